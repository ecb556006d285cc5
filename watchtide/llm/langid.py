"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads a window of bytes in both directions. From what it knows after each byte,
before and behind, it gives every position a probability of every language; a text's
probabilities are the means over all its positions. It is trained here in numpy by
backpropagation through time, every position of a window being an example of its text's language.

Texts are read whole: they are cut into windows of ``INNER`` bytes with ``OUTER`` bytes to
either side that are read but not counted, and the windows of many texts go through the
network together.

The training sample is bounded: at most ``TEXTS`` texts of each language, chosen by a hash
of the id from the rows that may be learned from, and ``WINDOWS`` windows of each, spread
evenly over the whole text. Only these windows come to the driver; scoring covers every row.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is all
where nothing can be learned from; rows without an id are not learned from; rows are independent, so
repeated rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from watchtide.llm.common import stored
from watchtide.llm.shingles import runs

UNKNOWN = "und"
TEXTS = 400
WINDOWS = 4
LENGTH = 64
HIDDEN = 8
EPOCHS = 5
BATCH = 256
#: Batches at least, so that few windows are read more often.
STEPS = 120
RATE = 0.02
INNER, OUTER = 160, 12
#: Windows that go through the network together, and bytes of texts at a time.
TOGETHER = 2048
RUN_BYTES = 2 << 20
#: Beside the 256 bytes, what stands before and behind a text.
PAD = 256
SYMBOLS = 257


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from; those without an id are neither."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Direction:
    """A gated recurrent layer that reads symbols one way. Tables are (number, window).

    ``x``: what a symbol adds to the update gate, the reset gate and the new state; ``u``: what
    the state before adds to them; ``b`` joins the state's part of the new state inside the reset gate.
    """

    def __init__(self, rng: np.random.Generator, hidden: int, kind: type = np.float32):
        self.x = rng.normal(0, 0.5, (3 * hidden, SYMBOLS)).astype(kind)
        self.u = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(kind)
        self.b = np.zeros((hidden, 1), dtype=kind)
        self.hidden = hidden

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b]

    def read(self, symbols: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """The state after every row of ``symbols`` (step, window); ``keep`` gets what ``learn`` needs.

        Outside a text the state is zero, however much of that a window holds.
        """
        n = self.hidden
        state = np.zeros((n, symbols.shape[1]), dtype=self.x.dtype)
        outside = symbols == PAD
        some = outside.any(axis=1)
        for t, row in enumerate(symbols):
            given, past = self.x.take(row, axis=1), self.u @ state
            past[2 * n :] += self.b
            gates = given[: 2 * n]
            gates += past[: 2 * n]
            # The logistic function as a tangent, which stays finite.
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = gates[n:] * past[2 * n :]
            new += given[2 * n :]
            np.tanh(new, out=new)
            after = state - new
            after *= gates[:n]
            after += new
            if some[t]:
                after[:, outside[t]] = 0
            if keep is not None:
                keep.append((row, state, gates[:n], gates[n:], past[2 * n :], new))
            state = after
            yield state

    def learn(self, keep: list, loss: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters, given the loss's gradient by the state after each step."""
        n, kind = self.hidden, self.x.dtype
        du, db = np.zeros_like(self.u), np.zeros_like(self.b)
        given = np.empty((len(keep), 3 * n, keep[0][1].shape[1]), dtype=kind)
        later = np.zeros_like(keep[0][1])
        for t in range(len(keep) - 1, -1, -1):
            row, state, update, reset, past, new = keep[t]
            up = loss[t] + later
            up[:, row == PAD] = 0
            a = up * (1 - update) * (1 - new * new)
            given[t, 2 * n :] = a
            given[t, :n] = up * (state - new) * update * (1 - update)
            given[t, n : 2 * n] = a * past * reset * (1 - reset)
            back = given[t].copy()
            back[2 * n :] = a * reset
            du += back @ state.T
            db += back[2 * n :].sum(axis=1, keepdims=True)
            later = up * update + self.u.T @ back
        # Sums by symbol.
        symbols = np.concatenate([k[0] for k in keep])
        order = np.argsort(symbols, kind="stable")
        cuts = np.flatnonzero(np.diff(symbols[order], prepend=-1))
        dx = np.zeros_like(self.x)
        dx[:, symbols[order][cuts]] = np.add.reduceat(given.transpose(0, 2, 1).reshape(-1, 3 * n)[order], cuts, axis=0).T
        return [dx, du, db]


class Network:
    """Both directions, and the languages' weights on what they know at a position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5, kind: type = np.float32):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ways = [Direction(rng, hidden, kind) for _ in range(2)]
        self.out = [rng.normal(0, hidden**-0.5, (len(languages), hidden)).astype(kind) for _ in range(2)]
        self.bias = np.zeros((len(languages), 1), dtype=kind)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ways[0].parameters(), *self.ways[1].parameters(), *self.out, self.bias]

    def probabilities(self, symbols: np.ndarray, keep: list[list] | None = None) -> np.ndarray:
        """(step, language, window) for symbols (step, window).

        Both the state before a position and the one behind it have read it.
        """
        steps = len(symbols)
        found = np.empty((steps, len(self.languages), symbols.shape[1]), dtype=self.bias.dtype)
        for t, state in enumerate(self.ways[0].read(symbols, keep and keep[0])):
            np.matmul(self.out[0], state, out=found[t])
        for t, state in enumerate(self.ways[1].read(symbols[::-1], keep and keep[1])):
            found[steps - 1 - t] += self.out[1] @ state
        found += self.bias
        found -= found.max(axis=1, keepdims=True)
        np.exp(found, out=found)
        found /= found.sum(axis=1, keepdims=True)
        return found

    def gradients(self, symbols: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the positions of weight 1, and its gradients."""
        keep: list[list] = [[], []]
        found = self.probabilities(symbols, keep)
        at = np.arange(symbols.shape[1])
        total = max(float(weight.sum()), 1.0)
        loss = -float((np.log(found[:, label, at] + 1e-30) * weight).sum()) / total
        found[:, label, at] -= 1
        found *= (weight / total)[:, None, :].astype(found.dtype)
        grads, outs = [], []
        for way, out, kept, slope in ((self.ways[0], self.out[0], keep[0], found), (self.ways[1], self.out[1], keep[1], found[::-1])):
            # The state after step t is the one before step t + 1; the last is made again.
            states = [k[1] for k in kept[1:]] + [_last(kept)]
            outs.append(sum(d @ s.T for s, d in zip(states, slope, strict=True)))
            grads += way.learn(kept, out.T @ slope)
        return loss, [*grads, *outs, found.sum(axis=(0, 2))[:, None]]

    def train(self, symbols: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> list[float]:
        """Adam over shuffled batches of windows (window, step); the loss of every epoch."""
        each = -(-len(symbols) // BATCH)
        epochs = max(epochs, -(-STEPS // each))
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        steps, losses = 0, []
        rounds = epochs * each
        for _ in range(epochs):
            order, sums = rng.permutation(len(symbols)), []
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                window = np.ascontiguousarray(symbols[rows].T)
                loss, grads = self.gradients(window, label[rows], (window != PAD).astype(self.bias.dtype))
                sums.append(loss)
                norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
                rate = RATE * (1 - steps / (rounds + 1)) * min(1.0, 1.0 / max(norm, 1e-9))
                steps += 1
                for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)).astype(p.dtype)
            losses.append(float(np.mean(sums)))
        return losses

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, language): mean probabilities over all bytes of texts that lie end to end in ``raw``."""
        sizes = np.diff(offsets)
        each = -(-sizes // INNER)
        owner = np.repeat(np.arange(len(sizes)), each)
        start = (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * INNER
        total = np.zeros((len(sizes), len(self.languages)))
        # Windows of one length together: the last of a text is shorter.
        length = np.minimum(sizes[owner] - start, INNER)
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), TOGETHER):
            rows = order[at : at + TOGETHER]
            steps = int(length[rows].max()) + 2 * OUTER
            place = start[rows][None, :] + np.arange(-OUTER, steps - OUTER)[:, None]
            inside = (place >= 0) & (place < sizes[owner[rows]][None, :])
            symbols = np.full(place.shape, PAD, dtype=np.int16)
            symbols[inside] = raw[(place + offsets[:-1][owner[rows]][None, :])[inside]]
            found = self.probabilities(symbols)[OUTER : steps - OUTER]
            found *= (np.arange(len(found))[:, None] < length[rows][None, :])[:, None, :]
            np.add.at(total, owner[rows], found.sum(axis=0, dtype=np.float64).T)
        return total / np.maximum(sizes, 1)[:, None]


def _last(kept: list) -> np.ndarray:
    row, state, update, _, _, new = kept[-1]
    return (new + update * (state - new)) * (row != PAD)


def _windows(raw: bytes) -> Iterator[np.ndarray]:
    """``WINDOWS`` windows spread evenly over a text, fewer if it is short."""
    n = min(WINDOWS, max(1, -(-len(raw) // LENGTH)))
    for k in range(n):
        at = (len(raw) - LENGTH) * k // max(n - 1, 1) if len(raw) > LENGTH else 0
        part = np.full(LENGTH, PAD, dtype=np.int16)
        piece = np.frombuffer(raw[at : at + LENGTH], dtype=np.uint8)
        part[: len(piece)] = piece
        yield part


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS) -> DataFrame:
    """lang, window (bytes of 16-bit symbols) of the texts learned from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).filter(has_letter(F.col("text")))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = rows.select("doc_id", "lang").withColumn("turn", turn).filter(F.col("turn") <= texts).select("doc_id", "lang").distinct()
    ids = stored(ids, "langid-ids")  # ``texts`` a language
    # Of rows that share an id and a language one is learned from.
    chosen = rows.join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                for part in _windows(text.as_buffer().to_pybytes()):
                    langs.append(lang)
                    parts.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "window"])

    return chosen.mapInArrow(run, "lang string, window binary")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def fit(windows: DataFrame) -> Network | None:
    """A network trained on ``sample``'s windows; none where there are none."""
    rows = windows.orderBy("lang", "window").toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    if not languages:
        return None
    label = np.array([languages.index(x) for x in rows["lang"].to_pylist()])
    symbols = np.frombuffer(b"".join(rows["window"].to_pylist()), dtype=np.int16).reshape(-1, LENGTH)
    network = Network(languages)
    network.train(symbols, label)
    return network


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score per row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), has_letter(text).alias("letter"))
    if network is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = pa.array([*network.languages, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch.column(1), RUN_BYTES):
                flat = pa.concat_arrays([texts.fill_null("").cast(pa.binary())])
                offsets = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
                raw = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
                letter = batch.column(2).slice(first, len(texts)).to_numpy(zero_copy_only=False).astype(bool)
                found = network.texts(raw, offsets)
                best = np.where(letter, found.argmax(axis=1), len(network.languages))
                score = np.where(letter, np.clip(found.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), names.take(pa.array(best)), pa.array(score, pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
