"""SentencePiece encoding and decoding by a max-plus parallel scan.

A segmentation is the sequence of vocabulary pieces with the largest sum of scores. With
"max" for addition and "+" for multiplication that is a product of matrices: for a chunk of
text, entry (i, j) is the best score of getting from i characters past its beginning to j
characters past its end (a piece may straddle a boundary, never more than the longest piece
allows). Matrices of neighbouring chunks combine associatively, so giant texts are cut into
chunks that are worked on independently: first every chunk's matrix, then one scan over a
text's small matrices that fixes the states at all boundaries, then every chunk is traced
back on its own between its two states.

No piece goes over the end of a word (a character before a blank), so inside a chunk words
are independent, a matrix factors there, and equal words are segmented once per task.

The vocabulary comes from a model file whose path is a parameter; the scores are its own.
Unknown characters cost ``UNKNOWN`` below the smallest score and become byte pieces, so
decoding gives back every text exactly, the sign for a blank included. Equal sums are told
apart by a small number per piece, so results do not depend on where chunks are cut.
Segmentation is by score; a model trained for merge order would segment some words
differently, with the same text when decoded.

Defined cases: null and empty texts have no pieces and decode to an empty text; texts of any
length; repeated rows give repeated rows; an empty table an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import stored
from watchtide.llm.shingles import runs

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32768
UNKNOWN = 10
#: A score counts this much; what tells equal sums apart counts 1 to 4096.
UNIT = 1 << 20
NEVER = -(1 << 62)
#: Bytes of words remembered by a task, of texts worked on together, and words of about one length.
REMEMBER = 32 << 20
RUN_BYTES = 4 << 20
BLOCK = 16384


_BASE = 0x9E3779B97F4A7C15
#: Longer words are segmented one at a time.
LONG_WORD = 64
#: Stands for "spell this character" while words are worked on together.
SPELLED = 1 << 21


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _polynomial(codes: np.ndarray) -> int:
    total = 0
    for code in codes.tolist():
        total = (total * _BASE + code + 1) & (1 << 64) - 1
    return int(_spread(np.array([total], dtype=np.uint64))[0])


class Vocabulary:
    """Pieces with blanks for the blank sign: text -> (id, weight); bytes of every id."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        lowest = 0.0
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace("▁", " ")
                lowest = min(lowest, model.get_score(i))
                tie = 1 + xxhash.xxh32_intdigest(text.encode()) % 4096
                self.pieces[text] = (i, round(model.get_score(i) * UNIT) - tie)
                self.bytes_of.append(text.encode())
        self.unknown = round((lowest - UNKNOWN) * UNIT)
        self.longest = max(map(len, self.pieces))
        self.unknown_id = model.unk_id()
        for code in range(128):  # unknown characters of one byte are pieces of that weight
            if chr(code) not in self.pieces:
                self.pieces[chr(code)] = (self.byte_ids.get(code, self.unknown_id), self.unknown)
        self._index()

    def _index(self) -> None:
        """Pieces by a hash of their code points, for many words at once."""
        hashes = {_polynomial(np.array([ord(c) for c in t], np.uint64)): v for t, v in self.pieces.items()}
        if len(hashes) < len(self.pieces):
            raise ValueError("two pieces have one hash")
        self.hashes = np.array(sorted(hashes), dtype=np.uint64)
        self.ids = np.array([hashes[int(h)][0] for h in self.hashes], dtype=np.int32)
        self.weights = np.array([hashes[int(h)][1] for h in self.hashes], dtype=np.int64)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def best_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentations, concatenated, and how many each word has.

        The same sums as ``best``. Words go in blocks of about one length, so that the tables
        are small whatever the number of words.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        easy = order[sizes[order] <= LONG_WORD]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for at in range(0, len(easy), BLOCK):
            block = easy[at : at + BLOCK]
            own, ids, step = self._best_block(flat, starts[block], sizes[block])
            found.append((block[own], ids, step))
        owner, ids, step = (np.concatenate(x) for x in zip(*found, strict=True))
        slow = np.flatnonzero(sizes > LONG_WORD)
        if len(slow):
            lists = [self.best(words[i])[1] for i in slow]
            owner = np.concatenate([owner, np.repeat(slow, [len(x) for x in lists])])
            ids = np.concatenate([ids, np.array([i for x in lists for i in x], np.int32)])
            step = np.concatenate([step, np.array([k for x in lists for k in range(len(x) - 1, -1, -1)], np.int64)])
        # Last pieces came first: count back from each word's end.
        each = np.bincount(owner, minlength=len(words))
        begin = np.concatenate([[0], np.cumsum(each)[:-1]])
        placed = np.empty(len(ids), dtype=np.int32)
        placed[begin[owner] + each[owner] - 1 - step] = ids
        return self._spelled(placed, each, owner_of=np.repeat(np.arange(len(words)), each))

    def _best_block(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, id, how many pieces from its end) for words given longest first, a position
        of all words at a time."""
        top = int(length[0])
        score = np.full((top + 1, len(length)), NEVER, dtype=np.int64)
        back = np.zeros((top + 1, len(length)), dtype=np.int8)
        piece = np.empty((top + 1, len(length)), dtype=np.int32)
        score[0] = 0
        prefix = np.zeros((top + 1, len(length)), dtype=np.uint64)
        powers = [np.uint64(1)]
        for _ in range(self.longest):
            powers.append(np.uint64(int(powers[-1]) * _BASE & (1 << 64) - 1))
        for p in range(1, top + 1):
            n = int(np.searchsorted(-length, -p, side="right"))  # the first n words reach p
            code = flat[start[:n] + p - 1]
            prefix[p, :n] = prefix[p - 1, :n] * powers[1] + code.astype(np.uint64) + np.uint64(1)
            score[p, :n] = score[p - 1, :n] + self.unknown
            back[p, :n] = 1
            piece[p, :n] = SPELLED + code.astype(np.int32)
            for size in range(min(p, self.longest), 0, -1):
                h = prefix[p, :n] - prefix[p - size, :n] * powers[size]
                h = _spread(h)
                at = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
                found = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                ok = self.hashes[found] == h[at]
                at, found = at[ok], found[ok]
                total = score[p - size, at] + self.weights[found]
                better = total > score[p, at]
                at, found = at[better], found[better]
                score[p, at], back[p, at], piece[p, at] = total[better], size, self.ids[found]
        columns, p, alive = [], length.copy(), np.arange(len(length))
        while len(alive):
            alive = alive[p[alive] > 0]
            columns.append((alive, piece[p[alive], alive]))
            p[alive] -= back[p[alive], alive]
        step = np.concatenate([np.full(len(c[0]), k, np.int64) for k, c in enumerate(columns)])
        return np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns]), step

    def _spelled(self, ids: np.ndarray, each: np.ndarray, owner_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters of several bytes become their bytes' ids."""
        odd = np.flatnonzero(ids >= SPELLED)
        if not len(odd):
            return ids, each
        spelling = {c: self.spell(chr(c - SPELLED)) for c in np.unique(ids[odd]).tolist()}
        times_ = np.ones(len(ids), dtype=np.int64)
        times_[odd] = [len(spelling[c]) for c in ids[odd].tolist()]
        out = np.repeat(ids, times_)
        at = np.cumsum(times_)[odd] - times_[odd]
        for i, c in zip(at.tolist(), ids[odd].tolist(), strict=True):
            out[i : i + len(spelling[c])] = spelling[c]
        return out, np.bincount(owner_of, times_, len(each)).astype(np.int64)

    def spell(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.byte_ids.get(b, self.unknown_id) for b in char.encode("utf-8", "surrogatepass")]

    def edges(self, text: str, end: int, first: int) -> Iterator[tuple[int, int, int | None]]:
        """(begin, weight, id) of the pieces that end at ``end`` and begin at ``first`` or later."""
        get = self.pieces.get
        for begin in range(max(first, end - self.longest), end):
            found = get(text[begin:end])
            if found:
                yield begin, found[1], found[0]
            elif begin == end - 1:
                yield begin, self.unknown, None

    def best(self, text: str, end: int | None = None) -> tuple[int, list[int]]:
        """(weight, ids) of the best segmentation from 0 to ``end``; only pieces within it."""
        end = len(text) if end is None else end
        get, longest, unknown = self.pieces.get, self.longest, self.unknown
        weight, back = [0] * (end + 1), [0] * (end + 1)
        for p in range(1, end + 1):
            top = weight[p - 1] + unknown
            at = p - 1
            for q in range(p - longest if p > longest else 0, p):
                found = get(text[q:p])
                if found and weight[q] + found[1] > top:
                    top, at = weight[q] + found[1], q
            weight[p], back[p] = top, at
        ids: list[int] = []
        p = end
        while p:
            q = back[p]
            found = get(text[q:p])
            ids.extend([found[0]] if found else reversed(self.spell(text[q:p])))
            p = q
        return weight[end], ids[::-1]


def cuts(text: str, upto: int) -> list[int]:
    """Positions up to ``upto`` that every segmentation passes: a blank after another character."""
    out = []
    at = text.find(" ", 1)
    while 0 < at <= upto:
        if text[at - 1] != " ":
            out.append(at)
        at = text.find(" ", at + 1)
    return out


class Words:
    """Segmentations of words, remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known, self.held = vocabulary, {}, 0

    def __call__(self, word: str) -> tuple[int, list[int]]:
        found = self.known.get(word)
        if found is None:
            found = self.vocabulary.best(word)
            self.held += 250 + len(word) + 40 * len(found[1])
            if self.held > REMEMBER:
                self.known.clear()
                self.held = 0
            self.known[word] = found
        return found


def matrix(vocabulary: Vocabulary, words: Words, text: str, size: int) -> np.ndarray:
    """Best weight from i past the beginning to j past ``size``; ``text`` may look further ahead."""
    width = vocabulary.longest
    at = [c for c in cuts(text, size) if c >= width]
    first, last = (at[0], at[-1]) if at else (size, size)
    # From every possible beginning to the first cut (or the end).
    reach = np.full((size + width if not at else first + 1, width), NEVER, dtype=np.int64)
    reach[np.arange(min(width, len(reach))), np.arange(min(width, len(reach)))] = 0
    _walk(vocabulary, text, reach, 0, first, size)
    if not at:
        return reach[size : size + width].T.copy()
    middle = sum(words(text[a:b])[0] for a, b in zip(at[:-1], at[1:], strict=True))
    tail = np.full((size - last + width, 1), NEVER, dtype=np.int64)
    tail[0] = 0
    _walk(vocabulary, text[last:], tail, 0, size - last, size - last)
    ends = tail[size - last : size - last + width, 0]
    return times(reach[first][:, None], np.where(ends > NEVER // 2, ends + middle, NEVER)[None, :])


def _walk(vocabulary: Vocabulary, text: str, reach: np.ndarray, first: int, stop: int, size: int) -> None:
    """Best weights (a column per beginning) at every position; pieces begin before ``size``."""
    for end in range(first + 1, min(len(reach) - 1, len(text)) + 1):
        for begin, weight, _ in vocabulary.edges(text, end, first):
            if begin < size and begin < max(stop, 1):
                np.maximum(reach[end], np.where(reach[begin] > NEVER // 2, reach[begin] + weight, NEVER), out=reach[end])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    total = a[:, :, None] + b[None, :, :]
    dead = (a[:, :, None] < NEVER // 2) | (b[None, :, :] < NEVER // 2)
    return np.where(dead, NEVER, total).max(axis=1)


def trace(vocabulary: Vocabulary, words: Words, text: str, size: int, i: int, j: int) -> list[int]:
    """Ids of the best way from ``i`` to ``size + j``."""
    text = text[i : size + j]
    # A piece that begins before ``size`` reaches the end: what lies beyond is one piece's rest.
    size -= i
    if size <= 0:
        return []
    at = [0, *cuts(text, size)]
    ids: list[int] = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        ids.extend(words(text[a:b])[1])
    last = text[at[-1] :]
    size -= at[-1]
    if not size:
        return ids
    if not j:
        return ids + words(last)[1]
    best = None
    for begin, weight, piece in vocabulary.edges(last, len(last), 0):
        if begin < size:
            before = vocabulary.best(last, begin)
            if best is None or before[0] + weight > best[0]:
                best = before[0] + weight, before[1] + ([piece] if piece is not None else vocabulary.spell(last[begin:]))
    return ids + best[1]


def _gather(codes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ids of the coded words, and the length of each."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    each = sizes[codes]
    ends = np.cumsum(each)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - each), each)
    return flat[where], each


def _encode_short(texts: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """Ids of texts of a chunk at most."""
    parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
    offsets = parts.offsets.to_numpy()
    coded = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    known = [" " + w for w in coded.dictionary.to_pylist()]
    ids, each = _gather(codes, *vocabulary.best_many(known))
    upto = np.concatenate([[0], np.cumsum(each)])[offsets]
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, text_sha256, ids."""
    vocabulary = Vocabulary(model)
    if chunk < 2 * vocabulary.longest:
        raise ValueError("a chunk must be longer than two pieces")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # Runs of blanks make words of their own shape; such texts take the chunk's way, too.
    plain = (F.length("text") < chunk) & (F.col("text") != "") & ~F.contains("text", F.lit("  ")) & ~F.endswith("text", F.lit(" ")) & ~F.startswith("text", F.lit(" "))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch.column(2), RUN_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, len(texts)) for c in batch.columns[:2]), _encode_short(texts, vocabulary)],
                    ["doc_id", "text_sha256", "ids"],
                )

    form = f"doc_id {kind}, text_sha256 string, ids array<int>"
    done = rows.filter(plain).mapInArrow(short, form)
    rest = rows.filter(~plain)
    # Chunks of distinct texts; a chunk sees as far ahead as a piece can reach.
    width = vocabulary.longest
    whole = F.concat(F.lit(" "), F.col("text"))
    n = F.greatest(F.lit(1), F.floor((F.length("text") + 1 - width) / chunk).cast("int") + 1)
    chunks = (
        rest.filter("text <> ''")
        .select("text_sha256", whole.alias("text"), n.alias("n"))
        .dropDuplicates(["text_sha256"])
        .select("text_sha256", "n", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        .withColumn("last", F.col("k") == F.col("n") - 1)
        .select(
            "text_sha256",
            "k",
            F.when(F.col("last"), F.length("text") - F.col("k") * chunk).otherwise(F.lit(chunk)).cast("int").alias("size"),
            F.when(F.col("last"), F.substr("text", F.col("k") * chunk + 1, F.length("text")))
            .otherwise(F.substr("text", F.col("k") * chunk + 1, F.lit(chunk + width)))
            .alias("text"),
        )
    )
    chunks = stored(chunks, "pieces-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary)
        for whole in batches:
            for first, texts in runs(whole.column(3), RUN_BYTES):
                batch = whole.slice(first, len(texts))
                made = [matrix(vocabulary, words, t, s).tobytes() for t, s in zip(texts.to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["text_sha256", "k", "m"])

    def states(frame: pd.DataFrame) -> pd.DataFrame:
        """The scan: weights at every boundary forwards, the best states backwards."""
        frame = frame.sort_values("k")
        each = [np.frombuffer(m, dtype=np.int64).reshape(width, width) for m in frame["m"]]
        weights = [np.full((1, width), NEVER, dtype=np.int64)]
        weights[0][0, 0] = 0
        for m in each:
            weights.append(times(weights[-1], m))
        at, ends = 0, []
        for before, m in zip(weights[-2::-1], each[::-1], strict=True):
            begin = int(np.where((before[0] < NEVER // 2) | (m[:, at] < NEVER // 2), NEVER, before[0] + m[:, at]).argmax())
            ends.append((begin, at))
            at = begin
        ends.reverse()
        return pd.DataFrame({"text_sha256": frame["text_sha256"], "k": frame["k"], "i": [x for x, _ in ends], "j": [y for _, y in ends]})

    many = chunks.filter("k > 0").select("text_sha256").distinct()
    scanned = (
        chunks.join(many, "text_sha256", "left_semi")
        .mapInArrow(matrices, "text_sha256 string, k int, m binary")
        .groupBy("text_sha256")
        .applyInPandas(states, "text_sha256 string, k int, i int, j int")
    )
    placed = chunks.join(scanned, ["text_sha256", "k"], "left").select(
        "text_sha256", "k", "size", "text", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("j", F.lit(0)).alias("j")
    )

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary)
        for whole in batches:
            # Whole batches of chunks are hundreds of megabytes.
            for first, texts in runs(whole.column(3), RUN_BYTES):
                batch = whole.slice(first, len(texts))
                rows_ = zip(*(batch.column(c).to_pylist() for c in (3, 2, 4, 5)), strict=True)
                ids = pa.array([np.array(trace(vocabulary, words, *row), np.int32) for row in rows_], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["text_sha256", "k", "ids"])

    joined = (
        placed.mapInArrow(traced, "text_sha256 string, k int, ids array<int>")
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
        .select("text_sha256", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    )
    rest = rest.drop("text").join(joined, "text_sha256", "left")
    return done.unionByName(
        rest.select("doc_id", "text_sha256", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    )


def decode(rows: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The kept columns and ``text`` for ``ids``; null ids give an empty text.

    Expressions only, so that a task that encodes and decodes has one Python worker. Byte pieces are
    no text on their own: a character stands for a byte until all pieces are joined. An id the
    model lacks is an error.
    """
    mark = chr(256)  # no byte
    table = F.split(F.lit(mark.join(b.decode("latin-1") for b in Vocabulary(model).bytes_of)), mark)
    joined = F.array_join(F.transform(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: table[i]), "")
    first = F.when(F.startswith(F.col("_bytes"), F.lit(" ")), 2).otherwise(1)
    raw = F.encode(F.substring(F.col("_bytes"), first, F.length("_bytes")), "ISO-8859-1")
    return rows.select(*keep, joined.alias("_bytes")).select(*keep, F.make_valid_utf8(raw.cast("string")).alias("text"))
