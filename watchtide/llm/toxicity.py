"""Toxicity by compression distance.

Two zstandard dictionaries: one trained on windows of ordinary text, one on windows of toxic
text. The toxic compressor has its dictionary in front of the ordinary one, so that what both
know costs the same. A text is cut into overlapping byte windows; a window that the
toxic compressor makes shorter than the ordinary one holds something only toxic text
has. The savings per window become a few numbers per text, and a logistic curve fitted on
labelled texts turns them into a calibrated score.

Toxic texts are mostly ordinary, so the windows the toxic dictionary is trained on are cut
around telling words: words met between many different neighbours in toxic samples and
(nearly) never in ordinary ones. Counting neighbours instead of texts keeps a text with
hundreds of copies from making its rare words look telling.

The model is fitted on a bounded sample of labelled rows, chosen by a hash of the id: at
most ``SAMPLE`` toxic ones and twice as many ordinary ones. Dictionaries are trained on at most
``PIECES`` windows of each, spread evenly over the whole text, which come to the driver (30 MB
at most); the curve is fitted on features of the sampled texts, whole, computed in tasks.
Everything else runs over all rows and whole texts.

Defined cases: null and empty texts have one empty window and are scored like any other;
rows are independent, so repeated rows get equal scores; an empty table gives an empty
result; without labels of both classes every score is the share of toxic labels, or 0;
several labels of one document count as toxic if one does; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.llm.common import stored
from watchtide.llm.shingles import mixed

SAMPLE = 3000
PIECES, PIECE = 32, 96
THRESHOLD = 0.3
WINDOW, STEP = 96, 80
LEVEL = 9
ORDINARY_BYTES = 32768
TOXIC_BYTES = 1024
LEAST_CONTEXTS = 4
TIMES_ORDINARY = 100
#: Of the windows the toxic dictionary is trained on: bytes to either side of a telling word, and windows of one word.
AROUND, OF_A_WORD = 1, 64
#: They are trained on in runs of so many, in so many orders.
RUN, ORDERS = 8, 8
SAVED = (1, 2, 4, 6)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _contexts(texts: list[bytes]) -> dict[bytes, int]:
    """Different (word before, word after) pairs by lower-cased word.

    A met word is one number, its code before 40 bits for its neighbours, so that memory is
    some bytes a word; two pairs of one word with equal bits would count as one.
    """
    codes: dict[bytes, int] = {b"": 0}
    met = [np.zeros(0, dtype=np.uint64)]
    for text in texts:
        found = (codes.setdefault(w, len(codes)) for w in re.findall(rb"[^\s.,;:!?]+", text.lower()))
        row = np.array([0, *found, 0], dtype=np.uint64)
        met.append(row[1:-1] << np.uint64(40) | mixed(row[:-2] << np.uint64(32) | row[2:]) >> np.uint64(24))
    seen = np.concatenate(met)
    met.clear()
    seen.sort()
    words = (seen[np.concatenate([seen[:1] >= 0, seen[1:] != seen[:-1]])] >> np.uint64(40)).astype(np.int64)
    counts = np.bincount(words, minlength=len(codes)).tolist()
    return {word: counts[code] for word, code in codes.items() if counts[code]}


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary content."""
    bad, good = _contexts(toxic), _contexts(ordinary)
    n_bad, n_good = max(1, sum(bad.values())), max(1, sum(good.values()))
    marks = [
        w
        for w, n in bad.items()
        if n >= LEAST_CONTEXTS and n / n_bad >= TIMES_ORDINARY * (good.get(w, 0) + 0.5) / n_good
    ]
    marks.sort(key=lambda w: (bad[w], w))
    plain = _trained([t[i : i + 64] for t in ordinary for i in range(0, len(t), 64)], ORDINARY_BYTES)
    if not marks:
        return plain, plain
    telling = re.compile(rb"(?<![^\s.,;:!?])(?:" + b"|".join(re.escape(w) for w in sorted(marks, key=len, reverse=True)) + rb")(?![^\s.,;:!?])", re.I)
    near: list[bytes] = []
    seen: dict[bytes, int] = {}
    for t in toxic:
        for m in telling.finditer(t):
            word = m.group().lower()
            seen[word] = seen.get(word, 0) + 1
            if seen[word] <= OF_A_WORD:
                near.append(t[max(0, m.start() - AROUND) : m.end() + AROUND])
    # In runs of several, in ever other orders, so that segments hold whole words of many kinds.
    rng = np.random.default_rng(5)
    orders = [rng.permutation(len(near)) for _ in range(ORDERS)]
    samples = [b"".join(near[i] for i in order[a : a + RUN]) for order in orders for a in range(0, len(near), RUN)]
    return _trained(samples, TOXIC_BYTES, 32, 6) + plain, plain


def _trained(windows: list[bytes], size: int, k: int = 32, d: int = 8) -> bytes:
    """A dictionary of at most ``size`` bytes, of segments of ``k`` bytes told by runs of ``d``; too
    little text to train on stands for itself."""
    try:
        return zstandard.train_dictionary(size, windows, k=k, d=d, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(windows)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)


def _lengths(compressor, data: bytes, segments: np.ndarray) -> np.ndarray:
    windows = zstandard.BufferWithSegments(data, np.ascontiguousarray(segments, dtype=np.uint64).tobytes())
    out = compressor.multi_compress_to_buffer(windows, threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), dtype=np.int64, count=len(out))


def features(texts: list[bytes], toxic, ordinary) -> np.ndarray:
    """A row per text: what windows save with the toxic dictionary."""
    table = np.zeros((len(texts), 6 + len(SAVED)))
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= 4 << 20):
            size += len(texts[upto])
            upto += 1
        table[at:upto] = _block(texts[at:upto], toxic, ordinary)
        at = upto
    return table


def _block(texts: list[bytes], toxic, ordinary) -> np.ndarray:
    # An empty text is one blank: every text then has a window.
    texts = [t or b" " for t in texts]
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-(sizes - (WINDOW - STEP)) // STEP))
    first = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(texts)), counts)
    begin = (np.arange(first[-1]) - first[owner]) * STEP
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])[owner]
    segments = np.stack([base + begin, np.minimum(WINDOW, sizes[owner] - begin)], axis=1)
    data = b"".join(texts)
    saved = _lengths(ordinary, data, segments) - _lengths(toxic, data, segments)
    order = np.lexsort((-saved, owner))
    ranked, rank = saved[order], np.arange(first[-1]) - first[owner]
    out = np.zeros((len(texts), 6 + len(SAVED)))
    out[:, 0] = ranked[first[:-1]]
    second = rank == 1
    out[owner[second], 1] = ranked[second]
    top = rank < 3
    out[:, 2] = np.bincount(owner[top], ranked[top], len(texts)) / np.minimum(counts, 3)
    out[:, 3] = np.bincount(owner, saved, len(texts)) / counts
    out[:, 4] = np.log(counts)
    out[:, 5] = np.bincount(owner[saved >= 4], minlength=len(texts)) / counts
    for i, least in enumerate(SAVED):
        out[:, 6 + i] = np.log1p(np.bincount(owner[saved >= least], minlength=len(texts)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Dictionaries and curve; ``score`` works on UTF-8 texts."""

    def __init__(self, contents: tuple[bytes, bytes], center, scale, weights):
        self.contents, self.center, self.scale, self.weights = contents, center, scale, weights

    def score(self, texts: list[bytes], compressors=None) -> np.ndarray:
        toxic, ordinary = compressors or [_compressor(c) for c in self.contents]
        x = (features(texts, toxic, ordinary) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _pieces(text: bytes) -> bytes:
    """A text of up to ``PIECES`` windows; of a longer one as many, spread evenly over it."""
    if len(text) <= PIECES * PIECE:
        return text
    return b"\n".join(text[at : at + PIECE] for at in ((len(text) - PIECE) * k // (PIECES - 1) for k in range(PIECES)))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic, half) of the rows learned from: ids are chosen from the labels, then their texts fetched."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    ids = None
    for value, most in ((1, sample), (0, 2 * sample)):
        mine = marks.filter(F.col("toxic") == value).orderBy("h", "doc_id").limit(most)
        ids = mine if ids is None else ids.union(mine)
    ids = stored(ids, "toxicity-ids")  # at most 3 * sample rows
    # Of rows that share an id one is learned from.
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(ids, "doc_id")
    texts = texts.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    return stored(texts.select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("half")), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From documents and labels (doc_id, toxic). The curve sees every text of the bounded sample
    through dictionaries trained on the other half of it; the final dictionaries use both halves."""
    rows = sampled(docs, labels, sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = pa.array([_pieces(t.as_py().encode()) for t in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([blobs, batch.column(1), batch.column(2)], ["blob", "toxic", "half"])

    blobs = rows.mapInArrow(cut, "blob binary, toxic int, half int").toArrow().sort_by([("toxic", "ascending"), ("half", "ascending"), ("blob", "ascending")])
    of = lambda toxic, half: [b for b, t, h in zip(*(blobs[c].to_pylist() for c in ("blob", "toxic", "half")), strict=True) if t == toxic and h == half]
    parts = {(t, h): of(t, h) for t in (0, 1) for h in (0, 1)}
    n_toxic, n_ordinary = (len(parts[t, 0]) + len(parts[t, 1]) for t in (1, 0))
    width = 6 + len(SAVED)
    if not n_toxic or not n_ordinary:
        share = n_toxic / max(1, n_toxic + n_ordinary)
        return Model((b"", b""), np.zeros(width), np.ones(width), np.concatenate([[_odds(share)], np.zeros(width)]))
    other = {h: train_dictionaries(parts[1, 1 - h], parts[0, 1 - h]) for h in (0, 1)}
    contents = train_dictionaries(parts[1, 0] + parts[1, 1], parts[0, 0] + parts[0, 1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = {h: [_compressor(c) for c in other[h]] for h in other}
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            table = [features([t], *compressors[h])[0].tolist() for t, h in zip(texts, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(table, pa.list_(pa.float64()))], ["toxic", "x"])

    told = rows.mapInArrow(measure, "toxic int, x array<double>").orderBy("toxic", "x").toArrow()
    x, y = np.array(told["x"].to_pylist()), told["toxic"].to_numpy().astype(float)
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    w = _logistic(np.c_[np.ones(len(x)), (x - center) / scale], y)
    return Model(contents, center, scale, w)


def _odds(share: float) -> float:
    return float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, score (0 to 1), predicted; with ``keep``, these columns of every row in place of doc_id."""
    kept = [F.col(c) for c in keep] or [F.col(id_col).alias("doc_id")]
    # A text that is kept goes to the workers once.
    at = keep.index(text_col) if text_col in keep else len(kept)
    rows = docs.select(*kept, *([] if text_col in keep else [F.col(text_col).cast("string").alias("_scored")]))
    fields = rows.schema.fields[: len(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [_compressor(c) for c in model.contents]
        names = [*(f.name for f in fields), "score"]
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            scores = pa.array(model.score(texts, compressors))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], scores], names)

    scored = rows.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
