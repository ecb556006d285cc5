"""Documents and vectors: chunks, exact similarity search, trust filter and context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchtide.functions.hashing import chunk_id
from watchtide.functions.text import fixed, has
from watchtide.operators import cells

# Chunk size, overlap and separators, hits and relevance.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", ". ", " ")
TOP_K = 3
#: Characters of chunks handed on at a time.
CHUNK_BYTES = 4 << 20
MIN_RELEVANCE = 0.4


def _stop(text: str, start: int, size: int, overlap: int) -> int:
    """End of the chunk at ``start``: after the last best separator past the overlap."""
    end = start + size
    if end >= len(text):
        return len(text)
    for sep in SEPARATORS:
        at = text.rfind(sep, start + overlap, end)
        if at >= 0:
            return at + len(sep)
    return end


def _chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, chunk) in order."""
    start = 0
    while start < len(text):
        stop = _stop(text, start, size, overlap)
        yield start, text[start:stop]
        if stop == len(text):
            break
        back = stop - overlap
        space = text.find(" ", back, stop - 1) if overlap else -1
        start = space + 1 if space >= 0 else back


def chunk_text(
    df: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Overlapping chunks of each text in order, cut at the best separator that fits."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")

    at = df.columns.index(text)
    keep = [f for f in df.schema.fields if f.name != text]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in keep]
        for batch in batches:
            others = [c for i, c in enumerate(batch.columns) if i != at]
            made, held = [], 0
            for k in range(batch.num_rows):
                for i, (start, chunk) in enumerate(_chunks(batch.column(at)[k].as_py() or "", size, overlap)):
                    made.append((k, i, start, chunk))
                    held += len(chunk)
                    if held > CHUNK_BYTES:  # a long text's chunks go on while it is cut
                        yield _chunk_batch(others, names, made)
                        made, held = [], 0
            yield _chunk_batch(others, names, made)

    added = [T.StructField(n, T.IntegerType()) for n in ("chunk_index", "chunk_start")]
    return df.mapInArrow(split, T.StructType([*keep, *added, T.StructField("chunk", T.StringType())]))


def _chunk_batch(others: list[pa.Array], names: list[str], made: list[tuple]) -> pa.RecordBatch:
    row, index, start, chunk = zip(*made, strict=True) if made else ((), (), (), ())
    at = pa.array(row, pa.int64())
    added = [pa.array(index, pa.int32()), pa.array(start, pa.int32()), pa.array(chunk, pa.string())]
    return pa.RecordBatch.from_arrays([*[c.take(at) for c in others], *added], [*names, "chunk_index", "chunk_start", "chunk"])


def join_chunks(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The texts that chunks were cut from, put together by their starts: keys, text."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_start", "chunk")))
    joined = F.aggregate(
        "parts", F.lit(""), lambda text, c: F.concat(text, F.substr(c["chunk"], F.length(text) - c["chunk_start"] + 1))
    )
    return chunks.groupBy(*keys).agg(parts.alias("parts")).select(*keys, joined.alias("text"))


def dedup_chunks(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """One row per distinct chunk text under its hash; the last payload stays."""
    cols = [c for c in df.columns if c != text]
    rows = df.withColumn("chunk_id", chunk_id(F.col(text)))
    last = rows.groupBy("chunk_id").agg(
        F.max_by(F.struct(*cols, text), F.struct(*order)).alias("r")
    )
    return last.select("chunk_id", "r.*")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(embedding: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with one query vector, 0 for a zero vector."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(_dot(v, v)) * F.lit(float(np.linalg.norm(np.asarray(query, dtype=float))))
    return F.when(norm > 0, _dot(v, q) / norm).otherwise(F.lit(0.0))


def payload_filter(df: DataFrame, **equals) -> DataFrame:
    """Points whose fields all have the given values; applied before ranking."""
    for column, value in equals.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def vector_search(
    points: DataFrame,
    query: Sequence[float],
    k: int = TOP_K,
    threshold: float | None = None,
    id_col: str = "id",
) -> DataFrame:
    """The k most similar points, ties by id."""
    scored = points.withColumn("score", cosine(F.col("embedding"), query))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.col("score").desc(), id_col).limit(k)


def vector_search_many(
    points: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    threshold: float | None = None,
    id_col: str = "id",
    query_col: str = "query_id",
) -> DataFrame:
    """The k most similar points of every query, exactly, over an index of cells (see ``cells``)."""
    index = cells.CellIndex(points, id_col)
    asked = queries.select(F.col(query_col).alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    if index.empty:
        form = [queries.schema[query_col], points.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
        return points.sparkSession.createDataFrame([], T.StructType(form))
    hits, _ = cells.search(index, asked, k)
    if threshold is not None:
        hits = hits.filter(F.col("score") >= threshold)
    return hits.select(F.col("query_id").alias(query_col), F.col("id").alias(id_col), "score", "rank")


def search_multi(
    points: DataFrame,
    query: Sequence[float],
    collections: Sequence | None = None,
    k: int = TOP_K,
    collection: str = "collection",
    id_col: str = "id",
) -> DataFrame:
    """The k most similar points of each collection; unknown collections give none."""
    rows = points if collections is None else points.filter(F.col(collection).isin(*collections))
    scored = rows.withColumn("score", cosine(F.col("embedding"), query))
    rank = Window.partitionBy(collection).orderBy(F.col("score").desc(), id_col)
    return scored.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def retrieve(
    points: DataFrame,
    query: Sequence[float],
    collections: Sequence | None = None,
    k: int = TOP_K,
    collection: str = "collection",
    id_col: str = "id",
) -> DataFrame:
    """The k best hits over all collections."""
    hits = search_multi(points, query, collections, k, collection, id_col).drop("rank")
    return hits.orderBy(F.col("score").desc(), id_col).limit(k)


def build_context(
    hits: DataFrame,
    text: str = "text",
    filename: str = "filename",
    source: str = "source",
    id_col: str = "id",
    k: int = TOP_K,
) -> DataFrame:
    """Numbered text blocks of the k best hits as one text, and the best score; one row."""
    label = F.coalesce(
        F.nullif(filename, F.lit("")), F.nullif(source, F.lit("")), F.lit("Unknown")
    )
    best = hits.orderBy(F.col("score").desc(), id_col).limit(k)
    rows = best.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("score")).alias("o"), id_col, label.alias("label"), F.col(text).alias("text")
                )
            )
        ).alias("hits"),
        F.max("score").alias("best"),
    )
    blocks = F.transform(
        "hits",
        lambda h, i: F.concat(
            F.format_string(
                "[Source %d: %s (relevance: %s)]\n", i + 1, h["label"], fixed(-h["o"], 2)
            ),
            h["text"],
        ),
    )
    return rows.select(
        F.array_join(blocks, "\n\n---\n\n").alias("context"),
        F.size("hits").alias("sources"),
        F.coalesce("best", F.lit(0.0)).alias("max_confidence"),
    )


# Trust levels best first, and patterns of documents that give orders.
TRUST = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
POISON = (
    r"ignore\s+(previous|above|all)\s+instructions",
    r"you\s+are\s+now\s+(a|an)\b",
    r"system\s+prompt",
    r"pretend\s+you\s+are",
)


def rag_allowed(score: Column, content: Column) -> Column:
    """Relevant enough and not trying to instruct; the lowest trust level is accepted."""
    return (score >= MIN_RELEVANCE) & ~has(content, *POISON)


def rag_filter(
    df: DataFrame,
    score: str = "relevance_score",
    content: str = "content",
    trust: str = "trust_level",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Allowed and filtered counts, highest trust and mean relevance of retrieved documents.

    An unknown trust level passes and counts as above all others.
    """
    ok = rag_allowed(F.col(score), F.col(content))
    rank = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(t) for t in TRUST]), F.col(trust)), F.lit(0)),
        F.lit(0),
    )
    return df.groupBy(*keys).agg(
        F.count_if(ok).alias("allowed"),
        F.count_if(~ok).alias("filtered"),
        F.min_by(F.when(ok, F.col(trust)), F.when(ok, rank)).alias("highest_trust"),
        F.coalesce(F.avg(F.when(ok, F.col(score))), F.lit(0.0)).alias("mean_relevance"),
    )


def collection_stats(points: DataFrame, collection: str = "collection") -> DataFrame:
    return points.groupBy(collection).agg(F.count(F.lit(1)).alias("points"))


# Collections each assistant reads.
ASSISTANTS = {
    "analyst": ("alerts", "incidents", "knowledge"),
    "audit": ("incidents", "logs", "knowledge"),
    "documentation": ("knowledge",),
    "incident": ("incidents", "alerts", "logs"),
}
DEFAULT_ASSISTANT = "analyst"


def assistant_scope(points: DataFrame, assistant: str, collection: str = "collection") -> DataFrame:
    """Only the collections an assistant reads; an unknown one reads what the analyst does."""
    names = ASSISTANTS.get(assistant, ASSISTANTS[DEFAULT_ASSISTANT])
    return points.filter(F.col(collection).isin(*names))


def assistants_table(spark: SparkSession) -> DataFrame:
    rows = [(a, c) for a, cs in ASSISTANTS.items() for c in cs]
    return spark.createDataFrame(rows, "assistant string, collection string")


def scope_requests(requests: DataFrame, assistants: DataFrame) -> DataFrame:
    """Collections of each request by its assistant."""
    names = [r for r in ASSISTANTS]
    known = F.when(F.col("assistant").isin(*names), F.col("assistant")).otherwise(DEFAULT_ASSISTANT)
    return requests.withColumn("assistant", known).join(assistants, "assistant")
