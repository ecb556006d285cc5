"""The corpus pipeline: documents to encoded training text in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows it gets; the result is written
and read again before the next one. All but the last return the columns of documents.
Texts may be null or empty and ids missing; rows without an id pass like any other. An empty
table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchtide.llm import exact, jaccard, mixing, pieces, toxicity
from watchtide.llm.common import prepare, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = ("_id", "_without", "_digest")
#: Below all ids.
LOWEST = -(1 << 63)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go. It learns from labelled documents outside the held-out part.

    Rows are judged one by one: repeated rows and rows that share an id stay or go by their own
    texts, and texts of any length are read whole. Columns beside those of documents are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, keep=COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays, once if it is repeated.

    Rows are met by id and digest: neither a missing id nor two texts of one id lose a row,
    and the copies of one text are spread by their ids.
    """
    found = exact.exact_dedup(docs, exact.DigestIndex.fresh(spark)).filter("kept")
    kept = found.select(*_key(F.col("doc_id"), F.col("text_sha256"))).distinct()
    rows = docs.select(*COLUMNS, *_key(F.col("doc_id"), exact.digest(F.col("text"))))
    return rows.join(kept, list(KEY)).dropDuplicates(list(KEY)).select(*COLUMNS)


def _key(doc_id: Column, digest: Column) -> list[Column]:
    return [c.alias(k) for c, k in zip((F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), digest), KEY, strict=True)]


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the one with the smallest id stays.

    Different texts of one id are nodes of their own: all but the first of them, by digest, get a
    number below all ids for the join, and of a linked group the smallest true id stays.
    Repeated rows (one id, one text) stay or go together; texts with no words, and rows without an
    id, stay. Texts are read whole; other columns are dropped.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("_digest")
    rows = docs.select(*COLUMNS, digest)
    texts = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("_digest").alias("first"), F.max("_digest").alias("last"))
    shared = stored(texts.filter("first <> last").select("doc_id", "first"), "pipeline-shared-ids")
    if shared.isEmpty():
        found = jaccard.near_duplicates(docs)
        gone = found.filter("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    others = rows.join(shared, "doc_id").filter("_digest <> first").select("doc_id", "_digest").distinct()
    numbered = others.select("doc_id", "_digest", (F.lit(LOWEST) + F.monotonically_increasing_id()).alias("_number"))
    numbered = stored(numbered, "pipeline-numbers")
    rows = rows.join(numbered, ["doc_id", "_digest"], "left").withColumn("_node", F.coalesce("_number", "doc_id"))
    rows = stored(rows.select(*COLUMNS, "_node"), "pipeline-nodes")
    found = jaccard.near_duplicates(rows, id_col="_node").filter("doc_id is not null").select(
        F.col("doc_id").alias("_node"), F.col("component_id").alias("_group")
    ).distinct()
    named = found.join(numbered.select("_number", "doc_id"), F.col("_node") == F.col("_number"), "left")
    named = named.select("_node", "_group", F.coalesce("doc_id", "_node").alias("_id"))
    first = named.groupBy("_group").agg(F.min(F.struct("_id", "_node")).alias("stays"))
    gone = named.join(first, "_group").filter(F.col("_node") != F.col("stays._node")).select("_node")
    return rows.join(gone, "_node", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many whole copies of a document as the mix takes of its words, rounded: none, one or
    two. Documents without words, which weigh nothing, stay once.

    Rows of one id and text count as one document, the largest share of them taken; ties in the
    shuffle go by id. Texts are read whole; other columns are dropped.
    """
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    copies = mixing.mix(docs).groupBy("row_key").agg(F.max(copies).alias("copies")).filter("copies > 0")
    rows = docs.select(*COLUMNS, mixing.row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    many = rows.join(copies, "row_key")
    return many.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids: one row per row of the mix, repeated rows and ids included.

    Null and empty texts have no pieces; very long texts are cut into chunks and joined again.
    """
    coded = pieces.encode(docs).select("doc_id", "text_sha256", "ids")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("SentencePiece encoding", encode),
]

# The first stage is a trained model, which SQL can't express; tests compare the rest with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's result is a table in the shared folder."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
