"""Chunks, vector search, trust filter and context over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.operators import retrieval
from watchtide.plans.governance import DOCS, _docs, rx
from watchtide.plans.registry import Tables, query
from watchtide.sources.adapters import spread

# The query vector is the first point's.
Q_SQL = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
SCORED = f"""{Q_SQL}, s AS (SELECT vec_id AS id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q)"""


def _points(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", "embedding")


def _query(t: Tables):
    return t.embeddings.orderBy("vec_id").limit(1).collect()[0]["embedding"]


def _hits(df, *cols):
    return df.select("id", *cols, F.round("score", 6).alias("score"))


@query("chunk_text")
def _(t):
    return retrieval.chunk_text(spread(t.documents.select("doc_id", "text")))


@query(
    "join_chunks",
    "SELECT doc_id, md5(text) AS digest, length(text) AS chars FROM documents WHERE text <> ''",
)
def _(t):
    chunks = retrieval.chunk_text(t.documents.select("doc_id", "text"))
    whole = retrieval.join_chunks(chunks, ["doc_id"])
    return whole.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@query(
    "dedup_chunks",
    "SELECT md5(text) AS chunk_id, max(doc_id) AS doc_id FROM documents GROUP BY 1",
)
def _(t):
    docs = t.documents.select("doc_id", "text")
    return retrieval.dedup_chunks(docs, "text", ["doc_id"]).select("chunk_id", "doc_id")


@query(
    "vector_search",
    f"WITH {SCORED} SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.05 ORDER BY s.score DESC, id LIMIT 10",
)
def _(t):
    return _hits(retrieval.vector_search(_points(t), _query(t), 10, 0.05))


CENTRES = """c AS (SELECT label AS query_id, i, avg(x) AS m FROM (SELECT label, unnest(generate_series(1, 64)) AS i,
    unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY 1, 2),
  qs AS (SELECT query_id, list(m ORDER BY i) AS q FROM c GROUP BY 1)"""


@query(
    "vector_search_many",
    f"""WITH {CENTRES}, s AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, qs),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
)
def _(t):
    parts = t.embeddings.select(F.col("label").alias("query_id"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(
        "query_id", F.transform("v", lambda e: e["m"]).alias("embedding")
    )
    out = retrieval.vector_search_many(_points(t), centres, 5)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "payload_filter",
    f"WITH {SCORED} SELECT id, label, round(score, 6) AS score FROM s WHERE label = 4 ORDER BY s.score DESC, id LIMIT 5",
)
def _(t):
    mine = retrieval.payload_filter(_points(t), label=4)
    return _hits(retrieval.vector_search(mine, _query(t), 5), "label")


@query(
    "search_multi",
    f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS rank FROM s WHERE label IN (1, 2, 5, 77))
    SELECT id, label, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r WHERE rank <= 3""",
)
def _(t):
    out = retrieval.search_multi(_points(t), _query(t), [1, 2, 5, 77], 3, "label")
    return _hits(out, "label", "rank")


@query(
    "retrieve",
    f"WITH {SCORED} SELECT id, label, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 3",
)
def _(t):
    return _hits(retrieval.retrieve(_points(t), _query(t), collection="label"), "label")


@query(
    "build_context",
    f"""WITH {SCORED}, h AS (SELECT id, label, score, row_number() OVER (ORDER BY score DESC, id) AS i FROM s),
    b AS (SELECT i, score, printf('[Source %d: %s (relevance: %.2f)]', i, CASE WHEN label % 2 = 0 THEN 'file' || label ELSE 'Unknown' END, score)
      || chr(10) || 'point ' || id AS block FROM h WHERE i <= 3)
    SELECT string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context, CAST(count(*) AS INT) AS sources,
      round(max(score), 6) AS max_confidence FROM b""",
)
def _(t):
    hits = retrieval.retrieve(_points(t), _query(t), collection="label").withColumns(
        {
            "text": F.concat(F.lit("point "), "id"),
            "filename": F.when(F.col("label") % 2 == 0, F.concat(F.lit("file"), "label")).otherwise(""),
            "source": F.lit(None).cast("string"),
        }
    )
    out = retrieval.build_context(hits)
    return out.withColumn("max_confidence", F.round("max_confidence", 6))


POISON = rx("text", *retrieval.POISON)


@query(
    "rag_filter",
    f"""WITH {DOCS}, d AS (SELECT source AS request, doc_id % 100 / 100.0::DOUBLE AS score, text,
      CASE doc_id % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'LOW' END AS trust FROM docs),
    k AS (SELECT *, score >= 0.4 AND NOT {POISON} AS ok FROM d)
    SELECT request, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS filtered,
      arg_min(trust, CASE trust WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END) FILTER (ok) AS highest_trust,
      round(coalesce(avg(score) FILTER (ok), 0), 6) AS mean_relevance FROM k GROUP BY 1""",
)
def _(t):
    k = F.col("doc_id") % 5
    trust = F.when(k == 1, "MEDIUM").when(k == 2, "HIGH").when(k == 3, "CRITICAL").otherwise("LOW")
    docs = _docs(t).select(
        F.col("source").alias("request"), (F.col("doc_id") % 100 / 100).alias("relevance_score"),
        F.col("text").alias("content"), trust.alias("trust_level"),
    )
    out = retrieval.rag_filter(docs, keys=["request"])
    return out.withColumn("mean_relevance", F.round("mean_relevance", 6))


@query("collection_stats", "SELECT label, count(*) AS points FROM embeddings GROUP BY 1")
def _(t):
    return retrieval.collection_stats(t.embeddings, "label")


NAMES = ("alerts", "incidents", "knowledge", "logs")
NAMED = "n AS (SELECT vec_id AS id, CASE label % 4 WHEN 0 THEN 'alerts' WHEN 1 THEN 'incidents' WHEN 2 THEN 'knowledge' ELSE 'logs' END AS collection FROM embeddings)"


def _named(t: Tables):
    names = F.array(*[F.lit(n) for n in NAMES])
    return t.embeddings.select(F.col("vec_id").alias("id"), F.get(names, F.col("label") % 4).alias("collection"))


@query("assistant_scope", f"WITH {NAMED} SELECT id, collection FROM n WHERE collection IN ('incidents', 'logs', 'knowledge')")
def _(t):
    return retrieval.assistant_scope(_named(t), "audit")


@query(
    "scope_requests",
    """WITH r AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'documentation' WHEN 2 THEN 'incident' ELSE 'analyst' END AS assistant FROM conversations),
    a AS (SELECT * FROM (VALUES ('analyst', 'alerts'), ('analyst', 'incidents'), ('analyst', 'knowledge'), ('documentation', 'knowledge'),
      ('incident', 'incidents'), ('incident', 'alerts'), ('incident', 'logs')) v(assistant, collection))
    SELECT conv_id, turn, assistant, collection FROM r JOIN a USING (assistant)""",
)
def _(t):
    k = F.col("conv_id") % 4
    name = F.when(k == 0, "analyst").when(k == 1, "documentation").when(k == 2, "incident").otherwise("stranger")
    requests = t.conversations.select("conv_id", "turn", name.alias("assistant"))
    return retrieval.scope_requests(requests, retrieval.assistants_table(t.spark)).select("conv_id", "turn", "assistant", "collection")
