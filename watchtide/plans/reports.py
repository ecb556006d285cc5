"""Sources, sinks, filters and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.functions.scoring import confidence_tier, risk_level, risk_score_v1, risk_score_v2
from watchtide.operators import reports, slices
from watchtide.plans.registry import CASES, SIG, Tables, query
from watchtide.session import shared_dir
from watchtide.sources import adapters, sinks

# "Now" of the event stream: its last event, as a scalar of the whole table.
NOW_SQL = "(SELECT max(ts) FROM events)"


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _now(t: Tables):
    return t.events.agg(F.max(F.col("ts").cast("timestamp"))).scalar()


@query(
    "signals",
    """SELECT CAST(event_id AS VARCHAR) AS id,
      CASE WHEN event_type = 'view' THEN 'external_event' ELSE event_type END AS event_type,
      CASE WHEN user_id % 3 = 0 THEN 'connector' ELSE 'user' || user_id END AS source,
      round(epoch_us(ts) / 1000000.0, 3) AS epoch FROM events""",
)
def _(t):
    raw = t.events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"),
        F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("user"), "user_id")).alias("host"),
    )
    fields = {"id": "event_id", "timestamp": "ts", "event_type": "kind", "source": "host"}
    return adapters.signals(raw, fields, F.lit(0.0)).select("id", "event_type", "source", r("epoch", 3))


@query(
    "normalize_epoch",
    """SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN 1700000000.0 + event_id
      WHEN 1 THEN (1700000000000 + event_id) / 1000.0 ELSE 42.0 END, 3)::DOUBLE AS from_number,
      round(CASE event_id % 4 WHEN 0 THEN epoch_us(ts) / 1000000.0 WHEN 1 THEN floor(epoch(ts)) ELSE 42.0 END, 3)::DOUBLE
      AS from_text FROM events""",
)
def _(t):
    k = F.col("event_id") % 4
    stamp = F.col("ts").cast("string")
    df = t.events.select(
        "event_id",
        F.when(k == 0, 1_700_000_000 + F.col("event_id")).when(k == 1, 1_700_000_000_000 + F.col("event_id"))
        .cast("double").alias("number"),
        F.when(k == 0, stamp)
        .when(k == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(k == 2, "not a time").alias("text"),
    )
    now = F.lit(42.0)
    return df.select(
        "event_id",
        F.round(adapters.normalize_epoch(df, "number", now), 3).alias("from_number"),
        F.round(adapters.normalize_epoch(df, "text", now), 3).alias("from_text"),
    )


@query(
    "incremental_read",
    """SELECT event_id, user_id, (SELECT max(event_id) FROM (SELECT event_id FROM events WHERE event_id > 500
       ORDER BY event_id LIMIT 200)) AS mark FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200""",
)
def _(t):
    batch = adapters.incremental_read(t.events.select("event_id", "user_id"), "event_id", 500, limit=200)
    return batch.withColumn("mark", adapters.high_water_mark(batch, "event_id", 500).scalar())


@query(
    "replay_rebase",
    """SELECT event_id, epoch_us(ts) - (SELECT arg_min(epoch_us(ts), event_id) FROM events) + 1000000000 AS t FROM events""",
)
def _(t):
    rows = t.events.select("event_id", adapters.micros("ts").alias("t"))
    return adapters.replay_rebase(rows, "t", "event_id", 1_000_000_000)


LOGS = {
    "error": "authentication_logs", "click": "firewall_logs", "view": "vpn_logs",
    "purchase": "network_events", "signup": "application_logs",
}


def _logs(t: Tables):
    ev = t.events.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("org"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 3 == 0, "failed").otherwise("ok").alias("status"),
        (F.col("value") * 20_000).alias("amount"), F.lit("log").alias("event_type"),
        F.when(F.col("user_id") % 10 == 0, "admin").otherwise(F.concat(F.lit("u"), "user_id")).alias("user_name"),
        F.when(F.col("value") > 200, "CRITICAL").otherwise("LOW").alias("severity_level"),
        F.col("event_type").alias("kind"),
    )
    return adapters.union_log_tables(
        {name: ev.filter(F.col("kind") == kind).drop("kind") for kind, name in LOGS.items()}
    )


@query(
    "union_log_tables",
    """SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'authentication_logs' WHEN 'click' THEN 'firewall_logs'
      WHEN 'view' THEN 'vpn_logs' WHEN 'purchase' THEN 'network_events' ELSE 'application_logs' END AS table_name FROM events""",
)
def _(t):
    return _logs(t).select("id", "table_name")


@query(
    "log_table_indicators",
    """WITH e AS (SELECT user_id % 4 AS org, event_type AS k, event_id % 3 = 0 AS failed, value, user_id FROM events)
    SELECT org,
      CAST(sum(CASE WHEN k IN ('error', 'view') AND failed THEN 1 ELSE 0 END) AS BIGINT) AS failed_logins,
      CAST(sum(CASE WHEN k = 'purchase' AND value * 20000 > 1000000 THEN 1 ELSE 0 END) AS BIGINT) AS large_transfers,
      CAST(sum(CASE WHEN k = 'signup' AND (value > 200 OR user_id % 10 = 0) THEN 1 ELSE 0 END) AS BIGINT) AS privileged_actions
    FROM e GROUP BY 1""",
)
def _(t):
    from watchtide.operators import detect

    flags = detect.log_table_flags()
    logs = _logs(t).select("org", *[c.alias(n) for n, c in flags.items()])
    names = ("failed_logins", "large_transfers", "privileged_actions")
    return logs.groupBy("org").agg(*[F.sum(n).alias(n) for n in names])


TABLE_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


@query(
    "discover_schema",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS row_count, CAST({i} AS INT) AS position, '{c}' AS column_name"""
        for t, cols in TABLE_COLUMNS.items()
        for i, c in enumerate(cols.split())
    ),
)
def _(t):
    return adapters.discover_schema({n: getattr(t, n) for n in TABLE_COLUMNS}).drop("column_type")


@query(
    "read_json_events",
    """SELECT event_type AS event, CAST(user_id AS VARCHAR) AS order_id, count(*) AS n, min(epoch_us(ts) // 1000) AS first_ms,
      max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1, 2""",
)
def _(t):
    # The events as sample files, each one JSON array of an hour's events, read back.
    path = shared_dir(t.spark, "samples")
    row = F.struct(
        F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("order_id"),
        (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("timestamp"), F.lit("web").alias("source"),
    )
    hours = t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.to_json(F.collect_list(row)).alias("value"))
    hours.select("value").repartition(24, "value").write.option("maxRecordsPerFile", 1).text(path)
    ms = F.round(F.col("timestamp") * 1000).cast("long")
    back = adapters.read_json_events(t.spark, path)
    return back.groupBy("event", "order_id").agg(F.count(F.lit(1)).alias("n"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


@query(
    "documents_not_blank",
    "SELECT doc_id, lang, n_chars FROM documents WHERE regexp_matches(text, '\\S')",
)
def _(t):
    return adapters.drop_blank(t.documents, "text").select("doc_id", "lang", "n_chars")


@query(
    "export_csv",
    f"""WITH {CASES}, top AS (SELECT * FROM cases ORDER BY cases.id DESC LIMIT 500)
    SELECT CAST(id AS VARCHAR) AS "ID", severity AS "Severity", status AS "Status",
      strftime(created_at, '%Y-%m-%dT%H:%M:%S.000Z') AS "Detection Time" FROM top""",
)
def _(t):
    rows = t.cases().withColumn("detection_time", F.col("created_sec"))
    out = sinks.export_rows(rows, "incidents", limit=500)
    return out.select(F.col("ID").cast("string").alias("ID"), "Severity", "Status", "Detection Time")


@query(
    "export_json",
    f"""WITH {CASES} SELECT id, '{{"id":' || id || ',"severity":"' || severity || '","status":"' || status || '"}}' AS json
    FROM cases ORDER BY id DESC LIMIT 500""",
)
def _(t):
    return sinks.json_rows(t.cases().select("id", "severity", "status"), limit=500)


@query(
    "report_summary",
    """SELECT (SELECT count(*) FROM events) AS total_events, (SELECT count(*) FROM customer) AS total_anomalies,
       (SELECT count(*) FROM orders) AS total_incidents""",
)
def _(t):
    return sinks.report_summary(t.events, t.customer, t.orders)


@query(
    "append_events",
    f"""WITH {SIG} SELECT id, org, substr(repeat(event_type, 20), 1, 100) AS event_type,
      substr(repeat(source, 80), 1, 255) AS source, strftime(ts, '%Y-%m-%d') AS event_date FROM sig""",
)
def _(t):
    long = t.sig().withColumns({"event_type": F.repeat("event_type", F.lit(20)), "source": F.repeat("source", F.lit(80))})
    out = sinks.storable_events(long, {"event_type": 100, "source": 255})
    return out.select("id", "org", "event_type", "source", F.col("event_date").cast("string").alias("event_date"))


@query(
    "upsert_points",
    """WITH a AS (SELECT vec_id AS id, label, vec_id AS seq, 0 AS n FROM embeddings WHERE vec_id % 3 <> 0),
    b AS (SELECT vec_id AS id, label + 100 AS label, vec_id + k AS seq, 1 AS n FROM embeddings, (VALUES (0), (1)) v(k)
          WHERE vec_id % 2 = 0)
    SELECT id, arg_max(label, (n, seq)) AS label, arg_max(seq, (n, seq)) AS seq FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""",
)
def _(t):
    base = t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("vec_id").alias("seq"))
    old = base.filter("id % 3 <> 0")
    first = base.filter("id % 2 = 0").withColumn("label", F.col("label") + 100)
    batch = first.unionByName(first.withColumn("seq", F.col("seq") + 1))
    return sinks.upsert_points(old, batch)


@query("delete_by_payload", "SELECT vec_id, label FROM embeddings WHERE label <> 3 OR label IS NULL")
def _(t):
    return sinks.delete_by_payload(t.embeddings.select("vec_id", "label"), "label", 3)


@query(
    "prune",
    f"SELECT event_id FROM events WHERE ts >= {NOW_SQL} - INTERVAL 5 DAY",
)
def _(t):
    return sinks.prune(t.events.select("event_id", "ts"), "ts", _now(t), 5 * 86_400).select("event_id")


@query("tenant_filter", f"WITH {SIG} SELECT id, org FROM sig WHERE org = 2")
def _(t):
    return reports.tenant_filter(t.sig(), 2).select("id", "org")


@query("tenant_filter_super", f"WITH {SIG} SELECT id, org FROM sig")
def _(t):
    return reports.tenant_filter(t.sig(), 2, "super_admin").select("id", "org")


@query(
    "tenant_or_global",
    f"WITH {SIG}, g AS (SELECT id, CASE WHEN id % 5 <> 0 THEN org END AS org FROM sig) SELECT id, org FROM g WHERE org = 1 OR org IS NULL",
)
def _(t):
    some = t.sig().select("id", F.when(F.col("id") % 5 != 0, F.col("org")).alias("org"))
    return reports.tenant_or_global(some, 1)


@query("recent", f"SELECT event_id FROM events WHERE ts >= {NOW_SQL} - INTERVAL 2 DAY")
def _(t):
    return reports.recent(t.events.select("event_id", "ts"), _now(t), 2 * 86_400).select("event_id")


@query("events_per_minute", f"SELECT count(*) AS events FROM events WHERE ts >= {NOW_SQL} - INTERVAL 6 HOUR")
def _(t):
    return reports.events_in_last(t.dated(), _now(t), 6 * 3600)


@query(
    "source_distribution",
    f"WITH {SIG} SELECT source, count(*) AS n FROM sig WHERE ts >= {NOW_SQL} - INTERVAL 3 DAY GROUP BY 1",
)
def _(t):
    return reports.top_counts(t.dated(), "source", _now(t), 3 * 86_400)


@query(
    "source_distribution_top",
    f"""WITH {SIG} SELECT source, count(*) AS n FROM sig WHERE ts >= {NOW_SQL} - INTERVAL 3 DAY GROUP BY 1
    ORDER BY n DESC, source LIMIT 5""",
)
def _(t):
    return reports.top_counts(t.dated(), "source", _now(t), 3 * 86_400, 5)


@query(
    "top_event_type",
    f"""WITH {SIG} SELECT event_type, count(*) AS n FROM sig WHERE ts >= {NOW_SQL} - INTERVAL 1 DAY GROUP BY 1
    ORDER BY n DESC, event_type LIMIT 1""",
)
def _(t):
    return reports.top_counts(t.dated(), "event_type", _now(t), 86_400, 1)


@query(
    "status_banners",
    """SELECT 1 AS case_, 'BREACH DETECTED' AS banner UNION ALL SELECT 2, CASE WHEN max(o_orderkey) % 2 = 1
      THEN 'AGENT MITIGATING' ELSE 'Steady State' END FROM orders UNION ALL SELECT 3, CASE WHEN max(o_orderkey) % 2 = 0
      THEN 'AGENT MITIGATING' ELSE 'Steady State' END FROM orders""",
)
def _(t):
    # Just after the latest anomaly, long after it, and long after one with the other status.
    def at(case, now, odd):
        status = F.when(F.col("o_orderkey") % 2 == odd, "Pending Mitigation").otherwise("x")
        rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(100.0).alias("timestamp"), status.alias("status"))
        return reports.status_banner(rows, F.lit(now)).select(F.lit(case).alias("case_"), "banner")

    return at(1, 114.9, 1).union(at(2, 115.0, 1)).union(at(3, 900.0, 0))


@query(
    "status_banner",
    """SELECT CASE WHEN 1000000 - arg_max(created, o_orderkey) < 15 THEN 'BREACH DETECTED'
       WHEN arg_max(status, o_orderkey) = 'Pending Mitigation' THEN 'AGENT MITIGATING' ELSE 'Steady State' END AS banner
    FROM (SELECT o_orderkey, 0 AS created, CASE WHEN o_orderkey % 2 = 1 THEN 'Pending Mitigation' ELSE 'x' END AS status FROM orders)""",
)
def _(t):
    status = F.when(F.col("o_orderkey") % 2 == 1, "Pending Mitigation").otherwise("x")
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("timestamp"), status.alias("status"))
    return reports.status_banner(rows, F.lit(1_000_000))


@query(
    "incident_stats",
    f"""WITH {CASES} SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open_count,
      count(*) FILTER (severity = 'CRITICAL') AS critical_count FROM cases""",
)
def _(t):
    return reports.incident_stats(t.cases(), "open")


@query(
    "threat_statistics",
    f"""WITH {CASES} SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical,
      count(*) FILTER (status = 'closed') AS mitigated, count(*) FILTER (status <> 'closed') AS pending FROM cases""",
)
def _(t):
    return reports.threat_statistics(t.cases(), "closed")


@query(
    "severity_distribution",
    f"""WITH {CASES}, c AS (SELECT coalesce(CASE WHEN id % 3 <> 0 AND severity <> 'LOW' THEN severity END, 'MEDIUM') AS severity FROM cases)
    SELECT d.severity, count(c.severity) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) d(severity)
    LEFT JOIN c ON c.severity = d.severity GROUP BY 1""",
)
def _(t):
    level = F.when((F.col("id") % 3 != 0) & (F.col("severity") != "LOW"), F.col("severity"))
    return reports.severity_distribution(t.cases().select(level.alias("severity")))


@query(
    "method_distribution",
    f"""WITH {CASES}, c AS (SELECT CASE id % 3 WHEN 0 THEN 'HYBRID' ELSE 'ZSCORE' END AS detection_method FROM cases)
    SELECT d.m AS detection_method, count(c.detection_method) AS n FROM (VALUES ('HYBRID'), ('ZSCORE+EWMA'), ('ZSCORE')) d(m)
    LEFT JOIN c ON c.detection_method = d.m GROUP BY 1""",
)
def _(t):
    k = F.col("id") % 3
    method = F.when(k == 0, "HYBRID").when(k == 1, "ZSCORE")
    return reports.method_distribution(t.cases().select(method.alias("detection_method")))


@query(
    "case_status_counts",
    f"""WITH {CASES} SELECT count(*) FILTER (status IN ('open', 'assigned')) AS open_cases,
      count(*) FILTER (status = 'investigating') AS investigating_cases,
      count(*) FILTER (status IN ('resolved', 'closed')) AS closed_cases FROM cases""",
)
def _(t):
    return reports.case_status_counts(t.cases())


# "Now" of the cases: noon of the last order day.
SLA = f"""{CASES}, now AS (SELECT max(created_sec) + 43200 AS now FROM cases),
sla AS (SELECT *, created_sec + CASE severity WHEN 'CRITICAL' THEN 60 WHEN 'HIGH' THEN 240 WHEN 'MEDIUM' THEN 1440
          ELSE 10080 END * 60 AS deadline FROM cases)"""


def _case_now(t: Tables):
    return t.cases().agg(F.max("created_sec") + 43_200).scalar()


@query(
    "sla_deadline",
    f"""WITH {SLA} SELECT id, deadline AS sla_deadline, now > deadline AND status <> 'closed' AS sla_breached FROM sla, now""",
)
def _(t):
    return reports.with_sla(t.cases(), _case_now(t)).select("id", "sla_deadline", "sla_breached")


@query(
    "case_list",
    f"""WITH {SLA} SELECT id, severity, status FROM sla, now
    WHERE status = 'open' AND severity = 'HIGH' AND now > deadline""",
)
def _(t):
    out = reports.case_list(t.cases(), _case_now(t), "open", "HIGH", breached=True)
    return out.select("id", "severity", "status")


@query(
    "sla_status",
    f"""WITH {SLA} SELECT count(*) AS total_active, count(*) FILTER (now > deadline) AS breached,
      count(*) FILTER (now > deadline - 3600 AND now <= deadline) AS approaching FROM sla, now WHERE status <> 'closed'""",
)
def _(t):
    return reports.sla_status(t.cases(), _case_now(t))


@query(
    "sla_by_severity",
    f"""WITH {SLA} SELECT d.severity, count(s.id) AS total, count(s.id) FILTER (now.now > s.deadline) AS breached
    FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) d(severity) CROSS JOIN now
    LEFT JOIN sla s ON s.severity = d.severity AND s.status <> 'closed' GROUP BY 1""",
)
def _(t):
    return reports.sla_by_severity(t.cases(), _case_now(t))


def _metrics(t: Tables):
    return t.events.select(
        F.col("event_type").alias("type"), "value", "ts",
        (F.col("event_id") % 17 != 0).alias("success"), (F.col("event_id") % 4).alias("sources_found"),
    )


@query(
    "latency_dashboard",
    f"""SELECT event_type AS type, round(avg(value), 6) AS avg_latency, quantile_disc(value, 0.95) AS p95_latency,
      count(*) AS requests, round(avg(CASE WHEN event_id % 17 = 0 THEN 1.0 ELSE 0 END), 6) AS error_rate
    FROM events WHERE ts > {NOW_SQL} - INTERVAL 240 HOUR GROUP BY 1""",
)
def _(t):
    out = reports.latency_dashboard(_metrics(t), _now(t), 240)
    return out.select("type", r("avg_latency"), "p95_latency", "requests", r("error_rate"))


@query(
    "nearest_rank",
    """SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS percentile, count(*) AS n FROM lineitem GROUP BY 1""",
)
def _(t):
    return reports.nearest_rank(t.lineitem, "l_extendedprice", 0.95, ["l_returnflag"])


@query(
    "rag_success_rate",
    """SELECT round(avg(CASE WHEN event_id % 4 > 0 THEN 1.0 ELSE 0 END), 6) AS success_rate,
       round(avg(event_id % 4), 6) AS avg_sources FROM events""",
)
def _(t):
    return reports.rag_success_rate(_metrics(t)).select(r("success_rate"), r("avg_sources"))


def _usage(t: Tables):
    c = t.conversations
    return c.select(
        (F.col("conv_id") % 3).alias("tenant"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 40).cast("int")).alias("day"),
        F.when(F.col("turn") % 2 == 0, "small").otherwise("large").alias("model"),
        F.length("text").cast("long").alias("tokens_in"), (F.length("text") % 100).cast("long").alias("tokens_out"),
    )


USAGE = """us AS (SELECT conv_id % 3 AS tenant, DATE '2024-01-01' + CAST(conv_id % 40 AS INT) AS day,
  CASE WHEN turn % 2 = 0 THEN 'small' ELSE 'large' END AS model, length(text) AS ti, length(text) % 100 AS tou FROM conversations),
roll AS (SELECT tenant, day, model, CAST(sum(ti) AS BIGINT) AS tokens_in, CAST(sum(tou) AS BIGINT) AS tokens_out,
  count(*) AS requests, CAST(sum(ti + tou) AS BIGINT) AS total_tokens,
  sum(ti) / 1000.0::DOUBLE * 0.000125::DOUBLE + sum(tou) / 1000.0::DOUBLE * 0.000375::DOUBLE AS cost_usd FROM us GROUP BY 1, 2, 3)"""


@query(
    "cost_rollup",
    f"""WITH {USAGE} SELECT tenant, strftime(day, '%Y-%m-%d') AS day, model, tokens_in, tokens_out, requests, total_tokens,
      round(cost_usd, 9) AS cost_usd FROM roll""",
)
def _(t):
    out = reports.cost_rollup(_usage(t))
    return out.withColumns({"day": F.col("day").cast("string"), "cost_usd": F.round("cost_usd", 9)})


@query(
    "cost_report",
    f"""WITH {USAGE} SELECT strftime(day, '%Y-%m-%d') AS day, model, requests FROM roll
    WHERE tenant = 1 AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def _(t):
    roll = reports.cost_rollup(_usage(t))
    out = reports.cost_report(roll, F.lit("2024-01-05").cast("date"), F.lit("2024-01-20").cast("date"), 1)
    return out.select(F.col("day").cast("string").alias("day"), "model", "requests")


@query(
    "cost_by_model",
    f"""WITH {USAGE} SELECT model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
      CAST(sum(requests) AS BIGINT) AS requests, round(sum(cost_usd), 8) AS cost_usd FROM roll GROUP BY 1""",
)
def _(t):
    return reports.cost_by_model(reports.cost_rollup(_usage(t))).withColumn("cost_usd", F.round("cost_usd", 8))


@query(
    "cost_summary",
    f"""WITH {USAGE} SELECT
      CAST(coalesce(sum(tokens_in) FILTER (day = DATE '2024-02-05'), 0) AS BIGINT) AS today_tokens_in,
      CAST(coalesce(sum(tokens_in) FILTER (day >= DATE '2024-01-06'), 0) AS BIGINT) AS month_tokens_in,
      CAST(sum(tokens_in) AS BIGINT) AS total_tokens_in,
      round(coalesce(sum(cost_usd) FILTER (day >= DATE '2024-01-06'), 0), 8) AS month_cost_usd,
      CAST(sum(requests) AS BIGINT) AS total_requests FROM roll""",
)
def _(t):
    out = reports.cost_summary(reports.cost_rollup(_usage(t)), F.lit("2024-02-05").cast("date"))
    return out.select(
        "today_tokens_in", "month_tokens_in", "total_tokens_in",
        F.round("month_cost_usd", 8).alias("month_cost_usd"), "total_requests",
    )


@query(
    "reliability_metrics",
    """WITH l AS (SELECT user_id % 7 AS tenant, event_id, event_type, value FROM events
                  WHERE user_id % 7 < 5 AND event_id >= 100),
    a AS (SELECT tenant, count(*) AS n, avg(1 - value / 1000) AS truth, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS h,
                 avg(CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 0 END) AS f, avg(value) AS lat, sum(event_id % 100 + event_id % 10) AS tok
          FROM l GROUP BY 1)
    SELECT t.tenant, coalesce(n, 0) AS total_requests, round(coalesce(truth, 1), 6) AS mean_truth_score,
      round(coalesce(h, 0), 6)::DOUBLE AS hallucination_rate, round(coalesce(f, 0), 6)::DOUBLE AS fallback_rate,
      round(coalesce(lat, 0), 6) AS avg_latency_ms, CAST(coalesce(tok, 0) AS BIGINT) AS total_tokens
    FROM (SELECT DISTINCT user_id % 7 AS tenant FROM events) t LEFT JOIN a ON a.tenant = t.tenant""",
)
def _(t):
    e = t.events
    logs = e.filter(F.col("user_id") % 7 < 5).select(
        (F.col("user_id") % 7).alias("tenant"), F.col("event_id").alias("request_timestamp"),
        (1 - F.col("value") / 1000).alias("truth_score"),
        F.when(F.col("event_type") == "error", "HALLUCINATION_DETECTED").otherwise("OK").alias("outcome"),
        (F.col("event_id") % 5 == 0).cast("int").alias("safe_fallback_used"), F.col("value").alias("latency_ms"),
        (F.col("event_id") % 100).alias("tokens_input"), (F.col("event_id") % 10).alias("tokens_output"),
    )
    tenants = e.select((F.col("user_id") % 7).alias("tenant")).distinct()
    out = reports.reliability_metrics(logs, F.lit(100), tenants=tenants)
    return out.select(
        "tenant", "total_requests", r("mean_truth_score"), r("hallucination_rate"), r("fallback_rate"),
        r("avg_latency_ms"), "total_tokens",
    )


EVALS = ("citation_quality", "hallucination_score", "consistency_score", "accuracy_score", "retrieval_score", "overall_score")


def _evaluations(t: Tables):
    e = F.col("event_id")
    drift = F.col("us") / 1e15 - 1.704
    return t.events.select(
        (F.col("user_id") % 4).alias("tenant"), e.alias("id"), adapters.micros("ts").alias("us"), e
    ).select(
        "tenant", "id", "us", ((e % 100) / 100.0).alias("citation_quality"), ((e * 7 % 100) / 100.0 + drift * 100).alias("hallucination_score"),
        ((e * 3 % 100) / 100.0).alias("consistency_score"), ((e * 11 % 100) / 100.0).alias("accuracy_score"),
        ((e * 13 % 70) / 100.0).alias("retrieval_score"), ((e * 17 % 100) / 100.0 + drift * 100).alias("overall_score"),
    )


@query(
    "evaluation_report",
    """WITH e AS (SELECT user_id % 4 AS tenant, event_id AS e, epoch_us(ts) AS us, epoch_us(ts) / 1e15 - 1.704 AS drift FROM events),
    m AS (SELECT tenant, e, us, (e % 100) / 100.0::DOUBLE AS c, (e * 7 % 100) / 100.0::DOUBLE + drift * 100 AS h,
            (e * 13 % 70) / 100.0::DOUBLE AS rt, (e * 17 % 100) / 100.0::DOUBLE + drift * 100 AS o,
            row_number() OVER (PARTITION BY user_t ORDER BY us, e) AS rn, count(*) OVER (PARTITION BY user_t) AS n
          FROM (SELECT *, tenant AS user_t FROM e WHERE us BETWEEN 1704153600000000 AND 1706400000000000)),
    g AS (SELECT tenant, count(*) AS total_interactions, avg(c) AS c, avg(h) AS h, avg(rt) AS rt, avg(o) AS o,
            avg(c) FILTER (rn > n // 2) - avg(c) FILTER (rn <= n // 2) AS dc,
            avg(h) FILTER (rn > n // 2) - avg(h) FILTER (rn <= n // 2) AS dh,
            avg(o) FILTER (rn > n // 2) - avg(o) FILTER (rn <= n // 2) AS dov FROM m GROUP BY 1)
    SELECT tenant, total_interactions, floor(c * 100 + 0.5) / 100 AS citation_quality,
      floor(h * 100 + 0.5) / 100 AS hallucination_score, floor(o * 100 + 0.5) / 100 AS overall_score,
      CASE WHEN abs(dc) < 0.05 THEN 'stable' WHEN dc > 0 THEN 'improving' ELSE 'declining' END AS citation_quality_trend,
      CASE WHEN abs(dh) < 0.05 THEN 'stable' WHEN dh < 0 THEN 'improving' ELSE 'declining' END AS hallucination_score_trend,
      CASE WHEN abs(dov) < 0.05 THEN 'stable' WHEN dov > 0 THEN 'improving' ELSE 'declining' END AS overall_score_trend,
      c < 0.5 AS cites_little, h > 0.3 AS makes_things_up, rt < 0.4 AS retrieves_little
    FROM g""",
)
def _(t):
    out = reports.evaluation_report(_evaluations(t), 1704153600000000, 1706400000000000)
    says = lambda text: F.contains("recommendations", F.lit(text))
    return out.select(
        "tenant", "total_interactions", "citation_quality", "hallucination_score", "overall_score",
        "citation_quality_trend", "hallucination_score_trend", "overall_score_trend",
        says("citation practices").alias("cites_little"), says("hallucination rate").alias("makes_things_up"),
        says("Retrieval effectiveness").alias("retrieves_little"),
    )


@query(
    "numbered",
    f"""WITH {SIG} SELECT id, org, row_number() OVER (PARTITION BY org ORDER BY us, id) AS rn,
      count(*) OVER (PARTITION BY org) AS n FROM sig""",
)
def _(t):
    rows = t.sig().select("id", "org", "us")
    return slices.numbered(rows, ["org"], "us", "id", 86_400_000_000).select("id", "org", "rn", "n")


@query(
    "tenant_usage",
    f"""WITH {SIG} SELECT org, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events_today, CAST(10000 AS BIGINT) AS events_limit,
      least(100, CAST(floor(count(*) / 10000 * 100 + 0.5) AS BIGINT)) AS percentage FROM sig GROUP BY 1, 2""",
)
def _(t):
    return reports.tenant_usage(t.sig()).withColumn("day", F.col("day").cast("string"))


@query(
    "org_user_counts",
    """SELECT n_nationkey, n_name, count(c_custkey) AS users FROM nation
    LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey <> 3 GROUP BY 1, 2""",
)
def _(t):
    users = t.customer.filter("c_nationkey <> 3").withColumnRenamed("c_nationkey", "n_nationkey")
    return reports.org_user_counts(t.nation.select("n_nationkey", "n_name"), users, "n_nationkey", "c_custkey")


@query(
    "guarded_sql",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value > 10 GROUP BY event_type",
)
def _(t):
    t.events.createOrReplaceTempView("watchtide_events")
    return reports.guarded_sql(
        t.spark,
        "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM watchtide_events "
        "WHERE value > 10 GROUP BY event_type",
    )


def _scores(t: Tables):
    e, v = F.col("event_id"), F.col("value")
    return t.events.select(
        "event_id", (v / 20).alias("z"), (e % 30).cast("double").alias("rate"), (e % 10 / 10.0).alias("iforest"),
        (e % 11 / 10.0).alias("hybrid"), (e % 3 == 0).alias("known"), (e % 5 / 2.0).alias("entropy"),
    )


RISK = """s AS (SELECT event_id, value / 20 AS z, event_id % 30 AS rate, event_id % 10 / 10.0::DOUBLE AS iforest,
  event_id % 11 / 10.0::DOUBLE AS hybrid, event_id % 3 = 0 AS known, event_id % 5 / 2.0::DOUBLE AS entropy FROM events)"""


@query(
    "risk_score_v2",
    f"""WITH {RISK}, k AS (SELECT event_id, CAST(least(floor(least(z * 8, 30.0::DOUBLE) + least(rate * 1.5::DOUBLE, 20.0::DOUBLE)
      + least(iforest * 25, 20.0::DOUBLE) + least(hybrid * 15, 15.0::DOUBLE) + CASE WHEN known THEN 10 ELSE 0 END
      + CASE WHEN entropy > 1.5 THEN 5 ELSE 0 END + CASE WHEN rate > 20 THEN 10 ELSE 0 END + 0.5::DOUBLE), 100) AS BIGINT) AS risk FROM s)
    SELECT event_id, risk, CASE WHEN risk >= 80 THEN 'CRITICAL' WHEN risk >= 60 THEN 'HIGH' WHEN risk >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM k""",
)
def _(t):
    c = F.col
    risk = risk_score_v2(c("z"), c("rate"), c("iforest"), c("hybrid"), c("known"), c("entropy"))
    return _scores(t).select("event_id", risk.alias("risk")).withColumn("level", risk_level(c("risk")))


@query(
    "risk_score_v1",
    f"""WITH {RISK} SELECT event_id, CAST(least(round_even(least(z * 10, 40.0::DOUBLE) + least(rate * 2.0::DOUBLE, 30.0::DOUBLE)
      + CASE WHEN known THEN 15 ELSE 0 END + CASE WHEN rate > 20 THEN 15 ELSE 0 END, 0), 100) AS BIGINT) AS risk FROM s""",
)
def _(t):
    c = F.col
    return _scores(t).select("event_id", risk_score_v1(c("z"), c("rate"), c("known")).alias("risk"))


@query(
    "confidence_tier",
    """SELECT event_id, CASE WHEN event_id % 100 >= 80 THEN 'high' WHEN event_id % 100 >= 50 THEN 'moderate' ELSE 'low' END AS tier FROM events""",
)
def _(t):
    return t.events.select("event_id", confidence_tier(F.col("event_id") % 100 / 100).alias("tier"))
