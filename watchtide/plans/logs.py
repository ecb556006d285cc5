"""Log lines written from the event stream and normalised back."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.operators import normalize
from watchtide.plans.registry import Tables, query
from watchtide.sources.adapters import spread

YEAR = 2024
NOW_SEC = 42

# Eight kinds of line by event_id, the same text in Spark and SQL.
LINES = r"""lines AS (
  SELECT event_id, event_id % 8 AS kind, event_type AS t, user_id AS u,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%b %d %H:%M:%S') AS bsd,
         CAST(floor(epoch(ts)) AS BIGINT) AS sec, epoch_us(ts) // 1000 AS ms
  FROM events)"""

_LINE = """concat(CASE event_id % 8
  WHEN 0 THEN '{"event_type":"' || t || '","msg":"value ' || u || '","host":"h' || u || '","level":"warn","time":"' || iso || '"}'
  WHEN 1 THEN '{"Records":[{"eventName":"api ' || t || '","sourceIPAddress":"10.0.0.' || (u % 250) || '","severity":' || (event_id % 12)
       || ',"timestamp":' || ms || '},{"action":"","type":"scan","priority":"err","severity":0}]}'
  WHEN 2 THEN 'CEF:0|vend|prod|1|' || u || '|login ' || t || '|' || (event_id % 13) || '|src=10.1.1.' || (u % 250)
       || ' msg=two words src=h' || u || ' end=' || iso
  WHEN 3 THEN '<' || (event_id % 190) || '>1 ' || iso || ' host' || u || ' app-' || t || ' p1 m1 - sshd accepted ' || u
  WHEN 4 THEN '<' || (event_id % 190) || '>' || bsd || ' box' || u || ' cron[' || u || ']: run ' || t
  WHEN 5 THEN '  event_type=' || t || ' src=1.2.3.' || (u % 250) || ' severity=FATAL message="file ' || u || ' open" ts=' || iso || ' src=10.9.9.9'
  WHEN 6 THEN '{"a": 1, action=' || t || ' host=k' || u
  ELSE CASE WHEN event_id % 16 = 7 THEN 'CEF:0|bad line ' || u ELSE 'free text ' || t || ' ' || u END END, '')"""

CATEGORY = """CASE
  WHEN regexp_matches(ct, 'login|auth|password|credential|ssh|logon|logoff|kerberos|ldap') THEN 'auth'
  WHEN regexp_matches(ct, 'firewall|tcp|udp|packet|flow|nat|dns|http|tls|port|scan|ddos|syn') THEN 'network'
  WHEN regexp_matches(ct, 'process|registry|file|malware|endpoint|host|agent|driver') THEN 'endpoint'
  WHEN regexp_matches(ct, 'app|api|request|response|sql|exception|error|deploy') THEN 'application'
  ELSE 'system' END"""

CEF_SEV = "list_extract(['info','info','info','low','low','medium','medium','high','high','critical','critical'], CAST({} AS INT) + 1)"
SYSLOG_SEV = "list_extract(['critical','critical','critical','high','medium','low','info','info'], CAST(event_id % 190 % 8 AS INT) + 1)"

PARSED = f"""{LINES}, ev AS (
  SELECT event_id, 'json' AS parser, sec, 'h' || u AS source, 'medium' AS severity, t AS event_type, 'value ' || u AS message,
         'event_type,host,level,msg,time' AS keys, NULL AS ct0 FROM lines WHERE kind = 0
  UNION ALL SELECT event_id, 'json', sec, '10.0.0.' || (u % 250),
         CASE WHEN event_id % 12 = 0 THEN 'info' ELSE {CEF_SEV.format("least(event_id % 12, 10)")} END, 'api ' || t,
         substr('{{"eventName":"api ' || t || '","sourceIPAddress":"10.0.0.' || (u % 250) || '","severity":' || (event_id % 12)
                || ',"timestamp":' || ms || '}}', 1, 200), 'eventName,severity,sourceIPAddress,timestamp', NULL FROM lines WHERE kind = 1
  UNION ALL SELECT event_id, 'json', {NOW_SEC}, 'unknown', 'high', 'scan',
         '{{"action":"","type":"scan","priority":"err","severity":0}}', 'action,priority,severity,type', NULL FROM lines WHERE kind = 1
  UNION ALL SELECT event_id, 'cef', sec, 'h' || u, coalesce({CEF_SEV.format("event_id % 13")}, 'info'), u || ': login ' || t,
         '[vend/prod] login ' || t, 'end,msg,name,product,sigId,src,vendor', 'login ' || t || ' vend prod' FROM lines WHERE kind = 2
  UNION ALL SELECT event_id, 'syslog-rfc5424', sec, 'host' || u, {SYSLOG_SEV}, 'app-' || t, '- sshd accepted ' || u,
         'appName,hostname,msg,pri', NULL FROM lines WHERE kind = 3
  UNION ALL SELECT event_id, 'syslog-rfc3164', sec, 'box' || u, {SYSLOG_SEV}, 'cron[' || u || ']', 'run ' || t,
         'hostname,msg,pri,tag', NULL FROM lines WHERE kind = 4
  UNION ALL SELECT event_id, 'key-value', sec, '10.9.9.9', 'critical', t, 'file ' || u || ' open',
         'event_type,message,severity,src,ts', NULL FROM lines WHERE kind = 5
  UNION ALL SELECT event_id, 'key-value', {NOW_SEC}, 'k' || u, 'info', t, '{{"a": 1, action=' || t || ' host=k' || u,
         'action,host', NULL FROM lines WHERE kind = 6
  UNION ALL SELECT event_id, 'raw', {NOW_SEC}, 'unknown', 'info', 'raw_log', 'free text ' || t || ' ' || u, 'raw', NULL
         FROM lines WHERE event_id % 16 = 15)
, full_ev AS (SELECT event_id, parser, CAST(sec AS BIGINT) AS sec, source, severity,
    CASE WHEN parser = 'raw' THEN 'unknown' ELSE {CATEGORY} END AS category, event_type, message, keys
  FROM (SELECT *, lower(coalesce(ct0, event_type || ' ' || message)) AS ct FROM ev))"""


def lines_of(events):
    """The lines in Spark: the same expression over the same derived columns."""
    base = events.select(
        "event_id", F.col("event_type").alias("t"), F.col("user_id").alias("u"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"),
        F.date_format("ts", "MMM dd HH:mm:ss").alias("bsd"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )
    return base.select("event_id", F.expr(_LINE).alias("line"))


def _lines(t: Tables):
    return spread(lines_of(t.events))


def _now():
    return F.timestamp_seconds(F.lit(NOW_SEC))


def _shown(events):
    return events.select(
        "event_id", "parser", F.unix_seconds("ts").alias("sec"), "source", "severity", "category",
        "event_type", "message", F.array_join(F.sort_array(F.map_keys("raw_data")), ",").alias("keys"),
    )


@query("normalize_logs", f"WITH {PARSED} SELECT * FROM full_ev")
def _(t):
    return _shown(normalize.normalize_logs(_lines(t), _now(), F.lit(YEAR), messages=normalize.MESSAGES))


@query("parse_json_logs", f"WITH {PARSED} SELECT * FROM full_ev WHERE parser = 'json'")
def _(t):
    return _shown(normalize.parse_json_logs(_lines(t), _now(), messages=normalize.MESSAGES))


@query("parse_cef_logs", f"WITH {PARSED} SELECT * FROM full_ev WHERE parser = 'cef'")
def _(t):
    return _shown(normalize.parse_cef_logs(_lines(t), _now()))


@query("parse_syslog_5424", f"WITH {PARSED} SELECT * FROM full_ev WHERE parser = 'syslog-rfc5424'")
def _(t):
    out = normalize.parse_syslog(_lines(t), _now(), F.lit(YEAR))
    return _shown(out.filter("parser = 'syslog-rfc5424'"))


@query("parse_syslog_3164", f"WITH {PARSED} SELECT * FROM full_ev WHERE parser = 'syslog-rfc3164'")
def _(t):
    out = normalize.parse_syslog(_lines(t), _now(), F.lit(YEAR))
    return _shown(out.filter("parser = 'syslog-rfc3164'"))


@query("parse_kv_logs", f"WITH {PARSED} SELECT * FROM full_ev WHERE parser = 'key-value'")
def _(t):
    # Lines other formats claim are left out; JSON that does not parse is read as pairs.
    line = F.col("line")
    pairs = (normalize.detect_format(line) == "kv") | F.startswith(line, F.lit('{"a"'))
    return _shown(normalize.parse_kv_logs(_lines(t).filter(pairs), _now()))


@query(
    "parse_raw",
    f"""WITH {LINES} SELECT event_id, 'raw' AS parser, 'raw_log' AS event_type, 'unknown' AS category,
      'free text ' || t || ' ' || u AS message FROM lines WHERE event_id % 16 = 15""",
)
def _(t):
    out = normalize.parse_raw(_lines(t).filter(F.startswith("line", F.lit("free"))), _now(), messages=normalize.MESSAGES)
    return out.select("event_id", "parser", "event_type", "category", "message")


@query(
    "detect_format",
    f"""WITH {LINES} SELECT event_id, CASE WHEN kind IN (0, 1, 6) THEN 'json' WHEN kind = 2 OR event_id % 16 = 7 THEN 'cef'
      WHEN kind IN (3, 4) THEN 'syslog' ELSE 'kv' END AS format FROM lines""",
)
def _(t):
    return _lines(t).select("event_id", normalize.detect_format(F.col("line")).alias("format"))


@query("formats_detected", f"WITH {PARSED} SELECT parser, count(*) AS n FROM full_ev GROUP BY 1")
def _(t):
    return normalize.formats_detected(normalize.normalize_logs(_lines(t), _now(), F.lit(YEAR)))


@query(
    "map_severity",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium'
      ELSE 'low' END AS word, list_extract(['info','info','info','low','low','medium','medium','high','high','critical','critical'],
      CAST(least(o_orderkey % 15, 10) AS INT) + 1) AS number FROM orders""",
)
def _(t):
    k = F.col("o_orderpriority")
    word = F.when(k == "1-URGENT", "EMERG").when(k == "2-HIGH", "Err").when(k == "3-MEDIUM", "warning").otherwise("notice")
    return t.orders.select(
        "o_orderkey", normalize.severity_of_word(word).alias("word"),
        normalize.severity_of_number((F.col("o_orderkey") % 15).cast("double")).alias("number"),
    )


@query(
    "infer_category",
    f"SELECT doc_id, {CATEGORY} AS category FROM (SELECT doc_id, lower(source || ' ' || text) AS ct FROM documents)",
)
def _(t):
    return spread(t.documents.select("doc_id", "source", "text")).select(
        "doc_id", normalize.infer_category(F.col("source"), F.col("text")).alias("category")
    )


BROKEN = """b AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS event_type,
  CASE WHEN event_id % 7 <> 0 THEN 's' || user_id END AS source FROM events)"""


def _broken(t: Tables):
    e = F.col("event_id")
    return t.events.select(
        "event_id", F.when(e % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(e % 7 != 0, F.concat(F.lit("s"), "user_id")).alias("source"),
        F.col("ts").cast("string").alias("timestamp"),
    )


@query(
    "validate_schema",
    f"""WITH {BROKEN} SELECT event_id, concat_ws('|', CASE WHEN event_type IS NULL THEN 'Missing required field: "event_type"' END,
      CASE WHEN source IS NULL THEN 'Missing required field: "source"' END,
      'Invalid type for field "timestamp": expected number, got string') AS errors FROM b""",
)
def _(t):
    out = normalize.validate_schema(_broken(t))
    return out.select("event_id", F.array_join("errors", "|").alias("errors"))


@query("valid_rows", f"WITH {BROKEN} SELECT event_id, event_type FROM b WHERE event_type IS NOT NULL AND source IS NOT NULL")
def _(t):
    rows = _broken(t).withColumn("timestamp", F.col("event_id").cast("double"))
    return normalize.valid_rows(rows).select("event_id", "event_type")


@query(
    "quarantine",
    f"""WITH {BROKEN} SELECT event_id, CAST(CASE WHEN event_type IS NULL THEN 1 ELSE 0 END + CASE WHEN source IS NULL THEN 1 ELSE 0 END
      AS INT) AS problems FROM b WHERE event_type IS NULL OR source IS NULL""",
)
def _(t):
    rows = _broken(t).withColumn("timestamp", F.col("event_id").cast("double"))
    return normalize.quarantine(rows).select("event_id", F.size("errors").alias("problems"))


@query(
    "reject_invalid_enums",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW'",
)
def _(t):
    enums = {"o_orderstatus": ("F", "O"), "o_orderpriority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")}
    return normalize.reject_invalid_enums(t.orders, enums).select("o_orderkey", "o_orderstatus")
