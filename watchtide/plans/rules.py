"""Rules, playbooks, enrichment, isolation forest and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.functions import indicators
from watchtide.operators import correlate, detect, enrich, folds, iforest, joins, rules, series
from watchtide.plans.detection import B, BINS, MIX, W
from watchtide.plans.registry import CASES, SIG, Tables, query
from watchtide.session import stored
from watchtide.sources.adapters import spread

# Rule windows are stretched: the test stream has a few events per hour.
SCALE = 36


def _rule_sql(rule: correlate.Rule, name: str) -> str:
    span = rule.span(SCALE)
    tests = [f"regexp_matches(event_type, '{s.pattern}', 'i')" for s in rule.stages]
    counts = ", ".join(
        f"sum(CASE WHEN {t} THEN 1 ELSE 0 END) OVER w AS s{i}" for i, t in enumerate(tests)
    )
    hit = " AND ".join(f"s{i} >= {s.at_least}" for i, s in enumerate(rule.stages))
    return f"""{name}_w AS (
      SELECT org, {rule.entity} AS entity_id, us, id, {counts},
             CAST(sum(CASE WHEN {" OR ".join(tests)} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS matched_events,
             count(*) OVER w AS window_events, min(us) OVER w AS first_seen
      FROM sig WINDOW w AS (PARTITION BY org, {rule.entity} ORDER BY us
                            RANGE BETWEEN {span} PRECEDING AND CURRENT ROW)),
    {name}_h AS (SELECT *, {hit} AS hit FROM {name}_w),
    {name}_l AS (SELECT *, lag(hit) OVER v AS was, us - lag(us) OVER v AS gap FROM {name}_h
                 WINDOW v AS (PARTITION BY org, entity_id ORDER BY us, id)),
    {name} AS (SELECT org, '{rule.id}' AS rule_id, '{rule.severity}' AS severity, entity_id,
                      id AS trigger_id, window_events, matched_events, first_seen, us AS last_seen
               FROM {name}_l WHERE hit AND NOT coalesce(was AND gap <= {span}, false))"""


CORR = ", ".join(_rule_sql(rule, f"c{i}") for i, rule in enumerate(correlate.RULES))
CORR_ALL = " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(len(correlate.RULES)))


@query("correlate", f"WITH {SIG}, {CORR} {CORR_ALL}")
def _(t):
    return correlate.correlate(t.sig(), scale=SCALE).select(
        "org", "rule_id", "severity", "entity_id", "trigger_id", "window_events",
        "matched_events", "first_seen", "last_seen",
    )


def _evidence_sql() -> str:
    parts = []
    for i, rule in enumerate(correlate.RULES):
        tests = " OR ".join(
            f"regexp_matches(event_type, '{s.pattern}', 'i')" for s in rule.stages
        )
        parts.append(
            f"""SELECT c.org, c.rule_id, c.entity_id, c.trigger_id, s.id AS event_id
            FROM c{i} c JOIN sig s ON s.org = c.org AND s.{rule.entity} = c.entity_id
             AND s.us BETWEEN c.last_seen - {rule.span(SCALE)} AND c.last_seen AND ({tests})"""
        )
    return " UNION ALL ".join(parts)


@query("correlation_evidence", f"WITH {SIG}, {CORR} {_evidence_sql()}")
def _(t):
    sig = t.sig()
    return correlate.correlation_evidence(sig, correlate.correlate(sig, scale=SCALE), scale=SCALE)


SIGMA = (
    *rules.SIGMA_RULES,
    {
        "id": "t-1",
        "title": "Failed login outside the first source",
        "level": "medium",
        "detection": {
            "selection": {"status": "FAILED", "event_type": ["login_failed", "auth_attempt"]},
            "filter": {"source": "src0"},
            "condition": "selection and not filter",
        },
    },
    {
        "id": "t-2",
        "title": "Export or administration",
        "level": "low",
        "detection": {
            "exports": {"event_type": "data_export"},
            "admin": {"action": "privileged_action", "is_admin": True},
            "condition": "1 of them",
        },
    },
)
SIGMA_ROWS = f"""WITH {SIG}, e AS (
  SELECT id, source, CASE event_type WHEN 'page_view' THEN 'auth_attempt' ELSE event_type END AS event_type,
         CASE WHEN event_type IN ('login_failed', 'page_view') AND id % 3 > 0 THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN event_type = 'admin_add' THEN 'privileged_action' END AS action,
         user_name = 'u1' AS is_admin FROM sig)"""


def _sigma_events(t: Tables):
    kind = F.col("event_type")
    failed = kind.isin("login_failed", "page_view") & (F.col("id") % 3 > 0)
    return t.sig().select(
        "id", "source", F.when(kind == "page_view", "auth_attempt").otherwise(kind).alias("event_type"),
        F.when(failed, "failed").otherwise("ok").alias("status"),
        F.when(kind == "admin_add", "privileged_action").alias("action"),
        (F.col("user_name") == "u1").alias("is_admin"),
    )


@query(
    "sigma_match",
    f"""{SIGMA_ROWS}
    SELECT id, 'sigma-01' AS rule_id, 'high' AS rule_level FROM e WHERE status = 'failed' AND event_type = 'auth_attempt'
    UNION ALL SELECT id, 'sigma-02', 'critical' FROM e WHERE action = 'privileged_action' AND NOT is_admin
    UNION ALL SELECT id, 't-1', 'medium' FROM e WHERE status = 'failed'
      AND event_type IN ('login_failed', 'auth_attempt') AND source <> 'src0'
    UNION ALL SELECT id, 't-2', 'low' FROM e WHERE event_type = 'data_export'
      OR (action = 'privileged_action' AND is_admin)""",
)
def _(t):
    return rules.sigma_match(_sigma_events(t), SIGMA).select("id", "rule_id", "rule_level")


def _book(i, org, name, mode, triggers, actions, active=True):
    return (i, org, name, active, mode, triggers, actions, 10)


PLAYBOOKS = [
    _book(1, 0, "all", "all", [("severity", "eq", "high"), ("z_score", "gte", "3.5")],
          ["notify_email", "block_ip", "reboot"]),
    _book(2, 1, "any", "any", [("severity", "eq", "critical"), ("source", "contains", "SRC1")],
          ["escalate", "delete_data"]),
    _book(3, 2, "regex", "all", [("event_type", "regex", "^LOGIN_(failed|success)$"),
                                 ("hybrid_score", "lte", "0.4")], ["create_incident"]),
    _book(4, 3, "always", "any", [("always", None, None)], ["tag_event", "disable_account"]),
    _book(5, 3, "method", "all", [("detection_method", "eq", "HYBRID"), ("severity", "neq", "low")],
          ["send_report"]),
    _book(6, 0, "no triggers", "all", [], ["escalate"]),
    _book(7, 0, "off", "any", [("always", None, None)], ["escalate"], active=False),
]


def _anomalies(t: Tables):
    """Anomalies played by events worth more than 40."""
    v = F.col("value")
    level = (
        F.when(v > 120, "CRITICAL").when(v > 90, "HIGH").when(v > 60, "MEDIUM").otherwise("LOW")
    )
    return t.sig().filter("value > 40").select(
        "id", "org", "source", "event_type", "us", level.alias("severity"),
        (v / 25).alias("z_score"), (v / 200).alias("hybrid_score"),
        F.when(F.col("id") % 2 == 0, "hybrid").otherwise("zscore").alias("detection_method"),
    )


ANOM = f"""{SIG}, anom AS (
  SELECT id, org, source, event_type, us,
         CASE WHEN value > 120 THEN 'CRITICAL' WHEN value > 90 THEN 'HIGH' WHEN value > 60 THEN 'MEDIUM'
              ELSE 'LOW' END AS severity,
         value / 25 AS z_score, value / 200 AS hybrid_score,
         CASE WHEN id % 2 = 0 THEN 'hybrid' ELSE 'zscore' END AS detection_method
  FROM sig WHERE value > 40)"""
MATCHES = """
  SELECT id, 1 AS playbook_id FROM anom WHERE org = 0 AND severity = 'HIGH' AND z_score >= 3.5
  UNION ALL SELECT id, 2 FROM anom WHERE org = 1 AND (severity = 'CRITICAL' OR contains(source, 'src1'))
  UNION ALL SELECT id, 3 FROM anom WHERE org = 2 AND event_type IN ('login_failed', 'login_success')
    AND hybrid_score <= 0.4
  UNION ALL SELECT id, 4 FROM anom WHERE org = 3
  UNION ALL SELECT id, 5 FROM anom WHERE org = 3 AND detection_method = 'hybrid' AND severity <> 'LOW'"""


def _matched(t: Tables):
    books = t.spark.createDataFrame(PLAYBOOKS, rules.PLAYBOOK_SCHEMA)
    return rules.playbook_match(_anomalies(t), books)


@query("playbook_match", f"WITH {ANOM} SELECT id, CAST(playbook_id AS BIGINT) AS playbook_id FROM ({MATCHES})")
def _(t):
    return _matched(t).select("id", "playbook_id")


@query(
    "playbook_route",
    f"""WITH {ANOM}, m AS ({MATCHES})
    SELECT id, CAST(playbook_id AS BIGINT) AS playbook_id,
      CASE playbook_id WHEN 1 THEN 'notify_email' WHEN 2 THEN 'escalate' WHEN 3 THEN 'create_incident'
           WHEN 4 THEN 'tag_event' ELSE 'send_report' END AS executed,
      CASE playbook_id WHEN 1 THEN 'block_ip' WHEN 2 THEN 'delete_data' WHEN 4 THEN 'disable_account'
           ELSE '' END AS skipped,
      CASE playbook_id WHEN 1 THEN 'Unknown action type: reboot' ELSE '' END AS unknown
    FROM m""",
)
def _(t):
    out = rules.playbook_route(_matched(t))
    unknown = F.filter("errors", lambda e: F.startswith(e, F.lit("Unknown")))
    return out.select(
        "id", "playbook_id", F.array_join("actions_executed", "|").alias("executed"),
        F.array_join("actions_skipped", "|").alias("skipped"), F.array_join(unknown, "|").alias("unknown"),
    )


def _features(t: Tables):
    return series.feature_vectors(t.sig(), "source", W, 5, B)


@query("iforest_train")
def _(t):
    return iforest.train(stored(_features(t), "features"), ["bin", "org"])


def _forest_scores(t: Tables):
    features = stored(_features(t), "features")
    return iforest.score(features, iforest.train(features, ["bin", "org"]))


@query("iforest_score")
def _(t):
    return _forest_scores(t).select("org", "bin", F.round("iforest_score", 9).alias("iforest_score"))


@query("hybrid_score_trained")
def _(t):
    counts = series.bin_counts(t.sig(), B)
    z = series.rate_stats(counts, W).select("org", "bin", "z")
    ew = folds.ewma(counts, length=128).select("org", "bin", "ewma_z")
    scored = _forest_scores(t).join(z, ["org", "bin"]).join(ew, ["org", "bin"])
    h = detect.hybrid_score(F.col("z"), F.col("ewma_z"), F.col("iforest_score"))
    return scored.select(
        "org", "bin", "c", F.round(h, 9).alias("hybrid"), detect.severity(h).alias("severity"),
        detect.detection_method(True).alias("method"),
    )


ASSETS = [
    ("SRC3", "CRITICAL", "Infrastructure", "Domain Controller", False, True),
    ("src7", "HIGH", "eCommerce", "Web Application Server", True, False),
    ("src9", "LOW", "Office", "Printer", False, False),
]
ASSET_SQL = """
  CASE source WHEN 'src3' THEN 'CRITICAL' WHEN 'src7' THEN 'HIGH' WHEN 'src9' THEN 'LOW' ELSE 'MEDIUM' END AS criticality,
  CASE source WHEN 'src3' THEN 2.5 WHEN 'src7' THEN 2.0 ELSE 1.0 END::DOUBLE AS risk_multiplier"""


def _assets(t: Tables):
    return t.spark.createDataFrame(ASSETS, enrich.ASSET_SCHEMA)


@query("asset_enrich", f"WITH {SIG} SELECT id, source, {ASSET_SQL} FROM sig")
def _(t):
    return enrich.asset_enrich(t.sig(), _assets(t)).select("id", "source", "criticality", "risk_multiplier")


@query(
    "module_scores",
    f"""WITH {SIG}, {BINS}, {MIX}, e AS (
      SELECT id, org, source, CASE event_type WHEN 'login_failed' THEN 'failed_login'
             WHEN 'admin_add' THEN 'brute_force' ELSE event_type END AS event_type,
             CAST(us // {B}000000 AS BIGINT) AS bin FROM sig)
    SELECT e.id, CASE WHEN event_type = 'failed_login' THEN 0.4
                 WHEN event_type = 'brute_force' OR burst_ratio > 5 THEN 0.9 ELSE 0 END::DOUBLE AS rule_score,
           CASE WHEN entropy < 1 THEN 0.7 ELSE 0 END::DOUBLE AS behaviour_score,
           CASE WHEN source IN ('src3', 'src7') THEN 0.8 ELSE 0.2 END::DOUBLE AS risk_score
    FROM e JOIN mix USING (org, bin) JOIN burst USING (org, bin)""",
)
def _(t):
    kind = F.col("event_type")
    events = enrich.asset_enrich(t.sig(), _assets(t)).select(
        "id", "org", "source", "risk_multiplier", series.bin_of("ts", B).alias("bin"),
        F.when(kind == "login_failed", "failed_login").when(kind == "admin_add", "brute_force")
        .otherwise(kind).alias("event_type"),
    )
    modules = ("Rule Engine", "Behavioral Engine", "Risk Engine")
    scores = detect.module_scores(
        F.col("event_type"), F.col("burst_ratio"), F.col("entropy"), F.col("risk_multiplier"), None, modules
    )
    out = events.join(_features(t).select("org", "bin", "entropy", "burst_ratio"), ["org", "bin"])
    out = out.withColumn("s", scores)
    names = ("rule_score", "behaviour_score", "risk_score")
    return out.select("id", *[F.col("s")[i]["score"].alias(n) for i, n in enumerate(names)])


# Claims of all documents as indicators, those of even documents as the known list.
KINDS = {"ioc_ip": "ip", "ioc_domain": "domain", "ioc_hash": "hash"}
TOKENS_SQL = """tok AS (
  SELECT doc_id, 'ip' AS type, unnest(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b')) AS value FROM documents
  UNION ALL
  SELECT doc_id, 'domain', lower(unnest(regexp_extract_all(text,
    '\\b(?:[a-zA-Z0-9-]+\\.)+(?:com|net|org|io|ru|cn|in|co|gov|edu|xyz|top|biz)\\b', 0, 'i'))) FROM documents
  UNION ALL SELECT doc_id, 'hash', lower(unnest(regexp_extract_all(text, '\\b[a-fA-F0-9]{32}\\b'))) FROM documents
  UNION ALL SELECT doc_id, 'hash', lower(unnest(regexp_extract_all(text, '\\b[a-fA-F0-9]{40}\\b'))) FROM documents
  UNION ALL SELECT doc_id, 'hash', lower(unnest(regexp_extract_all(text, '\\b[a-fA-F0-9]{64}\\b'))) FROM documents),
ind AS (SELECT * FROM tok WHERE type <> 'ip' OR NOT regexp_matches(value,
        '^(10\\.|192\\.168\\.|172\\.16\\.|172\\.17\\.|127\\.)|^0\\.0\\.0\\.0$')),
iocs AS (SELECT type, value, min(doc_id) AS doc_id FROM ind WHERE doc_id % 2 = 0 GROUP BY 1, 2)"""


def _indicators(t: Tables):
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    texts = spread(t.documents.select("doc_id", "text"))
    claims = indicators.extract_claims(texts, "text", "doc_id", kinds=KINDS)
    return claims.select(
        "doc_id", kinds[F.col("type")].alias("type"), "value"
    )


def _iocs(t: Tables):
    known = _indicators(t).filter("doc_id % 2 = 0").groupBy("type", "value")
    return known.agg(F.min("doc_id").alias("first_doc")).select(
        "type", "value", F.lit("feed").alias("source"), F.lit("HIGH").alias("severity"),
        F.concat(F.lit("seen in "), "first_doc").alias("description"),
        F.col("first_doc").alias("first_seen"), F.col("first_doc").alias("last_seen"),
    )


@query(
    "ioc_match",
    f"""WITH {TOKENS_SQL}
    SELECT i.doc_id, i.type, i.value, 'HIGH' AS ioc_severity, 'seen in ' || k.doc_id AS ioc_description,
           1.0::DOUBLE AS ioc_confidence
    FROM ind i JOIN iocs k ON k.type = i.type AND k.value = i.value""",
)
def _(t):
    out = enrich.ioc_match(_indicators(t), _iocs(t))
    return out.select("doc_id", "type", "value", "ioc_severity", "ioc_description", "ioc_confidence")


@query(
    "ioc_filter",
    f"""WITH {TOKENS_SQL} SELECT doc_id, type, value FROM ind
    WHERE (type, value) IN (SELECT type, value FROM iocs)""",
)
def _(t):
    return enrich.ioc_filter(_indicators(t), _iocs(t)).select("doc_id", "type", "value")


@query(
    "ioc_inventory",
    f"""WITH {TOKENS_SQL} SELECT count(*) AS total_indicators,
      count(*) FILTER (type = 'ip') AS ip, count(*) FILTER (type = 'domain') AS domain,
      count(*) FILTER (type = 'hash') AS hash FROM iocs""",
)
def _(t):
    return enrich.ioc_inventory(_iocs(t))


# Feeds played by pages: the host as a domain, stored once and delivered again.
PAGE_HOSTS = """ph AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)"""


def _hosts(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query(
    "ioc_upsert",
    f"""WITH {PAGE_HOSTS}, s AS (SELECT host, min(page_id) AS p FROM ph WHERE page_id % 3 <> 0 GROUP BY 1),
    b AS (SELECT host, max(page_id) AS p FROM ph WHERE page_id % 3 <> 1 GROUP BY 1)
    SELECT coalesce(s.host, b.host) AS value,
           CASE WHEN b.p IS NULL THEN 'stored' ELSE 'batch' || b.p END AS source,
           CAST(coalesce(s.p, 1000000) AS BIGINT) AS first_seen,
           CAST(CASE WHEN b.p IS NULL THEN s.p ELSE 1000000 END AS BIGINT) AS last_seen
    FROM s FULL JOIN b ON s.host = b.host""",
)
def _(t):
    hosts = _hosts(t)
    fixed = [F.lit("domain").alias("type"), F.col("host").alias("value")]
    rest = [F.lit("MEDIUM").alias("severity"), F.lit("host").alias("description")]
    store = hosts.filter("page_id % 3 <> 0").groupBy("host").agg(F.min("page_id").alias("p")).select(
        *fixed, F.lit("stored").alias("source"), *rest, F.col("p").alias("first_seen"), F.col("p").alias("last_seen")
    )
    batch = hosts.filter("page_id % 3 <> 1").select(
        *fixed, F.concat(F.lit("batch"), "page_id").alias("source"), *rest, F.col("page_id").alias("seq")
    )
    out = enrich.ioc_upsert(store, batch, F.lit(1_000_000))
    return out.select("value", "source", "first_seen", "last_seen")


@query(
    "parse_ioc_csv",
    f"""WITH {PAGE_HOSTS}
    SELECT page_id, host AS value, CASE page_id % 4 WHEN 0 THEN 'domain' ELSE 'ip' END AS type,
           CASE page_id % 4 WHEN 0 THEN 'otx' ELSE 'raw_csv_feed' END AS source,
           CASE page_id % 4 WHEN 0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
           CASE page_id % 4 WHEN 0 THEN 'bad' ELSE 'Ingested indicator' END AS description
    FROM ph WHERE page_id % 4 IN (0, 1)""",
)
def _(t):
    kind = F.col("page_id") % 4
    line = (
        F.when(kind == 0, F.concat("host", F.lit(" , domain, otx,HIGH, bad , more")))
        .when(kind == 1, F.concat("host", F.lit(",ip,,")))
        .when(kind == 2, F.concat("host", F.lit(",mutex,x")))
        .otherwise(F.col("host"))
    )
    return enrich.parse_ioc_csv(_hosts(t).select("page_id", line.alias("line")))


@query(
    "parse_ioc_json",
    f"""WITH {PAGE_HOSTS}
    SELECT page_id, host AS value, 'domain' AS type,
           CASE page_id % 4 WHEN 0 THEN 'otx' ELSE 'raw_json_feed' END AS source,
           'MEDIUM' AS severity, 'Ingested indicator' AS description
    FROM ph WHERE page_id % 4 IN (0, 1)""",
)
def _(t):
    kind = F.col("page_id") % 4
    line = (
        F.when(kind == 0, F.concat(F.lit('{"value":"'), "host", F.lit('","type":"domain","source":"otx"}')))
        .when(kind == 1, F.concat(F.lit('{"value":"'), "host", F.lit('","type":"domain","severity":""}')))
        .when(kind == 2, F.concat(F.lit('{"value":"'), "host", F.lit('"}')))
        .otherwise(F.concat(F.lit('{"value":"'), "host"))
    )
    return enrich.parse_ioc_json(_hosts(t).select("page_id", line.alias("line")))


# The test texts are invented prose: words of it stand in for the keywords.
WORDS = (
    (("ation", "brute"), ("T1110",), ("TA0006",), "one"),
    (("wh", "flood"), ("T1498",), ("TA0040",), "two"),
    (("secret", "outbound"), ("T1041",), ("TA0010",), "three"),
    (("password", "ransom"), ("T1486", "T1110"), ("TA0040", "TA0002"), "four"),
)
MITRE_SQL = """mt AS (SELECT doc_id,
  regexp_matches(lower(text), 'ation|brute') AS a, regexp_matches(lower(text), 'wh|flood') AS b,
  regexp_matches(lower(text), 'secret|outbound') AS c, regexp_matches(lower(text), 'password|ransom') AS d
  FROM documents)"""


@query(
    "mitre_map",
    f"""WITH {MITRE_SQL}
    SELECT doc_id, concat_ws('|', CASE WHEN a THEN 'T1110' END, CASE WHEN b THEN 'T1498' END,
        CASE WHEN c THEN 'T1041' END, CASE WHEN d THEN 'T1486' END,
        CASE WHEN d AND NOT a THEN 'T1110' END) AS techniques,
      concat_ws('|', CASE WHEN a THEN 'TA0006' END, CASE WHEN b THEN 'TA0040' END,
        CASE WHEN c THEN 'TA0010' END, CASE WHEN d AND NOT b THEN 'TA0040' END,
        CASE WHEN d THEN 'TA0002' END) AS tactics,
      CASE WHEN a OR b OR c OR d THEN concat_ws('; ', CASE WHEN a THEN 'one' END, CASE WHEN b THEN 'two' END,
        CASE WHEN c THEN 'three' END, CASE WHEN d THEN 'four' END)
        ELSE 'No specific MITRE ATT&CK mapping found' END AS mapping_description
    FROM mt""",
)
def _(t):
    out = enrich.mitre_map(spread(t.documents.select("doc_id", "text")), "text", words=WORDS)
    return out.select(
        "doc_id", F.array_join("techniques", "|").alias("techniques"),
        F.array_join("tactics", "|").alias("tactics"), "mapping_description",
    )


@query(
    "mitre_lookup",
    f"""WITH {SIG}, e AS (SELECT id, CASE event_type WHEN 'login_failed' THEN 'T1110.00' || (1 + id % 4)
        WHEN 'data_export' THEN 'T1041' WHEN 'admin_add' THEN 'T1078.004' WHEN 'page_view' THEN 'T9999'
        ELSE 'T1566.002' END AS ref FROM sig)
    SELECT id, ref, CASE WHEN ref LIKE 'T1110%' THEN 'Brute Force' WHEN ref = 'T1041' THEN 'Exfiltration Over C2 Channel'
        WHEN ref LIKE 'T1078%' THEN 'Valid Accounts' WHEN ref LIKE 'T1566%' THEN 'Phishing' END AS technique_name,
      CASE WHEN ref LIKE 'T1110%' THEN 'credential-access' WHEN ref = 'T1041' THEN 'exfiltration'
        WHEN ref LIKE 'T1078%' THEN 'persistence' WHEN ref LIKE 'T1566%' THEN 'initial-access' END AS tactic
    FROM e""",
)
def _(t):
    kind = F.col("event_type")
    ref = (
        F.when(kind == "login_failed", F.concat(F.lit("T1110.00"), 1 + F.col("id") % 4))
        .when(kind == "data_export", "T1041").when(kind == "admin_add", "T1078.004")
        .when(kind == "page_view", "T9999").otherwise("T1566.002")
    )
    out = enrich.mitre_lookup(t.sig().select("id", ref.alias("ref")), "ref", enrich.techniques_table(t.spark))
    return out.select("id", "ref", "technique_name", "tactic")


@query(
    "techniques_by_tactic",
    f"""WITH {SIG}, e AS (SELECT CASE event_type WHEN 'login_failed' THEN 'Credential Access' WHEN 'data_export' THEN 'exfiltration'
        WHEN 'admin_add' THEN 'Lateral  MOVEMENT' WHEN 'page_view' THEN 'no such tactic' ELSE 'impact' END AS asked FROM sig)
    SELECT asked, technique_id, count(*) AS n FROM e LEFT JOIN (VALUES ('Credential Access', 'T1110'), ('exfiltration', 'T1041'),
      ('Lateral  MOVEMENT', 'T1021'), ('impact', 'T1498'), ('impact', 'T1486')) v(tactic, technique_id) ON tactic = asked GROUP BY 1, 2""",
)
def _(t):
    kind = F.col("event_type")
    asked = (
        F.when(kind == "login_failed", "Credential Access").when(kind == "data_export", "exfiltration")
        .when(kind == "admin_add", "Lateral  MOVEMENT").when(kind == "page_view", "no such tactic").otherwise("impact")
    )
    out = enrich.tactic_lookup(t.sig().select(asked.alias("asked")), "asked", enrich.techniques_table(t.spark))
    return out.groupBy("asked", "technique_id").agg(F.count(F.lit(1)).alias("n"))


# Anomalies played by customers, incidents by their orders.
def _customers(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("z_score"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("event_count"),
    )


def _linked(t: Tables):
    return t.cases().withColumnRenamed("customer_id", "anomaly_id")


@query(
    "incidents_with_scores",
    f"""WITH {CASES}
    SELECT i.id, i.customer_id AS anomaly_id, i.severity, c.c_acctbal AS z_score
    FROM cases i LEFT JOIN customer c ON c.c_custkey = i.customer_id AND c.c_custkey % 2 = 0
    ORDER BY i.created_at DESC, i.id DESC LIMIT 50""",
)
def _(t):
    even = _customers(t).filter("id % 2 = 0").select("id", "z_score")
    return joins.incidents_with_scores(_linked(t), even).select("id", "anomaly_id", "severity", "z_score")


@query(
    "pending_alerts",
    f"""WITH {CASES}
    SELECT c.c_custkey AS id, c.c_acctbal AS z_score, i.id AS incident_id
    FROM customer c LEFT JOIN cases i ON i.customer_id = c.c_custkey AND i.severity = 'CRITICAL'
    WHERE c.c_custkey > 20""",
)
def _(t):
    bad = _linked(t).filter("severity = 'CRITICAL'")
    return joins.pending_alerts(_customers(t), bad, 20).select("id", "z_score", "incident_id")


@query(
    "pending_alerts_recent",
    f"""WITH {CASES}, a AS (SELECT c_custkey AS id, c_acctbal AS z_score, c_custkey * 10 AS timestamp,
        CASE c_custkey % 3 WHEN 0 THEN 'Mitigated' WHEN 1 THEN 'Acknowledged' ELSE 'Pending Mitigation' END AS status
        FROM customer)
    SELECT a.id, a.z_score, i.id AS incident_id FROM a LEFT JOIN cases i ON i.customer_id = a.id
    WHERE a.status NOT IN ('Mitigated', 'Acknowledged') AND a.timestamp >= 1000 - 120""",
)
def _(t):
    k = F.col("id") % 3
    status = F.when(k == 0, "Mitigated").when(k == 1, "Acknowledged").otherwise("Pending Mitigation")
    rows = _customers(t).withColumns({"timestamp": F.col("id") * 10, "status": status})
    out = joins.pending_alerts(rows, _linked(t), now=F.lit(1000))
    return out.select("id", "z_score", "incident_id")


@query(
    "orphan_anomalies",
    f"""WITH {CASES}
    SELECT c_custkey AS anomaly_id, printf('[ZSCORE] MEDIUM Severity Anomaly Breach #%d', c_custkey) AS title,
      printf('ZSCORE detection triggered at %d events/sec. Z-Score=%.2f, iForest=0.000, EWMA=0.00, Hybrid=0.000.',
             c_nationkey, c_acctbal) AS description, 'MEDIUM' AS severity, 'OPEN' AS status
    FROM customer WHERE c_custkey NOT IN (SELECT customer_id FROM cases WHERE severity = 'CRITICAL' AND status = 'open')""",
)
def _(t):
    none = {c: F.lit(None).cast("double") for c in ("iforest_score", "ewma_score", "hybrid_score")}
    text = {c: F.lit(None).cast("string") for c in ("detection_method", "severity")}
    bad = _linked(t).filter("severity = 'CRITICAL' and status = 'open'")
    return joins.orphan_anomalies(_customers(t).withColumns({**none, **text}), bad)


@query(
    "backfill_empty",
    f"""WITH {CASES}, i AS (SELECT id, customer_id, severity, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'known' END AS root_cause,
        CASE id % 5 WHEN 0 THEN '' ELSE 'act' END AS recommended_action,
        CASE WHEN status = 'closed' THEN 'MITIGATED' ELSE 'OPEN' END AS status FROM cases),
    j AS (SELECT i.*, c_acctbal, c_nationkey, c_mktsegment,
                 coalesce(root_cause, '') = '' OR recommended_action = '' AS todo
          FROM i LEFT JOIN customer ON c_custkey = customer_id AND c_custkey % 2 = 0),
    z AS (SELECT *, CASE WHEN c_acctbal <> 0 THEN regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') ELSE 'N/A' END AS z FROM j)
    SELECT id, CASE WHEN todo THEN 'Traffic anomaly detected (Z-Score: ' || z || ', ' ||
        CASE WHEN c_nationkey <> 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '0' END || ' events/sec, severity: ' ||
        coalesce(c_mktsegment, 'MEDIUM') || ')' ELSE root_cause END AS root_cause,
      CASE WHEN todo THEN 'Analyzed by AI agent — no detailed diagnosis available.' ELSE 'old' END AS ai_diagnosis,
      CASE WHEN todo THEN CASE WHEN status = 'MITIGATED' THEN 'Automated containment applied.'
           ELSE 'Pending analyst review.' END ELSE 'old' END AS resolution
    FROM z""",
)
def _(t):
    i = F.col("id")
    incidents = _linked(t).select(
        "id", "anomaly_id",
        F.when(i % 4 == 0, "").when(i % 4 == 1, F.lit(None)).otherwise("known").alias("root_cause"),
        F.when(i % 5 == 0, "").otherwise("act").alias("recommended_action"),
        F.when(F.col("status") == "closed", "MITIGATED").otherwise("OPEN").alias("status"),
        F.lit("old").alias("ai_diagnosis"), F.lit("old").alias("resolution"),
    )
    facts = _customers(t).filter("id % 2 = 0").select(
        "id", F.lit("").alias("diagnosis"), "z_score", "event_count", F.col("segment").alias("severity")
    )
    out = joins.backfill_empty(incidents, facts)
    return out.select("id", "root_cause", "ai_diagnosis", "resolution")


@query(
    "audit_with_user",
    f"""WITH {CASES} SELECT i.id, i.customer_id AS user_id, c.c_name AS user_name
    FROM cases i LEFT JOIN customer c ON c.c_custkey = i.customer_id WHERE i.org = 2
    ORDER BY i.created_at DESC, i.id DESC LIMIT 100""",
)
def _(t):
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    audit = t.cases().withColumnRenamed("customer_id", "user_id")
    return joins.audit_with_user(audit, users, 2, 100).select("id", "user_id", "user_name")


def _prompts(t: Tables):
    return t.conversations.select(
        (F.col("conv_id") % 3).alias("org"), F.concat(F.lit("p"), "conv_id").alias("name"),
        (F.col("turn") + 1).alias("version"), F.col("text").alias("template"),
        ((F.col("conv_id") % 2 == 0) & (F.col("turn") == F.col("conv_id") % 4)).alias("is_active"),
    )


PROMPTS = """pr AS (SELECT conv_id % 3 AS org, 'p' || conv_id AS name, turn + 1 AS version, text AS template,
  conv_id % 2 = 0 AND turn = conv_id % 4 AS is_active FROM conversations)"""


@query(
    "latest_version",
    f"""WITH {PROMPTS} SELECT org, name, version, is_active FROM (
      SELECT *, row_number() OVER (PARTITION BY org, name ORDER BY is_active DESC, version DESC) AS rn FROM pr)
    WHERE rn = 1""",
)
def _(t):
    return joins.latest_version(_prompts(t)).select("org", "name", "version", "is_active")


@query(
    "active_versions",
    f"WITH {PROMPTS} SELECT org, name, version FROM pr WHERE is_active",
)
def _(t):
    return joins.active_versions(_prompts(t)).select("org", "name", "version")


@query(
    "rollback_version",
    f"""WITH {PROMPTS}, has AS (SELECT org, name FROM pr WHERE org = 1 AND version = 2),
    last AS (SELECT org, name, max(version) AS v FROM pr WHERE (org, name) IN (SELECT org, name FROM has) GROUP BY 1, 2)
    SELECT org, name, version, md5(template) AS template,
           is_active AND (org, name) NOT IN (SELECT org, name FROM has) AS is_active FROM pr
    UNION ALL
    SELECT pr.org, pr.name, l.v + 1, md5(template), true FROM pr JOIN last l USING (org, name) WHERE pr.version = 2""",
)
def _(t):
    out = joins.rollback_version(_prompts(t), ("org", "name"), F.col("org") == 1, 2)
    return out.withColumn("template", F.md5("template"))


@query(
    "agent_trace",
    """SELECT conv_id, turn, role FROM conversations
    WHERE conv_id = (SELECT max(conv_id) FROM conversations) ORDER BY turn""",
)
def _(t):
    steps = t.conversations.select("conv_id", "turn", "role")
    return joins.agent_trace(steps, "conv_id", "turn", "role")


@query(
    "first_matching",
    f"""WITH {CASES} SELECT id, status, severity FROM cases
    WHERE id = (SELECT min(id) FROM cases WHERE status = 'open' AND severity = 'HIGH')""",
)
def _(t):
    cond = (F.col("status") == "open") & (F.col("severity") == "HIGH")
    return joins.first_matching(t.cases(), "id", cond).select("id", "status", "severity")


@query(
    "latest_n",
    "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 100",
)
def _(t):
    return joins.latest_n(t.events, "event_id", 100).select("event_id", "user_id")
