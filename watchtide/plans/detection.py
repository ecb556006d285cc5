"""Windows, detection and folds over the event stream, in hourly bins of one day's window."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchtide.operators import detect, folds, rolling, series
from watchtide.plans.registry import SIG, Tables, query

B, W = 3600, 24
DAY = 86_400
# The test stream is sparse: rolling windows of an hour and of a day instead of a minute.
HOUR = 3600

BINS = f"""bins AS (
  SELECT org, CAST(us // {B}000000 AS BIGINT) AS bin, count(*) AS c
  FROM sig GROUP BY 1, 2)"""

GRID = f"""grid AS (
  SELECT o.org, CAST(g.bin AS BIGINT) AS bin, coalesce(b.c, 0) AS c
  FROM (SELECT org, min(bin) AS lo, max(bin) AS hi FROM bins GROUP BY 1) o,
       LATERAL (SELECT unnest(generate_series(o.lo - {W}, o.hi)) AS bin) g
  LEFT JOIN bins b ON b.org = o.org AND b.bin = g.bin)"""

ZS = f"""zs AS (
  SELECT g.org, g.bin, g.c, m AS mean, s AS std,
         CASE WHEN s > 0 THEN (g.c - m) / s ELSE 0 END AS z
  FROM (SELECT org, bin, c,
               avg(c) OVER w AS m, stddev_samp(c) OVER w AS s
        FROM grid
        WINDOW w AS (PARTITION BY org ORDER BY bin ROWS BETWEEN {W} PRECEDING AND 1 PRECEDING)) g
  JOIN bins b ON b.org = g.org AND b.bin = g.bin)"""

RATE = f"""rs AS (
  SELECT g.org, g.bin, g.c, m AS mean, s AS std,
         CASE WHEN s > 0.001 THEN (g.c - m) / s ELSE 0 END AS z
  FROM (SELECT org, bin, c, avg(c) OVER w AS m, stddev_pop(c) OVER w AS s
        FROM grid
        WINDOW w AS (PARTITION BY org ORDER BY bin ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)) g
  JOIN bins b ON b.org = g.org AND b.bin = g.bin)"""

# EWMA over the dense grid from each organisation's first bin on, alpha 0.15.
EWMA = f"""dense AS (
  SELECT g.org, g.bin, g.c, row_number() OVER (PARTITION BY g.org ORDER BY g.bin) AS rn
  FROM grid g JOIN (SELECT org, min(bin) AS lo FROM bins GROUP BY 1) f
    ON f.org = g.org AND g.bin >= f.lo),
ew AS (
  SELECT org, bin, rn, c, CAST(c AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM dense WHERE rn = 1
  UNION ALL
  SELECT d.org, d.bin, d.rn, d.c, 0.15 * d.c + 0.85 * e.m,
         0.85 * (e.v + 0.15 * (d.c - e.m) * (d.c - e.m))
  FROM ew e JOIN dense d ON d.org = e.org AND d.rn = e.rn + 1),
ewma AS (
  SELECT org, bin, c, m AS ewma_mean, sqrt(v) AS ewma_std,
         CASE WHEN sqrt(v) > 0.001 THEN (c - m) / sqrt(v) ELSE 0 END AS ewma_z FROM ew)"""


def r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _bins(t: Tables):
    return series.bin_counts(t.sig(), B)


@query("bin_counts", f"WITH {SIG}, {BINS} SELECT org, bin, c FROM bins")
def _(t):
    return _bins(t)


@query(
    "timeline",
    f"""WITH {SIG}, {BINS}
    SELECT o.org, CAST(g.bin AS BIGINT) AS bin, CAST(coalesce(b.c, 0) AS BIGINT) AS c
    FROM (SELECT DISTINCT org FROM sig) o,
         (SELECT unnest(generate_series(474185 - 120, 474185)) AS bin) g
    LEFT JOIN bins b ON b.org = o.org AND b.bin = g.bin""",
)
def _(t):
    return series.timeline(t.sig(), 474185, 120, B)


@query(
    "zscore",
    f"""WITH {SIG}, {BINS}, {GRID}, {ZS}
    SELECT org, bin, c, round(mean, 6) AS mean, round(std, 6) AS std, round(z, 6) AS z FROM zs""",
)
def _(t):
    z = series.zscore(_bins(t), W)
    return z.select("org", "bin", "c", r("mean"), r("std"), r("z"))


@query(
    "rate_stats",
    f"""WITH {SIG}, {BINS}, {GRID}, {RATE}
    SELECT org, bin, c, round(mean, 6) AS mean, round(std, 6) AS std, round(z, 6) AS z FROM rs""",
)
def _(t):
    z = series.rate_stats(_bins(t), W)
    return z.select("org", "bin", "c", r("mean"), r("std"), r("z"))


@query(
    "breach",
    f"""WITH {SIG}, {BINS}, {GRID}, {ZS}
    SELECT org, bin, c, round(z, 6) AS z,
           CASE WHEN z > 4 THEN 'CRITICAL' WHEN z > 3 THEN 'HIGH' WHEN z > 2 THEN 'MEDIUM'
                ELSE 'LOW' END AS severity
    FROM zs WHERE z > 2 AND c > 5""",
)
def _(t):
    out = detect.breaches(t.sig(), W, B, threshold=2.0)
    return out.select("org", "bin", "c", r("z"), "severity")


@query(
    "rolling_rate",
    f"""WITH {SIG}
    SELECT id, round(count(*) OVER (PARTITION BY org ORDER BY us
           RANGE BETWEEN {HOUR}000000 PRECEDING AND CURRENT ROW) / {HOUR}.0, 9) AS rate
    FROM sig""",
)
def _(t):
    return rolling.rolling_rate(t.sig(), HOUR).select("id", r("rate", 9))


@query(
    "rate_by_source",
    f"""WITH {SIG}
    SELECT id, source, round(count(*) OVER (PARTITION BY org, source ORDER BY us
           RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW) / {DAY}.0, 9) AS rate
    FROM sig""",
)
def _(t):
    return rolling.rolling_rate(t.sig(), DAY, ("org", "source")).select("id", "source", r("rate", 9))


@query(
    "rate_by_user",
    f"""WITH {SIG}
    SELECT id, user_name, round(count(*) OVER (PARTITION BY org, lower(trim(user_name)) ORDER BY us
           RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW) / {DAY}.0, 9) AS rate
    FROM sig""",
)
def _(t):
    df = t.sig().withColumn("entity", rolling.entity("user_name"))
    return rolling.rolling_rate(df, DAY, ("org", "entity")).select("id", "user_name", r("rate", 9))


@query(
    "failed_auth_count",
    f"""WITH {SIG}
    SELECT id, CAST(sum(CASE WHEN event_type = 'login_failed' THEN 1 ELSE 0 END)
             OVER (PARTITION BY org ORDER BY us RANGE BETWEEN {HOUR}000000 PRECEDING AND CURRENT ROW)
             AS BIGINT) AS failures
    FROM sig""",
)
def _(t):
    f = {"failures": rolling.failed_auth(["login_failed"])}
    return rolling.rolling(t.sig(), f, HOUR).select("id", "failures")


@query(
    "user_auth_failures",
    f"""WITH {SIG}
    SELECT id, user_name, CAST(sum(CASE WHEN event_type = 'login_failed' THEN 1 ELSE 0 END)
             OVER (PARTITION BY org, lower(trim(user_name)) ORDER BY us
                   RANGE BETWEEN {DAY}000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS failures
    FROM sig""",
)
def _(t):
    df = t.sig().withColumn("entity", rolling.entity("user_name"))
    f = {"failures": rolling.failed_auth(["login_failed"])}
    return rolling.rolling(df, f, DAY, ("org", "entity")).select("id", "user_name", "failures")


@query(
    "unique_users_in_window",
    f"""WITH {SIG}
    SELECT id, CAST(len(list_distinct(list(user_name) OVER (PARTITION BY org ORDER BY us
           RANGE BETWEEN 6 * {HOUR}000000 PRECEDING AND CURRENT ROW))) AS BIGINT) AS users
    FROM sig""",
)
def _(t):
    return rolling.unique_in_window(t.sig(), "user_name", 6 * HOUR, name="users").select("id", "users")


@query(
    "unique_destinations_in_window",
    f"""WITH {SIG}, d AS (SELECT id, org, us, CASE WHEN event_type <> 'page_view'
                               THEN 'dst' || (bytes % 7) END AS destination FROM sig)
    SELECT id, CAST(coalesce(len(list_distinct(list(destination) FILTER (destination IS NOT NULL)
           OVER (PARTITION BY org ORDER BY us
           RANGE BETWEEN 2 * {HOUR}000000 PRECEDING AND CURRENT ROW))), 0) AS BIGINT) AS destinations
    FROM d""",
)
def _(t):
    dest = F.when(F.col("event_type") != "page_view", F.concat(F.lit("dst"), F.col("bytes") % 7))
    df = t.sig().withColumn("destination", dest)
    out = rolling.unique_in_window(df, "destination", 2 * HOUR, name="destinations")
    return out.select("id", "destinations")


@query(
    "bytes_in_window",
    f"""WITH {SIG}
    SELECT id, CAST(sum(coalesce(bytes, 0)) OVER (PARTITION BY org ORDER BY us
           RANGE BETWEEN {HOUR}000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes_moved
    FROM sig""",
)
def _(t):
    return rolling.rolling(t.sig(), {"bytes_moved": rolling.bytes_moved()}, HOUR).select("id", "bytes_moved")


@query(
    "protocol_distribution",
    f"""WITH {SIG}, {BINS}, p AS (
      SELECT org, CAST(us // {B}000000 AS BIGINT) AS bin, event_type, count(*) AS n
      FROM sig GROUP BY 1, 2, 3)
    SELECT b.org, b.bin, p.event_type, CAST(sum(p.n) AS BIGINT) AS n
    FROM bins b JOIN p ON p.org = b.org AND p.bin BETWEEN b.bin - {W - 1} AND b.bin
    GROUP BY 1, 2, 3""",
)
def _(t):
    return series.value_counts_in_window(t.sig(), "event_type", W, B)


@query(
    "anomaly_density",
    f"""WITH {SIG}, a AS (SELECT id, org, us, CASE id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'CRITICAL'
        ELSE 'LOW' END AS severity, event_type = 'login_failed' AS flag FROM sig)
    SELECT id, CAST(sum(CASE WHEN severity IN ('HIGH', 'CRITICAL') OR flag THEN 1 ELSE 0 END)
           OVER (PARTITION BY org ORDER BY us RANGE BETWEEN {HOUR}000000 PRECEDING AND CURRENT ROW)
           AS BIGINT) AS density
    FROM a""",
)
def _(t):
    level = F.when(F.col("id") % 5 == 0, "HIGH").when(F.col("id") % 5 == 1, "CRITICAL").otherwise("LOW")
    df = t.sig().withColumns(
        {"severity": level, "is_anomaly": F.col("event_type") == "login_failed"}
    )
    return rolling.rolling(df, {"density": rolling.anomaly_density()}, HOUR).select("id", "density")


MIX = f"""p AS (
  SELECT org, CAST(us // {B}000000 AS BIGINT) AS bin, source, count(*) AS n
  FROM sig GROUP BY 1, 2, 3),
pw AS (SELECT b.org, b.bin, p.source, sum(p.n) AS n
       FROM bins b JOIN p ON p.org = b.org AND p.bin BETWEEN b.bin - {W - 1} AND b.bin
       GROUP BY 1, 2, 3),
mix AS (SELECT org, bin, CAST(count(*) AS BIGINT) AS unique_sources, CAST(sum(n) AS BIGINT) AS total,
               -sum(n / t * log2(n / t)) AS entropy
        FROM (SELECT *, sum(n) OVER (PARTITION BY org, bin) AS t FROM pw) GROUP BY 1, 2),
burst AS (SELECT org, bin, c, max(c) OVER w / avg(c) OVER w AS burst_ratio,
                 CAST(sum(c) OVER w AS DOUBLE) AS s,
                 CAST(sum(c) OVER (PARTITION BY org ORDER BY bin
                      RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) AS s5
          FROM bins WINDOW w AS (PARTITION BY org ORDER BY bin
                      RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW))"""


@query(
    "source_entropy",
    f"""WITH {SIG}, {BINS}, {MIX}
    SELECT org, bin, total, unique_sources, round(entropy, 6) AS entropy FROM mix""",
)
def _(t):
    out = series.sliding_distribution(t.sig(), "source", W, B)
    return out.select(
        "org", "bin", "total", F.col("distinct_values").alias("unique_sources"), r("entropy")
    )


@query(
    "burst_ratio",
    f"""WITH {SIG}, {BINS}, {MIX}
    SELECT org, bin, c, round(burst_ratio, 6) AS burst_ratio FROM burst""",
)
def _(t):
    return series.burst_ratio(_bins(t), W).select("org", "bin", "c", r("burst_ratio"))


@query(
    "feature_vector",
    f"""WITH {SIG}, {BINS}, {MIX}
    SELECT org, bin, c, round(s / {W * B}, 9) AS rate, round(entropy, 6) AS entropy, unique_sources,
           round(s / {W * B} - s5 / {5 * B}, 9) AS acceleration, round(burst_ratio, 6) AS burst_ratio
    FROM burst JOIN mix USING (org, bin)""",
)
def _(t):
    out = series.feature_vectors(t.sig(), "source", W, 5, B)
    return out.select(
        "org", "bin", "c", r("rate", 9), r("entropy"), "unique_sources", r("acceleration", 9),
        r("burst_ratio"),
    )


@query(
    "ewma",
    f"""WITH RECURSIVE {SIG}, {BINS}, {GRID}, {EWMA}
    SELECT org, bin, CAST(c AS DOUBLE) AS c, round(ewma_mean, 6) AS ewma_mean,
           round(ewma_std, 6) AS ewma_std, round(ewma_z, 5) AS ewma_z FROM ewma""",
)
def _(t):
    out = folds.ewma(_bins(t), length=128, fill=True)
    return out.select("org", "bin", "c", r("ewma_mean"), r("ewma_std"), r("ewma_z", 5))


def _scored(t: Tables):
    counts = _bins(t)
    z = series.rate_stats(counts, W).select("org", "bin", "c", "z")
    ew = folds.ewma(counts, length=128).select("org", "bin", "ewma_z")
    return z.join(ew, ["org", "bin"]).withColumn(
        "hybrid", detect.hybrid_score(F.col("z"), F.col("ewma_z"))
    )


HYB = f"""hyb AS (
  SELECT rs.org, rs.bin, rs.c, rs.z, ewma_z,
         0.6 * least(rs.z / 9.0, 1.0) + 0.4 * least(abs(ewma_z) / 6.0, 1.0) AS hybrid
  FROM rs JOIN ewma ON ewma.org = rs.org AND ewma.bin = rs.bin)"""


@query(
    "hybrid_score",
    f"""WITH RECURSIVE {SIG}, {BINS}, {GRID}, {RATE}, {EWMA}, {HYB}
    SELECT org, bin, c, round(hybrid, 5) AS hybrid, 'ZSCORE+EWMA' AS method,
           CASE WHEN hybrid >= 0.7 THEN 'CRITICAL' WHEN hybrid >= 0.5 THEN 'HIGH'
                WHEN hybrid >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
           z > 3 OR hybrid >= 0.3 AS scored_high, (z > 3 OR hybrid >= 0.3) AND c > 5 AS breach
    FROM hyb""",
)
def _(t):
    h, z = F.col("hybrid"), F.col("z")
    return _scored(t).select(
        "org", "bin", "c", r("hybrid", 5), detect.detection_method(False).alias("method"),
        detect.severity(h).alias("severity"),
        ((z > 3) | (h >= 0.3)).alias("scored_high"),
        detect.is_breach(F.col("c"), z, h).alias("breach"),
    )


@query(
    "severity_z",
    f"""WITH {SIG}, {BINS}, {GRID}, {ZS}
    SELECT CASE WHEN z > 6 THEN 'CRITICAL' WHEN z > 4.5 THEN 'HIGH' WHEN z > 3 THEN 'MEDIUM'
                ELSE 'LOW' END AS severity, count(*) AS n
    FROM zs GROUP BY 1""",
)
def _(t):
    z = series.zscore(_bins(t), W)
    return z.groupBy(detect.severity_z(F.col("z")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


# Alerts played by events worth more than 60, two copies in every seventh second.
ALERTS = """alerts AS (
  SELECT id, org, us, us // 1000000 AS sec FROM sig WHERE value > 60
  UNION ALL
  SELECT id + 100000000, org, us, us // 1000000 FROM sig WHERE value > 60 AND id % 7 = 0)"""


def _alerts(t: Tables):
    base = t.sig().filter("value > 60").select(
        "id", "org", "us", F.expr("us div 1000000").alias("sec")
    )
    copies = base.filter("id % 7 = 0").withColumn("id", F.col("id") + 100_000_000)
    return base.unionByName(copies)


@query(
    "alert_dedup",
    f"""WITH {SIG}, {ALERTS}, stored AS (SELECT DISTINCT org, us // 1000000 AS sec FROM sig
                                        WHERE value > 60 AND id % 11 = 0)
    SELECT org, sec, min(id) AS id FROM alerts
    WHERE (org, sec) NOT IN (SELECT org, sec FROM stored) GROUP BY 1, 2""",
)
def _(t):
    stored = t.sig().filter("value > 60 and id % 11 = 0").select(
        "org", F.expr("us div 1000000").alias("sec")
    )
    return detect.alert_dedup(_alerts(t), stored).select("org", "sec", "id")


@query(
    "alert_cooldown",
    f"""WITH RECURSIVE {SIG}, a AS (
      SELECT org, us, min(id) AS id FROM sig WHERE value > 60 GROUP BY 1, 2),
    sent AS (
      SELECT org, min(us) AS us FROM a GROUP BY 1
      UNION ALL
      SELECT s.org, (SELECT min(a.us) FROM a WHERE a.org = s.org AND a.us > s.us + 36000000000)
      FROM sent s WHERE s.us IS NOT NULL)
    SELECT a.org, a.us, a.id FROM a JOIN sent s ON s.org = a.org AND s.us = a.us""",
)
def _(t):
    alerts = t.sig().filter("value > 60").select("id", "org", "us")
    return folds.alert_cooldown(alerts, 10 * HOUR).select("org", "us", "id")


@query(
    "hourly_rate_limit",
    f"""WITH RECURSIVE {SIG}, a AS (SELECT id, org AS playbook_id, us FROM sig),
    opens AS (
      SELECT playbook_id, min(us) AS us FROM a GROUP BY 1
      UNION ALL
      SELECT s.playbook_id, (SELECT min(a.us) FROM a WHERE a.playbook_id = s.playbook_id
                             AND a.us > s.us + 3600000000)
      FROM opens s WHERE s.us IS NOT NULL),
    placed AS (
      SELECT a.*, o.us AS opened FROM a ASOF JOIN (SELECT * FROM opens WHERE us IS NOT NULL) o
        ON a.playbook_id = o.playbook_id AND a.us >= o.us)
    SELECT id, playbook_id,
           row_number() OVER (PARTITION BY playbook_id, opened ORDER BY us, id) <= 2 AS allowed
    FROM placed""",
)
def _(t):
    fires = t.sig().select("id", F.col("org").alias("playbook_id"), "us")
    return folds.hourly_rate_limit(fires, 2).select("id", "playbook_id", "allowed")


@query(
    "quota_admission",
    f"""WITH RECURSIVE {SIG}, b AS (
      SELECT id, org, us // 86400000000 AS day, 1 + (id * 7) % 23 AS size,
             row_number() OVER (PARTITION BY org, us // 86400000000 ORDER BY us, id) AS rn FROM sig),
    walk AS (
      SELECT id, org, day, rn, size <= 200 AS accepted,
             CASE WHEN size <= 200 THEN size ELSE 0 END AS used FROM b WHERE rn = 1
      UNION ALL
      SELECT b.id, b.org, b.day, b.rn, w.used + b.size <= 200,
             CASE WHEN w.used + b.size <= 200 THEN w.used + b.size ELSE w.used END
      FROM walk w JOIN b ON b.org = w.org AND b.day = w.day AND b.rn = w.rn + 1)
    SELECT id, org, day, accepted FROM walk""",
)
def _(t):
    batches = t.sig().select(
        "id", "org", "us", F.expr("us div 86400000000").alias("day"),
        (1 + (F.col("id") * 7) % 23).alias("size"),
    )
    return folds.quota_admission(batches, 200).select("id", "org", "day", "accepted")


@query(
    "service_health",
    f"""WITH {SIG}, a AS (
      SELECT id, source AS service, us, event_type IN ('login_failed', 'data_export', 'admin_add') AS bad
      FROM sig),
    g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER w AS grp FROM a
          WINDOW w AS (PARTITION BY service ORDER BY us, id)),
    n AS (SELECT *, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END)
              OVER (PARTITION BY service, grp ORDER BY us, id) AS BIGINT) AS fails FROM g),
    p AS (SELECT *, lag(fails, 1, 0) OVER (PARTITION BY service ORDER BY us, id) AS prior FROM n)
    SELECT id, service, fails AS consecutive_failures,
           CASE WHEN NOT bad THEN 'healthy' WHEN fails >= 3 THEN 'unhealthy' ELSE 'degraded' END AS status,
           CASE WHEN bad AND fails = 1 THEN 'warning' WHEN bad AND fails = 3 THEN 'critical'
                WHEN NOT bad AND prior >= 3 THEN 'resolved' END AS alert
    FROM p""",
)
def _(t):
    checks = t.sig().select("id", F.col("source").alias("service"), "us", "event_type")
    bad = F.col("event_type").isin("login_failed", "data_export", "admin_add")
    out = folds.service_health(checks, bad)
    return out.select("id", "service", "consecutive_failures", "status", "alert")


FLAGS = """flags AS (
  SELECT org, us, CAST(event_type = 'login_failed' AS INT) AS f,
         CAST(event_type = 'data_export' AS INT) AS x, CAST(event_type = 'admin_add' AS INT) AS p
  FROM sig)"""
INDICATORS = f"""ind AS (
  SELECT org, bin, c, CAST(sum(f) OVER w AS BIGINT) AS failed_logins,
         CAST(sum(x) OVER w AS BIGINT) AS large_transfers,
         CAST(sum(p) OVER w AS BIGINT) AS privileged_actions, CAST(0 AS BIGINT) AS service_drops
  FROM (SELECT org, CAST(us // {B}000000 AS BIGINT) AS bin, count(*) AS c, sum(f) AS f,
               sum(x) AS x, sum(p) AS p FROM flags GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY org ORDER BY bin RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query(
    "threat_indicator_counts",
    f"WITH {SIG}, {FLAGS}, {INDICATORS} SELECT * FROM ind",
)
def _(t):
    return detect.indicator_counts(t.sig(), 2, B)


@query(
    "classify_threat",
    f"""WITH {SIG}, {BINS}, {GRID}, {ZS}, {FLAGS}, {INDICATORS}
    SELECT i.org, i.bin,
      CASE WHEN failed_logins >= 10 THEN 'Possible Brute Force Activity'
           WHEN i.c <= 2 THEN 'Possible Service Failure'
           WHEN large_transfers > 0 THEN 'Possible Data Exfiltration'
           WHEN privileged_actions > 0 THEN 'Possible Insider Threat'
           ELSE 'Possible DDoS Activity' END AS possible_threat,
      CASE WHEN failed_logins >= 10 THEN 82.0 WHEN i.c <= 2 THEN 74.0
           WHEN large_transfers > 0 THEN 71.0 WHEN privileged_actions > 0 THEN 69.0
           WHEN i.c >= 10 OR z > 3 THEN 76.0 ELSE 65.0 END::DOUBLE AS threat_confidence
    FROM ind i JOIN zs ON zs.org = i.org AND zs.bin = i.bin""",
)
def _(t):
    sig = t.sig()
    z = series.zscore(series.bin_counts(sig, B), W).select("org", "bin", "z")
    out = detect.classify_threat(detect.indicator_counts(sig, 2, B).join(z, ["org", "bin"]))
    return out.select("org", "bin", "possible_threat", "threat_confidence")


@query(
    "peak_near",
    f"""WITH {SIG}, {BINS}, {GRID}, {ZS},
    al AS (SELECT org, bin, org * 1000000 + bin AS id FROM zs WHERE z > 1.5 AND c > 5),
    near AS (SELECT al.org, al.id, b.bin, b.c,
                    row_number() OVER (PARTITION BY al.org, al.id ORDER BY b.c DESC, b.bin) AS rn
             FROM al JOIN bins b ON b.org = al.org AND b.bin BETWEEN al.bin - 3 AND al.bin + 3)
    SELECT org, bin AS peak_bin, min(id) AS id, max(c) AS peak_count FROM near WHERE rn = 1 GROUP BY 1, 2""",
)
def _(t):
    counts = _bins(t)
    z = series.zscore(counts, W).filter("z > 1.5 and c > 5")
    alerts = z.select("org", "bin", (F.col("org") * 1_000_000 + F.col("bin")).alias("id"))
    return series.peak_near(alerts, counts).select("org", "peak_bin", "id", "peak_count")


@query(
    "detection_title",
    f"""WITH {SIG}, {BINS}, {GRID}, {ZS}
    SELECT org, bin,
      printf('[ZSCORE] %s Severity Anomaly Breach #%d',
        CASE WHEN z > 4 THEN 'CRITICAL' WHEN z > 3 THEN 'HIGH' ELSE 'MEDIUM' END, bin) AS title,
      printf('ZSCORE detection triggered at %d events/sec. Z-Score=%.2f, iForest=0.000, EWMA=0.00, Hybrid=0.000.',
        c, z) AS summary
    FROM zs WHERE z > 2 AND c > 5""",
)
def _(t):
    out = detect.breaches(t.sig(), W, B, threshold=2.0)
    method, none = F.lit("ZSCORE"), F.lit(None)
    return out.select(
        "org", "bin",
        detect.detection_title(F.col("bin"), method, F.col("severity")).alias("title"),
        detect.detection_summary(F.col("c"), F.col("z"), none, none, none, method).alias("summary"),
    )
