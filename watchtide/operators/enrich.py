"""Indicators of compromise, assets and technique mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IOC_TYPES = ("ip", "domain", "hash")
IOC_SEVERITY = "MEDIUM"
IOC_DESCRIPTION = "Ingested indicator"
IOC_COLUMNS = ("type", "value", "source", "severity", "description", "first_seen", "last_seen")


def ioc_upsert(store: DataFrame, batch: DataFrame, now: Column, seq: str = "seq") -> DataFrame:
    """Merge a batch into the store: first_seen stays, last_seen is now, the rest is replaced."""
    attrs = F.struct("source", "severity", "description")
    old = store.select("type", "value", attrs.alias("a"), "first_seen", "last_seen", F.lit(-1).cast("long").alias("_q"))
    new = batch.select(
        "type",
        "value",
        attrs.alias("a"),
        F.lit(None).cast("long").alias("first_seen"),
        now.cast("long").alias("last_seen"),
        F.col(seq).cast("long").alias("_q"),
    )
    merged = old.unionByName(new).groupBy("type", "value").agg(
        F.max_by("a", "_q").alias("a"),
        F.coalesce(F.min("first_seen"), F.max("last_seen")).alias("first_seen"),
        F.max_by("last_seen", "_q").alias("last_seen"),
    )
    return merged.select(
        "type", "value", "a.source", "a.severity", "a.description", "first_seen", "last_seen"
    )


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def parse_ioc_csv(lines: DataFrame, column: str = "line") -> DataFrame:
    """value,type[,source,severity,description] per line; unknown types are skipped.

    Fields split at every comma, quotes have no meaning.
    """
    parts = F.transform(F.split(column, ","), lambda p: F.trim(p))
    rows = lines.filter(F.trim(column) != "").withColumn("_p", parts)

    def field(i: int) -> Column:
        return F.get("_p", F.lit(i))

    return rows.filter((F.size("_p") >= 2) & field(1).isin(*IOC_TYPES)).select(
        *[c for c in lines.columns if c != column],
        field(0).alias("value"),
        field(1).alias("type"),
        _or(field(2), "raw_csv_feed").alias("source"),
        _or(field(3), IOC_SEVERITY).alias("severity"),
        _or(field(4), IOC_DESCRIPTION).alias("description"),
    )


def parse_ioc_json(lines: DataFrame, column: str = "line") -> DataFrame:
    """One JSON object per line with value and type; other lines are skipped."""
    schema = "value string, type string, source string, severity string, description string"
    rows = lines.withColumn("_o", F.from_json(column, schema))
    known = (F.col("_o.value") != "") & (F.col("_o.type") != "")
    return rows.filter(known).select(
        *[c for c in lines.columns if c != column],
        "_o.value",
        "_o.type",
        _or(F.col("_o.source"), "raw_json_feed").alias("source"),
        _or(F.col("_o.severity"), IOC_SEVERITY).alias("severity"),
        _or(F.col("_o.description"), IOC_DESCRIPTION).alias("description"),
    )


def ioc_match(indicators: DataFrame, iocs: DataFrame) -> DataFrame:
    """Indicators found in the list, each with the list's attributes and confidence 1."""
    known = iocs.select(
        "type",
        "value",
        F.col("severity").alias("ioc_severity"),
        F.col("source").alias("ioc_source"),
        F.col("description").alias("ioc_description"),
        F.lit(1.0).alias("ioc_confidence"),
    )
    return indicators.join(known, ["type", "value"])


def ioc_filter(indicators: DataFrame, iocs: DataFrame) -> DataFrame:
    """Only the indicators found in the list."""
    return indicators.join(iocs.select("type", "value"), ["type", "value"], "left_semi")


def ioc_inventory(store: DataFrame) -> DataFrame:
    """Indicators in total and by type, one row."""
    return store.agg(
        F.count(F.lit(1)).alias("total_indicators"),
        *[F.count_if(F.col("type") == t).alias(t) for t in IOC_TYPES],
    )


# The built-in assets and the profile of unknown hosts.
ASSETS = (
    ("DC-01.internal", "CRITICAL", "Infrastructure", "Domain Controller", False, True),
    ("web-prod-01.public", "HIGH", "eCommerce", "Web Application Server", True, False),
)
ASSET_SCHEMA = (
    "host string, criticality string, business_unit string, role string, "
    "is_public boolean, is_sensitive boolean"
)
UNKNOWN_ASSET = {
    "criticality": "MEDIUM",
    "business_unit": "General",
    "role": "Generic Workstation",
    "is_public": False,
    "is_sensitive": False,
}


def default_assets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASSETS, ASSET_SCHEMA)


def risk_multiplier() -> Column:
    return (
        F.lit(1.0)
        + F.when(F.col("criticality") == "CRITICAL", 1.0)
        .when(F.col("criticality") == "HIGH", 0.5)
        .otherwise(0.0)
        + F.when(F.col("is_public"), 0.5).otherwise(0.0)
        + F.when(F.col("is_sensitive"), 0.5).otherwise(0.0)
    )


def asset_enrich(events: DataFrame, assets: DataFrame, host: str = "source") -> DataFrame:
    """Add the host's asset profile and risk multiplier; hosts compare without case."""
    profile = assets.select(F.lower("host").alias("_host"), *UNKNOWN_ASSET)
    out = events.withColumn("_host", F.lower(host)).join(profile, "_host", "left").drop("_host")
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in UNKNOWN_ASSET.items()})
    return out.withColumn("risk_multiplier", risk_multiplier())


# Tactics.
TACTICS = (
    ("TA0001", "Initial Access"),
    ("TA0002", "Execution"),
    ("TA0003", "Persistence"),
    ("TA0004", "Privilege Escalation"),
    ("TA0005", "Defense Evasion"),
    ("TA0006", "Credential Access"),
    ("TA0007", "Discovery"),
    ("TA0008", "Lateral Movement"),
    ("TA0009", "Collection"),
    ("TA0010", "Exfiltration"),
    ("TA0011", "Command and Control"),
    ("TA0040", "Impact"),
)
# Techniques with their tactic and sub-techniques.
TECHNIQUES = (
    (
        "T1110",
        "Brute Force",
        "credential-access",
        ("T1110.001", "T1110.002", "T1110.003", "T1110.004"),
    ),
    ("T1498", "Network Denial of Service", "impact", ("T1498.001", "T1498.002")),
    ("T1041", "Exfiltration Over C2 Channel", "exfiltration", ()),
    (
        "T1078",
        "Valid Accounts",
        "persistence",
        ("T1078.001", "T1078.002", "T1078.003", "T1078.004"),
    ),
    ("T1059", "Command and Scripting Interpreter", "execution", ()),
    ("T1566", "Phishing", "initial-access", ("T1566.001", "T1566.002", "T1566.003")),
    ("T1021", "Remote Services", "lateral-movement", ()),
    ("T1055", "Process Injection", "defense-evasion", ()),
    ("T1071", "Application Layer Protocol", "command-and-control", ()),
    ("T1486", "Data Encrypted for Impact", "impact", ()),
)
# Words of an anomaly text with the techniques and tactics they point to.
TECHNIQUE_WORDS = (
    (
        ("brute_force", "brute force", "failed_login", "authentication"),
        ("T1110",),
        ("TA0006",),
        "Repeated authentication failures suggest brute force attack",
    ),
    (
        ("ddos", "denial_of_service", "traffic_spike", "flood"),
        ("T1498",),
        ("TA0040",),
        "Traffic volume spike suggests DDoS attack",
    ),
    (
        ("exfiltration", "data_transfer", "outbound", "exfil"),
        ("T1041",),
        ("TA0010",),
        "Unusual outbound data transfers suggest data exfiltration",
    ),
    (
        ("insider", "privileged", "insider_threat", "unauthorized_access"),
        ("T1078",),
        ("TA0003",),
        "Privileged account abuse suggests insider threat",
    ),
    (
        ("malware", "ransomware", "encrypted", "ransom"),
        ("T1486", "T1059"),
        ("TA0040", "TA0002"),
        "Potential malware or ransomware activity detected",
    ),
    (
        ("lateral", "lateral_movement", "remote_service"),
        ("T1021",),
        ("TA0008",),
        "Lateral movement indicators detected",
    ),
)
NO_MAPPING = "No specific MITRE ATT&CK mapping found"


def mitre_map(
    df: DataFrame, text: str, event_type: str | None = None, words=TECHNIQUE_WORDS
) -> DataFrame:
    """Techniques, tactics and description a text points to, by keywords."""
    parts = [F.col(text)] + ([F.coalesce(event_type, F.lit(""))] if event_type else [F.lit("")])
    joined = F.lower(F.concat_ws(" ", *parts))
    empty = F.array().cast("array<string>")

    def hit(patterns) -> Column:
        return joined.rlike("|".join(patterns))

    def ids(values) -> Column:
        return F.array(*[F.lit(v) for v in values])

    hits = [F.col("_hits")[i] for i in range(len(words))]
    techniques = [F.when(h, ids(t)).otherwise(empty) for h, (_, t, _, _) in zip(hits, words)]
    tactics = [F.when(h, ids(t)).otherwise(empty) for h, (_, _, t, _) in zip(hits, words)]
    notes = F.concat_ws("; ", *[F.when(h, F.lit(d)) for h, (_, _, _, d) in zip(hits, words)])
    out = df.withColumn("_hits", F.array(*[hit(p) for p, _, _, _ in words]))
    return out.withColumns(
        {
            "techniques": F.array_distinct(F.concat(*techniques)),
            "tactics": F.array_distinct(F.concat(*tactics)),
            "mapping_description": F.coalesce(F.nullif(notes, F.lit("")), F.lit(NO_MAPPING)),
        }
    ).drop("_hits")


def techniques_table(spark: SparkSession) -> DataFrame:
    rows = [(i, n, t, list(s)) for i, n, t, s in TECHNIQUES]
    return spark.createDataFrame(
        rows, "id string, name string, tactic string, subtechniques array<string>"
    )


def mitre_lookup(df: DataFrame, column: str, techniques: DataFrame) -> DataFrame:
    """Technique of an id, given directly or as a sub-technique."""
    ids = techniques.select(
        F.explode(F.concat(F.array("id"), "subtechniques")).alias(column),
        F.col("id").alias("technique_id"),
        F.col("name").alias("technique_name"),
        "tactic",
    )
    return df.join(ids, column, "left")


def tactic_key(tactic: Column) -> Column:
    """A tactic's name in any case and with blanks, as the table has it."""
    return F.regexp_replace(F.lower(tactic), r"\s+", "-")


def techniques_by_tactic(techniques: DataFrame, tactic: Column) -> DataFrame:
    """Techniques of a tactic given by name, in any case and with blanks."""
    return techniques.filter(F.col("tactic") == tactic_key(tactic))


def tactic_lookup(df: DataFrame, column: str, techniques: DataFrame) -> DataFrame:
    """Every technique of the tactic a row names; rows that name none stay without."""
    known = techniques.select(F.col("id").alias("technique_id"), F.col("name").alias("technique_name"), F.col("tactic").alias("_tactic"))
    return df.join(known, tactic_key(F.col(column)) == F.col("_tactic"), "left").drop("_tactic")
