"""Evidence bundles: assembly, completeness, confidence and claims checked against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions import indicators
from watchtide.functions.scoring import half_up
from watchtide.functions.text import ascii_words, fixed, has

# Confidence needed, points of each kind of evidence, decay and tiers.
MIN_CONFIDENCE = 0.3
POINTS = {
    "matched_rules": 0.3,
    "threat_fusion": 0.2,
    "threat_intelligence": 0.15,
    "asset_context": 0.1,
    "behavior_context": 0.1,
    "mitre_mappings": 0.1,
}
STRONG_HYBRID, STRONG_POINTS = 0.7, 0.05
DECAY_START_MS, DECAY_END_MS, MAX_DECAY = 5 * 60_000, 30 * 60_000, 0.25
TIERS = ((0.8, "HIGH"), (0.5, "MEDIUM"))
LISTS = ("matched_rules", "threat_intelligence", "mitre_mappings")

# Notes on what is missing.
WARNINGS = {
    "threat_fusion": "threat_fusion unavailable — limited threat context",
    "threat_intelligence": "threat_intelligence empty — no external IOC correlation",
    "asset_context": "asset_context unavailable — cannot assess impact",
    "behavior_context": "behavior_context unavailable — no baseline comparison",
    "mitre_mappings": "mitre_mappings empty — technique unknown",
}
LIMITATIONS = {
    "threat_fusion": "Threat Fusion: unavailable",
    "threat_intelligence": "Threat Intelligence: no external IOC correlation",
    "asset_context": "Asset Context: unavailable — impact scope unknown",
    "behavior_context": "Behavior Context: unavailable — no baseline comparison",
    "mitre_mappings": "MITRE Mapping: technique unknown",
}


def present(part: str) -> Column:
    """Whether a bundle has a part: a non-empty list or a value that is not null."""
    if part in LISTS:
        return F.coalesce(F.size(part) > 0, F.lit(False))
    return F.col(part).isNotNull()


def assemble_evidence(
    anomalies: DataFrame,
    rules: DataFrame,
    intelligence: DataFrame,
    assets: DataFrame,
    behaviour: DataFrame,
    mappings: DataFrame,
    key: str = "anomaly_id",
) -> DataFrame:
    """One nested bundle per anomaly; parts nobody delivered are null or empty.

    The lists hold distinct small records (rules, indicators, techniques), so a list is
    bounded by the rule and indicator lists, not by the events behind it.
    """

    def listed(df: DataFrame, name: str) -> DataFrame:
        cols = sorted(c for c in df.columns if c != key)
        return df.groupBy(key).agg(F.sort_array(F.collect_set(F.struct(*cols))).alias(name))

    def single(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c != key]
        return df.select(key, F.struct(*cols).alias(name))

    out = anomalies
    for df, name in ((rules, "matched_rules"), (intelligence, "threat_intelligence"), (mappings, "mitre_mappings")):
        out = out.join(listed(df, name), key, "left")
    for df, name in ((assets, "asset_context"), (behaviour, "behavior_context")):
        out = out.join(single(df, name), key, "left")
    return out


def evidence_completeness(df: DataFrame) -> DataFrame:
    """Missing and warning lists, completeness share and validity of each bundle."""

    def bad_number(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(c)

    def absent(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    missing = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.col(c) <= 0, F.lit(True)), F.lit(c))
                for c in ("anomaly_id", "tenant_id", "detection_timestamp")
            ],
            F.when(absent("detection_method"), "detection_method"),
            F.when(bad_number("hybrid_score"), "hybrid_score"),
            F.when(bad_number("confidence"), "confidence"),
            F.when(absent("severity"), "severity"),
            F.when(
                F.col("confidence") < MIN_CONFIDENCE,
                F.format_string(
                    f"confidence_below_threshold (%s < {MIN_CONFIDENCE})",
                    fixed(F.col("confidence"), 2),
                ),
            ),
            F.when(~present("matched_rules"), "matched_rules (at least 1 required)"),
            F.when(F.col("explainability_summary").isNull(), "explainability_summary"),
        )
    )

    def outside(c: str) -> Column:
        return F.when(
            (F.col(c) < 0) | (F.col(c) > 1),
            F.concat(F.lit(f"{c} out of range: "), F.col(c).cast("string")),
        )

    warnings = F.array_compact(
        F.array(
            *[F.when(~present(p), F.lit(m)) for p, m in WARNINGS.items()],
            outside("hybrid_score"),
            outside("confidence"),
        )
    )
    parts = [*POINTS, "explainability_summary"]
    share = sum((present(p).cast("int") for p in parts), F.lit(0)) / len(parts)
    return df.withColumns(
        {"missing_fields": missing, "warning_fields": warnings, "completeness": share}
    ).withColumn("valid", F.size("missing_fields") == 0)


def evidence_confidence() -> Column:
    total = F.lit(0.0)
    for part, points in POINTS.items():
        total = total + F.when(present(part), points).otherwise(0.0)
    strong = F.when(F.col("hybrid_score") > STRONG_HYBRID, STRONG_POINTS).otherwise(0.0)
    return F.least(total + strong, F.lit(1.0))


def decay(age_ms: Column) -> Column:
    """Linear loss of confidence between five and thirty minutes."""
    window = DECAY_END_MS - DECAY_START_MS
    elapsed = F.greatest(F.least(age_ms - DECAY_START_MS, F.lit(window)), F.lit(0))
    return elapsed / window * MAX_DECAY


def confidence_gate(df: DataFrame, age_ms: Column) -> DataFrame:
    """Raw and decayed score, tier, whether an explanation is allowed, and limitations."""
    out = df.withColumns({"raw_score": evidence_confidence(), "decay_applied": decay(age_ms)})
    out = out.withColumn(
        "gate_score", F.greatest(F.col("raw_score") - F.col("decay_applied"), F.lit(0.0))
    )
    level = F
    for floor, name in TIERS:
        level = level.when(F.col("gate_score") >= floor, name)
    notes = F.array_compact(F.array(*[F.when(~present(p), F.lit(m)) for p, m in LIMITATIONS.items()]))
    return out.withColumns({"gate_level": level.otherwise("LOW"), "limitations": notes}).withColumn(
        "allow", F.col("gate_level") != "LOW"
    )


# Truth score tiers and tolerance of a confidence claim in points.
BADGES = ((0.95, "HIGH"), (0.85, "MEDIUM"), (0.70, "LOW"))
TRUTH_FLOOR = 0.70
CONFIDENCE_TOLERANCE = 5


def checked_claims(
    answers: DataFrame,
    evidence: DataFrame,
    key: str,
    text: str = "text",
    scope: str | None = None,
) -> DataFrame:
    """Every claim of an answer with its weight and whether the evidence holds it.

    Evidence rows are (type, value), optionally per ``scope`` column shared with the
    answers. Answers carry ``confidence`` (share) and ``severity``. An answer without
    claims keeps one row with a null type.
    """
    extra = [scope] if scope else []
    rows = answers.select(
        key,
        *extra,
        "confidence",
        "severity",
        F.explode_outer(indicators.claims(F.col(text))).alias("c"),
    ).select(key, *extra, "confidence", "severity", "c.type", "c.value")
    rows = rows.groupBy(key, *extra, "confidence", "severity", "type", "value").agg(
        F.count("type").alias("times")
    )
    lookup = F.when(F.col("type") == "threat_actor", F.lower("value")).otherwise(F.col("value"))
    known = (
        evidence.select(*extra, F.col("type"), F.col("value").alias("_known"))
        .distinct()
        .withColumn("_in", F.lit(True))
    )
    rows = rows.withColumn("_known", lookup).join(known, [*extra, "type", "_known"], "left")
    held = F.coalesce("_in", F.lit(False))
    kind = F.col("type")
    stated = F.regexp_extract("value", r"(\d{1,3}(?:\.\d+)?)", 1).try_cast("double")
    verified = (
        F.when(kind == "cve_id", held & F.col("value").rlike(indicators.CVE_VALID))
        .when(kind == "confidence_claim", stated <= F.col("confidence") * 100 + CONFIDENCE_TOLERANCE)
        .when(
            kind == "severity_claim",
            F.lower(F.regexp_extract("value", r"^(\w+)", 1)) == F.lower("severity"),
        )
        .otherwise(held)
    )
    weights = F.create_map(*[F.lit(x) for pair in indicators.WEIGHTS.items() for x in pair])
    return rows.withColumns({"verified": verified, "weight": weights[kind] * F.col("times")}).drop(
        "_known", "_in"
    )


def truth_score(claims: DataFrame, key: str) -> DataFrame:
    """Verified share of claim weight, badge and fallback per answer; no claims score 1."""
    real = F.col("type").isNotNull()
    n = F.sum("times")
    good = F.sum(F.when(F.col("verified"), F.col("times")).otherwise(0))
    out = claims.groupBy(key).agg(
        n.alias("total_claims"),
        good.alias("verified_claims"),
        F.coalesce(
            F.sum(F.when(F.col("verified"), F.col("weight")).otherwise(F.when(real, 0.0)))
            / F.sum(F.when(real, F.col("weight"))),
            F.lit(1.0),
        ).alias("truth_score"),
    )
    badge = F
    for floor, name in BADGES:
        badge = badge.when(F.col("truth_score") >= floor, name)
    fallback = (F.col("truth_score") < TRUTH_FLOOR) | (
        F.col("verified_claims") < F.col("total_claims")
    )
    return out.withColumns({"badge": badge.otherwise("REJECTED"), "safe_fallback": fallback})


# Weights of the answer metrics and patterns they look for.
METRIC_WEIGHTS = {
    "citation_quality": 0.20,
    "hallucination_score": 0.25,
    "consistency_score": 0.15,
    "accuracy_score": 0.25,
    "retrieval_score": 0.15,
}
CITING_WORDS = ("according to", "based on", "retrieved from", "evidence")
ABSOLUTE_WORDS = r"(?i)\bdefinitely\b|\bcertainly\b|\bguaranteed\b|\b100%\b|\balways\b|\bnever\b"
NUMBERS = r"(?i)\b\d{2,}(%|percent|times|cases|incidents)\b"
CONTRADICTIONS = (
    (r"\b(is|are)\s+safe\b", r"\b(is|are)\s+dangerous\b"),
    (r"\bno\s+(risk|threat|issue)\b", r"\b(high|critical)\s+(risk|threat)\b"),
)
NOTES = (
    ("citation_quality", "<", 0.5, "Low citation quality — response may not reference sources adequately"),
    ("hallucination_score", ">", 0.3, "Hallucination risk detected — claims may not be supported by evidence"),
    ("consistency_score", "<", 0.7, "Response consistency issues detected"),
    ("accuracy_score", "<", 0.5, "Accuracy concerns — low confidence or poor source matching"),
    ("retrieval_score", "<", 0.4, "Retrieval effectiveness is low — consider improving knowledge base"),
)
ALL_FINE = "All evaluation metrics within acceptable ranges"


def _clamp(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(ascii_words(pattern)))


def evaluate_response(
    df: DataFrame,
    response: str = "response",
    sources: str = "sources",
    confidence: str = "confidence",
    sufficient: str = "evidence_sufficient",
) -> DataFrame:
    """Five metrics, their weighted sum and notes for each answer, rounded to two places.

    ``sources`` is an array of structs with source, filename, score and collection.
    """
    a, c, src = F.col(response), F.col(confidence), F.col(sources)
    low = F.lower(a)
    n = F.size(src)
    general = F.contains(a, F.lit("[Source")) | F.contains(a, F.lit("Source "))
    for word in CITING_WORDS:
        general = general | F.contains(low, F.lit(word))

    def name(s: Column) -> Column:
        return F.lower(
            F.coalesce(
                F.nullif(s["filename"], F.lit("")), F.nullif(s["source"], F.lit("")), F.lit("")
            )
        )

    cited = F.size(F.filter(src, lambda s: general | F.contains(low, name(s))))
    citation = F.when(n == 0, 0.0).otherwise(F.least(cited / F.greatest(n, F.lit(1)), F.lit(1.0)))

    hallucination = F.least(
        F.when(~F.col(sufficient) & (n == 0), 0.5).otherwise(0.0)
        + F.when(c < 0.5, 0.3).otherwise(0.0)
        + F.when((_matches(a, ABSOLUTE_WORDS) > 2) & (n < 2), 0.2).otherwise(0.0)
        + F.when((_matches(a, NUMBERS) > 3) & (n == 0), 0.3).otherwise(0.0),
        F.lit(1.0),
    )

    words = F.size(F.split(a, r"\s+"))
    consistency = F.lit(1.0)
    for one, other in CONTRADICTIONS:
        consistency = consistency - F.when(has(a, one) & has(a, other), 0.3).otherwise(0.0)
    consistency = consistency - F.when(words < 10, 0.2).otherwise(0.0)
    consistency = consistency - F.when(words > 2000, 0.1).otherwise(0.0)
    listed = F.contains(a, F.lit("\n")) | F.contains(a, F.lit("-")) | F.contains(a, F.lit("•"))
    consistency = _clamp(consistency + F.when(listed, 0.1).otherwise(0.0))

    scores = F.transform(src, lambda s: s["score"])
    mean = F.when(n > 0, F.aggregate(scores, F.lit(0.0), lambda x, y: x + y) / n).otherwise(0.0)
    accuracy = F.lit(0.5) + mean * 0.3 + c * 0.2
    accuracy = _clamp(F.when(F.contains(a, F.lit("insufficient evidence")), 0.6).otherwise(accuracy))

    kinds = F.size(F.array_distinct(F.transform(src, lambda s: F.coalesce(s["collection"], F.lit("unknown")))))
    top = F.coalesce(F.array_max(scores), F.lit(0.0))
    retrieval = F.when(n == 0, 0.0).otherwise(
        F.least(mean * 0.5 + F.least(kinds * 0.05, F.lit(0.2)) + top * 0.3, F.lit(1.0))
    )

    out = df.withColumns(
        {
            "citation_quality": citation,
            "hallucination_score": hallucination,
            "consistency_score": consistency,
            "accuracy_score": accuracy,
            "retrieval_score": retrieval,
        }
    )
    overall = F.lit(0.0)
    for metric, weight in METRIC_WEIGHTS.items():
        value = 1 - F.col(metric) if metric == "hallucination_score" else F.col(metric)
        overall = overall + value * weight
    notes = F.concat_ws(
        ". ",
        *[
            F.when(F.col(m) < limit if op == "<" else F.col(m) > limit, F.lit(text))
            for m, op, limit, text in NOTES
        ],
    )
    out = out.withColumns(
        {
            "overall_score": overall,
            "evaluator_notes": F.coalesce(F.nullif(notes, F.lit("")), F.lit(ALL_FINE)),
        }
    )
    return out.withColumns({m: half_up(F.col(m)) for m in [*METRIC_WEIGHTS, "overall_score"]})
