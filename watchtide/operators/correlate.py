"""Multi-stage correlation of signals by entity over a trailing window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchtide.operators import slices

MICROS = 1_000_000
CONFIDENCE = 0.95


@dataclass(frozen=True)
class Stage:
    pattern: str
    at_least: int = 1

    def matches(self) -> Column:
        return F.col("event_type").rlike(f"(?i){self.pattern}")


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    minutes: int
    entity: str
    stages: tuple[Stage, ...]

    def span(self, scale: int) -> int:
        return self.minutes * 60 * MICROS * scale


# The built-in attack patterns.
RULES = (
    Rule(
        "RULE_BRUTE_FORCE_SUCCESS",
        "Brute Force Followed by Successful Login (Account Compromise)",
        "CRITICAL",
        10,
        "source",
        (
            Stage("login_failed|auth_failure|failed_password", 3),
            Stage("login_success|auth_success|accepted_password", 1),
        ),
    ),
    Rule(
        "RULE_TAKEOVER_EXFILTRATION",
        "Successful Login Followed by Data Exfiltration",
        "CRITICAL",
        15,
        "user_name",
        (
            Stage("login_success|auth_success", 1),
            Stage("mass_download|data_export|exfiltration", 1),
        ),
    ),
    Rule(
        "RULE_PRIVILEGE_ESCALATION_CHAIN",
        "Privilege Escalation after Anonymous Session",
        "HIGH",
        5,
        "source",
        (
            Stage("login_success", 1),
            Stage("privilege_escalation|sudo_grant|admin_add", 1),
        ),
    ),
)


def _entity_rows(signals: DataFrame, entity: str) -> DataFrame:
    return signals.filter(F.col(entity).isNotNull() & (F.col(entity) != "")).withColumn(
        "entity_id", F.col(entity)
    )


def _incidents_of(
    signals: DataFrame, rules: Sequence[Rule], entity: str, scale: int, org: str, us: str, order: str
) -> DataFrame:
    """Incidents of the rules that group by one entity, from one pass over the signals."""
    keys = [org, "entity_id"]
    halo = 2 * max(r.span(scale) for r in rules)
    rows = _entity_rows(signals, entity).select(*keys, us, order, "event_type")
    copied = slices.with_halo(rows, us, halo)
    # A signal enters all windows at its time and leaves each rule's just after its span;
    # running counts over these marks cost the same however many signals a window holds.
    flags = {}
    for i, rule in enumerate(rules):
        for j, stage in enumerate(rule.stages):
            flags[f"_s{i}_{j}"] = (i, stage.matches())
        flags[f"_m{i}"] = (i, reduce(lambda a, b: a | b, [s.matches() for s in rule.stages]))
        flags[f"_n{i}"] = (i, F.lit(True))
    tests = copied.select(
        *keys,
        slices.SLICE,
        us,
        order,
        *[c.cast("long").alias(f"f{n}") for n, (_, c) in flags.items()],
    )
    ends = [
        F.struct((F.col(us) + F.lit(r.span(scale) + 1)).alias("_at"), F.lit(i).alias("_leaves"))
        for i, r in enumerate(rules)
    ]
    start = F.struct(F.col(us).alias("_at"), F.lit(-1).alias("_leaves"))
    marks = tests.select("*", F.inline(F.array(start, *ends)))
    part = [*keys, slices.SLICE]
    upto = Window.partitionBy(*part).orderBy("_at")
    later = Window.partitionBy(*part).orderBy(F.col("_at").desc()).rangeBetween(
        Window.unboundedPreceding, -1
    )
    found = {}
    for n, (i, _) in flags.items():
        sign = F.when(F.col("_leaves") == -1, 1).when(F.col("_leaves") == i, -1).otherwise(0)
        found[n] = F.sum(F.col(f"f{n}") * sign).over(upto)
    for i, rule in enumerate(rules):
        # The next signal to leave is the first one still inside.
        leave = F.when(F.col("_leaves") == i, F.col("_at"))
        found[f"_f{i}"] = F.min(leave).over(later) - F.lit(rule.span(scale) + 1)
    rows = marks.withColumns(found).filter("_leaves = -1").drop(
        "_at", "_leaves", *[f"f{n}" for n in flags]
    )
    hits = {
        f"_h{i}": reduce(
            lambda a, b: a & b,
            [F.col(f"_s{i}_{j}") >= s.at_least for j, s in enumerate(rule.stages)],
        )
        for i, rule in enumerate(rules)
    }
    rows = rows.withColumns(hits)
    before = Window.partitionBy(*keys, slices.SLICE).orderBy(us, order)
    gap = F.col(us) - F.lag(us).over(before)
    fresh = {}
    for i, rule in enumerate(rules):
        running = F.lag(f"_h{i}").over(before) & (gap <= rule.span(scale))
        fresh[f"_r{i}"] = F.col(f"_h{i}") & ~F.coalesce(running, F.lit(False))
    rows = slices.drop_halo(rows.withColumns(fresh), us, halo)
    cases = F.array(
        *[
            F.when(
                F.col(f"_r{i}"),
                F.struct(
                    F.lit(r.id).alias("rule_id"),
                    F.lit(r.name).alias("rule_name"),
                    F.lit(r.severity).alias("severity"),
                    F.col(f"_n{i}").alias("window_events"),
                    F.col(f"_m{i}").alias("matched_events"),
                    F.col(f"_f{i}").alias("first_seen"),
                    F.col(us).alias("last_seen"),
                    F.lit(r.span(scale)).cast("long").alias("span"),
                ),
            )
            for i, r in enumerate(rules)
        ]
    )
    return rows.select(
        *keys, F.col(order).alias("trigger_id"), F.inline(F.array_compact(cases))
    )


def correlate(
    signals: DataFrame,
    rules: Sequence[Rule] = RULES,
    scale: int = 1,
    org: str = "org",
    us: str = "us",
    order: str = "id",
) -> DataFrame:
    """One incident per run of signals whose trailing window satisfies every stage of a rule.

    Stages may come in any order. A run ends when a signal does not match or comes more
    than the window after the one before. ``scale`` stretches all rule windows.
    """
    by_entity: dict[str, list[Rule]] = {}
    for rule in rules:
        by_entity.setdefault(rule.entity, []).append(rule)
    parts = [
        _incidents_of(signals, group, entity, scale, org, us, order)
        for entity, group in by_entity.items()
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumns(
        {
            "title": F.concat(F.lit("Correlated Security Incident: "), "rule_name"),
            "summary": F.format_string(
                "Matched attack pattern '%s' for entity '%s' across %d correlated events.",
                "rule_name",
                "entity_id",
                "window_events",
            ),
            "confidence": F.lit(CONFIDENCE),
        }
    )


def correlation_evidence(
    signals: DataFrame,
    incidents: DataFrame,
    rules: Sequence[Rule] = RULES,
    scale: int = 1,
    org: str = "org",
    us: str = "us",
    order: str = "id",
) -> DataFrame:
    """The matched events of each incident, one row per event, however many there are."""
    parts = []
    for rule in rules:
        span = rule.span(scale)
        any_stage = reduce(lambda a, b: a | b, [s.matches() for s in rule.stages])
        events = (
            _entity_rows(signals, rule.entity)
            .filter(any_stage)
            .select(
                org,
                "entity_id",
                F.col(order).alias("event_id"),
                F.col(us).alias("_t"),
                slices.slice_of(F.col(us), span).alias("_b"),
            )
        )
        cover = F.sequence(
            slices.slice_of(F.col("last_seen") - F.lit(span), span),
            slices.slice_of(F.col("last_seen"), span),
        )
        mine = (
            incidents.filter(F.col("rule_id") == rule.id)
            .select(org, "entity_id", "rule_id", "trigger_id", "last_seen")
            .withColumn("_b", F.explode(cover))
        )
        parts.append(
            mine.join(events, [org, "entity_id", "_b"])
            .filter(F.col("_t").between(F.col("last_seen") - F.lit(span), F.col("last_seen")))
            .select(org, "rule_id", "entity_id", "trigger_id", "event_id")
        )
    return reduce(DataFrame.unionByName, parts)
