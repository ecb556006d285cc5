"""Event rules and playbooks: literals and rule tables compiled to columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The built-in event rules.
SIGMA_RULES = (
    {
        "id": "sigma-01",
        "title": "Brute Force Authentication Failure",
        "level": "high",
        "tags": ["attack.credential_access", "attack.t1110"],
        "detection": {
            "selection": {"status": "failed", "event_type": "auth_attempt"},
            "condition": "selection",
        },
    },
    {
        "id": "sigma-02",
        "title": "Privileged Execution by Non-Admin",
        "level": "critical",
        "tags": ["attack.privilege_escalation", "attack.t1078"],
        "detection": {
            "selection": {"action": "privileged_action", "is_admin": False},
            "condition": "selection",
        },
    },
)


def _as_text(value) -> str:
    return str(value).lower()


def _criteria(block: Mapping, columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for field, wanted in block.items():
        if field not in columns:
            return F.lit(False)
        values = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        actual = F.lower(F.col(field).cast("string"))
        out = out & F.coalesce(actual.isin(*[_as_text(v) for v in values]), F.lit(False))
    return out


def sigma_condition(rule: Mapping, columns: Sequence[str]) -> Column:
    """One rule as a boolean column over a table with ``columns``."""
    detection = rule["detection"]
    condition = detection["condition"]
    blocks = {
        name: _criteria(block, columns)
        for name, block in detection.items()
        if name != "condition"
    }
    never = F.lit(False)
    if condition == "selection":
        return blocks.get("selection", never)
    if " and not " in condition:
        keep, drop = [part.strip() for part in condition.split(" and not ")][:2]
        return blocks.get(keep, never) & ~blocks.get(drop, never)
    return reduce(lambda a, b: a | b, blocks.values(), never)


def sigma_match(events: DataFrame, rules: Sequence[Mapping] = SIGMA_RULES) -> DataFrame:
    """One row per event and rule it matches; all rules run in one scan."""
    cases = [
        F.when(
            sigma_condition(rule, events.columns),
            F.struct(
                F.lit(rule["id"]).alias("rule_id"),
                F.lit(rule["title"]).alias("rule_title"),
                F.lit(rule["level"]).alias("rule_level"),
            ),
        )
        for rule in rules
    ]
    return events.select("*", F.inline(F.array_compact(F.array(*cases))))


# Actions a playbook may run, and those never run without a person.
DESTRUCTIVE_ACTIONS = ("block_ip", "disable_account", "delete_data")
KNOWN_ACTIONS = (
    "notify_email",
    "notify_webhook",
    "notify_slack",
    "notify_pagerduty",
    "create_incident",
    "tag_event",
    "escalate",
    "send_report",
)

PLAYBOOK_SCHEMA = (
    "id bigint, org bigint, name string, is_active boolean, trigger_mode string, "
    "triggers array<struct<condition:string,operator:string,value:string>>, "
    "actions array<string>, rate_limit_per_hour int"
)


def _trigger(t: Column) -> Column:
    """One trigger against the anomaly columns in the same row."""
    kind, wanted = t["condition"], t["value"]
    op = F.coalesce(t["operator"], F.lit("eq"))
    number = F.when(kind == "z_score", F.col("z_score")).when(
        kind == "hybrid_score", F.coalesce("hybrid_score", F.lit(0.0))
    )
    text = (
        F.when(kind == "severity", F.lower("severity"))
        .when(kind == "source", F.lower(F.coalesce("source", F.lit(""))))
        .when(kind == "event_type", F.lower(F.coalesce("event_type", F.lit(""))))
        .when(kind == "detection_method", F.upper(F.coalesce("detection_method", F.lit(""))))
    )
    shown = F.coalesce(text, number.cast("string"))
    value = F.coalesce(number, text.try_cast("double"))
    limit = wanted.try_cast("double")
    same = F.coalesce(text == wanted, number == limit)
    test = (
        F.when(op == "eq", same)
        .when(op == "neq", ~same)
        .when(op == "gte", value >= limit)
        .when(op == "lte", value <= limit)
        .when(op == "contains", F.contains(shown, F.lower(wanted)))
        .when(op == "regex", F.regexp_like(shown, F.concat(F.lit("(?i)"), wanted)))
    )
    return (kind == "always") | F.coalesce(test, F.lit(False))


def playbook_match(anomalies: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Active playbooks of an anomaly's organisation whose triggers hold.

    Joined on the organisation; Spark broadcasts the playbooks when they are small.
    """
    books = playbooks.filter("is_active").select(
        "org",
        F.col("id").alias("playbook_id"),
        F.col("name").alias("playbook_name"),
        "trigger_mode",
        "triggers",
        "actions",
    )
    some = F.size("triggers") > 0
    every = F.forall("triggers", _trigger)
    anyone = F.exists("triggers", _trigger)
    hit = some & F.when(F.col("trigger_mode") == "all", every).otherwise(anyone)
    return anomalies.join(books, "org").filter(hit).drop("triggers", "trigger_mode")


def playbook_route(df: DataFrame, actions: str = "actions") -> DataFrame:
    """Split actions into executed and skipped, with an error for each one not run."""
    todo = F.col(actions)
    blocked = F.filter(todo, lambda a: a.isin(*DESTRUCTIVE_ACTIONS))
    known = F.filter(todo, lambda a: a.isin(*KNOWN_ACTIONS))
    errors = F.transform(
        F.filter(todo, lambda a: ~a.isin(*KNOWN_ACTIONS)),
        lambda a: F.when(
            a.isin(*DESTRUCTIVE_ACTIONS),
            F.format_string(
                "GUARDRAIL BLOCKED: '%s' is a destructive action and cannot be automated. "
                "Requires explicit human authorization.",
                a,
            ),
        ).otherwise(F.concat(F.lit("Unknown action type: "), a)),
    )
    return df.withColumns(
        {"actions_executed": known, "actions_skipped": blocked, "errors": errors}
    )
