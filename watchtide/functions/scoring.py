"""Risk, evidence and confidence scores as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _points(test: Column, points: float) -> Column:
    return F.when(test, F.lit(float(points))).otherwise(F.lit(0.0))


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MEDIUM")
    ).otherwise("LOW")


def risk_score_v2(
    z: Column, rate: Column, iforest: Column, hybrid: Column, known: Column, entropy: Column
) -> Column:
    """Composite risk out of 100, halves rounded up."""
    raw = (
        F.least(z * 8, F.lit(30.0))
        + F.least(rate * 1.5, F.lit(20.0))
        + F.least(iforest * 25, F.lit(20.0))
        + F.least(hybrid * 15, F.lit(15.0))
        + _points(known, 10)
        + _points(entropy > 1.5, 5)
        + _points(rate > 20, 10)
    )
    return F.least(F.floor(raw + 0.5), F.lit(100)).cast("long")


def risk_score_v1(z: Column, rate: Column, known: Column) -> Column:
    """The older risk formula, halves rounded to the even number."""
    raw = (
        F.least(z * 10, F.lit(40.0))
        + F.least(rate * 2.0, F.lit(30.0))
        + _points(known, 15)
        + _points(rate > 20, 15)
    )
    return F.least(F.rint(raw), F.lit(100.0)).cast("long")


def half_up(value: Column, digits: int = 2) -> Column:
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


# Minutes a case may stay open by severity.
SLA_MINUTES = {"CRITICAL": 60, "HIGH": 240, "MEDIUM": 1440, "LOW": 10080}
CLOSED = ("resolved", "closed")


def sla_deadline(created_sec: Column, severity: Column) -> Column:
    minutes = F.create_map(*[F.lit(x) for pair in SLA_MINUTES.items() for x in pair])
    return created_sec + minutes[severity] * 60


def sla_breached(deadline: Column, status: Column, now: Column) -> Column:
    return (now > deadline) & ~status.isin(*CLOSED)


# Confidence tiers of an answer.
TIER_HIGH, TIER_MODERATE = 0.8, 0.5


def confidence_tier(score: Column) -> Column:
    return F.when(score >= TIER_HIGH, "high").when(score >= TIER_MODERATE, "moderate").otherwise("low")
