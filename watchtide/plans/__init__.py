"""All registered queries with their SQL twins."""

from watchtide.plans import detection, governance, logs, reports, retrieval, rules, streams  # noqa: F401
from watchtide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
