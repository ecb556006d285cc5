"""Content hashes and integrity stamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: evidence older than this many milliseconds is stale.
STALE_MS = 30 * 60 * 1000


def chunk_id(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def evidence_stamp(columns: Sequence[str]) -> Column:
    """Hash of the columns as JSON in name order, nested fields included."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def verify_stamp(
    same_identity: Column, current: Column, stamped: Column, age_ms: Column
) -> Column:
    """Why a stamped bundle is refused: identity, then hash, then age; null when it is valid."""
    minutes = F.floor(age_ms / 60_000 + 0.5).cast("long")
    return (
        F.when(
            ~same_identity, "Evidence bundle identity mismatch: anomaly_id or tenant_id changed."
        )
        .when(
            current != stamped,
            "Evidence bundle integrity violation: SHA-256 hash mismatch. Possible tampering detected.",
        )
        .when(
            age_ms > STALE_MS,
            F.format_string("Evidence bundle is stale (%d minutes old, max 30 minutes).", minutes),
        )
    )
