"""Indicators: validity of single values and claims found in texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.functions.text import ascii_words, strip

# Address ranges that are not looked up.
PRIVATE_PREFIXES = ("127.", "10.", "192.168.", "172.16.")
UNSPECIFIED = "0.0.0.0"
IPV4 = r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"
IPV6 = r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$"
DOMAIN = r"^[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
HASH = r"^[a-fA-F0-9]{32,64}$"
HASH_LENGTHS = (32, 40, 64)


def valid_indicator(kind: Column, value: Column) -> Column:
    """Whether a value is a public address, a public domain or a file hash of its kind."""
    v = strip(value)
    low = F.lower(v)
    octets = F.forall(
        F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int").between(0, 255), F.lit(False))
    )
    private = F.lit(False)
    for prefix in PRIVATE_PREFIXES:
        private = private | F.startswith(v, F.lit(prefix))
    ip = ((v.rlike(IPV4) & octets) | v.rlike(IPV6)) & ~private & (v != UNSPECIFIED)
    domain = (
        v.rlike(DOMAIN)
        & ~F.contains(low, F.lit("localhost"))
        & ~F.endswith(low, F.lit(".local"))
        & ~F.endswith(low, F.lit(".internal"))
    )
    digest = v.rlike(HASH) & F.length(v).isin(*HASH_LENGTHS)
    return (
        F.when(kind == "ip", ip).when(kind == "domain", domain).when(kind == "hash", digest)
    ).otherwise(F.lit(False))


# Patterns of the claims a text can make.
CVE = r"(?i)CVE-\d{4}-\d{4,7}"
CVE_VALID = r"^CVE-\d{4}-\d{4,7}$"
TECHNIQUE = r"T\d{4}(?:\.\d{3})?"
TEXT_IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
TEXT_DOMAIN = (
    r"(?i)\b(?:[a-zA-Z0-9-]+\.)+(?:com|net|org|io|ru|cn|in|co|gov|edu|xyz|top|biz)\b"
)
TEXT_HASH = r"\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b"
ACTOR = (
    r"(?i)\b(APT\d{1,3}|Lazarus\s+Group|Cozy\s+Bear|Fancy\s+Bear|Sandworm|Carbanak|FIN\d|TA\d{3,4})\b"
)
CONFIDENCE = r"(?i)\b(\d{1,3}(?:\.\d+)?)\s*%\s*confidence\b"
SEVERITY = r"(?i)\b(low|medium|high|critical)\s+severity\b"
# What each kind of claim weighs.
WEIGHTS = {
    "cve_id": 0.8,
    "mitre_technique": 0.6,
    "ioc_ip": 1.0,
    "ioc_domain": 1.0,
    "ioc_hash": 1.0,
    "threat_actor": 0.7,
    "confidence_claim": 0.5,
    "severity_claim": 0.5,
}
# Addresses that need no verification in a text.
TEXT_PRIVATE = r"^(?:10\.|192\.168\.|172\.16\.|172\.17\.|127\.)|^0\.0\.0\.0$"


def _found(
    text: Column, pattern: str, kind: str, lower: bool = False, only_if: Column | None = None
) -> Column:
    """Every match as a claim; ``only_if`` is a cheap test no matching text can fail."""
    hits = F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(0))
    if only_if is not None:
        hits = F.when(only_if, hits).otherwise(F.array().cast("array<string>"))
    return F.transform(
        hits,
        lambda v: F.struct(F.lit(kind).alias("type"), (F.lower(v) if lower else v).alias("value")),
    )


def claims(text: Column, kinds: Iterable[str] = WEIGHTS) -> Column:
    """Array of (type, value) for every claim of the given kinds, repeats included."""
    low = F.lower(text)

    def word(w: str) -> Column:
        return F.contains(low, F.lit(w))

    public = F.filter(
        _found(text, TEXT_IPV4, "ioc_ip", only_if=text.rlike(r"\d\.\d")),
        lambda c: ~c["value"].rlike(TEXT_PRIVATE),
    )
    found = {
        "cve_id": _found(text, CVE, "cve_id", only_if=word("cve-")),
        "mitre_technique": _found(text, TECHNIQUE, "mitre_technique"),
        "ioc_ip": public,
        "ioc_domain": _found(
            text, TEXT_DOMAIN, "ioc_domain", lower=True, only_if=text.rlike(r"\.[A-Za-z]")
        ),
        "ioc_hash": _found(
            text, TEXT_HASH, "ioc_hash", lower=True, only_if=text.rlike("[a-fA-F0-9]{32}")
        ),
        "threat_actor": _found(text, ACTOR, "threat_actor"),
        "confidence_claim": _found(
            text, CONFIDENCE, "confidence_claim", only_if=word("confidence")
        ),
        "severity_claim": _found(text, SEVERITY, "severity_claim", only_if=word("severity")),
    }
    return F.concat(*[found[k] for k in WEIGHTS if k in set(kinds)])


def extract_claims(
    df: DataFrame, text: str, *keep: str, kinds: Iterable[str] = WEIGHTS
) -> DataFrame:
    """One row per claim; texts without claims give no row."""
    return df.select(*keep, F.inline(claims(F.col(text), kinds)))
