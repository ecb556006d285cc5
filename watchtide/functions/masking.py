"""Masking of personal data and secrets in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchtide.functions.text import ascii_words

# Patterns replaced by a label, in this order.
LABELS = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[IP]"),
    (r"(?i)\b(?:sk|pk|ak|key)[-_]?[A-Za-z0-9]{16,}\b", "[API_KEY]"),
    (r"""(?i)(?:password|passwd|secret|token)\s*[:=]\s*["']?[^\s"']+""", "[SECRET]"),
)
# E-mail and address patterns of the partial masks.
EMAIL = r"([a-zA-Z0-9_\-.]+)@([a-zA-Z0-9_\-.]+)\.([a-zA-Z]{2,5})"
IPV4 = r"\b(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}\b"
IPV6_HEAD = r"\b((?:[0-9a-fA-F]{1,4}:){2}[0-9a-fA-F]{1,4})"
IPV6_GROUP = r"(?::[0-9a-fA-F]{1,4})"


def _cheap_tests(text: Column) -> dict[str, Column]:
    """Tests that any text with a match passes; most texts fail them and are left alone."""

    def holds(*parts: str) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.contains(text, F.lit(p))
        return out

    return {
        "[SSN]": text.rlike(r"\d-\d{2}-\d"),
        "[EMAIL]": holds("@"),
        "[IP]": text.rlike(r"\d\.\d"),
        "[SECRET]": holds(":", "="),
    }


def mask_labels(text: Column) -> Column:
    # Labels bring none of the tested signs, so the tests hold for every step.
    tests, out = _cheap_tests(text), text
    for pattern, label in LABELS:
        masked = F.regexp_replace(out, ascii_words(pattern), label)
        out = F.when(tests[label], masked).otherwise(out) if label in tests else masked
    return out


def was_masked(text: Column, masked: Column) -> Column:
    return text != masked


def mask_partial(text: Column) -> Column:
    """``a***b@d***.ext`` (``a***@`` for one or two letters) and ``x.y.*.*``."""
    short = r"(?<![a-zA-Z0-9_\-.])([a-zA-Z0-9_\-.])[a-zA-Z0-9_\-.]?@([a-zA-Z0-9_\-.])[a-zA-Z0-9_\-.]*\.([a-zA-Z]{2,5})"
    long = r"([a-zA-Z0-9_\-.])[a-zA-Z0-9_\-.]+([a-zA-Z0-9_\-.])@([a-zA-Z0-9_\-.])[a-zA-Z0-9_\-.]*\.([a-zA-Z]{2,5})"
    text = F.coalesce(text, F.lit(""))
    tests = _cheap_tests(text)
    out = F.regexp_replace(text, short, "$1***@$2***.$3")
    out = F.regexp_replace(out, long, "$1***$2@$3***.$4")
    out = F.when(tests["[EMAIL]"], out).otherwise(text)
    return F.when(tests["[IP]"], F.regexp_replace(out, ascii_words(IPV4), "$1.$2.*.*")).otherwise(out)


def mask_alert(text: Column) -> Column:
    """``j***@dom.ext``, ``x.y.xxx.xxx`` and the first three groups of an IPv6 address."""
    text = F.coalesce(text, F.lit(""))
    tests = _cheap_tests(text)
    out = F.regexp_replace(
        text,
        r"([a-zA-Z0-9_\-.])[a-zA-Z0-9_\-.]*@([a-zA-Z0-9_\-.]+)\.([a-zA-Z]{2,5})",
        "$1***@$2.$3",
    )
    out = F.when(tests["[EMAIL]"], out).otherwise(text)
    out = F.when(
        tests["[IP]"], F.regexp_replace(out, ascii_words(IPV4), "$1.$2.xxx.xxx")
    ).otherwise(out)
    same = out
    # One pass per length, longest first: a replacement cannot repeat a mask per group.
    for hidden in range(5, 0, -1):
        address = ascii_words(IPV6_HEAD + f"{IPV6_GROUP}{{{hidden}}}" + r"\b")
        out = F.regexp_replace(out, address, "$1" + ":xxxx" * hidden)
    return F.when(text.rlike(r"[0-9a-fA-F]:[0-9a-fA-F]{1,4}:"), out).otherwise(same)


def mask_username(name: Column, alert: bool = False) -> Column:
    """First and last letter stay; names of one or two letters depend on the variant."""
    n = F.length(name)
    first, last = F.substring(name, 1, 1), F.substring(name, -1, 1)
    if alert:
        short = F.repeat(F.lit("*"), n)
    else:
        short = F.when(n <= 1, F.repeat(F.lit("*"), n)).otherwise(F.concat(first, F.lit("*")))
    return F.when(n <= 2, short).otherwise(
        F.concat(first, F.repeat(F.lit("*"), n - 2), last)
    )
