"""Personal data: patterns propose, check sums confirm, words nearby move the score.

Spans are code points, end exclusive. A pattern's matches and the text between them give the
positions: a match begins after the lengths of all that comes before it. Patterns are
written so that a match never backtracks over a long run.

Kinds of the base: email, ip, card, phone. The method adds iban (mod-97) and number (7 to 12
digits with a word such as "call" or "tel" before them). Every span has a score: 0.6 from the
pattern, 0.3 more when a check sum confirms it, 0.2 more for a context word among the 40
characters before. Base spans always stay; added ones need a score of 0.8.

Defined cases: null text counts as empty and has no spans; every occurrence counts, repeated
ones too; rows are independent, so repeated ids are repeated rows; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")

# Fixed values: (kind, pattern, characters a text must have for a match).
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = (
    ("email", f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@"),
    ("ip", "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", "."),
    ("card", "[0-9](?:[\\x20-]?[0-9])++", ""),
    ("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "+"),
    ("iban", "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ""),
    ("number", "(?<![0-9+().-])[0-9](?:[\\x20.-]?[0-9]){6,11}(?![0-9])", ""),
)
CONTEXT = {
    "iban": "(?i)iban|account|bank|konto|compte|cuenta",
    "number": "(?i)call|phone|tel|mobile|fax|appel|anruf|llam",
}
BEFORE = 40
BASIC, CHECKED, NEARBY, ENOUGH = 0.6, 0.3, 0.2, 0.8


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Structs (start, end, value) of a pattern's leftmost matches that do not overlap, where confirmed."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + z["gap"]
        end = start + F.length(z["value"])
        span = F.struct(start.alias("start"), end.alias("end"), z["value"].alias("value"))
        # Only what is confirmed is added: a text full of numbers stays linear.
        out = F.when(_confirmed(kind, z["value"]), F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), values.alias("value")), lambda z: z["value"].isNotNull())
    return F.aggregate(pairs, zero, step)["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """True when the digits of ``value`` pass the Luhn check."""
    digits = F.split(F.reverse(_digits(value)), "")

    def add(total: Column, x: Column) -> Column:
        n = x["d"].cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return total + F.when(x["i"] % 2 == 1, twice).otherwise(n)

    numbered = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """True when an account number passes the mod-97 check."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return F.when(n > 9, (rest * 100 + n) % 97).otherwise((rest * 10 + n) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1


def _confirmed(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    if kind == "ip":
        return F.forall(
            F.split(value, "\\."),
            # A part may have any number of digits: null, not an error, beyond an int.
            lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)),
        )
    if kind == "card":
        return size.between(16, 19) & luhn(value)
    if kind == "phone":
        return size.between(8, 15)
    return mod97(value) if kind == "iban" else F.lit(True)


def _spans(kind: str, text: Column, pattern: str, needs: str) -> Column:
    maybe = F.contains(text, F.lit(needs)) if needs else text.rlike(pattern)
    found = _found(text, pattern, kind)
    checked = kind in ("ip", "card", "iban")

    def scored(s: Column) -> Column:
        score = F.lit(BASIC + CHECKED * checked)
        if kind in CONTEXT:
            start = F.greatest(s["start"] - BEFORE, F.lit(0))
            near = F.substr(text, start + 1, s["start"] - start).rlike(CONTEXT[kind])
            score = score + F.when(near, NEARBY).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    spans = F.transform(found, scored)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= ENOUGH)
    return F.when(maybe, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and an array column per kind of (kind, start, end, score), in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", *[_spans(k, F.col("text"), p, needs).alias(k) for k, p, needs in PATTERNS])


def joined(*kinds: str) -> Column:
    """kind:start:end by kind as listed, comma-joined."""
    every = F.concat(*[F.col(k) for k in kinds])
    return F.array_join(
        F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
