"""Quality rules: a threshold table compiled into one projection.

Every rule is (name, metric, low, high). Metrics are column expressions; ``compile_rules``
turns the table into one boolean. Nothing runs outside the JVM's expressions.

Defined cases: null text has no words and no lines; an empty text fails the base rule;
repeated words are found by 64-bit hashes of 8-word windows within one text; other columns
of the table are kept out; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchtide.llm.common import words

SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

# Frequent short words of the four languages.
STOP_WORDS = """
the of and to in is that for it was on are as with be at by this from or an have not
le la les de du des et un une en que qui dans pour est sur au par avec pas ce il
der die das und in zu den von mit ist ein eine auf im nicht des sich dem auch als
el los las del y que en un una por con para es se al lo como su más no
""".split()

# (name, metric, low, high); null leaves a side open.
RULES = (
    ("length", "n_words", 20, None),
    ("word length", "word_chars / n_words", 2.0, 15.0),
    ("symbols", "n_symbols / n_words", None, 0.5),
    ("stop words", "n_stop / n_words", 0.01, None),
    ("repeated lines", "n_dup_lines / n_lines", None, 0.3),
)


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that rules use, as long."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words(text).alias("w"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = d.select(
        "doc_id",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).alias("n_symbols"),
        lines.alias("lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(sorted(set(STOP_WORDS))))).alias("n_stop"),
        F.when(
            F.size("w") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))),
        ).otherwise(F.array().cast("array<long>")).alias("h"),
    )
    d = d.withColumn("twice", F.size("h") > F.size(F.array_distinct("h")))
    # Texts that repeat nothing, nearly all, end here; others sort their windows.
    ordered = F.when(F.col("twice"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    d = d.withColumn("s", ordered).withColumn("n_s", F.size("h"))

    def repeated(v: Column, i: Column) -> Column:
        before, after = F.get(F.col("s"), i - 1)["x"], F.get(F.col("s"), i + 1)["x"]
        return F.coalesce(before == v["x"], F.lit(False)) | F.coalesce(after == v["x"], F.lit(False))

    at = F.sort_array(F.transform(F.filter("s", repeated), lambda v: v["i"]))
    d = d.withColumn("at", F.coalesce(at, F.array().cast("array<int>")))
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return d.select(
        "doc_id",
        F.col("n_words").cast("long"),
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("n_stop").cast("long"),
    )


def compile_rules(rules=RULES) -> Column:
    """True where every rule holds; a ratio over nothing is 0."""

    def one(metric: str, low, high) -> Column:
        value = F.coalesce(reduce(lambda a, b: F.try_divide(a, b), [F.col(x.strip()) for x in metric.split("/")]), F.lit(0))
        parts = [value >= low] * (low is not None) + [value <= high] * (high is not None)
        return reduce(Column.__and__, parts, F.lit(True))

    return reduce(Column.__and__, [one(metric, low, high) for _, metric, low, high in rules], F.lit(True))


def quality(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    return (
        metrics(docs, id_col, text_col)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
    )
