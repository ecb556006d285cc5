"""Chat formatting with Spark expressions only.

Template: a block per run of turns of one role, ``<s>role[INST]text[TURN]text[/INST]</s>``.
Roles and texts are escaped so that they hold neither ``<`` nor ``[``: backslash becomes
``\\e``, ``<`` becomes ``\\l``, ``[`` becomes ``\\b``. No control string can then come from a text,
and taking the escapes back in the order ``\\l``, ``\\b``, ``\\e`` gives every text exactly.

Defined cases: null text and null role are empty; a null turn comes first; rows of equal
turn are ordered by role, then text, and repeated rows are turns of their own; rows without
conv_id are one conversation; an empty table gives no rows; other columns are not read.
A conversation's output is one row, as its text is; turns are sorted in pieces first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
BEGIN, BODY, TURN, DONE, END = "<s>", "[INST]", "[TURN]", "[/INST]", "</s>"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
PIECE_TURNS = 256


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _segment(text: Column, loss) -> Column:
    return F.struct(text.alias("text"), F.lit(loss).alias("loss") if isinstance(loss, bool) else loss.alias("loss"))


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per conversation: conv_id, formatted, segments (text, loss) that concatenate to it."""
    turns = rows.select(
        F.col(conv).alias("conv_id"),
        F.floor(F.col(turn) / PIECE_TURNS).alias("piece"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    pieces = turns.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "ts"))).alias("ps"))
    whole = whole.select("conv_id", F.flatten(F.transform("ps", lambda p: p["ts"])).alias("ts"))
    # The role of the turn before and after decides where a block begins and ends.
    n = F.size("ts")

    def pieces_of(t: Column, i: Column) -> Column:
        first = (i == 0) | (F.get(F.col("ts"), i - 1)["role"] != t["role"])
        last = (i == n - 1) | (F.get(F.col("ts"), i + 1)["role"] != t["role"])
        head = F.when(first, F.concat(F.lit(BEGIN), escape(t["role"]), F.lit(BODY))).otherwise(F.lit(TURN))
        tail = F.when(last, F.lit(DONE + END)).otherwise(F.lit(""))
        return F.array(
            _segment(head, False), _segment(escape(t["text"]), t["role"] == ASSISTANT), _segment(tail, False)
        )

    merged = whole.select("conv_id", F.flatten(F.transform("ts", pieces_of)).alias("segments"))
    return merged.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.replace(F.substring_index(block, BODY, 1), F.lit(BEGIN), F.lit("")))
        body = F.substring_index(F.substring_index(block, BODY, -1), DONE, 1)
        return F.transform(
            F.split(body, "\\[TURN\\]", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"])), "")
