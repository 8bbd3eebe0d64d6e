"""Preference pairs in chat format, in DataFrame functions alone.

A pair is a chosen and a rejected conversation.  Their longest common prefix of turns
(equal role and text, place by place) is rendered once as prompt; the rest of each is
its completion, with a mask of the parts to learn: the assistant's turns.

Turn places are compared by joining the two sides turn by turn, so no conversation is
gathered to find the prefix; only the rendered texts, which are whole conversations by
definition, come together in one row.

Edge cases: a turn's place is its rank by (turn, role, text) in its conversation, so
gaps and rows that repeat don't matter (repeated rows are repeated turns); null roles
and texts equal null ones and render as empty; a side without turns is an empty
conversation; equal conversations are all prompt, with empty completions; rows without
a pair are left out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands around a turn: begin, after the role, end.
BEGIN, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(side: DataFrame, pair_col: str, name: str) -> DataFrame:
    """``(pair, at, {name})``: turns in place; ``{name}`` is a struct of role and text."""
    order = Window.partitionBy("pair").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = side.where(F.col(pair_col).isNotNull()).select(F.col(pair_col).alias("pair"), "turn", "role", "text")
    return rows.select("pair", (F.row_number().over(order) - 1).alias("at"), F.struct("role", "text").alias(name))


def render(turn: Column) -> Column:
    """A turn as text."""
    none = F.lit("")
    return F.concat(F.lit(BEGIN), F.coalesce(turn["role"], none), F.lit(MIDDLE), F.coalesce(turn["text"], none), F.lit(END))


def _joined(parts: Column) -> Column:
    """Texts of ``(at, text, learn)`` structs in order."""
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p["text"]), "")


def _mask(parts: Column) -> Column:
    """Spans ``(start, length)`` of the learned parts, in characters of the joined text.

    The role header of a turn is not learned; its text and end mark are.
    """
    learned = F.filter(F.sort_array(parts), lambda p: p["learn"])
    return F.transform(
        learned, lambda p: F.struct((p["begin"] + p["head"]).alias("start"), (F.length(p["text"]) - p["head"]).cast("long").alias("length"))
    )


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id", learned_role: str = "assistant") -> DataFrame:
    """One row per pair of ``chosen`` and ``rejected`` (``pair_col, turn, role, text``).

    ``pair_col, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask``;
    a mask lists ``(start, length)`` in characters of its completion.
    """
    both = _turns(chosen, pair_col, "c").join(_turns(rejected, pair_col, "r"), ["pair", "at"], "full_outer")
    # the first place where the sides differ (one of them may have ended)
    first = F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("at")))
    cut = both.groupBy("pair").agg(F.coalesce(first, F.max("at") + 1).alias("prompt_turns"))
    placed = both.join(cut, "pair").withColumn("rest", F.col("at") >= F.col("prompt_turns"))
    before = Window.partitionBy("pair", "rest").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)

    def part(side: str) -> Column:
        turn = F.col(side)
        begin = F.coalesce(F.sum(F.when(turn.isNotNull(), F.length(render(turn)))).over(before), F.lit(0))
        head = F.length(F.lit(BEGIN)) + F.length(F.coalesce(turn["role"], F.lit(""))) + F.length(F.lit(MIDDLE))
        learn = F.coalesce(turn["role"] == learned_role, F.lit(False))
        return F.struct(F.col("at"), render(turn).alias("text"), begin.alias("begin"), head.alias("head"), learn.alias("learn"))

    rest = F.col("rest")
    rows = placed.select("pair", "prompt_turns", "rest", part("c").alias("cp"), part("r").alias("rp"), F.col("c").isNotNull().alias("has_c"), F.col("r").isNotNull().alias("has_r"))
    rows = rows.groupBy("pair", "prompt_turns").agg(
        F.collect_list(F.when(~rest, F.col("cp"))).alias("prompt"),
        F.collect_list(F.when(rest & F.col("has_c"), F.col("cp"))).alias("chosen"),
        F.collect_list(F.when(rest & F.col("has_r"), F.col("rp"))).alias("rejected"),
    )
    return rows.select(
        F.col("pair").alias(pair_col), F.col("prompt_turns").cast("long").alias("prompt_turns"), _joined(F.col("prompt")).alias("prompt"),
        _joined(F.col("chosen")).alias("chosen"), _mask(F.col("chosen")).alias("chosen_mask"),
        _joined(F.col("rejected")).alias("rejected"), _mask(F.col("rejected")).alias("rejected_mask"),
    )


def echo_rejections(conversations: DataFrame, conv_col: str = "conv_id", learned_role: str = "assistant") -> DataFrame:
    """Rejected counterparts of whole conversations.

    The last assistant turn answers with the text of the turn before it, and what
    followed it is dropped; conversations without an assistant turn stay as they are;
    turns without a conversation are left out.
    """
    order = Window.partitionBy(conv_col).orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    named = conversations.where(F.col(conv_col).isNotNull())
    rows = named.select(conv_col, "turn", "role", "text").withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("before", F.lag("text").over(order))
    last = rows.groupBy(conv_col).agg(F.max(F.when(F.col("role") == learned_role, F.col("at"))).alias("last"))
    rows = rows.join(last, conv_col).where(F.col("last").isNull() | (F.col("at") <= F.col("last")))
    text = F.when(F.col("at") == F.col("last"), F.coalesce("before", F.lit(""))).otherwise(F.col("text"))
    return rows.select(conv_col, "turn", "role", text.alias("text"))
