"""Preference formatting: one prompt and a pair of masked completions.

Chosen and rejected conversations are lists of turns. Their longest common prefix of equal turns (same
role and text) is rendered once, as the prompt; what follows it on each side is that side's completion.
A turn is rendered as <|im_start|>role, a line end, its text, <|im_end|> and a line end, in two segments:
the header, which is masked, and the rest, which is trained on if the role is `assistant`. Where a role
or a text spells <|im_start|> or <|im_end|>, a space after <| keeps it from opening or closing a turn.

Everything is DataFrame functions: one shuffle by pair, then array functions that are linear in the
number of turns. A conversation is one row of the result, so its turns have to fit in one row.

Defined cases: a null text is empty and a null role is `user`; turns stand in order of turn, then role,
then text, nulls first; repeated turns stay, each in its place; a side without turns is an empty list;
equal sides have empty completions, and `differs` is false; pairs with a null id are one pair; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe(x: Column) -> Column:
    return F.regexp_replace(x, r"<\|(im_start\|>|im_end\|>)", "<| $1")


def segments(turns: Column) -> Column:
    """array<struct<text, trained>>: two segments per turn."""

    def turn(t: Column) -> Column:
        header = F.struct(F.concat(F.lit("<|im_start|>"), safe(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("trained"))
        body = F.struct(F.concat(safe(t["text"]), F.lit("<|im_end|>\n")).alias("text"), (t["role"] == "assistant").alias("trained"))
        return F.array(header, body)

    return F.flatten(F.transform(turns, turn))


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def said() -> Column:
    return F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """render() of (pair_id, side, turn, role, text), side being chosen or rejected."""
    sides = {s: F.sort_array(F.collect_list(F.when(F.col("side") == s, said()))).alias(s) for s in ("chosen", "rejected")}
    return render(turns.where(F.col("side").isin(*sides)).groupBy("pair_id").agg(*sides.values()))


def render(pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected), lists of turns -> one row per pair: pair_id, prompt_turns, prompt,
    chosen, rejected (segments with their masks), differs (whether the completions do)."""
    sides = ("chosen", "rejected")
    same = F.zip_with(*sides, lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    pairs = pairs.select("pair_id", *(F.col(s).alias(f"{s}_turns") for s in sides), same.alias("same"))
    at = F.array_position("same", F.lit(False))
    pairs = pairs.withColumn("prompt_turns", F.when(at > 0, at - 1).otherwise(F.size("same")).cast("int"))
    rest = {s: F.slice(f"{s}_turns", F.col("prompt_turns") + 1, F.size(f"{s}_turns")) for s in sides}
    prompt = joined(segments(F.slice("chosen_turns", F.lit(1), F.col("prompt_turns"))))
    return pairs.select("pair_id", "prompt_turns", prompt.alias("prompt"), *(segments(rest[s]).alias(s) for s in sides), (at > 0).alias("differs"))


def stale_replies(conversations: DataFrame, only_different: bool = False) -> DataFrame:
    """(pair_id, chosen, rejected), lists of turns, out of plain conversations: chosen is the conversation
    up to its last assistant turn; rejected is the same with that reply's text replaced by that of the
    assistant turn before (empty if there is none). Conversations without an assistant turn give no pair;
    with only_different, nor do those without an earlier reply or with one of the same text."""
    ordered = conversations.groupBy(F.col("conv_id").cast("long").alias("pair_id")).agg(F.sort_array(F.collect_list(said())).alias("turns"))
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    found = ordered.withColumn("replies", replies).where(F.size("replies") > 0)
    last, before = F.element_at("replies", -1), F.get("replies", F.size("replies") - 2)
    found = found.select("pair_id", "turns", last.alias("last"), F.get("turns", last).alias("reply"), F.get("turns", before)["text"].alias("stale"))
    if only_different:
        found = found.where(F.col("stale").isNotNull() & (F.col("stale") != F.col("reply.text")))
    stale = F.struct(F.col("reply.turn").alias("turn"), F.col("reply.role").alias("role"), F.coalesce("stale", F.lit("")).alias("text"))
    return found.select("pair_id", F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"), F.concat(F.slice("turns", F.lit(1), F.col("last")), F.array(stale)).alias("rejected"))
