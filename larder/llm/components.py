"""Connected components of an edge table, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch

#: One mask per round: comparing ids under another mask each time breaks long chains of rising ids.
MASKS = tuple(((i + 1) * 0x9E3779B97F4A7C15 >> 1) & 0x7FFFFFFFFFFFFFFF for i in range(64))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(a long, b long), in any direction and with repeats -> (id, root): every id that occurs,
    with one id of its component, the same for all of it.

    Each round every id moves to the least of itself and its neighbours (under that round's mask), the
    edges are rewritten to where their ends went, and loops and repeats go. A star takes one round and
    a chain loses a constant share of its ids each round. Only tables move between the machines.
    """
    live = scratch.keep(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    where = scratch.keep(live.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("root")))
    for mask in MASKS:
        if live.isEmpty():
            break
        key = F.lit(mask)
        ends = live.select("a", "b").unionAll(live.select(F.col("b"), F.col("a")))
        to = scratch.keep(ends.groupBy("a").agg(F.least(F.min(F.col("b").bitwiseXOR(key)), F.first("a").bitwiseXOR(key)).bitwiseXOR(key).alias("to")).select(F.col("a").alias("at"), "to"))
        moved = live.join(to, F.col("a") == F.col("at")).select(F.col("to").alias("a"), "b").join(to, F.col("b") == F.col("at")).select("a", F.col("to").alias("b"))
        after = scratch.keep(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        found = scratch.keep(where.join(to, F.col("root") == F.col("at"), "left").select("id", F.coalesce("to", "root").alias("root")))
        scratch.drop(live, to, where)
        live, where = after, found
    else:
        raise RuntimeError(f"components did not settle in {len(MASKS)} rounds")
    scratch.drop(live)
    return where
