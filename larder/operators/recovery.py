"""Log recovery: the valid prefix, and in it the groups that were committed.

Rows: pos, status ('ok', 'torn' or 'corrupt'), pending, nbytes and whatever the record carries. Every row
before the first that is not ok is valid. A run of pending rows belongs to the next row that is not
pending; if the valid prefix ends before it, the run is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classified(log: DataFrame, block: int = 1 << 16) -> DataFrame:
    """The log with two more columns: valid, and commit_pos (where the row's group is committed, if it
    is).

    Positions are cut into blocks that are looked at in parallel; only one row per block, its first
    commit, is then looked at in order, so no task sees the whole log. Both looks run from the end, so
    that a running minimum does and the cost does not depend on the block's size.
    """
    first_bad = F.broadcast(log.agg(F.min(F.when(F.col("status") != "ok", F.col("pos"))).alias("first_bad")))
    rows = log.crossJoin(first_bad).withColumn("valid", F.col("first_bad").isNull() | (F.col("pos") < F.col("first_bad"))).drop("first_bad")
    commit = F.when(F.col("valid") & ~F.col("pending"), F.col("pos"))
    rows = rows.withColumn("_block", F.floor(F.col("pos") / block).cast("long"))
    blocks = rows.groupBy("_block").agg(F.min(commit).alias("_first"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_next", F.min("_first").over(later)).drop("_first")
    own = F.min(commit).over(Window.partitionBy("_block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_own", own).join(blocks, "_block")
    return rows.withColumn("commit_pos", F.when(F.col("valid"), F.coalesce("_own", "_next"))).drop("_block", "_own", "_next")


def committed(log: DataFrame) -> DataFrame:
    """The rows that recovery applies."""
    return classified(log).where("commit_pos IS NOT NULL").drop("valid", "commit_pos")


def report(log: DataFrame) -> DataFrame:
    """One row: records_applied, discarded_bytes, cause ('torn', 'corrupt', 'uncommitted' or null)."""
    rows = classified(log)
    applied = F.col("commit_pos").isNotNull()
    return rows.agg(
        F.count_if(applied).alias("records_applied"),
        F.coalesce(F.sum(F.when(~applied, F.col("nbytes"))), F.lit(0).cast("long")).alias("discarded_bytes"),
        F.coalesce(F.min_by("status", F.when(F.col("status") != "ok", F.col("pos"))), F.when(F.count_if(~applied) > 0, "uncommitted")).alias("cause"),
    )
