"""Ranks of values within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.runtime import cut_lineage

_PLACE = (1 << 33) - 1  # of a row within its partition, in monotonically_increasing_id


def ranked(df: DataFrame, group: str, value: str, rank: str = "r") -> DataFrame:
    """group, value and its rank from 1; equal values are ranked in any order.

    Rows are dealt out by ranges of (group, value) and sorted there, so a group lies in consecutive partitions. A row's rank is its
    place in its partition, plus what the partitions before hold of its group: a row a group and partition tells.
    The sorted rows are written once, as ranges drawn anew need not be the same.
    """
    rows = df.select(group, value).repartitionByRange(group, value).sortWithinPartitions(group, value)
    rows = cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit(_PLACE))})
    held = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over partitions, not rows
    held = held.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    rows = rows.join(F.broadcast(held), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))  # groups plus partitions
    return rows.select(group, value, (F.col("_at") + F.col("_off") + 1).alias(rank))


def paired(df: DataFrame, group: str, one: str, two: str, rank: str = "r") -> DataFrame:
    """group, rank and the values of that rank on both sides, each side sorted by itself."""
    return ranked(df, group, one, rank).join(ranked(df, group, two, rank), [group, rank]).select(group, rank, one, two)
