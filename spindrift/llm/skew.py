"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, LEAST = 1000, 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to table, which has one row for a key; total: how many rows there are.

    Keys that hold more than a thousandth of the rows, so a thousand keys at most, are looked up
    in a broadcast of those entries; all others meet in a shuffle, where none is hot any more.
    """
    least = max(total // SHARE, LEAST)
    hot = [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > least).select(key).collect()]  # SHARE at most
    if not hot:
        return rows.join(table, key)
    some = F.col(key).isin(hot)
    return rows.where(some).join(F.broadcast(table.where(some)), key).unionByName(rows.where(~some).join(table.where(~some), key))
