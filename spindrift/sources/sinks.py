"""Sinks: partitioned Parquet layouts of the products, and incremental writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that each product is laid out by.
LAYOUT = {
    "drift_proc": ["level", "sensor", "area", "day"],
    "drift_final": ["area", "day"],
    "wind_params": ["area", "month"],
    "max_drift_mask": ["area"],
    "matchup": ["area", "year", "month"],
    "image": ["instrument", "area", "day"],
    "trajectory": ["catalogue"],
}


def write_product(df: DataFrame, path: str, product: str) -> None:
    """Replaces just the partitions that df holds rows of."""
    keys = LAYOUT[product]
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_product(spark: SparkSession, path: str, **only) -> DataFrame:
    """A product, pruned to partitions with the given values."""
    df = spark.read.parquet(path)
    for k, v in only.items():
        df = df.where(F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return df


def pending(inputs: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Inputs without an output yet, by key."""
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_lines(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("overwrite").text(path)
