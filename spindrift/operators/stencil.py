"""Stencils over gridded images: neighbour joins by integer offsets, filters and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.merge import around

#: Offsets of a 5 x 5 window by ring.
WINDOW_5 = [(i, j) for j in range(-2, 3) for i in range(-2, 3)]


def neighbours(px: DataFrame, window: list[tuple[int, int]], value: str = "v", keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """Pairs of a pixel and each neighbour within the image, as nv, with i, j offsets squared in d2 and ring max(|i|, |j|)."""
    rows = around(px, window).withColumn("ring", F.greatest(F.abs(F.col("nx") - F.col("x")), F.abs(F.col("ny") - F.col("y"))))
    other = px.select(*keys, F.col("x").alias("nx"), F.col("y").alias("ny"), F.col(value).alias("nv"))
    return rows.join(other, [*keys, "nx", "ny"])


def laplacian(px: DataFrame) -> DataFrame:
    """Mean of the 3 x 3 core less that of the outer ring; flag 0 where both have values enough, 1 else."""
    rows = neighbours(px, WINDOW_5)
    inner, outer = F.when(F.col("ring") <= 1, F.col("nv")), F.when(F.col("ring") == 2, F.col("nv"))
    got = rows.groupBy("image", "x", "y").agg(F.avg(inner).alias("a"), F.avg(outer).alias("b"), F.count(inner).alias("n1"), F.count(outer).alias("n2"))
    enough = (F.col("n1") >= 5) & (F.col("n2") >= 9)
    return got.select("image", "x", "y", F.when(enough, F.col("a") - F.col("b")).alias("lap"), F.when(enough, 0).otherwise(1).alias("flag"))


def box_mean(px: DataFrame, half: int) -> DataFrame:
    """Mean over a square window where half of it or more is there."""
    window = [(i, j) for j in range(-half, half + 1) for i in range(-half, half + 1)]
    got = neighbours(px, window).groupBy("image", "x", "y").agg(F.avg("nv").alias("mean"), F.count("nv").alias("n"))
    return got.select("image", "x", "y", F.when(F.col("n") * 2 >= len(window), F.col("mean")).alias("mean"), "n")


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; null without variance."""
    return F.try_divide(n * sxy - sx * sy, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))
