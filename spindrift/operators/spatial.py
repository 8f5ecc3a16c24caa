"""Joins of points by distance, through buckets as wide as the radius."""

from __future__ import annotations

from math import ceil, log2, pi, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.runtime import cut_lineage

MOST_STEPS = 16  # halvings of the radius


def within(left: DataFrame, right: DataFrame, radius: float, x: str = "x", y: str = "y", rx: str = "sx", ry: str = "sy") -> DataFrame:
    """All pairs no further apart than the radius, with their squared distance d2: an equi-join on nine buckets."""
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.withColumn("_o", F.explode(near)).withColumns({"_bx": F.floor(F.col(x) / radius) + F.col("_o.i"), "_by": F.floor(F.col(y) / radius) + F.col("_o.j")})
    b = right.withColumns({"_bx": F.floor(F.col(rx) / radius), "_by": F.floor(F.col(ry) / radius)})
    dx, dy = F.col(x) - F.col(rx), F.col(y) - F.col(ry)
    return a.join(b, ["_bx", "_by"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radius * radius).drop("_bx", "_by", "_o")


def nearest(left: DataFrame, right: DataFrame, radius: float, k: int, id: str = "id", sid: str = "sid", x: str = "x", y: str = "y", rx: str = "sx", ry: str = "sy") -> DataFrame:
    """id, sid, d2 and place (from 1): the k nearest points of `right` to each id, no further than the radius; of equal ones those of smaller sid.

    Of points in one place only the k of smallest sid can be among them. The others are looked for within a radius that about k
    points lie in, then within twice as much, and so on up to `radius`: an id that has k points within a radius is done,
    as all that lies outside is further away. So an id meets a few times k points, however many lie within the whole radius.
    """
    c = F.col
    right = right.where(F.isnotnull(rx) & F.isnotnull(ry)).select(c(sid).alias("sid"), c(rx).alias("rx"), c(ry).alias("ry"))
    here = Window.partitionBy("rx", "ry").orderBy(c("sid").asc_nulls_last())
    right = cut_lineage(right.withColumn("n", F.row_number().over(here)).where(c("n") <= k).drop("n"))
    left = left.where(F.isnotnull(x) & F.isnotnull(y)).select(c(id).alias("id"), c(x).alias("x"), c(y).alias("y"))
    at = right.agg(F.countDistinct("rx", "ry").alias("n"), (F.max("rx") - F.min("rx")).alias("w"), (F.max("ry") - F.min("ry")).alias("h")).first()
    first = sqrt(max(at.w, radius) * max(at.h, radius) / at.n / pi) if at.n else radius  # a circle that a place lies in on average
    steps = min(MOST_STEPS, max(0, ceil(log2(radius / first))))
    found = []
    for r in (radius / 2**s for s in range(steps, -1, -1)):
        w = Window.partitionBy("id").orderBy("d2", c("sid").asc_nulls_last())
        best = within(right, left, r * (1 + 1e-9), "rx", "ry", "x", "y").where(c("d2") <= r * r)
        best = best.select("id", "sid", "d2").withColumn("place", F.row_number().over(w)).where(c("place") <= k)
        if r == radius:
            found.append(best)
            break
        best = cut_lineage(best)
        done = best.where(c("place") == k).select(c("id").alias("_id"))
        same = c("id").eqNullSafe(c("_id"))
        found.append(best.join(done, same, "left_semi"))
        left = cut_lineage(left.join(done, same, "left_anti"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
