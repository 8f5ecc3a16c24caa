"""Merging vectors of several sensors: masks, weighted means, coverage, flags and gap-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.dims import NO_FILL, REMOVED, VALID

SIGMA_LIMIT, POLE_LAT, POLE_HOLE, INFLATION = 50.0, 87.5, 86.0, 1.5  # POLE_HOLE: from where the north has no coverage
FILL_RADIUS, FILL_WIDTH = 300.0, 200.0


def usable(flag: Column, sigma: Column, *values: Column, lat: Column | None = None) -> Column:
    """Whether a sensor's vector takes part: nothing missing, a small enough uncertainty, a flag that is not to be filled.

    With lat, a vector near the pole takes part only under flag 0; a merge of wind alone goes without that rule.
    """
    ok = (sigma < SIGMA_LIMIT) & ~flag.isin(*NO_FILL)
    if lat is not None:
        ok = ok & ~((lat >= POLE_LAT) & (flag != 0))
    for v in (sigma, *values):
        ok = ok & v.isNotNull() & ~F.isnan(v)
    return F.coalesce(ok, F.lit(False))


def merged(lat: Column | None = None, wind: Column | None = None) -> list[Column]:
    """The aggregates of a merge: means of dx, dy weighted by 1 / sigma^2, their sigma, the least flag, no_fill and the sensors used.

    Rows where `wind` holds take part only in groups that some other sensor has a valid flag in. Batches and streams group by them alike.
    """
    ok = usable(F.col("flag"), F.col("sigma"), F.col("dx"), F.col("dy"), lat=lat)
    w = 1 / (F.col("sigma") * F.col("sigma"))
    if wind is None:
        add = lambda value, how=F.sum: how(F.when(ok, value))
        least = F.min(F.when(ok, F.col("flag")).otherwise(F.lit(REMOVED)))
    else:
        seen = F.bool_or(~wind & F.col("flag").isin(*VALID))

        def add(value, how=F.sum):
            return F.when(seen, how(F.when(ok, value))).otherwise(how(F.when(ok & ~wind, value)))

        flags = lambda good: F.min(F.when(good, F.col("flag")).otherwise(F.lit(REMOVED)))
        least = F.when(seen, flags(ok)).otherwise(flags(ok & ~wind))
    total = add(w)
    return [
        F.round(F.try_divide(add(w * F.col("dx")), total), 6).alias("dx"),
        F.round(F.try_divide(add(w * F.col("dy")), total), 6).alias("dy"),
        F.round(INFLATION * F.sqrt(F.try_divide(F.lit(1.0), total)), 6).alias("sigma"),
        least.alias("flag"),
        F.max(F.col("flag").isin(*NO_FILL).cast("int")).alias("no_fill"),
        add(w, F.count).alias("n_used"),
    ]


def inverse_variance(df: DataFrame, *keys: str, lat: Column | None = None, wind: Column | None = None) -> DataFrame:
    """One vector for each key, by the aggregates of `merged`."""
    return df.groupBy(*keys).agg(*merged(lat, wind))


def coverage(df: DataFrame, *keys: str, where: Column | None = None) -> DataFrame:
    """Valid vectors over ice pixels (flags up to 0 or above 5), of the rows where `where` holds; null where there is no ice."""
    where = F.lit(True) if where is None else where
    valid = F.count_if(where & F.col("flag").isin(*VALID))
    ice = F.count_if(where & ((F.col("flag") <= 0) | (F.col("flag") > 5)))
    return df.groupBy(*keys).agg(valid.alias("n_valid"), ice.alias("n_ice"), F.round(F.try_divide(valid, ice), 6).alias("ratio"))


def to_final(df: DataFrame, flags: DataFrame, flag: str = "flag") -> DataFrame:
    """df with final_flag; null for a flag that has none."""
    return df.join(F.broadcast(flags.withColumnRenamed("flag", "_flag")), F.col(flag) == F.col("_flag"), "left").drop("_flag")  # one row for each flag


def offsets(radius: float) -> list[tuple[int, int]]:
    """Grid offsets within a radius in cells."""
    r = int(radius)
    return [(i, j) for j in range(-r, r + 1) for i in range(-r, r + 1) if i * i + j * j <= radius * radius]


def around(df: DataFrame, around_: list[tuple[int, int]], x: str = "x", y: str = "y") -> DataFrame:
    """df once for each offset, with the neighbour's place as nx, ny and the squared distance d2 in cells."""
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around_))
    rows = df.withColumn("_o", F.explode(table))
    return rows.withColumns({"nx": F.col(x) + F.col("_o.i"), "ny": F.col(y) + F.col("_o.j"), "d2": F.col("_o.i") * F.col("_o.i") + F.col("_o.j") * F.col("_o.j")}).drop("_o")


def gaussian_fill(cells: DataFrame, sources: DataFrame, radius: float, width: float, *values: str) -> DataFrame:
    """cells (x, y) with each value kept where present, else the Gaussian mean of sources within the radius (in cells)."""
    wanted = around(cells.select("x", "y"), offsets(radius))
    s = sources.select(F.col("x").alias("nx"), F.col("y").alias("ny"), *(F.col(v).alias(f"_{v}") for v in values))
    w = F.exp(-F.col("d2") / (width * width))
    joined = wanted.join(s, ["nx", "ny"])
    fill = joined.groupBy("x", "y").agg(*(F.try_divide(F.sum(w * F.col(f"_{v}")), F.sum(F.when(F.col(f"_{v}").isNotNull(), w))).alias(f"_{v}") for v in values))
    return cells.join(fill, ["x", "y"], "left").select(*(c for c in cells.columns if c not in values), *(F.coalesce(v, f"_{v}").alias(v) for v in values), *(F.col(v).isNull().alias(f"{v}_filled") for v in values))
