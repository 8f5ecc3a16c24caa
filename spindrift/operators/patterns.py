"""Which cells of an output grid can be tracked: pattern windows laid over two dates' images.

A cell is tried with a large pattern and, where that is not all ice or has gaps, with a smaller one.
Both are counted in one pass over the large pattern's offsets, so every pixel is joined once a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.merge import around, offsets

#: States of a pixel, classes of its ice edge, and flags of a cell.
NODATA, UNPROCESSED = -1, 1
OPEN_ICE, CLOSE_ICE, LAND = 2, 3, 9
OUTSIDE, NEAR_BORDER, ON_LAND, NO_ICE, NEAR_EDGE, NEAR_MISSING, NEAR_UNPROCESSED, SMALLER = 1, 2, 3, 4, 5, 6, 7, 17


def is_ice(edge: Column) -> Column:
    """An observation of ice: neither land, nor open water, nor without a class; no class at all counts as ice."""
    return F.coalesce((edge < LAND) & ~edge.isin(0, 1), F.lit(True))


def ladder(cells: DataFrame, begin: DataFrame, end: DataFrame, large: float, small: float, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """keys, x, y, flag, pattern and product_flag for cells (keys, x, y) over pixels (keys, x, y, edge, tc) of two dates.

    Radii are in pixels. pattern is 0 for the large one, 1 for the small one, -1 for a cell that is refused
    before its pattern is read. product_flag is 17 for a cell that passes with the small pattern. Ice means
    edge 2 or 3 on both dates, and a pixel is missing or unprocessed if it is on either.
    """
    inner = F.col("d2") <= small * small
    first = begin.select(*keys, F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("edge").alias("e0"), F.col("tc").alias("t0"))
    second = end.select(*keys, F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("edge").alias("e1"), F.col("tc").alias("t1"))
    rows = around(cells, offsets(large)).join(first, [*keys, "nx", "ny"], "left").join(second, [*keys, "nx", "ny"], "left")
    ice = F.col("e0").isin(OPEN_ICE, CLOSE_ICE) & F.col("e1").isin(OPEN_ICE, CLOSE_ICE)
    either = lambda v: F.coalesce(F.col("t0") == v, F.lit(False)) | F.coalesce(F.col("t1") == v, F.lit(False))
    middle, there = F.col("d2") == 0, F.col("t0").isNotNull()
    n = lambda q, a: F.count_if(F.coalesce(q, F.lit(False))).alias(a)
    counts = []
    for k, part in enumerate((F.lit(True), inner)):
        counts += [n(part, f"points{k}"), n(part & ice, f"ice{k}"), n(part & either(NODATA), f"missing{k}"), n(part & either(UNPROCESSED), f"unread{k}")]
    got = rows.groupBy(*keys, "x", "y").agg(n(middle & there, "inside"), n(~there, "out"), F.max(F.when(middle, F.col("e0"))).alias("edge"), *counts)

    c = F.col
    less = c("ice0") < c("points0")  # not all ice: the small pattern from here on
    chosen = lambda name: F.when(less, c(f"{name}1")).otherwise(c(f"{name}0"))
    gaps = ~less & (c("missing0") > 0)  # or because of gaps
    border = F.when(c("inside") == 0, OUTSIDE).when(c("out") > 0, NEAR_BORDER)
    land = F.when(c("edge") >= LAND, ON_LAND)
    water = F.when(c("ice0") == 0, NO_ICE).when(chosen("ice") != chosen("points"), NEAR_EDGE)
    data = F.when(chosen("unread") > 0, NEAR_UNPROCESSED).when(F.when(less | gaps, c("missing1")).otherwise(c("missing0")) > 0, NEAR_MISSING)
    flag = F.coalesce(border, land, water, data, F.lit(0))
    pattern = F.when(flag.isin(OUTSIDE, NEAR_BORDER, ON_LAND), -1).when(flag == NO_ICE, 0).when(flag.isin(NEAR_EDGE, NEAR_UNPROCESSED), less.cast("int")).otherwise((less | gaps).cast("int"))
    rows = got.select(*keys, "x", "y", flag.cast("int").alias("flag"), pattern.cast("int").alias("pattern"))
    return rows.withColumn("product_flag", F.when((c("flag") == 0) & (c("pattern") == 1), SMALLER).otherwise(c("flag")).cast("int"))


def laplacian_of_ice(px: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """keys, x, y, lap, flag, edge_lap and edge_flag of pixels (keys, x, y, v, edge); v is null where there are no data.

    The mean of the eight neighbours less that of the ring of sixteen around them, of ice only. Flag 0 where five and
    nine of them have values, -1 where more than one neighbour has no data, 1 where too few are there or the
    pixel itself has no data or no ice. For edge_lap and edge_flag a row of the window ends at its first pixel outside
    the image, which leaves nothing of it within two pixels of the left border.

    Each pixel is handed to the places around it, its own included, and places are grouped: pixels are joined with nothing, so none
    of them can be broadcast. Repeated pixels count as often as they are there, and keep as many rows.
    """
    c = F.col
    window = [(i, j) for j in range(-2, 3) for i in range(-2, 3)]
    good = c("v").isNotNull() & is_ice(c("edge"))
    rows = around(px.select(*keys, "x", "y", "v", good.alias("good")), window)
    ring = F.greatest(F.abs(c("nx") - c("x")), F.abs(c("ny") - c("y")))
    near, far, own = F.when(c("good") & (ring == 1), c("v")), F.when(c("good") & (ring == 2), c("v")), ring == 0
    got = rows.groupBy(*keys, c("nx").alias("x"), c("ny").alias("y")).agg(
        F.avg(near).alias("a"), F.avg(far).alias("b"), F.count(near).alias("n1"), F.count(far).alias("n2"), F.count_if(c("v").isNull() & ~own).alias("gone"), F.count_if(own).alias("copies"), F.count_if(own & c("good")).alias("times"),
    ).where("copies > 0")
    least = px.groupBy(*keys).agg(F.min("x").alias("x0"))
    got = got.join(least.hint("merge"), list(keys), "left")  # a row an image; images without a key lie nowhere
    n = c("times")
    flag = F.when(c("gone") * n > 1, NODATA).when((c("n1") * n >= 5) & (c("n2") * n >= 9), 0)
    got = got.withColumn("f", F.coalesce(F.when(c("x0").isNotNull(), flag), F.lit(UNPROCESSED)).cast("int"))
    got = got.withColumn("g", F.when(c("x") >= c("x0") + 2, c("f")).otherwise(UNPROCESSED).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1), c("copies"))))
    lap = lambda k, name: F.when(c(k) == 0, c("a") - c("b")).alias(name)
    return got.select(*keys, "x", "y", lap("f", "lap"), c("f").alias("flag"), lap("g", "edge_lap"), c("g").alias("edge_flag"))
