"""Collocation of trajectories with gridded displacements in space, time and duration.

A record is laid between the four corners of the product's grid around it. What the corners hold gives the
product's times there: by the closest valid corner, or by bilinear weights. The record nearest to the
product's begin starts the match, that nearest to the product's duration after it ends it.

A record meets its four corners as one row, of a table of the products' grid meshes, so it is neither multiplied nor grouped.
Records are dealt by trajectory once, and only then meet the products, which trajectories that hold still all do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.geo import haversine
from spindrift.runtime import cut_lineage

#: Km, weight, seconds.
NEAREST_KM, LEAST_WEIGHT, START_S, DURATION_S = 40.0, 0.99, 3 * 3600, 3600
SMALL = 1 << 16  # cells of products whose meshes are broadcast, in 30 MB at most
VALUES = ("t0", "t1", "dx", "dy")
SPREADS = ("sx", "sy", "cxy")


CORNERS = [(i, j) for i in (0, 1) for j in (0, 1)]


def meshes(product: DataFrame) -> DataFrame:
    """prod, fx, fy and the four cells from there on as the array ps, null where they are not valid."""
    c = F.col
    good = product.where("dx is not null").select("prod", "cx", "cy", F.struct("lat", "lon", *VALUES, *SPREADS, "flag").alias("p"))
    at = F.explode(F.array(*(F.struct(F.lit(2 * i + j).alias("c"), (c("cx") - i).alias("fx"), (c("cy") - j).alias("fy")) for i, j in CORNERS)))
    rows = good.withColumn("at", at)
    return rows.groupBy("prod", c("at.fx").cast("bigint").alias("fx"), c("at.fy").cast("bigint").alias("fy")).agg(F.array(*(F.first(F.when(c("at.c") == k, c("p")), ignorenulls=True) for k in range(4))).alias("ps"))


def between(rows: DataFrame, mesh: DataFrame, nearest: bool, shift: float | None, whole: bool = True) -> DataFrame:
    """rows (prod, x, y, lat, lon, r0, r1, copies) that lie in a mesh, with begin and, if `whole`, with finish and all else that its corners say: p_ of each value, spread, px, py and near.

    A row that lies on a line of the grid has its lower corners twice: the upper ones have no weight, and are not there for the closest.
    """
    c = F.col
    on = {"fx": F.floor("x"), "fy": F.floor("y"), "ex": F.ceil("x") > F.floor("x"), "ey": F.ceil("y") > F.floor("y")}
    rows = rows.withColumns(on).join(mesh, ["prod", "fx", "fy"])
    # functions of the array, not four times as much code: Java leaves methods that grow too long uncompiled
    part = lambda v, high: F.when(high, c(v) - c(f"f{v}")).otherwise(1 - (c(v) - c(f"f{v}")))
    rows = rows.withColumn("ws", F.transform("ps", lambda p, k: F.when(p.isNotNull(), part("x", k >= 2) * part("y", k % 2 == 1))))
    added = lambda terms: F.aggregate(terms, F.lit(0.0), lambda a, w: a + F.coalesce(w, F.lit(0.0)))
    weighed = lambda v: lambda p, w: w * p[v]
    rows = rows.withColumn("total", added(c("ws")))
    own = lambda p, k: p.isNotNull() & (c("ex") | (k < 2)) & (c("ey") | (k % 2 == 0))
    if nearest:
        twice = F.when(c("ex"), 1).otherwise(2) * F.when(c("ey"), 1).otherwise(2)
        rows = rows.where(F.size(F.filter("ps", own)) * twice * c("copies") == 4)
    else:
        rows = rows.where((c("total") > 0) & (c("total") * c("copies") > LEAST_WEIGHT))
    if nearest or whole:
        at = [F.get("ps", F.lit(k)) for k in range(4)]
        km = [F.when(own(at[k], F.lit(k)), haversine(at[k]["lat"], at[k]["lon"], c("lat"), c("lon"))) for k in range(4)]
        if not whole and shift is None:
            return rows.where(F.least(*km) < NEAREST_KM).withColumn("begin", c("r0"))
        rows = rows.withColumn("m", F.least(*(F.when(km[k].isNotNull(), F.struct(km[k].alias("km"), F.lit(k).alias("c"))) for k in range(4)))).withColumn("p", F.get("ps", c("m.c")))
    if nearest:
        rows = rows.where(c("m.km") < NEAREST_KM)
        said = {f"p_{v}": c(f"p.{v}") for v in ((*VALUES, *SPREADS) if whole else VALUES[:1])}
    else:
        said = {f"p_{v}": added(F.zip_with("ps", "ws", weighed(v))) / c("total") for v in (VALUES if whole else VALUES[:1])}
    begin, finish = (c("r0"), c("r1")) if shift is None else (c("p_t0") + shift, c("p_t1") + shift)
    if not whole:
        return rows.withColumns(said).withColumn("begin", begin)
    said |= {"i": c("fx") + F.floor(c("m.c") / 2), "j": c("fy") + c("m.c") % 2, "flag": c("p.flag")}
    if nearest:
        said |= {"px": said["i"].cast("double"), "py": said["j"].cast("double"), "spread": F.when(c("p.sx").isNotNull(), 1.0).otherwise(0.0)}
    else:
        rows = rows.withColumn("us", F.zip_with("ps", "ws", lambda p, w: F.when(p["sx"].isNotNull(), w)))
        said |= {f"p_{v}": F.try_divide(added(F.zip_with("ps", "us", weighed(v))), added(c("us"))) for v in SPREADS}
        # of all four corners, over the weight of the valid ones
        said |= {"px": c("x") / c("total"), "py": c("y") / c("total"), "spread": added(c("us")) * c("copies")}
    return rows.withColumns(said).withColumns({"begin": begin, "finish": finish}).drop(*on, "m", "p", "ps", "ws", "us", "total")


def collocate(records: DataFrame, product: DataFrame, spans: DataFrame, shape: tuple[int, int], place: Callable[[Column, Column], tuple[Column, Column]], nearest: bool, delay: float | None = 0.0) -> DataFrame:
    """The match of each trajectory with each product, where there is one.

    records has traj, rec, t, x, y, lat, lon and static (a point that holds still: its time is the product's
    first, and it ends where it begins); product has prod, cx, cy, lat, lon, t0, t1, dx, dy, sx, sy, cxy and flag,
    dx null where there is no vector; spans has prod and its reference times r0 and r1. Times are
    seconds. `nearest` takes the closest corner, within 40 km and if all four are valid, else the corners' bilinear mean,
    where the valid ones weigh over 0.99. delay is None for a flat collocation (both times are the references), else hours that are
    added to the product's times.
    """
    nx, ny = shape
    c = F.col
    product = cut_lineage(product)  # a row a cell
    mesh, good = meshes(product), product.where("dx is not null")
    if product.count() <= SMALL:
        mesh = F.broadcast(mesh)
    shift = None if delay is None else delay * 3600
    spans = spans.join(good.groupBy("prod").agg(F.min("t0").alias("a"), F.max("t0").alias("b")), "prod")
    spans = cut_lineage(spans.select("prod", "r0", "r1", F.least("a", "r1").alias("low"), F.greatest("b", "r0").alias("high")))  # a row a product

    # repeated records weigh as often as they are there
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = Window.partitionBy("traj", "t", "rec", "lat", "lon", "static")
    dealt = records.repartition(n, "traj").withColumn("copies", F.count(F.lit(1)).over(same)).withColumn("k", F.row_number().over(same.orderBy("x", "y"))).where("k = 1").drop("k")
    dealt = dealt.withColumn("last", F.max("t").over(Window.partitionBy("traj")))

    # records whose time can be the product's: by buckets of days; points that hold still meet every product
    day = 86400
    days = F.sequence(F.floor((c("low") - START_S) / day), F.floor((c("high") + START_S) / day))
    wide = spans.withColumn("bucket", F.explode(F.array_append(days, F.lit(-1).cast("bigint"))))
    inside = (F.floor("x") >= 0) & (F.ceil("x") < nx) & (F.floor("y") >= 0) & (F.ceil("y") < ny)
    rows = dealt.where(inside).withColumn("bucket", F.when(c("static"), F.lit(-1).cast("bigint")).otherwise(F.floor(c("t") / day))).join(F.broadcast(wide), "bucket")
    time = F.when(c("static"), c("low")).otherwise(c("t"))
    rows = rows.withColumn("time", time).where((c("low") - c("time") <= START_S) & (c("time") - c("high") <= START_S))
    own = ["rec", "t", "x", "y", "lat", "lon", "static", "copies"]
    met = between(rows, mesh, nearest, shift, whole=False).select("prod", "traj", "last", *own, (c("time") - c("begin")).alias("off"))

    # in order of time, up to the first record that is no better and too late
    before = Window.partitionBy("prod", "traj").orderBy("t", "rec").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    worse = F.coalesce(F.abs("off") >= F.min(F.abs("off")).over(before), F.lit(False))
    met = met.withColumn("stop", worse & (c("off") > 0))
    met = met.withColumn("stopped", F.max("stop").over(upto))
    best = F.struct(F.abs("off").alias("gap"), *own, "last")
    first = met.groupBy("prod", "traj").agg(F.min_by(best, F.when(~c("stopped"), F.struct(F.abs("off"), "t", "rec"))).alias("m"), F.min(F.when(c("stopped"), F.struct("t", "rec"))).alias("from"))
    first = cut_lineage(first.where(c("m.gap") <= START_S).select("prod", "traj", "from", "m.*"))
    refs = F.broadcast(spans.select("prod", "r0", "r1", "high"))

    # from there, or from the first record that is too late for the product, or else over the whole trajectory
    late, bucket = c("high") + START_S, 6 * DURATION_S
    moving = between(first.where(~c("static")).join(refs, "prod"), mesh, nearest, shift)
    moving = moving.withColumn("after", F.when(c("from").isNull() & (c("last") > late), late)).withColumn("due", c("t") + (c("finish") - c("begin")))
    ask = moving.select("prod", "traj", "from", "after", "due", F.explode(F.sequence(F.floor((c("due") - DURATION_S) / bucket), F.floor((c("due") + DURATION_S) / bucket))).alias("bucket"))
    ends = records.select("traj", F.col("rec").alias("rec1"), F.col("t").alias("t_end"), F.floor(c("t") / bucket).alias("bucket"))
    ask = ask.join(ends, ["traj", "bucket"]).withColumn("gap", F.abs(c("t_end") - c("due")))
    ask = ask.where((c("gap") <= DURATION_S) & (c("from").isNull() | (F.struct(c("t_end").alias("t"), c("rec1").alias("rec")) >= c("from"))) & (c("after").isNull() | (c("t_end") > c("after"))))
    second = ask.groupBy("prod", "traj").agg(F.min(F.struct("gap", "t_end", "rec1")).alias("e"))
    both = first.drop("from", "last").join(second, ["prod", "traj"], "left").where(c("static") | c("e").isNotNull())
    both = between(both.join(refs, "prod"), mesh, nearest, shift)
    lat, lon = place(c("px"), c("py"))
    enough = c("spread") >= LEAST_WEIGHT
    both = both.withColumns({"t1": F.when(c("static"), c("t")).otherwise(c("e.t_end")), "rec1": F.when(c("static"), c("rec")).otherwise(c("e.rec1")), "b0": F.round("p_t0"), "b1": F.round("p_t1"), "lat0": lat, "lon0": lon})
    return both.select(
        "prod", "traj", F.col("rec").alias("rec0"), "rec1", "px", "py", F.col("p_dx").alias("dx"), F.col("p_dy").alias("dy"),
        *(F.when(enough, c(f"p_{v}")).otherwise(F.lit(-1.0)).alias(v) for v in SPREADS),
        "i", "j", "flag",
        haversine(c("lat"), c("lon"), c("lat0"), c("lon0")).alias("distance"), ((c("t") - c("b0")) / 3600).alias("dtb"), ((c("t1") - c("b1")) / 3600).alias("dte"),
    )
