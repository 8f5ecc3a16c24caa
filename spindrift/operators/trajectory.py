"""Trajectories: steps between records, filters by velocity, selections and as-of joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.geo import haversine
from spindrift.runtime import ship


def seconds(ts: Column) -> Column:
    """Seconds since 1970 with their fraction, of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts) / 1e6


def steps(df: DataFrame, traj: str = "traj_id", rec: str = "rec_id") -> DataFrame:
    """df with dist (km), dt (s) and speed (km/h) since the record before; null for the first."""
    w = Window.partitionBy(traj).orderBy("ts", rec)
    lag = lambda c: F.lag(c).over(w)
    rows = df.withColumns({"_lat": lag("lat"), "_lon": lag("lon"), "_s": lag(seconds(F.col("ts")))})
    rows = rows.withColumns({"dist": haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")), "dt": seconds(F.col("ts")) - F.col("_s")})
    return rows.withColumn("speed", F.try_divide(F.col("dist"), F.col("dt") / 3600)).drop("_lat", "_lon", "_s")


def one_pass(df: DataFrame, traj: str = "traj_id", rec: str = "rec_id") -> DataFrame:
    """One pass of the filter: rows that share a time go, and rows that stand still or are too fast, with the row before each."""
    rows = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(traj, "ts"))).where("_n = 1").drop("_n")
    rows = steps(rows, traj, rec)
    whole = Window.partitionBy(traj)
    mean = F.avg("speed").over(whole)
    speed = F.coalesce("speed", mean)
    bad = (F.coalesce("dist", F.lit(1.0)) == 0) | (speed > mean + 3 * F.stddev_samp("speed").over(whole))
    rows = rows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    rows = rows.withColumn("_next", F.coalesce(F.lead("_bad").over(Window.partitionBy(traj).orderBy("ts", rec)), F.lit(False)))
    return rows.where("not _bad and not _next").drop("_bad", "_next")


def _distance(lat0, lon0, lat1, lon1):
    p0, p1 = np.radians(lat0), np.radians(lat1)
    a = np.sin((p1 - p0) / 2) ** 2 + np.cos(p0) * np.cos(p1) * np.sin(np.radians(lon1 - lon0) / 2) ** 2
    return 2 * 6371.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def settle(t: pd.DataFrame) -> pd.DataFrame:
    """one_pass on one trajectory until no row goes any more."""
    t = t.sort_values(["ts", "rec_id"], kind="stable")
    while True:
        n = len(t)
        t = t[~t["ts"].duplicated(keep=False)]
        if len(t) > 1:
            dist = _distance(*(t[c].to_numpy()[:-1] for c in ("lat", "lon")), *(t[c].to_numpy()[1:] for c in ("lat", "lon")))
            hours = np.diff(t["ts"].to_numpy()).astype("timedelta64[us]").astype(float) / 3.6e9
            speed = dist / hours
            limit = speed.mean() + 3 * speed.std(ddof=1) if len(speed) > 1 else np.inf
            bad = np.r_[False, (dist == 0) | (speed > limit)]
            t = t[~(bad | np.r_[bad[1:], False])]
        if len(t) == n:
            return t


def gate(t: pd.DataFrame) -> pd.DataFrame:
    """Skips records reached faster than mean + 3 std, walking forwards and backwards; the direction that keeps more wins."""
    t = t.sort_values(["ts", "rec_id"], kind="stable").drop_duplicates("ts")
    if len(t) < 3:
        return t
    lat, lon = t["lat"].to_numpy(), t["lon"].to_numpy()
    hours = t["ts"].to_numpy().astype("datetime64[us]").astype(float) / 3.6e9
    speed = _distance(lat[:-1], lon[:-1], lat[1:], lon[1:]) / np.diff(hours)
    limit = speed.mean() + 3 * speed.std()

    def walk(order):
        kept = [order[0]]
        for k in order[1:]:
            j = kept[-1]
            if _distance(lat[j], lon[j], lat[k], lon[k]) / abs(hours[k] - hours[j]) <= limit:
                kept.append(k)
        return sorted(kept)

    ahead, back = walk(list(range(len(t)))), walk(list(range(len(t)))[::-1])
    return t.iloc[ahead if len(ahead) >= len(back) else back]


def by_trajectory(df: DataFrame, f, traj: str = "traj_id") -> DataFrame:
    """f on each trajectory, whole in one task: a buoy has thousands of records at most."""
    ship(df.sparkSession)
    return df.groupBy(traj).applyInPandas(f, df.schema)


def coverage(df: DataFrame, traj: str = "traj_id") -> DataFrame:
    """traj, its extent in place and time, and its area; `refused` marks one that does not lie on one side of the equator."""
    got = df.groupBy(traj).agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    north, south = (F.col("lat_min") > 0) & (F.col("lat_max") > 0), (F.col("lat_max") < 0) & (F.col("lat_min") < 0)
    area = F.when(north, "Northern Hemisphere").when(south, "Southern Hemisphere")
    return got.withColumn("area", area).withColumn("refused", F.col("area").isNull())


def nearest_in_time(left: DataFrame, right: DataFrame, key: str, within: float, left_id: str, right_id: str, left_ts: str = "ts", right_ts: str = "rts") -> DataFrame:
    """Each left row with the right row of its key nearest in time, not further than `within` seconds.

    Both sides are cut into buckets as wide as the limit, and a left row looks into three: the join
    stays an equi-join whose groups are bounded in time, however long a key's record is.
    """
    bucket = lambda c: F.floor(seconds(F.col(c)) / within)
    a = left.withColumn("_b", F.explode(F.sequence(bucket(left_ts) - 1, bucket(left_ts) + 1)))
    b = right.withColumn("_b", bucket(right_ts))
    gap = F.abs(seconds(F.col(right_ts)) - seconds(F.col(left_ts)))
    rows = a.join(b, [key, "_b"]).withColumn("gap", gap).where(F.col("gap") <= within)
    best = rows.groupBy(left_id).agg(F.min(F.struct("gap", right_id)).alias("m"))
    return best.select(left_id, F.col("m.gap").alias("gap"), F.col(f"m.{right_id}").alias(right_id))
