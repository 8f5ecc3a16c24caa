"""The daily chain as streams: freshest input, merge by day and cell with late data, steps along trajectories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.operators.merge import merged
from spindrift.runtime import ship

DELAY = "2 days"
QUIET_MS = 90 * 86_400_000  # of event time, after which a trajectory is over


def read_daily(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def first_of_each(stream: DataFrame, time: str, *keys: str) -> DataFrame:
    """One row for each key within the delay: repeats are dropped as they come."""
    return stream.withWatermark(time, DELAY).dropDuplicatesWithinWatermark(list(keys))


def merge_stream(stream: DataFrame, cell: str = "cell", time: str = "t0", lat: Column | None = None, wind: Column | None = None) -> DataFrame:
    """The merge by day and cell under the batch's own masks; a day is final once the watermark has passed it."""
    got = stream.withWatermark(time, DELAY).groupBy(F.window(time, "1 day"), cell).agg(*merged(lat, wind))
    return got.select(F.col("window.start").alias("day"), cell, "dx", "dy", "sigma", "flag", "no_fill", "n_used")


_OUT = "traj_id bigint, rec_id bigint, dist double, dt double"
#: The last record that steps were given from (at, rec, lat, lon; at is null before the first) and those that wait, in microseconds.
_KEPT = "at bigint, lat double, lon double, ats array<bigint>, recs array<bigint>, lats array<double>, lons array<double>"


def _steps(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Records wait until the watermark has passed them, as no earlier one can come then, and leave in order of time."""
    from spindrift.operators.trajectory import _distance

    at, lat, lon, ats, recs, lats, lons = state.get if state.exists else (None, None, None, [], [], [], [])
    wait = pd.DataFrame({"at": list(ats), "rec": list(recs), "lat": list(lats), "lon": list(lons)})
    if not state.hasTimedOut:
        new = pd.concat(list(batches))
        us = new["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        in_time = np.ones(len(us), bool) if at is None else us > at  # the others come after the step they belong in has left
        wait = pd.concat([wait, pd.DataFrame({"at": us, "rec": new["rec_id"], "lat": new["lat"], "lon": new["lon"]})[in_time]])
    wait = wait.astype({"at": "int64", "rec": "int64", "lat": float, "lon": float}).sort_values(["at", "rec"], kind="stable")
    passed = state.getCurrentWatermarkMs()
    go = wait[wait["at"] < passed * 1000]
    wait = wait.iloc[len(go) :]
    if len(go):
        first = [[x] if at is not None else [] for x in (at, lat, lon)]
        when, y, x = (np.r_[f, go[c].to_numpy()] for f, c in zip(first, ("at", "lat", "lon"), strict=True))
        dist = _distance(y[:-1], x[:-1], y[1:], x[1:])
        out = go.iloc[len(go) - len(dist) :]
        yield pd.DataFrame({"traj_id": key[0], "rec_id": out["rec"].to_numpy(), "dist": dist, "dt": np.diff(when) / 1e6})
        at, lat, lon = int(when[-1]), float(y[-1]), float(x[-1])
    if wait.empty and state.hasTimedOut and at is not None and at // 1000 + QUIET_MS <= passed:
        state.remove()  # nothing has come for long: the next record begins anew
        return
    if wait.empty and at is None:
        return
    state.update((at, lat, lon, wait["at"].tolist(), wait["rec"].tolist(), wait["lat"].tolist(), wait["lon"].tolist()))
    due = wait["at"].iloc[0] // 1000 + 1 if len(wait) else at // 1000 + QUIET_MS
    state.setTimeoutTimestamp(int(max(due, passed + 1)))


def step_stream(stream: DataFrame) -> DataFrame:
    """Distance and time since a trajectory's record before, for records in any order within DELAY.

    A record may come later than that as long as no step beyond it has left; else it is left out. The state of a trajectory is its last record and those that
    wait; it goes when nothing has come for QUIET_MS, so a trajectory that starts again after that has no step into its first record.
    """
    ship(stream.sparkSession)
    timed = stream.withWatermark("ts", DELAY)
    return timed.groupBy("traj_id").applyInPandasWithState(_steps, _OUT, _KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there, into a table in memory: for tests and small replays."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
