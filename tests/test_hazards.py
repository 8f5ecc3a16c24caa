
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.functions import calendars, dims, geo
from spindrift.operators import merge, spatial, stencil, tracking, trajectory, winds


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_h1_null_and_nan_are_masked(spark):
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        assert value(spark, merge.usable(F.lit(0), F.lit(1.0), bad)) is False
    assert value(spark, merge.usable(F.lit(0), F.lit(1.0), F.lit(2.0))) is True


def test_h2_no_neighbour_gives_null_and_zero_is_a_value(spark):
    df = spark.createDataFrame([(0, 0, None), (9, 9, 0.0), (8, 9, None)], "x int, y int, dx double")
    got = {(r.x, r.y): r.dx for r in merge.gaussian_fill(df, df.where("dx is not null"), 2, 1.0, "dx").collect()}
    assert got == {(0, 0): None, (9, 9): 0.0, (8, 9): 0.0}


def test_h4_bearing_carries_half_a_turn(spark):
    assert abs(value(spark, geo.bearing(F.lit(10.0), F.lit(0.0), F.lit(9.0), F.lit(0.0))) % 360) < 1e-9  # southwards


def test_h5_rows_run_downwards_in_grid_places(spark):
    x, y = geo.to_cell(F.lit(75000.0), F.lit(-75000.0), 0.0, 75.0, 0.0, 75.0)
    assert (value(spark, x), value(spark, y)) == (1.0, 1.0)


@pytest.mark.parametrize(("step", "radius", "n"), [(75.0, 100.0, 4), (62.5, 100.0, 8)])
def test_h7_neighbours_within_a_radius(step, radius, n):
    assert len(merge.offsets(radius / step)) - 1 == n


def test_h9_outside_pixels_alone_are_skipped(spark):
    px = spark.createDataFrame([(1, x, y, float(x)) for x in range(6) for y in range(6)], "image int, x int, y int, v double")
    got = {(r.x, r.y): r for r in stencil.laplacian(px).collect()}
    assert len(got) == 36 and got[2, 2].flag == 0 and abs(got[2, 2].lap) < 1e-12 and got[0, 0].flag == 1
    assert got[0, 2].flag == 0


def test_h12_the_simplex_rescores_and_converges():
    at, best, good = tracking.climb(lambda d: float(-((d[0] - 1) ** 2) - 3 * (d[1] + 2) ** 2), np.array([[0, 0], [1, 0], [0, 1.0]]))
    assert good and np.allclose(at, [1, -2], atol=0.01) and abs(best) < 1e-4


def fixes(hours):
    return pd.DataFrame([(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), 80 + i * 0.01, 10.0) for i, h in enumerate(hours)], columns=["traj_id", "rec_id", "ts", "lat", "lon"])


def test_h13_two_ways_with_repeated_times():
    t = fixes([0, 1, 1, 2, 3])
    assert 1 not in set(trajectory.settle(t).rec_id) and 2 not in set(trajectory.settle(t).rec_id)
    assert 1 in set(trajectory.gate(t).rec_id) and 2 not in set(trajectory.gate(t).rec_id)


def test_h15_unknown_sources_rank_last(spark):
    assert [value(spark, dims.source_rank(F.lit(s))) for s in ("gps", "wsm", "argos", "irid")] == [1, 2, 3, 4]


def test_h20_deviation_conventions(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0)], "k int, v double")
    r = df.agg(F.stddev_samp("v").alias("s"), F.stddev_pop("v").alias("p")).first()
    assert abs(r.s - 2**0.5) < 1e-12 and r.p == 1.0


def test_h22_season_bounds_are_inclusive(spark):
    season = lambda d: value(spark, calendars.merge_season(F.lit(d).cast("date"), F.lit("nh")))
    assert [season(d) for d in ("2019-04-01", "2019-04-02", "2019-09-01", "2019-09-02", "2019-10-31", "2019-11-01")] == ["winter", "spring", "summer", "autumn", "autumn", "winter"]


def test_h23_discs_are_integer_euclid():
    assert len(merge.offsets(75 / 12.5)) == 113 and (6, 0) in merge.offsets(6.0) and (5, 4) not in merge.offsets(6.0)


def test_h27_no_usable_start_is_flag_9():
    assert tracking.track(np.full((6, 6), np.nan), np.ones((6, 6)), 3.0)[3] == 9


def test_unmapped_flags_are_null(spark):
    df = spark.createDataFrame([(0,), (99,)], "flag int")
    assert {r.flag: r.final_flag for r in merge.to_final(df, dims.final_flags(spark)).collect()} == {0: 30, 99: None}


def test_radius_join_against_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-20, 20, (80, 2)), rng.uniform(-20, 20, (60, 2))
    da = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id int, x double, y double")
    db = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "sid int, sx double, sy double")
    got = {(r.id, r.sid) for r in spatial.within(da, db, 5.0).collect()}
    assert got == {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if ((p - q) ** 2).sum() <= 25}
    plan = spatial.within(da, db, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_complex_fit_equals_numpy(spark):
    rng = np.random.default_rng(2)
    w = rng.normal(size=30) + 1j * rng.normal(size=30)
    z = (0.8 + 0.3j) * w + (0.1 - 0.2j) + 0.01 * (rng.normal(size=30) + 1j * rng.normal(size=30))
    df = spark.createDataFrame([(1, float(p.real), float(p.imag), float(q.real), float(q.imag)) for p, q in zip(w, z, strict=True)], "cell int, u double, v double, iu double, iv double")
    r = winds.fit(df, "cell", 10).first()
    want = np.linalg.lstsq(np.c_[w, np.ones(30)], z, rcond=None)[0]
    assert np.allclose([r.ar + 1j * r.ai, r.cr + 1j * r.ci], want)
    assert winds.fit(df, "cell", 30).count() == 0
