import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import calendars, dims, geo, names, selectors
from spindrift.operators import merge, tracking, trajectory


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(
    ("code", "year", "first", "last"),
    [
        ("H1", 2012, "2012-01-01", "2012-06-30"), ("H2", 2013, "2013-07-01", "2013-12-31"), ("Q1", 2012, "2012-01-01", "2012-03-31"), ("Q2", 2012, "2012-04-01", "2012-06-30"),
        ("Q3", 2012, "2012-07-01", "2012-09-30"), ("Q4", 2012, "2012-10-01", "2012-12-31"), ("Y", 2009, "2009-01-01", "2009-12-31"), ("M2", 2008, "2008-02-01", "2008-02-29"),
        ("M2", 2007, "2007-02-01", "2007-02-28"), ("M7", 2010, "2010-07-01", "2010-07-31"), ("M11", 2019, "2019-11-01", "2019-11-30"),
    ],
)
def test_periods(spark, code, year, first, last):
    a, b = calendars.decode_period(F.lit(code), F.lit(year))
    r = one(spark, a=a.cast("string"), b=b.cast("string"))
    assert (r.a, r.b) == (first, last)


@pytest.mark.parametrize(("code", "year", "want"), [("Y", 2010, ("Y", 2009)), ("M11", 2019, ("M10", 2019)), ("M1", 2008, ("M12", 2007)), ("H1", 2005, ("H2", 2004)), ("H2", 2005, ("H1", 2005)), ("Q1", 2005, ("Q4", 2004)), ("Q3", 2010, ("Q2", 2010))])
def test_period_before(spark, code, year, want):
    n, y = calendars.previous_period(F.lit(code), F.lit(year))
    r = one(spark, n=n, y=y)
    assert (r.n, r.y) == want


def test_seasons_and_fractions(spark):
    rows = [("nh", d) for d in ("2019-01-15", "2019-04-01", "2019-05-01", "2019-06-01", "2019-10-01", "2019-11-01")] + [("sh", d) for d in ("2019-01-15", "2019-06-01", "2019-11-01")]
    df = spark.createDataFrame(rows, "area string, d string").withColumn("d", F.col("d").cast("date"))
    got = df.select(calendars.merge_season(F.col("d"), F.col("area")).alias("s"), calendars.winter_fraction(F.col("d"), F.col("area")).alias("w"), calendars.summer_hold(F.col("d"), F.col("area")).alias("h")).collect()
    assert [r.s for r in got] == ["winter", "winter", "spring", "summer", "autumn", "winter", "summer", "winter", "spring"]
    assert [r.w for r in got][:2] == [1.0, 1.0] and 0 < got[2].w < 1 and got[3].w == 0
    assert [r.h for r in got] == [False, False, True, True, True, False, True, False, True]


def test_projections_round_trip_and_known_points(spark):
    df = spark.range(0, 400).select((F.lit(50.0) + F.col("id") / 10.1).alias("lat"), (F.col("id") * 0.89 - 179).alias("lon"))
    for g in (geo.Laea(), geo.Stere()):
        x, y = g.forward(F.col("lat"), F.col("lon"))
        lat, lon = g.inverse(x, y)
        worst = df.select(F.max(F.abs(lat - F.col("lat"))).alias("a"), F.max(F.abs(lon - F.col("lon"))).alias("b")).first()
        assert worst.a < 1e-8 and worst.b < 1e-8
    south = geo.Laea(north=False)
    x, y = south.forward(F.lit(-75.0), F.lit(30.0))
    lat, lon = south.inverse(x, y)
    r = one(spark, x=x, y=y, lat=lat, lon=lon)
    assert abs(r.lat + 75) < 1e-8 and abs(r.lon - 30) < 1e-8 and r.x > 0 and r.y > 0
    x, y = geo.Stere().forward(F.lit(70.0), F.lit(-45.0))
    assert abs(one(spark, y=y).y + 2187.7e3) < 1e4  # the circle of true scale
    assert abs(one(spark, d=geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))).d - 6371 * math.pi / 2) < 1e-6
    assert abs(one(spark, d=geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).d - 180) < 1e-9  # north plus half a turn


def test_small_geometry(spark):
    assert one(spark, a=geo.round_significant(F.lit(1234.5), 2)).a == 1200
    assert one(spark, a=geo.round_significant(F.lit(0.0), 2)).a == 0
    assert [one(spark, a=geo.wrap_any(F.lit(v))).a for v in (180.0, -190.0, 540.0)] == [-180, 170, -180]
    assert abs(one(spark, a=geo.max_drift_km(F.lit(1))).a - 38.88) < 1e-9
    assert one(spark, a=geo.sigmoid(F.lit(1e6), F.lit(0.0))).a < 1e-300
    c = one(spark, c=geo.corners(F.lit(1.25), F.lit(2.5))).c
    assert abs(sum(x.weight for x in c) - 1) < 1e-12 and {(x.cx, x.cy) for x in c} == {(1, 2), (2, 2), (1, 3), (2, 3)}


def test_candidates_of_the_coarse_search():
    assert len(tracking.candidates(38.88)) == 32


def test_selectors_and_their_complement(spark):
    df = spark.createDataFrame([(i, f, lon) for i, (f, lon) in enumerate(zip([0, 0, 13, 17, 0, 0, 12, 0, 0, 17], range(-45, 55, 10), strict=True))], "id int, flag int, lon int").withColumn("lat", F.lit(81))
    assert df.where(selectors.equals("flag", 17)).count() == 2
    inside = selectors.box("lat", 70, 85) & selectors.lon_box("lon", -30, 10)
    assert df.where(inside).count() + df.where(~inside).count() == 10 and df.where(inside).count() == 4
    for bad in (lambda: selectors.box("lat", 80, 70), lambda: selectors.lon_box("lon", 10, -10), lambda: selectors.fold([("or", F.lit(True))])):
        with pytest.raises(ValueError):
            bad()


def test_names(spark):
    name = names.drift_name(F.lit("amsr2-gw1"), F.lit("37"), F.lit("nh"), F.lit("2019010112"), F.lit("2019010312"))
    r = one(spark, **names.split_drift_name(name))
    assert (r.sensor, r.area, r.start, r.stop, r.level) == ("amsr2-gw1", "nh", "2019010112", "2019010312", "lev2")
    assert one(spark, a=names.split_drift_name(F.lit("other.nc"))["sensor"]).a is None
    ok = [one(spark, a=names.instrument_ok(F.lit(i), F.lit(p))).a for i, p in (("ssmi", "f15"), ("ssmi", "f16"), ("ssmis", "f17"), ("amsr2", "gw1"), ("ascat", "metopA"), ("ssmi", "gw1"))]
    assert ok == [True, False, True, True, True, False]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "cell int, sensor int, dx double, dy double, sigma double, flag int")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(0.5, 40), st.sampled_from([0, 13, 17, 3, 20])), min_size=1, max_size=8))
def test_inverse_variance_against_plain_python(spark, rows):
    got = merge.inverse_variance(vectors(spark, [(1, i, x, -x, s, f) for i, (x, s, f) in enumerate(rows)]), "cell").first()
    used = [(x, s) for x, s, f in rows if f not in dims.NO_FILL]
    assert got.n_used == len(used) and got.no_fill == int(any(f in dims.NO_FILL for _, _, f in rows))
    if used:
        w = [1 / s**2 for _, s in used]
        assert abs(got.dx - sum(a * x for a, (x, _) in zip(w, used, strict=True)) / sum(w)) < 1e-5 and abs(got.sigma - 1.5 / math.sqrt(sum(w))) < 1e-5
    else:
        assert got.dx is None and got.flag == dims.REMOVED


def test_masked_values_take_no_part(spark):
    got = merge.inverse_variance(vectors(spark, [(1, 1, float("nan"), 1.0, 1.0, 0), (1, 2, None, 1.0, 1.0, 0), (1, 3, 4.0, 2.0, 60.0, 0), (1, 4, 5.0, 3.0, 2.0, 0)]), "cell").first()
    assert (got.dx, got.dy, got.n_used) == (5.0, 3.0, 1)


def test_coverage_without_ice_is_null(spark):
    assert merge.coverage(vectors(spark, [(1, 1, 0.0, 0.0, 1.0, 3)]), "sensor").first().ratio is None


def test_gapfill_keeps_what_is_there(spark):
    df = spark.createDataFrame([(x, y, float(x) if (x + y) % 3 else None) for x in range(6) for y in range(6)], "x int, y int, dx double")
    got = {(r.x, r.y): r for r in merge.gaussian_fill(df, df.where("dx is not null"), 2, 1.5, "dx").collect()}
    assert len(got) == 36 and all(got[x, y].dx == x and not got[x, y].dx_filled for x in range(6) for y in range(6) if (x + y) % 3)
    assert all(got[x, y].dx is not None and got[x, y].dx_filled for x in range(6) for y in range(6) if (x + y) % 3 == 0)
    assert len(merge.offsets(6)) == 113 and len(merge.offsets(3)) == 29


def fixes(rows):
    import pandas as pd

    return pd.DataFrame([(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), lat, lon) for i, (h, lat, lon) in enumerate(rows)], columns=["traj_id", "rec_id", "ts", "lat", "lon"])


def test_trajectory_filters(spark):
    rng = np.random.default_rng(1)
    rows = [(h, 80 + h * 0.01 + rng.normal() * 1e-4, 10 + h * 0.02) for h in range(60)]
    rows[30] = (30, 70.0, 40.0)
    rows += [(10, 80.0, 10.0)]  # the same time twice: both go
    t = fixes(rows)
    settled = trajectory.settle(t)
    assert 30 not in set(settled.rec_id) and not {10, 60} & set(settled.rec_id) and len(settled) >= 54
    gated = trajectory.gate(t)
    assert 30 not in set(gated.rec_id) and len(gated) == 59
    df = spark.createDataFrame(t).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    whole = trajectory.by_trajectory(df, trajectory.settle)
    assert {r.rec_id for r in whole.collect()} == set(settled.rec_id)
    once = trajectory.one_pass(df)
    assert set(settled.rec_id) <= {r.rec_id for r in once.collect()}


def test_known_shift_is_tracked():
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:24, 0:24].astype(float)
    waves = [(rng.uniform(0.2, 0.7), rng.uniform(0.2, 0.7), rng.uniform(0, 6)) for _ in range(8)]
    image = lambda dx, dy: sum(np.sin(a * (x - dx) + b * (y - dy) + c) for a, b, c in waves)
    dx, dy, rho, flag = tracking.track(image(0, 0), image(1.3, -0.6), 3.0)
    assert flag == 0 and rho > 0.9 and abs(dx - 1.3) < 0.15 and abs(dy + 0.6) < 0.15  # bilinear sampling pulls an optimum by a seventh of a pixel
    assert tracking.track(np.full((8, 8), np.nan), image(0, 0)[:8, :8], 3.0)[3] == 9
    cov = tracking.covariance(lambda d: float(-(d[0] ** 2) - 0.5 * d[1] ** 2), np.zeros(2))
    assert np.allclose(cov, [[0.5, 0], [0, 1]], atol=1e-3)
    assert tracking.covariance(lambda d: 0.0, np.zeros(2)) is None


def test_outliers_are_corrected():
    import pandas as pd

    v = pd.DataFrame([(x, y, 5.0 + 0.1 * x, 1.0, 0) for x in range(6) for y in range(6)], columns=["x", "y", "dx", "dy", "flag"])
    v.loc[(v.x == 3) & (v.y == 3), ["dx", "dy"]] = 60.0, -40.0
    got = tracking.correct(v).set_index(["x", "y"])
    assert got.loc[(3, 3), "flag"] == 13 and abs(got.loc[(3, 3), "dx"] - 5.3) < 0.2
    assert (got.flag == 0).sum() == 31 and (got.flag == 14).sum() == 4  # a corner has three neighbours


def test_uncertainty_tables():
    assert len(dims.SIGMAS) == 32 and len(dims.FINAL_FLAG) == 23 and dims.FINAL_FLAG[16] == 22


def test_correction_ends_with_no_outlier_left():
    import pandas as pd

    n = 130
    y, x = np.divmod(np.arange(n * n), n)
    d = np.random.default_rng(9).normal(0, 200, (n * n, 2))
    got = tracking.correct(pd.DataFrame({"x": x, "y": y, "dx": d[:, 0], "dy": d[:, 1], "flag": 0}))
    assert (got["flag"] != 0).sum() > 10_000
    flag, dx, dy = (got[c].to_numpy().reshape(n, n) for c in ("flag", "dx", "dy"))
    held, good = np.pad(np.isin(flag, (0, 13)), 1), np.pad(np.isin(flag, (0, 13, 14)), 1)  # 14 is given out at the end, for want of a mean of its own
    dx, dy = np.pad(dx, 1), np.pad(dy, 1)
    for i, j in np.argwhere(held):
        near = good[i - 1 : i + 2, j - 1 : j + 2].copy()
        near[1, 1] = False
        if near.sum() >= 5:
            off = [a[i, j] - a[i - 1 : i + 2, j - 1 : j + 2][near].mean() for a in (dx, dy)]
            assert np.hypot(*off) <= 10 + 1e-6


def test_correlation_is_the_mean_of_bands_that_are_there():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 10, 10)), rng.normal(size=(2, 10, 10))
    one = [tracking.similarity(a[k], b[k], np.zeros(2), 3.0) for k in range(2)]
    assert abs(tracking.similarity(a, b, np.zeros(2), 3.0) - np.mean(one)) < 1e-9
    core = (slice(2, 8), slice(2, 8))
    assert abs(one[0] - ((np.corrcoef(a[0][core].ravel(), b[0][core].ravel())[0, 1] + 1) * tracking.fade(np.zeros(2), 3.0) - 1)) < 1e-9
    gone = b.copy()
    gone[0, 2:5, 2:6] = np.nan  # 12 of the 36 pixels of a band: it does not count
    assert abs(tracking.similarity(a, gone, np.zeros(2), 3.0) - one[1]) < 1e-9
    gone[1, 2:5, 2:6] = np.nan
    assert tracking.similarity(a, gone, np.zeros(2), 3.0) == -1.0
    p, q = a[0][core].ravel(), b[0][core].ravel()
    fit = np.polyfit(p, q, 1)
    assert abs(tracking.difference(a[0], b[0], np.zeros(2), 3.0) * tracking.fade(np.zeros(2), 3.0) - 0.5 * ((np.polyval(fit, p) - q) ** 2).sum()) < 1e-6


def test_posterior_flags():
    y, x = np.mgrid[0:12, 0:12].astype(float)
    image = np.sin(0.8 * x + 0.3 * y) + np.cos(0.5 * y - 0.7 * x) + 0.1 * np.random.default_rng(1).normal(size=x.shape)
    vx, vy, cov, flag = tracking.posterior(image, image, np.array([0.3, 0.2]), 3.0)
    assert flag in (0, 1) and (flag == 1) == (min(vx, vy) < 0)
    assert tracking.posterior(np.zeros((12, 12)), image, np.zeros(2), 3.0)[3] == 2


def test_outliers_are_found_anew_on_their_images():
    import pandas as pd

    rng = np.random.default_rng(3)
    v = pd.DataFrame([(x, y, 1.0 + 0.01 * rng.normal(), 0.5, 0.9, 0) for y in range(5) for x in range(5)], columns=["x", "y", "dx", "dy", "corr", "flag"])
    v.loc[[6, 18], "dx"] = 30.0
    asked = []

    def again(i, mean):
        asked.append(i)
        return tracking.Found(mean + 0.05, 0.8 if i == 6 else 0.2)

    got = tracking.correct(v, 10.0, again=again).set_index(["x", "y"])
    assert sorted(asked) == [6, 18]
    assert got.loc[(1, 1), "flag"] == 13 and abs(got.loc[(1, 1), "dx"] - 1.05) < 0.05 and got.loc[(1, 1), "corr"] == 0.8
    assert got.loc[(3, 3), "flag"] == 12 and got["flag"].value_counts().to_dict() == {0: 15, 14: 8, 13: 1, 12: 1}  # corners, and borders beside the one that went, have too few
    v["corr"] = 0.1  # no neighbour is sure enough to make a mean
    assert (tracking.correct(v, 10.0, again=again)["flag"] == 14).all()


def brute_correct(v, furthest, least, again, correlation, mean_correlation):
    """Every mean and every distance by loops over the whole grid, one step after another."""
    at = {(r.x, r.y): [r.dx, r.dy, r.corr, r.flag, None, None, 0] for r in v.itertuples()}  # dx, dy, corr, flag, mean, distance, count
    ring = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j) != (0, 0)]

    def mean(p, kinds):
        some = [at[q] for i, j in ring if (q := (p[0] + i, p[1] + j)) in at and at[q][3] in kinds and at[q][2] >= mean_correlation]
        c = at[p]
        c[6] = len(some)
        c[4] = (sum(s[0] for s in some) / len(some), sum(s[1] for s in some) / len(some)) if some else None
        c[5] = -2 if len(some) < least else float("inf") if c[0] != c[0] else ((c[0] - c[4][0]) ** 2 + (c[1] - c[4][1]) ** 2) ** 0.5

    order = sorted(at, key=lambda p: (p[1], p[0]))
    for p in order:
        mean(p, (0,))
    while True:
        p = max(order, key=lambda q: at[q][5])
        c = at[p]
        if c[5] <= furthest:
            break
        if c[3] == 12:
            c[5] = -3
            continue
        c[3] = 12
        got = again(p, c[4])
        if got and got[2] >= correlation:
            c[:4] = *got, 13
            c[5] = ((c[0] - c[4][0]) ** 2 + (c[1] - c[4][1]) ** 2) ** 0.5
        else:
            c[5] = -3
        for i, j in ring:
            if (p[0] + i, p[1] + j) in at:
                mean((p[0] + i, p[1] + j), (0, 13))
    for c in at.values():
        if c[3] in (0, 13):
            c[3] = 14 if c[6] < least else 10 if c[2] < correlation else c[3]
    return {p: c[:4] for p, c in at.items()}


def test_correction_matches_its_steps_one_by_one():
    import pandas as pd

    for seed in range(25):
        rng = np.random.default_rng(seed)
        rows = [(x, y, *rng.normal([3, -2], 1), rng.uniform(0.1, 1), 0) for y in range(9) for x in range(9) if rng.random() < 0.93]
        v = pd.DataFrame(rows, columns=["x", "y", "dx", "dy", "corr", "flag"])
        bad = rng.random(len(v)) < 0.25
        v.loc[bad, ["dx", "dy"]] += rng.normal(0, 25, (bad.sum(), 2))
        lost = rng.random(len(v)) < 0.06
        v.loc[lost, ["dx", "dy", "corr", "flag"]] = [np.nan, np.nan, -1.0, 9]
        v["flag"] = v["flag"].astype(int)
        table = {(r.x, r.y): (*rng.uniform(-4, 4, 2), rng.uniform(0, 1)) for r in v.itertuples()}
        where = {i: (r.x, r.y) for i, r in zip(v.index, v.itertuples(), strict=True)}

        def plain(p, m):
            return (m[0] + table[p][0], m[1] + table[p][1], table[p][2]) if p[0] != 4 else None  # noqa: B023

        def again(i, m):
            got = plain(where[i], m)  # noqa: B023
            return tracking.Found(np.array(got[:2]), got[2]) if got else tracking.Found(np.full(2, np.nan), -1.0, False)

        want = brute_correct(v, 6.0, 5, plain, 0.3, 0.25)
        got = tracking.correct(v, 6.0, 5, again=again, correlation=0.3, mean_correlation=0.25)
        assert {9, 12, 13, 14} & set(got["flag"])
        for r in got.itertuples():
            w = want[r.x, r.y]
            assert r.flag == w[3]
            if r.flag in (0, 13):
                assert np.allclose([r.dx, r.dy, r.corr], w[:3])


def test_optimum_about_a_mean_keeps_near_it():
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:24, 0:24].astype(float)
    waves = [(rng.uniform(0.2, 0.9), rng.uniform(-0.9, 0.9), rng.uniform(0, 6)) for _ in range(12)]
    image = lambda dx, dy: sum(np.sin(a * (x - dx) + b * (y - dy) + c) for a, b, c in waves)
    at, corr, good = tracking.optimum_near(image(0, 0), image(1.3, -0.6), np.array([1.8, -0.9]), 1.0)
    assert good and corr > 0.9 and np.hypot(at[0] - 1.3, at[1] + 0.6) < 0.3
    away = np.array([-1.5, 1.5])
    at, corr, good = tracking.optimum_near(image(0, 0), image(1.3, -0.6), away, 1.0)
    assert np.hypot(*(at - away)) < 1.2 and corr < 0.9  # the true motion lies beyond the sigmoid
    assert tracking.optimum_near(np.full((8, 8), np.nan), np.ones((8, 8)), away, 1.0)[2] is False


def test_merge_masks_the_pole_and_the_wind_without_footprint(spark):
    rows = [(1, 1, 4.0, 0.0, 1.0, 13, 88.0), (1, 7, 8.0, 0.0, 1.0, 0, 88.0), (2, 7, 8.0, 0.0, 1.0, 0, 70.0), (2, 2, 3.0, 0.0, 1.0, 6, 70.0), (3, 7, 5.0, 0.0, 1.0, 0, 70.0)]
    df = spark.createDataFrame(rows, "cell int, sensor int, dx double, dy double, sigma double, flag int, lat double")
    got = {r.cell: r for r in merge.inverse_variance(df, "cell", lat=F.col("lat"), wind=F.col("sensor") == 7).collect()}
    assert got[1].dx == 8.0 and got[1].n_used == 1 and got[1].flag == 0  # the satellite is masked at the pole but leaves its footprint
    assert got[2].dx == 3.0 and got[2].n_used == 1 and got[2].flag == 6
    assert got[3].dx is None and got[3].n_used == 0 and got[3].flag == 100


def test_defines_follow_long_chains_and_circles(spark):
    from spindrift.sources.text import defines

    lines = [f"#define A{i} A{i + 1}" for i in range(40)] + ["#define A40 end", "#define X Y", "#define Y X", "#define W X", "# no"]
    got = {r.key: r.value for r in defines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert all(got[f"A{i}"] == "end" for i in range(41)) and got["X"] is got["Y"] is got["W"] is None and len(got) == 44
