import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import dims
from spindrift.operators import matchups, trajectory


def inside(t, v):
    """Probability of Student's distribution between -t and t, by integration."""
    x = np.linspace(0, math.atan(t / math.sqrt(v)), 40001)
    y = np.cos(x) ** (v - 1)
    h = x[1] - x[0]
    area = h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
    return 2 * area * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi)


def test_quantiles_of_few_and_many_degrees_of_freedom(spark):
    freedom = [1, 2, 3, 4, 5, 6, 7, 8, 15, 29, 30, 31, 40, 100, 5000]
    got = {r.v: r.t for r in spark.createDataFrame([(v,) for v in [0, *freedom]], "v long").select("v", matchups.t95(F.col("v")).alias("t")).collect()}
    assert got[0] is None
    assert all(abs(inside(got[v], v) - 0.95) < 2e-8 for v in freedom)


def test_regression_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x), float(2 * x - 1 + rng.normal()), float(rng.normal()), None if k % 5 == 0 else float(rng.normal())) for g, n in ((1, 3), (2, 9), (3, 200), (4, 2)) for k, x in enumerate(rng.normal(3, 2, n))]
    df = spark.createDataFrame(rows, "g int, vx double, px double, vy double, py double")
    got = {r.g: r for r in matchups.regression(df, ["g"], {"x": ("vx", "px"), "y": ("vy", "py")}).collect()}
    for g, r in got.items():
        for name, i, j in (("x", 1, 2), ("y", 3, 4)):
            pairs = np.array([(q[i], q[j]) for q in rows if q[0] == g and q[j] is not None])
            n = len(pairs)
            assert r[f"{name}_n"] == n
            if n < 3:
                assert r[f"{name}_a95"] is None
                continue
            x, y = pairs.T
            a, b = np.polyfit(x, y, 1)
            se = math.sqrt(((y - a * x - b) ** 2).sum() / (n - 2) / ((x - x.mean()) ** 2).sum())
            t = matchups.T95[n - 3] if n < 33 else None
            assert np.allclose([r[f"{name}_a"], r[f"{name}_b"]], [a, b])
            if t:
                assert np.allclose([r[f"{name}_a95"], r[f"{name}_b95"]], [t * se, t * se * math.sqrt((x**2).mean())])


def test_tables_of_modes_and_bands(spark):
    assert len(dims.sigmas_of()) == len(set(r[:5] for r in dims.sigmas_of())) == 32 + 2 * (12 * 3 + 2 * 2)
    assert len(dims.bands_of()) == 33 and sum(r[5] for r in dims.bands_of()) == 14
    name = lambda p: spark.range(1).select(dims.family(F.lit(p)).alias("f")).first().f
    assert [name(p) for p in ("ssmis-f18", "amsr2-gw1-tb37", "ascat-metopA", "ecmwf-era5", "wind", "multi")] == ["ssmi", "amsr2-gw1-bt37", "ascat", "wind", "wind", "multi"]


def test_trajectories_over_the_equator_are_refused(spark):
    rows = [(1, 5.0), (1, 9.0), (2, -5.0), (2, -1.0), (3, -1.0), (3, 1.0), (4, 0.0)]
    df = spark.createDataFrame(rows, "traj_id int, lat double").withColumns({"lon": F.lit(1.0), "ts": F.lit("2024-01-01").cast("timestamp_ntz")})
    assert {r.traj_id: (r.area, r.refused) for r in trajectory.coverage(df).collect()} == {1: ("Northern Hemisphere", False), 2: ("Southern Hemisphere", False), 3: (None, True), 4: (None, True)}


@pytest.mark.parametrize(("label", "colour"), [("GPS", "red"), ("argos", "blue"), ("none", "black"), (None, "black")])
def test_colours_of_labels(spark, label, colour):
    assert spark.range(1).select(matchups.colours(F.lit(label).cast("string")).alias("c")).first().c == colour
