import numpy as np

from spindrift.operators import coarse, tracking
from spindrift.operators.merge import offsets


def pixels(spark, image, name, gaps=()):
    ny, nx = image.shape
    rows = [(name, x, y, None if (x, y) in gaps else float(image[y, x])) for y in range(ny) for x in range(nx)]
    return spark.createDataFrame(rows, "pair int, x int, y int, v double")


def plain(a, b, cell, moves, weights, pattern):
    """The score of each move at a cell, pixel by pixel."""
    out = []
    for d, w in zip(moves, weights, strict=True):
        p, s = [], []
        for i, j in pattern:
            x, y = cell[0] + i, cell[1] + j
            if not (0 <= x < a.shape[1] and 0 <= y < a.shape[0]) or np.isnan(a[y, x]):
                continue
            fx, fy = int(np.floor(x + d[0])), int(np.floor(y + d[1]))
            total = weight = 0.0
            for u in (0, 1):
                for v in (0, 1):
                    c = abs(1 - u - (x + d[0] - fx)) * abs(1 - v - (y + d[1] - fy))
                    if 0 <= fx + u < b.shape[1] and 0 <= fy + v < b.shape[0] and not np.isnan(b[fy + v, fx + u]):
                        total, weight = total + c * b[fy + v, fx + u], weight + c
            if weight > 0.75:
                p.append(a[y, x])
                s.append(total / weight)
        ok = len(p) >= 0.75 * len(pattern) and np.std(p) > 0 and np.std(s) > 0
        out.append((np.corrcoef(p, s)[0, 1] + 1) * w - 1 if ok else -1.0)
    return out


def test_rings_of_the_tracker_on_tiles_of_any_size(spark):
    """32 candidates within 38.88 km, patterns of 75 km, pixels of 12.5 km: the same cells, whatever the tiles."""
    rng = np.random.default_rng(4)
    big = rng.normal(size=(64, 70))
    big = sum(np.roll(big, (i, j), (0, 1)) for i in range(3) for j in range(3))
    a, b = big[2:52, 3:63], big[1:51, 1:61] + 0.1 * rng.normal(size=(50, 60))  # moved by (2, 1) pixels
    gaps = {(20, 20), (21, 20), (40, 7)}
    one, two = pixels(spark, a, 1, gaps), pixels(spark, b, 1)
    cells = spark.createDataFrame([(1, x, y) for x in range(0, 60, 6) for y in range(0, 50, 6)], "pair int, x int, y int")
    want = None
    for tile in (16, 25, 64):
        got = coarse.search(cells, one, two, 38.88, 75.0, spacing=12.5, tile=tile, keys=("pair",)).collect()
        rows = sorted((r.x, r.y, r.place, r.candidate, round(r.dx, 9), round(r.dy, 9), round(r.score, 9)) for r in got)
        assert want is None or rows == want
        want = rows
    rings = tracking.candidates(38.88)
    assert len(rings) == 32 and len(offsets(6.0)) == 113
    moves, weights = np.array(rings) / 12.5, [tracking.fade(np.array(d), 38.88) for d in rings]
    a = a.copy()
    for x, y in gaps:
        a[y, x] = np.nan
    for x, y in ((0, 0), (12, 18), (24, 24), (42, 6), (54, 48)):
        score = plain(a, b, (x, y), moves, weights, offsets(6.0))
        best = [k for k in sorted(range(32), key=lambda k: -score[k])[:3] if score[k] > -1]  # noqa: B023
        mine = [r for r in want if r[:2] == (x, y)]
        assert [r[3] for r in mine] == best and np.allclose([r[6] for r in mine], [score[k] for k in best])
    middle = [r for r in want if r[:3] == (30, 24, 1)][0]
    assert abs(middle[4] - 25) < 10 and abs(middle[5] - 12.5) < 10


def test_no_row_holds_an_image(spark):
    px = pixels(spark, np.arange(90.0 * 80).reshape(80, 90), 1)
    sizes = [len(r.a) for r in coarse.tiled(px, ("pair",), 16, 5, "a").collect()]
    assert max(sizes) <= 26 * 26 and sum(sizes) > 90 * 80
    plan = coarse.search(px.select("pair", "x", "y"), px, px, 20.0, 3.0, tile=16, keys=("pair",))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert coarse.search(px.select("pair", "x", "y").limit(0), px, px, 20.0, 3.0, keys=("pair",)).count() == 0
