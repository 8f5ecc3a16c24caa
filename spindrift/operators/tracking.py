"""The tracking kernel: displacement of a pattern between two images by maximum cross-correlation.

Candidates are ranked by Spark; from the best three a Nelder-Mead simplex climbs, and a Hessian at
the optimum gives the covariance. The climb and the correction of outliers are sequential, so they
run in numpy: the functions on one pair define them, and those on `Pairs` take the same steps for many pairs
side by side, which is what the tasks do. Where these do not end, a simplex has shrunk to the last digits of a
place that the score jumps at, so that rounding decides; the function on one pair has the last word there.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from spindrift.runtime import ship

OK, FAILED, LOW, REFUSED, CORRECTED, NO_MEAN = 0, 9, 10, 12, 13, 14
EDGE = 2  # pixels around the pattern, for which the other image is still there when it moves
MOST_STEPS, ABSOLUTE, RELATIVE, EPSILON = 1000, 1e-6, 1e-9, 1e-4
REFLECT, EXPAND, CONTRACT_OUT, CONTRACT_IN, SHRINK = 2.0, 3.0, 1.5, 0.5, 0.5


def candidates(limit: float, first: float = 5.0, step: float = 10.0) -> list[tuple[float, float]]:
    """Start displacements on rings of eight below the limit, every other ring turned by half a step."""
    out, ring, radius = [], 0, first
    while radius < limit:
        for k in range(8):
            a = 2 * np.pi * k / 8 + (np.pi / 8 if ring % 2 else 0.0)
            out.append((float(radius * np.cos(a)), float(radius * np.sin(a))))
        ring, radius = ring + 1, radius + step
    return out


def climb(score: Callable[[np.ndarray], float], start: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """Best point, its score, and whether the simplex converged; start holds three points."""
    pts = np.array(start, float)
    val = np.array([score(p) for p in pts])
    for _ in range(MOST_STEPS):
        order = np.argsort(-val, kind="stable")
        pts, val = pts[order], val[order]
        if abs(val[2] - val[0]) < abs(val[2] + val[0]) * RELATIVE + ABSOLUTE:
            return pts[0], float(val[0]), True
        centre = pts[:2].mean(0)
        along = lambda t, c=centre, w=pts[2]: w + t * (c - w)
        p = along(REFLECT)
        v = score(p)
        if v > val[0]:
            q = along(EXPAND)
            u = score(q)
            pts[2], val[2] = (q, u) if u > v else (p, v)
        elif v > val[1]:
            pts[2], val[2] = p, v
        else:
            q = along(CONTRACT_OUT if v > val[2] else CONTRACT_IN)
            u = score(q)
            if u > max(v, val[2]):
                pts[2], val[2] = q, u
            else:
                pts[1:] = pts[0] + SHRINK * (pts[1:] - pts[0])
                val[1:] = [score(p) for p in pts[1:]]
    return pts[0], float(val[0]), False


def shifted(image: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """The image sampled at (x + dx, y + dy) by bilinear weights of the pixels there are; NaN where these weigh 0.75 or less."""
    ny, nx = image.shape
    x, y = np.arange(nx)[None, :] + dx, np.arange(ny)[:, None] + dy
    fx, fy = np.floor(x).astype(int), np.floor(y).astype(int)
    total, weight = np.zeros(image.shape), np.zeros(image.shape)
    for i in (0, 1):
        for j in (0, 1):
            w = np.abs(1 - i - (x - fx)) * np.abs(1 - j - (y - fy))
            cx, cy = fx + i, fy + j
            ok = (cx >= 0) & (cx < nx) & (cy >= 0) & (cy < ny)
            v = image[np.clip(cy, 0, ny - 1), np.clip(cx, 0, nx - 1)]
            ok = ok & ~np.isnan(v)
            total += np.where(ok, w * np.nan_to_num(v), 0)
            weight += np.where(ok, w, 0)
    return np.where(weight > 0.75, total / np.where(weight > 0, weight, 1), np.nan)


def _paired(a: np.ndarray, b: np.ndarray, d: np.ndarray, edge: int):
    """For each band: the pattern, which is a without `edge` pixels on every side, b moved back by d there, and where both are there."""
    for one, two in zip(a, b, strict=True) if a.ndim == 3 else ((a, b),):
        core = (slice(edge, one.shape[0] - edge), slice(edge, one.shape[1] - edge))
        p, s = one[core], shifted(two, *d)[core]
        yield p, s, ~np.isnan(p) & ~np.isnan(s)


def fade(d: np.ndarray, limit: float, centre: np.ndarray | None = None) -> float:
    """The weight of a displacement: near 1 within the limit of `centre` (no motion, if none is given), near 0 beyond."""
    away = np.asarray(d, float) if centre is None else np.asarray(d, float) - centre
    return float(1 / (1 + np.exp(min(700.0, (float(np.hypot(*away)) - limit) * 10))))


def similarity(a: np.ndarray, b: np.ndarray, d: np.ndarray, limit: float, edge: int = EDGE, centre: np.ndarray | None = None) -> float:
    """Mean over the bands of the correlation of a's pattern with b, moved back by d, weighed down beyond the limit of `centre`.

    a and b are [y, x] or [band, y, x]. A band counts where three quarters of its pattern's pixels
    are there; -1 where none does.
    """
    found = []
    for p, s, ok in _paired(a, b, d, edge):
        if ok.sum() >= 0.75 * p.size and p[ok].std() > 0 and s[ok].std() > 0:
            found.append(float(np.corrcoef(p[ok], s[ok])[0, 1]))
    return (float(np.mean(found)) + 1) * fade(d, limit, centre) - 1 if found else -1.0


def difference(a: np.ndarray, b: np.ndarray, d: np.ndarray, limit: float, edge: int = EDGE, centre: np.ndarray | None = None) -> float:
    """Half the sum of squared differences after the best linear scaling of the pattern, over the weight of d; infinite without pixels."""
    total, found = 0.0, False
    for p, s, ok in _paired(a, b, d, edge):
        if ok.sum() >= 0.75 * p.size and p[ok].var() > 0:
            p, s, found = p[ok], s[ok], True
            alpha = ((p - p.mean()) * (s - s.mean())).mean() / p.var()
            total += 0.5 * float(((alpha * p + s.mean() - alpha * p.mean() - s) ** 2).sum())
    return total / max(fade(d, limit, centre), 1e-300) if found else float("inf")


#: The metrics that a displacement can be found by; climb looks for the greatest value.
METRICS: dict[str, Callable[..., float]] = {"CC": similarity, "SD": lambda *x, **y: -difference(*x, **y)}


def posterior(a: np.ndarray, b: np.ndarray, at: np.ndarray, limit: float, centre: np.ndarray | None = None) -> tuple[float, float, float, int]:
    """(variance of x, of y, covariance, flag) at a displacement: 0 fine, 1 a negative variance, 2 no inverse."""
    cov = covariance(lambda d: -difference(a, b, d, limit, centre=centre), np.asarray(at, float))
    if cov is None or not np.isfinite(cov).all():
        return float("nan"), float("nan"), float("nan"), 2
    return float(cov[0, 0]), float(cov[1, 1]), float(cov[0, 1]), int(min(cov[0, 0], cov[1, 1]) < 0)


def covariance(score: Callable[[np.ndarray], float], at: np.ndarray, e: float = EPSILON) -> np.ndarray | None:
    """Inverse of the negative Hessian by finite differences; None where it is singular."""
    f = lambda i, j: score(at + np.array([i * e, j * e]))
    xx = (f(1, 0) - 2 * f(0, 0) + f(-1, 0)) / e**2
    yy = (f(0, 1) - 2 * f(0, 0) + f(0, -1)) / e**2
    xy = (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / (4 * e**2)
    h = -np.array([[xx, xy], [xy, yy]])
    return np.linalg.inv(h) if abs(np.linalg.det(h)) > 1e-12 else None


def track(a: np.ndarray, b: np.ndarray, limit: float, metric: str = "CC", least: float = 0.3) -> tuple[float, float, float, int]:
    """(dx, dy, score, flag) of the motion from a to b, in pixels; flag 9 without a usable start, 10 below `least` (of CC)."""
    score = lambda d: METRICS[metric](a, b, np.asarray(d, float), limit)
    none = -1.0 if metric == "CC" else float("-inf")
    starts = [(0.0, 0.0), *candidates(limit, 0.75, 0.75)]
    best = sorted(starts, key=lambda d: -score(d))[:3]
    if score(best[0]) <= none:
        return float("nan"), float("nan"), none, 9
    at, value, good = climb(score, np.array(best) + np.array([[0, 0], [1e-3, 0], [0, 1e-3]]))
    flag = 9 if not good else 10 if metric == "CC" and value < least else 0
    return float(at[0]), float(at[1]), value, flag


class Pairs:
    """Image pairs [pair, y, x] of one size, whose displacements are scored side by side."""

    def __init__(self, a: np.ndarray, b: np.ndarray, edge: int = EDGE):
        self.a, self.b = a, b
        n, self.ny, self.nx = b.shape
        core = slice(edge, max(a.shape[1] - edge, edge)), slice(edge, max(a.shape[2] - edge, edge))
        self.x, self.y = np.arange(a.shape[2])[core[1]], np.arange(a.shape[1])[core[0]]
        p = a[:, *core].reshape(n, -1)
        self.there = ~np.isnan(p)
        self.pattern = np.where(self.there, p, 0.0)
        # a border of zeros without weight, where all that lies outside is read
        self.image, self.weight = (np.pad(np.where(np.isnan(b), 0.0, v), ((0, 0), (1, 1), (1, 1))).reshape(-1) for v in (np.nan_to_num(b), np.ones_like(b)))
        self.size = self.pattern.shape[1]

    def __len__(self) -> int:
        return len(self.pattern)

    def moved(self, rows: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patterns of the second images of some rows, moved back by d, 0 where too little is there, and where enough is."""
        x, y = self.x[None, :] + d[:, 0, None], self.y[:, None].T + d[:, 1, None]
        fx, fy = np.floor(x), np.floor(y)
        base = (rows * ((self.ny + 2) * (self.nx + 2)))[:, None, None]
        wx, wy = ([np.abs(1 - i - (v - f)) for i in (0, 1)] for v, f in ((x, fx), (y, fy)))
        px = [np.clip(fx + i, -1, self.nx).astype(np.int64) + 1 for i in (0, 1)]
        py = [(np.clip(fy + j, -1, self.ny).astype(np.int64) + 1) * (self.nx + 2) for j in (0, 1)]
        total, weight = 0.0, 0.0
        for i in (0, 1):
            for j in (0, 1):
                w = wx[i][:, None, :] * wy[j][:, :, None]
                at = base + py[j][:, :, None] + px[i][:, None, :]
                total = total + w * self.image.take(at)
                weight = weight + w * self.weight.take(at)
        ok = weight > 0.75
        return np.where(ok, total / np.where(weight > 0, weight, 1), 0.0).reshape(len(rows), -1), ok.reshape(len(rows), -1)

    def score(self, metric: str, rows: np.ndarray, d: np.ndarray, limit: float, centre: np.ndarray | None = None) -> np.ndarray:
        """METRICS[metric] of displacements d of the rows, each about its row of `centre`."""
        none = -1.0 if metric == "CC" else float("-inf")
        out = np.full(len(rows), none)
        step = max(1, CHUNK // max(self.size, 1))
        for k in range(0, len(rows) if self.size else 0, step):
            part = slice(k, k + step)
            some, move = rows[part], d[part]
            s, ok = self.moved(some, move)
            ok = ok & self.there[some]
            n = ok.sum(1)
            div = np.maximum(n, 1)[:, None]
            p, s = np.where(ok, self.pattern[some], 0.0), np.where(ok, s, 0.0)
            mp, ms = p.sum(1, keepdims=True) / div, s.sum(1, keepdims=True) / div
            u, v = np.where(ok, p - mp, 0.0), np.where(ok, s - ms, 0.0)
            uu, uv = (u * u).sum(1), (u * v).sum(1)
            away = move if centre is None else move - centre[part]
            fade_ = 1 / (1 + np.exp(np.minimum(700.0, (np.hypot(away[:, 0], away[:, 1]) - limit) * 10)))
            good = (n >= 0.75 * self.size) & (uu > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                if metric == "CC":
                    vv = (v * v).sum(1)
                    good &= vv > 0
                    value = (np.clip(uv / np.sqrt(uu) / np.sqrt(vv), -1, 1) + 1) * fade_ - 1
                else:
                    alpha = ((uv / div[:, 0]) / (uu / div[:, 0]))[:, None]
                    rest = np.where(ok, alpha * p + ms - alpha * mp - s, 0.0)
                    value = -(0.5 * (rest * rest).sum(1) / np.maximum(fade_, 1e-300))
            out[part] = np.where(good, value, none)
        return out


CHUNK = 1 << 17  # pixels of patterns that are scored at a time


def climb_all(score: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As climb, for many simplexes [row, 3, 2] at once; score(rows, points) has a value for each."""
    pts, n = np.array(start, float), len(start)
    every = np.arange(n)
    val = np.stack([score(every, pts[:, k]) for k in range(3)], 1) if n else np.zeros((0, 3))
    good, live = np.zeros(n, bool), every
    for _ in range(MOST_STEPS):
        order = np.argsort(-val[live], axis=1, kind="stable")
        pts[live], val[live] = np.take_along_axis(pts[live], order[:, :, None], 1), np.take_along_axis(val[live], order, 1)
        with np.errstate(invalid="ignore"):
            done = np.abs(val[live, 2] - val[live, 0]) < np.abs(val[live, 2] + val[live, 0]) * RELATIVE + ABSOLUTE
        good[live[done]] = True
        live = live[~done]
        if not len(live):
            break
        own, v0, v1, v2 = pts[live], *val[live].T
        worst, centre = own[:, 2], own[:, :2].mean(1)
        p = worst + REFLECT * (centre - worst)
        v = score(live, p)
        far, fine = v > v0, v > v1
        t = np.where(far, EXPAND, np.where(v > v2, CONTRACT_OUT, CONTRACT_IN))[:, None]
        more = far | ~fine
        q, u = worst + t * (centre - worst), np.full(len(live), -np.inf)
        u[more] = score(live[more], q[more])
        second = np.where(far, u > v, ~fine & (u > np.maximum(v, v2)))  # the second point, else the first, else neither
        first = ~second & (far | fine)
        at = live[second]
        pts[at, 2], val[at, 2] = q[second], u[second]
        at = live[first]
        pts[at, 2], val[at, 2] = p[first], v[first]
        at = live[~second & ~first]
        if len(at):
            pts[at, 1:] = pts[at, :1] + SHRINK * (pts[at, 1:] - pts[at, :1])
            for k in (1, 2):
                val[at, k] = score(at, pts[at, k])
    return pts[:, 0], val[:, 0], good


def _best_starts(score: Callable[[np.ndarray, np.ndarray], np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best three of the starts [row, start, 2], and their values."""
    every = np.arange(len(starts))
    values = np.stack([score(every, starts[:, k]) for k in range(starts.shape[1])], 1) if len(starts) else np.zeros(starts.shape[:2])
    order = np.argsort(-values, axis=1, kind="stable")[:, :3]
    return np.take_along_axis(starts, order[:, :, None], 1), np.take_along_axis(values, order, 1)


def track_all(pairs: Pairs, limit: float, metric: str = "CC", least: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As track, for each pair."""
    score = lambda rows, d: pairs.score(metric, rows, d, limit)
    none, n = -1.0 if metric == "CC" else float("-inf"), len(pairs)
    starts = np.array([(0.0, 0.0), *candidates(limit, 0.75, 0.75)])
    best, value = _best_starts(score, np.broadcast_to(starts, (n, *starts.shape)))
    some = np.nonzero(value[:, 0] > none)[0]
    at, got, flag = np.full((n, 2), np.nan), np.full(n, none), np.full(n, FAILED)
    at[some], got[some], good = climb_all(lambda rows, d: score(some[rows], d), best[some] + np.array([[0, 0], [1e-3, 0], [0, 1e-3]]))
    flag[some] = np.where((got[some] < least) & (metric == "CC"), LOW, OK)
    for k in some[~good]:
        *at[k], got[k], flag[k] = track(pairs.a[k], pairs.b[k], limit, metric, least)
    return at[:, 0], at[:, 1], got, flag


def posterior_all(pairs: Pairs, rows: np.ndarray, at: np.ndarray, limit: float, centre: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As posterior, for some rows."""
    e = EPSILON
    f = {(i, j): pairs.score("SD", rows, at + np.array([i * e, j * e]), limit, centre) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    with np.errstate(invalid="ignore", over="ignore"):
        xx = (f[1, 0] - 2 * f[0, 0] + f[-1, 0]) / e**2
        yy = (f[0, 1] - 2 * f[0, 0] + f[0, -1]) / e**2
        xy = (f[1, 1] - f[1, -1] - f[-1, 1] + f[-1, -1]) / (4 * e**2)
        h = -np.stack([xx, xy, xy, yy], 1).reshape(-1, 2, 2)
        ok = np.isfinite(h).all((1, 2))
        ok[ok] = np.abs(np.linalg.det(h[ok])) > 1e-12
    cov = np.full((len(rows), 2, 2), np.nan)
    cov[ok] = np.linalg.inv(h[ok])
    ok &= np.isfinite(cov).all((1, 2))
    cov[~ok] = np.nan
    negative = np.minimum(cov[:, 0, 0], cov[:, 1, 1]) < 0
    return cov[:, 0, 0], cov[:, 1, 1], cov[:, 0, 1], np.where(ok, negative.astype(int), 2)


def optima_near(pairs: Pairs, rows: np.ndarray, mean: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As optimum_near, for some rows, each about its own mean."""
    score = lambda k, d: pairs.score("CC", rows[k], d, within, mean[k])
    best, value = _best_starts(score, mean[:, None] + np.array(candidates(within, within / 2, within)))
    some = np.nonzero(value[:, 2] > -1)[0]
    at, corr, good = np.full((len(rows), 2), np.nan), np.full(len(rows), -1.0), np.zeros(len(rows), bool)
    at[some], corr[some], good[some] = climb_all(lambda k, d: score(some[k], d), best[some])
    for k in some[~good[some]]:
        at[k], corr[k], good[k] = optimum_near(pairs.a[rows[k]], pairs.b[rows[k]], mean[k], within)
    return at, corr, good


def stacks(a: list, b: list, width: int) -> Iterator[tuple[np.ndarray, Pairs]]:
    """The places of the images of each size, and their pairs; a missing image has no pixel."""
    a, b = ([None if x is None else np.array(x, float) for x in v] for v in (a, b))
    sizes: dict[int, list[int]] = {}
    for k, (one, two) in enumerate(zip(a, b, strict=True)):
        n = len(one if one is not None else two if two is not None else ())
        a[k], b[k] = (np.full(n, np.nan) if x is None else x for x in (one, two))
        if len(a[k]) != len(b[k]):
            raise ValueError("the two images of a pair differ in size")
        sizes.setdefault(n, []).append(k)
    for own in sizes.values():
        yield np.array(own), Pairs(*(np.stack([x[k] for k in own]).reshape(len(own), -1, width) for x in (a, b)))


def optimum_near(a: np.ndarray, b: np.ndarray, mean: np.ndarray, within: float) -> tuple[np.ndarray, float, bool]:
    """Best displacement about `mean`, its correlation, and whether it was found.

    The sigmoid is centred on the mean and as long as `within`; the climb starts from the best three of the ring half as far.
    """
    score = lambda d: similarity(a, b, np.asarray(d, float), within, centre=mean)
    starts = sorted((mean + np.array(d) for d in candidates(within, within / 2, within)), key=lambda d: -score(d))[:3]
    if score(starts[2]) <= -1:
        return np.full(2, np.nan), -1.0, False
    return climb(score, np.array(starts))


class Found(NamedTuple):
    """An optimum about a mean: where, its correlation, whether it was found, and its posterior (variances, covariance, flag)."""

    at: np.ndarray
    corr: float
    good: bool = True
    spread: tuple[float, float, float, int] = (np.nan, np.nan, np.nan, -1)


SPREAD = ("var_x", "var_y", "cov_xy", "uflag")
SPREAD_NONE = (np.nan, np.nan, np.nan, -1)


def correct(
    vectors: pd.DataFrame, furthest: float = 10.0, least: int = 5, radius: float = 1.5, again: Callable[[int, np.ndarray], Found] | None = None, correlation: float = 0.3, mean_correlation: float = 0.3, most: int = 50
) -> pd.DataFrame:
    """Worst first, vectors further than `furthest` from the mean of their neighbours are found anew about that mean, or go.

    Rows have x, y, dx, dy and flag, 0 or 9 (not found: as far off as can be), and may have corr. At first vectors of flag 0, later
    those of flag 0 and 13, whose correlation is `mean_correlation` or more make the means, of `least` of them or more.
    The worst one is found anew by again(row of vectors, mean): it becomes 13 where that succeeds with `correlation` or more, else 12,
    which is final; then its neighbours' means and distances follow, its own distance stays with the mean it was found by. Without
    `again` it takes the mean. In the end what is left of 0 and 13 becomes 14 without enough neighbours
    and 10 below `correlation`. Neighbours may push a vector out again, which is found anew `most` times and then goes, so this ends.
    """
    steps = corrections(vectors, furthest, least, radius, correlation, mean_correlation, most)
    try:
        i, mean = next(steps)
        while True:
            i, mean = steps.send(again(i, mean) if again else Found(mean, 1.0))
    except StopIteration as end:
        return end.value


def corrections(vectors: pd.DataFrame, furthest: float, least: int = 5, radius: float = 1.5, correlation: float = 0.3, mean_correlation: float = 0.3, most: int = 50) -> Generator[tuple[int, np.ndarray], Found, pd.DataFrame]:
    """The steps of correct: yields (row of vectors, mean) of a vector that is to be found anew, is sent what was found, and returns the rows."""
    v = vectors.sort_values(["y", "x"], kind="stable")
    rows = v.index.to_numpy()
    v = v.reset_index(drop=True)
    xy, d, flag = v[["x", "y"]].to_numpy(float), v[["dx", "dy"]].to_numpy(float).copy(), v["flag"].to_numpy().copy()
    corr = v["corr"].to_numpy(float).copy() if "corr" in v else np.ones(len(v))
    spread = [list(v[c]) if c in v else [SPREAD_NONE[k]] * len(v) for k, c in enumerate(SPREAD)]
    cells: dict[tuple[int, int], list[int]] = {}
    side = max(radius, 1e-9)
    for i, (x, y) in enumerate(xy):
        cells.setdefault((int(x // side), int(y // side)), []).append(i)

    def beside(i: int) -> np.ndarray:
        cx, cy = int(xy[i, 0] // side), int(xy[i, 1] // side)
        some = np.array([j for p in (-1, 0, 1) for q in (-1, 0, 1) for j in cells.get((cx + p, cy + q), ()) if j != i], int)
        return np.sort(some[((xy[some] - xy[i]) ** 2).sum(1) <= radius**2])

    near = [beside(i) for i in range(len(v))]
    means, many, gaps, tries = np.full((len(v), 2), np.nan), np.zeros(len(v), int), np.full(len(v), -1.0), np.zeros(len(v), int)

    def measure(i: int, kinds: tuple[int, ...]) -> None:
        n = near[i][np.isin(flag[near[i]], kinds) & (corr[near[i]] >= mean_correlation)]
        many[i], means[i] = len(n), d[n].mean(0) if len(n) else np.nan
        if len(n) < least:
            gaps[i] = -2.0
        else:
            gaps[i] = np.inf if np.isnan(d[i]).any() else np.hypot(*(d[i] - means[i]))

    for i in range(len(v)):
        measure(i, (OK,))
    while len(gaps) and gaps.max() > furthest:
        i = int(gaps.argmax())
        if flag[i] == REFUSED:
            gaps[i] = -3.0
            continue
        flag[i], tries[i] = REFUSED, tries[i] + 1
        got = yield rows[i], means[i].copy()
        if got.good and got.corr >= correlation and tries[i] <= most:
            d[i], corr[i], flag[i] = got.at, got.corr, CORRECTED
            for k, x in enumerate(got.spread):
                spread[k][i] = x
        gaps[i] = np.hypot(*(d[i] - means[i])) if flag[i] == CORRECTED else -3.0
        for j in near[i]:
            measure(j, (OK, CORRECTED))
    held = np.isin(flag, (OK, CORRECTED))
    flag = np.where(held & (many < least), NO_MEAN, np.where(held & (corr < correlation), LOW, flag))
    v[["dx", "dy"]] = d
    v["flag"] = flag
    if "corr" in v:
        v["corr"] = corr
    for k, c in enumerate(SPREAD):
        if c in v:
            v[c] = [x if f in (OK, CORRECTED) else SPREAD_NONE[k] for x, f in zip(spread[k], flag, strict=True)]
    return v


FIELDS = 1 << 22  # pixels of the images that are held at once, a field being held whole


def correct_fields(t: pd.DataFrame, group: str, width: int, limit: float, furthest: float) -> list[pd.DataFrame]:
    """The corrected vectors of each field; the fields take their steps side by side, so each asks for one vector at a time."""
    columns = ("dx", "dy", "corr", "flag", *SPREAD)
    kinds, found = [], np.full((len(t), 8), [np.nan, np.nan, -1.0, FAILED, *SPREAD_NONE])
    size, place = np.zeros(len(t), int), np.zeros(len(t), int)
    for k, (own, images) in enumerate(stacks(list(t["a"]), list(t["b"]), width)):
        kinds.append(images)
        size[own], place[own] = k, np.arange(len(own))
        found[own, :4] = np.stack(track_all(images, limit, least=-2.0), 1)
        good = np.nonzero(found[own, 3] == OK)[0]
        found[own[good], 4:] = np.stack(posterior_all(images, good, found[own[good], :2], limit), 1)
    v = t[[group, "x", "y"]].assign(**{c: found[:, k].astype(int) if c in ("flag", "uflag") else found[:, k] for k, c in enumerate(columns)})

    def again(rows: np.ndarray, means: np.ndarray) -> list[Found]:
        out: list[Found] = [None] * len(rows)
        for k, images in enumerate(kinds):
            mine = np.nonzero(size[rows] == k)[0]
            at, corr, good = optima_near(images, place[rows[mine]], means[mine], furthest)
            spread = np.full((len(mine), 4), SPREAD_NONE)
            spread[good] = np.stack(posterior_all(images, place[rows[mine[good]]], at[good], furthest, means[mine[good]]), 1)
            for j, m in enumerate(mine):
                out[m] = Found(at[j], corr[j], good[j], (*spread[j, :3], int(spread[j, 3])))
        return out

    runs = [corrections(x, furthest) for _, x in v.groupby(group, dropna=False, sort=False)]
    done, asked, answers = [None] * len(runs), {}, dict.fromkeys(range(len(runs)))
    while answers:
        for k, answer in answers.items():
            try:
                asked[k] = runs[k].send(answer)
            except StopIteration as end:
                done[k] = end.value
        got = again(np.array([i for i, _ in asked.values()]), np.stack([m for _, m in asked.values()])) if asked else []
        answers, asked = dict(zip(asked, got, strict=True)), {}
    return done


def correct_images(pairs: DataFrame, group: str, width: int, limit: float, furthest: float) -> DataFrame:
    """(group, x, y, dx, dy, corr, flag, var_x, var_y, cov_xy, uflag) for rows (group, x, y, a, b) of image pairs on a grid.

    Each pair is tracked, then outliers of the group are found anew on their own images, with their posterior. A group is one
    field of vectors, of one date and sensor: its grid bounds it. uflag is -1 where there is no vector.
    """
    ship(pairs.sparkSession)

    def fields(batches):
        """Rows in whole fields, some fields at a time."""
        held, size, last = [], 0, None
        for t in batches:
            for value, part in t.groupby(group, dropna=False):
                if size >= FIELDS and not (value == last or pd.isna(value) and pd.isna(last)):
                    yield pd.concat(held, ignore_index=True)
                    held, size = [], 0
                held.append(part)
                size, last = size + sum(0 if x is None else 2 * len(x) for x in part["a"]), value
        if held:
            yield pd.concat(held, ignore_index=True)

    def run(batches):
        for t in fields(batches):
            yield pd.concat(correct_fields(t, group, width, limit, furthest), ignore_index=True)

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = f"{group} {kinds[group]}, x {kinds['x']}, y {kinds['y']}, dx double, dy double, corr double, flag int, var_x double, var_y double, cov_xy double, uflag int"
    return dealt(pairs.select(group, "x", "y", "a", "b"), group).sortWithinPartitions(group).mapInPandas(run, schema)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key to as many tasks as a shuffle has, which adaptive execution leaves as they are: its rows are few bytes and much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def track_pairs(pairs: DataFrame, width: int, limit: float = 3.0, metric: str = "CC") -> DataFrame:
    """(pair, dx, dy, corr, flag) for rows (pair, a, b) of two images as arrays; corr is the value of the metric."""
    ship(pairs.sparkSession)

    def run(batches):
        for t in batches:
            for own, images in stacks(list(t["a"]), list(t["b"]), width):
                yield pd.DataFrame(dict(zip(("dx", "dy", "corr", "flag"), track_all(images, limit, metric), strict=True))).assign(pair=t["pair"].to_numpy()[own])

    return dealt(pairs.select("pair", "a", "b"), "pair").mapInPandas(run, "pair bigint, dx double, dy double, corr double, flag int")


def posterior_pairs(pairs: DataFrame, width: int, limit: float = 3.0) -> DataFrame:
    """(pair, var_x, var_y, cov_xy, uflag) at the optimum of each of the rows (pair, a, b) of two images as arrays; without one uflag is 2."""
    ship(pairs.sparkSession)

    def run(batches):
        for t in batches:
            for own, images in stacks(list(t["a"]), list(t["b"]), width):
                dx, dy, _, flag = track_all(images, limit)
                found = np.nonzero(flag != FAILED)[0]
                out = np.full((len(own), 4), [np.nan, np.nan, np.nan, 2])
                out[found] = np.stack(posterior_all(images, found, np.stack([dx, dy], 1)[found], limit), 1)
                yield pd.DataFrame(out, columns=list(SPREAD)).astype({"uflag": int}).assign(pair=t["pair"].to_numpy()[own])

    return dealt(pairs.select("pair", "a", "b"), "pair").mapInPandas(run, "pair bigint, var_x double, var_y double, cov_xy double, uflag int")
