"""Quality by a sparse rule ensemble.

Statistics of each text feed small boosted trees; every path from a root is a conjunction of
thresholds, and lasso logistic regression keeps the few that matter. What is left is compiled
into one Spark column expression over the statistics. Trees and weights are fit on the driver
from at most `sample` labelled rows, taken by a hash of the id.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.columns import map_texts, quoted
from spindrift.llm.toxicity import labelled

SAMPLE, TREES, DEPTH, BINS = 20_000, 40, 3, 32
NAMES = ["n_words", "word_len", "upper", "digit", "punct", "symbol", "pipe", "bang", "stop", "beyond_ascii", "space", "lines", "line_words", "line_repeat", "line_top", "unique", "adjacent", "top_word", "end_symbol", "long_word"]
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOLS = [ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~"]
_PUNCT = [ord(c) for c in "!\"'(),-./:;?"]
PART = 1 << 20


def statistics(text: bytes | None) -> list[float]:
    """NAMES for one text; zeros for an empty one."""
    text = text or b""
    h = np.zeros(256)
    for i in range(0, len(text), PART):
        h += np.bincount(np.frombuffer(text[i : i + PART], np.uint8), minlength=256)
    n = max(1.0, h.sum())
    words = text.split()
    k = len(words)
    if not k:
        return [0.0] * len(NAMES)
    letters = max(1.0, h[_UPPER].sum() + h[_LOWER].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen, rows = Counter(words), Counter(lines)
    return [
        float(k),
        len(text) / k,
        h[_UPPER].sum() / letters,
        h[_DIGIT].sum() / n,
        h[_PUNCT].sum() / k,
        h[_SYMBOLS].sum() / k,
        h[124] / k,
        h[33] / k,
        h[46] / k,
        h[128:].sum() / n,
        (h[32] + h[9] + h[10] + h[13]) / n,
        float(len(lines)),
        k / max(1, len(lines)),
        1 - len(rows) / max(1, len(lines)),
        max(rows.values()) / max(1, len(lines)) if len(lines) > 3 else 0.0,
        len(seen) / k,
        sum(map(eq, words, words[1:])) / k,
        max(seen.values()) / k,
        sum(h[_SYMBOLS]) / max(1.0, h[32]),
        float(max(map(len, seen))),
    ]


def measure(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """row (a struct of the named columns) and the statistics of every row's text."""

    def of(batch):
        x = np.array([statistics(t) for t in batch], float).reshape(len(batch), len(NAMES))
        return [pa.array(x[:, k]) for k in range(len(NAMES))]

    rows = df.select(F.struct(*(quoted(k) for k in keys)).alias("row"), quoted(text).alias("text"))
    return map_texts(rows, ["row"], "text", of, ", ".join(f"{n} double" for n in NAMES))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    at: float

    def column(self) -> Column:
        x = F.col(self.name)
        return x > self.at if self.above else x <= self.at

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, NAMES.index(self.name)]
        return v > self.at if self.above else v <= self.at


@dataclass
class Model:
    constant: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self) -> Column:
        """The probability of label 1 as an expression over the statistics."""
        z = F.lit(self.constant)
        for conditions, weight in self.rules:
            holds = conditions[0].column()
            for c in conditions[1:]:
                holds = holds & c.column()
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray], codes: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list) -> np.ndarray:
    """One regression tree on gradient and curvature; appends every path; returns the leaf values of rows."""
    value = np.full(len(rows), -grad[rows].sum() / (hess[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 40:
        return value
    best = (1e-3, None, None)
    g, h = grad[rows], hess[rows]
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(codes.shape[1]):
        c = codes[rows, f]
        gs, hs, ns = (np.cumsum(np.bincount(c, w, len(edges[f]) + 1))[:-1] for w in (g, h, np.ones(len(rows))))
        if not len(gs):
            continue
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
        gain[(ns < 15) | (len(rows) - ns < 15)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    _, f, k = best
    if f is None:
        return value
    right = codes[rows, f] > k
    at = float(edges[f][k])
    for side in (False, True):
        step = (*path, Condition(NAMES[f], side, at))
        out.append(step)
        m = right == side
        value[m] = grow(x, grad, hess, edges, codes, rows[m], depth - 1, step, out)
    return value


def lasso(r: np.ndarray, y: np.ndarray, strength: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the constant is free."""
    w, v, c, cv, t = np.zeros(r.shape[1]), np.zeros(r.shape[1]), 0.0, 0.0, 1.0
    rate = 4.0 / max(np.linalg.norm(r.T @ r / len(y), 2) + 1.0, 1e-9)
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(r @ v + cv, -30, 30))) - y
        new = v - rate * (r.T @ e) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * strength, 0)
        cn = cv - rate * e.mean()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, cv = new + (t - 1) / s * (new - w), cn + (t - 1) / s * (cn - c)
        w, c, t = new, cn, s
    return c, w


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules and weights from statistics x and labels y; a constant where only one label occurs."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else np.clip(y.mean(), 0.01, 0.99)
        return Model(float(np.log(p / (1 - p))), [])
    rng = np.random.default_rng(7)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    z, paths = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.sort(rng.permutation(len(y))[: max(200, len(y) // 2)])
        out: list = []
        grow(x, p - y, p * (1 - p), edges, codes, rows, DEPTH, (), out)
        leaves = [q for q in out if not any(o != q and o[: len(q)] == q for o in out)]
        for q in leaves:
            m = np.logical_and.reduce([c.holds(x) for c in q])
            z[m] += 0.3 * -(p - y)[m].sum() / ((p * (1 - p))[m].sum() + 1.0)
        paths += out
    kept: dict[bytes, tuple] = {}
    for q in paths:
        m = np.logical_and.reduce([c.holds(x) for c in q])
        if 0.002 < m.mean() < 0.998:
            kept.setdefault(np.packbits(m).tobytes(), (q, m))
    if not kept:
        return Model(float(np.log(y.mean() / (1 - y.mean()))), [])
    r = np.stack([m for _, m in kept.values()], 1).astype(np.float64)
    centre = r.mean(0)
    test = np.arange(len(y)) % 4 == 0
    best = (np.inf, 0.01)
    for strength in (0.01, 0.003, 0.001, 0.0003):
        c, w = lasso(r[~test] - centre, y[~test], strength)
        p = np.clip(1 / (1 + np.exp(-(c + (r[test] - centre) @ w))), 1e-6, 1 - 1e-6)
        loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()
        if loss < best[0] - 1e-4:
            best = (loss, strength)
    c, w = lasso(r - centre, y, best[1], 800)
    some = np.flatnonzero(np.abs(w) > 1e-3)
    names = list(kept.values())
    return Model(float(c - centre @ np.where(np.abs(w) > 1e-3, w, 0)), [(names[k][0], float(w[k])) for k in some])


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", parts: int = 5, held: int = 0, sample: int = SAMPLE) -> Model:
    """Learns from rows of df with a label whose crc32(id) mod parts is not `held`."""
    chosen = labelled(labels, label, id, parts, held, sample).select(F.col("id"), F.col("y"))
    some = df.select(quoted(id).alias("id"), quoted(text).alias("text")).join(F.broadcast(chosen), "id")  # at most `sample` ids
    rows = measure(some, ["y"]).select("row.y", *NAMES).toArrow()
    if not rows.num_rows:
        return learn(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.stack([rows.column(n).to_numpy() for n in NAMES], 1)
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])
    mixed = order[np.random.default_rng(3).permutation(len(order))]
    return learn(x[mixed], y[mixed])


def score(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row; null and empty texts have all statistics zero."""
    return measure(df, [id], text).select("row.*", model.score().alias("score"))


def accept(df: DataFrame, model: Model, at: float, text: str = "text") -> DataFrame:
    """The rows of df that score `at` or more, with all their columns, whatever those are named; no shuffle."""
    return measure(df, df.columns, text).where(model.score() >= at).select("row.*")
