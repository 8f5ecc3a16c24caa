"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Two models predict the next byte of a word from the four before it: one learnt from texts
labelled toxic, one from ordinary ones. The longest context has counts of its class; all shorter
contexts share continuation counts gathered from every text of the corpus, so that a rare
expression is smoothed alike in both models and only what the labels show tells them apart.

A text is scored by the differences of the two log-likelihoods, each divided by the length it
covers: over the whole text, over its strongest passage and over its strongest words. A logistic
curve, fit on labelled texts that the counts have not seen, turns them into a probability.

The class counts come from at most `sample` labelled rows, taken by a hash of the id; the shared
counts from all texts, exactly, n-gram by n-gram. Where neither class has seen a context, both
models back off alike and the ratio is 0, so of the shared counts only those matter whose context
ends a context of the labelled rows. These are picked by a join and collected: at most 256 for each
context that the bounded sample has, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import wordhash
from spindrift.llm.columns import map_texts, quoted, texts
from spindrift.runtime import cut_lineage, map_arrow

ORDER, SAMPLE, FIT_SHARE, DISCOUNT, PASSAGE = 5, 60_000, 5, 0.75, 12
SHARED = 2  # the number of the class whose counts are shared


def crc_split(id: Column, parts: int) -> Column:
    """The remainder that decides which rows are held out."""
    return F.pmod(F.crc32(id.cast("string")), F.lit(parts))


def _count(batches, chosen: dict):
    """(class, gram, n): of labelled texts by class, and of all texts as SHARED."""
    sums = [wordhash.Counts() for _ in range(3)]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        kind = np.array([chosen.get(i, SHARED) for i in ids], np.int64)
        for piece in wordhash.cut(list(texts(batch.column(1)))):
            w = wordhash.words(piece)
            for k in range(3):
                some = kind[w.text] == k if k < SHARED else slice(None)
                if k < SHARED and not some.any():
                    continue
                part = w if k == SHARED else wordhash.Words(w.letters, w.first[some], w.size[some], w.text[some], w.hash[some])
                one, _, n = part.distinct()
                keys, _, per = wordhash.grams(one, ORDER)
                sums[k].add(keys, np.repeat(n, per))
    for k, s in enumerate(sums):
        keys, n = s.take()
        for i in range(0, len(keys), 1 << 16):
            part = keys[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part.view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["c", "g", "n"])


class Table:
    """Sums by key; 0 for any other key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, back = np.unique(keys, return_inverse=True)
        self.values = np.bincount(back, values, len(self.keys)).astype(np.float64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


class Level:
    """Counts of grams, and the totals and numbers of followers of their contexts (all bytes but the last)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams = Table(grams, counts)
        contexts = self.grams.keys >> np.uint64(8)
        self.totals, self.followers = Table(contexts, self.grams.values), Table(contexts, np.ones(len(contexts)))

    def smooth(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Kneser-Ney probabilities of the grams' last bytes; `lower` are those of the shorter grams."""
        context = keys >> np.uint64(8)
        total = self.totals.get(context)
        share = np.maximum(self.grams.get(keys) - DISCOUNT, 0) + DISCOUNT * self.followers.get(context) * lower
        return np.where(total > 0, share / np.maximum(total, 1), lower)


@dataclass
class Model:
    classes: list[Level]  # counts of ORDER-grams: ordinary, toxic
    shared: list[Level]  # continuation counts of (ORDER - 1)-grams down to single bytes
    weights: np.ndarray  # of the calibration, the constant first

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of each gram's last byte."""
        every, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(every))
        known = (self.classes[0].totals.get(every >> np.uint64(8)) + self.classes[1].totals.get(every >> np.uint64(8))) > 0
        some = every[known]
        p = np.full(len(some), 1 / 256)
        for k in range(len(self.shared) - 1, -1, -1):  # from single bytes up
            p = self.shared[k].smooth(some & np.uint64((1 << (8 * (ORDER - 1 - k))) - 1), p)
        own = [np.log(np.maximum(c.smooth(some, p), 1e-12)) for c in self.classes]
        out[known] = own[1] - own[0]
        return out[back]

    def features(self, batch: list[bytes | None]) -> np.ndarray:
        """[text, 6]: ratio a byte over all, of the best passage, the best word, the best three, and the square root of the words."""
        out = np.zeros((len(batch), 6))
        total, size, count = np.zeros(len(batch)), np.zeros(len(batch)), np.zeros(len(batch))
        best = np.full((len(batch), 3), 0.0)
        passage = np.full(len(batch), -9.0)
        for piece in wordhash.cut(batch):
            w = wordhash.words(piece)
            if not len(w.size):
                continue
            one, back, _ = w.distinct()
            keys, begin, n = wordhash.grams(one, ORDER)
            gain = np.add.reduceat(self.ratios(keys), begin)[back]
            length = (w.size + 1).astype(float)
            head = np.r_[0, np.flatnonzero(w.text[1:] != w.text[:-1]) + 1]
            own, tail = w.text[head], np.r_[head[1:], len(w.text)]
            total[own] += np.add.reduceat(gain, head)
            size[own] += np.add.reduceat(length, head)
            count[own] += tail - head
            g, b = np.r_[0, np.cumsum(gain)], np.r_[0, np.cumsum(length)]
            start = np.arange(len(gain))
            last = np.minimum(start + PASSAGE, np.repeat(tail, tail - head))
            start = np.maximum(np.minimum(start, last - PASSAGE), np.repeat(head, tail - head))
            run = (g[last] - g[start]) / np.maximum(b[last] - b[start], PASSAGE * 6)
            passage[own] = np.maximum(passage[own], np.maximum.reduceat(run, head))
            for t, s, e in zip(own.tolist(), head.tolist(), tail.tolist(), strict=True):
                x = gain[s:e]
                x = x if e - s <= 3 else np.partition(x, e - s - 3)[-3:]
                best[t] = np.sort(np.r_[best[t], x])[-3:]
        some = count > 0
        out[some, 0] = total[some] / size[some]
        out[some, 1] = passage[some]
        out[some, 2] = best[some, 2]
        out[some, 3] = best[some, 1]
        out[some, 4] = best[some].mean(1)
        out[:, 5] = np.log1p(count)
        return out

    def scores(self, batch: list[bytes | None]) -> np.ndarray:
        """Probabilities; 0 for a text without words."""
        f = self.features(batch)
        z = f @ self.weights[1:] + self.weights[0]
        return np.where(f[:, 5] > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (the constant first) of a ridge logistic regression, by Newton's method on standardised columns."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else np.clip(y.mean(), 0.01, 0.99)
        return np.r_[np.log(p / (1 - p)), np.zeros(x.shape[1])]
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / std]
    w, keep = np.zeros(z.shape[1]), np.r_[0, np.full(x.shape[1], ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-6)
        w = w - np.linalg.solve(h, z.T @ (p - y) + keep * w)
    return np.r_[w[0] - (w[1:] / std * mean).sum(), w[1:] / std]


def labelled(labels: DataFrame, label: str, id: str, parts: int, held: int, sample: int) -> DataFrame:
    """(id, y) of at most `sample` rows that may be learnt from, chosen by a hash of the id; the larger of conflicting labels."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & (crc_split(F.col(id), parts) != held))
    return rows.groupBy(F.col(id).alias("id")).agg((F.max(label) > 0).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", parts: int = 3, held: int = 1, sample: int = SAMPLE) -> Model:
    """Learns from texts of df whose id is labelled; one in FIT_SHARE of these serves the calibration alone."""
    rows = labelled(labels, label, id, parts, held, sample).withColumn("fit", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(FIT_SHARE)) == 0).collect()
    chosen = {r.id: int(r.y) for r in rows if not r.fit}
    rest = {r.id: int(r.y) for r in rows if r.fit}
    sent = df.sparkSession.sparkContext.broadcast(chosen)
    rows_ = df.select(quoted(id).alias("id"), quoted(text).alias("text"))
    counted = map_arrow(rows_, lambda batches: _count(batches, sent.value), "c int, g bigint, n bigint")
    grams = cut_lineage(counted.groupBy("c", "g").agg(F.sum("n").alias("n")))  # read many times below
    g = F.col("g")

    def level(rows: DataFrame) -> Level:
        got = rows.toArrow()
        return Level(got.column("g").to_numpy().view(np.uint64), got.column("n").to_numpy().astype(float))

    own = [level(grams.where(F.col("c") == c).select("g", "n")) for c in range(SHARED)]  # of the bounded sample
    seen = grams.where(F.col("c") < SHARED).select(F.shiftrightunsigned(g, 8).alias("context"))
    longer, shared = grams.where(F.col("c") == SHARED).select("g"), []
    for k in range(ORDER - 1):
        size = 8 * (ORDER - 1 - k)
        short = cut_lineage(longer.groupBy(g.bitwiseAND(F.lit((1 << size) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("n")))
        ends = seen.select(F.col("context").bitwiseAND(F.lit((1 << (size - 8)) - 1)).alias("context")).distinct()
        some = short.withColumn("context", F.shiftrightunsigned(g, 8)).join(ends, "context", "left_semi").select("g", "n")
        shared.append(level(some))  # at most 256 for a context of the sample
        longer = short.select("g")
    model = Model(own, shared, np.zeros(7))
    model.weights = calibrate(rows_, model, rest, "id", "text")
    return model


def calibrate(df: DataFrame, model: Model, rest: dict, id: str, text: str) -> np.ndarray:
    spark = df.sparkSession
    sent, ids = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(rest)

    def run(batches):
        for batch in batches:
            known = [(i, t) for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) if i in ids.value]
            if known:
                f = sent.value.features([t for _, t in known])
                y = np.array([ids.value[i] for i, _ in known], float)
                yield pa.RecordBatch.from_arrays([pa.array(y), *(pa.array(f[:, k]) for k in range(6))], names=["y", *(f"f{k}" for k in range(6))])

    rows = map_arrow(df.select(id, text), run, "y double, " + ", ".join(f"f{k} double" for k in range(6))).toArrow()
    order = np.lexsort([rows.column(i).to_numpy() for i in range(7)])
    x = np.stack([rows.column(k + 1).to_numpy() for k in range(6)], 1)[order] if rows.num_rows else np.zeros((0, 6))
    return logistic(x, rows.column(0).to_numpy()[order] if rows.num_rows else np.zeros(0))


def score(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row; a null or wordless text has score 0, ids pass through."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(df, [id], text, lambda batch: [pa.array(sent.value.scores(batch))], "score double")


