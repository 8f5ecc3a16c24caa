"""Exact top-k search by inner product, by distributed histogram selection.

Vectors travel in blocks of bounded size. Every block of queries meets every block of candidates once a
round, and all scores are computed; a round gives each query a histogram of its scores over BINS bins of
its present interval, summed over all blocks. The bin that holds the kth score is the next interval, until
it is one number wide: the kth value and how many scores lie above it are then known. A last round
keeps what lies above and, of the scores equal to it, as many as are wanting, smallest id first.

A block's own histogram ends at the bin of its own kth score, below which the global kth can't lie;
that and the last round's limit on equal scores bound what a pair of blocks emits, however many rows share
one vector.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.columns import quoted
from spindrift.runtime import cut_lineage, map_arrow, rewritten

CANDIDATES, QUERIES, SLICE = 4096, 2048, 256  # vectors of a block, and queries scored at once
BITS = 8
BINS = 1 << BITS
GROUP = 8  # blocks of candidates that one copy of the queries is sent to
SCALE = 64.0
_WIDE = 1 << 53


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their integers end to end, how many each has) of an Arrow column of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten() if column.null_count == 0 else column.values.slice(column.offsets[0].as_py(), column.offsets[n].as_py() - column.offsets[0].as_py())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
    row = np.repeat(np.arange(n), size)
    bad = np.bincount(row[~np.isfinite(x)], minlength=n) > 0
    if column.null_count:
        bad |= np.asarray(column.is_null())
    keep = np.flatnonzero(~bad)
    return keep, np.floor(SCALE * x[~bad[row]]), size[keep]


def matrix(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One row a vector; the shorter ones are filled up with zeros."""
    out = np.zeros((len(size), int(size.max(initial=0))))
    ends = np.cumsum(size)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(values)) - np.repeat(ends - size, size)] = values
    return out


def blocks(df: DataFrame, asks: Column, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The vectors of df in blocks, written to the shared folder: block, dim, ids, asks, norm and the values as little-endian doubles."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keep, values, size = whole(batch.column(2))
            ends = np.r_[0, np.cumsum(size)]
            for at in range(0, len(keep), CANDIDATES):
                k = pa.array(keep[at : at + CANDIDATES])
                m = matrix(values[ends[at] : ends[at + len(k)]], size[at : at + CANDIDATES])
                norm = float(np.sqrt((m * m).sum(1).max(initial=0)))
                one = lambda v, kind: pa.array([v], kind)
                yield pa.RecordBatch.from_arrays(
                    [one(number, pa.int64()), one(m.shape[1], pa.int32()), one(batch.column(0).take(k).cast(pa.int64()).to_pylist(), pa.list_(pa.int64())), one(batch.column(1).take(k).to_pylist(), pa.list_(pa.bool_())), one(norm, pa.float64()), one(m.astype("<f8").tobytes(), pa.binary())],
                    names=["block", "dim", "ids", "asks", "norm", "values"],
                )
                number += 1

    rows = df.select(quoted(id).cast("bigint").alias("i"), F.coalesce(asks, F.lit(False)).alias("a"), quoted(vector).cast("array<double>").alias("v"))
    return rewritten(map_arrow(rows, run, "block bigint, dim int, ids array<bigint>, asks array<boolean>, norm double, values binary"))


def questions(made: DataFrame) -> DataFrame:
    """The queries of the blocks in blocks of their own, with where each one comes from."""

    def run(batches):
        number, held = TaskContext.get().partitionId() << 32, []

        def close():
            size = max(m.shape[1] for _, _, _, m in held)
            values = np.concatenate([np.pad(m, ((0, 0), (0, size - m.shape[1]))) for *_, m in held])
            parts = [[x for h in held for x in h[c]] for c in range(3)]
            one = lambda v, kind: pa.array([v], kind)
            return pa.RecordBatch.from_arrays(
                [one(number, pa.int64()), one(size, pa.int32()), *(one(p, pa.list_(pa.int64())) for p in parts), one(values.astype("<f8").tobytes(), pa.binary())],
                names=["questions", "q_dim", "q_ids", "q_block", "q_place", "q_values"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                at = np.flatnonzero(np.array(r["asks"], np.bool_))
                m = np.frombuffer(r["values"], "<f8").reshape(len(r["ids"]), r["dim"])[at]
                for k in range(0, len(at), QUERIES):
                    part = at[k : k + QUERIES].tolist()
                    if held and sum(len(h[0]) for h in held) + len(part) > QUERIES:
                        yield close()
                        number, held = number + 1, []
                    held.append(([r["ids"][i] for i in part], [r["block"]] * len(part), part, m[k : k + QUERIES]))
        if held:
            yield close()

    some = made.where(F.exists("asks", lambda a: a)).select("block", "dim", "ids", "asks", "values")
    schema = "questions bigint, q_dim int, q_ids array<bigint>, q_block array<bigint>, q_place array<bigint>, q_values binary"
    return rewritten(map_arrow(some, run, schema))


class Scored:
    """Scores of a block of queries against a block of candidates, SLICE queries at a time."""

    def __init__(self, row: dict, exact: type, before: Scored | None = None):
        same = before is not None and before.number == row["questions"]
        n, size = len(row["q_ids"]), max(row["dim"], row["q_dim"])
        pad = lambda x, n, d: np.pad(np.frombuffer(x, "<f8").reshape(n, d), ((0, 0), (0, size - d))).astype(exact)
        self.number, self.n = row["questions"], n
        self.q = before.q if same and before.q.shape[1] == size else pad(row["q_values"], n, row["q_dim"])
        self.c = pad(row["values"], len(row["ids"]), row["dim"])
        self.ids = row["ids"]
        self.own = [(k, p) for k, (b, p) in enumerate(zip(row["q_block"], row["q_place"], strict=True)) if b == row["block"]]

    def slices(self):
        """(which queries, scores as integers [query, candidate], candidates that are no query's own row)."""
        for at in range(0, self.n, SLICE):
            s = (self.q[at : at + SLICE] @ self.c.T).astype(np.int64)
            free = np.ones(s.shape, np.bool_)
            for k, p in self.own:
                if at <= k < at + SLICE:
                    free[k - at, p] = False
            yield slice(at, at + len(s)), s, free


def met(candidates: DataFrame, asked: DataFrame, groups: int) -> DataFrame:
    """Every block of queries beside every block of candidates; queries are copied once a group of candidates."""
    c = candidates.select("block", "dim", "ids", "values", F.pmod(F.shiftright("block", 32) * 31 + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(groups)).alias("group"))
    q = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    return q.join(c.hint("shuffle_hash"), "group").drop("group")


def histograms(pairs: DataFrame, k: int, shift: int, bins: int, exact: type) -> DataFrame:
    """(questions, q, bin, n): scores of each query in `bins` bins of 2^shift numbers from its `low` on, as far down as they can matter."""

    def run(batches):
        last: Scored | None = None
        total = np.zeros((0, BINS), np.int64)

        def flush():
            above = np.cumsum(total[:, ::-1], 1)[:, ::-1] - total
            q, b = np.nonzero((total > 0) & (above < k))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), last.number)), pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[q, b])], names=["questions", "q", "bin", "n"])

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if last is not None and last.number != row["questions"]:
                    yield flush()
                    last = None
                now = Scored(row, exact, last)
                if last is None:
                    total = np.zeros((now.n, BINS), np.int64)
                last, low = now, np.array(row["low"], np.int64)
                for part, s, free in now.slices():
                    b = (s - low[part, None]) >> shift
                    q, c = np.nonzero(free & (b >= 0) & (b < bins))
                    flat = np.bincount(q * BINS + b[q, c], minlength=len(s) * BINS)
                    total[part] += flat.reshape(len(s), BINS)
        if last is not None:
            yield flush()

    found = map_arrow(pairs, run, "questions bigint, q int, bin int, n bigint")
    return found.groupBy("questions", "q", "bin").agg(F.sum("n").alias("n"))


def narrowed(state: DataFrame, counted: DataFrame, k: int, shift: int) -> DataFrame:
    """Each query's next interval: the bin of its kth score, or the lowest if it has fewer."""
    bins = counted.groupBy("questions", "q").agg(F.array_sort(F.collect_list(F.struct((-F.col("bin")).alias("down"), "n"))).alias("bins"))  # BINS at most
    rows = state.select("questions", F.posexplode(F.arrays_zip("low", "above")).alias("q", "s")).select("questions", "q", "s.low", "s.above")
    rows = rows.join(bins, ["questions", "q"], "left")
    start = F.struct(F.col("above").alias("above"), F.lit(None).cast("int").alias("bin"))
    walk = F.aggregate(
        F.coalesce("bins", F.array().cast("array<struct<down:int,n:bigint>>")),
        start,
        lambda acc, x: F.when(acc["bin"].isNotNull(), acc).otherwise(F.when(acc["above"] + x["n"] >= k, F.struct(acc["above"], (-x["down"]).alias("bin"))).otherwise(F.struct((acc["above"] + x["n"]).alias("above"), acc["bin"]))),
    )
    rows = rows.select("questions", "q", "low", walk.alias("at")).select("questions", "q", (F.col("low") + F.shiftleft(F.coalesce("at.bin", F.lit(0)).cast("bigint"), shift)).alias("low"), F.col("at.above").alias("above"))
    listed = rows.groupBy("questions").agg(F.array_sort(F.collect_list(F.struct("q", "low", "above"))).alias("s"))  # QUERIES at most
    return cut_lineage(listed.select("questions", F.col("s.low").alias("low"), F.col("s.above").alias("above")))


def kept(pairs: DataFrame, k: int, exact: type) -> DataFrame:
    """(questions, q, query_id, vec_id, score) above each query's kth value, and of those equal to it the smallest ids that are wanting."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                now = Scored(row, exact)
                low, wanting = np.array(row["low"], np.int64), k - np.array(row["above"], np.int64)
                key = np.array([np.iinfo(np.int64).max if i is None else i for i in now.ids], np.int64)
                order = np.argsort(key, kind="stable")
                qs, cs, scores = [], [], []
                for part, s, free in now.slices():
                    s, free, least = s[:, order], free[:, order], low[part, None]
                    level = free & (s == least)
                    take = free & (s > least) | level & (np.cumsum(level, 1) <= wanting[part, None])
                    q, c = np.nonzero(take)
                    qs.append(q + part.start)
                    cs.append(order[c])
                    scores.append(s[q, c])
                q, c = np.concatenate(qs), np.concatenate(cs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(q), now.number)), pa.array(q.astype(np.int32)), pa.array(row["q_ids"], pa.int64()).take(pa.array(q)), pa.array(now.ids, pa.int64()).take(pa.array(c)), pa.array(np.concatenate(scores))],
                    names=["questions", "q", "query_id", "vec_id", "score"],
                )

    return map_arrow(pairs, run, "questions bigint, q int, query_id bigint, vec_id bigint, score bigint")


def search(df: DataFrame, asks: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each row where `asks` holds with all other rows.

    Components are floor(64 x), scores integers, ties go to the smaller id (a null id last). Vectors
    that are null or hold a null or non-finite component take no part; of vectors of different lengths
    the common components count. Rows that repeat an id are rows of their own, as queries and as
    candidates; a query's own row alone is left out. Fewer candidates than k are all returned. Scores
    that do not fit in a long are an error.
    """
    made = blocks(df, asks, id, vector)
    norm, many = made.agg(F.max("norm"), F.count(F.lit(1))).first()
    spark = df.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not many:
        return spark.createDataFrame([], schema)
    bound = int(norm * norm * (1 + 1e-9)) + 1  # no score is larger (Cauchy and Schwarz), nor a partial sum of one
    if bound >= 1 << 62:
        raise OverflowError("scores do not fit in a long")
    exact = np.float32 if bound < 1 << 24 else np.float64 if bound < _WIDE else np.int64
    asked = questions(made)
    groups = min(many, max(ceil(many / GROUP), spark.sparkContext.defaultParallelism))
    shift = max(0, (2 * bound).bit_length() - BITS)
    low, zero = F.lit(-bound).cast("bigint"), F.lit(0).cast("bigint")
    state = asked.select("questions", F.transform("q_ids", lambda _: low).alias("low"), F.transform("q_ids", lambda _: zero).alias("above"))
    bins = BINS
    while True:
        counted = histograms(met(made, asked.join(state, "questions"), groups), k, shift, bins, exact)
        state = narrowed(state, counted, k, shift)
        if not shift:
            break
        bins, shift = min(BINS, 1 << shift), max(0, shift - BITS)  # of no more numbers than the last bin had
    found = kept(met(made, asked.join(state, "questions"), groups), k, exact)
    within = Window.partitionBy("questions", "q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
