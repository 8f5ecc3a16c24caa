import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from spindrift.llm import queries, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, block int, asks boolean, rank string"


def brute(rows, k, every):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v) in enumerate(good):
        if i is not None and i % every == 0:
            found = [(-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, j) for m, (j, w) in enumerate(good) if m != n]
            out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def same(spark, rows, k=20, every=20, parts=3):
    df = spark.createDataFrame([(i, v, 1, True, "r") for i, v in rows], SCHEMA).repartition(parts)
    got = topk.search(df, F.col("vec_id") % every == 0, k).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, every)
    return got


def vectors(rng, n, dim, scale=1.0):
    return [(i, [rng.uniform(-scale, scale) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 900.0, 2e6, 1e-4])
def test_matches_brute_force(spark, monkeypatch, scale):
    """In whole numbers of 24 bits, of 53, beyond, and with nearly all scores equal."""
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 16)
    monkeypatch.setattr(topk, "SLICE", 5)
    rng = random.Random(int(scale) + 3)
    same(spark, vectors(rng, 500, 7, scale), every=4)


def test_ties_repeats_nulls_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    rng = random.Random(5)
    rows = vectors(rng, 150, 3)
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(150, 400)]  # a third and more share one vector
    rows += [(400, None), (401, [float("nan"), 1.0, 1.0]), (402, [None, 1.0, 1.0]), (403, [float("inf")]), (420, []), (440, [2.0]), (441, [1.0] * 9), (None, [0.5, 0.5, 0.5]), (None, [9.0])]
    rows += [(40, [0.1, 0.2, 0.3]), (460, [0.25, 1.0, -1.0]), (460, [0.25, 1.0, -1.0])]
    got = same(spark, rows)
    assert {r.rank for r in got} == set(range(1, 21)) and sum(r.query_id == 40 for r in got) == 40
    same(spark, rows, k=1, every=3, parts=1)


def test_few_rows_and_none(spark):
    same(spark, [(0, [1.0]), (20, [2.0]), (21, [-3.0])])
    same(spark, [(0, [1.0])])
    same(spark, [(1, [1.0]), (2, [1.0])])
    same(spark, [(0, None)])
    assert topk.search(spark.createDataFrame([], SCHEMA), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]
    with pytest.raises(OverflowError):
        topk.search(spark.createDataFrame([(0, [1e12])], "vec_id bigint, embedding array<double>"), F.lit(True))


def test_query_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.sql(queries.ORACLES["op13_topk"]).fetchall()
    got = queries.QUERIES["op13_topk"](spark, SF)
    order = [got.columns.index(c) for c in ("query_id", "rank", "vec_id", "score")]
    assert sorted(tuple(r[i] for i in order) for r in got.collect()) == sorted(want)
