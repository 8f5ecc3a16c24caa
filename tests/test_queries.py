"""Every registered query of the core against its SQL on the smallest tables, and what their plans must not hold."""

import duckdb
import pandas as pd
import pytest

from spindrift.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings pages".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    show = lambda x: "-" if x is None or x is pd.NaT or x != x else f"{float(x):.5f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted("|".join(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    got = df.toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_works_without_the_optional_part(monkeypatch):
    import builtins
    import importlib
    import sys

    real = importlib.import_module

    def without(name, *a):
        if name.startswith("spindrift.llm") or name == "corpus_pipeline":
            raise ImportError(name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    sys.modules.pop("__spark_entry__", None)
    entry = builtins.__import__("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)
    sys.modules.pop("__spark_entry__", None)
