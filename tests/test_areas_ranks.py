from collections import defaultdict

import numpy as np
import pytest

from spindrift.functions import dims
from spindrift.operators import ranks
from spindrift.sources.areas import areas, written


def lines(spark, text, file="f"):
    return spark.createDataFrame([(file, n, x) for n, x in enumerate(text.split("\n"))], "file string, line_no int, value string")


def test_area_definitions_are_read_back(spark):
    got = areas(written(dims.grids(spark), "area_id").withColumnRenamed("area_id", "file"), file="file").collect()
    read = {(r.area_id, r.proj, r.lat_0, r.lon_0, r.lat_ts, r.nx, r.ny, r.llx, r.lly, r.urx, r.ury) for r in got}
    assert read == {tuple(float(x) if isinstance(x, int) and 2 <= k <= 4 or isinstance(x, int) and k > 6 else x for k, x in enumerate(g)) for g in dims.GRIDS}
    assert all(r.file == r.area_id == r.pcs_id and r.units == "m" and r.a is None for r in got)


def test_blocks_comments_and_faults(spark):
    text = """XSIZE: 9
REGION: one {
   NAME:  First grid # with a remark
   PCS_DEF: proj=stere, a=6378273, b=6356889.44891, lat_0=-90, lat_ts=-70, lon_0=-45
   # XSIZE: 7
   XSIZE:          608
   XSIZE: 609
   YSIZE: many
   AREA_EXTENT:    (-3856250.0,-5343750.0 , 3743750, x)
};
YSIZE: 5
#REGION: hidden {
#   XSIZE: 1
#};
REGION: two {
}
REGION: open {
   XSIZE: 4"""
    got = {r.area_id: r for r in areas(lines(spark, text)).collect()}
    assert set(got) == {"one", "two"}
    r = got["one"]
    assert (r.name, r.proj, r.a, r.b, r.lat_0, r.lat_ts, r.lon_0) == ("First grid", "stere", 6378273.0, 6356889.44891, -90.0, -70.0, -45.0)
    assert (r.nx, r.ny, r.llx, r.lly, r.urx, r.ury) == (609, None, -3856250.0, -5343750.0, 3743750.0, None)
    assert got["two"].nx is None and got["two"].proj is None
    both = lines(spark, text, "p").unionByName(lines(spark, "REGION: one {\nXSIZE: 3\n};", "q"))
    assert sorted((r.file, r.area_id, r.nx) for r in areas(both, file="file").collect() if r.area_id == "one") == [("p", "one", 609), ("q", "one", 3)]
    assert areas(lines(spark, text).limit(0)).count() == 0


@pytest.mark.parametrize("parts", ["1", "7"])
def test_ranks_of_a_group_that_holds_nearly_all(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(1, float(v)) for v in rng.integers(0, 40, 3000)] + [(int(g), float(v)) for g, v in zip(rng.integers(2, 9, 80), rng.normal(size=80), strict=True)] + [(None, 2.0), (None, 1.0), (5, None)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ranks.ranked(spark.createDataFrame(rows, "g int, v double"), "g", "v").collect()
        assert ranks.ranked(spark.createDataFrame([], "g int, v double"), "g", "v").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by = defaultdict(list)
    for r in got:
        by[r.g].append((r.r, r.v))
    want = defaultdict(list)
    for g, v in rows:
        want[g].append(v)
    low = lambda v: (v is not None, v or 0)
    for g, vs in want.items():
        assert sorted(by[g]) == list(enumerate(sorted(vs, key=low), 1)) if None not in vs else [v for _, v in sorted(by[g], key=lambda x: x[0])] == sorted(vs, key=low)
    plan = ranks.paired(spark.createDataFrame(rows, "g int, v double").selectExpr("g", "v", "v as w"), "g", "v", "w")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
