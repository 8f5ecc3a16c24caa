import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import merge
from spindrift.operators.trajectory import steps
from spindrift.queries.adapters import fix, vec
from spindrift.sources import netcdf3, sinks, text
from spindrift.streaming import daily

SF = "/root/testdata/sf0.001"


def test_catalogue_rows(spark):
    lines = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "line_no int, value string")
    got = text.records(lines("# id", "2010.01.02 03:04:05 80.5 -10.25", "broken", "2010.13.02 03:04:05 80.5 1"), text.CATALOGUES["aari"]).collect()
    assert [(str(r.datetime), r.lat, r.lon, r.source) for r in got] == [("2010-01-02 03:04:05", 80.5, 349.75, 0)]
    got = text.records(lines("! c", "2010 1.5 70.0 20.0", "2010 2.0 999.999 20"), text.CATALOGUES["antsid"]).collect()
    assert [(str(r.datetime), r.lat) for r in got] == [("2010-01-02 12:00:00", 70.0)]
    got = text.records(lines("2015-05-06T07:08,-70.5,10,GPS position better than 100m", "2015-05-06T07:09,-70.5,10,poor"), text.CATALOGUES["awi"]).collect()
    assert [(r.lat, r.source) for r in got] == [(-70.5, 1)]
    got = text.records(lines("1/2/2012 3:04,80,5,iridium", "x,y,z", "1/2/2012 3:05,81,5,GPS"), text.CATALOGUES["crrel"]).collect()
    assert [(r.lat, r.source) for r in got] == [(80.0, 0)]  # the file ends at its first bad line
    drift = spark.createDataFrame([("7 80.5N 10.0W 3 x-010/1230", "a.2007"), ("7 80.5N 10.0W 2 x-010/1230", "a.2007"), ("8 80.5N 10.0W 3 x-010/1230", "a.2007"), ("7 80.5 10.0W 3 x-010/1230", "a.2007"), ("7 1N 1E 3 x", None)], "value string, file string").selectExpr("0 AS line_no", "*")
    got = text.records(drift, text.CATALOGUES["tara"], file="file", buoy="7").collect()
    assert [(str(r.datetime), r.lat, r.lon) for r in got] == [("2007-01-10 12:30:00", 80.5, 350.0)]
    got = text.records(lines("# c", "1 2012-01-02 03:04:05 0.5 -70 10", "0 2012-01-02 03:04:05 0.5 -71 10"), text.CATALOGUES["sams"]).collect()
    assert [(str(r.datetime), r.lat, r.lon) for r in got] == [("2012-01-02 03:04:05", -70.0, 10.0)]
    defs = text.defines(spark.createDataFrame([("#define A 1",), ("#define B A",), ("#define C B // x",), ("int x;",)], "value string"))
    assert {r.key: r.value for r in defs.collect()} == {"A": "1", "B": "1", "C": "1"}


def test_stops_are_of_one_file(spark):
    rows = [(0, "1/2/2012 3:04,80,5,a", "p"), (1, "1/2/2012 3:04,,5,a", "p"), (2, "1/2/2012 3:04,82,5,a", "p"), (1, "1/2/2012 3:04,83,5,a", "q"), (0, "1/2/2012 3:04,84,5,a", None), (1, "", None), (2, "bad", None), (3, "1/2/2012 3:04,85,5,a", None)]
    lines = spark.createDataFrame(rows, "line_no int, value string, file string")
    got = text.records(lines, text.CATALOGUES["crrel"], file="file", carry=("file", "line_no")).collect()
    assert sorted((str(r.file), r.lat) for r in got) == [("None", 84.0), ("p", 80.0), ("q", 83.0)]
    assert text.records(lines.limit(0), text.CATALOGUES["crrel"], file="file").count() == 0


def test_conic_projection_round_trip(spark):
    cone = text.CATALOGUES["hudson"].grid
    places = spark.range(400).select((40 + F.col("id") % 40 + 0.25).alias("lat"), (F.col("id") - 240.5).alias("lon")).withColumn("lon", F.col("lon") % 180)
    x, y = cone.forward(F.col("lat"), F.col("lon"))
    lat, lon = cone.inverse(F.col("x"), F.col("y"))
    off = places.withColumn("x", x).withColumn("y", y).select(F.max(F.abs(lat - F.col("lat"))).alias("a"), F.max(F.abs(lon - F.col("lon"))).alias("b")).first()
    assert off.a < 1e-8 and off.b < 1e-8


def test_times_of_gridded_buoys(spark):
    rows = spark.createDataFrame([("a", 60, -70.0, -10.0), ("a", 120, None, 1.0), ("b", 60, -71.0, 1.0), ("a", 180, float("nan"), 1.0)], "buoy string, time long, lat double, lon double")
    got = text.numbered_times(rows, "seconds since 03 04 2017 12:30 UTC", "a").collect()
    assert [(str(r.datetime), r.lat, r.lon, r.source) for r in got] == [("2017-04-03 12:31:00", -70.0, 350.0, 0)]
    with pytest.raises(ValueError):
        text.numbered_times(rows, "days since 2017-04-03")
    rows = spark.createDataFrame([("01-APR-2007 10:20:30", 80.0, 5.0), ("never", 80.0, 5.0)], "time_string string, latitude double, longitude double")
    assert [(str(r.datetime), r.source) for r in text.written_times(rows, "argos").collect()] == [("2007-04-01 10:20:30", 0)]


def classic(dx: np.ndarray) -> bytes:
    """A classic file with dimensions y, x and variables dX (float, with a fill value) and flag (short)."""
    name = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    ny, nx = dx.shape
    fill = struct.pack(">ii", 12, 1) + name("_FillValue") + struct.pack(">iif", 5, 1, -1e10)
    none = struct.pack(">ii", 0, 0)
    body = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, 2) + name("yc") + struct.pack(">i", ny) + name("xc") + struct.pack(">i", nx) + none + struct.pack(">ii", 11, 2)
    one, two = ny * nx * 4, -(-ny * nx * 2 // 4) * 4
    var = lambda n, att, kind, size, at: name(n) + struct.pack(">iii", 2, 0, 1) + att + struct.pack(">iii", kind, size, at)
    head = len(body) + len(var("dX", fill, 5, one, 0)) + len(var("flag", none, 3, two, 0))
    body += var("dX", fill, 5, one, head) + var("flag", none, 3, two, head + one)
    return body + dx.astype(">f4").tobytes() + (np.arange(ny * nx) % 5).astype(">i2").tobytes().ljust(two, b"\0")


def test_netcdf3_source(spark, tmp_path):
    dx = np.arange(12, dtype=float).reshape(3, 4)
    dx[1, 2] = -1e10
    (tmp_path / "a.nc").write_bytes(classic(dx))
    (tmp_path / "b.nc").write_bytes(classic(dx + 100))
    netcdf3.register(spark)
    df = spark.read.format("netcdf3").load(str(tmp_path / "*.nc"))
    assert df.columns == ["path", "yc", "xc", "dX", "flag"] and df.count() == 24
    got = {(r.yc, r.xc): (r.dX, r.flag) for r in df.where(F.col("path").endswith("a.nc")).collect()}
    assert got[1, 2] == (None, 1) and got[2, 3] == (11.0, 1) and got[0, 0] == (0.0, 0)


def drift_rows(spark, names=("a.nc", "b.nc", "c.nc")):
    from spindrift.sources.products import LAYOUTS

    rows, some = [], []
    for f, name in enumerate(names):
        for y in range(5):
            for x in range(7):
                if (x, y) != (2, 2):
                    rows.append((name, y, x, None if x == y else x + 10 * y + 100 * f + 0.5, -float(y)))
    df = spark.createDataFrame(rows, "file string, yc int, xc int, driftX double, driftY double")
    for v in LAYOUTS["drift"].variables:
        if not v.optional and v.name not in df.columns:
            df = df.withColumn(v.name, F.lit(3))
            some.append(v.name)
    return df.withColumn("time", F.lit(86400.5)).withColumn("lat", F.col("yc") + 0.25), rows


def test_netcdf3_files_are_written_and_read_again(spark, tmp_path):
    df, rows = drift_rows(spark)
    folder = tmp_path / "out"
    axes = {"xc": {"values": [10.0 * k for k in range(7)], "notes": ["km", "x"]}}
    netcdf3.write(df, str(folder), "drift", {"yc": 5, "xc": 7}, axes)
    assert sorted(p.name for p in folder.iterdir()) == ["a.nc", "b.nc", "c.nc"]
    got = spark.read.format("netcdf3").option("variables", "driftX,driftY,flag").load(str(folder / "*.nc"))
    assert got.columns == ["path", "time", "yc", "xc", "driftX", "driftY", "flag"]
    read = {(r.path[-4:], r.yc, r.xc): (r.driftX, r.driftY, r.flag) for r in got.collect()}
    want = {(n, y, x): (a, b, 3) for n, y, x, a, b in rows} | {(n, 2, 2): (None, None, None) for n in ("a.nc", "b.nc", "c.nc")}
    assert read == want
    h = netcdf3.Header((folder / "b.nc").read_bytes())
    assert h.attributes == {"Conventions": "CF-1.0", "filename": "b.nc"} and h.values("time").tolist() == [86400.5]
    assert h.values("xc").tolist() == axes["xc"]["values"] and h.values("lat")[3, 4] == 3.25 and h.variables["driftX"]["attributes"]["units"] == "km"
    assert "navg" not in h.variables and h.shape("driftX") == [1, 5, 7]


def test_matchups_are_written_with_their_names(spark, tmp_path):
    from spindrift.sources.products import LAYOUTS

    df = spark.range(6).select(F.lit("m.nc").alias("file"), F.col("id").cast("int").alias("matchup"), *((F.concat(F.lit(v.name), F.col("id")) if v.kind == "char" else F.col("id") * 2).alias(v.name) for v in LAYOUTS["matchup"].variables))
    netcdf3.write(df, str(tmp_path), "matchup")
    h = netcdf3.Header((tmp_path / "m.nc").read_bytes())
    assert len(h.variables) == 31 and h.values("prd_flag").tolist() == [0, 2, 4, 6, 8, 10]
    assert [b"".join(r).rstrip(b"\0").decode() for r in h.values("val_source").data.tolist()] == [f"val_sour{''}" for _ in range(6)]
    assert [b"".join(r).rstrip(b"\0").decode() for r in h.values("val_id").data.tolist()] == [f"val_id{k}" for k in range(6)]


def test_no_file_is_left_after_a_failure(spark, tmp_path):
    df, _ = drift_rows(spark)
    bad = df.withColumn("xc", F.when((F.col("file") == "c.nc") & (F.col("xc") == 6) & (F.col("yc") == 4), 99).otherwise(F.col("xc")))
    with pytest.raises(Exception, match="outside of xc"):
        netcdf3.write(bad, str(tmp_path / "x"), "drift", {"yc": 5, "xc": 7})
    assert list((tmp_path / "x").iterdir()) == []
    netcdf3.write(df.where("file = 'a.nc'"), str(tmp_path / "x"), "drift")
    old = (tmp_path / "x" / "a.nc").read_bytes()
    with pytest.raises(Exception, match="there already"):
        netcdf3.write(df, str(tmp_path / "x"), "drift")
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["a.nc"] and (tmp_path / "x" / "a.nc").read_bytes() == old
    netcdf3.write(df.withColumn("flag", F.lit(4)), str(tmp_path / "x"), "drift", overwrite=True)
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == ["a.nc", "b.nc", "c.nc"] and (tmp_path / "x" / "a.nc").read_bytes() != old
    with pytest.raises(Exception, match="columns are missing: flag"):
        netcdf3.write(df.drop("flag"), str(tmp_path / "y"), "drift")
    twice = netcdf3.Writer(str(tmp_path / "x"), netcdf3.LAYOUTS["mask"], {}, {}, ["file", "yc", "xc", "maxdriftmask"], True)
    with pytest.raises(ValueError, match="two tasks"):
        twice.commit([netcdf3.Written([("p", "a.nc")]), None, netcdf3.Written([("q", "a.nc")])])


def test_grids_of_an_image_pair_must_agree(spark, tmp_path):
    from spindrift.sources import drift

    def put(name, **changes):
        rows = [(name, y, x, 1.0, 0, 3, x, {"area": changes.get("area", "nh"), "since": changes.get("since", "2024-01-01T12:00:00Z")}) for y in range(3) for x in range(changes.get("nx", 4))]
        df = spark.createDataFrame(rows, "file string, yc int, xc int, tb37v_Lap double, tb37v_Lap_flag int, ice_edge int, dtime int, attributes map<string,string>")
        netcdf3.write(df, str(tmp_path), "image", axes={"xc": {"values": [changes.get("x0", 0.0) + k for k in range(changes.get("nx", 4))], "notes": ["m", "x"]}, "yc": {"values": [2.0, 1.0, 0.0]}})
        return str(tmp_path / name)

    def read(second):
        pairs = spark.createDataFrame([(7, "one.nc", second)], "pair int, begin string, end string")
        return drift.image_pairs(spark, str(tmp_path / "*.nc"), pairs, ["tb37v_Lap"])

    put("one.nc")
    put("two.nc", since="2024-01-02T12:00:00Z")
    got = read("two.nc").collect()
    assert len(got) == 24 and {r.time - r.xc for r in got if r.date == 1} == {1704196800} and {r.x for r in got} == {0.0, 1.0, 2.0, 3.0}
    for name, change in {"area": {"area": "sh"}, "first x": {"x0": 1.0}, "time": {"since": "noon"}}.items():
        put(f"{name.replace(' ', '_')}.nc", **change)
        with pytest.raises(ValueError, match=f"pair 7.*: {name}"):
            read(f"{name.replace(' ', '_')}.nc")
    with pytest.raises(ValueError, match=": file"):
        read("none.nc")
    heads = drift.image_heads(spark, str(tmp_path / "*.nc"))
    wide = heads.where("name = 'two.nc'").withColumns({"name": F.lit("wide.nc"), "xc": F.array(*(F.lit(float(k)) for k in range(5)))})
    pairs = spark.createDataFrame([(7, "one.nc", "wide.nc")], "pair int, begin string, end string")
    assert [tuple(r) for r in drift.grid_faults(heads.unionByName(wide), pairs).collect()] == [(7, "size")]


def test_trajectories_over_the_equator_are_not_written(spark, tmp_path):
    rows = [(k, f"2024-01-0{d}", k * 40.0 - 50 + d, 5.0 * d, 1) for k in (0, 1, 2) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "traj_id int, ts string, lat double, lon double, source int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    netcdf3.write_trajectories(df, str(tmp_path / "a"))
    h = netcdf3.Header((tmp_path / "a" / "traj_2.nc").read_bytes())
    assert h.attributes["area"] == "Northern Hemisphere" and h.attributes["time_coverage_end"] == "2024-01-03T00:00:00Z" and h.attributes["geospatial_lat_min"] == "31.0"
    assert h.values("lat").tolist() == [31.0, 32.0, 33.0] and h.values("seconds")[0] == 1704067200.0
    with pytest.raises(ValueError, match="trajectory 1 crosses the equator"):
        netcdf3.write_trajectories(df.withColumn("lat", F.col("lat") + 8), str(tmp_path / "b"))
    assert not (tmp_path / "b").exists()


def test_final_files_count_from_1978(spark, tmp_path):
    from spindrift.sources import drift

    rows = [(f"ice_drift_{d}.nc", y, x, None if x == y else 1.5, 2.5, 60, 120, 30, [86400.0 * d, 86400.0 * (d + 2)], 86400.0 * (d + 2)) for d in (10, 11) for y in range(2) for x in range(3)]
    df = spark.createDataFrame(rows, "file string, yc int, xc int, dX double, dY double, t0 int, t1 int, status_flag int, time_bnds array<double>, time double")
    netcdf3.write(df, str(tmp_path), "final")
    refs = spark.createDataFrame([("ice_drift_10.nc", drift.FINAL_EPOCH + 864000, drift.FINAL_EPOCH + 864000 + 172800), ("ice_drift_11.nc", 5, 6)], "name string, r0 long, r1 long")
    got = drift.read_for_matchups(spark, str(tmp_path / "ice_drift_*.nc"), refs).collect()
    assert len(got) == 6 and {r.name for r in got} == {"ice_drift_10.nc"} and all(r.sigdX is None for r in got)
    assert {(r.t0, r.t1) for r in got if r.xc != r.yc} == {(drift.FINAL_EPOCH + 864060, drift.FINAL_EPOCH + 864000 + 172920)} and all(r.t0 is None for r in got if r.xc == r.yc)
    with pytest.raises(ValueError, match="neither"):
        drift.read_for_matchups(spark, str(tmp_path / "other*.nc"), refs)


def test_products_are_replaced_by_partition(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = lambda area, n: spark.createDataFrame([(area, "2020-01-01", i) for i in range(n)], "area string, day string, v int")
    sinks.write_product(rows("nh", 3).unionByName(rows("sh", 2)), path, "drift_final")
    sinks.write_product(rows("nh", 1), path, "drift_final")
    assert sinks.read_product(spark, path).count() == 3 and sinks.read_product(spark, path, area="nh").count() == 1
    assert sinks.pending(rows("nh", 4), sinks.read_product(spark, path, area="nh"), "v").count() == 3


def test_merge_stream_equals_batch(spark, tmp_path):
    """With the wind's footprint and the pole, in every column and every row."""
    v = vec(spark, SF).withColumn("t0", F.col("t0").cast("timestamp")).withColumn("lat", 60.0 + F.col("y") % 30)
    v = v.withColumn("lat", F.when(F.col("cell") % 3 == 0, 88.0).otherwise(F.col("lat")))
    v.repartitionByRange(6, "t0").sortWithinPartitions("t0").write.parquet(str(tmp_path / "in"))
    late = v.limit(1).withColumn("t0", F.to_timestamp(F.lit("2100-01-01")))
    late.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past all days
    masks = {"lat": F.col("lat"), "wind": F.col("sensor") == 7}
    stream = daily.merge_stream(daily.read_daily(spark, str(tmp_path / "in"), v.schema), **masks)
    got = daily.run_available(stream, "merged", str(tmp_path / "cp"))
    batch = merge.inverse_variance(v.withColumn("day", F.date_trunc("day", "t0")), "day", "cell", **masks)
    columns = ["cell", "dx", "dy", "sigma", "flag", "no_fill", "n_used"]
    a, b = (sorted(((str(r.day), *(r[c] for c in columns)) for r in x.collect()), key=str) for x in (got, batch))
    near = lambda p, q: p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-6
    assert len(a) == len(b) > 100 and all(near(p, q) for x, y in zip(a, b, strict=True) for p, q in zip(x, y, strict=True))
    plain = merge.inverse_variance(v.withColumn("day", F.date_trunc("day", "t0")), "day", "cell")
    assert sorted(map(str, plain.drop("day").collect())) != sorted(map(str, batch.drop("day").collect()))


def files_in_turn(df, path, parts):
    """One file after another, in the order of `part`."""
    import time

    for k in range(parts):
        df.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time


def test_step_stream_of_shuffled_records_equals_batch(spark, tmp_path):
    """Records up to two days out of order, over six files and rounds: every step, and no other."""
    f = fix(spark, SF).select("traj_id", "rec_id", F.col("ts").cast("timestamp").alias("ts"), "lat", "lon")
    day = F.datediff("ts", F.lit("2024-01-01"))
    jumbled = f.withColumn("part", F.floor((day + F.col("rec_id") % 2) / 6).cast("int"))  # a day's records come in two files at times
    flush = spark.createDataFrame([(-1, -1, 0.0, 0.0, 6)], "traj_id long, rec_id long, lat double, lon double, part int").withColumn("ts", F.to_timestamp(F.lit("2024-02-20")))
    path = str(tmp_path / "in")
    files_in_turn(jumbled.unionByName(flush.select(*jumbled.columns)), path, 7)
    stream = daily.step_stream(spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(path))
    got = daily.run_available(stream, "stepped", str(tmp_path / "cp"))
    want = steps(f.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).where("dist is not null").collect()
    a = {r.rec_id: (r.dist, r.dt) for r in got.collect()}
    b = {r.rec_id: (r.dist, r.dt) for r in want}
    assert len(got.collect()) == len(a) and set(a) == set(b)
    assert all(abs(a[k][0] - b[k][0]) < 1e-6 and abs(a[k][1] - b[k][1]) < 1e-5 for k in b)


def test_state_of_a_trajectory_ends_and_late_records_go(spark, tmp_path):
    at = lambda s: F.to_timestamp(F.lit(s))
    row = lambda part, rec, when, traj=1: spark.createDataFrame([(traj, rec, 80.0 + rec, 0.0, part)], "traj_id long, rec_id long, lat double, lon double, part int").withColumn("ts", at(when))
    came = [(1, "2024-01-01", 1), (2, "2024-01-10", 1), (6, "2024-01-20", 1), (10, "2024-01-21", 1), (3, "2024-01-02", 1), (9, "2024-06-01", 2), (8, "2024-06-03", 2), (4, "2024-06-05", 1), (5, "2024-06-06", 1), (7, "2024-07-01", 2)]
    rows = row(0, *came[0])
    for part, x in enumerate(came[1:], 1):
        rows = rows.unionByName(row(part, *x))
    path = str(tmp_path / "in")
    files_in_turn(rows, path, len(came))
    schema = rows.drop("part").schema
    got = daily.run_available(daily.step_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)), "ended", str(tmp_path / "cp"))
    found = {(r.traj_id, r.rec_id): r.dt / 86400 for r in got.collect()}
    # record 3 comes when the step over it has left; record 4 comes 136 days after the last one of its trajectory, whose state has ended
    assert found == {(1, 2): 9, (1, 6): 10, (1, 10): 1, (1, 5): 1, (2, 8): 2}
