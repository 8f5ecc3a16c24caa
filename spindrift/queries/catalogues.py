"""Names, identifiers, raw text and dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import dims, names
from spindrift.queries.registry import query
from spindrift.runtime import table
from spindrift.sources import areas

_NAME = "'drift_'||CASE o_custkey%3 WHEN 0 THEN 'amsr2-gw1' WHEN 1 THEN 'ssmi-f15' ELSE 'ascat-metopA' END||'_tb37v-Lap_simplex_lev2_'||CASE WHEN o_custkey%2=0 THEN 'nh-ease2-750' ELSE 'sh-ease2-750' END||'_'||strftime(o_orderdate,'%Y%m%d')||'12w_'||strftime(o_orderdate+INTERVAL 1 DAY,'%Y%m%d')||CASE WHEN o_custkey%5=0 THEN '12' ELSE '12n' END||'.nc'"


@query(
    f"""WITH f AS (SELECT o_orderkey AS rec_id, {_NAME} AS name FROM orders), p AS (SELECT *, regexp_extract(name,'^[a-z]+_([^_]+)_([^_]+)_([^_]+)_(lev[0-9])_([^_]+)_([0-9]{{10}}[wn]?)_([0-9]{{10}}[wn]?)[.]nc$',['a','b','c','d','e','f','g']) AS m FROM f)
SELECT rec_id, m.a AS sensor, m.b AS channels, m.d AS level, m.e AS area, left(m.f,10) AS start, left(m.g,10) AS stop FROM p"""
)
def filename_split(spark, sf_dir):
    k, d = F.col("o_custkey"), F.col("o_orderdate")
    sensor = F.when(k % 3 == 0, "amsr2-gw1").when(k % 3 == 1, "ssmi-f15").otherwise("ascat-metopA")
    area = F.when(k % 2 == 0, "nh-ease2-750").otherwise("sh-ease2-750")
    stamp = lambda x: F.date_format(x, "yyyyMMdd")
    name = F.concat(F.lit("drift_"), sensor, F.lit("_tb37v-Lap_simplex_lev2_"), area, F.lit("_"), stamp(d), F.lit("12w_"), stamp(F.date_add(d, 1)), F.when(k % 5 == 0, "12").otherwise("12n"), F.lit(".nc"))
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), name.alias("name"))
    parts = names.split_drift_name(F.col("name"))
    return f.select("rec_id", *(parts[c].alias(c) for c in ("sensor", "channels", "level", "area", "start", "stop")))


@query(
    "SELECT o_orderkey AS rec_id, 'drift_'||i||'_'||c||'v-Lap+'||c||'h-Lap_simplex_lev2_nh_'||strftime(o_orderdate,'%Y%m%d')||'w_'||strftime(o_orderdate+INTERVAL 2 DAY,'%Y%m%d')||'w.nc' AS name FROM (SELECT *, CASE o_custkey%3 WHEN 0 THEN 'amsr2-gw1' WHEN 1 THEN 'ssmi-f15' ELSE 'ascat-metopA' END AS i, CASE o_custkey%3 WHEN 0 THEN '37' WHEN 1 THEN '90' ELSE 'all' END AS c FROM orders)"
)
def sensor_filename(spark, sf_dir):
    k = F.col("o_custkey") % 3
    i = F.when(k == 0, "amsr2-gw1").when(k == 1, "ssmi-f15").otherwise("ascat-metopA")
    stamp = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyyMMdd")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), names.drift_name(i, names.default_channel(i), F.lit("nh"), stamp(0), stamp(2)).alias("name"))


@query(
    """WITH c AS (SELECT c_custkey AS id, CASE c_custkey%5 WHEN 0 THEN 'ssmi' WHEN 1 THEN 'ssmis' WHEN 2 THEN 'amsr2' WHEN 3 THEN 'ascat' ELSE 'other' END AS i, CASE WHEN c_custkey%5<2 THEN 'f'||CAST(c_nationkey AS VARCHAR) WHEN c_custkey%5=2 THEN CASE WHEN c_nationkey%2=0 THEN 'gw1' ELSE 'aq' END ELSE 'metopB' END AS p FROM customer)
SELECT id, i AS instrument, p AS platform, CASE i WHEN 'ssmi' THEN CAST(p[2:] AS INTEGER)<16 WHEN 'ssmis' THEN CAST(p[2:] AS INTEGER)>=16 WHEN 'amsr2' THEN p LIKE 'gw%' WHEN 'ascat' THEN p LIKE 'metop%' ELSE false END AS ok FROM c"""
)
def instrument_check(spark, sf_dir):
    k, n = F.col("c_custkey") % 5, F.col("c_nationkey")
    i = F.when(k == 0, "ssmi").when(k == 1, "ssmis").when(k == 2, "amsr2").when(k == 3, "ascat").otherwise("other")
    p = F.when(k < 2, F.concat(F.lit("f"), n.cast("string"))).when(k == 2, F.when(n % 2 == 0, "gw1").otherwise("aq")).otherwise("metopB")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), i.alias("instrument"), p.alias("platform"))
    return c.withColumn("ok", names.instrument_ok(F.col("instrument"), F.col("platform")))


@query("SELECT c_custkey AS id, rpad(substring(substring(c_mktsegment,1,1)||regexp_replace(c_name,'(_0pT|_1pT|#)','','g'),1,9),9,'z') AS short FROM customer")
def id_shorten(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), names.short_id(F.col("c_mktsegment"), F.col("c_name")).alias("short"))


@query("SELECT page_id, regexp_extract(url,'^https?://([^/]+)',1) AS host, split_part(regexp_replace(url,'/+$',''),'/',-1) AS token, length(url)::BIGINT AS n, rtrim(url,'/') AS trimmed FROM pages")
def url_token(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"), names.basename(u).alias("token"), F.length(u).cast("long").alias("n"), F.rtrim(u, F.lit("/")).alias("trimmed"))


@query("SELECT page_id, regexp_matches(split_part(regexp_replace('matchup_'||replace(regexp_extract(url,'^https?://([^/]+)',1),'.','_')||CASE WHEN page_id%3=0 THEN '.txt' ELSE '.nc' END,'/+$',''),'/',-1),'^matchup_[a-z0-9_-]+[.]nc$') AS ok FROM pages")
def list_file_check(spark, sf_dir):
    host = F.replace(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("."), F.lit("_"))
    line = F.concat(F.lit("matchup_"), host, F.when(F.col("page_id") % 3 == 0, ".txt").otherwise(".nc"))
    return table(spark, sf_dir, "pages").select("page_id", names.matchup_list_line(line).alias("ok"))


@query("SELECT host, count(*) AS n, min(page_id) AS first_page, CASE WHEN count(*)<2 THEN 3 WHEN min(page_id)%4=0 THEN 4 ELSE 0 END AS code FROM (SELECT page_id, regexp_extract(url,'//([a-z]+)',1) AS host FROM pages) GROUP BY host")
def crawler_names(spark, sf_dir):
    """Names caught from paths, and a code for what became of each."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([a-z]+)", 1).alias("host"))
    n, first = F.count(F.lit(1)), F.min("page_id")
    return rows.groupBy("host").agg(n.alias("n"), first.alias("first_page"), F.when(n < 2, 3).when(first % 4 == 0, 4).otherwise(0).alias("code"))


@query("SELECT s_suppkey AS id, rtrim(s_name||'///','/') AS path, replace('~'||s_name||'~','~','') AS name, lower(s_name)=lower(upper(s_name)) AS same FROM supplier")
def token_trim(spark, sf_dir):
    n = F.col("s_name")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.rtrim(F.concat(n, F.lit("///")), F.lit("/")).alias("path"), F.regexp_replace(F.concat(F.lit("~"), n, F.lit("~")), "~", "").alias("name"), (F.lower(n) == F.lower(F.upper(n))).alias("same"))




@query(
    """SELECT event_id, CAST(date_trunc('second',ts) AS VARCHAR) AS datetime, CASE WHEN event_id%2=0 THEN 1 ELSE -1 END*(60.5+event_id%30)::DOUBLE AS lat, CASE WHEN event_id%3=0 AND event_id%180>0 THEN 360-event_id%180 ELSE event_id%180 END::DOUBLE AS lon, 0 AS source FROM events WHERE event_id%10<>0"""
)
def raw_text_records(spark, sf_dir):
    """Lines of a catalogue written and read again; comments are no records."""
    from spindrift.sources.text import CATALOGUES, records

    k = F.col("event_id")
    line = F.concat(
        F.when(k % 10 == 0, "# ").otherwise(""), F.date_format("ts", "yyyy.MM.dd HH:mm:ss"), F.lit(" "), (60 + k % 30).cast("string"), F.lit(".5"), F.when(k % 2 == 0, "N").otherwise("S"), F.lit(" "), (k % 180).cast("string"), F.when(k % 3 == 0, "W").otherwise("E")
    )
    e = table(spark, sf_dir, "events").select(k, line.alias("value"), F.lit(1).alias("line_no"))
    spec = CATALOGUES["aari"]
    got = records(e.select("value", "line_no").distinct(), spec)
    back = e.select("event_id", "value").where(~F.col("value").startswith("#"))
    when = F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy.MM.dd HH:mm:ss")).cast("timestamp_ntz")
    lat = (60.5 + k % 30) * F.when(k % 2 == 0, 1).otherwise(-1)
    lon = F.when((k % 3 == 0) & (k % 180 > 0), 360 - k % 180).otherwise(k % 180)
    keyed = back.select("event_id", when.alias("datetime"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    return keyed.join(got.distinct(), ["datetime", "lat", "lon"]).select("event_id", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "lat", "lon", F.col("source").cast("int").alias("source"))


@query(
    """WITH RECURSIVE d AS (SELECT 'K'||CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey%13=0 THEN n_name ELSE 'K'||CAST(n_nationkey-1 AS VARCHAR) END AS value FROM nation),
 r AS (SELECT key, value FROM d UNION ALL SELECT r.key, d.value FROM r JOIN d ON r.value=d.key) SELECT key, value FROM r WHERE value NOT IN (SELECT key FROM d)"""
)
def header_defines(spark, sf_dir):
    """Definitions read from text; those that name others are followed."""
    from spindrift.sources.text import defines

    k = F.col("n_nationkey")
    value = F.when(k % 13 == 0, F.col("n_name")).otherwise(F.concat(F.lit("K"), (k - 1).cast("string")))
    lines = table(spark, sf_dir, "nation").select(F.concat(F.lit("#define K"), k.cast("string"), F.lit("  "), value).alias("value"))
    return defines(lines)


_GRID = dims.values(dims.GRIDS, "area_id, proj, lat_0, lon_0, lat_ts, nx, ny, llx, lly, urx, ury")


@query(f"SELECT n_nationkey AS id, area_id, proj, (urx-llx)/nx/1000.0::DOUBLE AS step_km, llx+(urx-llx)/nx/2.0::DOUBLE AS x0 FROM nation JOIN {_GRID} g ON g.area_id=CASE n_nationkey%3 WHEN 0 THEN 'nh-ease2-750' WHEN 1 THEN 'sh-ease2-125' ELSE 'nh-stere-625' END")
def grid_dimension(spark, sf_dir):
    k = F.col("n_nationkey")
    area = F.when(k % 3 == 0, "nh-ease2-750").when(k % 3 == 1, "sh-ease2-125").otherwise("nh-stere-625")
    n = table(spark, sf_dir, "nation").select(k.alias("id"), area.alias("area_id"))
    known = areas.areas(areas.written(dims.grids(spark), "area_id").withColumnRenamed("area_id", "file"), file="file")
    g = n.join(F.broadcast(known.select("area_id", "proj", "nx", "llx", "urx")), "area_id")  # seven grids
    width = F.col("urx") - F.col("llx")
    return g.select("id", "area_id", "proj", (width / F.col("nx") / 1000).alias("step_km"), (F.col("llx") + width / F.col("nx") / 2).alias("x0"))


@query(f"SELECT n_nationkey AS file, area_id, 'Grid '||area_id AS name, proj, lat_0::DOUBLE AS lat_0, lon_0::DOUBLE AS lon_0, coalesce(lat_ts,0)::DOUBLE AS lat_ts, nx, ny, llx::DOUBLE AS llx, lly::DOUBLE AS lly, urx::DOUBLE AS urx, ury::DOUBLE AS ury FROM nation JOIN (SELECT *, row_number() OVER () - 1 AS k FROM {_GRID}) g ON g.k=n_nationkey%7")
def area_definitions(spark, sf_dir):
    """Area definitions written as text, one file for each nation, and read again."""
    g = dims.grids(spark)
    number = F.expr("CASE area_id " + " ".join(f"WHEN '{r[0]}' THEN {k}" for k, r in enumerate(dims.GRIDS)) + " END")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), (F.col("n_nationkey") % 7).alias("k"))
    files = n.join(F.broadcast(g.withColumn("k", number.cast("bigint"))), "k")
    got = areas.areas(areas.written(files, "file"), file="file")
    return got.select("file", "area_id", "name", "proj", "lat_0", "lon_0", F.coalesce("lat_ts", F.lit(0.0)).alias("lat_ts"), "nx", "ny", "llx", "lly", "urx", "ury")


_INSTR = dims.values(dims.INSTRUMENTS, "instrument, platform_prefix, channel")


@query(f"SELECT s_suppkey AS id, instrument, channel FROM supplier JOIN {_INSTR} i ON i.instrument=CASE s_suppkey%4 WHEN 0 THEN 'amsr' WHEN 1 THEN 'amsr2' WHEN 2 THEN 'ssmis' ELSE 'ascat' END")
def instrument_dimension(spark, sf_dir):
    k = F.col("s_suppkey") % 4
    i = F.when(k == 0, "amsr").when(k == 1, "amsr2").when(k == 2, "ssmis").otherwise("ascat")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), i.alias("instrument"))
    return s.join(F.broadcast(dims.instruments(spark)), "instrument").select("id", "instrument", "channel")


_BANDS = dims.values([(*r[:5], int(r[5])) for r in dims.bands_of()], "instrument, place, band, footprint, noise, is_default")


@query(f"SELECT s_suppkey AS id, i.instrument, place, band, footprint::DOUBLE AS footprint, noise::DOUBLE AS noise, is_default=1 AS is_default FROM supplier JOIN {_BANDS} i ON i.instrument=list_extract(['ssmi','ssmis','amsr','amsr2','ascat','seawinds','miras','cimr','none'], CAST(s_suppkey%9+1 AS INTEGER))")
def instrument_bands(spark, sf_dir):
    """The bands of each supplier's instrument, with footprint, noise and whether they are used by default."""
    names = F.array(*(F.lit(x) for x in ("ssmi", "ssmis", "amsr", "amsr2", "ascat", "seawinds", "miras", "cimr", "none")))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(names, (F.col("s_suppkey") % 9 + 1).cast("int")).alias("instrument"))
    return s.join(F.broadcast(dims.bands(spark)), "instrument").select("id", "instrument", "place", "band", "footprint", "noise", "is_default")


@query("SELECT r_regionkey AS id, CASE WHEN r_regionkey%2=0 THEN 'nh' ELSE 'sh' END AS area, CASE WHEN r_regionkey<2 THEN 'stere' ELSE 'laea' END AS proj, CASE WHEN r_regionkey%2=0 THEN 90 ELSE -90 END AS lat_0 FROM region")
def hemisphere_chooser(spark, sf_dir):
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(k.alias("id"), F.when(k % 2 == 0, "nh").otherwise("sh").alias("area"), F.when(k < 2, "stere").otherwise("laea").alias("proj"), F.when(k % 2 == 0, 90).otherwise(-90).alias("lat_0"))


@query("SELECT o_orderkey AS rec_id, CASE WHEN o_custkey%3=0 THEN 'swath' ELSE 'daily' END AS kind, strftime(o_orderdate,'%Y%m%d')||'12' AS stamp FROM orders WHERE NOT (o_custkey%3<>0 AND o_orderkey%2=0)")
def image_discovery(spark, sf_dir):
    """Images by two name patterns; daily maps are left out where swaths are asked for."""
    k = F.col("o_custkey") % 3
    name = F.concat(F.when(k == 0, "tc_swath_").otherwise("tc_daily_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("12.nc"))
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), name.alias("name"))
    f = f.where(~(F.col("name").rlike("^tc_daily_") & (F.col("rec_id") % 2 == 0)))
    return f.select("rec_id", F.regexp_extract("name", "^tc_(swath|daily)_", 1).alias("kind"), F.regexp_extract("name", r"_(\d{10})\.nc$", 1).alias("stamp"))
