"""Trajectories, collocation, geometry and matchups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import dims, geo
from spindrift.operators import trajectory as tr
from spindrift.queries.adapters import FIX, VEC, ctes, fix, vec
from spindrift.queries.registry import query


def sql_haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))"
    return f"(12742.0*atan2(sqrt({h}),sqrt(1-{h})))"


def sql_bearing(a: str, b: str, c: str, d: str) -> str:
    return f"degrees(pi()+atan2(sin(radians({d}-({b})))*cos(radians({c})),cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d}-({b})))))"


_E2 = 1 - (geo.WGS84.b / geo.WGS84.a) ** 2
_E = _E2**0.5


def sql_laea(lat: str, lon: str) -> tuple[str, str]:
    s = f"sin(radians({lat}))"
    q = f"({1 - _E2!r}*({s}/(1-{_E2!r}*{s}*{s})-{1 / (2 * _E)!r}*ln((1-{_E!r}*{s})/(1+{_E!r}*{s}))))"
    rho = f"(6378137.0*sqrt(greatest({geo.Laea().pole!r}-{q},0.0)))"
    return f"({rho}*sin(radians({lon})))", f"(-1*{rho}*cos(radians({lon})))"


_STEP = """, st AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(epoch(ts)) OVER w AS s0 FROM fix WINDOW w AS (PARTITION BY traj_id ORDER BY ts, rec_id))"""


@query(ctes(FIX) + _STEP + f" SELECT rec_id, round({sql_haversine('lat0', 'lon0', 'lat', 'lon')},6) AS dist, round({sql_haversine('lat0', 'lon0', 'lat', 'lon')}/nullif((epoch(ts)-s0)/3600,0),4) AS speed FROM st")
def haversine_step(spark, sf_dir):
    return tr.steps(fix(spark, sf_dir)).select("rec_id", F.round("dist", 6).alias("dist"), F.round("speed", 4).alias("speed"))


@query(ctes(FIX) + _STEP + f" SELECT rec_id, round({sql_bearing('lat0', 'lon0', 'lat', 'lon')},6) AS bearing FROM st WHERE lat0 IS NOT NULL")
def bearing_step(spark, sf_dir):
    w = Window.partitionBy("traj_id").orderBy("ts", "rec_id")
    rows = fix(spark, sf_dir).withColumns({"a": F.lag("lat").over(w), "b": F.lag("lon").over(w)}).where("a is not null")
    return rows.select("rec_id", F.round(geo.bearing(F.col("a"), F.col("b"), F.col("lat"), F.col("lon")), 6).alias("bearing"))


@query(ctes(FIX) + f"SELECT rec_id, round({sql_laea('lat', 'lon')[0]},3)+0.0 AS x, round({sql_laea('lat', 'lon')[1]},3)+0.0 AS y, round(lat,6) AS lat, round(lon,6)+0.0 AS lon FROM fix")
def laea_roundtrip(spark, sf_dir):
    g = geo.Laea()
    x, y = g.forward(F.col("lat"), F.col("lon"))
    rows = fix(spark, sf_dir).select("rec_id", x.alias("x"), y.alias("y"))
    lat, lon = g.inverse(F.col("x"), F.col("y"))
    return rows.select("rec_id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"), F.round(lat, 6).alias("lat"), (F.round(lon, 6) + 0.0).alias("lon"))


_S = geo.Stere()
_SE = geo.HUGHES.e


@query(
    ctes(FIX)
    + f""", r AS (SELECT rec_id, lat, lon, {_S.scale!r}*tan(pi()/4-radians(lat)/2)/pow((1-{_SE!r}*sin(radians(lat)))/(1+{_SE!r}*sin(radians(lat))),{_SE / 2!r}) AS rho FROM fix)
SELECT rec_id, round(rho*sin(radians(lon+45)),3)+0.0 AS x, round(0-rho*cos(radians(lon+45)),3)+0.0 AS y, round(lat,6) AS lat, round(lon,6)+0.0 AS lon FROM r"""
)
def stere_roundtrip(spark, sf_dir):
    x, y = _S.forward(F.col("lat"), F.col("lon"))
    rows = fix(spark, sf_dir).select("rec_id", x.alias("x"), y.alias("y"))
    lat, lon = _S.inverse(F.col("x"), F.col("y"))
    return rows.select("rec_id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"), F.round(lat, 6).alias("lat"), (F.round(lon, 6) + 0.0).alias("lon"))


@query(
    ctes(FIX)
    + f""", u AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY traj_id, ts) AS n FROM fix) WHERE n=1),
 l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(epoch(ts)) OVER w AS s0 FROM u WINDOW w AS (PARTITION BY traj_id ORDER BY ts, rec_id)),
 d AS (SELECT *, {sql_haversine("lat0", "lon0", "lat", "lon")} AS dist FROM l), v AS (SELECT *, dist/((epoch(ts)-s0)/3600) AS speed FROM d),
 m AS (SELECT *, avg(speed) OVER (PARTITION BY traj_id) AS mean, stddev_samp(speed) OVER (PARTITION BY traj_id) AS sd FROM v),
 b AS (SELECT *, coalesce(coalesce(dist,1)=0 OR coalesce(speed,mean)>mean+3*sd,false) AS bad FROM m),
 n AS (SELECT *, coalesce(lead(bad) OVER (PARTITION BY traj_id ORDER BY ts, rec_id),false) AS nxt FROM b)
SELECT traj_id, rec_id FROM n WHERE NOT bad AND NOT nxt"""
)
def traj_one_pass_filter(spark, sf_dir):
    f = fix(spark, sf_dir)
    valid = f.where(F.col("lat").between(-90, 90) & ~F.isnan("lat") & ~F.isnan("lon"))
    return tr.one_pass(valid).select("traj_id", "rec_id")


#: The passes, one after another; a row without a record keeps each trajectory in the table when all its records go.
_SETTLE = (
    "WITH RECURSIVE " + FIX
    + f""", r AS (SELECT 0 AS pass, traj_id, rec_id, ts, lat, lon, CAST(-1 AS BIGINT) AS had FROM fix UNION ALL SELECT DISTINCT 0, traj_id, NULL, NULL, NULL, NULL, CAST(-1 AS BIGINT) FROM fix),
 p AS (SELECT * FROM r UNION ALL (
  WITH c AS (SELECT *, count(rec_id) OVER (PARTITION BY traj_id) AS now FROM p),
  g AS (SELECT * FROM c WHERE now<>had),
  u AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY traj_id, ts) AS same FROM g) WHERE rec_id IS NULL OR same=1),
  l AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ts) OVER w AS ts0 FROM u WHERE rec_id IS NOT NULL WINDOW w AS (PARTITION BY traj_id ORDER BY ts, rec_id)),
  d AS (SELECT *, {sql_haversine("lat0", "lon0", "lat", "lon")} AS dist, (epoch_us(ts)-epoch_us(ts0))/3.6e9 AS hours FROM l),
  m AS (SELECT *, dist/hours AS speed, avg(dist/hours) OVER (PARTITION BY traj_id) AS mean, stddev_samp(dist/hours) OVER (PARTITION BY traj_id) AS sd FROM d),
  b AS (SELECT *, coalesce(dist=0 OR speed>mean+3*sd,false) AS bad FROM m),
  n AS (SELECT *, coalesce(lead(bad) OVER (PARTITION BY traj_id ORDER BY ts, rec_id),false) AS nxt FROM b)
  SELECT pass+1, traj_id, rec_id, ts, lat, lon, now FROM n WHERE NOT bad AND NOT nxt UNION ALL SELECT pass+1, traj_id, NULL, NULL, NULL, NULL, now FROM g WHERE rec_id IS NULL))
SELECT traj_id, rec_id, ts, lat, lon, source FROM (SELECT *, max(pass) OVER (PARTITION BY traj_id) AS last FROM p) JOIN fix USING (traj_id, rec_id, ts, lat, lon) WHERE pass=last"""
)
#: Both walks, record by record.
_GATE = (
    "WITH RECURSIVE " + FIX
    + f""", u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, ts ORDER BY rec_id) AS k FROM fix) WHERE k=1),
 o AS (SELECT traj_id, rec_id, lat, lon, epoch_us(ts)/3.6e9 AS h, row_number() OVER (PARTITION BY traj_id ORDER BY ts) AS i, row_number() OVER (PARTITION BY traj_id ORDER BY ts DESC) AS j,
   lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(epoch_us(ts)) OVER w AS us0, epoch_us(ts) AS us FROM u WINDOW w AS (PARTITION BY traj_id ORDER BY ts)),
 s AS (SELECT traj_id, avg(v)+3*stddev_pop(v) AS fastest, count(*)+1 AS n FROM (SELECT traj_id, {sql_haversine("lat0", "lon0", "lat", "lon")}/((us-us0)/3.6e9) AS v FROM o WHERE lat0 IS NOT NULL) GROUP BY 1),
 q AS (SELECT traj_id, rec_id, lat, lon, h, true AS ahead, i AS k FROM o UNION ALL SELECT traj_id, rec_id, lat, lon, h, false, j FROM o),
 w AS (SELECT traj_id, ahead, k, rec_id, lat AS plat, lon AS plon, h AS ph, true AS kept FROM q WHERE k=1
  UNION ALL SELECT traj_id, ahead, k, rec_id, CASE WHEN ok THEN lat ELSE plat END, CASE WHEN ok THEN lon ELSE plon END, CASE WHEN ok THEN h ELSE ph END, ok
  FROM (SELECT q.traj_id, q.ahead, q.k, q.rec_id, q.lat, q.lon, q.h, w.plat, w.plon, w.ph, {sql_haversine("plat", "plon", "q.lat", "q.lon")}/abs(q.h-ph)<=fastest AS ok FROM w JOIN q ON q.traj_id=w.traj_id AND q.ahead=w.ahead AND q.k=w.k+1 JOIN s ON s.traj_id=w.traj_id)),
 c AS (SELECT traj_id, count(*) FILTER (WHERE ahead AND kept) >= count(*) FILTER (WHERE NOT ahead AND kept) AS forward FROM w GROUP BY 1)
SELECT fix.traj_id, fix.rec_id, fix.ts, fix.lat, fix.lon, fix.source FROM fix JOIN o ON o.traj_id=fix.traj_id AND o.rec_id=fix.rec_id JOIN c ON c.traj_id=fix.traj_id LEFT JOIN s ON s.traj_id=fix.traj_id
 LEFT JOIN w ON w.traj_id=fix.traj_id AND w.rec_id=fix.rec_id AND w.ahead=c.forward WHERE coalesce(s.n,1)<3 OR w.kept"""
)


@query(_SETTLE)
def traj_fixed_point(spark, sf_dir):
    return tr.by_trajectory(fix(spark, sf_dir), tr.settle)


@query(_GATE)
def traj_velocity_gate(spark, sf_dir):
    return tr.by_trajectory(fix(spark, sf_dir), tr.gate)


@query(ctes(FIX) + _STEP + f" SELECT traj_id, round(sum({sql_haversine('lat0', 'lon0', 'lat', 'lon')}),4) AS total_km, count(*) AS n FROM st GROUP BY traj_id")
def traj_distance(spark, sf_dir):
    return tr.steps(fix(spark, sf_dir)).groupBy("traj_id").agg(F.round(F.sum("dist"), 4).alias("total_km"), F.count(F.lit(1)).alias("n"))


@query(
    ctes(FIX)
    + "SELECT traj_id, arg_min(rec_id, (ts, rec_id)) AS first_rec, arg_max(rec_id, (ts, rec_id)) AS last_rec, min(ts) AS first_ts, max(ts) AS last_ts, min(lat) AS lat_min, max(lat) AS lat_max, count(DISTINCT ts) AS n_times, CASE WHEN bool_and(lat>0) THEN 'nh' WHEN bool_and(lat<0) THEN 'sh' ELSE 'both' END AS area FROM fix GROUP BY traj_id"
)
def traj_first_last(spark, sf_dir):
    at = F.struct("ts", "rec_id")
    area = F.when(F.bool_and(F.col("lat") > 0), "nh").when(F.bool_and(F.col("lat") < 0), "sh").otherwise("both")
    return fix(spark, sf_dir).groupBy("traj_id").agg(
        F.min_by("rec_id", at).alias("first_rec"), F.max_by("rec_id", at).alias("last_rec"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.countDistinct("ts").alias("n_times"), area.alias("area")
    )


@query(
    ctes(FIX)
    + """, k AS (SELECT traj_id FROM fix GROUP BY traj_id HAVING min(ts)<=TIMESTAMP '2024-01-10 01:00:00' AND max(ts)>=TIMESTAMP '2024-01-20' AND min(lat)>=59 AND max(abs(lat))>60),
 r AS (SELECT f.* FROM fix f JOIN k USING (traj_id) WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'), c AS (SELECT traj_id FROM r GROUP BY 1 HAVING count(*)>1)
SELECT r.traj_id, r.rec_id, r.ts FROM r JOIN c USING (traj_id)"""
)
def traj_window_select(spark, sf_dir):
    """Trajectories that cover a window, their records in it, and at least two of them."""
    f = fix(spark, sf_dir)
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    k = f.groupBy("traj_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.min("lat").alias("lo"), F.max(F.abs("lat")).alias("hi"))
    k = k.where((F.col("a") <= t("2024-01-10 01:00:00")) & (F.col("b") >= t("2024-01-20")) & (F.col("lo") >= 59) & (F.col("hi") > 60)).select("traj_id")
    r = f.where(F.col("ts").between(t("2024-01-10"), t("2024-01-20"))).join(k, "traj_id", "left_semi")
    return r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("traj_id"))).where("n > 1").select("traj_id", "rec_id", "ts")


@query(ctes(FIX) + "SELECT traj_id, round(min(lat),6) AS lat_min, round(max(lat),6) AS lat_max, round(min(lon),6) AS lon_min, round(max(lon),6) AS lon_max, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM fix GROUP BY traj_id")
def buoy_coverage(spark, sf_dir):
    r = lambda f, c: F.round(f(c), 6).alias(f"{c}_{f.__name__}")
    return fix(spark, sf_dir).groupBy("traj_id").agg(r(F.min, "lat"), r(F.max, "lat"), r(F.min, "lon"), r(F.max, "lon"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query(
    ctes(FIX)
    + """, m AS (SELECT traj_id, ts, lon, lat-75*(traj_id%3) AS lat FROM fix), c AS (SELECT traj_id, min(lat) AS lo, max(lat) AS hi, count(*) AS n FROM m GROUP BY 1)
SELECT traj_id, round(lo,6)+0.0 AS lat_min, round(hi,6)+0.0 AS lat_max, n, CASE WHEN lo>0 THEN 'Northern Hemisphere' WHEN hi<0 THEN 'Southern Hemisphere' ELSE 'refused' END AS area FROM c"""
)
def buoy_areas(spark, sf_dir):
    """The hemisphere of each trajectory; those that cross the equator are refused (every third lies in the middle, every third in the south)."""
    got = tr.coverage(fix(spark, sf_dir).withColumn("lat", F.col("lat") - 75 * (F.col("traj_id") % 3)))
    return got.select("traj_id", (F.round("lat_min", 6) + 0.0).alias("lat_min"), (F.round("lat_max", 6) + 0.0).alias("lat_max"), "n", F.when(F.col("refused"), "refused").otherwise(F.col("area")).alias("area"))


@query(
    ctes(FIX)
    + "SELECT traj_id, string_agg(CAST(rec_id AS VARCHAR), ',' ORDER BY ts, rec_id) AS records, count(*) AS n, date_diff('second', min(ts), max(ts))/86400 AS days FROM (SELECT traj_id, rec_id, date_trunc('second', ts) AS ts FROM fix) GROUP BY traj_id"
)
def trajectory_pack(spark, sf_dir):
    """Records of a trajectory as one array, in order; a trajectory's record is bounded."""
    f = fix(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    packed = f.groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("ts", "rec_id"))).alias("r"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return packed.select("traj_id", F.array_join(F.transform("r", lambda x: x["rec_id"].cast("string")), ",").alias("records"), F.size("r").cast("long").alias("n"), (F.timestamp_diff("SECOND", F.col("a"), F.col("b")) / 86400).alias("days"))


@query(ctes(FIX) + "SELECT traj_id, place, rec_id FROM (SELECT traj_id, rec_id, row_number() OVER (PARTITION BY traj_id ORDER BY ts, rec_id)-1 AS place FROM fix)")
def trajectory_scan(spark, sf_dir):
    """The padded collection read back: one row for each record and its place."""
    packed = fix(spark, sf_dir).groupBy("traj_id").agg(F.array_sort(F.collect_list(F.struct("ts", "rec_id"))).alias("r"))
    return packed.select("traj_id", F.posexplode("r").alias("place", "x")).select("traj_id", F.col("place").cast("long").alias("place"), F.col("x.rec_id").alias("rec_id"))


@query(
    ctes(FIX)
    + """, a AS (SELECT traj_id, rec_id, ts FROM fix WHERE source='gps'), b AS (SELECT traj_id, rec_id AS right_id, ts AS rts FROM fix WHERE source='argos'),
 j AS (SELECT a.traj_id, a.rec_id, right_id, abs(epoch_us(rts)-epoch_us(ts))/1e6 AS gap FROM a JOIN b ON a.traj_id=b.traj_id AND abs(epoch_us(rts)-epoch_us(ts))<=10800000000)
SELECT rec_id, right_id, CAST(round(gap*1000000) AS BIGINT) AS gap_us FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY gap, right_id) AS r FROM j) WHERE r=1"""
)
def asof_nearest(spark, sf_dir):
    """The product record nearest in time, three hours off at most."""
    f = fix(spark, sf_dir)
    a = f.where("source = 'gps'").select("traj_id", "rec_id", "ts")
    b = f.where("source = 'argos'").select("traj_id", F.col("rec_id").alias("right_id"), F.col("ts").alias("rts"))
    return tr.nearest_in_time(a, b, "traj_id", 10800, "rec_id", "right_id").select("rec_id", "right_id", F.round(F.col("gap") * 1e6).cast("long").alias("gap_us"))


@query(
    ctes(FIX)
    + """, j AS (SELECT a.rec_id, b.rec_id AS end_id, abs(epoch_us(b.ts)-epoch_us(a.ts)-86400000000)/1e6 AS off FROM fix a JOIN fix b ON a.traj_id=b.traj_id AND abs(epoch_us(b.ts)-epoch_us(a.ts)-86400000000)<=3600000000)
SELECT rec_id, end_id, CAST(round(off*1000000) AS BIGINT) AS off_us FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY off, end_id) AS r FROM j) WHERE r=1"""
)
def asof_duration(spark, sf_dir):
    """The record whose elapsed time is nearest to a day, an hour off at most."""
    f = fix(spark, sf_dir)
    a = f.select("traj_id", "rec_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    b = f.select("traj_id", F.col("rec_id").alias("end_id"), F.col("ts").alias("rts"))
    return tr.nearest_in_time(a, b, "traj_id", 3600, "rec_id", "end_id").select("rec_id", "end_id", F.round(F.col("gap") * 1e6).cast("long").alias("off_us"))


@query(ctes(FIX) + ", m AS (SELECT min(ts) AS t FROM fix) SELECT rec_id, CASE WHEN source='gcp' THEN t ELSE ts END AS ref_time, source='gcp' AS static FROM fix, m")
def static_points(spark, sf_dir):
    """A control point has no time of its own: the product's first is used."""
    f = fix(spark, sf_dir)
    first = f.agg(F.min("ts").alias("t"))  # one row
    return f.join(F.broadcast(first)).select("rec_id", F.when(F.col("source") == "gcp", F.col("t")).otherwise(F.col("ts")).alias("ref_time"), (F.col("source") == "gcp").alias("static"))


@query(
    ctes(FIX, VEC)
    + """, g AS (SELECT x AS cx, y AS cy, avg(dx) AS dx, avg(sigma) AS sigma FROM vec WHERE flag IN (0,13,17) GROUP BY ALL),
 p AS (SELECT rec_id, (lat-60)/30*49 AS px, (lon+180)/360*39 AS py FROM fix), c AS (SELECT rec_id, CAST(floor(px) AS BIGINT)+i AS cx, CAST(floor(py) AS BIGINT)+j AS cy,
 CASE WHEN i=0 THEN 1-(px-floor(px)) ELSE px-floor(px) END*CASE WHEN j=0 THEN 1-(py-floor(py)) ELSE py-floor(py) END AS w FROM p, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j))
SELECT rec_id, round(sum(w*dx)/sum(w),8)+0.0 AS dx, round(sum(w*sigma)/sum(w),8) AS sigma, count(*) AS n FROM c JOIN g USING (cx,cy) WHERE w>0 GROUP BY rec_id HAVING sum(w)>0.75"""
)
def bilinear_collocation(spark, sf_dir):
    """Product value at a point: mean of the valid corners by bilinear weight."""
    g = vec(spark, sf_dir).where(F.col("flag").isin(*dims.VALID)).groupBy(F.col("x").alias("cx"), F.col("y").alias("cy")).agg(F.avg("dx").alias("dx"), F.avg("sigma").alias("sigma"))
    p = fix(spark, sf_dir).select("rec_id", F.explode(geo.corners((F.col("lat") - 60) / 30 * 49, (F.col("lon") + 180) / 360 * 39)).alias("c")).select("rec_id", "c.*").where("weight > 0")
    w = F.col("weight")
    rows = p.join(g, ["cx", "cy"]).groupBy("rec_id").agg(F.sum(w).alias("w"), (F.round(F.sum(w * F.col("dx")) / F.sum(w), 8) + 0.0).alias("dx"), F.round(F.sum(w * F.col("sigma")) / F.sum(w), 8).alias("sigma"), F.count(F.lit(1)).alias("n"))
    return rows.where("w > 0.75").drop("w")


@query(
    ctes(VEC)
    + "SELECT x, y, obs, sensor, t0 FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY CASE sensor WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END, abs(dx), sigma, obs, t0, dy) AS r FROM vec) WHERE r=1"
)
def dedup_by_rank(spark, sf_dir):
    """One vector for each cell: best source, then smallest offsets; grouped maxima, no window over a cell."""
    rank = F.when(F.col("sensor") < 4, F.col("sensor")).otherwise(4)
    best = vec(spark, sf_dir).groupBy("x", "y").agg(F.min(F.struct(rank.alias("r"), F.abs("dx").alias("a"), "sigma", "obs", "t0", "dy", "sensor")).alias("m"))
    return best.select("x", "y", "m.obs", "m.sensor", "m.t0")


_END = f"""{sql_laea("lat", "lon")[0]} AS x0, {sql_laea("lat", "lon")[1]} AS y0"""


@query(
    ctes(FIX)
    + f""", a AS (SELECT rec_id, lat, lon, {_END}, rec_id%41-20 AS dx, rec_id%37-18 AS dy FROM fix), b AS (SELECT *, x0+dx*1000 AS x1, y0-dy*1000 AS y1 FROM a),
 c AS (SELECT *, 1-(x1*x1+y1*y1)/{geo.WGS84.a**2 * geo.Laea().pole!r} AS r FROM b),
 d AS (SELECT *, asin(r) AS be FROM c),
 e AS (SELECT *, degrees(be+{_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040!r}*sin(2*be)+{23 * _E2**2 / 360 + 251 * _E2**3 / 3780!r}*sin(4*be)+{761 * _E2**3 / 45360!r}*sin(6*be)) AS lat1, degrees(atan2(x1,-y1)) AS lon1 FROM d)
SELECT rec_id, round(lat1,6) AS lat1, round(lon1,6)+0.0 AS lon1, round({sql_haversine("lat", "lon", "lat1", "lon1")},5) AS length FROM e"""
)
def drift_endpoint(spark, sf_dir):
    g = geo.Laea()
    x, y = g.forward(F.col("lat"), F.col("lon"))
    lat, lon = g.inverse(x + (F.col("rec_id") % 41 - 20) * 1000, y - (F.col("rec_id") % 37 - 18) * 1000)
    rows = fix(spark, sf_dir).select("rec_id", "lat", "lon", lat.alias("lat1"), lon.alias("lon1"))
    return rows.select("rec_id", F.round("lat1", 6).alias("lat1"), (F.round("lon1", 6) + 0.0).alias("lon1"), F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1")), 5).alias("length"))


@query(
    ctes(FIX)
    + f""", p AS (SELECT traj_id, arg_min(lat,(ts,rec_id)) AS lat0, arg_min(lon,(ts,rec_id)) AS lon0, arg_max(lat,(ts,rec_id)) AS lat1, arg_max(lon,(ts,rec_id)) AS lon1 FROM fix GROUP BY 1)
SELECT traj_id, round(({sql_laea("lat1", "lon1")[0]}-{sql_laea("lat0", "lon0")[0]})/1000,4)+0.0 AS xdrift, round(({sql_laea("lat1", "lon1")[1]}-{sql_laea("lat0", "lon0")[1]})/1000,4)+0.0 AS ydrift FROM p"""
)
def displacement_pairs(spark, sf_dir):
    at, g = F.struct("ts", "rec_id"), geo.Laea()
    p = fix(spark, sf_dir).groupBy("traj_id").agg(*(f(c, at).alias(f"{c}{k}") for k, f in enumerate((F.min_by, F.max_by)) for c in ("lat", "lon")))
    a, b = (g.forward(F.col(f"lat{k}"), F.col(f"lon{k}")) for k in (0, 1))
    return p.select("traj_id", (F.round((b[0] - a[0]) / 1000, 4) + 0.0).alias("xdrift"), (F.round((b[1] - a[1]) / 1000, 4) + 0.0).alias("ydrift"))


@query(
    ctes(FIX)
    + """SELECT rec_id, round(degrees(asin(sin(radians(lat))*cos(d)+cos(radians(lat))*sin(d)*cos(az))),6) AS lat1,
 round(lon+degrees(atan2(sin(az)*sin(d)*cos(radians(lat)),cos(d)-sin(radians(lat))*sin(radians(degrees(asin(sin(radians(lat))*cos(d)+cos(radians(lat))*sin(d)*cos(az))))))),6)+0.0 AS lon1
FROM (SELECT rec_id, lat, lon, sqrt(e*e+n*n)/6371.0 AS d, atan2(e,n) AS az FROM (SELECT *, CAST(rec_id%41-20 AS DOUBLE) AS e, CAST(rec_id%37-18 AS DOUBLE) AS n FROM fix))"""
)
def zonal_drift(spark, sf_dir):
    """End point of an eastward and a northward displacement, on the sphere."""
    e, n = (F.col("rec_id") % 41 - 20).cast("double"), (F.col("rec_id") % 37 - 18).cast("double")
    d, az, p = F.sqrt(e * e + n * n) / geo.EARTH_RADIUS, F.atan2(e, n), F.radians("lat")
    lat1 = F.degrees(F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(az)))
    lon1 = F.col("lon") + F.degrees(F.atan2(F.sin(az) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(F.radians(lat1))))
    return fix(spark, sf_dir).select("rec_id", F.round(lat1, 6).alias("lat1"), (F.round(lon1, 6) + 0.0).alias("lon1"))


@query(
    ctes(FIX)
    + """SELECT rec_id, round(u*cos(a)-v*sin(a),6)+0.0 AS dx, round(u*sin(a)+v*cos(a),6)+0.0 AS dy FROM (SELECT rec_id, CAST(rec_id%41-20 AS DOUBLE) AS u, CAST(rec_id%37-18 AS DOUBLE) AS v, radians(lon+45)-radians(lon) AS a FROM fix)"""
)
def vector_rotation(spark, sf_dir):
    """From one polar grid to another: turned by the difference of their meridians."""
    u, v = (F.col("rec_id") % 41 - 20).cast("double"), (F.col("rec_id") % 37 - 18).cast("double")
    a = F.radians(F.col("lon") + 45) - F.radians("lon")
    return fix(spark, sf_dir).select("rec_id", (F.round(u * F.cos(a) - v * F.sin(a), 6) + 0.0).alias("dx"), (F.round(u * F.sin(a) + v * F.cos(a), 6) + 0.0).alias("dy"))


@query(
    ctes(FIX)
    + "SELECT rec_id, CASE WHEN lon<0 THEN lon+360 ELSE lon END AS lon360, CASE WHEN CASE WHEN lon<0 THEN lon+360 ELSE lon END>180 THEN CASE WHEN lon<0 THEN lon+360 ELSE lon END-360 ELSE CASE WHEN lon<0 THEN lon+360 ELSE lon END END AS lon180, round(((lon*3+180)%360+360)%360-180,6)+0.0 AS lon_any FROM fix"
)
def lon_wrap(spark, sf_dir):
    lon = F.col("lon")
    return fix(spark, sf_dir).select("rec_id", geo.wrap360(lon).alias("lon360"), geo.wrap180(geo.wrap360(lon)).alias("lon180"), (F.round(geo.wrap_any(lon * 3), 6) + 0.0).alias("lon_any"))


@query(
    ctes(FIX)
    + "SELECT rec_id, lat*10-600>=0 AND lat*10-600<200 AS in_grid, lon BETWEEN -100.5 AND 100.5 AS in_extent, CAST(trunc((lon)/7) AS BIGINT) AS cut, CAST(floor(lat) AS BIGINT)*144+CAST(floor(abs(lon)) AS BIGINT) AS place, (CAST(floor(lat) AS BIGINT)*144+CAST(floor(abs(lon)) AS BIGINT))//144 AS row_no FROM fix"
)
def point_predicates(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    place = F.floor(lat) * 144 + F.floor(F.abs(lon))
    in_grid = (lat * 10 - 600 >= 0) & (lat * 10 - 600 < 200)
    return fix(spark, sf_dir).select("rec_id", in_grid.alias("in_grid"), lon.between(-100.5, 100.5).alias("in_extent"), geo.truncate(lon / 7).cast("long").alias("cut"), place.alias("place"), F.floor(place / 144).alias("row_no"))


@query(
    "SELECT event_id, CASE WHEN value=0 THEN 0.0 ELSE round(value*pow(10.0, 2.0-floor(log10(abs(value)))))/pow(10.0, 2.0-floor(log10(abs(value)))) END AS rounded, round(greatest(CAST(event_id%5 AS DOUBLE),1.0)*38.88,6) AS max_drift, round(pow(10.0,value/1000),6) AS linear, round(log10(value+1)*10,6) AS db, round(0.01*value*2,6) AS kp FROM events"
)
def db_linear(spark, sf_dir):
    """Significant figures, longest possible drift, and decibels."""
    from spindrift.runtime import table

    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", geo.round_significant(v, 3).alias("rounded"), F.round(geo.max_drift_km(F.col("event_id") % 5), 6).alias("max_drift"), F.round(F.pow(F.lit(10.0), v / 1000), 6).alias("linear"), F.round(F.log10(v + 1) * 10, 6).alias("db"), F.round(F.lit(0.01) * v * 2, 6).alias("kp")
    )


_MATCH = """, b AS (SELECT traj_id, arg_min(rec_id,(ts,rec_id)) AS id0, arg_min(lat,(ts,rec_id)) AS lat0, arg_min(lon,(ts,rec_id)) AS lon0, arg_max(lat,(ts,rec_id)) AS lat1, arg_max(lon,(ts,rec_id)) AS lon1, min(ts) AS t0, max(ts) AS t1 FROM fix GROUP BY 1)"""


@query(
    ctes(FIX)
    + _MATCH
    + f"""SELECT traj_id, round({sql_haversine("lat0", "lon0", "lat1", "lon1")},5) AS len, round({sql_bearing("lat0", "lon0", "lat1", "lon1")},5) AS dir, round({sql_haversine("lat0", "lon0", "lat0+0.1", "lon0+0.2")},5) AS col_dist,
 round((epoch_us(t0)-epoch_us(TIMESTAMP '2024-01-01 12:00:00'))/3.6e9,5)+0.0 AS col_dtb, round((epoch_us(t1)-epoch_us(t0))/3.6e9-48,5)+0.0 AS col_ddur, round((epoch_us(t0)-epoch_us(TIMESTAMP '2024-01-01'))/(30*86.4e9),6) AS elapsed FROM b"""
)
def matchup_derive(spark, sf_dir):
    """Length, direction, distance and time offsets of a matchup, and the fraction of a period that has elapsed."""
    at = F.struct("ts", "rec_id")
    b = fix(spark, sf_dir).groupBy("traj_id").agg(*(f(c, at).alias(f"{c}{k}") for k, f in enumerate((F.min_by, F.max_by)) for c in ("lat", "lon")), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    ends = [F.col(c) for c in ("lat0", "lon0", "lat1", "lon1")]
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
    day0 = lambda s: us(F.lit(s).cast("timestamp_ntz"))
    t0, t1 = us(F.col("t0")), us(F.col("t1"))
    return b.select(
        "traj_id",
        F.round(geo.haversine(*ends), 5).alias("len"),
        F.round(geo.bearing(*ends), 5).alias("dir"),
        F.round(geo.haversine(ends[0], ends[1], ends[0] + 0.1, ends[1] + 0.2), 5).alias("col_dist"),
        (F.round((t0 - day0("2024-01-01 12:00:00")) / 3.6e9, 5) + 0.0).alias("col_dtb"),
        (F.round((t1 - t0) / 3.6e9 - 48, 5) + 0.0).alias("col_ddur"),
        F.round((t0 - day0("2024-01-01")) / (30 * 86.4e9), 6).alias("elapsed"),
    )


@query(ctes(FIX) + "SELECT traj_id, rec_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, ts ORDER BY rec_id) AS r FROM fix) WHERE r=1")
def traj_unique_time(spark, sf_dir):
    """The first record of each time stays."""
    return fix(spark, sf_dir).groupBy("traj_id", "ts").agg(F.min("rec_id").alias("rec_id")).select("traj_id", "rec_id", "ts")


@query(ctes(FIX) + "SELECT rec_id, source AS val_source, round(lat,6) AS val_lat, traj_id AS prd_id FROM fix WHERE source IN ('gps','argos') AND lat>65")
def nested_access(spark, sf_dir):
    """Fields of the two sides of a matchup by their path."""
    m = fix(spark, sf_dir).select("rec_id", F.struct("source", "lat").alias("val"), F.struct(F.col("traj_id").alias("id")).alias("prd"))
    return m.where(F.col("val.source").isin("gps", "argos") & (F.col("val.lat") > 65)).select("rec_id", F.col("val.source").alias("val_source"), F.round("val.lat", 6).alias("val_lat"), F.col("prd.id").alias("prd_id"))


_A2 = geo.WGS84.a**2 * geo.Laea().pole


@query(
    ctes(FIX)
    + f""", a AS (SELECT rec_id, CAST(rec_id%2000-1000 AS DOUBLE)*1500 AS x0, CAST(rec_id%1700-850 AS DOUBLE)*1700+37 AS y0 FROM fix), b AS (SELECT *, asin(1-(x0*x0+y0*y0)/{_A2!r}) AS be FROM a),
 c AS (SELECT rec_id, degrees(be+{_E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040!r}*sin(2*be)+{23 * _E2**2 / 360 + 251 * _E2**3 / 3780!r}*sin(4*be)+{761 * _E2**3 / 45360!r}*sin(6*be)) AS lat, degrees(atan2(x0,-y0)) AS lon FROM b),
 r AS (SELECT rec_id, lon, {_S.scale!r}*tan(pi()/4-radians(lat)/2)/pow((1-{_SE!r}*sin(radians(lat)))/(1+{_SE!r}*sin(radians(lat))),{_SE / 2!r}) AS rho FROM c)
SELECT rec_id, round(rho*sin(radians(lon+45)),2)+0.0 AS x, round(0-rho*cos(radians(lon+45)),2)+0.0 AS y FROM r"""
)
def grid_remap(spark, sf_dir):
    """A place on one grid as a place on another: inverse, then forward."""
    k = F.col("rec_id")
    lat, lon = geo.Laea().inverse((k % 2000 - 1000).cast("double") * 1500, (k % 1700 - 850).cast("double") * 1700 + 37)
    x, y = _S.forward(F.col("lat"), F.col("lon"))
    rows = fix(spark, sf_dir).select("rec_id", lat.alias("lat"), lon.alias("lon"))
    return rows.select("rec_id", (F.round(x, 2) + 0.0).alias("x"), (F.round(y, 2) + 0.0).alias("y"))
