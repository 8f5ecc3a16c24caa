"""Merging, masks, flags, coverage and gap-filling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import dims
from spindrift.operators import merge
from spindrift.queries.adapters import VEC, ctes, vec
from spindrift.queries.registry import query

_OK = "(sigma < 50 AND flag NOT IN (1,2,3,4,5,20) AND dx IS NOT NULL AND dy IS NOT NULL)"


@query(
    ctes(VEC)
    + f""", f AS (SELECT DISTINCT cell FROM vec WHERE sensor<>7 AND flag IN (0,13,17)),
 m AS (SELECT v.*, {_OK} AND NOT (60+y%30>=87.5 AND flag<>0) AND (sensor<>7 OR f.cell IS NOT NULL) AS ok FROM vec v LEFT JOIN f USING (cell))
SELECT cell, round(sum(dx/(sigma*sigma)) FILTER (WHERE ok)/sum(1/(sigma*sigma)) FILTER (WHERE ok),6) AS dx,
 round(sum(dy/(sigma*sigma)) FILTER (WHERE ok)/sum(1/(sigma*sigma)) FILTER (WHERE ok),6) AS dy,
 round(1.5*sqrt(1/sum(1/(sigma*sigma)) FILTER (WHERE ok)),6) AS sigma,
 min(CASE WHEN ok THEN flag ELSE 100 END) AS flag,
 max(CASE WHEN flag IN (1,2,3,4,5,20) THEN 1 ELSE 0 END) AS no_fill, count(*) FILTER (WHERE ok) AS n_used FROM m GROUP BY cell"""
)
def merge_inverse_variance(spark, sf_dir):
    """The merge of all sensors, of which the seventh is the wind model, under the masks of the pole and of the satellites' footprint."""
    return merge.inverse_variance(vec(spark, sf_dir), "cell", lat=60 + F.col("y") % 30, wind=F.col("sensor") == 7)


@query(
    ctes(VEC)
    + """, c AS (SELECT sensor, CAST(t0 AS DATE) AS d, count(*) FILTER (WHERE flag IN (0,13,17) AND 60+y%30<86) AS n_valid, count(*) FILTER (WHERE (flag<=0 OR flag>5) AND 60+y%30<86) AS n_ice FROM vec GROUP BY ALL)
SELECT sensor, CAST(d AS VARCHAR) AS d, n_valid, n_ice, round(n_valid/nullif(n_ice,0),6) AS ratio FROM c WHERE n_ice=0 OR n_valid/n_ice >= 0.4"""
)
def sensor_coverage_ratio(spark, sf_dir):
    found = merge.coverage(vec(spark, sf_dir).withColumn("d", F.to_date("t0")), "sensor", "d", where=60 + F.col("y") % 30 < merge.POLE_HOLE)
    return found.where("n_ice = 0 or n_valid / n_ice >= 0.4").withColumn("d", F.col("d").cast("string"))


@query(
    ctes(VEC)
    + """, h AS (SELECT *, CASE WHEN obs%2=0 THEN 'nh' ELSE 'sh' END AS area FROM vec),
 c AS (SELECT area, CAST(t0 AS DATE) AS d, count(DISTINCT cell) FILTER (WHERE flag IN (0,13,17)) AS n_cells FROM h WHERE NOT (area='nh' AND month(t0) IN (6,7,8,9)) AND NOT (area='sh' AND month(t0) IN (11,12,1,2)) GROUP BY ALL)
SELECT area, CAST(d AS VARCHAR) AS d, n_cells, least(floor(n_cells/2.0)+1, 30)::INTEGER AS bin, row_number() OVER (PARTITION BY area ORDER BY n_cells, d) AS place FROM c"""
)
def daily_union_coverage(spark, sf_dir):
    """Cells that any sensor covers by hemisphere and day, outside the melting season of each."""
    month = F.month("t0")
    rows = vec(spark, sf_dir).withColumn("area", F.when(F.col("obs") % 2 == 0, "nh").otherwise("sh"))
    rows = rows.where(F.when(F.col("area") == "nh", ~month.between(6, 9)).otherwise(month.between(3, 10))).withColumn("d", F.to_date("t0"))
    found = rows.groupBy("area", "d").agg(F.countDistinct(F.when(F.col("flag").isin(*dims.VALID), F.col("cell"))).alias("n_cells"))
    bin_ = F.least(F.floor(F.col("n_cells") / 2.0) + 1, F.lit(30)).cast("int").alias("bin")
    # one row for each day of a hemisphere: the report is as long as the record, 366 rows a year
    place = F.row_number().over(Window.partitionBy("area").orderBy("n_cells", "d")).cast("long").alias("place")
    return found.select("area", F.col("d").cast("string").alias("d"), "n_cells", bin_, place)


@query(
    ctes(VEC)
    + """, c AS (SELECT sensor, CAST(t0 AS DATE) AS d, count(*) FILTER (WHERE flag IN (0,13,17)) AS v, count(*) FILTER (WHERE flag<=0 OR flag>5) AS n FROM vec GROUP BY ALL),
 r AS (SELECT sensor, CASE WHEN n=0 THEN NULL ELSE v/n END AS ratio FROM c)
SELECT sensor, CASE WHEN ratio>0 AND ratio<=0.3 THEN 'low' WHEN ratio>0.3 AND ratio<=0.4 THEN 'mid' WHEN ratio>0.4 AND ratio<=0.5 THEN 'near' ELSE 'other' END AS band, count(*) AS n_days FROM r GROUP BY ALL"""
)
def daily_ratio_bands(spark, sf_dir):
    v, n = F.count_if(F.col("flag").isin(*dims.VALID)), F.count_if((F.col("flag") <= 0) | (F.col("flag") > 5))
    rows = vec(spark, sf_dir).groupBy("sensor", F.to_date("t0").alias("d")).agg(F.try_divide(v, n).alias("ratio"))
    r = F.col("ratio")
    band = F.when((r > 0) & (r <= 0.3), "low").when((r > 0.3) & (r <= 0.4), "mid").when((r > 0.4) & (r <= 0.5), "near").otherwise("other")
    return rows.groupBy("sensor", band.alias("band")).agg(F.count(F.lit(1)).alias("n_days"))


@query(
    ctes(VEC)
    + """, m AS (SELECT cell, bool_or(flag IN (0,13,17) AND sensor=1) AS ever, min(t0) AS first_t, max(t0) AS last_t FROM vec GROUP BY cell)
SELECT v.obs, v.cell, v.sensor, v.t0, CASE WHEN ever THEN dx END AS dx, CASE WHEN ever THEN v.flag ELSE 20 END AS flag, first_t, last_t FROM vec v JOIN m USING (cell)"""
)
def max_drift_mask(spark, sf_dir):
    v = vec(spark, sf_dir)
    mask = v.groupBy("cell").agg(F.bool_or(F.col("flag").isin(*dims.VALID) & (F.col("sensor") == 1)).alias("ever"), F.min("t0").alias("first_t"), F.max("t0").alias("last_t"))
    rows = v.join(mask, "cell")
    return rows.select("obs", "cell", "sensor", "t0", F.when(F.col("ever"), F.col("dx")).alias("dx"), F.when(F.col("ever"), F.col("flag")).otherwise(F.lit(20)).alias("flag"), "first_t", "last_t")


@query(
    ctes(VEC)
    + """, f AS (SELECT DISTINCT cell FROM vec WHERE sensor<>7 AND flag IN (0,13,17))
SELECT sensor, count(*) AS n, count(*) FILTER (WHERE dx IS NULL OR dy IS NULL OR sigma IS NULL) AS n_missing, count(*) FILTER (WHERE sigma>=50) AS n_wide,
 count(*) FILTER (WHERE 60+y%30>=87.5 AND flag<>0) AS n_pole, count(*) FILTER (WHERE flag IN (1,2,3,4,5,20)) AS n_nofill, count(*) FILTER (WHERE sensor=7 AND f.cell IS NULL) AS n_footprint
FROM vec LEFT JOIN f USING (cell) GROUP BY sensor"""
)
def merge_masking(spark, sf_dir):
    v = vec(spark, sf_dir)
    foot = v.where((F.col("sensor") != 7) & F.col("flag").isin(*dims.VALID)).select("cell").distinct().withColumn("foot", F.lit(True))
    rows = v.join(foot, "cell", "left")
    lat = 60 + F.col("y") % 30
    return rows.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("dx").isNull() | F.col("dy").isNull() | F.col("sigma").isNull()).alias("n_missing"),
        F.count_if(F.col("sigma") >= merge.SIGMA_LIMIT).alias("n_wide"),
        F.count_if((lat >= merge.POLE_LAT) & (F.col("flag") != 0)).alias("n_pole"),
        F.count_if(F.col("flag").isin(*dims.NO_FILL)).alias("n_nofill"),
        F.count_if((F.col("sensor") == 7) & F.col("foot").isNull()).alias("n_footprint"),
    )


_FINAL = dims.values(list(dims.FINAL_FLAG.items()), "flag, final_flag")


@query(ctes(VEC) + f"SELECT obs, cell, sensor, t0, v.flag, f.final_flag FROM vec v LEFT JOIN {_FINAL} f ON v.flag=f.flag")
def final_flags(spark, sf_dir):
    v = vec(spark, sf_dir).select("obs", "cell", "sensor", "t0", "flag")
    return merge.to_final(v, dims.final_flags(spark))


@query(
    ctes(VEC)
    + f"""SELECT obs, sensor, t0, round(dx,6) AS dx, round(0-dy,6) AS dy, f.final_flag AS status_flag, CAST(date_diff('second', TIMESTAMP '1978-01-01', t0) AS BIGINT) AS t_1978
FROM vec v LEFT JOIN {_FINAL} f ON v.flag=f.flag"""
)
def final_projection(spark, sf_dir):
    rows = merge.to_final(vec(spark, sf_dir), dims.final_flags(spark))
    seconds = F.timestamp_diff("SECOND", F.lit("1978-01-01").cast("timestamp_ntz"), F.col("t0"))
    return rows.select("obs", "sensor", "t0", F.round("dx", 6).alias("dx"), F.round(0 - F.col("dy"), 6).alias("dy"), F.col("final_flag").alias("status_flag"), seconds.alias("t_1978"))


_CELLS = """, cells AS (SELECT x, y, avg(CASE WHEN flag IN (0,13,17) AND sensor=1 THEN dx END) AS dx, avg(CASE WHEN flag IN (0,13,17) AND sensor=1 THEN sigma END) AS sigma FROM vec GROUP BY x, y),
 o AS (SELECT i, j, i*i+j*j AS d2 FROM (SELECT unnest(range(-4,5)) AS i), (SELECT unnest(range(-4,5)) AS j) WHERE i*i+j*j<=16),
 g AS (SELECT c.x, c.y, sum(exp(-d2/(8.0/3*8.0/3*2))*s.dx)/sum(CASE WHEN s.dx IS NOT NULL THEN exp(-d2/(8.0/3*8.0/3*2)) END) AS fdx,
 sum(exp(-d2/(8.0/3*8.0/3*2))*s.sigma)/sum(CASE WHEN s.sigma IS NOT NULL THEN exp(-d2/(8.0/3*8.0/3*2)) END) AS fsig
 FROM cells c, o JOIN cells s ON s.x=c.x+i AND s.y=c.y+j GROUP BY ALL)
"""


def _cells(spark, sf_dir):
    good = F.col("flag").isin(*dims.VALID) & (F.col("sensor") == 1)
    return vec(spark, sf_dir).groupBy("x", "y").agg(F.avg(F.when(good, F.col("dx"))).alias("dx"), F.avg(F.when(good, F.col("sigma"))).alias("sigma"))


@query(ctes(VEC) + _CELLS + "SELECT c.x, c.y, round(coalesce(dx,fdx),6) AS dx, round(coalesce(sigma,fsig),6) AS sigma, dx IS NULL AS filled FROM cells c JOIN g USING (x,y)")
def gaussian_gapfill(spark, sf_dir):
    """300 km on a 75 km grid, weights exp(-d^2 / s^2) with s = 200 km * sqrt 2."""
    cells = _cells(spark, sf_dir)
    filled = merge.gaussian_fill(cells, cells.where("dx is not null"), 4, 8.0 / 3 * 2**0.5, "dx", "sigma")
    return filled.select("x", "y", F.round("dx", 6).alias("dx"), F.round("sigma", 6).alias("sigma"), F.col("dx_filled").alias("filled"))


@query(
    ctes(VEC)
    + """, cells AS (SELECT x, y, avg(CASE WHEN flag IN (0,13,17) THEN dx END) AS a, count(*) FILTER (WHERE flag IN (0,13,17)) AS n FROM vec GROUP BY x, y),
 o AS (SELECT i, j, i*i+j*j AS d2 FROM (SELECT unnest(range(-3,4)) AS i), (SELECT unnest(range(-3,4)) AS j) WHERE i*i+j*j<=9),
 g AS (SELECT c.x, c.y, sum(exp(-d2/4.5)*s.a)/sum(exp(-d2/4.5)) AS far, sum(CASE WHEN d2<=1 THEN exp(-d2/0.5)*s.a END)/sum(CASE WHEN d2<=1 THEN exp(-d2/0.5) END) AS near
 FROM cells c, o JOIN cells s ON s.x=c.x+i AND s.y=c.y+j WHERE s.n>5 GROUP BY ALL)
SELECT c.x, c.y, round(CASE WHEN n>5 THEN near ELSE far END,6) AS a_gapfill, CASE WHEN n>5 THEN 0 WHEN far IS NOT NULL THEN 19 ELSE 4 END AS flag FROM cells c LEFT JOIN g USING (x,y)"""
)
def param_gapfill(spark, sf_dir):
    """Cells with enough data are smoothed over a small radius, the others filled over a large one."""
    good = F.col("flag").isin(*dims.VALID)
    cells = vec(spark, sf_dir).groupBy("x", "y").agg(F.avg(F.when(good, F.col("dx"))).alias("a"), F.count_if(good).alias("n"))
    s = cells.where("n > 5").select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("a").alias("s"))
    pairs = merge.around(cells.select("x", "y"), merge.offsets(3)).join(s, ["nx", "ny"])
    wf, wn = F.exp(-F.col("d2") / 4.5), F.when(F.col("d2") <= 1, F.exp(-F.col("d2") / 0.5))
    g = pairs.groupBy("x", "y").agg((F.sum(wf * F.col("s")) / F.sum(wf)).alias("far"), F.try_divide(F.sum(wn * F.col("s")), F.sum(wn)).alias("near"))
    rows = cells.join(g, ["x", "y"], "left")
    return rows.select("x", "y", F.round(F.when(F.col("n") > 5, F.col("near")).otherwise(F.col("far")), 6).alias("a_gapfill"), F.when(F.col("n") > 5, 0).when(F.col("far").isNotNull(), 19).otherwise(4).alias("flag"))


@query(
    ctes(VEC)
    + """, c AS (SELECT cell, count(*) FILTER (WHERE sensor<7 AND flag IN (0,13,17)) AS n_sat, count(*) FILTER (WHERE sensor=7 AND flag IN (0,13,17)) AS n_wind, min(flag) AS f,
 avg(CASE WHEN sensor=7 THEN dx END) AS wdx FROM vec GROUP BY cell)
SELECT cell, CASE WHEN n_sat=0 AND n_wind=0 THEN 16 WHEN n_sat=0 AND n_wind>0 THEN 21 WHEN n_wind>0 AND f IN (0,13,17) THEN 22 ELSE f END AS flag,
 CASE WHEN n_sat=0 THEN CASE WHEN n_wind=0 THEN 3.2 ELSE round(2.7*1.5,6) END END AS sigma_fixed, round(CASE WHEN n_sat=0 THEN wdx END,6) AS dx_fallback FROM c"""
)
def flag_finalise(spark, sf_dir):
    """Flags after filling, the fixed uncertainty of filled cells, and the wind model where no satellite is."""
    ok = F.col("flag").isin(*dims.VALID)
    c = vec(spark, sf_dir).groupBy("cell").agg(
        F.count_if((F.col("sensor") < 7) & ok).alias("n_sat"), F.count_if((F.col("sensor") == 7) & ok).alias("n_wind"), F.min("flag").alias("f"), F.avg(F.when(F.col("sensor") == 7, F.col("dx"))).alias("wdx")
    )
    none, windy = F.col("n_sat") == 0, F.col("n_wind") > 0
    flag = F.when(none & ~windy, 16).when(none & windy, 21).when(windy & F.col("f").isin(*dims.VALID), 22).otherwise(F.col("f"))
    sigma = F.when(none, F.when(~windy, F.lit(3.2)).otherwise(F.round(F.lit(2.7) * 1.5, 6)))
    return c.select("cell", flag.alias("flag"), sigma.alias("sigma_fixed"), F.round(F.when(none, F.col("wdx")), 6).alias("dx_fallback"))


@query(
    ctes(VEC)
    + """, m AS (SELECT cell, CAST(t0 AS DATE) AS d, bool_or(CASE WHEN month(t0) BETWEEN 5 AND 9 THEN flag=0 OR flag BETWEEN 6 AND 18 ELSE flag IN (0,13,17) END) AS valid, bool_or(sensor=1 AND flag=3) AS land FROM vec GROUP BY ALL)
SELECT v.obs, v.cell, v.sensor, v.t0, CASE WHEN land THEN 3 WHEN NOT valid THEN 4 ELSE flag END AS flag, CASE WHEN valid AND NOT land THEN dx END AS dx FROM vec v JOIN m ON v.cell=m.cell AND CAST(v.t0 AS DATE)=m.d"""
)
def ice_mask_apply(spark, sf_dir):
    v = vec(spark, sf_dir).withColumn("d", F.to_date("t0"))
    f = F.col("flag")
    valid = F.when(F.month("t0").between(5, 9), (f == 0) | f.between(6, 18)).otherwise(f.isin(*dims.VALID))
    m = v.groupBy("cell", "d").agg(F.bool_or(valid).alias("valid"), F.bool_or((F.col("sensor") == 1) & (f == 3)).alias("land"))
    rows = v.join(m, ["cell", "d"])
    return rows.select("obs", "cell", "sensor", "t0", F.when(F.col("land"), 3).when(~F.col("valid"), 4).otherwise(f).alias("flag"), F.when(F.col("valid") & ~F.col("land"), F.col("dx")).alias("dx"))


@query(
    ctes(VEC)
    + """SELECT obs, sensor, t0, CASE WHEN flag IN (0,13) AND abs(dx)<5 THEN 17 WHEN flag IN (0,13) AND sigma<1.3 THEN 10 WHEN sigma>10 THEN 14 ELSE flag END AS flag FROM vec"""
)
def final_flag_ladder(spark, sf_dir):
    """Smaller pattern over low correlation over missing neighbours; the rest stays."""
    f = F.col("flag")
    flag = F.when(f.isin(0, 13) & (F.abs("dx") < 5), 17).when(f.isin(0, 13) & (F.col("sigma") < 1.3), 10).when(F.col("sigma") > 10, 14).otherwise(f)
    return vec(spark, sf_dir).select("obs", "sensor", "t0", flag.alias("flag"))
