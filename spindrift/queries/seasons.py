"""Seasons, months, periods, uncertainties and files by date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import calendars, dims
from spindrift.queries.adapters import DAY, FIX, VEC, ctes, day, fix, vec
from spindrift.queries.registry import query
from spindrift.runtime import table

_MD = "(month(d)*100+day(d))"
_SEASON = f"""CASE WHEN area='nh' THEN CASE WHEN {_MD}>=1101 OR {_MD}<=401 THEN 'winter' WHEN {_MD} BETWEEN 601 AND 901 THEN 'summer' WHEN {_MD} BETWEEN 401 AND 601 THEN 'spring' ELSE 'autumn' END
 ELSE CASE WHEN {_MD} BETWEEN 401 AND 1001 THEN 'winter' WHEN {_MD}>=1201 OR {_MD}<=201 THEN 'summer' WHEN {_MD} BETWEEN 1001 AND 1201 THEN 'spring' ELSE 'autumn' END END"""
_HOLD = f"CASE WHEN area='nh' THEN {_MD} BETWEEN 501 AND 1001 ELSE {_MD}>=1101 OR {_MD}<=401 END"


@query(ctes(DAY) + f"SELECT area, {_SEASON} AS season, {_HOLD} AS hold, count(*) AS n FROM day GROUP BY ALL")
def summer_hold(spark, sf_dir):
    d = day(spark, sf_dir)
    return d.groupBy("area", calendars.merge_season(F.col("d"), F.col("area")).alias("season"), calendars.summer_hold(F.col("d"), F.col("area")).alias("hold")).agg(F.count(F.lit(1)).alias("n"))


@query(
    ctes(DAY)
    + f"SELECT rec_id, CASE WHEN ({_HOLD}) AND rec_id%23 NOT IN (1,2,3,4,6,7) THEN 15 ELSE rec_id%23 END AS flag, CASE WHEN ({_HOLD}) AND rec_id%23 NOT IN (1,2,3,4,6,7) THEN NULL ELSE price END AS value, area FROM day"
)
def summer_hold_apply(spark, sf_dir):
    f = F.col("rec_id") % 23
    held = calendars.summer_hold(F.col("d"), F.col("area")) & ~f.isin(1, 2, 3, 4, 6, 7)
    return day(spark, sf_dir).select("rec_id", F.when(held, F.lit(15)).otherwise(f).cast("long").alias("flag"), F.when(~held, F.col("price")).alias("value"), "area")


_FIRST = "make_date(year(d), CASE WHEN s='spring' THEN CASE WHEN area='nh' THEN 4 ELSE 10 END ELSE CASE WHEN area='nh' THEN 9 ELSE 2 END END, 1)"
_LAST = "make_date(year(d), CASE WHEN s='spring' THEN CASE WHEN area='nh' THEN 6 ELSE 12 END ELSE CASE WHEN area='nh' THEN 11 ELSE 4 END END, 1)"
_FRAC = f"""CASE s WHEN 'winter' THEN 1.0 WHEN 'summer' THEN 0.0 WHEN 'spring' THEN 1-CAST(date_diff('day',{_FIRST},CAST(d AS DATE)) AS DOUBLE)/date_diff('day',{_FIRST},{_LAST})
 ELSE CAST(date_diff('day',{_FIRST},CAST(d AS DATE)) AS DOUBLE)/date_diff('day',{_FIRST},{_LAST}) END"""


@query(ctes(DAY) + f", q AS (SELECT *, {_SEASON} AS s FROM day) SELECT rec_id, s AS season, round({_FRAC},6) AS winter, round(1-{_FRAC},6) AS summer FROM q")
def season_fraction(spark, sf_dir):
    w = calendars.winter_fraction(F.col("d"), F.col("area"))
    return day(spark, sf_dir).select("rec_id", calendars.merge_season(F.col("d"), F.col("area")).alias("season"), F.round(w, 6).alias("winter"), F.round(1 - w, 6).alias("summer"))


_SIG = dims.values(dims.SIGMAS, "area, product, season, flag, sigma")


@query(
    ctes(DAY)
    + f""", q AS (SELECT *, {_SEASON} AS s, CASE rec_id%4 WHEN 0 THEN 'amsr' WHEN 1 THEN 'ssmi' ELSE 'wind' END AS product, CASE WHEN rec_id%4<2 THEN CASE rec_id%3 WHEN 0 THEN 0 WHEN 1 THEN 13 ELSE 17 END ELSE CASE WHEN rec_id%3=0 THEN 0 ELSE 19 END END AS flag FROM day),
 f AS (SELECT *, {_FRAC} AS w FROM q),
 j AS (SELECT f.*, u.sigma AS tab FROM f LEFT JOIN {_SIG} u ON u.area=f.area AND u.product=f.product AND u.flag=f.flag AND u.season=CASE WHEN f.product='wind' THEN f.s ELSE 'winter' END)
SELECT rec_id, product, flag, s AS season, round(CASE WHEN product='wind' THEN CASE s WHEN 'winter' THEN 100 WHEN 'summer' THEN tab ELSE w*10+(1-w)*tab END
 ELSE CASE s WHEN 'winter' THEN tab WHEN 'summer' THEN 100 ELSE w*tab+(1-w)*10 END END,6) AS sigma FROM j"""
)
def season_sigma(spark, sf_dir):
    """Table uncertainty in the product's own season, 100 km in the other, linear to 10 km between."""
    d, area = F.col("d"), F.col("area")
    k, m = F.col("rec_id") % 4, F.col("rec_id") % 3
    q = day(spark, sf_dir).withColumns({"season": calendars.merge_season(d, area), "w": calendars.winter_fraction(d, area), "product": F.when(k == 0, "amsr").when(k == 1, "ssmi").otherwise("wind")})
    q = q.withColumn("flag", F.when(k < 2, F.when(m == 0, 0).when(m == 1, 13).otherwise(17)).otherwise(F.when(m == 0, 0).otherwise(19)))
    q = q.withColumn("_season", F.when(F.col("product") == "wind", F.col("season")).otherwise("winter"))
    u = F.broadcast(dims.sigmas(spark).withColumnRenamed("season", "_season"))  # 32 rows
    q = q.join(u, ["area", "product", "flag", "_season"], "left")
    w, tab, s = F.col("w"), F.col("sigma"), F.col("season")
    wind = F.when(s == "winter", F.lit(100.0)).when(s == "summer", tab).otherwise(w * 10 + (1 - w) * tab)
    sat = F.when(s == "winter", tab).when(s == "summer", F.lit(100.0)).otherwise(w * tab + (1 - w) * 10)
    return q.select("rec_id", "product", "flag", "season", F.round(F.when(F.col("product") == "wind", wind).otherwise(sat), 6).alias("sigma"))


_MODES = dims.values(dims.sigmas_of(), "mode, area, family, season, flag, sigma")
_PRODUCTS = ("amsr2-gw1-tb37", "amsr-aqua-bt19", "ssmis-f17", "ascat-metopB", "wind-era5", "ecmwf-era5", "amsr", "cimr")


@query(
    ctes(DAY)
    + f""", q AS (SELECT rec_id, area, CASE rec_id%2 WHEN 0 THEN 'nrt' ELSE 'cdr' END AS mode, list_extract(['{"', '".join(_PRODUCTS)}'], CAST(rec_id//2%8+1 AS INTEGER)) AS product,
   CASE WHEN month(d) IN (5,6,7,8,9) THEN 'summer' ELSE 'winter' END AS season, CASE rec_id%4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 13 ELSE 19 END AS flag FROM day),
 f AS (SELECT *, CASE WHEN product LIKE 'ssmi%' THEN 'ssmi' WHEN product LIKE 'amsr%' THEN replace(product,'tb','bt') WHEN product LIKE 'ascat%' THEN 'ascat' WHEN product LIKE 'wind%' OR product LIKE 'ecmwf%' THEN 'wind' ELSE product END AS family FROM q)
SELECT rec_id, f.mode, product, f.season, f.flag, coalesce(sigma,-1.0)::DOUBLE AS sigma FROM f LEFT JOIN {_MODES} u ON u.mode=f.mode AND u.area=f.area AND u.family=f.family AND u.season=f.season AND u.flag=f.flag"""
)
def mode_sigma(spark, sf_dir):
    """Uncertainty by mode of processing, area, family of product, season and flag; -1 where the table has none."""
    k = F.col("rec_id")
    q = day(spark, sf_dir).select(
        "rec_id", "area", F.when(k % 2 == 0, "nrt").otherwise("cdr").alias("mode"), F.element_at(F.array(*(F.lit(x) for x in _PRODUCTS)), (F.expr("rec_id div 2 % 8") + 1).cast("int")).alias("product"),
        F.when(F.month("d").isin(5, 6, 7, 8, 9), "summer").otherwise("winter").alias("season"), F.when(k % 4 < 2, 0).when(k % 4 == 2, 13).otherwise(19).alias("flag"),
    )
    q = q.withColumn("family", dims.family(F.col("product")))
    return q.join(F.broadcast(dims.mode_sigmas(spark)), ["mode", "area", "family", "season", "flag"], "left").select("rec_id", "mode", "product", "season", "flag", F.coalesce("sigma", F.lit(-1.0)).alias("sigma"))


@query("SELECT event_id, round(1+value/1000+0.015*h*h-0.005*h,9) AS sigma FROM (SELECT event_id, value, greatest(-10.0, least(10.0, hour(ts)-12+minute(ts)/60.0::DOUBLE))::DOUBLE AS h FROM events)")
def sigma_time_inflation(spark, sf_dir):
    a, b, c = dims.TIME_GROWTH["cdr"]
    h = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.hour("ts") - 12 + F.minute("ts") / 60.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(1 + F.col("value") / 1000 + a * h * h + b * h + c, 9).alias("sigma"))


_MID = "make_date(year(d),month(d),15)"


@query(
    ctes(DAY)
    + f""", m AS (SELECT rec_id, CAST(d AS DATE) AS d, {_MID} AS mid FROM day), n AS (SELECT *, CASE WHEN d>=mid THEN CAST(mid + INTERVAL 1 MONTH AS DATE) ELSE CAST(mid - INTERVAL 1 MONTH AS DATE) END AS other FROM m)
SELECT rec_id, month(mid) AS month_1, month(other) AS month_2, abs(date_diff('day',d,other)) AS w1, abs(date_diff('day',d,mid)) AS w2 FROM n"""
)
def month_weights(spark, sf_dir):
    """A date's own month and its neighbour; each weighs as much as the other's middle is far."""
    d = F.to_date("d")
    mid = F.make_date(F.year(d), F.month(d), F.lit(15))
    other = F.when(d >= mid, F.add_months(mid, 1)).otherwise(F.add_months(mid, -1))
    far = lambda x: F.abs(F.datediff(d, x)).cast("long")
    return day(spark, sf_dir).select("rec_id", F.month(mid).cast("long").alias("month_1"), F.month(other).cast("long").alias("month_2"), far(other).alias("w1"), far(mid).alias("w2"))


@query(
    ctes(VEC)
    + """, p AS (SELECT month(t0) AS m, avg(dx) AS a FROM vec GROUP BY 1), q AS (SELECT obs, cell, sensor, t0, dx, month(t0) AS m, CASE WHEN day(t0)>=15 THEN month(t0)%12+1 ELSE (month(t0)+10)%12+1 END AS m2, 1+abs(day(t0)-15) AS w2 FROM vec)
SELECT q.obs, q.cell, q.sensor, q.t0, q.dx, round((30*p1.a+w2*p2.a)/(30+w2),6) AS blended FROM q JOIN p p1 ON q.m=p1.m JOIN p p2 ON q.m2=p2.m"""
)
def month_blend(spark, sf_dir):
    v = vec(spark, sf_dir)
    p = v.groupBy(F.month("t0").alias("m")).agg(F.avg("dx").alias("a"))
    m, dd = F.month("t0"), F.dayofmonth("t0")
    q = v.select("obs", "cell", "sensor", "t0", "dx", m.alias("m"), F.when(dd >= 15, m % 12 + 1).otherwise((m + 10) % 12 + 1).alias("m2"), (1 + F.abs(dd - 15)).alias("w2"))
    # twelve months at most
    rows = q.join(F.broadcast(p), "m").join(F.broadcast(p.select(F.col("m").alias("m2"), F.col("a").alias("b"))), "m2")
    return rows.select("obs", "cell", "sensor", "t0", "dx", F.round((30 * F.col("a") + F.col("w2") * F.col("b")) / (30 + F.col("w2")), 6).alias("blended"))


_P = "(SELECT o_orderkey AS rec_id, year(o_orderdate) AS y, ['Y','H1','H2','Q1','Q2','Q3','Q4','M1','M2','M3','M4','M5','M6','M7','M8','M9','M10','M11','M12'][(o_orderkey%19)+1] AS code FROM orders)"
_W = "CASE code[1] WHEN 'H' THEN 6 WHEN 'Q' THEN 3 WHEN 'M' THEN 1 ELSE 12 END"
_N = "CASE WHEN code='Y' THEN 1 ELSE CAST(code[2:] AS INTEGER) END"
_CODES = ["Y", *(f"H{i}" for i in (1, 2)), *(f"Q{i}" for i in range(1, 5)), *(f"M{i}" for i in range(1, 13))]


def _periods(spark, sf_dir):
    codes = F.array(*(F.lit(c) for c in _CODES))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), F.year("o_orderdate").alias("y"), F.element_at(codes, (F.col("o_orderkey") % 19 + 1).cast("int")).alias("code"))


@query(
    f"""WITH p AS (SELECT *, make_date(y, ({_N}-1)*{_W}+1, 1) AS a, {_W} AS w, {_N} AS n FROM {_P})
SELECT rec_id, code, CAST(a AS VARCHAR) AS first_day, CAST(last_day(a + to_months(w-1)) AS VARCHAR) AS last_day,
 CASE WHEN code='Y' THEN 'Y' WHEN n=1 THEN code[1]||CASE code[1] WHEN 'H' THEN '2' WHEN 'Q' THEN '4' ELSE '12' END ELSE code[1]||CAST(n-1 AS VARCHAR) END AS before_code, CASE WHEN code='Y' OR n=1 THEN y-1 ELSE y END AS before_year FROM p"""
)
def period_decode(spark, sf_dir):
    first, last = calendars.decode_period(F.col("code"), F.col("y"))
    name, year = calendars.previous_period(F.col("code"), F.col("y"))
    return _periods(spark, sf_dir).select("rec_id", "code", first.cast("string").alias("first_day"), last.cast("string").alias("last_day"), name.alias("before_code"), year.cast("long").alias("before_year"))


@query(
    """WITH d AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE)+CAST(o_custkey%60 AS INTEGER) AS b FROM orders),
 r AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR a>before+1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM r)
SELECT k, CAST(min(a) AS VARCHAR) AS first_day, CAST(max(b) AS VARCHAR) AS last_day, count(*) AS n FROM g GROUP BY k, grp"""
)
def period_merge(spark, sf_dir):
    """Periods that overlap or follow within a day become one."""
    a = F.to_date("o_orderdate")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), a.alias("a"), F.date_add(a, (F.col("o_custkey") % 60).cast("int")).alias("b")).distinct()
    w = Window.partitionBy("k").orderBy("a", "b")
    r = d.withColumn("before", F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = (F.col("before").isNull() | (F.col("a") > F.date_add("before", 1))).cast("int")
    g = r.withColumn("grp", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("k", "grp").agg(F.min("a").cast("string").alias("first_day"), F.max("b").cast("string").alias("last_day"), F.count(F.lit(1)).alias("n")).drop("grp")


@query(
    """WITH p AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE)+CAST(o_custkey%90 AS INTEGER) AS b FROM orders)
SELECT k, CAST(m AS VARCHAR) AS first_day, CAST(last_day(m) AS VARCHAR) AS last_day FROM (SELECT k, CAST(unnest(generate_series(date_trunc('month',a), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m FROM p)"""
)
def period_split(spark, sf_dir):
    """Whole months that a period touches."""
    a = F.to_date("o_orderdate")
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), a.alias("a"), F.date_add(a, (F.col("o_custkey") % 90).cast("int")).alias("b"))
    m = p.select("k", F.explode(F.sequence(F.trunc("a", "month"), F.col("b"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    return m.select("k", F.col("m").cast("string").alias("first_day"), F.last_day("m").cast("string").alias("last_day"))


@query("SELECT o_orderkey AS rec_id, CASE WHEN month(o_orderdate) IN (12,1,2) THEN 'winter' WHEN month(o_orderdate)<=5 THEN 'spring' WHEN month(o_orderdate)<=8 THEN 'summer' ELSE 'autumn' END AS season FROM orders")
def season_class(spark, sf_dir):
    m = F.month("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rec_id"), F.when(m.isin(12, 1, 2), "winter").when(m <= 5, "spring").when(m <= 8, "summer").otherwise("autumn").alias("season"))


@query(
    ctes(FIX)
    + """SELECT rec_id, CASE WHEN hour(ts)=0 AND minute(ts)=0 AND second(ts)=0 THEN strftime(ts,'%Y%m%d')||'12' WHEN hour(ts)=12 AND minute(ts)=0 THEN strftime(ts,'%Y%m%d%H') ELSE strftime(ts,'%Y%m%d%H%M%S') END AS stamp,
 CAST(date_diff('second', TIMESTAMP '1978-01-01', date_trunc('second', ts)) AS BIGINT) AS since_1978 FROM fix"""
)
def date_format(spark, sf_dir):
    h, m, s = F.hour("ts"), F.minute("ts"), F.second("ts")
    stamp = F.when((h == 0) & (m == 0) & (s == 0), F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("12"))).when((h == 12) & (m == 0), F.date_format("ts", "yyyyMMddHH")).otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    since = F.timestamp_diff("SECOND", F.lit("1978-01-01").cast("timestamp_ntz"), F.date_trunc("second", F.col("ts")).cast("timestamp_ntz"))
    return fix(spark, sf_dir).select("rec_id", stamp.alias("stamp"), since.alias("since_1978"))


@query(
    """WITH u AS (SELECT event_id, 'seconds since '||strftime(ts,'%Y-%m-%d')||' 00:00:00' AS unit, CAST(round(value*10) AS BIGINT) AS n FROM events)
SELECT event_id, unit, CAST(epoch(CAST(regexp_extract(unit,'since (.*)$',1) AS TIMESTAMP)) AS BIGINT)+n AS epoch_s FROM u"""
)
def time_units(spark, sf_dir):
    """Seconds since a unit's date, as seconds since 1970."""
    u = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("seconds since "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" 00:00:00")).alias("unit"), F.round(F.col("value") * 10).cast("long").alias("n"))
    start = F.to_timestamp_ntz(F.regexp_extract("unit", "since (.*)$", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    return u.select("event_id", "unit", (F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), start) + F.col("n")).alias("epoch_s"))




@query(
    """WITH w AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), f AS (SELECT DISTINCT CAST(ts AS DATE) AS fd FROM events WHERE user_id%5=0 AND day(ts)%3<>0)
SELECT CAST(d AS VARCHAR) AS d, CASE WHEN d>=DATE '2024-01-14' THEN 'dm1' WHEN d>=DATE '2023-01-01' THEN 'icdr' ELSE 'cdr' END AS generation,
 (SELECT CAST(fd AS VARCHAR) FROM f WHERE abs(date_diff('day',d,fd))<=2 ORDER BY abs(date_diff('day',d,fd)), date_diff('day',d,fd) DESC LIMIT 1) AS used FROM w"""
)
def product_generation_switch(spark, sf_dir):
    """A date's file, or that of the nearest date within two days, the later one first."""
    e = table(spark, sf_dir, "events")
    w = e.select(F.to_date("ts").alias("d")).distinct()
    f = e.where((F.col("user_id") % 5 == 0) & (F.dayofmonth("ts") % 3 != 0)).select(F.to_date("ts").alias("fd")).distinct()
    tries = w.select("d", F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.lit(k).alias("r")) for r, k in enumerate((0, 1, -1, 2, -2)) for i in (r,)))).alias("t"))
    tries = tries.select("d", F.col("t.o").alias("o"), F.date_add("d", F.col("t.r")).alias("fd"))
    used = tries.join(f, "fd").groupBy("d").agg(F.min_by("fd", "o").alias("used"))
    gen = F.when(F.col("d") >= F.lit("2024-01-14").cast("date"), "dm1").when(F.col("d") >= F.lit("2023-01-01").cast("date"), "icdr").otherwise("cdr")
    return w.join(used, "d", "left").select(F.col("d").cast("string").alias("d"), gen.alias("generation"), F.col("used").cast("string").alias("used"))


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS valid, max(o_orderkey) AS run, arg_max(o_orderpriority, o_orderkey) AS member FROM orders GROUP BY 1")
def freshest_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").cast("string").alias("valid")).agg(F.max("o_orderkey").alias("run"), F.max_by("o_orderpriority", "o_orderkey").alias("member"))


@query(
    """WITH f AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate) AS y FROM orders), w AS (SELECT DISTINCT o_custkey AS k, year(o_orderdate)+CAST(o_custkey%3 AS INTEGER)-1 AS y FROM orders)
SELECT w.k, w.y, coalesce(a.y, b.y, c.y) AS used FROM w LEFT JOIN f a ON a.k=w.k AND a.y=w.y LEFT JOIN f b ON b.k=w.k AND b.y=w.y+1 LEFT JOIN f c ON c.k=w.k AND c.y=w.y-1"""
)
def file_year_shift(spark, sf_dir):
    """Parameters of a year, else of the next, else of the one before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    w = o.select("k", (F.col("y") + (F.col("k") % 3).cast("int") - 1).alias("y")).distinct()
    tries = w.select("k", "y", F.posexplode(F.array(F.col("y"), F.col("y") + 1, F.col("y") - 1)).alias("o", "fy"))
    hit = tries.join(o.distinct().withColumnRenamed("y", "fy"), ["k", "fy"]).groupBy("k", "y").agg(F.min_by("fy", "o").alias("used"))
    return w.join(hit, ["k", "y"], "left").select("k", F.col("y").cast("long").alias("y"), F.col("used").cast("long").alias("used"))


@query(
    """SELECT CAST(coalesce(a.d,b.d) AS VARCHAR) AS d, coalesce(a.n,0) AS n_wind, coalesce(b.n,0) AS n_ice, CASE WHEN a.d IS NULL THEN 'ice only' WHEN b.d IS NULL THEN 'wind only' ELSE 'both' END AS side
FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE o_custkey%2=0 GROUP BY 1) a FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem WHERE l_linenumber=1 GROUP BY 1) b ON a.d=b.d"""
)
def date_pairing(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n_wind"), F.first(F.lit(1)).alias("a"))
    b = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count(F.lit(1)).alias("n_ice"), F.first(F.lit(1)).alias("b"))
    side = F.when(F.col("a").isNull(), "ice only").when(F.col("b").isNull(), "wind only").otherwise("both")
    return a.join(b, "d", "full").select(F.col("d").cast("string").alias("d"), F.coalesce("n_wind", F.lit(0)).alias("n_wind"), F.coalesce("n_ice", F.lit(0)).alias("n_ice"), side.alias("side"))


@query(
    ctes(VEC)
    + """, f AS (SELECT sensor, CAST(t0 AS DATE) AS d, min(flag) AS lo, max(flag) AS hi FROM vec GROUP BY ALL HAVING max(flag)>=4 AND min(flag)<=0), w AS (SELECT DISTINCT CAST(t0 AS DATE) AS d FROM vec),
 t AS (SELECT w.d, f.d AS fd, f.sensor, row_number() OVER (PARTITION BY w.d ORDER BY abs(date_diff('day',w.d,f.d)), date_diff('day',w.d,f.d), f.sensor) AS r FROM w JOIN f ON f.d BETWEEN w.d-5 AND w.d+5)
SELECT CAST(w.d AS VARCHAR) AS d, CAST(t.fd AS VARCHAR) AS used, coalesce(t.sensor,0) AS sensor FROM w LEFT JOIN t ON t.d=w.d AND t.r=1"""
)
def mask_reference(spark, sf_dir):
    """The nearest day within five with a usable file, earlier days first; none gives null and sensor 0."""
    v = vec(spark, sf_dir).withColumn("d", F.to_date("t0"))
    f = v.groupBy("sensor", "d").agg(F.min("flag").alias("lo"), F.max("flag").alias("hi")).where("hi >= 4 and lo <= 0")
    best = f.groupBy("d").agg(F.min("sensor").alias("sensor")).withColumnRenamed("d", "fd")
    w = v.select("d").distinct()
    tries = w.select("d", F.posexplode(F.array(*(F.lit(k) for k in (0, -1, 1, -2, 2, -3, 3, -4, 4, -5, 5)))).alias("o", "k")).withColumn("fd", F.date_add("d", F.col("k")))
    used = tries.join(best, "fd").groupBy("d").agg(F.min_by(F.struct("fd", "sensor"), "o").alias("u"))
    return w.join(used, "d", "left").select(F.col("d").cast("string").alias("d"), F.col("u.fd").cast("string").alias("used"), F.coalesce("u.sensor", F.lit(0)).alias("sensor"))


@query(
    """SELECT o_custkey AS k, strftime(d,'%Y/%m') AS dir, count(*) AS n FROM (SELECT DISTINCT o_custkey, unnest(generate_series(CAST(o_orderdate AS DATE)::TIMESTAMP, CAST(o_orderdate AS DATE)::TIMESTAMP+INTERVAL 3 DAY, INTERVAL 1 DAY)) AS d FROM orders) GROUP BY ALL"""
)
def period_files(spark, sf_dir):
    """Daily files over the periods of a catalogue, each once."""
    a = F.to_date("o_orderdate")
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.explode(F.sequence(a, F.date_add(a, 3))).alias("d")).distinct()
    return d.groupBy("k", F.date_format("d", "yyyy/MM").alias("dir")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus='F') GROUP BY 1")
def missing_outputs(spark, sf_dir):
    """Inputs for which no output is there yet."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).join(done, "k", "left_anti").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(
    ctes(FIX)
    + """, a AS (SELECT rec_id, ts FROM fix WHERE source='wsm'), b AS (SELECT rec_id, ts FROM fix WHERE source='irid')
SELECT a.rec_id AS start_id, b.rec_id AS stop_id FROM a JOIN b ON b.ts>a.ts AND abs(epoch(b.ts)-epoch(a.ts)-86400)<=3600"""
)
def pair_product(spark, sf_dir):
    """Image pairs a day apart, give or take an hour: an equi-join on hours, then the exact range."""
    f = fix(spark, sf_dir)
    second = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    a = f.where("source = 'wsm'").select(F.col("rec_id").alias("start_id"), second("ts").alias("s"))
    b = f.where("source = 'irid'").select(F.col("rec_id").alias("stop_id"), second("ts").alias("e"))
    hour = 3600 * 10**6
    a = a.withColumn("h", F.explode(F.sequence(F.floor(F.col("s") / hour) + 23, F.floor(F.col("s") / hour) + 25)))
    b = b.withColumn("h", F.floor(F.col("e") / hour))
    return a.join(b, "h").where((F.col("e") > F.col("s")) & (F.abs(F.col("e") - F.col("s") - 24 * hour) <= hour)).select("start_id", "stop_id")


@query(
    ctes(VEC)
    + """SELECT cell, sensor, dir, obs FROM (SELECT cell, sensor, CAST(l AS INTEGER) AS dir, obs, row_number() OVER (PARTITION BY cell, sensor ORDER BY l DESC, obs DESC) AS r FROM (SELECT cell, sensor, obs, obs%4 AS l FROM vec WHERE flag<>5)) WHERE r=1"""
)
def sensor_resolution(spark, sf_dir):
    """Of ordered folders the last that holds a sensor's file wins."""
    v = vec(spark, sf_dir).where("flag != 5").withColumn("dir", (F.col("obs") % 4).cast("int"))
    best = v.groupBy("cell", "sensor").agg(F.max(F.struct("dir", "obs")).alias("b"))
    return best.select("cell", "sensor", "b.dir", "b.obs")
