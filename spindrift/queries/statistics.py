"""Matchup statistics, wind regression, selectors and small windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from spindrift.functions.selectors import box, equals, fold, label, period
from spindrift.operators import matchups, merge, ranks, spatial
from spindrift.queries.adapters import VEC, WIND, ctes, vec, wind
from spindrift.queries.registry import query
from spindrift.runtime import table

_R = lambda c, n, d=6: (F.round(c, d) + 0.0).alias(n)


@query(
    ctes(VEC)
    + """, s AS (SELECT sensor, count(*) AS n, avg(dx-sigma) AS bx, avg(dy-sigma) AS by_, var_samp(dx-sigma) AS vx, var_samp(dy-sigma) AS vy, covar_samp(dx-sigma,dy-sigma) AS c, regr_slope(dy,dx) AS slope, regr_intercept(dy,dx) AS icpt, corr(dx,dy) AS r FROM vec GROUP BY sensor)
SELECT sensor, n, round(bx,6)+0.0 AS bias_x, round(by_,6)+0.0 AS bias_y, round(sqrt(vx),6) AS sdev_x, round(sqrt(vy),6) AS sdev_y, round(c/sqrt(vx*vy),6)+0.0 AS corr_xy,
 round((vx+vy)/2+sqrt(pow((vx-vy)/2,2)+c*c),5) AS axis_1, round((vx+vy)/2-sqrt(pow((vx-vy)/2,2)+c*c),5) AS axis_2, round(slope,6)+0.0 AS slope, round(icpt,6)+0.0 AS intercept, round(r,6)+0.0 AS r FROM s"""
)
def matchup_stats(spark, sf_dir):
    """Bias, spread, error ellipse and regression of matchups."""
    ex, ey = F.col("dx") - F.col("sigma"), F.col("dy") - F.col("sigma")
    s = vec(spark, sf_dir).groupBy("sensor").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ex).alias("bx"), F.avg(ey).alias("by"), F.var_samp(ex).alias("vx"), F.var_samp(ey).alias("vy"), F.covar_samp(ex, ey).alias("c"),
        F.regr_slope("dy", "dx").alias("slope"), F.regr_intercept("dy", "dx").alias("icpt"), F.corr("dx", "dy").alias("r"),
    )
    vx, vy, c = F.col("vx"), F.col("vy"), F.col("c")
    root = F.sqrt(F.pow((vx - vy) / 2, F.lit(2)) + c * c)
    return s.select("sensor", "n", _R(F.col("bx"), "bias_x"), _R(F.col("by"), "bias_y"), _R(F.sqrt(vx), "sdev_x"), _R(F.sqrt(vy), "sdev_y"), _R(c / F.sqrt(vx * vy), "corr_xy"), _R((vx + vy) / 2 + root, "axis_1", 5), _R((vx + vy) / 2 - root, "axis_2", 5), _R(F.col("slope"), "slope"), _R(F.col("icpt"), "intercept"), _R(F.col("r"), "r"))


@query(
    ctes(VEC)
    + """SELECT strftime(t0,'%Y-%m') AS month, count(*) AS n, CASE WHEN count(*)>=25 THEN round(avg(dx-dy),6)+0.0 END AS bias, CASE WHEN count(*)>=25 THEN round(stddev_samp(dx-dy),6) END AS sdev,
 """
    + ", ".join(f"count(*) FILTER (WHERE sensor={k}) AS s{k}" for k in range(1, 8))
    + " FROM vec GROUP BY 1"
)
def monthly_stats(spark, sf_dir):
    e, n = F.col("dx") - F.col("dy"), F.count(F.lit(1))
    return vec(spark, sf_dir).groupBy(F.date_format("t0", "yyyy-MM").alias("month")).agg(
        n.alias("n"), F.when(n >= 25, F.round(F.avg(e), 6) + 0.0).alias("bias"), F.when(n >= 25, F.round(F.stddev_samp(e), 6)).alias("sdev"), *(F.count_if(F.col("sensor") == k).alias(f"s{k}") for k in range(1, 8))
    )


@query(ctes(VEC) + "SELECT strftime(t0,'%Y') AS year, " + ", ".join(f"count(*) FILTER (WHERE sensor={k}) AS n{k}" for k in range(1, 8)) + " FROM vec GROUP BY 1")
def network_pivot(spark, sf_dir):
    names = F.concat(F.lit("n"), F.col("sensor").cast("string"))
    rows = vec(spark, sf_dir).select(F.date_format("t0", "yyyy").alias("year"), names.alias("net"))
    return rows.groupBy("year").pivot("net", [f"n{k}" for k in range(1, 8)]).count().na.fill(0)


@query(
    ctes(VEC)
    + """, a AS (SELECT obs, dx-dy AS e FROM vec WHERE sensor=1), b AS (SELECT obs, dx-dy AS e FROM vec WHERE sensor=2)
SELECT count(*) AS n, round(corr(a.e,b.e),6)+0.0 AS r FROM a JOIN b USING (obs)"""
)
def cross_error_corr(spark, sf_dir):
    """Correlation of two sensors' errors over their common matchups: those of one observation."""
    v = vec(spark, sf_dir).select("obs", "sensor", (F.col("dx") - F.col("dy")).alias("e"))
    one, two = (v.where(F.col("sensor") == k).select("obs", F.col("e").alias(f"e{k}")) for k in (1, 2))
    return one.join(two, "obs").agg(F.count(F.lit(1)).alias("n"), _R(F.corr("e1", "e2"), "r"))


_Z = 1.959963984540054
#: Student's two-sided 95 % quantile is _Z plus these over the powers of the degrees of freedom (within 1e-4 from eight on).
_T95 = [(_Z**3 + _Z) / 4, (5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96, (3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384, (79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160]


@query(
    ctes(VEC)
    + f""", p AS (SELECT sensor, dx AS prd, sigma AS val FROM vec UNION ALL SELECT sensor, dy, sigma FROM vec),
 s AS (SELECT sensor, count(*) AS n, regr_slope(val,prd) AS slope, regr_intercept(val,prd) AS icpt, corr(prd,val) AS r, var_pop(prd) AS vx, var_pop(val) AS vy, avg(prd) AS mx FROM p GROUP BY sensor),
 t AS (SELECT *, sqrt((1-r*r)*vy/vx/(n-2)) AS se, {_Z!r}::DOUBLE{"".join(f"+{t!r}::DOUBLE/pow(n-2,{k + 1})" for k, t in enumerate(_T95))} AS t FROM s WHERE n>2)
SELECT sensor, n, round(slope,6)+0.0 AS slope, round(icpt,6)+0.0 AS intercept, round(r,6)+0.0 AS r, round(t*se,6) AS slope_95, round(t*se*sqrt(vx+mx*mx),6) AS intercept_95 FROM t"""
)
def matchup_regression(spark, sf_dir):
    """Regression over both components stacked, with the 95 % intervals of slope and intercept by Student's t."""
    both = F.explode(F.array("dx", "dy"))
    p = vec(spark, sf_dir).select("sensor", both.alias("prd"), F.col("sigma").alias("val"))
    s = p.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("val", "prd").alias("slope"), F.regr_intercept("val", "prd").alias("icpt"), F.corr("prd", "val").alias("r"), F.var_pop("prd").alias("vx"), F.var_pop("val").alias("vy"), F.avg("prd").alias("mx")
    ).where("n > 2")
    v, r = F.col("n") - 2, F.col("r")
    t = F.lit(_Z)
    for k, x in enumerate(_T95):
        t = t + x / F.pow(v, F.lit(k + 1))
    width = t * F.sqrt((1 - r * r) * F.col("vy") / F.col("vx") / v)
    return s.select("sensor", "n", _R(F.col("slope"), "slope"), _R(F.col("icpt"), "intercept"), _R(r, "r"), F.round(width, 6).alias("slope_95"), F.round(width * F.sqrt(F.col("vx") + F.col("mx") * F.col("mx")), 6).alias("intercept_95"))


_PAIRS = ", p AS (SELECT cell, sensor, dx AS prd_x, dy AS prd_y, sigma*3+obs%11 AS val_x, obs%13-sigma*2 AS val_y FROM vec)"
def _quantile(v: str) -> str:
    """The t of which the two-sided probability is 0.95, by halving an interval, from the finite sums for whole degrees of freedom."""
    angle = f"atan((s.a+s.b)/2/sqrt({v}))"
    odd = f"2/pi()*(o+sin(o)*cos(o)*list_reduce(list_concat([{{'t': 1.0::DOUBLE, 'n': CASE WHEN {v}>1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END}}], list_transform(range(1, ({v}-1)//2), lambda k: {{'t': 2.0*k/(2*k+1), 'n': 0.0::DOUBLE}})), lambda x, y: {{'t': x.t*y.t*cos(o)*cos(o), 'n': x.n+x.t*y.t*cos(o)*cos(o)}}).n)"
    even = f"sin(o)*list_reduce(list_concat([{{'t': 1.0::DOUBLE, 'n': 1.0::DOUBLE}}], list_transform(range(1, ({v}-2)//2+1), lambda k: {{'t': (2*k-1)/(2.0*k), 'n': 0.0::DOUBLE}})), lambda x, y: {{'t': x.t*y.t*cos(o)*cos(o), 'n': x.n+x.t*y.t*cos(o)*cos(o)}}).n"
    p = f"(CASE WHEN {v}%2=1 THEN {odd} ELSE {even} END)".replace("(o)", f"({angle})").replace("(o+", f"({angle}+")
    return f"list_reduce(list_concat([{{'a': 1.9::DOUBLE, 'b': 13.0::DOUBLE}}], list_transform(range(50), lambda z: {{'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE}})), lambda s, z: CASE WHEN {p}<0.95 THEN {{'a': (s.a+s.b)/2, 'b': s.b}} ELSE {{'a': s.a, 'b': (s.a+s.b)/2}} END).a"


def _component(k: str) -> str:
    x, y = f"val_{k}", f"prd_{k}"
    width = f"t*sqrt(greatest(1-pow(corr({x},{y}),2),0.0)*var_pop({y})/var_pop({x})/(max(n)-2))"
    return f"round(regr_slope({y},{x}),6)+0.0 AS {k}_a, round(regr_intercept({y},{x}),6)+0.0 AS {k}_b, round(corr({x},{y}),6)+0.0 AS {k}_r, round({width},3)+0.0 AS {k}_a95, round({width}*sqrt(var_pop({x})+pow(avg({x}),2)),2)+0.0 AS {k}_b95"


@query(
    ctes(VEC)
    + _PAIRS
    + f""", c AS (SELECT cell, sensor, count(*) AS n FROM p GROUP BY ALL HAVING count(*)>=3 AND count(*)<=30 AND var_pop(val_x)>0 AND var_pop(val_y)>0 AND var_pop(prd_x)>0 AND var_pop(prd_y)>0),
 v AS (SELECT n, {_quantile("w")} AS t FROM (SELECT DISTINCT n, n-2 AS w FROM c))
SELECT cell, sensor, n, {_component("x")}, {_component("y")} FROM p JOIN c USING (cell, sensor) JOIN v USING (n) GROUP BY cell, sensor, n, t"""
)
def matchup_components(spark, sf_dir):
    """Regressions of both components of the product on the validation's, each with its 95 % half-widths, for groups of few matchups."""
    p = vec(spark, sf_dir).select("cell", "sensor", F.col("dx").alias("prd_x"), F.col("dy").alias("prd_y"), (F.col("sigma") * 3 + F.col("obs") % 11).alias("val_x"), (F.col("obs") % 13 - F.col("sigma") * 2).alias("val_y"))
    moving = p.groupBy("cell", "sensor").agg(F.count(F.lit(1)).alias("n"), *(F.var_pop(c).alias(c) for c in ("prd_x", "prd_y", "val_x", "val_y"))).where("n between 3 and 30 and prd_x > 0 and prd_y > 0 and val_x > 0 and val_y > 0")
    got = matchups.regression(p.join(moving.select("cell", "sensor"), ["cell", "sensor"]), ["cell", "sensor"], {"x": ("val_x", "prd_x"), "y": ("val_y", "prd_y")})
    places = {"a": 6, "b": 6, "r": 6, "a95": 3, "b95": 2}
    return got.select("cell", "sensor", F.col("x_n").alias("n"), *(_R(F.col(f"{k}_{n}"), f"{k}_{n}", d) for k in "xy" for n, d in places.items()))


@query(
    "SELECT event_id, round((epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-05'))/(11*86.4e9),8)+0.0 AS elapsed, round(sqrt(pow(value/10,2)+pow(event_id%7,2))-(event_id%19),6)+0.0 AS mismatch_len, round((event_id%97)/24.0::DOUBLE-(event_id%89)/24.0::DOUBLE,6)+0.0 AS mismatch_dt, round((1+event_id%5+event_id%3)/2.0::DOUBLE,6) AS uncert, CASE upper(event_type) WHEN 'CLICK' THEN 'red' WHEN 'VIEW' THEN 'blue' WHEN 'ERROR' THEN 'green' ELSE 'black' END AS colour FROM events"
)
def colour_metrics(spark, sf_dir):
    """What matchups are coloured by: part of the period, mismatch of length and duration, mean uncertainty, label."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    length = F.sqrt(F.pow(F.col("value") / 10, F.lit(2)) + F.pow(k % 7, F.lit(2)))
    label = F.when(k % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return e.select(
        "event_id", _R(matchups.elapsed(F.col("ts").cast("timestamp_ntz"), F.lit("2024-01-05"), F.lit("2024-01-15")), "elapsed", 8), _R(length - k % 19, "mismatch_len"), _R(k % 97 / F.lit(24.0) - k % 89 / F.lit(24.0), "mismatch_dt"),
        F.round((1 + k % 5 + k % 3) / F.lit(2.0), 6).alias("uncert"), matchups.colours(label, {"click": "red", "View": "blue", "error": "green"}).alias("colour"),
    )


@query(
    ctes(WIND)
    + """, m AS (SELECT cell, month(t0)::INTEGER AS mon, u, v, iu, iv FROM wind),
 s AS (SELECT cell, mon, CAST(count(*) AS DOUBLE) AS n, sum(u) AS su, sum(v) AS sv, sum(iu) AS si, sum(iv) AS sj, sum(u*u+v*v) AS ww, sum(u*iu+v*iv) AS re, sum(u*iv-v*iu) AS im FROM m GROUP BY ALL
  HAVING count(*) > CASE WHEN (cell%2=0 AND mon IN (6,7,8,9)) OR (cell%2=1 AND mon IN (11,12,1,2)) THEN 5 ELSE 10 END)
SELECT cell, mon, CAST(n AS BIGINT) AS n, round((n*re-(su*si+sv*sj))/(n*ww-(su*su+sv*sv)),6)+0.0 AS a_real, round((n*im-(su*sj-sv*si))/(n*ww-(su*su+sv*sv)),6)+0.0 AS a_imag FROM s"""
)
def complex_lsq_monthly(spark, sf_dir):
    """The fit by cell and month of the year; a summer month of the cell's hemisphere needs more than 5 pairs, another more than 10."""
    from spindrift.operators.winds import fit

    w = wind(spark, sf_dir).withColumn("mon", F.month("t0"))
    north = F.col("cell") % 2 == 0
    summer = (north & F.col("mon").isin(6, 7, 8, 9)) | (~north & F.col("mon").isin(11, 12, 1, 2))
    return fit(w, "cell", F.when(summer, 5).otherwise(10), "mon").select("cell", "mon", "n", _R(F.col("ar"), "a_real"), _R(F.col("ai"), "a_imag"))


@query(
    ctes(VEC)
    + """, c AS (SELECT CAST(floor(sigma*2) AS BIGINT) AS b1, CAST(floor(abs(dy)) AS BIGINT) AS b2, dx, CAST(obs AS DOUBLE) AS o FROM vec) SELECT b1, b2, count(*) AS n, round(corr(dx,o),6)+0.0 AS r FROM c GROUP BY ALL HAVING count(*)>100"""
)
def timecoll_correlation(spark, sf_dir):
    c = vec(spark, sf_dir).select(F.floor(F.col("sigma") * 2).alias("b1"), F.floor(F.abs("dy")).alias("b2"), "dx", F.col("obs").cast("double").alias("o"))
    return c.groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("n"), _R(F.corr("dx", "o"), "r")).where("n > 100")


@query(
    """WITH h AS (SELECT CAST(floor(hour(ts)+minute(ts)/60.0::DOUBLE-12) AS BIGINT) AS bin, value-100 AS e FROM events), b AS (SELECT bin, count(*) AS n, avg(e) AS mean, stddev_pop(e) AS sd FROM h WHERE bin>=-9 AND bin<9 GROUP BY 1)
SELECT bin, n, round(mean,6)+0.0 AS mean, round(sd,6) AS sd FROM b"""
)
def miscolloc_bins(spark, sf_dir):
    bin_ = F.floor(F.hour("ts") + F.minute("ts") / 60.0 - 12)
    rows = table(spark, sf_dir, "events").select(bin_.alias("bin"), (F.col("value") - 100).alias("e")).where("bin >= -9 and bin < 9")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), _R(F.avg("e"), "mean"), _R(F.stddev_pop("e"), "sd"))


@query(
    """WITH h AS (SELECT floor(hour(ts)+minute(ts)/60.0::DOUBLE-12) AS x, value-100 AS e FROM events), b AS (SELECT x+0.5 AS x, stddev_pop(e) AS y FROM h WHERE x>=-9 AND x<9 GROUP BY 1),
 s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS x1, sum(x*x) AS x2, sum(x*x*x) AS x3, sum(x*x*x*x) AS x4, sum(y) AS y0, sum(x*y) AS y1, sum(x*x*y) AS y2 FROM b),
 d AS (SELECT *, n*(x2*x4-x3*x3)-x1*(x1*x4-x2*x3)+x2*(x1*x3-x2*x2) AS det FROM s)
SELECT round((y0*(x2*x4-x3*x3)-x1*(y1*x4-y2*x3)+x2*(y1*x3-y2*x2))/det,4) AS c0, round((n*(y1*x4-y2*x3)-y0*(x1*x4-x2*x3)+x2*(x1*y2-x2*y1))/det,4)+0.0 AS c1, round((n*(x2*y2-x3*y1)-x1*(x1*y2-x2*y1)+y0*(x1*x3-x2*x2))/det,4)+0.0 AS c2 FROM d"""
)
def miscolloc_parabola(spark, sf_dir):
    """Parabola through the spread by hour: normal equations by Cramer's rule."""
    x = F.floor(F.hour("ts") + F.minute("ts") / 60.0 - 12)
    b = table(spark, sf_dir, "events").select((x + 0.5).alias("x"), (F.col("value") - 100).alias("e")).where("x >= -8.5 and x < 9").groupBy("x").agg(F.stddev_pop("e").alias("y"))
    p = lambda k: F.sum(F.pow("x", F.lit(k)))
    s = b.agg(F.count(F.lit(1)).cast("double").alias("n"), *(p(k).alias(f"x{k}") for k in range(1, 5)), *(F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"y{k}") for k in range(3)))
    n, x1, x2, x3, x4, y0, y1, y2 = (F.col(c) for c in ("n", "x1", "x2", "x3", "x4", "y0", "y1", "y2"))
    det = n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x2 * x3) + x2 * (x1 * x3 - x2 * x2)
    return s.select(
        F.round((y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - y2 * x3) + x2 * (y1 * x3 - y2 * x2)) / det, 4).alias("c0"),
        _R((n * (y1 * x4 - y2 * x3) - y0 * (x1 * x4 - x2 * x3) + x2 * (x1 * y2 - x2 * y1)) / det, "c1", 4),
        _R((n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - x2 * y1) + y0 * (x1 * x3 - x2 * x2)) / det, "c2", 4),
    )


@query(
    ctes(VEC)
    + """, b AS (SELECT CAST(floor(sigma/0.5) AS BIGINT) AS bin, dx, dy, sigma FROM vec WHERE sigma<6) SELECT bin, count(*) AS n, round(avg(dx-dy),6)+0.0 AS mean, round(stddev_pop(dx-dy),6) AS sd, round(avg(sigma),6) AS sigma,
 round(avg(CASE WHEN abs((dx-dy)/sigma)<=12 THEN pow((dx-dy)/sigma,2) END),6) AS chi2 FROM b GROUP BY bin HAVING count(*)>50"""
)
def uncertainty_bins(spark, sf_dir):
    e, s = F.col("dx") - F.col("dy"), F.col("sigma")
    b = vec(spark, sf_dir).where(s < 6).groupBy(F.floor(s / 0.5).alias("bin"))
    return b.agg(F.count(F.lit(1)).alias("n"), _R(F.avg(e), "mean"), _R(F.stddev_pop(e), "sd"), _R(F.avg(s), "sigma"), _R(F.avg(F.when(F.abs(e / s) <= 12, F.pow(e / s, F.lit(2)))), "chi2")).where("n > 50")


@query(
    ctes(VEC)
    + """, v AS (SELECT sensor, dx, dy FROM vec WHERE flag=0), a AS (SELECT sensor, dx, row_number() OVER (PARTITION BY sensor ORDER BY dx) AS r FROM v), b AS (SELECT sensor, dy, row_number() OVER (PARTITION BY sensor ORDER BY dy) AS r FROM v) SELECT sensor, r, dx, dy FROM a JOIN b USING (sensor, r)"""
)
def qq_pairs(spark, sf_dir):
    """Both sides sorted by themselves and paired by rank."""
    return ranks.paired(vec(spark, sf_dir).where("flag = 0"), "sensor", "dx", "dy")


@query(
    ctes(VEC)
    + """, t AS (SELECT count(*) AS all_n FROM vec) SELECT CAST(floor(dx/2) AS BIGINT) AS bx, CAST(floor(dy/2) AS BIGINT) AS by_, count(*) AS n FROM vec, t GROUP BY bx, by_, all_n HAVING count(*)>0.0001*all_n"""
)
def hex_density(spark, sf_dir):
    b = vec(spark, sf_dir).groupBy(F.floor(F.col("dx") / 2).alias("bx"), F.floor(F.col("dy") / 2).alias("by_")).agg(F.count(F.lit(1)).alias("n"))
    total = b.agg(F.sum("n").alias("all_n"))  # one row
    return b.join(F.broadcast(total)).where("n > 0.0001 * all_n").select("bx", "by_", "n")


@query(
    ctes(VEC)
    + """, m AS (SELECT sqrt(dx*dx+dy*dy) AS len, sensor FROM vec), t AS (SELECT max(len) AS hi FROM m) SELECT sensor, CAST(least(floor(len/hi*30)+1,30) AS BIGINT) AS bin, count(*) AS n FROM m, t GROUP BY ALL"""
)
def magnitude_histogram(spark, sf_dir):
    m = vec(spark, sf_dir).select(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("len"), "sensor")
    top = m.agg(F.max("len").alias("hi"))  # one row
    return m.join(F.broadcast(top)).groupBy("sensor", F.least(F.floor(F.col("len") / F.col("hi") * 30) + 1, F.lit(30)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(ctes(VEC) + "SELECT month(t0)::BIGINT AS month, round(avg(sqrt(dx*dx+dy*dy))*100,5) AS abs_a, round(avg(degrees(atan2(dy,dx))),5)+0.0 AS theta, round(avg(sigma),6) AS abs_c, count(*) AS n FROM vec WHERE flag=0 GROUP BY 1")
def parameter_climatology(spark, sf_dir):
    x, y = F.col("dx"), F.col("dy")
    rows = vec(spark, sf_dir).where("flag = 0").groupBy(F.month("t0").cast("long").alias("month"))
    return rows.agg(_R(F.avg(F.sqrt(x * x + y * y)) * 100, "abs_a", 5), _R(F.avg(F.degrees(F.atan2(y, x))), "theta", 5), _R(F.avg("sigma"), "abs_c"), F.count(F.lit(1)).alias("n"))


@query(
    ctes(VEC)
    + "SELECT obs, sensor, t0, round(dx-sigma,6)+0.0 AS ex, round(dy-sigma,6)+0.0 AS ey, round((sigma+sigma*2)/2,6) AS mean_sigma, CASE sensor WHEN 1 THEN 'red' WHEN 2 THEN 'green' WHEN 3 THEN 'blue' ELSE 'grey' END AS colour FROM vec WHERE abs(dx-sigma)>=15 OR abs(dy-sigma)>=15"
)
def error_pairs(spark, sf_dir):
    """Errors on both axes of outliers, with the colour of their network."""
    s = F.col("sigma")
    ex, ey, k = F.col("dx") - s, F.col("dy") - s, F.col("sensor")
    rows = vec(spark, sf_dir).where((F.abs(ex) >= 15) | (F.abs(ey) >= 15))
    return rows.select("obs", "sensor", "t0", _R(ex, "ex"), _R(ey, "ey"), _R((s + s * 2) / 2, "mean_sigma"), F.when(k == 1, "red").when(k == 2, "green").when(k == 3, "blue").otherwise("grey").alias("colour"))


@query(ctes(VEC) + "SELECT printf('%06d %02d %s %8.3f', obs, sensor, strftime(t0,'%Y%m%d'), dx) AS line FROM vec WHERE abs(dx)>=15")
def outlier_dump(spark, sf_dir):
    return vec(spark, sf_dir).where(F.abs("dx") >= 15).select(F.format_string("%06d %02d %s %8.3f", "obs", "sensor", F.date_format("t0", "yyyyMMdd"), "dx").alias("line"))


@query(ctes(VEC) + "SELECT printf('%d & %d & %.2f', sensor, count(*), round(avg(dx),2)+0.0) AS line FROM vec GROUP BY sensor")
def stats_rows(spark, sf_dir):
    return vec(spark, sf_dir).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("dx"), 2) + 0.0).alias("m")).select(F.format_string("%d & %d & %.2f", "sensor", "n", "m").alias("line"))


@query(
    ctes(VEC)
    + """SELECT sensor, count(*) FILTER (WHERE flag=17) AS eq, count(*) FILTER (WHERE NOT (60+y%30 BETWEEN 70 AND 85)) AS outside, count(*) FILTER (WHERE t0 BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31' AND sigma>1.5) AS both_,
 count(*) FILTER (WHERE flag=0 OR flag=13 OR sensor=2) AS any_, count(*) FILTER (WHERE (flag=0 AND sigma<1.5) OR dx>20) AS folded, count(*) FILTER (WHERE abs(coalesce(dx,0))<=10 AND abs(coalesce(dy,0))<=10) AS coarse FROM vec GROUP BY sensor"""
)
def selector_algebra(spark, sf_dir):
    v = vec(spark, sf_dir).withColumns({"lat": 60 + F.col("y") % 30, "name": F.concat(F.lit("S"), F.col("sensor").cast("string"))})
    coarse = (F.abs(F.coalesce("dx", F.lit(0.0))) <= 10) & (F.abs(F.coalesce("dy", F.lit(0.0))) <= 10)
    n = lambda c, name: F.count_if(c).alias(name)
    return v.groupBy("sensor").agg(
        n(equals("flag", 17), "eq"),
        n(~box("lat", 70, 85), "outside"),
        n(period("t0", "1997-01-01", "1998-12-31") & (F.col("sigma") > 1.5), "both_"),
        n(equals("flag", 0) | equals("flag", 13) | label("name", "s2"), "any_"),
        n(fold([("and", equals("flag", 0)), ("and", F.col("sigma") < 1.5), ("or", F.col("dx") > 20)]), "folded"),
        n(coarse, "coarse"),
    )


@query(ctes(VEC) + ", f AS (SELECT DISTINCT sensor, flag FROM vec), x AS (SELECT DISTINCT x FROM vec) SELECT sensor, flag, dense_rank() OVER (PARTITION BY sensor ORDER BY flag)-1 AS code FROM f")
def flag_dense_recode(spark, sf_dir):
    f = vec(spark, sf_dir).select("sensor", "flag").distinct()
    return f.withColumn("code", (F.dense_rank().over(Window.partitionBy("sensor").orderBy("flag")) - 1).cast("long"))


@query(ctes(VEC) + ", d AS (SELECT DISTINCT sensor, dx FROM vec), r AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY dx) AS k FROM d) SELECT sensor, max(dx) FILTER (WHERE k=1) AS first_, max(dx) FILTER (WHERE k=2) AS second_, max(dx) FILTER (WHERE k=2)-max(dx) FILTER (WHERE k=1) AS spacing FROM r GROUP BY sensor")
def smallest_two(spark, sf_dir):
    """Smallest and second smallest coordinate, by distinct values."""
    d = vec(spark, sf_dir).select("sensor", "dx").distinct()
    low = d.groupBy("sensor").agg(F.min("dx").alias("first_"))
    second = d.join(low, "sensor").where("dx > first_").groupBy("sensor", "first_").agg(F.min("dx").alias("second_"))
    return second.select("sensor", "first_", "second_", (F.col("second_") - F.col("first_")).alias("spacing"))


@query(
    ctes(WIND)
    + """, s AS (SELECT cell, CAST(count(*) AS DOUBLE) AS n, sum(u) AS su, sum(v) AS sv, sum(iu) AS si, sum(iv) AS sj, sum(u*u+v*v) AS ww, sum(u*iu+v*iv) AS re, sum(u*iv-v*iu) AS im FROM wind GROUP BY cell HAVING count(*)>10),
 a AS (SELECT *, (n*re-(su*si+sv*sj))/(n*ww-(su*su+sv*sv)) AS ar, (n*im-(su*sj-sv*si))/(n*ww-(su*su+sv*sv)) AS ai FROM s),
 c AS (SELECT *, (si-(ar*su-ai*sv))/n AS cr, (sj-(ar*sv+ai*su))/n AS ci FROM a),
 r AS (SELECT w.cell, avg(pow(iu-(ar*u-ai*v+cr),2)) AS rr, avg(pow(iv-(ar*v+ai*u+ci),2)) AS ri FROM wind w JOIN c USING (cell) GROUP BY w.cell)
SELECT c.cell, CAST(n AS BIGINT) AS n, round(ar,6)+0.0 AS a_real, round(ai,6)+0.0 AS a_imag, round(cr,5)+0.0 AS c_real, round(ci,5)+0.0 AS c_imag, round(sqrt(ar*ar+ai*ai),6) AS abs_a, round(degrees(atan2(ai,ar)),4)+0.0 AS theta, round(sqrt(rr),5) AS rms_real, round(sqrt(ri),5) AS rms_imag FROM c JOIN r USING (cell)"""
)
def complex_lsq(spark, sf_dir):
    """ice = A * wind + C in complex numbers, from sums; then the residuals."""
    from spindrift.operators.winds import fit, residuals

    w = wind(spark, sf_dir)
    c = fit(w, "cell", 10)
    rows = c.join(residuals(w, c, "cell"), "cell")
    ar, ai = F.col("ar"), F.col("ai")
    return rows.select("cell", "n", _R(ar, "a_real"), _R(ai, "a_imag"), _R(F.col("cr"), "c_real", 5), _R(F.col("ci"), "c_imag", 5), _R(F.sqrt(ar * ar + ai * ai), "abs_a"), _R(F.degrees(F.atan2(ai, ar)), "theta", 4), _R(F.col("rms_real"), "rms_real", 5), _R(F.col("rms_imag"), "rms_imag", 5))


@query(
    ctes(WIND)
    + """SELECT cell, count(*) AS n, round(sum(CASE WHEN abs(dx)<=1000 THEN dx END),3)+0.0 AS dx, round(sum(CASE WHEN abs(dy)<=1000 THEN dy END),3)+0.0 AS dy, count(*) FILTER (WHERE abs(dx)>1000) AS n_masked
FROM (SELECT cell, (0.9*u-0.3*v+0.01)*2*86400/1000/10 AS dx, (0.9*v+0.3*u-0.02)*2*86400/1000/10 AS dy FROM wind) GROUP BY cell"""
)
def complex_apply(spark, sf_dir):
    """Velocity from the model, then displacement over two days, masked beyond 1000 km."""
    from spindrift.operators.winds import apply

    iu, iv = apply(F.col("u"), F.col("v"), 0.9, 0.3, 0.01, -0.02)
    rows = wind(spark, sf_dir).select("cell", (iu * 2 * 86400 / 1000 / 10).alias("dx"), (iv * 2 * 86400 / 1000 / 10).alias("dy"))
    inside = lambda c: F.when((F.abs(c) <= 1000) & ~F.isnan(c), F.col(c))
    return rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), _R(F.sum(inside("dx")), "dx", 3), _R(F.sum(inside("dy")), "dy", 3), F.count_if(F.abs("dx") > 1000).alias("n_masked"))


@query(ctes(WIND) + "SELECT cell, strftime(t0,'%Y-%m') AS month, round(avg(u),6) AS u_avg, round(stddev_pop(u),5) AS u_std, round(avg(v),6) AS v_avg, round(stddev_pop(v),5) AS v_std, count(*) AS n FROM wind GROUP BY ALL")
def wind_mean_std(spark, sf_dir):
    return wind(spark, sf_dir).groupBy("cell", F.date_format("t0", "yyyy-MM").alias("month")).agg(_R(F.avg("u"), "u_avg"), _R(F.stddev_pop("u"), "u_std", 5), _R(F.avg("v"), "v_avg"), _R(F.stddev_pop("v"), "v_std", 5), F.count(F.lit(1)).alias("n"))


@query(ctes(WIND) + "SELECT cell, round(avg(u*1000/(2*86400)),8)+0.0 AS u_ms, round(avg(0-v*1000/(2*86400)),8)+0.0 AS v_ms, count(*) AS n FROM wind GROUP BY cell")
def wind_scan_units(spark, sf_dir):
    """km in two days to m/s, with rows that run upwards."""
    return wind(spark, sf_dir).groupBy("cell").agg(_R(F.avg(F.col("u") * 1000 / (2 * 86400)), "u_ms", 8), _R(F.avg(0 - F.col("v") * 1000 / (2 * 86400)), "v_ms", 8), F.count(F.lit(1)).alias("n"))


@query(ctes(WIND) + "SELECT CAST(CAST(t0 AS DATE) AS VARCHAR) AS day, round(avg(u*0.5-3),6)+0.0 AS u10, round(avg(v*0.5-3),6)+0.0 AS v10, count(*) AS n FROM wind WHERE t0>=TIMESTAMP '1996-01-01' AND t0<TIMESTAMP '1998-01-01' GROUP BY 1")
def wind_prep(spark, sf_dir):
    """Two fields only, unpacked with scale and offset, a file a day over a closed range."""
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = wind(spark, sf_dir).where((F.col("t0") >= t("1996-01-01")) & (F.col("t0") < t("1998-01-01")))
    return rows.groupBy(F.to_date("t0").cast("string").alias("day")).agg(_R(F.avg(F.col("u") * 0.5 - 3), "u10"), _R(F.avg(F.col("v") * 0.5 - 3), "v10"), F.count(F.lit(1)).alias("n"))


@query(
    ctes(WIND)
    + "SELECT cell, round(regr_slope(iu,u),6)+0.0 AS slope, round(avg(iu)+regr_slope(iu,u)*(40-avg(u)),5)+0.0 AS at_40, round(stddev_pop(iu),5) AS std, count(*)//3 AS n3, round(arg_min(iu-0.19*(u-40), (abs(u-40), iu, v)),6)+0.0 AS fixed FROM wind GROUP BY cell HAVING count(*)//3>=2"
)
def incidence_ols(spark, sf_dir):
    """Backscatter at 40 degrees by regression, and by a fixed slope from the nearest observation."""
    slope, u, iu = F.regr_slope("iu", "u"), F.col("u"), F.col("iu")
    rows = wind(spark, sf_dir).groupBy("cell").agg(
        _R(slope, "slope"), _R(F.avg("iu") + slope * (40 - F.avg("u")), "at_40", 5), _R(F.stddev_pop("iu"), "std", 5), F.floor(F.count(F.lit(1)) / 3).alias("n3"), _R(F.min_by(iu - 0.19 * (u - 40), F.struct(F.abs(u - 40), iu, "v")), "fixed")
    )
    return rows.where("n3 >= 2")


@query(
    ctes(VEC)
    + "SELECT sensor, bool_and(y>=0) AS all_north, count(*) AS n, count(CASE WHEN flag<>22 THEN dx END) AS n_dx, round(avg(CASE WHEN flag<>22 THEN dx END),6)+0.0 AS mean_dx, round(avg(sigma),6) AS mean_sigma FROM vec GROUP BY sensor"
)
def drift_scan_masked(spark, sf_dir):
    """Columns of a product with its fill value as null."""
    dx = F.when(F.col("flag") != 22, F.col("dx"))
    return vec(spark, sf_dir).groupBy("sensor").agg(F.bool_and(F.col("y") >= 0).alias("all_north"), F.count(F.lit(1)).alias("n"), F.count(dx).alias("n_dx"), _R(F.avg(dx), "mean_dx"), _R(F.avg("sigma"), "mean_sigma"))


@query(ctes(VEC) + "SELECT obs, sensor, t0, dx, dy, CAST(CASE WHEN flag=22 THEN NULL ELSE flag END AS DOUBLE) AS flag FROM vec")
def drift_scan_short(spark, sf_dir):
    return vec(spark, sf_dir).select("obs", "sensor", "t0", "dx", "dy", F.when(F.col("flag") != 22, F.col("flag").cast("double")).alias("flag"))


@query(ctes(VEC) + "SELECT sensor AS view, count(*) AS n, round(sum(sigma),4) AS total FROM (SELECT sensor, sigma FROM vec WHERE sensor=1 UNION ALL SELECT sensor, sigma FROM vec WHERE sensor=2 UNION ALL SELECT sensor, NULL FROM vec WHERE sensor=3) GROUP BY 1")
def swath_union(spark, sf_dir):
    v = vec(spark, sf_dir).select("sensor", "sigma")
    every = v.where("sensor = 1").unionByName(v.where("sensor = 2")).unionByName(v.where("sensor = 3").select("sensor"), allowMissingColumns=True)
    return every.groupBy(F.col("sensor").alias("view")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sigma"), 4).alias("total"))


@query(ctes(VEC) + "SELECT DISTINCT month(t0)::BIGINT AS month, sensor FROM vec")
def param_stack(spark, sf_dir):
    return vec(spark, sf_dir).select(F.month("t0").cast("long").alias("month"), "sensor").distinct()


@query("SELECT o_orderpriority AS network, 'late' AS side, count(*) AS n FROM orders WHERE year(o_orderdate)>=1998 GROUP BY 1 UNION ALL SELECT o_orderpriority, 'early', count(*) FROM orders WHERE year(o_orderdate)<1998 GROUP BY 1")
def matchup_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda c, n: o.where(c).groupBy(F.col("o_orderpriority").alias("network")).agg(F.count(F.lit(1)).alias("n")).select("network", F.lit(n).alias("side"), "n")
    return side(F.year("o_orderdate") >= 1998, "late").unionByName(side(F.year("o_orderdate") < 1998, "early"))


@query(
    ctes(VEC)
    + """, g AS (SELECT x, y, avg(dx) AS dx, avg(dy) AS dy, bool_or(flag=0) AS ok FROM vec GROUP BY ALL), o AS (SELECT i,j FROM (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j) WHERE NOT (i=0 AND j=0))
SELECT c.x, c.y, count(*) AS navg, round(avg(n.dx),6)+0.0 AS avg_x, round(stddev_pop(n.dx),5) AS std_x, round(sqrt(pow(max(c.dx)-avg(n.dx),2)+pow(max(c.dy)-avg(n.dy),2)),5) AS len_diff FROM g c, o JOIN g n ON n.x=c.x+i AND n.y=c.y+j WHERE n.ok GROUP BY c.x, c.y HAVING count(*)>=5"""
)
def neighbour_mean(spark, sf_dir):
    """Mean of the valid vectors around a cell, itself excluded, where five or more are valid."""
    g = vec(spark, sf_dir).groupBy("x", "y").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.bool_or(F.col("flag") == 0).alias("ok"))
    n = g.where("ok").select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("dx").alias("ndx"), F.col("dy").alias("ndy"))
    ring = [o for o in merge.offsets(1.5) if o != (0, 0)]
    rows = merge.around(g, ring).join(n, ["nx", "ny"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("navg"), F.avg("ndx").alias("ax"), F.avg("ndy").alias("ay"), F.stddev_pop("ndx").alias("sx"), F.max("dx").alias("dx"), F.max("dy").alias("dy"))
    far = F.sqrt(F.pow(F.col("dx") - F.col("ax"), F.lit(2)) + F.pow(F.col("dy") - F.col("ay"), F.lit(2)))
    return rows.where("navg >= 5").select("x", "y", "navg", _R(F.col("ax"), "avg_x"), _R(F.col("sx"), "std_x", 5), _R(far, "len_diff", 5))


@query(
    """WITH c AS (SELECT c_custkey AS id, CAST(c_custkey%97 AS DOUBLE)+c_acctbal/20000 AS x, CAST(c_custkey%89 AS DOUBLE)+c_acctbal/30000 AS y FROM customer), s AS (SELECT s_suppkey AS sid, CAST(s_suppkey*7%97 AS DOUBLE) AS sx, CAST(s_suppkey*11%89 AS DOUBLE) AS sy FROM supplier),
 j AS (SELECT id, sid, (x-sx)*(x-sx)+(y-sy)*(y-sy) AS d2 FROM c JOIN s ON abs(x-sx)<=10 AND abs(y-sy)<=10), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, sid) AS k FROM j WHERE d2<=100)
SELECT id, sid, k, round(sqrt(d2),6) AS dist FROM r WHERE k<=5"""
)
def knn_join(spark, sf_dir):
    """Up to five nearest points within a radius, through buckets that widen up to it."""
    a, b = _points(spark, sf_dir)
    return spatial.nearest(a, b, 10.0, 5).select("id", "sid", F.col("place").cast("long").alias("k"), F.round(F.sqrt("d2"), 6).alias("dist"))


@query(
    """WITH c AS (SELECT c_custkey AS id, CAST(c_custkey%97 AS DOUBLE)+c_acctbal/20000 AS x, CAST(c_custkey%89 AS DOUBLE)+c_acctbal/30000 AS y FROM customer), s AS (SELECT s_suppkey AS sid, CAST(s_suppkey*7%97 AS DOUBLE) AS sx, CAST(s_suppkey*11%89 AS DOUBLE) AS sy FROM supplier),
 j AS (SELECT id, sid, (x-sx)*(x-sx)+(y-sy)*(y-sy) AS d2 FROM c JOIN s ON abs(x-sx)<=10 AND abs(y-sy)<=10)
SELECT id, arg_min(sid,(d2,sid)) AS sid, round(sqrt(min(d2)),6) AS dist FROM j WHERE d2<=100 GROUP BY id"""
)
def nn_join(spark, sf_dir):
    a, b = _points(spark, sf_dir)
    return spatial.nearest(a, b, 10.0, 1).select("id", "sid", F.round(F.sqrt("d2"), 6).alias("dist"))


def _points(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    k, j = F.col("c_custkey"), F.col("s_suppkey")
    a = c.select(k.alias("id"), ((k % 97).cast("double") + F.col("c_acctbal") / 20000).alias("x"), ((k % 89).cast("double") + F.col("c_acctbal") / 30000).alias("y"))
    return a, s.select(j.alias("sid"), (j * 7 % 97).cast("double").alias("sx"), (j * 11 % 89).cast("double").alias("sy"))
