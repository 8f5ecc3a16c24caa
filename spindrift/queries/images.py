"""Stencils, correlations and tracking on small images."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import geo
from spindrift.operators import coarse, patterns, stencil, tracking
from spindrift.queries.adapters import PX, VEC, ctes, px, vec
from spindrift.queries.registry import query
from spindrift.runtime import table

_R = lambda c, n, d=6: (F.round(c, d) + 0.0).alias(n)
_N5 = ", o AS (SELECT i, j, greatest(abs(i),abs(j)) AS ring FROM (SELECT unnest(range(-2,3)) AS i), (SELECT unnest(range(-2,3)) AS j)), n AS (SELECT p.image, p.x, p.y, p.v, ring, q.v AS nv FROM px p, o JOIN px q ON q.image=p.image AND q.x=p.x+i AND q.y=p.y+j)"


@query(
    ctes(PX) + _N5 + ", a AS (SELECT image, x, y, avg(nv) FILTER (WHERE ring<=1) AS a, avg(nv) FILTER (WHERE ring=2) AS b, count(*) FILTER (WHERE ring<=1) AS n1, count(*) FILTER (WHERE ring=2) AS n2 FROM n GROUP BY ALL) SELECT image, x, y, round(CASE WHEN n1>=5 AND n2>=9 THEN a-b END,6)+0.0 AS lap, CASE WHEN n1>=5 AND n2>=9 THEN 0 ELSE 1 END AS flag FROM a"
)
def laplacian(spark, sf_dir):
    return stencil.laplacian(px(spark, sf_dir)).select("image", "x", "y", _R(F.col("lap"), "lap"), "flag")


@query(ctes(PX) + _N5 + " SELECT image, x, y, count(*) AS n, round(CASE WHEN count(*)*2>=9 THEN avg(nv) END,6)+0.0 AS mean FROM n WHERE ring<=1 GROUP BY ALL")
def box_filter(spark, sf_dir):
    return stencil.box_mean(px(spark, sf_dir), 1).select("image", "x", "y", "n", _R(F.col("mean"), "mean"))


@query(ctes(PX) + _N5 + ", m AS (SELECT image, x, y, avg(nv) AS m FROM n WHERE ring<=1 GROUP BY ALL) SELECT n.image, n.x, n.y, round(arg_min(nv, (round(abs(nv-m),9), nv)),6)+0.0 AS v FROM n JOIN m ON n.image=m.image AND n.x=m.x AND n.y=m.y WHERE ring<=1 GROUP BY ALL")
def nearest_to_mean(spark, sf_dir):
    """The value of a window that is closest to the window's mean."""
    window = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)]
    n = stencil.neighbours(px(spark, sf_dir), window)
    m = n.groupBy("image", "x", "y").agg(F.avg("nv").alias("m"), F.collect_list("nv").alias("all"))  # nine at most
    rows = m.select("image", "x", "y", "m", F.explode("all").alias("nv"))
    return rows.groupBy("image", "x", "y").agg(_R(F.min_by("nv", F.struct(F.round(F.abs(F.col("nv") - F.col("m")), 9), "nv")), "v"))


@query(
    ctes(PX)
    + "SELECT p.image, p.image+1 AS other, round(corr(p.v,q.v),6)+0.0 AS rho, round(covar_pop(p.v,q.v)/var_pop(p.v),6)+0.0 AS alpha, round(avg(q.v)-covar_pop(p.v,q.v)/var_pop(p.v)*avg(p.v),6)+0.0 AS beta FROM px p JOIN px q ON q.image=p.image+1 AND q.x=p.x AND q.y=p.y GROUP BY p.image HAVING count(*)>=48"
)
def ncc_pairs(spark, sf_dir):
    """Correlation of image pairs where three quarters of the pixels are there, with the linear scaling between them."""
    p = px(spark, sf_dir)
    q = p.select((F.col("image") - 1).alias("image"), "x", "y", F.col("v").alias("w"))
    cov, var = F.covar_pop("v", "w"), F.var_pop("v")
    got = p.join(q, ["image", "x", "y"]).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.corr("v", "w").alias("r"), (cov / var).alias("a"), (F.avg("w") - cov / var * F.avg("v")).alias("b"))
    return got.where("n >= 48").select("image", (F.col("image") + 1).alias("other"), _R(F.col("r"), "rho"), _R(F.col("a"), "alpha"), _R(F.col("b"), "beta"))


@query(
    ctes(PX)
    + ", j AS (SELECT p.image, p.v, q.v AS w FROM px p JOIN px q ON q.image=p.image+1 AND q.x=p.x AND q.y=p.y), c AS (SELECT image, covar_pop(v,w)/var_pop(v) AS a, avg(w)-covar_pop(v,w)/var_pop(v)*avg(v) AS b FROM j GROUP BY 1) SELECT j.image, round(0.5*sum(pow(a*v+b-w,2)),5) AS score FROM j JOIN c USING (image) GROUP BY j.image"
)
def scaled_sqdiff(spark, sf_dir):
    """Half the squared difference after the best linear scaling, from sums alone."""
    p = px(spark, sf_dir)
    q = p.select((F.col("image") - 1).alias("image"), "x", "y", F.col("v").alias("w"))
    n, cov, var = F.count(F.lit(1)), F.covar_pop("v", "w"), F.var_pop("v")
    score = n * (F.var_pop("w") - cov * cov / var) / 2
    return p.join(q, ["image", "x", "y"]).groupBy("image").agg(F.round(score, 5).alias("score"))


_SHIFT = """, c AS (SELECT i, j, CASE WHEN i=0 THEN 0.7 ELSE 0.3 END*CASE WHEN j=0 THEN 0.6 ELSE 0.4 END AS w FROM (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j)),
 s AS (SELECT p.image, p.x, p.y, sum(w*q.v)/sum(w) AS sv, sum(w) AS sw FROM px p, c JOIN px q ON q.image=p.image AND q.x=p.x+i AND q.y=p.y+j GROUP BY ALL)"""


def _shifted(spark, sf_dir):
    p = px(spark, sf_dir)
    c = F.explode(geo.corners(F.col("x") + 0.3, F.col("y") + 0.4))
    rows = p.select("image", "x", "y", c.alias("c")).select("image", "x", "y", "c.*")
    q = p.select("image", F.col("x").alias("cx"), F.col("y").alias("cy"), "v")
    w = F.col("weight")
    return rows.join(q, ["image", "cx", "cy"]).groupBy("image", "x", "y").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("sv"), F.sum(w).alias("sw"))


@query(ctes(PX) + _SHIFT + " SELECT image, x, y, round(CASE WHEN sw>0.75 THEN sv END,6)+0.0 AS v, CASE WHEN sw>0.75 THEN 0 ELSE 2 END AS flag FROM s")
def bilinear_shift(spark, sf_dir):
    """An image moved by a fraction of a pixel; valid where the corners that are there weigh over 0.75."""
    ok = F.col("sw") > 0.75
    return _shifted(spark, sf_dir).select("image", "x", "y", _R(F.when(ok, F.col("sv")), "v"), F.when(ok, 0).otherwise(2).alias("flag"))


@query(ctes(PX) + _SHIFT + " SELECT s.image, count(*) AS n, round(corr(s.sv,p.v),6)+0.0 AS rho, round((corr(s.sv,p.v)+1)/(1+exp((0.5-3.0)*10))-1,6)+0.0 AS score FROM s JOIN px p ON p.image=s.image+1 AND p.x=s.x AND p.y=s.y WHERE sw>0.75 GROUP BY s.image HAVING count(*)>=48")
def shifted_ncc(spark, sf_dir):
    p = px(spark, sf_dir).select((F.col("image") - 1).alias("image"), "x", "y", "v")
    got = _shifted(spark, sf_dir).where("sw > 0.75").join(p, ["image", "x", "y"]).groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.corr("sv", "v").alias("r")).where("n >= 48")
    return got.select("image", "n", _R(F.col("r"), "rho"), _R((F.col("r") + 1) * geo.sigmoid(F.lit(0.5), F.lit(3.0)) - 1, "score"))


@query(ctes(PX) + "SELECT image, round(1/(1+exp(least(700.0,greatest(-700.0,(avg(v)*20-x)*10)))),8) AS weight, x FROM px GROUP BY image, x")
def sigmoid_weight(spark, sf_dir):
    m = px(spark, sf_dir).groupBy("image", "x").agg(F.avg("v").alias("m"))
    return m.select("image", "x", F.round(geo.sigmoid(F.col("m") * 20, F.col("x").cast("double")), 8).alias("weight"))


@query(
    ctes(PX)
    + """, o AS (SELECT i, j FROM (SELECT unnest(range(-2,3)) AS i), (SELECT unnest(range(-2,3)) AS j)), s AS (SELECT p.image, i, j, count(*) AS n, corr(p.v,q.v) AS r FROM px p, o JOIN px q ON q.image=p.image+1 AND q.x=p.x+i AND q.y=p.y+j GROUP BY ALL)
SELECT image, i, j, place, round(r,6)+0.0 AS rho FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(r,9) DESC, j, i) AS place FROM s) WHERE place<=3"""
)
def top3_candidates(spark, sf_dir):
    """The three best displacements of each pair."""
    p = px(spark, sf_dir)
    q = p.select((F.col("image") - 1).alias("image"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("v").alias("w"))
    from spindrift.operators.merge import around

    rows = around(p, stencil.WINDOW_5).withColumns({"i": F.col("nx") - F.col("x"), "j": F.col("ny") - F.col("y")}).join(q, ["image", "nx", "ny"])
    s = rows.groupBy("image", "i", "j").agg(F.corr("v", "w").alias("r"))
    w = Window.partitionBy("image").orderBy(F.round("r", 9).desc(), "j", "i")
    return s.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("image", "i", "j", "place", _R(F.col("r"), "rho"))


def _ring_table() -> str:
    moves = tracking.candidates(2.0, 0.5, 1.0)
    return ", ".join(f"({k}, {dx!r}, {dy!r})" for k, (dx, dy) in enumerate(moves))


@query(
    ctes(PX)
    + f""", k AS (SELECT * FROM (VALUES {_ring_table()}) AS t(candidate, dx, dy)), o AS (SELECT i, j FROM (SELECT unnest(range(-1,2)) AS i), (SELECT unnest(range(-1,2)) AS j) WHERE i*i+j*j<=1),
 q AS (SELECT unnest([0,1]) AS qi), r AS (SELECT qi AS qj FROM q),
 s AS (SELECT p.image, p.x, p.y, candidate, sum(w*e.v) AS sv, sum(w) AS sw FROM (SELECT p.image, p.x, p.y, candidate, CAST(floor(p.x+dx) AS BIGINT)+qi AS cx, CAST(floor(p.y+dy) AS BIGINT)+qj AS cy,
   abs(1-qi-(p.x+dx-floor(p.x+dx)))*abs(1-qj-(p.y+dy-floor(p.y+dy))) AS w FROM px p, k, q, r) p JOIN px e ON e.image=p.image+1 AND e.x=cx AND e.y=cy GROUP BY ALL),
 c AS (SELECT image, x, y FROM px WHERE x%2=1 AND y%2=0),
 m AS (SELECT c.image, c.x, c.y, candidate, count(*) AS n, corr(p.v, sv/sw) AS rho FROM c, o JOIN px p ON p.image=c.image AND p.x=c.x+i AND p.y=c.y+j JOIN s ON s.image=p.image AND s.x=p.x AND s.y=p.y AND sw>0.75 GROUP BY ALL),
 g AS (SELECT image, x, y, k.candidate, dx, dy, (rho+1)/(1+exp((sqrt(dx*dx+dy*dy)-2.0)*10))-1 AS score FROM m JOIN k USING (candidate) WHERE n>=0.75*5 AND rho IS NOT NULL AND NOT isnan(rho))
SELECT image, x, y, CAST(place AS INTEGER) AS place, candidate, round(dx,9)+0.0 AS dx, round(dy,9)+0.0 AS dy, round(score,6)+0.0 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY image, x, y ORDER BY score DESC, candidate) AS place FROM g WHERE score>-1) WHERE place<=3"""
)
def coarse_search(spark, sf_dir):
    """The best three displacements of the rings for every second pixel of each image and the next, on tiles of 4 x 4 pixels."""
    p = px(spark, sf_dir)
    cells = p.where("x % 2 = 1 and y % 2 = 0").select("image", "x", "y")
    got = coarse.search(cells, p, p.withColumn("image", F.col("image") - 1), limit=2.0, radius=1.0, first=0.5, step=1.0, tile=4)
    return got.select("image", "x", "y", "place", "candidate", _R(F.col("dx"), "dx", 9), _R(F.col("dy"), "dy", 9), _R(F.col("score"), "score"))


@query()
def simplex_track_sd(spark, sf_dir):
    """Motion of each image to the next by the least scaled squared difference, instead of the correlation."""
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("pair"), F.col("embedding").alias("b"))
    return tracking.track_pairs(e.select(F.col("vec_id").alias("pair"), F.col("embedding").alias("a")).join(b, "pair"), 8, metric="SD")


@query()
def simplex_track(spark, sf_dir):
    """Sub-pixel motion of each image to the next by the simplex."""
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("pair"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("pair"), F.col("embedding").alias("b"))
    return tracking.track_pairs(a.join(b, "pair"), 8)


@query()
def posterior_cov(spark, sf_dir):
    """Covariance of each image's motion to the next at its optimum, from the curvature of the scaled squared difference."""
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("pair"), F.col("embedding").alias("b"))
    pairs = e.select(F.col("vec_id").alias("pair"), F.col("embedding").alias("a")).join(b, "pair")
    return tracking.posterior_pairs(pairs, 8)


@query()
def neighbour_correction(spark, sf_dir):
    """Motions of image pairs on 10 x 10 grids; worst first, outliers are found anew about their neighbours' mean, with their posterior."""
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("pair"), F.col("embedding").alias("b"))
    pairs = e.select(F.col("vec_id").alias("pair"), F.col("embedding").alias("a")).join(b, "pair")
    cell = F.col("pair") % 100
    pairs = pairs.select(F.expr("pair div 100").alias("field"), (cell % 10).alias("x"), F.floor(cell / 10).alias("y"), "a", "b")
    return tracking.correct_images(pairs, "field", 8, 3.0, 1.0)


@query(ctes(PX) + "SELECT image, x, y, round(v,6)+0.0 AS v FROM px WHERE x%2=0 AND y%2=0")
def strided_read(spark, sf_dir):
    return px(spark, sf_dir).where("x % 2 = 0 and y % 2 = 0").select("image", "x", "y", _R(F.col("v"), "v"))


@query(ctes(PX) + ", d AS (SELECT DISTINCT image, x FROM px), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY x) AS k FROM d) SELECT image, max(x) FILTER (WHERE k=2)-max(x) FILTER (WHERE k=1) AS spacing, min(x)-0.5 AS left_, max(x)+0.5 AS right_ FROM r GROUP BY image")
def smallest_spacing(spark, sf_dir):
    """Spacing from the two smallest coordinates; extent padded by half a pixel."""
    d = px(spark, sf_dir).groupBy("image").agg(F.array_sort(F.collect_set("x")).alias("s"))  # a row of pixels
    at = lambda k: F.element_at("s", k)
    return d.select("image", (at(2) - at(1)).alias("spacing"), (at(1) - 0.5).alias("left_"), (at(-1) + 0.5).alias("right_"))


#: Ice edge and state of a pixel from its value; every 17th image is open water.
_EDGE = "CASE WHEN abs(v)<0.002 THEN 9 WHEN image%17=3 OR v<-0.25 THEN 1 WHEN v<-0.2 THEN 2 ELSE 3 END"
_STATE = "CASE WHEN v>0.27 THEN -1 WHEN v>0.255 THEN 1 ELSE 0 END"


def _coded(spark, sf_dir):
    v = F.col("v")
    edge = F.when(F.abs(v) < 0.002, 9).when((F.col("image") % 17 == 3) | (v < -0.25), 1).when(v < -0.2, 2).otherwise(3)
    return px(spark, sf_dir).select("image", "x", "y", "v", edge.alias("edge"), F.when(v > 0.27, -1).when(v > 0.255, 1).otherwise(0).alias("tc"))


@query(
    ctes(PX)
    + f""", e AS (SELECT image, x, y, {_EDGE} AS edge, {_STATE} AS tc FROM px),
 o AS (SELECT i, j, i*i+j*j<=1 AS small FROM (SELECT unnest(range(-2,3)) AS i), (SELECT unnest(range(-2,3)) AS j) WHERE i*i+j*j<=4),
 c AS (SELECT p.image, x, y FROM (SELECT DISTINCT image FROM px) p JOIN (SELECT DISTINCT image-1 AS image FROM px) q USING (image), (SELECT unnest(range(-1,9)) AS x), (SELECT unnest(range(-1,9)) AS y)),
 j AS (SELECT c.image, c.x, c.y, i=0 AND j=0 AS middle, small, a.edge AS e0, a.tc IS NOT NULL AS there, a.edge IN (2,3) AND b.edge IN (2,3) AS ice,
   coalesce(a.tc=-1,false) OR coalesce(b.tc=-1,false) AS gone, coalesce(a.tc=1,false) OR coalesce(b.tc=1,false) AS unread
   FROM c CROSS JOIN o LEFT JOIN e a ON a.image=c.image AND a.x=c.x+i AND a.y=c.y+j LEFT JOIN e b ON b.image=c.image+1 AND b.x=c.x+i AND b.y=c.y+j),
 n AS (SELECT image, x, y, bool_or(middle AND there) AS inside, bool_and(there) AS all_there, max(e0) FILTER (WHERE middle) AS edge,
   count(*) AS pl, count(*) FILTER (WHERE ice) AS il, count(*) FILTER (WHERE gone) AS ml, count(*) FILTER (WHERE unread) AS ul,
   count(*) FILTER (WHERE small) AS ps, count(*) FILTER (WHERE small AND ice) AS s_i, count(*) FILTER (WHERE small AND gone) AS ms, count(*) FILTER (WHERE small AND unread) AS us FROM j GROUP BY ALL),
 f AS (SELECT image, x, y, CASE WHEN NOT inside THEN 1 WHEN NOT all_there THEN 2 WHEN edge>=9 THEN 3 WHEN il=0 THEN 4
   WHEN il=pl THEN CASE WHEN ul>0 THEN 7 WHEN ml=0 THEN 0 WHEN ms>0 THEN 6 ELSE 0 END
   WHEN s_i<>ps THEN 5 WHEN us>0 THEN 7 WHEN ms>0 THEN 6 ELSE 0 END AS flag,
   CASE WHEN NOT inside OR NOT all_there OR edge>=9 THEN -1 WHEN il=0 THEN 0 WHEN il<pl THEN 1 WHEN ul>0 OR ml=0 THEN 0 ELSE 1 END AS pattern FROM n)
SELECT image, x, y, flag, pattern, CASE WHEN flag=0 AND pattern=1 THEN 17 ELSE flag END AS product_flag FROM f"""
)
def tracking_flag_ladder(spark, sf_dir):
    """Cells of each image and the next: outside, border, land, no ice, edge, missing, unprocessed, else fine with the large or the small pattern."""
    e = _coded(spark, sf_dir)
    second = e.withColumn("image", F.col("image") - 1)
    pairs = e.select("image").distinct().join(second.select("image").distinct(), "image")
    side = F.sequence(F.lit(-1), F.lit(8))
    cells = pairs.withColumn("x", F.explode(side)).withColumn("y", F.explode(side)).select("image", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    return patterns.ladder(cells, e, second, 2, 1)


_AROUND = """o AS (SELECT i, j, greatest(abs(i),abs(j)) AS ring FROM (SELECT unnest(range(-2,3)) AS i), (SELECT unnest(range(-2,3)) AS j) WHERE i<>0 OR j<>0),
 n AS (SELECT p.image, p.x, p.y, count(*) FILTER (WHERE q.v IS NULL) AS gone, avg(q.v) FILTER (WHERE ring=1 AND q.edge IN (2,3)) AS a, avg(q.v) FILTER (WHERE ring=2 AND q.edge IN (2,3)) AS b,
   count(q.v) FILTER (WHERE ring=1 AND q.edge IN (2,3)) AS n1, count(q.v) FILTER (WHERE ring=2 AND q.edge IN (2,3)) AS n2,
   count(*) FILTER (WHERE p.x>=2 AND q.v IS NULL) AS egone, count(q.v) FILTER (WHERE p.x>=2 AND ring=1 AND q.edge IN (2,3)) AS e1, count(q.v) FILTER (WHERE p.x>=2 AND ring=2 AND q.edge IN (2,3)) AS e2
   FROM e p, o JOIN e q ON q.image=p.image AND q.x=p.x+i AND q.y=p.y+j WHERE p.v IS NOT NULL AND p.edge IN (2,3) GROUP BY ALL)"""


@query(
    ctes(PX)
    + f""", e AS (SELECT image, x, y, CASE WHEN {_STATE}=-1 THEN NULL ELSE v END AS v, {_EDGE} AS edge FROM px), {_AROUND},
 f AS (SELECT *, CASE WHEN gone>1 THEN -1 WHEN n1>=5 AND n2>=9 THEN 0 ELSE 1 END AS f, CASE WHEN egone>1 THEN -1 WHEN e1>=5 AND e2>=9 THEN 0 ELSE 1 END AS g FROM n)
SELECT e.image, e.x, e.y, round(CASE WHEN f=0 THEN a-b END,6)+0.0 AS lap, coalesce(f,1) AS flag, round(CASE WHEN g=0 THEN a-b END,6)+0.0 AS edge_lap, coalesce(g,1) AS edge_flag
FROM e LEFT JOIN f ON f.image=e.image AND f.x=e.x AND f.y=e.y"""
)
def laplacian_ice(spark, sf_dir):
    """The Laplacian of ice pixels from ice neighbours, with the outside skipped and with rows that end at the border."""
    e = _coded(spark, sf_dir).withColumn("v", F.when(F.col("tc") != -1, F.col("v")))
    return patterns.laplacian_of_ice(e).select("image", "x", "y", _R(F.col("lap"), "lap"), "flag", _R(F.col("edge_lap"), "edge_lap"), "edge_flag")


@query(
    ctes(PX)
    + """, a AS (SELECT image, y, max(v) FILTER (WHERE x=3) AS l, max(v) FILTER (WHERE x=4) AS c, max(v) FILTER (WHERE x=5) AS r FROM px GROUP BY ALL),
 b AS (SELECT image, sqrt(avg(pow(c-l,2))) AS d1, sqrt(avg(pow(c-r,2))) AS d2, sqrt(avg(pow(l-r,2))) AS d0 FROM a GROUP BY 1) SELECT image, round(d1,6) AS d1, round(d2,6) AS d2, d1>2*d0 AND d2>2*d0 AS flip FROM b"""
)
def line_detector(spark, sf_dir):
    """Whether a column stands out from both its neighbours, by twice what these differ."""
    return _standing_out(px(spark, sf_dir)).select("image", F.round("a1", 6).alias("d1"), F.round("a2", 6).alias("d2"), "flip")


def _standing_out(pixels):
    at = lambda k: F.max(F.when(F.col("x") == k, F.col("v")))
    a = pixels.groupBy("image", "y").agg(at(3).alias("l"), at(4).alias("c"), at(5).alias("r"))
    rms = lambda p, q: F.sqrt(F.avg((F.col(p) - F.col(q)) * (F.col(p) - F.col(q))))
    b = a.groupBy("image").agg(rms("c", "l").alias("a1"), rms("c", "r").alias("a2"), rms("l", "r").alias("a0"))
    return b.withColumn("flip", (F.col("a1") > 2 * F.col("a0")) & (F.col("a2") > 2 * F.col("a0")))


@query(
    ctes(PX)
    + """, s AS (SELECT image, x, y, CASE WHEN x=4 AND image%2=0 THEN 5.0::DOUBLE-3*v ELSE v END AS v FROM px),
 a AS (SELECT image, y, max(v) FILTER (WHERE x=3) AS l, max(v) FILTER (WHERE x=4) AS c, max(v) FILTER (WHERE x=5) AS r FROM s GROUP BY ALL),
 b AS (SELECT image, sqrt(avg(pow(c-l,2)))>2*sqrt(avg(pow(l-r,2))) AND sqrt(avg(pow(c-r,2)))>2*sqrt(avg(pow(l-r,2))) AS flip FROM a GROUP BY 1)
SELECT image, x, y, round(CASE WHEN flip AND x=4 THEN -v ELSE v END,6)+0.0 AS v FROM s JOIN b USING (image)"""
)
def line_fix(spark, sf_dir):
    """The detector applied: a column that stands out changes its sign (every second image has such a column put in)."""
    s = px(spark, sf_dir).withColumn("v", F.when((F.col("x") == 4) & (F.col("image") % 2 == 0), 5.0 - 3 * F.col("v")).otherwise(F.col("v")))
    rows = s.join(_standing_out(s).select("image", "flip"), "image")
    return rows.select("image", "x", "y", _R(F.when(F.col("flip") & (F.col("x") == 4), -F.col("v")).otherwise(F.col("v")), "v"))


@query(ctes(PX) + "SELECT image, x, y, round(CASE WHEN abs(v)>0.2 THEN pow(abs(v)-0.2,2)*100 ELSE 0.0 END,8) AS penalty FROM px")
def soft_penalty(spark, sf_dir):
    over = F.abs("v") - 0.2
    return px(spark, sf_dir).select("image", "x", "y", F.round(F.when(over > 0, over * over * 100).otherwise(F.lit(0.0)), 8).alias("penalty"))


@query(
    ctes(PX)
    + """, o AS (SELECT i,j FROM (SELECT unnest([-1,0,1]) AS i), (SELECT unnest([-1,0,1]) AS j) WHERE NOT (i=0 AND j=0)) SELECT p.image, p.x, p.y, count(q.v) AS n_there, 8-count(q.v) AS n_missing FROM px p CROSS JOIN o LEFT JOIN px q ON q.image=p.image AND q.x=p.x+i AND q.y=p.y+j GROUP BY ALL"""
)
def stencil_lookup(spark, sf_dir):
    """Neighbours of a disc without its centre, and how many lie outside."""
    ring = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if (i, j) != (0, 0)]
    n = stencil.neighbours(px(spark, sf_dir), ring).groupBy("image", "x", "y").agg(F.count("nv").alias("n_there"))
    return n.select("image", "x", "y", "n_there", (8 - F.col("n_there")).alias("n_missing"))


@query(ctes(PX, VEC) + ", c AS (SELECT obs, sensor, t0, CASE WHEN x<8 AND y<8 THEN y*8+x END AS place FROM vec) SELECT obs, sensor, t0, round(p.v,6)+0.0 AS v, coalesce(place,-1) AS place FROM c LEFT JOIN px p ON p.image=obs%100 AND p.y*8+p.x=c.place")
def pixel_lookup(spark, sf_dir):
    """The pixel under an output cell; cells outside the image have none."""
    c = vec(spark, sf_dir).select("obs", "sensor", "t0", F.when((F.col("x") < 8) & (F.col("y") < 8), F.col("y") * 8 + F.col("x")).alias("place"), (F.col("obs") % 100).alias("image"))
    p = px(spark, sf_dir).select("image", (F.col("y") * 8 + F.col("x")).alias("place"), "v")
    return c.join(p, ["image", "place"], "left").select("obs", "sensor", "t0", _R(F.col("v"), "v"), F.coalesce("place", F.lit(-1)).alias("place"))


@query(ctes(PX) + "SELECT image, x, y, CASE WHEN v>0 THEN image*86400+CAST(round(v*1000) AS BIGINT) ELSE -1 END AS t0 FROM px")
def pixel_times(spark, sf_dir):
    """Time of a pixel where it is valid."""
    t = F.col("image") * 86400 + F.round(F.col("v") * 1000).cast("long")
    return px(spark, sf_dir).select("image", "x", "y", F.when(F.col("v") > 0, t).otherwise(F.lit(-1)).cast("long").alias("t0"))


@query(ctes(PX) + ", m AS (SELECT max(abs(v))*100 AS hi FROM px), b AS (SELECT image, x, y, CASE WHEN hi>50 THEN v*100/100 ELSE v*100 END AS c FROM px, m) SELECT image, count(*) FILTER (WHERE c>=0 AND c<0.4) AS open_, count(*) FILTER (WHERE c>=0.4 AND c<0.7) AS close_, count(*) FILTER (WHERE c<0 OR c>=0.7) AS full_, count(*) FILTER (WHERE c*100>=40) AS e3, count(*) FILTER (WHERE c*100<40) AS e1 FROM b GROUP BY image")
def bands(spark, sf_dir):
    """Concentration bands, percent or fraction told apart by the largest value, and edge classes."""
    p = px(spark, sf_dir)
    hi = p.agg((F.max(F.abs("v")) * 100).alias("hi"))  # one row
    c = F.when(F.col("hi") > 50, F.col("v") * 100 / 100).otherwise(F.col("v") * 100)
    b = p.join(F.broadcast(hi)).withColumn("c", c)
    c = F.col("c")
    n = lambda q, a: F.count_if(q).alias(a)
    return b.groupBy("image").agg(n((c >= 0) & (c < 0.4), "open_"), n((c >= 0.4) & (c < 0.7), "close_"), n((c < 0) | (c >= 0.7), "full_"), n(c * 100 >= 40, "e3"), n(c * 100 < 40, "e1"))


@query(ctes(VEC) + "SELECT obs, sensor, t0, round(sqrt(dx*dx+dy*dy),6) AS len, round(hour(t0)+dx/10-12,6)+0.0 AS t0_h, round(dx/10-dy/10+24,6)+0.0 AS tdiff FROM vec")
def magnitude_offsets(spark, sf_dir):
    x, y = F.col("dx"), F.col("dy")
    return vec(spark, sf_dir).select("obs", "sensor", "t0", _R(F.sqrt(x * x + y * y), "len"), _R(F.hour("t0") + x / 10 - 12, "t0_h"), _R(x / 10 - y / 10 + 24, "tdiff"))


@query(
    ctes(PX, VEC)
    + """, g AS (SELECT x, y, avg(dx) AS u, avg(dy) AS v FROM vec GROUP BY ALL), p AS (SELECT DISTINCT x, y, x+0.25 AS fx, y+0.5 AS fy FROM px), c AS (SELECT p.x, p.y, p.x+i AS cx, p.y+j AS cy, CASE WHEN i=0 THEN 0.75 ELSE 0.25 END*0.5 AS w FROM p, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j))
SELECT c.x, c.y, round(sum(w*(u*cos(radians(30))-v*sin(radians(30))))/sum(w),8)+0.0 AS ru, round(sum(w*(u*sin(radians(30))+v*cos(radians(30))))/sum(w),8)+0.0 AS rv FROM c JOIN g ON g.x=c.cx AND g.y=c.cy GROUP BY c.x, c.y"""
)
def bilinear_remap(spark, sf_dir):
    """Wind on another grid: bilinear weights, then the rotation between the grids."""
    g = vec(spark, sf_dir).groupBy(F.col("x").alias("cx"), F.col("y").alias("cy")).agg(F.avg("dx").alias("u"), F.avg("dy").alias("v"))
    p = px(spark, sf_dir).select("x", "y").distinct().select("x", "y", F.explode(geo.corners(F.col("x") + 0.25, F.col("y") + 0.5)).alias("c")).select("x", "y", "c.*")
    a, w = F.radians(F.lit(30.0)), F.col("weight")
    m = lambda e: F.sum(w * e) / F.sum(w)
    return p.join(g, ["cx", "cy"]).groupBy("x", "y").agg(_R(m(F.col("u") * F.cos(a) - F.col("v") * F.sin(a)), "ru", 8), _R(m(F.col("u") * F.sin(a) + F.col("v") * F.cos(a)), "rv", 8))


@query(ctes(PX) + ", g AS (SELECT image, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px WHERE NOT (image%50=7 AND x=7) GROUP BY image) SELECT a.image, a.n=b.n AND a.x0=b.x0 AND a.x1=b.x1 AND a.y0=b.y0 AND a.y1=b.y1 AS same FROM g a JOIN g b ON b.image=a.image+1")
def image_grid_check(spark, sf_dir):
    """Whether the two images of a pair lie on the same grid."""
    p = px(spark, sf_dir).where("not (image % 50 = 7 and x = 7)")
    g = p.groupBy("image").agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).alias("a"))
    other = g.select((F.col("image") - 1).alias("image"), F.col("a").alias("b"))
    return g.join(other, "image").select("image", (F.col("a") == F.col("b")).alias("same"))
