"""Collocation of trajectories with a product in its three temporal modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import collocation
from spindrift.queries.adapters import FIX, VEC, ctes, fix, vec
from spindrift.queries.registry import query
from spindrift.queries.tracks import sql_haversine

_N = 12
#: A product a day on a grid of 12 x 12 cells, some of them missing; every tenth trajectory holds still.
_SETUP = f""", rec AS (SELECT traj_id AS traj, rec_id AS rec, epoch_us(ts)/1e6 AS t, (lat-60)/30*{_N - 1} AS x, (lon+180)/360*{_N - 1} AS y, 70+(lat-60)/30*{_N - 1}*0.3 AS lat, (lon+180)/360*{_N - 1}*0.9 AS lon, traj_id%10=0 AS static FROM fix),
 days AS (SELECT DISTINCT epoch_us(date_trunc('day',ts))//86400000000 AS prod FROM fix),
 g AS (SELECT (l.cell%{_N}) AS cx, (l.cell//{_N})%{_N} AS cy, avg(dx) AS dx, avg(dy) AS dy, avg(sigma) AS sx, min(flag) AS flag FROM vec l GROUP BY ALL),
 product AS (SELECT prod, cx, cy, 70+cx*0.3 AS lat, cy*0.9 AS lon, prod*86400.0+43200+(cx-6)*900+cy*60 AS t0, prod*86400.0+43200+86400+(cx-6)*900+cy*60+(cx%3)*1200 AS t1,
   CASE WHEN (cx*7+cy*3+prod)%23<>0 THEN dx END AS dx, dy, CASE WHEN (cx+cy)%5<>0 THEN sx END AS sx, sx+1 AS sy, 0.1*(cx%3) AS cxy, flag FROM g, days),
 spans AS (SELECT prod, prod*86400.0+43200 AS r0, prod*86400.0+43200+86400 AS r1 FROM days)"""


def _sql(nearest: bool, delay: float | None) -> str:
    begin, finish = ("r0", "r1") if delay is None else (f"p_t0+{delay * 3600}", f"p_t1+{delay * 3600}")
    values = [*collocation.VALUES, *collocation.SPREADS]
    km = sql_haversine("p.lat", "p.lon", "k.lat", "k.lon")
    valid, spread = "p.dx IS NOT NULL", "p.dx IS NOT NULL AND p.sx IS NOT NULL"
    mean = lambda v, q: f"sum(w*p.{v}) FILTER (WHERE {q})/sum(w) FILTER (WHERE {q}) AS m_{v}"
    if nearest:
        chosen = ", ".join(f"near.{v} AS p_{v}" for v in values) + ", CAST(near.cx AS DOUBLE) AS px, CAST(near.cy AS DOUBLE) AS py, CASE WHEN near.sx IS NOT NULL THEN 1.0 ELSE 0.0 END AS spread"
        test = "corners=4 AND near.km<40"
    else:
        chosen = ", ".join(f"m_{v} AS p_{v}" for v in values) + ", mx AS px, my AS py, coalesce(mw,0) AS spread"
        test = "total>0.99"
    return (
        ctes(FIX, VEC)
        + _SETUP
        + f""", lim AS (SELECT s.prod, r0, r1, least(min(t0), r1) AS low, greatest(max(t0), r0) AS high FROM spans s JOIN product p ON p.prod=s.prod AND p.dx IS NOT NULL GROUP BY s.prod, r0, r1),
 k AS (SELECT rec.*, lim.*, CASE WHEN static THEN low ELSE t END AS time FROM rec JOIN lim ON static OR (t BETWEEN low-10800 AND high+10800)),
 q AS (SELECT k.*, i, j, 2*i+j AS c, CAST(CASE WHEN i=0 THEN floor(x) ELSE ceil(x) END AS BIGINT) AS cx, CAST(CASE WHEN j=0 THEN floor(y) ELSE ceil(y) END AS BIGINT) AS cy,
   CASE WHEN i=0 THEN 1-(x-floor(x)) ELSE x-floor(x) END*CASE WHEN j=0 THEN 1-(y-floor(y)) ELSE y-floor(y) END AS w FROM k, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j)
   WHERE floor(x)>=0 AND ceil(x)<{_N} AND floor(y)>=0 AND ceil(y)<{_N}),
 m AS (SELECT k.prod, traj, rec, k.time, k.t, k.lat, k.lon, k.static, k.r0, k.r1, k.high, coalesce(sum(w) FILTER (WHERE {valid}),0) AS total, count(*) FILTER (WHERE {valid}) AS corners,
   min({{'km': {km}, 'c': c, 'cx': k.cx, 'cy': k.cy, 'flag': p.flag, {", ".join(f"'{v}': p.{v}" for v in values)}}}) FILTER (WHERE {valid}) AS near,
   sum(w*k.cx)/sum(w) FILTER (WHERE {valid}) AS mx, sum(w*k.cy)/sum(w) FILTER (WHERE {valid}) AS my, sum(w) FILTER (WHERE {spread}) AS mw,
   {", ".join(mean(v, valid) for v in collocation.VALUES)}, {", ".join(mean(v, spread) for v in collocation.SPREADS)}
   FROM q k LEFT JOIN product p ON p.prod=k.prod AND p.cx=k.cx AND p.cy=k.cy GROUP BY ALL),
 d AS (SELECT * EXCLUDE (mx, my), {chosen} FROM m WHERE total>0 AND {test}),
 f AS (SELECT *, time-({begin}) AS off, ({finish})-({begin}) AS duration FROM d),
 s AS (SELECT *, coalesce(abs(off)>=min(abs(off)) OVER (PARTITION BY prod, traj ORDER BY t, rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),false) AND off>0 AS stop FROM f),
 u AS (SELECT *, bool_or(stop) OVER (PARTITION BY prod, traj ORDER BY t, rec ROWS UNBOUNDED PRECEDING) AS stopped FROM s),
 a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prod, traj ORDER BY abs(off), t, rec) AS n FROM u WHERE NOT stopped) WHERE n=1 AND abs(off)<=10800),
 z AS (SELECT prod, traj, min((t, rec)) AS from_ FROM u WHERE stopped GROUP BY ALL),
 l AS (SELECT traj, max(t) AS last FROM rec GROUP BY 1),
 e AS (SELECT a.prod, a.traj, r.rec AS rec1, r.t AS t1, row_number() OVER (PARTITION BY a.prod, a.traj ORDER BY abs(r.t-a.t-duration), r.t, r.rec) AS n
   FROM a LEFT JOIN z ON z.prod=a.prod AND z.traj=a.traj JOIN l ON l.traj=a.traj JOIN rec r ON r.traj=a.traj
   WHERE NOT a.static AND abs(r.t-a.t-duration)<=3600 AND CASE WHEN from_ IS NOT NULL THEN (r.t, r.rec)>=from_ WHEN last>high+10800 THEN r.t>high+10800 ELSE true END),
 o AS (SELECT a.*, coalesce(e.rec1, a.rec) AS rec1, coalesce(e.t1, a.t) AS t1, 70+px*0.3 AS lat0, py*0.9 AS lon0 FROM a LEFT JOIN e ON e.prod=a.prod AND e.traj=a.traj AND e.n=1 WHERE a.static OR e.rec1 IS NOT NULL)
SELECT prod, traj, rec AS rec0, rec1, round(px,6)+0.0 AS px, round(py,6)+0.0 AS py, round(p_dx,6)+0.0 AS dx, round(p_dy,6)+0.0 AS dy,
 {", ".join(f"round(CASE WHEN spread>=0.99 THEN p_{v} ELSE -1.0 END,6) AS {v}" for v in collocation.SPREADS)}, near.cx AS i, near.cy AS j, near.flag AS flag,
 round({sql_haversine("lat", "lon", "lat0", "lon0")},5) AS distance, round((t-round(p_t0))/3600,6)+0.0 AS dtb, round((t1-round(p_t1))/3600,6)+0.0 AS dte FROM o"""
    )


def _matches(spark, sf_dir, nearest: bool, delay: float | None):
    from spindrift.operators.trajectory import seconds

    c = F.col
    x, y = (c("lat") - 60) / 30 * (_N - 1), (c("lon") + 180) / 360 * (_N - 1)
    f = fix(spark, sf_dir)
    rec = f.select(F.col("traj_id").alias("traj"), F.col("rec_id").alias("rec"), seconds(c("ts")).alias("t"), x.alias("x"), y.alias("y"), (70 + x * 0.3).alias("lat"), (y * 0.9).alias("lon"), (c("traj_id") % 10 == 0).alias("static"))
    days = rec.select(F.floor(c("t") / 86400).alias("prod")).distinct()  # a row a day
    g = vec(spark, sf_dir).groupBy((c("cell") % _N).alias("cx"), (F.expr(f"cell div {_N}") % _N).alias("cy")).agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.avg("sigma").alias("sx"), F.min("flag").alias("flag"))
    start = c("prod") * 86400.0 + 43200
    t0 = start + (c("cx") - 6) * 900 + c("cy") * 60
    product = g.join(F.broadcast(days)).select(
        "prod", "cx", "cy", (70 + c("cx") * 0.3).alias("lat"), (c("cy") * 0.9).alias("lon"), t0.alias("t0"), (t0 + 86400 + c("cx") % 3 * 1200).alias("t1"),
        F.when((c("cx") * 7 + c("cy") * 3 + c("prod")) % 23 != 0, c("dx")).alias("dx"), "dy", F.when((c("cx") + c("cy")) % 5 != 0, c("sx")).alias("sx"), (c("sx") + 1).alias("sy"), (0.1 * (c("cx") % 3)).alias("cxy"), "flag",
    )
    spans = days.select("prod", start.alias("r0"), (start + 86400).alias("r1"))
    got = collocation.collocate(rec, product, spans, (_N, _N), lambda x, y: (70 + x * 0.3, y * 0.9), nearest, delay)
    r = lambda n, d=6: (F.round(n, d) + 0.0).alias(n)
    return got.select("prod", "traj", "rec0", "rec1", *(r(n) for n in ("px", "py", "dx", "dy", *collocation.SPREADS)), "i", "j", "flag", r("distance", 5), r("dtb"), r("dte"))


@query(_sql(True, None))
def collocation_flat(spark, sf_dir):
    """The closest corner within 40 km, times forced to the references."""
    return _matches(spark, sf_dir, True, None)


@query(_sql(False, 0.0))
def collocation_timed(spark, sf_dir):
    """Bilinear corners over 0.99, times of the product."""
    return _matches(spark, sf_dir, False, 0.0)


@query(_sql(False, 2.0))
def collocation_delayed(spark, sf_dir):
    """As timed, two hours later."""
    return _matches(spark, sf_dir, False, 2.0)
