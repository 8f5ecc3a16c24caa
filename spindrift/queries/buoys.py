"""Lines of the buoy catalogues, written from events and read again by their rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.queries.registry import query
from spindrift.runtime import table

def _id():
    return F.col("event_id")


def _lines(spark, sf_dir, value, file=None):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat_ws("", *value).alias("value"), (file if file is not None else F.col("user_id").cast("string")).alias("file"), (_id() + 20).alias("line_no"))


def _plain(rows):
    stamp = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime")
    return rows.select("event_id", stamp, F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.col("source").cast("int").alias("source"))


def _hudson_sql() -> str:
    """The inverse conic, its latitude by repeated substitution."""
    e = "sqrt(1-(b/a)*(b/a))"
    t = "(tan(pi()/4-{0}/2)/pow((1-e*sin({0}))/(1+e*sin({0})),e/2))"
    m = "(cos({0})/sqrt(1-pow(e*sin({0}),2)))"
    p1, p2 = "radians(44.5::DOUBLE)", "radians(54.5::DOUBLE)"
    cone = f"c0 AS (SELECT a, {e} AS e FROM (SELECT 6378137.0::DOUBLE AS a, 6356752.314140356::DOUBLE AS b)), c1 AS (SELECT a, e, ln({m.format(p1)}/{m.format(p2)})/ln({t.format(p1)}/{t.format(p2)}) AS n FROM c0), c2 AS (SELECT a, e, n, a*{m.format(p1)}/(n*pow({t.format(p1)},n)) AS u FROM c1)"
    places = "p0 AS (SELECT event_id, ts, e, n, (event_id%200-100)*10000.0::DOUBLE AS dx, u-(7000000+event_id%300*10000)::DOUBLE AS dy, u FROM events, c2), p1 AS (SELECT *, pow(sqrt(dx*dx+dy*dy)/u,1/n) AS t FROM p0), l0 AS (SELECT *, pi()/2-2*atan(t) AS phi FROM p1)"
    steps = ", ".join(f"l{k + 1} AS (SELECT * EXCLUDE (phi), pi()/2-2*atan(t*pow((1-e*sin(phi))/(1+e*sin(phi)),e/2)) AS phi FROM l{k})" for k in range(8))
    return f"WITH {cone}, {places}, {steps}, r AS (SELECT event_id, ts, degrees(phi) AS lat, -84+degrees(atan2(dx,dy)/n) AS lon FROM l8) SELECT event_id, strftime(date_trunc('minute',ts),'%Y-%m-%d %H:%M:%S') AS datetime, round(lat,5) AS lat, round(CASE WHEN lon<0 THEN lon+360 ELSE lon END,5) AS lon, 0 AS source FROM r"


@query(_hudson_sql())
def projected_records(spark, sf_dir):
    """Positions in metres of a conic projection."""
    from spindrift.sources.text import CATALOGUES, records

    x, y = 1000000 + (_id() % 200 - 100) * 10000, 7000000 + _id() % 300 * 10000
    value = [F.lit("collar 2024 "), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("\t"), x.cast("string"), F.lit(" "), y.cast("string")]
    return _plain(records(_lines(spark, sf_dir, value), CATALOGUES["hudson"], carry=("event_id",)))


@query(
    """WITH s AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_id%97=5 GROUP BY user_id)
SELECT event_id, strftime(date_trunc('minute',ts),'%Y-%m-%d %H:%M:%S') AS datetime, (60+event_id%30)::DOUBLE AS lat, CASE WHEN event_id%360>180 THEN 540-event_id%360 ELSE event_id%360 END::DOUBLE AS lon, CASE WHEN event_id%3=0 THEN 1 ELSE 0 END AS source
FROM events LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id<stop"""
)
def stopped_records(spark, sf_dir):
    """A file ends at its first line that is no record."""
    from spindrift.sources.text import CATALOGUES, records

    turn = _id() % 360
    lon = F.when(turn > 180, 180 - turn).otherwise(turn)
    lat = F.when(_id() % 97 == 5, "").otherwise((60 + _id() % 30).cast("string"))
    value = [F.date_format("ts", "M/d/yyyy H:mm"), F.lit(","), lat, F.lit(","), lon.cast("string"), F.when(_id() % 3 == 0, ",GPS").otherwise(",Iridium")]
    return _plain(records(_lines(spark, sf_dir, value), CATALOGUES["crrel"], file="file", carry=("event_id",)))


@query(
    """SELECT event_id, strftime(make_timestamp(2000+event_id%7,1,1,0,0,0.0)+to_days(CAST(dayofyear(ts)-1 AS INTEGER))+to_minutes(CAST(hour(ts)*60+minute(ts) AS BIGINT)),'%Y-%m-%d %H:%M:%S') AS datetime, 70.5::DOUBLE*CASE WHEN event_id%2=0 THEN 1 ELSE -1 END AS lat, CASE WHEN event_id%3=0 THEN 350.0 ELSE 10.0 END::DOUBLE AS lon, 0 AS source
FROM events WHERE user_id%5=3 AND event_id%4=3"""
)
def checked_records(spark, sf_dir):
    """One buoy of a file that has several, at the one quality that is good; the year is in the file's name."""
    from spindrift.sources.text import CATALOGUES, records

    value = [(F.col("user_id") % 5).cast("string"), F.when(_id() % 2 == 0, " 70.5N ").otherwise(" 70.5S "), F.when(_id() % 3 == 0, "10.0W ").otherwise("10.0E "), (_id() % 4).cast("string"), F.lit(" pass-"), F.date_format("ts", "DDD/HHmm")]
    lines = _lines(spark, sf_dir, value, F.concat(F.lit("argos_drift.ori."), (2000 + _id() % 7).cast("string")))
    return _plain(records(lines, CATALOGUES["tara"], file="file", buoy="3", carry=("event_id",)))


@query(
    """WITH e AS (SELECT event_id, event_id%2=0 AS f, event_id%100 AS y, event_id%365+1 AS d, event_id%24 AS h, 60+event_id%31 AS lat, event_id%361-180 AS lon FROM events)
SELECT event_id, strftime(make_timestamp(CASE WHEN y<=25 THEN 2000+y ELSE 1900+y END,1,1,0,0,0.0)+to_days(CAST(d-1 AS INTEGER))+to_hours(CASE WHEN f THEN 12 ELSE 6 END),'%Y-%m-%d %H:%M:%S') AS datetime, CASE WHEN lat=90 THEN -89 ELSE lat END::DOUBLE AS lat, CASE WHEN lon<0 THEN lon+360 ELSE lon END::DOUBLE AS lon, 0 AS source
FROM e WHERE (y<=25 OR y>=60) AND abs(lon)<>180 AND event_id%13<>0"""
)
def iabp_records(spark, sf_dir):
    """Two layouts told apart by the file; impossible years, fields and places are left out."""
    from spindrift.sources.text import iabp

    lat, full = 60 + _id() % 31, _id() % 2 == 0
    lat, lon = F.when(lat == 90, -89).otherwise(lat).cast("string"), (_id() % 361 - 180).cast("string")
    head = F.concat_ws(",", F.lit("300"), (_id() % 100).cast("string"), (_id() % 24).cast("string"))
    day = (_id() % 365 + 1).cast("string")
    long = F.concat_ws(",", head, F.lit("30"), F.concat(day, F.lit(".5")), F.lit("9.9"), lat, lon)
    short = F.concat_ws(",", head, F.concat(day, F.lit(".25")), lat, lon)
    value = [F.when(full, long).otherwise(short), F.when(_id() % 13 == 0, ",1,2,3,4,5").otherwise("")]
    lines = _lines(spark, sf_dir, value, F.when(full, "FULL_RESOLUTION/1.csv").otherwise("3HOUR/1.csv"))
    return _plain(iabp(lines, "file", carry=("event_id",)))


@query(
    """SELECT strftime(TIMESTAMP '2017-04-03 12:30:00'+to_seconds(event_id*600),'%Y-%m-%d %H:%M:%S') AS datetime, (-60-event_id%20)::DOUBLE AS lat, CASE WHEN event_id%350<180 THEN event_id%350 ELSE event_id%350+10 END::DOUBLE AS lon, 0 AS source FROM events WHERE user_id%3=1 AND event_id%7<>0"""
)
def named_buoy_records(spark, sf_dir):
    """One buoy's places of a gridded file, its times counted from the date in the units."""
    from spindrift.sources.text import numbered_times

    turn = _id() % 350
    lat = F.when(_id() % 7 != 0, (-60 - _id() % 20).cast("double"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("string").alias("buoy"), (_id() * 600).alias("time"), lat.alias("lat"), F.when(turn < 180, turn).otherwise(turn - 350).cast("double").alias("lon"))
    got = numbered_times(rows, "seconds since 03 04 2017 12:30 UTC", "1")
    return got.select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "lat", "lon", F.col("source").cast("int").alias("source"))


@query("SELECT strftime(date_trunc('second',ts),'%Y-%m-%d %H:%M:%S') AS datetime, (60+event_id%30)::DOUBLE AS lat, (event_id%360)::DOUBLE AS lon, 1 AS source FROM events")
def written_time_records(spark, sf_dir):
    """Times written with a month's name; the file's comment tells that they are of gps."""
    from spindrift.sources.text import written_times

    turn = _id() % 360
    rows = table(spark, sf_dir, "events").select(F.upper(F.date_format("ts", "dd-MMM-yyyy HH:mm:ss")).alias("time_string"), (60 + _id() % 30).cast("double").alias("latitude"), F.when(turn > 180, turn - 360).otherwise(turn).cast("double").alias("longitude"))
    got = written_times(rows, "buoy positions", "from GPS receivers")
    return got.select(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("datetime"), "lat", "lon", F.col("source").cast("int").alias("source"))
