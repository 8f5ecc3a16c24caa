"""Views of the driver's tables in the terms of the engine, as DataFrames and as CTE text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.runtime import table

FIX = """fix AS (SELECT user_id AS traj_id, event_id AS rec_id, ts, 60 + CAST(event_id % 3000 AS DOUBLE) / 100 AS lat,
 -180 + CAST(event_id * 7 % 36000 AS DOUBLE) / 100 AS lon,
 CASE event_type WHEN 'click' THEN 'gps' WHEN 'view' THEN 'argos' WHEN 'purchase' THEN 'wsm' WHEN 'signup' THEN 'irid' ELSE 'gcp' END AS source
 FROM events)"""
VEC = """vec AS (SELECT l_partkey AS cell, l_partkey % 50 AS x, l_partkey // 50 AS y, l_linenumber AS sensor, l_orderkey AS obs,
 l_quantity - 25 AS dx, l_tax * 100 - 4 AS dy, 1 + l_discount * 10 AS sigma, CAST(l_suppkey % 23 AS INTEGER) AS flag, l_shipdate AS t0 FROM lineitem)"""
WIND = """wind AS (SELECT l_suppkey AS cell, l_quantity AS u, l_discount * 100 AS v, l_extendedprice / 1000 AS iu, l_tax * 100 AS iv, l_shipdate AS t0 FROM lineitem)"""
PX = """px AS (SELECT vec_id AS image, p % 8 AS x, p // 8 AS y, CAST(embedding[p + 1] AS DOUBLE) AS v
 FROM (SELECT vec_id, embedding, unnest(range(64)) AS p FROM embeddings))"""
DAY = """day AS (SELECT o_orderkey AS rec_id, o_orderdate AS d, CASE WHEN o_custkey % 2 = 0 THEN 'nh' ELSE 'sh' END AS area, o_orderpriority AS priority, o_totalprice AS price FROM orders)"""


def fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory records: one buoy for each user."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("traj_id"),
        F.col("event_id").alias("rec_id"),
        "ts",
        (60 + (F.col("event_id") % 3000).cast("double") / 100).alias("lat"),
        (-180 + (F.col("event_id") * 7 % 36000).cast("double") / 100).alias("lon"),
        F.when(kind == "click", "gps").when(kind == "view", "argos").when(kind == "purchase", "wsm").when(kind == "signup", "irid").otherwise("gcp").alias("source"),
    )


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacement vectors of seven sensors on a 50-column grid."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("cell"),
        (F.col("l_partkey") % 50).alias("x"),
        F.expr("l_partkey div 50").alias("y"),
        F.col("l_linenumber").alias("sensor"),
        F.col("l_orderkey").alias("obs"),
        (F.col("l_quantity") - 25).alias("dx"),
        (F.col("l_tax") * 100 - 4).alias("dy"),
        (1 + F.col("l_discount") * 10).alias("sigma"),
        (F.col("l_suppkey") % 23).cast("int").alias("flag"),
        F.col("l_shipdate").alias("t0"),
    )


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of wind (u, v) and drift (iu, iv) by cell."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cell"),
        F.col("l_quantity").alias("u"),
        (F.col("l_discount") * 100).alias("v"),
        (F.col("l_extendedprice") / 1000).alias("iu"),
        (F.col("l_tax") * 100).alias("iv"),
        F.col("l_shipdate").alias("t0"),
    )


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of 8 x 8 images."""
    pixels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("p", "e"))
    return pixels.select("image", (F.col("p") % 8).cast("bigint").alias("x"), F.expr("p div 8").alias("y"), F.col("e").cast("double").alias("v"))


def day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated records of two hemispheres."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rec_id"),
        F.col("o_orderdate").alias("d"),
        F.when(F.col("o_custkey") % 2 == 0, "nh").otherwise("sh").alias("area"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
    )


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(names) + "\n"
