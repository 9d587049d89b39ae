"""The driver's tables read as points, descriptors, trajectories, poses and error logs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import geometry as G


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as scans: 50 frames; ids from the columns, without a sort over all rows."""
    mixed = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.round(F.col("l_extendedprice") * 100).cast("long")) % 1000000000
    return table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000000 + mixed).alias("pt_id"),
        (F.col("l_orderkey") % 50).alias("frame_id"),
        (F.col("l_quantity") - 25).alias("x"),
        (F.col("l_extendedprice") / 1000 - 50).alias("y"),
        ((F.col("l_discount") - 0.05) * 100).alias("z"),
    )


POINTS = """p AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + (l_partkey * 7919 + l_suppkey * 104729 + CAST(round(l_extendedprice * 100) AS BIGINT)) % 1000000000 AS pt_id,
  l_orderkey % 50 AS frame_id, l_quantity - 25 AS x, l_extendedprice / 1000 - 50 AS y, (l_discount - 0.05) * 100 AS z FROM lineitem)"""


def pairs_of_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even frames and the odd frames after them, by `pair`."""
    p = points(spark, sf_dir).withColumn("pair", F.floor(F.col("frame_id") / 2))
    return p.filter("frame_id % 2 = 0"), p.filter("frame_id % 2 = 1")


PAIRS = f"""{POINTS}, s AS (SELECT *, CAST(floor(frame_id / 2) AS BIGINT) AS pair FROM p WHERE frame_id % 2 = 0), t AS (SELECT *, CAST(floor(frame_id / 2) AS BIGINT) AS pair FROM p WHERE frame_id % 2 = 1)"""


def descriptors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even and odd vectors of embeddings as (id, v)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return e.filter("id % 2 = 0"), e.filter("id % 2 = 1")


DESCRIPTORS = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), a AS (SELECT * FROM e WHERE id % 2 = 0), b AS (SELECT * FROM e WHERE id % 2 = 1), ab AS (SELECT a.id AS src_id, b.id AS tgt_id, list_inner_product(a.v, b.v) AS sim, b.label FROM a, b)"


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as poses: a turn about z and a place."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.pmod("o_totalprice", F.lit(6.28)).alias("yaw"), (F.col("o_custkey") % 100).cast("double").alias("tx"), (F.col("o_orderkey") % 100).cast("double").alias("ty"), F.lit(0.0).alias("tz")
    )


POSES = "o AS (SELECT o_orderkey, o_totalprice % 6.28e0 AS yaw, CAST(o_custkey % 100 AS DOUBLE) AS tx, CAST(o_orderkey % 100 AS DOUBLE) AS ty FROM orders)"


def pose_of(df: DataFrame) -> G.Pose:
    zero = F.lit(0.0)
    return G.from_euler(zero, zero, df["yaw"]) | {c: df[c] for c in ("tx", "ty", "tz")}


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a trajectory for each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("seq_id"),
        (F.row_number().over(w) - 1).cast("long").alias("idx"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        (F.col("value") * F.cos(F.col("event_id").cast("double"))).alias("tx"),
        (F.col("value") * F.sin(F.col("event_id").cast("double"))).alias("ty"),
        F.lit(0.0).alias("tz"),
        "value",
        "event_type",
        "event_id",
    )


TRAJECTORIES = "tr AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) AS t, value * cos(CAST(event_id AS DOUBLE)) AS tx, value * sin(CAST(event_id AS DOUBLE)) AS ty, value, event_type, event_id FROM events)"


def turning(trajectory: DataFrame, rate: float, start: float) -> DataFrame:
    """(seq_id, idx, pose) of a trajectory that turns about z by rate at each step."""
    pose = G.from_euler(F.lit(0.0), F.lit(0.0), F.col("idx") * rate + start) | {c: F.col(c) for c in ("tx", "ty", "tz")}
    return trajectory.select("seq_id", "idx", *[c.alias(n) for n, c in pose.items()])


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as an error log."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("scene"), (F.col("l_discount") * 10).alias("rte"), (F.col("l_tax") * 100).alias("rre"))


ERRORS = "er AS (SELECT l_returnflag AS method, l_linestatus AS scene, l_discount * 10 AS rte, l_tax * 100 AS rre FROM lineitem)"


def r6(c: Column) -> Column:
    """Six decimals, by the same steps in both engines."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def s6(e: str) -> str:
    return f"floor(({e}) * 1e6 + 0.5e0) / 1e6"


DEGREE = math.pi / 180
