"""Frames in linked lists, depth images, raw scanner and radar rows, inertial tables, and a registry of formats."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.sources import scans


def cut(df: DataFrame) -> DataFrame:
    """df under spark.checkpoint.dir, its lineage cut. A local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="cairn-"))
    return df.checkpoint()


def linked_order(records: DataFrame, token: str = "token", following: str = "next") -> DataFrame:
    """SC12: (token, head, idx): the list that each record is in, by its first record, and its place there from 0.

    Tokens are unique and each is followed by one at most; a null or empty `following`, and one that
    names no record, ends a list. Each round doubles the steps back that a record knows, so that
    a list of n records takes log n joins and none is walked in one task. A ring is an error.
    """
    after = F.col(following)
    before = records.filter(after.isNotNull() & (after.cast("string") != "")).select(after.alias("_token"), F.col(token).alias("_up"))
    nodes = records.select(F.col(token).alias("_token")).join(before, "_token", "left")
    state = cut(nodes.select("_token", F.coalesce("_up", "_token").alias("_jump"), F.col("_up").isNotNull().cast("long").alias("_n")))
    total, steps = state.count(), 1
    while True:
        far = state.select(F.col("_token").alias("_jump"), F.col("_jump").alias("_to"), F.col("_n").alias("_more"))
        state = cut(state.join(far, "_jump").select("_token", F.col("_to").alias("_jump"), (F.col("_n") + F.col("_more")).alias("_n"), (F.col("_more") > 0).alias("_moved")))
        if state.filter("_moved").isEmpty():
            return state.select(F.col("_token").alias(token), F.col("_jump").alias("head"), F.col("_n").alias("idx"))
        steps *= 2
        if steps > 2 * total:
            raise ValueError("records that follow each other in a ring")
        state = state.drop("_moved")


#: Lens of the depth camera in pixels, depth units a metre, and the depth in metres from which there is none (fixed values).
FX = FY = 525.0
CX, CY = 319.5, 239.5
DEPTH_SCALE, DEPTH_END = 5000.0, 4.0


def back_projected(u: Column, v: Column, depth: Column) -> tuple[Column, Column, Column]:
    """SC13: the point that a pixel of a depth image shows; null where depth is not positive or too far."""
    z = depth / DEPTH_SCALE
    z = F.when((z > 0) & (z < DEPTH_END), z)
    return (u - CX) * z / FX, (v - CY) * z / FY, z


def raw_measures(ranges: Column, angles: Column) -> tuple[Column, Column]:
    """SC26: metres and radians from the whole numbers of a raw scanner image."""
    return ranges * 0.002, angles * (2 * math.pi / 36000)


#: Steps of the radar's encoder in a turn (fixed value).
ENCODER = 5600


def _unsigned(data: Column, start: int, size: int) -> Column:
    """Little-endian whole number of `size` bytes from byte `start` (from 1)."""
    digits = [F.hex(F.substr(data, F.lit(start + k), F.lit(1))) for k in reversed(range(size))]
    return F.conv(F.concat(*digits), 16, 10).cast("long")


def radar_rows(rows: DataFrame, data: str = "data") -> DataFrame:
    """SC27: the columns of rows with ts, azimuth (radians), valid and power (0 to 1) in place of the bytes of an azimuth.

    Eight bytes of time, two of azimuth, one that is 255 for a reading of the sensor's own, then a byte a bin.
    A row of eleven bytes has no bins; a shorter one gives nulls.
    """
    b = F.col(data)
    n = F.octet_length(b)
    bins = F.when(n > 11, F.transform(F.sequence(F.lit(12), n), lambda i: F.conv(F.hex(F.substr(b, i, F.lit(1))), 16, 10).cast("double") / 255)).otherwise(F.array().cast("array<double>"))
    whole = n >= 11
    return rows.select(
        *[c for c in rows.columns if c != data],
        F.when(whole, _unsigned(b, 1, 8)).alias("ts"),
        F.when(whole, _unsigned(b, 9, 2) / ENCODER * (2 * math.pi)).alias("azimuth"),
        F.when(whole, _unsigned(b, 11, 1) == 255).alias("valid"),
        F.when(whole, bins).alias("power"),
    )


#: First columns of place and of angles by kind of table; -3: the last three (fixed values).
POSE_TABLES = {"ins": (5, -3), "rtk": (4, 11), "vo": (2, 5)}


def read_pose_table(spark: SparkSession, path: str, kind: str = "ins") -> DataFrame:
    """SC29: (ts, r00..tz) from a table with a header: inertial (ins), corrected (rtk) or steps of visual odometry (vo)."""
    table = spark.read.option("header", "true").csv(path)
    c = [F.col(f"`{n}`") for n in table.columns]
    at, turn = POSE_TABLES[kind]
    turn = turn % len(c)
    place, angles = ([x.cast("double") for x in c[i : i + 3]] for i in (at, turn))
    pose = G.from_euler(*angles) | dict(zip(("tx", "ty", "tz"), place, strict=True))
    return table.select(c[0].cast("long").alias("ts"), *[pose[n].alias(n) for n in G.NAMES])


def sequence_names(paths: DataFrame, part: int, path: str = "path") -> DataFrame:
    """SC23: paths with `sequence`, the part of the path at a place from 0; null if there is none."""
    return paths.withColumn("sequence", F.try_element_at(F.split(path, "/"), F.lit(part + 1)))


@dataclass(frozen=True)
class Format:
    read: Callable[..., DataFrame]
    #: Can a reader start at a later frame; are there sequences in a folder?
    jumpable: bool = True
    sequences: bool = False


#: SC20: readers by name; `register` adds to them.
FORMATS: dict[str, Format] = {}


def register(name: str, read: Callable[..., DataFrame], jumpable: bool = True, sequences: bool = False) -> None:
    FORMATS[name] = Format(read, jumpable, sequences)


for _name in scans.LAYOUTS:
    register(_name, lambda spark, path, _layout=_name: scans.read_scans(spark, path, _layout), sequences=_name in ("kitti", "mulran", "boreas"))


def read(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in FORMATS:
        raise ValueError(f"no format {name}; there are {', '.join(sorted(FORMATS))}")
    return FORMATS[name].read(spark, path)
