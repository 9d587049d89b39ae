"""Readers and writers of laser scans and their metadata.

Binary scans are read with Spark's binaryFile source and decoded a file at a time; what comes out
is a point table that is best written to Parquet once, since filters don't push below a decoder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """How the numbers of a scan file lie; the first three of a point are x, y, z."""

    dtype: str
    width: int
    by_column: bool = False
    scale: float = 1.0
    shift: float = 0.0
    intensity: int | None = None
    flip: bool = False


#: Formats by name (fixed values).
LAYOUTS = {
    "nclt": Layout("<i2", 4, scale=0.005, shift=-100.0),
    "nclt_flipped": Layout("<i2", 4, scale=0.005, shift=-100.0, flip=True),
    "robotcar": Layout("<f4", 4, by_column=True, intensity=3),
    "kitti": Layout("<f4", 4, intensity=3),
    "mulran": Layout("<f4", 4, intensity=3),
    "boreas": Layout("<f4", 6),
    "segmented": Layout("<f4", 36),
}

POINTS = "path string, pt_id long, x double, y double, z double, intensity double"


def decode(content: bytes, layout: Layout) -> pd.DataFrame:
    raw = np.frombuffer(content, layout.dtype)
    raw = raw[: len(raw) // layout.width * layout.width]
    rows = raw.reshape(layout.width, -1).T if layout.by_column else raw.reshape(-1, layout.width)
    p = rows[:, :3].astype(np.float64) * layout.scale + layout.shift
    if layout.flip:
        p[:, 1:] = -p[:, 1:]
    extra = rows[:, layout.intensity].astype(np.float64) if layout.intensity is not None else np.full(len(p), np.nan)
    return pd.DataFrame({"pt_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "intensity": extra})


def read_scans(spark: SparkSession, path: str, layout: str | Layout, glob: str = "*.bin") -> DataFrame:
    """SC1-SC9, SC25: points of all files below a path; intensity is null where the format has none."""
    how = LAYOUTS[layout] if isinstance(layout, str) else layout
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                out = decode(content, how)
                out.insert(0, "path", name)
                yield out

    return files.select("path", "content").mapInPandas(run, POINTS)


#: Number formats of the fields of a self-describing point message, by code (fixed values).
FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}


def decode_message(data: bytes, fields: list[tuple[str, int, int, int]], step: int, big_endian: bool = False, names: list[str] | None = None) -> pd.DataFrame:
    """SC17: columns of a packed message with fields of (name, offset, type, count); a field of several is name_0, name_1..."""
    order = ">" if big_endian else "<"
    spec: dict[str, list] = {"names": [], "formats": [], "offsets": []}
    for name, offset, kind, count in fields:
        size = np.dtype(FIELD_TYPES[kind]).itemsize
        for k in range(max(1, count)):
            label = name if count <= 1 else f"{name}_{k}"
            if names is None or name in names:
                spec["names"].append(label)
                spec["formats"].append(order + FIELD_TYPES[kind])
                spec["offsets"].append(offset + k * size)
    rows = np.frombuffer(data[: len(data) // step * step], np.dtype(spec | {"itemsize": step}))
    return pd.DataFrame({n: rows[n].astype(rows[n].dtype.newbyteorder("=")) for n in spec["names"]})


def synthetic_time(points: DataFrame, columns: int = 1024, rows: int = 64) -> DataFrame:
    """SC7, SC8: time of a point from its place in the sweep; 1 in a scan of another size."""
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy("path"))
    return points.withColumn("rel", F.when(n == columns * rows, F.floor(F.col("pt_id") / rows) / columns).otherwise(1.0))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """SC5: (idx, r00..r22, tx, ty, tz) from lines of twelve numbers; one file."""
    names = [f"{'r' if j < 3 else 't'}{i}{j}" if j < 3 else f"t{'xyz'[i]}" for i in range(3) for j in range(4)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                m = np.array([[float(v) for v in line.split()] for line in content.decode().splitlines() if line.strip()]).reshape(-1, 12)
                yield pd.DataFrame({"idx": np.arange(len(m))} | {n: m[:, k] for k, n in enumerate(names)})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "idx long, " + ", ".join(f"{n} double" for n in names))


def pose_lines(poses: DataFrame, order: str = "idx") -> DataFrame:
    """SK2: (order, value): the twelve numbers of each pose in one line."""
    names = [x for i in range(3) for x in (f"r{i}0", f"r{i}1", f"r{i}2", "t" + "xyz"[i])]
    # Plus zero: no sign before a zero.
    return poses.select(order, F.concat_ws(" ", *[F.format_string("%.6e", F.col(n) + F.lit(0.0)) for n in names]).alias("value"))


def stamped_lines(poses: DataFrame, t: str = "t") -> DataFrame:
    """SK3: (t, value): time, translation and quaternion (x, y, z, w), four decimals."""
    from cairn.functions import geometry as G

    w, x, y, z = G.quaternion(G.pose())
    return poses.select(t, F.concat_ws(" ", *[F.format_string("%.4f", c.cast("double") + F.lit(0.0)) for c in (F.col(t), F.col("tx"), F.col("ty"), F.col("tz"), x, y, z, w)]).alias("value"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """SC24: (name, vals) from lines of `key: numbers`."""
    lines = spark.read.text(path).filter(F.col("value").contains(":"))
    numbers = F.filter(F.split(F.trim(F.substring_index("value", ":", -1)), r"\s+"), lambda v: v != "")
    return lines.select(F.trim(F.substring_index("value", ":", 1)).alias("name"), F.transform(numbers, lambda v: v.try_cast("double")).alias("vals"))


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """SC30: the first column as ts."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].cast("long").alias("ts"))


#: Fields of a packet of the inertial unit, in order; the last five are whole numbers (fixed values).
PACKET = (
    "lat", "lon", "alt", "roll", "pitch", "yaw", "vn", "ve", "vf", "vl", "vu", "ax", "ay", "az", "af", "al", "au", "wx", "wy", "wz", "wf", "wl", "wu",
    "pos_accuracy", "vel_accuracy", "navstat", "numsats", "posmode", "velmode", "orimode",
)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """SC28."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(*[parts[i].cast("double" if i < 25 else "int").alias(n) for i, n in enumerate(PACKET)])


def guess_layout(path: str) -> str | None:
    """SC21: a format from a path; null if none is named in it."""
    low = path.lower()
    return next((name for name in LAYOUTS if name in low), None)


def write_scene(points: DataFrame, path: str) -> None:
    """SK1: scenes by scene_id and role; rows without a pose stay out."""
    points.filter(F.col("pose").isNotNull()).write.partitionBy("scene_id", "role").parquet(path)


def read_scene(spark: SparkSession, path: str) -> DataFrame:
    """SC22: partition filters on scene_id and role prune files."""
    return spark.read.parquet(path)
