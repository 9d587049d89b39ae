"""Nearest-timestamp joins, brackets and windows over sequences.

As-of joins are a union and two windows over (key, time): n log n, and no pair of rows of the two
sides is formed. Times are BIGINT.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import geometry as G


def _around(queries: DataFrame, samples: DataFrame, key: str, strict_next: bool) -> DataFrame:
    """queries (key, q, t) with the sample times before (<= t) and after (>= t, or > t): lo and hi, null where there is none."""
    q = queries.select(key, "t", F.lit(1).alias("kind"), "q")
    s = samples.select(key, "t", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("q")).distinct()
    both = q.unionByName(s)
    value = F.when(F.col("kind") == 0, F.col("t"))
    before = Window.partitionBy(key).orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(F.desc("t"), F.asc("kind") if not strict_next else F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("lo", F.last(value, ignorenulls=True).over(before)).withColumn("hi", F.last(value, ignorenulls=True).over(after))
    return both.filter("kind = 1").drop("kind")


def nearest(queries: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """AS1, AS2, AS4: the nearest sample time for each query, the earlier of two as near; null without samples."""
    found = _around(queries, samples, key, strict_next=False)
    pick = F.when(F.col("hi").isNull() | (F.col("t") - F.col("lo") <= F.col("hi") - F.col("t")), F.col("lo")).otherwise(F.col("hi"))
    return found.select(key, "q", "t", pick.alias("nearest"))


def bracket(queries: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """AS3: the last sample time <= t and the first > t."""
    return _around(queries, samples, key, strict_next=True)


def interpolate(queries: DataFrame, samples: DataFrame, key: str, value: str) -> DataFrame:
    """AS5, the linear part of SE7: value at each query time between its bracket; queries outside go."""
    found = bracket(queries, samples, key).filter("lo IS NOT NULL AND hi IS NOT NULL")
    low = samples.select(key, F.col("t").alias("lo"), F.col(value).alias("v0"))
    high = samples.select(key, F.col("t").alias("hi"), F.col(value).alias("v1"))
    share = (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return found.join(low, [key, "lo"]).join(high, [key, "hi"]).select(key, "q", "t", (F.col("v0") + share * (F.col("v1") - F.col("v0"))).alias("value"))


def slerp(a: tuple[Column, ...], b: tuple[Column, ...], share: Column) -> tuple[Column, ...]:
    """SE7: quaternions a to b on the shorter way."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    sign = F.when(dot < 0, -1.0).otherwise(1.0)
    cos = F.least(F.abs(dot), F.lit(1.0))
    theta = F.acos(cos)
    linear = cos >= 1 - 1e-12
    s = F.nullif(F.sin(theta), F.lit(0.0))
    w0 = F.when(linear, 1 - share).otherwise(F.sin((1 - share) * theta) / s)
    w1 = sign * F.when(linear, share).otherwise(F.sin(share * theta) / s)
    return tuple(w0 * x + w1 * y for x, y in zip(a, b, strict=True))


def interpolate_poses(queries: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """SE7, AS5: place and quaternion at each query time (key, q, t), between the samples (key, t, tx, ty, tz, qw, qx, qy, qz) around it; queries outside go."""
    names = ("tx", "ty", "tz", "qw", "qx", "qy", "qz")
    found = bracket(queries, samples, key).filter("lo IS NOT NULL AND hi IS NOT NULL")
    low = samples.select(key, F.col("t").alias("lo"), *[F.col(c).alias(f"a_{c}") for c in names])
    high = samples.select(key, F.col("t").alias("hi"), *[F.col(c).alias(f"b_{c}") for c in names])
    share = (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    both = found.join(low, [key, "lo"]).join(high, [key, "hi"])
    place = [(F.col(f"a_{c}") + share * (F.col(f"b_{c}") - F.col(f"a_{c}"))).alias(c) for c in names[:3]]
    turn = slerp(tuple(F.col(f"a_{c}") for c in names[3:]), tuple(F.col(f"b_{c}") for c in names[3:]), share)
    return both.select(key, "q", "t", *place, *[c.alias(n) for n, c in zip(names[3:], turn, strict=True)])


def pose_of_quaternion(w: Column, x: Column, y: Column, z: Column) -> G.Pose:
    """The rotation of a unit quaternion."""
    return G.identity() | {
        "r00": 1 - 2 * (y * y + z * z), "r01": 2 * (x * y - w * z), "r02": 2 * (x * z + w * y),
        "r10": 2 * (x * y + w * z), "r11": 1 - 2 * (x * x + z * z), "r12": 2 * (y * z - w * x),
        "r20": 2 * (x * z - w * y), "r21": 2 * (y * z + w * x), "r22": 1 - 2 * (x * x + y * y),
    }


def build_cloud(scans: DataFrame, samples: DataFrame, key: str, low: int, high: int, extrinsics: G.Pose) -> DataFrame:
    """AS6: points of the scans (key, q, t, x, y, z) of low <= t <= high, placed by the pose at their time and the sensor's place on the vehicle.

    Scans outside the samples are left out, as are times without a scan. AS7 is its relative form, AS8 its projection.
    """
    inside_window = scans.filter(F.col("t").between(low, high))
    at = interpolate_poses(inside_window.select(key, "q", "t").distinct(), samples, key).withColumnsRenamed({c: f"p_{c}" for c in ("tx", "ty", "tz", "qw", "qx", "qy", "qz")})
    joined = inside_window.join(at, [key, "q", "t"])
    pose = pose_of_quaternion(*[F.col(f"p_q{c}") for c in "wxyz"]) | {f"t{c}": F.col(f"p_t{c}") for c in "xyz"}
    x, y, z = G.apply(G.compose(pose, extrinsics), F.col("x"), F.col("y"), F.col("z"))
    return joined.select(key, "q", "t", x.alias("x"), y.alias("y"), z.alias("z"))


def accumulated(steps: DataFrame, key: str, order: str) -> DataFrame:
    """AG13: the product of the relative poses up to each row, for each key, in order.

    Products do not commute, so that a sequence goes through one task, row by row; memory holds one batch.
    """
    kind = steps.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = None, np.eye(4)
        for f in frames:
            out = np.empty((len(f), 12))
            flat = f[list(G.NAMES)].to_numpy(np.float64)
            for i, k in enumerate(f[key].tolist()):
                step = np.eye(4)
                step[:3, :3], step[:3, 3] = flat[i, :9].reshape(3, 3), flat[i, 9:]
                now = step if k != last else now @ step
                last = k
                out[i] = [*now[:3, :3].ravel(), *now[:3, 3]]
            yield pd.DataFrame({key: f[key].to_numpy(), order: f[order].to_numpy()} | dict(zip(G.NAMES, out.T, strict=True)))

    rows = steps.select(key, F.col(order).cast("long").alias(order), *G.NAMES).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInPandas(run, f"{key} {kind}, {order} long, " + ", ".join(f"{c} double" for c in G.NAMES))


def stride(rows: DataFrame, key: str, order: str, step: int) -> DataFrame:
    """SC30: every step-th row, from the first."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") % step == 0).drop("_n")


def relative_time(rows: DataFrame, key: str, t: str) -> DataFrame:
    """WN6: seconds since the first row of a sequence, from microseconds."""
    return rows.withColumn("rel_s", (F.col(t) - F.min(t).over(Window.partitionBy(key))) / 1e6)


def frame_time(rows: DataFrame, key: str, t: str) -> DataFrame:
    """WN7, AG19: time within a frame as 0 to 1; 0 in a frame of one time."""
    w = Window.partitionBy(key)
    low, high = F.min(t).over(w), F.max(t).over(w)
    return rows.withColumn("rel", F.when(high > low, (F.col(t) - low) / (high - low)).otherwise(0.0))


def inside(rows: DataFrame, span: DataFrame, key: str, t: str, strict: bool) -> DataFrame:
    """PR9 (strict), PR10, PR17: rows within the least and largest time of span."""
    ends = span.groupBy(key).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    hit = (F.col(t) > F.col("_a")) & (F.col(t) < F.col("_b")) if strict else F.col(t).between(F.col("_a"), F.col("_b"))
    return rows.join(ends, key).filter(hit).drop("_a", "_b")
