"""Poses of a stream in a base frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry as G


def in_base_frame(poses: DataFrame, transforms: DataFrame, child: str = "child", t: str = "t") -> DataFrame:
    """ST4, ST5: poses seen from the base, by the latest transform of their frame; without one they stay as they are.

    transforms is a static table (child, t, r00..tz); poses may be a stream. Columns beyond the pose stay.
    """
    latest = transforms.groupBy(F.col(child).alias("_child")).agg(F.max_by(F.struct(*G.NAMES), t).alias("_to"))
    joined = poses.join(latest, F.col(child) == F.col("_child"), "left")
    to = {n: F.coalesce(F.col(f"_to.{n}"), one) for n, one in G.identity().items()}
    seen = G.conjugate(to, G.pose())
    return joined.select(*[seen[c].alias(c) if c in seen else F.col(c) for c in poses.columns])
