"""Random numbers that a row's key and a seed decide, so that a task that runs again gives the same ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry as G

#: Spread of a perturbed pose: metres along x, y, z and degrees about them (fixed values).
SHIFT, TURN = (10.0, 10.0, 1.0), (2.0, 2.0, 10.0)


def uniform(seed: int, draw: int, *keys: Column) -> Column:
    """Above 0 and below 1."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed), F.lit(draw)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, draw: int, *keys: Column) -> Column:
    """Mean 0, variance 1; each draw has its own number."""
    return F.sqrt(-2 * F.log(uniform(seed, 2 * draw, *keys))) * F.cos(2 * math.pi * uniform(seed, 2 * draw + 1, *keys))


def jittered(points: DataFrame, sigma: float, seed: int = 0, key: str = "pt_id") -> DataFrame:
    """SE20: each coordinate moved on its own; null coordinates stay null."""
    return points.withColumns({c: F.col(c) + sigma * normal(seed, k, F.col(key)) for k, c in enumerate("xyz")})


def random_pose(seed: int, turn: float, shift: float, *keys: Column) -> G.Pose:
    """SE20: a pose for each key, with angles in 0 to `turn` and places in -shift to shift."""
    out = G.from_euler(*[turn * uniform(seed, k, *keys) for k in range(3)])
    return out | {t: shift * (2 * uniform(seed, 3 + k, *keys) - 1) for k, t in enumerate(("tx", "ty", "tz"))}


def perturbed(p: G.Pose, seed: int, *keys: Column, shift: tuple = SHIFT, turn: tuple = TURN) -> G.Pose:
    """SE21: a pose with noise on its place and on its angles."""
    angles = [a + math.radians(s) * normal(seed, 3 + k, *keys) for k, (a, s) in enumerate(zip(G.to_euler(p), turn, strict=True))]
    return G.from_euler(*angles) | {t: p[t] + s * normal(seed, k, *keys) for k, (t, s) in enumerate(zip(("tx", "ty", "tz"), shift, strict=True))}
