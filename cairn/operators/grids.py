"""Cells around a centre, and polar scans laid on a square of pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sphere_voxels(spark: SparkSession, radius: float, radial: int, azimuth: int, elevation: int) -> DataFrame:
    """SE14: (voxel, x, y, z): centres of cells by radius, angle from the pole and azimuth, the last fastest."""
    i = F.col("id")
    a = (F.pmod(i, F.lit(azimuth)) + 0.5) * (2 * math.pi / azimuth)
    b = (F.pmod(F.floor(i / azimuth), F.lit(elevation)) + 0.5) * (math.pi / elevation)
    r = (F.floor(i / (azimuth * elevation)) + 0.5) * (radius / radial)
    return spark.range(radial * azimuth * elevation).select(i.alias("voxel"), (r * F.sin(b) * F.cos(a)).alias("x"), (r * F.sin(b) * F.sin(a)).alias("y"), (r * F.cos(b)).alias("z"))


def polar_to_cartesian(cells: DataFrame, scans: DataFrame, width: int, pixel: float, resolution: float) -> DataFrame:
    """SE22: (scan, i, j, power): each scan on width times width pixels, bilinear between its cells.

    cells are (scan, row, bin, power), scans (scan, first, step, n): azimuth of row 0, step between
    rows and their number. Past the last row comes the first; a cell that is not there has no power;
    nearer than half a bin counts as bin 0. A pixel meets four cells by an equi-join on scan, row and bin.
    """
    half = (width - 1) / 2 * pixel
    grid = scans.select("*", F.explode(F.sequence(F.lit(0), F.lit(width * width - 1))).alias("_p"))
    i, j = F.floor(F.col("_p") / width).cast("int"), (F.col("_p") % width).cast("int")
    x, y = half - i * pixel, j * pixel - half
    angle = F.atan2(y, x)
    angle = F.when(angle < 0, angle + 2 * math.pi).otherwise(angle)
    u = F.greatest((F.sqrt(x * x + y * y) - resolution / 2) / resolution, F.lit(0.0))
    at = grid.select("scan", "n", i.alias("i"), j.alias("j"), u.alias("u"), ((angle - F.col("first")) / F.col("step")).alias("v"))
    u0, v0 = F.floor("u"), F.floor("v")
    du, dv = F.col("u") - u0, F.col("v") - v0
    corners = F.array(*[F.struct((v0 + b).alias("row"), (u0 + a).alias("bin"), ((du if a else 1 - du) * (dv if b else 1 - dv)).alias("w")) for a in (0, 1) for b in (0, 1)])
    near = at.select("scan", "n", "i", "j", F.explode(corners).alias("c")).select("scan", "i", "j", "n", "c.*").filter("row BETWEEN -1 AND n")
    near = near.select("scan", "i", "j", F.pmod("row", "n").alias("row"), "bin", "w")
    found = near.join(cells.select("scan", F.col("row").cast("long").alias("row"), F.col("bin").cast("long").alias("bin"), "power"), ["scan", "row", "bin"], "left")
    return found.groupBy("scan", "i", "j").agg(F.coalesce(F.sum(F.col("w") * F.col("power")), F.lit(0.0)).alias("power"))
