"""Filters, voxels and map maintenance over point rows (x, y, z and whatever rides along)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import geometry as G
from cairn.functions import vectors as V


def radius() -> Column:
    return F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))


def range_crop(points: DataFrame, low: float, high: float) -> DataFrame:
    """PR1, PR4: low < distance < high."""
    return points.filter((radius() > low) & (radius() < high))


def square_crop(points: DataFrame, cx: Column, cy: Column, half: float) -> DataFrame:
    """PR6."""
    return points.filter(F.greatest(F.abs(F.col("x") - cx), F.abs(F.col("y") - cy)) < half)


def voxel_key(points: DataFrame, size: float, floor: bool = False) -> DataFrame:
    """VX1 (toward zero, so that cell 0 is twice as wide) or VX10 (floor): columns vx, vy, vz."""
    cut = F.floor if floor else (lambda c: c)
    return points.withColumns({f"v{a}": cut(F.col(a) / size).cast("int") for a in "xyz"})


def voxel_first(points: DataFrame, size: float, *by: str, order: str = "pt_id", floor: bool = False) -> DataFrame:
    """VX2: of each voxel of each group the point with the least order; one aggregation, no sort of voxels."""
    keyed = voxel_key(points, size, floor)
    row = F.struct(order, *[c for c in points.columns if c != order])
    return keyed.groupBy(*by, "vx", "vy", "vz").agg(F.min_by(row, F.col(order)).alias("p")).select("p.*").select(*points.columns)


def voxel_double(points: DataFrame, size: float, *by: str, second: float = 1.5) -> DataFrame:
    """VX3: half a voxel, then 1.5."""
    return voxel_first(voxel_first(points, 0.5 * size, *by), second * size, *by)


def voxel_cap(points: DataFrame, size: float, cap: int, *by: str, order: str = "pt_id") -> DataFrame:
    """VX4: the first `cap` points of each voxel."""
    w = Window.partitionBy(*by, "vx", "vy", "vz").orderBy(order)
    return voxel_key(points, size).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def voxel_evict(points: DataFrame, size: float, far: float, origin: tuple[float, float, float], *by: str, order: str = "pt_id") -> DataFrame:
    """VX5: a voxel goes when its first point is over `far` from the origin."""
    keyed = voxel_key(points, size)
    squared = sum(((F.col(a) - o) * (F.col(a) - o) for a, o in zip("xyz", origin, strict=True)), F.lit(0.0))
    keep = keyed.groupBy(*by, "vx", "vy", "vz").agg(F.min_by(squared, F.col(order)).alias("_d2")).filter(F.col("_d2") <= far * far)
    return keyed.join(keep.drop("_d2"), [*by, "vx", "vy", "vz"], "left_semi")


def voxel_centroid(points: DataFrame, size: float, *by: str) -> DataFrame:
    """VX11: the mean of each cell of a grid that starts half a cell below the least coordinates."""
    least = points.groupBy(*by).agg(*[(F.min(a) - size / 2).alias(f"o{a}") for a in "xyz"])
    cells = points.join(least, list(by)) if by else points.crossJoin(F.broadcast(least))
    cells = cells.withColumns({f"v{a}": F.floor((F.col(a) - F.col(f"o{a}")) / size).cast("int") for a in "xyz"})
    return cells.groupBy(*by, "vx", "vy", "vz").agg(*[F.avg(a).alias(a) for a in "xyz"], F.count("*").alias("n"))


def transformed(points: DataFrame, p: G.Pose) -> DataFrame:
    x, y, z = G.apply(p, F.col("x"), F.col("y"), F.col("z"))
    return points.withColumns({"x": x, "y": y, "z": z})


def map_update(local_map: DataFrame, scan: DataFrame, size: float, cap: int, far: float, origin: tuple[float, float, float], *by: str) -> DataFrame:
    """VX6, VX8: the scan is added behind the map, voxels are capped, far voxels go."""
    both = local_map.select(*scan.columns).unionByName(scan)
    return voxel_evict(voxel_cap(both, size, cap, *by).select(*scan.columns), size, far, origin, *by)


def preprocess(points: DataFrame, low: float, high: float, on: bool = True) -> DataFrame:
    """PR2: the range crop, or the points as they are."""
    return range_crop(points, low, high) if on else points


def settings(high: float, low: float, voxel: float | None = None) -> tuple[float, float, float]:
    """PR18: greatest and least range and voxel size; a least range over the greatest is 0, a voxel size that is not given a hundredth of the range."""
    return high, 0.0 if high < low else low, high / 100 if voxel is None else voxel


def frames_from(frames: DataFrame, order: str, jump: int, n: int | None = None) -> DataFrame:
    """PR19: frames jump to jump + n - 1, or to the end."""
    later = frames.filter(F.col(order) >= jump)
    return later if n is None else later.filter(F.col(order) < jump + n)


def with_colour(points: DataFrame, classes: list[tuple[float, float, float]], far: float = 50.0) -> DataFrame:
    """PR7: points (r, g, b) nearer than far to a class colour, once for each class that they are near to."""
    near = [F.sqrt(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("rgb", colour, strict=True)), F.lit(0.0))) < far for colour in classes]
    hit = F.filter(F.array(*[F.when(x, F.lit(i)) for i, x in enumerate(near)]), lambda i: i.isNotNull())
    return points.withColumn("class", F.explode(hit))


def without_nan(poses: DataFrame, *values: str) -> DataFrame:
    """PR11: rows without a NaN or null among values; what rides along goes with them."""
    keep = F.lit(True)
    for v in values:
        keep = keep & F.col(v).isNotNull() & ~F.isnan(v)
    return poses.filter(keep)


def sampled(points: DataFrame, n: int, seed: int, *by: str) -> DataFrame:
    """VX13: n points of each group at random, all of a smaller one; a seed gives the same ones again."""
    order = F.xxhash64(F.col("pt_id"), F.lit(seed))
    return points.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order, "pt_id"))).filter(F.col("_n") <= n).drop("_n")


def map_build(scans: DataFrame, poses: DataFrame, size: float, scan: str, scene: str, desc: str = "desc") -> DataFrame:
    """VX8: points with a descriptor, thinned in each scan, placed by the scan's pose, thinned in each scene."""
    thin = voxel_first(scans.filter(V.has_positive_sum(F.col(desc))), size, scan)
    placed = transformed(thin.join(poses.select(scan, scene, *G.NAMES), scan), G.pose()).drop(*G.NAMES)
    return voxel_first(placed, size, scene)


def gathered(pixels_of: DataFrame, pixels: DataFrame, points: DataFrame) -> DataFrame:
    """JN19: (pt_id, camera, feature) of points: of the first camera whose image has the pixel; null where none has.

    pixels_of: (pt_id, camera, u, v); pixels: (camera, u, v, feature).
    """
    seen = pixels_of.join(pixels, ["camera", "u", "v"]).groupBy("pt_id").agg(F.min(F.struct("camera", "feature")).alias("m"))
    return points.select("pt_id").join(seen, "pt_id", "left").select("pt_id", "m.camera", "m.feature")


def deskewed(points: DataFrame, start: G.Pose, finish: G.Pose, rel: Column) -> DataFrame:
    """WN8: points moved by the share of the motion between their time (0 to 1) and the middle of the scan.

    The twist and the pose of a point are columns of their own, so that no expression is written out twice.
    """
    out = points.withColumns({f"_v{i}": v for i, v in enumerate(G.log(G.relative(start, finish)))} | {"_rel": rel - 0.5})
    out = out.withColumns({f"_v{i}": F.col("_rel") * F.col(f"_v{i}") for i in range(6)})
    out = out.withColumns({f"_{n}": c for n, c in G.exp([F.col(f"_v{i}") for i in range(6)]).items()})
    return transformed(out, G.pose("_")).select(*points.columns)
