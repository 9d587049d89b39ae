"""Rigid-body geometry as Column expressions.

A pose is twelve columns r00 to r22, tx, ty, tz (row-major rotation, then translation); helpers
take and give a dict of Columns, so that all of it stays in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = range(3)
NAMES = [f"r{i}{j}" for i in AXES for j in AXES] + ["tx", "ty", "tz"]
Pose = dict[str, Column]


def pose(prefix: str = "") -> Pose:
    return {n: F.col(prefix + n) for n in NAMES}


def identity() -> Pose:
    return {n: F.lit(1.0 if n in ("r00", "r11", "r22") else 0.0) for n in NAMES}


def apply(p: Pose, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """SE1: the pose applied to a point."""
    return tuple(p[f"r{i}0"] * x + p[f"r{i}1"] * y + p[f"r{i}2"] * z + p["t" + "xyz"[i]] for i in AXES)


def compose(a: Pose, b: Pose) -> Pose:
    """SE2: a * b."""
    out = {f"r{i}{j}": a[f"r{i}0"] * b[f"r0{j}"] + a[f"r{i}1"] * b[f"r1{j}"] + a[f"r{i}2"] * b[f"r2{j}"] for i in AXES for j in AXES}
    return out | dict(zip(("tx", "ty", "tz"), apply(a, b["tx"], b["ty"], b["tz"]), strict=True))


def inverse(a: Pose) -> Pose:
    out = {f"r{i}{j}": a[f"r{j}{i}"] for i in AXES for j in AXES}
    return out | {"t" + "xyz"[i]: -(a[f"r0{i}"] * a["tx"] + a[f"r1{i}"] * a["ty"] + a[f"r2{i}"] * a["tz"]) for i in AXES}


def relative(a: Pose, b: Pose) -> Pose:
    """inverse(a) * b."""
    return compose(inverse(a), b)


def conjugate(c: Pose, p: Pose) -> Pose:
    """SE19, ST5: c * p * inverse(c)."""
    return compose(compose(c, p), inverse(c))


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Pose:
    """SE4, SE6: Rz(yaw) Ry(pitch) Rx(roll), without translation."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return identity() | {
        "r00": cy * cp, "r01": cy * sp * sr - sy * cr, "r02": cy * sp * cr + sy * sr,
        "r10": sy * cp, "r11": sy * sp * sr + cy * cr, "r12": sy * sp * cr - cy * sr,
        "r20": -sp, "r21": cp * sr, "r22": cp * cr,
    }


def to_euler(p: Pose) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw; at the poles roll takes the whole turn and yaw is 0."""
    flat = F.sqrt(p["r00"] * p["r00"] + p["r10"] * p["r10"])
    pole = flat < 1e-9
    roll = F.when(pole, F.atan2(-p["r12"], p["r11"])).otherwise(F.atan2(p["r21"], p["r22"]))
    return roll, F.atan2(-p["r20"], flat), F.when(pole, 0.0).otherwise(F.atan2(p["r10"], p["r00"]))


def quaternion(p: Pose) -> tuple[Column, Column, Column, Column]:
    """SE5: w, x, y, z; the largest component is positive and taken from the diagonal, the first of equals."""
    d = [p["r00"], p["r11"], p["r22"]]
    square = [1 + d[0] + d[1] + d[2], 1 + d[0] - d[1] - d[2], 1 - d[0] + d[1] - d[2], 1 - d[0] - d[1] + d[2]]
    cross = {
        (0, 1): p["r21"] - p["r12"], (0, 2): p["r02"] - p["r20"], (0, 3): p["r10"] - p["r01"],
        (1, 2): p["r10"] + p["r01"], (1, 3): p["r02"] + p["r20"], (2, 3): p["r21"] + p["r12"],
    }
    best = F.greatest(*square)

    def part(i: int) -> Column:
        out = None
        for k in range(4):
            half = F.sqrt(square[k])
            value = half / 2 if i == k else cross[min(i, k), max(i, k)] / (2 * half)
            out = F.when(square[k] == best, value) if out is None else out.when(square[k] == best, value)
        return out

    return part(0), part(1), part(2), part(3)


def rotation_degrees(a: Pose, b: Pose) -> Column:
    """SE8: angle between two rotations, the cosine clamped."""
    trace = sum((a[f"r{i}{j}"] * b[f"r{i}{j}"] for i in AXES for j in AXES), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.least((trace - 1) / 2, F.lit(1.0)), F.lit(-1.0))))


def angle(p: Pose) -> Column:
    """Angle of a rotation in radians, the cosine clamped."""
    return F.acos(F.greatest(F.least((p["r00"] + p["r11"] + p["r22"] - 1) / 2, F.lit(1.0)), F.lit(-1.0)))


def components(p: Pose) -> list[Column]:
    """SE6: x, y, z, roll, pitch, yaw of a pose."""
    return [p["tx"], p["ty"], p["tz"], *to_euler(p)]


def distance(a: Pose, b: Pose) -> Column:
    return F.sqrt(sum(((a[t] - b[t]) * (a[t] - b[t]) for t in ("tx", "ty", "tz")), F.lit(0.0)))


def model_error(p: Pose, max_range: float) -> Column:
    """SE10: how far a deviation moves a point at most, in translation and by its angle at max_range."""
    return distance(identity(), p) + 2 * max_range * F.sin(F.radians(rotation_degrees(identity(), p)) / 2)


def exp(v: list[Column]) -> Pose:
    """SE3: pose of a twist, translation first.

    Sine and cosine are used as they are, not as 1 less a multiple of the squared angle: a turn about
    an axis then has the very bits of its closed form, and nothing cancels on the diagonal.
    """
    rho, w = v[:3], v[3:]
    t2 = w[0] * w[0] + w[1] * w[1] + w[2] * w[2]
    t = F.sqrt(t2)
    none, small = t == 0, t < 1e-6
    u = F.when(none, 1.0).otherwise(t)
    sin = F.when(none, 1.0).otherwise(F.sin(t))
    rest = F.when(small, t2 / 2).otherwise(1 - F.cos(t))
    c = F.when(small, F.lit(1 / 6) - t2 / 120).otherwise((t - F.sin(t)) / F.nullif(t2 * t, F.lit(0.0)))
    n = [x / u for x in w]
    hat = [[F.lit(0.0), -n[2], n[1]], [n[2], F.lit(0.0), -n[0]], [-n[1], n[0], F.lit(0.0)]]
    cross = [n[1] * rho[2] - n[2] * rho[1], n[2] * rho[0] - n[0] * rho[2], n[0] * rho[1] - n[1] * rho[0]]
    along = c * (w[0] * rho[0] + w[1] * rho[1] + w[2] * rho[2])
    out = {f"r{i}{j}": (F.cos(t) if i == j else F.lit(0.0)) + sin * hat[i][j] + rest * (n[i] * n[j]) for i in AXES for j in AXES}
    return out | {"t" + "xyz"[i]: (sin * rho[i] + rest * cross[i]) / u + along * w[i] for i in AXES}


def log(p: Pose) -> list[Column]:
    """SE3: twist of a pose whose angle is below half a turn, translation first."""
    cos = F.greatest(F.least((p["r00"] + p["r11"] + p["r22"] - 1) / 2, F.lit(1.0)), F.lit(-1.0))
    t = F.acos(cos)
    small = t < 1e-6
    k = F.when(small, 0.5 + t * t / 12).otherwise(t / F.nullif(2 * F.sin(t), F.lit(0.0)))
    w = [k * (p["r21"] - p["r12"]), k * (p["r02"] - p["r20"]), k * (p["r10"] - p["r01"])]
    d = F.when(small, F.lit(1 / 12)).otherwise((1 - t * F.sin(t) / F.nullif(2 * (1 - cos), F.lit(0.0))) / F.nullif(t * t, F.lit(0.0)))
    x = [p["tx"], p["ty"], p["tz"]]
    wx = [w[1] * x[2] - w[2] * x[1], w[2] * x[0] - w[0] * x[2], w[0] * x[1] - w[1] * x[0]]
    wwx = [w[1] * wx[2] - w[2] * wx[1], w[2] * wx[0] - w[0] * wx[2], w[0] * wx[1] - w[1] * wx[0]]
    return [x[i] - 0.5 * wx[i] + d * wwx[i] for i in AXES] + w


def deskew(start: Pose, finish: Pose, rel: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """WN8: a point moved by the share of the motion that lies between its time and the middle of the scan."""
    return apply(exp([(rel - 0.5) * v for v in log(relative(start, finish))]), x, y, z)


def tilt(x: Column, y: Column, z: Column, degrees: float) -> tuple[Column, Column, Column]:
    """PR5: a point turned about the axis p x (0, 0, 1); one on that axis stays."""
    flat = F.nullif(F.sqrt(x * x + y * y), F.lit(0.0))
    ux, uy = y / flat, -x / flat
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    # Rodrigues for a unit axis (ux, uy, 0) that is normal to p.
    nx, ny, nz = x * c + uy * z * s, y * c - ux * z * s, z * c + (ux * y - uy * x) * s
    return F.coalesce(nx, x), F.coalesce(ny, y), F.coalesce(nz, z)


def pinhole(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column]:
    """SE11-13: column and row of the pixel, truncated; null behind the camera."""
    depth = F.when(z > 0, z)
    return (fx * x / depth + cx).cast("int"), (fy * y / depth + cy).cast("int")


def in_image(u: Column, v: Column, width: int, height: int) -> Column:
    """SE12: a pixel inside the image; those on the far edges are outside."""
    return (u >= 0) & (u < width) & (v >= 0) & (v < height)


def from_ranges(r: Column, azimuth: Column, elevation: Column, base: float = 0.090805) -> tuple[Column, Column, Column]:
    """PR16: a point of a spinning scanner from range, azimuth and elevation; null up to a range of 1."""
    valid = F.when(r > 1.0, r)
    flat = F.cos(elevation) * valid
    return F.sin(azimuth) * flat, -F.cos(azimuth) * flat, F.sin(elevation) * valid - base


def turn_back(x: Column, y: Column, i: Column, n: int) -> tuple[Column, Column]:
    """SE15: a point of azimuth sector i of n turned back into the first."""
    a = -i * 2 * math.pi / n
    return F.cos(a) * x - F.sin(a) * y, F.sin(a) * x + F.cos(a) * y


#: SE23: metres by which the true places of a scene are off in x and y, by its number (fixed values).
OFFSETS = {
    0: (15, 5), 6: (3.5, 2), 7: (10, 8), 10: (5, 2), 12: (3, 1), 13: (4, 2), 14: (-2, 2), 15: (3, 2), 17: (2, 2), 18: (8, 2), 21: (2, 1), 23: (5, 2), 24: (0, 2),
}


def with_offset(scene: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    """SE23: a place with the offset of its scene; scenes without one stay."""
    dx, dy = F.lit(0.0), F.lit(0.0)
    for number, (x, y) in OFFSETS.items():
        dx, dy = F.when(scene == number, F.lit(float(x))).otherwise(dx), F.when(scene == number, F.lit(float(y))).otherwise(dy)
    return tx + dx, ty + dy


def mercator(lat: Column, lon: Column, scale: Column) -> tuple[Column, Column]:
    """SE17: metres on a sphere of the earth's equatorial radius."""
    r = 6378137.0
    return scale * lon * math.pi * r / 180, scale * r * F.log(F.tan((90 + lat) * math.pi / 360))


def spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """SE14: radius, polar angle, azimuth."""
    r = F.sqrt(x * x + y * y + z * z)
    return r, F.acos(z / F.nullif(r, F.lit(0.0))), F.atan2(y, x)


def align(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Pose:
    """SE16: rotation that takes unit vector a to unit vector b (not opposite)."""
    v = [ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx]
    c = ax * bx + ay * by + az * bz
    hat = [[F.lit(0.0), -v[2], v[1]], [v[2], F.lit(0.0), -v[0]], [-v[1], v[0], F.lit(0.0)]]
    k = 1 / F.nullif(1 + c, F.lit(0.0))
    square = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    return identity() | {f"r{i}{j}": (1.0 if i == j else 0.0) + hat[i][j] + k * (v[i] * v[j] - (square if i == j else 0)) for i in AXES for j in AXES}


def yaw_time(x: Column, y: Column) -> Column:
    """SC6, SC9: time of a point within a sweep, from its azimuth."""
    return 0.5 * (1 - F.atan2(y, x) / math.pi)
