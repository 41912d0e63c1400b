"""Geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointweave.functions.se3 import Pose


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def squared_norm(x: Column, y: Column, z: Column) -> Column:
    return x * x + y * y + z * z


def squared_distance(a: tuple, b: tuple) -> Column:
    return squared_norm(*[c(p) - (q if isinstance(q, Column) else F.lit(q)) for p, q in zip(a, b, strict=True)])


def transformed(pose: Pose, x: str | Column = "x", y: str | Column = "y", z: str | Column = "z") -> tuple[Column, Column, Column]:
    """R p + t with the pose's twelve numbers as literals."""
    p = (c(x), c(y), c(z))
    r, t = pose.rotation, pose.translation
    return tuple(sum((F.lit(float(r[i, j])) * p[j] for j in range(3)), F.lit(float(t[i]))) for i in range(3))


def posed(yaw: Column, pitch: Column, roll: Column, tx: Column, ty: Column, tz: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """As :func:`transformed`, with the pose in columns (radians)."""
    cy, sy, cp, sp, cr, sr = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    return (
        cy * cp * x + (cy * sp * sr - sy * cr) * y + (cy * sp * cr + sy * sr) * z + tx,
        sy * cp * x + (sy * sp * sr + cy * cr) * y + (sy * sp * cr - cy * sr) * z + ty,
        -sp * x + cp * sr * y + cp * cr * z + tz,
    )


def turned(w: tuple[float | Column, float | Column, float | Column], t: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Exp(w t) p by Rodrigues' formula, with a constant rate, or one in columns, and a time column."""
    if any(isinstance(v, Column) for v in w):
        w = [v if isinstance(v, Column) else F.lit(float(v)) for v in w]
        n = F.sqrt(squared_norm(*w))
        k = [v / F.when(n == 0, F.lit(1.0)).otherwise(n) for v in w]
        angle = n * t
    else:
        size = math.sqrt(sum(v * v for v in w))
        if size == 0:
            return x, y, z
        k = [v / size for v in w]
        angle = F.lit(size) * t
    cos, sin = F.cos(angle), F.sin(angle)
    dot = k[0] * x + k[1] * y + k[2] * z
    cross = (k[1] * z - k[2] * y, k[2] * x - k[0] * z, k[0] * y - k[1] * x)
    return tuple(p * cos + q * sin + u * dot * (1 - cos) for p, q, u in zip((x, y, z), cross, k, strict=True))


def cell(v: Column, size: float) -> Column:
    """Index of a voxel: truncation toward zero, so the cells around zero are twice as wide."""
    return (v / F.lit(float(size))).cast("int")


def uniform_cell(v: Column, size: float) -> Column:
    """Index of a cell of uniform width."""
    return F.floor(v / F.lit(float(size))).cast("bigint")


def probability(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def erf(v: Column) -> Column:
    """The error function by a rational approximation, off by less than 2e-7."""
    x = F.abs(v)
    t = 1 / (1 + F.lit(0.3275911) * x)
    series = F.lit(1.061405429)
    for a in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = series * t + F.lit(a)
    return F.signum(v) * (1 - series * t * F.exp(-x * x))


def recolored(v: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 1 of a value between two bounds: blue, cyan, green, yellow, red."""
    u = F.least(F.greatest((v - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low), F.lit(0.0)), F.lit(1.0)) * 4
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return clip(u - 2), clip(F.lit(2.0) - F.abs(u - 2)), clip(F.lit(2.0) - u)
