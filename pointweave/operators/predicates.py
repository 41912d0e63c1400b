"""Row-wise operators: splits, projections and rigid motion.  None of them shuffles unless it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions import geometry as g
from pointweave.functions.se3 import Pose
from pointweave.schema import require

Split = dict[str, DataFrame]
Number = float | Column


def _pair(df: DataFrame, inside: Column, names: tuple[str, str]) -> Split:
    return {names[0]: df.where(inside), names[1]: df.where(~inside)}


def by_range(df: DataFrame, low: Number = 3.0, high: Number = 90.0, center: tuple[Number, Number, Number] = (0.0, 0.0, 0.0)) -> Split:
    """Points by distance from ``center``: ``between`` holds both ends, ``outside`` the rest."""
    d2 = g.squared_distance(("x", "y", "z"), center)
    return _pair(df, (d2 >= low * low) & (d2 <= high * high), ("between", "outside"))


def by_box(df: DataFrame, low: tuple[Number, Number, Number], high: tuple[Number, Number, Number]) -> Split:
    """Points in a closed axis-aligned box.  On stored columns the comparisons reach the file scan."""
    inside = F.lit(True)
    for name, a, b in zip("xyz", low, high, strict=True):
        inside = inside & (F.col(name) >= a) & (F.col(name) <= b)
    return _pair(df, inside, ("inside", "outside"))


def intensity_band(low: float, high: float) -> Column:
    i = F.col("intensity")
    return F.when(i < low, "low").when(i > high, "high").otherwise("mid")


def by_intensity(df: DataFrame, low: float, high: float) -> Split:
    """``low`` below the first threshold, ``high`` above the second, ``mid`` between, thresholds included."""
    require(df, "intensity")
    i = F.col("intensity")
    return {"low": df.where(i < low), "mid": df.where((i >= low) & (i <= high)), "high": df.where(i > high)}


def by_ring(df: DataFrame, rings: int | list[int]) -> Split:
    require(df, "ring")
    return _pair(df, F.col("ring").isin([rings] if isinstance(rings, int) else list(rings)), ("selected", "non_selected"))


def by_occupancy(points: DataFrame, voxels: DataFrame, resolution: float, threshold: float) -> Split:
    """Points in voxels that are surely occupied (``static``) or surely free (``dynamic``).

    ``voxels`` has ``cx, cy, cz, occupancy``, cells of uniform width, as
    :func:`~pointweave.operators.voxels.occupancy` makes them.  Points without a voxel, and
    those in voxels that are neither, go nowhere.  One equi-join on the cell.
    """
    f = min(threshold, 1 - threshold)
    keyed = points.withColumns({f"c{a}": g.uniform_cell(F.col(a), resolution).cast("int") for a in "xyz"})
    joined = keyed.join(voxels.select("cx", "cy", "cz", F.col("occupancy").alias("_occupancy")), ["cx", "cy", "cz"])
    p = F.col("_occupancy")
    return {k: joined.where(w).select(*points.columns) for k, w in (("static", p > 1 - f), ("dynamic", p < f))}


def adjust_timestamps(df: DataFrame, method: str, offset: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """Shifts or scales ``t`` by its extremes, over all points or within the groups of ``by``.

    ``earliest_is_zero``: t - (min + offset); ``middle_is_zero``: t - (middle
    + offset); ``normalize``: (t - min) / (max - min) + offset, with a
    divisor of 1 for a single time.  The extremes come from one small aggregate.
    """
    require(df, "t")
    lo, hi = F.min("t"), F.max("t")
    extremes = df.groupBy(*(by or [])).agg(lo.alias("_lo"), hi.alias("_hi"))
    joined = df.join(extremes, by) if by else df.crossJoin(F.broadcast(extremes))  # a single row
    t, a, b = F.col("t"), F.col("_lo"), F.col("_hi")
    new = {
        "earliest_is_zero": t - (a + offset),
        "middle_is_zero": t - (F.lit(0.5) * (a + b) + offset),
        "normalize": (t - a) * F.when(b == a, F.lit(1.0)).otherwise(1 / (b - a)) + offset,
    }[method]
    return joined.withColumn("t", new).select(*df.columns)


def normalize_intensity(df: DataFrame, fixed: tuple[float, float] | None = None, remember: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``intensity`` into 0 to 1 by its extremes.

    The extremes are ``fixed``, those of all points, or, with the name of an
    ordered column in ``remember``, those of all points up to the row's own
    value of it, as when scans come one after the other; or, with ``by``, those
    of each group.
    """
    require(df, "intensity")
    i = F.col("intensity")
    if fixed:
        joined = df.withColumns({"_lo": F.lit(float(fixed[0])), "_hi": F.lit(float(fixed[1]))})
    elif remember:
        own = df.groupBy(remember).agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))
        so_far = Window.orderBy(remember).rowsBetween(Window.unboundedPreceding, 0)  # over one row for each scan
        joined = df.join(own.select(remember, F.min("_lo").over(so_far).alias("_lo"), F.max("_hi").over(so_far).alias("_hi")), remember)
    elif by:
        joined = df.join(df.groupBy(*by).agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi")), by)
    else:
        joined = df.crossJoin(F.broadcast(df.agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))))  # a single row
    lo, hi = F.col("_lo"), F.col("_hi")
    new = F.least(F.greatest((i - lo) / F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo), F.lit(0.0)), F.lit(1.0))
    return joined.withColumn("intensity", new).select(*df.columns)


def moved(df: DataFrame, pose: Pose) -> DataFrame:
    x, y, z = g.transformed(pose)
    return df.withColumns({"x": x, "y": y, "z": z})


def deskew(df: DataFrame, twist: tuple[Number, ...], ignore_missing_times: bool = False, skip: bool = False) -> DataFrame:
    """Points as seen at time zero under a constant twist (v, w), whose numbers may be columns.  Points at the origin stay there."""
    if skip or ("t" not in df.columns and ignore_missing_times):
        return df
    require(df, "t")
    x, y, z, t = (F.col(k) for k in ("x", "y", "z", "t"))
    there = g.turned(tuple(twist[3:]), t, x, y, z)
    origin = (x == 0) & (y == 0) & (z == 0)
    still = origin | t.isNull()
    return df.withColumns({k: F.when(still, F.col(k)).otherwise(p + v * t) for k, p, v in zip("xyz", there, twist[:3], strict=True)})


def voxel_centres(voxels: DataFrame, resolution: float, occupied: float = 0.5) -> DataFrame:
    """Centres of the occupied voxels of a uniform grid, as points."""
    centre = {a: (F.col(f"c{a}") + 0.5) * resolution for a in "xyz"}
    return voxels.where(F.col("occupancy") > occupied).select(*[v.alias(k) for k, v in centre.items()])
