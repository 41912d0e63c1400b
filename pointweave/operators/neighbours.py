"""Nearest-neighbour joins and the matchers built on them.

The nearest points come from the leaves of a tree (:mod:`knn`), whatever the
radius and the density.  All pairs within a radius (:func:`within`) are as many
as the radius lets in: points fall into uniform cells as wide as it, so all
neighbours of a point lie in the 27 cells around its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions import geometry as g
from pointweave.functions.se3 import Pose
from pointweave.operators import knn
from pointweave.operators.predicates import moved
from pointweave.operators.voxels import bounding_box, shapes

PAIR = ["local_id", "global_id", "lx", "ly", "lz", "gx", "gy", "gz", "d2"]


def _sides(local: DataFrame, world: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    left = local.select(F.col("point_id").alias("local_id"), *[F.col(a).alias(f"l{a}") for a in "xyz"])
    right = world.select(F.col("point_id").alias("global_id"), *[F.col(a).alias(f"g{a}") for a in "xyz"], *[g.uniform_cell(F.col(a), radius).alias(f"c{a}") for a in "xyz"])
    around = F.array(*[F.struct(*[F.lit(v).alias(f"d{a}") for a, v in zip("xyz", (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    left = left.withColumn("o", F.explode(around))
    return left.select("local_id", "lx", "ly", "lz", *[(g.uniform_cell(F.col(f"l{a}"), radius) + F.col(f"o.d{a}")).alias(f"c{a}") for a in "xyz"]), right


def within(local: DataFrame, world: DataFrame, radius: float, limit: Column | None = None) -> DataFrame:
    """All pairs closer than ``radius``, or with d2 under ``limit``, which mustn't exceed its square."""
    left, right = _sides(local, world, radius)
    d2 = g.squared_distance(("lx", "ly", "lz"), tuple(F.col(f"g{a}") for a in "xyz"))
    pairs = left.join(right, ["cx", "cy", "cz"]).withColumn("d2", d2)
    return pairs.where(F.col("d2") < (F.lit(radius * radius) if limit is None else limit)).select(*PAIR)


def nearest(pairs: DataFrame, k: int = 1) -> DataFrame:
    """Of each local point's pairs the ``k`` with the least distance, ties by the global id."""
    if k == 1:
        best = F.min_by(F.struct("global_id", "lx", "ly", "lz", "gx", "gy", "gz", "d2"), F.struct("d2", "global_id"))
        return pairs.groupBy("local_id").agg(best.alias("p")).select("local_id", "p.*")
    rank = F.row_number().over(Window.partitionBy("local_id").orderBy("d2", "global_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_within(local: DataFrame, world: DataFrame, radius: float, k: int = 1, limit: Column | None = None) -> DataFrame:
    """``nearest(within(local, world, radius, limit), k)`` without all those pairs; ``limit`` may be any."""
    return nearest(knn.nearest_within(local, world, k, F.lit(float(radius * radius)) if limit is None else limit), k)


def nearest_unbounded(local: DataFrame, world: DataFrame) -> DataFrame:
    """The nearest global point of every local one, at any distance."""
    return nearest_within(local, world, math.inf).persist()


def boxes_meet(local: DataFrame, world: DataFrame, margin: float) -> bool:
    """Whether the bounding boxes (one row each) come closer than ``margin``."""
    a, b = bounding_box(local).first(), bounding_box(world).first()
    return a["min_x"] is not None and b["min_x"] is not None and all(a[f"min_{k}"] - margin <= b[f"max_{k}"] and b[f"min_{k}"] - margin <= a[f"max_{k}"] for k in "xyz")


def each_global_once(pairs: DataFrame) -> DataFrame:
    """Of pairs that share a global point the one with the least local id."""
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("global_id").orderBy("local_id"))).where("_r = 1").drop("_r")


def sampled(local: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` points, told by a hash (0: all)."""
    return local.orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(most) if most else local


def match_distance(
    local: DataFrame, world: DataFrame, pose: Pose, threshold: float, angular_deg: float = 0.5, per_point: int = 1, reuse_global: bool = False, paired: DataFrame | None = None, margin: float = 0.20
) -> DataFrame:
    """Pairs of the moved local points with their nearest global ones.

    A pair holds if d2 < threshold^2 + (angle * |p|)^2.  Local points in
    ``paired`` (``local_id``) are left out.  ``lx, ly, lz`` in the result are
    before the motion.
    """
    own = local if paired is None else local.join(paired.select(F.col("local_id").alias("point_id")), "point_id", "left_anti")
    there = moved(own, pose)
    angle = math.radians(angular_deg)
    limit = F.lit(threshold**2) + F.lit(angle**2) * g.squared_norm(F.col("lx"), F.col("ly"), F.col("lz"))
    if not boxes_meet(there, world, threshold + margin):
        return _unmoved(within(there.where(F.lit(False)), world, threshold), own)
    pairs = nearest_within(there, world, math.inf, per_point, limit).select(*PAIR)
    return _unmoved(pairs if reuse_global else each_global_once(pairs), own)


def match_inlier_ratio(local: DataFrame, world: DataFrame, pose: Pose, ratio: float, reuse_global: bool = False) -> DataFrame:
    """The best round(n * ratio) of all nearest pairs, whatever their distance."""
    if not 0 < ratio < 1:
        raise ValueError("the ratio lies between 0 and 1")
    pairs = best_share(nearest_unbounded(moved(local, pose), world).select(*PAIR), ratio)
    return _unmoved(pairs if reuse_global else each_global_once(pairs), local)


def best_share(pairs: DataFrame, ratio: float) -> DataFrame:
    """The round(n * ratio) pairs with the least distance: by the quantile's distance, ties by id."""
    keep = int(math.floor(pairs.count() * ratio + 0.5))
    if not keep:
        return pairs.where(F.lit(False))
    return pairs.orderBy("d2", "local_id").limit(keep)


def _unmoved(pairs: DataFrame, local: DataFrame) -> DataFrame:
    own = local.select(F.col("point_id").alias("local_id"), *[F.col(a).alias(f"l{a}") for a in "xyz"])
    return pairs.drop("lx", "ly", "lz").join(own, "local_id").select(*PAIR)


def _neighbourhood(local: DataFrame, world: DataFrame, radius: float, k: int) -> DataFrame:
    """For each local point the shape of its ``k`` nearest global ones within ``radius``."""
    near = nearest_within(local, world, radius, max(k, 2)).select("local_id", *[F.col(f"g{a}").alias(a) for a in "xyz"])
    return shapes(near, ["local_id"], 3)


def match_line(local: DataFrame, world: DataFrame, pose: Pose, distance: float, knn: int, eigen_threshold: float, minimum_points: int = 3) -> DataFrame:
    """Local points with the line through their neighbours, where these lie on one."""
    there = moved(local, pose)
    e0, e1, e2 = F.col("e0"), F.col("e1"), F.col("e2")
    line = _neighbourhood(there, world, distance, knn).where((F.col("n") >= minimum_points) & (e0 <= eigen_threshold * e2) & (e1 <= eigen_threshold * e2))
    base = line.select("local_id", *[F.col(f"m{a}").alias(f"b{a}") for a in "xyz"], *[F.col(f"v2{a}").alias(f"u{a}") for a in "xyz"])
    return base.join(local.select(F.col("point_id").alias("local_id"), *[F.col(a).alias(f"l{a}") for a in "xyz"]), "local_id")


def match_plane(local: DataFrame, world: DataFrame, pose: Pose, distance: float, radius: float = 1.0, knn: int = 8, eigen_threshold: float = 0.01, minimum_points: int = 4) -> DataFrame:
    """Local points with the plane through their neighbours, if they are no farther than ``distance`` from it."""
    there = moved(local, pose)
    shape = _neighbourhood(there, world, radius, knn)
    flat = shape.where((F.col("n") >= minimum_points) & (F.col("e0") < eigen_threshold * F.col("e1")) & (F.col("e0") < eigen_threshold * F.col("e2")))
    planes = flat.select("local_id", *[F.col(f"v0{a}").alias(f"n{a}") for a in "xyz"], *[F.col(f"m{a}").alias(f"c_{a}") for a in "xyz"])
    at = planes.join(there.select(F.col("point_id").alias("local_id"), "x", "y", "z"), "local_id")
    d = -(F.col("nx") * F.col("c_x") + F.col("ny") * F.col("c_y") + F.col("nz") * F.col("c_z"))
    out = at.withColumn("d", d).where(F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d")) <= distance).drop("x", "y", "z")
    return out.join(local.select(F.col("point_id").alias("local_id"), *[F.col(a).alias(f"l{a}") for a in "xyz"]), "local_id")


def match_adaptive(
    local: DataFrame,
    world: DataFrame,
    pose: Pose,
    interval: float,
    first_to_second: float,
    radius: float,
    detect_planes: bool = False,
    minimum_distance: float = 0.1,
    plane_points: int = 8,
    plane_minimum: int = 4,
    plane_eigen: float = 0.01,
    most_pairs: int = 1,
    plane_distance: float = 0.10,
) -> tuple[DataFrame, DataFrame | None]:
    """Point pairs, and plane pairs that take the place of a point's own, with a limit from the errors themselves.

    The limit is the upper bound of the confidence interval of the first and
    second errors, from a histogram of 50 bins, and at least ``minimum_distance``.
    """
    from pointweave.operators.voxels import confidence_bounds

    there = moved(local, pose)
    near = nearest_within(there, world, radius, max(2, min(10, max(plane_points, most_pairs)))).persist()
    bounds = confidence_bounds(near.where("rank <= 2"), "d2", interval, 50)
    limit = max(minimum_distance**2, bounds[1]) if bounds else minimum_distance**2
    own = local.select(F.col("point_id").alias("local_id"), *[F.col(a).alias(f"l{a}") for a in "xyz"])
    planes = None
    if detect_planes:
        planes = match_plane(local, world, pose, plane_distance, radius, plane_points, plane_eigen, plane_minimum)
        near = near.join(planes.select("local_id"), "local_id", "left_anti")
    first = F.min("d2").over(Window.partitionBy("local_id"))
    kept = near.withColumn("_first", first).where((F.col("rank") <= most_pairs) & (F.col("d2") < limit) & (F.col("d2") <= F.col("_first") * first_to_second**2))
    return kept.select(*PAIR).drop("lx", "ly", "lz").join(own, "local_id").select(*PAIR), planes
