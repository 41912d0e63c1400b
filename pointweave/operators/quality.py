"""Scores of a registration, from 0 to 1."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions import geometry as g
from pointweave.functions.se3 import Pose
from pointweave.operators.predicates import moved


def paired_ratio(n_pairs: int, potential: int, minimum: float = 0.20) -> tuple[float, bool]:
    """The share of possible pairs, and whether it is too small for any good registration."""
    ratio = n_pairs / potential if potential else 0.0
    return ratio, ratio < minimum


def range_image(df: DataFrame, ncols: int, nrows: int, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """``u, v, range``: the least range of each pixel of a pinhole camera that looks along x."""
    u, v = F.lit(cx) - F.lit(fx) * F.col("y") / F.col("x"), F.lit(cy) - F.lit(fy) * F.col("z") / F.col("x")
    rows = df.where("x <> 0").select(u.cast("int").alias("u"), v.cast("int").alias("v"), F.sqrt(g.squared_norm(F.col("x"), F.col("y"), F.col("z"))).alias("range"))
    return rows.where((F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") < ncols) & (F.col("v") < nrows)).groupBy("u", "v").agg(F.min("range").alias("range"))


def range_image_score(local: DataFrame, world: DataFrame, pose: Pose, camera: dict, sigma: float = 0.1, unseen: float = 2.0) -> DataFrame:
    """One row ``score``: the likeness of both clouds' ranges from either place, averaged.

    The pose moves the global cloud and its inverse the local one.  A pixel
    that one cloud alone has counts as off by ``unseen`` deviations.
    """
    parts = []
    for a, b in ((world, moved(local, pose.inverse())), (moved(world, pose), local)):
        both = range_image(a, **camera).withColumnRenamed("range", "ra").join(range_image(b, **camera).withColumnRenamed("range", "rb"), ["u", "v"], "full_outer")
        off = F.coalesce(F.abs(F.col("ra") - F.col("rb")) / sigma, F.lit(unseen))
        parts.append(both.select((1 - g.erf(off / math.sqrt(2))).alias("s")).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("s")))
    return parts[0].unionByName(parts[1]).agg(F.avg("s").alias("score"))


def voxel_quality(local: DataFrame, world: DataFrame, pose: Pose, resolution: float, scale: float = 2.0) -> DataFrame:
    """One row ``cells, quality`` from occupancies of voxels (``cx, cy, cz, occupancy``) that lie on each other.

    Centres of either side are looked up in the other; hardly seen voxels,
    within 0.01 of a half, don't count; nothing to compare gives 0.
    """
    parts = []
    for a, b, p in ((local, world, pose), (world, local, pose.inverse())):
        centres = moved(a.select("occupancy", *[((F.col(f"c{k}") + 0.5) * resolution).alias(k) for k in "xyz"]), p)
        at = centres.select(F.col("occupancy").alias("p"), *[g.uniform_cell(F.col(k), resolution).cast("int").alias(f"c{k}") for k in "xyz"])
        parts.append(at.join(b.select("cx", "cy", "cz", F.col("occupancy").alias("q")), ["cx", "cy", "cz"]).select("p", "q"))
    both = parts[0].unionByName(parts[1]).where((F.abs(F.col("p") - 0.5) >= 0.01) & (F.abs(F.col("q") - 0.5) >= 0.01))
    p, q = F.col("p"), F.col("q")
    loss = 1.5 + p + q - 12 * p * p + 22 * p * q - 12 * q * q
    return both.agg(F.count("*").alias("cells"), F.avg(loss).alias("m")).select("cells", F.when(F.col("cells") == 0, F.lit(0.0)).otherwise(1 / (1 + F.exp(-scale * F.col("m")))).alias("quality"))


def combined(scores: list[tuple[float, float, bool]]) -> float:
    """Weighted mean of (score, weight, discard); 0 if any discards."""
    if any(d for *_, d in scores) or not scores:
        return 0.0
    return float(np.average([s for s, _, _ in scores], weights=[w for _, w, _ in scores]))
