"""Operators that depend on the order of points along a ring or a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions import geometry as g
from pointweave.schema import require


def spaced(df: DataFrame, clearance: float, by: str | list[str] = "ring") -> DataFrame:
    """Drops points closer (in any axis) than ``clearance`` to the last point kept of their ring.

    Each decision needs the one before, so a ring is read in one piece.
    """
    if clearance <= 0:
        return df

    def keep(ring: pd.DataFrame) -> pd.DataFrame:
        ring = ring.sort_values("point_id")
        p = ring[["x", "y", "z"]].to_numpy()
        kept = np.zeros(len(p), bool)
        last = None
        for i in range(len(p)):
            if last is None or np.abs(p[i] - p[last]).max() >= clearance:
                kept[i], last = True, i
        return ring[kept]

    return df.groupBy(*([by] if isinstance(by, str) else by)).applyInPandas(keep, df.schema)


def curvature(df: DataFrame, max_cosine: float = 0.5, clearance: float = 0.0, max_gap: float = 2.0, by: str | list[str] | None = None) -> DataFrame:
    """``class`` of each point: ``larger`` or ``smaller`` curvature, or ``other``.

    Neighbours are the points before and after on the ring, which closes on
    itself.  Next to a gap a point counts as larger if it is closer to the
    sensor than the one before; rings of up to three points are all larger.
    A ring is told by ``by``: by default ``ring`` and, where these are there,
    the scan or keyframe.
    """
    by = [by] if isinstance(by, str) else by or [*(c for c in ("kf_id", "obs_id", "scan_id") if c in df.columns), "ring"]
    require(df, *by)
    own = Window.partitionBy(*by)
    line, whole = own.orderBy("point_id"), own.orderBy("point_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = spaced(df, clearance, by).withColumn("_n", F.count("*").over(own))
    for a in "xyz":
        rows = rows.withColumns({f"_p{a}": F.coalesce(F.lag(a).over(line), F.last(a).over(whole)), f"_s{a}": F.coalesce(F.lead(a).over(line), F.first(a).over(whole))})
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    before, after = tuple(F.col(f"_p{a}") for a in "xyz"), tuple(F.col(f"_s{a}") for a in "xyz")
    d1, d2 = g.squared_distance((x, y, z), before), g.squared_distance((x, y, z), after)
    dot = sum(((p - q) * (s - p) for p, q, s in zip((x, y, z), before, after, strict=True)), F.lit(0.0))
    gap = (d1 > max_gap**2) | (d2 > max_gap**2)
    kind = (
        F.when(F.col("_n") <= 3, "larger")
        .when(gap, F.when(g.squared_norm(x, y, z) < g.squared_norm(*before), "larger").otherwise("other"))
        .when(F.abs(dot) < max_cosine * F.sqrt(d1) * F.sqrt(d2), "larger")
        .otherwise("smaller")
    )
    return rows.withColumn("class", kind).select(*df.columns, "class")


def edges_from_curvature(scan: DataFrame, max_cosine: float = 0.5, clearance: float = 0.10) -> DataFrame:
    """Interior points ``scan_id, row, col, range, x, y, z`` of range images at which the row bends."""
    line = Window.partitionBy("scan_id", "row").orderBy("col")
    rows = scan
    for k, f in (("p", F.lag), ("s", F.lead)):
        rows = rows.withColumns({f"_{k}{a}": f(a).over(line) for a in ("x", "y", "z", "range")})
    v1 = [F.col(a) - F.col(f"_p{a}") for a in "xyz"]
    v2 = [F.col(f"_s{a}") - F.col(a) for a in "xyz"]
    n1, n2 = F.sqrt(g.squared_norm(*v1)), F.sqrt(g.squared_norm(*v2))
    dot = sum((p * q for p, q in zip(v1, v2, strict=True)), F.lit(0.0))
    whole = (F.col("range") != 0) & (F.col("_prange") != 0) & (F.col("_srange") != 0)
    return rows.where(whole & (n1 >= clearance) & (n2 >= clearance) & (F.abs(dot) < max_cosine * n1 * n2)).select(*scan.columns)


def range_edge_scores(scan: DataFrame, half: int = 8) -> DataFrame:
    """``score`` of each pixel of ``scan_id, row, col, range``: how far its range lies from the moving mean of differences.

    Ranges are whole numbers of 1/256; mean and variance over the window are
    both divided by its length less one.
    """
    line = Window.partitionBy("scan_id", "row").orderBy("col")
    window = line.rowsBetween(-half, half)
    fixed = F.round(F.col("range") * 256).cast("bigint")
    rows = scan.withColumn("_r", fixed).withColumn("_d", F.col("_r") - F.lag("_r").over(line))
    n = F.lit(2 * half)
    rows = rows.withColumn("_full", F.count("_d").over(window)).withColumn("_m", F.sum("_d").over(window) / n)
    rows = rows.withColumn("_v", (F.sum(F.col("_d") * F.col("_d")).over(window) - 2 * F.col("_m") * F.sum("_d").over(window) + (2 * half + 1) * F.col("_m") * F.col("_m")) / n)
    score = (F.col("_r") - F.col("_m")) * (F.col("_r") - F.col("_m")) / F.col("_v") / 65536
    return rows.where((F.col("_full") == 2 * half + 1) & (F.col("_v") > 0) & (F.col("range") != 0)).select(*scan.columns, score.alias("score"))


def edges_from_ranges(scan: DataFrame, threshold: float, half: int = 8) -> DataFrame:
    return range_edge_scores(scan, half).where(F.col("score") > threshold).drop("score")


def depth_edges_planes(pixels: DataFrame, threshold: float, block: int = 8) -> dict[str, DataFrame]:
    """Edges and planes of depth images ``scan_id, row, col, depth`` from block means.

    Means leave out zeros.  A block is an edge if its second difference,
    squared, exceeds ``threshold`` times the row's variance of it; on runs
    without edges a plane point stands at every 16th part of a row.
    """
    mean = F.avg(F.when(F.col("depth") != 0, F.col("depth")))
    blocks = pixels.groupBy("scan_id", F.floor(F.col("row") / block).alias("r"), F.floor(F.col("col") / block).alias("c")).agg(mean.alias("depth")).where("depth is not null")
    row = Window.partitionBy("scan_id", "r")
    line = row.orderBy("c")
    rows = blocks.withColumn("d1", F.col("depth") - F.lag("depth").over(line)).withColumn("d2", F.col("d1") - F.lag("d1").over(line))
    rows = rows.withColumn("v", F.var_pop("d2").over(row)).withColumn("n", F.max("c").over(row) + 1)
    rows = rows.withColumn("edge", F.coalesce(F.col("d2") * F.col("d2") > threshold * F.col("v"), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("edge").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy("scan_id", "r", "run", "edge").orderBy("c"))
    plane: Column = ~F.col("edge") & (at % F.greatest(F.lit(1), F.ceil(F.col("n") / 16)).cast("int") == 0)
    names = ["scan_id", "r", "c", "depth"]
    marked = rows.withColumn("plane", plane)
    return {"edges": marked.where("edge").select(*names), "planes": marked.where("plane").select(*names)}
