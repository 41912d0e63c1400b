"""Group-bys over voxels: decimation, local shape, poles, slices and summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions import geometry as g

CELL = ["cx", "cy", "cz"]


def keyed(df: DataFrame, resolution: float, key: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with its voxel; ``key`` may put other coordinates in the place of x, y, z."""
    own = key or {a: F.col(a) for a in "xyz"}
    return df.withColumns({f"c{a}": g.cell(own[a], resolution) for a in "xyz"})


def quadratic_key(radius: float) -> dict[str, Column]:
    """Coordinates that grow with the square up to ``radius``, so that voxels shrink with distance there."""
    return {a: F.when(F.abs(F.col(a)) > radius, F.col(a)).otherwise(F.signum(F.col(a)) * F.col(a) * F.col(a) / radius) for a in "xyz"}


def decimated(
    df: DataFrame, resolution: float, method: str = "first", key: dict[str, Column] | None = None, seed: int = 0, flatten_to: float | None = None, minimum_points: int = 0, by: list[str] | None = None
) -> DataFrame:
    """One point for each voxel, with the voxel and its number of points ``n``.

    ``first``: the least ``point_id``; ``mean``: the average, without other
    channels; ``closest``: the point closest to the average, of equally close
    ones the first; ``random``: the least hash of ``point_id``.  With
    ``flatten_to`` one point stays for each (cx, cy), at that height.  Clouds
    of at most ``minimum_points`` points come back whole.  With ``by`` the
    groups of these columns, such as scans, are thinned each by itself.
    """
    cells = [*(by or []), *CELL]
    if minimum_points and df.limit(minimum_points + 1).count() <= minimum_points:
        return keyed(df, resolution, key).withColumn("n", F.lit(1).cast("bigint"))
    own = keyed(df, resolution, key)
    names = [c for c in df.columns if c not in cells]
    if method == "mean":
        out = own.groupBy(*cells).agg(*[F.avg(a).alias(a) for a in "xyz"], F.min("point_id").alias("point_id"), F.count("*").alias("n"))
    elif method in ("first", "random"):
        order = F.col("point_id") if method == "first" else F.struct(random_rank(seed), "point_id")
        out = own.groupBy(*cells).agg(F.min_by(F.struct(*names), order).alias("p"), F.count("*").alias("n")).select(*cells, "p.*", "n")
    elif method == "closest":
        means = own.groupBy(*cells).agg(*[F.avg(a).alias(f"_m{a}") for a in "xyz"], F.count("*").alias("n"))
        d2 = F.round(g.squared_distance(("x", "y", "z"), tuple(F.col(f"_m{a}") for a in "xyz")), 9)
        near = own.join(means, cells).groupBy(*cells).agg(F.min_by(F.struct(*names), F.struct(d2, F.col("point_id"))).alias("p"), F.max("n").alias("n"))
        out = near.select(*cells, "p.*", "n")
    else:
        raise ValueError(f"no such method: {method}")
    if flatten_to is not None:
        flat = out.groupBy(*cells[:-1]).agg(F.min_by(F.struct("x", "y", "point_id"), "point_id").alias("p"), F.sum("n").alias("n"))
        out = flat.select(*cells[:-1], "p.x", "p.y", F.lit(float(flatten_to)).alias("z"), "p.point_id", "n")
    return out


def random_rank(seed: int) -> Column:
    """A portable pseudo-random number of a point."""
    return F.pmod((F.col("point_id") + seed) * F.lit(2654435761), F.lit(1000003))


def first_of_layers(layers: list[DataFrame], resolution: float) -> DataFrame:
    """The first point of each voxel over several layers, which come in the given order."""
    own = [x.withColumn("_layer", F.lit(i)) for i, x in enumerate(layers)]
    whole = own[0]
    for x in own[1:]:
        whole = whole.unionByName(x, allowMissingColumns=True)
    names = [c for c in whole.columns if c != "_layer"]
    grouped = keyed(whole, resolution).groupBy(*CELL).agg(F.min_by(F.struct(*names), F.struct("_layer", "point_id")).alias("p"), F.count("*").alias("n"))
    return grouped.select(*CELL, "p.*", "n")


def bounding_box(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def adaptive(df: DataFrame, target: int, minimum_box: float = 10.0, voxels_per_axis: int = 100, minimum_points: int = 1) -> DataFrame:
    """About ``target`` points, spread over the voxels: each round takes one point from every voxel.

    The voxel's size follows the bounding box (a single row).  Points are
    ordered by their round and a hash of the voxel, and the first ``target``
    stay, found by the counts of rounds, without sorting all points.
    """
    box = bounding_box(df).first()
    if box["min_x"] is None or target <= 0:
        return df.where(F.lit(False))
    size = max(np.linalg.norm([max(box[f"max_{a}"] - box[f"min_{a}"], minimum_box) for a in "xyz"]) / voxels_per_axis, 1e-9)
    own = Window.partitionBy(*CELL)
    rows = keyed(df, size).withColumn("_n", F.count("*").over(own)).withColumn("_round", F.row_number().over(own.orderBy("point_id"))).where(F.col("_n") >= minimum_points)
    rounds = rows.groupBy("_round").count().orderBy("_round")
    taken, last = 0, 0
    for r in rounds.toLocalIterator():  # a number for each round, up to the one that reaches the target
        if taken + r["count"] > target:
            break
        taken, last = taken + r["count"], r["_round"]
    whole = rows.where(F.col("_round") <= last)
    spread = F.pmod(F.col("cx") * F.lit(73856093) + F.col("cy") * F.lit(19349663) + F.col("cz") * F.lit(83492791), F.lit(1000003))
    rest = rows.withColumns({c: F.col(c).cast("bigint") for c in CELL}).where(F.col("_round") == last + 1).orderBy(spread, *CELL).limit(max(0, target - taken))
    return whole.unionByName(rest).select(*df.columns)


# ------------------------------------------------------------------ local shape

MOMENTS = ["sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz"]


def moments(df: DataFrame, by: list[str]) -> DataFrame:
    """Sums that a group's mean and covariance follow from; they merge, so they are added up before the shuffle."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    terms = dict(zip(MOMENTS, (x, y, z, x * x, x * y, x * z, y * y, y * z, z * z), strict=True))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in terms.items()])


def eigen_batch(n: np.ndarray, sums: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, ascending eigenvalues and eigenvectors (as columns) of population covariances."""
    mean = np.stack([sums[k] / n for k in ("sx", "sy", "sz")], axis=1)
    cov = np.empty((len(n), 3, 3))
    for i, a in enumerate("xyz"):
        for j, b in enumerate("xyz"):
            cov[:, i, j] = sums["s" + "".join(sorted(a + b))] / n - mean[:, i] * mean[:, j]
    values, vectors = np.linalg.eigh(cov) if len(n) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
    return mean, values, vectors


SHAPE = "mx double, my double, mz double, e0 double, e1 double, e2 double, v0x double, v0y double, v0z double, v2x double, v2y double, v2z double"


def shapes(df: DataFrame, by: list[str], minimum: int = 3) -> DataFrame:
    """Mean, eigenvalues, smallest and largest eigenvector of each group of at least ``minimum`` points."""
    sums = moments(df, by).where(F.col("n") >= max(3, minimum))
    keys = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in by)
    names = [x.split()[0] for x in SHAPE.split(", ")]

    def run(batches):
        for b in batches:
            mean, e, v = eigen_batch(b.column("n").to_numpy().astype(float), {k: b.column(k).to_numpy() for k in MOMENTS})
            columns = [*mean.T, *e.T, *v[:, :, 0].T, *v[:, :, 2].T]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in by], b.column("n"), *map(pa.array, columns)], [*by, "n", *names])

    return sums.mapInArrow(run, f"{keys}, n bigint, {SHAPE}")


def covariance_of_groups(df: DataFrame, by: list[str]) -> DataFrame:
    pairs = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.covar_pop(p[0], p[1]).alias(f"c{p}") for p in pairs])


def edges_planes(df: DataFrame, resolution: float, keep_every: int = 1, full_every: int = 1, max_ratio: float = 30.0, min_ratio: float = 100.0, min_e1: float = 0.0, max_ratio1: float | None = None, min_ratio1: float | None = None, by: list[str] | None = None) -> dict[str, DataFrame]:
    """Points of voxels that are edges or planes, the planes, and a thinned cloud.

    A voxel of 5 points or more is an edge if e2 and e1 are under ``max_ratio``
    and ``max_ratio1`` times e0; else a plane if they are over ``min_ratio`` and
    ``min_ratio1`` times e0 and e1 is over ``min_e1`` (the ratios of e1 are those
    of e2 if not given).  Normals face the origin.  Of a voxel's points each
    ``keep_every``-th stays; a plane's only if its normal isn't upright.  With
    ``full_every`` 0 the thinned cloud is empty.
    """
    cells = [*(by or []), *CELL]
    rows = keyed(df, resolution)
    shape = shapes(rows, cells, 5)
    edge = (F.col("e2") < max_ratio * F.col("e0")) & (F.col("e1") < (max_ratio if max_ratio1 is None else max_ratio1) * F.col("e0"))
    plane = ~edge & (F.col("e2") > min_ratio * F.col("e0")) & (F.col("e1") > (min_ratio if min_ratio1 is None else min_ratio1) * F.col("e0")) & (F.col("e1") > min_e1)
    towards = F.col("v0x") * F.col("mx") + F.col("v0y") * F.col("my") + F.col("v0z") * F.col("mz")
    sign = F.when(towards > 0, -1.0).otherwise(1.0)
    kind = shape.withColumn("kind", F.when(edge, "edge").when(plane, "plane").otherwise("other"))
    numbered = rows.join(kind.select(*cells, "kind", "v0z"), cells).withColumn("_k", F.row_number().over(Window.partitionBy(*cells).orderBy("point_id")) - 1)
    every = F.col("_k") % keep_every == 0
    planes = kind.where("kind = 'plane'").select(
        *cells, *[(sign * F.col(f"v0{a}")).alias(f"n{a}") for a in "xyz"], (-(sign * towards)).alias("d"), *[F.col(f"m{a}").alias(f"c_{a}") for a in "xyz"], "n"
    )
    return {
        "edge_points": numbered.where((F.col("kind") == "edge") & every).select(*df.columns),
        "plane_points": numbered.where((F.col("kind") == "plane") & (F.abs("v0z") < 0.9) & every).select(*df.columns),
        "full_decim": numbered.where(F.col("_k") % full_every == 0 if full_every else F.lit(False)).select(*df.columns),
        "plane_centroids": planes.select(*[F.col(f"c_{a}").alias(a) for a in "xyz"]),
        "planes": planes,
    }


# ------------------------------------------------------------------ cells of the ground plan


def pole_cells(df: DataFrame, size: float, low: float, high: float, minimum_points: int = 5, checks: int = 3) -> DataFrame:
    """``cx, cy, is_pole`` of cells with enough points.

    A cell is a pole if at least ``checks`` of its 8 neighbours lie lower on
    average by more than ``low`` and less than ``high``.
    """
    cells = df.select(g.cell(F.col("x"), size).alias("cx"), g.cell(F.col("y"), size).alias("cy"), "z").groupBy("cx", "cy").agg(F.count("*").alias("n"), F.avg("z").alias("mu"))
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)])
    asked = cells.where(F.col("n") >= minimum_points).withColumn("o", F.explode(around)).select("cx", "cy", "mu", (F.col("cx") + F.col("o.dx")).alias("nx"), (F.col("cy") + F.col("o.dy")).alias("ny"))
    near = cells.select(F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("mu").alias("mn"))
    passes = (F.col("mu") > F.col("mn") + low) & (F.col("mu") < F.col("mn") + high)
    counted = asked.join(near, ["nx", "ny"], "left").groupBy("cx", "cy").agg(F.sum(F.when(passes, 1).otherwise(0)).alias("passes"))
    return counted.select("cx", "cy", (F.col("passes") >= checks).alias("is_pole"))


def by_pole(df: DataFrame, size: float, low: float, high: float, minimum_points: int = 5, checks: int = 3) -> dict[str, DataFrame]:
    """Points of pole cells and of other cells; points of cells with too few go nowhere."""
    cells = pole_cells(df, size, low, high, minimum_points, checks)
    joined = df.withColumns({"cx": g.cell(F.col("x"), size), "cy": g.cell(F.col("y"), size)}).join(cells, ["cx", "cy"])
    return {k: joined.where(F.col("is_pole") == v).select(*df.columns) for k, v in (("poles", True), ("no_poles", False))}


def occupancy(df: DataFrame, resolution: float, hit: float = 0.85, most: float = 3.5) -> DataFrame:
    """Voxels of uniform width with the log-odds of their hits added up, clamped, and as a probability; they carry their ``resolution``."""
    log_odds = F.greatest(F.lit(-most), F.least(F.lit(most), F.count("*") * F.lit(float(np.log(hit / (1 - hit))))))
    out = df.select(*[g.uniform_cell(F.col(a), resolution).cast("int").alias(f"c{a}") for a in "xyz"]).groupBy(*CELL).agg(log_odds.alias("log_odds"))
    return out.withColumn("occupancy", g.probability(F.col("log_odds"))).withColumn("resolution", F.lit(float(resolution)))


def resolution_of(voxels: DataFrame, given: float | None = None) -> float:
    """The given resolution, or else the one that the voxels carry."""
    if given is not None:
        return float(given)
    row = voxels.select("resolution").first() if "resolution" in voxels.columns else None
    if row is None:
        raise ValueError("the voxel layer does not carry its resolution, and none is given")
    return row["resolution"]


def merged(a: DataFrame, b: DataFrame, most: float = 3.5) -> DataFrame:
    """Two voxel maps of one resolution: log-odds added up and clamped."""
    both = a.select(*CELL, "log_odds", "resolution").unionByName(b.select(*CELL, "log_odds", "resolution"))
    total = F.greatest(F.lit(-most), F.least(F.lit(most), F.sum("log_odds")))
    return both.groupBy(*CELL).agg(total.alias("log_odds"), F.min("resolution").alias("resolution")).withColumn("occupancy", g.probability(F.col("log_odds"))).select(*CELL, "log_odds", "occupancy", "resolution")


def members(df: DataFrame, resolution: float) -> DataFrame:
    """``cx, cy, cz, point_ids, n``: all points of each voxel, by id."""
    return keyed(df, resolution).groupBy(*CELL).agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"), F.count("*").alias("n"))


def visited(df: DataFrame, resolution: float, visitor, schema: str) -> DataFrame:
    """What ``visitor`` makes of the points of each voxel, given and returned as a pandas table."""
    return keyed(df, resolution).groupBy(*CELL).applyInPandas(visitor, schema)


def every(df: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Every ``k``-th point by id, within the groups of ``by``, the first included; 0 gives none."""
    if not k:
        return df.where(F.lit(False))
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*(by or [])).orderBy("point_id")) - 1).where(F.col("_k") % k == 0).drop("_k")


def voxel_slice(voxels: DataFrame, resolution: float, z_min: float, z_max: float, most: float = 3.5) -> DataFrame:
    """Cells of a ground plan from the voxels between two heights, log-odds added up and clamped."""
    lo, hi = int(np.floor(z_min / resolution)), int(np.floor(z_max / resolution))
    total = F.greatest(F.lit(-most), F.least(F.lit(most), F.sum("log_odds")))
    return voxels.where(F.col("cz").between(lo, hi)).groupBy("cx", "cy").agg(total.alias("log_odds")).withColumn("occupancy", g.probability(F.col("log_odds")))


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """``bin, n`` between the column's extremes, which come from one small aggregate."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n bigint")
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def confidence_bounds(df: DataFrame, column: str, interval: float = 0.95, bins: int = 100) -> tuple[float, float] | None:
    """The bounds that leave equal tails outside, from the histogram (a row for each bin)."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return None
    counts = np.zeros(bins)
    for r in histogram(df, column, bins).collect():
        counts[r["bin"]] = r["n"]
    share = counts.cumsum() / counts.sum()
    tail, width = (1 - interval) / 2, (hi - lo) / bins
    return lo + width * int(np.searchsorted(share, tail)), min(hi, lo + width * (int(np.searchsorted(share, 1 - tail)) + 1))
