"""A map: named layers of points, lines, planes, metadata and a geographic reference.

Maps are immutable: every operation gives a new one over the same lazy
DataFrames, so a chain of operations is planned as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.se3 import Pose
from pointweave.operators.predicates import moved


@dataclass(frozen=True)
class GeoReference:
    latitude: float
    longitude: float
    height: float
    pose: tuple[float, ...] = (0.0,) * 6
    covariance: tuple[float, ...] = (0.0,) * 36


@dataclass(frozen=True)
class PointMap:
    layers: dict[str, DataFrame] = field(default_factory=dict)
    planes: DataFrame | None = None
    lines: DataFrame | None = None
    id: int | None = None
    label: str | None = None
    metadata: dict = field(default_factory=dict)
    georeference: GeoReference | None = None

    def layer(self, name: str) -> DataFrame:
        if name not in self.layers:
            raise KeyError(f"no layer named {name!r}; there are {sorted(self.layers)}")
        return self.layers[name]

    def with_layer(self, name: str, points: DataFrame, append: bool = True) -> PointMap:
        """Adds points to a layer, which is made if there is none; or puts them in its place."""
        if not name:
            raise ValueError("an output layer needs a name")
        if append and name in self.layers:
            points = self.layers[name].unionByName(points, allowMissingColumns=True)
        return replace(self, layers=dict(sorted({**self.layers, name: points}.items())))

    def without(self, *names: str, missing_ok: bool = False) -> PointMap:
        if not missing_ok:
            for n in names:
                self.layer(n)
        return replace(self, layers={k: v for k, v in self.layers.items() if k not in names})

    def renamed(self, old: str, new: str) -> PointMap:
        """Whatever was at the new name is overwritten."""
        points = self.layer(old)
        return self.without(old).with_layer(new, points, append=False)

    def merged(self, other: PointMap, pose: Pose | None = None) -> PointMap:
        """Layers of equal names together, the other's moved by ``pose``; planes and lines as well."""
        out = self
        for name, points in other.layers.items():
            out = out.with_layer(name, moved(points, pose) if pose else points)
        planes = moved_planes(other.planes, pose) if pose and other.planes is not None else other.planes
        lines = moved_lines(other.lines, pose) if pose and other.lines is not None else other.lines
        return replace(out, planes=_together(self.planes, planes), lines=_together(self.lines, lines))

    def table(self) -> DataFrame | None:
        """All layers as one table with a ``layer`` column."""
        out = None
        for name, points in self.layers.items():
            tagged = points.withColumn("layer", F.lit(name))
            out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
        return out

    def contents(self) -> DataFrame | None:
        """Number of points by layer."""
        whole = self.table()
        return None if whole is None else whole.groupBy("layer").agg(F.count("*").alias("n"))

    def size(self) -> int:
        """Points, planes and lines."""
        frames = [*self.layers.values(), *(x for x in (self.planes, self.lines) if x is not None)]
        return sum(x.count() for x in frames)

    def size_points_only(self) -> int:
        return sum(x.count() for x in self.layers.values())

    def empty(self) -> bool:
        return not self.layers and self.planes is None and self.lines is None


def _together(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    if a is None or b is None:
        return b if a is None else a
    return a.unionByName(b, allowMissingColumns=True)


def moved_planes(planes: DataFrame, pose: Pose) -> DataFrame:
    """n' = R n, d' = d - n' t, and the centroid moved."""
    turned = moved(planes.select("*", *[F.col(f"n{a}").alias(a) for a in "xyz"]), Pose(pose.rotation, pose.translation * 0)).withColumns({f"n{a}": F.col(a) for a in "xyz"})
    d = F.col("d") - sum((F.col(f"n{a}") * float(t) for a, t in zip("xyz", pose.translation, strict=True)), F.lit(0.0))
    there = moved(turned.withColumns({a: F.col(f"c_{a}") for a in "xyz"}).withColumn("d", d), pose)
    return there.withColumns({f"c_{a}": F.col(a) for a in "xyz"}).select(*planes.columns)


def moved_lines(lines: DataFrame, pose: Pose) -> DataFrame:
    base = moved(lines.withColumns({a: F.col(f"b{a}") for a in "xyz"}), pose).withColumns({f"b{a}": F.col(a) for a in "xyz"})
    turned = moved(base.withColumns({a: F.col(f"u{a}") for a in "xyz"}), Pose(pose.rotation, pose.translation * 0))
    return turned.withColumns({f"u{a}": F.col(a) for a in "xyz"}).select(*lines.columns)
