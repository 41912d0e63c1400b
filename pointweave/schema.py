"""The point table and the names of its columns.

A layer is a DataFrame of points.  ``point_id`` stands for the row order of a
file, which operators that keep "the first" refer to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT = "point_id bigint, x double, y double, z double, intensity double, ring int, t double, r double, g double, b double, kf_id bigint"
CHANNELS = ("intensity", "ring", "t", "r", "g", "b", "kf_id")
RAW, PLANE_CENTROIDS = "raw", "plane_centroids"


def require(df: DataFrame, *columns: str) -> None:
    """Raises if a channel that an operator needs isn't there."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"the layer has no channel {', '.join(missing)}")


def has_values(df: DataFrame, column: str) -> bool:
    """Whether a channel is there and not null throughout."""
    return column in df.columns and bool(df.where(F.col(column).isNotNull()).limit(1).count())


def empty_like(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))
