"""Readers and writers of clouds, maps and trajectories."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators.predicates import voxel_centres
from pointweave.operators.voxels import resolution_of
from pointweave.pointmap import GeoReference, PointMap

#: Columns of the text formats.
FORMATS = {"xyz": ("x", "y", "z"), "xyzi": ("x", "y", "z", "intensity"), "xyzirt": ("x", "y", "z", "intensity", "ring", "t"), "xyzrgb": ("x", "y", "z", "r", "g", "b"), "xyzrgb_normalized": ("x", "y", "z", "r", "g", "b")}


#: Columns that a line must have at least.
LEAST = {"xyz": 3, "xyzi": 4, "xyzirt": 6, "xyzrgb": 6, "xyzrgb_normalized": 6}


def read_text(spark: SparkSession, path: str, kind: str = "xyz", columns: dict[str, int] | None = None) -> DataFrame:
    """Points from lines of numbers parted by blanks, tabs or commas; ``.gz`` files are inflated.

    ``columns`` gives other places (from 0) for some names.  Colours count to
    255 unless normalized.  ``point_id`` follows the order of lines.  A line
    with too few columns is an error when it is read.
    """
    names = FORMATS[kind]
    at = {n: (columns or {}).get(n, i) for i, n in enumerate(names)}
    parts = F.split(F.trim("value"), r"[ ,\t]+")
    rows = spark.read.text(path).withColumn("point_id", F.monotonically_increasing_id()).where(F.trim("value") != "")
    least = max(at.values()) + 1 if columns else LEAST[kind]
    short = F.raise_error(F.concat(F.lit(f"fewer than {least} columns: "), "value"))
    parts = F.when(F.size(parts) >= least, parts).otherwise(short.cast("array<string>"))
    out = rows.select("point_id", *[F.get(parts, F.lit(i)).cast("int" if n == "ring" else "double").alias(n) for n, i in at.items()])
    return out.withColumns({c: F.col(c) / 255 for c in "rgb"}) if kind == "xyzrgb" else out


def read_kitti(spark: SparkSession, path: str) -> DataFrame:
    """Points of binary scans of little-endian float32 quadruples, a file at a time; ``scan`` is the file."""
    schema = "scan string, point_id bigint, x double, y double, z double, intensity double"

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                p = np.frombuffer(content.as_buffer(), "<f4").reshape(-1, 4).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(p), pa.string()), pa.array(np.arange(len(p))), *[pa.array(p[:, i]) for i in range(4)]], ["scan", "point_id", "x", "y", "z", "intensity"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def write_text(df: DataFrame, path: str) -> None:
    """A line for each point, its channels parted by blanks, in order of ``point_id`` within files.

    Of a layer of voxels the centres of the occupied ones are written; other
    tables can't be.
    """
    if "occupancy" in df.columns:
        centres = voxel_centres(df, resolution_of(df))
        centres.select("x", "y", "z").write.mode("overwrite").csv(path, sep=" ")
        return
    if not {"x", "y", "z"} <= set(df.columns):
        raise ValueError(f"not a layer of points: {df.columns}")
    names = [c for c in ("x", "y", "z", "intensity", "ring", "t") if c in df.columns]
    df.sortWithinPartitions("point_id").select(*names).write.mode("overwrite").csv(path, sep=" ")


def save_map(m: PointMap, path: str) -> None:
    """Layers as one Parquet table by layer, planes and lines beside it, and the rest as JSON."""
    spark = None
    whole = m.table()
    if whole is not None:
        spark = whole.sparkSession
        whole.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/points")
    for name, frame in (("planes", m.planes), ("lines", m.lines)):
        if frame is not None:
            spark = frame.sparkSession
            frame.write.mode("overwrite").parquet(f"{path}/{name}")
    geo = m.georeference and vars(m.georeference)
    head = {"id": m.id, "label": m.label, "metadata": m.metadata, "georeference": geo, "layers": sorted(m.layers), "columns": {k: v.columns for k, v in m.layers.items()}, "planes": m.planes is not None, "lines": m.lines is not None}
    if spark is None:
        raise ValueError("an empty map has nothing to save")
    spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").json(f"{path}/head")


def load_map(spark: SparkSession, path: str) -> PointMap:
    """What :func:`save_map` wrote; a layer's files alone are read for it."""
    head = json.loads(spark.read.schema("head string").json(f"{path}/head").first()["head"])
    whole = spark.read.parquet(f"{path}/points") if head["layers"] else None
    layers = {k: whole.where(F.col("layer") == k).select(*head["columns"][k]) for k in head["layers"]}
    side = {k: spark.read.parquet(f"{path}/{k}") if head[k] else None for k in ("planes", "lines")}
    geo = head["georeference"]
    return PointMap(layers, side["planes"], side["lines"], head["id"], head["label"], head["metadata"], geo and GeoReference(**{k: tuple(v) if isinstance(v, list) else v for k, v in geo.items()}))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``t x y z qx qy qz qw``."""
    names = ("t", "x", "y", "z", "qx", "qy", "qz", "qw")
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*[F.get(parts, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])


def write_trajectory(poses: DataFrame, path: str) -> None:
    """Poses ``t, x, y, z, yaw, pitch, roll`` as such lines, in order of time."""
    h = {k: F.col(k) / 2 for k in ("yaw", "pitch", "roll")}
    c, s = {k: F.cos(v) for k, v in h.items()}, {k: F.sin(v) for k, v in h.items()}
    q = {
        "qx": s["roll"] * c["pitch"] * c["yaw"] - c["roll"] * s["pitch"] * s["yaw"],
        "qy": c["roll"] * s["pitch"] * c["yaw"] + s["roll"] * c["pitch"] * s["yaw"],
        "qz": c["roll"] * c["pitch"] * s["yaw"] - s["roll"] * s["pitch"] * c["yaw"],
        "qw": c["roll"] * c["pitch"] * c["yaw"] + s["roll"] * s["pitch"] * s["yaw"],
    }
    poses.withColumns(q).repartitionByRange("t").sortWithinPartitions("t").select("t", "x", "y", "z", *q).write.mode("overwrite").csv(path, sep=" ")


def georeference_yaml(ref: GeoReference) -> str:
    import yaml

    return yaml.safe_dump({"type": "georeference", "defined": True, "latitude": ref.latitude, "longitude": ref.longitude, "height": ref.height, "pose": list(ref.pose), "covariance": list(ref.covariance)})


def georeference_from_yaml(text: str) -> GeoReference | None:
    import yaml

    d = yaml.safe_load(text)
    if not isinstance(d, dict) or d.get("type") != "georeference":
        raise ValueError("not a geographic reference")
    return GeoReference(d["latitude"], d["longitude"], d["height"], tuple(d["pose"]), tuple(d["covariance"])) if d["defined"] else None


def open_cloud(spark: SparkSession, name: str) -> DataFrame | PointMap:
    """A cloud or map by its file name."""
    if name.endswith(".icplog") or ".icplog:" in name:  # one side of a registration's log, the local one by default
        path, _, side = name.partition(".icplog:")
        return load_map(spark, f"{path if side else name}{'.icplog' if side else ''}/{side or 'local'}")
    if name.endswith((".txt", ".xyz", ".txt.gz", ".xyz.gz", ".csv", ".csv.gz")):
        return read_text(spark, name)
    if name.endswith(".bin"):
        return read_kitti(spark, name)
    return load_map(spark, name)


def write_twists(twists: DataFrame, path: str) -> None:
    """Lines ``t vx vy vz wx wy wz`` in order of time."""
    twists.repartitionByRange("t").sortWithinPartitions("t").select("t", "vx", "vy", "vz", "wx", "wy", "wz").write.mode("overwrite").csv(path, sep=" ")
