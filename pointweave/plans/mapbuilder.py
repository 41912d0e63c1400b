"""Maps from keyframes: generators, filters for each observation, final filters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from pointweave.operators import keyframes, ordered, voxels
from pointweave.plans import pipeline
from pointweave.plans.expressions import realised
from pointweave.plans.registry import GENERATORS, lookup, registered
from pointweave.pointmap import PointMap
from pointweave.schema import POINT


@registered(GENERATORS, "Generator")
def _points(p: dict, points: DataFrame) -> DataFrame:
    """The points of the observations as they are."""
    return points


@registered(GENERATORS, "GeneratorEdgesFromCurvature")
def _bends(p: dict, points: DataFrame) -> DataFrame:
    """Points at which a row of a rotating scan bends; needs ``row, col, range``."""
    return ordered.edges_from_curvature(points.withColumn("scan_id", F.col("obs_id")), p.get("max_cosine", 0.5), p.get("min_point_clearance", 0.10)).drop("scan_id")


@registered(GENERATORS, "GeneratorEdgesFromRangeImage")
def _steps(p: dict, points: DataFrame) -> DataFrame:
    """Points at which a row's range jumps; needs ``row, col, range``."""
    return ordered.edges_from_ranges(points.withColumn("scan_id", F.col("obs_id")), p["score_threshold"]).drop("scan_id")


def empty_layer(spark, definition: Mapping) -> DataFrame:
    """A layer without content: points, or voxels of a resolution, told by the definition's ``class``."""
    kind = str(definition.get("class", "points")).rpartition("::")[2].lower()
    if "voxel" in kind or "occ" in kind:
        size = realised(definition.get("resolution", (definition.get("creationOpts") or {}).get("resolution", 1.0)))
        return voxels.occupancy(spark.createDataFrame([], POINT), size)
    return spark.createDataFrame([], POINT)


def generated(m: PointMap, entries: list[dict] | None, kfs: DataFrame, obs: DataFrame, points: DataFrame, variables: Mapping[str, float] | None = None) -> PointMap:
    """``m`` with the layers that the generators fill from observations, in the map's frame and with ``obs_id``.

    A generator with ``metric_map_definition`` makes its layer first, so that
    one whose pattern matches nothing leaves it empty; into a layer of voxels
    the points go as hits.  With ``throw_on_unhandled_observation_class`` an
    observation that no generator takes is an error.
    """
    names = ["obs_id", *points.columns] if "obs_id" not in points.columns else points.columns
    handled = None
    strict = False
    for entry in entries or [{"class_name": "Generator", "params": {}}]:
        make, params = lookup(GENERATORS, {"class_name": "Generator"} | entry)
        p = realised(params, variables)
        target = p.get("target_layer", "raw")
        own = keyframes.matching(obs, p.get("process_class_names_regex", ".*"), p.get("process_sensor_labels_regex", ".*"))
        strict = strict or bool(p.get("throw_on_unhandled_observation_class"))
        handled = own.select("obs_id") if handled is None else handled.unionByName(own.select("obs_id"))
        if definition := p.get("metric_map_definition"):
            if target not in m.layers:
                m = m.with_layer(target, empty_layer(obs.sparkSession, definition))
        mine = keyframes.generate(make(p, points.join(own.select("obs_id", "kf_id"), "obs_id")), kfs)
        if target in m.layers and "log_odds" in m.layers[target].columns:
            size = realised((definition or {}).get("resolution", ((definition or {}).get("creationOpts") or {}).get("resolution", 1.0)))
            m = m.with_layer(target, voxels.merged(m.layers[target], voxels.occupancy(mine, size)), append=False)
        else:
            m = m.with_layer(target, mine.select(*[c for c in mine.columns if c in names or c in ("kf_id", "x", "y", "z")]))
    if strict and (left := keyframes.matching(obs).join(handled, "obs_id", "left_anti").select("class").first()):
        raise ValueError(f"no generator takes observations of class {left['class']!r}")
    return m


def _with_variables(m: PointMap, kfs: DataFrame) -> PointMap:
    """Layers with the pose and twist of each point's keyframe in the columns that parameters may name."""
    have = {"robot_" + k: F.col(k) for k in keyframes.POSE} | {k: F.col(k) for k in ("vx", "vy", "vz", "wx", "wy", "wz") if k in kfs.columns}
    own = kfs.select("kf_id", *[v.alias(k) for k, v in have.items()])
    return PointMap({k: v.join(own, "kf_id") if "kf_id" in v.columns else v for k, v in m.layers.items()}, m.planes, m.lines, m.id, m.label, m.metadata, m.georeference)


def _without_variables(m: PointMap) -> PointMap:
    return PointMap({k: v.drop(*pipeline.VARIABLES) for k, v in m.layers.items()}, m.planes, m.lines, m.id, m.label, m.metadata, m.georeference)


def build(kfs: DataFrame, obs: DataFrame, points: DataFrame, config: dict, variables: dict[str, float] | None = None) -> PointMap:
    """Points of all matching observations in the map's frame, ``filters`` over each observation, ``final_filters`` over the map.

    All observations are one query: within ``filters`` what an operator looks
    at together (voxels, extremes of time, rings) is one observation's, and
    parameters may name the pose (``robot_x`` and so on) and the twist (``vx`` and so on) of its
    keyframe.  ``points`` has ``obs_id`` and the point columns.
    """
    m = generated(PointMap(), config.get("generators"), kfs, obs, points, variables)
    if config.get("filters"):
        m = _with_variables(m, kfs)
        token = pipeline.SCOPE.set(("obs_id",))
        try:
            m = pipeline.applied(pipeline.filters(config["filters"], variables), m)
        finally:
            pipeline.SCOPE.reset(token)
        m = _without_variables(m)
    return pipeline.applied(pipeline.filters(config.get("final_filters"), variables), m)


def scans(kfs: DataFrame, obs: DataFrame, points: DataFrame, config: dict, variables: dict[str, float] | None = None) -> DataFrame:
    """For each observation the layers that its generators and filters make, as one table: ``obs_id, out_layer, points``.

    The points are in the vehicle's frame; layers are named ``out_<layer>``.
    """
    still = kfs.select("kf_id", *[F.lit(0.0).alias(k) for k in keyframes.POSE])
    whole = build(still, obs, points, config, variables).table()
    return whole.withColumn("out_layer", F.concat(F.lit("out_"), "layer")).drop("layer")


def entry(obs: DataFrame, name: str) -> DataFrame:
    """The observations of entry N of a log, as ``<log>:N`` names it; entries count from 0 by keyframe."""
    n = int(name.rpartition(":")[2])
    order = obs.select("kf_id").distinct().orderBy("kf_id").limit(n + 1)
    last = order.agg(F.max("kf_id").alias("kf_id"), F.count("*").alias("_n")).where(F.col("_n") == n + 1).select("kf_id")
    return obs.join(F.broadcast(last), "kf_id")  # one row


