"""Filter pipelines from configuration: a fold of map-to-map functions over lazy DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.se3 import Pose
from pointweave.operators import ordered, predicates, voxels
from pointweave.plans.expressions import realised
from pointweave.plans.registry import FILTERS, lookup, registered
from pointweave.pointmap import PointMap

Filter = Callable[[PointMap], PointMap]
#: Columns by which the filters group what they look at together; the builder sets it to a layer's observations.
SCOPE: ContextVar[tuple[str, ...]] = ContextVar("scope", default=())
#: Columns that a builder adds for parameters that depend on the keyframe.
VARIABLES = ("robot_x", "robot_y", "robot_z", "robot_yaw", "robot_pitch", "robot_roll", "vx", "vy", "vz", "wx", "wy", "wz")


def scope(df: DataFrame, supported: bool = True) -> list[str]:
    """The columns by which ``df`` is looked at in parts; an operator that can't do so refuses."""
    by = [c for c in SCOPE.get() if c in df.columns]
    if by and not supported:
        raise ValueError("this filter works on whole maps only; put it among the final filters")
    return by


def _outputs(m: PointMap, parts: Mapping[str, DataFrame], names: Mapping[str, str | None]) -> PointMap:
    """Puts the named parts into their layers; parts without a name are dropped, and one name at least is needed."""
    wanted = {k: n for k, n in names.items() if n}
    if not wanted:
        raise ValueError(f"name at least one of the outputs {', '.join(names)}")
    for k, n in wanted.items():
        m = m.with_layer(n, parts[k])
    return m


def _pose(values) -> Pose:
    v = [float(x) for x in values]
    return Pose.of(*v)


@registered(FILTERS, "FilterByRange")
def _by_range(m: PointMap, p: dict) -> PointMap:
    parts = predicates.by_range(m.layer(p["input_pointcloud_layer"]), p["range_min"], p["range_max"], tuple(p.get("center", (0.0, 0.0, 0.0))))
    return _outputs(m, parts, {"between": p.get("output_layer_between"), "outside": p.get("output_layer_outside")})


@registered(FILTERS, "FilterBoundingBox")
def _by_box(m: PointMap, p: dict) -> PointMap:
    parts = predicates.by_box(m.layer(p.get("input_pointcloud_layer", "raw")), tuple(p["bounding_box_min"]), tuple(p["bounding_box_max"]))
    return _outputs(m, parts, {"inside": p.get("inside_pointcloud_layer"), "outside": p.get("outside_pointcloud_layer")})


@registered(FILTERS, "FilterByIntensity")
def _by_intensity(m: PointMap, p: dict) -> PointMap:
    parts = predicates.by_intensity(m.layer(p["input_pointcloud_layer"]), p["low_threshold"], p["high_threshold"])
    return _outputs(m, parts, {k: p.get(f"output_layer_{k}_intensity") for k in ("low", "mid", "high")})


@registered(FILTERS, "FilterByRing")
def _by_ring(m: PointMap, p: dict) -> PointMap:
    rings = p["selected_ring_ids"]
    parts = predicates.by_ring(m.layer(p["input_pointcloud_layer"]), [int(r) for r in (rings if isinstance(rings, list) else [rings])])
    return _outputs(m, parts, {k: p.get(f"output_layer_{k}") for k in ("selected", "non_selected")})


@registered(FILTERS, "FilterRemoveByVoxelOccupancy")
def _by_occupancy(m: PointMap, p: dict) -> PointMap:
    voxel_layer = m.layer(p["input_voxel_layer"])
    parts = predicates.by_occupancy(m.layer(p["input_pointcloud_layer"]), voxel_layer, voxels.resolution_of(voxel_layer, p.get("resolution")), p["occupancy_threshold"])
    return _outputs(m, parts, {k: p.get(f"output_layer_{k}_objects") for k in ("static", "dynamic")})


_TIME_METHODS = {"EarliestIsZero": "earliest_is_zero", "MiddleIsZero": "middle_is_zero", "Normalize": "normalize"}


@registered(FILTERS, "FilterAdjustTimestamps")
def _adjust_timestamps(m: PointMap, p: dict) -> PointMap:
    name = p["pointcloud_layer"]
    if "t" not in m.layer(name).columns and p.get("silently_ignore_no_timestamps"):
        return m
    method = _TIME_METHODS[p["method"].rpartition("::")[2]]
    return m.with_layer(name, predicates.adjust_timestamps(m.layer(name), method, p.get("time_offset", 0.0), scope(m.layer(name))), append=False)


@registered(FILTERS, "FilterNormalizeIntensity")
def _normalize_intensity(m: PointMap, p: dict) -> PointMap:
    name, most = p["pointcloud_layer"], p.get("fixed_maximum_intensity", 0)
    fixed = (p.get("fixed_minimum_intensity", 0), most) if most > 0 else None
    remember = "kf_id" if p.get("remember_intensity_range") else None
    return m.with_layer(name, predicates.normalize_intensity(m.layer(name), fixed, remember, scope(m.layer(name))), append=False)


@registered(FILTERS, "FilterDeskew")
def _deskew(m: PointMap, p: dict) -> PointMap:
    out = predicates.deskew(m.layer(p["input_pointcloud_layer"]), tuple(v if isinstance(v, Column) else float(v) for v in p.get("twist", [0.0] * 6)), p.get("silently_ignore_no_timestamps", False), p.get("skip_deskew", False))
    return m.with_layer(p["output_pointcloud_layer"], out)


_VOXEL_METHODS = {"FirstPoint": "first", "ClosestToAverage": "closest", "VoxelAverage": "mean", "RandomPoint": "random"}


@registered(FILTERS, "FilterDecimateVoxels")
def _decimate(m: PointMap, p: dict) -> PointMap:
    names = p.get("input_pointcloud_layer", "raw")
    names = names if isinstance(names, list) else [names]
    if p.get("error_on_missing_input_layer", True):
        for n in names:
            m.layer(n)
    layers = [m.layers[n] for n in names if n in m.layers]
    if not layers:
        raise KeyError(f"none of the layers {names} is there")
    method = _VOXEL_METHODS[p["decimate_method"].rpartition("::")[2]]
    if len(layers) > 1:
        if method != "first":
            raise ValueError("several layers go with the first point only")
        if p.get("flatten_to") is not None:
            raise ValueError("several layers can't be flattened")
        scope(layers[0], supported=False)
        out = voxels.first_of_layers(layers, p["voxel_filter_resolution"])
    else:
        out = voxels.decimated(layers[0], p["voxel_filter_resolution"], method, flatten_to=p.get("flatten_to"), minimum_points=int(p.get("minimum_input_points_to_filter", 0)), by=scope(layers[0]))
    return m.with_layer(p["output_pointcloud_layer"], out.drop(*voxels.CELL, "n"))


@registered(FILTERS, "FilterDecimateVoxelsQuadratic")
def _decimate_quadratic(m: PointMap, p: dict) -> PointMap:
    flags = {"mean": p.get("use_voxel_average"), "closest": p.get("use_closest_to_voxel_average"), "random": p.get("use_random_point_within_voxel")}
    method = next((k for k, v in flags.items() if v), "first")
    key = voxels.quadratic_key(p["quadratic_reference_radius"])
    layer = m.layer(p.get("input_pointcloud_layer", "raw"))
    out = voxels.decimated(layer, p["voxel_filter_resolution"], method, key, by=scope(layer))
    return m.with_layer(p["output_pointcloud_layer"], out.drop(*voxels.CELL, "n"))


@registered(FILTERS, "FilterDecimateAdaptive")
def _decimate_adaptive(m: PointMap, p: dict) -> PointMap:
    if not p.get("enabled", True):
        return m
    scope(m.layer(p.get("input_pointcloud_layer", "raw")), supported=False)
    out = voxels.adaptive(
        m.layer(p.get("input_pointcloud_layer", "raw")),
        int(p["desired_output_point_count"]),
        p.get("assumed_minimum_pointcloud_bbox", 10.0),
        int(p.get("maximum_voxel_count_per_dimension", 100)),
        int(p.get("minimum_input_points_per_voxel", 1)),
    )
    return m.with_layer(p["output_pointcloud_layer"], out)


@registered(FILTERS, "FilterEdgesPlanes")
def _edges_planes(m: PointMap, p: dict) -> PointMap:
    parts = voxels.edges_planes(
        m.layer(p.get("input_pointcloud_layer", "raw")), p["voxel_filter_resolution"], int(p["voxel_filter_decimation"]), int(p["full_pointcloud_decimation"]), p["voxel_filter_max_e2_e0"], p["voxel_filter_min_e2_e0"], p.get("voxel_filter_min_e1", 0.0),
        p.get("voxel_filter_max_e1_e0"), p.get("voxel_filter_min_e1_e0"), scope(m.layer(p.get("input_pointcloud_layer", "raw"))),
    )
    for name in ("edge_points", "plane_points", "full_decim", "plane_centroids"):
        m = m.with_layer(name, parts[name], append=False)
    return PointMap(m.layers, parts["planes"], m.lines, m.id, m.label, m.metadata, m.georeference)


@registered(FILTERS, "FilterPoleDetector")
def _poles(m: PointMap, p: dict) -> PointMap:
    scope(m.layer(p["input_pointcloud_layer"]), supported=False)
    parts = voxels.by_pole(m.layer(p["input_pointcloud_layer"]), p["grid_size"], p["minimum_relative_height"], p["maximum_relative_height"], int(p.get("minimum_pole_points", 5)), int(p.get("minimum_neighbors_checks_to_pass", 3)))
    return _outputs(m, parts, {k: p.get(f"output_layer_{k}") for k in ("poles", "no_poles")})


@registered(FILTERS, "FilterVoxelSlice")
def _slice(m: PointMap, p: dict) -> PointMap:
    if p["slice_z_max"] < p["slice_z_min"]:
        raise ValueError("the slice's upper end lies below its lower one")
    return m.with_layer(p["output_layer"], voxels.voxel_slice(m.layer(p["input_layer"]), voxels.resolution_of(m.layer(p["input_layer"]), p.get("resolution")), p["slice_z_min"], p["slice_z_max"]), append=False)


@registered(FILTERS, "FilterCurvature")
def _curvature(m: PointMap, p: dict) -> PointMap:
    src = m.layer(p["input_pointcloud_layer"])
    marked = ordered.curvature(src, p["max_cosine"], p["min_clearance"], p["max_gap"])
    parts = {k: marked.where(F.col("class") == k).drop("class") for k in ("larger", "smaller", "other")}
    return _outputs(m, parts, {"larger": p.get("output_layer_larger_curvature"), "smaller": p.get("output_layer_smaller_curvature"), "other": p.get("output_layer_other")})


@registered(FILTERS, "FilterMerge")
def _merge(m: PointMap, p: dict) -> PointMap:
    points = m.layer(p["input_pointcloud_layer"])
    pose = _pose(p.get("robot_pose", [0.0] * 6))
    there = predicates.moved(points, pose) if p.get("input_layer_in_local_coordinates") else points
    m.layer(p["target_layer"])
    if "log_odds" in m.layer(p["target_layer"]).columns:  # a voxel map: its log-odds and the new hits' add up
        target = m.layer(p["target_layer"])
        new = voxels.occupancy(there, voxels.resolution_of(target, p.get("resolution")))
        return m.with_layer(p["target_layer"], voxels.merged(target.withColumn("resolution", F.lit(voxels.resolution_of(target, p.get("resolution")))), new), append=False)
    return m.with_layer(p["target_layer"], there)


@registered(FILTERS, "FilterDeleteLayer")
def _delete(m: PointMap, p: dict) -> PointMap:
    names = p["pointcloud_layer_to_remove"]
    return m.without(*(names if isinstance(names, list) else [names]), missing_ok=not p.get("error_on_missing_input_layer", True))


#: Seconds that the driver spent on planning, by filter, and its number of runs.
PROFILE: dict[str, tuple[float, int]] = {}


def _timed(name: str, step: Filter) -> Filter:
    def run(m: PointMap) -> PointMap:
        began = time.perf_counter()
        try:
            return step(m)
        finally:
            spent, n = PROFILE.get(name, (0.0, 0))
            PROFILE[name] = (spent + time.perf_counter() - began, n + 1)

    return run


def filters(entries: list[dict] | None, variables: Mapping[str, float] | None = None) -> list[Filter]:
    """The filters of a list of entries; expressions in parameters get their values now."""
    out: list[Filter] = []
    for e in entries or []:
        f, params = lookup(FILTERS, e)
        out.append(_timed(e.get("class_name") or e.get("class"), lambda m, f=f, params=realised(params, variables, VARIABLES): f(m, params)))
    return out


def applied(steps: list[Filter], m: PointMap) -> PointMap:
    return reduce(lambda x, f: f(x), steps, m)


def from_yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text) or {}


def run_yaml(text: str, m: PointMap, entry: str = "filters", variables: Mapping[str, float] | None = None) -> PointMap:
    """The named list of filters of a YAML document over a map."""
    return applied(filters(from_yaml(text).get(entry), variables), m)
