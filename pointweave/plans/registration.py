"""Registration from configuration: matchers, solvers, evaluators and parameters by name; its log."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from pointweave.functions.se3 import Pose
from pointweave.operators import neighbours, quality, voxels
from pointweave.plans import icp, pipeline
from pointweave.plans.expressions import realised
from pointweave.plans.registry import EVALUATORS, MATCHERS, SOLVERS, lookup, registered
from pointweave.pointmap import PointMap


def _common(p: dict, m: icp.Matcher, reuse_global: bool = False) -> icp.Matcher:
    """What all matchers share: layers and weights, what may be matched again, and samples."""
    m.layers = [(x["global"], x["local"], float(x.get("weight", 1.0))) for x in p.get("pointLayerMatches") or []]
    m.reuse_local = bool(p.get("allowMatchAlreadyMatchedPoints", False))
    m.reuse_global = bool(p.get("allowMatchAlreadyMatchedGlobalPoints", reuse_global))
    m.most, m.seed = int(p.get("maxLocalPointsPerLayer", 0)), int(p.get("localPointsSampleSeed", 0))
    return m


@registered(MATCHERS, "Matcher_Points_DistanceThreshold")
def _distance(p: dict) -> icp.Matcher:
    return _common(p, icp.distance_matcher(p["threshold"], p.get("thresholdAngularDeg", 0.5), int(p.get("pairingsPerPoint", 1)), p.get("allowMatchAlreadyMatchedGlobalPoints", False)))


@registered(MATCHERS, "Matcher_Points_InlierRatio")
def _inliers(p: dict) -> icp.Matcher:
    return _common(p, icp.inlier_matcher(p["inliersRatio"]))


@registered(MATCHERS, "Matcher_Point2Plane")
def _planes(p: dict) -> icp.Matcher:
    own = {"distance": p["distanceThreshold"], "radius": p.get("searchRadius", 1.0), "knn": int(p.get("knn", 8)), "eigen_threshold": p.get("planeEigenThreshold", 0.01), "minimum_points": int(p.get("minimumPlanePoints", 4))}
    return _common(p, icp.plane_matcher(**own), True)


@registered(MATCHERS, "Matcher_Point2Line")
def _lines(p: dict) -> icp.Matcher:
    return _common(p, icp.line_matcher(distance=p["distanceThreshold"], knn=int(p["knn"]), eigen_threshold=p["lineEigenThreshold"], minimum_points=int(p["minimumLinePoints"])), True)


@registered(MATCHERS, "Matcher_Adaptive")
def _adaptive(p: dict) -> icp.Matcher:
    most = int(p.get("maxPt2PtCorrespondences", 1))
    planes = bool(p.get("enableDetectPlanes", False))

    def run(local: DataFrame, world: DataFrame, pose: Pose) -> icp.Pairs:
        points, flat = neighbours.match_adaptive(
            local, world, pose, p["confidenceInterval"], p["firstToSecondDistanceMax"], p["absoluteMaxSearchDistance"], planes, p.get("minimumCorrDist", 0.1),
            int(p.get("planeSearchPoints", 8)), int(p.get("planeMinimumFoundPoints", 4)), p.get("planeEigenThreshold", 0.01), most, p.get("planeMinimumDistance", 0.10),
        )
        return {"pt2pt": points} | ({"pt2pl": flat} if flat is not None else {})

    return _common(p, icp.Matcher(run, most), True)


_KINDS = {"pt2pt": "pt2pt", "pt2pl": "pt2pl", "pt2ln": "pt2ln", "pl2pl": "pl2pl"}


def _weights(p: dict) -> dict[str, float]:
    return {_KINDS[k]: float(v) for k, v in (p.get("pair_weights") or {}).items() if k in _KINDS}


def _closed_form(p: dict) -> dict:
    own = p.get("pairingsWeightParameters") or {}
    return {
        "outliers": float(own.get("scale_outlier_threshold", 1.20)) if own.get("use_scale_outlier_detector") else None,
        "kernel": str(own.get("robust_kernel", "None")).rpartition("::")[2],
        "c": float(own.get("robust_kernel_param", 1.0)),
        "weight": _weights(own).get("pt2pt", 1.0),
    }


@registered(SOLVERS, "Solver_Horn")
def _horn(p: dict) -> icp.Solver:
    return icp.horn(**_closed_form(p))


@registered(SOLVERS, "Solver_OLAE")
def _olae(p: dict) -> icp.Solver:
    return icp.olae(_closed_form(p)["outliers"])


@registered(SOLVERS, "Solver_GaussNewton")
def _gauss_newton(p: dict) -> icp.Solver:
    prior = p.get("prior")
    known = (Pose.of(*map(float, prior["mean"])), np.array(prior["information"], float).reshape(6, 6)) if prior else None
    return icp.gauss_newton_solver(int(p["maxIterations"]), str(p.get("robustKernel", "None")).rpartition("::")[2], p.get("robustKernelParam", 1.0), known, _weights(p) or None)


@registered(EVALUATORS, "QualityEvaluator_PairedRatio")
def _ratio(p: dict):
    """The last iteration's pairs, or with ``reuse_icp_pairings`` off those of matchers of its own at the final pose."""
    minimum = p.get("absolute_minimum_pairing_ratio", 0.20)
    if p.get("reuse_icp_pairings", True):
        return lambda local, world, result: quality.paired_ratio(result.n_pairs, result.potential, minimum)
    own = [make(params) for make, params in (lookup(MATCHERS, e) for e in p["matchers"])]
    for m in own:
        m.reuse_global = True

    def fresh(local, world, result):
        pairs, potential = icp.matched(own, local, world, result.pose)
        return quality.paired_ratio(sum(x.count() for x in pairs.values()), potential, minimum)

    return fresh


@registered(EVALUATORS, "QualityEvaluator_RangeImageSimilarity")
def _ranges(p: dict):
    camera = {k: p[k] for k in ("ncols", "nrows", "fx", "fy", "cx", "cy")}
    name = p.get("layer")

    def run(local, world, result):
        a, b = (x[name] if name else next(iter(x.values())) for x in (local, world))
        return quality.range_image_score(a, b, result.pose, camera, p.get("sigma", 0.1), p.get("penalty_not_visible", 2.0)).first()["score"], False

    return run


@registered(EVALUATORS, "QualityEvaluator_Voxels")
def _voxels(p: dict):
    name = p["voxel_layer_name"]

    def run(local, world, result):
        a, b = local[name], world[name]
        size = voxels.resolution_of(b, p.get("resolution"))
        return quality.voxel_quality(a, b, result.pose, size, p.get("dist2quality_scale", 2.0)).first()["quality"], False

    return run


@dataclass
class Registration:
    """A configured registration of one map onto another."""

    matchers: list[tuple[icp.Matcher | icp.Dynamic, icp.Gate]]
    solvers: list[tuple[icp.Solver, icp.Gate]]
    evaluators: list[tuple[Callable, float]]
    parameters: icp.Parameters
    local_filters: list[pipeline.Filter] = field(default_factory=list)
    global_filters: list[pipeline.Filter] = field(default_factory=list)
    variables: dict[str, float] = field(default_factory=dict)

    def run(self, local: PointMap, world: PointMap, start: Pose | None = None, layer: str = "raw", hook=None) -> icp.Result:
        """With ``pointLayerMatches`` the layers that they name are matched, else ``layer``."""
        a, b = pipeline.applied(self.local_filters, local), pipeline.applied(self.global_filters, world)
        named = any((m.at(0) if isinstance(m, icp.Dynamic) else m).layers for m, _ in self.matchers)
        sides = (a.layers, b.layers) if named else ({layer: a.layer(layer)}, {layer: b.layer(layer)})
        points = [{k: v for k, v in x.items() if "point_id" in v.columns} for x in sides]
        out = icp.align(*points, start, self.matchers, self.solvers, self.parameters, hook)
        if self.evaluators and out.n_pairs:
            scores = [(f({**a.layers, **points[0]}, {**b.layers, **points[1]}, out) if not named else f(a.layers, b.layers, out), w) for f, w in self.evaluators]
            out.quality = quality.combined([(score, w, discard) for (score, discard), w in scores])
        return out


def _gate(e: dict, p: dict) -> icp.Gate:
    return icp.Gate(bool(e.get("enabled", p.get("enabled", True))), int(p.get("runFromIteration", 0)), int(p.get("runUpToIteration", 0)))


def _matchers(entries: list[dict] | None, variables: Mapping[str, float]) -> list:
    """Matchers; those whose parameters name ``ICP_ITERATION`` are made anew in each iteration."""
    out = []
    for e in entries or []:
        make, params = lookup(MATCHERS, e)
        first = realised(params, {**variables, "ICP_ITERATION": 0})
        if "ICP_ITERATION" in json.dumps(params, default=str):
            own = icp.Dynamic(lambda i, make=make, params=params: make(realised(params, {**variables, "ICP_ITERATION": i})))
        else:
            own = make(first)
        out.append((own, _gate(e, first)))
    return out


def from_config(config: dict, variables: Mapping[str, float] | None = None) -> Registration:
    """From {params, matchers, solvers, quality, filters or local_filters and global_filters}."""
    p = config.get("params") or {}
    known = dict(variables or {})
    defaults = icp.Parameters()
    checks = {int(c["iteration"]): float(c["minimum_quality"]) for c in p.get("quality_checkpoints", [])} or defaults.checkpoints
    parameters = icp.Parameters(int(p.get("maxIterations", defaults.max_iterations)), p.get("minAbsStep_trans", defaults.min_step_translation), p.get("minAbsStep_rot", defaults.min_step_rotation), checks)
    evaluators = []
    for e in config.get("quality") or []:
        make, params = lookup(EVALUATORS, e)
        evaluators.append((make(realised(params, known)), float(e.get("weight", 1.0))))
    solver_list = []
    for e in config.get("solvers") or []:
        make, params = lookup(SOLVERS, e)
        own = realised(params, known)
        solver_list.append((make(own), _gate(e, own)))
    both = config.get("filters")
    return Registration(
        _matchers(config.get("matchers"), known),
        solver_list,
        evaluators,
        parameters,
        pipeline.filters(config.get("local_filters", both), known),
        pipeline.filters(config.get("global_filters", both), known),
        known,
    )


def log(spark, result: icp.Result, path: str, run_id: str) -> None:
    """Appends the iterations of a run to a Parquet log."""
    rows = [(run_id, i, *map(float, pose.values()), n, result.reason, float(result.quality)) for i, pose, n in result.trace]
    schema = "run_id string, iteration int, x double, y double, z double, yaw double, pitch double, roll double, n_pairs bigint, reason string, quality double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def read_log(spark, path: str, run_id: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if run_id is None else out.where(out["run_id"] == run_id)


def log_run(spark, folder: str, result: icp.Result, local: PointMap, world: PointMap, registration: Registration, number: int = 0, every: int = 1, name: str = "log-{number}-{local}-{world}", before: list[Callable[[PointMap], PointMap]] | None = None) -> str | None:
    """A record of a run: both maps, its first guess, parameters, variables, result and iterations.

    ``name`` may hold the run's number and the maps' labels; of runs only every
    ``every``-th is kept (None is returned for others).  ``before`` changes
    what is kept of the maps, not the maps.
    """
    from pointweave.sources import files

    if every > 1 and number % every:
        return None
    path = f"{folder}/{name.format(number=number, local=local.label or local.id or 'local', world=world.label or world.id or 'world')}"
    for side, m in (("local", local), ("world", world)):
        for change in before or []:
            m = change(m)
        files.save_map(m, f"{path}/{side}")
    log(spark, result, f"{path}/iterations", str(number))
    head = {
        "guess": list(map(float, (result.start or Pose.identity()).values())), "pose": list(map(float, result.pose.values())), "covariance": np.asarray(result.covariance).ravel().tolist(),
        "reason": result.reason, "quality": float(result.quality), "iterations": result.iterations, "n_pairs": result.n_pairs, "parameters": vars(registration.parameters), "variables": registration.variables,
    }
    spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").json(f"{path}/head")
    return path


def read_run(spark, path: str) -> dict:
    """What :func:`log_run` kept: its head, ``local`` and ``world`` maps and ``iterations``."""
    from pointweave.sources import files

    head = json.loads(spark.read.schema("head string").json(f"{path}/head").first()["head"])
    return head | {"local": files.load_map(spark, f"{path}/local"), "world": files.load_map(spark, f"{path}/world"), "trace": spark.read.parquet(f"{path}/iterations")}


def summary(result: icp.Result) -> str:
    deg = np.degrees(result.pose.values()[3:])
    place = " ".join(f"{v:.4f}" for v in [*result.pose.values()[:3], *deg])
    return f"pose [{place}] (degrees), quality {100 * result.quality:.2f} %, {result.iterations} iterations, {result.reason}, {result.n_pairs} pairs"
