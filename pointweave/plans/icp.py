"""Registration of two maps: match, solve, move, until nothing moves.

The global side is kept for all iterations; each iteration is one join and
one aggregate, of which a few sums come to the driver.  A cloud is one layer or
several by name; pairs are point to point, to line and to plane.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.functions.se3 import Pose, se3_log
from pointweave.operators import neighbours, quality, solvers


@dataclass
class Parameters:
    max_iterations: int = 40
    min_step_translation: float = 5e-4
    min_step_rotation: float = 1e-4
    checkpoints: dict[int, float] = field(default_factory=lambda: {50: 0.05, 100: 0.10})


@dataclass
class Gate:
    """In which iterations an operator takes part (0: no upper end)."""

    enabled: bool = True
    first: int = 0
    last: int = 0

    def open(self, iteration: int) -> bool:
        return self.enabled and iteration >= self.first and (not self.last or iteration <= self.last)


Layers = DataFrame | Mapping[str, DataFrame]
Pairs = dict[str, DataFrame]
Solver = Callable[[Pairs, Pose], Pose | None]


@dataclass
class Matcher:
    """``run(local, world, pose)`` gives pairs of one kind for each pair of layers (global, local, weight).

    Without layers the only one of either side, or those of equal names, are
    matched.  Unless allowed, local points that an earlier matcher paired and
    global points that it used are left out.  ``most`` bounds the local points
    of a layer, told by a hash (0: all).
    """

    run: Callable[[DataFrame, DataFrame, Pose], Pairs | DataFrame]
    per_point: int = 1
    layers: list[tuple[str, str, float]] = field(default_factory=list)
    reuse_local: bool = False
    reuse_global: bool = False
    most: int = 0
    seed: int = 0


class Dynamic:
    """A matcher whose parameters depend on the iteration."""

    def __init__(self, make: Callable[[int], Matcher]):
        self.make = make

    def at(self, iteration: int) -> Matcher:
        return self.make(iteration)


@dataclass
class Result:
    pose: Pose
    iterations: int
    reason: str
    quality: float
    covariance: np.ndarray
    n_pairs: int
    trace: list[tuple[int, Pose, int]] = field(default_factory=list)
    potential: int = 0
    start: Pose | None = None


def distance_matcher(threshold: float, angular_deg: float = 0.0, per_point: int = 1, reuse_global: bool = True) -> Matcher:
    return Matcher(lambda local, world, pose: neighbours.match_distance(local, world, pose, threshold, angular_deg, per_point, reuse_global), per_point, reuse_global=reuse_global)


def inlier_matcher(ratio: float) -> Matcher:
    return Matcher(lambda local, world, pose: neighbours.match_inlier_ratio(local, world, pose, ratio, reuse_global=True), reuse_global=True)


def plane_matcher(**how) -> Matcher:
    return Matcher(lambda local, world, pose: {"pt2pl": neighbours.match_plane(local, world, pose, **how)}, reuse_global=True)


def line_matcher(**how) -> Matcher:
    return Matcher(lambda local, world, pose: {"pt2ln": neighbours.match_line(local, world, pose, **how)}, reuse_global=True)


def _points_of(pairs: Pairs, pose: Pose) -> DataFrame | None:
    """Point pairs, in whose place come those made of lines and planes if there are any."""
    others = {k: pairs[k] for k in ("pt2ln", "pt2pl") if k in pairs}
    return solvers.to_point_pairs(pose, others.get("pt2ln"), others.get("pt2pl")) if others else pairs.get("pt2pt")


def closed_form_solver(solve: Callable[[DataFrame, Pose], Pose | None], outliers: float | None = None) -> Solver:
    """A closed form over point pairs; with ``outliers`` once more without pairs whose scales differ by that ratio."""

    def run(pairs: Pairs, pose: Pose) -> Pose | None:
        own = _points_of(pairs, pose)
        if own is None:
            return None
        found = solve(own, pose)
        if found is not None and outliers:
            again = solve(solvers.without_scale_outliers(own, outliers), pose)
            found = again if again is not None else found
        return found

    return run


def horn(outliers: float | None = None, kernel: str = "None", c: float = 1.0, weight: float = 1.0) -> Solver:
    return closed_form_solver(lambda pairs, pose: solvers.horn(pairs, solvers.weighted(pairs, pose, kernel, c, weight)), outliers)


horn_solver = horn()


def olae(outliers: float | None = None) -> Solver:
    return closed_form_solver(lambda pairs, pose: solvers.olae(pairs), outliers)


olae_solver = olae()


def gauss_newton_solver(iterations: int = 5, kernel: str = "None", c: float = 1.0, prior: tuple[Pose, np.ndarray] | None = None, weights: dict[str, float] | None = None) -> Solver:
    def solve(pairs: Pairs, pose: Pose) -> Pose | None:
        found = solvers.gauss_newton(pairs, pose, iterations, weights, kernel=kernel, c=c, prior=prior)
        return found and found.pose

    return solve


def _named(side: Layers) -> dict[str, DataFrame]:
    return {"raw": side} if isinstance(side, DataFrame) else dict(side)


def _layers_of(m: Matcher, local: dict[str, DataFrame], world: dict[str, DataFrame]) -> list[tuple[str, str, float]]:
    if m.layers:
        return m.layers
    if len(local) == len(world) == 1:
        return [(next(iter(world)), next(iter(local)), 1.0)]
    return [(k, k, 1.0) for k in local if k in world]


def matched(matchers: list[Matcher], local: Layers, world: Layers, pose: Pose) -> tuple[Pairs, int]:
    """The pairs by kind of all matchers, one after the other, and how many there could be."""
    local, world = _named(local), _named(world)
    found: Pairs = {}
    potential = 0
    for m in matchers:
        for theirs, ours, weight in _layers_of(m, local, world):
            if ours not in local or theirs not in world:
                raise KeyError(f"no layers {ours!r} and {theirs!r} to match")
            mine = neighbours.sampled(local[ours], m.most, m.seed)
            potential += mine.count() * m.per_point
            got = m.run(mine, world[theirs], pose)
            got = got if isinstance(got, dict) else {"pt2pt": got}
            for kind, own in got.items():
                if own is None:
                    continue
                own = own.withColumns({"weight": F.lit(float(weight)), "local_layer": F.lit(ours), "global_layer": F.lit(theirs)})
                for before in found.values():
                    if not m.reuse_local:
                        own = own.join(before.select("local_layer", "local_id"), ["local_layer", "local_id"], "left_anti")
                    if not m.reuse_global and "global_id" in own.columns and "global_id" in before.columns:
                        own = own.join(before.select("global_layer", "global_id"), ["global_layer", "global_id"], "left_anti")
                found[kind] = found[kind].unionByName(own, allowMissingColumns=True) if kind in found else own
    return found, potential


def align(
    local: Layers,
    world: Layers,
    start: Pose | None = None,
    matchers: list[tuple[Matcher | Dynamic, Gate]] | None = None,
    solver_list: list[tuple[Solver, Gate]] | None = None,
    parameters: Parameters | None = None,
    hook: Callable[[int, Pairs, Pose], bool] | None = None,
) -> Result:
    """The pose that puts ``local`` on ``world``.

    Ends without pairs (``NoPairings``) or a solution (``SolverError``), when
    the last step or that over two iterations is small (``Stalled``), when a
    quality checkpoint fails, on the hook's request, or after the most
    iterations.  Both sides are kept while it runs and released at the end.
    """
    p = parameters or Parameters()
    matchers = matchers or [(distance_matcher(1.0), Gate())]
    solver_list = solver_list or [(horn_solver, Gate())]
    world, local = ({k: v.persist() for k, v in _named(x).items()} for x in (world, local))
    pose = start or Pose.identity()
    before: list[Pose] = [pose]
    reason, n, potential, pairs, trace, i = "MaxIterations", 0, 0, {}, [], 0
    try:
        for i in range(p.max_iterations):
            now = [m.at(i) if isinstance(m, Dynamic) else m for m, gate in matchers if gate.open(i)]
            found, potential = matched(now, local, world, pose)
            _released(pairs)
            pairs = {k: v.persist() for k, v in found.items()}
            counts = {k: v.count() for k, v in pairs.items()}
            n, pairs = sum(counts.values()), {k: v for k, v in pairs.items() if counts[k]}
            if not n:
                reason = "NoPairings"
                break
            solved = next((s for f, gate in solver_list if gate.open(i) and (s := f(pairs, pose)) is not None), None)
            if solved is None:
                reason = "SolverError"
                break
            pose = solved
            trace.append((i, pose, n))
            steps = [se3_log(b.inverse() @ pose) for b in before[-2:]]
            if min(np.linalg.norm(s[:3]) for s in steps) < p.min_step_translation and min(np.linalg.norm(s[3:]) for s in steps) < p.min_step_rotation:
                reason = "Stalled"
                break
            before.append(pose)
            if i in p.checkpoints and quality.paired_ratio(n, potential)[0] < p.checkpoints[i]:
                reason = "QualityCheckpointFailed"
                break
            if hook is not None and hook(i, pairs, pose):
                reason = "HookRequest"
                break
        score, _ = quality.paired_ratio(n, potential, 0.0)
        cov = solvers.covariance(pairs, pose) if n else 1e6 * np.eye(6)
    finally:
        _released(pairs)
        _released(local)
        _released(world)
    return Result(pose, i, reason, score, cov, n, trace, potential, start or Pose.identity())


def _released(frames: Mapping[str, DataFrame]) -> None:
    for v in frames.values():
        v.unpersist()
