"""Rigid alignment from pairs.

What depends on the number of pairs is one aggregate to a few sums, which
Spark adds up before its shuffle; only these come to the driver, where the
small dense problem is solved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions import geometry as g
from pointweave.functions.se3 import Pose, se3_log, skew, ypr_jacobian

#: Residual names of each kind of pair: point to point, line and plane; plane to plane.
KINDS = ("pt2pt", "pt2ln", "pt2pl", "pl2pl")


def pair_sums(pairs: DataFrame, weight: Column | None = None) -> DataFrame:
    """The sums n, l, g and l gT of point pairs: one row, whatever the number of pairs."""
    w = F.lit(1.0) if weight is None else weight
    l, q = [F.col(f"l{a}") for a in "xyz"], [F.col(f"g{a}") for a in "xyz"]
    terms = {"n": w} | {f"l{a}": w * v for a, v in zip("xyz", l, strict=True)} | {f"g{a}": w * v for a, v in zip("xyz", q, strict=True)}
    terms |= {f"s{a}{b}": w * l[i] * q[j] for i, a in enumerate("xyz") for j, b in enumerate("xyz")}
    return pairs.agg(F.count("*").alias("rows"), *[F.sum(v).alias(k) for k, v in terms.items()])


def horn(pairs: DataFrame, weight: Column | None = None) -> Pose | None:
    """Closed form by unit quaternions; None with fewer than three pairs."""
    r = pair_sums(pairs, weight).first()
    if r["rows"] < 3 or not r["n"]:
        return None
    cl, cg = (np.array([r[f"{k}{a}"] for a in "xyz"]) / r["n"] for k in "lg")
    s = np.array([[r[f"s{a}{b}"] for b in "xyz"] for a in "xyz"]) - r["n"] * np.outer(cl, cg)
    return pose_from_covariance(s, cl, cg)


def pose_from_covariance(s: np.ndarray, cl: np.ndarray, cg: np.ndarray) -> Pose:
    anti = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
    n = np.zeros((4, 4))
    n[0, 0], n[0, 1:], n[1:, 0] = np.trace(s), anti, anti
    n[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
    q = np.linalg.eigh(n)[1][:, -1]
    r = rotation_of(q if q[0] >= 0 else -q)
    return Pose(r, cg - r @ cl)


def rotation_of(q: np.ndarray) -> np.ndarray:
    w, v = q[0], q[1:]
    return (w * w - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * w * skew(v)


def olae(pairs: DataFrame, planes: DataFrame | None = None) -> Pose | None:
    """Linear attitude from unit vectors: of four frames, turned by pi about the axes, the best conditioned one."""
    c = pairs.agg(F.count("*").alias("n"), *[F.avg(f"{k}{a}").alias(f"{k}{a}") for k in "lg" for a in "xyz"]).first()
    if c["n"] < 3:
        return None
    cl, cg = (np.array([c[f"{k}{a}"] for a in "xyz"]) for k in "lg")
    l, q = [F.col(f"l{a}") - float(v) for a, v in zip("xyz", cl, strict=True)], [F.col(f"g{a}") - float(v) for a, v in zip("xyz", cg, strict=True)]
    nl, nq = F.sqrt(g.squared_norm(*l)), F.sqrt(g.squared_norm(*q))
    unit = pairs.where((nl > 1e-4) & (nq > 1e-4)).select(*[(v / nl).alias(f"l{a}") for a, v in zip("xyz", l, strict=True)], *[(v / nq).alias(f"g{a}") for a, v in zip("xyz", q, strict=True)])
    if planes is not None:
        unit = unit.unionByName(planes.select("lx", "ly", "lz", "gx", "gy", "gz"))
    r = pair_sums(unit).first()
    if r["rows"] < 2:
        return None
    b = np.array([[r[f"s{x}{y}"] for y in "xyz"] for x in "xyz"]) / r["n"]  # sum of l gT
    best = None
    for turn in (np.eye(3), np.diag([1.0, -1, -1]), np.diag([-1.0, 1, -1]), np.diag([-1.0, -1, 1])):
        t = turn @ b  # local vectors turned first
        v = np.array([t[1, 2] - t[2, 1], t[2, 0] - t[0, 2], t[0, 1] - t[1, 0]])
        m = (np.trace(t) + 1) * np.eye(3) - t - t.T
        det = abs(np.linalg.det(m))
        if best is None or det > best[0]:
            best = (det, m, v, turn)
    _, m, v, turn = best
    gibbs = np.linalg.solve(m, v)
    quaternion = np.array([1.0, *gibbs]) / np.sqrt(1 + gibbs @ gibbs)
    rotation = rotation_of(quaternion) @ turn
    return Pose(rotation, cg - rotation @ cl)


def robust_weight(kernel: str, e2: Column, c: float) -> Column:
    """Weight by squared error."""
    if kernel == "None":
        return F.lit(1.0)
    if kernel == "GemanMcClure":
        return F.lit(c * c) / ((e2 + c) * (e2 + c))
    if kernel == "Cauchy":
        return F.lit(c * c) / (e2 + c * c)
    raise ValueError(f"no such kernel: {kernel}")


def _cross(v: list, i: int) -> list:
    """Row i of the matrix [v]x as a list of three terms."""
    x, y, z = v
    zero = F.lit(0.0)
    return [[zero, -z, y], [z, zero, -x], [-y, x, zero]][i]


def residuals(kind: str, pose: Pose) -> tuple[list[Column], list[list[Column]]]:
    """Three errors of a pair and their derivatives by (translation, rotation) on the right of the pose."""
    r = pose.rotation
    l = [F.col(f"l{a}") for a in "xyz"]
    if kind == "pl2pl":
        e = [sum((F.lit(float(r[i, j])) * F.col(f"ln{b}") for j, b in enumerate("xyz")), -F.col(f"gn{a}")) for i, a in enumerate("xyz")]
        base = [[F.lit(0.0)] * 3 + [-sum((F.lit(float(r[i, m])) * _cross([F.col(f"ln{b}") for b in "xyz"], m)[k] for m in range(3)), F.lit(0.0)) for k in range(3)] for i in range(3)]
        return e, base
    at = g.transformed(pose, *l)
    base = [[F.lit(float(r[i, k])) for k in range(3)] + [-sum((F.lit(float(r[i, m])) * _cross(l, m)[k] for m in range(3)), F.lit(0.0)) for k in range(3)] for i in range(3)]
    if kind == "pt2pt":
        return [p - F.col(f"g{a}") for p, a in zip(at, "xyz", strict=True)], base
    if kind == "pt2ln":
        u, d = [F.col(f"u{a}") for a in "xyz"], [p - F.col(f"b{a}") for p, a in zip(at, "xyz", strict=True)]
        m = [[F.lit(float(i == j)) - u[i] * u[j] for j in range(3)] for i in range(3)]
        e = [sum((m[i][j] * d[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    elif kind == "pt2pl":
        n = [F.col(f"n{a}") for a in "xyz"]
        nn = g.squared_norm(*n)
        off = sum((x * p for x, p in zip(n, at, strict=True)), F.col("d"))
        m = [[n[i] * n[j] / nn for j in range(3)] for i in range(3)]
        e = [n[i] * off / nn for i in range(3)]
    else:
        raise ValueError(f"no such kind of pair: {kind}")
    return e, [[sum((m[i][j] * base[j][k] for j in range(3)), F.lit(0.0)) for k in range(6)] for i in range(3)]


UPPER = [(i, j) for i in range(6) for j in range(i, 6)]


def normal_sums(pairs: DataFrame, kind: str, pose: Pose, kernel: str = "None", c: float = 1.0) -> DataFrame:
    """One row with the 21 sums of JT J, the 6 of JT e and the cost."""
    e, j = residuals(kind, pose)
    names = [f"e{i}" for i in range(3)] + [f"j{i}{k}" for i in range(3) for k in range(6)]
    values = [*e, *[x for row in j for x in row]]
    rows = pairs.select(*[v.alias(n) for n, v in zip(names, values, strict=True)], *(["weight"] if "weight" in pairs.columns else []))
    e2 = g.squared_norm(*[F.col(f"e{i}") for i in range(3)])
    rows = rows.withColumn("w", robust_weight(kernel, e2, c) * (F.col("weight") if "weight" in pairs.columns else 1.0)).withColumn("square", e2)
    w = F.col("w")
    h = [F.sum(w * sum((F.col(f"j{i}{a}") * F.col(f"j{i}{b}") for i in range(3)), F.lit(0.0))).alias(f"h{a}{b}") for a, b in UPPER]
    b = [F.sum(w * sum((F.col(f"j{i}{k}") * F.col(f"e{i}") for i in range(3)), F.lit(0.0))).alias(f"b{k}") for k in range(6)]
    return rows.agg(F.count("*").alias("n"), F.sum(w * F.col("square")).alias("cost"), *h, *b)


def normal_equations(pairs: dict[str, DataFrame], pose: Pose, weights: dict[str, float] | None = None, kernel: str = "None", c: float = 1.0) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Number of pairs, H, g and cost over all kinds."""
    total, h, b, cost = 0, np.zeros((6, 6)), np.zeros(6), 0.0
    for kind, frame in pairs.items():
        if frame is None:
            continue
        r = normal_sums(frame, kind, pose, kernel, c).first()
        if not r["n"]:
            continue
        w = (weights or {}).get(kind, 1.0)
        total += r["n"]
        for i, k in UPPER:
            h[i, k] += w * r[f"h{i}{k}"]
        b += w * np.array([r[f"b{k}"] for k in range(6)])
        cost += w * r["cost"]
    return total, h + np.triu(h, 1).T, b, cost


def quadratic_sums(pairs: DataFrame, kind: str) -> tuple[int, np.ndarray, np.ndarray, float]:
    """Number of pairs and the cost as a quadratic form of the pose's twelve numbers (R | t), row by row.

    The cost is x A x - 2 b x + c; A, b and c don't depend on the pose, so one
    aggregate serves all steps of a solver without a robust kernel.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    if kind == "pl2pl":
        v, target, q = [*[F.col(f"ln{a}") for a in "xyz"], None], [F.col(f"gn{a}") for a in "xyz"], None
    else:
        v = [*[F.col(f"l{a}") for a in "xyz"], one]
        if kind == "pt2pt":
            target, q = [F.col(f"g{a}") for a in "xyz"], None
        elif kind == "pt2ln":
            u = [F.col(f"u{a}") for a in "xyz"]
            target, q = [F.col(f"b{a}") for a in "xyz"], [[F.lit(float(i == j)) - u[i] * u[j] for j in range(3)] for i in range(3)]
        elif kind == "pt2pl":
            n = [F.col(f"n{a}") for a in "xyz"]
            nn = g.squared_norm(*n)
            target, q = [-F.col("d") * x / nn for x in n], [[n[i] * n[j] / nn for j in range(3)] for i in range(3)]
        else:
            raise ValueError(f"no such kind of pair: {kind}")
    w = F.col("weight") if "weight" in pairs.columns else one
    aims = target if q is None else [sum((q[i][k] * target[k] for k in range(3)), zero) for i in range(3)]  # q times the target
    have = [m for m in range(4) if v[m] is not None]
    terms = {"c": w * sum((aims[i] * target[i] for i in range(3)), zero)} | {f"b{i}{m}": w * aims[i] * v[m] for i in range(3) for m in have}
    parts = [(0, 0)] if q is None else [(i, k) for i in range(3) for k in range(i, 3)]
    terms |= {f"a{i}{k}{m}{n}": w * (one if q is None else q[i][k]) * v[m] * v[n] for i, k in parts for m in have for n in have if m <= n}
    r = pairs.agg(F.count("*").alias("n"), *[F.sum(x).alias(k) for k, x in terms.items()]).first()
    a, b = np.zeros((12, 12)), np.zeros(12)
    if not r["n"]:
        return 0, a, b, 0.0
    for i, k in parts if q is not None else [(0, 0), (1, 1), (2, 2)]:
        for m in have:
            for n in have:
                value = r[f"a{i}{k}{min(m, n)}{max(m, n)}"] if q is not None else r[f"a00{min(m, n)}{max(m, n)}"]
                a[4 * i + m, 4 * k + n] = a[4 * k + m, 4 * i + n] = value
    for i in range(3):
        for m in have:
            b[4 * i + m] = r[f"b{i}{m}"]
    return r["n"], a, b, r["c"]


def _directions(pose: Pose) -> np.ndarray:
    """Derivatives of the pose's twelve numbers by (translation, rotation) on its right, as columns."""
    out = np.zeros((3, 4, 6))
    for k in range(3):
        out[:, 3, k] = pose.rotation[:, k]
        out[:, :3, 3 + k] = pose.rotation @ skew(np.eye(3)[k])
    return out.reshape(12, 6)


@dataclass
class Solution:
    pose: Pose
    iterations: int
    cost: float


def gauss_newton(
    pairs: dict[str, DataFrame], start: Pose, iterations: int = 6, weights: dict[str, float] | None = None, kernel: str = "None", c: float = 1.0, prior: tuple[Pose, np.ndarray] | None = None, max_cost: float = 0.0
) -> Solution | None:
    """Minimises all residuals, and the distance from a prior pose with its information matrix.

    Without a kernel there is one aggregate for each kind of pair, with one
    there is one in each step.
    """
    pose, cost, k = start, 0.0, 0
    form = _whole_form(pairs, weights) if kernel == "None" else None
    for k in range(1, iterations + 1):
        if form is not None:
            n, a, b, rest = form
            x, j = np.concatenate([pose.rotation, pose.translation[:, None]], axis=1).ravel(), _directions(pose)
            h, grad, cost = j.T @ a @ j, j.T @ (a @ x - b), x @ a @ x - 2 * b @ x + rest
        else:
            n, h, grad, cost = normal_equations(pairs, pose, weights, kernel, c)
        if not n and prior is None:
            return None
        if prior is not None:
            d = se3_log(prior[0].inverse() @ pose)
            h, grad = h + prior[1], grad + prior[1] @ d
        step = -np.linalg.lstsq(h, grad, rcond=None)[0]
        pose = pose.retract(step)
        if np.linalg.norm(step) < 1e-7 or cost <= max_cost:
            break
    return Solution(pose, k, float(cost))


def _whole_form(pairs: dict[str, DataFrame], weights: dict[str, float] | None = None) -> tuple[int, np.ndarray, np.ndarray, float]:
    total, a, b, c = 0, np.zeros((12, 12)), np.zeros(12), 0.0
    for kind, frame in pairs.items():
        if frame is not None:
            n, own_a, own_b, own_c = quadratic_sums(frame, kind)
            w = (weights or {}).get(kind, 1.0)
            total, a, b, c = total + n, a + w * own_a, b + w * own_b, c + w * own_c
    return total, a, b, c


def covariance(pairs: dict[str, DataFrame], pose: Pose) -> np.ndarray:
    """Of (x, y, z, yaw, pitch, roll), the inverse of JT J; very large without pairs."""
    n, a, _, _ = _whole_form(pairs)
    if not n:
        return 1e6 * np.eye(6)
    d, j = _directions(pose), ypr_jacobian(pose)
    return j @ np.linalg.pinv(d.T @ a @ d) @ j.T


def to_point_pairs(pose: Pose, lines: DataFrame | None, planes: DataFrame | None) -> DataFrame:
    """Each point's closest point on its line or plane at the current pose, and of those only the largest errors.

    By kind, in descending order of error: those of at least a quarter of the
    largest, and at least three.
    """
    l = [F.col(f"l{a}") for a in "xyz"]
    at = g.transformed(pose, *l)
    parts = []
    for frame, kind in ((lines, "pt2ln"), (planes, "pt2pl")):
        if frame is None:
            continue
        e, _ = residuals(kind, pose)
        parts.append(frame.select("local_id", F.lit(kind).alias("kind"), "lx", "ly", "lz", *[(p - d).alias(f"g{a}") for p, d, a in zip(at, e, "xyz", strict=True)], F.sqrt(g.squared_norm(*e)).alias("err")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return largest_errors(whole)


def largest_errors(pairs: DataFrame) -> DataFrame:
    most = pairs.groupBy("kind").agg(F.max("err").alias("_most"))
    kept = pairs.join(F.broadcast(most), "kind")  # a row for each kind of pair
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("err"), "local_id"))
    return kept.withColumn("_r", rank).where((F.col("err") >= 0.25 * F.col("_most")) | (F.col("_r") <= 3)).drop("_most", "_r")


def weighted(pairs: DataFrame, pose: Pose, kernel: str = "None", c: float = 1.0, weight: float = 1.0) -> Column:
    """The weight of each point pair: its own, the kind's, and a robust kernel's at the current pose."""
    e, _ = residuals("pt2pt", pose)
    own = F.col("weight") if "weight" in pairs.columns else F.lit(1.0)
    return own * F.lit(float(weight)) * robust_weight(kernel, g.squared_norm(*e), c)


def without_scale_outliers(pairs: DataFrame, threshold: float = 1.2) -> DataFrame:
    """Point pairs whose distances from the two centroids have a ratio of at most ``threshold``."""
    c = pairs.agg(*[F.avg(f"{k}{a}").alias(f"{k}{a}") for k in "lg" for a in "xyz"]).first()
    if c["lx"] is None:
        return pairs
    nl, nq = (F.sqrt(g.squared_norm(*[F.col(f"{k}{a}") - c[f"{k}{a}"] for a in "xyz"])) for k in "lg")
    return pairs.where((nl > 1e-4) & (nq > 1e-4) & (F.greatest(nl, nq) / F.least(nl, nq) <= threshold))
