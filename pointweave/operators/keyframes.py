"""Tables of keyframes and observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions import geometry as g
from pointweave.functions.se3 import Pose

POSE = ["x", "y", "z", "yaw", "pitch", "roll"]


def cut(kfs: DataFrame, first: int, last: int) -> DataFrame:
    """Keyframes by index, both ends included."""
    return kfs.where(F.col("kf_id").between(first, last))


def trim(kfs: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Keyframes whose place lies in a closed box; bounds that are None are free."""
    for a, lo, hi in zip("xyz", low, high, strict=True):
        if lo is not None:
            kfs = kfs.where(F.col(a) >= lo)
        if hi is not None:
            kfs = kfs.where(F.col(a) <= hi)
    return kfs


def turned(kfs: DataFrame, pose: Pose) -> DataFrame:
    """``pose`` times each keyframe's pose, and its covariance (``cov``, 36 numbers) if there; all as column expressions."""
    a = [[float(v) for v in row] for row in pose.rotation]
    c, s = {k: F.cos(k) for k in POSE[3:]}, {k: F.sin(k) for k in POSE[3:]}
    own = [
        [c["yaw"] * c["pitch"], c["yaw"] * s["pitch"] * s["roll"] - s["yaw"] * c["roll"], c["yaw"] * s["pitch"] * c["roll"] + s["yaw"] * s["roll"]],
        [s["yaw"] * c["pitch"], s["yaw"] * s["pitch"] * s["roll"] + c["yaw"] * c["roll"], s["yaw"] * s["pitch"] * c["roll"] - c["yaw"] * s["roll"]],
        [-s["pitch"], c["pitch"] * s["roll"], c["pitch"] * c["roll"]],
    ]

    def r(i: int, j: int):
        return sum((F.lit(a[i][k]) * own[k][j] for k in range(3)), F.lit(0.0))

    x, y, z = g.transformed(pose)
    new = {"x": x, "y": y, "z": z, "yaw": F.atan2(r(1, 0), r(0, 0)), "pitch": F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -r(2, 0)))), "roll": F.atan2(r(2, 1), r(2, 2))}
    if "cov" in kfs.columns:  # only the places' axes turn

        def j(p: int, q: int) -> float:
            return a[p][q] if p < 3 and q < 3 else float(p == q)

        def entry(p: int, q: int):
            terms = [F.lit(j(p, m) * j(q, n)) * F.get("cov", F.lit(6 * m + n)) for m in range(6) for n in range(6) if j(p, m) and j(q, n)]
            return sum(terms[1:], terms[0])

        new["cov"] = F.when(F.col("cov").isNotNull(), F.array(*[entry(p, q) for p in range(6) for q in range(6)]))
    return kfs.withColumns(new).select(*kfs.columns)


def moved_places(kfs: DataFrame, pose: Pose) -> DataFrame:
    """Only the places moved, as column expressions."""
    x, y, z = g.transformed(pose)
    return kfs.withColumns({"x": x, "y": y, "z": z})


def joined(maps: list[DataFrame]) -> DataFrame:
    """Keyframe maps one after the other, with ids that go on."""
    out, base = None, 0
    for m in maps:
        lo, hi = m.agg(F.min("kf_id"), F.max("kf_id")).first()
        own = m.withColumn("kf_id", F.col("kf_id") - F.lit(lo or 0) + F.lit(base))
        base += (hi - lo + 1) if lo is not None else 0
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def info(kfs: DataFrame) -> DataFrame:
    """One row: count, extent of places and times, seconds between first and last, whether there is a twist."""
    twist = F.coalesce(F.bool_or(F.col("vx").isNotNull()), F.lit(False)) if "vx" in kfs.columns else F.max(F.lit(False))
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    return kfs.agg(
        span.alias("span"), F.coalesce(twist, F.lit(False)).alias("has_twist"), F.count("*").alias("n"), *[f(a).alias(f"{k}_{a}") for a in "xyz" for k, f in (("min", F.min), ("max", F.max))], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def observation_info(obs: DataFrame) -> DataFrame:
    return obs.groupBy("label", "class").agg(F.count("*").alias("n"))


def trajectory(kfs: DataFrame, obs: DataFrame) -> DataFrame:
    """Poses by time, the time of a keyframe's first observation; keyframes without one are left out."""
    first = obs.where("ts is not null").groupBy("kf_id").agg(F.min_by("ts", "obs_id").alias("t"))
    return kfs.drop("ts").join(first, "kf_id").select("t", *POSE)


def twists(kfs: DataFrame, obs: DataFrame) -> DataFrame:
    """``t, vx .. wz`` of keyframes that have a twist, by the time of their first observation."""
    first = obs.where("ts is not null").groupBy("kf_id").agg(F.min_by("ts", "obs_id").alias("t"))
    return kfs.where("vx is not null").join(first, "kf_id").select("t", "vx", "vy", "vz", "wx", "wy", "wz")


def as_observations(kfs: DataFrame, obs: DataFrame) -> DataFrame:
    """The observations, with a pose and (where there is one) a twist of each keyframe among them."""
    kind = obs.select("kf_id", "ts", "class", "label", F.col("payload").cast("string"))
    pose = kfs.select("kf_id", "ts", F.lit("pose").alias("class"), F.lit("pose").alias("label"), F.to_json(F.struct(*POSE)).alias("payload"))
    out = kind.unionByName(pose)
    if "vx" in kfs.columns:
        twist = kfs.where("vx is not null").select("kf_id", "ts", F.lit("twist").alias("class"), F.lit("twist").alias("label"), F.to_json(F.struct("vx", "vy", "vz", "wx", "wy", "wz")).alias("payload"))
        out = out.unionByName(twist)
    return out


def level(kfs: DataFrame, rounds: int = 50) -> Pose:
    """The rotation (pitch and roll; yaw can't be told) that makes heights vary least, against the first one's.

    Heights are linear in the rotation's last row, so nine sums of places are
    all that comes to the driver, where Levenberg-Marquardt runs on them.
    """
    first = kfs.orderBy("kf_id").select("x", "y", "z").first()
    if first is None:
        return Pose.identity()
    r = kfs.agg(F.count("*").alias("n"), *[F.sum(a).alias(f"s{a}") for a in "xyz"], *[F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for i, a in enumerate("xyz") for b in "xyz"[i:]]).first()
    s = np.array([r[f"s{a}"] for a in "xyz"])
    m = np.array([[r["s" + "".join(sorted(a + b))] for b in "xyz"] for a in "xyz"])
    z0 = first["z"]

    def cost(q):
        row = Pose.of(0, 0, 0, 0, q[0], q[1]).rotation[2]
        return row @ m @ row - 2 * z0 * row @ s + r["n"] * z0 * z0

    q, damping = np.zeros(2), 1e-3
    for _ in range(rounds):
        h = 1e-5
        grad = np.array([(cost(q + h * e) - cost(q - h * e)) / (2 * h) for e in np.eye(2)])
        hess = np.array([[(cost(q + h * (a + b)) - cost(q + h * (a - b)) - cost(q - h * (a - b)) + cost(q - h * (a + b))) / (4 * h * h) for b in np.eye(2)] for a in np.eye(2)])
        step = -np.linalg.lstsq(hess + damping * np.diag(np.abs(np.diag(hess)) + 1e-9), grad, rcond=None)[0]
        if cost(q + step) < cost(q):
            q, damping = q + step, damping / 3
        else:
            damping *= 5
        if np.linalg.norm(step) < 1e-10:
            break
    return Pose.of(0, 0, 0, 0, *q)


# ------------------------------------------------------------------ generators


def matching(obs: DataFrame, classes: str = ".*", labels: str = ".*", skipped: tuple[str, ...] = ("comment", "gps", "robot_pose")) -> DataFrame:
    """Observations whose class and label match the patterns as a whole."""
    return obs.where(F.col("class").rlike(f"^(?:{classes})$") & F.col("label").rlike(f"^(?:{labels})$") & ~F.lower("class").isin(*skipped))


def generate(obs_points: DataFrame, kfs: DataFrame, sensor: Pose | None = None) -> DataFrame:
    """Points of observations (``kf_id, point_id, x, y, z, ...``) in the map's frame: keyframe pose, then sensor pose."""
    own = obs_points
    if sensor is not None:
        x, y, z = g.transformed(sensor)
        own = own.withColumns({"x": x, "y": y, "z": z})
    poses = kfs.select("kf_id", *[F.col(k).alias(f"_{k}") for k in POSE])
    x, y, z = g.posed(*[F.col(f"_{k}") for k in ("yaw", "pitch", "roll", "x", "y", "z")], *[F.col(a) for a in "xyz"])
    return own.join(poses, "kf_id").withColumns({"x": x, "y": y, "z": z}).select(*obs_points.columns)


def unproject(depth: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """Points of depth images ``row, col, depth`` in the frame of a camera that looks along x; zeros have none."""
    d = F.col("depth")
    return depth.where("depth > 0").withColumns({"x": d, "y": (cx - F.col("col")) * d / fx, "z": (cy - F.col("row")) * d / fy})


# ------------------------------------------------------------------ nearest in time and velocities


def nearest_in_time(left: DataFrame, right: DataFrame, by: list[str], value: str, tolerance: float | None = None) -> DataFrame:
    """``left`` with ``value`` of the row of ``right`` nearest in ``t`` (seconds), the earlier of two.

    Both sides are put in one order by time within ``by``, and the last value
    before and first after are carried along: one shuffle, no join.
    """
    a = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_left"))
    b = right.select(*[F.col(c) if c in (*by, "t") else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("_v"), F.lit(0).alias("_left"))
    v = F.when(F.col("_left") == 0, F.struct("t", "_v"))
    line = Window.partitionBy(*by).orderBy("t", "_left")
    both = a.unionByName(b).withColumn("_p", F.last(v, True).over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_s", F.first(v, True).over(line.rowsBetween(0, Window.unboundedFollowing)))
    before, after = F.col("t") - F.col("_p.t"), F.col("_s.t") - F.col("t")
    best = F.when(after.isNull() | (before <= after), F.col("_p")).otherwise(F.col("_s"))
    out = both.where("_left = 1").withColumn("_b", best)
    near = F.lit(True) if tolerance is None else F.abs(F.col("t") - F.col("_b.t")) <= tolerance
    return out.select(*left.columns, F.when(near, F.col("_b._v")).alias(value))


def velocity_window(samples: DataFrame, by: list[str], seconds: float = 1.5) -> DataFrame:
    """For each sample (``t``) what a buffer of the last ``seconds`` holds: number and mean of ``value``."""
    w = Window.partitionBy(*by).orderBy(F.round(F.col("t") * 1e6).cast("bigint")).rangeBetween(-round(seconds * 1e6), 0)
    return samples.withColumns({"held": F.count("*").over(w), "mean": F.avg("value").over(w)})


def integrate_rates(rates: pd.DataFrame, at: np.ndarray, start: float) -> list[np.ndarray]:
    """Rotations at times ``at`` from samples ``t, wx, wy, wz``, the identity at ``start``; rates hold until the next sample."""
    from pointweave.functions.se3 import so3_exp

    t, w = rates["t"].to_numpy(), rates[["wx", "wy", "wz"]].to_numpy()
    order = np.argsort(t)
    t, w = t[order], w[order]

    def between(a: float, b: float) -> np.ndarray:
        r = np.eye(3)
        stops = [a, *[x for x in t if a < x < b], b]
        for p, q in zip(stops, stops[1:], strict=False):
            i = max(0, int(np.searchsorted(t, p, side="right")) - 1)
            r = r @ so3_exp(w[i] * (q - p))
        return r

    return [between(start, x) if x >= start else between(x, start).T for x in at]


def deskew_by_rates(points: DataFrame, rates: DataFrame, by: str = "scan_id") -> DataFrame:
    """Points ``scan_id, t, x, y, z`` turned by the integrated rates of their scan, a scan at a time."""

    def run(key, p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(r):
            return p
        out = p.copy()
        times, where = np.unique(p["t"].to_numpy(), return_inverse=True)
        turns = np.array(integrate_rates(r, times, 0.0))[where]
        out[["x", "y", "z"]] = np.einsum("nij,nj->ni", turns, p[["x", "y", "z"]].to_numpy())
        return out

    return points.groupBy(by).cogroup(rates.groupBy(by)).applyInPandas(run, points.schema)
