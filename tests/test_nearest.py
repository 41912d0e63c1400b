"""The nearest points against brute force, and that the rows made on the way follow the points, not the pairs within the radius."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave import queries
from pointweave.functions.se3 import Pose
from pointweave.operators import knn, neighbours

DENSE = 1200


def frame(spark, ids, at):
    return spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, at, strict=True)], "point_id bigint, x double, y double, z double")


def brute(a, at, b, bt, k, limit):
    out = set()
    for i, p in zip(a, at, strict=True):
        v = p - bt
        d2 = v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1] + v[:, 2] * v[:, 2]
        out |= {(int(i), int(j), float(d)) for d, j in sorted(zip(d2, b, strict=True))[:k] if d < limit}
    return out


def most_rows(df):
    """The most rows that any operator of the plan gave, with all of it run."""
    df.collect()

    def of(p):
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(p.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(p.plan())
        m = p.metrics().get("numOutputRows")
        kids = p.children()
        return max([m.get().value() if m.isDefined() else 0, *[of(kids.apply(i)) for i in range(kids.size())]])

    return of(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """A folder whose cloud lies in a ball smaller than all radii."""
    d = str(tmp_path_factory.mktemp("dense"))
    r = np.random.default_rng(7)
    rows = [(i, [float(v) for v in r.normal(0, 0.01, 4)], i % 10) for i in range(2 * DENSE)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["line_pairs", "plane_pairs", "nn_exclusive", "nn_threshold", "paired_ratio", "nn_topk"])
def test_rows_follow_the_points(spark, dense, name):
    assert most_rows(queries.QUERIES[name](spark, dense)) <= 12 * DENSE


CLOUDS = {
    "normal": lambda r, n: r.normal(size=(n, 3)),
    "lattice": lambda r, n: r.integers(0, 6, (n, 3)).astype(float),
    "one place": lambda r, n: np.where(r.random((n, 1)) < 0.7, 0.5, r.normal(size=(n, 3))),
    "clusters and an outlier": lambda r, n: np.concatenate([r.integers(0, 3, (n - 1, 1)) + r.normal(0, 1e-7, (n - 1, 3)), [[1e9, -1e9, 0]]]),
    "flat": lambda r, n: np.concatenate([r.uniform(-1, 1, (n, 2)), np.zeros((n, 1))], 1),
}


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("kind", sorted(CLOUDS))
def test_nearest_equal_brute_force(spark, monkeypatch, kind, few):
    monkeypatch.setattr(knn, "ONE_TASK", 10_000 if few else 50)
    r = np.random.default_rng(5)
    at, bt = CLOUDS[kind](r, 300), CLOUDS[kind](r, 500)
    a, b = r.permutation(300) * 2, r.permutation(500) * 2 + 1
    local, world = frame(spark, a, at), frame(spark, b, bt)
    for k, radius in ((1, 0.7), (3, 1.0), (40, np.inf)):
        got = neighbours.nearest_within(local, world, radius, k).select("local_id", "global_id", "d2").collect()
        want = brute(a, at, b, bt, k, radius * radius)
        assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_nearest_of_odd_points_and_empty_sides(spark):
    local = frame(spark, [0, 2, 4, 6], [(0, 0, 0), (np.nan, 0, 0), (np.inf, 0, 0), (5, 5, 5)])
    world = frame(spark, [1, 3, 5], [(0, 0, 0.5), (0, np.nan, 0), (-np.inf, 0, 0)]).union(spark.sql("select 7L, 0d, 0d, cast(null as double)"))
    assert [(x.local_id, x.global_id, x.d2) for x in neighbours.nearest_within(local, world, 1.0).collect()] == [(0, 1, 0.25)]
    assert neighbours.nearest_within(local, world, 0.5).count() == 0  # the radius itself is outside
    none = local.where("point_id < 0")
    assert neighbours.nearest_within(none, world, 1.0, 3).count() == neighbours.nearest_within(local, none, 1.0, 3).count() == 0
    own = F.lit(0.2) + F.lit(0.0) * F.col("lx")
    assert neighbours.nearest_within(local, world, np.inf, 1, own).count() == 0


def test_nearest_at_any_distance(spark):
    r = np.random.default_rng(6)
    at, bt = np.concatenate([r.normal(size=(50, 3)), [[1e6, 0, 0]]]), r.normal(size=(60, 3))
    got = neighbours.nearest_unbounded(frame(spark, range(51), at), frame(spark, range(60), bt)).select("local_id", "global_id", "d2").collect()
    assert len(got) == 51 and {tuple(x) for x in got} == brute(range(51), at, range(60), bt, 1, np.inf)


def test_rows_of_a_match_follow_the_points(spark, dense):
    local, world = queries.sides(spark, dense)
    assert most_rows(neighbours.match_distance(local, world, Pose.identity(), 0.5, 0.0, 1, True)) <= 12 * DENSE


def test_match_limits_grow_with_the_range(spark):
    r = np.random.default_rng(8)
    at, bt = r.normal(0, 3, (200, 3)), r.normal(0, 3, (300, 3))
    got = neighbours.match_distance(frame(spark, range(200), at), frame(spark, range(300), bt), Pose.identity(), 0.3, 10.0, 2, True).collect()
    want = set()
    for i, p in enumerate(at):
        want |= {x[:2] for x in brute([i], [p], range(300), bt, 2, 0.3**2 + np.radians(10.0) ** 2 * (p @ p))}
    assert {(x.local_id, x.global_id) for x in got} == want and len(got) == len(want)


def test_rows_of_the_adaptive_matcher_follow_the_points(spark, dense, monkeypatch):
    seen = []
    kept = neighbours.nearest_within
    monkeypatch.setattr(neighbours, "nearest_within", lambda *a, **k: seen.append(kept(*a, **k)) or seen[-1])
    neighbours.match_adaptive(*queries.sides(spark, dense), Pose.identity(), 0.9, 1.2, 1.0)
    assert len(seen) == 1 and most_rows(seen[0].select("local_id")) <= 12 * DENSE
