"""Builders, configured registration beyond point pairs, its log, streams of frames and the command line."""

import numpy as np
import pytest

from pointweave import cli
from pointweave.functions import geometry as g
from pointweave.functions.se3 import Pose, se3_log
from pointweave.operators import keyframes, neighbours, predicates, solvers, voxels
from pointweave.plans import icp, mapbuilder, pipeline, registration
from pointweave.pointmap import GeoReference, PointMap
from pointweave.sources import files
from pointweave.streaming import frames
from pyspark.sql import functions as F
from tests.test_clouds import cloud


def room(n=240, seed=1):
    """Points on three walls."""
    r = np.random.default_rng(seed)
    p = r.uniform(0, 4, (n, 3))
    p[np.arange(n), np.arange(n) % 3] = 0
    return p


def observations(spark):
    obs = spark.createDataFrame([(0, 0, "points", "front"), (1, 1, "points", "rear"), (2, 1, "imu", "imu")], "obs_id bigint, kf_id bigint, class string, label string")
    kfs = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0)], "kf_id bigint, x double, y double, z double, yaw double, pitch double, roll double, vx double")
    rows = [(o, 10 * o + i, 0.1 * i, 0.0, 0.0, float(i)) for o in (0, 1) for i in range(6)]
    return kfs, obs, spark.createDataFrame(rows, "obs_id bigint, point_id bigint, x double, y double, z double, t double")


def test_filters_see_one_observation_at_a_time(spark):
    kfs, obs, points = observations(spark)
    config = {"filters": [{"class_name": "FilterAdjustTimestamps", "params": {"pointcloud_layer": "raw", "method": "EarliestIsZero", "time_offset": 0.0}}, {"class_name": "FilterDecimateVoxels", "params": {"input_pointcloud_layer": "raw", "output_pointcloud_layer": "thin", "decimate_method": "FirstPoint", "voxel_filter_resolution": 100.0}}]}
    m = mapbuilder.build(kfs, obs, points, config)
    assert sorted(r["point_id"] for r in m.layer("thin").collect()) == [0, 10]
    assert "robot_x" not in m.layer("raw").columns
    twist = {"filters": [{"class_name": "FilterDeskew", "params": {"input_pointcloud_layer": "raw", "output_pointcloud_layer": "still", "twist": ["vx", 0, 0, 0, 0, 0]}}]}
    got = {r["point_id"]: r["x"] for r in mapbuilder.build(kfs, obs, points, twist).layer("still").collect()}
    assert got[3] == pytest.approx(0.3 + 3) and got[13] == pytest.approx(10.3 + 6)
    whole = {"filters": [{"class_name": "FilterDecimateAdaptive", "params": {"input_pointcloud_layer": "raw", "output_pointcloud_layer": "a", "desired_output_point_count": 3}}]}
    with pytest.raises(ValueError, match="final filters"):
        mapbuilder.build(kfs, obs, points, whole)


def test_generators(spark):
    kfs, obs, points = observations(spark)
    only = [{"class_name": "Generator", "params": {"target_layer": "cells", "process_class_names_regex": "", "metric_map_definition": {"class": "VoxelMap", "resolution": "$f{0.25*2}"}}}, {"class_name": "Generator", "params": {"target_layer": "cells", "metric_map_definition": {"resolution": 0.5}, "process_class_names_regex": "points"}}]
    m = mapbuilder.build(kfs, obs, points, {"generators": only})
    assert m.layer("cells").count() == 4 and voxels.resolution_of(m.layer("cells")) == 0.5
    strict = [{"class_name": "Generator", "params": {"process_class_names_regex": "points", "throw_on_unhandled_observation_class": True}}]
    with pytest.raises(ValueError, match="imu"):
        mapbuilder.build(kfs, obs, points, {"generators": strict})
    assert [r["obs_id"] for r in mapbuilder.entry(obs, "log:1").orderBy("obs_id").collect()] == [1, 2] and mapbuilder.entry(obs, "log:7").count() == 0
    out = mapbuilder.scans(kfs, obs, points, {})
    assert {r["out_layer"] for r in out.collect()} == {"out_raw"} and out.agg(F.max("x")).first()[0] < 1


@pytest.mark.parametrize("matcher", [{"class": "Matcher_Point2Plane", "params": {"distanceThreshold": "0.5/(1+ICP_ITERATION)+0.2", "searchRadius": 1.0, "knn": 6, "planeEigenThreshold": 0.05}}, {"class": "Matcher_Adaptive", "params": {"confidenceInterval": 0.9, "firstToSecondDistanceMax": 1.2, "absoluteMaxSearchDistance": 1.0, "enableDetectPlanes": True}}])
def test_registration_with_planes(spark, tmp_path, matcher):
    world, truth = room(), Pose.of(0.05, -0.04, 0.03, 0.02)
    config = {"params": {"maxIterations": 4}, "matchers": [matcher], "solvers": [{"class": "Solver_GaussNewton", "params": {"maxIterations": 3, "pair_weights": {"pt2pl": 1.0, "pt2pt": 0.1}}}], "quality": [{"class": "QualityEvaluator_Voxels", "params": {"voxel_layer_name": "cells"}}]}
    run = registration.from_config(config)
    local, fixed = (PointMap({"raw": (c := cloud(spark, p)), "cells": voxels.occupancy(c, 0.5)}) for p in (truth.inverse().apply(room(seed=2)), world))
    got = run.run(local, fixed)
    assert np.linalg.norm(se3_log(got.pose.inverse() @ truth)) < 0.05 and 0 < got.quality <= 1 and got.n_pairs <= got.potential
    path = registration.log_run(spark, str(tmp_path), got, local, fixed, run, number=4, every=2, before=[lambda m: m.without("cells")])
    kept = registration.read_run(spark, path)
    assert kept["n_pairs"] == got.n_pairs and list(kept["local"].layers) == ["raw"] and kept["trace"].count() == len(got.trace)
    assert registration.log_run(spark, str(tmp_path), got, local, fixed, run, number=5, every=2) is None


def test_matchers_leave_each_others_points(spark):
    a, b = cloud(spark, [(0, 0, 0), (1, 0, 0)]), cloud(spark, [(0.1, 0, 0), (5, 0, 0)])
    one = icp.distance_matcher(0.5, reuse_global=False)
    pairs, potential = icp.matched([one, icp.distance_matcher(2.0, reuse_global=False)], a, b, Pose.identity())
    assert sorted((r["local_id"], r["global_id"]) for r in pairs["pt2pt"].collect()) == [(0, 0)] and potential == 4
    loose = icp.distance_matcher(2.0, reuse_global=True)
    pairs, _ = icp.matched([one, loose], a, b, Pose.identity())
    assert sorted((r["local_id"], r["global_id"]) for r in pairs["pt2pt"].collect()) == [(0, 0), (1, 0)]
    assert neighbours.sampled(a, 1).count() == 1


def test_outliers_of_scale_are_left_out(spark):
    world = room(60)
    truth = Pose.of(0.3, 0.1, -0.2, 0.2)
    l = truth.inverse().apply(world)
    l[:3] *= 4
    rows = [(i, *map(float, l[i]), *map(float, world[i])) for i in range(60)]
    pairs = spark.createDataFrame(rows, "local_id bigint, lx double, ly double, lz double, gx double, gy double, gz double")
    plain, robust = (np.linalg.norm(se3_log(s({"pt2pt": pairs}, Pose.identity()).inverse() @ truth)) for s in (icp.horn(), icp.horn(outliers=1.3)))
    assert robust < plain


def test_turned_with_covariance(spark):
    r = np.random.default_rng(0)
    m = r.normal(size=(6, 6))
    cov, own, pose = m @ m.T, Pose.of(1, 2, 3, 0.4, -0.3, 0.2), Pose.of(-1, 0.5, 2, 1.0, 0.2, -0.7)
    kfs = spark.createDataFrame([(0, *map(float, own.values()), cov.ravel().tolist()), (1, *map(float, own.values()), None)], "kf_id bigint, x double, y double, z double, yaw double, pitch double, roll double, cov array<double>")
    got = keyframes.turned(kfs, pose).orderBy("kf_id").collect()
    assert np.allclose([got[0][k] for k in keyframes.POSE], (pose @ own).values()) and got[1]["cov"] is None
    j = np.eye(6)
    j[:3, :3] = pose.rotation
    assert np.allclose(np.array(got[0]["cov"]).reshape(6, 6), j @ cov @ j.T)


def test_streams_of_frames_and_buffers(spark, tmp_path):
    kfs, obs, points = observations(spark)
    points.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    q = frames.filter_stream(stream, kfs, obs, {}, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == points.count()
    samples = spark.createDataFrame([(0.0, "linear", 1.0, 2.0, 3.0), (9.0, "linear", 4.0, 5.0, 6.0), (9.5, "angular", 0.1, 0.2, 0.3)], "t double, kind string, a double, b double, c double")
    back, zero = frames.restored(spark, frames.buffer_state(samples, 9.25))
    assert zero == 9.25 and sorted(map(tuple, back.collect())) == [(9.0, "linear", 4.0, 5.0, 6.0), (9.5, "angular", 0.1, 0.2, 0.3)]
    assert frames.shifted_zero(1.0, points.select("t"), "middle_is_zero") == 3.5
    imu = spark.createDataFrame([(0.0, 1.0, 0.0, 0.0), (1.0, None, 0.0, 0.0)], "t double, wx double, wy double, wz double")
    (r,) = frames.rotated_rates(imu, Pose.of(yaw=np.pi / 2).rotation).collect()
    assert (round(r["wx"], 9), round(r["wy"], 9)) == (0.0, 1.0)


def test_files_and_command_line(spark, tmp_path):
    m = PointMap({"raw": cloud(spark, room(20)), "cells": voxels.occupancy(cloud(spark, room(20)), 1.0)}, georeference=GeoReference(1.0, 2.0, 3.0))
    files.save_map(m, str(tmp_path / "m"))
    cli.main(["georeference", str(tmp_path / "m"), "--extract", str(tmp_path / "g.yaml")], spark)
    cli.main(["georeference", str(tmp_path / "m"), "--inject", str(tmp_path / "g.yaml"), "--output", str(tmp_path / "n")], spark)
    assert files.load_map(spark, str(tmp_path / "n")).georeference.latitude == 1.0
    cli.main(["export-text", str(tmp_path / "m"), str(tmp_path / "t"), "-l", "cells"], spark)
    assert spark.read.text(str(tmp_path / "t_cells")).count() == m.layer("cells").count()
    with pytest.raises(ValueError, match="not a layer"):
        files.write_text(m.layer("raw").drop("x"), str(tmp_path / "no"))
    (tmp_path / "short.xyz").write_text("1 2\n")
    with pytest.raises(Exception, match="fewer than 3"):
        files.read_text(spark, str(tmp_path / "short.xyz")).collect()
    kfs, obs, points = observations(spark)
    kfs = kfs.withColumns({"ts": F.lit(0.0), **{k: F.lit(0.0) for k in ("vy", "vz", "wx", "wy", "wz")}})
    for name, df in (("k", kfs), ("o", obs.withColumns({"ts": F.col("obs_id") + F.lit(0.5), "payload": F.lit("p")})), ("p", points)):
        df.write.parquet(str(tmp_path / name))
    k, o = str(tmp_path / "k"), str(tmp_path / "o")
    cli.main(["keyframes-trim", k, str(tmp_path / "k2"), "--min-x", "5"], spark)
    assert spark.read.parquet(str(tmp_path / "k2")).count() == 1
    cli.main(["keyframes-export", k, o, str(tmp_path / "tum"), "--twists", str(tmp_path / "tw")], spark)
    assert files.read_trajectory(spark, str(tmp_path / "tum")).count() == 2 and spark.read.text(str(tmp_path / "tw")).count() == 2
    cli.main(["keyframes-export-log", k, o, str(tmp_path / "log")], spark)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3 + 2 + 2
    (tmp_path / "c.yaml").write_text("generators: []\n")
    cli.main(["scans", k, o, str(tmp_path / "p"), str(tmp_path / "c.yaml"), str(tmp_path / "s")], spark)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 12
    assert keyframes.info(kfs.withColumn("ts", F.timestamp_seconds("kf_id"))).select("span", "has_twist").first() == (1.0, True)


def test_own_map_tells_its_points(spark):
    """Points at negative coordinates lie in the voxels that they make."""
    p = cloud(spark, [(-0.5, -0.5, -0.5)] * 10)
    cells = voxels.occupancy(p, 1.0)
    assert predicates.by_occupancy(p, cells, voxels.resolution_of(cells), 0.6)["static"].count() == 10
    merged = voxels.merged(cells, cells).first()
    assert merged["log_odds"] == 3.5
    m = pipeline.run_yaml("filters:\n - {class_name: FilterRemoveByVoxelOccupancy, params: {input_pointcloud_layer: raw, input_voxel_layer: cells, occupancy_threshold: 0.6, output_layer_static_objects: s}}", PointMap({"raw": p, "cells": cells}))
    assert m.layer("s").count() == 10 and pipeline.PROFILE["FilterRemoveByVoxelOccupancy"][1] >= 1


def test_erf_and_colours(spark):
    import math

    xs = [(-3.0,), (-0.4,), (0.0,), (1e-3,), (0.7,), (5.0,)]
    rows = spark.createDataFrame(xs, "v double").select("v", g.erf(F.col("v")).alias("e"), F.struct(*g.recolored(F.col("v"), F.lit(-3.0), F.lit(5.0))).alias("c")).collect()
    assert all(abs(r["e"] - math.erf(r["v"])) < 2e-7 for r in rows) and tuple(rows[0]["c"]) == (0.0, 0.0, 1.0) and tuple(rows[-1]["c"]) == (1.0, 0.0, 0.0)


def test_quadratic_form_equals_the_normal_equations(spark):
    r = np.random.default_rng(6)
    names = [f"{k}{a}" for k in ("l", "g", "u", "b", "n", "ln", "gn") for a in "xyz"]
    m = r.normal(size=(40, len(names)))
    m[:, 6:9] /= np.linalg.norm(m[:, 6:9], axis=1)[:, None]
    pairs = spark.createDataFrame([(*map(float, x), float(i % 3 + 1), float(x[0])) for i, x in enumerate(m)], [*names, "weight", "d"])
    pose = Pose.of(0.3, -0.2, 0.5, 0.7, -0.1, 0.4)
    x, j = np.concatenate([pose.rotation, pose.translation[:, None]], axis=1).ravel(), solvers._directions(pose)
    for kind in solvers.KINDS:
        n, h, grad, cost = solvers.normal_equations({kind: pairs}, pose)
        count, a, b, c = solvers.quadratic_sums(pairs, kind)
        assert count == n == 40 and np.allclose(j.T @ a @ j, h) and np.allclose(j.T @ (a @ x - b), grad) and np.isclose(x @ a @ x - 2 * b @ x + c, cost)
