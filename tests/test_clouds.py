import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pointweave import queries
from pointweave.functions.se3 import Pose, se3_exp, se3_log
from pointweave.operators import keyframes, neighbours, ordered, predicates, quality, solvers, voxels
from pointweave.plans import icp, mapbuilder, pipeline
from pointweave.plans.expressions import Expression, realised
from pointweave.pointmap import GeoReference, PointMap
from pointweave.sources import files
from pointweave.streaming.velocity import velocity_buffer

D = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events embeddings".split()


def cloud(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point_id bigint, x double, y double, z double")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, D).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE_SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_poses():
    r = np.random.default_rng(1)
    for _ in range(50):
        d = r.normal(size=6)
        p = se3_exp(d)
        q = Pose.of(*r.normal(size=3), *(r.uniform(-1, 1, 3)))
        assert np.allclose(se3_log(p), d) or np.linalg.norm(d[3:]) > math.pi
        assert np.allclose((p @ p.inverse()).values(), 0) and np.allclose(Pose.of(*q.values()).rotation, q.rotation)
    assert np.allclose(Pose.parse("[1 2 3 90 0 0]").apply(np.array([[1.0, 0, 0]])), [[1, 3, 3]])


SCENE = [(0.01 * i, 5, 0) for i in range(10)] + [(10, 0.01 * i, 1) for i in range(10)]
CASES = [((0, 0, 0, 0), []), ((0, 5, 0, 0), [(0, 0)]), ((-2, 5, 0, 0), [(1, 0)]), ((8.5, -1, 1, math.radians(45)), [(1, 19)])]


@pytest.mark.parametrize(("pose", "want"), CASES)
def test_point_matcher_scene(spark, pose, want):
    local, world = cloud(spark, [(0, 0, 0), (2, 0, 0)]), cloud(spark, SCENE)
    got = neighbours.match_distance(local, world, Pose.of(*pose[:3], pose[3]), 1.05, 0.001)
    assert [(r.local_id, r.global_id) for r in got.collect()] == want


@pytest.mark.parametrize("kind", ["pt2pt", "pt2ln", "pt2pl", "pl2pl"])
def test_derivatives(spark, kind):
    r = np.random.default_rng(3)
    names = [f"{k}{a}" for k in ("l", "g", "b", "ln", "gn") for a in "xyz"]
    row = dict(zip(names, r.normal(size=len(names)), strict=True))
    for k in ("u", "n"):
        v = r.normal(size=3)
        row |= dict(zip((f"{k}{a}" for a in "xyz"), v / np.linalg.norm(v), strict=True))
    row["d"] = float(r.normal())
    df = spark.createDataFrame([{k: float(v) for k, v in row.items()}])
    pose = Pose.of(*r.normal(size=3), *r.uniform(-1, 1, 3))

    def errors(p):
        return np.array(df.select(*solvers.residuals(kind, p)[0]).first())

    j = np.array(df.select(*[x for line in solvers.residuals(kind, pose)[1] for x in line]).first()).reshape(3, 6)
    numeric = np.stack([(errors(pose.retract(h)) - errors(pose.retract(-h))) / 2e-5 for h in 1e-5 * np.eye(6)], axis=1)
    assert np.abs(j - numeric).max() < 1e-5


POSES = [Pose.of(), Pose.of(1, 2, 3), Pose.of(0, 0, 0, 0.35), Pose.of(1, 2, 3, -0.17, 0.09, 0.5), Pose.of(0, 0, 0, 3.0)]


@pytest.mark.parametrize("n", range(len(POSES)))
def test_solvers_recover_a_pose(spark, n):
    r = np.random.default_rng(n)
    local = r.uniform(0, 50, (40, 3))
    world = POSES[n].apply(local)
    pairs = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(local, world, strict=True))], "local_id bigint, lx double, ly double, lz double, gx double, gy double, gz double")
    found = [solvers.horn(pairs), solvers.olae(pairs)]
    if n != 4:
        found.append(solvers.gauss_newton({"pt2pt": pairs}, Pose.identity(), 15).pose)
    for p in found:
        assert np.linalg.norm(se3_log(p.inverse() @ POSES[n])) < 1e-3


def test_planes_lines_prior_and_covariance(spark):
    truth = Pose.of(0.2, -0.1, 0.3, 0.17)
    points = np.array([[0.5, 0, 0], [0, 0.8, 0], [0, 0, 0.3], [0.4, 0.1, 0.9], [0.2, 0.7, 0.1], [0.9, 0.3, 0.2]])
    normals = np.array([[0, 0, 1.0], [1, 0, 0], [0, 1, 0]] * 2)
    l = truth.inverse().apply(points)
    planes = spark.createDataFrame([(i, *map(float, a), *map(float, n), float(-n @ p)) for i, (a, n, p) in enumerate(zip(l, normals, points, strict=True))], "local_id bigint, lx double, ly double, lz double, nx double, ny double, nz double, d double")
    lines = spark.createDataFrame([(i, *map(float, a), *map(float, p), *map(float, n)) for i, (a, n, p) in enumerate(zip(l, normals, points, strict=True))], "local_id bigint, lx double, ly double, lz double, bx double, by double, bz double, ux double, uy double, uz double")
    for pairs in ({"pt2pl": planes}, {"pt2ln": lines}):
        got = solvers.gauss_newton(pairs, Pose.identity(), 25).pose
        assert np.linalg.norm(se3_log(got.inverse() @ truth)) < 1e-3
    prior = (Pose.of(2, 3, 4, 0.17, 0.17, 0.17), 100 * np.eye(6))
    assert np.abs(np.array(solvers.gauss_newton({}, Pose.identity(), 20, prior=prior).pose.values()) - prior[0].values()).max() < 0.05
    assert solvers.covariance({"pt2ln": lines}, truth).shape == (6, 6) and solvers.covariance({}, truth)[0, 0] == 1e6
    assert solvers.to_point_pairs(Pose.identity(), lines, planes).groupBy("kind").count().count() == 2


def test_registration(spark):
    r = np.random.default_rng(7)
    u, v = r.uniform(0, 3, (2, 300))
    world = np.concatenate([np.stack([u, v, 0 * u], 1), np.stack([u, 0 * u, v], 1), np.stack([0 * u, u, v], 1)])
    truth = Pose.of(0.1, -0.08, 0.05, 0.05, -0.03, 0.02)
    local, there = cloud(spark, truth.inverse().apply(world)), cloud(spark, world)
    for solver in (icp.horn_solver, icp.olae_solver, icp.gauss_newton_solver(kernel="Cauchy", c=0.5)):
        got = icp.align(local, there, matchers=[(icp.distance_matcher(0.3), icp.Gate())], solver_list=[(solver, icp.Gate())], parameters=icp.Parameters(max_iterations=12))
        assert np.linalg.norm(se3_log(got.pose.inverse() @ truth)) < 0.1 and got.quality > 0.9
    far = icp.align(local, cloud(spark, world + 100), parameters=icp.Parameters(max_iterations=3))
    assert far.reason == "NoPairings" and far.quality == 0


def test_line_plane_and_adaptive_matchers(spark):
    line = cloud(spark, [(0.1 * i, 0, 0) for i in range(30)])
    one = cloud(spark, [(1.5, 0.05, 0)])
    assert neighbours.match_line(one, line, Pose.identity(), 0.5, 5, 0.01).count() == 1
    r = np.random.default_rng(2)
    flat = cloud(spark, np.concatenate([r.uniform(0, 3, (400, 2)), np.zeros((400, 1))], 1))
    above = cloud(spark, [(1.5, 1.5, 0.05), (1.5, 1.5, 0.6)])
    got = neighbours.match_plane(above, flat, Pose.identity(), 0.2, 1.0).collect()
    assert [x.local_id for x in got] == [0] and abs(abs(got[0].nz) - 1) < 1e-6
    pairs, planes = neighbours.match_adaptive(above, flat, Pose.identity(), 0.9, 1.2, 1.0, True)
    assert planes.count() == 1 and pairs.where("local_id = 0").count() == 0


def test_scale_outliers_and_kernels(spark):
    rows = [(i, float(i), 0.0, float(i % 3), float(i), 0.0, float(i % 3)) for i in range(20)] + [(20, 1.0, 1.0, 1.0, 30.0, 30.0, 30.0)]
    pairs = spark.createDataFrame(rows, "local_id bigint, lx double, ly double, lz double, gx double, gy double, gz double")
    assert solvers.without_scale_outliers(pairs, 1.5).where("local_id = 20").count() == 0
    got = spark.range(1).select(solvers.robust_weight("Cauchy", F.lit(1.0), 2.0).alias("a"), solvers.robust_weight("GemanMcClure", F.lit(1.0), 2.0).alias("b")).first()
    assert got.a == pytest.approx(0.8) and got.b == pytest.approx(4 / 9)


def test_range_image_likeness(spark):
    pts = [(2 + 0.01 * i, 0.1 * (i % 7) - 0.3, 0.1 * (i % 5) - 0.2) for i in range(35)]
    camera = {"ncols": 100, "nrows": 60, "fx": 20.0, "fy": 20.0, "cx": 50.0, "cy": 30.0}
    same = quality.range_image_score(cloud(spark, pts), cloud(spark, pts), Pose.identity(), camera).first().score
    off = quality.range_image_score(cloud(spark, pts), cloud(spark, pts), Pose.of(0.5), camera).first().score
    assert same == pytest.approx(1.0) and off < 0.5


def test_ordered_operators(spark):
    ring = cloud(spark, [(math.cos(a), math.sin(a), 0) for a in np.linspace(0, 6.0, 40)]).withColumn("ring", F.lit(1))
    assert ordered.spaced(ring, 0.3).count() < 25 and ordered.curvature(ring, clearance=0.3).count() < 25
    depth = spark.createDataFrame([(0, r, c, 5.0 if c < 64 else 9.0) for r in range(16) for c in range(128)], "scan_id int, row int, col int, depth double")
    parts = ordered.depth_edges_planes(depth, 4.0)
    assert parts["edges"].count() > 0 and parts["planes"].count() > 0


def test_expressions():
    e = Expression("MATCH_THRESHOLD*2.0")
    assert e.value({"MATCH_THRESHOLD": 1.5}) == 3.0 and e.value({"MATCH_THRESHOLD": 0.5}) == 1.0
    with pytest.raises(ValueError, match="MATCH_THRESHOLD"):
        e.value()
    with pytest.raises(ValueError, match="not allowed"):
        Expression("__import__('os').system('x')")
    assert realised({"a": ["1+1", "name.with", "$f{2*3}"], "b": True}) == {"a": [2.0, "name.with", 6.0], "b": True}


YAML = """
filters:
  - {class_name: 'ns::FilterByRange', params: {input_pointcloud_layer: raw, output_layer_between: near, output_layer_outside: far, range_min: 1, range_max: 2*R}}
  - {class_name: FilterNormalizeIntensity, params: {pointcloud_layer: near}}
  - {class_name: FilterAdjustTimestamps, params: {pointcloud_layer: near, method: 'M::EarliestIsZero', silently_ignore_no_timestamps: true}}
  - {class_name: FilterDeskew, params: {input_pointcloud_layer: near, output_pointcloud_layer: still, twist: [1, 0, 0, 0, 0, 0.1]}}
  - {class_name: FilterByRing, params: {input_pointcloud_layer: near, output_layer_selected: rings, selected_ring_ids: [1, 2]}}
  - {class_name: FilterBoundingBox, params: {inside_pointcloud_layer: box, bounding_box_min: [-1, -1, -1], bounding_box_max: [1, 1, 1]}}
  - {class_name: FilterByIntensity, params: {input_pointcloud_layer: near, output_layer_high_intensity: bright, low_threshold: 0.2, high_threshold: 0.6}}
  - {class_name: FilterDecimateVoxelsQuadratic, params: {output_pointcloud_layer: quad, voxel_filter_resolution: 0.5, quadratic_reference_radius: 2, use_voxel_average: true}}
  - {class_name: FilterDecimateAdaptive, params: {output_pointcloud_layer: few, desired_output_point_count: 50}}
  - {class_name: FilterCurvature, params: {input_pointcloud_layer: raw, max_cosine: 0.5, min_clearance: 0.02, max_gap: 2, output_layer_larger_curvature: bends}}
  - {class_name: FilterPoleDetector, params: {input_pointcloud_layer: raw, output_layer_poles: poles, grid_size: 1, minimum_relative_height: 0.1, maximum_relative_height: 5}}
  - {class_name: FilterEdgesPlanes, params: {voxel_filter_resolution: 1, voxel_filter_decimation: 1, full_pointcloud_decimation: 2, voxel_filter_max_e2_e0: 30, voxel_filter_min_e2_e0: 30}}
  - {class_name: FilterMerge, params: {input_pointcloud_layer: far, target_layer: near, input_layer_in_local_coordinates: true, robot_pose: [1, 0, 0, 0, 0, 0]}}
  - {class_name: FilterDeleteLayer, params: {pointcloud_layer_to_remove: far}}
"""


def test_pipeline_from_yaml(spark):
    raw = queries.points(spark, D)
    out = pipeline.run_yaml(YAML, PointMap({"raw": raw}), variables={"R": 1.5})
    assert "far" not in out.layers and out.layer("near").count() == raw.count()  # what lay outside came back from the other layer
    sizes = {k: v.count() for k, v in out.layers.items()}
    assert sizes["few"] == 50 and sizes["still"] == raw.where("x*x+y*y+z*z between 1 and 9").count() and sizes["rings"] > 0
    assert out.planes is not None
    with pytest.raises(KeyError, match="no operator"):
        pipeline.filters([{"class_name": "Nothing"}])


def test_map_builder_and_keyframes(spark):
    kfs = spark.createDataFrame([(0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 20.0, 0.0, 0.0, math.pi / 2, 0.0, 0.0)], "kf_id bigint, x double, y double, z double, yaw double, pitch double, roll double")
    obs = spark.createDataFrame([(0, 0, "scan", "front"), (1, 1, "scan", "front"), (2, 1, "comment", "front")], "obs_id bigint, kf_id bigint, class string, label string")
    points = spark.createDataFrame([(o, i, 1.0, 0.0, 0.0) for o in range(3) for i in range(3)], "obs_id bigint, point_id bigint, x double, y double, z double")
    m = mapbuilder.build(kfs, obs, points, {"generators": [{"params": {"target_layer": "raw", "process_class_names_regex": "sc.*"}}], "filters": [{"class_name": "FilterDecimateVoxels", "params": {"output_pointcloud_layer": "thin", "decimate_method": "VoxelAverage", "voxel_filter_resolution": 0.5}}]})
    got = sorted((round(r.x, 6), round(r.y, 6)) for r in m.layer("thin").collect())
    assert got == [(11.0, 0.0), (20.0, 1.0)] and m.layer("raw").count() == 6
    turned = keyframes.turned(kfs, Pose.of(0, 0, 0, math.pi / 2)).orderBy("kf_id").collect()
    assert turned[0].y == pytest.approx(10) and turned[1].yaw == pytest.approx(math.pi)
    tilted = keyframes.moved_places(cloud(spark, [(i, (i * 7) % 5, 0) for i in range(20)]).withColumn("kf_id", F.col("point_id")), Pose.of(0, 0, 0, 0, 0.1, 0.05))
    fixed = keyframes.moved_places(tilted, keyframes.level(tilted)).agg(F.stddev_pop("z").alias("s")).first().s
    assert fixed < 1e-3


def test_times(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 2.6), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 0.9, "a"), (1, 3.0, "b")], "k int, t double, v string")
    got = {(r.k, r.t): r.v for r in keyframes.nearest_in_time(left, right, ["k"], "v", 0.5).collect()}
    assert got == {(1, 1.0): "a", (1, 2.6): "b", (2, 1.0): None}
    pts = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 0.0), (0, 1.0, 1.0, 0.0, 0.0)], "scan_id int, t double, x double, y double, z double")
    rates = spark.createDataFrame([(0, 0.0, 0.0, 0.0, math.pi / 2)], "scan_id int, t double, wx double, wy double, wz double")
    out = {r.t: (round(r.x, 6), round(r.y, 6)) for r in keyframes.deskew_by_rates(pts, rates).collect()}
    assert out == {0.0: (1.0, 0.0), 1.0: (0.0, 1.0)}


def test_streamed_velocities(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.0, 5.0), ("b", 0.0, 7.0)], "key string, t double, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = velocity_buffer(stream).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("select * from held").collect())
    assert got == [("a", 0.0, 1, 1.0), ("a", 1.0, 2, 2.0), ("a", 2.0, 2, 4.0), ("b", 0.0, 1, 7.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3 0.5\n4,5,6,0.7\n\n7\t8\t9\t1\n")
    got = files.read_text(spark, str(tmp_path / "a.txt"), "xyzi").orderBy("point_id").collect()
    assert [(r.x, r.z, r.intensity) for r in got] == [(1, 3, 0.5), (4, 6, 0.7), (7, 9, 1.0)]
    np.arange(8, dtype="<f4").tofile(tmp_path / "s.bin")
    assert [r.intensity for r in files.read_kitti(spark, str(tmp_path / "s.bin")).orderBy("point_id").collect()] == [3.0, 7.0]
    m = PointMap({"raw": cloud(spark, [(1, 2, 3), (4, 5, 6)]), "b": cloud(spark, [(0, 0, 0)])}, id=3, label="x", metadata={"name": "spot", "n": [1, 2]}, georeference=GeoReference(4.2, 23.0, 100.0, (1.0, 2.0, 3.0, 0.0, 0.0, 0.0)))
    files.save_map(m, str(tmp_path / "map"))
    back = files.load_map(spark, str(tmp_path / "map"))
    assert back.metadata == m.metadata and back.georeference == m.georeference and back.size() == 3 and back.layer("raw").columns == m.layer("raw").columns
    assert files.georeference_from_yaml(files.georeference_yaml(m.georeference)) == m.georeference
    files.write_text(m.layer("raw"), str(tmp_path / "out"))
    assert files.read_text(spark, str(tmp_path / "out")).count() == 2
    poses = spark.createDataFrame([(1.0, 1.0, 2.0, 3.0, 0.1, 0.2, 0.3)], "t double, x double, y double, z double, yaw double, pitch double, roll double")
    files.write_trajectory(poses, str(tmp_path / "tum"))
    q = files.read_trajectory(spark, str(tmp_path / "tum")).first()
    r = solvers.rotation_of(np.array([q.qw, q.qx, q.qy, q.qz]))
    assert np.allclose(r, Pose.of(0, 0, 0, 0.1, 0.2, 0.3).rotation)


def test_maps(spark):
    planes = spark.createDataFrame([(0.0, 0.0, 1.0, -2.0, 1.0, 1.0, 2.0)], "nx double, ny double, nz double, d double, c_x double, c_y double, c_z double")
    a, b = PointMap({"raw": cloud(spark, [(0, 0, 0)])}), PointMap({"raw": cloud(spark, [(1, 0, 0)])}, planes=planes)
    m = a.merged(b, Pose.of(0, 0, 3, math.pi / 2))
    p = m.planes.first()
    assert m.size() == 3 and m.size_points_only() == 2 and (round(p.d, 6), round(p.c_z, 6)) == (-5.0, 5.0)
    assert PointMap().empty() and not a.empty()
    with pytest.raises(KeyError):
        a.layer("none")


def test_box_reaches_the_scan(spark, tmp_path):
    cloud(spark, [(1, 2, 3), (4, 5, 6)]).write.parquet(str(tmp_path / "p"))
    plan = predicates.by_box(spark.read.parquet(str(tmp_path / "p")), (0.0, 0.0, 0.0), (2.0, 3.0, 4.0))["inside"].select("x")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(x)" in plan and "GreaterThanOrEqual(x,0.0), LessThanOrEqual(x,2.0)" in plan


def test_adaptive_and_minimum(spark):
    df = cloud(spark, np.random.default_rng(0).uniform(0, 10, (500, 3)))
    assert voxels.adaptive(df, 120).count() == 120 and voxels.adaptive(df, 10_000).count() == 500 and voxels.adaptive(df.where("false"), 5).count() == 0
    assert voxels.decimated(df, 5.0, minimum_points=1000).count() == 500
