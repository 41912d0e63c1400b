import numpy as np

from pointweave import cli
from pointweave.functions.se3 import Pose, se3_log
from pointweave.plans import registration
from pointweave.pointmap import PointMap
from tests.test_clouds import cloud

CONFIG = {
    "params": {"maxIterations": 10},
    "matchers": [{"class": "ns::Matcher_Points_DistanceThreshold", "params": {"threshold": "2*S", "thresholdAngularDeg": 0, "allowMatchAlreadyMatchedGlobalPoints": True}}],
    "solvers": [{"class": "Solver_GaussNewton", "params": {"maxIterations": 2, "runUpToIteration": 1}}, {"class": "Solver_Horn"}],
    "quality": [{"class": "QualityEvaluator_PairedRatio", "weight": 2}],
    "filters": [{"class_name": "FilterDecimateVoxels", "params": {"output_pointcloud_layer": "thin", "decimate_method": "FirstPoint", "voxel_filter_resolution": 0.05}}],
}


def test_from_configuration(spark, tmp_path):
    world = np.random.default_rng(0).uniform(0, 3, (400, 3))
    truth = Pose.of(0.05, -0.04, 0.03, 0.02)
    run = registration.from_config(CONFIG, {"S": 0.2})
    got = run.run(PointMap({"raw": cloud(spark, truth.inverse().apply(world))}), PointMap({"raw": cloud(spark, world)}))
    assert np.linalg.norm(se3_log(got.pose.inverse() @ truth)) < 0.05 and got.quality > 0.9
    registration.log(spark, got, str(tmp_path / "log"), "a")
    assert registration.read_log(spark, str(tmp_path / "log"), "a").count() == len(got.trace)
    assert got.reason in registration.summary(got)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.xyz").write_text("0 0 0\n1 1 1\n1.01 1 1\n")
    cli.main(["import-text", str(tmp_path / "a.xyz"), str(tmp_path / "m")], spark)
    (tmp_path / "p.yaml").write_text("filters:\n  - {class_name: FilterDecimateVoxels, params: {output_pointcloud_layer: thin, decimate_method: FirstPoint, voxel_filter_resolution: 0.5}}\n")
    cli.main(["filter", str(tmp_path / "m"), str(tmp_path / "out"), str(tmp_path / "p.yaml"), "--rename-layer", "thin|few"], spark)
    cli.main(["info", str(tmp_path / "out")], spark)
    assert "few" in capsys.readouterr().out
    cli.main(["export-text", str(tmp_path / "out"), str(tmp_path / "txt"), "-l", "few"], spark)
    assert spark.read.text(str(tmp_path / "txt_few")).count() == 2
