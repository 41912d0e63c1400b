"""Command line: convert, filter, register and inspect clouds, maps and keyframe tables."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession

from pointweave.functions.se3 import Pose
from pointweave.operators import keyframes
from pointweave.plans import mapbuilder, pipeline, registration
from pointweave.pointmap import PointMap
from pointweave.sources import files


def _map(spark: SparkSession, name: str, layer: str = "raw") -> PointMap:
    got = files.open_cloud(spark, name)
    return got if isinstance(got, PointMap) else PointMap({layer: got})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pointweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        return c

    command("import-text", "input", "output").add_argument("--format", default="xyz", choices=sorted(files.FORMATS))
    command("import-kitti", "input", "output")
    command("export-text", "input", "output").add_argument("-l", "--layer", action="append")
    command("info", "input")
    f = command("filter", "input", "output", "pipeline")
    f.add_argument("--rename-layer", action="append", default=[], help="old|new")
    r = command("register", "local", "world", "config")
    r.add_argument("--guess", default="[0 0 0 0 0 0]", help="x y z and yaw pitch roll in degrees")
    r.add_argument("--layer", default="raw")
    command("build", "keyframes", "observations", "points", "config", "output")
    command("keyframes-info", "input")
    c = command("keyframes-cut", "input", "output")
    c.add_argument("--from-index", type=int, required=True)
    c.add_argument("--to-index", type=int, required=True)
    command("keyframes-join", "output").add_argument("inputs", nargs="+")
    command("keyframes-move", "input", "output", "pose")
    command("keyframes-level", "input", "output")
    t = command("keyframes-trim", "input", "output")
    for a in "xyz":
        t.add_argument(f"--min-{a}", type=float)
        t.add_argument(f"--max-{a}", type=float)
    command("keyframes-export", "input", "observations", "output").add_argument("--twists", help="where to write the twists")
    command("keyframes-export-log", "input", "observations", "output")
    g = command("georeference", "map")
    g.add_argument("--extract", help="file to write the map's reference to")
    g.add_argument("--inject", help="file to read the reference from")
    g.add_argument("--output", help="the map with the reference that was read")
    command("scans", "keyframes", "observations", "points", "config", "output")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "import-text":
        files.save_map(PointMap({"raw": files.read_text(spark, a.input, a.format)}, label=a.input), a.output)
    elif a.command == "import-kitti":
        files.save_map(PointMap({"raw": files.read_kitti(spark, a.input)}, label=a.input), a.output)
    elif a.command == "export-text":
        m = _map(spark, a.input)
        for name in a.layer or m.layers:
            files.write_text(m.layer(name), f"{a.output}_{name}")
    elif a.command == "info":
        _map(spark, a.input).contents().orderBy("layer").show(1000, False)
    elif a.command == "filter":
        m = _map(spark, a.input)
        with open(a.pipeline) as f:
            m = pipeline.run_yaml(f.read(), m)
        for pair in a.rename_layer:
            m = m.renamed(*pair.split("|"))
        files.save_map(m, a.output)
    elif a.command == "register":
        with open(a.config) as f:
            run = registration.from_config(pipeline.from_yaml(f.read()))
        print(registration.summary(run.run(_map(spark, a.local), _map(spark, a.world), Pose.parse(a.guess), a.layer)))
    elif a.command == "build":
        with open(a.config) as f:
            config = pipeline.from_yaml(f.read())
        files.save_map(mapbuilder.build(*[spark.read.parquet(x) for x in (a.keyframes, a.observations, a.points)], config), a.output)
    elif a.command == "scans":
        with open(a.config) as f:
            config = pipeline.from_yaml(f.read())
        mapbuilder.scans(*[spark.read.parquet(x) for x in (a.keyframes, a.observations, a.points)], config).write.mode("overwrite").parquet(a.output)
    elif a.command == "georeference":
        m = files.load_map(spark, a.map)
        if a.extract:
            if m.georeference is None:
                raise SystemExit("the map has no geographic reference")
            with open(a.extract, "w") as f:
                f.write(files.georeference_yaml(m.georeference))
        if a.inject:
            with open(a.inject) as f:
                files.save_map(replace(m, georeference=files.georeference_from_yaml(f.read())), a.output)
    elif a.command in ("keyframes-export", "keyframes-export-log"):
        kfs, obs = spark.read.parquet(a.input), spark.read.parquet(a.observations)
        if a.command == "keyframes-export-log":
            keyframes.as_observations(kfs, obs).write.mode("overwrite").parquet(a.output)
        else:
            files.write_trajectory(keyframes.trajectory(kfs, obs), a.output)
            if a.twists:
                files.write_twists(keyframes.twists(kfs, obs), a.twists)
    elif a.command == "keyframes-info":
        keyframes.info(spark.read.parquet(a.input)).show(1, False)
    else:
        kfs = [spark.read.parquet(x) for x in (a.inputs if a.command == "keyframes-join" else [a.input])]
        out = {
            "keyframes-cut": lambda: keyframes.cut(kfs[0], a.from_index, a.to_index),
            "keyframes-trim": lambda: keyframes.trim(kfs[0], (a.min_x, a.min_y, a.min_z), (a.max_x, a.max_y, a.max_z)),
            "keyframes-join": lambda: keyframes.joined(kfs),
            "keyframes-move": lambda: keyframes.turned(kfs[0], Pose.parse(a.pose)),
            "keyframes-level": lambda: keyframes.turned(kfs[0], keyframes.level(kfs[0])),
        }[a.command]()
        out.write.mode("overwrite").parquet(a.output)


if __name__ == "__main__":
    main()
