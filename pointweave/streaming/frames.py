"""Observations as a stream: each batch goes through generators and filters and is appended to tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.plans import mapbuilder


def filter_stream(points: DataFrame, kfs: DataFrame, obs: DataFrame, config: dict, path: str, checkpoint: str, variables: dict[str, float] | None = None):
    """Starts a query that appends what :func:`mapbuilder.scans` makes of each batch of ``points``.

    A batch holds whole observations.  Batches are written under their number,
    so one that is run again after a failure takes the place of its first run.
    """

    def write(batch: DataFrame, number: int) -> None:
        mapbuilder.scans(kfs, obs, batch, config, variables).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def rotated_rates(imu: DataFrame, rotation) -> DataFrame:
    """Samples ``t, wx, wy, wz`` of a gyroscope in the vehicle's frame; those without all three axes are left out."""
    w = [F.col(f"w{a}") for a in "xyz"]
    there = {f"w{a}": sum((F.lit(float(rotation[i][j])) * w[j] for j in range(3)), F.lit(0.0)) for i, a in enumerate("xyz")}
    return imu.dropna(subset=["wx", "wy", "wz"]).withColumns(there)


def buffer_state(samples: DataFrame, zero: float | None = None, seconds: float = 1.5) -> str:
    """What a buffer of the last ``seconds`` holds, with its zero time, as text; ``samples`` are ``t, kind, a, b, c``.

    The window bounds what comes to the driver to the samples of ``seconds``.
    """
    last = samples.agg(F.max("t")).first()[0]
    held = [] if last is None else samples.where(F.col("t") >= last - seconds).orderBy("t", "kind").collect()
    state = {k: {f"{r['t']:.9f}": [r["a"], r["b"], r["c"]] for r in held if r["kind"] == k} for k in ("linear", "angular")}
    return json.dumps({"parameters": {"max_time_window": seconds}, "state": {"reference_zero_time": zero, **state}})


def restored(spark, text: str) -> tuple[DataFrame, float | None]:
    """The samples and the zero time of a state as :func:`buffer_state` writes it."""
    state = json.loads(text)["state"]
    rows = [(float(t), k, *map(float, v)) for k in ("linear", "angular") for t, v in state[k].items()]
    return spark.createDataFrame(rows, "t double, kind string, a double, b double, c double"), state["reference_zero_time"]


def shifted_zero(zero: float, times: DataFrame, method: str, offset: float = 0.0) -> float:
    """The zero time after stamps ``t`` of a scan are adjusted: it moves by what is taken off them, not for ``normalize``."""
    lo, hi = times.agg(F.min("t"), F.max("t")).first()
    return zero + {"earliest_is_zero": lo + offset, "middle_is_zero": 0.5 * (lo + hi) + offset, "normalize": 0.0}[method]
