"""The k nearest global points of each local one, exactly, by leaves of a tree.

The global side is cut into leaves of a few dozen points that lie together,
each a packed row; only their boxes come to the driver, at most about
``MOST_LEAVES`` of them.  The local side is cut into chunks.  The boxes tell
which leaves can hold one of the k nearest points of a chunk, and only these
are sent to it.  So work and traffic follow the points, not the pairs within
the radius.  Of points at one place the ``k`` least ids are enough.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a leaf at least, of a chunk and of a step at most; leaves at most; points that one task may cut.
LEAF, CHUNK, STEP, MOST_LEAVES, ONE_TASK = 32, 2048, 256, 1 << 18, 10_000
WAYS = 8
EDGES = ["x0", "y0", "z0", "x1", "y1", "z1"]
NO_ID = np.iinfo(np.int64).max

Boxes = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Index:
    """The leaves of a global side, kept, with their boxes from the root downward.

    Range partitions differ from run to run, so the leaves are written once to
    the shared folder and never made anew, even when an executor is lost.
    """

    leaves: DataFrame
    few: bool
    size: int
    numbers: np.ndarray
    levels: Boxes
    scale: list[tuple[float, float]]


_INDEXES: WeakKeyDictionary[DataFrame, dict[int, Index]] = WeakKeyDictionary()


def _stored(df: DataFrame, schema: str) -> DataFrame:
    """``df`` written to a fresh path in the folder that driver and executors share, and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/leaves-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def pieces(at: np.ndarray, size: int) -> list[np.ndarray]:
    """Indices of points by pieces of ``size`` and one of the rest, halved across the widest axis."""
    todo, done = [np.arange(len(at))], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            done.append(own)
            continue
        half = size * (-(-len(own) // size) // 2)
        axis = np.ptp(at[own], axis=0).argmax()
        order = np.argpartition(at[own, axis], half)
        todo += [own[order[half:]], own[order[:half]]]
    return done


def _together(df: DataFrame, names: str, key: str, scale: list[tuple[float, float]], few: bool) -> DataFrame:
    """``df`` dealt out and sorted in Morton order."""
    if few:
        return df.repartition(1)
    code = F.lit(0).cast("bigint")
    for a, (low, width) in zip("xyz", scale, strict=True):
        step = F.floor(F.least(F.greatest((F.col(names + a) - low) / width, F.lit(0.0)), F.lit(1.0)) * (2**20 - 1)).cast("bigint")
        code = code * 2 + F.conv(F.bin(step), 8, 10).cast("bigint")  # binary digits read as octal ones leave room for two axes
    order = ["_code", *[names + a for a in "xyz"], key]
    return df.withColumn("_code", code).repartitionByRange(*order).sortWithinPartitions(*order).drop("_code")


def _coordinates(b: pa.RecordBatch, names: str) -> np.ndarray:
    return np.stack([b.column(names + a).to_numpy(zero_copy_only=False) for a in "xyz"], axis=1)


def _packed(b: pa.RecordBatch, columns: list[str], parts: list[np.ndarray]) -> list[pa.Array]:
    """The columns as lists, one for each part."""
    whole = b.take(pa.array(np.concatenate(parts)))
    ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    return [pa.ListArray.from_arrays(ends, whole.column(c)) for c in columns]


def _finite(df: DataFrame, key: str, names: str) -> DataFrame:
    ok = F.col(key).isNotNull()
    for a in "xyz":
        ok &= F.abs(F.col(names + a)) < F.lit(float("inf"))
    return df.where(ok)


def indexed(world: DataFrame, k: int) -> Index:
    """The leaves of ``world`` for up to ``k`` neighbours, made once for each frame."""
    made = _INDEXES.setdefault(world, {})
    if k in made:
        return made[k]
    own = _finite(world.select(F.col("point_id").cast("bigint").alias("global_id"), *[F.col(a).cast("double").alias(f"g{a}") for a in "xyz"]), "global_id", "g")
    told = own.agg(F.count("*").alias("n"), *[F.percentile_approx(f"g{a}", [0.01, 0.99], 1000).alias(a) for a in "xyz"]).first()
    scale = [(0.0, 1.0)] * 3
    if told["n"]:
        scale = [(lo - (hi - lo) / 2, 2 * (hi - lo) or 1.0) for lo, hi in (told[a] for a in "xyz")]
    size = max(LEAF, k, -(-told["n"] // MOST_LEAVES))
    place = [f"g{a}" for a in "xyz"]
    if k == 1:
        own = own.groupBy(*place).agg(F.min("global_id").alias("global_id"))
    else:
        own = own.withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy("global_id"))).where(F.col("_r") <= k).drop("_r")
    columns = ["global_id", *place]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            at = _coordinates(b, "g")
            parts = pieces(at, size)
            edges = [np.concatenate([at[p].min(axis=0), at[p].max(axis=0)]) for p in parts]
            numbers = np.arange(leaf, leaf + len(parts))
            leaf += len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([len(p) for p in parts], pa.int32()), *map(pa.array, np.array(edges).T), *_packed(b, columns, parts)], ["leaf", "n", *EDGES, *columns])

    schema = "leaf bigint, n int, " + ", ".join(f"{e} double" for e in EDGES) + ", global_id array<bigint>, gx array<double>, gy array<double>, gz array<double>"
    leaves = _stored(_together(own.select(*columns), "g", "global_id", scale, told["n"] <= ONE_TASK).mapInArrow(cut, schema), schema)
    boxes = leaves.select("leaf", "n", *EDGES).toPandas().sort_values("leaf")
    edges = boxes[EDGES].to_numpy(float)
    levels = [(edges[:, :3], edges[:, 3:], boxes["n"].to_numpy("int64"))]
    while len(levels[0][2]) > WAYS:
        lo, hi, n = levels[0]
        starts = np.arange(0, len(n), WAYS)
        levels.insert(0, (np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.add.reduceat(n, starts)))
    made[k] = Index(leaves, told["n"] <= ONE_TASK, size, boxes["leaf"].to_numpy("int64"), levels, scale)
    return made[k]


def _squares(v: np.ndarray) -> np.ndarray:
    """The squared norm, in the order in which the expressions add it up, so that both give the same number."""
    return v[..., 0] * v[..., 0] + v[..., 1] * v[..., 1] + v[..., 2] * v[..., 2]


def reached(at: np.ndarray, limit: np.ndarray, k: int, levels: Boxes) -> np.ndarray:
    """The leaves that can hold one of the ``k`` nearest points of any of these within its limit.

    Rounding keeps order, so a box's nearest and farthest squares bound those
    of its points exactly.
    """
    top = len(levels[0][2])
    i, j = np.repeat(np.arange(len(at)), top), np.tile(np.arange(top), len(at))
    bound = np.full(len(at), np.inf)
    for depth, (lo, hi, n) in enumerate(levels):
        if depth:
            i, j = np.repeat(i, WAYS), (j[:, None] * WAYS + np.arange(WAYS)).ravel()
            i, j = i[j < len(n)], j[j < len(n)]
        if not len(i):
            break
        below, above = lo[j] - at[i], at[i] - hi[j]
        near = _squares(np.maximum(np.maximum(below, above), 0.0))
        far = np.where(n[j] >= k, _squares(np.maximum(-below, -above)), np.inf)
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        bound[i[starts]] = np.minimum(bound[i[starts]], np.minimum.reduceat(far, starts))
        keep = (near <= bound[i]) & (near < limit[i])
        i, j = i[keep], j[keep]
    return np.unique(j)


def _flat(t: pa.Table, c: str) -> np.ndarray:
    return t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def search(at: np.ndarray, limit: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray, points: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares and places (leaf * size + slot) of the ``k`` nearest under the limit, by square and id; infinite where there are fewer.

    Each point reads its leaves from the nearest on, until none can be better.
    """
    size = ids.shape[1]
    near = _squares(np.maximum(np.maximum(lo[None] - at[:, None], at[:, None] - hi[None]), 0.0))
    best, whose, where = np.full((len(at), k), np.inf), np.full((len(at), k), NO_ID), np.zeros((len(at), k), "int64")
    live = np.arange(len(at))
    while len(live):
        v = near[live].argmin(axis=1)
        d = near[live, v]
        keep = (d < limit[live]) & (d <= best[live, -1])
        live, v = live[keep], v[keep]
        near[live, v] = np.inf
        d2 = _squares(at[live, None] - points[v])
        d2[~(d2 < limit[live, None])] = np.inf
        some = ((d2 <= best[live, -1:]) & (d2 < np.inf)).any(axis=1)
        own, v, d2 = live[some], v[some], d2[some]
        every = np.concatenate([best[own], d2], axis=1)
        names = np.concatenate([whose[own], ids[v]], axis=1)
        places = np.concatenate([where[own], v[:, None] * size + np.arange(size)], axis=1)
        order = np.lexsort((names, every), axis=-1)[:, :k]
        best[own], whose[own], where[own] = (np.take_along_axis(x, order, axis=1) for x in (every, names, places))
    return best, where


def nearest_within(local: DataFrame, world: DataFrame, k: int, limit: Column) -> DataFrame:
    """``local_id, global_id, lx, ..., gz, d2``: for each row of ``local`` the ``k`` nearest points with d2 under ``limit`` (of ``lx, ly, lz``)."""
    index = indexed(world, k)
    levels, numbers, size = index.levels, index.numbers, index.size
    own = local.select(F.col("point_id").cast("bigint").alias("local_id"), *[F.col(a).cast("double").alias(f"l{a}") for a in "xyz"])
    own = _finite(own, "local_id", "l").withColumn("most", limit.cast("double")).where("most is not null")
    columns = ["local_id", "lx", "ly", "lz", "most"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows or not len(numbers):
                continue
            at, most = _coordinates(b, "l"), b.column("most").to_numpy(zero_copy_only=False)
            for part in pieces(at, CHUNK):
                asked = np.unique(np.concatenate([reached(at[part[p]], most[part[p]], k, levels) for p in pieces(at[part], STEP)]))
                if len(asked):
                    # the chunk's own row has a number that no leaf has, and others' don't share
                    packed = [pa.concat_arrays([x, pa.nulls(len(asked), x.type)]) for x in _packed(b, columns, [part])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked) + 1, chunk)), pa.array(np.concatenate([[-1 - chunk], numbers[asked]])), *packed], ["chunk", "leaf", *columns])
                    chunk += 1

    def answer(t: pa.Table) -> pa.Table:
        mine, theirs = t.filter(pc.less(t["leaf"], 0)), t.filter(pc.greater_equal(t["leaf"], 0))
        at, most, names = np.stack([_flat(mine, f"l{a}") for a in "xyz"], axis=1), _flat(mine, "most"), _flat(mine, "local_id")
        n = theirs["n"].to_numpy()
        slot = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        points, ids = np.full((len(n), size, 3), np.inf), np.full((len(n), size), NO_ID)
        points[slot] = np.stack([_flat(theirs, f"g{a}") for a in "xyz"], axis=1)
        ids[slot] = _flat(theirs, "global_id")
        edges = np.stack([theirs[e].to_numpy() for e in EDGES], axis=1)
        out = []
        for p in pieces(at, STEP):
            best, where = search(at[p], most[p], k, edges[:, :3], edges[:, 3:], points, ids)
            row, _ = np.nonzero(best < np.inf)
            place = where[best < np.inf]
            out.append([names[p[row]], ids.ravel()[place], *at[p[row]].T, *points.reshape(-1, 3)[place].T, best[best < np.inf]])
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=[x.split()[0] for x in found.split(", ")])

    found = "local_id bigint, global_id bigint, lx double, ly double, lz double, gx double, gy double, gz double, d2 double"
    schema = "chunk bigint, leaf bigint, local_id array<bigint>, lx array<double>, ly array<double>, lz array<double>, most array<double>"
    few = own.limit(ONE_TASK + 1).count() <= ONE_TASK
    asked = _together(own, "l", "local_id", index.scale, few).mapInArrow(ask, schema)
    leaves = index.leaves if index.few else index.leaves.hint("merge")
    return asked.join(leaves, "leaf", "left").groupBy("chunk").applyInArrow(answer, found)
