"""Near-duplicate detection with SuperMinHash, banding, exact verification and union-find.

A document's set are the distinct shingles of its words, A-Z in lower case.
Documents with equal sets form a class and go on as one.  SuperMinHash gives
each class a signature; bands are fixed random subsets of its positions.
Classes that share a band are candidates; they are compared on full sets, by
exact counts of common shingles, in blocks of bounded size, and linked where
the likeness reaches the threshold.  A shingle is a 64-bit mix of its words'
BLAKE2b hashes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm import common, graph, hashing

#: Length of a signature, and positions in a band.
LENGTH, ROWS = 242, 11
#: Bands in which a pair just at the threshold agrees on average; the chance of
#: none is about e to the minus that, a little more as a signature estimates.
AGREEING = 10
#: Shingles that the sets of one block of a comparison have together, more or less; one long set may be more.
BLOCK_SHINGLES = 1 << 19
_STEPS = np.uint64(0x9E3779B97F4A7C15)
common.keeps("minhash", hashing.forget)


def band_count(percent: int) -> int:
    """Bands for a threshold: 60 for 85 %, 116 for 80 %."""
    return round(AGREEING / (percent / 100) ** ROWS)


@functools.cache
def bands(count: int, length: int = LENGTH, rows: int = ROWS) -> np.ndarray:
    """The positions of each band: whole permutations cut in pieces, so that all positions serve alike."""
    rng = np.random.default_rng(20240229)
    flat = np.concatenate([rng.permutation(length)[: length // rows * rows] for _ in range(-(-count // (length // rows)))])
    return flat[: count * rows].reshape(count, rows)


def super_min_hash(elements: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The signature of a set of 64-bit hashes (at least one).

    Each element deals ranks out over the positions along a random
    permutation of its own: in step j it gives rank j plus a fraction to one
    position that it hasn't met.  A position keeps its least rank.  All
    elements take a step together, and after the step in which the last
    position got a rank no later one can lower any, so it stops there.
    """
    n = len(elements)
    if n > 1 << 15:  # bounded memory: the signature of a union is the minimum
        return np.minimum(super_min_hash(elements[: n // 2], length), super_min_hash(elements[n // 2 :], length))
    best = np.full(length, np.inf)
    order = np.broadcast_to(np.arange(length, dtype=np.int16), (n, length)).copy()
    row = np.arange(n)
    with np.errstate(over="ignore"):
        for j in range(length):
            h = hashing.mix(elements + np.uint64(2 * j + 1) * _STEPS)
            k = j + ((h >> np.uint64(40)) * np.uint64(length - j) >> np.uint64(24)).astype(np.int64)
            place = order[row, k]
            order[row, k] = order[:, j]
            rank = j + (h & np.uint64(0xFFFFFFFFFF)).astype(np.float64) / (1 << 40)
            np.minimum.at(best, place, rank)
            if best.max() < j + 1:
                break
    return best


def band_keys(signature: np.ndarray, count: int) -> np.ndarray:
    """A 64-bit key for each band."""
    bits = hashing.mix(signature.view(np.uint64))[bands(count)]
    key = np.arange(count, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = hashing.mix(key + bits[:, i])
    return key.view(np.int64)


def _sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    return [hashing.shingles(w, size) for w in hashing.word_hashes([(t or "").encode().lower() for t in texts])]


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def reached(hubs: list[np.ndarray], sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``sets`` are linked with one of ``hubs``; sets are sorted."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])[:-1]
    out = np.zeros(len(sets), bool)
    for hub in hubs:
        met = hub[np.minimum(np.searchsorted(hub, flat), len(hub) - 1)] == flat
        inter = np.add.reduceat(met.astype(np.int64), starts)
        out |= 100 * inter >= percent * (sizes + len(hub) - inter)
    return out


def linked(sets: list[np.ndarray], label: list[int], split: int, percent: int, columns: int = 2048) -> list[tuple[int, int]]:
    """Links that join sets of different labels: among all pairs, or with ``split`` those across it; a forest, never all.

    Counts of common shingles come from products of 0/1 matrices over the
    shingles that two or more sets have, some columns at a time.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    which = np.cumsum(new) - 1
    often = np.bincount(which) > 1
    number = np.cumsum(often) - 1
    keep = often[which]
    column, owner = number[which[keep]], owner[keep]
    left, right = (slice(0, split), slice(split, n)) if split else (slice(0, n), slice(0, n))
    common_count = np.zeros((left.stop - left.start, right.stop - right.start), np.float32)
    for c in range(0, int(often.sum()), columns):
        lo, hi = np.searchsorted(column, [c, c + columns])
        m = np.zeros((n, columns), np.float32)
        m[owner[lo:hi], column[lo:hi] - c] = 1
        common_count += m[left] @ m[right].T
    inter = common_count.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None] - inter
    labels = np.array(label)
    found = (100 * inter >= percent * union) & (labels[left][:, None] != labels[right][None])
    a, b = np.nonzero(found)
    a, b = a + left.start, b + right.start
    groups, out = UnionFind(n), []
    first: dict[int, int] = {}
    for i, x in enumerate(label):
        groups.join(i, first.setdefault(x, i))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        if i < j and groups.join(i, j):
            out.append((i, j))
    return out


def components(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate components of ``doc_id, text``.

    Returns ``doc_id, n_shingles, component_id, kept``: the size of the set,
    the least id reachable over links of likeness ``percent`` or more, and
    whether that is the row's own.  Null and empty texts, and texts without
    words, have the empty set, are linked with nothing and kept.  Rows with
    equal ids count as one document; a row without an id is linked with
    nothing, has no component and is kept.  Ties don't arise: the least id
    stays.  Other columns are ignored; an empty table stays empty.  Ids must
    be whole numbers.  Starts jobs at once.
    """
    rows = common.narrow(df, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))

    count = band_count(percent)

    def summary(batch) -> dict[str, list]:
        common.turn("minhash")
        sets = _sets(batch.column("text").to_pylist(), size)
        keys = [band_keys(super_min_hash(x), count) if len(x) else [] for x in sets]
        return {"doc_id": batch.column("doc_id"), "n_shingles": [len(x) for x in sets], "digest": [_digest(x) for x in sets], "key": keys}

    known = common.stored(common.map_batches(rows, summary, "doc_id bigint, n_shingles bigint, digest binary, key array<bigint>"), "minhash-documents")
    real = known.where("doc_id is not null and n_shingles > 0")
    classes = common.stored(real.groupBy("digest").agg(F.min("doc_id").alias("id")), "minhash-classes")
    links = verified(rows, members(real, classes), size, percent)
    final = graph.components(links, "minhash-links")
    label = classes.join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("class_id"))
    # rows that share an id share the least label of theirs
    return known.join(label, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("class_id"))).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def members(real: DataFrame, classes: DataFrame) -> DataFrame:
    """``key, hub, id, n``: the classes that share a band, the least of them, and their sets' sizes.

    Bands with the same members (told by their number, least, greatest and an
    exclusive or of hashes) count once.
    """
    met = real.join(classes.withColumnRenamed("digest", "own"), (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("own"))).select("id", F.col("n_shingles").alias("n"), F.explode("key").alias("key"))
    shared = met.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("most"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("who")).where("hub <> most")
    different = shared.groupBy("hub", "most", "size", "who").agg(F.min("key").alias("key")).select("key", "hub")
    return common.stored(met.join(different, "key").select("key", "hub", "id", "n"), "minhash-members")


def _blocks(total):
    """Parts for sets of ``total`` shingles together."""
    return F.ceil(total / BLOCK_SHINGLES).cast("int")


def _part(parts: str):
    return F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")


def verified(rows: DataFrame, met: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` between classes that share a band, compared on full sets.

    First each class is compared with the hubs of its bands, star by star,
    which joins nearly all of a tight group and is work in proportion to the
    bands.  Only bands whose classes are still apart are compared further, all
    classes of different labels; of such bands that hang together either each
    by itself or all as one group, whichever is fewer pairs.  Stars and groups
    are cut into blocks of at most about ``BLOCK_SHINGLES`` shingles, so none,
    however large, meets in one task.  Blocks return forests of links, never
    all pairs.  What is left of the square is the number of pairs of unlike
    classes that share a band.
    """
    pairs = met.where("hub <> id").select("hub", "id", "n").distinct()
    wanted = met.select("id").distinct()

    def sets(batch) -> dict[str, list]:
        common.turn("minhash")
        own = _sets(batch.column("text").to_pylist(), size)
        return {"id": batch.column("id"), "own": [s.tobytes() for s in own]}

    # the same plan at every size: what is compared grows with the input
    texts = rows.hint("merge").join(wanted, rows["doc_id"] == wanted["id"]).select("id", "text")
    full = common.stored(common.map_batches(texts, sets, "id bigint, own binary").where(F.length("own") > 0), "minhash-sets")

    blocks = pairs.groupBy("hub").agg(_blocks(F.sum("n")).alias("blocks"))
    dealt = pairs.join(blocks, "hub").withColumn("block", _part("blocks")).select("hub", "block", "id")
    rim = dealt.join(full, "id").select("hub", "block", F.lit(1).alias("side"), "id", "own")
    middle = dealt.select("hub", "block").distinct().join(full.withColumnRenamed("id", "hub"), "hub").select("hub", "block", F.lit(0).alias("side"), F.col("hub").alias("id"), "own")
    schema = common.arrow_schema(rows.sparkSession, "a bigint, b bigint")

    def star(group: pa.Table) -> pa.Table:
        side = np.asarray(group.column("side"))
        own = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        around = np.flatnonzero(side == 1)
        if not len(around) or len(around) == len(side):
            return schema.empty_table()
        hit = around[reached([own[i] for i in np.flatnonzero(side == 0)], [own[i] for i in around], percent)]
        return pa.table([np.asarray(group.column("hub"))[hit], np.asarray(group.column("id"))[hit]], schema=schema)

    # a class has at most one hub for each band
    one = common.stored(graph.thinned(rim.unionByName(middle).groupBy("hub", "block").applyInArrow(star, "a bigint, b bigint")), "minhash-stars")

    label = graph.components(one, "minhash-stars")
    told = met.join(label, "id", "left").select("key", "hub", "id", "n", F.coalesce("component", "id").alias("label"))
    open_bands = told.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").cast("double").alias("size")).where("l <> m").select("key", "size")
    apart = common.stored(told.join(open_bands, "key"), "minhash-apart")
    if apart.limit(1).count() == 0:
        return one
    whole = graph.components(graph.thinned(apart.where("hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b"))), "minhash-apart")
    pairs_of_bands = apart.where("hub = id").select("id", (F.col("size") * F.col("size")).alias("pairs")).join(whole, "id").groupBy("component").agg(F.sum("pairs").alias("by_band"))
    pairs_of_group = whole.groupBy("component").agg((F.count("*").cast("double") * F.count("*")).alias("at_once"))
    as_one = pairs_of_group.join(pairs_of_bands, "component").select("component", (F.col("at_once") < F.col("by_band")).alias("as_one"))
    groups = common.stored(whole.join(as_one, "component"), "minhash-groups")
    placed = apart.select("id", "n", "label", "key").join(groups, "id")
    grouped = placed.select(F.col("as_one").cast("int").alias("kind"), F.when(F.col("as_one"), F.col("component")).otherwise(F.col("key")).alias("grp"), "id", "n", "label").distinct()
    parts = grouped.groupBy("kind", "grp").agg(_blocks(F.sum("n")).alias("parts"))
    cut = grouped.join(parts, ["kind", "grp"]).withColumn("part", _part("parts")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    two = cut.select("kind", "grp", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), (F.col("part") > F.col("o")).cast("int").alias("side"), "id", "label").join(full, "id")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("id", "ascending")])
        ids, split = group.column("id").to_pylist(), group.column("side").to_pylist().count(0)
        one_block = group.column("i")[0] == group.column("j")[0]
        if len(ids) < 2 or (not one_block and split in (0, len(ids))):
            return schema.empty_table()
        own = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        found = linked(own, group.column("label").to_pylist(), 0 if one_block else split, percent)
        return pa.table([[ids[x] for x, _ in found], [ids[y] for _, y in found]], schema=schema)

    return one.unionByName(common.stored(two.groupBy("kind", "grp", "i", "j").applyInArrow(compare, "a bigint, b bigint"), "minhash-links"))
