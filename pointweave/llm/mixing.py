"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks.  Block k of a source with weight w is
released at slot floor(k / w) and due at slot ceil((k + 1) / w); in each slot
the released block with the earliest deadline runs.  On one line, with weights
that add up to one, every deadline is met, so at each slot each source's share
is less than one block from its target.  When a source has run out, the
others go on with their weights scaled up, from an even state again, so every
row gets a place.

Shares are taken exactly as they are given, as whole numbers over a common
denominator, so that no rounding adds up over the slots.  The driver works the
slots out one after another and holds 8 bytes for each block.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm import common

#: Rows of a block, at least, and blocks up to which it has no more; a block's rows grow with the table beyond.
BLOCK_ROWS, MOST_BLOCKS = 64, 1 << 24
#: Sources that a mixture may have; the driver's work grows with the square of their number.
MOST_SOURCES = 5_000
#: Rows that one task orders, more or less, when a source's rows are ranked.
RANKED_ROWS = 20_000


def turns(weights: list[int]) -> Iterator[int]:
    """The source that runs in each slot, without end; ``weights`` are at least 1."""
    total = sum(weights)
    ready = [(-(-total // w), i, 0) for i, w in enumerate(weights)]  # deadline, source, block
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int]] = []  # release, source, block
    for slot in itertools.count():
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[i]), i, k))
        _, i, k = heapq.heappop(ready)
        yield i
        heapq.heappush(waiting, ((k + 1) * total // weights[i], i, k + 1))


def period(weights: dict[str, int]) -> list[str]:
    """The sources that run in each slot of a period, whose length is the weights' sum."""
    names = sorted(weights)
    return [names[i] for i in itertools.islice(turns([weights[s] for s in names]), sum(weights.values()))]


@dataclass
class Schedule:
    """For each source the slots of its blocks."""

    places: dict[str, np.ndarray]

    def slots(self, source: str, blocks: np.ndarray) -> np.ndarray:
        return self.places[source][blocks]


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Schedule:
    """Places for ``blocks[s]`` blocks of each source with shares in proportion to ``weights[s]``.

    Sources of weight 0 come after all others, in equal shares.
    """
    whole = whole_weights(weights)
    left = {s: blocks[s] for s in sorted(blocks) if blocks[s] > 0}
    places = {s: array("q") for s in blocks}
    start = 0
    while left:
        names = [s for s in left if whole[s]] or list(left)
        if len(names) == 1:
            s = names[0]
            n = left.pop(s)
            places[s].frombytes(np.arange(start, start + n, dtype=np.int64).tobytes())
            start += n
            continue
        own = [whole[s] or 1 for s in names]
        g = math.gcd(*own)
        for i in turns([w // g for w in own]):
            s = names[i]
            places[s].append(start)
            start += 1
            left[s] -= 1
            if not left[s]:  # the phase ends after the slot in which the first source runs out
                del left[s]
                break
    return Schedule({s: np.frombuffer(x, np.int64) if x else np.zeros(0, np.int64) for s, x in places.items()})


def whole_weights(shares: dict[str, float]) -> dict[str, int]:
    """Shares as whole numbers in exactly the same proportions."""
    if not all(0 <= x < math.inf for x in shares.values()):
        raise ValueError("shares must be finite numbers of at least 0")
    exact = {s: Fraction(x) for s, x in shares.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def ranked(rows: DataFrame, group: str, order: list[str], n_rows: int, name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 0 within ``group`` by a hash of ``order``, which shuffles them evenly.

    The hash also cuts each group, however large, into parts that are ranked
    by themselves; the parts' sizes, added up, give where each starts.
    """
    bits = max(9, (n_rows // RANKED_ROWS).bit_length())
    hashed = rows.withColumn("_mix_hash", F.xxhash64(*order)).withColumn("_mix_part", F.shiftrightunsigned("_mix_hash", 64 - bits))
    before = Window.partitionBy(group).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = hashed.groupBy(group, "_mix_part").agg(F.count("*").alias("_mix_n")).select(group, "_mix_part", F.coalesce(F.sum("_mix_n").over(before), F.lit(0)).alias("_mix_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_mix_part").orderBy("_mix_hash", *order)) - 1
    return hashed.withColumn("_mix_inside", inside).join(starts, [group, "_mix_part"]).withColumn(name, F.col("_mix_start") + F.col("_mix_inside")).drop("_mix_hash", "_mix_part", "_mix_start", "_mix_inside")


def mixed(df: DataFrame, shares: dict[str | None, float] | None = None, temperature: float = 0.5, block_rows: int | None = None) -> DataFrame:
    """``df`` with ``mix_block, mix_slot, mix_position``: each row's block, the block's slot, the row's place.

    ``shares`` are target weights by source; without them, or for sources that
    they don't name, a source's share is its rows to the power
    ``temperature``.  A share of 0 puts a source after all others.  Rows of equal position don't arise; positions of the
    last, shorter block of a source leave a gap.  A null source is a source of
    its own; null and empty texts and null or repeated ids are placed like
    others, equal rows in any order among themselves; an empty table stays
    empty.  All columns of the input are kept; those three are replaced, and
    names that begin with ``_mix_`` are not allowed.  Blocks have ``block_rows``
    rows, by default ``BLOCK_ROWS`` and so many more that there are no more
    than about ``MOST_BLOCKS`` of them.  Starts a job at once.
    """
    if clash := [c for c in df.columns if c.lower().startswith("_mix_")]:
        raise ValueError(f"columns {clash} begin with _mix_")
    rows = df.drop("mix_block", "mix_slot", "mix_position").withColumn("_mix_source", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source")))
    counts = {r["_mix_source"]: r["n"] for r in rows.groupBy("_mix_source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them into fewer")
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_BLOCKS))
    named = {("-" if s is None else f"+{s}"): x for s, x in (shares or {}).items()}
    free = {s: n**temperature for s, n in counts.items() if s not in named}
    plan = schedule({s: -(-n // block_rows) for s, n in counts.items()}, {s: named.get(s, free.get(s, 0.0)) for s in counts})
    shared = df.sparkSession.sparkContext.broadcast(plan)  # 8 bytes for each block

    @F.pandas_udf("bigint")
    def slot(source, block):
        common.turn("mixing")
        out = np.zeros(len(source), np.int64)
        for s, places in source.groupby(source).indices.items():
            out[places] = shared.value.slots(s, block.to_numpy()[places])
        return type(block)(out)

    order = [c for c in ("doc_id", "text") if c in df.columns]
    out = ranked(rows, "_mix_source", order, sum(counts.values()), "_mix_rank")
    out = out.withColumn("mix_block", F.floor(F.col("_mix_rank") / block_rows)).withColumn("mix_slot", slot("_mix_source", "mix_block"))
    return out.withColumn("mix_position", F.col("mix_slot") * block_rows + F.col("_mix_rank") % block_rows).drop("_mix_source", "_mix_rank")


def in_order(df: DataFrame, **how) -> DataFrame:
    """The rows of ``df`` in mixed order: by ranges of the position, sorted, so that files follow it."""
    out = mixed(df, **how)
    return out.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*df.columns)
