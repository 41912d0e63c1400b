"""Removal of repeated substrings: each byte of a fixed-length string that occurred before.

Every string of ``LENGTH`` bytes belongs to one anchor, the leftmost of the
seeds (``SEED`` bytes) in it whose hash is least; equal strings have equal
anchors at equal offsets.  So it is enough to compare the surroundings of equal
anchors, and anchors are few, about one in 40 bytes.  What an anchor depends on
is the string alone, not the texts beside it.  An anchor whose strings all
agree with an earlier one's is settled by a 128-bit BLAKE2b digest of the bytes
they cover.  Where surroundings differ, the contexts to the right and
(reversed) to the left are put in suffix order by deep-shallow sorting; with
the lengths of common prefixes, every string of an anchor is told by two ranks,
and all but the first in each class are repeats: there bytes decide, not hashes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm import common, hashing
from pointweave.llm.suffixes import deep_shallow

LENGTH, SEED = 100, 16
#: Seeds in a string; an anchor's strings start at most ``SEEDS - 1`` bytes before it.
SEEDS = LENGTH - SEED + 1
#: Bytes of text that are hashed at a time, and anchors that are compared before they leave a task.
BATCH_BYTES, BATCH_ANCHORS = 1 << 21, 400_000
#: Bits for a place in the bytes that are hashed at a time; the seeds' hashes have the rest.
POSITION_BITS = 23
_B = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
ANCHOR = "h bigint, c bigint, d bigint, doc bigint, tag bigint, at int, ends int"


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return hashing.powers(_B, n), hashing.powers(_INVERSE, n)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def _digests(data: bytes, low: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests of pieces of ``data``, as two numbers each."""
    view = memoryview(data)
    found = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(low.tolist(), stop.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts: number of text, place, hash of the seed, first and last start of its strings, digest of what they cover.

    A string's anchor depends on the string alone, whatever lies beside it.
    The texts together are at most ``2**POSITION_BITS`` bytes.
    """
    none = (*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64)), np.zeros((0, 2), np.uint64))
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    n = len(data)
    if n < LENGTH:
        return none
    if n > 1 << POSITION_BITS:
        raise ValueError("too many bytes at a time")
    up, down = _powers(1 << (n + 1).bit_length())
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
        seeds = hashing.mix((sums[SEED:] - sums[:-SEED]) * down[: n - SEED + 1])
    bits = np.uint64(POSITION_BITS)
    packed = (seeds >> bits << bits) | np.arange(len(seeds), dtype=np.uint64)  # the leftmost of equal ones is least
    best = (_least(packed, SEEDS) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(best)]
    starts = np.flatnonzero(np.arange(len(best)) + LENGTH <= ends[owner])  # strings that lie in one text
    if not len(starts):
        return none
    at = best[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[starts][1:] != owner[starts][:-1])]))
    low, place = starts[new], at[new]
    high = starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    cover = _digests(joined, low, high + LENGTH)
    cover = cover ^ hashing.mix((place - low).astype(np.uint64) * np.uint64(512) + (high - low).astype(np.uint64))[:, None]
    text = owner[low]
    base = (ends - sizes)[text]
    return text, place - base, seeds[place], low - base, high - base, cover


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """A long text in pieces, with their places, so that each string lies in exactly one as a start."""
    yield 0, text[: BATCH_BYTES + LENGTH - 1]
    for at in range(BATCH_BYTES, len(text) - LENGTH + 1, BATCH_BYTES):
        yield at, text[at : at + BATCH_BYTES + LENGTH - 1]


def _packed_ends(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How far before the anchor its first and last string start, in one number."""
    return ((place - low) * 256 + (place - high)).astype(np.int32)


def find_anchors(rows: DataFrame) -> DataFrame:
    """Anchors of ``doc, tag, text``.

    Of anchors in one task whose strings all agree only the first goes on;
    the others, which are repeats, have ``c`` null.  So a passage, however
    common, leaves a task once.
    """
    arrow = common.arrow_schema(rows.sparkSession, ANCHOR)

    def leave(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        doc, tag, at, h, ends, cover = (np.concatenate(x) for x in zip(*parts, strict=True))
        c, d = cover.T
        order = np.lexsort((at, tag, doc, d, c, h))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (cover[order[1:]] == cover[order[:-1]]).all(axis=1)
        h = np.where(again, hashing.mix(np.arange(len(h))), h)  # repeats are dealt out evenly
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.ascontiguousarray(c).view(np.int64), mask=again), pa.array(np.ascontiguousarray(d).view(np.int64), mask=again), pa.array(doc), pa.array(tag), pa.array(at.astype(np.int32)), pa.array(ends)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def add(docs: list[int], tags: list[int], shifts: list[int], texts: list[bytes]) -> int:
            text, at, h, low, high, c = anchors(texts)
            if len(text):
                parts.append((np.array(docs, np.int64)[text], np.array(tags, np.int64)[text], at + np.array(shifts, np.int64)[text], h, _packed_ends(at, low, high), c))
            return len(text)

        docs, tags, shifts, texts, size = [], [], [], [], 0
        for batch in batches:
            for d, g, t in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), strict=True):
                for shift, piece in pieces(t.as_buffer().to_pybytes()):
                    if size and size + len(piece) > BATCH_BYTES:
                        held += add(docs, tags, shifts, texts)
                        docs, tags, shifts, texts, size = [], [], [], [], 0
                        if held >= BATCH_ANCHORS:
                            yield leave(parts)
                            parts.clear()
                            held = 0
                    docs.append(d)
                    tags.append(g)
                    shifts.append(shift)
                    texts.append(piece)
                    size += len(piece)
        add(docs, tags, shifts, texts)
        if parts:
            yield leave(parts)

    return rows.select("doc", "tag", F.col("text").cast("binary").alias("text")).mapInArrow(run, ANCHOR)


FOUND = "doc bigint, tag bigint, at int, ends int, h bigint"


def settle(found: DataFrame) -> DataFrame:
    """Repeats (``h`` null), and for seeds with different surroundings the first anchor of each (``h`` kept).

    Anchors come together by the seed's hash, sorted, and are read as a stream
    that keeps one row back.
    """
    dealt = found.repartition("h").sortWithinPartitions("h", F.col("c").asc_nulls_last(), "d", "doc", "tag", "at")
    arrow = common.arrow_schema(found.sparkSession, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # the first anchor of the last seed, if nothing is told of it yet
        last = None  # seed and surroundings of the last row
        for batch in batches:
            null = np.asarray(batch.column("c").is_null())
            x = {k: np.asarray(batch.column(k)) for k in ("h", "doc", "tag", "at", "ends")}
            x["c"], x["d"] = (np.asarray(batch.column(k).fill_null(0)) for k in ("c", "d"))
            marks = {k: v[null] for k, v in x.items()}
            x = {k: v[~null] for k, v in x.items()}
            n = len(x["h"])
            if n:
                before_h = np.concatenate([[last[0] if last else 0], x["h"][:-1]])
                before_c, before_d = (np.concatenate([[last[i] if last else 0], x[k][:-1]]) for i, k in ((1, "c"), (2, "d")))
                same_h, same = x["h"] == before_h, (x["h"] == before_h) & (x["c"] == before_c) & (x["d"] == before_d)
                if last is None:
                    same_h[0] = same[0] = False
                firsts = np.flatnonzero(~same)
                lead = ~same_h[firsts]  # the first anchor of its seed
                ask = ~lead
                # a leading first is asked for if the next first has its seed
                ask[:-1] |= lead[:-1] & ~lead[1:]
                if held is not None and len(firsts) and not lead[0]:
                    x = {k: np.concatenate([held[k], v]) for k, v in x.items()}
                    firsts, ask, same = np.concatenate([[0], firsts + 1]), np.concatenate([[True], ask]), np.concatenate([[False], same])
                    lead = np.concatenate([[True], lead])
                if len(firsts):
                    held = {k: v[firsts[-1:]] for k, v in x.items()} if lead[-1] else None
                last = tuple(int(x[k][-1]) for k in ("h", "c", "d"))
                asked = firsts[ask]
                marks = {k: np.concatenate([marks[k], x[k][same]]) for k in marks}
            else:
                asked = np.zeros(0, np.int64)
            out = {k: np.concatenate([marks[k], x[k][asked]]) for k in ("doc", "tag", "at", "ends", "h")}
            mask = np.arange(len(out["h"])) < len(marks["h"])
            yield pa.RecordBatch.from_arrays([pa.array(out["doc"]), pa.array(out["tag"]), pa.array(out["at"], pa.int32()), pa.array(out["ends"], pa.int32()), pa.array(out["h"], mask=mask)], schema=arrow)

    return dealt.mapInArrow(run, FOUND)


def contexts(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """The bytes around each anchor: ``SEEDS - 1`` before it, reversed, and ``LENGTH`` from it on, padded with zeros."""
    by = asked.groupBy("doc", "tag").agg(F.collect_list(F.struct("h", "at", "ends")).alias("own"))
    joined = rows.join(by, ["doc", "tag"]).select("doc", "tag", "own", F.col("text").cast("binary").alias("text"))
    schema = "h bigint, doc bigint, tag bigint, at int, ends int, context binary"
    arrow = common.arrow_schema(rows.sparkSession, schema)
    left = SEEDS - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = row.column("own").flatten()
                h, at, ends = (own.field(k) for k in range(3))
                data = np.concatenate([np.zeros(left, np.uint8), np.frombuffer(row.column("text")[0].as_buffer(), np.uint8), np.zeros(LENGTH, np.uint8)])
                p = np.asarray(at).astype(np.int64)[:, None] + left
                both = np.concatenate([data[p - 1 - np.arange(left)], data[p + np.arange(LENGTH)]], axis=1)
                n, width = both.shape
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([h, pa.array([row.column("doc")[0].as_py()] * n, pa.int64()), pa.array([row.column("tag")[0].as_py()] * n, pa.int64()), at, ends, blob], schema=arrow)

    return joined.mapInArrow(run, schema)


def repeats_among(h: np.ndarray, rank: np.ndarray, ends: np.ndarray, context: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Strings that occurred before, as pairs of (rows, distance of the start before the anchor).

    ``rank`` orders rows by document and place.  For each distance the left
    context to that depth and the right one to the rest make a class.
    """
    left_width = SEEDS - 1
    n = len(h)
    classes = []
    for part in (context[:, :left_width], context[:, left_width:]):
        order, shared = deep_shallow(h, np.ascontiguousarray(part))
        classes.append((order, shared))
    far, near = ends // 256, ends % 256
    out = []
    for o in range(SEEDS):
        have = (near <= o) & (o <= far)
        if not have.any():
            continue
        ids = []
        for (order, shared), depth in zip(classes, (o, LENGTH - o), strict=True):
            number = np.empty(n, np.int64)
            number[order] = np.cumsum(shared < depth)
            ids.append(number)
        rows = np.flatnonzero(have)
        key = ids[0][rows] * np.int64(n + 1) + ids[1][rows]
        by = np.lexsort((rank[rows], key))
        again = np.flatnonzero(key[by][1:] == key[by][:-1]) + 1
        if len(again):
            out.append((rows[by[again]], np.full(len(again), o)))
    return out


def compare(around: DataFrame, most: int = 20_000) -> DataFrame:
    """Spans ``doc, tag, start, stop`` of strings that occurred before, among anchors of one seed."""
    dealt = around.repartition("h").sortWithinPartitions("h", "doc", "tag", "at")
    schema = "doc bigint, tag bigint, start int, stop int"
    arrow = common.arrow_schema(around.sparkSession, schema)

    def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        h, at, ends = (whole.column(k).to_numpy() for k in ("h", "at", "ends"))
        context = np.frombuffer(b"".join(whole.column("context").to_pylist()), np.uint8).reshape(len(h), -1)
        found = repeats_among(h, np.arange(len(h)), ends, context)
        if not found:
            return pa.RecordBatch.from_pylist([], arrow)
        rows, o = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-o, rows))
        rows, start = rows[order], (at[rows] - o)[order]
        # runs of starts next to each other, of one anchor, are one span
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (start[1:] != start[:-1] + 1)])
        last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(rows) - 1]])
        rows, start, stop = rows[new], start[new], start[last] + LENGTH
        return pa.RecordBatch.from_arrays([whole.column("doc").to_numpy()[rows], whole.column("tag").to_numpy()[rows], pa.array(start, pa.int32()), pa.array(stop, pa.int32())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = np.asarray(batch.column("h"))
            if held >= most:  # closed where a new seed begins
                edge = np.flatnonzero(np.concatenate([[h[0] != parts[-1].column("h")[-1].as_py()], h[1:] != h[:-1]]))
                if len(edge):
                    if edge[0]:
                        parts.append(batch.slice(0, int(edge[0])))
                    yield solved(parts)
                    parts, held = [], 0
                    batch = batch.slice(int(edge[0]))
            parts.append(batch)
            held += batch.num_rows
        if parts:
            yield solved(parts)

    return dealt.mapInArrow(run, schema)


def repeated(df: DataFrame) -> DataFrame:
    """Repeated bytes of ``doc_id, text``, texts taken as UTF-8.

    A byte is removed if a string of ``LENGTH`` bytes covers it that also
    starts earlier: in a row with a lesser id, or in the same row.  Returns
    ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary``.  Null and
    empty texts, and those shorter than ``LENGTH``, lose nothing.  A null id
    comes before all.  Of rows with equal ids the order is that of a hash of
    their texts; rows that are equal in id and text count as one and get the
    same result.  Other columns are ignored; an empty table stays empty.
    """
    spark = df.sparkSession
    whole = common.narrow(df, doc_id="doc_id", text="text")
    ids = whole.groupBy("doc_id").count().where("count > 1").limit(1).count()
    tag = F.xxhash64("text") if ids else F.lit(0).cast("bigint")  # tells rows apart where ids don't
    rows = whole.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("doc"), tag.alias("tag"), common.text_or_empty().alias("text"), "doc_id")
    own = rows.select("doc", "tag", "text")
    own = own.dropDuplicates(["doc", "tag"]) if ids else own
    found = common.stored(settle(find_anchors(own)), "substrings-found")
    spans = compare(contexts(found.where("h is not null"), own))
    marks = found.where("h is null").select("doc", "tag", (F.col("at") - F.floor(F.col("ends") / 256)).cast("int").alias("start"), (F.col("at") - F.col("ends") % 256 + LENGTH).cast("int").alias("stop"))
    removed = marks.unionByName(spans).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    if ids:
        joined = rows.join(removed, ["doc", "tag"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    else:  # the same columns as in contexts(), so that one shuffle of the texts serves both joins
        joined = own.join(removed, ["doc", "tag"], "left").select(F.nullif(F.col("doc"), F.lit(-(2**63)).cast("bigint")).cast(df.schema["doc_id"].dataType).alias("doc_id"), F.col("text").cast("binary").alias("text"), "spans")

    def cut(batch) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            data, at, pieces, n, gone = text.as_buffer().to_pybytes(), 0, [], 0, 0
            pairs = np.zeros((0, 2), np.int64)
            if spans.is_valid:
                pairs = np.stack([np.asarray(spans.values.field(k)).astype(np.int64) for k in (0, 1)], axis=1)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            for a, b in pairs.tolist():
                if a > at or not n:
                    pieces.append(data[at:a])
                    n, gone, at = n + 1, gone + b - a, b
                elif b > at:
                    gone, at = gone + b - at, b
            pieces.append(data[at:])
            kept = b"".join(pieces)
            for k, v in zip(out, (len(data), gone, n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id")}

    kind = df.schema["doc_id"].dataType.simpleString()
    return common.map_batches(joined, cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
