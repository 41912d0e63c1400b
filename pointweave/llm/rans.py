"""Token ids as static range asymmetric numeral system shards.

A shard holds the ids of consecutive documents.  One frequency table, counted
over the whole shard, serves all its blocks.  A block holds up to ``BLOCK``
ids, dealt in turn to ``LANES`` interleaved coders that share one stream of
32-bit words; blocks do not depend on each other, and inside a block a
checkpoint every ``STEP`` rows of lanes keeps the coders' states and the place
in the stream, so that a reader can start there.  Each block carries the
CRC-32 of its ids and of its stream.

Shard layout, little-endian: magic ``b"RNS1"``; u32 documents, symbols,
blocks; u64 ids; the documents' lengths as u32; symbols as u32; frequencies as
u32 (sum ``1 << SCALE``); u64 offset of each block; the blocks.  A block: u32
ids, checkpoints, words, crc of ids, crc of words; for each checkpoint u32
place and ``LANES`` u64 states; the words as u32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, SCALE, LANES, BLOCK, STEP = b"RNS1", 20, 256, 1 << 16, 128
LOW = np.uint64(1 << 32)
_SHIFT, _HALF, _MASK = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols in ``ids`` and their frequencies, scaled to ``1 << SCALE``, each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    n = counts[symbols].astype(np.float64)
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError(f"{len(symbols)} symbols are too many for a scale of {SCALE} bits")
    f = np.maximum(1, np.floor(n * ((1 << SCALE) / n.sum()))).astype(np.int64)
    while (over := int(f.sum()) - (1 << SCALE)) > 0:  # rounding up of rare symbols; large ones give way
        f -= np.minimum(f - 1, -(-f * over // int(f.sum())))
    f[f.argmax()] += (1 << SCALE) - int(f.sum())
    return symbols.astype(np.uint32), f.astype(np.uint32)


def _encode_blocks(rows: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes ``rows`` (steps by coders) backwards, all coders of all blocks at once.

    Returns which coder put out a word at each step, the words, and the states
    before every ``STEP``-th step.
    """
    steps, coders = rows.shape
    x = np.full(coders, LOW)
    put, words = np.zeros((steps, coders), bool), np.zeros((steps, coders), np.uint32)
    kept = np.zeros((-(-steps // STEP), coders), np.uint64)
    for t in range(steps - 1, -1, -1):
        f, c = freq[rows[t]], start[rows[t]]
        out = put[t]
        np.greater_equal(x >> np.uint64(64 - SCALE), f, out=out)
        words[t] = x.astype(np.uint32)
        x = np.where(out, x >> _HALF, x)
        q = x // f
        x = (q << _SHIFT) + (x - q * f) + c
        if t % STEP == 0:
            kept[t // STEP] = x
    return put, words, kept


def encode(docs: list[np.ndarray]) -> bytes:
    """A shard of the documents' ids (arrays of unsigned integers, any may be empty)."""
    ids = np.concatenate([np.zeros(0, np.uint32), *docs]).astype(np.uint32)
    head = MAGIC
    lengths = np.array([len(d) for d in docs], "<u4")
    if not len(ids):
        return head + struct.pack("<IIIQ", len(docs), 0, 0, 0) + lengths.tobytes()
    symbols, f = frequencies(ids)
    rank = np.zeros(int(symbols[-1]) + 1, np.uint32)
    rank[symbols] = np.arange(len(symbols))
    freq = f.astype(np.uint64)
    start = np.cumsum(freq) - freq
    whole = len(ids) // BLOCK
    blocks: list[bytes] = []
    for part, n in ((ids[: whole * BLOCK], whole), (ids[whole * BLOCK :], 1)):
        if not len(part):
            continue
        size = len(part) // n
        steps = -(-size // LANES)
        filled = np.full(n * steps * LANES, f.argmax(), np.uint32)
        filled[: len(part)] = rank[part]
        rows = filled.reshape(n, steps, LANES).transpose(1, 0, 2).reshape(steps, n * LANES)
        put, words, kept = _encode_blocks(rows, freq, start)
        for b in range(n):
            own = slice(b * LANES, (b + 1) * LANES)
            m = put[:, own]
            stream = words[:, own][m].astype("<u4").tobytes()
            places = np.concatenate([[0], m.sum(axis=1).cumsum()])[: steps : STEP]
            raw = part[b * size : (b + 1) * size].astype("<u4").tobytes()
            points = b"".join(struct.pack("<I", p) + s.astype("<u8").tobytes() for p, s in zip(places.tolist(), kept[:, own], strict=True))
            blocks.append(struct.pack("<IIIII", size, len(kept), len(stream) // 4, zlib.crc32(raw), zlib.crc32(stream)) + points + stream)
    offsets = np.cumsum([0, *map(len, blocks)])[:-1].astype("<u8")
    return b"".join([head, struct.pack("<IIIQ", len(docs), len(symbols), len(blocks), len(ids)), lengths.tobytes(), symbols.astype("<u4").tobytes(), f.astype("<u4").tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """A reader of one shard."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        n, k, b, self.n_ids = struct.unpack_from("<IIIQ", data, 4)
        at = 24
        self.lengths = np.frombuffer(data, "<u4", n, at)
        at += 4 * n
        self.symbols = np.frombuffer(data, "<u4", k, at)
        self.freq = np.frombuffer(data, "<u4", k, at + 4 * k).astype(np.uint64)
        at += 8 * k
        offsets = np.frombuffer(data, "<u8", b, at)
        self.data, self.blocks = data, (offsets + np.uint64(at + 8 * b)).tolist()

    def segments(self) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
        """For each checkpoint: block, first id within it, ids, steps, states, words from there on."""
        for b, at in enumerate(self.blocks):
            size, points, n_words, _, crc = struct.unpack_from("<IIIII", self.data, at)
            at += 20
            words_at = at + points * (4 + 8 * LANES)
            words = np.frombuffer(self.data, "<u4", n_words, words_at)
            if zlib.crc32(words.tobytes()) != crc:
                raise ValueError(f"block {b}: the stream's checksum is wrong")
            steps = -(-size // LANES)
            for p in range(points):
                (place,) = struct.unpack_from("<I", self.data, at)
                states = np.frombuffer(self.data, "<u8", LANES, at + 4)
                at += 4 + 8 * LANES
                first = p * STEP * LANES
                yield b, first, min(STEP * LANES, size - first), min(STEP, steps - p * STEP), states, words[place:]

    def ids(self) -> np.ndarray:
        """All ids; the segments between checkpoints are decoded side by side and checked."""
        if not self.n_ids:
            return np.zeros(0, np.uint32)
        start = np.cumsum(self.freq) - self.freq
        symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        parts = list(self.segments())
        steps = max(s[3] for s in parts)
        n = len(parts)
        x = np.concatenate([s[4] for s in parts])
        stream = np.concatenate([*(s[5][: s[3] * LANES] for s in parts), np.zeros(LANES, np.uint32)])
        place = np.cumsum([0, *(min(len(s[5]), s[3] * LANES) for s in parts)])[:-1]
        last = len(stream) - 1
        rows = np.zeros((steps, n * LANES), np.uint32)
        for t in range(steps):
            slot = x & _MASK
            s = symbol[slot.astype(np.int64)]
            rows[t] = s
            x = self.freq[s] * (x >> _SHIFT) + slot - start[s]
            need = (x < LOW).reshape(n, LANES)
            before = need.cumsum(axis=1)
            at = np.minimum((place[:, None] + before - need).ravel(), last)
            x = np.where(need.ravel(), (x << _HALF) | stream[at].astype(np.uint64), x)
            place = place + before[:, -1]
        out = self.symbols[rows].reshape(steps, n, LANES).transpose(1, 0, 2).reshape(n, steps * LANES)
        ids = np.concatenate([out[i, : s[2]] for i, s in enumerate(parts)])
        at = 0
        for b, place in enumerate(self.blocks):
            size, _, _, crc, _ = struct.unpack_from("<IIIII", self.data, place)
            if zlib.crc32(ids[at : at + size].astype("<u4").tobytes()) != crc:
                raise ValueError(f"block {b}: the ids' checksum is wrong")
            at += size
        return ids

    def documents(self) -> list[np.ndarray]:
        return np.split(self.ids(), np.cumsum(self.lengths)[:-1]) if len(self.lengths) else []
