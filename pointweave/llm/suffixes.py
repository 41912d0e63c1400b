"""Deep-shallow sorting of strings of one bounded length.

Multikey quicksort orders them to a shallow depth, eight bytes at a time;
groups that still agree there are ordered by blind tries, whose inner nodes
know only where their strings part, so that a string is compared in full with
one other.  Both give the lengths of common prefixes on the way.
"""

from __future__ import annotations

import numpy as np

#: Bytes to which multikey quicksort goes.
SHALLOW = 32


def common_prefix(a: bytes, b: bytes) -> int:
    """Of strings of equal length."""
    x = int.from_bytes(a) ^ int.from_bytes(b)
    return len(a) - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie over strings of equal length: leaves are lists of equal strings, inner nodes [depth, {byte: child}]."""

    def __init__(self):
        self.root: list | None = None

    def insert(self, s: bytes, name: int) -> None:
        if self.root is None:
            self.root = [len(s), s, [name]]
            return
        node = self.root
        while isinstance(node[1], dict):  # blindly along the bytes at which strings part
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        depth = common_prefix(s, node[1])
        if depth == len(s):
            node[2].append(name)
            return
        above, node = None, self.root
        while node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        leaf = [len(s), s, [name]]
        if node[0] == depth:
            node[1][s[depth]] = leaf
            return
        some = node
        while isinstance(some[1], dict):
            some = next(iter(some[1].values()))
        parted = [depth, {some[1][depth]: node, s[depth]: leaf}]
        if above is None:
            self.root = parted
        else:
            above[1][s[above[0]]] = parted

    def walk(self) -> tuple[list[int], list[int]]:
        """Names in order, and for each the common prefix with the one before (the first: 0)."""
        names: list[int] = []
        shared: list[int] = []
        todo = [(self.root, 0)] if self.root else []
        while todo:
            node, before = todo.pop()
            if isinstance(node[1], dict):
                below = [node[1][b] for b in sorted(node[1])]
                todo.extend((child, node[0]) for child in reversed(below[1:]))
                todo.append((below[0], before))
            else:
                names.extend(node[2])
                shared.extend([before, *[node[0]] * (len(node[2]) - 1)])
        return names, shared


def multikey_quicksort(order: np.ndarray, run: np.ndarray, strings: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort each run of ``order`` to ``depth`` bytes; the new order and runs, whose rows agree so far.

    Each run is parted into rows below, at and above the median of three of
    its own keys, the next eight bytes; the middle part goes on with the eight
    bytes after.  All runs take a step together.
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(np.uint64)
    agreed = np.zeros(n, np.int64)
    while True:
        live = np.flatnonzero((np.bincount(run)[run] > 1) & (agreed < min(depth, width)))
        if not len(live):
            return order, run
        rows, own = order[live], run[live]
        key = words[rows, agreed[live] // 8]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(start, len(live)))
        a, b, c = key[start], key[start + count // 2], key[start + count - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), count)
        side = (key > pivot).astype(np.int64) + (key >= pivot)  # 0, 1 or 2
        inner = np.argsort(own * 3 + side, kind="stable")
        order[live], side = rows[inner], side[inner]
        agreed[live] += 8 * (side == 1)
        step = np.zeros(n, np.int64)
        step[live[1:][(own[1:] == own[:-1]) & (side[1:] != side[:-1])]] = 1
        run = run + np.cumsum(step)


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``strings`` (uint8) within ``group``, and the common prefix with the row before.

    The prefix is -1 where a new group starts.
    """
    n, width = strings.shape
    order = np.argsort(group, kind="stable")
    shared = np.zeros(n, np.int64)
    if not n:
        return order, shared
    shallow = min(-(-SHALLOW // 8) * 8, width)
    groups = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]]))
    order, run = multikey_quicksort(order, groups.copy(), strings, SHALLOW)
    parted = np.flatnonzero(run[1:] != run[:-1]) + 1
    shared[parted] = (strings[order[parted], :shallow] != strings[order[parted - 1], :shallow]).argmax(axis=1)
    shared[np.concatenate([[True], groups[1:] != groups[:-1]])] = -1
    size = np.bincount(run)
    ends = np.cumsum(size)
    for r in np.flatnonzero(size > 1).tolist():
        a, b = int(ends[r] - size[r]), int(ends[r])
        trie = BlindTrie()
        rows = order[a:b]
        for i, name in enumerate(rows.tolist()):
            trie.insert(strings[name].tobytes(), i)
        names, lengths = trie.walk()
        order[a:b] = rows[names]
        shared[a + 1 : b] = lengths[1:]
    return order, shared
