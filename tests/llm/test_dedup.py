import hashlib

import numpy as np
import pytest

from pointweave.llm import graph, hashing, minhash, substrings, suffixes
from tests.llm.helpers import SCHEMA, collected, odd_documents, words


def test_deep_shallow_order_and_prefixes():
    r = np.random.default_rng(0)
    for n, width, letters in ((0, 100, 2), (1, 100, 2), (60, 100, 2), (1500, 84, 3), (400, 10, 2)):
        base = r.integers(97, 97 + letters, (max(1, n // 20 + 1), width), dtype=np.uint8)
        s = base[r.integers(0, len(base), n)].copy()
        if n:
            s[np.arange(n), r.integers(0, width, n)] ^= (r.random(n) < 0.6).astype(np.uint8)
        group = r.integers(0, 7, n)
        order, shared = suffixes.deep_shallow(group, s)
        rows = [(group[i], s[i].tobytes()) for i in order]
        assert rows == sorted(rows) and sorted(order) == list(range(n))
        for i in range(1, n):
            a, b = rows[i - 1], rows[i]
            assert shared[i] == (-1 if a[0] != b[0] else suffixes.common_prefix(a[1], b[1]))


def brute_repeats(docs):
    """By (id, text) in order; equal rows count as one."""
    seen, out = set(), {}
    for key in sorted(set(docs)):
        data = key[1].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if (s := data[p : p + 100]) in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_substrings(spark):
    rows = odd_documents(spark)
    texts = [(-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in collected(rows)]
    want = brute_repeats(texts)
    got = collected(substrings.repeated(rows.repartition(3)))
    assert len(got) == len(texts)
    result = lambda r: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
    by_id = {i: want[i, t] for i, t in texts}
    for r in got:
        assert result(r) == by_id[-1 if r["doc_id"] is None else r["doc_id"]]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    assert substrings.repeated(rows.where("false")).count() == 0


def test_repeated_substrings_with_passages_and_periods(spark):
    passage = words(40, 9)
    docs = [(i, words(20, 100 + i) + " " + passage[: 60 + 17 * i] + words(15, 200 + i) + "ab" * (40 * (i % 3))) for i in range(12)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    want = brute_repeats(docs)
    for r in collected(substrings.repeated(rows.repartition(5))):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[docs[r["doc_id"]]]


def test_anchors_depend_on_the_string_alone(monkeypatch):
    r = np.random.default_rng(5)
    text, other = r.integers(97, 100, 300, dtype=np.uint8).tobytes(), r.integers(97, 100, 3_000_000, dtype=np.uint8).tobytes()
    alone = substrings.anchors([text])
    beside = substrings.anchors([other, text])
    own = beside[0] == 1
    assert all((a == b[own]).all() for a, b in zip(alone[1:], beside[1:], strict=True))
    monkeypatch.setattr(substrings, "BATCH_BYTES", 1000)
    found = [substrings.anchors([p]) for _, p in substrings.pieces(other[:5000])]
    strings = sum(int((high - low + 1).sum()) for _, _, _, low, high, _ in found)
    assert strings == 5000 - 99 and all(at + len(p) <= 5000 and len(p) < 1100 for at, p in substrings.pieces(other[:5000]))
    assert list(substrings.pieces(b"")) == [(0, b"")]


def test_long_texts_and_common_seeds(spark, monkeypatch):
    """Long texts cut into pieces, a seed of blanks with many surroundings, and a period."""
    monkeypatch.setattr(substrings, "BATCH_BYTES", 5000)  # workers import their own; the long text below is cut at the real size
    long = " ".join(words(10, i % 900) for i in range(60_000))
    docs = [(0, long), (1, words(30, 5) + long[2_097_100:2_097_400] + words(10, 6)), *((10 + i, words(9, i) + " " * (20 + i % 90) + words(9, 3000 + i)) for i in range(150)), (500, "ab" * 2000)]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    want = brute_repeats(docs)
    texts = dict(docs)
    for r in collected(substrings.repeated(rows.repartition(4)).drop("kept")):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], texts[r["doc_id"]]]


def brute_components(docs, size, percent):
    """docs: {id: text}; the least id reachable over links."""
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in docs}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in docs}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(spark):
    rows = odd_documents(spark)
    docs = {r["doc_id"]: r["text"] for r in collected(rows) if r["doc_id"] is not None}
    want, sizes = brute_components(docs, 3, 85)
    got = collected(minhash.components(rows, 3, 85))
    assert len(got) == rows.count()
    for r in got:
        i = r["doc_id"]
        if i is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[i], sizes[i], want[i] == i)
    assert minhash.components(rows.where("false")).count() == 0


@pytest.mark.parametrize("block", [900, 1 << 19])
def test_near_duplicates_in_a_large_group(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    base = words(150, 11).split()
    r = np.random.default_rng(3)
    docs = {}
    for i in range(60):
        w = list(base)
        for p in r.integers(0, len(w), int(r.integers(0, 9))):
            w[p] = f"edit{r.integers(0, 1000)}"
        docs[i] = " ".join(w)
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in docs.items()], SCHEMA)
    want, _ = brute_components(docs, 3, 85)
    assert {x["doc_id"]: x["component_id"] for x in collected(minhash.components(rows, 3, 85))} == want


def test_signatures_estimate_likeness():
    r = np.random.default_rng(1)
    ids = hashing.mix(r.integers(0, 1 << 60, 1000).astype(np.uint64))
    a, b = ids[:700], ids[300:]
    estimates = np.mean(minhash.super_min_hash(a) == minhash.super_min_hash(b))
    assert abs(estimates - 0.4) < 0.1
    whole = minhash.super_min_hash(ids)
    assert (np.minimum(minhash.super_min_hash(a), minhash.super_min_hash(b)) == whole).all()
    assert (np.sort(np.floor(minhash.super_min_hash(ids[:1]))) == np.arange(minhash.LENGTH)).all()  # ranks are a permutation


def test_word_hashes_and_shingles(monkeypatch):
    monkeypatch.setattr(hashing, "MOST_KEPT", 2)
    a, b = hashing.word_hashes([b"the cat  sat", b"\n cat sat on\tthe mat "])
    assert len(a) == 3 and len(b) == 5 and a[1] == b[0] and a[2] == b[1] and a[0] == b[3]
    assert len(hashing.shingles(a, 5)) == 1 and len(hashing.shingles(b, 3)) == 3 and not len(hashing.word_hashes([b""])[0])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 50), (7, 7), (200, 100)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in collected(graph.components(edges))}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 100: 50, 200: 50}


def thue_morse(n):
    s = b"a"
    while len(s) < n:
        s += s.translate(bytes.maketrans(b"ab", b"ba"))
    return s[:n].decode()


def test_structured_words_stay_apart(spark):
    t = thue_morse(4096)
    docs = {1: t, 2: t.translate(str.maketrans("ab", "ba")), 3: t + "\n", 4: "a " * 2000, 5: "a " * 1999 + "b"}
    rows = spark.createDataFrame([(i, x, None, None, None) for i, x in docs.items()], SCHEMA)
    want, _ = brute_components(docs, 3, 85)
    assert {x["doc_id"]: x["component_id"] for x in collected(minhash.components(rows, 3, 85))} == want


def test_chains_and_unlike_classes_in_shared_bands(spark, monkeypatch):
    """A chain whose ends are unlike, and texts with a common part that are near each other but below the threshold."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 3000)
    line = words(500, 31).split()
    docs = {i: " ".join(line[3 * i : 3 * i + 200]) for i in range(60)}
    common_part = words(160, 32)
    docs |= {100 + i: common_part + " " + words(35, 700 + i // 2) + f" x{i}" for i in range(60)}
    rows = spark.createDataFrame([(i, x, None, None, None) for i, x in docs.items()], SCHEMA)
    want, _ = brute_components(docs, 3, 85)
    assert len(set(want.values())) == 31
    assert {x["doc_id"]: x["component_id"] for x in collected(minhash.components(rows, 3, 85))} == want


def test_recall_at_the_threshold():
    """Pairs of likeness 0.85 to 0.87 share a band; 1,000 planted pairs."""
    r = np.random.default_rng(7)
    met = 0
    for _ in range(1000):
        ids = hashing.mix(r.integers(0, 1 << 62, 230).astype(np.uint64))
        cut = int(r.integers(14, 17))
        a, b = ids[:-cut], ids[cut:]
        met += bool((minhash.band_keys(minhash.super_min_hash(a), 60) == minhash.band_keys(minhash.super_min_hash(b), 60)).any())
    assert met >= 998
