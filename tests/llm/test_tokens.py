import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pointweave.llm import bpe, common, pretokens, rans, tokens
from tests.llm.helpers import collected, odd_documents


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t\rab1!é　\x1c\x85\xa0'sß😀ſ²", max_size=20))
def test_encoding_equals_the_plain_library(text):
    own = bpe.encoder(*bpe.default_vocabulary())
    if not hasattr(test_encoding_equals_the_plain_library, "enc"):
        test_encoding_equals_the_plain_library.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens)}, special_tokens={})
    ids = own.encode(text)
    assert ids == test_encoding_equals_the_plain_library.enc.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_every_token_is_encoded_as_itself(reference):
    own = bpe.encoder(*bpe.default_vocabulary())
    texts = [t.decode() for t in own.tokens if t.isascii() and t.isalpha()][:2000]
    assert [own.encode(t) for t in texts] == [reference.encode_ordinary(t) for t in texts]


def test_words_join_to_the_text():
    for text in ("", " ", "a b", "  a  b  ", "a\n b", " \n "):
        first, *rest = pretokens.words(text)
        assert first + "".join(" " + w for w in rest) == text


def test_documents(spark, reference):
    rows = odd_documents(spark)
    got = sorted(collected(bpe.encode(rows)), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    texts = sorted([(r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in collected(rows)], key=lambda x: x[:2])
    assert len(got) == len(texts)
    for r, (_, i, t) in zip(got, texts, strict=True):
        ids = reference.encode_ordinary(t)
        assert (r["doc_id"], r["ids"], r["n_tokens"], bytes(r["decoded"])) == (i, ids, len(ids), t.encode())
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode(rows.where("false")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 32768, 32769, 65536, 65537, 150_000])
def test_range_coder_round_trip(n):
    r = np.random.default_rng(n)
    docs = [np.minimum(r.zipf(1.3, k) - 1, 50256).astype(np.uint32) for k in (n, 0, n // 3)]
    back = rans.Shard(rans.encode(docs)).documents()
    assert [d.tolist() for d in back] == [d.tolist() for d in docs]


def test_range_coder_segments_and_checksums():
    docs = [np.arange(100_000, dtype=np.uint32) % 1000]
    data = rans.encode(docs)
    starts = [(b, first) for b, first, *_ in rans.Shard(data).segments()]
    assert (0, rans.STEP * rans.LANES) in starts  # a reader can begin inside a block
    broken = bytearray(data)
    broken[-50] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.Shard(bytes(broken)).ids()
    assert len(rans.encode([np.full(100_000, 7, np.uint32)])) < 20_000


def test_shards(spark, reference):
    rows = odd_documents(spark)
    path = common.shared_dir(spark, "test-shards")
    tokens.write(rows, path, partitions=3)
    got = sorted(collected(tokens.read(spark, path)), key=lambda r: r["start"])
    texts = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in collected(rows)])
    at = 0
    for r, (known, i, _, t) in zip(got, texts, strict=True):
        ids = [*reference.encode_ordinary(t), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (i if known else None, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = common.shared_dir(spark, "test-shards")
    tokens.write(rows.where("false"), empty)
    assert tokens.read(spark, empty).count() == 0


def test_slices_cover_a_batch():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * (3 << 20), "c", "d" * (1 << 20), "e" * (1 << 20), "f" * (1 << 20), ""]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    got = list(common.slices(batch, 3))
    assert [i for at, n in got for i in range(at, at + n)] == list(range(len(texts))) and max(n for _, n in got) <= 3
    assert all(n == 1 or sum(len(t or "") for t in texts[at : at + n]) <= common.SLICE_BYTES for at, n in got)
    assert list(common.slices(batch.slice(0, 0), 3)) == []
    assert list(common.slices(pa.RecordBatch.from_pydict({"x": [1, 2, 3]}), 2)) == [(0, 2), (2, 1)]
