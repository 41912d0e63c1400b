"""The registered queries over a whole small table, held against brute force or the named library."""

import zlib

import duckdb

from pointweave.llm import queries
from tests.llm.helpers import collected
from tests.llm.test_dedup import brute_components, brute_repeats
from tests.llm.test_pii_toxicity_html import brute_spans
from tests.llm.test_quality_sketch_mixing import brute_statistics

D = "/root/testdata/sf0.001"


def documents():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{D}/documents.parquet'").fetchall())


def test_near_duplicates(spark):
    want, _ = brute_components(documents(), 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in collected(queries.QUERIES["op9_near_duplicates"](spark, D))} == want


def test_repeated_substrings(spark):
    docs = documents()
    want = brute_repeats(docs.items())
    for r in collected(queries.QUERIES["op4_repeated_substrings"](spark, D)):
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"], docs[r["doc_id"]]]


def test_token_shards(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in collected(queries.QUERIES["op5_token_shards"](spark, D))}
    start = 0
    for i, text in sorted(documents().items()):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_counts_and_base_spans(spark):
    docs = documents()
    for r in collected(queries.QUERIES["op8_quality_rules"](spark, D)):
        n, chars, symbols, lines, repeats = brute_statistics(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and not (r["kept"] and r["base_failed"])
    for r in collected(queries.QUERIES["op6_personal_data"](spark, D)):
        own = brute_spans(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[2] == k for s in own) for k in ("email", "ip", "card", "phone")]
        assert all(f"{k}:{a}:{b}" in r["spans"] for a, b, k in own)


def test_sql(spark):
    d = "/root/testdata/sf0.01"
    for name, sql in queries.ORACLE_SQL.items():
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{d}/documents.parquet'")
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, d)
        assert set(got.columns) == set(columns)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
