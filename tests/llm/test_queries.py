import __spark_entry__
import corpus_pipeline
from pointweave.llm import queries
from tests.llm.test_dedup import brute_components


def test_registered():
    assert sorted({int(k[2:].split("_")[0]) for k in queries.QUERIES}) == list(range(1, 11))
    assert {"pipeline", *queries.QUERIES} <= __spark_entry__.queries().keys()


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, d)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    texts = {r.doc_id: r.text for r in kept.collect()}
    one = stages["minhash_near_dedup"](spark, kept, d)
    want, _ = brute_components(texts, 5, 80)
    assert {r.doc_id for r in one.select("doc_id").collect()} == set(want.values())
    masked = stages["pii"](spark, one, d)
    mixed = stages["mixing"](spark, masked, d)
    assert masked.count() == mixed.count() == one.count() and mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(want.values())
