from collections import defaultdict
from fractions import Fraction

import corpus_pipeline

from pointweave.llm import common, mixing
from pyspark.sql import functions as F
from tests.llm.helpers import collected


def brute_places(rows, block_rows):
    """Places by trying every source in every slot; ``rows`` are (source, rank key, id)."""
    by = defaultdict(list)
    for source, key, i in sorted(rows, key=lambda r: r[1:]):
        by[source].append(i)
    left = {s: -(-len(ids) // block_rows) for s, ids in by.items()}
    total, done, base, slot, start, places = dict(left), dict.fromkeys(left, 0), dict.fromkeys(left, 0), 0, 0, {}
    while left:
        share = {s: Fraction(len(by[s]) ** 0.5) for s in left}
        whole = sum(share.values())
        ready = []
        for s in left:
            k, w = done[s] - base[s], share[s] / whole
            if k / w // 1 <= slot - start:
                ready.append((-(-(k + 1) / w // 1), s))
        _, s = min(ready)
        for n, i in enumerate(by[s][done[s] * block_rows : (done[s] + 1) * block_rows]):
            places[i] = slot * block_rows + n
        done[s], slot = done[s] + 1, slot + 1
        if done[s] == total[s]:
            del left[s]
            base, start = dict(done), slot
    return places


def test_pipeline_returns_the_place_in_the_mixture(spark):
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.floor(F.sqrt("id") / 20)).alias("source"), F.lit(6).alias("n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    ordered = stages["mixing"](spark, docs, "")
    path = common.shared_dir(spark, "test-mixture")
    ordered.write.option("maxRecordsPerFile", 700).parquet(path)
    stored = spark.read.parquet(path)
    assert len(stored.inputFiles()) > 4
    got = {r["doc_id"]: r["mix_position"] for r in collected(stages["byte_bpe"](spark, stored, "").select("doc_id", "mix_position"))}
    keyed = [("+" + r["source"], r["h"], r["doc_id"]) for r in collected(docs.withColumn("h", F.xxhash64("doc_id", "text")))]
    keyed = [(s, h % (1 << 64), i) for s, h, i in keyed]  # the parts go by the hash's highest bits, unsigned
    assert got == brute_places(keyed, mixing.BLOCK_ROWS)
