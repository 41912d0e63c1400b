import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from pointweave.llm import mixing, quality, sketch
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, collected, odd_documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(t):
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rows = odd_documents(spark)
    got = Counter(tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in collected(quality.statistics(rows)))
    assert got == Counter((r["doc_id"], *brute_statistics(r["text"] or "")) for r in collected(rows))
    plan = quality.judge(rows, [quality.Rule((("symbols_per_word", True, 0.3),))])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_find_planted_thresholds():
    r = np.random.default_rng(0)
    x = {k: r.random(600) for k in quality.FEATURES}
    bad = (x["symbols_per_word"] > 0.7) | ((x["repeat_share"] > 0.6) & (x["mean_word_chars"] <= 0.4))
    rules = quality.learn(x, bad)
    told = np.zeros(600, bool)
    for rule in rules:
        told |= rule.covers(x)
    assert (told == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(600, bool)) == []


def test_quality_verdicts(spark):
    good = [(i, words(120, i)) for i in range(60)]
    junk = [(100 + i, " ".join(w + "###" for w in words(120, 500 + i).split())) for i in range(30)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in good + junk], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in good + junk], "doc_id bigint, quality int, toxic int")
    rules = quality.train(docs, labels)
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in collected(quality.judge(docs, rules))}
    assert all(verdict[i] == (False, True) for i, _ in good) and all(verdict[i] == (False, False) for i, _ in junk)
    assert quality.train(docs, labels.where("false")) == [] and quality.judge(docs.where("false"), rules).count() == 0


def test_edited_texts(spark):
    rows = odd_documents(spark)
    order = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in collected(rows)])
    want = Counter()
    for k, (known, i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][2]
        q = len(t) // 4
        want[i if known else None, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()] += 1
    got = collected(sketch.compare_edited(rows))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (0, 2)}
    assert len(same) == 1
    assert sketch.compare_edited(rows.where("false")).count() == 0
    one = collected(sketch.compare_edited(rows.where("doc_id = 0")))
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_sketch_estimates(spark):
    a, b = words(900, 21).split(), words(300, 22).split()
    texts = [" ".join(a), " ".join(a[:600] + b), " ".join(a[:300])]
    df = spark.createDataFrame([(texts[0], texts[1], texts[2])], "a string, b string, c string").select(*[sketch.sketch(F.col(k)).alias(k) for k in "abc"])

    def shingles(t):
        w = t.lower().split()
        return set(zip(*[w[k:] for k in range(5)], strict=False))

    x, y, z = map(shingles, texts)
    r = df.select(
        sketch.resemblance(F.col("a"), F.col("b")).alias("j"), sketch.containment(F.col("c"), F.col("a")).alias("in"), sketch.distinct(F.col("a")).alias("n"), (sketch.merge(F.col("b"), F.col("c")) == sketch.merge(F.col("c"), F.col("b"))).alias("same")
    ).first()
    assert abs(r["j"] - len(x & y) / len(x | y)) < 0.15 and abs(r["in"] - len(z & x) / len(z)) < 0.25 and abs(r["n"] / len(x) - 1) < 0.3 and r["same"]


@pytest.mark.parametrize("seed", range(30))
def test_schedule_keeps_shares_within_a_block(seed):
    r = np.random.default_rng(seed)
    weights = {str(i): int(r.integers(1, 30)) for i in range(int(r.integers(1, 7)))}
    total, ran = sum(weights.values()), dict.fromkeys(weights, 0)
    for t, s in enumerate(mixing.period(weights), 1):
        ran[s] += 1
        assert all(abs(ran[x] * total - weights[x] * t) < total for x in weights)
    assert ran == weights
    blocks = {s: int(r.integers(0, 200)) for s in weights}
    plan = mixing.schedule(blocks, weights)
    places = [x for s, n in blocks.items() if n for x in plan.slots(s, np.arange(n)).tolist()]
    assert sorted(places) == list(range(sum(blocks.values())))


def test_mixing(spark):
    rows = odd_documents(spark)
    got = collected(mixing.mixed(rows, block_rows=2))
    assert len(got) == rows.count() and len({r["mix_position"] for r in got}) == len(got)
    blocks = Counter((r["source"], r["mix_block"]) for r in got)
    assert max(blocks.values()) == 2 and len({r["mix_slot"] for r in got}) == len(blocks)
    counts = Counter(r["source"] for r in got)
    assert all(sorted(b for s, b in blocks if s == source) == list(range(-(-n // 2))) for source, n in counts.items())
    assert mixing.in_order(rows).columns == rows.columns and mixing.in_order(rows).count() == rows.count()
    assert mixing.mixed(rows.where("false")).count() == 0


def test_mixing_follows_given_shares(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = collected(mixing.mixed(rows, {"a": 3, "b": 1}, block_rows=10))
    early = sorted(got, key=lambda r: r["mix_position"])[:1200]
    assert abs(sum(r["source"] == "a" for r in early) - 900) <= 10
