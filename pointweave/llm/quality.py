"""Quality rules: statistics as native expressions, and decision lists learned by sequential covering.

Rules are conjunctions of thresholds on the statistics.  They are grown on one
part of the labelled rows, condition by condition, by the gain in purity, and
pruned on the other.  The finished list is an ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm import common
from pointweave.llm.words import BLANKS, let, shingle_hashes, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: The statistics that rules may use, as expressions over the counted columns.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def repeated_words(own: Column) -> Column:
    """Words that lie in 3-word windows which the text has twice or more."""

    def covered(h: Column) -> Column:
        """Of the windows' hashes; windows with equal hashes stand together after sorting."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]))

        places = F.sort_array(F.transform(let(pairs, twice), lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    def of(w: Column) -> Column:
        hashes = F.when(F.size(w) >= 3, shingle_hashes(w, 3)).otherwise(F.array().cast("array<bigint>"))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))

    return let(own, of)


def count_of(text: Column, characters: str) -> Column:
    """Occurrences of a few characters; replacing one at a time is quicker than a table for all."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(left)).cast("bigint")


def statistics(df: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of ``doc_id, text``; a map without any shuffle.

    Null and empty texts have no words, lines or characters; repeated rows and
    null ids are counted row by row; other columns are ignored.
    """
    text = F.col("text")
    rows = common.narrow(df, doc_id="doc_id", text="text").withColumn("text", common.text_or_empty())
    rows = rows.withColumn("w", words(text)).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return rows.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        count_of(text, "!").alias("n_bangs"),
    )


@dataclass(frozen=True)
class Rule:
    """All of the conditions (feature, whether it must be above, threshold) tell a bad document."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, cut in self.conditions:
            out &= (x[name] > cut) if above else (x[name] <= cut)
        return out

    def sql(self) -> str:
        return " and ".join(f"{FEATURES[n]} {'>' if above else '<='} cast('{cut!r}' as double)" for n, above, cut in self.conditions)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Adds the condition with the largest gain in purity until only bad rows are covered."""
    conditions: list[tuple[str, bool, float]] = []
    inside = np.ones(len(bad), bool)
    while not bad[inside].all() and len(conditions) < 5:
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best = (1e-9, None)
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            ends = np.flatnonzero(np.diff(v) > 0)  # a threshold lies between different values
            if not len(ends):
                continue
            below = np.cumsum(y)[ends]
            counts = ((False, below, ends + 1 - below), (True, p - below, n - (ends + 1 - below)))
            for above, good_p, good_n in counts:
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = good_p * (np.log2(good_p / (good_p + good_n)) - math.log2(p / (p + n)))
                gain = np.nan_to_num(gain, nan=0.0, neginf=0.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return Rule(tuple(conditions))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule with the best (p - n) / (p + n) on unseen rows, its precision and cover."""
    best = (-2.0, rule, 0.0, 0)
    for k in range(1, len(rule.conditions) + 1):
        short = Rule(rule.conditions[:k])
        c = short.covers(x)
        p, n = int(bad[c].sum()), int((~bad[c]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, short, p / max(1, p + n), p)
    return best[1], best[2], best[3]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 3, most_rules: int = 12) -> list[Rule]:
    """Sequential covering: rules for bad rows, in order, until none is precise enough on the pruning part.

    Rules have at most five conditions and the list at most ``most_rules``
    rules; both bound the expression that Spark compiles, not the rows.
    """
    part = np.arange(len(bad)) % 3 == 2  # every third row prunes
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, prune = left & ~part, left & part
        if bad[grow].sum() < least or bad[prune].sum() < 1:
            break
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule.conditions:
            break
        rule, share, _ = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        covered = rule.covers(x) & left
        if share < precision or bad[covered].sum() < least or bad[covered].mean() < precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def train(documents: DataFrame, labels: DataFrame, most_rows: int = 5_000) -> list[Rule]:
    """Learn from the statistics of at most ``most_rows`` labelled documents, told by a hash of their ids.

    Without labelled documents, or without both labels, there are no rules.
    An id with several labels takes the least; null ids and labels are left
    out; rows with equal ids are all taken.  Starts a job at once.
    """
    marked = common.narrow(labels, doc_id="doc_id", quality="quality").where("doc_id is not null and quality is not null")
    some = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = common.narrow(documents, doc_id="doc_id", text="text").join(F.broadcast(some), "doc_id")  # at most most_rows ids
    counts = statistics(rows.select("doc_id", "text")).select("doc_id", *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()])
    got = sorted(map(tuple, counts.join(F.broadcast(some), "doc_id").select("doc_id", "quality", *FEATURES).collect()))
    bad = np.array([r[1] == 0 for r in got], bool)
    if not len(bad) or bad.all() or not bad.any():
        return []
    return learn({k: np.array([r[2 + i] for r in got]) for i, k in enumerate(FEATURES)}, bad)


def decision(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: the first rule that holds rejects, the end accepts."""
    out = F
    for rule in rules:
        out = out.when(F.expr(rule.sql()), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def judge(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts of ``doc_id, text``, the fixed rule's verdict ``base_failed`` and the list's, ``kept``.

    A document fails the fixed rule with fewer than 50 words, or more than
    half of its words in repeated windows; what fails is never kept.  Null and
    empty texts fail; repeated rows are judged row by row; an empty table
    stays empty; other columns are ignored.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = statistics(df).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & decision(rules))
