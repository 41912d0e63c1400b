"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters and digits to plain letters,
drops invisible characters and turns everything between words into one space.
Lexicon entries are whole words or beginnings of words; their weights are log
ratios of their rates in toxic and other training texts.  Exception phrases
cancel the matches they hold.  The weights found, set against the text's
length, give the score through a logistic curve fitted to the same rows.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm import common

#: Letters that look like Latin ones.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "ı": "i", "ɑ": "a", "ɡ": "g", "ꞌ": "'", "ł": "l"}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "+": "t"}
#: Entries that need no training rows, and phrases in which a word is harmless.
SEED_WORDS = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "scum", "pathetic", "worthless", "disgusting", "trash", "clown")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "scum line", "pond scum")
SEED_WEIGHT = 4.0
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS) | _INVISIBLE
_SIGN = re.compile(r"(?<=[^\W\d_])[@$!|€+](?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Folded words with one space before, between and after them."""
    s = text if text.isascii() else unicodedata.normalize("NFKC", text)
    s = s.lower().translate(_FOLD)
    if any(c in s for c in SIGNS):
        s = _SIGN.sub(lambda m: SIGNS[m[0]], s)
    return f" {_GAP.sub(' ', s).strip()} "


@dataclass(frozen=True)
class Model:
    """weights: by entry, which begins with a space and ends with one if it is a whole word."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, ...]

    def features(self, s: str) -> list[float]:
        """From folded text."""
        total, hits = 0.0, 0
        cancelled: list[tuple[int, int]] = []
        found: list[tuple[int, int, float]] = []
        for end, (n, weight) in automaton(self).iter(s):
            if weight is None:
                cancelled.append((end - n + 1, end))
            else:
                found.append((end - n + 1, end, weight))
        last, reach, k = -1, -1, 0
        cancelled.sort()
        for a, b, weight in sorted(found):
            while k < len(cancelled) and cancelled[k][0] <= a:
                reach = max(reach, cancelled[k][1])  # how far the phrases that have begun go
                k += 1
            if a > last and b > reach:
                total, hits, last = total + weight, hits + 1, a
        words = s.count(" ") - 1 + (len(s) <= 2)
        return [1.0, float(hits > 0), math.log1p(total), math.log1p(1000 * total / (words + 20)), total / math.sqrt(words + 20), math.log(words + 20)]

    def score(self, text: str) -> float:
        z = sum(a * b for a, b in zip(self.coefficients, self.features(fold(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


_AUTOMATA: dict[int, object] = {}
common.keeps("toxicity", _AUTOMATA.clear)


def automaton(model: Model):
    if (key := id(model)) not in _AUTOMATA:
        import ahocorasick

        built = ahocorasick.Automaton()
        for k, w in model.weights.items():
            built.add_word(k, (len(k), w))
        for k in model.exceptions:
            built.add_word(f" {k} ", (len(k) + 2, None))
        built.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = built, model  # the model stays, so that its id does
    return _AUTOMATA[key][0]


def _entries(folded: str) -> Counter:
    """The candidates in a text: words as wholes and their beginnings of 4 to 7 letters."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        if len(w) >= 3:
            out[f" {w} "] += n
        for k in range(4, min(8, len(w) + 1)):
            out[f" {w[:k]}"] += n
    return out


def learn_lexicon(folded: list[str], labels: list[int], most_entries: int = 1000, per_text: int = 4) -> dict[str, float]:
    """Weights of entries that are far more frequent in toxic texts.

    An entry counts at most ``per_text`` times in a text, equal texts count
    once, the lexicon holds the ``most_entries`` most telling ones, and of entries where one begins another the more telling one stays.
    """
    rows = list(dict(zip(folded, labels, strict=True)).items())
    toxic = [t for t, y in rows if y]
    counts: tuple[Counter, Counter] = Counter(), Counter()
    spread: Counter = Counter()
    size = [0, 0]
    for t in toxic:
        c = _entries(t)
        spread.update(c.keys())
        counts[1].update({k: min(v, per_text) for k, v in c.items()})
        size[1] += t.count(" ") - 1
    least = max(4, len(toxic) // 50)
    candidates = {k for k, n in spread.items() if n >= least}
    for t, y in rows:
        if not y:
            size[0] += t.count(" ") - 1
            counts[0].update({k: min(v, per_text) for k, v in _entries(t).items() if k in candidates})
    told: list[tuple[float, str, float]] = []
    for k in candidates:
        a, b = counts[1][k], counts[0][k]
        ratio = math.log(((a + 0.5) / (size[1] + 1)) / ((b + 0.5) / (size[0] + 1)))
        share = a / (a + b)
        expected = size[1] / (size[0] + size[1])
        gain = a * math.log(share / expected) + (b * math.log((1 - share) / (1 - expected)) if b else 0)
        if ratio >= math.log(6) and gain >= 12:
            told.append((gain, k, ratio))
    kept: dict[str, float] = {}
    for _, k, ratio in sorted(told, reverse=True):
        if len(kept) < most_entries and not any(k.startswith(x) or x.startswith(k.rstrip()) for x in kept):
            kept[k] = ratio
    return kept


def learn_exceptions(folded: list[str], labels: list[int], weights: dict[str, float], least: int = 8) -> tuple[str, ...]:
    """Two-word phrases with a lexicon entry that ``least`` other texts have and no toxic one."""
    bad: set[str] = set()
    good: Counter = Counter()
    whole = {k[1:-1] for k in weights if k[-1] == " "}
    starts = {k[1:] for k in weights if k[-1] != " "}
    known: dict[str, bool] = {}
    for text, y in zip(folded, labels, strict=True):
        words = text.split()
        for w in words:
            if w not in known:
                known[w] = w in whole or any(w[:n] in starts for n in range(4, 8))
        own = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if known[a] or known[b]}
        if y:
            bad |= own
        else:
            good.update(own)
    return tuple(sorted(k for k, n in good.items() if n >= least and k not in bad))


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled texts; without both labels, the seed words with a plain curve."""
    weights = {f" {w} ": SEED_WEIGHT for w in SEED_WORDS}
    plain = (-5.0, 3.0, 1.0, 0.5, 0.0, 0.0)
    if len(set(labels)) < 2:
        return Model(weights, EXCEPTIONS, plain)
    folded = [fold(t) for t in texts]
    learned = learn_lexicon(folded, labels)
    weights = {k: w for k, w in weights.items() if not any(k.startswith(x) for x in learned)} | learned
    model = Model(weights, (*EXCEPTIONS, *learn_exceptions(folded, labels, learned)), plain)
    x, y = np.array([model.features(t) for t in folded]), np.array(labels, float)
    beta = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        penalty = 0.05 * np.eye(len(beta))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(model.weights, model.exceptions, tuple(beta.tolist()))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels a model must never see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, most_rows: int = 5_000, most_chars: int = 64_000_000) -> Model:
    """Fit on at most ``most_rows`` labelled documents of ``most_chars`` characters together, outside the held-out part.

    Which ones, if there are more, is told by a hash of their ids; their texts
    are whole.  The bounds keep what comes to the driver small however large
    the table is.  An id with several labels counts as toxic if one says so;
    null ids, labels and texts are left out; rows with equal ids are all taken.
    Starts a job at once.
    """
    marked = common.narrow(labels, doc_id="doc_id", toxic="toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    some = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = common.narrow(documents, doc_id="doc_id", text="text").where(F.col("text").isNotNull())
    found = common.stored(texts.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic", F.xxhash64("doc_id", "text").alias("h"), F.length("text").alias("n")), "toxicity-labelled")
    sizes = found.groupBy("h").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    taken = sizes.where(F.col("upto") <= most_chars).select("h")
    rows = found.join(taken, "h").select("doc_id", "text", "toxic").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [int(r.toxic > 0) for r in rows])


def score(documents: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``documents`` with ``score`` and ``predicted``; a map without any shuffle.

    Null and empty texts get the score of a text without matches; repeated
    rows and null ids are scored row by row; an empty table stays empty.  The
    input's columns are kept; one named ``score`` or ``predicted`` is replaced.
    """
    broadcast = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(text):
        common.turn("toxicity")
        m = broadcast.value
        return text.map(lambda t: m.score(t or ""), na_action=None).astype(float)

    out = documents.withColumn("score", scored(common.text_or_empty()))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
