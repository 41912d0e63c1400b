"""Small tables with every odd case, and brute-force versions to hold the operators against."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: A second input column for each name that operators use inside.
CLASHES = "doc bigint, tag string, id string, score2 string, h string, key string, host string, w string, rank string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_documents(spark):
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base),
        (1, " ".join(near)),
        (2, base),
        (3, None),
        (4, ""),
        (5, "   \n\t  "),
        (6, "one two"),
        (7, words(80, 2) + " " + base[:200] + " " + words(30, 3)),
        (8, "x" * 250 + " " + "the " * 400),
        (9, words(3000, 4)),
        (9, words(3000, 4)),
        (10, words(90, 5) + "\nline one here\nline one here\n" + words(20, 6)),
        (None, words(60, 7)),
        (11, "mail a.b@c.de and +1 (212) 555-0147 or 10.0.0.1, card 4111 1111 1111 1111, é😀ß"),
        (12, "<|endoftext|>  two  spaces\r\n and\xa0odd　blanks \n \n x"),
    ]
    full = [(i, t, "en", None if i == 4 else f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for c in CLASHES.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, df["doc_id"].cast(kind))
    return df


def collected(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
