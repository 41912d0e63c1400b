"""The corpus pipeline: documents through the stages in :data:`STAGES`.

Each stage takes what the one before kept and returns the columns of
documents, the last its token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm import bpe, common, minhash, mixing, pii, toxicity


def decent(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on ``labels``, does not reject."""
    model = toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, likeness 0.8 or more) the document with the least id."""
    kept = minhash.components(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    lone = docs.where("doc_id is null")  # rows without an id are linked with nothing
    return docs.join(kept, "doc_id", "left_semi").unionByName(lone)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order that interleaves the sources by their target weights."""
    return mixing.in_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document that is left, with its place in the mixture, ``mix_position``.

    A file scan need not return rows in the order of the files, so the place
    is worked out once more from the rows, on which alone it depends.  It is
    stored before the texts are encoded: both in one stage would need two
    Python workers for each task.
    """
    placed = common.stored(mixing.mixed(docs).select("doc_id", "text", "mix_position"), "pipeline-placed")
    return bpe.encode(placed, keep=("mix_position",)).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", decent),
    ("minhash_near_dedup", distinct),
    ("pii", private),
    ("mixing", mixture),
    ("byte_bpe", encoded),
]

#: Neither a fitted model nor the coders can be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result stored before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, f"pipeline-{name}")
    return docs
