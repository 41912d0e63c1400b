import pytest

from pointweave.llm import mixing
from pyspark.sql import functions as F


def test_names_and_growing_blocks(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("_hash"), F.lit(2).alias("_rank"))
    got = mixing.mixed(rows)
    assert got.columns == [*rows.columns, "mix_block", "mix_slot", "mix_position"] and got.select(F.sum("_hash"), F.sum("_rank")).first() == (500, 1000)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 4)
    assert mixing.mixed(rows).agg(F.max("mix_block")).first()[0] == 3
    with pytest.raises(ValueError, match="_mix_"):
        mixing.mixed(rows.withColumn("_mix_hash", F.lit(1)))
