"""Connected components of edges in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm import common


def thinned(edges: DataFrame) -> DataFrame:
    """Fewer edges ``a, b`` with the same components, where each b has few a's of the many that it shares with others.

    b goes with its least a, and so do its other a's, in place of an edge to
    each: as many edges as b's and different pairs of a's.  An a that is
    common to many b's makes no group here; a b's own a's do.
    """
    own = edges.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("others"))
    return own.select("a", "b").unionByName(own.select("a", F.explode("others").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """``id, component`` for each id in ``a, b`` (long): the least id that it reaches.

    Labels move along edges and then to their own labels' labels, so rounds
    grow with the logarithm of a component's diameter.  Each round is one
    aggregate and two joins, whose hot keys adaptive execution can split; it
    is written to the shared folder, which cuts the lineage.  Only a count of
    changes comes to the driver.
    """
    both = common.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{what}-edges")
    labels = common.stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label"), F.lit(True).alias("changed")), f"{what}-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.select("id", F.col("label").alias("old")).join(near, "id").select("id", "old", F.least("old", "near").alias("low"))
        hops = labels.select(F.col("id").alias("low"), F.col("label").alias("hop"))
        after = lower.join(hops, "low").select("id", F.least("low", "hop").alias("label"), (F.least("low", "hop") != F.col("old")).alias("changed"))
        labels = common.stored(after, f"{what}-labels")
        if labels.where("changed").limit(1).count() == 0:
            return labels.select("id", F.col("label").alias("component"))
