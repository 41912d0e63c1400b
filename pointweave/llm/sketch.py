"""Document fingerprints: bottom-k sketches of shingle hashes, as native expressions.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a text's
shingles.  Sketches of parts merge to the sketch of the whole.  Two sketches
estimate resemblance and containment, one the number of distinct shingles;
with fewer than ``k`` shingles all of these are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm import common
from pointweave.llm.words import let, shingle_hashes, words

K, SIZE = 128, 5


def sketch(text: Column, k: int = K, size: int = SIZE) -> Column:
    """The sketch of a text that isn't null; words are compared in lower case."""
    return smallest(shingle_hashes(words(F.lower(text)), size), k)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A or B|; of two empty sets 1, of an empty and another 0."""
    union = merge(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles."""
    spread = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / spread)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of |A and B| / |A|; 1 for an empty A."""
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct(a, k)))


def written(a: Column) -> Column:
    """A sketch as text: its hashes in hexadecimal digits, one after the other."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def fingerprints(df: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """``doc_id, sketch, fingerprint, n_shingles`` of ``doc_id, text``; null and empty texts have the empty sketch."""
    rows = common.narrow(df, doc_id="doc_id", text="text").withColumn("sketch", sketch(common.text_or_empty(), k, size))
    return rows.select("doc_id", "sketch", written(F.col("sketch")).alias("fingerprint"), distinct(F.col("sketch"), k).alias("n_shingles"))


def with_next(rows: DataFrame, key: str, others: list[str], buckets: int | None = None) -> DataFrame:
    """``rows`` with the struct ``next`` of ``others`` in the next row by ``key``, after the last the first.

    Rows are dealt out by quantiles of the key, so no task sorts more than
    its part; the first row of each part stands in for the next of the part
    before.  Null keys come first; rows with equal keys follow ``others``.
    """
    spark = rows.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # evenly spaced quantiles of one narrow column: n numbers come to the driver
    cuts = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast(f"array<{rows.schema[key].dataType.simpleString()}>")
    part = F.coalesce(F.size(F.filter(bounds, lambda c: c <= F.col(key))), F.lit(0))
    dealt = rows.withColumn("part", part).repartition(n, "part")  # a task fetches a few parts at a time only
    own = Window.partitionBy("part").orderBy(key, *others)
    value = F.struct(*others)
    placed = dealt.withColumn("following", F.lead(value).over(own)).withColumn("place", F.row_number().over(own))
    firsts = placed.where(F.col("place") == 1).select("part", value.alias("first"))
    line = Window.orderBy("part")  # over one row for each part
    around = firsts.select((F.coalesce(F.lag("part").over(line), F.max("part").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).alias("part"), F.col("first").alias("next_first"))
    return placed.join(around, "part").withColumn("next", F.coalesce("following", "next_first")).drop("part", "following", "place", "next_first")


def compare_edited(df: DataFrame, k: int = K, size: int = SIZE) -> DataFrame:
    """Each text's fingerprint against that of its edited text and of the next document.

    The edited text has the last quarter of the code points replaced by as
    many (or all) of the next text's first ones, the next in ascending order
    of ``doc_id``, after the last the first.  Null counts as empty; of rows
    with equal ids the lesser text comes first; a null id comes before all;
    an only document is its own next; other columns are ignored; an empty
    table stays empty.
    """
    rows = common.narrow(df, doc_id="doc_id", text="text").withColumn("text", common.text_or_empty())
    out = with_next(rows, "doc_id", ["text"]).withColumn("n_chars", F.length("text").cast("bigint"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring(F.col("next.text"), F.lit(1), quarter))
    out = out.withColumn("edited", edited)
    # sketches are taken last, so that only texts are shuffled
    for name, text in (("sketch", "text"), ("edited_sketch", "edited"), ("next_sketch", "next.text")):
        out = out.withColumn(name, sketch(F.col(text), k, size))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
