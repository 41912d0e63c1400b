"""The ``opN_*`` queries over the standard tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointweave.llm import bpe, common, html, minhash, mixing, pii, quality, sketch, substrings, tokens, toxicity


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.encode(common.table(spark, sf_dir, "documents"), with_ids=False)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mixture of its sources."""
    placed = mixing.mixed(common.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(common.table(spark, sf_dir, "pages"))


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that 100-byte strings repeat."""
    return substrings.repeated(common.table(spark, sf_dir, "documents")).drop("kept")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids as shards and read them back."""
    path = common.shared_dir(spark, "token-shards")
    tokens.write(common.table(spark, sf_dir, "documents"), path, added=True)
    return tokens.read(spark, path, with_ids=False)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.tag(common.table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a lexicon learned outside the held-out part."""
    documents = common.table(spark, sf_dir, "documents")
    model = toxicity.train(documents, common.table(spark, sf_dir, "labels"))
    rows = common.narrow(documents, doc_id="doc_id", text="text")
    return toxicity.score(rows, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a decision list learned from labelled ones."""
    documents = common.table(spark, sf_dir, "documents")
    rules = quality.train(documents, common.table(spark, sf_dir, "labels"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(documents, rules).select(*columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents: 3-word shingles, likeness 0.85 or more."""
    return minhash.components(common.table(spark, sf_dir, "documents"), size=3, percent=85)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, compared."""
    return sketch.compare_edited(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_mixing, op3_main_text, op4_repeated_substrings, op5_token_shards, op6_personal_data, op7_toxicity, op8_quality_rules, op9_near_duplicates, op10_fingerprints)}
#: All pairs that share a shingle and the closure of their links: for small tables only.
NEAR_DUPLICATES_SQL = r"""with recursive words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, list_distinct(case when len(w) = 0 then cast([] as varchar[])
        when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
    from words
), shingles as (
    select doc_id, len(s) as n, unnest(s) as shingle from sets
), links as (
    select a.doc_id as a, b.doc_id as b
    from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n
    having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached(doc_id, other) as (
    select doc_id, doc_id from documents
    union
    select r.doc_id, l.b from reached r join links l on r.other = l.a
)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.component_id, s.doc_id = r.component_id as kept
from sets s join (select doc_id, min(other) as component_id from reached group by doc_id) r on s.doc_id = r.doc_id
"""

#: Every string of 100 bytes in hexadecimal digits, cut from blocks of 512 starts: for small tables only.
REPEATED_SUBSTRINGS_SQL = r"""with texts as (
    select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents
), blocks as (
    select doc_id, n, first, substr(x, 2 * first + 1, 2 * (512 + 99)) as y
    from (select doc_id, x, n, unnest(range(0, n - 99, 512)) as first from texts where n >= 100)
), strings as (
    select doc_id, first + i as pos, substr(y, 2 * i + 1, 200) as s
    from (select doc_id, first, y, unnest(range(0, least(512, n - 99 - first))) as i from blocks)
), later as (
    select doc_id, pos, row_number() over (partition by s order by doc_id, pos) > 1 as again from strings
), repeats as (
    select doc_id, pos, lag(pos) over (partition by doc_id order by pos) as before from later where again
), numbered as (
    select doc_id, pos, sum(case when before is null or pos > before + 100 then 1 else 0 end) over (partition by doc_id order by pos) as run from repeats
), spans as (
    select doc_id, run, min(pos) as b, max(pos) + 100 as e from numbered group by doc_id, run
), gaps as (
    select doc_id, run, b, e, lag(e, 1, 0) over (partition by doc_id order by b) as since from spans
), pieces as (
    select g.doc_id, sum(e - b) as n_removed, count(*) as n_spans, max(e) as last,
        string_agg(substr(t.x, 2 * since + 1, 2 * (b - since)), '' order by b) as kept
    from gaps g join texts t on g.doc_id = t.doc_id group by g.doc_id
)
select t.doc_id, cast(t.n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
    sha256(unhex(coalesce(kept, '') || substr(t.x, 2 * coalesce(last, 0) + 1))) as kept_sha256
from texts t left join pieces p on t.doc_id = p.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op4_repeated_substrings": REPEATED_SUBSTRINGS_SQL, "op9_near_duplicates": NEAR_DUPLICATES_SQL}
