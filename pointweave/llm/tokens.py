"""Token ids of whole tables in shards of range-coded blocks (see :mod:`rans`).

Texts are encoded with the tokenizers library; distinct words are encoded once
per worker and looked up afterwards.  ``write`` deals the rows out by ranges of
``doc_id``, so that shards in the order of (part, shard) hold documents in
ascending order, and commits them through Spark's writer, which survives the
loss of executors.  ``read`` decodes shards wherever they lie.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointweave.llm import common, rans
from pointweave.llm.bpe import byte_characters
from pointweave.llm.pretokens import PretokenEncoder

TOKENIZER = "byte_bpe_50k.json"
#: Ids after which a shard is closed (the last document stays whole).
SHARD_IDS = 1_500_000
#: Bytes of text whose words are looked up together.
TEXT_BYTES = 1 << 23
SHARD = "part int, shard int, n_ids bigint, doc_ids array<bigint>, payload binary"


class LibraryBPE:
    """The tokenizers library's encoding of a byte-level BPE file, word by word through bounded caches.

    With ``added`` the file's added tokens are found first, as the library
    does, and what stands between them is encoded by itself; else they are
    text like any other.
    """

    def __init__(self, path: str, pattern: str, added: bool = False, most: int = 600_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary does not fit 16-bit ids")

        model, table = tokenizer.model, dict(enumerate(byte_characters()))
        space = table[32]

        def pretoken(s: str) -> bytes:  # the library's merges, without cutting and offsets once more
            plain = s.isascii() and s[0] == " " and s[1:].isalpha()  # letters stand for themselves
            ids = [t.id for t in model.tokenize(space + s[1:] if plain else s.encode().decode("latin-1").translate(table))]
            return struct.pack(f"<{len(ids)}H", *ids)

        self.texts = PretokenEncoder(pattern, pretoken, most)
        known = tokenizer.get_added_tokens_decoder() if added else {}
        self.added = {t.content: struct.pack("<H", i) for i, t in known.items()}
        if self.added and max(known) >= 1 << 16:
            raise ValueError("the added tokens do not fit 16-bit ids")
        if any(t.lstrip or t.rstrip or t.single_word for t in known.values()):
            raise ValueError("added tokens that take white space in or must be single words are not supported")
        # of those that begin at one place the longest, as in the library
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split

    def encode(self, text: str) -> np.ndarray:
        if not any(t in text for t in self.added):
            return np.frombuffer(self.texts.encode(text), "<u2")
        return np.frombuffer(b"".join(self.added.get(x) or self.texts.encode(x) for x in self.cut(text) if x), "<u2")

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """As ``encode``, of many texts at once; null as empty, and texts of over ``TEXT_BYTES`` by themselves, which takes less memory."""
        texts = texts.fill_null("")
        apart = {*np.flatnonzero(pc.binary_length(texts).to_numpy() > TEXT_BYTES).tolist()}
        for t in self.added:
            apart.update(pc.indices_nonzero(pc.match_substring(texts, t)).to_pylist())
        return self.texts.encode_all(texts, {i: self.encode(texts[i].as_py()).tobytes() for i in apart})


@functools.cache
def encoder(path: str, pattern: str, added: bool = False) -> LibraryBPE:
    return LibraryBPE(path, pattern, added)


def write(df: DataFrame, path: str, tokenizer: str | None = None, pattern: str | None = None, end: int = 2, partitions: int | None = None, added: bool = False) -> None:
    """Encode ``doc_id, text`` and write shards in ascending order of ``doc_id``.

    With ``added``, the tokenizer's added tokens in a text get their own ids,
    as the library gives them; else they are text like any other.  Each document's ids are followed by ``end``.  Null and empty texts have
    only that id; a null ``doc_id`` comes first; rows with equal ids stay
    together in the order of their texts; an empty table gives no shards.
    Other columns are ignored.
    """
    import public_tokenizers

    tokenizer, pattern = tokenizer or public_tokenizers.path(TOKENIZER), pattern or public_tokenizers.PATTERN
    rows = common.narrow(df, doc_id="doc_id", text="text")
    n = [partitions] if partitions else []
    rows = rows.repartitionByRange(*n, "doc_id").sortWithinPartitions("doc_id", "text")
    arrow = common.arrow_schema(df.sparkSession, SHARD)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = encoder(tokenizer, pattern, added), TaskContext.get().partitionId()
        tail = np.array([end], "<u2")
        names: list[int | None] = []
        docs: list[np.ndarray] = []
        size = shard = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "n_ids": size, "doc_ids": names, "payload": rans.encode(docs)}], arrow)

        for batch in batches:
            for at, n in common.slices(batch, batch.num_rows, TEXT_BYTES):
                own = batch.slice(at, n)
                for name, ids in zip(own.column("doc_id").to_pylist(), bpe.encode_all(own.column("text")), strict=True):
                    docs.append(np.concatenate([ids, tail]))
                    names.append(name)
                    size += len(docs[-1])
                    if size >= SHARD_IDS:
                        yield closed()
                        names, docs, size, shard = [], [], 0, shard + 1
        if names:
            yield closed()

    rows.mapInArrow(shards, SHARD).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode the shards under ``path``.

    Returns ``doc_id, start, n_tokens, ids_crc32, ids array<int>``, the last
    only ``with_ids``; ``start`` counts the ids of all documents before.  Only
    numbers of ids per part are summed in one place.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    kept = "part int, shard int, at bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    arrow = common.arrow_schema(spark, kept)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = rans.Shard(row["payload"]).documents()
                n = [len(d) for d in docs]
                out = {"part": [row["part"]] * len(n), "shard": [row["shard"]] * len(n), "at": np.cumsum([0, *n])[:-1], "doc_id": row["doc_ids"], "n_tokens": n, "ids_crc32": [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]}
                if with_ids:
                    out["ids"] = [d.astype(np.int32) for d in docs]
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)

    sizes = shards.select("part", "shard", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before.alias("part_start"))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("shard_start", inner).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    out = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(documents, kept).join(starts, ["part", "shard"])
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
