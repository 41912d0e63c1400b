"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole standard table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Only where that is
    unset (single-machine runs and tests) a folder under the warehouse serves;
    a cluster must set it, unless its warehouse lies in a shared store.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    This cuts the lineage: when an executor is lost, later stages read the
    written files again instead of recomputing what came before.
    """
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed to the keywords.

    Operators begin with this, so that other columns of the input, whatever
    their names, can't clash with the names an operator uses inside.
    """
    return df.select(*[df[c].alias(k) for k, c in columns.items()])


def text_or_empty(c: str = "text"):
    """Column ``c`` with null as the empty string."""
    return F.coalesce(F.col(c), F.lit(""))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], dict[str, list]], schema: str, rows: int = 256) -> DataFrame:
    """``df`` through ``f``, a slice of at most ``rows`` rows and ``SLICE_BYTES`` of ``text`` at a time.

    ``f`` gets an Arrow batch and returns columns for ``schema``; small slices
    bound a Python worker's memory where texts are long.  A longer text is a
    slice of its own.
    """
    spark = df.sparkSession
    arrow = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch, rows):
                out = f(batch.slice(at, n))
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: How to empty each operator's caches in a Python worker, and the operator that has the worker now.
_CACHES: dict[str, Callable[[], object]] = {}
_TURN = [""]


def keeps(operator: str, empty: Callable[[], object]) -> None:
    """``operator`` has caches in a worker that ``empty`` gives up."""
    _CACHES[operator] = empty


def turn(operator: str) -> None:
    """This worker now serves ``operator``; what others have cached is given back to the system.

    Spark hands the same workers from stage to stage, so without this each
    would end up with the caches of every stage before.
    """
    if _TURN[0] == operator:
        return
    _TURN[0] = operator
    for other, empty in _CACHES.items():
        if other != operator:
            empty()
    gc.collect()  # an encoder and its caches hold each other
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of text in a slice.
SLICE_BYTES = 1 << 21


def slices(batch: pa.RecordBatch, rows: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Starts and lengths of a batch's slices."""
    ends = np.zeros(batch.num_rows, np.int64)
    if "text" in batch.schema.names:
        ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, side="right"))))
        yield at, stop - at
        at = stop


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))
