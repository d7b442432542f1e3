"""Helpers the operators share: reading tables, written intermediate copies, task code."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from palaver.session import shared_folder

# Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send the functions of a module with the tasks, so executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and go on from the copy: lineage ends, lost executors lose nothing."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of tables that are no longer used; in a loop they add up until the driver collects garbage by itself."""
    gc.collect()
    spark._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents no model may learn from; rows without an id are never learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def arrow_schema(spark_schema) -> pa.Schema:
    return to_arrow_schema(spark_schema)


def taken_names(docs: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names among ``columns`` that the table has; operators select what they use and drop the rest."""
    return [c for c in columns if c in docs.columns]


def spare(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def byte_slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes in a text column, one row at least."""
    texts = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return unused memory of a task's worker: the worker stays, and the next stage needs the memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed blocks
    if trim is not None:
        trim(0)
