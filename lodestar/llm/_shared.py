"""Helpers that the corpus operators share: reading tables, cutting lineage, sorted arrays in the shared folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Arrow batches end at so many bytes, not only at a number of rows: rows may be very long.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: A written step's shuffle files go as soon as it is written.
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_C = ctypes.CDLL(None)


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes for the session, unless it has a bound of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it; a folder of our own only where none is named (tests)."""
    named = spark.conf.get(SETTING, None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="lodestar-shared-")
        spark.conf.set(SETTING, named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestar/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Writes df into the shared folder and reads it again: cuts the lineage, and lost executors cost no recomputation.
    The shuffle files of the step are given up with it. keep: open scopes of scratch() leave the table."""
    path = written(df, tag)
    for made in () if keep else _MADE:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> str:
    """The path of a table of its own in the shared folder; for tables that discard() takes away before a scope ends."""
    spark = df.sparkSession
    bounded(spark)
    path = shared_path(spark, tag)
    with cleaned(spark):
        df.write.parquet(path)
    return path


#: Paths of the tables that scopes of scratch() have made so far, one list for each open scope.
_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are made within are taken away at the end; what is needed later is made outside."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        for path in made:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleaned(spark: SparkSession):
    """What runs within gives up its shuffle files when it has ended."""
    was = spark.conf.get(CLEAN_SETTING, None)
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_SETTING) if was is None else spark.conf.set(CLEAN_SETTING, was)


def local_path(uri: str) -> str:
    """The path under which workers see a shared folder; it must be mounted on every machine."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"{SETTING} must be a mounted folder (file:// or a plain path) for memory-mapped arrays, not {uri}")
    return at.path if at.scheme else uri


def wrapped(docs: DataFrame, **named) -> DataFrame:
    """The whole row as `_row`, with the named columns: whatever the row's own columns are called, none clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(k) for k, c in named.items()])


def unwrapped(docs: DataFrame, columns: list[str], **new) -> DataFrame:
    """The row's columns, some of them replaced."""
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in columns])


def input_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column; a partial aggregate with one row to the driver."""
    bounded(docs.sparkSession)
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column).cast("long")).alias("b")).first()
    return row.n, row.b or 0


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    """Writes under another name and renames, so that repeated or speculative attempts of a task leave one whole file."""
    os.makedirs(folder, exist_ok=True)
    attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
    part = f"{folder}/.{name}.{attempt}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.ascontiguousarray(array).data)
    os.replace(part, f"{folder}/{name}")


def map_array(folder: str, name: str, dtype) -> np.ndarray:
    """A memory-mapped array, empty where no task wrote one."""
    path = f"{folder}/{name}"
    if not os.path.exists(path) or not os.path.getsize(path):
        return np.empty(0, dtype)
    return np.memmap(path, dtype=dtype, mode="r")


def texts_of(column: pa.Array) -> pa.Array:
    """A string column with nulls as empty texts, in one piece."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def buffers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column without nulls, and the offsets of its rows in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20, rows: int = 1 << 30):
    """Cuts a batch into runs of at most so many rows and bytes of a column; a longer row is a run of its own."""
    texts = texts_of(batch.column(batch.schema.get_field_index(column)))
    _, offsets = buffers_of(texts)
    k, n = 0, len(texts)
    while k < n:
        end = min(k + rows, max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1))
        yield batch.slice(k, end - k), texts.slice(k, end - k)
        k = end
    trim()


def trim() -> None:
    """Gives memory that is free back to the system; workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def long_column(batch: pa.RecordBatch, name: str, null: int) -> np.ndarray:
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.int64()), null).to_numpy(zero_copy_only=False)
