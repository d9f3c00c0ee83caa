"""Vector file formats: fvecs, ivecs, bvecs, headerless matrices, big-ann binaries, npy and delimited text.

Whole files are read by `binaryFile` and decoded by Arrow batches on the executors; rows are numbered by their place in
the file. Writers put one file for each partition, so the result is a folder; a single file is one partition's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int"), "bvecs": ("u1", "smallint")}


def decode_vecs(raw: bytes, kind: str) -> np.ndarray:
    """Rows of <int32 dimension><payload>; the dimension must be the same in all."""
    item = np.dtype(_KINDS[kind][0])
    if not raw:
        return np.empty((0, 0), item)
    d = int(np.frombuffer(raw[:4], "<i4")[0])
    width = 4 + d * item.itemsize
    if d <= 0 or len(raw) % width:
        raise ValueError(f"a {kind} file of {len(raw)} bytes can't hold rows of dimension {d}")
    table = np.frombuffer(raw, np.uint8).reshape(-1, width)
    if (np.ascontiguousarray(table[:, :4]).view("<i4") != d).any():
        raise ValueError("rows of different dimensions")
    return np.ascontiguousarray(table[:, 4:]).view(item)


def encode_vecs(rows: np.ndarray, kind: str) -> bytes:
    item = np.dtype(_KINDS[kind][0])
    rows = np.ascontiguousarray(rows, item)
    out = np.empty((len(rows), 4 + rows.shape[1] * item.itemsize), np.uint8)
    out[:, :4] = np.frombuffer(np.int32(rows.shape[1]).tobytes(), np.uint8)
    out[:, 4:] = rows.view(np.uint8).reshape(len(rows), -1)
    return out.tobytes()


def _read(spark: SparkSession, path: str, decode: Callable[[bytes], np.ndarray], element: str) -> DataFrame:
    kind = {"float": pa.float32(), "double": pa.float64(), "int": pa.int32(), "smallint": pa.int16()}[element]

    def run(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = decode(raw.as_py())
                for a in range(0, len(m), 8192):
                    part = m[a : a + 8192]
                    flat = pa.array(part.reshape(-1)).cast(kind)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * m.shape[1]), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), lists], ["file", "id", "v"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, id long, v array<{element}>")


def read_vecs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(file, id, v) of fvecs, ivecs or bvecs files, the kind by extension unless given."""
    kind = kind or path.rstrip("/*").rpartition(".")[2]
    if kind not in _KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(_KINDS)}")
    return _read(spark, path, lambda raw: decode_vecs(raw, kind), _KINDS[kind][1])


def read_matrix(spark: SparkSession, path: str, dimension: int, dtype: str = "<f4") -> DataFrame:
    """Headerless rows of one dimension."""
    return _read(spark, path, lambda raw: np.frombuffer(raw, dtype).reshape(-1, dimension), "float")


def read_big_ann(spark: SparkSession, path: str, dtype: str = "<f4") -> DataFrame:
    """<uint32 rows><uint32 dimension> and the rows."""

    def decode(raw: bytes) -> np.ndarray:
        n, d = np.frombuffer(raw[:8], "<u4").tolist()
        return np.frombuffer(raw[8:], dtype, n * d).reshape(n, d)

    return _read(spark, path, decode, "float")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    def decode(raw: bytes) -> np.ndarray:
        import io

        return np.load(io.BytesIO(raw), allow_pickle=False)

    return _read(spark, path, decode, "float")


def read_delimited(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """One vector a line; blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.split(F.trim("value"), separator).cast("array<float>").alias("v"))


def write_vecs(df: DataFrame, folder: str, kind: str = "fvecs", order: str = "id", vec: str = "v") -> int:
    """A file for each partition of a folder that all machines share, in the order of a column; returns the rows written.
    Attempts write under names of their own and rename at the end."""
    import os
    import uuid

    def run(batches):
        from pyspark import TaskContext

        n, at = 0, TaskContext.get().partitionId()
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{at}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for batch in batches:
                if batch.num_rows:
                    rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    f.write(encode_vecs(rows, kind))
                    n += batch.num_rows
        os.replace(part, f"{folder}/part-{at:05}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return df.sortWithinPartitions(order).select(vec).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def scrape_logs(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(file, and a double for each named pattern's first group): whole logs, missing values null."""
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return logs.select("file", *[F.expr(f"try_cast(nullif(regexp_extract(value, '{p}', 1), '') AS DOUBLE)").alias(k) for k, p in patterns.items()])
