"""Index maintenance: adding, removing, updating, merging, list algebra, and sliding windows, in batch and on streams.

Every operation is a relational one on the index table (id, v, ...), so it applies to Parquet tables as they are; the
streaming forms run the same code on each micro-batch.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df, written into the folder that spark.checkpoint.dir names and read again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/lodestar/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def add(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Appends rows without ids: numbers follow the largest id. One number to the driver; rows are numbered by partition
    counts, without a global sort."""
    start = index.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1
    # numbers of partitions hold for one run of the plan only, so they are written
    placed = written(rows.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    sizes = {r["_p"]: r["count"] for r in placed.groupBy("_p").count().collect()}  # one row for each partition
    offsets, at = {}, start
    for p in sorted(sizes):
        offsets[p], at = at, at + sizes[p]
    if not offsets:
        return index
    table = F.create_map(*[F.lit(x).cast("long") for p in offsets for x in (p, offsets[p])])
    numbered = placed.withColumn("id", F.element_at(table, F.col("_p").cast("long")) + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    return index.unionByName(numbered.drop("_p", "_m"), allowMissingColumns=True)


def remove(index: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    return index.join(ids.select(*keys).distinct(), list(keys), "left_anti")


def update(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of known ids replace them; others are left out."""
    known = rows.join(index.select("id"), "id", "left_semi")
    return remove(index, known).unionByName(known, allowMissingColumns=True)


def upsert(index: DataFrame, rows: DataFrame, deleted: DataFrame | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows replace those of the same keys and are added where there are none; then `deleted` keys go."""
    out = remove(index, rows, keys).unionByName(rows, allowMissingColumns=True)
    return out if deleted is None else remove(out, deleted, keys)


def merge_from(index: DataFrame, other: DataFrame, add_id: int = 0) -> DataFrame:
    if index.columns != other.columns:
        raise ValueError(f"indexes have different columns: {index.columns} and {other.columns}")
    return index.unionByName(other.withColumn("id", F.col("id") + add_id))


def copy_subset(index: DataFrame, modulus: int, rest: int) -> DataFrame:
    return index.where(F.pmod("id", F.lit(modulus)) == rest)


def without_stop_lists(lists: DataFrame, most: int) -> DataFrame:
    """Posting lists of at most `most` entries."""
    large = lists.groupBy("list_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("list_no")
    return lists.join(large, "list_no", "left_anti")


def masked_lists(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each list from the first table where it has it, else from the second."""
    return first.unionByName(second.join(first.select("list_no").distinct(), "list_no", "left_anti"))


def stacked_lists(*tables: DataFrame, n_lists: int) -> DataFrame:
    """Lists one table after another: numbers of the k-th table are raised by k * n_lists."""
    out = tables[0]
    for k, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("list_no", F.col("list_no") + k * n_lists))
    return out


def sliding_window(rows: DataFrame, step: int, width: int, slice_column: str = "slice") -> DataFrame:
    """The index after a step: the newest `width` slices."""
    return rows.where(F.col(slice_column).between(step - width + 1, step))


def windowed_counts(events: DataFrame, time: str, key: str, size: str = "1 hour", slide: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sliding event-time windows; on a stream rows later than `late` are dropped by the watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size, slide), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def maintain(stream: DataFrame, path: str, checkpoint: str, apply: Callable[[DataFrame, DataFrame], DataFrame] = upsert, empty: DataFrame | None = None):
    """Applies micro-batches to a versioned index table: batch n reads version n - 1 and writes version n, so a batch
    that runs again writes the same version. Returns the query, to be started with a trigger of choice."""
    spark = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        index = spark.read.parquet(f"{path}/version={n - 1}") if n else (empty if empty is not None else batch.limit(0))
        apply(index, batch).write.mode("overwrite").parquet(f"{path}/version={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
