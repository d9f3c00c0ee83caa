"""Two-pass external shuffle into shards of equal row counts, with DataFrame functions only.

Pass one scatters the rows uniformly, by a seeded hash, into buckets of a size that fits a task's memory; their number
follows from the table's rows and bytes. Pass two shuffles each bucket by Fisher-Yates (Spark's own shuffle of an
array, with a seed) over rows in a fixed order, one bucket after another within a partition. A row's place in the whole
order is its bucket's start (a running sum of bucket counts, by blocks of buckets) plus its place in the bucket; place p
goes to shard p mod n, slot p div n. So shard counts differ by one at most and slots have no gaps: the law `rows`.

Defined results: a null text has no bytes (size 16, checksum 0); repeated rows and equal texts are rows of their own,
so no group of copies gathers in one bucket; nulls in any column are kept; an empty table gives no rows; columns of the
input are carried, but for any called position, shard or slot, which the result's own replace.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import _shared

SHARDS = 40
BUCKET_BYTES = 64 << 20
BUCKET_ROWS = 10_000
#: Bucket starts are broadcast up to so many (two longs each, some 25 MB as a hash table) and joined by shuffle beyond.
BROADCAST_BUCKETS = 1 << 19


def scatter(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Pass one: (_bucket, _row). The row's place in its input partition is hashed too, so that repeated rows part."""
    own = [F.col(f"`{c}`") for c in rows.columns]
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *own), F.lit(buckets)).cast("int")
    return rows.select(bucket.alias("_bucket"), F.struct(*[c.alias(f"c{k}") for k, c in enumerate(own)]).alias("_row"))


def record_bytes(rows: DataFrame) -> Column:
    """The size of a whole record: its texts' and binaries' bytes, and 64 for the rest."""
    long = [f.name for f in rows.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    return sum((F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)).cast("long") for c in long), F.lit(64))


def bucket_starts(counts: DataFrame, buckets: int) -> DataFrame:
    """(_bucket, _start) from (_bucket, _n): the rows of all buckets before. Blocks of buckets are summed first, so that no
    task orders more than about the root of their number."""
    blocked = counts.withColumn("_block", F.floor(F.col("_bucket") / (math.isqrt(buckets) + 1)))
    blocks = blocked.groupBy("_block").agg(F.sum("_n").alias("_all"))
    before = blocks.select("_block", (F.sum("_all").over(Window.orderBy("_block")) - F.col("_all")).alias("_before"))
    own = F.sum("_n").over(Window.partitionBy("_block").orderBy("_bucket")) - F.col("_n")
    return blocked.join(before, "_block").select("_bucket", (own + F.col("_before")).alias("_start"))


def external_shuffle(rows: DataFrame, seed: int, row_bytes: Column | None = None, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds `position`: a uniformly random order of all rows. row_bytes: the size of a row, record_bytes where none is given."""
    columns = rows.columns
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(record_bytes(rows) if row_bytes is None else row_bytes).alias("b")).first()
    buckets = max(1, -(-size.n // bucket_rows), -(-(size.b or 0) // bucket_bytes))
    # a task gathers all of its buckets before it writes one: the bucket's number is the partition's, so each has one
    whole = scatter(rows, buckets, seed).repartitionById(buckets, F.col("_bucket")).groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    # rows and buckets in a fixed order before the seeded shuffle: a task that runs again gives the same result
    whole = whole.withColumn("_rows", F.sort_array("_rows")).sortWithinPartitions("_bucket")
    # written row by row: a file of whole buckets would be read with all of a bucket's records at once
    mixed = _shared.materialize(whole.select("_bucket", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_k", "_row")), "buckets")
    counts = mixed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    starts = bucket_starts(counts, buckets).hint("broadcast" if buckets <= BROADCAST_BUCKETS else "shuffle_hash")
    out = mixed.join(starts, "_bucket")
    return out.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(columns)], (F.col("_start") + F.col("_k")).alias("position"))


def shard_rows(rows: DataFrame, shards: int, seed: int = 11, row_bytes: Column | None = None, **sizes) -> DataFrame:
    """Rows in `shards` shards of equal counts (one apart at most), in a random order within and between them."""
    rows = rows.drop("position", "shard", "slot")
    mixed = external_shuffle(rows, seed, row_bytes, **sizes)
    place = F.col("position")
    return mixed.select(*[F.col(f"`{c}`") for c in rows.columns], (place % shards).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 11, row_bytes: Column | None = None) -> None:
    """Writes whole records, one folder a shard, in the shuffled order."""
    shard_rows(rows, shards, seed, row_bytes).repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records, all columns of documents, are shuffled and sharded; size and checksum are those of the sharded text."""
    docs = _shared.table(spark, sf_dir, "documents")
    out = shard_rows(docs, SHARDS, row_bytes=record_bytes(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
