"""Best-fit packing of token sequences with certified bin counts.

Each partition packs its pieces by best-fit decreasing and certifies its number of bins with lower bounds from dual
feasible functions: any function u on lengths for which every feasible bin has a sum of at most 1 gives the bound
ceil(sum u). Where the number of bins meets the bound, the packing of that partition is optimal. Partitions with a gap
give up the pieces of their least filled bins (as many bins as the gap, and the same number again, at least two); these
pieces are exchanged between the partitions by dealing them out anew and best-fit decreasing runs on them again. Rounds
end when no partition has a gap or no bin was saved.

Defined results: a null or empty text is a document of one token, the end; only documents longer than a sequence are
cut; repeated rows and ids are packed as rows of their own; an empty table gives no sequences; other columns are not
looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _shared
from lodestar.llm.bpe import default_tokenizer, load

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs: a fixed amount of memory, whatever the input.
PART_PIECES = 60_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin. Ties: the longer piece first, then its place in the input."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []  # the free lengths that some open bin has, sorted
    open_bins: dict[int, list[int]] = {}
    fill: list[int] = []
    for k in order.tolist():
        size = int(lengths[k])
        at = bisect_left(room, size)
        if at < len(room):
            free = room[at]
            own = open_bins[free]
            b = own.pop()
            if not own:
                del open_bins[free], room[at]
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[k], offsets[k] = b, fill[b]
        fill[b] += size
        if left := free - size:
            if left not in open_bins:
                open_bins[left] = []
                insort(room, left)
            open_bins[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the dual-feasible-function bounds: the sum itself, the thresholds of Martello and Toth, and the
    rounding functions of Fekete and Schepers."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for e in np.unique(np.concatenate([sizes[2 * sizes <= capacity], capacity - sizes[2 * sizes > capacity]])).tolist():
        # lengths over capacity - e count as a whole bin, those under e as nothing
        u = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int((u * counts).sum()) // capacity))
    for k in range(1, 33):
        whole = (sizes * (k + 1)) % capacity == 0
        u = np.where(whole, sizes * k, (sizes * (k + 1)) // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((u * counts).sum()) // (k * capacity)))
    return best


def cut_documents(docs: DataFrame, path: str, parts: int, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenises and cuts: one row per piece, dealt evenly over `parts` numbers by its place in its input partition; with
    keep_ids also its ids and `_at`, a number of its own."""

    def run(batches):
        coder = load(path)
        end = np.array([END_ID], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        dealt, own_numbers = task * 7919, (task << 36) - task * 7919
        for batch in batches:
            for part, texts in _shared.slices(batch, text):
                keys = part.column(0)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for k, x in enumerate(texts.to_pylist()):
                    ids = coder.encode(x) + end
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        row.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            kept.append(own)
                at = np.arange(len(row)) + dealt
                part_no = at % parts
                dealt += len(row)
                out = [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(part_no, pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(at + own_numbers), pa.array(kept, pa.binary())] if keep_ids else [])], ["key", "piece", "start", "length", "ids_crc32", "part", *(["_at", "ids"] if keep_ids else [])])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, part long" + ", _at long, ids binary" * keep_ids
    return docs.select(key, text).mapInArrow(run, schema)


def pack_parts(pieces: DataFrame, capacity: int, round_no: int) -> DataFrame:
    """Best-fit decreasing in every part; `bound` and `bins` of its part, and whether its bin is given up, on each row."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        given = np.zeros(len(fill), bool)
        if gap := len(fill) - bound:
            given[np.argsort(fill, kind="stable")[: max(2, 2 * gap)]] = True
        part = table.column("part")[0].as_py()
        table = table.drop_columns([c for c in ("sequence_id", "offset", "bound", "bins", "given") if c in table.column_names])
        for name, x in (("sequence_id", (round_no << 48) + (part << 24) + bins), ("offset", offsets), ("bound", np.full(len(bins), bound)), ("bins", np.full(len(bins), len(fill))), ("given", given[bins])):
            table = table.append_column(name, pa.array(x))
        return table

    plain = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "bound", "bins", "given")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain), "sequence_id long, offset long, bound long, bins long, given boolean"])
    return pieces.groupBy("part").applyInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """Adds sequence_id, offset and the certificate: `certified`, whether the piece's bin is of a part, in its last round,
    that has no more bins than its lower bound. What a round gives up is a few bins of each part, so the pool shrinks
    with the number of parts and the last rounds run on one part. Each round but the last saves a bin, so they end."""
    now = _shared.materialize(pack_parts(pieces, capacity, 0), "packed")
    settled: list[DataFrame] = []
    for r in count(1):
        parts = now.select("part", "bound", "bins").distinct()
        totals = parts.agg(F.sum("bins").alias("bins"), F.sum("bound").alias("bound"), F.count(F.lit(1)).alias("parts")).first()
        given = now.where("given")
        if not totals.parts or totals.bins == totals.bound:
            break
        pool = given.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sequence_id").alias("bins"), F.sum("length").alias("total")).first()
        if -(-pool.total // capacity) >= pool.bins:
            break
        n = max(1, -(-pool.n // part_pieces))
        dealt = given.withColumn("part", F.pmod(F.xxhash64("part", "sequence_id", "offset", F.lit(r)), F.lit(n)))
        again = _shared.materialize(pack_parts(dealt, capacity, r), "repacked")
        after = again.agg(F.countDistinct("sequence_id")).first()[0]
        if after >= pool.bins:
            break
        settled.append(now.where("not given"))
        now = again
    for x in settled:
        now = now.unionByName(x)
    return now.withColumn("certified", F.col("bins") <= F.col("bound")).drop("part", "bound", "bins", "given")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, part_pieces: int = PART_PIECES, keep_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs whole documents; with keep_ids also each piece's ids, which are joined to the packed
    pieces at the end and so are in no task that packs."""
    n, size = _shared.input_bytes(docs, text)
    parts = max(1, -(-(n + size // (8 * capacity)) // part_pieces))
    pieces = _shared.materialize(cut_documents(docs, path, parts, key, text, capacity, keep_ids), "pieces")
    packed = pack(pieces.drop("ids"), capacity, part_pieces)
    if keep_ids:
        packed = packed.join(pieces.select("_at", "ids"), "_at").drop("_at")
    return packed.withColumnRenamed("key", key)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_shared.table(spark, sf_dir, "documents"), default_tokenizer())
