"""Exact repeats of 50 bytes and more, found by a logarithmic family of suffix arrays.

The suffixes of all documents are dealt out so that equal 50-byte strings meet: each 50-byte window belongs to the least
hash of the 24-byte strings in it, and runs of windows with the same one travel together as one segment. Windows whose
least hash occurs in a single document cannot repeat; the repeated ones are found first (sorted arrays in the shared
folder, memory-mapped), so only segments that may repeat are moved. Within a task equal segments are moved once, for the
least document; the others are known repeats. Hashes that very many rows hold are hot: their windows are dealt out one by
one, by their own hashes, so that a common line gathers in no shard.

In each shard documents come in order of doc_id, batch by batch. A batch gets its suffix array, the places of its
distinct windows in the order of their bytes; it is merge-scanned, block by block, against the levels of the family, and
becomes a level itself; levels of equal size merge by the places of the scan, so sizes grow geometrically and a suffix is
merged log n times. A match of more than 50 bytes is a run of windows that match, so a suffix's order is settled by its
first 50 bytes and a level holds places, not strings.

`index_batch` keeps the family: levels are files in the shared folder, a manifest for each shard and batch names those
that count, and a new batch of documents is scanned against all batches before it without reading their texts again.

Defined results: null texts are empty; a byte is removed if it lies in a 50-byte string that also starts in a document
with a smaller doc_id; rows with the same doc_id are no repeats of each other; null doc_ids come last; empty texts,
and texts under 50 bytes, have no repeats; an empty table gives no rows; other columns are carried or not looked at. Rows
are told apart by doc_id and the 64-bit xxHash of their text.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _shared
from lodestar.llm._kernels import BASE, BYTES, U, mix, span_hashes
from lodestar.llm.bagminhash import node_of, order_of

LENGTH, PROBE = 50, 24
#: Text for each shard (a task's memory holds some ten times that), text that is hashed at once (some 100 bytes of memory
#: a byte), windows of a batch and of a block of a merge-scan, what a map task gathers before it sends, windows of a
#: segment, and the rows from which on a hash is hot.
SHARD_BYTES = 4 << 20
SLICE = 1 << 18
BATCH, BLOCK = 1 << 18, 1 << 16
GATHER_RUNS, GATHER_BYTES = 600_000, 12 << 20
SEGMENT = 1 << 14
HOT_ROWS = 2000
#: Mapped probe arrays that a worker holds at once.
MAPS = 1024
RECORD = np.dtype([("own", "i8"), ("node", "i8"), ("start", "u4"), ("length", "u4")])


def window_probes(data: np.ndarray) -> np.ndarray:
    """The least hash of the PROBE-byte strings in each LENGTH-byte window."""
    if len(data) < LENGTH:
        return np.empty(0, np.uint64)
    h, base, width, powers_of = BYTES[data], BASE, 1, {}
    while width <= PROBE:
        powers_of[width] = (h, base)
        h, base, width = h[:-width] * U(base) + h[width:], base * base % (1 << 64), 2 * width
    h, width = None, 0
    for w in sorted((w for w in powers_of if PROBE & w), reverse=True):
        own, power = powers_of[w]
        n = len(data) - width - w + 1
        h = own[:n] if h is None else h[:n] * U(power) + own[width : width + n]
        width += w
    h = (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    least, span, need = h, 1, LENGTH - PROBE + 1
    while 2 * span <= need:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = need - span
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def window_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows within a row that share a probe, at most SEGMENT long: probe (even), row, first and last window."""
    least = window_probes(data)
    n = len(least)
    edge = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long + 1] - LENGTH + 1, -1)
    valid = np.cumsum(edge)[:n] > 0
    same = np.zeros(n + 1, bool)
    same[1:n] = (least[1:] == least[:-1]) & valid[1:] & valid[:-1]
    first, last = np.flatnonzero(valid & ~same[:n]), np.flatnonzero(valid & ~same[1:])
    pieces = (last - first) // SEGMENT + 1
    if (pieces > 1).any():
        ends = np.cumsum(pieces)
        k = np.arange(ends[-1]) - np.repeat(ends - pieces, pieces)
        first, last = np.repeat(first, pieces) + k * SEGMENT, np.repeat(last, pieces)
        last = np.minimum(last, first + SEGMENT - 1)
    return least[first] & ~U(1), np.searchsorted(offsets, first, "right") - 1, first, last


def shard_of(probe: np.ndarray, shards: int) -> np.ndarray:
    return (mix(probe) % U(shards)).astype(np.int64)


def short(probe: np.ndarray) -> np.ndarray:
    """39 bits of a probe (even), enough to tell the probes of a shard apart; a mix-up only moves a segment too many."""
    return (mix(probe) >> U(24)) & ~U(1)


def pack40(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def by_shard(shard: np.ndarray):
    order = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(at, np.append(at[1:], len(order))):
        yield int(shard[order[a]]), order[a:b]


def repeated_probes(docs: DataFrame, shards: int, folder: str) -> None:
    """Writes, for each shard, the sorted probes that occur in two documents or more; the last bit marks hot ones."""

    def gather(batches):
        runs, rows, n, base = [], [], 0, 0

        def flush():
            probe, row = np.concatenate(runs), np.concatenate(rows)
            order = np.argsort(probe, kind="stable")
            probe, row = probe[order], row[order]
            del order
            first = np.flatnonzero(np.diff(probe, prepend=probe[0] + U(2)))
            ends = np.append(first[1:], len(row))
            keys = short(probe[first]) | (row[first] != row[ends - 1]).astype(np.uint64)
            seen = np.minimum(ends - first, 65535).astype("<u2")
            found = [(k, pack40(keys[own]), seen[own].tobytes()) for k, own in by_shard(shard_of(probe[first], shards))]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), *(pa.array([x[c] for x in found], pa.binary()) for c in (1, 2))], ["shard", "keys", "seen"])

        for batch in batches:
            for _, texts in _shared.slices(batch, "text", SLICE):
                probe, row, _, _ = window_runs(*_shared.buffers_of(texts))
                runs.append(probe)
                rows.append((row + base).astype(np.uint32))
                n, base = n + len(probe), base + len(texts)
                if n >= GATHER_RUNS:
                    yield flush()
                    runs, rows, n, base = [], [], 0, 0
                    _shared.trim()
        if n:
            yield flush()

    def reduce(table: pa.Table) -> pa.Table:
        keys = unpack40(b"".join(x.as_py() for x in table.column("keys")))
        seen = np.frombuffer(b"".join(x.as_py() for x in table.column("seen")), "<u2")
        order = np.argsort(keys, kind="stable")
        keys, seen = keys[order], seen[order]
        probe = keys & ~U(1)
        first = np.flatnonzero(np.diff(probe, prepend=probe[0] + U(2)))
        ends = np.append(first[1:], len(probe))
        hot = (np.add.reduceat(seen.astype(np.int64), first) >= HOT_ROWS).astype(np.uint64)
        found = (probe[first] | hot)[(ends - first > 1) | (keys[ends - 1] & U(1) > 0)]
        _shared.write_array(folder, f"probes-{table.column('shard')[0].as_py()}", found)
        _shared.trim()
        return pa.table({"n": pa.array([len(found)], pa.int64())})

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(gather, "shard long, keys binary, seen binary")
    with _shared.cleaned(docs.sparkSession):
        rows.repartition(shards, "shard").groupBy("shard").applyInArrow(reduce, "n long").agg(F.sum("n")).first()


class Level:
    """A suffix array: the places in `data` of distinct windows, in the order of their bytes."""

    def __init__(self, data: np.ndarray, places: np.ndarray, name: str | None = None):
        self.data, self.places, self.name = data, places, name

    def __len__(self) -> int:
        return len(self.places)

    def keys(self, a: int, b: int) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)
        return np.ascontiguousarray(windows[self.places[a:b]]).view(f"S{LENGTH}").ravel()

    def scan(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge-scan with sorted windows: which of them the level holds, and before which of its places each belongs."""
        hit, at, a = np.zeros(len(keys), bool), np.full(len(keys), len(self), np.int64), 0
        for start in range(0, len(self), BLOCK):
            end = min(start + BLOCK, len(self))
            b = len(keys) if end == len(self) else int(np.searchsorted(keys, self.keys(end - 1, end)[0], "right"))
            if a < b:
                block = self.keys(start, end)
                where = np.searchsorted(block, keys[a:b])
                hit[a:b] = (block[np.minimum(where, len(block) - 1)] == keys[a:b]) & (where < len(block))
                at[a:b] = start + where
                a = b
        return hit, at

    def merged(self, other: Level) -> Level:
        """Both levels as one; no window is in both."""
        at = np.concatenate([self.scan(other.keys(k, k + BLOCK))[1] for k in range(0, len(other), BLOCK)])
        if self.data is other.data:
            return Level(self.data, np.insert(self.places, at, other.places))
        return Level(np.concatenate([self.data, other.data]), np.insert(self.places, at, other.places + len(self.data)))


class SuffixFamily:
    """Levels, each at least twice as large as the next; all from documents before those scanned."""

    def __init__(self, levels: list[Level] | None = None):
        self.levels = levels or []

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted windows some level holds."""
        hit = np.zeros(len(keys), bool)
        for level in self.levels:
            hit |= level.scan(keys)[0]
        return hit

    def add(self, level: Level) -> None:
        """Adds a level of windows that no level holds; levels of about its size merge with it."""
        while self.levels and len(level) and len(self.levels[-1]) < 2 * len(level):
            level = self.levels.pop().merged(level)
        if len(level):
            self.levels.append(level)

    def whole(self) -> Level | None:
        """All levels as one."""
        while len(self.levels) > 1:
            small = self.levels.pop()
            self.levels.append(self.levels.pop().merged(small))
        return self.levels[0] if self.levels else None

    @classmethod
    def load(cls, folder: str, shard: int, before: int) -> SuffixFamily:
        """The family as the last batch before the given one left it, mapped."""
        for batch in range(before - 1, -1, -1):
            path = f"{folder}/manifest-{shard}-{batch}"
            if os.path.exists(path):
                with open(path) as f:
                    names = json.load(f)
                return cls([Level(_shared.map_array(folder, f"{x}-data", np.uint8), _shared.map_array(folder, f"{x}-places", np.int64), x) for x in names])
        return cls()

    def save(self, folder: str, shard: int, batch: int) -> None:
        """Writes the levels that are new, then the manifest; a task that runs again writes the same."""
        for k, level in enumerate(self.levels):
            if level.name is None:
                level.name = f"level-{shard}-{batch}-{k}"
                _shared.write_array(folder, f"{level.name}-data", level.data)
                _shared.write_array(folder, f"{level.name}-places", level.places.astype(np.int64))
        _shared.write_array(folder, f"manifest-{shard}-{batch}", np.frombuffer(json.dumps([x.name for x in self.levels]).encode(), np.uint8))


def repeats_in_order(records: np.ndarray, data: np.ndarray, batch: int = BATCH, before: SuffixFamily | None = None) -> np.ndarray:
    """Which windows of the segments (records in data, one after another) also start in a document with a smaller `own`,
    or in one of the family before. Returns a flag for each window, in the order of records and windows; the family
    before gets what is new as one level."""
    counts = records["length"].astype(np.int64) - (LENGTH - 1)
    places = np.cumsum(records["length"].astype(np.int64)) - records["length"]
    slots = np.cumsum(counts) - counts
    flags = np.zeros(int(counts.sum()), bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH) if len(data) >= LENGTH else None
    order = np.argsort(records["own"], kind="stable")
    own, cost = records["own"][order], np.cumsum(counts[order])
    family, a = SuffixFamily(), 0
    earlier = before or SuffixFamily()
    while a < len(order):
        b = int(np.searchsorted(cost, (cost[a - 1] if a else 0) + batch, "right"))
        b = int(np.searchsorted(own, own[max(a, b - 1)], "right"))  # a document's segments stay together
        part = order[a:b]
        step = np.arange(int(counts[part].sum())) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part])
        at = np.repeat(places[part], counts[part]) + step
        keys = np.ascontiguousarray(windows[at]).view(f"S{LENGTH}").ravel()
        whose = np.repeat(own[a:b], counts[part])
        suffixes = np.argsort(keys, kind="stable")
        keys, whose, at = keys[suffixes], whose[suffixes], at[suffixes]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        keys = keys[first]
        known = family.scan(keys) | earlier.scan(keys)
        hit = known[group] | (whose > whose[first][group])
        flags[(np.repeat(slots[part], counts[part]) + step)[suffixes]] = hit
        family.add(Level(data, at[first][~known]))
        a = b
    if before is not None and (new := family.whole()) is not None:
        before.add(new)
    return flags


def repeat_runs(docs: DataFrame, folder: str, shards: int, filtered: bool = True, batch_no: int | None = None) -> DataFrame:
    """(own, node, start, stop): stretches of bytes that repeat an earlier document; they may overlap. Filtered: segments
    whose probe no other document has are not moved. With a batch number, documents of earlier batches in the folder
    count as earlier ones, and the batch's windows are added to its families."""

    def gather(batches):
        probes: dict[int, np.ndarray] = {}
        parts: list[tuple] = []

        def lookup(probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which probes repeat, and which of them are hot."""
            found, hot = np.zeros(len(probe), bool), np.zeros(len(probe), bool)
            for k, own in by_shard(shard_of(probe, shards)):
                if k not in probes:
                    if len(probes) >= MAPS:
                        probes.clear()
                    probes[k] = _shared.map_array(folder, f"probes-{k}", np.uint64)
                if len(probes[k]):
                    keys = short(probe[own])
                    have = probes[k][np.minimum(np.searchsorted(probes[k], keys), len(probes[k]) - 1)]
                    found[own] = have & ~U(1) == keys
                    hot[own] = found[own] & (have & U(1) > 0)
            return found, hot

        def flush():
            probe, finger, records = (np.concatenate([p[k] for p in parts]) for k in range(3))
            body = b"".join(p[3] for p in parts)
            places = np.cumsum(records["length"].astype(np.int64)) - records["length"]
            order = np.lexsort((records["start"], records["node"], records["own"], records["length"], finger, probe))
            p, f, r = probe[order], finger[order], records[order]
            new = np.ones(len(p), bool)
            new[1:] = (p[1:] != p[:-1]) | (f[1:] != f[:-1]) | (r["length"][1:] != r["length"][:-1])
            least = r["own"][np.flatnonzero(new)[np.cumsum(new) - 1]]
            twin = np.zeros(len(p), bool)
            twin[1:] = r[1:] == r[:-1]
            twin &= ~new
            sent, known = order[(r["own"] == least) & ~twin], order[(r["own"] > least) & ~twin]
            rows = []
            for k, own in by_shard(shard_of(probe[sent], shards)):
                at = sent[own]
                rows.append((k, records[at].tobytes(), b"".join([body[places[x] : places[x] + records["length"][x]] for x in at.tolist()])))
            if len(known):
                rows.append((int(known[0]) % shards, records[known].tobytes(), None))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())], ["shard", "records", "data"])

        held = 0
        for batch in batches:
            for part, texts in _shared.slices(batch, "text", SLICE):
                data, offsets = _shared.buffers_of(texts)
                probe, row, first, last = window_runs(data, offsets)
                if filtered:
                    found, hot = lookup(probe)
                    if not found.any():
                        continue
                    probe, row, first, last, hot = probe[found], row[found], first[found], last[found], hot[found]
                    if hot.any():  # a hot probe's windows go by themselves, each by its own hash
                        n = np.where(hot, last - first + 1, 1)
                        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        probe, row, hot, first, last = (np.repeat(x, n) for x in (probe, row, hot, first, last))
                        first = first + np.where(hot, k, 0)
                        last = np.where(hot, first, last)
                        probe = np.where(hot, span_hashes(data, first, first + LENGTH) & ~U(1), probe)
                stop = last + LENGTH
                records = np.empty(len(row), RECORD)
                records["own"], records["node"] = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
                records["start"], records["length"] = first - offsets[row], stop - first
                raw = data.tobytes()
                parts.append((probe, span_hashes(data, first, stop), records, b"".join([raw[x:y] for x, y in zip(first.tolist(), stop.tolist())])))
                held += len(parts[-1][3])
                if held >= GATHER_BYTES:
                    yield flush()
                    parts, held = [], 0
                    _shared.trim()
        if parts:
            yield flush()

    def reduce(table: pa.Table) -> pa.Table:
        sent = [(r.as_py(), d.as_py()) for r, d in zip(table.column("records"), table.column("data"))]
        known = np.frombuffer(b"".join(r for r, d in sent if d is None), RECORD)
        records = np.frombuffer(b"".join(r for r, d in sent if d is not None), RECORD)
        data = np.frombuffer(b"".join(d for _, d in sent if d is not None), np.uint8)
        del sent
        before = None if batch_no is None else SuffixFamily.load(folder, shard := table.column("shard")[0].as_py(), batch_no)
        flags = repeats_in_order(records, data, before=before)
        if before is not None:
            before.save(folder, shard, batch_no)
        counts = records["length"].astype(np.int64) - (LENGTH - 1)
        whose = np.repeat(np.arange(len(records)), counts)
        step = np.arange(len(flags)) - np.repeat(np.cumsum(counts) - counts, counts)
        cut = np.ones(len(flags) + 1, bool)
        cut[1:-1] = whose[1:] != whose[:-1]
        before, after = np.concatenate([[False], flags[:-1]]), np.concatenate([flags[1:], [False]])
        first, last = np.flatnonzero(flags & (cut[:-1] | ~before)), np.flatnonzero(flags & (cut[1:] | ~after))
        r = records[whose[first]]
        out = [np.concatenate([known["own"], r["own"]]), np.concatenate([known["node"], r["node"]])]
        start = np.concatenate([known["start"].astype(np.int64), r["start"] + step[first]])
        stop = np.concatenate([known["start"].astype(np.int64) + known["length"], r["start"] + step[last] + LENGTH])
        _shared.trim()
        return pa.table({"own": out[0], "node": out[1], "start": start, "stop": stop})

    rows = docs.select(order_of(F.col("doc_id")).alias("own"), node_of(F.col("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.mapInArrow(gather, "shard long, records binary, data binary")
    return rows.repartition(shards, "shard").groupBy("shard").applyInArrow(reduce, "own long, node long, start long, stop long")


def union_of(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that the given ones cover together; stretches that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def repeat_spans(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(own, node, runs): the stretches of each document that repeats something."""
    spark = docs.sparkSession
    _, size = _shared.input_bytes(docs)
    shards = max(1, -(-size // shard_bytes))
    uri = _shared.shared_path(spark, "probes")
    folder = _shared.local_path(uri)
    repeated_probes(docs, shards, folder)
    runs = _shared.materialize(repeat_runs(docs, folder, shards), "runs")
    _shared.discard(spark, uri)
    return runs.groupBy("own", "node").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))


def new_index(spark: SparkSession, expected_bytes: int, shard_bytes: int = SHARD_BYTES) -> dict:
    """An empty index for about so many bytes of text; its number of shards stays."""
    return {"folder": _shared.local_path(_shared.shared_path(spark, "suffixes")), "shards": max(1, -(-expected_bytes // shard_bytes)), "batches": 0}


def index_batch(docs: DataFrame, index: dict) -> DataFrame:
    """(own, node, runs) of a new batch of documents, against all batches before and within the batch by doc_id. The batch
    becomes part of the index, which counts it; the result is written."""
    runs = _shared.materialize(repeat_runs(docs, index["folder"], index["shards"], False, index["batches"]), "runs")
    index["batches"] += 1
    return runs.groupBy("own", "node").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))


def with_spans(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Whole rows (`_row`) with `_runs`, null where nothing repeats."""
    spans = repeat_spans(docs, shard_bytes).select(F.col("own").alias("_own"), F.col("node").alias("_node"), F.col("runs").alias("_runs"))
    named = _shared.wrapped(docs, _own=order_of(F.col("doc_id")), _node=node_of(F.col("text")))
    return named.join(spans.hint("shuffle_hash"), ["_own", "_node"], "left").select("_row", "_runs")


def stretches(runs: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    if not runs[k].is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own = runs[k].values
    return union_of(own.field(0).to_numpy(), own.field(1).to_numpy())


def cut_digests(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the checksum of what is left."""

    def run(batches):
        for batch in batches:
            size, removed, spans, sha = [], [], [], []
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py().encode()
                a, b = stretches(batch.column(2), k)
                size.append(len(raw))
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                ends = [0, *b.tolist()]
                sha.append(hashlib.sha256(b"".join([raw[x:y] for x, y in zip(ends, [*a.tolist(), len(raw)])])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = with_spans(docs.select("doc_id", "text"), shard_bytes).select("_row.doc_id", F.coalesce("_row.text", F.lit("")).alias("text"), "_runs")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents without their repeats, with their own columns; characters that are only partly covered stay, n_chars
    follows the text."""
    names = docs.columns

    def run(batches):
        at = names.index("text")
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text = batch.column(at)[k].as_py()
                a, b = stretches(batch.column(len(names)), k)
                if text is not None and len(a):
                    raw, left, end = text.encode(), [], 0
                    for x, y in zip(a.tolist(), b.tolist()):
                        while x < y and raw[x] & 0xC0 == 0x80:
                            x += 1
                        while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
                            y -= 1
                        left.append(raw[end:x])
                        end = y
                    text = b"".join([*left, raw[end:]]).decode()
                out.append(text)
            columns = [batch.column(k) for k in range(len(names))]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = docs.schema
    out = with_spans(docs, shard_bytes).select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "_runs").mapInArrow(run, schema)
    return out.withColumn("n_chars", F.char_length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op9_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_digests(_shared.table(spark, sf_dir, "documents"))
