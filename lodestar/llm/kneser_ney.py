"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, mapped by the workers.

Words are counted first; a word's number is its place in the sorted arrays of word hashes (64 bits), so n-grams are spelled
in as few bytes as the vocabulary needs, and no two words share a number. Each map task counts its n-grams before it sends
them, as compressed columns; a shard of the n-gram table adds the counts up and writes an array of sorted hashes and one
of their values into the shared folder, one file for each shard and table. From the distinct n-grams of an order follow the
continuation counts of the order below and the totals of each context (its count, and the numbers of its followers seen
once, twice, more often). N-grams of three words and more are dealt out by their context, so those totals need no further
shuffle; pairs by themselves, as a word may have very many followers. Every order is a step of its own, whose shuffle files
go when it is written. The discounts of each order come from its counts of counts. Scoring reads only the mapped arrays: no
text is moved.

A table holds 32 bits of an n-gram's hash within its shard, and up to 16 by a directory of about n / 16 boxes; an n-gram that
was never seen is taken for a seen one with a probability of some 16 / 2**32. Values that are frequent in a shard are stored as one byte, others in
full (64 bits) beside it.

Tokens: words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, and one end for each text; n-grams reach over the beginning of
a text with start marks, which are context only. Unknown words share the unigram order's rest with all words evenly.

Defined results: null texts are empty (one token, the end); a null id counts as the id '' for the split; repeated rows
count as often as they stand; without training rows the model is uniform; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _shared
from lodestar.llm._kernels import U, join_hashes, mix, span_hashes, words

ORDER = 3
END, START = U(0x9D1F_27C3_51B8_A6E5), U(0x2B7E_1516_28AE_D2A7)
#: Text for each shard, and the tokens a map task counts before it sends.
SHARD_BYTES = 8 << 20
GATHER = 800_000
#: Mapped tables that a worker holds at once.
MAPS = 4096


def token_stream(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text with order - 1 start marks before it and an end behind, and their rows."""
    data, offsets = _shared.buffers_of(texts)
    starts, ends, rows = words(data, offsets)
    hashes = span_hashes(data, starts, ends, lower=True)
    per_row = np.bincount(rows, minlength=len(texts)).astype(np.int64)
    pad = order - 1
    heads = np.cumsum(per_row + pad + 1) - (per_row + pad + 1)
    out = np.full(int((per_row + pad + 1).sum()), START, np.uint64)
    out[np.arange(len(hashes)) + (np.arange(1, len(texts) + 1) * pad + np.arange(len(texts)))[rows]] = hashes
    out[heads + per_row + pad] = END
    return out, np.repeat(np.arange(len(texts)), per_row + pad + 1)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> U(32)).astype(np.int64) * shards >> 32


def fold(ids: np.ndarray, a: int, b: int) -> np.ndarray:
    """Hash of columns a to b of rows of word numbers."""
    key = mix(ids[:, a])
    for k in range(a + 1, b):
        key = join_hashes(key, ids[:, k])
    return key


def dealt_by(ids: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What an n-gram's shard follows from: its context, or the n-gram itself if it has two words or less."""
    n = ids.shape[1]
    return fold(ids, 0, n - 1) if n > 2 else key


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and the first place of each distinct one in it."""
    by = np.argsort(key)
    key = key[by]
    return by, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)


def sums_of(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order and the sums of their values."""
    by, first = runs_of(keys)
    return keys[by][first], [np.add.reduceat(v[by], first) if len(first) else v for v in values]


def groups(shard: np.ndarray):
    """(shard, places) for each shard that occurs."""
    by = np.argsort(shard, kind="stable")
    at = np.flatnonzero(np.diff(shard[by], prepend=-1))
    for a, b in zip(at, np.append(at[1:], len(by))):
        yield int(shard[by[a]]), by[a:b]


# -- what is sent: columns of numbers in bytes of equal weight, compressed

COUNT_BYTES = 6


def encode(columns: list[np.ndarray], sizes: list[int]) -> bytes:
    n = len(columns[0])
    planes = [np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :size].T).tobytes() for x, size in zip(columns, sizes)]
    return n.to_bytes(8, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def decode(raw: bytes, sizes: list[int]) -> list[np.ndarray]:
    n, out, at = int.from_bytes(raw[:8], "little"), [], 0
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    for size in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = planes[at : at + n * size].reshape(size, n).T
        out.append(wide.view("<u8").ravel())
        at += n * size
    return out


def spell(ids: np.ndarray, counts: np.ndarray, size: int) -> bytes:
    """N-grams (rows of word numbers) and counts, sorted by the first word, which is sent as steps."""
    by = np.argsort(ids[:, 0])
    ids = ids[by]
    steps = np.diff(ids[:, 0], prepend=U(0))
    return encode([steps, *ids[:, 1:].T, counts[by]], [size] * ids.shape[1] + [COUNT_BYTES])


def unspell(raw: bytes, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    *ids, counts = decode(raw, [size] * n + [COUNT_BYTES])
    ids[0] = np.cumsum(ids[0], dtype=np.uint64)
    return np.stack(ids, axis=1), counts.astype(np.int64)


# -- tables in the shared folder

BOOK, WIDE = 255, np.dtype("<u8")
#: Entries that a box of the directory has on average.
IN_BOX = 16


def write_table(folder: str, name: str, keys: np.ndarray, values: np.ndarray) -> None:
    """A table from distinct sorted hashes to rows of at most four numbers, in one file: sizes, directory, hashes, codes of
    values, the book of frequent values, and places and values of the others."""
    box_bits = max(0, min(16, int(len(keys) // IN_BOX).bit_length()))
    prints = keys >> U(32 - box_bits)
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    prints, values = prints[first], np.ascontiguousarray(values[first].astype(WIDE))
    n, width = values.shape
    packed = values[:, 0].copy()
    for k in range(1, width):
        packed |= values[:, k] << U(16 * k)
    packed[(values >> U(16)).any(axis=1)] = ~U(0)  # those stand by themselves
    book, seen = np.unique(packed, return_counts=True)
    often = np.sort(book[np.argsort(-np.where(book == ~U(0), 0, seen), kind="stable")[:BOOK]])
    often = often[often != ~U(0)]
    code = np.full(n, BOOK, np.uint8)
    if len(often):
        at = np.minimum(np.searchsorted(often, packed), len(often) - 1)
        code = np.where(often[at] == packed, at, BOOK).astype(np.uint8)
    rest = np.flatnonzero(code == BOOK)
    spread = np.stack([often >> U(16 * k) & U(0xFFFF) for k in range(width)], axis=1) if width > 1 else often[:, None]
    parts = [
        np.array([n, width, len(often), len(rest), box_bits], "<i8"), np.searchsorted(prints >> U(32), np.arange((1 << box_bits) + 1, dtype=np.uint64)).astype("<i8"),
        (prints & U(0xFFFFFFFF)).astype("<u4"), np.zeros(n % 2, "<u4"), code, np.zeros(-n % 8, np.uint8), spread.astype(WIDE), rest.astype("<i8"), values[rest],
    ]
    _shared.write_array(folder, name, np.frombuffer(b"".join(x.tobytes() for x in parts), np.uint8))


class Table:
    def __init__(self, folder: str, name: str):
        raw = _shared.map_array(folder, name, np.uint8)
        self.n = 0
        if not len(raw):
            return
        raw = np.asarray(raw)
        self.n, self.width, often, rest, self.box_bits = (int(x) for x in raw[:40].view("<i8"))
        at = 40

        def take(count: int, dtype, pad: int = 0) -> np.ndarray:
            nonlocal at
            out = raw[at : at + count * np.dtype(dtype).itemsize].view(dtype)
            at += out.nbytes + pad
            return out

        self.dirs = take((1 << self.box_bits) + 1, "<i8")
        self.low = take(self.n, "<u4", 4 * (self.n % 2))
        self.code = take(self.n, np.uint8, -self.n % 8)
        self.book = take(often * self.width, WIDE).reshape(-1, self.width)
        self.rest = take(rest, "<i8")
        self.values = take(rest * self.width, WIDE).reshape(-1, self.width)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes the table has, and their values; all are searched at once, by halving."""
        prints = keys >> U(32 - self.box_bits)
        box, want = (prints >> U(32)).astype(np.int64), (prints & U(0xFFFFFFFF)).astype(np.uint32)
        low, high = self.dirs[box], self.dirs[box + 1]
        end = high
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            mid = (low + high) >> 1
            less = (low < high) & (self.low[np.minimum(mid, self.n - 1)] < want)
            low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
        good = np.flatnonzero((low < end) & (self.low[np.minimum(low, self.n - 1)] == want))
        place = low[good]
        code = self.code[place]
        values = np.zeros((len(place), self.width))
        if len(self.book):  # none where all values stand by themselves
            values[:] = self.book[np.minimum(code, len(self.book) - 1)]
        if (far := np.flatnonzero(code == BOOK)).size and len(self.rest):
            values[far] = self.values[np.searchsorted(self.rest, place[far])]
        return good, values


# -- counting

NUMBERS = ("n1", "n2", "n3", "n4", "total", "distinct")
SENT = "kind string, shard long, data binary, order int, " + ", ".join(f"{x} long" for x in NUMBERS)


def arrow(rows: list[dict]) -> pa.Table:
    kinds = {"kind": pa.string(), "shard": pa.int64(), "data": pa.binary(), "order": pa.int32(), **dict.fromkeys(NUMBERS, pa.int64())}
    return pa.Table.from_pylist(rows, schema=pa.schema([*kinds.items()]))


def told(shard: int, order: int, counts: np.ndarray) -> dict:
    return {"kind": "told", "shard": shard, "order": order, **{f"n{k}": int((counts == k).sum()) for k in (1, 2, 3, 4)}, "total": int(counts.sum()), "distinct": len(counts)}


def of_kind(table: pa.Table, kind: str) -> list[bytes]:
    return [d for k, d in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()) if k == kind]


def streams(batches, order: int):
    """Token hashes of some GATHER tokens at a time."""
    held, n = [], 0
    for batch in batches:
        for _, column in _shared.slices(batch, "text", 1 << 20):
            held.append(token_stream(column, order)[0])
            n += len(held[-1])
            if n >= GATHER:
                yield np.concatenate(held)
                held, n = [], 0
                _shared.trim()
    if n:
        yield np.concatenate(held)


def step(rows: DataFrame, shards: int, reduce) -> tuple[DataFrame, list[dict]]:
    """One reduction by shard, written; what it sends on, and the sums of what it tells."""
    done = _shared.materialize(rows.repartition(shards, "shard").groupBy("shard").applyInArrow(reduce, SENT), "grams")
    sums = done.where("kind = 'told'").groupBy("order").agg(*[F.sum(c).alias(c) for c in NUMBERS], F.max("distinct").alias("most")).collect()
    return done.where("kind != 'told'"), [x.asDict() for x in sums]


def count_words(texts: DataFrame, shards: int, folder: str) -> list[dict]:
    def gather(batches):
        for tokens in streams(batches, 1):
            keys, (ones,) = sums_of(tokens, [np.ones(len(tokens), np.int64)])
            rows = [{"kind": "word", "shard": k, "data": encode([keys[own], ones[own]], [8, COUNT_BYTES])} for k, own in groups(shard_of(keys, shards))]
            yield from arrow(rows).to_batches()

    def reduce(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        found = [decode(x, [8, COUNT_BYTES]) for x in of_kind(table, "word")]
        keys, (counts,) = sums_of(np.concatenate([x for x, _ in found]), [np.concatenate([x for _, x in found]).astype(np.int64)])
        _shared.write_array(folder, f"word-key-{shard}", keys)
        _shared.write_array(folder, f"word-count-{shard}", counts.astype(WIDE))
        return arrow([told(shard, 0, counts)])

    return step(texts.mapInArrow(gather, SENT), shards, reduce)[1]


class Words:
    """Numbers and counts of words, from the mapped arrays: a word's number is 1 + its place in its shard * shards + the
    shard; 0 is the start mark, and what no array has is unknown."""

    def __init__(self, folder: str, shards: int, size: int):
        self.folder, self.shards = folder, shards
        self.unknown = U((1 << (8 * size)) - 1)
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each token hash."""
        keys, back = np.unique(tokens, return_inverse=True)
        number, count = np.full(len(keys), self.unknown), np.zeros(len(keys))
        for shard, own in groups(shard_of(keys, self.shards)):
            if shard not in self.maps:
                if len(self.maps) >= MAPS:
                    self.maps.clear()
                self.maps[shard] = tuple(_shared.map_array(self.folder, f"word-{x}-{shard}", WIDE) for x in ("key", "count"))
            have, counts = self.maps[shard]
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[own]), len(have) - 1)
                good = have[at] == keys[own]
                number[own[good]] = (1 + at[good] * self.shards + shard).astype(np.uint64)
                count[own[good]] = counts[at[good]]
        number[keys == START] = 0
        return number[back], count[back]


def count_grams(texts: DataFrame, order: int, shards: int, folder: str) -> tuple[list[dict], int]:
    """Counts words, then n-grams of the highest order, then order by order down; writes all tables. Returns the counts of
    counts of each order (0: words) and the bytes of a word's number."""
    stats = count_words(texts, shards, folder)
    most = max((x["most"] for x in stats), default=0)
    size = max(1, -(-(most * shards + 2).bit_length() // 8))

    def gather(batches):
        words_of = Words(folder, shards, size)
        for tokens in streams(batches, order):
            real = np.flatnonzero(tokens != START)
            numbers = words_of.find(tokens)[0]
            ids = np.stack([numbers[real - k] for k in range(order - 1, -1, -1)], axis=1)
            del tokens, numbers
            key = fold(ids, 0, order)
            by, first = runs_of(key)
            ones, ids, key = np.diff(np.append(first, len(by))), ids[by[first]], key[by[first]]
            rows = [{"kind": "gram", "shard": k, "data": spell(ids[own], ones[own], size)} for k, own in groups(shard_of(dealt_by(ids, key), shards))]
            yield from arrow(rows).to_batches()

    def reduce(level: int):
        def run(table: pa.Table) -> pa.Table:
            shard, out = table.column("shard")[0].as_py(), []
            if contexts := [decode(x, [8] + [COUNT_BYTES] * 4) for x in of_kind(table, "context")]:
                keys, sums = sums_of(mix(np.concatenate([x[0] for x in contexts])), [np.concatenate([x[k] for x in contexts]).astype(np.int64) for k in range(1, 5)])
                write_table(folder, f"context{level + 1}-{shard}", keys, np.stack(sums, axis=1))
            found = [unspell(x, level, size) for x in of_kind(table, "gram")]
            del table, contexts
            if found:
                ids, counts = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                del found
                key = mix(fold(ids, 0, level))
                by, first = runs_of(key)
                counts, by = np.add.reduceat(counts[by], first), by[first]
                key, ids = key[by], ids[by]
                write_table(folder, f"gram{level}-{shard}", key, counts[:, None])
                out.append(told(shard, level, counts))
                if level > 1:
                    ctx = fold(ids, 0, level - 1)
                    ctx, sums = sums_of(mix(ctx) if level > 2 else ctx, [counts, *(x.astype(np.int64) for x in (counts == 1, counts == 2, counts > 2))])
                    if level > 2:  # all followers of a context are here
                        write_table(folder, f"context{level}-{shard}", ctx, np.stack(sums, axis=1))
                    else:
                        out += [{"kind": "context", "shard": k, "data": encode([ctx[own], *(x[own] for x in sums)], [8] + [COUNT_BYTES] * 4)} for k, own in groups(shard_of(ctx, shards))]
                    low = fold(ids, 1, level)
                    by, first = runs_of(low)
                    ones, rest, low = np.diff(np.append(first, len(by))), ids[by[first], 1:], low[by[first]]
                    del ids, key, counts
                    out += [{"kind": "gram", "shard": k, "data": spell(rest[own], ones[own], size)} for k, own in groups(shard_of(dealt_by(rest, low), shards))]
            _shared.trim()
            return arrow(out)

        return run

    now = texts.mapInArrow(gather, SENT)
    for level in range(order, 0, -1):
        now, sums = step(now, shards, reduce(level))
        stats += sums
    return stats, size


def discounts(s: dict) -> tuple[float, float, float]:
    """D1, D2 and D3+ of Chen and Goodman; half of the count where the counts of counts don't give them."""
    n1, n2, n3, n4 = (s.get(f"n{k}", 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 1.5
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found))  # type: ignore[return-value]


class Model:
    """The mapped tables of one model; made anew in each worker."""

    def __init__(self, folder: str, order: int, shards: int, size: int, stats: list[dict]):
        self.folder, self.order, self.shards = folder, order, shards
        self.stats = {s["order"]: s for s in stats}
        self.words = Words(folder, shards, size)
        self.maps: dict[str, Table] = {}

    def table(self, name: str) -> Table:
        if name not in self.maps:
            if len(self.maps) >= MAPS:
                self.maps.clear()
            self.maps[name] = Table(self.folder, name)
        return self.maps[name]

    def lookup(self, name: str, keys: np.ndarray, by: np.ndarray, width: int = 1) -> np.ndarray:
        """Values of keys, whose shards follow from `by`; zeros where the table doesn't have them."""
        order, first = runs_of(keys)
        distinct = mix(keys[order[first]])
        out = np.zeros((len(first), width), np.float64)
        for shard, own in groups(shard_of(by[order[first]], self.shards)):
            table = self.table(f"{name}-{shard}")
            if table.n:
                good, values = table.find(distinct[own])
                out[own[good]] = values
        whole = np.empty((len(keys), width), np.float64)
        whole[order] = np.repeat(out, np.diff(np.append(first, len(keys))), axis=0)
        return whole

    def log10(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of the word at each place, given the order - 1 before it."""
        vocabulary = self.stats.get(0, {}).get("distinct", 0) + 1  # and one for all unknown words
        p = np.full(len(at), 1.0 / vocabulary)
        for level in range(1, self.order + 1):
            s = self.stats.get(level)
            if not s:
                continue
            d = np.array([0.0, *discounts(s)])
            ids = np.stack([numbers[at - k] for k in range(level - 1, -1, -1)], axis=1)
            key = fold(ids, 0, level)
            c = self.lookup(f"gram{level}", key, dealt_by(ids, key))[:, 0]
            kept = np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0)
            if level == 1:
                rest = d[1] * s["n1"] + d[2] * s["n2"] + d[3] * (s["distinct"] - s["n1"] - s["n2"])
                p = (kept + rest * p) / float(s["total"])
            else:
                context = fold(ids, 0, level - 1)
                sums = self.lookup(f"context{level}", context, context, 4)
                seen = sums[:, 0] > 0
                p[seen] = (kept[seen] + sums[seen, 1:] @ d[1:] * p[seen]) / sums[seen, 0]
        return np.log10(p)


_MODELS: dict[str, Model] = {}


def train(texts: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> dict:
    """Counts a table with a column `text`; returns what workers need to map the model."""
    spark = texts.sparkSession
    _, size = _shared.input_bytes(texts)
    shards = max(1, -(-size // shard_bytes))
    folder = _shared.local_path(_shared.shared_path(spark, "ngrams"))
    with _shared.scratch(spark):
        stats, size = count_grams(texts.select("text"), order, shards, folder)
    return {"folder": folder, "order": order, "shards": shards, "size": size, "stats": stats}


def score(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """key, held_out carried, token counts, base and model scores of every text."""

    def run(batches):
        folder = model["folder"]
        if folder not in _MODELS:
            _MODELS.clear()
            _MODELS[folder] = Model(**model)
        lm = _MODELS[folder]
        words_of = lm.stats.get(0, {"total": 0, "distinct": 0})
        total, distinct = words_of["total"], words_of["distinct"]
        for batch in batches:
            for part, texts in _shared.slices(batch, "text", 4 << 20):
                tokens, rows = token_stream(texts, lm.order)
                at = np.flatnonzero(tokens != START)
                numbers, c = lm.words.find(tokens)
                row, c = rows[at], c[at]
                n = len(texts)
                tally = lambda x: np.bincount(row, weights=x, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.bincount(row, minlength=n).astype(np.int64)), pa.array(tally(c > 0).astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(tally(np.log10((c + 1) / (total + distinct + 1)))), pa.array(tally(lm.log10(numbers, at)))],
                    ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), "held_out", "text")
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)


def split(docs: DataFrame, modulus: int = 7, rest: int = 2, key: str = "doc_id") -> DataFrame:
    """key, text (never null) and held_out."""
    return docs.select(key, F.coalesce("text", F.lit("")).alias("text"), (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus == rest).alias("held_out"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = split(_shared.table(spark, sf_dir, "documents"))
    return score(docs, train(docs.where("NOT held_out")))
