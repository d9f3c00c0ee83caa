"""Near-duplicates by BagMinHash over multisets of word shingles.

Each document is the multiset of its five-word shingles. Every shingle carries Poisson processes over dyadic intervals of
weight, (0, 1], (1, 2], (2, 4], ..., each with a rate as wide as the interval; a point counts if its weight, found by
halving the interval, is within the shingle's count, and it falls on one component of the signature. The earliest point
of each component is the signature: two documents agree in a component with their weighted Jaccard similarity as the
probability. Points are made in rounds of time until every component has one, so a signature costs about m log m points
whatever the weights.

Signatures are cut into bands. Texts that share a band's bucket are candidates: each is compared with the bucket's leader,
the text that shares most with others, so a bucket of n copies costs n comparisons; members left in other components are
compared only with those that could still be similar, found by their rarest shingles. Candidates are verified by the
overlap of their multisets. Documents with the same text count as one node.

Defined results: null and empty texts, and those of white space alone, are near-duplicates only of equal texts; texts of
one to four words are one shingle; null doc_ids come last and never name a class unless all its ids are null; repeated
rows share a class; an empty table gives no rows; other columns are not looked at. A text's node is its 64-bit xxHash;
texts that share one are told apart by a second hash, 128 bits together. Joins by bucket, shingle or label, of which one
may hold a third of all rows, have one row for each on their other side, so adaptive execution splits the large side.
Classes whose least ids are equal, or null, have the same class_id; class_label, the least text hash of the
class, tells them apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import _shared
from lodestar.llm._kernels import U, grams, mix, span_hashes, words
from lodestar.llm.components import components, joined_components

SHINGLE = 5
LEAST = 0.8
#: 32 bands of 4: a pair at 0.8 shares none with a probability of 5e-8.
BANDS, ROWS = 32, 4
SEED = 0x51ED270B
#: Node lists of two numbers a row are broadcast up to this length (16 bytes a row, some 20 MB as a hash table), after a
#: count; longer ones are joined by shuffle.
BROADCAST_NODES = 400_000


def multisets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of each distinct shingle, sorted by row and shingle."""
    data, offsets = _shared.buffers_of(texts)
    starts, ends, rows = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    found, where = grams(hashes, rows, n)
    per_row = np.bincount(rows, minlength=len(texts))
    for k in range(1, n):
        if (per_row == k).any():
            short, at = grams(hashes, rows, k)
            own = per_row[at] == k
            found, where = np.concatenate([found, short[own]]), np.concatenate([where, at[own]])
    order = np.lexsort((found, where))
    found, where = found[order], where[order]
    if not len(found):
        return where, found, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (where[1:] != where[:-1])]))
    return where[first], found[first], np.diff(np.append(first, len(found)))


def _processes(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, seed: int):
    """One Poisson process for each shingle and dyadic interval that begins under its count."""
    out, level, low = [], 0, 0
    alive = np.arange(len(row))
    while len(alive):
        rate = 1 if not level else 1 << level - 1
        out.append((row[alive], mix(shingle[alive] ^ mix(np.full(1, seed + level, np.uint64))), np.full(len(alive), rate, np.float64), (count[alive] - low) / rate))
        low, level = low + rate, level + 1
        alive = alive[count[alive] > low]
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0), np.empty(0)]


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_rows: int, m: int, seed: int = SEED) -> np.ndarray:
    """The earliest point of each component (as the bits of its time), all ones for rows without shingles."""
    sig = np.full(n_rows * m, np.inf)
    total = np.bincount(row, weights=count, minlength=n_rows)
    todo = np.flatnonzero(total > 0)
    horizon = np.zeros(n_rows)
    horizon[todo] = m * (np.log(m) + 4) / total[todo]
    who, start, rate, share = _processes(row, shingle, count, seed)
    pick = np.arange(len(who))
    while len(todo):
        at, state, time = who[pick], start[pick], np.zeros(len(pick))
        speed, part = rate[pick], share[pick]
        while len(at):
            state = mix(state + U(0x9E3779B97F4A7C15))
            time = time - np.log1p(-(state >> U(11)).astype(np.float64) * 2.0**-53) / speed
            alive = time <= horizon[at]
            at, state, time, speed, part = at[alive], state[alive], time[alive], speed[alive], part[alive]
            where = mix(state ^ U(0xA0761D6478BD642F))
            # the point's weight within the interval, found by halving it: the bits of `where` below its top 32
            hit = (part >= 1) | ((where & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < part)
            component = ((where >> U(32)) * U(m)) >> U(32)
            np.minimum.at(sig, at[hit] * m + component[hit].astype(np.int64), time[hit])
        todo = todo[np.isinf(sig.reshape(n_rows, m)[todo]).any(axis=1)]
        if len(todo):
            horizon[todo] *= 2
            again = np.zeros(n_rows, bool)
            again[todo] = True
            pick = np.flatnonzero(again[who])
            sig.reshape(n_rows, m)[todo] = np.inf
    return sig.view(np.uint64).reshape(n_rows, m)


def node_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def check_of(text: Column) -> Column:
    """A second hash of a text, independent of its node."""
    return F.xxhash64(F.lit("check"), F.coalesce(text, F.lit("")))


def shared_nodes(rows: DataFrame) -> DataFrame | None:
    """Of (node, check) the nodes that different texts share, with the least check of each; None where there is none. At
    most a few hundred are likely among 10**11 texts."""
    found = rows.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least != most").select("node", "least")
    found = _shared.materialize(found, "shared-nodes")
    return None if found.isEmpty() else found


def told_apart(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """rows (node, check, ...) without check; texts that share a node with another get one of their own."""
    if shared is None:
        return rows.drop("check")
    own = F.when(F.col("least") != F.col("check"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return rows.join(few(shared), "node", "left").withColumn("node", own).drop("check", "least")


def order_of(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit((1 << 63) - 1))


def band_table(docs: DataFrame, key: str, text: str, bands: int = BANDS, rows: int = ROWS, n: int = SHINGLE) -> DataFrame:
    """order, node, check and band hashes (null where a text has no words) of every document; one narrow stage."""

    def run(batches):
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                sig = signatures(*multisets(texts, n), len(texts), bands * rows)
                empty = np.isinf(sig.view(np.float64)[:, 0]) if len(texts) else np.empty(0, bool)
                parts = sig.reshape(len(texts), bands, rows)
                folded = parts[:, :, 0]
                for k in range(1, rows):
                    folded = mix(folded * U(0x9E3779B97F4A7C15) + parts[:, :, k])
                folded = mix(folded ^ np.arange(bands, dtype=np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), pa.array(folded.reshape(-1)), mask=pa.array(empty))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["own", "node", "check", "bands"])

    rows_in = docs.select(order_of(F.col(key)).alias("own"), node_of(F.col(text)).alias("node"), check_of(F.col(text)).alias("check"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows_in.mapInArrow(run, "own long, node long, check long, bands array<long>")


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if a count shows it to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_NODES else df


def multiset_table(docs: DataFrame, needed: DataFrame, text: str, n: int = SHINGLE, shared: DataFrame | None = None) -> DataFrame:
    """Sorted shingles and their counts of the needed nodes, one row each."""

    def run(batches):
        for batch in batches:
            for part, texts in _shared.slices(batch, "text"):
                row, shingle, count = multisets(texts, n)
                ends = np.searchsorted(row, np.arange(len(texts) + 1))
                sets = [shingle[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                counts = [b"" if not (count[a:b] > 1).any() else count[a:b].astype(np.uint32).tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], ["node", "shingles", "counts"])

    rows = docs.select(order_of(F.col("doc_id")).alias("own") if "doc_id" in docs.columns else F.lit(0).alias("own"), node_of(F.col(text)).alias("node"), check_of(F.col(text)).alias("check"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = told_apart(rows, shared).join(few(needed), ["node", "own"], "left_semi").select("node", "text")
    return rows.mapInArrow(run, "node long, shingles binary, counts binary").groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("counts").alias("counts"))


def weighted_jaccard(a: bytes, ca: bytes, b: bytes, cb: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    wx = np.frombuffer(ca, np.uint32).astype(np.int64) if ca else np.ones(len(x), np.int64)
    wy = np.frombuffer(cb, np.uint32).astype(np.int64) if cb else np.ones(len(y), np.int64)
    total = int(wx.sum() + wy.sum())
    if not total:
        return 0.0
    at = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    both = y[at] == x if len(y) else np.zeros(len(x), bool)
    shared = int(np.minimum(wx[both], wy[at[both]]).sum())
    return shared / (total - shared)


def verify(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""

    def run(batches):
        for batch in batches:
            sim = np.array([weighted_jaccard(*(c[k].as_py() for c in batch.columns[2:])) for k in range(batch.num_rows)])
            good = pa.array(np.flatnonzero(sim >= least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(run, "a long, b long")


def pairs_of(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def shingle_rows(sets: DataFrame) -> DataFrame:
    """(node, shingle, c), one row for each shingle of each node."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[k].as_py(), np.int64)
                c = batch.column(2)[k].as_py()
                counts = np.frombuffer(c, np.uint32).astype(np.int64) if c else np.ones(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(x), k))), pa.array(x), pa.array(counts)], ["node", "shingle", "c"])

    return sets.select("node", "shingles", "counts").mapInArrow(run, "node long, shingle long, c long")


def open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs that share a bucket, are in different components, and may reach the similarity: an overlap of a share of
    both weights together, 4 / 9 for 0.8.

    No pair is left out that could: with n a node's weight and own its weight in shingles of no other node here, a pair's
    overlap is at most n - own of either node, so n of one may not be over (n - own) / share - n of the other. Nodes
    without any such partner in their buckets are settled; the others look for partners by their rarest shingles, of
    which they must share one, so far copies of one text aren't compared one by one.
    """
    share = least / (1 + least)
    placed = members.join(labels, "node", "left").select("bucket", "node", "leader", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("bucket")
    rest = _shared.materialize(placed.join(mixed, "bucket"), "open")
    here = rest.select("node", "label").distinct()
    rows = _shared.materialize(shingle_rows(sets.join(here.select("node"), "node", "left_semi")), "shingles")
    spread = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    rows = _shared.materialize(rows.join(spread, "shingle"), "rated")
    weights = rows.groupBy("node").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("df") > 1, F.col("c")).otherwise(0)).alias("own"))
    nodes = _shared.materialize(here.join(weights.select("node", "n", (F.col("own") / share - F.col("n") + 1e-6).alias("slack")), "node"), "weights")
    known = rest.join(nodes.select("node", "n", "slack"), "node")
    bounds = known.groupBy("bucket").agg(F.min("n").alias("least_n"), F.max("slack").alias("most_slack"))
    led = known.where("node = leader").select("bucket", F.col("label").alias("leader_label"))
    seekers = known.join(bounds, "bucket").join(led, "bucket").where("label != leader_label AND least_n <= slack AND n <= most_slack")
    seekers = seekers.groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.first("slack").alias("slack"), F.min(F.greatest(F.col("least_n").cast("double"), F.col("n") * least)).alias("partner"))
    mine = rows.join(seekers, "node").withColumn("before", F.sum("c").over(Window.partitionBy("node").orderBy("df", "shingle")) - F.col("c"))
    rarest = mine.where(F.col("n") - F.col("before") >= F.ceil((F.col("n") + F.col("partner")) * share - 1e-6))
    others = rows.select("shingle", "node").join(nodes, "node").select("shingle", F.col("node").alias("node2"), F.col("label").alias("label2"), F.col("n").alias("n2"), F.col("slack").alias("slack2"))
    found = rarest.where("df > 1").join(others, "shingle").where(f"label != label2 AND n2 <= slack AND n <= slack2 AND n2 >= {least - 1e-9}D * n AND n >= {least - 1e-9}D * n2")
    return found.select(*pairs_of(F.col("node"), F.col("node2"))).distinct()


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, n: int = SHINGLE) -> tuple[DataFrame, DataFrame | None]:
    """(own, node, label, class_own, class_node) of every document: its class, and the least document of that; and the
    nodes that different texts share."""
    signed = _shared.materialize(band_table(docs, key, text, n=n), "bands")
    shared_by = shared_nodes(signed.select("node", "check"))
    signed = told_apart(signed, shared_by)
    texts = signed.groupBy("node").agg(F.min("own").alias("own"), F.first("bands").alias("bands"))
    buckets = texts.where("bands IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    buckets = _shared.materialize(buckets, "buckets")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = _shared.materialize(buckets.join(shared, "bucket"), "members")
    # the node that shares the most with others is the likely centre of its group
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    leaders = members.select("bucket", "node").join(degrees, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("m")).select("bucket", F.col("m.node").alias("leader"))
    members = _shared.materialize(members.select("bucket", "node").join(leaders, "bucket"), "members")
    firsts = signed.groupBy("node").agg(F.min("own").alias("own"))
    needed = _shared.materialize(members.select("node").distinct().join(firsts, "node"), "needed")
    sets = _shared.materialize(multiset_table(docs.withColumnRenamed(key, "doc_id") if key != "doc_id" else docs, needed, text, n, shared_by), "sets")

    candidates = members.where("node != leader").select(*pairs_of(F.col("node"), F.col("leader"))).distinct()
    labels = components(_shared.materialize(verify(candidates, sets, least), "verified"))
    labels = joined_components(labels, _shared.materialize(verify(open_pairs(members, labels, sets, least), sets, least), "verified"))
    classes = firsts.join(labels, "node", "left").select("node", "own", F.coalesce("label", "node").alias("label"))
    # ids may be null or tied, so a class is its label, and its least document an id and a text
    heads = classes.groupBy("label").agg(F.min(F.struct("own", "node")).alias("head"))
    of_node = classes.join(heads, "label").select("node", "label", F.col("head.own").alias("class_own"), F.col("head.node").alias("class_node"))
    return signed.select("own", "node").join(of_node, "node"), shared_by


def class_table(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document: its id, the id of its class, the least in it, and the label of the class."""
    back = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c))
    return near_duplicate_classes(docs, key, text, least)[0].select(back("own").alias(key), back("class_own").alias("class_id"), F.col("label").alias("class_label"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One document of each class, with its own columns; of repeated rows one."""
    # of each class only its head stays, by id and text; no join by class, some are large
    head = (F.col("own") == F.col("class_own")) & (F.col("node") == F.col("class_node"))
    spark = docs.sparkSession
    found_at, shared_at = _shared.shared_path(spark, "classes"), _shared.shared_path(spark, "shared")
    with _shared.scratch(spark):
        classes, shared_by = near_duplicate_classes(docs, key, text, least)
        with _shared.cleaned(spark):
            classes.select("own", "node", head.alias("head")).write.parquet(found_at)
            if shared_by is not None:
                shared_by.write.parquet(shared_at)
    found = spark.read.parquet(found_at)
    shared_by = None if shared_by is None else spark.read.parquet(shared_at)
    gone = found.where("NOT head").select("own", "node").distinct()
    named = _shared.wrapped(docs, own=order_of(F.col(key)), node=node_of(F.col(text)), check=check_of(F.col(text)))
    named = told_apart(named, shared_by).withColumnsRenamed({"own": "_own", "node": "_node"})
    gone = _shared.materialize(gone.select(F.col("own").alias("_own"), F.col("node").alias("_node")), "gone")
    left = named.join(few(gone), ["_own", "_node"], "left_anti")
    if not found.where("head").groupBy("own", "node").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["_own", "_node"])
    return _shared.unwrapped(left, docs.columns)


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_table(_shared.table(spark, sf_dir, "documents"))
