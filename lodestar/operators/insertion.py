"""Neighbour graphs built by insertion, in shards that fit a task.

Rows go to their nearest centroids (of a bounded sample), each to `spill` of them, so that neighbours meet in a shard though a
border parts them; clusters over SHARD_ROWS are split by a hash of the id, and queries go to all parts of a cluster. Each
shard is a graph of its own, built and searched by one task; Spark deals rows and queries to the shards and merges results.

Within a shard, rows are inserted in batches, the rows of high levels first, so a layer is a prefix of the shard. A batch
descends from the entry through the upper layers, searches its layer with a beam of `construction` candidates, and links
itself to those that no nearer kept candidate hides; candidates of the batch itself count as well. Back edges are added, and
where a row has more than it may have, they are chosen by the same rule. All rows of a batch advance together in numpy.

A graph without upper layers (`layered=False`) starts each search from the nearest of `starts` evenly spaced rows instead.

Results count how many rows each query was compared with. Null vectors are left out; repeated rows are rows of their own;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.indexes import lloyd, training_rows
from lodestar.operators.search import top_k

SHARD_ROWS, CENTROIDS, SAMPLE = 8192, 4096, 20_000
#: Queries that one task searches in a shard, and rows that are inserted or searched at once.
QUERIES, BATCH = 4096, 256
#: Open candidates that a beam expands in one step.
WIDTH = 4


# -- one shard


def distances(v: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each query to rows of its own; row len(v) is none."""
    gap = v[np.minimum(at, len(v) - 1)] - q[:, None, :]
    return np.where(at < len(v), np.einsum("bkd,bkd->bk", gap, gap), np.inf)


def first_of(ids: np.ndarray, dist: np.ndarray, most: int, *more: np.ndarray) -> list[np.ndarray]:
    """The `most` nearest of each row, in order."""
    if dist.shape[1] > most:
        near = np.argpartition(dist, most - 1, axis=1)[:, :most]
        ids, dist, *more = (np.take_along_axis(x, near, 1) for x in (ids, dist, *more))
    by = np.argsort(dist, axis=1, kind="stable")
    return [np.take_along_axis(x, by, 1) for x in (ids, dist, *more)]


def beam(v: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `width` nearest rows that each query reaches from its start rows: ids, squared distances, rows compared. Beams
    grow while they hold a row whose links were not followed."""
    n, many = len(v), len(q)
    seen = np.zeros((many, n + 1), bool)
    seen[:, n] = True
    seen[np.arange(many)[:, None], start] = True
    ids, dist, done = np.full((many, width), n), np.full((many, width), np.inf), np.ones((many, width), bool)
    got = distances(v, q, start)
    ids, dist, done = first_of(np.concatenate([ids, start], 1), np.concatenate([dist, got], 1), width, np.concatenate([done, np.zeros(start.shape, bool)], 1))
    compared = np.full(many, start.shape[1])
    while True:
        rank = np.where(done | np.isinf(dist), np.inf, dist)
        live = np.flatnonzero(np.isfinite(rank).any(1))
        if not len(live):
            return ids, dist, compared
        take = min(WIDTH, width)
        pick = np.argpartition(rank[live], take - 1, axis=1)[:, :take] if take < width else np.broadcast_to(np.arange(width), (len(live), width))
        usable = np.isfinite(np.take_along_axis(rank[live], pick, 1))
        nodes = np.where(usable, np.take_along_axis(ids[live], pick, 1), n)
        done[live[:, None], pick] = True
        after = np.where(nodes[:, :, None] < n, links[np.minimum(nodes, n - 1)], -1).reshape(len(live), -1)
        after = np.sort(np.where(after < 0, n, after), axis=1)
        after[:, 1:][after[:, 1:] == after[:, :-1]] = n  # each row once
        fresh = ~seen[live[:, None], after]
        seen[live[:, None], after] = True
        after = np.where(fresh, after, n)
        compared[live] += fresh.sum(1)
        got = distances(v, q[live], after)
        ids[live], dist[live], done[live] = first_of(np.concatenate([ids[live], after], 1), np.concatenate([dist[live], got], 1), width, np.concatenate([done[live], np.zeros(after.shape, bool)], 1))


def unhidden(v: np.ndarray, ids: np.ndarray, dist: np.ndarray, keep: int) -> np.ndarray:
    """Of candidates in order of distance, those that lie nearer to their row than to any kept one; the rest is -1."""
    x = v[np.minimum(ids, len(v) - 1)]
    norm = np.einsum("bkd,bkd->bk", x, x)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    hidden, kept = np.isinf(dist), np.zeros(ids.shape, bool)
    for k in range(ids.shape[1]):
        kept[:, k] = ~hidden[:, k] & (kept.sum(1) < keep)
        hidden |= kept[:, k : k + 1] & (between[:, k] < dist)
    by = np.argsort(~kept, axis=1, kind="stable")[:, :keep]
    out = np.where(np.take_along_axis(kept, by, 1), np.take_along_axis(ids, by, 1), -1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def add_back(v: np.ndarray, links: np.ndarray, sources: np.ndarray, chosen: np.ndarray) -> None:
    """Links from the chosen rows back to their sources, at most as many as a row of `links` holds."""
    cap = links.shape[1]
    src, dst = np.repeat(sources, chosen.shape[1]), chosen.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    targets, first, many = np.unique(dst, return_index=True, return_counts=True)
    if not len(targets):
        return
    new = np.full((len(targets), int(many.max())), -1)
    new[np.repeat(np.arange(len(targets)), many), np.arange(len(dst)) - np.repeat(first, many)] = src
    for a in range(0, len(targets), BATCH):
        own = targets[a : a + BATCH]
        ids = np.concatenate([links[own], new[a : a + BATCH]], 1)
        ids = np.sort(np.where(ids < 0, len(v), ids), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = len(v)  # rows of a batch may have chosen each other
        ids, dist = first_of(ids, distances(v, v[own], ids), min(ids.shape[1], 3 * cap))
        full = np.isfinite(dist).sum(1) > cap
        plain = np.where(np.isfinite(dist), ids, -1)[:, :cap]
        plain = np.pad(plain, ((0, 0), (0, cap - plain.shape[1])), constant_values=-1)
        if full.any():
            plain[full] = unhidden(v, ids[full], dist[full], cap)
        links[own] = plain


def insert_all(v: np.ndarray, layer_sizes: list[int], m: int, construction: int, starts: int) -> list[np.ndarray]:
    """Links of each layer, the lowest first. Layer l holds the first layer_sizes[l] rows; the first of all is the entry."""
    n = len(v)
    links = [np.full((n if level == 0 else size, 2 * m if level == 0 else m), -1, np.int64) for level, size in enumerate(layer_sizes)]
    a = 0
    while a < n:
        b = min(n, a + max(1, min(BATCH, a)))
        q = v[a:b]
        at = np.zeros((b - a, 1), np.int64) if len(links) > 1 or not a else entries(v[:a], q, starts)
        for level in range(len(links) - 1, -1, -1):
            inside, members = min(a, layer_sizes[level]), max(0, min(b, layer_sizes[level]) - a)
            if inside:
                wide = construction if members else 1
                ids, dist, _ = beam(v[:inside], links[level][:inside], q, np.minimum(at, inside - 1), wide)
                ids = np.where(np.isinf(dist), n, ids)
                at = ids[:, :1]
            else:
                ids, dist = np.full((b - a, 1), n), np.full((b - a, 1), np.inf)
            if members:
                mates = np.broadcast_to(np.arange(a, a + members), (members, members))
                apart = distances(v, q[:members], mates)
                apart[np.arange(members), np.arange(members)] = np.inf
                near, gap = first_of(np.concatenate([ids[:members], mates], 1), np.concatenate([dist[:members], apart], 1), construction)
                chosen = unhidden(v, near, gap, m)
                links[level][a : a + members, :m] = chosen
                add_back(v[:b], links[level][:b], np.arange(a, a + members), chosen)
        a = b
    return links


def entries(v: np.ndarray, q: np.ndarray, starts: int) -> np.ndarray:
    """The nearest of some evenly spaced rows, for each query."""
    some = np.unique(np.linspace(0, len(v) - 1, min(starts, len(v))).astype(np.int64))
    return some[distances(v, q, np.broadcast_to(some, (len(q), len(some)))).argmin(1)][:, None]


def search_one(v: np.ndarray, links: list[np.ndarray], q: np.ndarray, k: int, ef: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows that each query finds: places, squared distances (place len(v): none), and rows compared."""
    total = np.zeros(len(q), np.int64)
    if len(links) > 1:
        at = np.zeros((len(q), 1), np.int64)
        for level in range(len(links) - 1, 0, -1):
            at, _, compared = beam(v[: len(links[level])], links[level], q, at, 1)
            total += compared
    else:
        at, total = entries(v, q, starts), total + min(starts, len(v))
    ids, dist, compared = beam(v, links[0], q, at, max(k, ef))
    return ids[:, :k], dist[:, :k], total + compared


# -- shards


def nearest_centroids(rows: DataFrame, centroids: np.ndarray, most: int, key: str, vec: str) -> DataFrame:
    """(key, vec, cluster) with a row for each of a row's `most` nearest centroids."""
    most = min(most, len(centroids))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            d = (centroids * centroids).sum(1)[None] - 2 * x[:, : centroids.shape[1]] @ centroids.T
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(i := pa.array(np.repeat(np.arange(len(x)), most))), batch.column(1).take(i), pa.array(near.ravel().astype(np.int64))], [key, vec, "cluster"])

    return rows.where(F.col(vec).isNotNull()).select(F.col(key), F.col(vec)).mapInArrow(run, f"{key} long, {vec} array<double>, cluster long")


def build(base: DataFrame, save, m: int = 16, construction: int = 64, spill: int = 2, layered: bool = True, starts: int = 100, shard_rows: int = SHARD_ROWS, seed: int = 11) -> dict:
    """The index: centroids, parts of each cluster, and a table (shard, node, id, v, links) saved by `save`, a row for each
    row of each shard; links has a list of nodes for each layer that the row is in."""
    base = base.where("v IS NOT NULL")
    sample = training_rows(base, SAMPLE)
    n = base.count()
    wanted = min(CENTROIDS, max(1, -(-2 * n * spill // shard_rows)), max(1, len(sample)))
    centroids = lloyd(sample, wanted, 8) if wanted > 1 else sample[:1] if len(sample) else np.zeros((1, 0))
    rows = nearest_centroids(base, centroids, spill, "id", "v") if n else base.select("id", "v").withColumn("cluster", F.lit(0).cast("long"))
    counts = {r.cluster: r["count"] for r in rows.groupBy("cluster").count().collect()}  # CENTROIDS at most
    parts = [max(1, -(-counts.get(c, 0) // shard_rows)) for c in range(len(centroids))]
    offset = np.concatenate([[0], np.cumsum(parts)])
    of = lambda xs, c: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in xs]), (c + 1).cast("int"))
    shard = of(offset[:-1], F.col("cluster")) + F.pmod(F.xxhash64("id", F.lit(seed)), of(parts, F.col("cluster")))

    def graph(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        unit = np.random.default_rng(seed).random(len(ids))[np.argsort(np.argsort(ids, kind="stable"), kind="stable")]  # by id, whatever order rows come in
        level = np.floor(-np.log(np.maximum(unit, 1e-300)) / np.log(m)).astype(np.int64) if layered else np.zeros(len(ids), np.int64)
        by = np.lexsort((unit, -level))
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[by]
        level = level[by]
        sizes = [int((level >= k).sum()) for k in range(int(level[0]) + 1)]
        links = insert_all(v, sizes, m, construction, starts)
        lists = [[[int(x) for x in links[k][node] if x >= 0] for k in range(len(sizes)) if node < sizes[k]] for node in range(len(ids))]
        return pa.table([pa.array(np.full(len(ids), table.column("shard")[0].as_py())), pa.array(np.arange(len(ids))), pa.array(ids[by]), pa.array(list(v), pa.list_(pa.float64())), pa.array(lists, pa.list_(pa.list_(pa.int64())))], ["shard", "node", "id", "v", "links"])

    nodes = save(rows.select(shard.alias("shard"), "id", "v").groupBy("shard").applyInArrow(graph, "shard long, node long, id long, v array<double>, links array<array<long>>"))
    return {"nodes": nodes, "centroids": centroids, "parts": parts, "offset": offset, "m": m, "starts": starts, "layered": layered, "rows": n}


def search(index: dict, queries: DataFrame, k: int, ef: int = 64, probe: int = 3) -> DataFrame:
    """qid, rank, id, dist and compared (rows that the query was compared with, centroids too). Shards that many queries ask
    are given to several tasks."""
    m, starts, parts, offset = index["m"], index["starts"], index["parts"], index["offset"]
    of = lambda xs, c: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in xs]), (c + 1).cast("int"))
    asked = nearest_centroids(queries, index["centroids"], probe, "qid", "q")
    asked = asked.select("qid", "q", F.explode(F.sequence(of(offset[:-1], F.col("cluster")), of(offset[1:], F.col("cluster")) - 1)).alias("shard"))
    tasks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("tasks"))
    asked = asked.join(tasks, "shard").withColumn("task", F.pmod(F.xxhash64("qid"), F.col("tasks"))).drop("tasks")
    nodes = index["nodes"].join(tasks, "shard").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).drop("tasks")

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["qid", "id", "dist", "compared"]
        if not own.num_rows or not asking.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], names)
        own = own.sort_by("node")
        v = own.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
        lists = own.column("links").to_pylist()
        links = []
        for level in range(len(lists[0])):
            some = [x[level] for x in lists if len(x) > level]
            table = np.full((len(some), 2 * m if level == 0 else m), -1)
            for at, x in enumerate(some):
                table[at, : len(x)] = x
            links.append(table)
        ids, qids, out = own.column("id").to_numpy(), asking.column("qid").to_numpy(), []
        q = asking.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qids), -1)
        for a in range(0, len(qids), BATCH):
            at, dist, compared = search_one(v, links, q[a : a + BATCH], k, ef, starts)
            row, place = np.nonzero(np.isfinite(dist))
            out.append(pa.table([pa.array(qids[a : a + BATCH][row]), pa.array(ids[at[row, place]]), pa.array(np.sqrt(dist[row, place])), pa.array(np.where(place == 0, compared[row], 0))], names))
        return pa.concat_tables(out)

    found = nodes.groupBy("shard", "task").cogroup(asked.groupBy("shard", "task")).applyInArrow(lambda _, a, b: run(a, b), "qid long, id long, dist double, compared long")
    # a row is in several shards: its entries meet before the k best are taken
    one = found.groupBy("qid", "id").agg(F.min("dist").alias("dist"), F.sum("compared").alias("compared"))
    total = one.groupBy("qid").agg((F.sum("compared") + len(index["centroids"])).alias("compared"))
    return top_k(one.select("qid", "id", "dist"), k).join(total, "qid")
