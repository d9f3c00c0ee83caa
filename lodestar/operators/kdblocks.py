"""Query-aware hashing inside the blocks of a kd-tree.

The tree is grown on a bounded sample, turned to its principal axes: each node is cut at the median of its widest coordinate,
down to blocks of about BLOCK_ROWS rows of the whole table. Every row goes down to its block; a block over twice that size
(many equal rows) is split by a hash of the id. A query goes to the blocks whose cells (the ranges that the cuts leave) are
nearest to it.

Within a block, rows and query are projected on p-stable lines. A row whose projection lies within width * radius / 2 of the
query's on at least `threshold` lines is compared with it; the radius grows by the ratio c until the k-th distance found is
within `stop` * radius (c gives the ratio's guarantee, less finds more) or a share of the block has been compared. Width,
lines and threshold follow from the ratio and the block's size. Blocks are tasks; results count the rows that each query was compared with, cells included.

Null vectors are left out; repeated rows are rows of their own; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.indexes import training_rows
from lodestar.operators.more_indexes import query_aware_parameters
from lodestar.operators.search import top_k

BLOCK_ROWS, BLOCKS, SAMPLE = 4096, 2048, 20_000
#: Queries that one task searches in a block.
QUERIES = 4096


def kd_tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinate and threshold of each inner node in heap order; rows at or over the threshold go right."""
    axes, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = {0: np.arange(len(x))}
    for node in range(len(axes)):
        own = parts.pop(node)
        if len(own):
            axes[node] = int((x[own].max(0) - x[own].min(0)).argmax())
            cuts[node] = float(np.median(x[own, axes[node]]))
        right = x[own, axes[node]] >= cuts[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return axes, cuts


def leaves(x: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The block of each row."""
    node = np.zeros(len(x), np.int64)
    for _ in range((len(axes) + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[np.arange(len(x)), axes[node]] >= cuts[node])
    return node - len(axes)


def matrix_of(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def cells(axes: np.ndarray, cuts: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinates of each block's cell."""
    n = len(axes) + 1
    low, high = np.full((n, d), -np.inf), np.full((n, d), np.inf)
    for leaf in range(n):
        node = leaf + len(axes)
        while node:
            above, right = (node - 1) // 2, node % 2 == 0
            side, pick = (low, max) if right else (high, min)
            side[leaf, axes[above]] = pick(side[leaf, axes[above]], cuts[above])
            node = above
    return low, high


def principal_axes(x: np.ndarray) -> np.ndarray:
    """Axes as columns, the widest first."""
    values, axes = np.linalg.eigh(np.cov((x - x.mean(0)).T).reshape(x.shape[1], -1)) if len(x) > 1 else (np.ones(x.shape[1]), np.eye(x.shape[1]))
    return axes[:, np.argsort(-values)]


def build(base: DataFrame, save, block_rows: int = BLOCK_ROWS, seed: int = 7) -> dict:
    """The index: a table (block, id, v), the tree, and the first block and number of blocks of each leaf."""
    base = base.where("v IS NOT NULL")
    n, sample = base.count(), training_rows(base, SAMPLE)
    if not n:
        return {"n": 0}
    turn = principal_axes(sample)
    depth = max(0, min(int(math.log2(BLOCKS)), math.ceil(math.log2(n / block_rows))))
    axes, cuts = kd_tree(sample @ turn, depth)

    def descend(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(leaves(matrix_of(batch.column(1), batch.num_rows) @ turn, axes, cuts)), batch.column(0), batch.column(1)], ["leaf", "id", "v"])

    rows = save(base.select("id", "v").mapInArrow(descend, "leaf long, id long, v array<double>"))
    sizes = {r.leaf: r["count"] for r in rows.groupBy("leaf").count().collect()}  # BLOCKS rows at most
    parts = np.array([max(1, -(-sizes.get(k, 0) // (2 * block_rows))) for k in range(1 << depth)])
    first = np.cumsum(parts) - parts
    of = lambda xs: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in xs]), (F.col("leaf") + 1).cast("int"))
    rows = rows.select((of(first) + F.pmod(F.xxhash64("id", F.lit(seed)), of(parts))).alias("block"), "id", "v")
    return {"n": n, "rows": rows, "turn": turn, "cells": cells(axes, cuts, sample.shape[1]), "first": first, "parts": parts}


def chosen_blocks(index: dict, queries: DataFrame, blocks: int) -> DataFrame:
    """(qid, q, block) for all blocks of the leaves whose cells are nearest."""
    turn, (low, high), first, parts = index["turn"], index["cells"], index["first"], index["parts"]
    most = min(blocks, len(first))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                q = matrix_of(part.column(1), part.num_rows) @ turn
                beyond = np.maximum(0, np.maximum(low[None] - q[:, None], q[:, None] - high[None]))
                near = np.argsort(np.einsum("qld,qld->ql", beyond, beyond), axis=1, kind="stable")[:, :most]
                row, leaf = np.repeat(np.arange(len(q)), most), near.ravel()
                many = parts[leaf]
                block = np.repeat(first[leaf], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                i = pa.array(np.repeat(row, many))
                yield pa.RecordBatch.from_arrays([part.column(0).take(i), part.column(1).take(i), pa.array(block)], ["qid", "q", "block"])

    return queries.where("q IS NOT NULL").select("qid", "q").mapInArrow(run, "qid long, q array<double>, block long")


def hashed_search(x: np.ndarray, q: np.ndarray, k: int, c: float, stop: float, share: float, seed: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Of each query: the k nearest rows found, their squared distances, and the number of rows compared."""
    n = len(x)
    known = query_aware_parameters(max(n, 101), c)
    lines = np.random.default_rng(seed).standard_normal((known["tables"], x.shape[1]))
    keys, out = x @ lines.T, []
    for v in q:
        gap = np.abs(keys - v @ lines.T)
        # the radius at which a row collides often enough, for all rows at once
        needed = np.partition(gap, known["threshold"] - 1, axis=1)[:, known["threshold"] - 1] * 2 / known["width"]
        order = np.argsort(needed, kind="stable")
        most = min(n, k + math.ceil(share * n))
        radius, seen, dist = max(float(needed[order[min(k, n) - 1]]), 1e-12), 0, np.empty(0)
        while True:
            upto = min(most, int(np.searchsorted(needed[order], radius, "right")))
            more = x[order[seen:upto]] - v
            dist, seen = np.concatenate([dist, np.einsum("nd,nd->n", more, more)]), upto
            if seen >= most or (len(dist) >= k and np.partition(dist, k - 1)[k - 1] <= (stop * radius) ** 2):
                break
            radius *= c
        best = np.argsort(dist, kind="stable")[:k]
        out.append((order[best], dist[best], seen))
    return out


def search(index: dict, queries: DataFrame, k: int, blocks: int = 4, c: float = 2.0, stop: float = 1.0, share: float = 0.05, seed: int = 5) -> DataFrame:
    """qid, rank, id, dist, and compared. Blocks that many queries ask are given to several tasks."""
    if not index["n"]:
        return top_k(queries.select("qid", F.col("qid").alias("id"), F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("compared")).limit(0), k, extra=["compared"])
    asked = chosen_blocks(index, queries, blocks)
    tasks = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("tasks"))
    asked = asked.join(tasks, "block").withColumn("task", F.pmod(F.xxhash64("qid"), F.col("tasks"))).drop("tasks")
    rows = index["rows"].join(tasks, "block").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1))).drop("tasks")

    def run(_, own: pa.Table, asking: pa.Table) -> pa.Table:
        found = []
        if own.num_rows and asking.num_rows:
            own = own.sort_by("id")
            ids, qids = own.column("id").to_numpy(), asking.column("qid").to_numpy()
            for qid, (at, dist, seen) in zip(qids, hashed_search(matrix_of(own.column("v"), len(ids)), matrix_of(asking.column("q"), len(qids)), k, c, stop, share, seed)):
                found.append((np.full(len(at), qid), ids[at], np.sqrt(dist), np.where(np.arange(len(at)) == 0, seen, 0)))
        cols = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0)] * 4
        return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["qid", "id", "dist", "compared"])

    found = rows.groupBy("block", "task").cogroup(asked.groupBy("block", "task")).applyInArrow(run, "qid long, id long, dist double, compared long")
    total = found.groupBy("qid").agg((F.sum("compared") + len(index["first"])).alias("compared"))
    return top_k(found.select("qid", "id", "dist"), k).join(total, "qid")
