"""Learned rotations (optimized product codes, iterative quantization), block kernels for codes, and layered graphs.

Models are trained on a bounded seeded sample; every row is coded and indexed. Approximate lists are re-ranked exactly by
`search.refine`, with as many candidates as the caller gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.vectors import linear
from lodestar.operators import indexes as X
from lodestar.operators import search as S
from lodestar.operators.search import top_k


def iterative_quantization(x: np.ndarray, bits: int, steps: int = 30, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (d x bits): principal axes, then the rotation that brings them nearest to their signs."""
    mean = x.mean(0)
    values, axes = np.linalg.eigh(np.cov((x - mean).T))
    axes = axes[:, np.argsort(-values)[:bits]]
    y = (x - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(steps):
        u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = (u @ v).T
    return mean, axes @ turn


def optimized_rotation(x: np.ndarray, pieces: int, ksub: int, rounds: int = 8, steps: int = 4, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Rotation (d x d) and codebooks for which product codes lose least: codes for the rotation, then the rotation for
    the codes (orthogonal Procrustes), by turns."""
    d = x.shape[1]
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(rounds):
        y = x @ turn
        books = X.codebook(y, pieces, ksub, steps)
        u, _, v = np.linalg.svd(x.T @ decoded(y, books))
        turn = u @ v
    return turn, X.codebook(x @ turn, pieces, ksub, 4 * steps)


def coded(y: np.ndarray, books: np.ndarray) -> np.ndarray:
    w = len(books[0][0])
    return np.stack([((y[:, j * w : (j + 1) * w] ** 2).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * y[:, j * w : (j + 1) * w] @ b.T).argmin(1) for j, b in enumerate(books)], axis=1)


def decoded(y: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([b[c] for b, c in zip(books, coded(y, books).T)], axis=1)


def turned(df: DataFrame, matrix: np.ndarray, vec: str, mean: np.ndarray | None = None) -> DataFrame:
    return df.withColumn(vec, linear(matrix.T, vec) if mean is None else linear(matrix.T, vec, -(mean @ matrix)))


def reversed_turn(df: DataFrame, matrix: np.ndarray, vec: str) -> DataFrame:
    """The inverse of an orthonormal map."""
    return df.withColumn(vec, linear(matrix, vec))


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def encode_blocks(base: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, code) by matrix products on Arrow batches; the books travel once for each task, not as a plan's literal."""

    def run(batches):
        for batch in batches:
            c = coded(matrix_of(batch.column(1)), books) if batch.num_rows else np.empty((0, len(books)), int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(c.astype(np.uint8).view("S1").reshape(len(c), -1).view(f"V{len(books)}").ravel().tolist() if len(c) else []), pa.binary())], ["id", "code"])

    return base.select("id", "v").mapInArrow(run, "id long, code binary")


def nearest_codes(ids: np.ndarray, q: np.ndarray, books: np.ndarray, parts, k: int) -> list:
    """qid, id and distance of the k first codes of each query by (distance, id), over parts of (ids, codes)."""
    m, w = len(books), len(books[0][0])
    tables = [((q[:, None, j * w : (j + 1) * w] - books[j][None]) ** 2).sum(2) for j in range(m)]
    best = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
    for own, code in parts:
        for n in range(len(ids)):
            d = sum(tables[j][n][code[:, j]] for j in range(m))
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            d, i = np.concatenate([best[n][0], d[near]]), np.concatenate([best[n][1], own[near]])
            first = np.lexsort((i, d))[:k]
            best[n] = d[first], i[first]
    return [pa.array(np.repeat(ids, [len(x[0]) for x in best])), pa.array(np.concatenate([x[1] for x in best])), pa.array(np.concatenate([x[0] for x in best]))]


def block_search(codes: DataFrame, queries: DataFrame, books: np.ndarray, k: int) -> DataFrame:
    """The k nearest codes (binary, a byte for each piece) of each query. Tables of distances are made where they are used, and
    each task keeps its k first by (dist, id), so k rows for each query and task are shuffled. Up to QUERY_BLOCK queries are
    shipped to every task; more are dealt out in blocks that meet chunks of codes."""
    m, names, kinds = len(books), ["qid", "id", "dist"], "qid long, id long, dist double"
    parts = lambda batches: ((b.column(0).to_numpy(), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, m)) for b in batches if b.num_rows)
    known = queries.select("qid", "q").limit(S.QUERY_BLOCK + 1).collect()
    if len(known) <= S.QUERY_BLOCK:
        ids, q = np.array([r.qid for r in known], np.int64), np.array([r.q for r in known], np.float64).reshape(len(known), -1 if known else 0)

        def run(batches):
            if len(ids):
                yield pa.RecordBatch.from_arrays(nearest_codes(ids, q, books, parts(batches), k), names)

        return top_k(codes.select("id", "code").mapInArrow(run, kinds), k)
    rows, asked = S.dealt(codes.select("id", "code"), queries.select("qid", "q"))

    def meet(_, own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        return pa.table(nearest_codes(asking.column("qid").to_numpy(), matrix_of(asking.column("q").combine_chunks()), books, parts(own.select(["id", "code"]).to_batches()), k), names)

    return top_k(rows.groupBy("_chunk", "_block").cogroup(asked.groupBy("_chunk", "_block")).applyInArrow(meet, kinds), k)


# -- layered graphs

def levels(base: DataFrame, m: int) -> DataFrame:
    """(id, level): a row reaches a level with the probability m ** -level, by a hash of its id."""
    unit = (F.shiftrightunsigned(F.xxhash64("id", F.lit(17)), 11).cast("double") + 1) / F.lit(2.0**53)
    return base.select("id", F.floor(-F.log(unit) / F.lit(float(np.log(m)))).cast("int").alias("level"))


def layered_graph(base: DataFrame, m: int, construction: int, save, least_rows: int = 64) -> list[DataFrame]:
    """Edges (src, dst) of each layer, the lowest with all rows first: neighbours by descent on `construction` candidates,
    pruned by occlusion to m (2m in the lowest layer), and their reverses. Layers end where one has few rows."""
    of = save(levels(base, m))
    layers, level = [], 0
    while True:
        rows = base.join(of.where(F.col("level") >= level), "id", "left_semi").select("id", "v")
        n = rows.count()
        if level and n < least_rows:
            break
        k = max(1, min(construction, n - 1))
        near = save(X.nn_descent(rows, k, 5, save).select("src", "pos", "dst", "dist"))
        kept = save(X.occlusion_prune(near, rows, 2 * m if level == 0 else m).select("src", "dst"))
        layers.append(save(kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()))
        level += 1
    return layers


def layered_search(layers: list[DataFrame], base: DataFrame, queries: DataFrame, k: int, ef: int, save, entries: int = 8, hops: int = 40) -> DataFrame:
    """Beam search from the highest layer down: what a layer finds is where the next one starts."""
    seeds = [r.src for r in layers[-1].select("src").distinct().orderBy(F.xxhash64("src")).limit(entries).collect()]
    start = queries.select("qid", F.explode(F.array(*[F.lit(x).cast("long") for x in seeds])).alias("id")) if seeds else None
    for level in range(len(layers) - 1, -1, -1):
        wide = ef if level == 0 else entries
        found = X.graph_search(layers[level], base, queries, k if level == 0 else entries, wide, hops, save=save, start=start)
        start = found.select("qid", "id")
    return found
