"""Approximate access methods as tables and joins.

An index is a table (posting lists, codes, hash buckets, edges) plus a small model (centroids, codebooks, hyperplanes)
that is trained on a bounded sample on the driver or given. Searches return (qid, rank, id, dist); distances of
compressed methods are approximate, `search.refine` computes exact ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.distances import BLOCKS, coordinate_sum, distance, exact_block
from lodestar.functions.vectors import linear
from lodestar.operators.search import SLICE_PAIRS, TILE_QUERIES, TILE_ROWS, all_pairs, checked, first_of, in_tasks, listed, met, regular, top_k

TRAIN_ROWS = 65_536
#: Neighbours, with their vectors, of one task of a graph's making.
MEMBER_ROWS = 1 << 16


def literal(matrix) -> str:
    """A nested array of doubles as SQL."""
    if np.ndim(matrix) == 1:
        return "array(" + ", ".join(f"{float(x)!r}D" for x in matrix) + ")"
    return "array(" + ", ".join(literal(x) for x in matrix) + ")"


def first_rows(base: DataFrame, n: int) -> np.ndarray:
    """The n rows with the least ids, as a matrix on the driver: a model that any engine can name."""
    return np.array([r.v for r in base.orderBy("id").limit(n).select("v").collect()], np.float64)


def training_rows(base: DataFrame, n: int = TRAIN_ROWS, seed: int = 23) -> np.ndarray:
    """A seeded random sample of n rows, as a matrix on the driver: the bound is the parameter."""
    return np.array([r.v for r in base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select("v").collect()], np.float64)


def lloyd(x: np.ndarray, k: int, steps: int = 25, spherical: bool = False, weights: np.ndarray | None = None) -> np.ndarray:
    """k-means from the first k rows; ties go to the lower centroid; an empty one is split off the largest by 1 +- 1/1024."""
    c = x[:k].copy()
    w = np.ones(len(x)) if weights is None else weights
    for _ in range(steps):
        d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T
        own = d.argmin(1)
        n = np.bincount(own, weights=w, minlength=k)
        for j in range(k):
            if n[j]:
                c[j] = (x[own == j] * w[own == j, None]).sum(0) / n[j]
        for j in np.flatnonzero(n == 0):
            big = int(n.argmax())
            sign = np.where(np.arange(x.shape[1]) % 2, 1 - 1 / 1024, 1 + 1 / 1024)
            c[j], c[big] = c[big] * sign, c[big] * (2 - sign)
            n[j] = n[big] = n[big] / 2
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def centroid_table(df: DataFrame, centroids) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centroids)], "list_no int, c array<double>")


def assign(df: DataFrame, centroids, n: int = 1, vec: str = "v") -> DataFrame:
    """df with the n nearest centroids of each row (list_no, by distance then number), as n rows. The centroids are a
    bounded literal, so this is one narrow pass."""
    found = F.expr(f"slice(array_sort(transform({literal(centroids)}, (c, k) -> struct({coordinate_sum('(x - y) * (x - y)', 'c', vec)} AS d, k AS list_no))), 1, {n})")
    return df.withColumn("_near", F.explode(found)).select(*df.columns, F.col("_near.list_no").alias("list_no"), F.col("_near.d").alias("list_dist"))


def kmeans_step(points: DataFrame, centroids) -> DataFrame:
    """New centroids (list_no, n, c) after one assignment: sums by list and coordinate, partially aggregated."""
    each = assign(points, centroids).select("list_no", F.posexplode("v").alias("pos", "x"))
    means = each.groupBy("list_no", "pos").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"))
    return means.groupBy("list_no").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))


def split_empty(step: DataFrame, k: int) -> DataFrame:
    """The centroids of a step (list_no, n, c), with those of the k numbers that got no row split off the largest list by
    1 +- 1/1024, coordinate by coordinate; several empty ones go off the next largest. k rows at most."""
    ranked = step.withColumn("_r", F.row_number().over(Window.orderBy(F.col("n").desc(), "list_no")))
    numbers = step.sparkSession.range(k).select(F.col("id").cast("int").alias("empty")).join(step.select(F.col("list_no").alias("empty")), "empty", "left_anti")
    numbers = numbers.withColumn("_r", F.row_number().over(Window.orderBy("empty")))
    turned = lambda sign: F.transform("c", lambda x, p: x * F.when(p % 2 == 1, 1 + sign / 1024).otherwise(1 - sign / 1024))
    both = ranked.join(numbers, "_r", "left")
    kept = both.select("list_no", F.when(F.col("empty").isNull(), F.col("n")).otherwise(F.col("n") / 2).cast("long").alias("n"), F.when(F.col("empty").isNull(), F.col("c")).otherwise(turned(1)).alias("c"))
    return kept.unionByName(both.where("empty IS NOT NULL").select(F.col("empty").alias("list_no"), (F.col("n") / 2).cast("long").alias("n"), turned(-1).alias("c")))


# -- inverted lists

def ivf_search(lists: DataFrame, queries: DataFrame, centroids, k: int, nprobe: int, measure: str = "l2") -> DataFrame:
    """lists: id, v, list_no (written by list_no, whole lists are pruned). Queries probe their nprobe nearest lists."""
    probes = assign(queries, centroids, nprobe, "q").select("qid", "q", "list_no")
    found = listed(lists, probes, k) if measure == "l2" else None
    if found is not None:
        return found.drop("list_no")
    pairs = lists.join(F.broadcast(probes), "list_no").select("qid", "id", distance(measure).alias("dist"))
    return top_k(pairs.groupBy("qid", "id").agg(F.min("dist").alias("dist")), k)


def spilled(base: DataFrame, centroids, copies: int = 2) -> DataFrame:
    """Each row in its `copies` nearest lists."""
    return assign(base, centroids, copies).select("id", "v", "list_no")


def soar_spilled(base: DataFrame, centroids, weight: float = 1.0) -> DataFrame:
    """Each row in its nearest list and in a second one, chosen by distance plus a penalty for residuals that run
    parallel to the first residual."""
    c = literal(centroids)
    first = assign(base, centroids).select("id", "v", F.col("list_no").alias("first"))
    score = f"{coordinate_sum('(x - y) * (x - y)', 'v', 'c')} + {weight}D * CASE WHEN rr = 0 THEN 0D ELSE power({coordinate_sum('x * y', 'r', 'zip_with(v, c, (x, y) -> x - y)')}, 2) / rr END"
    rest = first.withColumn("r", F.expr(f"zip_with(v, {c}[first], (x, y) -> x - y)")).withColumn("rr", F.expr(coordinate_sum("x * y", "r", "r")))
    second = rest.withColumn("second", F.expr(f"array_min(filter(transform({c}, (c, k) -> struct({score} AS s, k AS k)), s -> s.k <> first)).k"))
    return second.select("id", "v", F.explode(F.array("first", "second")).alias("list_no"))


# -- product quantization and its relatives

def codebook(x: np.ndarray, m: int, ksub: int, steps: int = 25) -> np.ndarray:
    """m codebooks of ksub centroids for equal pieces of the coordinates."""
    d = x.shape[1] // m
    return np.stack([lloyd(x[:, j * d : (j + 1) * d], ksub, steps) for j in range(m)])


def pq_encode(df: DataFrame, books, vec: str = "v") -> DataFrame:
    """df with `code`: the nearest centroid of each piece, ties to the lower number."""
    m, d = len(books), len(books[0][0])
    near = f"array_min(transform(book, (c, k) -> struct({coordinate_sum('(x - y) * (x - y)', 'c', f'slice({vec}, j * {d} + 1, {d})')} AS d, k AS k))).k"
    return df.withColumn("code", F.expr(f"transform({literal(books)}, (book, j) -> {near})"))


def pq_tables(queries: DataFrame, books, query: str = "q") -> DataFrame:
    """queries with `lut`: squared distances of each piece to each centroid."""
    d = len(books[0][0])
    return queries.withColumn("lut", F.expr(f"transform({literal(books)}, (book, j) -> transform(book, c -> {coordinate_sum('(x - y) * (x - y)', f'slice({query}, j * {d} + 1, {d})', 'c')}))"))


def adc(lut: str = "lut", code: str = "code") -> Column:
    """Asymmetric distance: table entries of the code, added up."""
    return F.expr(f"aggregate(transform({code}, (c, j) -> {lut}[j][c]), 0D, (a, x) -> a + x)")


def pq_search(codes: DataFrame, queries: DataFrame, books, k: int) -> DataFrame:
    pairs = codes.join(F.broadcast(pq_tables(queries, books).select("qid", "lut")))
    return top_k(pairs.select("qid", "id", adc().alias("dist")), k)


def pq_symmetric(codes: DataFrame, queries: DataFrame, books, k: int) -> DataFrame:
    """Both sides coded; distances between centroids."""
    decoded = pq_encode(queries, books, "q").withColumn("q", pq_decode(books))
    return pq_search(codes, decoded.select("qid", "q"), books, k)


def pq_decode(books, code: str = "code") -> Column:
    return F.expr(f"flatten(transform({code}, (c, j) -> {literal(books)}[j][c]))")


def polysemous(codes: DataFrame, queries: DataFrame, books, k: int, most: int) -> DataFrame:
    """Only codes that differ from the query's in at most `most` pieces get a distance."""
    coded = pq_tables(pq_encode(queries, books, "q").withColumnRenamed("code", "qcode"), books).select("qid", "lut", "qcode")
    pairs = codes.join(F.broadcast(coded)).where(F.expr(coordinate_sum("CASE WHEN x <> y THEN 1 ELSE 0 END", "qcode", "code")) <= most)
    return top_k(pairs.select("qid", "id", adc().alias("dist")), k)


def residuals(assigned: DataFrame, centroids) -> DataFrame:
    """Rows with a list_no, with `r`: what the list's centroid leaves of v."""
    return assigned.withColumn("r", F.expr(f"zip_with(v, {literal(centroids)}[list_no], (x, y) -> x - y)"))


def residual_pq_pairs(codes: DataFrame, probes: DataFrame, centroids, books) -> DataFrame:
    """(qid, id, dist) of codes (id, list_no, code) of residuals in the lists that queries probe (qid, q, list_no): each
    list has its own table of distances for a query."""
    rest = probes.withColumn("r", F.expr(f"zip_with(q, {literal(centroids)}[list_no], (x, y) -> x - y)"))
    tables = pq_tables(rest, books, "r").select("qid", "list_no", "lut")
    return codes.join(F.broadcast(tables) if checked(tables, 65_536) else tables, "list_no").select("qid", "id", adc().alias("dist"))


def residual_encode(df: DataFrame, stages) -> DataFrame:
    """Greedy residual quantizer: each stage codes what the stages before it left."""
    out = df.withColumn("rest", F.col("v")).withColumn("code", F.expr("array()").cast("array<int>"))
    for book in stages:
        near = f"array_min(transform({literal(book)}, (c, k) -> struct({coordinate_sum('(x - y) * (x - y)', 'c', 'rest')} AS d, k AS k))).k"
        out = out.withColumn("_k", F.expr(near)).withColumn("rest", F.expr(f"zip_with(rest, {literal(book)}[_k], (x, y) -> x - y)")).withColumn("code", F.expr("concat(code, array(_k))")).drop("_k")
    return out


def scalar_quantize(df: DataFrame, low, high, bits: int = 8) -> DataFrame:
    """df with `code`: each coordinate on a grid of 2**bits steps between its bounds."""
    top = (1 << bits) - 1
    return df.withColumn("code", F.expr(f"zip_with(v, arrays_zip({literal(low)}, {literal(high)}), (x, b) -> CAST(least({top}D, greatest(0D, floor(CASE WHEN b['1'] > b['0'] THEN (x - b['0']) / (b['1'] - b['0']) ELSE 0D END * {top} + 0.5D))) AS INT))"))


def scalar_decode(low, high, bits: int = 8) -> Column:
    top = (1 << bits) - 1
    return F.expr(f"zip_with(code, arrays_zip({literal(low)}, {literal(high)}), (c, b) -> b['0'] + (b['1'] - b['0']) * c / {top}D)")


def bit_allocation(variances: np.ndarray, budget: int, least: int = 1, most: int = 8) -> list[int]:
    """Bits for each piece: one after another to the piece with the largest variance that is left (each bit takes a
    quarter), between the bounds."""
    bits = [least] * len(variances)
    left = np.array(variances, np.float64) / 4.0**least
    for _ in range(budget - least * len(variances)):
        open_ones = [j for j in range(len(bits)) if bits[j] < most]
        if not open_ones:
            break
        j = max(open_ones, key=lambda j: left[j])
        bits[j] += 1
        left[j] /= 4
    return bits


def variance_aware(x: np.ndarray, pieces: int, budget: int, least: int = 1, most: int = 8, steps: int = 10) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Mean, rotation to principal axes in order of variance, and codebooks with bits by variance."""
    mean = x.mean(0)
    values, axes = np.linalg.eigh(np.cov((x - mean).T))
    order = np.argsort(-values)
    axes = axes[:, order]
    y, d = (x - mean) @ axes, x.shape[1] // pieces
    share = values[order].reshape(pieces, d).sum(1)
    bits = bit_allocation(share, budget, least, most)
    return mean, axes, [lloyd(y[:, j * d : (j + 1) * d], min(1 << bits[j], len(y)), steps) for j in range(pieces)]


# -- hashing

def hyperplanes(n: int, d: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, d)).round(6)


def sign_codes(df: DataFrame, planes, vec: str = "v", name: str = "bits") -> DataFrame:
    return df.withColumn(name, F.transform(linear(planes, vec), lambda x: F.when(x >= 0, 1).otherwise(0)))


def sign_search(base: DataFrame, queries: DataFrame, planes, k: int) -> DataFrame:
    """Hamming distances between sign codes. Codes are made in blocks where they are compared, as words of 64 bits; k rows of each
    query and task leave it."""
    shape = regular(base, queries, "l2")
    if shape is None or dict(base.dtypes)["id"] != "bigint" or dict(queries.dtypes)["qid"] != "bigint" or not base.where("id IS NULL").isEmpty():
        return sign_columns(base, queries, planes, k)
    planes = np.asarray(planes, np.float64)

    def kernel(ids, q, parts):
        codes, n = sign_words(q, planes), len(q)
        a, i, d, bound = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.full(n, np.iinfo(np.uint16).max, np.uint16)
        for own, v in parts:
            words, found = sign_words(v, planes), []
            for m in range(0, n, TILE_QUERIES):
                top = bound[m : m + TILE_QUERIES]
                far = np.concatenate([word_distances(codes[:, m : m + TILE_QUERIES], words[:, r : r + 4 * TILE_ROWS]) for r in range(0, len(own), 4 * TILE_ROWS)], 1)
                if len(own) > k and (top == np.iinfo(np.uint16).max).any():
                    top = np.minimum(top, np.partition(far, k - 1, axis=1)[:, k - 1])
                x, y = np.nonzero(far <= top[:, None])
                found.append([x + m, own[y], far[x, y].astype(np.int64)])
            a, i, d = [np.concatenate(c) for c in zip([a, i, d], *found)]
            order = np.lexsort((i, d, a))
            a, i, d = a[order], i[order], d[order]
            starts = np.searchsorted(a, np.arange(n + 1))
            full = np.flatnonzero(np.diff(starts) >= k)
            bound[full] = d[starts[full] + k - 1]
            kept = np.arange(len(a)) - starts[a] < k
            a, i, d = a[kept], i[kept], d[kept]
        return [ids.take(pa.array(a)), pa.array(i), pa.array(d.astype(np.float64))]

    return top_k(met(in_tasks(base.select("id", "v"), *shape), queries, kernel), k)


def sign_columns(base: DataFrame, queries: DataFrame, planes, k: int) -> DataFrame:
    """The same by column expressions, for any vectors."""
    b, q = sign_codes(base, planes).select("id", "bits"), sign_codes(queries, planes, "q", "qbits").select("qid", "qbits")
    pairs = b.join(F.broadcast(q)).select("qid", "id", F.expr(coordinate_sum("CASE WHEN x <> y THEN 1 ELSE 0 END", "qbits", "bits")).alias("dist"))
    return top_k(pairs, k)


def sign_words(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sign codes as words (words x rows); products that may have either sign are summed from left to right, as columns are."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = x @ planes.T
        off = 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps * np.sqrt((x * x).sum(1))[:, None] * np.sqrt((planes * planes).sum(1)) + 1e-300
        a, b = np.nonzero(~(np.abs(s) > off))
    for m in range(0, len(a), 1 << 16):
        s[a[m : m + (1 << 16)], b[m : m + (1 << 16)]] = exact_block(BLOCKS["inner_product"], x[a[m : m + (1 << 16)]], planes[b[m : m + (1 << 16)]], True)
    bits = np.packbits(~(s < 0), axis=1)
    out = np.zeros((len(x), -(-bits.shape[1] // 8) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return np.ascontiguousarray(out.view(np.uint64).T)


def word_distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Differing bits of each code of q (words x codes) with each of v."""
    out = np.zeros((q.shape[1], v.shape[1]), np.uint16)
    for x, y in zip(q, v):
        out += np.bitwise_count(x[:, None] ^ y)
    return out


def bit_word(bits: str, first: int, n: int) -> Column:
    return F.expr(f"aggregate(transform(slice({bits}, {first + 1}, {n}), (x, i) -> shiftleft(CAST(x AS BIGINT), i)), CAST(0 AS BIGINT), (a, x) -> a | x)")


def binary_hash_search(base: DataFrame, queries: DataFrame, planes, k: int, n_bits: int, tables: int = 1, flips: int = 1) -> DataFrame:
    """Buckets by n_bits of the code for each table; queries probe all buckets within `flips` flipped bits."""
    masks = [0]
    for _ in range(flips):
        masks = sorted({m ^ (1 << j) for m in masks for j in range(n_bits)} | set(masks))
    b = sign_codes(base, planes)
    keyed = lambda df, bits: F.posexplode(F.array(*[bit_word(bits, t * n_bits, n_bits) for t in range(tables)])).alias("t", "key")
    rows = b.select("id", "bits", keyed(b, "bits"))
    q = sign_codes(queries, planes, "q", "qbits")
    probes = q.select("qid", "qbits", keyed(q, "qbits")).withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).select("qid", "qbits", "t", F.expr("key ^ mask").alias("key"))
    pairs = rows.join(probes, ["t", "key"]).select("qid", "id", F.expr(coordinate_sum("CASE WHEN x <> y THEN 1 ELSE 0 END", "qbits", "bits")).alias("dist")).distinct()
    return top_k(pairs, k)


def projected(df: DataFrame, matrix, vec: str, name: str = "p") -> DataFrame:
    return df.withColumn(name, linear(matrix, vec))


def collision_search(base: DataFrame, queries: DataFrame, matrix, k: int, width: float, least: int) -> DataFrame:
    """Query-aware hashing: rows that lie within width / 2 of the query in `least` projections or more are verified.
    The band join runs over cells of that width and the two beside them."""
    def cells(df: DataFrame, vec: str) -> DataFrame:
        return projected(df, matrix, vec).select("*", F.posexplode("p").alias("t", "x")).withColumn("cell", F.floor(F.col("x") / width))

    b = cells(base, "v").select("id", "t", F.col("x").alias("bx"), "cell")
    q = cells(queries, "q").select("qid", "t", "x", F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell"))
    hits = b.join(F.broadcast(q), ["t", "cell"]).where(F.abs(F.col("x") - F.col("bx")) <= width / 2).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    exact = hits.join(base, "id").join(F.broadcast(queries), "qid")
    return top_k(exact.select("qid", "id", distance("l2").alias("dist")), k)


# -- trees

def forest(x: np.ndarray, trees: int, leaf: int, seed: int) -> list[list[tuple[np.ndarray, float]]]:
    """Hyperplanes of random-projection trees trained on a sample: heap-ordered, each the bisector of two points."""
    rng = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(max(len(x) / leaf, 2)))))
    out = []
    for _ in range(trees):
        nodes: list[tuple[np.ndarray, float]] = [None] * ((1 << depth) - 1)  # type: ignore[list-item]
        parts = {0: np.arange(len(x))}
        for n in range(len(nodes)):
            own = parts.pop(n)
            a, b = x[rng.choice(own, 2, replace=len(own) < 2)] if len(own) else rng.standard_normal((2, x.shape[1]))
            w = (a - b).round(6)
            t = float(((a + b) / 2 @ w).round(6))
            nodes[n] = (w, t)
            side = x[own] @ w >= t
            parts[2 * n + 1], parts[2 * n + 2] = own[~side], own[side]
        out.append(nodes)
    return out


def leaves_of(x: np.ndarray, trees) -> np.ndarray:
    """The leaf of each row in each tree. Rows go down all trees in blocks, a level at a time."""
    out = np.zeros((len(x), len(trees)), np.int32)
    for t, nodes in enumerate(trees):
        planes, cuts = np.array([w for w, _ in nodes]), np.array([c for _, c in nodes])
        n = np.zeros(len(x), np.int64)
        for _ in range((len(nodes) + 1).bit_length() - 1):
            n = 2 * n + 1 + (np.einsum("ij,ij->i", planes[n], x) >= cuts[n])
        out[:, t] = n
    return out


def leaf_codes(df: DataFrame, trees, vec: str = "v") -> DataFrame:
    """df with one row for each tree: tree number and leaf."""
    names = df.columns

    def run(batches):
        for batch in batches:
            x = batch.column(names.index(vec)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), len(trees))))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(np.tile(np.arange(len(trees), dtype=np.int32), batch.num_rows)), pa.array(leaves_of(x, trees).ravel())], [*names, "tree", "leaf"])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "tree int, leaf int"]))


def forest_search(base: DataFrame, queries: DataFrame, trees, k: int) -> DataFrame:
    """Rows that share a leaf with the query in some tree, verified exactly where they are: k rows for each query and task
    leave it, and no row is repeated for each tree."""
    def kernel(ids, q, parts):
        asked, best = leaves_of(q, trees), [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        for own, v in parts:
            leaves = leaves_of(v, trees)
            for i in range(0, len(v), TILE_ROWS):
                found = []
                for j in range(0, len(q), TILE_QUERIES):
                    shared = np.zeros((len(q[j : j + TILE_QUERIES]), len(v[i : i + TILE_ROWS])), bool)
                    for t in range(len(trees)):
                        shared |= asked[j : j + TILE_QUERIES, t, None] == leaves[None, i : i + TILE_ROWS, t]
                    a, b = np.nonzero(shared)
                    d = exact_block(BLOCKS["l2"], q[j + a], v[i + b], True)
                    near = np.full(shared.shape, np.inf)
                    near[a, b] = d
                    if k < near.shape[1]:  # a tile's nearest, with all ties
                        first = d <= np.partition(near, k - 1, axis=1)[a, k - 1]
                        a, b, d = a[first], b[first], d[first]
                    found.append((j + a, own[i + b], d))
                best = [np.concatenate([x, *y]) for x, y in zip(best, zip(*found))]
                if len(best[0]) > 8 * k * len(q):
                    best = [x.to_numpy() for x in first_of(pa.array(np.arange(len(q))), *best, k)]
        return first_of(ids, *best, k)

    return top_k(met(base, queries, kernel), k)


# -- graphs

def knn_graph(base: DataFrame, k: int) -> DataFrame:
    """(src, pos, dst, dist): the k nearest others of every row, exactly. Rows meet in blocks of the base table."""
    from lodestar.operators.search import knn

    found = knn(base, base.select(F.col("id").alias("qid"), F.col("v").alias("q")), k + 1).where("qid <> id")
    ranked = found.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")))
    return ranked.where(F.col("pos") <= k).select(F.col("qid").alias("src"), "pos", F.col("id").alias("dst"), "dist")


def random_graph(base: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """k pseudo-random neighbours of every row, among rows with neighbouring hashes (no all-pairs step)."""
    parts = []
    for j in range(k):
        order = Window.partitionBy("_p").orderBy("_h")
        h = base.select("id", F.xxhash64("id", F.lit(seed + j)).alias("_h")).withColumn("_p", F.pmod(F.shiftright("_h", 40), F.lit(64)))
        parts.append(h.select(F.col("id").alias("src"), F.coalesce(F.lead("id").over(order), F.first("id").over(order)).alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("src <> dst").distinct()


def slim(base: DataFrame) -> DataFrame:
    """id and v, as floats where these hold the same values: half the bytes of a shuffle."""
    wide = base.agg(F.max(F.expr("exists(v, x -> x <> double(float(x)))"))).first()[0]
    return base.select("id", "v" if wide else F.col("v").cast("array<float>").alias("v"))


def whole_groups(batches):
    """Batches ordered by their first column, cut anew so that none ends within a group."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if rest and rest[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest)


def members_of(key: np.ndarray, most: int = SLICE_PAIRS >> 4):
    """Places of the rows of each group (groups x largest size, -1 beyond a group's end), in blocks of groups of about one size
    whose pairs are at most `most`, or of a single group."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    order = np.argsort(sizes, kind="stable")
    n = len(order)
    while n:
        m = int(sizes[order[n - 1]])
        own = order[max(n - max(1, most // (m * m)), 0) : n]
        n -= len(own)
        at = np.arange(m)[None]
        yield np.where(at < sizes[own, None], starts[own, None] + at, -1)


def distances_within(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances of all pairs of each group, as `distance("l2")` computes them (groups x members x members)."""
    x = np.ascontiguousarray(np.moveaxis(v[at], 2, 0))
    out = np.zeros((*at.shape, at.shape[1]))
    for c in x:
        d = c[:, :, None] - c[:, None, :]
        d *= d
        out += d
    return np.sqrt(out, out=out)


def meeting(members: DataFrame, rows: int, order: list[str], kernel, kinds: str) -> DataFrame:
    """`kernel(table)` of whole groups of `members`, of `rows` rows or so, by its first column, in tasks of MEMBER_ROWS."""
    key, names = members.columns[0], [x.split()[0] for x in kinds.split(", ")]

    def run(batches):
        for table in whole_groups(batches):
            for columns in kernel(table.combine_chunks()):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return members.repartition(max(1, -(-rows // MEMBER_ROWS)), key).sortWithinPartitions(key, *order).mapInArrow(run, kinds)


def nn_descent(base: DataFrame, k: int, rounds: int = 6, save=None) -> DataFrame:
    """Neighbours of neighbours become candidates, the k best stay; rounds are written so that plans stay short. A row's
    candidates are at most (2k)^2: reverse edges are cut at k by a hash. Candidates are scored where their common neighbour
    stands, which gets the vector of each of its neighbours once; of a row's pairs there only the k nearest go on, and none
    farther than the last of its k neighbours so far."""
    save = save or (lambda df: df.checkpoint())
    even = regular(base, base.select(F.col("id").alias("qid"), F.col("v").alias("q")), "l2")
    vec = slim(base)

    def scored(edges: DataFrame) -> DataFrame:
        both = edges.select("src", "dst").distinct().join(vec.select(F.col("id").alias("dst"), "v"), "dst").join(vec.select(F.col("id").alias("src"), F.col("v").alias("q")), "src")
        return both.select("src", "dst", F.col("q").cast("array<double>").alias("q"), F.col("v").cast("array<double>").alias("v")).select("src", "dst", distance("l2").alias("dist"))

    def best(edges: DataFrame) -> DataFrame:
        w = Window.partitionBy("src").orderBy("dist", "dst")
        return edges.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)

    def kernel(table: pa.Table):
        key, own, reach, v = table.column("mid").to_numpy(), table.column("id").to_numpy(), table.column("reach").to_numpy(), matrix_of(table.column("v"))
        for at in members_of(key):
            d, ids = distances_within(v, at), own[at]
            open_ones = (at >= 0)[:, :, None] & (at >= 0)[:, None, :] & (ids[:, :, None] != ids[:, None, :]) & (d <= reach[at][:, :, None])
            d[~open_ones] = np.inf
            if k < d.shape[2]:  # a row's nearest, with all ties
                open_ones &= d <= np.partition(d, k - 1, axis=2)[:, :, k - 1 : k]
            g, a, b = np.nonzero(open_ones)
            yield ids[g, a], ids[g, b], d[g, a, b]

    now = save(best(scored(random_graph(base, k))))
    for r in range(rounds):
        back = now.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")
        back = back.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy(F.xxhash64("dst", F.lit(r))))).where(F.col("_n") <= k).drop("_n")
        near = now.select("src", "dst").unionByName(back.select("src", "dst")).distinct()
        if even is None:
            two = near.select(F.col("src").alias("mid"), F.col("dst").alias("a")).join(near.select(F.col("src").alias("mid"), F.col("dst").alias("b")), "mid").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
            fresh = scored(two.distinct())
        else:
            reach = now.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("reach"))
            rows = vec.join(reach, "id", "left").select("id", F.coalesce("reach", F.lit(float("inf"))).alias("reach"), "v")
            members = near.select(F.col("src").alias("mid"), F.col("dst").alias("id")).join(rows, "id").select("mid", "id", "reach", "v")
            fresh = meeting(members, 2 * k * even[0], ["id"], kernel, "src long, dst long, dist double")
        found = now.select("src", "dst", "dist").unionByName(back).unionByName(fresh)
        found = found.repartition(-(-2 * k * even[0] // MEMBER_ROWS), "src") if even else found
        now = save(best(found.groupBy("src", "dst").agg(F.min("dist").alias("dist"))).select("src", "dst", "dist", "pos"))
    return now


def occlusion_prune(graph: DataFrame, base: DataFrame, degree: int) -> DataFrame:
    """Edges (src, dst) that no shorter edge (src, mid) with mid nearer to dst occludes; at most `degree` of each. A row's
    neighbours meet where it stands, each with its vector once."""
    even = regular(base, base.select(F.col("id").alias("qid"), F.col("v").alias("q")), "l2")
    edges = graph.select("src", "dst", "dist")
    if even is None:
        return occluded_by_columns(edges, base, degree)

    def kernel(table: pa.Table):
        src, dst, dist, v = (table.column(c) for c in ("src", "dst", "dist", "v"))
        src, dst, dist, v = src.to_numpy(), dst.to_numpy(), dist.to_numpy(), matrix_of(v)
        for at in members_of(src):
            own = np.where(at >= 0, dist[at], np.inf)
            if at.shape[1] ** 2 <= SLICE_PAIRS:
                d = distances_within(v, at)
                hidden = ((own[:, :, None] < own[:, None, :]) & (d < own[:, None, :])).any(1)
            else:  # a large group, in tiles
                hidden = np.zeros(at.shape, bool)
                for x, near, out in zip((v[n] for n in at), own, hidden):
                    for i in range(0, len(x), TILE_QUERIES):
                        for j in range(0, len(x), TILE_ROWS):
                            d, far = exact_block(BLOCKS["l2"], x[i : i + TILE_QUERIES], x[j : j + TILE_ROWS]), near[None, j : j + TILE_ROWS]
                            out[j : j + TILE_ROWS] |= ((near[i : i + TILE_QUERIES, None] < far) & (d < far)).any(0)
            kept = (at >= 0) & ~hidden  # members stand by (dist, dst)
            pos = np.cumsum(kept, axis=1)
            kept &= pos <= degree
            yield src[at[kept]], pos[kept].astype(np.int32), dst[at[kept]], dist[at[kept]]

    members = edges.join(slim(base).withColumnRenamed("id", "dst"), "dst").select("src", "dst", "dist", "v")
    return meeting(members, 2 * degree * even[0], ["dist", "dst"], kernel, "src long, pos int, dst long, dist double")


def occluded_by_columns(graph: DataFrame, base: DataFrame, degree: int) -> DataFrame:
    """The same for vectors that numpy blocks do not take."""
    vec = base.select(F.col("id"), "v")
    two = graph.select("src", F.col("dst").alias("mid"), F.col("dist").alias("mid_dist")).join(graph.select("src", "dst", "dist"), "src").where("mid_dist < dist")
    pairs = two.join(vec.select(F.col("id").alias("mid"), F.col("v").alias("q")), "mid").join(vec.select(F.col("id").alias("dst"), "v"), "dst")
    hidden = pairs.where(distance("l2") < F.col("dist")).select("src", "dst").distinct()
    left = graph.join(hidden, ["src", "dst"], "left_anti")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("pos") <= degree).select("src", "pos", "dst", "dist")


def matrix_of(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def graph_search(graph: DataFrame, base: DataFrame, queries: DataFrame, k: int, beam: int = 32, hops: int = 12, entries: list[int] | None = None, save=None, start: DataFrame | None = None) -> DataFrame:
    """Beam search for all queries at once: each hop expands the unexpanded rows of every query's beam by a join with the
    edges; a hop's frontier is bounded by queries * beam * degree, and beams are written."""
    save = save or (lambda df: df.checkpoint())
    vec = slim(base)
    if start is None:
        seeds = entries or [r.id for r in base.orderBy(F.xxhash64("id")).limit(4).collect()]
        start = queries.select("qid", F.explode(F.array(*[F.lit(x).cast("long") for x in seeds])).alias("id"))

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.join(vec, "id").join(F.broadcast(queries), "qid").withColumn("v", F.col("v").cast("array<double>"))
        return both.select("qid", "id", distance("l2").alias("dist"), F.lit(False).alias("seen"))

    def best(pairs: DataFrame) -> DataFrame:
        w = Window.partitionBy("qid").orderBy("dist", "id")
        return pairs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= beam).drop("_n")

    now = save(best(scored(start)))
    for _ in range(hops):
        open_ones = now.where("NOT seen")
        if open_ones.isEmpty():
            break
        new = open_ones.join(graph.select(F.col("src").alias("id"), "dst"), "id").select("qid", F.col("dst").alias("id")).distinct().join(now.select("qid", "id"), ["qid", "id"], "left_anti")
        now = save(best(now.withColumn("seen", F.lit(True)).unionByName(scored(new))))
    return top_k(now, k)
