"""Further access methods: multi-indexes, spilling policies, spectral and query-aware hashing, additive codes, 1-D k-means."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.distances import BLOCKS, coordinate_sum, distance, exact_block
from lodestar.functions.vectors import linear
from lodestar.operators.indexes import assign, hyperplanes, literal, lloyd, residual_encode
from lodestar.operators.pivots import box_pairs, boxes_of
from lodestar.operators.search import QUERY_BLOCK, SLICE_PAIRS, TILE_QUERIES, TILE_ROWS, first_of, knn, listed, met, regular, top_k

# -- inverted lists


def search_preassigned(lists: DataFrame, probes: DataFrame, k: int, measure: str = "l2") -> DataFrame:
    """probes: qid, q, list_no as the caller chose them. Results carry the list they come from."""
    found = listed(lists, probes, k) if measure == "l2" else None
    if found is not None:
        return found
    pairs = lists.join(F.broadcast(probes), "list_no").select("qid", "id", distance(measure).alias("dist"), "list_no")
    best = pairs.groupBy("qid", "id").agg(F.min(F.struct("dist", "list_no")).alias("b")).select("qid", "id", "b.dist", "b.list_no")
    return top_k(best, k, extra=["list_no"])


def spilling_probes(queries: DataFrame, centroids, policy: str, value: float) -> DataFrame:
    """Lists for each query by a spilling policy: `none`, `fixed` (so many), `additive` (within value of the nearest
    distance), `multiplicative` (within value times it), `absolute` (within value)."""
    ranked = assign(queries, centroids, len(centroids), "q").withColumn("list_dist", F.sqrt("list_dist"))
    w = Window.partitionBy("qid")
    least = F.min("list_dist").over(w)
    rank = F.row_number().over(w.orderBy("list_dist", "list_no"))
    keep = {"none": rank == 1, "fixed": rank <= value, "additive": F.col("list_dist") <= least + value, "multiplicative": F.col("list_dist") <= least * value, "absolute": (F.col("list_dist") <= value) | (rank == 1)}
    if policy not in keep:
        raise ValueError(f"unknown spilling policy {policy!r}; known: {', '.join(keep)}")
    return ranked.withColumn("_keep", keep[policy]).where("_keep").drop("_keep")


def dedup_lists(lists: DataFrame) -> DataFrame:
    """Equal vectors of a list stored once, with all their ids."""
    return lists.groupBy("list_no", "v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("id", F.col("ids")[0])


def dedup_search(deduped: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """k nearest of the distinct vectors, then every id of them, then the k nearest of those."""
    found = top_k(deduped.join(F.broadcast(probes), "list_no").select("qid", "id", distance("l2").alias("dist"), "ids"), k, extra=["ids"])
    return top_k(found.select("qid", F.explode("ids").alias("id"), "dist"), k)


def multi_assign(df: DataFrame, halves, n: int = 1, vec: str = "v") -> DataFrame:
    """Cells of the product of two codebooks for the halves of a vector: the n with the least sums of distances. Cell
    numbers are i * size + j."""
    a, b = halves
    d = len(a[0])
    near = lambda book, start: f"transform({literal(book)}, (c, k) -> struct({coordinate_sum('(x - y) * (x - y)', 'c', f'slice({vec}, {start}, {d})')} AS d, k AS k))"
    out = df.withColumn("_a", F.expr(near(a, 1))).withColumn("_b", F.expr(near(b, d + 1)))
    cells = f"slice(array_sort(flatten(transform(_a, s -> transform(_b, t -> struct(s.d + t.d AS d, CAST(s.k * {len(b)} + t.k AS INT) AS list_no))))), 1, {n})"
    return out.withColumn("_near", F.explode(F.expr(cells))).select(*df.columns, F.col("_near.list_no").alias("list_no"), F.col("_near.d").alias("list_dist"))


def multi_search(base: DataFrame, queries: DataFrame, halves, k: int, nprobe: int) -> DataFrame:
    return search_preassigned(multi_assign(base, halves).drop("list_dist"), multi_assign(queries, halves, nprobe, "q").drop("list_dist"), k).drop("list_no")


def crowded_by(pairs: DataFrame, quotas: dict[str, int], k: int) -> DataFrame:
    """Quotas on several attributes at once, the tighter rank of each row counting."""
    out = pairs
    for n, (attribute, quota) in enumerate(quotas.items()):
        out = out.withColumn(f"_r{n}", F.row_number().over(Window.partitionBy("qid", attribute).orderBy("dist", "id"))).where(F.col(f"_r{n}") <= quota).drop(f"_r{n}")
    return top_k(out, k, extra=list(quotas))


# -- codes


def product_residual_books(x: np.ndarray, pieces: int, stages: int, ksub: int, steps: int = 10) -> list[list[np.ndarray]]:
    d, out = x.shape[1] // pieces, []
    for j in range(pieces):
        y, own = x[:, j * d : (j + 1) * d].copy(), []
        for _ in range(stages):
            c = lloyd(y, ksub, steps)
            y = y - c[((y[:, None] - c[None]) ** 2).sum(2).argmin(1)]
            own.append(c)
        out.append(own)
    return out


def product_residual_encode(df: DataFrame, books) -> DataFrame:
    """A residual code for each piece; `rest` is what they leave together."""
    d, out = len(books[0][0][0]), df.withColumn("_whole", F.col("v"))
    for j, stages in enumerate(books):
        out = residual_encode(out.withColumn("v", F.slice("_whole", j * d + 1, d)), stages).withColumnRenamed("code", f"_code{j}").withColumnRenamed("rest", f"_rest{j}")
    n = range(len(books))
    return out.select(*[c for c in df.columns if c != "v"], F.col("_whole").alias("v"), F.concat(*[f"_code{j}" for j in n]).alias("code"), F.concat(*[f"_rest{j}" for j in n]).alias("rest"))


def anisotropic_encode(df: DataFrame, books, threshold: float = 0.2, passes: int = 2) -> DataFrame:
    """Codes that weigh the error along the vector more than across it: weight eta = (d - 1) t^2 / (1 - t^2). Coordinate
    descent: from the nearest centroids, each pass chooses piece by piece the centroid with the least weighted error of
    the whole vector, given the other pieces' errors along it."""
    m, d = len(books), len(books[0][0])
    eta = (m * d - 1) * threshold**2 / (1 - threshold**2)
    piece = f"slice(v, j * {d} + 1, {d})"
    # for each piece and centroid: s, the error, and p, the error along the vector
    terms = f"transform({literal(books)}, (book, j) -> transform(book, (c, k) -> struct({coordinate_sum('(x - y) * (x - y)', 'c', piece)} AS s, {coordinate_sum('(x - y) * x', piece, 'c')} AS p, k AS k)))"
    out = df.withColumn("_n2", F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).withColumn("_t", F.expr(terms))
    out = out.withColumn("code", F.expr("transform(_t, own -> array_min(transform(own, e -> struct(e.s AS s, e.k AS k))).k)"))
    weight = f"{eta - 1}D / CASE WHEN _n2 = 0 THEN 1D ELSE _n2 END"
    for _ in range(passes):
        for j in range(m):
            rest = f"aggregate(transform(code, (c, i) -> CASE WHEN i = {j} THEN 0D ELSE _t[i][c].p END), 0D, (a, x) -> a + x)"
            best = f"array_min(transform(_t[{j}], e -> struct(e.s + {weight} * power(_rest + e.p, 2) AS s, e.k AS k))).k"
            out = out.withColumn("_rest", F.expr(rest)).withColumn("code", F.expr(f"transform(code, (c, i) -> CASE WHEN i = {j} THEN {best} ELSE c END)"))
    return out.drop("_n2", "_t", "_rest")


def kmeans_1d(x: np.ndarray, k: int) -> np.ndarray:
    """Optimal centroids of one coordinate: dynamic programming over the sorted values."""
    x = np.sort(np.asarray(x, np.float64))
    n, k = len(x), min(k, len(x))
    s, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    cost = lambda a, b: s2[b] - s2[a] - (s[b] - s[a]) ** 2 / np.maximum(b - a, 1)
    best, cuts = cost(np.zeros(n + 1, int), np.arange(n + 1)), []
    for _ in range(1, k):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for b in range(1, n + 1):
            a = np.arange(b)
            total = best[:b] + cost(a, np.full(b, b))
            cut[b] = int(total.argmin())
            new[b] = total[cut[b]]
        best, cuts = new, [*cuts, cut]
    ends, b = [], n
    for cut in reversed(cuts):
        ends.append((cut[b], b))
        b = cut[b]
    ends.append((0, b))
    return np.array([x[a:b].mean() if b > a else x[0] for a, b in reversed(ends)])


# -- hashing


def spectral_bits(df: DataFrame, axes: np.ndarray, mean: np.ndarray, period: float, vec: str = "v", name: str = "bits") -> DataFrame:
    """Bits that alternate along each principal axis with a period."""
    return df.withColumn(name, F.transform(linear(axes.T, vec, -(mean @ axes)), lambda x: F.pmod(F.floor(x / period), F.lit(2)).cast("int")))


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def collision_probability(p: float, width: float, distance_: float) -> float:
    """That a row lies within width / 2 of the query in a p-stable projection (2: Gaussian, 1: Cauchy)."""
    if p == 2:
        return 1 - 2 * normal_cdf(-width / (2 * distance_))
    if p == 1:
        return 2 / math.pi * math.atan(width / (2 * distance_))
    raise ValueError("closed forms exist for p = 1 and p = 2")


def query_aware_parameters(n: int, c: float = 2.0, p: float = 2, false_share: float | None = None, error: float = 1 / math.e) -> dict:
    """Width, number of tables and collision threshold for an approximation ratio."""
    beta = false_share or 100 / n
    width = math.sqrt(8 * c * c * math.log(c) / (c * c - 1)) if p == 2 else 2 * math.sqrt(c)
    p1, p2 = collision_probability(p, width, 1), collision_probability(p, width, c)
    eta = math.sqrt(math.log(2 / beta) / math.log(1 / error))
    m = math.ceil((math.sqrt(math.log(2 / beta)) + math.sqrt(math.log(1 / error))) ** 2 / (2 * (p1 - p2) ** 2))
    return {"width": width, "tables": m, "threshold": math.ceil((eta * p1 + p2) / (1 + eta) * m), "p1": p1, "p2": p2}


def in_place(base: DataFrame, queries: DataFrame, maps: list, inside: Callable, k: int, save) -> Callable | None:
    """A function of (queries, radius) for `_rounds`: candidates are found by their projections and verified where they are. Rows
    are written once, with their projections behind their coordinates; of each task's candidates the k nearest leave it. `inside`
    tells from the projections of queries and rows and the radius which pairs are candidates. None for odd vectors."""
    shape = regular(base, queries, "l2")
    if shape is None:
        return None
    low = lambda vec: F.concat(vec, *[linear(m, vec) for m in maps])
    rows = save(base.select("id", low("v").alias("v")).repartition(max(1, -(-shape[0] * min(shape[1], QUERY_BLOCK) // SLICE_PAIRS))))
    d = len(maps[0][0])

    def near(open_ones: DataFrame, radius: float) -> DataFrame:
        def kernel(ids, q, parts):
            qs, ql = q[:, :d], q[:, d:]
            qq, place = (qs * qs).sum(1), pa.array(np.arange(len(q)))
            best, reach = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], np.full(len(q), np.inf)
            for own, x in parts:
                v, vl = x[:, :d], x[:, d:]
                vv, found = (v * v).sum(1), [best]
                for i in range(0, len(v), TILE_ROWS):
                    for j in range(0, len(q), TILE_QUERIES):
                        met_ones = inside(ql[j : j + TILE_QUERIES], vl[i : i + TILE_ROWS], radius)
                        scale = qq[j : j + TILE_QUERIES, None] + vv[None, i : i + TILE_ROWS]
                        gap = np.where(met_ones, scale - 2 * (qs[j : j + TILE_QUERIES] @ v[i : i + TILE_ROWS].T), np.inf)
                        most = reach[j : j + TILE_QUERIES, None] ** 2
                        if k < gap.shape[1]:
                            most = np.minimum(most, np.partition(gap, k - 1, axis=1)[:, k - 1 : k])
                        a, b = np.nonzero(met_ones & (gap <= most + 1e-9 * scale))  # what rounding may hide stays
                        found.append([j + a, own[i + b], exact_block(BLOCKS["l2"], qs[j + a], v[i + b], True)])
                best = [c.to_numpy() for c in first_of(place, *[np.concatenate(c) for c in zip(*found)], k)]
                n = np.bincount(best[0], minlength=len(q))
                np.maximum.at(reach := np.where(n >= k, 0.0, np.inf), best[0], best[2])
            return first_of(ids, *best, k)

        return met(rows, open_ones.select("qid", low("q").alias("q")), kernel)

    return near


def _rounds(candidates: Callable[[DataFrame, float], DataFrame] | None, near: Callable | None, base: DataFrame, queries: DataFrame, k: int, start: float, c: float, save, most: float = 2.0**40) -> DataFrame:
    """Radius rounds for all queries at once, by the k nearest candidates of each task (`near`) or by candidate pairs: each takes all rows of its radius, then queries whose k-th distance is within
    c * radius are settled. What is found only grows with the radius. Queries that are still open beyond the radius `most`
    (tables of less than k rows, distances beyond it) are compared with every row, so no list is cut short."""
    open_ones, done, radius = queries, None, start
    n = base.limit(k).count()
    while radius <= most and n >= k:
        pairs = near(open_ones, radius) if near else candidates(open_ones, radius).join(base.select("id", "v"), "id").join(F.broadcast(open_ones), "qid").select("qid", "id", distance("l2").alias("dist"))  # type: ignore[misc]
        found = save(top_k(pairs, k))
        settled = found.where(F.col("rank") == k).where(F.col("dist") <= c * radius).select("qid")
        part = found.join(settled, "qid", "left_semi")
        done = part if done is None else done.unionByName(part)
        open_ones = save(open_ones.join(settled, "qid", "left_anti"))
        if open_ones.isEmpty():
            return done
        radius *= c
    exact = knn(base, open_ones, k)
    return exact if done is None else done.unionByName(exact)


def query_aware_search(base: DataFrame, queries: DataFrame, k: int, c: float = 2.0, start: float = 0.5, seed: int = 5, tables: int | None = None, save=None) -> DataFrame:
    """Query-aware hashing with virtual rehashing: collisions within width * radius / 2, counted over the tables."""
    save = save or (lambda df: df.checkpoint())
    n = base.count()
    known = query_aware_parameters(max(n, 101), c)
    m = tables or known["tables"]
    least = max(1, math.ceil(known["threshold"] * m / known["tables"]))
    matrix = hyperplanes(m, len(base.first().v), seed)

    def collides(q: np.ndarray, v: np.ndarray, radius: float) -> np.ndarray:
        half, n = known["width"] * radius / 2, np.zeros((len(q), len(v)), np.int16)
        for x, y in zip(q.T, np.ascontiguousarray(v.T)):
            n += np.abs(x[:, None] - y) <= half
        return n >= least

    near = in_place(base, queries, [matrix], collides, k, save)
    if near:
        return _rounds(None, near, base, queries, k, start, c, save)
    keys = save(base.select("id", F.posexplode(linear(matrix, "v")).alias("t", "x")))

    def candidates(open_ones: DataFrame, radius: float) -> DataFrame:
        width = known["width"] * radius
        q = open_ones.select("qid", F.posexplode(linear(matrix, "q")).alias("t", "y")).withColumn("cell", F.explode(F.expr(f"array(floor(y / {width}D) - 1, floor(y / {width}D), floor(y / {width}D) + 1)")))
        hit = keys.withColumn("cell", F.floor(F.col("x") / width)).join(F.broadcast(q), ["t", "cell"]).where(F.abs(F.col("x") - F.col("y")) <= width / 2)
        return hit.groupBy("qid", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("qid", "id")

    return _rounds(candidates, None, base, queries, k, start, c, save)


def dynamic_bucket_search(base: DataFrame, queries: DataFrame, k: int, c: float = 1.5, start: float = 0.3, tables: int = 5, dims: int = 4, seed: int = 6, save=None) -> DataFrame:
    """Boxes around the query's projection, in several tables, whose half-width 2 c^2 * radius grows by rounds."""
    save = save or (lambda df: df.checkpoint())
    d = len(base.first().v)
    maps = [hyperplanes(dims, d, seed + t) for t in range(tables)]

    def boxed(q: np.ndarray, v: np.ndarray, radius: float) -> np.ndarray:
        half, found, rows = 2 * c * c * radius, np.zeros((len(q), len(v)), bool), np.ascontiguousarray(v.T)
        for t in range(0, tables * dims, dims):
            box = np.abs(q[:, t, None] - rows[t]) <= half
            for j in range(t + 1, t + dims):
                box &= np.abs(q[:, j, None] - rows[j]) <= half
            found |= box
        return found

    near = in_place(base, queries, maps, boxed, k, save)
    if near:
        return _rounds(None, near, base, queries, k, start, c, save)
    keys = save(boxes_of(base, "v", maps, "p").drop("v"))

    def candidates(open_ones: DataFrame, radius: float) -> DataFrame:
        return box_pairs(keys, boxes_of(open_ones, "q", maps, "q"), tables, 2 * c * c * radius)

    return _rounds(candidates, None, base, queries, k, start, c, save)


def chi_square_quantile(m: int, share: float = 0.99) -> float:
    """Wilson and Hilferty's approximation."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < share else (lo, mid)
    return m * (1 - 2 / (9 * m) + lo * math.sqrt(2 / (9 * m))) ** 3
