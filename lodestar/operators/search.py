"""Exact search: k nearest neighbours and range joins of a stated query set against a base table.

Results are long tables (qid, rank, id, dist) ordered by (dist, id); lists shorter than k are shorter. Two physical paths
give the same rows: block search (queries in blocks of bounded size go to every base partition, which keeps its k best
by numpy and so shuffles at most k rows for each query and task), and all pairs (tiles of numpy rows, or columns for measures
and vectors that those do not take).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.distances import BLOCKS, NOT_NEGATIVE, block_distance, distance, exact_block, is_similarity, near_block
from lodestar.functions.digests import first_words
from lodestar.functions.numbers import rounded, rounded_block, rounded_near

#: Queries that are shipped to every task; more are dealt out in blocks of this size, to chunks of so many rows.
QUERY_BLOCK, CHUNK_ROWS = 4096, 1 << 16
#: All pairs: a tile that stays in a core's cache, rows and queries of one group, pairs of one task.
TILE_QUERIES, TILE_ROWS, MEET_ROWS, TASK_PAIRS = 64, 512, 2048, 1 << 23
#: Most rows and queries of one group where all pairs leave it tile by tile, so that only its queries and a batch of rows are held;
#: smaller tables give about so many groups.
STREAM_ROWS, STREAM_TASKS = 1 << 14, 128
#: Measures whose order is that of squared distances, so that matrix products tell which pairs can be near.
SQUARED = {"l2", "l2_sq"}
#: Distances that a block search holds at once.
SLICE_PAIRS = 1 << 22


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *more: str) -> DataFrame:
    """Base table: id, v (doubles) and attributes."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more)


def queries_of(base: DataFrame, condition: str = "id % 100 = 0") -> DataFrame:
    """The stated query set: every row whose id is divisible by 100, so it grows with the table."""
    return base.where(condition).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def top_k(pairs: DataFrame, k: int, by: list[Column] | None = None, extra: list[str] | None = None) -> DataFrame:
    """The k first rows of each qid by (dist, id); a row limit per partition comes before the shuffle."""
    order = by or [F.col("dist"), F.col("id")]
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "id", "dist", *(extra or []))


def all_pairs(base: DataFrame, queries: DataFrame, measure: str | Column = "l2", within: tuple[float | None, float | None] = (None, None), first: int | None = None, least: int | None = None, digits: int | None = None, times: dict[str, float] | None = None) -> DataFrame:
    """Distances of the stated queries to every row; with `within`, those that are at least the first and less than the
    second bound; with `first`, at least so many of each query's nearest (for its `top_k`; of similarities the largest); with
    `least`, at least all that are smaller than the so-manieth smallest of all, and so many (for `range_at_most`). Measures with
    numpy terms are computed in tiles of pairs, left to right in double as the column path does, so both give the same
    doubles; a tile's pairs of one query leave it as arrays, or the whole tile if it has all its pairs. With `digits` distances
    are rounded as Spark does it; a product then tells all but those near half-way, which alone are summed from left to right.
    With `times` there is a column of distances to each row times a factor, by its name, in place of `dist`, of all pairs.
    Few queries are shipped to every task, more are dealt out in blocks."""
    if (digits is not None or times) and (within != (None, None) or first or least):
        raise ValueError("only distances of all pairs are rounded, or taken of multiples")
    shape = regular(base, queries, measure) if isinstance(measure, str) and measure in BLOCKS else None
    if shape is None and times:
        far = lambda f: distance(measure, "q", f"transform(v, x -> {float(f)!r}D * x)")
        pairs = column_pairs(base, queries, F.struct(*[(far(f) if digits is None else F.round(far(f), digits)).alias(c) for c, f in times.items()]))
        return pairs.select("qid", "id", "dist.*", *[c for c in base.columns if c not in ("id", "v")])
    if shape is None:
        pairs = column_pairs(base, queries, measure)
        pairs = pairs if digits is None else pairs.withColumn("dist", rounded("dist", digits))
        low, high = within
        pairs = pairs if low is None else pairs.where(F.col("dist") >= low)
        return pairs if high is None else pairs.where(F.col("dist") < high)
    (rows, asked), block = shape, BLOCKS[measure]  # type: ignore[index]
    tasks = -(-rows * asked // TASK_PAIRS) if asked <= QUERY_BLOCK else 1
    long = dict(base.dtypes)["id"] == dict(queries.dtypes)["qid"] == "bigint"
    if first and within[1] is None and measure in SQUARED and long and base.columns == ["id", "v"] and base.where("id IS NULL").isEmpty():
        return met(base.repartition(tasks) if tasks > 1 else base, queries, lambda ids, q, parts: closest(block, measure == "l2", ids, q, parts, first, within[0]))
    root, similar = {"l2": True, "l2_sq": False}.get(measure), is_similarity(measure)  # type: ignore[arg-type]
    keep = [c for c in base.columns if c not in ("id", "v")]
    made = [*(times or ["dist"])]
    names = ["qid", "id", *made, *keep]
    types = {f.name: f.dataType.simpleString() for f in [*base.schema.fields, queries.schema["qid"]]} | dict.fromkeys(made, "double")
    every = within == (None, None) and not first and not least
    kinds = ", ".join(f"`{n}` {types[n]}" if n == "qid" and not every else f"`{n}` array<{types[n]}>" for n in names)

    def whole_tiles(ids, q, owns):
        for own in owns:
            v, at = _matrix(_whole(own.column("v"))), [_whole(own.column(c)) for c in ("id", *keep)]
            for i in range(0, len(v), TILE_ROWS):
                for j in range(0, len(q), TILE_QUERIES):
                    x, y = q[j : j + TILE_QUERIES], v[i : i + TILE_ROWS]
                    multiples = [y] if not times else [y * f for f in times.values()]
                    d = [exact_block(block, x, z) if digits is None else rounded_tile(measure, block, x, z, digits) for z in multiples]  # type: ignore[arg-type]
                    columns = [ids.slice(j, len(x)), at[0].slice(i, len(y)), *[pa.array(z.reshape(-1)) for z in d], *[c.slice(i, len(y)) for c in at[1:]]]
                    yield [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]

    def some_tiles(ids, q, owns):
        smallest, bound = np.empty(0), within[1]
        for own in owns:
            v, at = _matrix(_whole(own.column("v"))), [_whole(own.column(c)) for c in ("id", *keep)]
            for i in range(0, len(v), TILE_ROWS):
                for j in range(0, len(q), TILE_QUERIES):
                    x, y = q[j : j + TILE_QUERIES], v[i : i + TILE_ROWS]
                    a, b, d = block_pairs(block, root, x, y, within[0], bound)
                    if least and len(d):
                        if len(d) > least:
                            near = np.sort(np.argpartition(d, least - 1)[:least])
                            a, b, d = a[near], b[near], d[near]
                        smallest = np.sort(np.concatenate([smallest, d]))[:least]
                        bound = smallest[-1] if len(smallest) == least else bound
                    if first and first < len(y) and len(d):  # a tile's nearest, with all ties
                        near = np.full((len(x), len(y)), np.inf)
                        near[a, b] = -d if similar else d
                        inside = near[a, b] <= np.partition(near, first - 1, axis=1)[a, first - 1]
                        a, b, d = a[inside], b[inside], d[inside]
                    if len(d):
                        ends = pa.array(np.searchsorted(a, np.arange(len(x) + 1)).astype(np.int32))
                        lists = [c.take(pa.array(b + i)) for c in at]
                        yield [ids.slice(j, len(x)), *[pa.ListArray.from_arrays(ends, c) for c in (lists[0], pa.array(d), *lists[1:])]]

    tiles = whole_tiles if every else some_tiles

    def single(pairs: DataFrame) -> DataFrame:
        if every:
            asking = pairs.select("id", *made, *keep, F.posexplode("qid").alias("_query", "qid"))
            placed = asking.select("qid", *made, *keep, (F.col("_query") * F.size("id")).alias("_from"), F.posexplode("id").alias("_place", "id"))
            return placed.select("qid", "id", *[F.col(n)[F.col("_from") + F.col("_place")].alias(n) for n in made], *[F.col(n)[F.col("_place")].alias(n) for n in keep])
        arrays = [n for n in names if n not in ("qid", "dist")]
        placed = pairs.select("qid", *arrays, F.posexplode("dist").alias("_place", "dist"))
        return placed.select(*[F.col(n)[F.col("_place")].alias(n) if n in arrays else n for n in names])

    rows_only = base.select("id", "v", *keep)
    if asked <= QUERY_BLOCK:
        known = queries.select("qid", "q").toArrow().combine_chunks()
        ids, q = _whole(known.column("qid")), _matrix(_whole(known.column("q")))
        spread = rows_only.repartition(tasks) if tasks > 1 else rows_only

        def run(batches):
            for columns in tiles(ids, q, batches):
                yield pa.RecordBatch.from_arrays(columns, names)

        return single(spread.mapInArrow(run, kinds))
    if every:
        return single(streamed(rows_only, queries.select("qid", "q"), (rows, asked), tiles, names, kinds))
    most = max(QUERY_BLOCK, CHUNK_ROWS) if least else MEET_ROWS  # with `least` a group of any size gives few rows
    own, asking = dealt(rows_only, queries.select("qid", "q"), sizes=(min(asked, QUERY_BLOCK, most), min(CHUNK_ROWS, most)), counts=(asked, rows))
    flat = _arrow_schema(base, queries, names)
    out = pa.schema([(f.name, f.type if f.name == "qid" else pa.list_(f.type)) for f in flat])

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        parts = [pa.RecordBatch.from_arrays(c, names) for c in tiles(_whole(right.column("qid")), _matrix(_whole(right.column("q"))), [left])]
        return pa.Table.from_batches(parts) if parts else out.empty_table()

    return single(own.groupBy("_chunk", "_block").cogroup(asking.groupBy("_chunk", "_block")).applyInArrow(meet, kinds))


def streamed(rows: DataFrame, queries: DataFrame, counts: tuple[int, int], tiles, names: list[str], kinds: str) -> DataFrame:
    """`tiles(qids, q, batches of rows)` of each chunk of rows and block of queries, in a task for each of these groups. Its
    queries come first and are held, rows pass in batches, so groups can be large and each row is shipped few times."""
    n, asked = counts
    size = min(max(int((n * asked / STREAM_TASKS) ** 0.5), MEET_ROWS), STREAM_ROWS)
    block, chunk = min(asked, size), size
    own, asking = dealt(slim(rows, "v"), slim(queries, "q"), sizes=(block, chunk), counts=(asked, n))
    blocks, chunks = -(-asked // block), -(-n // chunk) or 1
    group, columns = (F.col("_chunk") * F.lit(blocks) + F.col("_block")).cast("int").alias("_group"), [c for c in rows.columns if c != "v"]
    wide = "array<double>" if "array<double>" in (dict(own.dtypes)["v"], dict(asking.dtypes)["q"]) else "array<float>"
    first = asking.select(group, F.lit(0).alias("_side"), "qid", F.col("q").cast(wide).alias("_v"))
    rest = own.select(group, F.lit(1).alias("_side"), F.col("v").cast(wide).alias("_v"), *columns)

    def run(batches):
        held, ids, q, now = [], None, None, None
        for batch in batches:
            key = 2 * batch.column(0).to_numpy().astype(np.int64) + batch.column(1).to_numpy()
            ends = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else []
            for m, e in zip(ends[:-1], ends[1:]):
                part = batch.slice(m, e - m)
                if key[m] // 2 != now:
                    now, held, q = key[m] // 2, [], None
                if key[m] % 2 == 0:
                    held.append(part.select(["qid", "_v"]))
                elif held:
                    if q is None:
                        asking_ = pa.Table.from_batches(held)
                        ids, q = _whole(asking_.column("qid")), _matrix(_whole(asking_.column("_v")))
                    for made in tiles(ids, q, [part.rename_columns(["v" if c == "_v" else c for c in part.schema.names])]):
                        yield pa.RecordBatch.from_arrays(made, names)

    both = first.unionByName(rest, allowMissingColumns=True).repartitionById(min(blocks * chunks, 1 << 14), "_group")
    return both.sortWithinPartitions("_group", "_side").mapInArrow(run, kinds)


def slim(df: DataFrame, vec: str) -> DataFrame:
    """Vectors as floats where these hold the same values: half the bytes of a shuffle."""
    wide = df.agg(F.max(F.expr(f"exists({vec}, x -> x <> double(float(x)))"))).first()[0]
    return df if wide else df.withColumn(vec, F.col(vec).cast("array<float>"))


def rounded_tile(measure: str, block, x: np.ndarray, y: np.ndarray, digits: int) -> np.ndarray:
    """`rounded_block` of `exact_block`; sums from left to right are taken only of pairs near half-way, if others can be told."""
    near = near_block(measure, x, y)
    if near is None:
        return rounded_block(exact_block(block, x, y), digits)
    return rounded_near(*near, digits, lambda a, b: exact_block(block, x[a], y[b], True))


def squares(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and a bound of how far they and the sums from left to right are apart (not
    finite where squares pass the range of doubles)."""
    with np.errstate(over="ignore", invalid="ignore"):
        own, other = (q * q).sum(1), (v * v).sum(1)
        d = q @ v.T
        d *= -2.0
        d += own[:, None]
        d += other
        return d, float(8 * (q.shape[1] + 4) * np.finfo(np.float64).eps * (own.max(initial=0.0) + other.max(initial=0.0)) + 1e-300)


def _square_of(root: bool, x):
    """A distance in squares, and how much rounding may add to it."""
    s = x * x if root else x
    return s, np.abs(s) * 1e-12


def block_pairs(block, root: bool | None, x: np.ndarray, y: np.ndarray, low: float | None, high: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x and y and distances of the pairs that are at least `low` and less than `high`, by places. Of Euclidean
    distances (`root`) and their squares (not `root`; of others it is None) under a bound, products tell which pairs can be; only those are computed in the order of the coordinates."""
    a = None
    if high is not None and root is not None:
        near, off = squares(x, y)
        if np.isfinite(off):
            s, more = _square_of(root, high)
            a, b = np.nonzero(near < s + more + off)
            if len(a) > near.size // 8:
                a = None
    if a is None:
        d = exact_block(block, x, y)
        if low is None and high is None:
            return np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)), d.reshape(-1)
        a, b = np.nonzero((d >= (-np.inf if low is None else low)) & (d < high if high is not None else True))
        return a, b, d[a, b]
    d = exact_block(block, x[a], y[b], True) if len(a) else np.empty(0)
    inside = (d < high) if low is None else (d < high) & (d >= low)
    return a[inside], b[inside], d[inside]


def closest(block, root: bool, ids: pa.Array, q: np.ndarray, parts, k: int, low: float | None) -> list:
    """qid, id and distance of each query's k nearest rows by (distance, id), of those at distance `low` or more, for Euclidean
    distances or (without `root`) their squares. Products tell which pairs can be among them, ties with them; those are computed exactly."""
    a, i, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    bound = np.full(len(q), np.inf)
    step = max(k, SLICE_PAIRS // max(len(q), 1), 1)
    for own, v in parts:
        for n in range(0, len(own), step):
            w = v[n : n + step]
            near, off = squares(q, w)
            if np.isfinite(off):
                top = np.full(len(q), np.inf)
                inside = None
                if low is not None:
                    s, more = _square_of(root, low)
                    inside = near >= s - more - off
                if np.isinf(bound).any() and near.shape[1] >= k:  # the k-th of those that surely count
                    sure = near if low is None else np.where(near > s + more + off, near, np.inf)
                    top = np.partition(sure, k - 1, axis=1)[:, k - 1]
                s, more = _square_of(root, bound)
                top = np.minimum(top + np.abs(top) * 1e-12 + off, s + more) + off
                under = near <= top[:, None]
                at, b = np.nonzero(under if inside is None else under & inside)
                far = [exact_block(block, q[at[m : m + (1 << 16)]], w[b[m : m + (1 << 16)]], True) for m in range(0, len(at), 1 << 16)]
                far = np.concatenate(far) if far else np.empty(0)
            else:
                at, b = np.repeat(np.arange(len(q)), len(w)), np.tile(np.arange(len(w)), len(q))
                far = exact_block(block, q, w).reshape(-1)
            if low is not None:
                at, b, far = at[far >= low], b[far >= low], far[far >= low]
            if not len(at):
                continue
            a, i, d = np.concatenate([a, at]), np.concatenate([i, own[n + b]]), np.concatenate([d, far])
            order = np.lexsort((i, d, a))
            a, i, d = a[order], i[order], d[order]
            starts = np.searchsorted(a, np.arange(len(q) + 1))
            kept = np.arange(len(a)) - starts[a] < k
            full = np.flatnonzero(np.diff(starts) >= k)
            bound[full] = d[starts[full] + k - 1]
            a, i, d = a[kept], i[kept], d[kept]
    return [ids.take(pa.array(a)), pa.array(i), pa.array(d)]


def _arrow_schema(base: DataFrame, queries: DataFrame, names: list[str]) -> pa.Schema:
    empty = base.limit(0).crossJoin(queries.select("qid").limit(0)).withColumn("dist", F.lit(0.0)).select(*names)
    return empty.toArrow().schema


def _whole(column) -> pa.Array:
    """A column of a table or a batch as one array."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def regular(base: DataFrame, queries: DataFrame, measure: str) -> tuple[int, int] | None:
    """Numbers of rows and queries if all vectors are finite, without nulls and of one length; else None."""
    odd = "NOT (abs(x) < double('Infinity'))" if measure not in NOT_NEGATIVE else "NOT (x >= 0 AND x < double('Infinity'))"

    def counted(df: DataFrame, vec: str):
        bad = F.expr(f"{vec} IS NULL OR exists({vec}, x -> x IS NULL OR {odd})")
        return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(bad), F.lit(False)).alias("bad"), F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("most")).first()

    rows, asked = counted(base, "v"), counted(queries, "q")
    lengths = {rows.least, rows.most, asked.least, asked.most}
    return None if rows.bad or asked.bad or len(lengths) != 1 or not rows.least or rows.least < 1 else (rows.n, asked.n)


def column_pairs(base: DataFrame, queries: DataFrame, measure: str | Column = "l2") -> DataFrame:
    """Distances of the stated queries to every row by column expressions, for any measure and any vectors."""
    dist = distance(measure) if isinstance(measure, str) else measure
    keep = [c for c in base.columns if c not in ("id", "v")]
    if checked(queries):
        return base.join(F.broadcast(queries)).select("qid", "id", dist.alias("dist"), *keep)
    rows, asked = dealt(base, queries)
    return rows.join(asked, ["_chunk", "_block"]).select("qid", "id", dist.alias("dist"), *keep)


def dealt(base: DataFrame, queries: DataFrame, key: str = "id", sizes: tuple[int, int] | None = None, counts: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with columns _chunk and _block, so that each row meets each query in one pair of a chunk of rows and a
    block of queries: rows are repeated for each block, queries for each chunk. Both have a bounded size."""
    block, chunk = sizes or (QUERY_BLOCK, CHUNK_ROWS)
    asked, rows = counts or (queries.count(), base.count())
    blocks, chunks = -(-asked // block) or 1, -(-rows // chunk) or 1
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return base.withColumn("_chunk", of(key, chunks)).withColumn("_block", every(blocks)), queries.withColumn("_block", of("qid", blocks)).withColumn("_chunk", every(chunks))


def checked(queries: DataFrame, most: int | None = None) -> bool:
    """Whether the query set is small enough to broadcast: a count of at most `most` (QUERY_BLOCK) + 1 rows."""
    most = QUERY_BLOCK if most is None else most
    return queries.limit(most + 1).count() <= most


def knn_columns(base: DataFrame, queries: DataFrame, k: int, measure: str | Column = "l2") -> DataFrame:
    pairs = all_pairs(base.select("id", "v") if isinstance(measure, str) else base, queries, measure, first=k)
    first = F.col("dist").desc() if isinstance(measure, str) and is_similarity(measure) else F.col("dist").asc()
    return top_k(pairs, k, [first, F.col("id").asc()])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    """A matrix as an array column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def nearest_rows(near, q: np.ndarray, parts, take_most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and vectors of each query's nearest rows (queries x rows) of parts of (ids, vectors), by a block measure. Parts are
    taken in slices, so that a matrix of distances has SLICE_PAIRS entries at most."""
    best_d = best_i = best_v = None
    step = max(take_most, SLICE_PAIRS // max(len(q), 1), 1)
    for own, v in parts:
        near_d = near_at = None
        for n in range(0, len(own), step):  # places only, vectors once for a part
            d = near(q, v[n : n + step])
            take = min(take_most, d.shape[1])
            at = np.argpartition(d, take - 1, axis=1)[:, :take] if take < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
            d, at = np.take_along_axis(d, at, 1), at + n
            near_d, near_at = (d, at) if near_d is None else _merged(near_d, near_at, d, at, take_most)
        if near_d is None:
            continue
        d, i, w = near_d, own[near_at], v[near_at]
        if best_d is not None:
            d, i, w = np.concatenate([best_d, d], 1), np.concatenate([best_i, i], 1), np.concatenate([best_v, w], 1)
            at = np.argsort(d, axis=1, kind="stable")[:, : min(take_most, d.shape[1])]
            d, i, w = np.take_along_axis(d, at, 1), np.take_along_axis(i, at, 1), np.take_along_axis(w, at[:, :, None], 1)
        best_d, best_i, best_v = d, i, w
    return None if best_d is None else (best_i, best_v)


def _merged(d: np.ndarray, at: np.ndarray, more_d: np.ndarray, more_at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` smallest of two lists of each query."""
    d, at = np.concatenate([d, more_d], 1), np.concatenate([at, more_at], 1)
    if d.shape[1] <= most:
        return d, at
    first = np.argpartition(d, most - 1, axis=1)[:, :most]
    return np.take_along_axis(d, first, 1), np.take_along_axis(at, first, 1)


def first_of(ids: pa.Array, a: np.ndarray, own: np.ndarray, d: np.ndarray, k: int, similar: bool = False) -> list:
    """qid, id and distance of the k first pairs of each query by (distance, id); pairs are (query's place, id, distance)."""
    order = np.lexsort((own, -d if similar else d, a))
    a, own, d = a[order], own[order], d[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    kept = rank < k
    return [ids.take(pa.array(a[kept])), pa.array(own[kept]), pa.array(d[kept])]


def met(base: DataFrame, queries: DataFrame, kernel, kinds: str = "qid long, id long, dist double", row_columns: tuple[str, ...] = ("v",), query_columns: tuple[str, ...] = ("q",)) -> DataFrame:
    """Columns of `kernel(qids, q, parts)`, where parts yields the ids and vectors (or `row_columns`) of rows; `query_columns` are
    given in place of q. Each query meets each row in one call. Up to QUERY_BLOCK queries are shipped to every task; more stay on
    the executors, in blocks that meet chunks of rows."""
    names = [x.split()[0] for x in kinds.split(", ")]
    known = queries.select("qid", *query_columns).limit(QUERY_BLOCK + 1).toArrow().combine_chunks()
    rows = base.select("id", *row_columns)
    plain = lambda c: (_matrix(c) if c.type.value_type == pa.float64() else c) if pa.types.is_list(c.type) else c.to_numpy()
    parts = lambda batches: ((b.column(0).to_numpy(), *[plain(c) for c in b.columns[1:]]) for b in batches if b.num_rows)
    given = lambda t: [_whole(t.column("qid")), *[plain(_whole(t.column(c))) for c in query_columns]]
    if known.num_rows <= QUERY_BLOCK:
        asking = given(known) if known.num_rows else None

        def run(batches):
            if asking is not None:
                yield pa.RecordBatch.from_arrays(kernel(*asking, parts(batches)), names)

        return rows.mapInArrow(run, kinds)
    own, asked = dealt(rows, queries.select("qid", *query_columns))
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}

    def meet(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], types[x.split()[1]]) for x in kinds.split(", ")], names)
        return pa.table(kernel(*given(right), parts(left.select(["id", *row_columns]).to_batches())), names)

    return own.groupBy("_chunk", "_block").cogroup(asked.groupBy("_chunk", "_block")).applyInArrow(meet, kinds)


def in_tasks(base: DataFrame, rows: int, asked: int) -> DataFrame:
    """base in tasks of TASK_PAIRS, where the queries are shipped to each."""
    tasks = -(-rows * asked // TASK_PAIRS) if asked <= QUERY_BLOCK else 1
    return base.repartition(tasks) if tasks > 1 else base


class Nearest:
    """The k nearest rows of each query by (distance, id) so far, with the list that a row came from. With `distinct` an id counts
    once for a query, at its least distance and then list. `bound` holds the k-th distance of queries that have k."""

    def __init__(self, q: np.ndarray, k: int, distinct: bool):
        self.q, self.k, self.distinct, self.bound = q, k, distinct, np.full(len(q), np.inf)
        self.kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        self.new, self.waiting = [], 0

    def add(self, at: np.ndarray, own: np.ndarray, v: np.ndarray, list_no: int) -> None:
        """Rows of one list for the queries at some places. Products tell which pairs can be among the nearest, ties with them;
        those are computed from left to right."""
        x = self.q[at]
        near, off = squares(x, v)
        if np.isfinite(off):
            bound = self.bound[at]
            top = bound * bound * (1 + 1e-12) + off
            first = np.isinf(top)
            if first.any() and len(own) >= self.k and (not self.distinct or len(np.unique(own)) == len(own)):
                least = np.partition(near[first], self.k - 1, axis=1)[:, self.k - 1]
                top[first] = least + np.abs(least) * 1e-12 + 2 * off
            a, b = np.nonzero(near <= top[:, None])
        else:
            a, b = np.repeat(np.arange(len(x)), len(v)), np.tile(np.arange(len(v)), len(x))
        if not len(a):
            return
        d = np.concatenate([exact_block(BLOCKS["l2"], x[a[m : m + (1 << 16)]], v[b[m : m + (1 << 16)]], True) for m in range(0, len(a), 1 << 16)])
        self.new.append([at[a], own[b], d, np.full(len(a), list_no, np.int64)])
        self.waiting += len(a)
        if self.waiting > 1 << 18:
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        a, i, d, n = [np.concatenate(c) for c in zip(self.kept, *self.new)]
        self.new, self.waiting = [], 0
        if self.distinct:
            order = np.lexsort((n, d, i, a))
            a, i, d, n = a[order], i[order], d[order], n[order]
            once = np.r_[True, (a[1:] != a[:-1]) | (i[1:] != i[:-1])]
            a, i, d, n = a[once], i[once], d[once], n[once]
        order = np.lexsort((n, i, d, a))
        a, i, d, n = a[order], i[order], d[order], n[order]
        starts = np.searchsorted(a, np.arange(len(self.q) + 1))
        full = np.flatnonzero(np.diff(starts) >= self.k)
        self.bound[full] = d[starts[full] + self.k - 1]
        kept = np.arange(len(a)) - starts[a] < self.k
        self.kept = [a[kept], i[kept], d[kept], n[kept]]

    def columns(self, ids: pa.Array) -> list:
        self.settle()
        a, i, d, n = self.kept
        return [ids.take(pa.array(a)), pa.array(i), pa.array(d), pa.array(n.astype(np.int32))]


def by_list(lists: np.ndarray, order: np.ndarray):
    """(list_no, places) of the rows of each list, in an order."""
    sorted_ = lists[order]
    ends = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1], True]) if len(order) else []
    for m, e in zip(ends[:-1], ends[1:]):
        yield int(sorted_[m]), order[m:e]


def listed(lists: DataFrame, probes: DataFrame, k: int) -> DataFrame | None:
    """(qid, rank, id, dist, list_no): the k nearest rows, each id once, of the lists that a query probes. lists: id, v, list_no;
    probes: qid, q, list_no. Queries travel once with their lists' numbers; lists are met in blocks by matrix products. None for vectors
    that those do not take."""
    asking = probes.groupBy("qid", "q").agg(F.collect_set(F.col("list_no").cast("int")).alias("lists"))
    shape = regular(lists, asking, "l2")
    if shape is None or dict(lists.dtypes)["id"] != "bigint" or dict(probes.dtypes)["qid"] != "bigint" or not lists.where("id IS NULL OR list_no IS NULL").isEmpty():
        return None

    def kernel(ids, q, wanted, parts):
        best = Nearest(q, k, True)
        places = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
        asked = dict(by_list(wanted.flatten().to_numpy(), np.argsort(wanted.flatten().to_numpy(), kind="stable")))
        for own, v, numbers in parts:
            for number, at in by_list(numbers, np.argsort(numbers, kind="stable")):
                if number in asked:
                    here = np.sort(places[asked[number]])
                    step = max(k, SLICE_PAIRS // len(here))
                    for m in range(0, len(at), step):
                        best.add(here, own[at[m : m + step]], v[at[m : m + step]], number)
            best.settle()
        return best.columns(ids)

    own = in_tasks(lists.select("id", "v", F.col("list_no").cast("int").alias("list_no")), *shape)
    pairs = met(own, asking, kernel, "qid long, id long, dist double, list_no int", ("v", "list_no"), ("q", "lists"))
    best = pairs.groupBy("qid", "id").agg(F.min(F.struct("dist", "list_no")).alias("b")).select("qid", "id", "b.dist", "b.list_no")
    return top_k(best, k, extra=["list_no"])


def pruned(lists: DataFrame, reaches: DataFrame, k: int) -> DataFrame | None:
    """(qid, rank, id, dist): the k nearest rows of all lists; a query leaves out bands of a list's rows whose distances to the centroid
    differ from its own by more than its k-th distance so far. lists: id, v, list_no, apart (the distance to the centroid);
    reaches: qid, q, apart (distances to the centroids, by list_no). None for vectors that blocks do not take."""
    shape = regular(lists, reaches, "l2")
    if shape is None or dict(lists.dtypes)["id"] != "bigint" or dict(reaches.dtypes)["qid"] != "bigint" or not lists.where("id IS NULL OR list_no IS NULL").isEmpty():
        return None

    def kernel(ids, q, far, parts):
        best, nearest = Nearest(q, k, False), far.argmin(1)
        for own, v, numbers, apart in parts:
            bands = [(n, band) for n, at in by_list(numbers, np.lexsort((apart, numbers))) for band in np.array_split(at, -(-len(at) // max(k, TILE_ROWS)))]
            for last in (False, True):  # rows of a query's nearest list give it a bound
                for n, band in bands:
                    low, high = apart[band[0]], apart[band[-1]]
                    gap, slack = np.maximum(far[:, n] - high, low - far[:, n]), 1e-9 + 1e-9 * (far[:, n] + high)
                    here = np.flatnonzero(((nearest == n) != last) & (gap <= best.bound + slack))
                    for m in range(0, len(here), max(1, SLICE_PAIRS // len(band))):
                        best.add(here[m : m + max(1, SLICE_PAIRS // len(band))], own[band], v[band], n)
                best.settle()
        return best.columns(ids)[:3]

    own = in_tasks(lists.select("id", "v", F.col("list_no").cast("int").alias("list_no"), "apart"), *shape)
    return top_k(met(own, reaches, kernel, row_columns=("v", "list_no", "apart"), query_columns=("q", "apart")), k)


def knn(base: DataFrame, queries: DataFrame, k: int, measure: str = "l2", slack: int = 8) -> DataFrame:
    """Block search with `slack` more candidates for each task than k, whose distances are then computed anew, from left to
    right in double, so ids and distances are those of the column path; k rows for each query and task leave it."""
    near = block_distance(measure)
    if near is None or queries.isEmpty():
        return knn_columns(base, queries, k, measure)
    block, similar = BLOCKS[measure], is_similarity(measure)

    def kernel(ids, q, parts):
        best = nearest_rows(near, q, parts, k + slack)
        if best is None:
            return [ids.slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())]
        i, v = best
        d = np.concatenate([exact_block(block, np.repeat(q[n : n + 256], i.shape[1], 0), v[n : n + 256].reshape(-1, v.shape[2]), True) for n in range(0, len(q), 256)])
        return first_of(ids, np.repeat(np.arange(len(q)), i.shape[1]), i.reshape(-1), d, k, similar)

    return top_k(met(base, queries, kernel), k, [F.col("dist").desc() if similar else F.col("dist"), F.col("id")])


def random_rows(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id): k rows of each query by the least md5 of 'qid:id', then id. Only ids travel; hashes are made where they are
    compared, of which k for each query and task leave."""
    if {dict(base.dtypes)["id"], dict(queries.dtypes)["qid"]} != {"bigint"} or not (base.where("id IS NULL").isEmpty() and queries.where("qid IS NULL").isEmpty()):
        pairs = column_pairs(base.select("id"), queries.select("qid"), F.md5(F.concat(F.col("qid").cast("string"), F.lit(":"), F.col("id").cast("string"))))
        return top_k(pairs, k).select("qid", "id")

    def kernel(ids, parts):
        asked, best = ids.to_pylist(), [[] for _ in range(len(ids))]
        for (own,) in parts:
            rest = own.astype(str).astype("S")
            for n, qid in enumerate(asked):
                bound = best[n][-1][0] if len(best[n]) == k else None
                first = first_words(b"%d:" % qid, rest)
                limit = np.uint32(int(bound[:8], 16)) if bound else np.partition(first, k - 1)[k - 1] if len(own) > k else np.uint32(0xFFFFFFFF)
                at = np.flatnonzero(first <= limit)
                if len(at):
                    more = [(hashlib.md5(b"%d:%d" % (qid, i)).hexdigest(), i) for i in own[at].tolist()]
                    best[n] = sorted(best[n] + more)[:k]
        return [ids.take(pa.array(np.repeat(np.arange(len(asked)), [len(x) for x in best]))), pa.array([i for x in best for _, i in x], pa.int64()), pa.array([h for x in best for h, _ in x], pa.string())]

    return top_k(met(in_tasks(base.select("id"), base.count(), queries.count()), queries, kernel, "qid long, id long, dist string", (), ()), k).select("qid", "id")


def range_search(base: DataFrame, queries: DataFrame, radius: float, measure: str = "l2") -> DataFrame:
    """Rows with a distance under the radius (over it for similarities), strictly."""
    if is_similarity(measure):
        return all_pairs(base, queries, measure, (radius, None)).where(F.col("dist") > radius).select("qid", "id", "dist")
    return all_pairs(base, queries, measure, (None, radius)).select("qid", "id", "dist")


def range_at_most(pairs: DataFrame, most: int) -> DataFrame:
    """Range results shrunk to one radius for all queries, so that at most `most` rows remain: rows nearer than the
    (most + 1)-th smallest distance."""
    bound = pairs.select("dist").orderBy("dist").limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).first()
    return pairs if bound.n <= most else pairs.where(F.col("dist") < bound.r)


def crowded(pairs: DataFrame, attribute: str, quota: int, k: int) -> DataFrame:
    """At most `quota` neighbours of each attribute value, then the k nearest."""
    own = F.row_number().over(Window.partitionBy("qid", attribute).orderBy("dist", "id"))
    return top_k(pairs.withColumn("_own", own).where(F.col("_own") <= quota), k, extra=[attribute])


def refine(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, measure: str = "l2") -> DataFrame:
    """Exact distances of candidate pairs and the k best: joins fetch the vectors of the candidates only."""
    pairs = candidates.select("qid", "id").distinct().join(base.select("id", "v"), "id").join(queries, "qid")
    return top_k(pairs.select("qid", "id", distance(measure).alias("dist")), k, [F.col("dist").desc() if is_similarity(measure) else F.col("dist"), F.col("id")])
