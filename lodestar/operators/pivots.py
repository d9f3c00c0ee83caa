"""Projected hashing without comparing all rows: pivot rings and box cells as equi-joins.

A row's projection has a distance to each of a few pivots (far apart, of a bounded sample). It belongs to its nearest
pivot and, there, to a ring of distances. A ball of radius r around a query's projection meets only rows whose distances to
every pivot differ from the query's by r at most, so a query is joined with the rings it reaches of each pivot (and with no
ring beyond the pivot's farthest row), then filtered by the other pivots, then by the projected distance itself. A box meets
the cells of a grid of its own width: two in each dimension.

Nearest rows in the projection are found by balls that grow until each query has enough. All results are those of comparing
each query with every row. Null vectors are left out; repeated rows are rows of their own; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.distances import coordinate_sum, distance
from lodestar.functions.vectors import linear
from lodestar.operators.indexes import literal, training_rows
from lodestar.operators.search import top_k

PIVOTS, SAMPLE, ASKED = 8, 2048, 64
#: What rounding may take from a bound.
SLACK = 1e-6


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before; the first is the farthest from the mean."""
    least, chosen = ((x - x.mean(0)) ** 2).sum(1), []
    for _ in range(min(n, len(x))):
        k = int(least.argmax())
        if chosen and least[k] <= 0:
            break
        gap = ((x - x[k]) ** 2).sum(1)
        least = np.minimum(least, gap) if chosen else gap
        chosen.append(k)
    return x[chosen]


def pivot_distances(vec: str, pivots: np.ndarray) -> Column:
    return F.expr(f"transform({literal(pivots)}, c -> sqrt({coordinate_sum('(x - y) * (x - y)', 'c', vec)}))")


def ring_pairs(rows: DataFrame, asked: DataFrame, pivots: np.ndarray, width: float) -> DataFrame:
    """(qid, id, dist) of rows (id, v, own, ring_at, f0, f1, ...) and queries (qid, q, far_q, r) not farther apart than r."""
    cover = rows.groupBy("own").agg(F.max("ring_at").alias("cover"))  # a row for each pivot at most
    gaps = [F.col("far_q")[j].alias(f"g{j}") for j in range(len(pivots))]
    reach = asked.select("qid", "q", "r", *gaps, F.posexplode("far_q").alias("own", "at")).join(F.broadcast(cover), "own")
    first, last = F.floor(F.greatest(F.col("at") - F.col("r") - SLACK, F.lit(0.0)) / width), F.floor(F.least(F.col("at") + F.col("r") + SLACK, F.col("cover")) / width)
    reach = reach.where(first <= last).withColumn("cell", F.explode(F.sequence(first, last)))
    met = rows.withColumn("cell", F.floor(F.col("ring_at") / width)).join(reach, ["own", "cell"])
    for j in range(len(pivots)):  # plain comparisons of doubles, before any array is looked at
        met = met.where(F.abs(F.col(f"f{j}") - F.col(f"g{j}")) <= F.col("r") + SLACK)
    return met.select("qid", "id", distance("l2").alias("dist"), "r").where("dist <= r").select("qid", "id", "dist")


def nearest_projected(base: DataFrame, queries: DataFrame, matrix: np.ndarray, count: int, save, growth: float = 1.6) -> DataFrame:
    """The `count` nearest rows of each query by (distance in the projection, id): qid, rank, id, dist."""
    low = base.where("v IS NOT NULL").select("id", linear(matrix, "v").alias("v"))
    open_ones = queries.where("q IS NOT NULL").select("qid", linear(matrix, "q").alias("q"))
    sample = training_rows(low, SAMPLE)
    if not len(sample):
        return top_k(low.select(F.lit(0).cast("long").alias("qid"), "id", F.lit(0.0).alias("dist")).limit(0), count)
    pivots = far_apart(sample, PIVOTS)
    far = pivot_distances("v", pivots)
    rows = low.withColumn("far", far).withColumn("ring_at", F.array_min("far")).withColumn("own", (F.array_position("far", F.col("ring_at")) - 1).cast("int"))
    rows = save(rows.select("id", "v", "own", "ring_at", *[F.col("far")[j].alias(f"f{j}") for j in range(len(pivots))]))
    n = rows.count()
    wanted = min(count, n)
    some = np.array([r.q for r in open_ones.orderBy(F.xxhash64("qid")).limit(ASKED).collect()], np.float64)
    if not len(some):
        return top_k(low.select(F.lit(0).cast("long").alias("qid"), "id", F.lit(0.0).alias("dist")).limit(0), count)
    gaps = np.sort(np.sqrt(np.maximum((some**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * some @ sample.T, 0)), axis=1)
    radius = max(float(np.median(gaps[:, min(len(sample) - 1, int(1.1 * wanted * len(sample) / n))])), 1e-9)
    farthest = float(np.sqrt((np.abs(pivots).max() + 1) ** 2 * pivots.shape[1])) * 1e6
    open_ones, done = save(open_ones.withColumn("far_q", pivot_distances("q", pivots))), None
    while True:
        whole = radius > farthest  # every row is within it
        found = save(top_k(ring_pairs(rows, open_ones.withColumn("r", F.lit(radius)), pivots, max(radius / 2, 1e-9)), wanted))
        settled = found.where(F.col("rank") == wanted).select("qid")
        part = found.join(settled, "qid", "left_semi")
        done = part if done is None else done.unionByName(part)
        open_ones = save(open_ones.join(settled, "qid", "left_anti"))
        if whole or open_ones.isEmpty():
            return done
        radius *= growth


def projected_candidates(base: DataFrame, queries: DataFrame, matrix: np.ndarray, k: int, verify: int, save) -> DataFrame:
    """The `verify` rows nearest in the projection of each query, verified exactly."""
    chosen = nearest_projected(base, queries, matrix, verify, save).select("qid", "id")
    pairs = chosen.join(base.select("id", "v"), "id").join(queries.select("qid", "q"), "qid")
    return top_k(pairs.select("qid", "id", distance("l2").alias("dist")), k)


def box_pairs(keys: DataFrame, asked: DataFrame, tables: int, half: float) -> DataFrame:
    """Distinct (qid, id) of rows whose projection p0, p1, ... lies within `half` of the query's q0, q1, ... in every
    dimension of any table. Cells are as wide as the box, so a box meets two of them in each dimension at most, and a row
    is in one cell of each table."""
    width = 2 * half
    found = None
    for t in range(tables):
        rows = keys.select("id", F.col(f"p{t}").alias("p"), F.transform(f"p{t}", lambda x: F.floor(x / width)).alias("cell"))
        ends = F.transform(f"q{t}", lambda y: F.array_distinct(F.array(F.floor((y - half) / width), F.floor((y + half) / width))))
        product = F.aggregate(ends, F.expr("array(CAST(array() AS ARRAY<BIGINT>))"), lambda cells, two: F.flatten(F.transform(cells, lambda c: F.transform(two, lambda x: F.concat(c, F.array(x))))))
        boxes = asked.select("qid", F.col(f"q{t}").alias("y"), F.explode(product).alias("cell"))
        inside = F.forall(F.zip_with("p", "y", lambda a, b: F.abs(a - b)), lambda gap: gap <= half)
        one = rows.join(boxes, "cell").where(inside).select("qid", "id")
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def boxes_of(df: DataFrame, vec: str, maps: list, name: str) -> DataFrame:
    return df.withColumns({f"{name}{t}": linear(m, vec) for t, m in enumerate(maps)})


def box_search(base: DataFrame, queries: DataFrame, maps: list, k: int, half: float) -> DataFrame:
    """Rows inside the box of half-width `half` around the query's projection in any table, verified exactly."""
    met = box_pairs(boxes_of(base, "v", maps, "p"), boxes_of(queries, "q", maps, "q"), len(maps), half)
    pairs = met.join(base.select("id", "v"), "id").join(queries.select("qid", "q"), "qid")
    return top_k(pairs.select("qid", "id", distance("l2").alias("dist")), k)
