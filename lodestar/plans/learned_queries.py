"""Registered queries of learned codes, layered graphs and re-ranked indexes, and the recall of each.

No SQL can replay what they learn; `recall_*` queries compare each with exact search over the stated query set, and the
tests ask for 0.9 and more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import additive as A
from lodestar.operators import indexes as X
from lodestar.operators import insertion as G
from lodestar.operators import kdblocks as T
from lodestar.operators import lattice
from lodestar.operators import learned as R
from lodestar.operators import more_indexes as N
from lodestar.operators import search as S
from lodestar.operators.metrics import recall_at_k
from lodestar.plans.vector_queries import K, both, saver

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Rows that models are trained on, and candidates for each result row that are re-ranked exactly.
SAMPLE, FACTOR = 4096, 10


def query(name: str):
    def add(f):
        QUERIES[name] = f

        def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
            return recall_at_k(f(spark, sf_dir), S.knn(*both(spark, sf_dir), K), K).select(F.lit(name).alias("method"), "k", "recall")

        QUERIES[f"recall_{name}"] = recall
        return f

    return add


def signs_refined(b: DataFrame, q: DataFrame, planes: np.ndarray, factor: int, mean: np.ndarray | None = None) -> DataFrame:
    shifted = lambda df, vec: df if mean is None else df.withColumn(vec, F.zip_with(vec, F.array(*[F.lit(float(x)) for x in mean]), lambda x, y: x - y))
    return S.refine(X.sign_search(shifted(b, "v"), shifted(q, "q"), planes, factor * K), b, q, K)


@query("lsh_refined")
def lsh_refined(spark, sf_dir):
    return signs_refined(*both(spark, sf_dir), X.hyperplanes(256, 64, 3), 2 * FACTOR)


@query("itq_refined")
def itq_refined(spark, sf_dir):
    b, q = both(spark, sf_dir)
    mean, axes = R.iterative_quantization(X.training_rows(b, SAMPLE), 64)
    return signs_refined(b, q, axes.T, 4 * FACTOR, mean)


@query("pq_refined")
def pq_refined(spark, sf_dir):
    b, q = both(spark, sf_dir)
    x = X.training_rows(b, SAMPLE)
    books = X.codebook(x, 16, min(64, len(x)), 10)
    return S.refine(R.block_search(R.encode_blocks(b, books), q, books, FACTOR * K), b, q, K)


@query("opq_pq")
def opq_pq(spark, sf_dir):
    b, q = both(spark, sf_dir)
    x = X.training_rows(b, SAMPLE)
    turn, books = R.optimized_rotation(x, 16, min(64, len(x)))
    return S.refine(R.block_search(R.encode_blocks(R.turned(b, turn, "v"), books), R.turned(q, turn, "q"), books, FACTOR * K), b, q, K)


@query("ivf_pq_refined")
def ivf_pq_refined(spark, sf_dir):
    """Lists, product codes of the residuals, and exact re-ranking."""
    b, q = both(spark, sf_dir)
    x = X.training_rows(b, SAMPLE)
    c = X.lloyd(x, 16, 10)
    own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    books = X.codebook(x - c[own], 16, min(32, len(x)), 10)
    codes = X.pq_encode(X.residuals(X.assign(b, c), c), books, "r").select("id", "list_no", "code")
    found = S.top_k(X.residual_pq_pairs(codes, X.assign(q, c, 13, "q"), c, books), FACTOR * K)
    return S.refine(found, b, q, K)


@query("ivf_wide")
def ivf_wide(spark, sf_dir):
    b, q = both(spark, sf_dir)
    c = X.lloyd(X.training_rows(b, SAMPLE), 16, 10)
    return X.ivf_search(X.assign(b, c).select("id", "v", "list_no"), q, c, K, 10)


@query("imi_wide")
def imi_wide(spark, sf_dir):
    b, q = both(spark, sf_dir)
    x = X.training_rows(b, SAMPLE)
    return N.multi_search(b, q, [X.lloyd(x[:, :32], 8, 10), X.lloyd(x[:, 32:], 8, 10)], K, 50)


@query("anisotropic_refined")
def anisotropic_refined(spark, sf_dir):
    """Anisotropic codes, searched by inner product tables, and exact re-ranking."""
    b, q = both(spark, sf_dir)
    x = X.training_rows(b, SAMPLE)
    books = X.codebook(x, 16, min(16, len(x)), 10)
    return S.refine(X.pq_search(N.anisotropic_encode(b, books).select("id", "code"), q, books, 2 * FACTOR * K), b, q, K)


@query("forest_wide")
def forest_wide(spark, sf_dir):
    b, q = both(spark, sf_dir)
    return X.forest_search(b, q, X.forest(X.training_rows(b, SAMPLE), 40, 64, 4), K)


@query("hnsw")
def hnsw(spark, sf_dir):
    b, q = both(spark, sf_dir)
    save = saver(spark)
    return R.layered_search(R.layered_graph(b, 8, 16, save), b, q, K, 64, save)


@query("hnsw_insert")
def hnsw_insert(spark, sf_dir):
    """Layers built by insertion, in shards."""
    b, q = both(spark, sf_dir)
    return G.search(G.build(b, saver(spark), 16, 64), q, K).drop("compared")


@query("flat_insert")
def flat_insert(spark, sf_dir):
    """One layer built by insertion; searches start from the nearest of 100 rows."""
    b, q = both(spark, sf_dir)
    return G.search(G.build(b, saver(spark), 16, 64, layered=False, starts=100), q, K).drop("compared")


def additive_model(b: DataFrame):
    x = X.training_rows(b, SAMPLE)
    size = min(64, max(1, len(x) // 16))
    return x, A.local_search_books(x, 8, size, 6) if len(x) else np.zeros((8, 1, 1))


@query("lsq_refined")
def lsq_refined(spark, sf_dir):
    """Additive codes by local search with norms in 8 bits, and exact re-ranking."""
    b, q = both(spark, sf_dir)
    x, books = additive_model(b)
    return S.refine(A.search(A.encode(b, books), q, books, FACTOR * K, "int8", A.norm_range(x, books)), b, q, K)


def additive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error over the whole table at eight bytes a row: residual codes, greedy and by beam, and local search."""
    b, _ = both(spark, sf_dir)
    x, books = additive_model(b)
    residual = A.residual_books(x, 8, books.shape[1]) if len(x) else books
    rows = [A.encode(b, c, how).select(F.lit(how).alias("method"), "error") for how, c in (("greedy", residual), ("beam", residual), ("local", books))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("method").agg(F.avg("error").alias("error"), F.count(F.lit(1)).alias("n"))


QUERIES["additive_errors"] = additive_errors


def lattice_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of four coordinates as a point of the sphere of squared radius 10: code, and what it gives back."""
    return lattice.code_pieces(both(spark, sf_dir)[0], 4, 10)


QUERIES["lattice_codes"] = lattice_codes
ORACLES["lattice_codes"] = """
WITH c AS (SELECT unnest(range(-3, 4)) AS c), p AS (SELECT [a.c, b.c, d.c, e.c] AS point FROM c a, c b, c d, c e WHERE a.c * a.c + b.c * b.c + d.c * d.c + e.c * e.c = 10),
s AS (SELECT point, list_transform(point, lambda x: abs(x)) AS size FROM p),
o AS (SELECT point, row_number() OVER (ORDER BY list_reverse_sort(size) DESC, size, list_reduce(list_prepend(0, list_transform(list_filter(point, lambda x: x != 0), lambda x: CASE WHEN x < 0 THEN 1 ELSE 0 END)), lambda x, y: 2 * x + y)) - 1 AS code FROM s),
v AS (SELECT vec_id AS id, k AS piece, list_slice(embedding, 4 * k + 1, 4 * k + 4)::DOUBLE[] AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 4)) AS k FROM embeddings)),
m AS (SELECT id, piece, code, point, row_number() OVER (PARTITION BY id, piece ORDER BY x[1] * point[1] + x[2] * point[2] + x[3] * point[3] + x[4] * point[4] DESC, code) AS place FROM v, o)
SELECT id, piece, code, point FROM m WHERE place = 1
"""


@query("kd_hash")
def kd_hash(spark, sf_dir):
    """Query-aware hashing inside the nearest blocks of a kd-tree."""
    b, q = both(spark, sf_dir)
    return T.search(T.build(b, saver(spark), 512), q, K, 12, 1.3, 0.5, 0.25).drop("compared")
