import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import indexes as X
from lodestar.operators import metrics as E
from lodestar.operators import more_indexes as N
from lodestar.operators import search as S
from lodestar.plans.vector_queries import saver


@pytest.fixture(scope="module")
def base(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((6, 8)) * 2
    return spark.createDataFrame([(k, [float(x) for x in centers[k % 6] + 0.5 * rng.standard_normal(8)]) for k in range(300)], "id long, v array<double>").cache()


@pytest.fixture(scope="module")
def queries(base):
    return S.queries_of(base, "id < 20")


@pytest.fixture(scope="module")
def truth(base, queries):
    return S.knn(base, queries, 5).cache()


def recall(found, truth):
    return E.recall_at_k(found, truth, 5).first().recall


def test_one_dimensional_means_are_optimal():
    rng = np.random.default_rng(1)
    x = rng.standard_normal(12)
    s = np.sort(x)
    loss = lambda cuts: sum(((p - p.mean()) ** 2).sum() for p in np.split(s, cuts))
    best = min(loss(c) for c in itertools.combinations(range(1, 12), 2))
    c = N.kmeans_1d(x, 3)
    assert ((x[:, None] - c[None]) ** 2).min(1).sum() == pytest.approx(best)


def test_probabilities():
    assert N.collision_probability(2, 2.0, 1.0) == pytest.approx(0.682689, abs=1e-6)
    assert N.collision_probability(2, 2.7, 1.0) > N.collision_probability(2, 2.7, 2.0)
    assert N.chi_square_quantile(15) == pytest.approx(30.58, abs=0.1)
    p = N.query_aware_parameters(10_000)
    assert 0 < p["threshold"] < p["tables"] and p["p1"] > p["p2"]


def test_rounds_of_hashing(base, queries, truth, spark):
    save = saver(spark)
    assert recall(N.query_aware_search(base, queries, 5, tables=40, save=save), truth) > 0.8
    assert recall(N.dynamic_bucket_search(base, queries, 5, save=save), truth) > 0.8


def test_multi_index_and_spilling(base, queries, truth):
    x = X.training_rows(base)
    assert recall(N.multi_search(base, queries, [X.lloyd(x[:, :4], 4), X.lloyd(x[:, 4:], 4)], 5, 6), truth) > 0.7
    c = X.lloyd(x, 8)
    lists = X.assign(base, c).select("id", "v", "list_no")
    every = N.search_preassigned(lists, N.spilling_probes(queries, c, "fixed", 8), 5)
    assert recall(every, truth) == 1
    one = N.spilling_probes(queries, c, "none", 0)
    assert one.count() == queries.count() <= N.spilling_probes(queries, c, "additive", 1.0).count()
    with pytest.raises(ValueError, match="unknown spilling policy"):
        N.spilling_probes(queries, c, "nope", 1)


def test_equal_vectors_are_stored_once(base, queries, spark):
    twice = base.unionByName(base.withColumn("id", F.col("id") + 1000))
    c = X.lloyd(X.training_rows(base), 8)
    lists = X.assign(twice, c).select("id", "v", "list_no")
    probes = N.spilling_probes(queries, c, "fixed", 8)
    key = lambda df: sorted((r.qid, r.rank, r.id) for r in df.select("qid", "rank", "id").collect())
    assert N.dedup_lists(lists).count() == base.count()
    assert key(N.dedup_search(N.dedup_lists(lists), probes, 6)) == key(N.search_preassigned(lists, probes, 6))


def test_additive_codes_shrink_the_error(base):
    x = X.training_rows(base)
    error = lambda stages: N.product_residual_encode(base, N.product_residual_books(x, 2, stages, 8)).select(F.expr("aggregate(rest, 0D, (a, x) -> a + x * x)").alias("e")).agg(F.avg("e")).first()[0]
    assert error(2) < error(1) < float((x**2).sum(1).mean())
    books = X.codebook(x, 2, 8)
    assert N.anisotropic_encode(base, books).count() == base.count()
