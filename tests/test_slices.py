import numpy as np
from pyspark.sql import functions as F

from lodestar.functions.distances import block_distance
from lodestar.operators import indexes as X
from lodestar.operators import search as S
from tests.test_tiles import table


def test_matrices_of_distances_are_bounded():
    """A chunk of rows that comes as one batch is taken in slices."""
    near, seen = block_distance("l2"), []
    x, q = np.random.default_rng(1).standard_normal((9000, 4)), np.zeros((3000, 4))
    S.nearest_rows(lambda a, b: seen.append(len(a) * len(b)) or near(a, b), q, [(np.arange(9000), x)], 5)
    assert max(seen) <= 1 << 22


def test_forest_search_without_rows_for_each_tree(spark, monkeypatch):
    b, q = table(spark, 400)
    trees = X.forest(np.random.default_rng(2).standard_normal((200, 6)), 5, 10, 3)
    pairs = X.leaf_codes(b.select("id", "v"), trees).join(X.leaf_codes(q, trees, "q"), ["tree", "leaf"]).dropDuplicates(["qid", "id"])
    want = sorted(map(tuple, S.top_k(pairs.select("qid", "id", S.distance("l2").alias("dist")), 7).collect()))
    for block in (4096, 11):
        monkeypatch.setattr(S, "QUERY_BLOCK", block)
        monkeypatch.setattr(S, "CHUNK_ROWS", 90)
        found = X.forest_search(b, q, trees, 7)
        assert sorted(map(tuple, found.collect())) == want
        assert "tree" not in found._jdf.queryExecution().executedPlan().toString()
