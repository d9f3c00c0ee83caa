import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import learned as R
from lodestar.operators import search as S
from lodestar.operators.indexes import codebook
from tests.test_insertion import frame, generated


def rows(found):
    return sorted(tuple(r) for r in found.select("qid", "rank", "id", "dist").collect())


@pytest.fixture()
def table(spark, tmp_path):
    x = generated(5000, 8, 30)
    x[10] = x[11]
    base = frame(spark, str(tmp_path / "b.parquet"), x).repartition(4)
    return x, base, base.select(F.col("id").alias("qid"), F.col("v").alias("q"))


def plan_of(frame_):
    return frame_._jdf.queryExecution().toString()


def test_five_thousand_queries(table, monkeypatch):
    """More queries than are shipped, by small blocks and chunks, against one block that holds all."""
    x, base, queries = table
    want = {}
    for measure in ("l2", "inner_product"):
        monkeypatch.setattr(S, "QUERY_BLOCK", 1 << 14)
        want[measure] = rows(S.knn(base, queries, 3, measure))
        monkeypatch.setattr(S, "QUERY_BLOCK", 900)
        monkeypatch.setattr(S, "CHUNK_ROWS", 1300)
        found = S.knn(base, queries, 3, measure)
        assert "Cartesian" not in plan_of(found) and "NestedLoop" not in plan_of(found)
        assert rows(found) == want[measure] and len(want[measure]) == 15_000
    d = ((x[:300, None] - x[None]) ** 2).sum(2)
    nearest = {(q, i) for q, _, i, _ in want["l2"]}
    assert all((k, int(j)) in nearest for k in range(300) for j in np.lexsort((np.arange(5000), d[k]))[:3])


def test_pairs_and_codes_of_many_queries(table, monkeypatch):
    x, base, queries = table
    some = queries.where("qid < 60")
    books = codebook(x[:1000], 4, 16, 5)
    codes = R.encode_blocks(base, books)
    want = rows(S.knn_columns(base, some, 4)), rows(R.block_search(codes, some, books, 5)), sorted(map(tuple, S.range_search(base, some, 0.8).collect()))
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "CHUNK_ROWS", 600)
    found = S.knn_columns(base, some, 4)
    assert "Cartesian" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    assert (rows(found), rows(R.block_search(codes, some, books, 5)), sorted(map(tuple, S.range_search(base, some, 0.8).collect()))) == want
