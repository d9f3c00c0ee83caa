from pyspark.sql import functions as F

from lodestar.operators import search as S
from tests.test_tiles import bits, table


def test_all_pairs_are_streamed_in_large_groups(spark, monkeypatch):
    """Each row is shipped once for each block of queries: larger groups, fewer copies."""
    b, _ = table(spark)
    q = b.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    want = bits(S.column_pairs(b, q, "l2_sq"))
    monkeypatch.setattr(S, "QUERY_BLOCK", 9)
    monkeypatch.setattr(S, "MEET_ROWS", 20)
    monkeypatch.setattr(S, "TILE_ROWS", 32)
    for rows in (1 << 14, 64):
        monkeypatch.setattr(S, "STREAM_ROWS", rows, raising=False)
        monkeypatch.setattr(S, "STREAM_TASKS", 1, raising=False)
        got = S.all_pairs(b, q, "l2_sq")
        plan = got._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "CoGroup" not in plan
        assert bits(got) == want and len(want) == 150 * 150


def test_vectors_are_shipped_as_floats_only_where_these_hold_them(spark):
    assert dict(S.slim(spark.createDataFrame([(1, [0.5, 2.0])], "id long, v array<double>"), "v").dtypes)["v"] == "array<float>"
    assert dict(S.slim(spark.createDataFrame([(1, [0.5, 0.1])], "id long, v array<double>"), "v").dtypes)["v"] == "array<double>"
