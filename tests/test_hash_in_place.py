import pytest
from pyspark.sql import functions as F

from lodestar.operators import more_indexes as N
from lodestar.operators import search as S
from tests.test_insertion import frame, generated, save  # noqa: F401
from tests.test_pivots import rows


@pytest.mark.parametrize("search", [N.dynamic_bucket_search, N.query_aware_search])
def test_candidates_are_verified_where_they_are(spark, tmp_path, save, monkeypatch, search):  # noqa: F811
    """The rows of the joins of candidates, copies with them, without a row for each candidate pair."""
    x = generated(500, 12, 9)
    x[50:150] = x[50]
    base = frame(spark, str(tmp_path / "b.parquet"), x)
    queries = base.where("id < 90 AND id % 3 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    plans = []
    got = rows(search(base, queries, 5, save=lambda df: plans.append(df._jdf.queryExecution().toString()) or save(df)), "qid", "rank", "id", "dist")
    assert any("MapInArrow" in p for p in plans) and len(got) == 150
    with monkeypatch.context() as m:
        m.setattr(N, "regular", lambda *_: None, raising=False)
        assert rows(search(base, queries, 5, save=save), "qid", "rank", "id", "dist") == got
    monkeypatch.setattr(S, "QUERY_BLOCK", 11)
    monkeypatch.setattr(S, "CHUNK_ROWS", 90)
    assert rows(search(base, queries, 5, save=save), "qid", "rank", "id", "dist") == got
