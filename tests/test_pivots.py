import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.vectors import linear
from lodestar.operators import indexes as X
from lodestar.operators import more_indexes as N
from lodestar.operators import pivots as P
from lodestar.operators import search as S
from tests.test_insertion import frame, generated, save  # noqa: F401


def rows(frame, *names):
    return sorted(tuple(r[c] for c in names) for r in frame.collect())


@pytest.fixture()
def table(spark, tmp_path):
    x = generated(500, 12, 9)
    x[50:150] = x[50]
    base = frame(spark, str(tmp_path / "b.parquet"), x).unionByName(spark.createDataFrame([(1000, None)], "id long, v array<double>"))
    return x, base, base.where("id < 60 AND id % 3 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))


@pytest.mark.parametrize("count", [1, 40, 499, 5000])
def test_nearest_in_the_projection(spark, table, save, count):  # noqa: F811
    x, base, queries = table
    matrix = X.hyperplanes(4, 12, 3)
    low = base.where("v IS NOT NULL").select("id", linear(matrix, "v").alias("v"))
    want = S.top_k(low.crossJoin(queries.select("qid", linear(matrix, "q").alias("q"))).select("qid", "id", S.distance("l2").alias("dist")), count)
    got = P.nearest_projected(base, queries, matrix, count, save)
    assert rows(got, "qid", "rank", "id", "dist") == rows(want, "qid", "rank", "id", "dist")


@pytest.mark.parametrize("half", [0.05, 0.7, 100.0])
def test_boxes(spark, table, half):
    x, base, queries = table
    maps = [X.hyperplanes(3, 12, 5 + t) for t in range(3)]
    y = [x @ m.T for m in maps]
    want = sorted((q, k) for q in range(0, 60, 3) for k in range(500) if any((np.abs(p[k] - p[q]) <= half).all() for p in y))
    got = P.box_pairs(P.boxes_of(base.where("v IS NOT NULL"), "v", maps, "p"), P.boxes_of(queries, "q", maps, "q"), 3, half)
    assert rows(got, "qid", "id") == want


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def test_no_plan_compares_all_rows(spark, table, save):  # noqa: F811
    x, base, queries = table
    maps = [X.hyperplanes(3, 12, 5)]
    seen = [plan_of(P.box_search(base, queries, maps, 5, 0.5))]
    P.projected_candidates(base, queries, X.hyperplanes(4, 12, 3), 5, 20, lambda df: seen.append(plan_of(df)) or save(df)).count()
    N.dynamic_bucket_search(base.where("v IS NOT NULL"), queries, 5, save=lambda df: seen.append(plan_of(df)) or save(df)).count()
    assert len(seen) > 4 and not any("NestedLoop" in p or "Cartesian" in p for p in seen)


def test_empty_tables(spark, table, save):  # noqa: F811
    x, base, queries = table
    matrix = X.hyperplanes(4, 12, 3)
    assert P.nearest_projected(base.limit(0), queries, matrix, 3, save).count() == 0
    assert P.nearest_projected(base, queries.limit(0), matrix, 3, save).count() == 0
