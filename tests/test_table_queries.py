"""Every query of table_queries against its DuckDB text, on small tables."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestar.functions import distances, texts
from lodestar.operators import lists
from lodestar.plans import table_queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    v = np.random.default_rng(11).standard_normal((130, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    spark.createDataFrame([(k, [float(x) for x in r], k % 5) for k, r in enumerate(v)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{path}/embeddings.parquet")
    spark.range(1, 701).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for t in ("embeddings", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return c


def plain(x):
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x if isinstance(x, (str, bool)) or x is None else round(float(x), 9)


@pytest.mark.parametrize("name", sorted(table_queries.QUERIES))
def test_query(spark, folder, duck, name):
    got = table_queries.QUERIES[name](spark, folder)
    found = duck.execute(table_queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = Counter(str(plain(r)) for r in found.fetchall())
    assert sorted(got.columns) == sorted(columns) and want
    assert Counter(str(plain([r[c] for c in columns])) for r in got.collect()) == want


def test_nulls_and_empty_tables(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, None), (2, ""), (3, " A+ B")], "id long, x string")
    assert [r.c for r in rows.select("id", texts.combination(F.col("x")).alias("c")).orderBy("id").collect()] == [None, "", "A + B"]
    assert [r.n for r in rows.select("id", texts.number(F.col("x"), 0).alias("n")).orderBy("id").collect()] == [0.0, 0.0, 0.0]
    none = spark.createDataFrame([], "qid long, rank long, id long, dist double")
    assert lists.intersect(none, none).count() == 0 and lists.shared_sizes(none, none).count() == 0
    assert [(r.precision, r.recall) for r in lists.range_precision_recall(none, none, [1.0]).collect()] == [(1.0, 1.0)]
    with pytest.raises(ValueError):
        texts.found_column(rows, "qps")
    with pytest.raises(ValueError):
        distances.register("l2", {"s": "x"}, "s")
