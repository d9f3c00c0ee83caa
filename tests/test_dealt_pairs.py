import numpy as np
from pyspark.sql import functions as F

from lodestar.functions.numbers import rounded, rounded_block
from lodestar.plans import analytics as A
from lodestar.plans import analytics_queries as Q


def values():
    rng = np.random.default_rng(3)
    halves = (rng.integers(-3_000_000, 3_000_000, 2000) + 0.5) / 1e6
    near = np.concatenate([halves, np.nextafter(halves, 9), np.nextafter(halves, -9)])
    return np.concatenate([rng.standard_normal(3000), near, rng.standard_normal(500) * 1e12, [0.0, -0.0, -1e-9, 1e-7, 4294.9672955, 1e300, np.nan, np.inf, -np.inf, 2.5e-6, 0.1234565]])


def test_rounding_is_that_of_spark(spark):
    x = values()
    for digits in (5, 6):
        got = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", F.round("x", digits).alias("want"), rounded("x", digits).alias("got")).collect()
        want = np.array([r.want for r in got])
        assert np.array([r.got for r in got]).tobytes() == want.tobytes()
        assert rounded_block(np.array([r.x for r in got]), digits).tobytes() == want.tobytes()


def test_pairs_of_one_dataset_are_dealt_out(spark, monkeypatch):
    runs = spark.range(1, 4001).selectExpr("concat('d', id % 1) AS dataset", "'A' AS model", "id / 4001 AS recall", "id * 1.0D AS search_time", "id % 90 + 0.1D AS construction_time", "IF(id % 5 = 0, NULL, id * 2.0D) AS memory")
    left, right = runs.where("search_time <= 700"), runs.where("search_time > 700 AND search_time < 1400")
    monkeypatch.setattr(A, "PAIR_RUNS", 100, raising=False)
    out = A.config_pairs(left, right)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 700 * 699 and max(sizes) < 700 * 699 / 4
    want = left.alias("a").join(right.alias("b"), "dataset").selectExpr("a.recall", "b.recall", "200 / greatest(a.search_time, b.search_time)", "coalesce(a.memory, 0D) + coalesce(b.memory, 0D)")
    got = out.select("a_recall", "b_recall", "qps_parallel", "memory")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_pairs_of_empty_sides(spark):
    none = spark.createDataFrame([], "dataset string, model string, recall double, search_time double, construction_time double, memory double")
    assert A.config_pairs(none, none).count() == 0
    assert Q.PROFILES
