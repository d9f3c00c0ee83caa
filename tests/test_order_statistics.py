import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import metrics as E


def test_places_are_found_without_holding_values(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(3000) * 10.0 ** rng.integers(-300, 300, 3000), np.repeat([0.0, -0.0, 2.5, -2.5], 50), [np.inf, -np.inf, np.nan, 5e-324, -5e-324]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    ordered, places = np.sort(x), [0, 1, 7, 1500, 1600, len(x) // 2, len(x) - 3, len(x) - 2, len(x) - 1]
    got = E.order_statistics(df, places)
    assert all(got[p] == ordered[p] or (np.isnan(got[p]) and np.isnan(ordered[p])) for p in places)


def test_percentiles_are_those_of_spark(spark):
    x = spark.range(1, 2001).selectExpr("IF(id % 9 = 0, NULL, round(id * 7919 % 4001 / 3.0D, 2)) AS x")
    points = (0.0, 0.5, 0.9, 0.95, 0.99, 0.999, 1.0)
    got = E.latency_percentiles(x, "x", points)
    want = x.agg(*[F.round(F.percentile("x", F.lit(p)), 6).alias(str(p)) for p in points])
    assert list(got.first()) == list(want.first())
    assert "percentile" not in got._jdf.queryExecution().toString()  # one task held all values, once for each point
    none = E.latency_percentiles(x.where("x < 0"), "x")
    assert none.columns == ["p50", "p90", "p95", "p99", "p99_9"] and list(none.first()) == [None] * 5
