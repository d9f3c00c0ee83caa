import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import distances as D
from lodestar.operators import search as S


def table(spark, n: int = 150, d: int = 6, signed: bool = True):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, d)).round(2)
    x[5] = 0
    x[7] = x[9]
    x = x if signed else np.abs(x)
    b = spark.createDataFrame([(k, [float(c) for c in v], k % 3) for k, v in enumerate(x)], "id long, v array<double>, label int")
    return b, b.where("id < 40").select(F.col("id").alias("qid"), F.col("v").alias("q"))


def bits(df):
    return sorted((r.qid, r.id, r.label, None if r.dist is None else np.float64(r.dist).tobytes()) for r in df.collect())


@pytest.mark.parametrize("measure", [*D.MEASURES, "linf"])
def test_tiles_give_the_doubles_of_columns(spark, measure):
    b, q = table(spark, signed=measure not in ("jensen_shannon", "weighted_jaccard"))
    assert measure not in D.BLOCKS or "MapInArrow" in S.all_pairs(b, q, measure)._jdf.queryExecution().toString()
    got, want = S.all_pairs(b, q, measure), S.column_pairs(b, q, measure)
    if measure == "jensen_shannon":  # logarithms differ in the last bit
        far = {(r.qid, r.id): r.dist for r in want.collect()}
        assert len(far) == 6000 and all(r.dist == pytest.approx(far[r.qid, r.id], abs=1e-13) for r in got.collect())
    else:
        assert bits(got.withColumn("dist", F.col("dist") + 0.0)) == bits(want.withColumn("dist", F.col("dist") + 0.0))


def test_tiles_dealt_out(spark, monkeypatch):
    b, q = table(spark)
    want = bits(S.column_pairs(b, q, "cosine")), bits(S.column_pairs(b, q, "l2").where("dist >= 1.0 AND dist < 2.0"))
    monkeypatch.setattr(S, "QUERY_BLOCK", 9)
    monkeypatch.setattr(S, "MEET_ROWS", 20, raising=False)
    assert bits(S.all_pairs(b, q, "cosine")) == want[0]
    assert bits(S.all_pairs(b, q, "l2", (1.0, 2.0))) == want[1]
    monkeypatch.undo()
    monkeypatch.setattr(S, "TASK_PAIRS", 500, raising=False)
    assert S.all_pairs(b, q, "l2").rdd.getNumPartitions() == 12
    assert bits(S.all_pairs(b, q, "cosine")) == want[0]


def test_odd_vectors_take_columns(spark):
    b, q = table(spark)
    for odd in ("CAST(NULL AS array<double>)", "array(1D, 2D)", "array(1D, NULL, 1D, 1D, 1D, 1D)", "array(1D, double('NaN'), 1D, 1D, 1D, 1D)"):
        c = b.withColumn("v", F.expr(f"IF(id = 3, {odd}, v)"))
        assert "MapInArrow" not in S.all_pairs(c, q, "hamming")._jdf.queryExecution().toString()
        assert bits(S.all_pairs(c, q, "hamming")) == bits(S.column_pairs(c, q, "hamming"))


def test_nearest_of_tiles(spark, monkeypatch):
    """Only a tile's nearest leave it, ties with them."""
    monkeypatch.setattr(S, "TILE_ROWS", 40, raising=False)
    b, q = table(spark)
    for measure in ("l2", "inner_product"):
        order = F.col("dist").desc() if measure == "inner_product" else F.col("dist")
        pairs = S.all_pairs(b, q, measure, (-0.5, None), 4)
        assert pairs.count() < 40 * 150 / 2
        got = S.top_k(pairs, 4, [order, F.col("id")]).select("qid", "rank", "id").collect()
        assert sorted(got) == sorted(S.top_k(S.column_pairs(b, q, measure).where("dist >= -0.5"), 4, [order, F.col("id")]).select("qid", "rank", "id").collect())
