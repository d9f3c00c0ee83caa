"""Pairs under a bound, nearest pairs and range counts: the same rows and doubles as all pairs, without computing them all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import distances as D
from lodestar.operators import lists as L
from lodestar.operators import metrics as E
from lodestar.operators import search as S


def table(spark, n: int = 300, d: int = 5):
    """Rows on a coarse grid, so that many distances are equal and lie on the bounds; groups of copies."""
    x = np.random.default_rng(4).integers(-2, 3, (n, d)) / 2.0
    x[40:90] = x[3]
    b = spark.createDataFrame([(k * 7 % n, [float(c) for c in v]) for k, v in enumerate(x)], "id long, v array<double>")
    return b, b.where("id < 30").select(F.col("id").alias("qid"), F.col("v").alias("q"))


def rows(df):
    return sorted((r.qid, r.id, np.float64(r.dist).tobytes()) for r in df.collect())


def counted(monkeypatch):
    """Pairs that exact_block computes."""
    n, real = [0], D.exact_block

    def block(block, q, v, paired=False):
        n[0] += len(q) if paired else len(q) * len(v)
        return real(block, q, v, paired)

    monkeypatch.setattr(S, "exact_block", block)
    return n


def test_only_pairs_near_the_bound_are_computed(monkeypatch):
    x = np.random.default_rng(1).standard_normal((500, 16))
    n = counted(monkeypatch)
    d = D.exact_block(D.BLOCKS["l2"], x, x)
    a, b, got = S.block_pairs(D.BLOCKS["l2"], True, x, x, None, 3.0)
    assert n[0] < 500 * 500 / 8 and 500 < len(a) and sorted(zip(a, b)) == sorted(zip(*np.nonzero(d < 3.0)))
    assert got.tobytes() == d[a, b].tobytes()


@pytest.mark.parametrize("scale", [1.0, 1e-170, 1e200])
def test_bounds_hold_at_any_scale(scale):
    x = np.random.default_rng(2).integers(-2, 3, (80, 4)) * scale
    for measure, root in (("l2", True), ("l2_sq", False)):
        with np.errstate(over="ignore"):
            d = D.exact_block(D.BLOCKS[measure], x, x)
            for high in np.unique(d)[:9]:
                a, b, got = S.block_pairs(D.BLOCKS[measure], root, x, x, None, float(high))
                assert sorted(zip(a, b)) == sorted(zip(*np.nonzero(d < high))) and got.tobytes() == d[a, b].tobytes()
            i = S.closest(D.BLOCKS[measure], root, S.pa.array(np.arange(80)), x, [(np.arange(80), x)], 7, None)[1].to_numpy().reshape(80, 7)
        assert (i == np.argsort(d, axis=1, kind="stable")[:, :7]).all()


@pytest.mark.parametrize("block", [4096, 9])
def test_ranges_and_nearest_are_those_of_columns(spark, monkeypatch, block):
    monkeypatch.setattr(S, "QUERY_BLOCK", block)
    monkeypatch.setattr(S, "SLICE_PAIRS", 1000)
    monkeypatch.setattr(S, "MEET_ROWS", 100)
    monkeypatch.setattr(S, "CHUNK_ROWS", 120)
    b, q = table(spark)
    for measure in ("l2", "l2_sq"):
        every = S.column_pairs(b, q, measure).cache()
        for low, high in ((None, 1.0), (1.0, 1.5), (0.0, 0.5), (None, float("inf"))):
            want = every.where(F.lit(True) if low is None else F.col("dist") >= low).where(F.col("dist") < high)
            assert rows(S.all_pairs(b, q, measure, (low, high))) == rows(want)
        for low in (None, 1.0, 2.5):
            want = S.top_k(every if low is None else every.where(F.col("dist") >= low), 4)
            assert rows(S.top_k(S.all_pairs(b, q, measure, (low, None), 4), 4)) == rows(want)


def test_nearest_leave_a_task_once(spark):
    """k rows of each query and task, not those of each tile with all ties."""
    b, q = table(spark)
    pairs = S.all_pairs(b.coalesce(1), q, "l2", (0.5, None), 4)
    assert pairs.count() == 4 * 30
    odd = b.withColumn("id", F.when(F.col("id") != 77, F.col("id")))  # an id that is null stands first among ties
    assert S.top_k(S.all_pairs(odd, q, "l2", first=300), 300).where("id IS NULL").count() == 30


@pytest.mark.parametrize("block", [4096, 9])
def test_smallest_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(S, "QUERY_BLOCK", block)
    monkeypatch.setattr(S, "CHUNK_ROWS", 120)
    b, q = table(spark)
    q = q.where("qid % 2 = 1")
    for measure in ("l2", "l1"):
        every = S.column_pairs(b, q, measure)
        for most in (3, 40, 200, 10_000):
            few = S.all_pairs(b.coalesce(2), q, measure, least=most + 1)
            assert rows(S.range_at_most(few, most)) == rows(S.range_at_most(every, most))
        assert S.all_pairs(b.coalesce(1), q, measure, least=4).count() <= 60


def test_counts_of_measures_by_products():
    x = (np.random.default_rng(3).random((40, 9)) > 0.6) * 1.5
    for measure in ("jaccard", "nonzero_intersect"):
        both, either = [(f(x[:, None] != 0, x[None] != 0)).sum(2) for f in (np.logical_and, np.logical_or)]
        want = np.where(either == 0, 0.0, 1 - both / np.maximum(either, 1)) if measure == "jaccard" else 0.0 - both
        assert (D.exact_block(D.BLOCKS[measure], x, x) == want).all()
        assert (D.exact_block(D.BLOCKS[measure], x[:20], x[20:], True) == want[np.arange(20), np.arange(20, 40)]).all()


def test_range_counts_make_each_table_once(spark):
    """Ids that stand twice count for each pair of them, as in the join; ids that are null meet none."""
    found = spark.createDataFrame([(0, 1, 0.1), (0, 1, 0.4), (0, 2, 0.2), (1, None, 0.1)], "qid long, id long, dist double")
    true = spark.createDataFrame([(0, 1, 0.3), (0, 1, 0.6), (0, 3, 0.1), (1, None, 0.2)], "qid long, id long, dist double")
    made = spark.sparkContext.accumulator(0)

    def seen(df):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)

    got = L.range_precision_recall(seen(found), seen(true), [0.35, 1.0]).collect()
    assert made.value == 8
    assert [(r.precision, r.recall) for r in got] == [(1 / 3, 1 / 3), (4 / 4, 4 / 4)]
    counts = E.range_counts(found, true, spark.createDataFrame([(0,), (1,), (2,)], "qid long")).orderBy("qid").collect()
    assert [tuple(r) for r in counts] == [(0, 3, 3, 4), (1, 1, 1, 0), (2, 0, 0, 0)]
