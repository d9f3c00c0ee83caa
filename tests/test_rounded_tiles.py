"""Rounded distances of all pairs: the doubles of round(distance) by columns, with only few pairs summed from left to right."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import distances as D
from lodestar.functions.numbers import rounded, rounded_block
from lodestar.operators import search as S
from tests.test_tiles import bits, table

CHEAP = [*sorted(D.PRODUCTS), "l1", "bray_curtis"]


@pytest.mark.parametrize("measure", CHEAP)
def test_only_pairs_near_half_way_are_summed(monkeypatch, measure):
    rng, n, real = np.random.default_rng(5), [0], D.exact_block
    x = rng.standard_normal((300, 24)).astype(np.float32).astype(np.float64)

    def block(block, q, v, paired=False):
        n[0] += len(q) if paired else len(q) * len(v)
        return real(block, q, v, paired)

    monkeypatch.setattr(S, "exact_block", block)
    got = S.rounded_tile(measure, D.BLOCKS[measure], x, x, 6)
    assert n[0] < 300 * 300 / 50
    assert got.tobytes() == rounded_block(real(D.BLOCKS[measure], x, x), 6).tobytes()


@pytest.mark.parametrize("measure", CHEAP)
@pytest.mark.parametrize("kind", ["halves", "grid", "1e-170", "1e-80", "1e90", "1e200", "mixed", "far"])
def test_rounding_is_that_of_exact_sums(measure, kind):
    """Values that lie half-way, sums that vanish, lengths beyond the range of squares, rows far from the origin."""
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (90, 7)) / 2.0
    if kind == "halves":
        x = rng.integers(-3, 4, (90, 7)) * 0.0005
    elif kind == "mixed":
        x = rng.standard_normal((90, 7)) * 10.0 ** rng.integers(-200, 200, (90, 1))
    elif kind == "far":
        x = rng.standard_normal((90, 7)) * 1e-3 + 1e6
    elif kind != "grid":
        x = x * float(kind)
    x[5], x[7] = 0, x[9]
    with np.errstate(all="ignore"):
        want = rounded_block(D.exact_block(D.BLOCKS[measure], x, x), 6)
        got = S.rounded_tile(measure, D.BLOCKS[measure], x, x, 6)
    assert np.array_equal(got, want, equal_nan=True)


def test_few_pairs_have_the_doubles_of_many():
    x = np.random.default_rng(7).standard_normal((D.FEW + 50, 9))
    for measure, block in D.BLOCKS.items():
        y = np.abs(x) if measure in D.NOT_NEGATIVE else x
        many = D.exact_block(block, y, y[::-1], True)
        for n in (1, 40, D.FEW - 1):
            assert D.exact_block(block, y[:n], y[::-1][:n], True).tobytes() == many[:n].tobytes(), measure


@pytest.mark.parametrize("measure", [*D.MEASURES, "linf"])
def test_rounded_pairs_are_those_of_columns(spark, monkeypatch, measure):
    b, q = table(spark, signed=measure not in ("jensen_shannon", "weighted_jaccard"))
    want = bits(S.column_pairs(b, q, measure).withColumn("dist", rounded("dist", 6)))
    assert bits(S.all_pairs(b, q, measure, digits=6)) == want
    monkeypatch.setattr(S, "QUERY_BLOCK", 9)
    monkeypatch.setattr(S, "MEET_ROWS", 20)
    monkeypatch.setattr(S, "TASK_PAIRS", 500)
    assert bits(S.all_pairs(b, q, measure, digits=6)) == want


def test_whole_tiles_leave_as_rows(spark):
    """One row of arrays for each tile, not one for each query with all ids."""
    b, q = table(spark)
    pairs = S.all_pairs(b.select("id", "v").coalesce(1), q, "l2", digits=6)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(qid" in plan and "posexplode(id" in plan
    names = b.select(F.concat(F.lit("n"), "id").alias("id"), "v", F.struct("label").alias("label")), q.select(F.concat(F.lit("q"), "qid").alias("qid"), "q")
    got = S.all_pairs(*names, "l2", digits=6).selectExpr("qid", "id", "label.label", "dist")
    assert bits(got) == bits(S.column_pairs(*names, "l2").select("qid", "id", "label.label", rounded("dist", 6).alias("dist")))


def test_dealt_pairs_have_tasks_of_bounded_size(spark, monkeypatch):
    b, q = table(spark)
    monkeypatch.setattr(S, "QUERY_BLOCK", 9)
    monkeypatch.setattr(S, "MEET_ROWS", 20)
    monkeypatch.setattr(S, "TASK_PAIRS", 500)
    pairs = S.all_pairs(b, q, "l2", digits=6)
    assert pairs.rdd.getNumPartitions() == 12
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan  # they are not shuffled again
