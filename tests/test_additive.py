import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import additive as A
from lodestar.operators import search as S


def generated(n=900, d=12, seed=4):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, 5)) @ rng.standard_normal((5, d)) + 0.1 * rng.standard_normal((n, d))


def test_one_step_of_conditional_modes_by_brute_force():
    x, rng = generated(40, 6), np.random.default_rng(1)
    books = rng.standard_normal((3, 7, 6))
    codes = rng.integers(0, 7, (40, 3))
    got, want = A.conditional_modes(x, codes, books, A.products(books), 1), codes.copy()
    for j in range(3):
        for n in range(40):
            tried = [A.errors(x[n : n + 1], np.array([[*want[n, :j], k, *want[n, j + 1 :]]]), books)[0] for k in range(7)]
            want[n, j] = int(np.argmin(tried))
    assert (got == want).all()


def test_beams_and_local_search_against_all_codes():
    x, rng = generated(30, 5), np.random.default_rng(2)
    books = A.residual_books(x, 3, 4)
    every = np.array(list(itertools.product(range(4), repeat=3)))
    least = np.min([A.errors(x, np.repeat(c[None], len(x), 0), books) for c in every], axis=0)
    greedy, wide = A.beam_codes(x, books), A.beam_codes(x, books, 64)
    assert np.allclose(A.errors(x, wide, books), least)
    found = A.local_search(x, greedy, books, rng, tries=20)
    assert (A.errors(x, found, books) <= A.errors(x, greedy, books) + 1e-9).all() and (A.errors(x, found, books) <= least + 1e-9).mean() > 0.9


def test_errors_fall_from_greedy_to_beam_to_local():
    x = generated()
    start = A.residual_books(x, 4, 16)
    books = A.local_search_books(x, 4, 16)
    greedy, beam = (A.errors(x, A.beam_codes(x, start, b), start).mean() for b in (1, 8))
    local = A.errors(x, A.local_search(x, A.beam_codes(x, books, 8), books, np.random.default_rng(0)), books).mean()
    assert local < beam < greedy and local < 0.8 * greedy


@pytest.mark.parametrize("norms", list(A.NORMS))
def test_search_by_hand(spark, monkeypatch, norms):
    """Every norm mode against the distances to what the codes stand for; queries in several blocks."""
    monkeypatch.setattr(S, "QUERY_BLOCK", 4 if norms in ("float", "none") else 4096)
    monkeypatch.setattr(S, "CHUNK_ROWS", 100)
    x = generated(300, 8)
    x[7] = x[5]
    base = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(3)
    books = A.local_search_books(x, 3, 8, rounds=3)
    codes = A.encode(base, books).cache()
    kept = {r.id: np.frombuffer(r.code, np.uint8) for r in codes.collect()}
    assert sorted(kept) == list(range(300))
    y = A.decoded(np.stack([kept[k] for k in range(300)]).astype(int), books)
    norm, bounds = (y * y).sum(1), A.norm_range(x, books)
    if A.NORMS[norms]:
        norm = A.stored_norm(norm, A.NORMS[norms], *bounds)
    queries = base.where("id % 30 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    got = {}
    for r in A.search(codes, queries, books, 5, norms, bounds).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.dist))
    assert sorted(got) == list(range(0, 300, 30))
    for i, found in got.items():
        d = (x[i] ** 2).sum() + norm - 2 * y @ x[i]
        assert np.allclose([f[2] for f in sorted(found)], np.sort(d)[:5])
    assert A.search(codes, S.queries_of(base.limit(0)), books, 5).count() == 0 and A.search(codes.limit(0), queries, books, 5).count() == 0
