import itertools

import duckdb
import numpy as np
import pytest

from lodestar.operators import lattice as L
from lodestar.plans import learned_queries


@pytest.mark.parametrize(("d", "r2"), [(1, 4), (2, 25), (3, 9), (4, 10), (5, 7), (8, 3)])
def test_all_points_of_small_spheres(d, r2):
    """Codes number the points without gaps, come back, and the nearest point is that of brute force."""
    top = int(r2**0.5)
    points = np.array([p for p in itertools.product(range(-top, top + 1), repeat=d) if sum(c * c for c in p) == r2])
    codes = L.encode(points, r2)
    assert sorted(codes.tolist()) == list(range(len(points))) and L.offsets(d, r2)[-1] == len(points)
    assert (L.decode(codes, d, r2) == points).all()
    x = np.random.default_rng(d).standard_normal((400, d))
    assert np.allclose((L.nearest_points(x, r2) * x).sum(1), (x @ points.T).max(1))
    assert (L.nearest_points(points.astype(float), r2) == points).all()


def test_large_spheres_come_back():
    x = np.random.default_rng(1).standard_normal((300, 24))
    points = L.nearest_points(x, 60)
    assert ((points**2).sum(1) == 60).all() and (L.decode(L.encode(points, 60), 24, 60) == points).all()
    assert len(set(L.encode(points, 60).tolist())) == 300
    with pytest.raises(ValueError):
        L.offsets(24, 100)


def test_query_by_its_sql(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(64).tolist(), "a") for k in range(5)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(path)
    got = sorted((r.id, r.piece, r.code, tuple(r.point)) for r in learned_queries.QUERIES["lattice_codes"](spark, str(tmp_path)).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted((i, p, c, tuple(x)) for i, p, c, x in duckdb.sql(learned_queries.ORACLES["lattice_codes"]).project("id, piece, code, point").fetchall())
    assert got == want and len(got) == 5 * 16


def test_odd_rows(spark):
    base = spark.createDataFrame([(1, [0.0] * 6), (2, None), (3, [1.0, 1.0, -1.0, 1.0, 2.0, 0.0])], "id long, v array<double>")
    got = {(r.id, r.piece): tuple(r.point) for r in L.code_pieces(base).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (3, 0), (3, 1)] and all(sum(c * c for c in p) == 10 for p in got.values())
    assert L.code_pieces(base.limit(0)).count() == 0
