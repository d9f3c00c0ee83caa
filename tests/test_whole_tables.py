import numpy as np
import pytest

from lodestar.functions import distances as D
from lodestar.plans import vector_queries as Q

#: As imported: tests that run before may register further measures, which have no query.
MEASURES = [*D.MEASURES]


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(4).standard_normal((230, 64)).astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def folder(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("embeddings"))
    rows = [(k, [float(x) for x in v], k % 5) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_distances_to_every_row(spark, folder, vectors):
    every = {(q, k) for q in (0, 100, 200) for k in range(230)}
    for name in [*(f"dist_{m}" for m in MEASURES), "dist_linf", "dist_lp_root"]:
        got = {(r.qid, r.id): r.dist for r in Q.QUERIES[name](spark, folder).collect()}
        assert got.keys() == every, name
        if name in ("dist_l1", "dist_linf", "dist_lp_root"):
            of = {"dist_l1": lambda x: abs(x).sum(), "dist_linf": lambda x: abs(x).max(), "dist_lp_root": lambda x: (abs(x) ** 1.5).sum() ** (1 / 1.5)}[name]
            assert all(d == pytest.approx(of(vectors[q] - vectors[k]), abs=1e-5) for (q, k), d in got.items())


def test_every_pair_and_coordinate(spark, folder, vectors):
    got = {(r.i, r.j): r.dist for r in Q.pairwise_matrix(spark, folder).collect()}
    assert len(got) == 230 * 230 and all(d == pytest.approx(((vectors[i] - vectors[j]) ** 2).sum(), abs=1e-5) for (i, j), d in got.items())
    centred = vectors - vectors.mean(0)
    got = {(r.id, r.pos): r.x for r in Q.center(spark, folder).collect()}
    assert len(got) == 230 * 64 and all(x == pytest.approx(centred[k, p], abs=1e-5) for (k, p), x in got.items())
    low, high = vectors.min(0), vectors.max(0)
    for bits in (8, 4):
        want = np.floor((vectors - low) / (high - low) * (2**bits - 1) + 0.5)
        got = {(r.id, r.pos): r.code for r in Q.QUERIES[f"sq{bits}"](spark, folder).collect()}
        assert len(got) == 230 * 64 and all(c == want[k, p] for (k, p), c in got.items())
