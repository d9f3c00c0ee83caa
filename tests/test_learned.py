import numpy as np
import pytest

from lodestar.operators import indexes as X
from lodestar.operators import learned as R
from lodestar.operators import search as S
from lodestar.plans import learned_queries
from lodestar.streaming import maintenance


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    v = np.random.default_rng(21).standard_normal((350, 64)).astype(np.float32)
    spark.createDataFrame([(k, [float(x) for x in r], k % 5) for k, r in enumerate(v)], "vec_id long, embedding array<float>, label int").coalesce(2).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(n for n in learned_queries.QUERIES if n.startswith("recall_")))
def test_recall(spark, folder, name):
    assert learned_queries.QUERIES[name](spark, folder).first().recall >= 0.9


def test_rotations():
    x = np.random.default_rng(2).standard_normal((500, 16)) * np.geomspace(4, 0.1, 16)
    turn, books = R.optimized_rotation(x, 4, 16)
    assert np.allclose(turn @ turn.T, np.eye(16), atol=1e-8)
    loss = lambda y, b: ((y - R.decoded(y, b)) ** 2).sum()
    assert loss(x @ turn, books) < loss(x, X.codebook(x, 4, 16, 16))
    mean, axes = R.iterative_quantization(x, 8)
    assert np.allclose(axes.T @ axes, np.eye(8), atol=1e-8)
    y = (x - mean) @ axes
    plain = (x - mean) @ np.linalg.eigh(np.cov((x - mean).T))[1][:, ::-1][:, :8]
    gap = lambda z: ((np.where(z >= 0, 1, -1) - z) ** 2).sum()
    assert gap(y) <= gap(plain)


def test_block_search_equals_column_search(spark, folder):
    b = S.vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    q = S.queries_of(b)
    books = X.codebook(X.training_rows(b, 200), 8, 16, 3)
    got = R.block_search(R.encode_blocks(b, books), q, books, 10).collect()
    want = X.pq_search(X.pq_encode(b, books).select("id", "code"), q, books, 10).collect()
    assert {(r.qid, r.rank): round(r.dist, 9) for r in got} == {(r.qid, r.rank): round(r.dist, 9) for r in want}
    assert R.block_search(R.encode_blocks(b.limit(0), books), q, books, 10).count() == 0
    turn = np.linalg.qr(np.random.default_rng(4).standard_normal((64, 64)))[0]
    back = R.reversed_turn(R.turned(b, turn, "v"), turn, "v").collect()
    assert np.allclose([r.v for r in back], [r.v for r in b.collect()])


def test_levels_thin_out(spark):
    rows = spark.range(20000).selectExpr("id", "array(1D) AS v")
    n = {r.level: r["count"] for r in R.levels(rows, 8).groupBy("level").count().collect()}
    assert n[0] > 16000 and 1500 < n[1] < 3000 and sum(n.values()) == 20000


def test_add_numbers_rows_after_the_largest_id(spark):
    index = spark.createDataFrame([(0, [1.0])], "id long, v array<double>")
    new = spark.createDataFrame([([2.0],), ([3.0],), ([4.0],)], "v array<double>").repartition(3)
    assert sorted(r.id for r in maintenance.add(index, new).collect()) == [0, 1, 2, 3]
    assert sorted(r.id for r in maintenance.add(index.limit(0), new).collect()) == [0, 1, 2]
    assert [r.id for r in maintenance.add(index, new.limit(0)).collect()] == [0]


def test_split_of_several_empty_lists(spark):
    step = spark.createDataFrame([(0, 10, [1.0, 2.0]), (2, 4, [3.0, 5.0])], "list_no int, n long, c array<double>")
    got = {r.list_no: (r.n, r.c) for r in X.split_empty(step, 4).collect()}
    e = 1 / 1024
    assert got[0] == (5, [1 - e, 2 * (1 + e)]) and got[1] == (5, [1 + e, 2 * (1 - e)])
    assert got[2] == (2, [3 * (1 - e), 5 * (1 + e)]) and got[3] == (2, [3 * (1 + e), 5 * (1 - e)])
