import numpy as np

from lodestar.operators import learned as R
from tests.test_tiles import table


def test_books_of_different_sizes_in_blocks(spark):
    b, q = table(spark)
    rng = np.random.default_rng(4)
    books = [rng.standard_normal((n, 2)) for n in (16, 3, 2)]
    x, asked = np.array([r.v for r in b.orderBy("id").collect()]), np.array([r.v for r in b.where("id < 40").orderBy("id").collect()])
    gaps = lambda y: [((y[:, None, 2 * j : 2 * j + 2] - c[None]) ** 2).sum(2) for j, c in enumerate(books)]
    d = sum(t[:, near.argmin(1)] for t, near in zip(gaps(asked), gaps(x)))
    want = np.sort(d, axis=1)[:, :9]
    got = R.block_search(R.encode_blocks(b, books), q, books, 9).orderBy("qid", "rank").collect()
    assert np.allclose(np.array([r.dist for r in got]).reshape(40, 9), want)
    assert all(abs(d[r.qid, r.id] - r.dist) < 1e-9 for r in got)
