import hashlib

import numpy as np
from pyspark.sql import functions as F

from lodestar.functions.digests import first_words
from lodestar.operators import search as S
from tests.test_tiles import table


def test_first_words_of_digests():
    rng = np.random.default_rng(1)
    own = np.concatenate([np.arange(3000), rng.integers(-(2**63), 2**63 - 1, 3000)])
    for qid in (0, -7, 10**6, -(2**63)):
        got = first_words(b"%d:" % qid, own.astype(str).astype("S"))
        assert got.tolist() == [int(hashlib.md5(b"%d:%d" % (qid, i)).hexdigest()[:8], 16) for i in own.tolist()]


def test_random_rows_are_chosen_where_they_are(spark, monkeypatch):
    b, q = table(spark)
    pairs = S.column_pairs(b, q, F.md5(F.concat(F.col("qid").cast("string"), F.lit(":"), F.col("id").cast("string"))))
    want = sorted(map(tuple, S.top_k(pairs, 5).select("qid", "id").collect()))
    got = S.random_rows(b, q, 5)
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # not a sorted table of all pairs
    assert sorted(map(tuple, got.collect())) == want and len(want) == 200
    monkeypatch.setattr(S, "QUERY_BLOCK", 9)
    monkeypatch.setattr(S, "CHUNK_ROWS", 40)
    assert sorted(map(tuple, S.random_rows(b, q, 5).collect())) == want


def test_distances_to_multiples_in_tiles(spark, monkeypatch):
    b, q = table(spark)
    times = {"added": -1.0, "less": 1.0, "scaled": -2.5}
    sums = [F.round(F.expr(f"aggregate(zip_with(q, v, (x, y) -> abs({t})), 0D, (a, z) -> a + z)"), 6).alias(c) for c, t in (("added", "x + y"), ("less", "x - y"), ("scaled", "x + 2.5D * y"))]
    want = sorted(map(tuple, b.crossJoin(q).select("qid", "id", *sums, "label").collect()))
    for block in (4096, 9):
        monkeypatch.setattr(S, "QUERY_BLOCK", block)
        got = S.all_pairs(b, q, "l1", digits=6, times=times)
        assert "InArrow" in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(S, "regular", lambda *_: None)
    assert sorted(map(tuple, S.all_pairs(b, q, "l1", digits=6, times=times).collect())) == want
