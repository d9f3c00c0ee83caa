import numpy as np

from lodestar.operators import indexes as X
from lodestar.operators import lists as L
from lodestar.operators import more_indexes as N
from lodestar.operators import search as S
from tests.test_tiles import table


def rows(df):
    return sorted(map(tuple, df.select("qid", "rank", "id", "dist").collect()))


def plan_of(df):
    return df._jdf.queryExecution().toString()


def both_ways(monkeypatch, make):
    """By blocks, dealt out in blocks, and by columns."""
    got = make()
    assert "MapInArrow" in plan_of(got)
    with monkeypatch.context() as m:
        m.setattr(S, "QUERY_BLOCK", 7)
        m.setattr(S, "CHUNK_ROWS", 60)
        dealt = make()
        assert "CoGroup" in plan_of(dealt)
        dealt = rows(dealt)
    with monkeypatch.context() as m:
        for module in (S, X):
            m.setattr(module, "regular", lambda *_: None)
        want = make()
        assert "InArrow" not in plan_of(want)
        want = rows(want)
    assert rows(got) == dealt == want and want


def test_lists_in_blocks(spark, monkeypatch):
    b, q = table(spark)
    c = X.first_rows(b, 6)
    both_ways(monkeypatch, lambda: X.ivf_search(X.assign(b, c).select("id", "v", "list_no"), q, c, 5, 3))


def test_copies_of_a_row_count_once(spark, monkeypatch):
    b, q = table(spark)
    c = X.first_rows(b, 6)
    both_ways(monkeypatch, lambda: X.ivf_search(X.spilled(b, c, 3), q, c, 5, 4))


def test_cells_in_blocks(spark, monkeypatch):
    b, q = table(spark)
    x = X.first_rows(b, 4)
    both_ways(monkeypatch, lambda: N.multi_search(b, q, [x[:, :3], x[:, 3:]], 5, 7))


def test_pruned_bands_in_blocks(spark, monkeypatch):
    b, q = table(spark)
    c = X.first_rows(b, 4)
    probes = X.assign(q, c, 4, "q").select("qid", "list_no", "list_dist")
    monkeypatch.setattr(S, "TILE_ROWS", 6)
    both_ways(monkeypatch, lambda: L.pruned_search(X.assign(b, c).select("id", "v", "list_no", "list_dist"), q, probes, 5))


def test_sign_codes_in_blocks(spark, monkeypatch):
    b, q = table(spark)
    for n in (9, 130):
        both_ways(monkeypatch, lambda: X.sign_search(b, q, X.hyperplanes(n, 6, 3), 8))


def test_words_hold_the_signs_of_columns(spark):
    b, _ = table(spark)
    planes = np.concatenate([X.hyperplanes(60, 6, 3), np.array([[1, -1, 0, 0, 0, 0]] * 10, float)])
    words = X.sign_words(np.array([r.v for r in b.orderBy("id").collect()]), planes)
    bits = np.unpackbits(np.ascontiguousarray(words.T).view(np.uint8), axis=1)[:, :70]
    assert bits.tolist() == [r.bits for r in X.sign_codes(b, planes).orderBy("id").select("bits").collect()]
