import numpy as np
import pyarrow as pa

from lodestar.operators import indexes as X
from tests.test_insertion import save  # noqa: F401
from tests.test_tiles import table


def edges(df):
    return sorted(map(tuple, df.select("src", "pos", "dst", "dist").collect()))


def test_candidates_meet_at_their_common_neighbour(spark, save, monkeypatch):  # noqa: F811
    b, _ = table(spark, 300)
    plans = []
    got = edges(X.nn_descent(b, 5, 3, lambda df: plans.append(df._jdf.queryExecution().toString()) or save(df)))
    assert all("MapInArrow" in p for p in plans[1:])  # no join of two vectors for each candidate
    monkeypatch.setattr(X, "MEMBER_ROWS", 100)
    assert edges(X.nn_descent(b, 5, 3, save)) == got
    monkeypatch.setattr(X, "regular", lambda *_: None)
    assert edges(X.nn_descent(b, 5, 3, save)) == got


def test_pruning_beside_the_source(spark, save, monkeypatch):  # noqa: F811
    b, _ = table(spark, 300)
    graph = save(X.knn_graph(b, 40))
    want = edges(X.occluded_by_columns(graph.drop("pos"), b, 9))
    assert edges(X.occlusion_prune(graph, b, 9)) == want
    monkeypatch.setattr(X, "SLICE_PAIRS", 900)  # groups of 40 are too large for one block
    assert edges(X.occlusion_prune(graph, b, 9)) == want


def test_groups_are_not_cut(spark):
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(0, 9, 100))
    for step in (1, 3, 17, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[n : n + step])], ["k"]) for n in range(0, 100, step)]
        parts = [t.column("k").to_numpy() for t in X.whole_groups(batches)]
        assert np.array_equal(np.concatenate(parts), key)
        assert len(np.concatenate([np.unique(p) for p in parts])) == len(np.unique(key))
    for most in (1, 400, 10**6):
        at = np.concatenate([a[a >= 0] for a in X.members_of(key, most)])
        assert np.array_equal(np.sort(at), np.arange(100))


def test_floats_only_where_they_hold_the_values(spark):
    assert "array<float>" in X.slim(spark.createDataFrame([(1, [0.5, 2.0])], "id long, v array<double>")).schema["v"].dataType.simpleString()
    assert "array<double>" in X.slim(spark.createDataFrame([(1, [0.5, 0.1])], "id long, v array<double>")).schema["v"].dataType.simpleString()
