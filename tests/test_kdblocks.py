import numpy as np
from pyspark.sql import functions as F

from lodestar.operators import kdblocks as B
from tests.test_insertion import frame, generated, recall, save  # noqa: F401


def test_tree_by_hand():
    x = generated(900, 5, 7)
    axes, cuts = B.kd_tree(x, 4)
    got = B.leaves(x, axes, cuts)
    for k in range(0, 900, 31):
        node = 0
        while node < 15:
            node = 2 * node + (2 if x[k, axes[node]] >= cuts[node] else 1)
        assert got[k] == node - 15
    low, high = B.cells(axes, cuts, 5)
    assert ((x >= low[got]) & (x <= high[got])).all()
    assert np.bincount(got, minlength=16).max() <= 58 and np.bincount(got, minlength=16).min() >= 54


def test_radii_find_what_rounds_of_collisions_find():
    """Each round by brute force: rows with enough collisions within the radius, until the k-th distance is in reach."""
    x, k, c = generated(400, 6, 5), 5, 2.0
    known = B.query_aware_parameters(400, c)
    lines = np.random.default_rng(5).standard_normal((known["tables"], 6))
    for q, (at, dist, seen) in zip(x[::40] + 0.1, B.hashed_search(x, x[::40] + 0.1, k, c, c, 1.0, 5)):
        gap = np.abs((x - q) @ lines.T)
        hits = lambda r: np.flatnonzero((gap <= known["width"] * r / 2 + 1e-12).sum(1) >= known["threshold"])
        radius = min(r for r in np.sort(gap.ravel()) * 2 / known["width"] if len(hits(r)) >= k)
        while np.sort(((x[hits(radius)] - q) ** 2).sum(1))[k - 1] > (c * radius) ** 2 and len(hits(radius)) < 400:
            radius *= c
        found = hits(radius)
        d = ((x[found] - q) ** 2).sum(1)
        assert seen == len(found) and set(at) == set(found[np.argsort(d, kind="stable")[:k]]) and np.allclose(dist, np.sort(d)[:k])


def test_recall_and_share(spark, tmp_path, save):  # noqa: F811
    x = generated(30_000, 64, 150)
    base = frame(spark, str(tmp_path / "b.parquet"), x).repartition(8)
    ids = np.arange(0, len(x), 500)
    found = B.search(B.build(base, save, 1024), base.where("id % 500 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q")), 10, 8, share=0.15).collect()
    compared = {r.qid: r.compared for r in found}
    assert recall(found, x, ids) >= 0.9 and np.mean(list(compared.values())) < 0.05 * len(x)


def test_copies_nulls_and_empty_tables(spark, tmp_path, save, monkeypatch):  # noqa: F811
    monkeypatch.setattr(B, "QUERIES", 5)
    x = generated(500, 8, 5)
    x[100:300] = x[100]
    base = frame(spark, str(tmp_path / "b.parquet"), x).unionByName(spark.createDataFrame([(1000, None)], "id long, v array<double>"))
    queries = base.where("id < 40 AND v IS NOT NULL").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    index = B.build(base, save, 32)
    assert index["rows"].count() == 500 and max(r["count"] for r in index["rows"].groupBy("block").count().collect()) <= 130
    found = B.search(index, queries, 10, 64, share=1.0).collect()
    assert len(found) == 400 and len({(r.qid, r.id) for r in found}) == 400 and recall(found, x, np.arange(40)) >= 0.9
    assert B.search(B.build(base.limit(0), save), queries, 5).count() == 0 and B.search(index, queries.limit(0), 5).count() == 0
