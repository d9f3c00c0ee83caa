from collections import defaultdict

import pytest

from lodestar.plans import analytics_queries as Q


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("part"))
    spark.range(1, 601).selectExpr("id AS p_partkey").write.parquet(f"{path}/part.parquet")
    return path


@pytest.fixture(scope="module")
def sides(spark, folder):
    """Valid runs of each single model by dataset, from the results table itself."""
    out = {m: defaultdict(list) for m in "ABC"}
    for r in Q.runs(spark, folder).collect():
        if r.combo in out and r.recall is not None and r.qps > 0 and r.construction_time > 0:
            out[r.combo][r.dataset].append((r.recall, r.qps / 100, r.construction_time, r.memory if r.id % 5 else 0.0))
    return out


def test_every_pair_and_triple(spark, folder, sides):
    pairs = {d: [(a, b) for a in sides["A"][d] for b in sides["B"][d]] for d in sides["A"]}
    assert all(pairs.values()) and len(pairs) == 7
    got = Q.config_pairs(spark, folder).collect()
    want = sorted((d, a[0], b[0], round(200 / max(a[1], b[1]), 6), round(a[2] + b[2], 6), a[3] + b[3]) for d, p in pairs.items() for a, b in p)
    assert sorted((r.dataset, r.a_recall, r.b_recall, r.qps_parallel, r.build_sequential, r.memory) for r in got) == [(w[0], *[pytest.approx(x, abs=2e-6) for x in w[1:]]) for w in want]
    assert {r.dataset: r.memory for r in Q.memory_sum(spark, folder).collect()} == {d: pytest.approx(sum(a[3] + b[3] for a, b in p)) for d, p in pairs.items()}
    merged = {d: [min(1.0, (a[0] + b[0]) * 0.55) >= max(a[0], b[0]) for a, b in p] for d, p in pairs.items()}
    assert {r.dataset: (r.wins, r.losses) for r in Q.win_lose(spark, folder).collect()} == {d: (sum(m), len(m) - sum(m)) for d, m in merged.items()}
    best = {d: max(200 / max(a[1], b[1], c[1]) for a, b in p for c in sides["C"][d]) for d, p in pairs.items()}
    assert {r.dataset: (r.n, r.best_qps) for r in Q.config_triples(spark, folder).collect()} == {d: (len(p) * len(sides["C"][d]), pytest.approx(best[d], abs=1e-5)) for d, p in pairs.items()}
