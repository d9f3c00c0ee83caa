"""Registered queries of the further access methods."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import indexes as X
from lodestar.operators import more_indexes as N
from lodestar.operators import pivots as P
from lodestar.operators import search as S
from lodestar.plans import duck
from lodestar.plans.vector_queries import K, _books, _nearest, base, both, first_centroids, saver

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_FIRST = "c AS (SELECT id AS list_no, v AS c FROM b WHERE id < 16)"
_LISTS = f"lists AS ({_nearest('b', 'id', 'v', 1)}), near AS (SELECT qid, q, list_no, sqrt(list_dist) AS d FROM ({_nearest('q', 'qid', 'q', 16)}))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {duck.BASE}, {_FIRST}, {_LISTS} {sql}"
        return f

    return add


def _spill(policy: str, value: float, rule: str) -> None:
    @query(f"spill_{policy}", f"SELECT qid, list_no, round(d, 6) AS d FROM (SELECT *, min(d) OVER (PARTITION BY qid) AS least, row_number() OVER (PARTITION BY qid ORDER BY d, list_no) AS r FROM near) WHERE {rule}")
    def run(spark, sf_dir):
        _, q = both(spark, sf_dir)
        return N.spilling_probes(q, first_centroids(spark, sf_dir), policy, value).select("qid", F.col("list_no").cast("long").alias("list_no"), F.round("list_dist", 6).alias("d"))


_spill("none", 0, "r = 1")
_spill("fixed", 3, "r <= 3")
_spill("additive", 0.15, "d <= least + 0.15")
_spill("multiplicative", 1.1, "d <= least * 1.1")
_spill("absolute", 1.2, "d <= 1.2 OR r = 1")


@query("search_preassigned", f", p AS (SELECT * FROM q, (VALUES (1), (5)) x(list_no)), hit AS (SELECT qid, id, {duck.measure('l2', 'p.q', 'lists.v')} AS dist, list_no FROM p JOIN lists USING (list_no)) SELECT qid, rank, id, dist, list_no::INT AS list_no FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM hit) WHERE rank <= {K}")
def search_preassigned(spark, sf_dir):
    b, q = both(spark, sf_dir)
    lists = X.assign(b, first_centroids(spark, sf_dir)).select("id", "v", "list_no")
    return N.search_preassigned(lists, q.withColumn("list_no", F.explode(F.array(F.lit(1), F.lit(5)))), K)


ORACLES["search_preassigned"] = ORACLES["search_preassigned"].replace(") , p AS", "), p AS")


@query("ivf_flat_dedup", f", p AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, list_no) <= 4), hit AS (SELECT qid, id, {duck.measure('l2', 'p.q', 'lists.v')} AS dist FROM p JOIN lists USING (list_no)) SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM hit) WHERE rank <= {K}")
def ivf_flat_dedup(spark, sf_dir):
    b, q = both(spark, sf_dir)
    c = first_centroids(spark, sf_dir)
    lists = X.assign(b, c).select("id", "v", "list_no")
    return N.dedup_search(N.dedup_lists(lists), X.assign(q, c, 4, "q").select("qid", "q", "list_no"), K)


ORACLES["ivf_flat_dedup"] = ORACLES["ivf_flat_dedup"].replace(") , p AS", "), p AS")


@query("knn_crowding_multi", f", x AS (SELECT *, id % 3 AS part FROM ({duck.pairs('l2')})), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY qid, label ORDER BY dist, id) <= 3), z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY qid, part ORDER BY dist, id) <= 4) SELECT qid, rank, id, dist, label, part FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM z) WHERE rank <= {K}")
def knn_crowding_multi(spark, sf_dir):
    pairs = S.all_pairs(*both(spark, sf_dir), "l2").withColumn("part", F.col("id") % 3)
    return N.crowded_by(pairs, {"label": 3, "part": 4}, K)


ORACLES["knn_crowding_multi"] = ORACLES["knn_crowding_multi"].replace(") , x AS", "), x AS")


@query("imi")
def imi(spark, sf_dir):
    b, q = both(spark, sf_dir)
    x = X.training_rows(b, 4096)
    return N.multi_search(b, q, [X.lloyd(x[:, :32], 8, 10), X.lloyd(x[:, 32:], 8, 10)], K, 8)


@query("product_residual")
def product_residual(spark, sf_dir):
    b = base(spark, sf_dir)
    coded = N.product_residual_encode(b, N.product_residual_books(X.training_rows(b, 4096), 4, 2, 8, 5))
    return coded.select("id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"), F.round(F.expr("aggregate(rest, 0D, (a, x) -> a + x * x)"), 6).alias("error"))


@query("anisotropic_pq")
def anisotropic_pq(spark, sf_dir):
    b, q = both(spark, sf_dir)
    books = _books(spark, sf_dir)
    return X.pq_search(N.anisotropic_encode(b, books).select("id", "code"), q, books, K)


@query("spectral_hash")
def spectral_hash(spark, sf_dir):
    b, q = both(spark, sf_dir)
    x = X.training_rows(b, 4096)
    values, axes = np.linalg.eigh(np.cov((x - x.mean(0)).T))
    axes = axes[:, np.argsort(-values)[:24]].round(6)
    bits = lambda df, v, name: N.spectral_bits(df, axes, x.mean(0), 0.3, v, name)
    pairs = bits(b, "v", "bits").select("id", "bits").join(F.broadcast(bits(q, "q", "qbits").select("qid", "qbits")))
    return S.top_k(pairs.select("qid", "id", F.expr(X.coordinate_sum("CASE WHEN x <> y THEN 1 ELSE 0 END", "qbits", "bits")).alias("dist")), K)


@query("query_aware_hash")
def query_aware_hash(spark, sf_dir):
    return N.query_aware_search(*both(spark, sf_dir), K, save=saver(spark))


@query("dynamic_bucket_hash")
def dynamic_bucket_hash(spark, sf_dir):
    return N.dynamic_bucket_search(*both(spark, sf_dir), K, save=saver(spark))


@query("projected_hash_bounded")
def projected_hash_bounded(spark, sf_dir):
    b, q = both(spark, sf_dir)
    return P.projected_candidates(b, q, X.hyperplanes(15, 64, 12) / np.sqrt(N.chi_square_quantile(15)), K, int(0.1 * b.count()) + K, saver(spark))


@query("code_patterns")
def code_patterns(spark, sf_dir):
    """Frequent sets of centroids among the codes."""
    from pyspark.ml.fpm import FPGrowth

    coded = X.pq_encode(base(spark, sf_dir), _books(spark, sf_dir))
    items = coded.select(F.transform("code", lambda c, j: F.concat_ws(":", j.cast("string"), c.cast("string"))).alias("items"))
    found = FPGrowth(minSupport=0.02, minConfidence=0.5).fit(items).freqItemsets
    return found.select(F.array_join(F.array_sort("items"), " ").alias("items"), "freq")


# -- k-means steps beyond the plain one, from the rows with the 16 least ids

_MEANS = "SELECT list_no, pos, avg(x) AS x FROM (SELECT list_no, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM lists) GROUP BY 1, 2"


@query("spherical_step", f", m AS ({_MEANS}), n AS (SELECT list_no, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT list_no, pos, round(x / n, 6) AS x FROM m JOIN n USING (list_no)")
def spherical_step(spark, sf_dir):
    from lodestar.functions.vectors import normalize

    step = X.kmeans_step(base(spark, sf_dir), first_centroids(spark, sf_dir)).withColumn("c", normalize("c"))
    return step.select(F.col("list_no").cast("long").alias("list_no"), F.posexplode("c").alias("pos", "x")).select("list_no", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("weighted_step", "SELECT list_no, pos, round(sum(x * w) / sum(w), 6) AS x FROM (SELECT list_no, id % 3 + 1 AS w, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM lists) GROUP BY 1, 2")
def weighted_step(spark, sf_dir):
    own = X.assign(base(spark, sf_dir), first_centroids(spark, sf_dir)).select(F.col("list_no").cast("long").alias("list_no"), (F.col("id") % 3 + 1).alias("w"), F.posexplode("v").alias("pos", "x"))
    return own.groupBy("list_no", F.col("pos").cast("long").alias("pos")).agg(F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 6).alias("x"))


@query("kmeans_3_steps")
def kmeans_3_steps(spark, sf_dir):
    """Three distributed steps; the centroids, a bounded matrix, go by the driver between them."""
    b, c = base(spark, sf_dir), first_centroids(spark, sf_dir)
    for _ in range(3):
        found = {r.list_no: r.c for r in X.kmeans_step(b, c).collect()}
        c = np.array([found.get(k, list(x)) for k, x in enumerate(c)])
    return X.assign(b, c).groupBy("list_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("list_dist"), 6).alias("loss"))


#: Centroids of which the last can get no row: it stands far from all of them.
_FAR = "f AS (SELECT list_no, c FROM c WHERE list_no < 7 UNION ALL SELECT 7, list_transform(c, lambda z: z + 100) FROM c WHERE list_no = 7)"
_FAR_LISTS = _nearest("b", "id", "v", 1).replace("FROM b, c)", "FROM b, f c)")


@query("empty_list_split", f", {_FAR}, own AS ({_FAR_LISTS}), n AS (SELECT list_no, count(*) AS n FROM own GROUP BY list_no), big AS (SELECT list_no FROM n ORDER BY n DESC, list_no LIMIT 1), m AS (SELECT list_no, pos, avg(x) AS x FROM (SELECT list_no, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM own) GROUP BY 1, 2) SELECT list_no, pos, round(CASE WHEN list_no IN (SELECT list_no FROM big) THEN x * CASE WHEN pos % 2 = 1 THEN 1 + 1 / 1024.0::DOUBLE ELSE 1 - 1 / 1024.0::DOUBLE END ELSE x END, 6) AS x FROM m UNION ALL SELECT 7, pos, round(x * CASE WHEN pos % 2 = 1 THEN 1 - 1 / 1024.0::DOUBLE ELSE 1 + 1 / 1024.0::DOUBLE END, 6) FROM m WHERE list_no IN (SELECT list_no FROM big)")
def empty_list_split(spark, sf_dir):
    """One step of k-means in which a centroid gets no row and is split off the largest list."""
    c = first_centroids(spark, sf_dir, 8)
    c[7] = c[7] + 100
    b = base(spark, sf_dir)
    step = X.split_empty(X.kmeans_step(b, c), 8)
    return step.select(F.col("list_no").cast("long").alias("list_no"), F.posexplode("c").alias("pos", "x")).select("list_no", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


# -- merging and tuning


@query("triple_union", ", x AS (SELECT qid, id FROM (" + " UNION ".join(f"SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY {duck.measure('l2', f'q[{a}:{b}]', f'v[{a}:{b}]')}, id) AS rank FROM q, b) WHERE rank <= 5" for a, b in ((1, 20), (21, 40), (41, 64))) + ")) SELECT DISTINCT qid, id FROM x")
def triple_union(spark, sf_dir):
    from lodestar.operators import merge as M

    b, q = both(spark, sf_dir)
    part = lambda a, n: S.knn(b.withColumn("v", F.slice("v", a, n)), q.withColumn("q", F.slice("q", a, n)), 5)
    return M.pair_union(part(1, 20), part(21, 20), part(41, 24))


@query("operating_points_merged", ", pts AS (SELECT 'a:' || p_partkey AS key, (p_partkey * 37 % 500) / 500.0::DOUBLE AS perf, 1 + (p_partkey * 53 % 900) / 10.0::DOUBLE AS t FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'b:' || p_partkey, (p_partkey * 37 % 500) / 500.0::DOUBLE, 1 + (p_partkey * 53 % 900) / 10.0::DOUBLE FROM part WHERE p_partkey % 2 = 1), best AS (SELECT * FROM pts WHERE perf > 0 QUALIFY row_number() OVER (PARTITION BY perf ORDER BY t, key) = 1) SELECT key, perf, t FROM (SELECT *, min(t) OVER (ORDER BY perf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best) WHERE before IS NULL OR t < before")
def operating_points_merged(spark, sf_dir):
    from lodestar.operators.metrics import pareto_front
    from lodestar.plans.vector_queries import points

    p = points(spark, sf_dir)
    tag = lambda name, rest: p.where(F.col("key") % 2 == rest).withColumn("key", F.concat(F.lit(f"{name}:"), F.col("key").cast("string")))
    return pareto_front(tag("a", 0).unionByName(tag("b", 1)))


@query("param_grid", "SELECT nprobe, m, nprobe * m AS cost FROM (VALUES (1), (4), (16)) a(nprobe), (VALUES (4), (8)) b(m)")
def param_grid(spark, sf_dir):
    from lodestar.plans.spec import param_grid as grid

    return spark.createDataFrame([(x["nprobe"], x["m"], x["nprobe"] * x["m"]) for x in grid(nprobe=[1, 4, 16], m=[4, 8])], "nprobe int, m int, cost int")


@query("autopilot_plan")
def autopilot_plan(spark, sf_dir):
    from lodestar.plans.spec import autopilot

    b = base(spark, sf_dir)
    n, d = b.count(), len(b.first().v)
    return spark.createDataFrame([(n * f, d, autopilot(n * f, d)) for f in (1, 1000, 100_000)], "n long, dimension int, plan string")


for _name in ("spherical_step", "triple_union", "operating_points_merged"):
    ORACLES[_name] = ORACLES[_name].replace(") , ", "), ", 1)
