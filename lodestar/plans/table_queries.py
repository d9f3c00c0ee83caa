"""Registered queries of text helpers, row and list operators, bit measures, filters and costs, with their DuckDB texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import distances as D
from lodestar.functions import texts as T
from lodestar.functions import vectors as V
from lodestar.operators import indexes as X
from lodestar.operators import lists as L
from lodestar.operators import merge as M
from lodestar.operators import search as S
from lodestar.plans import duck
from lodestar.plans.analytics_queries import RUNS, VALID, _SIDE, runs, side
from lodestar.plans.vector_queries import _BITS, _FIRST, _LISTS, _PIECES, _PQCODE, K, _books, _nearest, _words, base, both, first_centroids, halves, saver

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str, whole: bool = False):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql if whole else f"WITH {duck.BASE}{sql}" if sql.startswith(",") else f"WITH {duck.BASE} {sql}"
        return f

    return add


def part(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("id"))


# -- texts

_RAW = "raw AS (SELECT p_partkey::BIGINT AS id, CASE p_partkey % 4 WHEN 0 THEN 'A+B' WHEN 1 THEN ' A  +  B ' WHEN 2 THEN 'C' ELSE 'A +B+ C' END AS combo, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_partkey || '.5 ' WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN '1e3' ELSE '-' || p_partkey END AS num, CASE p_partkey % 3 WHEN 0 THEN 'ds' || p_partkey || '_profile_' || (p_partkey % 9) || '.csv' WHEN 1 THEN 'sift_20_variants_profile2.csv' ELSE 'other' || p_partkey || '.txt' END AS name, 'VAQ' || (p_partkey % 256) || 'm' || (p_partkey % 32) || 'min' || (p_partkey % 4) || 'max' || (p_partkey % 13) || CASE WHEN p_partkey % 2 = 0 THEN 'var0.95' ELSE '' END || ',EA' AS method, 'nprobe=' || (p_partkey % 64) || ', ht=' || (p_partkey % 30) AS params FROM part)"


def raw(spark, sf_dir) -> DataFrame:
    n = F.col("id")
    s = lambda c: c.cast("string")
    return part(spark, sf_dir).select(
        "id",
        F.when(n % 4 == 0, "A+B").when(n % 4 == 1, " A  +  B ").when(n % 4 == 2, "C").otherwise("A +B+ C").alias("combo"),
        F.when(n % 5 == 0, F.concat(F.lit(" "), s(n), F.lit(".5 "))).when(n % 5 == 1, "n/a").when(n % 5 == 2, "").when(n % 5 == 3, "1e3").otherwise(F.concat(F.lit("-"), s(n))).alias("num"),
        F.when(n % 3 == 0, F.concat(F.lit("ds"), s(n), F.lit("_profile_"), s(n % 9), F.lit(".csv"))).when(n % 3 == 1, "sift_20_variants_profile2.csv").otherwise(F.concat(F.lit("other"), s(n), F.lit(".txt"))).alias("name"),
        F.concat(F.lit("VAQ"), s(n % 256), F.lit("m"), s(n % 32), F.lit("min"), s(n % 4), F.lit("max"), s(n % 13), F.when(n % 2 == 0, "var0.95").otherwise(""), F.lit(",EA")).alias("method"),
        F.concat(F.lit("nprobe="), s(n % 64), F.lit(", ht="), s(n % 30)).alias("params"),
    )


@query("combo_normalised", f"WITH {_RAW} SELECT id, regexp_replace(trim(combo), '\\s*\\+\\s*', ' + ', 'g') AS combo FROM raw", True)
def combo_normalised(spark, sf_dir):
    return raw(spark, sf_dir).select("id", T.combination(F.col("combo")).alias("combo"))


@query("numeric_coerced", f"WITH {_RAW} SELECT id, try_cast(trim(num) AS DOUBLE) AS x, coalesce(try_cast(trim(num) AS DOUBLE), -1) AS filled FROM raw", True)
def numeric_coerced(spark, sf_dir):
    return raw(spark, sf_dir).select("id", T.number(F.col("num")).alias("x"), T.number(F.col("num"), -1).alias("filled"))


_FILE = "^(.+)_profile_?([0-9]+)\\.csv$"


@query("file_name_parsed", f"WITH {_RAW} SELECT id, CASE WHEN regexp_matches(name, '{_FILE}') THEN replace(regexp_extract(name, '{_FILE}', 1), '_20_variants', '') END AS dataset, CASE WHEN regexp_matches(name, '{_FILE}') THEN regexp_extract(name, '{_FILE}', 2)::INT END AS profile FROM raw", True)
def file_name_parsed(spark, sf_dir):
    return raw(spark, sf_dir).withColumn("p", T.file_parts(F.col("name"))).select("id", "p.dataset", "p.profile")


@query("method_parsed", f"WITH {_RAW} SELECT id, nullif(regexp_extract(method, '^[A-Za-z]+([0-9]+)', 1), '')::INT AS bits, nullif(regexp_extract(method, 'm([0-9]+)', 1), '')::INT AS pieces, nullif(regexp_extract(method, 'min([0-9]+)', 1), '')::INT AS least, nullif(regexp_extract(method, 'max([0-9]+)', 1), '')::INT AS most, nullif(regexp_extract(method, 'var([0-9.]+)', 1), '')::DOUBLE AS variance, regexp_extract(method, ',([A-Z]+)$', 1) AS mode FROM raw", True)
def method_parsed(spark, sf_dir):
    return raw(spark, sf_dir).withColumn("p", T.method_parts(F.col("method"))).select("id", "p.*")


@query("params_from_string", f"WITH {_RAW} SELECT id, regexp_extract(params, 'nprobe=([0-9]+)', 1)::INT AS nprobe, regexp_extract(params, 'ht=([0-9]+)', 1)::INT AS ht FROM raw", True)
def params_from_string(spark, sf_dir):
    return raw(spark, sf_dir).withColumn("m", T.settings(F.col("params"))).select("id", F.col("m")["nprobe"].cast("int").alias("nprobe"), F.col("m")["ht"].cast("int").alias("ht"))


@query("headers_found", f"WITH {RUNS} SELECT dataset, count(*) AS n, round(max(recall), 6) AS best FROM runs GROUP BY dataset", True)
def headers_found(spark, sf_dir):
    """Columns by name, whatever their case and white space."""
    r = T.stripped(runs(spark, sf_dir).withColumnsRenamed({"recall": " Refined  Recall ", "dataset": "DataSet"}))
    return r.groupBy(F.col(T.found_column(r, "dataset")).alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(f"`{T.found_column(r, 'recall', 'refined recall')}`"), 6).alias("best"))


@query("csv_roundtrip", f"WITH {RUNS} SELECT id, dataset, combo, recall, qps FROM runs", True)
def csv_roundtrip(spark, sf_dir):
    """A result table as CSV with a header, and back with its types."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        saver(spark)
        folder = spark.conf.get("spark.checkpoint.dir")
    path = f"{folder.rstrip('/')}/lodestar/results-{uuid.uuid4().hex}"
    r = runs(spark, sf_dir).select("id", "dataset", "combo", "recall", "qps")
    r.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(r.schema).csv(path)


@query("sampled_scan", "SELECT id, round(list_sum(v), 6) AS s FROM b WHERE id % 7 = 3")
def sampled_scan(spark, sf_dir):
    return base(spark, sf_dir).where("id % 7 = 3").select("id", F.round(F.expr("aggregate(v, 0D, (a, x) -> a + x)"), 6).alias("s"))


# -- bit measures on sign words

_W = f"w AS (SELECT id, {_BITS.format(v='v', a=1, b=32)} AS w0, {_BITS.format(v='v', a=33, b=64)} AS w1 FROM b), x AS (SELECT a.id AS qid, b.id, a.w0 AS a0, a.w1 AS a1, b.w0 AS b0, b.w1 AS b1 FROM w a, w b WHERE a.id % 100 = 0)"


def sign_pairs(spark, sf_dir) -> DataFrame:
    b, q = both(spark, sf_dir)
    return S.all_pairs(b.withColumn("v", _words("v")), q.withColumn("q", _words("q")), F.struct(F.col("q")[0].alias("a0"), F.col("q")[1].alias("a1"), F.col("v")[0].alias("b0"), F.col("v")[1].alias("b1"))).select("qid", "id", "dist.*")


@query("sub_range_hamming", f", {_W} SELECT qid, id, bit_count(xor(a1, b1))::BIGINT AS dist FROM x")
def sub_range_hamming(spark, sf_dir):
    return sign_pairs(spark, sf_dir).select("qid", "id", F.expr("CAST(bit_count(a1 ^ b1) AS BIGINT)").alias("dist"))


@query("generalized_hamming", f", {_W} SELECT qid, id, (" + " + ".join(f"(((a{w} >> {s}) & 255) <> ((b{w} >> {s}) & 255))::BIGINT" for w in (0, 1) for s in (0, 8, 16, 24)) + ") AS dist FROM x")
def generalized_hamming(spark, sf_dir):
    """Differing bytes of two codes."""
    return sign_pairs(spark, sf_dir).select("qid", "id", F.expr(" + ".join(f"CAST(((a{w} >> {s}) & 255) <> ((b{w} >> {s}) & 255) AS BIGINT)" for w in (0, 1) for s in (0, 8, 16, 24))).alias("dist"))


@query("binary_dot", f", {_W} SELECT qid, id, (bit_count(a0 & b0) + bit_count(a1 & b1))::BIGINT AS dot FROM x")
def binary_dot(spark, sf_dir):
    return sign_pairs(spark, sf_dir).select("qid", "id", F.expr("CAST(bit_count(a0 & b0) + bit_count(a1 & b1) AS BIGINT)").alias("dot"))


@query("binary_cosine", f", {_W} SELECT qid, id, round(1 - (bit_count(a0 & b0) + bit_count(a1 & b1)) / sqrt((bit_count(a0) + bit_count(a1))::DOUBLE * (bit_count(b0) + bit_count(b1))), 6) AS dist FROM x")
def binary_cosine(spark, sf_dir):
    return sign_pairs(spark, sf_dir).select("qid", "id", F.expr("round(1 - (bit_count(a0 & b0) + bit_count(a1 & b1)) / sqrt(CAST(bit_count(a0) + bit_count(a1) AS DOUBLE) * (bit_count(b0) + bit_count(b1))), 6)").alias("dist"))


# -- vectors

@query("vector_arithmetic", "SELECT qid, id, round(list_sum(list_transform(list_zip(q, v), lambda p: abs(p[1] + p[2]))), 6) AS added, round(list_sum(list_transform(list_zip(q, v), lambda p: abs(p[1] - p[2]))), 6) AS less, round(list_sum(list_transform(list_zip(q, v), lambda p: abs(p[1] + 2.5::DOUBLE * p[2]))), 6) AS scaled, list_position(v, list_min(v))::BIGINT - 1 AS argmin FROM q, b")
def vector_arithmetic(spark, sf_dir):
    b, q = both(spark, sf_dir)
    b = b.select("id", "v", (F.array_position("v", F.array_min("v")) - 1).cast("long").alias("argmin"))
    out = S.all_pairs(b, q, "l1", digits=6, times={"added": -1.0, "less": 1.0, "scaled": -2.5})  # |q + v| is the distance to -v
    return out.select("qid", "id", "added", "less", "scaled", "argmin")


@query("l2_from_products", "SELECT qid, id, round(sqrt(greatest(0, " + duck.total("x * y", "q", "q") + " + " + duck.total("x * y", "v", "v") + " - 2 * " + duck.total("x * y", "q", "v") + ")), 5) AS dist FROM q, b WHERE qid <> id")
def l2_from_products(spark, sf_dir):
    b, q = both(spark, sf_dir)
    terms = {"s": "x * y", "p": "x * x", "r": "y * y"}
    products = {"s": lambda x, y: x * y, "p": lambda x, y: x * x, "r": lambda x, y: y * y}
    D.register("l2_products", terms, "sqrt(greatest(0.0D, p + r - 2 * s))", block=(products, lambda s, p, r: np.sqrt(np.maximum(0.0, p + r - 2 * s))))
    return S.all_pairs(b.select("id", "v"), q, "l2_products", digits=5).where("qid <> id")


_CUTS = ((1, 8), (9, 24), (33, 32))


@query("variable_chunks", "SELECT id, j, round(s, 6) AS s FROM (SELECT id, unnest([0, 1, 2])::BIGINT AS j, unnest([" + ", ".join(f"list_sum(v[{a}:{a + n - 1}])" for a, n in _CUTS) + "]) AS s FROM b)")
def variable_chunks(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.posexplode(F.array(*[F.slice("v", a, n) for a, n in _CUTS])).alias("j", "c")).select("id", F.col("j").cast("long").alias("j"), F.round(F.expr("aggregate(c, 0D, (a, x) -> a + x)"), 6).alias("s"))


@query("remap_dims", "SELECT id, list_transform(range(0, 8), lambda k: round(v[63 - 7 * k + 1], 6)) AS v FROM b")
def remap_dims(spark, sf_dir):
    """Small negative coordinates become -0.0, as in SQL; Spark's round alone gives 0.0."""
    return base(spark, sf_dir).select("id", F.expr("transform(transform(sequence(0, 7), k -> get(v, 63 - 7 * k)), x -> signum(x) * round(abs(x), 6))").alias("v"))


@query("variance_explained", ", x AS (SELECT unnest(range(0, 64)) AS pos, unnest(v) AS x FROM b), s AS (SELECT pos, var_pop(x) AS s FROM x GROUP BY pos) SELECT pos, round(sum(s) OVER (ORDER BY s DESC, pos ROWS UNBOUNDED PRECEDING) / sum(s) OVER (), 6) AS share FROM s")
def variance_explained(spark, sf_dir):
    """Cumulative share of the variance, axis by axis; one row for each dimension."""
    from pyspark.sql import Window

    s = base(spark, sf_dir).select(F.posexplode("v").alias("pos", "x")).groupBy(F.col("pos").cast("long").alias("pos")).agg(F.var_pop("x").alias("s"))
    w = Window.orderBy(F.col("s").desc(), "pos").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("pos", F.round(F.sum("s").over(w) / F.sum("s").over(Window.partitionBy()), 6).alias("share"))


@query("kmin_rowwise", "SELECT id, k, x, pos FROM (SELECT id, pos, round(x, 6) AS x, row_number() OVER (PARTITION BY id ORDER BY x, pos) AS k FROM (SELECT id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM b)) WHERE k <= 5")
def kmin_rowwise(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.posexplode(L.smallest("v", 5)).alias("k", "e")).select("id", (F.col("k") + 1).cast("long").alias("k"), F.round("e.x", 6).alias("x"), F.col("e.pos").cast("long").alias("pos"))


@query("kmax_rowwise", "SELECT id, k, x, pos FROM (SELECT id, pos, round(x, 6) AS x, row_number() OVER (PARTITION BY id ORDER BY x DESC, pos) AS k FROM (SELECT id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM b)) WHERE k <= 5")
def kmax_rowwise(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.posexplode(L.smallest("v", 5, True)).alias("k", "e")).select("id", (F.col("k") + 1).cast("long").alias("k"), F.round("e.x", 6).alias("x"), F.col("e.pos").cast("long").alias("pos"))


@query("argsort_rowwise", "SELECT id, (row_number() OVER (PARTITION BY id ORDER BY x, pos) - 1)::BIGINT AS k, pos FROM (SELECT id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM b)")
def argsort_rowwise(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.posexplode(L.argsort("v")).alias("k", "pos")).select("id", F.col("k").cast("long").alias("k"), F.col("pos").cast("long").alias("pos"))


@query("partition_by_share", "SELECT id, v[1] <= (SELECT quantile_cont(v[1], 0.3::DOUBLE) FROM b) AS low FROM b")
def partition_by_share(spark, sf_dir):
    return L.parted(base(spark, sf_dir).select("id", F.col("v")[0].alias("x")), "x", 0.3).select("id", "low")


@query("stable_sort_ranks", "SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY round(v[1], 1) DESC, round(v[2], 1), id) AS rank FROM b")
def stable_sort_ranks(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy(F.round(F.col("v")[0], 1).desc(), F.round(F.col("v")[1], 1), "id")
    return base(spark, sf_dir).select("id", "label", F.row_number().over(w).cast("long").alias("rank"))


# -- filters

@query("knn_min_distance", duck.knn("l2", where=f"{duck.measure('l2')} >= 1.0"))
def knn_min_distance(spark, sf_dir):
    b, q = both(spark, sf_dir)
    return S.top_k(S.all_pairs(b.select("id", "v"), q, "l2", (1.0, None), K), K)


@query("knn_disjoint_tokens", f", t AS (SELECT id AS qid, label AS token FROM b WHERE id % 100 = 0) SELECT qid, rank, id, dist FROM (SELECT qid, id, {duck.measure('l2')} AS dist, row_number() OVER (PARTITION BY qid ORDER BY {duck.measure('l2')}, id) AS rank FROM q JOIN t USING (qid) JOIN b ON b.label = t.token) WHERE rank <= {K}")
def knn_disjoint_tokens(spark, sf_dir):
    """Each query sees the rows of its own token only; a join on the token."""
    b = base(spark, sf_dir)
    q = b.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), "label")
    return S.top_k(b.join(q, "label").select("qid", "id", D.distance("l2").alias("dist")), K)


@query("knn_allowlist", duck.knn("l2", where="id IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_partkey + 1 FROM part WHERE p_partkey % 50 = 0)"))
def knn_allowlist(spark, sf_dir):
    """Rows are denied unless a list, or what was appended to it, names them."""
    b, q = both(spark, sf_dir)
    p = part(spark, sf_dir)
    allowed = p.where("id % 2 = 0").unionByName(p.where("id % 50 = 0").select((F.col("id") + 1).alias("id"))).distinct()
    return S.knn(b.join(allowed, "id", "left_semi"), q, K)


@query("knn_predicate", duck.knn("l2", where="list_sum(v) > 0 AND label <> 2"))
def knn_predicate(spark, sf_dir):
    """Any predicate over the row."""
    b, q = both(spark, sf_dir)
    return S.knn(b.where(F.expr("aggregate(v, 0D, (a, x) -> a + x) > 0 AND label <> 2")), q, K)


@query("dist_registered", "SELECT qid, id, round(" + duck.total("(x - y) * (x - y) * (x - y) * (x - y)", "q", "v") + ", 6) AS dist FROM q, b")
def dist_registered(spark, sf_dir):
    """A measure that a caller registers."""
    D.register("fourth_power", {"s": "(x - y) * (x - y) * (x - y) * (x - y)"}, "s", block=({"s": D.fourth_power}, lambda s: s))
    b, q = both(spark, sf_dir)
    return S.all_pairs(b.select("id", "v"), q, "fourth_power", digits=6)


@query("knn_pruned", duck.knn("l2"))
def knn_pruned(spark, sf_dir):
    b, q = both(spark, sf_dir)
    c = first_centroids(spark, sf_dir)
    probes = X.assign(q, c, len(c), "q").select("qid", "list_no", "list_dist")
    return L.pruned_search(X.assign(b, c).select("id", "v", "list_no", "list_dist"), q, probes, K)


# -- lists

@query("ids_intersect", f"{_LISTS} SELECT qid, id FROM w WHERE votes = 2", True)
def ids_intersect(spark, sf_dir):
    _, _, x, y = halves(spark, sf_dir)
    return L.intersect(x, y)


@query("ids_except", f"{_LISTS} SELECT qid, id FROM la WHERE (qid, id) NOT IN (SELECT (qid, id) FROM lb)", True)
def ids_except(spark, sf_dir):
    _, _, x, y = halves(spark, sf_dir)
    return L.except_(x, y)


@query("shared_list_sizes", f"{_LISTS} SELECT qid, sum((votes = 2)::INT)::BIGINT AS n FROM w GROUP BY qid", True)
def shared_list_sizes(spark, sf_dir):
    _, _, x, y = halves(spark, sf_dir)
    return L.shared_sizes(x, y)


@query("running_precision", f"{_LISTS}, truth AS ({duck.knn('l2')}) SELECT qid, rank, round(avg(hit) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING), 6) AS precision FROM (SELECT qid, rank, ((qid, id) IN (SELECT (qid, id) FROM truth))::INT AS hit FROM la)", True)
def running_precision(spark, sf_dir):
    b, q, x, _ = halves(spark, sf_dir)
    return L.running_precision(x, S.knn(b, q, K)).select("qid", "rank", F.round("precision", 6).alias("precision"))


@query("recall_100q", f"{_LISTS}, truth AS ({duck.knn('l2')}), f AS (SELECT qid FROM q ORDER BY qid LIMIT 100) SELECT round((SELECT count(*) FROM la JOIN truth USING (qid, id) WHERE qid IN (SELECT qid FROM f)) / ((SELECT count(*) FROM f) * {K}), 6) AS recall", True)
def recall_100q(spark, sf_dir):
    """Recall over the first 100 queries, by definition."""
    from lodestar.operators.metrics import recall_at_k

    b, q, x, _ = halves(spark, sf_dir)
    first = q.select("qid").orderBy("qid").limit(100)
    return recall_at_k(x.join(first, "qid", "left_semi"), S.knn(b, q, K).join(first, "qid", "left_semi"), K).select("recall")


_QUARTERS = [(1, 16), (17, 32), (33, 48), (49, 64)]


@query("quad_union", f", x AS ({' UNION '.join(f'SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY ' + duck.measure('l2', f'q[{a}:{b}]', f'v[{a}:{b}]') + ', id) AS rank FROM q, b) WHERE rank <= 5' for a, b in _QUARTERS)}) SELECT qid, id FROM x")
def quad_union(spark, sf_dir):
    b, q = both(spark, sf_dir)
    return M.pair_union(*[S.knn(b.withColumn("v", F.slice("v", a, 16)), q.withColumn("q", F.slice("q", a, 16)), 5) for a, _ in _QUARTERS])


@query("config_quads", f"WITH {RUNS}, {VALID}, a AS ({_SIDE.format(m='A')}), b AS ({_SIDE.format(m='B')}), c AS ({_SIDE.format(m='C')}), d AS ({_SIDE.format(m='A + B')}), g AS (SELECT 'A' AS m, dataset, count(*) AS n, max(recall) AS r FROM a GROUP BY 2 UNION ALL SELECT 'B', dataset, count(*), max(recall) FROM b GROUP BY 2 UNION ALL SELECT 'C', dataset, count(*), max(recall) FROM c GROUP BY 2 UNION ALL SELECT 'D', dataset, count(*), max(recall) FROM d GROUP BY 2) SELECT dataset, product(n)::DOUBLE AS n, round(min(r), 6) AS least_best FROM g GROUP BY dataset HAVING count(*) = 4", True)
def config_quads(spark, sf_dir):
    """How many quadruples of configurations a dataset has, and the least of the four models' best recalls."""
    r = runs(spark, sf_dir)
    own = lambda m, k: side(r, m).groupBy("dataset").agg(F.count(F.lit(1)).alias(f"n_{k}"), F.max("recall").alias(f"r_{k}"))
    every = own("A", "a")
    for m, k in (("B", "b"), ("C", "c"), ("A + B", "d")):
        every = every.join(own(m, k), "dataset")
    return every.select("dataset", (F.col("n_a") * F.col("n_b") * F.col("n_c") * F.col("n_d")).cast("double").alias("n"), F.round(F.least("r_a", "r_b", "r_c", "r_d"), 6).alias("least_best"))


_SMALL = f"small AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY {duck.measure('l2', 'q[1:16]', 'v[1:16]')}, id) AS rank FROM q, b), truth AS ({duck.knn('l2')})"


@query("refinement_curve", f", {_SMALL}, f AS (SELECT unnest([1, 2, 3, 4, 5]) AS factor), hit AS (SELECT factor, qid, id, row_number() OVER (PARTITION BY factor, qid ORDER BY {duck.measure('l2')}, id) AS r FROM f, small JOIN q USING (qid) JOIN b USING (id) WHERE small.rank <= factor * {K}) SELECT factor, round(count(*) / ((SELECT count(*) FROM q) * {K}), 6) AS recall FROM hit JOIN truth USING (qid, id) WHERE r <= {K} GROUP BY factor")
def refinement_curve(spark, sf_dir):
    b, q = both(spark, sf_dir)
    ranked = S.top_k(S.all_pairs(b.withColumn("v", V.truncate(16)), q.withColumn("q", V.truncate(16, "q")), "l2"), 5 * K)
    return L.refinement_curve(ranked, b, q, S.knn(b, q, K), K, [1, 2, 3, 4, 5]).select("factor", F.round("recall", 6).alias("recall"))


_RADII = [0.9, 1.0, 1.1, 1.2]
_FOUND = f"t AS (SELECT qid, id, dist FROM ({duck.pairs('l2')}) WHERE dist < 1.2), f AS (SELECT qid, id, dist * 1.4 AS dist FROM (SELECT qid, id, {duck.measure('l2', 'q[1:32]', 'v[1:32]')} AS dist FROM q, b) WHERE dist * 1.4 < 1.2)"


def found_in_range(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b, q = both(spark, sf_dir)
    half = S.all_pairs(b.withColumn("v", F.slice("v", 1, 32)), q.withColumn("q", F.slice("q", 1, 32)), "l2", (None, 1.2 / 1.4 + 1e-9)).select("qid", "id", (F.col("dist") * 1.4).alias("dist"))
    return half.where("dist < 1.2D"), S.range_search(b, q, 1.2)


@query("range_pr_thresholds", f", {_FOUND}, r AS (SELECT unnest({_RADII!r}::DOUBLE[]) AS radius), n AS (SELECT radius, (SELECT count(*) FROM f WHERE dist < radius) AS nf, (SELECT count(*) FROM t WHERE dist < radius) AS nt, (SELECT count(*) FROM f JOIN t USING (qid, id) WHERE f.dist < radius AND t.dist < radius) AS nb FROM r) SELECT radius, round(CASE WHEN nf = 0 THEN 1 ELSE nb / nf END, 6) AS precision, round(CASE WHEN nt = 0 THEN 1 ELSE nb / nt END, 6) AS recall FROM n")
def range_pr_thresholds(spark, sf_dir):
    return L.range_precision_recall(*found_in_range(spark, sf_dir), _RADII).select("radius", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("filter_range_results", f", {_FOUND} SELECT q.qid, count(id) AS n, min(dist) AS nearest FROM q LEFT JOIN (SELECT * FROM t WHERE dist < 1.0) t ON q.qid = t.qid GROUP BY q.qid")
def filter_range_results(spark, sf_dir):
    """Range results under a smaller radius, with the new number of each query's results."""
    b, q = both(spark, sf_dir)
    kept = S.range_search(b, q, 1.2).where("dist < 1.0D")
    return q.select("qid").join(kept, "qid", "left").groupBy("qid").agg(F.count("id").alias("n"), F.min("dist").alias("nearest"))


# -- lists of an index

_IVF = f", {_FIRST}, lists AS ({_nearest('b', 'id', 'v', 1)}), probes AS ({_nearest('q', 'qid', 'q', 4)}), sizes AS (SELECT list_no, count(*) AS n FROM lists GROUP BY list_no)"


def probed(spark, sf_dir):
    b, q = both(spark, sf_dir)
    c = first_centroids(spark, sf_dir)
    return b, q, X.assign(b, c), X.assign(q, c, 4, "q")


@query("search_costs", f"{_IVF} SELECT qid, sum(coalesce(n, 0))::BIGINT AS compared, round(sum(coalesce(n, 0)) / (SELECT count(*) FROM b), 6) AS share FROM probes LEFT JOIN sizes USING (list_no) GROUP BY qid")
def search_costs(spark, sf_dir):
    _, _, lists, probes = probed(spark, sf_dir)
    return L.probe_costs(lists, probes.select("qid", "list_no")).select("qid", "compared", F.round("share", 6).alias("share"))


@query("ivf_max_codes", f"{_IVF}, o AS (SELECT qid, q, list_no, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY qid ORDER BY list_dist, list_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM probes LEFT JOIN sizes USING (list_no)), hit AS (SELECT qid, id, {duck.measure('l2', 'o.q', 'lists.v')} AS dist FROM o JOIN lists USING (list_no) WHERE before < 60) SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM hit) WHERE rank <= {K}")
def ivf_max_codes(spark, sf_dir):
    from lodestar.operators.more_indexes import search_preassigned

    _, _, lists, probes = probed(spark, sf_dir)
    return search_preassigned(lists.select("id", "v", "list_no"), L.capped_probes(lists, probes, 60).select("qid", "q", "list_no"), K).drop("list_no")


@query("index_health", f"{_IVF} SELECT list_no, count(*) AS n, round(avg(list_dist), 6) AS error FROM lists GROUP BY list_no")
def index_health(spark, sf_dir):
    return L.health(probed(spark, sf_dir)[2]).select(F.col("list_no").cast("long").alias("list_no"), "n", F.round("error", 6).alias("error"))


@query("list_residuals", f"{_IVF} SELECT id, round(sqrt({duck.measure('l2_sq', 'c.c', 'lists.v')}), 6) AS norm, round(lists.v[1] - c.c[1], 6) AS first FROM lists JOIN c USING (list_no)")
def list_residuals(spark, sf_dir):
    c = first_centroids(spark, sf_dir)
    r = X.residuals(X.assign(base(spark, sf_dir), c), c)
    return r.select("id", F.round(V.norm("r"), 6).alias("norm"), F.round(F.col("r")[0], 6).alias("first"))


_RES = f"{_IVF}, m AS (SELECT unnest(range(0, 8)) AS j), res AS (SELECT lists.id, lists.list_no, list_transform(list_zip(lists.v, c.c), lambda p: p[1] - p[2]) AS r FROM lists JOIN c USING (list_no)), book AS (SELECT j, id - 16 AS k, r[j * 8 + 1:j * 8 + 8] AS c FROM res, m WHERE id >= 16 AND id < 32), code AS (SELECT id, list_no, j, k FROM (SELECT res.id, list_no, book.j, k, row_number() OVER (PARTITION BY res.id, book.j ORDER BY {duck.measure('l2_sq', 'c', 'res.r[book.j * 8 + 1:book.j * 8 + 8]')}, k) AS r FROM res, book) WHERE r = 1), qr AS (SELECT qid, list_no, list_transform(list_zip(probes.q, c.c), lambda p: p[1] - p[2]) AS r FROM probes JOIN c USING (list_no)), lut AS (SELECT qid, list_no, j, k, {duck.measure('l2_sq', 'r[j * 8 + 1:j * 8 + 8]', 'c')} AS d FROM qr, book), s AS (SELECT qid, id, round(sum(d), 6) AS dist FROM code JOIN lut USING (list_no, j, k) GROUP BY qid, id)"


@query("ivf_pq_residual", f"{_RES} SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s) WHERE rank <= {K}")
def ivf_pq_residual(spark, sf_dir):
    """Product codes of what the list's centroid leaves; books are the residuals of 16 rows, so SQL can name them."""
    import numpy as np

    b, q = both(spark, sf_dir)
    c = first_centroids(spark, sf_dir)
    rest = X.residuals(X.assign(b, c), c)
    some = np.array([r.r for r in rest.where("id >= 16 AND id < 32").orderBy("id").select("r").collect()])
    books = np.stack([some[:, 8 * j : 8 * j + 8] for j in range(8)])
    found = X.residual_pq_pairs(X.pq_encode(rest, books, "r").select("id", "list_no", "code"), X.assign(q, c, 4, "q"), c, books)
    return S.top_k(found.select("qid", "id", F.round("dist", 6).alias("dist")), K)


@query("code_histogram", f", {_PIECES}, {_PQCODE} SELECT j, k, count(*) AS n FROM code GROUP BY j, k")
def code_histogram(spark, sf_dir):
    return X.pq_encode(base(spark, sf_dir), _books(spark, sf_dir)).select(F.posexplode("code").alias("j", "k")).groupBy(F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("code_checksum", f", {_PIECES}, {_PQCODE} SELECT id, md5(string_agg(k::VARCHAR, ',' ORDER BY j)) AS sum FROM code GROUP BY id")
def code_checksum(spark, sf_dir):
    return X.pq_encode(base(spark, sf_dir), _books(spark, sf_dir)).select("id", F.md5(F.array_join(F.col("code").cast("array<string>"), ",")).alias("sum"))


@query("pq_decode_error", f", {_PIECES}, {_PQCODE} SELECT id, round(sum({duck.measure('l2_sq', 'book.c', 'b.v[j * 8 + 1:j * 8 + 8]')}), 6) AS error FROM code JOIN book USING (j, k) JOIN b USING (id) GROUP BY id")
def pq_decode_error(spark, sf_dir):
    """Codes and back: what the code loses of each vector."""
    books = _books(spark, sf_dir)
    coded = X.pq_encode(base(spark, sf_dir), books).withColumn("d", X.pq_decode(books))
    return coded.select("id", F.round(D.distance("l2_sq", "d", "v"), 6).alias("error"))


def _uniform(bits: int) -> None:
    top = (1 << bits) - 1
    sql = f", g AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT unnest(v) AS x FROM b)) SELECT id, list_transform(v, lambda z: floor((z - lo) / (hi - lo) * {top} + 0.5)::INT) AS code FROM b, g"

    @query(f"sq{bits}_uniform", sql)
    def run(spark, sf_dir):
        b = base(spark, sf_dir)
        r = b.agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")).first()
        d = len(b.first().v)
        return X.scalar_quantize(b, [r.lo] * d, [r.hi] * d, bits).select("id", "code")


_uniform(8)
_uniform(6)
_uniform(4)


@query("random_neighbours", "SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || ':' || id), id) AS r FROM q, b) WHERE r <= 5")
def random_neighbours(spark, sf_dir):
    """Five rows of each query by a seeded hash: a sampling operator."""
    return S.random_rows(*both(spark, sf_dir), 5)


@query("best_per_parameter", f"WITH {RUNS} SELECT dataset, p, id, recall FROM (SELECT dataset, id % 4 AS p, id, recall, count(*) OVER w AS n, row_number() OVER (PARTITION BY dataset, id % 4 ORDER BY recall DESC, id) AS r FROM runs WHERE recall IS NOT NULL WINDOW w AS (PARTITION BY dataset, id % 4)) WHERE r = 1 AND n >= 5", True)
def best_per_parameter(spark, sf_dir):
    return L.best_of_parameter(runs(spark, sf_dir).withColumn("p", F.col("id") % 4), "p", "recall", 5).select("dataset", "p", "id", "recall")


@query("explored_grid", "WITH g AS (SELECT p_partkey::BIGINT AS id, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 37 % 500) / 500.0::DOUBLE END AS perf, 1 + (p_partkey * 53 % 900) / 10.0::DOUBLE AS t, 1 + (p_partkey * 53 % 900) / 12.0::DOUBLE AS cost_bound, least(1.0, (p_partkey * 41 % 500) / 400.0::DOUBLE) AS perf_bound FROM part) SELECT id FROM g WHERE perf IS NOT NULL OR NOT EXISTS (SELECT 1 FROM g h WHERE h.perf IS NOT NULL AND h.t <= g.cost_bound AND h.perf >= g.perf_bound)", True)
def explored_grid(spark, sf_dir):
    p = F.col("id")
    g = part(spark, sf_dir).select("id", F.when(p % 3 == 0, p * 37 % 500 / F.lit(500.0)).alias("perf"), (1 + p * 53 % 900 / F.lit(10.0)).alias("t"), (1 + p * 53 % 900 / F.lit(12.0)).alias("cost_bound"), F.least(F.lit(1.0), p * 41 % 500 / F.lit(400.0)).alias("perf_bound"))
    return L.explored(g, "perf", "t", ["id"]).select("id")
