"""Registered queries of vector search, merging and evaluation, with their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import distances as D
from lodestar.functions import vectors as V
from lodestar.operators import indexes as X
from lodestar.operators import learned as R
from lodestar.operators import merge as M
from lodestar.operators import metrics as E
from lodestar.operators import pivots as P
from lodestar.operators import search as S
from lodestar.plans import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 10


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {duck.BASE} {sql}"
        return f

    return add


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = base(spark, sf_dir)
    return b, S.queries_of(b)


# -- distances: the stated queries against every row

POSITIVE = {"jensen_shannon", "weighted_jaccard"}
SPARSE = {"nonzero_intersect", "hamming", "jaccard"}


def _prepared(measure: str) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """Spark and DuckDB texts that prepare a vector for a measure: absolute values, or signs of large coordinates."""
    if measure in POSITIVE:
        return (lambda c: f"transform({c}, x -> abs(x))"), (lambda c: f"list_transform({c}, lambda z: abs(z))")
    if measure in SPARSE:
        return (lambda c: f"transform({c}, x -> CASE WHEN x > 0.1D THEN 1D ELSE 0D END)"), (lambda c: f"list_transform({c}, lambda z: CASE WHEN z > 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")
    return (lambda c: c), (lambda c: c)


def _distance_query(measure: str) -> None:
    s, d = _prepared(measure)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, q = both(spark, sf_dir)
        b, q = b.withColumn("v", F.expr(s("v"))), q.withColumn("q", F.expr(s("q")))
        return S.all_pairs(b.select("id", "v"), q, measure, digits=6)

    query(f"dist_{measure}", f"SELECT qid, id, round(CAST({duck.measure(measure, d('q'), d('v'))} AS DOUBLE), 6) AS dist FROM q, b")(run)


for _m in [*D.MEASURES, "linf"]:
    _distance_query(_m)


@query("dist_lp_root", "SELECT qid, id, round(power(" + duck.total("power(abs(x - y), 1.5)", "q", "v") + ", 1 / 1.5), 6) AS dist FROM q, b")
def dist_lp_root(spark, sf_dir):
    b, q = both(spark, sf_dir)
    D.register("lp_root", {"s": "power(abs(x - y), 1.5D)"}, "power(s, 1 / 1.5D)", block=({"s": lambda x, y: np.power(np.abs(x - y), 1.5)}, lambda s: np.power(s, 1 / 1.5)))
    return S.all_pairs(b.select("id", "v"), q, "lp_root", digits=6)


_BITS = "list_sum(list_transform(list_zip(list_transform({v}[{a}:{b}], lambda z: CASE WHEN z >= 0 THEN 1::BIGINT ELSE 0::BIGINT END), range(0, 32)), lambda p: p[1] << p[2]))::BIGINT"


def _words(c: str) -> Column:
    return F.array(*[F.expr(f"aggregate(transform(slice({c}, {a}, 32), (x, i) -> shiftleft(CAST(CASE WHEN x >= 0 THEN 1 ELSE 0 END AS BIGINT), i)), CAST(0 AS BIGINT), (acc, z) -> acc | z)") for a in (1, 33)])


@query("binarize_sign", f"SELECT id, {_BITS.format(v='v', a=1, b=32)} AS w0, {_BITS.format(v='v', a=33, b=64)} AS w1 FROM b")
def binarize_sign(spark, sf_dir):
    return base(spark, sf_dir).withColumn("w", _words("v")).select("id", F.col("w")[0].alias("w0"), F.col("w")[1].alias("w1"))


@query("knn_hamming", f"SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT qid, id, " + duck.total("CASE WHEN (x >= 0) <> (y >= 0) THEN 1 ELSE 0 END", "q", "v") + f"::BIGINT AS dist FROM q, b)) WHERE rank <= {K}")
def knn_hamming(spark, sf_dir):
    b, q = both(spark, sf_dir)
    return S.knn_columns(b.withColumn("v", _words("v")), q.withColumn("q", _words("q")), K, D.bit_hamming().cast("long"))


@query("pairwise_matrix", "SELECT a.id AS i, b.id AS j, round(" + duck.measure("l2_sq", "a.v", "b.v") + ", 6) AS dist FROM b a, b")
def pairwise_matrix(spark, sf_dir):
    b = base(spark, sf_dir).select("id", "v")
    return S.all_pairs(b, b.select(F.col("id").alias("qid"), F.col("v").alias("q")), "l2_sq", digits=6).select(F.col("qid").alias("i"), F.col("id").alias("j"), "dist")


# -- vector maps

@query("normalize_l2", "SELECT id, round(list_sum(list_transform(v, lambda z: abs(z / n))), 6) AS s, round(v[1] / n, 6) AS first FROM (SELECT id, v, sqrt(" + duck.total("x * y", "v", "v") + ") AS n FROM b)")
def normalize_l2(spark, sf_dir):
    return base(spark, sf_dir).withColumn("u", V.normalize()).select("id", F.round(F.expr("aggregate(u, 0D, (a, x) -> a + abs(x))"), 6).alias("s"), F.round(F.col("u")[0], 6).alias("first"))


@query("center", "SELECT id, pos, round(x - avg(x) OVER (PARTITION BY pos), 6) AS x FROM (SELECT id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM b)")
def center(spark, sf_dir):
    b = base(spark, sf_dir)
    own = b.select("id", F.posexplode("v").alias("pos", "x"))
    return own.join(V.column_means(b), "pos").select("id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x") - F.col("mean"), 6).alias("x"))


@query("truncate_dims", "SELECT id, len(v[1:16]) AS n, round(list_sum(v[1:16]), 6) AS s FROM b")
def truncate_dims(spark, sf_dir):
    return base(spark, sf_dir).withColumn("u", V.truncate(16)).select("id", F.size("u").cast("long").alias("n"), F.round(F.expr("aggregate(u, 0D, (a, x) -> a + x)"), 6).alias("s"))


@query("pad_dims", "SELECT id, 70::BIGINT AS n, round(list_sum(v), 6) AS s FROM b")
def pad_dims(spark, sf_dir):
    return base(spark, sf_dir).withColumn("u", V.pad(10)).select("id", F.size("u").cast("long").alias("n"), F.round(F.expr("aggregate(u, 0D, (a, x) -> a + x)"), 6).alias("s"))


@query("split_chunks", "SELECT id, m, round(list_sum(v[m * 8 + 1:m * 8 + 8]), 6) AS s FROM b, range(0, 8) t(m)")
def split_chunks(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.posexplode(V.chunks(8)).alias("m", "c")).select("id", F.col("m").cast("long").alias("m"), F.round(F.expr("aggregate(c, 0D, (a, x) -> a + x)"), 6).alias("s"))


@query("matrix_stats", "SELECT pos, count(*) AS n, sum(isnan(x)::INT)::BIGINT AS n_nan, sum(isinf(x)::INT)::BIGINT AS n_inf, sum((x = 0)::INT)::BIGINT AS n_zero, min(x) AS least, max(x) AS most, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation FROM (SELECT unnest(range(0, 64)) AS pos, unnest(v) AS x FROM b) GROUP BY pos")
def matrix_stats(spark, sf_dir):
    return V.matrix_stats(base(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query("duplicate_vectors", "SELECT min(id) AS id, count(*) AS n FROM (SELECT id, v FROM b UNION ALL SELECT id + 100000, v FROM b WHERE id % 9 = 0) GROUP BY v HAVING count(*) > 1")
def duplicate_vectors(spark, sf_dir):
    """Vectors that stand twice or more: the table with every ninth row once more under another id."""
    b = base(spark, sf_dir).select("id", "v")
    b = b.unionByName(b.where("id % 9 = 0").withColumn("id", F.col("id") + 100_000))
    return b.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "n")


@query("norm_histogram", "SELECT floor(round(sqrt(" + duck.total("x * y", "v", "v") + "), 4) * 10)::BIGINT AS bucket, count(*) AS n FROM b GROUP BY 1")
def norm_histogram(spark, sf_dir):
    return base(spark, sf_dir).groupBy(F.floor(F.round(V.norm(), 4) * 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_ROT = np.linalg.qr(np.random.default_rng(5).standard_normal((64, 64)))[0][:8].round(6)


def _mapped(m, v: str = "v", var: str = "r") -> str:
    return f"list_transform({duck.matrix(m)}, lambda {var}: {duck.total('x * y', var, v)})"


@query("random_rotation", f"SELECT id, j, round(x, 6) AS x FROM (SELECT id, unnest(range(0, 8)) AS j, unnest({_mapped(_ROT)}) AS x FROM b)")
def random_rotation(spark, sf_dir):
    return base(spark, sf_dir).select("id", F.posexplode(V.linear(_ROT)).alias("j", "x")).select("id", F.col("j").cast("long").alias("j"), F.round("x", 6).alias("x"))


# -- exact search

@query("knn_l2", duck.knn("l2"))
def knn_l2(spark, sf_dir):
    return S.knn(*both(spark, sf_dir), K, "l2")


@query("knn_ip", duck.knn("inner_product", desc=True))
def knn_ip(spark, sf_dir):
    return S.knn(*both(spark, sf_dir), K, "inner_product")


@query("knn_cosine", f"SELECT qid, rank, id, round(dist, 6) + 0.0 AS dist FROM ({duck.knn('cosine')})")
def knn_cosine(spark, sf_dir):
    return S.knn(*both(spark, sf_dir), K, "cosine").withColumn("dist", F.round("dist", 6) + 0.0)


@query("knn_l1", duck.knn("l1"))
def knn_l1(spark, sf_dir):
    return S.knn(*both(spark, sf_dir), K, "l1")


@query("knn_columns_l2", duck.knn("l2"))
def knn_columns_l2(spark, sf_dir):
    return S.knn_columns(*both(spark, sf_dir), K, "l2")


@query("range_l2", f"SELECT qid, id, dist FROM ({duck.pairs('l2')}) WHERE dist < 1.2")
def range_l2(spark, sf_dir):
    return S.range_search(*both(spark, sf_dir), 1.2)


@query("range_ip", f"SELECT qid, id, dist FROM ({duck.pairs('inner_product')}) WHERE dist > 0.3")
def range_ip(spark, sf_dir):
    return S.range_search(*both(spark, sf_dir), 0.3, "inner_product")


@query("range_max_results", f"SELECT qid, id, dist FROM ({duck.pairs('l2')}) WHERE dist < (SELECT max(dist) FROM (SELECT dist FROM ({duck.pairs('l2')}) ORDER BY dist LIMIT 201))")
def range_max_results(spark, sf_dir):
    b, q = both(spark, sf_dir)
    return S.range_at_most(S.all_pairs(b.select("id", "v"), q, "l2", least=201), 200)


@query("knn_graph", f"SELECT src, pos, dst, dist FROM (SELECT a.id AS src, b.id AS dst, {duck.measure('l2', 'a.v', 'b.v')} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {duck.measure('l2', 'a.v', 'b.v')}, b.id) AS pos FROM b a, b WHERE a.id <> b.id) WHERE pos <= 5")
def knn_graph(spark, sf_dir):
    return X.knn_graph(base(spark, sf_dir), 5).withColumn("pos", F.col("pos").cast("long"))


@query("knn_1d", "SELECT qid, rank, id, dist FROM (SELECT qid, id, abs(q[1] - v[1]) AS dist, row_number() OVER (PARTITION BY qid ORDER BY abs(q[1] - v[1]), id) AS rank FROM q, b) WHERE rank <= 5")
def knn_1d(spark, sf_dir):
    return S.knn_columns(*both(spark, sf_dir), 5, F.expr("abs(q[0] - v[0])"))


@query("assign_nearest", f"SELECT qid, id FROM ({duck.knn('l2', 2)}) WHERE rank = 2")
def assign_nearest(spark, sf_dir):
    return S.knn(*both(spark, sf_dir), 2).where("rank = 2").select("qid", "id")


# -- filtered search

def _filtered(name: str, spark_condition: str, duck_condition: str | None = None) -> None:
    @query(name, duck.knn("l2", where=duck_condition or spark_condition))
    def run(spark, sf_dir):
        b, q = both(spark, sf_dir)
        return S.knn(b.where(spark_condition), q, K)


_filtered("knn_id_range", "id >= 100 AND id < 300")
_filtered("knn_id_not", "NOT (id >= 100 AND id < 300)")
_filtered("knn_label", "label = 4")
_filtered("knn_bitmap", "getbit(715827882, CAST(id % 30 AS INT)) = 1", "(715827882 >> (id % 30)) & 1 = 1")


@query("knn_id_set", duck.knn("l2", where="id IN (SELECT p_partkey * 3 FROM part)"))
def knn_id_set(spark, sf_dir):
    b, q = both(spark, sf_dir)
    wanted = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") * 3).cast("long").alias("id"))
    return S.knn(b.join(wanted, "id", "left_semi"), q, K)


@query("knn_epsilon", f"SELECT * FROM ({duck.knn('l2')}) WHERE dist <= 1.1")
def knn_epsilon(spark, sf_dir):
    return S.knn(*both(spark, sf_dir), K).where("dist <= 1.1D")


_CROWD = f"SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY dist, id) AS own FROM ({duck.pairs('l2')})"


@query("knn_crowding", f"SELECT qid, rank, id, dist, label FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM ({_CROWD}) WHERE own <= 2) WHERE rank <= {K}")
def knn_crowding(spark, sf_dir):
    return S.crowded(S.all_pairs(*both(spark, sf_dir), "l2"), "label", 2, K)


# -- approximate search with given or trained models; texts hold the models only where they are literals

_PLANES = X.hyperplanes(24, 64, 3)


def _code(v: str, var: str) -> str:
    return f"list_transform({_mapped(_PLANES, v, var)}, lambda z: CASE WHEN z >= 0 THEN 1 ELSE 0 END)"


@query("lsh_sign", f", cb AS (SELECT id, {_code('v', 'r')} AS c FROM b), cq AS (SELECT qid, {_code('q', 'r')} AS c FROM q) SELECT qid, rank, id, dist FROM (SELECT qid, id, {duck.total('CASE WHEN x <> y THEN 1 ELSE 0 END', 'cq.c', 'cb.c')} AS dist, row_number() OVER (PARTITION BY qid ORDER BY {duck.total('CASE WHEN x <> y THEN 1 ELSE 0 END', 'cq.c', 'cb.c')}, id) AS rank FROM cq, cb) WHERE rank <= {K}")
def lsh_sign(spark, sf_dir):
    return X.sign_search(*both(spark, sf_dir), _PLANES, K)


#: Centroids that SQL can name: the rows with the 16 least ids.
_FIRST = "c AS (SELECT id AS list_no, v AS c FROM b WHERE id < 16)"


def first_centroids(spark, sf_dir, n: int = 16) -> np.ndarray:
    return X.first_rows(base(spark, sf_dir), n)


def _nearest(side: str, key: str, vec: str, n: int) -> str:
    return f"SELECT * FROM (SELECT {side}.*, list_no, {duck.measure('l2_sq', 'c.c', f'{side}.{vec}')} AS list_dist, row_number() OVER (PARTITION BY {key} ORDER BY {duck.measure('l2_sq', 'c.c', f'{side}.{vec}')}, list_no) AS r FROM {side}, c) WHERE r <= {n}"


_IVF = f"WITH {duck.BASE}, {_FIRST}, lists AS ({_nearest('b', 'id', 'v', 1)}), probes AS ({_nearest('q', 'qid', 'q', 4)}), hit AS (SELECT qid, id, {duck.measure('l2', 'probes.q', 'lists.v')} AS dist FROM probes JOIN lists USING (list_no)) SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM hit) WHERE rank <= {K}"


@query("ivf_flat", _IVF)
def ivf_flat(spark, sf_dir):
    b, q = both(spark, sf_dir)
    c = first_centroids(spark, sf_dir)
    return X.ivf_search(X.assign(b, c).select("id", "v", "list_no"), q, c, K, 4)


@query("kmeans_assign", f"WITH {duck.BASE}, {_FIRST} SELECT id, list_no, round(list_dist, 6) AS list_dist FROM ({_nearest('b', 'id', 'v', 1)})")
def kmeans_assign(spark, sf_dir):
    return X.assign(base(spark, sf_dir), first_centroids(spark, sf_dir)).select("id", F.col("list_no").cast("long").alias("list_no"), F.round("list_dist", 6).alias("list_dist"))


@query("kmeans_step", f"WITH {duck.BASE}, {_FIRST} SELECT list_no, pos, n, round(x, 6) AS x FROM (SELECT list_no, pos, count(*) AS n, avg(x) AS x FROM (SELECT list_no, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM ({_nearest('b', 'id', 'v', 1)})) GROUP BY 1, 2)")
def kmeans_step(spark, sf_dir):
    step = X.kmeans_step(base(spark, sf_dir), first_centroids(spark, sf_dir))
    return step.select(F.col("list_no").cast("long").alias("list_no"), "n", F.posexplode("c").alias("pos", "x")).select("list_no", F.col("pos").cast("long").alias("pos"), "n", F.round("x", 6).alias("x"))


@query("imbalance_factor", f"WITH {duck.BASE}, {_FIRST} SELECT round(count(*) * sum(n * n) / power(sum(n), 2), 6) AS imbalance FROM (SELECT count(*)::DOUBLE AS n FROM ({_nearest('b', 'id', 'v', 1)}) GROUP BY list_no)")
def imbalance_factor(spark, sf_dir):
    return E.imbalance_factor(X.assign(base(spark, sf_dir), first_centroids(spark, sf_dir)).groupBy("list_no").agg(F.count(F.lit(1)).alias("n")))


def _books(spark, sf_dir, m: int = 8, ksub: int = 16) -> np.ndarray:
    x = first_centroids(spark, sf_dir, ksub)
    d = x.shape[1] // m
    return np.stack([x[:, j * d : (j + 1) * d] for j in range(m)])


_PIECES = "m AS (SELECT unnest(range(0, 8)) AS j), book AS (SELECT j, id AS k, v[j * 8 + 1:j * 8 + 8] AS c FROM b, m WHERE id < 16)"
_PQCODE = f"code AS (SELECT id, j, k FROM (SELECT b.id, book.j, k, row_number() OVER (PARTITION BY b.id, book.j ORDER BY {duck.measure('l2_sq', 'c', 'b.v[book.j * 8 + 1:book.j * 8 + 8]')}, k) AS r FROM b, book) WHERE r = 1)"


@query("pq_adc", f"WITH {duck.BASE}, {_PIECES}, {_PQCODE}, lut AS (SELECT qid, j, k, {duck.measure('l2_sq', 'q[j * 8 + 1:j * 8 + 8]', 'c')} AS d FROM q, book), s AS (SELECT qid, id, round(sum(d), 6) AS dist FROM code JOIN lut USING (j, k) GROUP BY qid, id) SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM s) WHERE rank <= {K}")
def pq_adc(spark, sf_dir):
    b, q = both(spark, sf_dir)
    books = _books(spark, sf_dir)
    codes, tables = X.pq_encode(b, books).select("id", "code"), X.pq_tables(q, books).select("qid", "lut")
    return S.top_k(codes.join(F.broadcast(tables)).select("qid", "id", F.round(X.adc(), 6).alias("dist")), K)


@query("pq_codes", f"WITH {duck.BASE}, {_PIECES}, {_PQCODE} SELECT id, j, k FROM code")
def pq_codes(spark, sf_dir):
    return X.pq_encode(base(spark, sf_dir), _books(spark, sf_dir)).select("id", F.posexplode("code").alias("j", "k")).select("id", F.col("j").cast("long").alias("j"), F.col("k").cast("long").alias("k"))


def _bounds(b: DataFrame) -> tuple[list, list]:
    rows = b.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("pos").collect()  # one row for each dimension
    return [r.lo for r in rows], [r.hi for r in rows]


def _sq(bits: int) -> None:
    top = (1 << bits) - 1
    sql = f"WITH {duck.BASE}, x AS (SELECT id, unnest(range(0, 64)) AS pos, unnest(v) AS x FROM b), g AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM x GROUP BY pos) SELECT id, pos, least({top}, greatest(0, floor(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END * {top} + 0.5)))::INT AS code FROM x JOIN g USING (pos)"

    @query(f"sq{bits}", sql)
    def run(spark, sf_dir):
        b = base(spark, sf_dir)
        return X.scalar_quantize(b, *_bounds(b), bits).select("id", F.posexplode("code").alias("pos", "code")).withColumn("pos", F.col("pos").cast("long"))


_sq(8)
_sq(4)


@query("rowwise_minmax", "SELECT id, round(lo, 6) AS lo, round(hi, 6) AS hi, list_transform(v, lambda z: floor((z - lo) / (hi - lo) * 255 + 0.5)::INT)[1] AS first FROM (SELECT id, v, list_min(v) AS lo, list_max(v) AS hi FROM b)")
def rowwise_minmax(spark, sf_dir):
    b = base(spark, sf_dir).withColumns({"lo": F.array_min("v"), "hi": F.array_max("v")})
    return b.select("id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.expr("CAST(floor((v[0] - lo) / (hi - lo) * 255 + 0.5D) AS INT)").alias("first"))


@query("refine_k_factor", f"WITH {duck.BASE}, small AS (SELECT qid, id, {duck.measure('l2', 'q[1:16]', 'v[1:16]')} AS d FROM q, b), cand AS (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS r FROM small) WHERE r <= 30), hit AS (SELECT qid, id, {duck.measure('l2')} AS dist FROM cand JOIN q USING (qid) JOIN b USING (id)) SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM hit) WHERE rank <= {K}")
def refine_k_factor(spark, sf_dir):
    b, q = both(spark, sf_dir)
    cand = S.top_k(S.all_pairs(b.withColumn("v", V.truncate(16)), q.withColumn("q", V.truncate(16, "q")), "l2"), 30)
    return S.refine(cand, b, q, K)


def _ranked(source: str, k: int = K) -> str:
    return f"SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM ({source})) WHERE rank <= {k}"


def _projected(m) -> str:
    return f"pb AS (SELECT id, v, {_mapped(m, 'v')} AS x FROM b), pq AS (SELECT qid, q, {_mapped(m, 'q')} AS y FROM q)"


_BAND = X.hyperplanes(12, 64, 9)
_BOXES = [X.hyperplanes(3, 64, s) for s in (1, 2, 3, 4)]
_LOW = X.hyperplanes(15, 64, 12) / 8
_APART = "CASE WHEN x <> y THEN 1 ELSE 0 END"
_CODES = f"cb AS (SELECT id, {_code('v', 'r')} AS c FROM b), cq AS (SELECT qid, {_code('q', 'r')} AS d FROM q)"


@query("collision_band", f"WITH {duck.BASE}, {_projected(_BAND)} {_ranked('SELECT qid, id, ' + duck.measure('l2') + ' AS dist FROM pq, pb WHERE ' + duck.total('CASE WHEN abs(x - y) <= 0.5 THEN 1 ELSE 0 END', 'pq.y', 'pb.x') + ' >= 6')}")
def collision_band(spark, sf_dir):
    return X.collision_search(*both(spark, sf_dir), _BAND, K, 1.0, 6)


@query("box_hash", f"WITH {duck.BASE}, {_projected(np.concatenate(_BOXES))} {_ranked('SELECT qid, id, ' + duck.measure('l2') + ' AS dist FROM pq, pb WHERE ' + ' OR '.join(duck.measure('linf', f'pq.y[{3 * t + 1}:{3 * t + 3}]', f'pb.x[{3 * t + 1}:{3 * t + 3}]') + ' <= 0.7' for t in range(4)))}")
def box_hash(spark, sf_dir):
    return P.box_search(*both(spark, sf_dir), _BOXES, K, 0.7)


@query("projected_verify", f"WITH {duck.BASE}, {_projected(_LOW)}, near AS (SELECT pq.qid, pb.id, q, v, row_number() OVER (PARTITION BY qid ORDER BY {duck.measure('l2', 'pq.y', 'pb.x')}, id) AS r FROM pq, pb) {_ranked('SELECT qid, id, ' + duck.measure('l2') + ' AS dist FROM near WHERE r <= 60')}")
def projected_verify(spark, sf_dir):
    return P.projected_candidates(*both(spark, sf_dir), _LOW, K, 60, saver(spark))


def _flips(tables: int, flips: int) -> str:
    inside = " OR ".join(f"{duck.total(_APART, f'cq.d[{8 * t + 1}:{8 * t + 8}]', f'cb.c[{8 * t + 1}:{8 * t + 8}]')} <= {flips}" for t in range(tables))
    return f"WITH {duck.BASE}, {_CODES} {_ranked('SELECT qid, id, ' + duck.total(_APART, 'cq.d', 'cb.c') + ' AS dist FROM cq, cb WHERE ' + inside)}"


@query("binary_hash_flip", _flips(1, 2))
def binary_hash_flip(spark, sf_dir):
    return X.binary_hash_search(*both(spark, sf_dir), _PLANES, K, 8, 1, 2)


@query("binary_multihash", _flips(3, 1))
def binary_multihash(spark, sf_dir):
    return X.binary_hash_search(*both(spark, sf_dir), _PLANES, K, 8, 3, 1)


@query("ivf_trained")
def ivf_trained(spark, sf_dir):
    b, q = both(spark, sf_dir)
    c = X.lloyd(X.training_rows(b, 4096), 16, 10)
    return X.ivf_search(X.assign(b, c).select("id", "v", "list_no"), q, c, K, 4)


@query("soar_spill")
def soar_spill(spark, sf_dir):
    b, q = both(spark, sf_dir)
    c = first_centroids(spark, sf_dir)
    return X.ivf_search(X.soar_spilled(b, c), q, c, K, 4)


_QCODE = f"qcode AS (SELECT qid, j, k AS qk, c AS qc FROM (SELECT qid, book.j, k, c, row_number() OVER (PARTITION BY qid, book.j ORDER BY {duck.measure('l2_sq', 'c', 'q[book.j * 8 + 1:book.j * 8 + 8]')}, k) AS r FROM q, book) WHERE r = 1)"


@query("pq_symmetric", f"WITH {duck.BASE}, {_PIECES}, {_PQCODE}, {_QCODE} {_ranked('SELECT qid, id, round(sum(' + duck.measure('l2_sq', 'qc', 'book.c') + '), 6) AS dist FROM qcode JOIN code USING (j) JOIN book USING (j, k) GROUP BY qid, id')}")
def pq_symmetric(spark, sf_dir):
    b, q = both(spark, sf_dir)
    books = _books(spark, sf_dir)
    codes = X.pq_encode(b, books).select("id", "code")
    tables = X.pq_tables(X.pq_encode(q, books, "q").withColumn("q", X.pq_decode(books)), books).select("qid", "lut")
    return S.top_k(codes.join(F.broadcast(tables)).select("qid", "id", F.round(X.adc(), 6).alias("dist")), K)


@query("polysemous", f"WITH {duck.BASE}, {_PIECES}, {_PQCODE}, {_QCODE} {_ranked('SELECT qid, id, round(sum(' + duck.measure('l2_sq', 'q.q[j * 8 + 1:j * 8 + 8]', 'book.c') + '), 6) AS dist FROM qcode JOIN code USING (j) JOIN book USING (j, k) JOIN q USING (qid) GROUP BY qid, id HAVING sum((qk <> k)::INT) <= 6')}")
def polysemous(spark, sf_dir):
    b, q = both(spark, sf_dir)
    books = _books(spark, sf_dir)
    found = X.polysemous(X.pq_encode(b, books), q, books, 1 << 30, 6)
    return S.top_k(found.select("qid", "id", F.round("dist", 6).alias("dist")), K)


@query("rq_greedy")
def rq_greedy(spark, sf_dir):
    b = base(spark, sf_dir)
    x, stages = X.training_rows(b, 4096), []
    for _ in range(3):
        c = X.lloyd(x, 16, 5)
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        x = x - c[own]
        stages.append(c)
    return X.residual_encode(b, stages).select("id", F.round(F.expr("sqrt(aggregate(rest, 0D, (a, x) -> a + x * x))"), 6).alias("error"), F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


@query("variance_aware_pq")
def variance_aware_pq(spark, sf_dir):
    b, q = both(spark, sf_dir)
    mean, axes, books = X.variance_aware(X.training_rows(b, 4096), 8, 32, 1, 6)
    turned = lambda c: V.linear(axes.T, c, -(mean @ axes))
    codes = R.encode_blocks(b.withColumn("v", turned("v")), books)
    found = R.block_search(codes, q.withColumn("q", turned("q")), books, 4 * K)
    return S.refine(found, b, q, K)


@query("forest_search")
def forest_search(spark, sf_dir):
    b, q = both(spark, sf_dir)
    return X.forest_search(b, q, X.forest(X.training_rows(b, 4096), 8, 32, 4), K)


@query("nn_descent")
def nn_descent(spark, sf_dir):
    return X.nn_descent(base(spark, sf_dir), 8, 4, saver(spark)).select("src", F.col("pos").cast("long").alias("pos"), "dst", "dist")


@query("graph_prune")
def graph_prune(spark, sf_dir):
    b = base(spark, sf_dir)
    return X.occlusion_prune(X.knn_graph(b, 16), b, 8)


@query("graph_search")
def graph_search(spark, sf_dir):
    b, q = both(spark, sf_dir)
    save = saver(spark)
    graph = save(X.occlusion_prune(X.knn_graph(b, 16), b, 8))
    graph = save(graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    return X.graph_search(graph, b, q, K, 32, 12, save=save)


def saver(spark):
    """Cuts lineage with a table in the shared folder that the session names."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", folder)

    def save(df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/lodestar/step-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


# -- merging: A sees the first half of the coordinates, B the second

def _half(name: str, a: int, b: int) -> str:
    return f"{name} AS (SELECT qid, id, dist, rank FROM (SELECT qid, id, {duck.measure('l2', f'q[{a}:{b}]', f'v[{a}:{b}]')} AS dist, row_number() OVER (PARTITION BY qid ORDER BY {duck.measure('l2', f'q[{a}:{b}]', f'v[{a}:{b}]')}, id) AS rank FROM q, b) WHERE rank <= {K})"


_LISTS = f"WITH {duck.BASE}, {_half('la', 1, 32)}, {_half('lb', 33, 64)}, u AS (SELECT *, 0 AS s FROM la UNION ALL SELECT *, 1 AS s FROM lb), w AS (SELECT qid, id, count(DISTINCT s) AS votes, min(rank) AS best, sum(rank) AS ranks, min(dist) AS dist FROM u GROUP BY qid, id)"
_FULL = f"truth AS ({duck.knn('l2')})"


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    b, q = both(spark, sf_dir)
    part = lambda a: S.knn(b.withColumn("v", F.slice("v", a, 32)), q.withColumn("q", F.slice("q", a, 32)), K)
    return b, q, part(1), part(33)


def _voted(order: str) -> str:
    return f"{_LISTS} SELECT qid, rank, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, id) AS rank FROM w) WHERE rank <= {K}"


@query("pair_union", f"{_LISTS} SELECT qid, id FROM w")
def pair_union(spark, sf_dir):
    _, _, x, y = halves(spark, sf_dir)
    return M.pair_union(x, y)


@query("pair_rerank", f"{_LISTS}, hit AS (SELECT qid, id, {duck.measure('l2')} AS dist FROM (SELECT qid, id FROM w) JOIN q USING (qid) JOIN b USING (id)) SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM hit) WHERE rank <= {K}")
def pair_rerank(spark, sf_dir):
    b, q, x, y = halves(spark, sf_dir)
    return M.pair_rerank(b, q, K, x, y)


@query("pair_vote", _voted("(votes = 2) DESC, votes DESC, best"))
def pair_vote(spark, sf_dir):
    _, _, x, y = halves(spark, sf_dir)
    return M.pair_vote(K, x, y)


@query("pair_ranksum", _voted("(votes = 2) DESC, ranks"))
def pair_ranksum(spark, sf_dir):
    _, _, x, y = halves(spark, sf_dir)
    return M.pair_ranksum(K, x, y)


@query("pair_common_dist", _voted("(votes = 2) DESC, dist"))
def pair_common_dist(spark, sf_dir):
    _, _, x, y = halves(spark, sf_dir)
    return M.pair_common_then_dist(K, x, y)


@query("shard_merge", duck.knn("l2"))
def shard_merge(spark, sf_dir):
    b, q = both(spark, sf_dir)
    low, high = b.where("id < 250"), b.where("id >= 250").withColumn("id", F.col("id") - 250)
    return M.shard_merge(K, (S.knn(low, q, K), 0), (S.knn(high, q, K), 250))


@query("id_map", f"SELECT qid, rank, 'doc-' || id AS id, dist FROM ({duck.knn('l2')})")
def id_map(spark, sf_dir):
    b, q = both(spark, sf_dir)
    return M.map_ids(S.knn(b, q, K), b.select("id", F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("external"))).select("qid", "rank", "id", "dist")


# -- evaluation: the list of the first half against the truth

def judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b, q, x, _ = halves(spark, sf_dir)
    return x, S.knn(b, q, K)


def _eval(name: str, select: str, f) -> None:
    query(name, f"{_LISTS}, {_FULL} {select}")(lambda spark, sf_dir: f(*judged(spark, sf_dir)))


_NQ = "(SELECT count(DISTINCT qid) FROM truth)"
_eval("recall_at_k", f"SELECT {K}::BIGINT AS k, round(count(*) / ({_NQ} * {K}), 6) AS recall FROM la JOIN truth USING (qid, id)", lambda r, t: E.recall_at_k(r, t, K))
_eval("recall_multi_k", f"SELECT k, round(count(*) / ({_NQ} * k), 6) AS recall FROM la JOIN truth USING (qid, id), (VALUES (1::BIGINT), (5), (10)) x(k) WHERE la.rank <= k AND truth.rank <= k GROUP BY k", lambda r, t: E.recall_many(r, t, [1, 5, 10]))
_eval("one_recall_at_r", f"SELECT r, round(count(*) / {_NQ}, 6) AS one_recall FROM la JOIN truth ON la.qid = truth.qid AND la.id = truth.id AND truth.rank = 1, (VALUES (1::BIGINT), (10)) x(r) WHERE la.rank <= r GROUP BY r", lambda r, t: E.one_recall_at_r(r, t, [1, 10]))
_eval("recall_by_dist", f"SELECT round(count(*) / ({_NQ} * {K}), 6) AS recall FROM la JOIN (SELECT qid, max(dist) AS reach FROM truth GROUP BY qid) USING (qid) WHERE la.dist <= reach", lambda r, t: E.recall_by_distance(r, t, K))
_eval("map_truncated", f", h AS (SELECT la.qid, la.rank AS r, greatest(la.rank, truth.rank) AS m FROM la JOIN truth USING (qid, id)) SELECT round(coalesce(sum(n / r) / {K}, 0) / {_NQ}, 6) AS map FROM (SELECT x.qid, x.r, count(*) AS n FROM h x JOIN h y ON x.qid = y.qid AND y.m <= x.r GROUP BY 1, 2)", lambda r, t: E.map_truncated(r, t, K))
_eval("approx_ratio", "SELECT round(avg(r), 6) AS ratio FROM (SELECT qid, avg((la.dist + 1e-12) / (truth.dist + 1e-12)) AS r FROM la JOIN truth USING (qid, rank) WHERE rank > 1 GROUP BY qid)", lambda r, t: E.approx_ratio(r.where("rank > 1"), t))
_eval("overall_ratio_mean", "SELECT round(avg(r), 6) AS ratio FROM (SELECT qid, avg(CASE WHEN truth.dist = 0 THEN 1 ELSE la.dist / truth.dist END) AS r FROM la JOIN truth USING (qid, rank) GROUP BY qid)", lambda r, t: E.approx_ratio(r, t, True))
_eval("overall_ratio_total", "SELECT round(avg(CASE WHEN truth.dist = 0 THEN 1 ELSE la.dist / truth.dist END), 6) AS ratio FROM la JOIN truth USING (qid, rank)", lambda r, t: E.overall_ratio_total(r, t))
ORACLES["map_truncated"] = ORACLES["map_truncated"].replace(") , h AS", "), h AS")


@query("refine_multiplier", f"{_LISTS} SELECT round(count(*) / (count(DISTINCT qid) * {K}), 6) AS multiplier FROM w")
def refine_multiplier(spark, sf_dir):
    _, _, x, y = halves(spark, sf_dir)
    return E.refine_multiplier(M.pair_union(x, y), K)


_RANGES = f"WITH {duck.BASE}, t AS (SELECT qid, id FROM ({duck.pairs('l2')}) WHERE dist < 1.2), f AS (SELECT qid, id FROM (SELECT qid, id, {duck.measure('l2', 'q[1:32]', 'v[1:32]')} AS dist FROM q, b) WHERE dist < 0.8), c AS (SELECT qid, (SELECT count(*) FROM f WHERE f.qid = q.qid) AS nf, (SELECT count(*) FROM t WHERE t.qid = q.qid) AS nt, (SELECT count(*) FROM f JOIN t USING (qid, id) WHERE f.qid = q.qid) AS nb FROM q)"


def ranges(spark, sf_dir):
    b, q = both(spark, sf_dir)
    found = S.range_search(b.withColumn("v", F.slice("v", 1, 32)), q.withColumn("q", F.slice("q", 1, 32)), 0.8)
    return found, S.range_search(b, q, 1.2), q


@query("range_pr_overall", f"{_RANGES} SELECT round(sum(nb) / sum(nf), 6) AS precision, round(sum(nb) / sum(nt), 6) AS recall FROM c")
def range_pr_overall(spark, sf_dir):
    return E.range_pr_overall(*ranges(spark, sf_dir))


@query("range_pr_average", f"{_RANGES} SELECT round(avg(CASE WHEN nf = 0 THEN 1 ELSE nb / nf END), 6) AS precision, round(avg(CASE WHEN nt = 0 THEN CASE WHEN nf = 0 THEN 1 ELSE 0 END ELSE nb / nt END), 6) AS recall FROM c")
def range_pr_average(spark, sf_dir):
    return E.range_pr_average(*ranges(spark, sf_dir))


@query("latency_percentiles", "SELECT round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice::DOUBLE, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice::DOUBLE, 0.99), 6) AS p99, round(quantile_cont(l_extendedprice::DOUBLE, 0.999), 6) AS p99_9 FROM lineitem")
def latency_percentiles(spark, sf_dir):
    return E.latency_percentiles(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("x")), "x")


_POINTS = "pts AS (SELECT (p_partkey * 37 % 500) / 500.0::DOUBLE AS perf, 1 + (p_partkey * 53 % 900) / 10.0::DOUBLE AS t, p_partkey AS key FROM part)"


def points(spark, sf_dir):
    p = F.col("p_partkey")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select((p * 37 % 500 / F.lit(500.0)).alias("perf"), (1 + p * 53 % 900 / F.lit(10.0)).alias("t"), p.alias("key"))


@query("pareto_front", f"WITH {_POINTS}, best AS (SELECT perf, t, key FROM (SELECT *, row_number() OVER (PARTITION BY perf ORDER BY t, key) AS r FROM pts WHERE perf > 0) WHERE r = 1) SELECT perf, t, key FROM (SELECT *, min(t) OVER (ORDER BY perf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best) WHERE before IS NULL OR t < before")
def pareto_front(spark, sf_dir):
    return E.pareto_front(points(spark, sf_dir))


@query("time_for_perf", f"WITH {_POINTS} SELECT target, coalesce(min(t), 1e50) AS t FROM (VALUES (0.25::DOUBLE), (0.9), (2.0)) x(target) LEFT JOIN pts ON perf >= target GROUP BY target")
def time_for_perf(spark, sf_dir):
    return E.time_for_perf(points(spark, sf_dir), [0.25, 0.9, 2.0])
