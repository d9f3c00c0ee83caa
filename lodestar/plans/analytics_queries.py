"""Registered queries of configuration analytics, over a results table derived from `part`, with their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.numbers import rounded
from lodestar.plans import analytics as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_COMBO = "CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'A + B' WHEN 4 THEN 'A + C' ELSE 'B + C' END"
_RUNS = f"""SELECT 'ds' || (p_partkey % 7) || CASE p_partkey % 7 WHEN 1 THEN '_500k' WHEN 2 THEN '_10k' ELSE '' END AS dataset, {_COMBO} AS combo,
  CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 0.5 + (p_partkey * 37 % 500) / 1000.0 END AS recall,
  CASE WHEN p_partkey % 43 = 0 THEN 0.0 ELSE 100.0 + (p_partkey * 91 % 5000) END AS qps,
  1 + (p_partkey * 53 % 900) / 10.0 AS construction_time, 10.0 + p_partkey * 29 % 700 AS memory, p_partkey AS id FROM part"""


def typed(sql: str) -> str:
    """The results table with doubles; the text is the same in both dialects."""
    cast = "DOUBLE"
    return f"SELECT dataset, combo, round(CAST(recall AS {cast}), 6) AS recall, CAST(qps AS {cast}) AS qps, CAST(construction_time AS {cast}) AS construction_time, CAST(memory AS {cast}) AS memory, CAST(id AS BIGINT) AS id FROM ({sql})"


RUNS = f"runs AS ({typed(_RUNS)})"
VALID = "ok AS (SELECT * FROM runs WHERE recall IS NOT NULL AND qps > 0 AND construction_time > 0)"
_Q = "quantile_cont({c}, {p})"
PROFILES = "profiles AS (" + " UNION ALL ".join(f"SELECT dataset, {k} AS profile, quantile_cont(1 / qps, {p}::DOUBLE) AS tq, quantile_cont(construction_time, {p}::DOUBLE) AS tc, quantile_cont(memory, {p}::DOUBLE) AS tm FROM ok GROUP BY dataset" for k, p in A.PROFILES) + ")"
FITS = "qps >= 1.0 / tq AND construction_time <= tc"
BEST = "best AS (SELECT dataset, profile, combo, coalesce(max(CASE WHEN {fits} THEN recall END), 0.0) AS best_recall, bool_or({fits}) AS feasible FROM ok JOIN profiles USING (dataset) GROUP BY 1, 2, 3)"
PROPS = "props AS (SELECT dataset, 1.0 + (row_number() OVER (ORDER BY dataset) * 37 % 11) / 10.0::DOUBLE AS rc, CASE WHEN row_number() OVER (ORDER BY dataset) % 2 = 0 THEN 'OOD' ELSE 'ID' END AS distribution, 128 * (row_number() OVER (ORDER BY dataset)) AS dim FROM (SELECT DISTINCT dataset FROM runs))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    return spark.sql(typed(_RUNS.replace("FROM part", "FROM {part}")), part=part)


def properties(table: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.orderBy("dataset"))
    return table.select("dataset").distinct().select("dataset", (1.0 + n * 37 % 11 / F.lit(10.0)).alias("rc"), F.when(n % 2 == 0, "OOD").otherwise("ID").alias("distribution"), (128 * n).alias("dim"))


def query(name: str, body: str, fits: str = FITS):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = f"WITH {RUNS}, {VALID}, {PROFILES}, {BEST.format(fits=fits)}, {PROPS} {body}"
        return f

    return add


def best(spark, sf_dir, **how) -> DataFrame:
    r = runs(spark, sf_dir)
    return A.best_recall(r, A.budget_profiles(r), **how)


@query("valid_runs", "SELECT dataset, count(*) AS n FROM ok GROUP BY dataset")
def valid_runs(spark, sf_dir):
    return A.valid(runs(spark, sf_dir)).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("budget_profiles", "SELECT dataset, profile, round(tq, 9) AS tq, round(tc, 6) AS tc, round(tm, 6) AS tm FROM profiles")
def budget_profiles(spark, sf_dir):
    return A.budget_profiles(runs(spark, sf_dir)).select("dataset", "profile", F.round("tq", 9).alias("tq"), F.round("tc", 6).alias("tc"), F.round("tm", 6).alias("tm"))


@query("profile_fallback", "SELECT d.dataset, p.profile, round(coalesce(o.tq, 0.01), 9) AS tq, round(coalesce(o.tc, 50), 6) AS tc, round(coalesce(o.tm, 300), 6) AS tm FROM (SELECT DISTINCT dataset FROM runs UNION SELECT 'empty') d CROSS JOIN (VALUES (1), (2), (3)) p(profile) LEFT JOIN profiles o ON o.dataset = d.dataset AND o.profile = p.profile")
def profile_fallback(spark, sf_dir):
    r = runs(spark, sf_dir)
    r = r.unionByName(spark.createDataFrame([("empty", "A", None, 1.0, 1.0, 1.0, -1)], r.schema))
    f = r.select("dataset").distinct().crossJoin(spark.createDataFrame([(k, 0.01, 50.0, 300.0) for k in (1, 2, 3)], "profile int, tq double, tc double, tm double"))
    return A.budget_profiles(r, f).select("dataset", "profile", F.round("tq", 9).alias("tq"), F.round("tc", 6).alias("tc"), F.round("tm", 6).alias("tm"))


@query("best_recall_under_budget", "SELECT * FROM best")
def best_recall_under_budget(spark, sf_dir):
    return best(spark, sf_dir)


@query("best_recall_with_memory", "SELECT * FROM best", FITS + " AND memory <= tm")
def best_recall_with_memory(spark, sf_dir):
    return best(spark, sf_dir, memory=True)


@query("no_constraint_best", "SELECT * FROM best", "TRUE")
def no_constraint_best(spark, sf_dir):
    return best(spark, sf_dir, constrained=False)


_CATEGORIES = "categories AS (SELECT CASE profile WHEN 1 THEN 'tight' ELSE 'relaxed' END AS level, dataset, max(CASE WHEN combo NOT LIKE '%+%' THEN best_recall END) AS standalone, max(CASE WHEN combo LIKE '%+%' THEN best_recall END) AS pairing FROM best WHERE profile <> 2 GROUP BY 1, 2)"


@query("best_by_category", f", {_CATEGORIES} SELECT * FROM categories")
def best_by_category(spark, sf_dir):
    return A.by_category(best(spark, sf_dir))


def _wins(skip: str) -> str:
    return f", {_CATEGORIES}, z AS (SELECT level, coalesce(standalone, -1) AS s, coalesce(pairing, -1) AS p FROM categories) SELECT level, round(avg(CASE WHEN s >= 0 THEN s END), 6) AS standalone_avg, round(avg(CASE WHEN p >= 0 THEN p END), 6) AS pairing_avg, sum((NOT ({skip}) AND s > p)::INT)::BIGINT AS standalone_wins, sum((NOT ({skip}) AND p > s)::INT)::BIGINT AS pairing_wins FROM z GROUP BY level"


@query("summary_wins_and", _wins("s < 0 AND p < 0"))
def summary_wins_and(spark, sf_dir):
    return A.wins(A.by_category(best(spark, sf_dir)))


@query("summary_wins_or", _wins("s < 0 OR p < 0"))
def summary_wins_or(spark, sf_dir):
    return A.wins(A.by_category(best(spark, sf_dir)), skip_any=True)


def _cohort(name: str, label: str, f) -> None:
    @query(name, f"SELECT {label} AS cohort, profile, combo, round(avg(best_recall), 6) AS avg_best, count(*) AS n FROM best JOIN props USING (dataset) GROUP BY 1, 2, 3")
    def run(spark, sf_dir):
        p = properties(runs(spark, sf_dir))
        return A.cohort(best(spark, sf_dir), p, f(p))


_cohort("cohort_hardness", "CASE WHEN rc <= (SELECT quantile_cont(rc, 0.5) FROM props) THEN 'hard' ELSE 'easy' END", A.hardness)
_cohort("cohort_ood", "distribution", lambda p: F.col("distribution"))
_cohort("cohort_dim", "CASE WHEN dim >= 512 THEN 'high' ELSE 'low' END", lambda p: F.when(F.col("dim") >= 512, "high").otherwise("low"))
_cohort("cohort_scale", "CASE WHEN contains(dataset, '500k') THEN '500k' WHEN contains(dataset, '10k') THEN '10k' ELSE '1M' END", lambda p: A.scale_of())


@query("banned_models", "SELECT combo, count(*) AS n FROM runs WHERE NOT list_contains(string_split(combo, ' + '), 'B') GROUP BY combo")
def banned_models(spark, sf_dir):
    return A.without_models(runs(spark, sf_dir), ["B"]).groupBy("combo").agg(F.count(F.lit(1)).alias("n"))


_SIDE = "SELECT dataset, combo AS model, recall, qps / 100 AS search_time, construction_time, CASE WHEN id % 5 = 0 THEN NULL ELSE memory END AS memory FROM ok WHERE combo = '{m}'"


def side(table: DataFrame, model: str) -> DataFrame:
    """All valid runs of a model."""
    return A.valid(table).where(F.col("combo") == model).select("dataset", F.col("combo").alias("model"), "recall", (F.col("qps") / 100).alias("search_time"), "construction_time", F.when(F.col("id") % 5 != 0, F.col("memory")).alias("memory"))


_PAIRS = f"a AS ({_SIDE.format(m='A')}), b AS ({_SIDE.format(m='B')})"


@query("config_pairs", f", {_PAIRS} SELECT a.dataset, a.model || ' + ' || b.model AS combo, a.recall AS a_recall, b.recall AS b_recall, round(200 / greatest(a.search_time, b.search_time), 6) AS qps_parallel, round(200 / (a.search_time + b.search_time), 6) AS qps_sequential, greatest(a.construction_time, b.construction_time) AS build_parallel, round(a.construction_time + b.construction_time, 6) AS build_sequential, coalesce(a.memory, 0) + coalesce(b.memory, 0) AS memory FROM a JOIN b USING (dataset)")
def config_pairs(spark, sf_dir):
    r = runs(spark, sf_dir)
    out = A.config_pairs(side(r, "A"), side(r, "B"))
    return out.withColumns({c: rounded(c, 6) for c in ("qps_parallel", "qps_sequential", "build_sequential")})


@query("config_triples", f", {_PAIRS}, c AS ({_SIDE.format(m='C')}) SELECT dataset, count(*) AS n, round(max(least(200 / a.search_time, 200 / b.search_time, 200 / c.search_time)), 6) AS best_qps FROM a JOIN b USING (dataset) JOIN c USING (dataset) GROUP BY dataset")
def config_triples(spark, sf_dir):
    # the best of the slowest of three is the slowest of the three best, so no triple is made
    r = runs(spark, sf_dir)
    own = lambda m, k: side(r, m).groupBy("dataset").agg(F.count(F.lit(1)).alias(f"n_{k}"), F.max(200 / F.col("search_time")).alias(f"qps_{k}"))
    every = own("A", "a").join(own("B", "b"), "dataset").join(own("C", "c"), "dataset")
    return every.select("dataset", (F.col("n_a") * F.col("n_b") * F.col("n_c")).alias("n"), F.round(F.least("qps_a", "qps_b", "qps_c"), 6).alias("best_qps"))


@query("memory_sum", f", {_PAIRS} SELECT dataset, round(sum(coalesce(a.memory, 0) + coalesce(b.memory, 0)), 6) AS memory FROM a JOIN b USING (dataset) GROUP BY dataset")
def memory_sum(spark, sf_dir):
    r = runs(spark, sf_dir)
    own = lambda m, k: side(r, m).groupBy("dataset").agg(F.count(F.lit(1)).alias(f"n_{k}"), F.sum(F.coalesce("memory", F.lit(0.0))).alias(f"m_{k}"))
    both = own("A", "a").join(own("B", "b"), "dataset")
    return both.select("dataset", F.round(F.col("m_a") * F.col("n_b") + F.col("m_b") * F.col("n_a"), 6).alias("memory"))


@query("nq_to_qps", "SELECT id, round(CASE WHEN contains(lower(dataset), 'sift') THEN 10000 ELSE 200 END / construction_time, 6) AS qps FROM runs")
def nq_to_qps(spark, sf_dir):
    return runs(spark, sf_dir).select("id", F.round(A.queries_in() / F.col("construction_time"), 6).alias("qps"))


@query("win_lose", f", {_PAIRS} SELECT dataset, sum((merged >= greatest(ar, br))::INT)::BIGINT AS wins, sum((merged < greatest(ar, br))::INT)::BIGINT AS losses FROM (SELECT dataset, a.recall AS ar, b.recall AS br, least(1.0, (a.recall + b.recall) * 0.55) AS merged FROM a JOIN b USING (dataset)) GROUP BY dataset")
def win_lose(spark, sf_dir):
    # runs of equal recall win and lose alike: pairs of recalls, with counts
    r = runs(spark, sf_dir)
    own = lambda m, k: side(r, m).groupBy("dataset", F.col("recall").alias(f"{k}_recall")).agg(F.count(F.lit(1)).alias(f"n_{k}"))
    pairs = own("A", "a").join(own("B", "b"), "dataset").withColumn("merged", F.least(F.lit(1.0), (F.col("a_recall") + F.col("b_recall")) * 0.55))
    return A.win_lose(pairs, F.col("n_a") * F.col("n_b"))


@query("best_param_pick", "SELECT dataset, name, recall FROM (SELECT dataset, 'f' || id AS name, recall, row_number() OVER (PARTITION BY dataset ORDER BY recall DESC, 'f' || id DESC) AS r FROM ok WHERE contains('f' || id, '1')) WHERE r = 1")
def best_param_pick(spark, sf_dir):
    return A.best_parameter(A.valid(runs(spark, sf_dir)).withColumn("name", F.concat(F.lit("f"), F.col("id").cast("string"))), "name", "1")


@query("timing_rescale", "SELECT dataset, combo, x, round(r / first_value(r) OVER (PARTITION BY dataset, combo ORDER BY x) * 0.9, 6) AS rescaled FROM (SELECT dataset, combo, x, max(recall) * (1 + x / 100.0::DOUBLE) AS r FROM ok, (VALUES (1), (2), (3)) t(x) GROUP BY 1, 2, 3)")
def timing_rescale(spark, sf_dir):
    top = A.valid(runs(spark, sf_dir)).groupBy("dataset", "combo").agg(F.max("recall").alias("r"))
    curves = top.withColumn("x", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3)]))).select("dataset", "combo", "x", (F.col("r") * (1 + F.col("x") / 100.0)).alias("recall"), F.lit(0.9).alias("measured"))
    return A.rescale(curves)


_LOW = "low AS (SELECT dataset, combo, recall AS x, min(construction_time) AS y FROM runs WHERE recall IS NOT NULL GROUP BY 1, 2, 3), seg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM low WINDOW w AS (PARTITION BY dataset, combo ORDER BY x)), span AS (SELECT dataset, combo, min(x) AS lo, max(x) AS hi FROM low GROUP BY 1, 2), pair AS (SELECT a.dataset, a.combo AS combo_a, b.combo AS combo_b, a.lo AS lo_a, a.hi AS hi_a, b.lo AS lo_b, b.hi AS hi_b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM span a JOIN span b ON a.dataset = b.dataset AND a.combo <> b.combo), grid AS (SELECT dataset, combo_a, combo_b, i, lo + (hi - lo) * i / 199::DOUBLE AS x FROM pair, range(0, 200) t(i) WHERE hi > lo)"
_AT = "SELECT grid.dataset, combo_a, combo_b, i, CASE WHEN x2 IS NULL THEN y ELSE y + (y2 - y) * (grid.x - seg.x) / (x2 - seg.x) END AS y FROM grid JOIN seg ON grid.dataset = seg.dataset AND combo_{s} = combo AND ((grid.x >= seg.x AND grid.x < x2) OR (x2 IS NULL AND grid.x >= seg.x))"
_DOM = f", {_LOW}, ya AS ({_AT.format(s='a')}), yb AS ({_AT.format(s='b')}), sh AS (SELECT ya.dataset, ya.combo_a, ya.combo_b, avg((ya.y < yb.y)::INT) AS share FROM ya JOIN yb ON ya.dataset = yb.dataset AND ya.combo_a = yb.combo_a AND ya.combo_b = yb.combo_b AND ya.i = yb.i GROUP BY 1, 2, 3), dom AS (SELECT pair.dataset, pair.combo_a, pair.combo_b, round(CASE WHEN hi > lo THEN share WHEN lo_a > hi_b THEN 1 WHEN lo_b > hi_a THEN 0 END, 4) AS ratio FROM pair LEFT JOIN sh ON pair.dataset = sh.dataset AND pair.combo_a = sh.combo_a AND pair.combo_b = sh.combo_b)"


@query("domination_ratio", f"{_DOM} SELECT * FROM dom")
def domination_ratio(spark, sf_dir):
    return A.domination(runs(spark, sf_dir), "construction_time")


@query("domination_avg", f"{_DOM}, whole AS (SELECT dataset FROM dom GROUP BY dataset HAVING count(*) = count(ratio)) SELECT combo_a, combo_b, round(avg(ratio), 4) AS ratio FROM dom WHERE dataset IN (SELECT dataset FROM whole) GROUP BY 1, 2")
def domination_avg(spark, sf_dir):
    return A.average_domination(A.domination(runs(spark, sf_dir), "construction_time"))
