"""Analytics of index configurations: pairing, cost model, budgets, best recall, domination, summaries.

The unified table has one row for each measured configuration: dataset, combo (one model, or several joined by ' + '),
qps, recall, construction_time, memory. Everything is relational: quantiles, conditional maxima, windows and joins on
the dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROFILES = ((1, 0.25), (2, 0.40), (3, 0.50))
GRID = 200
#: Runs of a side, of one dataset, that meet as many of the other side in one group.
PAIR_RUNS = 2048


def valid(runs: DataFrame) -> DataFrame:
    """Rows that can be judged: nothing missing, positive speed and build time."""
    return runs.where("recall IS NOT NULL AND qps > 0 AND construction_time > 0")


def budget_profiles(runs: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(dataset, profile, tq, tc, tm): quantiles of latency, build time and memory; profile 1 is the tightest. Datasets
    without valid rows take theirs from `fallback`, if given."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    own = valid(runs).groupBy("dataset").agg(*[q(c, p).alias(f"{name}{k}") for k, p in PROFILES for name, c in (("tq", 1 / F.col("qps")), ("tc", F.col("construction_time")), ("tm", F.col("memory")))])
    out = own.select("dataset", F.explode(F.array(*[F.struct(F.lit(k).alias("profile"), F.col(f"tq{k}").alias("tq"), F.col(f"tc{k}").alias("tc"), F.col(f"tm{k}").alias("tm")) for k, _ in PROFILES])).alias("p")).select("dataset", "p.*")
    if fallback is None:
        return out
    every = runs.select("dataset").distinct().crossJoin(F.broadcast(runs.sparkSession.createDataFrame([(k,) for k, _ in PROFILES], "profile int")))
    f = fallback.select("dataset", "profile", *[F.col(c).alias(f"f_{c}") for c in ("tq", "tc", "tm")])
    return every.join(out, ["dataset", "profile"], "left").join(f, ["dataset", "profile"], "left").select("dataset", "profile", *[F.coalesce(c, f"f_{c}").alias(c) for c in ("tq", "tc", "tm")])


def feasible(constrained: bool = True, memory: bool = False) -> Column:
    """Within the budget. Speed is compared as qps >= 1 / tq."""
    if not constrained:
        return F.lit(True)
    ok = (F.col("qps") >= 1.0 / F.col("tq")) & (F.col("construction_time") <= F.col("tc"))
    return ok & (F.col("memory") <= F.col("tm")) if memory else ok


def best_recall(runs: DataFrame, profiles: DataFrame, constrained: bool = True, memory: bool = False) -> DataFrame:
    """Best recall of each combo within each budget; combos without a feasible row stay, with 0."""
    fits = feasible(constrained, memory)
    return valid(runs).join(profiles, "dataset").groupBy("dataset", "profile", "combo").agg(F.coalesce(F.max(F.when(fits, F.col("recall"))), F.lit(0.0)).alias("best_recall"), F.max(fits).alias("feasible"))


def n_models(combo: str = "combo", separator: str = r"\+") -> Column:
    return F.size(F.split(combo, separator)).cast("long")


def without_models(runs: DataFrame, banned: list[str]) -> DataFrame:
    return runs.where(~F.arrays_overlap(F.transform(F.split("combo", r"\+"), lambda x: F.trim(x)), F.array(*[F.lit(x) for x in banned])))


def by_category(best: DataFrame) -> DataFrame:
    """Best single model and best pair of each dataset under the tight and the relaxed budget."""
    kind = F.when(n_models() == 1, "standalone").when(n_models() == 2, "pairing")
    tight = F.when(F.col("profile") == 1, "tight").when(F.col("profile") == 3, "relaxed")
    rows = best.withColumns({"category": kind, "level": tight}).where("category IS NOT NULL AND level IS NOT NULL")
    return rows.groupBy("level", "dataset").pivot("category", ["standalone", "pairing"]).agg(F.max("best_recall"))


def wins(categories: DataFrame, skip_any: bool = False) -> DataFrame:
    """Averages over datasets with a value, and strict wins. Datasets are skipped where both values are missing (or, with
    skip_any, where one is)."""
    s, p = F.coalesce("standalone", F.lit(-1.0)), F.coalesce("pairing", F.lit(-1.0))
    skipped = ((s < 0) | (p < 0)) if skip_any else ((s < 0) & (p < 0))
    return categories.groupBy("level").agg(
        F.round(F.avg(F.when(s >= 0, s)), 6).alias("standalone_avg"),
        F.round(F.avg(F.when(p >= 0, p)), 6).alias("pairing_avg"),
        F.sum((~skipped & (s > p)).cast("long")).alias("standalone_wins"),
        F.sum((~skipped & (p > s)).cast("long")).alias("pairing_wins"),
    )


def cohort(best: DataFrame, properties: DataFrame, label: Column) -> DataFrame:
    """Mean best recall of each combo by a label of its dataset's properties."""
    return best.join(F.broadcast(properties.withColumn("cohort", label)), "dataset").where("cohort IS NOT NULL").groupBy("cohort", "profile", "combo").agg(F.round(F.avg("best_recall"), 6).alias("avg_best"), F.count(F.lit(1)).alias("n"))


def hardness(properties: DataFrame) -> Column:
    """hard up to the median of relative contrast, easy above it."""
    median = properties.agg(F.percentile("rc", F.lit(0.5))).first()[0]
    return F.when(F.col("rc") <= F.lit(median), "hard").otherwise("easy")


def scale_of(name: str = "dataset") -> Column:
    out = F.when(F.contains(name, F.lit("500k")), "500k")
    for x in ("100k", "50k", "10k"):
        out = out.when(F.contains(name, F.lit(x)), x)
    return out.otherwise("1M")


def config_pairs(left: DataFrame, right: DataFrame, nq: Column | int = 200) -> DataFrame:
    """All pairs of configurations of two models on the same dataset, with the combined cost model: parallel runs take
    the slower side, sequential ones the sum. A dataset's runs are dealt into chunks, and each chunk of the left meets
    each of the right in a group of its own, so no task takes all pairs of a dataset."""
    own = lambda df, s: df.select("dataset", *[F.col(c).alias(f"{s}_{c}") for c in ("model", "recall", "search_time", "construction_time", "memory")])
    sizes = lambda df: df.groupBy("dataset").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count(F.lit(1))).first()
    (most_a, datasets), (most_b, _) = sizes(left), sizes(right)
    n_a, n_b = -(-most_a // PAIR_RUNS) or 1, -(-most_b // PAIR_RUNS) or 1
    keys, parts = ["dataset", "_a", "_b"], max(1, min(datasets * n_a * n_b, 4096))
    chunk = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a, b = own(left, "a"), own(right, "b")
    a = a.withColumn("_a", chunk(a, n_a)).withColumn("_b", every(n_b)).repartition(parts, *keys)
    b = b.withColumn("_b", chunk(b, n_b)).withColumn("_a", every(n_a)).repartition(parts, *keys)
    n = F.lit(nq) if isinstance(nq, int) else nq
    return a.join(b.hint("shuffle_hash"), keys).select(
        "dataset", F.concat_ws(" + ", "a_model", "b_model").alias("combo"), "a_recall", "b_recall",
        (n / F.greatest("a_search_time", "b_search_time")).alias("qps_parallel"), (n / (F.col("a_search_time") + F.col("b_search_time"))).alias("qps_sequential"),
        F.greatest("a_construction_time", "b_construction_time").alias("build_parallel"), (F.col("a_construction_time") + F.col("b_construction_time")).alias("build_sequential"),
        (F.coalesce("a_memory", F.lit(0.0)) + F.coalesce("b_memory", F.lit(0.0))).alias("memory"),
    )


def queries_in(dataset: str = "dataset") -> Column:
    return F.when(F.contains(F.lower(F.col(dataset)), F.lit("sift")), 10_000).otherwise(200)


def domination(runs: DataFrame, metric: str) -> DataFrame:
    """(dataset, combo_a, combo_b, ratio): over the recalls that both curves span, the share of 200 evenly spaced ones at
    which a's interpolated metric is below b's. Without a common span the combo with the higher recalls dominates (1 or
    0). Segments between neighbouring recalls meet grid points by a range condition within dataset and combo."""
    low = runs.where(f"recall IS NOT NULL AND {metric} IS NOT NULL").groupBy("dataset", "combo", "recall").agg(F.min(metric).alias("y"))
    w = Window.partitionBy("dataset", "combo").orderBy("recall")
    segments = low.withColumns({"x2": F.lead("recall").over(w), "y2": F.lead("y").over(w)})
    spans = low.groupBy("dataset", "combo").agg(F.min("recall").alias("lo"), F.max("recall").alias("hi"))
    pair = spans.select("dataset", F.col("combo").alias("combo_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a")).join(spans.select("dataset", F.col("combo").alias("combo_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b")), "dataset").where("combo_a != combo_b")
    pair = pair.withColumns({"lo": F.greatest("lo_a", "lo_b"), "hi": F.least("hi_a", "hi_b")})
    grid = pair.where("hi > lo").select("dataset", "combo_a", "combo_b", F.posexplode(F.expr(f"transform(sequence(0, {GRID - 1}), i -> lo + (hi - lo) * i / {GRID - 1}D)")).alias("i", "x"))

    def at(side: str) -> DataFrame:
        s = segments.select("dataset", F.col("combo").alias(f"combo_{side}"), F.col("recall").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
        hit = grid.join(s, ["dataset", f"combo_{side}"]).where("(x >= x1 AND x < x2) OR (x2 IS NULL AND x >= x1)")
        return hit.select("dataset", "combo_a", "combo_b", "i", F.expr("CASE WHEN x2 IS NULL THEN y1 ELSE y1 + (y2 - y1) * (x - x1) / (x2 - x1) END").alias(f"y_{side}"))

    share = at("a").join(at("b"), ["dataset", "combo_a", "combo_b", "i"]).groupBy("dataset", "combo_a", "combo_b").agg(F.avg((F.col("y_a") < F.col("y_b")).cast("double")).alias("share"))
    apart = F.when(F.col("hi") > F.col("lo"), F.col("share")).when(F.col("lo_a") > F.col("hi_b"), 1.0).when(F.col("lo_b") > F.col("hi_a"), 0.0)
    return pair.join(share, ["dataset", "combo_a", "combo_b"], "left").select("dataset", "combo_a", "combo_b", F.round(apart, 4).alias("ratio"))


def average_domination(matrix: DataFrame) -> DataFrame:
    """Means over datasets; a dataset with any missing ratio is left out."""
    whole = matrix.groupBy("dataset").agg(F.sum(F.col("ratio").isNull().cast("int")).alias("missing")).where("missing = 0").select("dataset")
    return matrix.join(whole, "dataset", "left_semi").groupBy("combo_a", "combo_b").agg(F.round(F.avg("ratio"), 4).alias("ratio"))


def best_parameter(runs: DataFrame, name: str, prefix: str) -> DataFrame:
    """The configuration with the highest recall among those whose name holds the prefix."""
    return runs.where(F.contains(name, F.lit(prefix))).groupBy("dataset").agg(F.max_by(F.struct(name, "recall"), F.struct("recall", name)).alias("b")).select("dataset", f"b.{name}", "b.recall")


def rescale(curves: DataFrame, factor: str = "recall") -> DataFrame:
    """Recall at refinement x as a share of that at 1, times a measured one."""
    first = curves.where("x = 1").select("dataset", "combo", F.col(factor).alias("_one"))
    return curves.join(first, ["dataset", "combo"]).select("dataset", "combo", "x", F.round(F.col(factor) / F.col("_one") * F.col("measured"), 6).alias("rescaled"))


def win_lose(pairs: DataFrame, n: Column | int = 1) -> DataFrame:
    """Pairs whose merged recall reaches, or misses, the better side's; n: how many pairs a row stands for."""
    n = F.lit(n) if isinstance(n, int) else n
    merged = F.col("merged") >= F.greatest("a_recall", "b_recall")
    return pairs.groupBy("dataset").agg(F.sum(merged.cast("long") * n).alias("wins"), F.sum((~merged).cast("long") * n).alias("losses"))
