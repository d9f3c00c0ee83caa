"""Operators on result lists and rows of numbers: smallest entries, set algebra, refinement curves, costs, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.distances import distance
from lodestar.operators.search import pruned, refine, top_k


def smallest(v: str, k: int, largest: bool = False) -> Column:
    """The k smallest (or largest) entries of an array as structs of x and pos, ties by position."""
    x = "-x" if largest else "x"
    return F.expr(f"transform(slice(array_sort(transform({v}, (x, i) -> struct({x} AS s, i AS pos, x AS x))), 1, {k}), e -> struct(e.x AS x, e.pos AS pos))")


def argsort(v: str) -> Column:
    """Positions of an array's entries in ascending order, ties by position."""
    return F.expr(f"transform(array_sort(transform({v}, (x, i) -> struct(x AS s, i AS pos))), e -> e.pos)")


def parted(df: DataFrame, column: str, share: float) -> DataFrame:
    """df with `low`, whether the row is among the smallest share of the column; one threshold for all rows."""
    cut = df.agg(F.percentile(column, F.lit(share)).alias("c")).first().c
    return df.withColumn("low", F.col(column) <= F.lit(cut))


def intersect(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("qid", "id").distinct().join(second.select("qid", "id"), ["qid", "id"], "left_semi")


def except_(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("qid", "id").distinct().join(second.select("qid", "id"), ["qid", "id"], "left_anti")


def shared_sizes(first: DataFrame, second: DataFrame) -> DataFrame:
    """(qid, n): the ids that both lists of a query hold, each once; zero where none is shared."""
    n = intersect(first, second).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    return first.select("qid").distinct().join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def running_precision(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, rank, precision): of the first ranks of each list, the share that is true."""
    true = truth.select("qid", "id").withColumn("hit", F.lit(1))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return results.join(true, ["qid", "id"], "left").select("qid", "rank", (F.sum(F.coalesce("hit", F.lit(0))).over(w) / F.count(F.lit(1)).over(w)).alias("precision"))


def refinement_curve(ranked: DataFrame, base: DataFrame, queries: DataFrame, truth: DataFrame, k: int, factors: list[int]) -> DataFrame:
    """(factor, recall): of one ranking, the first factor * k rows re-ranked exactly; the ranking is made once."""
    nq = truth.select("qid").distinct().count()
    out = None
    for factor in factors:
        found = refine(ranked.where(F.col("rank") <= factor * k), base, queries, k)
        one = found.join(truth.select("qid", "id"), ["qid", "id"], "left_semi").agg(F.lit(factor).alias("factor"), (F.count(F.lit(1)) / F.lit(max(nq, 1) * k)).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


def range_precision_recall(found: DataFrame, true: DataFrame, radii: list[float]) -> DataFrame:
    """(radius, precision, recall) of range results (qid, id, dist) cut at each radius; both tables are made once and meet by
    their keys. An empty result has precision 1, an empty truth recall 1."""
    under = lambda df, name, none: df.select("qid", "id", *[(F.col("dist") < r).cast("long").alias(f"{name}{n}") for n, r in enumerate(radii)], *[F.lit(0).cast("long").alias(f"{none}{n}") for n in range(len(radii))])
    names = [f"{name}{n}" for name in "ft" for n in range(len(radii))]
    each = under(found, "f", "t").unionByName(under(true, "t", "f")).groupBy("qid", "id").agg(*[F.sum(c).alias(c) for c in names])
    known = F.when(F.col("qid").isNotNull() & F.col("id").isNotNull(), 1)
    one = each.agg(*[F.sum(c).alias(c) for c in names], *[F.sum(known * F.col(f"f{n}") * F.col(f"t{n}")).alias(f"b{n}") for n in range(len(radii))])
    share = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) == 0, 1.0).otherwise(F.coalesce(F.col(a), F.lit(0)) / F.col(b))
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), share(f"b{n}", f"f{n}").alias("precision"), share(f"b{n}", f"t{n}").alias("recall")) for n, r in enumerate(radii)])).alias("x")).select("x.*")


def probe_costs(lists: DataFrame, probes: DataFrame) -> DataFrame:
    """(qid, compared, share): rows that a query's lists hold, and their share of the table."""
    sizes = lists.groupBy("list_no").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 1
    return probes.join(sizes, "list_no", "left").groupBy("qid").agg(F.sum(F.coalesce("n", F.lit(0))).alias("compared")).withColumn("share", F.col("compared") / F.lit(total))


def capped_probes(lists: DataFrame, probes: DataFrame, most: int) -> DataFrame:
    """Probes (qid, list_no, list_dist) until the lists before hold `most` rows: the limit on codes of a search."""
    sizes = lists.groupBy("list_no").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("qid").orderBy("list_dist", "list_no")
    before = F.sum(F.coalesce("n", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return probes.join(sizes, "list_no", "left").withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < most).drop("_b", "n")


def health(assigned: DataFrame) -> DataFrame:
    """(list_no, n, error): size and mean squared distance to the centroid of each list."""
    return assigned.groupBy("list_no").agg(F.count(F.lit(1)).alias("n"), F.avg("list_dist").alias("error"))


def pruned_search(lists: DataFrame, queries: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """Exact search with lists: rows of the query's nearest list give a bound, by which the triangle inequality leaves out
    all rows whose distance to their centroid differs too much from the query's. lists: id, v, list_no, list_dist;
    probes: qid, list_no, list_dist for every list (squared distances). List numbers count from 0."""
    of = probes.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("list_no", F.sqrt("list_dist").alias("apart")))).alias("_l"))
    odd = of.where("exists(_l, x -> x.list_no <> array_position(_l, x) - 1)")
    if odd.isEmpty():
        reaches = queries.join(of, "qid").select("qid", "q", F.col("_l.apart").alias("apart"))
        found = pruned(lists.select("id", "v", "list_no", F.sqrt("list_dist").alias("apart")), reaches, k)
        if found is not None:
            return found
    nearest = probes.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("list_dist", "list_no"))).where("_r = 1").select("qid", "list_no")
    first = top_k(lists.join(nearest.join(queries, "qid"), "list_no").select("qid", "id", distance("l2").alias("dist")), k)
    reach = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("reach"))
    wide = probes.join(reach, "qid", "left").select("qid", "list_no", F.sqrt("list_dist").alias("qd"), F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    left = lists.join(wide, "list_no").where(F.abs(F.sqrt("list_dist") - F.col("qd")) <= F.col("reach") + 1e-9)
    return top_k(left.join(queries, "qid").select("qid", "id", distance("l2").alias("dist")), k)


def best_of_parameter(runs: DataFrame, parameter: str, score: str, least_points: int = 1) -> DataFrame:
    """Of each dataset and parameter the row with the highest score (then the least id), where so many rows have one."""
    w = Window.partitionBy("dataset", parameter)
    ranked = runs.where(F.col(score).isNotNull()).withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(F.col(score).desc(), "id"))})
    return ranked.where((F.col("_r") == 1) & (F.col("_n") >= least_points)).drop("_n", "_r")


def explored(grid: DataFrame, perf: str, time: str, order: list[str]) -> DataFrame:
    """Settings of a grid that are worth a run: `cost_bound` and `perf_bound` are known bounds of a setting (it takes at
    least, it reaches at most); a setting goes where a measured one is as fast as its bound and at least as good."""
    measured = grid.where(F.col(perf).isNotNull()).select(F.col(perf).alias("_p"), F.col(time).alias("_t"))
    best = measured.groupBy("_t").agg(F.max("_p").alias("_p"))
    worse = grid.join(F.broadcast(best), (F.col("_t") <= F.col("cost_bound")) & (F.col("_p") >= F.col("perf_bound")), "left_semi").where(F.col(perf).isNull())
    return grid.join(worse.select(*order), order, "left_anti")
