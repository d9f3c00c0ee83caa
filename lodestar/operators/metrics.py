"""Evaluation of result lists against the truth: (qid, rank, id, dist) each."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bands of perf that a Pareto front is first looked for in.
BANDS = 1024
#: Bits of a double that one pass of `order_statistics` tells.
KEY_BITS = 13


def _hits(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    top = lambda x: x.where(F.col("rank") <= k).select("qid", "id", "rank")
    return top(result).join(top(truth).withColumnRenamed("rank", "true_rank"), ["qid", "id"])


def _n(truth: DataFrame) -> DataFrame:
    return truth.agg(F.countDistinct("qid").alias("nq"))


def recall_at_k(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Found true neighbours over queries times k."""
    hit = _hits(result, truth, k).agg(F.count(F.lit(1)).alias("hits"))
    return hit.join(F.broadcast(_n(truth))).select(F.lit(k).cast("long").alias("k"), F.round(F.col("hits") / (F.col("nq") * k), 6).alias("recall"))


def recall_many(result: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """Recall at several k in one pass: a hit counts at every k from the larger of its ranks."""
    most = max(ks)
    hit = _hits(result, truth, most).withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks]))).where((F.col("rank") <= F.col("k")) & (F.col("true_rank") <= F.col("k")))
    return hit.groupBy("k").agg(F.count(F.lit(1)).alias("hits")).join(F.broadcast(_n(truth))).select("k", F.round(F.col("hits") / (F.col("nq") * F.col("k")), 6).alias("recall"))


def refine_multiplier(union: DataFrame, k: int) -> DataFrame:
    return union.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("qid").alias("nq")).select(F.round(F.col("n") / (F.col("nq") * k), 6).alias("multiplier"))


def one_recall_at_r(result: DataFrame, truth: DataFrame, rs: list[int]) -> DataFrame:
    """Share of queries whose nearest neighbour is among the first r."""
    first = truth.where("rank = 1").select("qid", "id")
    hit = result.join(first, ["qid", "id"]).select("rank")
    counts = hit.withColumn("r", F.explode(F.array(*[F.lit(r).cast("long") for r in rs]))).where("rank <= r").groupBy("r").agg(F.count(F.lit(1)).alias("hits"))
    return counts.join(F.broadcast(_n(truth))).select("r", F.round(F.col("hits") / F.col("nq"), 6).alias("one_recall"))


def recall_by_distance(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of results no farther than the k-th true neighbour, so that ties count."""
    reach = truth.where(F.col("rank") <= k).groupBy("qid").agg(F.max("dist").alias("reach"))
    good = result.where(F.col("rank") <= k).join(reach, "qid").where("dist <= reach").agg(F.count(F.lit(1)).alias("good"))
    return good.join(F.broadcast(_n(truth))).select(F.round(F.col("good") / (F.col("nq") * k), 6).alias("recall"))


def map_truncated(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Mean over queries of the average precision in which both lists are cut at each rank."""
    hit = _hits(result, truth, k).withColumn("m", F.greatest("rank", "true_rank"))
    at = hit.select("qid", F.col("rank").alias("r")).join(hit.select("qid", "m"), "qid").where("m <= r").groupBy("qid", "r").agg(F.count(F.lit(1)).alias("n"))
    ap = at.groupBy("qid").agg((F.sum(F.col("n") / F.col("r")) / k).alias("ap")).agg(F.sum("ap").alias("total"))
    return ap.join(F.broadcast(_n(truth))).select(F.round(F.coalesce("total", F.lit(0.0)) / F.col("nq"), 6).alias("map"))


def approx_ratio(result: DataFrame, truth: DataFrame, zero_is_one: bool = False) -> DataFrame:
    """Mean over queries of the mean ratio of found to true distances at equal ranks."""
    both = result.select("qid", "rank", "dist").join(truth.select("qid", "rank", F.col("dist").alias("true_dist")), ["qid", "rank"])
    ratio = F.when(F.col("true_dist") == 0, 1.0).otherwise(F.col("dist") / F.col("true_dist")) if zero_is_one else (F.col("dist") + 1e-12) / (F.col("true_dist") + 1e-12)
    return both.groupBy("qid").agg(F.avg(ratio).alias("r")).agg(F.round(F.avg("r"), 6).alias("ratio"))


def overall_ratio_total(result: DataFrame, truth: DataFrame) -> DataFrame:
    """Ratios over all results together; a true distance of zero counts as one."""
    both = result.select("qid", "rank", "dist").join(truth.select("qid", "rank", F.col("dist").alias("true_dist")), ["qid", "rank"])
    return both.agg(F.round(F.avg(F.when(F.col("true_dist") == 0, 1.0).otherwise(F.col("dist") / F.col("true_dist"))), 6).alias("ratio"))


def range_counts(result: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, n_found, n_true, n_both for every query, zero where there is none; both tables are made once."""
    one = lambda df, found, true: df.select("qid", "id", F.lit(found).cast("long").alias("n_found"), F.lit(true).cast("long").alias("n_true"))
    each = one(result, 1, 0).unionByName(one(truth, 0, 1)).groupBy("qid", "id").agg(F.sum("n_found").alias("n_found"), F.sum("n_true").alias("n_true"))
    both = F.sum(F.when(F.col("id").isNotNull(), F.col("n_found") * F.col("n_true"))).alias("n_both")
    out = queries.select("qid").join(each.groupBy("qid").agg(F.sum("n_found").alias("n_found"), F.sum("n_true").alias("n_true"), both), "qid", "left")
    return out.na.fill(0, ["n_found", "n_true", "n_both"])


def range_pr_overall(result: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    s = range_counts(result, truth, queries).agg(*[F.sum(c).alias(c) for c in ("n_found", "n_true", "n_both")])
    return s.select(F.round(F.when(F.col("n_found") == 0, 1.0).otherwise(F.col("n_both") / F.col("n_found")), 6).alias("precision"), F.round(F.when(F.col("n_true") == 0, F.when(F.col("n_found") == 0, 1.0).otherwise(0.0)).otherwise(F.col("n_both") / F.col("n_true")), 6).alias("recall"))


def range_pr_average(result: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    c = range_counts(result, truth, queries)
    p = F.when(F.col("n_found") == 0, 1.0).otherwise(F.col("n_both") / F.col("n_found"))
    r = F.when(F.col("n_true") == 0, F.when(F.col("n_found") == 0, 1.0).otherwise(0.0)).otherwise(F.col("n_both") / F.col("n_true"))
    return c.agg(F.round(F.avg(p), 6).alias("precision"), F.round(F.avg(r), 6).alias("recall"))


def imbalance_factor(sizes: DataFrame, count: str = "n") -> DataFrame:
    """k * sum(c^2) / sum(c)^2: 1 for equal lists."""
    c = F.col(count).cast("double")
    return sizes.agg(F.round(F.count(F.lit(1)) * F.sum(c * c) / F.pow(F.sum(c), F.lit(2)), 6).alias("imbalance"))


def order_keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of doubles; zeros are equal, NaN is the largest."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _double_of(key: int) -> float:
    return float(np.array([key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)], np.uint64).view(np.float64)[0])


def order_statistics(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """The values (a column of doubles without nulls) at places from 0 in ascending order. Their 64 bits are told in rounds of
    KEY_BITS: each counts the rows by the next bits, under the bits found so far, so no task holds values."""
    found = dict.fromkeys(ranks, (0, 0))  # the bits so far, rows before them
    for shift in range(64 - KEY_BITS, -KEY_BITS, -KEY_BITS):
        shift, width = max(shift, 0), KEY_BITS + min(shift, 0)
        known = np.array(sorted({p for p, _ in found.values()}), np.uint64)

        def run(batches, shift=shift, width=width, known=known):
            counts = np.zeros((len(known), 1 << width), np.int64)
            for batch in batches:
                keys = order_keys(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64))
                above = keys >> np.uint64(shift + width) if shift + width < 64 else np.zeros(len(keys), np.uint64)
                at = np.minimum(np.searchsorted(known, above), len(known) - 1)
                inside = known[at] == above
                digit = (keys[inside] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
                np.add.at(counts.reshape(-1), (at[inside] << width) + digit.astype(np.int64), 1)
            p, digit = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(digit), pa.array(counts[p, digit])], ["p", "digit", "n"])

        rows = values.mapInArrow(run, "p long, digit long, n long").groupBy("p", "digit").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((len(known), 1 << width), np.int64)
        counts[rows["p"].to_numpy(), rows["digit"].to_numpy()] = rows["n"].to_numpy()
        for rank, (prefix, before) in found.items():
            below = before + np.cumsum(counts[np.searchsorted(known, np.uint64(prefix))])
            digit = int(np.searchsorted(below, rank, side="right"))
            found[rank] = (prefix << width) | digit, int(below[digit - 1]) if digit else before
    return {rank: _double_of(key) for rank, (key, _) in found.items()}


def latency_percentiles(times: DataFrame, column: str, points: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99, 0.999)) -> DataFrame:
    """Exact percentiles with linear interpolation, as Spark's `percentile` gives them, in bounded memory."""
    values = times.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n, names = values.count(), ["p" + str(p * 100).replace(".0", "").replace(".", "_") for p in points]
    kinds, out = ", ".join(f"`{c}` double" for c in names), []
    places = [(n - 1) * p for p in points] if n else []
    at = order_statistics(values, sorted({f(x) for x in places for f in (math.floor, math.ceil)})) if n else {}
    for x in places:
        low, high = math.floor(x), math.ceil(x)
        out.append(at[low] if low == high or at[low] == at[high] else (high - x) * at[low] + (x - low) * at[high])
    made = times.sparkSession.createDataFrame([tuple(out or [None] * len(points))], kinds)
    return made.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) for c in names])


def pareto_front(points: DataFrame) -> DataFrame:
    """Operating points (perf, t, key) that no other one beats: more perf, less time; of equal perf the faster, of equal
    points the least key; perf 0 is no point. Bands of perf are compared first, by their least times, so that only what no
    higher band beats is ordered, each band by itself."""
    best = points.where("perf > 0").groupBy("perf").agg(F.min(F.struct("t", "key")).alias("b")).select("perf", "b.t", "b.key")
    low, high = points.where("perf > 0").agg(F.min("perf"), F.max("perf")).first()
    width = float(high - low) / BANDS if low is not None and math.isfinite(high - low) else 0.0
    banded = best.withColumn("_band", F.floor((F.col("perf") - F.lit(low)) / width).cast("int") if width else F.lit(0))
    above = Window.orderBy(F.col("_band").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over BANDS + 1 rows at most
    least = banded.groupBy("_band").agg(F.min("t").alias("_t")).select("_band", F.min("_t").over(above).alias("_above"))
    left = banded.join(F.broadcast(least), "_band").where("_above IS NULL OR t < _above")
    own = Window.partitionBy("_band").orderBy(F.col("perf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return left.withColumn("_before", F.min("t").over(own)).where("_before IS NULL OR t < _before").select("perf", "t", "key")


def time_for_perf(points: DataFrame, targets: list[float]) -> DataFrame:
    wanted = points.sparkSession.createDataFrame([(float(x),) for x in targets], "target double")
    return wanted.join(points, F.col("perf") >= F.col("target"), "left").groupBy("target").agg(F.coalesce(F.min("t"), F.lit(1e50)).alias("t"))
