"""Host-level quality rules, with DataFrame functions only.

Rules are checked on each document, failures are counted by host (`source`), each host's failure rate is shrunk towards
all hosts' by an empirical beta prior, and the host's verdict is joined back to its documents. A document is kept if it
fails no rule itself and its host is not rejected.

The prior's mean m is the rate of all rows with a host, its strength follows from the hosts' weighted second moment less
what sampling alone explains (so hosts that differ by chance only are shrunk to the mean). A host is rejected if its
posterior lies over the limit, twice the mean or half of the way from the mean to 1, the lower of them, with some 95 %:
the posterior's mean is over the limit by 1.645 of its deviations. Limit and shrinkage follow the corpus; where hosts do
not differ, none is rejected.

Rules: under 50 words; over half of the words in repeated three-word windows; more symbols than words; over half of the
lines with words repeat earlier ones. The first two are the base.

Defined results: a null text has no words (it fails); rows with a null host are judged by their own rules alone, as there
is no host to judge; repeated rows count as rows of their own; an empty table gives no rows; columns of the input keep
their names and may be called anything but the columns added here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _shared

LEAST_WORDS = 50
#: A rejected host's rate is over so many times the mean, by so many deviations of the posterior.
TIMES, DEVIATIONS = 2.0, 1.645
#: The prior's strength where the hosts' rates differ by no more than sampling explains.
NO_SPREAD = 1e6
#: Rejected hosts up to this number are broadcast (some MB); more are joined by a salted shuffle.
BROADCAST_HOSTS = 100_000
SALTS = 32
_NEAR = 24


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use refers to it within a lambda."""
    return F.transform(F.array(value), use)[0]


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, each word once."""

    def spread(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.when(k + 1 < F.size(at), F.least(F.lit(3), F.get(at, k + 1) - p)).otherwise(3))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def by_sort(windows: Column) -> Column:
        def flagged(s: Column) -> Column:
            both = F.filter(s, lambda v, k: F.get(s, k - 1)["h"].eqNullSafe(v["h"]) | F.get(s, k + 1)["h"].eqNullSafe(v["h"]))
            return let(F.sort_array(F.transform(both, lambda v: v["p"])), spread)

        return let(F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p")))), flagged)

    def by_list(windows: Column, twice: Column) -> Column:
        places = F.transform(windows, lambda h, p: F.when(F.array_contains(twice, h), p))
        return let(F.filter(places, lambda p: p.isNotNull()), spread)

    def count(windows: Column) -> Column:
        twice = let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda h, k: F.get(s, k - 1).eqNullSafe(h))))
        return let(twice, lambda t: F.when(F.size(t) == 0, 0).when(F.size(t) <= _NEAR, by_list(windows, t)).otherwise(by_sort(windows)))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda k: F.xxhash64(F.get(words, k), F.get(words, k + 1), F.get(words, k + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, count))


def document_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and two booleans: base_failed, and rule_failed for any rule."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = let(
        split_words(body),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = docs.withColumns({"_words": own, "_lines": of_lines, "n_symbols": F.char_length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long")})
    counted = counted.select("*", "_words.*", "_lines.*").drop("_words", "_lines")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rule = base | (F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines"))
    return counted.withColumns({"base_failed": base, "rule_failed": rule})


def host_counts(judged: DataFrame, host: str = "source") -> DataFrame:
    """(_host, n, failed) of rows with a host."""
    return judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))


def rejected_hosts(hosts: DataFrame, times: float = TIMES, deviations: float = DEVIATIONS) -> DataFrame:
    """Of hosts (_host, n, failed) those whose failure rate, shrunk by the empirical beta prior, is over the limit."""
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(failed).alias("f"), F.sum(n * n).alias("nn"), F.sum(failed * failed / n).alias("ff")).first()
    total = sums.n or 0.0
    m = sums.f / total if total else 0.0
    strength, free = NO_SPREAD, (total - sums.nn / total - (sums.k - 1)) if total else 0.0
    if 0 < m < 1 and free > 0:
        # the share of the rates' variance that is not sampling, of the beta-binomial's moments
        share = (sums.ff - total * m * m - m * (1 - m) * (sums.k - 1)) / (m * (1 - m) * free)
        if share > 0:
            strength = min(NO_SPREAD, max(1.0, (1 - share) / share))
    rate = (failed + m * strength) / (n + strength)
    return hosts.where(rate - deviations * F.sqrt(rate * (1 - rate) / (n + strength + 1)) > min(times * m, (1 + m) / 2)).select("_host")


def join_verdicts(judged: DataFrame, rejected: DataFrame, host: str = "source") -> DataFrame:
    """Adds host_rejected. Few rejected hosts are broadcast, after a count; many are joined with the hot hosts salted."""
    if rejected.count() <= BROADCAST_HOSTS:
        right, on = F.broadcast(rejected), judged[host] == F.col("_host")
        return judged.join(right, on, "left").withColumn("host_rejected", F.col("_host").isNotNull()).drop("_host")
    salted = judged.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    right = rejected.withColumn("_own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    out = salted.join(right, (salted[host] == right["_host"]) & (salted["_salt"] == right["_own"]), "left")
    return out.withColumn("host_rejected", F.col("_host").isNotNull()).drop("_host", "_salt", "_own")


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """Counts, failures and `kept` of every document, with the named columns; the counts are written once."""
    judged = _shared.materialize(document_rules(docs, text).select(*(carry or ["doc_id", host]), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "rule_failed"), "rules")
    hosts = _shared.materialize(host_counts(judged, host), "hosts")
    out = join_verdicts(judged, rejected_hosts(hosts), host)
    return out.withColumn("kept", ~F.col("rule_failed") & ~F.col("host_rejected"))


def filter_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with their own columns. Rules are checked once: rows that pass are written, and a
    host's failures are its rows less those."""
    judged = document_rules(_shared.wrapped(docs, text=F.col(text), source=F.col(host)))
    passed = _shared.materialize(judged.where(~F.col("rule_failed")).select("_row", "source"), "passed")
    every = docs.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("n"))
    good = passed.where("source IS NOT NULL").groupBy(F.col("source").alias("_good")).agg(F.count(F.lit(1)).alias("passed"))
    hosts = every.join(good, F.col("_host") == F.col("_good"), "left").select("_host", "n", (F.col("n") - F.coalesce("passed", F.lit(0))).alias("failed"))
    rejected = rejected_hosts(_shared.materialize(hosts, "hosts"))
    if rejected.isEmpty():
        return _shared.unwrapped(passed, docs.columns)
    return _shared.unwrapped(join_verdicts(passed, rejected).where(~F.col("host_rejected")), docs.columns)


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(_shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, ws[p + 1] || ' ' || ws[p + 2] || ' ' || ws[p + 3] AS g FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 2, 0))) AS p FROM w)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS r FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(r, 0) AS n_repeat_words,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
  len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_own
  FROM w LEFT JOIN cov USING (doc_id)),
j AS (SELECT *, n_lines - n_own AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
k AS (SELECT *, base_failed OR n_symbols > n_words OR 2 * n_dup_lines > n_lines AS rule_failed FROM j),
h AS (SELECT source, count(*) AS n, sum(rule_failed::INT) AS failed FROM k WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(failed)::DOUBLE AS f, sum(n::DOUBLE * n) AS nn, sum(failed::DOUBLE * failed / n) AS ff FROM h),
m AS (SELECT *, f / n AS m, n - nn / n - (k - 1) AS free FROM t),
sh AS (SELECT *, CASE WHEN m > 0 AND m < 1 AND free > 0 THEN (ff - n * m * m - m * (1 - m) * (k - 1)) / (m * (1 - m) * free) ELSE 0 END AS share FROM m),
s AS (SELECT m, CASE WHEN share > 0 THEN least(1e6, greatest(1.0, (1 - share) / share)) ELSE 1e6 END AS s FROM sh),
r AS (SELECT source, n, s, (failed + m * s) / (n + s) AS rate, least(2 * m, (1 + m) / 2) AS top FROM h, s),
bad AS (SELECT source FROM r WHERE rate - 1.645 * sqrt(rate * (1 - rate) / (n + s + 1)) > top)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT rule_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM k
"""
