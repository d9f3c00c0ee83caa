"""Importance resampling towards a target distribution, by hashed word n-grams.

Features of a text are its runs of 1 to `longest` consecutive words, joined by one space, repeats counted; a feature's bucket
is the CRC-32 of its bytes modulo `buckets`. The corpus's and the target's bucket counts are summed over all rows; a bucket's
gain is 1000 times the logarithm of the target's smoothed share over the corpus's, floored, and a text's weight the floored
mean of its features' gains. Adding seeded Gumbel noise to the weights and drawing the highest is sampling without
replacement in proportion to exp(weight / 1000).

The texts of an Arrow batch are one byte buffer. A table of 256 classes tells word bytes from others, differences of
neighbouring classes give the words' starts and ends, and the table-driven CRCs of all words advance together, one byte of
each a step; a pair's CRC goes on from its first word's through the space and the second word. Words of over LONG bytes go
through zlib's CRC, one by one, so one very long word costs no step for each of its bytes.

The corpus is scanned twice (counts, then weights) and nothing of it is shuffled: tasks send at most `buckets` counts, and
`buckets` gains go back to them. Scores are whole numbers between some -60000 and 60000, so rows are counted by score and
ranked within a score; no task orders all rows.

Words: [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z in lower case, that is digits, letters and all characters beyond ASCII.

Defined results: null texts have no words, no features and weight 0; a null id is spelled '' in the noise and comes first
among ties; repeated rows are rows of their own; rows with under `least_words` words get a score but are never drawn; an
empty table gives no rows, an empty target counts as all zeros; other columns are not looked at, and `resample` carries them
whatever they are called.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import _shared
from lodestar.llm._kernels import LOWER, words

BUCKETS, LONGEST = 10_000, 2
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Longer words go through zlib's CRC.
LONG = 48
#: Bytes of text that are taken apart at once.
SLICE = 1 << 20
# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Bytes that are no part of a word.
BREAKS = np.ones(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    BREAKS[_a:_b] = False


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()
#: The state before the first byte and what the last is XORed with.
ONES = np.uint32(0xFFFFFFFF)


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of each span; all spans take their next byte in one step, longer ones one by one."""
    out = state.copy()
    short = -np.minimum(lengths, LONG + 1).astype(np.int16)
    by = np.argsort(short, kind="stable")
    far = int(np.searchsorted(short[by], -LONG, "left"))
    for k in by[:far]:
        out[k] = np.uint32(zlib.crc32(data[starts[k] : starts[k] + lengths[k]], int(out[k] ^ ONES))) ^ ONES
    by = by[far:]
    now, at, left = out[by], starts[by], lengths[by]
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, "left"))  # spans with a byte left
        now[:n] = CRC[(now[:n] ^ data[at[:n] + step]) & 0xFF] ^ (now[:n] >> np.uint32(8))
    out[by] = now
    return out


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of every feature, its row, and the number of words of each row."""
    data, offsets = _shared.buffers_of(texts)
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, BREAKS)
    lengths, n = ends - starts, len(starts)
    found, owners = [], []
    state = np.full(n, ONES, np.uint32)
    for size in range(1, min(longest, n) + 1):
        more = n - size + 1  # the runs that begin at words 0 to more - 1, unless they reach into the next row
        state = state[:more]
        if size > 1:
            state = CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> np.uint32(8))
        state = advance(state, data, starts[size - 1 :], lengths[size - 1 :])
        whole = rows[:more] == rows[size - 1 :]
        found.append((state[whole] ^ ONES) % np.uint32(buckets))
        owners.append(rows[:more][whole])
    none = [np.empty(0, np.int64)]
    return np.concatenate(found or none).astype(np.int64), np.concatenate(owners or none), np.bincount(rows, minlength=len(texts)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket occurs in all texts. Each task sends its own counts, Spark adds them up; the driver gets one
    number for each bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _shared.slices(batch, "text", SLICE):
                total += np.bincount(feature_buckets(texts, buckets, longest)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    _shared.bounded(docs.sparkSession)
    told = docs.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in told.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed shares' ratio, floored, for each bucket."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """key, n_words, n_features and weight of every row; the gains go to the tasks, their number is that of the buckets."""

    def run(batches):
        for batch in batches:
            for part, texts in _shared.slices(batch, "text", SLICE):
                found, rows, n_words = feature_buckets(texts, len(gain), longest)
                n = len(texts)
                many = np.bincount(rows, minlength=n).astype(np.int64)
                sums = np.bincount(rows, weights=gain[found], minlength=n).astype(np.int64)  # exact: whole numbers below 2**53
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(many), pa.array(np.where(many > 0, sums // np.maximum(many, 1), 0))], ["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    _shared.bounded(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long").withColumnRenamed("key", key)


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, from the SHA-256 of seed and key."""
    spelled = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(spelled.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, key: str = "doc_id") -> DataFrame:
    """Adds rank (1, 2, ... from the highest score, ties to the smaller key; null where a row isn't drawn) to rows with n_words
    and score: floor(percent * N / 100) of the N rows with enough words are drawn. Rows are counted by score first, which has
    few values; only rows of scores that can be drawn are ordered, each score by itself."""
    fit = F.col("n_words") >= least_words
    counts = scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    levels = counts.select(F.col("score").alias("_score"), (F.sum("_n").over(Window.orderBy(F.desc("score"))) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    levels = levels.withColumn("_drawn", F.expr(f"_all * {int(percent)} div 100")).where("_before < _drawn")
    # scores are whole numbers within some 120,000: the broadcast side is bounded whatever the table's size
    joined = scored.join(F.broadcast(levels), fit & (F.col("score") == F.col("_score")), "left")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col(f"`{key}`")))
    chosen = joined.where("_score IS NOT NULL").withColumn("rank", place)
    chosen = chosen.withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank")).cast("long"))
    rest = joined.where("_score IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return chosen.unionByName(rest).drop("_score", "_before", "_all", "_drawn")


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every row of docs; target has a column of the same name `text`."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, text, buckets, longest))
    scored = weigh(docs, gain, key, text, longest).withColumn("score", (F.col("weight") + noise(F.col(f"`{key}`"), seed)).cast("long"))
    return ranked(_shared.materialize(scored, "importance"), percent, least_words, key)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of docs with their own columns. Rows that share a key share their noise, and are rows of their own."""
    rows = _shared.wrapped(docs, id=F.struct(F.col(f"`{key}`").alias("key"), F.monotonically_increasing_id().alias("own")), text=F.col(f"`{text}`"))
    rows = _shared.materialize(rows, "rows")
    scored = weigh(rows, gains(bucket_counts(rows), bucket_counts(target, text)), "id").withColumn("score", (F.col("weight") + noise(F.col("id.key"), seed)).cast("long"))
    drawn = ranked(_shared.materialize(scored, "importance"), percent, least_words, "id").where("rank IS NOT NULL").select("id.own")
    return _shared.unwrapped(rows.withColumn("own", F.col("id.own")).join(drawn, "own"), docs.columns)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
