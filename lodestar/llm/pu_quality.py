"""A quality classifier by positive-unlabelled learning: the non-negative unbiased risk, minimised on hashed features.

Trusted positives are labelled rows of quality 1; unlabelled text is all text outside the held-out rows. With the class
prior p the risk of a scorer g under the logistic loss is
p R+(g, positives) + max(0, R-(g, unlabelled) - p R-(g, positives)): the second part estimates the loss on negatives and
is not let under zero (when it is, the step goes against it).

The prior comes from positives and unlabelled text alone, by best-bin estimation: of a first scorer's thresholds, that one
is taken whose share of unlabelled text over it, divided by the share of positives that the scorer has not seen, has the
least upper confidence bound. Negative labels are not used at all.

Features are computed once and written (a byte for each pair of bytes, 2112 bytes a row). A start is fitted on bounded
samples; then the risk of all unlabelled rows is minimised, its gradient summed over the whole table in every step.

Features of a whole text: frequencies of byte pairs hashed to 2048 places, and counts of words, lines and kinds of
characters. Labels, lang, source and id are no features.

Defined results: null and empty texts get a score like any other; a null id counts as the id '' for the split; repeated
and tied rows get equal scores for equal texts; labels that are null or missing only mean that a row is unlabelled;
without positives every score is the prior (0.5); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import _shared
from lodestar.llm._kernels import U, grams, mix, span_hashes, words

PLACES = 2048
#: Labelled positives that the fit takes, at most, and unlabelled rows of its start: those with the least hashes of their ids.
SAMPLE = 6000
STEPS, RATE = 200, 0.03
#: Steps over all unlabelled rows.
WHOLE_STEPS, WHOLE_RATE = 6, 0.003
#: Thresholds of the prior's estimate, its confidence, and task sums that are added up before they go to the driver.
BINS, GAMMA, DELTA, FAN_IN = 1000, 0.01, 0.1, 512
#: The risk swings between its two branches; the weights of so many last steps are averaged.
AVERAGED = 100
#: Standardised features are cut at so many deviations; L2 on the weights of byte pairs and of the others.
CLIP, DECAY_PAIRS, DECAY_DENSE = 3.0, 3e-2, 1e-4
THRESHOLD = 0.7

_KINDS = np.zeros((8, 256), bool)
_KINDS[0, 65:91] = True
_KINDS[1, 97:123] = True
_KINDS[2, 48:58] = True
_KINDS[3, 128:] = True
_KINDS[4, [10, 13]] = True
_KINDS[5, [9, 32]] = True
_KINDS[6, [44, 46]] = True
_KINDS[7] = ~_KINDS[:7].any(axis=0)


def pair_places(data: np.ndarray) -> np.ndarray:
    pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
    return _PLACE_OF[pairs]


_PLACE_OF = (mix(np.arange(1 << 16, dtype=np.uint64)) % U(PLACES)).astype(np.int32)


def dense(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of kinds of bytes and what words and lines repeat, for each row."""
    n, size = len(texts), np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    whole = np.maximum(size, 1)
    starts, ends, where = words(data, offsets)
    count = np.bincount(where, minlength=n)
    hashes = span_hashes(data, starts, ends)
    def own(h: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Distinct hashes of each row."""
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=n)

    kinds = [np.bincount(row, weights=k[data], minlength=n) / whole for k in _KINDS]
    three, at = grams(hashes, where, 3)
    repeats = 1 - own(hashes, where) / np.maximum(count, 1)
    repeats3 = 1 - own(three, at) / np.maximum(np.bincount(at, minlength=n), 1)
    length = np.bincount(where, weights=ends - starts, minlength=n) / np.maximum(count, 1)
    return np.stack([*kinds, np.log1p(count), np.minimum(length, 40) / 10, repeats, repeats3, repeats3 > 0.3, repeats3 > 0.1, np.sqrt(np.minimum(kinds[7], 1)), kinds[7] > 0.05], axis=1).astype(np.float32)


DENSE = 16


#: A share's square root is kept as a byte, up to a half.
UNIT, WIDTH = 510, PLACES + 4 * DENSE


def stored(texts: pa.Array) -> np.ndarray:
    """Features of each text as bytes: pairs, then the dense ones in single precision."""
    data, offsets = _shared.buffers_of(texts)
    out = np.zeros((len(texts), WIDTH), np.uint8)
    out[:, PLACES:] = dense(texts, data, offsets).astype("<f4").view(np.uint8).reshape(len(texts), -1)
    for k in range(len(texts)):
        own = data[offsets[k] : offsets[k + 1]]
        if len(own) > 1:
            out[k, :PLACES] = np.minimum(255, np.rint(np.sqrt(np.bincount(pair_places(own), minlength=PLACES) / (len(own) - 1)) * UNIT))
    return out


def read(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows[:, :PLACES].astype(np.float32) / np.float32(UNIT), np.ascontiguousarray(rows[:, PLACES:]).view("<f4")], axis=1)


def matrix_of(column: pa.Array) -> np.ndarray:
    return read(_shared.buffers_of(column)[0].reshape(-1, WIDTH))


def features(texts: pa.Array) -> np.ndarray:
    return read(stored(texts))


def feature_table(docs: DataFrame) -> DataFrame:
    """docs: text and columns to carry; the written table of those columns and `x`."""
    carried = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part, texts in _shared.slices(batch, "text", 1 << 20, 1000):
                x = pa.array([r.tobytes() for r in stored(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in carried), x], [*carried, "x"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), "x binary"])
    return _shared.materialize(docs.mapInArrow(run, schema), "features")


class Adam:
    def __init__(self, n: int, rate: float = RATE):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -CLIP, CLIP)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def negative_sums(x: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Of standardised rows: the sums of the loss as a negative, of its gradient by weights and by bias, and their number."""
    z = (x @ w.astype(np.float32)).astype(np.float64) + b
    slope = sigmoid(z)
    return np.concatenate([[np.logaddexp(0, z).sum()], x.T @ slope.astype(np.float32), [slope.sum(), len(x)]])


def risk(positive: np.ndarray, unlabelled, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk and the direction to go against. positive: standardised rows; unlabelled: negative_sums of
    any number of rows, as a function of the scorer."""
    u = unlabelled(w, b)
    u = u[:-1] / max(u[-1], 1)
    p = negative_sums(positive, w, b)
    p = prior * p[:-1] / p[-1]
    z = (positive @ w.astype(np.float32)).astype(np.float64) + b
    slope = -prior * sigmoid(-z) / len(z)
    own = np.append(positive.T @ slope.astype(np.float32), slope.sum())
    loss, negative = prior * np.logaddexp(0, -z).mean(), u[0] - p[0]
    if negative < 0:  # step against the overfitted part
        return loss, p[1:] - u[1:]
    return loss + negative, own + u[1:] - p[1:]


def descend(positive: np.ndarray, unlabelled, w: np.ndarray, b: float, prior: float, steps: int, rate: float = RATE) -> tuple[np.ndarray, float]:
    decay = np.append(np.where(np.arange(len(w)) < PLACES, DECAY_PAIRS, DECAY_DENSE), 0.0)
    adam, total, averaged = Adam(len(w) + 1, rate), np.zeros(len(w) + 1), min(AVERAGED, steps)
    now = np.append(w, b)
    for step in range(steps):
        direction = risk(positive, unlabelled, now[:-1], now[-1], prior)[1]
        now = now - adam.step(direction + decay * now)
        if step >= steps - averaged:
            total += now / averaged
    return total[:-1], float(total[-1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> dict:
    """Weights of the linear scorer that minimises the non-negative risk of two matrices, on standardised features."""
    if mean is None or scale is None:
        mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    p, u = standard(positive, mean, scale), standard(unlabelled, mean, scale)
    w, b = descend(p, lambda w, b: negative_sums(u, w, b), np.zeros(p.shape[1]), float(np.log(prior / (1 - prior))), prior, steps)
    return {"w": w.astype(np.float32), "b": b, "mean": mean, "scale": scale, "prior": prior}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    return sigmoid((standard(x, model["mean"], model["scale"]) @ model["w"] + np.float32(model["b"])).astype(np.float64))


def best_bin(positive: np.ndarray, counts: np.ndarray) -> float:
    """The class prior from the scores of positives that the scorer has not seen and the counts of unlabelled rows by bins
    of their scores."""
    n_p, n_u = len(positive), counts.sum()
    over_u = np.cumsum(counts[::-1])[::-1] / n_u
    over_p = np.cumsum(np.bincount(np.minimum((positive * len(counts)).astype(int), len(counts) - 1), minlength=len(counts))[::-1])[::-1] / n_p
    slack = np.sqrt(np.log(4 / DELTA) / (2 * n_u)) + np.sqrt(np.log(4 / DELTA) / (2 * n_p))
    bound = np.where(over_p > 0, (over_u + (1 + GAMMA) * slack) / np.maximum(over_p, 1e-12), np.inf)
    at = int(bound.argmin())
    return float(min(max(over_u[at] / over_p[at], 0.01), 0.99))


def summed(table: DataFrame, sums) -> np.ndarray:
    """sums(matrix), a vector of numbers, added up over all rows: in each task, then by groups of tasks, then here."""

    def run(batches):
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                own = sums(matrix_of(batch.column(0).slice(k, 2000)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // FAN_IN], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "v"])

    add = lambda column: np.sum([np.frombuffer(v.as_py()) for v in column], axis=0)
    parts = table.select("x").mapInArrow(run, "part long, v binary").groupBy("part").applyInArrow(lambda t: pa.table({"v": pa.array([add(t.column("v")).tobytes()], pa.binary())}), "v binary")
    with _shared.cleaned(table.sparkSession):
        found = [np.frombuffer(r.v) for r in parts.collect()]
    return np.sum(found, axis=0) if found else np.zeros(1)


def held_out(key, modulus: int = 4, rest: int = 2):
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus == rest


def sample(table: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of the rows with the least id hashes, at most so many: a bounded matrix on the driver."""
    chosen = ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = table.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "x").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").select("x").toArrow()
    return matrix_of(found.column("x").combine_chunks()) if found.num_rows else np.empty((0, PLACES + DENSE), np.float32)


def train(table: DataFrame, labels: DataFrame, most: int = SAMPLE, prior: float | None = None, whole_steps: int = WHOLE_STEPS) -> dict:
    """table: doc_id and x of the rows that may be learned from; labels: doc_id and quality of the same. Of the labels only
    quality 1 counts, at most `most` rows of it; the risk is that of all rows of the table."""
    good = labels.select(F.col("doc_id").cast("long"), "quality").where("doc_id IS NOT NULL AND quality = 1")
    positive = sample(table, good, most)
    start = sample(table, table, most) if len(positive) > 1 else positive
    if len(positive) < 2 or not len(start):
        p, flat = prior or 0.5, np.zeros(PLACES + DENSE, np.float32)
        return {"w": flat, "b": float(np.log(p / (1 - p))), "mean": flat, "scale": flat + 1, "prior": p}
    moments = summed(table, lambda x: np.concatenate([x.sum(axis=0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(axis=0), [len(x)]]))
    n, d = moments[-1], PLACES + DENSE
    mean = (moments[:d] / n).astype(np.float32)
    scale = (np.sqrt(np.maximum(moments[d:-1] / n - (moments[:d] / n) ** 2, 0)) + 1e-3).astype(np.float32)
    if prior is None:
        first = fit(positive[::2], start, 0.5, STEPS, mean, scale)
        counts = summed(table, lambda x: np.bincount(np.minimum((scores(x, first) * BINS).astype(int), BINS - 1), minlength=BINS).astype(np.float64))
        prior = best_bin(scores(positive[1::2], first), counts)
    model = fit(positive, start, prior, STEPS, mean, scale)
    whole = lambda w, b: summed(table, lambda x: negative_sums(standard(x, mean, scale), w, b))
    w, b = descend(standard(positive, mean, scale), whole, model["w"].astype(np.float64), model["b"], prior, whole_steps, WHOLE_RATE) if whole_steps else (model["w"], model["b"])
    return model | {"w": w.astype(np.float32), "b": b}


def score_table(table: DataFrame, model: dict) -> DataFrame:
    """Adds `score` to a table of features, in place of x."""
    carried = [c for c in table.columns if c != "x"]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in carried), pa.array(scores(matrix_of(part.column(part.schema.get_field_index("x"))), model))], [*carried, "score"])

    return table.mapInArrow(run, ", ".join([*(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in carried), "score double"]))


def score(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """docs: key, text and columns to carry; adds `score`. One narrow stage, without the text."""
    carried = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for part, texts in _shared.slices(batch, "text", 1 << 20, 1000):
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in carried), pa.array(scores(features(texts), model))], [*carried, "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried), "score double"])
    return docs.mapInArrow(run, schema)


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    labels = _shared.table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    table = feature_table(docs)
    model = train(table.where("NOT held_out"), labels)
    return score_table(table, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).select("doc_id", "held_out", "score", "predicted")
