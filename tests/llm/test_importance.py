import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def features(text):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [" ".join(p) for p in zip(w, w[1:])]]


def by_hand(rows, target, percent=25):
    """[(id, text)] to {place in rows: (n_words, n_features, weight, score)} and the ordered places that are drawn."""
    found = [features(t) for _, t in rows]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for (i, _), (n, f) in zip(rows, found):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((k for k in range(len(rows)) if out[k][0] >= 20), key=lambda k: (-out[k][3], -1 if rows[k][0] is None else rows[k][0]))
    return out, fit[: percent * len(fit) // 100]


def test_buckets_are_those_of_zlib():
    rng = random.Random(3)
    texts = ["", "One", "one  TWO.three", "É日本 x9", "a" * 47 + " " + "b" * 48 + " " + "c" * 49 + " tail", "", "x" * 3_000_000 + " y " + "z" * 200, " ".join(rng.choice(["ab", "Zé", "7", "q" * 60]) for _ in range(500))]
    found, rows, n_words = importance.feature_buckets(pa.array(texts))
    for k, t in enumerate(texts):
        n, want = features(t)
        assert n_words[k] == n and Counter(found[rows == k].tolist()) == Counter(want)
    found, rows, _ = importance.feature_buckets(pa.array(["a b c d"]), 97, 3)
    assert Counter(found.tolist()) == Counter(zlib.crc32(x) % 97 for x in (b"a", b"b", b"c", b"d", b"a b", b"b c", b"c d", b"a b c", b"b c d"))


def test_weights_scores_and_ranks(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = ["the of and to in is on that", None, "", "changed words " * 30]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    want, drawn = by_hand(rows, target)
    got = importance.importance(docs, frame).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want))
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(rows[k][0], want[k][3]) for k in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1)) and drawn


def test_clashing_names_and_empty_tables(spark, docs, clashing, empty):
    target = spark.createDataFrame([("the of and",)], "text string")
    wide = clashing.withColumns({c: F.lit(2) for c in ("score", "weight", "n_words", "_score", "_before", "own", "_row")})
    out = importance.resample(wide, target)
    assert out.columns == wide.columns
    drawn = [r.doc_id for r in importance.importance(docs, target).where("rank IS NOT NULL").collect()]
    assert Counter(r.doc_id for r in out.collect()) == Counter(drawn)
    assert importance.importance(empty, target).count() == 0
    assert importance.importance(docs, empty.select("text")).count() == docs.count()
    none = spark.createDataFrame([(None,), ("",)], "text string")
    assert importance.gains(np.zeros(7, np.int64), importance.bucket_counts(none, buckets=7)).tolist() == [0] * 7


def test_a_target_draws_its_own_kind(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["red", "green", "blue"] if k % 4 == 0 else ["ox", "cow", "hen"]) for _ in range(200))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("red green blue " * 40,)], "text string")
    drawn = [r.doc_id for r in importance.resample(docs, target).collect()]
    assert len(drawn) == 50 and sum(k % 4 == 0 for k in drawn) >= 40


def test_tied_scores_go_by_id(spark):
    """Rows of one score, more than are drawn: the least ids, with ranks without gaps."""
    scored = spark.createDataFrame([(k, 30, 5) for k in range(40)] + [(100 + k, 30, 9) for k in range(3)] + [(200, 3, 99)], "doc_id long, n_words long, score long")
    got = {r.doc_id: r["rank"] for r in importance.ranked(scored).collect()}
    assert {i: p for i, p in got.items() if p} == {100: 1, 101: 2, 102: 3} | {k: 4 + k for k in range(7)}
