import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import collocations

LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_hand(rows, least=10, longest=3, cover=50, top=2000):
    """[(lang, text)] to the operator's rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {k: c for k, c in f.items() if c >= least and len(k[1]) > 1}
    out = {}
    for (lang, p), a in often.items():
        inside = any(100 * c >= cover * a and lang == other and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), c in often.items() if len(q) > len(p))
        if not inside:
            cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        rows += [(lang, k + 1, p, a, left, right, n[lang], score) for k, (score, a, p, left, right) in enumerate(found[:top])]
    return sorted(rows)


def result(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    some = [f"w{k}" for k in range(12)] + ["É", "日本", "A", "a", "New", "York", "city"]
    rows = []
    for k in range(160):
        words = [rng.choice(some) if rng.random() < 0.6 else rng.choice(["new york city", "New York", "strong\ttea", "x y z x y z", "aa"]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), "".join(w + rng.choice([" ", " ", "  ", ", ", ".\n", "\r\n", "; "]) for w in words)))
    return rows + [("en", None), ("en", ""), ("en", " \t."), ("fr", "same same " * 4000), ("xx", "once only"), ("de", "x" * 300_000), *[("fr", "copied row of words")] * 30]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 3000, "shard_bytes": 400}, {"block_bytes": 3000, "shard_bytes": 200, "fan": 3}])
def test_by_hand(spark, rows, sizes):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = by_hand(rows)
    assert len(want) > 30 and result(collocations.collocations(docs, **sizes)) == want


def test_longer_phrases_and_other_limits(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2).withColumns({c: F.lit(1) for c in ("word", "n", "id", "ids", "block", "local", "data", "f", "phrase", "rank")})
    for least, longest, cover, top in ((4, 4, 80, 50), (25, 2, 50, 7)):
        assert result(collocations.collocations(docs, least, longest, cover, top, block_bytes=4000, shard_bytes=1000)) == by_hand(rows, least, longest, cover, top)


def test_groups_are_ranked_as_one(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "RANKED", 4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert result(collocations.collocations(docs, top=1)) == by_hand(rows, top=1)


def test_none(spark, docs, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "no phrase is frequent here")], "lang string, text string")).count() == 0
    assert result(collocations.collocations(docs)) == by_hand([(r.lang, r.text) for r in docs.collect()])


def test_scores_beyond_64_bits(spark):
    """Frequencies of a trillion: the division is exact."""
    rows = [([1], 3_000_000_000_019), ([2], 2_999_999_999_989), ([1, 2], 2_999_999_999_900)]
    got = collocations.scored(spark.createDataFrame(rows, "ids array<long>, f long")).collect()
    assert [(r.a, r.score) for r in got] == [(2_999_999_999_900, 10**6 * 2_999_999_999_900**2 // (3_000_000_000_019 * 2_999_999_999_989))]


def test_packing():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-(1 << 50), 1 << 60, 1000), np.zeros(5, np.int64), np.sort(rng.integers(0, 1 << 40, 77)), np.empty(0, np.int64), np.array([7])]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(columns, collocations.unpack(collocations.pack(*columns))))
    counts, places = np.array([3, 1, 2]), np.array([4, 9, 11, 2, 0, 5])
    got, where, (more,) = collocations.unpack_lists(collocations.pack_lists(counts, places, np.array([5, 6, 7])))
    assert (got == counts).all() and (where == places).all() and more.tolist() == [5, 6, 7]
