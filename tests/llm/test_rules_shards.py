import re
import zlib
from collections import Counter

from lodestar.llm import host_rules, sharding


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, docs, clashing, empty):
    rows = host_rules.judge(docs, carry=["doc_id", "source", "text"]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        n, chars, symbols, lines, repeats = by_hand(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.base_failed and r.kept)
    assert host_rules.filter_documents(docs).count() == sum(r.kept for r in rows)
    assert host_rules.filter_documents(clashing).columns == clashing.columns and host_rules.filter_documents(clashing).count() == sum(r.kept for r in rows)
    assert host_rules.filter_documents(empty).count() == 0


def test_bad_host_goes(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(k, good if k % 10 == 0 else "short", "bad") for k in range(200)] + [(1000 + k, good, f"h{k % 7}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in host_rules.filter_documents(docs).collect()}
    assert kept == {1000 + k for k in range(200)}


def test_good_documents_of_a_bad_host_go(spark):
    """One host of twenty fails far more often than the others: its good documents go with it, all other good ones stay."""
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(100 * h + k, "short" if k < (30 if h == 7 else 5) else good, f"h{h}") for h in range(20) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {k for k, t, h in rows if t == good and h != "h7"}
    assert {r.doc_id for r in host_rules.filter_documents(docs).collect()} == want
    assert {r.doc_id for r in host_rules.judge(docs).where("kept").collect()} == want


def test_hosts_that_differ_by_chance_stay(spark):
    good = " ".join(f"w{k}" for k in range(80))
    rows = [(100 * h + k, "short" if (h * 31 + k * 17) % 7 == 0 else good, f"h{h}") for h in range(20) for k in range(40 + h)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert host_rules.filter_documents(docs).count() == sum(t == good for _, t, _ in rows)


def test_salted_verdicts(spark, monkeypatch):
    monkeypatch.setattr(host_rules, "BROADCAST_HOSTS", -1)
    test_bad_host_goes(spark)


def test_shards(spark, docs, clashing, empty):
    rows = docs.select("doc_id", "text")
    for sizes in ({}, {"bucket_rows": 4}):
        out = sharding.shard_rows(rows, 5, **sizes).collect()
        assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in rows.collect())
        own = Counter(r.shard for r in out)
        assert max(own.values()) - min(own.values()) <= 1
        for s, n in own.items():
            assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert len(sharding.shard_rows(clashing, 5).columns) == len(clashing.columns) + 1  # its own shard column is replaced
    assert sharding.shard_rows(empty, 5).count() == 0


def test_whole_records_are_sharded(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    put, seen = sharding.external_shuffle, []

    def shuffle(rows, *a, **b):
        seen.append(put(rows, *a, **b))
        return seen[-1]

    monkeypatch.setattr(sharding, "external_shuffle", shuffle)
    out = sharding.op3_two_pass_shuffle(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text is None, r.text)
    assert sorted((r for r in seen[0].drop("position").collect()), key=key) == sorted(docs.collect(), key=key)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())


def test_buckets_follow_the_bytes(spark, monkeypatch):
    put, seen = sharding.scatter, []
    monkeypatch.setattr(sharding, "scatter", lambda rows, buckets, seed: seen.append(buckets) or put(rows, buckets, seed))
    rows = spark.range(40).selectExpr("id", "repeat('x', 1000) AS t")
    assert sharding.external_shuffle(rows, 3, bucket_bytes=4096).count() == 40
    assert seen == [11]  # 40 records of 1064 bytes


def test_many_buckets_are_joined_by_shuffle(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id", "'x' AS t")
    broadcast = sorted(tuple(r) for r in sharding.external_shuffle(rows, 3, bucket_rows=4).collect())
    monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", 0)
    out = sharding.external_shuffle(rows, 3, bucket_rows=4)
    assert "Broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == broadcast
    assert sorted(x[-1] for x in broadcast) == list(range(300))


def test_bucket_starts(spark):
    counts = {b: b % 7 + 1 for b in range(0, 90, 2)}
    out = sharding.bucket_starts(spark.createDataFrame(list(counts.items()), "_bucket long, _n long"), 90).collect()
    assert {r._bucket: r._start for r in out} == {b: sum(n for c, n in counts.items() if c < b) for b in counts}


def test_order_is_random(spark):
    rows = spark.range(4000).selectExpr("id", "'x' AS t")
    out = [r.id for r in sharding.external_shuffle(rows, 3, bucket_rows=500).orderBy("position").collect()]
    steps = sum(abs(a - b) for a, b in zip(out, out[1:])) / len(out)
    assert 1200 < steps < 1470  # a third of n for a uniform order
    assert zlib.crc32(b"") == 0
