import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from lodestar.llm import bagminhash, components, suffix_dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes_by_hand(rows, least=0.8):
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {k: (t or "", shingles(t)) for k, t in rows}
    keys = sorted(bags)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            (ta, x), (tb, y) = bags[a], bags[b]
            union = sum((x | y).values())
            if ta == tb or (union and sum((x & y).values()) / union >= least):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def test_classes(spark, docs, clashing, empty):
    rows = {(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect()}
    want = classes_by_hand(rows)
    got = bagminhash.class_table(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    kept = bagminhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == len(set(want.values())) + 1
    assert bagminhash.class_table(empty).count() == 0 and bagminhash.keep_one(empty).count() == 0


def test_null_and_tied_ids_keep_their_classes(spark):
    say = lambda tag, n=60: " ".join(f"{tag}{k}" for k in range(n))
    near = lambda tag: say(tag) + f" {tag}end"
    rows = [(None, say("a")), (None, say("b")), (None, say("b")), (None, near("b")), (None, say("c")), (7, say("d")), (8, near("d")), (7, say("e")), (7, near("e")), (9, near("e")), (7, say("f")), (None, near("f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.text for r in bagminhash.keep_one(docs).collect()]
    assert sorted(x[0] for x in kept) == list("abcdef")
    got = bagminhash.class_table(docs).collect()
    assert len(got) == len(rows) and len({r.class_label for r in got}) == 6
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter({(None, None): 5, (7, 7): 4, (8, 7): 1, (9, 7): 1, (None, 7): 1})
    sizes = Counter(r.class_label for r in got)
    assert sorted(sizes.values()) == [1, 1, 2, 2, 3, 3]


def test_texts_that_share_a_node(spark, monkeypatch):
    """Different texts with the same 64-bit hash are different documents."""
    monkeypatch.setattr(bagminhash, "node_of", lambda text: bagminhash.F.length(bagminhash.F.coalesce(text, bagminhash.F.lit(""))).cast("long"))
    say = lambda tag, n=60: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(1, say("a")), (2, say("b")), (3, say("c")), (4, say("b")), (5, say("c") + " end"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.class_table(docs).collect()} == classes_by_hand(rows)
    assert sorted(r.doc_id for r in bagminhash.keep_one(docs).collect()) == [1, 2, 3, 6]


def test_far_copies_of_one_text(spark):
    """Copies with many edits: some pairs are linked with each other alone, none with the centre."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):
        words = list(base)
        for p in rng.choice(150, rng.integers(0, 9), replace=False):
            words[p] = f"e{k}_{p}"
        rows.append((k, " ".join(words)))
        if k % 4 == 0:
            words[7] = "again"
            rows.append((100 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.class_table(docs).collect()} == classes_by_hand(rows)


def test_signature_estimates_weighted_overlap():
    texts = pa.array(["a b c d e f g h i j " * 3, "a b c d e f g h i j " * 2 + "x y z"])
    row, shingle, count = bagminhash.multisets(texts)
    sig = bagminhash.signatures(row, shingle, count, 2, 4096)
    sets = [(shingle[row == k].tobytes(), count[row == k].astype(np.uint32).tobytes()) for k in (0, 1)]
    assert abs((sig[0] == sig[1]).mean() - bagminhash.weighted_jaccard(*sets[0], *sets[1])) < 0.04


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    found = components.components(links)
    assert {r.node: r.label for r in found.collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    more = components.joined_components(found, spark.createDataFrame([(5, 102), (500, 501)], "a long, b long"))
    assert {r.node: r.label for r in more.collect()} == {**dict.fromkeys([*range(41), 100, 101, 102], 0), 500: 500, 501: 500}


def cut_by_hand(rows):
    seen, out = set(), {}
    for k, texts in sorted(rows.items()):
        new = []
        for text in texts:
            x = (text or "").encode()
            mark = bytearray(len(x))
            for i in range(len(x) - 49):
                if x[i : i + 50] in seen:
                    mark[i : i + 50] = b"\1" * 50
            new += [x[i : i + 50] for i in range(len(x) - 49)]
            spans = sum(1 for i in range(len(x)) if mark[i] and (i == 0 or not mark[i - 1]))
            out[k, text] = (len(x), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(x, mark) if not m)).hexdigest())
        seen.update(new)
    return out


def test_cuts(spark, docs, clashing, empty):
    rows = defaultdict(list)
    for r in docs.collect():
        rows[r.doc_id if r.doc_id is not None else 1 << 62].append(r.text)
    want = Counter(v for (k, t), v in cut_by_hand(rows).items() for _ in range(rows[k].count(t)))
    for shard_bytes in (1 << 20, 2000):
        got = suffix_dedup.cut_digests(docs, shard_bytes).collect()
        assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    left = suffix_dedup.remove_repeats(clashing)
    assert left.columns == clashing.columns and left.count() == docs.count()
    assert suffix_dedup.cut_digests(empty).count() == 0


def test_family_levels_grow_geometrically():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 5000).astype(np.uint8)
    windows = [data[k : k + 50].tobytes() for k in range(len(data) - 49)]
    family, seen = suffix_dedup.SuffixFamily(), set()
    for part in np.array_split(rng.permutation(len(windows)), 50):
        part = np.array(sorted(part, key=lambda k: windows[k]))
        keys = suffix_dedup.Level(data, part).keys(0, len(part))
        assert family.scan(keys).tolist() == [windows[k] in seen for k in part]
        family.add(suffix_dedup.Level(data, part))
        seen.update(windows[k] for k in part)
        assert family.scan(keys).all()
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    whole = family.whole()
    assert [windows[k] for k in whole.places] == sorted(windows)


def test_merge_scan_by_blocks(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 7)
    test_family_levels_grow_geometrically()


def test_batches_equal_one_run(spark, docs):
    """Three batches, one after another in an index that is kept, against one run over all of them."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    spans = lambda df: {(r.own, r.node): tuple(x.tolist() for x in suffix_dedup.union_of(np.array([x.start for x in r.runs]), np.array([x.stop for x in r.runs]))) for r in df.collect()}
    want = spans(suffix_dedup.repeat_spans(rows))
    index, got = suffix_dedup.new_index(spark, 400_000, 100_000), {}
    for low, high in ((0, 12), (12, 18), (18, 100)):
        got |= spans(suffix_dedup.index_batch(rows.where(f"doc_id >= {low} AND doc_id < {high}"), index))
    assert index["batches"] == 3 and want and got == want


def test_hot_probes_and_long_runs(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 40)
    rng = np.random.default_rng(5)
    line = "=" * 80 + " a common line that every document has " + "-" * 30
    rows = [(k, "".join(map(chr, rng.integers(97, 123, 30))) + line + "".join(map(chr, rng.integers(97, 123, rng.integers(0, 90)))) + "x" * int(rng.integers(0, 400))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter(cut_by_hand({k: [t] for k, t in rows}).values())
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_digests(docs, 1000).collect()) == want


def test_probes_are_least_hashes_of_windows():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 4, 400).astype(np.uint8)
    twice = np.concatenate([data, data])
    p = suffix_dedup.window_probes(twice)
    assert len(p) == len(twice) - 49 and (p[: len(data) - 49] == p[len(data) : len(data) + len(data) - 49]).all()
