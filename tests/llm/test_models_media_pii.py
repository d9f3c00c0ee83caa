import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from lodestar.llm import feistel_pii, kneser_ney, matroska, pu_quality
from tests.llm.conftest import prose


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney(spark, docs, order):
    rows = kneser_ney.split(docs)
    model = kneser_ney.train(rows.where("NOT held_out"), order, shard_bytes=4000)
    got = kneser_ney.score(rows, model).collect()
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    split = lambda t: ["<s>"] * (order - 1) + t.encode().translate(lower).split() + ["</s>"]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    train = [split(t) for k, t in texts if not held(k)]
    words = Counter(w for x in train for w in x if w != "<s>")
    n, v = sum(words.values()), len(words)
    counts = {order: Counter(tuple(x[i - order + 1 : i + 1]) for x in train for i in range(order - 1, len(x)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d, ctx = {}, {}
    for k, c in counts.items():
        d[k] = kneser_ney.discounts({f"n{j}": sum(1 for x in c.values() if x == j) for j in (1, 2, 3, 4)})
        ctx[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, x in c.items():
            ctx[k][g[:-1]][0] += x
            ctx[k][g[:-1]][min(x, 3)] += 1

    def p(g, k):
        if not k:
            return 1 / (v + 1)
        x = ctx[k].get(g[:-1])
        if not x:
            return p(g[1:], k - 1)
        c = counts[k].get(g, 0)
        return (max(c - (d[k][min(c, 3) - 1] if c else 0), 0) + sum(a * b for a, b in zip(d[k], x[1:])) * p(g[1:], k - 1)) / x[0]

    want = Counter()
    for k, t in texts:
        x = split(t)
        score = sum(math.log10(p(tuple(x[i - order + 1 : i + 1]), order)) for i in range(order - 1, len(x)))
        own = [w for w in x if w != "<s>"]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        want[k, held(k), len(own), sum(w in words for w in own), n, round(base, 6), round(score, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


def test_kneser_ney_without_text(spark, docs, empty):
    rows = kneser_ney.split(docs)
    model = kneser_ney.train(rows.limit(0))
    assert all(r.score <= 0 for r in kneser_ney.score(rows, model).collect())
    assert kneser_ney.score(kneser_ney.split(empty), model).count() == 0


def test_pu_quality(spark, empty):
    rng = random.Random(4)
    good = [prose(rng, rng.randint(30, 200)) for _ in range(260)]
    bad = [" ".join(w + rng.choice(["***", "###", "%%%"]) for w in prose(rng, rng.randint(30, 200)).split()) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(good + bad)] + [(None, "x"), (5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 260)) for k in range(300) if k % 2] + [(None, 1), (7, None)], "doc_id long, quality int")
    table = pu_quality.feature_table(docs)
    learn = table.where(~pu_quality.held_out(table.doc_id))
    model = pu_quality.train(learn, labels.where(~pu_quality.held_out(labels.doc_id)))
    score = {r.doc_id: r.score for r in pu_quality.score(docs.na.fill("", ["text"]), model).collect()}
    assert {r.doc_id: r.score for r in pu_quality.score_table(table, model).collect()} == score
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = [(score[k] >= 0.7) == (k < 260) for k in held]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == len(rows)
    flat = pu_quality.train(learn, labels.limit(0))
    assert {round(r.score, 6) for r in pu_quality.score(docs.na.fill("", ["text"]), flat).collect()} == {0.5}
    assert pu_quality.score_table(pu_quality.feature_table(empty.select("doc_id", "text")), model).count() == 0
    clashes = docs.selectExpr("doc_id", "text", "1 AS score_", "2 AS n", "3 AS part", "4 AS key")
    assert {r.doc_id: r.score for r in pu_quality.score_table(pu_quality.feature_table(clashes), model).collect()} == score


def test_risk_and_its_gradient_by_brute_force(spark):
    """The sums over a table against single rows, and the direction against differences of the risk."""
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 40)) + ("***" if k % 3 else "") for k in range(40)]
    table = pu_quality.feature_table(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3))
    x = pu_quality.features(pa.array(texts)).astype(np.float64)
    w = np.random.default_rng(3).standard_normal(x.shape[1]) * 0.05
    got = pu_quality.summed(table, lambda m: pu_quality.negative_sums(m, w, 0.3))
    z = [float(r @ w + 0.3) for r in x]
    assert got[-1] == 40 and got[0] == pytest.approx(sum(math.log1p(math.exp(v)) for v in z), rel=1e-4)
    assert got[-2] == pytest.approx(sum(1 / (1 + math.exp(-v)) for v in z), rel=1e-4)
    assert got[1:-2] == pytest.approx(sum(r / (1 + math.exp(-v)) for r, v in zip(x, z)), rel=1e-3, abs=1e-4)
    for prior in (0.3, 0.95):  # the second part over and under zero
        part = lambda w, b: pu_quality.negative_sums(x, w, b)
        loss, direction = pu_quality.risk(x[:10], part, w, 0.3, prior)
        def parts(w, b):
            zp, zu = x[:10] @ w + b, x @ w + b
            return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        good, negative = parts(w, 0.3)
        assert loss == pytest.approx(good + max(0, negative), rel=1e-4)
        whole = (lambda w, b: sum(parts(w, b))) if negative >= 0 else (lambda w, b: -parts(w, b)[1])
        for k in (0, 7, 2050, 2060):
            e = np.zeros(len(w))
            e[k] = 1e-4
            assert direction[k] == pytest.approx((whole(w + e, 0.3) - whole(w - e, 0.3)) / 2e-4, rel=2e-2, abs=2e-5)
        assert direction[-1] == pytest.approx((whole(w, 0.3001) - whole(w, 0.2999)) / 2e-4, rel=2e-2, abs=2e-5)


def test_prior_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(6)
    for share in (0.2, 0.5, 0.85):
        good = lambda n: 1 / (1 + np.exp(-rng.normal(2, 1, n)))
        bad = 1 / (1 + np.exp(-rng.normal(-2, 1, 20000 - int(20000 * share))))
        counts = np.histogram(np.concatenate([good(int(20000 * share)), bad]), pu_quality.BINS, (0, 1))[0]
        assert pu_quality.best_bin(good(3000), counts.astype(float)) == pytest.approx(share, abs=0.06)


def test_nonnegative_risk_is_kept():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, pu_quality.PLACES + pu_quality.DENSE)).astype(np.float32)
    x[:, 20:] = 0
    x[:300, 0] += 3
    model = pu_quality.fit(x[:100], x[100:], 0.66)
    z = pu_quality.standard(x, model["mean"], model["scale"]) @ model["w"] + model["b"]
    assert np.median(z[:300]) > np.quantile(z[300:], 0.9)


@pytest.mark.parametrize("size", [64, 1024, 1088, 8256, 65600, 200000])
def test_matroska_round_trip(size):
    payload = random.Random(size).randbytes(size // 64 * 64)
    found = matroska.parse(matroska.mux(payload))
    data = matroska.mux(payload)
    assert found["error"] is None
    assert b"".join(data[s : s + n] for _, _, s, n, *_ in found["packets"]) == payload
    assert [p[1] for p in found["packets"]] == [128_000_000 * k for k in range(len(found["packets"]))]
    assert all(matroska.number(data, c[2], c[2] + 4) == matroska.CLUSTER for c in found["cues"]) and len(found["cues"]) == found["clusters"]


@pytest.mark.parametrize("kind", [matroska.XIPH, matroska.EBML_LACING])
def test_lacing(kind):
    rng = random.Random(kind)
    for _ in range(100):
        frames = [rng.randbytes(rng.choice([0, 1, 254, 255, 256, 3000, 70000])) for _ in range(rng.randint(2, 9))]
        body = matroska.lace(frames, kind)
        assert matroska.lacing_sizes(body, 0, len(body), kind)[0] == [len(x) for x in frames]


def test_matroska_unknown_sizes_groups_and_damage():
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, b"\x81\x00\x05\x00abc") + matroska.uint(matroska.REFERENCE, 1))
    body = matroska._TRACKS + b"\x1f\x43\xb6\x75\xff" + matroska.uint(matroska.CLUSTER_TIME, 10) + group + b"\x1f\x43\xb6\x75\xff" + matroska.uint(matroska.CLUSTER_TIME, 20) + matroska.element(matroska.SIMPLE_BLOCK, b"\x81\x00\x00\x80xy")
    data = matroska._HEAD + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + body
    found = matroska.parse(data)
    assert found["error"] is None
    assert [(p[1] // 10**6, data[p[2] : p[2] + p[3]], p[7]) for p in found["packets"]] == [(15, b"abc", False), (20, b"xy", True)]
    whole = matroska.mux(bytes(64 * 200))
    for k in range(1, len(whole), 997):
        matroska.parse(whole[:k])
        matroska.parse(whole[:k] + b"\xff" * 20 + whole[k + 20 :])


def test_matroska_tables(spark, docs, clashing, empty):
    files = matroska.store(docs)
    rows = matroska.digest(files).collect()
    assert len(rows) == docs.count() and all(r.payload_bytes == max(64, -(-r.n_bytes // 64) * 64) for r in rows)
    packets = matroska.packet_table(files, "doc_id", "media")
    assert packets.where("error IS NOT NULL").isEmpty() and packets.agg({"length": "sum"}).first()[0] == sum(r.payload_bytes for r in rows)
    assert matroska.cue_table(files, "doc_id", "media").count() >= len(rows)
    assert matroska.digest(matroska.store(clashing)).count() == len(rows) and matroska.digest(matroska.store(empty)).count() == 0


def test_counts_beyond_16_bits_only(spark):
    """One word, repeated: all values of a shard's table stand beside its book of frequent ones, which is empty."""
    n = 200_000
    docs = spark.createDataFrame([(1, "a " * n), (2, "a a b")], "doc_id long, text string").withColumn("held_out", F.lit(False))
    model = kneser_ney.train(docs.where("doc_id = 1"), 2, 2 * n // 7 + 1)
    assert model["shards"] == 7
    one, two = kneser_ney.score(docs, model).orderBy("doc_id").collect()
    assert (one.n_tokens, one.n_known, two.n_tokens, two.n_known) == (n + 1, n + 1, 4, 3)
    # a after a: its count less the discount, and the rest's share by the continuations, of which a has two of three
    assert 0 > one.score > -30 and one.score > two.score
    for shard in range(7):
        table = kneser_ney.Table(model["folder"], f"gram2-{shard}")
        if table.n:
            assert len(table.find(np.array([], np.uint64))[0]) == 0


TEXTS = ["card 4111 1111 1111 1111 and 4111111111111111, bad 4111111111111112 end", "mail a.b1@x.example.com!", "GB82 WEST 1234 5698 7654 32 x DE89370400440532013000", "ip 10.0.0.1 999.1.1.1", "on 2024-02-29 or 2023-02-29", "ssn 123-45-6789 000-12-3456", "+1 (017) 555-7713", '"9b0b3c6a43eb78aa99cbd7049c572391524f37a8"', "", None, "year 2024 v1.2"]


def luhn(digits):
    return not sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10


def test_pseudonyms(spark, docs, clashing, empty):
    df = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    out = {r.doc_id: r for r in feistel_pii.pseudonymise(df, 'k').collect()}
    assert [out[k]._n_values for k in range(len(TEXTS))] == [2, 1, 2, 1, 1, 1, 1, 1, 0, 0, 0]
    one, two = re.search(r"card (.*) and (\d+), bad (\d+)", out[0].text).groups()[:2]
    assert one.replace(" ", "") == two != "4111111111111111" and luhn(two) and "4111111111111112" in out[0].text
    iban = out[2].text.split(" x ")[1]
    assert iban[:2] == "DE" and len(iban) == 22 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4} 000-12-3456", out[5].text) and re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", out[6].text)
    assert out[9].text is None and out[10].text == TEXTS[10]
    assert feistel_pii.replace_pii(clashing, 'k').columns == clashing.columns and feistel_pii.replace_pii(empty, 'k').count() == 0
    assert feistel_pii.replace_pii(docs, 'k').count() == docs.count()


def test_hexadecimal_keys_without_digit_pairs(spark):
    keys = ["a1b2c3d4e5f6" * 3, "A1B2C3D4E5F6" * 3, "abcdef" * 6]
    docs = spark.createDataFrame([(k, f"the key {x} is secret") for k, x in enumerate(keys)], "doc_id long, text string")
    for r in feistel_pii.pseudonymise(docs, 'k').collect():
        assert r._n_values == 1 and keys[r.doc_id] not in r.text


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    three = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = {r.p for r in three.select(feistel_pii.permute_digits(F.col("d"), "k", "t").alias("p")).collect()}
    assert got == {f"{k:03}" for k in range(1000)}
    dates = spark.range(3000).select(F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = [r.p for r in dates.select(feistel_pii.pseudonym(F.col("d"), "k").alias("p")).collect()]
    assert len(set(moved)) == 3000 and all(re.fullmatch(r"\d{4}-\d\d-\d\d", x) for x in moved)


def undone(text, key, kind, radix=10, tweak=""):
    """The permutation of a digit string, taken back round by round."""

    def back(a, b, size_a, size_b, kind):
        part = lambda k, x: int(hashlib.sha256(f"{key}|{kind}|{k}|{tweak}|{size_a}|{size_b}|{x}".encode()).hexdigest()[:14], 16)
        for k in reversed(range(feistel_pii.ROUNDS)):
            a, b = ((a - part(k, b)) % size_a, b) if k % 2 == 0 else (a, (b - part(k, a)) % size_b)
        return a, b

    spell = lambda n, width: "".join("0123456789abcdefghijklmnopqrstuvwxyz"[n // radix**k % radix] for k in reversed(range(width)))
    if len(text) == 1:
        size_a, size_b = feistel_pii.SINGLE[radix]
        n = radix
        place = int(text, radix)
        while n >= radix:
            a, b = back(place // size_b, place % size_b, size_a, size_b, f"{kind}-one")
            n = place = a * size_b + b
        return spell(n, 1)
    half = len(text) // 2
    a, b = back(int(text[:half] or "0", radix), int(text[half:] or "0", radix), radix**half, radix ** (len(text) - half), kind)
    return spell(a, half) + spell(b, len(text) - half)


def test_pseudonyms_can_be_taken_back(spark):
    """Brute force: every value comes back with the key, in its own format, and not with another key."""
    from pyspark.sql import functions as F

    mails = [f"{a}.{n}@mail{n}.{b}.com" for a in ("hein", "ann-lee", "q") for n in range(9) for b in ("example", "corp.test")] + [f"x{n}@z.com" for n in range(10)] + [f"{a}@9.com" for a in "abcdefg"]
    cards = ["4111111111111111", "5500005555555559", "340000000000009"]
    ibans = ["GB82WEST12345698765432", "DE89370400440532013000", "NL91ABNA0417164300"]
    rows = spark.createDataFrame([(x,) for x in mails + cards + ibans], "x string")
    got = {r.x: r.p for r in rows.select("x", feistel_pii.pseudonym(F.col("x"), "k").alias("p")).collect()}
    assert len(set(got.values())) == len(got)
    pick = lambda x, kind: "".join(c for c in x if re.match(kind, c))
    to_number = str.maketrans(feistel_pii._LETTERS, feistel_pii._AS_NUMBERS)
    for x, y in got.items():
        shape = lambda v: re.sub("[a-z]", "a", re.sub("[0-9]", "0", v))
        if "@" in x:
            assert shape(x) == shape(y) and y.endswith(".com") and x != y
            head, was = y.rpartition(".")[0], x.rpartition(".")[0]
            masked = re.sub("[0-9]", "0", x)
            assert undone(pick(head, "[0-9]"), "k", "email-digits", tweak=masked) == pick(was, "[0-9]")
            assert undone(pick(head, "[a-z]").translate(to_number), "k", "email", 26) == pick(was, "[a-z]").translate(to_number)
        elif x[0].isdigit():
            assert luhn(y) and undone(y[:-1], "k", "card") == x[:-1]
        else:
            assert re.sub("[A-Z]", "A", re.sub("[0-9]", "0", x)) == re.sub("[A-Z]", "A", re.sub("[0-9]", "0", y)) and x[:2] == y[:2]
            assert int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1
            assert undone(pick(y[4:], "[0-9]"), "k", "iban") == pick(x[4:], "[0-9]")
            if letters := pick(y[4:], "[A-Z]").lower():
                assert undone(letters.translate(to_number), "k", "iban-letters", 26) == pick(x[4:], "[A-Z]").lower().translate(to_number)
    ten = [(int(got[f"x{n}@z.com"][1]) - n) % 10 for n in range(10)]
    assert len(set(ten)) > 2 and sum(undone(pick(y, "[0-9]"), "other", "email-digits", tweak=re.sub("[0-9]", "0", x)) != pick(x, "[0-9]") for x, y in got.items() if "@mail" in x) > 25
    with pytest.raises(ValueError):
        feistel_pii.pseudonymise(rows.withColumnRenamed("x", "text"), "")


def test_single_digits_and_letters_are_no_shift(spark):
    """Each radix's single digits are permuted, and for most keys and tweaks not by a constant."""
    from pyspark.sql import functions as F

    for radix in (10, 16, 26):
        digits = "0123456789abcdefghijklmnop"[:radix]
        rows = spark.createDataFrame([(c, t) for c in digits for t in ("", "one", "two")], "d string, t string")
        got = rows.select("d", "t", feistel_pii.permute_digits(F.col("d"), "k", "s", radix, F.col("t")).alias("p")).collect()
        shifts = []
        for t in ("", "one", "two"):
            own = {r.d: r.p for r in got if r.t == t}
            assert sorted(own.values()) == sorted(digits) and all(undone(v, "k", "s", radix, t) == k for k, v in own.items())
            shifts.append(len({(int(v, 36) - int(k, 36)) % radix for k, v in own.items()}))
        assert min(shifts) > 2


def test_long_runs_take_linear_time(spark):
    """Addresses of thousands of labels, and texts of 20 MB without white space, neither overflow a stack nor take long."""
    run = "k" * 20_000_000
    texts = ["see a@" + "b." * 3000 + "com", "see a@" + "b." * 100_000 + "com", "see a@" + "bc." * 100_000 + "com x", "a." * 100_000 + "@x.com", run, f"{run}@host.com", f"me@{run}.com", "." * 3_000_000 + "Bob1@x.com", "..bob1@x.com bob1@x.com", "g" * 31 + "9" * 3_000_000 + "g", "a@" * 500_000, "é@" * 200_000]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    began = time.time()
    out = {r.doc_id: r for r in feistel_pii.pseudonymise(docs, "k").collect()}
    assert time.time() - began < 90
    assert [out[k]._n_values for k in range(len(texts))] == [0, 0, 1, 0, 0, 0, 0, 1, 2, 0, 0, 0]
    assert out[2].text.endswith("bc.com x") and out[7].text[:3_000_000] == "." * 3_000_000 and len(out[7].text) == len(texts[7])
    lone, = re.findall(r"\.\.(.*) ", out[8].text)
    assert out[8].text == f"..{lone} {lone}" and out[7].text.endswith(lone)


def test_phones_keep_their_country(spark):
    from pyspark.sql import functions as F

    phones = ["+1 (743) 555-3824", "+49 30 1234 5678", "+353 12 234 5678", "+442079460123", "(212) 555-0100"]
    got = [r.p for r in spark.createDataFrame([(x,) for x in phones], "x string").select(feistel_pii.pseudonym(F.col("x"), "k").alias("p")).collect()]
    assert [x[:k] for x, k in zip(got, (3, 4, 5, 3, 1))] == ["+1 ", "+49 ", "+353 ", "+44", "("]
    assert all(re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) and a != b for a, b in zip(got, phones))


def test_op6_uses_the_keys_of_the_session(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (str(r.doc_id), str(r.text))
    spark.conf.set(feistel_pii.KEY_SETTING, "one")
    out = sorted(feistel_pii.op6_feistel_pii(spark, str(tmp_path)).collect(), key=key)
    assert [(r.doc_id, r.text) for r in out] == [(r.doc_id, r.text) for r in sorted(feistel_pii.pseudonymise(docs, "one").collect(), key=key)]
    spark.conf.set(feistel_pii.KEY_SETTING, "two")
    assert out != sorted(feistel_pii.op6_feistel_pii(spark, str(tmp_path)).collect(), key=key)
    spark.conf.unset(feistel_pii.KEY_SETTING)
    drawn = feistel_pii.session_key(spark)
    assert len(drawn) == 64 and feistel_pii.session_key(spark) == drawn
