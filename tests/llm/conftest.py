import random

import pytest

WORDS = "the of and to in is on that by this with you it for are was as be".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing", "tion", "s"]) + rng.choice(WORDS) for _ in range(n))


def odd_texts() -> list:
    """Texts that each operator has to bear: nulls, empties, copies, near copies, shared passages, long ones, odd characters."""
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 60)
    near = base.split()
    near[50] = "changed"
    texts = [prose(rng, rng.randint(5, 150)) for _ in range(12)]
    texts += [None, "", " \n\t", "a", "one two three four", base, base, " ".join(near), f"{prose(rng, 40)}\n{passage}", f"{passage}\n{prose(rng, 30)}"]
    texts += ["x" * 5000, "ab " * 3000, "é" * 300 + "ß 日本語 😀 \x00 \x85 end", f"mail {'a.b'}@mail.example.com card 4111111111111111 on 2024-02-29 ip 10.1.2.3", "For " * 80, "!!! *** ### " * 40]
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 3}" if k % 5 else None, len(t or "")) for k, t in enumerate(odd_texts())]
    rows += [rows[17], rows[17], (None, "no id here " * 20, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("node", "own", "label", "bucket", "rank", "id", "key", "shard", "words", "runs", "_words", "n", "start")})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
