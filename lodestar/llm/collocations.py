"""Collocations: phrases whose words stand together more often than their parts would, from positional inverted lists.

The corpus is cut into blocks of whole texts. A block holds, for each of its words, the ascending places at which it stands
(a vertical list); places are numbered so that neighbours within a piece differ by one and all others by more. A list's
length is its phrase's frequency in the block, the sum over all blocks the exact frequency. Words that are frequent in the
corpus are extended: a phrase's places, moved on by one, are merge-joined with the lists of what stands there (words at first,
then phrases that overlap in all but one word), all lists of a block at once; what meets is the list of a longer phrase.

Lists stay in their blocks. What travels is, for each phrase of a block, its words' numbers and its list's length, packed and
dealt out by the phrase: a shard adds the lengths up, keeps the frequent phrases, and tells the blocks that sent them. A list
that is long enough by itself needs no answer, so phrases that are frequent everywhere are only summed. Rare phrases end
there: only frequent ones are extended. Words are counted as strings and numbered when they are known to be frequent, so
frequencies are exact and no two phrases are taken for one. With more than FAN shards the packed rows take two shuffles, so
that rows stay long whatever the number of shards; a shard holds one entry for each block and phrase at most.

Words: A-Z in lower case; pieces end at [.,;:!?\\x0A-\\x0D], words are [^\\x20\\x09]+ within a piece. Everything is counted by
`lang`. A candidate's score is floor(1000000 a a / (l r)), exact in decimals, for the cut into two phrases that scores lowest,
the first of equals. Candidates that stand in longer candidates for at least `cover` percent of their occurrences are dropped.

Defined results: null texts have no words; a null lang is `und`; repeated rows count as often as they stand; ties in score and
frequency go by the phrase's bytes; an empty table, or one without frequent phrases, gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm import _shared
from lodestar.llm._kernels import LOWER, U, join_hashes, mix, words

LEAST, LONGEST, COVER, TOP = 10, 3, 50, 2000
#: Bytes of text in a block and for each shard; shards that a task deals to at once.
BLOCK_BYTES, SHARD_BYTES, FAN = 4 << 20, 4 << 20, 4096
#: Numbers that are gathered before they are dealt out again.
GATHER = 1 << 20
#: Candidates that are ranked in one group.
RANKED = 100_000
PIECE = np.zeros(256, bool)
PIECE[[ord(c) for c in ".,;:!?"]] = PIECE[0x0A:0x0E] = True
BREAKS = PIECE.copy()
BREAKS[[0x20, 0x09]] = True


# -- columns of numbers as bytes: smaller by their least value, by steps where they ascend, in planes of equal weight


def pack(*columns: np.ndarray) -> bytes:
    heads, planes = [len(columns)], []
    for x in columns:
        x = np.ascontiguousarray(x, np.int64)
        steps = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        low = int(x[0] if steps else x.min()) if len(x) else 0
        x = np.diff(x, prepend=low) if steps else x - low
        size = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
        heads += [len(x), size, int(steps), low]
        planes.append(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(len(x), 8)[:, :size].T).tobytes())
    raw = np.array(heads, "<i8").tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    heads, at, out = np.frombuffer(raw, "<i8", 1 + 4 * count)[1:].reshape(-1, 4), 8 * (1 + 4 * count), []
    for n, size, steps, low in heads.tolist():
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        x = wide.view("<i8").ravel()
        out.append((np.cumsum(x) if steps else x) + low)
        at += n * size
    return out


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """The first place of each distinct key."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)


def pack_lists(counts: np.ndarray, places: np.ndarray, *more: np.ndarray) -> bytes:
    """Lists of ascending places, one after another, as steps within each list."""
    steps = np.diff(places, prepend=0)
    first = np.cumsum(counts) - counts
    steps[first] = places[first]
    return pack(counts, steps, *more)


def unpack_lists(packed: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    counts, steps, *more = unpack(packed)
    first, whole = np.cumsum(counts) - counts, np.cumsum(steps)
    return counts, whole - np.repeat(whole[first] - steps[first], counts), more


# -- a block's lists


def occurrences(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of some texts, as strings told apart exactly, the row of each, and its place."""
    data, offsets = _shared.buffers_of(texts)
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, BREAKS)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    spelled = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data[~BREAKS[data]]))])
    piece = np.searchsorted(np.flatnonzero(PIECE[data]), starts)
    apart = np.concatenate([[False], (rows[1:] != rows[:-1]) | (piece[1:] != piece[:-1])])[: len(starts)]
    return spelled.dictionary_encode(), rows, np.arange(len(starts)) + np.cumsum(apart)


BLOCK_ROWS = "block long, local long, lang string, word string, n long, data binary"


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """From (lang, text): each block's words (local number, lang, word, n) and, in a row of its own, their lists."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        schema = pa.schema([("block", pa.int64()), ("local", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("data", pa.binary())])

        def block():
            nonlocal seq
            whole = pa.Table.from_batches(held).combine_chunks()
            spelled, rows, places = occurrences(_shared.texts_of(whole.column("text")))
            langs = whole.column("lang").combine_chunks().dictionary_encode()
            number = (part << 33) + seq
            seq += 1
            width = max(1, len(spelled.dictionary))
            key = langs.indices.to_numpy()[rows].astype(np.int64) * width + spelled.indices.to_numpy()
            by = np.argsort(key, kind="stable")
            first = runs(key[by])
            counts, distinct = np.diff(np.append(first, len(by))), key[by][first]
            n = len(first)
            if n:
                blank = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n)), langs.dictionary.take(pa.array(distinct // width)).cast(pa.string()), spelled.dictionary.take(pa.array(distinct % width)).cast(pa.string()), pa.array(counts), blank], schema=schema)
                yield pa.RecordBatch.from_pylist([{"block": number, "data": pack_lists(counts, places[by])}], schema=schema)

        size = 0
        for batch in batches:
            for rows, texts in _shared.slices(batch, "text", block_bytes):
                size += texts.nbytes
                held.append(rows)
                if size >= block_bytes:
                    yield from block()
                    held, size = [], 0
                    _shared.trim()
        if held:
            yield from block()

    return docs.mapInArrow(run, BLOCK_ROWS)


def joined_neighbours(ids: np.ndarray, counts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of phrases one word longer: each place of a phrase is joined with the phrase that stands one place on, which
    is the next word (of words) or overlaps in all words but the last. ids: one row for each phrase. Places are distinct."""
    own = np.repeat(np.arange(len(counts)), counts)
    at = np.full(int(places.max(initial=0)) + 2, -1, np.int32)
    at[places] = own
    after = at[places + 1]
    met = np.flatnonzero(after >= 0)
    key = own[met] * len(ids) + after[met]
    by = np.argsort(key, kind="stable")
    first = runs(key[by])
    key = key[by][first]
    longer = np.concatenate([ids[key // max(1, len(ids))], ids[key % max(1, len(ids)), -1:]], axis=1)
    return longer, np.diff(np.append(first, len(by))), places[met[by]]


# -- between blocks and shards

SENT = "shard long, block long, sent binary, lists binary"
SENT_SCHEMA = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("sent", pa.binary()), ("lists", pa.binary())])


def hashed(ids: np.ndarray) -> np.ndarray:
    key = mix(ids[:, 0].astype(np.uint64))
    for k in range(1, ids.shape[1]):
        key = join_hashes(key, ids[:, k].astype(np.uint64))
    return key


def dealt(ids: np.ndarray, n: np.ndarray, block: np.ndarray, local: np.ndarray, shards: int) -> list[dict]:
    """Entries packed by shard. local: the phrase's number in its block plus one, 0 where no answer is needed."""
    shard = (hashed(ids) >> U(32)).astype(np.int64) * shards >> 32
    by = np.argsort(shard, kind="stable")
    first = runs(shard[by])
    return [{"shard": int(shard[own[0]]), "sent": pack(block[own], local[own], n[own], *ids[own].T)} for own in np.split(by, first[1:]) if len(own)]


def route(sent: DataFrame, shards: int, fan: int) -> DataFrame:
    """Rows of (shard, sent) so that all of a shard's meet under its number; what was dealt to `fan` groups is dealt out anew."""
    if shards <= fan:
        return sent.select("shard", "sent")

    def run(batches):
        held, size = [], 0

        def flush():
            block, local, n, *ids = (np.concatenate(x) for x in zip(*held))
            yield from pa.Table.from_pylist(dealt(np.stack(ids, axis=1), n, block, local, shards), SENT_SCHEMA).to_batches()

        for batch in batches:
            for raw in batch.column(0):
                held.append(unpack(raw.as_py()))
                size += len(held[-1][0])
                if size >= GATHER:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return sent.repartition(fan, "shard").select("sent").mapInArrow(run, SENT).select("shard", "sent")


def extend(lists: DataFrame, kept: DataFrame, least: int, last: bool, groups: int) -> DataFrame:
    """Blocks' lists and what is known of them to the lists of phrases one word longer, and what the shards get of those.

    Of words: kept has a row (block, local, id) for each frequent word of a block. Of phrases: packed local numbers (block,
    data); lists that are long enough by themselves stay without an answer. last: no lists are kept."""

    def run(table: pa.Table) -> pa.Table:
        block, out = table.column("block")[0].as_py(), []
        raw = [x for x in table.column("lists").to_pylist() if x is not None]
        if raw:
            counts, places, ids = unpack_lists(raw[0])
            if ids:  # phrases
                ids = np.stack(ids, axis=1)
                told = [unpack(x)[0] for x in table.column("data").to_pylist() if x is not None]
                chosen = np.unique(np.concatenate([*told, np.flatnonzero(counts >= least)]))
                ids = ids[chosen]
            else:
                told = table.select(["local", "id"]).filter(pc.is_valid(table.column("id")))
                chosen, ids = told.column("local").to_numpy(), told.column("id").to_numpy()
                by = np.argsort(ids)
                chosen, ids = chosen[by], ids[by][:, None]
            first = np.cumsum(counts) - counts
            many = counts[chosen]
            ends = np.cumsum(many)
            places = places[np.arange(int(many.sum())) + np.repeat(first[chosen] - (ends - many), many)]
            ids, counts, places = joined_neighbours(ids, many, places)
            if len(ids):
                local = np.where((counts >= least) | last, 0, np.arange(1, len(ids) + 1))
                out = [x | {"block": block} for x in dealt(ids, counts, np.full(len(ids), block), local, groups)]
                if not last:
                    out.append({"block": block, "lists": pack_lists(counts, places, *ids.T)})
        _shared.trim()
        return pa.Table.from_pylist(out, SENT_SCHEMA)

    both = lists.select("block", "lists").unionByName(kept, allowMissingColumns=True)
    for c, kind in (("local", "long"), ("id", "long"), ("data", "binary")):
        if c not in both.columns:
            both = both.withColumn(c, F.lit(None).cast(kind))
    return both.groupBy("block").applyInArrow(run, SENT)


SUMMED = "block long, data binary, ids array<long>, f long"
SUMMED_SCHEMA = pa.schema([("block", pa.int64()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("f", pa.int64())])


def summed(sent: DataFrame, least: int) -> DataFrame:
    """Frequent phrases (ids, f), and for each block that asked, which of its phrases they are (block, data)."""

    def run(table: pa.Table) -> pa.Table:
        block, local, n, *ids = (np.concatenate(x) for x in zip(*(unpack(x) for x in table.column("sent").to_pylist())))
        by = np.lexsort(ids[::-1])
        ids = np.stack(ids, axis=1)[by]
        first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
        f = np.add.reduceat(n[by], first)
        often = f >= least
        phrases, width = ids[first[often]], ids.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(phrases) + 1) * width, pa.int32()), pa.array(phrases.ravel()))
        out = [pa.table([pa.nulls(len(phrases), pa.int64()), pa.nulls(len(phrases), pa.binary()), lists, pa.array(f[often])], schema=SUMMED_SCHEMA)]
        asked = by[np.repeat(often, np.diff(np.append(first, len(by))))]
        asked = asked[local[asked] > 0]
        asked = asked[np.lexsort((local[asked], block[asked]))]
        if len(asked):
            answers = [{"block": int(block[own[0]]), "data": pack(local[own] - 1)} for own in np.split(asked, runs(block[asked])[1:])]
            out.append(pa.Table.from_pylist(answers, SUMMED_SCHEMA))
        _shared.trim()
        return pa.concat_tables(out)

    return sent.groupBy("shard").applyInArrow(run, SUMMED)


# -- frequencies, candidates, ranks


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (lang, text): frequent words (id, lang, word, f), frequent phrases of all lengths (ids, f), and all words' number
    by lang (lang, n). All three are written tables."""
    spark = docs.sparkSession
    _, size = _shared.input_bytes(docs)
    shards = max(1, -(-size // shard_bytes))
    groups = min(shards, fan)
    read = lambda path, kinds: spark.read.schema(kinds).parquet(path)
    lists_at = _shared.written(blocks(docs, block_bytes), "blocks")
    made = read(lists_at, BLOCK_ROWS)
    in_blocks = made.where("word IS NOT NULL").drop("data")
    totals = _shared.materialize(in_blocks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    vocabulary = in_blocks.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    vocabulary = _shared.materialize(vocabulary.select(F.monotonically_increasing_id().alias("id"), "lang", "word", "f"), "vocabulary")
    phrases = [vocabulary.select(F.array("id").alias("ids"), "f")]
    kept = in_blocks.join(vocabulary.drop("f"), ["lang", "word"]).select("block", "local", "id")
    lists = made.where("data IS NOT NULL").select("block", F.col("data").alias("lists"))
    answers_at = None
    for level in range(2, longest + 1):
        sent_at = _shared.written(extend(lists, kept, least, level == longest, groups), "longer")
        for path in (lists_at, answers_at):
            if path:
                _shared.discard(spark, path)
        sent = read(sent_at, SENT)
        done = _shared.written(summed(route(sent.where("sent IS NOT NULL"), shards, groups), least), "summed")
        told = read(done, SUMMED)
        phrases.append(_shared.materialize(told.where("ids IS NOT NULL").select("ids", "f"), "phrases"))
        lists, kept = sent.where("lists IS NOT NULL").select("block", "lists"), told.where("data IS NOT NULL").select("block", "data")
        lists_at, answers_at = sent_at, done
    for path in (lists_at, answers_at):
        if path:
            _shared.discard(spark, path)
    whole = phrases[0]
    for x in phrases[1:]:
        whole = whole.unionByName(x)
    return vocabulary, whole, totals


def scored(phrases: DataFrame) -> DataFrame:
    """(ids, a, l, r, score) of each phrase of two words and more, by its lowest-scoring cut."""
    parts = phrases.select(F.col("ids").alias("part"), F.col("f").alias("of_part"))
    cuts = phrases.where(F.size("ids") > 1).select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("ids", F.lit(1), F.col("k")), "tail": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    cuts = cuts.join(parts, F.col("head") == F.col("part")).withColumnRenamed("of_part", "l").drop("part")
    cuts = cuts.join(parts, F.col("tail") == F.col("part")).withColumnRenamed("of_part", "r").drop("part")
    wide = lambda c: f"CAST({c} AS DECIMAL(14, 0))"  # noqa: E731  37 digits hold a million times the square
    score = F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * ({wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("ids").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
    return best.select("ids", "best.a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, cover: int = COVER) -> DataFrame:
    """Candidates (ids, a, ...) without those that stand in a longer candidate for `cover` percent of their occurrences."""
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("ids") - n + 1), lambda k: F.slice("ids", k, n))))
    inner = candidates.where(F.size("ids") > 2).select(F.explode(spans).alias("inner"), "a").groupBy("inner").agg(F.max("a").alias("_most"))
    out = candidates.join(inner, F.col("ids") == F.col("inner"), "left")
    return out.where(F.coalesce(100 * F.col("_most") < cover * F.col("a"), F.lit(True))).drop("inner", "_most")


def spelled_out(candidates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds lang and phrase."""
    at = candidates.select("ids", F.posexplode("ids").alias("pos", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    texts = at.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return candidates.join(texts, "ids")


def leading(rows: DataFrame, n_rows: int, top: int = TOP) -> DataFrame:
    """The first rows of each lang with their rank; large langs in groups first, of which each gives its first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = n_rows // max(RANKED, 50 * top)
    while salts > 1:
        place = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order))
        rows = rows.withColumn("rank", place).where(F.col("rank") <= top).drop("rank")
        salts //= 40
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, lang: str = "lang", text: str = "text", **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first collocations."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    with _shared.scratch(spark):
        vocabulary, phrases, totals = frequent_phrases(rows, least, longest, **sizes)
        candidates = _shared.materialize(spelled_out(uncovered(_shared.materialize(scored(phrases), "scored"), cover), vocabulary), "candidates")
        first = leading(candidates, candidates.count(), top).join(totals, "lang")
        out = _shared.materialize(first.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)
    return out


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_shared.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(list_filter(list_transform(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+')), lambda x: len(x) > 0)) AS ws FROM d),
one AS (SELECT lang, unnest(ws) AS p FROM pieces),
f1 AS (SELECT lang, p, count(*) AS f FROM one GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS p FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS p FROM pieces) GROUP BY ALL HAVING count(*) >= 10),
s2 AS (SELECT lang, p, string_split(p, ' ') AS w, f FROM f2), s3 AS (SELECT lang, p, string_split(p, ' ') AS w, f FROM f3),
c2 AS (SELECT s.lang, s.p, s.f AS a, x.f AS l, y.f AS r FROM s2 s JOIN f1 x ON x.lang = s.lang AND x.p = w[1] JOIN f1 y ON y.lang = s.lang AND y.p = w[2]),
c3 AS (SELECT s.lang, s.p, s.f AS a, x.f AS l1, xy.f AS r1, yx.f AS l2, y.f AS r2 FROM s3 s JOIN f1 x ON x.lang = s.lang AND x.p = w[1] JOIN f2 xy ON xy.lang = s.lang AND xy.p = w[2] || ' ' || w[3]
  JOIN f2 yx ON yx.lang = s.lang AND yx.p = w[1] || ' ' || w[2] JOIN f1 y ON y.lang = s.lang AND y.p = w[3]),
b3 AS (SELECT *, 1000000::HUGEINT * a * a // (l1::HUGEINT * r1) AS v1, 1000000::HUGEINT * a * a // (l2::HUGEINT * r2) AS v2 FROM c3),
inner2 AS (SELECT lang, p, max(f) AS most FROM (SELECT lang, w[1] || ' ' || w[2] AS p, f FROM s3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM s3) GROUP BY ALL),
allc AS (SELECT lang, p, a, l, r, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM c2 LEFT JOIN inner2 USING (lang, p) WHERE most IS NULL OR 100 * most < 50 * a
  UNION ALL SELECT lang, p, a, CASE WHEN v1 <= v2 THEN l1 ELSE l2 END, CASE WHEN v1 <= v2 THEN r1 ELSE r2 END, least(v1, v2) FROM b3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM allc)
SELECT lang, rank::BIGINT AS rank, p AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
