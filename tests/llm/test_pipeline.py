import zlib

import corpus_pipeline
from lodestar.llm import registry


def test_stages_compose(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns
        counts.append(now.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in now.collect())
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, now.collect()))


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
