"""The pipeline's stages against their operators' decisions, one stage after the other."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from grafspan.llm import common, decontaminate, language, near_dedup, piece_sampling, quality


def test_stages_keep_what_their_operators_keep(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language identification", "near-duplicate removal", "benchmark decontamination", "piece encoding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns
            before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
            if k == 0:
                model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
                want = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= corpus_pipeline.LEAST_QUALITY}
            elif k == 1:
                want = {r.doc_id for r in language.predict(docs, language.fit(docs)).collect() if r.lang_pred != "und" and r.score >= 0.5}
            elif k == 2:
                want = {r.doc_id for r in near_dedup.near_duplicates(docs, percent=80).collect() if r.kept}
            else:
                found = decontaminate.find_windows(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
                hit = {r._row.doc_id: (sum(s.b - s.a for s in r.spans), r.n_words) for r in found}
                want = {i for i, (h, n) in hit.items() if not (h and 20 * h >= n)}
            assert after == want and after <= before, name
            docs = common.store(out, f"test-{k}")
        else:
            texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
            rows = out.collect()
            assert {r.doc_id for r in rows} == set(texts)
            vocabulary = piece_sampling.Vocabulary(piece_sampling.default_vocabulary())
            for r in rows:
                assert r.round_trip == ("▁" not in texts[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
                assert vocabulary.decode(r.ids).decode() == texts[r.doc_id].replace("▁", " ")


def test_quality_stage_drops_what_the_classifier_rejects(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.op3_quality(spark, sf).collect() if r.predicted == 1}


def test_stages_on_nulls_and_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "a", 0), (-2, None, "en", "a", 0)], docs.schema)
    for part in (docs.limit(0), odd):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, part, sf)
            assert out.count() <= 2 * part.count()
            if k < 4:
                assert out.columns == docs.columns


@pytest.mark.parametrize("name", ["pipeline", *(f"op{n}_" for n in range(1, 11))])
def test_registered(name):
    import __spark_entry__

    assert any(q.startswith(name) for q in __spark_entry__.queries())
