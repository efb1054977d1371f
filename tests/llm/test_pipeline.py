"""The pipeline's stages over the smallest tables: each works on what it is given and its decision takes effect."""

import corpus_pipeline
from tests.llm import brute
from tidewatch.llm import line_templates, mixing, quality_crf

SF_DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, before, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality_classifier":
            scored = quality_crf.quality_report(before, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in scored.where("predicted = 1").collect()}
        if name == "line_dedup":
            gone = {r.doc_id: r.kept_sha256 for r in line_templates.template_report(before).collect()}
            assert {r.doc_id: brute.sha(r.text) for r in docs.collect()} == gone
        if name == "near_dedup":
            texts = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id for r in docs.collect()} == {d for d, (_, c) in brute.components(texts, 5).items() if c == d}
        if name == "source_mix":
            taken = {r.doc_id: r.taken for r in mixing.mix_report(before).collect() if r.taken}
            got = {}
            for r in docs.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.words(r.text))
            assert got == taken
        if name == "byte_bpe":
            assert sorted((r.doc_id, r.decoded) for r in docs.collect()) == sorted((r.doc_id, r.text) for r in before.collect())
        else:
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, SF_DIR).count() == docs.count()
