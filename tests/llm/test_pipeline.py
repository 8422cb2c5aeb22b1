"""The pipeline's stages on the small tables, each against what its operator says of its own input."""

import pytest

import corpus_pipeline
from tagwright.llm import common, neardup, packing, pii, quality

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, at = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in at.collect()}
        at = spark.createDataFrame(stage(spark, at, FOLDER).collect(), docs.schema)
        after = {r.doc_id: r for r in at.collect()}
        assert at.columns == columns and set(after) <= set(before)
        if name == "quality":
            field = quality.fit_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            assert set(after) == {i for i, r in before.items() if field.score([r.text or ""])[0] >= 0.3}
        elif name == "near_duplicates":
            frame = spark.createDataFrame(list(before.values()), docs.schema)
            kept = neardup.near_duplicates(frame, settings=neardup.NearSettings.at_80()).where("kept")
            assert set(after) == {r.doc_id for r in kept.collect()}
        elif name == "personal_data":
            assert set(after) == set(before)
            assert not any(pii.base_spans(r.text or "") for r in after.values() if pii.base_spans(before[r.doc_id].text))
            assert all(r.n_chars == len(r.text) for r in after.values())
    pieces = packing.pack(at).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in at.collect()}
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole if r.start == 0 and r.length == r.doc_tokens) != []
    assert sum(r.length for r in whole) == sum(r.length for r in pieces)


def test_stage_names_are_known():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "personal_data", "packing"]
    with pytest.raises(KeyError):
        dict(corpus_pipeline.STAGES)["none"]


def test_kept_rows_are_judged_in_small_lists(spark):
    texts = [(i, "x" * 100_000) for i in range(30)]
    given = spark.createDataFrame(texts, "doc_id int, text string").coalesce(1)
    kept = common.keep_rows(given, "text", lambda: lambda part: [sum(map(len, part)) < 700_000] * len(part))
    assert sorted(map(tuple, kept.collect())) == texts
