"""The corpus pipeline, stage by stage, each against its own input."""

import corpus_pipeline
from lodestone.llm import packing
from lodestone.session import materialize


def test_stages_keep_their_contracts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, sf), f"test-{name}")
        assert after.columns == columns
        sizes.append((docs.count(), after.count(), docs.select("doc_id").distinct().count()))
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = after
    assert sizes[0][1] > 0.98 * sizes[0][0]  # clean documents stay
    assert sizes[1][1] < sizes[1][0]  # copies go
    assert sizes[2][1] == sizes[2][0]  # passages go, documents don't
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.where(f"length > {packing.CAPACITY}").count() == 0
    assert last.where("piece = 0").count() == docs.count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeats", "mixing", "packing"]
