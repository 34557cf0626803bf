import importlib

import corpus_pipeline
from recallgrid.llm import registry


def test_stages_and_run(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept = out.count()
        assert 0.7 * rows < kept <= rows
        docs = out
    packed = corpus_pipeline.run(spark, data)
    assert packed.count() > 0 and packed.agg({"length": "max"}).first()[0] <= 1024


def test_registered():
    names = registry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(registry.oracles()) <= set(names)
    assert importlib.import_module("__spark_entry__").queries().keys() >= names.keys()
