import corpus_pipeline
from pyspark.sql import functions as F

from quillstone.llm import nearcopy, secrets


def test_stages(spark, sf_dir, tmp_path, documents):
    docs, seen = documents, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= before.count()
    before, after = seen["near_dedup"]
    groups = nearcopy.near_copies(before).select("component_id").distinct()
    assert after.count() == groups.count() and after.join(groups, after.doc_id == groups.component_id, "left_anti").count() == 0
    before, after = seen["secret_scan"]
    assert after.count() == before.count()
    assert not any(secrets.scan(r.text) for r in after.collect())
    before, after = seen["packing"]
    assert after.select("doc_id").distinct().count() == before.count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    good = documents.join(labels, "doc_id").filter(F.size(F.split("text", r"\s+")) >= 60)
    kept = seen["quality_rules"][1]
    assert good.join(kept, "doc_id", "left_semi").count() >= 0.95 * good.count()


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_odd_rows(spark, odd_docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd_docs, sf_dir).collect()
        assert len(rows) <= 2 * odd_docs.count()
        assert stage(spark, odd_docs.limit(0), sf_dir).count() == 0
    ids = [r.doc_id for r in corpus_pipeline.near_dedup(spark, odd_docs, sf_dir).collect()]
    assert len(ids) == len(set(ids)) and None in ids
