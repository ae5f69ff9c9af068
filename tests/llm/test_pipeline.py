"""Stages keep the columns of documents and their decisions hold."""

import corpus_pipeline as p
import __spark_entry__ as e

DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixture", "sharding"]
    kept = stages["near_duplicates"](spark, docs, DIR)
    clean = stages["decontamination"](spark, kept, DIR)
    mixed = stages["mixture"](spark, clean, DIR).cache()
    assert kept.columns == clean.columns == mixed.columns == docs.columns
    assert clean.count() <= kept.count() <= docs.count()
    sizes = stages["sharding"](spark, mixed, DIR).groupBy("shard").count().toPandas()["count"]
    assert sizes.sum() == mixed.count() and sizes.max() - sizes.min() <= 1
    assert "pipeline" in e.queries()
