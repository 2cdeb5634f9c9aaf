"""The stages one after the other, and the registered queries."""

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tabwright.llm.common import publish, table
from tests.conftest import SMALL


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = table(spark, SMALL, "documents")
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = publish(stage(spark, docs, SMALL), "stage")
        assert docs.columns == columns, name
        after = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        texts[name] = (before, after)
    before, after = texts["quality classifier"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    good = [i for i in before if labels.get(i) == 1]
    assert sum(i in after for i in good) >= 0.97 * len(good)
    assert sum(i in after for i in before if labels.get(i) == 0) <= 2
    before, after = texts["language id"]
    assert set(before) == set(after)
    before, after = texts["minhash near-dedup"]
    assert len(after) < len(before) and len(set(after.values())) == len(after)
    before, after = texts["substring dedup"]
    assert set(before) == set(after) and sum(map(len, after.values())) < sum(map(len, before.values()))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.count()
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.filter("n <> end or n > 2048").count() == 0


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5
