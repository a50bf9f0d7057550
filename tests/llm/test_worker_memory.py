"""Workers keep a model from task to task only while their tasks use it; the driver gives back what it doesn't need."""

import os

import pyarrow as pa

from arterion.llm import common, line_dedup, sentencepieces, toxicity
from arterion.llm.common import let_go, tidied


def test_a_task_of_another_operator_lets_go_of_the_model():
    proto = sentencepieces.default_model()
    batch = [pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text"])], ["doc_id", "text"])]
    first = sentencepieces.model_of(proto, 2)
    list(tidied(iter, keeps=True)(iter(batch)))
    assert sentencepieces.model_of(proto, 2) is first
    list(tidied(iter)(iter(batch)))
    second = sentencepieces.model_of(proto, 2)
    assert second is not first
    let_go()


def test_workers_have_no_model_after_another_operator(spark):
    """As the pipeline runs them: its last stage, then the first two over the next table."""
    proto = sentencepieces.default_model()
    docs = spark.createDataFrame([(k, f"a common line\nown {k}") for k in range(400)], "doc_id long, text string").repartition(4)

    def held(batches):
        import gc

        for batch in batches:
            models = sum(type(x).__name__ == "Model" and type(x).__module__ == sentencepieces.__name__ for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([models])], ["pid", "models"])

    def models():
        return {r["pid"]: r["models"] for r in docs.select("doc_id").mapInArrow(held, "pid long, models long").collect()}

    sentencepieces.encode(docs, proto).write.format("noop").mode("overwrite").save()
    before = models()
    assert any(before.values())
    toxicity.keep_clean(docs, toxicity.Lexicon(words={"own": 1.0}, stems={})).write.format("noop").mode("overwrite").save()
    line_dedup.drop_frequent_lines(docs).write.format("noop").mode("overwrite").save()
    assert sum(models().values()) < sum(before.values())


def test_the_driver_is_tidied_after_tables_of_all_operators_together(spark, monkeypatch):
    """Stages with fewer tables than it takes, and results, count too."""
    tidied_at = []
    monkeypatch.setattr(common, "tidy_driver", tidied_at.append)
    for _ in range(2 * common.Scratch.TIDY):
        common.stash(spark, spark.range(3), "small")
    assert tidied_at == [spark, spark]


def test_the_jvm_gives_native_memory_back(spark):
    assert "Trim native heap" in common.trim_driver(spark)
