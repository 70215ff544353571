"""Answers found from texts alone: rows stay in the JVM, a text is asked once, memory goes back after a task."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from saltmarsh.llm import common, language_id, toxicity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_texts_go_to_python(spark):
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("word "), "id")).alias("text"), F.lit(1.0).alias("score"), F.lit("kept").alias("row"), F.lit(2).alias("found"))
    sizes = spark.sparkContext.accumulator(0)

    def kernel(texts):
        assert len(texts) <= 1000 and texts.type == pa.string()
        sizes.add(len(texts))
        return pa.StructArray.from_arrays([pa.array([len(t or "") for t in texts.to_pylist()], pa.int64()), texts.is_valid()], ["score", "there"])

    out = common.with_answers(docs.coalesce(1), F.col("text"), kernel, "score long, there boolean").where("there and score > 5")
    assert out.columns == ["doc_id", "text", "row", "found", "score", "there"]
    rows = out.collect()
    assert {(r.doc_id, r.text, r.row, r.found, r.score) for r in rows} == {(i, f"word {i}", "kept", 2, len(f"word {i}")) for i in range(2500) if i % 7}
    assert sizes.value == 2500 and len(rows) == sum(1 for i in range(2500) if i % 7)
    assert common.with_answers(docs.limit(0), F.col("text"), kernel, "score long, there boolean").count() == 0


def test_classifiers_keep_rows_in_the_jvm(spark):
    docs = spark.createDataFrame([(1, "one text", "en"), (2, None, "de")], "doc_id long, text string, lang string")
    language = language_id.LanguageModel(["de", "en"], np.zeros((2, 1 << language_id.BITS)), np.array([0.0, 1.0]))
    severity = toxicity.SeverityModel(np.zeros(1 << toxicity.BITS), np.array([30.0, 31.0]))
    for out in (language_id.identify_languages(docs, language).where("lang_pred <> 'und'"), toxicity.score_severity(docs, severity).where("not toxic")):
        assert "MapInArrow" not in plan(out) and plan(out).count("ArrowEvalPython") == 1
    assert [r.doc_id for r in language_id.identify_languages(docs, language).where("lang_pred = 'en'").collect()] == [1]


def test_unused_memory_goes_back_after_a_task(monkeypatch):
    released = []

    class _Pool:
        def release_unused(self):
            released.append(1)

    monkeypatch.setattr(common.pa, "default_memory_pool", _Pool)
    part = pa.RecordBatch.from_arrays([pa.array(range(5))], names=["x"])
    out = list(common.batches(lambda p: p, 2)(iter([part, part])))
    assert [p.num_rows for p in out] == [2, 2, 1] * 2 and released == [1]
