"""Reports as lines."""

from pyspark.sql import functions as F

from saltmarsh.operators import report_text as R


def text(df, experiment):
    return [r.line for r in df.where(F.col("experiment_id") == experiment).orderBy("part", "position").collect()]


def test_cells_and_decimals(spark):
    df = spark.createDataFrame([("a|b\nc ", 0.0625), (None, None), ("", -1.00005)], "t string, v double")
    assert [tuple(r) for r in df.select(R.cell(F.col("t")), R.decimals(F.col("v"), 3)).collect()] == [("a\\|b c", "0.063"), ("", "-"), ("", "-1.000")]


def test_review_report(spark):
    kind = """experiment_id string, title string, benchmark string, model string, checkpoint string, source_report_id string, utterance_count int, cer double, dialect_preservation_rate double, context_overcorrection_rate double,
    high_confidence_wrong_count int, p50_latency_ms double, p95_latency_ms double, reviewed int, revisions int, confirmed int, rejected int, uncertain int, failure_types array<string>, limitations array<string>, gate_decision string"""
    heads = spark.createDataFrame([(e, "# T", "b@1", "m", None, "s", 2, 0.25, 0.5, 0.125, 1, 10.0, 20.555, 2, 3, 1, 0, 1, ["MODEL 1"], ["one", "two"], "open") for e in ("x", "y")], kind)
    cases = spark.createDataFrame(
        [("x", 2, "r|", "h", 0.5, [("ka", "preserved"), ("na", "missing")], "confirmed", ["MODEL", "DATA"], "note\nmore"), ("x", 1, "r", None, 0.0005, None, None, None, None)],
        "experiment_id string, case_id int, reference string, hypothesis string, cer double, matches array<struct<surface_form:string,match_status:string>>, verdict string, confirmed_failure_types array<string>, notes string",
    )
    lines = text(R.review_report(heads, cases), "x")
    assert lines[:7] == ["# T", "## Experiment", "- Experiment: `x`", "- Benchmark: `b@1`", "- Model: `m`", "- Checkpoint: `not recorded`", "- Source report: `s`"]
    assert {"- CER: 0.2500", "- Latency p50/p95: 10.00 / 20.56 ms", "- Confirmed / rejected / uncertain: 1 / 0 / 1", "- Confirmed failure types: MODEL 1"} <= set(lines)
    assert lines[22:] == ["| r |  | 0.001 | no expression | not reviewed | none |  |", "| r\\| | h | 0.500 | ka:preserved, na:missing | confirmed | MODEL, DATA | note more |", "## Limitations", "- one", "- two", "## Decision", "`open`"]
    assert len(text(R.review_report(heads, cases), "y")) == 27


def test_calibrated_report(spark):
    kind = """experiment_id string, evaluation_revision string, source_report_id string, cer double, dialect_preservation_rate double, context_overcorrection_rate double, expressions int, preservation_rate double, overcorrection_rate double,
    ambiguous int, match int, mismatch int, missed int, false_positive int, no_error_agreement int, uncertain int"""
    heads = spark.createDataFrame([("x", "v2", None, 0.1, 0.2, 0.3, 15, 0.4, 0.5, 2, 1, 2, 3, 4, 5, 6)], kind)
    cases = spark.createDataFrame(
        [("x", 1, "r", "h", None, ["NO_ERROR"], None, "confirmed", ["MODEL"], "MATCH"), ("x", 2, "r", "h", None, ["NO_ERROR", "PHONETIC_SUBSTITUTION"], ["MODEL"], None, None, None)],
        "experiment_id string, case_id int, reference string, hypothesis string, matches array<struct<surface_form:string,match_status:string>>, observed array<string>, causes array<string>, verdict string, confirmed_failure_types array<string>, agreement string",
    )
    lines = text(R.calibrated_report(heads, cases), "x")
    assert {"| CER | 0.1000 | 0.1000 |", "| Dialect preservation | 0.2000 | 0.4000 |", "| Expressions | 15 | 13 |", "| Ambiguous variants | 0 | 2 |", "- False positive: 4", "- Source report: `not recorded`"} <= set(lines)
    assert lines[-2:] == ["| r | h | no expression | NO_ERROR | unknown | confirmed:MODEL | MATCH |", "| r | h | no expression | PHONETIC_SUBSTITUTION | MODEL | not reviewed | - |"]
