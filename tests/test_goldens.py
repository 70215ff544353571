"""Ten transcribed sentences of a frozen benchmark with both arms' results, and what the reports must say of them."""

import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import scoring
from saltmarsh.operators import gate, reports

# Reference, expressions (surface form and normalised forms), the two hypotheses with latencies in ms, duration in ms.
ROWS = [
    ("와따 맛있노", [("와따", ["와"]), ("맛있노", ["맛있다"])], "", 407.543, "와따 맛있노?", 457.761, 4457.312),
    ("마, 괜찮다 아이가.", [("마", ["야"]), ("아이가", ["잖아"])], "막 괜찮다 이거", 415.593, "막 괜찮다 아이가.", 466.835, 4286.688),
    ("내일 같이 가재이", [("가재이", ["가자"])], "", 445.459, "내일 같이 가재이.", 449.315, 4372.0),
    ("여기 좀 앉으이소.", [("앉으이소", ["앉으세요"])], "어 이 조만칠이서", 16988.643, "아 여기 좀 앉으이소.", 5109.247, 3945.312),
    ("지금 뭐 하노?", [("하노", ["해", "하니"])], "지금 뭐 하노", 358.194, "지금 뭐 하노?", 399.812, 4884.0),
    ("그거 아이다.", [("아이다", ["아니야", "아닙니다"])], "", 377.915, "그거 아이다.", 399.769, 3945.312),
    ("오늘 와 이리 춥노?", [("와", ["왜"]), ("이리", ["이렇게"]), ("춥노", ["추워"])], "옷 와이디 춤로", 407.31, "오늘 와이리 춥노?", 447.76, 4713.312),
    ("밥 묵었나?", [("묵었나", ["먹었어", "먹었니"])], "밤 무거나", 1357.606, "밥 묵었나?", 1293.24, 4372.0),
    ("니 지금 어데고?", [("니", ["너"]), ("어데고", ["어디야"])], "니 지금 어디가", 379.74, "니 지금 어데고?", 428.178, 4457.312),
    ("국밥 하나 주이소", [("주이소", ["주세요", "주십시오"])], "국밥 하나 주의소", 384.023, "국밥아나 주이소.", 427.296, 5054.688),
]


@pytest.fixture(scope="module")
def arms(spark):
    rows = [(str(i), f"s{i % 3}", *r) for i, r in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "utterance_id string, speaker_id string, reference string, labels array<struct<surface_form:string,normalized_forms:array<string>>>, h0 string, l0 double, h1 string, l1 double, duration_ms double")
    return [df.select("utterance_id", "speaker_id", "reference", "labels", F.col(f"h{k}").alias("hypothesis"), F.col(f"l{k}").alias("latency_ms"), "duration_ms", F.lit(None).cast("double").alias("confidence")) for k in (0, 1)]


def scored(df):
    c = scoring.with_expression_matches(scoring.score_cases(df)).withColumn("m", scoring.dialect_metric(F.col("matches")))
    return c.select("*", *[F.col(f"m.{n}").alias(n) for n in ("expressions", "preserved", "overcorrected")]).drop("m")


@pytest.mark.parametrize("arm, edits, kept, cer, blank, p50, p95, mean, mean_rtf", [(0, 37, 3, 0.616667, 3, 407.4265, 9954.67635, 2152.2026, 0.532354), (1, 3, 14, 0.05, 0, 448.5375, 3392.04385, 987.9213, 0.236397)])
def test_reports(arms, arm, edits, kept, cer, blank, p50, p95, mean, mean_rtf):
    c = scored(arms[arm])
    sums = c.agg(F.sum("edits").alias("e"), F.sum("ref_chars").alias("n"), F.sum("preserved").alias("p"), F.sum("expressions").alias("x"), F.sum("overcorrected").alias("o")).first()
    assert tuple(sums) == (edits, 60, kept, 15, 0)
    r = reports.aggregate_report(c).first()
    assert (r.utterance_count, r.cer, r.dialect_preservation_rate, r.context_overcorrection_rate, r.high_confidence_wrong_count) == (10, cer, round(kept / 15, 6), 0, 0)
    assert (r.p50_latency_ms, r.p95_latency_ms) == (pytest.approx(p50), pytest.approx(p95))
    m = reports.arm_metrics(c.withColumn("arm", F.lit("a"))).first()
    assert (m.empty_outputs, m.mean_latency_ms) == (blank, pytest.approx(mean))
    s = reports.inference_summary(c.withColumn("status", F.lit("ok")), c).first()
    assert (s.status, s.mean_rtf) == ("complete", pytest.approx(mean_rtf, abs=2e-6))
    counts = c.select(scoring.edit_counts(F.col("nr"), F.col("nh")).alias("k")).agg(F.sum(F.expr("k.substitutions + k.deletions + k.insertions")).alias("n")).first().n
    assert counts == edits


def test_comparison_and_gate(spark, arms):
    manifest = arms[0].select("utterance_id", "speaker_id", F.col("reference").alias("surface_text"), F.transform("labels", lambda x: x["surface_form"]).alias("dialect_expressions"))
    rows = gate.compare_arms(manifest, *[a.select("utterance_id", "hypothesis", "latency_ms") for a in arms])
    r = gate.arm_report(rows, True).first()
    assert (r.improved, r.equal, r.worsened, r.pretrained_cer, r.fine_tuned_cer, r.pretrained_empty_outputs, r.fine_tuned_empty_outputs) == (8, 2, 0, 0.616667, 0.05, 3, 0)
    kept = rows.agg(*[F.count_if(F.expr(f"fine_tuned_preserved {o} pretrained_preserved")) for o in (">", "=", "<")]).first()
    assert tuple(kept) == (9, 1, 0)
    pilot = gate.arm_report(rows, True).select(
        F.lit("c").alias("candidate"), F.lit(True).alias("benchmark_integrity_passed"), F.col("fine_tuned_cer").alias("pilot_fine_tuned_cer"), F.col("fine_tuned_dialect_preservation").alias("pilot_fine_tuned_dialect_preservation"),
        F.col("pretrained_empty_outputs").alias("pilot_pretrained_empty_outputs"), F.col("fine_tuned_empty_outputs").alias("pilot_fine_tuned_empty_outputs"),
    )
    none = {f"{s}_{a}_{w}": F.lit(None).cast("double") for s in ("independent", "standard") for a in gate.ARMS for w in ("cer", "dialect_preservation", "empty_outputs")} | {f"{s}_{w}": F.lit(None).cast("long") for s in ("independent", "standard") for w in ("utterances", "speakers")}
    base = pilot.withColumns(none | {"independent_test_complete": F.lit(False), "standard_regression_complete": F.lit(False), "human_fine_tuned_preference_rate": F.lit(None).cast("double")})
    passed = spark.createDataFrame([("c", True, True)], "candidate string, passed boolean, bundle_passed boolean")
    human = spark.createDataFrame([("c", False, None)], "candidate string, complete boolean, preference_rate double")
    r = gate.gate_assessment(gate.gate_evidence(base, passed, human)).first()
    assert (r.status, r.passed, r.failed, r.pending) == ("FAIL", 5, 0, 3)
