"""Release decisions: named checks of evidence against thresholds, many candidates at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import edit_distance, rate
from ..functions.text import normalize_for_cer
from .governance import evaluation_set_check

#: Proposed thresholds.
CRITERIA = {
    "pilot_max_cer": 0.35,
    "pilot_min_dialect_preservation": 0.6,
    "human_min_fine_tuned_preference_rate": 0.7,
    "independent_min_utterances": 100,
    "independent_min_speakers": 5,
    "independent_min_relative_cer_improvement": 0.1,
    "independent_min_dialect_preservation_delta": 0.15,
    "standard_min_utterances": 100,
    "standard_min_speakers": 5,
    "standard_max_relative_cer_regression": 0.15,
    "standard_max_absolute_cer_regression": 0.03,
    "empty_output_increase_allowed": 0,
}
#: A failure of one of these is never forgiven.
DECISIVE = ("benchmark_integrity", "reproducibility", "pilot_empty_output_regression", "independent_empty_output_regression", "standard_cer_regression", "standard_empty_output_regression")


def relative_improvement(base: Column, new: Column) -> Column:
    """(base - new) / base; with a base of zero 1 if the new rate is zero too, else 0."""
    return F.when(base > 0, (base - new) / base).otherwise((new == 0).cast("double"))


def allowed_regression(base: Column, absolute: float, relative: float) -> Column:
    return F.greatest(F.lit(absolute), base * relative)


def checks(evidence: DataFrame, criteria: dict[str, float] = CRITERIA) -> DataFrame:
    """(candidate, check, outcome) with outcome passed, failed or pending; checks that don't apply are left out."""
    e, c = F.col, criteria

    def grown(arm: str) -> Column:
        return e(f"{arm}_fine_tuned_empty_outputs") <= e(f"{arm}_pretrained_empty_outputs") + c["empty_output_increase_allowed"]

    def missing(arm: str, *what: str) -> Column:
        out = F.lit(False)
        for w in what:
            out |= e(f"{arm}_pretrained_{w}").isNull() | e(f"{arm}_fine_tuned_{w}").isNull()
        return out

    told = F.lit(True)
    free, plain = e("independent_test_complete"), e("standard_regression_complete")
    free_gap, plain_gap = missing("independent", "cer", "dialect_preservation", "empty_outputs"), missing("standard", "cer", "empty_outputs")
    free_on, plain_on = free & ~free_gap, plain & ~plain_gap
    rules: list[tuple[str, Column, Column, Column]] = [  # name, applies, pending, holds
        ("benchmark_integrity", told, ~told, e("benchmark_integrity_passed")),
        ("reproducibility", told, ~told, e("reproducibility_passed")),
        ("pilot_cer", told, ~told, e("pilot_fine_tuned_cer") <= c["pilot_max_cer"]),
        ("pilot_dialect_preservation", told, ~told, e("pilot_fine_tuned_dialect_preservation") >= c["pilot_min_dialect_preservation"]),
        ("pilot_empty_output_regression", told, ~told, grown("pilot")),
        ("human_ab", told, ~e("human_review_complete"), e("human_fine_tuned_preference_rate") >= c["human_min_fine_tuned_preference_rate"]),
        ("independent_multi_speaker_test", ~free, ~free, told),
        ("independent_metrics_complete", free & free_gap, ~told, ~told),
        ("independent_dataset_size", free_on, ~told, (e("independent_utterances") >= c["independent_min_utterances"]) & (e("independent_speakers") >= c["independent_min_speakers"])),
        ("independent_cer_improvement", free_on, ~told, relative_improvement(e("independent_pretrained_cer"), e("independent_fine_tuned_cer")) >= c["independent_min_relative_cer_improvement"]),
        ("independent_dialect_preservation", free_on, ~told, e("independent_fine_tuned_dialect_preservation") - e("independent_pretrained_dialect_preservation") >= c["independent_min_dialect_preservation_delta"]),
        ("independent_empty_output_regression", free_on, ~told, grown("independent")),
        ("standard_korean_regression", ~plain, ~plain, told),
        ("standard_metrics_complete", plain & plain_gap, ~told, ~told),
        ("standard_dataset_size", plain_on, ~told, (e("standard_utterances") >= c["standard_min_utterances"]) & (e("standard_speakers") >= c["standard_min_speakers"])),
        ("standard_cer_regression", plain_on, ~told, e("standard_fine_tuned_cer") - e("standard_pretrained_cer") <= allowed_regression(e("standard_pretrained_cer"), c["standard_max_absolute_cer_regression"], c["standard_max_relative_cer_regression"])),
        ("standard_empty_output_regression", plain_on, ~told, grown("standard")),
    ]
    outcome = [F.struct(F.lit(name).alias("check"), F.when(applies, F.when(pending, "pending").when(F.coalesce(holds, F.lit(False)), "passed").otherwise("failed")).alias("outcome")) for name, applies, pending, holds in rules]
    return evidence.select("candidate", F.explode(F.array(*outcome)).alias("x")).select("candidate", "x.check", "x.outcome").where("outcome is not null")


def gate_assessment(evidence: DataFrame, criteria: dict[str, float] = CRITERIA) -> DataFrame:
    """Per candidate: counts of outcomes and PASS, CONDITIONAL PASS (one failure that is not decisive) or FAIL."""
    rows = checks(evidence, criteria).groupBy("candidate").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "pending")], F.count_if((F.col("outcome") == "failed") & F.col("check").isin(*DECISIVE)).alias("decisive"),
    )
    status = F.when((F.col("pending") > 0) | (F.col("decisive") > 0), "FAIL").when(F.col("failed") == 0, "PASS").when(F.col("failed") == 1, "CONDITIONAL PASS").otherwise("FAIL")
    return rows.select("candidate", "passed", "failed", "pending", status.alias("status"))


def finding_pair(choice: Column) -> Column:
    """A reviewer's choice a, b, both, neither or uncertain as findings on A and B; null where uncertain."""
    return F.struct(F.when(choice.isin("a", "both"), True).when(choice.isin("b", "neither"), False).alias("a"), F.when(choice.isin("b", "both"), True).when(choice.isin("a", "neither"), False).alias("b"))


ARMS = ("pretrained", "fine_tuned")


def compare_arms(manifest: DataFrame, pretrained: DataFrame, fine_tuned: DataFrame, *by: str) -> DataFrame:
    """A row for each entry that both arms transcribed: error rates, edits, kept expressions, blanks, latencies and the outcome.

    manifest: utterance_id, speaker_id, surface_text, dialect_expressions (array); arms: utterance_id, hypothesis, latency_ms; ``by``
    names further columns of the key that all three have.
    """
    keys = [*by, "utterance_id"]
    rows = manifest.select(*keys, "speaker_id", "surface_text", F.coalesce("dialect_expressions", F.array().cast("array<string>")).alias("dialect_expressions"))
    for arm, frame in zip(ARMS, (pretrained, fine_tuned), strict=True):
        rows = rows.join(frame.select(*keys, F.col("hypothesis").alias(f"{arm}_text"), F.col("latency_ms").alias(f"{arm}_latency_ms")), keys)
    rows = rows.withColumn("_r", normalize_for_cer(F.coalesce("surface_text", F.lit("")))).withColumn("reference_characters", F.length("_r"))

    def kept(text: Column) -> Column:
        return F.size(F.filter("dialect_expressions", lambda e: F.contains(text, e)))

    for arm in ARMS:
        text = F.coalesce(F.col(f"{arm}_text"), F.lit(""))
        rows = rows.withColumn(f"{arm}_edits", edit_distance(F.col("_r"), normalize_for_cer(text))).withColumn(f"{arm}_cer", rate(F.col(f"{arm}_edits"), F.col("reference_characters")))
        rows = rows.withColumn(f"{arm}_preserved", kept(text)).withColumn(f"{arm}_empty", F.trim(text) == "")
    before, after = F.col("pretrained_cer"), F.col("fine_tuned_cer")
    outcome = F.when(after < before, "improved").when(after > before, "worsened").otherwise("equal")
    return rows.withColumn("expressions", F.size("dialect_expressions")).withColumn("outcome", outcome).drop("_r", "dialect_expressions")


def arm_report(rows: DataFrame, preservation: bool, *by: str) -> DataFrame:
    """compare_arms in one row (or one for each group): sizes, outcomes, and rates, blanks and latencies of both arms.

    Rates are null without characters or expressions, and preservation is null for a set that is not asked for it.
    """
    per_arm: list[Column] = []
    for arm in ARMS:
        p = F.percentile(f"{arm}_latency_ms", F.array(F.lit(0.5), F.lit(0.95)))
        kept = F.try_divide(F.sum(f"{arm}_preserved"), F.sum("expressions")) if preservation else F.lit(None).cast("double")
        per_arm += [
            F.round(F.try_divide(F.sum(f"{arm}_edits"), F.sum("reference_characters")), 6).alias(f"{arm}_cer"), F.round(kept, 6).alias(f"{arm}_dialect_preservation"), F.count_if(f"{arm}_empty").alias(f"{arm}_empty_outputs"),
            F.round(F.avg(f"{arm}_latency_ms"), 6).alias(f"{arm}_latency_mean_ms"), F.round(p[0], 6).alias(f"{arm}_latency_p50_ms"), F.round(p[1], 6).alias(f"{arm}_latency_p95_ms"),
        ]
    outcomes = [F.count_if(F.col("outcome") == o).alias(o) for o in ("improved", "equal", "worsened")]
    return rows.groupBy(*by).agg(F.count("*").alias("utterances"), F.countDistinct("speaker_id").alias("speakers"), *outcomes, *per_arm)


def gate_evidence(base: DataFrame, reproducibility: DataFrame, human: DataFrame, independent: DataFrame | None = None, standard: DataFrame | None = None) -> DataFrame:
    """The evidence of each candidate, folded from its reports over a base row; a report that is there overrides the base.

    All have ``candidate``, once each.  reproducibility: passed, bundle_passed; human: complete, preference_rate; independent and standard:
    rows of arm_report.  ``review_without_key`` marks a complete human review without a rate: it can't be unblinded, and counts as
    not complete.
    """
    def value(name: str) -> Column:
        return F.col(f"b.{name}") if name in base.columns else F.lit(None)

    rows = base.alias("b").join(reproducibility.withColumn("_there", F.lit(True)).alias("r"), "candidate", "left").join(human.alias("h"), "candidate", "left")
    new: dict[str, Column] = {
        "reproducibility_passed": F.when(F.col("r._there"), F.coalesce(F.col("r.passed") & F.col("r.bundle_passed"), F.lit(False))).otherwise(value("reproducibility_passed")),
        "review_without_key": F.coalesce(F.col("h.complete") & F.col("h.preference_rate").isNull(), F.lit(False)),
        "human_review_complete": F.coalesce(F.col("h.complete") & F.col("h.preference_rate").isNotNull(), value("human_review_complete"), F.lit(False)),
        "human_fine_tuned_preference_rate": F.coalesce(F.col("h.preference_rate"), value("human_fine_tuned_preference_rate")),
    }
    for name, done, report in (("independent", "independent_test_complete", independent), ("standard", "standard_regression_complete", standard)):
        if report is None:
            continue
        rows = rows.join(report.withColumn("_there", F.lit(True)).alias(name), "candidate", "left")
        there = F.col(f"{name}._there").isNotNull()
        new[done] = there | F.coalesce(value(done), F.lit(False))
        for field in ("utterances", "speakers", *[f"{a}_{w}" for a in ARMS for w in ("cer", "dialect_preservation", "empty_outputs")]):
            new[f"{name}_{field}"] = F.when(there, F.col(f"{name}.{field}")).otherwise(value(f"{name}_{field}"))
    kept = [F.col(f"b.{c}") for c in base.columns if c not in new and c != "candidate"]
    return rows.select("candidate", *kept, *[c.alias(n) for n, c in new.items()])


def gate_suite(sets: dict[str, tuple[DataFrame, DataFrame, DataFrame]], exclusions: DataFrame, base: DataFrame, reproducibility: DataFrame, human: DataFrame, criteria: dict[str, float] = CRITERIA, headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assessment, evidence, findings) of candidates from their two held-out sets and the predictions of both arms.

    sets: ``independent`` and ``standard``, each (manifest, pretrained, fine_tuned) with ``candidate``.  The sets are checked first
    (governance.evaluation_set_check); a candidate of which a set has an error is not assessed, and its findings say why.
    """
    found, reports = [], {}
    for name, (manifest, pretrained, fine_tuned) in sets.items():
        sizes = criteria[f"{name}_min_utterances"], criteria[f"{name}_min_speakers"]
        found.append(evaluation_set_check(manifest, exclusions, *sizes, needs_expressions=name == "independent", headers=headers, by="candidate").withColumn("set", F.lit(name)))
        reports[name] = arm_report(compare_arms(manifest, pretrained, fine_tuned, "candidate"), name == "independent", "candidate")
    findings = reduce(DataFrame.unionByName, found)
    bad = findings.where("level = 'error'").select("candidate").distinct()
    evidence = gate_evidence(base, reproducibility, human, reports.get("independent"), reports.get("standard")).join(bad, "candidate", "left_anti")
    return gate_assessment(evidence, criteria), evidence, findings
