"""Re-evaluation of predictions against rules on dialect forms and the latest human review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_for_cer, tokens_without_punct
from .governance import coverage_check
from .history import latest_by
from .reports import ratio

#: Fixed value: the revision of the profile without rules that stands in where no profile fits.
NO_PROFILE = "live-observation-only"


def first_form(hypothesis: Column, forms: Column) -> Column:
    """The first of some forms (array of structs with ``plain``, the form as normalised for error rates) in a hypothesis."""
    return F.get(F.filter(forms, lambda f: F.contains(hypothesis, f["plain"])), F.lit(0))


def classify_expression(hypothesis: Column, surface: Column, variants: Column, standards: Column) -> Column:
    """What became of an expression, tried in order: exact, variant (approved or candidate), standard form, missing.

    hypothesis and surface are normalised; variants and standards are arrays of structs (form, plain, status).
    """
    variant, standard = first_form(hypothesis, variants), first_form(hypothesis, standards)
    exact = F.contains(hypothesis, surface)
    kind = F.when(exact, "EXACT_SURFACE").when(variant.isNotNull(), "ACCEPTABLE_VARIANT").when(standard.isNotNull(), "STANDARD_EQUIVALENT").otherwise("MISSING")
    error = (
        F.when(exact | (variant["status"] == "approved"), "NO_ERROR").when(variant.isNotNull(), "AMBIGUOUS_VARIANT")
        .when(standard.isNotNull(), "DIALECT_TO_STANDARD").otherwise("DIALECT_EXPRESSION_LOST")
    )
    form = F.when(~exact, F.coalesce(variant["form"], standard["form"]))
    return F.struct(kind.alias("match_kind"), error.alias("observed_error"), form.alias("matched_form"))


def substitute_variants(hypothesis: Column, accepted: Column) -> Column:
    """The hypothesis with the first occurrence of each accepted variant (form, surface), in order, replaced by its surface."""

    def step(text: Column, v: Column) -> Column:
        at = F.instr(text, v["form"])
        return F.when((at > 0) & (v["form"] != ""), F.concat(F.substring(text, F.lit(1), at - 1), v["surface"], F.substring(text, at + F.length(v["form"]), F.length(text)))).otherwise(text)

    return F.aggregate(accepted, hypothesis, step)


def edit_observations(reference: Column, hypothesis: Column, counts: Column) -> Column:
    """Observed errors of a pair from its edit counts, word borders and ending."""
    a, b = normalize_for_cer(reference), normalize_for_cer(hypothesis)
    k = F.least(F.lit(3), F.length(a), F.length(b))
    return F.array_compact(F.array(
        F.when((a == b) & (tokens_without_punct(reference) != tokens_without_punct(hypothesis)), "WORD_BOUNDARY_ERROR"),
        F.when(counts["substitutions"] > 0, "PHONETIC_SUBSTITUTION"), F.when(counts["deletions"] > 0, "WORD_OR_SYLLABLE_OMISSION"), F.when(counts["insertions"] > 0, "WORD_OR_SYLLABLE_INSERTION"),
        F.when((k > 0) & (a != b) & (F.right(a, k) != F.right(b, k)), "ENDING_SUBSTITUTION"),
    ))


def failure_candidates(errors: Column) -> Column:
    """Failure types from observed errors: bias for standard forms; model for anything but a border; else decoding."""
    acting = F.filter(errors, lambda e: ~e.isin("NO_ERROR", "AMBIGUOUS_VARIANT"))
    model = F.exists(acting, lambda e: ~e.isin("WORD_BOUNDARY_ERROR", "DIALECT_TO_STANDARD"))
    border = F.array_contains(acting, "WORD_BOUNDARY_ERROR")
    return F.array_compact(F.array(F.when(F.array_contains(acting, "DIALECT_TO_STANDARD"), "LANGUAGE_MODEL_BIAS"), F.when(model, "MODEL").when(border, "DECODING")))


def human_agreement(automatic: Column, verdict: Column, confirmed: Column) -> Column:
    none = F.size(automatic) == 0
    return (
        F.when(verdict == "uncertain", "UNCERTAIN").when((verdict == "rejected") & none, "NO_ERROR_AGREEMENT").when(verdict == "rejected", "FALSE_POSITIVE")
        .when(none, "MISSED").when(F.arrays_overlap(automatic, confirmed), "MATCH").otherwise("MISMATCH")
    )


def attach_rules(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """labels with the rule of their surface form; ``rule_count`` above 1 is an error of the table of rules, and the least rule as JSON is taken."""
    rule = F.struct("variants", "standards")
    one = rules.groupBy("surface_form").agg(F.min_by(rule, F.to_json(rule)).alias("_rule"), F.count("*").alias("rule_count"))
    return labels.join(one.select("surface_form", "_rule.variants", "_rule.standards", "rule_count"), "surface_form", "left")


def calibrated_aggregate(results: DataFrame) -> DataFrame:
    """results (match_kind, observed_error): counts, and rates among the expressions that are not ambiguous."""
    kind, error = F.col("match_kind"), F.col("observed_error")
    total, unclear = F.count("*"), F.count_if(error == "AMBIGUOUS_VARIANT")
    exact, good, standard = F.count_if(kind == "EXACT_SURFACE"), F.count_if((kind == "ACCEPTABLE_VARIANT") & (error == "NO_ERROR")), F.count_if(kind == "STANDARD_EQUIVALENT")
    return results.agg(
        total.alias("expressions"), exact.alias("exact"), good.alias("approved_variants"), standard.alias("standard"), F.count_if(kind == "MISSING").alias("missing"), unclear.alias("ambiguous"),
        F.round(ratio(exact + good, total - unclear, 1.0), 6).alias("preservation_rate"), F.round(ratio(standard, total - unclear, 0.0), 6).alias("overcorrection_rate"),
    )


def human_agreement_summary(cases: DataFrame) -> DataFrame:
    outcomes = ("MATCH", "MISMATCH", "MISSED", "FALSE_POSITIVE", "NO_ERROR_AGREEMENT", "UNCERTAIN")
    return cases.agg(*[F.count_if(F.col("agreement") == o).alias(o.lower()) for o in outcomes])


def report_identity(report: DataFrame, experiment: DataFrame) -> DataFrame:
    """Fields in which a report differs from its experiment, and whether there is just one report of it."""
    fields = [c for c in report.columns if c != "experiment_id" and c in experiment.columns]
    b = experiment.select("experiment_id", *[F.col(c).alias(f"_{c}") for c in fields])
    n = report.groupBy("experiment_id").agg(F.count("*").alias("reports"))
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in fields]))
    return report.join(b, "experiment_id", "left").join(n, "experiment_id").select("experiment_id", "reports", F.array_join(differ, ",").alias("differs"))


def matching_profile(experiments: DataFrame, profiles: DataFrame) -> DataFrame:
    """experiments (experiment_id, benchmark_id, benchmark_version) with the latest profile of the same benchmark and version.

    profiles: revision_id, benchmark_id, benchmark_version, created_at, rules.  Ties by revision id; without one the revision is
    NO_PROFILE and rules are null.
    """
    keyed = profiles.withColumn("_key", F.struct("benchmark_id", "benchmark_version"))
    last = latest_by(keyed, "_key", "created_at", "revision_id").select("benchmark_id", "benchmark_version", "revision_id", "rules")
    return experiments.join(last, ["benchmark_id", "benchmark_version"], "left").withColumn("revision_id", F.coalesce("revision_id", F.lit(NO_PROFILE)))


def recalibration_input(entries: DataFrame, predictions: DataFrame, cases: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, violations): entries with their prediction, source case and latest review, which must cover the same utterances.

    entries: utterance_id and more; predictions: prediction_id, utterance_id, hypothesis; cases: utterance_id, cer; reviews: review_id,
    prediction_id, utterance_id, verdict, confirmed_failure_types, created_at.  Violations: missing, unexpected and duplicate ids of
    predictions and cases, predictions without a review, and reviews of another utterance.
    """
    latest = latest_by(reviews, "prediction_id", "created_at", "review_id").select("prediction_id", F.col("utterance_id").alias("_of"), "review_id", "verdict", "confirmed_failure_types")
    found = [coverage_check(entries, df, "utterance_id").select(F.concat(F.lit(f"{name}_"), "rule").alias("rule"), "key") for name, df in (("prediction", predictions), ("case", cases))]
    reviewed = predictions.join(latest, "prediction_id", "left")
    found.append(reviewed.where("review_id is null").select(F.lit("review_missing").alias("rule"), F.col("utterance_id").cast("string").alias("key")))
    found.append(reviewed.where("_of <> utterance_id").select(F.lit("review_of_another").alias("rule"), F.col("utterance_id").cast("string").alias("key")))
    rows = entries.join(reviewed.where("review_id is not null").drop("_of"), "utterance_id").join(cases.select("utterance_id", F.col("cer").alias("source_cer")), "utterance_id")
    return rows, found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
