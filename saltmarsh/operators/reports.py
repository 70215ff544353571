"""Aggregates over scored cases, reviews and arms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import rtf
from .percentiles import exact_percentiles


def ratio(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(F.coalesce(bottom, F.lit(0)) == 0, F.lit(empty)).otherwise(top / bottom)


def _with_percentiles(sums: DataFrame, df: DataFrame, value: str, names: dict[str, float], *by: str) -> DataFrame:
    """One row for each group: sums of df, and beside them percentiles of a column."""
    p = exact_percentiles(df, value, names, *by)
    if not by:
        return sums.join(p, F.lit(True), "left")  # one row each
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by])
    return sums.alias("a").join(p.alias("b"), same, "left").select(*[F.col(f"a.{c}") for c in sums.columns], *[F.col(f"b.{n}") for n in names])


def corpus_cer() -> Column:
    """Edits over reference characters of all cases; the edits themselves where there are no characters, 0 without cases."""
    chars, edits = F.coalesce(F.sum("ref_chars"), F.lit(0)), F.coalesce(F.sum("edits"), F.lit(0))
    return F.when(chars == 0, edits.cast("double")).otherwise(edits / chars)


def aggregate_report(cases: DataFrame, *by: str) -> DataFrame:
    """One row (or one for each group): counts, error rate, expression rates, confident errors, latency percentiles.

    cases: edits, ref_chars, high_confidence_wrong, latency_ms, expressions, preserved, overcorrected.  Every case needs a latency: cases
    without a number of at least 0 are counted in ``missing_latency_count`` (latency_violations() names them), and a report that has any is not to
    be published.
    """
    sums = cases.groupBy(*by).agg(
        F.count("*").alias("utterance_count"), F.round(corpus_cer(), 6).alias("cer"),
        F.round(ratio(F.sum("preserved"), F.sum("expressions"), 1.0), 6).alias("dialect_preservation_rate"),
        F.round(ratio(F.sum("overcorrected"), F.sum("expressions"), 0.0), 6).alias("context_overcorrection_rate"),
        F.count_if("high_confidence_wrong").alias("high_confidence_wrong_count"), F.count_if(_no_latency()).alias("missing_latency_count"),
    )
    p = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}
    return _with_percentiles(sums, cases, "latency_ms", p, *by).withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in p})


def _no_latency() -> Column:
    return F.col("latency_ms").isNull() | F.isnan("latency_ms") | (F.col("latency_ms") < 0)


def latency_violations(cases: DataFrame, key: str) -> DataFrame:
    """(rule, key) of the cases without a usable latency."""
    return cases.where(_no_latency()).select(F.lit("latency_missing").alias("rule"), F.col(key).cast("string").alias("key"))


def latency_percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Exact median and 95th percentile with linear interpolation."""
    out = _with_percentiles(df.groupBy(*by).agg(F.count(value).alias("n")), df, value, {"p50": 0.5, "p95": 0.95}, *by)
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


def group_cer(cases: DataFrame, *by: str, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Error rates by sets of the columns ``by``: each of ``sets``, or by default every prefix, down to none.

    ``level`` tells them apart: bit i from the right is set where the i-th column from the right is summed over.  A null key with its
    bit unset is a group of its own.
    """
    sets = [by[:n] for n in range(len(by) + 1)] if sets is None else sets
    grouped = cases.groupingSets([[F.col(c) for c in s] for s in sets], *by)
    return grouped.agg(F.count("*").alias("cases"), F.round(corpus_cer(), 6).alias("cer"), F.grouping_id().cast("long").alias("level"))


def failure_type_counts(reviews: DataFrame) -> DataFrame:
    """Confirmed failure types by name."""
    types = reviews.where("verdict = 'confirmed'").select(F.explode("confirmed_failure_types").alias("failure_type"))
    return types.groupBy("failure_type").agg(F.count("*").alias("n")).orderBy("failure_type")


def human_review_summary(reviews: DataFrame) -> DataFrame:
    """reviews: the latest of each prediction with its ``revisions``."""
    return reviews.agg(
        F.count("*").alias("reviewed"), F.coalesce(F.sum("revisions"), F.lit(0)).alias("revisions"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("confirmed", "rejected", "uncertain")],
        F.count_if(F.array_contains("confirmed_failure_types", "LANGUAGE_MODEL_BIAS")).alias("language_model_bias"),
    )


def review_queue_counts(queue: DataFrame) -> DataFrame:
    """Rows by label status; reviewed are all but candidates."""
    n = {s: F.count_if(F.col("label_status") == s).alias(s) for s in ("candidate", "human_reviewed", "approved", "rejected")}
    return queue.agg(F.count("*").alias("total"), *n.values(), F.count_if(F.col("label_status") != "candidate").alias("reviewed"))


def compare_predictions(a: DataFrame, b: DataFrame, key: str = "utterance_id") -> DataFrame:
    """Differences b - a for one utterance in two experiments; null where either side has none."""
    fields = ("cer", "preservation", "overcorrection", "confidence")
    left = a.select(key, *[F.col(f).alias(f"{f}_a") for f in fields])
    right = b.select(key, *[F.col(f).alias(f"{f}_b") for f in fields])
    return left.join(right, key).select(key, *[F.round(F.col(f"{f}_b") - F.col(f"{f}_a"), 6).alias(f"{f}_delta") for f in fields])


def outcome_counts(deltas: DataFrame, value: str, smaller_is_better: bool = True) -> DataFrame:
    """How many rows improved, stayed equal or worsened; rows without a difference are left out."""
    d = F.col(value) if smaller_is_better else -F.col(value)
    outcome = F.when(d < 0, "improved").when(d == 0, "equal").when(d > 0, "worsened")
    return deltas.where(F.col(value).isNotNull()).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def arm_metrics(rows: DataFrame) -> DataFrame:
    """Per arm: error rate, preservation (null without expressions), blank outputs and latency. rows: arm, edits, ref_chars,
    expressions, preserved, hypothesis, latency_ms."""
    sums = rows.groupBy("arm").agg(
        F.round(corpus_cer(), 6).alias("cer"), F.round(F.try_divide(F.sum("preserved"), F.sum("expressions")), 6).alias("dialect_preservation"),
        F.count_if(F.trim("hypothesis") == "").alias("empty_outputs"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
    )
    p = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}
    return _with_percentiles(sums, rows, "latency_ms", p, "arm").withColumns({c: F.round(c, 6) for c in p})


def ab_unblind(results: DataFrame, key: DataFrame) -> DataFrame:
    """results (item_id, transcript_preference A, B, tie or uncertain) with ``winner``: the arm behind the letter."""
    joined = results.join(key.select("item_id", F.col("A").alias("arm_a"), F.col("B").alias("arm_b")), "item_id")
    p = F.col("transcript_preference")
    return joined.withColumn("winner", F.when(p == "A", F.col("arm_a")).when(p == "B", F.col("arm_b")).otherwise(p))


def ab_tally(unblinded: DataFrame, ours: str, base: str) -> DataFrame:
    """Wins, ties, uncertain and undecided items; the preference rate is null without a decisive item."""
    w = F.col("winner")
    wins, losses = F.count_if(w == ours), F.count_if(w == base)
    return unblinded.agg(
        F.count("*").alias("items"), wins.alias("wins"), losses.alias("losses"), F.count_if(w == "tie").alias("ties"), F.count_if(w == "uncertain").alias("uncertain"),
        F.count_if(w.isNull()).alias("open"), F.round(F.try_divide(wins, wins + losses), 6).alias("preference_rate"),
    )


def inference_summary(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """rows (utterance_id, status, latency_ms, duration_ms) against the expected ids: what is missing, twice or failed, and times."""
    seen = rows.groupBy("utterance_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    sets = expected.select("utterance_id").distinct().withColumn("wanted", F.lit(True)).join(seen, "utterance_id", "full_outer")
    counts = sets.agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("duplicate"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed")
    )
    done = rows.where("status <> 'failed'")
    times = done.agg(
        F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
        F.round(F.avg(rtf(F.col("latency_ms"), F.col("duration_ms"))), 6).alias("mean_rtf"),
    )
    p = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95}
    times = _with_percentiles(times, done, "latency_ms", p).withColumns({c: F.round(c, 6) for c in p})
    return counts.crossJoin(times).withColumn("status", F.when(F.expr("missing + unexpected + duplicate + failed") == 0, "complete").otherwise("incomplete"))  # one row each


def report_title(experiment_id: Column) -> Column:
    """The heading of a report: the task's number in capitals where the id begins with one."""
    task = F.upper(F.regexp_extract(experiment_id, r"(?i)^(task-\d+[a-z]?)", 1))
    return F.when(task != "", F.concat(F.lit("# "), task, F.lit(" Human-reviewed Baseline Report"))).otherwise("# Human-reviewed Surface ASR Baseline Report")


def limitations(reports: DataFrame) -> DataFrame:
    """reports with ``limitations``, the notes that apply to each.

    reports: with_confidence (cases that have one), uncertain, context_overcorrection_rate, language_model_bias (confirmed by people),
    checkpoint_identifier.
    """
    notes = F.array_compact(F.array(
        F.lit("automatic dialect results are exact matches and miss natural variants"), F.when(F.col("with_confidence") == 0, "the runtime gave no confidence"),
        F.when(F.col("uncertain") > 0, F.concat(F.col("uncertain").cast("string"), F.lit(" reviews are uncertain"))),
        F.when((F.col("context_overcorrection_rate") == 0) & (F.col("language_model_bias") > 0), F.concat(F.lit("no automatic overcorrection, but people confirmed bias of the language model in "), F.col("language_model_bias").cast("string"))),
        F.when(F.col("checkpoint_identifier").isNull(), "the checkpoint is not identified"),
    ))
    return reports.withColumn("limitations", notes)
