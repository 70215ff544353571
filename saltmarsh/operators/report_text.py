"""Reports as text, one row a line: experiments side by side, cases of any number, numbers with fixed decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(c: Column) -> Column:
    """A text as a table's cell: bars escaped, line ends as spaces, nothing around it; null is empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\n", " "))


def decimals(c: Column, n: int) -> Column:
    """A number with n decimals, halves away from zero; a dash for null."""
    scale = 10**n
    away = F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale
    return F.when(c.isNotNull(), F.format_string(f"%.{n}f", away)).otherwise("-")


def _line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _numbered(df: DataFrame, part: int, lines: list[Column]) -> DataFrame:
    rows = df.select("experiment_id", F.posexplode(F.array_compact(F.array(*lines))).alias("at", "line"))
    return rows.select("experiment_id", F.lit(part).alias("part"), F.col("at").cast("string").alias("position"), "line")


def _statuses(matches: Column) -> Column:
    told = F.array_join(F.transform(matches, lambda m: F.concat(m["surface_form"], F.lit(":"), m["match_status"])), ", ")
    return F.when(F.coalesce(told, F.lit("")) == "", "no expression").otherwise(told)


def _joined(names: Column, none: str) -> Column:
    told = F.coalesce(F.array_join(names, ", "), F.lit(""))
    return F.when(told == "", none).otherwise(told)


def review_report(experiments: DataFrame, cases: DataFrame) -> DataFrame:
    """(experiment_id, part, position, line) of reports of reviewed experiments; in order of part and position they are the text.

    experiments, a row each: experiment_id, title, benchmark, model, checkpoint, source_report_id, utterance_count, cer, dialect_preservation_rate,
    context_overcorrection_rate, high_confidence_wrong_count, p50_latency_ms, p95_latency_ms, reviewed, revisions, confirmed, rejected,
    uncertain, failure_types (array of ``name n``), limitations (array), gate_decision.  cases: experiment_id, case_id, reference, hypothesis, cer, matches
    (array of surface_form, match_status), verdict, confirmed_failure_types, notes.  A case is a row of its own, so a report may have any number.
    """
    c = F.col
    named = lambda name, value: F.concat(F.lit(f"- {name}: "), value.cast("string"))
    code = lambda name, value: F.concat(F.lit(f"- {name}: `"), F.coalesce(value.cast("string"), F.lit("not recorded")), F.lit("`"))
    head = [
        c("title"), F.lit("## Experiment"), code("Experiment", c("experiment_id")), code("Benchmark", c("benchmark")), code("Model", c("model")), code("Checkpoint", c("checkpoint")), code("Source report", c("source_report_id")),
        F.lit("## Automatic evaluation"), named("Utterances", c("utterance_count")), named("CER", decimals(c("cer"), 4)), named("Dialect preservation", decimals(c("dialect_preservation_rate"), 4)),
        named("Context overcorrection", decimals(c("context_overcorrection_rate"), 4)), named("High-confidence wrong", c("high_confidence_wrong_count")),
        F.concat(F.lit("- Latency p50/p95: "), decimals(c("p50_latency_ms"), 2), F.lit(" / "), decimals(c("p95_latency_ms"), 2), F.lit(" ms")),
        F.lit("## Human review"), named("Latest reviews", c("reviewed")), named("All revisions", c("revisions")), F.concat(F.lit("- Confirmed / rejected / uncertain: "), F.concat_ws(" / ", *[c(x).cast("string") for x in ("confirmed", "rejected", "uncertain")])),
        named("Confirmed failure types", _joined(c("failure_types"), "none")), F.lit("## Cases"), F.lit("| Reference | Hypothesis | CER | Expressions | Verdict | Failure types | Notes |"), F.lit("|---|---|---:|---|---|---|---|"),
    ]
    lines = cases.select(
        "experiment_id", F.lit(1).alias("part"), c("case_id").cast("string").alias("position"),
        _line(cell(c("reference")), cell(c("hypothesis")), decimals(c("cer"), 3), cell(_statuses(c("matches"))), F.coalesce("verdict", F.lit("not reviewed")), cell(_joined(c("confirmed_failure_types"), "none")), cell(c("notes"))).alias("line"),
    )
    notes = experiments.select("experiment_id", F.posexplode(F.concat(F.array(F.lit("## Limitations")), F.transform("limitations", lambda x: F.concat(F.lit("- "), x)), F.array(F.lit("## Decision"), F.concat(F.lit("`"), F.col("gate_decision"), F.lit("`"))))).alias("at", "line"))
    end = notes.select("experiment_id", F.lit(2).alias("part"), F.lpad(F.col("at").cast("string"), 4, "0").alias("position"), "line")
    first = _numbered(experiments, 0, head)
    return first.withColumn("position", F.lpad("position", 4, "0")).unionByName(lines).unionByName(end)


def calibrated_report(experiments: DataFrame, cases: DataFrame) -> DataFrame:
    """(experiment_id, part, position, line): automatic against calibrated rates, agreement with people, and each case.

    experiments: experiment_id, evaluation_revision, source_report_id, cer, dialect_preservation_rate, context_overcorrection_rate (as first evaluated), expressions,
    preservation_rate, overcorrection_rate, ambiguous (calibrated), match, mismatch, missed, false_positive, no_error_agreement, uncertain.  cases:
    experiment_id, case_id, reference, hypothesis, matches, observed (array), causes (array), verdict, confirmed_failure_types, agreement.
    """
    c = F.col
    code = lambda name, value: F.concat(F.lit(f"- {name}: `"), F.coalesce(value.cast("string"), F.lit("not recorded")), F.lit("`"))
    row = lambda name, a, b: _line(F.lit(name), a, b)
    count = lambda name, column: F.concat(F.lit(f"- {name}: "), c(column).cast("string"))
    head = [
        F.lit("# Calibrated evaluation"), code("Experiment", c("experiment_id")), code("Evaluation revision", c("evaluation_revision")), code("Source report", c("source_report_id")), F.lit("| Measure | Automatic | Calibrated |"), F.lit("|---|---:|---:|"),
        row("CER", decimals(c("cer"), 4), decimals(c("cer"), 4)), row("Dialect preservation", decimals(c("dialect_preservation_rate"), 4), decimals(c("preservation_rate"), 4)),
        row("Context overcorrection", decimals(c("context_overcorrection_rate"), 4), F.concat(decimals(c("overcorrection_rate"), 4), F.lit(" (candidates)"))), row("Expressions", c("expressions").cast("string"), (c("expressions") - c("ambiguous")).cast("string")),
        row("Ambiguous variants", F.lit("0"), c("ambiguous").cast("string")), F.lit("## Automatic causes against the latest reviews"), count("Match", "match"), count("Mismatch", "mismatch"), count("Missed", "missed"), count("False positive", "false_positive"),
        count("No error on either side", "no_error_agreement"), count("Uncertain", "uncertain"), F.lit("## Cases"), F.lit("| Reference | Hypothesis | Automatic | Observed | Causes | Review | Agreement |"), F.lit("|---|---|---|---|---|---|---|"),
    ]
    types = F.coalesce(F.array_join("confirmed_failure_types", ","), F.lit(""))
    review = F.concat(F.coalesce("verdict", F.lit("not reviewed")), F.when(types != "", F.concat(F.lit(":"), types)).otherwise(""))
    lines = cases.select(
        "experiment_id", F.lit(1).alias("part"), c("case_id").cast("string").alias("position"),
        _line(cell(c("reference")), cell(c("hypothesis")), cell(_statuses(c("matches"))), cell(_joined(F.filter("observed", lambda e: e != "NO_ERROR"), "NO_ERROR")), cell(_joined(c("causes"), "unknown")), cell(review), F.coalesce("agreement", F.lit("-"))).alias("line"),
    )
    return _numbered(experiments, 0, head).withColumn("position", F.lpad("position", 4, "0")).unionByName(lines)
