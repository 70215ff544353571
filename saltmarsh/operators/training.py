"""From utterance records to manifests, training entries, recording imports and the training pool.

An utterance record has utterance_id, speaker_id, region, environment, source, dataset_split, surface_text, normalized_meaning,
label_status, label_version, dialect_expressions, the consents storage_allowed, research_use_allowed and model_training_allowed,
policy_version, quality_passed, and the audio assets original, derived, master (or null) and derivatives (array), each a struct with
role, sha256, relative_path and duration_ms.  Checks give violations (rule, key, detail) and never raise on data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import surface_key
from .contracts import violations
from .governance import asset_for_role, coverage_check

SPLITS = ("train", "validation", "test")
CONSENTS = ("storage_allowed", "research_use_allowed", "model_training_allowed")


def first_seen(values: Column) -> Column:
    """The distinct values of an array in the order of their first occurrence."""
    return F.array_distinct(values)


def lineage_assets(original: Column, derived: Column, master: Column, derivatives: Column) -> Column:
    """All assets of a leakage check: original and derived, or where there is a master, original, master and all derivatives."""
    return F.when(master.isNull(), F.array(original, derived)).otherwise(F.concat(F.array(original, master), F.coalesce(derivatives, F.array())))


def _lineage_hashes() -> Column:
    assets = lineage_assets(F.col("original"), F.col("derived"), F.col("master"), F.col("derivatives"))
    return F.transform(assets, lambda a: a["sha256"])


def audio_quality_gate(records: DataFrame) -> DataFrame:
    """Records whose audio passed its quality checks; null is no pass."""
    return records.where(F.coalesce("quality_passed", F.lit(False)))


def build_manifest(records: DataFrame, benchmark_id: str, benchmark_version: str, split: str) -> DataFrame:
    """Records as entries of a benchmark in one split; the lineage keeps repeated hashes."""
    if split not in SPLITS:
        raise ValueError("a benchmark manifest needs a split")
    return records.select(
        F.lit(benchmark_id).alias("benchmark_id"), F.lit(benchmark_version).alias("benchmark_version"), "utterance_id", "speaker_id", F.lit(split).alias("split"), F.col("original.sha256").alias("original_audio_sha256"),
        F.col("derived.sha256").alias("derived_audio_sha256"), F.col("derived.relative_path").alias("derived_audio_path"), _lineage_hashes().alias("lineage_audio_sha256s"), "surface_text", "normalized_meaning", "dialect_expressions",
    )


def training_violations(records: DataFrame) -> DataFrame:
    """What keeps records from becoming training entries."""
    return violations(records, "utterance_id", {
        "no_training_consent": ~F.coalesce("model_training_allowed", F.lit(False)),
        "label_not_reviewed": ~F.coalesce(F.col("label_status").isin("human_reviewed", "approved"), F.lit(False)),
        "audio_quality": ~F.coalesce("quality_passed", F.lit(False)),
    })


def build_training_entries(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """Training entries of the assigned (utterance_id, split) records that have no violation; lineage in first-seen order."""
    asr = asset_for_role(F.col("derivatives"), "asr_16k_mono", F.col("derived"))
    good = records.join(training_violations(records).select(F.col("key").alias("_bad")).distinct(), F.col("utterance_id").cast("string") == F.col("_bad"), "left_anti")
    return good.join(assignments.select("utterance_id", "split"), "utterance_id").select(
        "utterance_id", "speaker_id", "split", "region", F.col("environment").alias("recording_environment"), F.col("original.sha256").alias("original_audio_sha256"), asr["sha256"].alias("asr_audio_sha256"), asr["relative_path"].alias("asr_audio_path"),
        first_seen(_lineage_hashes()).alias("audio_lineage_sha256s"), asr["duration_ms"].alias("duration_ms"), "surface_text", "label_status", "label_version", "dialect_expressions", F.col("policy_version").alias("consent_policy_version"),
    )


def import_plan(prompts: DataFrame, recordings: DataFrame, frozen: DataFrame, first: int, last: int, speaker_id: str, consent: dict[str, bool], required: str) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of an import of the recordings ``first`` to ``last``; it passes if there are no errors.

    prompts: number, text; recordings: name, number, status (ok, unexpected, unsupported, duplicate), length, sha256; frozen: the
    entries of the frozen benchmarks with benchmark (id@version), speaker_id, lineage (array of hashes) and surface_text.
    """
    spark = prompts.sparkSession
    numbers = spark.range(first, last + 1).select(F.col("id").cast("int").alias("number"))

    def error(df: DataFrame, rule: str, key: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))

    def said(rule: str, key: str, holds: bool) -> DataFrame:
        return error(spark.range(1).where(F.lit(holds)), rule, F.lit(key))

    found = recordings.where("status = 'ok'")
    wanted = prompts.groupBy("number").agg(F.min("text").alias("text"))
    mapped = numbers.join(found, "number").join(wanted, "number")
    usable = mapped.where("length > 0")
    hashes = frozen.select(F.explode("lineage").alias("sha256")).distinct()
    surfaces = frozen.select(surface_key(F.col("surface_text")).alias("surface")).distinct()
    items = usable.select(F.format_string("T004-S%03d", "number").alias("prompt_id"), F.col("name").alias("source_filename"), F.col("sha256").alias("source_audio_sha256"), F.col("text").alias("candidate_surface_text"))
    n_items = items.agg(F.count("*").alias("n")).where(F.col("n") != last - first + 1)
    speakers = frozen.where(F.col("speaker_id") == speaker_id).select("speaker_id").distinct()
    checked = frozen.agg(F.count_if(F.col("benchmark") == required).alias("n")).where("n = 0")
    twice = items.groupBy("source_audio_sha256").agg(F.count("*").alias("n")).where("n > 1")
    rules = [
        error(recordings.where("status <> 'ok'"), "recording", F.concat_ws(": ", "status", "name")), error(numbers.join(found, "number", "left_anti"), "missing_recording", F.col("number")),
        error(found.join(numbers, "number", "left_anti"), "outside_range", F.col("number")), error(numbers.join(wanted, "number", "left_anti"), "missing_prompt", F.col("number")),
        error(checked, "benchmark_not_checked", F.lit(required)), error(speakers, "speaker_in_benchmark", F.col("speaker_id")), *[said("consent", c, not consent.get(c, False)) for c in CONSENTS],
        error(mapped.where("length <= 0"), "empty_recording", F.col("name")), error(usable.join(hashes, "sha256", "left_semi"), "audio_in_benchmark", F.col("name")),
        error(usable.withColumn("surface", surface_key(F.col("text"))).join(surfaces, "surface", "left_semi"), "surface_in_benchmark", F.col("number")), error(twice, "duplicate_audio", F.col("source_audio_sha256")), error(n_items, "mapped_count", F.col("n")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return items, out


def resumable_import_check(items: DataFrame, records: DataFrame, speaker_id: str) -> DataFrame:
    """Records that exist already and differ from the plan's item (utterance_id, prompt_id, hash and text) of the same id."""
    planned = items.select("utterance_id", "prompt_id", F.col("source_audio_sha256").alias("_sha"), F.col("candidate_surface_text").alias("_text"))
    same = (F.col("source") == "import") & (F.col("speaker_id") == speaker_id) & (F.col("dataset_split") == "train") & (F.col("original.sha256") == F.col("_sha")) & F.col("surface_text").eqNullSafe(F.col("_text")) & (F.col("label_status") == "candidate")
    both = records.join(planned, "utterance_id").where(~F.coalesce(same, F.lit(False)))
    return both.select(F.lit("record_differs").alias("rule"), F.col("prompt_id").alias("key"))


def import_review_queue(ledger: DataFrame, utterances: DataFrame) -> DataFrame:
    """The entries of an import's ledger (import_id, entry: its order, prompt_id, utterance_id ...) with position and today's label."""
    labels = utterances.select("utterance_id", "surface_text", "label_status", "label_version")
    position = F.row_number().over(Window.partitionBy("import_id").orderBy("entry"))
    return ledger.withColumn("position", position).join(labels, "utterance_id")


def import_summaries(imports: DataFrame) -> DataFrame:
    """(import_id, created_at, speaker_id, entry_count) of imports given by entry, the newest first, ties by id."""
    one = imports.groupBy("import_id").agg(F.max("created_at").alias("created_at"), F.max("speaker_id").alias("speaker_id"), F.count("*").alias("entry_count"))
    return one.orderBy(F.desc("created_at"), "import_id")


def train_pool(ledger: DataFrame, records: DataFrame, frozen: DataFrame, files: DataFrame, speaker_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows, violations) of a training pool: the ledger's records, with every gate applied.

    frozen: utterance_id, speaker_id, lineage (array), surface_text; files: path, sha256.  A row goes into the pool if it breaks no
    rule.  Of records with one audio hash none does.
    """
    own = ledger.select("utterance_id").distinct().join(records, "utterance_id").withColumn("lineage", _lineage_hashes()).withColumn("surface", surface_key(F.col("surface_text")))
    own = own.withColumn("path", F.col("derived.relative_path")).withColumn("audio", F.col("derived.sha256"))

    def flag(df: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
        return df.join(known.where(F.col(key).isNotNull()).select(key).distinct().withColumn(name, F.lit(True)), key, "left")

    own = flag(own, frozen, "utterance_id", "_known")
    own = flag(own, frozen, "speaker_id", "_voice")
    own = flag(own, frozen.select(surface_key(F.col("surface_text")).alias("surface")).where("surface <> ''"), "surface", "_said")
    leaked = own.select("utterance_id", F.explode("lineage").alias("sha")).join(frozen.select(F.explode("lineage").alias("sha")).distinct(), "sha", "left_semi")
    own = flag(own, leaked, "utterance_id", "_leaked")
    own = flag(own, own.groupBy("audio").agg(F.count("*").alias("n")).where("n > 1"), "audio", "_twice")
    own = own.join(files.groupBy("path").agg(F.min("sha256").alias("_file")), "path", "left")
    consent = F.lit(True)
    for c in CONSENTS:
        consent &= F.coalesce(F.col(c), F.lit(False))
    broken = violations(own, "utterance_id", {
        "utterance_in_benchmark": F.col("_known"), "speaker_in_benchmark": F.col("_voice"), "audio_in_benchmark": F.col("_leaked"), "surface_in_benchmark": F.col("_said"), "speaker": ~F.col("speaker_id").eqNullSafe(F.lit(speaker_id)),
        "split": ~F.col("dataset_split").eqNullSafe(F.lit("train")), "label_not_approved": ~F.col("label_status").eqNullSafe(F.lit("approved")), "consent": ~consent, "audio_quality": ~F.coalesce("quality_passed", F.lit(False)),
        "audio_missing": F.col("_file").isNull(), "audio_hash": F.col("_file") != F.col("audio"), "duplicate_audio": F.col("_twice"),
    })
    absent = coverage_check(ledger, records.join(ledger.select("utterance_id").distinct(), "utterance_id", "left_semi"), "utterance_id").select("rule", "key")
    good = own.join(broken.select(F.col("key").alias("_bad")).distinct(), F.col("utterance_id").cast("string") == F.col("_bad"), "left_anti")
    rows = good.select(
        F.concat(F.lit("audio/"), F.col("utterance_id").cast("string"), F.lit(".wav")).alias("audio_filepath"), (F.col("derived.duration_ms") / 1000).alias("duration"), F.col("surface_text").alias("text"), "speaker_id", "utterance_id",
        F.col("audio").alias("audio_sha256"), F.lit("train").alias("split"),
    )
    return rows, broken.unionByName(absent)


def train_pool_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("train_utterance_count"), F.round(F.coalesce(F.sum("duration"), F.lit(0.0)), 6).alias("total_duration_seconds"))


def review_decisions_applied(decisions: DataFrame, current: DataFrame) -> DataFrame:
    """The next label revision of each accepted decision (contracts.review_decisions): status, text and version counted on."""
    number = F.regexp_extract("label_version", r"(\d+)$", 1).try_cast("int")
    now = current.select("utterance_id", F.coalesce(number, F.lit(0)).alias("_n"), F.col("surface_text").alias("_text"))
    accepted = decisions.where("outcome = 'accepted'").select("utterance_id", "status", "new_text")
    return accepted.join(now, "utterance_id").select("utterance_id", F.col("status").alias("label_status"), F.coalesce("new_text", "_text").alias("surface_text"), F.concat(F.lit("label_v"), F.col("_n") + 1).alias("label_version"))
