"""Contract checks: each gives the rows that break a rule, as (rule, key, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The failure types that a review may confirm.
FAILURE_TYPES = ("DATA", "LABEL", "AUDIO", "TOKENIZER", "MODEL", "DECODING", "LANGUAGE_MODEL_BIAS", "CALIBRATION")
SHA256 = "^[0-9a-f]{64}$"


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each row of df and rule that holds of it; rules say what is wrong.  A null condition is no violation."""
    broken = F.array_compact(F.array(*[F.when(wrong, F.lit(rule)) for rule, wrong in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def stripped(df: DataFrame) -> DataFrame:
    """df with the white space around its texts taken off."""
    return df.select(*[F.regexp_replace(f.name, r"(?U)^\s+|\s+$", "").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def strict_fields(df: DataFrame, column: str, schema: T.StructType, key: str) -> DataFrame:
    """Rows whose JSON text has fields that the schema doesn't name; those of nested objects are told by their path."""

    def unknown_in(text: Column, struct: T.StructType, path: str) -> list[Column]:
        own = F.transform(F.array_except(F.json_object_keys(text), F.lit([f.name for f in struct.fields])), lambda k: F.concat(F.lit(path), k))
        found = [F.coalesce(own, F.array().cast("array<string>"))]
        for f in struct.fields:
            if isinstance(f.dataType, T.StructType):
                found += unknown_in(F.get_json_object(text, f"$.{f.name}"), f.dataType, f"{path}{f.name}.")
        return found

    unknown = F.concat(*unknown_in(F.col(column), schema, ""))
    return df.select(F.lit("unknown_fields").alias("rule"), F.col(key).cast("string").alias("key"), F.array_join(unknown, ",").alias("detail")).where("detail <> ''")


def confidence_consistency(supported: Column, confidence: Column) -> Column:
    return supported != confidence.isNotNull()


def bad_sha(value: Column) -> Column:
    return value.isNull() | ~value.rlike(SHA256)


def out_of_range(value: Column, least: float, most: float) -> Column:
    return value.isNull() | ~value.between(least, most)


def consent_gate(df: DataFrame, *flags: str) -> DataFrame:
    """Rows for which every named consent was given."""
    cond = F.lit(True)
    for f in flags:
        cond &= F.coalesce(F.col(f), F.lit(False))
    return df.where(cond)


def label_status_gate(df: DataFrame, approved_only: bool = False) -> DataFrame:
    return df.where(F.col("label_status").isin("approved") if approved_only else F.col("label_status").isin("human_reviewed", "approved"))


def safe_relative_path(path: Column) -> Column:
    """Neither absolute nor with a drive, a backslash, or a segment that is empty, . or .."""
    parts = F.split(path, "/")
    return path.isNotNull() & (path != "") & ~path.rlike(r"^/|\\|^[A-Za-z]:") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def audio_path(path: Column) -> Column:
    return safe_relative_path(path) & path.rlike(r"^derived/asr_16k_mono/.+\.wav$")


def review_contract(reviews: DataFrame) -> DataFrame:
    types, verdict = F.col("confirmed_failure_types"), F.col("verdict")
    return violations(reviews, "review_id", {
        "unknown_failure_type": F.size(F.array_except(types, F.lit(list(FAILURE_TYPES)))) > 0,
        "types_without_confirmation": (F.size(types) > 0) & (verdict != "confirmed"),
        "uncertain_without_notes": (verdict == "uncertain") & (F.trim(F.coalesce("notes", F.lit(""))) == ""),
    })


def training_entry_contract(entries: DataFrame) -> DataFrame:
    lineage = F.col("lineage")
    return violations(entries, "utterance_id", {
        "split": ~F.col("split").isin("train", "validation"),
        "lineage_without_original": ~F.array_contains(lineage, F.col("original_audio_sha256")),
        "lineage_without_asr": ~F.array_contains(lineage, F.col("asr_audio_sha256")),
        "lineage_repeats": F.size(F.array_distinct(lineage)) < F.size(lineage),
    })


def manifest_shape(entries: DataFrame, expected: int, benchmark: tuple[str, str] | None = None) -> DataFrame:
    """Violations of a manifest's shape: count, unique ids and paths; with ``benchmark`` (id, version) also these, and frozen."""
    n = [F.count("*").alias("n"), F.countDistinct("utterance_id").alias("ids"), F.countDistinct("audio_path").alias("paths")]
    rules = {"count": F.col("n") != expected, "ids_repeat": F.col("ids") < F.col("n"), "paths_repeat": F.col("paths") < F.col("n")}
    if benchmark is not None:
        n += [F.count_if(~F.coalesce("frozen", F.lit(False))).alias("thawed"), F.count_if(~(F.col("benchmark_id").eqNullSafe(F.lit(benchmark[0])) & F.col("benchmark_version").eqNullSafe(F.lit(benchmark[1])))).alias("others")]
        rules |= {"not_frozen": F.col("thawed") > 0, "other_benchmark": F.col("others") > 0}
    return violations(entries.agg(*n).withColumn("manifest", F.lit("manifest")), "manifest", rules)


def heldout_contract(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return violations(df, "dataset_id", {
        "not_frozen": ~F.col("frozen"), "training_allowed": F.col("training_allowed"), "selection_allowed": F.col("checkpoint_selection_allowed"), "kind": ~F.col("kind").isin(*kinds),
    })


def inference_view(entries: DataFrame) -> DataFrame:
    """Held-out entries as inference may see them: without the reference texts."""
    return entries.drop("surface_text", "normalized_meaning", "dialect_expressions")


def prediction_metadata(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Rows whose model fields differ from the expected ones (null is a difference), or that claim confidence."""
    rules = {f"model_{k}": ~F.col(f"model.{k}").eqNullSafe(F.lit(v)) for k, v in expected.items()}
    return violations(df, "utterance_id", rules | {"confidence_supported": F.col("confidence_supported")})


def audio_contract(headers: DataFrame, tolerance_s: float = 0.02) -> DataFrame:
    return violations(headers, "path", {
        "corrupt": F.col("error").isNotNull(), "rate": F.col("rate") != 16_000, "channels": F.col("channels") != 1, "width": F.col("width") != 2, "compressed": F.col("format") != 1, "empty": F.col("frames") == 0,
        "duration": F.abs(F.col("declared_s") - F.col("frames") / F.col("rate")) > tolerance_s,
    })


def blinding_check(queue: DataFrame, names: tuple[str, ...], key: str = "item_id") -> DataFrame:
    """Queue rows in which a model's name shows anywhere, whatever the case."""
    text = F.lower(F.to_json(F.struct("*")))
    return queue.select(F.col(key), F.filter(F.lit([n.lower() for n in names]), lambda n: F.contains(text, n)).alias("names")).where(F.size("names") > 0)


def diagnostic_class(audio_ok: Column, extracted: Column, returned_empty: Column, reproduced: Column) -> Column:
    """The first rule that applies: audio, extraction, empty return, not reproduced; else unresolved."""
    return F.when(~audio_ok, "AUDIO_CONTRACT").when(~extracted, "EXTRACTION").when(returned_empty, "RETURNED_EMPTY").when(~reproduced, "NOT_REPRODUCED").otherwise("UNRESOLVED")


def review_decisions(decisions: DataFrame, current: DataFrame, frozen: DataFrame) -> DataFrame:
    """decisions (utterance_id, status, surface_text) against the current labels: accepted, or why not."""
    known = current.select("utterance_id", F.col("label_status").alias("was"), F.col("surface_text").alias("old"))
    locked = frozen.select("utterance_id").distinct().withColumn("locked", F.lit(True))
    both = decisions.join(known, "utterance_id", "left").join(locked, "utterance_id", "left")
    same = (F.col("was") == F.col("status")) & F.coalesce("surface_text", "old").eqNullSafe(F.col("old"))
    outcome = F.when(F.col("was").isNull(), "unknown").when(F.col("locked"), "frozen").when(~F.col("status").isin("human_reviewed", "approved", "rejected"), "bad status").when(same, "unchanged").otherwise("accepted")
    return both.select("utterance_id", "status", F.col("surface_text").alias("new_text"), outcome.alias("outcome"))
