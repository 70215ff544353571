"""Splits, leakage, duplicates, exclusions, coverage and file audits.

Checks give violations (rule, key, detail) so that one pass finds all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_for_cer, surface_key
from .contracts import safe_relative_path


def _violation(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def coverage_check(manifest: DataFrame, predictions: DataFrame, *keys: str) -> DataFrame:
    """Violations missing, unexpected and duplicate of predictions against a manifest, by the given key columns."""
    key = F.concat_ws("/", *keys)
    have = predictions.groupBy(*keys).agg(F.count("*").alias("n"))
    both = manifest.select(*keys).distinct().withColumn("wanted", F.lit(True)).join(have, list(keys), "full_outer")
    rule = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.withColumn("rule", rule).where("rule is not null").select("rule", key.alias("key"), F.coalesce("n", F.lit(0)).cast("string").alias("detail"))


def attach_predictions(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """manifest joined to predictions by audio hash; ``agrees`` is whether the utterance is the same."""
    p = predictions.select("audio_sha256", F.col("utterance_id").alias("predicted_utterance"), "hypothesis")
    return manifest.join(p, "audio_sha256").withColumn("agrees", F.col("utterance_id") == F.col("predicted_utterance"))


def split_leaks(entries: DataFrame, *keys: str) -> DataFrame:
    """Values of each key column that occur in more than one split."""
    found = []
    for k in keys:
        groups = entries.where(F.col(k).isNotNull()).groupBy(k).agg(F.sort_array(F.collect_set("split")).alias("splits"))
        found.append(_violation(groups.where(F.size("splits") > 1), f"{k}_in_splits", F.col(k), F.array_join("splits", ",")))
    return _all(found)


def duplicate_surface_groups(entries: DataFrame, key: Column | None = None) -> DataFrame:
    """Groups of more than one utterance with the same surface key: size, least id and splits; crossing splits is an error."""
    keyed = entries.withColumn("surface", surface_key(F.col("surface_text")) if key is None else key).where("surface <> ''")
    groups = keyed.groupBy("surface").agg(F.count("*").alias("n"), F.min("utterance_id").alias("first_id"), F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"))
    return groups.where("n > 1").withColumn("level", F.when(F.contains("splits", F.lit(",")), "error").otherwise("warning"))


def duplicate_surface_members(entries: DataFrame, key: Column | None = None) -> DataFrame:
    """(surface, utterance_id, split, level) of each utterance in a group of duplicate_surface_groups(), one row each, however large the group."""
    keyed = entries.withColumn("surface", surface_key(F.col("surface_text")) if key is None else key)
    groups = duplicate_surface_groups(entries, key).select("surface", "level")
    return keyed.join(groups, "surface").select("surface", "utterance_id", "split", "level")


def duplicate_lineage(entries: DataFrame) -> DataFrame:
    """Hashes in the lineage of more than one utterance."""
    rows = entries.select("utterance_id", F.explode(F.array_distinct("lineage")).alias("sha"))
    groups = rows.groupBy("sha").agg(F.countDistinct("utterance_id").alias("n")).where("n > 1")
    return _violation(groups, "duplicate_lineage", F.col("sha"), F.col("n"))


def leakage_check(train: DataFrame, frozen: DataFrame) -> DataFrame:
    """Overlaps of training rows with frozen benchmarks by utterance, speaker, lineage hash and exact surface key.

    Both: utterance_id, speaker_id, lineage (array), surface_key; frozen also benchmark_id.  Each overlap is an error that names
    the benchmark.  Four equality joins; a null or empty key never matches.
    """
    def named(lineage: Column) -> Column:
        one = [F.struct(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("value")) for rule, c in (("utterance", "utterance_id"), ("speaker", "speaker_id"), ("surface", "surface_key"))]
        return F.explode(F.concat(F.array(*one), F.transform(F.coalesce(lineage, F.array().cast("array<string>")), lambda s: F.struct(F.lit("lineage").alias("rule"), s.cast("string").alias("value")))))

    # Each side is read once, every row as all that it may be recognised by.
    once = F.monotonically_increasing_id().alias("_row")
    ours = train.select("utterance_id", once, named(F.array_distinct("lineage")).alias("_x")).select("utterance_id", "_row", "_x.*").where("value <> '' or rule = 'lineage' and value is not null")
    theirs = frozen.select("benchmark_id", named(F.col("lineage")).alias("_x")).select("benchmark_id", "_x.*").where("value <> '' or rule = 'lineage' and value is not null").distinct()
    hits = ours.join(theirs, ["rule", "value"])
    # Several hashes of a row may be in one benchmark, and rows of one id share theirs: that is one finding.
    alone = F.when(F.col("rule") != "lineage", F.col("_row"))
    return hits.select("rule", F.col("utterance_id").cast("string").alias("key"), F.col("benchmark_id").cast("string").alias("detail"), alone.alias("_row")).dropDuplicates().drop("_row")


def exclusion_registry(*sources: tuple[DataFrame, dict[str, Column]]) -> DataFrame:
    """Distinct (kind, value) of several tables; each comes with its columns by kind."""
    rows = [df.select(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for df, kinds in sources for kind, value in kinds.items()]
    return _all(rows).where("value is not null and value <> ''").distinct()


def exclusion_check(entries: DataFrame, exclusions: DataFrame, kinds: dict[str, Column], warnings: tuple[str, ...] = ("surface",)) -> DataFrame:
    """Rows of entries whose value of a kind is excluded; level warning for the given kinds, else error."""
    found = []
    for kind, value in kinds.items():
        known = exclusions.where(F.col("kind") == kind).select(F.col("value").alias("_value"))
        hits = entries.withColumn("_value", value.cast("string")).join(known, "_value", "left_semi")
        found.append(_violation(hits, kind, F.col("utterance_id"), F.lit("warning" if kind in warnings else "error")))
    return _all(found)


def evaluation_set_check(entries: DataFrame, exclusions: DataFrame, least_utterances: float, least_speakers: float, needs_expressions: bool = False, headers: DataFrame | None = None, by: str = "dataset_id") -> DataFrame:
    """(``by``, rule, key, level) of what is wrong with held-out sets, many at once: sizes, overlaps with exclusions, files.

    entries: ``by``, utterance_id, speaker_id, source_recording_id, audio_sha256, audio_lineage (array), surface_text,
    dialect_expressions (array), audio_filepath.  exclusions: kind (speaker, utterance, recording, audio, surface) and value, surfaces
    as normalised for error rates.  headers (path, sha256, rate, channels, width, frames, error) tell of the audio files, if given.
    The same transcript is a warning, everything else an error; each finding appears once.
    """
    def found(df: DataFrame, rule: str, key: Column, level: str = "error") -> DataFrame:
        return df.select(by, F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(level).alias("level"))

    sizes = entries.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("speaker_id").alias("speakers"), F.sum(F.size(F.coalesce("dialect_expressions", F.array().cast("array<string>")))).alias("expressions"))
    out = [found(sizes.where(F.col("n") < least_utterances), "too_few_utterances", F.col("n")), found(sizes.where(F.col("speakers") < least_speakers), "too_few_speakers", F.col("speakers"))]
    if needs_expressions:
        out.append(found(sizes.where("expressions = 0"), "no_expressions", F.col(by)))

    def excluded(df: DataFrame, kind: str) -> DataFrame:
        return df.join(exclusions.where(F.col("kind") == kind).select(F.col("value").alias("_value")).distinct(), "_value", "left_semi")

    for kind, column in (("speaker", "speaker_id"), ("utterance", "utterance_id"), ("recording", "source_recording_id")):
        out.append(found(excluded(entries.withColumn("_value", F.col(column).cast("string")), kind), f"{kind}_overlap", F.col("_value")))
    lineage = F.array_append(F.coalesce("audio_lineage", F.array().cast("array<string>")), F.col("audio_sha256"))
    out.append(found(excluded(entries.select(by, "utterance_id", F.explode(lineage).alias("_value")), "audio"), "audio_overlap", F.col("utterance_id")))
    out.append(found(excluded(entries.withColumn("_value", normalize_for_cer(F.col("surface_text"))), "surface"), "surface_overlap", F.col("utterance_id"), "warning"))
    if headers is not None:
        safe = safe_relative_path(F.col("audio_filepath"))
        out.append(found(entries.where(~safe), "path_escapes", F.col("audio_filepath")))
        files = headers.select(F.col("path").alias("audio_filepath"), F.col("sha256").alias("_sha"), "rate", "channels", "width", "frames", "error")
        read = entries.where(safe).join(files, "audio_filepath", "left")
        wrong = (
            F.when(F.col("_sha").isNull(), "audio_missing").when(F.col("_sha") != F.col("audio_sha256"), "audio_hash").when(F.col("error").isNotNull(), "audio_corrupt")
            .when((F.col("rate") != 16_000) | (F.col("channels") != 1), "audio_not_16k_mono").when((F.col("width") != 2) | (F.col("frames") <= 0), "audio_not_pcm16")
        )
        bad = read.withColumn("_rule", wrong).where("_rule is not null")
        out.append(bad.select(by, F.col("_rule").alias("rule"), F.col("audio_filepath").alias("key"), F.lit("error").alias("level")))
    return _all(out).distinct()


def prepare_ab_queue(queue: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, violations) of a blinded comparison: queue (item_id, utterance_id, audio_path, A, B) with reference and expressions.

    The queue has to cover the manifest (utterance_id, surface_text, dialect_expressions) exactly once.
    """
    m = manifest.select("utterance_id", F.col("surface_text").alias("reference_surface_text"), F.transform("dialect_expressions", lambda e: e["surface_form"]).alias("dialect_expressions"))
    items = queue.join(m, "utterance_id").select("item_id", "utterance_id", "audio_path", "reference_surface_text", "dialect_expressions", F.col("A").alias("candidate_A"), F.col("B").alias("candidate_B"))
    return items, coverage_check(manifest, queue, "utterance_id")


def audio_lineage_contract(assets: DataFrame, required: tuple[str, ...] = ("original", "master", "asr_16k_mono")) -> DataFrame:
    """Violations of the assets (utterance_id, role, sha256, parent_sha256, rate, channels, codec, transformation) of utterances.

    Beside lineage_chain: required roles, one transformation for each derived asset and none for the original, and the format of the
    16 kHz mono asset.  An utterance that has only original and derived (the two-asset form) needs no master.
    """
    roles = assets.groupBy("utterance_id").agg(F.collect_set("role").alias("roles"))
    needed = F.when(F.array_contains("roles", "derived") & ~F.array_contains("roles", "master"), F.array(F.lit("original"), F.lit("derived"))).otherwise(F.lit(list(required)))
    lacking = roles.select("utterance_id", F.explode(F.array_except(needed, "roles")).alias("role"))
    steps = F.size(F.coalesce("transformation", F.array().cast("array<string>")))
    wrong = assets.withColumn("rule", F.when((F.col("role") == "original") & (steps > 0), "original_transformed").when((F.col("role") != "original") & (steps != 1), "one_transformation"))
    form = assets.where("role = 'asr_16k_mono' and not (rate <=> 16000 and channels <=> 1 and codec <=> 'pcm_s16le')")
    return _all([
        lineage_chain(assets), _violation(lacking, "role_missing", F.col("utterance_id"), F.col("role")),
        wrong.where("rule is not null").select("rule", F.col("utterance_id").cast("string").alias("key"), F.col("sha256").alias("detail")), _violation(form, "asr_format", F.col("utterance_id"), F.col("sha256")),
    ])


def training_report(entries: DataFrame) -> DataFrame:
    """Rows, distinct speakers and hours by split, and warnings on small sets."""
    hours = F.bround(F.coalesce(F.sum("duration_ms"), F.lit(0.0)) / 3_600_000, 6)
    n, speakers = F.count("*"), F.countDistinct("speaker_id")
    few = F.when(n < 300, "few rows"), F.when((F.col("split") == "validation") & (speakers < 2), "few speakers")
    return entries.groupBy("split").agg(n.alias("rows"), speakers.alias("speakers"), hours.alias("hours"), F.concat_ws("; ", *few).alias("warnings"))


def resolve_assignments(assigned: DataFrame, utterances: DataFrame) -> DataFrame:
    """assigned (utterance_id, split) with ``known``: whether the id is in the table."""
    there = utterances.select("utterance_id").distinct().withColumn("known", F.lit(True))
    return assigned.join(there, "utterance_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def is_frozen(utterances: DataFrame, *members: DataFrame) -> DataFrame:
    """The utterances that are in any of the frozen sets."""
    every = _all([m.select("utterance_id") for m in members]).distinct()
    return utterances.join(every, "utterance_id", "left_semi")


def artifact_audit(spec: DataFrame, files: DataFrame) -> DataFrame:
    """spec (path, expected_sha256) against files (path, sha256): verified, mismatch, unpinned, missing or unexpected."""
    both = spec.withColumn("named", F.lit(True)).join(files, "path", "full_outer")
    status = (
        F.when(F.col("named").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").when(F.col("expected_sha256").isNull(), "unpinned")
        .when(F.col("expected_sha256") == F.col("sha256"), "verified").otherwise("mismatch")
    )
    return both.select("path", status.alias("status"))


def map_prompts(prompts: DataFrame, recordings: DataFrame, first: int, last: int) -> DataFrame:
    """Numbers first to last with their prompt and recording, and what is missing or outside of the range."""
    numbers = prompts.sparkSession.range(first, last + 1).withColumnRenamed("id", "number").withColumn("inside", F.lit(True))
    both = numbers.join(prompts, "number", "full_outer").join(recordings, "number", "full_outer")
    status = F.when(F.col("inside").isNull(), "outside").when(F.col("prompt").isNull(), "no prompt").when(F.col("recording").isNull(), "no recording").otherwise("mapped")
    return both.select("number", "prompt", "recording", status.alias("status"))


def shared_assets(assets: DataFrame, archived: DataFrame) -> DataFrame:
    """Paths of archived utterances, and whether an utterance that stays uses them as well."""
    gone = archived.select("utterance_id").distinct()
    paths = assets.join(gone, "utterance_id", "left_semi").select("path").distinct()
    kept = assets.join(gone, "utterance_id", "left_anti").select("path").distinct().withColumn("shared", F.lit(True))
    return paths.join(kept, "path", "left").select("path", F.coalesce("shared", F.lit(False)).alias("shared"))


def archive_cascade(ids: DataFrame, key: str, tables: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """For each table its (kept, archived) rows."""
    gone = ids.select(key).distinct()
    return {name: (t.join(gone, key, "left_anti"), t.join(gone, key, "left_semi")) for name, t in tables.items()}


def prompt_disjointness(sets: dict[str, DataFrame]) -> DataFrame:
    """Surface keys (column key) that are in several sets or several times in one."""
    rows = _all([df.select("key", F.lit(name).alias("set")) for name, df in sets.items()])
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("set")), ",").alias("sets"))
    return groups.where("n > 1")


def single_valued(df: DataFrame, *columns: str) -> DataFrame:
    """How many distinct values each column has, and whether it is one."""
    counts = df.agg(*[F.countDistinct(F.to_json(F.struct(c))).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.column", "x.n", (F.col("x.n") == 1).alias("single"))


def benchmark_identity(manifests: DataFrame) -> DataFrame:
    """manifests (source, utterance_id, surface_text, expressions array): per source the counts and a hash of the meaning.

    The hash is over the rows, with expressions sorted; equal hashes mean the same benchmark.  It is built as a tree: rows fall into
    buckets by six hexadecimal digits of their id's hash, each hashed in order of id; these into 4096 by three digits, and a source's
    hash is over those in order.  So no array has many more entries than the 16.7 millionth part of the rows, or than 4096.
    """
    line = F.sha2(F.to_json(F.struct("utterance_id", "surface_text", F.sort_array("expressions").alias("expressions"))), 256)
    rows = manifests.select("source", F.col("utterance_id").cast("string").alias("at"), line.alias("hash"), F.lit(1).cast("long").alias("n"), F.size("expressions").alias("k"))
    digits = F.md5(F.coalesce("at", F.lit("")).cast("binary"))

    def up(level: DataFrame, *by: Column) -> DataFrame:
        hashes = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])
        return level.groupBy("source", *by).agg(F.sha2(F.array_join(hashes, ""), 256).alias("hash"), F.sum("n").alias("n"), F.sum("k").alias("k"))

    fine = up(rows, F.left(digits, F.lit(6)).alias("bucket")).withColumnRenamed("bucket", "at")
    coarse = up(fine, F.left("at", F.lit(3)).alias("bucket")).withColumnRenamed("bucket", "at")
    return up(coarse).select("source", F.col("n").alias("entries"), F.col("k").alias("expressions"), F.col("hash").alias("semantic_hash"))


def asset_for_role(assets: Column, role: str, legacy: Column) -> Column:
    return F.coalesce(F.get(F.filter(assets, lambda a: a["role"] == role), F.lit(0)), legacy)


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values of a key in one table only: missing (not in b) or unexpected (not in a)."""
    missing = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("missing"))
    extra = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.union(extra)


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def lineage_chain(assets: DataFrame) -> DataFrame:
    """Assets (utterance_id, role, sha256, parent_sha256) whose parent is no asset of the utterance, and repeated roles."""
    a = assets.where("parent_sha256 is not null").select("utterance_id", "sha256", "parent_sha256").alias("a")
    parents = assets.select(F.col("utterance_id").alias("u"), F.col("sha256").alias("p"))
    orphans = a.join(parents, (F.col("a.utterance_id") == F.col("u")) & (F.col("a.parent_sha256") == F.col("p")), "left_anti")
    # Counted, so that no group's rows are held or sorted.
    twice = assets.groupBy("utterance_id", "role").count().where("count > 1")
    return _violation(orphans, "parent_missing", F.col("utterance_id"), F.col("sha256")).unionByName(_violation(twice, "role_repeated", F.col("utterance_id"), F.col("role")))
