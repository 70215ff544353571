"""Audits: two forms of a benchmark, recovery bundles, blinded reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import expand_labels
from .contracts import safe_relative_path
from .governance import benchmark_identity

#: What a reviewer decides on each item.
DECISIONS = ("transcript_preference", "dialect_preservation_preference", "meaning_fidelity_preference", "meaning_distortion_a", "meaning_distortion_b", "overcorrection_a", "overcorrection_b")
#: Files of a bundle that its index does not list.
OWN_FILES = ("MANIFEST.json", "MANIFEST.sha256")


def serialized_identity(manifests: DataFrame) -> DataFrame:
    """Per source: entries, raw_expressions, expressions, annotation_structure and semantic_hash.

    manifests: source, utterance_id, surface_text, labels (surface_form, normalized_forms) as they are written; quoted lists of several
    labels are expanded first, so two ways of writing the same benchmark have one hash.
    """
    rows = manifests.withColumn("_labels", F.coalesce("labels", F.array().cast(manifests.schema["labels"].dataType)))
    line = F.transform(expand_labels(F.col("_labels")), lambda x: F.to_json(F.struct(x["surface_form"].alias("surface_form"), x["normalized_forms"].alias("normalized_forms"))))
    raw = rows.groupBy("source").agg(F.sum(F.size("_labels")).alias("raw_expressions"))
    found = benchmark_identity(rows.select("source", "utterance_id", "surface_text", line.alias("expressions")))
    both = found.alias("a").join(raw.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    structure = F.when(F.col("raw_expressions") != F.col("expressions"), "legacy_quoted_compound").otherwise("expanded_labels")
    return both.select("a.source", "entries", "raw_expressions", "expressions", structure.alias("annotation_structure"), "semantic_hash")


def benchmark_audit(stored: DataFrame, canonical: DataFrame) -> DataFrame:
    """Two serialisations of each source against each other: equal meaning keeps the version, whatever their structure.

    decision: audited_semantic_equivalence_keep_version, different_content, only_stored or only_canonical.
    """
    a, b = serialized_identity(stored).alias("a"), serialized_identity(canonical).alias("b")
    both = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "full_outer")
    decision = (
        F.when(F.col("b.entries").isNull(), "only_stored").when(F.col("a.entries").isNull(), "only_canonical")
        .when(F.col("a.semantic_hash") == F.col("b.semantic_hash"), "audited_semantic_equivalence_keep_version").otherwise("different_content")
    )
    return both.select(
        F.coalesce("a.source", "b.source").alias("source"), F.col("a.raw_expressions").alias("stored_raw"), F.col("b.raw_expressions").alias("canonical_raw"), F.coalesce("a.expressions", "b.expressions").alias("expressions"),
        F.col("a.annotation_structure").alias("stored_structure"), F.col("b.annotation_structure").alias("canonical_structure"), decision.alias("decision"),
    )


def bundle_audit(index: DataFrame, files: DataFrame) -> DataFrame:
    """(bundle, path, status) of every file that a bundle's index lists or its folder holds.

    index: bundle, relative_path, size_bytes, sha256; files: bundle, path, size, sha256, is_symlink.  unsafe: absolute, with a part .. or a backslash, or empty;
    duplicate: listed again after its first row; missing: not there, or a link; size_mismatch, hash_mismatch, verified; unexpected: there but
    not listed, unless it is one of OWN_FILES.  A bundle whose own index has another hash than it states is for manifest_check().
    """
    safe = F.coalesce(safe_relative_path(F.col("relative_path")) & (F.col("relative_path") != ""), F.lit(False))
    again = F.row_number().over(Window.partitionBy("bundle", "relative_path").orderBy("size_bytes", "sha256")) > 1
    listed = index.withColumn("_bad", F.when(~safe, "unsafe").when(again, "duplicate"))
    good = listed.where("_bad is null").select("bundle", F.col("relative_path").alias("path"), F.col("size_bytes").alias("_size"), F.col("sha256").alias("_hash"), F.lit(True).alias("_listed"))
    both = good.join(files.where(~F.coalesce("is_symlink", F.lit(False))), ["bundle", "path"], "full_outer")
    own = F.col("path").isin(*OWN_FILES)
    status = (
        F.when(F.col("_listed").isNull() & own, F.lit(None)).when(F.col("_listed").isNull(), "unexpected").when(F.col("size").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("_size")), "size_mismatch")
        .when(~F.col("sha256").eqNullSafe(F.col("_hash")), "hash_mismatch").otherwise("verified")
    )
    found = both.select("bundle", "path", status.alias("status")).where("status is not null")
    return found.unionByName(listed.where("_bad is not null").select("bundle", F.coalesce("relative_path", F.lit("")).alias("path"), F.col("_bad").alias("status")))


def manifest_check(stated: DataFrame, files: DataFrame) -> DataFrame:
    """(bundle, matches): whether a bundle's MANIFEST.json has the hash that it states (bundle, sha256); false where there is none."""
    have = files.where(F.col("path") == OWN_FILES[0]).select("bundle", F.col("sha256").alias("_hash"))
    return stated.join(have, "bundle", "left").select("bundle", F.coalesce(F.col("sha256") == F.col("_hash"), F.lit(False)).alias("matches"))


def bundle_result(found: DataFrame) -> DataFrame:
    """Per bundle: listed files, each status's number, and whether it passed."""
    kinds = ("verified", "missing", "size_mismatch", "hash_mismatch", "unexpected", "unsafe", "duplicate")
    out = found.groupBy("bundle").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count("*").alias("_all"))
    return out.select("bundle", *kinds, (F.col("verified") == F.col("_all")).alias("passed"))


def member_safety(members: DataFrame) -> DataFrame:
    """(rule, key) of archive members (name, kind) that are unsafe to unpack, or neither file nor folder."""
    unsafe = ~F.coalesce(safe_relative_path(F.rtrim(F.col("name"), F.lit("/"))), F.lit(False))
    rule = F.array_compact(F.array(F.when(unsafe, "unsafe_path"), F.when(~F.col("kind").isin("file", "dir") | F.col("kind").isNull(), "unsupported_member")))
    return members.select(F.explode(rule).alias("rule"), F.col("name").alias("key"))


def blind_review_violations(queue: DataFrame, results: DataFrame, opened: bool = False) -> DataFrame:
    """(rule, key) of review results against the blinded queue, both (review, position, item_id, utterance_id); results with DECISIONS and status.

    Results must have the queue's pairs of ids in the queue's order: pair_differs where a position has another pair, row_missing, row_extra.
    opened: the key is used; reviews that are not complete must not be (key_before_completion).
    """
    q = queue.select("review", "position", F.col("item_id").alias("_item"), F.col("utterance_id").alias("_utterance"), F.lit(True).alias("_queued"))
    both = q.join(results.withColumn("_done", F.lit(True)), ["review", "position"], "full_outer")
    same = F.col("_item").eqNullSafe(F.col("item_id")) & F.col("_utterance").eqNullSafe(F.col("utterance_id"))
    rule = F.when(F.col("_done").isNull(), "row_missing").when(F.col("_queued").isNull(), "row_extra").when(~same, "pair_differs")
    found = both.withColumn("rule", rule).where("rule is not null").select("rule", F.concat_ws("/", "review", "position").alias("key"))
    if opened:
        early = blind_review_status(results).where(F.col("status").isNull() | (F.col("status") != "complete"))
        found = found.unionByName(early.select(F.lit("key_before_completion").alias("rule"), F.col("review").cast("string").alias("key")))
    return found


def blind_review_status(results: DataFrame) -> DataFrame:
    """Per review: items, those with all DECISIONS made, and its status (the least, if rows differ)."""
    made = F.lit(True)
    for d in DECISIONS:
        made = made & F.col(d).isNotNull()
    return results.groupBy("review").agg(F.count("*").alias("total_items"), F.count_if(made).alias("reviewed_items"), F.min("status").alias("status"))


def blind_review_summary(results: DataFrame, key: DataFrame, ours: str, base: str) -> DataFrame:
    """Per complete review: wins of either arm, ties, uncertain, decisive items and the preference rate (null without a decisive one).

    key: review, item_id, A, B.  Reviews that are not complete have no row: their key stays closed.
    """
    done = results.join(blind_review_status(results).where("status = 'complete'").select("review"), "review", "left_semi")
    p = F.col("transcript_preference")
    winner = F.when(p == "A", F.col("A")).when(p == "B", F.col("B")).otherwise(p)
    named = done.join(key, ["review", "item_id"], "left").withColumn("winner", winner)
    wins, losses = F.count_if(F.col("winner") == ours), F.count_if(F.col("winner") == base)
    out = named.groupBy("review").agg(wins.alias("wins"), losses.alias("losses"), F.count_if(F.col("winner") == "tie").alias("ties"), F.count_if(F.col("winner") == "uncertain").alias("uncertain"))
    decisive = F.col("wins") + F.col("losses")
    return out.select("*", decisive.alias("decisive"), F.round(F.try_divide("wins", decisive), 6).alias("preference_rate"))
