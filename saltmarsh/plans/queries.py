"""The registered queries over the given tables, each with its statement in SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import audio, dictionary, scoring, text
from ..operators import calibration, contracts, gate, governance, history, reports
from ..streaming import streams
from . import lenses
from .lenses import CASES, ENTRIES, REVIEWS, surface_sql, table
from .registry import QUERIES, SQL, query

def scored(sql: str) -> Callable[[Callable], Callable]:
    """Registers a query over the scored cases of lenses.cases."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(spark, d, lenses.cases(spark, d))
        SQL[f.__name__] = sql
        return f

    return add


_AGGREGATE = """count(*) AS utterance_count, round(CASE WHEN sum(ref_chars) = 0 THEN sum(edits) ELSE sum(edits) / sum(ref_chars) END, 6) AS cer,
 round(sum(preserved) / sum(expressions), 6) AS dialect_preservation_rate, round(sum(overcorrected) / sum(expressions), 6) AS context_overcorrection_rate,
 count(*) FILTER (hcw) AS high_confidence_wrong_count, count(*) FILTER (latency_ms IS NULL) AS missing_latency_count, round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms"""


@scored(f"WITH {CASES} SELECT {_AGGREGATE} FROM scored")
def aggregate_report(spark, d, cases):
    return reports.aggregate_report(cases)


@scored(f"WITH {CASES} SELECT role, {_AGGREGATE} FROM scored GROUP BY role")
def aggregate_report_by_role(spark, d, cases):
    return reports.aggregate_report(cases, "role")


@scored(f"WITH {CASES} SELECT case_id, edits::INT AS edits, ref_chars::INT AS ref_chars, round(cer, 6) AS cer, hcw AS high_confidence_wrong, overcorrected, preserved FROM scored")
def case_scores(spark, d, cases):
    return cases.select("case_id", "edits", "ref_chars", F.round("cer", 6).alias("cer"), "high_confidence_wrong", "overcorrected", "preserved")


@scored(f"WITH {CASES} SELECT case_id, edits::INT AS edits, (length(nh) - length(nr))::INT AS longer FROM scored")
def edit_counts(spark, d, cases):
    """Substitutions, deletions and insertions add up to the distance; insertions less deletions are the difference in length."""
    c = cases.withColumn("k", scoring.edit_counts(F.col("nr"), F.col("nh")))
    return c.select("case_id", F.expr("k.substitutions + k.deletions + k.insertions").alias("edits"), F.expr("k.insertions - k.deletions").alias("longer"))


_RATE = "round(CASE WHEN sum(ref_chars) = 0 THEN sum(edits) ELSE sum(edits) / sum(ref_chars) END, 6) AS cer"


@scored(f"WITH {CASES} SELECT role, part, count(*) AS cases, {_RATE}, grouping_id(role, part)::BIGINT AS level FROM (SELECT *, CASE WHEN turn % 3 <> 2 THEN conv_id % 4 END AS part FROM scored) GROUP BY ROLLUP (role, part)")
def group_cer(spark, d, cases):
    """By role and part, of which some cases have none: their group is not the subtotal."""
    return reports.group_cer(cases.withColumn("part", F.when(F.col("turn") % 3 != 2, F.col("conv_id") % 4)), "role", "part")


@scored(f"WITH {CASES} SELECT speaker, region, environment, count(*) AS cases, {_RATE}, grouping_id(speaker, region, environment)::BIGINT AS level FROM (SELECT *, role AS speaker, CASE WHEN conv_id % 7 <> 3 THEN conv_id % 7 END AS region, turn % 2 AS environment FROM scored) GROUP BY GROUPING SETS ((speaker), (region), (environment), (region, environment), ())")
def group_cer_sets(spark, d, cases):
    """By speaker, region, environment, the last two together, and all."""
    keyed = cases.withColumns({"speaker": F.col("role"), "region": F.when(F.col("conv_id") % 7 != 3, F.col("conv_id") % 7), "environment": F.col("turn") % 2})
    return reports.group_cer(keyed, "speaker", "region", "environment", sets=[("speaker",), ("region",), ("environment",), ("region", "environment"), ()])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return reports.latency_percentiles(table(spark, d, "events"), "value", "event_type")


@query(f"WITH {REVIEWS} SELECT failure AS failure_type, count(*) AS n FROM reviews WHERE failure IS NOT NULL GROUP BY failure")
def failure_type_counts(spark, d):
    return reports.failure_type_counts(lenses.reviews(spark, d))


@query(f"WITH {REVIEWS} SELECT prediction_id, review_id, verdict, revisions FROM latest")
def latest_review(spark, d):
    return history.latest_by(lenses.reviews(spark, d), "prediction_id", "created_at", "review_id").select("prediction_id", "review_id", "verdict", "revisions")


@query(
    f"WITH {REVIEWS} SELECT count(*) AS reviewed, sum(revisions)::BIGINT AS revisions, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'rejected') AS rejected, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (failure = 'LANGUAGE_MODEL_BIAS') AS language_model_bias FROM latest"
)
def human_review_summary(spark, d):
    return reports.human_review_summary(history.latest_by(lenses.reviews(spark, d), "prediction_id", "created_at", "review_id"))


@query(f"WITH {REVIEWS} SELECT c_custkey AS prediction_id, verdict, revisions, review_id IS NULL AS missing_review FROM customer LEFT JOIN latest ON prediction_id = c_custkey")
def attach_latest_review(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("prediction_id"))
    return history.attach_latest_review(p, lenses.reviews(spark, d)).select("prediction_id", "verdict", "revisions", "missing_review")


@query(f"WITH {REVIEWS} SELECT review_id, 'label_v' || row_number() OVER (PARTITION BY prediction_id ORDER BY created_at, review_id::VARCHAR) AS label_version FROM reviews")
def label_version(spark, d):
    r = lenses.reviews(spark, d).withColumnsRenamed({"prediction_id": "utterance_id", "review_id": "revision_id"})
    return history.label_versions(r).select(F.col("revision_id").alias("review_id"), "label_version")


@scored(f"WITH {CASES}, {REVIEWS} SELECT case_id FROM scored WHERE (overcorrected > 0 OR hcw) AND conv_id + 120 NOT IN (SELECT prediction_id FROM reviews)")
def review_queue(spark, d, cases):
    predictions = cases.withColumn("prediction_id", F.col("conv_id") + 120)
    return history.review_queue(predictions, lenses.reviews(spark, d)).select("case_id")


@query("SELECT doc_id, coalesce(after_it, first_one) AS next_candidate FROM (SELECT doc_id, first_value(CASE WHEN toxic = 0 THEN doc_id END IGNORE NULLS) OVER (PARTITION BY doc_id % 40 ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_it, min(CASE WHEN toxic = 0 THEN doc_id END) OVER (PARTITION BY doc_id % 40) AS first_one FROM labels)")
def next_unreviewed(spark, d):
    q = table(spark, d, "labels").select(F.col("doc_id").alias("utterance_id"), (F.col("doc_id") % 40).alias("grp"), F.when(F.col("toxic") == 0, "candidate").otherwise("approved").alias("label_status"))
    return history.next_unreviewed(q, "grp", "utterance_id").select(F.col("utterance_id").alias("doc_id"), "next_candidate")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position FROM events")
def queue_position(spark, d):
    return history.queue_position(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "position")


@query("SELECT count(*) AS total, count(*) FILTER (s = 'candidate') AS candidate, count(*) FILTER (s = 'human_reviewed') AS human_reviewed, count(*) FILTER (s = 'approved') AS approved, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s <> 'candidate') AS reviewed FROM (SELECT CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'candidate' END AS s FROM labels)")
def review_queue_counts(spark, d):
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("candidate")
    return reports.review_queue_counts(table(spark, d, "labels").select(status.alias("label_status")))


@query(f"WITH {ENTRIES} SELECT 'speaker_id_in_splits' AS rule, speaker_id AS key, string_agg(DISTINCT split, ',' ORDER BY split) AS detail FROM entries WHERE speaker_id IS NOT NULL GROUP BY speaker_id HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'region_in_splits', region, string_agg(DISTINCT split, ',' ORDER BY split) FROM entries WHERE region IS NOT NULL GROUP BY region HAVING count(DISTINCT split) > 1")
def split_leaks(spark, d):
    return governance.split_leaks(lenses.entries(spark, d), "speaker_id", "region")


@query(f"WITH {ENTRIES}, k AS (SELECT *, {surface_sql('surface_text')} AS surface FROM entries) SELECT sha256(surface) AS surface, count(*) AS n, min(utterance_id) AS first_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, CASE WHEN count(DISTINCT split) > 1 THEN 'error' ELSE 'warning' END AS level FROM k WHERE surface <> '' GROUP BY surface HAVING count(*) > 1")
def duplicate_surface_groups(spark, d):
    """Groups by the hashes of surface keys, so that no text is shuffled."""
    return governance.duplicate_surface_groups(lenses.entries(spark, d), F.coalesce(_surface_hash(F.col("surface_text")), F.lit("")))


@query(f"WITH {ENTRIES}, r AS (SELECT DISTINCT utterance_id, unnest(lineage) AS sha FROM entries) SELECT 'duplicate_lineage' AS rule, sha AS key, count(*)::VARCHAR AS detail FROM r GROUP BY sha HAVING count(*) > 1")
def duplicate_lineage(spark, d):
    return governance.duplicate_lineage(lenses.entries(spark, d))


_TRAIN = f"{ENTRIES}, keyed AS (SELECT *, {surface_sql('surface_text')} AS k FROM entries)"
_FROZEN = f"""frozen AS (SELECT item_id * 25 AS utterance_id, 'src' || (item_id % 100 + 15) AS speaker_id, ['a' || item_id] AS lineage, {surface_sql('text')} AS k, 'b' || (item_id % 3) AS benchmark_id FROM benchmark
UNION ALL SELECT utterance_id, speaker_id, lineage, k, 'validation' FROM keyed WHERE split = 'validation')"""


@query(f"WITH {_TRAIN}, {_FROZEN}, t AS (SELECT * FROM keyed WHERE split = 'train'), l AS (SELECT DISTINCT benchmark_id, unnest(lineage) AS sha FROM frozen), tl AS (SELECT utterance_id, unnest(lineage) AS sha FROM t) SELECT 'utterance' AS rule, t.utterance_id::VARCHAR AS key, benchmark_id AS detail FROM t JOIN (SELECT DISTINCT utterance_id, benchmark_id FROM frozen) USING (utterance_id) UNION ALL SELECT 'speaker', t.utterance_id::VARCHAR, benchmark_id FROM t JOIN (SELECT DISTINCT speaker_id, benchmark_id FROM frozen WHERE speaker_id <> '') USING (speaker_id) UNION ALL SELECT 'surface', t.utterance_id::VARCHAR, benchmark_id FROM t JOIN (SELECT DISTINCT k, benchmark_id FROM frozen WHERE k <> '') f ON f.k = t.k UNION ALL SELECT * FROM (SELECT DISTINCT 'lineage', tl.utterance_id::VARCHAR, benchmark_id FROM tl JOIN l USING (sha))")
def leakage_check(spark, d):
    """Training rows against the benchmark and the whole validation split, by surface keys (their hashes)."""
    rows = lenses.entries(spark, d).withColumn("surface_key", _surface_hash(F.col("surface_text")))
    bench = table(spark, d, "benchmark").select(
        (F.col("item_id") * 25).alias("utterance_id"), F.concat(F.lit("src"), F.col("item_id") % 100 + 15).alias("speaker_id"), F.array(F.concat(F.lit("a"), F.col("item_id"))).alias("lineage"), _surface_hash(F.col("text")).alias("surface_key"), F.concat(F.lit("b"), F.col("item_id") % 3).alias("benchmark_id")
    )
    held = rows.where("split = 'validation'").select("utterance_id", "speaker_id", "lineage", "surface_key", F.lit("validation").alias("benchmark_id"))
    return governance.leakage_check(rows.where("split = 'train'"), bench.unionByName(held))


def _surface_hash(c):
    key = text.surface_key(c)
    return F.when(key != "", F.sha2(key, 256))


@query(f"WITH {ENTRIES} SELECT split, count(*) AS rows, count(DISTINCT speaker_id) AS speakers, round(sum(duration_ms) / 3600000, 6) AS hours, concat_ws('; ', CASE WHEN count(*) < 300 THEN 'few rows' END, CASE WHEN split = 'validation' AND count(DISTINCT speaker_id) < 2 THEN 'few speakers' END) AS warnings FROM entries GROUP BY split")
def training_report(spark, d):
    return governance.training_report(lenses.entries(spark, d))


@query(f"WITH {ENTRIES}, x AS (SELECT *, first_value(split) OVER (PARTITION BY speaker_id ORDER BY utterance_id) AS first_split FROM entries) SELECT utterance_id, first_split, split <> first_split AS conflict FROM x")
def first_seen_split(spark, d):
    return history.first_seen_split(lenses.entries(spark, d), "speaker_id", "utterance_id").select("utterance_id", "first_split", "conflict")


@query(f"SELECT DISTINCT kind, value FROM (SELECT 'speaker' AS kind, source AS value FROM documents UNION ALL SELECT 'utterance', doc_id::VARCHAR FROM documents UNION ALL SELECT 'utterance', doc_id::VARCHAR FROM labels UNION ALL SELECT 'surface', {surface_sql('text')} FROM benchmark) WHERE value <> ''")
def exclusion_registry(spark, d):
    docs, labels, bench = (table(spark, d, t) for t in ("documents", "labels", "benchmark"))
    return governance.exclusion_registry((docs, {"speaker": F.col("source"), "utterance": F.col("doc_id")}), (labels, {"utterance": F.col("doc_id")}), (bench, {"surface": text.surface_key(F.col("text"))}))


@query(f"WITH {_TRAIN}, banned AS (SELECT {surface_sql('text')} AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT {surface_sql('text')} FROM benchmark) SELECT 'utterance' AS rule, utterance_id::VARCHAR AS key, 'error' AS detail FROM keyed WHERE utterance_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'surface', utterance_id::VARCHAR, 'warning' FROM keyed WHERE k <> '' AND k IN (SELECT k FROM banned)")
def exclusion_check(spark, d):
    """Entries against toxic labels, and by surface keys (their hashes) against the benchmark and all labelled documents."""
    labels = table(spark, d, "labels")
    labelled = table(spark, d, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    surface = {"surface": _surface_hash(F.col("text"))}
    registry = governance.exclusion_registry((labels.where("toxic = 1"), {"utterance": F.col("doc_id")}), (labelled, surface), (table(spark, d, "benchmark"), surface))
    return governance.exclusion_check(lenses.entries(spark, d), registry, {"utterance": F.col("utterance_id"), "surface": _surface_hash(F.col("surface_text"))})


@query("SELECT doc_id AS utterance_id, CASE WHEN quality = 1 THEN 'train' ELSE 'validation' END AS split, doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AS known FROM labels")
def resolve_assignments(spark, d):
    assigned = table(spark, d, "labels").select(F.col("doc_id").alias("utterance_id"), F.when(F.col("quality") == 1, "train").otherwise("validation").alias("split"))
    return governance.resolve_assignments(assigned, table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("utterance_id")))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) OR doc_id IN (SELECT item_id FROM benchmark)")
def is_frozen(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("utterance_id"))
    found = governance.is_frozen(docs, table(spark, d, "labels").select(F.col("doc_id").alias("utterance_id")), table(spark, d, "benchmark").select(F.col("item_id").alias("utterance_id")))
    return found.withColumnRenamed("utterance_id", "doc_id")


@query("WITH m AS (SELECT DISTINCT c_custkey AS k FROM customer), p AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN p.k IS NULL THEN 'missing' WHEN m.k IS NULL THEN 'unexpected' ELSE 'duplicate' END AS rule, coalesce(m.k, p.k)::VARCHAR AS key, coalesce(n, 0)::VARCHAR AS detail FROM m FULL JOIN p ON m.k = p.k WHERE p.k IS NULL OR m.k IS NULL OR n > 1")
def coverage_check(spark, d):
    """All orders, by customer, against all customers."""
    return governance.coverage_check(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


_ARM = "SELECT l_orderkey AS utterance_id, l_discount AS cer, l_tax AS preservation, l_quantity AS overcorrection, CASE WHEN l_linestatus = 'O' THEN l_extendedprice END AS confidence FROM lineitem WHERE l_linenumber = {}"


def _arm(spark, d, number):
    return table(spark, d, "lineitem").where(F.col("l_linenumber") == number).select(
        F.col("l_orderkey").alias("utterance_id"), F.col("l_discount").alias("cer"), F.col("l_tax").alias("preservation"), F.col("l_quantity").alias("overcorrection"), F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).alias("confidence")
    )


_DELTAS = f"WITH a AS ({_ARM.format(1)}), b AS ({_ARM.format(2)}), deltas AS (SELECT a.utterance_id, round(b.cer - a.cer, 6) AS cer_delta, round(b.preservation - a.preservation, 6) AS preservation_delta, round(b.overcorrection - a.overcorrection, 6) AS overcorrection_delta, round(b.confidence - a.confidence, 6) AS confidence_delta FROM a JOIN b USING (utterance_id))"


@query(f"{_DELTAS} SELECT * FROM deltas")
def compare_predictions(spark, d):
    return reports.compare_predictions(_arm(spark, d, 1), _arm(spark, d, 2))


@query(f"{_DELTAS} SELECT CASE WHEN cer_delta < 0 THEN 'improved' WHEN cer_delta = 0 THEN 'equal' ELSE 'worsened' END AS outcome, count(*) AS n FROM deltas WHERE cer_delta IS NOT NULL GROUP BY 1")
def outcome_counts(spark, d):
    return reports.outcome_counts(reports.compare_predictions(_arm(spark, d, 1), _arm(spark, d, 2)), "cer_delta")


@scored(f"WITH {CASES} SELECT CASE WHEN turn % 2 = 0 THEN 'pretrained' ELSE 'fine_tuned' END AS arm, round(sum(edits) / sum(ref_chars), 6) AS cer, round(sum(preserved) / sum(expressions), 6) AS dialect_preservation, count(*) FILTER (trim(hypothesis) = '') AS empty_outputs, round(avg(latency_ms), 6) AS mean_latency_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms FROM scored GROUP BY 1")
def arm_metrics(spark, d, cases):
    return reports.arm_metrics(cases.withColumn("arm", F.when(F.col("turn") % 2 == 0, "pretrained").otherwise("fine_tuned")))


@query("WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'signup' THEN 'tie' WHEN 'error' THEN 'uncertain' END AS p, CASE WHEN event_id % 2 = 0 THEN 'fine_tuned' ELSE 'pretrained' END AS a FROM events), w AS (SELECT CASE WHEN p = 'A' THEN a WHEN p = 'B' THEN CASE WHEN a = 'fine_tuned' THEN 'pretrained' ELSE 'fine_tuned' END ELSE p END AS w FROM r) SELECT count(*) AS items, count(*) FILTER (w = 'fine_tuned') AS wins, count(*) FILTER (w = 'pretrained') AS losses, count(*) FILTER (w = 'tie') AS ties, count(*) FILTER (w = 'uncertain') AS uncertain, count(*) FILTER (w IS NULL) AS open, round(count(*) FILTER (w = 'fine_tuned') / count(*) FILTER (w IN ('fine_tuned', 'pretrained')), 6) AS preference_rate FROM w")
def ab_tally(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    results = e.select(F.col("event_id").alias("item_id"), F.when(kind == "view", "A").when(kind == "click", "B").when(kind == "signup", "tie").when(kind == "error", "uncertain").alias("transcript_preference"))
    ours = F.col("event_id") % 2 == 0
    key = e.select(F.col("event_id").alias("item_id"), F.when(ours, "fine_tuned").otherwise("pretrained").alias("A"), F.when(ours, "pretrained").otherwise("fine_tuned").alias("B"))
    return reports.ab_tally(reports.ab_unblind(results, key), "fine_tuned", "pretrained")


@scored(f"WITH {CASES}, c AS (SELECT *, CASE WHEN contains(nh, substr(nr, 1, 4)) THEN 'EXACT_SURFACE' WHEN contains(nh, substr(nr, 1, 3)) THEN 'ACCEPTABLE_VARIANT' WHEN contains(nh, substr(nr, 5, 2)) THEN 'STANDARD_EQUIVALENT' ELSE 'MISSING' END AS kind, turn % 2 = 0 AS good FROM scored) SELECT count(*) AS expressions, count(*) FILTER (kind = 'EXACT_SURFACE') AS exact, count(*) FILTER (kind = 'ACCEPTABLE_VARIANT' AND good) AS approved_variants, count(*) FILTER (kind = 'STANDARD_EQUIVALENT') AS standard, count(*) FILTER (kind = 'MISSING') AS missing, count(*) FILTER (kind = 'ACCEPTABLE_VARIANT' AND NOT good) AS ambiguous, round((count(*) FILTER (kind = 'EXACT_SURFACE') + count(*) FILTER (kind = 'ACCEPTABLE_VARIANT' AND good)) / (count(*) - count(*) FILTER (kind = 'ACCEPTABLE_VARIANT' AND NOT good)), 6) AS preservation_rate, round(count(*) FILTER (kind = 'STANDARD_EQUIVALENT') / (count(*) - count(*) FILTER (kind = 'ACCEPTABLE_VARIANT' AND NOT good)), 6) AS overcorrection_rate FROM c")
def calibrated_aggregate(spark, d, cases):
    return calibration.calibrated_aggregate(_classified(cases).select("x.*"))


def _classified(cases):
    def form(at, n, status):
        part = F.substring("nr", at, n)
        return F.array(F.struct(part.alias("form"), part.alias("plain"), status.alias("status")))

    variants = form(1, 3, F.when(F.col("turn") % 2 == 0, "approved").otherwise("candidate"))
    return cases.withColumn("x", calibration.classify_expression(F.col("nh"), F.substring("nr", 1, 4), variants, form(5, 2, F.lit("approved"))))


_AGREEMENT = rf"""WITH {CASES}, {REVIEWS}, words AS (SELECT *, regexp_extract_all(regexp_replace(nfc_normalize(reference), '\p{{P}}', '', 'g'), '\S+') <> regexp_extract_all(regexp_replace(nfc_normalize(hypothesis), '\p{{P}}', '', 'g'), '\S+') AS other FROM scored),
k AS (SELECT *, CASE WHEN contains(nh, substr(nr, 1, 4)) OR contains(nh, substr(nr, 1, 3)) AND turn % 2 = 0 THEN 'none' WHEN contains(nh, substr(nr, 1, 3)) THEN 'unclear' WHEN contains(nh, substr(nr, 5, 2)) THEN 'standard' ELSE 'lost' END AS error FROM words),
a AS (SELECT conv_id, error = 'standard' AS bias, edits > 0 OR error = 'lost' AS model, edits = 0 AND other AND error <> 'lost' AS decoding FROM k),
g AS (SELECT CASE WHEN verdict = 'uncertain' THEN 'u' WHEN verdict = 'rejected' AND NOT (bias OR model OR decoding) THEN 'n' WHEN verdict = 'rejected' THEN 'f' WHEN NOT (bias OR model OR decoding) THEN 'm'
  WHEN coalesce(failure = 'LANGUAGE_MODEL_BIAS' AND bias OR failure = 'MODEL' AND model OR failure = 'DECODING' AND decoding, false) THEN 'y' ELSE 'x' END AS g FROM a JOIN latest ON conv_id = prediction_id)
SELECT count(*) FILTER (g = 'y') AS match, count(*) FILTER (g = 'x') AS mismatch, count(*) FILTER (g = 'm') AS missed, count(*) FILTER (g = 'f') AS false_positive, count(*) FILTER (g = 'n') AS no_error_agreement, count(*) FILTER (g = 'u') AS uncertain FROM g"""


@query(_AGREEMENT)
def human_agreement_summary(spark, d):
    c = _classified(lenses.cases(spark, d)).withColumn("k", scoring.edit_counts(F.col("nr"), F.col("nh")))
    observed = F.concat(F.array("x.observed_error"), calibration.edit_observations(F.col("reference"), F.col("hypothesis"), F.col("k")))
    r = history.latest_by(lenses.reviews(spark, d), "prediction_id", "created_at", "review_id").select("prediction_id", "verdict", "confirmed_failure_types")
    cases = c.withColumn("automatic", calibration.failure_candidates(observed)).join(r, c.conv_id == r.prediction_id)
    return calibration.human_agreement_summary(cases.withColumn("agreement", calibration.human_agreement(F.col("automatic"), F.col("verdict"), F.col("confirmed_failure_types"))))


@query(f"WITH {CASES}, rows AS (SELECT *, CASE WHEN turn % 5 = 4 THEN 'failed' ELSE 'ok' END AS status FROM scored), seen AS (SELECT conv_id, count(*) AS n, count(*) FILTER (status = 'failed') AS f FROM rows GROUP BY conv_id), want AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (w IS NULL) AS unexpected, count(*) FILTER (n > 1) AS duplicate, coalesce(sum(f), 0)::BIGINT AS failed FROM (SELECT want.conv_id AS w, n, f FROM want FULL JOIN seen ON want.conv_id = seen.conv_id)), t AS (SELECT round(avg(latency_ms), 6) AS mean_latency_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms, round(avg(latency_ms / duration_ms), 6) AS mean_rtf FROM rows WHERE status <> 'failed') SELECT *, CASE WHEN missing + unexpected + duplicate + failed = 0 THEN 'complete' ELSE 'incomplete' END AS status FROM s, t")
def inference_summary(spark, d):
    """Cases against all conversations; one of a single turn has no case and is missing."""
    rows = lenses.cases(spark, d).select(F.col("conv_id").alias("utterance_id"), F.when(F.col("turn") % 5 == 4, "failed").otherwise("ok").alias("status"), "latency_ms", "duration_ms")
    return reports.inference_summary(rows, table(spark, d, "conversations").select(F.col("conv_id").alias("utterance_id")))


@query("WITH s AS (SELECT page_id, sha256(html) AS h, CASE WHEN page_id % 11 = 3 THEN NULL WHEN page_id % 7 = 2 THEN 'x' ELSE sha256(html) END AS expected FROM pages) SELECT url || page_id AS path, CASE WHEN page_id % 5 = 4 THEN 'missing' WHEN page_id % 13 = 5 THEN 'unexpected' WHEN expected IS NULL THEN 'unpinned' WHEN expected = h THEN 'verified' ELSE 'mismatch' END AS status FROM s JOIN pages USING (page_id)")
def artifact_audit(spark, d):
    p = table(spark, d, "pages").select(F.concat("url", "page_id").alias("path"), F.sha2("html", 256).alias("sha256"), "page_id")
    spec = p.where("page_id % 13 <> 5 OR page_id % 5 = 4").select("path", F.when(F.col("page_id") % 11 == 3, None).when(F.col("page_id") % 7 == 2, "x").otherwise(F.col("sha256")).alias("expected_sha256"))
    return governance.artifact_audit(spec, p.where("page_id % 5 <> 4").select("path", "sha256"))


@query("SELECT p_name AS path, count(*) FILTER (p_partkey % 10 <> 0) > 0 AS shared FROM part GROUP BY p_name HAVING count(*) FILTER (p_partkey % 10 = 0) > 0")
def shared_assets(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("utterance_id"), F.col("p_name").alias("path"))
    return governance.shared_assets(parts, parts.where("utterance_id % 10 = 0"))


@query("WITH g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT 'orders' AS name, count(*) FILTER (o_orderkey NOT IN (SELECT k FROM g)) AS kept, count(*) FILTER (o_orderkey IN (SELECT k FROM g)) AS archived FROM orders UNION ALL SELECT 'lineitem', count(*) FILTER (l_orderkey NOT IN (SELECT k FROM g)), count(*) FILTER (l_orderkey IN (SELECT k FROM g)) FROM lineitem")
def archive_cascade(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    tables = {"orders": orders, "lineitem": table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")}
    split = governance.archive_cascade(orders.where("o_orderstatus = 'F'"), "k", tables)
    out = [a.agg(F.count("*").alias("kept")).crossJoin(b.agg(F.count("*").alias("archived"))).select(F.lit(n).alias("name"), "kept", "archived") for n, (a, b) in split.items()]  # one row each
    return out[0].union(out[1])


@query("WITH s AS (SELECT c_mktsegment || c_nationkey AS key, 'a' AS s FROM customer UNION ALL SELECT 'BUILDING' || s_nationkey, 'b' FROM supplier) SELECT key, count(*) AS n, string_agg(DISTINCT s, ',' ORDER BY s) AS sets FROM s GROUP BY key HAVING count(*) > 1")
def prompt_disjointness(spark, d):
    a = table(spark, d, "customer").select(F.concat("c_mktsegment", "c_nationkey").alias("key"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("BUILDING"), "s_nationkey").alias("key"))
    return governance.prompt_disjointness({"a": a, "b": b})


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events) SELECT k, 'missing' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'unexpected' FROM b WHERE k NOT IN (SELECT k FROM a)")
def set_difference(spark, d):
    return governance.set_difference(table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), table(spark, d, "events").withColumnRenamed("user_id", "k"), "k")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, d):
    return governance.duplicates(table(spark, d, "events"), "user_id", "event_type")


_QUALITY = """WITH q AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
m AS (SELECT vec_id, list_max(list_transform(x, lambda v: abs(v))) AS peak, 20 * log10(greatest(sqrt(list_sum(list_transform(x, lambda v: v * v)) / n), 1e-12)) AS rms_dbfs, len(list_filter(x, lambda v: abs(v) >= 0.999)) / n AS clipping_ratio,
  len(list_filter(x, lambda v: abs(v) < 0.01)) / n AS silence_ratio, list_sum(x) / n AS dc_offset, n / 16000 * 1000 AS duration_ms FROM q)
SELECT vec_id, round(peak, 6) AS peak, round(rms_dbfs, 6) AS rms_dbfs, round(clipping_ratio, 6) AS clipping_ratio, round(silence_ratio, 6) AS silence_ratio, round(dc_offset, 6) AS dc_offset, round(duration_ms, 6) AS duration_ms,
  array_to_string(list_filter([CASE WHEN clipping_ratio > 0.01 THEN 'CLIPPING_HIGH' END, CASE WHEN rms_dbfs < -50 THEN 'LEVEL_TOO_LOW' END, CASE WHEN silence_ratio > 0.95 THEN 'MOSTLY_SILENCE' END, CASE WHEN abs(dc_offset) > 0.05 THEN 'DC_OFFSET_HIGH' END,
    CASE WHEN duration_ms NOT BETWEEN 300 AND 30000 THEN 'DURATION_OUT_OF_RANGE' END], lambda w: w IS NOT NULL), ',') AS warnings FROM m"""


@query(_QUALITY)
def audio_quality(spark, d):
    e = table(spark, d, "embeddings").withColumn("q", audio.audio_quality(F.col("embedding"), 16_000))
    return e.select("vec_id", *[F.round(f"q.{c}", 6).alias(c) for c in ("peak", "rms_dbfs", "clipping_ratio", "silence_ratio", "dc_offset", "duration_ms")], F.array_join("q.warnings", ",").alias("warnings"))


@query("SELECT vec_id, i AS bin, round(list_min(embedding[i * len(embedding) // 7 + 1 : (i + 1) * len(embedding) // 7])::DOUBLE, 6) AS low, round(list_max(embedding[i * len(embedding) // 7 + 1 : (i + 1) * len(embedding) // 7])::DOUBLE, 6) AS high FROM embeddings, range(7) t(i)")
def waveform_envelope(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(audio.waveform_envelope(F.col("embedding"), 7, 16_000)).alias("bin", "x"))
    return e.select("vec_id", F.col("bin").cast("long").alias("bin"), F.round(F.col("x.low").cast("double"), 6).alias("low"), F.round(F.col("x.high").cast("double"), 6).alias("high"))


@query("SELECT vec_id, i AS frame, round(list_sum(list_transform(embedding[i * 8 + 1 : i * 8 + 16], lambda v: v::DOUBLE * v::DOUBLE)), 6) AS energy FROM embeddings, range(7) t(i) WHERE i <= (len(embedding) - 16) // 8")
def frame_energy(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(audio.frame_signal(F.col("embedding"), 16, 8)).alias("frame", "x"))
    energy = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return e.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(energy, 6).alias("energy"))


@query()
def acoustic_snapshot(spark, d):
    e = audio.acoustic_snapshot(table(spark, d, "embeddings"), "embedding", 16_000, 8)
    return e.select("vec_id", F.size("log_mel").alias("mel_bins"), F.round(F.array_min(F.transform("log_mel", lambda r: F.array_min(r))), 4).alias("floor_db"), F.round(F.get("f0", F.lit(0))["confidence"], 4).alias("confidence"), "truncated")


@query("WITH e AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM e) SELECT user_id, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS streak FROM i GROUP BY user_id, island")
def practice_streaks(spark, d):
    return history.practice_streaks(table(spark, d, "events"), "user_id", "ts").withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("SELECT user_id, count(*) AS n, max(ts)::DATE::VARCHAR AS last_day, least(count(*) - 1, 3)::INT AS step, (max(ts)::DATE + [1, 3, 7, 14][least(count(*) - 1, 3) + 1]::INT)::VARCHAR AS due FROM events GROUP BY user_id")
def review_schedule(spark, d):
    return history.review_schedule(table(spark, d, "events"), "user_id", "ts").withColumns({c: F.col(c).cast("string") for c in ("last_day", "due")})


_EVIDENCE = {
    "benchmark_integrity_passed": "c_custkey % 9 <> 0", "reproducibility_passed": "c_custkey % 11 <> 0", "pilot_pretrained_empty_outputs": "c_custkey % 3", "pilot_fine_tuned_empty_outputs": "c_custkey % 2", "pilot_fine_tuned_cer": "(c_custkey % 50) / 100.0",
    "pilot_fine_tuned_dialect_preservation": "(c_custkey % 7) / 7.0 + 0.3", "human_review_complete": "c_custkey % 4 <> 1", "human_fine_tuned_preference_rate": "CASE WHEN c_custkey % 4 <> 1 THEN (c_custkey % 10) / 10.0 END", "independent_test_complete": "c_custkey % 5 <> 2",
    "independent_pretrained_cer": "(c_custkey % 6) / 10.0", "independent_fine_tuned_cer": "(c_custkey % 4) / 10.0", "independent_pretrained_dialect_preservation": "0.25", "independent_fine_tuned_dialect_preservation": "(c_custkey % 4) / 4.0", "independent_pretrained_empty_outputs": "2",
    "independent_fine_tuned_empty_outputs": "c_custkey % 4", "independent_utterances": "c_custkey", "independent_speakers": "10", "standard_regression_complete": "true", "standard_pretrained_cer": "0.5", "standard_fine_tuned_cer": "(c_custkey % 8) / 10.0",
    "standard_pretrained_empty_outputs": "CASE WHEN c_custkey % 6 <> 0 THEN 1 END", "standard_fine_tuned_empty_outputs": "c_custkey % 2", "standard_utterances": "100", "standard_speakers": "5",
}
_GATE = f"""WITH e AS (SELECT c_custkey AS candidate, {", ".join(f"{v} AS {k}" for k, v in _EVIDENCE.items())} FROM customer),
k AS (SELECT candidate, unnest([
  {{'n': 'benchmark_integrity', 'o': CASE WHEN benchmark_integrity_passed THEN 1 ELSE 0 END}}, {{'n': 'reproducibility', 'o': CASE WHEN reproducibility_passed THEN 1 ELSE 0 END}},
  {{'n': 'pilot_cer', 'o': (pilot_fine_tuned_cer <= 0.35)::INT}}, {{'n': 'pilot_dp', 'o': (pilot_fine_tuned_dialect_preservation >= 0.6)::INT}}, {{'n': 'safe', 'o': (pilot_fine_tuned_empty_outputs <= pilot_pretrained_empty_outputs)::INT}},
  {{'n': 'human', 'o': CASE WHEN NOT human_review_complete THEN 2 ELSE (human_fine_tuned_preference_rate >= 0.7)::INT END}},
  {{'n': 'ind', 'o': CASE WHEN NOT independent_test_complete THEN 2 END}}, {{'n': 'ind_size', 'o': CASE WHEN independent_test_complete THEN (independent_utterances >= 100)::INT END}},
  {{'n': 'ind_cer', 'o': CASE WHEN independent_test_complete THEN (CASE WHEN independent_pretrained_cer > 0 THEN (independent_pretrained_cer - independent_fine_tuned_cer) / independent_pretrained_cer ELSE (independent_fine_tuned_cer = 0)::INT END >= 0.1)::INT END}},
  {{'n': 'ind_dp', 'o': CASE WHEN independent_test_complete THEN (independent_fine_tuned_dialect_preservation - 0.25 >= 0.15)::INT END}}, {{'n': 'safe', 'o': CASE WHEN independent_test_complete THEN (independent_fine_tuned_empty_outputs <= 2)::INT END}},
  {{'n': 'std_metrics', 'o': CASE WHEN standard_pretrained_empty_outputs IS NULL THEN 0 END}}, {{'n': 'std_size', 'o': CASE WHEN standard_pretrained_empty_outputs IS NOT NULL THEN 1 END}},
  {{'n': 'safe', 'o': CASE WHEN standard_pretrained_empty_outputs IS NOT NULL THEN (standard_fine_tuned_cer - 0.5 <= 0.075)::INT END}}, {{'n': 'safe', 'o': CASE WHEN standard_pretrained_empty_outputs IS NOT NULL THEN (standard_fine_tuned_empty_outputs <= 1)::INT END}}]) AS x FROM e),
s AS (SELECT candidate, count(*) FILTER (x.o = 1) AS passed, count(*) FILTER (x.o = 0) AS failed, count(*) FILTER (x.o = 2) AS pending, count(*) FILTER (x.o = 0 AND x.n IN ('safe', 'benchmark_integrity', 'reproducibility')) AS decisive FROM k GROUP BY candidate)
SELECT candidate, passed, failed, pending, CASE WHEN pending > 0 OR decisive > 0 THEN 'FAIL' WHEN failed = 0 THEN 'PASS' WHEN failed = 1 THEN 'CONDITIONAL PASS' ELSE 'FAIL' END AS status FROM s"""


@query(_GATE)
def gate_assessment(spark, d):
    evidence = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate"), *[F.expr(v.replace(" / 100.0", " / 100D").replace(" / 10.0", " / 10D").replace(" / 7.0 + 0.3", " / 7D + 0.3D").replace(" / 4.0", " / 4D")).alias(k) for k, v in _EVIDENCE.items()])
    return gate.gate_assessment(evidence)


@query(rf"SELECT doc_id, {surface_sql('text')} AS surface_key, regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s', '', 'g') AS pool_key, regexp_replace(nfc_normalize(text), '[\p{{Z}}\p{{P}}]', '', 'g') AS plain, len(regexp_extract_all(regexp_replace(nfc_normalize(text), '\p{{P}}', '', 'g'), '\S+'))::INT AS tokens FROM documents")
def surface_keys(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.surface_key(t).alias("surface_key"), text.pool_surface_key(t).alias("pool_key"), text.normalize_for_cer(t).alias("plain"), F.size(text.tokens_without_punct(t)).alias("tokens"))


_LABELS = """words AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark), labels AS (SELECT w AS label_id, w AS surface_form, lower(w) AS first_form, substr(w, 1, 5) AS second_form FROM words WHERE w <> '')"""


@query(f"WITH {_LABELS}, docs AS (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS t FROM documents), m AS (SELECT doc_id, label_id, CASE WHEN contains(t, surface_form) THEN surface_form WHEN contains(t, first_form) THEN first_form WHEN contains(t, second_form) THEN second_form END AS form, surface_form FROM docs, labels) SELECT doc_id, label_id, CASE WHEN form = surface_form THEN 'preserved' ELSE 'overcorrected' END AS match_status, form AS matched_form FROM m WHERE form IS NOT NULL")
def dictionary_matches(spark, d):
    """Every document against a list of all words of the benchmark, with their lower case and their first five letters."""
    w = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).distinct().where("w <> ''")
    labels = w.select(F.col("w").alias("label_id"), F.col("w").alias("surface_form"), F.array(F.lower("w"), F.substring("w", 1, 5)).alias("normalized_forms"))
    return dictionary.dictionary_matches(table(spark, d, "documents"), "doc_id", "text", labels)


@query("SELECT 'types_without_confirmation' AS rule, event_id::VARCHAR AS key FROM events WHERE event_id % 3 = 0 AND event_type = 'error' UNION ALL SELECT 'uncertain_without_notes', event_id::VARCHAR FROM events WHERE event_type IN ('view', 'click')")
def review_contract(spark, d):
    r = lenses.reviews(spark, d)
    odd = (F.col("review_id") % 3 == 0) & (F.col("verdict") == "rejected")
    return contracts.review_contract(r.withColumn("confirmed_failure_types", F.when(odd, F.array(F.lit("MODEL"))).otherwise(F.col("confirmed_failure_types"))))


@query("SELECT 'price' AS rule, l_orderkey::VARCHAR AS key FROM lineitem WHERE NOT l_extendedprice BETWEEN 1000 AND 50000 UNION ALL SELECT 'discount', l_orderkey::VARCHAR FROM lineitem WHERE l_discount > 0.08")
def field_constraints(spark, d):
    return contracts.violations(table(spark, d, "lineitem"), "l_orderkey", {"price": contracts.out_of_range(F.col("l_extendedprice"), 1000, 50000), "discount": F.col("l_discount") > 0.08})


@query("WITH line AS (SELECT source, doc_id::VARCHAR AS id, length(lang) AS k, sha256('{\"utterance_id\":' || doc_id || ',\"surface_text\":' || to_json(text)::VARCHAR || CASE WHEN lang IS NULL THEN '' ELSE ',\"expressions\":' || to_json(list_sort(string_split(lang, '')))::VARCHAR END || '}') AS line FROM documents), fine AS (SELECT source, left(md5(id), 6) AS b6, count(*) AS n, sum(k) AS k, sha256(string_agg(line, '' ORDER BY id, line)) AS hash FROM line GROUP BY ALL), bucket AS (SELECT source, left(b6, 3) AS bucket, sum(n) AS n, sum(k) AS k, sha256(string_agg(hash, '' ORDER BY b6)) AS hash FROM fine GROUP BY ALL) SELECT source, sum(n)::BIGINT AS entries, sum(k)::BIGINT AS expressions, sha256(string_agg(hash, '' ORDER BY bucket)) AS semantic_hash FROM bucket GROUP BY source")
def benchmark_identity(spark, d):
    m = table(spark, d, "documents").select("source", F.col("doc_id").alias("utterance_id"), F.col("text").alias("surface_text"), F.split("lang", "").alias("expressions"))
    return governance.benchmark_identity(m)


@query("SELECT w AS window_start, count(*) AS events, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value) / sum(event_id), 6) AS cer, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS w, * FROM events) GROUP BY w")
def quality_windows(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("value").alias("latency_ms"), F.col("value").alias("edits"), F.col("event_id").alias("ref_chars"), (F.col("event_type") == "error").alias("high_confidence_wrong"))
    out = streams.quality_monitor(e, "6 hours")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("cases").alias("events"), F.col("p50_latency_ms").alias("p50"), F.col("p95_latency_ms").alias("p95"), "cer", F.col("high_confidence_wrong").alias("errors"))


from . import graphs as _graphs  # noqa: E402, F401  registers the queries over closures and audits
from . import live as _live  # noqa: E402, F401  registers the queries over streams
from . import records as _records  # noqa: E402, F401  registers the queries over records
from . import waves as _waves  # noqa: E402, F401  registers the queries over signals in chunks
