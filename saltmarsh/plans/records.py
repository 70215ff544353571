"""Queries over utterance records, held-out sets, arms, contracts and listings, as the given tables stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring, text
from ..operators import calibration, contracts, gate, governance, history, reports, training
from . import lenses
from .lenses import CASES, ENTRIES, REVIEWS, surface_sql, table
from .registry import query


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as utterance records; the label's status comes from ``labels``, the two-asset form is that of English."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = docs.join(labels, "doc_id", "left")
    ms, key = F.col("n_chars") * 10.0, F.col("doc_id").cast("string")

    def asset(role: str, sha: Column, folder: str) -> Column:
        return F.struct(F.lit(role).alias("role"), sha.alias("sha256"), F.concat(F.lit(f"{folder}/"), key, F.lit(".wav")).alias("relative_path"), ms.alias("duration_ms"))

    plain = F.coalesce(F.col("lang") == "en", F.lit(True))
    number = F.coalesce(F.substring("source", 4, 10).try_cast("int"), F.lit(0))
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "human_reviewed").otherwise("candidate")
    return d.select(
        F.col("doc_id").alias("utterance_id"), F.col("source").alias("speaker_id"), F.col("lang").alias("region"), F.lit("room").alias("environment"), F.lit("import").alias("source"), F.when(number % 5 == 0, "validation").otherwise("train").alias("dataset_split"),
        F.col("text").alias("surface_text"), F.lit(None).cast("string").alias("normalized_meaning"), status.alias("label_status"), F.lit("label_v1").alias("label_version"), F.array(F.split("text", " ")[0]).alias("dialect_expressions"),
        F.lit(True).alias("storage_allowed"), F.col("source").isNotNull().alias("research_use_allowed"), (F.col("n_chars") >= 200).alias("model_training_allowed"), F.lit("policy-1").alias("policy_version"), (F.col("n_chars") < 20_000).alias("quality_passed"),
        asset("original", F.concat(F.lit("a"), (F.col("doc_id") % 400).cast("string")), "original").alias("original"), asset("derived", F.concat(F.lit("b"), key), "derived/asr_16k_mono").alias("derived"),
        F.when(~plain, asset("master", F.concat(F.lit("m"), key), "master")).alias("master"),
        F.when(~plain, F.array(asset("asr_16k_mono", F.concat(F.lit("d"), key), "derived/asr_16k_mono"), asset("preview", F.concat(F.lit("m"), key), "preview"))).alias("derivatives"),
    )


RECORDS = """rec AS (SELECT d.doc_id AS utterance_id, source AS speaker_id, lang AS region, CASE WHEN coalesce(try_cast(substr(source, 4) AS INT), 0) % 5 = 0 THEN 'validation' ELSE 'train' END AS dataset_split, text AS surface_text,
  CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' WHEN quality = 0 THEN 'human_reviewed' ELSE 'candidate' END AS label_status, split_part(text, ' ', 1) AS expression, source IS NOT NULL AS research, n_chars >= 200 AS training, n_chars < 20000 AS good,
  n_chars * 10.0::DOUBLE AS ms, coalesce(lang = 'en', true) AS two, 'a' || (d.doc_id % 400) AS original, 'b' || d.doc_id AS derived, 'm' || d.doc_id AS master, 'd' || d.doc_id AS asr FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT *, CASE WHEN two THEN [original, derived] ELSE [original, master, asr, master] END AS lineage, CASE WHEN two THEN [original, derived] ELSE [original, master, asr] END AS once,
  training AND good AND label_status IN ('human_reviewed', 'approved') AS fit FROM rec)"""


@query(f"WITH {RECORDS} SELECT utterance_id, speaker_id, 'test' AS split, original AS original_audio_sha256, derived AS derived_audio_sha256, 'derived/asr_16k_mono/' || utterance_id || '.wav' AS derived_audio_path, array_to_string(lineage, ',') AS lineage, md5(surface_text) AS surface, expression AS expressions FROM r")
def build_manifest(spark, d):
    m = training.build_manifest(records(spark, d), "bench", "1.0.0", "test")
    return m.select("utterance_id", "speaker_id", "split", "original_audio_sha256", "derived_audio_sha256", "derived_audio_path", F.array_join("lineage_audio_sha256s", ",").alias("lineage"), F.md5("surface_text").alias("surface"), F.array_join("dialect_expressions", ",").alias("expressions"))


@query(f"WITH {RECORDS} SELECT utterance_id, dataset_split AS split, CASE WHEN two THEN derived ELSE asr END AS asr_audio_sha256, array_to_string(once, ',') AS lineage, ms AS duration_ms, label_status FROM r WHERE fit")
def build_training_entries(spark, d):
    r = records(spark, d)
    e = training.build_training_entries(r, r.select("utterance_id", F.col("dataset_split").alias("split")))
    return e.select("utterance_id", "split", "asr_audio_sha256", F.array_join("audio_lineage_sha256s", ",").alias("lineage"), "duration_ms", "label_status")


@query(f"WITH {RECORDS} SELECT 'no_training_consent' AS rule, utterance_id::VARCHAR AS key FROM r WHERE NOT training UNION ALL SELECT 'label_not_reviewed', utterance_id::VARCHAR FROM r WHERE label_status NOT IN ('human_reviewed', 'approved') UNION ALL SELECT 'audio_quality', utterance_id::VARCHAR FROM r WHERE NOT good")
def training_violations(spark, d):
    return training.training_violations(records(spark, d))


@query(f"WITH {RECORDS} SELECT utterance_id, len(lineage)::INT AS assets FROM r")
def lineage_assets(spark, d):
    assets = training.lineage_assets(F.col("original"), F.col("derived"), F.col("master"), F.col("derivatives"))
    return records(spark, d).select("utterance_id", F.size(assets).alias("assets"))


@query(f"WITH {RECORDS} SELECT label_status, count(*) AS n FROM r WHERE good AND training AND research GROUP BY label_status")
def consent_and_quality(spark, d):
    """Records with consents and passed audio, by label status."""
    kept = contracts.consent_gate(training.audio_quality_gate(records(spark, d)), "storage_allowed", "research_use_allowed", "model_training_allowed")
    return kept.groupBy("label_status").agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS} SELECT utterance_id FROM r WHERE label_status IN ('human_reviewed', 'approved')")
def label_status_gate(spark, d):
    return contracts.label_status_gate(records(spark, d)).select("utterance_id")


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as frozen entries."""
    return table(spark, sf_dir, "benchmark").select(
        F.lit("bench@1").alias("benchmark"), (F.col("item_id") * 25).alias("utterance_id"), F.concat(F.lit("voice"), F.col("item_id") % 7).alias("speaker_id"), F.array(F.concat(F.lit("a"), F.col("item_id"))).alias("lineage"), F.col("text").alias("surface_text")
    )


_POOL = f"""{RECORDS}, frozen AS (SELECT item_id * 25 AS u, 'voice' || (item_id % 7) AS v, 'a' || item_id AS sha, {surface_sql('text')} AS k FROM benchmark),
leaked AS (SELECT DISTINCT utterance_id FROM (SELECT utterance_id, unnest(lineage) AS sha FROM r) WHERE sha IN (SELECT sha FROM frozen)), own AS (SELECT *, {surface_sql('surface_text')} AS k, count(*) OVER (PARTITION BY derived) > 1 AS twice FROM r),
bad AS (SELECT unnest(list_filter([CASE WHEN utterance_id IN (SELECT u FROM frozen) THEN 'utterance_in_benchmark' END, CASE WHEN speaker_id IN (SELECT v FROM frozen) THEN 'speaker_in_benchmark' END,
  CASE WHEN utterance_id IN (SELECT utterance_id FROM leaked) THEN 'audio_in_benchmark' END, CASE WHEN k <> '' AND k IN (SELECT k FROM frozen) THEN 'surface_in_benchmark' END,
  CASE WHEN speaker_id IS DISTINCT FROM 'src1' THEN 'speaker' END, CASE WHEN dataset_split <> 'train' THEN 'split' END, CASE WHEN label_status <> 'approved' THEN 'label_not_approved' END,
  CASE WHEN NOT (research AND training) THEN 'consent' END, CASE WHEN NOT good THEN 'audio_quality' END, CASE WHEN utterance_id NOT IN (SELECT page_id FROM pages) THEN 'audio_missing' END, CASE WHEN twice THEN 'duplicate_audio' END], lambda x: x IS NOT NULL)) AS rule, utterance_id FROM own)"""


def _pool(spark, d):
    files = table(spark, d, "pages").select(F.concat(F.lit("derived/asr_16k_mono/"), F.col("page_id").cast("string"), F.lit(".wav")).alias("path"), F.concat(F.lit("b"), F.col("page_id").cast("string")).alias("sha256"))
    r = records(spark, d)
    return training.train_pool(r.select("utterance_id"), r, _frozen(spark, d), files, "src1")


@query(f"WITH {_POOL} SELECT 'audio/' || utterance_id || '.wav' AS audio_filepath, ms / 1000 AS duration, speaker_id, derived AS audio_sha256 FROM own WHERE utterance_id NOT IN (SELECT utterance_id FROM bad)")
def train_pool_rows(spark, d):
    return _pool(spark, d)[0].select("audio_filepath", "duration", "speaker_id", "audio_sha256")


@query(f"WITH {_POOL} SELECT rule, utterance_id::VARCHAR AS key FROM bad")
def train_pool_violations(spark, d):
    return _pool(spark, d)[1]


def _recordings(spark, d):
    """Pages as recordings, numbered by their id; a page that repeats a url is a duplicate."""
    place = F.row_number().over(Window.partitionBy("url").orderBy("page_id"))
    return table(spark, d, "pages").select((F.col("page_id") + 1).cast("int").alias("number"), F.concat("url", "page_id").alias("name"), F.when(place > 1, "duplicate").otherwise("ok").alias("status"), F.octet_length("html").alias("length"), F.concat(F.lit("a"), F.col("page_id").cast("string")).alias("sha256"))


_PLAN = f"""rec AS (SELECT (page_id + 1)::INT AS number, url || page_id AS name, CASE WHEN row_number() OVER (PARTITION BY url ORDER BY page_id) > 1 THEN 'duplicate' ELSE 'ok' END AS status, strlen(html) AS size, 'a' || page_id AS sha FROM pages),
prompts AS (SELECT doc_id::INT AS number, min(text) AS text FROM documents GROUP BY 1), num AS (SELECT i::INT AS number FROM range(1, 301) t(i)), found AS (SELECT * FROM rec WHERE status = 'ok'),
mapped AS (SELECT f.*, p.text FROM num JOIN found f USING (number) JOIN prompts p USING (number)), usable AS (SELECT *, {surface_sql('text')} AS k FROM mapped WHERE size > 0)"""
_FROZEN = f"fr AS (SELECT 'a' || item_id AS sha, 'voice' || (item_id % 7) AS v, {surface_sql('text')} AS k FROM benchmark)"


def _plan(spark, d):
    prompts = table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("number"), "text")
    return training.import_plan(prompts, _recordings(spark, d), _frozen(spark, d), 1, 300, "voice3", {"storage_allowed": True, "research_use_allowed": True}, "bench@2")


@query(f"WITH {_PLAN} SELECT format('T004-S{{:03d}}', number) AS prompt_id, name AS source_filename, sha AS source_audio_sha256, md5(text) AS surface FROM usable")
def import_plan_items(spark, d):
    """The recordings 1 to 300 of the pages, as an import names them."""
    return _plan(spark, d)[0].select("prompt_id", "source_filename", "source_audio_sha256", F.md5("candidate_surface_text").alias("surface"))


@query(
    f"WITH {_PLAN}, {_FROZEN} SELECT 'recording' AS rule, status || ': ' || name AS key FROM rec WHERE status <> 'ok' UNION ALL SELECT 'missing_recording', number::VARCHAR FROM num WHERE number NOT IN (SELECT number FROM found) UNION ALL SELECT 'outside_range', number::VARCHAR FROM found WHERE number NOT IN (SELECT number FROM num)"
    " UNION ALL SELECT 'missing_prompt', number::VARCHAR FROM num WHERE number NOT IN (SELECT number FROM prompts) UNION ALL SELECT 'benchmark_not_checked', 'bench@2' UNION ALL SELECT DISTINCT 'speaker_in_benchmark', v FROM fr WHERE v = 'voice3' UNION ALL SELECT 'consent', 'model_training_allowed'"
    " UNION ALL SELECT 'empty_recording', name FROM mapped WHERE size <= 0 UNION ALL SELECT 'audio_in_benchmark', name FROM usable WHERE sha IN (SELECT sha FROM fr) UNION ALL SELECT 'surface_in_benchmark', number::VARCHAR FROM usable WHERE k IN (SELECT k FROM fr)"
    " UNION ALL SELECT 'duplicate_audio', sha FROM usable GROUP BY sha HAVING count(*) > 1 UNION ALL SELECT 'mapped_count', count(*)::VARCHAR FROM usable HAVING count(*) <> 300"
)
def import_plan(spark, d):
    return _plan(spark, d)[1]


@query(f"WITH {RECORDS} SELECT 'record_differs' AS rule, 'P' || r.utterance_id AS key FROM r JOIN labels l ON l.doc_id = r.utterance_id WHERE NOT coalesce(speaker_id = 'src1' AND dataset_split = 'train' AND original = 'a' || r.utterance_id AND label_status = 'candidate', false)")
def resumable_import_check(spark, d):
    r = records(spark, d)
    items = table(spark, d, "labels").join(r.select(F.col("utterance_id").alias("doc_id"), "surface_text"), "doc_id")
    items = items.select(F.col("doc_id").alias("utterance_id"), F.concat(F.lit("P"), F.col("doc_id").cast("string")).alias("prompt_id"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("source_audio_sha256"), F.col("surface_text").alias("candidate_surface_text"))
    return training.resumable_import_check(items, r, "src1")


@query("WITH o AS (SELECT o_custkey AS import_id, o_orderkey AS entry FROM orders), p AS (SELECT *, row_number() OVER (PARTITION BY import_id ORDER BY entry) AS position FROM o) SELECT import_id, position, entry, CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'candidate' END AS label_status FROM p JOIN orders ON o_orderkey = entry")
def import_review_queue(spark, d):
    """Orders as an import's ledger by customer, and as the utterances that it names."""
    o = table(spark, d, "orders")
    ledger = o.select(F.col("o_custkey").alias("import_id"), F.col("o_orderkey").alias("entry"), F.col("o_orderkey").alias("utterance_id"))
    utterances = o.select(F.col("o_orderkey").alias("utterance_id"), F.lit("x").alias("surface_text"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("candidate").alias("label_status"), F.lit("label_v1").alias("label_version"))
    return training.import_review_queue(ledger, utterances).select("import_id", F.col("position").cast("long").alias("position"), "entry", "label_status")


@query("SELECT o_custkey AS import_id, max(o_orderdate)::VARCHAR AS created_at, count(*) AS entry_count FROM orders GROUP BY 1")
def import_summaries(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("import_id"), F.col("o_orderdate").alias("created_at"), F.lit("s").alias("speaker_id"))
    return training.import_summaries(o).select("import_id", F.col("created_at").cast("string").alias("created_at"), "entry_count")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 25")
def newest_first(spark, d):
    """The 25 newest orders: a listing of bounded length."""
    rows = history.newest_first(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 25)
    return rows.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("place"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT user_id, count(*) AS events, max(n) AS versions FROM r GROUP BY user_id")
def event_versions(spark, d):
    v = history.label_versions(table(spark, d, "events").withColumnsRenamed({"user_id": "utterance_id", "event_id": "revision_id", "ts": "created_at"}))
    return v.groupBy(F.col("utterance_id").alias("user_id")).agg(F.count("*").alias("events"), F.max(F.regexp_extract("label_version", r"(\d+)$", 1).cast("long")).alias("versions"))


@query("WITH s AS (SELECT user_id, count(*) AS n, max(ts)::DATE AS last FROM events GROUP BY user_id) SELECT user_id, (last + [1, 3, 7, 14][least(n - 1, 3) + 1]::INT)::VARCHAR AS due FROM s WHERE last + [1, 3, 7, 14][least(n - 1, 3) + 1]::INT <= (SELECT max(ts)::DATE + 13 FROM events)")
def due_reviews(spark, d):
    """Reviews that are due 13 days after the last event."""
    e = table(spark, d, "events")
    today = e.agg(F.date_add(F.max("ts").cast("date"), 13).alias("today"))
    schedule = history.review_schedule(e, "user_id", "ts").crossJoin(F.broadcast(today))  # one row
    return history.due_reviews(schedule, F.col("today")).select("user_id", F.col("due").cast("string").alias("due"))


@query(f"WITH {REVIEWS}, p AS (SELECT c_custkey AS prediction_id, c_custkey AS utterance_id FROM customer), c AS (SELECT o_custkey AS utterance_id, count(*) AS n FROM orders GROUP BY 1) SELECT 'case_missing' AS rule, utterance_id::VARCHAR AS key FROM p WHERE utterance_id NOT IN (SELECT utterance_id FROM c) UNION ALL SELECT 'case_duplicate', utterance_id::VARCHAR FROM c WHERE n > 1 UNION ALL SELECT 'review_missing', utterance_id::VARCHAR FROM p WHERE prediction_id NOT IN (SELECT prediction_id FROM latest) UNION ALL SELECT 'review_of_another', prediction_id::VARCHAR FROM latest JOIN p USING (prediction_id) WHERE review_id % 150 <> p.utterance_id")
def recalibration_input(spark, d):
    """Customers as entries and predictions, orders as their cases, events as reviews: what doesn't fit together."""
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("utterance_id"))
    predictions = ids.select(F.col("utterance_id").alias("prediction_id"), "utterance_id", F.lit("x").alias("hypothesis"))
    cases = table(spark, d, "orders").select(F.col("o_custkey").alias("utterance_id"), F.col("o_totalprice").alias("cer"))
    reviews = lenses.reviews(spark, d).withColumn("utterance_id", F.col("review_id") % 150)
    return calibration.recalibration_input(ids, predictions, cases, reviews)[1]


@query("WITH p AS (SELECT l_partkey AS b, l_suppkey AS v, l_orderkey * 10 + l_linenumber AS revision, l_shipdate AS t, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, (l_orderkey * 10 + l_linenumber)::VARCHAR DESC) AS n FROM lineitem) SELECT c_custkey AS experiment_id, coalesce(revision::VARCHAR, 'live-observation-only') AS revision_id FROM customer LEFT JOIN p ON b = c_custkey AND v = c_custkey % 97 + 1 AND n = 1")
def matching_profile(spark, d):
    experiments = table(spark, d, "customer").select(F.col("c_custkey").alias("experiment_id"), F.col("c_custkey").alias("benchmark_id"), (F.col("c_custkey") % 97 + 1).alias("benchmark_version"))
    profiles = table(spark, d, "lineitem").select(F.col("l_partkey").alias("benchmark_id"), F.col("l_suppkey").alias("benchmark_version"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("revision_id"), F.col("l_shipdate").alias("created_at"), F.lit("r").alias("rules"))
    return calibration.matching_profile(experiments, profiles).select("experiment_id", "revision_id")


@query("SELECT 'i' || p_partkey AS item_id, p_partkey AS utterance_id, p_name AS reference, p_brand AS expressions, p_type AS a FROM part JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON l_partkey = p_partkey")
def prepare_ab_queue(spark, d):
    parts = table(spark, d, "part")
    manifest = parts.select(F.col("p_partkey").alias("utterance_id"), F.col("p_name").alias("surface_text"), F.array(F.struct(F.col("p_brand").alias("surface_form"))).alias("dialect_expressions"))
    queue = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(parts, "p_partkey").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_partkey").alias("utterance_id"), F.lit("a.wav").alias("audio_path"), F.col("p_type").alias("A"), F.col("p_name").alias("B"))
    items = governance.prepare_ab_queue(queue, manifest)[0]
    return items.select("item_id", "utterance_id", F.col("reference_surface_text").alias("reference"), F.array_join("dialect_expressions", ",").alias("expressions"), F.col("candidate_A").alias("a"))


_SETS = r"""e AS (SELECT doc_id AS u, lang AS d, source AS s, 'rec' || (doc_id // 3) AS r, ['a' || (doc_id % 400), 'b' || doc_id] AS l, regexp_replace(nfc_normalize(text), '[\p{Z}\p{P}]', '', 'g') AS k FROM documents WHERE lang IS NOT NULL),
sizes AS (SELECT d, count(*) AS n, count(DISTINCT s) AS voices FROM e GROUP BY d), b AS (SELECT regexp_replace(nfc_normalize(text), '[\p{Z}\p{P}]', '', 'g') AS k, 'rec' || item_id AS r, 'a' || item_id AS sha FROM benchmark)"""


@query(
    f"WITH {_SETS} SELECT d AS dataset_id, 'too_few_utterances' AS rule, n::VARCHAR AS key, 'error' AS level FROM sizes WHERE n < 300 UNION ALL SELECT d, 'too_few_speakers', voices::VARCHAR, 'error' FROM sizes WHERE voices < 40 UNION ALL SELECT DISTINCT d, 'speaker_overlap', s, 'error' FROM e WHERE s IN (SELECT 'src' || n_nationkey FROM nation)"
    " UNION ALL SELECT DISTINCT d, 'utterance_overlap', u::VARCHAR, 'error' FROM e WHERE u IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT DISTINCT d, 'recording_overlap', r, 'error' FROM e WHERE r IN (SELECT r FROM b)"
    " UNION ALL SELECT DISTINCT d, 'audio_overlap', u::VARCHAR, 'error' FROM (SELECT d, u, unnest(l) AS sha FROM e) WHERE sha IN (SELECT sha FROM b) UNION ALL SELECT DISTINCT d, 'surface_overlap', u::VARCHAR, 'warning' FROM e WHERE k IN (SELECT k FROM b)"
)
def evaluation_set_check(spark, d):
    """Documents as held-out sets by language, against toxic labels, the benchmark and some speakers."""
    docs = table(spark, d, "documents").where("lang is not null")
    entries = docs.select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("utterance_id"), F.col("source").alias("speaker_id"), F.concat(F.lit("rec"), F.floor(F.col("doc_id") / 3).cast("string")).alias("source_recording_id"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("audio_sha256"),
        F.array(F.concat(F.lit("a"), (F.col("doc_id") % 400).cast("string"))).alias("audio_lineage"), F.col("text").alias("surface_text"), F.array(F.lit("x")).alias("dialect_expressions"), F.lit("a.wav").alias("audio_filepath"),
    )
    bench, item = table(spark, d, "benchmark"), F.col("item_id").cast("string")
    registry = governance.exclusion_registry(
        (table(spark, d, "nation"), {"speaker": F.concat(F.lit("src"), F.col("n_nationkey").cast("string"))}), (table(spark, d, "labels").where("toxic = 1"), {"utterance": F.col("doc_id")}),
        (bench, {"recording": F.concat(F.lit("rec"), item), "audio": F.concat(F.lit("a"), item), "surface": text.normalize_for_cer(F.col("text"))}),
    )
    return governance.evaluation_set_check(entries, registry, 300, 40)


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as a held-out set by role: one arm hears the next turn, the other hears even turns right."""
    c = lenses.cases(spark, sf_dir).select(F.col("role").alias("candidate"), F.col("case_id").alias("utterance_id"), F.col("conv_id").cast("string").alias("speaker_id"), "reference", "hypothesis", "latency_ms", "turn")
    manifest = c.select("candidate", "utterance_id", "speaker_id", F.col("reference").alias("surface_text"), F.array(F.split("reference", " ")[0]).alias("dialect_expressions"))
    better = F.when(F.col("turn") % 2 == 0, F.col("reference")).otherwise(F.col("hypothesis"))
    return manifest, c.select("candidate", "utterance_id", "hypothesis", "latency_ms"), c.select("candidate", "utterance_id", better.alias("hypothesis"), (F.col("latency_ms") + 1).alias("latency_ms"))


_ARMS = f"{CASES}, arms AS (SELECT role AS candidate, case_id, conv_id, ref_chars, edits, CASE WHEN turn % 2 = 0 THEN 0 ELSE edits END AS edits2, preserved, CASE WHEN turn % 2 = 0 THEN 1 ELSE preserved END AS preserved2, trim(hypothesis) = '' AS blank, trim(CASE WHEN turn % 2 = 0 THEN reference ELSE hypothesis END) = '' AS blank2, latency_ms FROM scored)"
_REPORT = """report AS (SELECT candidate, count(*) AS utterances, count(DISTINCT conv_id) AS speakers, count(*) FILTER (edits2 < edits) AS improved, count(*) FILTER (edits2 = edits) AS equal, count(*) FILTER (edits2 > edits) AS worsened,
  round(sum(edits) / sum(ref_chars), 6) AS pretrained_cer, round(sum(edits2) / sum(ref_chars), 6) AS fine_tuned_cer, round(sum(preserved) / count(*), 6) AS pretrained_dialect_preservation, round(sum(preserved2) / count(*), 6) AS fine_tuned_dialect_preservation,
  count(*) FILTER (blank) AS pretrained_empty_outputs, count(*) FILTER (blank2) AS fine_tuned_empty_outputs, round(quantile_cont(latency_ms, 0.95), 6) AS pretrained_latency_p95_ms FROM arms GROUP BY candidate)"""


@query(f"WITH {_ARMS} SELECT candidate, case_id AS utterance_id, edits::INT AS pretrained_edits, edits2::INT AS fine_tuned_edits, preserved::INT AS pretrained_preserved, preserved2::INT AS fine_tuned_preserved, CASE WHEN edits2 < edits THEN 'improved' WHEN edits2 > edits THEN 'worsened' ELSE 'equal' END AS outcome FROM arms")
def compare_arms(spark, d):
    return gate.compare_arms(*_arms(spark, d), "candidate").select("candidate", "utterance_id", "pretrained_edits", "fine_tuned_edits", "pretrained_preserved", "fine_tuned_preserved", "outcome")


@query(f"WITH {_ARMS}, {_REPORT} SELECT * FROM report")
def arm_report(spark, d):
    r = gate.arm_report(gate.compare_arms(*_arms(spark, d), "candidate"), True, "candidate")
    return r.drop("pretrained_latency_mean_ms", "pretrained_latency_p50_ms", "fine_tuned_latency_mean_ms", "fine_tuned_latency_p50_ms", "fine_tuned_latency_p95_ms")


def _suite(spark, d):
    manifest, pretrained, fine_tuned = _arms(spark, d)
    n = F.lit(None).cast("string")
    full = manifest.withColumns({"source_recording_id": n, "audio_sha256": F.col("utterance_id"), "audio_lineage": F.array().cast("array<string>"), "audio_filepath": n})
    roles = table(spark, d, "conversations").select(F.col("role").alias("candidate")).distinct()
    base = roles.select("candidate", F.lit(True).alias("benchmark_integrity_passed"), F.lit(0.05).alias("pilot_fine_tuned_cer"), F.lit(0.93).alias("pilot_fine_tuned_dialect_preservation"), F.lit(3).alias("pilot_pretrained_empty_outputs"), F.lit(0).alias("pilot_fine_tuned_empty_outputs"))
    passed = roles.select("candidate", F.lit(True).alias("passed"), F.lit(True).alias("bundle_passed"))
    human = roles.select("candidate", F.lit(True).alias("complete"), F.when(F.col("candidate") != "system", 0.8).alias("preference_rate"))
    banned = table(spark, d, "region").select(F.lit("speaker").alias("kind"), F.concat(F.lit("none"), "r_name").alias("value"))
    return gate.gate_suite({"independent": (full, pretrained, fine_tuned), "standard": (full, fine_tuned, pretrained)}, banned, base, passed, human)


@query(f"WITH {_ARMS}, {_REPORT} SELECT candidate, 0.8::DOUBLE AS human_fine_tuned_preference_rate, utterances AS independent_utterances, pretrained_cer AS independent_pretrained_cer, fine_tuned_cer AS independent_fine_tuned_cer, fine_tuned_dialect_preservation AS independent_fine_tuned_dialect_preservation, fine_tuned_cer AS standard_pretrained_cer, pretrained_empty_outputs AS standard_fine_tuned_empty_outputs FROM report WHERE candidate <> 'system' AND utterances >= 100 AND speakers >= 5")
def gate_evidence(spark, d):
    """Evidence by role, where both sets are large enough."""
    e = _suite(spark, d)[1].where("not review_without_key")
    return e.select("candidate", "human_fine_tuned_preference_rate", "independent_utterances", "independent_pretrained_cer", "independent_fine_tuned_cer", "independent_fine_tuned_dialect_preservation", "standard_pretrained_cer", "standard_fine_tuned_empty_outputs")


@query(f"WITH {_ARMS}, {_REPORT}, k AS (SELECT candidate, candidate <> 'system' AS human, 5 + (candidate <> 'system')::INT + 1 + (pretrained_cer = 0 AND fine_tuned_cer = 0 OR pretrained_cer > 0 AND (pretrained_cer - fine_tuned_cer) / pretrained_cer >= 0.1)::INT + (fine_tuned_dialect_preservation - pretrained_dialect_preservation >= 0.15)::INT + (fine_tuned_empty_outputs <= pretrained_empty_outputs)::INT + 1 + (pretrained_cer - fine_tuned_cer <= greatest(0.03, fine_tuned_cer * 0.15))::INT + (pretrained_empty_outputs <= fine_tuned_empty_outputs)::INT AS passed, (pretrained_cer - fine_tuned_cer > greatest(0.03, fine_tuned_cer * 0.15)) OR fine_tuned_empty_outputs <> pretrained_empty_outputs AS decisive FROM report WHERE utterances >= 100 AND speakers >= 5) SELECT candidate, passed::BIGINT AS passed, (13 - passed - (NOT human)::INT)::BIGINT AS failed, (NOT human)::BIGINT AS pending, CASE WHEN NOT human OR decisive THEN 'FAIL' WHEN passed = 13 THEN 'PASS' WHEN passed = 12 THEN 'CONDITIONAL PASS' ELSE 'FAIL' END AS status FROM k")
def gate_suite(spark, d):
    return _suite(spark, d)[0]


@query(r"WITH l AS (SELECT doc_id, split_part(text, ' ', 1) AS a, split_part(text, ' ', 2) AS b FROM documents WHERE regexp_matches(text, '^[A-Za-z]+ [A-Za-z]+ ')) SELECT doc_id, a || ',' || b AS forms, upper(a) || ',' || upper(b) AS plain, false AS wrong FROM l")
def expand_labels(spark, d):
    """A quoted list of each document's first two words as one label, expanded into two."""
    docs = table(spark, d, "documents").where(F.col("text").rlike("^[A-Za-z]+ [A-Za-z]+ "))
    a, b = F.split("text", " ")[0], F.split("text", " ")[1]
    quoted = lambda x, y: F.concat(F.lit('"'), x, F.lit('", "'), y, F.lit('"'))
    label = F.array(F.struct(quoted(a, b).alias("surface_form"), F.array(quoted(F.upper(a), F.upper(b))).alias("normalized_forms")))
    x = docs.select("doc_id", text.expand_labels(label).alias("x"))
    return x.select("doc_id", F.array_join("x.surface_form", ",").alias("forms"), F.array_join(F.flatten("x.normalized_forms"), ",").alias("plain"), F.exists("x.problem", lambda p: p.isNotNull()).alias("wrong"))


@query(f"WITH {CASES}, w AS (SELECT case_id, hypothesis, split_part(reference, ' ', 1) AS a, CASE WHEN contains(reference, ' ') THEN split_part(reference, ' ', 2) END AS b FROM scored), m AS (SELECT case_id, CASE WHEN contains(hypothesis, a) THEN 'preserved' WHEN contains(hypothesis, b) THEN 'overcorrected' ELSE 'missing' END AS match_status FROM w) SELECT case_id, match_status, (match_status = 'preserved')::INT::DOUBLE AS preservation_rate, (match_status = 'overcorrected')::INT::DOUBLE AS overcorrection_rate FROM m")
def expression_matches(spark, d):
    """Each turn's first word as its label, with the second as the normalised form."""
    words = F.split("reference", " ")
    label = F.array(F.struct(words[0].alias("surface_form"), F.array_compact(F.array(F.get(words, F.lit(1)))).alias("normalized_forms")))
    c = scoring.with_expression_matches(lenses.cases(spark, d).withColumn("labels", label)).withColumn("m", scoring.dialect_metric(F.col("matches")))
    return c.select("case_id", F.col("matches")[0]["match_status"].alias("match_status"), "m.preservation_rate", "m.overcorrection_rate")


@query(r"SELECT doc_id, contains(regexp_replace(nfc_normalize(text), '[\p{Z}\p{P}]', '', 'g'), 'thatthe') AS found FROM documents")
def contains_form(spark, d):
    return table(spark, d, "documents").select("doc_id", text.contains_form(F.col("text"), F.lit("that, the")).alias("found"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN true WHEN event_type = 'view' THEN false END AS a, CASE WHEN event_type = 'view' THEN true WHEN event_type = 'click' THEN false END AS b FROM events")
def finding_pair(spark, d):
    choice = F.when(F.col("event_type") == "click", "a").when(F.col("event_type") == "view", "b").otherwise("uncertain")
    return table(spark, d, "events").select("event_id", gate.finding_pair(choice).alias("x")).select("event_id", "x.a", "x.b")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'AUDIO_CONTRACT' WHEN o_totalprice < 20000 THEN 'EXTRACTION' WHEN o_orderpriority = '1-URGENT' THEN 'RETURNED_EMPTY' WHEN o_orderstatus = 'F' THEN 'NOT_REPRODUCED' ELSE 'UNRESOLVED' END AS kind FROM orders")
def diagnostic_class(spark, d):
    return table(spark, d, "orders").select("o_orderkey", contracts.diagnostic_class(F.col("o_orderstatus") != "P", F.col("o_totalprice") >= 20_000, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") != "F").alias("kind"))


@query("SELECT c_custkey, 'unknown_fields' AS rule, 'c_nationkey' AS detail FROM customer")
def strict_fields(spark, d):
    """Customers as JSON, read with a schema that leaves one field out."""
    rows = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_nationkey")).alias("json"))
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType())])
    return contracts.strict_fields(rows, "json", schema, "c_custkey").select(F.col("key").cast("long").alias("c_custkey"), "rule", "detail")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R') <> (l_linestatus = 'F')")
def confidence_consistency(spark, d):
    confidence = F.when(F.col("l_linestatus") == "F", F.col("l_discount"))
    return table(spark, d, "lineitem").where(contracts.confidence_consistency(F.col("l_returnflag") == "R", confidence)).select("l_orderkey", "l_linenumber")


@query(f"WITH {ENTRIES} SELECT 'split' AS rule, utterance_id::VARCHAR AS key FROM entries WHERE split NOT IN ('train', 'validation') UNION ALL SELECT 'lineage_without_asr', utterance_id::VARCHAR FROM entries WHERE region = 'fr' UNION ALL SELECT 'lineage_repeats', utterance_id::VARCHAR FROM entries WHERE region = 'de'")
def training_entry_contract(spark, d):
    e = lenses.entries(spark, d)
    asr = F.when(F.coalesce(F.col("region") == "fr", F.lit(False)), "other").otherwise(F.col("lineage")[1])
    lineage = F.when(F.coalesce(F.col("region") == "de", F.lit(False)), F.concat("lineage", "lineage")).otherwise(F.col("lineage"))
    return contracts.training_entry_contract(e.withColumns({"original_audio_sha256": F.col("lineage")[0], "asr_audio_sha256": asr, "lineage": lineage}))


@query("WITH n AS (SELECT count(*) AS n, count(DISTINCT p_partkey) AS ids, count(DISTINCT p_name) AS paths FROM part) SELECT unnest(list_filter([CASE WHEN n <> 100 THEN 'count' END, CASE WHEN ids < n THEN 'ids_repeat' END, CASE WHEN paths < n THEN 'paths_repeat' END], lambda x: x IS NOT NULL)) AS rule, 'manifest' AS key FROM n")
def manifest_shape(spark, d):
    return contracts.manifest_shape(table(spark, d, "part").select(F.col("p_partkey").alias("utterance_id"), F.col("p_name").alias("audio_path")), 100)


@query("SELECT 'not_frozen' AS rule, o_orderkey::VARCHAR AS key FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'training_allowed', o_orderkey::VARCHAR FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'kind', o_orderkey::VARCHAR FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def heldout_contract(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("dataset_id"), (F.col("o_orderstatus") != "O").alias("frozen"), (F.col("o_totalprice") > 200_000).alias("training_allowed"), F.lit(False).alias("checkpoint_selection_allowed"), F.col("o_orderpriority").alias("kind"))
    return contracts.heldout_contract(o, ("1-URGENT", "2-HIGH"))


@query("SELECT 'model_name' AS rule, p_partkey::VARCHAR AS key FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT 'model_version', p_partkey::VARCHAR FROM part WHERE p_brand <> 'Brand#11' UNION ALL SELECT 'confidence_supported', p_partkey::VARCHAR FROM part WHERE p_retailprice > 1000")
def prediction_metadata(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("utterance_id"), F.struct(F.col("p_type").alias("name"), F.col("p_brand").alias("version")).alias("model"), (F.col("p_retailprice") > 1000).alias("confidence_supported"))
    return contracts.prediction_metadata(p, {"name": "PROMO", "version": "Brand#11"})


@query("SELECT page_id, array_to_string(list_filter(['html', 'example'], lambda x: contains(lower(url || html), x)), ',') AS names FROM pages WHERE contains(lower(url || html), 'html') OR contains(lower(url || html), 'example')")
def blinding_check(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("item_id"), F.concat("url", "html").alias("text"))
    return contracts.blinding_check(pages.select("item_id", "text"), ("HTML", "Example")).select(F.col("item_id").alias("page_id"), F.array_join("names", ",").alias("names"))


@query("WITH d AS (SELECT doc_id AS u, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'maybe' END AS s FROM labels) SELECT u AS utterance_id, s AS status, CASE WHEN lang IS NULL THEN 'unknown' WHEN u IN (SELECT item_id FROM benchmark) THEN 'frozen' WHEN s = 'maybe' THEN 'bad status' WHEN s = CASE WHEN lang = 'en' THEN 'approved' ELSE 'candidate' END THEN 'unchanged' ELSE 'accepted' END AS outcome FROM d LEFT JOIN (SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL) x ON x.doc_id = u")
def review_decisions(spark, d):
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("maybe")
    decisions = table(spark, d, "labels").select(F.col("doc_id").alias("utterance_id"), status.alias("status"), F.lit(None).cast("string").alias("surface_text"))
    current = table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("utterance_id"), F.when(F.col("lang") == "en", "approved").otherwise("candidate").alias("label_status"), F.col("text").alias("surface_text"))
    return contracts.review_decisions(decisions, current, table(spark, d, "benchmark").select(F.col("item_id").alias("utterance_id"))).select("utterance_id", "status", "outcome")


@query("SELECT o_orderkey AS utterance_id, l_partkey AS predicted_utterance, o_orderkey = l_partkey AS agrees FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def attach_predictions(spark, d):
    manifest = table(spark, d, "orders").select(F.col("o_orderkey").alias("audio_sha256"), F.col("o_orderkey").alias("utterance_id"))
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("audio_sha256"), F.col("l_partkey").alias("utterance_id"), F.lit("x").alias("hypothesis"))
    return governance.attach_predictions(manifest, p).select("utterance_id", "predicted_utterance", "agrees")


@query("WITH n AS (SELECT i AS number FROM range(1, 101) t(i)), p AS (SELECT c_custkey AS number, c_name AS prompt FROM customer), r AS (SELECT s_suppkey AS number, s_name AS recording FROM supplier) SELECT coalesce(n.number, p.number, r.number) AS number, prompt, recording, CASE WHEN n.number IS NULL THEN 'outside' WHEN prompt IS NULL THEN 'no prompt' WHEN recording IS NULL THEN 'no recording' ELSE 'mapped' END AS status FROM n FULL JOIN p ON n.number = p.number FULL JOIN r ON r.number = coalesce(n.number, p.number)")
def map_prompts(spark, d):
    prompts = table(spark, d, "customer").select(F.col("c_custkey").alias("number"), F.col("c_name").alias("prompt"))
    recordings = table(spark, d, "supplier").select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("recording"))
    return governance.map_prompts(prompts, recordings, 1, 100)


@query("WITH r AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1) SELECT c_custkey, n AS rule_count FROM customer LEFT JOIN r ON k = c_nationkey")
def attach_rules(spark, d):
    labels = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("surface_form"))
    rules = table(spark, d, "nation").select(F.col("n_regionkey").alias("surface_form"), F.array("n_name").alias("variants"), F.array("n_name").alias("standards"))
    return calibration.attach_rules(labels, rules).select("c_custkey", "rule_count")


@query("WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS experiment_id, n AS reports, array_to_string(list_filter([CASE WHEN l_partkey <> o_custkey THEN 'a' END, CASE WHEN l_linestatus <> o_orderstatus THEN 'b' END], lambda x: x IS NOT NULL), ',') AS differs FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN n ON k = o_orderkey")
def report_identity(spark, d):
    report = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("experiment_id"), F.col("l_partkey").alias("a"), F.col("l_linestatus").alias("b"))
    experiment = table(spark, d, "orders").select(F.col("o_orderkey").alias("experiment_id"), F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"))
    return calibration.report_identity(report, experiment)


@query("SELECT 'n_regionkey' AS \"column\", count(DISTINCT n_regionkey) AS n, count(DISTINCT n_regionkey) = 1 AS single FROM nation UNION ALL SELECT 'n_name', count(DISTINCT n_name), count(DISTINCT n_name) = 1 FROM nation")
def single_valued(spark, d):
    return governance.single_valued(table(spark, d, "nation"), "n_regionkey", "n_name")


@query("SELECT 'parent_missing' AS rule, o_orderkey::VARCHAR AS key, l_linenumber::VARCHAR AS detail FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber > 1 AND (l_orderkey, l_linenumber - 1) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem) UNION ALL SELECT DISTINCT 'role_repeated', l_orderkey::VARCHAR, l_returnflag FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) AS n FROM lineitem) WHERE n > 1")
def lineage_chain(spark, d):
    assets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("utterance_id"), F.col("l_returnflag").alias("role"), F.col("l_linenumber").cast("string").alias("sha256"), F.when(F.col("l_linenumber") > 1, (F.col("l_linenumber") - 1).cast("string")).alias("parent_sha256"))
    return governance.lineage_chain(assets)


@query("SELECT o_orderkey, coalesce(min(l_partkey) FILTER (l_linenumber = 3), o_custkey) AS sha FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey")
def asset_for_role(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("string").alias("role"), F.col("l_partkey").alias("sha")))).alias("assets"))
    asset = governance.asset_for_role(F.col("assets"), "3", F.struct(F.lit("x").alias("role"), F.col("o_custkey").alias("sha")))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", asset["sha"].alias("sha"))


@query("SELECT c_custkey, (1 + (c_acctbal < 0)::INT + (c_nationkey > 3)::INT + (c_acctbal > 5000 AND c_nationkey > 10)::INT + (c_mktsegment = 'BUILDING')::INT)::INT AS notes FROM customer")
def limitations(spark, d):
    r = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, 0).otherwise(5).alias("with_confidence"), F.greatest(F.col("c_nationkey") - 3, F.lit(0)).alias("uncertain"), F.when(F.col("c_acctbal") > 5000, 0.0).otherwise(0.5).alias("context_overcorrection_rate"),
        F.greatest(F.col("c_nationkey") - 10, F.lit(0)).alias("language_model_bias"), F.when(F.col("c_mktsegment") != "BUILDING", "c").alias("checkpoint_identifier"),
    )
    return reports.limitations(r).select("c_custkey", F.size("limitations").alias("notes"))


@query("SELECT c_custkey, CASE WHEN c_nationkey > 5 THEN '# TASK-' || c_custkey || ' Human-reviewed Baseline Report' ELSE '# Human-reviewed Surface ASR Baseline Report' END AS title FROM customer")
def report_title(spark, d):
    named = F.when(F.col("c_nationkey") > 5, F.concat(F.lit("task-"), F.col("c_custkey").cast("string"), F.lit("-run"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", reports.report_title(named).alias("title"))
