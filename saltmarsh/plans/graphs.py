"""Registered queries over closures, audits, names and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import audio, text
from ..operators import audits, closure, contracts, governance, history, report_text, reports
from . import lenses
from .lenses import CASES, ENTRIES, REVIEWS, surface_sql, table
from .registry import query

_ASSETS = """assets AS (SELECT o_custkey AS utterance_id, o_orderkey AS sha256, CASE WHEN o_orderkey % 13 = 5 THEN NULL WHEN o_orderkey % 17 = 3 THEN -1 ELSE coalesce(lag(o_orderkey) OVER w, CASE WHEN o_custkey % 4 = 1 THEN last_value(o_orderkey) OVER w END) END AS parent_sha256,
  CASE o_orderkey % 3 WHEN 0 THEN 'asr_16k_mono' WHEN 1 THEN 'tts_48k_mono' ELSE 'original' END AS role, CASE o_orderkey % 3 WHEN 0 THEN 16000 WHEN 1 THEN 48000 END - o_orderkey % 2 * (o_orderkey % 5) AS rate, 'pcm_s16le' AS codec
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
up AS (SELECT a.*, b.sha256 IS NOT NULL AS there FROM assets a LEFT JOIN assets b ON b.utterance_id = a.utterance_id AND b.sha256 = a.parent_sha256),
walk AS (SELECT utterance_id, sha256, sha256 AS anc FROM up UNION SELECT walk.utterance_id, walk.sha256, up.parent_sha256 FROM walk JOIN up ON up.utterance_id = walk.utterance_id AND up.sha256 = walk.anc AND up.there),
ends AS (SELECT walk.utterance_id, walk.sha256, max(CASE WHEN NOT there THEN anc END) AS top, count(*) - 1 AS steps, max(CASE WHEN NOT there THEN CASE WHEN parent_sha256 IS NULL THEN 'root' ELSE 'dangling' END END) AS ended FROM walk JOIN up ON up.utterance_id = walk.utterance_id AND up.sha256 = walk.anc GROUP BY ALL)"""


def _assets(spark: SparkSession, d: str) -> DataFrame:
    """Assets of customers: each order comes from the one before; some chains begin anew, some hang, some end in themselves."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = F.col("o_orderkey")
    before = F.coalesce(F.lag("o_orderkey").over(w), F.when(F.col("o_custkey") % 4 == 1, F.max("o_orderkey").over(Window.partitionBy("o_custkey"))))
    parent = F.when(k % 13 == 5, None).when(k % 17 == 3, -1).otherwise(before)
    role = F.when(k % 3 == 0, "asr_16k_mono").when(k % 3 == 1, "tts_48k_mono").otherwise("original")
    rate = F.when(k % 3 == 0, 16_000).when(k % 3 == 1, 48_000) - k % 2 * (k % 5)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("utterance_id"), k.alias("sha256"), parent.alias("parent_sha256"), role.alias("role"), rate.alias("rate"), F.lit(1).alias("channels"), F.lit("pcm_s16le").alias("codec"))


@query(f"WITH RECURSIVE {_ASSETS} SELECT utterance_id, sha256, coalesce(ended, 'cycle') AS ended, top AS root_sha256, CASE WHEN ended IS NOT NULL THEN steps END AS depth FROM ends")
def lineage_roots(spark, d):
    return closure.lineage_roots(_assets(spark, d))


@query(
    f"""WITH RECURSIVE {_ASSETS}, n AS (SELECT utterance_id, count(DISTINCT top) FILTER (ended = 'root') AS n FROM ends GROUP BY 1)
SELECT coalesce(ended, 'cycle') AS rule, utterance_id::VARCHAR AS key, sha256::VARCHAR AS detail FROM ends WHERE ended IS DISTINCT FROM 'root'
UNION ALL SELECT CASE WHEN n > 1 THEN 'two_roots' ELSE 'no_root' END, utterance_id::VARCHAR, n::VARCHAR FROM n WHERE n <> 1
UNION ALL SELECT 'format', utterance_id::VARCHAR, sha256::VARCHAR FROM assets WHERE role = 'tts_48k_mono' OR role = 'asr_16k_mono' AND rate <> 16000"""
)
def lineage_violations(spark, d):
    return closure.lineage_violations(_assets(spark, d))


_GONE = """WITH g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'), orders_ AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT k FROM g)),
predictions AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_orderkey IN (SELECT k FROM g)), reviews AS (SELECT event_id AS id FROM events WHERE event_id // 2 * 10 + 1 + event_id % 2 IN (SELECT id FROM predictions)),
revisions AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) FILTER (o_orderkey IN (SELECT k FROM g)) > 0), assets AS (SELECT l_partkey AS id FROM lineitem GROUP BY 1 HAVING bool_and(l_orderkey IN (SELECT k FROM g))),
reports AS (SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT k FROM g)))"""
_COUNTED = " UNION ALL ".join(
    f"SELECT '{name}' AS name, {total} - (SELECT count(*) FROM {gone}) AS kept, (SELECT count(*) FROM {gone}) AS archived"
    for name, gone, total in (
        ("assets", "assets", "(SELECT count(DISTINCT l_partkey) FROM lineitem)"), ("orders", "orders_", "(SELECT count(*) FROM orders)"), ("predictions", "predictions", "(SELECT count(DISTINCT l_orderkey * 10 + l_linenumber) FROM lineitem)"),
        ("reports", "reports", "(SELECT count(*) FROM customer)"), ("reviews", "reviews", "(SELECT count(*) FROM events)"), ("revisions", "revisions", "(SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'P')"),
    )
)


@query(f"{_GONE} {_COUNTED}")
def archive_closure(spark, d):
    """Urgent closed orders go, with their predictions, those's reviews, lists and reports that name them, and parts that nothing else uses."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    named = orders.groupBy("o_custkey").agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit("#"), "o_orderkey", F.lit("#")))).alias("body"))
    tables = {
        "orders": orders.select(F.col("o_orderkey").alias("id")),
        "predictions": lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("of"), F.col("l_partkey").alias("part")),
        "reviews": table(spark, d, "events").select(F.col("event_id").alias("id"), (F.floor(F.col("event_id") / 2) * 10 + 1 + F.col("event_id") % 2).alias("of")),
        "revisions": orders.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderkey").alias("of")),
        "reports": table(spark, d, "customer").join(named, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("id"), "body"),
        "assets": lines.select(F.col("l_partkey").alias("id")).distinct(),
    }
    links = [closure.Link("predictions", "of", "orders"), closure.Link("reviews", "of", "predictions"), closure.Link("revisions", "of", "orders", "array"), closure.Link("reports", "body", "orders", "text", ("#", "#"))]
    seeds = {"orders": orders.where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))}
    gone = closure.archive_closure(seeds, tables, links, {"assets": [("predictions", "part")]})
    out = None
    for name, t in tables.items():
        flagged = t.select("id").distinct().join(gone[name].withColumn("_gone", F.lit(True)), "id", "left")
        one = flagged.agg(F.lit(name).alias("name"), F.count_if(F.col("_gone").isNull()).alias("kept"), F.count_if(F.col("_gone").isNotNull()).alias("archived"))
        out = one if out is None else out.unionByName(one)
    return out


_FORMS = """forms AS (SELECT source, doc_id, text, list_transform(range(doc_id % 4), lambda i: 's' || doc_id || '-' || i) AS names FROM documents)"""


@query(
    f"""WITH {_FORMS}, n AS (SELECT source, sum(CASE WHEN len(names) = 3 THEN 1 ELSE len(names) END)::BIGINT AS stored_raw, sum(len(names))::BIGINT AS canonical_raw, bool_or(doc_id % 97 = 11) AS changed FROM forms GROUP BY source)
SELECT source, stored_raw, canonical_raw, canonical_raw AS expressions, CASE WHEN stored_raw <> canonical_raw THEN 'legacy_quoted_compound' ELSE 'expanded_labels' END AS stored_structure, 'expanded_labels' AS canonical_structure,
  CASE WHEN changed THEN 'different_content' ELSE 'audited_semantic_equivalence_keep_version' END AS decision FROM n"""
)
def benchmark_audit(spark, d):
    """Documents as written in two ways: three labels as one quoted list, or one by one; some texts differ."""
    docs = table(spark, d, "documents").withColumn("names", F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < F.col("doc_id") % 4), lambda i: F.concat(F.lit("s"), F.col("doc_id"), F.lit("-"), i)))
    label = lambda s: F.struct(s.alias("surface_form"), F.array().cast("array<string>").alias("normalized_forms"))
    quoted = F.concat(F.lit('"'), F.array_join("names", '", "'), F.lit('"'))
    one_by_one = F.transform("names", label)
    rows = docs.select("source", F.col("doc_id").alias("utterance_id"), F.col("text").alias("surface_text"), one_by_one.alias("labels"), F.when(F.size("names") == 3, F.array(label(quoted))).otherwise(one_by_one).alias("stored"))
    changed = F.when(F.col("utterance_id") % 97 == 11, F.concat(F.coalesce("surface_text", F.lit("")), F.lit("!"))).otherwise(F.col("surface_text"))
    return audits.benchmark_audit(rows.select("source", "utterance_id", "surface_text", F.col("stored").alias("labels")), rows.select("source", "utterance_id", changed.alias("surface_text"), "labels"))


_BUNDLES = """p AS (SELECT page_id, page_id % 20 AS bundle, 'p/' || page_id || '.html' AS path, strlen(html) AS size, sha256(html) AS hash FROM pages),
listed AS (SELECT bundle, CASE WHEN page_id % 31 = 4 THEN '../' || path ELSE path END AS path, size + (page_id % 23 = 6)::INT AS size, CASE WHEN page_id % 29 = 9 THEN 'x' ELSE hash END AS hash, page_id FROM p WHERE page_id % 7 <> 5),
files AS (SELECT bundle, path, size, hash FROM p WHERE page_id % 11 <> 2), good AS (SELECT * FROM listed WHERE page_id % 31 <> 4),
found AS (SELECT coalesce(g.bundle, f.bundle) AS bundle, CASE WHEN g.path IS NULL THEN 'unexpected' WHEN f.path IS NULL THEN 'missing' WHEN g.size <> f.size THEN 'size_mismatch' WHEN g.hash <> f.hash THEN 'hash_mismatch' ELSE 'verified' END AS status
  FROM good g FULL JOIN files f ON g.bundle = f.bundle AND g.path = f.path UNION ALL SELECT bundle, 'unsafe' FROM listed WHERE page_id % 31 = 4 UNION ALL SELECT bundle, 'duplicate' FROM good WHERE page_id % 37 = 1)"""


@query(f"WITH {_BUNDLES} SELECT bundle, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in ('verified', 'missing', 'size_mismatch', 'hash_mismatch', 'unexpected', 'unsafe', 'duplicate'))}, bool_and(status = 'verified') AS passed FROM found GROUP BY bundle")
def bundle_audit(spark, d):
    """Pages as files of twenty bundles, against an index that is wrong in places."""
    k = F.col("page_id")
    p = table(spark, d, "pages").select("page_id", (k % 20).alias("bundle"), F.concat(F.lit("p/"), k, F.lit(".html")).alias("path"), F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha256"))
    listed = p.where(k % 7 != 5).select("bundle", F.when(k % 31 == 4, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("relative_path"), (F.col("size") + (k % 23 == 6).cast("int")).alias("size_bytes"), F.when(k % 29 == 9, "x").otherwise(F.col("sha256")).alias("sha256"), "page_id")
    index = listed.unionByName(listed.where((k % 37 == 1) & (k % 31 != 4))).drop("page_id")
    files = p.where(k % 11 != 2).select("bundle", "path", "size", "sha256", F.lit(False).alias("is_symlink"))
    own = p.select("bundle").distinct().select("bundle", F.lit(audits.OWN_FILES[0]).alias("path"), F.lit(1).alias("size"), F.lit("h").alias("sha256"), F.lit(False).alias("is_symlink"))
    return audits.bundle_result(audits.bundle_audit(index, files.unionByName(own)))


_REVIEWED = """e AS (SELECT *, user_id % 30 AS review, row_number() OVER (PARTITION BY user_id % 30 ORDER BY event_id) AS position, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' WHEN 'signup' THEN 'tie' WHEN 'error' THEN 'uncertain' END AS p FROM events),
s AS (SELECT review, count(*) AS total_items, count(*) FILTER (p IS NOT NULL AND event_id % 6 <> 1) AS reviewed_items, CASE WHEN review % 3 = 0 THEN 'in_progress' ELSE 'complete' END AS status FROM e GROUP BY review),
w AS (SELECT review, CASE WHEN p IN ('A', 'B') THEN CASE WHEN (p = 'A') = (event_id % 2 = 0) THEN 'tuned' ELSE 'base' END ELSE p END AS w FROM e),
t AS (SELECT review, count(*) FILTER (w = 'tuned') AS wins, count(*) FILTER (w = 'base') AS losses, count(*) FILTER (w = 'tie') AS ties, count(*) FILTER (w = 'uncertain') AS uncertain FROM w GROUP BY review)"""


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, kind = F.col("event_id"), F.col("event_type")
    e = table(spark, d, "events").withColumn("review", F.col("user_id") % 30)
    e = e.withColumn("position", F.row_number().over(Window.partitionBy("review").orderBy("event_id")))
    queue = e.select("review", "position", k.alias("item_id"), "user_id", F.col("user_id").alias("utterance_id")).drop("user_id")
    choice = F.when(kind == "view", "A").when(kind == "click", "B").when(kind == "signup", "tie").when(kind == "error", "uncertain")
    other = F.when(k % 6 != 1, True)
    results = e.select(
        "review", (F.col("position") + (k % 101 == 7).cast("int") * 1_000_000).alias("position"), k.alias("item_id"), F.when(k % 103 == 9, -1).otherwise(F.col("user_id")).alias("utterance_id"), choice.alias(audits.DECISIONS[0]),
        *[other.alias(c) for c in audits.DECISIONS[1:]], F.when(F.col("review") % 3 == 0, "in_progress").otherwise("complete").alias("status"),
    )
    ours = k % 2 == 0
    key = e.select("review", k.alias("item_id"), F.when(ours, "tuned").otherwise("base").alias("A"), F.when(ours, "base").otherwise("tuned").alias("B"))
    return queue, results, key


@query(f"WITH {_REVIEWED} SELECT s.*, wins, losses, ties, uncertain, wins + losses AS decisive, round(wins / nullif(wins + losses, 0), 6) AS preference_rate FROM s LEFT JOIN t ON s.review = t.review AND s.status = 'complete'")
def blind_review_summary(spark, d):
    _, results, key = _reviews(spark, d)
    return audits.blind_review_status(results).join(audits.blind_review_summary(results, key, "tuned", "base"), "review", "left")


@query(
    f"""WITH {_REVIEWED} SELECT 'pair_differs' AS rule, review || '/' || position AS key FROM e WHERE event_id % 103 = 9 AND event_id % 101 <> 7 UNION ALL SELECT 'row_missing', review || '/' || position FROM e WHERE event_id % 101 = 7
UNION ALL SELECT 'row_extra', review || '/' || (position + 1000000) FROM e WHERE event_id % 101 = 7 UNION ALL SELECT 'key_before_completion', review::VARCHAR FROM s WHERE status <> 'complete'"""
)
def blind_review_violations(spark, d):
    queue, results, _ = _reviews(spark, d)
    return audits.blind_review_violations(queue, results, opened=True)


@query(f"WITH {ENTRIES}, k AS (SELECT *, {surface_sql('surface_text')} AS surface FROM entries), g AS (SELECT surface, CASE WHEN count(DISTINCT split) > 1 THEN 'error' ELSE 'warning' END AS level FROM k WHERE surface <> '' GROUP BY surface HAVING count(*) > 1) SELECT sha256(surface) AS surface, utterance_id, split, level FROM k JOIN g USING (surface)")
def duplicate_surface_members(spark, d):
    key = text.surface_key(F.col("surface_text"))
    return governance.duplicate_surface_members(lenses.entries(spark, d), F.coalesce(F.when(key != "", F.sha2(key, 256)), F.lit("")))


_HASH = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('lab:import-' || page_id % 3 || ':' || page_id || ':' || sha256(html)))"


@query(rf"""WITH h AS (SELECT *, {_HASH} AS h FROM pages) SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab89ab89ab89ab'[instr('0123456789abcdef', h[17])] || h[18:20] || '-' || h[21:32] AS utterance_id,
 nullif(substr(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), 1, 180), '') AS record_name, split_part(url, '.', 1) AS recording_id, page_id % 4 = 0 AS safe FROM h""")
def names_and_ids(spark, d):
    """Ids of imports in a name space of their own, record names, recording ids and safe paths of every page."""
    k: Column = F.col("page_id")
    p = table(spark, d, "pages")
    path = F.concat(F.when(k % 4 == 1, "/").when(k % 4 == 2, "a/../").when(k % 4 == 3, "a\\").otherwise(""), F.lit("x/"), k, F.lit(".wav"))
    uid = text.import_utterance_id(F.concat(F.lit("import-"), k % 3), k.cast("string"), F.sha2("html", 256), "lab")
    return p.select("page_id", uid.alias("utterance_id"), text.safe_record_name(F.col("url")).alias("record_name"), text.source_recording_id(F.col("url")).alias("recording_id"), contracts.safe_relative_path(path).alias("safe"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: round_even(v::DOUBLE * 32767, 0)::INT / 32768) AS x FROM embeddings), e AS (SELECT vec_id, len(x) AS n, list_sum(x) AS total, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM s)
SELECT vec_id, CASE WHEN vec_id % 9 = 4 THEN 'truncated data' END AS error, CASE WHEN vec_id % 9 <> 4 THEN n::INT END AS frames, CASE WHEN vec_id % 9 <> 4 THEN n / 16000 * 1000 END AS duration_ms, CASE WHEN vec_id % 9 <> 4 THEN round(total, 9) END AS total, CASE WHEN vec_id % 9 <> 4 THEN peak END AS peak FROM e""")
def wav_files(spark, d):
    """Embeddings written as 16-bit WAV files, some of them cut short, and read again."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.bround(v.cast("double") * 32767).cast("int")).alias("x"))
    little = lambda v, n: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex(F.call_function("shiftright", v, (8 * i).cast("int")).bitwiseAND(255)), 2, "0")), "")
    size = F.size("x") * 2
    head = F.concat(F.hex(F.lit("RIFF").cast("binary")), little(size + 36, 4), F.hex(F.lit("WAVEfmt ").cast("binary")), little(F.lit(16), 4), little(F.lit(1), 2), little(F.lit(1), 2), little(F.lit(16_000), 4), little(F.lit(32_000), 4), little(F.lit(2), 2), little(F.lit(16), 2), F.hex(F.lit("data").cast("binary")), little(size, 4))
    whole = F.unhex(F.concat(head, F.array_join(F.transform("x", lambda v: little(v, 2)), "")))
    files = e.withColumn("w", whole).select(
        "vec_id", F.col("vec_id").cast("string").alias("path"), F.when(F.col("vec_id") % 9 == 4, F.expr("substring(w, 1, octet_length(w) - 3)")).otherwise(F.col("w")).alias("content")
    )
    x = files.withColumn("s", F.transform(audio.decode_pcm16(F.col("content")), lambda v: v.cast("double")))
    x = x.select("vec_id", "path", F.round(F.aggregate("s", F.lit(0.0), lambda a, v: a + v), 9).alias("total"), F.array_max(F.transform("s", F.abs)).alias("peak"))
    return x.join(audio.wav_headers(files).select("path", "error", "frames", "duration_ms"), "path").select("vec_id", "error", "frames", "duration_ms", "total", "peak")


_REPORT = rf"""WITH {CASES}, {REVIEWS}, c AS (SELECT scored.*, verdict, failure FROM scored LEFT JOIN latest ON prediction_id = conv_id),
e AS (SELECT role, count(*) AS n, sum(edits) / sum(ref_chars) AS cer, sum(preserved) / count(*) AS kept, sum(overcorrected) / count(*) AS lost, count(*) FILTER (hcw) AS hcw, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95,
  count(*) FILTER (verdict IS NOT NULL) AS reviewed, count(*) FILTER (verdict = 'confirmed') AS yes, count(*) FILTER (verdict = 'rejected') AS no, count(*) FILTER (verdict = 'uncertain') AS unsure FROM c GROUP BY role),
h AS (SELECT role, unnest(['# Human-reviewed Surface ASR Baseline Report', '## Experiment', '- Experiment: `' || role || '`', '- Benchmark: `conversations@1`', '- Model: `turns`', '- Checkpoint: `not recorded`', '- Source report: `not recorded`', '## Automatic evaluation', '- Utterances: ' || n,
  '- CER: ' || printf('%.4f', floor(round(cer, 6) * 10000 + 0.5) / 10000), '- Dialect preservation: ' || printf('%.4f', floor(round(kept, 6) * 10000 + 0.5) / 10000), '- Context overcorrection: ' || printf('%.4f', floor(round(lost, 6) * 10000 + 0.5) / 10000), '- High-confidence wrong: ' || hcw,
  '- Latency p50/p95: ' || printf('%.2f', floor(round(p50, 6) * 100 + 0.5) / 100) || ' / ' || printf('%.2f', floor(round(p95, 6) * 100 + 0.5) / 100) || ' ms', '## Human review', '- Latest reviews: ' || reviewed, '- All revisions: ' || n, '- Confirmed / rejected / uncertain: ' || yes || ' / ' || no || ' / ' || unsure,
  '- Confirmed failure types: none', '## Cases', '| Reference | Hypothesis | CER | Expressions | Verdict | Failure types | Notes |', '|---|---|---:|---|---|---|---|']) AS line, unnest(range(22)) AS i FROM e)
SELECT role AS experiment_id, 0 AS part, lpad(i::VARCHAR, 4, '0') AS position, line FROM h
UNION ALL SELECT role, 1, case_id, '| ' || concat_ws(' | ', trim(replace(replace(reference, '|', '\|'), chr(10), ' ')), trim(replace(replace(hypothesis, '|', '\|'), chr(10), ' ')), printf('%.3f', floor(round(cer, 6) * 1000 + 0.5) / 1000), 'no expression', coalesce(verdict, 'not reviewed'), coalesce(failure, 'none'), '') || ' |' FROM c
UNION ALL SELECT role, 2, '000' || i, ['## Limitations', '- the checkpoint is not identified', '## Decision', '`open`'][i + 1] FROM e, range(4) AS r(i)"""


@query(_REPORT)
def review_report(spark, d):
    """A report on the cases of each role with their latest reviews, line by line."""
    c = lenses.cases(spark, d)
    r = history.latest_by(lenses.reviews(spark, d), "prediction_id", "created_at", "review_id").select("prediction_id", "verdict", "confirmed_failure_types", "notes")
    both = c.join(r, c.conv_id == r.prediction_id, "left").withColumn("experiment_id", F.col("role"))
    sums = reports.aggregate_report(c, "role")
    verdicts = both.groupBy("role").agg(F.count("verdict").alias("reviewed"), F.count("*").alias("revisions"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("confirmed", "rejected", "uncertain")])
    nothing = F.lit(None).cast("string")
    heads = sums.join(verdicts, "role").select(
        F.col("role").alias("experiment_id"), reports.report_title(F.col("role")).alias("title"), F.lit("conversations@1").alias("benchmark"), F.lit("turns").alias("model"), nothing.alias("checkpoint"), nothing.alias("source_report_id"), *[x for x in sums.columns if x != "role"],
        "reviewed", "revisions", "confirmed", "rejected", "uncertain", F.array().cast("array<string>").alias("failure_types"), F.array(F.lit("the checkpoint is not identified")).alias("limitations"), F.lit("open").alias("gate_decision"),
    )
    rows = both.select("experiment_id", "case_id", "reference", "hypothesis", F.round("cer", 6).alias("cer"), F.array().cast("array<struct<surface_form:string,match_status:string>>").alias("matches"), "verdict", "confirmed_failure_types", "notes")
    return report_text.review_report(heads, rows)
