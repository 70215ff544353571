"""How the given tables stand for transcripts, reviews and data sets; each lens in Spark and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import failure_flags, score_cases


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distances of texts take far longer than the texts' bytes tell, so the number of parts is stated, not left to their size.
    w = Window.partitionBy("conv_id").orderBy("turn")
    dealt = table(spark, sf_dir, "conversations").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id")
    return dealt.withColumn("next", F.lead("text").over(w)).where("next is not null")


def _scored(turns: DataFrame, reference: Column, hypothesis: Column) -> DataFrame:
    rows = turns.select(
        F.concat_ws(":", "conv_id", "turn").alias("case_id"), "conv_id", "turn", "role", reference.alias("reference"), hypothesis.alias("hypothesis"),
        F.when(F.col("turn") % 4 != 3, ((F.col("conv_id") * 7 + F.col("turn") * 13) % 100) / 100.0).alias("confidence"), (F.length("next") * 1.5 + F.col("turn")).alias("latency_ms"), (F.length("text") * 2.0 + 10).alias("duration_ms"),
    )
    word, other = F.split("reference", " ")[0], F.substring("reference", 1, 2)
    out = score_cases(rows).withColumn("expressions", F.lit(1)).withColumn("preserved", F.contains("hypothesis", word).cast("int"))
    out = out.withColumn("overcorrected", ((F.col("preserved") == 0) & F.contains("hypothesis", other)).cast("int"))
    return out.withColumn("flags", failure_flags(F.col("overcorrected"), F.col("high_confidence_wrong")))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cases: each whole turn against the whole next one, of every script."""
    return _scored(_pairs(spark, sf_dir), F.col("text"), F.col("next"))


#: DuckDB's distance counts bytes, so the accented letters of the given tables stand as control characters, one byte each.
_ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(14, 27)])

CASES = rf"""turns AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
pairs AS (SELECT conv_id || ':' || turn AS case_id, conv_id, turn, role, text AS reference, nxt AS hypothesis,
  CASE WHEN turn % 4 <> 3 THEN ((conv_id * 7 + turn * 13) % 100) / 100.0 END::DOUBLE AS confidence, (length(nxt) * 1.5 + turn)::DOUBLE AS latency_ms, (length(text) * 2.0 + 10)::DOUBLE AS duration_ms
  FROM turns WHERE nxt IS NOT NULL),
normal AS (SELECT *, regexp_replace(nfc_normalize(reference), '[\p{{Z}}\p{{P}}]', '', 'g') AS nr, regexp_replace(nfc_normalize(hypothesis), '[\p{{Z}}\p{{P}}]', '', 'g') AS nh FROM pairs),
counted AS (SELECT *, levenshtein(translate(nr, '{_ACCENTED}', {_BYTES}), translate(nh, '{_ACCENTED}', {_BYTES})) AS edits, length(nr) AS ref_chars FROM normal),
cases AS (SELECT *, CASE WHEN ref_chars = 0 THEN edits ELSE edits / ref_chars END AS cer, 1 AS expressions,
  contains(hypothesis, split_part(reference, ' ', 1))::INT AS preserved FROM counted),
scored AS (SELECT *, coalesce(cer > 0 AND confidence >= 0.85, false) AS hcw, (preserved = 0 AND contains(hypothesis, substr(reference, 1, 2)))::INT AS overcorrected FROM cases)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of predictions: events, with the user as the prediction."""
    e = table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type").isin("purchase", "signup"), "confirmed").when(F.col("event_type") == "error", "rejected").otherwise("uncertain")
    kinds = F.array(F.lit("MODEL"), F.lit("DATA"), F.lit("LANGUAGE_MODEL_BIAS"))
    types = F.when(verdict == "confirmed", F.array(F.get(kinds, (F.col("event_id") % 3).cast("int")))).otherwise(F.array().cast("array<string>"))
    return e.select(F.col("event_id").alias("review_id"), F.col("user_id").alias("prediction_id"), F.col("ts").cast("timestamp").alias("created_at"), verdict.alias("verdict"), types.alias("confirmed_failure_types"), F.col("value").alias("latency_ms"), F.lit("").alias("notes"))


REVIEWS = """reviews AS (SELECT event_id AS review_id, user_id AS prediction_id, ts AS created_at,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'confirmed' WHEN event_type = 'error' THEN 'rejected' ELSE 'uncertain' END AS verdict,
  CASE WHEN event_type IN ('purchase', 'signup') THEN ['MODEL', 'DATA', 'LANGUAGE_MODEL_BIAS'][event_id % 3 + 1] END AS failure, value AS latency_ms FROM events),
latest AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY prediction_id) AS revisions, row_number() OVER (PARTITION BY prediction_id ORDER BY created_at DESC, review_id::VARCHAR DESC) AS rn FROM reviews) WHERE rn = 1)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training entries: documents, their source as the speaker; splits by source, some rows dealt against it."""
    d = table(spark, sf_dir, "documents")
    number = F.coalesce(F.substring("source", 4, 10).cast("int"), F.lit(0))
    split = F.when((F.col("doc_id") % 50 == 7) | (number % 5 == 0), "validation").otherwise("train")
    return d.select(
        F.col("doc_id").alias("utterance_id"), F.col("source").alias("speaker_id"), split.alias("split"), F.col("lang").alias("region"), F.col("text").alias("surface_text"), F.col("n_chars").cast("double").alias("duration_ms"),
        F.array(F.concat(F.lit("a"), F.col("doc_id") % 400), F.concat(F.lit("b"), F.col("doc_id"))).alias("lineage"),
    )


ENTRIES = """entries AS (SELECT doc_id AS utterance_id, source AS speaker_id, CASE WHEN doc_id % 50 = 7 OR coalesce(try_cast(substr(source, 4) AS INT), 0) % 5 = 0 THEN 'validation' ELSE 'train' END AS split,
  lang AS region, text AS surface_text, n_chars::DOUBLE AS duration_ms, ['a' || (doc_id % 400), 'b' || doc_id] AS lineage FROM documents)"""


def surface_sql(column: str) -> str:
    """The surface key of a column: NFC and lower case do what NFKC and folding do to the letters of the given tables, ß aside."""
    return rf"regexp_replace(replace(lower(nfc_normalize({column})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"
