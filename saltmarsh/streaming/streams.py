"""Append-only predictions and reviews as streams.  All take a streaming (or batch) DataFrame with a timestamp column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import score_cases
from ..operators.reports import corpus_cer
from ..shared import shared_path


def ingest_predictions(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Scored predictions, each prediction_id once within the watermark (append mode)."""
    once = stream.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["prediction_id"])
    return score_cases(once)


def replay(arrivals: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a streaming query writes when tables arrive one after another; each is a run of its own that goes on from the last one's checkpoint.

    Rows have the number of their ``batch``; in update mode a later one replaces an earlier one of the same key, in complete mode all before.
    Everything is in the shared folder, and a batch that runs again replaces what it wrote.
    """
    spark, base = arrivals[0].sparkSession, shared_path(arrivals[0].sparkSession, "replay")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    for rows in arrivals:
        rows.write.mode("append").parquet(f"{base}/in")
        stream = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{base}/in"))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")


def latest_review_stream(reviews: DataFrame) -> DataFrame:
    """The latest review of each prediction so far (update mode); ties by id as text."""
    row = F.struct("review_id", "verdict", "created_at")
    return reviews.groupBy("prediction_id").agg(F.max_by(row, F.struct(F.col("created_at"), F.col("review_id").cast("string"))).alias("latest"), F.count("*").alias("revisions")).select("prediction_id", "latest.*", "revisions")


def review_queue_stream(events: DataFrame) -> DataFrame:
    """Per prediction whether it still waits for a review (update mode).

    events: prediction_id, kind (prediction or review), flags (number of automatic failures).  A later review turns waiting to false.
    """
    return events.groupBy("prediction_id").agg(F.max(F.when(F.col("kind") == "prediction", F.col("flags"))).alias("flags"), F.count_if(F.col("kind") == "review").alias("reviews")).withColumn(
        "waiting", F.coalesce(F.col("flags") > 0, F.lit(False)) & (F.col("reviews") == 0)
    )


def quality_monitor(cases: DataFrame, window: str, slide: str | None = None, lateness: str = "1 hour", exact: bool = True) -> DataFrame:
    """Error rate, confident errors and latency percentiles by window of time.

    Exact percentiles keep every distinct latency in the state; ``exact=False`` keeps a bounded sketch, for long windows.
    """
    at = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    both = F.array(F.lit(0.5), F.lit(0.95))
    p = F.percentile("latency_ms", both) if exact else F.percentile_approx("latency_ms", both, F.lit(1000))
    out = cases.withWatermark("created_at", lateness).groupBy(at.alias("w")).agg(
        F.count("*").alias("cases"), F.round(corpus_cer(), 6).alias("cer"), F.count_if("high_confidence_wrong").alias("high_confidence_wrong"), F.round(p[0], 6).alias("p50_latency_ms"), F.round(p[1], 6).alias("p95_latency_ms"),
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "cases", "cer", "high_confidence_wrong", "p50_latency_ms", "p95_latency_ms")


def session_metrics(events: DataFrame, key: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of each key: start, end and number of events."""
    w = F.session_window("created_at", gap)
    return events.withWatermark("created_at", lateness).groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
