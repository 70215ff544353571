"""Registered queries over streams: events arrive in two runs, first those of even ids, then the others, many of them late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import state, streams
from . import lenses
from .lenses import REVIEWS, table
from .registry import query


def _runs(df: DataFrame, number: str) -> list[DataFrame]:
    return [df.where(F.pmod(number, F.lit(2)) == n) for n in (0, 1)]


def _events(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("created_at"), *more)


def _newest(out: DataFrame, *key: str) -> DataFrame:
    """Of update mode: each key's row of the last batch that has one."""
    row = F.struct(*[c for c in out.columns if c != "batch"])
    return out.groupBy(*key).agg(F.max_by(row, "batch").alias("row")).select("row.*")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2, ts, event_id) = 1 AS accepted FROM events")
def stream_accept_once(spark, d):
    """The first event of each user and type is accepted, all later ones refused for good."""
    e = _events(spark, d, F.concat_ws("/", "user_id", "event_type").alias("prediction_id"))
    return streams.replay(_runs(e, "event_id"), lambda s: state.accept_once(s, order=("created_at", "event_id")), "append").select("event_id", "accepted")


@query(f"WITH {REVIEWS} SELECT prediction_id, review_id, verdict, revisions FROM latest")
def stream_latest_review(spark, d):
    """Each prediction's latest review after both runs, by the state that each run left behind."""
    r = lenses.reviews(spark, d).select("prediction_id", "review_id", "verdict", "created_at")
    out = streams.replay(_runs(r, "review_id"), streams.latest_review_stream, "update")
    return _newest(out, "prediction_id").select("prediction_id", "review_id", "verdict", "revisions")


_QUEUE = """WITH e AS (SELECT user_id * 100 + day(ts) AS prediction_id, event_id % 2 = 0 AS first, CASE WHEN event_type IN ('purchase', 'signup') THEN 'review' ELSE 'prediction' END AS kind, event_id % 3 AS flags FROM events),
k AS (SELECT prediction_id, coalesce(max(flags) FILTER (first AND kind = 'prediction'), 0) AS f1, coalesce(max(flags) FILTER (kind = 'prediction'), 0) AS f2, count(*) FILTER (first AND kind = 'review') > 0 AS r1, count(*) FILTER (kind = 'review') > 0 AS r2, count(*) FILTER (NOT first) > 0 AS again FROM e GROUP BY prediction_id)
SELECT prediction_id, f1::BIGINT AS flags, 'enqueue' AS action FROM k WHERE f1 > 0 AND NOT r1
UNION ALL SELECT prediction_id, f2::BIGINT, 'retract' FROM k WHERE again AND f1 > 0 AND NOT r1 AND r2
UNION ALL SELECT prediction_id, f2::BIGINT, 'enqueue' FROM k WHERE again AND f2 > 0 AND NOT r2 AND NOT (f1 > 0)"""


@query(_QUEUE)
def stream_review_queue(spark, d):
    """What enters and leaves the review queue; predictions are a user's day."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "review").otherwise("prediction")
    e = _events(spark, d, (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("prediction_id"), kind.alias("kind"), (F.col("event_id") % 3).alias("flags"))
    return streams.replay(_runs(e, "event_id"), state.retracting_queue, "append").select("prediction_id", "flags", "action")


_WINDOWS = """WITH w AS (SELECT *, time_bucket(INTERVAL 6 HOURS, ts) AS w FROM events), mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS m FROM events WHERE event_id % 2 = 0),
seen AS (SELECT * FROM w, mark WHERE event_id % 2 = 0 OR w + INTERVAL 6 HOURS > date_trunc('milliseconds', m))
SELECT w AS window_start, count(*) AS events, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (event_type = 'error') AS errors, (SELECT count(*) FROM events) - (SELECT count(*) FROM seen) AS late FROM seen GROUP BY w"""


@query(_WINDOWS)
def stream_quality_windows(spark, d):
    """Windows of six hours; events behind the watermark are left out, and ``late`` is their number."""
    one = F.lit(1).cast("long")
    e = _events(spark, d).select("event_id", "created_at", F.col("value").alias("latency_ms"), one.alias("edits"), one.alias("ref_chars"), (F.col("event_type") == "error").alias("high_confidence_wrong"))
    out = _newest(streams.replay(_runs(e, "event_id"), lambda s: streams.quality_monitor(s.drop("event_id"), "6 hours"), "update"), "window_start")
    late = e.agg(F.count("*").alias("all")).crossJoin(out.agg(F.sum("cases").alias("counted"))).select((F.col("all") - F.coalesce("counted", F.lit(0))).alias("late"))  # one row each
    named = out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("cases").alias("events"), F.col("p50_latency_ms").alias("p50"), F.col("p95_latency_ms").alias("p95"), F.col("high_confidence_wrong").alias("errors"))
    return named.crossJoin(late)  # one row


@query("WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTES AS new FROM events), s AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS events FROM s GROUP BY user_id, n")
def stream_sessions(spark, d):
    """Sessions of every user after both runs: events of the second one lengthen and join sessions of the first."""
    out = streams.replay(_runs(_events(spark, d), "event_id"), lambda s: streams.session_metrics(s, "user_id"), "complete")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "events")
