"""Latest rows, versions, queues, streaks and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days until the next review after each step; the last repeats.
INTERVALS = (1, 3, 7, 14)


def latest_by(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The row of each key with the latest time, ties by the tie column as text, and ``revisions``, the number of its rows."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(key).agg(F.max_by(row, F.struct(F.col(time), F.col(tie).cast("string"))).alias("row"), F.count("*").alias("revisions"))
    return best.select("row.*", "revisions")


def attach_latest_review(predictions: DataFrame, reviews: DataFrame) -> DataFrame:
    """predictions with their latest review; ``missing_review`` marks those without."""
    latest = latest_by(reviews, "prediction_id", "created_at", "review_id").select("prediction_id", "review_id", "verdict", "revisions")
    return predictions.join(latest, "prediction_id", "left").withColumn("missing_review", F.col("review_id").isNull())


def label_versions(revisions: DataFrame) -> DataFrame:
    """revisions with ``label_version``: label_v1 for an utterance's first, and so on in order of time and id."""
    w = Window.partitionBy("utterance_id").orderBy("created_at", F.col("revision_id").cast("string"))
    return revisions.withColumn("label_version", F.concat(F.lit("label_v"), F.row_number().over(w)))


def queue_position(df: DataFrame, group: str, *order: str) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def next_unreviewed(queue: DataFrame, group: str, order: str) -> DataFrame:
    """queue with ``next_candidate``: the next row's id with status candidate, or else the group's first such id."""
    after = Window.partitionBy(group).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    candidate = F.when(F.col("label_status") == "candidate", F.col("utterance_id"))
    return queue.withColumn("next_candidate", F.coalesce(F.first(candidate, ignorenulls=True).over(after), F.first(candidate, ignorenulls=True).over(whole)))


def first_seen_split(entries: DataFrame, key: str, order: str) -> DataFrame:
    """entries with the split in which their key was seen first, and whether their own differs."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entries.withColumn("first_split", F.first("split").over(w)).withColumn("conflict", F.col("split") != F.col("first_split"))


def practice_streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days of each key: first and last day and length (islands: day minus its rank)."""
    each = days.select(key, F.col(day).cast("date").alias("day")).where("day is not null").distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("day"))
    return each.withColumn("island", F.date_sub("day", rank)).groupBy(key, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("streak")).drop("island")


def review_schedule(reviews: DataFrame, key: str, time: str) -> DataFrame:
    """Per item: how often it was seen, its step, and the day on which it is due again."""
    steps = F.lit(list(INTERVALS))
    done = reviews.groupBy(key).agg(F.count("*").alias("n"), F.max(time).cast("date").alias("last_day"))
    step = F.least(F.col("n") - 1, F.lit(len(INTERVALS) - 1)).cast("int")
    return done.withColumn("step", step).withColumn("due", F.date_add("last_day", F.get(steps, F.col("step"))))


def due_reviews(schedule: DataFrame, today: Column) -> DataFrame:
    return schedule.where(F.col("due") <= today)


def review_queue(predictions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Predictions with automatic failures (``flags`` not empty) and no review yet."""
    return predictions.where(F.size("flags") > 0).join(reviews.select("prediction_id").distinct(), "prediction_id", "left_anti")


def newest_first(df: DataFrame, time: str, tie: str, most: int | None = None) -> DataFrame:
    """A listing, the newest row first, ties by another column; of ``most`` rows if given."""
    rows = df.orderBy(F.desc_nulls_last(time), tie)
    return rows if most is None else rows.limit(most)
