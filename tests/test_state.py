"""Keyed state: duplicates refused for good and the retracting queue, over restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from saltmarsh.streaming import state, streams

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(1)


def test_each_prediction_once_for_good(spark):
    schema = "prediction_id string, hypothesis string, created_at timestamp"
    arrivals = [[("a", "1", T0), ("a", "2", T0 + DAY), ("b", "1", T0), (None, "0", None)], [("a", "3", T0 - 900 * DAY), ("c", "2", T0 + DAY), ("c", "1", T0)], [("c", "0", T0 - DAY), ("d", None, None), (None, "1", T0)]]
    out = streams.replay([spark.createDataFrame(r, schema) for r in arrivals], state.accept_once, "append").collect()
    assert {(r.prediction_id, r.hypothesis) for r in out if r.accepted} == {("a", "1"), ("b", "1"), ("c", "1"), ("d", None), (None, "0")}
    assert {(r.prediction_id, r.hypothesis) for r in out if not r.accepted} == {("a", "2"), ("a", "3"), ("c", "2"), ("c", "0"), (None, "1")}


def test_a_key_of_many_rows(spark):
    rows = spark.range(30_000).select(F.lit("x").alias("prediction_id"), (F.col("id") * 7 % 30_000).alias("line"))
    out = streams.replay([rows.limit(0), rows.repartition(3)], lambda s: state.accept_once(s, order=("line",)), "append")
    assert out.count() == 30_000 and [r.line for r in out.where("accepted").collect()] == [0]


def test_queue_is_retracted_by_late_reviews(spark):
    schema = "prediction_id string, kind string, flags int, created_at timestamp"
    arrivals = [
        [("p", "prediction", 2, T0), ("q", "prediction", 0, T0), ("r", "review", None, T0), ("s", "prediction", 1, T0), ("s", "review", None, T0)],
        [("p", "review", None, T0 - 30 * DAY), ("q", "prediction", 3, T0), ("r", "prediction", 5, T0)],
        [("p", "prediction", 9, T0), ("q", "review", None, T0), ("q", "review", None, T0)],
    ]
    out = streams.replay([spark.createDataFrame(r, schema) for r in arrivals], state.retracting_queue, "append").collect()
    assert sorted((r.prediction_id, r.flags, r.action) for r in out) == [("p", 2, "enqueue"), ("p", 2, "retract"), ("q", 3, "enqueue"), ("q", 3, "retract")]


def test_overdue_items(spark):
    schema = "prediction_id string, kind string, flags int, created_at timestamp"
    arrivals = [[("p", "prediction", 2, T0), ("q", "prediction", 1, T0)], [("q", "review", None, T0)], [("z", "review", None, T0 + 3 * DAY)]]
    make = lambda s: state.retracting_queue(s.withWatermark("created_at", "1 hour"), wait_ms=86_400_000)
    out = streams.replay([spark.createDataFrame(r, schema) for r in arrivals], make, "append").collect()
    assert sorted((r.prediction_id, r.action) for r in out) == [("p", "enqueue"), ("p", "overdue"), ("q", "enqueue"), ("q", "retract")]


def test_many_keys_share_a_call(spark):
    """Python is called for buckets of keys, not for each key; whole numbers beside nulls stay exact, null keys share one."""
    big = 2**60 + 1
    rows = spark.range(40_000).select(F.when(F.col("id") % 5_000 != 7, F.col("id") % 5_000 + big).alias("prediction_id"), F.when(F.col("id") % 3 > 0, F.col("id") + big).alias("line"))
    at = (F.coalesce("line", F.lit(0)) % 2) == 0
    e = streams.replay([rows.where(at), rows.where(~at)], lambda s: state.accept_once(s, order=("line",), buckets=16), "append")
    assert e.count() == 40_000 and e.where("accepted").count() == 5_000 and e.exceptAll(e).isEmpty()
    assert e.select("prediction_id", "line").exceptAll(rows).isEmpty() and rows.exceptAll(e.select("prediction_id", "line")).isEmpty()
    calls: list[int] = []

    class _Handle:
        def getValueState(self, *_):  # noqa: N802
            class Value:
                def get(self):
                    calls.append(1)

                def update(self, _):
                    calls.append(1)

            return Value()

    import pandas as pd

    p = state._Once(["x"], ["x"])
    p.init(_Handle())
    out = pd.concat(p.handleInputRows((0,), iter([pd.DataFrame({"key__text": [f"={i % 900}" for i in range(2000)], "x": range(2000)})]), None))
    assert len(calls) == 2 and out.accepted.sum() == 900 and set(out[out.accepted].x) == set(range(900))
