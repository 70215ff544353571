"""Streams that keep something for every key for good, in RocksDB: a batch reads and writes the buckets of keys that its own keys fall into."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Into how many groups keys are dealt by their hash.  A call of Python for each key would take milliseconds; a group's keys are handled at
#: once, as columns, and their state is one value: with n keys in all a group reads n / BUCKETS of them.  A checkpoint stays with its number.
BUCKETS = 1 << 10

_KEY, _BUCKET = "key__text", "key__bucket"  # pandas renames names that begin with an underscore
_PACKED = T.StructType([T.StructField("packed", T.BinaryType())])
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _there(name: str) -> str:
    return f"there__{name}"


def _dealt(stream: DataFrame, key: str, processor: StatefulProcessor, output: T.StructType, time_mode: str, buckets: int) -> DataFrame:
    """stream by bucket.  Keys go as text, never null; whole numbers go with a flag of being there, for pandas would make doubles of those with nulls."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias(_KEY)
    columns: list[Column] = []
    for f in stream.schema:
        whole = isinstance(f.dataType, _WHOLE)
        columns += [F.coalesce(f.name, F.lit(0).cast(f.dataType)).alias(f.name), F.isnotnull(f.name).alias(_there(f.name))] if whole else [F.col(f.name)]
    rows = stream.select(text, *columns).withColumn(_BUCKET, F.pmod(F.xxhash64(_KEY), F.lit(buckets)))
    return rows.groupBy(_BUCKET).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode=time_mode)


def _packed(table: pd.DataFrame) -> bytes:
    data = pa.RecordBatch.from_pandas(table, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, data.schema) as writer:
        writer.write_batch(data)
    return out.getvalue().to_pybytes()


def _unpacked(state: Any) -> pd.DataFrame | None:
    held = state.get()
    return None if held is None else pa.ipc.open_stream(bytes(held[0])).read_pandas()


class _Once(StatefulProcessor):
    def __init__(self, columns: list[str], order: list[str]):
        self.columns, self.order = columns, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen_keys", _PACKED)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        before = _unpacked(self.seen)
        known = pd.Index([]) if before is None else pd.Index(before[_KEY])
        first = None
        for part in rows:  # the best row so far of each new key is held back, others are refused as they come
            old = part[_KEY].isin(known)
            if old.any():
                yield part.loc[old, self.columns].assign(accepted=False)
                part = part[~old]
            if len(part):
                both = part if first is None else pd.concat([first, part])
                both = both.sort_values(self.order, kind="stable", na_position="first")
                late = both.duplicated(_KEY)
                first = both[~late]
                if late.any():
                    yield both.loc[late, self.columns].assign(accepted=False)
        if first is not None:
            new = first[[_KEY]]
            self.seen.update((_packed(new if before is None else pd.concat([before, new])),))
            yield first[self.columns].assign(accepted=True)

    def close(self) -> None:
        pass


def accept_once(stream: DataFrame, key: str = "prediction_id", order: tuple[str, ...] = ("created_at",), buckets: int = BUCKETS) -> DataFrame:
    """stream with ``accepted``: true for the first row of each key, ever; false for all others, however late they come (append mode).

    Of a batch's rows with one key the first by ``order`` (nulls first) is taken, if no earlier batch had the key.  The state holds the
    keys; a restart from the checkpoint goes on with it.  Rows with a null key share one.
    """
    fields = stream.schema.fields
    whole = {f.name for f in fields if isinstance(f.dataType, _WHOLE)}
    carried = [*fields, *[T.StructField(_there(f.name), T.BooleanType()) for f in fields if f.name in whole]]
    by = [name for c in order for name in ([_there(c), c] if c in whole else [c])]
    processor = _Once([f.name for f in carried], by)
    out = _dealt(stream, key, processor, T.StructType([*carried, T.StructField("accepted", T.BooleanType())]), "none", buckets)
    return out.select(*[F.when(F.col(_there(f.name)), F.col(f.name)).alias(f.name) if f.name in whole else F.col(f.name) for f in fields], "accepted")


class _Queue(StatefulProcessor):
    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getValueState("items", _PACKED)

    @staticmethod
    def _rows(items: pd.DataFrame, action: Any) -> pd.DataFrame:
        return pd.DataFrame({_KEY: items[_KEY], "flags": items["flags"], "action": action})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        seen = None
        for part in rows:
            own = pd.DataFrame({_KEY: part[_KEY], "flags": part["flags"].where(part["kind"] == "prediction", 0).astype("int64"), "reviewed": part["kind"] == "review", "latest": part["created_at"]})
            own = own if seen is None else pd.concat([seen, own])
            seen = own.groupby(_KEY, as_index=False, sort=False).max()
        before = _unpacked(self.items)
        if before is None:
            before = pd.DataFrame({_KEY: [], "flags": [], "reviewed": [], "queued": [], "due": []}).astype({_KEY: object, "flags": "int64", "reviewed": bool, "queued": bool, "due": "int64"})
        held = before.set_index(_KEY)
        old = pd.DataFrame({c: held[c].reindex(seen[_KEY], fill_value=empty).to_numpy() for c, empty in (("flags", 0), ("reviewed", False), ("queued", False), ("due", 0))})
        items = pd.DataFrame({_KEY: seen[_KEY], "flags": seen["flags"].clip(lower=0).where(seen["flags"] > old["flags"], old["flags"]), "reviewed": seen["reviewed"] | old["reviewed"]})
        items["queued"] = (items["flags"] > 0) & ~items["reviewed"]
        changed = items["queued"] != old["queued"]
        items["due"] = old["due"].where(~changed, 0)
        if self.wait_ms is not None:
            waits = changed & items["queued"] & seen["latest"].notna()
            items.loc[waits, "due"] = [int(t.timestamp() * 1000) + self.wait_ms for t in seen.loc[waits, "latest"]]
            for due in items.loc[waits, "due"].unique():
                self.handle.registerTimer(int(due))
        kept = before[~before[_KEY].isin(items[_KEY])]
        self.items.update((_packed(pd.concat([kept, items]) if len(kept) else items),))
        if changed.any():
            yield self._rows(items[changed], items.loc[changed, "queued"].map({True: "enqueue", False: "retract"}))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N803
        items = _unpacked(self.items)
        over = items["queued"] & (items["due"] == expiredTimerInfo.getExpiryTimeInMs())
        if over.any():
            yield self._rows(items[over], "overdue")

    def close(self) -> None:
        pass


def retracting_queue(events: DataFrame, key: str = "prediction_id", wait_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Changes of the review queue, (key, flags, action) (append mode).

    events: key, kind (prediction or review), flags (number of automatic failures), created_at.  ``enqueue``: a flagged prediction without a review
    waits; ``retract``: its review came, however late; ``overdue``, with ``wait_ms``: it waits for that long after the latest event of the
    batch that queued it, by the watermark, which events must then have.  The key's type must be one that a cast to text and back keeps.
    """
    kept = events.select(key, "kind", F.col("flags").cast("long").alias("flags"), "created_at")
    output = T.StructType([T.StructField(_KEY, T.StringType()), T.StructField("flags", T.LongType()), T.StructField("action", T.StringType())])
    out = _dealt(kept, key, _Queue(wait_ms), output, "none" if wait_ms is None else "eventTime", buckets)
    text = F.when(F.col(_KEY) != "", F.substring(_KEY, 2, 1 << 30))
    return out.select(text.cast(kept.schema[key].dataType).alias(key), "flags", "action")
