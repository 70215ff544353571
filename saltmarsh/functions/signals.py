"""Signals of any length as chunk rows (signal, start, samples): each measure is that of the whole signal, whatever the chunks.

``start`` is the number of samples before a chunk.  Frames that reach into the next chunk get its samples by a shuffle into blocks
that overlap by a frame; what holds for a whole signal is a merge of numbers from its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audio import mel_filters, pitch_of

#: Frames of a block, about; bounds what one row holds.
BLOCK_FRAMES = 1024


def chunked(signals: DataFrame, key: str, samples: str, size: int) -> DataFrame:
    """(key, start, samples) of arrays, in chunks of ``size`` samples."""
    n = F.size(samples)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return signals.select(key, F.col(samples).alias("_x"), F.explode(starts).alias("start")).select(key, F.col("start").cast("long").alias("start"), F.slice("_x", F.col("start") + 1, size).alias("samples"))


def with_starts(chunks: DataFrame, key: str, order: str) -> DataFrame:
    """chunks (key, order, samples) with ``start``; one task sees a signal's chunk lengths, not its samples."""
    lengths = chunks.select(key, order, F.size("samples").cast("long").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.join(lengths.select(key, order, before.alias("start")), [key, order])


def lengths(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n) of every signal."""
    return chunks.groupBy(key).agg(F.max(F.col("start") + F.size("samples")).alias("n"))


def quality(chunks: DataFrame, key: str, rate: int, least_ms: float = 300, most_ms: float = 30_000) -> DataFrame:
    """Peak, level, clipping and silence shares, offset, duration and warnings of every signal that has samples."""
    x = F.transform("samples", lambda v: v.cast("double"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("p"), F.lit(0).alias("c"), F.lit(0).alias("z"))
    part = F.aggregate(x, zero, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"), F.greatest(a["p"], F.abs(v)).alias("p"), (a["c"] + (F.abs(v) >= 0.999).cast("int")).alias("c"), (a["z"] + (F.abs(v) < 0.01).cast("int")).alias("z")))
    t = chunks.select(key, F.size("samples").cast("long").alias("n"), part.alias("t")).where("n > 0").groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(f"t.{c}").alias(c) for c in "sqcz"], F.max("t.p").alias("peak"))
    found = t.select(
        key, "peak", (20 * F.log10(F.greatest(F.sqrt(F.col("q") / F.col("n")), F.lit(1e-12)))).alias("rms_dbfs"), (F.col("c") / F.col("n")).alias("clipping_ratio"), (F.col("z") / F.col("n")).alias("silence_ratio"),
        (F.col("s") / F.col("n")).alias("dc_offset"), (F.col("n") / rate * 1000).alias("duration_ms"),
    )
    warnings = F.array_compact(F.array(
        F.when(F.col("clipping_ratio") > 0.01, "CLIPPING_HIGH"), F.when(F.col("rms_dbfs") < -50, "LEVEL_TOO_LOW"), F.when(F.col("silence_ratio") > 0.95, "MOSTLY_SILENCE"), F.when(F.abs("dc_offset") > 0.05, "DC_OFFSET_HIGH"),
        F.when(~F.col("duration_ms").between(least_ms, most_ms), "DURATION_OUT_OF_RANGE")))
    return found.withColumn("warnings", warnings)


def envelope(chunks: DataFrame, key: str, bins: int, rate: int) -> DataFrame:
    """(key, bin, time_ms, low, high) of ``bins`` equal parts of each signal, fewer for a shorter one."""
    n = lengths(chunks, key)
    k = F.least(F.lit(bins), F.col("n"))
    edge = lambda i: F.floor(i * F.col("n") / k).cast("long")
    end = F.col("start") + F.size("samples")
    # The bins that a chunk touches: bin i has the samples edge(i) to edge(i + 1).
    first = F.greatest(F.lit(0), F.floor(F.col("start") * k / F.col("n")) - 1)
    last = F.least(k - 1, F.floor((end - 1) * k / F.col("n")) + 1)
    rows = chunks.where(F.size("samples") > 0).join(n, key).select("*", k.alias("k"), F.explode(F.sequence(first, last)).alias("bin"))
    a, b = F.greatest(edge(F.col("bin")), F.col("start")), F.least(edge(F.col("bin") + 1), end)
    part = F.slice("samples", (a - F.col("start") + 1).cast("int"), (b - a).cast("int"))
    rows = rows.where(b > a).select(key, "bin", ((edge(F.col("bin")) + edge(F.col("bin") + 1)) / 2 / rate * 1000).alias("time_ms"), F.array_min(part).alias("low"), F.array_max(part).alias("high"))
    return rows.groupBy(key, "bin").agg(F.max("time_ms").alias("time_ms"), F.min("low").alias("low"), F.max("high").alias("high"))


def _blocks(chunks: DataFrame, key: str, size: int, hop: int) -> DataFrame:
    """(key, block, n, samples): the samples of BLOCK_FRAMES frames each, those that the last frame needs from the next block included."""
    span = BLOCK_FRAMES * hop
    end = F.col("start") + F.size("samples")
    first = F.greatest(F.lit(0), F.floor((F.col("start") - (size - hop if size > hop else 0)) / span)).cast("long")
    last = F.floor((end - 1) / span).cast("long")
    dealt = chunks.where(F.size("samples") > 0).select(key, "start", "samples", F.explode(F.sequence(first, last)).alias("block"))
    a, b = F.greatest(F.col("start"), F.col("block") * span), F.least(end, F.col("block") * span + span + max(size - hop, 0))
    parts = dealt.where(b > a).select(key, "block", a.alias("at"), F.slice("samples", (a - F.col("start") + 1).cast("int"), (b - a).cast("int")).alias("x"))
    whole = parts.groupBy(key, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])).alias("samples"))
    return whole.join(lengths(chunks, key), key)


def _per_frame(chunks: DataFrame, key: str, size: int, hop: int, measure, schema: str, rate: int) -> DataFrame:
    """measure(samples) of each block gives columns by frame; the last frame is the last whole one, but a signal of less than a frame has one, filled with zeros."""
    names, kinds = zip(*[(c.split()[0], pa.float64() if c.endswith(" double") else pa.list_(pa.float64())) for c in schema.split(", ")], strict=True)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in range(part.num_rows):
                block, n = part.column(1)[row].as_py(), part.column(2)[row].as_py()
                frames = min((max(n, size) - size) // hop + 1 - block * BLOCK_FRAMES, BLOCK_FRAMES)
                if frames <= 0:
                    continue
                x = part.column(3)[row].values.to_numpy(zero_copy_only=False).astype(np.float64)
                columns = measure(np.pad(x, (0, max(0, size - len(x)))))
                number = block * BLOCK_FRAMES + np.arange(frames)
                keys = part.column(0).take(pa.array(np.full(frames, row)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(number), *[pa.array(list(c[:frames]), k) for c, k in zip(columns, kinds, strict=True)]], names=["key", "frame", *names])

    blocks = _blocks(chunks, key, size, hop).select(F.col(key).alias("key"), "block", "n", "samples")
    return blocks.mapInArrow(run, f"key {blocks.schema['key'].dataType.simpleString()}, frame long, {schema}").withColumnRenamed("key", key)


def log_mel(chunks: DataFrame, key: str, rate: int, bins: int = 48, fft: int = 512, size: int = 400, hop: int = 160) -> DataFrame:
    """(key, frame, mel): decibels below the loudest cell of the whole signal, at least -80."""

    def measure(x: np.ndarray) -> list[np.ndarray]:
        frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
        power = np.abs(np.fft.rfft(frames * np.hanning(size), fft)) ** 2
        return [10 * np.log10(np.maximum(power @ mel_filters(rate, fft, bins).T, 1e-12))]

    own = _per_frame(chunks, key, size, hop, measure, "mel array<double>", rate)
    most = own.groupBy(key).agg(F.max(F.array_max("mel")).alias("_most"))
    return own.join(most, key).select(key, "frame", F.transform("mel", lambda v: F.greatest(v - F.col("_most"), F.lit(-80.0))).alias("mel"))


def f0_track(chunks: DataFrame, key: str, rate: int, size: int = 640, hop: int = 320) -> DataFrame:
    """(key, frame, time_ms, f0_hz, confidence); f0_hz is null where a frame is quiet or unclear."""

    def measure(x: np.ndarray) -> list:
        hz, sure = pitch_of(x, rate, size, hop)
        return [[None if np.isnan(h) else float(h) for h in hz], sure]

    own = _per_frame(chunks, key, size, hop, measure, "f0_hz double, confidence double", rate)
    return own.select(key, "frame", ((F.col("frame") * hop + hop) / rate * 1000).alias("time_ms"), "f0_hz", "confidence")


def frame_energy(chunks: DataFrame, key: str, size: int, hop: int) -> DataFrame:
    """(key, frame, energy): sums of squares of whole frames."""
    frames = _blocks(chunks.where(F.col("start") >= 0), key, size, hop).where(F.col("n") >= size)
    count: Column = F.least(F.floor((F.col("n") - size) / hop) + 1 - F.col("block") * BLOCK_FRAMES, F.lit(BLOCK_FRAMES))
    rows = frames.where(count > 0).select(key, "block", "samples", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("i"))
    energy = F.aggregate(F.slice("samples", F.col("i") * hop + 1, size), F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return rows.select(key, (F.col("block") * BLOCK_FRAMES + F.col("i")).alias("frame"), energy.alias("energy"))
