"""Measures of signals in chunks against those of whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.functions import audio, signals

RATE = 16_000


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(5)
    t = np.arange(9000) / RATE
    found = {1: np.sin(2 * np.pi * 180 * t) * 0.4 + rng.normal(0, 0.01, len(t)), 2: rng.normal(0, 0.2, 1700), 3: np.zeros(1000), 4: rng.normal(0, 0.3, 100), 5: np.array([1.0]), 6: rng.normal(0, 0.1, 640), 7: np.full(400, 0.9995)}
    found = {k: v.astype(np.float32) for k, v in found.items()}
    return found, spark.createDataFrame([(k, v.tolist()) for k, v in found.items()] + [(8, [])], "id int, x array<float>")


@pytest.mark.parametrize("size, frames", [(7, 1024), (64, 3), (1000, 2), (10_000, 1024)])
def test_any_chunks_give_the_whole(spark, waves, size, frames, monkeypatch):
    found, df = waves
    chunks = signals.chunked(df, "id", "x", size).repartition(5)
    if size == 64:  # starts from the order of chunks
        chunks = signals.with_starts(chunks.withColumnRenamed("start", "number"), "id", "number").drop("number")
    mel = {}
    for r in signals.log_mel(chunks, "id", RATE).collect():
        mel.setdefault(r.id, {})[r.frame] = r.mel
    pitch = {(r.id, r.frame): (r.time_ms, r.f0_hz, r.confidence) for r in signals.f0_track(chunks, "id", RATE).collect()}
    level = {r.id: r for r in signals.quality(chunks, "id", RATE).collect()}
    lows = {(r.id, r.bin): (r.low, r.high, r.time_ms) for r in signals.envelope(chunks, "id", 9, RATE).collect()}
    energy = {(r.id, r.frame): r.energy for r in signals.frame_energy(chunks, "id", 400, 160).collect()}
    assert set(level) == set(mel) == set(found)
    count = 0
    for k, x in found.items():
        want = audio.log_mel_of(x.astype(np.float64), RATE).T
        assert len(mel[k]) == len(want)
        np.testing.assert_allclose([mel[k][i] for i in range(len(want))], want, atol=1e-6)
        hz, sure = audio.pitch_of(x.astype(np.float64), RATE)
        for i, (h, s) in enumerate(zip(hz, sure, strict=True)):
            time, f0, confidence = pitch[k, i]
            assert time == (i * 320 + 320) / RATE * 1000 and confidence == pytest.approx(s, abs=1e-9) and (f0 is None) == bool(np.isnan(h)) and (f0 is None or f0 == pytest.approx(h))
        count += len(hz)
        for i in range((len(x) - 400) // 160 + 1 if len(x) >= 400 else 0):
            assert energy.pop((k, i)) == pytest.approx(float((x[i * 160 : i * 160 + 400].astype(np.float64) ** 2).sum()))
        bins = min(9, len(x))
        for i in range(bins):
            a, b = i * len(x) // bins, (i + 1) * len(x) // bins
            assert lows.pop((k, i)) == (x[a:b].min(), x[a:b].max(), (a + b) / 2 / RATE * 1000)
    assert len(pitch) == count and not energy and not lows
    whole = {r.id: r.q for r in df.select("id", audio.audio_quality(F.col("x"), RATE).alias("q")).collect() if r.q}
    for k, q in whole.items():
        assert level[k].warnings == q.warnings and [level[k][c] for c in ("peak", "rms_dbfs", "silence_ratio", "dc_offset")] == pytest.approx([q[c] for c in ("peak", "rms_dbfs", "silence_ratio", "dc_offset")])
