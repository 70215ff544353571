"""Audio in columns: WAV headers, PCM samples, quality, envelopes, log-mel spectra and pitch."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Acoustic features cover this much of a signal.
FIRST_SECONDS = 60


def parse_wav(content: bytes) -> tuple[dict, bytes]:
    """Header fields and sample bytes of a RIFF WAVE file; raises ValueError where it is none."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, head = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt " and size >= 16:
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            head = {"format": kind, "channels": channels, "rate": rate, "width": bits // 8}
        elif name == b"data":
            if head is None or not head["channels"] or not head["width"]:
                raise ValueError("no format before the data")
            if at + 8 + size > len(content):
                raise ValueError("truncated data")
            return head | {"frames": size // (head["channels"] * head["width"])}, content[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def wav_headers(audio: DataFrame) -> DataFrame:
    """(path, format, channels, rate, width, frames, duration_ms, error) of files with path and content."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    head, _ = parse_wav(bytes(content or b""))
                    rows.append((path, head["format"], head["channels"], head["rate"], head["width"], head["frames"], 1000 * head["frames"] / head["rate"] if head["rate"] else None, None))
                except (ValueError, struct.error) as error:
                    rows.append((path, None, None, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "format", "channels", "rate", "width", "frames", "duration_ms", "error"], dtype=object)

    return audio.select("path", "content").mapInPandas(run, "path string, format int, channels int, rate int, width int, frames long, duration_ms double, error string")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_pcm16(content: pd.Series) -> pd.Series:
    """Samples (-1 to 1) of a mono 16-bit WAV file; null for any other."""

    def one(raw: bytes | None) -> np.ndarray | None:
        try:
            head, data = parse_wav(bytes(raw or b""))
        except (ValueError, struct.error):
            return None
        return np.frombuffer(data, "<i2").astype(np.float32) / 32768 if (head["format"], head["channels"], head["width"]) == (1, 1, 2) else None

    return content.map(one)


def audio_quality(samples: Column, rate: int, least_ms: float = 300, most_ms: float = 30_000) -> Column:
    """Peak, level, clipping and silence shares, offset, duration and warnings of a non-empty array; null for an empty one."""
    n = F.size(samples)
    x = F.transform(samples, lambda v: v.cast("double"))
    total = F.aggregate(x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("p"), F.lit(0).alias("c"), F.lit(0).alias("z")), lambda a, v: F.struct(
        (a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"), F.greatest(a["p"], F.abs(v)).alias("p"),
        (a["c"] + (F.abs(v) >= 0.999).cast("int")).alias("c"), (a["z"] + (F.abs(v) < 0.01).cast("int")).alias("z")))
    level = 20 * F.log10(F.greatest(F.sqrt(total["q"] / n), F.lit(1e-12)))
    clipped, silent, offset, duration = total["c"] / n, total["z"] / n, total["s"] / n, n / rate * 1000
    warnings = F.array_compact(F.array(
        F.when(clipped > 0.01, "CLIPPING_HIGH"), F.when(level < -50, "LEVEL_TOO_LOW"), F.when(silent > 0.95, "MOSTLY_SILENCE"), F.when(F.abs(offset) > 0.05, "DC_OFFSET_HIGH"),
        F.when(~duration.between(least_ms, most_ms), "DURATION_OUT_OF_RANGE")))
    return F.when(n > 0, F.struct(total["p"].alias("peak"), level.alias("rms_dbfs"), clipped.alias("clipping_ratio"), silent.alias("silence_ratio"), offset.alias("dc_offset"), duration.alias("duration_ms"), warnings.alias("warnings")))


def frame_signal(samples: Column, size: int, hop: int) -> Column:
    """Overlapping frames; a signal shorter than one frame gives none."""
    count = F.floor((F.size(samples) - size) / hop).cast("int")
    return F.when(F.size(samples) >= size, F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(samples, i * hop + 1, size))).otherwise(F.array().cast("array<array<float>>"))


def waveform_envelope(samples: Column, bins: int, rate: int) -> Column:
    """(time_ms, low, high) of ``bins`` equal parts, fewer for a shorter signal."""
    n = F.size(samples)
    k = F.greatest(F.lit(1), F.least(F.lit(bins), n))

    def one(i: Column) -> Column:
        a, b = F.floor(i * n / k).cast("int"), F.floor((i + 1) * n / k).cast("int")
        part = F.slice(samples, a + 1, b - a)
        return F.struct(((a + b) / 2 / rate * 1000).alias("time_ms"), F.array_min(part).alias("low"), F.array_max(part).alias("high"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), k - 1), one))


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    x = np.pad(x, (0, max(0, size - len(x))))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def mel_filters(rate: int, fft: int, bins: int, low: float = 40, high: float = 7600) -> np.ndarray:
    """Triangles between points that are evenly spaced on the mel scale (2595 log10(1 + f / 700))."""
    mel = np.linspace(*(2595 * np.log10(1 + np.array([low, high]) / 700)), bins + 2)
    hz = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)[None, :]
    rise = (f - hz[:-2, None]) / np.maximum(hz[1:-1] - hz[:-2], 1e-9)[:, None]
    fall = (hz[2:, None] - f) / np.maximum(hz[2:] - hz[1:-1], 1e-9)[:, None]
    return np.clip(np.minimum(rise, fall), 0, None)


def log_mel_of(x: np.ndarray, rate: int, bins: int = 48, fft: int = 512, size: int = 400, hop: int = 160) -> np.ndarray:
    """Decibels below the loudest cell, at least -80: (bins, frames)."""
    power = np.abs(np.fft.rfft(_frames(x, size, hop) * np.hanning(size), fft)) ** 2
    db = 10 * np.log10(np.maximum(power @ mel_filters(rate, fft, bins).T, 1e-12))
    return np.maximum(db - db.max(), -80).T


def pitch_of(x: np.ndarray, rate: int, size: int = 640, hop: int = 320, low: float = 65, high: float = 450) -> tuple[np.ndarray, np.ndarray]:
    """Pitch (NaN where quiet or unclear) and confidence of each frame, by autocorrelation of all frames at once."""
    frames = _frames(x, size, hop)
    w = (frames - frames.mean(1, keepdims=True)) * np.hanning(size)
    spectrum = np.fft.rfft(w, 2 * size)
    auto = np.fft.irfft(np.abs(spectrum) ** 2)[:, :size]
    first, last = max(1, int(rate // high)), min(size - 1, int(np.ceil(rate / low)))
    band = auto[:, first : last + 1]
    lag = band.argmax(1)
    loud = (np.sqrt((w**2).mean(1)) >= 0.008) & (auto[:, 0] > 1e-9)
    sure = np.where(loud, np.clip(band[np.arange(len(band)), lag] / np.where(loud, auto[:, 0], 1), 0, 1), 0.0)
    return np.where(loud & (sure >= 0.3), rate / (lag + first), np.nan), sure


def log_mel(rate: int, bins: int = 48):
    @F.pandas_udf("array<array<double>>")
    def udf(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: None if x is None else [row.tolist() for row in log_mel_of(np.asarray(x, np.float64)[: FIRST_SECONDS * rate], rate, bins)])

    return udf


def f0_track(rate: int):
    @F.pandas_udf("array<struct<time_ms:double,f0_hz:double,confidence:double>>")
    def udf(samples: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            hz, sure = pitch_of(np.asarray(x, np.float64)[: FIRST_SECONDS * rate], rate)
            return [{"time_ms": (i * 320 + 320) / rate * 1000, "f0_hz": None if np.isnan(h) else float(h), "confidence": float(s)} for i, (h, s) in enumerate(zip(hz, sure, strict=True))]

        return samples.map(one)

    return udf


def acoustic_snapshot(df: DataFrame, samples: str, rate: int, bins: int = 200) -> DataFrame:
    """df with envelope, log_mel, f0 and ``truncated`` (longer than what the features cover)."""
    part = F.slice(samples, 1, FIRST_SECONDS * rate)
    return df.select("*", waveform_envelope(part, bins, rate).alias("envelope"), log_mel(rate)(part).alias("log_mel"), f0_track(rate)(part).alias("f0"), (F.size(samples) > FIRST_SECONDS * rate).alias("truncated"))


def audio_probe(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest (utterance_id, path, audio_sha256) with what its file (path, content) holds: format, level, offset and hash.

    A missing file, or one that is no mono 16-bit WAV, has null measures; its hash tells which.
    """
    heads = wav_headers(files)
    x = F.transform(decode_pcm16(F.col("content")), lambda v: v.cast("double"))
    got = files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("file_size_bytes"), x.alias("x"))
    total = F.aggregate("x", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("p"), F.lit(0).alias("k")), lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + v * v).alias("q"), F.greatest(a["p"], F.abs(v)).alias("p"), (a["k"] + (v != 0).cast("int")).alias("k")))
    n = F.size("x")
    some = lambda c: F.when(n > 0, F.round(c, 8))
    measured = got.withColumn("t", total).select(
        "path", "sha256", "file_size_bytes", F.when(n >= 0, n).alias("sample_count"), some(F.col("t.p")).alias("peak_amplitude"), some(F.sqrt(F.col("t.q") / n)).alias("rms_amplitude"),
        some(F.col("t.s") / n).alias("dc_offset"), some(F.col("t.k") / n).alias("nonzero_sample_ratio"), F.coalesce((n > 0) & (F.col("t.p") > 0), F.lit(False)).alias("waveform_nonempty"),
    )
    both = manifest.join(measured, "path", "left").join(heads.select("path", "rate", "channels", "width", "frames", F.round("duration_ms", 3).alias("duration_ms")), "path", "left")
    return both.withColumn("hash_matches_manifest", F.coalesce(F.col("sha256") == F.col("audio_sha256"), F.lit(False)))
