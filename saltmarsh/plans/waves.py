"""Registered queries over signals in chunks: fifty embeddings in order are one signal, each of them a chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals
from .lenses import table
from .registry import query

RATE = 16_000
_SAMPLES = """parts AS (SELECT vec_id // 50 AS signal, vec_id, embedding AS x, coalesce(sum(len(embedding)) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM embeddings),
samples AS (SELECT signal, start + i AS t, x[i + 1]::DOUBLE AS v FROM parts, unnest(range(len(x))) AS r(i)), lengths AS (SELECT signal, count(*) AS n FROM samples GROUP BY signal)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("signal"), "vec_id", F.col("embedding").alias("samples"))
    return signals.with_starts(e, "signal", "vec_id").select("signal", "start", "samples")


_MEL = f"""WITH {_SAMPLES}, cells AS (SELECT signal, f, t - f * 160 AS j, v * (0.5 - 0.5 * cos(2 * pi() * (t - f * 160) / 399)) AS w FROM lengths JOIN samples USING (signal), unnest(range((greatest(n, 400) - 400) // 160 + 1)) AS r(f) WHERE t >= f * 160 AND t < f * 160 + 400),
power AS (SELECT signal, f, k, sum(w * cos(2 * pi() * k * j / 512)) ** 2 + sum(w * sin(2 * pi() * k * j / 512)) ** 2 AS p FROM cells, range(257) AS s(k) GROUP BY ALL),
ends AS (SELECT 2595 * log10(1 + 40 / 700) AS a, 2595 * log10(1 + 7600 / 700) AS b), hz AS (SELECT i, 700 * (10 ** ((a + (b - a) * i / 49) / 2595) - 1) AS h FROM ends, range(50) AS s(i)),
filters AS (SELECT m.i AS bin, k, greatest(least((k * 31.25 - l.h) / greatest(m.h - l.h, 1e-9), (u.h - k * 31.25) / greatest(u.h - m.h, 1e-9)), 0) AS g FROM hz l JOIN hz m ON m.i = l.i + 1 JOIN hz u ON u.i = m.i + 1, range(257) AS s(k)),
cell AS (SELECT signal, f, bin, 10 * log10(greatest(sum(p * g), 1e-12)) AS db FROM power JOIN filters USING (k) WHERE g > 0 GROUP BY ALL)
SELECT signal, f AS frame, bin - 1 AS bin, round(greatest(db - max(db) OVER (PARTITION BY signal), -80), 4) AS db FROM cell"""


@query(_MEL)
def signal_log_mel(spark, d):
    mel = signals.log_mel(_chunks(spark, d), "signal", RATE)
    return mel.select("signal", "frame", F.posexplode("mel").alias("bin", "db")).select("signal", "frame", F.col("bin").cast("long").alias("bin"), F.round("db", 4).alias("db"))


_PITCH = f"""WITH {_SAMPLES}, frames AS (SELECT signal, f FROM lengths, unnest(range((greatest(n, 640) - 640) // 320 + 1)) AS r(f)),
raw AS (SELECT signal, f, j, coalesce(v, 0) AS v FROM frames CROSS JOIN range(640) AS s(j) LEFT JOIN samples USING (signal) WHERE t = f * 320 + j),
every AS (SELECT frames.signal, frames.f, s.j, coalesce(raw.v, 0) AS v FROM frames CROSS JOIN range(640) AS s(j) LEFT JOIN raw ON raw.signal = frames.signal AND raw.f = frames.f AND raw.j = s.j),
w AS (SELECT signal, f, j, (v - avg(v) OVER (PARTITION BY signal, f)) * (0.5 - 0.5 * cos(2 * pi() * j / 639)) AS w FROM every),
auto AS (SELECT a.signal, a.f, b.j - a.j AS lag, sum(a.w * b.w) AS r FROM w a JOIN w b ON a.signal = b.signal AND a.f = b.f AND (b.j = a.j OR b.j - a.j BETWEEN 35 AND 247) GROUP BY ALL),
best AS (SELECT signal, f, max(r) FILTER (lag = 0) AS r0, arg_max(lag, r) FILTER (lag > 0) AS lag, max(r) FILTER (lag > 0) AS r FROM auto GROUP BY ALL),
found AS (SELECT *, sqrt(r0 / 640) >= 0.008 AND r0 > 1e-9 AS loud FROM best), sure AS (SELECT *, CASE WHEN loud THEN least(greatest(r / r0, 0), 1) ELSE 0 END AS c FROM found)
SELECT signal, f AS frame, (f * 320 + 320) / 16000 * 1000 AS time_ms, CASE WHEN loud AND c >= 0.3 THEN round(16000 / lag, 6) END AS f0_hz, round(c, 6) AS confidence FROM sure"""


@query(_PITCH)
def signal_pitch(spark, d):
    f0 = signals.f0_track(_chunks(spark, d), "signal", RATE)
    return f0.select("signal", "frame", "time_ms", F.round("f0_hz", 6).alias("f0_hz"), F.round("confidence", 6).alias("confidence"))


_LEVEL = f"""WITH {_SAMPLES}, m AS (SELECT signal, n, max(abs(v)) AS peak, 20 * log10(greatest(sqrt(sum(v * v) / n), 1e-12)) AS rms, count(*) FILTER (abs(v) < 0.01) / n AS quiet, sum(v) / n AS dc FROM samples JOIN lengths USING (signal) GROUP BY signal, n)
SELECT signal, round(peak, 6) AS peak, round(rms, 6) AS rms_dbfs, round(quiet, 8) AS silence_ratio, round(dc, 6) AS dc_offset, round(n / 16000 * 1000, 6) AS duration_ms FROM m"""


@query(_LEVEL)
def signal_quality(spark, d):
    q = signals.quality(_chunks(spark, d), "signal", RATE)
    return q.select("signal", *[F.round(c, 8 if c == "silence_ratio" else 6).alias(c) for c in ("peak", "rms_dbfs", "silence_ratio", "dc_offset", "duration_ms")])


_ENVELOPE = f"""WITH {_SAMPLES}, b AS (SELECT signal, n, least(n, 200) AS k FROM lengths), e AS (SELECT signal, i AS bin, i * n // k AS a, (i + 1) * n // k AS z FROM b, unnest(range(k)) AS r(i))
SELECT signal, bin, (a + z) / 2 / 16000 * 1000 AS time_ms, min(v)::FLOAT::DOUBLE AS low, max(v)::FLOAT::DOUBLE AS high FROM e JOIN samples USING (signal) WHERE t >= a AND t < z GROUP BY ALL"""


@query(_ENVELOPE)
def signal_envelope(spark, d):
    e = signals.envelope(_chunks(spark, d), "signal", 200, RATE)
    return e.select("signal", F.col("bin").cast("long").alias("bin"), "time_ms", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"))
