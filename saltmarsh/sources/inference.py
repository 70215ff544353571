"""The plug point for a transcription model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def transcribe_with(audio: DataFrame, make_model: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """(utterance_id, hypothesis, latency_ms, rtf, status, error) for audio (utterance_id, content, duration_ms).

    ``make_model`` is called once in each task.  A failing utterance is reported and doesn't stop the others.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for part in parts:
            rows = []
            for key, content, duration in zip(part["utterance_id"], part["content"], part["duration_ms"], strict=True):
                began, text, error = time.perf_counter(), None, None
                try:
                    text = model(bytes(content))
                except Exception as e:  # noqa: BLE001  any failure of a model is that utterance's own
                    error = f"{type(e).__name__}: {e}"
                ms = (time.perf_counter() - began) * 1000
                rows.append((key, text, ms, ms / duration if duration else None, "failed" if error else "ok", error))
            yield pd.DataFrame(rows, columns=["utterance_id", "hypothesis", "latency_ms", "rtf", "status", "error"])

    return audio.select("utterance_id", "content", "duration_ms").mapInPandas(run, "utterance_id string, hypothesis string, latency_ms double, rtf double, status string, error string")
