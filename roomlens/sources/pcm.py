"""Audio files as frames of samples; wave files are read with the standard library, other kinds need a decoder outside."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """(mono samples in -1..1, rate) of 16-bit wave content."""
    with wave.open(io.BytesIO(content)) as w:
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float) / 32768
        return (x.reshape(-1, w.getnchannels()).mean(1) if w.getnchannels() > 1 else x), w.getframerate()


def frames(spark: SparkSession, path: str, seconds: float = 1.0) -> DataFrame:
    """(media_id, frame, rate, samples) of the wave files at ``path``; the last frame may be shorter."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                x, rate = decode(bytes(content))
                n = max(1, int(rate * seconds))
                rows = [(p, k, rate, x[lo : lo + n].tolist()) for k, lo in enumerate(range(0, len(x), n))]
                yield pd.DataFrame(rows, columns=["media_id", "frame", "rate", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "media_id string, frame long, rate long, samples array<double>")
