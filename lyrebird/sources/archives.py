"""Text corpora in gzipped tars, and audio: WAV decoding (other formats by a library) and log mel features in numpy."""

from __future__ import annotations

import io
import tarfile
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The splits of the corpus, which are folders and file suffixes alike.
SPLITS = ("dev", "devtest")


def corpus_lines(spark: SparkSession, path: str, splits: tuple[str, ...] = SPLITS, depth: int = 3) -> DataFrame:
    """(lang, file, line): stripped, non-empty lines of a tar.gz's files ``.../<split>/<language>.<split>``. An archive is
    a stream, so each is read by one task, a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for content in df["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as archive:
                    for m in archive:
                        parts = m.name.strip("/").split("/")
                        if m.isfile() and len(parts) >= depth and parts[-2] in splits and parts[-1].rpartition(".")[2] in splits:
                            lines = [s for raw in archive.extractfile(m) if (s := raw.decode("utf-8").strip())]
                            yield pd.DataFrame({"lang": parts[-1].split(".", 1)[0], "file": m.name, "line": lines})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(
        run, "lang string, file string, line string",
    )


def corpus_counts(lines: DataFrame) -> DataFrame:
    by_file = lines.groupBy("lang", "file").agg(F.count("*").alias("n"))
    return by_file.agg(
        F.sum("n").alias("num_lines"), F.count("*").alias("num_files"), F.count_distinct("lang").alias("num_languages"),
    )


def _wav(payload: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(payload)) as w:
        n, width, channels, own = w.getnframes(), w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(n)
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width == 3:
        wide = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = (np.pad(wide, ((0, 0), (1, 0))).copy().view("<i4").ravel() >> 8) / float(1 << 23)
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"WAV samples of {width} bytes are not read")
    return x.reshape(-1, channels).mean(1), own


def _compressed(payload: bytes) -> tuple[np.ndarray, int]:
    """mp3, flac and others need a library that is no part of this one."""
    try:
        import soundfile
    except ModuleNotFoundError as e:
        raise ValueError("only WAV is read without the soundfile library") from e
    x, own = soundfile.read(io.BytesIO(payload), always_2d=True, dtype="float64")
    return x.mean(1), own


def samples(payload: bytes, rate: int = 16_000) -> np.ndarray:
    """Mono samples in [-1, 1) at a rate, from a PCM WAV file; from any other file by an audio library, if one is there."""
    x, own = _wav(payload) if payload[:4] == b"RIFF" else _compressed(payload)
    if own != rate and len(x):
        at = np.arange(int(len(x) * rate / own)) * own / rate
        x = np.interp(at, np.arange(len(x)), x)
    return x


def fbank(x: np.ndarray, rate: int = 16_000, bins: int = 80, length_ms: int = 25, shift_ms: int = 10) -> np.ndarray:
    """Log mel energies without dither, so that they are the same each time: frames that fit wholly, mean removed,
    pre-emphasis, a power-of-cosine window, mel triangles from 20 Hz to half the rate."""
    size, step = rate * length_ms // 1000, rate * shift_ms // 1000
    x = x * (1 << 15)
    if len(x) < size:
        return np.zeros((0, bins), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    frames = frames - frames.mean(1, keepdims=True)
    frames = frames - 0.97 * np.concatenate([frames[:, :1], frames[:, :-1]], 1)
    window = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85
    padded = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames * window, padded)) ** 2
    mel = lambda f: 1127 * np.log(1 + f / 700)
    edges = np.linspace(mel(20.0), mel(rate / 2), bins + 2)
    at = mel(np.arange(padded // 2 + 1) * rate / padded)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    weights = np.maximum(0, np.minimum((at - low) / (mid - low), (high - at) / (high - mid)))
    return np.log(np.maximum(power @ weights.T, np.finfo(np.float32).eps)).astype(np.float32)


def features(payload: Column, rate: int = 16_000, bins: int = 80) -> Column:
    """Feature frames of WAV bytes, as arrays of arrays."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: None if b is None else [f.tolist() for f in fbank(samples(b, rate), rate, bins)])

    return F.pandas_udf(run, "array<array<float>>")(payload)
