"""Loudness windows of audio, integrated loudness and ramps."""

import struct
import wave
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of ramps in dB, window length, offset and gate of the loudness scale, filter coefficients
# (b0, b1, b2, a1, a2) of the two stages of the published K weighting at 48 kHz.
THRESHOLDS = (-90, -60, -40, -30, -24, -21, -18, -15, -12, -9, -6, -3, 0, 3, 6)
WINDOW_MS, OFFSET_DB, GATE = 100, -0.691, -70
STAGES = ((1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585), (1.0, -2.0, 1.0, -1.99004745483398, 0.99007225036621))
LAST_INDEX, MOST_ENTRIES = 0xFFFF, 15
MOST_RATE, MOST_CHANNELS = 384_000, 8
#: Samples that a filter takes at a time, as one row of a matrix product.
_BLOCK = 256
PROFILE = "id string, sample_rate int, duration_ms bigint, ref_lufs double, start_ramp binary, end_ramp binary, problem string"


class Biquad:
    """A second-order filter over blocks of samples, with the state carried from block to block.

    Within a block the answer to the samples is a product with a lower-triangular matrix, the answer to the state a
    product with two columns; only the states step from block to block.
    """

    def __init__(self, b0: float, b1: float, b2: float, a1: float, a2: float) -> None:
        step, entry = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        powers = [np.eye(2)]
        for _ in range(_BLOCK):
            powers.append(step @ powers[-1])
        impulse = np.array([b0, *(powers[k][0] @ entry for k in range(_BLOCK - 1))])
        lag = np.subtract.outer(np.arange(_BLOCK), np.arange(_BLOCK))
        self.answer = np.where(lag >= 0, impulse[np.abs(lag)], 0.0).T
        self.fade = np.array([p[0] for p in powers[:_BLOCK]]).T
        self.gather = np.array([powers[_BLOCK - 1 - k] @ entry for k in range(_BLOCK)])
        self.jump, self.powers, self.entry, self.step = powers[_BLOCK], powers, entry, step
        self.b0, self.state = b0, np.zeros(2)

    def __call__(self, samples: np.ndarray) -> np.ndarray:
        whole = len(samples) // _BLOCK * _BLOCK
        rows = samples[:whole].reshape(-1, _BLOCK)
        added, states, now = rows @ self.gather, np.empty((len(rows), 2)), self.state
        for i in range(len(rows)):
            states[i] = now
            now = self.jump @ now + added[i]
        out = [(rows @ self.answer + states @ self.fade).ravel()]
        rest = samples[whole:]
        tail = np.empty(len(rest))
        for i, x in enumerate(rest):
            tail[i] = self.b0 * x + now[0]
            now = self.step @ now + self.entry * x
        self.state = now
        return np.concatenate([*out, tail])


def window_loudness(blocks: Iterable[np.ndarray], rate: int) -> tuple[list[float], int]:
    """(loudness of every 100 ms window, frames) of blocks of samples, channels first; the last window may be short."""
    size, filters, kept, out, frames = max(1, rate * WINDOW_MS // 1000), None, None, [], 0
    for block in blocks:
        block = np.atleast_2d(np.asarray(block, np.float32)).astype(np.float64)
        if filters is None:
            filters, kept = [[Biquad(*s) for s in STAGES] for _ in block], np.empty((len(block), 0))
        elif len(filters) != len(block):
            raise ValueError("the number of channels changed")
        weighted = np.stack([second(first(x)) for (first, second), x in zip(filters, block)])
        kept, frames = np.concatenate([kept, weighted], axis=1), frames + block.shape[1]
        full = kept.shape[1] // size
        squares = (kept[:, : full * size] ** 2).reshape(len(kept), full, size).mean(axis=(0, 2))
        out += map(decibels, squares)
        kept = kept[:, full * size :]
    if kept is not None and kept.shape[1]:
        out.append(decibels(float((kept**2).mean())))
    return out, frames


def decibels(square: float) -> float:
    return 10 * float(np.log10(square)) + OFFSET_DB if square > 0 else float("-inf")


def integrated(loudness: list[float]) -> float:
    """Mean power of the windows above the gate, in dB; -inf if there is none."""
    loud = np.array([x for x in loudness if x > GATE])
    return 10 * float(np.log10(np.mean(10 ** ((loud - OFFSET_DB) / 10)))) + OFFSET_DB if len(loud) else float("-inf")


def ramp(relative: list[float]) -> list[tuple[int, int]]:
    """For every threshold the first window that reaches it; thresholds that none reaches are left out."""
    values = np.asarray(relative)
    return [(t, min(int(np.argmax(values >= t)), LAST_INDEX)) for t in THRESHOLDS if (values >= t).any()]


def encode_ramp(entries: list[tuple[int, int]]) -> bytes:
    """3 bytes an entry: signed dB, unsigned window index, little-endian."""
    if len(entries) > MOST_ENTRIES:
        raise ValueError("too many entries")
    return b"".join(struct.pack("<bH", *entry) for entry in entries)


def decode_ramp(data: bytes) -> list[tuple[int, int]]:
    return [tuple(x) for x in struct.iter_unpack("<bH", data)]


def profile(name: str, blocks: Iterable[np.ndarray], rate: int) -> tuple:
    """A row of PROFILE; `problem` names what makes a profile impossible."""
    if not 0 < rate <= MOST_RATE:
        return name, rate, None, None, None, None, "sample rate"
    try:
        loudness, frames = window_loudness(blocks, rate)
    except ValueError as error:
        return name, rate, None, None, None, None, str(error)
    level = integrated(loudness)
    if not np.isfinite(level):
        return name, rate, None, None, None, None, "silent"
    if len(loudness) > LAST_INDEX + 1:
        return name, rate, None, None, None, None, "too long"
    relative = [x - level for x in loudness]
    return name, rate, int(frames / rate * 1000), level, encode_ramp(ramp(relative)), encode_ramp(ramp(relative[::-1])), None


def opened(path: str) -> BinaryIO:
    """A file of any file system that executors can reach, open for reading."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    uri = f"file://{rest}" if colon and scheme == "file" and not rest.startswith("//") else path
    system, inner = fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)
    return system.open_input_file(inner)


def wav_blocks(source: BinaryIO, frames: int = 131_072) -> tuple[int, Iterator[np.ndarray]]:
    """(sample rate, blocks) of an open PCM WAV file of 8, 16, 24 or 32 bits; a block at a time is read."""
    file = wave.open(source)
    channels, width = file.getnchannels(), file.getsampwidth()
    if not 0 < channels <= MOST_CHANNELS:
        raise ValueError("channels")

    def blocks() -> Iterator[np.ndarray]:
        while raw := file.readframes(frames):
            if width == 1:
                values = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
            elif width == 3:
                parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                values = ((parts[:, 0] << 8 | parts[:, 1] << 16 | parts[:, 2] << 24) / 2**31).astype(np.float32)
            else:
                values = (np.frombuffer(raw, f"<i{width}") / 2 ** (8 * width - 1)).astype(np.float32)
            yield values.reshape(-1, channels).T

    return file.getframerate(), blocks()


def profiles(files: DataFrame) -> DataFrame:
    """PROFILE of the WAV files at `path`; other columns (spark.read.format("binaryFile") has content) are not read.

    Each task opens one file after the other and reads it in blocks, so memory grows with the block and, by a number for
    each 100 ms, with the duration, not with the size of the file.
    """

    def analyse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    with opened(path) as file:
                        rate, blocks = wav_blocks(file)
                        rows.append(profile(path, blocks, rate))
                except (wave.Error, EOFError, ValueError, OSError) as error:
                    rows.append((path, None, None, None, None, None, f"no PCM audio: {error}"))
            yield pd.DataFrame(rows, columns=["id", "sample_rate", "duration_ms", "ref_lufs", "start_ramp", "end_ramp", "problem"]).astype({"sample_rate": "Int32", "duration_ms": "Int64"})

    return files.select("path").mapInPandas(analyse, PROFILE)


def integrated_loudness(loudness: Column) -> Column:
    """Aggregate: integrated loudness of windows; NULL if none is above the gate."""
    loud = F.when(loudness > GATE, F.pow(F.lit(10.0), (loudness - OFFSET_DB) / 10))
    return 10 * F.log10(F.avg(loud)) + OFFSET_DB


def ramp_entries(windows: DataFrame, key: str, index: str, relative: str) -> DataFrame:
    """key, threshold, first_index, last_distance: where each threshold is first reached from either end.

    One aggregation with a conditional minimum and maximum for each threshold; no window of a series is gathered.
    """
    hits = [F.struct(F.lit(t).alias("threshold"), F.min(F.when(F.col(relative) >= t, F.col(index))).alias("first_index"), (F.max(index) - F.max(F.when(F.col(relative) >= t, F.col(index)))).alias("last_distance")) for t in THRESHOLDS]
    found = windows.groupBy(key).agg(F.array(*hits).alias("__hits")).select(key, F.inline("__hits"))
    cut = lambda c: F.least(F.col(c), F.lit(LAST_INDEX)).alias(c)
    return found.where("first_index is not null").select(key, "threshold", cut("first_index"), cut("last_distance"))
