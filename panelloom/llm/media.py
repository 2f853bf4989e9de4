"""Media columns: texts' bytes as WAV samples, read back, with short-time spectra and spectral-peak pair fingerprints.

A payload is the text in UTF-8 with zero bytes up to a positive multiple of `block`. It is stored as unsigned 8-bit mono
samples by the wave module. Features come from the bytes that are read back: frames of 256 samples every 128 under a Hann
window, each frame's strongest bin above the lowest two (the lowest of equals), and pairs of a frame's peak with the peaks
of the next three frames. A pair is coded as frame << 20 | bin << 12 | later bin << 4 | distance, so a fingerprint array is
in order of time.

Nulls and edges: a null text is an empty one, whose payload is `block` zero bytes; null media reads back as null; equal
texts give equal values; the last frame is filled with silence (128); of equally strong bins the lowest counts; texts of any
length are stored whole; repeated rows give equal values; an empty table gives an empty result. Other columns stay as they are,
but for those that are named like an output, which takes their place.
"""

from __future__ import annotations

import io
import wave
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelloom.llm import frames
from panelloom.llm.frames import ship_package
from panelloom.llm.words import chunks

RATE = 8000
FRAME, HOP, REACH = 256, 128, 3
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin of each frame, a bounded number of frames at a time."""
    count = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    full = np.full((count - 1) * HOP + FRAME, 128, np.uint8)
    full[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(full, FRAME)[::HOP]
    out = np.empty(count, np.int64)
    for at in range(0, count, 2048):
        block = (frames[at : at + 2048].astype(np.float32) - 128) * _WINDOW
        spectrum = np.fft.rfft(block, axis=1)
        out[at : at + 2048] = np.argmax((spectrum.real**2 + spectrum.imag**2)[:, 2:], axis=1) + 2
    return out


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Codes of all peak pairs in order of time."""
    p = peaks(samples)
    t = np.arange(len(p))
    codes = [(t[:-d] << 20) | (p[:-d] << 12) | (p[d:] << 4) | d for d in range(1, REACH + 1) if len(p) > d]
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def _store(column: str, block: int, kept: list[str]):
    def run(batches):
        for piece in chunks(batches, column):
            sizes, media = [], []
            for text in piece.column(column).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(to_wav(raw + bytes(-len(raw) % block if raw else block)))
            yield frames.batch(piece, kept, n_bytes=pa.array(sizes, pa.int64()), media=pa.array(media, pa.binary()))

    return run


def _read(column: str, kept: list[str]):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                payloads, codes, counts = [], [], []
                for media in batch.column(batch.schema.names.index(column)).to_pylist():
                    payload = None if media is None else from_wav(media)
                    payloads.append(payload)
                    samples = None if payload is None else np.frombuffer(payload, np.uint8)
                    codes.append(None if samples is None else fingerprints(samples))
                    counts.append(None if samples is None else max(1, -(-(len(samples) - FRAME) // HOP) + 1))
                yield frames.batch(batch, kept, payload=pa.array(payloads, pa.binary()), n_frames=pa.array(counts, pa.int64()), fingerprint=pa.array(codes, pa.list_(pa.int64())))

    return run


def store_media(df: DataFrame, text_col: str = "text", block: int = 64) -> DataFrame:
    """df with n_bytes and the media column: a WAV file for each row."""
    ship_package(df.sparkSession)
    return frames.with_columns(df, partial(_store, text_col, block), "n_bytes long, media binary")


def read_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with payload (the stored samples), n_frames and fingerprint (time-coded peak pairs) of each WAV file."""
    ship_package(df.sparkSession)
    return frames.with_columns(df, partial(_read, media_col), "payload binary, n_frames long, fingerprint array<long>")
