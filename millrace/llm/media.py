"""Audio features of media columns: polyphase resampling, log-mel filterbanks, energy segments.

A payload becomes an 8-bit unsigned PCM WAV file, and the files are stored as a Parquet table in the shared
folder. What follows reads the stored bytes back: it finds the data chunk, resamples by a polyphase filter, takes overlapped windows
through a mel filterbank and a logarithm, and marks segments by hysteresis on frame energy (a
segment opens above the upper threshold and closes below the lower one). Frames are cut into tensors
of one fixed shape with their time spans and kept as an Arrow fixed-shape tensor column in an IPC
stream, which Parquet stores as binary.

Each document is handled by itself with shapes that depend on its length alone, so equal texts give
equal values, and memory is bounded by one block of frames and one document.

Defined results: null or empty text: 64 zero bytes; texts of any length are read whole; repeated rows: repeated results; empty table: no
rows; columns beside doc_id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, bound_batches, raw_texts, written

RATE, UP, DOWN, TAPS = 16_000, 1, 2, 16
FRAME, HOP, FFT, MELS = 200, 80, 256, 32
SPAN = 64  # frames of one tensor
BLOCK = 4096  # frames computed at a time
OPEN_DB, CLOSE_DB = 3.0, -1.0  # against the mean frame energy of the clip


def encode_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM in a WAV container."""
    pad = len(samples) & 1
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(samples) + pad) + head + samples + b"\0" * pad


def decode_wav(media: bytes) -> tuple[int, memoryview]:
    """(rate, samples) of what encode_wav wrote; walks the chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif kind == b"data":
            return rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@cache
def _lowpass(up: int, down: int) -> np.ndarray:
    """Phases of a Hamming-windowed sinc, one row for each output phase."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = cut * np.sinc(cut * t) * np.hamming(n)
    return (h * up / h.sum()).reshape(TAPS, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output j takes phase j*down mod up, and only the taps that meet real samples."""
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS + down, np.float32)])
    phases, out = _lowpass(up, down), np.zeros(n, np.float32)
    for first in range(up):
        j = np.arange(first, n, up)
        if not len(j):
            continue
        start, h = first * down // up, phases[first * down % up]
        own = np.zeros(len(j), np.float32)
        for k in range(TAPS):
            piece = padded[start + k : start + k + (len(j) - 1) * down + 1 : down]
            own += h[TAPS - 1 - k] * piece
        out[first::up] = own
    return out


@cache
def _filters() -> tuple[np.ndarray, np.ndarray]:
    """A Hann window and the triangular mel filterbank."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    up = (f[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    down = (points[2:] - f[:, None]) / (points[2:] - points[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log-mel energies, frame energies in dB); a short signal gives one frame."""
    frames = max(1, 1 + (len(y) - FRAME) // HOP)
    y = np.pad(y, (0, max(0, (frames - 1) * HOP + FRAME - len(y))))
    window, bank = _filters()
    views = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, BLOCK):
        w = views[at : at + BLOCK] * window
        spectrum = np.fft.rfft(w, FFT, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mels[at : at + BLOCK] = np.log(power.astype(np.float32) @ bank + 1e-6)
        energy[at : at + BLOCK] = 10 * np.log10(np.einsum("ij,ij->i", w, w) / FRAME + 1e-9)
    return mels, energy


def segments(energy: np.ndarray, opens: float = OPEN_DB, closes: float = CLOSE_DB) -> np.ndarray:
    """Rows (first, last + 1) of segments by hysteresis around the mean energy."""
    level = energy - energy.mean()
    mark = np.where(level >= opens, 1, np.where(level < closes, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] == 1)
    edges = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)], 1)


TENSOR = pa.fixed_shape_tensor(pa.float16(), (SPAN, MELS))


def tensors(mels: np.ndarray) -> bytes:
    """An Arrow IPC stream: tensor of fixed shape, start_s, end_s; the last tensor is padded with zeros."""
    n = -(-len(mels) // SPAN)
    block = np.zeros((n * SPAN, MELS), np.float16)
    block[: len(mels)] = mels
    start = np.arange(n) * SPAN
    end = np.minimum(start + SPAN, len(mels))
    step = HOP * DOWN / (RATE * UP)
    batch = pa.record_batch(
        [
            pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(block.reshape(-1)), SPAN * MELS)),
            pa.array(start * step),
            pa.array((end - 1) * step + FRAME * DOWN / (RATE * UP)),
        ],
        names=["tensor", "start_s", "end_s"],
    )
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


def features(media: bytes) -> dict:
    """Tensors, segments and pooled energies of a stored WAV file."""
    _, samples = decode_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x))
    return {"frames": len(mels), "segments": segments(energy), "mels": mels.mean(0, dtype=np.float64), "tensors": tensors(mels)}


def pack(text: bytes) -> bytes:
    """The payload: the text with zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % 64 if text else 64)


SCHEMA = (
    "doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "n_frames long, n_segments long, feature string, spans array<array<double>>, tensors binary{more}"
)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the stored form of each row's text."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text"))

    def run(batches):
        for b in batches:
            texts = raw_texts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode_wav(pack(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def stored_features(stored: DataFrame, keep_media: bool = False) -> DataFrame:
    """Features of stored media (doc_id, n_bytes, media): digests, the spans of segments in seconds, tensors with theirs."""
    bound_batches(stored.sparkSession)
    ddl = SCHEMA.format(kind=stored.schema["doc_id"].dataType.simpleString(), more=", media binary" if keep_media else "")
    schema = arrow_schema(stored.sparkSession, ddl)

    def run(batches):
        step = HOP * DOWN / (RATE * UP)
        for b in batches:
            rows = []
            for i, n, media in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload, f = bytes(decode_wav(media)[1]), features(media)
                digest = hashlib.sha256(f["tensors"]).hexdigest()[:16]
                pooled = ",".join(f"{v:.2f}" for v in f["mels"].reshape(8, -1).mean(1))
                rows.append((
                    i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(),
                    f["frames"], len(f["segments"]), f"{f['frames']}x{MELS};seg={len(f['segments'])};mel={pooled};tensors={digest}",
                    (f["segments"] * step).tolist(), f["tensors"], *([media] if keep_media else []),
                ))
            cols = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)


def audio_features(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Per document the features read back from its stored form; keep_media adds that as the column media."""
    return stored_features(written(media_table(docs), "media"), keep_media)


def query(spark, sf_dir: str) -> DataFrame:
    return audio_features(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_media=False)
