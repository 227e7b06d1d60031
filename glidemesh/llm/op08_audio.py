"""Audio features of media columns: resampling, log-mel frames and energy segments."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glidemesh.llm.common import table

UNIT = 192
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


@dataclass(frozen=True)
class AudioParams:
    rate: int = 12_000
    to_rate: int = 8_000
    taps: int = 8  # of the resampling filter on each side, in samples of the slower rate
    window: int = 256
    hop: int = 128
    mels: int = 16
    frames: int = 8  # of each tensor
    block: int = 512  # tensors worked on at once
    open_std: float = 0.5  # a segment opens above mean + open_std * std of the frames' log energy
    keep_std: float = -0.25  # and lasts while the energy stays above mean + keep_std * std


def write_wav(payload: bytes, rate: int) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    n = len(payload)
    pad = n % 2
    return HEADER.pack(b"RIFF", 36 + n + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload + b"\0" * pad


def read_wav(media: bytes) -> tuple[int, int, int]:
    """(rate, offset of the samples, number of samples) of a file of ``write_wav``."""
    riff, _, wave, fmt, _, kind, channels, rate, _, _, bits, data, n = HEADER.unpack_from(media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8):
        raise ValueError("not a mono 8-bit WAV file")
    return rate, HEADER.size, n


@lru_cache(maxsize=4)
def _phases(up: int, down: int, taps: int) -> tuple[np.ndarray, int]:
    """The low-pass filter dealt to ``up`` phases: row p weighs the inputs of outputs m = p mod up."""
    half = taps * max(up, down)
    t = np.arange(-half, half + 1)
    cut = 1.0 / max(up, down)
    h = up * cut * np.sinc(cut * t) * np.kaiser(2 * half + 1, 6.0)
    reach = half // up + 1
    rows = np.zeros((up, 2 * reach + 1), dtype=np.float32)
    for p in range(up):
        centre = p * down // up
        for j in range(-reach, reach + 1):
            d = p * down - (centre + j) * up
            if -half <= d <= half:
                rows[p, j + reach] = h[d + half]
    return rows, reach


def resample(x: np.ndarray, first: int, count: int, up: int, down: int, taps: int) -> np.ndarray:
    """Outputs ``first .. first + count`` of polyphase resampling; ``first`` a multiple of ``up``.

    Only the inputs within reach are touched, so a long signal can be taken block by block.
    """
    rows, reach = _phases(up, down, taps)
    start = first // up * down - reach
    steps = -(-count // up)
    need = steps * down + 2 * reach + down
    seg = np.zeros(need, dtype=np.float32)
    lo, hi = max(0, start), min(len(x), start + need)
    if hi > lo:
        seg[lo - start : hi - start] = x[lo:hi]
    view = np.lib.stride_tricks.sliding_window_view(seg, 2 * reach + 1)
    out = np.empty((steps, up), dtype=np.float32)
    for p in range(up):
        out[:, p] = view[p * down // up :: down][:steps] @ rows[p]
    return out.reshape(-1)[:count]


@lru_cache(maxsize=4)
def _mel_bank(rate: int, window: int, mels: int) -> np.ndarray:
    """Triangles that overlap by half, evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(window // 2 + 1) * rate / window
    rise = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def hysteresis(energy: np.ndarray, p: AudioParams) -> list[tuple[int, int]]:
    """Runs of frames above the keeping level that reach the opening level somewhere."""
    mean, std = float(energy.mean()), float(energy.std())
    on, keep = energy >= mean + p.open_std * std, energy >= mean + p.keep_std * std
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    seen = np.concatenate([[0], np.cumsum(on)])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if seen[b] > seen[a]]


def features(samples: np.ndarray, p: AudioParams) -> tuple[np.ndarray, int, list[tuple[int, int]]]:
    """(tensors [n, frames, mels], number of frames, segments in frames) of 8-bit samples."""
    g = gcd(p.to_rate, p.rate)
    up, down = p.to_rate // g, p.rate // g
    n_out = -(-len(samples) * up // down)
    n_frames = max(1, -(-(n_out - p.window) // p.hop) + 1)
    bank, taper = _mel_bank(p.to_rate, p.window, p.mels), np.hanning(p.window).astype(np.float32)
    tensors, energies = [], []
    step = p.block * p.frames
    for a in range(0, n_frames, step):
        k = min(step, n_frames - a)
        first = a * p.hop // up * up
        off = a * p.hop - first
        y = resample_block(samples, first, off + (k - 1) * p.hop + p.window, up, down, p.taps)[off:]
        view = np.lib.stride_tricks.sliding_window_view(y, p.window)[:: p.hop][:k]
        power = np.abs(np.fft.rfft(view * taper, axis=1)).astype(np.float32) ** 2
        mel = np.log(power @ bank + np.float32(1e-6))
        energies.append(np.log(np.einsum("ij,ij->i", view, view) / p.window + 1e-6))
        full = np.full((-(-k // p.frames) * p.frames, p.mels), np.log(np.float32(1e-6)), dtype=np.float32)
        full[:k] = mel
        tensors.append(full.reshape(-1, p.frames, p.mels))
    return np.concatenate(tensors), n_frames, hysteresis(np.concatenate(energies), p)


def level_db(samples: np.ndarray) -> float:
    """Mean power of 8-bit samples in decibels, from exact integer sums."""
    total = sum(int(((samples[a : a + (1 << 20)].astype(np.int64) - 128) ** 2).sum()) for a in range(0, len(samples), 1 << 20))
    return 10 * float(np.log10(total / max(1, len(samples)) / 16384 + 1e-12))


def resample_block(samples: np.ndarray, first: int, count: int, up: int, down: int, taps: int) -> np.ndarray:
    """``resample`` of raw 8-bit samples: only the part within reach becomes floats."""
    reach = _phases(up, down, taps)[1]
    lo = max(0, first // up * down - reach - down)
    lo -= lo % down
    hi = min(len(samples), (first + count) * down // up + reach + 2 * down)
    x = (samples[lo:hi].astype(np.float32) - 128) / 128
    return resample(x, first - lo // down * up, count, up, down, taps)


def tensor_stream(tensors: np.ndarray, n_frames: int, segments: list[tuple[int, int]], p: AudioParams) -> bytes:
    """An Arrow stream: a fixed-shape tensor a row, the span of time it covers, its voiced frames."""
    s = p.hop / p.to_rate
    at = np.arange(len(tensors)) * p.frames
    voiced = np.zeros(len(tensors) * p.frames + 1, dtype=np.int32)
    for a, b in segments:
        voiced[a:b] = 1
    batch = pa.record_batch(
        {
            "mel": pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors)),
            "start_s": at * s,
            "end_s": np.minimum(at + p.frames, n_frames) * s,
            "voiced": np.add.reduceat(voiced, at),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def audio_features(
    df: DataFrame,
    id_col: str = "doc_id",
    bytes_col: str = "payload",
    params: AudioParams = AudioParams(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Store a column of bytes as 8-bit audio, read it back and describe it.

    Returns ``doc_id``; ``media`` (the WAV file); ``data_offset`` and ``data_bytes`` (where the
    samples stand in it, by its own header); ``tensors`` (an Arrow stream of log-mel tensors of
    fixed shape [frames, mels] with their time spans); ``segments`` (time spans found by hysteresis
    on the frames' energy); ``feature`` (a summary: equal bytes give equal summaries).

    Every payload is worked on block by block and apart from others. A null payload counts as
    empty, gives a file without samples and one tensor of silence. Repeated rows and null ids stay.
    Columns named in ``keep`` are carried along (none may bear a name of the result); others are
    ignored.
    """
    p = params
    names = ["media", "data_offset", "data_bytes", "tensors", "segments", "feature"]
    if clash := {"doc_id", *names} & {*keep}:
        raise ValueError(f"columns to keep clash with the result: {sorted(clash)}")

    def one(payload: bytes | None):
        media = write_wav(payload or b"", p.rate)
        _, off, n = read_wav(media)
        samples = np.frombuffer(media, np.uint8, n, off)
        tensors, frames, segments = features(samples, p)
        level = level_db(samples)
        s = p.hop / p.to_rate
        voiced = sum(b - a for a, b in segments) * s
        digest = zlib.crc32(np.round(tensors, 3).tobytes())
        text = f"frames={frames};tensors={len(tensors)};segments={len(segments)};voiced_s={voiced:.3f};level_db={level:.4f};mel={digest:08x}"
        return media, off, n, tensor_stream(tensors, frames, segments, p), [{"start_s": a * s, "end_s": b * s} for a, b in segments], text

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                out = pd.DataFrame([one(x) for x in part.payload], columns=names)
                yield pd.concat([part.drop(columns="payload").reset_index(drop=True), out], axis=1)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(bytes_col).cast("binary").alias("payload"), *keep)
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in keep)
    return rows.mapInPandas(
        run,
        f"doc_id long, {kept}media binary, data_offset int, data_bytes long, tensors binary, "
        "segments array<struct<start_s double, end_s double>>, feature string",
    )


def padded(text_col: str, unit: int = UNIT) -> "F.Column":
    """UTF-8 bytes of a text with spaces up to a positive multiple of ``unit``; null is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.octet_length(text)
    short = F.greatest(F.lit(unit), F.ceil(n / unit) * unit) - n
    return F.concat(text, F.repeat(F.lit(" "), short.cast("int"))).cast("binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    out = audio_features(docs.select("doc_id", n.alias("n_bytes"), padded("text").alias("payload")), keep=("n_bytes",))
    return out.select(
        "doc_id",
        "n_bytes",
        F.col("data_bytes").alias("payload_bytes"),
        F.sha2(F.expr("substring(media, data_offset + 1, cast(data_bytes as int))"), 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(media, cast(data_offset + data_bytes - 15 as int), 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.octet_length("tensors").alias("tensor_bytes"),
        F.size("segments").alias("n_segments"),
    )


QUERIES = {"op8_audio_features": query}
ORACLES: dict[str, str] = {}
