"""Audio columns: lossless 8-bit media, and features read back from it.

The media column is made by expressions alone: a WAV header and the payload as unsigned 8-bit samples; it is
written. The feature step reads the stored bytes: polyphase resampling with whole-number taps (exact in floats),
log-mel filterbanks over overlapped frames, and segments by energy with hysteresis. Features are stored as
fixed-shape Arrow tensors of frames by bands, each with its time span, and read back for what is said of them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, text_chunks, written

#: Payload unit in bytes; sample rate of the media and of the features; up and down factors between them.
UNIT, RATE, UP, DOWN = 576, 16_000, 1, 2
#: Frame and hop in resampled samples, bands, frames of a tensor.
FRAME, HOP, BANDS, FRAMES = 256, 128, 24, 32
#: Segments open over one energy and close under the other (log10 of mean square), and last this many frames.
OPEN, CLOSE, SHORTEST = 2.6, 2.2, 3
#: Frames that are transformed at once, whole tensors of them; the level of an empty frame.
BLOCK, FLOOR = 1 << 12, -3.0


def little_endian(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))


def encode_media(docs: DataFrame, unit: int = UNIT, rate: int = RATE) -> DataFrame:
    """doc_id, n_bytes, media: the UTF-8 bytes, padded with bytes 255 to a positive multiple of ``unit``, as WAV.

    Null texts count as empty and become one unit of padding. Equal texts give equal media.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    padded = F.greatest(F.lit(1), F.ceil(n / F.lit(unit))).cast("int") * unit
    pad = F.unhex(F.repeat(F.lit("FF"), (padded - n).cast("int")))
    header = F.concat(
        F.lit(b"RIFF"), little_endian(padded + 36), F.lit(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data"), little_endian(padded)
    )
    return docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat(header, data, pad).alias("media"))


def read_wav(media: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and 8-bit samples of a mono WAV, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV data")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        if name == b"data":
            return rate, np.frombuffer(media, np.uint8, size, at + 8)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def taps(up: int = UP, down: int = DOWN, half: int = 8) -> np.ndarray:
    """A windowed sinc low-pass for the lower of the two rates, rounded to whole 1/4096."""
    widest = max(up, down)
    t = np.arange(-half * widest, half * widest + 1)
    return np.rint(4096 * np.sinc(t / widest) * np.hanning(len(t) + 2)[1:-1] / widest * up)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, h: np.ndarray | None = None) -> np.ndarray:
    """Polyphase: output k is the sum of x[j] * h[k * down - j * up + mid], one branch of taps a phase."""
    h = taps(up, down) if h is None else h
    mid, n = len(h) // 2, -(-len(x) * up // down)
    out = np.zeros(n, np.float64)
    for first in range(up):  # outputs k = first, first + up, ...: all of one phase
        k = np.arange(first, n, up)
        if not len(k):
            continue
        phase = (first * down + mid) % up
        branch = h[phase::up]
        newest = (first * down + mid) // up  # the input that meets the branch's first tap
        padded = np.concatenate([np.zeros(len(branch)), x, np.zeros(len(branch) + down)])
        begin = newest - len(branch) + 1 + len(branch)
        rows = np.lib.stride_tricks.sliding_window_view(padded, len(branch))[begin :: down][: len(k)]
        out[k] = rows @ branch[::-1]
    return out / 4096


def mel_bank(rate: float, size: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """(bins, bands) triangles, even on the mel scale from 0 to half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    bins = np.arange(size // 2 + 1)[:, None] * rate / size
    up, down = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def resampled(samples: np.ndarray, start: int, stop: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Outputs ``start`` (a multiple of ``up``) to ``stop`` of the resampled signal, from the samples round them alone."""
    h = taps(up, down)
    margin = down * (len(h) // (up * down) + 2)
    a = start // up * down - margin
    b = start // up * down + -(-(stop - start) * down // up) + margin
    x = np.zeros(b - a)
    own = samples[max(a, 0) : min(b, len(samples))]
    x[max(a, 0) - a :][: len(own)] = own.astype(np.float64) - 128
    return resample(x, up, down, h)[margin * up // down :][: stop - start]


def n_frames(n: int) -> int:
    return max(1, -(-(n - FRAME) // HOP) + 1)


def log_mel(samples: np.ndarray, rate: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (frames, bands) log10 mel energies and (frames,) log10 mean squares of 8-bit samples.

    Frames overlap by half; the last is filled with zeros. A block needs the samples under it and a margin, so a
    long text is never held as floats.
    """
    n, window, bank = -(-len(samples) * UP // DOWN), np.hanning(FRAME), mel_bank(rate)
    for at in range(0, n_frames(n), BLOCK):
        k = min(BLOCK, n_frames(n) - at)
        x = np.zeros((k - 1) * HOP + FRAME)
        part = resampled(samples, at * HOP, min(n, at * HOP + len(x)))
        x[: len(part)] = part
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * window)) ** 2
        yield np.log10(power @ bank + 1e-3), np.log10((frames * frames).mean(axis=1) + 1e-3)


def segments(energy: np.ndarray, opens: float = OPEN, closes: float = CLOSE, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Frames [a, b) in which energy rose over ``opens`` and has not yet fallen under ``closes``."""
    mark = np.where(energy >= opens, 1, np.where(energy < closes, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[np.maximum(last, 0)] == 1), [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= shortest]


KIND = pa.fixed_shape_tensor(pa.float16(), [FRAMES, BANDS])
STORED = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("tensor", KIND)])


def tensor_batch(mel: np.ndarray, first: int, rate: float) -> pa.RecordBatch:
    """Frames from number ``first`` on as fixed-shape tensors with their time spans; the last is filled with the floor."""
    n = -(-len(mel) // FRAMES)
    blocks = np.full((n * FRAMES, mel.shape[1]), FLOOR, np.float16)
    blocks[: len(mel)] = mel
    starts = first + np.arange(n) * FRAMES
    held = np.minimum(FRAMES, first + len(mel) - starts)
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(blocks.reshape(n, FRAMES, mel.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(starts * HOP / rate), pa.array(((starts + held - 1) * HOP + FRAME) / rate), column], schema=STORED)


def features_of(media: bytes) -> tuple[np.ndarray, bytes, list[tuple[float, float]]]:
    """Samples, the tensors with their spans as an Arrow stream, and segments in seconds."""
    rate, samples = read_wav(media)
    own, first, energies, sink = rate * UP / DOWN, 0, [], pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STORED) as out:
        for mel, energy in log_mel(samples, own):
            out.write_batch(tensor_batch(mel, first, own))
            energies.append(energy)
            first += len(mel)
    spans = [(a * HOP / own, ((b - 1) * HOP + FRAME) / own) for a, b in segments(np.concatenate(energies))]
    return samples, sink.getvalue().to_pybytes(), spans


def read_tensors(stored: bytes, rate: float = RATE * UP / DOWN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tensors, FRAMES, BANDS), frames held by each, and spans (tensors, 2), from the stored stream, without copying it."""
    table = pa.ipc.open_stream(pa.py_buffer(stored)).read_all()
    blocks = [c.to_numpy_ndarray() for c in table["tensor"].chunks]
    spans = np.stack([table["start_s"].to_numpy(), table["end_s"].to_numpy()], axis=1)
    held = np.rint(((spans[:, 1] - spans[:, 0]) * rate - FRAME) / HOP).astype(np.int64) + 1
    return blocks[0] if len(blocks) == 1 else np.concatenate(blocks), held, spans


def audio_features(media: DataFrame) -> DataFrame:
    """Every row of ``media`` with digests of its payload and bytes, its segments, and its tensors.

    ``tensors`` is an Arrow stream of fixed-shape tensors with start_s and end_s, which keeps their shape in any
    store; ``segments`` are the time spans in which the energy is on. Repeated rows are computed each; a null
    ``media`` is an error, as ``encode_media`` makes none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "media"):
            rows = []
            for data in chunk["media"].to_pylist():
                samples, stored, spans = features_of(data)
                payload = memoryview(samples)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), [{"start_s": a, "end_s": b} for a, b in spans], stored))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.binary())
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], chunk["n_bytes"], *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=NAMES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, segments array<struct<start_s:double,end_s:double>>, tensors binary")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "segments", "tensors"]


def feature_lines(audio: DataFrame) -> DataFrame:
    """``audio`` with ``feature``, a line from the stored tensors and segments: frames, tensors, segments and their
    seconds, mean band levels, and a crc of the tensors rounded to hundredths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "tensors"):
            lines = []
            for stored, spans in zip(chunk["tensors"].to_pylist(), chunk["segments"].to_pylist()):
                blocks, held, _ = read_tensors(stored)
                frames, total, crc = int(held.sum()), np.zeros(BANDS), 0
                for at in range(0, len(blocks), 512):
                    part = blocks[at : at + 512].astype(np.float32)
                    crc = zlib.crc32(np.rint(part * 100).astype("<i2").tobytes(), crc)
                    inside = np.arange(FRAMES)[None, :] < held[at : at + 512, None]
                    total += np.where(inside[:, :, None], part, 0).sum(axis=(0, 1), dtype=np.float64)
                seconds = sum(s["end_s"] - s["start_s"] for s in spans)
                levels = ",".join(f"{v:.2f}" for v in (total / frames)[::6])
                lines.append(f"frames={frames};tensors={len(blocks)}x{FRAMES}x{BANDS};segments={len(spans)};voiced_s={seconds:.3f};mel={levels};crc={crc:08x}")
            yield chunk.append_column("feature", pa.array(lines, pa.string()))

    return audio.mapInArrow(run, T.StructType([*audio.schema.fields, T.StructField("feature", T.StringType())]))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(encode_media(documents(spark, sf_dir)), "media")
    out = feature_lines(written(audio_features(stored), "audio-features"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments", "tensors")
