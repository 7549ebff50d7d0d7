"""Media columns: 8-bit audio, its log-mel features as fixed-shape Arrow tensors, and its loud segments.

`to_wav` stores bytes as 8-bit mono PCM in a WAV container, losslessly. `audio_features` reads the stored bytes
back, resamples them from `RATE` by UP / DOWN with a polyphase filter, takes overlapped windows of `WINDOW`
samples every `HOP`, and gives the logarithm of `MELS` mel bands for each. `TENSOR` frames at a time become
one tensor of fixed shape (TENSOR, MELS) with the time span that it covers; the last is filled up with the
floor value. Segments are the spans in which the energy rises above `HIGH` decibels over the median and
hasn't yet fallen below `LOW`.

Defined results: a null payload is an empty one; an empty payload still holds 64 zero bytes, so every row has audio and at
least one tensor. Equal bytes give equal results, whatever else is in the batch. A container that isn't
8-bit mono PCM raises ValueError. Long payloads are worked on `BLOCK` frames at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradloom.llm._shared import small_batches

RATE = 16000
UP, DOWN, TAPS = 3, 4, 8
WINDOW, HOP, FFT, MELS = 300, 120, 512, 32
TENSOR = 64
HIGH, LOW = 3.0, 1.0
BLOCK = 2048
FLOOR = -23.0
UNIT = 64
#: Bytes of payload whose results go to Spark at once.
BATCH = 4 << 20


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of UNIT."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """payload as the samples of a WAV file."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def from_wav(stored: bytes) -> tuple[int, bytes]:
    """(sample rate, samples) of a WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(stored):
        kind, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _bank() -> np.ndarray:
    """The low-pass filter as UP rows of TAPS coefficients, each row one phase."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    cutoff = 1.0 / max(UP, DOWN)
    h = cutoff * np.sinc(cutoff * n) * np.hamming(UP * TAPS) * UP
    return h.reshape(TAPS, UP).T.astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """x at UP / DOWN times its rate: output n is phase n * DOWN % UP over the TAPS inputs up to n * DOWN // UP."""
    count = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN + TAPS, np.float32)])
    out = np.zeros(-(-count // UP) * UP, np.float32)
    per = len(out) // UP
    for n in range(UP):  # outputs n, n + UP, ... are DOWN inputs apart
        first, h = n * DOWN // UP, _bank()[n * DOWN % UP]
        y = np.zeros(per, np.float32)
        for t in range(TAPS):
            part = padded[first + TAPS - 1 - t :: DOWN][:per]
            y[: len(part)] += h[t] * part
        out[n::UP] = y
    return out[:count]


@cache
def _mel() -> np.ndarray:
    """FFT bins x MELS triangular filters, evenly spaced in mel up to half the new rate."""
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(20.0), mel(top), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FFT // 2 + 1)[:, None]
    up, down = (f - points[:-2]) / (points[1:-1] - points[:-2]), (points[2:] - f) / (points[2:] - points[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@cache
def _window() -> np.ndarray:
    return np.hanning(WINDOW).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS, energy of each frame in decibels), one frame at least."""
    n = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    x = np.concatenate([x, np.zeros((n - 1) * HOP + WINDOW - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    mels, energy = [], []
    for a in range(0, n, BLOCK):
        part = frames[a : a + BLOCK]
        spectrum = np.fft.rfft(part * _window(), FFT, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log(power @ _mel() + np.float32(1e-10)))
        energy.append(10 * np.log10((part.astype(np.float64) ** 2).mean(1) + 1e-10))
    return np.vstack(mels), np.concatenate(energy)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Spans of frames that begin at HIGH over the median and last until the energy falls below LOW over it."""
    base = np.median(energy)
    mark = np.where(energy >= base + HIGH, 1, np.where(energy < base + LOW, 0, -1))
    at = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(at >= 0, mark[at] == 1, False)
    change = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray, frame_s: float) -> pa.RecordBatch:
    """Rows of (start_s, end_s, log_mel), log_mel of fixed shape (TENSOR, MELS)."""
    n = -(-len(mel) // TENSOR)
    whole = np.full((n * TENSOR, MELS), FLOOR, np.float32)
    whole[: len(mel)] = np.round(mel, 2)
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR, MELS))
    values = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), TENSOR * MELS))
    first = np.arange(n) * TENSOR
    return pa.RecordBatch.from_arrays([pa.array(first * frame_s), pa.array(np.minimum(first + TENSOR, len(mel)) * frame_s), values], ["start_s", "end_s", "log_mel"])


def analyse(stored: bytes) -> tuple[bytes, list[tuple[float, float]]]:
    """(Arrow IPC stream of tensors(), loud spans in seconds) of a WAV file."""
    rate, payload = from_wav(stored)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    frame_s = HOP * DOWN / UP / rate
    mel, energy = log_mel(resample(x))
    batch = tensors(mel, frame_s)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes(), [(a * frame_s, b * frame_s) for a, b in segments(energy)]


def _flush(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _in_batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= BATCH or len(held) >= 2000:
            yield _flush(held, schema)
            held, size = [], 0
    yield _flush(held, schema)


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text's UTF-8 bytes, padded, as a WAV file."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("media", pa.binary())])

            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple[dict, int]]:
                for k, v in zip(batch.column(0), batch.column(1), strict=True):
                    data = v.as_buffer().to_pybytes() if v.is_valid else b""
                    yield {"key": k.as_py(), "n_bytes": len(data), "media": to_wav(pad(data))}, len(data)

            yield from _in_batches(rows(), schema)

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return out.mapInArrow(run, f"key {id_type.simpleString()}, n_bytes long, media binary").withColumnRenamed("key", key)


def audio_features(media: DataFrame, key: str = "doc_id", column: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, media, tensors, spans): the Arrow IPC stream of the features and the loud spans, for each stored file."""
    small_batches(media.sparkSession)
    shape = media.select(key, *keep, column).schema.add("tensors", "binary").add("spans", T.ArrayType(T.StructType().add("start_s", "double").add("end_s", "double")))
    return media.select(key, *keep, column).mapInArrow(_analysed(len(keep) + 1), shape)


def _analysed(at: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for batch in batches:
            step, a = [], 0
            names = [*batch.schema.names, "tensors", "spans"]
            for i, v in enumerate(batch.column(at)):
                step.append(analyse(v.as_py()) if v.is_valid else (None, None))
                if sum(len(t or b"") for t, _ in step[-1:]) + (i - a) * 4096 >= BATCH or i + 1 == batch.num_rows:
                    part = batch.slice(a, i + 1 - a)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t for t, _ in step], pa.binary()), pa.array([None if s is None else [{"start_s": x, "end_s": y} for x, y in s] for _, s in step], span)], names)
                    step, a = [], i + 1

    return run


def digests(features: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """(key, keep, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of audio_features(), all from the stored bytes."""
    schema = features.select(key, *keep).schema
    for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    n = 1 + len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored, tensor, spans in zip(batch.column(n), batch.column(n + 1), batch.column(n + 2), strict=True):
                media = stored.as_py()
                payload = from_wav(media)[1]
                table = pa.ipc.open_stream(tensor.as_buffer()).read_all()
                mel = table["log_mel"].combine_chunks()
                mel = mel.chunk(0) if isinstance(mel, pa.ChunkedArray) else mel
                values = mel.storage.flatten().to_numpy()
                loud = sum(s["end_s"] - s["start_s"] for s in spans.as_py())
                feature = f"tensors={len(table)}x{TENSOR}x{MELS} seconds={table['end_s'][-1].as_py():.4f} spans={len(spans)} loud={loud:.4f} mean={float(values.mean(dtype=np.float64)):.3f} crc32={zlib.crc32(values.astype('<f4').tobytes()):08x}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], schema.fieldNames())

    return features.select(key, *keep, "media", "tensors", "spans").mapInArrow(run, schema)
