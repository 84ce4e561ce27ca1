"""WAV media columns and spectral-peak fingerprints.

A payload is stored as 8-bit mono samples of a WAV file in a binary column, written and read by the wave module. Spectra are
short-time Fourier transforms (Hann window of 192 samples, step 96); peaks are the bins that exceed their neighbours in time
and frequency, the strongest five of a frame; each peak is paired with the next peaks of up to 32 frames later. A pair is one
64-bit code: frame, then both frequencies, then the distance; codes ascend with time, so that the array is time-coded.

Text payloads: the UTF-8 bytes of the whole text, filled with blanks to a positive multiple of 192. Nulls: a null text is an
empty one, whose payload is 192 blanks. Equal texts give equal media and fingerprints. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_of

UNIT = 192
RATE = 8000
FRAME, STEP = 192, 96
PEAKS = 5
FAN_OUT = 3
REACH = 32
FRAMES_AT_ONCE = 4096

_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b" ")


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of an 8-bit mono file."""
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are asked for")
        return r.readframes(r.getnframes()), r.getframerate()


def spectrum(samples: bytes, first: int, last: int) -> np.ndarray:
    """Magnitudes of the frames first to last, whole numbers, so that rounding decides no comparison."""
    x = np.frombuffer(samples, np.uint8)[first * STEP : (last - 1) * STEP + FRAME].astype(np.float32) - np.float32(128)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::STEP] * _WINDOW
    return np.rint(np.abs(np.fft.rfft(frames, axis=1))).astype(np.int32)


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, in the order of time and then frequency."""
    total = 1 + (len(samples) - FRAME) // STEP if len(samples) >= FRAME else 0
    times, bins = [], []
    for start in range(0, total, FRAMES_AT_ONCE):
        stop = min(total, start + FRAMES_AT_ONCE)
        lo, hi = max(0, start - 1), min(total, stop + 1)  # neighbours in time
        m = spectrum(samples, lo, hi)
        p = np.pad(m, 1, constant_values=-1)
        top = (m > p[1:-1, :-2]) & (m >= p[1:-1, 2:]) & (m > p[:-2, 1:-1]) & (m >= p[2:, 1:-1])
        top[:, 0] = False  # the constant part
        top, m = top[start - lo : stop - lo], m[start - lo : stop - lo]
        t, f = np.nonzero(top)
        if len(t):
            order = np.lexsort((f, -m[t, f], t))
            t, f = t[order], f[order]
            first = np.r_[True, t[1:] != t[:-1]]
            place = np.arange(len(t)) - np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
            t, f = t[place < PEAKS], f[place < PEAKS]
            order = np.lexsort((f, t))
            times.append(t[order] + start)
            bins.append(f[order])
    if not times:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(times).astype(np.int64), np.concatenate(bins).astype(np.int64)


def fingerprint(samples: bytes) -> np.ndarray:
    """Ascending codes: frame << 24 | first bin << 16 | second bin << 8 | frames between."""
    t, f = peaks(samples)
    if not len(t):
        return np.empty(0, np.int64)
    nxt = np.searchsorted(t, t, "right")  # the first peak of a later frame
    codes = []
    for k in range(FAN_OUT):
        j = nxt + k
        ok = np.flatnonzero(j < len(t))
        i, j = ok, j[ok]
        gap = t[j] - t[i]
        near = gap <= REACH
        i, j, gap = i[near], j[near], gap[near]
        codes.append(t[i] << 24 | f[i] << 16 | f[j] << 8 | gap)
    return np.unique(np.concatenate(codes))


def encode_wav(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes of the unpadded text, and media, the WAV file of its payload."""

    def run(b: dict) -> dict:
        texts = b["__text"].to_pylist()
        return {"key": b["__key"], "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "media": [to_wav(payload(x)) for x in texts]}

    frame = docs.select(F.col(f"`{key}`").cast("long").alias("__key"), text_of(text).alias("__text"))
    return map_batches(frame, run, "key long, n_bytes long, media binary").withColumnRenamed("key", key)


def fingerprints(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """key and codes, the time-coded array of each media value; a null media value has no code."""

    def run(b: dict) -> dict:
        return {"key": b["__key"], "codes": [fingerprint(from_wav(m)[0]) if m is not None else [] for m in b["__media"].to_pylist()]}

    frame = media.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{column}`").alias("__media"))
    return map_batches(frame, run, "key long, codes array<long>").withColumnRenamed("key", key)


def digests(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """What is read back from each stored value of encode_wav, the time-coded array of its peak pairs, and a feature string:
    number and checksum of the codes."""

    def run(b: dict) -> dict:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        out: dict[str, Any] = {c: [] for c in names}
        arrays = [np.empty(0, np.int64)]
        for m in b["media"].to_pylist():
            samples, _ = from_wav(m)
            codes = fingerprint(samples)
            out["payload_bytes"].append(len(samples))
            out["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
            out["tail_crc32"].append(zlib.crc32(samples[-16:]))
            out["media_bytes"].append(len(m))
            out["media_sha256"].append(hashlib.sha256(m).hexdigest())
            out["feature"].append(f"{len(codes)}:{hashlib.sha256(codes.astype('<i8').tobytes()).hexdigest()[:32]}")
            arrays.append(codes)
        ends = np.cumsum([len(a) for a in arrays], dtype=np.int32)
        out["codes"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))
        return {"key": b["key"], "n_bytes": b["n_bytes"]} | out

    schema = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codes array<long>"
    frame = media.select(F.col(f"`{key}`").cast("long").alias("key"), "n_bytes", F.col(f"`{column}`").alias("media"))
    return map_batches(frame, run, schema).withColumnRenamed("key", key)
