"""Media columns: WAV bytes in a binary column, read with ``wave``, and spectral-peak fingerprints.

A fingerprint is a pair of peaks of the short-time Fourier transform: two frequency bins and
the frames between them.  A recording's fingerprints are stored as two equally long arrays,
``fp_time`` (frame of the first peak) and ``fp_hash`` (the pair), ordered by time, so that two
recordings can be matched by equal hashes at a constant time difference.

Frames are read in blocks, so memory doesn't grow with a recording.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.shared import frugal

#: Payload unit in bytes; payloads are padded with ``PAD`` to a positive multiple of it.
UNIT, PAD = 576, b"\xff"
RATE = 8000
FRAME, HOP, BLOCK = 1024, 512, 512
#: Edges of the frequency bands; each frame offers its strongest bin of each band.
BANDS = (1, 10, 20, 40, 80, 160, FRAME // 2 + 1)
#: Peaks paired with each peak, and the most frames between them.
FAN_OUT, REACH = 3, 63
_HANN = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | bytes | None) -> bytes:
    """The text's UTF-8 bytes, padded to a positive multiple of ``UNIT``; null counts as empty."""
    raw = text if isinstance(text, bytes) else (text or "").encode()
    return raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wav(payload: bytes) -> bytes:
    """A mono recording whose 8-bit samples are exactly ``payload``."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """All samples of a mono 8-bit recording."""
    with wave.open(io.BytesIO(media)) as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("a mono recording of 8-bit samples is expected")
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of spectral peaks, in order.

    A peak is the strongest bin of its band, above the frame's mean power, and at least as
    strong as that band's strongest bin in both neighbouring frames.  Silence fills the last frame.
    """
    x = np.frombuffer(samples, dtype=np.uint8)
    n = max(0, -(-(len(x) - FRAME) // HOP)) + 1
    if (short := (n - 1) * HOP + FRAME - len(x)) > 0:
        x = np.concatenate([x, np.full(short, 128, np.uint8)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lo in range(0, n, BLOCK):
        a, b = max(0, lo - 1), min(n, lo + BLOCK + 1)
        part = x[a * HOP : (b - 1) * HOP + FRAME].astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * _HANN
        spectrum = np.fft.rfft(frames, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        floor = power[:, 1:].mean(axis=1)
        bins = np.stack([power[:, i:j].argmax(axis=1) + i for i, j in zip(BANDS, BANDS[1:])], axis=1)
        top = np.take_along_axis(power, bins, axis=1)
        keep = top > floor[:, None]
        keep[1:] &= top[1:] >= top[:-1]
        keep[:-1] &= top[:-1] >= top[1:]
        keep = keep[lo - a : lo - a + min(BLOCK, n - lo)]
        t, band = np.nonzero(keep)
        found.append((t + lo, bins[lo - a :][t, band]))
    return np.concatenate([t for t, _ in found]), np.concatenate([b for _, b in found])


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(fp_time, fp_hash, number of peaks) of a recording's samples."""
    t, f = peaks(samples)
    times, hashes = [], []
    for step in range(1, FAN_OUT + 1):
        if len(t) <= step:
            break
        dt = t[step:] - t[:-step]
        ok = dt <= REACH
        times.append(t[:-step][ok])
        hashes.append((f[:-step][ok] << 16) | (f[step:][ok] << 6) | dt[ok])
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), len(t)
    at, what = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((what, at))
    return at[order].astype(np.int32), what[order].astype(np.int32), len(t)


def feature_of(at: np.ndarray, what: np.ndarray, n_peaks: int) -> str:
    digest = hashlib.sha256(at.astype("<i4").tobytes() + what.astype("<i4").tobytes()).hexdigest()
    return f"{n_peaks}:{len(at)}:{digest[:32]}"


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, fp_time array<int>, fp_hash array<int>"
)
WAV_SCHEMA = "doc_id long, n_bytes long, media binary"


def wav_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One recording (``media``) for each row: the text's payload as samples.

    Null or empty text: one unit of padding.  Repeated rows give repeated rows, a null key stays
    null, other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = [(x.as_py() or "").encode() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(payload_of(x)) for x in raw], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select(key, text).mapInArrow(frugal(run), WAV_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Digests, spectral-peak pair fingerprints and their summary of each row of ``wav_columns``.

    A null recording counts as one unit of padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                for doc, n, stored in zip(*(part.column(i).to_pylist() for i in range(3))):
                    stored = to_wav(payload_of(b"")) if stored is None else stored
                    back = from_wav(stored)
                    at, what, n_peaks = fingerprints(back)
                    rows.append(
                        (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(at, what, n_peaks), at, what)
                    )
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return media.mapInArrow(frugal(run), MEDIA_SCHEMA)
