"""Sliding spectral windows over sample blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.media import with_first
from .groups import by_key

_SCHEMA = "recording_id string, time double, dominant_freq double, concentration double, rms double"
#: Windows that one task's group holds, and how many are transformed at once.
SPAN, AT_ONCE = 1024, 256


def _joined(part: pa.Table, begin: int, end: int) -> np.ndarray:
    """Samples begin to end of the blocks in part, which are in order, cut where they end."""
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part.column("samples").chunks])
    at = part.column("first")[0].as_py()
    return x[max(0, begin - at) : end - at].astype(np.float64) / 32768.0


def spectral_windows(blocks: DataFrame, rate: int = 22050, window: float = 0.5, hop: float = 0.25, low: float = 300.0, high: float = 8000.0) -> DataFrame:
    """recording_id, time, dominant_freq, concentration, rms of pcm_blocks (recording_id, block, samples ARRAY<SMALLINT>).

    A window of `window` seconds (256 samples at least) every `hop` seconds; none for what is
    left at the end. Each is weighted (Hann); concentration is the magnitude in the
    peak bin and two on either side over that of the band, 0 with frequency 0 where the band is
    silent. Blocks of a recording may be of any length, one after the other.

    Windows are dealt out SPAN to a group, with the blocks that they reach into, so a long recording is
    many tasks; only blocks at a group's edge are sent twice.
    """
    size, step = max(int(window * rate), 256), max(int(hop * rate), 1)
    weights, freq = np.hanning(size), np.fft.rfftfreq(size, 1 / rate)
    band = np.flatnonzero((freq >= low) & (freq <= high))
    span = SPAN * step

    def measured(chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(frequency, concentration, rms) of each row."""
        magnitude = np.abs(np.fft.rfft(chunks * weights, axis=1))[:, band]
        total, rms = magnitude.sum(axis=1), np.sqrt((chunks * chunks).mean(axis=1))
        peak = magnitude.argmax(axis=1) if len(band) else np.zeros(len(chunks), np.int64)
        near = sum((np.take_along_axis(magnitude, np.clip(peak + k, 0, len(band) - 1)[:, None], 1)[:, 0] * ((peak + k >= 0) & (peak + k < len(band))) for k in range(-2, 3)), np.zeros(len(chunks))) if len(band) else total
        live = total > 1e-9
        return np.where(live, freq[band][peak] if len(band) else 0.0, 0.0), np.where(live, near / np.where(live, total, 1), 0.0), rms

    def run(key: tuple, part: pa.Table) -> pa.RecordBatch:
        begin = key[1] * span
        x = _joined(part, begin, begin + span - step + size)
        every = np.lib.stride_tricks.sliding_window_view(x, size)[::step] if len(x) >= size and part.column("first")[0].as_py() <= begin else np.empty((0, size))
        found = [measured(every[a : a + AT_ONCE]) for a in range(0, len(every), AT_ONCE)]
        f, c, rms = (np.concatenate([m[k] for m in found]) if found else np.empty(0) for k in range(3))
        who = pa.array([key[0]] * len(f), pa.string())
        return pa.RecordBatch.from_arrays([who, *(pa.array(x, pa.float64()) for x in ((begin + np.arange(len(f)) * step) / rate, f, c, rms))], ["recording_id", "time", "dominant_freq", "concentration", "rms"])

    d = with_first(blocks).where(F.size("samples") > 0).select(F.col("recording_id").cast("string"), F.col("first").cast("long"), "samples")
    # group g has the windows that begin in [g * span, (g + 1) * span), which end size - step samples beyond at most
    earliest = F.greatest(F.lit(0), F.floor((F.col("first") - (size - step)) / span))
    latest = F.floor((F.col("first") + F.size("samples") - 1) / span)
    dealt = d.withColumn("group", F.explode(F.sequence(earliest, F.greatest(earliest, latest))))
    return by_key(dealt, ["recording_id", "group"], ["first"], run, _SCHEMA)
