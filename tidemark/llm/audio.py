"""Audio features: resampling, log-mel windows as fixed-shape Arrow tensors, and energy segments."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payloads are padded with blanks to a positive multiple of this.
UNIT = 192
#: Frames that are computed at once; bounds memory for long clips.
AT_ONCE = 2048


@dataclass(frozen=True)
class Settings:
    rate: int = 16000  # of the stored samples
    target: int = 8000  # after resampling
    taps: int = 12  # of the resampling filter, to each side, per phase
    frame: int = 200
    hop: int = 80
    fft: int = 256
    mels: int = 32
    window: int = 64  # frames in a tensor
    on_db: float = -18.0  # a segment begins at this frame energy
    off_db: float = -24.0  # and lasts until the energy is below this
    least: int = 5  # frames of a segment


def payload(text: str | None) -> bytes:
    """UTF-8 with blanks appended up to a positive multiple of UNIT bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * ((-len(data)) % UNIT if data else UNIT)


def to_wav(data: bytes, rate: int) -> bytes:
    """One channel of unsigned 8-bit samples as a RIFF file; a sample is a byte, so nothing is lost."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(data))
    return head + data


def from_wav(media: bytes) -> bytes:
    """The samples of a file as to_wav writes it, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


class Analyzer:
    """Filters and tables for one setting."""

    def __init__(self, s: Settings) -> None:
        self.s = s
        g = np.gcd(s.rate, s.target)
        self.up, self.down = s.target // g, s.rate // g
        half = s.taps * max(self.up, self.down)
        t = np.arange(-half, half + 1)
        cutoff = 1 / max(self.up, self.down)
        self.filter = (np.sinc(t * cutoff) * cutoff * self.up * np.kaiser(len(t), 8.0)).astype(np.float32)
        self.half = half
        self.hann = np.hanning(s.frame).astype(np.float32)
        edges = self._from_mel(np.linspace(0, self._to_mel(s.target / 2), s.mels + 2))
        f = np.fft.rfftfreq(s.fft, 1 / s.target)
        rise, fall = ((f[:, None] - edges[None, :-2]) / np.diff(edges)[None, :-1], (edges[None, 2:] - f[:, None]) / np.diff(edges)[None, 1:])
        self.bank = np.maximum(0, np.minimum(rise, fall))
        self.tensor = pa.fixed_shape_tensor(pa.float32(), [s.window, s.mels], dim_names=["frame", "mel"])

    @staticmethod
    def _to_mel(hz: float) -> float:
        return 2595 * np.log10(1 + hz / 700)

    @staticmethod
    def _from_mel(mel: np.ndarray) -> np.ndarray:
        return 700 * (10 ** (mel / 2595) - 1)

    def resampled(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """Resampled signal from place first to last, by polyphase branches; outside x is silence.

        Place m stands at m * down / up of x; a branch holds every up-th tap of the filter.
        """
        out = np.zeros(last - first, np.float32)
        low = (first * self.down - self.half) // self.up - 1
        high = (last * self.down + self.half) // self.up + 2
        part = np.zeros(high - low, np.float32)
        a, b = max(0, low), min(len(x), high)
        if a < b:
            part[a - low : b - low] = (x[a:b].astype(np.float32) - 128) / 128
        for phase in range(self.up):
            m = np.arange(first + (phase - first) % self.up, last, self.up)
            if not len(m):
                continue
            base, shift = divmod(int(m[0]) * self.down, self.up)
            own = np.zeros(len(m), np.float32)
            # taps at shift + k * up: k counts samples back from the place
            for k in range(-((self.half + shift) // self.up), (self.half - shift) // self.up + 1):
                at = base - k - low
                own += self.filter[self.half + shift + k * self.up] * part[at : at + (len(m) - 1) * self.down + 1 : self.down]
            out[int(m[0]) - first :: self.up] = own
        return out

    def frames(self, samples: int) -> int:
        """Frames that hold every sample; the last one may reach into the silence behind them."""
        n = -(-samples * self.up // self.down)
        return 1 + -(-max(0, n - self.s.frame) // self.s.hop)

    def run(self, data: bytes) -> tuple[bytes, str, int, list[tuple[int, int]]]:
        """(tensors as an Arrow stream, their digest, frames, energy segments as frame spans) of the samples.

        Each row of the stream holds start, end (seconds) and a window of log-mel frames; the
        last window is filled up with the floor. The digest is of the values in thousandths: they
        are worked out in double precision, so that the last bits, in which machines differ, don't show.
        """
        s, x = self.s, np.frombuffer(data, np.uint8)
        total = self.frames(len(x))
        floor = np.float32(np.log(1e-6))
        sink, energy, digest = io.BytesIO(), [], hashlib.sha256()
        schema = pa.schema([("start", pa.float64()), ("end", pa.float64()), ("mel", self.tensor)])
        with pa.ipc.new_stream(sink, schema) as stream:
            for f in range(0, total, AT_ONCE):
                n = min(AT_ONCE, total - f)
                y = self.resampled(x, f * s.hop, (f + n - 1) * s.hop + s.frame)
                cut = np.lib.stride_tricks.sliding_window_view(y, s.frame)[:: s.hop]
                cut = cut - cut.mean(axis=1, keepdims=True)
                energy.append(10 * np.log10(np.mean(cut * cut, axis=1) + 1e-9))
                power = np.abs(np.fft.rfft(cut.astype(np.float64) * self.hann, s.fft)) ** 2
                mel = np.log(power @ self.bank + 1e-6)
                digest.update(np.rint(mel * 1000).astype("<i4").tobytes())
                rows = -(-n // s.window)
                full = np.full((rows * s.window, s.mels), floor, np.float32)
                full[:n] = mel
                start = (f + np.arange(rows) * s.window) * s.hop / s.target
                end = (np.minimum(f + (np.arange(rows) + 1) * s.window, total) - 1) * s.hop / s.target + s.frame / s.target
                cells = pa.ExtensionArray.from_storage(self.tensor, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), s.window * s.mels))
                stream.write_batch(pa.record_batch([pa.array(start), pa.array(end), cells], schema=schema))
        return sink.getvalue(), digest.hexdigest(), total, self.segments(np.concatenate(energy))

    def segments(self, energy: np.ndarray) -> list[tuple[int, int]]:
        """[begin, end) of runs that begin at on_db or more and last while the energy is off_db or more."""
        mark = np.where(energy >= self.s.on_db, 1, np.where(energy < self.s.off_db, 0, -1))
        known = np.where(mark >= 0, np.arange(len(mark)), -1)
        np.maximum.accumulate(known, out=known)
        on = np.where(known >= 0, mark[np.maximum(known, 0)], 0) == 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= self.s.least]


_COLUMNS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(), "tensors": pa.binary()}


def audio_features(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("media", "tensors")) -> DataFrame:
    """Each text as a sound file, and the features of what is read back from it.

    doc_id, n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of its last 16
    bytes), media_bytes and media_sha256 (of the file), feature (frames, a digest of the
    tensors, spans of the segments in frames) and, where kept, the file itself and the tensors:
    an Arrow stream of start, end and a fixed-shape tensor of window by mels. Null texts are empty, and an empty
    text has one unit of blanks. Rows stay where they are; long clips are computed in parts.
    """
    names = [c for c in _COLUMNS if c not in ("media", "tensors") or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyzer = Analyzer(settings)
        for b in batches:
            at, held, rows = 0, 0, []
            for i, text in enumerate(b.column("text")):
                text = text.as_py()
                data = payload(text)
                media = to_wav(data, settings.rate)
                back = from_wav(media)
                tensors, digest, frames, spans = analyzer.run(back)
                feature = f"{frames};{digest};" + ",".join(f"{x}-{y}" for x, y in spans)
                rows.append({"n_bytes": len((text or "").encode("utf-8", "surrogatepass")), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "media": media, "tensors": tensors})
                held += len(media) + len(tensors)
                if held > 1 << 24 or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(rows)), *[pa.array([r[c] for r in rows], _COLUMNS[c]) for c in names]], ["doc_id", *names])
                    at, held, rows = i + 1, 0, []

    sql = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    schema = "doc_id long, " + ", ".join(f"{c} {sql[_COLUMNS[c]]}" for c in names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
