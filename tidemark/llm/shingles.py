"""Hashes of word shingles, computed for many texts at once from their UTF-8 bytes."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is hashed alone, in slices of this size.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no trace of sums or products."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word reaches from one text into the next."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def slices(data: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Spans of about `size` bytes that part no word; a longer word is in one span."""
    a = 0
    while a < len(data):
        b = min(a + size, len(data))
        while b < len(data) and not (gap := np.flatnonzero(_SPACE[data[b : b + size]])[:1]).size:
            b = min(b + size, len(data))
        if b < len(data):
            b += int(gap[0])
        yield a, b
        a = b


#: The low n bytes of a lane of 8.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Runs of more bytes than this are hashed one at a time.
LONG = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: bytes) -> np.ndarray:
    """64-bit hashes of runs of bytes: 8 bytes at a time are mixed in, for all runs at once; long ones by BLAKE2b.

    Whoever doesn't know the key (16 bytes) can't choose runs that collide.
    """
    first, last = np.frombuffer(key, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    n = end - start
    out = mix((first ^ n.astype(np.uint64) * _STEP) ^ (lanes[start] & _LOW[np.minimum(n, 8)]))
    more, at = np.flatnonzero(n > 8), 8
    while len(more) and at < LONG:
        out[more] = mix(out[more] ^ (lanes[start[more] + at] & _LOW[np.minimum(n[more] - at, 8)]))
        at += 8
        more = more[n[more] > at]
    for i in more.tolist():
        out[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key).digest(), np.uint64)[0]
    return mix(out ^ last)


class Hasher:
    """Keyed word and shingle hashes of whole buffers; all who are to agree need one key."""

    def __init__(self, width: int = 5, key: bytes = bytes(range(16)), fold: bool = True) -> None:
        self.width, self.key, self.fold = width, key, fold
        # odd factors, one for each place in a shingle, and one mark for each shorter length
        self.places = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
        self.marks = mix(np.arange(100, 100 + width, dtype=np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, A-Z in lower case where fold is set, number of words before each text and after the last)."""
        if len(data) > 2 * CHUNK and len(offsets) == 2:
            parts = [self._words(data[a:b], np.array([0, b - a]))[0] for a, b in slices(data)]
            return np.concatenate(parts), np.array([0, sum(map(len, parts))])
        return self._words(data, offsets)

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = word_bounds(data, offsets)
        return hash_runs(LOWER[data] if self.fold else data, start, end, self.key), np.searchsorted(start, offsets)

    def _joined(self, word: np.ndarray) -> np.ndarray:
        """The hash of every run of `width` words."""
        out = np.empty(len(word) - self.width + 1, np.uint64)
        for a in range(0, len(out), CHUNK):
            part = word[a : a + CHUNK + self.width - 1]
            n = len(part) - self.width + 1
            total = part[:n] * self.places[0]
            for k in range(1, self.width):
                total += part[k : k + n] * self.places[k]
            out[a : a + n] = mix(total)
        return out

    def shingles(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text: of `width` words, or of all where there are fewer; none without words."""
        word, at = self.words(data, offsets)
        w = self.width
        full = self._joined(word) if len(word) >= w else word[:0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= w:
                s = full[a : b - w + 1]
                if len(at) == 2:
                    del word
                    s.sort()
                else:
                    s = np.sort(s)
                new = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            elif b > a:
                yield mix((word[a:b] * self.places[: b - a]).sum(dtype=np.uint64, keepdims=True) + self.marks[b - a : b - a + 1])
            else:
                yield np.empty(0, np.uint64)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first, bytes, offsets) of runs of texts of about CHUNK bytes; nulls count as empty."""
    row = 0
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(c):
            continue
        c = c.cast(pa.large_binary())
        if c.null_count:
            c = c.fill_null(b"")
        _, offs, buf = c.buffers()
        offs = np.frombuffer(offs, np.int64)[c.offset : c.offset + len(c) + 1]
        raw = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
        a = 0
        while a < len(c):
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + CHUNK, "right")) - 1)
            yield row + a, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            a = b
        row += len(c)
    give_back()


def give_back() -> None:
    """Returns memory that is free to the system: workers live on, and with them whatever they have held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another allocator than glibc's
        pass


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles; 0 for the empty set. Two sets share one with a chance of 2**-64."""
    if not len(shingles):
        return 0
    total = np.zeros(1, np.uint64)
    for a in range(0, len(shingles), CHUNK):
        total += mix(shingles[a : a + CHUNK] ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(mix(total + np.array([len(shingles)], np.uint64) * _STEP).view(np.int64)[0]) or 1
