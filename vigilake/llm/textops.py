"""Vectorised word, hash and gram kernels over Arrow string batches.

All kernels work on the UTF-8 bytes of many texts at once, so a task handles
millions of words without a Python loop. ``slices`` bounds the bytes that are
expanded at a time; a text longer than the bound is handled alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTE_VALUE = [_RNG.integers(1, 1 << 63, 256, dtype=np.uint64) for _ in range(2)]
_BASE = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)]
_INVERSE = [_U(pow(int(b), -1, 1 << 64)) for b in _BASE]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(separators: bytes) -> np.ndarray:
    """1 for bytes that belong to a word, 0 for the separators."""
    out = np.ones(256, dtype=np.uint8)
    out[list(separators)] = 0
    return out


#: Words of ``[^\x20\x09-\x0D]+``.
SPACED = byte_class(b" \t\n\v\f\r")
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, to be applied to lower-cased bytes.
ALNUM = byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Lines.
LINES = byte_class(b"\n")
#: Maps A-Z to a-z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buffers[2], dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Spans:
    """Start and end byte of each word; ``first[i]:first[i + 1]`` are those of text i."""

    __slots__ = ("starts", "ends", "first")

    def __init__(self, buf: np.ndarray, off: np.ndarray, klass: np.ndarray):
        if not len(buf):
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(off), np.int64)
            return
        inside = klass[buf]
        before = np.empty_like(inside)
        before[0], before[1:] = 0, inside[:-1]
        before[off[:-1][off[:-1] < len(buf)]] = 0
        self.starts = np.flatnonzero(inside > before)
        after = np.empty_like(inside)
        after[-1], after[:-1] = 0, inside[1:]
        after[off[1:][off[1:] > 0] - 1] = 0
        self.ends = np.flatnonzero(inside > after) + 1
        self.first = np.searchsorted(self.starts, off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def word_array(buf: np.ndarray, spans: Spans, klass: np.ndarray) -> pa.StringArray:
    """The words themselves; their bytes, under 2 GB, are those that klass marks."""
    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(spans.ends - spans.starts, dtype=np.int32)))
    return pa.StringArray.from_buffers(len(spans.starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf[klass[buf] > 0])))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads entropy over all 64 bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        made = []
        for base in (_BASE[which], _INVERSE[which]):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, out=x))
        have = (made[0], made[1])
        if size <= 4 * SLICE_BYTES:
            _POWERS[which] = have
    return have


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands."""
    power, inverse = _powers(len(buf) + 1, which)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[which][buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _U(0x94D049BB133111EB))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, text borders ignored."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (k * 0x8CB92BA72F3D8DD7) % (1 << 64), np.uint64)
    for j in range(k):
        out = out * _U(0xFF51AFD7ED558CCD) + h[j : j + n]
    return mix(out)


def gram_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text its sorted distinct k-gram hashes.

    A text of fewer than k words, but not none, has its whole sequence as its
    one gram; a text without words has an empty set.
    """
    all_grams, out = grams(h, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(all_grams[a : b - k + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif b > a:
            out.append(grams(h[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def per_text(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of marks over the words of each text."""
    sums = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return sums[first[1:]] - sums[first[:-1]]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
