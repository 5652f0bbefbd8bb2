"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes: h = (h << 2) + G[byte], kept to 32 bits, so
it depends on the last 16 bytes alone. A chunk ends behind a white-space byte
where the hash's top bits are zero, at ``least`` bytes or later, and at the
first white space behind ``most`` bytes in any case. In a run of more than
``most`` bytes without white space, as in Chinese, Japanese or minified code, it
ends behind any character where ``_RUN_BITS`` more bits are zero, and behind the
first one at ``most`` bytes in any case. Boundaries depend on the content near them, so an insertion moves
only the chunks it touches. Chunks are compared by a 128-bit digest; all but
the first, by (doc_id, position), are repeats. A run of neighbouring repeats is
cut out if it has ``min_run`` bytes at least, so short stock phrases stay.

Defined cases: a null text stays null; an empty text has no chunks; a repeated
row (same doc_id and text) is one occurrence, a repeated doc_id with another
text is a document of its own; a row without doc_id is kept whole; an empty
table gives an empty one. Other columns are kept, but for n_chunks, n_seen,
n_repeated and n_cut_bytes, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Units, later_occurrences, rewritten
from .textops import SPACED, span_hashes, texts_of

LEAST, MOST, MASK_BITS, MIN_RUN = 24, 256, 2, 120
#: A run has a cut for each byte, not for each word.
_RUN_BITS = 3

_GEAR = np.random.Generator(np.random.PCG64(8)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte, by doubling the window: 1, 2, 4, 8, 16 bytes."""
    h = _GEAR[buf]
    for width in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[width:] = h[:-width] << np.uint32(2 * width)
        h = h + older
    return h


def chunk_ends(buf: np.ndarray, off: np.ndarray, least: int = LEAST, most: int = MOST, mask_bits: int = MASK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """End of each chunk and the text it belongs to. A text's first 16 bytes hash as if the text before it went on, so no cut is taken there."""
    white = SPACED[buf] == 0
    h = gear(buf, off)
    cut = white & (h >> np.uint32(32 - mask_bits) == 0)
    borders = np.union1d(np.append(off, 0), np.flatnonzero(white) + 1)
    gaps = np.diff(borders)
    stop = white
    if (gaps > most).any():
        inner = np.repeat(gaps > most, gaps)
        inner[:-1] &= buf[1 : len(inner)] & 0xC0 != 0x80  # behind a character's last byte
        stop = white | inner
        cut |= inner & (h >> np.uint32(32 - mask_bits - _RUN_BITS) == 0)
    cuts = np.flatnonzero(cut) + 1
    spaces = np.flatnonzero(stop) + 1
    ends, owner = [], []
    at = np.searchsorted(cuts, off).tolist()
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if a == b:
            continue
        start, n = a, len(ends)
        for c in [*cuts[at[k] : at[k + 1]].tolist(), b]:
            while c - start > most:
                j = int(np.searchsorted(spaces, start + most))
                if j >= len(spaces) or spaces[j] >= c:
                    break
                start = int(spaces[j])
                ends.append(start)
            if c - start >= least and c - a >= 16 or c == b:
                if c > start:
                    ends.append(c)
                start = c
        owner += [k] * (len(ends) - n)
    return np.array(ends, np.int64), np.array(owner, np.int64)


def _chunks(least: int, most: int, mask_bits: int):
    def units(column: pa.Array) -> Units:
        buf, off = texts_of(column)
        ends, owner = chunk_ends(buf, off, least, most, mask_bits)
        if not len(ends):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        first = np.searchsorted(owner, np.arange(len(off)))
        starts = np.concatenate(([0], ends[:-1]))
        return owner, np.arange(len(ends)) - first[owner], span_hashes(buf, starts, ends, 0), span_hashes(buf, starts, ends, 1)

    return units


def _without(least: int, most: int, mask_bits: int, min_run: int):
    def rewrite(text: str | None, repeats: list[int] | None) -> tuple[str | None, int, int, int, int]:
        if text is None:
            return None, 0, 0, 0, 0
        raw = text.encode()
        ends, _ = chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), least, most, mask_bits)
        if not repeats:
            return text, len(ends), 0, 0, 0
        bounds, left, at, cut, gone, k = [0, *ends.tolist()], [], 0, 0, 0, 0
        while k < len(repeats):
            j = k
            while j + 1 < len(repeats) and repeats[j + 1] == repeats[j] + 1:
                j += 1
            a, b = bounds[repeats[k]], bounds[repeats[j] + 1]
            if b - a >= min_run:
                left.append(raw[at:a])
                at, cut, gone = b, cut + b - a, gone + j + 1 - k
            k = j + 1
        return b"".join([*left, raw[at:]]).decode(), len(ends), len(repeats), gone, cut

    return rewrite


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, most: int = MOST, mask_bits: int = MASK_BITS, min_run: int = MIN_RUN) -> DataFrame:
    """docs with text freed of repeated passages, and n_chunks, n_seen (chunks seen before), n_repeated (those of them in runs that are cut) and n_cut_bytes."""
    found = later_occurrences(docs, _chunks(least, most, mask_bits), doc_id=doc_id, text=text)
    extra = [(x, pa.int64(), "long") for x in ("n_chunks", "n_seen", "n_repeated", "n_cut_bytes")]
    return rewritten(docs, found, extra, _without(least, most, mask_bits, min_run), doc_id=doc_id, text=text)
