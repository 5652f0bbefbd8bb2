"""Periodic runs of words: maximal repetitions of three periods at least.

A run is a stretch of words with smallest period q, of ``longest of min_words
and 3 q`` words at least, that can't be extended by a word on either side.

At each scale b, a power of two from 8, the text is cut into aligned blocks of b
words. A run of period q from b to 2 b - 1 (from 1 at the smallest scale) is
long enough to hold an aligned block and the same block q words on. So the
blocks are keys of an Aho-Corasick automaton that reads the text; each
occurrence at a distance that fits the scale is a seed, and is extended word by
word in both directions. Stretches of equal ends are one repetition, whose
period is the smallest of theirs.

A key has eight integers at every scale: the numbers of the b / 8 words from
each eighth of the block on, where equal spans have equal numbers. Numbers of
longer spans come from those of their halves. The automaton reads the text in
steps of b / 8, from each of the first b / 8 words on.

What keeps this near n log n on any text: a block can only be one of a run if
each of its words comes again within 2 b words; others are no keys. A seed
inside a stretch that its distance has given already is not extended again. A
block that is itself periodic, four times or more, lies in a run R that a
smaller scale has found; a longer period can only match R with a run of the
same period that begins or ends just as far on, so of its many occurrences only
those are extended.

Defined cases: a null or empty text, or one of fewer words, has no run; repeated
rows are treated alike; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textops import SPACED, Spans, slices, texts_of, word_array

_SMALLEST = 8


def _next_distance(ids: np.ndarray) -> np.ndarray:
    """Words from each one to its next occurrence; the number of words where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids), np.int64)
    again = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def _longer(names: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the spans of 2 m words from those of m words."""
    if len(names) <= m:
        return names[:0]
    return np.unique(names[:-m] * (int(names.max()) + 1) + names[m:], return_inverse=True)[1]


def _occurrences(names: np.ndarray, blocks: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of the occurrences of the aligned blocks of b words, from b to 2 b - 1 words on, and at the smallest scale from 1. names: of each span of b / 8 words."""
    m = b // 8
    automaton, number = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), {}
    content = np.full(int(blocks[-1]) // b + 1, -1, np.int64)
    for i, key in zip((blocks // b).tolist(), map(tuple, names[blocks[:, None] + np.arange(0, b, m)].tolist()), strict=True):
        if key not in number:
            number[key] = len(number)
            automaton.add_word(key, number[key])
        content[i] = number[key]
    automaton.make_automaton()
    starts, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # blocks whose reaches overlap are searched in one go
    for part in np.split(blocks, np.flatnonzero(np.diff(blocks) > 3 * b) + 1):
        lo, hi = int(part[0]), int(part[-1]) + 3 * b - m
        found, offset = [], []
        for r in range(m):
            here = list(automaton.iter(tuple(names[lo + r : hi : m].tolist())))
            found += here
            offset.append((lo + r, len(here)))
        if not found:
            continue
        end, which = np.array(found, np.int64).T
        at = np.repeat(*np.array(offset).T) + (end - 7) * m
        for i in ((at - 1) // b * b, (at - 1) // b * b - b) if b == _SMALLEST else ((at - b) // b * b,):
            fits = (i >= 0) & (i <= blocks[-1]) & (at - i < 2 * b)
            fits[fits] = content[i[fits] // b] == which[fits]
            starts.append(i[fits])
            distances.append((at - i)[fits])
    return np.concatenate(starts), np.concatenate(distances)


def _equal_from(ids: np.ndarray, at: int, q: int) -> int:
    """The first place from ``at`` on whose word is not that q words on."""
    end, step = len(ids) - q, 64
    while at < end:
        stop = min(end, at + step)
        unlike = np.flatnonzero(ids[at:stop] != ids[at + q : stop + q])
        if len(unlike):
            return at + int(unlike[0])
        at, step = stop, 2 * step
    return end


def _equal_down_to(ids: np.ndarray, at: int, q: int) -> int:
    """The smallest place from which on, up to ``at``, words are as those q words on."""
    step = 64
    while at > 0:
        start = max(0, at - step)
        unlike = np.flatnonzero(ids[start:at] != ids[start + q : at + q])
        if len(unlike):
            return start + int(unlike[-1]) + 1
        at, step = start, 2 * step
    return 0


def _worth_extending(i: np.ndarray, q: np.ndarray, b: int, known: dict[tuple[int, int], int], n: int) -> np.ndarray:
    """Which seeds can give another period than that of a run their block lies in."""
    runs = sorted((period, start, end) for (start, end), period in known.items() if 4 * period <= b <= end - start)
    if not runs:
        return np.ones(len(i), bool)
    period, start, end = np.array(runs, np.int64).T
    cover = np.full(n // b + 1, -1, np.int64)
    for k, (_, s, e) in enumerate(runs):
        cover[-(-s // b) : e // b] = k
    own = cover[i // b]
    inside = own >= 0
    s, e, d = (np.where(inside, x[own], -1) for x in (start, end, period))
    same = inside & (i + q + b <= e) & (q % np.maximum(d, 1) == 0)
    place = period * (n + 1) + start
    other = np.maximum(np.searchsorted(place, d * (n + 1) + i + q, "right") - 1, 0)
    alike = (period[other] == d) & ((end[other] - e == q) | (start[other] - s == q))
    return ~inside | (~same & alike)


def runs_of(ids: np.ndarray, min_words: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period. min_words is 24 at least."""
    n = len(ids)
    if n < min_words:
        return []
    reach = _next_distance(ids)
    b, found, names, m = _SMALLEST, {}, ids, 1
    widest = reach[: n // b * b].reshape(-1, b).max(1)
    while b == _SMALLEST or 3 * b <= n:
        blocks = np.flatnonzero(widest < 2 * b) * b
        if len(blocks):
            while 8 * m < b:
                names, m = _longer(names, m), 2 * m
            i, q = _occurrences(names, blocks, b)
            use = _worth_extending(i, q, b, found, n) if b >= 32 else np.ones(len(i), bool)
            i, q = i[use], q[use]
            order = np.lexsort((i, q))
            last_q, last_end, made = 0, 0, []
            for at, period in zip(i[order].tolist(), q[order].tolist(), strict=True):
                if period == last_q and at < last_end:
                    continue
                last_q, last_end = period, _equal_from(ids, at + b, period)
                start = _equal_down_to(ids, at, period)
                if last_end + period - start >= max(min_words, 3 * period):
                    made.append((start, last_end + period, period))
            for start, end, period in made:
                found[start, end] = min(period, found.get((start, end), period))
        if len(widest) < 2:
            break
        widest = np.maximum(widest[0 : len(widest) // 2 * 2 : 2], widest[1::2])
        b *= 2
    return sorted((start, end - start, period) for (start, end), period in found.items())


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """That of the greatest length by period; of equal ones the first, then that of the smallest period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_KINDS = {
    "n_runs": ("long", pa.int64()), "start": ("long", pa.int64()), "length": ("long", pa.int64()), "period": ("long", pa.int64()), "exponent_milli": ("long", pa.int64()),
    "runs": ("array<struct<start:long,length:long,period:long>>", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    "collapsed": ("string", pa.string()), "runs_sha256": ("string", pa.string()), "collapsed_sha256": ("string", pa.string()),
}


def periodic_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 24, outputs: tuple[str, ...] = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")) -> DataFrame:
    """doc_id with the wanted outputs of each row: the number of runs; start, length, period and exponent of the best; all runs; and the text, its words joined by one space, without what any run says again after its first period. runs_sha256 and collapsed_sha256 are digests of the last two, a run being ``start,length,period`` and a line end."""
    if min_words < 24:
        raise ValueError("runs of fewer than 24 words can lie between the blocks of the smallest scale")
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    wants_text = any(x.startswith("collapsed") for x in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, off = texts_of(batch.column("text"))
            spans = Spans(buf, off, SPACED)
            words = word_array(buf, spans, SPACED)
            ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keep, rows = np.ones(len(ids), bool), []
            for a, z in zip(spans.first[:-1].tolist(), spans.first[1:].tolist(), strict=True):
                runs = runs_of(ids[a:z], min_words)
                rows.append(runs)
                for start, length, period in runs:
                    keep[a + start + period : a + start + length] = False
            best = [best_run(r) or (None, None, None) for r in rows]
            columns = {"n_runs": [len(r) for r in rows], "start": [x[0] for x in best], "length": [x[1] for x in best], "period": [x[2] for x in best]}
            columns["exponent_milli"] = [None if p is None else 1000 * n // p for _, n, p in best]
            if "runs" in outputs:
                columns["runs"] = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in rows]
            if "runs_sha256" in outputs:
                columns["runs_sha256"] = [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in r).encode()).hexdigest() for r in rows]
            if wants_text:
                kept = np.concatenate((np.zeros(1, np.int64), np.cumsum(keep)))[spans.first]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words if keep.all() else words.filter(pa.array(keep))), " ")
                columns["collapsed"] = joined
                if "collapsed_sha256" in outputs:
                    columns["collapsed_sha256"] = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(columns[x] if isinstance(columns[x], pa.Array) else pa.array(columns[x], _KINDS[x][1]) for x in outputs)], names=["doc_id", *outputs])

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{x} {_KINDS[x][0]}" for x in outputs))
