"""Benchmark decontamination by winnowing.

Every text becomes a sequence of word hashes. Of each ``span_words -
gram + 1`` neighbouring ``gram``-word hashes the smallest is kept (all of
them where they tie) as a fingerprint. Two texts that share ``span_words``
consecutive words keep the same fingerprint inside that span, so looking the
documents' fingerprints up among the benchmark's finds every such span. A hit
is extended to the windows of ``span_words`` words around it, each of which is
looked up among the items' windows and then compared with one of its places
word by word; windows that follow one another make up the whole shared span.
Equal windows of the benchmark are one entry with a list of their items, so the
work depends neither on how often a text repeats itself nor on how many items
share a passage. An item of fewer words is one window of its own length, for
which winnowing has no shorter guarantee, so grams of that length are compared.

The benchmark is cut into blocks of at most ``block_bytes`` of text, and one
block at a time is broadcast; documents are never shuffled.

Defined cases: a null or empty text has no words and no hits; an item without
words never occurs; an item without id is searched for and its hits count, but
it has no id to stand in items; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime
from .textops import ALNUM, LOWER, Spans, grams, slices, span_hashes, texts_of

BLOCK_BYTES = 32 << 20
_LUT_BITS = 18

_HITS = "array<struct<start:int,stop:int>>"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, off = texts_of(column)
    buf = LOWER[buf]
    spans = Spans(buf, off, ALNUM)
    return span_hashes(buf, spans.starts, spans.ends), spans.first


def winnow(h: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions and hashes of the kept fingerprints of all texts."""
    g = grams(h, gram)
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[:n].copy()
    for j in range(1, window):
        np.minimum(least, g[j : j + n], out=least)
    whole = np.zeros(n, bool)  # windows within one text
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= gram + window - 1:
            whole[a : b - gram - window + 2] = True
    kept = np.zeros(len(g), bool)
    for j in range(window):
        kept[j : j + n] |= whole & (g[j : j + n] == least)
    at = np.flatnonzero(kept)
    return at, g[at]


class Windows:
    """Distinct windows of one length, sorted by hash: a place of each among the items' words and the number of the list of its items."""

    def __init__(self, words: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int, lists: dict[tuple[int, ...], int]):
        self.length = length
        h = grams(words, length)[at] if len(at) else np.zeros(0, np.uint64)
        order = np.lexsort((owner, h))
        h, at, owner = h[order], at[order], owner[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.hash, self.at = h[starts], at[starts]
        stops = np.concatenate((starts[1:], [len(h)])) if len(h) else starts
        items = owner.tolist()
        self.list = np.array([lists.setdefault(tuple(dict.fromkeys(items[a:b])), len(lists)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)

    def among(self, h: np.ndarray, starts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the starts in h at which a window stands, and the number of its list."""
        g = grams(h, self.length)
        starts = starts[starts < len(g)]
        starts = starts[Index.found(g[starts], self.hash)]
        place = np.searchsorted(self.hash, g[starts])
        same = np.ones(len(starts), bool)
        for j in range(self.length):
            same &= h[starts + j] == words[self.at[place] + j]
        return starts[same], self.list[place[same]]


class Index:
    """Fingerprints and windows of one benchmark block."""

    def __init__(self, items: list[tuple[str | None, str | None]], span_words: int, gram: int):
        h, first = word_hashes(pa.array([t for _, t in items], pa.string()))
        self.ids, self.span, self.gram, self.words = [i for i, _ in items], span_words, gram, h
        self.fp = np.unique(winnow(h, first, gram, span_words - gram + 1)[1])
        size, lists = np.diff(first), {}
        owner = np.repeat(np.arange(len(size)), size)
        rest = first[1:][owner] - np.arange(len(h))  # words from each one to the end of its item
        at = np.flatnonzero(rest >= span_words)
        self.long = Windows(h, at, owner[at], span_words, lists)
        self.short = []
        for m in np.unique(size[(size > 0) & (size < span_words)]).tolist():
            own = np.flatnonzero(size == m)
            self.short.append(Windows(h, first[own], own, m, lists))
        self.lists = list(lists)

    @staticmethod
    def found(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Indices of the keys that stand among the sorted hashes."""
        if not len(among) or not len(keys):
            return np.zeros(0, np.int64)
        low = np.zeros(1 << _LUT_BITS, bool)
        mask = np.uint64((1 << _LUT_BITS) - 1)
        low[(among & mask).astype(np.int64)] = True
        some = np.flatnonzero(low[(keys & mask).astype(np.int64)])
        place = np.minimum(np.searchsorted(among, keys[some]), len(among) - 1)
        return some[among[place] == keys[some]]

    def search(self, h: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For each text with hits: word spans and the items they belong to."""
        at, fp = winnow(h, first, self.gram, self.span - self.gram + 1)
        hit = at[self.found(fp, self.fp)]
        marked = np.zeros(len(h) + 1, bool)
        for j in range(self.span - self.gram + 1):
            marked[hit[hit >= j] - j] = True
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        edge = np.zeros(len(h) + 1, np.int64)
        for windows, starts in [(self.long, np.flatnonzero(marked[:-1])), *((w, np.arange(len(h))) for w in self.short)]:
            text = np.searchsorted(first, starts, "right") - 1
            starts, lists = windows.among(h, starts[starts + windows.length <= first[text + 1]], self.words)
            edge[starts] += 1
            np.subtract.at(edge, starts + windows.length, 1)
            seen.append((np.searchsorted(first, starts, "right") - 1, lists))
        inside = np.cumsum(edge)[:-1] > 0
        before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
        border = np.zeros(len(h) + 1, bool)
        border[first] = True
        opens, closes = np.flatnonzero(inside & (~before | border[:-1])), np.flatnonzero(inside & (~after | border[1:])) + 1
        out: dict[int, tuple[list, set]] = {}
        for text, start, stop in zip((np.searchsorted(first, opens, "right") - 1).tolist(), opens.tolist(), closes.tolist(), strict=True):
            out.setdefault(text, ([], set()))[0].append((start - int(first[text]), stop - int(first[text])))
        pairs = np.unique(np.concatenate([t * len(self.lists) + x for t, x in seen])) if self.lists else []
        for pair in pairs:
            text, k = divmod(int(pair), len(self.lists))
            out[text][1].update(self.ids[i] for i in self.lists[k] if self.ids[i] is not None)
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pass(df: DataFrame, index, text: str) -> DataFrame:
    """Adds one block's hits to the columns n_words, hits and items."""
    schema = df.schema
    arrow_hits = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            h, first = word_hashes(batch.column(text))
            found = index.value.search(h, first)
            hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for k, (spans, ids) in found.items():
                old = [(x["start"], x["stop"]) for x in hits[k] or ()]
                hits[k] = [{"start": a, "stop": b} for a, b in merged(old + spans)]
                items[k] = sorted({*(items[k] or ()), *ids})
            new = {"n_words": pa.array(np.diff(first)), "hits": pa.array(hits, arrow_hits), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(f.name)) for f in schema], names=schema.names)

    return df.mapInArrow(run, schema)


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """Lists of (item id as string or null, text) of at most block_bytes each, one item at least; read one block at a time."""
    block, used = [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        size = len(row.t or "") * 4
        if block and used + size > block_bytes:
            yield block
            block, used = [], 0
        block.append((row.i, row.t))
        used += size
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span_words: int = 10, gram: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs' columns with n_words, hits (merged word spans) and items (ids of the items that occur).

    Columns of docs that clash with those three are replaced.
    """
    spark = docs.sparkSession
    kept = docs.drop("n_words", "hits", "items")
    out = kept.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast(_HITS), "items": F.array().cast("array<string>")})
    # at least one pass, which counts the words
    found = False
    for block in blocks_of(benchmark, item_id, item_text, block_bytes):
        out = runtime.written(out) if found else out
        out, found = _pass(out, spark.sparkContext.broadcast(Index(block, span_words, gram)), text), True
    return out if found else _pass(out, spark.sparkContext.broadcast(Index([], span_words, gram)), text)


def report(judged: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document with counts and a digest of the item ids."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + (x.stop - x.start))
    return judged.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
