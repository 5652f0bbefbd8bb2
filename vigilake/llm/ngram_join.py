"""Similarity join of documents by the Jaccard index of their word n-gram sets.

Token-combination prefixes. A token is a hashed n-gram. Tokens fall into four
classes by the number of documents they stand in; class k is indexed by
combinations of k neighbouring tokens, so the rare ones singly and the most
frequent ones by four. Tokens are put in one global order, by class and by hash
within a class. Let n be a set's size, t the threshold. Two linked sets differ
in d = floor((1 - t) / t n) tokens together at most, and in u = n - ceil(t n)
of the one set.

* Class by class, a prefix of the class's tokens is cut such that combinations
  of k neighbours in it suffice: u + (k - 1)(d + 1) + 1 tokens, of which
  (k - 1)(d + 1) + 1 are shared at least. Unshared tokens part them into d + 1
  runs at most, so one run has k tokens, neighbours in both sets.
* If a class of m tokens is shorter, all its combinations are signatures. If
  none of them is shared, it holds (m - k + 1) / k unshared tokens at least,
  which leaves fewer, d and u, for the classes behind. Once d or u is negative,
  no more signatures are needed.
* A set whose last class is too short also has the first n - ceil(t n) + 1
  tokens as signatures of a kind of their own.

Of two linked sets, the one whose prefix ends first has all it needs within the
other's prefix, so they share a signature whichever class a token is in; the
classes only decide how many others share it. Frequencies are counted over all
documents, by 32 bits of the hash; frequent is what stands in more than 16
documents or, if those are over 2^22 tokens, in more than the least count, in
steps of an eighth, that leaves as many, so at most 2^22 tokens, in 5 bytes
each, are broadcast; each further class begins at eight times the count.

Exact copies are one class with one representative. Documents of a signature
are compared with its largest, where their sizes allow a link. Where that
leaves a signature's documents in several components, those of a short list
(LIGHT documents) outside its most frequent component are paired with all others
of another component, unless the number of signatures that two sets share rules
a link out. Longer lists make no pairs: the sets of all long lists with one
largest document are dealt into blocks, two blocks meet in one task, and it
sends on only links that join components. Every pair that shares a signature is
thus compared, ruled out or already connected. Comparison is exact; sets of
pairs travel as 32-bit tokens, and a pair that a coincidence of tokens could
decide is compared again in 64 bits.

That search finds components, not all links in them. For n_links the sets of a
component, in 64 bits, are dealt into blocks of about BLOCK_TOKENS tokens and
BLOCK_SETS sets, and any two blocks meet in one task, which works out all
overlaps at once. All links lie within components, so none is missed.

Defined cases: a text of fewer words than n has its whole sequence as its one
token; one without words, or null, has none and no links; rows that repeat a
doc_id and text are one document; rows that repeat a doc_id with another text
are documents of their own, each with its own links; a row without doc_id
represents no class but has the values of its set's class, if there is one; an empty table has an empty result; of other columns only ids and text
are used, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .runtime import discard, release, shuffle_partitions, written
from .textops import LOWER, SPACED, Spans, gram_sets, mix, signed, slices, span_hashes, texts_of

MAX_FREQUENT = 1 << 22
MIN_FREQUENT = 16
CLASSES = 4
CLASS_STEP = 8
LIGHT = 24
BLOOM_BITS_MOST = 1 << 26
BLOCK_TOKENS = 1 << 18
BLOCK_SETS = 512
_FLUSH = 1_000_000
_RANGES = 1024
_FAN = 64
_CELLS = 1 << 21
_CHUNK_BITS = 17
_U = np.uint64


def token_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    buf, off = texts_of(column)
    buf = LOWER[buf]
    spans = Spans(buf, off, SPACED)
    return gram_sets(span_hashes(buf, spans.starts, spans.ends), spans.first, words)


def _blob(x: np.ndarray) -> bytes:
    return x.tobytes()


def measured(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, d1, d2): set size and an order-free 128-bit digest of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = token_sets(batch.column("text"), words)
            n = np.array([len(s) for s in sets], np.int64)
            d1 = np.array([s.sum(dtype=_U) for s in sets], _U)
            d2 = np.array([mix(s).sum(dtype=_U) for s in sets], _U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed(n), signed(d1), signed(d2)], names=["doc_id", "n", "d1", "d2"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long")


def frequent_tokens(docs: DataFrame, words: int, least: int = MIN_FREQUENT, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted upper 32 bits of the frequent tokens, ``most`` at most, and the class of each, from 2 on.

    Frequent is what stands in more documents than the first of the limits
    ``least``, an eighth more and so on that leaves so few tokens. Tokens travel
    in packed ranges of the hash; a task holds one range at a time.
    """
    limits = [least]
    while limits[-1] < 1 << 40:
        limits.append(limits[-1] + max(1, limits[-1] // 8))
    parts = max(1, shuffle_partitions(docs.sparkSession))
    ranges = max(parts, _RANGES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held))
            bounds = np.searchsorted(x, [(k << 32) // ranges for k in range(1, ranges)])
            blobs = [(k, _blob(b)) for k, b in enumerate(np.split(x, bounds)) if len(b)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary())], names=["range", "tokens"])

        for batch in slices(batches):
            for s in token_sets(batch.column("text"), words):
                held.append((s >> _U(32)).astype(np.uint32))
                size += len(s)
            if size >= _FLUSH:
                yield dealt()
                held, size = [], 0
        if size:
            yield dealt()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def counted() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            often = np.diff(np.append(at, len(x)))
            some = often > least
            return pa.RecordBatch.from_arrays([pa.array([_blob(x[at[some]])], pa.binary()), pa.array([_blob(often[some].astype(np.int64))], pa.binary())], names=["tokens", "counts"])

        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != now and held:
                    yield counted()
                    held.clear()
                now = k
                held.append(np.frombuffer(blob, np.uint32))
        if held:
            yield counted()

    def over_limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = np.zeros(len(limits), np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                counts = np.sort(np.frombuffer(blob, np.int64))
                passed += len(counts) - np.searchsorted(counts, limits, "right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(limits)), pa.int32()), pa.array(passed)], names=["limit", "passed"])

    found = docs.mapInArrow(deal, "range int, tokens binary").repartition(parts, "range").sortWithinPartitions("range").mapInArrow(count, "tokens binary, counts binary")
    found = written(found.where("length(tokens) > 0"))
    passed = {r["limit"]: r["passed"] for r in found.mapInArrow(over_limits, "limit int, passed long").groupBy("limit").agg(F.sum("passed").alias("passed")).collect()}
    over = next(x for k, x in enumerate(limits) if passed.get(k, 0) <= most)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for tokens, counts in zip(batch.column("tokens").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                x, often = np.frombuffer(tokens, np.uint32), np.frombuffer(counts, np.int64)
                some = often > over
                klass = np.full(int(some.sum()), 2, np.uint8)
                for k in range(1, CLASSES - 1):
                    klass += often[some] > over * CLASS_STEP**k
                kept.append((_blob(x[some]), _blob(klass)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in kept], pa.binary()) for k in (0, 1)], names=["tokens", "classes"])

    rows = found.mapInArrow(classed, "tokens binary, classes binary").where("length(tokens) > 0").collect()
    discard(found)
    tokens, classes = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[k], kind) for r in rows)]) for k, kind in enumerate((np.uint32, np.uint8)))
    order = np.argsort(tokens)
    return tokens[order], classes[order]


def signatures(s: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """A set's signatures, the number of tokens in each, and whether they are its whole prefix, of single tokens only; ``classes``: the class of each token."""
    n = len(s)
    none = np.zeros(0, np.uint8)
    if n < 2:
        return np.zeros(0, _U), none, True  # links of one token are exact copies
    u, d = n - -(-percent * n // 100), (100 - percent) * n // percent
    out, sizes, left = [], [], u
    for k in range(1, CLASSES + 1):
        own = s[classes == k]
        need = left + (k - 1) * (d + 1) + 1
        x = own[:need]
        if len(x) >= k:
            run = x[: len(x) - k + 1]
            for j in range(1, k):
                run = mix(run * _U(0x9FB21C651E98DF25) + x[j : len(x) - k + 1 + j])
            out.append(run)
            sizes.append(np.full(len(run), k, np.uint8))
        if len(own) >= need:
            return np.concatenate(out), np.concatenate(sizes), k == 1
        d -= max(0, -(-(len(own) - k + 1) // k))
        left -= len(own) if k == 1 else 0
        if d < 0 or left < 0:
            return np.concatenate(out or [np.zeros(0, _U)]), np.concatenate(sizes or [none]), False
    first = np.concatenate([s[classes == k] for k in range(1, CLASSES + 1)])[: u + 1]
    return np.concatenate([*out, mix(first + _U(0xA24BAED4963EE407))]), np.concatenate([*sizes, np.full(len(first), CLASSES + 1, np.uint8)]), False


class Frequent:
    """Class of each token: 1 for the rare, more for the frequent; the bitmap spares most lookups."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray]):
        (self.tokens, self.classes), self.maybe = known, np.zeros(1 << 22, bool)
        self.maybe[self.tokens >> 10] = True

    def of(self, s: np.ndarray) -> np.ndarray:
        top = (s >> _U(32)).astype(np.uint32)
        out = np.ones(len(s), np.uint8)
        some = np.flatnonzero(self.maybe[top >> 10])
        if len(some):
            place = np.minimum(np.searchsorted(self.tokens, top[some]), len(self.tokens) - 1)
            out[some] = np.where(self.tokens[place] == top[some], self.classes[place], 1)
        return out


def signed_documents(docs: DataFrame, words: int, percent: int, known) -> DataFrame:
    """(doc_id, n, pure, signatures, combined) of documents that can have links besides exact copies; pure: single tokens only; combined: signatures that can be in more documents than a rare token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Frequent(known.value)
        kinds = (pa.int64(), pa.int64(), pa.bool_())

        def lists(parts: list[np.ndarray]) -> pa.Array:
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), signed(np.concatenate([np.zeros(0, _U), *parts])))

        for batch in slices(batches):
            rows = []
            for i, s in zip(batch.column("doc_id").to_pylist(), token_sets(batch.column("text"), words), strict=True):
                x, k, pure = signatures(s, frequent.of(s), percent)
                if len(x):
                    rows.append((i, len(s), pure, x[k == 1], x[k > 1]))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, lists([r[3] for r in rows]), lists([r[4] for r in rows])], names=["doc_id", "n", "pure", "signatures", "combined"])

    return docs.mapInArrow(run, "doc_id long, n long, pure boolean, signatures array<long>, combined array<long>")


def _bits_of(ids: np.ndarray, bits: int) -> np.ndarray:
    """Three bit places of each id."""
    x = ids.astype(np.int64).view(_U)
    return np.stack([mix(x + _U(k * 0x9E3779B97F4A7C15 % (1 << 64))) & _U(bits - 1) for k in (1, 2, 3)]).astype(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids; its size is bounded, not the number of ids. It comes to the driver in packed chunks."""
    bits = 1 << min(BLOOM_BITS_MOST.bit_length() - 1, max(_CHUNK_BITS, 4 + max(1, ids.count()).bit_length()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits_of(batch.column(0).to_numpy(zero_copy_only=False), bits))
            bounds = np.searchsorted(at, np.arange(0, bits + 1, 1 << _CHUNK_BITS))
            chunks = np.flatnonzero(np.diff(bounds))
            blobs = [_blob((at[bounds[c] : bounds[c + 1]] & ((1 << _CHUNK_BITS) - 1)).astype(np.uint32)) for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(chunks.astype(np.int32)), pa.array(blobs, pa.binary())], names=["chunk", "at"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                maps.setdefault(c, np.zeros(1 << _CHUNK_BITS, bool))[np.frombuffer(blob, np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([_blob(np.packbits(x)) for x in maps.values()], pa.binary())], names=["chunk", "at"])

    out = np.zeros(bits // 8, np.uint8)
    size = (1 << _CHUNK_BITS) // 8
    for r in ids.mapInArrow(deal, "chunk int, at binary").repartition("chunk").mapInArrow(gather, "chunk int, at binary").collect():
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r["at"], np.uint8)
    return out


def _made_of(docs: DataFrame, ids: DataFrame, words: int, make) -> DataFrame:
    """(doc_id, tokens) of the wanted documents, tokens being make() of each one's set. A broadcast Bloom filter drops nearly all others before they are shuffled."""
    bits = docs.sparkSession.sparkContext.broadcast(_bloom(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, made = bits.value, make()
        for batch in batches:
            at = _bits_of(batch.column("doc_id").to_numpy(zero_copy_only=False), 8 * len(table))
            maybe = ((table[at >> 3] << (at & 7).astype(np.uint8)) & 0x80).all(axis=0)
            for part in slices(iter([batch.filter(pa.array(maybe))])):
                sets = token_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([_blob(made(s)) for s in sets], pa.binary())], names=["doc_id", "tokens"])

    return docs.mapInArrow(run, "doc_id long, tokens binary")


def _met(pairs: DataFrame, docs: DataFrame, words: int, make) -> DataFrame:
    """(a, b, x, y): the pairs (a, b) with what make() gives for both.

    The b of a pair travels to its a, of which there is one copy for every
    ``_FAN`` of its pairs, so a set with many partners is in many tasks.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = _made_of(docs, ids, words, make)
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _FAN).alias("fans"))
    dealt = pairs.join(fans, "a").select("a", F.col("b").alias("doc_id"), F.pmod(F.xxhash64("b"), "fans").alias("fan"))
    heads = fans.select(F.col("a").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("fans") - 1)).alias("fan"))
    left = dealt.join(sets, "doc_id").select("a", "fan", F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    right = heads.join(sets, "doc_id").select(F.col("doc_id").alias("a"), "fan", F.col("tokens").alias("x"))
    return left.join(right, ["a", "fan"]).select("a", "b", "x", "y")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate((x, y)))
    return int((both[1:] == both[:-1]).sum())


def _paired(found: DataFrame, judge, kind: type) -> DataFrame:
    """(a, b, sure) of the pairs for which judge(x, y) is not None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(k) for k in range(4)), strict=True):
                verdict = judge(np.frombuffer(x.as_buffer(), kind), np.frombuffer(y.as_buffer(), kind))
                if verdict is not None:
                    rows.append((a.as_py(), b.as_py(), verdict))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "sure"])

    return found.mapInArrow(run, "a long, b long, sure boolean").distinct()


def possible(pairs: DataFrame, docs: DataFrame, words: int, percent: int, known) -> DataFrame:
    """(a, b) of the pairs that their prefixes, a seventh of the sets, do not rule out.

    Of two prefixes of rare tokens, let one end first. The tokens of its set
    behind its end are all that can be shared besides those shared up to there.
    """

    def make():
        frequent = Frequent(known.value)

        def prefix(s: np.ndarray) -> np.ndarray:
            x, _, pure = signatures(s, frequent.of(s), percent)
            return np.concatenate((np.array([len(s), pure], np.uint32), (x >> _U(32)).astype(np.uint32) if pure else np.zeros(0, np.uint32)))

        return prefix

    def judge(x: np.ndarray, y: np.ndarray) -> bool | None:
        (nx, px), (ny, py) = ((int(z[0]), z[2:]) for z in (x, y))
        if not (x[1] and y[1] and len(px) and len(py)):
            return True
        behind = nx - len(px) if px[-1] < py[-1] else ny - len(py) if py[-1] < px[-1] else max(nx - len(px), ny - len(py))
        return True if _common(px, py) + behind >= -(-percent * (nx + ny) // (100 + percent)) else None

    return _paired(_met(pairs, docs, words, make), judge, np.uint32).select("a", "b")


def _compared(pairs: DataFrame, docs: DataFrame, words: int, percent: int, narrow: bool = True) -> DataFrame:
    """(a, b, sure) of the linked among the pairs (a, b); not sure, where 32-bit tokens that coincide might have decided."""

    def judge(x: np.ndarray, y: np.ndarray) -> bool | None:
        overlap = _common(x, y)
        joint = len(x) + len(y) - overlap
        # tokens that coincide by chance may have added a few
        return not narrow or 100 * (overlap - 3) >= percent * (joint + 3) if 100 * overlap >= percent * joint else None

    make = (lambda: lambda s: (s >> _U(32)).astype(np.uint32)) if narrow else (lambda: lambda s: s)
    return _paired(_met(pairs, docs, words, make), judge, np.uint32 if narrow else _U)


def links_of(pairs: DataFrame, docs: DataFrame, words: int, percent: int, known) -> DataFrame:
    """(a, b) of the linked among the pairs."""
    some = written(possible(pairs, docs, words, percent, known))
    release(docs.sparkSession)
    found = written(_compared(some, docs, words, percent))
    unsure = found.where("not sure").select("a", "b")
    again = _compared(unsure, docs, words, percent, narrow=False) if unsure.take(1) else found.limit(0)
    out = written(found.where("sure").select("a", "b").union(again.select("a", "b")))
    discard(some, found)
    return out


def link_matrix(sets: list[np.ndarray], second: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which sets are linked across the two sides of ``second`` or, where all are on one side, with one another: indices of the rows, of the columns, and the matrix."""
    n = np.array([len(s) for s in sets], np.int64)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = often > 1  # other tokens are not shared
    held = some[at]
    owner, at = np.repeat(np.arange(len(sets)), n)[held], (np.cumsum(some) - 1)[at[held]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    halves = (np.flatnonzero(~second), np.flatnonzero(second))
    left, right = halves if len(halves[0]) and len(halves[1]) else (np.arange(len(sets)),) * 2
    common = np.zeros((len(left), len(right)), np.int64)
    width, step = int(some.sum()), max(1024, _CELLS // len(sets))
    for c in range(0, width, step):
        lo, hi = np.searchsorted(at, (c, c + step))
        has = np.zeros((len(sets), min(step, width - c)), np.float32)
        has[owner[lo:hi], at[lo:hi] - c] = 1
        common += (has[left] @ has[right].T).astype(np.int64)
    linked = 100 * common >= percent * (n[left][:, None] + n[right] - common)
    if left is right:
        np.fill_diagonal(linked, False)
    return left, right, linked


def joining(linked: tuple[np.ndarray, np.ndarray, np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Links, as index pairs, that join sets of different labels into the components that all links make; at most one for each label."""
    left, right, matrix = linked
    code, out = labels.copy(), []
    while True:
        differ = matrix & (code[left][:, None] != code[right])
        rows = np.flatnonzero(differ.any(axis=1))
        if not len(rows):
            return out
        for i, j in zip(left[rows].tolist(), right[differ[rows].argmax(axis=1)].tolist(), strict=True):
            if code[i] != code[j]:
                code[code == code[j]] = code[i]
                out.append((i, j))


def _in_blocks(members: DataFrame, docs: DataFrame, words: int, extra: tuple[str, ...], schema: str, work) -> DataFrame:
    """Rows of work(ids, extra values, sets, second) for any two blocks of a cluster's documents; members: (cluster, doc_id, n, *extra).

    A block has about BLOCK_TOKENS tokens and BLOCK_SETS sets; second marks the sets of the one of two blocks.
    """
    weight = F.sum(F.greatest("n", F.lit(BLOCK_TOKENS // BLOCK_SETS)))
    fans = members.groupBy("cluster").agg(F.ceil(weight / BLOCK_TOKENS).alias("fans"))
    placed = written(members.join(fans, "cluster").select("doc_id", "cluster", *extra, "fans", F.pmod(F.xxhash64("doc_id"), "fans").alias("block")))
    sets = _made_of(docs, placed.select("doc_id").distinct(), words, lambda: lambda s: s)
    met = sets.join(placed, "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fans") - 1)))
    key = ("cluster", "low", "high")
    dealt = met.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc_id", (F.col("block") > F.col("other")).alias("second"), "tokens", *extra)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, {}, []

        def settle() -> None:
            # the half that waits for another one does not meet itself here
            second = np.array([x for x, *_ in held.values()], bool)
            if len(held) > 1 and (now[1] == now[2] or second.any() != second.all()):
                rows.extend(work(np.fromiter(held, np.int64, len(held)), [x[2:] for x in held.values()], [x[1] for x in held.values()], second))

        def made() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    settle()
                    now, held = row[:3], {}
                held[row[3]] = (row[4], np.frombuffer(row[5], _U), *row[6:])
            yield made()
        settle()
        yield made()

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def links_in_clusters(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of links that join labels, among all documents of each cluster; members: (cluster, doc_id, n, label)."""

    def work(ids: np.ndarray, more: list, sets: list[np.ndarray], second: np.ndarray) -> list[tuple[int, int]]:
        labels = np.array([x[0] for x in more], np.int64)
        if (labels == labels[0]).all():
            return []
        return [(int(ids[i]), int(ids[j])) for i, j in joining(link_matrix(sets, second, percent), labels)]

    return _in_blocks(members, docs, words, ("label",), "a long, b long", work)


def degrees(found: DataFrame, sizes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, links): to how many others each document of a component is linked; found: (node, component), sizes: (doc_id, n)."""
    # a component's smallest document stands in its second column only
    nodes = found.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).union(found.select("component", "component")).distinct()

    def work(ids: np.ndarray, more: list, sets: list[np.ndarray], second: np.ndarray) -> list[tuple[int, int]]:
        left, right, linked = link_matrix(sets, second, percent)
        links = np.zeros(len(sets), np.int64)
        links[left] += linked.sum(axis=1)
        if left is not right:
            links[right] += linked.sum(axis=0)
        return list(zip(ids.tolist(), links.tolist(), strict=True))

    parts = _in_blocks(nodes.join(sizes, "doc_id"), docs, words, (), "doc_id long, links long", work)
    return parts.groupBy("doc_id").agg(F.sum("links").alias("links"))


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(signature, doc_id, n, pure, hub, most) of signatures of two documents or more; hub is the largest, most its size.

    A single rare token stands in a bounded number of documents, so they are put
    in order; combinations may be in any number, and only sums of them meet.
    """
    order = Window.partitionBy("signature").orderBy(F.desc("n"), "doc_id")
    single = rows.select("doc_id", "n", "pure", F.explode("signatures").alias("signature"))
    single = single.withColumns({"before": F.lag("doc_id", 1).over(order), "after": F.lead("doc_id", 1).over(order), "hub": F.first("doc_id").over(order), "most": F.first("n").over(order)})
    single = single.where("before is not null or after is not null")
    combined = rows.where("size(combined) > 0").select("doc_id", "n", "pure", F.explode(F.array_distinct("combined")).alias("signature"))
    heads = combined.groupBy("signature").agg(F.max_by(F.struct("n", "doc_id"), F.struct("n", -F.col("doc_id"))).alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").select("signature", F.col("head.doc_id").alias("hub"), F.col("head.n").alias("most"))
    columns = ("signature", "doc_id", "n", "pure", "hub", "most")
    return single.select(*columns).union(combined.join(heads, "signature").select(*columns))


def _joined(source: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) per row of (doc_id, text), in which a doc_id stands for one text."""
    spark = source.sparkSession
    usable = source.where("doc_id is not null and text is not null")
    sizes = written(measured(source, words))
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("class_id"))
    known = spark.sparkContext.broadcast(frequent_tokens(usable, words, MIN_FREQUENT, MAX_FREQUENT))
    release(spark)
    heads = classes.select(F.col("class_id").alias("doc_id"))
    rows = written(signed_documents(usable, words, percent, known).join(heads, "doc_id").dropDuplicates(["doc_id"]))
    shared = written(shared_signatures(rows))
    discard(rows)
    release(spark)
    tried = written(shared.where((F.col("hub") != F.col("doc_id")) & (100 * F.col("n") >= percent * F.col("most"))).select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct())
    links = links_of(tried, usable, words, percent, known)
    found = written(components(links))
    release(spark)
    # signatures of documents that these links leave apart
    members = shared.select("signature", "doc_id", "n", "pure", "hub").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    by_label = members.groupBy("signature", "label").agg(F.count(F.lit(1)).alias("size"))
    mixed = by_label.groupBy("signature").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.count(F.lit(1)).alias("labels"), F.sum("size").alias("size")).where("labels > 1 and size > 2").select("signature", "largest", "size")
    members = written(members.join(mixed, "signature"))
    discard(shared)
    more = []
    brief = members.where(F.col("size") <= LIGHT)
    if brief.take(1):
        small = brief.where("label != largest").select("signature", F.col("doc_id").alias("p"), F.col("n").alias("pn"), F.col("pure").alias("pp"), F.col("label").alias("pl"))
        rest = small.join(brief, "signature").where((F.col("pl") != F.col("label")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")))
        # a signature counts twice for a pair of which neither is in the largest component
        once = F.when(F.col("label") == F.col("largest"), 2).otherwise(1)
        rest = rest.select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b"), (F.col("pp") & F.col("pure")).alias("pure"), (F.col("n") + F.col("pn")).alias("total"), F.greatest("n", "pn").alias("more"), once.alias("w"))
        rest = rest.groupBy("a", "b", "pure", "total", "more").agg(F.sum("w").alias("w"))
        # behind the shorter of two prefixes of rare tokens, least - 1 tokens may still be shared; of two pure sets all signatures are in short lists or all pairs are compared in blocks
        enough = F.col("w") / 2 + F.ceil(F.col("more") * percent / 100) - 1 >= F.ceil(F.col("total") * percent / (100 + percent))
        rest = written(rest.where(~F.col("pure") | enough).select("a", "b").join(tried, ["a", "b"], "left_anti"))
        release(spark)
        more.append(links_of(rest, usable, words, percent, known))
        discard(rest)
    lengthy = members.where(F.col("size") > LIGHT)
    if lengthy.take(1):
        more.append(written(links_in_clusters(lengthy.select(F.col("hub").alias("cluster"), "doc_id", "n", "label").distinct(), usable, words, percent)))
    more = [x for x in more if x.take(1)]
    if more:
        for x in more:
            links = links.union(x)
        found = written(components(links))
    discard(tried, members)
    release(spark)
    degree = written(degrees(found, classes.groupBy(F.col("class_id").alias("doc_id")).agg(F.max("n").alias("n")), usable, words, percent).withColumnRenamed("doc_id", "class_id"))
    heads = classes.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left").join(degree, "class_id", "left")
    keyed = heads.select("n", "d1", "d2", "class_id", F.coalesce("component", "class_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = sizes.join(keyed, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def ngram_jaccard_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) per row of docs.

    component_id is the smallest doc_id reachable by links, class_id the
    smallest one with the same set, n_links the number of other classes whose
    sets are linked to its own.
    """
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    again = source.where("doc_id is not null and text is not null").groupBy("doc_id").agg((F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("varied")).where("varied")
    again = written(again.select(F.col("doc_id").alias("again")))
    if not again.take(1):
        return _joined(source, words, percent)
    # texts that share a doc_id get keys of their own
    own = F.when(F.col("again").isNotNull() & F.col("text").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    keyed = written(source.join(again, source.doc_id == again.again, "left").select(source.doc_id.alias("real"), own.alias("doc_id"), "text"))
    found = _joined(keyed.select("doc_id", "text"), words, percent)
    rows = written(keyed.groupBy("doc_id").agg(F.min("real").alias("real"), F.count(F.lit(1)).alias("rows")).join(found.distinct(), "doc_id"))
    rows = rows.unionByName(found.where("doc_id is null").select(F.lit(None).cast("long").alias("real"), F.lit(1).cast("long").alias("rows"), *found.columns))
    least = [rows.where(f"{c} is not null").groupBy(c).agg(F.min("real").alias(f"least_{c}")) for c in ("component_id", "class_id")]
    out = rows.join(least[0], "component_id", "left").join(least[1], "class_id", "left").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select(F.col("real").alias("doc_id"), "n_shingles", F.col("least_component_id").alias("component_id"), F.col("least_class_id").alias("class_id"), "n_links")
