"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, word pairs and runs of
marks): one of the target, documents labelled good, one of the raw text, all
documents. A document's log importance weight is the sum, over all its n-grams,
of the log ratio of target to raw. Both counts are smoothed: ``prior`` is added
to each, and the count that the raw model makes us expect in the target is moved
towards the target's by ``sure`` standard errors, as far as equality, so n-grams
too rare to tell have ratio 1 and chance does not add up over a long text. The
weights are divided by ``temperature``, perturbed with Gumbel noise, and the top
k are kept, which draws k documents without replacement by importance. k is the
number of documents whose weight clears the cut that best separates the labelled
rows. The noise of a document is fixed by ``seed`` and doc_id alone.

Counts cover all documents. The labelled rows are at most ``max_labelled``, by
a hash of doc_id. The tables have fixed sizes.

Defined cases: a null or empty text has weight 0, so chance decides where 0 is
near the cut; without labelled rows of both kinds all are kept; labels of one
doc_id that contradict one another count as not good, labels with a null are
left out; repeated rows get the same noise and verdict; ties at the last place
are kept; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import shuffle_partitions, written
from .textops import ALNUM, LOWER, Spans, byte_class, grams, slices, span_hashes, texts_of

MAX_LABELLED = 40_000
#: Sharpness of the ratios; the bound holds back chance, the prior decides how much an n-gram that the target lacks counts.
SURE, PRIOR, TEMPERATURE = 3.0, 0.02, 1.0
#: log2 of the slots for words, word pairs and runs of marks.
_BITS = (20, 18, 12)
_START = np.cumsum([0, *(1 << b for b in _BITS)])
_CHUNKS = 512
#: Bytes of text expanded at a time, at some 50 bytes each.
_SLICE = 1 << 17
_MARKS = byte_class(bytes(b for b in range(256) if not (0x21 <= b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x7F)))


def features(column: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of words, pairs and marks: slots of all texts and the bounds of each text; and the number of words."""
    buf, off = texts_of(column)
    lower = LOWER[buf]
    words, marks = Spans(lower, off, ALNUM), Spans(buf, off, _MARKS)
    h = span_hashes(lower, words.starts, words.ends)
    owner = words.owner
    pair = grams(h, 2)
    within = np.flatnonzero(owner[: len(pair)] == owner[1 : len(pair) + 1])
    out = []
    for k, (x, first) in enumerate(((h, words.first), (pair[within], np.searchsorted(within, words.first)), (span_hashes(buf, marks.starts, marks.ends), marks.first))):
        out.append(((x >> np.uint64(64 - _BITS[k])).astype(np.int64) + _START[k], first))
    return out, words.counts


def _counts(docs: DataFrame, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all slots over all documents, and over the good ones."""
    parts = max(1, min(_CHUNKS, shuffle_partitions(docs.sparkSession)))
    known = docs.sparkSession.sparkContext.broadcast(good)
    n = int(_START[-1])
    bounds = np.linspace(0, n, _CHUNKS + 1).astype(int)

    def packed(sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(_CHUNKS), pa.int32()), pa.array([sums[:, a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["chunk", "sums"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, one, size = np.zeros((2, n), np.int32), np.int32(1), 0
        for batch in slices(batches, most=_SLICE):
            found, _ = features(batch.column("text"))
            mine = np.flatnonzero(pc.is_in(batch.column("doc_id"), value_set=pa.array(known.value, pa.int64())).to_numpy(zero_copy_only=False))
            for slots, first in found:
                # in place, as lists of slots and the counts of each take several times the memory of the sums
                np.add.at(sums[0], slots, one)
                for k in mine:
                    np.add.at(sums[1], slots[first[k] : first[k + 1]], one)
                size += len(slots)
            if size > 8_000_000:
                size = 0
                if sums.max() > 1 << 30:
                    yield packed(sums)
                    sums[:] = 0
        yield packed(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(blob.as_buffer(), np.int32)
                sums[k] = x.astype(np.int64) if k not in sums else sums[k] + x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "sums"])

    rows = docs.mapInArrow(count, "chunk int, sums binary").repartition(parts, "chunk").mapInArrow(add, "chunk int, sums binary").collect()
    out = np.zeros((2, n), np.int64)
    for r in rows:
        out[:, bounds[r.chunk] : bounds[r.chunk + 1]] = np.frombuffer(r.sums, np.int64).reshape(2, -1)
    return out[0], out[1]


def log_ratios(raw: np.ndarray, target: np.ndarray, sure: float = SURE, prior: float = PRIOR) -> np.ndarray:
    """log target/raw of each slot, on the scale of the target's counts; 0 within ``sure`` standard errors."""
    out = np.zeros(len(raw), np.float32)
    for a, b in zip(_START[:-1], _START[1:], strict=True):
        share = target[a:b].sum() / max(1, raw[a:b].sum())
        expected = raw[a:b] * share
        error = sure * np.sqrt(expected * (1 - share) + 1)
        out[a:b] = np.log((target[a:b] + prior) / (np.clip(target[a:b], np.maximum(expected - error, 0), expected + error) + prior))
    return out


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, row, n_words, weight)."""
    table = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_SLICE):
            found, n_words = features(batch.column("text"))
            total = np.zeros(len(n_words))
            for slots, first in found:
                sums = np.concatenate(([0.0], np.cumsum(table.value[slots], dtype=np.float64)))
                total += sums[first[1:]] - sums[first[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n_words.astype(np.int64)), pa.array(np.round(total, 6))], names=["doc_id", "row", "n_words", "weight"])

    return docs.mapInArrow(run, "doc_id long, row long, n_words long, weight double")


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut that maximises the share of good rows at or over it plus the share of others under it."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    kept = 1 - np.concatenate(([0], np.cumsum(g))) / g.sum()
    rejected = np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    usable = np.concatenate(([True], w[1:] != w[:-1], [True]))
    k = int(np.argmax(np.where(usable, kept + rejected, -1)))
    if k == 0:
        return float(w[0])
    return float((w[k - 1] + w[k]) / 2) if k < len(w) else float(w[-1]) + 1e-9


def kth_largest(table: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a written column, by counting in ever narrower ranges; no sort of all rows."""
    low, high = table.agg(F.min(key), F.max(key)).first()
    above = 0
    while high > low:
        width = (high - low) / 512
        within = table.where((F.col(key) >= low) & (F.col(key) <= high))
        counts = {int(r.bin): (r.n, r.lo, r.hi) for r in within.groupBy(F.least(F.floor((F.col(key) - low) / width), F.lit(511)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            n, lo, hi = counts[b]
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
    return float(low)


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, sure: float = SURE, prior: float = PRIOR, temperature: float = TEMPERATURE, seed: int = 42) -> DataFrame:
    """(doc_id, row, n_words, weight, key, kept) of every row; row, a hash of the text, tells rows of one doc_id apart. labels: doc_id, quality, toxic; good is quality 1 and toxic 0."""
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("row"), docs[text].alias("text"))
    marked = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.expr("quality = 1 and toxic = 0")).alias("good"))
    rows = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    good = {r.doc_id: r.good for r in rows}
    raw, target = _counts(source, np.array([i for i, g in good.items() if g], np.int64))
    scored = written(weighed(source, log_ratios(raw, target, sure, prior)))
    spark = docs.sparkSession
    sample = spark.createDataFrame([(i, g) for i, g in good.items()], "id long, good boolean")
    known = scored.join(F.broadcast(sample), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.first("weight").alias("weight"), F.first("good").alias("good")).select("weight", "good").collect()
    weights, is_good = np.array([r.weight for r in known]), np.array([r.good for r in known], bool)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scored.withColumn("key", F.col("weight") / temperature - F.log(-F.log(uniform)))
    if not is_good.any() or is_good.all():
        return keyed.withColumn("kept", F.lit(True))
    k = scored.where(F.col("weight") >= best_cut(weights, is_good)).count()
    if not k:
        return keyed.withColumn("kept", F.lit(False))
    keyed = written(keyed)
    return keyed.withColumn("kept", F.col("key") >= kth_largest(keyed, "key", k))
