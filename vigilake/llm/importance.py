"""Importance resampling towards a target distribution of hashed word n-grams.

In each task DuckDB takes the words of a slice of texts apart (unnest), pairs
neighbours (window) and gives every run of words its CRC-32 bucket. Each slice's
bucket counts, and each document's buckets, are spilled to Parquet in the shared
folder; Spark merges the counts, turns them into one gain per bucket and scores
the documents from what was spilled, so texts are taken apart once.

CRC-32 of a run of words is combined from those of its words: zlib is asked for
words only, and appending bytes to a text is a linear map of its CRC that
depends on their number alone.

A document's weight is the floored mean of its features' gains, its score adds
Gumbel noise that only seed and doc_id decide, and the best ``percent`` of the
documents with ``min_words`` words are drawn: a sample without replacement, in
proportion to exp(weight / 1000). Ranks come from a sort by ranges, of which no
task sees more than one, however many scores are tied.

Defined cases: a null or empty text has no features and weight 0; repeated rows
are scored alike and count and rank as often as they stand, next to one another;
a null doc_id has the noise of an empty one and comes after others in ties; an
empty table gives an empty one; an empty target has no features; other columns
are ignored.
"""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import shuffle_partitions, written
from .textops import slices

_SLICE = 2 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SHORT = 64


def _columns(n_bytes: int) -> np.ndarray:
    """What each of the 32 bits of a CRC becomes when n_bytes follow, by squaring the map of one byte."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    # crc(x + zero byte) is affine in crc(x); the constant falls away in differences
    one = np.array([zlib.crc32(b"\0", int(b)) ^ zlib.crc32(b"\0", 0) for b in bits], np.uint32)
    out = bits
    while n_bytes:
        if n_bytes & 1:
            out = _mapped(_table(one), out)
        one, n_bytes = _mapped(_table(one), one), n_bytes >> 1
    return out


def _table(columns: np.ndarray) -> np.ndarray:
    """The map for each value of each of the four bytes."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        bit = (np.arange(256) >> (k % 8)) & 1 > 0
        out[k // 8, bit] ^= columns[k]
    return out


def _mapped(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


@lru_cache(1024)
def _appending(n_bytes: int) -> np.ndarray:
    return _table(_columns(n_bytes))


@lru_cache(1)
def _short_tables() -> np.ndarray:
    return np.concatenate([_appending(n).ravel() for n in range(_SHORT)])


def combined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of ``x + " " + y`` from those of x and y and the number of bytes of y."""
    spaced = _mapped(_appending(1), left) ^ np.uint32(zlib.crc32(b" "))
    tables, place = _short_tables(), np.minimum(size, _SHORT - 1) << 10
    out = tables[place + (spaced & 255)]
    for k in (1, 2, 3):
        out ^= tables[place + (k << 8) + ((spaced >> (8 * k)) & 255)]
    for n in np.unique(size[size >= _SHORT]).tolist():
        which = size == n
        out[which] = _mapped(_appending(n), spaced[which])
    return out ^ right


def _crc(words: pa.Array) -> pa.Array:
    """zlib's CRC-32 of each word."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    data, crc32 = words.buffers()[2].to_pybytes(), zlib.crc32
    return pa.array([crc32(data[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.int64())


def _crc_after(left: pa.Array, right: pa.Array, size: pa.Array) -> pa.Array:
    a, b, n = (np.asarray(x).astype(t) for x, t in ((left, np.uint32), (right, np.uint32), (size, np.int64)))
    return pa.array(combined(a, b, n).astype(np.int64))


def _statements(longest: int, buckets: int) -> tuple[list[str], str, str]:
    """What makes the table grams (d, r1, r2 ...) of the CRC-32 of the 1, 2 ... words that begin at each word; the query for each text's buckets; and that for their counts."""
    leads = "".join(f", lead(c, {k}, 0) OVER w AS c{k}, lead(size, {k}, -1) OVER w AS s{k}" for k in range(1, longest))
    steps = ["g1 AS (SELECT d, c AS r1" + "".join(f", c{k}, s{k}" for k in range(1, longest)) + " FROM neighbours)"]
    steps += [f"g{k + 1} AS (SELECT *, CASE WHEN s{k} >= 0 THEN crc_after(r{k}, c{k}, s{k}) END AS r{k + 1} FROM g{k})" for k in range(1, longest)]
    every = [f"r{k + 1}" for k in range(longest)]
    make = [
        f"CREATE OR REPLACE TEMP TABLE words AS SELECT d, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM (SELECT d, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM slice)",
        "CREATE OR REPLACE TEMP TABLE vocabulary AS SELECT word, crc(word) AS c, strlen(word)::BIGINT AS size FROM (SELECT DISTINCT word FROM words)",
        f"CREATE OR REPLACE TEMP TABLE grams AS WITH neighbours AS (SELECT d, c{leads} FROM words JOIN vocabulary USING (word) WINDOW w AS (PARTITION BY d ORDER BY i)), {', '.join(steps)} SELECT d, {', '.join(every)} FROM g{longest}",
    ]
    texts = f"SELECT d, count(*)::BIGINT AS n_words, list_concat({', '.join(f'coalesce(list(({r} % {buckets})::INTEGER) FILTER ({r} IS NOT NULL), [])' for r in every)}) AS buckets FROM grams GROUP BY d ORDER BY d"
    counts = f"SELECT list(bucket) AS b, list(n) AS n FROM (SELECT bucket, count(*) AS n FROM (SELECT unnest([{', '.join(every)}]) % {buckets} AS bucket FROM grams) WHERE bucket IS NOT NULL GROUP BY bucket)"
    return make, texts, counts


def spilled(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Written rows of two kinds: each document's n_words and buckets, one for each feature, and each slice's distinct buckets with their counts. docs: doc_id, row, text."""
    schema = "kind string, doc_id long, row long, n_words long, buckets array<int>, counts array<long>"
    make, texts, counts = _statements(longest, buckets)
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = ["kind", "doc_id", "row", "n_words", "buckets", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as scratch, duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "384MB", "temp_directory": scratch}) as db:
            db.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
            db.create_function("crc_after", _crc_after, ["BIGINT", "BIGINT", "BIGINT"], "BIGINT", type="arrow")
            for batch in slices(batches, most=_SLICE):
                n = batch.num_rows
                db.register("slice", pa.table({"d": pa.array(np.arange(n, dtype=np.int32)), "text": batch.column("text")}))
                for statement in make:
                    db.execute(statement)
                of = db.sql(texts).to_arrow_table().combine_chunks()
                n_words, lists = np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
                d = of["d"].to_numpy()
                n_words[d] = of["n_words"].to_numpy()
                made = of["buckets"].combine_chunks() if isinstance(of["buckets"], pa.ChunkedArray) else of["buckets"]
                lists[d + 1] = np.diff(made.offsets.to_numpy())
                found = pa.ListArray.from_arrays(pa.array(np.cumsum(lists).astype(np.int32)), made.flatten())
                none = pa.nulls(n, types[5])
                yield pa.RecordBatch.from_arrays([pa.array(["document"] * n), batch.column("doc_id"), batch.column("row"), pa.array(n_words), found, none], names=names)
                sums = db.sql(counts).fetchall()[0]
                if sums[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(("slice", None, None, None, *sums), types, strict=True)], names=names)
                db.unregister("slice")

    return written(docs.mapInArrow(run, schema), "kind")


def _counts(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name): merged counts of the slices."""
    each = rows.where("kind = 'slice'").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket from two spilled tables: 1000 times the log ratio of the smoothed shares, floored. One number for each of a fixed number of buckets."""
    spark = docs.sparkSession
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(_counts(docs, "s"), "bucket", "left").join(_counts(target, "t"), "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"))
    rows = both.collect()
    s, t = (np.zeros(buckets) for _ in "st")
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    every_s, every_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * every_s / ((a + 1) * every_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, row, n_words, n_features, weight) of each spilled document."""
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("buckets")
            ends = found.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(table.value[found.flatten().to_numpy()])))
            ends = ends - ends[0]
            n = np.diff(ends)
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "n_words")), pa.array(n), pa.array(weight)], names=["doc_id", "row", "n_words", "n_features", "weight"])

    return docs.where("kind = 'document'").select("doc_id", "row", "n_words", "buckets").mapInArrow(run, "doc_id long, row long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, *by) -> DataFrame:
    """rows with rank 1, 2, 3 ... in the order of ``by``, by ranges of it; equal rows get ranks in any order. by must not leave more than a range of ties, so it ends with something that tells all rows apart."""
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)
    placed = written(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # one row for each range
    sizes = dict(sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()))
    before, offsets = 0, []
    for k, n in sizes.items():
        offsets.append((k, before))
        before += n
    known = spark.createDataFrame(offsets, "part long, before long")
    joined = placed.withColumn("part", part).join(F.broadcast(known), "part")
    return joined.withColumn("rank", F.col("before") + F.col("place") - F.shiftleft(F.col("part"), 33) + 1).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 2, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, row, n_words, n_features, weight, score, rank) of every row; row, a hash of the text, tells rows of one doc_id apart; rank is null where a row is not drawn."""
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("row"), docs[text].alias("text"))
    aim = target.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), target[target_text].alias("text"))
    found, wanted = spilled(source, longest, buckets), spilled(aim, longest, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed(found, gains(found, wanted, buckets)).withColumn("score", F.col("weight") + noise))
    eligible = F.col("n_words") >= min_words
    drawn = percent * scored.where(eligible).count() // 100
    out = ranked(scored.where(eligible).withColumn("apart", F.monotonically_increasing_id()), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"), F.asc("apart"))
    out = out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).drop("apart")
    return out.unionByName(scored.where(~eligible).withColumn("rank", F.lit(None).cast("long")))
