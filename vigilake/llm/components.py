"""Connected components of a link table, without gathering links in one task.

Each task first replaces its links by a spanning star per local component.
Then large-star and small-star rounds (Kiveris et al., "Connected components in
MapReduce and beyond", 2014) run until nothing changes; each round is two
aggregations and joins by node, written to the shared folder, so hubs are
pre-aggregated and their joins can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, written

BLOCK_LINKS = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def drained() -> pa.RecordBatch:
        rows = [(x, root(x)) for x in list(parent)]
        rows = [(x, r) for x, r in rows if x != r]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > BLOCK_LINKS:
            yield drained()
    yield drained()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = down.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("k", "m").toDF("u", "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link to another; component is its smallest node. links: two long columns, in any order."""
    stars = links.select(links.columns[:2]).mapInArrow(_stars, "u long, v long")
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
    e = written(stars)
    before = mark(e)
    while before[0]:
        last, e = e, written(_small_star(_large_star(e)))
        discard(last)
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
