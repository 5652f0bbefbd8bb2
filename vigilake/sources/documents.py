"""Large JSON documents read by many tasks.

A document is a list of objects, or an object whose first key is Records with
such a list. Spark's text reader cuts it at every closing brace, by byte ranges,
so a file is as many tasks as it has blocks. Whether a piece begins inside a
string and how deep it lies follows from all pieces before it: the parity of the
quotes and the sum of the brackets. Both are summed within blocks and then over
the few rows that stand for blocks, for either parity a block may begin with, so
no task sees more than a block. A record ends where a brace that is in no string
leads back to the list's depth; its pieces, which may lie in two blocks or more,
are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

_WRAPPED, _LIST = r'^\s*\{\s*"Records"\s*:\s*\[', r"^\s*\["
_BLOCK = ["file", "block"]


def _every_other(parity: int):
    return lambda _, i: i % 2 == parity


def _shape(value: Column) -> tuple[Column, list[Column], list[Column]]:
    """Of a piece: its quotes and, for either parity it may begin with, the change of depth before its closing brace and the least of it on the way."""
    plain = F.regexp_replace(value, r"\\.", "")
    parts = F.split(plain, '"', -1)
    deltas, least = [], []
    for parity in (0, 1):
        outside = F.array_join(F.filter(parts, _every_other(parity)), "")
        steps = F.transform(F.filter(F.split(F.regexp_replace(outside, r"[^\[\]{]", ""), ""), lambda x: x != ""), lambda x: F.when(x == "]", -1).otherwise(1))
        walked = F.aggregate(steps, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), lambda a, x: F.struct((a.d + x).alias("d"), F.least(a.m, a.d + x).alias("m")))
        deltas.append(walked.d)
        least.append(walked.m)
    return F.size(parts) - 1, deltas, least


def _chosen(parity: Column, of: list[Column]) -> Column:
    return F.when(parity == 0, of[0]).otherwise(of[1])


def read_documents(spark: SparkSession, *paths: str, scratch: Scratch | None = None) -> DataFrame:
    """(raw, file): the objects of the documents' lists.

    Items that are no objects are not looked for, and the documents must be
    valid JSON. Two small tables, of a row for each block, are in ``scratch``.
    """
    scratch = scratch or Scratch(spark)
    text = spark.read.option("lineSep", "}").text(list(paths))
    pieces = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    inner = Window.partitionBy(*_BLOCK).orderBy("id")
    # what opens the list is taken off the file's first piece
    first = (F.col("block") == 0) & (F.row_number().over(inner) == 1)
    pieces = pieces.withColumn("head", F.when(first, F.col("value"))).withColumn("value", F.when(F.col("head").isNotNull(), F.regexp_replace("value", f"{_WRAPPED}|{_LIST}", "")).otherwise(F.col("value")))
    quotes, deltas, least = _shape(F.col("value"))
    shaped = pieces.select("*", quotes.alias("q"), *(c.alias(n) for c, n in zip((*deltas, *least), ("d0", "d1", "m0", "m1"), strict=True)))
    before, upto = inner.rowsBetween(Window.unboundedPreceding, -1), inner.rowsBetween(Window.unboundedPreceding, 0)
    parity = F.pmod(F.coalesce(F.sum("q").over(before), F.lit(0)), F.lit(2))
    placed = shaped.withColumn("parity", parity)
    for start in (0, 1):
        own = F.pmod(F.col("parity") + start, F.lit(2))
        # the closing brace counts if the piece ends outside a string
        closing = F.when(F.pmod(own + F.col("q"), F.lit(2)) == 0, 1).otherwise(0)
        placed = placed.withColumn(f"c{start}", closing).withColumn(f"n{start}", _chosen(own, [F.col("d0"), F.col("d1")]) - closing).withColumn(f"l{start}", _chosen(own, [F.col("m0"), F.col("m1")]))
    for start in (0, 1):
        placed = placed.withColumn(f"b{start}", F.coalesce(F.sum(f"n{start}").over(before), F.lit(0)))
    placed = placed.drop("d0", "d1", "m0", "m1")
    # a row for each block: quotes, change of depth, least depth on the way, and how the file begins
    sums = placed.groupBy(*_BLOCK).agg(F.sum("q").alias("q"), *(F.sum(f"n{s}").alias(f"n{s}") for s in (0, 1)), *(F.min(F.col(f"b{s}") + F.col(f"l{s}")).alias(f"l{s}") for s in (0, 1)), F.max("head").alias("head"))
    file = Window.partitionBy("file").orderBy("block")
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.withColumn("start", F.pmod(F.coalesce(F.sum("q").over(earlier), F.lit(0)), F.lit(2)))
    for n in ("n", "l"):
        blocks = blocks.withColumn(n, _chosen(F.col("start"), [F.col(f"{n}0"), F.col(f"{n}1")]))
    blocks = blocks.withColumn("head", F.first("head").over(file))
    blocks = blocks.withColumn("items", F.when(F.col("head").rlike(_LIST), 1).when(F.col("head").rlike(_WRAPPED), 2))
    blocks = blocks.withColumn("depth", F.col("items") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("low", F.col("depth") + F.col("l"))
    blocks = scratch.written(blocks.where("items is not null").select(*_BLOCK, "start", "depth", "items"))
    known = placed.join(blocks, _BLOCK)
    at = {n: _chosen(F.col("start"), [F.col(f"{n}0"), F.col(f"{n}1")]) for n in ("b", "n", "l", "c")}
    known = known.select(*_BLOCK, "id", "value", "items", at["c"].alias("c"), (F.col("depth") + at["b"] + at["n"]).alias("after"), (F.col("depth") + at["b"] + at["l"]).alias("low"))
    # behind the end of the list nothing is an item
    known = known.withColumn("lowest", F.min("low").over(upto))
    over = scratch.written(known.groupBy(*_BLOCK).agg(F.min("low").alias("low"), F.max(F.when((F.col("c") == 1) & (F.col("after") == F.col("items")), F.col("id"))).alias("last")))
    over = over.withColumns({"past": F.min("low").over(earlier), "last": F.last("last", True).over(earlier)}).select(*_BLOCK, "past", F.col("last").alias("before"))
    known = known.join(over, _BLOCK).where(F.least("lowest", F.coalesce("past", "lowest")) >= F.col("items"))
    ends = F.when((F.col("c") == 1) & (F.col("after") == F.col("items")), F.col("id"))
    numbered = known.withColumn("ended", ends.isNotNull()).withColumn("record", F.coalesce(F.last(ends, True).over(before), F.col("before"), F.lit(-1)))
    records = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "id", "value"))).alias("parts"), F.max("ended").alias("whole"))
    joined = F.concat(F.array_join(F.col("parts.value"), "}"), F.lit("}"))
    return records.where("whole").select(F.regexp_replace(joined, r"^[^{]*", "").alias("raw"), "file")
