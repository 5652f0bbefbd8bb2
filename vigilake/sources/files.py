"""Log files: lines, JSON documents, and streams of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.schema import ENVELOPE

#: The longest line that is taken for a record.
MAX_LINE = 10 * 1024 * 1024


def split_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per record: the items of a JSON array or of an object's Records, else the text itself. Rows spread by their items, not by their file, once repartitioned."""
    v = F.try_parse_json(F.col(raw))
    whole = F.startswith(F.trim(F.col(raw)), F.lit("["))
    wrapped = F.try_variant_get(v, "$.Records", "array<variant>")
    items = F.when(whole, F.try_variant_get(v, "$", "array<variant>")).otherwise(wrapped)
    texts = F.coalesce(F.transform(items, lambda x: F.to_json(x)), F.array(raw))
    return df.withColumn(raw, F.explode(texts))


def _taken(text: DataFrame) -> DataFrame:
    return text.where((F.length("raw") <= MAX_LINE) & (F.trim("raw") != ""))


def too_long(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, lines): how many lines of each file are over MAX_LINE characters, which reading leaves out."""
    text = spark.read.text(list(paths)).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    return text.where(F.length("raw") > MAX_LINE).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


def read_lines(spark: SparkSession, *paths: str, whole: bool = False) -> DataFrame:
    """(raw, file): records of text files, compressed ones too by their suffix.

    A line that is a JSON array or {"Records": [...]} gives its items. With
    ``whole`` each file is one JSON document over many lines; one task reads it.
    """
    text = spark.read.text(list(paths), wholetext=whole).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    return split_records(_taken(text) if not whole else text)


def read_auto(spark: SparkSession, *paths: str, head: int = 1024) -> DataFrame:
    """(raw, file), deciding per file: one document if it begins with [ or has Records in its first bytes and its first line is not all of it, else lines.

    Reads the files' first lines once to decide, and each file in one way.
    """
    first = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).where("at = 0")
    opening = first.where(F.trim("value") != "").groupBy("file").agg(F.first(F.substring("value", 1, head)).alias("line"))
    trimmed = F.trim("line")
    many = opening.where((F.startswith(trimmed, F.lit("[")) | F.startswith(trimmed, F.lit("{"))) & (F.length("line") < head) & F.try_parse_json("line").isNull())
    many = many.select("file")
    documents = [r.file for r in many.collect()]  # a reader takes names; the driver lists all of them for any reading
    lines = read_lines(spark, *paths)
    if not documents:
        return lines
    return lines.join(many, "file", "left_anti").select("raw", "file").unionByName(read_lines(spark, *documents, whole=True))


def read_events(spark: SparkSession, *paths: str) -> DataFrame:
    """CloudTrail events of JSON lines; lines that are no JSON are left out."""
    return spark.read.schema(ENVELOPE + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(list(paths)).where("_bad is null and eventID is not null").drop("_bad")


def stream_lines(spark: SparkSession, path: str, glob: str = "*.json*", max_files: int | None = None) -> DataFrame:
    """The same as a stream over a directory tree; its checkpoint is the ledger of files that are done."""
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return split_records(_taken(reader.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))))
