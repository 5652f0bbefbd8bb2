"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the
next one reads it. Rejected documents go; all stages but the last return the
columns of documents, with n_chars brought up to date where text changes.

Defined cases, for every stage: an empty table gives an empty one; columns
beside those of documents are dropped, whatever their names; a repeated doc_id
with another text is a document of its own, and each is judged by its text.
What stages do with nulls, empty texts and repeated rows stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import bpe, decontaminate, line_dedup, ngram_join, quality_classifier
from vigilake.llm.queries import tokenizer_path
from vigilake.llm.runtime import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps.

    A null or empty text has weight 0 and is drawn by that; repeated rows share
    their noise, so all stay or all go; without labels of both kinds all stay.
    """
    docs = docs.select(*COLUMNS)
    verdict = quality_classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = verdict.where("not kept").select(F.col("doc_id").alias("i"), F.col("row").alias("r")).distinct()
    return docs.join(rejected, docs.doc_id.eqNullSafe(F.col("i")) & (F.xxhash64(docs.text) == F.col("r")), "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines removed; a document of which nothing is left goes.

    A null or empty text stays as it is; repeated rows are one occurrence and
    are all cut alike.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("n_removed = 0 or length(text) > 0")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, that of the smallest id stays.

    Of equal ids the one with the smaller hash of its text stays; of rows that
    repeat an id and text, one. A null text or one without words is in no group
    and stays, as does a document without id.
    """
    docs = docs.select(*COLUMNS)
    keyed = docs.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    found = written(ngram_join.ngram_jaccard_join(keyed, doc_id="key", words=5, percent=80).where("doc_id is not null").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")))
    ids = keyed.where("key is not null").select("key", "doc_id")
    stays = written(found.join(ids, "key").groupBy("group").agg(F.min_by("key", F.struct("doc_id", "key")).alias("key")).select("key"))
    left = keyed.join(stays, "key", "left_semi").unionByName(keyed.where("key is null"))
    # rows that repeat an id and text have one key
    again = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    if again.take(1):
        repeated = written(left.join(again, "key", "left_semi").dropDuplicates(["key"]))
        left = left.join(again, "key", "left_anti").unionByName(repeated)
    return left.select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. A null or empty text has none and stays; repeated rows are judged alike."""
    judged = decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where(F.size("hits") == 0).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them. A null or empty text has no tokens; repeated rows are encoded alike."""
    return bpe.tokenize(docs, tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("encoded", encoded)]
#: Neither the sampling nor BPE can be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
