"""One query per operator over whole tables with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_extract, importance, licenses, line_dedup, ngram_join, periodic_runs, quality_classifier, quality_rules, substring_dedup, token_files, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(_table(spark, sf_dir, "documents"), tokenizer_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by the CRC-32 of their id, the words from some place on repeat themselves."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def altered(words):
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, a + (i - a) % p))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    # the function's argument is worked out once
    made = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, altered(w)).otherwise(F.col("text"))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(planted_runs(_table(spark, sf_dir, "documents")), outputs=("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    ops = (op1_ngram_jaccard, op2_html_extract, op3_quality_classifier, op4_decontaminate, op5_quality_rules, op6_bpe, op7_line_dedup, op8_substring_dedup, op9_url_filter, op10_licenses, op11_importance_resampling, op12_periodic_runs, op13_token_files)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


_LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
full_lines AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines WHERE line <> ''),
windows AS (
  SELECT doc_id, k, md5(line || chr(10) || n1 || chr(10) || n2) AS h
  FROM (SELECT *, lead(line, 1) OVER w AS n1, lead(line, 2) OVER w AS n2 FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE n2 IS NOT NULL),
repeats AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS r FROM windows) WHERE r > 1),
covered AS (SELECT DISTINCT doc_id, k + j AS k FROM repeats, (VALUES (0), (1), (2)) AS o(j)),
counted AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
full_counts AS (SELECT doc_id, count(*) AS n FROM full_lines GROUP BY doc_id),
left_over AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) r
  LEFT JOIN full_lines f ON f.doc_id = r.doc_id AND f.i = r.i
  LEFT JOIN covered c ON c.doc_id = r.doc_id AND c.k = f.k
  WHERE c.k IS NULL GROUP BY r.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE coalesce(f.n, 0) END AS n_lines, coalesce(c.n, 0) AS n_removed,
  CAST(length(t.text) AS BIGINT) AS n_chars, md5(t.text) AS text_md5
FROM documents d LEFT JOIN full_counts f USING (doc_id) LEFT JOIN counted c USING (doc_id)
CROSS JOIN LATERAL (SELECT CASE WHEN d.text IS NULL THEN NULL WHEN coalesce(c.n, 0) = 0 THEN d.text WHEN c.n = f.n THEN '' ELSE coalesce((SELECT l.text FROM left_over l WHERE l.doc_id = d.doc_id), '') END AS text) t
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op7_line_dedup": _LINE_DEDUP_SQL}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
