"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, fingerprints, html_text, licenses, mixing, ngram_join, pieces, pii, quality, resampling, toxicity, warc
from .common import documents

THRESHOLD = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup_decisions(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256 AS k, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g ON text_sha256 = k
"""


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(documents(spark, sf_dir))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encode(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "exact", "ids")


def _held_out(fold: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(False))


def _predicted(scores: DataFrame, fold: int, held: int) -> DataFrame:
    return scores.select("doc_id", _held_out(fold, held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(quality.quality_scores(documents(spark, sf_dir), _table(spark, sf_dir, "labels"), fold=5, held=0), 5, 0)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(toxicity.toxicity_scores(documents(spark, sf_dir), _table(spark, sf_dir, "labels"), fold=4, held=2), 4, 2)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_exact_dedup, op2_ngram_jaccard_join, op3_html_extraction, op4_source_mix, op5_pii, op6_sentencepiece, op7_quality, op8_fingerprints, op9_warc, op10_toxicity,
        op11_importance_resampling, op12_collocations, op13_license_scan,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL, "op4_source_mix": mixing.MIX_SQL, "op9_warc": warc.WARC_SQL,
        "op11_importance_resampling": resampling.RESAMPLING_SQL, "op12_collocations": collocations.COLLOCATIONS_SQL,
    }
