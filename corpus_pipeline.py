"""The corpus pipeline: stages that turn ``documents`` into token ids.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame; all but the last return the columns of ``documents``.

For all stages: rows are told by their own content or number, never by doc_id
alone, so null and repeated doc_ids lose no other row; a null text is the empty
text; texts are read whole, however long; further columns are kept as they are;
no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastertables.llm import common, exact_dedup, mixing, ngram_join, pieces, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not toxic, in one pass.  Empty texts stay; equal texts
    stay or go together; columns of any name are kept."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of those with equal normalised text: the least doc_id, a null one
    last; of rows that repeat one stays.  Further columns may have any name."""
    return exact_dedup.drop_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the least doc_id, null ones last.
    Texts without words resemble nothing and stay.  Further columns may have any name."""
    return ngram_join.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, 0 to 3 times.  A null source is a source;
    texts without words are never taken; rows that repeat in all columns are taken
    equally often.  Further columns may have any name."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with ids and exact instead of the text; an empty text has no ids.
    These take the place of columns of the input that are named ids or exact."""
    return pieces.encode(docs.drop("ids", "exact"))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_jaccard_join", remove_near_copies),
    ("source_mix", mix_sources),
    ("sentencepiece", encode),
]

#: Classifier, MinHash and token ids have no SQL form; tests/llm/test_pipeline.py
#: holds every stage against a plain Python version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows stored for the next."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
