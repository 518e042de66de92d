"""Incremental ingest of tile manifests (ST1, S11)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import filter_invalid
from ..operators.splits import split_by_group

KEY = ["observation_id", "row", "col"]
#: State is kept on the executors' disks and in the checkpoint, not on their heaps.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rebuild_index(spark: SparkSession, root: str, fraction: float, least: int, seed: str) -> DataFrame:
    """(observation_id, split) of everything ingested so far, from the observations that
    each batch has noted: one row for an observation and batch, not one for a tile."""
    return split_by_group(spark.read.parquet(f"{root}/observations"), "observation_id", fraction, least, seed)


def index_counts(spark: SparkSession, root: str) -> DataFrame:
    """One row: crops and observations ingested so far, from the batches' counts."""
    noted = spark.read.parquet(f"{root}/observations").groupBy("observation_id").agg(F.sum("n_crops").alias("n"))
    return noted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_crops"), F.count(F.lit(1)).alias("n_observations"))


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The splits of the last run that was finished."""
    rows = spark.read.parquet(f"{root}/splits")
    return rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def ingest_incremental(stream: DataFrame, root: str, checkpoint: str, most_invalid: float = 0.01, fraction: float = 0.02, least: int = 20, seed: str = "42") -> None:
    """Append newly arrived manifest rows that pass quality control, each tile once, and
    write the splits when all that has arrived is in.

    Which tiles are known is keyed state of the stream, so a batch reads its own rows
    only, however much has been ingested; rows that come again change nothing, and of rows
    with one key in a batch any one stays.  Each batch has folders of its own below
    ``crops`` and ``observations``; a batch that is run again replaces these only.  The
    splits are made of the observations, and are a folder of their own as well."""
    spark, last = stream.sparkSession, []

    def batch(rows: DataFrame, number: int) -> None:
        own = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{root}/crops/batch={number}")
        noted = own.read.schema(rows.schema).parquet(f"{root}/crops/batch={number}").groupBy("observation_id").agg(F.count(F.lit(1)).alias("n_crops"))
        noted.write.mode("overwrite").parquet(f"{root}/observations/batch={number}")
        last.append(number)

    new = filter_invalid(stream, most_invalid).select(*KEY, "invalid_fraction").dropDuplicates(KEY)
    with _settings(spark, STATE):
        new.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if last:
        rebuild_index(spark, root, fraction, least, seed).write.mode("overwrite").parquet(f"{root}/splits/batch={last[-1]}")
