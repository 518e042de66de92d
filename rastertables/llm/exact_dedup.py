"""Exact deduplication with keyed streaming state.

Every document becomes one narrow row (digest, identifier, locator).  A
Structured Streaming aggregation without watermark reads these rows; its state,
kept on disk by RocksDB and never expired, holds for each digest the first
identifier, where its content is (the file it was read from), and how many rows
had it.  A digest seen more than once is a hit, and the full bytes of every hit
are compared with those of the row that stays, found by identifier and locator.
Rows that share a digest but not their bytes are regrouped by their bytes.

Digests that more than a thousandth of all rows have are few; rows meet their
state without a shuffle there (``split_join``), so no group is one task.

Defined cases: a null text is the empty text; empty texts equal each other; a
null identifier sorts last, so it stays only if no other row has the text; of
repeated rows (same identifier, same text) one stays; further columns are
ignored by the decisions and kept by ``drop_copies``; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Likely, shared_dir, split_join, stored, text_or_empty, with_own_names

#: State on disk: without preallocated files, as there is a store per partition,
#: with one bounded memory for all stores of an executor, closed after each batch.
ROCKS = "spark.sql.streaming.stateStore.rocksdb."
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    ROCKS + "allowFAllocate": "false",
    ROCKS + "boundedMemoryUsage": "true",
    ROCKS + "maxMemoryUsageMB": "24",
    ROCKS + "writeBufferSizeMB": "2",
    ROCKS + "maxWriteBufferNumber": "2",
}
#: Rows of one group that are compared with one copy of the text that stays.
ROWS_PER_SALT = 64


def normalised(text: Column | str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def keyed_state(keys: DataFrame, checkpoint: str) -> DataFrame:
    """Run the streaming aggregation over a stream of (digest, doc_id, row_id,
    locator) rows until its source is used up, and return the state:
    digest, first (struct of null_id, doc_id, row_id, locator), group_size.

    Called again with the same checkpoint and a source that has grown, it goes
    on where it stopped.
    """
    spark = keys.sparkSession
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        groups = keys.groupBy("digest").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row_id", "locator")).alias("first"),
            F.count(F.lit(1)).alias("group_size"),
        )
        query = groups.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    first, size = (f"value.`{n}`" for n in state.schema["value"].dataType.names)
    return state.select(F.col("key.digest").alias("digest"), F.col(first).alias("first"), F.col(size).alias("group_size"))


def _raw_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("string"), docs["text"])


def dedup_decisions(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, keep_id, group_size, kept,
    raw (a hash of identifier and text as they are)."""
    spark = docs.sparkSession
    path, checkpoint = shared_dir(spark, "dedup-keys"), shared_dir(spark, "dedup-state")
    raw = _raw_hash(docs).alias("raw")
    keys = docs.select("doc_id", digest(normalised()).alias("digest"), F.monotonically_increasing_id().alias("row_id"), F.input_file_name().alias("locator"), raw)
    keys.write.parquet(path)
    state = stored(keyed_state(spark.readStream.schema(keys.schema).parquet(path), checkpoint), "dedup-groups")
    rows = spark.read.schema(keys.schema).parquet(path)
    decided = split_join(rows, state, "digest", "group_size")
    decided = decided.select(
        "doc_id", "digest", "row_id", "locator", "raw", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("keep_locator"), "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
    )
    decided = stored(decided, "dedup-decided")
    odd = _differing_hits(docs, decided, digest)
    if odd.groupBy().count().first()[0]:
        decided = _regrouped(decided, odd)
    return decided.select("doc_id", "digest", "keep_id", "group_size", "kept", "raw")


def _differing_hits(docs: DataFrame, decided: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Hits whose full bytes differ from those of the row that stays: doc_id,
    digest, text.  The text that stays is copied once for ROWS_PER_SALT rows of
    its group, so a large group is spread over many tasks."""
    salts = F.ceil(F.col("group_size") / ROWS_PER_SALT).cast("int")
    hits = decided.filter("group_size > 1")
    likely = Likely(stored(hits.select("raw").distinct(), "dedup-hits"), "dedup-likely")
    # Rows that repeat doc_id, text and file are one place; a place that most rows share stays in
    # the tasks that read it.
    place = F.concat_ws(":", F.hex("digest"), F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null")), F.md5("locator"))
    hits = hits.withColumn("place", place).groupBy("place", "doc_id", "digest", "locator", "keep_id", "keep_locator", salts.alias("salts")).agg(F.count(F.lit(1)).alias("rows"))
    hits = stored(hits, "dedup-places")
    # Only texts that are likely hits are normalised again and moved.
    texts = likely.mark(docs.select("doc_id", "text", F.input_file_name().alias("d_locator")), _raw_hash(docs), "d_likely").filter("d_likely")
    texts = texts.select("doc_id", F.col("d_locator").alias("locator"), normalised().alias("d_text")).withColumn("digest", digest(F.col("d_text")))
    hits = split_join(texts.withColumn("place", place).select("place", "d_text"), hits, "place", "rows")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("locator") == F.col("keep_locator"))
    first = (
        hits.filter(stays).groupBy("digest", "salts").agg(F.min("d_text").alias("first_text"))
        .select(F.col("digest").alias("f_digest"), "first_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("f_salt"))
    )
    salted = hits.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts")).cast("int"))
    pairs = salted.join(first, (F.col("digest") == F.col("f_digest")) & (F.col("salt") == F.col("f_salt")))
    return pairs.filter(F.col("d_text") != F.col("first_text")).select("doc_id", "digest", F.col("d_text").alias("text"))


def _regrouped(decided: DataFrame, odd: DataFrame) -> DataFrame:
    """Decisions after the rows of ``odd`` form groups of their own bytes."""
    odd = odd.distinct().select(F.col("doc_id").alias("o_id"), F.col("digest").alias("o_digest"), "text")
    own = decided.join(odd, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("digest") == F.col("o_digest")))
    groups = own.groupBy("digest", "text").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("f"), F.count(F.lit(1)).alias("n"))
    fixed = own.join(groups, ["digest", "text"]).select("row_id", F.col("f.doc_id").alias("k"), F.col("n"), (F.col("row_id") == F.col("f.row_id")).alias("s"))
    fewer = own.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    out = decided.join(fixed, "row_id", "left").join(fewer, "digest", "left")
    moved = F.col("n").isNotNull()
    return out.select(
        "doc_id", "digest", "row_id", "raw", F.when(moved, F.col("k")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(moved, F.col("n")).otherwise(F.col("group_size") - F.coalesce("less", F.lit(0))).alias("group_size"),
        F.when(moved, F.col("s")).otherwise(F.col("kept")).alias("kept"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, which may have any name."""
    return with_own_names(docs, _without_copies)


def _without_copies(docs: DataFrame) -> DataFrame:

    def key(digest: Column) -> Column:
        return F.concat_ws(":", F.hex(digest), F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null")))

    decided = dedup_decisions(docs)
    marks = decided.groupBy(key(F.col("digest")).alias("k_key")).agg(F.max("kept").alias("k_stays"), F.count(F.lit(1)).alias("k_rows"))
    marks = stored(marks.filter("NOT k_stays OR k_rows > 1"), "dedup-marks")
    # Rows that are alone in their group pass without being looked up.
    likely = Likely(stored(decided.filter("group_size > 1").select("raw").distinct(), "dedup-hits"), "dedup-likely")
    keyed = likely.mark(docs, _raw_hash(docs), "k_likely")
    marked = split_join(keyed.filter("k_likely").withColumn("k_key", key(sha256(normalised()))), marks, "k_key", "k_rows", "left")
    out = keyed.filter("NOT k_likely").unionByName(marked.filter("k_rows IS NULL").select(*keyed.columns))
    if not marks.filter("k_stays").isEmpty():
        out = out.unionByName(marked.filter("k_stays").dropDuplicates(["k_key"]).select(*keyed.columns))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
