"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, LF, VT, FF, CR.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has more than this share of all rows; so at most this many keys are.
HOT_KEYS = 1000
#: A table that is broadcast has at most this many bytes (as text); larger rows of hot keys are
#: copied for each of SALTS parts of their key's rows.
BROADCAST_BYTES, SALTS = 32 << 20, 64


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share: the
    session's ``spark.checkpoint.dir``.  Only where that is unset and Spark runs
    on this machine alone (tests) a temporary folder is chosen."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rastertables-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts the
    lineage, and the rows survive lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to Python at once; a larger row goes alone.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send rows to Python in batches of at most BATCH_BYTES: long texts are
    held twice, by the JVM outside its heap and by Python."""
    if int(spark.conf.get(BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")


def split_join(rows: DataFrame, table: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row for each ``key``, which is never
    null; ``size`` says how many of the rows have it) so that no key lands in
    one task.  The table is a stored one; small tables are broadcast.

    The keys that have more than 1 / HOT_KEYS of all rows are at most HOT_KEYS:
    their part of the table is broadcast and their rows stay where they are, unless
    that part is too large: then it is copied, and their rows are shuffled in parts.
    All others are shuffled on the key.
    """
    total, keys = table.agg(F.sum(size), F.count(F.lit(1))).first()
    if keys <= HOT_KEYS and _small(table):
        return rows.join(F.broadcast(table), key, how)
    large = F.col(size) * HOT_KEYS > total
    hot = table.filter(large)
    few = hot.select(key)
    if few.isEmpty():
        return rows.join(table, key, how)
    usual = rows.join(F.broadcast(few), key, "left_anti").join(table.filter(~large), key, how)
    if _small(hot):
        return usual.unionByName(rows.join(F.broadcast(hot), key))
    parts = rows.join(F.broadcast(few), key, "left_semi").withColumn("l_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = hot.withColumn("l_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return usual.unionByName(parts.join(copies, [key, "l_salt"]).drop("l_salt"))


def _small(table: DataFrame) -> bool:
    """Whether a table of at most HOT_KEYS rows may be broadcast."""
    return (table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def with_own_names(docs: DataFrame, work: Callable[[DataFrame], DataFrame], own: tuple[str, ...] = ("doc_id", "text", "source")) -> DataFrame:
    """``work`` on ``docs``, whose columns besides ``own`` are renamed meanwhile, so that they
    may have any name."""
    plain = {c: c if c in own else f"column{i}" for i, c in enumerate(docs.columns)}
    out = work(docs.select(*[F.col(f"`{c}`").alias(p) for c, p in plain.items()]))
    return out.select(*[F.col(p).alias(c) for c, p in plain.items()])


#: Bits of one bitmap, and how many bitmaps a filter has at most (16 MB in all).
MAP_BITS, MAPS = 1 << 15, 4096


class Likely:
    """Which rows may have a wanted hash: a filter of a bounded size.

    The filter has one bit for each of at most MAP_BITS * MAPS classes of
    hashes, in bitmaps of 4 KB, and is broadcast: 16 MB whatever the tables'
    sizes.  Every wanted row passes; others pass the more often the more hashes
    are wanted, so what follows must be right for all rows and only gains by
    few.  Large rows that do not pass need no shuffle.
    """

    def __init__(self, hashes: DataFrame, name: str):
        """``hashes``: a stored table whose only column holds the wanted hashes (longs)."""
        h = F.col(hashes.columns[0])
        self.maps = max(1, min(MAPS, -(-hashes.count() * 64 // MAP_BITS)))
        bits = hashes.select(self._map(h).alias("l_map"), self._bit(h).alias("l_bit"))
        self.table = stored(bits.groupBy("l_map").agg(F.bitmap_construct_agg("l_bit").alias("l_bits")), name)

    def _map(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.maps))

    def _bit(self, h: Column) -> Column:
        return F.pmod(F.shiftright(h, 20), F.lit(MAP_BITS))

    def mark(self, rows: DataFrame, h: Column, out: str) -> DataFrame:
        """``rows`` with the boolean column ``out``: whether ``h`` may be wanted."""
        joined = rows.withColumn("l_h", h)
        joined = joined.join(F.broadcast(self.table), self._map(F.col("l_h")) == F.col("l_map"), "left")
        bit = self._bit(F.col("l_h"))
        byte = F.conv(F.hex(F.substr(F.col("l_bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))
        return joined.withColumn(out, F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False))).drop("l_h", "l_map", "l_bits")


def text_or_empty(col: Column | str = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def word_count(col: Column | str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col) if isinstance(col, str) else col, F.lit(WORDS)), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
