"""Importance resampling towards a target distribution of hashed n-grams.

Features of a text are all runs of ``low`` to ``high`` consecutive words, hashed
by CRC-32 into buckets.  Each text is scanned once: of its normalised form (words
behind one separator each) only the running CRC before and after every word is
kept.  The CRC of any run of words follows from two of these prefixes, as CRC is
linear over GF(2): the earlier prefix, shifted by the run's length in bytes, is
cancelled from the later one.  So longer runs cost no further look at the text.

The scan stores each text's buckets.  Their counts in the corpus and in the target
give a gain for each bucket; a text's weight is the sum of its features' gains,
and the texts with the highest weight plus Gumbel noise, seeded by doc_id, are
drawn: a sample without replacement in proportion to the importance weights.

Defined cases: a null text has no words; texts with fewer than ``least`` words
have a weight and a score, and are never drawn; a null doc_id is hashed as the empty
string and comes last among ties; rows that repeat are drawn one by one; no rows
give no rows; an empty target gives every bucket the gain of its absence; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tiling import with_index
from .common import small_batches, stored

#: Bytes that belong to words, A-Z lower-cased; all others separate.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_PIECES = re.compile(rb" [^ ]+")
#: Rows that are scanned together, and bytes of a text that are split into words at once.
ROWS, SLICE = 256, 1 << 20


def _crc_table() -> np.ndarray:
    """The CRC of each byte by the reflected polynomial of CRC-32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


_TABLE = _crc_table()


def _after(crc: np.ndarray, byte: int) -> np.ndarray:
    """CRCs of byte strings with one more byte."""
    state = ~crc
    return ~(_TABLE[(state ^ np.uint32(byte)) & 0xFF] ^ (state >> np.uint32(8)))


def _zeros_tables(powers: int = 32) -> np.ndarray:
    """For each power k the operator that shifts a CRC by 2^k bytes, as its values
    for the 256 values of each of the CRC's four bytes: (powers, 4, 256)."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    columns = _TABLE[bits & 0xFF] ^ (bits >> np.uint32(8))  # of one zero byte
    out = np.zeros((powers, 4, 256), np.uint32)
    for k in range(powers):
        for byte in range(4):
            for bit in range(8):
                on = (np.arange(256) >> bit & 1).astype(bool)
                out[k, byte, on] ^= columns[8 * byte + bit]
        columns = _apply(out[k], columns)  # the operator after itself
    return out


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][crc >> np.uint32(8) & 0xFF] ^ table[2][crc >> np.uint32(16) & 0xFF] ^ table[3][crc >> np.uint32(24)]


_SHIFTS = _zeros_tables()


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """CRCs of prefixes carried over ``by`` further bytes."""
    out, by = crc.astype(np.uint32), by.astype(np.int64)
    for k in range(int(by.max(initial=0)).bit_length()):
        on = (by >> k & 1).astype(bool)
        out[on] = _apply(_SHIFTS[k], out[on])
    return out


class Prefixes:
    """Running CRCs of one text: before (start) and after (end) each of its words,
    and where these are in its normalised form."""

    def __init__(self, text: str | None):
        raw = b" " + (text or "").encode("utf-8", "replace").translate(_KEPT)
        ends, sizes, last, low = [], [], 0, 0
        while low < len(raw):
            high = raw.find(b" ", low + SLICE)
            high = len(raw) if high < 0 else high
            pieces = _PIECES.findall(raw, low, high)
            crcs = np.fromiter(accumulate(pieces, lambda crc, piece: zlib.crc32(piece, crc), initial=last), np.uint32, len(pieces) + 1)
            ends.append(crcs[1:])
            sizes.append(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            last, low = int(crcs[-1]), high
        self.end, size = np.concatenate(ends), np.concatenate(sizes)
        self.start = _after(np.concatenate([np.zeros(1, np.uint32), self.end[:-1]])[: len(self.end)], 32)
        self.end_at = np.cumsum(size)
        self.start_at = self.end_at - size + 1

    def __len__(self) -> int:
        return len(self.end)

    def ngrams(self, low: int, high: int) -> np.ndarray:
        """CRCs of all runs of low to high words, joined by one space."""
        out = [np.empty(0, np.uint32)]
        for n in range(low, min(high, len(self)) + 1):
            count = len(self) - n + 1
            length = self.end_at[n - 1 :] - self.start_at[:count]
            out.append(self.end[n - 1 :] ^ shifted(self.start[:count], length))
        return np.concatenate(out)


def stored_as(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def hashed_features(docs: DataFrame, low: int, high: int, buckets: int, name: str) -> DataFrame:
    """A stored table: doc_id, n_words, n_features and hashed (the features' buckets),
    from one scan of every text."""
    kind = stored_as(buckets)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.slice(at, ROWS)
                words, hashed = [], []
                for text in rows.column("text"):
                    prefixes = Prefixes(text.as_py())
                    words.append(len(prefixes))
                    hashed.append((prefixes.ngrams(low, high) % np.uint32(buckets)).astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(words, pa.int64()), pa.array([len(h) // kind.itemsize for h in hashed], pa.int64()), pa.array(hashed, pa.binary())], ["doc_id", "n_words", "n_features", "hashed"])

    id_type = dict(docs.dtypes)["doc_id"]
    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, hashed binary"), name)


def bucket_counts(hashed: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: how many features fall into each bucket that has any.  A task sends
    one row for each bucket at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch["hashed"]), stored_as(buckets)), minlength=buckets)
        found = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": found, "n": counts[found]})

    return hashed.select("hashed").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) for every
    bucket; s of S features of the corpus and t of T of the target are in it."""
    every = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    sums = both.agg(F.sum("s"), F.sum("t")).first()  # two numbers
    more = lambda n: (F.col(n) + 1).cast("double") if isinstance(n, str) else F.lit(float(n + buckets))
    return both.select("bucket", F.floor(F.log(more("t") * more(sums[0] or 0) / (more("s") * more(sums[1] or 0))) * 1000).cast("long").alias("gain"))


def gumbel(seed: str) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 8 hex digits of the sha-256 of seed:doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, low: int = 1, high: int = 1, buckets: int = 10_000, least: int = 20, seed: str = "2024") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank (from 1, of
    the ``percent`` % of the documents with ``least`` words that are drawn, else
    null), against the texts of ``target``.  The gains, one number a bucket, are the
    only table that goes through the driver."""
    hashed = hashed_features(docs, low, high, buckets, "resampling-features")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    counts = bucket_counts(hashed, buckets), bucket_counts(hashed_features(wanted, low, high, buckets, "resampling-target"), buckets)
    gains, kind = np.zeros(buckets, np.int64), stored_as(buckets)
    for bucket, gain in bucket_gains(*counts, buckets).collect():
        gains[bucket] = gain

    @F.pandas_udf("long")
    def weight(part: pd.Series) -> pd.Series:
        return part.map(lambda h: int(gains[np.frombuffer(h, kind)].sum())).astype("int64")

    scored = hashed.select("doc_id", "n_features", weight("hashed").alias("weight"), (F.col("n_words") >= least).alias("may"))
    scored = stored(scored.withColumn("score", F.col("weight") + gumbel(seed)), "resampling-scores")
    drawn = scored.filter("may").count() * percent // 100
    ranked = with_index(scored, [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank"))


#: CRC-32 of each word byte by byte, with a table of its 256 steps.
RESAMPLING_SQL = """
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
f AS (
  SELECT doc_id, unnest(words) AS w, TRUE AS own FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents)
  UNION ALL
  SELECT NULL, unnest(words), FALSE FROM (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark)),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM f)),
c AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
         lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM h, steps),
n AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN c USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
d AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN c USING (w) JOIN g USING (bucket) WHERE own GROUP BY doc_id),
s AS (
  SELECT documents.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (doc_id)
"""
