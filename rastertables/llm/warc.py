"""WARC archives: writing gzip members, and a splittable reader.

Writer: each task writes the records of its partition, one gzip member each, to
a file of its own name in the shared folder; only files that a finished task
names are read, so a task that is run again leaves no duplicates.

Reader: files are cut into byte ranges.  A task scans its range for the gzip
magic, takes a candidate for a member only if it decodes to a WARC header, and
owns the records that start inside its range, reading past its end where a
record does.  Magic bytes inside compressed data are thus no trouble.

Defined cases: null html is the empty payload; rows with the same page_id are
records of their own (of equal payloads under one page_id, all are responses); a null page_id is written and read as null and is the
smallest; other columns are ignored; no rows give no records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Likely, shared_dir, split_join, stored, text_or_empty

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Bytes of an archive that one task scans, and that are read at a time.
RANGE, CHUNK = 4 << 20, 1 << 18
MAGIC = b"\x1f\x8b\x08"
EPOCH = "2024-01-01T00:00:00Z"
ROW = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _record(row) -> bytes:
    """One record: its headers, a blank line, the block, two blank lines."""
    name = lambda i: f"<urn:page:{'null' if pd.isna(i) else int(i)}>"
    payload = row.html.encode("utf-8", "replace")
    revisit = row.kind == "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {row.kind}", f"WARC-Record-ID: {name(row.page_id)}", f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {'' if row.url is None else ''.join(row.url.splitlines())}", f"WARC-Payload-Digest: sha1:{row.digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(row.first_id)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str) -> list[tuple[str, int]]:
    """Write a record per row of ``pages`` below ``folder``; the archives' paths and sizes.
    Of equal payloads of LEAST bytes or more, the one of the largest page_id is
    the response that the others revisit."""
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= LEAST
    # Which rows revisit is decided on narrow rows; the pages themselves move only
    # where their digest is likely to repeat.
    narrow = stored(rows.filter(large).select("page_id", "digest"), "warc-digests")
    first = narrow.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("same"))
    first = stored(first.filter("same > 1"), "warc-repeated")
    likely = Likely(stored(first.select(F.xxhash64("digest")), "warc-hashes"), "warc-likely")
    marked = likely.mark(rows, F.xxhash64("digest"), "w_likely").withColumn("w_likely", F.col("w_likely") & large)
    none = [F.lit(None).cast(dict(first.dtypes)["first_id"]).alias("first_id"), F.lit(None).cast("long").alias("same")]
    alone = marked.filter("NOT w_likely").select("page_id", "url", "html", "digest", *none)
    again = split_join(marked.filter("w_likely"), first, "digest", "same", "left").select("page_id", "url", "html", "digest", "first_id", "same")
    rows = alone.unionByName(again)
    rows = rows.withColumn("kind", F.when(F.col("same").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")), "response").otherwise("revisit"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _filesystem(folder)
        path, out = f"{base}/{uuid.uuid4().hex}.warc.gz", None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(packer.compress(_record(row)) + packer.flush())
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [system.get_file_info(path).size]})

    listed = rows.select("page_id", "url", "html", "digest", "kind", "first_id").mapInPandas(run, "path string, bytes long")
    # One row per archive; these names are what the driver must know to read them.
    names = shared_dir(pages.sparkSession, "warc-names")
    listed.write.parquet(names)
    return [(r.path, r.bytes) for r in pages.sparkSession.read.schema("path string, bytes long").parquet(names).collect()]


class _Range:
    """Bytes of a file from ``start`` on, read in chunks as they are asked for."""

    def __init__(self, file, start: int):
        self.file, self.base, self.data, self.done = file, start, b"", False
        file.seek(start)

    def upto(self, end: int) -> bool:
        """Have the bytes before ``end`` in memory; False at the end of the file."""
        while not self.done and self.base + len(self.data) < end:
            chunk = self.file.read(CHUNK)
            self.done = not chunk
            self.data += chunk
        return self.base + len(self.data) >= end

    def drop(self, start: int) -> None:
        self.data, self.base = self.data[start - self.base :], start


def _member(source: _Range, at: int) -> tuple[bytes, int] | None:
    """The decoded gzip member at ``at`` and where it ends; None if it is none
    or does not begin with a WARC header."""
    unpacker, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            if not source.upto(pos + 1):
                return None
            piece = source.data[pos - source.base : pos - source.base + CHUNK]
            out.append(unpacker.decompress(piece))
            pos += len(piece)
            if out and len(out[0]) >= 5 and not out[0].startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    body = b"".join(out)
    return (body, pos - len(unpacker.unused_data)) if body.startswith(b"WARC/") else None


def scan_range(file, start: int, end: int) -> Iterator[bytes]:
    """Decoded records whose member starts in [start, end)."""
    source, at = _Range(file, start), start
    while at < end:
        source.upto(at + CHUNK)
        hit = source.data.find(MAGIC, at - source.base)
        if hit < 0:
            at = max(at, source.base + len(source.data) - len(MAGIC) + 1)
            if source.done:
                return
            source.drop(at)
            continue
        at = source.base + hit
        if at >= end:
            return
        found = _member(source, at)
        if found:
            yield found[0]
        at = found[1] if found else at + 1
        source.drop(min(at, source.base + len(source.data)))


def _parsed(record: bytes) -> dict:
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda s: None if s is None or "null" in s else int(s.strip("<>").rpartition(":")[2])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "payload_bytes": None if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "url": fields["WARC-Target-URI"], "payload": None if revisit else payload,
    }


def read_warc(spark: SparkSession, folder: str, archives: list[tuple[str, int]], step: int = RANGE) -> DataFrame:
    """The records of ``archives`` (paths and sizes): page_id, record_type,
    payload_bytes, payload_digest, refers_to, url, payload (null for revisits)."""
    files = spark.createDataFrame(archives, "path string, bytes long")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(step).cast("long"))).alias("start"))
    count = max(1, sum(-(-n // step) for _, n in archives))
    ranges = ranges.repartition(count)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                with system.open_input_file(path) as file:
                    rows, size = [], 0
                    for record in scan_range(file, start, start + step):
                        rows.append(_parsed(record))
                        size += len(record)
                        if size > 8 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                    if rows:
                        yield _frame(rows)

    return ranges.mapInPandas(run, ROW)


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows)
    return frame.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` and read the archives back; a revisit's payload size is
    that of the response it refers to."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    archives = write_warc(pages, folder)
    records = read_warc(spark, folder, archives).drop("payload")
    records = stored(records, "warc-records")
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes")
    # Only what revisits refer to is looked up, and large groups are not one task.
    asked = revisits.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("asked"))
    sizes = records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    sizes = stored(asked.join(sizes, "payload_digest", "left"), "warc-sizes")
    found = split_join(revisits, sizes, "payload_digest", "asked", "left").drop("asked")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.filter("record_type <> 'revisit'").select(*columns).unionByName(found.select(*columns))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT payload_digest AS f_digest, max(page_id) AS first_id FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON payload_digest = f_digest AND payload_bytes >= 1000
"""
