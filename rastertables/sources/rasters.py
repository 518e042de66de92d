"""Raster files as listings, inventories and block tables."""

from __future__ import annotations

import fnmatch
import io
import itertools
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators.tiling import count_candidates
from .shared import stored

SUFFIXES = ("jp2", "tif", "tiff", "vrt", "npy")
BLOCK_SCHEMA = "path string, image_id string, y0 long, x0 long, h int, w int, channels int, dtype string, pixels binary, error string"
#: (suffix, decoder) in the order they are tried; a decoder takes a file's bytes.
_DECODERS: list[tuple[str, Callable[[bytes], np.ndarray]]] = []


def register_decoder(suffix: str, decode: Callable[[bytes], np.ndarray]) -> None:
    """Decoders of a suffix are tried in the order of their registration."""
    _DECODERS.append((suffix.lower(), decode))


register_decoder("npy", lambda raw: np.load(io.BytesIO(raw), allow_pickle=False))


def channels_last(a: np.ndarray) -> np.ndarray:
    """H x W x C of an array that may lack channels or have them first."""
    if a.ndim == 2:
        return a[:, :, None]
    if a.ndim != 3:
        raise ValueError(f"a raster of {a.ndim} axes")
    return np.moveaxis(a, 0, -1) if a.shape[0] <= 16 and min(a.shape[1:]) > 16 else a


def _wanted(files: DataFrame, pattern: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(name.rlike(rf"(?i)\.({'|'.join(SUFFIXES)})$") & name.rlike("(?i)^" + fnmatch.translate(pattern)))


def _files(spark: SparkSession, directory: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)


def discover_rasters(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, length) of raster files whose name matches, in path order; the
    contents are not read."""
    return _wanted(_files(spark, directory, recursive), pattern).select("path", "length").orderBy("path")


def _decoded(path: str, raw: bytes, decoders: list) -> np.ndarray:
    """By the first decoder that works; the error names every failure."""
    failures = []
    for suffix, decode in decoders:
        if path.lower().endswith("." + suffix):
            try:
                return channels_last(decode(raw))
            except Exception as e:
                failures.append(f"{suffix}: {e}")
    raise ValueError("; ".join(failures) or "no decoder for this suffix")


def _system(path: str):
    """The file system of a path or URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _opened(path: str):
    system, inside = _system(path)
    return system.open_input_file(inside)


HEADER_SCHEMA = "path string, length long, image_id string, height long, width long, channels int, dtype string, at long, layout string, error string"


def _image_id(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _header(path: str, length: int) -> dict:
    """What the first bytes of a .npy file say; layout is ``last`` or ``first`` (of the
    channels), or ``whole`` for what can't be read by ranges."""
    out = {"path": path, "length": length, "image_id": _image_id(path), "layout": "whole"}
    with _opened(path) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](f)
        if fortran or dtype.hasobject or len(shape) not in (2, 3):
            return out
        first = len(shape) == 3 and shape[0] <= 16 and min(shape[1:]) > 16
        shape = (*shape, 1) if len(shape) == 2 else (*shape[1:], shape[0]) if first else shape
        return out | {"height": shape[0], "width": shape[1], "channels": shape[2], "dtype": dtype.str, "at": f.tell(), "layout": "first" if first else "last"}


def _only_builtin(suffix: str) -> bool:
    return sum(s == suffix for s, _ in _DECODERS) == 1


def raster_headers(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """HEADER_SCHEMA of all matching files, from their first bytes, read where the file's
    row is.  A file of another format than .npy, or of one with a decoder of one's own, has
    the layout ``whole`` and no size; one without a decoder has an error."""
    known, ranged = {s for s, _ in _DECODERS}, _only_builtin("npy")
    names = [c.split()[0] for c in HEADER_SCHEMA.split(", ")]

    def one(path: str, length: int) -> dict:
        suffix = path.rsplit(".", 1)[-1].lower()
        if suffix == "npy" and ranged:
            try:
                return _header(path, length)
            except Exception as e:
                return {"path": path, "length": length, "image_id": _image_id(path), "error": f"npy: {e}"}
        error = {} if suffix in known else {"error": "no decoder for this suffix"}
        return {"path": path, "length": length, "image_id": _image_id(path), "layout": "whole", **error}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [one(path, length) for path, length in zip(batch["path"], batch["length"], strict=True)]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return _wanted(_files(spark, directory, recursive), pattern).select("path", "length").mapInPandas(run, HEADER_SCHEMA)


#: Bytes that a task reads at once, and that it reads in all if the files are large.
READ_BYTES, TASK_BYTES = 16 << 20, 128 << 20


def planned_reads(headers: DataFrame, block: int, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """headers with a row for each range to read: y0, h, x0, w (a band of rows, as many whole
    blocks wide as READ_BYTES allow) and bytes.  Of a region (top, left, height, width) only
    what lies in it is planned."""
    top, left, height, width = region or (0, 0, 1 << 40, 1 << 40)
    size = F.regexp_extract("dtype", "[0-9]+$", 0).cast("long")
    run = F.greatest(F.lit(1), F.floor(F.lit(READ_BYTES) / (size * F.col("channels") * block * block))).cast("long") * block
    known = headers.filter("error IS NULL AND layout <> 'whole' AND height > 0 AND width > 0").withColumn("run", run).withColumn("size", size)

    def steps(low: int, n: int, full: str, step: Column) -> Column:
        end = F.least(F.col(full), F.lit(low + n))
        first = F.floor(F.lit(low) / step) * step
        return F.explode(F.when(F.lit(low) < end, F.sequence(first.cast("long"), end - 1, step.cast("long"))))

    rows = known.select("*", steps(top, height, "height", F.lit(block)).alias("by")).select("*", steps(left, width, "width", F.col("run")).alias("bx"))
    y0, x0 = F.greatest(F.col("by"), F.lit(top)), F.greatest(F.col("bx"), F.lit(left))
    rows = rows.withColumn("y0", y0).withColumn("h", F.least(F.col("by") + block, F.col("height"), F.lit(top + height)) - y0)
    rows = rows.withColumn("x0", x0).withColumn("w", F.least(F.col("bx") + F.col("run"), F.col("width"), F.lit(left + width)) - x0)
    return rows.withColumn("bytes", F.col("h") * F.col("w") * F.col("channels") * F.col("size")).drop("by", "bx", "run", "size")


def _range_of(f, r: dict) -> np.ndarray:
    """The h x w x channels of a planned read, by as few reads as its bytes are runs."""
    kind = np.dtype(r["dtype"])
    planes, per = (r["channels"], 1) if r["layout"] == "first" else (1, r["channels"])
    h, w, full = r["h"], r["w"], r["width"]
    out = np.empty((planes, h, w * per), kind)

    def take(first: int, n: int) -> np.ndarray:
        f.seek(r["at"] + first * kind.itemsize)
        raw = f.read(n * kind.itemsize)
        if len(raw) < n * kind.itemsize:
            raise ValueError("the file ends too early")
        return np.frombuffer(raw, kind)

    for plane in range(planes):
        start = plane * r["height"] * full
        if w == full:
            out[plane] = take((start + r["y0"] * full) * per, h * full * per).reshape(h, w * per)
        else:
            for y in range(h):
                out[plane, y] = take((start + (r["y0"] + y) * full + r["x0"]) * per, w * per)
    a = np.moveaxis(out, 0, -1) if r["layout"] == "first" else out[0].reshape(h, w, per)
    return a.astype(kind.newbyteorder("="))


def _blocks_of(a: np.ndarray, row: dict, block: int, y0: int = 0, x0: int = 0) -> Iterator[dict]:
    """The parts of ``a``, which lies at (y0, x0) of its image, on the grid of blocks."""
    for y in range(y0 // block * block, y0 + a.shape[0], block):
        for x in range(x0 // block * block, x0 + a.shape[1], block):
            ya, xa = max(y, y0), max(x, x0)
            part = a[ya - y0 : y + block - y0, xa - x0 : x + block - x0]
            yield row | {"y0": ya, "x0": xa, "h": part.shape[0], "w": part.shape[1], "channels": part.shape[2], "dtype": part.dtype.name, "pixels": np.ascontiguousarray(part).tobytes()}


def _frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    while part := list(itertools.islice(rows, 64)):
        yield pd.DataFrame([[r.get(n) for n in names] for r in part], columns=names, dtype=object)


def _read(reads: list[dict], block: int) -> Iterator[dict]:
    """The blocks of planned reads; a read that fails is a row with ``error``."""
    name, f = None, None
    for r in reads:
        row = {"path": r["path"], "image_id": r["image_id"]}
        try:
            if r["path"] != name:
                name, f = r["path"], _opened(r["path"])
            a = _range_of(f, r)
        except Exception as e:
            yield {**row, "error": f"npy: {e}"}
        else:
            yield from _blocks_of(a, row, block, r["y0"], r["x0"])


def _clipped(blocks: Iterator[dict], region: tuple[int, int, int, int] | None) -> Iterator[dict]:
    """What of blocks lies in a region."""
    for r in blocks:
        if region is None or r.get("error"):
            yield r
            continue
        top, left, height, width = region
        ya, yb, xa, xb = max(r["y0"], top), min(r["y0"] + r["h"], top + height), max(r["x0"], left), min(r["x0"] + r["w"], left + width)
        if ya < yb and xa < xb:
            a = np.frombuffer(r["pixels"], np.dtype(r["dtype"])).reshape(r["h"], r["w"], r["channels"])
            part = a[ya - r["y0"] : yb - r["y0"], xa - r["x0"] : xb - r["x0"]]
            yield r | {"y0": ya, "x0": xa, "h": part.shape[0], "w": part.shape[1], "pixels": np.ascontiguousarray(part).tobytes()}


def read_blocks(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = False, block: int = 512, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The block table of all matching files (BLOCK_SCHEMA), or of the part of each that lies
    in ``region`` (top, left, height, width).

    Of .npy files the headers are read first, then byte ranges, dealt over tasks by their
    size: a file is as many tasks as it has TASK_BYTES, and what lies outside the region is
    not read.  Files that only a decoder of one's own can read are decoded whole, one in a
    task.  A file or range that can't be read is one row with ``error``."""
    headers = stored(raster_headers(spark, directory, pattern, recursive), "raster-headers")
    reads = planned_reads(headers, block, region)
    total, n = reads.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    tasks = max(1, min(n, 100_000, max(-(-(total or 0) // TASK_BYTES), spark.sparkContext.defaultParallelism)))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(_read(batch.to_dict("records"), block))

    out = reads.repartitionByRange(tasks, "path", "y0", "x0").mapInPandas(ranges, BLOCK_SCHEMA)
    none = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in BLOCK_SCHEMA.split(", ")[2:-1])]
    out = out.unionByName(headers.filter("error IS NOT NULL").select("path", "image_id", *none, "error"))
    whole = headers.filter("error IS NULL AND layout = 'whole'").select("path")
    if whole.isEmpty():
        return out
    decoders = list(_DECODERS)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                row = {"path": path, "image_id": _image_id(path)}
                try:
                    blocks = _blocks_of(_decoded(path, raw, decoders), row, block)
                except ValueError as e:
                    blocks = iter([{**row, "error": str(e)}])
                yield from _frames(_clipped(blocks, region))

    files = _wanted(_files(spark, directory, recursive), pattern).select("path", "content")
    return out.unionByName(files.join(whole, "path", "left_semi").mapInPandas(decode, BLOCK_SCHEMA))


def read_region(blocks: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """One row per image of a block table: the part of its region of ``height`` x
    ``width`` pixels from (top, left) that lies inside it (image_id, y0, x0, h, w,
    channels, dtype, pixels).  Blocks that do not touch the region are not read
    on; images that it misses have no row."""
    meets = (F.col("y0") < top + height) & (F.col("y0") + F.col("h") > top) & (F.col("x0") < left + width) & (F.col("x0") + F.col("w") > left)
    some = blocks.filter("error IS NULL") if "error" in blocks.columns else blocks
    kind = dict(blocks.dtypes)["image_id"]

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = max(top, int(group["y0"].min())), max(left, int(group["x0"].min()))
        y1, x1 = min(top + height, int((group["y0"] + group["h"]).max())), min(left + width, int((group["x0"] + group["w"]).max()))
        first = group.iloc[0]
        out = np.zeros((y1 - y0, x1 - x0, int(first["channels"])), np.dtype(first["dtype"]))
        for r in group.itertuples(index=False):
            a = np.frombuffer(r.pixels, np.dtype(r.dtype)).reshape(int(r.h), int(r.w), int(r.channels))
            ya, yb, xa, xb = max(y0, r.y0), min(y1, r.y0 + r.h), max(x0, r.x0), min(x1, r.x0 + r.w)
            out[ya - y0 : yb - y0, xa - x0 : xb - x0] = a[ya - r.y0 : yb - r.y0, xa - r.x0 : xb - r.x0]
        return pd.DataFrame([{"image_id": first["image_id"], "y0": y0, "x0": x0, "h": out.shape[0], "w": out.shape[1], "channels": out.shape[2], "dtype": out.dtype.name, "pixels": out.tobytes()}])

    schema = f"image_id {kind}, y0 long, x0 long, h int, w int, channels int, dtype string, pixels binary"
    return some.filter(meets).groupBy("image_id").applyInPandas(joined, schema)


def raster_inventory(blocks: DataFrame, stride: int, cap: int) -> DataFrame:
    """Per raster of a block table: height, width, channels, dtype and its candidate counts."""
    sizes = blocks.filter("error IS NULL").groupBy("path", "image_id").agg(
        F.max(F.col("y0") + F.col("h")).alias("height"), F.max(F.col("x0") + F.col("w")).alias("width"), F.max("channels").alias("channels"), F.max("dtype").alias("dtype")
    )
    return count_candidates(sizes, stride, cap)


def file_inventory(spark: SparkSession, directory: str, stride: int, cap: int, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """``raster_inventory`` of files, from their headers; only files that a decoder of one's own
    reads are decoded for it."""
    headers = stored(raster_headers(spark, directory, pattern, recursive), "raster-headers")
    sized = headers.filter("error IS NULL AND height IS NOT NULL")
    kind = F.concat(F.element_at(F.create_map(*[F.lit(v) for v in itertools.chain(*KINDS.items())]), F.regexp_extract("dtype", "[a-z]", 0)), (F.regexp_extract("dtype", "[0-9]+$", 0).cast("int") * 8).cast("string"))
    out = count_candidates(sized.select("path", "image_id", "height", "width", "channels", kind.alias("dtype")), stride, cap)
    if headers.filter("error IS NULL AND height IS NULL").isEmpty():
        return out
    rest = read_blocks(spark, directory, pattern, recursive, 1 << 14).join(headers.filter("height IS NULL").select("path"), "path", "left_semi")
    return out.unionByName(raster_inventory(rest, stride, cap).select(*out.columns))


#: numpy's names of the kinds of numbers.
KINDS = {"u": "uint", "i": "int", "f": "float", "c": "complex"}


class NpyBlocks(DataSource):
    """``spark.read.format("npy_blocks").option("block", 512).load(directory)``: the block table
    of a folder's .npy files as a data source.  Partitions are byte ranges; with
    ``spark.sql.python.filterPushdown.enabled`` comparisons of image_id, path, y0 and x0
    with values leave out ranges before they are read.  Headers are read by the driver,
    so folders of very many files are better read by ``read_blocks``."""

    @classmethod
    def name(cls) -> str:
        return "npy_blocks"

    def schema(self) -> str:
        return BLOCK_SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


@dataclass
class Range(InputPartition):
    reads: list[dict]


class NpyReader(DataSourceReader):
    TESTS = {EqualTo: operator.eq, LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge}

    def __init__(self, options: dict):
        self.path, self.block, self.task_bytes = options["path"], int(options.get("block", 512)), int(options.get("task_bytes", TASK_BYTES))
        self.pattern, self.tests = options.get("pattern", "*"), []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if type(f) in self.TESTS and f.attribute[0] in ("image_id", "path", "y0", "x0"):
                self.tests.append((f.attribute[0], self.TESTS[type(f)], f.value))
            yield f  # Spark tests the rows that are read as well

    def _reads(self) -> Iterator[dict]:
        from pyarrow import fs

        system, base = _system(self.path)
        name = re.compile("(?i)^" + fnmatch.translate(self.pattern))
        for info in sorted(system.get_file_info(fs.FileSelector(base)), key=lambda i: i.path):
            if info.is_file and info.base_name.lower().endswith(".npy") and name.match(info.base_name):
                head = _header(f"file:{info.path}" if system.type_name == "local" else f"{self.path.rstrip('/')}/{info.base_name}", info.size)
                if head["layout"] == "whole":
                    raise ValueError(f"{head['path']} can't be read by ranges")
                for y in range(0, head["height"], self.block):
                    for x in range(0, head["width"], self.block):
                        r = head | {"y0": y, "x0": x, "h": min(self.block, head["height"] - y), "w": min(self.block, head["width"] - x)}
                        if all(test(r[c], value) for c, test, value in self.tests):
                            yield r

    def partitions(self) -> list[Range]:
        out, size = [], self.task_bytes
        for r in self._reads():
            n = r["h"] * r["w"] * r["channels"] * np.dtype(r["dtype"]).itemsize
            if size + n > self.task_bytes:
                out.append(Range([]))
                size = 0
            out[-1].reads.append(r)
            size += n
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
        for r in _read(partition.reads if partition is not None else [], self.block):
            yield tuple(r.get(n) for n in names)


def write_rasters(tiles: DataFrame, folder: str, form: str = "npy") -> None:
    """A file ``name`` in ``folder`` for every tile: its array in .npy form, or its
    bytes (``raw``).  A task that runs again writes the same files again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _system(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for r in batch.itertuples(index=False):
                a = np.frombuffer(r.pixels, np.dtype(r.dtype)).reshape(int(r.h), int(r.w), int(r.channels))
                buffer = io.BytesIO()
                if form == "npy":
                    np.save(buffer, a[:, :, 0] if a.shape[2] == 1 else a)
                else:
                    buffer.write(a.tobytes())
                with system.open_output_stream(f"{base}/{r.name}", compression=None) as out:
                    out.write(buffer.getvalue())
            yield pd.DataFrame({"n": [len(batch)]})

    tiles.select("name", "h", "w", "channels", "dtype", "pixels").mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()
