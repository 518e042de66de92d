"""Exchange of parts between the blocks of large images.

A block table holds image_id, y0, x0, h, w, channels, dtype, pixels (row-major bytes);
blocks lie on a grid of ``block`` pixels, ragged at the far edges.  The block at
(y0, x0) is the cell (y0 / block, x0 / block).  A part is a rectangle of pixels that is
sent to a cell: a block itself, the strip of it that a neighbour needs, or what a tile
or a finer level covers of the cell.  Only parts are shuffled, never pixel rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CELL = ["image_id", "cy", "cx"]
PLACE = "y long, x long, h int, w int, channels int, dtype string, pixels binary"
#: Rows of a batch that are unpacked together.
ROWS = 64


def kind_of(df: DataFrame, column: str = "image_id") -> str:
    return dict(df.dtypes)[column]


def as_array(row: dict) -> np.ndarray:
    return np.frombuffer(row["pixels"], np.dtype(row["dtype"])).reshape(row["h"], row["w"], row["channels"])


def fields(a: np.ndarray) -> dict:
    return {"h": a.shape[0], "w": a.shape[1], "channels": a.shape[2], "dtype": a.dtype.str if a.dtype.byteorder == ">" else a.dtype.name, "pixels": np.ascontiguousarray(a).tobytes()}


def each_row(batches: Iterator[pa.RecordBatch], per: int = ROWS) -> Iterator[list[dict]]:
    """The rows of a task as lists of at most ``per`` dicts."""
    for batch in batches:
        for at in range(0, len(batch), per):
            yield batch.slice(at, per).to_pylist()


def mapped(rows: DataFrame, work: Callable[[Iterator[list[dict]]], Iterator[list[dict]]], schema: str | StructType, per: int = ROWS) -> DataFrame:
    """``rows`` through ``work``, which gets lists of dicts and gives such lists, or columns as
    a dict of arrays."""
    like = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names, form = like.names, to_arrow_schema(like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in work(each_row(batches, per)):
            if isinstance(out, dict):
                yield pa.RecordBatch.from_arrays([pa.array(out[n], form.field(n).type) for n in names], schema=form)
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], form.field(n).type) for n in names], schema=form)

    return rows.mapInArrow(run, like)


def cells(first: int, n: int, block: int, before: int, after: int) -> range:
    """Cells along one axis whose area, wider by ``before`` and ``after``, meets [first, first + n)."""
    return range(max(0, -(-(first - block + 1 - after) // block)), (first + n - 1 + before) // block + 1)


def send(blocks: DataFrame, block: int, name: str, before: int = 0, after: int = 0, dy: int = 0, dx: int = 0, others: bool = False) -> DataFrame:
    """Parts of ``blocks`` for each cell: what lies in its area, ``before`` pixels wider
    above and left and ``after`` below and right.  Pixels are first moved by (-dy, -dx).
    With ``others`` a block sends nothing to its own cell."""

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for r in rows:
                a, y0, x0 = as_array(r), r["y0"] - dy, r["x0"] - dx
                for cy in cells(y0, r["h"], block, before, after):
                    ya, yb = max(y0, cy * block - before), min(y0 + r["h"], (cy + 1) * block + after)
                    for cx in cells(x0, r["w"], block, before, after):
                        if others and (cy, cx) == (r["y0"] // block, r["x0"] // block):
                            continue
                        xa, xb = max(x0, cx * block - before), min(x0 + r["w"], (cx + 1) * block + after)
                        out.append({"image_id": r["image_id"], "cy": cy, "cx": cx, "name": name, "y": ya, "x": xa, **fields(a[ya - y0 : yb - y0, xa - x0 : xb - x0])})
            yield out

    rows = blocks.select("image_id", "y0", "x0", "h", "w", "channels", "dtype", "pixels")
    return mapped(rows, work, f"image_id {kind_of(blocks)}, cy long, cx long, name string, {PLACE}")


def met(*sent: DataFrame) -> DataFrame:
    """image_id, cy, cx, parts: the parts of each cell.  ``send`` makes a bounded number of
    them for a cell, by the reach and the block's size."""
    every = sent[0]
    for s in sent[1:]:
        every = every.unionByName(s)
    return every.groupBy(*CELL).agg(F.collect_list(F.struct("name", "y", "x", "h", "w", "channels", "dtype", "pixels")).alias("parts"))


def found(parts: list[dict], name: str) -> list[dict]:
    return [p for p in parts if p["name"] == name]


def placed(parts: list[dict], y: int, x: int, h: int, w: int, fill: float, kind: str | None = None) -> np.ndarray:
    """The h x w area from (y, x) with the pixels of ``parts``, ``fill`` where there are none."""
    out = np.full((h, w, parts[0]["channels"] if parts else 1), fill, np.dtype(kind or parts[0]["dtype"]))
    for p in parts:
        ya, yb, xa, xb = max(y, p["y"]), min(y + h, p["y"] + p["h"]), max(x, p["x"]), min(x + w, p["x"] + p["w"])
        if ya < yb and xa < xb:
            out[ya - y : yb - y, xa - x : xb - x] = as_array(p)[ya - p["y"] : yb - p["y"], xa - p["x"] : xb - p["x"]]
    return out


def folded(parts: DataFrame, order: list[str], start: Callable[[dict], object], add: Callable[[object, dict], None], done: Callable[[dict, object], dict], schema: str) -> DataFrame:
    """One row for each cell from all its parts in ``order``: ``start`` makes a state from the
    first, ``add`` puts each into it and ``done`` gives the row.  Parts stream through
    the task one after the other, so a cell may have any number of them."""

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        key, state, last = None, None, None
        for rows in lists:
            out = []
            for r in rows:
                here = tuple(r[c] for c in CELL)
                if here != key:
                    if key is not None:
                        out.append(done(last, state))
                    key, state = here, start(r)
                add(state, r)
                last = r
            yield out
        if key is not None:
            yield [done(last, state)]

    dealt = parts.repartition(*CELL).sortWithinPartitions(*CELL, *order)
    return mapped(dealt, work, schema)
