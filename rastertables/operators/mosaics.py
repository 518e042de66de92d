"""Mosaics, pyramids, prefix sums and label maps as block tables.

Each operator has one vectorised pass over blocks; between blocks only strips, edge
vectors, colours or covered rectangles are shuffled (see ``exchange``).  The forms that
take one row a pixel (``labels``, ``quality``, ``registration``) give the same values for
small tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .exchange import CELL, PLACE, as_array, fields, folded, found, kind_of, mapped, met, placed, send
from .labels import MOST_CLASSES

#: Bytes of partial cells that a task holds before it sends them on.
HELD = 64 << 20


def _block_schema(df: DataFrame, key: str = "image_id") -> str:
    return f"image_id {kind_of(df, key)}, y0 long, x0 long, h int, w int, channels int, dtype string, pixels binary"


def _block(image, y0: int, x0: int, a: np.ndarray) -> dict:
    return {"image_id": image, "y0": y0, "x0": x0, **fields(a)}


# Neighbours and other tables at the same ground.


def label_edge_blocks(labels: DataFrame, block: int) -> DataFrame:
    """Blocks of 1 where a labelled pixel differs from its right or lower neighbour, else 0.
    A block gets one column of its right neighbour and one row of its lower one."""

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for r in rows:
                own = found(r["parts"], "own")
                if own:
                    o = own[0]
                    near = placed(own + found(r["parts"], "near"), o["y"], o["x"], o["h"] + 1, o["w"] + 1, -1, "int64")[:, :, 0]
                    a, right, down = near[:-1, :-1], near[:-1, 1:], near[1:, :-1]
                    edge = (a > 0) & ((right != a) & (right >= 0) | (down != a) & (down >= 0))
                    out.append(_block(r["image_id"], o["y"], o["x"], edge.astype(np.uint8)[:, :, None]))
            yield out

    both = met(send(labels, block, "own"), send(labels, block, "near", 0, 1, others=True))
    return mapped(both, work, _block_schema(labels))


def pair_blocks(imagery: DataFrame, labels: DataFrame, block: int, off_y: int, off_x: int) -> DataFrame:
    """Imagery blocks with label_pixels (int64): the labels at the same ground, which are at
    (off_y, off_x) further in their own table; missing labels are 0."""

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for r in rows:
                for o in found(r["parts"], "own"):
                    label = placed(found(r["parts"], "label"), o["y"], o["x"], o["h"], o["w"], 0, "int64")[:, :, :1]
                    out.append({"image_id": r["image_id"], "y0": o["y"], "x0": o["x"], "label_pixels": label.tobytes(), **{k: o[k] for k in ("h", "w", "channels", "dtype", "pixels")}})
            yield out

    both = met(send(imagery, block, "own"), send(labels, block, "label", dy=off_y, dx=off_x))
    return mapped(both, work, _block_schema(imagery) + ", label_pixels binary")


# Prefix sums in two levels.


def integral_blocks(blocks: DataFrame, block: int) -> DataFrame:
    """2-D prefix sums of the first channel, as blocks of big-endian int64 (float64 for
    floats).  Blocks are summed by themselves; what lies left of and above a block comes
    as two vectors along its edges, carried over one block row and one block column."""
    image = kind_of(blocks)
    edge = f"image_id {image}, cy long, cx long, kind string, down binary, across binary"

    def sums(a: np.ndarray) -> np.ndarray:
        return a[:, :, 0].astype("float64" if a.dtype.kind == "f" else "int64")

    def edges(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for r in rows:
                a = sums(as_array(r))
                out.append({"image_id": r["image_id"], "cy": r["y0"] // block, "cx": r["x0"] // block, "kind": a.dtype.name, "down": a.sum(1).cumsum().tobytes(), "across": a.sum(0).cumsum().tobytes()})
            yield out

    narrow = stored(mapped(blocks.select("image_id", "y0", "x0", "h", "w", "channels", "dtype", "pixels"), edges, edge), "integral-edges")
    # Cells without a block have no sums of their own, but carry those of others.
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n)))
    grid = narrow.groupBy("image_id").agg(F.max("cy").alias("my"), F.max("cx").alias("mx"), F.first("kind").alias("kind"))
    grid = grid.select("image_id", "kind", "mx", upto("my").alias("cy")).select("image_id", "kind", "cy", upto("mx").alias("cx"))
    every = grid.join(narrow.drop("kind"), CELL, "left").select(*CELL, "kind", "down", "across")

    def vector(r: dict, name: str) -> np.ndarray:
        return np.frombuffer(r[name], r["kind"]) if r[name] is not None else np.zeros(1, r["kind"])

    def row(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        """left: the row sums over all blocks to the left, from the block's first row on."""
        key, total = None, None
        for rows in lists:
            for r in rows:
                if (r["image_id"], r["cy"]) != key:
                    key, total = (r["image_id"], r["cy"]), np.zeros(1, r["kind"])
                r["left"] = total.tobytes()
                total = total + vector(r, "down")
            yield rows

    rows = every.repartition("image_id", "cy").sortWithinPartitions("image_id", "cy", "cx")
    rows = mapped(rows, row, edge + ", left binary")

    def column(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        """above: the column sums over all blocks above and all that is above and left."""
        key, total, corner = None, None, None
        for rows in lists:
            for r in rows:
                if (r["image_id"], r["cx"]) != key:
                    key, total, corner = (r["image_id"], r["cx"]), np.zeros(1, r["kind"]), np.zeros(1, r["kind"])
                r["above"] = (total + corner).tobytes()
                total, corner = total + vector(r, "across"), corner + vector(r, "left")[-1:]
            yield rows

    columns = rows.repartition("image_id", "cx").sortWithinPartitions("image_id", "cx", "cy")
    carry = mapped(columns, column, edge + ", left binary, above binary").filter("down IS NOT NULL").select(*CELL, "left", "above")

    def whole(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for r in rows:
                a = sums(as_array(r))
                total = a.cumsum(0).cumsum(1) + np.frombuffer(r["left"], a.dtype)[:, None] + np.frombuffer(r["above"], a.dtype)[None, :]
                out.append(_block(r["image_id"], r["y0"], r["x0"], total.astype(a.dtype.newbyteorder(">"))[:, :, None]))
            yield out

    own = blocks.select("image_id", "y0", "x0", "h", "w", "channels", "dtype", "pixels", F.floor(F.col("y0") / block).alias("cy"), F.floor(F.col("x0") / block).alias("cx"))
    return mapped(own.join(carry, CELL), whole, _block_schema(blocks))


def window_sums(integral: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """``windows`` (image_id, y0, x0, y1, x1: [y0, y1) x [x0, x1)) with total, from the four
    corners in ``integral_blocks``.  A block is sent once, with all corners in it."""
    keys = windows.columns
    row = windows.withColumn("key", F.struct(*keys))
    corner = lambda y, x, sign: F.struct((F.col(y) - 1).alias("y"), (F.col(x) - 1).alias("x"), F.lit(sign).alias("sign"))
    corners = row.select("image_id", "key", F.explode(F.array(corner("y1", "x1", 1), corner("y0", "x1", -1), corner("y1", "x0", -1), corner("y0", "x0", 1))).alias("c"))
    corners = corners.filter("c.y >= 0 AND c.x >= 0").select("image_id", F.floor(F.col("c.y") / block).alias("cy"), F.floor(F.col("c.x") / block).alias("cx"), "key", "c")
    at = F.floor(F.col("c.y") % block) * F.col("w") + F.col("c.x") % block
    # Windows meet narrow references first; values are read from the block's bytes in the JVM.
    cells = integral.select("image_id", F.floor(F.col("y0") / block).alias("cy"), F.floor(F.col("x0") / block).alias("cx"), "w", "dtype", "pixels")
    raw = F.hex(F.substr(F.col("pixels"), (at * 8 + 1).cast("int"), F.lit(8)))
    number = F.conv(raw, 16, 10).cast("decimal(20,0)")
    signed = F.when(number >= F.lit("9223372036854775808").cast("decimal(20,0)"), number - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(number).cast("long")
    values = cells.join(corners, CELL).groupBy("key").agg(F.sum(signed * F.col("c.sign")).alias("total"))
    return row.join(values, "key", "left").select(*keys, F.coalesce("total", F.lit(0)).alias("total"))


# Overlapping tiles.


def _covered(row: dict, block: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(cy, cx, y, x, pixels) for each cell that a tile (row, col, h, w, ...) covers; pixels
    beyond valid_height and valid_width, if the tile has these, are left out."""
    a, y0, x0 = as_array(row), row["row"], row["col"]
    a = a[: row.get("valid_height") if row.get("valid_height") is not None else None, : row.get("valid_width") if row.get("valid_width") is not None else None]
    h, w = a.shape[:2]
    for cy in range(y0 // block, -(-(y0 + h) // block)):
        ya, yb = max(y0, cy * block), min(y0 + h, (cy + 1) * block)
        for cx in range(x0 // block, -(-(x0 + w) // block)):
            xa, xb = max(x0, cx * block), min(x0 + w, (cx + 1) * block)
            yield cy, cx, ya, xa, a[ya - y0 : yb - y0, xa - x0 : xb - x0]


def _sized(block: int, canvas: dict | None, cy: int, cx: int) -> tuple[int, int]:
    if canvas is None or canvas.get("height") is None:
        return block, block
    return min(block, canvas["height"] - cy * block), min(block, canvas["width"] - cx * block)


def _with_canvas(parts: DataFrame, canvas: DataFrame, block: int) -> DataFrame:
    """``parts`` of the cells of each image's canvas (image_id, height, width), with an empty
    part for each cell, and the canvas' size."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / block).cast("long") - 1))
    sized = canvas.filter("height > 0 AND width > 0")
    every = sized.select("image_id", "height", "width", upto("height").alias("cy")).select("*", upto("width").alias("cx"))
    limits = sized.select("image_id", "height", "width")
    known = parts.join(limits, "image_id").filter((F.col("cy") * block < F.col("height")) & (F.col("cx") * block < F.col("width")))
    return known.unionByName(every, allowMissingColumns=True)


def stitch_blocks(tiles: DataFrame, block: int, canvas: DataFrame | None = None) -> DataFrame:
    """Overlap-averaged mosaic of tiles (image_id, row, col, h, w, channels, dtype, pixels,
    maybe valid_height and valid_width): blocks of float64, two channels: the mean, and how
    many tiles cover the pixel (0: the mean is 0).  A task adds up what its tiles cover of a
    cell, so that each cell gets a part from a task and not from a tile.  With ``canvas``
    (image_id, height, width) every cell of an image has a block."""
    kind = kind_of(tiles)
    schema = f"image_id {kind}, cy long, cx long, {PLACE}"

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        held: dict[tuple, np.ndarray] = {}

        def given() -> list[dict]:
            out = []
            for (image, cy, cx), a in held.items():
                ys, xs = np.flatnonzero(a[:, :, 1].any(1)), np.flatnonzero(a[:, :, 1].any(0))
                if len(ys):
                    out.append({"image_id": image, "cy": cy, "cx": cx, "y": cy * block + int(ys[0]), "x": cx * block + int(xs[0]), **fields(a[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1])})
            held.clear()
            return out

        for rows in lists:
            for r in rows:
                for cy, cx, y, x, a in _covered(r, block):
                    if (key := (r["image_id"], cy, cx)) not in held:
                        held[key] = np.zeros((block, block, 2))
                    into = held[key][y - cy * block : y - cy * block + a.shape[0], x - cx * block : x - cx * block + a.shape[1]]
                    into[:, :, 0] += a[:, :, 0]
                    into[:, :, 1] += 1
                if len(held) * block * block * 16 > HELD:
                    yield given()
        yield given()

    names = ["image_id", "row", "col", "h", "w", "channels", "dtype", "pixels", *(c for c in ("valid_height", "valid_width") if c in tiles.columns)]
    parts = mapped(tiles.select(*names), work, schema)
    if canvas is not None:
        parts = _with_canvas(parts, canvas, block)

    def start(r: dict) -> np.ndarray:
        h, w = _sized(block, r, r["cy"], r["cx"])
        return np.zeros((h, w, 2))

    def add(state: np.ndarray, r: dict) -> None:
        if r["pixels"] is not None:
            y, x = r["y"] - r["cy"] * block, r["x"] - r["cx"] * block
            into = state[y : y + r["h"], x : x + r["w"]]
            into += as_array(r)[: into.shape[0], : into.shape[1]]

    def done(r: dict, state: np.ndarray) -> dict:
        state[:, :, 0] /= np.maximum(state[:, :, 1], 1)
        return _block(r["image_id"], r["cy"] * block, r["cx"] * block, state)

    return folded(parts, [], start, add, done, _block_schema(tiles))


def composite_blocks(tiles: DataFrame, block: int, nodata: int = 0, canvas: DataFrame | None = None) -> DataFrame:
    """Overlapping tiles (tile, image_id, row, col, h, w, channels, dtype, pixels) as blocks of
    the first channel: the last in name order wins, nodata never does.  Tiles are dealt by
    ranges of names, so a task's own composite of a cell stands for its range, and a cell
    that most tiles cover gets one part from each task; these are laid over each other in the
    ranges' order.  With ``canvas`` every cell of an image has a block."""
    schema = f"image_id {kind_of(tiles)}, cy long, cx long, name {kind_of(tiles, 'tile')}, {PLACE}"

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        held: dict[tuple, list] = {}
        size = 0

        def given() -> list[dict]:
            out = [{"image_id": image, "cy": cy, "cx": cx, "name": name, "y": cy * block, "x": cx * block, **fields(a)} for (image, cy, cx), (name, a) in held.items()]
            held.clear()
            return out

        for rows in lists:
            for r in rows:
                for cy, cx, y, x, a in _covered(r, block):
                    key = (r["image_id"], cy, cx)
                    if key not in held:
                        held[key] = [r["tile"], np.full((block, block, 1), nodata, a.dtype)]
                        size += held[key][1].nbytes
                    into = held[key][1][y - cy * block : y - cy * block + a.shape[0], x - cx * block : x - cx * block + a.shape[1]]
                    np.copyto(into, a[:, :, :1], where=a[:, :, :1] != nodata)
                if size > HELD:
                    yield given()
                    size = 0
        yield given()

    ranged = tiles.select("tile", "image_id", "row", "col", "h", "w", "channels", "dtype", "pixels").repartitionByRange("tile").sortWithinPartitions("tile")
    parts = mapped(ranged, work, schema)
    if canvas is not None:
        parts = _with_canvas(parts, canvas, block)

    def start(r: dict) -> dict:
        h, w = _sized(block, r, r["cy"], r["cx"])
        return {"a": None, "h": h, "w": w}

    def add(state: dict, r: dict) -> None:
        if r["pixels"] is not None:
            a = as_array(r)[: state["h"], : state["w"]]
            if state["a"] is None:
                state["a"] = np.array(a)
            else:
                np.copyto(state["a"], a, where=a != nodata)

    def done(r: dict, state: dict) -> dict:
        a = state["a"] if state["a"] is not None else np.full((state["h"], state["w"], 1), nodata, np.uint8)
        return _block(r["image_id"], r["cy"] * block, r["cx"] * block, a)

    # A range's parts of a cell bear the name of their first tile.
    return folded(parts, ["name"], start, add, done, _block_schema(tiles))


# Means and overviews.


def _shrunk(a: np.ndarray, y0: int, x0: int, by: int) -> tuple[int, int, np.ndarray]:
    """Sums of a (h, w, k) over cells of by x by of the image's grid, and the place of the first."""
    top, left = y0 // by, x0 // by
    a = np.pad(a, ((y0 - top * by, -(y0 + a.shape[0]) % by), (x0 - left * by, -(x0 + a.shape[1]) % by), (0, 0)))
    return top, left, a.reshape(a.shape[0] // by, by, a.shape[1] // by, by, -1).sum((1, 3))


def _gathered(parts: DataFrame, block: int, like: DataFrame) -> DataFrame:
    """Sums and counts (two channels) that several blocks give to a cell, added up."""

    def start(r: dict) -> list:
        return [np.zeros((block, block, 2)), 0, 0]

    def add(state: list, r: dict) -> None:
        y, x = r["y"] - r["cy"] * block, r["x"] - r["cx"] * block
        state[0][y : y + r["h"], x : x + r["w"]] += as_array(r)
        state[1], state[2] = max(state[1], y + r["h"]), max(state[2], x + r["w"])

    return folded(parts, [], start, add, lambda r, s: _block(r["image_id"], r["cy"] * block, r["cx"] * block, s[0][: s[1], : s[2]]), _block_schema(like))


def _cut(image, top: int, left: int, a: np.ndarray, block: int) -> Iterator[dict]:
    for cy, cx, y, x, part in _covered({"row": top, "col": left, **fields(a)}, block):
        yield {"image_id": image, "cy": cy, "cx": cx, "y": y, "x": x, **fields(part)}


def _counted(a: np.ndarray) -> np.ndarray:
    """The first channel and how often it is there (NaN is not), as (h, w, 2) of float64."""
    v = a[:, :, 0].astype(np.float64)
    there = ~np.isnan(v)
    return np.stack([np.where(there, v, 0), there], axis=2)


def _mean_blocks(sums: DataFrame) -> DataFrame:
    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for r in rows:
                a = as_array(r)
                out.append(_block(r["image_id"], r["y0"], r["x0"], np.where(a[:, :, 1:] > 0, a[:, :, :1] / np.maximum(a[:, :, 1:], 1), np.nan)))
            yield out

    return mapped(sums, work, _block_schema(sums))


def pyramid_blocks(blocks: DataFrame, block: int, factors: tuple[int, ...] = (2, 4, 8), categorical: bool = False) -> DataFrame:
    """Overviews as blocks of float64 with ``factor``: means of present pixels (NaN where
    there are none), or the pixel at the cell's centre.  Each block gives its sums and counts,
    a quarter of its size for a factor of 2; quarters meet in blocks of the next level, and a
    factor that is a multiple of the one before is made from these, so pixels are read once.
    Of categories only the pixels that stay are read on."""
    schema = f"image_id {kind_of(blocks)}, cy long, cx long, {PLACE}"
    names = ["image_id", "y0", "x0", "h", "w", "channels", "dtype", "pixels"]

    def level(rows: DataFrame, by: int, ready: bool) -> DataFrame:
        def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
            for rows in lists:
                out = []
                for r in rows:
                    a = as_array(r) if ready else _counted(as_array(r))
                    top, left, small = _shrunk(a, r["y0"], r["x0"], by)
                    out += _cut(r["image_id"], top, left, small, block)
                yield out

        return _gathered(mapped(rows.select(*names), work, schema), block, blocks)

    def nearest(by: int) -> DataFrame:
        def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
            for rows in lists:
                out = []
                for r in rows:
                    first = [(by // 2 - r[at]) % by for at in ("y0", "x0")]
                    small = as_array(r)[first[0] :: by, first[1] :: by, :1].astype(np.float64)
                    if small.size:
                        out += _cut(r["image_id"], (r["y0"] + first[0]) // by, (r["x0"] + first[1]) // by, np.concatenate([small, np.ones_like(small)], axis=2), block)
                yield out

        return _gathered(mapped(blocks.select(*names), work, schema), block, blocks)

    out, below, last = None, None, 1
    for f in factors:
        if categorical:
            sums = nearest(f)
        elif below is None or f % last:
            sums = below = stored(level(blocks, f, False), f"pyramid-{f}")
            last = f
        else:
            sums = below = stored(level(below, f // last, True), f"pyramid-{f}")
            last = f
        one = _mean_blocks(sums).withColumn("factor", F.lit(f))
        out = one if out is None else out.unionByName(one)
    return out


def downsample_blocks(blocks: DataFrame, block: int, factor: int) -> DataFrame:
    """Means of factor x factor cells as blocks of float64; ragged edges count as if the last
    row and column were repeated.  ``blocks`` also has image_height and image_width."""

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for r in rows:
                a = as_array(r)[:, :, 0].astype(np.float64)
                weigh = lambda first, n, full: np.where(first + np.arange(n) == full - 1, 1 + -full % factor, 1)
                weight = weigh(r["y0"], r["h"], r["image_height"])[:, None] * weigh(r["x0"], r["w"], r["image_width"])[None, :]
                top, left, small = _shrunk(np.stack([a * weight, weight], axis=2), r["y0"], r["x0"], factor)
                out += _cut(r["image_id"], top, left, small, block)
            yield out

    rows = blocks.select("image_id", "y0", "x0", "h", "w", "channels", "dtype", "pixels", "image_height", "image_width")
    return _mean_blocks(_gathered(mapped(rows, work, f"image_id {kind_of(blocks)}, cy long, cx long, {PLACE}"), block, blocks))


# Colours.


def _packed(a: np.ndarray) -> np.ndarray:
    """r, g, b as one number, -1 where transparent."""
    rgb = a[:, :, :3].astype(np.int64)
    return np.where(a[:, :, 3] > 0, rgb[:, :, 0] << 16 | rgb[:, :, 1] << 8 | rgb[:, :, 2], -1)


def block_colours(blocks: DataFrame) -> DataFrame:
    """image_id, y0, x0, colour, n: the different colours of each RGBA block (-1:
    transparent) and their pixels."""

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for r in rows:
                values, n = np.unique(_packed(as_array(r)), return_counts=True)
                out += [{"image_id": r["image_id"], "y0": r["y0"], "x0": r["x0"], "colour": int(v), "n": int(k)} for v, k in zip(values, n, strict=True)]
            yield out

    rows = blocks.select("image_id", "y0", "x0", "h", "w", "channels", "dtype", "pixels")
    return mapped(rows, work, f"image_id {kind_of(blocks)}, y0 long, x0 long, colour long, n long")


def decoded_colours(colours: DataFrame, palette: DataFrame, tolerance: int = 1600) -> DataFrame:
    """colour, class_id of the different colours: the nearest legend colour, of equal ones
    the first; 0 where transparent or farther than the tolerance."""
    if palette.count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} legend colours")
    p = palette.select(F.col("class_id").alias("p_id"), *[F.col(c).cast("long").alias(f"p_{c}") for c in "rgb"])
    part = {"r": F.shiftright("colour", 16), "g": F.shiftright("colour", 8).bitwiseAND(255), "b": F.col("colour").bitwiseAND(255)}
    distance = sum(((part[c] - F.col(f"p_{c}")) * (part[c] - F.col(f"p_{c}")) for c in "rgb"), F.lit(0))
    known = colours.select("colour").distinct()
    near = known.join(F.broadcast(p), how="cross").groupBy("colour").agg(F.min(F.struct(distance.alias("d"), "p_id")).alias("best"))
    class_id = F.when((F.col("colour") >= 0) & (F.col("best.d") <= tolerance), F.col("best.p_id")).otherwise(0).cast("long")
    return known.join(near, "colour", "left").select("colour", class_id.alias("class_id"))


def decode_blocks(blocks: DataFrame, palette: DataFrame, tolerance: int = 1600) -> DataFrame:
    """RGBA blocks as blocks of class ids (uint8).  Different colours meet the palette; each
    block gets the classes of its own colours back and puts them in place."""
    per = stored(block_colours(blocks), "block-colours")
    codes = per.join(decoded_colours(per, palette, tolerance), "colour")
    codes = codes.groupBy("image_id", "y0", "x0").agg(F.array_sort(F.collect_list(F.struct("colour", "class_id"))).alias("codes"))

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for r in rows:
                known = np.array([c["colour"] for c in r["codes"]], np.int64)
                classes = np.array([c["class_id"] for c in r["codes"]], np.uint8)
                out.append(_block(r["image_id"], r["y0"], r["x0"], classes[np.searchsorted(known, _packed(as_array(r)))][:, :, None]))
            yield out

    rows = blocks.select("image_id", "y0", "x0", "h", "w", "channels", "dtype", "pixels").join(codes, ["image_id", "y0", "x0"])
    return mapped(rows, work, _block_schema(blocks))


def block_histogram(blocks: DataFrame, classes: DataFrame, tolerance: int = 1600) -> DataFrame:
    """Pixels and share of each class of RGBA blocks, 0 included, classes without pixels too:
    from the counts of different colours alone."""
    per = stored(block_colours(blocks).groupBy("colour").agg(F.sum("n").alias("n")), "colour-counts")
    counts = per.join(decoded_colours(per, classes, tolerance), "colour").groupBy("class_id").agg(F.sum("n").alias("k"))
    every = classes.select("class_id").unionByName(classes.sparkSession.range(1).select(F.col("id").alias("class_id")))
    total = per.agg(F.sum("n").alias("total"))  # one row
    out = every.join(counts, "class_id", "left").join(F.broadcast(total), how="cross")
    return out.select("class_id", F.coalesce("k", F.lit(0)).alias("n"), F.try_divide(F.coalesce("k", F.lit(0)), "total").alias("share"))
