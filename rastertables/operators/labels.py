"""Label colours, legends, pairing, mosaics and pyramids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: A class id is one byte, so a legend has fewer rows than this.
MOST_CLASSES = 256


def legend(rows: DataFrame) -> DataFrame:
    """class_id 1..N of the square rows with a value, in source order (a legend
    has a few rows), with r, g, b of the colour."""
    kept = rows.filter((F.lower(F.trim("shape")) == "square") & (F.trim("value") != ""))
    part = lambda i: F.conv(F.substring("color", i, 2), 16, 10).cast("int")
    ids = F.row_number().over(Window.orderBy("src_pos")).cast("long")
    return kept.select(ids.alias("class_id"), "value", "color", part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def colormap(classes: DataFrame) -> DataFrame:
    rows = classes.select("class_id", "r", "g", "b", F.lit(255).alias("a"))
    zero = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("class_id"), *[F.lit(0).alias(c) for c in "rgba"])
    return rows.unionByName(zero)


def decode_colours(pixels: DataFrame, palette: DataFrame, tolerance: int = 1600) -> DataFrame:
    """Pixels with the class of the nearest legend colour; 0 where transparent
    or farther than the tolerance.  Only distinct colours meet the palette."""
    colours = pixels.filter("a > 0").select("r", "g", "b").distinct()
    p = palette.select(F.col("class_id").alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in "rgb"])
    distance = sum(((F.col(c) - F.col(f"p_{c}")) * (F.col(c) - F.col(f"p_{c}")) for c in "rgb"), F.lit(0))
    if palette.count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} legend colours")
    near = colours.crossJoin(F.broadcast(p)).groupBy("r", "g", "b").agg(F.min(F.struct(distance.alias("d"), F.col("p_id"))).alias("best"))
    near = near.select(*[F.col(c).alias(f"n_{c}") for c in "rgb"], F.when(F.col("best.d") <= tolerance, F.col("best.p_id")).otherwise(0).alias("near"))
    same = (F.col("r") == F.col("n_r")) & (F.col("g") == F.col("n_g")) & (F.col("b") == F.col("n_b"))
    out = pixels.join(near, same, "left")
    return out.withColumn("class_id", F.when(F.col("a") == 0, 0).otherwise(F.coalesce("near", F.lit(0))).cast("long")).drop("n_r", "n_g", "n_b", "near")


def class_histogram(decoded: DataFrame, classes: DataFrame) -> DataFrame:
    """Pixels and share per class, 0 included, classes without pixels too."""
    counts = decoded.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    total = decoded.agg(F.count(F.lit(1)).alias("total"))
    every = classes.select("class_id").unionByName(classes.sparkSession.range(1).select(F.col("id").alias("class_id")))
    out = every.join(counts, "class_id", "left").crossJoin(F.broadcast(total))
    return out.select("class_id", F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(F.coalesce("n", F.lit(0)), "total").alias("share"))


def decode_totals(decoded: DataFrame) -> DataFrame:
    """One row: pixels in all, transparent ones, opaque ones without a class, with
    one, and the share of opaque pixels that have one."""
    clear, known = F.col("a") == 0, F.col("class_id") > 0
    out = decoded.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(clear).alias("transparent"), F.count_if(~clear & ~known).alias("unmatched"), F.count_if(~clear & known).alias("labelled")
    )
    return out.withColumn("labelled_share", F.col("labelled") / F.greatest(F.col("labelled") + F.col("unmatched"), F.lit(1)))


def pair_by_ground_bounds(imagery: DataFrame, labels: DataFrame, off_y: int, off_x: int) -> DataFrame:
    """Imagery pixels with the label at the same ground; missing labels are 0."""
    moved = labels.select((F.col("y") - off_y).alias("y"), (F.col("x") - off_x).alias("x"), F.col("class_id").alias("label"))
    return imagery.join(moved, ["y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def remap_labels(pixels: DataFrame) -> DataFrame:
    """Training labels: class c becomes c - 1; no label or no imagery is 255."""
    return pixels.withColumn("target", F.when((F.col("label") == 0) | (F.col("dn") == 0), 255).otherwise(F.col("label") - 1))


def coverage_fractions(pixels: DataFrame, window: list[str]) -> DataFrame:
    share = lambda c: F.avg((F.col(c) > 0).cast("double"))
    return pixels.groupBy(*window).agg(share("dn").alias("valid_frac"), share("label").alias("label_frac"))


def mosaic_extent(tiles: DataFrame) -> DataFrame:
    """Each tile with the mosaic's size and its own offset in it, in pixels."""
    whole = tiles.agg(F.min("left").alias("m_left"), F.max("right").alias("m_right"), F.min("bottom").alias("m_bottom"), F.max("top").alias("m_top"))
    pixels = lambda d: F.rint(d / F.col("res")).cast("long")
    return tiles.crossJoin(F.broadcast(whole)).select(
        "tile", pixels(F.col("m_right") - F.col("m_left")).alias("m_width"), pixels(F.col("m_top") - F.col("m_bottom")).alias("m_height"),
        pixels(F.col("left") - F.col("m_left")).alias("off_x"), pixels(F.col("m_top") - F.col("top")).alias("off_y"),
    )


def mosaic_composite(pixels: DataFrame, nodata: int = 0) -> DataFrame:
    """Overlapping tiles: the last in name order wins, nodata never does; a place
    that only has nodata is nodata."""
    found = pixels.groupBy("y", "x").agg(F.max_by(F.when(F.col("dn") != nodata, F.col("dn")), F.when(F.col("dn") != nodata, F.col("tile"))).alias("dn"))
    return found.withColumn("dn", F.coalesce("dn", F.lit(nodata)))


def fill_gaps(pixels: DataFrame, height: int, width: int, value: str, fill: float = 0) -> DataFrame:
    """Every place of a canvas (y, x), with ``fill`` where ``pixels`` have none."""
    spark = pixels.sparkSession
    rows = spark.range(height).select(F.col("id").alias("y"))
    canvas = rows.select("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"))
    return canvas.join(pixels.select("y", "x", value), ["y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def downsample_mean(pixels: DataFrame, image: str, height: str, width: str, factor: int) -> DataFrame:
    """Block means, ragged edges padded by repeating the last row and column."""
    pad = lambda at, n: F.when(F.col(at) == F.col(n) - 1, 1 + F.pmod(-F.col(n), F.lit(factor))).otherwise(1)
    weight = pad("y", height) * pad("x", width)
    cell = lambda n: F.floor(F.col(n) / factor).cast("long")
    return pixels.groupBy(image, cell("y").alias("block_y"), cell("x").alias("block_x")).agg((F.sum(F.col("dn") * weight) / F.sum(weight)).alias("dn"))


def build_pyramid(pixels: DataFrame, image: str, factors: tuple[int, ...] = (2, 4, 8), categorical: bool = False) -> DataFrame:
    """Overviews: means of present pixels, or the pixel at the cell's centre.

    Means of a factor that is a multiple of the one before are made from the sums
    and counts of its cells, so the pixels are read once."""
    levels, below, last = None, None, 1
    for f in factors:
        cell = lambda n, by: F.floor(F.col(n) / by).cast("long")
        if categorical:
            level = pixels.filter((F.col("y") % f == f // 2) & (F.col("x") % f == f // 2)).select(image, cell("y", f).alias("block_y"), cell("x", f).alias("block_x"), F.col("dn").cast("double").alias("dn"))
        else:
            if below is None or f % last:
                below = pixels.groupBy(image, cell("y", f).alias("block_y"), cell("x", f).alias("block_x")).agg(F.sum(F.col("dn").cast("double")).alias("s"), F.count("dn").alias("n"))
            else:
                by = f // last
                below = below.groupBy(image, cell("block_y", by).alias("block_y"), cell("block_x", by).alias("block_x")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
            below, last = stored(below, f"pyramid-{f}"), f
            level = below.select(image, "block_y", "block_x", F.try_divide("s", "n").alias("dn"))
        level = level.withColumn("factor", F.lit(f))
        levels = level if levels is None else levels.unionByName(level)
    return levels


def stitch_tiles(pixels: DataFrame, image: str, canvas: DataFrame | None = None) -> DataFrame:
    """Overlap-averaged mosaic of tile pixels (row and col offsets, y and x in the
    tile).  Pixels beyond a tile's valid_height and valid_width, if it has these,
    are left out.  With ``canvas`` (image, height, width) every place of an image
    is returned, 0 where no tile covers it."""
    if {"valid_height", "valid_width"} <= set(pixels.columns):
        pixels = pixels.filter("y < valid_height AND x < valid_width")
    found = pixels.groupBy(image, (F.col("row") + F.col("y")).alias("gy"), (F.col("col") + F.col("x")).alias("gx")).agg(F.avg("v").alias("v"))
    if canvas is None:
        return found
    upto = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))
    places = canvas.select(image, "width", upto("height").alias("gy")).select(image, "gy", upto("width").alias("gx"))
    return places.join(found, [image, "gy", "gx"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def valid_share(pixels: DataFrame, image: str) -> DataFrame:
    return pixels.groupBy(image).agg(F.count_if(F.col("dn") > 0).alias("n_valid"), F.avg((F.col("dn") > 0).cast("double")).alias("share"))


def _snapped(df: DataFrame, x0, y0, x1, y1, left: float, top: float, res: float) -> DataFrame:
    """The window of whole pixels that covers metres x0..x1, y0..y1."""
    c0, r0 = F.floor((x0 - F.lit(left)) / F.lit(res)), F.floor((F.lit(top) - y1) / F.lit(res))
    c1, r1 = F.ceil((x1 - F.lit(left)) / F.lit(res)), F.ceil((F.lit(top) - y0) / F.lit(res))
    return df.withColumn("col", c0.cast("long")).withColumn("row", r0.cast("long")).withColumn("w", (c1 - c0).cast("long")).withColumn("h", (r1 - r0).cast("long"))


def snap_aoi(boxes: DataFrame, radius: float, left: float, top: float, res: float) -> DataFrame:
    """Integer window on the grid that covers a lon/lat box."""
    metres = lambda n: F.col(n) * F.lit(radius * math.pi / 180)
    return _snapped(boxes, metres("lon0"), metres("lat0"), metres("lon1"), metres("lat1"), left, top, res)


def snap_centre(points: DataFrame, size: int, radius: float, left: float, top: float, res: float) -> DataFrame:
    """Integer window of about ``size`` pixels around a lon/lat point."""
    x, y = (F.col(n) * F.lit(radius * math.pi / 180) for n in ("lon", "lat"))
    half = F.lit(size * res / 2)
    return _snapped(points, x - half, y - half, x + half, y + half, left, top, res)


def full_extent(tiles: DataFrame, left: float, top: float, res: float) -> DataFrame:
    """One row: the window that covers all tiles (left, right, bottom, top in metres)."""
    whole = tiles.agg(F.min("left").alias("__l"), F.max("right").alias("__r"), F.min("bottom").alias("__b"), F.max("top").alias("__t"))
    return _snapped(whole, F.col("__l"), F.col("__b"), F.col("__r"), F.col("__t"), left, top, res).drop("__l", "__r", "__b", "__t")


def latest_version_tiles(files: DataFrame, folder: str = r"/(v[^/]*)/", tag: str | None = None) -> DataFrame:
    """Tiles of the last version folder in string order, sorted by path; ``version``
    is what ``tag`` finds in the file's name, or the folder's.  Without any it is
    an error."""
    tagged = files.withColumn("__v", F.regexp_extract("path", folder, 1)).filter("__v <> ''")
    last = tagged.agg(F.max("__v")).first()[0]
    if last is None:
        raise FileNotFoundError("no version folder")
    name = F.element_at(F.split("path", "/"), -1)
    version = F.col("__v") if tag is None else F.regexp_extract(name, tag, 1)
    return tagged.filter(F.col("__v") == last).select(version.alias("version"), "path").filter("version <> ''").orderBy("path")
