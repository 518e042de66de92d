"""Tile quality: invalid pixels, brightness, filters, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import as_array, fields, mapped

FLOAT_NODATA = -3.0e38


def _invalid(a: np.ndarray) -> np.ndarray:
    """``pixel_invalid`` of an array by its own type."""
    if a.dtype == np.uint8:
        return (a == 0) | (a == 255)
    return ~np.isfinite(a) | (a <= FLOAT_NODATA) if a.dtype.kind == "f" else a == 0


def value_counts(blocks: DataFrame, tile: str = "image_id") -> DataFrame:
    """tile, dn, n, bad, pixels of block tables: how often a tile has each finite value,
    and whether the value is invalid; the row with a null dn counts the pixels, and
    as n those that are invalid in all channels.  What is shuffled is one row for each different value
    of a block, 256 at most for 8-bit blocks, never a pixel."""
    kind = dict(blocks.dtypes)[tile]

    def work(lists: Iterator[list[dict]]) -> Iterator[dict]:
        for rows in lists:
            keys, dns, counts, bads, pixels = [], [], [], [], []
            for r in rows:
                a = as_array(r)
                if a.dtype == np.uint8:
                    n = np.bincount(a.ravel(), minlength=256)
                    values = np.flatnonzero(n).astype(np.uint8)
                    n = n[values]
                else:
                    values, n = np.unique(a[np.isfinite(a)], return_counts=True)
                lost = int(_invalid(a).all(axis=2).sum())
                keys += [r[tile]] * (len(values) + 1)
                dns += [*values.astype(float).tolist(), None]
                counts += [*n.tolist(), lost]
                bads += [*_invalid(values).tolist(), True]
                pixels += [0] * len(values) + [r["h"] * r["w"]]
            yield {"tile": keys, "dn": dns, "n": counts, "bad": bads, "pixels": pixels}

    parts = mapped(blocks.select(tile, "pixels", "dtype", "h", "w", "channels"), work, f"tile {kind}, dn double, n long, bad boolean, pixels long")
    return parts.groupBy(F.col("tile").alias(tile), "dn", "bad").agg(F.sum("n").alias("n"), F.sum("pixels").alias("pixels"))


def block_invalid_fraction(counts: DataFrame, tile: str = "image_id") -> DataFrame:
    """``invalid_fraction`` from ``value_counts``."""
    bad = F.sum(F.when(F.col("dn").isNull(), F.col("n")).otherwise(0))
    return counts.groupBy(tile).agg((bad / F.sum("pixels")).alias("invalid_fraction"))


def _summed_product(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: the product's error, from halves of 26 bits, and the sum's
    error are added to the sum."""
    half = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    p, ah, bh = a * b, half(a), half(b)
    lost = ((ah * bh - p) + ah * (b - bh) + (a - ah) * bh) + (a - ah) * (b - bh)
    s = p + c
    back = s - p
    exact = s + (((p - (s - back)) + (c - back)) + lost)
    return F.when(F.greatest(F.abs(a), F.abs(c)) < 1e290, exact).otherwise(s)  # the halves of larger numbers overflow


def _limits(values: DataFrame, tile: str, low: float, high: float) -> DataFrame:
    """tile, lo, hi of values (tile, good, n: how often a tile has a value, null for those that do not
    count): the percentiles, or the extremes where these are equal.  Between two values v and w
    a percentile is v * (1 - d) + w * d, rounded as DuckDB's quantile_cont rounds it, since a
    preview truncates what is computed from it."""
    n = F.when(F.col("good").isNotNull(), F.col("n")).otherwise(0)
    upto = F.sum(n).over(Window.partitionBy(tile).orderBy("good").rowsBetween(Window.unboundedPreceding, 0))
    rows = values.select(tile, "good", upto.alias("__upto"), F.sum(n).over(Window.partitionBy(tile)).alias("__all"))
    at = {"p": (F.col("__all") - 1) * F.lit(low), "q": (F.col("__all") - 1) * F.lit(high)}
    least = lambda place: F.min(F.when(F.col("__upto") > place, F.col("good")))
    found = rows.groupBy(tile).agg(
        F.min("good").alias("mn"), F.max("good").alias("mx"), *[least(F.floor(v)).alias(f"{k}0") for k, v in at.items()], *[least(F.ceil(v)).alias(f"{k}1") for k, v in at.items()],
        *[F.max(v - F.floor(v)).alias(f"{k}d") for k, v in at.items()],
    )
    point = lambda k: _summed_product(F.col(f"{k}0"), 1 - F.col(f"{k}d"), F.col(f"{k}1") * F.col(f"{k}d")).alias(k)
    spread = F.col("q") > F.col("p")
    found = found.select(tile, "mn", "mx", point("p"), point("q"))
    return found.select(tile, F.when(spread, F.col("p")).otherwise(F.col("mn")).alias("lo"), F.when(spread, F.col("q")).otherwise(F.col("mx")).alias("hi"))


def stretch_limits(counts: DataFrame, tile: str = "image_id", low: float = 0.01, high: float = 0.99, finite: bool = False) -> DataFrame:
    """tile, lo, hi of ``robust_stretch`` (with ``finite`` of ``unit_range``) from
    ``value_counts``; null where a tile has no valid value."""
    known = F.col("dn").isNotNull() & ~F.isnan("dn") & (F.abs("dn") != float("inf"))
    rows = counts.filter(known).select(tile, F.when(F.lit(finite) | ~F.col("bad"), F.col("dn")).alias("good"), "n")
    return _limits(rows, tile, low, high)


def block_std(counts: DataFrame, limits: DataFrame, tile: str = "image_id") -> DataFrame:
    """``tile_std`` from ``value_counts`` and ``stretch_limits``."""
    unit = 2 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("dn") - F.col("lo")) / (F.col("hi") - F.col("lo")))) - 1
    rows = counts.filter("dn IS NOT NULL").join(limits, tile).withColumn("u", F.when(F.col("hi") > F.col("lo"), unit))
    n, mean = F.sum("n"), F.sum(F.col("u") * F.col("n")) / F.sum("n")
    var = F.sum(F.col("u") * F.col("u") * F.col("n")) / n - mean * mean
    return rows.groupBy(tile).agg(F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"))


def stretch_blocks(blocks: DataFrame, limits: DataFrame, tile: str = "image_id", out: str = "uint8") -> DataFrame:
    """Blocks with stretched pixels: ``uint8`` (rounded), ``preview`` (the first
    three channels, truncated to uint8) or ``float32`` and ``float64`` (unit values).  Constant and
    empty tiles become zero."""
    schema = blocks.schema

    made = {"uint8": lambda u: np.rint(np.round(u * 255, 9)).astype(np.uint8), "preview": lambda u: np.floor(u * 255).astype(np.uint8), "float32": lambda u: u.astype(np.float32), "float64": lambda u: u}[out]

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            done = []
            for r in rows:
                a, lo, hi = as_array(r).astype(float), r["lo"], r["hi"]
                a = a[:, :, :3] if out == "preview" else a
                unit = np.clip((a - lo) / (hi - lo), 0, 1) if hi is not None and hi > lo else np.zeros_like(a)
                done.append(r | fields(made(unit)))
            yield done

    return mapped(blocks.join(limits, tile).select(*schema.names, "lo", "hi"), work, schema)


def textured_tiles(tiles: DataFrame, key: str, most_zero: float = 0.02, least_std: float = 6.0, least_edge: float = 0.015) -> DataFrame:
    """``textured_patches`` of tiles (key, pixels and edges: bytes of equal length,
    edges 1 on edges): one pass over the tiles and no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = [np.frombuffer(p, np.uint8) for p in b["pixels"]]
            edges = [np.frombuffer(p, np.uint8) for p in b["edges"]]
            yield pd.DataFrame({key: b[key], "zero": [(x == 0).mean() for x in a], "std": [x.std() for x in a], "edges": [x.mean() for x in edges]})

    stats = tiles.select(key, "pixels", "edges").mapInPandas(run, f"{key} {dict(tiles.dtypes)[key]}, zero double, std double, edges double")
    return stats.filter((F.col("zero") <= most_zero) & (F.col("std") >= least_std) & (F.col("edges") >= least_edge))


def pixel_invalid(dn: Column, dtype: str) -> Column:
    if dtype == "uint8":
        return dn.isin(0, 255)
    if dtype in ("float32", "float64"):
        return dn.isNull() | F.isnan(dn) | (F.abs(dn) == float("inf")) | (dn <= FLOAT_NODATA)
    return dn == 0


def invalid_fraction(pixels: DataFrame, tile: str, dtype: str = "uint8") -> DataFrame:
    """Share of a tile's pixels that are invalid in all channels."""
    each = pixels.groupBy(tile, "y", "x").agg(F.bool_and(pixel_invalid(F.col("dn"), dtype)).alias("bad"))
    return each.groupBy(tile).agg(F.avg(F.col("bad").cast("double")).alias("invalid_fraction"))


def robust_stretch(pixels: DataFrame, tile: str, low: float = 0.01, high: float = 0.99, dtype: str = "uint8") -> DataFrame:
    """Each pixel's brightness between the tile's low and high percentiles of
    valid pixels: unit, u8, and the tile's std of 2 unit - 1 over all pixels.
    Constant and empty tiles have null."""
    good = F.when(~pixel_invalid(F.col("dn"), dtype), F.col("dn").cast("double"))
    limits = _limits(pixels.groupBy(tile, good.alias("good")).agg(F.count(F.lit(1)).alias("n")), tile, low, high).withColumnRenamed(tile, "__t")
    out = pixels.join(limits, F.col(tile) == F.col("__t")).drop("__t")
    unit = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("dn") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    out = out.withColumn("unit", F.when(F.col("hi") > F.col("lo"), unit))
    return out.withColumn("u8", F.rint(F.round(F.col("unit") * 255, 9)).cast("int"))


def tile_std(stretched: DataFrame, tile: str) -> DataFrame:
    return stretched.groupBy(tile).agg(F.stddev_pop(2 * F.col("unit") - 1).alias("std"))


def unit_range(pixels: DataFrame, tile: str) -> DataFrame:
    """Like ``robust_stretch`` on all finite pixels; constant tiles are zero."""
    out = robust_stretch(pixels, tile, dtype="float64")
    return out.withColumn("unit", F.coalesce("unit", F.lit(0.0))).drop("u8")


def preview_stretch(pixels: DataFrame, tile: str) -> DataFrame:
    """8-bit preview of the first three channels (all pixels without a column
    ``ch``), truncated instead of rounded."""
    pixels = pixels.filter("ch < 3") if "ch" in pixels.columns else pixels
    out = robust_stretch(pixels, tile, dtype="float64")
    return out.withColumn("u8", F.floor(F.coalesce("unit", F.lit(0.0)) * 255).cast("int"))


def dequantise(u8: Column) -> Column:
    return u8 / F.lit(127.5) - 1


def display(v: Column) -> Column:
    """Values of -1 to 1 as 0 to 1, clipped."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v + 1) / 2))


def requantise(v: Column) -> Column:
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v))
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint((clipped + 1) * 127.5))).cast("int")


def filter_invalid(df: DataFrame, most: float) -> DataFrame:
    """Rows whose invalid_fraction is not above ``most``; negative keeps all."""
    return df if most < 0 else df.filter(F.col("invalid_fraction") <= most)


def filter_low_variance(df: DataFrame, least: float = 0.02) -> DataFrame:
    return df.filter(F.col("std").isNotNull() & (F.col("std") >= least))


def gsd_policy(catalog: DataFrame, target: float | None, tolerance: float) -> DataFrame:
    """gsd (null if unknown) and whether the policy excludes the image."""
    size = F.abs("xres")
    out = catalog.withColumn("gsd", F.when((size != 0) & (F.abs(size - 1) > 1e-9), size))
    kept = F.lit(True) if target is None else F.coalesce(F.abs(F.col("gsd") - target) <= tolerance, F.lit(False))
    return out.withColumn("excluded", ~kept)


def gsd_distribution(catalog: DataFrame, error: Column | None = None) -> DataFrame:
    """Images, excluded ones and errors (rows where ``error`` is not null) for each
    ground sample distance of three decimals."""
    name = F.coalesce(F.format_string("%.3f", F.col("gsd")), F.lit("unknown"))
    failed = F.lit(False) if error is None else error.isNotNull()
    return catalog.groupBy(F.when(F.col("gsd").isNull(), "unknown").otherwise(name).alias("gsd_name")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("excluded").alias("n_excluded"), F.count_if(failed).alias("n_errors")
    )


def records_per_source(records: DataFrame, source: str) -> DataFrame:
    """Rows of each source, and (source null, n_sources set) of all of them."""
    each = records.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    total = each.agg(F.lit(None).cast(dict(records.dtypes)[source]).alias(source), F.sum("n").alias("n"), F.count(source).alias("n_sources"))
    return each.withColumn("n_sources", F.lit(None).cast("long")).unionByName(total)


def qc_summary(decisions: DataFrame, group: str) -> DataFrame:
    """Candidates, kept and rejected, per group and in total (group null)."""
    n = lambda what: F.count_if(F.col("decision") == what)
    return decisions.rollup(group).agg(
        F.count(F.lit(1)).alias("candidates"), n("kept").alias("kept"), n("invalid").alias("rejected_invalid"), n("lowvar").alias("rejected_lowvar"), n("error").alias("errors")
    )


def coverage_filter(df: DataFrame, valid: float = 0.99, label: float = 0.5) -> DataFrame:
    out = df.filter((F.col("valid_frac") >= valid) & (F.col("label_frac") >= label))
    return out.withColumn("valid_frac", F.bround("valid_frac", 4)).withColumn("label_frac", F.bround("label_frac", 4))


def textured_patches(pixels: DataFrame, patch: str, most_zero: float = 0.02, least_std: float = 6.0, least_edge: float = 0.015) -> DataFrame:
    stats = pixels.groupBy(patch).agg(F.avg((F.col("dn") == 0).cast("double")).alias("zero"), F.stddev_pop("dn").alias("std"), F.avg(F.col("edge").cast("double")).alias("edges"))
    return stats.filter((F.col("zero") <= most_zero) & (F.col("std") >= least_std) & (F.col("edges") >= least_edge))


def integral_image(pixels: DataFrame, image: str, value: str) -> DataFrame:
    """2-D prefix sums.  One window per image: for small images; block sums
    (``invalid_fraction``) serve large ones."""
    down = Window.partitionBy(image, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    right = Window.partitionBy(image, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("__d", F.sum(value).over(down)).withColumn("total", F.sum("__d").over(right)).drop("__d")


def window_sum(sums: DataFrame, windows: DataFrame, image: str) -> DataFrame:
    """Sum of a rectangle [y0, y1) x [x0, x1) from its four corners."""
    out = windows
    for name, y, x in (("a", "y1", "x1"), ("b", "y0", "x1"), ("c", "y1", "x0"), ("d", "y0", "x0")):
        corner = sums.select(F.col(image).alias("__i"), F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("total").alias(f"__{name}"))
        out = out.join(corner, (F.col(image) == F.col("__i")) & (F.col(y) - 1 == F.col("__y")) & (F.col(x) - 1 == F.col("__x")), "left").drop("__i", "__y", "__x")
    z = lambda n: F.coalesce(F.col(f"__{n}"), F.lit(0))
    return out.withColumn("total", z("a") - z("b") - z("c") + z("d")).drop("__a", "__b", "__c", "__d")
