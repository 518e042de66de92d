"""Tile geometry, manifests, sampling and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def _starts(length: str, step: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.col(length) - 1, F.lit(0)).cast("long"), F.lit(step).cast("long"))


def padded_grid(catalog: DataFrame, patch: int, stride: int) -> DataFrame:
    """Tiles that start every ``stride`` pixels and are padded at the far edges."""
    rows = catalog.select("*", F.posexplode(_starts("height", stride)).alias("row", "top"))
    cells = rows.select("*", F.posexplode(_starts("width", stride)).alias("col", "left"))
    valid = lambda n, at: F.least(F.lit(patch), F.greatest(F.col(n) - F.col(at), F.lit(0))).cast("long")
    out = cells.withColumn("valid_h", valid("height", "top")).withColumn("valid_w", valid("width", "left"))
    return out.withColumn("pad_h", F.lit(patch) - F.col("valid_h")).withColumn("pad_w", F.lit(patch) - F.col("valid_w"))


def full_tile_grid(catalog: DataFrame, size: int) -> DataFrame:
    """Only tiles that lie fully inside; the strip left over is dropped."""
    at = lambda n: F.sequence(F.lit(0).cast("long"), (F.col(n) - size).cast("long"), F.lit(size).cast("long"))
    fits = catalog.filter((F.col("height") >= size) & (F.col("width") >= size))
    return fits.select("*", F.posexplode(at("height")).alias("row", "y")).select("*", F.posexplode(at("width")).alias("col", "x"))


def strided_windows(catalog: DataFrame, size: int, stride: int, decimation: int) -> DataFrame:
    """Full-resolution windows with their place and size on the decimated grid."""
    at = lambda n: F.sequence(F.lit(0).cast("long"), (F.col(n) - size).cast("long"), F.lit(stride).cast("long"))
    fits = catalog.filter((F.col("height") >= size) & (F.col("width") >= size))
    out = fits.select("*", F.explode(at("height")).alias("row")).select("*", F.explode(at("width")).alias("col"))
    down = lambda n: F.floor(F.col(n) / decimation).cast("long")
    return out.withColumn("d_row", down("row")).withColumn("d_col", down("col")).withColumn("d_size", F.lit(max(size // decimation, 1)).cast("long"))


def block_partition(windows: DataFrame, block_w: int, block_h: int) -> DataFrame:
    """Processing blocks of windows (row, col, h, w), ragged at the far edges."""
    steps = lambda n, b: F.sequence(F.lit(0).cast("long"), (F.col(n) - 1).cast("long"), F.lit(b).cast("long"))
    out = windows.filter("h > 0 AND w > 0").select("*", F.explode(steps("h", block_h)).alias("dy")).select("*", F.explode(steps("w", block_w)).alias("dx"))
    return (
        out.withColumn("b_row", F.col("row") + F.col("dy")).withColumn("b_col", F.col("col") + F.col("dx"))
        .withColumn("b_h", F.least(F.lit(block_h), F.col("h") - F.col("dy")).cast("long")).withColumn("b_w", F.least(F.lit(block_w), F.col("w") - F.col("dx")).cast("long")).drop("dy", "dx")
    )


def count_candidates(catalog: DataFrame, stride: int, cap: int) -> DataFrame:
    """total and analysed candidate tiles; a negative cap is no cap."""
    along = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / stride)).cast("long")
    out = catalog.withColumn("total", along("height") * along("width"))
    return out.withColumn("analysed", F.col("total") if cap < 0 else F.least(F.col("total"), F.lit(cap)).cast("long"))


def context_window(grid: DataFrame, patch: int, context: int) -> DataFrame:
    """The window centred on each tile, clipped to the image, with its padding."""
    out = grid
    for axis, start, size in (("y", "top", "height"), ("x", "left", "width")):
        want = F.col(start) + patch // 2 - context // 2
        first, last = F.greatest(want, F.lit(0)), F.least(want + context, F.col(size))
        valid = F.greatest(last - first, F.lit(0))
        out = (
            out.withColumn(f"req_{axis}", want.cast("long")).withColumn(f"read_{axis}", first.cast("long")).withColumn(f"valid_{axis}", valid.cast("long"))
            .withColumn(f"before_{axis}", F.greatest(-want, F.lit(0)).cast("long")).withColumn(f"after_{axis}", F.greatest(want + context - F.col(size), F.lit(0)).cast("long"))
        )
    return out


def tile_name(stem: Column, row: Column, col: Column, y: Column, x: Column) -> Column:
    return F.format_string("%s_r%04d_c%04d_y%07d_x%07d.npy", stem, row, col, y, x)


def context_name(stem: Column, row: Column, col: Column, y: Column, x: Column, output: Column | None = None) -> Column:
    """File of a tile's context; with ``output`` of its cache of that size."""
    if output is None:
        return F.format_string("%s_context_r%04d_c%04d_y%07d_x%07d.npy", stem, row, col, y, x)
    return F.format_string("%s_context_o%04d_r%04d_c%04d_y%07d_x%07d.npy", stem, output, row, col, y, x)


def context_base_name(stem: Column, context: Column, output: Column) -> Column:
    return F.format_string("%s_context_base_c%04d_o%04d.npy", stem, context, output)


def preview_name(stem: Column, example: Column, row: Column, col: Column, y: Column, x: Column) -> Column:
    return F.format_string("example_%02d_%s_r%04d_c%04d_y%07d_x%07d.png", example, stem, row, col, y, x)


def relative_path(path: Column, root: str) -> Column:
    """``path`` below the dataset's root; other paths stay."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substring(path, len(top) + 1, 1 << 30)).otherwise(path)


def gallery_id(stem: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_%d_%d", stem, col, row)


def running_before(df: DataFrame, group: str, order: str, amount: Column, out: str, name: str = "running", total: str | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows before it in its group, by
    ``order``, and as ``total`` that of its whole group.  Rows are range-partitioned by (group, order) and stored; sums are
    taken within a partition and, of a group that lies in several, shifted by those of the partitions before, so a
    group with most of the rows is spread over many tasks."""
    keys = [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first()]
    ranged = df.withColumn("__v", amount.cast("long")).repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    ranged = stored(ranged, name)
    own = Window.partitionBy("__p", group)
    within = F.sum("__v").over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    both = ranged.withColumn("__w", F.coalesce(within, F.lit(0)))
    if total:
        both = both.withColumn("__a", F.coalesce(F.sum("__v").over(own), F.lit(0)))
    sums = ranged.groupBy(group, "__p").agg(F.sum("__v").alias("__s"))
    every = Window.partitionBy(group)
    ahead = every.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col(group).alias("__g"), F.col("__p").alias("__q"), F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__b"), F.sum("__s").over(every).alias("__t"), F.count(F.lit(1)).over(every).alias("__c")
    )
    parted = F.broadcast(sums.filter("__c > 1"))  # ranges cut at most two groups a partition
    both = both.join(parted, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")), "left")
    both = both.withColumn(out, F.coalesce("__b", F.lit(0)) + F.col("__w"))
    if total:
        both = both.withColumn(total, F.coalesce("__t", "__a")).drop("__a")
    return both.drop("__v", "__p", "__q", "__g", "__b", "__w", "__t", "__c")


def even_subsample(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """k rows of each group spread evenly over its order; a negative k keeps all.  Places in the
    order come from counts of its ranges, so a group with most of the rows is many tasks."""
    if k < 0:
        return df
    ranked = running_before(df.withColumn("__o", F.struct(*order)), group, "__o", F.lit(1), "__i", "even-subsample", "__n").drop("__o")
    if k == 0:
        keep = F.lit(False)
    elif k == 1:
        keep = F.col("__i") == F.floor(F.col("__n") / 2)
    else:
        # Row i is picked if some j of 0..k-1 has rint(j (n-1) / (k-1)) = i; j is near i (k-1) / (n-1).
        near = F.floor(F.col("__i") * (k - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
        hits = [F.rint((near + d) * (F.col("__n") - 1) / F.lit(float(k - 1))) == F.col("__i") for d in (-1, 0, 1)]
        inside = [(near + d).between(0, k - 1) for d in (-1, 0, 1)]
        keep = (F.col("__n") <= k) | (hits[0] & inside[0]) | (hits[1] & inside[1]) | (hits[2] & inside[2])
    return ranked.filter(keep).drop("__i", "__n")


def seeded_order(seed: str, *keys: str) -> Column:
    """The order of all seeded operators: md5 of the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n random rows, the same at every run."""
    return df.orderBy(seeded_order(seed, key), key).limit(n)


def with_index(rows: DataFrame, order: str | list[str], name: str = "index") -> DataFrame:
    """A 0-based rank by ``order`` (rows that tie in it, in the order of all their
    columns).  Rows are range-partitioned and stored, ranked within a partition
    and shifted by the counts of those before, so no task sees all rows."""
    order = [order] if isinstance(order, str) else order
    keys = [*order, F.xxhash64(*rows.columns).alias("__t")]
    ranged = rows.withColumn("__t", keys[-1]).repartitionByRange(*order, "__t").withColumn("__p", F.spark_partition_id())
    ranged = stored(ranged, "ranked")
    ranked = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order, "__t")) - 1)
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))  # one row a partition
    return ranked.join(before, "__p").withColumn(name, F.col("__b") + F.col("__i")).drop("__p", "__i", "__b", "__t")


def batch_slice(files: DataFrame, start: int, count: int) -> DataFrame:
    """Files ``start`` to ``start + count`` in path order; a negative count is no limit."""
    start = max(start, 0)
    if count >= 0 and start + count <= 10_000:  # few: each task keeps its own least paths
        return files.orderBy("path").limit(start + count).offset(start)
    ranked = with_index(files, "path", "__rank").filter(F.col("__rank") >= start)
    return (ranked if count < 0 else ranked.filter(F.col("__rank") < start + count)).drop("__rank")


#: Rows of a task that sorts, about.
SORTED = 1_000_000


def scan_order(records: DataFrame) -> DataFrame:
    """Records of an image together, in (row, col) order.  Tasks get ranges of this order, so
    an image with most of the records is many tasks, and as many ranges as the records need,
    so that a task sorts about ``SORTED`` of them at any size."""
    n = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // SORTED))
    return records.repartitionByRange(n, "image_id", "row", "col").sortWithinPartitions("image_id", "row", "col")


def follows_scan_order(records: DataFrame) -> DataFrame:
    """One row: out_of_order, how many records of ``scan_order`` come before one of
    their image that should precede them."""
    at = records.withColumn("__m", F.monotonically_increasing_id())
    before = F.lag(F.struct("row", "col")).over(Window.partitionBy("image_id").orderBy("__m"))
    return at.select((before > F.struct("row", "col")).alias("bad")).agg(F.count_if("bad").alias("out_of_order"), F.count(F.lit(1)).alias("n"))


#: Rows of one rectangle that are kept together, about.
TOGETHER = 4096


def tiles_for_blocks(blocks: DataFrame, tiles: DataFrame, cell: int) -> DataFrame:
    """Blocks with the tiles they overlap.  Rectangles, each once, meet in the cells of a coarse
    grid, where a pair counts in the first cell that both cover; the rows of a rectangle are dealt
    into lists of about ``TOGETHER``, and each two lists of a pair of rectangles are one piece of work.
    There may be far more pairs than rows, so the pieces are spread over all shuffle partitions."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = {p: [p + c for c in ("y0", "y1", "x0", "x1")] for p in ("b_", "t_")}

    def spread(sizes: DataFrame, p: str) -> DataFrame:
        cells = lambda lo, hi: F.sequence(F.floor(F.col(p + lo) / cell), F.floor((F.col(p + hi) - 1) / cell))
        return sizes.select("*", F.explode(cells("y0", "y1")).alias("cy")).select("*", F.explode(cells("x0", "x1")).alias("cx")).repartition(n, "cy", "cx")

    def lists(rows: DataFrame, sizes: DataFrame, p: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in edges[p]] or edges[p]
        dealt = rows.join(sizes, edges[p]).withColumn(p + "list", F.pmod(F.xxhash64(*rows.columns), p + "lists"))
        return dealt.groupBy(*edges[p], p + "list").agg(F.collect_list(F.struct(*rest)).alias(p + "rows"))

    every = {"b_": blocks, "t_": tiles}
    sizes = {p: d.groupBy(*edges[p]).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias(p + "lists")) for p, d in every.items()}
    met = spread(sizes["b_"], "b_").join(spread(sizes["t_"], "t_"), ["cy", "cx"])
    met = met.filter("b_y0 < t_y1 AND t_y0 < b_y1 AND b_x0 < t_x1 AND t_x0 < b_x1")
    own = (F.col("cy") == F.floor(F.greatest("b_y0", "t_y0") / cell)) & (F.col("cx") == F.floor(F.greatest("b_x0", "t_x0") / cell))
    work = met.filter(own).drop("cy", "cx")
    for p, d in every.items():
        work = work.withColumn(p + "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col(p + "lists") - 1)))
        work = work.join(lists(d, sizes[p], p), [*edges[p], p + "list"])
    work = work.repartition(n, *edges["b_"], "b_list", *edges["t_"], "t_list")
    for p, d in every.items():
        left = [c for c in work.columns if c != p + "rows"]
        # Compiled code keeps all rows that one row of its input gives, so only the tiles of one block are made
        # by it: transform is not compiled, and what it gives is passed on block by block.
        each = F.transform(p + "rows", lambda r: r) if p == "b_" else F.col(p + "rows")
        work = work.select(*left, F.explode(each).alias("__r")).select(*left, *[F.col("__r")[c].alias(c) for c in d.columns if c not in edges[p]])
    return work.select(*blocks.columns, *tiles.columns)


def pixels_to_windows(pixels: DataFrame, patch: int, stride: int) -> DataFrame:
    """Each pixel with the ordinal of every tile that covers it."""
    first = lambda n: F.greatest(F.ceil((F.col(n) - patch + 1) / stride), F.lit(0)).cast("long")
    cover = lambda n: F.sequence(first(n), F.floor(F.col(n) / stride).cast("long"))
    reach = lambda d, n: d.filter(first(n) <= F.floor(F.col(n) / stride))
    out = reach(reach(pixels, "y"), "x")
    return out.select("*", F.explode(cover("y")).alias("row")).select("*", F.explode(cover("x")).alias("col"))
