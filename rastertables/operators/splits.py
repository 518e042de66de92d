"""Splits, sampling caps, plans of epochs and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiling import running_before, seeded_order


def global_rank(df: DataFrame, order: Column, key: str, out: str) -> DataFrame:
    """Rank from 1 of all rows by (order, key), in two passes over 4096 buckets
    of the hash, so that no task sees all rows."""
    keyed = df.withColumn("__o", order).withColumn("__b", F.substring("__o", 1, 3))
    sizes = keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select(F.col("__b").alias("__k"), before.alias("__a"))
    within = F.row_number().over(Window.partitionBy("__b").orderBy("__o", key))
    return keyed.withColumn("__r", within).join(ahead, F.col("__b") == F.col("__k")).withColumn(out, (F.col("__a") + F.col("__r")).cast("long")).drop("__o", "__b", "__n", "__k", "__a", "__r")


def split_by_group(ids: DataFrame, key: str, fraction: float, least: int, seed: str) -> DataFrame:
    """(key, split) of the distinct keys; min(max(least, round(n f)), n) are val."""
    distinct = ids.select(key).distinct()
    ranked = global_rank(distinct, seeded_order(seed, key), key, "__rank")
    n = ranked.agg(F.count(F.lit(1)).alias("__total"))
    want = F.least(F.greatest(F.lit(least), F.rint(F.col("__total") * F.lit(fraction))), F.col("__total"))
    return ranked.crossJoin(F.broadcast(n)).select(key, F.when(F.col("__rank") <= want, "val").otherwise("train").alias("split"))


def split_records(df: DataFrame, key: str, val: float, test: float, seed: str) -> DataFrame:
    """Row-level split: train first, then val, the rest test."""
    if val < 0 or test < 0 or val + test > 1:
        raise ValueError("val and test must be shares of at most 1 together")
    ranked = global_rank(df, seeded_order(seed, key), key, "__rank")
    n = df.agg(F.count(F.lit(1)).alias("__total"))
    n_val, n_test = F.rint(F.col("__total") * F.lit(val)), F.rint(F.col("__total") * F.lit(test))
    n_train = F.greatest(F.col("__total") - n_val - n_test, F.lit(0))
    split = F.when(F.col("__rank") <= n_train, "train").when(F.col("__rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.crossJoin(F.broadcast(n)).withColumn("split", split).drop("__rank", "__total")


def assign_split(crops: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Crops inherit their observation's split; others are dropped."""
    return crops.join(splits.select(key, "split"), key)


def spatial_holdout(df: DataFrame, width: str, size: int, fraction: float) -> DataFrame:
    edge = F.rint(F.col(width) * F.lit(1 - fraction))
    return df.withColumn("split", F.when(F.col("col") + size // 2 >= edge, "val").otherwise("train"))


def select_split(df: DataFrame, split: str) -> DataFrame:
    return df if split == "all" else df.filter(F.col("split") == split)


def split_counts(df: DataFrame, kept: Column) -> DataFrame:
    """Candidates and kept rows per split, and in total (split null)."""
    return df.rollup("split").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(kept).alias("kept"))


def sample_per_group(df: DataFrame, groups: list[str], key: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` random rows of each group."""
    order = seeded_order(seed, *groups, key)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*groups).orderBy(order, key))).filter(F.col("__n") <= most).drop("__n")


def cap_class_total(samples: DataFrame, cls: str, crop: str, most: int) -> DataFrame:
    """Crops in order contribute to a class while its total before is below ``most``."""
    counts = samples.groupBy(cls, crop).agg(F.count(F.lit(1)).alias("n"))
    return running_before(counts, cls, crop, F.col("n"), "before", "class-totals").filter(F.col("before") < most)


def first_n_with_minimum(df: DataFrame, cls: str, order: str, least: int, most: int) -> DataFrame:
    """The first ``most`` rows of each class that has ``least``."""
    enough = df.groupBy(cls).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") >= least).select(F.col(cls).alias("__k"))
    out = running_before(df, cls, order, F.lit(1), "__n", "class-ranks").filter(F.col("__n") < most)
    return out.join(enough, F.col(cls).eqNullSafe(F.col("__k"))).drop("__n", "__k")


def epoch_plan(ids: DataFrame, key: str, seed: int, epoch: int, batch: int, drop_last: bool, consumed: int) -> DataFrame:
    """Batches of an epoch's permutation that are still to come."""
    ranked = global_rank(ids, seeded_order(str(seed + epoch), key), key, "__rank")
    out = ranked.withColumn("batch", F.floor((F.col("__rank") - 1) / batch).cast("long")).withColumn("slot", (F.col("__rank") - 1) % batch)
    if drop_last:
        full = ids.agg(F.floor(F.count(F.lit(1)) / batch).alias("__full"))
        out = out.crossJoin(F.broadcast(full)).filter(F.col("batch") < F.col("__full")).drop("__full")
    return out.filter(F.col("batch") >= consumed).drop("__rank")


def exact_ratio_mask(crops: DataFrame, key: str, gh: int, gw: int, ratio: float, seed: str) -> DataFrame:
    """Cells of each crop, exactly round(gh gw ratio) of them masked."""
    cells = crops.select(key, F.explode(F.sequence(F.lit(0), F.lit(gh * gw - 1))).alias("cell"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(seeded_order(seed, key, "cell"), "cell"))
    return cells.withColumn("masked", rank <= round(gh * gw * ratio))


def random_mask(crops: DataFrame, key: str, size: int, unit: int, ratio: float, seed: str) -> DataFrame:
    """Units of each crop, each masked with probability ``ratio``; ``mask_pixels``
    expands them."""
    if size % unit:
        raise ValueError("the unit must divide the size")
    cells = crops.select(key, F.explode(F.sequence(F.lit(0), F.lit((size // unit) ** 2 - 1))).alias("cell"))
    draw = F.conv(F.substring(seeded_order(seed, key, "cell"), 1, 8), 16, 10).cast("double") / 4294967296.0
    return cells.withColumn("masked", draw < ratio)


def mask_pixels(cells: DataFrame, size: int, unit: int) -> DataFrame:
    """The pixels (y, x) of units (cell: their number in row order)."""
    each = F.explode(F.sequence(F.lit(0), F.lit(unit * unit - 1))).alias("__i")
    wide = size // unit
    y = F.floor(F.col("cell") / wide) * unit + F.floor(F.col("__i") / unit)
    x = F.col("cell") % wide * unit + F.col("__i") % unit
    return cells.select("*", each).withColumn("y", y.cast("int")).withColumn("x", x.cast("int")).drop("__i", "cell")


def flip_augment(pixels: DataFrame, key: str, width: int, height: int, seed: str) -> DataFrame:
    """Fair horizontal and vertical flips, one coin each for all bands of a tile."""
    coin = lambda axis: F.conv(F.substring(seeded_order(f"{seed}:{axis}", key), 1, 1), 16, 10).cast("int") < 8
    return pixels.withColumn("x", F.when(coin("h"), width - 1 - F.col("x")).otherwise(F.col("x"))).withColumn("y", F.when(coin("v"), height - 1 - F.col("y")).otherwise(F.col("y")))


def apply_mask(value: Column, mask: Column, fill: float = 0.0) -> Column:
    return F.when(mask, F.lit(fill)).otherwise(value)


def composite(original: Column, reconstruction: Column, mask: Column) -> Column:
    return F.when(mask, reconstruction).otherwise(original)


def resume_plan(candidates: DataFrame, existing: DataFrame, key: str, overwrite: bool) -> DataFrame:
    """(key, action): kept candidates to write, existing outputs of rejected ones to delete."""
    kept, rejected = candidates.filter("keep").select(key), candidates.filter("NOT keep").select(key)
    write = kept if overwrite else kept.join(existing, key, "left_anti")
    delete = rejected.join(existing, key, "left_semi")
    return write.withColumn("action", F.lit("write")).unionByName(delete.withColumn("action", F.lit("delete")))


def append_manifests(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_is_partition(ids: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """One row: n_both (in train and val), n_missing, n_extra; all 0 for a partition."""
    part = lambda s: splits.filter(F.col("split") == s).select(key)
    both = part("train").intersect(part("val"))
    union = part("train").union(part("val")).distinct()
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    return count(both, "n_both").crossJoin(count(ids.select(key).distinct().subtract(union), "n_missing")).crossJoin(count(union.subtract(ids.select(key)), "n_extra"))
