"""Evaluation of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segmentation_metrics(pairs: DataFrame, batch: str, ignore: int = 255) -> DataFrame:
    """Per batch: pixel accuracy and mean IoU over classes with a union."""
    counts = pairs.filter(F.col("target") != ignore).groupBy(batch, "pred", "target").agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(batch, F.col("pred").alias("c"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t"), F.when(F.col("pred") == F.col("target"), F.col("n")).otherwise(0).alias("i"))
    sides = sides.unionByName(counts.select(batch, F.col("target").alias("c"), F.lit(0).cast("long").alias("p"), F.col("n").alias("t"), F.lit(0).cast("long").alias("i")))
    per = sides.groupBy(batch, "c").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.sum("i").alias("i"))
    found = per.groupBy(batch).agg((F.sum("i") / F.sum("t")).alias("accuracy"), F.avg(F.col("i") / (F.col("p") + F.col("t") - F.col("i"))).alias("miou"))
    return pairs.select(batch).distinct().join(found, batch, "left").fillna(0.0, ["accuracy", "miou"])


def epoch_metrics(batches: DataFrame, epoch: str, metric: str, size: str) -> DataFrame:
    return batches.groupBy(epoch).agg((F.sum(F.col(metric) * F.col(size)) / F.sum(size)).alias(metric))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def cross_entropy(rows: DataFrame, ignore: int = 255) -> DataFrame:
    loss = log_sum_exp(F.col("logits")) - F.get("logits", F.col("target").cast("int"))
    return rows.agg(F.avg(F.when(F.col("target") != ignore, loss)).alias("loss"))


def softmax(logits: Column) -> Column:
    return F.transform(logits, lambda x: F.exp(x - log_sum_exp(logits)))


def confidence_entropy(rows: DataFrame) -> DataFrame:
    """Highest softmax share, entropy and first best class of each row's logits."""
    p = rows.withColumn("__p", softmax(F.col("logits")))
    entropy = F.aggregate("__p", F.lit(0.0), lambda a, x: a - x * F.log(F.greatest(x, F.lit(1e-8))))
    return p.withColumn("confidence", F.array_max("__p")).withColumn("entropy", entropy).withColumn("argmax", F.array_position("logits", F.array_max("logits")) - 1).drop("__p")


def masked_loss(rows: DataFrame, batch: str, kind: str = "l1") -> DataFrame:
    """Reconstruction loss over masked pixels only."""
    d = F.abs(F.col("recon") - F.col("target"))
    loss = {"l1": d, "mse": d * d, "smooth_l1": F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)}[kind]
    return rows.groupBy(batch).agg((F.sum(F.when(F.col("mask"), loss).otherwise(0.0)) / F.greatest(F.count_if("mask"), F.lit(1))).alias("loss"))


def weighted_loss(losses: DataFrame, size: str = "n") -> DataFrame:
    """One row: the loss of a set, each batch weighted by its samples."""
    return losses.agg((F.sum(F.col("loss") * F.col(size)) / F.sum(size)).alias("loss"))


def class_presence(rows: DataFrame, crop: str, label: str, ignore: int = 255, least: float = 0.05) -> DataFrame:
    valid = rows.filter(F.col(label) != ignore)
    total = valid.groupBy(crop).agg(F.count(F.lit(1)).alias("total"))
    share = valid.groupBy(crop, label).agg(F.count(F.lit(1)).alias("n")).join(total, crop).withColumn("share", F.col("n") / F.col("total"))
    return share.filter(F.col("share") >= least).select(crop, label, "share")


def best_epoch(history: DataFrame, run: str, epoch: str, metric: str, goal: str = "max") -> DataFrame:
    order = F.desc(metric) if goal == "max" else F.asc(metric)
    return history.withColumn("__n", F.row_number().over(Window.partitionBy(run).orderBy(order, epoch))).filter("__n = 1").drop("__n")


def top_k_gallery(scores: DataFrame, groups: list[str], key: str, k: int = 6) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def feature_distance(a: DataFrame, b: DataFrame, key: str, normalise: bool = False) -> DataFrame:
    """Mean squared difference of two feature tables (key, f); with ``normalise``
    each vector is divided by its length first."""
    length = lambda f: F.greatest(F.sqrt(F.aggregate(f, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12))
    unit = lambda d, out: d.withColumn("__l", length(F.col("f"))).select(key, F.transform("f", lambda x: x / F.col("__l")).alias(out)) if normalise else d.select(key, F.col("f").alias(out))
    both = unit(a, "fa").join(unit(b, "fb"), key)
    return both.agg(F.avg(F.aggregate(F.zip_with("fa", "fb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("fa")).alias("distance"))


def weighted_feature_distance(a: DataFrame, b: DataFrame, key: str, level: str, weights: dict, normalise: bool = False) -> DataFrame:
    """level, distance of feature tables with several levels, and (level null) the
    sum of the levels' distances times their ``weights``; other levels are left out."""
    length = lambda f: F.greatest(F.sqrt(F.aggregate(f, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12))

    def unit(d: DataFrame, out: str) -> DataFrame:
        d = d.filter(F.col(level).isin(list(weights))).withColumn("__l", length(F.col("f")) if normalise else F.lit(1.0))
        return d.select(key, level, F.transform("f", lambda x: x / F.col("__l")).alias(out))

    both = unit(a, "fa").join(unit(b, "fb"), [key, level])
    gap = F.aggregate(F.zip_with("fa", "fb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("fa")
    each = both.groupBy(level).agg(F.avg(gap).alias("distance"))
    weight = F.lit(None).cast("double")
    for name, w in weights.items():
        weight = F.when(F.col(level) == name, F.lit(float(w))).otherwise(weight)
    total = each.agg(F.lit(None).cast(dict(a.dtypes)[level]).alias(level), F.sum(F.col("distance") * weight).alias("distance"))
    return each.unionByName(total)


def reference_distance(scores: DataFrame, value: str, q: float = 0.95, bins: int = 4096) -> DataFrame:
    """One row: the exact, linearly interpolated quantile ``q``.

    Three passes: the range, a histogram of ``bins`` cells, and the values of the
    one or two cells that hold the two order statistics around the quantile; only
    these are sorted."""
    rows = scores.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or low == high:
        return rows.agg(F.max("v").alias("reference"))
    cell = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    celled = rows.withColumn("cell", cell)
    counts = dict(celled.groupBy("cell").count().collect())  # at most ``bins`` rows
    at = q * (n - 1)
    before, wanted, ahead = 0, [], None
    for c in sorted(counts):
        if before <= int(at) + 1 and before + counts[c] > int(at):
            wanted.append(c)
            ahead = before if ahead is None else ahead
        before += counts[c]
    some = celled.filter(F.col("cell").isin(wanted))
    ordered = some.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = ordered.withColumn("upto", F.lit(ahead) + F.sum("n").over(Window.orderBy("v")))
    left, right = F.min(F.when(F.col("upto") > int(at), F.col("v"))), F.min(F.when(F.col("upto") > min(int(at) + 1, n - 1), F.col("v")))
    return upto.agg((left + (right - left) * F.lit(at - int(at))).alias("reference"))
