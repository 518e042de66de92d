"""Set-wide analyses of feature vectors: Gaussians, distances, PCA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Heads (one short row each) that are sent to every task.
MOST_HEADS = 10_000
#: Bytes of matrices that are sent to every task.
MOST_BYTES = 256 << 20


def pooled_features(rows: DataFrame, crop: str, features: str) -> DataFrame:
    """Mean of each feature over a crop, as (crop, dim, mean)."""
    return rows.select(crop, F.posexplode(features).alias("dim", "v")).groupBy(crop, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def class_embedding(pooled: DataFrame, weights: DataFrame) -> DataFrame:
    """psi = w * mean for each class of ``weights`` (class_id, dim, w)."""
    return pooled.join(weights, "dim").withColumn("psi", F.col("w") * F.col("mean"))


def class_moments(rows: DataFrame, label: str, features: str) -> DataFrame:
    """n, mean vector and centred scatter matrix per class.

    Partitions add up moments around the class means of a first pass; what is
    shuffled is one F x F matrix per class and partition."""
    means = rows.select(label, F.posexplode(features).alias("dim", "v")).groupBy(label, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("s")).select(F.col(label).alias("c"), F.transform("s", lambda x: x["m"]).alias("mean"))
    vectors = means.limit(MOST_HEADS + 1).collect()  # one vector per class
    if len(vectors) > MOST_HEADS:
        raise ValueError(f"more than {MOST_HEADS} classes: their means are too many to send to every task")
    known = {r.c: np.array(r.mean) for r in vectors}
    kind = dict(rows.dtypes)[label]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for c, part in b.groupby(label):
                d = np.stack(part[features].to_numpy()).astype(float) - known[c]
                n, s = sums.get(c, (0, 0.0))
                sums[c] = n + len(d), s + d.T @ d
        if sums:
            yield pd.DataFrame({"c": list(sums), "n": [n for n, _ in sums.values()], "s": [s.ravel().tolist() for _, s in sums.values()]})

    parts = rows.select(label, features).mapInPandas(run, f"c {kind}, n long, s array<double>")
    added = parts.select("c", "n", F.posexplode("s").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    scatter = added.groupBy("c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("scatter"))
    return scatter.join(means, "c").withColumnRenamed("c", label)


def fit_class_gaussians(rows: DataFrame, label: str, features: str, shared: bool = True, eps: float = 1e-6) -> DataFrame:
    """label, mean, precision (row-major F x F): per class or of pooled residuals.  Each
    class is inverted where its moments are."""
    moments = stored(class_moments(rows, label, features).select(label, "n", "mean", "scatter"), "class-moments")
    fitted = moments
    if shared:
        pooled = moments.select(F.posexplode("scatter").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
        pooled = pooled.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("scatter"))  # F x F
        fitted = moments.select(label, "mean").crossJoin(F.broadcast(pooled.crossJoin(moments.agg(F.sum("n").alias("n")))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for n, mean, scatter in zip(b["n"], b["mean"], b["scatter"], strict=True):
                s = np.asarray(scatter, float).reshape(len(mean), len(mean))
                found.append(np.linalg.pinv(s / max(1, n - 1) + eps * np.eye(len(s))).ravel().tolist())
            yield pd.DataFrame({label: b[label], "mean": b["mean"], "precision": found})

    return fitted.select(label, "n", "mean", "scatter").mapInPandas(run, f"{label} {dict(rows.dtypes)[label]}, mean array<double>, precision array<double>")


def mahalanobis_score(rows: DataFrame, stats: DataFrame, features: str, reference: float | None = None, normalise: bool | None = None) -> DataFrame:
    """``rows`` with the least distance to any class; with ``normalise`` (where it
    is not given, with a reference) divided by the reference distance (1 where it is
    missing or 0) and clipped to 0..1."""
    normalise = reference is not None if normalise is None else normalise
    held = stats.agg(F.sum(F.size("precision").cast("long"))).first()[0] or 0
    if 8 * held > MOST_BYTES:
        raise ValueError(f"{8 * held} bytes of precisions are too many to send to every task")
    fitted = stats.toPandas()  # F x F per class
    means = np.stack(fitted["mean"].to_numpy())
    precision = np.stack(fitted["precision"].to_numpy()).reshape(len(means), means.shape[1], means.shape[1])

    @F.pandas_udf("double")
    def score(part: pd.Series) -> pd.Series:
        x = np.stack(part.to_numpy()).astype(float)
        if x.shape[1] != means.shape[1]:
            raise ValueError(f"expected {means.shape[1]} features, got {x.shape[1]}")
        d = np.min([np.sqrt(np.maximum(0, np.einsum("nf,fg,ng->n", x - m, p, x - m))) for m, p in zip(means, precision, strict=True)], axis=0)
        return pd.Series(np.clip(d / max(reference or 1.0, 1e-8), 0, 1) if normalise else d)

    return rows.withColumn("score", score(features))


def fit_class_pca(rows: DataFrame, label: str, features: str, n_components: int = 4) -> DataFrame:
    """label, component, eigenvalue, direction, mean, n of each class's principal directions,
    found where the class's moments are."""
    kind = dict(rows.dtypes)[label]
    schema = f"{label} {kind}, component int, eigenvalue double, direction array<double>, mean array<double>, n long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for c, n, mean, scatter in zip(b[label], b["n"], b["mean"], b["scatter"], strict=True):
                dim = len(mean)
                values, vectors = np.linalg.eigh(np.asarray(scatter, float).reshape(dim, dim) / max(1, n - 1))
                out += [(c, i, float(values[-1 - i]), vectors[:, -1 - i].tolist(), list(mean), n) for i in range(min(n_components, n, dim))]
            yield pd.DataFrame(out, columns=[label, "component", "eigenvalue", "direction", "mean", "n"])

    return class_moments(rows, label, features).select(label, "n", "mean", "scatter").mapInPandas(run, schema)


def project_components(rows: DataFrame, pca: DataFrame, label: str, features: str) -> DataFrame:
    """((psi - mean) . v) * sum(v) per component: the same for v and -v."""
    both = rows.join(pca.drop("n"), label)
    dot = F.aggregate(F.zip_with(F.zip_with(features, "mean", lambda x, m: x - m), "direction", lambda x, v: x * v), F.lit(0.0), lambda a, x: a + x)
    return both.withColumn("score", dot * F.aggregate("direction", F.lit(0.0), lambda a, x: a + x)).drop("mean", "direction", "eigenvalue")


def linear_logits(rows: DataFrame, weights: DataFrame, features: str, classes: list[int] | None = None) -> DataFrame:
    """Class scores f . w + b of the heads (class_id, w array, b), which are one
    row a class, numbered from 0.  ``classes`` chooses some; an id that no head has
    is an error."""
    n, low, high = weights.agg(F.count(F.lit(1)), F.min("class_id"), F.max("class_id")).first()
    if n and (low != 0 or high != n - 1):
        raise ValueError(f"{n} heads must have the class ids 0 to {n - 1}, not {low} to {high}")
    if classes is not None:
        wrong = [c for c in classes if not 0 <= c < n]
        if wrong:
            raise ValueError(f"class ids {wrong} are outside 0 to {n - 1}")
        weights = weights.filter(F.col("class_id").isin(classes))
    if n > MOST_HEADS:
        raise ValueError(f"{n} heads are too many to send to every task")
    dot = F.aggregate(F.zip_with(features, "w", lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    return rows.crossJoin(F.broadcast(weights)).withColumn("logit", dot + F.col("b")).drop("w", "b")
