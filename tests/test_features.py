"""Fitted features against numpy."""

import numpy as np
import pytest

from rastertables import catalogue
from rastertables.operators.features import fit_class_gaussians, fit_class_pca, mahalanobis_score, project_components
from rastertables.sources.manifests import load_artifact

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return catalogue.view(spark, DATA, "logits").select("vec_id", "target", "logits")


@pytest.fixture(scope="module")
def table(rows):
    return rows.toPandas().sort_values("vec_id", ignore_index=True)


def test_gaussians_and_distances(rows, table):
    x, y = np.stack(table["logits"]), table["target"].to_numpy()
    classes = np.unique(y)
    means = np.stack([x[y == c].mean(axis=0) for c in classes])
    rest = x - means[np.searchsorted(classes, y)]
    precision = np.linalg.pinv(rest.T @ rest / (len(x) - 1) + 1e-6 * np.eye(x.shape[1]))
    fitted = fit_class_gaussians(rows, "target", "logits")
    found = fitted.toPandas().sort_values("target", ignore_index=True)
    np.testing.assert_allclose(np.stack(found["mean"]), means, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(np.array(found["precision"][0]).reshape(precision.shape), precision, rtol=1e-5, atol=1e-8)
    d = np.sqrt(np.min([np.einsum("nf,fg,ng->n", x - m, precision, x - m) for m in means], axis=0))
    scores = mahalanobis_score(rows, fitted, "logits").toPandas().sort_values("vec_id", ignore_index=True)
    np.testing.assert_allclose(scores["score"], d, rtol=1e-5)
    half = mahalanobis_score(rows, fitted, "logits", reference=float(np.median(d))).toPandas()["score"]
    assert half.max() == 1 and half.min() >= 0


def test_components_and_projections(rows, table):
    pca = fit_class_pca(rows, "target", "logits", 3)
    found = pca.toPandas()
    scores = project_components(rows, pca, "target", "logits").toPandas()
    for c, part in table.groupby("target"):
        x = np.stack(part["logits"])
        centred = x - x.mean(axis=0)
        s = np.linalg.svd(centred, compute_uv=False)
        own = found[found["target"] == c].sort_values("component")
        np.testing.assert_allclose(own["eigenvalue"], (s**2 / max(1, len(x) - 1))[: len(own)], rtol=1e-6, atol=1e-9)
        assert (own["n"] == len(x)).all() and len(own) == min(3, *x.shape)
        for i, v in zip(own["component"], own["direction"], strict=True):
            got = scores[(scores["target"] == c) & (scores["component"] == i)].sort_values("vec_id")["score"]
            np.testing.assert_allclose(got, centred @ np.array(v) * sum(v), rtol=1e-6, atol=1e-9)


def test_missing_artifact(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_artifact(spark, str(tmp_path / "none"), "a long")
