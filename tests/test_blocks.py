"""Block-table forms against the pixel forms and against numpy."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rastertables.operators import features, labels, metrics, quality, registration, splits, windows

BLOCK = "image_id long, y0 long, x0 long, h int, w int, channels int, dtype string, pixels binary, image_height int, image_width int"


def blocks_of(spark, images, size):
    rows = []
    for i, a in images.items():
        a = a if a.ndim == 3 else a[:, :, None]
        for y in range(0, a.shape[0], size):
            for x in range(0, a.shape[1], size):
                p = np.ascontiguousarray(a[y : y + size, x : x + size])
                rows.append((i, y, x, p.shape[0], p.shape[1], p.shape[2], p.dtype.name, p.tobytes(), a.shape[0], a.shape[1]))
    return spark.createDataFrame(rows, BLOCK)


def pixels_of(spark, images):
    rows = [(i, int(y), int(x), int(c), float(v)) for i, a in images.items() for (y, x, c), v in np.ndenumerate(a if a.ndim == 3 else a[:, :, None])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, ch int, dn double")


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    return {
        1: rng.integers(0, 256, (20, 31)).astype(np.uint8), 2: np.full((9, 9), 100, np.uint8), 3: np.zeros((8, 8), np.uint8),
        4: np.where(rng.random((17, 12, 2)) < 0.3, 0, rng.integers(1, 255, (17, 12, 2))).astype(np.uint8),
    }


def test_quality_of_blocks_is_that_of_pixels(spark, images):
    counts = quality.value_counts(blocks_of(spark, images, 8)).cache()
    pixels = pixels_of(spark, images)
    own = {r.image_id: r.invalid_fraction for r in quality.block_invalid_fraction(counts).collect()}
    assert own == {r.image_id: r.invalid_fraction for r in quality.invalid_fraction(pixels, "image_id").collect()}
    got = {r.image_id: r.std for r in quality.block_std(counts, quality.stretch_limits(counts)).collect()}
    want = {r.image_id: r.std for r in quality.tile_std(quality.robust_stretch(pixels, "image_id"), "image_id").collect()}
    assert got.keys() == want.keys() and all(a is None and b is None or abs(a - b) < 1e-9 for a, b in ((got[i], want[i]) for i in want))


@pytest.mark.parametrize("kind", ["uint16", "float32"])
def test_other_types_of_pixels(spark, kind):
    rng = np.random.default_rng(1)
    a = (rng.random((12, 12)) * 60000).astype(kind)
    a[0, :3] = 0
    if kind == "float32":
        a[1, 0], a[1, 1], a[1, 2] = np.nan, np.inf, -3.4e38
    counts = quality.value_counts(blocks_of(spark, {1: a}, 5))
    bad = 3 / 144
    assert abs(quality.block_invalid_fraction(counts).first().invalid_fraction - bad) < 1e-12
    limit = quality.stretch_limits(counts).first()
    good = a[(a != 0)] if kind == "uint16" else a[np.isfinite(a) & (a > -3e38)]
    assert np.allclose([limit.lo, limit.hi], np.percentile(good.astype(float), [1, 99]))


def test_previews_have_three_channels(spark):
    a = np.random.default_rng(2).integers(0, 256, (6, 6, 5)).astype(np.uint8)
    blocks = blocks_of(spark, {1: a}, 6)
    (row,) = quality.stretch_blocks(blocks, quality.stretch_limits(quality.value_counts(blocks), finite=True), out="preview").collect()
    lo, hi = np.percentile(a, [1, 99])
    want = np.floor(np.clip((a[:, :, :3].astype(float) - lo) / (hi - lo), 0, 1) * 255)
    assert row.channels == 3 and (np.frombuffer(row.pixels, np.uint8).reshape(6, 6, 3) == want).all()


@pytest.mark.parametrize("form", ["blocks", "pixels"])
def test_percentiles_are_rounded_like_those_of_sql(spark, form):
    """A preview truncates, so the last bit of a percentile decides over a level."""
    rng = np.random.default_rng(8)
    images = {i: rng.integers(0, 256, (1, int(rng.integers(2, 80)))).astype(np.uint8) for i in range(400)}
    rows = pd.DataFrame([(i, float(v)) for i, a in images.items() for v in a.ravel()], columns=["i", "v"])
    want = {i: (p, q) for i, p, q in duckdb.sql("SELECT i, quantile_cont(v, 0.01), quantile_cont(v, 0.99) FROM rows GROUP BY i").fetchall()}
    if form == "blocks":
        found = quality.stretch_limits(quality.value_counts(blocks_of(spark, images, 80)), finite=True)
        got = {r.image_id: (r.lo, r.hi) for r in found.collect()}
    else:
        found = quality.robust_stretch(spark.createDataFrame(rows).withColumnRenamed("v", "dn"), "i", dtype="float64").select("i", "lo", "hi").distinct()
        got = {r.i: (r.lo, r.hi) for r in found.collect()}
    same = {i for i, (p, q) in want.items() if q > p}
    assert len(same) > 390 and [got[i] for i in same] == [want[i] for i in same]


def test_sweeps_against_numpy(spark):
    rng = np.random.default_rng(3)
    lab = np.kron(rng.integers(0, 4, (7, 9)), np.ones((8, 8), int)).astype(np.uint8)[:50, :66]
    img = np.clip(np.roll(lab, (2, -1), (0, 1)) * 40 + rng.integers(0, 30, lab.shape), 0, 255).astype(np.uint8)
    imagery, classes = blocks_of(spark, {1: img}, 16), blocks_of(spark, {1: lab}, 16)
    reach, step, ds = 4, 2, 2
    got = {(r.dy, r.dx): r.fisher for r in registration.separability_sweep(imagery, classes, reach, 16, step, ds, 20, 100).collect()}
    small, codes, pad = img[::ds, ::ds].astype(float), lab[::ds, ::ds], reach // ds + 1
    for (dy, dx), value in got.items():
        a = small[pad : small.shape[0] - pad, pad : small.shape[1] - pad]
        b = codes[pad + dy // ds : codes.shape[0] - pad + dy // ds, pad + dx // ds : codes.shape[1] - pad + dx // ds]
        ok = (a > 0) & (b > 0)
        between = sum((ok & (b == c)).sum() * (a[ok & (b == c)].mean() - a[ok].mean()) ** 2 for c in range(1, 4) if (ok & (b == c)).sum() >= 20) / ok.sum()
        assert abs(value - between / (a[ok].var() + 1e-9)) < 1e-9
    assert len(got) == 25 and (registration.peaks(registration.separability_sweep(imagery, classes, reach, 16, 2, 1, 20, 100), "fisher").first().dy) == -2
    found = {(r.dy, r.dx): r.energy for r in registration.edge_sweep(imagery, classes, 3, 16, 10).collect()}
    grad = windows.smoothed(windows.gradient(img[:, :, None].astype(float)), 1.0)[:, :, 0]
    grad[img == 0] = 0
    edge = np.zeros(lab.shape, bool)
    edge[:, :-1] |= lab[:, 1:] != lab[:, :-1]
    edge[:-1] |= lab[1:] != lab[:-1]
    ys, xs = np.nonzero(edge & (lab > 0))
    inside = (ys > 3) & (ys < 47) & (xs > 3) & (xs < 63)
    ys, xs = ys[inside], xs[inside]
    assert all(abs(found[dy, dx] - grad[ys + dy, xs + dx].mean()) < 1e-6 for dy in range(-3, 4) for dx in range(-3, 4))
    assert registration.edge_sweep(imagery, classes, 3, 16, 10**6).collect()[0].energy is None


def test_reference_distance_is_the_quantile(spark):
    rng = np.random.default_rng(7)
    for v in (rng.normal(size=1001), np.repeat([1.0, 2.0, 9.0], 40), np.array([3.0]), rng.integers(0, 5, 200).astype(float)):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "d double")
        for q in (0.95, 0.5, 0.0, 1.0):
            assert abs(metrics.reference_distance(df, "d", q).first().reference - np.quantile(v, q)) < 1e-9
    assert metrics.reference_distance(spark.createDataFrame([], "d double"), "d").first().reference is None


def test_caps_of_a_class_with_most_rows(spark):
    rows = [("a" if i % 10 else "b", i // 3) for i in range(600)]
    df = spark.createDataFrame(rows, "c string, crop int")
    got = {(r.c, r.crop, r.before) for r in splits.cap_class_total(df, "c", "crop", 50).collect()}
    want = set()
    for c in "ab":
        before = 0
        for crop in sorted({k for x, k in rows if x == c}):
            if before < 50:
                want.add((c, crop, before))
            before += sum(r == (c, crop) for r in rows)
    assert got == want
    kept = splits.first_n_with_minimum(df.distinct(), "c", "crop", 55, 70).collect()
    crops = {c: sorted({k for x, k in rows if x == c}) for c in "ab"}
    assert {(r.c, r.crop) for r in kept} == {(c, k) for c in "ab" if len(crops[c]) >= 55 for k in crops[c][:70]}


def test_class_ids_of_heads_are_checked(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "k int, f array<double>")
    heads = spark.createDataFrame([(0, [1.0, 0.0], 0.5), (1, [0.0, 1.0], 0.0)], "class_id long, w array<double>, b double")
    assert sorted(r.logit for r in features.linear_logits(rows, heads, "f").collect()) == [1.5, 2.0]
    assert features.linear_logits(rows, heads, "f", [1]).first().logit == 2.0
    with pytest.raises(ValueError):
        features.linear_logits(rows, heads, "f", [2])
    with pytest.raises(ValueError):
        features.linear_logits(rows, heads.filter("class_id = 1"), "f")


def test_no_version_folder_is_an_error(spark):
    files = spark.createDataFrame([("/maps/other/a.tif",)], "path string")
    with pytest.raises(FileNotFoundError):
        labels.latest_version_tiles(files)


def test_mosaic_gaps_are_nodata(spark):
    pixels = spark.createDataFrame([("a", 0, 0, 5), ("b", 0, 0, 0), ("a", 0, 1, 0)], "tile string, y long, x long, dn int")
    assert sorted(map(tuple, labels.mosaic_composite(pixels).collect())) == [(0, 0, 5), (0, 1, 0)]
    full = labels.fill_gaps(labels.mosaic_composite(pixels), 2, 2, "dn", 0)
    assert sorted(map(tuple, full.select("y", "x", F.col("dn").cast("int")).collect())) == [(0, 0, 5), (0, 1, 0), (1, 0, 0), (1, 1, 0)]
