"""Block mosaics against numpy: ragged images, missing blocks, hot cells, other types."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertables.operators import exchange, labels, mosaics, registration

BLOCK = "image_id long, y0 long, x0 long, h int, w int, channels int, dtype string, pixels binary, image_height int, image_width int"


def blocks_of(spark, images, size, without=()):
    rows = []
    for i, a in images.items():
        a = a if a.ndim == 3 else a[:, :, None]
        for y in range(0, a.shape[0], size):
            for x in range(0, a.shape[1], size):
                p = np.ascontiguousarray(a[y : y + size, x : x + size])
                if (i, y, x) not in without:
                    rows.append((i, y, x, p.shape[0], p.shape[1], p.shape[2], p.dtype.name, p.tobytes(), a.shape[0], a.shape[1]))
    return spark.createDataFrame(rows, BLOCK)


def whole(df, shape, image=1, fill=0.0, channel=0):
    out = np.full(shape, fill)
    for r in df.filter(F.col("image_id") == image).collect():
        a = np.frombuffer(r.pixels, np.dtype(r.dtype)).reshape(r.h, r.w, -1)[:, :, channel]
        out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = a
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).integers(0, 256, (75, 103)).astype(np.uint8)


def test_strips_of_a_cell(spark, image):
    """Each cell gets its own area and what neighbours have within the reach, also if the reach
    is wider than a block; the strips are small."""
    got = exchange.met(exchange.send(blocks_of(spark, {1: image}, 10), 10, "a", 3, 12)).collect()
    for r in got:
        parts = [p.asDict() for p in r.parts]
        area = exchange.placed(parts, r.cy * 10 - 3, r.cx * 10 - 3, 25, 25, -1, "int64")[:, :, 0]
        want = np.full((200, 200), -1)
        want[3 : 3 + image.shape[0], 3 : 3 + image.shape[1]] = image
        assert (area == want[r.cy * 10 : r.cy * 10 + 25, r.cx * 10 : r.cx * 10 + 25]).all()
    near = exchange.send(blocks_of(spark, {1: image}, 10), 10, "a", 0, 1, others=True)
    assert near.agg(F.sum(F.octet_length("pixels"))).first()[0] < 0.25 * image.size


def test_prefix_sums_of_ten_by_ten_blocks(spark):
    image = np.random.default_rng(2).integers(0, 60_000, (97, 100)).astype(np.uint16)
    blocks = blocks_of(spark, {1: image, 2: image[:30, :5]}, 10)
    integral = mosaics.integral_blocks(blocks, 10).cache()
    want = image.astype(np.int64).cumsum(0).cumsum(1)
    assert (whole(integral, image.shape) == want).all() and (whole(integral, (30, 5), 2) == want[:30, :5]).all()
    rng = np.random.default_rng(3)
    boxes = [(1, *map(int, (*sorted(rng.integers(0, 98, 2)), *sorted(rng.integers(0, 101, 2))))) for _ in range(40)] + [(1, 0, 97, 0, 100), (1, 5, 5, 0, 9), (2, 0, 1, 0, 1), (9, 0, 1, 0, 1)]
    windows = spark.createDataFrame([(i, a, c, b, d) for i, a, b, c, d in boxes], "image_id long, y0 int, x0 int, y1 int, x1 int")
    source = {1: image, 2: image[:30, :5], 9: np.zeros((1, 1), int)}
    got = sorted(map(tuple, mosaics.window_sums(integral, windows.distinct(), 10).collect()))
    assert got == sorted({(i, a, c, b, d, int(source[i][a:b, c:d].sum())) for i, a, b, c, d in boxes})


def test_prefix_sums_over_missing_blocks(spark):
    """A missing block counts as zeros, for what lies beyond it as well."""
    image = np.random.default_rng(4).integers(0, 9, (40, 50)).astype(np.float32)
    gaps = {(1, 0, 0), (1, 10, 20), (1, 10, 30), (1, 30, 40)}
    there = image.copy()
    for _, y, x in gaps:
        there[y : y + 10, x : x + 10] = 0
    got = whole(mosaics.integral_blocks(blocks_of(spark, {1: image}, 10, gaps), 10), image.shape, fill=np.nan)
    want = there.astype(float).cumsum(0).cumsum(1)
    assert np.isnan(got).sum() == 400 and np.allclose(got[~np.isnan(got)], want[~np.isnan(got)])


def test_edges_and_pairs(spark, image):
    classes = (image // 64).astype(np.uint8)
    edge = np.zeros(classes.shape, bool)
    edge[:, :-1] |= classes[:, 1:] != classes[:, :-1]
    edge[:-1] |= classes[1:] != classes[:-1]
    got = whole(mosaics.label_edge_blocks(blocks_of(spark, {1: classes}, 16), 16), image.shape)
    assert (got == (edge & (classes > 0))).all()
    paired = mosaics.pair_blocks(blocks_of(spark, {1: image}, 16), blocks_of(spark, {1: classes}, 16), 16, -21, 40).collect()
    want = np.zeros(image.shape, int)
    want[21:, :63] = classes[:54, 40:]
    for r in paired:
        assert (np.frombuffer(r.label_pixels, np.int64).reshape(r.h, r.w) == want[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]).all()
    assert len(paired) == 35


def tiles_of(spark, rows):
    kind = "tile string, image_id long, row long, col long, h int, w int, channels int, dtype string, pixels binary, valid_height int, valid_width int"
    return spark.createDataFrame([(t, 1, y, x, a.shape[0], a.shape[1], 1, a.dtype.name, a.tobytes(), *(valid or (None, None))) for t, y, x, a, valid in rows], kind)


def test_overlaps_are_averaged_or_laid_over(spark, monkeypatch):
    """Most tiles lie on one cell; a task must give what it holds several times."""
    rng = np.random.default_rng(5)
    rows = [(f"t{rng.integers(1000):03d}-{i}", *(int(v) for v in (rng.integers(0, 9, 2) if i % 10 else rng.integers(0, 60, 2))), rng.integers(0, 3, (12, 9)).astype(np.uint8), None if i % 3 else (7, 8)) for i in range(300)]
    total, n, last = np.zeros((80, 80)), np.zeros((80, 80)), np.zeros((80, 80))
    for t, y, x, a, valid in sorted(rows, key=lambda r: r[0]):
        v = a[: valid[0], : valid[1]] if valid else a
        total[y : y + v.shape[0], x : x + v.shape[1]] += v
        n[y : y + v.shape[0], x : x + v.shape[1]] += 1
        area = last[y : y + 12, x : x + 9]
        area[a != 0] = a[a != 0]
    monkeypatch.setattr(mosaics, "HELD", 10_000)
    tiles = tiles_of(spark, rows)
    mean = mosaics.stitch_blocks(tiles, 16).cache()
    assert np.allclose(whole(mean, (80, 80)), total / np.maximum(n, 1)) and (whole(mean, (80, 80), channel=1) == n).all()
    canvas = spark.createDataFrame([(1, 70, 33)], "image_id long, height int, width int")
    cut = mosaics.stitch_blocks(tiles, 16, canvas)
    assert cut.count() == 15 and cut.agg(F.sum(F.col("h") * F.col("w"))).first()[0] == 70 * 33
    assert np.allclose(whole(cut, (70, 33)), (total / np.maximum(n, 1))[:70, :33])
    plain = tiles.drop("valid_height", "valid_width")
    assert (whole(mosaics.composite_blocks(plain, 16), (80, 80)) == last).all()
    full = mosaics.composite_blocks(plain, 16, 0, canvas)
    assert full.count() == 15 and (whole(full, (70, 33)) == last[:70, :33]).all()
    assert mosaics.stitch_blocks(tiles.filter("false"), 16).count() == 0 and mosaics.composite_blocks(plain.filter("false"), 16, 0, canvas).count() == 15


def test_means_and_overviews(spark, image):
    blocks = blocks_of(spark, {1: image}, 16)
    down = mosaics.downsample_blocks(blocks, 16, 5)
    padded = np.pad(image, ((0, -75 % 5), (0, -103 % 5)), mode="edge").astype(float)
    assert np.allclose(whole(down, (15, 21), fill=np.nan), padded.reshape(15, 5, 21, 5).mean((1, 3)))
    levels = mosaics.pyramid_blocks(blocks, 16, (2, 4, 12)).cache()
    for f in (2, 4, 12):
        h, w = -(-75 // f), -(-103 // f)
        want = np.array([[image[y * f : y * f + f, x * f : x * f + f].mean() for x in range(w)] for y in range(h)])
        assert np.allclose(whole(levels.filter(F.col("factor") == f), (h, w), fill=np.nan), want)
    near = mosaics.pyramid_blocks(blocks, 16, (3,), categorical=True)
    assert (whole(near, (25, 34)) == image[1::3, 1::3]).all()


def test_colours_are_decoded_in_blocks(spark):
    rng = np.random.default_rng(6)
    rgba = rng.integers(0, 256, (37, 41, 4)).astype(np.uint8)
    rgba[:, :, :3] = rgba[:, :, :3] // 40 * 40
    rgba[:, :, 3] = np.where(rgba[:, :, 3] < 60, 0, 255)
    palette = spark.createDataFrame([(1, 0, 0, 0), (2, 200, 40, 80), (3, 240, 240, 0)], "class_id long, r int, g int, b int")
    blocks = blocks_of(spark, {1: rgba}, 16)
    got = whole(mosaics.decode_blocks(blocks, palette, 9000), (37, 41))
    y, x = np.mgrid[:37, :41]
    pixels = spark.createDataFrame([tuple(int(v) for v in r) for r in np.column_stack([y.ravel(), x.ravel(), *rgba.reshape(-1, 4).T])], "y long, x long, r long, g long, b long, a long")
    decoded = labels.decode_colours(pixels, palette, 9000).cache()
    want = np.zeros((37, 41))
    for r in decoded.collect():
        want[r.y, r.x] = r.class_id
    assert (got == want).all() and want.max() == 3
    assert sorted(map(tuple, mosaics.block_histogram(blocks, palette, 9000).collect())) == sorted(map(tuple, labels.class_histogram(decoded, palette).collect()))


@pytest.mark.parametrize("direct", [0, 1000])
def test_sums_by_shift_are_whole_numbers(spark, monkeypatch, direct):
    """16-bit DN over wide shifts: the sums of squares are exact, by FFT and added up."""
    monkeypatch.setattr(registration, "DIRECT", direct)
    rng = np.random.default_rng(8)
    image, classes = rng.integers(0, 65_536, (70, 90)).astype(np.uint16), rng.integers(0, 4, (70, 90)).astype(np.uint8)
    shifts = [(0, 0), (25, -3), (-30, 31)]
    got = {(r.dy, r.dx, r.class_id): (r.n, r.s, r.ss) for r in registration.shift_sums(blocks_of(spark, {1: image}, 32), blocks_of(spark, {1: classes}, 32), shifts, 32).collect()}
    want = {}
    for dy, dx in shifts:
        for y in range(max(0, -dy), min(70, 70 - dy)):
            a, b = image[y, max(0, -dx) : 90 - max(0, dx)].astype(int), classes[y + dy, max(0, dx) : 90 - max(0, -dx)]
            for c in (1, 2, 3):
                v = a[(b == c) & (a > 0)]
                n, s, ss = want.get((dy, dx, c), (0, 0, 0))
                want[dy, dx, c] = n + len(v), s + int(v.sum()), ss + int((v * v).sum())
    assert got == want
