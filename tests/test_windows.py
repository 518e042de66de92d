"""Window kernels against plain numpy over whole images."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from rastertables import catalogue
from rastertables.operators import windows as W
from rastertables.operators.registration import refined_peak

BLOCK, H, WIDTH = 8, 21, 19
IMAGE = np.random.default_rng(1).integers(1, 255, (H, WIDTH, 2)).astype(np.uint8)
KNOWN = [135, 101, 187, 66, 166, 109, 86, 78, 137, 255, 109, 94, 67, 159, 92, 91, 144, 103, 138, 182, 208, 160, 71, 130, 129, 86, 54, 127, 61, 194, 133, 66, 167, 178, 203, 119, 111, 181, 144, 196, 46, 185, 139, 175, 217, 189, 186, 196, 78, 48, 208, 138, 162, 171, 159, 75, 160, 157, 75, 203, 86, 126, 131, 128]
WINDOW_SCHEMA = "image_id string, window_id long, top long, left long, height long, width long, image_height long, image_width long"


@pytest.fixture(scope="module")
def blocks(spark):
    rows = []
    for y in range(0, H, BLOCK):
        for x in range(0, WIDTH, BLOCK):
            cut = IMAGE[y : y + BLOCK, x : x + BLOCK]
            rows.append(("A", y, x, *cut.shape, "uint8", bytearray(cut.tobytes())))
    return spark.createDataFrame(rows, "image_id string, y0 long, x0 long, h int, w int, channels int, dtype string, pixels binary")


def arrays(df):
    return {r["window_id"]: np.frombuffer(r["pixels"], r["dtype"]).reshape(r["h"], r["w"], r["channels"]) for r in df.collect()}


@pytest.mark.parametrize("mode", ["edge", "constant", "symmetric"])
def test_windows_are_padded_cuts(spark, blocks, mode):
    places = [(0, 0, 5, 6), (-3, -2, 9, 9), (15, 12, 10, 12), (5, 6, 12, 11)]
    rows = [("A", i, *p, H, WIDTH) for i, p in enumerate(places)] + [("A", 9, 100, 0, 4, 4, H, WIDTH)]
    found = arrays(W.extract_windows(blocks, spark.createDataFrame(rows, WINDOW_SCHEMA), BLOCK, mode, 7))
    padded = np.pad(IMAGE, ((12, 12), (12, 12), (0, 0)), mode=mode, **({"constant_values": 7} if mode == "constant" else {}))
    for i, (t, l, h, w) in enumerate(places):
        assert (found[i] == padded[t + 12 : t + 12 + h, l + 12 : l + 12 + w]).all()
    assert found[9].shape == (4, 4, 1) and (found[9] == 7).all()


def test_shrunk_windows_are_means(spark, blocks):
    rows = [("A", 0, 0, 0, 10, 10, H, WIDTH)]
    found = arrays(W.extract_windows(blocks, spark.createDataFrame(rows, WINDOW_SCHEMA), BLOCK, shrink=5))[0]
    assert np.allclose(found[1, 0], IMAGE[5:10, :5].reshape(-1, 2).mean(axis=0))


def test_context_is_centred_on_the_base(spark, blocks):
    schema = "image_id string, window_id long, top long, left long, patch_size long, context_scale double, context_output_size long, base_height long, base_width long"
    patches = spark.createDataFrame([("A", 0, 16, 16, 8, 2.0, 6, H, WIDTH)], schema)
    assert (arrays(W.context_from_base(blocks, patches, BLOCK))[0] == IMAGE[7:13, 7:13]).all()


def test_kernels():
    ramp = np.tile(np.arange(6.0)[None, :, None], (5, 1, 1)).astype(np.float32)
    assert np.allclose(W.gradient(ramp)[:, 1:-1], 8) and np.allclose(W.gradient(ramp)[:, 0], 4)
    assert np.allclose(W.smoothed(np.full((4, 5, 1), 3.0), 1.5), 3)
    assert abs(W.smoothed(np.eye(9)[:, :, None], 1.0).sum() - 9) < 1e-9
    assert np.allclose(W.resized(ramp, 5, 3)[0, :, 0], [0.5, 2.5, 4.5])
    assert np.allclose(W.resized(ramp, 5, 3, "nearest")[0, :, 0], [0, 2, 4])
    assert np.allclose(W.resized(ramp[:, :2], 5, 4)[0, :, 0], [0, 0.25, 0.75, 1])


@pytest.mark.parametrize("how", ["nearest", "bilinear", "cubic", "average"])
def test_warp_to_the_same_grid_is_a_copy(spark, blocks, how):
    source = {"left": 0.0, "top": float(H), "xres": 1.0, "yres": 1.0, "height": H, "width": WIDTH}
    targets = spark.createDataFrame([("A", 0, 0, 0, 12, 10), ("A", 1, 12, 10, 9, 9)], "image_id string, window_id long, row long, col long, h long, w long")
    found = arrays(W.warp_to_grid(blocks, targets, source, {k: source[k] for k in ("left", "top", "xres", "yres")}, BLOCK, how))
    assert (found[0] == IMAGE[:12, :10]).all() and (found[1] == IMAGE[12:, 10:]).all()


def test_warp_to_half_the_resolution_averages(spark, blocks):
    source = {"left": 0.0, "top": float(H), "xres": 1.0, "yres": 1.0, "height": H, "width": WIDTH}
    targets = spark.createDataFrame([("A", 0, 2, 1, 5, 4)], "image_id string, window_id long, row long, col long, h long, w long")
    found = arrays(W.warp_to_grid(blocks, targets, source, {"left": 0.0, "top": float(H), "xres": 2.0, "yres": 2.0}, BLOCK, "average"))[0]
    assert (found == np.rint(IMAGE[4:14, 2:10].astype(float).reshape(5, 2, 4, 2, 2).mean(axis=(1, 3)))).all()


def test_stack_finds_a_planted_shift(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(12):
        field = rng.normal(size=(48, 48))
        rows.append((field[8:40, 8:40].ravel().tolist(), field[5:37, 10:42].ravel().tolist()))
    surface = W.stacked_surface(spark.createDataFrame(rows, "ref array<double>, mov array<double>").repartition(3), 32, 32)
    found = refined_peak(surface, "value", 8).first().asDict()
    assert round(found["dy"]) == -3 and round(found["dx"]) == 2 and found["n"] == 12 and found["snr"] > 5
    none = W.stacked_surface(spark.createDataFrame([], "ref array<double>, mov array<double>"), 32, 32)
    assert none.count() == 0 and refined_peak(none, "value", 8).count() == 0


def test_scores_come_by_key(spark):
    found = W.score_tiles(spark.range(10).withColumnRenamed("id", "k"), "k", lambda: lambda b: b["k"] * 2.0, batch_size=3).collect()
    assert {r["k"]: r["score"] for r in found} == {k: 2.0 * k for k in range(10)}


@pytest.mark.parametrize("how", ["bilinear", "average", "cubic"])
def test_means_midway_are_rounded_as_in_sql(spark, tmp_path, how):
    """Tiles of few values have such means, and one of check_l did: its pixel 1 was 157, in SQL 156."""
    rng = np.random.default_rng(8)
    dn = np.where(np.arange(2000)[:, None] % 2, rng.integers(0, 3, (2000, 64)), rng.integers(100, 104, (2000, 64)))
    dn[0] = KNOWN
    rows = pd.DataFrame({"vec_id": np.arange(2000), "embedding": list(((dn - 128) / 400).astype(np.float32)), "label": np.arange(2000, dtype=np.int32) % 7})
    rows.to_parquet(f"{tmp_path}/embeddings.parquet")
    name = f"r3_warp_{how}"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = {(t, i): v for t, i, v in duck.execute(f"SELECT tile, i, v FROM ({catalogue.oracle_sql()[name]})").fetchall()}
    got = {(r.tile, r.i): r.v for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert got == want and (how != "bilinear" or got[0, 1] == 156)
