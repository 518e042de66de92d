import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertables.operators.tiling import with_index
from rastertables.sources import manifests as M
from rastertables.sources import rasters as R


def test_rasters_become_blocks_or_errors(spark, tmp_path):
    image = np.arange(20 * 30, dtype=np.uint16).reshape(20, 30)
    np.save(tmp_path / "Scene_B.npy", image)
    (tmp_path / "scene_a.tif").write_bytes(b"no raster")
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "deep" / "scene_c.npy", image)
    names = lambda df: [r["path"].rsplit("/", 1)[-1] for r in df.collect()]
    assert names(R.discover_rasters(spark, str(tmp_path))) == ["Scene_B.npy", "scene_a.tif"]
    assert names(R.discover_rasters(spark, str(tmp_path), "SCENE_[bc]*", recursive=True)) == ["Scene_B.npy", "scene_c.npy"]
    blocks = R.read_blocks(spark, str(tmp_path), block=16)
    rows = blocks.collect()
    assert [r["image_id"] for r in rows if r["error"]] == ["scene_a"]
    whole = np.zeros_like(image)
    for r in rows:
        if not r["error"]:
            whole[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r["pixels"], r["dtype"]).reshape(r["h"], r["w"])
    assert (whole == image).all()
    (sizes,) = R.raster_inventory(blocks, 16, 3).collect()
    assert (sizes["height"], sizes["width"], sizes["total"], sizes["analysed"], sizes["dtype"]) == (20, 30, 4, 3, "uint16")


def test_a_registered_decoder_is_tried_in_turn(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "_DECODERS", list(R._DECODERS))
    R.register_decoder("vrt", lambda raw: 1 / 0)
    R.register_decoder("vrt", lambda raw: np.frombuffer(raw, np.uint8).reshape(1, -1))
    (tmp_path / "a.vrt").write_bytes(b"abc")
    (row,) = R.read_blocks(spark, str(tmp_path)).collect()
    assert row["pixels"] == b"abc" and row["error"] is None


def test_channels_move_last():
    assert R.channels_last(np.zeros((3, 20, 30))).shape == (20, 30, 3)
    assert R.channels_last(np.zeros((20, 30))).shape == (20, 30, 1)


def test_patch_index_falls_back_to_older_columns(spark, tmp_path):
    (tmp_path / "index.csv").write_text(
        "source_image,patch_path,context_path,context_size,row,black_fraction,reader_backend\nimg.jp2,/abs/p.npy,c.npy,1024,3,0.25,x\nimg.jp2,,,512,4,,x\n"
    )
    a, b = M.read_patch_index(spark, f"{tmp_path}/index.csv").orderBy("row").collect()
    assert list(a.asDict()) == M.FIELDS
    assert a["source_image"] == f"{tmp_path}/img.jp2" and a["patch_path"] == "/abs/p.npy" and a["context_cache_path"] == f"{tmp_path}/c.npy"
    assert (a["context_output_size"], a["context_scale"], a["invalid_fraction"], a["local_storage"], a["row"]) == (1024, 1.0, 0.25, "patch_file", 3)
    assert b["patch_path"] is None and b["context_path"] is None and (b["invalid_fraction"], b["pad_value"]) == (0.0, 0.0)


def test_crop_index_counts_across_partitions(spark, tmp_path):
    (tmp_path / "crops.csv").write_text("crop_path,observation_id\n" + "".join(f"c{i:03d}.npy,O{i % 3}\n" for i in range(100)))
    rows = M.read_crop_index(spark, f"{tmp_path}/crops.csv").collect()
    assert {r["crop_path"][-8:]: r["index"] for r in rows} == {f"c{i:03d}.npy": i for i in range(100)}


def test_splits_round_trip(spark, tmp_path):
    rows = [("A", "train"), ("B", "train"), ("C", "val")]
    splits = spark.createDataFrame([*rows, ("A", "train")], "observation_id string, split string")
    M.write_splits(splits, f"{tmp_path}/splits")
    M.export_splits(splits, f"{tmp_path}/document")
    for name in ("splits", "document"):
        assert sorted(map(tuple, M.read_splits(spark, f"{tmp_path}/{name}").collect())) == rows
    with pytest.raises(ValueError):
        M.export_splits(splits, f"{tmp_path}/other", 2)


def test_a_document_of_splits_may_have_other_fields(spark, tmp_path):
    (tmp_path / "splits.json").write_text('{"train": ["A", "B"], "val": ["C"], "seed": 42, "val_fraction": 0.1}')
    got = sorted(map(tuple, M.read_splits(spark, f"{tmp_path}/splits.json").collect()))
    assert got == [("A", "train"), ("B", "train"), ("C", "val")]


def test_index_ranks_ties_once(spark):
    rows = spark.createDataFrame([("a", i % 3) for i in range(50)] + [("b", 0)], "k string, v int").repartition(7)
    got = with_index(rows, "k").collect()
    assert sorted(r["index"] for r in got) == list(range(51)) and [r["index"] for r in got if r["k"] == "b"] == [50]


def test_region_is_cut_from_its_blocks(spark, tmp_path):
    image = np.arange(3 * 20 * 30, dtype=np.uint16).reshape(3, 20, 30)
    np.save(tmp_path / "a.npy", image)
    blocks = R.read_blocks(spark, str(tmp_path), block=7)
    (row,) = R.read_region(blocks, 5, 11, 9, 40).collect()
    part = np.frombuffer(row["pixels"], row["dtype"]).reshape(row["h"], row["w"], row["channels"])
    assert (row["y0"], row["x0"]) == (5, 11) and (part == np.moveaxis(image, 0, -1)[5:14, 11:30]).all()
    assert R.read_region(blocks, 100, 0, 5, 5).count() == 0


def test_seg_manifest_defaults_to_train(spark, tmp_path):
    (tmp_path / "m.csv").write_text("col,row,size\n1,2,3\n")
    (row,) = M.read_seg_manifest(spark, f"{tmp_path}/m.csv").collect()
    assert (row["col"], row["row"], row["size"], row["split"]) == (1, 2, 3, "train")


def test_artefacts_and_histories(spark, tmp_path):
    df = spark.range(3)
    M.save_artifact(df, f"{tmp_path}/a")
    assert M.load_artifact(spark, f"{tmp_path}/a", "id long").count() == 3
    with pytest.raises(FileNotFoundError):
        M.load_artifact(spark, f"{tmp_path}/none", "id long")
    assert M.write_history(df, f"{tmp_path}/h") and not M.write_history(df.limit(0), f"{tmp_path}/h0")
    assert spark.read.option("header", True).csv(f"{tmp_path}/h").columns == ["id"]


def test_backend_prefers_the_cache(spark):
    rows = spark.createDataFrame([(1, "c1", "b1"), (2, "c2", "b1"), (3, None, None)], "k int, context_cache_path string, context_base_path string")
    existing = spark.createDataFrame([("c1",), ("b1",), ("b1",)], "path string")
    found = {r["k"]: r["backend"] for r in M.resolve_backend(rows, existing).collect()}
    assert found == {1: "offline_paired_context", 2: "offline_shared_context", 3: "online_jp2"}
    assert {r["backend"] for r in M.resolve_backend(rows, existing, "online_jp2").collect()} == {"online_jp2"}


def test_only_the_bytes_of_a_region_are_read(spark, tmp_path):
    """The file ends after its first rows: what is read must lie before."""
    image = np.arange(4000 * 300, dtype=np.uint16).reshape(4000, 300)
    np.save(tmp_path / "a.npy", image)
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "a.npy").write_bytes(whole[: 128 + 2 * 300 * 400])
    headers = R.raster_headers(spark, str(tmp_path))
    assert headers.first()["length"] == 128 + 2 * 300 * 400
    region = (100, 50, 250, 120)
    planned = R.planned_reads(headers, 64, region)
    assert planned.agg({"bytes": "sum"}).first()[0] == 2 * 250 * 120 and planned.count() == 5
    (row,) = R.read_region(R.read_blocks(spark, str(tmp_path), block=64, region=region), *region).collect()
    assert (np.frombuffer(row["pixels"], np.uint16).reshape(250, 120) == image[100:350, 50:170]).all()
    (sizes,) = R.file_inventory(spark, str(tmp_path), 1000, 3).collect()
    assert (sizes["height"], sizes["width"], sizes["channels"], sizes["dtype"], sizes["total"], sizes["analysed"]) == (4000, 300, 1, "uint16", 4, 3)
    errors = R.read_blocks(spark, str(tmp_path), block=1000).filter("error IS NOT NULL").collect()
    assert len(errors) == 4 and "ends too early" in errors[0]["error"]


def test_a_file_is_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "TASK_BYTES", 10_000)
    monkeypatch.setattr(R, "READ_BYTES", 4_000)
    image = np.random.default_rng(0).integers(0, 255, (300, 500)).astype(np.uint8)
    np.save(tmp_path / "a.npy", image)
    blocks = R.read_blocks(spark, str(tmp_path), block=50)
    assert blocks.rdd.getNumPartitions() >= 15
    got = np.zeros_like(image)
    for r in blocks.collect():
        assert r["y0"] % 50 == 0 and r["x0"] % 50 == 0 and r["error"] is None
        got[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r["pixels"], np.uint8).reshape(r["h"], r["w"])
    assert (got == image).all()


@pytest.mark.parametrize("image", [
    np.arange(3 * 40 * 50, dtype=">i4").reshape(3, 40, 50), np.arange(40 * 50 * 2, dtype=np.float32).reshape(40, 50, 2), np.asfortranarray(np.arange(40 * 50).reshape(40, 50)),
], ids=["channels first, big endian", "channels last", "columns first"])
def test_layouts_of_files(spark, tmp_path, image):
    np.save(tmp_path / "a.npy", image)
    want = R.channels_last(image)
    got = np.zeros(want.shape, want.dtype.newbyteorder("="))
    for r in R.read_blocks(spark, str(tmp_path), block=16, region=(5, 7, 100, 30)).collect():
        got[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r["pixels"], r["dtype"]).reshape(r["h"], r["w"], r["channels"])
    outside = got.copy()
    outside[5:, 7:37] = 0
    assert (got[5:, 7:37] == want[5:, 7:37]).all() and not outside.any()


def test_broken_headers_and_decoders_in_an_inventory(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "_DECODERS", list(R._DECODERS))
    R.register_decoder("vrt", lambda raw: np.frombuffer(raw, np.uint8).reshape(2, -1))
    (tmp_path / "a.vrt").write_bytes(b"abcdef")
    (tmp_path / "b.npy").write_bytes(b"\x93NUMPY")
    np.save(tmp_path / "c.npy", np.zeros((5, 4, 3), np.uint8))
    found = {r["image_id"]: (r["height"], r["width"], r["channels"]) for r in R.file_inventory(spark, str(tmp_path), 2, 9).collect()}
    assert found == {"a": (2, 3, 1), "c": (5, 4, 3)}
    errors = [r["image_id"] for r in R.read_blocks(spark, str(tmp_path)).collect() if r["error"]]
    assert errors == ["b"]


def test_the_data_source_prunes_ranges(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(R.NpyBlocks)
    image = np.arange(4000 * 300, dtype=np.uint16).reshape(4000, 300)
    np.save(tmp_path / "a.npy", image)
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "a.npy").write_bytes(whole[: 128 + 2 * 300 * 400])
    blocks = spark.read.format("npy_blocks").option("block", 100).option("task_bytes", 40_000).load(str(tmp_path))
    rows = blocks.filter("y0 < 400 AND x0 >= 100").collect()
    assert len(rows) == 8 and not any(r["error"] for r in rows)
    assert all((np.frombuffer(r["pixels"], np.uint16).reshape(100, 100) == image[r["y0"] : r["y0"] + 100, r["x0"] : r["x0"] + 100]).all() for r in rows)
    assert blocks.filter("image_id = 'b'").count() == 0


def test_manifests_are_written_compressed(spark, tmp_path):
    import glob
    import os

    kind = {n: F.lit("/data/i1.npy") if n in M.STRINGS else F.lit(7.0) if n in M.DOUBLES else F.lit(7) for n in M.FIELDS}
    rows = spark.range(5000, numPartitions=1).select(*[v.alias(n) for n, v in (kind | {"row": F.col("id").cast("int")}).items()])
    M.write_manifest_index(rows, f"{tmp_path}/index")
    M.write_image_manifests(rows, f"{tmp_path}/images")
    for top, found in (("index", M.read_patch_index(spark, f"{tmp_path}/index")), ("images", M.read_patch_index(spark, f"{tmp_path}/images/image=i1"))):
        size = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/{top}/**/part-*", recursive=True))
        assert size < 250_000 and found.select(*M.FIELDS).exceptAll(rows).count() == 0 and found.count() == 5000  # plain text is 1 MB
