"""An image with most of the rows is spread over tasks, and order inside images is kept."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertables.operators import tiling
from rastertables.sources import manifests


@pytest.fixture
def small_parts(spark):
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_of(spark, n=3000):
    return spark.range(n, numPartitions=16).select(
        F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 7)).alias("image_id"), ((F.col("id") * 7919) % 60).cast("int").alias("row"), F.floor(F.col("id") / 60).cast("int").alias("col"), F.sha2(F.col("id").cast("string"), 512).alias("pixels")
    )


def test_a_large_image_is_many_files(spark, tmp_path, small_parts):
    tiles = rows_of(spark)
    manifests.write_tiles(tiles, f"{tmp_path}/tiles")
    assert len(glob.glob(f"{tmp_path}/tiles/image_id=hot/*.parquet")) >= 4
    assert spark.read.parquet(f"{tmp_path}/tiles").select(*tiles.columns).exceptAll(tiles).count() == 0


def test_scan_order_of_a_large_image(spark, small_parts):
    ordered = tiling.scan_order(rows_of(spark))
    at = ordered.withColumn("p", F.spark_partition_id())
    assert at.filter("image_id = 'hot'").select("p").distinct().count() >= 3
    got = [(r.image_id, r.row, r.col) for r in ordered.collect()]
    assert got == sorted(got) and tiling.follows_scan_order(ordered).first().out_of_order == 0


@pytest.mark.parametrize("k", [-1, 0, 1, 2, 7, 100, 5000])
def test_even_subsample_of_a_large_image(spark, small_parts, k):
    rows = rows_of(spark).withColumn("key", F.col("row") * 100 + F.col("col"))
    got = {}
    for r in tiling.even_subsample(rows, "image_id", ["row", "col"], k).collect():
        got.setdefault(r.image_id, []).append(r.key)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.image_id, []).append(r.key)
    want = {}
    for image, keys in groups.items():
        keys, n = sorted(keys), len(keys)
        at = range(n) if k < 0 or n <= k and k > 1 else [] if k == 0 else [n // 2] if k == 1 else sorted({int(np.rint(j * (n - 1) / (k - 1))) for j in range(k)})
        if at:
            want[image] = [keys[i] for i in at]
    assert {i: sorted(x) for i, x in got.items()} == want


def test_what_grows_with_images_is_not_broadcast(spark):
    rows = rows_of(spark).withColumn("image_id", F.concat("image_id", F.col("row").cast("string")))
    picked = tiling.even_subsample(rows, "image_id", ["row", "col"], 3)
    kind = {c: F.lit("").alias(c) for c in manifests.PREVIEW}
    manifest = rows.select(F.col("image_id").alias("source_image"), "row", "col", *[v for c, v in kind.items() if c not in ("source_image", "row", "col", "example_index", "preview_path", "top", "left")], F.lit(0).alias("top"), F.lit(0).alias("left"))
    picks = picked.select(F.col("image_id").alias("source_image"), "row", "col", F.lit(1).alias("example_index"))
    for df, n in ((picked, 420), (manifests.preview_manifest(manifest, picks), None)):
        got = df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert (n is None or len(got) <= n) and got and final.count("BroadcastExchange") <= 1  # groups that ranges cut


def test_pairs_of_a_crowded_place_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(tiling, "TOGETHER", 50)
    n = 300
    side = lambda p: spark.range(n, numPartitions=1).select(F.col("id").alias(p + "id"), *[F.when(F.col("id") < 280, F.lit(v)).otherwise(F.col("id") * 3 + v).cast("double").alias(p + c) for c, v in (("y0", 0), ("y1", 9), ("x0", 0), ("x1", 12))])
    found = tiling.tiles_for_blocks(side("b_"), side("t_"), 4).withColumn("p", F.spark_partition_id())
    got = found.select("b_id", "t_id", "b_y0", "t_x1", "p").collect()
    first = lambda i: 0 if i < 280 else 3 * i
    want = {(i, j) for i in range(n) for j in range(n) if abs(first(i) - first(j)) < 9}
    assert len(got) == len(want) and {r[:2] for r in got} == want and all(r.b_y0 == first(r.b_id) and r.t_x1 == first(r.t_id) + 12 for r in got)
    assert len({r.p for r in got}) >= 3


def test_pairs_are_made_block_by_block(spark):
    """A compiled stage keeps all rows of one row of its input: two lists of 4096 rows would be 16 million pairs."""
    side = lambda p: spark.range(40, numPartitions=1).select(F.col("id").alias(p + "id"), *[F.lit(v).cast("double").alias(p + c) for c, v in (("y0", 0), ("y1", 9), ("x0", 0), ("x1", 12))])
    found = tiling.tiles_for_blocks(side("b_"), side("t_"), 4)
    assert len(found.collect()) == 1600
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    made = {n: [x.strip(" :+-") for x in plan if "Generate" in x and f"{n}_rows" in x.split("[")[0]] for n in "bt"}
    assert [len(x) for x in made.values()] == [1, 1] and made["t"][0].startswith("*(") and made["b"][0].startswith("Generate")


def test_a_task_sorts_a_bounded_number_of_records(spark, monkeypatch):
    monkeypatch.setattr(tiling, "SORTED", 250)
    ordered = tiling.scan_order(rows_of(spark))
    assert ordered.rdd.getNumPartitions() == 12 and [r[:3] for r in ordered.collect()] == sorted(r[:3] for r in rows_of(spark).collect())
