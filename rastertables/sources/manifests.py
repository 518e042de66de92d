"""Manifests, indexes, splits, histories and artefacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tiling import preview_name, with_index

# The columns of a patch manifest, in order, and their types.
STRINGS = "source_image reader_backend patch_path context_path context_base_path context_cache_path local_storage patch_name dtype pad_mode".split()
DOUBLES = ["context_scale", "pad_value", "invalid_fraction"]
FIELDS = (
    "source_image reader_backend patch_path context_path context_base_path context_cache_path local_storage context_output_size context_scale "
    "patch_name row col top left patch_size stride valid_height valid_width pad_bottom pad_right image_height image_width channels dtype "
    "pad_mode pad_value context_size context_top context_left context_valid_height context_valid_width context_pad_top context_pad_bottom "
    "context_pad_left context_pad_right invalid_fraction"
).split()
SEG_INTS = ["col", "row", "size"]


def _text(df: DataFrame, name: str) -> Column:
    """A column's trimmed text; null if it is empty or missing."""
    return F.nullif(F.trim(F.col(name)), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _resolved(path: Column, root: str) -> Column:
    return F.when(path.rlike("^(/|[a-zA-Z][a-zA-Z0-9+.-]*:)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", False).csv(path)


def read_patch_index(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """The typed FIELDS of a patch index, with the fall-backs of older indexes;
    relative paths are taken from ``root`` (the index's own folder)."""
    raw = _csv(spark, path)
    root = path.rsplit("/", 1)[0] if root is None else root
    text = {n: _text(raw, n) for n in FIELDS}
    for n in ("source_image", "patch_path", "context_base_path"):
        text[n] = _resolved(text[n], root)
    text["context_cache_path"] = text["context_path"] = _resolved(F.coalesce(text["context_cache_path"], text["context_path"]), root)
    text["context_output_size"] = F.coalesce(text["context_output_size"], text["context_size"], F.lit("0"))
    ratio = text["context_size"].cast("double") / F.greatest(text["context_output_size"].cast("double"), F.lit(1.0))
    scale = F.coalesce(text["context_scale"].cast("double"), F.greatest(ratio, F.lit(1.0)))
    text["local_storage"] = F.coalesce(text["local_storage"], F.lit("patch_file"))
    text["pad_value"] = F.coalesce(text["pad_value"], F.lit("0"))
    text["invalid_fraction"] = F.coalesce(text["invalid_fraction"], _text(raw, "black_fraction"), F.lit("0"))
    typed = lambda n: text[n] if n in STRINGS else text[n].cast("double") if n in DOUBLES else text[n].cast("double").cast("int")
    return raw.select(*[(scale if n == "context_scale" else typed(n)).alias(n) for n in FIELDS])


def read_crop_index(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """crop_path (resolved), observation_id and a 0-based index in the order of
    the path and place of a crop, which is kept in the rows themselves."""
    raw = _csv(spark, path)
    root = path.rsplit("/", 1)[0] if root is None else root
    rows = raw.select(_resolved(_text(raw, "crop_path"), root).alias("crop_path"), "observation_id")
    return with_index(rows, "crop_path")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(observation_id, split) of ``write_splits``, or of a JSON document of
    lists by split."""
    try:
        return spark.read.schema("observation_id string, split string").parquet(f"{path}/ids")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    raw = spark.read.option("multiLine", True).json(path)
    pairs = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"`{s}`").cast("array<string>").alias("ids")) for s in raw.columns if raw.schema[s].dataType.typeName() == "array"])
    return raw.select(F.explode(pairs).alias("p")).select(F.explode("p.ids").alias("observation_id"), F.col("p.split").alias("split"))


def write_splits(splits: DataFrame, path: str) -> None:
    """A row for each (observation_id, split), in a folder for each split."""
    splits.select("observation_id", "split").distinct().write.mode("overwrite").partitionBy("split").parquet(f"{path}/ids")


def export_splits(splits: DataFrame, path: str, most: int = 100_000) -> None:
    """One JSON document of the sorted ids of every split, for at most ``most`` ids."""
    ids = splits.select("observation_id", "split").distinct()
    if ids.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} ids: read the rows of write_splits instead")
    lists = ids.groupBy("split").agg(F.array_sort(F.collect_set("observation_id")).alias("ids"))
    row = lists.agg(F.map_from_entries(F.collect_list(F.struct("split", "ids"))).alias("m"))
    row.select(F.to_json("m").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_seg_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = _csv(spark, path)
    ints = [_text(raw, n).cast("int").alias(n) for n in SEG_INTS]
    shares = [_text(raw, n).cast("double").alias(n) for n in ("valid_frac", "label_frac")]
    return raw.select(*ints, F.coalesce(_text(raw, "split"), F.lit("train")).alias("split"), *shares)


def target_grid(rasters: DataFrame) -> DataFrame:
    """Size, affine, resolution and bounds of rasters (width, height, a..f)."""
    return rasters.select(
        "width", "height", "a", "b", "c", "d", "e", "f", F.col("a").alias("res_x"), (-F.col("e")).alias("res_y"), F.col("c").alias("left"), F.col("f").alias("top"),
        (F.col("c") + F.col("a") * F.col("width")).alias("right"), (F.col("f") + F.col("e") * F.col("height")).alias("bottom"),
    )


def write_tiles(tiles: DataFrame, path: str, overwrite: bool = False) -> None:
    """Tiles as Parquet, a folder for each image.  Without ``overwrite`` the rows
    are appended: J7 chooses those that are not there yet.  Small images share a task,
    and a large one has as many tasks as the session's advisory partition size gives it."""
    tiles.hint("rebalance", "image_id").write.mode("overwrite" if overwrite else "append").partitionBy("image_id").parquet(path)


#: Manifest rows repeat most of their text, so they are written compressed; a compressed file is read in one task, so it is bounded.
PACKED = {"header": True, "compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 500_000}


def write_manifest_index(manifest: DataFrame, path: str) -> None:
    """The FIELDS of a manifest as compressed CSV, which is the global index; its rows name
    their image, so an image's manifest is a filter on ``source_image``."""
    manifest.select(*FIELDS).write.mode("append").options(**PACKED).csv(path)


# The columns of a preview manifest, in order.
PREVIEW = (
    "source_image reader_backend preview_path patch_path context_path context_base_path context_cache_path example_index row col top left valid_height valid_width "
    "pad_bottom pad_right image_height image_width channels dtype pad_mode invalid_fraction"
).split()


def write_image_manifests(manifest: DataFrame, path: str) -> None:
    """The FIELDS of a manifest as compressed CSV in a folder for each image; a large image has several
    files."""
    folder = F.regexp_replace(F.element_at(F.split("source_image", "/"), -1), r"\.[^.]*$", "").alias("image")
    manifest.select(*FIELDS, folder).hint("rebalance", "image").write.mode("append").partitionBy("image").options(**PACKED).csv(path)


def preview_manifest(manifest: DataFrame, picks: DataFrame, root: str = "previews") -> DataFrame:
    """The PREVIEW columns of the picked tiles of a manifest (picks: source_image,
    row, col, example_index).  There may be some of every image, so they are never broadcast."""
    rows = manifest.join(picks.hint("merge"), ["source_image", "row", "col"])
    stem = F.regexp_replace(F.element_at(F.split("source_image", "/"), -1), r"\.[^.]*$", "")
    name = preview_name(stem, F.col("example_index"), F.col("row"), F.col("col"), F.col("top"), F.col("left"))
    return rows.withColumn("preview_path", F.concat(F.lit(root.rstrip("/") + "/"), name)).select(*PREVIEW)


def save_artifact(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise


def write_history(history: DataFrame, path: str) -> bool:
    """Epoch rows as CSV; nothing is written without rows."""
    if history.isEmpty():
        return False
    history.write.mode("overwrite").option("header", True).csv(path)
    return True


def build_manifest(tiles: DataFrame, patch: int, stride: int, context: int, context_output: int, pad_mode: str = "constant", pad_value: float = 0.0) -> DataFrame:
    """The FIELDS of tiles: a padded grid with its context windows (the columns
    of ``tiling.context_window``), plus source_image, reader_backend, channels,
    dtype, patch_path, context_base_path, context_cache_path, patch_name and
    invalid_fraction; a path that was not written is the empty string."""
    made = {
        "context_path": F.col("context_cache_path"), "local_storage": F.lit("patch_file"), "context_output_size": F.lit(context_output),
        "context_scale": F.lit(max(1, -(-context // context_output))), "patch_size": F.lit(patch), "stride": F.lit(stride),
        "valid_height": F.col("valid_h"), "valid_width": F.col("valid_w"), "pad_bottom": F.col("pad_h"), "pad_right": F.col("pad_w"),
        "image_height": F.col("height"), "image_width": F.col("width"), "pad_mode": F.lit(pad_mode), "pad_value": F.lit(float(pad_value)), "context_size": F.lit(context),
        "context_top": F.col("req_y"), "context_left": F.col("req_x"), "context_valid_height": F.col("valid_y"), "context_valid_width": F.col("valid_x"),
        "context_pad_top": F.col("before_y"), "context_pad_bottom": F.col("after_y"), "context_pad_left": F.col("before_x"), "context_pad_right": F.col("after_x"),
    }
    kind = lambda n: "string" if n in STRINGS else "double" if n in DOUBLES else "int"
    value = lambda n: F.coalesce(made.get(n, F.col(n)).cast("string"), F.lit("")) if n in STRINGS else made.get(n, F.col(n))
    return tiles.select(*[value(n).cast(kind(n)).alias(n) for n in FIELDS])


def resolve_backend(patches: DataFrame, existing: DataFrame, setting: str = "auto") -> DataFrame:
    """Where each patch's context comes from: its own cache if that exists, else
    the shared base, else the raw image; a ``setting`` other than auto wins."""
    if setting != "auto":
        return patches.withColumn("backend", F.lit(setting))
    paths = existing.select("path").distinct()
    out = patches.join(paths.select(F.col("path").alias("__cache")), F.col("context_cache_path") == F.col("__cache"), "left")
    out = out.join(paths.select(F.col("path").alias("__base")), F.col("context_base_path") == F.col("__base"), "left")
    backend = F.when(F.col("__cache").isNotNull(), "offline_paired_context").when(F.col("__base").isNotNull(), "offline_shared_context").otherwise("online_jp2")
    return out.withColumn("backend", backend).drop("__cache", "__base")
