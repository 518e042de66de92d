"""All queries over the driver's tables, with their SQL.

``VIEWS`` derives image catalogues, pixels, labels, logits and manifests from
the tables, once for Spark and once for DuckDB where the dialects differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import labels as L
from .operators import metrics as M
from .operators import mosaics as B
from .operators import quality as Q
from .operators import registration as R
from .operators import splits as S
from .operators import tiling as T
from .operators import windows as W
from .operators.features import (
    class_embedding, class_moments, fit_class_gaussians, fit_class_pca, linear_logits, mahalanobis_score, pooled_features, project_components,
)
from .operators.exchange import mapped
from .sources import manifests
from .sources import rasters
from .sources.shared import scratch, stored
from .streaming import ingest

#: name -> (table, Spark SQL, DuckDB SQL or None if the same)
VIEWS = {
    "catalog": ("orders", """SELECT concat('IMG_', o_orderkey) AS image_id, concat('OBS_', o_custkey) AS observation_id, 100 + o_orderkey % 157 AS height, 90 + o_custkey % 211 AS width,
        CAST(CASE o_orderkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 0 END AS DOUBLE) AS xres FROM orders""", None),
    "pixels": ("embeddings", """SELECT vec_id AS tile, CAST(floor(vec_id / 10) AS BIGINT) AS crop, CAST(label AS BIGINT) AS label, CAST(floor(pos / 8) AS BIGINT) AS y, CAST(pos % 8 AS BIGINT) AS x,
        CAST(greatest(0, least(255, rint(CAST(v AS DOUBLE) * 400 + 128))) AS BIGINT) AS dn FROM (SELECT vec_id, label, posexplode(embedding) AS (pos, v) FROM embeddings)""",
        """SELECT vec_id AS tile, CAST(floor(vec_id / 10) AS BIGINT) AS crop, CAST(label AS BIGINT) AS label, CAST(floor(pos / 8) AS BIGINT) AS y, CAST(pos % 8 AS BIGINT) AS x,
        CAST(greatest(0, least(255, round_even(CAST(v AS DOUBLE) * 400 + 128, 0))) AS BIGINT) AS dn FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)"""),
    "logits": ("embeddings", """SELECT vec_id, CAST(floor(vec_id / 10) AS BIGINT) AS batch, CASE WHEN vec_id % 7 = 0 THEN 255 ELSE CAST(label AS BIGINT) END AS target,
        transform(embedding, x -> CAST(x AS DOUBLE) * 20) AS logits FROM embeddings""",
        """SELECT vec_id, CAST(floor(vec_id / 10) AS BIGINT) AS batch, CASE WHEN vec_id % 7 = 0 THEN 255 ELSE CAST(label AS BIGINT) END AS target,
        list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 20) AS logits FROM embeddings"""),
    "blocks": ("embeddings", """SELECT vec_id AS image_id, CAST(floor(vec_id / 10) AS BIGINT) AS crop, CAST(label AS BIGINT) AS label, CAST(0 AS BIGINT) AS y0, CAST(0 AS BIGINT) AS x0, 8 AS h, 8 AS w, 1 AS channels, 'uint8' AS dtype,
        unhex(array_join(transform(embedding, v -> lpad(hex(CAST(greatest(0, least(255, rint(CAST(v AS DOUBLE) * 400 + 128))) AS BIGINT)), 2, '0')), '')) AS pixels FROM embeddings""", None),
    "mosaic_blocks": ("embeddings", """SELECT CAST(floor(vec_id / 64) AS BIGINT) AS image_id, CAST(floor(vec_id % 64 / 8) * 8 AS BIGINT) AS y0, CAST(vec_id % 8 * 8 AS BIGINT) AS x0, 8 AS h, 8 AS w, 1 AS channels, 'uint8' AS dtype, 64 AS image_height, 64 AS image_width,
        unhex(array_join(transform(embedding, v -> lpad(hex(CAST(greatest(0, least(255, rint(CAST(v AS DOUBLE) * 400 + 128))) AS BIGINT)), 2, '0')), '')) AS pixels FROM embeddings""", None),
    "mosaic": ("embeddings", """SELECT CAST(floor(vec_id / 64) AS BIGINT) AS image_id, CAST(floor(vec_id % 64 / 8) * 8 + floor(pos / 8) AS BIGINT) AS y, CAST(vec_id % 8 * 8 + pos % 8 AS BIGINT) AS x,
        CAST(greatest(0, least(255, rint(CAST(v AS DOUBLE) * 400 + 128))) AS BIGINT) AS dn FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM embeddings)""",
        """SELECT CAST(floor(vec_id / 64) AS BIGINT) AS image_id, CAST(floor(vec_id % 64 / 8) * 8 + floor(pos / 8) AS BIGINT) AS y, CAST(vec_id % 8 * 8 + pos % 8 AS BIGINT) AS x,
        CAST(greatest(0, least(255, round_even(CAST(v AS DOUBLE) * 400 + 128, 0))) AS BIGINT) AS dn FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings)"""),
    "rgba_blocks": ("embeddings", """SELECT CAST(floor(vec_id / 16) AS BIGINT) AS image_id, CAST(floor(vec_id % 16 / 4) * 4 AS BIGINT) AS y0, CAST(vec_id % 4 * 4 AS BIGINT) AS x0, 4 AS h, 4 AS w, 4 AS channels, 'uint8' AS dtype,
        unhex(array_join(transform(embedding, (v, i) -> lpad(hex(CASE WHEN i % 4 = 3 THEN CASE WHEN v < -0.1 THEN 0 ELSE 255 END ELSE CAST(greatest(0, least(15, rint(CAST(v AS DOUBLE) * 25 + 8))) * 16 AS BIGINT) END), 2, '0')), '')) AS pixels FROM embeddings""", None),
    "rgba_pixels": ("embeddings", """SELECT CAST(floor(vec_id / 16) AS BIGINT) AS image_id, CAST(floor(vec_id % 16 / 4) * 4 + floor(p / 4) AS BIGINT) AS y, CAST(vec_id % 4 * 4 + p % 4 AS BIGINT) AS x,
        CAST(greatest(0, least(15, round_even(CAST(embedding[p * 4 + 1] AS DOUBLE) * 25 + 8, 0))) * 16 AS BIGINT) AS r, CAST(greatest(0, least(15, round_even(CAST(embedding[p * 4 + 2] AS DOUBLE) * 25 + 8, 0))) * 16 AS BIGINT) AS g,
        CAST(greatest(0, least(15, round_even(CAST(embedding[p * 4 + 3] AS DOUBLE) * 25 + 8, 0))) * 16 AS BIGINT) AS b, CASE WHEN embedding[p * 4 + 4] < -0.1 THEN 0 ELSE 255 END AS a FROM (SELECT vec_id, embedding, unnest(range(16)) AS p FROM embeddings)""", None),
    "legend_rows": ("nation", """SELECT CASE WHEN n_regionkey = 0 THEN 'rect' ELSE ' Square' END AS shape, n_name AS value, concat('#', lpad(hex(CAST((n_nationkey * 651733) % 16777216 AS BIGINT)), 6, '0')) AS color, CAST(n_nationkey AS BIGINT) AS src_pos FROM nation""", None),
    "rgba": ("lineitem", """SELECT l_orderkey AS y, CAST(l_linenumber AS BIGINT) AS x, CAST((l_partkey * 37) % 256 AS BIGINT) AS r, CAST((l_suppkey * 11) % 256 AS BIGINT) AS g, CAST((l_partkey + l_suppkey) % 256 AS BIGINT) AS b,
        CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE 255 END AS a FROM lineitem""", None),
    "crops": ("events", """SELECT event_id AS crop_id, concat('OBS_', user_id) AS observation_id, event_type, value, value / 500 AS invalid_fraction,
        CASE WHEN event_type = 'error' THEN 'error' WHEN value / 500 > 0.25 THEN 'invalid' WHEN event_id % 11 = 0 THEN 'lowvar' ELSE 'kept' END AS decision FROM events""", None),
    "history": ("events", "SELECT user_id AS run, event_id AS epoch, value AS metric, event_id % 17 + 1 AS batch_size FROM events", None),
    "boxes": ("supplier", """SELECT s_suppkey AS box_id, (s_suppkey % 360 - 180) / 10.0D AS lon0, (s_suppkey % 360 - 170) / 10.0D AS lon1, (s_suppkey % 120 - 60) / 10.0D AS lat0, (s_suppkey % 120 - 52) / 10.0D AS lat1 FROM supplier""",
        """SELECT s_suppkey AS box_id, (s_suppkey % 360 - 180) / 10.0::DOUBLE AS lon0, (s_suppkey % 360 - 170) / 10.0::DOUBLE AS lon1, (s_suppkey % 120 - 60) / 10.0::DOUBLE AS lat0, (s_suppkey % 120 - 52) / 10.0::DOUBLE AS lat1 FROM supplier"""),
    "tiles": ("customer", """SELECT concat('T', c_custkey) AS tile, CAST(c_custkey % 40 * 16 AS DOUBLE) AS `left`, CAST(c_custkey % 40 * 16 + 20 AS DOUBLE) AS `right`, CAST(c_nationkey * 12 AS DOUBLE) AS bottom, CAST(c_nationkey * 12 + 15 AS DOUBLE) AS top, CAST(0.5 AS DOUBLE) AS res FROM customer""",
        """SELECT concat('T', c_custkey) AS tile, CAST(c_custkey % 40 * 16 AS DOUBLE) AS "left", CAST(c_custkey % 40 * 16 + 20 AS DOUBLE) AS "right", CAST(c_nationkey * 12 AS DOUBLE) AS bottom, CAST(c_nationkey * 12 + 15 AS DOUBLE) AS top, CAST(0.5 AS DOUBLE) AS res FROM customer"""),
    "files": ("orders", "SELECT concat('/maps/v', o_orderkey % 12, '/tile_', o_orderkey, '.tif') AS path FROM orders", None),
}

_FOUND: dict[str, tuple[Callable, str | None]] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, text, _ = VIEWS[name]
    return spark.sql(text.replace(f"FROM {table}", "FROM {table}"), table=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def query(sql: str | None = None, *views: str, of: tuple[str, ...] | None = None):
    """Register a query: a function of views (``of``, else ``views``), and the SQL
    over ``views``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) for v in of or views])

        if sql is not None:
            known = ", ".join(f"{v} AS ({VIEWS[v][2] or VIEWS[v][1]})" for v in views)
            text = f"WITH {known} {sql}" if not sql.startswith("WITH ") else f"WITH {known}, {sql[5:]}"
        else:
            text = None
        _FOUND[f.__name__] = (run, text)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _FOUND.items() if s is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FOUND["w1_tile_quality_splits"][0](spark, sf_dir)


STRETCH = """WITH g AS (SELECT tile, CASE WHEN dn IN (0, 255) THEN NULL ELSE CAST(dn AS DOUBLE) END AS v FROM pixels),
q AS (SELECT tile, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99, min(v) AS mn, max(v) AS mx FROM g GROUP BY tile),
l AS (SELECT tile AS t, CASE WHEN p99 > p1 THEN p1 ELSE mn END AS lo, CASE WHEN p99 > p1 THEN p99 ELSE mx END AS hi FROM q),
s AS (SELECT pixels.*, CASE WHEN hi > lo THEN least(1.0, greatest(0.0, (dn - lo) / (hi - lo))) END AS unit FROM pixels JOIN l ON tile = t)"""


@query(STRETCH + """, f AS (SELECT tile, avg(CASE WHEN dn IN (0, 255) THEN 1.0 ELSE 0.0 END) AS bad FROM pixels GROUP BY tile),
d AS (SELECT s.tile, min(crop) AS crop, stddev_pop(2 * unit - 1) AS std FROM s GROUP BY s.tile),
k AS (SELECT d.*, CASE WHEN bad > 0.05 THEN 'invalid' WHEN std IS NULL OR std < 0.4 THEN 'lowvar' ELSE 'kept' END AS decision FROM d JOIN f ON d.tile = f.tile),
o AS (SELECT crop, row_number() OVER (ORDER BY md5('42:' || crop), crop) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT crop FROM pixels)),
p AS (SELECT crop, CASE WHEN rk <= least(greatest(5, round_even(n * 0.2::DOUBLE, 0)), n) THEN 'val' ELSE 'train' END AS split FROM o)
SELECT split, count(*) AS candidates, count_if(decision = 'kept')::BIGINT AS kept, count_if(decision = 'invalid')::BIGINT AS rejected_invalid, count_if(decision = 'lowvar')::BIGINT AS rejected_lowvar, 0::BIGINT AS errors
FROM k JOIN p ON k.crop = p.crop GROUP BY ROLLUP (split)""", "pixels", of=("blocks",))
def w1_tile_quality_splits(blocks):
    """Quality of tiles from value counts of their blocks: no pixel leaves a task."""
    counts = stored(Q.value_counts(blocks), "value-counts")
    std = Q.block_std(counts, Q.stretch_limits(counts))
    tiles = blocks.select("image_id", "crop").join(Q.block_invalid_fraction(counts), "image_id").join(std, "image_id")
    decision = F.when(F.col("invalid_fraction") > 0.05, "invalid").when(F.col("std").isNull() | (F.col("std") < 0.4), "lowvar").otherwise("kept")
    splits = S.split_by_group(blocks.select("crop"), "crop", 0.2, 5, "42")
    return Q.qc_summary(S.assign_split(tiles.withColumn("decision", decision), splits, "crop"), "split")


GRID = """(SELECT image_id, height, width, "row", "row" * 64 AS top, col, col * 64 AS "left" FROM (
SELECT *, unnest(range(0, greatest(1, CAST(ceil(width / 64) AS BIGINT)))) AS col FROM (SELECT *, unnest(range(0, greatest(1, CAST(ceil(height / 64) AS BIGINT)))) AS "row" FROM catalog)))"""


@query(f"""SELECT image_id, "row", col, top, "left", least(96, height - top) AS valid_h, least(96, width - "left") AS valid_w, 96 - least(96, height - top) AS pad_h, 96 - least(96, width - "left") AS pad_w FROM {GRID}""", "catalog")
def p1_padded_grid(catalog):
    return T.padded_grid(catalog, 96, 64).select("image_id", "row", "col", "top", "left", "valid_h", "valid_w", "pad_h", "pad_w")


@query("""SELECT image_id, y // 64 AS "row", x // 64 AS col, y, x FROM (SELECT *, unnest(range(0, width - 64 + 1, 64)) AS x FROM (SELECT *, unnest(range(0, height - 64 + 1, 64)) AS y FROM catalog))""", "catalog")
def p2_full_tile_grid(catalog):
    return T.full_tile_grid(catalog, 64).select("image_id", "row", "col", "y", "x")


@query("""SELECT image_id, "row", col, "row" // 4 AS d_row, col // 4 AS d_col, 16::BIGINT AS d_size FROM (SELECT *, unnest(range(0, width - 64 + 1, 48)) AS col FROM (SELECT *, unnest(range(0, height - 64 + 1, 48)) AS "row" FROM catalog))""", "catalog")
def p3_strided_windows(catalog):
    return T.strided_windows(catalog, 64, 48, 4).select("image_id", "row", "col", "d_row", "d_col", "d_size")


@query("""SELECT image_id, 10 + dy AS b_row, 20 + dx AS b_col, least(50, height - dy) AS b_h, least(80, width - dx) AS b_w FROM (SELECT *, unnest(range(0, width, 80)) AS dx FROM (SELECT *, unnest(range(0, height, 50)) AS dy FROM catalog))""", "catalog")
def p4_block_partition(catalog):
    windows = catalog.select("image_id", F.lit(10).cast("long").alias("row"), F.lit(20).cast("long").alias("col"), F.col("height").alias("h"), F.col("width").alias("w"))
    return T.block_partition(windows, 80, 50).select("image_id", "b_row", "b_col", "b_h", "b_w")


@query("SELECT image_id, CAST(ceil(height / 32) * ceil(width / 32) AS BIGINT) AS total, least(40, CAST(ceil(height / 32) * ceil(width / 32) AS BIGINT)) AS analysed FROM catalog", "catalog")
def p5_count_candidates(catalog):
    return T.count_candidates(catalog, 32, 40).select("image_id", "total", "analysed")


@query(f"""SELECT image_id, "row", col, top + 48 - 100 AS req_y, greatest(top - 52, 0) AS read_y, greatest(least(top + 148, height) - greatest(top - 52, 0), 0) AS valid_y, greatest(52 - top, 0) AS before_y, greatest(top + 148 - height, 0) AS after_y,
"left" - 52 AS req_x, greatest("left" - 52, 0) AS read_x, greatest(least("left" + 148, width) - greatest("left" - 52, 0), 0) AS valid_x, greatest(52 - "left", 0) AS before_x, greatest("left" + 148 - width, 0) AS after_x FROM {GRID}""", "catalog")
def p6_context_window(catalog):
    names = [f"{n}_{a}" for a in "yx" for n in ("req", "read", "valid", "before", "after")]
    return T.context_window(T.padded_grid(catalog, 96, 64), 96, 200).select("image_id", "row", "col", *names)


@query(f"""SELECT image_id, printf('%s_r%04d_c%04d_y%07d_x%07d.npy', image_id, "row", col, top, "left") AS name FROM {GRID}""", "catalog")
def p7_tile_names(catalog):
    grid = T.padded_grid(catalog, 96, 64)
    return grid.select("image_id", T.tile_name(*[F.col(c) for c in ("image_id", "row", "col", "top", "left")]).alias("name"))


@query("SELECT crop_id, invalid_fraction FROM crops WHERE invalid_fraction <= 0.1", "crops")
def p9_filter_invalid(crops):
    return Q.filter_invalid(crops, 0.1).select("crop_id", "invalid_fraction")


@query(STRETCH + " SELECT tile, round(stddev_pop(2 * unit - 1), 6) AS std FROM s GROUP BY tile HAVING stddev_pop(2 * unit - 1) >= 0.4", "pixels", of=("blocks",))
def p10_filter_low_variance(blocks):
    counts = Q.value_counts(blocks)
    std = Q.filter_low_variance(Q.block_std(counts, Q.stretch_limits(counts)), 0.4)
    return std.select(F.col("image_id").alias("tile"), F.round("std", 6).alias("std"))


@query("""SELECT image_id, CASE WHEN xres <> 0 AND abs(abs(xres) - 1) > 1e-9 THEN abs(xres) END AS gsd, NOT coalesce(CASE WHEN xres <> 0 AND abs(abs(xres) - 1) > 1e-9 THEN abs(abs(xres) - 0.25) <= 0.05 END, false) AS excluded FROM catalog""", "catalog")
def p11_gsd_policy(catalog):
    return Q.gsd_policy(catalog, 0.25, 0.05).select("image_id", "gsd", "excluded")


COVER = """(SELECT crop, avg(CASE WHEN dn > 60 THEN 1.0::DOUBLE ELSE 0.0 END) AS valid_frac, avg(CASE WHEN label > 4 THEN 1.0::DOUBLE ELSE 0.0 END) AS label_frac FROM pixels GROUP BY crop)"""


@query(f"SELECT crop, round_even(valid_frac, 4) AS valid_frac, round_even(label_frac, 4) AS label_frac FROM {COVER} WHERE valid_frac >= 0.9 AND label_frac >= 0.5", "pixels")
def p12_coverage_filter(pixels):
    shifted = pixels.withColumn("dn", F.col("dn") - 60).withColumn("label", F.col("label") - 4)
    return Q.coverage_filter(L.coverage_fractions(shifted, ["crop"]), 0.9, 0.5)


@query("""SELECT image_id, y // 64 AS "row", x AS col, CASE WHEN x + 32 >= round_even(width * (1 - 0.3::DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, unnest(range(0, width - 64 + 1, 64)) AS x FROM (SELECT *, unnest(range(0, height - 64 + 1, 64)) AS y FROM catalog))""", "catalog")
def p13_spatial_holdout(catalog):
    cells = T.full_tile_grid(catalog, 64).select("image_id", "row", "width", F.col("x").alias("col"))
    return S.spatial_holdout(cells, "width", 64, 0.3).select("image_id", "row", "col", "split")


@query("""SELECT box_id, CAST(floor((lon0 * m + 3000000) / 500) AS BIGINT) AS col, CAST(floor((lat1 * m - 1000000) * -1 / 500) AS BIGINT) AS "row",
CAST(ceil((lon1 * m + 3000000) / 500) - floor((lon0 * m + 3000000) / 500) AS BIGINT) AS w, CAST(ceil((lat0 * m - 1000000) * -1 / 500) - floor((lat1 * m - 1000000) * -1 / 500) AS BIGINT) AS h FROM boxes, (SELECT 3396190.0::DOUBLE * pi() / 180 AS m)""", "boxes")
def p15_snap_aoi(boxes):
    return L.snap_aoi(boxes, 3396190.0, -3000000.0, 1000000.0, 500.0).select("box_id", "col", "row", "w", "h")


@query("""SELECT tile, round(avg(CASE WHEN dn = 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS zero, round(stddev_pop(dn), 6) AS std FROM pixels GROUP BY tile
HAVING avg(CASE WHEN dn = 0 THEN 1.0::DOUBLE ELSE 0.0 END) <= 0.02 AND stddev_pop(dn) >= 45 AND avg(CASE WHEN dn > 200 THEN 1.0::DOUBLE ELSE 0.0 END) >= 0.05""", "pixels", of=("blocks",))
def p16_textured_patches(blocks):
    tiles = blocks.select("image_id", "h", "w", "channels", "dtype", "pixels", F.lit(0).cast("long").alias("window_id"))
    bright = W.map_tiles(tiles, lambda a: (a > 200).astype(a.dtype)).select("image_id", F.col("pixels").alias("edges"))
    found = Q.textured_tiles(tiles.join(bright, "image_id"), "image_id", 0.02, 45.0, 0.05)
    return found.select(F.col("image_id").alias("tile"), F.round("zero", 6).alias("zero"), F.round("std", 6).alias("std"))


SPLIT = """o AS (SELECT observation_id, row_number() OVER (ORDER BY md5('7:' || observation_id), observation_id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT observation_id FROM crops)),
p AS (SELECT observation_id, CASE WHEN rk <= least(greatest(20, round_even(n * 0.1::DOUBLE, 0)), n) THEN 'val' ELSE 'train' END AS split FROM o)"""


@query(f"WITH {SPLIT} SELECT observation_id, split FROM p", "crops")
def w3_split_by_group(crops):
    return S.split_by_group(crops, "observation_id", 0.1, 20, "7")


@query(f"WITH {SPLIT} SELECT crop_id, p.observation_id, split FROM crops JOIN p ON crops.observation_id = p.observation_id", "crops")
def j1_assign_split(crops):
    return S.assign_split(crops.select("crop_id", "observation_id"), S.split_by_group(crops, "observation_id", 0.1, 20, "7"), "observation_id")


FAULTY = f"""{SPLIT}, q AS (SELECT observation_id, split FROM p WHERE length(observation_id) % 5 <> 1 UNION ALL SELECT observation_id, 'val' FROM p WHERE observation_id LIKE '%7' UNION ALL SELECT 'X' || observation_id, split FROM p WHERE observation_id LIKE '%3'),
tr AS (SELECT observation_id FROM q WHERE split = 'train'), va AS (SELECT observation_id FROM q WHERE split = 'val'), ids AS (SELECT DISTINCT observation_id FROM crops)"""


@query(f"""WITH {FAULTY} SELECT (SELECT count(*) FROM (SELECT * FROM tr INTERSECT SELECT * FROM va)) AS n_both, (SELECT count(*) FROM (SELECT * FROM ids EXCEPT (SELECT * FROM tr UNION SELECT * FROM va))) AS n_missing,
(SELECT count(*) FROM ((SELECT * FROM tr UNION SELECT * FROM va) EXCEPT SELECT * FROM ids)) AS n_extra""", "crops")
def u2_split_is_partition(crops):
    """A split with ids in both parts, ids that are missing and ids that are extra."""
    splits = S.split_by_group(crops, "observation_id", 0.1, 20, "7")
    both = splits.filter(F.col("observation_id").endswith("7")).withColumn("split", F.lit("val"))
    extra = splits.filter(F.col("observation_id").endswith("3")).withColumn("observation_id", F.concat(F.lit("X"), "observation_id"))
    return S.split_is_partition(crops, splits.filter(F.length("observation_id") % 5 != 1).unionByName(both).unionByName(extra), "observation_id")


@query(f"WITH {SPLIT}, tr AS (SELECT observation_id FROM p WHERE split = 'train'), va AS (SELECT observation_id FROM p WHERE split = 'val') SELECT (SELECT count(*) FROM (SELECT * FROM tr INTERSECT SELECT * FROM va)) AS n_both, (SELECT count(*) FROM (SELECT DISTINCT observation_id FROM crops)) - (SELECT count(*) FROM p) AS n_missing, 0::BIGINT AS n_extra", "crops")
def u2_split_of_groups(crops):
    return S.split_is_partition(crops, S.split_by_group(crops, "observation_id", 0.1, 20, "7"), "observation_id")


@query("""SELECT crop_id, CASE WHEN rk <= n - round_even(n * 0.2::DOUBLE, 0) - round_even(n * 0.1::DOUBLE, 0) THEN 'train' WHEN rk <= n - round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split
FROM (SELECT crop_id, row_number() OVER (ORDER BY md5('s:' || crop_id), crop_id) AS rk, count(*) OVER () AS n FROM crops)""", "crops")
def w4_split_records(crops):
    return S.split_records(crops.select("crop_id"), "crop_id", 0.2, 0.1, "s")


@query("""SELECT crop_id, batch, slot FROM (SELECT crop_id, (rk - 1) // 64 AS batch, (rk - 1) % 64 AS slot, n // 64 AS nb FROM (SELECT crop_id, row_number() OVER (ORDER BY md5('12:' || crop_id), crop_id) AS rk, count(*) OVER () AS n FROM crops)) WHERE batch < nb AND batch >= 3""", "crops")
def w8_epoch_plan(crops):
    return S.epoch_plan(crops.select("crop_id"), "crop_id", 10, 2, 64, True, 3)


@query("""SELECT observation_id, crop_id FROM (SELECT observation_id, crop_id, i, n, CAST(floor(i * 4 / greatest(n - 1, 1)) AS BIGINT) AS j FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY crop_id) - 1 AS i, count(*) OVER (PARTITION BY observation_id) AS n FROM crops))
WHERE n <= 5 OR i IN (SELECT 0) OR list_contains([round_even(k * (n - 1) / 4.0::DOUBLE, 0) FOR k IN range(5)], i)""", "crops")
def w2_even_subsample(crops):
    return T.even_subsample(crops, "observation_id", ["crop_id"], 5).select("observation_id", "crop_id")


@query("SELECT tile, label, x, y FROM (SELECT *, row_number() OVER (PARTITION BY label, crop ORDER BY md5(concat('k:', label, ':', crop, ':', tile * 64 + y * 8 + x)), tile * 64 + y * 8 + x) AS n FROM pixels) WHERE n <= 5", "pixels")
def w5_sample_pixels_per_class(pixels):
    keyed = pixels.withColumn("key", F.col("tile") * 64 + F.col("y") * 8 + F.col("x"))
    return S.sample_per_group(keyed, ["label", "crop"], "key", 5, "k").select("tile", "label", "x", "y")


@query("""SELECT label, crop, n, "before" FROM (SELECT *, coalesce(CAST(sum(n) OVER (PARTITION BY label ORDER BY crop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "before" FROM (SELECT label, crop, count(*) AS n FROM pixels GROUP BY ALL)) WHERE "before" < 1500""", "pixels")
def w6_cap_class_total(pixels):
    return S.cap_class_total(pixels, "label", "crop", 1500)


@query("SELECT label, crop FROM (SELECT *, count(*) OVER (PARTITION BY label) AS c, row_number() OVER (PARTITION BY label ORDER BY crop) AS n FROM (SELECT DISTINCT label, crop FROM pixels)) WHERE c >= 10 AND n <= 20", "pixels")
def w7_first_n_with_minimum(pixels):
    return S.first_n_with_minimum(pixels.select("label", "crop").distinct(), "label", "crop", 10, 20)


@query("SELECT crop_id, cell, row_number() OVER (PARTITION BY crop_id ORDER BY md5(concat('m:', crop_id, ':', cell)), cell) <= 10 AS masked FROM (SELECT crop_id, unnest(range(16))::INTEGER AS cell FROM crops)", "crops")
def w9_exact_ratio_mask(crops):
    return S.exact_ratio_mask(crops, "crop_id", 4, 4, 0.6, "m")


@query("SELECT crop_id, cell, ('0x' || substr(md5(concat('b:', crop_id, ':', cell)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 AS masked FROM (SELECT crop_id, unnest(range(16))::INTEGER AS cell FROM crops)", "crops")
def f8_random_mask(crops):
    return S.random_mask(crops, "crop_id", 64, 16, 0.5, "b")


@query("""SELECT tile, CASE WHEN ('0x' || substr(md5('f:h:' || tile), 1, 1))::INTEGER < 8 THEN 7 - x ELSE x END AS x, CASE WHEN ('0x' || substr(md5('f:v:' || tile), 1, 1))::INTEGER < 8 THEN 7 - y ELSE y END AS y, dn FROM pixels""", "pixels")
def f7_flip_augment(pixels):
    return S.flip_augment(pixels, "tile", 8, 8, "f").select("tile", "x", "y", "dn")


@query("""SELECT tile, x, y, CASE WHEN label % 2 = 0 THEN -1.0::DOUBLE ELSE dn END AS masked_dn, CASE WHEN label % 2 = 0 THEN 255 - dn ELSE dn END AS mixed_dn FROM pixels""", "pixels")
def f9_apply_mask(pixels):
    mask = F.col("label") % 2 == 0
    return pixels.select("tile", "x", "y", S.apply_mask(F.col("dn"), mask, -1.0).alias("masked_dn"), S.composite(F.col("dn"), 255 - F.col("dn"), mask).alias("mixed_dn"))


@query("""SELECT crop_id, 'write' AS action FROM crops WHERE decision = 'kept' AND crop_id % 3 <> 0 UNION ALL SELECT crop_id, 'delete' FROM crops WHERE decision <> 'kept' AND crop_id % 3 = 0""", "crops")
def j7_resume_plan(crops):
    return S.resume_plan(crops.select("crop_id", (F.col("decision") == "kept").alias("keep")), crops.filter("crop_id % 3 = 0").select("crop_id"), "crop_id", False)


@query("SELECT crop_id, observation_id, NULL::DOUBLE AS value FROM crops UNION ALL SELECT crop_id, NULL, value FROM crops WHERE value > 50", "crops")
def u1_append_manifests(crops):
    return S.append_manifests(crops.select("crop_id", "observation_id"), crops.filter("value > 50").select("crop_id", "value"))


def _place():
    """y, x of the value number ``i`` of an 8 x 8 tile."""
    return F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x")


@query("SELECT path FROM files ORDER BY path LIMIT 500 OFFSET 100", "files")
def t1_batch_slice(files):
    return T.batch_slice(files, 100, 500)


@query("SELECT crop_id FROM crops ORDER BY md5('r:' || crop_id), crop_id LIMIT 100", "crops")
def t2_seeded_sample(crops):
    return T.seeded_sample(crops.select("crop_id"), "crop_id", 100, "r")


@query("SELECT run, epoch, metric FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY metric DESC, epoch) AS n FROM history) WHERE n = 1", "history")
def t4_best_epoch(history):
    return M.best_epoch(history, "run", "epoch", "metric").select("run", "epoch", "metric")


@query("""SELECT label, x, key, score, "rank" FROM (SELECT label, x, tile * 8 + y AS key, dn AS score, row_number() OVER (PARTITION BY label, x ORDER BY dn DESC, tile * 8 + y) AS "rank" FROM pixels) WHERE "rank" <= 6""", "pixels")
def t5_top_k_gallery(pixels):
    return M.top_k_gallery(pixels.select("label", "x", (F.col("tile") * 8 + F.col("y")).alias("key"), F.col("dn").alias("score")), ["label", "x"], "key")


@query("SELECT tile, avg(CASE WHEN dn IN (0, 255) THEN 1.0::DOUBLE ELSE 0.0 END) AS invalid_fraction FROM pixels GROUP BY tile", "pixels", of=("blocks",))
def a1_invalid_fraction(blocks):
    return Q.block_invalid_fraction(Q.value_counts(blocks)).withColumnRenamed("image_id", "tile")


@query("""SELECT observation_id, count(*) AS candidates, count_if(decision = 'kept')::BIGINT AS kept, count_if(decision = 'invalid')::BIGINT AS rejected_invalid, count_if(decision = 'lowvar')::BIGINT AS rejected_lowvar, count_if(decision = 'error')::BIGINT AS errors FROM crops GROUP BY ROLLUP (observation_id)""", "crops")
def a2_qc_summary(crops):
    return Q.qc_summary(crops, "observation_id")


@query("""WITH g AS (SELECT height, CASE WHEN xres <> 0 AND abs(abs(xres) - 1) > 1e-9 THEN abs(xres) END AS gsd FROM catalog)
SELECT CASE WHEN gsd IS NULL THEN 'unknown' ELSE printf('%.3f', gsd) END AS gsd_name, count(*) AS n, count_if(NOT coalesce(abs(gsd - 0.5) <= 0.1, false))::BIGINT AS n_excluded, count_if(height > 200)::BIGINT AS n_errors FROM g GROUP BY 1""", "catalog")
def a3_gsd_distribution(catalog):
    return Q.gsd_distribution(Q.gsd_policy(catalog, 0.5, 0.1), F.when(F.col("height") > 200, "too high"))


@query("SELECT CAST(sum(t) AS BIGINT) AS total, CAST(sum(least(40, t)) AS BIGINT) AS analysed FROM (SELECT CAST(ceil(height / 32) * ceil(width / 32) AS BIGINT) AS t FROM catalog)", "catalog")
def a4_inventory_totals(catalog):
    return T.count_candidates(catalog, 32, 40).agg(F.sum("total").alias("total"), F.sum("analysed").alias("analysed"))


@query("SELECT observation_id, count(*) AS n, NULL::BIGINT AS n_sources FROM crops GROUP BY observation_id UNION ALL SELECT NULL, count(*), count(DISTINCT observation_id) FROM crops", "crops")
def a5_records_per_source(crops):
    return Q.records_per_source(crops, "observation_id")


LEGEND = """leg AS (SELECT row_number() OVER (ORDER BY src_pos) AS class_id, value, color, ('0x' || substr(color, 2, 2))::INTEGER AS r, ('0x' || substr(color, 4, 2))::INTEGER AS g, ('0x' || substr(color, 6, 2))::INTEGER AS b FROM legend_rows WHERE lower(trim(shape)) = 'square' AND trim(value) <> '')"""
DECODED = LEGEND + """, near AS (SELECT c.r, c.g, c.b, arg_min(class_id, d * 1000 + class_id) AS near_id, min(d) AS d FROM (SELECT DISTINCT r, g, b FROM rgba WHERE a > 0) c, (SELECT class_id, r AS pr, g AS pg, b AS pb FROM leg) p, LATERAL (SELECT (c.r - pr) * (c.r - pr) + (c.g - pg) * (c.g - pg) + (c.b - pb) * (c.b - pb) AS d) GROUP BY ALL),
dec AS (SELECT x, y, rgba.r, rgba.g, rgba.b, a, CASE WHEN a = 0 OR d > 1600 THEN 0 ELSE near_id END AS class_id FROM rgba LEFT JOIN near ON rgba.r = near.r AND rgba.g = near.g AND rgba.b = near.b)"""


@query(f"WITH {LEGEND} SELECT class_id, value, color, r, g, b FROM leg", "legend_rows")
def s8_legend(rows):
    return L.legend(rows)


@query(f"WITH {LEGEND} SELECT class_id, r, g, b, 255 AS a FROM leg UNION ALL SELECT 0, 0, 0, 0, 0", "legend_rows")
def s12_colormap(rows):
    return L.colormap(L.legend(rows))


@query("SELECT version, path FROM (SELECT *, regexp_extract(path, '/(v[^/]*)/', 1) AS version FROM files) WHERE version = (SELECT max(regexp_extract(path, '/(v[^/]*)/', 1)) FROM files)", "files")
def s16_latest_version_tiles(files):
    return L.latest_version_tiles(files)


@query("SELECT regexp_extract(path, 'tile_([0-9])', 1) AS version, path FROM files WHERE regexp_extract(path, '/(v[^/]*)/', 1) = (SELECT max(regexp_extract(path, '/(v[^/]*)/', 1)) FROM files)", "files")
def s16_version_of_names(files):
    return L.latest_version_tiles(files, tag="tile_([0-9])")


@query(f"WITH {DECODED} SELECT x, y, class_id FROM dec", "rgba", "legend_rows")
def j3_decode_colours(rgba, rows):
    return L.decode_colours(rgba, L.legend(rows)).select("x", "y", "class_id")


@query(f"WITH {DECODED}, h AS (SELECT class_id AS c, count(*) AS k FROM dec GROUP BY 1) SELECT class_id, coalesce(k, 0) AS n, coalesce(k, 0) / (SELECT count(*) FROM dec) AS share FROM (SELECT class_id FROM leg UNION ALL SELECT 0) LEFT JOIN h ON class_id = c", "rgba", "legend_rows")
def a6_class_histogram(rgba, rows):
    classes = L.legend(rows)
    return L.class_histogram(L.decode_colours(rgba, classes), classes)


@query("SELECT i.y, i.x, i.r, coalesce(l.g, 0) AS label FROM rgba i LEFT JOIN (SELECT y - 3 AS y, x - 1 AS x, g FROM rgba) l ON i.y = l.y AND i.x = l.x", "rgba")
def j2_pair_by_ground_bounds(rgba):
    return L.pair_by_ground_bounds(rgba.select("y", "x", "r"), rgba.select("y", "x", F.col("g").alias("class_id")), 3, 1)


@query("SELECT tile, x, y, CASE WHEN label = 0 OR dn = 0 THEN 255 ELSE label - 1 END AS target FROM pixels", "pixels")
def f6_remap_labels(pixels):
    return L.remap_labels(pixels).select("tile", "x", "y", "target")


@query(f"SELECT crop, round(valid_frac, 6) AS valid_frac, round(label_frac, 6) AS label_frac FROM {COVER}", "pixels")
def a7_coverage_fractions(pixels):
    shifted = pixels.withColumn("dn", F.col("dn") - 60).withColumn("label", F.col("label") - 4)
    return L.coverage_fractions(shifted, ["crop"]).select("crop", F.round("valid_frac", 6).alias("valid_frac"), F.round("label_frac", 6).alias("label_frac"))


@query("""SELECT tile, CAST(round_even((mr - ml) / res, 0) AS BIGINT) AS m_width, CAST(round_even((mt - mb) / res, 0) AS BIGINT) AS m_height, CAST(round_even(("left" - ml) / res, 0) AS BIGINT) AS off_x, CAST(round_even((mt - top) / res, 0) AS BIGINT) AS off_y
FROM tiles, (SELECT min("left") AS ml, max("right") AS mr, min(bottom) AS mb, max(top) AS mt FROM tiles)""", "tiles")
def a9_mosaic_extent(tiles):
    return L.mosaic_extent(tiles)


@query("""SELECT a.tile AS b_tile, b.tile AS t_tile FROM tiles a JOIN tiles b ON a.bottom < b.top AND b.bottom < a.top AND a."left" < b."right" AND b."left" < a."right" AND a.tile < b.tile""", "tiles")
def j4_tiles_for_blocks(tiles):
    side = lambda p: tiles.select(F.col("tile").alias(f"{p}tile"), *[F.col(c).alias(p + n) for c, n in (("bottom", "y0"), ("top", "y1"), ("left", "x0"), ("right", "x1"))])
    return T.tiles_for_blocks(side("b_"), side("t_"), 32).filter("b_tile < t_tile").select("b_tile", "t_tile")


@query("""SELECT tile, y, x, "row", col FROM pixels, (SELECT unnest(range(4)) AS "row") r, (SELECT unnest(range(4)) AS col) c WHERE y >= "row" * 2 AND y < "row" * 2 + 4 AND x >= col * 2 AND x < col * 2 + 4""", "pixels")
def j5_pixels_to_windows(pixels):
    return T.pixels_to_windows(pixels, 4, 2).select("tile", "y", "x", "row", "col")


@query("SELECT y, x, coalesce(arg_max(dn, tile) FILTER (dn <> 0), 0) AS dn FROM (SELECT tile, crop % 40 * 8 + y AS y, x, dn FROM pixels) GROUP BY y, x", "pixels")
def a10_mosaic_composite(pixels):
    return L.mosaic_composite(pixels.select("tile", (F.col("crop") % 40 * 8 + F.col("y")).alias("y"), "x", "dn"))


@query("SELECT y, x, coalesce(dn, 0) AS dn FROM (SELECT unnest(range(400)) AS y) CROSS JOIN (SELECT unnest(range(10)) AS x) LEFT JOIN (SELECT crop % 40 * 8 + y AS y, x, max(dn) AS dn FROM pixels GROUP BY ALL) USING (y, x)", "pixels")
def a10_fill_gaps(pixels):
    found = pixels.groupBy((F.col("crop") % 40 * 8 + F.col("y")).alias("y"), "x").agg(F.max("dn").alias("dn"))
    return L.fill_gaps(found, 400, 10, "dn", 0)


@query("SELECT tile, y // 3 AS block_y, x // 3 AS block_x, round(sum(dn * wy * wx) / sum(wy * wx), 6) AS dn FROM (SELECT *, CASE WHEN y = 7 THEN 2 ELSE 1 END AS wy, CASE WHEN x = 7 THEN 2 ELSE 1 END AS wx FROM pixels) GROUP BY ALL", "pixels")
def a11_downsample_mean(pixels):
    sized = pixels.withColumn("h", F.lit(8)).withColumn("w", F.lit(8))
    return L.downsample_mean(sized, "tile", "h", "w", 3).withColumn("dn", F.round("dn", 6))


@query("SELECT tile, block_y, block_x, round(dn, 6) AS dn, factor FROM (SELECT tile, y // 2 AS block_y, x // 2 AS block_x, avg(dn) AS dn, 2 AS factor FROM pixels GROUP BY ALL UNION ALL SELECT tile, y // 4, x // 4, avg(dn), 4 FROM pixels GROUP BY ALL)", "pixels")
def a12_build_pyramid(pixels):
    return L.build_pyramid(pixels, "tile", (2, 4)).withColumn("dn", F.round("dn", 6))


@query("SELECT crop, tile % 10 * 4 + y AS gy, tile % 5 * 4 + x AS gx, round(avg(dn), 6) AS v FROM pixels GROUP BY ALL", "pixels")
def a13_stitch_tiles(pixels):
    placed = pixels.select("crop", (F.col("tile") % 10 * 4).alias("row"), (F.col("tile") % 5 * 4).alias("col"), "y", "x", F.col("dn").alias("v"))
    return L.stitch_tiles(placed, "crop").withColumn("v", F.round("v", 6))


@query("SELECT crop, count_if(dn > 0)::BIGINT AS n_valid, round(avg(CASE WHEN dn > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM pixels GROUP BY crop", "pixels")
def a25_valid_share(pixels):
    return L.valid_share(pixels, "crop").withColumn("share", F.round("share", 6))


def _shifts(df: DataFrame) -> DataFrame:
    one = lambda n: df.sparkSession.range(-1, 2).select(F.col("id").alias(n))
    return one("dy").crossJoin(one("dx"))


EDGES = """e AS (SELECT tile, y, x, dn // 52 AS c, dn // 52 > 0 AND (coalesce(lead(dn // 52) OVER (PARTITION BY tile, y ORDER BY x) <> dn // 52, false) OR coalesce(lead(dn // 52) OVER (PARTITION BY tile, x ORDER BY y) <> dn // 52, false)) AS edge FROM pixels)"""


@query(f"WITH {EDGES} SELECT tile, y, x, edge FROM e", "pixels")
def w10_label_edges(pixels):
    labels = pixels.select("tile", "y", "x", F.floor(F.col("dn") / 52).alias("class_id"))
    return R.label_edges(labels, "tile").select("tile", "y", "x", "edge")


SWEEP = EDGES + """, sh AS (SELECT * FROM (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)), sw AS (SELECT sh.dy, sh.dx, avg(p.dn) AS energy FROM e, sh, pixels p WHERE edge AND p.tile = e.tile AND p.y = e.y + sh.dy AND p.x = e.x + sh.dx GROUP BY ALL)"""


def _sweep(pixels):
    edges = R.label_edges(pixels.select("tile", "y", "x", F.floor(F.col("dn") / 52).alias("class_id")), "tile")
    return R.edge_energy(edges, pixels.select("tile", "y", "x", F.col("dn").alias("g")), _shifts(pixels), "tile")


def _classes(blocks):
    """Block table of classes of the same images: DN // 52."""
    tiles = blocks.withColumn("window_id", F.lit(0).cast("long"))
    return W.map_tiles(tiles, lambda a: (a // 52).astype("uint8")).drop("window_id")


SHIFTED = """sh AS (SELECT dy, dx, CAST(floor(dy / 2.0) AS BIGINT) AS gy, CAST(floor(dx / 2.0) AS BIGINT) AS gx FROM (SELECT unnest(range(-4, 5, 2)) AS dy), (SELECT unnest(range(-4, 5, 2)) AS dx)),
grid AS (SELECT image_id, y // 2 AS y, x // 2 AS x, dn, dn // 52 AS c FROM mosaic WHERE y % 2 = 0 AND x % 2 = 0),
pr AS (SELECT a.image_id, sh.dy, sh.dx, a.dn, b.c FROM grid a, sh, grid b WHERE a.image_id = b.image_id AND b.y = a.y + sh.gy AND b.x = a.x + sh.gx AND a.dn > 0 AND b.c > 0 AND a.y BETWEEN 3 AND 28 AND a.x BETWEEN 3 AND 28),
k AS (SELECT image_id, dy, dx, c, count(*) AS n, avg(dn) AS m FROM pr GROUP BY ALL), tt AS (SELECT image_id, dy, dx, count(*) AS alln, avg(dn) AS mean, var_pop(dn) AS v FROM pr GROUP BY ALL),
bb AS (SELECT k.image_id, k.dy, k.dx, sum(CASE WHEN n >= 20 THEN n * (m - mean) ** 2 ELSE 0 END) AS ss FROM k JOIN tt ON k.image_id = tt.image_id AND k.dy = tt.dy AND k.dx = tt.dx GROUP BY ALL),
sw AS (SELECT i.image_id, sh.dy, sh.dx, CASE WHEN coalesce(alln, 0) < 300 THEN 0 ELSE coalesce(ss, 0) / alln / (v + 1e-9) END AS fisher FROM (SELECT DISTINCT image_id FROM mosaic) i CROSS JOIN sh LEFT JOIN tt ON tt.image_id = i.image_id AND tt.dy = sh.dy AND tt.dx = sh.dx LEFT JOIN bb ON bb.image_id = i.image_id AND bb.dy = sh.dy AND bb.dx = sh.dx)"""


def _separability(blocks):
    return R.separability_sweep(blocks, _classes(blocks), 4, 8, 2, 2, 20, 300)


@query(f"WITH {SHIFTED} SELECT image_id, dy, dx, round(fisher, 6) AS fisher FROM sw", "mosaic", of=("mosaic_blocks",))
def r6_separability_sweep(blocks):
    """Every second pixel, shifts of -4 to 4 by 2, three grid steps inside."""
    return _separability(blocks).withColumn("fisher", F.round("fisher", 6))


WEIGHTS = "(SELECT o, exp(-0.5::DOUBLE * o * o) / (SELECT sum(exp(-0.5::DOUBLE * o * o)) FROM (SELECT unnest(range(-4, 5)) AS o)) AS k FROM (SELECT unnest(range(-4, 5)) AS o))"
BLURRED = f"""ob AS (SELECT * FROM (VALUES (-1, -1, -1, -1), (-1, 0, -2, 0), (-1, 1, -1, 1), (0, -1, 0, -2), (0, 1, 0, 2), (1, -1, 1, -1), (1, 0, 2, 0), (1, 1, 1, 1)) t(oy, ox, ky, kx)), wt AS {WEIGHTS},
whole AS (SELECT i.image_id, y, x, coalesce(dn, 0) AS dn FROM (SELECT DISTINCT image_id FROM mosaic) i CROSS JOIN (SELECT unnest(range(64)) AS y) CROSS JOIN (SELECT unnest(range(64)) AS x) LEFT JOIN mosaic m USING (image_id, y, x)),
near AS (SELECT image_id, y, x, ky, kx, greatest(0, least(63, y + oy)) AS ny, greatest(0, least(63, x + ox)) AS nx FROM whole, ob),
gr AS (SELECT n.image_id, n.y, n.x, sqrt(sum(ky * w.dn) ** 2 + sum(kx * w.dn) ** 2) AS g FROM near n JOIN whole w ON w.image_id = n.image_id AND w.y = ny AND w.x = nx GROUP BY ALL),
g1 AS (SELECT t.image_id, t.y, t.x, sum(k * s.g) AS g FROM (SELECT image_id, y, x, k, CASE WHEN y + o < 0 THEN -(y + o) - 1 WHEN y + o > 63 THEN 127 - y - o ELSE y + o END AS ny FROM gr, wt) t JOIN gr s ON s.image_id = t.image_id AND s.y = ny AND s.x = t.x GROUP BY ALL),
g2 AS (SELECT t.image_id, t.y, t.x, sum(k * s.g) AS g FROM (SELECT image_id, y, x, k, CASE WHEN x + o < 0 THEN -(x + o) - 1 WHEN x + o > 63 THEN 127 - x - o ELSE x + o END AS nx FROM g1, wt) t JOIN g1 s ON s.image_id = t.image_id AND s.x = nx AND s.y = t.y GROUP BY ALL),
e AS (SELECT image_id, y, x FROM (SELECT image_id, y, x, dn // 52 AS c, lead(dn // 52) OVER (PARTITION BY image_id, y ORDER BY x) AS r, lead(dn // 52) OVER (PARTITION BY image_id, x ORDER BY y) AS d FROM whole) WHERE c > 0 AND (coalesce(r <> c, false) OR coalesce(d <> c, false)) AND y > 3 AND y < 61 AND x > 3 AND x < 61),
sh AS (SELECT * FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)), many AS (SELECT image_id, count(*) AS n FROM e GROUP BY image_id),
sw AS (SELECT e.image_id, sh.dy, sh.dx, avg(CASE WHEN w.dn = 0 THEN 0 ELSE g2.g END) AS energy FROM e JOIN many ON many.image_id = e.image_id AND n >= 1000, sh, g2, whole w WHERE g2.image_id = e.image_id AND g2.y = e.y + sh.dy AND g2.x = e.x + sh.dx AND w.image_id = e.image_id AND w.y = g2.y AND w.x = g2.x GROUP BY ALL)"""


def _edge_sweep(blocks):
    return R.edge_sweep(blocks, _classes(blocks), 3, 8, 1000)


@query(f"WITH {BLURRED} SELECT image_id, dy, dx, round(energy, 4) AS energy FROM sw UNION ALL SELECT i.image_id, NULL, NULL, NULL FROM (SELECT DISTINCT image_id FROM mosaic) i LEFT JOIN many ON many.image_id = i.image_id WHERE coalesce(n, 0) < 1000", "mosaic", of=("mosaic_blocks",))
def r7_edge_energy_sweep(blocks):
    """Shifts of -3 to 3; images of fewer than 1,000 edges have a null row."""
    return _edge_sweep(blocks).withColumn("energy", F.round("energy", 4))


@query(f"""WITH {BLURRED}, pk AS (SELECT image_id, min(struct_pack(v := -energy, dy := dy, dx := dx)) AS b, max(energy) FILTER (dy = 0 AND dx = 0) AS zero FROM sw GROUP BY image_id),
f AS (SELECT image_id, b.dy AS dy, b.dx AS dx, -b.v / (zero + 1e-9) > 1.05 OR CASE WHEN zero > 0 THEN -b.v / zero - 1 ELSE 0 END > 0.1 AS resolvable FROM pk)
SELECT image_id, resolvable, CASE WHEN resolvable THEN dy ELSE 0 END AS best_dy, CASE WHEN resolvable THEN dx ELSE 0 END AS best_dx, CASE WHEN resolvable THEN sqrt(dy * dy + dx * dx) ELSE 0 END AS residual_px, CASE WHEN resolvable THEN sqrt(dy * dy + dx * dx) ELSE 0 END * 0.25::DOUBLE AS residual_m FROM f""", "mosaic", of=("mosaic_blocks",))
def r8_registration_report(blocks):
    peak = R.peaks(_edge_sweep(blocks), "energy").withColumnsRenamed({"dy": "best_dy", "dx": "best_dx"})
    return R.registration_report(peak, res=0.25)


@query("SELECT tile, y, x, CAST(sum(d) OVER (PARTITION BY tile, y ORDER BY x) AS BIGINT) AS total FROM (SELECT *, sum(dn) OVER (PARTITION BY tile, x ORDER BY y) AS d FROM pixels)", "pixels")
def w11_integral_image(pixels):
    return Q.integral_image(pixels, "tile", "dn").select("tile", "y", "x", "total")


@query(STRETCH + " SELECT tile, y, x, CAST(round_even(round(unit * 255, 9), 0) AS INTEGER) AS u8 FROM s", "pixels", of=("blocks",))
def f2_robust_stretch(blocks):
    out = _values(Q.stretch_blocks(blocks, Q.stretch_limits(Q.value_counts(blocks))))
    return out.select("tile", *_place(), F.col("v").cast("int").alias("u8"))


@query("SELECT tile, y, x, dn / 127.5::DOUBLE - 1 AS v, CAST(dn AS INTEGER) AS u8 FROM pixels", "pixels")
def f5_dequantise_requantise(pixels):
    v = Q.dequantise(F.col("dn"))
    return pixels.select("tile", "y", "x", v.alias("v"), Q.requantise(v).alias("u8"))


SOFT = """l AS (SELECT *, list_max(logits) AS mx FROM logits), n AS (SELECT *, mx + ln(list_sum(list_transform(logits, lambda x: exp(x - mx)))) AS lse FROM l)"""


@query(f"WITH {SOFT} SELECT vec_id, round(exp(mx - lse), 6) AS confidence, round(-list_sum(list_transform(logits, lambda x: exp(x - lse) * ln(greatest(exp(x - lse), 1e-8)))), 6) AS entropy, CAST(list_position(logits, mx) - 1 AS BIGINT) AS argmax FROM n", "logits")
def f10_confidence_entropy(logits):
    out = M.confidence_entropy(logits)
    return out.select("vec_id", F.round("confidence", 6).alias("confidence"), F.round("entropy", 6).alias("entropy"), "argmax")


@query(f"WITH {SOFT} SELECT round(avg(lse - logits[target + 1]), 6) AS loss FROM n WHERE target <> 255", "logits")
def a17_cross_entropy(logits):
    return M.cross_entropy(logits).select(F.round("loss", 6).alias("loss"))


MIOU = """pp AS (SELECT batch, target, CAST(list_position(logits, list_max(logits)) - 1 AS BIGINT) AS pred FROM logits), v AS (SELECT * FROM pp WHERE target <> 255),
cl AS (SELECT batch, c, sum(p) AS p, sum(t) AS t, sum(i) AS i FROM (SELECT batch, pred AS c, 1 AS p, 0 AS t, CASE WHEN pred = target THEN 1 ELSE 0 END AS i FROM v UNION ALL SELECT batch, target, 0, 1, 0 FROM v) GROUP BY ALL),
bm AS (SELECT batch, sum(i) / sum(t) AS accuracy, avg(i / (p + t - i)) AS miou FROM cl GROUP BY batch)"""


@query(f"WITH {MIOU} SELECT b.batch, round(coalesce(accuracy, 0), 6) AS accuracy, round(coalesce(miou, 0), 6) AS miou FROM (SELECT DISTINCT batch FROM pp) b LEFT JOIN bm ON b.batch = bm.batch", "logits")
def a15_segmentation_metrics(logits):
    pairs = logits.select("batch", "target", (F.array_position("logits", F.array_max("logits")) - 1).alias("pred"))
    return M.segmentation_metrics(pairs, "batch").select("batch", F.round("accuracy", 6).alias("accuracy"), F.round("miou", 6).alias("miou"))


@query("SELECT run, round(sum(metric * batch_size) / sum(batch_size), 6) AS metric FROM history GROUP BY run", "history")
def a16_epoch_metrics(history):
    return M.epoch_metrics(history, "run", "metric", "batch_size").withColumn("metric", F.round("metric", 6))


@query("SELECT crop, round(sum(CASE WHEN label % 2 = 0 THEN CASE WHEN abs(dn / 100 - 1) < 1 THEN 0.5 * (dn / 100 - 1) ** 2 ELSE abs(dn / 100 - 1) - 0.5 END ELSE 0 END) / greatest(count_if(label % 2 = 0), 1), 6) AS loss FROM pixels GROUP BY crop", "pixels")
def a18_masked_loss(pixels):
    rows = pixels.select("crop", (F.col("dn") / 100).alias("recon"), F.lit(1.0).alias("target"), (F.col("label") % 2 == 0).alias("mask"))
    return M.masked_loss(rows, "crop", "smooth_l1").withColumn("loss", F.round("loss", 6))


@query("SELECT crop, label, n / total AS share FROM (SELECT crop, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY crop) AS total FROM pixels WHERE label <> 3 GROUP BY crop, label) WHERE n / total >= 0.15", "pixels")
def a19_class_presence(pixels):
    return M.class_presence(pixels, "crop", "label", 3, 0.15)


@query("SELECT crop, dim, round(avg(v), 6) AS mean, round(avg(v) * (dim + 1), 6) AS psi FROM (SELECT crop, (y * 8 + x)::INTEGER AS dim, dn::DOUBLE AS v FROM pixels) GROUP BY crop, dim", "pixels")
def a20_pooled_features(pixels):
    rows = pixels.groupBy("crop", "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("y") * 8 + F.col("x")).alias("p"), "dn"))), lambda s: s["dn"]).alias("f"))
    weights = pixels.sparkSession.range(64).select(F.col("id").cast("int").alias("dim"), (F.col("id") + 1).alias("w"))
    out = class_embedding(pooled_features(rows, "crop", "f"), weights)
    return out.select("crop", "dim", F.round("mean", 6).alias("mean"), F.round("psi", 6).alias("psi"))


@query("SELECT quantile_cont(dn, 0.95) AS reference FROM (SELECT dn::DOUBLE AS dn FROM pixels)", "pixels")
def a22_reference_distance(pixels):
    return M.reference_distance(pixels.withColumn("dn", F.col("dn").cast("double")), "dn")


@query("SELECT round(avg(s / 64), 6) AS distance FROM (SELECT list_sum(list_transform(logits, lambda x: (x * 0.5 - x) ** 2)) AS s FROM logits)", "logits")
def a24_feature_distance(logits):
    a = logits.select("vec_id", F.col("logits").alias("f"))
    return M.feature_distance(a, a.select("vec_id", F.transform("f", lambda x: x * 0.5).alias("f")), "vec_id").select(F.round("distance", 6).alias("distance"))


@query("SELECT vec_id, class_id, round(list_sum(list_transform(logits, lambda x: x * (class_id + 1))) + class_id, 6) AS logit FROM logits, (SELECT unnest(range(3)) AS class_id)", "logits")
def f11_linear_logits(logits):
    ids = logits.sparkSession.range(3).select(F.col("id").alias("class_id"))
    weights = ids.select("class_id", F.array_repeat((F.col("class_id") + 1).cast("double"), 64).alias("w"), F.col("class_id").cast("double").alias("b"))
    return linear_logits(logits, weights, "logits").select("vec_id", "class_id", F.round("logit", 6).alias("logit"))


def _image_blocks(pixels, block=4):
    """The 8 x 8 tiles as block tables, one image a tile."""
    at = pixels.select("tile", "y", "x", "dn", (F.floor(F.col("y") / block) * block).alias("y0"), (F.floor(F.col("x") / block) * block).alias("x0"))
    rows = at.groupBy("tile", "y0", "x0").agg(F.array_sort(F.collect_list(F.struct("y", "x", "dn"))).alias("s"))
    raw = F.unhex(F.array_join(F.transform("s", lambda p: F.lpad(F.hex(p["dn"]), 2, "0")), ""))
    kind = [F.lit(block).alias("h"), F.lit(block).alias("w"), F.lit(1).alias("channels"), F.lit("uint8").alias("dtype")]
    return rows.select(F.col("tile").alias("image_id"), "y0", "x0", *kind, raw.alias("pixels"))


def _whole_tiles(pixels):
    return _image_blocks(pixels, 8).withColumn("window_id", F.lit(0).cast("long")).drop("y0", "x0")


def _values(tiles):
    """tile, i, v of tiles: their values in row order."""

    def work(lists):
        import numpy as np

        for rows in lists:
            v = [np.frombuffer(r["pixels"], r["dtype"]).astype(float) for r in rows]
            yield {"tile": [r["image_id"] for r, a in zip(rows, v, strict=True) for _ in a], "i": np.concatenate([np.arange(len(a)) for a in v]), "v": np.concatenate(v)}

    kind = dict(tiles.dtypes)["image_id"]
    return mapped(tiles.select("image_id", "pixels", "dtype"), work, f"tile {kind}, i long, v double")


@query("""SELECT o.tile, (wy + 3) * 7 + wx - 4 AS i, CAST(dn AS DOUBLE) AS v FROM (SELECT tile, unnest(range(4, 11)) AS wx, wy FROM (SELECT DISTINCT tile, wy FROM pixels, (SELECT unnest(range(-3, 4)) AS wy))) o
JOIN pixels ON pixels.tile = o.tile AND y = greatest(0, least(7, wy)) AND x = greatest(0, least(7, wx))""", "pixels")
def r1_extract_windows(pixels):
    size = [F.lit(n).cast("long").alias(c) for c, n in (("window_id", 0), ("top", -3), ("left", 4), ("height", 7), ("width", 7), ("image_height", 8), ("image_width", 8))]
    windows = pixels.select(F.col("tile").alias("image_id")).distinct().select("image_id", *size)
    return _values(W.extract_windows(_image_blocks(pixels), windows, 4))


@query("SELECT tile, (y // 2) * 4 + x // 2 AS i, avg(dn) AS v FROM pixels GROUP BY ALL", "pixels")
def r2_resize_bilinear(pixels):
    return _values(W.resize_tiles(_whole_tiles(pixels), 4, 4))


@query("""SELECT tile, y * 4 + x AS i, CAST(dn AS DOUBLE) AS v FROM (SELECT tile, (y - 1) // 2 AS y, (x - 1) // 2 AS x, dn FROM pixels WHERE y % 2 = 1 AND x % 2 = 1)""", "pixels")
def r3_warp_nearest(pixels):
    source = {"left": 0.0, "top": 0.0, "xres": 1.0, "yres": 1.0, "height": 8, "width": 8}
    size = [F.lit(n).cast("long").alias(c) for c, n in (("window_id", 0), ("row", 0), ("col", 0), ("h", 4), ("w", 4))]
    targets = pixels.select(F.col("tile").alias("image_id")).distinct().select("image_id", *size)
    return _values(W.warp_to_grid(_image_blocks(pixels), targets, source, {"left": 0.0, "top": 0.0, "xres": 2.0, "yres": 2.0}, 4, "nearest"))


@query("""WITH o AS (SELECT * FROM (VALUES (-1, -1, -1, -1), (-1, 0, -2, 0), (-1, 1, -1, 1), (0, -1, 0, -2), (0, 1, 0, 2), (1, -1, 1, -1), (1, 0, 2, 0), (1, 1, 1, 1)) t(dy, dx, ky, kx)),
n AS (SELECT tile, y, x, ky, kx, greatest(0, least(7, y + dy)) AS ny, greatest(0, least(7, x + dx)) AS nx FROM pixels, o)
SELECT n.tile, n.y * 8 + n.x AS i, round(sqrt(sum(ky * p.dn) ** 2 + sum(kx * p.dn) ** 2), 3) AS v FROM n JOIN pixels p ON p.tile = n.tile AND p.y = ny AND p.x = nx GROUP BY n.tile, n.y, n.x""", "pixels")
def r4_image_gradient(pixels):
    tiles = W.image_gradient(_whole_tiles(pixels))
    return _values(tiles).withColumn("v", F.round("v", 3))


@query("SELECT tile, y, x, CASE WHEN dn IN (0, 255) THEN true ELSE false END AS invalid FROM pixels", "pixels")
def f1_pixel_invalid(pixels):
    return pixels.select("tile", "y", "x", Q.pixel_invalid(F.col("dn"), "uint8").alias("invalid"))


@query("""SELECT tile, dy, dx, avg(b.dn - a.dn) AS gap FROM (SELECT a.tile, a.dn, a.y + dy AS ly, a.x + dx AS lx, dy, dx FROM pixels a, (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx)) a
JOIN (SELECT tile AS t, y, x, dn FROM pixels) b ON a.tile = b.t AND ly = b.y AND lx = b.x GROUP BY tile, dy, dx""", "pixels", of=("blocks",))
def j9_shift_join(blocks):
    """Gaps between each pixel and its neighbours, from sums by shift and value."""
    own = blocks.withColumn("image_height", F.lit(8)).withColumn("image_width", F.lit(8))
    shifts = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    sums = R.shift_sums(own, blocks, shifts, 8, valid=False)
    gap = (F.sum(F.col("class_id") * F.col("n")) - F.sum("s")) / F.sum("n")
    return sums.groupBy(F.col("image_id").alias("tile"), "dy", "dx").agg(gap.alias("gap"))


@query("""WITH g AS (SELECT crop, label, dn FROM pixels WHERE dn > 0 AND label > 0), t AS (SELECT crop, count(*) AS n, avg(dn) AS m, var_pop(dn) AS v FROM g GROUP BY crop),
k AS (SELECT crop, label, count(*) AS n, avg(dn) AS m FROM g GROUP BY crop, label HAVING count(*) >= 50)
SELECT t.crop, round(CASE WHEN any_value(t.n) < 300 THEN 0 ELSE coalesce(sum(k.n * (k.m - t.m) ** 2), 0) / any_value(t.n) / (any_value(t.v) + 1e-9) END, 9) AS fisher FROM t LEFT JOIN k ON t.crop = k.crop GROUP BY t.crop""", "pixels")
def a14_fisher_ratio(pixels):
    pairs = pixels.select("crop", "dn", F.col("label").alias("class_id"))
    return R.fisher_ratio(pairs, ["crop"], 50, 300).withColumn("fisher", F.round("fisher", 9))


@query("SELECT 100 + height AS height, width, xres AS a, 0.0::DOUBLE AS b, 10.0::DOUBLE AS c, 0.0::DOUBLE AS d, -xres AS e, 20.0::DOUBLE AS f, xres AS res_x, xres AS res_y, 10.0::DOUBLE AS \"left\", 20.0::DOUBLE AS top, 10 + xres * width AS \"right\", 20 - xres * (100 + height) AS bottom FROM catalog", "catalog")
def s13_target_grid(catalog):
    zero, x = F.lit(0.0), F.col("xres")
    return manifests.target_grid(catalog.select((F.col("height") + 100).alias("height"), "width", x.alias("a"), zero.alias("b"), F.lit(10.0).alias("c"), zero.alias("d"), (-x).alias("e"), F.lit(20.0).alias("f")))


@query(f"""SELECT image_id AS source_image, 'npy' AS reader_backend, 'p/' || image_id AS patch_path, '' AS context_path, '' AS context_base_path, '' AS context_cache_path, 'patch_file' AS local_storage, 100 AS context_output_size, 2.0::DOUBLE AS context_scale, image_id AS patch_name,
"row", col, top, "left", 96 AS patch_size, 64 AS stride, least(96, height - top) AS valid_height, least(96, width - "left") AS valid_width, 96 - least(96, height - top) AS pad_bottom, 96 - least(96, width - "left") AS pad_right, height AS image_height, width AS image_width,
1 AS channels, 'uint8' AS dtype, 'constant' AS pad_mode, 0.0::DOUBLE AS pad_value, 200 AS context_size, top - 52 AS context_top, "left" - 52 AS context_left, greatest(least(top + 148, height) - greatest(top - 52, 0), 0) AS context_valid_height, greatest(least("left" + 148, width) - greatest("left" - 52, 0), 0) AS context_valid_width,
greatest(52 - top, 0) AS context_pad_top, greatest(top + 148 - height, 0) AS context_pad_bottom, greatest(52 - "left", 0) AS context_pad_left, greatest("left" + 148 - width, 0) AS context_pad_right, 0.5::DOUBLE AS invalid_fraction FROM {GRID}""", "catalog")
def p8_build_manifest(catalog):
    grid = T.context_window(T.padded_grid(catalog, 96, 64), 96, 200)
    text = {"source_image": F.col("image_id"), "reader_backend": F.lit("npy"), "patch_path": F.concat(F.lit("p/"), "image_id"), "patch_name": F.col("image_id"), "dtype": F.lit("uint8")}
    none = {c: F.lit(None).cast("string") for c in ("context_base_path", "context_cache_path")}
    return manifests.build_manifest(grid.withColumns(text | none | {"channels": F.lit(1), "invalid_fraction": F.lit(0.5)}), 96, 64, 200, 100)


@query("""SELECT crop_id, CASE WHEN crop_id % 3 = 0 THEN 'offline_paired_context' WHEN user_obs IN (SELECT observation_id FROM crops WHERE event_type = 'error') THEN 'offline_shared_context' ELSE 'online_jp2' END AS backend FROM (SELECT crop_id, observation_id AS user_obs FROM crops)""", "crops")
def j8_resolve_backend(crops):
    patches = crops.select("crop_id", F.concat(F.lit("cache/"), "crop_id").alias("context_cache_path"), F.col("observation_id").alias("context_base_path"))
    existing = patches.filter("crop_id % 3 = 0").select(F.col("context_cache_path").alias("path")).unionByName(crops.filter("event_type = 'error'").select(F.col("observation_id").alias("path")))
    return manifests.resolve_backend(patches, existing).select("crop_id", "backend")


TAGGED = "SELECT crop_id, CASE crop_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'other' ELSE 'train' END AS split, decision FROM crops"


def _tagged(crops: DataFrame) -> DataFrame:
    tag = F.when(F.col("crop_id") % 5 == 0, "val").when(F.col("crop_id") % 5 == 1, "other").otherwise("train")
    return crops.select("crop_id", tag.alias("split"), "decision")


@query(f"SELECT crop_id, split FROM ({TAGGED}) WHERE split = 'val'", "crops")
def p14_select_split(crops):
    return S.select_split(_tagged(crops), "val").select("crop_id", "split")


@query(f"SELECT split, count(*) AS candidates, count(*) FILTER (decision = 'kept') AS kept FROM ({TAGGED}) GROUP BY ROLLUP (split)", "crops")
def a8_split_counts(crops):
    return S.split_counts(_tagged(crops), F.col("decision") == "kept")


FINITE = """WITH q AS (SELECT tile AS t, quantile_cont(dn::DOUBLE, 0.01) AS p1, quantile_cont(dn::DOUBLE, 0.99) AS p99, min(dn)::DOUBLE AS mn, max(dn)::DOUBLE AS mx FROM pixels GROUP BY tile),
l AS (SELECT t, CASE WHEN p99 > p1 THEN p1 ELSE mn END AS lo, CASE WHEN p99 > p1 THEN p99 ELSE mx END AS hi FROM q),
s AS (SELECT tile, y, x, CASE WHEN hi > lo THEN least(1.0, greatest(0.0, (dn - lo) / (hi - lo))) ELSE 0 END AS unit FROM pixels JOIN l ON tile = t)"""


@query(FINITE + " SELECT tile, y, x, round(unit, 6) AS unit FROM s", "pixels", of=("blocks",))
def f3_unit_range(blocks):
    limits = Q.stretch_limits(Q.value_counts(blocks), finite=True)
    return _values(Q.stretch_blocks(blocks, limits, out="float64")).select("tile", *_place(), F.round("v", 6).alias("unit"))


@query(FINITE + " SELECT tile, y, x, CAST(floor(unit * 255) AS INTEGER) AS u8 FROM s", "pixels", of=("blocks",))
def f4_preview_stretch(blocks):
    limits = Q.stretch_limits(Q.value_counts(blocks), finite=True)
    return _values(Q.stretch_blocks(blocks, limits, out="preview")).select("tile", *_place(), F.col("v").cast("int").alias("u8"))


@query(FINITE.replace("FROM pixels", "FROM banded").replace("WITH q", "WITH banded AS (SELECT tile // 5 AS tile, tile % 5 AS ch, y, x, dn FROM pixels WHERE tile % 5 < 3), q").replace("tile, y, x, CASE", "tile, ch, y, x, CASE") + " SELECT tile, ch, y, x, CAST(floor(unit * 255) AS INTEGER) AS u8 FROM s", "pixels")
def f4_preview_of_channels(pixels):
    """Of images of five channels only the first three are stretched."""
    banded = pixels.select(F.floor(F.col("tile") / 5).alias("tile"), (F.col("tile") % 5).alias("ch"), "y", "x", "dn")
    return Q.preview_stretch(banded, "tile").select("tile", "ch", "y", "x", "u8")


@query(f"WITH {SWEEP}, z AS (SELECT max(energy) AS zero FROM sw WHERE dy = 0 AND dx = 0) SELECT dy, dx, round(energy, 6) AS peak, round(zero, 6) AS zero, round(CASE WHEN zero > 0 THEN energy / zero - 1 ELSE 0 END, 6) AS gain FROM sw, z ORDER BY energy DESC, dy, dx LIMIT 1", "pixels")
def t3_surface_peak(pixels):
    return R.surface_peak(_sweep(pixels), "energy").select("dy", "dx", *[F.round(n, 6).alias(n) for n in ("peak", "zero", "gain")])


@query(f'SELECT image_id, "row", col FROM {GRID}', "catalog")
def t6_scan_order(catalog):
    return T.scan_order(T.padded_grid(catalog, 96, 64)).select("image_id", "row", "col")


@query("""WITH v AS (SELECT target, unnest(range(64)) AS i, logits FROM logits), m AS (SELECT target, i, avg(logits[i + 1]) AS mean FROM v GROUP BY target, i)
SELECT a.target, a.i, b.i AS j, round(any_value(a.mean), 6) AS mean, round(sum((l.logits[a.i + 1] - a.mean) * (l.logits[b.i + 1] - b.mean)) / greatest(1, count(*) - 1), 5) AS cov
FROM logits l JOIN m a ON l.target = a.target JOIN m b ON l.target = b.target GROUP BY a.target, a.i, b.i""", "logits")
def a21_class_covariances(logits):
    """Means and covariances of features by class, from partial moments."""
    fitted = class_moments(logits, "target", "logits").select("target", "n", "mean", F.posexplode("scatter").alias("at", "v"))
    i, j = F.floor(F.col("at") / 64), F.col("at") % 64
    return fitted.select("target", i.alias("i"), j.cast("long").alias("j"), F.round(F.col("mean")[i.cast("int")], 6).alias("mean"), F.round(F.col("v") / F.greatest(F.lit(1), F.col("n") - 1), 5).alias("cov"))


@query(None, "logits")
def a21_class_gaussians(logits):
    return fit_class_gaussians(logits, "target", "logits")


@query(None, "logits")
def f12_mahalanobis(logits):
    return mahalanobis_score(logits, fit_class_gaussians(logits, "target", "logits"), "logits").select("vec_id", "target", "score")


@query(None, "logits")
def a23_class_pca(logits):
    return fit_class_pca(logits, "target", "logits").drop("mean")


@query(None, "logits")
def f13_project_components(logits):
    return project_components(logits, fit_class_pca(logits, "target", "logits"), "target", "logits").select("vec_id", "target", "component", "score")


@query("SELECT tile, avg(dn)::DOUBLE AS score FROM pixels GROUP BY tile", "pixels")
def x2_score_tiles(pixels):
    def load():
        import numpy as np

        return lambda part: [np.frombuffer(raw, np.uint8).mean() for raw in part["pixels"]]

    return W.score_tiles(_whole_tiles(pixels), "image_id", load).withColumnRenamed("image_id", "tile")


@query("""SELECT image_id, "row", col, top, "left", '/data/p/' || image_id AS patch_path, 'patch_file' AS local_storage, 200 AS context_output_size, 1.0::DOUBLE AS context_scale, 0.0::DOUBLE AS pad_value FROM """ + GRID, "catalog")
def s4_patch_index(catalog):
    """A legacy index, without the newer columns, written and read again."""
    path = scratch(catalog.sparkSession, "patch-index")
    grid = T.padded_grid(catalog, 96, 64)
    rows = grid.select(F.concat(F.lit("/data/"), "image_id").alias("source_image"), F.concat(F.lit("p/"), "image_id").alias("patch_path"), "row", "col", "top", "left", F.lit(200).alias("context_size"))
    rows.write.option("header", True).csv(path)
    read = manifests.read_patch_index(catalog.sparkSession, path, "/data")
    return read.select(F.substring_index("source_image", "/", -1).alias("image_id"), "row", "col", "top", "left", "patch_path", "local_storage", "context_output_size", "context_scale", "pad_value")


@query("""SELECT '/data/' || name AS crop_path, observation_id, row_number() OVER (ORDER BY '/data/' || name) - 1 AS "index" FROM (SELECT printf('c%012d', crop_id) AS name, observation_id FROM crops)""", "crops")
def s5_crop_index(crops):
    path = scratch(crops.sparkSession, "crop-index")
    crops.select(F.format_string("c%012d", "crop_id").alias("crop_path"), "observation_id").write.option("header", True).csv(path)
    return manifests.read_crop_index(crops.sparkSession, path, "/data").select("crop_path", "observation_id", "index")


@query("SELECT DISTINCT observation_id, CASE WHEN length(observation_id) % 2 = 0 THEN 'val' ELSE 'train' END AS split FROM crops", "crops")
def s6_splits(crops):
    path = scratch(crops.sparkSession, "splits")
    ids = crops.select("observation_id", F.when(F.length("observation_id") % 2 == 0, "val").otherwise("train").alias("split"))
    manifests.write_splits(ids, path)
    return manifests.read_splits(crops.sparkSession, path)


@query("SELECT crop_id AS \"row\", 512 AS size, 'train' AS split, invalid_fraction AS valid_frac FROM crops", "crops")
def s7_seg_manifest(crops):
    """A manifest without splits, written and read again."""
    path = scratch(crops.sparkSession, "seg-manifest")
    crops.select(F.lit(0).alias("col"), F.col("crop_id").alias("row"), F.lit(512).alias("size"), F.col("invalid_fraction").alias("valid_frac"), F.lit(1.0).alias("label_frac")).write.option("header", True).csv(path)
    return manifests.read_seg_manifest(crops.sparkSession, path).select(F.col("row").cast("long").alias("row"), "size", "split", "valid_frac")


@query("SELECT tile AS image_id, tile % 16 AS folder, string_agg(printf('%02X', dn), '' ORDER BY y, x) AS pixels FROM pixels GROUP BY tile", "pixels")
def s9_write_tiles(pixels):
    """Sixteen folders, the pixels as they were written."""
    path, spark = scratch(pixels.sparkSession, "tiles"), pixels.sparkSession
    tiles = _whole_tiles(pixels).withColumn("tile", F.col("image_id")).withColumn("image_id", F.col("tile") % 16)
    manifests.write_tiles(tiles, path)
    return spark.read.parquet(path).select(F.col("tile").alias("image_id"), F.col("image_id").cast("long").alias("folder"), F.hex("pixels").alias("pixels"))


@query('SELECT image_id, "row", col, 0.5::DOUBLE AS invalid_fraction FROM ' + GRID, "catalog")
def s10_manifest_index(catalog):
    path, spark = scratch(catalog.sparkSession, "manifest"), catalog.sparkSession
    manifests.write_manifest_index(p8_build_manifest(catalog), path)
    read = manifests.read_patch_index(spark, path, "/data")
    return read.select(F.substring_index("source_image", "/", -1).alias("image_id"), "row", "col", "invalid_fraction")


@query("SELECT run, epoch, metric FROM history", "history")
def s15_history(history):
    path, rows = scratch(history.sparkSession, "history"), history.select("run", "epoch", "metric")
    return history.sparkSession.read.schema(rows.schema).option("header", True).csv(path) if manifests.write_history(rows, path) else rows


@query("SELECT target, count(*) AS n FROM logits GROUP BY target", "logits")
def s14_artifacts(logits):
    path, spark = scratch(logits.sparkSession, "artifact"), logits.sparkSession
    fitted = class_moments(logits, "target", "logits").select("target", "n")
    manifests.save_artifact(fitted, path)
    return manifests.load_artifact(spark, path, "target long, n long")


def _mosaic_tiles(blocks):
    """The mosaics as whole tiles of 64 x 64 pixels."""
    whole = [F.lit(n).cast("long").alias(c) for c, n in (("window_id", 0), ("top", 0), ("left", 0), ("height", 64), ("width", 64), ("image_height", 64), ("image_width", 64))]
    return W.extract_windows(blocks, blocks.select("image_id").distinct().select("image_id", *whole), 8, "constant")


WHOLE = """whole AS (SELECT i.image_id, y, x, coalesce(dn, 0) AS dn FROM (SELECT DISTINCT image_id FROM mosaic) i CROSS JOIN (SELECT unnest(range(64)) AS y) CROSS JOIN (SELECT unnest(range(64)) AS x) LEFT JOIN mosaic m USING (image_id, y, x))"""


def _written(blocks, suffix="npy"):
    """A folder of one raster file for each mosaic."""
    path = scratch(blocks.sparkSession, "rasters")
    named = _mosaic_tiles(blocks).withColumn("name", F.format_string(f"Img_%04d.{suffix}", "image_id"))
    rasters.write_rasters(named, path, "npy" if suffix == "npy" else "raw")
    return path


@query("SELECT printf('Img_%04d.npy', image_id) AS name, 128 + 64 * 64 AS length FROM (SELECT DISTINCT image_id FROM mosaic) WHERE regexp_matches(printf('%04d', image_id), '[0-4]$')", "mosaic", of=("mosaic_blocks",))
def s1_discover_rasters(blocks):
    """Files whose name matches, whatever its case."""
    found = rasters.discover_rasters(blocks.sparkSession, _written(blocks), "IMG_*[0-4].npy")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("SELECT DISTINCT printf('Img_%04d', image_id) AS image_id, 64 AS height, 64 AS width, 1 AS channels, 'uint8' AS dtype, 16 AS total, 10 AS analysed FROM mosaic", "mosaic", of=("mosaic_blocks",))
def s2_raster_inventory(blocks):
    return rasters.file_inventory(blocks.sparkSession, _written(blocks), 16, 10).select("image_id", "height", "width", "channels", "dtype", "total", "analysed")


@query(f"WITH {WHOLE} SELECT printf('Img_%04d', image_id) AS image_id, y, x, CAST(dn AS DOUBLE) AS v FROM whole WHERE y BETWEEN 10 AND 39 AND x BETWEEN 41 AND 63", "mosaic", of=("mosaic_blocks",))
def s3_read_region(blocks):
    """Of files in blocks of 24 pixels only a region is read, which reaches beyond them."""
    read = rasters.read_blocks(blocks.sparkSession, _written(blocks), block=24, region=(10, 41, 30, 60))
    part = rasters.read_region(read, 10, 41, 30, 60)
    values = _values(part).join(part.select("image_id", "y0", "x0", "w"), F.col("tile") == F.col("image_id"))
    return values.select("image_id", (F.col("y0") + F.floor(F.col("i") / F.col("w"))).alias("y"), (F.col("x0") + F.col("i") % F.col("w")).alias("x"), "v")


@query(f"WITH {WHOLE} SELECT printf('Img_%04d', image_id) AS image_id, CAST(sum(dn) AS BIGINT) AS total, 0 AS n_errors FROM whole GROUP BY image_id", "mosaic", of=("mosaic_blocks",))
def x1_register_decoder(blocks):
    """A suffix with two decoders, of which the first always fails."""
    import numpy as np

    before = list(rasters._DECODERS)
    try:
        rasters.register_decoder("vrt", lambda raw: 1 / 0)
        rasters.register_decoder("vrt", lambda raw: np.frombuffer(raw, np.uint8).reshape(64, 64))
        read = rasters.read_blocks(blocks.sparkSession, _written(blocks, "vrt"), block=64)
    finally:
        rasters._DECODERS[:] = before
    errors = read.groupBy("image_id").agg(F.count("error").alias("n_errors"))
    sums = _values(read).groupBy(F.col("tile").alias("image_id")).agg(F.sum("v").cast("long").alias("total"))
    return sums.join(errors, "image_id").select("image_id", "total", F.col("n_errors").cast("int").alias("n_errors"))


INGESTED = """kept AS (SELECT DISTINCT observation_id, crop_id FROM crops WHERE invalid_fraction <= 0.1), o AS (SELECT observation_id, row_number() OVER (ORDER BY md5('42:' || observation_id), observation_id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT observation_id FROM kept))"""


def _ingested(crops):
    """Half of the crops arrive, then all of them again with the rest."""
    spark = crops.sparkSession
    arrivals, root, checkpoint = (scratch(spark, n) for n in ("arrivals", "ingested", "ingest-state"))
    rows = crops.select("observation_id", F.floor(F.col("crop_id") / 1000).cast("int").alias("row"), (F.col("crop_id") % 1000).cast("int").alias("col"), "invalid_fraction")
    for part in (rows.filter("col % 2 = 0"), rows):
        part.write.mode("append").parquet(arrivals)
        ingest.ingest_incremental(spark.readStream.schema(rows.schema).parquet(arrivals), root, checkpoint, 0.1, 0.2, 5)
    return root


@query(f"WITH {INGESTED} SELECT observation_id, CASE WHEN rk <= least(greatest(5, round_even(n * 0.2::DOUBLE, 0)), n) THEN 'val' ELSE 'train' END AS split FROM o", "crops")
def st1_ingest_incremental(crops):
    return ingest.read_index(crops.sparkSession, _ingested(crops)).select("observation_id", "split")


@query(f"WITH {INGESTED} SELECT (SELECT count(*) FROM kept) AS n_crops, (SELECT count(*) FROM o) AS n_observations", "crops")
def s11_rebuild_index(crops):
    return ingest.index_counts(crops.sparkSession, _ingested(crops))


@query("""SELECT tile, oy * 5 + ox AS i, CAST(dn AS DOUBLE) AS v FROM (SELECT tile, oy, ox, CAST(round_even((tile % 5 * 8 + 4) / 4.0::DOUBLE, 0) AS BIGINT) AS cy, CAST(round_even((tile % 3 * 8 + 4) / 4.0::DOUBLE, 0) AS BIGINT) AS cx FROM (SELECT DISTINCT tile FROM pixels), (SELECT unnest(range(5)) AS oy), (SELECT unnest(range(5)) AS ox)) w
JOIN pixels USING (tile) WHERE y = greatest(0, least(7, least(greatest(cy, 0), 7) - 2 + oy)) AND x = greatest(0, least(7, least(greatest(cx, 0), 7) - 2 + ox))""", "pixels", of=("blocks",))
def j6_context_from_base(blocks):
    """Contexts of five pixels around places of a base that is four times smaller."""
    at = lambda m: (F.col("image_id") % m * 8).cast("long")
    size = [F.lit(v).alias(c) for c, v in (("patch_size", 8), ("context_scale", 4.0), ("context_output_size", 5), ("base_height", 8), ("base_width", 8))]
    patches = blocks.select("image_id", F.lit(0).cast("long").alias("window_id"), at(5).alias("top"), at(3).alias("left"), *size)
    return _values(W.context_from_base(blocks.drop("crop", "label"), patches, 8))


@query(f"""WITH {DECODED} SELECT count(*) AS total, count_if(a = 0)::BIGINT AS transparent, count_if(a > 0 AND class_id = 0)::BIGINT AS unmatched, count_if(a > 0 AND class_id > 0)::BIGINT AS labelled,
count_if(a > 0 AND class_id > 0) / greatest(count_if(a > 0), 1) AS labelled_share FROM dec""", "rgba", "legend_rows")
def a6_decode_totals(rgba, rows):
    return L.decode_totals(L.decode_colours(rgba, L.legend(rows)))


@query("""WITH p AS (SELECT crop, tile % 10 * 4 + y AS gy, tile % 5 * 4 + x AS gx, dn FROM pixels WHERE y < 6 AND x < 7), i AS (SELECT DISTINCT crop FROM pixels)
SELECT i.crop, gy, gx, round(coalesce(v, 0), 6) AS v FROM i CROSS JOIN (SELECT unnest(range(48)) AS gy) CROSS JOIN (SELECT unnest(range(30)) AS gx) LEFT JOIN (SELECT crop, gy, gx, avg(dn) AS v FROM p GROUP BY ALL) q USING (crop, gy, gx)""", "pixels")
def a13_stitch_canvas(pixels):
    """Tiles of which 6 x 7 pixels are valid, on canvases of 48 x 30."""
    valid = [F.lit(6).alias("valid_height"), F.lit(7).alias("valid_width")]
    placed = pixels.select("crop", (F.col("tile") % 10 * 4).alias("row"), (F.col("tile") % 5 * 4).alias("col"), "y", "x", F.col("dn").alias("v"), *valid)
    canvas = pixels.select("crop").distinct().select("crop", F.lit(48).alias("height"), F.lit(30).alias("width"))
    return L.stitch_tiles(placed, "crop", canvas).withColumn("v", F.round("v", 6))


@query("SELECT tile, y // 2 AS block_y, x // 2 AS block_x, CAST(dn AS DOUBLE) AS dn, 2 AS factor FROM pixels WHERE y % 2 = 1 AND x % 2 = 1 UNION ALL SELECT tile, y // 4, x // 4, CAST(dn AS DOUBLE), 4 FROM pixels WHERE y % 4 = 2 AND x % 4 = 2", "pixels")
def a12_nearest_pyramid(pixels):
    return L.build_pyramid(pixels, "tile", (2, 4), categorical=True)


@query(f"""SELECT image_id, printf('%s_context_o%04d_r%04d_c%04d_y%07d_x%07d.npy', image_id, 128, "row", col, top, "left") AS cache, printf('%s_context_r%04d_c%04d_y%07d_x%07d.npy', image_id, "row", col, top, "left") AS context,
printf('%s_context_base_c%04d_o%04d.npy', image_id, 200, 128) AS base, printf('example_%02d_%s_r%04d_c%04d_y%07d_x%07d.png', col % 100, image_id, "row", col, top, "left") AS preview, 'p/' || image_id || '.npy' AS relative, printf('%s_%d_%d', image_id, col, "row") AS gallery FROM {GRID}""", "catalog")
def p7_other_names(catalog):
    at = [F.col(c) for c in ("image_id", "row", "col", "top", "left")]
    stem, rest = at[0], at[1:]
    return T.padded_grid(catalog, 96, 64).select(
        "image_id", T.context_name(*at, output=F.lit(128)).alias("cache"), T.context_name(*at).alias("context"), T.context_base_name(stem, F.lit(200), F.lit(128)).alias("base"),
        T.preview_name(stem, F.col("col") % 100, *rest).alias("preview"), T.relative_path(F.concat(F.lit("/data/set/p/"), stem, F.lit(".npy")), "/data/set/").alias("relative"), T.gallery_id(stem, at[1], at[2]).alias("gallery"),
    )


@query(f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY "row", col) - 1 AS i, count(*) OVER (PARTITION BY image_id) AS n FROM {GRID}), k AS (SELECT * FROM g WHERE n <= 3 OR list_contains([round_even(k * (n - 1) / 2.0::DOUBLE, 0) FOR k IN range(3)], i))
SELECT image_id AS source_image, printf('previews/example_%02d_%s_r%04d_c%04d_y%07d_x%07d.png', row_number() OVER (PARTITION BY image_id ORDER BY "row", col) - 1, image_id, "row", col, top, "left") AS preview_path,
CAST(row_number() OVER (PARTITION BY image_id ORDER BY "row", col) - 1 AS INTEGER) AS example_index, "row", col, least(96, height - top) AS valid_height, height AS image_height, 22 AS n_columns FROM k""", "catalog")
def s10_preview_manifest(catalog):
    """Three tiles of each image, spread evenly."""
    manifest = p8_build_manifest(catalog)
    picked = T.even_subsample(manifest.select("source_image", "row", "col"), "source_image", ["row", "col"], 3)
    picks = picked.withColumn("example_index", (F.row_number().over(Window.partitionBy("source_image").orderBy("row", "col")) - 1).cast("int"))
    rows = manifests.preview_manifest(manifest, picks)
    return rows.select("source_image", "preview_path", "example_index", "row", "col", "valid_height", "image_height", F.lit(len(rows.columns)).alias("n_columns"))


@query(f"""SELECT image_id AS source_image, 'I' || regexp_extract(image_id, '[0-9]$') AS image, count(*) AS n FROM {GRID} GROUP BY ALL""", "catalog")
def s10_image_manifests(catalog):
    """A folder for each image name, here ten of them."""
    path, spark = scratch(catalog.sparkSession, "image-manifests"), catalog.sparkSession
    named = p8_build_manifest(catalog).withColumn("source_image", F.concat(F.lit("I"), F.regexp_extract("source_image", "[0-9]$", 0), F.lit(".npy"))).withColumn("patch_path", F.col("patch_name"))
    manifests.write_image_manifests(named, path)
    return spark.read.option("header", True).csv(path).groupBy(F.col("patch_path").alias("source_image"), "image").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(loss * n) / sum(n), 6) AS loss FROM (SELECT crop, count(*) AS n, sum(CASE WHEN label % 2 = 0 THEN abs(dn / 100 - 1) ELSE 0 END) / greatest(count_if(label % 2 = 0), 1) AS loss FROM pixels GROUP BY crop)", "pixels")
def a18_set_loss(pixels):
    rows = pixels.select("crop", (F.col("dn") / 100).alias("recon"), F.lit(1.0).alias("target"), (F.col("label") % 2 == 0).alias("mask"))
    sizes = pixels.groupBy("crop").agg(F.count(F.lit(1)).alias("n"))
    return M.weighted_loss(M.masked_loss(rows, "crop").join(sizes, "crop")).select(F.round("loss", 6).alias("loss"))


@query("""WITH v AS (SELECT vec_id, batch % 3 AS lev, logits, list_transform(logits, lambda x: x * 0.5 + 1) AS other FROM logits), d AS (SELECT lev, avg(s / 64) AS distance FROM (SELECT lev, list_sum(list_transform(range(1, 65), lambda i: (logits[i] / la - other[i] / lb) ** 2)) AS s
FROM (SELECT *, sqrt(list_sum(list_transform(logits, lambda x: x * x))) AS la, sqrt(list_sum(list_transform(other, lambda x: x * x))) AS lb FROM v) WHERE lev < 2) GROUP BY lev)
SELECT lev, round(distance, 9) AS distance FROM d UNION ALL SELECT NULL, round(sum(distance * CASE lev WHEN 0 THEN 0.25 ELSE 2.0 END), 9) FROM d""", "logits")
def a24_weighted_distance(logits):
    """Two of three levels, vectors of unit length, weights 0.25 and 2."""
    a = logits.select("vec_id", (F.col("batch") % 3).alias("lev"), F.col("logits").alias("f"))
    b = a.withColumn("f", F.transform("f", lambda x: x * 0.5 + 1))
    return M.weighted_feature_distance(a, b, "vec_id", "lev", {0: 0.25, 1: 2.0}, True).withColumn("distance", F.round("distance", 9))


@query("SELECT crop_id, y, x, ('0x' || substr(md5(concat('b:', crop_id, ':', (y // 4) * 2 + x // 4)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 AS masked FROM crops, (SELECT unnest(range(8))::INTEGER AS y), (SELECT unnest(range(8))::INTEGER AS x)", "crops")
def f8_mask_pixels(crops):
    return S.mask_pixels(S.random_mask(crops, "crop_id", 8, 4, 0.5, "b"), 8, 4).select("crop_id", "y", "x", "masked")


@query("SELECT tile, y, x, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((dn / 100.0::DOUBLE - 1.2) + 1) / 2)) AS shown FROM pixels", "pixels")
def f5_display(pixels):
    return pixels.select("tile", "y", "x", Q.display(F.col("dn") / 100.0 - 1.2).alias("shown"))


@query("""SELECT box_id, CAST(floor((lon0 * m - 25000 + 3000000) / 500) AS BIGINT) AS col, CAST(floor((1000000 - (lat0 * m + 25000)) / 500) AS BIGINT) AS "row", CAST(ceil((lon0 * m + 25000 + 3000000) / 500) - floor((lon0 * m - 25000 + 3000000) / 500) AS BIGINT) AS w,
CAST(ceil((1000000 - (lat0 * m - 25000)) / 500) - floor((1000000 - (lat0 * m + 25000)) / 500) AS BIGINT) AS h FROM boxes, (SELECT 3396190.0::DOUBLE * pi() / 180 AS m)""", "boxes")
def p15_snap_centre(boxes):
    points = boxes.select("box_id", F.col("lon0").alias("lon"), F.col("lat0").alias("lat"))
    return L.snap_centre(points, 100, 3396190.0, -3000000.0, 1000000.0, 500.0).select("box_id", "col", "row", "w", "h")


@query("""SELECT CAST(floor((min("left") - 3) / 0.7) AS BIGINT) AS col, CAST(floor((500 - max(top)) / 0.7) AS BIGINT) AS "row", CAST(ceil((max("right") - 3) / 0.7) - floor((min("left") - 3) / 0.7) AS BIGINT) AS w, CAST(ceil((500 - min(bottom)) / 0.7) - floor((500 - max(top)) / 0.7) AS BIGINT) AS h FROM tiles""", "tiles")
def p15_full_extent(tiles):
    return L.full_extent(tiles, 3.0, 500.0, 0.7).select("col", "row", "w", "h")


@query("""WITH s AS (SELECT tile, y, x, sum(sum(dn)) OVER (PARTITION BY tile ORDER BY y ROWS UNBOUNDED PRECEDING) AS z FROM pixels GROUP BY tile, y, x), w AS (SELECT * FROM (VALUES (0, 0, 8, 8), (1, 2, 4, 7), (3, 0, 4, 1), (5, 5, 5, 8)) t(y0, x0, y1, x1))
SELECT t.tile, y0, x0, y1, x1, CAST(coalesce(sum(dn), 0) AS BIGINT) AS total FROM (SELECT DISTINCT tile FROM pixels) t CROSS JOIN w LEFT JOIN pixels p ON p.tile = t.tile AND p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1 GROUP BY ALL""", "pixels")
def w11_window_sum(pixels):
    """Four windows of each tile, one of them empty."""
    box = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("y0", "x0", "y1", "x1"), b, strict=True)]) for b in ((0, 0, 8, 8), (1, 2, 4, 7), (3, 0, 4, 1), (5, 5, 5, 8))])
    windows = pixels.select("tile").distinct().select("tile", F.explode(box).alias("b")).select("tile", "b.*")
    return Q.window_sum(Q.integral_image(pixels, "tile", "dn"), windows, "tile").select("tile", "y0", "x0", "y1", "x1", F.col("total").cast("long").alias("total"))


@query(f'SELECT 0::BIGINT AS out_of_order, count(*) AS n FROM {GRID}', "catalog")
def t6_order_kept(catalog):
    return T.follows_scan_order(T.scan_order(T.padded_grid(catalog, 96, 64)))


@query("SELECT path, row_number() OVER (ORDER BY path) - 1 AS place FROM files ORDER BY path LIMIT 20000 OFFSET 37", "files")
def t1_ranked_slice(files):
    """A slice that is too long for one task's least paths."""
    return T.with_index(T.batch_slice(files, 37, 20_000), "path", "at").select("path", (F.col("at") + 37).alias("place"))


LINES = """ax AS (SELECT o, greatest((o + 0.5::DOUBLE) * 8 / 5 - 0.5, 0) AS mid FROM (SELECT unnest(range(5)) AS o)), wg AS (SELECT o, CAST(floor(mid) AS BIGINT) AS s, 1 - (mid - floor(mid)) AS k FROM ax UNION ALL SELECT o, least(CAST(floor(mid) AS BIGINT) + 1, 7), mid - floor(mid) FROM ax)"""


@query(f"WITH {LINES} SELECT tile, a.o * 5 + b.o AS i, round(sum(a.k * b.k * dn), 3) AS v FROM pixels JOIN wg a ON y = a.s JOIN wg b ON x = b.s GROUP BY ALL", "pixels", of=("blocks",))
def r2_resize_uneven(blocks):
    """8 x 8 pixels to 5 x 5."""
    tiles = blocks.select("image_id", F.lit(0).cast("long").alias("window_id"), "h", "w", "channels", "dtype", "pixels")
    return _values(W.resize_tiles(tiles, 5, 5)).withColumn("v", F.round("v", 3))


def _warp_sql(weight):
    axis = f"SELECT o, s, {weight} AS k, CAST(floor(c) = s AS INTEGER) AS near FROM (SELECT o, s, (o + 0.5::DOUBLE) * 1.37 AS c FROM (SELECT unnest(range(5)) AS o), (SELECT unnest(range(8)) AS s))"
    return f"""WITH wg AS ({axis}) SELECT tile, a.o * 5 + b.o AS i, CAST(CASE WHEN {{there}} AND sum(a.k * b.k) FILTER (dn <> 0) > 1e-9 THEN least(255, greatest(0, round_even(sum(a.k * b.k * dn) / sum(a.k * b.k) FILTER (dn <> 0), 0))) ELSE 0 END AS DOUBLE) AS v
    FROM pixels JOIN wg a ON y = a.s JOIN wg b ON x = b.s GROUP BY ALL"""


NEAR = "coalesce(max(a.near * b.near) FILTER (dn <> 0), 0) > 0"
BILINEAR = _warp_sql("greatest(0, 1 - abs(s + 0.5::DOUBLE - c) / 1.37)").replace("{there}", NEAR)
AVERAGE = _warp_sql("greatest(0, least(s + 1, c + 0.685) - greatest(s, c - 0.685))").replace("{there}", "true")
CUBIC = _warp_sql("CASE WHEN abs(s + 0.5::DOUBLE - c) / 1.37 < 1 THEN 1.5 * (abs(s + 0.5::DOUBLE - c) / 1.37) ** 3 - 2.5 * (abs(s + 0.5::DOUBLE - c) / 1.37) ** 2 + 1 WHEN abs(s + 0.5::DOUBLE - c) / 1.37 < 2 THEN -0.5 * (abs(s + 0.5::DOUBLE - c) / 1.37) ** 3 + 2.5 * (abs(s + 0.5::DOUBLE - c) / 1.37) ** 2 - 4 * (abs(s + 0.5::DOUBLE - c) / 1.37) + 2 ELSE 0 END").replace("{there}", NEAR)


def _warped(blocks, how):
    """8 x 8 pixels to 5 x 5 that are 1.37 times as wide."""
    source = {"left": 0.0, "top": 0.0, "xres": 1.0, "yres": 1.0, "height": 8, "width": 8}
    size = [F.lit(n).cast("long").alias(c) for c, n in (("window_id", 0), ("row", 0), ("col", 0), ("h", 5), ("w", 5))]
    return _values(W.warp_to_grid(blocks, blocks.select("image_id", *size), source, {"left": 0.0, "top": 0.0, "xres": 1.37, "yres": 1.37}, 8, how))


@query(BILINEAR, "pixels", of=("blocks",))
def r3_warp_bilinear(blocks):
    return _warped(blocks, "bilinear")


@query(AVERAGE, "pixels", of=("blocks",))
def r3_warp_average(blocks):
    return _warped(blocks, "average")


@query(CUBIC, "pixels", of=("blocks",))
def r3_warp_cubic(blocks):
    return _warped(blocks, "cubic")


@query(f"""WITH wt AS {WEIGHTS}, a AS (SELECT t.tile, t.y, t.x, sum(k * p.dn) AS g FROM (SELECT tile, y, x, k, CASE WHEN y + o < 0 THEN -(y + o) - 1 WHEN y + o > 7 THEN 15 - y - o ELSE y + o END AS ny FROM pixels, wt) t JOIN pixels p ON p.tile = t.tile AND p.y = ny AND p.x = t.x GROUP BY ALL)
SELECT t.tile, t.y * 8 + t.x AS i, round(sum(k * a.g), 4) AS v FROM (SELECT tile, y, x, k, CASE WHEN x + o < 0 THEN -(x + o) - 1 WHEN x + o > 7 THEN 15 - x - o ELSE x + o END AS nx FROM pixels, wt) t JOIN a ON a.tile = t.tile AND a.x = nx AND a.y = t.y GROUP BY ALL""", "pixels", of=("blocks",))
def r4_gaussian_smooth(blocks):
    tiles = blocks.select("image_id", F.lit(0).cast("long").alias("window_id"), "h", "w", "channels", "dtype", "pixels")
    return _values(W.gaussian_smooth(tiles, 1.0)).withColumn("v", F.round("v", 4))


PHASE = """pr AS (SELECT a.tile, a.y, a.x, a.dn AS r, b.dn AS m FROM pixels a JOIN pixels b ON b.tile = a.tile + 1 AND b.y = a.y AND b.x = a.x WHERE a.tile % 2 = 0),
cn AS (SELECT tile, y, x, (0.5 - 0.5 * cos(2 * pi() * y / 7)) * (0.5 - 0.5 * cos(2 * pi() * x / 7)) * (r - avg(r) OVER (PARTITION BY tile)) AS r, (0.5 - 0.5 * cos(2 * pi() * y / 7)) * (0.5 - 0.5 * cos(2 * pi() * x / 7)) * (m - avg(m) OVER (PARTITION BY tile)) AS m FROM pr),
fq AS (SELECT tile, u, v, sum(r * cos(2 * pi() * (u * y + v * x) / 8)) AS rr, -sum(r * sin(2 * pi() * (u * y + v * x) / 8)) AS ri, sum(m * cos(2 * pi() * (u * y + v * x) / 8)) AS mr, -sum(m * sin(2 * pi() * (u * y + v * x) / 8)) AS mi FROM cn, (SELECT unnest(range(8)) AS u), (SELECT unnest(range(8)) AS v) GROUP BY ALL),
cp AS (SELECT u, v, rr * mr + ri * mi AS re, ri * mr - rr * mi AS im FROM fq), sm AS (SELECT u, v, avg(re / (sqrt(re * re + im * im) + 1e-8)) AS re, avg(im / (sqrt(re * re + im * im) + 1e-8)) AS im FROM cp GROUP BY u, v),
sf AS (SELECT dy, dx, sum(re * cos(2 * pi() * (u * dy + v * dx) / 8) - im * sin(2 * pi() * (u * dy + v * dx) / 8)) / 64 AS value FROM sm, (SELECT unnest(range(-4, 4)) AS dy), (SELECT unnest(range(-4, 4)) AS dx) GROUP BY dy, dx)"""


def _stack(pixels):
    tiles = pixels.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "dn"))), lambda s: s["dn"].cast("double")).alias("v"))
    ref = tiles.filter("tile % 2 = 0").select("tile", F.col("v").alias("ref"))
    return W.stacked_surface(ref.join(tiles.select((F.col("tile") - 1).alias("tile"), F.col("v").alias("mov")), "tile"), 8, 8)


@query(f"WITH {PHASE} SELECT dy, dx, round(value, 6) AS value, (SELECT count(DISTINCT tile) FROM pr) AS n FROM sf", "pixels")
def r5_stacked_surface(pixels):
    """Phase correlation of each even tile with the next one, summed over all."""
    return _stack(pixels).withColumn("value", F.round("value", 6))


@query(f"""WITH {PHASE}, nr AS (SELECT * FROM sf WHERE abs(dy) <= 2 AND abs(dx) <= 2), bt AS (SELECT dy AS py, dx AS px, value AS t FROM nr ORDER BY value DESC, dy, dx LIMIT 1),
nb AS (SELECT max(value) FILTER (dy = py - 1 AND dx = px) AS u, max(value) FILTER (dy = py + 1 AND dx = px) AS d, max(value) FILTER (dx = px - 1 AND dy = py) AS l, max(value) FILTER (dx = px + 1 AND dy = py) AS r FROM sf, bt)
SELECT round(py + (u - d) / (2 * (u + d - 2 * t)), 5) AS dy, round(px + (l - r) / (2 * (l + r - 2 * t)), 5) AS dx, round((t - (SELECT avg(value) FROM nr)) / ((SELECT stddev_pop(value) FROM nr) + 1e-12), 4) AS snr, (SELECT count(DISTINCT tile) FROM pr) AS n FROM bt, nb""", "pixels")
def r5_coherent_stack(pixels):
    found = R.refined_peak(_stack(pixels), "value", 2)
    return found.select(F.round("dy", 5).alias("dy"), F.round("dx", 5).alias("dx"), F.round("snr", 4).alias("snr"), "n")


MEANS = """m AS (SELECT target, d, avg(logits[d + 1]) AS mu FROM logits, (SELECT unnest(range(64)) AS d) GROUP BY target, d), c AS (SELECT l.vec_id, l.target, m.d, l.logits[m.d + 1] - m.mu AS x FROM logits l JOIN m ON m.target = l.target)"""


@query(f"WITH {MEANS} SELECT target, 64 AS n_dims, 0.0::DOUBLE AS residual, round(any_value(total), 6) AS norm FROM (SELECT target, sum(mu) OVER (PARTITION BY target) AS total FROM m) GROUP BY target", "logits")
def a21_class_precisions(logits):
    """The precision times the pooled covariance is the unit matrix; means add up."""
    fitted = fit_class_gaussians(logits, "target", "logits")
    moments = class_moments(logits, "target", "logits")
    pooled = moments.select(F.posexplode("scatter").alias("at", "v"), "n").groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    cov = pooled.select(F.floor(F.col("at") / 64).alias("k"), (F.col("at") % 64).alias("j"), (F.col("v") / (F.col("n") - 1) + F.when(F.col("at") % 65 == 0, 1e-6).otherwise(0.0)).alias("s"))
    p = fitted.select("target", F.posexplode("precision").alias("at", "p")).select("target", F.floor(F.col("at") / 64).alias("i"), (F.col("at") % 64).alias("k"), "p")
    unit = p.join(cov, "k").groupBy("target", "i", "j").agg(F.sum(F.col("p") * F.col("s")).alias("u"))
    gap = unit.groupBy("target").agg(F.sqrt(F.count(F.lit(1))).cast("int").alias("n_dims"), F.round(F.max(F.abs(F.col("u") - (F.col("i") == F.col("j")).cast("double"))), 5).alias("residual"))
    total = fitted.select("target", F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6).alias("norm"))
    return gap.join(total, "target")


@query(f"""WITH {MEANS}, q AS (SELECT a.target, a.d, b.d AS e, sum(a.x * b.x) / greatest(1, count(*) - 1) AS v FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.target = b.target GROUP BY ALL)
SELECT target, round(sum(v) FILTER (d = e), 4) AS total, round(sum(v * v), 2) AS squares, 0.0::DOUBLE AS off_unit FROM q GROUP BY target""", "logits")
def a23_component_totals(logits):
    """All components of a class: their variances add up to the total variance,
    their squares to those of the covariances, and directions have length 1."""
    pca = fit_class_pca(logits, "target", "logits", 64)
    length = F.sqrt(F.aggregate("direction", F.lit(0.0), lambda a, x: a + x * x))
    return pca.groupBy("target").agg(
        F.round(F.sum("eigenvalue"), 4).alias("total"), F.round(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), 2).alias("squares"), F.round(F.max(F.abs(length - 1)), 6).alias("off_unit")
    )


@query(f"WITH {MEANS} SELECT vec_id, target, round(sum(x * x), 4) AS squares FROM c WHERE target <> 255 GROUP BY ALL", "logits")
def f13_projection_lengths(logits):
    """Scores on all directions, freed of their scale: a row's squared distance
    from its class mean."""
    known = logits.filter("target <> 255")
    pca = stored(fit_class_pca(known, "target", "logits", 64), "components")
    scale = pca.select("target", "component", F.aggregate("direction", F.lit(0.0), lambda a, x: a + x).alias("scale"))
    scores = project_components(known, pca, "target", "logits").join(scale, ["target", "component"])
    part = F.col("score") / F.col("scale")
    return scores.groupBy("vec_id", "target").agg(F.round(F.sum(part * part), 4).alias("squares"))


@query(f"""WITH {MEANS}, z AS (SELECT l.vec_id, m.target AS k, sqrt(sum((l.logits[m.d + 1] - mu) ** 2 / (m.d + 1)) + 0.01 * sum(l.logits[m.d + 1] - mu) ** 2) AS dist FROM logits l, m GROUP BY ALL)
SELECT vec_id, round(min(dist), 6) AS score, round(least(1, min(dist) / 5.0), 6) AS unit, round(least(1, min(dist)), 6) AS without FROM z GROUP BY vec_id""", "logits")
def f12_given_precision(logits):
    """Distances to class means under a known precision: raw, over a reference of 5,
    and with none."""
    moments = class_moments(logits, "target", "logits")
    at = F.sequence(F.lit(0), F.lit(64 * 64 - 1))
    known = F.transform(at, lambda i: F.when(i % 65 == 0, 1 / (F.floor(i / 64) + 1)).otherwise(0.0) + 0.01)
    stats = moments.select("target", "mean", known.alias("precision"))
    raw = mahalanobis_score(logits, stats, "logits").withColumnRenamed("score", "raw")
    unit = mahalanobis_score(raw, stats, "logits", 5.0, True).withColumnRenamed("score", "unit")
    return mahalanobis_score(unit, stats, "logits", None, True).select("vec_id", F.round("raw", 6).alias("score"), F.round("unit", 6).alias("unit"), F.round("score", 6).alias("without"))


# Block forms: images of 64 x 64 pixels in blocks of 8, pixels only for the comparison.


def _pixels(blocks: DataFrame, column: str = "pixels", kind: str | None = None) -> DataFrame:
    """image_id, y, x, v (first channel) and v2 (the last) of block tables."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for r in b.itertuples(index=False):
                a = np.frombuffer(r.raw, np.dtype(r.dtype)).reshape(r.h, r.w, -1).astype(float)
                y, x = np.mgrid[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]
                yield pd.DataFrame({"image_id": r.image_id, "y": y.ravel(), "x": x.ravel(), "v": a[:, :, 0].ravel(), "v2": a[:, :, -1].ravel()})

    image = dict(blocks.dtypes)["image_id"]
    raw = blocks.select("image_id", "y0", "x0", "h", "w", F.lit(kind).alias("dtype") if kind else F.col("dtype"), F.col(column).alias("raw"))
    return raw.mapInPandas(run, f"image_id {image}, y long, x long, v double, v2 double")


MOSAIC_EDGES = """SELECT image_id, y, x, CASE WHEN c > 0 AND (coalesce(lead(c) OVER (PARTITION BY image_id, y ORDER BY x) <> c, false) OR coalesce(lead(c) OVER (PARTITION BY image_id, x ORDER BY y) <> c, false)) THEN 1 ELSE 0 END AS edge FROM (SELECT image_id, y, x, dn // 52 AS c FROM mosaic)"""


@query(MOSAIC_EDGES, "mosaic", of=("mosaic_blocks",))
def w10_edge_blocks(blocks):
    return _pixels(B.label_edge_blocks(_classes(blocks), 8)).select("image_id", "y", "x", F.col("v").cast("int").alias("edge"))


@query("SELECT i.image_id, i.y, i.x, i.dn, coalesce(l.dn // 52, 0) AS label FROM mosaic i LEFT JOIN mosaic l ON l.image_id = i.image_id AND l.y = i.y + 3 AND l.x = i.x - 5", "mosaic", of=("mosaic_blocks",))
def j2_pair_blocks(blocks):
    paired = B.pair_blocks(blocks, _classes(blocks), 8, 3, -5)
    label = _pixels(paired, "label_pixels", "int64").select("image_id", "y", "x", F.col("v").cast("long").alias("label"))
    return _pixels(paired).select("image_id", "y", "x", F.col("v").cast("long").alias("dn")).join(label, ["image_id", "y", "x"])


@query("SELECT image_id, y, x, CAST(sum(d) OVER (PARTITION BY image_id, y ORDER BY x) AS BIGINT) AS total FROM (SELECT *, sum(dn) OVER (PARTITION BY image_id, x ORDER BY y) AS d FROM mosaic)", "mosaic", of=("mosaic_blocks",))
def w11_integral_blocks(blocks):
    return _pixels(B.integral_blocks(blocks, 8)).select("image_id", "y", "x", F.col("v").cast("long").alias("total"))


@query("""WITH w AS (SELECT * FROM (VALUES (0, 0, 32, 64), (1, 2, 24, 37), (3, 0, 4, 1), (5, 5, 5, 8), (9, 17, 31, 18)) t(y0, x0, y1, x1))
SELECT i.image_id, y0, x0, y1, x1, CAST(coalesce(sum(dn), 0) AS BIGINT) AS total FROM (SELECT DISTINCT image_id FROM mosaic WHERE y = 63) i CROSS JOIN w LEFT JOIN mosaic p ON p.image_id = i.image_id AND p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1 GROUP BY ALL""", "mosaic", of=("mosaic_blocks",))
def w11_window_blocks(blocks):
    """Windows over several blocks of each whole image, one of them empty."""
    boxes = ((0, 0, 32, 64), (1, 2, 24, 37), (3, 0, 4, 1), (5, 5, 5, 8), (9, 17, 31, 18))
    box = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("y0", "x0", "y1", "x1"), b, strict=True)]) for b in boxes])
    windows = blocks.filter("y0 = 56").select("image_id").distinct().select("image_id", F.explode(box).alias("b")).select("image_id", "b.*")
    return B.window_sums(B.integral_blocks(blocks, 8), windows, 8)


def _tiles_at(blocks: DataFrame, row, col) -> DataFrame:
    own = blocks.select(F.col("image_id").alias("tile"), F.col("crop").alias("image_id"), "h", "w", "channels", "dtype", "pixels")
    return own.withColumn("row", row.cast("long")).withColumn("col", col.cast("long"))


@query("SELECT crop AS image_id, tile % 10 * 4 + y AS y, tile % 5 * 4 + x AS x, round(avg(dn), 6) AS v, count(*) AS n FROM pixels GROUP BY ALL", "pixels", of=("blocks",))
def a13_stitch_blocks(blocks):
    """Tiles that overlap by half, in blocks of 6 pixels that they straddle."""
    tiles = _tiles_at(blocks, F.col("tile") % 10 * 4, F.col("tile") % 5 * 4)
    out = _pixels(B.stitch_blocks(tiles, 6)).filter("v2 > 0")
    return out.select("image_id", "y", "x", F.round("v", 6).alias("v"), F.col("v2").cast("long").alias("n"))


@query("""WITH p AS (SELECT crop AS image_id, tile % 10 * 4 + y AS y, tile % 5 * 4 + x AS x, dn FROM pixels WHERE y < 6 AND x < 7), i AS (SELECT DISTINCT crop AS image_id FROM pixels)
SELECT i.image_id, y, x, round(coalesce(v, 0), 6) AS v FROM i CROSS JOIN (SELECT unnest(range(40)) AS y) CROSS JOIN (SELECT unnest(range(21)) AS x) LEFT JOIN (SELECT image_id, y, x, avg(dn) AS v FROM p GROUP BY ALL) q USING (image_id, y, x)""", "pixels", of=("blocks",))
def a13_canvas_blocks(blocks):
    """Tiles of which 6 x 7 pixels are valid, on canvases of 40 x 21 that some reach beyond."""
    tiles = _tiles_at(blocks, F.col("tile") % 10 * 4, F.col("tile") % 5 * 4).withColumn("valid_height", F.lit(6)).withColumn("valid_width", F.lit(7))
    canvas = blocks.select(F.col("crop").alias("image_id")).distinct().withColumn("height", F.lit(40)).withColumn("width", F.lit(21))
    return _pixels(B.stitch_blocks(tiles, 16, canvas)).select("image_id", "y", "x", F.round("v", 6).alias("v"))


@query("""WITH p AS (SELECT crop % 3 AS image_id, tile, crop % 40 * 5 + y AS y, tile % 10 * 3 + x AS x, dn FROM pixels), b AS (SELECT DISTINCT image_id, y // 16 AS cy, x // 16 AS cx FROM p)
SELECT b.image_id, cy * 16 + dy AS y, cx * 16 + dx AS x, coalesce(dn, 0) AS dn FROM b CROSS JOIN (SELECT unnest(range(16)) AS dy) CROSS JOIN (SELECT unnest(range(16)) AS dx) LEFT JOIN (SELECT image_id, y, x, coalesce(arg_max(dn, tile) FILTER (dn <> 0), 0) AS dn FROM p GROUP BY ALL) q ON q.image_id = b.image_id AND q.y = cy * 16 + dy AND q.x = cx * 16 + dx""", "pixels", of=("blocks",))
def a10_composite_blocks(blocks):
    """Three mosaics on which very many tiles lie over each other."""
    tiles = _tiles_at(blocks, F.col("image_id") % 40 * 5, F.col("tile") % 10 * 3).withColumn("image_id", F.col("image_id") % 3)
    return _pixels(B.composite_blocks(tiles, 16)).select("image_id", "y", "x", F.col("v").cast("long").alias("dn"))


@query("SELECT image_id, y // 3 AS y, x // 3 AS x, round(sum(dn * wy * wx) / sum(wy * wx), 6) AS v FROM (SELECT *, CASE WHEN y = 63 THEN 3 ELSE 1 END AS wy, CASE WHEN x = 63 THEN 3 ELSE 1 END AS wx FROM mosaic) GROUP BY ALL", "mosaic", of=("mosaic_blocks",))
def a11_downsample_blocks(blocks):
    """Cells of three pixels that straddle blocks of eight."""
    return _pixels(B.downsample_blocks(blocks, 8, 3)).filter("v IS NOT NULL").select("image_id", "y", "x", F.round("v", 6).alias("v"))


@query("SELECT image_id, y // f AS y, x // f AS x, round(avg(dn), 6) AS v, f AS factor FROM mosaic, (SELECT unnest([2, 4, 8]) AS f) GROUP BY ALL", "mosaic", of=("mosaic_blocks",))
def a12_pyramid_blocks(blocks):
    levels = B.pyramid_blocks(blocks, 8)
    rows = [_pixels(levels.filter(F.col("factor") == f)).withColumn("factor", F.lit(f)) for f in (2, 4, 8)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).filter("v IS NOT NULL").select("image_id", "y", "x", F.round("v", 6).alias("v"), "factor")


@query("SELECT image_id, y // f AS y, x // f AS x, CAST(dn AS DOUBLE) AS v, f AS factor FROM mosaic, (SELECT unnest([2, 4, 8]) AS f) WHERE y % f = f // 2 AND x % f = f // 2", "mosaic", of=("mosaic_blocks",))
def a12_nearest_blocks(blocks):
    levels = B.pyramid_blocks(blocks, 8, categorical=True)
    rows = [_pixels(levels.filter(F.col("factor") == f)).withColumn("factor", F.lit(f)) for f in (2, 4, 8)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).filter("v IS NOT NULL").select("image_id", "y", "x", "v", "factor")


DECODED_BLOCKS = DECODED.replace("rgba", "rgba_pixels").replace("d > 1600", "d > 9000").replace("SELECT x, y,", "SELECT image_id, x, y,")


@query(f"WITH {DECODED_BLOCKS} SELECT image_id, y, x, class_id FROM dec", "rgba_pixels", "legend_rows", of=("rgba_blocks", "legend_rows"))
def j3_decode_blocks(blocks, rows):
    return _pixels(B.decode_blocks(blocks, L.legend(rows), 9000)).select("image_id", "y", "x", F.col("v").cast("long").alias("class_id"))


@query(f"WITH {DECODED_BLOCKS}, h AS (SELECT class_id AS c, count(*) AS k FROM dec GROUP BY 1) SELECT class_id, coalesce(k, 0) AS n, coalesce(k, 0) / (SELECT count(*) FROM dec) AS share FROM (SELECT class_id FROM leg UNION ALL SELECT 0) LEFT JOIN h ON class_id = c", "rgba_pixels", "legend_rows", of=("rgba_blocks", "legend_rows"))
def a6_block_histogram(blocks, rows):
    return B.block_histogram(blocks, L.legend(rows), 9000)
