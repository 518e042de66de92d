"""Windows cut from block tables and kernels on them.

A block row holds image_id, y0, x0, h, w, channels, dtype, pixels (row-major
bytes); blocks lie on a grid of ``block`` pixels, ragged at the far edges.  A tile
row holds image_id, window_id, h, w, channels, dtype, pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exchange import as_array, mapped, placed

WINDOW = ["image_id", "window_id", "top", "left", "height", "width", "image_height", "image_width"]


def _array(row) -> np.ndarray:
    return np.frombuffer(row["pixels"], np.dtype(row["dtype"])).reshape(int(row["h"]), int(row["w"]), int(row["channels"]))


def _fields(a: np.ndarray) -> dict:
    return {"h": a.shape[0], "w": a.shape[1], "channels": a.shape[2], "dtype": a.dtype.name, "pixels": np.ascontiguousarray(a).tobytes()}


def _tile_schema(df: DataFrame) -> str:
    kinds = dict(df.dtypes)
    return f"image_id {kinds['image_id']}, window_id {kinds['window_id']}, h int, w int, channels int, dtype string, pixels binary"


def mean_shrunk(a: np.ndarray, factor: int) -> np.ndarray:
    """Means of factor x factor cells; ragged edges repeat the last pixels."""
    if factor <= 1:
        return a
    a = np.pad(a, ((0, -a.shape[0] % factor), (0, -a.shape[1] % factor), (0, 0)), mode="edge").astype(np.float32)
    h, w, c = a.shape
    return a.reshape(h // factor, factor, w // factor, factor, c).mean(axis=(1, 3))


def extract_windows(blocks: DataFrame, windows: DataFrame, block: int, pad_mode: str = "edge", pad_value: float = 0.0, shrink: int = 1) -> DataFrame:
    """One tile per row of ``windows`` (the columns WINDOW), padded where it
    reaches beyond its image by ``edge``, ``constant`` or ``symmetric``.

    A window meets the blocks of its cells in an equi-join, and only its own
    blocks come together in a task.  Missing blocks hold ``pad_value``; a window
    wholly outside its image is one channel of ``pad_value``.
    """

    def cells(at: str, n: str, full: str) -> Column:
        first, last = F.greatest(F.col(at), F.lit(0)), F.least(F.col(at) + F.col(n), F.col(full)) - 1
        return F.when(first <= last, F.sequence(F.floor(first / block), F.floor(last / block)))

    spread = windows.select(*WINDOW, F.explode_outer(cells("top", "height", "image_height")).alias("by"))
    spread = spread.select("*", F.explode_outer(cells("left", "width", "image_width")).alias("bx"))
    parts = blocks.select("image_id", F.floor(F.col("y0") / block).alias("by"), F.floor(F.col("x0") / block).alias("bx"), "y0", "x0", "h", "w", "channels", "dtype", "pixels")

    def cut(r: dict) -> np.ndarray:
        top, left, bottom, right = r["top"], r["left"], r["top"] + r["height"], r["left"] + r["width"]
        if not r["parts"]:
            return np.full((r["height"], r["width"], 1), pad_value, np.float32)
        y0, y1, x0, x1 = max(top, 0), min(bottom, r["image_height"]), max(left, 0), min(right, r["image_width"])
        out = placed(r["parts"], y0, x0, y1 - y0, x1 - x0, pad_value)
        pads = ((y0 - top, bottom - y1), (x0 - left, right - x1), (0, 0))
        return np.pad(out, pads, mode=pad_mode, **({"constant_values": pad_value} if pad_mode == "constant" else {}))

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            yield [{"image_id": r["image_id"], "window_id": r["window_id"], **_fields(mean_shrunk(cut(r), shrink))} for r in rows]

    met = spread.join(parts, ["image_id", "by", "bx"], "left")
    part = F.struct(F.col("y0").alias("y"), F.col("x0").alias("x"), "h", "w", "channels", "dtype", "pixels")
    met = met.groupBy(*WINDOW).agg(F.collect_list(F.when(F.col("pixels").isNotNull(), part)).alias("parts"))
    return mapped(met, work, _tile_schema(windows))


def context_from_base(bases: DataFrame, patches: DataFrame, block: int, pad_mode: str = "edge", pad_value: float = 0.0) -> DataFrame:
    """Contexts cut from the downsampled base of each image.  patches: image_id,
    window_id, top, left, patch_size, context_scale, context_output_size,
    base_height, base_width."""
    size = F.greatest(F.col("context_output_size"), F.lit(1)).cast("long")

    def start(at: str, full: str) -> Column:
        middle = F.rint((F.col(at) + F.floor(F.col("patch_size") / 2)) / F.greatest(F.col("context_scale"), F.lit(1.0))).cast("long")
        inside = F.least(F.greatest(middle, F.lit(0)), F.greatest(F.col(full) - 1, F.lit(0)))
        return (inside - F.floor(size / 2)).cast("long")

    windows = patches.select(
        "image_id", "window_id", start("top", "base_height").alias("top"), start("left", "base_width").alias("left"), size.alias("height"), size.alias("width"),
        F.col("base_height").alias("image_height"), F.col("base_width").alias("image_width"),
    )
    return extract_windows(bases, windows, block, pad_mode, pad_value)


def map_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``kernel`` on the H x W x C array of every tile; other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                shape = zip(batch["pixels"], batch["dtype"], batch["h"], batch["w"], batch["channels"], strict=True)
                new = [_fields(kernel(np.frombuffer(raw, np.dtype(kind)).reshape(int(h), int(w), int(c)))) for raw, kind, h, w, c in shape]
                batch = batch.assign(**{name: [f[name] for f in new] for name in new[0]})
            yield batch

    return tiles.mapInPandas(run, tiles.schema)


def resized(a: np.ndarray, h: int, w: int, mode: str = "bilinear") -> np.ndarray:
    """Bilinear with half-pixel centres and no antialiasing, or nearest."""
    if a.shape[:2] == (h, w):
        return a
    if mode == "nearest":
        return a[np.arange(h) * a.shape[0] // h][:, np.arange(w) * a.shape[1] // w]
    a = a.astype(np.float32)
    for axis, n in ((0, h), (1, w)):
        at = np.maximum((np.arange(n) + 0.5) * a.shape[axis] / n - 0.5, 0)
        low = np.minimum(at.astype(int), a.shape[axis] - 1)
        share = (at - low).astype(np.float32).reshape([-1 if i == axis else 1 for i in range(3)])
        a = np.take(a, low, axis) * (1 - share) + np.take(a, np.minimum(low + 1, a.shape[axis] - 1), axis) * share
    return a


def resize_tiles(tiles: DataFrame, h: int, w: int, mode: str = "bilinear") -> DataFrame:
    return map_tiles(tiles, lambda a: resized(a, h, w, mode))


def gradient(a: np.ndarray) -> np.ndarray:
    """Sobel magnitude; beyond the edges the pixels are mirrored."""
    p = np.pad(a.astype(np.float64), ((1, 1), (1, 1), (0, 0)), mode="symmetric")
    down = p[2:] - p[:-2]
    across = p[:, 2:] - p[:, :-2]
    gy = down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]
    gx = across[:-2] + 2 * across[1:-1] + across[2:]
    return np.hypot(gy, gx)


def smoothed(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur of radius int(4 sigma + 0.5), mirrored at the edges."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    out = a.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        p = np.pad(out, [(radius, radius) if i == axis else (0, 0) for i in range(3)], mode="symmetric")
        out = sum(k * np.take(p, range(i, i + n), axis) for i, k in enumerate(weights))
    return out


def image_gradient(tiles: DataFrame) -> DataFrame:
    return map_tiles(tiles, gradient)


def gaussian_smooth(tiles: DataFrame, sigma: float) -> DataFrame:
    return map_tiles(tiles, lambda a: smoothed(a, sigma))


@lru_cache(16)
def _axis_taps(first: int, n: int, scale: float, shift: float, source_first: int, source_n: int, how: str) -> tuple[np.ndarray, np.ndarray]:
    """n x taps places among ``source_n`` source pixels from ``source_first``, in ascending
    order, and their weights: target pixel i of an axis is centred on the source coordinate
    (first + i + 0.5) * scale + shift."""
    centre = ((np.arange(first, first + n) + 0.5) * scale + shift)[:, None]
    reach = int(2 * max(1.0, scale)) + 1
    own = np.floor(centre).astype(int) + np.arange(-reach, reach + 1)[None, :]
    if how == "nearest":
        k = (np.floor(centre) == own).astype(float)
    elif how == "average":
        half = scale / 2
        k = np.clip(np.minimum(own + 1, centre + half) - np.maximum(own, centre - half), 0, None)
    else:
        t = np.abs(own + 0.5 - centre) / max(1.0, scale)
        if how == "bilinear":
            k = np.clip(1 - t, 0, None)
        else:
            t2, t3 = (np.array([math.pow(v, e) for v in t.flat]).reshape(t.shape) for e in (2, 3))
            near, far = 1.5 * t3 - 2.5 * t2 + 1, -0.5 * t3 + 2.5 * t2 - 4 * t + 2
            k = np.where(t < 1, near, np.where(t < 2, far, 0.0))
    own = own - source_first
    k = np.where((own >= 0) & (own < source_n), k, 0.0)
    used = (k != 0).any(axis=0)
    used[0] |= not used.any()
    return np.clip(own[:, used], 0, source_n - 1), k[:, used]


#: Values of a target that are mixed at once, about.
MIXED = 1 << 16


def _mixed(a: np.ndarray, valid: np.ndarray, rows: tuple, cols: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weight * pixel and of weight over the valid pixels around each target pixel.
    They are added up one by one in the order of rows and columns, as SQL does it over such
    pixels, so that a mean midway between two whole numbers is rounded to the same one."""
    (ys, ky), (xs, kx) = _axis_taps(*rows), _axis_taps(*cols)
    total, weight = (np.zeros((len(ys), len(xs), a.shape[2])) for _ in range(2))
    step = max(1, MIXED // max(1, len(xs) * a.shape[2]))
    for at in range(0, len(ys), step):
        part = slice(at, at + step)
        for y, wy in zip(ys[part].T, ky[part].T, strict=True):
            a_y, valid_y, wy = a.take(y, 0), valid.take(y, 0), wy[:, None, None]
            for x, wx in zip(xs.T, kx.T, strict=True):
                k = wy * wx[:, None] * valid_y.take(x, 1)
                weight[part] += k
                k *= a_y.take(x, 1)
                total[part] += k
    return total, weight


def warp_to_grid(blocks: DataFrame, targets: DataFrame, source: dict, grid: dict, block: int, how: str = "cubic", nodata: float = 0) -> DataFrame:
    """Resample a mosaic onto a target grid, block by block.

    ``source`` and ``grid`` describe north-up rasters by left, top, xres, yres
    (source also width, height); targets: image_id, window_id, row, col, h, w on
    the grid.  Every target block reads its source window and a halo of the
    kernel's reach; pixels equal to ``nodata`` get no weight, and a target whose
    nearest source pixel is missing is ``nodata``.
    """
    sy, sx = grid["yres"] / source["yres"], grid["xres"] / source["xres"]
    oy, ox = (source["top"] - grid["top"]) / source["yres"], (grid["left"] - source["left"]) / source["xres"]
    halo_y, halo_x = int(2 * max(1, sy)) + 2, int(2 * max(1, sx)) + 2
    at = lambda first, s, o, halo: (F.floor(F.col(first) * s + o) - halo).cast("long")
    size = lambda n, s, halo: (F.ceil(F.col(n) * s) + 2 * halo + 1).cast("long")
    windows = targets.select(
        "image_id", "window_id", at("row", sy, oy, halo_y).alias("top"), at("col", sx, ox, halo_x).alias("left"), size("h", sy, halo_y).alias("height"),
        size("w", sx, halo_x).alias("width"), F.lit(source["height"]).alias("image_height"), F.lit(source["width"]).alias("image_width"),
    )
    cut = extract_windows(blocks, windows, block, "constant", nodata)
    known = targets.select("image_id", "window_id", F.col("row").alias("t_row"), F.col("col").alias("t_col"), F.col("h").alias("t_h"), F.col("w").alias("t_w"))

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for some in lists:
            out = []
            for r in some:
                a = as_array(r)
                rows = (r["t_row"], r["t_h"], sy, oy, int(np.floor(r["t_row"] * sy + oy)) - halo_y, a.shape[0])
                cols = (r["t_col"], r["t_w"], sx, ox, int(np.floor(r["t_col"] * sx + ox)) - halo_x, a.shape[1])
                valid = a != nodata
                total, weight = _mixed(a, valid, (*rows, how), (*cols, how))
                there = weight > 1e-9
                if how != "average":
                    there &= _mixed(a, valid, (*rows, "nearest"), (*cols, "nearest"))[1] > 0
                value = np.where(there, total / np.where(there, weight, 1), nodata)
                if a.dtype.kind in "ui":
                    value = np.clip(np.rint(value), np.iinfo(a.dtype).min, np.iinfo(a.dtype).max)
                out.append({"image_id": r["image_id"], "window_id": r["window_id"], **_fields(value.astype(a.dtype))})
            yield out

    return mapped(cut.join(known, ["image_id", "window_id"]), work, cut.schema)


def stacked_surface(pairs: DataFrame, height: int, width: int) -> DataFrame:
    """dy, dx, value, n: the phase correlation of all pairs of equal patches (ref,
    mov: row-major arrays of ``height`` x ``width``) for every shift of mov onto
    ref; no rows without pairs.

    Tasks add up cross spectra of unit magnitude; one patch-sized spectrum a task
    is shuffled, and each shift's value is a sum over frequencies, so all that is
    ever in one place is one patch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taper, total, n = np.hanning(height)[:, None] * np.hanning(width)[None], np.zeros((height, width), complex), 0
        spectrum = lambda v: np.fft.fft2(taper * (v - v.mean()))
        for batch in batches:
            for ref, mov in zip(batch["ref"], batch["mov"], strict=True):
                cross = spectrum(np.reshape(np.asarray(ref, float), (height, width))) * spectrum(np.reshape(np.asarray(mov, float), (height, width))).conj()
                total, n = total + cross / (abs(cross) + 1e-8), n + 1
        if n:
            yield pd.DataFrame({"n": n, "i": np.arange(height * width), "re": total.real.ravel(), "im": total.imag.ravel()})

    parts = pairs.select("ref", "mov").mapInPandas(run, "n long, i int, re double, im double")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("re").alias("re"), F.sum("im").alias("im"))

    def inverse(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        n = int(group["n"].iloc[0])
        surface = np.fft.ifft2((group["re"].to_numpy() + 1j * group["im"].to_numpy()).reshape(height, width) / n).real
        dy, dx = (np.fft.fftfreq(k, 1 / k).round().astype(int) for k in (height, width))
        return pd.DataFrame({"dy": np.repeat(dy, width), "dx": np.tile(dx, height), "value": surface.ravel(), "n": n})

    return rows.withColumn("patch", F.col("i") * 0).groupBy("patch").applyInPandas(inverse, "dy long, dx long, value double, n long")


def score_tiles(df: DataFrame, key: str, load: Callable[[], Callable[[pd.DataFrame], np.ndarray]], batch_size: int = 256) -> DataFrame:
    """(key, score) of any model: ``load`` runs once a task and returns a
    function from a frame of at most ``batch_size`` rows to their scores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            for i in range(0, len(batch), batch_size):
                part = batch.iloc[i : i + batch_size]
                yield pd.DataFrame({key: part[key], "score": np.asarray(predict(part), float)})

    return df.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, score double")
