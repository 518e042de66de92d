"""Checks of registration: edges, shifts, separability.

Sweeps over shifts work on block tables: each imagery block meets the labels (or
a label block the imagery) of its own area and strips of the neighbours as wide as the
largest shift; correlations by FFT give what all shifts need at once, and only these
sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import as_array, found, kind_of, mapped, met, placed, send
from .windows import gradient, smoothed

#: Blocks that are unpacked and transformed together, and how many shifts a class must have
#: for the transform to be cheaper than adding up.
BATCH, DIRECT = 1024, 8
SIZE = ["image_id", "image_height", "image_width"]


def _limits(imagery: DataFrame) -> DataFrame:
    return imagery.select(*SIZE).distinct()  # one row an image


def _correlated(own: np.ndarray, other: np.ndarray, reach: int) -> np.ndarray:
    """Spectrum whose inverse has at (reach + dy, reach + dx) the sum of own at p times other at
    p + (dy, dx).  other (..., h + 2 reach, w + 2 reach) is wider on each side than own (..., h, w)."""
    size = other.shape[-2:]
    return np.conj(np.fft.rfft2(own, size)) * np.fft.rfft2(other, size)


def _sums_by_shift(spectrum: np.ndarray, size: tuple[int, int], reach: int) -> np.ndarray:
    return np.fft.irfft2(spectrum, size)[..., : 2 * reach + 1, : 2 * reach + 1]


def _alike(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows (image, arrays...) whose arrays have the same shapes, by image; what is worked on
    together is bounded."""
    shapes: dict[tuple, list[tuple]] = {}
    for r in rows:
        shapes.setdefault(tuple(a.shape for a in r[1:]), []).append(r)
    for shape, same in shapes.items():
        most = max(1, (1 << 20) // max(1, shape[-1][0] * shape[-1][1]))
        for at in range(0, len(same), most):
            yield same[at : at + most]


def _by_image(rows: list[tuple]) -> tuple[list, np.ndarray]:
    """The different images of rows and which each row has."""
    index: dict = {}
    return index, np.array([index.setdefault(r[0], len(index)) for r in rows])


def _added(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by their image."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    np.add.at(out, at, values)
    return out


def _summed(a: np.ndarray, use: np.ndarray, b: np.ndarray, at: np.ndarray, n: int, classes: np.ndarray, wanted: np.ndarray, reach: int) -> np.ndarray:
    """Counts, sums and sums of squares of blocks a by image and class, shift by shift."""
    h, w = a.shape[1:]
    out = np.zeros((n, 3, len(classes), len(wanted)), np.int64)
    which = np.where(np.isin(b, classes), np.searchsorted(classes, b), -1)
    for j, (dy, dx) in enumerate(wanted):
        c = which[:, reach + dy : reach + dy + h, reach + dx : reach + dx + w]
        good = use & (c >= 0)
        code = (at[:, None, None] * len(classes) + c)[good]
        dn = a[good]
        for k, weight in enumerate((None, dn, dn * dn)):
            out[:, k, :, j] = np.rint(np.bincount(code, weight, n * len(classes))).reshape(n, len(classes))
    return out


def _transformed(a: np.ndarray, use: np.ndarray, b: np.ndarray, at: np.ndarray, n: int, classes: np.ndarray, wanted: np.ndarray, reach: int) -> np.ndarray:
    """``_summed`` by FFT, of all shifts of a class at once."""
    out = np.zeros((n, 3, len(classes), len(wanted)), np.int64)
    square = a * a
    own = np.stack([use, a, square & 0xFFFF, square >> 16], axis=1).astype(np.float64)
    for i, c in enumerate(classes):
        spectrum = _added(_correlated(own, (b == c)[:, None].astype(np.float64), reach), at, n)
        sums = np.rint(_sums_by_shift(spectrum, b.shape[1:], reach)).astype(np.int64)[:, :, wanted[:, 0] + reach, wanted[:, 1] + reach]
        out[:, :, i] = np.stack([sums[:, 0], sums[:, 1], sums[:, 2] + (sums[:, 3] << 16)], axis=1)
    return out


def shift_sums(imagery: DataFrame, labels: DataFrame, shifts: list[tuple[int, int]], block: int, ds: int = 1, margin: int = 0, valid: bool = True) -> DataFrame:
    """image_id, dy, dx, class_id, n, s, ss: over imagery pixels on the grid of
    every ``ds`` pixels, ``margin`` grid steps inside the image, the count, sum and
    sum of squares of DN for each class of the label (dy, dx) grid steps away;
    with ``valid`` only where both DN and class are above 0.

    Imagery blocks meet their own labels and strips of the neighbours' as wide as the
    largest shift.  The sums of all shifts at once are correlations of the class masks
    with DN's count, value and square, made by FFT for all blocks of a batch together and
    added up by image before the inverse.  Squares are split so that each sum stays a
    whole number below 2^47, which rounding restores.  Where shifts are few beside the
    classes, they are added up one by one, with the same sums."""
    reach = max((max(abs(y), abs(x)) for y, x in shifts), default=0)
    wide = reach * ds
    rows = met(send(imagery, block, "own"), send(labels, block, "label", wide, wide)).join(F.broadcast(_limits(imagery)), "image_id")
    wanted = np.array(sorted(set(shifts)), dtype=int).reshape(-1, 2)

    def planes(r: dict) -> tuple | None:
        own = found(r["parts"], "own")
        if not own:
            return None
        o = own[0]
        # Rows and columns on the grid: places in the block, and in grid steps.
        ys, xs = (np.arange(-o[at] % ds, o[n], ds) for at, n in (("y", "h"), ("x", "w")))
        if not len(ys) or not len(xs):
            return None
        a = as_array(o)[:, :, 0][np.ix_(ys, xs)].astype(np.int64)
        b = placed(found(r["parts"], "label"), o["y"] - wide, o["x"] - wide, o["h"] + 2 * wide, o["w"] + 2 * wide, -1, "int64")[:, :, 0]
        b = b[ys[0] : ys[0] + (len(ys) + 2 * reach - 1) * ds + 1 : ds, xs[0] : xs[0] + (len(xs) + 2 * reach - 1) * ds + 1 : ds]
        inside = lambda at, first, full: (first + at >= margin * ds) & ((first + at) // ds < -(-full // ds) - margin)
        use = inside(ys, o["y"], r["image_height"])[:, None] & inside(xs, o["x"], r["image_width"])[None, :]
        return r["image_id"], np.where(use & (a > 0) if valid else use, a, 0), use & (a > 0) if valid else use, b

    def work(lists: Iterator[list[dict]]) -> Iterator[dict]:
        for rows in lists:
            for same in _alike([p for p in map(planes, rows) if p]):
                index, at = _by_image(same)
                a, use, b = (np.stack([r[k] for r in same]) for k in (1, 2, 3))
                classes = np.unique(b)
                classes = classes[classes > (0 if valid else -1)]
                if not len(classes):
                    continue
                # (images, 3, classes, shifts)
                sums = (_summed if len(wanted) <= DIRECT * len(classes) else _transformed)(a, use, b, at, len(index), classes, wanted, reach)
                image, c, j = np.nonzero(sums[:, 0])
                n, s, ss = (sums[image, k, c, j] for k in range(3))
                images = list(index)
                yield {"image_id": [images[i] for i in image], "dy": wanted[j, 0], "dx": wanted[j, 1], "class_id": classes[c], "n": n, "s": s, "ss": ss}

    parts = mapped(rows, work, f"image_id {kind_of(imagery)}, dy long, dx long, class_id long, n long, s long, ss long", BATCH)
    return parts.groupBy("image_id", "dy", "dx", "class_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))


def fisher_of_sums(sums: DataFrame, keys: list[str], least_class: int = 50, least: int = 1000) -> DataFrame:
    """``fisher_ratio`` from ``shift_sums``."""
    total = Window.partitionBy(*keys)
    rows = sums.withColumn("__n", F.sum("n").over(total)).withColumn("__s", F.sum("s").over(total))
    mean = F.col("__s") / F.col("__n")
    between = F.when(F.col("n") >= least_class, F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).otherwise(0.0)
    out = rows.withColumn("__b", between).groupBy(*keys).agg(F.sum("n").alias("all"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("__b").alias("b"))
    var = F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("all")) / F.col("all"), F.lit(0.0))
    return out.select(*keys, F.when(F.col("all") < least, 0.0).otherwise(F.col("b") / F.col("all") / (var + 1e-9)).alias("fisher"))


def _offsets(spark: SparkSession, reach: int, step: int, ds: int) -> DataFrame:
    """dy, dx of a sweep and the grid steps they fall on (rounded down)."""
    one = lambda n: spark.range(-reach, reach + 1, step).select(F.col("id").alias(n), F.floor(F.col("id") / ds).alias(f"g{n}"))
    return one("dy").crossJoin(one("dx"))


def separability_sweep(imagery: DataFrame, labels: DataFrame, reach: int, block: int, step: int = 2, ds: int = 4, least_class: int = 50, least: int = 1000) -> DataFrame:
    """image_id, dy, dx, fisher: how well the classes part the imagery for every
    label shift of ``-reach`` to ``reach`` pixels, on the grid of every ``ds``
    pixels.  Several shifts fall on one grid step."""
    steps = sorted({o // ds for o in range(-reach, reach + 1, step)})
    sums = shift_sums(imagery, labels, [(y, x) for y in steps for x in steps], block, ds, reach // ds + 1)
    found = fisher_of_sums(sums, ["image_id", "dy", "dx"], least_class, least).select("image_id", F.col("dy").alias("gdy"), F.col("dx").alias("gdx"), "fisher")
    offsets = _offsets(imagery.sparkSession, reach, step, ds)  # (2 reach / step + 1)^2 rows
    images = imagery.select("image_id").distinct()
    surface = images.crossJoin(F.broadcast(offsets)).join(found, ["image_id", "gdy", "gdx"], "left")
    return surface.select("image_id", "dy", "dx", F.coalesce("fisher", F.lit(0.0)).alias("fisher"))


def edge_sweep(imagery: DataFrame, labels: DataFrame, reach: int, block: int, least: int = 5000, sigma: float = 1.0) -> DataFrame:
    """image_id, dy, dx, energy: the mean smoothed gradient of the imagery under
    label edges for every shift; 0 where DN is 0.  Edges within ``reach`` of the
    image's border are dropped; an image with fewer than ``least`` edges has none
    but a null row."""
    radius = int(4 * sigma + 0.5) + 1
    wide = reach + radius
    met_parts = met(send(labels, block, "own"), send(labels, block, "near", 0, 1, others=True), send(imagery, block, "image", wide, wide))
    rows = met_parts.join(F.broadcast(_limits(imagery)), "image_id")

    def planes(r: dict) -> tuple | None:
        own = found(r["parts"], "own")
        if not own:
            return None
        o = own[0]
        y0, x0, h, w = o["y"], o["x"], o["h"], o["w"]
        near = placed(own + found(r["parts"], "near"), y0, x0, h + 1, w + 1, -1, "int64")[:, :, 0]
        a, right, down = near[:-1, :-1], near[:-1, 1:], near[1:, :-1]
        y, x = np.mgrid[y0 : y0 + h, x0 : x0 + w]
        edge = (a > 0) & ((right != a) & (x + 1 < r["image_width"]) | (down != a) & (y + 1 < r["image_height"]))
        edge &= (y > reach) & (y < r["image_height"] - reach) & (x > reach) & (x < r["image_width"] - reach)
        top, left, bottom, far = max(y0 - wide, 0), max(x0 - wide, 0), min(y0 + h + wide, r["image_height"]), min(x0 + w + wide, r["image_width"])
        g = placed(found(r["parts"], "image"), top, left, bottom - top, far - left, 0)[:, :, 0]
        g = np.pad(g, ((top - y0 + wide, y0 + h + wide - bottom), (left - x0 + wide, x0 + w + wide - far)), mode="symmetric")
        return r["image_id"], edge, g

    def work(lists: Iterator[list[dict]]) -> Iterator[list[dict]]:
        for rows in lists:
            out = []
            for same in _alike([p for p in map(planes, rows) if p]):
                index, at = _by_image(same)
                # The blocks of a batch side by side as channels: one pass of the filters.
                g = np.stack([r[2] for r in same], axis=2)
                energy = np.where(g == 0, 0.0, smoothed(gradient(g), sigma))[radius:-radius, radius:-radius].transpose(2, 0, 1)
                edge = np.stack([r[1] for r in same]).astype(np.float64)
                spectrum = _added(_correlated(edge, energy, reach), at, len(index))
                sums, n = _sums_by_shift(spectrum, energy.shape[1:], reach), _added(edge.sum((1, 2)), at, len(index))
                for image, k in index.items():
                    out += [{"image_id": image, "dy": dy - reach, "dx": dx - reach, "n": int(n[k]), "s": float(v)} for (dy, dx), v in np.ndenumerate(sums[k])]
            yield out

    parts = mapped(rows, work, f"image_id {kind_of(labels)}, dy long, dx long, n long, s double", BATCH)
    swept = parts.groupBy("image_id", "dy", "dx").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    enough = F.col("n") >= least
    known = swept.filter(enough).select("image_id", "dy", "dx", (F.col("s") / F.col("n")).alias("energy"))
    none = swept.filter(~enough).select("image_id").distinct().select("image_id", *[F.lit(None).cast(t).alias(c) for c, t in (("dy", "long"), ("dx", "long"), ("energy", "double"))])
    return known.unionByName(none)


def peaks(surface: DataFrame, value: str, group: str = "image_id") -> DataFrame:
    """``surface_peak`` of every group: dy, dx, peak, zero, gain and ratio."""
    first = F.min(F.struct((-F.col(value)).alias("v"), "dy", "dx"))
    zero = F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col(value)))
    out = surface.filter(F.col(value).isNotNull()).groupBy(group).agg(first.alias("b"), zero.alias("zero"))
    out = out.select(group, F.col("b.dy").alias("dy"), F.col("b.dx").alias("dx"), (-F.col("b.v")).alias("peak"), "zero")
    out = out.withColumn("gain", F.when(F.col("zero") > 0, F.col("peak") / F.col("zero") - 1).otherwise(0.0))
    return out.withColumn("ratio", F.col("peak") / (F.col("zero") + 1e-9))


def refined_peak(surface: DataFrame, value: str, reach: int) -> DataFrame:
    """One row of a surface (dy, dx, value, n) of all shifts of a patch: the peak
    within ``reach``, moved to the top of the parabola through its neighbours, its
    height above the mean in standard deviations (snr), and n; no row without one."""
    near = surface.filter((F.abs("dy") <= reach) & (F.abs("dx") <= reach))
    best = near.orderBy(F.desc(value), "dy", "dx").limit(1).select(F.col("dy").alias("py"), F.col("dx").alias("px"), F.col(value).alias("top"), "n")
    facts = near.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    at = lambda y, x: F.max(F.when((F.col("dy") == F.col("py") + y) & (F.col("dx") == F.col("px") + x), F.col(value)))
    beside = surface.crossJoin(F.broadcast(best)).agg(at(-1, 0).alias("up"), at(1, 0).alias("down"), at(0, -1).alias("left"), at(0, 1).alias("right"))

    def moved(p: str, low: str, high: str) -> Column:
        bend = F.col(low) + F.col(high) - 2 * F.col("top")
        part = F.when(F.abs(bend) >= 1e-12, (F.col(low) - F.col(high)) / (2 * bend))
        return F.col(p) + F.coalesce(part, F.lit(0.0))

    row = best.crossJoin(F.broadcast(facts)).crossJoin(F.broadcast(beside))
    return row.select(moved("py", "up", "down").alias("dy"), moved("px", "left", "right").alias("dx"), ((F.col("top") - F.col("mean")) / (F.col("std") + 1e-12)).alias("snr"), "n")


def label_edges(labels: DataFrame, image: str) -> DataFrame:
    """Whether a labelled pixel differs from its right or lower neighbour."""
    right = F.lead("class_id").over(Window.partitionBy(image, "y").orderBy("x"))
    down = F.lead("class_id").over(Window.partitionBy(image, "x").orderBy("y"))
    out = labels.withColumn("__r", right).withColumn("__d", down)
    edge = (F.col("class_id") > 0) & (F.coalesce(F.col("__r") != F.col("class_id"), F.lit(False)) | F.coalesce(F.col("__d") != F.col("class_id"), F.lit(False)))
    return out.withColumn("edge", edge).drop("__r", "__d")


def _few(shifts: DataFrame, most: int = 10_000) -> DataFrame:
    if shifts.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} shifts: use the sweeps over blocks")
    return shifts


def shift_join(imagery: DataFrame, labels: DataFrame, shifts: DataFrame, image: str) -> DataFrame:
    """Every imagery pixel with the label displaced by each (dy, dx) of the
    small table of shifts."""
    moved = imagery.crossJoin(F.broadcast(_few(shifts))).withColumn("ly", F.col("y") + F.col("dy")).withColumn("lx", F.col("x") + F.col("dx"))
    own = labels.select(image, F.col("y").alias("ly"), F.col("x").alias("lx"), "class_id")
    return moved.join(own, [image, "ly", "lx"])


def fisher_ratio(pairs: DataFrame, keys: list[str], least_class: int = 50, least: int = 1000) -> DataFrame:
    """Between-class over total variance of dn over pixels valid in both."""
    good = pairs.filter("dn > 0 AND class_id > 0")
    per = good.groupBy(*keys, "class_id").agg(F.count(F.lit(1)).alias("n"), F.avg("dn").alias("m"))
    total = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("all"), F.avg("dn").alias("mean"), F.var_pop("dn").alias("var"))
    kept = per.filter(F.col("n") >= least_class).join(total, keys)
    between = kept.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("ss"))
    out = total.join(between, keys, "left")
    return out.select(*keys, F.when(F.col("all") < least, 0.0).otherwise(F.coalesce("ss", F.lit(0.0)) / F.col("all") / (F.col("var") + 1e-9)).alias("fisher"))


def edge_energy(edges: DataFrame, gradient: DataFrame, shifts: DataFrame, image: str) -> DataFrame:
    """Mean gradient under label-edge pixels for every shift."""
    moved = edges.filter("edge").crossJoin(F.broadcast(_few(shifts))).select(image, "dy", "dx", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    return moved.join(gradient, [image, "y", "x"]).groupBy("dy", "dx").agg(F.avg("g").alias("energy"))


def surface_peak(surface: DataFrame, value: str) -> DataFrame:
    """One row: the peak (first in row order on ties), the value at zero shift, the gain."""
    peak = surface.orderBy(F.desc(value), "dy", "dx").limit(1).select("dy", "dx", F.col(value).alias("peak"))
    zero = surface.agg(F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col(value))).alias("zero"))
    return peak.crossJoin(zero).withColumn("gain", F.when(F.col("zero") > 0, F.col("peak") / F.col("zero") - 1).otherwise(0.0))


def registration_report(sweep: DataFrame, ratio: float = 1.05, gain: float = 0.10, res: float = 1.0) -> DataFrame:
    """Whether the registration can be resolved, and the residual shift, for each
    row of ``peaks`` (best_dy, best_dx, peak, zero, gain; other columns stay)."""
    found = F.coalesce((F.col("peak") / (F.col("zero") + 1e-9) > ratio) | (F.col("gain") > gain), F.lit(False))
    shift = lambda c: F.when(F.col("resolvable"), F.col(c)).otherwise(0)
    px = F.sqrt((F.col("best_dy") * F.col("best_dy") + F.col("best_dx") * F.col("best_dx")).cast("double"))
    rest = [c for c in sweep.columns if c not in ("best_dy", "best_dx", "peak", "zero", "gain", "ratio")]
    out = sweep.withColumn("resolvable", found).select(*rest, "resolvable", shift("best_dy").alias("best_dy"), shift("best_dx").alias("best_dx"))
    return out.withColumn("residual_px", px).withColumn("residual_m", px * res)
