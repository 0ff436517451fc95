"""Grids: resampling, warping, padding, tiles with margins and halos, distances, holes and shapes of regions, band roles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .aggregates import exact_percentiles
from .regions import label_components

#: Names of bands by role, first role first, and the wavelengths of a role in nanometres: fixed values.
ALIASES = {
    "red": ("red", "b04", "b4"), "green": ("green", "b03", "b3"), "blue": ("blue", "b02", "b2"), "nir": ("nir", "nir08", "b08", "b8", "b8a"),
    "swir": ("swir", "swir16", "b11"), "vv": ("vv",), "vh": ("vh",),
}
STRICT_ALIASES = {
    "blue": ("blue",), "green": ("green",), "red": ("red",), "nir": ("nir", "nearinfrared", "nir08"), "narrow_nir": ("narrownir", "nirnarrow", "nir09", "b8a"),
    "swir": ("swir", "swir1", "swir16", "shortwaveinfrared1"), "swir2": ("swir2", "swir22", "shortwaveinfrared2"), "vv": ("vv",), "vh": ("vh",), "hh": ("hh",), "hv": ("hv",),
}
SENTINEL2 = {"b2": "blue", "b3": "green", "b4": "red", "b8": "nir", "b8a": "narrow_nir", "b11": "swir", "b12": "swir2"}
WAVES = (("blue", 450, 510), ("green", 520, 600), ("red", 630, 690), ("narrow_nir", 855, 890), ("nir", 780, 854), ("swir", 1550, 1750), ("swir2", 2080, 2350))


def _role(key: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for role, names in reversed(aliases.items()):
        out = F.when(key.isin(*names), role).otherwise(out)
    return out


def band_roles_by_alias(bands: DataFrame, by: list[str], idx: str, name: str) -> DataFrame:
    """(by, role, idx): the first band of each role by its name, dashes and underscores left out."""
    key = F.regexp_replace(F.lower(F.trim(name)), "[-_]", "")
    return bands.withColumn("role", _role(key, ALIASES)).where("role IS NOT NULL").groupBy(*by, "role").agg(F.min(idx).alias(idx))


def band_roles_strict(bands: DataFrame, by: list[str], idx: str, name: str, colour: str, nm: str, sentinel2: str) -> DataFrame:
    """(by, role, idx) where all evidence agrees: names, colour tags, wavelengths, and band numbers of a known sensor.

    A band with several roles makes all of them unusable in its scene, and so is a role claimed by several bands. Short-wave
    infrared also counts as its first band.
    """
    bands = bands.withColumn("__key", F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]", ""))
    bands = bands.withColumn("__number", F.regexp_replace(F.regexp_replace("__key", "^band", "b"), "^b0+", "b"))
    key, number = F.col("__key"), F.col("__number")
    known = F.when(F.col(sentinel2), _role(number, {role: (b,) for b, role in SENTINEL2.items()}))
    wave = F.lit(None).cast("string")
    for role, lo, hi in WAVES:
        wave = F.when(F.col(nm).between(lo, hi), role).otherwise(wave)
    tint = F.when(F.col(colour).isin("red", "green", "blue"), F.col(colour))
    claims = bands.select(*by, idx, F.array_distinct(F.filter(F.array(_role(key, STRICT_ALIASES), known, tint, wave), lambda x: x.isNotNull())).alias("roles"))
    # outer, as the filter that an inner one implies would compute the roles once more, below the steps above
    one = claims.select(*by, idx, F.explode_outer("roles").alias("role"), (F.size("roles") > 1).alias("torn")).where("role IS NOT NULL")
    sure = one.groupBy(*by, "role").agg(F.min(idx).alias(idx), F.max(idx).alias("__last"), F.bool_or("torn").alias("torn")).where((F.col(idx) == F.col("__last")) & ~F.col("torn"))
    alias = F.when(F.col("role") == "swir", F.array(F.lit("swir"), F.lit("swir1"))).otherwise(F.array("role"))
    return sure.select(*by, F.explode(alias).alias("role"), idx)


def select_channels(roles: Column, contract: tuple[str, ...], bands: Column) -> Column:
    """struct(channels, problem): the bands (map role -> number from 1) in the contract's order, and why it can't be met."""
    picked = F.array(*[roles[r] for r in contract])
    missing = F.exists(picked, lambda x: x.isNull())
    outside = F.coalesce(F.exists(picked, lambda x: (x < 1) | (x > bands)), F.lit(False))
    return F.struct(F.when(~missing & ~outside, picked).alias("channels"), F.when(missing, "missing").when(outside, "out_of_range").alias("problem"))


def radiometry_check(df: DataFrame, by: list[str], bands: list[str], is_byte: Column) -> DataFrame:
    """(by, method, is_ok) per scene: bytes are divided by 255, others must already lie in 0..1.00001."""
    scaled = [F.when(is_byte, F.col(b) / 255.0).otherwise(F.col(b)) for b in bands]
    lo, hi = F.array_min(F.array(*scaled)), F.array_max(F.array(*scaled))
    out = df.groupBy(*by).agg(F.bool_and(is_byte).alias("b"), F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    ok = F.coalesce((F.col("lo") >= 0) & (F.col("hi") <= 1.00001), F.lit(True))
    return out.select(*by, F.when(F.col("b"), "uint8 / 255").otherwise("metadata").alias("method"), ok.alias("is_ok"))


def sample(grid: DataFrame, source: DataFrame, by: list[str], value: str, row: Column, col: Column, method: str = "bilinear") -> DataFrame:
    """grid (by, r, c) with ``value`` read from source (by, r, c, value) at the real coordinates (row, col).

    Each target cell meets one or four source cells in an equi-join. Outside the source, and where all neighbours are null,
    the value is null; null neighbours leave their weight to the others.
    """
    spot = lambda r, c, w: F.struct(r.cast("long").alias("sr"), c.cast("long").alias("sc"), w.alias("w"))
    if method == "nearest":
        near = F.array(spot(F.floor(row + 0.5), F.floor(col + 0.5), F.lit(1.0)))
    else:
        r0, c0 = F.floor(row), F.floor(col)
        fr, fc = row - r0, col - c0
        near = F.array(spot(r0, c0, (1 - fr) * (1 - fc)), spot(r0, c0 + 1, (1 - fr) * fc), spot(r0 + 1, c0, fr * (1 - fc)), spot(r0 + 1, c0 + 1, fr * fc))
    want = grid.select(*by, "r", "c", F.explode(F.filter(near, lambda x: x["w"] > 0)).alias("x")).select(*by, "r", "c", "x.*")
    have = source.select(*by, F.col("r").cast("long").alias("sr"), F.col("c").cast("long").alias("sc"), F.col(value).alias("v"))
    got = want.join(have, [*by, "sr", "sc"], "left").groupBy(*by, "r", "c")
    used = F.when(F.col("v").isNotNull(), F.col("w"))
    return got.agg(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sum(used)).alias(value))


def resample(source: DataFrame, by: list[str], value: str, height: int, width: int, method: str = "bilinear") -> DataFrame:
    """Each scene of source on a grid of the given size; cell centres map to cell centres, edges are clamped."""
    dims = source.groupBy(*by).agg((F.max("r") + 1).alias("__h"), (F.max("c") + 1).alias("__w"))
    grid = dims.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    at = lambda x, n, m: F.least(F.greatest((F.col(x) + 0.5) * F.col(n) / m - 0.5, F.lit(0.0)), F.col(n) - 1.0)
    return sample(grid, source, by, value, at("r", "__h", height), at("c", "__w", width), method)


def warp_affine(source: DataFrame, grid: DataFrame, by: list[str], value: str, affine: tuple[float, ...], method: str = "bilinear") -> DataFrame:
    """source read on grid (by, r, c): row = a r + b c + d and col = e r + f c + g, with affine (a, b, d, e, f, g)."""
    a, b, d, e, f, g = affine
    return sample(grid, source, by, value, a * F.col("r") + b * F.col("c") + d, e * F.col("r") + f * F.col("c") + g, method)


def padded_index(i: Column, n: Column | int, mode: str) -> Column:
    """Where in 0..n-1 a padded position reads: mirrored about the edge cells, or the edge itself; null for zeros."""
    n = F.lit(n) if isinstance(n, int) else n
    if mode == "zero":
        return F.when((i >= 0) & (i < n), i)
    if mode == "edge":
        return F.least(F.greatest(i, F.lit(0)), n - 1)
    turn = F.greatest(2 * (n - 1), F.lit(1))
    at = F.pmod(i, turn)
    return F.when(n == 1, 0).otherwise(F.least(at, turn - at))


def tile_grid_with_margin(scenes: DataFrame, width: str, height: str, patch: int, margin: int) -> DataFrame:
    """scenes with x, y: patches whose cores (without margins) cover the scene; the last ones are flush with its edge."""
    step = patch - 2 * margin
    if step <= 0:
        raise ValueError("the margins leave nothing of a patch")

    def starts(n: str) -> Column:
        last = F.col(n) + margin - patch
        # the same patch arises more than once at the far edge
        return F.array_distinct(F.transform(F.sequence(F.lit(-margin), F.col(n) + margin - 1, F.lit(step)), lambda x: F.least(x, last)))

    return scenes.withColumn("x", F.explode(starts(width))).withColumn("y", F.explode(starts(height)))


def tile_join_pixels(px: DataFrame, height: int, width: int, size: int, step: int) -> DataFrame:
    """px with ty, tx for every overlapping tile that covers the pixel; a pixel lies in a bounded number of tiles."""

    def over(x: str, n: int) -> Column:
        last = max(n - size, 0)
        at = sorted({*range(0, last + 1, step), last})
        return F.explode(F.filter(F.array(*map(F.lit, at)), lambda s: (s <= F.col(x)) & (F.col(x) < s + size)))

    return px.withColumn("ty", over("r", height)).withColumn("tx", over("c", width))


def crop_margin_mosaic(cells: DataFrame, patch: int, margin: int) -> DataFrame:
    """Cells (x, y of the patch, i, j in it, ...) of patch cores only, with r and c on the output grid."""
    core = F.col("i").between(margin, patch - margin - 1) & F.col("j").between(margin, patch - margin - 1)
    return cells.where(core).withColumn("r", F.col("y") + F.col("i")).withColumn("c", F.col("x") + F.col("j"))


def score_tiles(tiles: DataFrame, key: list[str], values: str, predict: Callable[[np.ndarray], np.ndarray], classes: int) -> DataFrame:
    """(key, scores): ``predict`` maps a batch (tiles, cells) to probabilities (tiles, cells, classes), checked for shape,
    finiteness, range and sums; scores holds a tile's cube, cell by cell. Tiles of a batch have one size."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(len(key))
            grid = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            cube = np.asarray(predict(grid), np.float64)
            if cube.shape != (*grid.shape, classes):
                raise ValueError(f"a predictor gave {cube.shape} for {(*grid.shape, classes)}")
            if not np.isfinite(cube).all() or (cube < 0).any() or (cube > 1 + 1e-6).any() or (np.abs(cube.sum(axis=2) - 1) > 1e-4).any():
                raise ValueError("a predictor gave no probabilities")
            flat = pa.ListArray.from_arrays(np.arange(len(cube) + 1, dtype=np.int32) * cube[0].size, pa.array(cube.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(key))], flat], names=[*key, "scores"])

    kept = ", ".join(f"`{k}` {tiles.schema[k].dataType.simpleString()}" for k in key)
    return tiles.select(*key, values).mapInArrow(run, f"{kept}, scores array<double>")


def on_halo_tiles(px: DataFrame, value: str, tile: int, halo: int, fn: Callable[[np.ndarray], np.ndarray], by: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    """(by, r, c, out) after ``fn`` on each tile with ``halo`` cells around it; cells that don't exist, or are null, are NaN.

    A cell is sent to the tiles whose halo it lies in, at most nine where the halo is no wider than a tile. NaN results
    are null.
    """
    if halo > tile:
        raise ValueError("the halo is wider than a tile")
    by, out = list(by), out or value
    near = lambda x: F.array_distinct(F.transform(F.array(F.lit(-halo), F.lit(0), F.lit(halo)), lambda d: F.floor((F.col(x) + d) / tile)))
    sent = px.select(*by, "r", "c", F.col(value).cast("double").alias("v")).withColumn("ty", F.explode(near("r"))).withColumn("tx", F.explode(near("c")))
    kinds = [f"`{k}` {px.schema[k].dataType.simpleString()}" for k in by]

    def run(key, table):
        *scene, ty, tx = (k.as_py() for k in key)
        r, c = (table.column(n).to_numpy() - t * tile + halo for n, t in (("r", ty), ("c", tx)))
        grid = np.full((tile + 2 * halo,) * 2, np.nan)
        grid[r, c] = table.column("v").to_numpy(zero_copy_only=False)
        made = np.asarray(fn(grid), np.float64)
        if made.shape not in (grid.shape, (tile, tile)):
            raise ValueError("a tile function gave another shape")
        made = made[halo : halo + tile, halo : halo + tile] if made.shape == grid.shape else made
        own = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        r, c = r[own] - halo, c[own] - halo
        cells = {"r": pa.array(r + ty * tile, pa.int64()), "c": pa.array(c + tx * tile, pa.int64()), out: pa.array(made[r, c], from_pandas=True)}
        names = {k: pa.array([v] * len(r), table.schema.field(k).type) for k, v in zip(by, scene, strict=True)}
        return pa.table(names | cells)

    cells = sent.select(*by, F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "v")
    return cells.groupBy(*by, "ty", "tx").applyInArrow(run, ", ".join([*kinds, "r long", "c long", f"`{out}` double"]))


def region_fn(cells: DataFrame, key: str, fn, schema: str) -> DataFrame:
    """Any pandas function on whole regions; for regions of bounded size, as the whole of one meets in a task.

    fn gets frames of many regions, each in full and told apart by the key: a call per region would cost milliseconds each.
    """

    def run(frames):
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame[key].isna() if pd.isna(frame[key].iloc[-1]) else frame[key] == frame[key].iloc[-1]
            held, whole = frame[last], frame[~last]
            if len(whole):
                yield fn(whole)
        if held is not None:
            yield fn(held)

    return cells.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def nearest_squares(at: np.ndarray, known: np.ndarray, height: np.ndarray) -> np.ndarray:
    """For each of the ascending places at, the least (at - known)^2 + height^2 over the ascending known places.

    The parabolas' lower envelope in its matrix form: the best known place never moves back as at grows, so every solved
    place bounds the search of those beside it. Halving the gaps between solved places takes log2(n) numpy passes over at
    most n + m candidates each; no pairs are formed.
    """
    n, best, square = len(at), np.empty(len(at), np.int64), height.astype(np.int64) ** 2
    found, gap = np.empty(n, np.int64), 1 << max(0, n - 1).bit_length()
    while gap:
        i = np.arange(gap - 1, n, 2 * gap)
        lo = np.where(i >= gap, best[np.maximum(i - gap, 0)], 0)
        hi = np.where(i + gap < n, best[np.minimum(i + gap, n - 1)], len(known) - 1)
        many = hi - lo + 1
        start = np.cumsum(many) - many
        k = np.repeat(lo - start, many) + np.arange(many.sum())
        value = (np.repeat(at[i], many) - known[k]) ** 2 + square[k]
        least = np.minimum.reduceat(value, start) if len(i) else value
        first = np.flatnonzero(value == np.repeat(least, many))
        best[i], found[i] = k[first[np.searchsorted(first, start)]], least
        gap //= 2
    return found


def distance_to_background(px: DataFrame, by: list[str], mask: Column) -> DataFrame:
    """(by, r, c, distance): the exact distance of each mask cell to the nearest other cell; null where there is none.

    The nearest background up and down a column comes from windows; then a row, whose width is the scene's, is one task's,
    in time that grows with its width (``nearest_squares``).
    """
    df = px.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.coalesce(mask, F.lit(False)).alias("m"))
    column = W.partitionBy(*by, "c")
    back = F.when(~F.col("m"), F.col("r"))
    run_of = lambda order: F.last(back, True).over(column.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    up, down = F.col("r") - run_of("r"), run_of(F.desc("r")) - F.col("r")
    df = df.withColumn("g", F.least(up, down))
    names = [*by, "r", "c", "distance"]

    def run(table):
        table = table.sort_by("c")
        c, m = table.column("c").to_numpy(), table.column("m").to_numpy(zero_copy_only=False).astype(bool)
        g = table.column("g").cast(pa.float64()).to_numpy(zero_copy_only=False)
        known = ~np.isnan(g)
        found = np.full(int(m.sum()), np.nan)
        if known.any() and m.any():
            found = np.sqrt(nearest_squares(c[m], c[known], g[known]))
        out = table.filter(pa.array(m)).select([*by, "r", "c"]).append_column("distance", pa.array(found, from_pandas=True))
        return out.rename_columns(names)

    kept = "".join(f"`{k}` {px.schema[k].dataType.simpleString()}, " for k in by)
    return df.select(*by, "r", "c", "g", "m").groupBy(*by, "r").applyInArrow(run, f"{kept}r long, c long, distance double")


def fill_holes(px: DataFrame, mask: Column, width: int, most: int = 150, tile: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, r, c, is_mask): regions outside the mask of at most ``most`` cells join it."""
    cell, key = [*by, "r", "c"], [*by, "label"]
    df = px.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.coalesce(mask, F.lit(False)).alias("m"))
    labels = label_components(df.where("NOT m").select(*cell), width, tile=tile, by=by)
    small = labels.groupBy(*key).count().where(F.col("count") <= most).select(*key)
    holes = labels.join(small, key, "left_semi").select(*cell, F.lit(True).alias("hole"))
    return df.join(holes, cell, "left").select(*cell, (F.col("m") | F.coalesce("hole", F.lit(False))).alias("is_mask"))


def border_padding(px: DataFrame, black: Column, height: int, width: int, tile: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, r, c, is_valid): exact-black regions that touch the scene's edge are padding; black cells inside stay valid."""
    cell, key = [*by, "r", "c"], [*by, "label"]
    df = px.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.coalesce(black, F.lit(False)).alias("m"))
    labels = label_components(df.where("m").select(*cell), width, tile=tile, by=by)
    rim = labels.where((F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == height - 1) | (F.col("c") == width - 1)).select(*key).distinct()
    out = labels.join(rim, key, "left_semi").select(*cell, F.lit(True).alias("pad"))
    return df.join(out, cell, "left").select(*cell, F.col("pad").isNull().alias("is_valid"))


def region_shape(labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, pixels, perimeter, elongation, compactness): perimeter counts cells with a side neighbour outside the region."""
    steps, key = [(0, 1), (1, 0), (0, -1), (-1, 0)], [*by, "label"]
    sent = labels.select(*key, F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in steps])).alias("x")).select(*key, "x.r", "x.c")
    inner = sent.groupBy(*key, "r", "c").count().where("count = 4").select(*key, "r", "c", F.lit(1).alias("inner"))
    df = labels.join(inner, [*key, "r", "c"], "left").groupBy(*key).agg(
        F.count("*").alias("pixels"), F.count_if(F.col("inner").isNull()).alias("perimeter"), (F.max("r") - F.min("r") + 1).alias("h"), (F.max("c") - F.min("c") + 1).alias("w")
    )
    long, short = F.greatest("h", "w"), F.least("h", "w")
    return df.select(*key, "pixels", "perimeter", (long / short).alias("elongation"), (4 * np.pi * F.col("pixels") / F.col("perimeter") ** 2).alias("compactness"))


def mask_join(px: DataFrame, mask: DataFrame, by: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(px with the mask's value, problems (by, missing, extra)): a mask made elsewhere must have the same cells."""
    keys = [*by, "r", "c"]
    both = px.select(*keys, F.lit(1).alias("__p")).join(mask.select(*keys, F.lit(1).alias("__m")), keys, "full")
    off = both.groupBy(*by).agg(F.count_if(F.col("__m").isNull()).alias("missing"), F.count_if(F.col("__p").isNull()).alias("extra"))
    return px.join(mask.select(*keys, value), keys, "left"), off.where("missing + extra > 0")


def sar_water_score(df: DataFrame, by: list[str], db: Column, gradient: Column, ratio: Column | None = None) -> DataFrame:
    """df with ``score``: dark radar returns below a centre that follows the scene, cross-polarized ratio where there is one.

    The centre is the mean of the 10th percentile and the median, within -20..-8, and -14 in scenes of 100 cells or fewer.
    Steep gradients (radar shadow) and bright returns get 0.08 at most, cells without a value 0.
    """
    df = df.withColumn("__db", db)
    mid = exact_percentiles(df, by, F.col("__db"), {"p10": 0.1, "p50": 0.5}).join(df.groupBy(*by).agg(F.count("__db").alias("n")), by)
    centre = F.when(F.col("n") > 100, F.greatest(F.lit(-20.0), F.least(F.lit(-8.0), (F.col("p10") + F.col("p50")) / 2))).otherwise(-14.0)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    df = df.join(mid.select(*by, centre.alias("__centre")), by)
    score = unit((F.col("__centre") - 2.0 - F.col("__db")) / 8.0)
    score = score if ratio is None else F.when(ratio.isNotNull(), 0.65 * score + 0.35 * unit((-4.0 - ratio) / 6.0)).otherwise(score)
    capped = F.when((gradient > 3.5) | (F.col("__db") > -3.0), F.least(score, F.lit(0.08))).otherwise(score)
    return df.withColumn("score", F.when(F.col("__db").isNull(), 0.0).otherwise(capped)).drop("__db", "__centre")


def radar_profile(df: DataFrame, by: list[str], db: Column) -> DataFrame:
    """Statistics of decibels per scene, shares of structural, specular and volume returns, and what they say."""
    share = lambda x: F.round(100.0 * F.count_if(x) / F.count(db), 2)
    out = df.groupBy(*by).agg(
        F.round(F.avg(db), 2).alias("mean_db"), F.round(F.min(db), 2).alias("min_db"), F.round(F.max(db), 2).alias("max_db"), F.round(F.stddev_pop(db), 2).alias("std_db"),
        share(db >= -10.0).alias("structural"), share(db <= -20.0).alias("specular"), share((db > -20.0) & (db < -10.0)).alias("volume"),
    )
    said = [F.when(F.col("structural") > 5, "structural"), F.when(F.col("specular") > 5, "specular"), F.when(F.col("volume") > 10, "volume")]
    return out.withColumn("summary", F.coalesce(F.nullif(F.concat_ws(",", *said), F.lit("")), F.lit("uniform")))


def similarity(df: DataFrame, by: list[str], a: str, b: str, least: int = 64) -> DataFrame:
    """(by, similarity): correlation clipped to 0..1; 0 with too few common cells or a flat side."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by)
    out = both.agg(F.count("*").alias("n"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.corr(a, b).alias("p"))
    poor = (F.col("n") < least) | (F.least("sa", "sb") < 1e-6)
    return out.select(*by, F.when(poor, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p")))).alias("similarity"))


def sensor_masks(df: DataFrame, by: list[str], ndwi: Column, ndbi: Column, db: Column) -> DataFrame:
    """df with is_water and is_built by the optical image, is_dark and is_bright by the radar's; built-up is a scene's top quarter."""
    cut = exact_percentiles(df, by, ndbi, {"__cut": 0.75})
    yes = lambda x: F.coalesce(x, F.lit(False))
    out = df.join(cut, by, "left").withColumn("is_water", yes(ndwi >= 0.12)).withColumn("is_dark", yes(db <= -20.0))
    return out.withColumn("is_built", yes(ndbi >= F.col("__cut"))).withColumn("is_bright", yes(db >= -10.0)).drop("__cut")
