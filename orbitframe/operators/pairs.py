"""Two dates or two sensors of one place: alignment, shifts, normalisation, change and agreement; series of dates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .aggregates import agreement


def _slope(value: str, line: list[str], along: str) -> Column:
    """Central difference inside a line, one-sided at its ends."""
    at = W.partitionBy(*line).orderBy(along)
    ahead, behind = F.lead(value).over(at), F.lag(value).over(at)
    step = F.when(ahead.isNotNull() & behind.isNotNull(), 2.0).otherwise(1.0)
    return (F.coalesce(ahead, F.col(value)) - F.coalesce(behind, F.col(value))) / step


def correlation(a: str, b: str) -> Column:
    """Pearson's, as an aggregate; NULL where either side is flat (``corr`` raises there in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def gradient_magnitude(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Windows run along single rows and columns of a scene, so a partition is never larger than one side of the grid."""
    dx, dy = _slope(value, [*by, "r"], "c"), _slope(value, [*by, "c"], "r")
    return df.withColumn("__dx", dx).withColumn("__dy", dy).withColumn(out, F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2)).drop("__dx", "__dy")


def alignment_score(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, alignment, status): correlation, absolute difference and gradient correlation in one number of four places.

    Flat grids score by their mean difference alone. Pixels where a date is NULL take no part.
    """
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    df = gradient_magnitude(gradient_magnitude(df, by, a, "__ga"), by, b, "__gb")
    s = df.groupBy(*by).agg(
        F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), correlation(a, b).alias("p"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"),
        F.stddev_pop("__ga").alias("ga"), F.stddev_pop("__gb").alias("gb"), correlation("__ga", "__gb").alias("gp"),
    )
    near = F.greatest(F.lit(0.0), 1 - 2 * F.col("mae"))
    shape = F.when((F.col("ga") > 1e-6) & (F.col("gb") > 1e-6), F.greatest(F.lit(0.0), F.col("gp"))).otherwise(near)
    flat = (F.col("sa") < 1e-6) | (F.col("sb") < 1e-6)
    score = F.when(flat, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("mae")))).otherwise(0.45 * F.greatest(F.lit(0.0), F.col("p")) + 0.35 * near + 0.20 * shape)
    status = F.when(F.col("alignment") >= 0.70, "optimal").when(F.col("alignment") >= 0.35, "acceptable").otherwise("low_confidence")
    return s.select(*by, F.round(score, 4).alias("alignment")).withColumn("status", status)


def _averaged(df: DataFrame, by: list[str], a: str, b: str, factor: int) -> DataFrame:
    """(by, r, c, __a, __b): both dates averaged over squares of ``factor`` cells."""
    if factor == 1:
        return df.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(a).alias("__a"), F.col(b).alias("__b"))
    square = lambda x: F.floor(F.col(x) / factor).cast("long").alias(x)
    return df.groupBy(*by, square("r"), square("c")).agg(F.avg(a).alias("__a"), F.avg(b).alias("__b"))


def shift_scores(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Correlation of a[r, c] with b[r + dy, c + dx] for all shifts of up to ``most``, NaN cells left out, as one square.

    Six cross-correlations by Fourier transform give the number of common cells and their sums for every shift at once.
    NaN where fewer than two cells meet or either side is flat there.
    """
    size = tuple(n + most for n in a.shape)
    masks = [~np.isnan(x) for x in (a, b)]
    centred = [np.where(m, x - (x[m].mean() if m.any() else 0), 0) for x, m in zip((a, b), masks, strict=True)]
    turned = lambda x: np.fft.rfft2(x, size)
    fa, fb = ([turned(m), turned(x), turned(x * x)] for m, x in zip(masks, centred, strict=True))
    shifts = np.arange(-most, most + 1)
    met = lambda x, y: np.fft.irfft2(np.conj(x) * y, size)[np.ix_(shifts, shifts)]
    n = np.round(met(fa[0], fb[0]))
    sa, sb, saa, sbb, sab = met(fa[1], fb[0]), met(fa[0], fb[1]), met(fa[2], fb[0]), met(fa[0], fb[2]), met(fa[1], fb[1])
    va, vb = n * saa - sa * sa, n * sbb - sb * sb
    flat = (n < 2) | (va <= 1e-12 * n * np.abs(saa)) | (vb <= 1e-12 * n * np.abs(sbb))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(flat, np.nan, (n * sab - sa * sb) / np.sqrt(va * vb))


def _all_shifts(grid: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, dy, dx, peak) of every shift of up to ``most`` cells; a scene's grid, coarse and so bounded, is one group."""

    def run(table):
        r, c = (table.column(n).to_numpy() for n in ("r", "c"))
        r, c = r - r.min(), c - c.min()
        grids = []
        for name in ("__a", "__b"):
            cells = np.full((int(r.max()) + 1, int(c.max()) + 1), np.nan)
            cells[r, c] = table.column(name).to_numpy(zero_copy_only=False)
            grids.append(cells)
        score = shift_scores(*grids, most).ravel()
        dy, dx = (x.ravel() for x in np.meshgrid(*[np.arange(-most, most + 1)] * 2, indexing="ij"))
        scene = table.select(by).take(pa.array(np.zeros(len(score), np.int64)))
        for name, column in (("dy", pa.array(dy)), ("dx", pa.array(dx)), ("peak", pa.array(np.round(score, 9), from_pandas=True))):
            scene = scene.append_column(name, column)
        return scene

    kept = "".join(f"`{k}` {grid.schema[k].dataType.simpleString()}, " for k in by)
    return grid.groupBy(*by).applyInArrow(run, f"{kept}dy long, dx long, peak double")


def shift_sums(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Number of common cells, and sums of a, b, aa, bb and ab over them, for each shift of up to ``most``: (shifts, 6).

    b has a margin of ``most`` cells; NaN cells are left out.
    """
    out = []
    mask = ~np.isnan(a)
    a = np.where(mask, a, 0.0)
    there = ~np.isnan(b)
    b = np.where(there, b, 0.0)
    for dy in range(2 * most + 1):
        for dx in range(2 * most + 1):
            at = np.s_[dy : dy + a.shape[0], dx : dx + a.shape[1]]
            m, x, y = mask & there[at], np.where(there[at], a, 0.0), np.where(mask, b[at], 0.0)
            out.append((m.sum(), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()))
    return np.array(out, float)


def _near_shifts(df: DataFrame, by: list[str], a: str, b: str, most: int, tile: int = 128) -> DataFrame:
    """(by, dy, dx, peak) of every shift of up to ``most`` cells, exact for scenes of any size.

    Tiles meet the cells of b in a margin around them and add up their sums; six numbers a shift and tile are shuffled.
    Values are centred by their scene's means first, as correlation is a difference of large sums.
    """
    means = df.groupBy(*by).agg(F.avg(a).alias("__ma"), F.avg(b).alias("__mb"))  # a row per scene
    cells = df.join(F.broadcast(means), by).select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), (F.col(a) - F.col("__ma")).alias("__a"), (F.col(b) - F.col("__mb")).alias("__b"))
    tiles = lambda x: F.sequence(F.floor((F.col(x) - most) / tile), F.floor((F.col(x) + most) / tile))
    cells = cells.withColumn("__y", F.explode(tiles("r"))).withColumn("__x", F.explode(tiles("c")))
    dy, dx = (x.ravel() for x in np.meshgrid(*[np.arange(-most, most + 1)] * 2, indexing="ij"))
    names = ("n", "sa", "sb", "saa", "sbb", "sab")

    def run(table):
        r, c, ty, tx = (table.column(n).to_numpy() for n in ("r", "c", "__y", "__x"))
        r, c = r - ty * tile + most, c - tx * tile + most
        grids = np.full((2, tile + 2 * most, tile + 2 * most), np.nan)
        for grid, name in zip(grids, ("__a", "__b"), strict=True):
            grid[r, c] = table.column(name).to_numpy(zero_copy_only=False)
        sums = shift_sums(grids[0][most : most + tile, most : most + tile], grids[1], most)
        out = table.select(by).take(pa.array(np.zeros(len(sums), np.int64)))
        for name, column in (("dy", dy), ("dx", dx), *zip(names, sums.T, strict=True)):
            out = out.append_column(name, pa.array(column))
        return out

    kept = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)
    sums = cells.groupBy(*by, "__y", "__x").applyInArrow(run, f"{kept}dy long, dx long, " + ", ".join(f"{n} double" for n in names))
    sums = sums.groupBy(*by, "dy", "dx").agg(*[F.sum(n).alias(n) for n in names])
    va, vb = F.col("n") * F.col("saa") - F.col("sa") ** 2, F.col("n") * F.col("sbb") - F.col("sb") ** 2
    flat = (F.col("n") < 2) | (va <= 1e-12 * F.col("n") * F.col("saa")) | (vb <= 1e-12 * F.col("n") * F.col("sbb"))
    peak = F.when(~flat, F.try_divide(F.col("n") * F.col("sab") - F.col("sa") * F.col("sb"), F.sqrt(va) * F.sqrt(vb)))
    return sums.select(*by, "dy", "dx", F.round(peak, 9).alias("peak"))


def best_shift(df: DataFrame, by: list[str], a: str, b: str, share: float = 0.2, base: int = 64, most: int | None = None) -> DataFrame:
    """(by, dy, dx, peak): the displacement of b against a with the largest correlation, the shortest on ties; NULL if flat.

    With ``most``, displacements are also of at most so many cells, and all of them are searched at full size. Else
    all displacements of up to ``share`` of either side of a scene are searched, coarse to fine: on grids averaged to sides
    of at most ``base`` cells every one, by Fourier transform; then, with cells half as large each time, those next to the
    best, nine candidates a cell in an equi-join. Scenes of up to ``base`` cells a side are searched in full.
    """
    if not by:
        return best_shift(df.withColumn("__scene", F.lit(1)), ["__scene"], a, b, share, base, most).drop("__scene")
    size = df.groupBy(*by).agg((F.max("r") - F.min("r") + 1).alias("__h"), (F.max("c") - F.min("c") + 1).alias("__w"))

    def choose(score: DataFrame, factor: int) -> DataFrame:
        fits = (F.abs("dy") * factor <= share * F.col("__h")) & (F.abs("dx") * factor <= share * F.col("__w"))
        order = F.struct(F.col("peak"), (-F.abs("dy") - F.abs("dx")).alias("near"), F.col("dy"), F.col("dx"))
        return score.join(size, by).where(fits).groupBy(*by).agg(F.max(order).alias("t")).select(*by, "t.dy", "t.dx", "t.peak")

    whole = lambda best: best.select(*by, F.col("dy").cast("int").alias("dy"), F.col("dx").cast("int").alias("dx"), "peak")
    if most is not None:
        return whole(choose(_near_shifts(df, by, a, b, most), 1))
    longest = size.agg(F.max(F.greatest("__h", "__w"))).first()[0] or 1
    factor, best = 1, None
    while longest > base * factor:
        factor *= 2
    while True:
        grid = _averaged(df, by, a, b, factor)
        if best is None:
            score = _all_shifts(grid, by, int(share * min(longest, base * factor) / factor))
        else:
            near = F.array(*[F.struct((2 * F.col("dy") + y).alias("dy"), (2 * F.col("dx") + x).alias("dx")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
            moved = grid.where("__b IS NOT NULL").join(best, by).select(*by, "r", "c", "__b", F.explode(near).alias("__m"))
            moved = moved.select(*by, (F.col("r") - F.col("__m.dy")).alias("r"), (F.col("c") - F.col("__m.dx")).alias("c"), "__m.dy", "__m.dx", "__b")
            score = moved.join(grid.where("__a IS NOT NULL").select(*by, "r", "c", "__a"), [*by, "r", "c"]).groupBy(*by, "dy", "dx").agg(F.round(correlation("__a", "__b"), 9).alias("peak"))
        best = choose(score, factor)
        if factor == 1:
            return whole(best)
        factor //= 2


def apply_shift(df: DataFrame, by: list[str], value: str, dy: int, dx: int, out: str) -> DataFrame:
    """The grid with its values moved by (dy, dx); vacated cells are NULL."""
    moved = df.select(*by, (F.col("r") + dy).cast("int").alias("r"), (F.col("c") + dx).cast("int").alias("c"), F.col(value).alias(out))
    return df.select(*by, "r", "c").join(moved, [*by, "r", "c"], "left")


def shared_valid(df: DataFrame, by: list[str], a: Column, b: Column, least: float = 0.8) -> DataFrame:
    """Pixels valid at both dates, their share of the frame, and whether that suffices."""
    out = df.groupBy(*by).agg(F.count_if(a & b).alias("shared"), F.count("*").alias("all_n"))
    return out.withColumn("share", F.col("shared") / F.col("all_n")).withColumn("enough", F.col("share") >= least)


def radiometric_normalization(df: DataFrame, by: list[str], a: str, b: str, out: str) -> DataFrame:
    """b with the mean and spread of a, clipped to 0..1; unchanged where either is flat or the spreads differ four-fold.

    The moments, a row per scene, are broadcast: dealt by scene, all cells of one would meet in a task.
    """
    at = F.col(a).isNotNull() & F.col(b).isNotNull()
    s = df.where(at).groupBy(*by).agg(F.avg(a).alias("__ma"), F.avg(b).alias("__mb"), F.stddev_pop(a).alias("__sa"), F.stddev_pop(b).alias("__sb"))
    ratio = F.col("__sa") / F.col("__sb")
    use = (F.col("__sa") > 0.02) & (F.col("__sb") > 0.02) & (ratio > 0.25) & (ratio < 4)
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(b) - F.col("__mb")) * ratio + F.col("__ma")))
    both = df.join(F.broadcast(s), by, "left") if by else df.crossJoin(F.broadcast(s))
    return both.withColumn(out, F.when(use & F.col(b).isNotNull(), moved).otherwise(F.col(b))).drop("__ma", "__mb", "__sa", "__sb")


def gradient_witness(df: DataFrame, by: list[str], diff: str, out: str) -> DataFrame:
    """Chance of change from the mean absolute difference of the bands and its steps to the next row and column."""
    right = F.abs(F.lead(diff).over(W.partitionBy(*by, "r").orderBy("c")) - F.col(diff))
    down = F.abs(F.lead(diff).over(W.partitionBy(*by, "c").orderBy("r")) - F.col(diff))
    edge = df.withColumn("__x", F.coalesce(right, F.lit(0.0))).withColumn("__y", F.coalesce(down, F.lit(0.0)))
    return edge.withColumn(out, 1 / (1 + F.exp(-12 * (F.col(diff) + 0.3 * (F.col("__x") + F.col("__y")) - 0.22)))).drop("__x", "__y")


def change_consensus(df: DataFrame, by: list[str], a: Column, b: Column, base: float) -> DataFrame:
    """Overlap of two change masks in percent and the confidence it leaves."""
    out = df.groupBy(*by).agg(F.count_if(a & b).alias("__i"), F.count_if(a | b).alias("__u"))
    out = out.withColumn("iou_percent", F.coalesce(F.try_divide(100.0 * F.col("__i"), F.col("__u")), F.lit(0.0))).drop("__i", "__u")
    return out.withColumn("confidence", 0.5 * base + 0.5 * F.least(F.lit(1.0), F.col("iou_percent") / 70))


def change_kind(df: DataFrame, by: list[str], changed: Column, green_change: Column, light_change: Column) -> DataFrame:
    """A name for the change, from the mean change of greenness and light in changed pixels."""
    s = df.groupBy(*by).agg(F.avg(F.when(changed, green_change)).alias("greenness"), F.avg(F.when(changed, light_change)).alias("light"))
    g, x = F.col("greenness"), F.col("light")
    kind = F.when(g < -0.05, "vegetation_loss").when(g > 0.05, "vegetation_growth").when(x > 0.08, "built_up_expansion").when(x < -0.10, "water_expansion").otherwise("surface_modification")
    return s.withColumn("kind", kind)


def class_shift(df: DataFrame, label: str, date: Column, least: float = 2.0) -> DataFrame:
    """(label, before, after, shift) in percent of each date's pixels, for classes that moved by ``least`` points or more.

    ``date`` is 0 or 1. The totals come from the class counts, so the table is read and shuffled once.
    """
    n = df.groupBy(label).agg(F.count_if(date == 0).alias("b"), F.count_if(date == 1).alias("a"))
    every = W.partitionBy(F.lit(0))
    out = n.select(label, F.coalesce(F.try_divide(100.0 * F.col("b"), F.sum("b").over(every)), F.lit(0.0)).alias("before"), F.coalesce(F.try_divide(100.0 * F.col("a"), F.sum("a").over(every)), F.lit(0.0)).alias("after"))
    return out.withColumn("shift", F.col("after") - F.col("before")).where(F.abs(F.round("shift", 9)) >= least)


def change_significance(percent: Column, directional: Column, least: float = 0.5) -> tuple[Column, Column]:
    """Whether a change is significant, and whether it supports the claim (NULL unless the question has a direction)."""
    return percent >= least, F.when(directional, percent >= least)


def cosine(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """Cosine of two flattened grids, clipped to -1..1; 0 if either is zero."""
    s = df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    x = F.coalesce(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0))
    return s.select(*by, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)).alias("cosine"))


def sensor_agreement(df: DataFrame, by: list[str], optical: Column, radar: Column, base: float = 0.62, slope: float = 0.35, most: float = 0.91) -> DataFrame:
    """Agreement of an optical and a radar mask, with the confidence of a confirmed finding."""
    out = agreement(df, by, optical, radar)
    return out.withColumn("confidence", F.least(F.lit(most), base + slope * F.coalesce("iou", F.lit(0.0))))


def clear_dates(df: DataFrame, date: str, cloud: Column, snow: Column, most: float = 0.05) -> DataFrame:
    """Dates whose pixels are free of cloud and snow but for a share ``most``; if there are none, free of snow only."""
    s = df.groupBy(date).agg(F.avg((~cloud & ~snow).cast("double")).alias("__both"), F.avg((~snow).cast("double")).alias("__snow"))
    s = s.withColumn("__any", F.max(F.col("__both") >= 1 - most).over(W.partitionBy(F.lit(0))))
    return s.where(F.when(F.col("__any"), F.col("__both") >= 1 - most).otherwise(F.col("__snow") >= 1 - most)).select(date)


def day_offset(date: Column, month: int, day: int) -> Column:
    """Days from a reference day of the same year, of text yyyyMMdd; NULL for anything else."""
    at = F.when(date.rlike(r"^\d{8}$"), F.try_to_timestamp(date, F.lit("yyyyMMdd")).cast("date"))
    return F.datediff(at, F.make_date(F.year(at), F.lit(month), F.lit(day)))


def time_steps(band: Column, channels: int) -> tuple[Column, Column]:
    """A band's number to (time, channel)."""
    return F.floor(band / channels).cast("int"), (band % channels).cast("int")
