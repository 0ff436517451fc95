"""Moving-window operators over pixel tables, as window frames by row and by column; never partitioned by scene alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grids import on_halo_tiles


class Grid:
    """Names of a pixel table's keys: scene columns, row and column."""

    def __init__(self, row: str = "r", col: str = "c", scene: tuple[str, ...] = ()):
        self.row, self.col, self.scene = row, col, scene

    def along(self, axis: str):
        return W.partitionBy(*self.scene, self.row if axis == "x" else self.col).orderBy(self.col if axis == "x" else self.row)

    def frame(self, axis: str, h: int):
        return self.along(axis).rangeBetween(-h, h)


GRID = Grid()


def box(df: DataFrame, sums: dict[str, Column], k: int, grid: Grid = GRID) -> DataFrame:
    """k x k sums of several columns at once, in two passes that share their shuffles; cells outside count nothing."""
    h = k // 2
    for axis in ("x", "y"):
        f = grid.frame(axis, h)
        df = df.withColumns({n: F.sum(x if axis == "x" else F.col(n)).over(f) for n, x in sums.items()})
    return df


def box_mean(df: DataFrame, value: str, k: int, out: str, grid: Grid = GRID) -> DataFrame:
    """Mean of the cells there are in the window: missing and NULL cells have no weight."""
    v = F.col(value)
    df = box(df, {"__s": F.coalesce(v, F.lit(0.0)), "__n": v.isNotNull().cast("int")}, k, grid)
    return df.withColumn(out, F.try_divide(F.col("__s"), F.col("__n"))).drop("__s", "__n")


def local_std(df: DataFrame, value: str, k: int, out: str, grid: Grid = GRID) -> DataFrame:
    v = F.col(value)
    df = box(df, {"__s": v, "__q": v * v, "__n": v.isNotNull().cast("int")}, k, grid)
    m = F.try_divide(F.col("__s"), F.col("__n"))
    return df.withColumn(out, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("__q"), F.col("__n")) - m * m))).drop("__s", "__q", "__n")


def sobel(df: DataFrame, value: str, out: str, grid: Grid = GRID) -> DataFrame:
    """Gradient magnitude, kernel 1-2-1 by -1-0-1, divided by 4; the edge repeats its own cell."""
    x, y, v = grid.along("x"), grid.along("y"), F.col(value)
    near = lambda c, w, n: F.coalesce(F.lag(c, n).over(w) if n > 0 else F.lead(c, -n).over(w), F.col(c))
    df = df.withColumns({"__dx": near(value, x, -1) - near(value, x, 1), "__sx": near(value, x, 1) + 2 * v + near(value, x, -1)})
    gx = (near("__dx", y, 1) + 2 * F.col("__dx") + near("__dx", y, -1)) / 4
    gy = (near("__sx", y, -1) - near("__sx", y, 1)) / 4
    return df.withColumns({"__gx": gx, "__gy": gy}).withColumn(out, F.sqrt(F.col("__gx") ** 2 + F.col("__gy") ** 2)).drop("__dx", "__sx", "__gx", "__gy")


def edge_density(df: DataFrame, value: str, threshold: float, k: int, out: str, grid: Grid = GRID) -> DataFrame:
    df = sobel(df, value, "__g", grid).withColumn("__e", (F.col("__g") > threshold).cast("double"))
    return box_mean(df, "__e", k, out, grid).drop("__g", "__e")


def _morph(df: DataFrame, mask: str, out: str, agg, n: int, cross: bool, grid: Grid) -> DataFrame:
    df = df.withColumn(out, F.col(mask))
    for _ in range(n):
        if cross:
            both = {f"__{a}": agg(out).over(grid.frame(a, 1)) for a in ("x", "y")}
            join = (F.col("__x") | F.col("__y")) if agg is F.bool_or else (F.col("__x") & F.col("__y"))
            df = df.withColumns(both).withColumn(out, join).drop("__x", "__y")
        else:
            for axis in ("x", "y"):
                df = df.withColumn(out, agg(out).over(grid.frame(axis, 1)))
    return df


def dilate(df: DataFrame, mask: str, out: str, n: int = 1, cross: bool = False, grid: Grid = GRID) -> DataFrame:
    return _morph(df, mask, out, F.bool_or, n, cross, grid)


def erode(df: DataFrame, mask: str, out: str, n: int = 1, cross: bool = False, grid: Grid = GRID) -> DataFrame:
    """Cells outside the table do not erode; give a table with a margin of false cells where they should."""
    return _morph(df, mask, out, F.bool_and, n, cross, grid)


def opened(df: DataFrame, mask: str, out: str, grid: Grid = GRID) -> DataFrame:
    return dilate(erode(df, mask, "__o", grid=grid), "__o", out, grid=grid).drop("__o")


def closed(df: DataFrame, mask: str, out: str, grid: Grid = GRID) -> DataFrame:
    return erode(dilate(df, mask, "__o", grid=grid), "__o", out, grid=grid).drop("__o")


def denoise(df: DataFrame, mask: str, out: str, least: int = 4, grid: Grid = GRID) -> DataFrame:
    """A true cell stays if at least so many of its 3 x 3 are true, itself included; outside counts as false."""
    return box(df, {"__n": F.col(mask).cast("int")}, 3, grid).withColumn(out, F.col(mask) & (F.col("__n") >= least)).drop("__n")


def ssim(df: DataFrame, a: str, b: str, out: str, k: int = 7, c1: float = 0.01**2, c2: float = 0.03**2, grid: Grid = GRID) -> DataFrame:
    """Structural discrepancy 1 - (ssim + 1) / 2 of two grids; five moving sums in two shuffles."""
    x, y = F.col(a), F.col(b)
    df = box(df, {"__x": x, "__y": y, "__xx": x * x, "__yy": y * y, "__xy": x * y, "__n": (x + y).isNotNull().cast("int")}, k, grid)
    m = {s: F.col(f"__{s}") / F.col("__n") for s in ("x", "y", "xx", "yy", "xy")}
    vx, vy, cov = m["xx"] - m["x"] * m["x"], m["yy"] - m["y"] * m["y"], m["xy"] - m["x"] * m["y"]
    value = ((2 * m["x"] * m["y"] + c1) * (2 * cov + c2)) / ((m["x"] * m["x"] + m["y"] * m["y"] + c1) * (vx + vy + c2))
    return df.withColumn(out, 1 - (F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value)) + 1) / 2).drop("__x", "__y", "__xx", "__yy", "__xy", "__n")


def gradient(df: DataFrame, value: str, axis: str, out: str, grid: Grid = GRID) -> DataFrame:
    """Central differences inside, one-sided at the edges."""
    w, v = grid.along(axis), F.col(value)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(out, F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2))


def laplace_variance(df: DataFrame, value: str, grid: Grid = GRID) -> DataFrame:
    """Blur measure: population variance of the 4-neighbour Laplacian of inner cells, per scene."""
    x, y = grid.along("x"), grid.along("y")
    lap = F.lag(value).over(x) + F.lead(value).over(x) + F.lag(value).over(y) + F.lead(value).over(y) - 4 * F.col(value)
    return df.withColumn("__l", lap).groupBy(*grid.scene).agg(F.var_pop("__l").alias("laplace_variance"))


def illumination_drop(df: DataFrame, value: str, k: int, out: str, floor: float = 0.05, grid: Grid = GRID) -> DataFrame:
    df = box_mean(df, value, k, "__m", grid)
    return df.withColumn(out, (F.col("__m") - F.col(value)) / F.greatest(F.col("__m"), F.lit(floor))).drop("__m")


def boundary(df: DataFrame, label: str, out: str, grid: Grid = GRID) -> DataFrame:
    """A labelled cell with a 4-neighbour of another label, the table's border included; label 0 or NULL is outside."""
    own = F.coalesce(F.col(label).cast("long"), F.lit(0).cast("long"))
    df = df.withColumn("__v", own)
    near = [f("__v").over(grid.along(a)) for a in ("x", "y") for f in (F.lag, F.lead)]
    differs = [F.coalesce(n, F.lit(0).cast("long")) != F.col("__v") for n in near]
    return df.withColumns({f"__d{i}": d for i, d in enumerate(differs)}).withColumn(out, (F.col("__v") != 0) & (F.col("__d0") | F.col("__d1") | F.col("__d2") | F.col("__d3"))).drop("__v", "__d0", "__d1", "__d2", "__d3")


def adjacency_zone(df: DataFrame, mask: str, out: str, n: int = 1, grid: Grid = GRID) -> DataFrame:
    return dilate(df, mask, "__z", n, grid=grid).withColumn(out, F.col("__z") & ~F.col(mask)).drop("__z")


def window_median(grid: np.ndarray, k: int) -> np.ndarray:
    """Median of the k x k cells around each inner cell of a padded grid, of those that are not NaN; NaN where none is."""
    sides = np.lib.stride_tricks.sliding_window_view(grid, (k, k))
    out = np.empty(sides.shape[:2])
    for i in range(len(out)):  # a row of windows at a time bounds the copy
        row = np.sort(sides[i].reshape(out.shape[1], -1), axis=1)  # NaN last
        n = (~np.isnan(row)).sum(axis=1)
        at = np.arange(len(row))
        out[i] = (row[at, np.maximum(n - 1, 0) // 2] + row[at, np.minimum(n // 2, k * k - 1)]) / 2
        out[i, n == 0] = np.nan
    return out


def median_filter(df: DataFrame, value: str, k: int, out: str, grid: Grid = GRID, tile: int = 256) -> DataFrame:
    """df with the median of the k x k cells there are; missing and NULL cells have no weight.

    Each tile is filtered with the cells of a halo around it: one shuffle of (1 + (k - 1) / tile)^2 rows a cell.
    """
    if k % 2 == 0:
        raise ValueError("a window has a middle")
    keys = [*grid.scene, grid.row, grid.col]
    cells = df.select(*grid.scene, F.col(grid.row).cast("long").alias("r"), F.col(grid.col).cast("long").alias("c"), F.col(value).alias("__v"))
    made = on_halo_tiles(cells, "__v", max(tile, k // 2), k // 2, lambda g: window_median(g, k), tuple(grid.scene), out)
    typed = made.select(*grid.scene, F.col("r").cast(df.schema[grid.row].dataType).alias(grid.row), F.col("c").cast(df.schema[grid.col].dataType).alias(grid.col), out)
    return df.join(typed, keys)
