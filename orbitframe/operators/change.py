"""Change maps of two dates, agreement of two sensors, and the report of a tile search. Numbers are fixed values of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written as _written
from . import aggregates as A
from . import focal as N
from .pairs import radiometric_normalization
from .regions import label_components
from .tiles import rank_tiles


def _cleaned(df: DataFrame, mask: str, out: str, grid: N.Grid) -> DataFrame:
    """Opening and closing by 3 x 3, where cells outside the scene are false."""
    df = N.dilate(N.denoise(df, mask, "__e", 9, grid), "__e", "__o", grid=grid)
    df = N.denoise(N.dilate(df, "__o", "__d", grid=grid), "__d", out, 9, grid)
    return df.drop("__e", "__o", "__d")


def change_baseline(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, r, c, p, changed): chance of change from differences and lost structure, cut at the histogram's valley and cleaned.

    Cells without both dates are left out. The cut is the lower edge of Otsu's bin, within 0.08 to 0.45; 0.15 where all
    cells fall into one bin.
    """
    grid = N.Grid(scene=tuple(by))
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, "r", "c", F.col(a).alias("__a"), F.col(b).alias("__b"))
    both = N.ssim(radiometric_normalization(both, by, "__a", "__b", "__moved"), "__a", "__moved", "__s", grid=grid)
    both = _written(both.select(*by, "r", "c", (0.55 * F.abs(F.col("__a") - F.col("__moved")) + 0.45 * F.col("__s")).alias("p")))
    bins = F.floor(F.least(F.col("p"), F.lit(1.0)) * 256)
    flat = both.groupBy(*by).agg((F.min(bins) == F.max(bins)).alias("__flat"))
    cut = A.with_group(A.otsu(both, by, F.col("p"), clip=(0.0, 1.0)), F.broadcast(flat), by)  # a row per scene, as below
    cut = cut.withColumn("threshold", F.when(F.col("__flat"), 0.15).otherwise(F.least(F.lit(0.45), F.greatest(F.lit(0.08), F.col("threshold") - 1 / 256))))
    marked = A.with_group(both, F.broadcast(cut.drop("__flat")), by).withColumn("__m", F.col("p") >= F.coalesce("threshold", F.lit(0.15)))
    return _cleaned(marked, "__m", "changed", grid).select(*by, "r", "c", "p", "changed")


def change_radiometric(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, r, c, d, changed): differences on one stretch of both dates (2nd to 98th percentile, else least to most) against a
    robust threshold, without lone cells.

    Percentiles read their input several times, so both grids of values are written to the shared folder.
    """
    both = _written(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, "r", "c", F.col(a).alias("__a"), F.col(b).alias("__b")))
    values = both.select(*by, F.explode(F.array("__a", "__b")).alias("__v"))
    ends = A.with_group(A.exact_percentiles(values, by, F.col("__v"), {"__lo": 0.02, "__hi": 0.98}), values.groupBy(*by).agg(F.min("__v").alias("__least"), F.max("__v").alias("__most")), by)
    wide = F.col("__hi") > F.col("__lo")
    ends = ends.select(*by, F.when(wide, F.col("__lo")).otherwise(F.col("__least")).alias("__lo"), F.when(wide, F.col("__hi")).otherwise(F.col("__most")).alias("__hi"))
    unit = lambda x: F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col(x) - F.col("__lo"), F.col("__hi") - F.col("__lo"))))).otherwise(0.0)
    both = A.with_group(both, F.broadcast(ends), by).withColumns({"__a": unit("__a"), "__b": unit("__b")}).drop("__lo", "__hi")
    both = _written(radiometric_normalization(both, by, "__a", "__b", "__moved").select(*by, "r", "c", F.abs(F.col("__a") - F.col("__moved")).alias("d")))
    limit = A.robust_threshold(both, by, F.col("d")).select(*by, "threshold")
    marked = A.with_group(both, F.broadcast(limit), by).withColumn("__m", F.col("d") > F.col("threshold"))
    return N.denoise(marked, "__m", "changed", grid=N.Grid(scene=tuple(by))).select(*by, "r", "c", "d", "changed")


def change_summary(df: DataFrame, by: list[str], strength: str) -> DataFrame:
    """Changed cells, their share in percent and mean strength."""
    out = df.groupBy(*by).agg(F.count_if("changed").alias("changed"), F.count("*").alias("cells"), F.avg(F.when(F.col("changed"), F.col(strength))).alias("__m"))
    return out.select(*by, "changed", "cells", F.round(100 * F.col("changed") / F.col("cells"), 3).alias("percent"), F.round(F.coalesce("__m", F.lit(0.0)), 4).alias("intensity"))


def fusion_masks(target: str, light: Column, radar: Column, index: Column | None = None, red: Column | None = None, green: Column | None = None) -> tuple[Column, Column]:
    """(optical, radar) masks of a target on radar stretched to 0..1; index is the target's spectral index, where there is one."""
    if target == "water":
        return (light <= 0.25 if index is None else index >= 0.12), radar <= 0.28
    if target == "built-up":
        return light >= 0.40, radar >= 0.55
    if target == "vegetation":
        return (green > red if index is None else index >= 0.35), radar.between(0.35, 0.70)
    return light >= 0.30, radar >= 0.35


# The words by which a question names what two sensors are compared for, first match first.
FUSION_WORDS = {
    "built-up": ("built", "urban", "building", "structure", "settlement"),
    "vegetation": ("vegetation", "forest", "crop", "canopy"),
    "water": ("water", "river", "lake", "flood", "ocean", "sea"),
    "general": ("compare", "show", "difference", "information", "additional"),
}


def fusion_target(target: Column, question: Column) -> Column:
    """What two sensors are compared for: the first target that is given or named by the question, else what is given, else water."""
    given = F.nullif(target, F.lit(""))
    out = F
    for name, words in FUSION_WORDS.items():
        out = out.when(F.coalesce(given == name, F.lit(False)) | F.coalesce(F.lower(question).rlike("|".join(words)), F.lit(False)), F.lit(name))
    return out.otherwise(F.coalesce(given, F.lit("water")))


def fused_masks(df: DataFrame, target: Column, multispectral: Column, light: Column, radar: Column, ndwi: Column, ndvi: Column, red: Column, green: Column) -> DataFrame:
    """df with optical and radar masks by each row's own target and ``seen``: both, optical, radar, or NULL where neither is true.

    Spectral indices decide where the scene has them, brightness or colour elsewhere; built-up and general comparison use
    brightness alone. A cell whose value is NULL or NaN is in no mask. Targets without rules are compared as general.
    """
    known = {"water": ndwi, "built-up": None, "vegetation": ndvi, "general": None}
    yes = lambda x: F.coalesce(x, F.lit(False))
    clean = lambda x: F.nanvl(x, F.lit(None).cast("double"))
    light, radar, red, green = map(clean, (light, radar, red, green))
    optical = echo = F
    for name, index in known.items():
        plain, echoed = fusion_masks(name, light, radar, None, red, green)
        rich = plain if index is None else fusion_masks(name, light, radar, clean(index))[0]
        here = F.lit(True) if name == "general" else target == name
        optical, echo = optical.when(here, yes(F.when(multispectral, rich).otherwise(plain))), echo.when(here, yes(echoed))
    df = df.withColumns({"optical": optical, "radar": echo})
    return df.withColumn("seen", F.when(F.col("optical") & F.col("radar"), "both").when(F.col("optical"), "optical").when(F.col("radar"), "radar"))


def sensor_fusion(df: DataFrame, by: list[str], optical: Column, radar: Column, multispectral: bool | Column = True) -> DataFrame:
    """(by, agreement, iou_percent, confirmed_percent, confidence) of two sensors' masks; NULL cells are in neither.

    ``multispectral`` may be an expression of the columns in ``by``.
    """
    optical, radar = (F.coalesce(x, F.lit(False)) for x in (optical, radar))
    out = df.groupBy(*by).agg(F.count_if(optical & radar).alias("i"), F.count_if(optical | radar).alias("u"), F.count("*").alias("n"))
    share = F.col("i") / F.greatest(F.col("u"), F.lit(1))
    agreement = F.round(share, 3)
    base = F.when(F.lit(multispectral) if isinstance(multispectral, bool) else multispectral, 0.88).otherwise(0.82)
    confidence = 0.4 * base + 0.6 * F.least(F.lit(1.0), F.greatest(F.lit(0.1), agreement / 0.60))
    return out.select(*by, agreement.alias("agreement"), F.round(share * 100, 2).alias("iou_percent"), F.round(100 * F.col("i") / F.col("n"), 3).alias("confirmed_percent"), F.round(confidence, 3).alias("confidence"))


def counted_regions(cells: DataFrame, by: list[str], width: int, least: int = 4, tile: int = 256) -> DataFrame:
    """(by, regions, region_pixels): regions by side of the cells (by, r, c) that have at least ``least`` cells."""
    labels = label_components(cells.select(*by, "r", "c"), width, tile=tile, by=tuple(by))
    sizes = labels.groupBy(*by, "label").agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    return sizes.groupBy(*by).agg(F.count("*").alias("regions"), F.sum("__n").alias("region_pixels"))


def _with_regions(told: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """told with both counts; 0 where no region is left."""
    out = told.join(regions, by, "left") if by else told.crossJoin(F.broadcast(regions))  # one row
    return out.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("regions", "region_pixels")})


def fusion_report(cells: DataFrame, by: list[str], width: int, multispectral: Column, tile: int = 256) -> DataFrame:
    """What ``sensor_fusion`` says of ``fused_masks``' cells, with the regions that both sensors confirm and their cells.

    ``by`` names the scene and whatever is equal in all of it, as the target; its columns may not be NULL.
    """
    cells = _written(cells.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "optical", "radar"))
    told = sensor_fusion(cells, by, F.col("optical"), F.col("radar"), multispectral)
    return _with_regions(told, counted_regions(cells.where("optical AND radar"), by, width, tile=tile), by)


def retrieval_report(tiles: DataFrame, kept: Column, threshold: Column, score: str = "score", key: str = "id") -> DataFrame:
    """(key, score, rank, is_relevant, reason): kept tiles first, each group by falling score; why the others were left out."""
    told = tiles.withColumn("__kept", kept).withColumn("__below", F.col(score) < threshold)
    pair = F.format_string("(%s < %s)", *(F.format_number(x, 2) for x in (F.col(score), threshold)))
    reason = F.when(F.col("__kept"), None).when(F.col("__below"), F.concat(F.lit("below the threshold "), pair)).otherwise("overlaps a better tile")
    ranked = rank_tiles(told.withColumn("reason", reason), F.col("__kept"), score, key)
    return ranked.select(key, score, "rank", F.col("__kept").alias("is_relevant"), "reason")


def retrieval_summary(tiles: DataFrame, kept: Column, threshold: float | Column, score: str = "score", external: float = 0.85) -> DataFrame:
    """Counts, mean and peak score of a search and its confidence; 0.35 where no tile is relevant."""
    out = tiles.agg(F.count("*").alias("tiles"), F.count_if(kept).alias("relevant"), F.avg(F.when(kept, F.col(score))).alias("__mean"), F.max(score).alias("peak"), F.max(threshold).alias("threshold"))
    found = F.col("relevant") > 0
    return out.select(
        "tiles", "relevant", (F.col("tiles") - F.col("relevant")).alias("excluded"), "threshold", F.when(found, F.round("__mean", 3)).otherwise(0.0).alias("mean"), "peak",
        F.when(found, F.round(0.4 * external + 0.6 * F.col("peak"), 3)).otherwise(0.35).alias("confidence"),
    )


def index_change(df: DataFrame, by: list[str], before: Column, after: Column, width: int, floor: float = 0.05, step: float = 0.12, increase: bool = True, tile: int = 256) -> DataFrame:
    """(by, changed_pixels, valid_pixels, changed_percent, regions, region_pixels, mean_changed, strength, confidence) of an index
    between two dates.

    A cell has changed that moved by ``step`` in the wanted direction and lies above ``floor`` at the date when there is
    more; cells with fewer than four changed ones among their 3 x 3 do not count. Regions are by side and have four cells or
    more, as ``region_pixels`` counts. Cells without both dates are left out; a scene without change has strength 0 and confidence 0.58.
    """
    cells = df.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), before.alias("__a"), after.alias("__b")).where("__a IS NOT NULL AND __b IS NOT NULL")
    move = F.col("__b") - F.col("__a")
    mask = (move >= step) & (F.col("__b") >= floor) if increase else (move <= -step) & (F.col("__a") >= floor)
    cells = _written(N.denoise(cells.withColumn("__m", mask), "__m", "changed", 4, N.Grid(scene=tuple(by))).select(*by, "r", "c", "changed", F.abs(move).alias("__d")))
    hit = F.when(F.col("changed"), F.col("__d"))
    told = cells.groupBy(*by).agg(F.count_if("changed").alias("changed_pixels"), F.count("*").alias("valid_pixels"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("mean_changed"))
    regions = counted_regions(cells.where("changed"), by, width, tile=tile)
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("mean_changed") / 0.4))
    out = _with_regions(told, regions, by)
    confidence = F.when(F.col("changed_pixels") > 0, F.round(0.67 + 0.18 * strength, 3)).otherwise(0.58)
    return out.select(*by, "changed_pixels", "valid_pixels", (100.0 * F.col("changed_pixels") / F.col("valid_pixels")).alias("changed_percent"), "regions", "region_pixels", "mean_changed", strength.alias("strength"), confidence.alias("confidence"))
