"""Radiometry as column expressions: indices, colour measures, stretches and unit changes. NULL in, NULL out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    """greatest/least skip NULL in Spark, so NULL is kept by hand."""
    return F.when(x.isNotNull(), F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x)))


def normalized_difference(a: Column, b: Column, least: float = 1e-7) -> Column:
    """(a - b) / (a + b) clipped to -1..1; NULL where |a + b| is too small."""
    return F.when(F.abs(a + b) > least, clip((a - b) / (a + b), -1, 1))


def nd_eps(a: Column, b: Column, eps: float = 1e-7, fill: float = -1.0) -> Column:
    return F.coalesce((a - b) / (a + b + F.lit(eps)), F.lit(float(fill)))


def mndwi(green: Column, swir: Column) -> Column:
    return normalized_difference(green, swir)


def awei_shadow(blue: Column, green: Column, nir: Column, swir1: Column, swir2: Column, limit: float | None = None) -> Column:
    x = blue + 2.5 * green - 1.5 * (nir + swir1) - 0.25 * swir2
    return x if limit is None else clip(x, -limit, limit)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def brightness(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3


def ndbr(r: Column, b: Column, eps: float = 1e-5) -> Column:
    return (b - r) / (b + r + F.lit(eps))


def ndgr(r: Column, g: Column, eps: float = 1e-5) -> Column:
    return (g - r) / (g + r + F.lit(eps))


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b


def redness(r: Column, g: Column, b: Column) -> Column:
    return r - (g + b) / 2


def greenness(r: Column, g: Column, b: Column) -> Column:
    return g - (r + b) / 2


def colour_spread(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(F.abs(r - g), F.abs(g - b), F.abs(r - b))


def saturation(r: Column, g: Column, b: Column) -> Column:
    hi = F.greatest(r, g, b)
    return F.when(hi > 1e-6, (hi - F.least(r, g, b)) / hi).otherwise(0.0)


def neutrality(r: Column, g: Column, b: Column, full: float = 0.35) -> Column:
    return 1 - clip(saturation(r, g, b) / full, 0, 1)


def range_stretch(x: Column, lo: float, hi: float) -> Column:
    """lo..hi to 0..1 with clip: decibels -30..0, reflectance 0..3000 and so on."""
    return clip((x - lo) / (hi - lo), 0, 1)


def standardize(x: Column, mean: float, std: float) -> Column:
    return (x - mean) / std


def to_db(x: Column, units: str) -> Column:
    """Decibels from db, intensity, power or amplitude; values not above 0 become NULL."""
    if units == "db":
        return x
    factor = {"intensity": 10.0, "power": 10.0, "amplitude": 20.0}.get(units)
    if factor is None:
        raise ValueError(f"unknown radar units: {units}")
    return F.when(x > 0, factor * F.log10(x))


def dual_pol_ratio(vv_db: Column, vh_db: Column) -> Column:
    return vh_db - vv_db


def logistic(x: Column, k: float = 12.0, x0: float = 0.22) -> Column:
    return 1 / (1 + F.exp(-k * (x - x0)))


def ramp(x: Column, lo: float, hi: float) -> Column:
    return clip((x - lo) / (hi - lo), 0, 1)


def cap_where(p: Column, cond: Column, v: float) -> Column:
    return F.when(cond, F.least(p, F.lit(float(v)))).otherwise(p)


def raise_where(p: Column, cond: Column, v: float) -> Column:
    return F.when(cond, F.greatest(p, F.lit(float(v)))).otherwise(p)


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == label).cast("int"))


def elevation_difference(surface: Column, terrain: Column) -> Column:
    return surface - terrain


def pixel_to_world(row: Column, col: Column, affine: Sequence[float], centre: bool = True) -> tuple[Column, Column]:
    """x = a col + b row + c, y = d col + e row + f, of the pixel's centre or upper left corner."""
    a, b, c, d, e, f = map(float, affine)
    half = 0.5 if centre else 0.0
    x, y = col + half, row + half
    return a * x + b * y + c, d * x + e * y + f


def rescale_window(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Target size when the longer side may have at most so many pixels; rounds half to even, at least 1."""
    factor = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.bround(x * factor, 0).cast("int")) for x in (width, height))


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, w: a + w))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def probability_byte(p: Column) -> Column:
    return F.bround(p * 255, 0).cast("int")


def web_mercator(lon: Column, lat: Column, bounded: bool = True) -> tuple[Column, Column]:
    """EPSG 3857 of degrees; NULL outside the projection's range. Unbounded, the bare formula: NaN where it has no value."""
    r = 6378137.0
    rise = F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))
    x, y = F.radians(lon) * r, F.when(rise < 0, F.lit(float("nan"))).otherwise(F.log(rise) * r)
    ok = (F.abs(lat) <= 85.06) & (F.abs(lon) <= 180)
    return (F.when(ok, x), F.when(ok, y)) if bounded else (x, y)


def cell_area_m2(lat: Column, dlat: float, dlon: float) -> Column:
    """Area of a cell of degrees on the WGS84 ellipsoid (closed-form band area), centred at the latitude."""
    b2, e = 6356752.314245179**2, 0.08181919084262149

    def band(phi: Column) -> Column:
        s = F.sin(F.radians(phi))
        es = F.lit(e) * s
        return b2 * (s / (1 - es * es) / 2 + F.log((1 + es) / (1 - es)) / (4 * e))

    return F.abs(band(lat + dlat / 2) - band(lat - dlat / 2)) * abs(dlon) * 0.017453292519943295


def argmax(p: Column) -> Column:
    """Index of the largest element, ties to the lowest."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def margin(p: Column) -> Column:
    s = F.sort_array(p, asc=False)
    return F.get(s, F.lit(0)) - F.get(s, F.lit(1))


def vari(r: Column, g: Column, b: Column) -> Column:
    """Vegetation proxy without infrared, (g - r) / (g + r - b) in -1..1; -0.4 where the surface is not clearly green."""
    light = brightness(r, g, b)
    sand = (light > 0.45) & (colour_spread(r, g, b) < 0.08)
    soil = (r >= 0.98 * g) & (light > 0.08) & (light < 0.55)
    water = (b > 0.98 * g) & (b > 1.05 * r)
    other = (g <= 1.05 * r) | (g <= 0.98 * b) | sand | soil | water
    below = g + r - b
    return F.when(other, -0.4).when(F.abs(below) > 1e-6, clip((g - r) / below, -1.0, 1.0))


def builtup_proxy(r: Column, g: Column, b: Column) -> Column:
    """Built-up proxy without infrared; -0.4 where coloured or dark."""
    mean = (r + b) / 2
    coloured = F.greatest(F.abs(r - g), F.abs(g - b)) > 0.20
    return F.when(coloured | (mean < 0.25), -0.4).when(mean + g > 1e-6, (mean - g) / (mean + g + 1e-6))


def road_conflict(water: Column, built: Column, colour: Column) -> Column:
    """Built-up evidence outweighs water and colour gives no hint of water; such water is to be capped at 0.1."""
    return (built >= F.greatest(F.lit(0.35), 0.7 * water)) & (colour < 0.5)


def illumination_state(shadow: Column, valid: Column) -> Column:
    return F.when(~valid, "nodata").when(shadow >= 0.52, "shadowed").when(shadow >= 0.38, "uncertain").otherwise("normal")


def location_phrase(y: Column, x: Column, coverage: Column) -> Column:
    """Where a region lies, from its centre (0..1 from the upper left) and its share of the image in percent."""

    def third(at: Column, low: str, high: str) -> Column:
        return F.when(at < 0.42, low).when(at > 0.58, high)

    wide = F.concat(F.lit("broad marine/coastal expanse spanning the "), F.when(x < 0.5, "western").otherwise("eastern"), F.lit(" and offshore sectors"))
    v, h = third(y, "northern (upper)", "southern (lower)"), third(x, "western (left)", "eastern (right)")
    corner = F.when(v.isNotNull() & h.isNotNull(), F.concat(v, F.lit(" and "), h, F.lit(" sector")))
    return F.when(coverage >= 45, wide).otherwise(F.coalesce(corner, F.concat(F.coalesce(v, h, F.lit("central")), F.lit(" portion of the image"))))


def confidence_interval(score: Column, evidence: Column, quality: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % interval; pieces of evidence and quality (0..1) stand for the number of trials."""
    n = F.greatest(F.lit(3), 4 * evidence + F.floor(8 * quality))
    spread = 1.96 * F.sqrt(F.greatest(F.lit(1e-6), score * (1 - score) / n))
    return F.round(F.greatest(F.lit(0.0), score - spread), 3), F.round(F.least(F.lit(1.0), score + spread), 3)


def region_confidence(p: Column, base: float = 0.55, slope: float = 0.42, most: float = 0.97) -> Column:
    return F.round(F.least(F.lit(most), base + slope * p), 3)
