"""Decisions per pixel, region or run as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .radiometry import clip


def spectral_support(ndwi: Column, mndwi: Column, ndvi: Column, awei: Column, light: Column, cirrus: Column, limits: dict[str, float]) -> Column:
    """Water is likely by its spectrum: wet enough, not vegetation, not deep shadow, not cloud."""
    wet = (ndwi >= limits["ndwi_min"]) | (mndwi >= limits["mndwi_min"])
    return wet & (ndvi <= limits["ndvi_max"]) & (awei >= limits["awei_shadow_min"]) & (light >= limits["brightness_min"]) & (cirrus <= limits["cirrus_max"])


def fuse_classes(base: Column, confidence: Column, margin: Column, valid: Column, water: Column, support: Column, building: Column, least: float = 0.4, gap: float = 0.05, sure: float = 0.60) -> tuple[Column, Column]:
    """(class, confidence): buildings over supported water over the base class; invalid and ambiguous pixels are 0.

    Water is class 5, built-up class 1. The confidence is the winner's.
    """
    built = building >= sure
    wet = (water >= sure) & support
    kind = F.when(~valid, 0).when(built, 1).when(wet, 5).when((confidence < least) | (margin < gap), 0).otherwise(base)
    return kind.cast("int"), F.when(~valid, 0.0).when(built, building).when(wet, water).otherwise(confidence)


def veto_recover(water: Column, land_sure: Column, light: Column, witness: Column) -> tuple[Column, Column, Column]:
    """(mask, vetoed, recovered): bright pixels that a witness is sure are land go, those it gives 0.50 for water come."""
    vetoed = water & land_sure & (light >= 0.06)
    recovered = (witness >= 0.50) & ~(water & ~vetoed)
    return (water & ~vetoed) | recovered, vetoed, recovered


def strict_limit(percent: Column, threshold: Column, proxy: Column) -> Column:
    """A stricter index limit where a scene's coverage is implausibly large."""
    return F.when(proxy & (percent > 35), 0.30).when(percent > 60, clip(threshold + 0.08, 0.20, 0.35)).otherwise(threshold)


def tile_relevance(topic: Column, light: Column, green: Column, texture: Column, water: Column, red: Column, contrast: Column) -> Column:
    """How well a tile fits a topic, 0.10 to 0.98, three places."""
    wet = F.when(water >= 0.20, 0.75 + clip(water * 0.22, 0.0, 0.23)).otherwise(0.15 + clip(water * 1.5, 0.0, 0.25))
    score = (
        F.when(topic == "water", wet)
        .when(topic == "vegetation", 0.50 + clip(green * 3.5 + light * 0.2, -0.3, 0.45))
        .when(topic == "urban", 0.50 + clip(texture * 4.0 + light * 0.2, -0.3, 0.45))
        .when(topic == "soil", 0.50 + clip(red * 3.0 + light * 0.2, -0.3, 0.45))
        .otherwise(0.50 + clip(contrast * 1.5, -0.2, 0.40))
    )
    return F.round(clip(score, 0.10, 0.98), 3)


def footprint_overlap(a: tuple[Column, ...], b: tuple[Column, ...], a_res: Column, b_res: Column) -> tuple[Column, Column]:
    """(share, score) of boxes (x0, y0, x1, y1): intersection over the smaller area, divided by the ratio of resolutions."""
    zero = F.lit(0.0)
    inside = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = [F.greatest(F.lit(1e-9), (x[2] - x[0]) * (x[3] - x[1])) for x in (a, b)]
    share = inside / F.least(*area)
    return share, share / (F.greatest(a_res, b_res) / F.greatest(F.least(a_res, b_res), F.lit(1e-9)))


def logprob_probability(logprobs: Column, temperature: float = 1.32) -> Column:
    """Mean log probability, clipped to -20..0, as a calibrated probability."""
    mean = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + F.greatest(F.lit(-20.0), F.least(F.lit(0.0), x))) / F.size(logprobs)
    p = F.exp(mean)
    return F.when(F.size(logprobs) > 0, F.when((p <= 0) | (p >= 1), p).otherwise(1 / (1 + F.exp(-F.log(p / (1 - p)) / temperature))))


def weighted_confidence(quality: Column, alignment: Column, evidence: Column, agreement: Column, penalty: Column, model: Column, temperature: float = 1.32) -> Column:
    """Weighted parts (0.28, 0.22, 0.30, 0.20; 15 % for the model where it has a probability), penalty, temperature."""
    own = quality * 0.28 + alignment * 0.22 + evidence * 0.30 + agreement * 0.20
    raw = clip(F.when(model.isNotNull(), own * 0.85 + model * 0.15).otherwise(own) - penalty, 0.0, 0.99)
    return F.when((raw > 0) & (raw < 1), clip(1 / (1 + F.exp(-F.log(raw / (1 - raw)) / temperature)), 0.05, 0.98)).otherwise(raw)


def count_reliability(start: Column, f1: Column) -> Column:
    """A count is unreliable without a benchmark score of 0.6, and never better than approximate."""
    return F.when(f1.isNull() | (f1 < 0.6), "COUNT_UNRELIABLE").when(start == "COUNT_RELIABLE", "COUNT_APPROXIMATE").otherwise(start)
