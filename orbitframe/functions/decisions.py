"""Rules on scenes, pairs and runs, and the final verdicts. Words and numbers of the rules are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPTICAL = ("building_detection_evidence", "water_grounding_evidence", "land_cover_classification", "spectral_water_analysis", "optical_scene_evidence")
RADAR = ("sar_structural_evidence", "sar_specular_evidence", "croma_cross_attention_fusion", "cross_sensor_agreement")
#: Limitations that turn a supported claim into one supported with limitations, when a text holds one of them.
LIMITING = (
    "spectral index change cannot be computed",
    "physical ndvi calculation is not available",
    "physical ndbi calculation is not available",
    "physical ndwi calculation is not available",
    "required spectral bands are unavailable",
    "croma skipped because required input channels",
    "relative sar backscatter",
    "uncalibrated",
)


def problems(rules: list[tuple[str, str, Column]]) -> Column:
    """Array of struct(level, rule) of the rules (level, name, holds) that hold, in their order."""
    found = [F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(name).alias("rule"))) for level, name, holds in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def scene_rules(crs: Column, nodata: Column, bands: Column, indices: Column) -> Column:
    """Problems of one scene: nodata in percent, indices an array of the spectral indices it allows."""
    return problems([
        ("warning", "missing_crs", crs.isNull()),
        ("warning", "nodata", nodata > 40),
        ("blocker", "no_usable_pixels", nodata >= 99.9),
        ("blocker", "no_bands", bands < 1),
        ("warning", "no_index", F.size(indices) == 0),
    ])


def pair_rules(a: dict[str, Column], b: dict[str, Column], strict: bool = True) -> tuple[Column, Column, Column]:
    """(overlap, alignment, problems) of two scenes with crs, width, height, res and box x0, y0, x1, y1 in one projection.

    The overlap is shared area over the larger footprint, and under 0.8 blocks; the lenient form takes the smaller footprint
    and blocks under 0.1. One scene without a projection blocks; two without are compared by shape.
    """
    zero = F.lit(0.0)
    both, none = a["crs"].isNotNull() & b["crs"].isNotNull(), a["crs"].isNull() & b["crs"].isNull()
    shape = (a["width"] == b["width"]) & (a["height"] == b["height"])
    slack = a["res"] if strict else a["res"] + b["res"]
    bounds = F.greatest(*[F.abs(a[k] - b[k]) for k in ("x0", "y0", "x1", "y1")]) <= slack
    wide = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    areas = [F.greatest(F.lit(1e-9), (x["x1"] - x["x0"]) * (x["y1"] - x["y0"])) for x in (a, b)]
    overlap = wide * high / (F.greatest(*areas) if strict else F.least(*areas))
    scale = F.greatest(a["res"], b["res"]) / F.greatest(F.least(a["res"], b["res"]), F.lit(1e-9))
    same = (a["crs"] == b["crs"]) & shape & bounds
    alignment = F.when(both, F.when(same, 1.0).otherwise(overlap / scale)).when(none, F.when(shape, 1.0).otherwise(0.85)).otherwise(0.0)
    apart = (overlap < 0.8) if strict else ~bounds & (overlap < 0.1)
    found = problems([
        ("warning", "different_crs", both & (a["crs"] != b["crs"])),
        ("warning", "different_shape", (both | none) & ~shape),
        ("blocker", "too_little_overlap", both & apart),
        ("warning", "partial_overlap", both & ~apart & ~bounds),
        ("blocker", "one_crs", ~both & ~none),
        ("warning", "pixel_space", none),
    ])
    return F.when(both, overlap), alignment, found


def policy_rules(needs_pair: Column, needs_dates: Column, tools: Column, images: Column, setup: Column, modalities: Column) -> Column:
    """Problems of a plan with its images: tools and modalities are arrays, setup names the kind of image set."""
    return problems([
        ("blocker", "pair_needed", needs_pair & (images != 2)),
        ("blocker", "dates_needed", needs_dates & ~setup.isin("PAIR_BITEMPORAL_OPTICAL", "PAIR_BITEMPORAL_SAR")),
        ("blocker", "sensors_needed", F.array_contains(tools, "fusion") & ~setup.isin("PAIR_OPTICAL_SAR", "PAIR_MULTISENSOR_BITEMPORAL")),
        ("blocker", "optical_needed", F.array_contains(tools, "buildings") & (F.size(F.array_except(modalities, F.array(F.lit("optical"), F.lit("multispectral")))) > 0)),
    ])


def water_rules(valid: Column, water: Column, parts: Column, outside: Column, foreign: Column, coastal: Column) -> tuple[Column, Column]:
    """(passed, problems): pixels valid, water, outside the valid area and without a finite probability; number of parts."""
    found = problems([
        ("blocker", "no_valid_pixels", valid == 0),
        ("blocker", "water_outside", (valid > 0) & (outside > 0)),
        ("blocker", "not_finite", (valid > 0) & (foreign > 0)),
        ("warning", "inland_cover", ~coastal & (100.0 * water > 85.0 * valid)),
        ("warning", "fragmented", parts > 1500),
    ])
    return ~F.exists(found, lambda x: x["level"] == "blocker"), found


def land_rules(share: dict[str, Column], witness: dict[str, Column], has_nir: Column) -> tuple[Column, Column]:
    """(passed, problems) of a mix in percent (water, built, plants, bare) beside a scene witness (water, urban; null: none)."""
    water, built, plants, bare = (share[k] for k in ("water", "built", "plants", "bare"))
    found = problems([
        ("warning", "water_witness", (water > 50) & (witness["water"] < 0.12)),
        ("warning", "built_witness", (built > 60) & (witness["urban"] < 0.10)),
        ("warning", "water_cover", (water > 65) & (plants + built < 5)),
        ("warning", "plant_cover", (plants > 85) & (water + built < 2)),
        ("warning", "bare_cover", (bare > 70) & (plants + water < 5)),
        ("warning", "visible_light_only", ~has_nir),
    ])
    return F.size(found) == 0, found


def instance_rules(count: Column, small: Column, unsure: Column, metres: Column, reliability: Column) -> tuple[Column, Column]:
    """(passed, problems) of counted objects: shares of small and unsure ones, coarse pixels, an unreliable count."""
    found = problems([
        ("warning", "none_found", count == 0),
        ("warning", "many_small", (count > 0) & (small / F.greatest(count, F.lit(1)) > 0.60)),
        ("warning", "many_unsure", (count > 0) & (unsure / F.greatest(count, F.lit(1)) > 0.50)),
        ("warning", "coarse", (count > 0) & (metres > 1.5)),
        ("warning", "unreliable", (count > 0) & (reliability == "COUNT_UNRELIABLE")),
    ])
    return (count == 0) | (F.size(found) == 0), found


def sensor(bands: Column, names: Column, order: tuple[str, ...]) -> Column:
    """The sensor of a band list, null if none fits: three bands are visible light, as many as ``order`` must be in that order."""
    rgb = (F.size(names) == 0) | (F.size(F.array_except(names, F.array(*map(F.lit, ("RED", "GREEN", "BLUE"))))) == 0) & (F.size(F.array_distinct(names)) == 3)
    return F.when((bands == 3) & rgb, "RGB_VHR").when((bands == len(order)) & (names == F.array(*map(F.lit, order))), "SENTINEL2_L1C_13B")


def metres_per_pixel(size: Column, degrees: Column, lat: Column) -> Column:
    """Projected sizes are metres; sizes in degrees become the longer of the two sides on a sphere at that latitude."""
    side = F.greatest(F.radians(size), F.radians(size) * F.cos(F.radians(lat))) * 6_371_008.8
    return F.when(degrees, side).otherwise(size)


def resolution_gate(metres: Column, model: Column) -> Column:
    """May a model see pixels of that size? Unknown sizes pass only where no size is asked for."""
    windows = {"aerial": (0.15, 0.60), "rgb": (0.01, 1.5), "medium": (8.0, 30.0), "sentinel2": (5.0, 65.0)}
    out = F.when((model == "aerial") & metres.isNull(), False)
    for name, (least, most) in windows.items():
        out = out.when(model == name, metres.isNull() | metres.between(least, most))
    return out.otherwise(True)


def thresholds_ok(foot: Column, rim: Column, area: Column, distance: Column, prominence: Column) -> Column:
    inside = lambda x: (x > 0) & (x < 1)
    return inside(foot) & inside(rim) & (area >= 1) & (distance >= 1) & (prominence > 0)


def calibrated(suffix: Column, crs: Column, dtype: Column, tags: Column, some_negative: Column) -> tuple[Column, Column]:
    """(calibrated, reason) of a radar image."""
    named = F.lower(tags).rlike("sigma0|gamma0|beta0|sentinel|radiometric|decibel")
    reason = F.when(suffix.isin(".png", ".jpg", ".jpeg", ".bmp", ".webp"), "rendered").when(crs.isNull(), "not_georeferenced").when(dtype == "uint8", "eight_bit")
    reason = reason.when(named, "named_product").when(some_negative, "physical_db").otherwise("no_metadata")
    return reason.isin("named_product", "physical_db"), reason


def witness_agreement(evidence: DataFrame, by: list[str]) -> DataFrame:
    """(by, agreements, disagreements, bonus) from evidence (kind, supports, dl_consensus, is_dl, found, cover, water_percent).

    Pairs of water and land-cover evidence of a run are compared; their number is a run's own, a handful.
    """
    water, land = F.col("kind") == "water_grounding_evidence", F.col("kind") == "land_cover_classification"
    pick = lambda kinds, value: F.coalesce(F.bool_or(F.col("kind").isin(*kinds) & (F.col("supports") == value)), F.lit(False))
    yes = evidence.groupBy(*by).agg(
        F.count_if(water & F.col("dl_consensus")).alias("consensus"), F.count_if(water & F.col("is_dl") & F.col("found")).alias("deep"),
        F.count_if(F.col("supports")).alias("supporting"), pick(OPTICAL, True).alias("oy"), pick(OPTICAL, False).alias("on"), pick(RADAR, True).alias("ry"), pick(RADAR, False).alias("rn"),
    )
    a = evidence.where(water & (F.col("cover") > 0)).select(*by, "cover")
    b = evidence.where(land & (F.col("water_percent") > 0)).select(*by, "water_percent")
    shares = F.least("cover", "water_percent") / F.greatest("cover", "water_percent")
    pairs = a.join(b, by).groupBy(*by).agg(
        F.count_if(shares > 0.5).alias("close"), F.count_if((shares < 0.2) & (F.abs(F.col("cover") - F.col("water_percent")) > 10)).alias("far")
    )
    out = yes.join(pairs, by, "left").fillna(0, ["close", "far"])
    both, split = F.col("oy") & F.col("ry"), (F.col("ry") & F.col("on")) | (F.col("oy") & F.col("rn"))
    many = F.col("supporting") >= 3
    one = lambda x: x.cast("int")
    split = ~both & split
    bonus = 0.03 * F.col("consensus") + 0.02 * F.col("deep") + 0.02 * F.col("close") - 0.03 * F.col("far") + 0.04 * one(both) - 0.05 * one(split) + 0.02 * one(many)
    return out.select(
        *by, (F.col("consensus") + F.col("deep") + F.col("close") + one(both) + one(many)).alias("agreements"), (F.col("far") + one(split)).alias("disagreements"),
        F.round(F.greatest(F.lit(-0.10), F.least(F.lit(0.10), bonus)), 3).alias("bonus"),
    )


def limiting(texts: Column) -> Column:
    return F.coalesce(F.exists(texts, lambda t: F.lower(t).rlike("|".join(LIMITING))), F.lit(False))


def verdict(blockers: Column, alignment: Column, items: Column, supports: Column, refutes: Column, claim: Column, missing_model: Column, limited: Column, quality: Column, score: Column, bonus: Column) -> tuple[Column, Column, Column]:
    """(status, confidence, kind) of a run by ordered rules.

    blockers and items are counts, supports and refutes tell whether any item does, claim is a status asked for or null,
    limited says that a limitation counts, score is the weighted confidence and bonus the witnesses' adjustment.
    """
    adjusted = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + bonus)), 3)
    with_limits = claim.eqNullSafe("supported_with_limitations")
    case = F.when(blockers > 0, "hard_input_rejection").when(alignment < 0.15, "severe_misalignment_abstention").when(items == 0, "empty_evidence_abstention")
    case = case.when(claim.eqNullSafe("disputed") | (refutes & ~supports), "disputed").when(missing_model & ~with_limits, "semantic_model_unavailable_abstention")
    case = case.when(with_limits | limited, "limited").otherwise("supported")
    told = case.isin("disputed", "limited", "supported")
    status = F.when(case == "disputed", "disputed").when(case == "limited", "supported_with_limitations").when(case == "supported", "supported").otherwise("insufficient_evidence")
    low = F.when(case == "severe_misalignment_abstention", F.round(alignment * 0.2, 3)).when(case == "semantic_model_unavailable_abstention", F.round(F.least(F.lit(0.49), quality * 0.45), 3))
    return status, F.when(told, adjusted).otherwise(F.coalesce(low, F.lit(0.0))), F.when(told, "evidence_weighted_spatial_ensemble_v2").otherwise(case)


def verdict_strict(unclear: Column, blockers: Column, task: Column, evidence: Column, user_point: Column, unreliable: Column, f1: Column, withheld: Column, insufficient: Column) -> Column:
    """Status by the stricter rules: what a later rule says of the evidence outweighs an earlier one."""
    lacking = F.when(task == "water_analysis", "insufficient_evidence").otherwise("low_confidence")
    weak = F.coalesce(unreliable, F.lit(False)) | F.coalesce(f1 < 0.6, F.lit(False)) | F.coalesce(withheld > 0.5, F.lit(False))
    by_evidence = F.when(insufficient, lacking).when(weak, "low_confidence").when((evidence > 0) & user_point, "supported")
    by_evidence = by_evidence.when(evidence > 0, "supported_with_limitations").otherwise("insufficient_evidence")
    return F.when(unclear, "insufficient_evidence").when(blockers > 0, "invalid_input").when(task == "unsupported", "unsupported_task").otherwise(by_evidence)
