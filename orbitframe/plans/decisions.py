"""Queries of surface rules, quality rules and verdicts, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as Q
from ..functions import surfaces as U
from ..sources import scenes as S
from .registry import PX, clip_sql, register, table

c = F.col


def given(name: str, source: str, keys: str, inputs: dict[str, str], outputs: Callable[[], dict[str, Column]], sql: dict[str, str], doubles: str = "", more: str = "") -> None:
    """A query of expressions over columns that Spark and DuckDB derive from a table by the same text."""
    names = keys.split(", ")
    chosen = [*names, *(f"{x} AS {n}" for n, x in inputs.items())]

    def make(s, d) -> DataFrame:
        df = S.derived_scene(s, d) if source == "s" else table(s, d, source)
        return df.selectExpr(*chosen).select(*names, *[x.alias(n) for n, x in outputs().items()])

    before = f"{PX}, " if source == "s" else ""
    text = f"WITH {before}q AS (SELECT {', '.join(chosen)} FROM {source}){more} SELECT {keys}, " + ", ".join(f"{x} AS {n}" for n, x in sql.items())
    register(name, make, f"{text} FROM {'q2' if more else 'q'}", doubles)


def told(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["level"], x["rule"])), ",")


def told_sql(*rules: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {holds} THEN '{name}' END" for name, holds in rules) + ")"


# F: surfaces --------------------------------------------------------------------------------------------------------
BANDS = {"red": "red", "green": "green", "blue": "swir2", "nir": "nir", "swir": "swir", "more": "nir2"}
rgb = lambda: (c("red"), c("green"), c("blue"))
_share = lambda a, b: f"(({a} - {b}) / ({a} + {b} + 1e-7))"
_WET = f"(0.5 * {_share('green', 'nir')} + 0.5 * {_share('green', 'swir')})"
_NEVER = f"({_share('nir', 'red')} > 0.18 OR (nir > green * 1.15 AND nir > red) OR ({_share('swir', 'nir')} > 0.02 AND nir < 0.20 AND swir > green * 1.10) OR ((green + nir + red) / 3 < 0.015 AND {_share('green', 'nir')} < 0.05))"
_SCORE = f"1 / (1 + exp(-12.0 * ({_WET} - 0.05)))"
given(
    "f05_multispectral_water_score", "s", "r, c", BANDS,
    lambda: {"score": U.multispectral_water_score(c("red"), c("green"), c("nir"), c("swir"))},
    {"score": f"CASE WHEN {_WET} IS NULL OR red IS NULL THEN 0 WHEN {_NEVER} THEN least({_SCORE}, 0.05) ELSE {_SCORE} END"}, "score",
)
_PLANT = "(2 * green - red - blue > 0.03 OR (green > blue * 1.30 AND green > red * 1.05))"
given(
    "f13_water_probability_suppression", "s", "r, c", BANDS,
    lambda: {"p": U.suppressed_water(c("more"), *rgb())},
    {"p": f"CASE WHEN {_PLANT} OR (red > blue * 1.15 AND green > blue * 0.95 AND red > 0.08) THEN least(more, 0.20) ELSE more END"}, "p",
)
given(
    "f12_land_cover_correction", "s", "r, c", BANDS | {"kind": "CASE WHEN nir > 0.5 THEN 5 ELSE 1 END"},
    lambda: {"kind": U.corrected_water(c("kind"), *rgb())},
    {"kind": """CASE WHEN kind <> 5 THEN kind WHEN red > blue * 1.15 AND green > blue * 0.95 AND red > 0.10 THEN 4
        WHEN 2 * green - red - blue > 0.03 OR (green > blue * 1.25 AND green > red * 1.04) THEN 2
        WHEN greatest(abs(red - green), abs(green - blue), abs(red - blue)) < 0.25 AND 0.299 * red + 0.587 * green + 0.114 * blue BETWEEN 0.12 AND 0.60 AND blue < 0.48 THEN 6 ELSE kind END"""},
)
_COVER = BANDS | {"ndvi": "nir - red", "ndwi": "green - nir", "ndbi": "swir - nir", "edges": "abs(red2 - red) / 2", "fall": "green2 - 0.4"}
given(
    "f11_land_cover_rules", "s", "r, c", _COVER,
    lambda: {"kind": U.land_cover_candidates(c("ndvi"), c("ndwi"), c("ndbi"), *rgb(), c("edges"), c("fall"))},
    {"kind": f"""CASE WHEN ndwi >= 0.18 AND ndvi < 0.05 AND blue > red * 1.15 AND NOT {_PLANT} AND NOT (red > blue * 1.12 AND green > blue * 0.95 AND (red + green + blue) / 3 > 0.10)
        AND NOT (green > red * 1.05 AND green > blue) AND NOT (fall > 0.20 AND (edges > 0.03 OR (red + green + blue) / 3 < 0.25)) AND (red + green + blue) / 3 < 0.55 AND edges < 0.10 THEN 1
        WHEN ndvi >= 0.38 THEN 2 WHEN ndvi >= 0.16 THEN 3
        WHEN ndvi < 0.08 AND abs(red - blue) < 0.09 AND abs(green - blue) < 0.09 AND (red + green + blue) / 3 BETWEEN 0.18 AND 0.68 AND edges > 0.06 THEN 4
        WHEN ndbi >= 0.06 OR edges > 0.12 OR ((red + green + blue) / 3 > 0.55 AND ndvi < 0.15) THEN 5
        WHEN ndvi >= 0.08 AND ndvi < 0.28 AND red > 0.18 THEN 6 ELSE 7 END"""},
)
_MASKS = {"valid": "red > 0.35", "water": "coalesce(green > 0.55, false)", "buildings": "coalesce(nir > 0.55, false)", "plants": "coalesce(swir > 0.5, false)", "model": "CAST(floor(red2 * 200) AS INT) % 16"}
given(
    "f17_compose_land_cover", "s", "r, c", _MASKS,
    lambda: {
        "detailed": U.composed_land_cover(c("valid"), c("water"), c("buildings"), c("plants"), c("model")),
        "plain": U.composed_land_cover(c("valid"), c("water"), c("buildings"), c("plants"), c("model"), False),
        "is_disputed": U.disputed(c("water"), c("buildings"), c("plants")),
    },
    {"detailed": """CASE WHEN NOT valid THEN 0 WHEN water THEN 1 WHEN plants AND NOT buildings AND coalesce(model IN (12, 13, 14), false) THEN 5
        WHEN (buildings OR coalesce(model = 3, false)) AND NOT plants THEN 3 WHEN plants AND NOT buildings AND NOT coalesce(model IN (9, 10, 11), false) THEN 2
        WHEN buildings THEN 4 WHEN model = 2 THEN 10 WHEN model = 7 THEN 9 WHEN model IN (9, 10, 11) THEN 8 WHEN model IN (4, 5) THEN 7 ELSE 4 END""",
     "plain": """CASE WHEN NOT valid THEN 0 WHEN water THEN 1 WHEN buildings THEN CASE WHEN plants THEN 4 ELSE 3 END WHEN coalesce(model = 4, false) AND NOT plants THEN 6
        WHEN plants AND coalesce(model = 2, false) THEN 5 WHEN plants THEN 2 ELSE 4 END""",
     "is_disputed": "(water AND buildings) OR (plants AND buildings) OR (water AND plants)"},
)
_ROOFS = {"kind": "CAST(floor(red * 300) AS INT) % 5 + 1", "roof": "green", "road": "nir", "other_roof": "2 * red2 - 0.6", "other_paved": "1.3 * green2"}
given(
    "f18_reconcile_roof_pavement", "s", "r, c", _ROOFS,
    lambda: {"kind": U.reconciled_roof(c("kind"), c("roof"), c("road"), c("other_roof"), c("other_paved"))},
    {"kind": """CASE WHEN kind = 3 AND other_roof < 0.20 AND other_paved >= 0.65 AND road >= 0.30 THEN 6 WHEN kind = 4 AND other_roof >= 0.65 AND roof >= 0.30 THEN 3
        WHEN kind = 4 AND other_paved >= 0.65 AND road >= 0.30 AND road > roof THEN 6 ELSE kind END"""},
)
_P = {n: clip_sql(f"3 * {x} - 1", "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)") for n, x in (("water", "red"), ("shade", "green"), ("plants", "nir"), ("built", "swir"), ("house", "red2"))}
_OTHER = "greatest(plants, built, house)"
_WETTER = f"""NOT (water < 0.55 AND {_OTHER} < 0.35) AND ((water >= 0.60 AND NOT (shade >= 0.40 AND shade >= water)) OR (water >= 0.75 AND water > shade)
    OR (water >= 0.5 AND water >= {_OTHER} + 0.08 AND NOT (shade >= 0.40 AND shade >= water)))"""
_CONFLICT = "(1 - abs(water - shade)) * least(water + shade, 1)"
given(
    "f20_adjudicate_surface", "s", "r, c", _P,
    lambda: dict(zip(("surface", "conflict", "uncertainty"), U.adjudicated_surface(c("water"), c("shade"), c("plants"), c("built"), c("house")), strict=True)),
    {"surface": f"""CASE WHEN {_WETTER} THEN 'water' WHEN house >= 0.52 THEN 'building' WHEN built >= 0.52 AND built >= plants THEN 'built_up' WHEN plants >= 0.52 AND plants >= built THEN 'vegetation'
        WHEN plants < 0.30 AND built < 0.30 AND house < 0.25 AND water < 0.35 THEN 'bare_land' ELSE 'other' END""",
     "conflict": _CONFLICT, "uncertainty": f"greatest({_CONFLICT}, 1 - least(1, abs(water - {_OTHER}) * 2.5))"}, "conflict uncertainty",
)
_DROP = "least(1, greatest(0, (around - light) / greatest(around, 0.01)))"
_RAW = f"least(1, greatest(0, 0.40 * {_DROP} + 0.20 * least(1, greatest(0, (dark - light) / greatest(dark, 1e-4))) + 0.22 * (1 - water) + 0.18 * greatest(plants, built)))"
given(
    "f23_multispectral_shadow_score", "s", "r, c", {"light": "red", "around": "green + 0.1", "dark": "CAST(0.5 AS DOUBLE)", "water": "nir - 0.3", "plants": "swir", "built": "red2"},
    lambda: dict(zip(("p", "kind"), U.shadow_score(c("light"), c("around"), c("dark"), c("water"), c("plants"), c("built")), strict=True)),
    {"p": "p", "kind": "CASE WHEN p < 0.52 THEN 'none' WHEN built > plants AND built > 0.45 THEN 'building_shadow' WHEN plants >= built AND plants > 0.45 THEN 'vegetation_shadow' ELSE 'unknown_shadow' END"}, "p",
    more=f", q2 AS (SELECT *, CASE WHEN {_DROP} > 0.22 AND (1 - water > 0.55 OR greatest(plants, built) > 0.45) THEN {_RAW} ELSE {_RAW} * 0.30 END AS p FROM q)",
)
_STACK = {"red": "red", "green": "green", "blue": "red2", "nir": "nir", "swir1": "swir", "swir2": "swir2", "cirrus": "nir2", "edge2": "CASE WHEN r % 2 = 0 THEN green2 END"}
_sh = lambda a, b: f"({a} - {b}) / ({a} + {b} + 1e-6)"
_sc = lambda x, by: clip_sql(f"({x}) / {by}", 0, 1)
given(
    "p34_feature_stack", "s", "r, c", _STACK, lambda: {f"f_{n}": x for n, x in U.feature_stack({n: c(n) for n in _STACK}).items()},
    {**{f"f_{n}": _sc(n, 0.3) for n in ("red", "green", "blue")}, "f_edge1": _sc("red + (nir - red) * 0.25", 0.816), "f_edge2": _sc("coalesce(edge2, red + (nir - red) * 0.5)", 0.816),
     "f_edge3": _sc("red + (nir - red) * 0.75", 0.816), **{f"f_{n}": _sc(n, 0.816) for n in ("nir", "swir1", "swir2")}, "f_ndwi": _sh("green", "nir"), "f_mndwi": _sh("green", "swir1"), "f_ndvi": _sh("nir", "red"),
     "f_awei": "blue + 2.5 * green - 1.5 * (nir + swir1) - 0.25 * swir2", "f_brightness": "(red + green + blue) / 3", "f_cirrus": "cirrus"},
    "f_red f_green f_blue f_edge1 f_edge2 f_edge3 f_nir f_swir1 f_swir2 f_ndwi f_mndwi f_ndvi f_awei f_brightness f_cirrus",
)

# Q: rules -----------------------------------------------------------------------------------------------------------
given(
    "q01_scene_rules", "part", "p_partkey", {"crs": "CASE WHEN p_size % 4 > 0 THEN 'EPSG:32643' END", "nodata": "CAST(p_size * 2.1 AS DOUBLE)", "bands": "p_size % 3", "n": "p_size % 5"},
    lambda: {"found": told(Q.scene_rules(c("crs"), c("nodata"), c("bands"), F.array_repeat(F.lit("ndvi"), c("n"))))},
    {"found": told_sql(("warning:missing_crs", "crs IS NULL"), ("warning:nodata", "nodata > 40"), ("blocker:no_usable_pixels", "nodata >= 99.9"), ("blocker:no_bands", "bands < 1"), ("warning:no_index", "n = 0"))},
)
_FRAME = {"crs": "'EPSG:32643'", "width": "100", "height": "100", "res": "CAST(1 AS DOUBLE)", "x0": "CAST(0 AS DOUBLE)", "y0": "CAST(0 AS DOUBLE)", "x1": "CAST(100 AS DOUBLE)", "y1": "CAST(100 AS DOUBLE)"}
_A = {f"a_{k}": v for k, v in _FRAME.items()} | {"a_crs": "CASE WHEN l_linenumber % 5 > 0 THEN 'EPSG:32643' END"}
_B = {f"b_{k}": v for k, v in _FRAME.items()} | {
    "b_crs": "CASE WHEN l_linenumber % 7 > 1 THEN 'EPSG:32643' WHEN l_linenumber % 7 = 1 THEN 'EPSG:4326' END", "b_width": "CASE WHEN l_returnflag = 'A' THEN 90 ELSE 100 END",
    "b_x0": "CAST(l_quantity - 1 AS DOUBLE)", "b_x1": "CAST(l_quantity + 99 AS DOUBLE)", "b_res": "CAST(1 + l_linenumber % 3 AS DOUBLE)",
}


def _pair(strict: bool) -> tuple[Column, Column, Column]:
    return Q.pair_rules({k: c(f"a_{k}") for k in _FRAME}, {k: c(f"b_{k}") for k in _FRAME}, strict)


def _pair_sql(strict: bool) -> dict[str, str]:
    both, none, shape = "(a_crs IS NOT NULL AND b_crs IS NOT NULL)", "(a_crs IS NULL AND b_crs IS NULL)", "(a_width = b_width AND a_height = b_height)"
    near = f"(abs(b_x0 - a_x0) <= {'a_res' if strict else 'a_res + b_res'})"
    over = "greatest(0, least(a_x1, b_x1) - greatest(a_x0, b_x0)) / 100"  # equal areas
    apart = f"({over} < 0.8)" if strict else f"(NOT {near} AND {over} < 0.1)"
    found = told_sql(
        ("warning:different_crs", f"{both} AND a_crs <> b_crs"), ("warning:different_shape", f"({both} OR {none}) AND NOT {shape}"), ("blocker:too_little_overlap", f"{both} AND {apart}"),
        ("warning:partial_overlap", f"{both} AND NOT {apart} AND NOT {near}"), ("blocker:one_crs", f"NOT {both} AND NOT {none}"), ("warning:pixel_space", none),
    )
    align = f"CASE WHEN {both} THEN CASE WHEN a_crs = b_crs AND {shape} AND {near} THEN 1 ELSE {over} / b_res END WHEN {none} THEN CASE WHEN {shape} THEN 1 ELSE 0.85 END ELSE 0 END"
    return {"overlap": f"CASE WHEN {both} THEN {over} END", "alignment": align, "found": found}


for _strict, _name in ((True, "q02_pair_rules"), (False, "q02_pair_rules_lenient")):
    given(
        _name, "lineitem", "l_orderkey, l_linenumber", _A | _B,
        lambda k=_strict: dict(zip(("overlap", "alignment", "found"), (x if i < 2 else told(x) for i, x in enumerate(_pair(k))), strict=True)), _pair_sql(_strict), "overlap alignment",
    )
_PLAN = {
    "pair": "p_size % 2 = 0", "dates": "p_size % 3 = 0", "tools": "CASE WHEN p_size % 5 = 0 THEN 'fusion' WHEN p_size % 5 = 1 THEN 'buildings' ELSE 'spectral' END", "images": "p_size % 4",
    "setup": "CASE WHEN p_size % 7 = 0 THEN 'PAIR_OPTICAL_SAR' WHEN p_size % 7 = 1 THEN 'PAIR_BITEMPORAL_SAR' ELSE 'SINGLE' END", "kind": "CASE WHEN p_partkey % 3 = 0 THEN 'sar' ELSE 'optical' END",
}
given(
    "q04_policy_rules", "part", "p_partkey", _PLAN,
    lambda: {"found": told(Q.policy_rules(c("pair"), c("dates"), F.array("tools"), c("images"), c("setup"), F.array("kind", F.lit("multispectral"))))},
    {"found": told_sql(("blocker:pair_needed", "pair AND images <> 2"), ("blocker:dates_needed", "dates AND setup NOT IN ('PAIR_BITEMPORAL_OPTICAL', 'PAIR_BITEMPORAL_SAR')"),
                       ("blocker:sensors_needed", "tools = 'fusion' AND setup NOT IN ('PAIR_OPTICAL_SAR', 'PAIR_MULTISENSOR_BITEMPORAL')"), ("blocker:optical_needed", "tools = 'buildings' AND kind = 'sar'"))},
)
_WATER = {"valid": "(p_size % 6) * 100", "water": "p_size * 10", "parts": "p_partkey % 3000", "outside": "CASE WHEN p_size % 9 = 0 THEN 4 ELSE 0 END", "alien": "CASE WHEN p_size % 8 = 0 THEN 1 ELSE 0 END", "coastal": "p_size % 2 = 0"}
given(
    "q11_water_rules", "part", "p_partkey", _WATER,
    lambda: dict(zip(("passed", "found"), (x if i == 0 else told(x) for i, x in enumerate(Q.water_rules(*[c(n) for n in _WATER]))), strict=True)),
    {"passed": "NOT (valid = 0 OR outside > 0 OR alien > 0)",
     "found": told_sql(("blocker:no_valid_pixels", "valid = 0"), ("blocker:water_outside", "valid > 0 AND outside > 0"), ("blocker:not_finite", "valid > 0 AND alien > 0"),
                       ("warning:inland_cover", "NOT coastal AND 100.0 * water > 85.0 * valid"), ("warning:fragmented", "parts > 1500"))},
)
_LAND = {"water": "(p_size * 7) % 101", "built": "(p_size * 13) % 101", "plants": "(p_size * p_size) % 101", "bare": "(p_size * 29) % 101", "w_water": "CASE WHEN p_partkey % 2 = 0 THEN CAST(0.1 AS DOUBLE) END", "w_urban": "CAST(0.05 AS DOUBLE)", "nir": "p_partkey % 3 > 0"}
_LAND_SQL = told_sql(("warning:water_witness", "water > 50 AND w_water < 0.12"), ("warning:built_witness", "built > 60 AND w_urban < 0.10"), ("warning:water_cover", "water > 65 AND plants + built < 5"),
                     ("warning:plant_cover", "plants > 85 AND water + built < 2"), ("warning:bare_cover", "bare > 70 AND plants + water < 5"), ("warning:visible_light_only", "NOT nir"))
given(
    "q12_land_rules", "part", "p_partkey", _LAND,
    lambda: dict(zip(("passed", "found"), (x if i == 0 else told(x) for i, x in enumerate(Q.land_rules({k: c(k) for k in ("water", "built", "plants", "bare")}, {"water": c("w_water"), "urban": c("w_urban")}, c("nir")))), strict=True)),
    {"passed": f"{_LAND_SQL} = ''", "found": _LAND_SQL},
)
_OBJECTS = {"n": "p_size % 7", "small": "p_partkey % 5", "unsure": "p_partkey % 4", "metres": "CASE WHEN p_size % 3 > 0 THEN CAST(p_size % 4 AS DOUBLE) END", "reliability": "CASE WHEN p_partkey % 6 = 0 THEN 'COUNT_UNRELIABLE' ELSE 'COUNT_RELIABLE' END"}
_OBJECTS_SQL = told_sql(("warning:none_found", "n = 0"), ("warning:many_small", "n > 0 AND small > 0.60 * n"), ("warning:many_unsure", "n > 0 AND unsure > 0.50 * n"),
                        ("warning:coarse", "n > 0 AND metres > 1.5"), ("warning:unreliable", "n > 0 AND reliability = 'COUNT_UNRELIABLE'"))
given(
    "q13_instance_rules", "part", "p_partkey", _OBJECTS,
    lambda: dict(zip(("passed", "found"), (x if i == 0 else told(x) for i, x in enumerate(Q.instance_rules(*[c(n) for n in _OBJECTS]))), strict=True)),
    {"passed": f"n = 0 OR {_OBJECTS_SQL} = ''", "found": _OBJECTS_SQL},
)
_NAMES = {"bands": "CASE WHEN p_size % 3 = 0 THEN 3 WHEN p_size % 3 = 1 THEN 4 ELSE 5 END", "names": "CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'BLUE RED GREEN' WHEN p_partkey % 4 = 2 THEN 'B1 B2 B3 B4' ELSE 'RED RED BLUE' END"}
given(
    "q17_sensor_detect", "part", "p_partkey", _NAMES,
    lambda: {"sensor": Q.sensor(c("bands"), F.filter(F.split("names", " "), lambda x: x != ""), ("B1", "B2", "B3", "B4"))},
    {"sensor": "CASE WHEN bands = 3 AND names IN ('', 'BLUE RED GREEN') THEN 'RGB_VHR' WHEN bands = 4 AND names = 'B1 B2 B3 B4' THEN 'SENTINEL2_L1C_13B' END"},
)
_GATE = {"size": "CASE WHEN p_size % 10 > 0 THEN CAST(p_size AS DOUBLE) / CASE WHEN p_size % 2 = 0 THEN 10.0 ELSE 100000.0 END END", "degrees": "p_size % 2 = 1", "lat": "CAST(p_partkey % 80 AS DOUBLE)",
         "model": "CASE p_partkey % 5 WHEN 0 THEN 'aerial' WHEN 1 THEN 'rgb' WHEN 2 THEN 'medium' WHEN 3 THEN 'sentinel2' ELSE 'any' END"}
given(
    "q18_resolution_gate", "part", "p_partkey", _GATE,
    lambda: {"metres": Q.metres_per_pixel(c("size"), c("degrees"), c("lat")), "passed": Q.resolution_gate(Q.metres_per_pixel(c("size"), c("degrees"), c("lat")), c("model"))},
    {"metres": "m", "passed": """CASE model WHEN 'aerial' THEN coalesce(m BETWEEN 0.15 AND 0.60, false) WHEN 'rgb' THEN coalesce(m BETWEEN 0.01 AND 1.5, true)
        WHEN 'medium' THEN coalesce(m BETWEEN 8 AND 30, true) WHEN 'sentinel2' THEN coalesce(m BETWEEN 5 AND 65, true) ELSE true END"""}, "metres",
    more=", q2 AS (SELECT *, CASE WHEN degrees THEN radians(size) * 6371008.8 ELSE size END AS m FROM q)",
)
_LIMITS = {"foot": "CAST(l_discount * 10 AS DOUBLE)", "rim": "CAST(l_tax * 20 AS DOUBLE)", "area": "l_linenumber - 1", "distance": "CAST(l_quantity AS INT) % 3", "prominence": "CAST(l_tax AS DOUBLE)"}
given(
    "q19_threshold_bounds", "lineitem", "l_orderkey, l_linenumber", _LIMITS, lambda: {"is_ok": Q.thresholds_ok(*[c(n) for n in _LIMITS])},
    {"is_ok": "foot > 0 AND foot < 1 AND rim > 0 AND rim < 1 AND area >= 1 AND distance >= 1 AND prominence > 0"},
)
_RADAR = {"suffix": "CASE WHEN p_size % 5 = 0 THEN '.png' ELSE '.tif' END", "crs": "CASE WHEN p_size % 4 > 0 THEN 'EPSG:4326' END", "kind": "CASE WHEN p_size % 3 = 0 THEN 'uint8' ELSE 'float32' END", "tags": "p_type || CASE WHEN p_partkey % 7 = 0 THEN ' Sigma0' ELSE '' END", "negative": "p_partkey % 2 = 0"}
given(
    "x22_calibrated_flag", "part", "p_partkey", _RADAR, lambda: dict(zip(("is_calibrated", "reason"), Q.calibrated(*[c(n) for n in _RADAR]), strict=True)),
    {"is_calibrated": "suffix <> '.png' AND crs IS NOT NULL AND kind <> 'uint8' AND (tags LIKE '%Sigma0' OR negative)",
     "reason": "CASE WHEN suffix = '.png' THEN 'rendered' WHEN crs IS NULL THEN 'not_georeferenced' WHEN kind = 'uint8' THEN 'eight_bit' WHEN tags LIKE '%Sigma0' THEN 'named_product' WHEN negative THEN 'physical_db' ELSE 'no_metadata' END"},
)

# V: verdicts --------------------------------------------------------------------------------------------------------
_KIND = "CASE event_type WHEN 'view' THEN 'water_grounding_evidence' WHEN 'signup' THEN 'land_cover_classification' WHEN 'click' THEN 'sar_structural_evidence' WHEN 'error' THEN 'building_detection_evidence' ELSE 'cross_sensor_agreement' END"
_EVIDENCE = """event_id, CAST(floor(event_id / 4) AS BIGINT) AS run, {kind} AS kind, CASE k % 3 WHEN 0 THEN false WHEN 1 THEN true END AS supports, k % 5 = 0 AS dl_consensus, k % 2 = 0 AS is_dl, k % 4 = 0 AS found,
    CAST(k AS DOUBLE) AS cover, CAST(k * 7 % 50 AS DOUBLE) AS water_percent"""


def evidence(s, d: str) -> DataFrame:
    df = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return df.selectExpr(*[x.strip() for x in _EVIDENCE.format(kind=_KIND).replace("\n", " ").split(", ")])


_ANY = lambda kinds, value: f"coalesce(bool_or(kind IN ({kinds}) AND supports = {value}), false)"
_OPT, _SAR = "'building_detection_evidence', 'water_grounding_evidence', 'land_cover_classification'", "'sar_structural_evidence', 'cross_sensor_agreement'"
_WITNESS = f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events), v AS (SELECT {_EVIDENCE.format(kind=_KIND)} FROM e),
    y AS (SELECT run, count(*) FILTER (kind LIKE 'water%' AND dl_consensus) AS cons, count(*) FILTER (kind LIKE 'water%' AND is_dl AND found) AS deep, count(*) FILTER (supports) >= 3 AS many,
        {_ANY(_OPT, 'true')} AS oy, {_ANY(_OPT, 'false')} AS o_no, {_ANY(_SAR, 'true')} AS ry, {_ANY(_SAR, 'false')} AS r_no FROM v GROUP BY run),
    p AS (SELECT a.run, count(*) FILTER (least(a.cover, b.water_percent) / greatest(a.cover, b.water_percent) > 0.5) AS near,
        count(*) FILTER (least(a.cover, b.water_percent) / greatest(a.cover, b.water_percent) < 0.2 AND abs(a.cover - b.water_percent) > 10) AS far
        FROM v a JOIN v b ON a.run = b.run AND a.kind LIKE 'water%' AND b.kind LIKE 'land%' AND a.cover > 0 AND b.water_percent > 0 GROUP BY a.run),
    z AS (SELECT y.*, coalesce(near, 0) AS near, coalesce(far, 0) AS far, oy AND ry AS agreed, NOT (oy AND ry) AND ((ry AND o_no) OR (oy AND r_no)) AS torn FROM y LEFT JOIN p USING (run))
    SELECT run, cons + deep + near + CAST(agreed AS INT) + CAST(many AS INT) AS agreements, far + CAST(torn AS INT) AS disagreements,
        round(greatest(-0.10, least(0.10, 0.03 * cons + 0.02 * deep + 0.02 * near - 0.03 * far + 0.04 * CAST(agreed AS INT) - 0.05 * CAST(torn AS INT) + 0.02 * CAST(many AS INT))), 3) AS bonus FROM z"""
register("v12_witness_agreement", lambda s, d: Q.witness_agreement(evidence(s, d), ["run"]), _WITNESS, "bonus")
_RUN = {
    "blockers": "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END", "alignment": "CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 20 AS DOUBLE) / 100 WHEN o_orderkey % 7 < 5 THEN CAST(0.6 AS DOUBLE) END",
    "items": "o_custkey % 5", "supports": "o_orderstatus = 'F'", "refutes": "o_orderkey % 3 = 0", "claim": "CASE WHEN o_custkey % 9 = 0 THEN 'disputed' WHEN o_custkey % 9 = 1 THEN 'supported_with_limitations' END",
    "missing": "o_orderkey % 4 = 0", "note": "CASE WHEN o_orderkey % 5 = 0 THEN 'An Uncalibrated raster' ELSE 'cloud cover' END", "quality": "CAST(o_custkey % 100 AS DOUBLE) / 100", "score": "CAST(o_orderkey % 100 AS DOUBLE) / 100", "bonus": "CAST(o_orderkey % 21 - 10 AS DOUBLE) / 100",
}
_CASE = """CASE WHEN blockers > 0 THEN 'hard_input_rejection' WHEN alignment < 0.15 THEN 'severe_misalignment_abstention' WHEN items = 0 THEN 'empty_evidence_abstention'
    WHEN coalesce(claim = 'disputed', false) OR (refutes AND NOT supports) THEN 'disputed' WHEN missing AND NOT coalesce(claim = 'supported_with_limitations', false) THEN 'semantic_model_unavailable_abstention'
    WHEN coalesce(claim = 'supported_with_limitations', false) OR note LIKE '%Uncalibrated%' THEN 'limited' ELSE 'supported' END"""
given(
    "v13_verdict", "orders", "o_orderkey", _RUN,
    lambda: dict(zip(("status", "confidence", "kind"), Q.verdict(c("blockers"), c("alignment"), c("items"), c("supports"), c("refutes"), c("claim"), c("missing"), Q.limiting(F.array("note")), c("quality"), c("score"), c("bonus")), strict=True)),
    {"status": "CASE x WHEN 'disputed' THEN 'disputed' WHEN 'limited' THEN 'supported_with_limitations' WHEN 'supported' THEN 'supported' ELSE 'insufficient_evidence' END",
     "confidence": """CASE WHEN x IN ('disputed', 'limited', 'supported') THEN round(greatest(0, least(1, score + bonus)), 3) WHEN x LIKE 'severe%' THEN round(alignment * 0.2, 3)
        WHEN x LIKE 'semantic%' THEN round(least(0.49, quality * 0.45), 3) ELSE 0 END""",
     "kind": "CASE WHEN x IN ('disputed', 'limited', 'supported') THEN 'evidence_weighted_spatial_ensemble_v2' ELSE x END"}, "confidence",
    more=f", q2 AS (SELECT *, {_CASE} AS x FROM q)",
)
_STRICT = {
    "unclear": "o_orderkey % 13 = 0", "blockers": "CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END", "task": "CASE o_custkey % 4 WHEN 0 THEN 'water_analysis' WHEN 1 THEN 'unsupported' ELSE 'buildings' END", "items": "o_custkey % 3",
    "user_point": "o_orderkey % 5 = 0", "unreliable": "o_orderkey % 6 = 0", "f1": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 10 AS DOUBLE) / 10 END", "withheld": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 7 AS DOUBLE) / 10 END", "lacking": "o_orderkey % 17 = 0",
}
given(
    "v14_verdict_strict", "orders", "o_orderkey", _STRICT, lambda: {"status": Q.verdict_strict(*[c(n) for n in _STRICT])},
    {"status": """CASE WHEN unclear THEN 'insufficient_evidence' WHEN blockers > 0 THEN 'invalid_input' WHEN task = 'unsupported' THEN 'unsupported_task'
        WHEN lacking THEN CASE WHEN task = 'water_analysis' THEN 'insufficient_evidence' ELSE 'low_confidence' END WHEN unreliable OR coalesce(f1 < 0.6, false) OR coalesce(withheld > 0.5, false) THEN 'low_confidence'
        WHEN items = 0 THEN 'insufficient_evidence' WHEN user_point THEN 'supported' ELSE 'supported_with_limitations' END"""},
)
