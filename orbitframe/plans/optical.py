"""Queries of visible-light scenes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import surfaces as U
from ..operators import optical as O
from ..sources import scenes as S
from .registry import PX, register

c = F.col
#: Colours of a scene in blocks of 16 x 16 cells, on which the derived bands lie as noise: open water, dark water, plants,
#: silt, roofs, turbid water and soil.
_BLOCK = "(floor(r / 16.0) * 4 + floor(c / 16.0)) % 11"
_PAINT = {"red": (0.03, 0.034, 0.03, 0.034, 0.10, 0.20, 0.80, 0.034, 0.12, 0.03, 0.22), "green": (0.06, 0.035, 0.06, 0.035, 0.20, 0.21, 0.79, 0.035, 0.16, 0.06, 0.18), "blue": (0.10, 0.036, 0.10, 0.036, 0.08, 0.19, 0.77, 0.036, 0.17, 0.10, 0.12)}


def _paint(name: str, band: str, noise: float) -> str:
    return f"CASE {_BLOCK} " + " ".join(f"WHEN {k} THEN CAST({v} AS DOUBLE)" for k, v in enumerate(_PAINT[name])) + f" END + {noise} * ({band} - 0.5)"


def _painted(noise: float) -> dict[str, str]:
    return {"red": _paint("red", "red", noise), "green": _paint("green", "green", noise), "blue": _paint("blue", "nir", noise)}


def scene(s, d: str, noise: float = 0.02, **more: str) -> DataFrame:
    """The painted scene, with more columns by text that Spark and DuckDB share."""
    return S.derived_scene(s, d).selectExpr("1 AS scene", "r", "c", *(f"{x} AS {n}" for n, x in (_painted(noise) | more).items()))


def scene_sql(noise: float = 0.02, **more: str) -> str:
    return f"{PX}, b0 AS (SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, " + ", ".join(f"{x} AS {n}" for n, x in (_painted(noise) | more).items()) + " FROM s)"


def _box_sql(x: str, k: int, axis: str) -> str:
    order = "PARTITION BY r ORDER BY c" if axis == "x" else "PARTITION BY c ORDER BY r"
    return f"sum({x}) OVER ({order} RANGE BETWEEN {k // 2} PRECEDING AND {k // 2} FOLLOWING)"


def cues_sql(edges: float, wide: dict[str, int], bright: dict[str, tuple[str, int]] | None = None) -> str:
    """Tables b1 .. b5: the cues of b0, in b5."""
    bright, sizes = bright or {}, sorted({5, *wide.values(), *(k for _, k in (bright or {}).values())})
    sums = {"s_": ("light", 5), "q_": ("light * light", 5)} | {f"n{k}": ("1", k) for k in sizes} | {f"b_{n}": (f"CASE WHEN {x} THEN 1 ELSE 0 END", k) for n, (x, k) in bright.items()}
    row, col = "(PARTITION BY r ORDER BY c)", "(PARTITION BY c ORDER BY r)"
    before = lambda x, w: f"coalesce(lag({x}) OVER {w}, {x})"
    after = lambda x, w: f"coalesce(lead({x}) OVER {w}, {x})"
    return ", ".join((
        "b1 AS (SELECT *, 0.299 * red + 0.587 * green + 0.114 * blue AS light FROM b0)",
        "b2 AS (SELECT *, " + ", ".join(f"{_box_sql(x, k, 'x')} AS x_{n}" for n, (x, k) in sums.items()) + f", {after('light', row)} - {before('light', row)} AS dx, {before('light', row)} + 2 * light + {after('light', row)} AS sx FROM b1)",
        "b3 AS (SELECT *, " + ", ".join(f"{_box_sql('x_' + n, k, 'y')} AS y_{n}" for n, (_, k) in sums.items()) + f", ({before('dx', col)} + 2 * dx + {after('dx', col)}) / 4 AS gx, ({after('sx', col)} - {before('sx', col)}) / 4 AS gy FROM b2)",
        "b4 AS (SELECT *, sqrt(gx * gx + gy * gy) AS slope, sqrt(greatest(0, y_q_ / y_n5 - (y_s_ / y_n5) ** 2)) AS texture" + "".join(f", y_b_{n} / y_n{k} AS {n}" for n, (_, k) in bright.items()) + " FROM b3)",
        "b4e AS (SELECT *" + "".join(f", {_box_sql(f'CASE WHEN slope > {edges} THEN 1 ELSE 0 END', k, 'x')} AS e_{n}" for n, k in wide.items()) + " FROM b4)",
        "b5 AS (SELECT *" + "".join(f", {_box_sql(f'e_{n}', k, 'y')} / y_n{k} AS {n}" for n, k in wide.items()) + " FROM b4e)",
    ))


_CLIP = "least({hi}, greatest({lo}, {x}))".format
_LIGHT3, _NDBR, _NDGR, _EXG = "((red + green + blue) / 3)", "((blue - red) / (blue + red + 1e-7))", "((green - red) / (green + red + 1e-7))", "(2 * green - red - blue)"
_GAP = "greatest(abs(red - green), abs(green - blue), abs(red - blue))"
_GREEN = f"(green > blue * 1.35 OR ({_EXG} > 0.03 AND texture > 0.010) OR {_EXG} > 0.18 OR (green > red * 1.08 AND green > blue AND texture > 0.012))"
_BLUE = "((blue > red * 1.35 AND blue > green * 0.80 AND light < 0.35 AND texture < 0.030) OR (light < 0.08 AND blue > red * 1.15 AND blue >= green * 0.75 AND texture < 0.020))"
_NEAR = "(abs(red - green) / (red + green + 1e-6))"
_KINDS = ("(blue > red * 1.15 AND blue >= green * 0.70 AND light < 0.40 AND light >= 0.008)", "(green >= red * 1.12 AND blue >= red * 1.20 AND green <= blue * 1.40 AND texture < 0.018 AND light < 0.30)",
          f"({_NEAR} < 0.12 AND blue >= least(red, green) * 0.70 AND blue <= greatest(red, green) * 1.20 AND green <= blue * 1.40 AND texture < 0.025 AND light >= 0.06 AND light <= 0.45)",
          "(light < 0.12 AND light >= 0.008 AND blue > red * 1.10 AND blue >= green * 0.75 AND texture < 0.018)")
_VALID = "r % 37 <> 5 OR c % 29 <> 3"
_RULES = f"""{cues_sql(0.050, {"urban": 15, "broad": 31}, {"shiny": (f"{_LIGHT3} > 0.55", 61)})}, town AS (SELECT avg(CASE WHEN {_LIGHT3} > 0.55 AND ok THEN 1.0 ELSE 0.0 END) AS town FROM b0),
    f1 AS (SELECT *, {_GREEN} OR ((texture > 0.030 OR slope > 0.070 OR urban > 0.08 OR ({_GAP} < 0.030 AND {_NDBR} < 0.05 AND blue <= red * 1.10)
            OR (red >= green * 0.95 AND red >= blue AND {_LIGHT3} < 0.25 AND {_LIGHT3} > 0.03 AND {_NDBR} < 0.08)) AND NOT {_BLUE})
        OR {_LIGHT3} > 0.55 OR {_LIGHT3} < 0.005 OR ({_LIGHT3} < 0.020 AND blue <= red) OR (shiny > CASE WHEN town > 0.2 THEN 0.005 ELSE 0.08 END AND broad > CASE WHEN town > 0.2 THEN 0.005 ELSE 0.08 END) AS gone FROM b5, town),
    f2 AS (SELECT *, ({" OR ".join(_KINDS)}) AND NOT gone AND ok AS cand, ({_KINDS[0]} OR {_KINDS[1]} OR ({_KINDS[2]} AND {_NEAR} < 0.08)) AND NOT gone AND texture < 0.026 AND ok AS core,
        ok AND {_LIGHT3} >= 0.003 AND {_LIGHT3} < 0.12 AND {_GAP} < 0.055 AND {_EXG} < 0.025 AND texture < 0.018 AND slope < 0.045 AND urban < 0.08 AND NOT {_GREEN} AS dim,
        {_CLIP(lo=-1, hi=1, x=f"{_NDBR} * 0.40 + {_NDGR} * 0.15 + (0.25 - {_LIGHT3}) * 0.20 - texture * 1.80 - urban * 0.80")} AS base FROM f1)"""
register(
    "f06_rgb_water_rules", lambda s, d: O.rgb_water(scene(s, d, ok=_VALID), ["scene"], c("red"), c("green"), c("blue"), 64, c("ok"), tile=16).drop("scene"),
    f"""WITH RECURSIVE {scene_sql(ok=_VALID)}, {_RULES}, open AS MATERIALIZED (SELECT r, c FROM f2 WHERE cand OR dim),
    fill AS (SELECT r, c FROM f2 WHERE core AND {_NDBR} > 0.15 AND blue > green * 0.85 UNION SELECT o.r, o.c FROM fill f JOIN open o ON abs(o.r - f.r) + abs(o.c - f.c) = 1),
    g AS (SELECT f2.*, dim AND f.r IS NOT NULL AS back FROM f2 LEFT JOIN fill f USING (r, c)),
    p AS (SELECT *, CASE WHEN cand THEN greatest(0.55, 0.50 + base * 0.45) ELSE least(0.10, greatest(0, 0.10 + base * 0.15)) END AS p FROM g),
    q AS (SELECT *, CASE WHEN gone THEN least(p, 0.03) ELSE p END AS q FROM p)
    SELECT r, c, CASE WHEN NOT ok THEN 0 WHEN back THEN greatest(q, 0.42) ELSE q END AS score, core AS is_core, gone AND NOT back AS is_excluded, cand AS is_candidate, back AS is_recovered FROM q""", "score",
)

_WIDE = "((blue - red) / (blue + red + 1e-5)", "((green - red) / (green + red + 1e-5)"
_INDEX = _CLIP(lo=-1, hi=1, x=f"{_WIDE[0]}) * 0.5 + {_WIDE[1]}) * 0.3 + (0.35 - light) * 0.4 - urban * 0.8 - texture * 1.5")
register(
    "f07_rgb_water_estimate", lambda s, d: O.rgb_water_estimate(scene(s, d), ["scene"], c("red"), c("green"), c("blue")).drop("scene"),
    f"""WITH {scene_sql()}, {cues_sql(0.06, {"urban": 17})}, i AS (SELECT *, {_INDEX} AS idx FROM b5), h AS (SELECT least(floor((idx + 1) * 128), 255) AS bin, count(*) AS n FROM i GROUP BY 1),
    w AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS n0, sum(n) OVER () AS n_all, sum(n * (bin + 0.5)) OVER (ORDER BY bin) / 128 - sum(n) OVER (ORDER BY bin) AS s0, sum(n * (bin + 0.5)) OVER () / 128 - sum(n) OVER () AS s_all FROM h),
    v AS (SELECT bin, coalesce(n0 * (n_all - n0) * (s0 / n0 - (s_all - s0) / nullif(n_all - n0, 0)) ** 2 / n_all ** 2, 0) AS v FROM w),
    t AS (SELECT least(0.15, greatest(0.01, (bin + 1) / 128 - 1)) AS cut FROM v ORDER BY round(v, 12) DESC, bin LIMIT 1)
    SELECT r, c, idx AS index, (blue > red * 1.01 OR (green > red * 1.02 AND blue > red * 0.88)) AND ({_WIDE[0]}) > 0.005 OR {_WIDE[1]}) > 0.005) AND texture < 0.06 AND slope < 0.08 AND urban < 0.15
        AND light BETWEEN 0.003 AND 0.85 AND NOT (light >= 0.05 AND {_GAP} < 0.035 AND {_WIDE[0]}) < 0.04) AND idx >= cut AS is_water FROM i, t""", "index",
)

_SAT = "((greatest(red, green, blue) - least(red, green, blue)) / (greatest(red, green, blue) + 1e-7))"
_SURFACES = (
    (f"(({_EXG} > 0.02 AND green > red * 1.08 AND (blue < green * 0.65 OR {_NDBR} < 0.12)) OR green > blue * 1.35 OR (green > red * 1.08 AND green > blue AND texture > 0.012))", -0.40),
    (f"({_LIGHT3} < 0.16 AND {_SAT} < 0.10 AND abs(red - blue) < 0.025)", -0.45), ("(texture > 0.030 OR slope > 0.065)", -0.35), (f"(urban > 0.10 AND {_LIGHT3} > 0.20)", -0.35),
    (f"({_GAP} < 0.035 AND {_NDBR} < 0.05)", -0.30), (f"(red >= green * 0.95 AND red >= blue AND {_LIGHT3} < 0.25 AND {_LIGHT3} > 0.03 AND {_NDBR} < 0.08)", -0.30),
)
_FORCED = "least(value, " + ", ".join(f"CASE WHEN {x} THEN {v} ELSE 1 END" for x, v in _SURFACES) + ")"
register(
    "f08_rgb_water_proxy", lambda s, d: O.rgb_water_proxy(scene(s, d), ["scene"], c("red"), c("green"), c("blue")).drop("scene"),
    f"""WITH {scene_sql()}, {cues_sql(0.06, {"urban": 17})}, k AS (SELECT *, {_CLIP(lo=-1, hi=1, x=f"{_NDBR} * 0.40 + {_NDGR} * 0.15 + (0.25 - {_LIGHT3}) * 0.20 - texture * 1.80")} AS base,
        {_LIGHT3} >= 0.03 AND (({_NDBR} > 0.05 AND blue > red * 1.10 AND blue >= green * 0.70 AND {_LIGHT3} < 0.40) OR (green >= red * 1.10 AND blue >= red * 1.15 AND {_NDBR} >= 0.14 AND {_LIGHT3} < 0.30 AND texture < 0.020)
            OR (green >= red * 0.95 AND green <= red * 1.30 AND blue >= green * 0.65 AND {_LIGHT3} < 0.25 AND texture < 0.025) OR ({_LIGHT3} < 0.10 AND blue > red * 1.08 AND texture < 0.020)) AS wet,
        {" OR ".join(x for x, _ in _SURFACES)} OR {_LIGHT3} > 0.50 OR {_LIGHT3} < 0.025 OR (red >= green * 0.90 AND {_LIGHT3} > 0.35 AND {_NDBR} < 0.04) AS other FROM b5),
    v AS (SELECT *, CASE WHEN wet AND NOT other THEN greatest(0.22, base + 0.15) ELSE least(0.08, base) END AS value FROM k)
    SELECT r, c, CASE WHEN {_LIGHT3} < 0.025 OR {_LIGHT3} > 0.50 THEN -0.50 ELSE {_FORCED} END AS index FROM v""", "index",
)

_SHADE = {"ok": _VALID, "wet": "CASE WHEN floor(c / 16.0) % 2 = 0 THEN green2 + 0.12 ELSE 0.2 END", "roof": "r % 23 < 3 AND c % 19 < 4", "plant": "swir2 + 0.08"}
_STEPS = " ".join(f"LEFT JOIN (SELECT a.r, a.c, min(abs(a.r - m.r) + abs(a.c - m.c)) AS n_{n} FROM b5 a JOIN b5 m ON {x} AND abs(a.r - m.r) <= {k} AND abs(a.c - m.c) <= {k} GROUP BY a.r, a.c) d_{n} USING (r, c)" for n, x, k in (("roof", "m.roof", 8), ("plant", "m.plant > 0.55", 5), ("bright", "m.light > 0.82 AND m.ok", 18)))
_BESIDE = {n: f"coalesce(n_{n} BETWEEN 1 AND {k}, false)" for n, k in (("roof", 8), ("plant", 5), ("bright", 18))}
register(
    "f22_rgb_shadow_score",
    lambda s, d: O.rgb_shadow(scene(s, d, 0.9, **_SHADE), ["scene"], c("red"), c("green"), c("blue"), c("ok"), c("wet"), c("roof"), c("plant")).drop("scene"),
    f"""WITH {scene_sql(0.9, **_SHADE)}, {cues_sql(0.035, {"edge": 9}, {"u_n": ("ok", 21), "u_wn": ("wet >= 0.55", 31)})},
    h1 AS (SELECT *, {_box_sql("CASE WHEN ok THEN light ELSE 0 END", 21, "x")} AS s1, {_box_sql("CASE WHEN wet >= 0.55 THEN coalesce(light, 0) ELSE 0 END", 31, "x")} AS w1 FROM b5),
    h2 AS (SELECT *, {_box_sql("s1", 21, "y")} / nullif(y_b_u_n, 0) AS around, {_box_sql("w1", 31, "y")} / nullif(y_b_u_wn, 0) AS pool FROM h1), h3 AS (SELECT h2.*, n_roof, n_plant, n_bright FROM h2 {_STEPS}),
    h4 AS (SELECT *, {_CLIP(lo=0, hi=1, x="coalesce((around - light) / greatest(around, 0.04), 0)")} AS fall, {_CLIP(lo=0, hi=1, x="coalesce((pool - light) / greatest(pool, 0.02), 0)")} AS deeper,
        1 - {_CLIP(lo=0, hi=1, x="(greatest(red, green, blue) - least(red, green, blue)) / greatest(greatest(red, green, blue), 1e-5) / 0.35")} AS plain, {_CLIP(lo=0, hi=1, x="(0.34 - light) / 0.34")} AS dark, {_CLIP(lo=0, hi=1, x="edge / 0.18")} AS rim,
        {_BESIDE["roof"]} AS by_roof, {_BESIDE["plant"]} AS by_plant, {_BESIDE["bright"]} AS by_bright FROM h3),
    h5 AS (SELECT *, by_roof OR by_plant OR by_bright OR (rim > 0.55 AND plain > 0.50) AS near, 0.25 * dark + 0.32 * fall + 0.13 * plain + 0.10 * rim + 0.14 * by_roof::INT + 0.06 * by_plant::INT + 0.10 * by_bright::INT AS raw FROM h4),
    h6 AS (SELECT *, CASE WHEN fall > 0.20 AND near THEN raw ELSE raw * 0.35 END AS p FROM h5),
    h7 AS (SELECT *, CASE WHEN NOT ok OR light IS NULL THEN 0 ELSE {_CLIP(lo=0, hi=1, x="CASE WHEN wet >= 0.55 AND deeper > 0.28 AND near THEN greatest(p, 0.42 + 0.45 * deeper) WHEN wet >= 0.55 THEN p * 0.20 ELSE p END")} END AS score FROM h6)
    SELECT r, c, score, score >= 0.52 AS is_shadow, CASE WHEN score < 0.52 THEN 'none' WHEN by_roof THEN 'building' WHEN by_plant THEN 'vegetation' WHEN by_bright THEN 'cloud' ELSE 'unknown' END AS type FROM h7""", "score",
)

# land cover with its masks cleaned -----------------------------------------------------------------------------
_LAND = {"ndvi": f"3.0 * (nir2 - CASE WHEN {_BLOCK} IN (0, 1, 2, 3, 9) THEN 0.56 WHEN {_BLOCK} = 5 THEN 0.54 ELSE 0.42 END)", "ndwi": "2.0 * (green2 - 0.3)", "ndbi": "swir2 - 0.46", "fall": "red2 - 0.4", "edge": "(swir - 0.4) / 2"}


def _conditions() -> dict:
    return U.land_cover_conditions(*(c(n) for n in ("ndvi", "ndwi", "ndbi", "red", "green", "blue", "edge", "fall")))


_NEAR9 = "FROM {t} a JOIN {t} o ON o.r BETWEEN a.r - 1 AND a.r + 1 AND o.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY ALL"
_ALL9 = "count(*) FILTER (o.w) = 9"
_WETS = ("ndwi >= 0.18 AND ndvi < 0.05 AND blue > red * 1.15 AND NOT (2 * green - red - blue > 0.03 OR (green > blue * 1.30 AND green > red * 1.05)) AND NOT (red > blue * 1.12 AND green > blue * 0.95 AND (red + green + blue) / 3 > 0.10) AND NOT (green > red * 1.05 AND green > blue) AND NOT (fall > 0.20 AND (edge > 0.03 OR (red + green + blue) / 3 < 0.25)) AND (red + green + blue) / 3 < 0.55 AND edge < 0.10")
_HOLDS = {
    2: "ndvi >= 0.38", 3: "ndvi >= 0.16", 4: f"ndvi < 0.08 AND abs(red - blue) < 0.09 AND abs(green - blue) < 0.09 AND {_LIGHT3} BETWEEN 0.18 AND 0.68 AND edge > 0.06",
    5: f"ndbi >= 0.06 OR edge > 0.12 OR ({_LIGHT3} > 0.55 AND ndvi < 0.15)", 6: "ndvi >= 0.08 AND ndvi < 0.28 AND red > 0.18",
}
_TURNS = ", ".join(
    f"""k{n}c AS (SELECT *, k = 0 AND ok AND coalesce({x}, false) AS m FROM k{n - 1}), k{n}n AS (SELECT a.r, a.c, count(*) FILTER (o.m) AS n FROM k{n}c a JOIN k{n}c o ON o.r BETWEEN a.r - 1 AND a.r + 1 AND o.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c),
    k{n} AS (SELECT q.* EXCLUDE (m, k), CASE WHEN m AND n >= 4 THEN {n} ELSE k END AS k FROM k{n}c q JOIN k{n}n USING (r, c))"""
    for n, x in _HOLDS.items()
)
register(
    "f11_land_cover", lambda s, d: O.land_cover(scene(s, d, ok=_VALID, **_LAND), ["scene"], _conditions(), c("ok"), 64, 9, tile=16).drop("scene"),
    f"""WITH RECURSIVE {scene_sql(ok=_VALID, **_LAND)}, w0 AS (SELECT r, c, coalesce({_WETS}, false) AS w FROM b0), w1 AS (SELECT a.r, a.c, {_ALL9} AS w {_NEAR9.format(t="w0")}),
    w2 AS (SELECT a.r, a.c, bool_or(o.w) AS w {_NEAR9.format(t="w1")}), w3 AS (SELECT a.r, a.c, bool_or(o.w) AS w {_NEAR9.format(t="w2")}), w4 AS (SELECT a.r, a.c, {_ALL9} AS w {_NEAR9.format(t="w3")}),
    m AS MATERIALIZED (SELECT r, c, r * 64 + c AS id FROM w4 WHERE w), e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
    z AS (SELECT id AS u, id AS label FROM m UNION SELECT e.v, z.label FROM z JOIN e ON e.u = z.u), l AS (SELECT u, min(label) AS label FROM z GROUP BY u),
    big AS (SELECT u FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 9)),
    k1 AS (SELECT *, CASE WHEN ok AND r * 64 + c IN (SELECT u FROM big) THEN 1 ELSE 0 END AS k FROM b0), {_TURNS}
    SELECT r, c, CASE WHEN NOT ok THEN 0 WHEN k = 0 THEN 7 ELSE k END AS class FROM k6""",
)
_WATERS = {"kind": "CASE WHEN red2 > 0.46 THEN 5 ELSE 1 END", "grey": "green2 > 0.52", "pool": "swir2 > 0.5"}
register(
    "f12_corrected_regions", lambda s, d: O.corrected_regions(scene(s, d, 0.9, **_WATERS), ["scene"], "kind", c("blue") * 4, c("grey"), c("pool"), 64, 12, tile=16).select(c("r").cast("long").alias("r"), c("c").cast("long").alias("c"), "kind"),
    f"""WITH RECURSIVE {scene_sql(0.9, **_WATERS)}, m AS MATERIALIZED (SELECT r, c, r * 64 + c AS id FROM b0 WHERE kind = 5), e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
    z AS (SELECT id AS u, id AS label FROM m UNION SELECT e.v, z.label FROM z JOIN e ON e.u = z.u), l AS (SELECT u, min(label) AS label FROM z GROUP BY u),
    t AS (SELECT label, count(*) AS n, avg(4 * blue) AS blue, avg(coalesce(grey, false)::INT) AS grey, avg(coalesce(pool, false)::INT) AS pool FROM l JOIN b0 ON u = r * 64 + c GROUP BY label)
    SELECT r, c, CASE WHEN n < 12 AND NOT coalesce(t.pool > 0.4 AND t.blue > 0.48, false) THEN CASE WHEN t.grey > 0.2 THEN 6 ELSE 4 END ELSE kind END AS kind FROM b0 LEFT JOIN l ON u = r * 64 + c LEFT JOIN t USING (label)""",
)
