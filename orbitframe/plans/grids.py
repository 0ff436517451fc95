"""Queries of grids, regions, matches, catalog and ordering, with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import catalog as C
from ..operators import grids as K
from ..operators import matching as M
from ..operators import polygons as O
from ..operators import regions as G
from ..operators import tiles as T
from ..sources import scenes as S
from .decisions import given
from .registry import PX, _CC, labels, register, table

c = F.col


def px(s, d: str) -> DataFrame:
    """The derived scene as one scene of a keyed table."""
    return S.derived_scene(s, d).withColumn("scene", F.lit(1))


# P: bands and grids -------------------------------------------------------------------------------------------------
_BAND = "CASE l_partkey % 9 WHEN 0 THEN 'B04' WHEN 1 THEN ' b-3' WHEN 2 THEN 'NIR_08' WHEN 3 THEN 'swir16' WHEN 4 THEN 'VV' WHEN 5 THEN 'other' WHEN 6 THEN 'B8A' WHEN 7 THEN 'Band 02' ELSE 'near-infrared' END"


def _bands(s, d: str) -> DataFrame:
    return table(s, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber AS idx", f"{_BAND} AS name", "CASE l_suppkey % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'blue' ELSE 'grey' END AS colour",
        "CASE WHEN l_partkey % 4 = 0 THEN CAST(400 + l_suppkey % 50 * 40 AS DOUBLE) END AS nm", "l_orderkey % 2 = 0 AS sentinel2",
    )


register(
    "p01_band_roles_by_alias", lambda s, d: K.band_roles_by_alias(_bands(s, d), ["l_orderkey"], "idx", "name"),
    """WITH q AS (SELECT l_orderkey, l_linenumber AS idx, CASE l_partkey % 9 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'nir' WHEN 3 THEN 'swir' WHEN 4 THEN 'vv' WHEN 6 THEN 'nir' END AS role FROM lineitem)
    SELECT l_orderkey, role, min(idx) AS idx FROM q WHERE role IS NOT NULL GROUP BY ALL""",
)
register(
    "p02_band_roles_strict", lambda s, d: K.band_roles_strict(_bands(s, d), ["l_orderkey"], "idx", "name", "colour", "nm", "sentinel2"),
    """WITH q AS (SELECT l_orderkey, l_linenumber AS idx, l_partkey % 9 AS k, l_suppkey % 5 AS t, CASE WHEN l_partkey % 4 = 0 THEN 400 + l_suppkey % 50 * 40 END AS nm, l_orderkey % 2 = 0 AS s2 FROM lineitem),
    w AS (SELECT l_orderkey, idx, list_distinct(list_filter([CASE WHEN k IN (2, 8) THEN 'nir' WHEN k = 3 THEN 'swir' WHEN k = 4 THEN 'vv' WHEN k = 6 THEN 'narrow_nir' END,
        CASE WHEN s2 THEN CASE k WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 6 THEN 'narrow_nir' WHEN 7 THEN 'blue' END END, CASE t WHEN 0 THEN 'red' WHEN 1 THEN 'blue' END,
        CASE WHEN nm BETWEEN 450 AND 510 THEN 'blue' WHEN nm BETWEEN 520 AND 600 THEN 'green' WHEN nm BETWEEN 630 AND 690 THEN 'red' WHEN nm BETWEEN 855 AND 890 THEN 'narrow_nir'
            WHEN nm BETWEEN 780 AND 854 THEN 'nir' WHEN nm BETWEEN 1550 AND 1750 THEN 'swir' WHEN nm BETWEEN 2080 AND 2350 THEN 'swir2' END], lambda x: x IS NOT NULL)) AS roles FROM q),
    o AS (SELECT l_orderkey, idx, unnest(roles) AS role, len(roles) > 1 AS torn FROM w),
    g AS (SELECT l_orderkey, role, min(idx) AS idx FROM o GROUP BY l_orderkey, role HAVING count(DISTINCT idx) = 1 AND NOT bool_or(torn))
    SELECT * FROM g UNION ALL SELECT l_orderkey, 'swir1', idx FROM g WHERE role = 'swir'""",
)
given(
    "p36_select_channels", "part", "p_partkey", {"n": "p_size % 5", "nir": "CASE WHEN p_size % 3 > 0 THEN p_size % 7 END"},
    lambda: (lambda x: {"channels": F.array_join(F.transform(x["channels"], lambda i: i.cast("string")), ","), "problem": x["problem"]})(
        K.select_channels(F.create_map(F.lit("nir"), c("nir"), F.lit("red"), F.lit(1)), ("nir", "red"), c("n"))),
    {"channels": "CASE WHEN nir BETWEEN 1 AND n AND n >= 1 THEN nir || ',1' END", "problem": "CASE WHEN nir IS NULL THEN 'missing' WHEN nir < 1 OR nir > n OR n < 1 THEN 'out_of_range' END"},
)
register(
    "p20_radiometry_check", lambda s, d: K.radiometry_check(px(s, d).select("r", (c("red") * F.when(c("r") % 3 == 0, 255.0).otherwise(1 + (c("r") % 5 == 1).cast("int"))).alias("x")), ["r"], ["x"], c("r") % 3 == 0),
    f"WITH {PX} SELECT r, CASE WHEN r % 3 = 0 THEN 'uint8 / 255' ELSE 'metadata' END AS method, coalesce(max(red * CASE WHEN r % 3 > 0 AND r % 5 = 1 THEN 2 ELSE 1 END) <= 1.00001, true) AS is_ok FROM s GROUP BY r",
)
_AT = "least(greatest(({i} + 0.5) * {n} / {m} - 0.5, 0), {n} - 1)"
_FOUR = f"""{{grid}}, n AS (SELECT y, x, CAST(floor(sy) AS INT) + i AS r, CAST(floor(sx) AS INT) + j AS c, CASE i WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END * CASE j WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS w
    FROM g, range(2) a(i), range(2) b(j)) SELECT y AS r, x AS c, sum(red * w) / nullif(sum(w) FILTER (red IS NOT NULL), 0) AS red FROM n LEFT JOIN s USING (r, c) WHERE w > 0 GROUP BY y, x"""
_GRID = f"WITH {PX}, h AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM s), g AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, {_AT.format(i='y', n='h', m='20')} AS sy, {_AT.format(i='x', n='w', m='24')} AS sx FROM h, range(20) t(y), range(24) u(x))"
register("p31_resample", lambda s, d: K.resample(px(s, d), ["scene"], "red", 20, 24).select("r", "c", "red"), _FOUR.format(grid=_GRID), "red")
register(
    "p31_resample_nearest", lambda s, d: K.resample(px(s, d), ["scene"], "red", 20, 24, "nearest").select("r", "c", "red"),
    f"{_GRID} SELECT y AS r, x AS c, red FROM g LEFT JOIN s ON s.r = floor(sy + 0.5) AND s.c = floor(sx + 0.5)", "red",
)
register(
    "t05_warp_affine", lambda s, d: K.warp_affine(px(s, d), px(s, d).select("scene", "r", "c"), ["scene"], "red", (0.75, 0.25, 1.5, -0.125, 1.0, 2.25)).select("r", "c", "red"),
    _FOUR.format(grid=f"WITH {PX}, g AS (SELECT r AS y, c AS x, 0.75 * r + 0.25 * c + 1.5 AS sy, -0.125 * r + c + 2.25 AS sx FROM s)"), "red",
)
register("t02_similarity", lambda s, d: K.similarity(px(s, d), ["scene"], "red", "red2"), f"WITH {PX} SELECT 1 AS scene, CASE WHEN count(*) < 64 THEN 0 ELSE least(1, greatest(0, corr(red, red2))) END AS similarity FROM s WHERE red IS NOT NULL AND red2 IS NOT NULL", "similarity")

# F: masks -----------------------------------------------------------------------------------------------------------
_FLOOD = f"""WITH RECURSIVE {PX}, m AS (SELECT r, c, coalesce(red < 0.44, false) AS dark FROM s), z AS (SELECT max(r) AS h, max(c) AS w FROM s),
    f AS (SELECT r, c FROM m, z WHERE dark AND (r = 0 OR c = 0 OR r = h OR c = w) UNION SELECT m.r, m.c FROM f JOIN m ON dark AND abs(m.r - f.r) + abs(m.c - f.c) = 1)"""


def _height(s, d: str) -> int:
    return S.derived_scene(s, d).agg(F.max("r")).first()[0] + 1


register(
    "f02_border_padding_mask", lambda s, d: K.border_padding(px(s, d), c("red") < 0.44, _height(s, d), 64, tile=16),
    f"{_FLOOD} SELECT CAST(m.r AS BIGINT) AS r, CAST(m.c AS BIGINT) AS c, f.r IS NULL AS is_valid FROM m LEFT JOIN f USING (r, c)",
)
_HOLES = f"""WITH RECURSIVE {PX}, m AS (SELECT r, c, r * 64 + c AS id, coalesce(red >= 0.44, false) AS mask FROM s), o AS (SELECT * FROM m WHERE NOT mask),
    e AS (SELECT a.id AS u, b.id AS v FROM o a JOIN o b ON abs(a.r - b.r) + abs(a.c - b.c) = 1), k AS (SELECT id AS u, id AS label FROM o UNION SELECT e.v, k.label FROM k JOIN e ON e.u = k.u),
    l AS (SELECT u AS id, min(label) AS label FROM k GROUP BY u), z AS (SELECT label FROM l GROUP BY label HAVING count(*) <= 5)"""
register(
    "g04_fill_holes", lambda s, d: K.fill_holes(px(s, d), c("red") >= 0.44, 64, 5, tile=16),
    f"{_HOLES} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, mask OR coalesce(label IN (SELECT label FROM z), false) AS is_mask FROM m LEFT JOIN l USING (id)",
)
register(
    "f09_sar_water_score", lambda s, d: K.sar_water_score(px(s, d).select("scene", "r", "c", (30 * c("red") - 32).alias("db"), (12 * F.abs(c("green") - 0.5)).alias("g"), F.when(c("r") % 2 == 0, -12 * c("nir")).alias("x")), ["scene"], c("db"), c("g"), c("x")).select("r", "c", "score"),
    f"""WITH {PX}, q AS (SELECT r, c, 30 * red - 32 AS db, 12 * abs(green - 0.5) AS g, CASE WHEN r % 2 = 0 THEN -12 * nir END AS x FROM s),
    m AS (SELECT greatest(-20, least(-8, (quantile_cont(db, 0.1) + quantile_cont(db, 0.5)) / 2)) AS mid FROM q), t AS (SELECT *, greatest(0, least(1, (mid - 2 - db) / 8)) AS a FROM q, m),
    u AS (SELECT *, CASE WHEN x IS NOT NULL THEN 0.65 * a + 0.35 * greatest(0, least(1, (-4 - x) / 6)) ELSE a END AS b FROM t)
    SELECT r, c, CASE WHEN db IS NULL THEN 0 WHEN g > 3.5 OR db > -3 THEN least(b, 0.08) ELSE b END AS score FROM u""", "score",
)
register(
    "t21_radar_profile", lambda s, d: K.radar_profile(px(s, d), ["r"], 60 * c("red") - 45),
    f"""WITH {PX}, q AS (SELECT r, 60 * red - 45 AS db FROM s), m AS (SELECT r, round(avg(db), 2) AS mean_db, round(min(db), 2) AS min_db, round(max(db), 2) AS max_db, round(stddev_pop(db), 2) AS std_db,
        round(100.0 * count(*) FILTER (db >= -10) / count(db), 2) AS structural, round(100.0 * count(*) FILTER (db <= -20) / count(db), 2) AS specular, round(100.0 * count(*) FILTER (db > -20 AND db < -10) / count(db), 2) AS volume FROM q GROUP BY r)
    SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN structural > 5 THEN 'structural' END, CASE WHEN specular > 5 THEN 'specular' END, CASE WHEN volume > 10 THEN 'volume' END), ''), 'uniform') AS summary FROM m""",
    "mean_db min_db max_db std_db structural specular volume",
)
register(
    "a21_flood_summary", lambda s, d: C.flood_summary(px(s, d).select("r", F.when(c("red") > 0.55, 1).when(c("red") > 0.42, 0).otherwise(2).alias("k")), ["r"], "k"),
    f"""WITH {PX}, q AS (SELECT r, CASE WHEN red > 0.55 THEN 1 WHEN red > 0.42 THEN 0 ELSE 2 END AS k FROM s), m AS (SELECT r, count(*) FILTER (k = 0) AS dry, count(*) FILTER (k = 1) AS flood, count(*) FILTER (k = 2) AS cloud FROM q GROUP BY r)
    SELECT *, round(flood / greatest(flood + dry, 1), 6) AS flood_share, CASE WHEN flood / greatest(flood + dry, 1) >= 0.10 THEN 'flood' WHEN cloud / (dry + flood + cloud) >= 0.50 THEN 'cloud_nodata' ELSE 'no_flood' END AS dominant FROM m""",
    "flood_share",
)

# N, G, J: distances, regions, matches -------------------------------------------------------------------------------
register(
    "n14_distance_to_background", lambda s, d: K.distance_to_background(px(s, d), ["scene"], c("red") > 0.42).drop("scene"),
    f"""WITH {PX}, m AS (SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, coalesce(red > 0.42, false) AS m FROM s)
    SELECT a.r, a.c, sqrt(min((a.r - b.r) ** 2 + (a.c - b.c) ** 2)) AS distance FROM m a, m b WHERE a.m AND NOT b.m GROUP BY a.r, a.c""", "distance",
)
register(
    "g06_region_shape", lambda s, d: K.region_shape(labels(s, d)),
    f"""{_CC}, n AS (SELECT a.r, a.c, a.label, count(b.r) AS near FROM l a LEFT JOIN l b ON a.label = b.label AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL),
    w2 AS (SELECT label, count(*) AS pixels, count(*) FILTER (near < 4) AS perimeter, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM n GROUP BY label)
    SELECT label, pixels, perimeter, greatest(h, w) / least(h, w) AS elongation, 4 * pi() * pixels / perimeter ** 2 AS compactness FROM w2""", "elongation compactness",
)
register(
    "g19_multi_part_union", lambda s, d: G.multi_part_union(table(s, d, "lineitem").select("l_orderkey", F.concat_ws(" ", "l_linenumber", "l_partkey").alias("part"), c("l_linenumber").alias("area")), "l_orderkey", "part", "area").select("l_orderkey", F.array_join("parts", "; ").alias("parts"), "area"),
    "WITH q AS (SELECT l_orderkey, l_linenumber || ' ' || l_partkey AS part, l_linenumber AS area FROM lineitem) SELECT l_orderkey, string_agg(part, '; ' ORDER BY part) AS parts, CAST(sum(area) AS BIGINT) AS area FROM q GROUP BY l_orderkey",
)
register(
    "j04_mask_join", lambda s, d: K.mask_join(px(s, d).select("scene", "r", "c", "red"), px(s, d).where("(r + c) % 7 > 0").select("scene", "r", "c", c("nir").alias("mask")), ["scene"], "mask")[0].select("r", "c", "red", "mask"),
    f"WITH {PX} SELECT r, c, red, CASE WHEN (r + c) % 7 > 0 THEN nir END AS mask FROM s", "red mask",
)
register(
    "j04_mask_problems", lambda s, d: K.mask_join(px(s, d).select(c("r").alias("row"), "r", "c"), px(s, d).where("(r + c) % 7 > 0").select(c("r").alias("row"), "r", (c("c") + 1).alias("c"), c("nir").alias("mask")), ["row"], "mask")[1],
    f"""WITH {PX}, m AS (SELECT r, c + 1 AS c FROM s WHERE (r + c) % 7 > 0), f AS (SELECT coalesce(s.r, m.r) AS row, s.r IS NULL AS extra, m.r IS NULL AS missing FROM s FULL JOIN m ON s.r = m.r AND s.c = m.c)
    SELECT row, count(*) FILTER (missing) AS missing, count(*) FILTER (extra) AS extra FROM f GROUP BY row HAVING count(*) FILTER (missing OR extra) > 0""",
)
register(
    "j05_tile_join_pixels", lambda s, d: K.tile_join_pixels(px(s, d).select("r", "c", "red"), 4096, 64, 24, 16).groupBy("ty", "tx").agg(F.count("*").alias("n"), F.avg("red").alias("red")),
    f"WITH {PX}, x AS (SELECT unnest([0, 16, 32, 40]) AS tx), y AS (SELECT CAST(unnest(range(0, 4073, 16)) AS INT) AS ty UNION SELECT 4072) SELECT ty, tx, count(*) AS n, avg(red) AS red FROM s, x, y WHERE ty <= r AND r < ty + 24 AND tx <= c AND c < tx + 24 GROUP BY ty, tx", "red",
)


def sides(s, d: str, even: bool) -> DataFrame:
    """Squares of 448 in rows of twenty; the second set is shifted by up to 299, and every eleventh is missing there."""
    v = c("vec_id")
    df = table(s, d, "embeddings").select(v.alias("id"), F.floor(v / 20).alias("scene"), (v % 20 * 600 + (F.lit(0) if even else v * 37 % 300)).cast("int").alias("x"), (F.floor(v / 20) * 1000).cast("int").alias("y"), F.lit(448).alias("w"), F.lit(448).alias("h"), F.lit(448 * 448).alias("area"))
    return df if even else df.where("id % 11 > 0")


def overlaps(s, d: str) -> DataFrame:
    boxes = sides(s, d, True).withColumn("id", 2 * c("id")).unionByName(sides(s, d, False).withColumn("id", 2 * c("id") + 1)).select("id", "x", "y", "w", "h")
    both = T.bbox_overlap_join(boxes, 448).where("(a_id + b_id) % 2 = 1 AND iou > 0")
    even = F.when(c("a_id") % 2 == 0, c("a_id")).otherwise(c("b_id"))
    return both.select((even / 2).cast("long").alias("a"), ((c("a_id") + c("b_id") - even - 1) / 2).cast("long").alias("b"), "iou")


def matched(s, d: str, least: float) -> DataFrame:
    return M.one_to_one_match(overlaps(s, d), least).withColumn("scene", F.floor(c("a") / 20))


# moved squares overlap their own original most, so the best assignment is known
_DIAGONAL = "WITH e AS (SELECT vec_id AS id, vec_id // 20 AS scene, vec_id % 11 > 0 AS seen, (448 - vec_id * 37 % 300) / CAST(448 + vec_id * 37 % 300 AS DOUBLE) AS iou FROM embeddings)"
register("j14_one_to_one_match", lambda s, d: matched(s, d, 0.3).drop("scene"), f"{_DIAGONAL} SELECT id AS a, id AS b, iou FROM e WHERE seen AND iou >= 0.3", "iou")
_SUMS = f"{_DIAGONAL}, g AS (SELECT scene, count(*) AS n_a, count(*) FILTER (seen) AS n_b, count(*) FILTER (seen AND iou >= {{t}}) AS m, coalesce(avg(iou) FILTER (seen AND iou >= {{t}}), 0) AS miou FROM e GROUP BY scene)"
register(
    "v04_instance_metrics", lambda s, d: M.instance_metrics(sides(s, d, True), sides(s, d, False), matched(s, d, 0.5), ["scene"]),
    _SUMS.format(t=0.5) + " SELECT scene, coalesce(m / nullif(n_b, 0), 0) AS precision, m / n_a AS recall, 2 * m / (n_a + n_b) AS f1, miou AS matched_iou, abs(n_b - n_a) AS count_error, abs(n_b - n_a) / n_a AS relative_error FROM g",
    "precision recall f1 matched_iou relative_error",
)
register(
    "t22_instance_change", lambda s, d: M.instance_change(sides(s, d, True), sides(s, d, False), matched(s, d, 0.3), ["scene"]),
    _SUMS.format(t=0.3) + " SELECT scene, n_a AS before_n, n_b AS after_n, n_b - n_a AS net, 100 * (n_b - n_a) / n_a AS net_percent, m AS persistent, n_b - m AS possible_new, n_a - m AS possible_removed, (n_b - n_a) * 200704 AS net_area FROM g", "net_percent",
)
register(
    "t22_change_status", lambda s, d: M.change_status(sides(s, d, True), matched(s, d, 0.3), "a", "REMOVED").select("id", "status", "candidate_type"),
    f"{_DIAGONAL} SELECT id, CASE WHEN seen AND iou >= 0.3 THEN 'UNCHANGED' ELSE 'POSSIBLE_CHANGE' END AS status, CASE WHEN NOT (seen AND iou >= 0.3) THEN 'REMOVED' END AS candidate_type FROM e",
)

# R, D: tiles --------------------------------------------------------------------------------------------------------
_STARTS = "list_distinct(list_transform(range(-32, {n} + 32, 192), lambda x: least(x, {n} + 32 - 256)))"
register(
    "r03_tile_grid_with_margin", lambda s, d: K.tile_grid_with_margin(table(s, d, "part").select("p_partkey", (c("p_size") * 40 + 100).alias("sw"), (c("p_size") * 20 + 90).alias("sh")), "sw", "sh", 256, 32).select("p_partkey", "x", "y"),
    f"WITH q AS (SELECT p_partkey, p_size * 40 + 100 AS sw, p_size * 20 + 90 AS sh FROM part), x AS (SELECT *, CAST(unnest({_STARTS.format(n='sw')}) AS INT) AS x FROM q) SELECT p_partkey, x, CAST(unnest({_STARTS.format(n='sh')}) AS INT) AS y FROM x",
)


def _padded(s, d: str, mode: str) -> DataFrame:
    """Every row of the scene as a short tile of 64, padded by five cells on both sides."""
    cells = px(s, d).where("c = 0").select("r", F.explode(F.sequence(F.lit(-5), F.lit(68))).alias("k")).withColumn("c", K.padded_index(c("k"), 64, mode))
    return cells.join(px(s, d).select("r", "c", "red"), ["r", "c"], "left").select("r", "k", "red")


for _mode, _where in (("reflect", "CASE WHEN k < 0 THEN -k WHEN k > 63 THEN 126 - k ELSE k END"), ("edge", "least(greatest(k, 0), 63)"), ("zero", "k")):
    register(f"r04_pad_tile_{_mode}", lambda s, d, m=_mode: _padded(s, d, m), f"WITH {PX}, q AS (SELECT DISTINCT r, CAST(k AS INT) AS k FROM s, range(-5, 69) t(k)) SELECT q.r, k, red FROM q LEFT JOIN s ON s.r = q.r AND s.c = {_where}", "red")


def _three(grid: np.ndarray) -> np.ndarray:
    """A predictor for the tests: three classes from a cell's value."""
    raw = np.stack([grid, 1 - grid, np.full_like(grid, 0.5)], axis=2)
    return raw / raw.sum(axis=2, keepdims=True)


def _tiles(s, d: str) -> DataFrame:
    return S.pixels_to_tiles(S.derived_pixels(s, d), ["r", "b"], ["c"], "v")


register(
    "r05_score_tiles", lambda s, d: K.score_tiles(_tiles(s, d), ["r", "b"], "values", _three, 3).select("r", "b", F.posexplode("scores").alias("p", "score")).where("p % 3 = 1").select("r", "b", F.floor(c("p") / 3).cast("int").alias("c"), "score"),
    f"WITH {PX} SELECT r, b, c, (1 - v) / 1.5 AS score FROM px", "score",
)
_BLEND = "CASE WHEN c < 32 THEN c + 1 ELSE 64 - c END"
register(
    "r06_blend_tiles", lambda s, d: T.blend_tiles(S.derived_pixels(s, d).select("r", c("c").alias("x"), c("v").alias("p"), F.least(c("c") + 1, 64 - c("c")).alias("w")), ["r", "x"], "p", "w"),
    f"WITH {PX} SELECT r, c AS x, sum(v * ({_BLEND})) / sum({_BLEND}) AS p FROM px GROUP BY r, c", "p",
)
register(
    "r07_crop_margin_mosaic", lambda s, d: K.crop_margin_mosaic(S.derived_pixels(s, d).select((F.floor(c("r") / 16) * 14 - 2).cast("int").alias("y"), (c("b") * 60 - 2).alias("x"), (c("r") % 16).alias("i"), c("c").alias("j"), "v"), 64, 2).select("r", "c", "v"),
    f"WITH {PX}, q AS (SELECT r // 16 * 14 - 2 AS y, b * 60 - 2 AS x, r % 16 AS i, c AS j, v FROM px) SELECT CAST(y + i AS INT) AS r, x + j AS c, v FROM q WHERE i BETWEEN 2 AND 61 AND j BETWEEN 2 AND 61", "v",
)


def _greatest(grid: np.ndarray) -> np.ndarray:
    """The largest value in three by three cells."""
    shifts = [grid[i : len(grid) - 2 + i, j : grid.shape[1] - 2 + j] for i in range(3) for j in range(3)]
    return np.pad(np.fmax.reduce(shifts), 1, constant_values=np.nan)


register(
    "d02_tile_fn", lambda s, d: K.on_halo_tiles(px(s, d).where("red IS NOT NULL"), "red", 16, 1, _greatest),
    f"WITH {PX}, q AS (SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, red FROM s WHERE red IS NOT NULL) SELECT a.r, a.c, max(b.red) AS red FROM q a JOIN q b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c", "red",
)


def _middle(pdf):
    pdf = pdf.sort_values(["label", "r", "c"])
    at = pdf.groupby("label")["r"]
    return pdf[at.cumcount() == at.transform("size") // 2][["label", "r", "c"]]


register(
    "d03_region_fn", lambda s, d: K.region_fn(labels(s, d), "label", _middle, "label long, r long, c long"),
    f"{_CC} SELECT label, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY r, c) = count(*) OVER (PARTITION BY label) // 2 + 1",
)

# S, L, U, X, V: catalog, order, evaluation --------------------------------------------------------------------------
register(
    "s07_choose_variable", lambda s, d: C.choose_variable(table(s, d, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("name"), (c("l_linenumber") % 4).alias("w"), c("l_linenumber").alias("h"), (c("l_partkey") % 20).alias("n")), ["l_orderkey"], "name", "w", "h", "n"),
    """WITH q AS (SELECT l_orderkey, l_returnflag || l_linestatus AS name, (l_linenumber % 4) * l_linenumber * greatest(1, least(l_partkey % 20, 16)) AS score FROM lineitem WHERE l_linenumber % 4 > 1 AND l_linenumber > 1)
    SELECT l_orderkey, name, CAST(score AS BIGINT) AS score FROM q QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, name) = 1""",
)
register(
    "s14_append_message", lambda s, d: C.append_messages(table(s, d, "conversations").groupBy("conv_id").agg(F.lit(0).cast("long").alias("updated")), table(s, d, "conversations").where("turn < 3").select("conv_id", c("turn").alias("at"), "role"), table(s, d, "conversations").where("turn >= 3").select("conv_id", c("turn").alias("at"), "role"), "conv_id", "at", "updated")[1],
    "SELECT conv_id, CAST(coalesce(max(turn) FILTER (turn >= 3), 0) AS BIGINT) AS updated FROM conversations GROUP BY conv_id",
)
register(
    "s16_write_scene_report", lambda s, d: C.scene_report(table(s, d, "lineitem"), ["l_linenumber"], {"n": F.count("*"), "parts": F.count_distinct("l_partkey")}),
    """WITH a AS (SELECT l_linenumber AS k, count(*) AS n, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY ROLLUP (l_linenumber)) SELECT CASE WHEN k IS NULL THEN 'global' ELSE 'by_scene' END AS part,
    CASE WHEN k IS NOT NULL THEN '{"l_linenumber":' || k || '}' END AS scene, '{"n":' || n || ',"parts":' || p || '}' AS metrics FROM a""",
)
register("l03_messages_in_order", lambda s, d: C.in_order(table(s, d, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "place"), "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
register(
    "l08_region_order", lambda s, d: C.in_order(table(s, d, "customer"), ["c_nationkey"], [F.when(c("c_nationkey") % 2 == 0, -c("c_acctbal")).otherwise(F.lit(0.0)), -(c("c_custkey") % 7), -c("c_acctbal"), "c_custkey"]).select("c_custkey", "place"),
    "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_nationkey % 2 = 0 THEN -c_acctbal ELSE 0 END, -(c_custkey % 7), -c_acctbal, c_custkey) AS place FROM customer",
)
register(
    "u02_union_records", lambda s, d: C.union_records([table(s, d, "orders").where("o_orderkey % 3 < 2").select("o_orderkey", c("o_orderstatus").alias("x")), table(s, d, "orders").where("o_orderkey % 3 > 0").select("o_orderkey", F.lower("o_orderpriority").alias("x"))], ["o_orderkey"]),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus ELSE lower(o_orderpriority) END AS x FROM orders",
)
register(
    "x26_order_coverage", lambda s, d: C.in_order(table(s, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("p")), ["l_orderkey"], [(c("l_returnflag") == "N").cast("int"), F.desc("p"), "l_returnflag"]).select("l_orderkey", "l_returnflag", "place"),
    "WITH q AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS p FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'N', p DESC, l_returnflag) AS place FROM q",
)
_CELLS = "WITH q AS (SELECT label AS t, CAST((list_position(embedding, list_max(embedding)) - 1) % 10 AS INT) AS p FROM embeddings WHERE label NOT IN (3, 7)), k AS (SELECT * FROM q WHERE p NOT IN (3, 7)), c AS (SELECT CAST(i AS INT) AS class FROM range(10) t(i) WHERE i NOT IN (3, 7))"
register(
    "v02_percent_metrics_weighted", lambda s, d: A.percent_metrics(A.confusion(table(s, d, "embeddings").select("label", ((F.array_position("embedding", F.array_max("embedding")) - 1) % 10).cast("int").alias("p")), "label", "p", 10), {i: 0.0 if i in (3, 7) else 1.0 for i in range(10)}),
    _CELLS + """, m AS (SELECT class, (SELECT count(*) FROM k WHERE t = class AND p = class) AS tp, (SELECT count(*) FROM k WHERE t = class) AS a, (SELECT count(*) FROM k WHERE p = class) AS b FROM c)
    SELECT class, coalesce(100.0 * tp / nullif(a + b - tp, 0), 0) AS iou, coalesce(100.0 * tp / nullif(b, 0), 0) AS precision, coalesce(100.0 * tp / nullif(a, 0), 0) AS recall, coalesce(200.0 * tp / nullif(a + b, 0), 0) AS f1,
        100.0 * (SELECT count(*) FROM k WHERE t = p) / (SELECT count(*) FROM k) AS accuracy FROM m""", "iou precision recall f1 accuracy",
)
register(
    "f10_sensor_masks", lambda s, d: K.sensor_masks(px(s, d).select("scene", "r", "c", (c("green") - c("nir")).alias("ndwi"), (c("swir") - c("nir")).alias("ndbi"), (60 * c("red") - 48).alias("db")), ["scene"], c("ndwi"), c("ndbi"), c("db")).select("r", "c", "is_water", "is_dark", "is_built", "is_bright"),
    f"""WITH {PX}, q AS (SELECT r, c, green - nir AS ndwi, swir - nir AS ndbi, 60 * red - 48 AS db FROM s), m AS (SELECT quantile_cont(ndbi, 0.75) AS cut FROM q)
    SELECT r, c, coalesce(ndwi >= 0.12, false) AS is_water, coalesce(db <= -20, false) AS is_dark, coalesce(ndbi >= cut, false) AS is_built, coalesce(db >= -10, false) AS is_bright FROM q, m""",
)


def _corner_sums(rings):
    """Shoelace area and outline length of a polygon's rings."""
    plus = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)
    turned = lambda r: F.concat(F.slice(r, F.lit(2), F.size(r) - 1), F.slice(r, 1, 1))
    total = lambda of: plus(F.transform(rings, lambda r: plus(F.zip_with(r, turned(r), of))))
    area = total(lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2
    return area.cast("long"), total(lambda a, b: F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]))


def _polygons(s, d: str) -> DataFrame:
    return O.polygonize(labels(s, d))


register(
    "g16_polygonize", lambda s, d: _polygons(s, d).select("label", *[x.alias(n) for n, x in zip(("area", "length"), _corner_sums(c("rings")), strict=True)]),
    f"""{_CC}, n AS (SELECT a.r, a.c, a.label, count(b.r) AS near FROM l a LEFT JOIN l b ON a.label = b.label AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL)
    SELECT label, count(*) AS area, CAST(sum(4 - near) AS BIGINT) AS length FROM n GROUP BY label HAVING count(*) >= 4""",
)
register(
    "q08_geometry_matches_mask",
    lambda s, d: O.geometry_matches_mask(_polygons(s, d).withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + (c("label") % 2)).alias("x"), p["y"].alias("y"))))), G.filter_small(labels(s, d), 4)),
    f"""{_CC}, own AS (SELECT * FROM l WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 4)), p AS (SELECT r, CAST(c + label % 2 AS INT) AS c, label FROM own),
    f AS (SELECT coalesce(own.label, p.label) AS label, p.label IS NULL AS missing, own.label IS NULL AS extra FROM own FULL JOIN p ON own.label = p.label AND own.r = p.r AND own.c = p.c)
    SELECT label, count(*) FILTER (missing) AS missing, count(*) FILTER (extra) AS extra FROM f GROUP BY label HAVING count(*) FILTER (missing OR extra) > 0""",
)
