"""Queries of change maps, sensor fusion and search reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import change as H
from ..sources import scenes as S
from .analysis import BOTH, pair
from .registry import _WIN, PX, register, table, windows

c = F.col


def _near(alias: str, other: str, h: int) -> str:
    return f"{other}.r BETWEEN {alias}.r - {h} AND {alias}.r + {h} AND {other}.c BETWEEN {alias}.c - {h} AND {alias}.c + {h}"


def _norm(source: str) -> str:
    return f"""mm AS (SELECT avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM {source}),
    nn AS (SELECT r, c, a, CASE WHEN sa > 0.02 AND sb > 0.02 AND sa / sb > 0.25 AND sa / sb < 4 THEN least(1, greatest(0, (b - mb) * sa / sb + ma)) ELSE b END AS b FROM {source}, mm)"""


_SSIM = """least(1.0, greatest(-1.0, ((2 * avg(o.a) * avg(o.b) + 0.0001) * (2 * (avg(o.a * o.b) - avg(o.a) * avg(o.b)) + 0.0009))
    / ((avg(o.a) ** 2 + avg(o.b) ** 2 + 0.0001) * (avg(o.a ** 2) - avg(o.a) ** 2 + avg(o.b ** 2) - avg(o.b) ** 2 + 0.0009))))"""
_BASELINE = f"""{BOTH}, {_norm('p')},
    v AS (SELECT x.r, x.c, 0.55 * max(abs(x.a - x.b)) + 0.45 * (1 - ({_SSIM} + 1) / 2) AS p FROM nn x JOIN nn o ON {_near('x', 'o', 3)} GROUP BY x.r, x.c),
    h AS (SELECT CAST(least(floor(p * 256), 255) AS INT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY 1),
    u AS (SELECT bin, sum(n) OVER k AS w, sum(n * bin) OVER k AS m, sum(n) OVER () AS ww, sum(n * bin) OVER () AS mm FROM h WINDOW k AS (ORDER BY bin)),
    t AS (SELECT CASE WHEN ww = w THEN 0.15 ELSE least(0.45, greatest(0.08, bin / 256.0)) END AS t FROM u
        ORDER BY CASE WHEN ww > w THEN round(w * (ww - w) * power((m / w - (mm - m) / (ww - w)) / 256, 2) / (ww * ww), 12) ELSE 0 END DESC, bin LIMIT 1),
    k0 AS (SELECT r, c, p, p >= t AS m FROM v, t),
    k1 AS (SELECT x.r, x.c, count(*) FILTER (o.m) = 9 AS m FROM k0 x JOIN k0 o ON {_near('x', 'o', 1)} GROUP BY x.r, x.c),
    k2 AS (SELECT x.r, x.c, bool_or(o.m) AS m FROM k1 x JOIN k1 o ON {_near('x', 'o', 1)} GROUP BY x.r, x.c),
    k3 AS (SELECT x.r, x.c, bool_or(o.m) AS m FROM k2 x JOIN k2 o ON {_near('x', 'o', 1)} GROUP BY x.r, x.c),
    k4 AS (SELECT x.r, x.c, count(*) FILTER (o.m) = 9 AS m FROM k3 x JOIN k3 o ON {_near('x', 'o', 1)} GROUP BY x.r, x.c)"""
register(
    "t08_change_baseline", lambda s, d: H.change_baseline(pair(s, d), ["scene"], "a", "b"),
    f"{_BASELINE} SELECT 1 AS scene, r, c, p, k4.m AS changed FROM k0 JOIN k4 USING (r, c)", "p",
)
_UNIT = "CASE WHEN hi > lo THEN least(1, greatest(0, ({} - lo) / (hi - lo))) ELSE 0 END"
_RADIOMETRIC = f"""{BOTH}, e0 AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi, min(v) AS least, max(v) AS most FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p)),
    e AS (SELECT CASE WHEN hi > lo THEN lo ELSE least END AS lo, CASE WHEN hi > lo THEN hi ELSE most END AS hi FROM e0),
    st AS (SELECT r, c, {_UNIT.format('a')} AS a, {_UNIT.format('b')} AS b FROM p, e), {_norm('st')},
    f AS (SELECT r, c, abs(a - b) AS d FROM nn), md AS (SELECT median(d) AS md FROM f),
    th AS (SELECT greatest(0.08, max(md) + 3 * greatest(median(abs(d - md)), 0.01)) AS t FROM f, md), k AS (SELECT r, c, d, d > t AS m FROM f, th),
    g AS (SELECT x.r, x.c, max(x.d) AS d, bool_or(x.m) AND count(*) FILTER (o.m) >= 4 AS changed FROM k x JOIN k o ON {_near('x', 'o', 1)} GROUP BY x.r, x.c)"""
register("t09_change_radiometric", lambda s, d: H.change_radiometric(pair(s, d), ["scene"], "a", "b"), f"{_RADIOMETRIC} SELECT 1 AS scene, r, c, d, changed FROM g", "d")
register(
    "t09_change_summary", lambda s, d: H.change_summary(H.change_radiometric(pair(s, d), ["scene"], "a", "b"), ["scene"], "d"),
    f"""{_RADIOMETRIC} SELECT 1 AS scene, count(*) FILTER (changed) AS changed, count(*) AS cells, round(100.0 * count(*) FILTER (changed) / count(*), 3) AS percent,
    round(coalesce(avg(d) FILTER (changed), 0), 4) AS intensity FROM g""", "percent intensity",
)


def _fusion(s, d: str) -> DataFrame:
    optical, radar = H.fusion_masks("water", (c("red") + c("green") + c("nir")) / 3, c("swir") - 0.2, c("green") - c("nir"))
    return H.sensor_fusion(S.derived_scene(s, d), ["c"], optical, radar)


register(
    "t18_sensor_fusion", _fusion,
    f"""WITH {PX}, q AS (SELECT c, coalesce(green - nir >= 0.12, false) AS o, coalesce(swir - 0.2 <= 0.28, false) AS m FROM s),
    k AS (SELECT c, count(*) FILTER (o AND m) / greatest(count(*) FILTER (o OR m), 1) AS x, 100.0 * count(*) FILTER (o AND m) / count(*) AS f FROM q GROUP BY c)
    SELECT c, round(x, 3) AS agreement, round(x * 100, 2) AS iou_percent, round(f, 3) AS confirmed_percent,
    round(0.4 * 0.88 + 0.6 * least(1.0, greatest(0.1, round(x, 3) / 0.60)), 3) AS confidence FROM k""", "agreement iou_percent confirmed_percent confidence",
)
_TOLD = "CASE " + " ".join(f"WHEN coalesce(given = '{n}', false) OR coalesce(regexp_matches(lower(q), '{'|'.join(w)}'), false) THEN '{n}'" for n, w in H.FUSION_WORDS.items()) + " ELSE coalesce(nullif(given, ''), 'water') END"
register(
    "f10_fusion_target", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", H.fusion_target(F.element_at(F.array(F.lit(None), *map(F.lit, ("", "water", "road", "vegetation"))), (c("turn") % 5 + 1).cast("int")), c("text")).alias("target")),
    f"WITH q AS (SELECT conv_id, turn, text AS q, [NULL, '', 'water', 'road', 'vegetation'][turn % 5 + 1] AS given FROM conversations) SELECT conv_id, turn, {_TOLD} AS target FROM q",
)


def _fused(s, d: str) -> DataFrame:
    """Scenes of six rows and their targets in turn, every other one without spectral indices; radar and brightness are spread over 0..1."""
    px = S.derived_scene(s, d).withColumn("scene", F.floor(c("r") / 6).cast("int"))
    px = px.withColumn("target", F.element_at(F.array(*map(F.lit, ("water", "built-up", "vegetation", "general", "road"))), (c("scene") % 5 + 1).cast("int"))).withColumn("multispectral", c("scene") % 2 == 0)
    light, radar = 0.3 + 2 * ((c("red") + c("green") + c("nir")) / 3 - 0.5), 0.5 + 4 * (c("swir") - 0.5)
    return H.fused_masks(px, c("target"), c("multispectral"), light, radar, 4 * (c("green") - c("nir")), 4 * (c("nir") - c("red")), c("red"), c("green"))


_FUSED = f"""WITH RECURSIVE {PX}, v AS (SELECT *, r // 6 AS scene, ['water', 'built-up', 'vegetation', 'general', 'road'][r // 6 % 5 + 1] AS target, r // 6 % 2 = 0 AS multispectral, 0.3 + 2 * ((red + green + nir) / 3 - 0.5) AS light, 0.5 + 4 * (swir - 0.5) AS echo FROM s),
    m AS MATERIALIZED (SELECT CAST(scene AS INT) AS scene, r, c, target, multispectral,
        coalesce(CASE target WHEN 'water' THEN CASE WHEN multispectral THEN 4 * (green - nir) >= 0.12 ELSE light <= 0.25 END WHEN 'built-up' THEN light >= 0.4 WHEN 'vegetation' THEN CASE WHEN multispectral THEN 4 * (nir - red) >= 0.35 ELSE green > red END ELSE light >= 0.3 END, false) AS optical,
        coalesce(CASE target WHEN 'water' THEN echo <= 0.28 WHEN 'built-up' THEN echo >= 0.55 WHEN 'vegetation' THEN echo BETWEEN 0.35 AND 0.7 ELSE echo >= 0.35 END, false) AS radar FROM v)"""
register(
    "f10_fused_masks", lambda s, d: _fused(s, d).select("scene", "r", "c", "target", "optical", "radar", "seen"),
    f"{_FUSED} SELECT scene, r, c, target, optical, radar, CASE WHEN optical AND radar THEN 'both' WHEN optical THEN 'optical' WHEN radar THEN 'radar' END AS seen FROM m",
)
register(
    "t18_fusion_report", lambda s, d: H.fusion_report(_fused(s, d), ["scene", "target", "multispectral"], 64, c("multispectral"), tile=16),
    f"""{_FUSED}, z AS (SELECT scene, r, c, r * 64 + c AS label FROM m WHERE optical AND radar UNION SELECT n.scene, n.r, n.c, z.label FROM z JOIN m n ON n.optical AND n.radar AND n.scene = z.scene AND abs(n.r - z.r) + abs(n.c - z.c) = 1),
    l AS (SELECT scene, count(*) AS regions, sum(n) AS region_pixels FROM (SELECT scene, label, count(*) AS n FROM (SELECT scene, r, c, min(label) AS label FROM z GROUP BY scene, r, c) GROUP BY scene, label HAVING count(*) >= 4) GROUP BY scene),
    k AS (SELECT scene, target, multispectral, count(*) FILTER (optical AND radar) / greatest(count(*) FILTER (optical OR radar), 1) AS x, 100.0 * count(*) FILTER (optical AND radar) / count(*) AS f FROM m GROUP BY ALL)
    SELECT scene, target, multispectral, round(x, 3) AS agreement, round(x * 100, 2) AS iou_percent, round(f, 3) AS confirmed_percent,
    round(0.4 * CASE WHEN multispectral THEN 0.88 ELSE 0.82 END + 0.6 * least(1.0, greatest(0.1, round(x, 3) / 0.60)), 3) AS confidence,
    CAST(coalesce(regions, 0) AS BIGINT) AS regions, CAST(coalesce(region_pixels, 0) AS BIGINT) AS region_pixels FROM k LEFT JOIN l USING (scene)""", "agreement iou_percent confirmed_percent confidence",
)
#: As if every third tile overlapped a better one.
_KEPT = lambda: (c("score") >= 0.15) & (c("id") % 3 != 0)
register(
    "r14_retrieval_report", lambda s, d: H.retrieval_report(windows(s, d).select("id", "score"), _KEPT(), F.lit(0.15)),
    f"""WITH q AS (SELECT id, score, score >= 0.15 AND id % 3 <> 0 AS kept FROM ({_WIN}))
    SELECT id, score, row_number() OVER (ORDER BY NOT kept, score DESC, id) AS rank, kept AS is_relevant, CASE WHEN kept THEN NULL
    WHEN score < 0.15 THEN 'below the threshold (' || printf('%.2f', score) || ' < 0.15)' ELSE 'overlaps a better tile' END AS reason FROM q""", "score",
)
register(
    "r14_retrieval_summary", lambda s, d: H.retrieval_summary(windows(s, d), _KEPT(), F.lit(0.15)),
    f"""WITH q AS (SELECT score, score >= 0.15 AND id % 3 <> 0 AS kept FROM ({_WIN})),
    k AS (SELECT count(*) AS tiles, count(*) FILTER (kept) AS relevant, avg(score) FILTER (kept) AS m, max(score) AS peak FROM q)
    SELECT tiles, relevant, tiles - relevant AS excluded, 0.15 AS threshold, CASE WHEN relevant > 0 THEN round(m, 3) ELSE 0 END AS mean, peak,
    CASE WHEN relevant > 0 THEN round(0.4 * 0.85 + 0.6 * peak, 3) ELSE 0.35 END AS confidence FROM k""", "threshold mean peak confidence",
)
