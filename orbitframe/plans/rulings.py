"""Queries of rule tables: tasks of questions, modality of images, cards of runs, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import questions as Q
from .registry import register, table

c = F.col

# X03: questions put together from phrases, and all turns of the conversations -------------------------------------------
_OPEN = ("", "Describe this image and", "How many", "Where is the", "Compare", "Highlight the largest", "Identify", "Is there any", "What does SAR show about the", "Locate", "Who is the", "Map land cover with")
_WHAT = ("buildings", "water bodies", "forest canopy", "roads", "the river", "urban settlement", "objects", "vegetation", "it", "lake in the city", "crops", "structures", "mayor")
_REST = ("", "before and after 2020?", "using both images", "in this scene", "near Pune, over time", "and land use?", "with radar and optical data")
_pick = lambda words, by: "CASE " + by + " " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words)) + " END"
_ASKED = f"""SELECT CAST(o_orderkey AS BIGINT) AS id, {_pick(_OPEN, "o_orderkey % 12")} || ' ' || {_pick(_WHAT, "o_custkey % 13")} || ' ' || {_pick(_REST, "(o_orderkey + o_custkey) % 7")} AS q,
    CASE WHEN o_orderkey % 17 = 0 THEN 2 ELSE 1 END AS n, CASE WHEN o_orderkey % 29 = 0 THEN 'optical_sar' WHEN o_orderkey % 31 = 0 THEN 'bi_temporal' ELSE 'auto' END AS pair FROM orders
    UNION ALL SELECT -1 - (conv_id * 1000 + turn), text, 1, 'auto' FROM conversations"""


def _tasks(s, d: str) -> DataFrame:
    for name in ("orders", "conversations"):
        table(s, d, name).createOrReplaceTempView(f"orbitframe_{name}")
    asked = s.sql(_ASKED.replace("FROM orders", "FROM orbitframe_orders").replace("FROM conversations", "FROM orbitframe_conversations"))
    return Q.tag_tasks(asked, "id", c("q"), c("n"), c("pair")).withColumn("parts", F.array_join("parts", ","))


_sql = lambda x: "'" + x.replace("'", "''") + "'"
_re = lambda words: _sql("|".join(x.replace("+", "\\+") for x in words))
_FACTS = ", ".join(f"coalesce(regexp_matches(q, {_re(words)}), false) AS f_{n}" for n, words in Q.PHRASES.items())
_TARGET = "CASE " + " ".join(f"WHEN regexp_matches(q, {_sql(chr(92) + 'b(' + '|'.join(words) + ')' + chr(92) + 'b')}) THEN '{t}'" for t, words in Q.TARGETS) + " END"


def _holds(name: str) -> str:
    return {"any": "true", "targeted": "target IS NOT NULL"}.get(name) or (f"coalesce(target = '{name[7:]}', false)" if name.startswith("target:") else f"f_{name}")


def _rule(trigger, needs, bars) -> str:
    return " AND ".join([*(_holds(x) for x in (trigger, *needs)), *(f"NOT {_holds(x)}" for x in bars)])


_FOUND = "CASE " + " ".join(f"WHEN {_rule(t, n, b)} THEN {k}" for k, (t, n, b, *_) in enumerate(Q.RULES)) + " END"
_of = lambda i: "CASE rule " + " ".join(f"WHEN {k} THEN {_sql(r[i]) if r[i] else 'NULL'}" for k, r in enumerate(Q.RULES)) + " END"
_PARTS = "list_filter([" + ", ".join(f"CASE WHEN {_rule(n[0], n[1:], b)} THEN '{p}' END" for p, n, b in Q.PARTS) + "], lambda x: x IS NOT NULL)"
register(
    "x03_tag_task", _tasks,
    f"""WITH a AS (SELECT id, trim(lower(coalesce(q, ''))) AS q, n, pair FROM ({_ASKED})), b AS (SELECT *, {_FACTS}, {_TARGET} AS target FROM a),
    u AS (SELECT *, regexp_matches(q, {_sql("|".join(Q.UNSUPPORTED))}) AS f_unsupported, length(q) < 3 OR q IN ({", ".join(map(_sql, Q.UNCLEAR))}) AS f_unclear,
        f_fusion OR (pair = 'optical_sar' AND (n >= 2 OR NOT f_change)) AS f_cross, n >= 2 OR f_change OR pair = 'bi_temporal' AS f_temporal FROM b),
    r AS (SELECT *, {_FOUND} AS rule, {_PARTS} AS parts FROM u), t AS (SELECT id, {_of(3)} AS application, {_of(4)} AS task, {_of(5)} AS specific_task, coalesce({_of(6)}, CASE WHEN rule > 1 THEN target END) AS target, parts FROM r)
    SELECT id, application, task, specific_task, target, CASE WHEN application <> 'single_image' THEN '' WHEN len(parts) > 1 THEN array_to_string(parts, ',') WHEN task = 'grounding' THEN 'water_analysis' ELSE specific_task END AS parts,
        application = 'single_image' AND len(parts) > 1 AS is_multi FROM t""",
)

# X19: scenes are orders, their bands line items -------------------------------------------------------------------------
_BAND = _pick(("VV", "vh", "B04", "Red", "b10", "band_1", "", "thermal", "B8A nir", "rgb", "x", "grey"), "(l_partkey + l_orderkey) % 12")
_SCENE = {
    "file": _pick(("scene.tif", "S1_grd.tif", "photo_RGB.png", "a.jpg", "landsat8.tif", "plain.nc"), "o_orderkey % 6"), "tags": _pick(("", "Sensor=PALSAR radar", "mission=Sentinel-2", "note=none"), "o_custkey % 4"),
    "dtype": "CASE WHEN o_orderkey % 5 < 2 THEN 'float32' ELSE 'uint8' END", "n_bands": "CAST(o_custkey % 6 AS INT)", "least": "CASE WHEN o_orderkey % 7 < 2 THEN -25.5 WHEN o_orderkey % 7 = 2 THEN -900.0 ELSE 0.0 END",
    "most": "CAST(o_orderkey % 11 AS DOUBLE)", "speckle": "o_orderkey % 10 / 20.0", "saturation": "o_custkey % 7 / 50.0", "gap": "CAST(o_orderkey % 9 AS DOUBLE)",
}


def _modality(s, d: str) -> DataFrame:
    scenes = table(s, d, "orders").selectExpr("o_orderkey", *(f"{x} AS {n}" for n, x in _SCENE.items()))
    # some orders have no bands; a band number repeats where a line number does
    bands = table(s, d, "lineitem").selectExpr("l_orderkey AS o_orderkey", "l_linenumber AS i", f"{_BAND} AS name").where("o_orderkey % 3 = 0")
    return Q.modality_from_metadata(scenes, bands, "o_orderkey")


_first = lambda text, words: "CASE " + " ".join(f"WHEN contains({text}, '{w}') THEN '{w}'" for w in words) + " END"
register(
    "x19_modality_from_metadata", _modality,
    f"""WITH s AS (SELECT o_orderkey AS k, {", ".join(f"{x} AS {n}" for n, x in _SCENE.items())} FROM orders), bn AS (SELECT l_orderkey AS k, l_linenumber AS nth, lower(trim({_BAND})) AS w FROM lineitem WHERE l_orderkey % 3 = 0),
    bk AS (SELECT k, nth, w, CASE WHEN w IN ({", ".join(map(_sql, Q.POLARISATIONS))}) THEN 'polarisation' WHEN {_first("w", Q.SENTINEL_BANDS)} IS NOT NULL THEN 'sentinel band' WHEN {_first("w", Q.LANDSAT_BANDS)} IS NOT NULL THEN 'landsat band' WHEN w = 'rgb' THEN 'optical band' END AS kind FROM bn WHERE w <> ''),
    t AS (SELECT *, {_first("lower(tags)", Q.RADAR_TAGS)} AS rt, {_first("lower(tags)", Q.OPTICAL_TAGS)} AS ot, {_first("lower(file)", Q.RADAR_FILES)} AS rf, {_first("lower(file)", Q.OPTICAL_FILES)} AS xf, regexp_matches(lower(file), '(png|jpg)$') AS pic FROM s),
    g AS (SELECT *, dtype = 'float32' AND NOT pic AND least < -5 AS neg, dtype = 'float32' AND NOT pic AND least < -5 AND least > -60 AND most < 10 AS db FROM t),
    h AS (SELECT k, nth, kind, w, CASE WHEN kind = 'polarisation' THEN 3 ELSE 0 END AS sar, CASE kind WHEN 'polarisation' THEN 0 WHEN 'sentinel band' THEN 2 ELSE 1 END AS opt FROM bk WHERE kind IS NOT NULL
        UNION ALL SELECT k, 1001, 'radar tag', rt, 2, 0 FROM g WHERE rt IS NOT NULL UNION ALL SELECT k, 1002, 'optical tag', ot, 0, 2 FROM g WHERE ot IS NOT NULL
        UNION ALL SELECT k, 1003, CASE WHEN db THEN 'decibels' ELSE 'negative values' END, 'range', CASE WHEN db THEN 3 ELSE 1 END, 0 FROM g WHERE neg),
    m AS (SELECT k, sum(sar) AS sar, sum(opt) AS opt FROM h GROUP BY k), w AS (SELECT g.*, coalesce(sar, 0) AS sar0, coalesce(opt, 0) AS opt0 FROM g LEFT JOIN m USING (k)),
    x AS (SELECT *, NOT pic AND n_bands >= 4 AND opt0 = 0 AS many, rf IS NOT NULL AND sar0 = 0 AS named, xf IS NOT NULL AND opt0 = 0 AND NOT (NOT pic AND n_bands >= 4) AS shown FROM w),
    a AS (SELECT k, nth, kind, w FROM h UNION ALL SELECT k, 1004, 'several bands', CAST(n_bands AS VARCHAR) FROM x WHERE many UNION ALL SELECT k, 1005, 'radar file', rf FROM x WHERE named UNION ALL SELECT k, 1006, 'optical file', xf FROM x WHERE shown),
    e AS (SELECT k, string_agg(kind || ':' || w, '; ' ORDER BY nth, kind || ':' || w) AS evidence FROM a GROUP BY k),
    p AS (SELECT k, string_agg(upper(w), '/' ORDER BY nth, w) AS pols FROM (SELECT k, w, min(nth) AS nth FROM h WHERE kind = 'polarisation' GROUP BY k, w) GROUP BY k),
    y AS (SELECT x.*, sar0 + named::INT AS sar, opt0 + many::INT + shown::INT AS opt, evidence, pols, sar0 = 0 AND (n_bands IN (1, 2) OR (n_bands >= 3 AND (gap < 4 OR saturation < 0.04))) AS grey, sar0 = 0 AND n_bands >= 3 AND NOT (gap < 4 OR saturation < 0.04) AS colour FROM x LEFT JOIN e USING (k) LEFT JOIN p USING (k)),
    z AS (SELECT *, CASE WHEN sar >= 3 THEN 0 WHEN opt >= 2 THEN 1 WHEN (sar >= 1 AND opt = 0) OR grey THEN 2 WHEN colour THEN 3 WHEN opt = 1 OR n_bands >= 3 THEN 4 WHEN sar0 = 0 AND speckle > 0.2 THEN 2 ELSE 5 END AS b FROM y)
    SELECT k AS o_orderkey, ['sar', 'optical', 'sar_like', 'optical', 'optical', 'unknown'][b + 1] AS modality, [CASE WHEN sar >= 5 THEN 'high' ELSE 'medium' END, 'high', 'low', 'medium', 'low', 'low'][b + 1] AS level, sar >= 3 OR opt >= 2 AS is_verified,
        db AND (sar >= 3 OR opt >= 2) AS is_calibrated, [coalesce('SAR (' || pols || ')', CASE ot WHEN 'sentinel-2' THEN 'Sentinel 2' END, 'SAR (sensor family unverified)'), coalesce(CASE ot WHEN 'sentinel-2' THEN 'Sentinel 2' END, 'Optical multispectral (sensor verified)'),
        'Visual SAR-like image', 'RGB optical image', 'RGB optical image', 'Unknown'][b + 1] AS family, CAST(sar AS BIGINT) AS sar, CAST(opt AS BIGINT) AS optical, coalesce(evidence, '') AS evidence FROM z""",
)

# V17: runs are orders, their evidence line items ------------------------------------------------------------------------
_KINDS = tuple(dict.fromkeys(x.split(":")[0] for x in Q.FAMILIES)) + ("sar_structural_evidence",)
_METRIC = {
    "total_coverage_percent": "CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END", "largest_coverage_percent": "l_quantity + 0.5", "total_area_m2": "CASE WHEN l_suppkey % 3 > 0 THEN l_extendedprice * 50 END", "area_m2": "l_extendedprice * 2",
    "region_count": "CAST(l_linenumber % 3 AS DOUBLE)", "changed_percent": "l_discount * 450", "dominant_percent": "l_quantity + l_tax", "vegetation_percent": "l_tax * 100", "built_up_percent": "CASE WHEN l_linenumber > 2 THEN l_discount * 100 END", "water_percent": "0.0",
    "building_count": "CAST(l_suppkey % 40 AS DOUBLE)", "coverage_percent": "l_quantity", "confirmed_percent": "l_quantity / 2", "identified": "CASE WHEN l_partkey % 4 = 0 THEN 0.0 END",
}
_EVIDENCE = f"""SELECT l_orderkey AS o_orderkey, {_pick(_KINDS, f"l_suppkey % {len(_KINDS)}")} AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'bare_land' END AS word, {", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in _METRIC.items())}"""
_RUNS = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'insufficient_evidence' ELSE 'supported' END AS status, (o_custkey % 13) / 12.0 AS confidence, o_orderkey % 3 > 0 AS scaled"


def _cards(s, d: str) -> DataFrame:
    table(s, d, "orders").createOrReplaceTempView("orbitframe_orders")
    # dealt by run once, as it is read: what follows groups by run
    table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax").repartition("l_orderkey").createOrReplaceTempView("orbitframe_lineitem")
    e = s.sql(f"{_EVIDENCE} FROM orbitframe_lineitem")
    # one piece of evidence of a run and kind, as pieces are told apart by their metrics
    e = e.groupBy("o_orderkey", "kind").agg(F.max("word").alias("word"), *[F.max(n).alias(n) for n in _METRIC])
    metrics = F.map_filter(F.create_map(*[x for n in _METRIC for x in (F.lit(n), c(n))]), lambda k, v: v.isNotNull())
    return Q.summary_cards(s.sql(f"{_RUNS} FROM orbitframe_orders"), e.select("o_orderkey", "kind", metrics.alias("metrics"), "word"), "o_orderkey")


_usual = lambda *names, lack: "coalesce(" + ", ".join(f"nullif({n}, 0)" for n in names) + f", {lack})"


def _value_sql(label: str, form: str, metric: str | None, other: str | None, lack: float | None) -> str:
    whole = lambda x: f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) || '%'"
    fine = lambda x: f"printf('%.2f', {x}) || '%'"
    if form == "text":
        return _sql(metric)
    if form == "confidence":
        return whole("100 * confidence")
    if form.startswith("area"):
        size = f"CASE WHEN {metric} >= 1e6 THEN format('{{:,.2f}} km²', {metric} / 1e6) WHEN {metric} >= 1e4 THEN format('{{:,.2f}} ha', {metric} / 1e4) ELSE format('{{:,.0f}} m²', {metric}) END"
        return f"CASE WHEN scaled AND {metric} > 0 THEN {size} ELSE {whole(_usual(other, lack=lack))} || ' of {form.split()[1]}' END"
    found = _usual(*(x for x in (metric, other) if x), lack=lack)
    if form == "count":
        return f"CAST(CAST({found} AS BIGINT) AS VARCHAR)"
    if form == "class":
        return f"CASE WHEN word IS NULL THEN 'Land' ELSE 'Bare Land' END || ' (' || {fine(found)} || ')'"
    return fine(found) if form == "fine" else whole(found)


register(
    "v17_summary_cards", _cards,
    f"""WITH e0 AS ({_EVIDENCE} FROM lineitem), e AS (SELECT o_orderkey, kind, max(word) AS word, {", ".join(f"max({n}) AS {n}" for n in _METRIC)} FROM e0 GROUP BY o_orderkey, kind), r AS ({_RUNS} FROM orders),
    f AS (SELECT *, {"CASE kind " + " ".join(f"WHEN '{x.split(':')[0]}' THEN {i}" for i, x in enumerate(Q.FAMILIES)) + " END"} AS rank, {"CASE kind " + " ".join(f"WHEN '{x.split(':')[0]}' THEN '{x.split(':')[1]}'" for x in Q.FAMILIES) + " END"} AS own FROM e),
    one AS (SELECT * FROM f WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY rank) = 1),
    j AS (SELECT r.*, one.* EXCLUDE (o_orderkey, kind), CASE WHEN status = 'insufficient_evidence' OR confidence < 0.40 THEN 'insufficient' WHEN own = 'water' AND coalesce(identified, 1) = 0 THEN 'no_water' ELSE coalesce(own, 'generic') END AS family FROM r LEFT JOIN one USING (o_orderkey))
    """ + " UNION ALL ".join(f"SELECT o_orderkey, family, {i} AS place, {_sql(x[1])} AS label, {_value_sql(*x[1:])} AS value FROM j WHERE family = '{x[0]}'" for i, x in enumerate(Q.CARDS)),
)
