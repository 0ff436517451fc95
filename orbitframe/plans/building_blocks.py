"""Queries of functions that other operators are made of, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import catalog as C
from ..operators import evaluation as E
from ..operators import focal as N
from ..operators import grids as K
from ..operators import questions as Q
from ..operators import regions as G
from ..operators import tiles as T
from ..sources import features as V
from ..sources import scenes as S
from ..sources.storage import shared
from .grids import _BAND, _bands
from .registry import _BOX, PX, _STATS, register, stats, table
from .rulings import _ASKED, _re, _sql

c = F.col

register(
    "s01_read_pixels", lambda s, d: S.read_pixels(s, f"{d}/lineitem.parquet", ["l_quantity", "l_tax"], ["l_orderkey", "l_linenumber"], 0.02, -0.1, c("l_returnflag") != "N"),
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_quantity * 0.02 - 0.1 END AS l_quantity, CASE WHEN l_returnflag <> 'N' THEN l_tax * 0.02 - 0.1 END AS l_tax FROM lineitem", "l_quantity l_tax",
)
register(
    "s12_patch_report", lambda s, d: C.patch_report(table(s, d, "orders").where("o_orderkey % 3 > 0"), table(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey"),
    "SELECT DISTINCT l_orderkey AS o_orderkey, l_orderkey % 3 > 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) AS found FROM lineitem",
)


def _indices(s, d: str) -> DataFrame:
    roles = K.band_roles_by_alias(_bands(s, d), ["l_orderkey"], "idx", "name")
    return roles.groupBy("l_orderkey").agg(F.collect_set("role").alias("roles")).select("l_orderkey", F.array_join(X.available_indices(c("roles")), ",").alias("indices"))


register(
    "p03_available_indices", _indices,
    f"""WITH q AS (SELECT l_orderkey, CASE l_partkey % 9 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'nir' WHEN 3 THEN 'swir' WHEN 4 THEN 'vv' WHEN 6 THEN 'nir' END AS role, {_BAND} AS name FROM lineitem),
    g AS (SELECT l_orderkey, list(DISTINCT role) AS r FROM q WHERE role IS NOT NULL GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_filter([CASE WHEN list_has_all(r, ['nir', 'red']) THEN 'NDVI' END, CASE WHEN list_has_all(r, ['green', 'nir']) THEN 'NDWI' END, CASE WHEN list_has_all(r, ['swir', 'nir']) THEN 'NDBI' END], lambda x: x IS NOT NULL), ',') AS indices FROM g""",
)
register(
    "g09_keep_relative_to_primary", lambda s, d: G.keep_relative_to_primary(G.region_score(stats(s, d)).withColumn("scene", F.lit(1)), ["scene"], 0.3, 0.57, 0.6, 0.8).select("label", "pixels"),
    f"""{_STATS}, v AS (SELECT *, (mean + 1) * sqrt(pixels) * (sqrt(solidity) / aspect ** 0.25) AS score FROM u), w AS (SELECT *, row_number() OVER (ORDER BY score DESC, label) AS n, first(pixels) OVER (ORDER BY score DESC, label) AS p FROM v)
    SELECT label, pixels FROM w WHERE n = 1 OR (pixels > 0.3 * p AND mean > 0.57) OR (mean > 0.6 AND solidity >= 0.8)""",
)
register(
    "l09_chronological_pair", lambda s, d: E.chronological_pair(table(s, d, "orders").withColumn("day", F.to_date("o_orderdate")), "o_custkey", "o_orderkey", "day"),
    """WITH q AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), g AS (SELECT o_custkey, min({'d': day, 'k': o_orderkey}) AS a, max({'d': day, 'k': o_orderkey}) AS z FROM q GROUP BY 1 HAVING count(*) > 1)
    SELECT o_custkey, a.k AS before, z.k AS after, CAST(date_diff('day', a.d, z.d) AS INT) AS days FROM g""",
)
register(
    "w02_rank_tiles", lambda s, d: T.rank_tiles(table(s, d, "embeddings").select("vec_id", F.round(c("embedding")[0].cast("double"), 2).alias("score"), (c("label") % 3 == 0).alias("kept")), c("kept"), "score", "vec_id").select("vec_id", F.col("rank").cast("long").alias("rank")),
    "SELECT vec_id, row_number() OVER (ORDER BY label % 3 <> 0, round(CAST(embedding[1] AS DOUBLE), 2) DESC, vec_id) AS rank FROM embeddings",
)
register(
    "w07_focal_frames", lambda s, d: N.box(S.derived_scene(s, d).select("r", "c", "red", "nir"), {"a": c("red"), "b": c("nir") * c("red")}, 3).select("r", "c", "a", "b"),
    f"WITH {PX} " + _BOX.format(agg="sum(o.red) AS a, sum(o.nir * o.red) AS b", t="s", h=1), "a b",
)
register(
    "w08_nearest_values", lambda s, d: N.gradient(N.gradient(S.derived_scene(s, d).select("r", "c", "nir"), "nir", "y", "gy"), "nir", "x", "gx").select("r", "c", "gx", "gy"),
    f"""WITH {PX}, q AS (SELECT r, c, nir, lag(nir) OVER x AS w, lead(nir) OVER x AS e, lag(nir) OVER y AS n, lead(nir) OVER y AS z FROM s WINDOW x AS (PARTITION BY r ORDER BY c), y AS (PARTITION BY c ORDER BY r))
    SELECT r, c, CASE WHEN w IS NULL THEN e - nir WHEN e IS NULL THEN nir - w ELSE (e - w) / 2 END AS gx, CASE WHEN n IS NULL THEN z - nir WHEN z IS NULL THEN nir - n ELSE (z - n) / 2 END AS gy FROM q""", "gx gy",
)


def _polygons(s, d: str) -> DataFrame:
    ring = T.window_polygon(c("vec_id") % 20 * 400, F.floor(c("vec_id") / 20) * 400, F.lit(448), F.lit(448), (0.5, 0.0, 1000.0, 0.0, -0.5, 9000.0))
    corners = F.transform(ring, lambda p: F.concat_ws(" ", F.transform(p, lambda x: F.round(x * 10).cast("long").cast("string"))))
    return table(s, d, "embeddings").select("vec_id", F.array_join(corners, ",").alias("ring"))


_CORNER = lambda x, y: f"CAST(10 * (1000 + 0.5 * ({x})) AS BIGINT) || ' ' || CAST(10 * (9000 - 0.5 * ({y})) AS BIGINT)"
_X, _Y = "vec_id % 20 * 400", "vec_id // 20 * 400"
register("r15_window_polygons", _polygons, "SELECT vec_id, " + " || ',' || ".join(_CORNER(x, y) for x, y in ((_X, _Y), (f"{_X} + 448", _Y), (f"{_X} + 448", f"{_Y} + 448"), (_X, f"{_Y} + 448"), (_X, _Y))) + " AS ring FROM embeddings")


def _tests(s, d: str) -> DataFrame:
    for name in ("orders", "conversations"):
        table(s, d, name).createOrReplaceTempView(f"orbitframe_{name}")
    asked = s.sql(_ASKED.replace("FROM orders", "FROM orbitframe_orders").replace("FROM conversations", "FROM orbitframe_conversations"))
    return Q.with_task_facts(asked, c("q"), c("n"), c("pair")).select("id", *[F.array_contains("__facts", F.lit(n)).alias(f"is_{n}") for n in ("change", "fusion", "unsupported", "unclear")])


register(
    "x04_question_tests", _tests,
    f"""WITH a AS (SELECT id, trim(lower(coalesce(q, ''))) AS q FROM ({_ASKED})) SELECT id, regexp_matches(q, {_re(Q.PHRASES["change"])}) AS is_change, regexp_matches(q, {_re(Q.PHRASES["fusion"])}) AS is_fusion,
        regexp_matches(q, {_sql("|".join(Q.UNSUPPORTED))}) AS is_unsupported, length(q) < 3 OR q IN ({", ".join(map(_sql, Q.UNCLEAR))}) AS is_unclear FROM a""",
)


# S: files written from the tables and read back; a file holds a block of ids, so blocks and not files grow in number -------
def _features(s, d: str) -> DataFrame:
    x, y = c("l_quantity").cast("double"), c("l_linenumber").cast("double")
    rows = table(s, d, "lineitem").select(F.floor(c("l_orderkey") / 4096).alias("block"), "l_orderkey", "l_linenumber", "l_returnflag", V.rectangle(x, y, x + 10, y + 1).alias("ring"))
    rows = rows.withColumn("kind", F.when(c("l_returnflag") != "N", c("l_returnflag"))).withColumn("ring", F.when(c("l_linenumber") < 7, c("ring")))
    path = shared(s, "collections")
    V.feature_collections(rows, ["block"], ["l_orderkey", "l_linenumber", "kind"], "ring").write.partitionBy("block").option("compression", "gzip").text(path)
    read = V.read_features(s, path, "*.txt.gz")
    x0, y0, x1, y1 = V.geometry_bounds(c("geometry.coordinates"))
    named = lambda n: F.element_at("properties", n).cast("long").alias(n)
    kind = F.when(c("kind") == F.regexp_replace("file", r"\.[^.]*$", ""), "file").otherwise(c("kind"))
    return read.select(named("l_orderkey"), named("l_linenumber"), kind.alias("kind"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


register(
    "s03_read_features", _features,
    "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE 'file' END AS kind, l_quantity AS x0, l_linenumber AS y0, l_quantity + 10 AS x1, l_linenumber + 1 AS y1 FROM lineitem WHERE l_linenumber < 7", "x0 y0 x1 y1",
)


def _manifests(s, d: str) -> DataFrame:
    """A manifest per order, its line items as entries; orders without any have an empty list."""
    entries = table(s, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), F.struct(c("l_linenumber").alias("nth"), c("l_returnflag").alias("name"), c("l_tax").cast("double").alias("cloud")).alias("e")).groupBy("o_orderkey").agg(F.collect_list("e").alias("tiles"))
    path = shared(s, "manifests")
    table(s, d, "orders").select(c("o_orderkey"), c("o_orderstatus").alias("state")).join(entries, "o_orderkey", "left").withColumn("tiles", F.coalesce("tiles", F.array())).write.json(path)
    return V.read_manifests(s, path, "o_orderkey long, state string, tiles array<struct<nth: long, name: string, cloud: double>>", "tiles", lines=True)


register(
    "s05_read_manifests", _manifests,
    "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus AS state, CAST(l_linenumber AS BIGINT) AS nth, l_returnflag AS name, l_tax AS cloud FROM orders JOIN lineitem ON l_orderkey = o_orderkey", "cloud",
)


def _texts(s, d: str) -> DataFrame:
    """A text per block of parts: sizes as keys and values, brands as rows, and a remark; every tenth line has room around it."""
    part = table(s, d, "part").withColumn("block", F.floor(c("p_partkey") / 500))
    key, room = c("p_partkey").cast("string"), F.when(c("p_partkey") % 10 == 0, "  ").otherwise("")
    line = lambda *x: F.concat(room, *x, room)
    rows = part.select("block", "p_partkey", F.explode(F.array(
        F.struct(F.lit("META").alias("section"), line(F.lit("part "), key, F.lit(": "), c("p_size").cast("string"), F.lit(": cm")).alias("line")),
        F.struct(F.lit("PATCHES").alias("section"), line(key, F.lit(" | "), c("p_brand"), F.lit("|x: "), c("p_type")).alias("line")),
        F.struct(F.lit("REMARKS").alias("section"), line(F.lit("# "), c("p_name")).alias("line")),
    )).alias("e")).select("block", "p_partkey", "e.*")
    path = shared(s, "texts")
    V.sectioned_text(rows, ["block"], "section", "line", ["p_partkey"]).write.partitionBy("block").text(path)
    read = V.read_sectioned_text(s, f"{path}/block=*")
    return read.select("section", "key", "value", F.array_join("parts", ";").alias("parts"))


register(
    "s06_read_sectioned_text", _texts,
    """SELECT 'META' AS section, 'part ' || p_partkey AS key, p_size || ': cm' AS value, NULL AS parts FROM part
    UNION ALL SELECT 'PATCHES', NULL, NULL, p_partkey || ';' || p_brand || ';x: ' || p_type FROM part""",
)


def _grid(s, d: str) -> DataFrame:
    path = shared(s, "grid")
    px = S.derived_pixels(s, d)
    V.write_grid(px.repartition("b"), path, ["b"])
    return V.read_grid(s, path, "r int, c int, v double, b int").select("r", "c", "b", "v")


register("s09_write_grid", _grid, f"WITH {PX} SELECT r, c, b, v FROM px", "v")


# W, L: groups that hold a quarter of all rows and more, in sorted ranges --------------------------------------------------
def _lines(s, d: str) -> DataFrame:
    """Quantities by return flag, order and line; one flag is NULL, and every third line has no quantity."""
    flag = F.when(c("l_returnflag") != "A", c("l_returnflag")).alias("flag")
    whole = table(s, d, "lineitem").groupBy(flag, "l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return whole.select("flag", "l_orderkey", "l_linenumber", F.when((c("l_orderkey") + c("l_linenumber")) % 3 > 0, c("q")).alias("x"))


_LINES = """l AS (SELECT flag, l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 3 > 0 THEN q END AS x
    FROM (SELECT CASE WHEN l_returnflag <> 'A' THEN l_returnflag END AS flag, l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))"""
_ORDER = lambda: [F.desc("l_orderkey"), c("l_linenumber")]
register(
    "w05_running_total", lambda s, d: A.cumulative(_lines(s, d), ["flag"], _ORDER(), "x", "upto"),
    f"WITH {_LINES} SELECT *, sum(x) OVER (PARTITION BY flag ORDER BY l_orderkey DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS upto FROM l", "x upto",
)
register(
    "w06_last_value", lambda s, d: A.forward_fill(_lines(s, d), ["flag"], _ORDER(), "x", "last"),
    f"WITH {_LINES} SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY flag ORDER BY l_orderkey DESC, l_linenumber ROWS UNBOUNDED PRECEDING) AS last FROM l", "x last",
)
register(
    "l06_even_sample_of_lines", lambda s, d: A.even_sample(_lines(s, d), ["flag"], _ORDER(), 1000).select("flag", "l_orderkey", "l_linenumber"),
    f"""WITH {_LINES}, q AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY l_orderkey DESC, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY flag) AS n FROM l)
    SELECT flag, l_orderkey, l_linenumber FROM q WHERE n <= 1000 OR i IN (SELECT j * (k.n - 1) // 999 FROM (SELECT DISTINCT n FROM q) k, range(1000) t(j) WHERE k.n = q.n)""",
)
