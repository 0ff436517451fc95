"""Queries of split and merged objects, with what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import focal as N
from ..operators import instances as I
from ..sources import scenes as S
from .registry import PX, register, table

c = F.col
#: The derived scene is noise, so its objects, where the mean of 5 x 5 cells is high, are small: a rule on a small scale.
SMALL = I.SplitRule(threshold=0.5, least=4, reach=3, floor=1.2, large=300, large_reach=5, large_floor=1.5, markers=50)


def _objects(s, d: str) -> DataFrame:
    px = N.box_mean(S.derived_scene(s, d).select("r", "c", "red"), "red", 5, "mean").withColumn("scene", F.lit(1))
    return I.split_touching(px, ["scene"], c("mean"), 64, SMALL, tile=16).drop("scene")


register("g15_split_touching", _objects, None)


def _partition(s, d: str) -> DataFrame:
    """Of each component: whether its cells lie in one object each, of the least size at least and named by their first cell."""
    out = _objects(s, d)
    sizes = out.groupBy("component", "instance").agg(F.count("*").alias("n"), F.countDistinct("r", "c").alias("cells"), F.min(c("r") * 64 + c("c")).alias("first"))
    return sizes.groupBy("component").agg(F.bool_and(c("n") == c("cells")).alias("is_single"), F.bool_and(c("n") >= SMALL.least).alias("is_large"), F.bool_and(c("first") == c("instance")).alias("is_named"))


_PARTS = f"""WITH RECURSIVE {PX}, m AS MATERIALIZED (SELECT a.r, a.c, a.r * 64 + a.c AS id FROM s a JOIN s o ON o.r BETWEEN a.r - 2 AND a.r + 2 AND o.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY a.r, a.c HAVING avg(o.red) > {SMALL.threshold}),
    e AS (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
    k AS (SELECT id AS u, id AS label FROM m UNION SELECT e.v, k.label FROM k JOIN e ON e.u = k.u),
    l AS (SELECT u, CAST(min(label) AS BIGINT) AS component FROM k GROUP BY u)"""
register(
    "g15_split_partition", lambda s, d: _partition(s, d),
    f"{_PARTS} SELECT component, true AS is_single, true AS is_large, true AS is_named FROM l GROUP BY component HAVING count(*) >= {SMALL.least}",
)


def detections(s, d: str) -> DataFrame:
    """(scene, id, r, c, score, cut, valid): each vector a detection, an ellipse whose place and size follow from its numbers."""
    e = table(s, d, "embeddings").where("vec_id IS NOT NULL")
    of = lambda i, n: F.floor((c("embedding")[i] + 1) / 2 * n).cast("int")
    box = e.select(
        F.floor(c("vec_id") / 40).cast("int").alias("scene"), c("vec_id").alias("id"), F.round(c("embedding")[0], 3).alias("score"), (c("vec_id") % 7 == 0).alias("cut"),
        of(1, 60).alias("y"), of(2, 60).alias("x"), (4 + of(3, 7)).alias("h"), (4 + of(4, 7)).alias("w"),
    )
    cells = box.withColumn("dy", F.explode(F.sequence(-c("h"), c("h")))).withColumn("dx", F.explode(F.sequence(-c("w"), c("w"))))
    inside = c("dy") * c("dy") * c("w") * c("w") + c("dx") * c("dx") * c("h") * c("h") <= c("h") * c("h") * c("w") * c("w")
    cells = cells.where(inside).select("scene", "id", (c("y") + c("dy")).alias("r"), (c("x") + c("dx")).alias("c"), "score", "cut")
    return cells.withColumn("valid", (c("r") * 7 + c("c") * 3) % 31 != 0)


register("g20_merge_instances", lambda s, d: I.merge_instances(detections(s, d), ["scene"]), None)
