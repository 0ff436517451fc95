"""Tiling, overlap joins, retrieval and suppression of overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written as _written
from .regions import min_label, numbered


def tile_starts(length: Column, size: int, step: int) -> Column:
    """0, step, ... and a last flush tile; one tile if the length is short."""
    last = F.greatest(length - size, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last.cast("int"), F.lit(step)), F.array(last.cast("int"))))


def tile_index(scenes: DataFrame, width: str, height: str, size: int, step: int) -> DataFrame:
    """All windows of each scene: x0, y0, w, h."""
    xs = scenes.withColumn("x0", F.explode(tile_starts(F.col(width), size, step)))
    out = xs.withColumn("y0", F.explode(tile_starts(F.col(height), size, step)))
    return out.withColumn("w", F.least(F.lit(size), F.col(width) - F.col("x0"))).withColumn("h", F.least(F.lit(size), F.col(height) - F.col("y0")))


def iou(a: str, b: str) -> Column:
    """Of two boxes given as columns <name>_x, _y, _w, _h."""
    c = lambda n, k: F.col(f"{n}_{k}")
    w = F.greatest(F.lit(0), F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x")))
    h = F.greatest(F.lit(0), F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y")))
    both = w * h
    return F.coalesce(F.try_divide(both.cast("double"), (c(a, "w") * c(a, "h") + c(b, "w") * c(b, "h") - both).cast("double")), F.lit(0.0))


def bbox_overlap_join(boxes: DataFrame, cell: int, gap: int = 0) -> DataFrame:
    """(a_id, b_id, iou), a_id < b_id, of windows (id, x, y, w, h) that overlap or lie within the gap.

    Windows are sent to the grid cells they touch and joined by cell; a pair is kept in the cell of its upper left common
    corner only, so no distinct is needed. Cells should be about as large as the windows.
    """
    x0, y0 = F.col("x") - gap, F.col("y") - gap
    span = lambda lo, n: F.sequence(F.floor(lo / cell), F.floor((lo + n + 2 * gap) / cell))
    sent = boxes.withColumn("gx", F.explode(span(x0, F.col("w")))).withColumn("gy", F.explode(span(y0, F.col("h"))))
    side = lambda n: sent.select("gx", "gy", *[F.col(c).alias(f"{n}_{c}") for c in ("id", "x", "y", "w", "h")])
    near = (F.col("a_x") <= F.col("b_x") + F.col("b_w") + gap) & (F.col("b_x") <= F.col("a_x") + F.col("a_w") + gap)
    near &= (F.col("a_y") <= F.col("b_y") + F.col("b_h") + gap) & (F.col("b_y") <= F.col("a_y") + F.col("a_h") + gap)
    home = (F.col("gx") == F.floor((F.greatest("a_x", "b_x") - gap) / cell)) & (F.col("gy") == F.floor((F.greatest("a_y", "b_y") - gap) / cell))
    return side("a").join(side("b"), ["gx", "gy"]).where("a_id < b_id").where(near & home).select("a_id", "b_id", iou("a", "b").alias("iou"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_topk(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k vectors most similar to the one query row; the query is a single row, so its broadcast is bounded."""
    q = query.select(F.col(vec).alias("__q")).limit(1)
    return vectors.crossJoin(F.broadcast(q)).select(key, cosine(F.col(vec), F.col("__q")).alias("score")).orderBy(F.desc(F.round("score", 9)), key).limit(k)


def relevance_cut(df: DataFrame, score: str, threshold: float = 0.35, most: float = 0.68, share: float = 0.75) -> DataFrame:
    """Rows of at least max(threshold, min(most, share * peak)); the peak is one row."""
    peak = df.agg(F.max(score).alias("__p"))
    cut = F.greatest(F.lit(threshold), F.least(F.lit(most), share * F.col("__p")))
    return df.crossJoin(F.broadcast(peak)).where(F.col(score) >= cut).drop("__p")


def non_max_suppression(boxes: DataFrame, cell: int, threshold: float = 0.45, rounds: int = 1000) -> DataFrame:
    """Boxes (id, x, y, w, h, score) that greedy suppression keeps: by score, ties to the smaller id.

    In each round the boxes that beat all their open neighbours stay and their neighbours go, all at once; the result is the
    greedy one. The overlap graph is joined once; rounds run over its edges only.
    """
    edges = bbox_overlap_join(boxes, cell).where(F.col("iou") > threshold)
    score = boxes.select("id", "score")
    edges = edges.join(score.withColumnRenamed("id", "a_id").withColumnRenamed("score", "sa"), "a_id").join(score.withColumnRenamed("id", "b_id").withColumnRenamed("score", "sb"), "b_id")
    a_wins = F.col("sa") >= F.col("sb")
    edges = _written(edges.select(F.when(a_wins, F.col("a_id")).otherwise(F.col("b_id")).alias("win"), F.when(a_wins, F.col("b_id")).otherwise(F.col("a_id")).alias("lose")))
    gone = None
    for _ in range(rounds):
        # winners without a stronger open neighbour are safe; what they beat goes
        safe = edges.join(edges.select(F.col("lose").alias("win")).distinct(), "win", "left_anti")
        out = _written(safe.select(F.col("lose").alias("id")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        if not out.limit(1).count():
            return boxes.join(gone, "id", "left_anti")
        safe_ids = safe.select(F.col("win")).distinct()
        edges = _written(edges.join(out.withColumnRenamed("id", "win"), "win", "left_anti").join(out.withColumnRenamed("id", "lose"), "lose", "left_anti").join(safe_ids, "win", "left_anti"))
    raise RuntimeError("suppression did not settle")


def merge_adjacent(boxes: DataFrame, cell: int, gap: int = 48) -> DataFrame:
    """(region, id): windows within the gap of each other share a region, named by its smallest id."""
    labels = min_label(bbox_overlap_join(boxes, cell, gap).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    return boxes.join(labels, boxes["id"] == labels["node"], "left").select(F.coalesce("label", "id").alias("region"), "id")


def region_summary(members: DataFrame, boxes: DataFrame) -> DataFrame:
    """(region, tiles, x, y, w, h, mean, peak, rank) of merged windows, the highest peak first, ties to the smaller region."""
    out = members.join(boxes, "id").groupBy("region").agg(
        F.count("*").alias("tiles"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.avg("score").alias("mean"), F.max("score").alias("peak"),
    )
    return numbered(out.withColumn("__first", -F.round("peak", 9)), ["__first", "region"], "rank").drop("__first")


def rank_tiles(df: DataFrame, kept: Column, score: str, key: str) -> DataFrame:
    ordered = df.withColumn("__first", (~kept).cast("int")).withColumn("__second", -F.col(score))
    return numbered(ordered, ["__first", "__second", key], "rank").drop("__first", "__second")


def window_polygon(x: Column, y: Column, w: Column, h: Column, affine: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> Column:
    """The rectangle of a pixel window as five world coordinates, closed; x' = a x + b y + c and y' = d x + e y + f."""
    a, b, c, d, e, f = affine
    at = lambda px, py: F.array(a * px + b * py + c, d * px + e * py + f)
    return F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h), at(x, y))


def blend_tiles(cells: DataFrame, by: list[str], p: str, weight: str) -> DataFrame:
    """Overlapping tiles' predictions as one value a cell: their mean by weight."""
    return cells.groupBy(*by).agg((F.sum(F.col(p) * F.col(weight)) / F.sum(weight)).alias(p))
