"""From labelled cells to polygons and back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sides of a cell, clockwise from the top with y downwards: neighbour (dr, dc), start and end corner (dx, dy).
SIDES = (((-1, 0), (0, 0), (1, 0)), ((0, 1), (1, 0), (1, 1)), ((1, 0), (1, 1), (0, 1)), ((0, -1), (0, 1), (0, 0)))


def outline(labels: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, way, x, y): each cell side that borders another region, from its start corner, the region on its right."""
    sides = F.array(*[F.struct(F.lit(i).alias("way"), (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"), (F.col("c") + x).alias("x"), (F.col("r") + y).alias("y")) for i, ((dr, dc), (x, y), _) in enumerate(SIDES)])
    sent = labels.select(*by, "label", F.explode(sides).alias("s")).select(*by, "label", "s.*")
    return sent.join(labels.select(*by, "label", "r", "c"), [*by, "label", "r", "c"], "left_anti").select(*by, "label", "way", "x", "y")


def _walk(edges: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of corners from sides (way, x, y). Where two cells touch by a corner only, a ring turns right and stays
    with its cell."""
    out: dict[tuple[int, int], set[int]] = {}
    for way, x, y in edges:
        out.setdefault((x, y), set()).add(way)
    rings = []
    for start in sorted(out):
        while out[start]:
            way, at, ring = min(out[start]), start, []
            first = way
            while True:
                out[at].discard(way)
                if not ring or ring[-1][1] != way:
                    ring.append((at, way))
                at = (at[0] + (1, 0, -1, 0)[way], at[1] + (0, 1, 0, -1)[way])
                if at == start and first not in out[at] and not {(way + 1) % 4} & out[at]:
                    break
                way = next(w for w in ((way + 1) % 4, way, (way + 3) % 4) if w in out[at])
            if ring[0][1] == ring[-1][1] and len(ring) > 1:  # the start lies within a side
                ring = [(ring[-1][0], ring[0][1]), *ring[1:-1]]
            rings.append([p for p, _ in ring])
    return rings


def signed_area(ring: list[tuple[int, int]]) -> float:
    """Positive for shells, negative for holes."""
    return sum(x * v - u * y for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def polygonize(labels: DataFrame, by: list[str] | None = None, least: int = 4) -> DataFrame:
    """(by, label, rings): rectilinear rings of 4-connected regions (by, r, c, label) of at least ``least`` cells.

    A ring is an array of corners (x, y) without points on straight lines; the shell comes first, holes follow, which run
    the other way. The sides are found in joins; only a region's sides meet in one task, as they must in its row.
    """
    by = list(by or [])
    kept = labels.join(labels.groupBy(*by, "label").count().where(F.col("count") >= least).select(*by, "label"), [*by, "label"], "left_semi")
    sides = outline(kept, by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = _walk(list(pdf[["way", "x", "y"]].itertuples(index=False, name=None)))
        rings.sort(key=lambda r: (-signed_area(r), r[0]))
        own = {k: [pdf[k].iloc[0]] for k in [*by, "label"]}
        return pd.DataFrame(own | {"rings": [[[{"x": int(x), "y": int(y)} for x, y in r] for r in rings]]})

    kinds = "".join(f"`{k}` {labels.schema[k].dataType.simpleString()}, " for k in [*by, "label"])
    return sides.groupBy(*by, "label").applyInPandas(run, f"{kinds}rings array<array<struct<x:bigint,y:bigint>>>")


def rasterize(polygons: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, r, c): cells whose centre lies inside by the even-odd rule, from the rings' upright sides."""
    by = list(by or [])
    ring = polygons.select(*by, "label", F.explode("rings").alias("ring"))
    points = ring.select(*by, "label", F.explode(F.arrays_zip(F.col("ring").alias("a"), F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1)).alias("b"))).alias("e"))
    upright = points.where("e.a.x = e.b.x").select(*by, "label", F.col("e.a.x").alias("x"), F.explode(F.sequence(F.least("e.a.y", "e.b.y"), F.greatest("e.a.y", "e.b.y") - 1)).alias("r"))
    row = W.partitionBy(*by, "label", "r").orderBy("x")
    spans = upright.withColumn("to", F.lead("x").over(row)).withColumn("nth", F.row_number().over(row)).where("nth % 2 = 1")
    return spans.select(*by, "label", "r", F.explode(F.sequence(F.col("x"), F.col("to") - 1)).alias("c"))


def geometry_matches_mask(polygons: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, missing, extra) of the regions whose polygons cover other cells than the mask, shifted ones included."""
    by = list(by or [])
    keys = [*by, "label", "r", "c"]
    both = labels.select(*keys, F.lit(1).alias("m")).join(rasterize(polygons, by).withColumn("p", F.lit(1)), keys, "full")
    off = both.groupBy(*by, "label").agg(F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("m").isNull()).alias("extra"))
    return off.where("missing + extra > 0")
