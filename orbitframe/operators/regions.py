"""Connected regions of masks: labels, statistics, filters and ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import written as _written
from .aggregates import exact_percentiles


def min_label(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable, for the nodes of edges (u, v).

    Large-star and small-star joins in turn (Kiveris et al., 2014) settle in O(log^2 n) rounds, however long the chains,
    and never gather a node's neighbours in one row. Nodes may be numbers, strings or structs.
    """
    down = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    stars = _written(down(edges.where("u IS NOT NULL AND v IS NOT NULL").select("u", "v")))
    was = mark(stars)
    for _ in range(rounds):
        if not was[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = down(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        stars = _written(down(small))
        was, before = mark(stars), was
        if was == before:
            break
    else:
        raise RuntimeError("labels did not settle")
    ends = stars.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    return ends.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with its place from 1 in the order of all rows: sorted ranges, each numbered from the sum of those before it."""
    ranged = _written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row per partition
    starts = ranged.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(starts, "__part").withColumn(out, F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def _tile_labels(by: list[str], diagonal: bool):
    def run(table):
        """Labels inside one tile: runs of cells in a row are joined where runs of the next row touch them."""
        ids, r, c = (table.column(n).to_numpy() for n in ("id", "r", "c"))
        order = np.lexsort((c, r))
        r, c = r[order] - r.min(), c[order] - c.min()
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1] + 1)])
        last = np.r_[first[1:], len(r)] - 1
        wide, reach = int(c.max()) + 3, int(diagonal)
        starts, ends = r[first] * wide + c[first], r[last] * wide + c[last]
        lo = np.searchsorted(ends, starts + wide - reach)
        hi = np.searchsorted(starts, ends + wide + reach, side="right")
        many = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(first)), many)
        b = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        b, a = b[r[first][b] == r[first][a] + 1], a[r[first][b] == r[first][a] + 1]
        label = np.arange(len(first))
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        run_of = np.repeat(label, last - first + 1)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, run_of, ids[order])
        part = np.empty(len(ids), np.int64)
        part[order] = least[run_of]
        return table.select([*by, "id", "r", "c"]).append_column("part", pa.array(part))

    return run


def label_components(mask: DataFrame, width: int, diagonal: bool = False, tile: int = 256, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, r, c, label) of the true cells (by, r, c): label is the smallest r * width + c of the component in its scene.

    Tiles label themselves in one pass; only the labels that meet across tile seams run in the distributed rounds, so
    their number follows the seams and not the pixels. ``by`` names the scenes of a table; they never touch.
    """
    by = list(by)
    px = mask.select(*by, F.col("r").cast("long"), F.col("c").cast("long")).withColumn("id", F.col("r") * width + F.col("c"))
    tiled = px.withColumn("ty", F.floor(F.col("r") / tile)).withColumn("tx", F.floor(F.col("c") / tile))
    kept = "".join(f"`{k}` {mask.schema[k].dataType.simpleString()}, " for k in by)
    local = _written(tiled.groupBy(*by, "ty", "tx").applyInArrow(_tile_labels(by, diagonal), f"{kept}id long, r long, c long, part long"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    rim = local.where((F.pmod("r", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("c", F.lit(tile)).isin(0, tile - 1)))
    sent = rim.select(*by, F.col("part").alias("u"), F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in steps])).alias("to")).select(*by, "u", "to.r", "to.c")
    seams = sent.join(rim.select(*by, "r", "c", F.col("part").alias("v")), [*by, "r", "c"]).where("u <> v")
    node = (lambda x: F.struct(*by, F.col(x).alias("part"))) if by else F.col
    joined = min_label(seams.select(node("u").alias("u"), node("v").alias("v")))
    joined = joined.select("node.*", F.col("label.part").alias("label")) if by else joined.withColumnRenamed("node", "part")
    return local.join(joined, [*by, "part"], "left").select(*by, "r", "c", F.coalesce("label", "part").alias("label"))


def filter_small(labels: DataFrame, least: int, by: tuple[str, ...] = ()) -> DataFrame:
    key = [*by, "label"]
    return labels.join(labels.groupBy(*key).count().where(F.col("count") >= least).select(*key), key, "left_semi")


def reconstruct(labels: DataFrame, seeds: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All cells of components that hold a seed (by, r, c)."""
    cell, key = [*by, "r", "c"], [*by, "label"]
    return labels.join(labels.join(seeds.select(*cell), cell, "left_semi").select(*key).distinct(), key, "left_semi")


def region_medians(cells: DataFrame, key: list[str], value: Column, out: str = "median", bins: int = 64) -> DataFrame:
    """(key, out): the exact median of each region's values, of all regions at once; regions without a value are left out.

    Most regions are small: those of at most ``bins`` values are sorted in an array, a bounded one. For the others,
    histograms narrow down the middle ranks (``exact_percentiles``) and combine before each shuffle, so that no task ever
    holds the values of a large region.
    """
    src = _written(cells.select(*key, value.cast("double").alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x")))
    sizes = src.groupBy(*key).agg(F.count("*").alias("__n"))
    large = _written(sizes.where(F.col("__n") > bins).select(*key))
    lists = src.join(large, key, "left_anti").groupBy(*key).agg(F.sort_array(F.collect_list("__x")).alias("v"))
    n = F.size("v")
    middle = (F.element_at("v", (F.floor((n - 1) / 2) + 1).cast("int")) + F.element_at("v", (F.floor(n / 2) + 1).cast("int"))) / 2
    small = lists.select(*key, middle.alias(out))
    if large.isEmpty():
        return small
    return small.unionByName(exact_percentiles(src.join(large, key, "left_semi"), key, F.col("__x"), {out: 0.5}, cells=bins * bins).select(*key, out))


def region_stats(labels: DataFrame, value: Column, height: int, width: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per label: pixels, box, centroid, solidity, aspect, statistics of the value, border contact.

    The median comes from histograms that narrow, of all regions at once, so no task buffers a region's values.
    """
    key, df = [*by, "label"], labels.withColumn("__x", value)
    out = df.groupBy(*key).agg(
        F.count("*").alias("pixels"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"),
        F.avg("r").alias("centre_r"), F.avg("c").alias("centre_c"), F.avg("__x").alias("mean"), F.stddev_pop("__x").alias("std"),
        F.bool_or((F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == height - 1) | (F.col("c") == width - 1)).alias("border"),
    )
    out = out.join(region_medians(df, key, F.col("__x")), key, "left")
    h, w = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    return out.withColumn("solidity", F.col("pixels") / (h * w)).withColumn("aspect", F.greatest(h, w) / F.least(h, w))


def region_score(stats: DataFrame) -> DataFrame:
    return stats.withColumn("score", (F.col("mean") + 1) * F.sqrt("pixels") * (F.col("solidity") ** 0.5 / F.col("aspect") ** 0.25))


def region_filter(stats: DataFrame, aspect: float = 8.0, solidity: float = 0.25) -> DataFrame:
    return stats.where(~((F.col("aspect") > aspect) & (F.col("solidity") < solidity)))


def keep_relative_to_primary(stats: DataFrame, by: list[str], share: float = 0.02, mean: float = 0.1, strong: float = 0.4, solid: float = 0.25) -> DataFrame:
    """The best region of each group, and others of more than a share of its size that are also strong enough."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), "label")
    df = stats.withColumn("__n", F.row_number().over(w)).withColumn("__p", F.first("pixels").over(w))
    ok = ((F.col("pixels") > share * F.col("__p")) & (F.col("mean") > mean)) | ((F.col("mean") > strong) & (F.col("solidity") >= solid))
    return df.where((F.col("__n") == 1) | ok).drop("__n", "__p")


def largest_region(labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The cells of the largest region of each scene, ties to the smaller label."""
    sizes = labels.groupBy(*by, "label").count()
    top = sizes.groupBy(*by).agg(F.max(F.struct("count", (-F.col("label")).alias("l"))).alias("t")).select(*by, (-F.col("t.l")).alias("label"))
    return labels.join(top, [*by, "label"], "left_semi")


def compact_ids(labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Numbers 1..n in the order of the labels, in each scene. The numbering runs over the regions, not the pixels."""
    key = [*by, "label"]
    names = numbered(labels.select(*key).distinct(), key, "id")
    if by:
        names = names.join(names.groupBy(*by).agg((F.min("id") - 1).alias("__less")), list(by)).withColumn("id", F.col("id") - F.col("__less")).drop("__less")
    return labels.join(names, key)


def instance_scores(labels: DataFrame, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return labels.groupBy(*by, "label").agg(F.avg(value).alias("score"))


def exclude_by_overlap(labels: DataFrame, mask: DataFrame, most: float = 0.5, least_rest: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Drops labels covered by the mask (by, r, c) to at least a share, or whose rest is too small; trims the others."""
    cell, key = [*by, "r", "c"], [*by, "label"]
    df = labels.join(mask.select(*cell).withColumn("__m", F.lit(1)), cell, "left")
    share = df.groupBy(*key).agg(F.count("__m").alias("__in"), F.count("*").alias("__all")).where((F.col("__in") < most * F.col("__all")) & (F.col("__all") - F.col("__in") >= least_rest))
    return df.where("__m IS NULL").join(share.select(*key), key, "left_semi").drop("__m")


def confirm_by_witness(labels: DataFrame, support: DataFrame, least: int = 25, share: float = 0.6, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, label, pixels, supported, confirmed): a component needs pixels and the support (by, r, c) of a second grid."""
    cell = [*by, "r", "c"]
    df = labels.join(support.select(*cell).withColumn("__m", F.lit(1)), cell, "left")
    out = df.groupBy(*by, "label").agg(F.count("*").alias("pixels"), F.count("__m").alias("supported"))
    return out.withColumn("confirmed", (F.col("pixels") >= least) & (F.col("supported") >= share * F.col("pixels")))


def representative_point(labels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each label the pixel nearest its centroid, ties to the smaller row and column."""
    key = [*by, "label"]
    centre = labels.groupBy(*key).agg(F.avg("r").alias("__y"), F.avg("c").alias("__x"))
    d = (F.col("r") - F.col("__y")) ** 2 + (F.col("c") - F.col("__x")) ** 2
    return labels.join(centre, key).groupBy(*key).agg(F.min(F.struct(F.round(d, 9), "r", "c")).alias("p")).select(*key, F.col("p.r").alias("r"), F.col("p.c").alias("c"))


def multi_part_union(parts: DataFrame, key: str, part: str, area: str) -> DataFrame:
    """(key, parts, area): one feature per id even where its parts are disjoint; an id's parts are few."""
    return parts.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("parts"), F.sum(area).alias(area))
