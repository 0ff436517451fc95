"""Single objects out of masks: touching ones split by a flood from seeds, overlapping detections merged."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import written as _written
from .focal import Grid
from .grids import distance_to_background
from .regions import label_components, min_label


@dataclass(frozen=True)
class SplitRule:
    """How touching objects are told apart.

    The foreground is what lies above ``threshold``. Seeds are plateaus of the peak surface that no cell within ``reach``
    exceeds, at least ``floor`` high and, with a ``prominence``, at least so far above the way to any higher cell. Of
    components over ``large`` cells they are sought with ``large_reach`` and ``large_floor``, ``markers`` at most.
    The boundary's probability lowers the surfaces: the peaks by ``weight`` times it, or times its part above
    ``boundary_threshold`` where ``above``. Objects keep at least ``least`` cells.
    """

    threshold: float
    least: int
    reach: int
    floor: float = 0.0
    prominence: float | None = None
    large: int | None = None
    large_reach: int = 0
    large_floor: float = 0.0
    markers: int | None = None
    boundary_threshold: float = 0.6
    weight: float = 0.0
    above: bool = False


#: Fixed values of the three sets of parameters: by distance alone, by distance and boundary, and by relief in blended mosaics.
PLAIN = SplitRule(threshold=0.4371, least=16, reach=6, floor=2.0, large=1500, large_reach=10, large_floor=3.0, markers=50)
BOUNDARY = SplitRule(threshold=0.6, least=48, reach=8, prominence=6.0, weight=0.4)
RELIEF = SplitRule(threshold=0.6, least=48, reach=8, prominence=6.0, weight=0.65, above=True)


def _neighbours(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(n, 4) places of the cells above, left, right and below in arrays sorted by row and column; -1 where there is none."""
    wide = int(c.max()) + 3 if len(c) else 1
    key = r * wide + c
    out = np.full((len(key), 4), -1)
    for k, step in enumerate((-wide, -1, 1, wide)):
        at = np.minimum(np.searchsorted(key, key + step), len(key) - 1)
        found = key[at] == key + step
        out[found, k] = at[found]
    return out


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches along the edges (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def plateau_seeds(r: np.ndarray, c: np.ndarray, value: np.ndarray, highest: np.ndarray) -> np.ndarray:
    """Places of one cell per highest plateau, sorted by row and column; value is NaN outside the surface.

    Cells that reach ``highest``, the maximum of their window, count where their whole plateau of equal value has no
    higher neighbour. Each connected set of them gives the cell nearest its centre, the first in row order of equals.
    """
    near = _neighbours(r, c)
    v = np.where(np.isnan(value), -np.inf, value)
    other = np.where(near >= 0, v[near], -np.inf)
    i, k = np.nonzero((near >= 0) & (other == v[:, None]) & (v > -np.inf)[:, None])
    plateau = _joined(len(v), i, near[i, k])
    beaten = np.zeros(len(v), bool)
    np.logical_or.at(beaten, plateau, (other > v[:, None]).any(axis=1))
    top = (v == highest) & (v > -np.inf) & ~beaten[plateau]
    i, k = np.nonzero(top[:, None] & (near >= 0) & top[near])
    group = _joined(len(v), i, near[i, k])[top]
    at = np.flatnonzero(top)
    if not len(at):
        return at
    _, group, size = np.unique(group, return_inverse=True, return_counts=True)
    far = sum((x[at] - (np.bincount(group, x[at]) / size)[group]) ** 2 for x in (r, c))
    order = np.lexsort((at, far, group))
    return np.sort(at[order[np.r_[True, np.diff(group[order]) > 0]]])


def prominent(r: np.ndarray, c: np.ndarray, value: np.ndarray, h: float) -> np.ndarray:
    """Whether each cell is the maximum of the connected cells higher than itself less h. Outside, the surface is 0.

    One pass from the top: cells join as the bar falls, and a set knows its maximum. A cell not over h, whose way to all
    others leads over the outside, is never prominent.
    """
    near, order = _neighbours(r, c).tolist(), np.argsort(-value, kind="stable")
    v, parent, best, added = value.tolist(), list(range(len(value))), value.tolist(), 0
    joined, out = [False] * len(v), np.zeros(len(v), bool)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = order.tolist()
    for i in order:
        if v[i] < h:
            break
        while added < len(order) and v[order[added]] > v[i] - h:
            x = order[added]
            joined[x] = True
            for y in near[x]:
                if y >= 0 and joined[y]:
                    a, b = root(x), root(y)
                    if a != b:
                        parent[a] = b
                        best[b] = max(best[a], best[b])
            added += 1
        out[i] = best[root(i)] == v[i]
    return out


def flood(r: np.ndarray, c: np.ndarray, level: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each cell the seed (its place in ``seeds``) whose water reaches it first; -1 where none does.

    Water rises: of the cells at the shore, the lowest is filled first, and of equal ones that which was reached first.
    """
    near, level = _neighbours(r, c).tolist(), level.tolist()
    owner, shore, age = [-1] * len(level), [], 0
    for k, at in enumerate(seeds.tolist()):
        owner[at] = k
        shore.append((level[at], age, at))
        age += 1
    heapq.heapify(shore)
    while shore:
        _, _, at = heapq.heappop(shore)
        for other in near[at]:
            if other >= 0 and owner[other] < 0:
                owner[other] = owner[at]
                heapq.heappush(shore, (level[other], age, other))
                age += 1
    return np.array(owner)


def _by_cell(table: pa.Table) -> pa.Table:
    return table.sort_by([("r", "ascending"), ("c", "ascending")])


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def window_max(df: DataFrame, values: dict[str, tuple[Column, int]], by: list[str]) -> DataFrame:
    """df with, per name, the maximum of a column over the cells within a reach, in two passes that all share."""
    grid = Grid(scene=tuple(by))
    for axis in ("x", "y"):
        df = df.withColumns({n: F.max(x if axis == "x" else F.col(n)).over(grid.frame(axis, reach)) for n, (x, reach) in values.items()})
    return df


def spaced(points: DataFrame, by: list[str], rounds: int = 1000) -> DataFrame:
    """points (by, r, c, value, first, reach) without those less than their reach, on both axes, from a better one that stays.

    Better is the higher value, then the smaller ``first``. Points of different reach do not disturb each other. In each
    round those that beat all open neighbours stay and what they beat goes, which is the result of taking them in order.
    """
    bin_ = lambda x: F.floor(F.col(x) / F.col("reach"))
    name = F.struct(*by, "r", "c", "reach")
    own = points.select(*by, "reach", name.alias("id"), "r", "c", F.struct((-F.col("value")).alias("v"), "first").alias("rank"), bin_("r").alias("y"), bin_("c").alias("x"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    sent = own.withColumn("s", F.explode(steps)).select(*by, "reach", F.col("id").alias("win"), F.col("r").alias("wr"), F.col("c").alias("wc"), F.col("rank").alias("better"), (F.col("y") + F.col("s.a")).alias("y"), (F.col("x") + F.col("s.b")).alias("x"))
    # a cell of reach by reach holds no more points than that, so the join is bounded
    near = sent.join(own, [*by, "reach", "y", "x"]).where((F.col("better") < F.col("rank")) & (F.abs(F.col("wr") - F.col("r")) < F.col("reach")) & (F.abs(F.col("wc") - F.col("c")) < F.col("reach")))
    edges, gone = _written(near.select("win", F.col("id").alias("lose"))), None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        safe = edges.join(edges.select(F.col("lose").alias("win")).distinct(), "win", "left_anti")
        out = _written(safe.select("lose").distinct())
        gone = out if gone is None else gone.unionByName(out)
        edges = _written(edges.join(out, "lose", "left_anti").join(out.withColumnRenamed("lose", "win"), "win", "left_anti"))
    else:
        raise RuntimeError("spacing did not settle")
    return points if gone is None else points.withColumn("__id", name).join(gone.withColumnRenamed("lose", "__id"), "__id", "left_anti").drop("__id")


def split_touching(px: DataFrame, by: list[str], probability: Column, width: int, rule: SplitRule = PLAIN, boundary: Column | None = None, valid: Column | None = None, tile: int = 256) -> DataFrame:
    """(by, r, c, component, instance) of the cells of single objects; both are named by the smallest r * width + c.

    Cells over the rule's threshold form components (by side). Distances to the background, windows and the spacing of
    seeds run over the whole table; a component without a seed is seeded at its highest cell. Then each component is
    flooded from its seeds, downhill from the far cells to the rim, and objects under the least size are dropped.

    Null probabilities, boundaries and invalid cells are background. A component is worked on in one task, so its size,
    at most that of a scene, bounds the memory; scenes and components run in parallel. Where a scene has no background,
    all distances are 0. An empty table gives an empty result.
    """
    limit = (lambda p: p >= rule.threshold) if rule.above else (lambda p: p > rule.threshold)
    ok = F.coalesce(limit(probability), F.lit(False)) & (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False)))
    edge = F.lit(0.0) if boundary is None else F.coalesce(boundary, F.lit(0.0))
    cells = _written(px.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), ok.alias("fg"), edge.cast("double").alias("edge")))
    keys, kept = [*by, "r", "c"], "".join(f"`{k}` {px.schema[k].dataType.simpleString()}, " for k in by)
    labels = _written(label_components(cells.where("fg"), width, tile=tile, by=tuple(by)))
    sizes = labels.groupBy(*by, "label").agg(F.count("*").alias("size")).where(F.col("size") >= rule.least)
    if rule.above:  # here small components are background before distances are taken
        cells = cells.drop("fg").join(labels.join(sizes, [*by, "label"]).select(*keys, F.lit(True).alias("fg")), keys, "left").withColumn("fg", F.coalesce("fg", F.lit(False)))
    distance = distance_to_background(cells, by, F.col("fg")).withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    df = labels.join(sizes, [*by, "label"]).join(distance, keys).join(cells.select(*keys, "edge"), keys)
    part = F.greatest((F.col("edge") - rule.boundary_threshold) / (1 - rule.boundary_threshold), F.lit(0.0)) if rule.above else F.col("edge")
    lowered = F.col("distance") * (1 - rule.weight * part)
    level = lowered if rule.above else F.when(F.col("edge") >= rule.boundary_threshold, lowered).otherwise(F.col("distance"))
    df = _written(df.withColumns({"peak": lowered, "level": -level}))

    if rule.prominence is not None:
        top = F.broadcast(df.groupBy(*by).agg(F.max("peak").alias("top"))) if by else None  # a row per scene

        def rise(table):
            table = _by_cell(table)
            r, c = (table.column(n).to_numpy() for n in ("r", "c"))
            flags = prominent(r - r.min(), c - c.min(), _floats(table, "peak"), rule.prominence)
            return table.append_column("prominent", pa.array(flags))

        risen = df.groupBy(*by, "label").applyInArrow(rise, kept + "label long, r long, c long, size long, distance double, edge double, peak double, level double, prominent boolean")
        if top is not None:  # the scene's highest cell has no higher one to be compared with
            risen = risen.join(top, by).withColumn("prominent", F.col("prominent") | (F.col("peak") == F.col("top"))).drop("top")
        df = _written(risen)
        surfaces = {"small": (F.when(F.col("prominent"), F.col("peak")), rule.reach)}
    elif rule.large:
        big = F.col("size") > rule.large
        surfaces = {
            "small": (F.when(~big & (F.col("peak") >= rule.floor), F.col("peak")), rule.reach),
            "big": (F.when(big & (F.col("peak") >= rule.large_floor), F.col("peak")), rule.large_reach),
        }
    else:
        surfaces = {"small": (F.when(F.col("peak") >= rule.floor, F.col("peak")), rule.reach)}
    near = window_max(df.withColumns({f"{n}_v": x for n, (x, _) in surfaces.items()}), {n: (F.col(f"{n}_v"), k) for n, (_, k) in surfaces.items()}, by)
    reaches = {n: k for n, (_, k) in surfaces.items()}

    def peaks(table):
        table = _by_cell(table)
        r, c, ids = (table.column(n).to_numpy() for n in ("r", "c", "label"))
        out = []
        for name, reach in reaches.items():
            at = plateau_seeds(r - r.min(), c - c.min(), _floats(table, f"{name}_v"), _floats(table, name))
            out.append(table.take(pa.array(at)).select([*by, "label", "r", "c", "peak"]).append_column("reach", pa.array(np.full(len(at), reach))).append_column("first", pa.array(r[at] * width + c[at])))
        return pa.concat_tables(out).rename_columns([*by, "label", "r", "c", "value", "reach", "first"])

    points = _written(near.groupBy(*by, "label").applyInArrow(peaks, kept + "label long, r long, c long, value double, reach long, first long"))
    seeds = spaced(points, by).select(*keys, F.lit(1).alias("seed"))

    def split(table):
        table = _by_cell(table)
        r, c = (table.column(n).to_numpy() for n in ("r", "c"))
        far, high = _floats(table, "distance"), _floats(table, "peak")
        at = np.flatnonzero(_floats(table, "seed") > 0)
        if rule.large and rule.markers and len(r) > rule.large and len(at) > rule.markers:
            at = np.sort(at[np.argsort(-far[at], kind="stable")[: rule.markers]])
        if not len(at):
            at = np.array([np.argmax(high if rule.above else far)])
        owner = flood(r - r.min(), c - c.min(), _floats(table, "level"), at)
        size = np.bincount(owner, minlength=len(at))
        ids = r * width + c
        name = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(name, owner, ids)
        good = size[owner] >= rule.least
        out = table.select([*by, "r", "c", "label"]).append_column("instance", pa.array(name[owner]))
        return out.filter(pa.array(good)).rename_columns([*by, "r", "c", "component", "instance"])

    return df.join(seeds, keys, "left").groupBy(*by, "label").applyInArrow(split, kept + "r long, c long, component long, instance long")


def merge_instances(cells: DataFrame, by: list[str], least: int = 16, iou: float = 0.5, inside: float = 0.8, unclaimed: float = 0.5, island: float = 0.02) -> DataFrame:
    """(by, r, c, id, score): the cells that each surviving detection claims, of cells (by, id, r, c, score, cut, valid).

    Detections are taken in order: those not cut by a tile's edge first, by score, ties to the smaller id. One goes if an
    accepted one meets it with an IoU of ``iou`` or holds ``inside`` of the smaller of both; if fewer than ``least`` of its
    valid cells, or under ``unclaimed`` of them, are unclaimed; else it claims these, without islands of fewer than
    ``least`` cells or a share ``island`` of its largest. An accepted detection is what it claimed.

    Detections act on each other only through cells they share, so those linked by cells form clusters, and each
    cluster is swept by itself in one task: a chain of overlapping detections in one scene bounds its memory. As claims
    never overlap, what a detection shares with all accepted ones is one count over the owners of its cells.

    Repeated cells of a detection count once; invalid cells are never claimed, but count in its size. Null validity is
    invalid; a null score comes last. Detections without cells do not exist. An empty table gives an empty result.
    """
    df = cells.groupBy(*by, "id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).agg(F.max("score").cast("double").alias("score"), F.bool_or(F.coalesce("cut", F.lit(False))).alias("cut"), F.bool_or(F.coalesce("valid", F.lit(False))).alias("valid"))
    df = _written(df)
    # links as stars: each cell ties its detections to its smallest one
    least_id = df.groupBy(*by, "r", "c").agg(F.min("id").alias("v"))
    node = lambda x: F.struct(*by, F.col(x).alias("id"))
    links = df.join(least_id, [*by, "r", "c"]).where("id <> v").select(node("id").alias("u"), node("v").alias("v")).distinct()
    groups = min_label(links).select("node.*", F.col("label.id").alias("cluster"))
    df = df.join(groups, [*by, "id"], "left").withColumn("cluster", F.coalesce("cluster", "id"))

    def sweep(table):
        table = table.sort_by([("id", "ascending"), ("r", "ascending"), ("c", "ascending")])
        ids = table.column("id").to_numpy()
        r, c = (table.column(n).to_numpy() for n in ("r", "c"))
        score, cut, valid = (table.column(n).to_numpy(zero_copy_only=False) for n in ("score", "cut", "valid"))
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ends = np.r_[starts[1:], len(ids)]
        _, spot = np.unique((r - r.min()) * (int(c.max() - c.min()) + 1) + c - c.min(), return_inverse=True)
        owner, claimed, taken = np.full(spot.max() + 1, -1), [], np.zeros(len(ids), bool)
        ranks = np.where(np.isnan(score[starts].astype(float)), np.inf, -score[starts].astype(float))
        for k in np.lexsort((ids[starts], ranks, cut[starts])):
            own = np.arange(starts[k], ends[k])
            held = owner[spot[own]]
            if (held >= 0).any():
                shared = np.bincount(held[held >= 0], minlength=len(claimed))
                other = np.array(claimed)
                if (shared >= iou * (len(own) + other - shared)).any() or (shared >= inside * np.minimum(len(own), other)).any():
                    continue
            usable = own[valid[own].astype(bool)]
            free = usable[owner[spot[usable]] < 0]
            if len(free) < least or len(free) < unclaimed * len(usable):
                continue
            near = _neighbours(r[free] - r[free].min() + 1, c[free] - c[free].min() + 1)
            i, j = np.nonzero(near >= 0)
            _, part, size = np.unique(_joined(len(free), i, near[i, j]), return_inverse=True, return_counts=True)
            free = free[size[part] >= max(least, np.ceil(size.max() * island))]
            if not len(free):
                continue
            owner[spot[free]] = len(claimed)
            claimed.append(len(free))
            taken[free] = True
        return table.select([*by, "r", "c", "id", "score"]).filter(pa.array(taken))

    kept = "".join(f"`{k}` {cells.schema[k].dataType.simpleString()}, " for k in by)
    return df.groupBy(*by, "cluster").applyInArrow(sweep, f"{kept}r long, c long, id {df.schema['id'].dataType.simpleString()}, score double")
