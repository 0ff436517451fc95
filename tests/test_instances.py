"""Objects split by floods and merged by claims, against plain loops; regions of several scenes; linear distances."""

import heapq
import time

import numpy as np
import pytest
from orbitframe.operators import focal, grids, instances, pairs, regions
from orbitframe.plans import registry
from pyspark.sql import functions as F

SIDES = ((-1, 0), (0, -1), (0, 1), (1, 0))


def plain_labels(mask):
    label, out = 0, np.zeros(mask.shape, int)
    for i, j in zip(*np.nonzero(mask), strict=True):
        if out[i, j]:
            continue
        label += 1
        out[i, j], todo = label, [(i, j)]
        while todo:
            a, b = todo.pop()
            for y, x in SIDES:
                y, x = a + y, b + x
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = label
                    todo.append((y, x))
    return out, label


def plain_distance(mask):
    back = np.argwhere(~mask)
    out = np.zeros(mask.shape)
    for i, j in zip(*np.nonzero(mask), strict=True):
        out[i, j] = np.sqrt(((back - (i, j)) ** 2).sum(axis=1).min()) if len(back) else 0
    return out


def plain_flood(level, mask, seeds):
    owner, shore, age = np.zeros(level.shape, int), [], 0
    for k, (i, j) in enumerate(seeds, 1):
        owner[i, j] = k
        heapq.heappush(shore, (level[i, j], age, i, j))
        age += 1
    while shore:
        _, _, i, j = heapq.heappop(shore)
        for y, x in SIDES:
            y, x = i + y, j + x
            if 0 <= y < level.shape[0] and 0 <= x < level.shape[1] and mask[y, x] and not owner[y, x]:
                owner[y, x] = owner[i, j]
                heapq.heappush(shore, (level[y, x], age, y, x))
                age += 1
    return owner


def plain_peaks(surface, reach):
    """Seeds of one surface (-inf outside), the whole scene at once."""
    h, w = surface.shape
    top = np.zeros(surface.shape, bool)
    for i, j in zip(*np.nonzero(surface > -np.inf), strict=True):
        top[i, j] = surface[i, j] == surface[max(0, i - reach) : i + reach + 1, max(0, j - reach) : j + reach + 1].max()
    for value in np.unique(surface[surface > -np.inf]):
        zones, n = plain_labels(surface == value)
        for k in range(1, n + 1):
            higher = any(0 <= i + y < h and 0 <= j + x < w and surface[i + y, j + x] > value for i, j in np.argwhere(zones == k) for y, x in SIDES)
            if higher:
                top[zones == k] = False
    zones, n = plain_labels(top)
    found = []
    for k in range(1, n + 1):
        points = np.argwhere(zones == k)
        far = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
        found.append((-surface[tuple(points[0])], k, *points[np.argmin(far)]))
    kept = []
    for _, _, i, j in sorted(found):
        if all(max(abs(i - a), abs(j - b)) >= reach for a, b in kept):
            kept.append((i, j))
    return kept


def plain_split(p, rule, edge=None):
    fg = p >= rule.threshold if rule.above else p > rule.threshold
    zones, n = plain_labels(fg)
    size = np.bincount(zones.ravel(), minlength=n + 1)
    if rule.above:
        fg = fg & (size[zones] >= rule.least)
    far = plain_distance(fg)
    edge = np.zeros(p.shape) if edge is None else edge
    part = np.maximum(edge - rule.boundary_threshold, 0) / (1 - rule.boundary_threshold) if rule.above else edge
    peak = far * (1 - rule.weight * part)
    level = -peak if rule.above else -np.where(edge >= rule.boundary_threshold, peak, far)
    fg = fg & (size[zones] >= rule.least)
    if rule.prominence is not None:
        high = np.zeros(p.shape, bool)
        for i, j in zip(*np.nonzero(fg), strict=True):
            v = peak[i, j]
            around, _ = plain_labels(np.where(fg, peak, 0) > v - rule.prominence)
            high[i, j] = np.where(fg, peak, 0)[around == around[i, j]].max() <= v
        seeds = plain_peaks(np.where(high, peak, -np.inf), rule.reach)
    elif rule.large:
        big = size[zones] > rule.large
        seeds = plain_peaks(np.where(fg & ~big & (peak >= rule.floor), peak, -np.inf), rule.reach)
        more = plain_peaks(np.where(fg & big & (peak >= rule.large_floor), peak, -np.inf), rule.large_reach)
        seeds += more
    else:
        seeds = plain_peaks(np.where(fg & (peak >= rule.floor), peak, -np.inf), rule.reach)
    out = np.full(p.shape, -1)
    for k in range(1, n + 1):
        own = (zones == k) & fg
        if not own.any():
            continue
        mine = sorted((i, j) for i, j in seeds if own[i, j])
        if rule.large and rule.markers and size[k] > rule.large and len(mine) > rule.markers:
            mine = sorted(sorted(mine, key=lambda x: -far[x])[: rule.markers])
        if not mine:
            mine = [np.unravel_index(np.argmax(np.where(own, peak if rule.above else far, -np.inf)), p.shape)]
        got = plain_flood(level, own, mine)
        for s in range(1, len(mine) + 1):
            cells = np.argwhere(got == s)
            if len(cells) >= rule.least:
                out[got == s] = (cells[:, 0] * p.shape[1] + cells[:, 1]).min()
    return out


def blobs(seed, shape=(40, 60), n=14):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: shape[0], : shape[1]]
    p = np.zeros(shape)
    for _ in range(n):
        cy, cx, ry, rx = rng.integers(0, shape[0]), rng.integers(0, shape[1]), rng.integers(3, 9), rng.integers(3, 9)
        p[(y - cy) ** 2 / ry**2 + (x - cx) ** 2 / rx**2 <= 1] = 0.9
    p[rng.random(shape) < 0.01] = 0.1
    return p


def as_table(spark, scenes, **more):
    rows = [(s, r, c, float(p[r, c]), *[float(m[s][r, c]) for m in more.values()]) for s, p in scenes.items() for r in range(p.shape[0]) for c in range(p.shape[1])]
    return spark.createDataFrame(rows, "scene int, r int, c int, p double" + "".join(f", {n} double" for n in more))


RULES = [instances.PLAIN, instances.SplitRule(threshold=0.4371, least=16, reach=3, floor=1.5, large=150, large_reach=5, large_floor=2.0, markers=3), instances.BOUNDARY, instances.RELIEF, instances.SplitRule(threshold=0.6, least=10, reach=3, prominence=1.0, weight=0.4)]


@pytest.mark.parametrize("rule", RULES)
def test_split_equals_a_plain_flood(spark, rule):
    """Three scenes with the same cells' numbers: seeds, spacing over components' borders, floods and least sizes."""
    scenes = {s: blobs(s) for s in (1, 2, 3)}
    rng = np.random.default_rng(8)
    edges = {s: np.round(rng.random(p.shape), 2) for s, p in scenes.items()} if rule.weight else {s: np.zeros(p.shape) for s, p in scenes.items()}
    df = as_table(spark, scenes, edge=edges)
    got = instances.split_touching(df, ["scene"], F.col("p"), 60, rule, F.col("edge"), tile=16).collect()
    want = {s: plain_split(p, rule, edges[s]) for s, p in scenes.items()}
    found = {s: np.full(p.shape, -1) for s, p in scenes.items()}
    for x in got:
        found[x.scene][x.r, x.c] = x.instance
    for s in scenes:
        assert (found[s] == want[s]).all(), (s, np.argwhere(found[s] != want[s])[:5])
    assert len({(x.scene, x.instance) for x in got}) > len({(x.scene, x.component) for x in got}) or rule.prominence == 6.0


def test_split_edges(spark):
    nothing = spark.createDataFrame([], "scene int, r int, c int, p double")
    assert instances.split_touching(nothing, ["scene"], F.col("p"), 10).count() == 0
    full = as_table(spark, {1: np.ones((6, 6))})  # no background: one object
    assert {x.instance for x in instances.split_touching(full, ["scene"], F.col("p"), 6).collect()} == {0}
    some = full.withColumn("p", F.when(F.col("c") != 2, F.col("p")))
    assert {(x.component, x.instance) for x in instances.split_touching(some, ["scene"], F.col("p"), 6, valid=F.col("r") < 7).collect()} == {(3, 3)}
    assert instances.split_touching(full, ["scene"], F.col("p"), 6, valid=F.col("r") < 2).count() == 0


def plain_merge(found, valid, least=16, iou=0.5, inside=0.8, unclaimed=0.5, island=0.02):
    """found: {id: (score, cut, set of cells)}."""
    kept, owner = [], {}
    for k in sorted(found, key=lambda k: (found[k][1], -found[k][0], k)):
        score, _, cells = found[k]
        over = [(len(cells & o) / len(cells | o), len(cells & o) / min(len(cells), len(o))) for _, o in kept]
        if any(a >= iou or b >= inside for a, b in over):
            continue
        usable = cells & valid
        free = {x for x in usable if x not in owner}
        if len(free) < least or len(free) < unclaimed * len(usable):
            continue
        parts, left = [], set(free)
        while left:
            todo, part = [left.pop()], set()
            while todo:
                i, j = todo.pop()
                part.add((i, j))
                for y, x in SIDES:
                    if (i + y, j + x) in left:
                        left.discard((i + y, j + x))
                        todo.append((i + y, j + x))
            parts.append(part)
        floor = max(least, int(np.ceil(max(map(len, parts)) * island)))
        free = set().union(*[p for p in parts if len(p) >= floor])
        if not free:
            continue
        kept.append((k, free))
        owner |= dict.fromkeys(free, (k, score))
    return owner


def test_merge_equals_a_plain_sweep(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for scene in (1, 2):
        found, valid = {}, {(r, c) for r in range(50) for c in range(60) if rng.random() < 0.97}
        for k in range(60):
            y, x, h, w = rng.integers(0, 40), rng.integers(0, 50), rng.integers(3, 11), rng.integers(3, 11)
            cells = {(r, c) for r in range(y, min(50, y + h)) for c in range(x, min(60, x + w)) if rng.random() < 0.95}
            found[k] = (round(float(rng.random()), 1), bool(rng.random() < 0.2), cells)
            rows += [(scene, k, r, c, found[k][0], found[k][1], (r, c) in valid) for r, c in cells]
        want |= {(scene, *cell): own for cell, own in plain_merge(found, valid).items()}
    df = spark.createDataFrame(rows + rows[:40], "scene int, id int, r int, c int, score double, cut boolean, valid boolean")
    got = {(x.scene, x.r, x.c): (x.id, x.score) for x in instances.merge_instances(df, ["scene"]).collect()}
    assert got == want and len({v[0] for v in got.values()}) > 10


def test_merge_known_cases(spark):
    def cells(k, y, x, h, w, score, valid=lambda r, c: True):
        return [(k, r, c, score, False, valid(r, c)) for r in range(y, y + h) for c in range(x, x + w)]

    def run(rows):
        df = spark.createDataFrame(rows, "id int, r int, c int, score double, cut boolean, valid boolean")
        return instances.merge_instances(df, []).groupBy("id").count().collect()

    assert sorted(map(tuple, run(cells(1, 8, 10, 12, 12, 0.9) + cells(2, 8, 10, 12, 12, 0.8) + cells(3, 8, 31, 10, 10, 0.7)))) == [(1, 144), (3, 100)]
    assert [tuple(x) for x in run(cells(1, 5, 5, 15, 15, 0.9, lambda r, c: not (8 <= r < 16 and 8 <= c < 16)))] == [(1, 161)]
    # two accepted ones cover a third together: its leftover strip is no object
    assert sorted(x[0] for x in run(cells(1, 10, 10, 10, 18, 0.95) + cells(2, 10, 30, 10, 18, 0.9) + cells(3, 10, 10, 12, 38, 0.6))) == [1, 2]
    # whole ones come before better ones that a tile cut
    both = cells(1, 0, 0, 8, 8, 0.5) + [(2, r, c, 0.9, True, True) for r in range(8) for c in range(5)]
    assert [tuple(x) for x in run(both)] == [(1, 64)]


def test_instance_queries(spark, sf):
    split = registry.QUERIES["g15_split_touching"](spark, sf)
    assert split.columns == ["r", "c", "component", "instance"] and split.count() > 100
    merged = registry.QUERIES["g20_merge_instances"](spark, sf)
    assert merged.groupBy("scene", "r", "c").count().where("count > 1").isEmpty() and merged.select("scene", "id").distinct().count() > 10


def test_distance_rows_are_linear():
    """A row of 200,000 cells equals brute force where checked and takes seconds at most."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        c = np.sort(rng.choice(80, n, replace=False))
        known = np.sort(rng.choice(80, int(rng.integers(1, 40)), replace=False))
        g = rng.integers(0, 12, len(known)).astype(float)
        want = ((c[:, None] - known) ** 2 + g**2).min(axis=1)
        assert (grids.nearest_squares(c, known, g) == want).all()
    wide = np.arange(200_000)
    g = rng.integers(0, 5000, len(wide)).astype(float)
    began = time.perf_counter()
    got = grids.nearest_squares(wide, wide, g)
    assert time.perf_counter() - began < 20
    for at in (0, 777, 123_456, 199_999):
        assert got[at] == ((wide - at) ** 2 + g**2).min()


def test_regions_of_two_scenes(spark):
    """Labels of two scenes clash; each scene gives what it gives alone."""
    one, two = blobs(11, (20, 24), 5), blobs(12, (20, 24), 6)
    df = as_table(spark, {1: one, 2: two}).withColumn("v", F.col("r") * 1.5 + F.col("c")).withColumn("hit", (F.col("c") > 8) & (F.col("c") < 15))
    by = ("scene",)
    mask = df.where("p > 0.5")

    def all_of(part, by):
        cells = part.select(*by, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "p", "v", "hit")
        fg = cells.where("p > 0.5")
        lab = regions.label_components(fg.select(*by, "r", "c"), 24, tile=7, by=by)
        valued = lab.join(cells, [*by, "r", "c"])
        hit = cells.where("hit").select(*by, "r", "c")
        return {
            "small": regions.filter_small(lab, 30, by=by), "grown": regions.reconstruct(lab, hit, by=by), "stats": regions.region_stats(valued, F.col("v"), 20, 24, by=by),
            "largest": regions.largest_region(lab, by=by), "ids": regions.compact_ids(lab, by=by), "scores": regions.instance_scores(valued, F.col("v"), by=by),
            "cut": regions.exclude_by_overlap(lab, hit, 0.6, by=by), "seen": regions.confirm_by_witness(lab, hit, 10, 0.3, by=by), "point": regions.representative_point(lab, by=by),
            "holes": grids.fill_holes(cells, F.col("p") > 0.5, 24, 5, tile=7, by=by), "rim": grids.border_padding(cells, F.col("p") <= 0.5, 20, 24, tile=7, by=by),
            "shape": grids.region_shape(lab, by=by), "tiles": grids.on_halo_tiles(cells, "v", 8, 1, lambda g: g * 2, by=by),
        }

    both = all_of(df, by)
    alone = {s: all_of(df.where(F.col("scene") == s).drop("scene"), ()) for s in (1, 2)}
    near = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    for name, found in both.items():
        for s in (1, 2):
            columns = alone[s][name].columns
            assert sorted(map(near, found.where(F.col("scene") == s).select(*columns).collect())) == sorted(map(near, alone[s][name].collect())), name
    assert mask.count() > 0


def test_medians_of_large_and_small_regions(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k), float(v)) for k, n in ((1, 1), (2, 2), (3, 63), (4, 64), (5, 65), (6, 3000), (7, 3001)) for v in rng.lognormal(sigma=3, size=n)] + [(8, None), (9, 2.0), (9, None), (10, 5.0)] + [(10, 5.0)] * 500
    got = {r.k: r["median"] for r in regions.region_medians(spark.createDataFrame(rows, "k int, v double"), ["k"], F.col("v")).collect()}
    for k in {r[0] for r in rows} - {8}:
        assert got[k] == pytest.approx(np.median([v for q, v in rows if q == k and v is not None]), rel=1e-12)
    assert 8 not in got


def test_window_medians(spark):
    """Missing and null cells have no weight; tiles smaller than the scene, two scenes."""
    rng = np.random.default_rng(9)
    values = {(s, r, c): (None if rng.random() < 0.1 else float(rng.random())) for s in (1, 2) for r in range(13) for c in range(11) if rng.random() < 0.9}
    df = spark.createDataFrame([(*k, v) for k, v in values.items()], "scene int, r int, c int, v double")
    got = {(x.scene, x.r, x.c): x.m for x in focal.median_filter(df, "v", 5, "m", focal.Grid(scene=("scene",)), tile=4).collect()}
    assert set(got) == set(values)
    for (s, r, c), m in got.items():
        near = [v for y in range(r - 2, r + 3) for x in range(c - 2, c + 3) if (v := values.get((s, y, x))) is not None]
        assert m is None if not near else m == pytest.approx(np.median(near), rel=1e-12)


def test_shift_scores_equal_plain_correlations():
    rng = np.random.default_rng(10)
    a, b = rng.random((14, 17)) + 5, rng.random((14, 17)) * 3
    a[rng.random(a.shape) < 0.2], b[rng.random(b.shape) < 0.2] = np.nan, np.nan
    b[:, 12:] = 1.0
    got = pairs.shift_scores(a, b, 4)
    for dy in range(-4, 5):
        for dx in range(-4, 5):
            both = [(a[r, c], b[r + dy, c + dx]) for r in range(14) for c in range(17) if 0 <= r + dy < 14 and 0 <= c + dx < 17]
            both = np.array([x for x in both if not np.isnan(x).any()])
            assert got[dy + 4, dx + 4] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)
    assert np.isnan(pairs.shift_scores(a, np.ones_like(a), 2)).all()


def test_sparse_assignment_equals_the_dense_one():
    from orbitframe.operators.matching import assign, assign_sparse

    rng = np.random.default_rng(1)
    for _ in range(400):
        n, m = rng.integers(1, 9, 2)
        grid = np.where(rng.random((n, m)) < 0.5, np.round(rng.random((n, m)), int(rng.integers(1, 5))), 0)
        i, j = np.nonzero(grid)
        if len(i):
            got = assign_sparse(i, j, grid[i, j])
            assert len(set(i[got])) == len(got) == len(set(j[got]))
            assert grid[i[got], j[got]].sum() == pytest.approx(sum(grid[x] for x in assign(grid)), abs=1e-9)
    # a chain of 10,000 overlaps: no matrix, and the best total by a plain recurrence
    a, b = np.repeat(np.arange(10_000), 2)[:-1], np.r_[0, np.repeat(np.arange(1, 10_000), 2)]
    w, took, left = rng.random(len(a)), 0.0, 0.0
    for x in w:
        took, left = left + x, max(left, took)
    assert w[assign_sparse(a, b, w)].sum() == pytest.approx(max(took, left))


@pytest.mark.parametrize("most_pairs", [False, True])
def test_matches_over_settled_pairs_and_clusters(spark, most_pairs):
    from orbitframe.operators.matching import assign, one_to_one_match

    rng = np.random.default_rng(2)
    grid = np.where(rng.random((30, 28)) < 0.12, np.round(rng.random((30, 28)), 3), 0)
    edges = spark.createDataFrame([(int(i), int(j), float(grid[i, j])) for i, j in zip(*np.nonzero(grid), strict=True)] * 2, "a long, b long, iou double")
    got = one_to_one_match(edges, 0.3, most_pairs).collect()
    assert len({x.a for x in got}) == len(got) == len({x.b for x in got}) and all(x.iou >= 0.3 and grid[x.a, x.b] == x.iou for x in got)
    if most_pairs:
        likely = np.where(grid >= 0.3, grid + 100, 0)
        want = [x for x in assign(likely) if likely[x] > 0]
    else:
        want = [x for x in assign(grid) if grid[x] >= 0.3]
    assert len(got) == len(want) and sum(x.iou for x in got) == pytest.approx(sum(grid[x] for x in want))
    assert one_to_one_match(edges.limit(0)).count() == 0
