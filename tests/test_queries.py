"""Every registered query of the reference's operators against its SQL twin; iterative ones against numpy or plain Python."""

import pytest
from conftest import duck, same
from orbitframe.plans import registry


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf, con, name):
    same(registry.QUERIES[name](spark, sf), con, registry.ORACLE_SQL[name])


def test_non_max_suppression_is_greedy(spark, sf):
    boxes = registry.windows(spark, sf).collect()
    kept = []
    for b in sorted(boxes, key=lambda b: (-b.score, b.id)):
        def iou(a, b=b):
            w, h = max(0, min(a.x, b.x) + 448 - max(a.x, b.x)), max(0, min(a.y, b.y) + 448 - max(a.y, b.y))
            return w * h / (2 * 448 * 448 - w * h)

        if all(iou(a) <= 0.45 for a in kept):
            kept.append(b)
    assert sorted(r.id for r in registry.QUERIES["r12_non_max_suppression"](spark, sf).collect()) == sorted(b.id for b in kept)


def test_labels_of_several_scenes(spark):
    """Scenes never touch; tiles of one cell make every border a seam; diagonal neighbours count where asked for."""
    import numpy as np
    from orbitframe.operators import regions

    rng = np.random.default_rng(2)
    cells = {(s, int(r), int(c)) for s in range(3) for r, c in zip(*np.nonzero(rng.random((14, 17)) < 0.55), strict=True)}
    df = spark.createDataFrame(sorted(cells), "scene int, r int, c int")
    for diagonal, tile in ((False, 5), (True, 5), (True, 1), (False, 64)):
        left, want = set(cells), {}
        while left:
            todo = [min(left)]
            left.discard(todo[0])
            seen = []
            while todo:
                s, r, c = todo.pop()
                seen.append((s, r, c))
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):
                        near = (s, r + dr, c + dc)
                        if near in left and (diagonal or abs(dr) + abs(dc) == 1):
                            left.discard(near)
                            todo.append(near)
            want |= {x: min(r * 17 + c for _, r, c in seen) for x in seen}
        got = regions.label_components(df, 17, diagonal, tile, by=("scene",))
        assert {(x.scene, x.r, x.c): x.label for x in got.collect()} == want


@pytest.mark.parametrize("few", [0, 100_000])
def test_percentiles_and_numbers(spark, monkeypatch, few):
    import numpy as np
    from orbitframe.operators import aggregates, regions
    from pyspark.sql import functions as F

    monkeypatch.setattr(aggregates, "FEW", few)
    rng = np.random.default_rng(9)
    data = [(int(k), float(x)) for k in range(3) for x in rng.lognormal(sigma=4, size=400)] + [(5, 1.0)] * 50 + [(6, None), (7, float("nan")), (8, 3.0)]
    df = spark.createDataFrame(data, "k int, x double")
    got = {r.k: (r.a, r.b, r.c) for r in aggregates.exact_percentiles(df, ["k"], F.col("x"), {"a": 0.0, "b": 0.37, "c": 1.0}, cells=7).collect()}
    for k in (0, 1, 2, 5, 8):
        want = np.percentile([x for q, x in data if q == k], [0, 37, 100])
        assert np.allclose(got[k], want, rtol=1e-12)
    assert set(got) == {0, 1, 2, 5, 8}
    out = regions.numbered(df.where("k < 3"), ["x", "k"], "n").orderBy("n").collect()
    assert [r.n for r in out] == list(range(1, 1201)) and [r.x for r in out] == sorted(r.x for r in out)


@pytest.fixture
def small_ranges(spark):
    """Small tables keep all their ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ordered_groups_spread_over_ranges(spark, small_ranges):
    """One group holds most rows and many ranges; NULL is a group; an empty table stays empty; no columns are added but the named one."""
    from orbitframe.operators import aggregates
    from pyspark.sql import functions as F

    rows = [(1, i, i % 7 if i % 3 == 0 else None) for i in range(3000)] + [(None, i, i) for i in range(40)] + [(2, 0, None), (2, 1, None)]
    df = spark.createDataFrame(rows, "k int, i int, x int").repartition(5)
    want_sum, want_last = {}, {}
    for k in (1, None, 2):
        total = last = None
        for _, i, x in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            total, last = (total or 0) + x if x is not None else total, x if x is not None else last
            want_sum[k, i], want_last[k, i] = total, last
    for make, want in ((aggregates.cumulative, want_sum), (aggregates.forward_fill, want_last)):
        out = make(df, ["k"], [F.desc("i")], "x", "y")
        assert out.columns == ["k", "i", "x", "y"] and {(r.k, r.i): r.y for r in out.collect()} == want
        assert make(df.where("false"), ["k"], [F.desc("i")], "x", "y").count() == 0
    spread = aggregates.in_ranges(df, ["k"], [F.desc("i")])
    assert spread.where("k = 1").select("__part").distinct().count() > 1
    order = {k: {i: n for n, i in enumerate(sorted((r[1] for r in rows if r[0] == k), reverse=True), 1)} for k in (1, None, 2)}
    assert all(r["rank"] == order[r.k][r.i] for r in aggregates.ranked(df, ["k"], [F.desc("i")]).collect())
    got = aggregates.even_sample(df, ["k"], [F.col("i")], 50)
    assert {(r.k, r.i) for r in got.collect()} == {(1, j * 2999 // 49) for j in range(50)} | {(None, i) for i in range(40)} | {(2, 0), (2, 1)}


def test_shift_is_found_coarse_to_fine(spark):
    import numpy as np
    from orbitframe.operators import pairs

    rng = np.random.default_rng(3)
    field = np.cumsum(np.cumsum(rng.normal(size=(70, 80)), axis=0), axis=1)
    a, b = field[10:58, 10:66], field[3:51, 5:61]
    rows = [(1, r, c, float(a[r, c]), float(b[r, c])) for r in range(48) for c in range(56)]
    df = spark.createDataFrame(rows, "scene int, r int, c int, a double, b double")
    for base in (64, 16):
        assert [tuple(x)[:3] for x in pairs.best_shift(df, ["scene"], "a", "b", base=base).collect()] == [(1, 7, 5)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
