"""Readers, writers and streams on small files of their own; text and rule functions on odd values."""

import json

from orbitframe.functions import rules, text
from orbitframe.operators import pairs
from orbitframe.sources import features
from orbitframe.streaming import catalog
from pyspark.sql import functions as F


def test_read_features_skips_what_is_no_feature(spark, tmp_path):
    ring = [[[0, 0], [4, 0], [4, 2], [0, 0]]]
    good = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"kind": "water"}, "geometry": {"type": "Polygon", "coordinates": ring}}, {"type": "Feature", "properties": {}, "geometry": None}, {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": ring}}]}
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "lakes.geojson").write_text(json.dumps(good))
    (tmp_path / "run" / "broken.geojson").write_text("{no json")
    found = features.read_features(spark, str(tmp_path))
    assert sorted(r.kind for r in found.collect()) == ["lakes", "water"]
    bounds = found.select(*features.geometry_bounds(F.col("geometry.coordinates"))).first()
    assert tuple(bounds) == (0.0, 0.0, 4.0, 2.0)
    empty = spark.range(1).select(*features.geometry_bounds(F.lit(None).cast(features.RING))).first()
    assert tuple(empty) == (0.0, 0.0, 0.0, 0.0)


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"scene": "a", "tiles": [{"x": 1}, {"x": 2}]}))
    rows = features.read_manifests(spark, str(tmp_path), "scene string, tiles array<struct<x: int>>", "tiles")
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 1), ("a", 2)]


def test_group_delivered_again_replaces_its_rows(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "run long, feature long").coalesce(1)
    make([(1, 10), (1, 11), (2, 20)]).write.parquet(str(tmp_path / "in.parquet"))
    make([(1, 12)]).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    stream = spark.readStream.schema("run long, feature long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in.parquet"))
    rows = catalog.latest_delivery(catalog.run_to_table(stream, "append"), "run")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 12), (2, 20)]


def test_texts_of_odd_values(spark):
    df = spark.createDataFrame([("",), (None,), ("mark 95, 10",), ("water near Old Town, please",)], "t string")
    told = df.select(text.topic_title(F.col("t")).alias("title"), text.place(F.col("t")).alias("place"), text.coordinates(F.col("t"))[2].alias("error")).collect()
    assert [r.title for r in told] == ["Geospatial Analysis", None, "Mark 95 10", "Water Near Old Town"]
    assert [r.place for r in told] == [None, None, None, "old town"]
    assert [r.error for r in told] == [None, None, "out of range", None]


def test_empty_tables(spark):
    px = spark.createDataFrame([], "scene int, r int, c int, a double, b double")
    assert pairs.alignment_score(px, ["scene"], "a", "b").count() == 0
    assert pairs.best_shift(px, ["scene"], "a", "b").count() == 0
    assert pairs.radiometric_normalization(px, ["scene"], "a", "b", "x").count() == 0


def test_flat_scene_and_missing_model(spark):
    px = spark.createDataFrame([(1, r, c, 0.5, 0.7) for r in range(4) for c in range(4)], "scene int, r int, c int, a double, b double")
    assert pairs.alignment_score(px, ["scene"], "a", "b").first().alignment == 0.8
    one = spark.range(1).select(rules.weighted_confidence(*[F.lit(1.0)] * 4, F.lit(0.0), F.lit(None).cast("double")).alias("p"))
    assert 0.95 < one.first().p <= 0.98


def test_sectioned_text(spark, tmp_path):
    from orbitframe.sources import features

    (tmp_path / "a.txt").write_text("# remark\n\n[META]\nName: one: two\n[CLASSES]\n0: Urban\n 1: Water \n[PATCHES]\np1 | x | 3\n")
    got = [(r.section, r.key, r.value, r.parts) for r in features.read_sectioned_text(spark, str(tmp_path / "a.txt")).orderBy("line").collect()]
    assert got == [("META", "Name", "one: two", None), ("CLASSES", "0", "Urban", None), ("CLASSES", "1", "Water", None), ("PATCHES", None, None, ["p1", "x", "3"])]


def test_polygons_with_holes_and_corners(spark):
    from orbitframe.operators import polygons

    ring = [(1, r, c) for r in range(5) for c in range(5) if not (1 <= r <= 3 and 1 <= c <= 3)]
    corner = [(2, 10, 10), (2, 10, 11), (2, 11, 11), (2, 12, 11), (2, 12, 10), (2, 12, 9), (2, 11, 9)]
    df = spark.createDataFrame(ring + corner + [(3, 20, 20)], "label long, r long, c long")
    out = polygons.polygonize(df)
    got = {r.label: [[(p.x, p.y) for p in x] for x in r.rings] for r in out.collect()}
    assert got[1] == [[(0, 0), (5, 0), (5, 5), (0, 5)], [(1, 1), (1, 4), (4, 4), (4, 1)]]
    assert set(got) == {1, 2} and sum(polygons.signed_area(x) for x in got[2]) == 7
    assert {(r.label, r.r, r.c) for r in polygons.rasterize(out).collect()} == set(ring + corner)
    assert polygons.geometry_matches_mask(out, df.where("label < 3")).count() == 0
    assert [tuple(r) for r in polygons.geometry_matches_mask(out, df.where("label < 3 AND NOT (label = 2 AND c = 9)")).collect()] == [(2, 0, 2)]


def test_collections_and_texts_come_back(spark, tmp_path):
    """Features without a shape and properties without a value are left out; an empty table writes nothing that is read."""
    rows = spark.createDataFrame([(0, "b", None, 1.0), (0, "a", "x", 2.0), (1, "c", "y", None)], "block int, name string, note string, x double")
    x = F.col("x")
    shaped = rows.withColumn("ring", F.when(x.isNotNull(), features.rectangle(x, x, x + 1, x + 1)))
    features.feature_collections(shaped, ["block"], ["name", "note"], "ring").write.partitionBy("block").text(str(tmp_path / "a"))
    got = features.read_features(spark, str(tmp_path / "a"), "*.txt").collect()
    assert sorted((r.properties["name"], r.properties.get("note")) for r in got) == [("a", "x"), ("b", None)]
    features.feature_collections(shaped.where("false"), ["block"], ["name"], "ring").write.partitionBy("block").text(str(tmp_path / "b"))
    assert features.read_features(spark, str(tmp_path / "b"), "*.txt").count() == 0

    lines = spark.createDataFrame([(0, 1, "A", "k: v"), (0, 2, "B", "1 | 2"), (0, 0, "B", "# no"), (0, 3, "A", "l:m:n")], "block int, nth int, section string, line string")
    texts = features.sectioned_text(lines, ["block"], "section", "line", ["nth"])
    assert [r.value for r in texts.collect()] == ["[A]\nk: v\nl:m:n\n[B]\n# no\n1 | 2"]


def test_manifests_of_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text("".join(json.dumps(x) + "\n" for x in ({"scene": "a", "tiles": [{"x": 1}]}, {"scene": "b", "tiles": []}, {"scene": "c"}, {"scene": "d", "tiles": [{"x": 2}, {}]})))
    rows = features.read_manifests(spark, str(tmp_path), "scene string, tiles array<struct<x: int>>", "tiles", lines=True)
    assert sorted((tuple(r) for r in rows.collect()), key=str) == [("a", 1), ("d", 2), ("d", None)]


def test_fused_masks_and_their_regions(spark):
    """NULL and NaN cells are in no mask, unknown targets are compared as general, regions of three cells do not count."""
    from orbitframe.operators import change

    ask = spark.createDataFrame([(None, None), ("", "Which Rivers?"), ("road", None), ("water", "urban water"), ("road", "crop"), ("general", "the sea")], "target string, q string")
    assert [r[0] for r in ask.select(change.fusion_target(F.col("target"), F.col("q"))).collect()] == ["water", "water", "road", "built-up", "vegetation", "water"]

    nan = float("nan")
    cells = [(1, "road", r, c, True, 0.9, 0.9) for r, c in ((0, 0), (0, 1), (1, 0), (1, 1), (3, 3), (3, 4), (4, 3))]
    cells += [(1, "road", 6, 0, True, nan, 0.9), (1, "road", 6, 1, True, 0.9, None), (2, "water", 0, 0, False, 0.1, 0.1), (2, "water", 0, 1, False, None, nan), (3, "water", 0, 0, True, 0.1, 0.1)]
    df = spark.createDataFrame(cells, "scene int, target string, r int, c int, multi boolean, light double, radar double")
    none = F.lit(None).cast("double")
    masks = change.fused_masks(df, F.col("target"), F.col("multi"), F.col("light"), F.col("radar"), none, none, none, none)
    assert {(r.scene, r.r, r.c): r.seen for r in masks.where("scene > 1 OR r = 6").collect()} == {(1, 6, 0): "radar", (1, 6, 1): "optical", (2, 0, 0): "both", (2, 0, 1): None, (3, 0, 0): "radar"}
    told = change.fusion_report(masks, ["scene", "target", "multi"], 8, F.col("multi"), tile=4).orderBy("scene").collect()
    assert [(r.regions, r.region_pixels, r.iou_percent, r.confidence) for r in told] == [(1, 4, 77.78, 0.952), (0, 0, 100.0, 0.928), (0, 0, 0.0, 0.412)]
