"""Vector features as GeoJSON, manifests as JSON, grids as Parquet: read and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.aggregates import ranked as in_ranks

RING = "array<array<array<double>>>"
FEATURES = f"type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: {RING}>>>"


def read_features(spark: SparkSession, folder: str, names: str = "*.geojson") -> DataFrame:
    """(file, kind, properties, geometry): one row per feature of every GeoJSON file below the folder whose name fits.

    A kind that is not given is the file's stem. Files that are no JSON and features without geometry are left out.
    """
    files = spark.read.schema(FEATURES).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", names).option("mode", "PERMISSIVE").json(folder)
    rows = files.select(F.col("_metadata.file_name").alias("file"), F.explode("features").alias("f")).where("f.geometry.coordinates IS NOT NULL")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return rows.select("file", F.coalesce(F.element_at("f.properties", "kind"), stem).alias("kind"), F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))


def geometry_bounds(coordinates: Column) -> tuple[Column, Column, Column, Column]:
    """(x0, y0, x1, y1) of all vertices; zeros where there are none."""
    points = F.flatten(coordinates)
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return tuple(F.coalesce(v, F.lit(0.0)) for v in (F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed ring around a box, as GeoJSON polygon coordinates."""
    return F.array(F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]))


def feature_lines(df: DataFrame, run: str, area: str, coordinates: str, kind: str) -> DataFrame:
    """(run, feature): a GeoJSON feature per row, ranked by area in its run; the largest is marked.

    Runs may be of any size: their rows are ranked in sorted ranges, which kinds divide where areas and shapes are equal.
    """
    shaped = df.withColumn("__shape", F.to_json(F.struct(coordinates)))  # a column, as a sort computes its expressions per comparison
    ranked = in_ranks(shaped, [run], [F.desc(area), F.col("__shape"), F.col(kind)], "__rank")
    properties = F.struct(F.col(run).cast("string").alias("run"), F.col(kind).cast("string").alias("kind"), F.col(area).cast("string").alias("area"), F.col("__rank").cast("string").alias("rank"), (F.col("__rank") == 1).cast("string").alias("is_largest"))
    return ranked.select(run, F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.col(coordinates).alias("coordinates")).alias("geometry"))).alias("feature"))


def write_features(df: DataFrame, path: str, run: str, area: str, coordinates: str, kind: str) -> None:
    """One line per feature (GeoJSON text sequence), a folder per run: no run has to fit in one row or task."""
    feature_lines(df, run, area, coordinates, kind).write.partitionBy(run).text(path)


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_features`` wrote: (kind, properties, geometry)."""
    one = f"type string, properties map<string, string>, geometry struct<type: string, coordinates: {RING}>"
    rows = spark.read.text(path).select(F.from_json("value", one).alias("f")).where("f.geometry.coordinates IS NOT NULL")
    return rows.select(F.element_at("f.properties", "kind").alias("kind"), F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))


def read_manifests(spark: SparkSession, folder: str, schema: str, entries: str, lines: bool = False) -> DataFrame:
    """One row per entry of the JSON manifests below a folder: a manifest per file, or per line. Manifests without entries have no row."""
    rows = spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True).json(folder)
    return rows.select("*", F.explode(entries).alias("__e")).drop(entries).select("*", "__e.*").drop("__e")


def feature_collections(df: DataFrame, by: list[str], properties: list[str], coordinates: str) -> DataFrame:
    """(by, value): a GeoJSON document per group with a feature per row, in the order of the properties.

    A group is one row, so ``by`` must name bounded groups, such as a scene's block; ``write_features`` has no such bound.
    Columns are shuffled and written out as text only then, several times as long.
    """
    def feature(x):
        told = F.create_map(*[y for p in properties for y in (F.lit(p), x[p].cast("string"))])
        return F.to_json(F.struct(F.lit("Feature").alias("type"), told.alias("properties"), F.struct(F.lit("Polygon").alias("type"), x["__ring"].alias("coordinates")).alias("geometry")))

    lists = df.select(*by, F.struct(*properties, F.col(coordinates).alias("__ring")).alias("x")).groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return lists.select(*by, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("x", feature), ","), F.lit("]}")).alias("value"))


def sectioned_text(rows: DataFrame, by: list[str], section: str, line: str, order: list[str]) -> DataFrame:
    """(by, value): a text per group, a ``[SECTION]`` header before each section's lines; groups and their order as the columns say.

    A text is one row and is read back as one, so ``by`` must name bounded groups.
    """
    first = F.row_number().over(W.partitionBy(*by, section).orderBy(*order)) == 1
    told = F.when(first, F.concat(F.lit("["), F.col(section), F.lit("]\n"), F.col(line))).otherwise(F.col(line))
    lists = rows.withColumn("__t", told).select(*by, F.struct(section, *order, "__t").alias("x")).groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return lists.select(*by, F.array_join("x.__t", "\n").alias("value"))


def read_grid(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_grid`` wrote; filters on the parts open only their folders."""
    return spark.read.schema(schema).parquet(path)


def write_grid(df: DataFrame, path: str, parts: list[str]) -> None:
    """A pixel table by product and scene, so that a reader of one scene opens only its files."""
    df.write.partitionBy(*parts).parquet(path)


def read_sectioned_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, section, key, value, parts) of texts with ``[SECTION]`` headers, ``#`` remarks, ``key: value`` lines and
    ``a | b | c`` rows. A file is one row at first, as its lines' order matters; such files are small."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = files.withColumn("text", F.btrim("text")).where((F.col("text") != "") & ~F.col("text").startswith("#"))
    head = F.regexp_extract("text", r"^\[(.*)\]$", 1)
    order = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("head", F.col("text").rlike(r"^\[.*\]$")).withColumn("section", F.last(F.when(F.col("head"), head), True).over(order)).where("NOT head")
    row, pair = F.contains("text", F.lit("|")), F.contains("text", F.lit(":"))
    return lines.select(
        "file", "line", "section", F.when(pair & ~row, F.btrim(F.regexp_extract("text", "^([^:]*):", 1))).alias("key"), F.when(pair & ~row, F.btrim(F.regexp_extract("text", "^[^:]*:(.*)$", 1))).alias("value"),
        F.when(row, F.transform(F.split("text", r"\|"), lambda x: F.btrim(x))).alias("parts"),
    )
