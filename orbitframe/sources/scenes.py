"""Pixel tables: moving between tiles and pixels, and the derived scene used by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ("red", "green", "nir", "swir")


def read_pixels(spark: SparkSession, path: str, bands: list[str], keys: list[str], scale: float = 1.0, offset: float = 0.0, valid: Column | None = None) -> DataFrame:
    """Only the wanted bands of a pixel table, scaled; NULL where the pixel is not valid. Column pruning reaches the scan."""
    df = spark.read.parquet(path)
    ok = F.lit(True) if valid is None else valid
    return df.select(*keys, *[F.when(ok, F.col(b) * scale + offset).alias(b) for b in bands])


def tiles_to_pixels(tiles: DataFrame, key: str, row: Column, width: int, values: str) -> DataFrame:
    """One row per cell of an array column: (key, r, c, v), row by row in tiles of the width."""
    return tiles.select(key, row.alias("__r0"), F.posexplode(values).alias("__p", "v")).select(key, (F.col("__r0") + F.floor(F.col("__p") / width)).cast("int").alias("r"), (F.col("__p") % width).cast("int").alias("c"), "v")


def pixels_to_tiles(px: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Back to one array per tile, in order. Tiles have a fixed size, so groups are bounded."""
    return px.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias("values"))


def derived_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, b, v): four bands at two dates, made of the embeddings table; v in 0..1."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.floor(F.col("vec_id") / 8).cast("int").alias("r"), (F.col("vec_id") % 8).cast("int").alias("b"), F.posexplode("embedding").alias("c", "e")).select("r", "c", "b", ((F.col("e").cast("double") + 1) / 2).alias("v"))


def derived_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, red..swir, red2..swir2): one row per pixel. A scene row is made of eight vectors, so one shuffle does it."""
    names = [*BANDS, *(f"{b}2" for b in BANDS)]
    px = derived_pixels(spark, sf_dir)
    return px.groupBy("r", "c").agg(*[F.max(F.when(F.col("b") == i, F.col("v"))).alias(n) for i, n in enumerate(names)])
