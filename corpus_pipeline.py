"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import jaccard_join, langid, line_dedup, mixing, packing
from orbitframe.llm.common import materialize, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction less sure than this rejects the document.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; lang is the predicted one. Texts without letters or with an unsure guess go."""
    model = langid.train(docs.where(~langid.in_fold(F.col("doc_id"))))
    told = langid.predict(docs.select(*COLUMNS), model)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that many documents share; n_chars follows."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; null ids come last.

    Rows are told apart by id and text, so rows that share an id or have none are judged each by its own text. Of rows equal
    in both, one stays. Documents without words have no near copies and stay, but for such repeats.
    """
    found = materialize(jaccard_join.link_components(docs).select("doc_id", "text_hash", "component_key"), "near-copies")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.where("component_key IS NOT NULL").groupBy("component_key").agg(F.min(rank).alias("first"))
    gone = found.join(first, "component_key").where(rank != F.col("first")).select("doc_id", "text_hash").distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    same = lambda other: rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["text_hash"] == other["text_hash"])
    kept = rows.join(gone, same(gone), "left_anti")
    twice = found.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    if not twice.isEmpty():
        once = kept.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "text_hash"])
        kept = kept.join(twice, same(twice), "left_anti").unionByName(once)
    return kept.select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.mixed(docs.select(*COLUMNS))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.op7(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("sequences", sequences)]
#: Trained models, perfect hashing, similarity links and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/orbitframe-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
