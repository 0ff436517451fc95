"""Structured Streaming: state per chat, and an index that takes each arriving group of features once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import shared


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/{name}.parquet*")


def chat_state(messages: DataFrame, chat: str, turn: str, role: str) -> DataFrame:
    """Per chat: messages, those of the user, and the last role; state is one row per chat."""
    return messages.groupBy(chat).agg(F.count("*").alias("messages"), F.count_if(F.col(role) == "user").alias("asked"), F.max(F.struct(turn, role)).alias("__m")).select(chat, "messages", "asked", F.col(f"__m.{turn}").alias("last_turn"), F.col(f"__m.{role}").alias("last_role"))


def windowed_counts(events: DataFrame, time: str, late: str, width: str, kind: str) -> DataFrame:
    """Events per window and kind; windows close when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there, and reads its result back from the shared folder.

    In update mode each micro-batch writes its changed rows with the batch's number; the newest row of a key counts, see
    ``newest``. Batches write under their own number, so a batch that runs again replaces itself.
    """
    spark, path = stream.sparkSession, shared(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/b={number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(write).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{path}/rows/b=-1")
    return spark.read.schema(schema).parquet(f"{path}/rows/b=*")


def newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the row of the latest batch."""
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*key, "__r.*")


def latest_delivery(rows: DataFrame, group: str) -> DataFrame:
    """Rows of each group's latest batch: a group that is delivered again replaces its earlier rows."""
    last = rows.groupBy(group).agg(F.max("batch").alias("batch"))
    return rows.join(last, [group, "batch"], "left_semi").drop("batch")
