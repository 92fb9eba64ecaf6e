"""Incremental loading: a file stream whose batches are upserted, and duplicates within a watermark dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("__rank = 1").drop("__rank")


def upsert_stream(spark: SparkSession, source: str, schema, table: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """Each micro-batch is written as a version of the table that holds the newest row of each key.

    A batch that runs twice writes its own version again, so the result is the same. The newest version is read
    with :func:`current`.
    """

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        rows = batch
        if number > 0:
            rows = s.read.parquet(f"{table}/v{number - 1}").unionByName(batch)
        latest_by_key(rows, key, order).write.mode("overwrite").parquet(f"{table}/v{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{table}/v{version}")


def deduplicated(stream: DataFrame, key: str, time: str, lookback: str) -> DataFrame:
    """The first arrival of each key within the look-back window; state older than it is dropped."""
    return stream.withWatermark(time, lookback).dropDuplicatesWithinWatermark([key])
