"""Streams of delivered records: each record once, and counts of event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.storage import table_dir


def delivered(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream; new files in the folder arrive as new batches."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")


def first_deliveries(stream: DataFrame, key: str, received: str = "received_at", within: str | None = None) -> DataFrame:
    """Each record once, by its key.

    Without ``within`` the state holds every key, so a re-delivery is dropped however late it comes.
    With it, only re-deliveries that arrive within the delay of the first delivery are dropped and
    keys are forgotten after it: state stays small and later re-deliveries count again; ``once``
    removes those from what was collected.
    """
    if within is None:
        return stream.dropDuplicates([key])
    timed = stream.withColumn(received, F.col(received).cast("timestamp"))
    return timed.withWatermark(received, within).dropDuplicatesWithinWatermark([key])


def once(records: DataFrame, key: str, received: str = "received_at") -> DataFrame:
    """The first delivery of each record of a table, however late others came: the exact batch way.

    Deliveries without a time count as the last ones; a null key is a record of its own.
    """
    first = records.groupBy(key).agg(F.min(received).alias("_first"))
    return records.join(first, records[key].eqNullSafe(first[key]) & records[received].eqNullSafe(first["_first"]), "left_semi").dropDuplicates([key])


def window_counts(records: DataFrame, time: str, length: str, *keys: str) -> DataFrame:
    """(window start, keys, records) per tumbling window of the records' own time; rows without a time are left out."""
    timed = records.where(F.col(time).isNotNull()).withColumn("_at", F.col(time).cast("timestamp"))
    counted = timed.groupBy(F.window("_at", length).alias("w"), *keys).agg(F.count("*").alias("records"))
    return counted.select(F.col("w.start").alias("begins"), *keys, "records")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now and return what it gave, from the shared folder.

    The last complete result replaces those before it, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    base = f"{table_dir(spark)}/{name}-{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch-{number}")
        last[:] = [number]

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/batch-{last[0]}")
