"""Structured Streaming forms of the batch jobs: file sources in, windows or micro-batches out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.workspace import shared_folder


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """New parquet files of a folder, a bounded number of them at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(events: DataFrame, time: str, keys: list[str], value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of tumbling windows; rows later than the watermark are left out."""
    marked = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    agg = marked.groupBy(F.window("_t", window), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("window.start").alias("start"), *keys, "n", "total")


def run_to_table(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Runs a stream over all that is there now, into a table of the shared folder, and reads that.

    Restarted with the same folder it goes on where it stopped; each run here has its own.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def micro_batches(stream: DataFrame, handle, folder: str):
    """Hands each micro-batch, with its number, to a function; exactly resumable by the checkpoint in ``folder``."""
    return stream.writeStream.foreachBatch(lambda df, k: handle(df, k)).option("checkpointLocation", folder).trigger(availableNow=True).start()
