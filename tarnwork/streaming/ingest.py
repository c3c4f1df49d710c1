"""Incremental ingestion of run records: an addition of this engine for growing result folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnwork.sources import io


def ingest_runs(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the records of new files to a Parquet table, each batch once (its number names its folder), then ends."""

    def write(batch: DataFrame, number: int) -> None:
        io.flatten_runs(io.parse_runs(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.text(path, wholetext=True).withColumn("source_path", F.col("_metadata.file_path"))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
