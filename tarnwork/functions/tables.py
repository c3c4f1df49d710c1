"""Tables that are written to the folder which driver and executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where it is unset and the master is this machine (tests) a temporary one takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, what: str, *by: str) -> DataFrame:
    """``df`` written once and read back, in a folder for each value of its last columns ``by``: its lineage ends there, lost executors cost no more than a read. The files go with the session."""
    spark = df.sparkSession
    path = f"{shared(spark)}/{what}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
