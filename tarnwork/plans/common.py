"""Tables of the queries, and the SQL fragments their oracles share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, label (the source)"""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("label"))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, label (the quality), lang, source, toxic of the labelled documents"""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"), "lang", "source", "toxic")


SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def norm(x: str) -> str:
    return f"replace(lower(replace(trim(regexp_replace({x}, '{SPACE}', ' ', 'g')), 'İ', 'i̇')), 'ß', 'ss')"


SOURCED = "sourced AS (SELECT doc_id, text, source AS label FROM documents)"
RATED = "rated AS (SELECT doc_id, text, quality AS label, lang, source, toxic FROM documents JOIN labels USING (doc_id))"
