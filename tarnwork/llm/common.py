"""What several operators of this package share: table access, scratch space, word splitting."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the five ASCII controls 0x09-0x0D. Fixed by the contracts.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a narrow table (some dozens of bytes each) that is broadcast, at most.
FEW_ROWS = 200_000


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the folder that driver and executors share; it goes with the session at the latest.

    The cluster names that folder in ``spark.checkpoint.dir``; only where it is unset and the master is this
    machine (tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnwork-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _file_system(spark, path)[0].deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    return path


#: Rows that go to a Python worker at once; Spark's own 10,000 whole texts are tens of megabytes, several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a worker and the executor beside it hold of texts; a session that asks for still smaller batches keeps them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Seconds of work after which a written table's shuffles are given back.
TIDY_S = 5.0
_tidied = [0.0]


def tidy(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of ended queries. It does so once the driver's JVM collects their handles, which a driver with memory to
    spare puts off while the executors' disks fill; so it is asked to, at most every ``TIDY_S`` seconds."""
    if time.monotonic() - _tidied[0] >= TIDY_S:
        spark.sparkContext._jvm.System.gc()
        _tidied[0] = time.monotonic()


def lean(run):
    """``run`` for mapInArrow; at the end of each task its worker, which waits for the next stage's, gives back the memory of batches that are gone."""

    def mapped(parts):
        yield from run(parts)
        pa.default_memory_pool().release_unused()

    return mapped


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. What it was shuffled through goes."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, wherever it is."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def few(table: DataFrame) -> DataFrame:
    """A narrow written table, to be broadcast if it has FEW_ROWS rows at most."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table


def words_of(text):
    """Column: the words of a text, [] for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
