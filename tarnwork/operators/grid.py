"""Experiment grids as relations: expansion, priority, shared stages, admission, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Disk figures of the admission rule (GB): a checkpoint, a run's records, and the margin.
CHECKPOINT_GB, RUN_GB, MARGIN = 1.2, 0.00025, 1.15
FEW = 2000


def seeds_for(size: Column, all_seeds: list[int], few: list[int]) -> Column:
    return F.when(size <= FEW, F.array(*map(F.lit, all_seeds))).otherwise(F.array(*map(F.lit, few)))


def expand(bases: DataFrame, conditions: DataFrame, reference: int, seeds: list[int], few: list[int]) -> DataFrame:
    """bases (base, base_pos, sizes), conditions (condition, cond_pos, sizes or null for all) -> the queue, numbered in priority order: reference size of every base first, then the other sizes of each base, conditions, seeds."""
    b = bases.select("base", "base_pos", F.posexplode("sizes").alias("size_pos", "size"))
    c = conditions.withColumnRenamed("sizes", "only")
    j = b.join(F.broadcast(c), F.col("only").isNull() | F.array_contains("only", F.col("size")))
    q = j.select("base", "base_pos", "size", "size_pos", "condition", "cond_pos", *[x for x in ("tokenizer", "turkish") if x in c.columns], F.posexplode(seeds_for(F.col("size"), seeds, few)).alias("seed_pos", "seed"))
    later = F.col("size") != reference
    order = Window.orderBy(later, "base_pos", F.when(later, F.col("size_pos")).otherwise(0), "cond_pos", "seed_pos")  # a plan of some hundred rows
    return q.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).drop("base_pos", "size_pos", "cond_pos", "seed_pos")


def tranche(queue: DataFrame, bases: list[str] | None = None, conditions: list[str] | None = None, sizes: list[int] | None = None, seeds: list[int] | None = None) -> DataFrame:
    """The part of the queue that all filters given let through."""
    for c, some in (("base", bases), ("condition", conditions), ("size", sizes), ("seed", seeds)):
        queue = queue.filter(F.col(c).isin(some)) if some is not None else queue
    return queue


def shared_stages(queue: DataFrame, needs: str, keys: list[str]) -> DataFrame:
    """Requests for a shared stage and the distinct stages to build."""
    n = queue.filter(F.col(needs))
    return n.agg(F.count("*").alias("requests"), F.count_distinct(*keys).alias("builds"))


def injective(queue: DataFrame, keys: list[str]) -> DataFrame:
    return queue.agg(F.count("*").alias("n"), F.count_distinct(*keys).alias("n_distinct")).withColumn("ok", F.col("n") == F.col("n_distinct"))


def remaining(queue: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return queue.join(done.select(*keys).distinct(), keys, "left_anti")


def disk_need(checkpoints: Column, n_runs: Column, streams: int, keep_best: bool) -> Column:
    return (checkpoints * CHECKPOINT_GB + n_runs * RUN_GB + (2 * streams * CHECKPOINT_GB if keep_best else 0.0)) * MARGIN


def admit(queue: DataFrame, seconds: Column, limit: float) -> DataFrame:
    """Items in order while their running estimate fits the limit; none after the first that doesn't."""
    w = Window.orderBy("pos")
    return queue.withColumn("until", F.sum(seconds).over(w)).withColumn("admitted", F.col("until") <= F.lit(float(limit)))


def stream_cap(requested: int, ceiling: float, per_stream: float) -> int:
    if per_stream > ceiling:
        raise ValueError("a single stream is over the ceiling")
    return min(requested, max(1, int(ceiling // per_stream)))


def missing_stages(required: DataFrame, built: DataFrame, keys: list[str]) -> DataFrame:
    """Required stages that a manifest lacks; it may be sealed when there are none."""
    return required.select(*keys).distinct().join(built.select(*keys), keys, "left_anti")


def projected_hours(queue: DataFrame, needs: str, keys: list[str], steps: int, stage_steps: int, seconds: float, stage_seconds: float) -> DataFrame:
    """Hours of a queue from measured seconds a step: ``steps`` of each item, and ``stage_steps`` of each distinct stage that items with ``needs`` share."""
    g = queue.agg(F.count("*").alias("runs"), F.count_distinct(F.when(F.col(needs), F.struct(*keys))).alias("stages"))
    return g.withColumn("hours", F.round((F.col("runs") * (steps * seconds) + F.col("stages") * (stage_steps * stage_seconds)) / 3600, 2))
