"""Best-fit packing of token sequences by hierarchical residual packing.

A document longer than the capacity is cut from its end into pieces of the full capacity; what remains
is its first piece. Full pieces are sequences of their own. The others are dealt evenly to groups of
bounded size, each packed best-fit in decreasing order. Bins that are nearly full are done; the rest go
up a tree, several groups to one, as items of their filled size, and are packed best-fit again, until
one group is left. A bin never opens again, so an offset in a sequence is the sum of the offsets along the tree.

Best fit leaves at most one bin of a group half full or less, and two that are fuller can't merge. So of FAN_IN
groups that meet, at most FAN_IN bins can go into others, and no more than FAN_IN bins of each filled size can
take one in: no others go up the tree, and a task has at most FAN_IN * FAN_IN * capacity items, whatever the input.

Groups are dealt by a hash of the row's place, so rows that repeat an id spread as well. Null texts are
empty: one piece with the end id. Repeated rows are packed each. No rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import bpe, common

CAPACITY = 1024
END_ID = 2
#: Items that one group packs.
GROUP_ITEMS = 50_000
#: A bin with at most this much room is nearly full.
NEARLY = 64
#: Groups that go into one in the next round.
FAN_IN = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document."""
    common.small_batches(docs.sparkSession)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = bpe.encoder(tokenizer or bpe.default_path()), 0
        for batch in parts:
            cols: list[list] = [[] for _ in range(5)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.each(batch.column(1))):
                raw = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                n, at = len(ids) + 1, 0
                for k in range(-(-n // capacity)):
                    size = capacity if k else n - (n - 1) // capacity * capacity
                    for c, v in zip(cols, (doc_id, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)]))):
                        c.append(v)
                    at += size
            place = np.arange(seen, seen + len(cols[0]), dtype=np.int64)
            seen += len(place)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), pa.array(place)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Largest first, each into the fullest bin with room for it; ties go to the bin that opened last."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        with_room[room - s].append(b)
        mask |= 1 << (room - s)
    return bins, offsets


def _pack_group(keys: list[str], capacity: int, level: int, nearly: int, fan_in: int):
    """For one group: adds bin (level, group and number), offset and whether the bin goes up to its rows, in an order that doesn't depend on how they came."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys])
        bins, offsets = best_fit(table["length"].to_numpy(), capacity)
        group = table["grp"][0].as_py()
        filled = np.bincount(bins, table["length"].to_numpy()).astype(np.int64)
        order = np.argsort(filled, kind="stable")
        rank = np.empty(len(filled), np.int64)  # among the bins filled alike
        rank[order] = np.arange(len(filled)) - np.searchsorted(filled[order], filled[order])
        table = table.append_column("goes_up", pa.array(((filled < capacity - nearly) & (rank < fan_in))[bins]))
        return table.append_column("bin", pa.array(((level * (1 << 24) + group) << 32) + bins)).append_column("bin_offset", pa.array(offsets))

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, nearly: int = NEARLY, fan_in: int = FAN_IN) -> DataFrame:
    """``items`` (of ``pieces``) with sequence_id and offset instead of deal."""
    spark, keep = items.sparkSession, ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = common.materialise(items, "pieces")
    full = items.filter(F.col("length") == capacity).select(*keep)
    rest = items.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_items))
    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "deal"), F.lit(groups)))
    first = dealt.groupBy("grp").applyInArrow(_pack_group(["doc_id", "piece", "ids_crc32", "deal"], capacity, 0, nearly, fan_in), f"{PIECES}, grp long, goes_up boolean, bin long, bin_offset long")
    first = common.materialise(first, "packed")
    filled = lambda df: df.filter("goes_up").groupBy("bin", "grp").agg(F.sum("length").alias("length"))
    open_bins = common.materialise(filled(first), "open")
    moved = None  # bin of the first round -> sequence, offset
    level = 1
    while True:
        groups = -(-groups // fan_in)
        up = open_bins.select("bin", "length", F.floor(F.col("grp") / fan_in).cast("long").alias("grp"))
        up = up.withColumnRenamed("bin", "item").groupBy("grp").applyInArrow(_pack_group(["item"], capacity, level, nearly, fan_in), "item long, length long, grp long, goes_up boolean, bin long, bin_offset long")
        up = common.materialise(up, "packed")
        common.release(open_bins)
        step = up.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("bin_offset").alias("by"))
        if moved is None:
            moved = step.select("bin", F.col("to").alias("seq"), F.col("by").alias("shift"))
        else:
            s = step.withColumnRenamed("bin", "seq")
            moved = moved.join(s, "seq", "left").select("bin", F.coalesce("to", "seq").alias("seq"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
        if groups == 1:
            break
        open_bins = common.materialise(filled(up), "open")
        level += 1
    # every full piece stands alone, numbered below zero by its place
    alone = full.select(*keep, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = first.join(moved, "bin", "left").select(*keep, F.coalesce("seq", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return placed.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(common.table(spark, sf_dir, "documents")))
