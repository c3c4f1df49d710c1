"""Token-ID output as length-delimited binary records with a separate offset index.

A record is: payload length (u64), masked CRC-32 of those eight bytes (u32), payload, masked CRC-32
of the payload (u32); all little-endian. A payload is: document id (i64), number of ids (u32), bytes
for each id (u8: 2 or 4, with the highest bit set if the document has no id), then the ids, compressed with zstd. The mask rotates the sum right by 15
bits and adds 0xA282EAD8, so that a sum stored inside summed bytes does not upset the sum.

Documents are dealt to shards by ranges of their id and written in ascending order, so the shards one
after the other hold the corpus in id order. A task writes its shard under a name of its own and the
index (a Parquet table: shard, doc_id, offset, length, n_tokens) names only the files of the attempts
that Spark committed; files of repeated or lost attempts are deleted in the end. Null texts are empty and hold
just the end id; repeated ids are kept, in any order among themselves; documents without an id come first and are read back without one; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import bpe, common

#: Fixed values of the record format.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
LEAD = struct.Struct("<qIB")
NO_ID = 0x80

END_ID = 2
#: Bytes of text for a shard, about; small inputs have as many shards as shuffles have partitions.
SHARD_BYTES = 64 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(stream) -> Iterator[bytes]:
    """Payloads of a file object; raises ValueError where a length, checksum or end does not hold."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("record file ends within a header")
        size, check = HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError("record length fails its checksum")
        body = stream.read(size + 4)
        if len(body) != size + 4 or masked(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("record payload fails its checksum")
        yield body[:-4]


def pack(doc_id: int | None, ids: np.ndarray, codec) -> bytes:
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return LEAD.pack(doc_id or 0, len(ids), wide | (NO_ID if doc_id is None else 0)) + codec.compress(ids.astype("<u2" if wide == 2 else "<u4").tobytes())


def unpack(payload: bytes, codec) -> tuple[int | None, np.ndarray]:
    doc_id, n, kind = LEAD.unpack_from(payload)
    wide = kind & ~NO_ID
    raw = codec.decompress(payload[LEAD.size :], max_output_size=n * wide) if n else b""
    return None if kind & NO_ID else doc_id, np.frombuffer(raw, "<u2" if wide == 2 else "<u4").astype("<u4")


def open_output(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store, path


INDEX = "shard string, doc_id long, offset long, length long, n_tokens long"


def write(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``out/data/*.rec`` and the index ``out/index``; returns the index, read back."""
    spark = docs.sparkSession
    common.small_batches(spark)
    if not shards:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        shards = max(common.shuffle_width(spark), -(-size // SHARD_BYTES))
    given = tokenizer

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, codec = bpe.encoder(given or bpe.default_path()), zstandard.ZstdCompressor(level=1)
        store, path = open_output(f"{out}/data")
        store.create_dir(path, recursive=True)
        name, stream, at = f"{uuid.uuid4().hex}.rec", None, 0
        for batch in parts:
            rows: list[tuple[int, int, int, int]] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.each(batch.column(1))):
                stream = stream or store.open_output_stream(f"{path}/{name}")
                record = frame(pack(doc_id, np.append(ids, np.uint32(end_id)), codec))
                stream.write(record)
                rows.append((doc_id, at, len(record), len(ids) + 1))
                at += len(record)
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["shard", "doc_id", "offset", "length", "n_tokens"])
        if stream:
            stream.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(encode, INDEX).write.parquet(f"{out}/index")
    index = spark.read.schema(INDEX).parquet(f"{out}/index")
    sweep(index, out)
    return index


def sweep(index: DataFrame, out: str) -> None:
    """Deletes the files of attempts that weren't committed; only their names come to the driver."""
    spark = index.sparkSession
    data = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/data")
    store = data.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(data):
        found = [(x.getPath().getName(),) for x in store.listStatus(data)]  # one for each shard, and strays
        strays = spark.createDataFrame(found, "shard string").filter(F.col("shard").endswith(".rec")).join(index.select("shard").distinct(), "shard", "left_anti").collect() if found else []
        for x in strays:
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/data/{x['shard']}"), False)


def read(spark: SparkSession, out: str) -> DataFrame:
    """Every record of the shards that the index names: doc_id, start, n_tokens, ids_crc32 in id order, each checked against both its sums and the index."""
    index = spark.read.schema(INDEX).parquet(f"{out}/index")
    files = index.groupBy("shard").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "offset")).alias("k"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("records"), F.sum("length").alias("bytes"))
    # one row for each shard: ordering them is the only step on one task
    from pyspark.sql import Window

    before = F.sum("tokens").over(Window.orderBy("first", "shard").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("shard", F.coalesce(before, F.lit(0)).alias("base"), "records", "bytes").repartition(common.shuffle_width(spark), "shard")

    def decode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = zstandard.ZstdDecompressor()
        store, path = open_output(f"{out}/data")
        for batch in parts:
            for shard, base, records, size in zip(*(c.to_pylist() for c in batch.columns)):
                rows, start = [], base
                with store.open_input_stream(f"{path}/{shard}") as stream:
                    for payload in unframe(stream):
                        doc_id, ids = unpack(payload, codec)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _table(rows)
                            records -= len(rows)
                            rows = []
                if records != len(rows):
                    raise ValueError(f"{shard} has another number of records than the index")
                yield _table(rows)

    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def seek(out: str, shard: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its index entry, as a shuffled reader gets it."""
    import zstandard

    store, path = open_output(f"{out}/data")
    with store.open_input_file(f"{path}/{shard}") as f:
        f.seek(offset)
        return unpack(next(unframe(f)), zstandard.ZstdDecompressor())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.scratch(spark, "records")
    write(common.table(spark, sf_dir, "documents"), out)
    return read(spark, out)
