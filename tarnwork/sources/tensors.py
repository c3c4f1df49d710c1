"""Embedding matrices in tensor files, read and written by Spark's tasks.

A file has the length of its header (u64, little-endian), the header as JSON (name -> dtype, shape, data_offsets from the header's end; ``__metadata__`` aside), and
the tensors' bytes one after the other. ``TensorRows`` reads from the headers alone which tensor is the matrix and how many rows it has, and deals ranges of
rows to tasks; a task reads the bytes of its rows and nothing else. So neither the driver nor a task ever holds the matrix.

    spark.dataSource.register(TensorRows)
    spark.read.format("tensor_rows").option("rows", 32768).load(path)    # id long, vec array<float>
    df.select("id", "vec").write.format("tensor_rows").mode("append").save(path)

``path`` is a file, or a folder whose files end with ``.safetensors`` and have their rows' ids beside the matrix, as the writer makes them; without ids a row's place is its id.
Options: ``rows`` the first dimension that the matrix must have (of a folder: all files together; left out, any), ``key`` the tensor's name, ``batch`` the rows of a
task at most. No matrix that fits, or several of which ``preferred`` names can't tell one, is an error that lists them.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Types of numbers that are read, by their names in a header; two-byte floats with eight bits of exponent are widened by hand (fixed names).
DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4"}
FLOATS = ("F64", "F32", "F16", "BF16")
#: Parts of names that speak for an embedding table, and against it (fixed values).
WANTED, UNWANTED = ["embed"], ["classifier", "lm_head", "decoder", "predictions", "cls"]
SCHEMA = "id bigint, vec array<float>"
IDS, MATRIX, SUFFIX = "ids", "embedding.weight", ".safetensors"
#: Rows of a task and of a batch within it.
TASK_ROWS, BATCH_ROWS = 65_536, 4_096


class Tensor(NamedTuple):
    name: str
    dtype: str
    shape: tuple[int, ...]
    start: int  # from the file's beginning


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def header(store: fs.FileSystem, path: str) -> list[Tensor]:
    with store.open_input_file(path) as f:
        size = f.size()
        lead = f.read(8)
        if len(lead) < 8 or (n := struct.unpack("<Q", lead)[0]) > size - 8:
            raise ValueError(f"{path} is no tensor file")
        entries = json.loads(f.read(n))
    out = []
    for name, e in entries.items():
        if name != "__metadata__":
            a, b = e["data_offsets"]
            count = math.prod(e["shape"])
            if e["dtype"] in DTYPES and b - a != count * np.dtype(DTYPES[e["dtype"]]).itemsize or b + 8 + n > size:
                raise ValueError(f"{path}: {name} doesn't fill its place")
            out.append(Tensor(name, e["dtype"], tuple(e["shape"]), 8 + n + a))
    return out


def select(tensors: list[Tensor], rows: int | None = None, key: str | None = None, wanted: list[str] = WANTED, unwanted: list[str] = UNWANTED) -> Tensor:
    """The two-dimensional tensor of so many rows; of several the one whose name speaks for it, if it is one."""
    two = [t for t in tensors if len(t.shape) == 2]
    fit = [t for t in two if (t.name == key if key else True) and (rows is None or t.shape[0] == rows)]
    if len(fit) > 1:
        fit = [t for t in fit if any(w in t.name.lower() for w in wanted) and not any(u in t.name.lower() for u in unwanted)] or fit
    if len(fit) != 1 or fit[0].dtype not in FLOATS:
        raise ValueError(f"{len(fit)} matrices fit {rows if rows is not None else 'any number of'} rows: {[(t.name, t.dtype, t.shape) for t in (fit or two)]}")
    return fit[0]


def numbers(raw: bytes, dtype: str) -> np.ndarray:
    x = np.frombuffer(raw, DTYPES[dtype])
    return (x.astype("<u4") << 16).view("<f4") if dtype == "BF16" else x


class Rows(InputPartition):
    def __init__(self, path: str, matrix: Tensor, ids: Tensor | None, first: int, count: int, base: int) -> None:
        self.path, self.matrix, self.ids, self.first, self.count, self.base = path, matrix, ids, first, count, base


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.key = options["path"], options.get("key")
        self.rows = int(options["rows"]) if "rows" in options else None
        self.batch = int(options.get("batch", TASK_ROWS))

    def partitions(self) -> list[Rows]:
        store, path = located(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        folder = info.type == fs.FileType.Directory
        files = sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.path.endswith(SUFFIX)) if folder else [path]
        out, base = [], 0
        for file in files:
            found = header(store, file)
            matrix = select(found, None if folder else self.rows, self.key)
            ids = next((t for t in found if t.name == IDS and t.dtype == "I64" and t.shape == matrix.shape[:1]), None)
            uri = self.path.rstrip("/") + "/" + file.rsplit("/", 1)[1] if folder else self.path
            out += [Rows(uri, matrix, ids, a, min(self.batch, matrix.shape[0] - a), base + a) for a in range(0, matrix.shape[0], self.batch)]
            base += matrix.shape[0]
        if folder and self.rows is not None and base != self.rows:
            raise ValueError(f"{self.path} has {base} rows, not {self.rows}")
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition is None or not isinstance(partition, Rows):
            return
        store, path = located(partition.path)
        width, item = partition.matrix.shape[1], np.dtype(DTYPES[partition.matrix.dtype]).itemsize
        with store.open_input_file(path) as f:
            for a in range(partition.first, partition.first + partition.count, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.first + partition.count - a)
                values = numbers(f.read_at(n * width * item, partition.matrix.start + a * width * item), partition.matrix.dtype).astype("<f4")
                if partition.ids:
                    ids = numbers(f.read_at(n * 8, partition.ids.start + a * 8), "I64")
                else:
                    ids = np.arange(n, dtype=np.int64) + partition.base + a - partition.first
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(ids), vec], names=["id", "vec"])


class Written(WriterCommitMessage):
    def __init__(self, name: str | None) -> None:
        self.name = name


class _Writer(DataSourceArrowWriter):
    """A file for each task, under a name of its own; those of tasks that weren't committed are deleted."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.mark = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        ids, parts, width = [], [], None
        for batch in iterator:
            vec = batch.column(1)
            if batch.num_rows and (batch.column(0).null_count or vec.null_count):
                raise ValueError("rows without an id or a vector can't be written")
            offsets = vec.offsets.to_numpy()
            widths = np.unique(np.diff(offsets)).tolist()
            if len(widths) > 1 or width not in (None, *widths):
                raise ValueError(f"vectors of different lengths: {sorted({*widths, *([width] if width is not None else [])})}")
            width = widths[0] if widths else width
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            parts.append(vec.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype("<f4"))
        n = sum(map(len, ids))
        if not n:
            return Written(None)
        context = TaskContext.get()
        name = f"part-{self.mark}-{context.partitionId():06d}-{context.taskAttemptId()}{SUFFIX}"
        store, folder = located(self.path)
        store.create_dir(folder, recursive=True)
        lead = json.dumps({IDS: {"dtype": "I64", "shape": [n], "data_offsets": [0, 8 * n]}, MATRIX: {"dtype": "F32", "shape": [n, width], "data_offsets": [8 * n, 8 * n + 4 * n * width]}}).encode()
        lead += b" " * (-len(lead) % 8)
        with store.open_output_stream(f"{folder}/{name}") as f:
            f.write(struct.pack("<Q", len(lead)) + lead)
            for x in (*ids, *parts):
                f.write(x.tobytes())
        return Written(name)

    def _sweep(self, keep: set[str]) -> None:
        store, folder = located(self.path)
        for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.path.endswith(SUFFIX) and x.base_name not in keep and (self.overwrite and keep or self.mark in x.base_name):
                store.delete_file(x.path)

    def commit(self, messages: list[Written | None]) -> None:
        self._sweep({m.name for m in messages if m and m.name})

    def abort(self, messages: list[Written | None]) -> None:
        self.overwrite = False
        self._sweep(set())


class TensorRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensor_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)
