"""Tensor files as a data source: choice from the headers, ranges of rows, round trips."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.sources import tensors


def tensor_file(path, entries):
    """A file of (name, dtype, array) as the format has it."""
    lead, data, at = {"__metadata__": {"format": "pt"}}, b"", 0
    for name, dtype, x in entries:
        raw = x.tobytes()
        lead[name] = {"dtype": dtype, "shape": list(x.shape), "data_offsets": [at, at + len(raw)]}
        data, at = data + raw, at + len(raw)
    lead = json.dumps(lead).encode()
    path.write_bytes(struct.pack("<Q", len(lead)) + lead + data)


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(tensors.TensorRows)
    return spark


def read(spark, path, **options):
    return spark.read.format("tensor_rows").options(**{k: str(v) for k, v in options.items()}).load(str(path))


@pytest.mark.parametrize("dtype", ["F64", "F32", "F16", "BF16"])
def test_rows_of_each_type(source, tmp_path, dtype):
    x = np.random.default_rng(1).normal(size=(23, 5))
    if dtype == "BF16":
        stored = (x.astype("<f4").view("<u4") >> 16).astype("<u2")
        want = (stored.astype("<u4") << 16).view("<f4")
    else:
        stored = x.astype(tensors.DTYPES[dtype])
        want = stored.astype("<f4")
    tensor_file(tmp_path / "m.safetensors", [("other", "F32", np.zeros((3, 5), "<f4")), ("model.embed_tokens.weight", dtype, stored), ("bias", "F32", np.zeros(23, "<f4"))])
    df = read(source, tmp_path / "m.safetensors", rows=23, batch=4)
    assert df.rdd.getNumPartitions() == 6 and df.dtypes == [("id", "bigint"), ("vec", "array<float>")]
    got = {r["id"]: r["vec"] for r in df.collect()}
    assert sorted(got) == list(range(23)) and np.array_equal(np.array([got[i] for i in range(23)], "<f4"), want)
    assert read(source, f"file://{tmp_path}/m.safetensors", rows=23).filter("id = 7").count() == 1


def test_choice(tmp_path):
    t = lambda name, shape=(9, 2), dtype="F32": tensors.Tensor(name, dtype, shape, 0)
    assert tensors.select([t("a"), t("b", (8, 2)), t("c", (9,))], 9).name == "a"
    assert tensors.select([t("lm_head.weight"), t("Embeddings.word")], 9).name == "Embeddings.word"
    assert tensors.select([t("a"), t("b")], 9, key="b").name == "b"
    for tensors_, rows in (([t("a")], 8), ([t("a"), t("b")], 9), ([t("embed.a"), t("embed.b")], 9), ([t("embed.decoder"), t("cls.embed")], 9), ([], None), ([t("a", dtype="I64")], 9)):
        with pytest.raises(ValueError):
            tensors.select(tensors_, rows)


def test_refusals(source, tmp_path):
    (tmp_path / "no.safetensors").write_bytes(b"\xff" * 20)
    tensor_file(tmp_path / "two.safetensors", [(n, "F32", np.zeros((4, 2), "<f4")) for n in "ab"])
    lead = json.dumps({"a": {"dtype": "F32", "shape": [9, 9], "data_offsets": [0, 4]}}).encode()
    (tmp_path / "short.safetensors").write_bytes(struct.pack("<Q", len(lead)) + lead + b"1234")
    for name, what in (("no", "no tensor file"), ("two", "2 matrices fit"), ("short", "fill its place"), ("missing", "missing")):
        with pytest.raises(Exception, match=what):
            read(source, tmp_path / f"{name}.safetensors").collect()


def test_round_trip(source, tmp_path):
    df = source.range(1000).select((F.col("id") * 7 - 50).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("id") * 0.25 + i).cast("float")).alias("vec"))
    out = f"file://{tmp_path}/folder"
    df.repartition(3).write.format("tensor_rows").mode("append").save(out)
    back = read(source, out, batch=100)
    assert back.count() == 1000 and back.exceptAll(df).count() == 0 and back.rdd.getNumPartitions() >= 10
    assert read(source, out, rows=1000).count() == 1000
    with pytest.raises(Exception, match="has 1000 rows"):
        read(source, out, rows=999).collect()
    df.limit(5).write.format("tensor_rows").mode("overwrite").save(out)
    assert read(source, out).count() == 5
    for bad in ("cast(null AS array<float>)", "CASE WHEN id = 6 THEN array(cast(1 AS float)) ELSE vec END"):
        with pytest.raises(Exception):
            df.withColumn("vec", F.expr(bad)).coalesce(1).write.format("tensor_rows").mode("append").save(out)
    assert read(source, out).count() == 5
