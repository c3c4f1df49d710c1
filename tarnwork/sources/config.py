"""Configuration: placeholders left unfilled, a lock on file contents, tables kept by their specification, and the text an evaluation reads."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import text as T


#: The value that stands where one is still to be filled in (fixed).
PLACEHOLDER = "FILL"


def unfilled(config, mark: str = PLACEHOLDER, path: str = "") -> list[str]:
    """Paths of values that are still the placeholder, at any depth; a text that merely holds it is a value."""
    if isinstance(config, dict):
        return [p for k, v in config.items() for p in unfilled(v, mark, f"{path}.{k}" if path else str(k))]
    if isinstance(config, (list, tuple)):
        return [p for i, v in enumerate(config) for p in unfilled(v, mark, f"{path}[{i}]")]
    return [path] if config == mark else []


def content_hash(raw: bytes) -> str:
    """SHA-256 with line ends as \\n, so that a checkout's line ends don't matter."""
    return hashlib.sha256(raw.replace(b"\r\n", b"\n")).hexdigest()


def verify_lock(files: dict[str, bytes], lock: dict[str, str]) -> None:
    """Raises once, with every locked file that is missing or changed. Entries of the lock that begin with an underscore are comments; files outside it are nobody's concern."""
    locked = {n: h for n, h in lock.items() if not n.startswith("_")}
    wrong = [f"{n}: missing" if n not in files else f"{n}: changed" for n, h in locked.items() if n not in files or content_hash(files[n]) != h]
    if wrong:
        raise ValueError("; ".join(sorted(wrong)))


def load_config(path: str) -> dict:
    """A YAML file without places left to fill; every one that is left is named."""
    import yaml

    with open(path, encoding="utf-8") as f:
        config = yaml.safe_load(f) or {}
    left = unfilled(config)
    if left:
        raise ValueError(f"to be filled in: {', '.join(left)}")
    return config


def content_key(spec: dict) -> str:
    """16 hexadecimal digits for a specification, whatever its keys' order."""
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def cached(spark: SparkSession, root: str, spec: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of ``build``, kept below ``root`` by its specification; a table whose stored specification is another is an error.

    It is written beside and then renamed, so a half-written one is never read; of two writers the first wins.
    """
    path = f"{root}/{content_key(spec)}"
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    text = json.dumps(spec, sort_keys=True)
    if not fs.exists(jvm.Path(path)):
        part = f"{path}.part-{uuid.uuid4().hex}"
        build().write.parquet(f"{part}/data")
        spark.createDataFrame([(text,)], "value string").write.text(f"{part}/spec")
        if not fs.exists(jvm.Path(path)):
            fs.rename(jvm.Path(part), jvm.Path(path))
        else:
            fs.delete(jvm.Path(part), True)
    if spark.read.text(f"{path}/spec").first()[0] != text:
        raise ValueError(f"{path} holds another specification")
    return spark.read.parquet(f"{path}/data")


def text_or(path: str | None, fallback: str) -> str:
    """A file's text if there is one, else the text given."""
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return f.read()
    return fallback


def resolve_eval_text(spark: SparkSession, path: str | None, train: DataFrame | None, builtin: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines to measure on (line, text, provenance): a file's, else a seeded sample of training texts, else the text built in."""
    if path and os.path.exists(path):
        return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"), F.lit(f"file {path}").alias("provenance")).filter(F.trim("text") != "")
    if train is not None and not train.isEmpty():
        return eval_text(train, key, text).select(F.col(key).cast("long").alias("line"), F.col(text).alias("text"), "provenance")
    return spark.createDataFrame([(i, t, "built in") for i, t in enumerate(builtin.strip().splitlines())], "line long, text string, provenance string")


def eval_text(train: DataFrame, key: str, text: str = "text", n: int = 300, least: int = 40, seed: str = "17") -> DataFrame:
    """n training texts of ``least`` characters or more in seeded order (a sample is what this is), with where they come from."""
    fit = train.filter(F.char_length(text) >= least)
    return fit.orderBy(T.seeded(seed, F.col(key)), key).limit(n).select(key, text, F.lit(f"train sample, seed {seed}").alias("provenance"))
