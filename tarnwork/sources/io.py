"""Sources and sinks: JSON lines, CSV with detected encoding or byte-order mark, JSON documents, run records, logs, ledgers."""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import json
import math
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.functions import text as T

#: Tried in this order; the last one reads any bytes (fixed values).
ENCODINGS = ["utf-8-sig", "utf-8", "cp1254", "cp1252", "latin-1"]
#: Version of run records that is read; others are counted and left out.
RUN_VERSION = 4
#: A run record as it is written (fixed names).
RUN_DDL = """run_result_schema_version int, n_labels int, base string, base_role string, condition string, condition_id long, tokenizer string, turkish string, train_size long, seed long,
escaped boolean, escape_step long, selected_step long, selected_validation_macro_f1 double, terminal_step long, terminal_validation_macro_f1 double, escaped_but_terminal_collapsed boolean, eval_split string,
per_run_verdict string, max_steps long, completed_steps long, steps_per_epoch long, effective_epochs double, runtime_sec double, tr_stage_macro_f1 double, tr_stage_degenerate boolean,
test_comparison struct<eval_split:string,selection:string,matched_step:long,validation_macro_f1_matched:double,restored_validation_macro_f1:double,test_macro_f1:double,delta_test_minus_validation_matched:double>,
step_history array<struct<step:long,epoch:double,eval_loss:double,eval_macro_f1:double,train_loss:double,validation_prediction_counts:map<string,double>>>"""
#: Columns of a flattened record, in this order (fixed names); source_path comes after them.
RUN_COLUMNS = [
    "base", "base_role", "condition", "condition_id", "tokenizer", "turkish", "train_size", "seed", "escaped", "escape_step", "selected_step", "selected_validation_macro_f1",
    "terminal_step", "terminal_validation_macro_f1", "escaped_but_terminal_collapsed", "eval_split", "test_macro_f1", "tr_stage_macro_f1", "tr_stage_degenerate",
    "delta_test_minus_validation_matched", "max_steps", "steps_per_epoch", "effective_epochs", "runtime_sec",
]


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped, order is not kept."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def load_records(spark: SparkSession, path: str, kind: str, text: str, label: str, names: list[str] | None = None) -> DataFrame:
    """text, label of a CSV, JSON-lines or Parquet source; a missing column is an error that lists those there are. ``names`` maps integer labels."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path) if kind == "csv" else spark.read.parquet(path) if kind == "parquet" else spark.read.json(path)
    missing = [c for c in (text, label) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    value = F.col(label)
    if names:
        value = F.get(F.array(*map(F.lit, names)), value.cast("int"))
    return df.select(F.col(text).alias("text"), value.cast("string").alias("label"))


def decode_csv(raw: bytes) -> tuple[list[dict], str]:
    """Rows of a small CSV file and the encoding that fits."""
    for name in ENCODINGS:
        try:
            return list(csv.DictReader(io.StringIO(raw.decode(name)))), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("the last encoding reads any bytes")


def read_csv_folder(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all files of a folder: path, encoding (the first of ENCODINGS that fits the whole file), row (its place, from 0), values (by column).

    Each file is decoded strictly, by one task, so only its size bounds it; a row with fewer fields than the header has nulls, further fields are left out.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, encoding = decode_csv(raw.as_py())
                values = [[(k, v) for k, v in r.items() if k is not None] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([encoding] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), pa.array(values, pa.map_(pa.string(), pa.string()))], names=["path", "encoding", "row", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, encoding string, row long, values map<string,string>")


def write_csv_bom(df: DataFrame, path: str, columns: list[str]) -> None:
    """A small report as CSV with a byte-order mark, columns in this order, nulls empty; streamed, not collected."""
    with open(path, "wb") as raw:
        raw.write(codecs.BOM_UTF8)
        out = io.TextIOWrapper(raw, "utf-8", newline="")
        w = csv.writer(out)
        w.writerow(columns)
        for r in df.select(*columns).toLocalIterator():
            w.writerow(["" if v is None else v for v in r])
        out.flush()


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clean_json(value) -> tuple[object, int]:
    """The value with non-finite numbers nulled, and how many there were."""
    if isinstance(value, float) and not math.isfinite(value):
        return None, 1
    if isinstance(value, dict):
        parts = {k: clean_json(v) for k, v in value.items()}
        return {k: v for k, (v, _) in parts.items()}, sum(n for _, n in parts.values())
    if isinstance(value, (list, tuple)):
        items = [clean_json(v) for v in value]
        return [v for v, _ in items], sum(n for _, n in items)
    return value, 0


def write_json(value: dict, path: str) -> None:
    """A report in one atomic step; non-finite numbers become null and are counted."""
    value, n = clean_json(value)
    if n:
        value = {**value, "n_nonfinite_values_nulled": n}
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Each file of a folder as one record: value (its text) and source_path."""
    return spark.read.text(path, wholetext=True).withColumn("source_path", F.col("_metadata.file_path"))


def parse_runs(raw: DataFrame) -> DataFrame:
    """``raw`` (value, and whatever is beside it) with the record as struct r; a record without a version has version 0."""
    return raw.withColumn("r", F.from_json("value", RUN_DDL)).withColumn("version", F.coalesce("r.run_result_schema_version", F.lit(0)))


def flatten_runs(parsed: DataFrame) -> DataFrame:
    """RUN_COLUMNS and source_path of the records of the version that is read; others are never pooled with them."""
    nested = {"test_macro_f1": "r.test_comparison.test_macro_f1", "delta_test_minus_validation_matched": "r.test_comparison.delta_test_minus_validation_matched"}
    cols = [F.coalesce("r.base_role", F.lit("unknown")).alias(c) if c == "base_role" else F.col(nested.get(c, f"r.{c}")).alias(c) for c in RUN_COLUMNS]
    return parsed.filter(F.col("version") == RUN_VERSION).select(*cols, "source_path")


def skipped_runs(parsed: DataFrame) -> DataFrame:
    """How many records there are of each other version."""
    return parsed.filter(F.col("version") != RUN_VERSION).groupBy("version").agg(F.count("*").alias("n"))


def scan_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The flattened records of the version that is read, and the number of records of each other version."""
    parsed = parse_runs(read_runs(spark, path))
    return flatten_runs(parsed), skipped_runs(parsed)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


#: A line of a run's log: time, level, logger and message between bars; STEP and STAGE messages and the note on the restored state (fixed forms).
LOG_LINE = r"^(\d\d:\d\d:\d\d) \| (\w+)\s*\| ([\w.]+) \| (.*)$"
STEP_LINE = r"^STEP step=(\d+) loss=(\S+) dt_sec=([\d.]+) cum_wall_sec=([\d.]+)$"
STAGE_LINE = r"^STAGE=(\w+) (\S+)"
RESTORED_LINE = r"^Best checkpoint restored and verified: step (\d+), val macro-F1 = ([\d.]+)"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a folder of logs, with the run that a file's name tells (base, condition, train_size, seed, started) and each line's place in its file (block, line)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    part = lambda pattern: F.nullif(F.regexp_extract("file", pattern, 1), F.lit(""))
    return lines.select("file", part(r"^base=(.+?)__").alias("base"), part(r"__cond=(.+?)__").alias("condition"), part(r"__n=(\d+)__").cast("long").alias("train_size"), part(r"__seed=(\d+)__").cast("long").alias("seed"), part(r"__([0-9TZ]+)\.log$").alias("started"), "block", "line", "value")


def parse_log(lines: DataFrame) -> DataFrame:
    """Lines (value, and whatever is beside it) with time, level, logger, kind (step, stage, restored, other; null if it is no log line) and what the message says:
    step, loss, dt_sec, cum_wall_sec of a step; stage and event (start, end, cache_hit=...) of a stage, with runtime_sec; step and score of the restored state."""
    at = lambda c, pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    m = F.col("message")
    d = lines.withColumns({c: at(F.col("value"), LOG_LINE, i + 1) for i, c in enumerate(("time", "level", "logger", "message"))})
    step, stage, restored = (m.rlike(p) for p in (STEP_LINE, STAGE_LINE, RESTORED_LINE))
    d = d.withColumn("kind", F.when(m.isNull(), None).when(step, "step").when(stage, "stage").when(restored, "restored").otherwise("other"))
    # a loss may be nan: then it is null, as in a report
    return d.withColumns({
        "step": F.coalesce(at(m, STEP_LINE, 1), at(m, RESTORED_LINE, 1)).cast("long"), "loss": finite(at(m, STEP_LINE, 2).try_cast("double")), "dt_sec": at(m, STEP_LINE, 3).cast("double"), "cum_wall_sec": at(m, STEP_LINE, 4).cast("double"),
        "stage": at(m, STAGE_LINE, 1), "event": at(m, STAGE_LINE, 2), "runtime_sec": at(m, r"^STAGE=.* runtime_sec=([\d.]+)", 1).cast("double"), "score": at(m, RESTORED_LINE, 2).cast("double"),
    }).drop("message", "value")


def markdown(df: DataFrame, columns: list[str]) -> str:
    """A small report table as Markdown; nulls as a dash."""
    rows = [columns, ["---"] * len(columns)] + [["–" if v is None else str(v) for v in r] for r in df.select(*columns).toLocalIterator()]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def line_file(spark: SparkSession, path: str, n: int, least_words: int = 5) -> DataFrame:
    """The first n lines of a text file with ``least_words`` words or more, with their place (a limit that callers ask for)."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    return lines.filter(F.size(T.split_words(F.col("value"))) >= least_words).orderBy("line").limit(n).select("line", F.col("value").alias("text"))


def parallel_texts(spark: SparkSession, places: dict[str, list[str]], n: int) -> DataFrame:
    """The same n sentences in several languages (lang, sent_id, text): of each language the first Parquet table that can be read; its column ``sentence``, else ``text``, else its first."""
    out = None
    for lang, paths in places.items():
        table = None
        for path in paths:
            try:
                table = spark.read.parquet(path)
                break
            except AnalysisException:
                continue
        if table is None:
            raise ValueError(f"no table of {lang} can be read: {paths}")
        column = next((c for c in ("sentence", "text") if c in table.columns), table.columns[0])
        rows = table.select(F.monotonically_increasing_id().alias("m"), F.col(column).cast("string").alias("text")).orderBy("m").limit(n)
        rows = rows.select(F.lit(lang).alias("lang"), (F.row_number().over(Window.orderBy("m")) - 1).cast("long").alias("sent_id"), "text")  # n rows
        out = rows if out is None else out.unionByName(rows)
    return out


def write_markdown(df: DataFrame, columns: list[str], path: str, sources: list[str]) -> None:
    """A report table, and beside it (``.sources.json``) the files that it was made from with their hashes."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(markdown(df, columns))
    hashes = {}
    for s in sources:
        with open(s, "rb") as f:
            hashes[s] = hashlib.sha256(f.read()).hexdigest()
    write_json({"report": os.path.basename(path), "columns": columns, "sources": hashes}, f"{path}.sources.json")


def pick_tensor(entries: DataFrame, rows: int, words: list[str]) -> DataFrame:
    """(key, shape) -> the two-dimensional entry with that first dimension; several: the one whose key holds a word, if it is one."""
    fit = entries.filter((F.size("shape") == 2) & (F.get("shape", F.lit(0)) == rows))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains("key", F.lit(w))
    r = fit.withColumn("hit", hit).agg(F.collect_list("key").alias("all"), F.collect_list(F.when(F.col("hit"), F.col("key"))).alias("some"))
    one = F.when(F.size("all") == 1, F.get("all", F.lit(0))).when(F.size("some") == 1, F.get("some", F.lit(0)))
    return r.select(F.coalesce(one, F.raise_error(F.concat(F.lit("no single entry fits; candidates: "), F.array_join("all", ","))).cast("string")).alias("key"))
