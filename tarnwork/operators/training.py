"""Training runs in steps on the cluster, with all that a run record asks for.

The model is a small one: a text is the sum of the vectors of its distinct hashed words, scaled by their number's root (the encoder), a linear head gives the classes. It goes
through the stages of a run: an optional source stage on other labelled texts whose end state is carried over, a new head, the target stage with an evaluation
every few steps, the best step's state chosen on validation rows, proven by scoring it again, and scored once on test rows.

The batch of a step are the rows of one bucket of a seeded deal, which lie together in a folder of a written table, so a step reads only them, whatever the table's size. A large batch is
a job: its gradient is summed up a tree, and the driver takes the step. Batches that fit a task are taken some after each other, CHAIN_ROWS rows at most, by one task: it gets the parameters, and gives them back
after the last of its steps; the next ones are another task's. The driver holds the parameters (some megabytes, whatever the data's size). A source stage's end state is written to the shared folder under the
digest of all that it depends on, and read from there by other runs. Everything random comes from seeds and hashes of keys, nothing from the rows' places.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tarnwork.functions import tables
from tarnwork.functions import text as T
from tarnwork.operators import learn, prep
from tarnwork.operators.runs import ESCAPE, SELECTIONS

#: Slots of the hashed words, rows of a batch that a task reads, about, and rows of all the steps that a task takes.
SLOTS, TASK_ROWS, CHAIN_ROWS = 1 << 14, 1024, 4096
VERSION = 4


class Settings(NamedTuple):
    """Of a stage: rows of a batch, steps of the target stage, steps between evaluations, passes of the source stage, learning rate, part of the steps over which it rises, weight decay."""

    batch: int = 4096
    max_steps: int = 20
    eval_every: int = 5
    epochs: int = 3
    rate: float = 0.05
    warmup: float = 0.1
    decay: float = 0.01
    select_best: bool = True


class Shape(NamedTuple):
    """Of the parameters: width of the encoder's vectors, classes."""

    width: int
    classes: int

    @property
    def encoder(self) -> int:
        return SLOTS * self.width

    @property
    def size(self) -> int:
        return self.encoder + (self.width + 1) * self.classes


def _random(what: str, n: int, scale: float) -> np.ndarray:
    return np.random.default_rng(int(hashlib.sha256(what.encode()).hexdigest()[:16], 16)).normal(0, scale, n)


def base_model(name: str, shape: Shape) -> np.ndarray:
    """The state that all runs of a base begin with; its head is not used."""
    return np.concatenate([_random(f"base:{name}", shape.encoder, 0.3), np.zeros(shape.size - shape.encoder)])


def with_new_head(state: np.ndarray, width: int, classes: int, seed: int) -> np.ndarray:
    """The encoder as it is, the whole head anew: small random weights, no offsets."""
    return np.concatenate([state[: SLOTS * width], _random(f"head:{seed}:{classes}", width * classes, 0.02), np.zeros(classes)])


def chained(batch: int) -> int:
    """Steps that one task takes; their buckets are a part of the table."""
    return CHAIN_ROWS // batch if batch <= TASK_ROWS else 1


def features(df: DataFrame, key: str, seed: int, batch: int) -> tuple[DataFrame, int]:
    """key, text, label (codes 0, 1, ...) -> a written table of bucket, y, idx, val, and part, which has a folder for each ``chained`` buckets, and the number of buckets: one for each ``batch`` rows, dealt by a seeded hash."""
    n = df.count()
    buckets = max(1, math.ceil(n / batch))
    slots = F.transform(T.words(F.lower(F.coalesce("text", F.lit("")))), lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))
    rows = df.select(F.pmod(F.xxhash64(F.lit(f"batch:{seed}"), F.col(key)), F.lit(buckets)).cast("int").alias("bucket"), F.col("label").cast("int").alias("y"), F.array_sort(F.array_distinct(slots)).alias("idx"))
    rows = rows.withColumn("val", F.transform("idx", lambda _: 1.0 / F.sqrt(F.size("idx").cast("double"))))
    rows = rows.withColumn("part", F.floor(F.col("bucket") / chained(batch)).cast("int"))
    pieces = F.pmod(F.xxhash64("idx"), F.lit(math.ceil(batch / TASK_ROWS)))  # of a batch that is too large for a task
    return tables.written(rows.repartition(max(1, math.ceil(n / CHAIN_ROWS)), "part", pieces).sortWithinPartitions("part", "bucket"), "batches", "part"), buckets


def _forward(state: np.ndarray, shape: Shape, idx: np.ndarray, val: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the texts, the head, and the classes' probabilities."""
    encoder = state[: shape.encoder].reshape(SLOTS, shape.width)
    head, offset = state[shape.encoder : shape.size - shape.classes].reshape(shape.width, shape.classes), state[shape.size - shape.classes :]
    vec = np.stack([np.bincount(row, encoder[idx, k] * val, rows) for k in range(shape.width)], axis=1)
    z = vec @ head + offset
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return vec, head, e / e.sum(axis=1, keepdims=True)


def _columns(batch: pa.RecordBatch) -> tuple:
    y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64)
    (idx, n), (val, _) = learn._flat(batch.column("idx"), np.int64), learn._flat(batch.column("val"), np.float64)
    return y, idx, val, np.repeat(np.arange(len(y)), n)


def _add_gradient(sums: np.ndarray, state: np.ndarray, shape: Shape, y: np.ndarray, idx: np.ndarray, val: np.ndarray, row: np.ndarray) -> None:
    """To sums of rows: their number, their loss, the gradient."""
    encoder = sums[2 : 2 + shape.encoder].reshape(SLOTS, shape.width)
    head = sums[2 + shape.encoder : 2 + shape.size - shape.classes].reshape(shape.width, shape.classes)
    vec, weights, p = _forward(state, shape, idx, val, row, len(y))
    sums[0] += len(y)
    sums[1] -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    p[np.arange(len(y)), y] -= 1
    head += vec.T @ p
    sums[2 + shape.size - shape.classes :] += p.sum(axis=0)
    back = p @ weights.T
    for k in range(shape.width):
        encoder[:, k] += np.bincount(idx, back[row, k] * val, SLOTS)


def _gradient(shape: Shape, sent):
    """Sums of a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 + shape.size)
        for batch in batches:
            _add_gradient(sums, sent.value, shape, *_columns(batch))
        yield from learn.blocks_of(sums)

    return run


def _stepped(state: np.ndarray, m: np.ndarray, v: np.ndarray, sums: np.ndarray, t: int, steps: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State and moments after step t of Adam with decay, the rate rising, then falling to nothing."""
    rise = max(1, math.ceil(steps * settings.warmup))
    g = sums[2:] / max(sums[0], 1)
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    rate = settings.rate * (t / rise if t <= rise else max(0.0, (steps - t + 1) / (steps - rise + 1)))
    return state - rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + settings.decay * state), m, v


def _chain(shape: Shape, sent, first: int, last: int, steps: int, buckets: int, settings: Settings):
    """Steps first to last on rows sorted by bucket: state and moments after them, then the last step's number of rows and loss. A bucket without rows is a step, too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, t, sums = tuple(sent.value), first, np.zeros(2 + shape.size)
        for batch in batches:
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                while (t - 1) % buckets < bucket[a]:
                    now, t, sums = _stepped(*now, sums, t, steps, settings), t + 1, np.zeros(2 + shape.size)
                _add_gradient(sums, now[0], shape, *_columns(batch.slice(a, b - a)))
        while t < last:
            now, t, sums = _stepped(*now, sums, t, steps, settings), t + 1, np.zeros(2 + shape.size)
        yield from learn.blocks_of(np.concatenate([*_stepped(*now, sums, t, steps, settings), sums[:2]]))

    return run


def _score(shape: Shape, sent):
    """Sums of a task's rows: their loss, and how many of class g are taken for class p."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + shape.classes**2)
        for batch in batches:
            y, idx, val, row = _columns(batch)
            p = _forward(sent.value, shape, idx, val, row, len(y))[2]
            sums[0] -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
            sums[1:] += np.bincount(y * shape.classes + p.argmax(axis=1), minlength=shape.classes**2)
        yield from learn.blocks_of(sums)

    return run


def _sums(rows: DataFrame, kernel, state: np.ndarray, shape: Shape, n: int) -> np.ndarray:
    sent = rows.sparkSession.sparkContext.broadcast(state)
    out = learn.tree_sum(rows.select("y", "idx", "val").mapInArrow(kernel(shape, sent), learn.SUMS), rows.rdd.getNumPartitions(), n)
    sent.destroy()
    return out


def _chain_of(rows: DataFrame, state: np.ndarray, m: np.ndarray, v: np.ndarray, shape: Shape, first: int, last: int, steps: int, buckets: int, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sent = rows.sparkSession.sparkContext.broadcast((state, m, v))
    one = rows.select("bucket", "y", "idx", "val").coalesce(1).sortWithinPartitions("bucket")
    out = learn.tree_sum(one.mapInArrow(_chain(shape, sent, first, last, steps, buckets, settings), learn.SUMS), 1, 3 * shape.size + 2)
    sent.destroy()
    return *(out[k * shape.size : (k + 1) * shape.size] for k in range(3)), out[3 * shape.size :]


def evaluate(rows: DataFrame, state: np.ndarray, shape: Shape) -> dict:
    """eval_loss, eval_macro_f1 over the classes that occur or are predicted, and how often each class is predicted."""
    sums = _sums(rows, _score, state, shape, 1 + shape.classes**2)
    table = sums[1:].reshape(shape.classes, shape.classes)
    both = table.sum(axis=0) + table.sum(axis=1)
    seen = both > 0
    f1 = 2 * np.diag(table)[seen] / both[seen]
    return {"eval_loss": float(sums[0] / max(table.sum(), 1)), "eval_macro_f1": float(f1.mean()) if len(f1) else 0.0, "counts": table.sum(axis=0).astype(int).tolist()}


def train(rows: DataFrame, buckets: int, state: np.ndarray, shape: Shape, settings: Settings, steps: int, val: DataFrame | None = None) -> tuple[np.ndarray, list[dict], dict[int, np.ndarray]]:
    """Steps of Adam on ``rows``, which ``features`` made with this batch. -> the end state; a row for each evaluated step (every ``eval_every``, and the last); the best step's state.

    Of equal scores the first step is the best.
    """
    m, v = np.zeros(shape.size), np.zeros(shape.size)
    history: list[dict] = []
    best: dict[int, np.ndarray] = {}
    top, t, per = -1.0, 0, chained(settings.batch)
    while t < steps:
        first, bucket = t + 1, t % buckets
        part = rows.filter(F.col("part") == bucket // per)
        if per == 1:
            t = first
            sums = _sums(part, _gradient, state, shape, 2 + shape.size)
            state, m, v = _stepped(state, m, v, sums, t, steps, settings)
        else:
            t = min(steps, t + per - bucket % per, t + buckets - bucket, steps if val is None else t - t % settings.eval_every + settings.eval_every)
            state, m, v, sums = _chain_of(part.filter(F.col("bucket").between(bucket, bucket + t - first)), state, m, v, shape, first, t, steps, buckets, settings)
        n = max(sums[0], 1)
        if val is not None and (t % settings.eval_every == 0 or t == steps):
            found = evaluate(val, state, shape)
            history.append({"step": t, "epoch": round(t / buckets, 4), "eval_loss": round(found["eval_loss"], 6), "eval_macro_f1": round(found["eval_macro_f1"], 6), "train_loss": round(float(sums[1] / n), 6), "validation_prediction_counts": {str(c): k for c, k in enumerate(found["counts"])}})
            if history[-1]["eval_macro_f1"] > top:
                top, best = history[-1]["eval_macro_f1"], {t: state}
    return state, history, best


def save_state(spark: SparkSession, path: str, state: np.ndarray, info: dict) -> None:
    data = [(b, state[b * learn.BLOCK : (b + 1) * learn.BLOCK].tobytes(), json.dumps(info, sort_keys=True)) for b in range(-(-len(state) // learn.BLOCK))]
    spark.createDataFrame(data, "block int, data binary, info string").coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[np.ndarray, dict] | None:
    """The state and what was noted with it; None where there is none."""
    try:
        rows = sorted(spark.read.parquet(path).collect())
    except AnalysisException:
        return None
    return np.concatenate([np.frombuffer(r["data"], np.float64) for r in rows]), json.loads(rows[0]["info"])


def source_stage(df: DataFrame, key: str, base: str, width: int, seed: int, settings: Settings, folder: str, name: str) -> tuple[np.ndarray, dict]:
    """Trains on the first nine tenths of ``df`` (key, text, label codes) by key, and is scored on the rest. The end state is kept, not the best.

    ``folder`` holds the states of stages by the digest of what they depend on: the same stage is trained once.
    """
    spark = df.sparkSession
    data = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, "text", "label") % 1_000_003).alias("h"), (F.max("label") + 1).alias("k")).first()
    spec = {"base": base, "width": width, "seed": seed, "settings": settings._asdict(), "data": name, "rows": data["n"], "digest": data["h"]}
    path = f"{folder}/{hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()}"
    kept = load_state(spark, path)
    if kept:
        return kept[0], kept[1] | {"tr_cache_hit": True}
    shape = Shape(width, max(2, data["k"] or 0))
    parts = prep.positional_cut(df, key)
    rows, buckets = features(parts.filter("split = 'train'"), key, seed, settings.batch)
    held, _ = features(parts.filter("split = 'val'"), key, seed, settings.batch)
    state = with_new_head(base_model(base, shape), width, shape.classes, seed)
    state, *_ = train(rows, buckets, state, shape, settings, buckets * settings.epochs)
    found = evaluate(held, state, shape)
    single = sum(c > 0 for c in found["counts"]) <= 1
    info = {"tr_stage_macro_f1": round(found["eval_macro_f1"], 6), "tr_stage_constant_prediction": single, "tr_stage_degenerate": found["eval_macro_f1"] <= ESCAPE or single}
    save_state(spark, path, state, info)
    return state, info | {"tr_cache_hit": False}


class Ready(NamedTuple):
    """What runs of a target, seed, size and batch share: written tables of the chosen, validation and test rows, the chosen ones' buckets and number, and the classes."""

    chosen: DataFrame
    buckets: int
    n: int
    held: DataFrame
    hidden: DataFrame | None
    classes: int


def ready(target: DataFrame, key: str, seed: int, train_size: int, batch: int, test: bool = False) -> Ready:
    """Raises if there are no rows to train or evaluate on."""
    target = tables.written(target.select(key, "text", "label", "split"), "target")
    labels = target.filter("split IN ('train', 'val')").agg(F.max("label")).first()[0]
    if labels is None:
        raise ValueError("no rows to train on")
    rows, buckets = features(prep.subsample_balanced(target.filter("split = 'train'"), train_size, key, seed=str(seed)), key, seed, batch)
    held, _ = features(target.filter("split = 'val'"), key, seed, batch)
    hidden = features(target.filter("split = 'test'"), key, seed, batch)[0] if test else None
    return Ready(rows, buckets, rows.count(), held, hidden, max(2, labels + 1))


def run(target: DataFrame | Ready, key: str, *, base: str, condition: str, seed: int, train_size: int, settings: Settings, width: int = 16, source: DataFrame | None = None, source_name: str = "none", test: bool = False, folder: str | None = None) -> dict:
    """One run -> its record. ``target`` (key, text, label codes, split of train, val, test), or what ``ready`` made of it for the same seed, size, batch and ``test``; ``source`` (key, text, label codes) makes it go through a source stage first.

    Raises if the best step's state, scored again, does not give the score it was chosen for, or if a stage has no rows to train or evaluate on.
    """
    if settings.select_best and settings.max_steps % settings.eval_every:
        raise ValueError(f"{settings.max_steps} steps are no multiple of {settings.eval_every}: the last one would not be measured")
    if not isinstance(target, Ready):
        target = ready(target, key, seed, train_size, settings.batch, test)
    rows, buckets, n, held, hidden, classes = target
    spark, shape = rows.sparkSession, Shape(width, classes)
    info = {"tr_stage_macro_f1": None, "tr_stage_degenerate": None}
    state = base_model(base, shape)
    if source is not None:
        state, info = source_stage(source, key, base, width, seed, settings, folder or f"{tables.shared(spark)}/source-stages", source_name)
    state = with_new_head(state, width, shape.classes, seed)
    end, history, best = train(rows, buckets, state, shape, settings, settings.max_steps, held)
    (selected_step, selected), last = next(iter(best.items())), history[-1]
    score = {h["step"]: h["eval_macro_f1"] for h in history}
    over = [h["step"] for h in history if h["eval_macro_f1"] > ESCAPE]
    restored = round(evaluate(held, selected, shape)["eval_macro_f1"], 6) if settings.select_best else None
    if restored is not None and abs(restored - score[selected_step]) > 1e-4:
        raise ValueError(f"the state of step {selected_step} scores {restored}, not {score[selected_step]}")
    matched_step = selected_step if settings.select_best else last["step"]
    tested = None
    if test:
        tested = round(evaluate(hidden, selected if settings.select_best else end, shape)["eval_macro_f1"], 6)
    comparison = {
        "eval_split": "test" if test else "val", "selection": SELECTIONS[0] if settings.select_best else SELECTIONS[1], "matched_step": matched_step, "validation_macro_f1_matched": score[matched_step],
        "restored_validation_macro_f1": restored, "test_macro_f1": tested, "delta_test_minus_validation_matched": None if tested is None else round(tested - score[matched_step], 6),
    }
    return {
        "run_result_schema_version": VERSION, "n_labels": shape.classes, "base": base, "condition": condition, "condition_id": 0, "tokenizer": "hashed words", "turkish": source_name, "train_size": train_size, "actual_train_size": n, "seed": seed,
        "escaped": bool(over), "escape_step": min(over, default=None), "selected_step": selected_step, "selected_validation_macro_f1": score[selected_step], "terminal_step": last["step"], "terminal_validation_macro_f1": last["eval_macro_f1"],
        "escaped_but_terminal_collapsed": bool(over) and last["eval_macro_f1"] <= ESCAPE, "eval_split": "test" if test else "val", "per_run_verdict": "ESCAPED" if over else "NOT_ESCAPED", "max_steps": settings.max_steps, "steps_per_epoch": buckets, "effective_epochs": round(settings.max_steps / buckets, 4),
        "test_comparison": comparison, "step_history": history, "training_settings": {"max_steps": settings.max_steps, "eval_every_steps": settings.eval_every, "metric_for_best_model": "eval_macro_f1", "early_stopping_patience": None, "load_best_model_at_end": settings.select_best}, **info,
    }


def records(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """Run records as the texts that ``sources.io.parse_runs`` reads: value, source_path."""
    return spark.createDataFrame([(json.dumps(r, sort_keys=True), f"{r['base']}/{r['condition']}/{r['train_size']}/{r['seed']}") for r in runs], "value string, source_path string")
