"""Text classifiers that are trained on the cluster.

Features are TF-IDF weights of character n-grams within words, with document frequencies over all training rows. The loss and its
gradient are summed over the tasks and up a tree, so that no task holds more than a few tasks' sums of one block of parameters; the driver holds
the parameters and makes the next step. Many models, one for each group of rows, are trained in lockstep: an evaluation is one job for all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import tables
from tarnwork.functions import text as T
from tarnwork.operators import prep

#: Lengths of the n-grams, rows that must hold one at least, features of a model at most, and the test rows' share (fixed values).
SIZES, MIN_DF, FEATURES, TEST_SHARE = (2, 3, 4, 5), 2, 200_000, 0.2
#: Parameters that are trained at once: models beyond them come in a further round. 8 bytes each are held, and sent, some times over.
MOST_PARAMETERS = 4_000_000
#: Parameters of a block, and sums that are added in one task.
BLOCK, FAN = 1 << 16, 16


def char_grams(text: Column) -> Column:
    """The n-grams of each lower-cased word with a space at both its ends, as often as they occur; no n-gram is longer than its word."""
    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.concat(*(_pieces(padded, n) for n in SIZES))

    return F.flatten(F.transform(T.split_words(F.lower(F.coalesce(text, F.lit("")))), of))


def _pieces(word: Column, n: int) -> Column:
    last = F.char_length(word) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def gram_counts(rows: DataFrame) -> DataFrame:
    """rows (row, group, train, text) -> row, group, train, gram, tf. Rows are dealt out by their number, so each row's n-grams are counted where its text is."""
    each = rows.repartition(F.col("row")).select("row", "group", "train", F.explode(char_grams(F.col("text"))).alias("gram"))
    return each.groupBy("row", "group", "train", "gram").agg(F.count("*").cast("double").alias("tf"))


def vocabulary(counts: DataFrame, sizes: DataFrame, least: int = MIN_DF, most: int = FEATURES) -> DataFrame:
    """group, gram, idx, idf of each group's training rows; sizes (group, n).

    Of a group with too many n-grams the most frequent stay; those as frequent as the first that has no place go together.
    """
    return _vocabulary(counts.filter("train").groupBy("group", "gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), sizes, least, most)


def _vocabulary(df: DataFrame, sizes: DataFrame, least: int, most: int) -> DataFrame:
    """``vocabulary`` from group, gram, df (rows that hold it), total."""
    df = tables.written(df.filter(F.col("df") >= least), "grams")
    upto = F.sum("n").over(Window.partitionBy("group").orderBy(F.desc("total")))
    cut = df.groupBy("group", "total").agg(F.count("*").alias("n")).withColumn("upto", upto).filter(F.col("upto") <= most).groupBy("group").agg(F.min("total").alias("cut"))
    kept = df.join(F.broadcast(cut), "group").filter(F.col("total") >= F.col("cut"))
    idx = F.row_number().over(Window.partitionBy("group").orderBy("gram")) - 1  # ``most`` rows at most
    idf = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return kept.join(F.broadcast(sizes), "group").select("group", "gram", idx.alias("idx"), idf.alias("idf"))


#: Texts whose n-grams a task holds at once, and the base of the numbers that stand for n-grams.
TEXTS, _BASE = 500, np.uint64(0x9E3779B97F4A7C15)


def spaced(text: Column) -> Column:
    """The lower-cased words, each with a space at both its ends."""
    return F.array_join(F.transform(T.split_words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``char_grams`` of a ``spaced`` text, by 64-bit numbers in ascending order, and how often each occurs."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    gaps = np.flatnonzero(c == 32)
    room = np.repeat(gaps[1::2] + 1, gaps[1::2] - gaps[::2] + 1) - np.arange(len(c))  # characters up to the word's end
    found = []
    for n in SIZES:
        m = max(0, len(c) - n + 1)
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h *= _BASE
            h += c[k : k + m]
        found.append(h[room[:m] >= n])
    return np.unique(np.concatenate(found).view(np.int64), return_counts=True)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, TEXTS):
            yield batch.slice(i, TEXTS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, spaced text): of each group's n-grams in some texts the texts that hold them, and all occurrences."""
    for batch in _chunks(batches):
        groups = batch.column(0).dictionary_encode()
        code, texts = groups.indices.to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        for g in range(len(groups.dictionary)):
            gram, tf = (np.concatenate(x) for x in zip(*(_grams(texts[i]) for i in np.flatnonzero(code == g).tolist())))
            keys, at = np.unique(gram, return_inverse=True)
            df, total = np.bincount(at, minlength=len(keys)), np.bincount(at, tf, len(keys))
            yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(np.full(len(keys), g))), pa.array(keys), pa.array(df.astype(np.int64)), pa.array(total)], names=["group", "gram", "df", "total"])


def _weights(words):
    """Rows (row, train, model, y, spaced text): the features' places and weights, (1 + ln tf) idf, scaled to length 1, for texts; ``words`` has each model's n-grams in order and their idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in _chunks(batches):
            idx, val = [], []
            for m, text in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                (grams, idf), (gram, tf) = known[m], _grams(text)
                at = np.searchsorted(grams, gram)
                hit = np.flatnonzero(grams[np.minimum(at, len(grams) - 1)] == gram) if len(grams) else np.zeros(0, np.int64)
                x = (1 + np.log(tf[hit])) * idf[at[hit]]
                idx.append(at[hit].astype(np.int32))
                val.append(x / np.sqrt((x * x).sum()) if len(x) else x)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in idx])]).astype(np.int32))
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (idx, val))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], names=["row", "train", "model", "y", "idx", "val"])

    return run


# --- sums over the cluster


def blocks_of(sums: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """(block, part, data) of a long array, blocks without anything left out."""
    part = TaskContext.get().partitionId()
    for b in range(0, len(sums), BLOCK):
        if sums[b : b + BLOCK].any():
            yield pa.RecordBatch.from_arrays([pa.array([first + b // BLOCK], pa.int32()), pa.array([part], pa.int32()), pa.array([sums[b : b + BLOCK].tobytes()], pa.binary())], names=["block", "part", "data"])


SUMS = "block int, part int, data binary"


def _added(t: pa.Table) -> pa.Table:
    total = np.zeros(0)
    for data in t["data"]:
        x = np.frombuffer(data.as_buffer(), np.float64)
        total = total + x if len(total) else x.copy()
    return pa.table([t["block"][:1], t["part"][:1], pa.array([total.tobytes()], pa.binary())], names=["block", "part", "data"])


def tree_sum(parts: DataFrame, tasks: int, n: int) -> np.ndarray:
    """The sum of all tasks' arrays of length n: FAN of them at a time, up a tree; the driver gets one array."""
    while tasks > 1:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("block", "part").applyInArrow(_added, SUMS)
    out = np.zeros(n)
    for r in parts.collect():
        x = np.frombuffer(r["data"], np.float64)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(x)] = x
    return out


# --- logistic models, one for each group


class Layout(NamedTuple):
    """Where the parameters of each group's model are: ``outputs`` rows (one for two classes) of its features and an intercept, from ``start`` on."""

    start: np.ndarray
    features: np.ndarray
    outputs: np.ndarray

    @staticmethod
    def of(features: list[int], classes: list[int]) -> Layout:
        f, k = np.array(features, np.int64), np.array(classes, np.int64)
        outputs = np.where(k == 2, 1, k)
        size = outputs * (f + 1)
        return Layout(np.cumsum(size) - size, f, outputs)

    @property
    def size(self) -> np.ndarray:
        return self.outputs * (self.features + 1)


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(dtype), np.diff(offsets)


def margins(w: np.ndarray, layout: Layout, model: np.ndarray, idx: np.ndarray, val: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each row the outputs' margins, minus infinity for outputs that its model lacks; two classes have the margins 0 and z."""
    row = np.repeat(np.arange(len(model)), n)
    most = int(layout.outputs.max(initial=1))
    out = np.full((len(model), max(2, most)), -np.inf)
    for k in range(most):
        has = layout.outputs[model] > k
        base = layout.start[model] + k * (layout.features[model] + 1)
        entry = has[row]
        z = np.bincount(row[entry], val[entry] * w[base[row[entry]] + idx[entry]], len(model))
        at = np.where(layout.outputs[model] == 1, 1, k)
        out[has, at[has]] = z[has] + w[(base + layout.features[model])[has]]
    out[layout.outputs[model] == 1, 0] = 0.0
    return out


def _loss(layout: Layout, w):
    """Sums of a task's rows (model, y, idx, val): the losses of all models, then the gradient."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = w.value
        models = len(layout.start)
        sums = np.zeros(models + len(now))
        loss, grad = sums[:models], sums[models:]
        for batch in batches:
            model, y = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            (idx, n), (val, _) = _flat(batch.column(2), np.int64), _flat(batch.column(3), np.float64)
            z = margins(now, layout, model, idx, val, n)
            top = z.max(axis=1, keepdims=True)
            e = np.exp(z - top)
            total = e.sum(axis=1, keepdims=True)
            at = np.arange(len(y))
            loss += np.bincount(model, np.log(total[:, 0]) + top[:, 0] - z[at, y], models)
            off = e / total
            off[at, y] -= 1
            row = np.repeat(at, n)
            for k in range(int(layout.outputs.max(initial=1))):
                has = layout.outputs[model] > k
                delta = off[at, np.where(layout.outputs[model] == 1, 1, k)]
                base = layout.start[model] + k * (layout.features[model] + 1)
                entry = has[row]
                grad += np.bincount(base[row[entry]] + idx[entry], val[entry] * delta[row[entry]], len(grad))
                grad += np.bincount((base + layout.features[model])[has], delta[has], len(grad))
        yield from blocks_of(sums)

    return run


def lbfgs(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, size: np.ndarray, steps: int = 200, memory: int = 10, tolerance: float = 1e-4) -> np.ndarray:
    """Minimises several functions of segments (``size``) of x side by side: each has its own curvature pairs, step lengths and end.

    ``evaluate`` gives all values and the whole gradient. A segment rests once no component of its gradient is above ``tolerance``.
    """
    starts = np.cumsum(size) - size
    dot = lambda a, b: np.add.reduceat(a * b, starts)
    wide = lambda v: np.repeat(v, size)
    f, g = evaluate(x)
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scale = 1 / np.maximum(np.sqrt(dot(g, g)), 1)
    for _ in range(steps):
        active = np.maximum.reduceat(np.abs(g), starts) > tolerance
        if not active.any():
            break
        q, alphas = g.copy(), []
        for s, y, rho in reversed(pairs):
            alphas.append(rho * dot(s, q))
            q -= wide(alphas[-1]) * y
        q *= wide(scale)
        for (s, y, rho), a in zip(pairs, reversed(alphas)):
            q += wide(a - rho * dot(y, q)) * s
        d = -q * wide(active)
        slope, t = dot(g, d), np.ones(len(size))
        for _ in range(30):
            new = x + wide(t) * d
            f_new, g_new = evaluate(new)
            bad = active & ~(f_new <= f + 1e-4 * t * slope + 1e-12 * np.abs(f))
            if not bad.any():
                break
            t = np.where(bad, t / 2, t)
        s, y = new - x, g_new - g
        sy, yy = dot(s, y), dot(y, y)
        good = sy > 1e-12 * yy
        pairs = [*pairs, (s, y, np.where(good, 1 / np.where(good, sy, 1), 0))][-memory:]
        scale = np.where(good, sy / np.where(yy > 0, yy, 1), scale)
        x, f, g = new, f_new, g_new
    return x


def fit(rows: DataFrame, layout: Layout, c: float = 1.0) -> np.ndarray:
    """rows (model, y, idx, val) -> the parameters at which ``c`` times the log loss and half the squared weights, intercepts aside, are least."""
    spark = rows.sparkSession
    tasks, total = rows.rdd.getNumPartitions(), int(layout.size.sum())
    models = len(layout.start)
    weight = np.ones(total)
    for start, features, outputs in zip(*layout):
        weight[start + features + (features + 1) * np.arange(outputs)] = 0

    def evaluate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = spark.sparkContext.broadcast(x)
        sums = tree_sum(rows.mapInArrow(_loss(layout, sent), SUMS), tasks, models + total)
        sent.destroy()
        penalty = np.add.reduceat(weight * x * x, layout.start) / 2
        return c * sums[:models] + penalty, c * sums[models:] + weight * x

    return lbfgs(evaluate, np.zeros(total), layout.size)


def predict(rows: DataFrame, layout: Layout, w: np.ndarray) -> DataFrame:
    """rows (row, model, y, idx, val) -> row, model, y, pred."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            (idx, n), (val, _) = _flat(batch.column(3), np.int64), _flat(batch.column(4), np.float64)
            z = margins(sent.value, layout, model, idx, val, n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z.argmax(axis=1), pa.int32())], names=["row", "model", "y", "pred"])

    return rows.select("row", "model", "y", "idx", "val").mapInArrow(run, "row long, model int, y int, pred int")


def macro_f1(predicted: DataFrame, by: str, gold: str = "y", pred: str = "pred") -> DataFrame:
    """Of each group the mean F1 of the classes that are in gold or predicted."""
    hit = F.col(gold) == F.col(pred)
    both = F.explode(F.array_distinct(F.array(F.col(gold), F.col(pred)))).alias("class")
    g = predicted.select(by, both, hit.alias("hit")).groupBy(by, "class").agg(F.sum(F.when(F.col("hit"), 2).otherwise(0)).alias("tp2"), F.sum(F.when(F.col("hit"), 2).otherwise(1)).alias("all"))
    return g.groupBy(by).agg(F.avg(F.col("tp2") / F.col("all")).alias("macro_f1"))


def headroom(df: DataFrame, group: str, key: str, text: str = "text", label: str = "label", seed: str = "0", least: int = MIN_DF, most: int = FEATURES) -> DataFrame:
    """Of each group how well a plain classifier does: group, n_train, n_test, n_features, headroom (macro-F1 on held-out rows).

    A fifth of each class's rows, in seeded order, is held out; ``key`` is unique. Headroom is null for a group with fewer than two classes, or a class
    of one row, or nothing to hold out. Rows without a text or label are left out; a row without any known n-gram is judged by the intercepts.
    """
    d = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("row"), F.col(group).alias("group"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    d = d.withColumn("stratum", F.struct("group", "label"))
    held = prep.cuts(d, "stratum", seed, "row", {"test": F.floor(F.col("n") * F.lit(TEST_SHARE))}).select("_by", F.col("n").alias("_n"), "test")
    at = F.struct(T.seeded(seed, F.col("row")).alias("h"), F.col("row").alias("k"))
    d = d.join(held, F.col("stratum").eqNullSafe(F.col("_by"))).withColumn("train", ~F.coalesce(at <= F.col("test"), F.lit(False))).select("row", "group", "label", "text", "train")
    d = tables.written(d, "headroom-rows")
    names = d.groupBy("group").agg(F.sort_array(F.collect_set("label")).alias("classes"), F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_test"))
    rare = d.groupBy("group", "label").agg(F.count("*").alias("c")).groupBy("group").agg(F.min("c").alias("fewest"))
    names = tables.written(names.alias("a").join(rare.alias("b"), F.col("a.group").eqNullSafe(F.col("b.group"))).select("a.*", "fewest"), "headroom-groups")
    fit_for = names.filter((F.size("classes") >= 2) & (F.col("fewest") >= 2) & (F.col("n_test") > 0) & F.col("group").isNotNull())
    texts = d.filter("train").join(F.broadcast(fit_for.select("group")), "group").select("group", spaced(F.col("text")).alias("text"))
    kind = dict(d.dtypes)["group"]
    counts = texts.mapInArrow(_frequencies, f"group {kind}, gram long, df long, total double").groupBy("group", "gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    words = tables.written(_vocabulary(counts, fit_for.select("group", F.col("n_train").alias("n")), least, most), "headroom-vocabulary")
    sizes = {r["group"]: r["n"] for r in words.groupBy("group").agg(F.count("*").alias("n")).collect()}  # one row for each data set
    models = [(r["group"], r["classes"], sizes.get(r["group"], 0)) for r in fit_for.orderBy("group").collect()]
    out = None
    for part in _rounds(models):
        layout = Layout.of([n for *_, n in part], [len(c) for _, c, _ in part])
        numbers = d.sparkSession.createDataFrame([(g, m, c, n) for m, (g, c, n) in enumerate(part)], f"group {kind}, model int, classes array<string>, n_features long")
        mine = words.join(F.broadcast(numbers), "group").select("model", "idx", "gram", "idf").orderBy("model", "idx").toArrow()  # MOST_PARAMETERS at most
        of, gram, idf = (mine[c].to_numpy() for c in ("model", "gram", "idf"))
        edges = np.searchsorted(of, np.arange(len(part) + 1))
        sent = d.sparkSession.sparkContext.broadcast([(gram[a:b], idf[a:b]) for a, b in zip(edges[:-1], edges[1:])])
        y = (F.array_position("classes", F.col("label")) - 1).cast("int").alias("y")
        rows = d.join(F.broadcast(numbers), "group").select("row", "train", "model", y, spaced(F.col("text")).alias("text"))
        rows = tables.written(rows.mapInArrow(_weights(sent), f"row {dict(d.dtypes)['row']}, train boolean, model int, y int, idx array<int>, val array<double>"), "headroom-features")
        sent.destroy()
        w = fit(rows.filter("train").select("model", "y", "idx", "val"), layout)
        found = macro_f1(predict(rows.filter("NOT train"), layout, w), "model").join(F.broadcast(numbers), "model").select("group", "n_features", F.round("macro_f1", 4).alias("headroom"))
        out = found if out is None else out.unionByName(found)
    plain = names.select(F.col("group").alias(group), "n_train", "n_test")
    if out is None:
        return plain.select("*", F.lit(None).cast("long").alias("n_features"), F.lit(None).cast("double").alias("headroom"))
    return plain.join(out.withColumnRenamed("group", group), group, "left")


def _rounds(models: list[tuple]) -> Iterator[list[tuple]]:
    """Models in order, as many at a time as have MOST_PARAMETERS together, one at least."""
    part, size = [], 0
    for m in models:
        n = (1 if len(m[1]) == 2 else len(m[1])) * (m[2] + 1)
        if part and size + n > MOST_PARAMETERS:
            yield part
            part, size = [], 0
        part.append(m)
        size += n
    if part:
        yield part
