"""Embedding-space operators: norms, nearest anchors, sparse reconstruction, assembly, rescaling."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tarnwork.functions import tables
from tarnwork.operators import order

#: Bytes of an anchor matrix that is sent to every task, at most; beyond it anchors are met in cells.
MOST_BYTES = 64 << 20
#: Anchors, or targets, of a task's block, about; targets compared at once; targets whose candidates' vectors meet in one task; cells at most.
BLOCK, SLICE, GROUP, MOST_CELLS = 20_000, 256, 64, 4096
#: Slack of angles, far above the rounding of cosines to nine places.
SLACK = 1e-4


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def scaled(v: Column, by: Column) -> Column:
    """Each component times ``by``, which is evaluated once for a vector."""
    return F.get(F.transform(F.array(by), lambda m: F.transform(v, lambda x: x.cast("double") * m)), 0)


def normalise(v: Column) -> Column:
    return scaled(v, 1.0 / F.greatest(norm(v), F.lit(1e-8)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)


def _fits(anchors: DataFrame) -> bool:
    """Whether the anchors' matrix may be sent to every task."""
    size = anchors.agg(F.sum(F.size("vec")).alias("n")).first()["n"] or 0
    return 8 * size <= MOST_BYTES


def _matrix(anchors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """ids and unit vectors of few anchors, by id."""
    t = anchors.select(F.col("id").cast("long"), "vec").toArrow()
    ids, m = t["id"].to_numpy(), _array(t["vec"])
    by = np.argsort(ids, kind="stable")
    return ids[by], _unit(m[by])


def _best(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest values, in falling order, of equal ones the first columns."""
    if sim.shape[1] > 4 * k:
        least = -np.partition(-sim, k - 1, axis=1)[:, k - 1]  # the k-th largest; all those as large are candidates
        out = np.empty((len(sim), k), np.int64)
        for i, v in enumerate(least):
            at = np.flatnonzero(sim[i] >= v)
            out[i] = at[np.argsort(-sim[i, at], kind="stable")[:k]]
        return out
    return np.argsort(-sim, axis=1, kind="stable")[:, :k]


def cosine_topk(targets: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """targets, anchors (id, vec) -> id, rank, anchor_id, cosine of the k nearest; ties by anchor id. One pass over the targets if the anchors' matrix has MOST_BYTES at most, else by cells."""
    if not _fits(anchors):
        return cosine_topk_cells(targets, anchors, k)
    shared = targets.sparkSession.sparkContext.broadcast(_matrix(anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = shared.value
        rows = max(1, min(SLICE, (32 << 20) // 8 // max(1, len(ids))))  # similarities of 32 MB at once
        for batch in batches:
            for i in range(0, batch.num_rows if len(ids) else 0, rows):
                part = batch.slice(i, rows)
                sim = np.round(_unit(_array(part.column(1))) @ m.T, 9)
                best = _best(sim, k)
                n = best.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(1, n + 1), len(sim))), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(sim, best, 1).ravel())], names=["id", "rank", "anchor_id", "cosine"])

    return targets.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, rank long, anchor_id long, cosine double")


def cosine_topk_cells(targets: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """The same as cosine_topk for any number of anchors, exactly."""
    rows, near = _nearest(targets, anchors, k)
    return near.join(rows.select("_row", "id"), "_row").select("id", "rank", "anchor_id", "cosine")


class _Cells(NamedTuple):
    """Centres (unit vectors), and of each cell its radius as an angle and its anchors; one more cell, the last, has the anchors without a direction: its radius is half a turn."""

    centres: np.ndarray
    radius: np.ndarray
    count: np.ndarray

    def angles(self, unit: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(unit @ self.centres.T, -1, 1))


def _placed(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """``df`` (.., id, vec) with the cell of the nearest centre and the angle to it; vectors without a direction are in the last."""
    sent = df.sparkSession.sparkContext.broadcast(centres)
    schema = StructType([*df.schema.fields, StructField("_cell", IntegerType()), StructField("_angle", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_array(batch.column("vec")))
            cell, angle = np.zeros(len(unit), np.int32), np.zeros(len(unit))
            for i in range(0, len(unit), SLICE):
                cos = unit[i : i + SLICE] @ sent.value.T
                cell[i : i + SLICE] = cos.argmax(axis=1)
                angle[i : i + SLICE] = np.arccos(np.clip(cos.max(axis=1), -1, 1))
            odd = np.abs(np.linalg.norm(unit, axis=1) - 1) > 1e-6
            cell[odd], angle[odd] = len(sent.value), math.pi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=[*batch.schema.names, "_cell", "_angle"])

    return df.mapInArrow(run, schema)


def _meet(targets: DataFrame, anchors: DataFrame, cells: _Cells, visits: dict[int, int], k: int) -> DataFrame:
    """targets (_row, vec, _cell), anchors (id, vec, _cell) -> _row, anchor_id, cosine of the k nearest of each pair of blocks. ``visits``: targets of each cell.

    A cell's anchors, and the targets that visit it, are dealt into blocks, so neither a cell nor a crowd of targets is one task.
    """
    spark = targets.sparkSession
    sizes = spark.createDataFrame([(int(c), max(1, math.ceil(n / BLOCK)), max(1, math.ceil(visits.get(c, 0) / BLOCK))) for c, n in enumerate(cells.count.tolist()) if n], "_cell int, _na int, _nt int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    a = anchors.join(F.broadcast(sizes), "_cell").select("_cell", "id", "vec", deal("id", "_na").alias("_a"), each("_nt").alias("_t"))
    t = targets.join(F.broadcast(sizes), "_cell").select("_cell", "_row", "vec", deal("_row", "_nt").alias("_t"), each("_na").alias("_a"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = right["id"].to_numpy()
            by = np.argsort(ids, kind="stable")
            ids, m = ids[by], _unit(_array(right["vec"]))[by]
            row = left["_row"].to_numpy()
            rows = max(1, min(SLICE, (32 << 20) // 8 // len(ids)))
            for i in range(0, len(row), rows):
                sim = np.round(_unit(_array(left["vec"].slice(i, rows))) @ m.T, 9)
                best = _best(sim, k)
                for o, x in zip(out, (np.repeat(row[i : i + rows], best.shape[1]), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel())):
                    o.append(x)
        return pa.table([pa.array(np.concatenate(o) if o else np.zeros(0), t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["_row", "anchor_id", "cosine"])

    keys = ["_cell", "_a", "_t"]
    return t.groupBy(*keys).cogroup(a.groupBy(*keys)).applyInArrow(run, "_row long, anchor_id long, cosine double")


def _nearest(targets: DataFrame, anchors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Targets with a number of their own (_row, id, vec), and (_row, rank, anchor_id, cosine) of their k nearest anchors.

    Anchors are dealt to cells around some of them. A target first meets its own cell; the k-th cosine found there bounds how far the k nearest can be. It then visits only
    the cells that this bound can't exclude: those whose centre, less the cell's radius, is no farther. Only numbers and cosines are merged.
    """
    spark = targets.sparkSession
    n = anchors.count()
    some = anchors.orderBy(F.xxhash64("id"), "id").limit(min(MOST_CELLS, max(1, math.ceil(n / BLOCK)))).select("vec").toArrow()
    rows = tables.written(targets.select(F.monotonically_increasing_id().alias("_row"), F.col("id").cast("long").alias("id"), "vec"), "targets")
    nothing = spark.createDataFrame([], "_row long, rank long, anchor_id long, cosine double")
    if not n:
        return rows, nothing
    centres = _unit(_array(some["vec"]))
    dealt = tables.written(_placed(anchors.select(F.col("id").cast("long").alias("id"), "vec"), centres), "anchors")
    radius, count = np.zeros(len(centres) + 1), np.zeros(len(centres) + 1, np.int64)
    for r in dealt.groupBy("_cell").agg(F.max("_angle").alias("r"), F.count("*").alias("n")).collect():  # one row for each cell
        radius[r["_cell"]], count[r["_cell"]] = r["r"], r["n"]
    cells = _Cells(centres, radius, count)
    home = tables.written(_placed(rows.select("_row", "vec"), centres), "homes")
    visits = lambda df: {r["_cell"]: r["n"] for r in df.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    first = tables.written(_meet(home.select("_row", "vec", "_cell"), dealt, cells, visits(home), k), "nearest")
    kth = first.groupBy("_row").agg(F.get(F.sort_array(F.collect_list("cosine"), False), F.lit(k - 1)).alias("_kth"))  # k of each block of one cell
    sent = spark.sparkContext.broadcast(cells)

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """_row, _cell of the cells that a target must visit besides its own."""
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part, c = batch.slice(i, SLICE), sent.value
                unit = _unit(_array(part.column("vec")))
                bound = part.column("_kth").to_numpy(zero_copy_only=False)
                odd = np.abs(np.linalg.norm(unit, axis=1) - 1) > 1e-6
                reach = np.where(odd | np.isnan(bound), math.pi, np.arccos(np.clip(np.nan_to_num(bound), -1, 1))) + SLACK
                near = np.hstack([c.angles(unit) - c.radius[:-1], np.full((len(unit), 1), -math.pi)]) <= reach[:, None]
                near &= c.count > 0
                near[odd] = c.count > 0
                near[np.arange(len(unit)), part.column("_cell").to_numpy()] = False
                who, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(part.column("_row").to_numpy()[who]), pa.array(cell.astype(np.int32))], names=["_row", "_cell"])

    more = tables.written(home.join(kth, "_row", "left").select("_row", "vec", "_cell", "_kth").mapInArrow(further, "_row long, _cell int"), "visits")
    second = _meet(more.join(rows.select("_row", "vec"), "_row"), dealt, cells, visits(more), k)
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("cosine"), "anchor_id"))
    near = first.unionByName(second).withColumn("rank", rank).filter(F.col("rank") <= k)
    return rows, near.select("_row", F.col("rank").cast("long").alias("rank"), "anchor_id", "cosine")


def mean_weights(top: DataFrame, k: int) -> DataFrame:
    """Weight 1/k on the k nearest."""
    return top.filter(F.col("rank") <= k).select("id", "anchor_id", (1.0 / F.count("*").over(Window.partitionBy("id"))).alias("w"))


def transfer(weights: DataFrame, base: DataFrame) -> DataFrame:
    """(id, anchor_id, w) and the base's (id, vec), not normalised -> id, vec = sum of w * vec. A target has few weights; their vectors are added up in anchor order."""
    j = weights.join(base.select(F.col("id").alias("anchor_id"), "vec"), "anchor_id").select("id", F.struct("anchor_id", "w", scaled(F.col("vec"), F.col("w")).alias("x")).alias("s"))
    g = j.groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    zero = F.transform(F.get("s", F.lit(0))["x"], lambda x: x * 0.0)
    return g.select("id", F.aggregate("s", zero, lambda acc, s: F.zip_with(acc, s["x"], lambda a, x: a + x)).alias("vec"))


def omp(target: np.ndarray, atoms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy: k atoms (rows) at most and their least-squares weights; stops where atoms become dependent or nothing is left."""
    k = min(k, *atoms.shape)
    chosen: list[int] = []
    weights = np.zeros(0)
    left = target.astype(np.float64).copy()
    for _ in range(k):
        c = np.abs(atoms @ left)
        c[chosen] = -1
        best = int(c.argmax())
        if c[best] <= 1e-12:
            break
        trial = atoms[[*chosen, best]]
        gram = trial @ trial.T
        if np.linalg.matrix_rank(gram, tol=1e-10) < len(trial):
            break
        chosen.append(best)
        weights = np.linalg.solve(gram, trial @ target)
        left = target - weights @ trial
    return np.array(chosen, np.int64), weights


def _sparse(key: int, vec: np.ndarray, ids: np.ndarray, atoms: np.ndarray, k: int) -> list[tuple]:
    """Rows of omp_weights for one target."""
    t = np.asarray(vec, np.float64)
    t = t / max(float(np.linalg.norm(t)), 1e-8)
    at, w = omp(t, atoms, k)
    made = w @ atoms[at] if len(at) else np.zeros_like(t)
    cos = float(made @ t / max(float(np.linalg.norm(made)), 1e-8))
    return [(key, int(ids[a]), float(x), float(np.linalg.norm(t - made)), cos) for a, x in zip(at, w)]


def omp_weights(targets: DataFrame, anchors: DataFrame, k: int, candidates: int) -> DataFrame:
    """Sparse weights over the nearest ``candidates`` anchors of each target, with the reconstruction's error and cosine."""
    schema = "id long, anchor_id long, w double, error double, cosine double"
    width = anchors.select(F.size("vec")).first()
    if width and candidates >= width[0]:
        warnings.warn(f"{candidates} candidates for vectors of {width[0]} components: more atoms than components, greedy choices may be wrong", stacklevel=2)
    if not _fits(anchors):
        return _omp_cells(targets, anchors, k, candidates, schema)
    shared = targets.sparkSession.sparkContext.broadcast(_matrix(anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = shared.value
        rows = max(1, min(SLICE, (32 << 20) // 8 // max(1, len(ids))))
        for batch in batches:
            for i in range(0, batch.num_rows if len(ids) else 0, rows):
                keys, t = batch.column(0)[i : i + rows].to_pylist(), _array(batch.column(1)[i : i + rows])
                best = _best(np.round(_unit(t) @ m.T, 9), candidates)
                yield _weights([x for key, vec, near in zip(keys, t, best) for x in _sparse(key, vec, ids[near], m[near], k)])

    return targets.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, schema)


def _weights(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), *[pa.float64()] * 3))], names=["id", "anchor_id", "w", "error", "cosine"])


def _omp_cells(targets: DataFrame, anchors: DataFrame, k: int, candidates: int, schema: str) -> DataFrame:
    """omp_weights for any number of anchors: targets of one cell, GROUP of them at a time, meet their candidates' vectors, each of which travels once for the group."""
    rows, near = _nearest(targets, anchors, candidates)
    near = tables.written(near, "candidates")
    lists = near.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("rank", "anchor_id"))).alias("near"))
    # targets with the same nearest anchor share most of the others
    lists = rows.join(lists, "_row").withColumn("_first", F.get("near", F.lit(0))["anchor_id"])
    crowd = lists.groupBy("_first").agg(F.ceil(F.count("*") / GROUP).alias("_n"))
    lists = lists.join(crowd, "_first").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_n")).cast("int")).select("_first", "_part", "_row", "id", "vec", F.transform("near", lambda x: x["anchor_id"]).alias("near"))
    lists = tables.written(lists, "groups")
    wanted = lists.select(F.col("_first").alias("_f"), F.col("_part").alias("_p"), F.explode("near").alias("anchor_id")).distinct()
    atoms = wanted.join(anchors.select(F.col("id").cast("long").alias("anchor_id"), "vec"), "anchor_id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            ids = right["anchor_id"].to_numpy()
            by = np.argsort(ids)
            ids, m = ids[by], _unit(_array(right["vec"]))[by]
            for key, vec, near in zip(left["id"].to_pylist(), _array(left["vec"]), left["near"].to_pylist()):
                at = np.searchsorted(ids, near)
                out += _sparse(key, vec, ids[at], m[at], k)
        return pa.Table.from_batches([_weights(out)])

    return lists.groupBy("_first", "_part").cogroup(atoms.groupBy("_f", "_p")).applyInArrow(run, schema)


def random_weights(top: DataFrame, k: int, seed: str) -> DataFrame:
    """k candidates of each target by a seeded hash, weights normally distributed (Box-Muller on the hash's digits), scaled to absolute sum 1."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.col("rank").cast("string")))
    r = F.row_number().over(Window.partitionBy("id").orderBy(h))
    unit = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 1) / float((1 << 32) + 1)
    x = F.sqrt(-2 * F.ln(unit(9))) * F.cos(2 * math.pi * unit(17))
    d = top.withColumn("r", r).withColumn("x", x).filter(F.col("r") <= k)
    return d.select("id", "anchor_id", (F.col("x") / F.sum(F.abs("x")).over(Window.partitionBy("id"))).alias("w"))


def reconstruction(weights: DataFrame) -> DataFrame:
    """Mean error, mean and tenth-percentile cosine over the targets."""
    one = tables.written(weights.groupBy("id").agg(F.first("error").alias("e"), F.first("cosine").alias("c")), "errors")
    means = one.agg(F.count("*").alias("n"), F.round(F.avg("e"), 4).alias("mean_l2"), F.round(F.avg("c"), 4).alias("mean_cosine"))
    tenth = order.percentiles(one, [], "c", {"p": 0.1}).agg(F.round(F.max("p"), 4).alias("p10_cosine"))  # one row, none without targets
    return means.join(F.broadcast(tenth))


def norm_report(rows: DataFrame, by: str) -> DataFrame:
    """Statistics of the norms of each set of rows."""
    d = tables.written(rows.select(by, norm(F.col("vec")).alias("x")), "norms")
    r = lambda c: F.round(c, 4)
    g = d.groupBy(by).agg(F.count("*").alias("rows"), r(F.avg("x")).alias("mean"), r(F.stddev_pop("x")).alias("sd"), r(F.min("x")).alias("min"), r(F.max("x")).alias("max"))
    mid = order.percentiles(d, [by], "x", {"median": 0.5}).select(F.col(by).alias("_by"), r(F.col("median")).alias("median"))
    return g.join(F.broadcast(mid), F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "rows", "median", "mean", "sd", "min", "max")


def norm_health(report: DataFrame, by: str, made: str, anchor: str) -> DataFrame:
    x = report.agg(F.max(F.when(F.col(by) == made, F.col("median"))).alias("m"), F.max(F.when(F.col(by) == anchor, F.col("median"))).alias("a"))
    ratio = F.round(F.col("m") / F.greatest("a", F.lit(1e-12)), 3)
    return x.select(ratio.alias("ratio"), F.coalesce(ratio.between(0.85, 1.15), F.lit(False)).alias("healthy"))


def rescale(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows at the anchors' median norm, directions kept."""
    med = order.percentiles(anchors.select(norm(F.col("vec")).alias("x")), [], "x", {"_m": 0.5}).select("_m")
    return rows.join(F.broadcast(med)).select("id", scaled(F.col("vec"), F.col("_m") / F.greatest(norm(F.col("vec")), F.lit(1e-8))).alias("vec"))


def assemble(ids: DataFrame, anchors: DataFrame, specials: DataFrame, made: DataFrame) -> DataFrame:
    """A row for each id: the special's vector, else the anchor's, else the reconstructed one, and where it came from."""
    j = ids.join(specials.select("id", F.col("vec").alias("s")), "id", "left").join(anchors.select("id", F.col("vec").alias("a")), "id", "left").join(made.select("id", F.col("vec").alias("r")), "id", "left")
    return j.select("id", F.coalesce("s", "a", "r").alias("vec"), F.when(F.col("s").isNotNull(), "special").when(F.col("a").isNotNull(), "anchor").when(F.col("r").isNotNull(), "reconstructed").alias("origin"))


def cross_base(reports: DataFrame) -> DataFrame:
    """Of remade models (base, tag, n_anchor, n_unfamiliar, measured_tag, delta_bpc, norm_ratio, healthy, mean_cosine) what may be compared.

    The change in bits is withheld where it was measured on another or an unnamed artefact. The worse model is the one with the larger
    change; norm health corroborates it if the worse is unhealthy and another one is healthy. Cosines are listed, never judged by.
    """
    known = F.col("measured_tag").eqNullSafe(F.col("tag"))
    r = reports.select("base", F.round(100 * F.col("n_anchor") / F.greatest(F.col("n_anchor") + F.col("n_unfamiliar"), F.lit(1)), 2).alias("anchor_share_pct"), "mean_cosine", F.when(known, F.col("delta_bpc")).alias("delta_bpc"), (F.col("delta_bpc").isNotNull() & ~known).alias("withheld"), "norm_ratio", "healthy")
    g = r.agg(F.max("delta_bpc").alias("hi"), F.count("delta_bpc").alias("k"), F.count_distinct("delta_bpc").alias("values"), F.count_if(F.col("healthy")).alias("sound"))  # one row
    worse = F.coalesce((F.col("k") >= 2) & (F.col("values") >= 2) & (F.col("delta_bpc") == F.col("hi")), F.lit(False))
    return r.join(F.broadcast(g)).withColumn("worse", worse).withColumn("corroborated", F.when(worse, F.coalesce(~F.col("healthy"), F.lit(False)) & (F.col("sound") > 0))).drop("hi", "k", "values", "sound")
