"""Cells, intervals, tests and contrasts over runs; the numeric tails that SQL lacks run on Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tarnwork.operators import order

#: The normal quantile of the 95 % interval, whatever alpha is asked for.
Z = 1.959963984540054


def mean(value: Column | str) -> Column:
    """The mean, from an exact sum of values taken to ten places: the same in any order of the rows."""
    v = F.col(value) if isinstance(value, str) else value
    return F.try_divide(F.sum(v.cast("decimal(28,10)")).cast("double"), F.count(v))


def places(value: Column | str, n: int) -> Column:
    """Rounded half away from zero as the decimal that it is to ten places, so that the last bits of a double don't decide."""
    v = F.col(value) if isinstance(value, str) else value
    return F.round(v.cast("decimal(28,10)"), n).cast("double")


def cell_summary(grid: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of ``grid``, also those without runs: (keys, seed, escaped, f1, collapsed)."""
    g = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("escaped").alias("k"), mean(F.when(F.col("escaped"), F.col("f1"))).alias("c"), mean("f1").alias("a"), F.count_if(F.col("escaped") & ~F.col("collapsed")).alias("sustained"))
    j = grid.join(g, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("k", F.coalesce("k", F.lit(0)))
    return j.select(
        *keys, F.when(F.col("n") > 0, "MEASURED").otherwise("NOT MEASURED").alias("status"), "n", F.col("k").alias("n_escaped"), F.when(F.col("n") > 0, F.round(F.col("k") / F.col("n"), 4)).alias("escape_rate"), F.when(F.col("n") > 0, F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"))).alias("escape_count"),
        places("c", 4).alias("conditional_f1"), places("a", 4).alias("all_seed_f1"), places(F.col("c") - F.col("a"), 4).alias("difference"), F.coalesce("sustained", F.lit(0)).alias("sustained"),
    )


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """The interval of k of n, within [0, 1]; null without trials."""
    nn = F.greatest(n, F.lit(1)).cast("double")
    p = k / nn
    mid, half = (p + Z * Z / (2 * nn)) / (1 + Z * Z / nn), Z / (1 + Z * Z / nn) * F.sqrt(p * (1 - p) / nn + Z * Z / (4 * nn * nn))
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), mid - half)), F.when(some, F.least(F.lit(1.0), mid + half))


_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    """ln(n!) of whole numbers, by a table and Stirling's series."""
    x = np.maximum(np.asarray(n, np.float64), 1.0)
    far = x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(x < 256, _SMALL[np.minimum(x, 255).astype(np.int64)], far)


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of tables: the sum of all tables' probabilities, with the same margins, that are no larger."""
    out = []
    for a_, b_, c_, d_ in zip(a, b, c, d):
        x = np.arange(max(0, a_ + c_ - (c_ + d_)), min(a_ + c_, a_ + b_) + 1)
        w = -(log_factorial(x) + log_factorial(a_ + b_ - x) + log_factorial(a_ + c_ - x) + log_factorial(d_ - a_ + x))
        q = np.exp(w - w.max())
        out.append(min(1.0, float(q[q <= q[a_ - x[0]] * (1 + 1e-9)].sum() / q.sum())))
    return pd.Series(out, dtype="float64")


def fisher(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Two-sided exact test of (a, b, c, d): odds ratio (null if infinite) and p, rounded."""
    g = tables.select(*keys, *(F.col(x).cast("long").alias(x) for x in "abcd")).withColumn("p", fisher_p("a", "b", "c", "d"))
    odds = F.when((F.col("b") * F.col("c")) > 0, F.round(F.col("a") * F.col("d") / (F.col("b") * F.col("c")).cast("double"), 4))
    return g.select(*keys, odds.alias("odds_ratio"), F.round("p", 5).alias("p"), (F.col("p") < 0.05).alias("significant"))


def moments(runs: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean and sample variance over the escaped runs."""
    return runs.filter("escaped").groupBy(*keys).agg(F.count("*").alias("n"), mean("f1").alias("mean"), F.var_samp("f1").alias("var"))


def seed_noise(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.filter("escaped").groupBy(*keys).agg(F.count("*").alias("n"), places(mean("f1"), 4).alias("mean"), F.round(F.stddev_samp("f1"), 4).alias("sd"))


def pairs(cells: DataFrame, group: list[str], condition: str) -> DataFrame:
    """All pairs of conditions c1 < c2 within a group; the other columns prefixed a_ and b_."""
    rest = [c for c in cells.columns if c not in (*group, condition)]
    a = cells.select(*group, F.col(condition).alias("c1"), *(F.col(c).alias(f"a_{c}") for c in rest))
    b = cells.select(*group, F.col(condition).alias("c2"), *(F.col(c).alias(f"b_{c}") for c in rest))
    return a.join(b, group).filter("c1 < c2")


def effect(p: DataFrame) -> DataFrame:
    """Difference, Cohen's d, Welch's t and degrees of freedom, difference over noise of pairs of moments; null under two runs an arm."""
    ok = (F.coalesce("a_n", F.lit(0)) >= 2) & (F.coalesce("b_n", F.lit(0)) >= 2)
    va, vb = F.col("a_var") / F.col("a_n"), F.col("b_var") / F.col("b_n")
    diff = F.col("b_mean") - F.col("a_mean")
    pooled = F.sqrt(((F.col("a_n") - 1) * F.col("a_var") + (F.col("b_n") - 1) * F.col("b_var")) / F.greatest(F.col("a_n") + F.col("b_n") - 2, F.lit(1)))
    noise = F.sqrt((F.col("a_var") + F.col("b_var")) / 2)
    se = va + vb
    df = se * se / (va * va / F.greatest(F.col("a_n") - 1, F.lit(1)) + vb * vb / F.greatest(F.col("b_n") - 1, F.lit(1)))
    good = ok & (se > 0)
    return p.select("*", F.when(ok, "MEASURED").otherwise("NOT MEASURED").alias("status"), F.when(ok, places(diff, 4)).alias("diff"), F.when(good & (pooled > 0), places(diff / pooled, 3)).alias("cohens_d"), F.when(good, F.round(diff / F.sqrt(se), 4)).alias("t"), F.when(good, F.round(df, 3)).alias("df"), F.when(good & (noise > 0), places(F.abs(diff) / noise, 2)).alias("diff_over_noise"), F.when(ok, F.round(noise, 4)).alias("seed_std_pooled"))


def paired(runs: DataFrame, group: list[str], condition: str, seed: str, escaped_only: bool = True) -> DataFrame:
    """Paired t of conditions over shared seeds: n, mean difference, t, and whether all differences have one sign."""
    r = runs.filter("escaped") if escaped_only else runs
    a, b = r.select(*group, seed, F.col(condition).alias("c1"), F.col("f1").alias("x")), r.select(*group, seed, F.col(condition).alias("c2"), F.col("f1").alias("y"))
    j = a.join(b, [*group, seed]).filter("c1 < c2").withColumn("d", F.col("y") - F.col("x"))
    g = j.groupBy(*group, "c1", "c2").agg(F.count("*").alias("n"), mean("d").alias("m"), F.stddev_samp("d").alias("s"), (F.min(F.signum("d")) == F.max(F.signum("d"))).alias("same_sign"))
    ok = F.col("n") >= 2
    return g.select(*group, "c1", "c2", "n", F.when(ok, "MEASURED").otherwise("NOT MEASURED").alias("status"), F.when(ok, places("m", 4)).alias("mean_diff"), F.when(ok & (F.col("s") > 0), F.round(F.col("m") / (F.col("s") / F.sqrt("n")), 4)).alias("t"), F.when(ok, F.col("same_sign")).alias("same_sign"))


def holm(df: DataFrame, p: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p over the whole (small) family; rows without p stay out of it."""
    with_p = df.filter(F.col(p).isNotNull())
    m = F.count("*").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.orderBy(p, *order)) - 1
    d = with_p.withColumn("_raw", F.least(F.lit(1.0), (m - rank) * F.col(p))).withColumn("_rank", rank)
    adj = F.max("_raw").over(Window.orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return d.withColumn("p_holm", F.round(adj, 6)).withColumn("survives", adj < alpha).drop("_raw", "_rank")


def difference_of_differences(cells: DataFrame, base: str, condition: str, bases: tuple[str, str], conditions: tuple[str, str], values: list[str]) -> DataFrame:
    """(treated - plain) of the first base less that of the second, for each value; missing arms are listed and give null."""
    def at(b: str, c: str, v: str) -> Column:
        return F.max(F.when((F.col(base) == b) & (F.col(condition) == c), F.col(v)))

    g = cells.agg(*(at(b, c, v).alias(f"{v}_{i}{k}") for v in values for i, b in enumerate(bases) for k, c in enumerate(conditions)))
    out = []
    for v in values:
        x = {(i, k): F.col(f"{v}_{i}{k}") for i in (0, 1) for k in (0, 1)}
        out.append(F.round((x[0, 1] - x[0, 0]) - (x[1, 1] - x[1, 0]), 4).alias(f"{v}_did"))
    missing = F.array_join(F.filter(F.array(*(F.when(F.col(f"{values[0]}_{i}{k}").isNull(), F.lit(f"{b}/{c}")) for i, b in enumerate(bases) for k, c in enumerate(conditions))), lambda x: x.isNotNull()), ",")
    return g.select(*out, missing.alias("missing"), F.when(missing == "", "MEASURED").otherwise("NOT MEASURED").alias("status"))


def decision_gate(plain: Column, treated: Column) -> Column:
    """Go or stop by the escaped runs of the plain and the treated condition."""
    return F.when((plain == 0) & (treated == 0), "STOP").when((treated >= 3) & (plain < 3), "RUN_STRONG").when((plain >= 3) & (treated >= 3), "RUN").otherwise("ERRATIC")


def pilot_verdict(xb: Column, xt: Column, rb: Column, rt: Column, gx: Column, gr: Column, least: float = 0.03) -> Column:
    """The pilot's ordered outcomes from escaped counts and gains (null: not measured) of two bases."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(xb + xt + rb + rt == 0, "NOTHING_LEARNED").when((rb + rt > 0) & (xb + xt == 0), "ONLY_SECOND_LEARNED").when(no((gx >= least) & (gr >= least)), "CONTROL_FAILED").when(no(gx <= -least), "NEGATIVE")
        .when(no((gx >= least) & (gr.isNull() | (F.abs(gr) < least))) | ((xt - xb >= 2) & (rt - rb <= 0)), "PREDICTED").otherwise("MIXED")
    )


def hash_bootstrap(df: DataFrame, keys: list[str], value: str, order: str, draws: int = 200) -> DataFrame:
    """95 % interval of the mean by resampling with hashed indices: the same in every engine, at any partitioning."""
    g = df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("v"))
    b = g.select(*keys, "v", F.size("v").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("b"))
    pick = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("b").cast("string"), F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    s = b.select(*keys, "n", F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda a, i: a + F.get("v", pick(i).cast("int"))).alias("t"))
    return s.groupBy(*keys).agg(F.round(F.percentile(F.col("t") / F.col("n"), F.lit(0.025)), 2).alias("lo"), F.round(F.percentile(F.col("t") / F.col("n"), F.lit(0.975)), 2).alias("hi"))


def bootstrap_mean(values: np.ndarray, draws: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """95 % interval of the mean with a PCG64 stream; one value gives itself twice."""
    if len(values) == 1:
        return float(values[0]), float(values[0])
    rng = np.random.default_rng(seed)
    means = values[rng.integers(0, len(values), size=(draws, len(values)))].mean(axis=1)
    lo, hi = np.quantile(means, [0.025, 0.975])
    return float(lo), float(hi)


def pcg_bootstrap(df: DataFrame, keys: list[str], value: str, order: str, draws: int = 2000) -> DataFrame:
    names = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = bootstrap_mean(pdf.sort_values(order)[value].to_numpy(float), draws)
        return pd.DataFrame([(*key, lo, hi)], columns=[*keys, "lo", "hi"])

    return df.select(*keys, value, order).groupBy(*keys).applyInPandas(run, f"{names}, lo double, hi double")


def bootstrap_difference(a: np.ndarray, b: np.ndarray, draws: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """95 % interval of mean(b) - mean(a), both resampled from one PCG64 stream, a first."""
    rng = np.random.default_rng(seed)
    means = [v[rng.integers(0, len(v), size=(draws, len(v)))].mean(axis=1) for v in (a, b)]
    lo, hi = np.percentile(means[1] - means[0], [2.5, 97.5])
    return float(lo), float(hi)


def difference_intervals(runs: DataFrame, group: list[str], condition: str, value: str, order: str, draws: int = 10_000) -> DataFrame:
    """Intervals of the difference of the escaped runs' means for each pair of conditions; null under two runs an arm. Cells hold a few runs each."""
    lists = runs.filter("escaped").groupBy(*group, condition).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("v"))

    @F.pandas_udf("lo double, hi double")
    def both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = [bootstrap_difference(np.asarray(x, float), np.asarray(y, float), draws) if min(len(x), len(y)) >= 2 else (None, None) for x, y in zip(a, b)]
        return pd.DataFrame(out, columns=["lo", "hi"], dtype="float64")

    p = pairs(lists, group, condition).withColumn("i", both("a_v", "b_v"))
    return p.select(*group, "c1", "c2", F.round("i.lo", 4).alias("lo"), F.round("i.hi", 4).alias("hi"), ((F.col("i.lo") > 0) | (F.col("i.hi") < 0)).alias("excludes_zero"))


def cell_details(runs: DataFrame, keys: list[str]) -> DataFrame:
    """What a cell's summary holds besides: runs that escaped and fell back, the rate of those that stayed, the source stage's degenerate runs and mean, and the runs' places."""
    g = runs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("escaped") & F.col("collapsed")).alias("n_escaped_then_collapsed"), F.count_if(F.col("escaped") & ~F.col("collapsed")).alias("s"),
        F.count_if(F.coalesce("tr_stage_degenerate", F.lit(False))).alias("n_tr_stage_degenerate"), places(mean("tr_stage_macro_f1"), 4).alias("tr_stage_macro_f1_mean"), F.array_join(F.sort_array(F.collect_list("source_path")), ";").alias("source_paths"),
    )
    lo, hi = wilson(F.col("s"), F.col("n"))
    return g.select(*keys, "n", "n_escaped_then_collapsed", F.round(F.col("s") / F.col("n"), 4).alias("escape_rate_sustained"), F.round(lo, 4).alias("sustained_lo"), F.round(hi, 4).alias("sustained_hi"), "n_tr_stage_degenerate", "tr_stage_macro_f1_mean", "source_paths")


def test_table(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Descriptive table of the test split: escaped of all, mean test score of the escaped and of all runs, mean validation score of the escaped, mean matched delta."""
    g = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("escaped").alias("k"), mean(F.when(F.col("escaped"), F.col("test_macro_f1"))).alias("c"), mean("test_macro_f1").alias("a"), mean(F.when(F.col("escaped"), F.col("selected_validation_macro_f1"))).alias("v"), mean("delta_test_minus_validation_matched").alias("d"))
    return g.select(*keys, "n", F.concat_ws("/", "k", "n").alias("escaped"), places("c", 4).alias("test_f1_conditional"), places("a", 4).alias("test_f1_all"), places("v", 4).alias("validation_f1_conditional"), places("d", 4).alias("delta_mean"))


def _apart(runs: DataFrame, group: list[str], condition: str, seed: str) -> DataFrame:
    """Pairs c1 < c2 of conditions on shared seeds: validation and test differences."""
    side = lambda c, k: runs.select(*group, seed, F.col(condition).alias(c), F.col("selected_validation_macro_f1").alias(f"v{k}"), F.col("test_macro_f1").alias(f"t{k}"))
    return side("c1", 1).join(side("c2", 2), [*group, seed]).filter("c1 < c2").select(*group, "c1", "c2", (F.col("v2") - F.col("v1")).alias("v"), (F.col("t2") - F.col("t1")).alias("t"))


def test_contrasts(runs: DataFrame, group: list[str], condition: str, seed: str) -> DataFrame:
    """Each pair of conditions on validation and on test rows: mean differences over the seeds that escaped in both (null without any), whether they have one sign, and differences of all runs' means."""
    keys = [*group, "c1", "c2"]
    shared = _apart(runs.filter("escaped"), group, condition, seed).groupBy(*keys).agg(F.count("*").alias("n_shared"), places(mean("v"), 4).alias("d_val"), places(mean("t"), 4).alias("d_test"))
    cells = runs.groupBy(*group, condition).agg(mean("selected_validation_macro_f1").alias("v"), mean("test_macro_f1").alias("t"))
    every = pairs(cells, group, condition).select(*keys, places(F.col("b_v") - F.col("a_v"), 4).alias("d_val_all"), places(F.col("b_t") - F.col("a_t"), 4).alias("d_test_all"))
    same = F.signum("d_val") == F.signum("d_test")
    return every.join(shared, keys, "left").select(*keys, F.coalesce("n_shared", F.lit(0)).alias("n_shared"), "d_val", "d_test", same.alias("same_sign"), "d_val_all", "d_test_all")


def _and_all(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn(by, F.explode(F.array(F.col(by), F.lit("ALL"))))


def generalisation_gap(runs: DataFrame, by: str) -> DataFrame:
    """Test less validation score of the same weights, for each group and for ALL: runs, mean, median, deviation, least, most, and how many are below nil."""
    d = _and_all(runs.filter(F.col("delta_test_minus_validation_matched").isNotNull()).select(by, F.col("delta_test_minus_validation_matched").alias("d")), by)
    g = d.groupBy(by).agg(F.count("*").alias("n"), places(mean("d"), 4).alias("mean"), F.round(F.stddev_samp("d"), 4).alias("sd"), F.min("d").alias("min"), F.max("d").alias("max"), F.count_if(F.col("d") < 0).alias("negative"))
    mid = order.percentiles(d, [by], "d", {"m": 0.5}).select(by, places("m", 4).alias("median"))
    return g.join(F.broadcast(mid), by).select(by, "n", "mean", "median", "sd", "min", "max", "negative")


def sign_agreement(contrasts: DataFrame, by: str, clear: float = 0.01) -> DataFrame:
    """Of test_contrasts, for each group and for ALL: pairs with shared seeds whose differences have one sign, the same among those of ``clear`` size on validation, Pearson's r, and the ratio of the mean sizes."""
    c = _and_all(contrasts.filter("n_shared > 0"), by)
    big = F.abs("d_val") >= clear
    g = c.groupBy(by).agg(F.count("*").alias("n"), F.count_if("same_sign").alias("agree"), F.count_if(big).alias("n_clear"), F.count_if(big & F.col("same_sign")).alias("agree_clear"), F.corr("d_val", "d_test").alias("r"), F.try_divide(F.sum(F.abs("d_test")), F.sum(F.abs("d_val"))).alias("ratio"))
    return g.select(by, "n", "agree", "n_clear", "agree_clear", F.round("r", 4).alias("r"), F.round("ratio", 3).alias("ratio"))


def paired_p(report: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``paired``'s rows with the two-sided p of their t over n - 1 degrees of freedom, null where nothing is measured."""
    d = report.withColumn("p", F.round(student_p_column(F.col("t").cast("double"), (F.col("n") - 1).cast("double")), 5))
    return d.withColumn("significant", F.col("p") < alpha)


def survival(health: DataFrame, least: float = 0.01) -> DataFrame:
    """(base, accuracy) of remade models: how many of them still predict, and what that says."""
    g = health.agg(F.count("*").alias("n"), F.count_if(F.coalesce("accuracy", F.lit(0.0)) < least).alias("dead"))
    return g.select("n", "dead", F.when(F.col("dead") == 0, "SURVIVED").when(F.col("dead") == F.col("n"), "ALL_DESTROYED").otherwise("SOME_DESTROYED").alias("verdict"))


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t by the continued fraction of the incomplete beta function."""
    if not (math.isfinite(t) and df > 0):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def student_p_column(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_p(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype="float64")


def steadiness(steps: DataFrame, keys: list[str], warm: int = 2) -> DataFrame:
    """Of each run, the second half's mean over the first half's after the warm-up; over 1.3 degrades."""
    w = Window.partitionBy(*keys)
    d = steps.withColumn("r", F.row_number().over(w.orderBy("step"))).filter(F.col("r") > warm).withColumn("n", F.count("*").over(w))
    g = d.groupBy(*keys).agg(mean(F.when(F.col("r") - warm <= F.floor(F.col("n") / 2), F.col("f1"))).alias("a"), mean(F.when(F.col("r") - warm > F.floor(F.col("n") / 2), F.col("f1"))).alias("b"))
    r = F.when(F.col("a") > 0, F.round(F.col("b") / F.col("a"), 4))
    return g.select(*keys, r.alias("ratio"), F.when(r > 1.3, "DEGRADING").when(r.isNotNull(), "STABLE").alias("state"))
