"""Agreement of annotators with each other and with the data set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions import text as T

#: Prefixes of an abstention, and the labels digits stand for (fixed values).
ABSTAIN = ["bilmir", "unclear", "n/a", "na", "?", "-"]
DIGITS = {"1": "positive", "2": "neutral", "3": "negative"}
#: Points: humans below this agree too little; margins of data set against humans.
TOO_SUBJECTIVE, PROCEED, CAVEAT = 60.0, 5.0, 12.0
TIERS = ["PROCEED", "PROCEED_WITH_CAVEAT", "STOP_LABELS_UNRELIABLE", "STOP_TASK_TOO_SUBJECTIVE"]
#: Columns of a blind sheet that may carry the answer (fixed values).
FORBIDDEN = ["label", "labels", "gold", "gold_label", "gold_label_name", "label_name", "verdict", "answer", "correct"]
#: Rows of undisputed meaning that tell which digit stands for which label: idx, label, digit (fixed values).
PROBES = [(38, "positive", "1"), (48, "negative", "3"), (57, "neutral", "2")]


def abstains(c: Column) -> Column:
    low = T.casefold(F.trim(c))
    out = F.lit(False)
    for p in ABSTAIN:
        out = out | low.startswith(p)
    return F.coalesce((low != "") & out, F.lit(False))


def canonical(c: Column) -> Column:
    """Blank to null, abstentions to unclear, digits to their label, else case-folded."""
    low = T.casefold(F.trim(c))
    named = low
    for k, v in DIGITS.items():
        named = F.when(low == k, v).otherwise(named)
    return F.when(low.isNull() | (low == ""), None).when(abstains(c), "unclear").otherwise(named)


def leaking_columns(df: DataFrame) -> list[str]:
    """Columns of a blind sheet that would give the answer away."""
    return [c for c in df.columns if c.casefold() in FORBIDDEN]


def is_blind(sheet: DataFrame, label: str = "your_label") -> bool:
    return sheet.filter(F.trim(F.coalesce(F.col(label), F.lit(""))) != "").isEmpty()


def agreement(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Of pairs: rows where neither abstains, percent equal, kappa (null below two labels or where chance agrees always), percent unclear in b."""
    clear = (F.col(a) != "unclear") & (F.col(b) != "unclear")
    base = pairs.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(clear).alias("n"), F.count_if(clear & (F.col(a) == F.col(b))).alias("agree"), F.count_if(F.col(b) == "unclear").alias("unclear"))
    long = pairs.filter(clear).select(*by, F.explode(F.array(F.struct(F.col(a).alias("l"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col(b).alias("l"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("m"))
    m = long.groupBy(*by, "m.l").agg(F.sum("m.x").alias("x"), F.sum("m.y").alias("y"))
    chance = m.groupBy(*by).agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.count("*").alias("labels"))
    j = base.join(chance, by, "left")
    nn = F.greatest("n", F.lit(1)).cast("double")
    po, pe = F.col("agree") / nn, F.col("xy") / (nn * nn)
    return j.select(*by, "n", F.round(100.0 * po, 2).alias("agreement_pct"), F.when((F.col("labels") >= 2) & (pe < 1), F.round((po - pe) / (1 - pe), 4)).alias("kappa"), F.round(100.0 * F.col("unclear") / F.greatest("rows", F.lit(1)), 2).alias("unclear_pct"), (100.0 * F.col("unclear") / F.greatest("rows", F.lit(1)) > 15).alias("concern"))


def class_accuracy(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Of each label of a, the rows on which b gives an answer, and the part of them that agrees."""
    g = pairs.filter(F.col(b) != "unclear").groupBy(*by, F.col(a).alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("correct"))
    return g.withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 4))


def polarity_subset(sheets: DataFrame, gold: str, a: str, b: str) -> DataFrame:
    """Rows on which the data set and both annotators name a pole, and the annotators' agreement on them in percent (null without rows)."""
    poles = F.lit(True)
    for c in (gold, a, b):
        poles = poles & ~F.col(c).isin("neutral", "unclear")
    g = sheets.filter(poles).agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("k"))
    return g.select("n", F.when(F.col("n") > 0, F.round(100.0 * F.col("k") / F.greatest("n", F.lit(1)), 2)).alias("hh_agreement_pct"))


#: Draws of one resample that are made at once.
PICKS = 1 << 20


def agreement_intervals(pairs: DataFrame, by: list[str], a: str, b: str, order: str, draws: int = 10_000) -> DataFrame:
    """95 % intervals of percent agreement and kappa over the rows that b answers, by PCG64 resampling in ``order``.

    A resample counts only how often each pair of labels is drawn, so the rows travel in order as numbers of their pairs, two bytes each (four with
    over 256 labels). PCG64's one stream makes one task of a group draw; beside those bytes it holds ``PICKS`` draws.
    """
    spark = pairs.sparkSession
    rows = pairs.filter(F.col(b) != "unclear").select(*by, order, a, b)
    names = sorted(r[0] for r in rows.select(F.explode(F.array(a, b)).alias("l")).filter("l IS NOT NULL").distinct().collect())  # the labels
    k = len(names) + 1  # null is one
    kind = "<u2" if k <= 256 else "<u4"
    place = lambda c: F.coalesce(F.array_position(F.lit(names).cast("array<string>"), F.col(c)), F.lit(0))
    at = F.col(order).asc_nulls_last()
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    coded = rows.select(*by, order, (place(a) * k + place(b)).cast("int").alias("_code")).repartitionByRange(width, *by, at).sortWithinPartitions(*by, at)

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for key, g in pdf.groupby(by, sort=False, dropna=False):
                yield pd.DataFrame([(*key, g[order].iloc[0], g["_code"].to_numpy().astype(kind).tobytes())], columns=[*by, order, "data"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        code = np.frombuffer(b"".join(pdf.sort_values(order)["data"]), kind)
        rng, n, same, kappa = np.random.default_rng(0), len(code), [], []
        for _ in range(draws):
            hits = np.zeros(k * k, np.int64)
            for first in range(0, n, PICKS):
                hits += np.bincount(code[rng.integers(0, n, size=min(PICKS, n - first))], minlength=k * k)
            hits = hits.reshape(k, k)
            po, chance = np.trace(hits) / n, float((hits.sum(1) / n * (hits.sum(0) / n)).sum())
            same.append(100.0 * po)
            kappa.append(np.nan if abs(1 - chance) < 1e-12 else (po - chance) / (1 - chance))
        out = [round(float(v), 4) for x in (same, kappa) for v in np.percentile(x, [2.5, 97.5])]
        return pd.DataFrame([(*key, *out)], columns=[*by, "agree_lo", "agree_hi", "kappa_lo", "kappa_hi"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*by).dtypes)
    parts = coded.mapInPandas(packed, f"{kinds}, {order} {dict(rows.dtypes)[order]}, data binary")
    return parts.groupBy(*by).applyInPandas(run, f"{kinds}, agree_lo double, agree_hi double, kappa_lo double, kappa_hi double")


def decompose(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Disagreements at the neutral border and flips of polarity, in percent of all disagreements."""
    dis = F.col(a) != F.col(b)
    border = dis & ((F.col(a) == "neutral") | (F.col(b) == "neutral"))
    g = pairs.groupBy(*by).agg(F.count_if(~dis).alias("agreements"), F.count_if(dis).alias("disagreements"), F.count_if(border).alias("neutral_boundary"), F.count_if(dis & ~border).alias("polarity_flip"))
    pct = lambda c: F.round(100.0 * F.col(c) / F.greatest("disagreements", F.lit(1)), 2)
    return g.select("*", pct("neutral_boundary").alias("neutral_boundary_pct"), pct("polarity_flip").alias("polarity_flip_pct"))


def tier(hd: Column, hh: Column) -> Column:
    d = hd - hh
    return F.when(d >= -PROCEED, 0).when(d >= -CAVEAT, 1).otherwise(2)


def gate(hh: Column, hd1: Column, hd2: Column) -> Column:
    """The worse annotator's tier, unless the humans agree too little."""
    worst = F.when(hh < TOO_SUBJECTIVE, 3).otherwise(F.greatest(tier(hd1, hh), tier(hd2, hh)))
    return F.get(F.array(*map(F.lit, TIERS)), worst)


def consensus(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rows on which both gave the same clear label."""
    return pairs.filter((F.col(a) == F.col(b)) & (F.col(a) != "unclear")).withColumn("consensus", F.col(a))


def probe_failures(sheets: DataFrame, probes: DataFrame) -> DataFrame:
    """(annotator, idx, label) against (idx, expected): how many fixed checks each annotator misses."""
    j = sheets.select("annotator").distinct().join(F.broadcast(probes)).join(sheets, ["annotator", "idx"], "left")
    return j.groupBy("annotator").agg(F.count("*").alias("probes"), F.count_if(~F.coalesce(F.col("label") == F.col("expected"), F.lit(False))).alias("missed"))
