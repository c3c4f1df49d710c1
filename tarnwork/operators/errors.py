"""A taxonomy of prediction errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import text as T

#: Tokens a word above which an error counts as one of morphology.
MORPHOLOGY = 4.0
#: Marks stripped from words before they are looked up.
MARKS = ".,!?;:()\"'"


def classify(text: Column, n_tokens: Column, false_friends: list[str], technical: list[str]) -> Column:
    """First that holds: a false friend, a technical word, many tokens a word, other."""
    words = T.split_words(F.lower(text))
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"""^[.,!?;:()"']+|[.,!?;:()"']+$""", ""))
    has = lambda lex: F.arrays_overlap(bare, F.array(*map(F.lit, lex)))
    return F.when(has(false_friends), "false_friend").when(has(technical), "technical").when(n_tokens / F.greatest(F.size(words), F.lit(1)) > MORPHOLOGY, "morphology").otherwise("other")


def explode_predictions(runs: DataFrame) -> DataFrame:
    """(condition, gold, pred: arrays) -> a row for each position where they differ."""
    x = runs.select("condition", F.posexplode(F.arrays_zip("gold", "pred")).alias("pos", "z"))
    return x.select("condition", "pos", "z.gold", "z.pred").filter("gold <> pred")


def rates(runs: DataFrame) -> DataFrame:
    """(condition, gold, pred: arrays) -> of each condition the predictions, the errors and their rate in percent."""
    x = runs.select("condition", F.explode(F.arrays_zip("gold", "pred")).alias("z"))
    g = x.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.col("z.gold") != F.col("z.pred")).alias("errors"))
    return g.withColumn("rate_pct", F.round(100.0 * F.col("errors") / F.col("n"), 2))


def rates_of_rows(predictions: DataFrame) -> DataFrame:
    """The same of a row for each prediction (condition, gold, pred)."""
    g = predictions.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.col("gold") != F.col("pred")).alias("errors"))
    return g.withColumn("rate_pct", F.round(100.0 * F.col("errors") / F.col("n"), 2))


def shares(errors: DataFrame, by: str) -> DataFrame:
    g = errors.groupBy(by, "category").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    return g.select(by, "category", "n", F.round(100.0 * F.col("n") / total, 2).alias("share_pct"))


def sample(errors: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n errors of each group, for reading by hand."""
    return errors.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_r") <= n).drop("_r")
