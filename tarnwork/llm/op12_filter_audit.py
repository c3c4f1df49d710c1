"""Filter interaction audit: what each filter takes in every order of the filters, by an incidence matrix product.

Five filters give each document a mask of the filters that it fails. Whatever the order, a document's fate follows from its
mask alone, so it is enough to count documents by part and mask, three times: all, those labelled good, those labelled toxic.
These histograms, stacked, are an integer matrix with 32 columns. For each outcome (kept, removed, redundant, unique) a 0/1
matrix says for each of the 32 masks and 600 pairs of order and step whether it counts; the product holds all results.

Filters A to D are expressions on the text. E (a copy of a smaller id's text) needs no join and no group of copies in one place:
rows are added up by digest, part, mask and labels first, each sum with its smallest id and how many rows have it, and a digest's
smallest id is sought among these sums. A digest has as many sums as parts, masks and labels that it is found with, however often it is copied.

Null texts are empty ones. Null sources are the part named by the empty string, with empty sources. Rows without an id fail E never and have
no labels; rows that repeat an id count each, and none of them is a copy of the others. A label that repeats an id counts if any of its rows
has it. Without documents the result is empty. Other columns are ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm import common

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
MASKS = 1 << len(FILTERS)
#: The limits of the filters A, B, C (in words and percent) and the characters of D.
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 2, "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts whose histograms are multiplied at once: each gives STEPS rows.
PARTS = 64


def matrices() -> dict[str, np.ndarray]:
    """Of each outcome the MASKS x STEPS matrix, column 5 * order + step - 1; and "filter", MASKS x 5, by how many of the orders a mask's document falls to each filter."""
    bit = np.array([[1 << FILTERS.index(f) for f in o] for o in ORDERS], np.int64)
    before = (np.cumsum(bit, axis=1) - bit).ravel()
    own, mask = bit.ravel(), np.arange(MASKS, dtype=np.int64)[:, None]
    fails, fell = (mask & own) > 0, (mask & before) > 0
    out = {"kept": (mask & (before | own)) == 0, "removed": fails & ~fell, "redundant": fails & fell, "unique": mask == own}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    out["filter"] = out["removed"] @ (own[:, None] == 1 << np.arange(len(FILTERS))).astype(np.int64)
    return out


def failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails: bit 0 is A."""
    words = F.array_remove(F.split(text, common.WORD_SPLIT), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    size = F.char_length(text)
    upper = size - F.char_length(F.translate(text, UPPER, ""))
    fails = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n, 100 * upper.cast("long") > MAX_UPPER * size, text.rlike(f"[{SYMBOLS}]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def sums(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, part, text), labels (doc_id, quality, toxic) -> part, mask (of A to D), good, toxic, n (rows) and first (those that don't fail E)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "part", failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rated = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == v), F.lit(False)).alias(c) for c, v in (("quality", 1), ("toxic", 1))))
    marks = [F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    keys = ["part", "mask", "good", "toxic"]
    named = rows.filter(F.col("doc_id").isNotNull()).join(rated, "doc_id", "left").select("doc_id", "digest", "part", "mask", *marks)
    each = named.groupBy("doc_id", "digest", *keys).agg(F.count("*").alias("c"))
    alike = each.groupBy("digest", *keys).agg(F.sum("c").alias("n"), F.min("doc_id").alias("least"), F.min_by("c", "doc_id").alias("c"))
    is_first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    alike = alike.select(*keys, "n", F.when(is_first, F.col("c")).otherwise(0).alias("first"))
    nameless = rows.filter(F.col("doc_id").isNull()).select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("first"))
    return alike.unionByName(nameless).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("first").alias("first"))


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, part, text), labels (doc_id, quality, toxic) -> a row for each part, order and step."""
    counts = F.collect_list(F.struct("mask", "good", "toxic", "n", "first"))  # at most 64 of a part
    parts = sums(docs, labels).groupBy("part").agg(counts.alias("counts"))
    return parts.mapInArrow(_products, RESULT)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by, copy = matrices(), 1 << FILTERS.index("E")
    fate = np.concatenate([by[k] for k in ("kept", "removed", "redundant", "unique")], axis=1)
    orders = np.repeat(np.array(ORDERS, object), len(FILTERS))
    filters = np.array([FILTERS.index(f) for o in ORDERS for f in o])
    steps = np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS))
    for batch in batches:
        for i in range(0, batch.num_rows, PARTS):
            names, stack = batch.column(0)[i : i + PARTS].to_pylist(), []
            for counts in batch.column(1)[i : i + PARTS].to_pylist():
                rows = np.zeros((3, MASKS), np.int64)  # all, good, toxic
                for c in counts:
                    for row, counted in zip(rows, (True, c["good"], c["toxic"])):
                        if counted:
                            row[c["mask"]] += c["first"]
                            row[c["mask"] | copy] += c["n"] - c["first"]
                stack.append(rows)
            rows = np.stack(stack)
            kept, removed, redundant, unique = np.split(rows[:, 0] @ fate, 4, axis=1)
            lost = rows[:, 1:].reshape(-1, MASKS) @ by["removed"]
            shapley = (rows[:, 0] @ by["filter"])[:, filters]
            n = len(names)
            values = [kept, removed, redundant, unique, lost[0::2], lost[1::2], shapley]
            cols = [np.repeat(np.array(names, object), STEPS), np.tile(orders, n), np.tile(steps, n).astype(np.int32), *(v.ravel() for v in values)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return audit(docs, common.table(spark, sf_dir, "labels"))


_WORD = r"[^\x20\x09-\x0D]"
_BIT = lambda f: f"(1 << (ascii({f}) - 65))"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < {MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT} * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_UPPER} * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[{SYMBOLS}]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN l USING (doc_id)),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM m GROUP BY ALL),
f AS (SELECT unnest(string_split('A B C D E', ' ')) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT array_to_string(o, '') AS filter_order, step, o[step] AS f, {_BIT('o[step]')} AS own, list_sum(list_transform(o[1:step], lambda z: {_BIT('z')})) AS upto FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (WHERE mask & upto = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & upto = own), 0) AS removed, coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & upto <> own), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails, coalesce(sum(g) FILTER (WHERE mask & upto = own), 0) AS good_lost, coalesce(sum(x) FILTER (WHERE mask & upto = own), 0) AS toxic_lost FROM h, (SELECT filter_order, step, f, cast(own AS bigint) AS own, cast(upto AS bigint) AS upto FROM s) GROUP BY ALL)
SELECT part, filter_order, cast(step AS int) AS step, cast(kept AS bigint) AS kept, cast(removed AS bigint) AS removed, cast(redundant AS bigint) AS redundant, cast(unique_fails AS bigint) AS unique_fails,
  cast(good_lost AS bigint) AS good_lost, cast(toxic_lost AS bigint) AS toxic_lost, cast(sum(removed) OVER (PARTITION BY part, f) AS bigint) AS shapley FROM r"""
