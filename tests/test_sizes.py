"""Long texts and large tables: what once took time or memory with the square of a size, against plain Python."""

import hashlib
import time

from pyspark.sql import functions as F

import __spark_entry__
from tarnwork.functions import text as T
from tarnwork.operators import corpus


def masked(words, key):
    h = {i: hashlib.md5(f"17:{key}:{i}".encode()).hexdigest()[:8] for i, w in enumerate(words) if len(w) >= 2}
    return [i for i, x in h.items() if x < "26666666"] or sorted(h, key=lambda i: (h[i], i))[:1]


def documents(spark, tmp_path):
    texts = [" ".join(f"w{i % 977}" if i % 3 else "x" for i in range(20_000)), "a bc", "a b", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return texts


def test_masks_of_a_long_text(spark, tmp_path):
    texts = documents(spark, tmp_path)
    start = time.time()
    got = {r["doc_id"]: tuple(r)[1:] for r in __spark_entry__.queries()["mask_counts"](spark, str(tmp_path)).collect()}
    assert time.time() - start < 30  # with the square of the words it took minutes
    want = {i: masked(t.split(), i) for i, t in enumerate(texts) if t is not None}
    assert got == {i: (len(texts[i].split()), len(m), min(m, default=None)) for i, m in want.items()} | {4: (None, 0, None)}


def test_masks_bar_by_place(spark):
    """An array of marks that is shorter or longer than the tokens."""
    d = spark.createDataFrame([("a b c d", [True]), ("a b", [None, True, False])], "t string, s array<boolean>").select(T.split_words(F.col("t")).alias("w"), "s")
    got = [r[0] for r in d.select(corpus.mask_positions(F.col("w"), F.col("s"), F.lit("k"), part=0.999999)).collect()]
    assert got == [[1, 2, 3], [0]]


def test_baseline_of_a_long_text(spark, tmp_path):
    texts = documents(spark, tmp_path)
    start = time.time()
    row = __spark_entry__.queries()["bpc_baseline"](spark, str(tmp_path)).first()
    assert time.time() - start < 30
    assert row["masked"] == sum(len(masked((t or "").split(), i)) for i, t in enumerate(texts)) and row["tokens"] == sum(len((t or "").split()) for t in texts)


def test_masked_words_are_counted_as_rows(spark):
    """The counts of the masks by place; rows of a few words often have none chosen, and some have only barred ones."""
    texts = [" ".join(f"w{i * k % 7}" if i % 4 else "x" for i in range(k % 9)) for k in range(300)] + ["x x x", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", T.split_words(F.col("t")).alias("w"))
    counts = corpus.masked_word_counts(d, "id", "w", lambda y: F.char_length(y) < 2)
    want: dict = {}
    for i, t in enumerate(texts):
        words = (t or "").split()
        at = set(masked(words, i))
        for k, w in enumerate(words):
            n, m = want.get(w, (0, 0))
            want[w] = n + 1, m + (k in at)
    assert {r["word"]: (r["n"], r["masked"]) for r in counts.collect()} == want


def test_baseline_without_words(spark, tmp_path):
    spark.createDataFrame([(1, " ", "en", "s", 1), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    row = __spark_entry__.queries()["bpc_baseline"](spark, str(tmp_path)).first()
    assert row["chars"] == 1 and row["random_guess"] is None and row["bpc"] is None


def test_intervals_in_parts(spark, monkeypatch):
    """Draws made in parts, however long the sheet, are those of one call; against plain numpy."""
    import numpy as np

    from tarnwork.operators import audit

    labels = F.array(*map(F.lit, ("positive", "negative", "neutral")))
    sheet = lambda n: spark.range(n).select(F.lit("x").alias("pair"), "id", F.get(labels, F.pmod(F.xxhash64("id"), F.lit(3)).cast("int")).alias("a"), F.get(labels, F.pmod(F.xxhash64("id") + F.col("id") % 2, F.lit(3)).cast("int")).alias("b"))
    monkeypatch.setattr(audit, "PICKS", 64)
    d = sheet(500)
    rows = d.orderBy("id").collect()
    x, y = (np.array([["positive", "negative", "neutral"].index(r[c]) for r in rows]) for c in ("a", "b"))
    pick = np.random.default_rng(0).integers(0, 500, size=(300, 500))
    same = (x[pick] == y[pick]).mean(1)
    chance = sum((x[pick] == c).mean(1) * (y[pick] == c).mean(1) for c in range(3))
    want = [round(float(v), 4) for z in (100 * same, (same - chance) / (1 - chance)) for v in np.percentile(z, [2.5, 97.5])]
    assert audit.agreement_intervals(d.repartition(3), ["pair"], "a", "b", "id", 300).collect() == [("x", *want)]
