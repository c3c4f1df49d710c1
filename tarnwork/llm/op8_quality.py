"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text gets word, symbol, line and repetition counts. For each language and source a quantile sketch of each
of MEASURES is built over all texts that pass the fixed base rules: a histogram over buckets whose bounds
grow by GROWTH, so a quantile is right to that factor. Such sketches are merged by adding counts, and they are
the same in every run and partitioning.

A group's quantiles are drawn towards those of its language, and these towards the whole corpus's, as if the
parent had SHRINK texts in the group: small groups mostly follow their parent, large ones themselves, and no
size switches anything. The upper limit of a share is the last of the group's quantiles from the median up to
99 % below its first gap: a step to the next quantile of more than

    SPREAD * (q - q25) + DEVIATIONS standard errors of q in a text of the group's median size.

So what is usual in a group stays, to its 99 % quantile, and a tail that is cut off from the rest doesn't lift the
limit, whether it begins at 60 % or at 98 %. Zeros have a bucket of their own; where nearly all texts have none of
a thing, the limit is zero. Word length has limits SPREAD quartile ranges above q75 and below q25. Limits are joined back by language and
source. A text goes if it is over a limit by more than chance allows in a text of its size: DEVIATIONS
standard errors of its count (for word length, of the mean of its words, if these vary by half the median).

Null text has no words and fails the base rules. Null language or source is a group of its own; a group without
a text that passes the base rules has its parent's limits. Repeated rows count each. Without rows there are no
groups and the result is empty. Other columns are ignored, whatever their names. Texts of any length are read whole,
in memory that grows with the longest one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm import common

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: Base rule: repeated words in percent of the words at most.
MAX_REPEATED = 20
SHRINK, SPREAD, DEVIATIONS = 50.0, 3.0, 4.0
#: Quantiles of a sketch in percent; those from the median on are the steps that limits of shares climb.
LEVELS = [25, *range(50, 96, 5), 99]
MEDIAN, THIRD = LEVELS.index(50), LEVELS.index(75)
#: Factor between the bounds of a sketch's buckets.
GROWTH = 1.01
#: Share -> (count, size, what one occurrence adds to the count: a repetition both of its windows).
SHARES = {"symbol_share": ("n_symbols", "word_chars", 1), "dup_line_share": ("n_dup_lines", "n_lines", 1), "repeat_share": ("n_repeat_words", "n_words", 2 * WINDOW)}
MEASURES = [*SHARES, "word_length", "word_chars", "n_lines", "n_words"]
LIMITS = [*(f"up_{m}" for m in SHARES), "up_word_length", "lo_word_length"]
#: Bucket of zero, below all others.
ZERO = -(1 << 20)


def counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, common.SPACE_CHARS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, common.SPACE_CHARS, "") != "")
    base = docs.select(*keep, common.words_of(text).alias("_w"), lines.alias("_l"), F.char_length(bare).cast("long").alias("word_chars"), (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    grams = F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>"))
    base = base.select(*keep, "word_chars", "n_symbols", F.size("_w").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), grams.alias("_g"))
    # only texts with a repeated window go on to the places of its windows
    base = base.withColumn("_g", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    near = lambda k: F.coalesce(F.get("_g", k)["g"], F.lit(None).cast("long"))
    twice = F.filter("_g", lambda e, k: (F.when(k > 0, near(k - 1)).eqNullSafe(e["g"])) | near(k + 1).eqNullSafe(e["g"]))
    base = base.withColumn("_p", F.sort_array(F.transform(twice, lambda e: e["i"]))).drop("_g")
    # a window covers its words up to the next repeated window's start
    base = base.withColumn("_c", F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)))))
    covered = F.coalesce(F.aggregate("_c", F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return base.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def shares(df: DataFrame) -> DataFrame:
    df = df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    for m, (count, size, _) in SHARES.items():
        df = df.withColumn(m, F.col(count) / F.greatest(size, F.lit(1)).cast("double"))
    return df.withColumn("word_length", F.col("word_chars") / F.greatest("n_words", F.lit(1)).cast("double"))


def bucket(value: Column) -> Column:
    """The bucket of a value: its logarithm to the base GROWTH, rounded down."""
    return F.when(value > 0, F.floor(F.ln(value) / F.lit(math.log(GROWTH)))).otherwise(F.lit(ZERO)).cast("int")


def value_of(bucket_: Column) -> Column:
    """The middle of a bucket."""
    return F.when(bucket_ == ZERO, 0.0).otherwise(F.exp((bucket_ + 0.5) * F.lit(math.log(GROWTH))))


def sketches(measured: DataFrame, group: list[str]) -> DataFrame:
    """Of each group and measure the histogram over all texts that pass the base rules: group, measure, b, n."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m).cast("double")).alias("b")) for m in MEASURES)))
    return measured.filter(~F.col("base_failed")).select(*group, each.alias("s")).groupBy(*group, "s.measure", "s.b").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """group, measure, n (texts) and the array q of the quantiles at LEVELS."""
    keys = [*group, "measure"]
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("b"))
    of = F.sum("n").over(Window.partitionBy(*keys))
    ranked = sketch.withColumn("upto", upto).withColumn("of", of)
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("of") * k, F.col("b"))) for k in LEVELS]
    return ranked.groupBy(*keys).agg(F.max("of").alias("n"), F.array(*map(value_of, at)).alias("q"))


def _drawn(own: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Quantiles of ``own`` drawn towards their parent's, joined by ``on`` (nulls equal) and the measure; rows without own ones have the parent's."""
    cond = F.col("o.measure") == F.col("p.measure")
    for c in on:
        cond = cond & F.col(f"o.{c}").eqNullSafe(F.col(f"p.{c}"))
    j = own.alias("o").join(parent.select(*on, "measure", F.col("q").alias("pq")).alias("p"), cond).select("o.*", "pq")
    weight = F.coalesce("n", F.lit(0)).cast("double")
    return j.withColumn("q", F.when(F.col("q").isNull(), F.col("pq")).otherwise(F.zip_with("q", "pq", lambda a, b: (weight * a + SHRINK * b) / (weight + SHRINK)))).drop("pq")


def limits(measured: DataFrame, group: list[str]) -> DataFrame:
    """A row for each (language, source) with the limits LIMITS; none if no text at all passes the base rules."""
    first = group[0]
    sketch = common.materialise(sketches(measured, group), "sketches")
    merged = lambda by: sketch.groupBy(*by, "measure", "b").agg(F.sum("n").alias("n"))
    whole = quantiles(merged([]), [])
    by_first = _drawn(quantiles(merged([first]), [first]), whole, [])
    names = measured.select(*group).distinct()
    all_names = names.select(*group, F.explode(F.array(*map(F.lit, MEASURES))).alias("measure"))
    found = quantiles(sketch, group)
    same = F.col("a.measure") == F.col("f.measure")
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}"))
    own = all_names.alias("a").join(found.alias("f"), same, "left").select(*(F.col(f"a.{c}") for c in group), "a.measure", "f.n", "f.q")
    # a language without any text that passes has the corpus's
    firsts = names.select(first).distinct().select(first, F.explode(F.array(*map(F.lit, MEASURES))).alias("measure"))
    known = F.col("a.measure").eqNullSafe(F.col("f.measure")) & F.col(f"a.{first}").eqNullSafe(F.col(f"f.{first}"))
    by_first = firsts.alias("a").join(by_first.alias("f"), known, "left").select(f"a.{first}", "a.measure", "f.q")
    by_first = by_first.alias("a").join(whole.select("measure", F.col("q").alias("wq")).alias("w"), F.col("a.measure") == F.col("w.measure")).select(first, "a.measure", F.coalesce("q", "wq").alias("q"))
    drawn = _drawn(own, by_first, [first])
    at = lambda m: F.max(F.when(F.col("measure") == m, F.col("q")))
    flat = drawn.groupBy(*group).agg(*(at(m).alias(f"q_{m}") for m in MEASURES))
    q = lambda m, k: F.get(f"q_{m}", F.lit(k))
    ups = [below_gap([q(m, k) for k in range(len(LEVELS))], F.greatest(F.lit(1.0), q(size, MEDIAN)), unit).alias(f"up_{m}") for m, (_, size, unit) in SHARES.items()]
    length = SPREAD * (q("word_length", THIRD) - q("word_length", 0))
    return flat.select(*group, *ups, (q("word_length", THIRD) + length).alias("up_word_length"), (q("word_length", 0) - length).alias("lo_word_length"), q("word_length", MEDIAN).alias("mid_word_length"))


def below_gap(q: list[Column], size: Column, unit: int) -> Column:
    """The last of the quantiles from the median on before the first step that is wider than the span below it and chance explain."""
    out = q[-1]
    for here, above in reversed(list(zip(q[MEDIAN:], q[MEDIAN + 1 :]))):
        error = F.sqrt(F.greatest(here * size, F.lit(float(unit))) * unit) / size
        out = F.when(above - here > SPREAD * (here - q[0]) + DEVIATIONS * error, here).otherwise(out)
    return out


def clearly_over() -> Column:
    """Whether a measured row, with its group's limits, is beyond one of them by more than chance allows."""
    out = F.lit(False)
    for m, (count, size, unit) in SHARES.items():
        most = F.col(f"up_{m}") * F.col(size)
        out = out | (F.col(count) > most + DEVIATIONS * F.sqrt(F.greatest(most, F.lit(float(unit))) * unit))
    error = DEVIATIONS * F.col("mid_word_length") / 2 / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double"))
    return out | (F.col("word_length") > F.col("up_word_length") + error) | (F.col("word_length") < F.col("lo_word_length") - error)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """A row for each document: counts, base_failed, kept, shares and limits."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    measured = common.materialise(shares(counts(df, ["doc_id", "_lang", "_source"], "_text")), "measured")
    limit = limits(measured, ["_lang", "_source"]).alias("t")
    out = measured.alias("m").join(limit, F.col("m._lang").eqNullSafe(F.col("t._lang")) & F.col("m._source").eqNullSafe(F.col("t._source")), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(clearly_over(), F.lit(False))
    return out.select("m.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *SHARES, "word_length", *LIMITS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(c, 6).alias(c) for c in LIMITS))


_WORD = r"[^\x20\x09-\x0D]"
_LN = f"cast('{math.log(GROWTH)!r}' AS double)"
_Q = ", ".join(f"min(CASE WHEN upto * 100 >= n * {k} THEN b END) AS b{k}" for k in LEVELS)
_V = ", ".join(f"CASE WHEN b{k} = {ZERO} THEN 0.0 ELSE exp((b{k} + 0.5) * {_LN}) END AS q{k}" for k in LEVELS)


def _quantiles(by: str) -> str:
    keys = ", ".join([*by.split(), "measure"])
    return f"""(SELECT {keys}, n, {_V} FROM (SELECT {keys}, max(n) AS n, {_Q} FROM (SELECT {keys}, b, sum(c) OVER (PARTITION BY {keys} ORDER BY b) AS upto, sum(c) OVER (PARTITION BY {keys}) AS n
FROM (SELECT {keys}, b, sum(c) AS c FROM sk GROUP BY ALL)) GROUP BY {keys}))"""


_DRAWN = ", ".join(f"CASE WHEN o.q{k} IS NULL THEN p.q{k} ELSE (coalesce(o.n, 0) * o.q{k} + cast({SHRINK} AS double) * p.q{k}) / (coalesce(o.n, 0) + cast({SHRINK} AS double)) END AS q{k}" for k in LEVELS)
_QS = ", ".join(f"q{k}" for k in LEVELS)
_AT = ", ".join(f"max(CASE WHEN measure = '{m}' THEN q{k} END) AS {m}_{k}" for m in MEASURES for k in LEVELS)
def _below_gap(m: str, size: str, unit: int) -> str:
    size = f"greatest(1.0, {size}_50)"
    steps = zip(LEVELS[MEDIAN:], LEVELS[MEDIAN + 1 :])
    whens = " ".join(f"WHEN {m}_{b} - {m}_{a} > {SPREAD} * ({m}_{a} - {m}_25) + {DEVIATIONS} * sqrt(greatest({m}_{a} * {size}, {unit}) * {unit}) / {size} THEN {m}_{a}" for a, b in steps)
    return f"CASE {whens} ELSE {m}_{LEVELS[-1]} END AS up_{m}"


_UPS = ", ".join(_below_gap(m, size, unit) for m, (_, size, unit) in SHARES.items())
_OVER = " OR ".join(f"{count} > up_{m} * {size} + {DEVIATIONS} * sqrt(greatest(up_{m} * {size}, {unit}) * {unit})" for m, (count, size, unit) in SHARES.items())
_ERROR = f"{DEVIATIONS} * word_length_50 / 2 / sqrt(cast(greatest(n_words, 1) AS double))"
SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
y AS (SELECT doc_id, i, x || {" || ".join(f"' ' || lead(x, {k}) OVER o" for k in range(1, WINDOW))} AS s FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, list(i) AS places FROM y WHERE s IS NOT NULL GROUP BY doc_id, s HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT doc_id, unnest(places) AS i FROM g)) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars, cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
  cast(len(l) AS bigint) AS n_lines, cast(len(l) - len(list_distinct(l)) AS bigint) AS n_dup_lines, cast(coalesce(r.n, 0) AS bigint) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
m AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed, {", ".join(f"{count} / cast(greatest({size}, 1) AS double) AS {m}" for m, (count, size, _) in SHARES.items())}, word_chars / cast(greatest(n_words, 1) AS double) AS word_length FROM c),
sk AS MATERIALIZED (SELECT lang, source, measure, CASE WHEN v > 0 THEN cast(floor(ln(v) / {_LN}) AS int) ELSE {ZERO} END AS b, count(*) AS c FROM (
  {" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, cast({m} AS double) AS v FROM m WHERE NOT base_failed" for m in MEASURES)}) GROUP BY ALL),
qa AS {_quantiles("")}, ql AS {_quantiles("lang")}, qo AS {_quantiles("lang source")},
names AS (SELECT * FROM (SELECT DISTINCT lang, source FROM m), (SELECT unnest({MEASURES!r}) AS measure)),
dl AS (SELECT o.lang, p.measure, {_DRAWN} FROM (SELECT x.lang, x.measure, n, {_QS} FROM (SELECT DISTINCT lang, measure FROM names) x LEFT JOIN ql ON x.lang IS NOT DISTINCT FROM ql.lang AND x.measure = ql.measure) o JOIN qa p ON o.measure = p.measure),
d AS (SELECT o.lang, o.source, p.measure, {_DRAWN} FROM (SELECT x.lang, x.source, x.measure, n, {_QS} FROM names x LEFT JOIN qo ON x.lang IS NOT DISTINCT FROM qo.lang AND x.source IS NOT DISTINCT FROM qo.source AND x.measure = qo.measure) o JOIN dl p ON o.measure = p.measure AND o.lang IS NOT DISTINCT FROM p.lang),
f AS (SELECT lang, source, {_AT} FROM d GROUP BY lang, source),
lim AS (SELECT *, {_UPS}, word_length_75 + {SPREAD} * (word_length_75 - word_length_25) AS up_word_length, word_length_25 - {SPREAD} * (word_length_75 - word_length_25) AS lo_word_length FROM f),
j AS (SELECT m.*, {", ".join(f"t.{c}" for c in LIMITS)}, word_length_50 FROM m LEFT JOIN lim t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({_OVER} OR word_length > up_word_length + {_ERROR} OR word_length < lo_word_length - {_ERROR}, false) AS kept, {", ".join(f"round({c}, 6) AS {c}" for c in LIMITS)} FROM j"""
