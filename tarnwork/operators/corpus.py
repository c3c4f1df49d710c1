"""Corpus statistics over words and tokens: fertility, lengths, truncation, overlap of types, relatedness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import encoding
from tarnwork.functions import text as T
from tarnwork.operators import order as ranks

#: Characters of a token of the piece tokenizer, which stands in for a trained one.
PIECE = 3


def pieces(word: Column) -> Column:
    """A word as fixed-width pieces."""
    n = F.char_length(word)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int")), lambda i: F.substring(word, i * PIECE + F.lit(1), F.lit(PIECE)))


def lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words and n_tokens (pieces) of each text."""
    w = T.words(F.col(text))
    df = df.withColumn("_w", w)
    return df.select("*", F.size("_w").cast("long").alias("n_words"), F.aggregate("_w", F.lit(0), lambda a, x: a + F.ceil(F.char_length(x) / PIECE).cast("int")).cast("long").alias("n_tokens")).drop("_w")


def encoded_lengths(df: DataFrame, file, text: str = "text", unknown: int = -1) -> DataFrame:
    """``df`` with n_words (white-space separated), n_word_chars, n_tokens and n_unknown by a tokenizer file."""
    d = encoding.encoded(df.withColumn("_w", T.split_words(F.col(text))), text, file, "_ids")
    chars = F.aggregate("_w", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    return d.select(*(F.col(f"`{c}`") for c in df.columns), F.size("_w").cast("long").alias("n_words"), chars.alias("n_word_chars"), F.size("_ids").cast("long").alias("n_tokens"), F.size(F.filter("_ids", lambda i: i == unknown)).cast("long").alias("n_unknown"))


def sample_fertility(measured: DataFrame, by: str) -> DataFrame:
    """Of each group: words, tokens, tokens a word, characters of words a token, unknown tokens."""
    g = measured.groupBy(by).agg(F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_word_chars").alias("c"), F.sum("n_unknown").alias("n_unknown"))
    return g.select(by, "n_words", "n_tokens", F.round(F.col("n_tokens") / F.greatest("n_words", F.lit(1)), 3).alias("fertility"), F.round(F.col("c") / F.greatest("n_tokens", F.lit(1)), 3).alias("chars_per_token"), "n_unknown")


def truncation_between(a: DataFrame, b: DataFrame, by: str, caps: tuple[int, ...] = (128, 256)) -> DataFrame:
    """Of each group and cap the percent of texts longer than it under two setups (n_tokens), their difference, and an alarm from a point on."""
    def rates(df: DataFrame, name: str) -> DataFrame:
        long = df.select(by, "n_tokens", F.explode(F.array(*map(F.lit, caps))).alias("cap"))
        return long.groupBy(by, F.col("cap").cast("long").alias("cap")).agg(F.round(100.0 * F.count_if(F.col("n_tokens") > F.col("cap")) / F.count("*"), 2).alias(name))

    delta = F.round(F.col("pct_b") - F.col("pct_a"), 2)
    return rates(a, "pct_a").join(rates(b, "pct_b"), [by, "cap"]).select(by, "cap", "pct_a", "pct_b", delta.alias("delta"), (F.abs(delta) >= 1.0).alias("alarm"))


def fertility(measured: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Tokens a word: over all words, and over texts (those without words left out); rounded."""
    # texts with the same counts of words and tokens are one row with a weight
    d = measured.filter("n_words > 0").groupBy(by, "n_tokens", "n_words").agg(F.count("*").alias("c"), F.sum(F.char_length(text)).alias("chars")).withColumn("f", F.col("n_tokens") / F.col("n_words"))
    q = lambda p: F.round(F.percentile("f", F.lit(p), F.col("c")), 4)
    total = lambda x: F.sum(F.col(x) * F.col("c"))
    mean = F.sum(F.col("f") * F.col("c")) / F.sum("c")
    centre = d.groupBy(by).agg(mean.alias("m"))  # a row for each group
    g = d.join(centre, by)
    return g.groupBy(by).agg(
        F.sum("c").alias("n"), F.round(total("n_tokens") / total("n_words"), 4).alias("micro"), F.round(F.max("m"), 4).alias("macro"),
        F.round(F.when(F.sum("c") > 1, F.sqrt(F.sum(F.col("c") * (F.col("f") - F.col("m")) * (F.col("f") - F.col("m"))) / (F.sum("c") - 1))), 4).alias("sd"),
        q(0.5).alias("p50"), q(0.9).alias("p90"), F.round(F.sum("chars") / F.greatest(total("n_tokens"), F.lit(1)), 4).alias("chars_per_token"),
    )


def fertility_verdict(fert: DataFrame, by: str, base: str) -> DataFrame:
    """Each group's fertility against the base group's."""
    b = fert.filter(F.col(by) == base).select(F.col("micro").alias("b"))
    r = F.round(F.col("micro") / F.greatest("b", F.lit(1e-9)), 4)
    return fert.filter(F.col(by) != base).join(F.broadcast(b)).select(by, r.alias("ratio"), F.when(r > 1.15, "HOLDS").when(r > 1.05, "WEAK").otherwise("FAILS").alias("verdict"))


def fertility_gain(base: DataFrame, donor: DataFrame, by: str) -> DataFrame:
    """By how many percent the donor's tokens a word are fewer than the base's."""
    j = base.select(by, F.col("micro").alias("base_micro")).join(donor.select(by, F.col("micro").alias("donor_micro")), by)
    return j.withColumn("gain_pct", F.round(100.0 * (F.col("base_micro") - F.col("donor_micro")) / F.greatest("base_micro", F.lit(1e-9)), 2))


def word_counts(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """by, word, n: how often each word stands in each group's texts."""
    return df.select(by, F.explode(T.words(F.col(text))).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))


def common_words(counts: DataFrame, least: int) -> DataFrame:
    """The words that stand ``least`` times or more in all groups together: a vocabulary of whole words."""
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("word")


def lookup_fertility(counts: DataFrame, vocab: DataFrame, by: str) -> DataFrame:
    """by, micro: tokens a word where the vocabulary's words are one token and all others one for each character. Groups without words have no row."""
    j = counts.join(vocab.select("word", F.lit(1).alias("one")), "word", "left")
    g = j.groupBy(by).agg(F.sum(F.col("n") * F.coalesce("one", F.char_length("word"))).alias("t"), F.sum("n").alias("w"))
    return g.select(by, F.round(F.col("t") / F.col("w"), 4).alias("micro"))


def accent_confound(plain: DataFrame, stripped: DataFrame, vocab: DataFrame, by: str, lost: list[str], apart: list[str], kept: list[str], rare: int = 10) -> DataFrame:
    """Whether a vocabulary learned without accents could use texts that keep them, for each group.

    ``plain`` and ``stripped`` are (by, micro) of texts with and without accents, ``vocab`` holds the tokens (word). Letters fall in
    three kinds: ``lost`` ones carry a mark that stripping takes, ``apart`` ones are letters of their own, ``kept`` ones carry no mark.
    n_lost, n_apart and n_kept count tokens by letter (a token with two of them counts for each). Keeping accents is worse if it takes
    more tokens; GONE: worse, and no token holds a lost letter; HELPS: not worse; MIXED: worse though some tokens hold them.
    """
    kinds = {"lost": lost, "apart": apart, "kept": kept}
    hits = vocab.agg(*(F.count_if(F.contains("word", F.lit(x))).alias(f"{k}_{i}") for k, some in kinds.items() for i, x in enumerate(some)))
    total = lambda k: sum((F.col(f"{k}_{i}") for i in range(len(kinds[k]))), F.lit(0)).cast("long")
    seen = hits.select(*(total(k).alias(f"n_{k}") for k in kinds))
    j = plain.select(by, F.col("micro").alias("plain")).join(stripped.select(by, F.col("micro").alias("stripped")), by).join(F.broadcast(seen))
    j = j.withColumn("delta", F.round(F.col("plain") - F.col("stripped"), 4)).withColumn("worse", F.col("plain") > F.col("stripped"))
    verdict = F.when(~F.col("worse"), "HELPS").when(F.col("n_lost") == 0, "GONE").otherwise("MIXED")
    return j.select(by, "plain", "stripped", "delta", "worse", "n_lost", "n_apart", "n_kept", F.col("n_apart").between(1, rare).alias("apart_rare"), verdict.alias("verdict"))


def length_stats(measured: DataFrame, by: str) -> DataFrame:
    """Exact statistics of n_tokens; lengths are counted by value first, so no task holds a group's texts."""
    counted = measured.groupBy(by, "n_tokens").agg(F.count("*").alias("c"))
    q = lambda p: F.round(F.percentile("n_tokens", F.lit(p), F.col("c")), 4)
    return counted.groupBy(by).agg(F.sum("c").alias("n"), F.round(F.sum(F.col("n_tokens") * F.col("c")) / F.sum("c"), 4).alias("mean"), q(0.5).alias("median"), q(0.9).alias("p90"), q(0.99).alias("p99"), F.max("n_tokens").alias("max"))


def truncation(measured: DataFrame, by: str, caps: tuple[int, ...] = (128, 256)) -> DataFrame:
    """Texts longer than each cap, in percent, against the mean of all groups; a point of difference raises the alarm."""
    long = measured.select(by, "n_tokens", F.explode(F.array(*map(F.lit, caps))).alias("cap"))
    g = long.groupBy(by, F.col("cap").cast("long").alias("cap")).agg(F.count("*").alias("n"), F.count_if(F.col("n_tokens") > F.col("cap")).alias("n_over"))
    pct = F.round(100.0 * F.col("n_over") / F.greatest("n", F.lit(1)), 2)
    all_ = long.groupBy(F.col("cap").cast("long").alias("cap")).agg(F.round(100.0 * F.count_if(F.col("n_tokens") > F.col("cap")) / F.count("*"), 2).alias("pct_all"))
    g = g.withColumn("pct", pct).join(F.broadcast(all_), "cap")
    return g.select(by, "cap", "n", "n_over", "pct", F.round(F.col("pct") - F.col("pct_all"), 2).alias("delta"), (F.abs(F.round(F.col("pct") - F.col("pct_all"), 2)) >= 1.0).alias("alarm"))


def equal_first(df: DataFrame, by: str, order: str, cap: int | None = 2000) -> DataFrame:
    """The first n rows of each group by ``order`` (numbers, unique within a group; rows without one are out), n the smallest group's size, ``cap`` at most if there is one (a limit that the raw overlap asks for)."""
    sizes = df.groupBy(by).agg(F.count("*").alias("n"))
    n = sizes.agg(F.least(F.min("n"), F.lit(cap)).alias("n")).first()["n"]
    if not n:
        return df.limit(0)
    last = ranks.at_ranks(df.select(by, order), [by], order, {"_last": F.lit(n - 1)}).select(F.col(by).alias("_by"), "_last")  # one row for each group
    return df.join(F.broadcast(last), F.col(by).eqNullSafe(F.col("_by")) & (F.col(order) <= F.col("_last"))).drop("_by", "_last")


def types(df: DataFrame, by: str, alpha: bool, text: str = "text") -> DataFrame:
    """Distinct cleaned tokens of each group."""
    words = df.select(by, F.explode(F.array_distinct(T.words(F.col(text)))).alias("w")).groupBy("w").agg(F.collect_set(by).alias("groups"))  # each word is cut and cleaned once
    t = words.select("groups", F.explode(pieces(F.col("w"))).alias("p")).select("groups", T.clean_token(F.col("p")).alias("type")).filter("type <> ''").select(F.explode("groups").alias(by), "type")
    return (t.filter(T.is_alpha(F.col("type"))) if alpha else t).distinct()


def type_overlap(t: DataFrame, by: str, target: str) -> DataFrame:
    """The target's types against each other group's: shared, covered percent, Jaccard."""
    a, b = t.filter(F.col(by) == target).select("type"), t.filter(F.col(by) != target)
    n_a = a.agg(F.count("*").alias("a_types"))
    sizes = b.groupBy(by).agg(F.count("*").alias("b_types"))
    shared = b.join(a, "type", "left_semi").groupBy(by).agg(F.count("*").alias("shared"))
    g = sizes.join(shared, by, "left").join(F.broadcast(n_a)).withColumn("shared", F.coalesce("shared", F.lit(0)))
    return g.select(by, "a_types", "b_types", "shared", F.round(100.0 * F.col("shared") / F.greatest("a_types", F.lit(1)), 2).alias("a_covered_pct"), F.round(F.col("shared") / F.greatest(F.col("a_types") + F.col("b_types") - F.col("shared"), F.lit(1)), 4).alias("jaccard"))


def relatedness(overlap: DataFrame, by: str, related: str) -> DataFrame:
    """The related group's covered percent over the controls': lift, spread, verdict."""
    x = overlap.agg(
        F.max(F.when(F.col(by) == related, F.col("a_covered_pct"))).alias("rel"), F.avg(F.when(F.col(by) != related, F.col("a_covered_pct"))).alias("base"),
        F.max(F.when(F.col(by) != related, F.col("a_covered_pct"))).alias("hi"), F.min(F.when(F.col(by) != related, F.col("a_covered_pct"))).alias("lo"), F.max("a_types").alias("a_types"),
    )
    lift, spread = F.round(F.col("rel") - F.col("base"), 2), F.round(F.col("hi") - F.col("lo"), 2)
    verdict = F.when((lift >= 10) & (lift >= 3 * F.greatest(spread, F.lit(0.5))), "RELATEDNESS_CONFIRMED").when(lift >= 5, "RELATEDNESS_MODERATE").otherwise("RELATEDNESS_WEAK")
    return x.select(F.col("rel").alias("related_pct"), F.round("base", 2).alias("baseline_pct"), spread.alias("spread_points"), lift.alias("lift_points"), F.round(F.col("rel") / F.greatest("base", F.lit(1e-9)), 3).alias("ratio"),
                    F.round(100.0 * (F.col("rel") - F.col("base")) / F.greatest(100.0 - F.col("base"), F.lit(1e-9)), 2).alias("headroom_share_pct"), F.bround(F.col("a_types") * (F.col("rel") - F.col("base")) / 100.0).cast("long").alias("n_specific_est"), verdict.alias("verdict"))


def specific_types(t: DataFrame, by: str, target: str, related: str) -> DataFrame:
    """Types that target and related share and no other group has."""
    one = lambda g: t.filter(F.col(by) == g).select("type")
    rest = t.filter(~F.col(by).isin(target, related)).select("type")
    return one(target).join(one(related), "type", "left_semi").join(rest, "type", "left_anti")


def letter_counts(words_df: DataFrame, letters: list[str], by: str) -> DataFrame:
    """Distinct words of each group that contain each letter, case and all."""
    hit = words_df.select(by, "word", F.explode(F.array(*map(F.lit, letters))).alias("letter")).filter(F.contains("word", F.col("letter")))
    return hit.groupBy(by, "letter").agg(F.count_distinct("word").alias("n"))


def _mask_hash(seed: str, key: Column, place: Column) -> Column:
    return F.substring(T.seeded(seed, key, place), 1, 8)


def _mask_limit(part: float) -> Column:
    return F.lit(f"{int(part * (1 << 32)):08x}")


def mask_positions(tokens: Column, special: Column, key: Column, seed: str = "17", part: float = 0.15) -> Column:
    """Places to mask of an array of tokens: each place that ``special`` (an array of booleans) doesn't bar by a seeded hash, and the first by it where none is chosen."""
    barred = F.zip_with(tokens, F.slice(special, F.lit(1), F.size(tokens)), lambda _, x: F.coalesce(x, F.lit(False)))  # once a text, not once a place
    at = F.filter(F.transform(barred, lambda x, i: F.struct(F.when(~x, _mask_hash(seed, key, i)).alias("h"), i.alias("i"))), lambda x: x["h"].isNotNull())

    def picked(at: Column) -> Column:
        chosen = F.filter(at, lambda x: x["h"] < _mask_limit(part))
        return F.transform(F.when(F.size(chosen) > 0, chosen).when(F.size(at) > 0, F.array(F.array_min(at))).otherwise(at), lambda x: x["i"])

    return F.get(F.transform(F.array(at), picked), F.lit(0))  # the lambda's argument keeps the hashes from being made for each use


def masked_word_counts(df: DataFrame, key: str, tokens: str, bar: Callable[[Column], Column], seed: str = "17", part: float = 0.15) -> DataFrame:
    """word, n, masked: how often each token stands in the rows' arrays, and on how many places that ``mask_positions`` gives (``bar`` tells of a token if it is special).

    Tokens are hashed as rows, in compiled code. Rows in which none is chosen are looked for apart, up to the first chosen one, and only they take the way by arrays.
    """
    chosen = lambda word, place: ~F.coalesce(bar(word), F.lit(False)) & (_mask_hash(seed, F.col(key), place) < _mask_limit(part))
    each = df.select(key, F.posexplode(tokens).alias("_place", "word")).select("word", F.lit(1).alias("_n"), chosen(F.col("word"), F.col("_place")).cast("int").alias("_m"))
    without = df.filter(~F.exists(F.transform(tokens, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: chosen(p["x"], p["i"])))
    first = without.select(tokens, F.explode(mask_positions(F.col(tokens), F.transform(tokens, bar), F.col(key), seed, part)).alias("_place")).select(F.get(F.col(tokens), F.col("_place")).alias("word"), F.lit(0).alias("_n"), F.lit(1).alias("_m"))
    return each.unionByName(first).groupBy("word").agg(F.sum("_n").alias("n"), F.sum("_m").alias("masked"))


def bits_per_char(lines: DataFrame, vocab_size: int | str | None = None) -> DataFrame:
    """Over lines (nats, masked, tokens, chars, correct): bits a character, top-1 accuracy; with a vocabulary's size (a number, or the column of ``lines`` that holds it) also a random guess's accuracy and how often better."""
    size = F.max(vocab_size) if isinstance(vocab_size, str) else F.lit(vocab_size)
    g = lines.agg(*(F.sum(c).alias(c) for c in ("nats", "masked", "tokens", "chars", "correct")), size.cast("long").alias("v"))
    bits = F.col("nats") / F.greatest("masked", F.lit(1)) * F.col("tokens") / F.log(F.lit(2.0))
    guess = [] if vocab_size is None else [F.round(1.0 / F.col("v"), 8).alias("random_guess"), F.round(F.col("correct") / F.greatest("masked", F.lit(1)) * F.col("v"), 2).alias("over_random")]
    return g.select("masked", "tokens", "chars", *guess, F.round(bits / F.greatest("chars", F.lit(1)), 4).alias("bpc"), F.round(F.col("correct") / F.greatest("masked", F.lit(1)), 4).alias("top1"))
