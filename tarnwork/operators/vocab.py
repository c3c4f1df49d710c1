"""Vocabularies: marker schemes, canonical keys, anchors between two vocabularies, special tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import bytelevel, encoding
from tarnwork.operators import order

#: Word-boundary marks (fixed values) and the shares above which they tell the scheme, in this order.
PIECE_MARK, BYTE_MARK, CONT_MARK, END_MARK = "▁", "Ġ", "##", "</w>"
#: Special-token roles, and the role of the base that stands in for a missing one.
FALLBACK = {"cls": "bos", "bos": "cls", "sep": "eos", "eos": "sep"}
GO, CARE = 20_000, 5_000


def _scheme(shares: dict[str, Column]) -> Column:
    return F.when(shares["p"] > 0.05, "sentencepiece").when(shares["b"] > 0.05, "bytelevel").when(shares["c"] > 0.02, "wordpiece").when(shares["e"] > 0.30, "fastbpe").otherwise("plain")


def _shares() -> dict[str, Column]:
    t = F.col("token")
    marked = {"p": t.startswith(PIECE_MARK), "b": t.startswith(BYTE_MARK), "c": t.startswith(CONT_MARK), "e": t.endswith(END_MARK)}
    return {k: F.avg(F.when(c, 1.0).otherwise(0.0)) for k, c in marked.items()}


def schemes(vocab: DataFrame) -> DataFrame:
    """vocab (tokenizer, token, token_id) -> tokenizer, scheme."""
    g = vocab.groupBy("tokenizer").agg(*(c.alias(k) for k, c in _shares().items()))
    return g.select("tokenizer", _scheme({k: F.col(k) for k in "pbce"}).alias("scheme"))


def keyed(vocab: DataFrame) -> DataFrame:
    """``vocab`` with its scheme, canonical key and bare surface, in one pass over it."""
    w = Window.partitionBy("tokenizer")  # a vocabulary is small
    d = vocab.select("*", *(c.over(w).alias(f"_{k}") for k, c in _shares().items())).withColumn("scheme", _scheme({k: F.col(f"_{k}") for k in "pbce"}))
    return d.select(*vocab.columns, "scheme", canon(F.col("token"), F.col("scheme")).alias("key"), surface(F.col("token"), F.col("scheme")).alias("bare"))


def _after(t: Column, mark: str) -> Column:
    return F.substring(t, F.lit(len(mark) + 1), F.char_length(t))


def canon(token: Column, scheme: Column) -> Column:
    """(surface, initial): the token without its mark, and whether it starts a word; end-marked tokens stay plain."""
    def key(surface: Column, initial: Column) -> Column:
        return F.struct(surface.alias("surface"), initial.alias("initial"))

    start = lambda m: F.when(token.startswith(m), key(_after(token, m), F.lit(True))).otherwise(key(token, F.lit(False)))
    cont = F.when(token.startswith(CONT_MARK), key(_after(token, CONT_MARK), F.lit(False))).otherwise(key(token, F.lit(True)))
    return F.when(scheme == "sentencepiece", start(PIECE_MARK)).when(scheme == "bytelevel", start(BYTE_MARK)).when(scheme == "wordpiece", cont).otherwise(key(token, F.lit(True)))


def surface(token: Column, scheme: Column) -> Column:
    """The token without any mark of its scheme."""
    strip = lambda m: F.when(token.startswith(m), _after(token, m)).otherwise(token)
    end = F.when(token.endswith(END_MARK), F.substring(token, F.lit(1), F.char_length(token) - len(END_MARK))).otherwise(token)
    return F.when(scheme == "sentencepiece", strip(PIECE_MARK)).when(scheme == "bytelevel", strip(BYTE_MARK)).when(scheme == "wordpiece", strip(CONT_MARK)).when(scheme == "fastbpe", end).otherwise(token)


def canon_vocab(vocab: DataFrame) -> DataFrame:
    """The lowest id of each canonical key."""
    return keyed(vocab).groupBy("tokenizer", "key").agg(F.min("token_id").alias("token_id")).select("tokenizer", "key.surface", "key.initial", "token_id")


def surface_vocab(vocab: DataFrame) -> DataFrame:
    """The lowest id of each bare surface; empty ones left out."""
    return keyed(vocab).filter("bare <> ''").groupBy("tokenizer", F.col("bare").alias("surface")).agg(F.min("token_id").alias("token_id"))


def _lowest(*when: Column) -> Column:
    """The lowest id of a group's tokens for which all hold."""
    cond = when[0]
    for c in when[1:]:
        cond = cond & c
    return F.min(F.when(cond, F.col("token_id")))


def _meeting(rows: DataFrame, on: str, donor: str, base: str) -> DataFrame:
    g = rows.groupBy(on).agg(_lowest(F.col("tokenizer") == donor).alias("donor_id"), _lowest(F.col("tokenizer") == base).alias("base_id"))
    return g.filter("donor_id IS NOT NULL AND base_id IS NOT NULL").select("donor_id", "base_id")


def anchors_strict(vocab: DataFrame, donor: str, base: str) -> DataFrame:
    return _meeting(keyed(vocab), "key", donor, base)


def anchors_surface(vocab: DataFrame, donor: str, base: str) -> DataFrame:
    return _meeting(keyed(vocab).filter("bare <> ''"), "bare", donor, base)


def anchors_functional(vocab: DataFrame, donor: str, base: str) -> DataFrame:
    """Donor tokens whose surface the base encodes as exactly one token, alone or after a space.

    With a base that has a token for a surface exactly when its vocabulary lists it, encoding is two look-ups:
    the surface inside a word, then at a word's start. Other tokenizers encode: ``anchors_by_encoding``.
    """
    as_bare, as_key = F.struct(F.col("bare").alias("s"), F.lit("bare").alias("k")), F.struct(F.col("key.surface").alias("s"), F.when(F.col("key.initial"), "start").otherwise("inside").alias("k"))
    rows = keyed(vocab).select("tokenizer", "token_id", F.explode(F.array(as_bare, as_key)).alias("x")).select("tokenizer", "token_id", "x.s", "x.k")
    of = lambda who, kind: _lowest(F.col("tokenizer") == who, F.col("k") == kind)
    g = rows.filter("s <> ''").groupBy("s").agg(of(donor, "bare").alias("donor_id"), of(base, "inside").alias("inside"), of(base, "start").alias("start"))
    found = g.select("donor_id", F.coalesce("inside", "start").alias("base_id"), F.when(F.col("inside").isNotNull(), "standalone").otherwise("leading_space").alias("how"))
    return found.filter("donor_id IS NOT NULL AND base_id IS NOT NULL")


def anchors_encoded(donor: DataFrame, specials: DataFrame) -> DataFrame:
    """donor (donor_id, alone, spaced: arrays of base ids); accepted is a single id that is not special, alone first."""
    one = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    long = donor.select("donor_id", F.posexplode(F.array(one("alone"), one("spaced")))).filter("col IS NOT NULL")
    good = long.join(specials.select(F.col("token_id").alias("col")), "col", "left_anti")
    return good.groupBy("donor_id").agg(F.min_by("col", "pos").alias("base_id"), F.min("pos").alias("p")).select("donor_id", "base_id", F.when(F.col("p") == 0, "standalone").otherwise("leading_space").alias("how"))


def anchors_by_encoding(vocab: DataFrame, donor: str, file, refused: DataFrame) -> DataFrame:
    """Anchors of ``anchors_encoded`` of the donor's tokens, whose surfaces the base's tokenizer file encodes; byte-level tokens are decoded first."""
    own = bytelevel.decode_vocab(vocab.filter(F.col("tokenizer") == donor))
    s = own.join(schemes(own), "tokenizer").select(F.col("token_id").alias("donor_id"), surface(F.col("token"), F.col("scheme")).alias("surface")).filter("surface <> ''")
    both = encoding.encoded(encoding.encoded(s, "surface", file, "alone").withColumn("_s", F.concat(F.lit(" "), "surface")), "_s", file, "spaced")
    return anchors_encoded(both.select("donor_id", "alone", "spaced"), refused)


def anchor_diagnostics(strict: DataFrame, functional: DataFrame) -> DataFrame:
    s, f = strict.select("donor_id", F.lit(1).alias("s")), functional.select("donor_id", F.lit(1).alias("f"))
    j = s.join(f, "donor_id", "full")
    return j.agg(F.count("*").alias("n_union"), F.count_if(F.col("f").isNull()).alias("strict_only"), F.count_if(F.col("s").isNull()).alias("functional_only"), F.count_if(F.col("s").isNotNull() & F.col("f").isNotNull()).alias("both"))


def verdict(anchors: DataFrame, go: int = GO, care: int = CARE) -> DataFrame:
    return anchors.agg(F.count("*").alias("n_anchors")).select("n_anchors", F.when(F.col("n_anchors") >= go, "GO").when(F.col("n_anchors") >= care, "GO_WITH_CARE").otherwise("NO_GO").alias("verdict"))


def raw_overlap(vocab: DataFrame, donor: str, base: str) -> DataFrame:
    t = lambda x: vocab.filter(F.col("tokenizer") == x).select("token")
    return t(donor).join(t(base), "token", "left_semi").agg(F.count("*").alias("shared"))


def align_specials(donor: DataFrame, base: DataFrame) -> DataFrame:
    """(role, token_id) of both -> donor_id, base_id: by role, or by the role that stands in where the base lacks it."""
    b = base.select(F.col("role").alias("b_role"), F.col("token_id").alias("base_id"))
    stand = F.coalesce(*(F.when(F.col("role") == k, F.lit(v)) for k, v in FALLBACK.items()))
    d = donor.select("role", F.col("token_id").alias("donor_id"), stand.alias("other"))
    own = d.join(b, d["role"] == b["b_role"], "left").drop("b_role")
    alt = b.select(F.col("b_role").alias("other"), F.col("base_id").alias("alt_id"))
    return own.join(alt, "other", "left").select("role", "donor_id", F.coalesce("base_id", "alt_id").alias("base_id")).filter("base_id IS NOT NULL")


def partition_ids(vocab: DataFrame, donor: str, anchors: DataFrame, specials: DataFrame | None = None) -> DataFrame:
    """Each donor id is an anchor, an aligned special token, or unfamiliar."""
    if specials is not None:
        known = anchors.select("donor_id", F.lit("anchor").alias("part")).unionByName(specials.select("donor_id", F.lit("special").alias("part")))
        known = known.groupBy("donor_id").agg(F.min("part").alias("part"))
    else:
        known = anchors.select("donor_id", F.lit("anchor").alias("part")).distinct()
    v = vocab.filter(F.col("tokenizer") == donor).select(F.col("token_id").alias("donor_id"))
    return v.join(known, "donor_id", "left").select("donor_id", F.coalesce("part", F.lit("unfamiliar")).alias("part"))


def ranked_vocab(tokens: DataFrame) -> DataFrame:
    """(tokenizer, token) occurrences -> vocabulary with ids by falling count, then token."""
    g = tokens.groupBy("tokenizer", "token").agg(F.count("*").alias("n"))
    return order.dense_ranks(g, "tokenizer", "n", "token").select("tokenizer", "token", F.col("_rank").alias("token_id"))
