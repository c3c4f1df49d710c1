"""Set-level data preparation: exclusion, encoding, dedup, splits, subsamples, leakage, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import text as T


def drop_empty(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Rows with a text and a label; texts stripped, empty ones dropped."""
    return df.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).withColumn(text, F.regexp_replace(F.col(text), rf"^{T.SPACE}|{T.SPACE}$", "")).filter(F.col(text) != "")


def exclude_classes(df: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    """Without the classes listed; compared as strings, a no-op for an empty list."""
    return df.filter(~F.col(label).cast("string").isin(labels)) if labels else df


def exclusion_stats(df: DataFrame, labels: list[str], label: str = "label") -> DataFrame:
    gone = F.count_if(F.col(label).cast("string").isin(labels)) if labels else F.lit(0)
    return df.agg(F.count("*").alias("n_before"), gone.cast("long").alias("n_excluded")).select(F.lit(",".join(sorted(labels))).alias("excluded_labels"), "n_before", (F.col("n_before") - F.col("n_excluded")).alias("n_after"), "n_excluded")


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct names in order -> 0, 1, ...; the (few) names are ranked, not the rows."""
    names = df.select(label).filter(F.col(label).isNotNull()).distinct()
    codes = names.withColumn("code", F.dense_rank().over(Window.orderBy(label)) - 1)
    return df.join(codes.withColumn("code", F.col("code").cast("long")), label)


def dedup(df: DataFrame, order: str, text: str = "text", label: str = "label") -> DataFrame:
    """One row (the first by ``order``, which is unique) for each normalised text; texts with several labels go entirely.

    Only digests, orders and labels are grouped; the rows are then picked by their order.
    """
    g = df.groupBy(F.md5(T.normalise(F.col(text))).alias("_k")).agg(F.min(order).alias("_first"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    keep = g.filter(F.col("lo") == F.col("hi")).select("_first")
    return df.join(keep, df[order] == keep["_first"], "left_semi")


def dedup_stats(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    g = df.groupBy(F.md5(T.normalise(F.col(text))).alias("_k")).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("conflict"))
    s = g.agg(F.sum("n").alias("n_before"), F.count_if("conflict").alias("conflicts"), F.count_if(~F.col("conflict")).alias("n_after"))
    removed = F.col("n_before") - F.col("n_after")
    pct = F.round(100.0 * removed / F.greatest("n_before", F.lit(1)), 2)
    return s.select("n_before", "n_after", "conflicts", removed.alias("duplicates_removed"), pct.alias("duplicate_pct"), F.when(pct >= 40, "RECONSIDER").when(pct >= 25, "WARN").otherwise("OK").alias("gate"))


#: Ranges of the seeded hash, by its first hexadecimal digits.
DIGITS = 3


def cuts(df: DataFrame, by: str, seed: str, key: str, quotas: dict[str, Column]) -> DataFrame:
    """Of each group ``_by`` (null is one) its rows ``n``, and for each quota the (hash, key) of the last of so many rows in seeded order, null for none.

    Quotas may use n, ``all`` rows and the number of ``groups``. Hash ranges are counted first and only the ranges in which quotas end are
    ordered, each a 4,096th of its group, so no task orders a group; texts stay where they are, a row is in if its own (hash, key) is not
    behind the cut.
    """
    narrow = df.select(F.col(by).alias("_by"), T.seeded(seed, F.col(key)).alias("h"), F.col(key).alias("k")).withColumn("r", F.substring("h", 1, DIGITS))
    w = Window.partitionBy("_by")
    counts = narrow.groupBy("_by", "r").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w.orderBy("r"))).withColumn("n", F.sum("c").over(w))
    sizes = counts.groupBy("_by").agg(F.sum("c").alias("n"))
    whole = sizes.agg(F.sum("n").alias("all"), F.count("*").alias("groups"))  # one row
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), q.cast("long").alias("q")) for name, q in quotas.items())))
    ends = counts.join(F.broadcast(whole)).select("_by", "r", "upto", "c", asked.alias("x")).filter((F.col("x.q") <= F.col("upto")) & (F.col("x.q") > F.col("upto") - F.col("c")))
    ends = ends.select(F.col("_by").alias("_g"), F.col("r").alias("_r"), "x.name", (F.col("x.q") - F.col("upto") + F.col("c")).alias("left"))
    inside = narrow.join(ends, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("r") == F.col("_r")))
    last = inside.withColumn("at", F.row_number().over(Window.partitionBy("_by", "name").orderBy("h", "k"))).filter(F.col("at") == F.col("left"))
    found = last.groupBy(F.col("_by").alias("_g")).agg(*(F.max(F.when(F.col("name") == name, F.struct("h", "k"))).alias(name) for name in quotas))
    out = sizes.join(F.broadcast(whole)).join(found, F.col("_by").eqNullSafe(F.col("_g")), "left")
    # a quota beyond the group takes all of it
    most = F.struct(F.lit("g").alias("h"), F.lit(None).cast(df.schema[key].dataType).alias("k"))
    return out.select("_by", "n", "all", "groups", *(F.when(q.cast("long") >= F.col("n"), most).otherwise(F.col(name)).alias(name) for name, q in quotas.items()))


def _with_cuts(df: DataFrame, by: str, seed: str, key: str, quotas: dict[str, Column]) -> DataFrame:
    c = cuts(df, by, seed, key, quotas)
    c = c.withColumnsRenamed({x: f"_{x}" for x in c.columns if x != "_by"})
    return df.join(c, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_at", F.struct(T.seeded(seed, F.col(key)).alias("h"), F.col(key).alias("k")))


_CUT = ["_by", "_n", "_all", "_groups", "_at"]


def stratified_split(df: DataFrame, key: str, label: str = "label", val: float = 0.10, test: float = 0.15, seed: str = "17") -> DataFrame:
    """``df`` with split: within each label, in seeded order, floor(n val) go to val, floor(n test) to test, the rest to train."""
    n_val, n_test = F.floor(F.col("n") * F.lit(float(val))), F.floor(F.col("n") * F.lit(float(test)))
    d = _with_cuts(df, label, seed, key, {"val": n_val, "test": n_val + n_test})
    return d.withColumn("split", F.when(F.col("_at") <= F.col("_val"), "val").when(F.col("_at") <= F.col("_test"), "test").otherwise("train")).drop(*_CUT, "_val", "_test")


def label_distribution(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def subsample_proportional(df: DataFrame, n: int, key: str, label: str = "label", seed: str = "17") -> DataFrame:
    """Up to n rows: of each class round-half-even(n * share), then the first n in seeded order; all rows if there are no more than n."""
    d = _with_cuts(df, label, seed, key, {"cut": F.when(F.col("all") <= n, F.col("n")).otherwise(F.bround(F.lit(float(n)) * F.col("n") / F.col("all")))})
    kept = d.filter(F.col("_at") <= F.col("_cut"))
    return kept.orderBy(T.seeded(f"{seed}x", F.col(key)), key).limit(n).drop(*_CUT, "_cut") if n else df.limit(0)


def subsample_balanced(df: DataFrame, n: int, key: str, label: str = "label", seed: str = "17") -> DataFrame:
    """n rows with equal counts: max(1, n // classes) of each class, filled from the rest at random (by hash)."""
    d = _with_cuts(df, label, seed, key, {"cut": F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("groups")))})
    first = F.coalesce(F.col("_at") <= F.col("_cut"), F.lit(False))
    return d.orderBy(first.desc(), T.seeded(f"{seed}x", F.col(key)), F.col(key)).limit(n).drop(*_CUT, "_cut")


def audit_sample(train: DataFrame, n: int, key: str, label: str = "label", seed: str = "31") -> DataFrame:
    """max(1, n // classes) rows of each class in seeded order; a class with fewer gives all, and nothing is filled up."""
    d = _with_cuts(train, label, seed, key, {"cut": F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("groups")))})
    return d.filter(F.col("_at") <= F.col("_cut")).drop(*_CUT, "_cut")


def assert_disjoint(sample: DataFrame, others: DataFrame, text: str = "text") -> None:
    """Raises if a normalised text of ``sample`` is in ``others``."""
    n = overlap_count(sample, others, text).first()["shared"]
    if n:
        raise ValueError(f"{n} texts of the sample are in the other splits")


def leakage(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """Shared normalised texts of each pair of splits."""
    keys = df.select(F.col(split).alias("s"), F.md5(T.normalise(F.col(text))).alias("k")).distinct()
    pairs = keys.alias("a").join(keys.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.s") < F.col("b.s")))
    found = pairs.groupBy(F.col("a.s").alias("left"), F.col("b.s").alias("right")).agg(F.count("*").alias("shared"))
    names = keys.select("s").distinct()
    grid = names.alias("x").join(names.alias("y"), F.col("x.s") < F.col("y.s")).select(F.col("x.s").alias("left"), F.col("y.s").alias("right"))
    return grid.join(found, ["left", "right"], "left").select("left", "right", F.coalesce("shared", F.lit(0)).alias("shared"))


def overlap_count(a: DataFrame, b: DataFrame, text: str = "text") -> DataFrame:
    """Distinct normalised texts of ``a`` that ``b`` has as well; 0 when the two are disjoint."""
    ka, kb = (x.select(F.md5(T.normalise(F.col(text))).alias("k")).distinct() for x in (a, b))
    return ka.join(kb, "k", "left_semi").agg(F.count("*").alias("shared")).select("shared", (F.col("shared") == 0).alias("disjoint"))


#: Digests that one task of the manifest joins, about.
MANIFEST_GROUP = 4096


def manifest(df: DataFrame, split: str = "split", text: str = "text", label: str = "label") -> DataFrame:
    """n and an order-free SHA-256 of each split.

    Each row is digested. Digests that begin alike are joined in order and digested again, two hexadecimal digits fewer at a time. The tree
    is as deep as the largest split needs (one level to a million rows), so no task joins more than some thousands.
    """
    d = df.select(F.col(split).alias("split"), F.sha2(F.concat(T.normalise(F.col(text)), F.lit("\t"), F.col(label).cast("string")), 256).alias("h"))
    most = d.groupBy("split").count().agg(F.max("count")).first()[0] or 0
    digits = 2
    while most > MANIFEST_GROUP * 16**digits:
        digits += 2
    level = d.select("split", F.substring("h", 1, digits).alias("p"), "h", F.lit(1).cast("long").alias("n"), F.lit("").alias("q"))
    while True:
        level = level.groupBy("split", "p").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("q", "h"))), "\n"), 256).alias("h"))
        if digits == 0:
            return level.select("split", "n", F.col("h").alias("sha256"))
        digits -= 2
        level = level.select("split", F.substring("p", 1, digits).alias("p"), "h", "n", F.col("p").alias("q"))


def scramble(text: Column, seed: str, key: Column) -> Column:
    """The words in a seeded order; texts of fewer than three words stay as they are."""
    w = T.split_words(text)
    mixed = F.array_sort(F.transform(w, lambda x, i: F.struct(F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string"), F.lit(":"), i.cast("string"))).alias("h"), x.alias("w"))))
    return F.when(F.size(w) >= 3, F.array_join(F.transform(mixed, lambda s: s["w"]), " ")).otherwise(text)


def scramble_invariants(df: DataFrame, key: str, text: str = "text", seed: str = "17") -> DataFrame:
    d = df.withColumn("s", scramble(F.col(text), seed, F.col(key)))
    same = F.sort_array(T.split_words(F.col(text))) == F.sort_array(T.split_words(F.col("s")))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("s") != F.col(text)).alias("n_changed"), F.count_if(same).alias("n_multiset_kept"))


def positional_cut(df: DataFrame, order: str, part: float = 0.9) -> DataFrame:
    """The first floor(part * n) rows by ``order`` (numbers, unique) are train, the rest val.

    Approximate quantiles bound the cut on both sides; the rows below are counted, and only those between are ordered.
    """
    n = df.count()
    want, width, last = int(part * n), 2e-4, None
    while want and last is None:
        lo, hi = df.agg(F.percentile_approx(order, F.lit(max(0.0, part - width)), 20_000), F.percentile_approx(order, F.lit(min(1.0, part + width)), 20_000)).first()
        left = want - df.filter(F.col(order) < lo).count()
        if left > 0:
            row = df.filter(F.col(order).between(lo, hi)).select(order).orderBy(order).offset(left - 1).limit(1).first()
            last = row[0] if row else None
        width *= 8  # the bounds missed it: farther apart
    return df.withColumn("split", F.when(F.col(order) <= F.lit(last), "train").otherwise("val") if want else F.lit("val"))


#: What a candidate data set must have: rows after dedup, the largest class's share at most, classes, and the band of its headroom (fixed values).
MIN_ROWS, MAX_MAJORITY, MIN_CLASSES, HEADROOM = 10_000, 0.90, 2, (0.60, 0.85)
#: Words of a description that hint at how labels were made (fixed values).
MARKERS = ["emoji", "rule-based", "rule based", "automatically labeled", "automatically labelled", "heuristic", "keyword", "weak supervision", "distant supervision", "wikipedia", "translated", "synthetic"]


def candidate_profile(df: DataFrame, group: str, text: str = "text", label: str = "label", min_rows: int = MIN_ROWS, max_majority: float = MAX_MAJORITY, min_classes: int = MIN_CLASSES, scores: DataFrame | None = None) -> DataFrame:
    """Of each candidate data set: rows before and after dedup (texts with several labels go), classes, the largest class's share, and its criteria.

    ``scores`` (group, headroom, gated), where it is known, adds the criteria of headroom, a plain classifier's macro-F1 that must lie in a
    band, and of free access, and the whole verdict.
    """
    k = df.groupBy(group, F.md5(T.normalise(F.col(text))).alias("_k")).agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count("*").alias("c"))
    by = k.groupBy(group, F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("l")).agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    kept = F.when(F.col("l").isNotNull(), F.col("n"))
    g = by.groupBy(group).agg(F.sum("c").alias("rows_raw"), F.coalesce(F.sum(kept), F.lit(0)).alias("rows_after_dedup"), F.count(kept).alias("n_classes"), F.coalesce(F.max(kept) / F.sum(kept), F.lit(1.0)).alias("m"))
    rows_ok, classes_ok, majority_ok = F.col("rows_after_dedup") >= min_rows, F.col("n_classes") >= min_classes, F.col("m") <= max_majority
    out = g.select(group, "rows_raw", "rows_after_dedup", "n_classes", F.round("m", 4).alias("majority_share"), majority_ok.alias("majority_ok"), rows_ok.alias("rows_ok"), classes_ok.alias("classes_ok"), (rows_ok & classes_ok & majority_ok).alias("passes_without_headroom"))
    if scores is None:
        return out
    fits = F.coalesce(F.col("headroom").between(*HEADROOM), F.lit(False))
    free = ~F.coalesce("gated", F.lit(False))
    return out.join(scores, group, "left").withColumn("headroom_ok", fits).withColumn("not_gated", free).withColumn("passes", F.col("passes_without_headroom") & fits & free)


def marker_counts(docs: DataFrame, text: str = "text", markers: list[str] = MARKERS) -> DataFrame:
    """How many texts hold each marker, case aside."""
    names = F.array(*map(F.lit, markers))
    found = docs.select(F.explode(F.filter(names, lambda m: F.contains(T.casefold(F.col(text)), m))).alias("marker")).groupBy("marker").agg(F.count("*").alias("n"))
    every = docs.sparkSession.createDataFrame([(m,) for m in markers], "marker string")
    return every.join(found, "marker", "left").select("marker", F.coalesce("n", F.lit(0)).alias("n"))


def top_source_by_label(df: DataFrame, source: str, label: str = "label") -> DataFrame:
    """Of each label the most frequent source (ties: first by name), its share, and the number of sources."""
    by = df.groupBy(label, source).agg(F.count("*").alias("n"))
    g = by.groupBy(label).agg(F.min_by(source, F.struct((-F.col("n")).alias("n"), source)).alias("top_source"), F.max("n").alias("top"), F.sum("n").alias("rows"), F.count("*").alias("n_sources"))
    return g.select(label, "top_source", F.round(F.col("top") / F.col("rows"), 4).alias("top_share"), "n_sources")
