"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A tree domain > language > source has a weight at each node (equal where none is given). A budget of
tokens goes down the tree: the children of a node share its budget in proportion to their weights, but no
child gets more than its leaves can give, that is their tokens times the epochs allowed. What a short
child can't use goes to its siblings in proportion to their weights, and only what all of them can't use
is left to the node's own siblings. So at each level the filled shares are weight * level for one common
level, found with running sums over the children ordered by capacity / weight.

Each leaf's budget is a prefix of its tokens in seeded order: whole epochs first, then of one more epoch
the documents of the prefix, up to the last one that still fits whole. The order is a hash of seed, epoch
and id, so a prefix is a threshold on that hash. It is found by summing tokens in hash ranges of a leaf,
a range then being searched alone; no leaf is sorted in one task, and texts don't travel.

Tokens are words here; any long column can be named instead. Null language or source is a value of its
own. Rows that repeat an id are taken or left together; their tokens count each. Null ids are hashed like
one id. Null texts have no tokens and cost nothing: they are in each whole epoch, and in the part of one
that their hash falls in. Leaves with weight 0 get nothing. An empty table gives an empty result; other
columns come through, whatever their names, but those named like the three that are added, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwork.llm import common

LEVELS = ["domain", "lang", "source"]
SEED = 20240229
#: Hash ranges of a leaf.
RANGES = 4096
#: Target weights of the query: by path from the root, joined by "/".
WEIGHTS = {"web": 3.0, "books": 1.0, "web/en": 4.0, "web/fr": 2.0, "web/de": 2.0, "web/es": 1.0, "books/en": 2.0, "books/es": 2.0}
MAX_EPOCHS = 3
#: Budget of the query as a part of all tokens.
PART = 0.9
#: Sources of the domain "books"; all others are "web".
BOOKS = ["src3", "src7", "src11", "src15", "src19"]


def domain_of(source: Column) -> Column:
    return F.when(F.coalesce(source.isin(BOOKS), F.lit(False)), "books").otherwise("web")


def _weights(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()] or [("", 1.0)], "path string, weight double")


def budgets(leaves: DataFrame, weights: dict[str, float], total: float | Column, max_epochs: int) -> DataFrame:
    """``leaves`` (the levels, tokens) with path and budget (tokens, a double)."""
    spark = leaves.sparkSession
    w = _weights(spark, weights)
    path: Column = F.lit("")
    for k, level in enumerate(LEVELS):
        path = F.concat(path, F.lit("/" if k else ""), F.coalesce(F.col(level), F.lit("\0null")))
        leaves = leaves.withColumn(f"p{k}", path)
    leaves = leaves.withColumn("given", F.lit(total).cast("double") if not isinstance(total, Column) else total)
    for k in range(len(LEVELS)):
        parent = [f"p{j}" for j in range(k)]
        node = [*parent, f"p{k}"]
        nodes = leaves.groupBy(*node).agg(F.sum("tokens").alias("t"), F.first("given").alias("given"))
        nodes = nodes.join(w.withColumnsRenamed({"path": f"p{k}"}), f"p{k}", "left").withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0)))
        # a node without weight can't take anything
        nodes = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("t").cast("double") * max_epochs).otherwise(0.0)).withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0))
        order = Window.partitionBy(*parent).orderBy("ratio", f"p{k}") if parent else Window.orderBy("ratio", f"p{k}")
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
        # the level if this node and those after it stay below their capacity
        nodes = nodes.withColumn("level", F.when(F.col("open") > 0, (F.col("given") - F.col("full")) / F.col("open")).otherwise(0.0))
        whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", f"p{k}", "level"))).over(whole)["level"]
        nodes = nodes.withColumn("at", level).withColumn("share", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.greatest(F.lit(0.0), F.col("at") * F.col("weight")))))
        leaves = leaves.drop("given").join(nodes.select(*node, F.col("share").alias("given")), node)
    return leaves.withColumnRenamed("given", "budget")


def select(docs: DataFrame, domain: Column, tokens: Column, weights: dict[str, float], total: float | None = None, part: float = 1.0, max_epochs: int = 1, seed: int = SEED, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` once for each epoch that a document is in, with _domain, _tokens and _epoch (from 0)."""
    added = ("_domain", "_tokens", "_epoch")
    own = [c for c in docs.columns if c not in added]
    n_tokens = F.coalesce(tokens, F.lit(0)).cast("long")
    levels = [domain.alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")]
    # tokens are counted once, in a narrow table; the texts are only read again to be handed on
    narrow = common.materialise(docs.select(F.col(id_col).alias("id"), *levels, n_tokens.alias("tokens")), "tokens")
    leaves = common.materialise(narrow.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    given = F.lit(float(total)) if total is not None else F.lit(part) * F.lit(float(leaves.agg(F.sum("tokens")).first()[0] or 0))
    plan = budgets(leaves, weights, given, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.when(F.col("budget") >= 0, F.lit(0))).cast("long"))
    plan = common.materialise(plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).select(*LEVELS, F.col("tokens").alias("leaf_tokens"), "budget", "whole", "rest"), "plan")

    def same(a: str, b: str) -> Column:
        out = F.lit(True)
        for c in LEVELS:
            out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
        return out

    def key(id_: Column, epoch: Column) -> Column:
        return F.xxhash64(F.lit(seed), epoch, id_)

    def range_of(h: Column) -> Column:
        return F.shiftright(h, 64 - 12) + F.lit(RANGES // 2)

    # sums of the part epoch by hash range, and the range in which a leaf's prefix ends
    one = narrow.alias("d").join(plan.filter("rest > 0").alias("p"), same("d", "p")).select(*(F.col(f"d.{c}").alias(c) for c in LEVELS), "d.tokens", "rest", key(F.col("d.id"), F.col("whole")).alias("h")).withColumn("r", range_of(F.col("h")))
    one = common.materialise(one, "one")
    sums = one.groupBy(*LEVELS, "r").agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("r"))
    ends = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy(*LEVELS).agg(F.min(F.struct("r", (F.col("rest") - (F.col("upto") - F.col("t"))).alias("left"))).alias("e")).select(*LEVELS, "e.r", "e.left")
    ends = common.materialise(ends, "ends")
    # within that range, ids with one hash together
    last = one.alias("d").join(ends.alias("e"), same("d", "e") & (F.col("d.r") == F.col("e.r"))).groupBy(*(F.col(f"d.{c}").alias(c) for c in LEVELS), "h").agg(F.sum("tokens").alias("t"), F.first("left").alias("left"))
    over = last.withColumn("upto", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("h"))).filter(F.col("upto") > F.col("left")).groupBy(*LEVELS).agg(F.min("h").alias("stop"))
    cuts = plan.alias("p").join(over.alias("o"), same("p", "o"), "left").select("p.*", "stop", F.xxhash64(*(F.coalesce(F.col(f"p.{c}"), F.lit("\0null")) for c in LEVELS)).alias("leaf"))
    cuts = common.materialise(cuts, "cuts")

    common.release(narrow, leaves, plan, one, ends)
    # the columns of docs are numbered here, so that no name clashes
    leaf = F.xxhash64(*(F.coalesce(c, F.lit("\0null")) for c in (domain, F.col(lang_col), F.col(source_col))))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"u{k}") for k, c in enumerate(own)), domain.alias("domain"), n_tokens.alias("tokens"), leaf.alias("leaf"), F.col(id_col).alias("id"))
    found = rows.join(cuts.select("leaf", "whole", "rest", "stop"), "leaf")
    # a prefix without an end takes the whole epoch
    partly = (F.col("rest") > 0) & (F.col("stop").isNull() | (key(F.col("id"), F.col("whole")) < F.col("stop")))
    epochs = F.col("whole") + partly.cast("long")
    found = found.filter(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))
    return found.select(*(F.col(f"u{k}").alias(c) for k, c in enumerate(own)), F.col("domain").alias("_domain"), F.col("tokens").alias("_tokens"), F.col("epoch").alias("_epoch"))


def words(text: Column) -> Column:
    return F.size(common.words_of(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = select(docs, domain_of(F.col("source")), words(F.col("text")), WEIGHTS, part=PART, max_epochs=MAX_EPOCHS)
    return out.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"))
