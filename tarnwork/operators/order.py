"""Order statistics and ranks of whole tables without a task that holds a group.

``at_ranks`` finds the values at given places of each group's order exactly. Every round counts the rows of BUCKETS equal parts of the range that a place
lies in, and goes on within the part that holds it: values meet only as counts, until few are left, whose distinct values are ordered. The driver holds one row
for each group and place, so groups are meant to be few (sets of rows, languages).

Values are numbers; null and NaN values are left out, infinite ones are an error. A place outside its group is an error as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a range, and rows whose distinct values are put in order in one task.
BUCKETS, FEW = 4096, 100_000


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """A row for each group of ``by`` (null is one) that has values: by, n (its values) and, named as in ``ranks``, the values at these places (from 0; expressions of n)."""
    spark = df.sparkSession
    v = F.col(value).cast("double")
    rows = df.select(*by, F.col(value).alias("_v"), v.alias("_x")).filter(v.isNotNull() & ~F.isnan(v))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    places = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items())))
    state = [r.asDict() | {"below": 0, "within": r["n"]} for r in sizes.select("*", places.alias("p")).select(*by, "n", "lo", "hi", "p.name", "p.rank").collect()]
    for s in state:
        if s["rank"] is None or not 0 <= s["rank"] < s["n"]:
            raise ValueError(f"{s['name']}: no place {s['rank']} among {s['n']} values")
        if not (math.isfinite(s["lo"]) and math.isfinite(s["hi"])):
            raise ValueError("infinite values have no place")
    kinds = ", ".join(f"{b} {t}" for b, t in rows.select(*by).dtypes)
    schema = f"{kinds}{', ' if by else ''}_name string, _lo double, _hi double, _below long, _rank long"

    def narrowed(left: list[dict]) -> DataFrame:
        """The rows in the ranges of ``left``, with the range's name."""
        told = F.broadcast(spark.createDataFrame([(*(s[b] for b in by), s["name"], s["lo"], s["hi"], s["below"], s["rank"]) for s in left], schema))
        cond = F.col("_x").between(F.col("t._lo"), F.col("t._hi"))
        for b in by:
            cond = cond & F.col(f"r.{b}").eqNullSafe(F.col(f"t.{b}"))
        return rows.alias("r").join(told.alias("t"), cond).select("r.*", *(f"t.{c}" for c in ("_name", "_lo", "_hi", "_below", "_rank")))

    while wide := [s for s in state if s["lo"] < s["hi"] and s["within"] > FEW]:
        span = F.col("_hi") - F.col("_lo")
        # a span beyond the doubles is taken by halves; a span of the least of them has none
        share = F.when(span == float("inf"), (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)).otherwise((F.col("_x") - F.col("_lo")) / span)
        bucket = F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS))
        keys = [*by, "_name"]
        counts = narrowed(wide).groupBy(*keys, "_below", "_rank", bucket.alias("b")).agg(F.count("*").alias("c"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("b"))  # BUCKETS rows
        hit = counts.withColumn("upto", F.col("_below") + upto).filter((F.col("_rank") < F.col("upto")) & (F.col("_rank") >= F.col("upto") - F.col("c")))
        found = {tuple(r[k] for k in keys): r for r in hit.collect()}
        for s in wide:
            r = found[(*(s[b] for b in by), s["name"])]
            s |= {"lo": r["lo"], "hi": r["hi"], "below": r["upto"] - r["c"], "within": r["c"]}
    few = narrowed(state).groupBy(*by, "_name", "_below", "_rank", "_v").agg(F.count("*").alias("c")) if state else None
    kind = dict(rows.dtypes)["_v"]
    out = sizes.select(*by, "n")
    if few is None:
        return out.select("*", *(F.lit(None).cast(kind).alias(name) for name in ranks))
    upto = F.col("_below") + F.sum("c").over(Window.partitionBy(*by, "_name").orderBy("_v"))
    last = few.withColumn("upto", upto).filter(F.col("upto") > F.col("_rank")).groupBy(*by).agg(*(F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks))
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(f"o.{b}").eqNullSafe(F.col(f"l.{b}"))
    return out.alias("o").join(F.broadcast(last).alias("l"), cond).select("o.*", *(f"l.{name}" for name in ranks))


def percentiles(df: DataFrame, by: list[str], value: str, parts: dict[str, float]) -> DataFrame:
    """by, n and the exact percentiles ``parts`` (name -> share), between two values by their distance from the place, as ``percentile`` gives them."""
    at = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in parts.items()}
    ends = {f"{name}_{end}": f(place) for name, place in at.items() for end, f in (("lo", F.floor), ("hi", F.ceil))}
    found = at_ranks(df, by, value, ends)

    def between(name: str) -> Column:
        lo, hi, place = F.col(f"{name}_lo").cast("double"), F.col(f"{name}_hi").cast("double"), at[name]
        return F.when(F.ceil(place) == F.floor(place), lo).when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi)

    return found.select(*by, "n", *(between(name).alias(name) for name in parts))


def dense_ranks(df: DataFrame, by: str, count: str, name: str, prefix: int = 3) -> DataFrame:
    """``df`` with _rank: each row's place (from 0) in its group by falling ``count``, then ``name``, both together unique.

    Rows are ordered only among those of the same count whose names begin alike, behind as many as all ranges before them hold.
    """
    begin = F.substring(F.col(name), 1, prefix)
    ranges = df.groupBy(by, count, begin.alias("_begin")).agg(F.count("*").alias("_c"))
    # a row for each count and beginning: far fewer than names
    before = F.sum("_c").over(Window.partitionBy(by).orderBy(F.desc(count), "_begin").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(by, count, "_begin", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, count, "_begin").orderBy(name))
    rows = df.withColumn("_begin", begin).withColumn("_own", own)
    cond = F.col(f"r.{by}").eqNullSafe(F.col(f"g.{by}")) & (F.col(f"r.{count}") == F.col(f"g.{count}")) & F.col("r._begin").eqNullSafe(F.col("g._begin"))
    return rows.alias("r").join(ranges.alias("g"), cond).select(*(f"r.{c}" for c in df.columns), (F.col("_before") + F.col("_own") - 1).alias("_rank"))


def positions(df: DataFrame, by: str, key: str) -> DataFrame:
    """``df`` with _at: each row's place (from 0) in its group by ``key``, finite numbers that are unique in the group.

    Rows are ordered only within one of BUCKETS equal parts of their group's range, behind as many as the parts before hold.
    """
    x = F.col(key).cast("double")
    ends = df.groupBy(F.col(by).alias("_by")).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))  # one row for each group
    rows = df.join(F.broadcast(ends), F.col(by).eqNullSafe(F.col("_by")))
    part = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(BUCKETS - 1), F.floor((x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * BUCKETS))).otherwise(0).cast("int")
    rows = rows.withColumn("_part", part).withColumn("_own", F.row_number().over(Window.partitionBy("_by", "_part").orderBy(key)))
    counts = rows.groupBy(F.col("_by").alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_g", "_p", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.join(F.broadcast(counts), F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.select(*df.columns, (F.col("_before") + F.col("_own") - 1).alias("_at"))
