"""URL rules indexed by their rarest literal token, in DataFrame functions only.

A rule is a host and path prefix (the longest that fits a URL decides) or, for URLs that none of these
fits, a pattern: a regular expression with literal tokens that any URL it matches must hold. Over all
URLs, the rules' literal tokens are counted once; each rule is indexed by the one that fewest URLs hold.
URLs are cut into tokens, tokens fetch candidate rules, and only candidates are tested. Rules without a
literal token are indexed by the empty token, which every URL holds.

The rule set is a parameter, not data; its size is checked (``MOST_RULES``) before it is broadcast. With
more rules the same joins run on shuffled sides.

Null urls, and those without ``://``, have empty host and path; no host rule fits them, patterns are
tested on the text there is, and without a match they are allowed. Ties between rules of one length go
to block, then to the smaller rule string. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import common

#: Rules up to this many are broadcast (some 100 bytes each).
MOST_RULES = 20_000

HOST_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Patterns on the host and path with A-Z lower-cased, with literal tokens that each needs.
PATTERN_RULES = [
    ("block", r"(^|[.-])spam-farm\.", ["spam", "farm"]),
    ("block", r"(^|[.-])cheap-pills\.", ["cheap", "pills"]),
    ("block", r"(^|[.-])casino-win\.", ["casino", "win"]),
    ("block", r"(^|[./_-])(online-)?casino([./_-]|$)", ["casino"]),
    ("block", r"(^|[./_-])viagra([./_-]|$)", ["viagra"]),
    ("block", r"(^|[./_-])porn([./_-]|$)", ["porn"]),
    ("block", r"(^|[./_-])xxx([./_-]|$)", ["xxx"]),
    ("block", r"/wp-login\.php$", ["wp", "login", "php"]),
    ("block", r"(^|\.)doubleclick\.", ["doubleclick"]),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule string, verdict string, host string, path string, pattern string, literals array<string>"


def literal_tokens(host: str, path: str) -> list[str]:
    """Tokens that every URL which a host rule fits must hold whole: the host's, and of the path all but a last one that may go on."""
    found = re.findall(r"[a-z0-9]+", host)
    path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in path)
    return sorted({*found, *re.findall(r"[a-z0-9]+(?![a-z0-9])(?=[^a-z0-9])", path)})


def rules(spark: SparkSession, hosts=HOST_RULES, patterns=PATTERN_RULES) -> DataFrame:
    rows = [(h + p, v, h, p, None, literal_tokens(h, p)) for v, h, p in hosts] + [(None, v, None, None, p, sorted(set(t))) for v, p, t in patterns]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    """Distinct tokens, and the empty one."""
    lower = F.translate(text, UPPER, LOWER)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(lower, "[^a-z0-9]+")))


def judge(pages: DataFrame, rule_table: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of each row."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    parts = pages.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    # one row number per row would need a sort; host and path decide alone, so equal ones are judged once
    urls = parts.select("host", "path").distinct()
    urls = common.materialise(urls.withColumn("tokens", tokens_of(F.concat("host", F.lit("/"), "path"))), "urls")
    small = rule_table.count() <= MOST_RULES
    hint = F.broadcast if small else (lambda df: df)
    listed = rule_table.select(F.monotonically_increasing_id().alias("k"), "*")
    listed = common.materialise(listed, "rules")
    literals = listed.select("k", F.explode(F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))).alias("token"))
    exploded = urls.select("host", "path", F.explode("tokens").alias("token"))
    held = exploded.join(hint(literals.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    index = literals.join(held, "token", "left").groupBy("k").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    index = common.materialise(index.join(listed.drop("literals"), "k"), "index").drop("k")
    candidates = exploded.join(hint(index.withColumnsRenamed({"host": "r_host", "path": "r_path"})), "token")
    fits = F.when(F.col("pattern").isNull(), ((F.col("host") == F.col("r_host")) | F.endswith("host", F.concat(F.lit("."), "r_host"))) & F.startswith("path", "r_path")).otherwise(F.expr(f"concat(host, translate(path, '{UPPER}', '{LOWER}')) rlike pattern"))
    key = F.struct(F.col("pattern").isNull().alias("host_rule"), F.coalesce(F.length("rule"), F.lit(0)).alias("length"), (F.col("verdict") == "block").alias("block"))
    won = candidates.filter(fits).groupBy("host", "path").agg(F.max(F.struct(key.alias("key"), F.struct("rule", "verdict", "pattern").alias("r"))).alias("w"))
    won = won.select("host", "path", "w.r.rule", "w.r.verdict", "w.r.pattern")
    return parts.join(won, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "pattern")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"), rules(spark)).select("page_id", "host", "path", "rule", "verdict")


_CASES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2])))
_BLOCKED = " OR ".join(f"rule = '{h}{p}'" for v, h, p in HOST_RULES if v == "block")
_PATTERNS = "|".join(f"(?:{p})" for _, p, _ in PATTERN_RULES)
SQL = f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, CASE {_CASES} END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN CASE WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END
            WHEN regexp_matches(concat(host, translate(path, '{UPPER}', '{LOWER}')), '{_PATTERNS}') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""
