"""Text expressions that read the same in Spark and in other SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as an explicit class; Spark's \\s is ASCII only.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]+"


def casefold(c: Column) -> Column:
    """Full lower-casing plus the foldings that lower() lacks (ß; İ as one code point)."""
    return F.replace(F.lower(F.replace(c, F.lit("İ"), F.lit("i̇"))), F.lit("ß"), F.lit("ss"))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalise(c: Column) -> Column:
    """Runs of white space to one space, ends stripped, case folded."""
    return casefold(collapse(c))


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1))


def split_words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def is_alpha(c: Column) -> Column:
    return c.rlike(r"^\p{L}+$")


def clean_token(c: Column) -> Column:
    """A token without its word-boundary marks: all leading ▁ and # go, then outer spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "^▁+", ""), "^#+", ""))


def seeded(seed: str, *cols: Column) -> Column:
    """A reproducible ordering key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in cols]))
