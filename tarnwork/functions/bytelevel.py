"""Byte-level token strings: the table between bytes and printable characters, decoding, detection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def byte_table() -> dict[str, int]:
    """Character -> byte: printable Latin-1 stands for itself, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_TABLE = byte_table()


def decode(token: str | None) -> str | None:
    """The text of a byte-level token; null if a character is outside the table or the bytes aren't UTF-8."""
    if token is None or any(c not in _TABLE for c in token):
        return None
    try:
        return bytes(_TABLE[c] for c in token).decode("utf-8")
    except UnicodeDecodeError:
        return None


@F.pandas_udf(StringType())
def decode_column(s: pd.Series) -> pd.Series:
    return s.map(decode)


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    """Lower-cased, without combining marks."""
    import unicodedata

    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))


def is_byte_level(vocab: DataFrame, first: int = 3000) -> DataFrame:
    """tokenizer, byte_level: of the first ids, 90 % decode and 2 % change by it."""
    d = vocab.filter(F.col("token_id") < first).withColumn("d", decode_column("token"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return d.groupBy("tokenizer").agg(((share(F.col("d").isNotNull()) >= 0.9) & (share(F.col("d").isNotNull() & (F.col("d") != F.col("token"))) >= 0.02)).alias("byte_level"))


def decode_vocab(vocab: DataFrame) -> DataFrame:
    """Byte-level vocabularies as text, the lowest id on a clash; undecodable tokens stay."""
    j = vocab.join(F.broadcast(is_byte_level(vocab)), "tokenizer")
    text: Column = F.when(F.col("byte_level"), F.coalesce(decode_column("token"), F.col("token"))).otherwise(F.col("token"))
    return j.withColumn("token", text).groupBy("tokenizer", "token").agg(F.min("token_id").alias("token_id"))
