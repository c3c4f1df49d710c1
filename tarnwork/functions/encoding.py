"""Encoding texts with tokenizer files, in Arrow batches on the executors.

A ``.json`` file is read by the ``tokenizers`` library, a ``.model`` file by ``sentencepiece``. The path is a parameter; each
worker reads the file once, from its own machine.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Texts that are encoded in one call.
TEXTS = 256


class Encoder:
    """``encode`` gives the ids of each text without special tokens; ``unknown`` is the id of what the vocabulary lacks (-1 without one), ``refused`` are the ids that stand for no text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode: Callable[[list[str]], list[list[int]]] = lambda texts: model.encode(texts, num_threads=1)
            self.tokens = lambda: [(model.id_to_piece(i), i) for i in range(model.get_piece_size())]
            self.unknown = model.unk_id()
            self.refused = {i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i)}
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True  # their strings in a text are text
            self.encode = lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
            self.tokens = lambda: sorted(tok.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
            unknown = getattr(tok.model, "unk_token", None)
            self.unknown = tok.token_to_id(unknown) if unknown and tok.token_to_id(unknown) is not None else -1
            self.refused = {i for i, t in tok.get_added_tokens_decoder().items() if t.special} | ({self.unknown} - {-1})


@lru_cache(maxsize=4)
def load(path: str) -> Encoder:
    return Encoder(path)


def public_path(name: str) -> str:
    """Where a public vocabulary lies; asked for on the machine that reads it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoded(df: DataFrame, text: str, file: str | Callable[[], Encoder], name: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text`` (null: none) as an array column. ``file``: a path, the name of a public vocabulary, or what makes an encoder."""
    schema = df.drop(name).schema.add(name, ArrayType(IntegerType()))
    rows = df.drop(name).withColumn("_encoded_text", F.coalesce(F.col(text), F.lit("")))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = file() if callable(file) else load(file if os.path.sep in file else public_path(file))
        for batch in parts:
            for i in range(0, batch.num_rows, TEXTS):
                some = batch.slice(i, TEXTS)
                ids = pa.array(enc.encode(some.column(some.num_columns - 1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], ids], names=schema.names)

    return rows.mapInArrow(run, schema)


def vocabulary(spark, tokenizer: str, file: str) -> DataFrame:
    """tokenizer, token, token_id of a tokenizer file; vocabularies are small."""
    rows = load(file if os.path.sep in file else public_path(file)).tokens()
    return spark.createDataFrame([(tokenizer, t, i) for t, i in rows], "tokenizer string, token string, token_id long")
