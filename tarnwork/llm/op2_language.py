"""Language identification with bit-sliced Bloom filters over byte n-grams.

Each slot of one table holds a bitmask of languages; a 4-byte n-gram sets its language's bit in K slots.
The AND of its K slots gives, in one look-up, all languages whose filter holds the n-gram. A text's bits
are counted for each language, and the counts are corrected for false positives: of N n-grams a filter
that answers yes by chance at rate f lets N f pass, so (count - N f) / (1 - f) remain. The language with
the most decides; the score is its part of all languages' corrected counts.

The filters are learned from a bounded sample of labelled texts (``PER_LANG`` texts for each of the ``MOST_LANGS``
most frequent languages, picked by a hash of the id): an n-gram belongs to a language if it makes up RARE of the language's n-grams
or more (so at most 1 / RARE of them), and at least CLEAN of its largest share in any language, which
keeps passages in other languages out. With so many languages that this would be more than MOST_GRAMS n-grams
or TABLE_BYTES of filters, RARE is higher and the filters are shorter, and let more n-grams pass by chance. Prediction reads the whole text and nothing else.

Null texts and texts without a letter are ``und`` with score 0. A text with letters but no known n-gram
gets the most frequent language with score 0. Ties go to the language first in order. Rows with null
labels, or of languages with fewer than MIN_DOCS texts, are not learned from. Without any learned
language all is ``und``. Repeated rows are predicted each; other columns are ignored, and those to keep come
through whatever their names, but ``lang_pred`` and ``score``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import bytehash, common

PER_LANG = 4000
MIN_DOCS = 5
MOST_LANGS, MOST_GRAMS, TABLE_BYTES = 4096, 2_000_000, 64 << 20
RARE = 1e-5
CLEAN = 0.15
HASHES = 3
#: Slots for each n-gram of a language, about.
SLOTS = 8
BATCH_BYTES = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")

#: Bytes other than letters count as a space.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some rows at a time: the first row, 4-byte n-grams of the lower-cased texts, and where each row's begin (n + 1 places)."""
    data, offsets = bytehash.buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    for i, j in bytehash.split_rows(offsets, BATCH_BYTES):
        part = _CLASS[data[offsets[i] : offsets[j]]].astype(np.uint32)
        at = offsets[i : j + 1] - offsets[i]
        if len(part) < 4:
            yield i, np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
            continue
        g = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        ok = np.ones(len(part), bool)
        for k in range(3):  # n-grams that would cross into the next row
            last = at[1:] - 1 - k
            ok[last[last >= at[:-1]]] = False
        ok = ok[: len(g)]
        # n-grams with two spaces in a row say nothing
        ok &= ((g & np.uint32(0xFFFF)) != 0x2020) & ((g >> np.uint32(8) & np.uint32(0xFFFF)) != 0x2020) & (g >> np.uint32(16) != 0x2020)
        yield i, g[ok], np.concatenate([[0], np.cumsum(ok)])[np.minimum(at, len(g))]


def _slots(g: np.ndarray, slots: int) -> list[np.ndarray]:
    h = bytehash.mix(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return [((h >> np.uint64(21 * k)) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """The table, a mask of languages in each slot (as many 64-bit words as they need), and each filter's rate of chance answers."""

    def __init__(self, langs: list[str], index: np.ndarray, gram: np.ndarray, frequent: int):
        self.langs, self.frequent = langs, frequent
        most = min(1 << 21, TABLE_BYTES // 8 // max(1, -(-len(langs) // 64)))
        self.slots = min(1 << int(np.log2(most)), 1 << max(10, int(np.ceil(np.log2(SLOTS * max(1, len(np.unique(gram))))))))
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.words = [np.zeros(self.slots, kind) for _ in range(-(-len(langs) // 64))] or [np.zeros(self.slots, kind)]
        for lang in range(len(langs)):
            for s in _slots(gram[index == lang], self.slots):
                self.words[lang // 64][s] |= kind(1 << lang % 64)
        self.chance = np.array([np.count_nonzero(self.words[k // 64] & kind(1 << k % 64)) / self.slots for k in range(len(langs))]) ** HASHES

    def counts(self, g: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Corrected counts, rows by languages."""
        slots, n = _slots(g, self.slots), np.diff(at)
        out = np.zeros((len(n), len(self.langs)))
        for w, table in enumerate(self.words):
            mask = table[slots[0]]
            for s in slots[1:]:
                mask &= table[s]
            for k in range(64 * w, min(len(self.langs), 64 * w + 64)):
                hit = np.concatenate([[0], np.cumsum(mask >> mask.dtype.type(k % 64) & mask.dtype.type(1), dtype=np.int64)])
                out[:, k] = np.maximum(0, (np.diff(hit[at]) - n * self.chance[k]) / max(1e-9, 1 - self.chance[k]))
        return out


def learn(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from the rows with ``train`` true and a label."""
    common.small_batches(docs.sparkSession)
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().filter(F.col("count") >= MIN_DOCS).orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], np.zeros(0, np.int64), np.zeros(0, np.uint32), 0)
    rates = docs.sparkSession.createDataFrame([(x, k, int(1e6 * min(1.0, PER_LANG / sizes[x]))) for k, x in enumerate(langs)], "lang string, place int, rate int")
    sample = rows.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < F.col("rate"))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            lang = batch.column(1).to_numpy().astype(np.int64)
            for i, g, at in grams(batch.column(0)):
                row = np.repeat(lang[i : i + len(at) - 1], np.diff(at))
                key, n = np.unique(g.astype(np.int64) | row << 32, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = common.materialise(sample.select("text", "place").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    lang = F.shiftright("key", 32)
    total = counted.groupBy(lang.alias("l")).agg(F.sum("n").cast("double").alias("total"))  # a row for each language
    share = counted.join(F.broadcast(total), lang == F.col("l")).select("key", (F.col("n") / F.col("total")).alias("p"))
    kept = share.filter(F.col("p") >= max(RARE, len(langs) / MOST_GRAMS)).toArrow()  # at most MOST_GRAMS
    common.release(counted)
    key, p = kept["key"].to_numpy(), kept["p"].to_numpy()
    gram, index = (key & 0xFFFFFFFF).astype(np.uint32), key >> 32
    _, inverse = np.unique(gram, return_inverse=True)
    top = np.zeros(inverse.max() + 1 if len(inverse) else 0)
    np.maximum.at(top, inverse, p)
    clean = p >= CLEAN * top[inverse]
    return Filters(langs, index[clean], gram[clean], langs.index(max(sizes, key=lambda x: (sizes[x], x))))


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (the id and the text's own stay out unless named) with lang_pred and score."""
    common.small_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    kept = docs.select(*(F.col(f"`{c}`") for c in keep)).schema
    rows = docs.select(*(F.col(f"`{c}`").alias(f"u{k}") for k, c in enumerate(keep)), F.col(text_col).alias("text"))
    schema = kept.add("lang_pred", "string").add("score", "double")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in parts:
            texts = batch.column(batch.num_columns - 1)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            letters = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
            if f.langs:
                for i, g, at in grams(texts):
                    c = f.counts(g, at)
                    best, total = c.argmax(1), c.sum(1)
                    some = total > 0
                    for k in np.flatnonzero(letters[i : i + len(best)]):
                        lang[i + k] = f.langs[best[k] if some[k] else f.frequent]
                        score[i + k] = c[k, best[k]] / total[k] if some[k] else 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang.tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs, ~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
