"""Ranked lexical search by a bit-sliced impact index.

``build`` cuts the documents into blocks, each a row for every term of the block: which of the block's documents hold it and how often.
A block has at most BLOCK_DOCS documents, numbered in the order of their ids, and about BLOCK_POSTINGS postings; it is made where its
documents are read, so nothing is shuffled, and a frequent term is spread over all blocks.

``search`` turns the postings of the wanted terms into impacts, which need the corpus's counts: an impact is the term's weight times the saturated
frequency, a whole number. In a block the impacts of a term are slices: slice b is a bitmap of the documents whose impact has bit b. Only words of
64 documents that hold the term are stored. A query's scores are the sum of its terms' impacts, added slice by slice with carries, for all documents of a
word at once. The best k are found from the most significant slice down: documents that have the bit stay before those that haven't, as long as there are more than k;
what is still equal at the end is taken in the order of ids. So no score is made but those of the documents that are returned.

Terms are the maximal runs of letters and digits of ASCII and of all other characters outside it, A-Z lower-cased. Null and empty texts have no terms; they
aren't counted, nor found. Repeated rows are documents of their own; documents without an id come after the others of equal scores. Texts of any length are read
whole, in windows. Rows of queries with the same id are one query, of the terms of all; one without terms finds nothing; the null id is an id. Other columns
are ignored, whatever their names. Equal 64-bit hashes of two terms in one window would be taken for one term: 1 in 10^10 for a window of 100,000 terms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tarnwork.llm import bytehash, common

#: Not part of a term, and the letters that are lower-cased. Fixed by the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the score: scale of the frequencies, of the weights, and the shares of a text's length.
SCALE, WEIGHT, HALF, LENGTH = 10**9, 1000, 8, 90
#: Documents and postings of a block, and bytes of text that are cut into terms at once; a text may give a block more postings.
BLOCK_DOCS, BLOCK_POSTINGS, WINDOW_BYTES = 1 << 13, 1 << 20, 1 << 20
#: Terms of queries that are sent to the tasks at once, about, and queries whose slices a task adds at once.
BATCH_TERMS, QUERIES = 1 << 18, 128
#: A term's row: df documents, their numbers and frequencies. A block's own row has no term: df documents with a term, ids, lengths, and the terms in all.
INDEX = "block string, term string, df int, docs binary, tfs binary, ids array<long>, lengths array<long>, tokens long"
_IS_TERM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Block:
    """Documents until they are written: of each window the terms, their documents and frequencies."""

    def __init__(self) -> None:
        self.ids: list = []
        self.terms: dict[bytes, int] = {}
        self.term, self.doc, self.tf = [], [], []
        self.postings = 0

    def window(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> None:
        hashes = bytehash.slices(lower, starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = lower.tobytes()
        known = self.terms
        names = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts[first].tolist(), ends[first].tolist())], np.int64)
        pair, tf = np.unique(names[which] << 32 | docs, return_counts=True)
        self.term.append((pair >> 32).astype(np.uint32))
        self.doc.append((pair & 0xFFFFFFFF).astype(np.uint16))
        self.tf.append(tf.astype(np.uint32))
        self.postings += len(pair)

    def batch(self) -> pa.RecordBatch:
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        lengths = np.zeros(n, np.int64)
        cols: list = [[], [], [], []]
        if self.postings:
            doc = number[np.concatenate(self.doc)]
            key, tf = np.concatenate(self.term).astype(np.int64) << 16 | doc, np.concatenate(self.tf).astype(np.int64)
            at = np.argsort(key, kind="stable")
            key, tf = key[at], tf[at]
            new = np.flatnonzero(np.diff(key, prepend=-1))  # a long text's windows meet here
            key, tf = key[new], np.add.reduceat(tf, new)
            doc = key & 0xFFFF
            lengths = np.bincount(doc, tf, n).astype(np.int64)
            begin = np.flatnonzero(np.diff(key >> 16, prepend=-1))
            names = list(self.terms)
            cols = [[names[t].decode(errors="replace") for t in (key[begin] >> 16).tolist()], np.diff(begin, append=len(key)), _pieces(doc.astype("<u2"), begin), _pieces(tf.astype("<u4"), begin)]
        terms = len(cols[0])
        lists = lambda values: pa.array([*[None] * terms, values], pa.list_(pa.int64()))
        nothing = pa.array([None], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex] * (terms + 1)), pa.array([*cols[0], None], pa.string()), pa.array([*cols[1], int((lengths > 0).sum())], pa.int32()),
             *(pa.concat_arrays([c, nothing]) if terms else nothing for c in cols[2:]), lists([self.ids[i] for i in order]), lists(lengths.tolist()), pa.array([*[None] * terms, int(lengths.sum())], pa.int64())],
            names=["block", "term", "df", "docs", "tfs", "ids", "lengths", "tokens"],
        )


def _pieces(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    at = np.append(begin, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about WINDOW_BYTES that end with a row or before a byte outside terms."""
    at, end = 0, int(offsets[-1])
    while at < end:
        to = min(at + WINDOW_BYTES, end)
        while to < end and _IS_TERM[data[to]] and _IS_TERM[data[to - 1]]:
            gap = np.flatnonzero(~_IS_TERM[data[to : to + 4096]])
            to = min(end, to + (int(gap[0]) if len(gap) else 4096))
        yield at, to
        at = to


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for batch in batches:
        ids, (data, offsets) = batch.column(0).to_pylist(), bytehash.buffers(batch.column(1))
        at = 0
        while at < len(ids):
            room = min(len(ids) - at, BLOCK_DOCS - len(block.ids), max(1, int(np.searchsorted(offsets, offsets[at] + WINDOW_BYTES, "right")) - 1 - at))
            part, cuts = data[offsets[at] : offsets[at + room]], offsets[at : at + room + 1] - offsets[at]
            base = len(block.ids)
            block.ids += ids[at : at + room]
            for a, b in _windows(part, cuts):
                inner = cuts[(cuts > a) & (cuts < b)] - a
                starts, ends, _ = bytehash.runs(_IS_TERM[part[a:b]], inner)
                if len(starts):
                    block.window(_LOWER[part[a:b]], starts, ends, base + np.searchsorted(cuts, starts + a, "right") - 1)
            at += room
            if len(block.ids) >= BLOCK_DOCS or block.postings >= BLOCK_POSTINGS:
                yield block.batch()
                block = _Block()
    if block.ids:
        yield block.batch()


def build(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the index of all documents to ``out``; returns it, read back."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_index, INDEX).write.parquet(out)
    return spark.read.schema(INDEX).parquet(out)


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, [] for null."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)))


def weigh(index: DataFrame, wanted: DataFrame) -> tuple[DataFrame, int, int]:
    """wanted (item, term) with the weight w of each term that documents hold; documents with a term, terms in all."""
    n, total = index.filter(F.col("term").isNull()).agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    names = common.few(common.materialise(wanted.select("term").distinct(), "search-terms"))
    df = index.filter(F.col("term").isNotNull()).select("term", "df").join(names, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(WEIGHT * F.ln(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighed = wanted.join(df.select("term", w.alias("w")), "term")
    return weighed, n, total


class _Slices:
    """The impacts of terms in one block as bitmaps, a slice for each bit: words of 64 documents that hold the term."""

    def __init__(self, docs: list[np.ndarray], impacts: list[np.ndarray]) -> None:
        sizes = np.array([len(d) for d in docs])
        doc, impact = np.concatenate(docs), np.concatenate(impacts).astype(np.uint64)
        word = np.repeat(np.arange(len(docs)) << 32, sizes) | doc >> 6
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        place = (doc & 63).astype(np.uint64)
        self.bits = int(impact.max()).bit_length()
        one = np.uint64(1)
        self.slices = [np.bitwise_or.reduceat((impact >> np.uint64(b) & one) << place, begin) for b in range(self.bits)]
        self.word = word[begin] & 0xFFFFFFFF
        term = word[begin] >> 32
        self.count = np.bincount(term, minlength=len(docs))
        self.first = np.cumsum(self.count) - self.count


def _sums(slices: _Slices, queries: list[np.ndarray], words: int) -> np.ndarray:
    """Slices (bit, query, word) of the scores of each query, a list of term numbers."""
    longest = max(len(q) for q in queries)
    total = slices.bits + max(1, longest).bit_length()
    out = np.zeros((total, len(queries) * words), np.uint64)
    for k in range(longest):
        who = np.array([i for i, q in enumerate(queries) if len(q) > k])
        term = np.array([queries[i][k] for i in who])
        at = bytehash.ragged(slices.first[term], slices.count[term])
        to = np.repeat(who * words, slices.count[term]) + slices.word[at]
        carry = np.zeros(len(to), np.uint64)
        for b in range(total):
            have = out[b][to]
            if b < slices.bits:
                add = slices.slices[b][at]
                half = have ^ add
                out[b][to] = half ^ carry
                carry = have & add | half & carry
            elif carry.any():
                out[b][to] = have ^ carry
                carry = have & carry
            else:
                break
    return out.reshape(total, len(queries), words)


def _best(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, document number and score of the k best of each query, those of equal scores with the lowest numbers; scores above 0 only."""
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    open_ = np.bitwise_or.reduce(sums, axis=0)
    sure = np.zeros_like(open_)
    for s in sums[::-1]:
        with_bit = open_ & s
        many = (count(sure) + count(with_bit) > k)[:, None]
        sure = np.where(many, sure, sure | with_bit)
        open_ = np.where(many, with_bit, open_ & ~s)
    bits = lambda x: np.unpackbits(np.ascontiguousarray(x).astype("<u8").view(np.uint8), axis=1, bitorder="little").astype(bool)
    equal = bits(open_)
    room = (k - count(sure))[:, None]
    query, doc = np.nonzero(bits(sure) | (equal & (np.cumsum(equal, axis=1) <= room)))
    score = np.zeros(len(doc), np.int64)
    for b, s in enumerate(sums):
        score |= ((s[query, doc >> 6] >> (doc & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << b
    return query, doc, score


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of every query: the queries' ids, rank, doc_id, score."""
    kind = queries.schema[id_col].dataType
    wanted = queries.select(F.col(id_col).alias("item"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()
    weighed, n, total = weigh(index, wanted)
    weighed = common.materialise(weighed.filter(F.col("w") > 0), "search-weights")
    batches = max(1, -(-weighed.count() // BATCH_TERMS))
    found = [_search_batch(index, weighed.filter(F.pmod(F.xxhash64("item"), F.lit(batches)) == b), n, total, k, kind) for b in range(batches)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    out = out.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def _search_batch(index: DataFrame, weighed: DataFrame, n: int, total: int, k: int, kind) -> DataFrame:
    """item, doc_id, score of the k best of each block for a bounded number of queries."""
    spark = index.sparkSession
    rows = weighed.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms")).collect()  # BATCH_TERMS at most, about
    weight = {t["term"]: t["w"] for r in rows for t in r["terms"]}
    names = sorted(weight)
    number = {t: i for i, t in enumerate(names)}
    sent = spark.sparkContext.broadcast((names, np.array([weight[t] for t in names], np.int64), [r["item"] for r in rows], [np.array([number[t["term"]] for t in r["terms"]], np.int64) for r in rows]))

    def best(block: pa.Table) -> pa.Table:
        names, weights, items, queries = sent.value
        own = block.filter(pc.is_null(block["term"]))
        ids, lengths = own["ids"].to_pylist()[0], np.array(own["lengths"].to_pylist()[0], np.int64)
        block = block.filter(pc.is_valid(block["term"]))
        at = pc.index_in(block["term"], pa.array(names, block["term"].type)).to_numpy()
        docs = [d.astype(np.int64) for c in block["docs"].chunks for d in bytehash.blobs(c, "<u2")]
        tfs = [t.astype(np.int64) for c in block["tfs"].chunks for t in bytehash.blobs(c, "<u4")]
        place = np.full(len(names), -1)
        place[at] = np.arange(len(at))
        norm = 100 - LENGTH + LENGTH * lengths * n // total if total else lengths
        impacts = [weights[a] * (SCALE * t // (1000 * t + HALF * norm[d])) for a, d, t in zip(at, docs, tfs)]
        here = [p[p >= 0] for p in (place[q] for q in queries)]
        some = [i for i, q in enumerate(here) if len(q)]
        out = {"item": [], "doc_id": [], "score": []}
        slices = _Slices(docs, impacts) if some else None
        for i in range(0, len(some), QUERIES):
            part = some[i : i + QUERIES]
            query, doc, score = _best(_sums(slices, [here[j] for j in part], -(-len(ids) // 64)), k)
            out["item"] += [items[part[j]] for j in query]
            out["doc_id"] += [ids[j] for j in doc]
            out["score"] += score.tolist()
        return pa.table([pa.array(out[c], t) for c, t in zip(out, (to_arrow_type(kind), pa.int64(), pa.int64()))], names=list(out))

    terms = spark.createDataFrame([(t,) for t in names], "term string")
    wanted = index.join(F.broadcast(terms.withColumn("_wanted", F.lit(True))), "term", "left").filter(F.col("term").isNull() | F.col("_wanted"))
    return wanted.select("block", "term", "docs", "tfs", "ids", "lengths").groupBy("block").applyInArrow(best, f"item {kind.simpleString()}, doc_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(common.table(spark, sf_dir, "documents"), common.scratch(spark, "search-index"))
    return search(index, common.table(spark, sf_dir, "benchmark"))


SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
n AS (SELECT count(*) AS n, sum(len(t)) AS l FROM t WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
p AS (SELECT r, doc_id, len, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS len, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, cast(floor({WEIGHT} * ln(cast(2 * (SELECT n FROM n) + 2 AS double) / cast(2 * count(*) + 1 AS double))) AS bigint) AS w FROM p GROUP BY term),
s AS (SELECT item_id, r, doc_id, cast(sum(w * (({SCALE} * tf) // (1000 * tf + {HALF} * ({100 - LENGTH} + ({LENGTH} * len * (SELECT n FROM n)) // (SELECT cast(l AS bigint) FROM n))))) AS bigint) AS score FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT item_id, cast(rank AS int) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
