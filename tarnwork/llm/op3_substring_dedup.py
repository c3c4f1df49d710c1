"""Substring dedup by hashing units of text.

A unit is a line cut at its marks (``.,!?;:``): its words, A-Z lower-cased, whatever stands between them.
Units are digested to 64 bits and grouped over all documents; the occurrence in the document with the
smallest id, and in it the first, is kept. A repeated unit alone says little when it is short, so what is
removed are runs of repeated units, next to each other, that hold ``MIN_RUN`` words or more: repeated
lines, paragraphs, and passages inside other lines, less a broken unit at either end.

With ``min_line`` every line of so many characters, from its first word to its last, is a unit as well: a line that repeats goes,
however few words it has, all but its first occurrence. So do paragraphs, as lines. The registered query and the pipeline take lines of ``MIN_LINE`` characters.

With ``window`` every run of so many words is digested as well, at each word and across all marks, so a
passage of that length goes wherever it stands, broken units and all. A character of a script without
spaces (``lone``) is a word of its own there. Of a repeat that overlaps its own first occurrence only what
lies behind it goes. The registered query and the pipeline have windows of ``MIN_RUN`` words.

The result has the text that is left, and the spans of the original text (in characters) that it is made
of, so every character can be traced back.

A task sends each digest once, with its smallest id; the other documents of the task that have it know
already that they repeat it. What travels is about ten bytes for a unit or window, and the compressed texts once.

Null text stays null, with no spans. Rows that repeat an id count as one document: what they share among
themselves stays. Rows without an id are left as they are. Other columns come through unchanged, but those
named like the three that are added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tarnwork.llm import bytehash, common

#: Words of a run of repeated units that is removed.
MIN_RUN = 20
#: Characters of a line that is removed as such: shorter ones are list marks, numbers, closing brackets.
MIN_LINE = 10
BATCH_BYTES = 1 << 19
FLUSH = 750_000
_SPACE, _MARK, _LINE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_MARK[[ord(c) for c in ".,!?;:\n"]] = True
_LINE[10] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWER = 0xD1342543DE82EF95
_WINDOW, _WHOLE = np.uint64(0x8BB84B93962EACC9), np.uint64(0x2F0B4C47A3D9E561)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """What units, lines and windows of the same rows have in common: lower-cased bytes, the words' starts, ends and rows, sums of their hashes."""
    low = _LOWER[data]
    starts, ends, row = bytehash.words(np.where(_MARK[low], np.uint8(32), low), offsets)
    return low, starts, ends, row, _sums(low, starts, ends)


def _sums(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    w = bytehash.slices(low, starts, ends)
    up, _ = bytehash._power_tables(_POWER, len(w) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)], dtype=np.uint64)])


def units(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _MARK, salt: np.uint64 = np.uint64(0), found: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Of rows (bytes, n + 1 offsets; ``found``: their ``_words``, if known) the units between ``breaks``: row, digest, words, start (its first word's) and end (its last word's)."""
    low, starts, ends, row, sums = found or _words(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none, none
    marks = np.concatenate([[0], np.cumsum(breaks[low])])
    new = np.ones(len(starts), bool)
    new[1:] = (row[1:] != row[:-1]) | (marks[starts[1:]] != marks[ends[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts))
    _, down = bytehash._power_tables(_POWER, len(sums))
    digest = bytehash.mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) + salt)
    return row[first], digest, last - first, starts[first], ends[last - 1]


def lines(data: np.ndarray, offsets: np.ndarray, least: int, found: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Of rows the lines with ``least`` characters from the first word to the last: row, digest, start, end."""
    row, digest, _, start, end = units(data, offsets, _LINE, _WHOLE, found)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = chars[end] - chars[start] >= least
    return row[long], digest[long], start[long], end[long]


def lone(low: np.ndarray) -> np.ndarray:
    """Places of characters (of three bytes) of scripts without spaces: kana, Han, Thai, Lao, Myanmar, Khmer."""
    if not len(low) or low.max() < 0xE0:
        return np.zeros(0, np.int64)
    after = np.append(low[1:], np.uint8(0))
    found = (low >= 0xE3) & (low <= 0xE9)
    found |= (low == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
    found |= (low == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F))
    return np.flatnonzero(found)


def windows(data: np.ndarray, offsets: np.ndarray, size: int, found: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Of rows the starts of their words, and of each run of ``size`` words: its first word, row and digest."""
    low, starts, ends, row, sums = found or _words(data, offsets)
    own = lone(low)
    if len(own):
        behind = own + 3
        behind = behind[behind < ends[np.searchsorted(starts, own, "right") - 1]]
        cuts = np.unique(np.concatenate([starts, own, behind]))
        word = np.searchsorted(starts, cuts, "right") - 1
        starts, ends, row = cuts, np.minimum(np.append(cuts[1:], len(low)), ends[word]), row[word]
        sums = _sums(low, starts, ends)
    n = max(0, len(starts) - size + 1)
    _, down = bytehash._power_tables(_POWER, len(sums))
    at = np.flatnonzero(row[:n] == row[size - 1 :][:n])
    digest = bytehash.mix((sums[at + size] - sums[at]) * down[at] + _WINDOW)
    return starts, at, row[at], digest


def _scan(buckets: int, window: int, min_line: int):
    """Rows (doc_id, text). Of kind 0 the digests (packed, by document) that a smaller id in the task has; of kind 1, packed by bucket, each digest of the task with its smallest id."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, ids, held = [], [], 0
        for batch in parts:
            key = batch.column(0).to_numpy()
            data, offsets = bytehash.buffers(batch.column(1))
            for i, j in bytehash.split_rows(offsets, BATCH_BYTES):
                part, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = _words(part, edges)
                row, digest, *_ = units(part, edges, found=words)
                found = [(row, digest), windows(part, edges, window, words)[2:]] if window else [(row, digest)]
                if min_line:
                    found.append(lines(part, edges, min_line, words)[:2])
                for row, digest in found:
                    digests.append(digest)
                    ids.append(key[i:j][row])
                    held += len(digest)
                if held > FLUSH:
                    yield from _sent(digests, ids, buckets)
                    digests, ids, held = [], [], 0
        if held:
            yield from _sent(digests, ids, buckets)

    return run


def _owned(digest: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by digest: digests and documents; the place of each distinct digest's first, and its smallest document."""
    order = np.argsort(digest)
    digest, doc = digest[order], doc[order]
    first = np.ones(len(digest), bool)
    first[1:] = digest[1:] != digest[:-1]
    first = np.flatnonzero(first)
    return digest, doc, first, np.minimum.reduceat(doc, first)


def _sent(digests: list, ids: list, buckets: int) -> Iterator[pa.RecordBatch]:
    digest, doc, first, owner = _owned(np.concatenate(digests), np.concatenate(ids).astype(np.int64))
    again = doc != np.repeat(owner, np.diff(np.append(first, len(digest))))
    for batch in _by_key(doc[again], digest[again]):
        grp = bytehash.mix(batch.column(0).to_numpy().astype(np.uint64)) % np.uint64(buckets)
        yield _row(0, grp.astype(np.int64), *batch.columns)
    digest = digest[first]
    # buckets are ranges of the digest; a bucket's documents are sent once each, with a place for each digest
    group = ((digest >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(group, np.arange(buckets + 1))
    table, place = np.unique(owner, return_inverse=True)
    for g in np.flatnonzero(np.diff(edges)).tolist():
        a, b = int(edges[g]), int(edges[g + 1])
        used = np.zeros(len(table), bool)
        used[place[a:b]] = True
        docs = table[used]
        at = (np.cumsum(used) - 1)[place[a:b]].astype("<u2" if len(docs) <= 1 << 16 else "<u4")
        blob = np.array([b - a, at.itemsize], "<i8").tobytes() + _planes(digest[a:b]) + at.tobytes() + _planes(np.diff(docs, prepend=0))
        yield _row(1, np.array([g]), pa.array([None], pa.int64()), pa.array([blob], pa.binary()))


def _planes(values: np.ndarray) -> bytes:
    """64-bit values byte by byte, the highest of all first: those of sorted values, or of small differences, are nearly all the same."""
    return values.astype(f">{values.dtype.kind}8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(f">{kind}8").ravel().astype(f"{kind}8")


def _row(kind: int, grp: np.ndarray, key: pa.Array, data: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(grp), kind, np.int32)), pa.array(grp), key, data], names=["kind", "grp", "key", "data"])


def _by_key(key: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, data) with the values of each key packed one array after the other."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    values = [v[order] for v in values]
    edges = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] - 1)), len(key)) if len(key) else np.zeros(1, np.int64)
    for i in range(0, len(edges) - 1, 2000):
        ab = list(zip(edges[i : i + 2000].tolist(), edges[i + 1 : i + 2001].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([int(key[a]) for a, _ in ab], pa.int64()), pa.array([b"".join(v[a:b].tobytes() for v in values) for a, b in ab], pa.binary())], names=["key", "data"])


def _gather(table: pa.Table) -> pa.Table:
    """Of one bucket, packed by document: what its tasks know already (kind 0), or the digests that a smaller id in another task has (kind 1)."""
    if table["kind"][0].as_py() == 0:
        return table.select(["key", "data"])
    digest, doc = [], []
    for blob in table["data"].to_pylist():
        n, width = np.frombuffer(blob, "<i8", 2).tolist()
        at = 16 + 8 * n
        digest.append(_unplanes(blob[16:at], "u"))
        doc.append(np.cumsum(_unplanes(blob[at + width * n :], "i"))[np.frombuffer(blob, f"<u{width}", n, at)])
    digest, doc, first, owner = _owned(np.concatenate(digest), np.concatenate(doc))
    owner = np.repeat(owner, np.diff(np.append(first, len(digest))))
    return pa.Table.from_batches(_by_key(doc[doc != owner], digest[doc != owner]), pa.schema([("key", pa.int64()), ("data", pa.binary())]))


def _zip_texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    codec = zstandard.ZstdCompressor(level=1)
    for batch in parts:
        data = [None if t is None else codec.compress(t.encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), *batch.columns[2:]], names=["key", "data", *batch.schema.names[2:]])


def _among(digest: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which digests are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(digest), bool)
    return known[np.minimum(np.searchsorted(known, digest), len(known) - 1)] == digest


def cut(text: bytes, repeated: np.ndarray, min_run: int, window: int = 0, min_line: int = 0) -> tuple[list[tuple[int, int]], int, int]:
    """Spans of the text that are kept, units of which something and words that are removed; ``repeated``: digests that smaller ids have."""
    data = np.frombuffer(text, np.uint8)
    offsets = np.array([0, len(data)])
    made = _words(data, offsets)
    _, digest, n, start, end = units(data, offsets, found=made)
    if not len(digest):
        return [(0, len(text))] if text else [], 0, 0
    repeated = np.sort(repeated)
    again = _among(digest, repeated)
    seen = np.ones(len(digest), bool)
    seen[np.unique(digest, return_index=True)[1]] = False
    again |= seen
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
    runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()) if int(n[a:b].sum()) >= min_run]
    if not window:
        starts, first = start, np.arange(len(start) + 1)
        words = n
    else:
        starts, at, _, found = windows(data, offsets, window, made)
        first = np.append(np.searchsorted(starts, start), len(starts))
        words = np.ones(len(starts), np.int64)
    # +1 where removed words (units without windows) begin, -1 behind their end
    change = np.zeros(len(starts) + 1, np.int64)
    for a, b in runs:
        change[first[a]] += 1
        change[first[b]] -= 1
    if min_line:
        _, whole, start, end = lines(data, offsets, min_line, made)
        later = np.ones(len(whole), bool)
        later[np.unique(whole, return_index=True)[1]] = False
        later |= _among(whole, repeated)
        np.add.at(change, np.searchsorted(starts, start[later]), 1)
        np.add.at(change, np.searchsorted(starts, end[later]), -1)
    if window and len(found):
        distinct, place, inverse = np.unique(found, return_index=True, return_inverse=True)
        elsewhere = _among(distinct, repeated)[inverse]
        begin = np.where(elsewhere, at, np.maximum(at, at[place][inverse] + window))
        gone = elsewhere | (at != at[place][inverse])
        np.add.at(change, begin[gone], 1)
        np.add.at(change, at[gone] + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    spans, at = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if starts[a] > at:
            spans.append((at, int(starts[a])))
        at = int(starts[b]) if b < len(starts) else len(text)
    if at < len(text):
        spans.append((at, len(text)))
    return spans, int(np.logical_or.reduceat(gone, first[:-1]).sum()), int(words[gone].sum())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, window: int = 0, min_line: int = 0) -> DataFrame:
    """``docs`` with its text reduced, and _spans, _units_removed, _words_removed."""
    spark = docs.sparkSession
    common.small_batches(spark)
    width = common.shuffle_width(spark)
    buckets = max(256, 4 * width)
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    # one scan gives both: what a task knows of its own rows must be of the same scan as what it sends
    scan = rows.mapInArrow(_scan(buckets, window, min_line), "kind int, grp long, key long, data binary")
    marks = scan.groupBy("kind", "grp").applyInArrow(_gather, "key long, data binary")
    added = ("_spans", "_units_removed", "_words_removed")
    own = [c for c in docs.columns if c not in added]
    others = [c for c in own if c not in (id_col, text_col)]
    kept = docs.select(F.col(id_col), *(F.col(f"`{c}`") for c in others)).schema
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"), F.struct(F.col(id_col), *(F.col(f"`{c}`") for c in others)).alias("rest"))
    texts = texts.mapInArrow(_zip_texts, StructType().add("key", "long").add("data", "binary").add("rest", kept))
    marks = marks.withColumn("rest", F.lit(None).cast(texts.schema["rest"].dataType)).withColumn("kind", F.lit(0))
    both = marks.unionByName(texts.withColumn("kind", F.lit(1)))
    # rows without an id are dealt out evenly
    both = both.repartition(width, F.coalesce("key", F.xxhash64("data"))).sortWithinPartitions("key", "kind")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = zstandard.ZstdDecompressor()
        now, repeated = None, []
        for batch in parts:
            keep, cols = [], ([], [], [], [])
            for k, (key, data, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "data", "kind")))):
                if key != now:
                    now, repeated = key, []
                if kind == 0:
                    repeated.append(np.frombuffer(data, np.uint64))
                    continue
                keep.append(k)
                if data is None:
                    found = (None, None, 0, 0)
                else:
                    text = codec.decompress(data)
                    spans, n, w = cut(text, np.concatenate(repeated) if repeated else np.zeros(0, np.uint64), min_run, window, min_line) if key is not None else ([(0, len(text))], 0, 0)
                    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                    found = (b"".join(text[a:b] for a, b in spans).decode(), [{"start": int(chars[a]), "end": int(chars[b])} for a, b in spans], n, w)
                for c, v in zip(cols, found):
                    c.append(v)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.string(), span, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rest").take(pa.array(keep, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["rest", "text", "spans", "units", "words"])

    schema = StructType().add("rest", kept).add("text", "string").add("spans", ArrayType(StructType().add("start", "integer").add("end", "integer"))).add("units", "long").add("words", "long")
    out = both.select("key", "data", "rest", "kind").mapInArrow(run, schema)
    back = [F.col("text").alias(text_col) if c == text_col else F.col("rest").getField(c).alias(c) for c in own]
    return out.select(*back, F.col("spans").alias("_spans"), F.col("units").alias("_units_removed"), F.col("words").alias("_words_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"), window=MIN_RUN, min_line=MIN_LINE)
    return out.select("doc_id", "text", F.col("_spans").alias("spans"), F.col("_units_removed").alias("units_removed"), F.col("_words_removed").alias("words_removed"))
