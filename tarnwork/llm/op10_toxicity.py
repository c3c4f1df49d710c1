"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two strings compares their character subsequences of length three within a span of six;
an occurrence of span s weighs DECAY ** s, so letters put between those of an insult, or left out, lower
the kernel a little where they would break a match of words or n-grams. Kernels are normalised.

Instances are the pieces of sentences: lower-cased words between two marks, words without the marks in
them, words of letters and digits with the letters that digits are written for, runs of very short words
joined, and two neighbours of at most SHORT bytes joined ("stu pid"). Training is multiple-instance. Near copies among the labelled texts count
as one text. Signs are pieces that toxic texts have far more often than clean ones, by smoothed log odds (a
clean text that quotes an insult doesn't hide it, and counts against it); the positives are they, the first
of them disguised as well (characters put in, or one in another's stead), and in later rounds the worst piece
of each toxic text without a sign. Negatives are the clean pieces most like the signs, and in later rounds
those that come out worst. Landmarks are signs that aren't too similar to each other, by their number of
toxic texts, the clean pieces nearest to them, and some at large. A linear machine with squared hinge is
trained on the Nyström features K_zz^(-1/2) k_z(x); it folds into one weight for each subsequence, so scoring
a piece is a sum over its own.

A text's evidence is the sum of its distinct pieces' margins, as far as each is above FLOOR: several doubtful
pieces make a text toxic, one doesn't. A logistic curve turns evidence into scores; its middle has the best F1
on the training texts, weighted to the labels' own shares, with the signs alone and disguised besides.

Learning uses a bounded sample (``MOST_TEXTS`` of each class, by a hash of the id) of the labelled rows;
scoring reads whole texts. Rows with null labels or texts aren't learned from; without both classes, or any
sign, every score is near 0. Null and empty texts score as a text without pieces, below 0.5. An id with several
labels is toxic if any is. Repeated rows are scored each, texts with the same pieces alike; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import bytehash, common

MOST_TEXTS = 1500
LENGTH, SPAN, DECAY = 3, 6, 0.75
#: Landmarks at most, of signs (fewer if there are fewer) and of clean pieces.
LANDMARKS = 256
#: Two signs this similar don't both become landmarks.
SAME = 0.8
#: A longer piece is cut into overlapping ones of this many bytes.
PIECE = 24
#: Neighbours of at most this many bytes are also read as one piece.
SHORT = 4
#: Pieces of clean texts that train: those nearest to the signs, then those that come out worst.
NEGATIVES = 6000
#: Rounds of training; after each the worst clean pieces, and the worst pieces of toxic texts, join.
ROUNDS = 3
#: Texts that a piece is thought to have had beforehand, in the classes' proportion, and the log odds from which it is a sign.
PRIOR, SIGN = 4.0, 1.9
#: By how much the margin asked of a sign grows with its log odds.
STEEP = 0.1
#: Weight of the errors against the weights' size.
COST = 5.0
#: Margin from which a piece counts for its text.
FLOOR = 0.4
#: Near copies in the sample: the similarity of their pieces, and the bands and rows of the min-hashes that find them.
COPY, BANDS, ROWS = 0.6, 10, 3
#: Weight of the disguised copies of a sign against the sign.
DISGUISED = 0.5
#: Weight of all lone and disguised signs against all training texts when the curve is fitted.
LONE = 0.3
MAX_PIECES = 1 << 18
BATCH_BYTES = 1 << 18
START, END = 1, 2
_OFFSETS = [(0, *c) for c in combinations(range(1, SPAN), LENGTH - 1)]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many strings (bytes one after the other, n + 1 offsets): string, subsequence and weight of each distinct subsequence."""
    padded = np.concatenate([data, np.zeros(SPAN, np.uint8)]).astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = offsets[1:][row] - np.arange(len(data))  # bytes from here to the string's end
    keys, weights = [], []
    for off in _OFFSETS:
        ok = np.flatnonzero(left > off[-1])
        code = padded[ok]
        for o in off[1:]:
            code = code << np.uint64(8) | padded[ok + o]
        keys.append(row[ok].astype(np.uint64) << np.uint64(24) | code)
        weights.append(np.full(len(ok), DECAY ** (off[-1] + 1)))
    keys, weights = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=np.uint64(0xFFFFFFFFFFFFFFFF)) != 0)
    total = np.add.reduceat(weights, first) if len(first) else weights[:0]
    return (keys[first] >> np.uint64(24)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFF)).astype(np.int64), total


def _join(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)


def _dense(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Landmarks as columns: a table (2**24 codes -> row + 1, 0 if none of them has it) and rows of normalised weights."""
    row, code, w = features(*_join(strings))
    norm = np.sqrt(np.bincount(row, w * w, len(strings)))
    codes, at = np.unique(code, return_inverse=True)
    rows = np.zeros((len(codes) + 1, len(strings)))
    rows[at + 1, row] = w / np.maximum(norm[row], 1e-12)
    table = np.zeros(1 << 24, np.int32)
    table[codes] = np.arange(1, len(codes) + 1)
    return table, rows


def kernels(strings: list[bytes], table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Normalised kernels of strings (rows) with the landmarks (columns)."""
    out = np.zeros((len(strings), rows.shape[1]))
    row, code, w = features(*_join(strings))
    norm = np.sqrt(np.bincount(row, w * w, len(strings)))
    at = table[code]
    hit = np.flatnonzero(at)
    if len(hit):
        first = np.flatnonzero(np.diff(row[hit], prepend=-1))
        out[row[hit][first]] = np.add.reduceat(w[hit, None] * rows[at[hit]], first, axis=0)
    return out / np.maximum(norm, 1e-12)[:, None]


_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[list(b"013457")] = list(b"oieast")


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of lower-cased rows: bytes, starts, ends, row. Words; inner marks dropped; runs of short words joined."""
    keep = _KEEP[data]
    bare = data[keep]
    at = np.concatenate([[0], np.cumsum(keep)])
    starts, ends, row = bytehash.words(data, offsets)
    a, b = at[starts], at[ends]
    some = b > a
    starts, ends, row, a, b = starts[some], ends[some], row[some], a[some], b[some]
    # words without any mark are read in the bare bytes; ends of others are trimmed to their first and last letter
    first, last = np.flatnonzero(keep)[a], np.flatnonzero(keep)[b - 1] + 1
    inner = last - first > b - a
    out_a, out_b, out_row = [a, first[inner] + len(bare)], [b, last[inner] + len(bare)], [row, row[inner]]
    if len(a):  # runs of three words or more of at most two bytes
        short = (b - a) <= 2
        begin = np.flatnonzero(short & np.concatenate([[True], ~short[:-1] | (row[1:] != row[:-1])]))
        end = np.flatnonzero(short & np.concatenate([~short[1:] | (row[1:] != row[:-1]), [True]]))
        run = end - begin >= 2
        out_a.append(a[begin[run]])
        out_b.append(b[end[run]])
        out_row.append(row[begin[run]])
    # of words of letters and digits another reading, with the letters that digits are written for
    digits = np.concatenate([[0], np.cumsum((bare >= 48) & (bare <= 57))])
    mixed = digits[b] - digits[a]
    mixed = np.flatnonzero((mixed > 0) & (mixed < b - a))
    out_a.append(a[mixed] + len(bare) + len(data))
    out_b.append(b[mixed] + len(bare) + len(data))
    out_row.append(row[mixed])
    small = (b - a) <= SHORT
    pair = np.flatnonzero(small[:-1] & small[1:] & (row[:-1] == row[1:]) & (b[1:] - a[:-1] > SHORT)) if len(a) else np.zeros(0, np.int64)
    out_a.append(a[pair])
    out_b.append(b[pair + 1] if len(pair) else b[:0])
    out_row.append(row[pair])
    a, b, row = (np.concatenate(x).astype(np.int64) for x in (out_a, out_b, out_row))
    long = np.flatnonzero(b - a > PIECE)
    if len(long):
        more = [(s, min(s + PIECE, int(b[k])), int(row[k])) for k in long for s in range(int(a[k]), int(b[k]) - PIECE // 2, PIECE // 2)]
        ok = np.ones(len(a), bool)
        ok[long] = False
        x = np.array(more, np.int64)
        a, b, row = np.concatenate([a[ok], x[:, 0]]), np.concatenate([b[ok], x[:, 1]]), np.concatenate([row[ok], x[:, 2]])
    # every piece stands between two marks, so that its ends count like characters
    text = np.concatenate([bare, data, _DIGIT[bare]])
    n = b - a + 2
    ends = np.cumsum(n)
    marked = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint8)
    marked[ends - 1] = END
    inside = np.ones(len(marked), bool)
    inside[ends - n] = inside[ends - 1] = False
    marked[inside] = text[bytehash.ragged(a, b - a)]
    return marked, ends - n, ends, row


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


class Machine:
    """What a fitted machine needs to score: a weight for each subsequence, a bias, and the curve over a text's evidence."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float, slope: float = 1.0, middle: float = 50.0):
        self.codes, self.weights, self.bias, self.slope, self.middle = codes, weights, bias, slope, middle
        self._table = None

    def __getstate__(self):
        return {**self.__dict__, "_table": None, "keys": None, "margins": None}

    def _fill(self) -> None:
        self._table = np.zeros(1 << 24, np.float32)
        self._table[self.codes] = self.weights
        self.keys, self.margins = np.zeros(MAX_PIECES, np.uint64), np.zeros(MAX_PIECES, np.float32)

    def margin(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margins of pieces (bytes one after the other, n + 1 offsets)."""
        if self._table is None:
            self._fill()
        out = np.empty(len(offsets) - 1)
        for i, j in bytehash.split_rows(offsets, 1 << 16):
            row, code, w = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            norm = np.sqrt(np.bincount(row, w * w, j - i))
            out[i:j] = np.bincount(row, w * self._table[code], j - i) / np.maximum(norm, 1e-12) + self.bias
        return out

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Of each text the sum of its distinct pieces' margins, as far as they are above FLOOR."""
        if self._table is None:
            self._fill()
        data, offsets = bytehash.buffers(_lower(texts))
        out = np.zeros(len(offsets) - 1)
        for i, j in bytehash.split_rows(offsets, BATCH_BYTES):
            part, a, b, row = pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            if not len(a):
                continue
            keys, first, inverse = np.unique(bytehash.slices(part, a, b), return_index=True, return_inverse=True)
            # margins met before stand in a table; a piece takes the place of another with the same place
            place = (keys & np.uint64(MAX_PIECES - 1)).astype(np.int64)
            margins = self.margins[place]
            new = np.flatnonzero(self.keys[place] != keys)
            if len(new):
                x, y = a[first[new]], b[first[new]]
                margins[new] = self.margin(part[bytehash.ragged(x, y - x)], np.concatenate([[0], np.cumsum(y - x)]))
                at, k = np.unique(place[new], return_index=True)
                self.keys[at], self.margins[at] = keys[new[k]], margins[new[k]]
            hit = np.flatnonzero(margins[inverse] > FLOOR)
            of, piece = np.divmod(np.unique(row[hit] * len(keys) + inverse[hit]), len(keys))
            out[i:j] = np.bincount(of, margins[piece] - FLOOR, j - i)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.curve(self.evidence(texts))

    def curve(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-self.slope * (evidence - self.middle), -50, 50)))


def _distinct(text: str | None) -> set[bytes]:
    data, offsets = bytehash.buffers(_lower(pa.array([text], pa.large_string())))
    out: set[bytes] = set()
    part, a, b, _ = pieces(data, offsets)
    raw = part.tobytes()
    out.update(raw[x:y] for x, y in zip(a.tolist(), b.tolist()))
    return out


def _order(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=8).digest()


def disguised(piece: bytes) -> list[bytes]:
    """Copies of a marked piece with one or two characters put in, or one put in another's stead, by a rule from the piece itself."""
    out, word = [], piece[1:-1]
    for k in range(1, min(len(word), 9)):
        fill = b"x1e0"[(k + len(word)) % 4 :][:1]
        out.append(word[:k] + fill + word[k:])
        if k + 2 < len(word):
            out.append(word[:k] + fill + word[k : k + 2] + fill + word[k + 2 :])
        if k + 1 < len(word):
            out.append(word[:k] + fill + word[k + 1 :])
    return [bytes([START]) + x + bytes([END]) for x in out]


def grouped(bags: list[set[bytes]]) -> tuple[list[set[bytes]], np.ndarray]:
    """Near copies (by their pieces) as one bag, and the group of each bag; a text that is there a hundred times counts once."""
    up = np.arange(len(bags))
    mins = np.zeros((BANDS * ROWS, len(bags)), np.uint64)
    for k, bag in enumerate(bags):
        h = np.array([zlib.crc32(w) for w in bag] or [k], np.uint64)
        for r in range(BANDS * ROWS):
            mins[r, k] = bytehash.mix(h * np.uint64(2 * r + 0x9E3779B97F4A7C15) + np.uint64(r)).min()

    def top(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return int(k)

    for b in range(0, BANDS * ROWS, ROWS):
        first: dict[bytes, int] = {}
        for k in range(len(bags)):
            j = first.setdefault(mins[b : b + ROWS, k].tobytes(), k)
            x, y = top(j), top(k)
            if x != y and COPY * len(bags[j] | bags[k]) <= len(bags[j] & bags[k]):
                up[max(x, y)] = min(x, y)
    tops, group = np.unique([top(k) for k in range(len(bags))], return_inverse=True)
    out: list[set[bytes]] = [set() for _ in tops]
    for k, bag in zip(group, bags):
        out[k] |= bag
    return out, group


def signs(toxic: list[set[bytes]], clean: list[set[bytes]]) -> dict[bytes, tuple[float, float]]:
    """Pieces that toxic texts have far more often than clean ones: the number of toxic texts with each, and the margin asked of it, by its log odds."""
    up, down = Counter(w for x in toxic for w in x), Counter(w for x in clean for w in x)
    p = len(toxic) / (len(toxic) + len(clean))
    odds = lambda w: np.log((up[w] + PRIOR * p) / (down[w] + PRIOR * (1 - p)) * (1 - p) / p)
    found = {w: odds(w) / SIGN for w in sorted(up) if up[w] > 1}
    return {w: (float(up[w]), float(1 + STEEP * (x - 1))) for w, x in found.items() if x >= 1}


def _spread(table_of, words: list[bytes], most: int) -> list[bytes]:
    """The first words, in this order, that aren't too similar to one taken before."""
    chosen: list[bytes] = []
    for i in range(0, len(words), most):
        some = words[i : i + most]
        if len(chosen) == most:
            break
        if chosen:
            some = [w for w, k in zip(some, table_of(some, chosen).max(1)) if k < SAME]
        if not some:
            continue
        near = table_of(some, some)
        kept: list[int] = []
        for k in range(len(some)):
            if len(chosen) + len(kept) < most and (not kept or near[k, kept].max() < SAME):
                kept.append(k)
        chosen += [some[k] for k in kept]
    return chosen


def _times(words: list[bytes], codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The product of each piece's normalised subsequences with one weight vector."""
    machine = Machine(codes, weights, 0.0)
    return np.concatenate([machine.margin(*_join(words[i : i + 20_000])) for i in range(0, len(words), 20_000)]) if words else np.zeros(0)


def _similar(a: list[bytes], b: list[bytes]) -> np.ndarray:
    table, rows = _dense(b)
    return np.concatenate([kernels(a[i : i + 1000], table, rows) for i in range(0, len(a), 1000)]) if a else np.zeros((0, len(b)))


def fit(texts: list[str | None], labels: list[int], share: float | None = None) -> Machine:
    """A machine from labelled texts. ``share``: the toxic part of all texts, if that of these is another."""
    nothing = Machine(np.zeros(0, np.int64), np.zeros(0), -1.0)
    one: dict[bytes, bytes] = {}  # each piece is held once
    toxic = [{one.setdefault(w, w) for w in _distinct(t)} for t, y in zip(texts, labels) if y]
    clean = [{one.setdefault(w, w) for w in _distinct(t)} for t, y in zip(texts, labels) if not y]
    del one
    toxic, group = grouped(toxic)
    clean, other = grouped(clean)
    known = signs(toxic, clean) if toxic and clean else {}
    if not known:
        return nothing
    down = Counter(w for x in clean for w in x)
    pool = sorted((w for w in down if w not in known), key=_order)
    ranked = sorted(known, key=lambda w: (-known[w][0], _order(w)))
    marks = _spread(_similar, ranked, LANDMARKS // 2)
    lead = set(marks)
    # the clean pieces most like the signs' mean, and some at large; each sign's nearest of them are landmarks as well
    table, rows = _dense(marks)
    codes = np.flatnonzero(table)
    near = _times(pool, codes, rows[table[codes]].sum(1))
    chosen = {pool[i] for i in np.argsort(-near, kind="stable")[:NEGATIVES]} | set(pool[: NEGATIVES // 4])
    like = sorted(chosen, key=_order)
    near = np.concatenate([kernels(like[i : i + 1000], table, rows) for i in range(0, len(like), 1000)]) if like else np.zeros((0, len(marks)))
    each = max(1, LANDMARKS // 4 // len(marks))
    close = {like[i] for k in range(len(marks)) for i in np.argsort(-near[:, k], kind="stable")[:each]}
    marks += sorted(close) + pool[: LANDMARKS // 8]
    table, rows = _dense(marks)
    # Nyström: K_zz^(-1/2)
    kz = kernels(marks, table, rows)
    values, vectors = np.linalg.eigh((kz + kz.T) / 2)
    root = vectors @ np.diag(np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0)) @ vectors.T
    codes = np.flatnonzero(table)
    share = sum(labels) / len(labels) if share is None else share
    scale = (1 - share) / share * len(toxic) / len(clean)  # of the clean texts, against the toxic ones
    positive = {w: known[w] for w in ranked[: NEGATIVES // 2]}
    for turn in range(ROUNDS):
        words, cost, target = [], [], []
        for w, (n, t) in positive.items():
            copies = [c for c in disguised(w) if c not in down] if w in lead else []
            words += [w, *copies]
            cost += [n, *[DISGUISED * n / max(1, len(copies))] * len(copies)]
            target += [t] * (1 + len(copies))
        negative = sorted(chosen - positive.keys(), key=_order)
        quoted = [w for w in positive if down[w]]  # clean texts have these too, which counts against them
        y = np.concatenate([np.ones(len(words)), -np.ones(len(quoted) + len(negative))])
        z = np.concatenate([kernels(part[i : i + 1000], table, rows) @ root for part in (words, quoted, negative) for i in range(0, len(part), 1000)])
        z = np.hstack([z, np.ones((len(z), 1))])
        against = np.array([down[w] * scale for w in quoted])
        rest = np.sqrt([down[w] for w in negative])
        cost = np.concatenate([np.array(cost) / sum(cost), against / sum(cost), rest / max(1, rest.sum())]) * len(z)
        w = _hinge(z, y, np.concatenate([target, np.ones(len(y) - len(words))]), COST * cost)
        machine = Machine(codes, rows[table[codes]] @ (root @ w[:-1]), float(w[-1]))
        if turn == ROUNDS - 1:
            break
        # clean pieces that come out on the wrong side, or nearly, train from now on
        margin = _times(pool, codes, machine.weights) + machine.bias
        order = np.argsort(-margin, kind="stable")[: NEGATIVES // 2]
        chosen |= {pool[i] for i in order if margin[i] > -0.5}
        # and of each toxic text without a sign among its pieces the worst piece, if it looks toxic
        for x in toxic:
            if not x & positive.keys():
                some = sorted(x - down.keys())
                if some:
                    m = machine.margin(*_join(some))
                    if m.max() > 0.25:
                        positive[some[int(m.argmax())]] = (1.0, 1.0)
    found = machine.evidence(pa.array(texts, pa.large_string()))
    # the signs alone, and disguised, count like toxic texts
    lone = [x for w in ranked[: LANDMARKS // 2] for x in (w, *disguised(w)[:3])]
    alone = np.maximum(0, machine.margin(*_join(lone)) - FLOOR)
    y = np.array(labels, float)
    weight = np.empty(len(y))  # of a group of copies together as much as of another text
    weight[y > 0] = share / len(toxic) / np.bincount(group)[group]
    weight[y == 0] = (1 - share) / len(clean) / np.bincount(other)[other]
    machine.slope, machine.middle = _curve(np.concatenate([found, alone]), np.concatenate([y, np.ones(len(lone))]), np.concatenate([weight, np.full(len(lone), LONE * share / len(lone))]))
    return machine


def _hinge(x: np.ndarray, y: np.ndarray, target: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The linear machine with squared hinge below each row's target margin, by Newton steps over the rows below it."""
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3  # the bias is nearly free

    def loss(w: np.ndarray) -> float:
        return 0.5 * float(ridge @ (w * w)) + float(cost @ np.maximum(0, target - y * (x @ w)) ** 2)

    now = loss(w)
    for _ in range(rounds):
        below = np.flatnonzero(y * (x @ w) < target)
        xa, c = x[below], cost[below]
        hess = 2 * (xa * c[:, None]).T @ xa + np.diag(ridge)
        to, step = np.linalg.solve(hess, 2 * (xa * c[:, None]).T @ (y * target)[below]), 1.0
        while loss(w + step * (to - w)) > now and step > 1e-4:
            step /= 2
        w, before = w + step * (to - w), now
        now = loss(w)
        if before - now <= 1e-6 * before:
            break
    return w


def _curve(evidence: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope, and the middle with the best F1 (of equal ones that in the widest gap)."""
    order = np.argsort(-evidence, kind="stable")
    v, up, down = evidence[order], (label * weight)[order], ((1 - label) * weight)[order]
    f = 2 * np.cumsum(up) / (np.cumsum(up + down) + up.sum())
    gap = v - np.append(v[1:], 0.0)
    f = np.where((gap > 0) & (v > 0), f, -1.0)
    best = np.flatnonzero(f >= f.max() - 1e-9)
    k = best[np.argmax(gap[best])]
    middle = float(v[k] - gap[k] / 2)
    return 4.0 / max(1e-3, middle), middle


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from a bounded sample of the labelled rows where ``train`` (on the id) holds."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter(F.col("_label").isNotNull() & F.col("_id").isNotNull())
    marked = marked.withColumnRenamed("_id", id_col).filter(train).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col("_label") > 0).cast("int")).alias("_y"))
    n = {r[0]: r[1] for r in marked.groupBy("_y").count().collect()}
    if not n.get(0) or not n.get(1):
        return fit([], [])
    rate = F.when(F.col("_y") == 1, F.lit(int(1e6 * min(1.0, MOST_TEXTS / n[1])))).otherwise(F.lit(int(1e6 * min(1.0, MOST_TEXTS / n[0]))))
    picked = marked.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < rate)
    # the sample's ids are few by the rates (the limit is far above what they let through), so texts aren't shuffled
    bound = 2 * MOST_TEXTS + MOST_TEXTS // 2
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked.limit(bound)), "_id").filter(F.col("_text").isNotNull())
    rows = found.select("_id", "_y", "_text").orderBy("_id", "_text").limit(bound).collect()
    return fit([r["_text"] for r in rows], [r["_y"] for r in rows], n[1] / (n[0] + n[1]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double").add("predicted", "integer")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in parts:
            s = m.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    machine = learn(docs, common.table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")
