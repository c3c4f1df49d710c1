"""Exact whole-text encoding with a byte-level BPE file of the ``tokenizers`` library.

The library encodes about 1.3 MB/s of text on one core, nearly all of it merges of words met before.
A byte-level BPE never merges across its pre-tokens, and some places in a text
always start a pre-token (see ``_cuts``). So texts are cut there, each distinct piece is
encoded by the library once, and the ids of a text are gathered from a table by the pieces' hashes.
Texts with the special token's string go to the library whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tarnwork.llm import bytehash

#: Places of the table of known pieces (22 bytes each), and ids that it keeps (4 bytes each). A piece takes the
#: place of another with the same place; when the ids are full the table starts anew. So memory is bounded.
PLACES, KEPT_IDS = 1 << 19, 1 << 21
#: Bytes of text that are encoded in one go; the arrays made on the way are some dozens of bytes for each.
BATCH_BYTES = 1 << 19
#: White space outside ASCII, as UTF-8 (fixed values).
WIDE_SPACES = "\u0085                 　"
_WIDE = {n: np.array([int.from_bytes(c.encode(), "big") for c in WIDE_SPACES if len(c.encode()) == n]) for n in (2, 3)}


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where pre-tokens surely start: at and after lone white space, and at marks after letters.

    A space or line end counts if its neighbours are both there and not white space; the space opens
    the next pre-token, the line end is one. A comma or full stop counts after an ASCII letter.
    """
    narrow = np.zeros(256, bool)
    narrow[[*range(9, 14), *range(28, 33)]] = True
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123)]] = True
    mark = np.flatnonzero((data == 44) | (data == 46))
    mark = mark[mark > 0]
    mark = mark[letter[data[mark - 1]]]
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~(narrow[data[at - 1]] | narrow[data[at + 1]])]
    ok = np.ones(len(at), bool)
    padded = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(4, np.uint8)]).astype(np.int64)
    for off, lead in ((1, True), (-1, False)):
        k = np.flatnonzero(data[at + off] >= 0x80)
        for n, codes in _WIDE.items():
            first = at[k] + 4 + (1 if lead else -n)
            code = sum(padded[first + i] << (8 * (n - 1 - i)) for i in range(n))
            ok[k[np.isin(code, codes)]] = False
    at = at[ok]
    return np.concatenate([at, at[data[at] == 10] + 1, mark])


class Encoder:
    """Equal to ``tokenizer.encode(text, add_special_tokens=False)`` for each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.opens = np.zeros(self.size, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.check = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint64)  # two hashes of the piece in each place
        self.begin, self.count = np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int32)  # its ids; 0 of them if there is no piece
        self.ids, self.used = np.zeros(KEPT_IDS, np.uint32), 0

    def _one(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _fresh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and their numbers. Those that open with their only space go to the library many in a call: a token opening with a space starts the next piece."""
        raw = data.tobytes()
        spaces = np.concatenate([[0], np.cumsum(data == 32)])
        joined = (data[starts] == 32) & (spaces[ends] - spaces[starts] == 1)
        k = np.flatnonzero(joined)
        if len(k):
            pieces = [raw[a:b] for a, b in zip(starts[k].tolist(), ends[k].tolist())]
            some, _ = self._many([b"".join(pieces[j : j + 500]).decode() for j in range(0, len(pieces), 500)])
            at = np.flatnonzero(self.opens[some])
            if len(at) != len(k):  # not with a byte-level file; all alone is exact for any
                joined[:], k = False, k[:0]
        if not len(k):
            some, at = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        rest = np.flatnonzero(~joined)
        more, n = self._many([raw[a:b].decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist())])
        counts, begin = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        counts[k], begin[k] = np.diff(np.append(at, len(some))), at
        counts[rest], begin[rest] = n, len(some) + np.cumsum(n) - n
        return np.concatenate([some, more])[bytehash.ragged(begin, counts)], counts

    def _look_up(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct pieces begin in ``self.ids``, and how many they are; new pieces are encoded first."""
        place = (keys & np.uint64(PLACES - 1)).astype(np.int64)
        known = (self.count[place] > 0) & (self.keys[place] == keys) & (self.check[place] == check)
        begin, count = self.begin[place], self.count[place].astype(np.int64)
        new = np.flatnonzero(~known)
        if not len(new):
            return begin, count
        ids, n = self._fresh(text, starts[new], ends[new])
        if self.used + len(ids) > len(self.ids) and self.used:
            self._clear()
            return self._look_up(text, starts, ends, keys, check)
        if len(ids) > len(self.ids):
            self.ids = np.zeros(len(ids), np.uint32)  # until the table starts anew
        self.ids[self.used : self.used + len(ids)] = ids
        begin[new], count[new] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)
        at, first = np.unique(place[new], return_index=True)  # of several pieces for one place the first
        k = new[first]
        self.keys[at], self.check[at], self.begin[at], self.count[at] = keys[k], check[k], begin[k], count[k]
        return begin, count

    def _many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64)

    def _some(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[_cuts(data)] = True
        cut[offsets] = True
        cut[len(data)] = False
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        keys, first, inverse = np.unique(bytehash.slices(data, starts, ends), return_index=True, return_inverse=True)
        a, b = starts[first], ends[first]
        text = data[bytehash.ragged(a, b - a)]  # the distinct pieces once more, for a second hash
        stop = np.cumsum(b - a)
        check = bytehash.slices(text, stop - (b - a), stop, bytehash.BASE_B)
        begin, count = self._look_up(text, stop - (b - a), stop, keys, check)
        n = count[inverse]
        flat = self.ids[bytehash.ragged(begin[inverse], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        edges = total[np.searchsorted(starts, offsets, "left")]
        return flat, np.diff(edges)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long row, window by window; windows end at cuts."""
        out, at, size = [], 0, BATCH_BYTES
        while at < len(data):
            part = data[at : at + size]
            if at + size < len(data):
                cut = _cuts(part)
                cut = cut[(cut > 0) & (cut <= size - 8)]  # what is behind a later one may matter
                if not len(cut):
                    size *= 2
                    continue
                part = part[: cut.max()]
            out.append(self._some(part, np.array([0, len(part)]))[0])
            at, size = at + len(part), BATCH_BYTES
        return np.concatenate(out)

    def encode(self, texts: pa.Array):
        """Yields (first row, ids of some rows one after the other, ids in each of those rows)."""
        data, offsets = bytehash.buffers(texts)
        for i, j in bytehash.split_rows(offsets, BATCH_BYTES):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            odd = np.zeros(j - i, bool)
            raw = part.tobytes()
            for s in self.special:
                k = raw.find(s)
                while k >= 0:
                    odd[np.searchsorted(at, k, "right") - 1] = True
                    k = raw.find(s, k + 1)
            edges = [0, *(np.flatnonzero(np.diff(odd.view(np.int8))) + 1).tolist(), j - i]
            for x, y in zip(edges[:-1], edges[1:]):
                if odd[x]:
                    for k in range(x, y):
                        ids = np.array(self._one(raw[at[k] : at[k + 1]].decode()), np.uint32)
                        yield i + k, ids, np.array([len(ids)], np.int64)
                elif len(part) > 2 * BATCH_BYTES:
                    ids = self._long(part)
                    yield i, ids, np.array([len(ids)], np.int64)
                else:
                    yield i + x, *self._some(part[at[x] : at[y]], at[x : y + 1] - at[x])

    def each(self, texts: pa.Array):
        """The ids of each text in turn."""
        for _, flat, counts in self.encode(texts):
            yield from np.split(flat, np.cumsum(counts)[:-1])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def default_path() -> str:
    """Where the public vocabulary lies; the driver and each executor ask for their own."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
