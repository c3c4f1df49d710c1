"""Personal data in texts, also in disguise, with offsets into the original.

Four kinds of identifiers are found by fixed patterns in the text as it stands (the base). Then transducers rewrite the text and the same
patterns are tried again. A transducer reads the text once and replaces what its rule matches; each character that it writes knows the
characters of the source that it stands for, so transducers follow one another and every span found at the end is mapped back to the source.

1. ``plain``: characters that look like ASCII ones (full-width and mathematical forms, digits of other scripts, Cyrillic and Greek letters,
   full stops, dashes and spaces of other kinds) become these; characters without width go.
2. ``digits``: runs of spelled digits (English, German, French, Spanish) of two words or beside a digit become digits, but not beside a group of more than
   GROUP digits, nor a word that is also an article at a number's edge; "plus" before a digit becomes the sign; O, l, I, S and B that touch a digit within a number become digits.
3. ``marks``: "at" and "dot" and what stands for them in the four languages, in brackets, as entities, or as words or spaced marks where an address or number goes on.

A span counts if a transducer wrote part of it, and
- after ``plain``: unless it lies within a base span of its kind (one that it extends stays beside it);
- after all three: only if it overlaps no span of its kind that was found before, and if an address ends with a label of letters.
  Where "at" is a word and all full stops are real ones, as in "look at example.com", the part before it must look like an account (a digit or mark within).

Null texts are empty; they and texts without identifiers have no spans. Rows are judged one by one: repeated rows alike, rows without an id too, an empty
table gives an empty one. Other columns are ignored, whatever their names. Texts of any length are read whole, and each pattern in time that grows with their length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import common

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int]

#: The base patterns, fixed by the contract, in forms that never read a run of characters twice.
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ACCOUNT_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """A match reaches back from its @ as far as an account can, but not into the match before."""
    last = 0
    for m in _HOST.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in _ACCOUNT_CHARS:
            at -= 1
        if at < m.start():
            yield at, m.end()
            last = m.end()


def ips(text: str) -> Iterator[Span]:
    """Each four parts of a run of dotted numbers, from its start on."""
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = at + sum(map(len, parts[i : i + 4])) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts[i : i + 4]):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}


class Mapped(NamedTuple):
    """A rewritten text; character i stands for the source's characters from begin[i] to before end[i]; written[i]: a transducer wrote it. No arrays: as the source."""

    text: str
    begin: np.ndarray | None = None
    end: np.ndarray | None = None
    written: np.ndarray | None = None

    def source(self, span: Span) -> Span:
        return span if self.begin is None else (int(self.begin[span[0]]), int(self.end[span[1] - 1]))

    def touched(self, span: Span) -> bool:
        """Whether characters within the span were written, or left out."""
        if self.begin is None:
            return False
        a, b = span
        return bool(self.written[a:b].any()) or bool((self.begin[a + 1 : b] != self.end[a : b - 1]).any())


#: (start, end, what is written for it), in order and apart
Edit = tuple[int, int, str]


def rewrite(t: Mapped, edits: list[Edit]) -> Mapped:
    """The text with the edits made; a written character stands for all that its edit replaces."""
    if not edits:
        return t
    n = len(t.text)
    begin, end, written = (np.arange(n), np.arange(1, n + 1), np.zeros(n, bool)) if t.begin is None else t[1:]
    parts, froms, tos, marks, at = [], [], [], [], 0
    for a, b, new in edits:
        parts += [t.text[at:a], new]
        froms += [begin[at:a], np.full(len(new), begin[a])]
        tos += [end[at:a], np.full(len(new), end[b - 1])]
        marks += [written[at:a], np.ones(len(new), bool)]
        at = b
    parts.append(t.text[at:])
    return Mapped("".join(parts), np.concatenate([*froms, begin[at:]]), np.concatenate([*tos, end[at:]]), np.concatenate([*marks, written[at:]]))


#: Letters of other scripts that look like ASCII ones, and marks that look like ASCII marks. Fixed values.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινϲ",
    "ABESIJKMHOPCTYXaesijopcyxhdqwgABEZHIKMNOPTYXaoivc",
)) | {"。": ".", "․": ".", "‧": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹘": "-"}
#: Characters without width that may stand within an identifier (the soft hyphen among them). Fixed values.
WIDTHLESS = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"


@lru_cache(maxsize=1 << 16)
def plain_char(c: str) -> str:
    """What a character looks like in ASCII: itself if it doesn't, nothing if it has no width."""
    if c < "\x80":
        return c
    if c in WIDTHLESS:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    digit = unicodedata.digit(c, None)
    if digit is not None and unicodedata.category(c) == "Nd":
        return str(digit)
    if unicodedata.category(c) == "Zs":
        return " "
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 and form < "\x80" else c


def plain(t: Mapped) -> Mapped:
    if t.text.isascii():
        return t
    odd = [c for c in set(t.text) if plain_char(c) != c]
    if not odd:
        return t
    found = re.finditer(f"[{re.escape(''.join(odd))}]", t.text)
    return rewrite(t, [(m.start(), m.end(), plain_char(m.group())) for m in found])


#: Spelled digits of four languages. Fixed values.
SPELLED = {
    "0": "zero oh null zéro cero", "1": "one eins un une uno una", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf fuenf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
DIGIT_OF = {w: d for d, words in SPELLED.items() for w in words.split()}


def any_of(words: list[str]) -> str:
    """A pattern of the words, alternatives sharing their beginnings, which is read about ten times as fast as a list of them."""
    follow: dict[str, list[str]] = {}
    for w in words:
        if w:
            follow.setdefault(w[0], []).append(w[1:])
    if not follow:
        return ""
    parts = [re.escape(c) + any_of(rest) for c, rest in sorted(follow.items())]
    return f"(?:{'|'.join(parts)})" + "?" * ("" in words)


def lower(text: str) -> str:
    """Lower case, character by character."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(low if len(low := c.lower()) == 1 else c for c in text)


_WORD = any_of(list(DIGIT_OF))
_SPELLED = re.compile(rf"\b{_WORD}\b(?:[\x20,-]{{1,2}}{_WORD}\b)*")
_WORDS = re.compile(r"[^\W\d_]+")
#: A word for the plus sign before digits.
_PLUS = re.compile(r"\b(?:plus|m[aá]s)[\x20-](?=[0-9])")
#: Numbers with letters that look like digits among them: seven digits at least, and no fewer than letters; each letter in a group with a digit.
_MIXED = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9OolISB]){6,}")
_GROUPS = re.compile(r"[0-9OolISB]+")
_SHAPES = dict(zip("OolISB", "001158"))
#: Words that are articles too, and the digits of a group beside spelled ones at most.
ARTICLES, GROUP = frozenset("one un une uno una".split()), 4
#: What stands between the parts of a number.
_NEAR = re.compile(r"([0-9]+)[\x20().-]?\Z")
_NEXT = re.compile(r"[\x20().-]?([0-9]+)")


def spelled(text: str) -> list[Edit]:
    edits: list[Edit] = []
    for m in _SPELLED.finditer(lower(text)):
        words = [(w.start() + m.start(), w.end() + m.start(), DIGIT_OF[w.group()], w.group()) for w in _WORDS.finditer(m.group())]
        near = _NEAR.search(text, max(0, m.start() - GROUP - 2), m.start()), _NEXT.match(text, m.end(), m.end() + GROUP + 2)
        beside = [x for x in near if x]
        if any(len(x.group(1)) > GROUP for x in beside) or not beside and len(words) == 1 or len(beside) == 1 and len(words) == 1 and words[0][3] in ARTICLES:
            continue
        # the words stand close together: what is between them goes
        edits += [(a, words[i + 1][0] if i + 1 < len(words) else b, d) for i, (a, b, d, _) in enumerate(words)]
    return edits


def lookalikes(text: str) -> list[Edit]:
    edits: list[Edit] = []
    word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    for m in _MIXED.finditer(text):
        start, end = m.span()
        while start and text[start - 1] in _SHAPES:
            start -= 1
        groups = [g.span() for g in _GROUPS.finditer(text, start, end)]
        if word(end):  # the last group goes on as a word
            end = groups.pop()[0]
        real = sum(text[i].isdigit() for i in range(start, end))
        odd = [i for a, b in groups if not text[a:b].isalpha() for i in range(a, b) if text[i] in _SHAPES]
        if odd and real >= max(7, len(odd)) and not word(start - 1):
            edits += [(i, i + 1, _SHAPES[text[i]]) for i in odd]
    return edits


def digits(t: Mapped) -> Mapped:
    t = rewrite(t, spelled(t.text))
    t = rewrite(t, [(*m.span(), "+") for m in _PLUS.finditer(lower(t.text))])
    return rewrite(t, lookalikes(t.text))


#: Words for @ and the full stop in four languages. Fixed values.
AT_WORDS, DOT_WORDS = "at ät arroba arobase arobas klammeraffe", "dot punkt punto point period"
_AT, _DOT = any_of(AT_WORDS.split()), any_of(DOT_WORDS.split())
_OPEN, _CLOSE = r"[\[({<]\s{0,2}", r"\s{0,2}[\])}>]"
#: Sure marks: in brackets, or as entities. A letter a in brackets is one too.
_SURE = {"@": (rf"{_OPEN}(?:{_AT}|@|a){_CLOSE}", r"&(?:#0*64|#x0*40|commat);"), ".": (rf"{_OPEN}(?:{_DOT}|\.){_CLOSE}", r"&(?:#0*46|#x0*2e|period);")}
_SURE = {mark: [re.compile(p) for p in each] for mark, each in _SURE.items()}
#: Marks as words between spaces, dashes or underscores, and spaced marks.
_WEAK_DOTS = [re.compile(rf"[\x20_-]{{1,2}}{_DOT}[\x20_-]{{1,2}}(?=\w)"), re.compile(r"\x20{1,2}\.\x20{1,2}(?=\w)")]
_GOES_ON = r"(?=[a-z0-9-]+\.[a-z0-9-])"
_WEAK_ATS = [re.compile(rf"[\x20_-]{{1,2}}{_AT}[\x20_-]{{1,2}}{_GOES_ON}"), re.compile(rf"\x20{{1,2}}@\x20{{0,2}}{_GOES_ON}"), re.compile(rf"@\x20{{1,2}}{_GOES_ON}")]
_ACCOUNTS = re.compile(r"[0-9]|\w[._%+-]\w")
_LETTERS = re.compile(r"\.[A-Za-z]{2,}\Z")
#: Characters of a host that are looked at behind a weak mark.
_HOST_SIZE = 256


def matches(patterns: list[re.Pattern], text: str) -> list[Span]:
    """Spans of all patterns in the lower-cased text, in order; of those that overlap the first."""
    out: list[Span] = []
    low = lower(text)
    for a, b in sorted(m.span() for p in patterns for m in p.finditer(low)):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def wide(text: str, span: Span, last: int) -> Span:
    """A span with two characters of white space at each side at most, none before ``last``."""
    a, b = span
    while a > max(last, span[0] - 2) and text[a - 1].isspace():
        a -= 1
    while b < min(len(text), span[1] + 2) and text[b].isspace():
        b += 1
    return a, b


def marks(t: Mapped) -> Mapped:
    for mark, patterns in _SURE.items():
        edits: list[Edit] = []
        for span in matches(patterns, t.text):
            edits.append((*wide(t.text, span, edits[-1][1] if edits else 0), mark))
        t = rewrite(t, edits)
    word = lambda i: i >= 0 and (t.text[i].isalnum() or t.text[i] == "_")
    t = rewrite(t, [(a, b, ".") for a, b in matches(_WEAK_DOTS, t.text) if word(a - 1)])
    edits = []
    for a, b in matches(_WEAK_ATS, t.text):
        host = _HOST.match("@" + t.text[b : b + _HOST_SIZE])
        if host is None or not word(a - 1):
            continue
        start = a
        while start and t.text[start - 1] in _ACCOUNT_CHARS:
            start -= 1
        if t.touched((b, b + host.end() - 1)) or "@" in t.text[a:b] or _ACCOUNTS.search(t.text, start, a):
            edits.append((a, b, "@"))
    return rewrite(t, edits)


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The base spans, and those that the transducers add, by kind."""
    base = {k: list(f(text)) for k, f in FINDERS.items()}
    more: dict[str, list[Span]] = {k: [] for k in KINDS}
    source = Mapped(text)
    seen = plain(source)
    if seen.begin is not None:
        for kind, finder in FINDERS.items():
            for span in finder(seen.text):
                a, b = seen.source(span)
                if seen.touched(span) and not any(x <= a and b <= y for x, y in base[kind]):
                    more[kind].append((a, b))
    last = marks(digits(seen))
    if last is not seen:
        for kind, finder in FINDERS.items():
            known = sorted(base[kind] + more[kind])
            for span in finder(last.text):
                a, b = last.source(span)
                clear = not any(x < b and a < y for x, y in known)
                if clear and last.touched(span) and (kind != "email" or _LETTERS.search(last.text, *span)):
                    more[kind].append((a, b))
    return base, more


def listed(spans: dict[str, list[Span]]) -> str:
    """kind:start:end of all, by start, then by kind as listed, then by end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, KINDS.index(kind), b) for kind, each in spans.items() for a, b in set(each)))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts and digest of the base spans, all spans, and how many of them are added."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, more = find(text.as_py() or "")
                every = {k: base[k] + more[k] for k in KINDS}
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), sum(map(len, more.values()))))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(common.table(spark, sf_dir, "documents"))
