"""Personal data, the filter audit and lexical search against brute force, with odd rows in every table."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import op11_pii, op12_filter_audit, op13_lexical_search
from tarnwork.llm import registry

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n int, term string, part string, block string"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names the operators use."""
    return spark.createDataFrame([(i, t, "en", s, 1, 2, "x", "p", "b") for i, t, s in rows], DOC)


# --- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_brute(text):
    """The contract's patterns as they stand."""
    def good(kind, m):
        digits = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if good(k, m.group())] for k, p in BASE.items()}


def soup(r, alphabet, n):
    return "".join(r.choice(alphabet) for _ in range(r.randrange(n)))


def test_base_is_the_patterns():
    r = random.Random(3)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-0000", "+", " ", "-", "x", "é", "\n", "0", "12", "\U0001f600", "a.b@c-d.e.f", "001.002.3.4", "--"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert {k: list(f(text)) for k, f in op11_pii.FINDERS.items()} == base_brute(text), text
    for alphabet in ("a@.", "0123456789. ", "+1 ().-", "0159 -"):
        for _ in range(1500):
            text = soup(r, alphabet, 40)
            assert {k: list(f(text)) for k, f in op11_pii.FINDERS.items()} == base_brute(text), text


HIDDEN = {
    "email": [
        "bo.42 at mail8 dot example dot com", "bo.42 [at] mail8 [dot] example [dot] com", "bo(at)example.com", "bo.42 at mail8.example.com", "jоhn@exаmple.com", "bo＠example．com", "bo dot 42 at mail8 dot example dot com", "BO AT HOST DOT ORG",
        "bo_at_host_dot_org", "bo @ host . org", "bo&#64;host&#46;org", "bo arroba host punto es", "bo{ät}host{punkt}de", "bo​@host.org", "bo @host.org",
    ],
    "ip": ["42 dot 144 dot 35 dot 254", "42[.]144[.]35[.]254", "four two dot one four four dot three five dot two five four", "٤٢.١٤٤.٣٥.٢٥٤", "42．144．35．254"],
    "card": ["４１１１ １１１１ １１１１ １１１１", " ".join(["four"] + ["one"] * 15), "4lll 1111 1111 111I", "4111​1111​1111​1111", "4111–1111–1111–1111"],
    "phone": ["plus one nine eight eight five five five two four eight five", "+1 (988) five five five-2485", "+1 988 555 O185", "＋1 988 555 0185", "+1 neuf huit huit cinq cinq cinq zéro un huit cinq"],
}


@pytest.mark.parametrize("kind", op11_pii.KINDS)
def test_disguises_map_back(kind):
    for hidden in HIDDEN[kind]:
        for before, after in (("", ""), ("Écrivez: ", " the end."), ("one of them\n", "\nfür alle")):
            text = before + hidden + after
            base, more = op11_pii.find(text)
            assert base == base_brute(text)
            assert [text[a:b] for a, b in more[kind]] == [hidden], (text, more)
            assert not any(v for k, v in more.items() if k != kind), (text, more)


def test_clean_texts_have_none():
    for text in [
        "meet at noon, look at example.com", "the dot on the i; a point of view", "one of the two or three at four", "3963522770391943 | un ami", "4111 1111 1111 1112 one", "user@host.org dot matrix",
        "at the dot at", "Le point. Un deux trois quatre", "version 1 dot 2", "naïve café – прекрасно", "[a] [at] [.]", "plus one", "12345678 Senf", "price 1000000 S",
    ]:
        base, more = op11_pii.find(text)
        assert base == base_brute(text) and not any(more.values()), (text, more)


def test_rewrites_compose():
    t = op11_pii.rewrite(op11_pii.Mapped("a bb ccc"), [(2, 4, "X"), (5, 8, "YZ")])
    assert t.text == "a X YZ" and t.source((2, 3)) == (2, 4) and t.source((4, 6)) == (5, 8) and t.touched((2, 3)) and not t.touched((0, 2))
    again = op11_pii.rewrite(t, [(1, 2, ""), (4, 5, "Q")])
    assert again.text == "aX QZ" and again.source((1, 4)) == (2, 8) and again.touched((0, 2))


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1" * 200_000 + "a", "x" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "one " * 50_000, "O1" * 100_000, "a@" * 50_000, "[" * 100_000, "- " * 100_000):
        op11_pii.find(text)


def test_detect(spark):
    rows = [(1, "a@b.c 1.2.3.4 at +1 988 555 0185", "s"), (1, "a@b.c 1.2.3.4 at +1 988 555 0185", "s"), (None, "é bo at x dot org", None), (3, None, "s"), (4, "", "s"), (5, "w " * 50_000 + "é a@b.c", "s")]
    out = op11_pii.detect(docs(spark, rows))
    assert [c for c, _ in out.dtypes][:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got = Counter(tuple(r)[:7] for r in out.collect())
    want = Counter()
    for i, t, _ in rows:
        base = base_brute(t or "")
        joined = ",".join(f"{k}:{a}:{b}" for a, j, b, k in sorted((a, j, b, k) for j, k in enumerate(op11_pii.KINDS) for a, b in base[k]))
        every = {"é bo at x dot org": "email:2:17"}.get(t, joined)
        want[(i, *(len(base[k]) for k in op11_pii.KINDS), hashlib.sha256(joined.encode()).hexdigest(), every)] += 1
    assert got == want
    assert op11_pii.detect(docs(spark, [])).count() == 0


# --- filter audit


def audit_brute(rows, labels):
    """rows (doc_id, text, source): each document through each order of the filters."""
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails.append({
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        })
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, removed_by = {}, Counter()
    for part in {s or "" for *_, s in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order):
                c = Counter()
                for (i, _, s), x in zip(rows, fails):
                    if (s or "") == part:
                        gone = any(x[g] for g in order[:step])
                        c["kept"] += not gone and not x[f]
                        c["removed"] += x[f] and not gone
                        c["redundant"] += x[f] and gone
                        c["unique_fails"] += x[f] and sum(x.values()) == 1
                        c["good_lost"] += x[f] and not gone and i in good
                        c["toxic_lost"] += x[f] and not gone and i in toxic
                out[part, order, step + 1] = c
                removed_by[part, f] += c["removed"]
    return {(*k, *(c[n] for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), removed_by[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_audit(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, k=250)), " ".join(words), " ".join(words) + "#", "WORD " * 210, "AB " + " ".join(words), "few words", "few words\x0b", "é" * 30 + "A", "", None, " ".join(words[:7]) * 40 + " $ X" * 30]
    rows = [(i, r.choice(texts), r.choice(["s", "t", "", None])) for i in range(60)] + [(None, texts[1], "s"), (None, texts[5], None), (70, texts[0], "t"), (70, texts[0], "t"), (70, texts[0], "s"), (71, texts[0], "u")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 60, 2)] + [(70, 1, 0), (70, 0, 1), (None, 1, 1), (999, 1, 1)]
    given = docs(spark, rows).withColumn("part", F.coalesce("source", F.lit("")))
    out = op12_filter_audit.audit(given, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == audit_brute(rows, labels)
    empty = op12_filter_audit.audit(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert empty.count() == 0
    bare = op12_filter_audit.audit(given, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {tuple(x) for x in bare.collect()} == audit_brute(rows, [])


def test_audit_matrices():
    m = op12_filter_audit.matrices()
    assert all(m[k].shape == (32, 600) for k in ("kept", "removed", "redundant", "unique"))
    fails = m["removed"] + m["redundant"]
    assert (fails.reshape(32, 120, 5).sum(axis=2) == np.array([[i.bit_count()] for i in range(32)])).all()
    assert (m["filter"].sum(axis=1) == 120 * (np.arange(32) > 0)).all()


# --- lexical search

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def search_brute(rows, items, k=10):
    held = [(i, Counter(x)) for i, t in rows if (x := terms(t))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(x for _, c in held for x in c)
    out = []
    for item in {i for i, _ in items}:
        wanted = {x for i, t in items if i == item for x in terms(t)}
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in wanted if x in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if gone else i, -s) for r, (s, gone, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_search(spark, tmp_path, seed, monkeypatch):
    r = random.Random(seed)
    if seed == 2:  # several blocks, windows and batches even for little text
        for name, value in (("BLOCK_DOCS", 64), ("BLOCK_POSTINGS", 500), ("WINDOW_BYTES", 100), ("QUERIES", 3), ("BATCH_TERMS", 20)):
            monkeypatch.setattr(op13_lexical_search, name, value)
    vocabulary = [*"abcdefghijklmnop", "Été", "été", "naïve", "x1", "日本", "THE", "the", "a" * 300]
    join = lambda: "".join(r.choice(vocabulary) + r.choice([" ", " ", ", ", "\n", "_", "\x00", "."]) for _ in range(r.choice([0, 3, 20, 90])))
    rows = [(r.randrange(400), join(), "s") for _ in range(250)]
    rows += [(None, "the été x1", "s"), (None, "the", "s"), (7, None, "s"), (8, "", "s"), (9, "?!", "s"), (500, "zz " * 3000, "s"), (501, "rare été", "s"), (501, "rare été", "s"), (502, "rare été", "s")]
    items = [(i, join()) for i in range(12)] + [(20, None), (21, ""), (22, "unknown words"), (23, "rare"), (23, "ZZ"), (None, "The THE été"), (24, " ".join(vocabulary))]
    index = op13_lexical_search.build(docs(spark, rows).repartition(3), f"file://{tmp_path}/index")
    given = spark.createDataFrame([(i, t, 5, "y") for i, t in items], "item_id long, text string, rank int, term string")
    got = sorted((tuple(x) for x in op13_lexical_search.search(index, given, 10).collect()), key=repr)
    assert got == sorted(search_brute([x[:2] for x in rows], items), key=repr)
    few = sorted((tuple(x) for x in op13_lexical_search.search(index, given, 1).collect()), key=repr)
    assert few == sorted(search_brute([x[:2] for x in rows], items, 1), key=repr)


def test_search_of_nothing(spark, tmp_path):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for k, rows in enumerate(([], [(1, None, "s"), (2, "", "s")])):
        index = op13_lexical_search.build(docs(spark, rows), f"file://{tmp_path}/{k}")
        assert op13_lexical_search.search(index, items).count() == 0
    index = op13_lexical_search.build(docs(spark, [(1, "a", "s")]), f"file://{tmp_path}/one")
    assert op13_lexical_search.search(index, items.limit(0)).count() == 0
    assert [tuple(x) for x in op13_lexical_search.search(index, items).collect()] == search_brute([(1, "a")], [(1, "a b")])


def test_slices_add_as_numbers():
    r = np.random.default_rng(4)
    held = [np.flatnonzero(r.random(300) < p) for p in (0.9, 0.5, 0.02, 0.3)]
    impacts = [r.integers(0, 1 << b, len(d)) for d, b in zip(held, (35, 3, 20, 34))]
    impacts[0][0] = (1 << 35) - 1
    slices = op13_lexical_search._Slices(held, impacts)
    queries = [np.array(q) for q in ([0, 1, 2, 3], [2], [3, 0], [1, 1, 1])]
    sums = op13_lexical_search._sums(slices, queries, 5)
    query, doc, score = op13_lexical_search._best(sums, 7)
    for i, q in enumerate(queries):
        whole = np.zeros(300, np.int64)
        for t in q:
            np.add.at(whole, held[t], impacts[t])
        best = sorted((-s, d) for d, s in enumerate(whole.tolist()) if s)[:7]
        assert sorted((-s, d) for d, s in zip(doc[query == i].tolist(), score[query == i].tolist())) == best


@pytest.mark.parametrize("name", ["op11_pii", "op12_filter_audit", "op13_lexical_search"])
def test_query(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
