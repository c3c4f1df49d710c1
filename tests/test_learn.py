"""Classifiers trained on the cluster against plain numpy."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import learn


def grams(text):
    """N-grams within words, as the usual vectoriser cuts them."""
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (2, 3, 4, 5):
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def test_char_grams(spark):
    texts = ["Ab  c\nxyz", "", None, "é", "  lots of\tWords ", "日本語 x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", learn.char_grams(F.col("t")).alias("g")).collect()
    for r in got:
        assert Counter(r["g"]) == Counter(grams(texts[r["i"]] or ""))


def test_lbfgs_side_by_side():
    """Quadratics of very different curvature, and one that starts at its minimum, each to its own end."""
    r = np.random.default_rng(2)
    size = np.array([5, 1, 30, 2])
    starts = np.cumsum(size) - size
    a = [np.diag(10.0 ** r.uniform(-1, 2, n)) for n in size]
    want = [r.normal(size=n) for n in size]
    want[3][:] = 0

    def evaluate(x):
        parts = [x[s : s + n] - w for s, n, w in zip(starts, size, want)]
        return np.array([p @ m @ p / 2 for p, m in zip(parts, a)]), np.concatenate([m @ p for p, m in zip(parts, a)])

    got = learn.lbfgs(evaluate, np.zeros(size.sum()), size, steps=300, tolerance=1e-7)
    assert np.allclose(got, np.concatenate(want), atol=1e-5)


def rows_of(r):
    """Three data sets: two classes, three classes, too little."""
    out, key = [], 0
    for group, classes, n in (("two", "ab", 60), ("three", "abc", 75), ("one", "a", 9), ("few", "ab", 3)):
        for i in range(n):
            c = classes[i % len(classes)]
            words = [r.choice({"a": ["alpha", "arm", "all"], "b": ["beta", "box"], "c": ["gamma", "Gate"]}[c] + ["the", "of", "noise", "alpha", "box"]) for _ in range(r.randint(1, 5))]
            out.append((key, group, c, " ".join(words)))
            key += 1
    return [*out, (key, "two", None, "x"), (key + 1, "two", "a", None), (key + 2, None, "a", "alpha"), (key + 3, "three", "b", "zzz"), (key + 4, "three", "b", "")]


def by_numpy(rows, group, least=2):
    mine = [x for x in rows if x[1] == group and x[2] is not None and x[3] is not None]
    strata = defaultdict(list)
    for key, _, c, _ in mine:
        strata[c].append(key)
    test = set()
    for keys in strata.values():
        keys.sort(key=lambda k: (hashlib.md5(f"0:{k}".encode()).hexdigest(), k))
        test |= set(keys[: math.floor(len(keys) * 0.2)])
    classes = sorted(strata)
    train = [x for x in mine if x[0] not in test]
    df = Counter(g for x in train for g in set(grams(x[3])))
    words = sorted(g for g, n in df.items() if n >= least)
    idf = {g: math.log((1 + len(train)) / (1 + df[g])) + 1 for g in words}
    place = {g: i for i, g in enumerate(words)}

    def matrix(part):
        m = np.zeros((len(part), len(words) + 1))
        for i, x in enumerate(part):
            for g, n in Counter(grams(x[3])).items():
                if g in place:
                    m[i, place[g]] = (1 + math.log(n)) * idf[g]
            size = np.linalg.norm(m[i])
            m[i] /= size if size else 1
        m[:, -1] = 1
        return m

    x, y = matrix(train), np.array([classes.index(t[2]) for t in train])
    k = len(classes)
    outputs = 1 if k == 2 else k
    w = np.zeros((outputs, x.shape[1]))
    reg = np.ones(x.shape[1])
    reg[-1] = 0

    def logits(w, x):
        z = x @ w.T
        return np.hstack([np.zeros((len(x), 1)), z]) if k == 2 else z

    step = 0.05
    velocity = np.zeros_like(w)
    for _ in range(6000):  # gradient descent with momentum
        z = logits(w, x)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = (p[:, 1:] if k == 2 else p).T @ x + reg * w
        velocity = 0.9 * velocity - step * 0.2 * g
        w = w + velocity
    held = [t for t in mine if t[0] in test]
    pred, gold = logits(w, matrix(held)).argmax(1), np.array([classes.index(t[2]) for t in held])
    f1 = [2 * ((gold == c) & (pred == c)).sum() / ((gold == c).sum() + (pred == c).sum()) for c in set(gold) | set(pred)]
    return len(train), len(held), len(words), round(float(np.mean(f1)), 4), w


@pytest.mark.parametrize("blocks", [False, True])
def test_headroom_equals_numpy(spark, blocks, monkeypatch):
    rows = rows_of(random.Random(6))
    if blocks:  # several blocks of parameters, a deep tree, a round for each model
        for name, value in (("BLOCK", 64), ("FAN", 2), ("MOST_PARAMETERS", 100)):
            monkeypatch.setattr(learn, name, value)
    df = spark.createDataFrame(rows, "doc_id long, source string, label string, text string").repartition(3)
    got = {r["source"]: tuple(r)[1:] for r in learn.headroom(df, "source", "doc_id").collect()}
    for group in ("two", "three"):
        assert got[group] == by_numpy(rows, group)[:4]
    assert got["one"] == (8, 1, None, None) and got["few"][2:] == (None, None) and got[None][2:] == (None, None)


def test_parameters_equal_numpy(spark):
    """The fitted parameters themselves, of two and of three classes at once."""
    r = np.random.default_rng(5)
    data, layout = [], learn.Layout.of([4, 3], [2, 3])
    for i in range(80):
        model = i % 2
        f = sorted(r.choice(layout.features[model], 2, replace=False).tolist())
        data.append((model, int(r.integers(0, 2 + model)), f, r.normal(size=2).tolist()))
    w = learn.fit(spark.createDataFrame(data, "model int, y int, idx array<int>, val array<double>").repartition(3), layout)
    assert len(w) == 5 + 3 * 4
    for model, (start, k) in enumerate(((0, 1), (5, 3))):
        mine = [d for d in data if d[0] == model]
        n = int(layout.features[model])
        x = np.zeros((len(mine), n + 1))
        for i, d in enumerate(mine):
            x[i, d[2]] = d[3]
        x[:, n] = 1
        v = w[start : start + k * (n + 1)].reshape(k, n + 1)
        z = x @ v.T
        z = np.hstack([np.zeros((len(x), 1)), z]) if k == 1 else z
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        p[np.arange(len(mine)), [d[1] for d in mine]] -= 1
        reg = v.copy()
        reg[:, n] = 0
        assert np.abs((p[:, 1:] if k == 1 else p).T @ x + reg).max() < 1e-3  # at the minimum the whole gradient is nil


def test_headroom_caps_features(spark):
    """Of too many n-grams the most frequent stay, and those that tie at the end go together."""
    rows = [(i, "g", True, t) for i, t in enumerate(["aa bb", "aa bb cc", "aa cc", "aa"])]
    counts = learn.gram_counts(spark.createDataFrame(rows, "row long, group string, train boolean, text string"))
    sizes = spark.createDataFrame([("g", 4)], "group string, n long")
    assert learn.vocabulary(counts, sizes, most=8).count() == 6  # those of aa; bb and cc tie
    got = {r["gram"]: (r["idx"], r["idf"]) for r in learn.vocabulary(counts, sizes).collect()}
    assert sorted(got) == sorted(set(grams("aa bb cc"))) and sorted(i for i, _ in got.values()) == list(range(18))
    assert got["aa"][1] == pytest.approx(1.0) and got["bb"][1] == pytest.approx(math.log(5 / 3) + 1)


def test_headroom_of_nothing(spark):
    assert learn.headroom(spark.createDataFrame([], "doc_id long, source string, label string, text string"), "source", "doc_id").count() == 0
