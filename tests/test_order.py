"""Order statistics, ranks and nearest vectors by cells against plain sorting and one matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import order, vectors


@pytest.mark.parametrize("few", [1, 10, 100_000])
def test_at_ranks(spark, monkeypatch, few):
    """Ties, far outliers, neighbouring doubles, one value, nulls; with narrow rounds too."""
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "BUCKETS", 4 if few == 1 else 16)
    r = np.random.default_rng(1)
    groups = {
        "ties": [1.0] * 40 + [2.0] * 3, "far": [*r.normal(size=50), 1e300, -1e300, 1.7e308, -1.7e308], "close": [np.nextafter(1.0, 2), 1.0, np.nextafter(1.0, 0)] * 3, "one": [5.0], None: list(r.normal(size=30)), "tiny": [5e-324, 0.0, -5e-324, 1e-310],
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("ties", None), ("none", None), ("far", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {x["g"]: x for x in order.at_ranks(df, ["g"], "x", {"first": F.lit(0), "mid": F.floor((F.col("n") - 1) / 2), "last": F.col("n") - 1}).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        xs = sorted(xs)
        assert tuple(got[g])[1:] == (len(xs), xs[0], xs[(len(xs) - 1) // 2], xs[-1])
    p = {x["g"]: x for x in order.percentiles(df.filter("g <> 'far'"), ["g"], "x", {"p10": 0.1, "median": 0.5}).collect()}
    for g in ("ties", "close", "one"):
        assert p[g]["median"] == pytest.approx(np.median(groups[g]), abs=0) and p[g]["p10"] == pytest.approx(np.quantile(groups[g], 0.1))
    whole = order.percentiles(df.filter("g = 'ties'").drop("g"), [], "x", {"m": 0.99}).collect()
    assert len(whole) == 1 and whole[0]["m"] == pytest.approx(np.quantile(groups["ties"], 0.99))


def test_at_ranks_refuses(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    with pytest.raises(ValueError, match="infinite"):
        order.at_ranks(df, [], "x", {"a": F.lit(0)})
    with pytest.raises(ValueError, match="no place 5"):
        order.at_ranks(df.limit(1), [], "x", {"a": F.lit(5)})
    assert order.at_ranks(df.limit(0).withColumn("g", F.lit("a")), ["g"], "x", {"a": F.lit(0)}).count() == 0


def test_at_ranks_of_whole_numbers(spark):
    """Beyond what doubles tell apart, whole numbers keep their values."""
    big = 1 << 60
    df = spark.createDataFrame([(big + i,) for i in range(100)], "x long").repartition(3)
    r = order.at_ranks(df, [], "x", {"a": F.lit(7), "b": F.lit(99)}).first()
    assert (r["a"], r["b"]) == (big + 7, big + 99)


def test_dense_ranks(spark):
    r = np.random.default_rng(3)
    names = sorted({"".join(r.choice(list("abé"), r.integers(1, 7))) for _ in range(200)})
    rows = [(g, n, int(r.integers(1, 4))) for g in "xy" for n in names]
    got = {(x["g"], x["n"]): x["_rank"] for x in order.dense_ranks(spark.createDataFrame(rows, "g string, n string, c long").repartition(4), "g", "c", "n").collect()}
    for g in "xy":
        mine = sorted(((-c, n.encode(), n) for h, n, c in rows if h == g))
        assert [got[g, n] for *_, n in mine] == list(range(len(mine)))


def test_positions(spark, monkeypatch):
    monkeypatch.setattr(order, "BUCKETS", 4)
    r = np.random.default_rng(5)
    groups = {"a": r.permutation(500)[:60].tolist(), "b": [7], None: [3, 1_000_000, -5, 4]}
    rows = [(g, int(k)) for g, keys in groups.items() for k in keys]
    got = {(x["g"], x["k"]): x["_at"] for x in order.positions(spark.createDataFrame(rows, "g string, k long").repartition(3), "g", "k").collect()}
    assert got == {(g, k): i for g, keys in groups.items() for i, k in enumerate(sorted(keys))}


def brute(targets, anchors, k):
    unit = lambda v: v / max(np.linalg.norm(v), 1e-8)
    out = []
    for i, t in targets:
        sims = sorted((-round(float(np.round(unit(t) @ unit(a), 9)), 9), j) for j, a in anchors)[:k]
        out += [(i, n + 1, j, pytest.approx(-s, abs=2e-9)) for n, (s, j) in enumerate(sims)]
    return out


@pytest.mark.parametrize("kind", ["clusters", "uniform", "odd"])
def test_nearest_by_cells(spark, monkeypatch, kind):
    r = np.random.default_rng(7)
    if kind == "clusters":
        middles = r.normal(size=(8, 12)) * 5
        v = np.array([middles[i % 8] + r.normal(size=12) * 0.05 for i in range(260)])
    else:
        v = r.normal(size=(260, 12))
    if kind == "odd":
        v[::9] = 0
        v[5::11] = v[40]
        v[7::13] *= 1e-12
    monkeypatch.setattr(vectors, "MOST_BYTES", 100)
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "SLICE", 16)
    targets, anchors = [(i, v[i]) for i in range(60)], [(i, v[i]) for i in range(60, 260)]
    frame = lambda rows: spark.createDataFrame([(i, x.tolist()) for i, x in rows], "id long, vec array<double>").repartition(3)
    got = sorted(tuple(x) for x in vectors.cosine_topk(frame(targets), frame(anchors), 6).collect())
    if kind == "odd":  # what ties but for rounding may change places
        want = brute(targets, anchors, 6)
        assert [(x[0], x[1]) for x in got] == [w[:2] for w in want] and all(x[3] == w[3] for x, w in zip(got, want))
    else:
        assert got == brute(targets, anchors, 6)
    assert vectors.cosine_topk(frame(targets[:3]), frame(anchors).limit(0), 6).count() == 0
    assert vectors.cosine_topk(frame(targets).limit(0), frame(anchors), 6).count() == 0


def test_cells_are_skipped(spark, monkeypatch):
    """Targets in one of several far clusters visit that one alone."""
    r = np.random.default_rng(2)
    v = np.eye(6).repeat(50, axis=0) + r.normal(size=(300, 6)) * 0.01
    monkeypatch.setattr(vectors, "MOST_BYTES", 100)
    monkeypatch.setattr(vectors, "BLOCK", 30)
    seen = []
    meet = vectors._meet
    monkeypatch.setattr(vectors, "_meet", lambda t, a, cells, visits, k: seen.append(sum(visits.values())) or meet(t, a, cells, visits, k))
    frame = lambda rows: spark.createDataFrame([(i, x.tolist()) for i, x in rows], "id long, vec array<double>")
    out = vectors.cosine_topk(frame([(i, v[i]) for i in range(10)]), frame([(i, v[i]) for i in range(10, 300)]), 3)
    assert out.count() == 30 and seen[0] == 10 and seen[1] < 10 * 5  # of ten cells, few are near
