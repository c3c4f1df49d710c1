"""Training runs: gradients, repeatability, stages, selection, and records that keep every rule."""

import json
import random

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import runs as R
from tarnwork.operators import training as tr
from tarnwork.sources import io

EASY = tr.Settings(batch=32, max_steps=12, eval_every=4, epochs=2)


def texts(n, seed, classes=2):
    r = random.Random(seed)
    signs = [["good", "fine"], ["bad", "poor"], ["odd"]]
    rows = []
    for i in range(n):
        c = i % classes
        rows.append((i, " ".join(r.choices(["the", "a", "thing", "is", "of"], k=4) + [r.choice(signs[c])]), c, "test" if i % 7 == 0 else "val" if i % 7 == 1 else "train"))
    return rows


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame(texts(210, 1), "doc_id long, text string, label int, split string")


def test_gradient_is_the_loss_slope(spark):
    shape = tr.Shape(3, 3)
    rows = spark.createDataFrame([(0, [1, 5], [0.6, 0.8]), (2, [5], [1.0]), (1, [], [])], "y int, idx array<int>, val array<double>").repartition(2)
    state = np.random.default_rng(0).normal(size=shape.size)
    sums = tr._sums(rows, tr._gradient, state, shape, 2 + shape.size)
    assert sums[0] == 3
    for i in (3 * 1, 3 * 5 + 2, shape.encoder, shape.encoder + 4, shape.size - 1):
        ends = []
        for h in (1e-5, -1e-5):
            moved = state.copy()
            moved[i] += h
            ends.append(tr.evaluate(rows, moved, shape)["eval_loss"] * 3)
        assert sums[2 + i] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)
    assert tr.evaluate(rows, state, shape)["eval_loss"] * 3 == pytest.approx(sums[1])
    assert not sums[2 : 2 + shape.encoder].reshape(-1, 3)[[0, 2, 3, 4, 6]].any()  # words that don't occur


def test_new_head_leaves_the_encoder():
    shape = tr.Shape(4, 2)
    state = tr.base_model("b", shape) + 1
    new = tr.with_new_head(state, 4, 5, 7)
    assert (new[: shape.encoder] == state[: shape.encoder]).all() and len(new) == tr.Shape(4, 5).size and not new[-5:].any()
    assert (tr.with_new_head(state, 4, 5, 7) == new).all() and (tr.with_new_head(state, 4, 5, 8) != new).any()


def test_run_keeps_every_rule_and_repeats(spark, target, tmp_path):
    source = spark.createDataFrame([(i, t, c) for i, t, c, _ in texts(90, 2, 3)], "doc_id long, text string, label int")
    how = {"base": "b", "seed": 3, "train_size": 100, "settings": EASY, "test": True, "folder": f"file://{tmp_path}/stages"}
    plain = tr.run(target, "doc_id", condition="plain", **how)
    staged = tr.run(target, "doc_id", condition="staged", source=source, source_name="three", **how)
    again = tr.run(target.repartition(5), "doc_id", condition="staged", source=source.repartition(2), source_name="three", **how)
    assert not staged.pop("tr_cache_hit") and again.pop("tr_cache_hit") and staged == again
    assert plain["tr_stage_macro_f1"] is None and staged["tr_stage_macro_f1"] > 0.4 and plain["step_history"] != staged["step_history"]
    assert plain["actual_train_size"] == 100 and plain["selected_validation_macro_f1"] > 0.9 and plain["test_comparison"]["test_macro_f1"] > 0.9
    parsed = io.parse_runs(tr.records(spark, [plain, staged]))
    assert all(r["n"] == 0 for r in R.violations(parsed, R.record_rules()).collect())
    steps = parsed.select("r.condition", F.explode("r.step_history").alias("h")).select("condition", F.col("h.step").alias("step"), F.col("h.eval_macro_f1").alias("f1"))
    for r in R.summarise(steps, ["condition"]).collect():
        own = plain if r["condition"] == "plain" else staged
        assert (r["selected_step"], r["selected_f1"], r["first_escape"], r["verdict"]) == (own["selected_step"], own["selected_validation_macro_f1"], own["escape_step"], own["per_run_verdict"])
    assert io.flatten_runs(parsed).count() == 2


def test_best_step_is_first_of_equals(spark, target):
    rows, buckets = tr.features(target.filter("split = 'train'"), "doc_id", 0, 32)
    held, _ = tr.features(target.filter("split = 'val'"), "doc_id", 0, 32)
    shape = tr.Shape(4, 2)
    state = tr.with_new_head(tr.base_model("b", shape), 4, 2, 0)
    end, history, best = tr.train(rows, buckets, state, shape, EASY._replace(eval_every=2), 8, held)
    (step, chosen), scores = next(iter(best.items())), {h["step"]: h["eval_macro_f1"] for h in history}
    assert list(scores) == [2, 4, 6, 8] and step == min(s for s, f in scores.items() if f == max(scores.values()))
    assert round(tr.evaluate(held, chosen, shape)["eval_macro_f1"], 6) == scores[step]
    assert round(tr.evaluate(held, end, shape)["eval_macro_f1"], 6) == scores[8]


def test_buckets_share_out_all_rows(spark, target):
    rows, buckets = tr.features(target, "doc_id", 5, 50)
    assert buckets == 5 and rows.count() == 210 and rows.select("bucket").distinct().count() == 5
    odd = spark.createDataFrame([(None, None, 0), (1, "", 1), (1, "x " * 9000, 0)], "doc_id long, text string, label int")
    got = tr.features(odd, "doc_id", 0, 50)[0].collect()
    assert sorted(len(r["idx"]) for r in got) == [0, 0, 1]


def test_refusals(spark, target):
    with pytest.raises(ValueError, match="no multiple"):
        tr.run(target, "doc_id", base="b", condition="c", seed=1, train_size=9, settings=EASY._replace(eval_every=5))
    with pytest.raises(ValueError, match="no rows"):
        tr.run(target.limit(0), "doc_id", base="b", condition="c", seed=1, train_size=9, settings=EASY)


def test_records_are_json(spark):
    assert json.loads(tr.records(spark, [{"base": "b", "condition": "c", "train_size": 1, "seed": 2}]).first()["value"])["seed"] == 2


def test_chained_steps_are_single_steps(spark, target, monkeypatch):
    """Steps that a task takes after each other, against those of each batch by itself, with buckets and a whole part that hold no rows; a job for each part, not for each step."""
    monkeypatch.setattr(tr, "CHAIN_ROWS", 32)
    shape, how = tr.Shape(4, 2), EASY._replace(batch=16)
    rows, buckets = tr.features(target.filter("split = 'train'"), "doc_id", 0, 16)
    rows = rows.filter("bucket NOT IN (4, 5, 7)")
    steps, start = buckets + 3, tr.with_new_head(tr.base_model("b", shape), 4, 2, 0)
    spark.sparkContext.setJobGroup("chained", "")
    end, history, best = tr.train(rows, buckets, start, shape, how, steps)
    spark.sparkContext.setJobGroup("other", "")
    assert buckets == 10 and not history and not best and len(spark.sparkContext.statusTracker().getJobIdsForGroup("chained")) == 7
    data, now = rows.toArrow(), (start, np.zeros(shape.size), np.zeros(shape.size))
    for t in range(1, steps + 1):
        sums = np.zeros(2 + shape.size)
        for batch in data.filter(pc.field("bucket") == (t - 1) % buckets).combine_chunks().to_batches():
            tr._add_gradient(sums, now[0], shape, *tr._columns(batch))
        now = tr._stepped(*now, sums, t, steps, how)
    assert np.allclose(end, now[0], rtol=0, atol=1e-9) and not np.allclose(end, start, rtol=0, atol=1e-3)


def test_runs_share_what_is_ready(spark, target):
    how = {"base": "b", "condition": "plain", "seed": 3, "train_size": 100, "settings": EASY, "test": True}
    assert tr.run(tr.ready(target, "doc_id", 3, 100, EASY.batch, test=True), "doc_id", **how) == tr.run(target, "doc_id", **how)
