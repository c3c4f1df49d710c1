"""Hand-checked cases of single operators."""

import hashlib
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwork.functions import bytelevel
from tarnwork.operators import audit, corpus, prep, runs, stats, vectors, vocab
from tarnwork.sources import io


def test_dedup_drops_conflicts(spark):
    rows = [(0, "salam dünya", 1), (1, "  Salam   Dünya ", 1), (2, "ziddiyyət", 0), (3, "ziddiyyət", 1), (4, "tək qeyd", 2)]
    df = spark.createDataFrame(rows, "i int, text string, label int")
    assert [r["i"] for r in prep.dedup(df, "i").orderBy("i").collect()] == [0, 4]
    s = prep.dedup_stats(df).first()
    assert (s["duplicates_removed"], s["conflicts"], s["n_after"]) == (3, 1, 2)
    once = prep.dedup(df, "i")
    assert prep.dedup(once, "i").count() == once.count()


def test_exclusion(spark):
    df = spark.createDataFrame([(x,) for x in ("neutral", "a", "b", "neutral")], "label string")
    assert tuple(prep.exclusion_stats(df, ["neutral"]).first())[1:] == (4, 2, 2)
    assert prep.exclude_classes(df, []).count() == 4


def test_split_sizes(spark):
    df = spark.range(13962).select("id", F.lit(0).alias("label")).unionAll(spark.range(20000, 33952).select("id", F.lit(1).alias("label")))
    n = {r["split"]: r["count"] for r in prep.stratified_split(df, "id").groupBy("split").count().collect()}
    assert n == {"train": 20937, "val": 2791, "test": 4186}


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("label"))
    got = [sorted(map(tuple, prep.stratified_split(df.repartition(k), "id").select("id", "split").collect())) for k in (1, 3, 8)]
    assert got[0] == got[1] == got[2]


def test_schemes_and_keys(spark):
    v = spark.createDataFrame([("p", "▁gəl", 0), ("p", "▁c", 1), ("w", "a", 0), ("w", "##di", 1), ("f", "bu</w>", 0), ("f", "san</w>", 1), ("f", "ie", 2)], "tokenizer string, token string, token_id long")
    assert {r[0]: r[1] for r in vocab.schemes(v).collect()} == {"p": "sentencepiece", "w": "wordpiece", "f": "fastbpe"}
    keys = {(r["tokenizer"], r["surface"], r["initial"]) for r in vocab.canon_vocab(v).collect()}
    assert {("p", "gəl", True), ("w", "di", False), ("w", "a", True), ("f", "bu</w>", True)} <= keys
    assert "bu" in {r["surface"] for r in vocab.surface_vocab(v).collect()}


def test_functional_anchors(spark):
    donor = spark.createDataFrame([(1, [12], [7, 8]), (2, [4, 5], [30]), (3, [4, 5], [6, 7]), (4, [9], [9])], "donor_id long, alone array<long>, spaced array<long>")
    got = {r["donor_id"]: (r["base_id"], r["how"]) for r in vocab.anchors_encoded(donor, spark.createDataFrame([(9,)], "token_id long")).collect()}
    assert got == {1: (12, "standalone"), 2: (30, "leading_space")}


def test_byte_level():
    assert bytelevel.decode("âĸģgÉĻlmiÅŁdi") == "▁gəlmişdi"
    assert bytelevel.decode("a b") is None and bytelevel.decode("âĸ") is None
    assert sorted(bytelevel.byte_table().values()) == list(range(256))


def test_omp_finds_the_support():
    rng = np.random.default_rng(0)
    atoms = rng.normal(size=(20, 64))
    atoms /= np.linalg.norm(atoms, axis=1, keepdims=True)
    at, w = vectors.omp(0.6 * atoms[3] - 0.4 * atoms[7], atoms, 2)
    assert dict(zip(at.tolist(), w.round(6).tolist())) == {3: 0.6, 7: -0.4}


def test_cells(spark):
    grid = spark.createDataFrame([("a",), ("b",), ("c",)], "cell string")
    r = spark.createDataFrame([("a", True, 0.577, False), ("a", False, 0.333, False), ("b", False, 0.3, False), ("b", False, 0.2, False)], "cell string, escaped boolean, f1 double, collapsed boolean")
    got = {x["cell"]: x for x in stats.cell_summary(grid, r, ["cell"]).collect()}
    assert got["a"]["escape_rate"] == 0.5 and got["a"]["conditional_f1"] == 0.577
    assert got["b"]["status"] == "MEASURED" and got["b"]["escape_count"] == "0/2" and got["b"]["conditional_f1"] is None
    assert got["c"]["status"] == "NOT MEASURED" and got["c"]["escape_rate"] is None


def test_wilson(spark):
    df = spark.createDataFrame([(2, 5), (5, 5), (3, 3), (0, 0)], "k int, n int")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = [(None if a is None else round(a, 4), None if b is None else round(b, 4)) for a, b in df.select(lo, hi).collect()]
    assert got == [(0.1176, 0.7693), (0.5655, 1.0), (0.4385, 1.0), (None, None)]


def test_fisher(spark):
    df = spark.createDataFrame([(1, 5, 0, 0, 5), (2, 10, 10, 10, 10), (3, 18, 2, 2, 18), (4, 15, 1, 48, 2)], "k int, a long, b long, c long, d long")
    got = {r["k"]: r for r in stats.fisher(df, ["k"]).collect()}
    assert got[1]["p"] == 0.00794 and got[1]["odds_ratio"] is None
    assert got[2]["p"] >= 0.05 and got[3]["significant"]
    assert got[4]["odds_ratio"] == 0.625 and got[4]["p"] == 1.0


@pytest.mark.parametrize("t, df, p", [(2.228, 10, 0.05), (12.706, 1, 0.05), (0.0, 5, 1.0), (1.96, 1e6, 0.05)])
def test_student(t, df, p):
    assert math.isclose(stats.student_p(t, df), p, abs_tol=2e-4)


@given(st.lists(st.floats(0, 1), min_size=1, max_size=8))
@settings(max_examples=5, deadline=None)
def test_holm_is_monotone(spark, ps):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = [r["p_holm"] for r in stats.holm(df, "p", ["i"]).orderBy("p", "i").collect()]
    assert got == sorted(got) and all(h >= round(p, 6) - 1e-6 for h, p in zip(got, sorted(ps)))


def test_gate_and_decomposition(spark):
    one = spark.range(1)
    gate = lambda *x: one.select(audit.gate(*(F.lit(v) for v in x))).first()[0]
    assert gate(70.0, 90.0, 60.0) == "PROCEED_WITH_CAVEAT" and gate(50.0, 90.0, 90.0) == "STOP_TASK_TOO_SUBJECTIVE"
    p = spark.createDataFrame([("x", "positive", "positive"), ("x", "neutral", "neutral"), ("x", "neutral", "positive"), ("x", "positive", "negative"), ("x", "negative", "positive")], "k string, a string, b string")
    r = audit.decompose(p, ["k"], "a", "b").first()
    assert (r["agreements"], r["neutral_boundary"], r["polarity_flip"]) == (2, 1, 2)


def test_selection_and_terminal(spark):
    s = spark.createDataFrame([("r", 1, 0.3), ("r", 2, 0.6), ("r", 3, 0.6), ("r", 4, 0.35)], "run string, step long, f1 double")
    r = runs.summarise(s, ["run"]).first()
    assert (r["selected_step"], r["first_escape"], r["terminal_step"], r["collapsed"], r["verdict"]) == (2, 2, 4, True, "ESCAPED")


def test_sources(spark, tmp_path):
    raw = "idx,text,your_label\n1,söz ğ,bilmirəm\n"
    assert io.decode_csv(raw.encode("utf-8-sig"))[1] == "utf-8-sig"
    rows, name = io.decode_csv("idx,text\n1,ğ\n".encode("cp1254"))
    assert name == "cp1254" and rows[0]["text"] == "ğ"
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "idx int, text string, your_label string")
    io.write_csv_bom(df, f"{tmp_path}/x.csv", ["idx", "text", "your_label"])
    data = (tmp_path / "x.csv").read_bytes()
    assert data.startswith(b"\xef\xbb\xbf") and b"1,a,\r\n" in data
    io.write_json({"a": float("nan"), "b": [1.0, float("inf")]}, f"{tmp_path}/r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": None, "b": [1.0, None], "n_nonfinite_values_nulled": 2}
    io.write_jsonl(df, f"{tmp_path}/j")
    assert io.read_jsonl(spark, f"{tmp_path}/j", "idx int, text string").count() == 2
    with pytest.raises(ValueError):
        io.load_records(spark, f"{tmp_path}/x.csv", "csv", "text", "nope")
    e = spark.createDataFrame([("emb.weight", [5, 3]), ("x", [5]), ("head.weight", [5, 3])], "key string, shape array<int>")
    assert io.pick_tensor(e, 5, ["emb"]).first()[0] == "emb.weight"


def record(**other):
    """A complete run record."""
    out = {
        "run_result_schema_version": 4, "n_labels": 2, "base": "b", "condition": "c", "condition_id": 1, "tokenizer": "t", "turkish": "none", "train_size": 500, "seed": 13,
        "step_history": [{"step": 65, "epoch": 1.0, "eval_loss": 0.8, "eval_macro_f1": 0.5, "train_loss": 0.9, "validation_prediction_counts": {"0": 1400, "1": 1391}}],
        "escaped": True, "escape_step": 65, "selected_step": 65, "selected_validation_macro_f1": 0.5, "terminal_step": 65, "terminal_validation_macro_f1": 0.5, "escaped_but_terminal_collapsed": False,
        "test_comparison": {"eval_split": "val", "selection": "best_validation_checkpoint", "matched_step": 65, "validation_macro_f1_matched": 0.5, "restored_validation_macro_f1": 0.5, "test_macro_f1": None, "delta_test_minus_validation_matched": None},
        "max_steps": 2000, "completed_steps": 2000, "steps_per_epoch": 63, "effective_epochs": 2000 / 63, "per_run_verdict": "ESCAPED", "eval_split": "val",
        "training_settings": {"max_steps": 2000, "eval_every_steps": 65, "metric_for_best_model": None, "early_stopping_patience": None, "load_best_model_at_end": False},
    }
    for path, v in other.items():
        at, keys = out, path.split("__")
        for k in keys[:-1]:
            at = at[int(k) if k.isdigit() else k]
        if v is ...:
            del at[keys[-1]]
        else:
            at[keys[-1]] = v
    return out


def test_streaming_ingests_each_file_once(spark, tmp_path):
    from tarnwork.streaming.ingest import ingest_runs

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(record(seed=i, run_result_schema_version=4 if i else 3), indent=1))
    (tmp_path / "in" / "old.json").write_text(json.dumps({"f1": 0.5}))
    for _ in range(2):
        ingest_runs(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    rows, skipped = io.scan_runs(spark, f"{tmp_path}/in")
    assert rows.columns == [*io.RUN_COLUMNS, "source_path"] and len(rows.columns) == 25
    got = {r["seed"]: r for r in rows.collect()}
    assert set(got) == {1, 2} and got[1]["base_role"] == "unknown" and got[1]["selected_validation_macro_f1"] == 0.5 and got[1]["test_macro_f1"] is None and got[1]["source_path"].endswith("1.json")
    assert dict(skipped.collect()) == {3: 1, 0: 1}


BREAKS = {
    "has_keys": {"escape_step": ...}, "has_version": {"run_result_schema_version": 3}, "has_settings": {"training_settings__max_steps": ...}, "has_escaped": {"escaped": None}, "has_steps": {"step_history": []}, "verdict_known": {"per_run_verdict": "MAYBE"},
    "history_has_keys": {"step_history__0__eval_loss": ...}, "classes_complete": {"step_history__0__validation_prediction_counts__2": 1}, "counts_whole": {"step_history__0__validation_prediction_counts__0": -1}, "selected_in_history": {"selected_step": 66},
    "escaped_matches": {"escaped": False}, "escape_step_matches": {"escape_step": 60}, "terminal_step_is_last": {"terminal_step": 1}, "terminal_score_is_last": {"terminal_validation_macro_f1": 0.4}, "collapse_matches": {"escaped_but_terminal_collapsed": True},
    "comparison_split_matches": {"test_comparison__eval_split": "test"}, "selection_known": {"test_comparison__selection": "luck"}, "restored_verified": {"test_comparison__restored_validation_macro_f1": None}, "restored_matches": {"test_comparison__restored_validation_macro_f1": 0.51},
    "matched_step": {"test_comparison__matched_step": 64}, "matched_score": {"test_comparison__validation_macro_f1_matched": 0.6}, "test_score_where_tested": {"eval_split": "test"}, "no_test_score_elsewhere": {"test_comparison__test_macro_f1": 0.4},
}


def test_record_rules(spark):
    """A complete record breaks no rule; each fault breaks its own."""
    second = {"step": 65, "eval_loss": 0.7, "eval_macro_f1": 0.5, "validation_prediction_counts": {"0": 1, "1": 2}}
    cases = {"good": {}, **BREAKS, "steps_increase": {"step_history": [record()["step_history"][0], second]}, "matched_delta": {"eval_split": "test", "test_comparison__eval_split": "test", "test_comparison__test_macro_f1": 0.4, "test_comparison__delta_test_minus_validation_matched": -0.2}}
    raw = spark.createDataFrame([(json.dumps(record(**c)), k) for k, c in cases.items()], "value string, source_path string")
    rules = runs.record_rules()
    assert set(rules) == set(cases) - {"good"}
    for r in io.parse_runs(raw).select("source_path", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items())).collect():
        broken = {k for k in rules if not r[k]}
        assert broken == set() if r["source_path"] == "good" else r["source_path"] in broken, (r["source_path"], broken)
    ok = record(eval_split="test", test_comparison__eval_split="test", test_comparison__test_macro_f1=0.4, test_comparison__delta_test_minus_validation_matched=-0.1)
    one = io.parse_runs(spark.createDataFrame([(json.dumps(ok), "x")], "value string, source_path string"))
    assert all(v == 0 for v in dict(runs.violations(one, rules).collect()).values())


def test_digits_and_leaks(spark):
    df = spark.createDataFrame([(d,) for _, _, d in audit.PROBES] + [(" Bilmirəm",), ("",)], "x string")
    assert [r[0] for r in df.select(audit.canonical(F.col("x"))).collect()] == [*(w for _, w, _ in audit.PROBES), "unclear", None]
    blind = spark.createDataFrame([(1, "t", None)], "idx int, text string, your_label string")
    assert audit.leaking_columns(blind) == [] and audit.is_blind(blind) and not audit.is_blind(blind.fillna("x"))
    assert audit.leaking_columns(blind.withColumns({c: F.lit(1) for c in ("Labels", "label_name", "verdict", "answer", "correct", "score")})) == ["Labels", "label_name", "verdict", "answer", "correct"]


def test_agreement_intervals(spark):
    r = np.random.default_rng(2)
    rows = [("p", i, "abc"[r.integers(3)], "abc"[r.integers(3)] if i % 3 else "unclear") for i in range(40)]
    got = audit.agreement_intervals(spark.createDataFrame(rows, "k string, i int, a string, b string"), ["k"], "a", "b", "i", 700).first()
    some = [(a, b) for _, _, a, b in rows if b != "unclear"]

    def kappa(x):
        po = np.mean([a == b for a, b in x])
        pe = sum(np.mean([a == c for a, _ in x]) * np.mean([b == c for _, b in x]) for c in "abc")
        return (po - pe) / (1 - pe)

    for stat, cols in ((lambda x: 100 * np.mean([a == b for a, b in x]), ("agree_lo", "agree_hi")), (kappa, ("kappa_lo", "kappa_hi"))):
        rng = np.random.default_rng(0)
        draws = [stat([some[k] for k in rng.integers(0, len(some), size=len(some))]) for _ in range(700)]
        assert [got[c] for c in cols] == pytest.approx(np.percentile(draws, [2.5, 97.5]), abs=1e-3)


def test_difference_interval():
    a, b = np.array([0.5, 0.6, 0.7]), np.array([0.8, 0.9])
    rng = np.random.default_rng(0)
    x, y = rng.choice(a, size=(500, 3), replace=True).mean(axis=1), rng.choice(b, size=(500, 2), replace=True).mean(axis=1)
    assert stats.bootstrap_difference(a, b, 500) == pytest.approx(tuple(np.percentile(y - x, [2.5, 97.5])))


def greedy(vocab):
    """An encoder, defined here so that it travels by value."""

    class Greedy:
        """Longest known pieces, -1 for unknown characters; a text that begins with a space takes the marked pieces."""

        refused = {0}

        def __init__(self, vocab):
            self.vocab = vocab

        def encode(self, texts):
            return [self.one(t) for t in texts]

        def one(self, text):
            text, ids, i = ("\u2581" + text[1:]) if text.startswith(" ") else text, [], 0
            while i < len(text):
                for j in range(len(text), i, -1):
                    if text[i:j] in self.vocab:
                        ids.append(self.vocab[text[i:j]])
                        i = j
                        break
                else:
                    ids.append(-1)
                    i += 1
            return ids

    return lambda: Greedy(vocab)


def test_anchors_by_encoding(spark):
    donor = spark.createDataFrame([("d", "di", 1), ("d", "ev</w>", 2), ("d", "xyz</w>", 3), ("d", "un</w>", 4)], "tokenizer string, token string, token_id long")
    refused = spark.createDataFrame([(0,)], "token_id long")
    got = vocab.anchors_by_encoding(donor, "d", greedy({"di": 12, "\u2581ev": 30, "un": 0}), refused)
    assert {tuple(r) for r in got.collect()} == {(1, 12, "standalone"), (2, 30, "leading_space")}


def test_encoding_files(spark):
    from tokenizers import Tokenizer

    from tarnwork.functions import encoding

    texts = ["The small house", None, "", "naïve <|endoftext|> ə", "a" * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("ids", F.lit("mine"))
    tok = Tokenizer.from_file(encoding.public_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    got = {r["i"]: r["ids"] for r in encoding.encoded(df, "text", "byte_bpe_50k.json").collect()}
    assert got == {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=encoding.public_path("piece_bpe_32k.model"))
    got = {r["i"]: r["ids"] for r in encoding.encoded(df, "text", "piece_bpe_32k.model").collect()}
    assert got == {i: sp.encode(t or "") for i, t in enumerate(texts)}
    m = corpus.encoded_lengths(df.filter("i = 0").drop("ids"), "byte_bpe_50k.json").first()
    assert (m["n_words"], m["n_word_chars"], m["n_unknown"]) == (3, 13, 0)


def test_profile_criteria(spark):
    rows = [("a", f"t{i}", i % 3) for i in range(30)] + [("a", "t0", 0), ("a", "t1", 2), ("b", "x", 0)]
    df = spark.createDataFrame(rows, "g string, text string, label int")
    scores = spark.createDataFrame([("a", 0.7, None)], "g string, headroom double, gated boolean")
    got = {r["g"]: r for r in prep.candidate_profile(df, "g", min_rows=20, scores=scores).collect()}
    assert (got["a"]["rows_raw"], got["a"]["rows_after_dedup"], got["a"]["n_classes"], got["a"]["passes"]) == (32, 29, 3, True)
    assert not got["b"]["passes"] and not got["b"]["headroom_ok"] and got["b"]["majority_share"] == 1.0


def test_seeded_cuts_against_ranks(spark):
    """The cuts found from ranges give what ordering each group gives, nulls and small groups too."""
    rows = [(i, "t", None if i % 7 == 0 else "ab"[i % 2] if i % 5 else "c") for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, text string, label string")
    got = {r["k"]: r["split"] for r in prep.stratified_split(df, "k").collect()}
    groups = {}
    for k, _, label in rows:
        groups.setdefault(label, []).append((hashlib.md5(f"17:{k}".encode()).hexdigest(), k))
    for g in groups.values():
        v, t = int(len(g) * 0.10), int(len(g) * 0.15)
        for at, (_, k) in enumerate(sorted(g)):
            assert got[k] == ("val" if at < v else "test" if at < v + t else "train")
    cut = prep.positional_cut(df, "k", 0.371)
    assert {r["k"] for r in cut.filter("split = 'train'").collect()} == set(range(1113))
    assert prep.positional_cut(df.limit(0), "k").count() == 0 and prep.positional_cut(df, "k", 0.0).filter("split = 'train'").count() == 0


def test_audit_sample_has_no_fill(spark):
    df = spark.createDataFrame([(i, f"Text {i}", "a" if i < 3 else "b") for i in range(40)], "k int, text string, label string")
    got = prep.audit_sample(df, 20, "k").groupBy("label").count().collect()
    assert dict(got) == {"a": 3, "b": 10}
    prep.assert_disjoint(df.filter("k < 5"), df.filter("k >= 5"))
    with pytest.raises(ValueError):
        prep.assert_disjoint(df.filter("k < 5"), df.select("k", F.upper("text").alias("text"), "label"))


def test_fisher_and_factorials():
    import math

    n = np.array([0, 1, 5, 255, 256, 1000, 10**6])
    assert np.allclose(stats.log_factorial(n), [math.lgamma(x + 1) for x in n.tolist()], rtol=1e-13)


def test_random_weights_are_normal(spark):
    top = spark.createDataFrame([(i, r, 100 + r) for i in range(2000) for r in range(1, 9)], "id int, rank int, anchor_id int")
    rows = vectors.random_weights(top, 5, "17").collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r["w"])
    assert all(len(v) == 5 and abs(sum(map(abs, v)) - 1) < 1e-9 for v in by.values())
    assert abs(np.mean([w for v in by.values() for w in v])) < 0.02


def test_config():
    from tarnwork.sources import config

    assert config.unfilled({"a": {"b": "FILL", "e": [1, "FILL"]}, "c": "to FILL in", "d": None}) == ["a.b", "a.e[1]"]
    lock = {"x": config.content_hash(b"a\nb"), "gone": "0", "_comment": "made by hand"}
    config.verify_lock({"x": b"a\r\nb", "beside": b""}, {"x": lock["x"], "_comment": "text"})
    with pytest.raises(ValueError, match="^gone: missing; x: changed$"):
        config.verify_lock({"x": b"other", "new": b""}, lock)


def test_texts_and_caches(spark, tmp_path):
    from tarnwork.sources import config

    (tmp_path / "lines.txt").write_text("one two three four five\nshort\n\nsix seven eight nine ten eleven\n")
    lines = f"{tmp_path}/lines.txt"
    assert [tuple(r) for r in io.line_file(spark, lines, 5).collect()] == [(0, "one two three four five"), (3, "six seven eight nine ten eleven")]
    train = spark.createDataFrame([(i, "x" * 30 + str(i) * 20) for i in range(9)], "doc_id long, text string")
    got = [config.resolve_eval_text(spark, path, t, "a\nb") for path, t in ((lines, train), ("/none", train), (None, None))]
    assert [(r.count(), r.first()["provenance"]) for r in got] == [(3, f"file {lines}"), (9, "train sample, seed 17"), (2, "built in")]
    assert config.text_or("/none", "x") == "x" and config.text_or(lines, "x").startswith("one")
    for lang, cols in (("az", ("id", "sentence")), ("tr", ("text", "other")), ("en", ("first", "second"))):
        spark.createDataFrame([(f"{lang}{i}a", f"{lang}{i}b") for i in range(4)], list(cols)).coalesce(1).write.parquet(f"{tmp_path}/{lang}")
    p = io.parallel_texts(spark, {"az": ["/none", f"{tmp_path}/az"], "tr": [f"{tmp_path}/tr"], "en": [f"{tmp_path}/en"]}, 3)
    assert {(r["lang"], r["sent_id"]): r["text"] for r in p.collect()} == {(lang, i): f"{lang}{i}{'b' if lang == 'az' else 'a'}" for lang in ("az", "tr", "en") for i in range(3)}
    with pytest.raises(ValueError):
        io.parallel_texts(spark, {"az": ["/none"]}, 3)
    built = []
    make = lambda: built.append(1) or spark.range(3)
    one, two = (config.cached(spark, f"file://{tmp_path}/cache", spec, make) for spec in ({"a": 1, "b": [2]}, {"b": [2], "a": 1}))
    assert one.count() == two.count() == 3 and built == [1]
    (next((tmp_path / "cache").iterdir()) / "spec").rename(tmp_path / "gone")
    spark.createDataFrame([("other",)], "value string").write.text(f"{tmp_path}/cache/{config.content_key({'a': 1, 'b': [2]})}/spec")
    with pytest.raises(ValueError):
        config.cached(spark, f"file://{tmp_path}/cache", {"a": 1, "b": [2]}, make)
    io.write_markdown(p, ["lang", "text"], f"{tmp_path}/t.md", [lines])
    assert (tmp_path / "t.md").read_text().startswith("| lang | text |") and lines in (tmp_path / "t.md.sources.json").read_text()
    (tmp_path / "c.yaml").write_text("a: 1\nb: [x, FILL]\n")
    with pytest.raises(ValueError, match=r"b\[1\]"):
        config.load_config(f"{tmp_path}/c.yaml")
    io.append_ledger(spark.range(2), f"{tmp_path}/ledger")
    io.append_ledger(spark.range(1), f"{tmp_path}/ledger")
    assert spark.read.json(f"{tmp_path}/ledger").count() == 3


def test_logs(spark, tmp_path):
    """Lines of a real run's log."""
    lines = [
        "20:11:04 | INFO    | src.training.finetune |   [AZ mərhələsi] 2000 nümunə | 2 sinif | init=baza",
        "20:11:05 | INFO    | src.training.finetune | STAGE=azerbaijani start ts=2026-09-08T20:11:05.047597+00:00 n=2000 n_classes=2",
        "20:11:06 | INFO    | src.training.finetune | STEP step=10 loss=4.1386 dt_sec=0.83 cum_wall_sec=0.8",
        "20:13:53 | INFO    | src.training.finetune | STEP step=2000 loss=nan dt_sec=0.76 cum_wall_sec=168.2",
        "20:13:56 | INFO    | src.training.finetune | STAGE=azerbaijani end ts=2026-09-08T20:13:56.703761+00:00 runtime_sec=171.7",
        "20:13:58 | INFO    | src.training.finetune | Best checkpoint restored and verified: step 1600, val macro-F1 = 0.7058",
        "Traceback (most recent call last):",
    ]
    (tmp_path / "base=xlm15__cond=transplant_mean__n=2000__seed=1337__20260908T201104Z.log").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "other.log").write_text("20:11:06 | WARNING | a.b | x\n")
    got = io.parse_log(io.read_logs(spark, str(tmp_path))).orderBy("file", "block", "line").collect()
    assert [r["kind"] for r in got] == ["other", "stage", "step", "step", "stage", "restored", None, "other"]
    assert [(r["step"], r["loss"], r["dt_sec"], r["cum_wall_sec"]) for r in got if r["kind"] == "step"] == [(10, 4.1386, 0.83, 0.8), (2000, None, 0.76, 168.2)]
    assert [(r["stage"], r["event"], r["runtime_sec"]) for r in got if r["kind"] == "stage"] == [("azerbaijani", "start", None), ("azerbaijani", "end", 171.7)]
    assert (got[5]["step"], got[5]["score"], got[0]["time"], got[-1]["level"], got[-1]["logger"]) == (1600, 0.7058, "20:11:04", "WARNING", "a.b")
    assert tuple(got[0])[1:6] == ("xlm15", "transplant_mean", 2000, 1337, "20260908T201104Z") and tuple(got[-1])[1:6] == (None,) * 5


def test_csv_folder(spark, tmp_path):
    """Each file in its own encoding, read by the tasks."""
    for name, raw in (("a.csv", "idx,text\n1,söz ğ\n2,\n".encode("utf-8-sig")), ("b.csv", "idx,text\n3,ğ\n".encode("cp1254")), ("c.csv", "idx,text\n4,ə\n5\n6,x,y\n".encode()), ("d.csv", b""), ("e.csv", b"idx,text\n7,\x81\x8d\n")):
        (tmp_path / name).write_bytes(raw)
    got = sorted((r["path"].rsplit("/", 1)[1], r["row"], r["encoding"], r["values"]) for r in io.read_csv_folder(spark, str(tmp_path)).collect())
    assert got == [
        ("a.csv", 0, "utf-8-sig", {"idx": "1", "text": "söz ğ"}), ("a.csv", 1, "utf-8-sig", {"idx": "2", "text": ""}), ("b.csv", 0, "cp1254", {"idx": "3", "text": "ğ"}),
        ("c.csv", 0, "utf-8-sig", {"idx": "4", "text": "ə"}), ("c.csv", 1, "utf-8-sig", {"idx": "5", "text": None}), ("c.csv", 2, "utf-8-sig", {"idx": "6", "text": "x"}), ("e.csv", 0, "latin-1", {"idx": "7", "text": "\x81\x8d"}),
    ]


def test_degenerate_and_stream_cap(spark):
    from tarnwork.operators import grid

    df = spark.createDataFrame([(0.9, {"0": 5, "1": 0}), (0.9, {"0": 5, "1": 1}), (0.4, {"0": 5, "1": 1}), (None, {"0": 5})], "f1 double, counts map<string,int>")
    assert [r[0] for r in df.select(runs.degenerate(F.col("f1"), F.col("counts"))).collect()] == [True, False, True, None]
    assert [grid.stream_cap(8, c, 7.0) for c in (100.0, 30.0, 8.0)] == [8, 4, 1]
    with pytest.raises(ValueError):
        grid.stream_cap(8, 1.0, 7.0)


def test_byte_level_vocabularies(spark):
    from tarnwork.functions import encoding

    v = encoding.vocabulary(spark, "bytes", "byte_bpe_50k.json").unionByName(encoding.vocabulary(spark, "words", "word_bpe_49k.json"))
    assert dict(bytelevel.is_byte_level(v).collect())["bytes"] is True
    tokens = {r["token"]: r["token_id"] for r in bytelevel.decode_vocab(v.filter("tokenizer = 'bytes'")).collect()}
    ids = {t: i for t, i in encoding.load(encoding.public_path("byte_bpe_50k.json")).tokens()}
    assert tokens[" the"] == ids["Ġthe"] and tokens["ée"] == ids["Ã©e"]


def test_identity_leaves_the_matrix(spark):
    """With each token its own anchor, assembly and transfer give the matrix back."""
    r = np.random.default_rng(1)
    m = r.normal(size=(20, 6))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(20)], "id long, vec array<double>")
    none = df.limit(0)
    back = {x["id"]: x["vec"] for x in vectors.assemble(df.select("id"), df, none, none).collect()}
    assert all(back[i] == m[i].tolist() for i in range(20))
    own = spark.createDataFrame([(i, i, 1.0) for i in range(20)], "id long, anchor_id long, w double")
    assert all(x["vec"] == m[x["id"]].tolist() for x in vectors.transfer(own, df).collect())
    unit = {x["id"]: x["v"] for x in df.select("id", vectors.normalise(F.col("vec")).alias("v")).collect()}
    assert all(np.allclose(unit[i], m[i] / np.linalg.norm(m[i])) for i in range(20))


def test_queries_without_sql_on_values(spark):
    """Matching pursuit, p-values and PCG64 intervals against numpy."""
    from tarnwork.plans import runs as R
    from tarnwork.plans import vectors as V

    sf = "/root/testdata/sf0.001"
    e = {x["vec_id"]: np.array(x["embedding"], np.float64) for x in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    donor, base = {k: v[:40] for k, v in e.items()}, {k: v[40:64] for k, v in e.items()}
    anchors = sorted(k for k in e if k % 3)
    a = np.stack([donor[k] / np.linalg.norm(donor[k]) for k in anchors])
    made, cos = {}, []
    for k in e:
        if k % 3 == 0:
            t = donor[k] / np.linalg.norm(donor[k])
            near = np.lexsort((anchors, -np.round(a @ t, 9)))[:32]
            left, chosen = t, []
            for _ in range(6):
                c = np.abs(a[near] @ left)
                c[chosen] = -1
                chosen.append(int(c.argmax()))
                w = np.linalg.lstsq(a[near][chosen].T, t, rcond=None)[0]
                left = t - w @ a[near][chosen]
            made[k] = np.linalg.norm(sum(x * base[anchors[near[i]]] for x, i in zip(w, chosen)))
            cos.append((t - left) @ t / np.linalg.norm(t - left))
    got = {x["id"]: x["norm"] for x in V.Q["omp_transfer"](spark, sf).collect()}
    assert set(got) == set(made) and all(abs(got[k] - made[k]) < 1e-5 for k in made)
    r = V.Q["omp_reconstruction"](spark, sf).first()
    assert r["n"] == len(cos) and r["mean_cosine"] == pytest.approx(np.mean(cos), abs=1e-4)

    t = {tuple(x)[:3]: (x["t"], x["df"]) for x in R.Q["welch_t"](spark, sf).collect()}
    for x in R.Q["welch_p"](spark, sf).collect():
        v, n = t[tuple(x)[:3]]
        if v is None:
            assert x["p"] is None
            continue
        grid = np.linspace(0, abs(v), 200_001)
        pdf = np.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + grid**2 / n) ** (-(n + 1) / 2)
        assert x["p"] == pytest.approx(1 - 2 * np.trapezoid(pdf, grid), abs=2e-5)
    cells = {}
    for x in R.runs(spark, sf).filter("escaped").orderBy("seed").collect():
        cells.setdefault((x["base"], x["condition"]), []).append(x["f1"])
    for x in R.Q["bootstrap_ci_pcg64"](spark, sf).collect():
        v = np.array(cells[(x["base"], x["condition"])])
        want = (v[0], v[0]) if len(v) == 1 else np.quantile(np.random.default_rng(0).choice(v, size=(2000, len(v)), replace=True).mean(axis=1), [0.025, 0.975])
        assert (x["lo"], x["hi"]) == pytest.approx(tuple(want))


def test_nearest_in_blocks(spark, monkeypatch):
    """Beyond the bound of anchors the blocks give what one matrix gives, ties and repeated ids too."""
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (90, 6)).astype(float)
    frame = lambda a, b: spark.createDataFrame([(i, v[i].tolist()) for i in range(a, b)], "id long, vec array<double>")
    targets, anchors = frame(0, 30).unionByName(frame(4, 5)), frame(30, 90)
    every = lambda: (sorted(map(tuple, vectors.cosine_topk(targets, anchors, 5).collect())), sorted(map(tuple, vectors.omp_weights(targets, anchors, 3, 8).collect())))
    top, weights = every()
    monkeypatch.setattr(vectors, "MOST_BYTES", 10)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "SLICE", 4)
    top_b, weights_b = every()
    assert len(top) == 31 * 5 and [x[:3] for x in top_b] == [x[:3] for x in top] and np.allclose([x[3] for x in top_b], [x[3] for x in top])
    assert [x[:2] for x in weights_b] == [x[:2] for x in weights] and np.allclose([x[2:] for x in weights_b], [x[2:] for x in weights])


def test_alpha_overlap_is_not_capped(spark, tmp_path):
    from tarnwork.plans import corpus

    rows = [(2 * i + k, lang, "abc" if i < 2050 else "xyz") for i in range(2100) for k, lang in enumerate(("fr", "es"))]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(corpus.Q[q](spark, str(tmp_path)).first())[1:4] for q in ("type_overlap_alpha", "type_overlap")] == [(2, 2, 2), (1, 1, 1)]


def test_lookup_fertility_and_accents(spark):
    rows = [("a", "şəkər ev ev 12", 0), ("a", None, 1), ("b", "sekar ev", 2), (None, "ev", 3), ("c", "", 4)]
    counts = corpus.word_counts(spark.createDataFrame(rows, "lang string, text string, lang2 int"), "lang")
    assert {(r["lang"], r["word"]): r["n"] for r in counts.collect()} == {("a", "şəkər"): 1, ("a", "ev"): 2, ("a", "12"): 1, ("b", "sekar"): 1, ("b", "ev"): 1, (None, "ev"): 1}
    vocab = corpus.common_words(counts, 2)
    assert [r["word"] for r in vocab.collect()] == ["ev"]
    assert {r["lang"]: r["micro"] for r in corpus.lookup_fertility(counts, vocab, "lang").collect()} == {"a": 2.25, "b": 3.0, None: 1.0}

    def verdicts(tokens, plain, stripped):
        v = spark.createDataFrame([(t,) for t in tokens], "word string")
        f = lambda x: spark.createDataFrame(x, "lang string, micro double")
        got = corpus.accent_confound(f(plain), f(stripped), v, "lang", ["ş", "ç"], ["ə"], ["ı"], 2).collect()
        return {r["lang"]: (r["delta"], r["worse"], r["n_lost"], r["n_apart"], r["n_kept"], r["apart_rare"], r["verdict"]) for r in got}

    two = [("az", 3.2), ("tr", 1.8)]
    assert verdicts(["ə", "sa", "qı"], two, [("az", 3.0), ("tr", 1.8)]) == {"az": (0.2, True, 0, 1, 1, True, "GONE"), "tr": (0.0, False, 0, 1, 1, True, "HELPS")}
    assert verdicts(["şəç", "ə", "bə"], two, [("az", 3.0), ("tr", 1.9)]) == {"az": (0.2, True, 2, 3, 0, False, "MIXED"), "tr": (-0.1, False, 2, 3, 0, False, "HELPS")}
    assert verdicts([], [], []) == {}


def test_guess_over_a_column_of_sizes(spark):
    lines = spark.createDataFrame([(2.0, 4, 8, 10, 1, 50), (2.0, 4, 8, 10, 0, 50)], "nats double, masked long, tokens long, chars long, correct long, v long")
    assert corpus.bits_per_char(lines, "v").collect() == corpus.bits_per_char(lines, 50).collect()
    assert corpus.bits_per_char(lines, "v").first()["over_random"] == 6.25


def test_cross_base(spark):
    """Changes measured on another artefact are withheld; the worse base is corroborated by its norms only if another one is sound."""
    rows = [("b1", "t", 900, 100, "t", 0.5, 1.4, False, 0.9), ("b2", "t", 800, 300, "t", -0.2, 1.0, True, 0.7), ("b3", "t", 10, 0, "old", -3.0, 1.0, True, 0.99)]
    df = spark.createDataFrame(rows, "base string, tag string, n_anchor long, n_unfamiliar long, measured_tag string, delta_bpc double, norm_ratio double, healthy boolean, mean_cosine double")
    got = {r["base"]: (r["anchor_share_pct"], r["delta_bpc"], r["withheld"], r["worse"], r["corroborated"]) for r in vectors.cross_base(df).collect()}
    assert got == {"b1": (90.0, 0.5, False, True, True), "b2": (72.73, -0.2, False, False, None), "b3": (100.0, None, True, False, None)}
