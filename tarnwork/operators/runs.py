"""Training histories: selection, escape, terminal state, verdicts, metrics, schema rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run escapes when its score rises above this.
ESCAPE = 0.40


def summarise(steps: DataFrame, keys: list[str], escape: float = ESCAPE, target_steps: int | None = None) -> DataFrame:
    """(keys, step, f1) -> of each run the selected step (best score, lowest step), escape and its first step, the terminal row, and a verdict."""
    over = F.col("f1") > F.lit(float(escape))
    g = steps.groupBy(*keys).agg(
        F.count("*").alias("n_steps"), F.max_by(F.struct("step", "f1"), F.struct(F.col("f1"), (-F.col("step")).alias("s"))).alias("best"),
        F.min(F.when(over, F.col("step"))).alias("first_escape"), F.max_by(F.struct("step", "f1"), F.col("step")).alias("last"),
    )
    escaped = F.col("first_escape").isNotNull()
    done = F.lit(True) if target_steps is None else F.col("n_steps") >= target_steps
    return g.select(
        *keys, "n_steps", F.col("best.step").alias("selected_step"), F.col("best.f1").alias("selected_f1"), escaped.alias("escaped"), "first_escape", F.col("last.step").alias("terminal_step"), F.col("last.f1").alias("terminal_f1"),
        (escaped & (F.col("last.f1") <= F.lit(float(escape)))).alias("collapsed"), F.when(escaped, "ESCAPED").when(done, "NOT_ESCAPED").otherwise("UNRESOLVED").alias("verdict"),
    )


def epochs(n: Column, batch: int, accum: int, steps: Column) -> tuple[Column, Column]:
    per = F.ceil(n.cast("double") / (batch * accum))
    return per.cast("long"), F.round(steps / F.greatest(per, F.lit(1)), 4)


def merge_history(evals: DataFrame, losses: DataFrame, keys: list[str]) -> DataFrame:
    """Evaluation rows with the training loss of exactly that step, or null."""
    return evals.join(losses.select(*keys, "step", "train_loss"), [*keys, "step"], "left")


def degenerate(f1: Column, counts: Column) -> Column:
    """Null without a score; else a low score or a single class predicted."""
    return F.when(f1.isNotNull(), (f1 <= ESCAPE) | (F.size(F.filter(F.map_values(counts), lambda v: v > 0)) <= 1))


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.groupBy(gold, pred).agg(F.count("*").alias("n"))


def class_scores(conf: DataFrame, gold: str, pred: str) -> DataFrame:
    """Of each class, gold or predicted: support, precision, recall, F1, zero where undefined."""
    long = conf.select(F.explode(F.array(F.struct(F.col(gold).alias("c"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("c"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), "n", (F.col(gold) == F.col(pred)).alias("hit"))
    g = long.groupBy(F.col("x.c").alias("class")).agg(F.sum(F.col("x.g") * F.col("n")).alias("support"), F.sum(F.col("x.p") * F.col("n")).alias("predicted"), F.sum(F.when(F.col("hit"), F.col("x.g") * F.col("n")).otherwise(0)).alias("tp"))
    p, r = F.col("tp") / F.greatest("predicted", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    return g.select("class", "support", "predicted", "tp", p.alias("precision"), r.alias("recall"), (2.0 * F.col("tp") / F.greatest(F.col("support") + F.col("predicted"), F.lit(1))).alias("f1"))


def macro_f1(conf: DataFrame, gold: str, pred: str) -> DataFrame:
    s = class_scores(conf, gold, pred)
    return s.agg(F.round(F.sum("tp") / F.greatest(F.sum("support"), F.lit(1)), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.greatest(F.sum("support"), F.lit(1)), 6).alias("weighted_f1"))


def matched_delta(df: DataFrame) -> DataFrame:
    """(val, test, terminal) of each run -> test less validation, selected less terminal."""
    return df.withColumn("delta", F.round(F.col("test") - F.col("val"), 6)).withColumn("drift", F.round(F.col("val") - F.col("terminal"), 6))


def violations(runs: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Of each rule, the number of runs that break it or can't be judged by it."""
    long = runs.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.coalesce(~v, F.lit(True)).alias("bad")) for k, v in rules.items()))).alias("x"))
    return long.groupBy(F.col("x.rule").alias("rule")).agg(F.count_if("x.bad").alias("n"))


def history_rules() -> dict[str, Column]:
    """Rules of a run record with history: array<struct<step, f1>> and its summary."""
    h = F.col("history")
    return {
        "has_steps": F.size(h) > 0,
        "steps_increase": F.forall(F.sequence(F.lit(0), F.greatest(F.size(h) - 2, F.lit(0))), lambda i: F.coalesce(F.get(h, i)["step"] < F.get(h, i + 1)["step"], F.lit(True))),
        "selected_is_max": F.col("selected_f1") == F.array_max(F.transform(h, lambda x: x["f1"])),
        "escape_matches": F.col("escaped") == F.exists(h, lambda x: x["f1"] > F.col("threshold")),
        "terminal_is_last": F.col("terminal_step") == F.array_max(F.transform(h, lambda x: x["step"])),
        "first_escape_in_history": F.col("first_escape").isNull() | F.array_contains(F.transform(h, lambda x: x["step"]), F.col("first_escape")),
    }


#: Keys that a run record, its settings and each row of its history must have (fixed names), and its verdicts and ways of selection.
RECORD_KEYS = [
    "run_result_schema_version", "escaped", "escape_step", "selected_step", "selected_validation_macro_f1", "terminal_step", "terminal_validation_macro_f1", "escaped_but_terminal_collapsed",
    "test_comparison", "max_steps", "steps_per_epoch", "effective_epochs", "step_history", "per_run_verdict", "eval_split", "training_settings",
]
SETTINGS_KEYS = ["max_steps", "eval_every_steps", "metric_for_best_model", "early_stopping_patience", "load_best_model_at_end"]
HISTORY_KEYS = ["step", "eval_loss", "eval_macro_f1", "validation_prediction_counts"]
VERDICTS = ["ESCAPED", "NOT_ESCAPED", "UNRESOLVED"]
SELECTIONS = ["best_validation_checkpoint", "final_step"]


def record_rules(version: int = 4) -> dict[str, Column]:
    """Rules of a run record parsed by ``sources.io.parse_runs`` (value, r); all must hold before it is written. One that can't be judged counts as broken."""
    def has(keys: Column, needed: list[str]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, needed)), F.coalesce(keys, F.array().cast("array<string>")))) == 0

    h, t = F.col("r.step_history"), F.col("r.test_comparison")
    last = F.get(h, F.size(h) - 1)
    steps = F.transform(h, lambda x: x["step"])
    over = F.filter(h, lambda x: x["eval_macro_f1"] > ESCAPE)
    first_over = F.array_min(F.transform(over, lambda x: x["step"]))
    classes = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("r.n_labels") - 1), lambda i: i.cast("string")))
    best = t["selection"] == SELECTIONS[0]
    step = F.when(best, F.col("r.selected_step")).otherwise(F.col("r.terminal_step"))
    score = F.when(best, F.col("r.selected_validation_macro_f1")).otherwise(F.col("r.terminal_validation_macro_f1"))
    tested = F.col("r.eval_split") == "test"
    rows = F.from_json(F.get_json_object("value", "$.step_history"), "array<map<string,string>>")
    return {
        "has_keys": has(F.json_object_keys("value"), RECORD_KEYS),
        "has_version": F.col("r.run_result_schema_version") == version,
        "has_settings": has(F.json_object_keys(F.get_json_object("value", "$.training_settings")), SETTINGS_KEYS),
        "has_escaped": F.col("r.escaped").isNotNull(),
        "has_steps": F.size(h) > 0,
        "verdict_known": F.col("r.per_run_verdict").isin(VERDICTS),
        "history_has_keys": F.forall(rows, lambda x: has(F.map_keys(x), HISTORY_KEYS)),
        "steps_increase": F.forall(F.transform(h, lambda x, i: F.struct(x["step"].alias("s"), F.coalesce(F.get(steps, i - 1), F.lit(-1)).alias("p"))), lambda x: x["s"] > x["p"]),
        "classes_complete": F.forall(h, lambda x: F.array_sort(F.map_keys(x["validation_prediction_counts"])) == classes),
        "counts_whole": F.forall(h, lambda x: F.forall(F.map_values(x["validation_prediction_counts"]), lambda v: (v >= 0) & (v == F.floor(v)))),
        "selected_in_history": F.array_contains(steps, F.col("r.selected_step")),
        "escaped_matches": F.col("r.escaped") == (F.size(over) > 0),
        "escape_step_matches": F.col("r.escape_step").eqNullSafe(first_over),
        "terminal_step_is_last": F.col("r.terminal_step") == last["step"],
        "terminal_score_is_last": F.col("r.terminal_validation_macro_f1") == last["eval_macro_f1"],
        "collapse_matches": F.col("r.escaped_but_terminal_collapsed") == (F.col("r.escaped") & (last["eval_macro_f1"] <= ESCAPE)),
        "comparison_split_matches": t["eval_split"] == F.col("r.eval_split"),
        "selection_known": t["selection"].isin(SELECTIONS),
        "restored_verified": ~best | t["restored_validation_macro_f1"].isNotNull(),
        "restored_matches": ~best | (F.abs(t["restored_validation_macro_f1"] - F.col("r.selected_validation_macro_f1")) <= 1e-4),
        "matched_step": t["matched_step"] == step,
        "matched_score": t["validation_macro_f1_matched"] == score,
        "test_score_where_tested": ~tested | t["test_macro_f1"].isNotNull(),
        "matched_delta": ~tested | (t["delta_test_minus_validation_matched"] == F.round(t["test_macro_f1"] - score, 6)),
        "no_test_score_elsewhere": tested | t["test_macro_f1"].isNull(),
    }
