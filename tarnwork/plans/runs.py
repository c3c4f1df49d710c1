"""Queries of run records and statistics, each with its SQL. A run is a user and an event type; its steps are the events, a value being the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.operators import runs as R
from tarnwork.operators import prep as P
from tarnwork.operators import stats as S
from tarnwork.operators import training as L
from tarnwork.plans.common import rated, table
from tarnwork.sources import io

Q: dict = {}
O: dict[str, str] = {}

ESC = 140.0


def _mean(x: str, where: str = "") -> str:
    """SQL of a mean from an exact sum."""
    f = f" FILTER (WHERE {where})" if where else ""
    return f"(cast(sum(cast({x} AS decimal(28,10))){f} AS double) / count({x}){f})"


def _round(x: str, places: int = 4) -> str:
    """SQL that rounds by the decimal places that a double shows, half away from zero."""
    return f"cast(round(cast({x} AS decimal(28,10)), {places}) AS double)"


KEYS = ["base", "condition", "seed"]


def steps(s, d):
    return table(s, d, "events").select((F.col("user_id") % 2).cast("string").alias("base"), F.col("event_type").alias("condition"), F.col("user_id").cast("long").alias("seed"), F.col("event_id").cast("long").alias("step"), F.col("value").cast("double").alias("f1"))


def runs(s, d):
    return R.summarise(steps(s, d), KEYS, ESC, 6).withColumn("f1", F.col("selected_f1"))


_S = "steps AS (SELECT cast(user_id % 2 AS varchar) AS base, event_type AS condition, cast(user_id AS bigint) AS seed, cast(event_id AS bigint) AS step, cast(value AS double) AS f1 FROM events)"
_R = f"""{_S}, runs AS (SELECT base, condition, seed, count(*) AS n_steps, arg_max(step, {{'f': f1, 's': -step}}) AS selected_step, max(f1) AS selected_f1, bool_or(f1 > 140) AS escaped, min(step) FILTER (WHERE f1 > 140) AS first_escape, max(step) AS terminal_step, arg_max(f1, step) AS terminal_f1 FROM steps GROUP BY ALL),
rr AS (SELECT *, escaped AND terminal_f1 <= 140 AS collapsed, CASE WHEN escaped THEN 'ESCAPED' WHEN n_steps >= 6 THEN 'NOT_ESCAPED' ELSE 'UNRESOLVED' END AS verdict, selected_f1 AS f1 FROM runs)"""
Q["run_escape"] = lambda s, d: runs(s, d).select(*KEYS, "escaped", "first_escape")
O["run_escape"] = f"WITH {_R} SELECT base, condition, seed, escaped, first_escape FROM rr"
Q["run_select"] = lambda s, d: runs(s, d).select(*KEYS, "selected_step", "selected_f1")
O["run_select"] = f"WITH {_R} SELECT base, condition, seed, selected_step, selected_f1 FROM rr"
Q["run_terminal"] = lambda s, d: runs(s, d).select(*KEYS, "terminal_step", "terminal_f1", "collapsed")
O["run_terminal"] = f"WITH {_R} SELECT base, condition, seed, terminal_step, terminal_f1, collapsed FROM rr"
Q["run_verdict"] = lambda s, d: runs(s, d).select(*KEYS, "n_steps", "verdict")
O["run_verdict"] = f"WITH {_R} SELECT base, condition, seed, n_steps, verdict FROM rr"
Q["run_schema_violations"] = lambda s, d: R.violations(runs(s, d).join(steps(s, d).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("step", F.col("f1")))).alias("history")), KEYS).withColumn("threshold", F.lit(ESC)), R.history_rules())
O["run_schema_violations"] = "SELECT unnest(['has_steps', 'steps_increase', 'selected_is_max', 'escape_matches', 'terminal_is_last', 'first_escape_in_history']) AS rule, cast(0 AS bigint) AS n"
Q["epoch_arithmetic"] = lambda s, d: (lambda e: runs(s, d).select(*KEYS, e[0].alias("steps_per_epoch"), e[1].alias("effective_epochs")))(R.epochs(F.col("seed"), 32, 2, F.col("n_steps")))
O["epoch_arithmetic"] = f"WITH {_R} SELECT base, condition, seed, cast(ceil(seed / cast(64 AS double)) AS bigint) AS steps_per_epoch, round(n_steps / greatest(ceil(seed / cast(64 AS double)), 1), 4) AS effective_epochs FROM rr"
Q["history_merge"] = lambda s, d: R.merge_history(steps(s, d), steps(s, d).filter("f1 > 50").withColumn("train_loss", F.round(F.col("f1") / 10, 4)), KEYS).select(*KEYS, "step", "f1", "train_loss")
O["history_merge"] = f"WITH {_S} SELECT base, condition, seed, step, f1, CASE WHEN f1 > 50 THEN round(f1 / 10, 4) END AS train_loss FROM steps"


def records(s, d):
    """The runs as texts of run records, scores scaled to 0-1; those of the first base are of an older version."""
    score = lambda c: F.round(F.col(c) / 400, 6)
    pairs_ = steps(s, d).withColumn("s", score("f1")).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("step", "s"))).alias("h"))
    history = F.transform("h", lambda x: F.struct(x["step"].alias("step"), F.lit(0.5).alias("eval_loss"), x["s"].alias("eval_macro_f1"), F.create_map(F.lit("0"), F.lit(3), F.lit("1"), F.lit(4)).alias("validation_prediction_counts")))
    r = R.summarise(steps(s, d).withColumn("f1", score("f1")), KEYS).join(pairs_, KEYS)
    val = F.col("selected_f1")
    comparison = F.struct(F.lit("test").alias("eval_split"), F.lit("best_validation_checkpoint").alias("selection"), F.col("selected_step").alias("matched_step"), val.alias("validation_macro_f1_matched"), val.alias("restored_validation_macro_f1"), F.round(val * 0.9, 6).alias("test_macro_f1"), F.round(F.round(val * 0.9, 6) - val, 6).alias("delta_test_minus_validation_matched"))
    settings = F.struct(F.lit(100).alias("max_steps"), F.lit(1).alias("eval_every_steps"), F.lit("f1").alias("metric_for_best_model"), F.lit(3).alias("early_stopping_patience"), F.lit(True).alias("load_best_model_at_end"))
    record = F.struct(
        F.when(F.col("base") == "0", 3).otherwise(4).alias("run_result_schema_version"), F.lit(2).alias("n_labels"), "base", "condition", F.lit(1).alias("condition_id"), F.lit("t").alias("tokenizer"), F.lit("none").alias("turkish"), F.lit(500).alias("train_size"), "seed", "escaped", F.col("first_escape").alias("escape_step"), "selected_step",
        val.alias("selected_validation_macro_f1"), "terminal_step", F.col("terminal_f1").alias("terminal_validation_macro_f1"), F.col("collapsed").alias("escaped_but_terminal_collapsed"), F.lit("test").alias("eval_split"), F.col("verdict").alias("per_run_verdict"), F.lit(100).alias("max_steps"), F.lit(63).alias("steps_per_epoch"), F.lit(1.5).alias("effective_epochs"),
        comparison.alias("test_comparison"), history.alias("step_history"), settings.alias("training_settings"),
    )
    return r.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"), F.concat_ws("/", *KEYS).alias("source_path"))


_RS = f"""{_S}, sc AS (SELECT base, condition, seed, step, round(f1 / 400, 6) AS f1 FROM steps), sr AS (SELECT base, condition, seed, count(*) AS n_steps, arg_max(step, {{'f': f1, 's': -step}}) AS selected_step, max(f1) AS selected_f1, bool_or(f1 > 0.4) AS escaped, min(step) FILTER (WHERE f1 > 0.4) AS escape_step, max(step) AS terminal_step, arg_max(f1, step) AS terminal_f1 FROM sc GROUP BY ALL)"""
Q["run_scan"] = lambda s, d: io.flatten_runs(io.parse_runs(records(s, d)))
O["run_scan"] = f"""WITH {_RS} SELECT base, 'unknown' AS base_role, condition, cast(1 AS bigint) AS condition_id, 't' AS tokenizer, 'none' AS turkish, cast(500 AS bigint) AS train_size, seed, escaped, escape_step, selected_step, selected_f1 AS selected_validation_macro_f1, terminal_step, terminal_f1 AS terminal_validation_macro_f1,
escaped AND terminal_f1 <= 0.4 AS escaped_but_terminal_collapsed, 'test' AS eval_split, round(selected_f1 * cast(0.9 AS double), 6) AS test_macro_f1, cast(NULL AS double) AS tr_stage_macro_f1, cast(NULL AS boolean) AS tr_stage_degenerate, round(round(selected_f1 * cast(0.9 AS double), 6) - selected_f1, 6) AS delta_test_minus_validation_matched,
cast(100 AS bigint) AS max_steps, cast(63 AS bigint) AS steps_per_epoch, cast(1.5 AS double) AS effective_epochs, cast(NULL AS double) AS runtime_sec, base || '/' || condition || '/' || seed AS source_path FROM sr WHERE base <> '0'"""
Q["run_scan_skipped"] = lambda s, d: io.skipped_runs(io.parse_runs(records(s, d)))
O["run_scan_skipped"] = f"WITH {_RS} SELECT 3 AS version, count(*) AS n FROM sr WHERE base = '0' HAVING count(*) > 0"
RULES = [
    "has_keys", "has_version", "has_settings", "has_escaped", "has_steps", "verdict_known", "history_has_keys", "steps_increase", "classes_complete", "counts_whole", "selected_in_history", "escaped_matches", "escape_step_matches",
    "terminal_step_is_last", "terminal_score_is_last", "collapse_matches", "comparison_split_matches", "selection_known", "restored_verified", "restored_matches", "matched_step", "matched_score", "test_score_where_tested", "matched_delta", "no_test_score_elsewhere",
]


def broken(s, d):
    """Parsed records of which some seeds' break rules: no known verdict, another last step, a state not restored, another split, a score that the history lacks."""
    r, odd = F.col("r"), lambda k, m: F.col("r.seed") % k == m
    r = r.withField("per_run_verdict", F.when(odd(7, 3), "MAYBE").otherwise(F.col("r.per_run_verdict"))).withField("terminal_step", F.col("r.terminal_step") + F.when(odd(5, 2), 1).otherwise(0))
    r = r.withField("test_comparison.restored_validation_macro_f1", F.when(~odd(11, 4), F.col("r.test_comparison.restored_validation_macro_f1"))).withField("test_comparison.eval_split", F.when(odd(13, 6), "val").otherwise(F.col("r.test_comparison.eval_split")))
    return io.parse_runs(records(s, d)).withColumn("r", r.withField("escape_step", F.when(odd(3, 1) & F.col("r.escaped"), F.lit(-1).cast("long")).otherwise(F.col("r.escape_step"))))


Q["run_record_violations"] = lambda s, d: R.violations(broken(s, d), R.record_rules())
O["run_record_violations"] = f"""WITH {_RS} SELECT rule, (SELECT count(*) FILTER (WHERE CASE rule WHEN 'has_version' THEN base = '0' WHEN 'verdict_known' THEN seed % 7 = 3 WHEN 'terminal_step_is_last' THEN seed % 5 = 2 WHEN 'restored_verified' THEN seed % 11 = 4 WHEN 'restored_matches' THEN seed % 11 = 4
WHEN 'comparison_split_matches' THEN seed % 13 = 6 WHEN 'escape_step_matches' THEN seed % 3 = 1 AND escaped ELSE false END) FROM sr) AS n FROM (SELECT unnest({RULES!r}) AS rule)"""
Q["matched_delta"] = lambda s, d: R.matched_delta(runs(s, d).select(*KEYS, F.col("selected_f1").alias("val"), (F.col("selected_f1") * 0.9).alias("test"), F.col("terminal_f1").alias("terminal"))).select(*KEYS, F.round("delta", 4).alias("delta"), F.round("drift", 4).alias("drift"))
O["matched_delta"] = f"WITH {_R} SELECT base, condition, seed, round(round(selected_f1 * cast(0.9 AS double) - selected_f1, 6), 4) AS delta, round(round(selected_f1 - terminal_f1, 6), 4) AS drift FROM rr"


def predicted(s, d):
    """A keyword rule as the predictor of quality."""
    return rated(s, d).select(F.col("label").cast("string").alias("gold"), F.when(F.col("text").contains("***") | F.col("text").contains("%%%"), "0").otherwise("1").alias("pred"))


_P = "p AS (SELECT cast(quality AS varchar) AS gold, CASE WHEN contains(text, '***') OR contains(text, '%%%') THEN '0' ELSE '1' END AS pred FROM documents JOIN labels USING (doc_id))"
Q["confusion"] = lambda s, d: R.confusion(predicted(s, d), "gold", "pred")
O["confusion"] = f"WITH {_P} SELECT gold, pred, count(*) AS n FROM p GROUP BY ALL"
Q["macro_f1"] = lambda s, d: R.macro_f1(R.confusion(predicted(s, d), "gold", "pred"), "gold", "pred")
O["macro_f1"] = f"""WITH {_P}, c AS (SELECT DISTINCT gold AS c FROM p UNION SELECT DISTINCT pred FROM p), s AS (SELECT c, (SELECT count(*) FROM p WHERE gold = c) AS g, (SELECT count(*) FROM p WHERE pred = c) AS q, (SELECT count(*) FROM p WHERE gold = c AND pred = c) AS t FROM c),
f AS (SELECT *, cast(2 AS double) * t / greatest(g + q, 1) AS f FROM s) SELECT round(cast(sum(t) AS double) / sum(g), 6) AS accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * g) / sum(g), 6) AS weighted_f1 FROM f"""

CELL = ["base", "condition"]


def grid(s, d):
    c = table(s, d, "events").select(F.col("event_type").alias("condition")).distinct().unionByName(s.createDataFrame([("never_run",)], "condition string"))
    return c.join(F.broadcast(s.createDataFrame([("0",), ("1",)], "base string")))


_C = f"""{_R}, gr AS (SELECT base, condition FROM (SELECT unnest(['0', '1']) AS base), (SELECT DISTINCT event_type AS condition FROM events UNION ALL SELECT 'never_run')),
ag AS (SELECT base, condition, count(*) AS n, count(*) FILTER (WHERE escaped) AS k, {_mean('f1', 'escaped')} AS c, {_mean('f1')} AS a, count(*) FILTER (WHERE escaped AND NOT collapsed) AS sustained, var_samp(f1) FILTER (WHERE escaped) AS v FROM rr GROUP BY ALL),
cl AS (SELECT base, condition, coalesce(n, 0) AS n, coalesce(k, 0) AS k, c, a, coalesce(sustained, 0) AS sustained, v FROM gr LEFT JOIN ag USING (base, condition))"""


def cells(s, d):
    return S.cell_summary(grid(s, d), runs(s, d), CELL)


Q["cell_summary"] = cells
O["cell_summary"] = f"""WITH {_C} SELECT base, condition, CASE WHEN n > 0 THEN 'MEASURED' ELSE 'NOT MEASURED' END AS status, n, k AS n_escaped, CASE WHEN n > 0 THEN round(k / cast(n AS double), 4) END AS escape_rate, CASE WHEN n > 0 THEN k || '/' || n END AS escape_count,
{_round('c')} AS conditional_f1, {_round('a')} AS all_seed_f1, {_round('c - a')} AS difference, sustained FROM cl"""


def _wilson(s, d):
    lo, hi = S.wilson(F.col("n_escaped"), F.col("n"))
    return cells(s, d).select(*CELL, F.round(lo, 4).alias("lo"), F.round(hi, 4).alias("hi"))


Q["wilson"] = _wilson
O["wilson"] = f"""WITH {_C}, z AS (SELECT *, k / cast(greatest(n, 1) AS double) AS p, cast(greatest(n, 1) AS double) AS m, cast({S.Z} AS double) AS z FROM cl)
SELECT base, condition, CASE WHEN n > 0 THEN round(greatest(0, (p + z*z/(2*m)) / (1 + z*z/m) - z / (1 + z*z/m) * sqrt(p*(1-p)/m + z*z/(4*m*m))), 4) END AS lo, CASE WHEN n > 0 THEN round(least(1, (p + z*z/(2*m)) / (1 + z*z/m) + z / (1 + z*z/m) * sqrt(p*(1-p)/m + z*z/(4*m*m))), 4) END AS hi FROM z"""
Q["seed_noise"] = lambda s, d: S.seed_noise(runs(s, d), CELL)
O["seed_noise"] = f"WITH {_R} SELECT base, condition, count(*) AS n, {_round(_mean('f1'))} AS mean, round(stddev_samp(f1), 4) AS sd FROM rr WHERE escaped GROUP BY ALL"


def contrasts(s, d):
    return S.effect(S.pairs(S.moments(runs(s, d), CELL), ["base"], "condition"))


_W = f"""{_R}, mo AS (SELECT base, condition, count(*) AS n, {_mean('f1')} AS mean, var_samp(f1) AS var FROM rr WHERE escaped GROUP BY ALL), pr AS (SELECT a.base, a.condition AS c1, b.condition AS c2, a.n AS an, b.n AS bn, a.mean AS am, b.mean AS bm, a.var AS av, b.var AS bv FROM mo a JOIN mo b ON a.base = b.base AND a.condition < b.condition),
ef AS (SELECT *, an >= 2 AND bn >= 2 AS ok, bm - am AS diff, av / an + bv / bn AS se, sqrt(((an - 1) * av + (bn - 1) * bv) / greatest(an + bn - 2, 1)) AS pooled, sqrt((av + bv) / 2) AS noise FROM pr)"""
Q["pair_contrasts"] = lambda s, d: contrasts(s, d).select("base", "c1", "c2", "status", "diff", "diff_over_noise")
O["pair_contrasts"] = f"WITH {_W} SELECT base, c1, c2, CASE WHEN ok THEN 'MEASURED' ELSE 'NOT MEASURED' END AS status, CASE WHEN ok THEN {_round('diff')} END AS diff, CASE WHEN ok AND se > 0 AND noise > 0 THEN {_round('abs(diff) / noise', 2)} END AS diff_over_noise FROM ef"
Q["cohens_d"] = lambda s, d: contrasts(s, d).select("base", "c1", "c2", "cohens_d")
O["cohens_d"] = f"WITH {_W} SELECT base, c1, c2, CASE WHEN ok AND se > 0 AND pooled > 0 THEN {_round('diff / pooled', 3)} END AS cohens_d FROM ef"
Q["welch_t"] = lambda s, d: contrasts(s, d).select("base", "c1", "c2", "t", "df")
O["welch_t"] = f"WITH {_W} SELECT base, c1, c2, CASE WHEN ok AND se > 0 THEN round(diff / sqrt(se), 4) END AS t, CASE WHEN ok AND se > 0 THEN round(se * se / ((av/an)*(av/an) / greatest(an - 1, 1) + (bv/bn)*(bv/bn) / greatest(bn - 1, 1)), 3) END AS df FROM ef"
Q["arm_means"] = lambda s, d: contrasts(s, d).select("base", "c1", "c2", S.places("a_mean", 4).alias("mean_baseline"), S.places("b_mean", 4).alias("mean_comparison"), "seed_std_pooled")
O["arm_means"] = f"WITH {_W} SELECT base, c1, c2, {_round('am')} AS mean_baseline, {_round('bm')} AS mean_comparison, CASE WHEN ok THEN round(noise, 4) END AS seed_std_pooled FROM ef"
Q["paired_p"] = lambda s, d: S.paired_p(S.paired(runs(s, d), ["base"], "condition", "seed")).select("base", "c1", "c2", "n", "p", "significant")
Q["welch_p"] = lambda s, d: contrasts(s, d).select("base", "c1", "c2", F.round(S.student_p_column("t", "df"), 5).alias("p"))
_PT = f"SELECT a.base, a.condition AS c1, b.condition AS c2, count(*) AS n, {_mean('b.f1 - a.f1')} AS m, stddev_samp(b.f1 - a.f1) AS s, min(sign(b.f1 - a.f1)) = max(sign(b.f1 - a.f1)) AS same_sign FROM {{0}} a JOIN {{0}} b ON a.base = b.base AND a.seed = b.seed AND a.condition < b.condition GROUP BY ALL"
_PO = f"SELECT base, c1, c2, n, CASE WHEN n >= 2 THEN 'MEASURED' ELSE 'NOT MEASURED' END AS status, CASE WHEN n >= 2 THEN {_round('m')} END AS mean_diff, CASE WHEN n >= 2 AND s > 0 THEN round(m / (s / sqrt(n)), 4) END AS t, CASE WHEN n >= 2 THEN same_sign END AS same_sign FROM g"
Q["paired_t"] = lambda s, d: S.paired(runs(s, d), ["base"], "condition", "seed")
O["paired_t"] = f"WITH {_R}, e AS (SELECT * FROM rr WHERE escaped), g AS ({_PT.format('e')}) {_PO}"
Q["paired_t_all"] = lambda s, d: S.paired(runs(s, d), ["base"], "condition", "seed", False)
O["paired_t_all"] = f"WITH {_R}, g AS ({_PT.format('rr')}) {_PO}"


def fishers(s, d):
    c = runs(s, d).groupBy(*CELL).agg(F.count_if("escaped").alias("k"), F.count("*").alias("n"))
    p = S.pairs(c, ["base"], "condition")
    return S.fisher(p.select("base", "c1", "c2", F.col("b_k").alias("a"), (F.col("b_n") - F.col("b_k")).alias("b"), F.col("a_k").alias("c"), (F.col("a_n") - F.col("a_k")).alias("d")), ["base", "c1", "c2"])


_FC = """lf AS (SELECT i, sum(ln(greatest(i, 1))) OVER (ORDER BY i) AS lf FROM range(0, 200001) t(i)),
fx AS (SELECT t.*, unnest(range(greatest(0, a + c - (c + d)), least(a + c, a + b) + 1)) AS x FROM ft t),
fw AS (SELECT fx.*, -(l1.lf + l2.lf + l3.lf + l4.lf) AS w FROM fx JOIN lf l1 ON l1.i = x JOIN lf l2 ON l2.i = a + b - x JOIN lf l3 ON l3.i = a + c - x JOIN lf l4 ON l4.i = c + d - a - c + x)"""


def _fisher(keys: str) -> str:
    return f"""{_FC}, fq AS (SELECT *, exp(w - max(w) OVER (PARTITION BY {keys})) AS q FROM fw), fo AS (SELECT *, max(q) FILTER (WHERE x = a) OVER (PARTITION BY {keys}) AS obs FROM fq),
fr AS (SELECT {keys}, first(a) AS a, first(b) AS b, first(c) AS c, first(d) AS d, sum(q) FILTER (WHERE q <= obs * (1 + 1e-9)) / sum(q) AS p FROM fo GROUP BY {keys}),
fisher AS (SELECT {keys}, CASE WHEN b * c > 0 THEN round(a * d / cast(b * c AS double), 4) END AS odds_ratio, round(least(p, 1.0), 5) AS p, p < 0.05 AS significant FROM fr)"""


_FT = f"{_R}, fc AS (SELECT base, condition, count(*) FILTER (WHERE escaped) AS k, count(*) AS n FROM rr GROUP BY ALL), ft AS (SELECT a.base, a.condition AS c1, b.condition AS c2, b.k AS a, b.n - b.k AS b, a.k AS c, a.n - a.k AS d FROM fc a JOIN fc b ON a.base = b.base AND a.condition < b.condition)"
Q["fisher_escape"] = fishers
O["fisher_escape"] = f"WITH {_FT}, {_fisher('base, c1, c2')} SELECT * FROM fisher"
Q["holm"] = lambda s, d: S.holm(fishers(s, d), "p", ["base", "c1", "c2"]).select("base", "c1", "c2", "p", "p_holm", "survives")
O["holm"] = f"""WITH {_FT}, {_fisher('base, c1, c2')}, h AS (SELECT *, row_number() OVER (ORDER BY p, base, c1, c2) - 1 AS r, count(*) OVER () AS m FROM fisher), a AS (SELECT *, max(least(1.0, (m - r) * p)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS adj FROM h)
SELECT base, c1, c2, p, round(adj, 6) AS p_holm, adj < 0.05 AS survives FROM a"""
Q["cross_base"] = lambda s, d: S.difference_of_differences(cells(s, d), "base", "condition", ("0", "1"), ("click", "purchase"), ["escape_rate", "conditional_f1"])
O["cross_base"] = f"""WITH {_C}, v AS (SELECT base, condition, CASE WHEN n > 0 THEN round(k / cast(n AS double), 4) END AS e, {_round('c')} AS f FROM cl), x AS (SELECT max(e) FILTER (WHERE base = '0' AND condition = 'click') AS e00, max(e) FILTER (WHERE base = '0' AND condition = 'purchase') AS e01, max(e) FILTER (WHERE base = '1' AND condition = 'click') AS e10, max(e) FILTER (WHERE base = '1' AND condition = 'purchase') AS e11,
max(f) FILTER (WHERE base = '0' AND condition = 'click') AS f00, max(f) FILTER (WHERE base = '0' AND condition = 'purchase') AS f01, max(f) FILTER (WHERE base = '1' AND condition = 'click') AS f10, max(f) FILTER (WHERE base = '1' AND condition = 'purchase') AS f11 FROM v),
y AS (SELECT *, concat_ws(',', CASE WHEN e00 IS NULL THEN '0/click' END, CASE WHEN e01 IS NULL THEN '0/purchase' END, CASE WHEN e10 IS NULL THEN '1/click' END, CASE WHEN e11 IS NULL THEN '1/purchase' END) AS missing FROM x)
SELECT round((e01 - e00) - (e11 - e10), 4) AS escape_rate_did, round((f01 - f00) - (f11 - f10), 4) AS conditional_f1_did, missing, CASE WHEN missing = '' THEN 'MEASURED' ELSE 'NOT MEASURED' END AS status FROM y"""


def gates(s, d):
    c = cells(s, d)
    p = S.pairs(c.select("base", "condition", "n_escaped"), ["base"], "condition")
    return p.select("base", "c1", "c2", S.decision_gate(F.col("a_n_escaped"), F.col("b_n_escaped")).alias("gate"))


Q["decision_gates"] = gates
O["decision_gates"] = f"WITH {_C} SELECT a.base, a.condition AS c1, b.condition AS c2, CASE WHEN a.k = 0 AND b.k = 0 THEN 'STOP' WHEN b.k >= 3 AND a.k < 3 THEN 'RUN_STRONG' WHEN a.k >= 3 AND b.k >= 3 THEN 'RUN' ELSE 'ERRATIC' END AS gate FROM cl a JOIN cl b ON a.base = b.base AND a.condition < b.condition"


def pilot(s, d):
    c = cells(s, d)
    at = lambda b, x, v: F.max(F.when((F.col("base") == b) & (F.col("condition") == x), F.col(v)))
    g = c.agg(*(at(b, x, v).alias(f"{v[0]}{b}{k}") for v in ("n_escaped", "conditional_f1") for b in "01" for k, x in enumerate(("click", "purchase"))))
    return g.select(S.pilot_verdict(F.col("n00"), F.col("n01"), F.col("n10"), F.col("n11"), F.col("c01") - F.col("c00"), F.col("c11") - F.col("c10")).alias("verdict"))


Q["pilot_verdict"] = pilot
O["pilot_verdict"] = f"""WITH {_C}, g AS (SELECT max(k) FILTER (WHERE base = '0' AND condition = 'click') AS xb, max(k) FILTER (WHERE base = '0' AND condition = 'purchase') AS xt, max(k) FILTER (WHERE base = '1' AND condition = 'click') AS rb, max(k) FILTER (WHERE base = '1' AND condition = 'purchase') AS rt,
max(round(c, 4)) FILTER (WHERE base = '0' AND condition = 'purchase') - max(round(c, 4)) FILTER (WHERE base = '0' AND condition = 'click') AS gx, max(round(c, 4)) FILTER (WHERE base = '1' AND condition = 'purchase') - max(round(c, 4)) FILTER (WHERE base = '1' AND condition = 'click') AS gr FROM cl)
SELECT CASE WHEN xb + xt + rb + rt = 0 THEN 'NOTHING_LEARNED' WHEN rb + rt > 0 AND xb + xt = 0 THEN 'ONLY_SECOND_LEARNED' WHEN gx >= 0.03 AND gr >= 0.03 THEN 'CONTROL_FAILED' WHEN gx <= -0.03 THEN 'NEGATIVE' WHEN (gx >= 0.03 AND (gr IS NULL OR abs(gr) < 0.03)) OR (xt - xb >= 2 AND rt - rb <= 0) THEN 'PREDICTED' ELSE 'MIXED' END AS verdict FROM g"""
Q["bootstrap_ci_hash"] = lambda s, d: S.hash_bootstrap(runs(s, d).filter("escaped"), CELL, "f1", "seed", 100)
O["bootstrap_ci_hash"] = f"""WITH {_R}, v AS (SELECT base, condition, list(f1 ORDER BY seed) AS v, count(*) AS n FROM rr WHERE escaped GROUP BY ALL), b AS (SELECT base, condition, v, n, unnest(range(0, 100)) AS b FROM v), i AS (SELECT base, condition, v, n, b, unnest(range(0, n)) AS i FROM b),
m AS (SELECT base, condition, b, avg(v[cast('0x' || left(md5(b || ':' || i), 8) AS bigint) % n + 1]) AS m FROM i GROUP BY ALL) SELECT base, condition, round(quantile_cont(m, 0.025), 2) AS lo, round(quantile_cont(m, 0.975), 2) AS hi FROM m GROUP BY ALL"""
Q["bootstrap_ci_pcg64"] = lambda s, d: S.pcg_bootstrap(runs(s, d).filter("escaped"), CELL, "f1", "seed")
Q["steadiness"] = lambda s, d: S.steadiness(steps(s, d), KEYS)
O["steadiness"] = f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY base, condition, seed ORDER BY step) AS r FROM steps), n AS (SELECT *, count(*) OVER (PARTITION BY base, condition, seed) AS n FROM r WHERE r > 2),
g AS (SELECT base, condition, seed, {_mean('f1', 'r - 2 <= n // 2')} AS a, {_mean('f1', 'r - 2 > n // 2')} AS b FROM n GROUP BY ALL), x AS (SELECT base, condition, seed, CASE WHEN a > 0 THEN round(b / a, 4) END AS ratio FROM g)
SELECT *, CASE WHEN ratio > 1.3 THEN 'DEGRADING' WHEN ratio IS NOT NULL THEN 'STABLE' END AS state FROM x"""
Q["figure_series"] = lambda s, d: cells(s, d).filter("status = 'MEASURED'").select("base", "condition", "n", "escape_rate", "conditional_f1")
O["figure_series"] = f"WITH {_C} SELECT base, condition, n, round(k / cast(n AS double), 4) AS escape_rate, {_round('c')} AS conditional_f1 FROM cl WHERE n > 0"


def scanned(s, d):
    """The scanned records, with what a source stage would have left."""
    return Q["run_scan"](s, d).withColumn("tr_stage_macro_f1", F.round(F.col("selected_validation_macro_f1") / 2, 6)).withColumn("tr_stage_degenerate", F.col("selected_validation_macro_f1") < 0.5).withColumn("collapsed", F.col("escaped_but_terminal_collapsed"))


_SCAN = f"{_RS}, sn AS (SELECT *, escaped AND terminal_f1 <= 0.4 AS collapsed, round(selected_f1 / 2, 6) AS tr, round(selected_f1 * cast(0.9 AS double), 6) AS te FROM sr WHERE base <> '0')"
_WL = "cast(greatest(n, 1) AS double)"
Q["cell_details"] = lambda s, d: S.cell_details(scanned(s, d), CELL)
O["cell_details"] = f"""WITH {_SCAN}, g AS (SELECT base, condition, count(*) AS n, count(*) FILTER (WHERE escaped AND collapsed) AS f, count(*) FILTER (WHERE escaped AND NOT collapsed) AS k, count(*) FILTER (WHERE selected_f1 < 0.5) AS dg, {_round(_mean('tr'))} AS m, string_agg(base || '/' || condition || '/' || seed, ';' ORDER BY base || '/' || condition || '/' || seed) AS sp FROM sn GROUP BY ALL),
z AS (SELECT *, k / {_WL} AS p, cast({S.Z} AS double) AS z FROM g) SELECT base, condition, n, f AS n_escaped_then_collapsed, round(k / cast(n AS double), 4) AS escape_rate_sustained, round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n))), 4) AS sustained_lo, round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z / (1 + z*z/n) * sqrt(p*(1-p)/n + z*z/(4*n*n))), 4) AS sustained_hi, dg AS n_tr_stage_degenerate, m AS tr_stage_macro_f1_mean, sp AS source_paths FROM z"""
Q["test_table"] = lambda s, d: S.test_table(Q["run_scan"](s, d), CELL)
O["test_table"] = f"WITH {_SCAN} SELECT base, condition, count(*) AS n, count(*) FILTER (WHERE escaped) || '/' || count(*) AS escaped, {_round(_mean('te', 'escaped'))} AS test_f1_conditional, {_round(_mean('te'))} AS test_f1_all, {_round(_mean('selected_f1', 'escaped'))} AS validation_f1_conditional, {_round(_mean('round(te - selected_f1, 6)'))} AS delta_mean FROM sn GROUP BY ALL"


def tested(s, d):
    """The scanned records, their test scores moved by the seed."""
    te = F.round(F.col("test_macro_f1") + (F.col("seed") % 7) * F.lit(0.013), 6)
    return Q["run_scan"](s, d).withColumn("test_macro_f1", te).withColumn("delta_test_minus_validation_matched", F.round(F.col("test_macro_f1") - F.col("selected_validation_macro_f1"), 6))


_TST = f"""{_RS}, ts AS (SELECT base, condition, seed, escaped, selected_f1 AS v, round(round(selected_f1 * cast(0.9 AS double), 6) + (seed % 7) * cast(0.013 AS double), 6) AS t FROM sr WHERE base <> '0'),
sd AS (SELECT a.base, a.condition AS c1, b.condition AS c2, count(*) AS n_shared, {_round(_mean('b.v - a.v'))} AS d_val, {_round(_mean('b.t - a.t'))} AS d_test FROM ts a JOIN ts b ON a.base = b.base AND a.seed = b.seed AND a.condition < b.condition WHERE a.escaped AND b.escaped GROUP BY ALL),
cm AS (SELECT base, condition, {_mean('v')} AS v, {_mean('t')} AS t FROM ts GROUP BY ALL), tc AS (SELECT a.base, a.condition AS c1, b.condition AS c2, coalesce(n_shared, 0) AS n_shared, d_val, d_test, sign(d_val) = sign(d_test) AS same_sign, {_round('b.v - a.v')} AS d_val_all, {_round('b.t - a.t')} AS d_test_all
FROM cm a JOIN cm b ON a.base = b.base AND a.condition < b.condition LEFT JOIN sd ON sd.base = a.base AND c1 = a.condition AND c2 = b.condition)"""
Q["test_contrasts"] = lambda s, d: S.test_contrasts(tested(s, d), ["base"], "condition", "seed")
O["test_contrasts"] = f"WITH {_TST} SELECT * FROM tc"
Q["generalisation_gap"] = lambda s, d: S.generalisation_gap(tested(s, d), "base")
O["generalisation_gap"] = f"WITH {_TST}, g AS (SELECT unnest([base, 'ALL']) AS base, round(t - v, 6) AS d FROM ts) SELECT base, count(*) AS n, {_round(_mean('d'))} AS mean, {_round('median(d)')} AS median, round(stddev_samp(d), 4) AS sd, min(d) AS min, max(d) AS max, count(*) FILTER (WHERE d < 0) AS negative FROM g GROUP BY base"
Q["sign_agreement"] = lambda s, d: S.sign_agreement(S.test_contrasts(tested(s, d), ["base"], "condition", "seed"), "base")
O["sign_agreement"] = f"""WITH {_TST}, g AS (SELECT unnest([base, 'ALL']) AS base, d_val, d_test, same_sign FROM tc WHERE n_shared > 0) SELECT base, count(*) AS n, count(*) FILTER (WHERE same_sign) AS agree, count(*) FILTER (WHERE abs(d_val) >= 0.01) AS n_clear, count(*) FILTER (WHERE abs(d_val) >= 0.01 AND same_sign) AS agree_clear,
round(corr(d_val, d_test), 4) AS r, round(sum(abs(d_test)) / sum(abs(d_val)), 3) AS ratio FROM g GROUP BY base"""
Q["difference_intervals"] = lambda s, d: S.difference_intervals(runs(s, d), ["base"], "condition", "f1", "seed", 2000)
Q["survival"] = lambda s, d: S.survival(cells(s, d).groupBy("base").agg((F.max("escape_rate") / 100).alias("accuracy")))
O["survival"] = f"WITH {_C}, a AS (SELECT base, max(CASE WHEN n > 0 THEN round(k / cast(n AS double), 4) END) / 100 AS a FROM cl GROUP BY base), g AS (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(a, 0) < 0.01) AS dead FROM a) SELECT n, dead, CASE WHEN dead = 0 THEN 'SURVIVED' WHEN dead = n THEN 'ALL_DESTROYED' ELSE 'SOME_DESTROYED' END AS verdict FROM g"


def trained(s, d):
    """Records of two runs on the most frequent language's rated documents: alone, and after a stage on the other languages."""
    x = rated(s, d)
    first = x.groupBy("lang").count().orderBy(F.desc("count"), "lang").first()["lang"]
    target = P.stratified_split(x.filter(F.col("lang") == first).select("doc_id", "text", "label"), "doc_id")
    other = x.filter(F.col("lang") != first).select("doc_id", "text", "label")
    how = {"base": "b1", "seed": 13, "train_size": 20_000, "settings": L.Settings(batch=256, max_steps=8, eval_every=4, epochs=2), "test": True}
    target = L.ready(target, "doc_id", how["seed"], how["train_size"], how["settings"].batch, test=True)
    return L.records(s, [L.run(target, "doc_id", condition="plain", **how), L.run(target, "doc_id", condition="staged", source=other, source_name="others", **how)])


def training_history(s, d):
    """The evaluated steps of the runs trained here, with what H2-H9 make of them."""
    r = io.parse_runs(trained(s, d)).select("r.base", "r.condition", "r.seed", F.explode("r.step_history").alias("h"))
    h = r.select("base", "condition", "seed", F.col("h.step").cast("long").alias("step"), F.col("h.eval_macro_f1").alias("f1"))
    return h.join(R.summarise(h, KEYS, target_steps=2), KEYS).select(*KEYS, "step", "f1", "selected_step", "terminal_step", "verdict")


Q["training_history"] = training_history
Q["training_violations"] = lambda s, d: R.violations(io.parse_runs(trained(s, d)), R.record_rules())
