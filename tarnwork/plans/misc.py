"""Queries of grids, audits and error taxonomies, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwork.functions import tables
from tarnwork.operators import audit as A
from tarnwork.operators import corpus as C
from tarnwork.operators import errors as E
from tarnwork.operators import grid as G
from tarnwork.operators import order
from tarnwork.operators import stats as S
from tarnwork.plans.common import rated, table
from tarnwork.plans.runs import _fisher

Q: dict = {}
O: dict[str, str] = {}

#: Sizes of training parts, besides all rows of a language; the first ones are also those of the intermediate stage.
SIZES, MIDDLE, REFERENCE = [25, 100, 500, 2000, 10000], [25, 100], 100
SEEDS, FEW = [13, 21, 42, 87, 2024], [13, 42, 2024]
CONDITIONS = [("plain", 0, "orig", False, None), ("swapped", 1, "new", False, None), ("plain_mid", 2, "orig", True, MIDDLE), ("swapped_mid", 3, "new", True, MIDDLE)]


def queue(s, d):
    """The grid over the languages of the documents, each in the sizes that its rows allow."""
    n = table(s, d, "documents").filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").cast("int").alias("n"))
    sizes = F.concat(F.filter(F.array(*map(F.lit, SIZES)), lambda x: x < F.col("n")), F.array("n"))
    bases = n.select(F.col("lang").alias("base"), F.row_number().over(Window.orderBy("lang")).alias("base_pos"), sizes.alias("sizes"))  # a row a language
    conds = s.createDataFrame(CONDITIONS, "condition string, cond_pos int, tokenizer string, turkish boolean, sizes array<int>")
    return G.expand(bases, conds, REFERENCE, SEEDS, FEW)


_G = f"""ba AS (SELECT lang AS base, row_number() OVER (ORDER BY lang) AS bp, list_concat(list_filter({SIZES!r}, lambda x: x < n), [n]) AS sizes FROM (SELECT lang, cast(count(*) AS int) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)), bs AS (SELECT base, bp, unnest(sizes) AS size, generate_subscripts(sizes, 1) AS sp FROM ba),
co AS (SELECT * FROM (VALUES ('plain', 0, 'orig', false, NULL), ('swapped', 1, 'new', false, NULL), ('plain_mid', 2, 'orig', true, {MIDDLE!r}), ('swapped_mid', 3, 'new', true, {MIDDLE!r})) t(condition, cp, tokenizer, turkish, only_)),
j AS (SELECT * FROM bs JOIN co ON only_ IS NULL OR list_contains(only_, size)), e AS (SELECT *, CASE WHEN size <= 2000 THEN {SEEDS!r} ELSE {FEW!r} END AS se FROM j), x AS (SELECT *, unnest(se) AS seed, generate_subscripts(se, 1) AS dp FROM e),
q AS (SELECT base, size, condition, tokenizer, turkish, seed, row_number() OVER (ORDER BY size <> {REFERENCE}, bp, CASE WHEN size <> {REFERENCE} THEN sp ELSE 0 END, cp, dp) - 1 AS pos FROM x)"""
Q["grid_queue"] = queue
O["grid_queue"] = f"WITH {_G} SELECT * FROM q"
Q["grid_shared_stages"] = lambda s, d: G.shared_stages(queue(s, d), "turkish", ["base", "tokenizer", "seed"])
O["grid_shared_stages"] = f"WITH {_G} SELECT count(*) AS requests, count(DISTINCT base || tokenizer || seed) AS builds FROM q WHERE turkish"
Q["grid_injective"] = lambda s, d: G.injective(queue(s, d), ["base", "condition", "size", "seed"])
O["grid_injective"] = f"WITH {_G} SELECT count(*) AS n, count(DISTINCT concat_ws(':', base, condition, size, seed)) AS n_distinct, count(*) = count(DISTINCT concat_ws(':', base, condition, size, seed)) AS ok FROM q"
Q["grid_budget"] = lambda s, d: G.admit(queue(s, d), F.col("size") * 0.01 + 20, 2500.0).select("pos", F.round("until", 2).alias("until"), "admitted")
O["grid_budget"] = f"WITH {_G}, u AS (SELECT pos, sum(size * cast(0.01 AS double) + 20) OVER (ORDER BY pos) AS u FROM q) SELECT pos, round(u, 2) AS until, u <= 2500 AS admitted FROM u"
Q["grid_disk"] = lambda s, d: queue(s, d).agg(F.count("*").alias("n"), F.count_distinct("base", "tokenizer", "seed").alias("c")).select("n", "c", F.round(G.disk_need(F.col("c"), F.col("n"), 2, True), 4).alias("gb"))
O["grid_disk"] = f"WITH {_G} SELECT count(*) AS n, count(DISTINCT base || tokenizer || seed) AS c, round((count(DISTINCT base || tokenizer || seed) * cast(1.2 AS double) + count(*) * cast(0.00025 AS double) + 4.8) * cast(1.15 AS double), 4) AS gb FROM q"
DONE = "event_type = 'click'"
Q["grid_resume"] = lambda s, d: G.remaining(queue(s, d), table(s, d, "events").filter(DONE).select(F.col("user_id").cast("int").alias("seed")).distinct().withColumn("size", F.lit(REFERENCE)), ["seed", "size"]).select("base", "condition", "size", "seed")
O["grid_resume"] = f"WITH {_G} SELECT base, condition, size, seed FROM q WHERE NOT (size = {REFERENCE} AND seed IN (SELECT user_id FROM events WHERE {DONE}))"
Q["grid_missing_stages"] = lambda s, d: G.missing_stages(q := queue(s, d).filter("turkish"), q.filter("seed <> 87"), ["base", "tokenizer", "seed"])
O["grid_missing_stages"] = f"WITH {_G} SELECT DISTINCT base, tokenizer, seed FROM q WHERE turkish AND seed = 87"


def sheets(s, d):
    """Two annotators of the labelled documents, flipped by a hash, and the data set's own label."""
    h = F.md5(F.col("doc_id").cast("string"))
    gold = F.when(F.substring(h, 5, 1) < "4", "neutral").when(F.col("label") == 1, "positive").otherwise("negative")
    flip = lambda c, k: F.when(F.substring(h, k, 1) == "0", "bilmirəm").when(F.substring(h, k, 1) == "1", "2").when(F.substring(h, k, 1) == "2", "").when(F.substring(h, k, 1) == "3", F.when(c == "positive", "Negative").otherwise("Positive")).when(F.substring(h, k, 1).isin("4", "5"), F.when(c == "positive", "1").when(c == "neutral", " 2").otherwise("3")).otherwise(c)
    x = rated(s, d).select("doc_id", "text", gold.alias("gold"))
    return x.select("doc_id", "text", "gold", F.coalesce(A.canonical(flip(F.col("gold"), 1)), F.lit("unclear")).alias("h1"), F.coalesce(A.canonical(flip(F.col("gold"), 2)), F.lit("unclear")).alias("h2"))


def _flip(k: int) -> str:
    return f"CASE substring(h, {k}, 1) WHEN '0' THEN 'unclear' WHEN '1' THEN 'neutral' WHEN '2' THEN 'unclear' WHEN '3' THEN CASE WHEN gold = 'positive' THEN 'negative' ELSE 'positive' END ELSE gold END"


_A = f"""g AS (SELECT doc_id, text, md5(cast(doc_id AS varchar)) AS h, CASE WHEN substring(md5(cast(doc_id AS varchar)), 5, 1) < '4' THEN 'neutral' WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS gold FROM documents JOIN labels USING (doc_id)),
sh AS (SELECT doc_id, text, gold, {_flip(1)} AS h1, {_flip(2)} AS h2 FROM g), pp AS (SELECT 'hh' AS pair, h1 AS a, h2 AS b FROM sh UNION ALL SELECT 'hd1', gold, h1 FROM sh UNION ALL SELECT 'hd2', gold, h2 FROM sh),
st AS (SELECT pair, count(*) AS "rows", count(*) FILTER (WHERE a <> 'unclear' AND b <> 'unclear') AS n, count(*) FILTER (WHERE a = b AND a <> 'unclear') AS agree, count(*) FILTER (WHERE b = 'unclear') AS unclear FROM pp GROUP BY pair),
mg AS (SELECT pair, l, count(*) FILTER (WHERE s = 1) AS x, count(*) FILTER (WHERE s = 2) AS y FROM (SELECT pair, a AS l, 1 AS s FROM pp WHERE a <> 'unclear' AND b <> 'unclear' UNION ALL SELECT pair, b, 2 FROM pp WHERE a <> 'unclear' AND b <> 'unclear') GROUP BY ALL),
ch AS (SELECT pair, sum(x * y) AS xy, count(*) AS labels FROM mg GROUP BY pair),
ar AS (SELECT pair, n, round(cast(100 AS double) * agree / greatest(n, 1), 2) AS agreement_pct, CASE WHEN labels >= 2 THEN round((agree / cast(n AS double) - xy / (cast(n AS double) * n)) / (1 - xy / (cast(n AS double) * n)), 4) END AS kappa, round(cast(100 AS double) * unclear / "rows", 2) AS unclear_pct, cast(100 AS double) * unclear / "rows" > 15 AS concern FROM st JOIN ch USING (pair))"""


def pairs(s, d):
    x = sheets(s, d)
    return x.select(F.explode(F.array(*(F.struct(F.lit(k).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b")) for k, a, b in (("hh", "h1", "h2"), ("hd1", "gold", "h1"), ("hd2", "gold", "h2"))))).alias("p")).select("p.*")


def scores(s, d):
    return A.agreement(pairs(s, d), ["pair"], "a", "b")


Q["audit_agreement"] = lambda s, d: scores(s, d).select("pair", "n", "agreement_pct", "unclear_pct", "concern")
O["audit_agreement"] = f"WITH {_A} SELECT pair, n, agreement_pct, unclear_pct, concern FROM ar"
Q["audit_kappa"] = lambda s, d: scores(s, d).select("pair", "kappa")
O["audit_kappa"] = f"WITH {_A} SELECT pair, kappa FROM ar"
Q["audit_per_class"] = lambda s, d: A.class_accuracy(pairs(s, d).filter("pair <> 'hh'"), ["pair"], "a", "b")
O["audit_per_class"] = f"WITH {_A} SELECT pair, a AS class, count(*) AS n, count(*) FILTER (WHERE a = b) AS correct, round(count(*) FILTER (WHERE a = b) / cast(count(*) AS double), 4) AS accuracy FROM pp WHERE pair <> 'hh' AND b <> 'unclear' GROUP BY ALL"
Q["audit_polarity"] = lambda s, d: A.polarity_subset(sheets(s, d), "gold", "h1", "h2")
O["audit_polarity"] = f"WITH {_A} SELECT count(*) AS n, CASE WHEN count(*) > 0 THEN round(cast(100 AS double) * count(*) FILTER (WHERE h1 = h2) / greatest(count(*), 1), 2) END AS hh_agreement_pct FROM sh WHERE gold NOT IN ('neutral', 'unclear') AND h1 NOT IN ('neutral', 'unclear') AND h2 NOT IN ('neutral', 'unclear')"
Q["audit_intervals"] = lambda s, d: A.agreement_intervals(sheets(s, d).select(F.lit("hd1").alias("pair"), "doc_id", F.col("gold").alias("a"), F.col("h1").alias("b")), ["pair"], "a", "b", "doc_id", 2000)


def probed(s, d):
    """What the annotators say at the probes' places in the order of the documents; only these places are sought."""
    x = sheets(s, d)
    n = x.count()
    places = {f"p{p[0]}": F.lit(p[0]) for p in A.PROBES if p[0] < n}
    at = order.at_ranks(x.select("doc_id"), [], "doc_id", places).select(F.explode(F.array(*(F.struct(F.lit(int(c[1:])).alias("idx"), F.col(c).alias("doc_id")) for c in places))).alias("p")).select("p.*")
    y = x.join(F.broadcast(at), "doc_id")
    return y.select("idx", F.explode(F.array(F.struct(F.lit("h1").alias("annotator"), F.col("h1").alias("label")), F.struct(F.lit("h2").alias("annotator"), F.col("h2").alias("label")))).alias("x")).select("x.annotator", "idx", "x.label")


Q["audit_probes"] = lambda s, d: A.probe_failures(probed(s, d), s.createDataFrame([p[:2] for p in A.PROBES], "idx int, expected string"))
O["audit_probes"] = f"""WITH {_A}, ix AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM sh), pe AS (SELECT * FROM (VALUES (38, 'positive'), (48, 'negative'), (57, 'neutral')) t(idx, expected)),
pl AS (SELECT 'h1' AS annotator, idx, h1 AS label FROM ix UNION ALL SELECT 'h2', idx, h2 FROM ix) SELECT annotator, count(*) AS probes, count(*) FILTER (WHERE NOT coalesce(label = expected, false)) AS missed FROM (SELECT n.annotator, pe.idx, expected, label FROM (SELECT DISTINCT annotator FROM pl) n CROSS JOIN pe LEFT JOIN pl ON pl.annotator = n.annotator AND pl.idx = pe.idx) GROUP BY annotator"""
Q["leak_columns"] = lambda s, d: s.createDataFrame([(c,) for c in sorted(A.leaking_columns(sheets(s, d).withColumnsRenamed({"h1": "Verdict", "h2": "correct"})))], "leaks string")
O["leak_columns"] = "SELECT unnest(['Verdict', 'correct', 'gold']) AS leaks"
Q["audit_decomposition"] = lambda s, d: A.decompose(pairs(s, d).filter("a <> 'unclear' AND b <> 'unclear'"), ["pair"], "a", "b")
O["audit_decomposition"] = f"""WITH {_A}, c AS (SELECT pair, count(*) FILTER (WHERE a = b) AS agreements, count(*) FILTER (WHERE a <> b) AS disagreements, count(*) FILTER (WHERE a <> b AND (a = 'neutral' OR b = 'neutral')) AS neutral_boundary, count(*) FILTER (WHERE a <> b AND a <> 'neutral' AND b <> 'neutral') AS polarity_flip FROM pp WHERE a <> 'unclear' AND b <> 'unclear' GROUP BY pair)
SELECT *, round(cast(100 AS double) * neutral_boundary / greatest(disagreements, 1), 2) AS neutral_boundary_pct, round(cast(100 AS double) * polarity_flip / greatest(disagreements, 1), 2) AS polarity_flip_pct FROM c"""
Q["audit_gate"] = lambda s, d: (lambda at: scores(s, d).agg(at("hh").alias("hh"), at("hd1").alias("hd1"), at("hd2").alias("hd2")).select("hh", "hd1", "hd2", A.gate(F.col("hh"), F.col("hd1"), F.col("hd2")).alias("verdict")))(lambda k: F.max(F.when(F.col("pair") == k, F.col("agreement_pct"))))
O["audit_gate"] = f"""WITH {_A}, v AS (SELECT max(agreement_pct) FILTER (WHERE pair = 'hh') AS hh, max(agreement_pct) FILTER (WHERE pair = 'hd1') AS hd1, max(agreement_pct) FILTER (WHERE pair = 'hd2') AS hd2 FROM ar)
SELECT *, CASE WHEN hh < 60 THEN 'STOP_TASK_TOO_SUBJECTIVE' WHEN least(hd1, hd2) - hh >= -5 THEN 'PROCEED' WHEN least(hd1, hd2) - hh >= -12 THEN 'PROCEED_WITH_CAVEAT' ELSE 'STOP_LABELS_UNRELIABLE' END AS verdict FROM v"""


def consensus_fisher(s, d):
    c = A.consensus(sheets(s, d), "h1", "h2").select((F.col("consensus") == F.col("gold")).alias("agrees"), F.contains("text", F.lit("tion")).alias("has"))
    t = c.agg(F.count_if(F.col("has") & F.col("agrees")).alias("a"), F.count_if(F.col("has") & ~F.col("agrees")).alias("b"), F.count_if(~F.col("has") & F.col("agrees")).alias("c"), F.count_if(~F.col("has") & ~F.col("agrees")).alias("d"))
    return S.fisher(t.withColumn("k", F.lit(1)), ["k"])


Q["consensus_fisher"] = consensus_fisher
O["consensus_fisher"] = f"""WITH {_A}, cs AS (SELECT h1 = gold AS agrees, contains(text, 'tion') AS has FROM sh WHERE h1 = h2 AND h1 <> 'unclear'), ft AS (SELECT 1 AS k, count(*) FILTER (WHERE has AND agrees) AS a, count(*) FILTER (WHERE has AND NOT agrees) AS b, count(*) FILTER (WHERE NOT has AND agrees) AS c, count(*) FILTER (WHERE NOT has AND NOT agrees) AS d FROM cs), {_fisher('k')} SELECT * FROM fisher"""

FRIENDS, TECH = ["the", "von"], ["para", "pour"]


def errors(s, d):
    x = rated(s, d).withColumn("pred", F.when(F.contains("text", F.lit("***")), 0).otherwise(1)).filter("pred <> label")
    m = C.lengths(x)
    return m.select("doc_id", "lang", E.classify(F.col("text"), F.col("n_tokens"), FRIENDS, TECH).alias("category"))


_E = r"""ex AS (SELECT doc_id, lang, lower(text) AS t, text FROM documents JOIN labels USING (doc_id) WHERE quality <> CASE WHEN contains(text, '***') THEN 0 ELSE 1 END),
ew AS (SELECT *, list_filter(string_split(trim(regexp_replace(t, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w, coalesce(list_sum(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: cast(ceil(length(x) / cast(3 AS double)) AS bigint))), 0) AS k FROM ex),
eb AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '^[.,!?;:()"'']+|[.,!?;:()"'']+$', '', 'g')) AS b FROM ew),
er AS (SELECT doc_id, lang, CASE WHEN list_has_any(b, ['the', 'von']) THEN 'false_friend' WHEN list_has_any(b, ['para', 'pour']) THEN 'technical' WHEN k / cast(greatest(len(w), 1) AS double) > 4 THEN 'morphology' ELSE 'other' END AS category FROM eb)"""
Q["error_taxonomy"] = lambda s, d: E.shares(errors(s, d), "lang")
O["error_taxonomy"] = f"WITH {_E}, g AS (SELECT lang, category, count(*) AS n FROM er GROUP BY ALL) SELECT lang, category, n, round(cast(100 AS double) * n / sum(n) OVER (PARTITION BY lang), 2) AS share_pct FROM g"
Q["error_sample"] = lambda s, d: E.sample(errors(s, d), "lang", "doc_id", 5)
O["error_sample"] = f"WITH {_E} SELECT doc_id, lang, category FROM er QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5"
Q["grid_tranche"] = lambda s, d: G.tranche(queue(s, d), ["en", "fr"], ["plain", "swapped"], [REFERENCE]).select("base", "condition", "size", "seed")
O["grid_tranche"] = f"WITH {_G} SELECT base, condition, size, seed FROM q WHERE base IN ('en', 'fr') AND condition IN ('plain', 'swapped') AND size = {REFERENCE}"
Q["grid_hours"] = lambda s, d: G.projected_hours(queue(s, d), "turkish", ["base", "tokenizer", "seed"], 2000, 1126, 0.066, 0.07)
O["grid_hours"] = f"WITH {_G}, c AS (SELECT count(*) AS runs, count(DISTINCT CASE WHEN turkish THEN base || tokenizer || seed END) AS stages FROM q) SELECT *, round((runs * cast(132 AS double) + stages * cast(78.82 AS double)) / 3600, 2) AS hours FROM c"


def predictions(s, d):
    """Predictions of a keyword rule, a row for each document, with its place in its language's order."""
    x = rated(s, d).select(F.col("lang").alias("condition"), "doc_id", F.col("label").cast("int").alias("gold"), F.when(F.contains("text", F.lit("***")), 0).otherwise(1).alias("pred"))
    return order.positions(tables.written(x, "predictions"), "condition", "doc_id").withColumnRenamed("_at", "pos")


Q["error_rows"] = lambda s, d: predictions(s, d).filter("gold <> pred").select("condition", "pos", "gold", "pred")
O["error_rows"] = "SELECT lang AS condition, pos, gold, pred FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, cast(quality AS int) AS gold, CASE WHEN contains(text, '***') THEN 0 ELSE 1 END AS pred FROM documents JOIN labels USING (doc_id)) WHERE gold <> pred"
Q["error_rates"] = lambda s, d: E.rates_of_rows(predictions(s, d))
O["error_rates"] = "WITH x AS (SELECT lang AS condition, quality AS gold, CASE WHEN contains(text, '***') THEN 0 ELSE 1 END AS pred FROM documents JOIN labels USING (doc_id)), g AS (SELECT condition, count(*) AS n, count(*) FILTER (WHERE gold <> pred) AS errors FROM x GROUP BY condition) SELECT *, round(cast(100 AS double) * errors / n, 2) AS rate_pct FROM g"
