"""Queries of vocabularies, each with its SQL. The vocabularies are made from the documents' words: one scheme of marks for each language."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import encoding
from tarnwork.functions import text as T
from tarnwork.operators import corpus as C
from tarnwork.operators import vocab as V
from tarnwork.plans.common import table

Q: dict = {}
O: dict[str, str] = {}


def vocab(s, d):
    w = table(s, d, "documents").select("lang", F.explode(T.words(F.col("text"))).alias("w"))
    p = w.withColumn("ps", C.pieces(F.col("w"))).select("lang", F.size("ps").alias("k"), F.posexplode("ps").alias("i", "p"))
    first, last = F.col("i") == 0, F.col("i") == F.col("k") - 1
    token = F.when(F.col("lang") == "en", F.when(first, F.concat(F.lit("▁"), "p")).otherwise(F.col("p"))).when(F.col("lang") == "de", F.when(first, F.col("p")).otherwise(F.concat(F.lit("##"), "p")))
    token = token.when(F.col("lang") == "fr", F.when(last, F.concat("p", F.lit("</w>"))).otherwise(F.col("p"))).when(F.col("lang") == "es", F.when(first, F.concat(F.lit("Ġ"), "p")).otherwise(F.col("p"))).otherwise(F.col("p"))
    return V.ranked_vocab(p.select(F.col("lang").alias("tokenizer"), token.alias("token")))


_V = r"""vw AS (SELECT lang, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents),
vp AS (SELECT lang, i, substring(w, cast(3 * i + 1 AS bigint), 3) AS p, i = 0 AS f, i = cast(ceil(length(w) / cast(3 AS double)) AS bigint) - 1 AS l FROM (SELECT lang, w, unnest(range(0, cast(ceil(length(w) / cast(3 AS double)) AS bigint))) AS i FROM vw)),
vt AS (SELECT lang AS tokenizer, CASE WHEN lang = 'en' THEN CASE WHEN f THEN '▁' || p ELSE p END WHEN lang = 'de' THEN CASE WHEN f THEN p ELSE '##' || p END WHEN lang = 'fr' THEN CASE WHEN l THEN p || '</w>' ELSE p END WHEN lang = 'es' THEN CASE WHEN f THEN 'Ġ' || p ELSE p END ELSE p END AS token FROM vp),
vocab AS (SELECT tokenizer, token, row_number() OVER (PARTITION BY tokenizer ORDER BY n DESC, token) - 1 AS token_id FROM (SELECT tokenizer, token, count(*) AS n FROM vt GROUP BY ALL)),
sch AS (SELECT tokenizer, CASE WHEN avg(cast(starts_with(token, '▁') AS int)) > 0.05 THEN 'sentencepiece' WHEN avg(cast(starts_with(token, 'Ġ') AS int)) > 0.05 THEN 'bytelevel' WHEN avg(cast(starts_with(token, '##') AS int)) > 0.02 THEN 'wordpiece' WHEN avg(cast(ends_with(token, '</w>') AS int)) > 0.30 THEN 'fastbpe' ELSE 'plain' END AS scheme FROM vocab GROUP BY tokenizer),
vs AS (SELECT * FROM vocab JOIN sch USING (tokenizer)),
cv AS (SELECT tokenizer, surface, initial, min(token_id) AS token_id FROM (SELECT tokenizer, token_id, CASE WHEN scheme = 'sentencepiece' AND starts_with(token, '▁') THEN substring(token, 2) WHEN scheme = 'bytelevel' AND starts_with(token, 'Ġ') THEN substring(token, 2) WHEN scheme = 'wordpiece' AND starts_with(token, '##') THEN substring(token, 3) ELSE token END AS surface,
  CASE WHEN scheme = 'sentencepiece' THEN starts_with(token, '▁') WHEN scheme = 'bytelevel' THEN starts_with(token, 'Ġ') WHEN scheme = 'wordpiece' THEN NOT starts_with(token, '##') ELSE true END AS initial FROM vs) GROUP BY ALL),
sv AS (SELECT tokenizer, surface, min(token_id) AS token_id FROM (SELECT tokenizer, token_id, CASE WHEN scheme = 'sentencepiece' AND starts_with(token, '▁') THEN substring(token, 2) WHEN scheme = 'bytelevel' AND starts_with(token, 'Ġ') THEN substring(token, 2) WHEN scheme = 'wordpiece' AND starts_with(token, '##') THEN substring(token, 3) WHEN scheme = 'fastbpe' AND ends_with(token, '</w>') THEN left(token, length(token) - 4) ELSE token END AS surface FROM vs) WHERE surface <> '' GROUP BY ALL),
a_strict AS (SELECT d.token_id AS donor_id, b.token_id AS base_id FROM cv d JOIN cv b ON d.tokenizer = 'de' AND b.tokenizer = 'en' AND d.surface = b.surface AND d.initial = b.initial),
a_surface AS (SELECT d.token_id AS donor_id, b.token_id AS base_id FROM sv d JOIN sv b ON d.tokenizer = 'de' AND b.tokenizer = 'en' AND d.surface = b.surface),
a_fun AS (SELECT donor_id, coalesce(ins, sta) AS base_id, CASE WHEN ins IS NOT NULL THEN 'standalone' ELSE 'leading_space' END AS how FROM (SELECT d.token_id AS donor_id, i.token_id AS ins, s.token_id AS sta FROM sv d LEFT JOIN cv i ON i.tokenizer = 'en' AND NOT i.initial AND i.surface = d.surface LEFT JOIN cv s ON s.tokenizer = 'en' AND s.initial AND s.surface = d.surface WHERE d.tokenizer = 'de') WHERE coalesce(ins, sta) IS NOT NULL)"""

Q["vocab_ranked"] = vocab
O["vocab_ranked"] = f"WITH {_V} SELECT * FROM vocab"
Q["vocab_scheme"] = lambda s, d: V.schemes(vocab(s, d))
O["vocab_scheme"] = f"WITH {_V} SELECT * FROM sch"
Q["canon_vocab"] = lambda s, d: V.canon_vocab(vocab(s, d))
O["canon_vocab"] = f"WITH {_V} SELECT * FROM cv"
Q["surface_vocab"] = lambda s, d: V.surface_vocab(vocab(s, d))
O["surface_vocab"] = f"WITH {_V} SELECT * FROM sv"
Q["anchors_strict"] = lambda s, d: V.anchors_strict(vocab(s, d), "de", "en")
O["anchors_strict"] = f"WITH {_V} SELECT * FROM a_strict"
Q["anchors_surface"] = lambda s, d: V.anchors_surface(vocab(s, d), "de", "en")
O["anchors_surface"] = f"WITH {_V} SELECT * FROM a_surface"
Q["anchors_functional"] = lambda s, d: V.anchors_functional(vocab(s, d), "de", "en")
O["anchors_functional"] = f"WITH {_V} SELECT * FROM a_fun"
Q["anchor_diag"] = lambda s, d: V.anchor_diagnostics(V.anchors_strict(v := vocab(s, d), "de", "en"), V.anchors_functional(v, "de", "en"))
O["anchor_diag"] = f"WITH {_V} SELECT count(*) AS n_union, count(*) FILTER (WHERE f.donor_id IS NULL) AS strict_only, count(*) FILTER (WHERE s.donor_id IS NULL) AS functional_only, count(*) FILTER (WHERE s.donor_id IS NOT NULL AND f.donor_id IS NOT NULL) AS both FROM a_strict s FULL JOIN a_fun f ON s.donor_id = f.donor_id"
Q["anchor_verdict"] = lambda s, d: V.verdict(V.anchors_functional(vocab(s, d), "de", "en"), 20_000, 500)
O["anchor_verdict"] = f"WITH {_V} SELECT count(*) AS n_anchors, CASE WHEN count(*) >= 20000 THEN 'GO' WHEN count(*) >= 500 THEN 'GO_WITH_CARE' ELSE 'NO_GO' END AS verdict FROM a_fun"
Q["raw_token_overlap"] = lambda s, d: V.raw_overlap(vocab(s, d), "de", "en")
O["raw_token_overlap"] = f"WITH {_V} SELECT count(*) AS shared FROM vocab WHERE tokenizer = 'de' AND token IN (SELECT token FROM vocab WHERE tokenizer = 'en')"
Q["donor_partition"] = lambda s, d: V.partition_ids(v := vocab(s, d), "de", V.anchors_functional(v, "de", "en"), Q["special_align"](s, d))
O["donor_partition"] = f"WITH {_V} SELECT token_id AS donor_id, CASE WHEN token_id IN (SELECT donor_id FROM a_fun) THEN 'anchor' WHEN token_id IN (0, 1, 2, 3, 4, 5) THEN 'special' ELSE 'unfamiliar' END AS part FROM vocab WHERE tokenizer = 'de'"

DONOR_ROLES = [("cls", 2), ("sep", 3), ("eos", 4), ("pad", 0), ("unk", 1), ("mask", 5)]
BASE_ROLES = [("bos", 0), ("sep", 2), ("pad", 1), ("unk", 3)]


def specials(s, d):
    """The donor's special tokens in the base, whose mask stands behind its vocabulary."""
    mask = vocab(s, d).filter("tokenizer = 'en'").agg(F.lit("mask").alias("role"), (F.coalesce(F.max("token_id"), F.lit(-1)) + 1).alias("token_id"))
    named = lambda rows: s.createDataFrame(rows, "role string, token_id long")
    return V.align_specials(named(DONOR_ROLES), named(BASE_ROLES).unionByName(mask))


Q["special_align"] = specials
O["special_align"] = f"WITH {_V} SELECT * FROM (VALUES ('cls', cast(2 AS bigint), cast(0 AS bigint)), ('sep', 3, 2), ('eos', 4, 2), ('pad', 0, 1), ('unk', 1, 3)) t(role, donor_id, base_id) UNION ALL SELECT 'mask', 5, count(*) FROM vocab WHERE tokenizer = 'en'"


def by_encoding(s, d):
    """Anchors of the documents' vocabulary in a public one, by encoding."""
    refused = s.createDataFrame([(i,) for i in sorted(encoding.load(encoding.public_path("byte_bpe_50k.json")).refused)], "token_id long")
    return V.anchors_by_encoding(vocab(s, d), "de", "byte_bpe_50k.json", refused)


Q["anchors_by_encoding"] = by_encoding
