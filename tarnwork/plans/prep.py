"""Queries of data preparation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.functions import text as T
from tarnwork.operators import learn as L
from tarnwork.operators import prep as P
from tarnwork.sources.config import eval_text
from tarnwork.plans.common import RATED, SOURCED, norm, rated, sourced, table

Q: dict = {}
O: dict[str, str] = {}

Q["norm_text_hash"] = lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.normalise(F.col("text"))).alias("h"))
O["norm_text_hash"] = f"SELECT doc_id, md5({norm('text')}) AS h FROM documents"

Q["drop_empty_rows"] = lambda s, d: P.drop_empty(sourced(s, d)).select("doc_id", F.md5("text").alias("h"))
O["drop_empty_rows"] = r"SELECT doc_id, md5(t) AS h FROM (SELECT doc_id, regexp_replace(text, '^[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) WHERE t <> ''"

EXCLUDED = ["src0", "src1"]
Q["label_exclude_stats"] = lambda s, d: P.exclusion_stats(sourced(s, d), EXCLUDED)
O["label_exclude_stats"] = "SELECT 'src0,src1' AS excluded_labels, count(*) AS n_before, count(*) FILTER (WHERE source NOT IN ('src0','src1')) AS n_after, count(*) FILTER (WHERE source IN ('src0','src1')) AS n_excluded FROM documents"

Q["label_encode"] = lambda s, d: P.encode_labels(P.exclude_classes(sourced(s, d), EXCLUDED)).select("doc_id", "label", "code")
O["label_encode"] = "SELECT doc_id, source AS label, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents WHERE source NOT IN ('src0','src1')"

_DEDUP = f"k AS (SELECT *, md5({norm('text')}) AS k FROM sourced), g AS (SELECT k, arg_min(doc_id, doc_id) AS doc_id, min(label) AS lo, max(label) AS hi, count(*) AS n FROM k GROUP BY k)"
Q["dedup_label_aware"] = lambda s, d: P.dedup(sourced(s, d), "doc_id").select("doc_id", "label", F.md5("text").alias("h"))
O["dedup_label_aware"] = f"WITH {SOURCED}, {_DEDUP} SELECT s.doc_id, s.label, md5(s.text) AS h FROM sourced s JOIN g USING (doc_id) WHERE lo = hi"

Q["dedup_stats"] = lambda s, d: P.dedup_stats(sourced(s, d))
O["dedup_stats"] = f"""WITH {SOURCED}, {_DEDUP}, x AS (SELECT cast(sum(n) AS bigint) AS n_before, count(*) FILTER (WHERE lo <> hi) AS conflicts, count(*) FILTER (WHERE lo = hi) AS n_after FROM g),
y AS (SELECT *, n_before - n_after AS duplicates_removed, round(cast(100.0 AS double) * (n_before - n_after) / greatest(n_before, 1), 2) AS duplicate_pct FROM x)
SELECT *, CASE WHEN duplicate_pct >= 40 THEN 'RECONSIDER' WHEN duplicate_pct >= 25 THEN 'WARN' ELSE 'OK' END AS gate FROM y"""

_SPLIT = "ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('17:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM rated), split AS (SELECT *, CASE WHEN r <= floor(n * cast(0.10 AS double)) THEN 'val' WHEN r <= floor(n * cast(0.10 AS double)) + floor(n * cast(0.15 AS double)) THEN 'test' ELSE 'train' END AS split FROM ranked)"


def split(s, d):
    return P.stratified_split(rated(s, d), "doc_id")


Q["split_stratified"] = lambda s, d: split(s, d).select("doc_id", "label", "split")
O["split_stratified"] = f"WITH {RATED}, {_SPLIT} SELECT doc_id, label, split FROM split"

Q["split_label_dist"] = lambda s, d: P.label_distribution(split(s, d), "split", "label")
O["split_label_dist"] = f"WITH {RATED}, {_SPLIT} SELECT split, label, count(*) AS n FROM split GROUP BY ALL"

Q["subsample_proportional"] = lambda s, d: P.subsample_proportional(rated(s, d), 120, "doc_id").select("doc_id", "label")
O["subsample_proportional"] = f"""WITH {RATED}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('17:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS a FROM rated)
SELECT doc_id, label FROM r WHERE a <= 120 OR r <= round_even(cast(120 AS double) * n / a, 0) ORDER BY md5('17x:' || doc_id), doc_id LIMIT 120"""

Q["subsample_balanced"] = lambda s, d: P.subsample_balanced(rated(s, d), 151, "doc_id").select("doc_id", "label")
O["subsample_balanced"] = f"""WITH {RATED}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('17:' || doc_id), doc_id) AS r, (SELECT count(DISTINCT label) FROM rated) AS c FROM rated)
SELECT doc_id, label FROM r ORDER BY (r <= greatest(1, 151 // c)) DESC, md5('17x:' || doc_id), doc_id LIMIT 151"""

_LEAK = f"k AS (SELECT DISTINCT split AS s, md5({norm('text')}) AS k FROM split)"
Q["leakage_pairs"] = lambda s, d: P.leakage(split(s, d))
O["leakage_pairs"] = f"""WITH {RATED}, {_SPLIT}, {_LEAK}, n AS (SELECT DISTINCT s FROM k), g AS (SELECT x.s AS "left", y.s AS "right" FROM n x JOIN n y ON x.s < y.s),
f AS (SELECT a.s AS "left", b.s AS "right", count(*) AS shared FROM k a JOIN k b ON a.k = b.k AND a.s < b.s GROUP BY ALL) SELECT "left", "right", coalesce(shared, 0) AS shared FROM g LEFT JOIN f USING ("left", "right")"""

Q["benchmark_disjoint"] = lambda s, d: P.overlap_count(table(s, d, "documents"), table(s, d, "benchmark"))
O["benchmark_disjoint"] = f"SELECT count(*) AS shared, count(*) = 0 AS disjoint FROM (SELECT DISTINCT {norm('text')} AS k FROM documents INTERSECT SELECT {norm('text')} FROM benchmark)"

Q["audit_sample"] = lambda s, d: P.audit_sample(split(s, d).filter("split = 'train'"), 60, "doc_id").select("doc_id", "label")
O["audit_sample"] = f"""WITH {RATED}, {_SPLIT}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('31:' || doc_id), doc_id) AS r, (SELECT count(DISTINCT label) FROM split WHERE split = 'train') AS c FROM split WHERE split = 'train')
SELECT doc_id, label FROM r WHERE r <= greatest(1, 60 // c)"""

Q["split_manifest"] = lambda s, d: P.manifest(split(s, d))
O["split_manifest"] = f"""WITH {RATED}, {_SPLIT}, h AS (SELECT split, sha256({norm('text')} || chr(9) || label) AS h FROM split),
p AS (SELECT split, left(h, 2) AS p, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY ALL) SELECT split, cast(sum(n) AS bigint) AS n, sha256(string_agg(p || h, chr(10) ORDER BY p || h)) AS sha256 FROM p GROUP BY split"""

_SCR = r"""w AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x85\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM w), m AS (SELECT doc_id, list(x ORDER BY md5('17:' || doc_id || ':' || i), x) AS m FROM e GROUP BY doc_id),
s AS (SELECT doc_id, text, w, CASE WHEN len(w) >= 3 THEN array_to_string(m, ' ') ELSE text END AS s FROM w LEFT JOIN m USING (doc_id))"""
Q["scramble_text"] = lambda s, d: table(s, d, "documents").select("doc_id", F.md5(P.scramble(F.col("text"), "17", F.col("doc_id"))).alias("h"))
O["scramble_text"] = f"WITH {_SCR} SELECT doc_id, md5(s) AS h FROM s"
Q["scramble_invariants"] = lambda s, d: P.scramble_invariants(table(s, d, "documents"), "doc_id")
O["scramble_invariants"] = f"WITH {_SCR} SELECT count(*) AS n, count(*) FILTER (WHERE s <> text) AS n_changed, count(*) AS n_multiset_kept FROM s"

Q["positional_cut"] = lambda s, d: P.positional_cut(table(s, d, "documents").select("doc_id"), "doc_id")
O["positional_cut"] = "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(cast(0.9 AS double) * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split FROM documents"

Q["candidate_profile"] = lambda s, d: P.candidate_profile(rated(s, d), "lang")
O["candidate_profile"] = f"""WITH {RATED}, k AS (SELECT lang, {norm('text')} AS k, min(label) AS lo, max(label) AS hi, count(*) AS c FROM rated GROUP BY ALL), l AS (SELECT lang, lo AS label, count(*) AS n FROM k WHERE lo = hi GROUP BY ALL),
x AS (SELECT lang, (SELECT cast(sum(c) AS bigint) FROM k WHERE k.lang = l.lang) AS rows_raw, cast(sum(n) AS bigint) AS rows_after_dedup, count(*) AS n_classes, round(cast(max(n) AS double) / sum(n), 4) AS majority_share, cast(max(n) AS double) / sum(n) <= 0.9 AS majority_ok FROM l GROUP BY lang)
SELECT *, rows_after_dedup >= 10000 AS rows_ok, n_classes >= 2 AS classes_ok, rows_after_dedup >= 10000 AND n_classes >= 2 AND majority_ok AS passes_without_headroom FROM x"""

Q["headroom"] = lambda s, d: L.headroom(rated(s, d), "lang", "doc_id")


def verdicts(s, d):
    """Each source as a candidate, whole verdict; none of them is gated."""
    x = rated(s, d)
    return P.candidate_profile(x, "source", scores=L.headroom(x, "source", "doc_id").select("source", "headroom", F.lit(False).alias("gated")))


Q["candidate_verdict"] = verdicts

Q["source_by_label"] = lambda s, d: P.top_source_by_label(rated(s, d), "source")
O["source_by_label"] = f"""WITH {RATED}, b AS (SELECT label, source, count(*) AS n FROM rated GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, source) AS r, sum(n) OVER (PARTITION BY label) AS a, count(*) OVER (PARTITION BY label) AS n_sources FROM b)
SELECT label, source AS top_source, round(cast(n AS double) / a, 4) AS top_share, n_sources FROM r WHERE r = 1"""

Q["marker_scan"] = lambda s, d: P.marker_counts(table(s, d, "documents"))
O["marker_scan"] = f"SELECT marker, count(*) FILTER (WHERE contains(lower(text), marker)) AS n FROM documents, (SELECT unnest({P.MARKERS!r}) AS marker) GROUP BY marker"

Q["eval_text"] = lambda s, d: eval_text(split(s, d).filter("split = 'train'"), "doc_id").select("doc_id", F.md5("text").alias("h"), "provenance")
O["eval_text"] = f"WITH {RATED}, {_SPLIT} SELECT doc_id, md5(text) AS h, 'train sample, seed 17' AS provenance FROM split WHERE split = 'train' AND length(text) >= 40 ORDER BY md5('17:' || doc_id), doc_id LIMIT 300"
