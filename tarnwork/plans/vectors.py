"""Queries of embedding operators. Donor space: the first 40 components; base space: the other 24; anchors: ids not divisible by 3."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnwork.functions import tables
from tarnwork.operators import vectors as X
from tarnwork.plans.common import table
from tarnwork.sources import tensors

Q: dict = {}
O: dict[str, str] = {}

K = 5


def _space(s, d, a, n):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", a, n), lambda x: x.cast("double")).alias("vec"))


def donor(s, d):
    return _space(s, d, 1, 40)


def base(s, d):
    return _space(s, d, 41, 24)


ANCHOR = "id % 3 <> 0"


def top(s, d):
    v = donor(s, d)
    return X.cosine_topk(v.filter(f"NOT ({ANCHOR})"), v.filter(ANCHOR), K)


def made(s, d):
    return X.transfer(X.mean_weights(top(s, d), K), base(s, d))


_E = """don AS (SELECT vec_id AS id, list_transform(embedding[1:40], lambda x: cast(x AS double)) AS vec FROM embeddings), bas AS (SELECT vec_id AS id, list_transform(embedding[41:64], lambda x: cast(x AS double)) AS vec FROM embeddings),
sim AS (SELECT t.id, a.id AS anchor_id, round(list_cosine_similarity(t.vec, a.vec), 9) AS cosine FROM don t, don a WHERE t.id % 3 = 0 AND a.id % 3 <> 0),
top AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, anchor_id) AS rank FROM sim QUALIFY rank <= 5),
md AS (SELECT id, i, sum(x / 5) AS y FROM (SELECT top.id, unnest(bas.vec) AS x, generate_subscripts(bas.vec, 1) AS i FROM top JOIN bas ON bas.id = top.anchor_id) GROUP BY ALL),
made AS (SELECT id, list(y ORDER BY i) AS vec FROM md GROUP BY id)"""

Q["cosine_topk"] = lambda s, d: top(s, d).select("id", "rank", "anchor_id", F.round("cosine", 6).alias("cosine"))
O["cosine_topk"] = f"WITH {_E} SELECT id, rank, anchor_id, round(cosine, 6) AS cosine FROM top"
Q["mean_transfer"] = lambda s, d: made(s, d).select("id", F.posexplode("vec").alias("i", "x")).select("id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
O["mean_transfer"] = f"WITH {_E} SELECT id, i - 1 AS i, round(y, 6) AS x FROM md"


def report(s, d):
    b = base(s, d)
    rows = b.withColumn("part", F.when(F.expr(ANCHOR), "anchor").otherwise("original")).unionByName(made(s, d).withColumn("part", F.lit("reconstructed")))
    return X.norm_report(rows, "part")


_R = f"""{_E}, al AS (SELECT CASE WHEN id % 3 <> 0 THEN 'anchor' ELSE 'original' END AS part, vec FROM bas UNION ALL SELECT 'reconstructed', vec FROM made), nn AS (SELECT part, sqrt(list_dot_product(vec, vec)) AS n FROM al),
rep AS (SELECT part, count(*) AS "rows", round(median(n), 4) AS median, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS sd, round(min(n), 4) AS min, round(max(n), 4) AS max FROM nn GROUP BY part)"""
Q["norm_report"] = report
O["norm_report"] = f"WITH {_R} SELECT * FROM rep"
Q["norm_health"] = lambda s, d: X.norm_health(report(s, d), "part", "reconstructed", "anchor")
O["norm_health"] = f"WITH {_R}, r AS (SELECT round((SELECT median FROM rep WHERE part = 'reconstructed') / (SELECT median FROM rep WHERE part = 'anchor'), 3) AS ratio) SELECT ratio, ratio BETWEEN 0.85 AND 1.15 AS healthy FROM r"
Q["rescale_rows"] = lambda s, d: X.rescale(made(s, d), base(s, d).filter(ANCHOR)).select("id", F.round(X.norm(F.col("vec")), 5).alias("norm"), F.round(F.get("vec", F.lit(0)), 5).alias("x0"))
O["rescale_rows"] = f"WITH {_E}, m AS (SELECT median(sqrt(list_dot_product(vec, vec))) AS m FROM bas WHERE id % 3 <> 0) SELECT id, round(m, 5) AS norm, round(vec[1] * m / sqrt(list_dot_product(vec, vec)), 5) AS x0 FROM made, m"
Q["assemble_matrix"] = lambda s, d: X.assemble(base(s, d).select("id"), base(s, d).filter(ANCHOR), base(s, d).filter("id IN (0, 1)"), made(s, d)).select("id", "origin", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))
O["assemble_matrix"] = f"WITH {_E} SELECT b.id, CASE WHEN b.id IN (0, 1) THEN 'special' WHEN b.id % 3 <> 0 THEN 'anchor' ELSE 'reconstructed' END AS origin, round(list_sum(CASE WHEN b.id IN (0, 1) OR b.id % 3 <> 0 THEN b.vec ELSE m.vec END), 5) AS total FROM bas b LEFT JOIN made m USING (id)"


def reread(s, d):
    """The embeddings through tensor files: written by the tasks that hold them, read back in ranges of rows."""
    path = f"{tables.shared(s)}/tensors-{uuid.uuid4().hex}"
    s.dataSource.register(tensors.TensorRows)
    table(s, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("float")).alias("vec")).write.format("tensor_rows").mode("append").save(path)
    return s.read.format("tensor_rows").load(path)


Q["tensor_rows"] = lambda s, d: reread(s, d).select("id", F.size("vec").alias("width"), F.round(X.norm(F.col("vec")), 6).alias("norm"), F.round(F.get(X.normalise(F.col("vec")), 0), 6).alias("first"))
O["tensor_rows"] = """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: cast(cast(x AS float) AS double)) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT id, cast(len(v) AS int) AS width, round(n, 6) AS norm, round(v[1] / greatest(n, 1e-8), 6) AS first FROM n"""


def omp(s, d):
    v = donor(s, d)
    return X.omp_weights(v.filter(f"NOT ({ANCHOR})"), v.filter(ANCHOR), 6, 32)


Q["omp_transfer"] = lambda s, d: X.transfer(omp(s, d).select("id", "anchor_id", "w"), base(s, d)).select("id", F.round(X.norm(F.col("vec")), 6).alias("norm"))
Q["omp_reconstruction"] = lambda s, d: X.reconstruction(omp(s, d))
Q["random_coef_weights"] = lambda s, d: X.random_weights(top(s, d), 3, "17")


def reports(s, d):
    """A report on each label's remade vectors as if it were a base of its own; the change in bits is a stand-in, one less the mean of the nearest anchors' cosines, measured on another artefact for every fourth label."""
    e = table(s, d, "embeddings").filter("label IS NOT NULL").select(F.col("vec_id").alias("id"), "label")
    kept = F.expr(ANCHOR)
    n = e.groupBy("label").agg(F.count_if(kept).alias("n_anchor"), F.count_if(~kept).alias("n_unfamiliar"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    old = base(s, d).filter(ANCHOR).join(e, "id").groupBy("label").agg(F.avg(norm).alias("o"))
    new = made(s, d).join(e, "id").groupBy("label").agg(F.avg(norm).alias("m"))
    near = top(s, d).filter("rank = 1").join(e, "id").groupBy("label").agg(F.round(F.avg("cosine"), 4).alias("mean_cosine"))
    ratio = F.round(F.col("m") / F.col("o"), 3)
    j = n.join(old, "label").join(new, "label").join(near, "label")
    return j.select(F.col("label").cast("string").alias("base"), F.lit("t").alias("tag"), "n_anchor", "n_unfamiliar", F.when(F.col("label") % 4 == 0, "old").otherwise("t").alias("measured_tag"), F.round(1 - F.col("mean_cosine"), 4).alias("delta_bpc"), ratio.alias("norm_ratio"), ratio.between(0.45, 1.15).alias("healthy"), "mean_cosine")


Q["cross_base_quality"] = lambda s, d: X.cross_base(reports(s, d))
O["cross_base_quality"] = f"""WITH {_E}, lb AS (SELECT vec_id AS id, label FROM embeddings WHERE label IS NOT NULL), n AS (SELECT label, count(*) FILTER (WHERE id % 3 <> 0) AS a, count(*) AS n FROM lb GROUP BY label),
o AS (SELECT label, avg(sqrt(list_dot_product(vec, vec))) AS o FROM bas JOIN lb USING (id) WHERE id % 3 <> 0 GROUP BY label), m AS (SELECT label, avg(sqrt(list_dot_product(vec, vec))) AS m FROM made JOIN lb USING (id) GROUP BY label),
c AS (SELECT label, round(avg(cosine), 4) AS mean_cosine FROM top JOIN lb USING (id) WHERE rank = 1 GROUP BY label),
r AS (SELECT cast(label AS varchar) AS base, round(cast(100 AS double) * a / n, 2) AS anchor_share_pct, mean_cosine, CASE WHEN label % 4 <> 0 THEN round(1 - mean_cosine, 4) END AS delta_bpc, label % 4 = 0 AS withheld, round(m / o, 3) AS norm_ratio, round(m / o, 3) BETWEEN 0.45 AND 1.15 AS healthy FROM n JOIN o USING (label) JOIN m USING (label) JOIN c USING (label)),
w AS (SELECT *, coalesce(delta_bpc = (SELECT max(delta_bpc) FROM r) AND (SELECT count(DISTINCT delta_bpc) FROM r) >= 2, false) AS worse FROM r)
SELECT *, CASE WHEN worse THEN NOT healthy AND (SELECT bool_or(healthy) FROM r) END AS corroborated FROM w"""
