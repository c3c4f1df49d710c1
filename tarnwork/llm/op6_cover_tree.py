"""Embedding near-dedup by cover trees and dual traversal: all pairs of one label at or above a cosine, exactly.

Equal vectors of a label are one class with a count. A label's classes are dealt by a hash to parts of
bounded size, and each pair of parts (a part with itself as well) is a task. A task builds a cover tree
on each part: nested levels of centres whose radii halve, each node with the actual radius that covers
its members. Both trees are descended together; a pair of nodes goes no further when their centres are
farther apart than both radii and the distance at the threshold. What is left are pairs of leaves, whose
members are compared by their cosines in double precision. Tasks return counts of links and, for
connections, each vector with one representative, never the pairs.

The number of tasks of a label grows with the square of its parts: in high dimension no bound prunes
unrelated vectors before they are compared once. Radii are checked with a margin for rounding.

Vectors that are null, zero or hold null or non-finite components, or have a null label, link with
nothing; vectors of one label but different lengths don't link either. Rows that repeat an id are one
vector with the links of all its rows, and each row counts as a link of its equals. Rows without an id
are returned without links and component. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.llm import common, graph

THRESHOLD = 0.98
#: Classes in a part.
PART = 2048
#: Members of a node that isn't divided further.
LEAF = 16
#: Room for rounding in distances.
MARGIN = 1e-9


class Node:
    __slots__ = ("centre", "radius", "members", "children")

    def __init__(self, centre: int, radius: float, members: np.ndarray):
        self.centre, self.radius, self.members, self.children = centre, radius, members, []


def cover_tree(x: np.ndarray, small: float) -> Node:
    """A tree over unit vectors; nodes within ``small`` aren't divided."""
    members = np.arange(len(x))
    d = _distances(x, x[:1])[:, 0]
    root = Node(0, float(d.max()), members)
    todo = [(root, root.radius)]
    while todo:
        node, level = todo.pop()
        if len(node.members) <= LEAF or node.radius <= small:
            continue
        half = min(level, node.radius) / 2
        left = node.members
        next_centre = node.centre  # the levels are nested: a centre stays one
        while len(left):
            d = _distances(x[left], x[next_centre : next_centre + 1])[:, 0]
            d[left == next_centre] = 0.0
            near = d <= half
            child = Node(next_centre, float(d[near].max()), left[near])
            node.children.append(child)
            todo.append((child, half))
            left = left[~near]
            if len(left):
                next_centre = int(left[0])
    return root


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def dual_links(x: np.ndarray, tree_x: Node, y: np.ndarray, tree_y: Node, threshold: float, same: bool):
    """Yields (rows of x, rows of y) of linked pairs; with ``same`` each pair of a part once."""
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + MARGIN
    todo = [(tree_x, tree_y)]
    while todo:
        a, b = todo.pop()
        if not a.children and not b.children:
            c = x[a.members] @ y[b.members].T >= threshold
            i, j = np.nonzero(c)
            i, j = a.members[i], b.members[j]
            if same and a is b:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        down_a = a.children if a.children and (a.radius >= b.radius or not b.children or a is b) else [a]
        down_b = b.children if b.children and (b.radius > a.radius or not a.children or a is b) else [b]
        d = _distances(x[[n.centre for n in down_a]], y[[n.centre for n in down_b]])
        far = np.array([n.radius for n in down_a])[:, None] + np.array([n.radius for n in down_b])[None, :] + reach
        p, q = np.nonzero(d <= far)
        if same and a is b:
            p, q = p[p <= q], q[p <= q]
        todo += [(down_a[i], down_b[j]) for i, j in zip(p.tolist(), q.tolist())]


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Smallest label along links, in place."""
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum(label, label[label], out=label)
        if (label == before).all():
            return


def _task(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        own = table["own"].to_numpy()
        order = np.lexsort((table["rep"].to_numpy(), own))
        rep, count, own = table["rep"].to_numpy()[order], table["m"].to_numpy()[order], own[order]
        flat = table["embedding"].combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1)[order]
        large = np.abs(x).max(axis=1)
        far = (large < 1e-100) | (large > 1e100)  # whose squares would be lost or infinite
        x[far] /= large[far, None]
        x = x / np.linalg.norm(x, axis=1)[:, None]
        small = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) / 2
        n = int((own == i).sum())
        if n == 0 or n == len(x) and i != j:
            return table.select(["rep"]).slice(0, 0).append_column("root", pa.array([], pa.int64())).append_column("links", pa.array([], pa.int64()))
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        a = cover_tree(x[:n], small)
        found = dual_links(x, a, x, a, threshold, True) if i == j else dual_links(x[:n], a, x[n:], cover_tree(x[n:], small), threshold, False)
        ends: list[list[np.ndarray]] = [[], []]
        for p, q in found:
            q = q if i == j else q + n
            np.add.at(links, p, count[q])
            np.add.at(links, q, count[p])
            ends[0].append(p)
            ends[1].append(q)
        if ends[0]:
            _connect(label, np.concatenate(ends[0]), np.concatenate(ends[1]))
        some = links > 0
        return pa.table({"rep": rep[some], "root": rep[label[some]], "links": links[some]})

    return run


def dedup(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"), F.col(label_col).alias("label"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = common.materialise(classes.withColumn("dim", F.size("embedding")), "classes")
    parts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / part).cast("int").alias("k"))
    dealt = classes.join(parts, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("label", "dim", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "rep", "m", "embedding")
    found = dealt.groupBy("label", "dim", "i", "j").applyInArrow(_task(threshold), "rep long, root long, links long")
    found = common.materialise(found, "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("more"))
    comps = graph.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(classes.select(F.col("rep").alias("a"), F.col("rep").alias("b"))), loops=True)
    placed = classes.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep").select("label", "embedding", F.col("m"), (F.col("m") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "comp")
    # rows of a class, and classes that share an id, are one
    out = good.join(placed, ["label", "embedding"]).select("vec_id", "n_links", "comp")
    rest = rows.join(out.select("vec_id").distinct(), "vec_id", "left_anti")
    ids = out.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("comp").alias("comp"))
    whole = rows.select("vec_id").join(ids, "vec_id").unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("comp")))
    return whole.select("vec_id", "n_links", F.col("comp").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("comp"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS MATERIALIZED (SELECT vec_id, label, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) >= {THRESHOLD}),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN c ON x = vec_id LEFT JOIN n ON a = vec_id"""
