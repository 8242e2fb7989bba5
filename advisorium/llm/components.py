"""Pairwise matches consolidated into groups: large-star and small-star rewrites of the edges until unchanged.

Edges point from a larger to a smaller identifier. The large star links every larger neighbour of a node to the
smallest node of its neighbourhood; the small star links the smaller neighbours and the node itself to it. In the
end every edge leads to the smallest identifier of its component. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from advisorium.session import Workspace

#: A node with more than this share of all edges is hot; there are at most 1 / share such nodes.
HOT_SHARE = 1 / 2000
MAX_ROUNDS = 100


def links(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Edges (u, v) with u > v from pairs in any direction; self-pairs and pairs with a null end give none."""
    return pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _with_smallest(edges: DataFrame, node: str, total: int) -> DataFrame:
    """``edges`` (node, other) with the smallest ``other`` of each node, which may be the node itself, as ``m``.

    All edges of a node meet in one window, so that they are shuffled once. That would send a hot node's to one task:
    its smallest neighbour is aggregated with partial results instead and looked up by broadcast. Each hot node holds
    more than a fixed share of the edges, hence there are at most ``1 / HOT_SHARE`` of them.
    """
    own = F.least(F.min("other").over(Window.partitionBy(node)), node)
    threshold = max(100_000, int(total * HOT_SHARE))
    if total <= threshold:
        return edges.withColumn("m", own)
    smallest = edges.groupBy(node).agg(F.min("other").alias("low"), F.count("*").alias("degree")).filter(F.col("degree") > threshold)
    hot = F.broadcast(smallest.select(node, F.least("low", node).alias("hot_m")))
    marked = edges.join(hot, node, "left")
    return marked.filter("hot_m is not null").withColumnRenamed("hot_m", "m").unionByName(marked.filter("hot_m is null").drop("hot_m").withColumn("m", own))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    starred = _with_smallest(both, "node", 2 * total)
    return starred.filter(F.col("other") > F.col("node")).select(F.col("other").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """The smaller neighbours of a node, and the node, are linked to the smallest of them."""
    starred = _with_smallest(edges.select(F.col("u").alias("node"), F.col("v").alias("other")), "node", total)
    moved = starred.filter(F.col("other") != F.col("m")).select(F.col("other").alias("u"), F.col("m").alias("v"))
    own = starred.select(F.col("node").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(own).distinct()


def _stored(work: Workspace, edges: DataFrame, label: str) -> tuple[DataFrame, tuple[int, int]]:
    """Edges written to the shared folder, with their number and a sum of their hashes, which tell whether a round
    changed anything; both are observed while the edges are written."""
    seen = Observation()
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    stored = work.store(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")), label, keep=2)
    return stored, (seen.get["n"] or 0, int(seen.get["h"] or 0))


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """Members of components with at least one edge, except the smallest of each: u, v (the smallest).

    Rounds follow the logarithm of the longest path. A round that changes nothing ends the loop; no end within
    ``MAX_ROUNDS`` is an error.
    """
    work = Workspace(edges.sparkSession, name)
    now, mark = _stored(work, edges, "edges")
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            return now
        wide = work.store(large_star(now, mark[0]), "large", keep=2)
        now, new = _stored(work, small_star(wide, mark[0]), "small")
        if new == mark:
            return now
        mark = new
    raise RuntimeError(f"{name}: still changing after {MAX_ROUNDS} rounds")


def groups(nodes: DataFrame, edges: DataFrame, name: str = "components") -> DataFrame:
    """Every identifier of ``nodes`` (identifier) with the smallest identifier of its group: identifier, group_id.

    Identifiers without an edge are their own group; null identifiers give no row, repeated ones a single row.
    """
    linked = connected(edges, name).select(F.col("u").alias("identifier"), F.col("v").alias("group_id"))
    return nodes.filter("identifier is not null").distinct().join(linked, "identifier", "left").select("identifier", F.coalesce("group_id", "identifier").alias("group_id"))


def group_sizes(assigned: DataFrame) -> DataFrame:
    """How many groups there are of each size: size, n_groups."""
    return assigned.groupBy("group_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def exploded_links(own: Column, others: Column) -> Column:
    """Pairs of an identifier with each of its row's aliases, as an array of structs a, b."""
    return F.transform(others, lambda o: F.struct(own.alias("a"), o.alias("b")))
