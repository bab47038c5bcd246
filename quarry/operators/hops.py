"""Primitives of graph traversal: the undirected edge view, a hop, top-k and tiers.

A frontier is a frame with `at` (the node reached), `ids` (nodes so far) and `eids`
(edges so far) next to any columns that travel along. All hops are equi-joins on node
ids, so Spark picks the join by size, and splits hub nodes by AQE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges_bi(edges: DataFrame) -> DataFrame:
    """edge_id, a_id, rel, b_id, dir: each edge from both ends; a self-loop once. With a_kind and b_kind, where edges say what kinds their ends are of."""
    return turned(edges, "out").unionByName(turned(edges.filter("src_id <> dst_id"), "in"))


def turned(edges: DataFrame, way: str) -> DataFrame:
    """Edges as links from their source (out) or to it (in)."""
    a, b = ("src", "dst") if way == "out" else ("dst", "src")
    kinds = [F.col(f"{a}_kind").alias("a_kind"), F.col(f"{b}_kind").alias("b_kind")] if "src_kind" in edges.columns else []
    return edges.select("edge_id", F.col(f"{a}_id").alias("a_id"), "rel", F.col(f"{b}_id").alias("b_id"), F.lit(way).alias("dir"), *kinds)


def between(links: DataFrame, a: list[str] | None = None, b: list[str] | None = None) -> DataFrame:
    """Links but for those whose kinds of ends bear none of the labels; all, where links don't say. Nodes are not looked up."""
    for end, labels in (("a_kind", a), ("b_kind", b)):
        if labels and end in links.columns:
            links = links.filter(F.arrays_overlap(F.split(end, r"\+"), F.array(*map(F.lit, labels))))
    return links


def leaving(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links but for those that start at a kind that none of these nodes is of; all, where links or nodes don't say. Kinds are few."""
    if "kind" not in nodes.columns or "a_kind" not in links.columns:
        return links
    return links.filter(F.col("a_kind").isin([r["kind"] for r in nodes.select("kind").distinct().collect()]))


def start(rows: DataFrame, at: str = "node_id") -> DataFrame:
    """A frontier at the nodes of rows."""
    return rows.withColumns({"at": F.col(at), "ids": F.array(F.col(at)), "eids": F.array().cast("array<string>")})


def hop(frontier: DataFrame, links: DataFrame, rel: Column | str | None = None, direction: str | Column | None = None, unique_edges: bool = True, keep_rel: str | None = None) -> DataFrame:
    """One step over links (edge_id, a_id, rel, b_id, dir).

    rel: a name, or a column of the frontier, or None for any. direction: out or in, or a
    column of the frontier. unique_edges: no edge twice (one MATCH clause). keep_rel: array
    column of the frontier that the relation is appended to.
    """
    e = links.select(F.col("edge_id").alias("_e"), F.col("a_id").alias("_a"), F.col("rel").alias("_rel"), F.col("b_id").alias("_b"), F.col("dir").alias("_dir"))
    if isinstance(rel, str):
        e, rel = e.filter(F.col("_rel") == rel), None
    if isinstance(direction, str):
        e, direction = e.filter(F.col("_dir") == direction), None
    on = frontier["at"] == F.col("_a")
    if rel is not None:
        on = on & (rel == F.col("_rel"))
    if direction is not None:
        on = on & (direction == F.col("_dir"))
    out = frontier.join(e, on)
    if unique_edges:
        out = out.filter(~F.array_contains("eids", F.col("_e")))
    new = {"at": F.col("_b"), "ids": F.array_append("ids", F.col("_b")), "eids": F.array_append("eids", F.col("_e"))}
    if keep_rel:
        new[keep_rel] = F.array_append(F.col(keep_rel), F.col("_rel"))
    return out.withColumns(new).drop("_e", "_a", "_b", "_dir", "_rel")


def labelled(frontier: DataFrame, nodes: DataFrame, label: Column | str | None) -> DataFrame:
    """Keep frontier rows whose node bears the label (a name or a column)."""
    n = nodes.select(F.col("node_id").alias("_n"), F.col("labels").alias("_labels"))
    if isinstance(label, str):
        return frontier.join(n.filter(F.array_contains("_labels", label)).select("_n"), F.col("at") == F.col("_n"), "left_semi")
    return frontier.join(n, F.col("at") == F.col("_n")).filter(F.array_contains(F.col("_labels"), label)).drop("_n", "_labels")


def apart(pairs: list[tuple[int, int]]) -> Column:
    """Node inequalities between positions of ids."""
    return reduce(lambda x, y: x & y, [F.get("ids", F.lit(i)) != F.get("ids", F.lit(j)) for i, j in pairs], F.lit(True))


def named(frontier: DataFrame, nodes: DataFrame, out: str = "name") -> DataFrame:
    """Adds the reached node's name; rows without a name go."""
    n = nodes.select(F.col("node_id").alias("_n"), F.col("name").alias(out)).filter(F.col(out) != "")
    return frontier.join(n, F.col("at") == F.col("_n")).drop("_n")


def top_k(df: DataFrame, by: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """First k rows of each group."""
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def first_tier(frames: list[DataFrame], by: list[str]) -> DataFrame:
    """Rows of the first frame that has any for the group; adds tier (from 1)."""
    both = reduce(DataFrame.unionByName, [f.withColumn("tier", F.lit(i)) for i, f in enumerate(frames, 1)])
    least = F.min("tier").over(Window.partitionBy(*by))
    return both.withColumn("_least", least).filter("tier = _least").drop("_least")
