"""What several sources have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import induced, nodes_of


def tagged(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """All sources as one table with a column `source`; equal rows of a source collapse."""
    out = None
    for name, df in sources.items():
        one = df.select(*keys, F.lit(name).alias("source"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def venn(items: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(one 0/1 column per source, n): how many items have each pattern of sources."""
    own = items.groupBy(*keys).agg(*[F.max(F.when(F.col("source") == n, 1).otherwise(0)).cast("long").alias(n) for n in names])
    return own.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def venn_weights(patterns: DataFrame, names: list[str]) -> DataFrame:
    """(pattern, n): patterns as text, first source first."""
    return patterns.select(F.concat(*[F.col(n).cast("string") for n in names]).alias("pattern"), "n")


def pair_overlap(items: DataFrame, keys: list[str]) -> DataFrame:
    """(x, y, size_x, size_y, size_xy) for each pair of sources x < y; one self-join for all pairs."""
    size = items.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    both = items.select(*keys, F.col("source").alias("x")).join(items.select(*keys, F.col("source").alias("y")), keys).filter("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("size_xy"))
    pairs = size.select(F.col("source").alias("x"), F.col("n").alias("size_x")).crossJoin(size.select(F.col("source").alias("y"), F.col("n").alias("size_y"))).filter("x < y")  # sources, not items
    return pairs.join(both, ["x", "y"], "left").select("x", "y", "size_x", "size_y", F.coalesce("size_xy", F.lit(0)).alias("size_xy"))


def edge_overlap(networks: DataFrame) -> DataFrame:
    """networks (net, a, b) -> (x, y, size_x, size_y, shared_x, shared_y, size_xy): edges of each, edges of
    each between nodes of both, and edges of both, for each pair x < y."""
    ends = networks.select("net", F.explode(F.array("a", "b")).alias("node")).distinct()
    nets = networks.groupBy("net").agg(F.count(F.lit(1)).alias("n"))
    other = lambda node: ends.select(F.col("net").alias("other"), F.col("node").alias(node))
    inside = networks.join(other("a"), "a").join(other("b"), ["b", "other"]).filter("net <> other").groupBy("net", "other").agg(F.count(F.lit(1)).alias("k"))
    same = networks.select("a", "b", F.col("net").alias("x")).join(networks.select("a", "b", F.col("net").alias("y")), ["a", "b"]).filter("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("size_xy"))
    pairs = nets.select(F.col("net").alias("x"), F.col("n").alias("size_x")).crossJoin(nets.select(F.col("net").alias("y"), F.col("n").alias("size_y"))).filter("x < y")
    sx = inside.select(F.col("net").alias("x"), F.col("other").alias("y"), F.col("k").alias("shared_x"))
    sy = inside.select(F.col("net").alias("y"), F.col("other").alias("x"), F.col("k").alias("shared_y"))
    out = pairs.join(sx, ["x", "y"], "left").join(sy, ["x", "y"], "left").join(same, ["x", "y"], "left")
    return out.na.fill(0, ["shared_x", "shared_y", "size_xy"])


def coverage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: nodes and edges of a network, and how many of each a node set covers."""
    ends = nodes_of(edges)
    a = ends.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
    b = ends.join(nodes.select("node").distinct(), "node", "left_semi").agg(F.count(F.lit(1)).alias("covered_nodes"))
    return a.crossJoin(b).crossJoin(induced(edges, nodes).agg(F.count(F.lit(1)).alias("covered_edges")))


def overlap_percent(pairs: DataFrame) -> DataFrame:
    return pairs.select("*", (100.0 * F.try_divide("size_xy", "size_x")).alias("percent_x"), (100.0 * F.try_divide("size_xy", "size_y")).alias("percent_y"))


def pairwise_coverage(networks: DataFrame, members: DataFrame) -> DataFrame:
    """networks (net, a, b), members (node, ctx, present) -> (net, ctx, covered_nodes, covered_edges): how many
    nodes and edges of every network every context covers."""
    live = members.filter("present <> 0").select("node", "ctx").distinct()
    ends = networks.select("net", F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = ends.join(live, "node").groupBy("net", "ctx").agg(F.count(F.lit(1)).alias("covered_nodes"))
    both = networks.join(live.select(F.col("node").alias("a"), "ctx"), "a").join(live.select(F.col("node").alias("b"), "ctx"), ["b", "ctx"])
    edges = both.groupBy("net", "ctx").agg(F.count(F.lit(1)).alias("covered_edges"))
    return nodes.join(edges, ["net", "ctx"], "left").na.fill(0, ["covered_edges"])
