"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored

#: Edges that a task joins into trees at once, and nodes of trees that it holds at most.
CHUNK, HELD = 1 << 22, 1 << 22


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of edges in memory that is not the smallest of its component."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, x, y = np.arange(len(names)), ends[: len(a)], ends[len(a) :]
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))  # x and y are roots, so trees only grow downwards
        while True:
            top = up[up]
            if (top == up).all():
                break
            up = top
        x, y = up[x], up[y]
        apart = x != y
        x, y = x[apart], y[apart]
    below = np.flatnonzero(up != np.arange(len(names)))
    return names[below], names[up[below]]


def _trees(keyed: bool):
    """Of edges ([key], a, b), rows ([key], u, v) that connect what a task's edges connect: of each of its components every node
    with the smallest."""

    def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        key, a, b = (np.concatenate(side) for side in zip(*parts))
        order = np.argsort(key, kind="stable") if keyed else slice(None)
        key, a, b = key[order], a[order], b[order]
        cut = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)).tolist()
        trees = [(key[i:j], *roots(a[i:j], b[i:j])) for i, j in zip(cut, [*cut[1:], len(key)])]
        return [np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*[(k[: len(u)], u, v) for k, u, v in trees])] or [np.zeros(0, np.int64)] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x[0 if keyed else 1 :]], ["key", "u", "v"][0 if keyed else 1 :])
        held, size = [[np.zeros(0, np.int64)] * 3], 0
        for batch in batches:
            *key, a, b = (c.to_numpy() for c in batch.columns)
            held.append([*key, a, b] if keyed else [np.zeros(len(a), np.int64), a, b])
            size += len(a)
            if size >= CHUNK:
                held, size = [joined(held)], 0
                if len(held[0][0]) > HELD:
                    yield row(held[0])
                    held = [[np.zeros(0, np.int64)] * 3]
        yield row(joined(held))

    return run


def connected_components(edges: DataFrame, key: str | None = None) -> DataFrame:
    """([key,] node, root) for every node of edges ([key,] a, b: long) that is not the smallest of its component; a key tells networks apart.

    Tasks first join their own edges into trees, so that rounds have rows of nodes and not of edges. Each round is
    joins and minima over this table, written to the shared folder; rounds grow
    with the logarithm of a component's size. Nothing but a checksum reaches the driver.
    """
    k = ["key"] if key else []
    plain = edges.filter("a <> b").select(*[F.col(c).cast("long").alias(x) for c, x in zip([*([key] if key else []), "a", "b"], [*k, "a", "b"])])
    now = stored(plain.mapInArrow(_trees(bool(key)), ", ".join(f"{c} long" for c in [*k, "u", "v"])).distinct(), "components")
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(20,0)"))).first())
    before = sign(now)
    while before[0]:
        both = now.select(*k, F.col("u").alias("a"), F.col("v").alias("b")).union(now.select(*k, "v", "u"))
        # minima are stored, so that the join sees two plain exchanges and can split a hub's edges
        low = stored(both.groupBy(*k, "a").agg(F.min("b").alias("m")).select(*k, "a", F.least("a", "m").alias("m")), "components-low")
        large = both.join(low, [*k, "a"]).filter("b > a").select(*k, F.col("b").alias("u"), F.col("m").alias("v"))
        large = stored(large, "components-large")
        least = stored(large.groupBy(*k, "u").agg(F.min("v").alias("m")), "components-least")
        small = large.join(least, [*k, "u"]).filter("v <> m").select(*k, F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = stored(small.distinct(), "components")
        after = sign(now)
        if after == before:
            break
        before = after
    return now.select(*[F.col("key").alias(key)] if key else [], F.col("u").alias("node"), F.col("v").alias("root"))


def component_labels(nodes: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node of each node's component, isolated nodes included; found: connected_components(edges), if known."""
    found = connected_components(edges) if found is None else found
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
