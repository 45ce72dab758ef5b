"""Searches in blocks, against plain Python and against the searches of one task."""

import random

import numpy as np
import pandas as pd
import pytest

from quiltnet.functions import stats
from quiltnet.operators import blocks, components, graph, relational, traversal

from .test_graph import BRIDGE, edges, nodes, plain_bw, random_case, values


def adjacent(pairs, n):
    adj = {v: set() for v in n}
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    return adj


def plain_far(adj):
    """(longest distance, whether all reach all)."""
    deep, whole = 0, True
    for s in adj:
        dist, order = {s: 0}, [s]
        for u in order:
            for v in adj[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    order.append(v)
        deep, whole = max(deep, dist[order[-1]]), whole and len(dist) == len(adj)
    return deep, whole


def test_betweenness_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    n = 80  # parts of 20 nodes need two steps of FAN = 2
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(200)})
    monkeypatch.setattr(blocks, "FAN", 2)
    monkeypatch.setattr(blocks.Blocks.__init__, "__defaults__", (20,))
    e = edges(spark, [*pairs, (5, 5), pairs[0]])
    got = values(traversal.betweenness(e, nodes(spark, [*range(n), 500]), task_edges=0), "node", "betweenness")
    assert got == pytest.approx(plain_bw(adjacent(pairs, [*range(n), 500]), [*range(n), 500]), abs=1e-6)


def test_contexts_mix_both_ways(spark):
    pairs, mem = random_case(5)
    e, m = edges(spark, pairs), spark.createDataFrame(mem, "node long, ctx long, present long")
    n = nodes(spark, range(14))
    key = lambda df: {(r["ctx"], r["node"]): r["betweenness"] for r in df.collect()}
    want = key(traversal.betweenness(e, n, m))
    sizes = sorted(r["m"] for r in graph.context_edge_counts(e, m).collect())
    limit = sizes[len(sizes) // 2]
    assert key(traversal.betweenness(e, n, m, task_edges=limit)) == pytest.approx(want, abs=1e-9)
    far = lambda **k: {r["ctx"]: r["diameter"] for r in traversal.diameter(e, n, m, **k).collect()}
    assert far(task_edges=limit) == far()


def test_empty_network(spark):
    e = edges(spark, [])
    assert values(traversal.betweenness(e, nodes(spark, [1]), task_edges=0), "node", "betweenness") == {1: 0.0}
    assert traversal.diameter(e, nodes(spark, [1]), task_edges=0).first()[0] == 0


def test_diameter_needs_few_searches(spark):
    """A dense middle with tails: the searches are far fewer than the nodes."""
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(200), 2))) for _ in range(1500)} | {(k, k + 1) for k in range(199)}
    pairs |= {(0, 200), (7, 230)} | {(k, k + 1) for k in [*range(200, 204), *range(230, 233)]}
    per = edges(spark, sorted(pairs)).selectExpr("0L ctx", "a", "b")
    got, searches = blocks.farthest(per, part_nodes=40, first=2)
    want, whole = plain_far(adjacent(pairs, {x for p in pairs for x in p}))
    row = got.first()
    assert whole and row["deep"] == want and row["reached"] == row["n"]
    assert searches <= 20 < row["n"] / 10


@pytest.mark.parametrize("pairs", [[(k, (k + 1) % 9) for k in range(9)], BRIDGE, [(0, 1), (2, 3)], [(0, 1)]])
def test_diameters_of_small_shapes(spark, pairs):
    e = edges(spark, [tuple(sorted(p)) for p in pairs])
    deep, whole = plain_far(adjacent(pairs, {x for p in pairs for x in p}))
    assert traversal.diameter(e, graph.nodes_of(e), task_edges=0).first()[0] == (deep if whole else 0)


def test_look_up_against_plain_python(spark):
    rng = random.Random(6)
    keys = rng.sample(range(1000), 120)
    table = spark.createDataFrame([(float(k), k * 10) for k in keys] + [(None, 1)], "k double, v long")
    asked = [float(rng.randrange(-50, 1050)) for _ in range(400)] + [float(k) for k in keys] + [keys[0] * 1.0] * 300
    probes = spark.createDataFrame([(i, x) for i, x in enumerate([*asked, None])], "i long, x double")
    got = {r["i"]: (r["low"], r["high"]) for r in stats.look_up(probes, "x", table, "k", {"v": "low"}, {"k": "high"}).collect()}
    for i, x in enumerate(asked):
        less, more = [k for k in keys if k < x], [k for k in keys if k >= x]
        assert got[i] == (max(less) * 10 if less else None, min(more) if more else None)
    assert got[len(asked)] == (None, None) and len(got) == len(asked) + 1
    none = stats.look_up(probes, "x", table.limit(0), "k", {"v": "low"}, {"k": "high"})
    assert none.count() == len(got) and none.filter("low is not null or high is not null").isEmpty()


def test_coverage_curve_against_plain_python(spark):
    rng = random.Random(7)
    mem = [(v, c, 1) for v in range(40) for c in range(25) if rng.random() < (0.98 if c < 12 else 0.6)]
    measured = {c: {v for v, x, _ in mem if x == c} for c in range(25)}
    want = set()
    for level in {len(s) for s in measured.values()}:
        reach = [c for c in measured if len(measured[c]) >= level]
        n = len(set.intersection(*[measured[c] for c in reach]))
        want.add((level, len(reach), n, len(reach) * n))
    curve = relational.coverage_curve(spark.createDataFrame(mem, "node long, ctx long, present long"))
    assert {tuple(r) for r in curve.collect()} == want
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_a_search_reads_few_of_the_edges(monkeypatch):
    # before, every source read every edge: 256 sources read 256 times all of them
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3000, 60_000), rng.integers(0, 3000, 60_000)
    _, offsets, near = traversal._csr(a, b)
    read, plain = [0], traversal._neighbours

    def counted(*args):
        out = plain(*args)
        read[0] += len(out[2])
        return out

    monkeypatch.setattr(traversal, "_neighbours", counted)
    assert traversal.reach(offsets, near, np.arange(256)) == (3, 3000) and read[0] < 4 * len(near)
    read[0] = 0
    traversal.dependencies(offsets, near, np.arange(16))
    assert read[0] < 16 * 0.7 * len(near)


@pytest.mark.parametrize("n, m", [(30, 40), (200, 250), (300, 3000), (2000, 100), (50, 1200)])
def test_search_kernels_equal_plain_python(n, m):
    rng = np.random.default_rng(n)
    names, offsets, near = traversal._csr(rng.integers(0, n, m), rng.integers(0, n, m))
    some = range(0, len(names), 3)
    want, deep, least = np.zeros(len(names)), 0, len(names)
    for s in some:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for v in near[offsets[u] : offsets[u + 1]].tolist():
                if v not in dist:
                    dist[v], paths[v] = dist[u] + 1, 0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        owed = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[offsets[v] : offsets[v + 1]].tolist():
                if dist[u] == dist[v] - 1:
                    owed[u] += paths[u] / paths[v] * (1 + owed[v])
        for v in order[1:]:
            want[v] += owed[v]
        deep, least = max(deep, dist[order[-1]]), min(least, len(order))
    assert traversal.dependencies(offsets, near, np.array(some)) == pytest.approx(want)
    assert traversal.reach(offsets, near, np.array(some)) == (deep, least)


def test_a_large_family_is_not_copied_by_chunk(spark, monkeypatch):
    # before, every chunk of sources carried its whole subgraph through an exchange
    monkeypatch.setattr(traversal, "SHARED_BYTES", 0)
    monkeypatch.setattr(traversal, "SENT", 3)
    per = spark.range(100).selectExpr("id % 2 as ctx", "id as a", "id + 2 as b")
    got = traversal._over_sources(per, lambda ctx, names, offsets, near, sources: pd.DataFrame({"ctx": [ctx], "k": [len(sources)]}), "ctx long, k long", 1).toPandas()
    assert len(got) == 6 and got.groupby("ctx").k.sum().to_dict() == {0: 51, 1: 51}


def test_searches_store_no_levels(spark, monkeypatch):
    # before, every level of every search was written: a number for each pair of nodes
    kept, real = [], blocks.stored

    def counted(df, name, **k):
        out = real(df, name, **k)
        blobs = [c for c, t in out.dtypes if t == "binary"]
        kept.append(sum(sum(len(r[c] or b"") for c in blobs) for r in out.select(*blobs).collect()) if blobs else 0)
        return out

    monkeypatch.setattr(blocks, "stored", counted)
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(900)} | {(k, k + 1) for k in range(40)} | {(400 + k, 401 + k) for k in range(30)})
    ids = sorted({v for p in pairs for v in p})
    got = values(traversal.betweenness(edges(spark, pairs), nodes(spark, ids), task_edges=0), "node", "betweenness")
    assert got == pytest.approx(plain_bw(adjacent(pairs, ids), ids), abs=1e-6)  # the path takes more laps than the first job has
    assert sum(kept) < 300 * 300 * 4


def test_a_hub_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART_SPAN", 7)
    pairs = [(0, k) for k in range(1, 30)] + [(k, k + 1) for k in range(1, 29)]
    e = edges(spark, pairs)
    got = values(traversal.betweenness(e, nodes(spark, range(30)), task_edges=0), "node", "betweenness")
    assert got == pytest.approx(plain_bw(adjacent(pairs, range(30)), range(30)), abs=1e-6)


def test_a_diameter_stores_no_pairs(spark, monkeypatch):
    # before, each round wrote a row for each of its sources and every node
    rows, real = [], blocks.stored

    def counted(df, name, **k):
        out = real(df, name, **k)
        rows.append(out.count())
        return out

    monkeypatch.setattr(blocks, "stored", counted)
    ring = edges(spark, [tuple(sorted((k, (k + 1) % 50))) for k in range(50)])
    assert traversal.diameter(ring, graph.nodes_of(ring), task_edges=0).first()[0] == 25
    assert max(rows) <= 100


@pytest.mark.parametrize("task_edges", [0, traversal.TASK_EDGES])
def test_networks_that_are_not_connected_are_not_searched(spark, monkeypatch, task_edges):
    def never(*_, **__):
        raise AssertionError("searched")

    monkeypatch.setattr(traversal, "_over_sources", never)
    monkeypatch.setattr(traversal, "farthest", never)
    two = edges(spark, [(0, 1), (1, 2), (10, 11), (11, 12)])
    ids = nodes(spark, [0, 1, 2, 10, 11, 12])
    assert traversal.diameter(two, ids, task_edges=task_edges).first()[0] == 0
    mem = spark.createDataFrame([(v, c, 1) for v in (0, 2, 11, 12) for c in (0, 1)], "node long, ctx long, present long")
    assert {r["ctx"]: r["diameter"] for r in traversal.diameter(two, ids, mem, task_edges=task_edges).collect()} == {0: 0, 1: 0}


def test_components_of_several_networks(spark, monkeypatch):
    """Trees of tasks that hold few edges and few nodes at once."""
    monkeypatch.setattr(components, "CHUNK", 7)
    monkeypatch.setattr(components, "HELD", 5)
    rng = random.Random(8)
    rows = [(c, *rng.sample(range(60), 2)) for c in (3, 4) for _ in range(45)]
    per = spark.createDataFrame(rows, "net long, a long, b long").repartition(3)
    got = {(r["net"], r["node"]): r["root"] for r in components.connected_components(per, "net").collect()}
    for c in (3, 4):
        root = {v: v for v in range(60)}
        for _ in range(60):
            for k, a, b in rows:
                if k == c:
                    root[a] = root[b] = min(root[a], root[b])
        assert {v: r for (k, v), r in got.items() if k == c} == {v: r for v, r in root.items() if v != r}
        own = components.connected_components(per.filter(per.net == c).select("a", "b")).collect()
        assert {r["node"]: r["root"] for r in own} == {v: r for v, r in root.items() if v != r}


def test_sources_searched_together(monkeypatch):
    """A dense network with hubs and another component: tables read whole, from either side, and in rows of few neighbours."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 300, 6000), rng.integers(0, 300, 6000)
    a, b = np.r_[a, np.zeros(299, int), 400, 401], np.r_[b, np.arange(1, 300), 401, 402]
    names, offsets, near = traversal._csr(a, b)
    want = traversal._one_by_one(offsets, near, np.arange(len(names)))[0]
    calls, real = [], traversal._one_by_one
    monkeypatch.setattr(traversal, "_one_by_one", lambda o, x, s: calls.append(len(s)) or (*real(o, x, s)[:2], 10**9))
    for span, whole in ((256, 7), (16, 7), (16, 10**9), (256, 0)):
        monkeypatch.setattr(traversal, "SPAN", span)
        monkeypatch.setattr(traversal, "WHOLE", whole)
        assert traversal.dependencies(offsets, near, np.arange(len(names))) == pytest.approx(want, abs=1e-9)
    assert calls == [1] * 4
    monkeypatch.setattr(traversal, "LEAST_NODES", 1)
    parts = list(traversal._apart(names, offsets, near))
    assert [p[0].tolist() for p in parts] == [names[:-3].tolist(), [400, 401, 402]]
    got = np.concatenate([traversal.dependencies(o, x, np.arange(len(p))) for p, o, x in parts])
    assert got == pytest.approx(want, abs=1e-9)


def test_triangles_of_large_networks_by_component(spark, monkeypatch):
    """Edges of a network of many components go to few tasks; a connected one is dealt by colours as before."""
    monkeypatch.setattr(graph, "TASK_EDGES", 12)
    rng, dealt, real = random.Random(9), [], graph._in_bins
    monkeypatch.setattr(graph, "_in_bins", lambda *a: dealt.append(real(*a)) or dealt[-1])
    few = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(40)}
    for copies in (12, 1):
        pairs = {(a + 20 * k, b + 20 * k) for a, b in few for k in range(copies)} | ({(x, x + 1) for x in range(300)} if copies == 1 else set())
        adj = adjacent(pairs, {x for p in pairs for x in p})
        want = sorted((a, b, c) for a, b in pairs for c in adj[a] & adj[b] if c > b)
        got = graph.triangles(edges(spark, sorted(pairs)))
        assert sorted(tuple(sorted(r)) for r in got.collect()) == want and got.columns == ["x", "y", "z"]
    assert len(dealt) == 2 and dealt[0].select("bin").distinct().count() > 1 and dealt[1] is None
