import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quiltnet.operators import community, components, graph, traversal


def edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs] or [], "a long, b long")


def nodes(spark, n):
    return spark.createDataFrame([(k,) for k in n], "node long")


STAR = [(0, k) for k in range(1, 6)]
K4 = list(combinations(range(4), 2))
PATH = [(0, 1), (1, 2), (2, 3)]
BRIDGE = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_closed_forms(spark):
    bw = values(traversal.betweenness(edges(spark, STAR), nodes(spark, range(6)), sources_per_task=2), "node", "betweenness")
    assert bw == {0: 20.0} | {k: 0.0 for k in range(1, 6)}
    assert values(traversal.betweenness(edges(spark, PATH), nodes(spark, range(5))), "node", "betweenness") == {0: 0, 1: 4, 2: 4, 3: 0, 4: 0}
    assert set(values(traversal.betweenness(edges(spark, K4), nodes(spark, range(4))), "node", "betweenness").values()) == {0.0}
    assert set(values(graph.local_clustering(edges(spark, K4)), "node", "cc").values()) == {1.0}
    assert set(values(graph.local_clustering(edges(spark, STAR)), "node", "cc").values()) == {0.0}
    cl = spark.createDataFrame([(k, k // 3) for k in range(6)], "node long, cluster long")
    got = values(graph.modularity_per_cluster(edges(spark, BRIDGE), cl), "cluster", "modularity")
    assert got == pytest.approx({0: 3 / 7 - 0.25, 1: 3 / 7 - 0.25})
    with pytest.raises(Exception, match="modularity needs edges"):
        graph.modularity_per_cluster(edges(spark, []), cl).collect()
    assert traversal.diameter(edges(spark, PATH), nodes(spark, range(4))).first()[0] == 3
    assert traversal.diameter(edges(spark, PATH), nodes(spark, range(5))).first()[0] == 0
    d = {(r["s"], r["t"]): r["d"] for r in traversal.distances(edges(spark, PATH)).collect()}
    assert d[(0, 3)] == d[(3, 0)] == 3 and len(d) == 12


def test_self_loops_and_isolated_nodes(spark):
    e = edges(spark, [(1, 1), (1, 2), (2, 3), (1, 3)])
    assert values(graph.degrees(e, nodes(spark, [1, 2, 3, 4])), "node", "degree") == {1: 3, 2: 2, 3: 2, 4: 0}
    assert values(graph.local_clustering(e, nodes(spark, [1, 2, 3, 4])), "node", "cc") == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0}


def random_case(seed, n=14, t=5):
    rng = random.Random(seed)
    pairs = [p for p in combinations(range(n), 2) if rng.random() < 0.3]
    mem = [(k, c, int(rng.random() < 0.6)) for k in range(n) for c in range(t)]
    return pairs, mem


def plain_cc(adj, v):
    near = adj[v]
    k = len(near)
    return 0.0 if k < 2 else sum(1 for x, y in combinations(sorted(near), 2) if y in adj[x]) * 2 / (k * (k - 1))


def plain_bw(adj, n):
    out = {v: 0.0 for v in n}
    for s in n:
        dist, sigma, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for v in adj[u]:
                if v not in dist:
                    dist[v], sigma[v] = dist[u] + 1, 0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    sigma[v] += sigma[u]
        delta = {v: 0.0 for v in order}
        for u in reversed(order):
            for v in adj[u]:
                if dist.get(v) == dist[u] - 1:
                    delta[v] += sigma[v] / sigma[u] * (1 + delta[u])
            if u != s:
                out[u] += delta[u]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_contexts_against_plain_python(spark, seed):
    pairs, mem = random_case(seed, t=70 if seed == 2 else 5)  # more than one word of contexts
    e, m = edges(spark, pairs), spark.createDataFrame(mem, "node long, ctx long, present long")
    on = {(k, c) for k, c, p in mem if p}
    n_ctx = 1 + max(c for _, c, _ in mem)
    deg = {(r["ctx"], r["node"]): r["degree"] for r in graph.context_degrees(e, m).collect()}
    assert {r["ctx"]: r["m"] for r in graph.context_edge_counts(e, m).collect()} == {c: k for c in range(n_ctx) for k in [sum((a, c) in on and (b, c) in on for a, b in pairs)] if k}
    cc = {(r["ctx"], r["node"]): r["cc"] for r in graph.context_clustering(e, m).collect()}
    bw = {(r["ctx"], r["node"]): r["betweenness"] for r in traversal.betweenness(e, graph.universe(m, e), m).collect()} if n_ctx < 10 else None
    for c in range(n_ctx):
        adj = {v: set() for v in range(14)}
        for a, b in pairs:
            if (a, c) in on and (b, c) in on:
                adj[a].add(b)
                adj[b].add(a)
        assert {v: len(x) for v, x in adj.items() if x} == {v: d for (k, v), d in deg.items() if k == c}
        for v in adj:
            assert cc.get((c, v), 0.0) == pytest.approx(plain_cc(adj, v))
        if bw:
            assert {v: x for (k, v), x in bw.items() if k == c and x} == pytest.approx({v: x for v, x in plain_bw(adj, adj).items() if x})
    near = {r["node"]: r for r in graph.neighbour_presence(e, m, graph.universe(m, e), n_ctx).collect()}
    count = {v: sum((v, c) in on for c in range(n_ctx)) for v in range(14)}
    for v, r in near.items():
        live = [y if x == v else x for x, y in pairs if v in (x, y) and any((x, c) in on and (y, c) in on for c in range(n_ctx))]
        assert (r["coexpr_degree"], r["min_neighbor_expr_count"], r["max_neighbor_expr_count"]) == (len(live), min([count[u] for u in live], default=n_ctx), max([count[u] for u in live], default=0))
    for a, b, w in graph.coexistence_weights(e, m).collect():
        both = sum((a, c) in on and (b, c) in on for c in range(n_ctx))
        assert w == pytest.approx(both / max(count[a], count[b]) if max(count[a], count[b]) else 0.0)
    assert all(0 <= r["weight"] <= 1 for r in graph.correlation_weights(e, m, n_ctx).collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), min_size=1, max_size=20))
def test_invariants(spark, pairs):
    e = edges(spark, pairs).distinct()
    ids = nodes(spark, range(9))
    comp = values(components.component_labels(ids, e), "node", "component")
    group = {v: {v} for v in range(9)}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for v in group[b]:
                group[v] = group[a]
    assert comp == {v: min(group[v]) for v in range(9)}
    assert all(0 <= x <= 1 for x in values(graph.local_clustering(e, ids), "node", "cc").values())
    cl = community.modularity_communities(e, ids, "louvain", 1.0)
    assert sum(values(graph.modularity_per_cluster(e, cl), "cluster", "modularity").values()) <= 1 + 1e-9


def test_communities_of_planted_cliques(spark):
    cliques = [(10 * g + a, 10 * g + b) for g in range(4) for a, b in combinations(range(6), 2)] + [(10 * g, 10 * g + 11) for g in range(3)]
    e = edges(spark, cliques)
    ids = graph.nodes_of(e)
    want = {v: 10 * (v // 10) for v in values(ids, "node", "node")}
    for method in ("louvain", "greedy"):
        assert values(community.modularity_communities(e, ids, method), "node", "cluster") == want
    lpa = values(community.label_propagation(e, ids), "node", "label")
    assert all(lpa[a] == lpa[b] for a, b in combinations(lpa, 2) if a // 10 == b // 10)
    report = community.cluster_report(e, community.modularity_communities(e, ids)).collect()
    assert len(report) == 4 and all(r["size"] == 6 and r["score"] == 0.0 for r in report)
    alone = community.label_propagation(e, nodes(spark, [*want, 99]))
    assert values(alone, "node", "label")[99] == 99


def test_cluster_sizes(spark):
    cl = spark.createDataFrame([(k, c) for k, c in enumerate([1, 1, 1, 2, 3, 3])], "node long, cluster long")
    assert {(r["size"], r["count"]) for r in graph.size_histogram(cl).collect()} == {(3, 1), (1, 1), (2, 1)}
    row = graph.weighted_sizes(cl).first()
    assert row["weighted_mean"] == pytest.approx(14 / 6) and row["weighted_median"] == 2


def test_simplified_and_threshold_series(spark):
    e = graph.simplified(spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (3, 2), (4, 1), (None, 2)], "a long, b long"))
    assert sorted(map(tuple, e.collect())) == [(1, 2), (1, 4), (2, 3)]
    scores = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.51), (4, None), (9, 0.1)], "node long, score double")  # 9 is in no edge
    got = [tuple(r) for r in graph.threshold_series(e, scores, 4).orderBy("step").collect()]
    assert got == [(0, 0.0, 1, 0), (1, 0.25, 1, 0), (2, 0.5, 2, 1), (3, 0.75, 3, 2), (4, 1.0, 3, 2)]
    assert [tuple(r)[2:] for r in graph.threshold_series(e, scores.limit(0), 1).orderBy("step").collect()] == [(0, 0), (0, 0)]


def test_property_in_overlapping_sets(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a long, b long")
    first, second = (spark.createDataFrame([(k,) for k in x], "node long") for x in ([1, 2, 3], [3, 4]))
    of = lambda method: sorted(tuple(r) for r in graph.property_in_sets(e, first, second, graph.degrees, method).select("node", "set", "degree").collect())
    assert of("global") == [(1, 1, 1), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 2, 2)]
    assert of("subgraph") == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (3, 2, 1), (4, 2, 1)]
    assert of("combined_subgraph") == [(1, 1, 1), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 2, 1)]


def test_edges_meet_their_contexts_as_one_row(spark):
    from quiltnet.functions import reports

    rng = np.random.default_rng(5)
    mem = [(v, c, int(rng.random() < 0.4)) for v in range(20) for c in range(130) if rng.random() < 0.8]
    pairs = [(a, b) for a in range(21) for b in range(a, 21) if rng.random() < 0.4]
    e, m = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(mem, "node long, ctx long, present long")
    packed, words = graph.packed_edges(e, m)
    assert words == 3 and packed.count() == sum(b < 20 for _, b in pairs)
    at = {}
    for v, c, x in mem:
        at.setdefault(v, {})[c] = x
    want = {(a, b): (sum(at[a][c] * at[b].get(c, 0) for c in at[a]), len(at[a].keys() & at[b].keys())) for a, b in pairs if b < 20}
    assert {(r["a"], r["b"]): (r["both"], r["measured"]) for r in reports.edge_presence(e, m).collect()} == want


def test_triangles_move_few_bytes_of_an_edge(spark, monkeypatch):
    # before, every edge carried the list of its first node's neighbours: hundreds of bytes
    rng = random.Random(5)
    monkeypatch.setattr(graph, "TASK_EDGES", 2_000)
    pairs = {(net, *sorted(rng.sample(range(300), 2))) for net in "pq" for _ in range(3000)}
    far = {v: v << 40 if v % 2 else -v for v in range(300)}  # ids that no table of places holds
    named = {(net, *sorted((far[a], far[b]))) for net, a, b in pairs}
    for case in (pairs, named):
        e = spark.createDataFrame(sorted(case), "net string, a long, b long")
        got = [(r["net"], *sorted((r["x"], r["y"], r["z"]))) for r in graph.triangles(e, "net").collect()]
        near = {}
        for net, a, b in case:
            near.setdefault((net, a), set()).add(b)
        want = {(net, a, b, c) for net, a, b in case for c in near.get((net, b), set()) & near[net, a]}
        assert len(got) == len(want) > 2000 and set(got) == want
    assert graph.triangles(e.filter("net = 'none'"), "net").collect() == [] and graph.triangles(e.filter("net = 'none'")).collect() == []
    a = np.sort(np.random.default_rng(1).integers(0, 7_000_000, 10_000))
    b = np.random.default_rng(2).integers(0, 7_000_000, 10_000)
    assert len(graph._packed(a)) + len(graph._packed(b)) < 7 * 10_000 and (graph._unpacked(graph._packed(b), 10_000) == b).all()
