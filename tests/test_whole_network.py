"""Registered network queries against plain Python on tables in which every pair of parts shares one order only."""

import datetime
import inspect

import pytest

from quiltnet.functions import reports
from quiltnet.operators import bundles, community, graph, ontology, traversal
from quiltnet.plans import graph_queries, registry, relational_queries, report_queries, semantic_queries, source_queries, summary_queries  # noqa: F401

from .test_graph import BRIDGE, plain_bw

#: Two triangles with a bridge and a long tail; 30 has no edges.
PAIRS = BRIDGE + [(k, k + 1) for k in range(5, 12)]
NODES = [*range(13), 30]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    day = datetime.date(2020, 1, 1)
    lines = [(o, p, 50.0, day) for o, pair in enumerate(PAIRS) for p in pair] + [(99, 30, 50.0, day)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_shipdate date").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(p, f"part {p}", 30) for p in NODES], "p_partkey long, p_name string, p_size long").write.parquet(f"{at}/part.parquet")
    return at


def run(spark, tables, name):
    return registry.QUERIES[name](spark, tables).collect()


def near():
    adj = {v: set() for v in NODES}
    for a, b in PAIRS:
        adj[a].add(b)
        adj[b].add(a)
    return adj


def test_all_edges_count(spark, tables):
    adj = near()
    want = plain_bw(adj, adj)
    assert {r["node"]: r["betweenness"] for r in run(spark, tables, "g15_betweenness")} == pytest.approx(want, abs=1e-6)
    assert {r["node"]: r["betweenness"] for r in run(spark, tables, "g14_context_betweenness") if r["betweenness"]} == pytest.approx({v: x for v, x in want.items() if x}, abs=1e-6)
    assert run(spark, tables, "g24_diameter")[0]["diameter"] == 10
    stats = run(spark, tables, "g25_graph_stats")[0]
    assert (stats["m"], stats["conn_comp"]) == (len(PAIRS), 2)
    assert {r["node"]: r["component"] for r in run(spark, tables, "g20_components")} == {v: 30 if v == 30 else 0 for v in NODES}
    assert {(r["a"], r["b"]) for r in run(spark, tables, "x20_names")} == set(PAIRS)
    for name in ("g18_louvain", "g18_greedy_modularity", "x14_weighted_communities"):
        assert sum(r["size"] for r in run(spark, tables, name)) == len(NODES) - 1


def test_sweep_has_every_resolution(spark, tables):
    want = {"PLP", *(f"PLM {g:g}" for g in (1, 2, 5, 10, 15, 20, 30, 40, 50, 100, 200, 500, 1000))}
    assert {r["clusterer"] for r in run(spark, tables, "x12_resolution_sweep")} == want


def settled(adj, label):
    """Whether every node has the smallest of its neighbours' most frequent labels."""
    for v, us in adj.items():
        got = [label[u] for u in us]
        if label[v] != (min(got, key=lambda x: (-got.count(x), x)) if got else v):
            return False
    return True


def test_labels_travel_until_they_settle(spark, tables):
    adj = near()
    assert settled(adj, {r["node"]: r["label"] for r in run(spark, tables, "g17_label_propagation")})
    assert settled({v: us for v, us in adj.items() if us}, {r["node"]: r["label"] for r in run(spark, tables, "g16_context_label_propagation")})
    swing = spark.createDataFrame([(0, 1), (2, 3)], "a long, b long")
    got = community.label_propagation(swing, graph.nodes_of(swing)).collect()
    label = {r["node"]: r["label"] for r in got}
    assert label[0] == label[1] and label[2] == label[3]


def test_class_tests_draw_a_thousand_samples(spark, monkeypatch):
    drawn, real = [], reports.class_tests
    monkeypatch.setattr(reports, "class_tests", lambda *a, **k: drawn.append(inspect.signature(real).bind(*a, **k)) or real(*a, **k))
    assert registry.QUERIES["r15_class_tests"](spark, "/root/testdata/sf0.001").collect()
    for b in drawn:
        b.apply_defaults()
    assert [b.arguments["samples"] for b in drawn] == [1000]


def test_long_chains_are_followed_to_the_end(spark):
    is_a = spark.createDataFrame([(k + 1, k) for k in range(40)], "child long, parent long")
    assert [r["path"] for r in ontology.paths_to_roots(is_a, 40).collect()] == [list(range(41))]
    with pytest.raises(ValueError, match="cycle"):
        ontology.paths_to_roots(spark.createDataFrame([(1, 0), (0, 1)], "child long, parent long"), 1)
    chain = spark.createDataFrame([(k, k + 1) for k in range(66)], "a long, b long")
    assert traversal.distances(chain).agg({"d": "max"}).first()[0] == 66


def test_bundles_against_plain_python(spark):
    """A square: without node 3 all paths between 0 and 2 lead over 1."""
    square = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 3)], "a long, b long")
    members = spark.createDataFrame([(v, c, int(c == 0 or v != 3)) for v in range(4) for c in (0, 1)], "node long, ctx long, present long")
    got = [tuple(r) for r in bundles.raised_betweenness(square, members).collect()]
    assert got == [(1, 1, 2.0, 1.0, 2, 2, 2, 2)]
    stats = {r["ctx"]: r for r in bundles.context_stats(square, members).collect()}
    assert [(stats[c]["n"], stats[c]["m"], stats[c]["conn_comp"], stats[c]["diameter"], stats[c]["gl_cluster_coeff"]) for c in (0, 1)] == [(4, 4, 1, 2, 0.0), (3, 2, 1, 2, 0.0)]
    lone = spark.createDataFrame([(0, 0, 1), (2, 0, 1)], "node long, ctx long, present long")
    row = bundles.context_stats(square, lone).first()
    assert (row["n"], row["m"], row["conn_comp"], row["diameter"]) == (2, 0, 2, 0)
    two = spark.createDataFrame([("x", 0, 1), ("x", 1, 2), ("x", 0, 2), ("y", 0, 1)], "net string, a long, b long")
    assert {(r["net"], r["node"]): (r["degree"], r["cc"]) for r in bundles.keyed_clustering(two).collect()} == {("x", 0): (2, 1.0), ("x", 1): (2, 1.0), ("x", 2): (2, 1.0), ("y", 0): (1, 0.0), ("y", 1): (1, 0.0)}


def test_paths_are_counted_alike_when_subgraphs_are_joined(spark, monkeypatch):
    adj = near()
    edges = spark.createDataFrame(PAIRS, "a long, b long")
    monkeypatch.setattr(traversal, "SHARED_BYTES", 0)
    got = {r["node"]: r["betweenness"] for r in traversal.betweenness(edges, graph.nodes_of(edges), sources_per_task=3).collect()}
    assert got == pytest.approx({v: x for v, x in plain_bw(adj, adj).items() if v != 30}, abs=1e-6)
    assert traversal.diameter(edges, graph.nodes_of(edges), sources_per_task=3).first()["diameter"] == 10


def test_types_are_compared(spark):
    rows = [("Global", k, 9, 0.1 * k, 1.0 - 0.1 * k) for k in range(6)] + [("0", k, 9, 5.0 + 0.1 * k, 1.0 - 0.1 * k) for k in range(6)] + [("1", 0, 2, 1.0, 0.5)]
    got = reports.compare_types(spark.createDataFrame(rows, "type string, cluster long, size long, score double, modularity double"), "Global", 0.5, 4).collect()
    line = {(r["comparison"], r["type"]): r for r in got}
    assert line["base", "0"]["greater"] and line["base", "0"]["p"] < 0.05 and ("base", "1") not in line
    assert line["others", "Global"]["first"] == pytest.approx(0.1) and line["others", "Global"]["second"] == pytest.approx(0.4)
    assert line["share greater", "Global"]["first"] == 1.0 and line["share smaller", "Global"]["first"] == 0.0


def test_class_tests_agree_with_the_closed_form(spark):
    values = spark.createDataFrame([(c, v, float(v % 17 + c)) for c in (0, 1) for v in range(300)], "ctx long, node long, value double")
    cls = spark.createDataFrame([(v, "HK" if v % 3 else "TS") for v in range(0, 300, 2)], "node long, class string")
    for r in reports.class_tests(spark, values, "value", cls, 600).collect():
        own = [(v % 17 + r["ctx"]) for v in range(0, 300, 2) if (v % 3 != 0) == (r["class"] == "HK")]
        every = [v % 17 + r["ctx"] for v in range(300)]
        mu = sum(every) / 300
        sd = (sum((x - mu) ** 2 for x in every) / 300 / len(own) * (300 - len(own)) / 299) ** 0.5
        assert r["mean"] == pytest.approx(sum(own) / len(own)) and r["k"] == len(own)
        assert abs(r["mu"] - mu) < 5 * sd / 600**0.5 and r["sd"] == pytest.approx(sd, rel=0.15)


def test_clusterings_of_all_types(spark):
    edges = spark.createDataFrame(PAIRS, "a long, b long")
    members = spark.createDataFrame([(v, c, int(v % 5 != c)) for v in range(13) for c in (0, 1)], "node long, ctx long, present long")
    notes = spark.createDataFrame([(v, v % 3) for v in range(13)], "node long, term long")
    matrix = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 0.5)], "i long, j long, sim double")
    rows = community.all_clusterings(edges, members, notes, matrix, 1.0).collect()
    assert {r["type"] for r in rows} == {"Global", "0", "1", "EdgeCoexprCount"}
    size = {t: sum(r["size"] for r in rows if r["type"] == t) for t in ("Global", "0", "1")}
    assert size == {"Global": 13, "0": sum(v % 5 != 0 for v in range(13)), "1": sum(v % 5 != 1 for v in range(13))}
    plain = community.cluster_report(edges, community.modularity_communities(edges, graph.nodes_of(edges), "louvain", 1.0)).collect()
    assert {r["cluster"]: r["modularity"] for r in rows if r["type"] == "Global"} == pytest.approx({r["cluster"]: r["modularity"] for r in plain})
    assert any(r["score"] for r in rows)


def full_rounds(adj, rounds):
    label = {v: v for v in adj}
    for _ in range(rounds):
        label = {v: min((label[u] for u in us), key=lambda x: (-[label[w] for w in us].count(x), x)) if us else label[v] for v, us in adj.items()}
    return label


def test_votes_change_by_moved_nodes_only(spark):
    """The labels of rounds over all nodes, while fewer and fewer nodes are looked at."""
    cliques = [(12 * g + a, 12 * g + b) for g in range(30) for a in range(12) for b in range(a)] + [(12 * g, 12 * g + 13) for g in range(29)] + [(359 + k, 360 + k) for k in range(6)]
    edges, adj = spark.createDataFrame(cliques, "a long, b long"), {v: set() for v in range(366)}
    for a, b in cliques:
        adj[a].add(b)
        adj[b].add(a)
    ids = graph.nodes_of(edges)
    for rounds in (1, 2, 4):
        assert {r["node"]: r["label"] for r in community.label_propagation(edges, ids, rounds=rounds).collect()} == full_rounds(adj, rounds)
    trace = []
    got = {r["node"]: r["label"] for r in community.label_propagation(edges, ids, trace=trace).collect()}
    assert settled(adj, got) and trace[0] == 366 and trace[-1] < 36


def test_labels_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(community, "MOST_ROUNDS", 1)
    edges = spark.createDataFrame(PAIRS, "a long, b long")
    with pytest.raises(ValueError, match="do not settle"):
        community.label_propagation(edges, graph.nodes_of(edges))


def planted(groups, size, seed=1):
    import numpy as np

    rng, n = np.random.default_rng(seed), groups * size
    pairs = {(a, b) for a in range(n) for b in range(a) if rng.random() < (0.6 if a // size == b // size else 0.01)}
    return sorted(pairs)


def quality(pairs, part, gamma=1.0):
    degree = {}
    for a, b in pairs:
        for v in (a, b):
            degree[v] = degree.get(v, 0) + 1
    vol = {}
    for v, d in degree.items():
        vol[part[v]] = vol.get(part[v], 0) + d
    return sum(part[a] == part[b] for a, b in pairs) / len(pairs) - gamma * sum(x * x for x in vol.values()) / (2 * len(pairs)) ** 2


def test_rounds_over_tables_reach_the_quality_of_a_task(spark):
    pairs = planted(8, 16)
    edges = spark.createDataFrame([("x", *p, 1.0) for p in pairs], "net string, a long, b long, w double")
    runs = spark.createDataFrame([("one", "x", 1.0), ("three", "x", 3.0)], "run string, net string, gamma double")
    part = lambda rows, run: {r["node"]: r["cluster"] for r in rows if r["run"] == run}
    near, far = community.louvain(edges, runs).collect(), community.louvain(edges, runs, task_edges=0).collect()
    for run, gamma in (("one", 1.0), ("three", 3.0)):
        assert len(part(far, run)) == len(part(near, run)) == 128
        assert quality(pairs, part(far, run), gamma) >= 0.99 * quality(pairs, part(near, run), gamma)


def test_no_merge_is_left_after_matchings(spark):
    pairs = planted(6, 12)
    edges = spark.createDataFrame([("x", *p, 1.0) for p in pairs], "net string, a long, b long, w double")
    runs = spark.createDataFrame([("one", "x", 1.0)], "run string, net string, gamma double")
    near, far = ({r["node"]: r["cluster"] for r in community.greedy_modularity(edges, runs, k).collect()} for k in (10**6, 0))
    assert quality(pairs, far) >= 0.9 * quality(pairs, near)
    names, base = sorted(set(far.values())), quality(pairs, far)
    for k, x in enumerate(names):
        for y in names[:k]:
            assert quality(pairs, {v: y if c == x else c for v, c in far.items()}) <= base + 1e-9
    # all leaves of a star belong to its hub
    star = spark.createDataFrame([("x", 0, k, 1.0) for k in range(1, 9)], "net string, a long, b long, w double")
    assert {r["cluster"] for r in community.greedy_modularity(star, runs, 0).collect()} <= set(range(9))


def test_a_round_stores_rows_of_nodes_only(spark, monkeypatch):
    """Votes of a dense network are many times its nodes; no round writes them."""
    import numpy as np

    from quiltnet.operators import nearby

    rng, n = np.random.default_rng(5), 120
    pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.3]
    adj = {v: set() for v in range(n)}
    for a, b in pairs:
        adj[a].add(b)
        adj[b].add(a)
    rows, real = {}, community.stored

    def counted(df, name, **k):
        out = real(df, name, **k)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(community, "stored", counted)
    monkeypatch.setattr(nearby, "LEAST_EDGES", 100)
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["label"] for r in community.label_propagation(edges, graph.nodes_of(edges), rounds=2).collect()}
    assert got == full_rounds(adj, 2)
    assert max(k for name, k in rows.items() if name != "lpa-edges") <= n


def test_components_of_a_large_network_end_in_tasks(spark):
    """Copies side by side exceed a task, each copy does not: the result is that of one task with all of them."""
    base = planted(3, 10)
    pairs = [(a + 100 * i, b + 100 * i) for i in range(4) for a, b in base] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(5)]
    edges = spark.createDataFrame([("x", *p, 1.0) for p in pairs], "net string, a long, b long, w double")
    runs = spark.createDataFrame([("one", "x", 1.0), ("three", "x", 3.0)], "run string, net string, gamma double")
    for method in (community.louvain, community.greedy_modularity):
        near, far = ({(r["run"], r["node"]): r["cluster"] for r in method(edges, runs, k).collect()} for k in (10**6, len(base)))
        assert far == near and len(far) == 2 * len({v for p in pairs for v in p})


def test_louvain_in_a_task_moves_by_batches(monkeypatch):
    """Planted clusters are found, with weights too, and by few looks at arrays instead of one for each node and pass."""
    import numpy as np

    pairs = planted(8, 16)
    x, y = (np.array(side) for side in zip(*pairs))
    for w in (np.ones(len(x)), np.linspace(1.0, 1.1, len(x))):
        got = community._louvain(np.arange(128) * 7, x, y, w, 1.0, 2 * w.sum())
        assert len({(v // 16, c) for v, c in enumerate(got.tolist())}) == len(set(got.tolist())) == 8
    rng, n, looks, real = np.random.default_rng(2), 3_000, [], community.best_of
    monkeypatch.setattr(community, "best_of", lambda *a: looks.append(1) or real(*a))
    code = np.unique(rng.integers(0, n, 60_000) * n + rng.integers(0, n, 60_000))
    x, y = np.divmod(code[code // n < code % n], n)
    part = community._louvain(np.arange(n), x, y, np.ones(len(x)), 1.0, 2.0 * len(x))
    vol = np.bincount(part[x], minlength=n) + np.bincount(part[y], minlength=n)
    assert (part[x] == part[y]).mean() - ((vol / (2 * len(x))) ** 2).sum() > 0.15
    assert 0 < len(looks) <= community.STARTS * (20 * community.BATCHES + n)


def test_greedy_merges_the_best_pair_first(monkeypatch):
    """Step by step as plain Python does, with few entries of the heap: a merge offers one pair and not all of its row."""
    import heapq

    import numpy as np

    rng, n, pushed, real = np.random.default_rng(4), 60, [], heapq.heappush
    pairs = [(a, b) for a in range(n) for b in range(a + 1) if rng.random() < (0.7 if a % 4 == b % 4 else 0.3)]
    x, y = (np.array(side) for side in zip(*pairs))
    w = rng.random(len(x))
    two_m = 2 * w.sum()
    e = np.zeros((n, n))
    np.add.at(e, (x, y), w / two_m)
    np.add.at(e, (y, x), w / two_m)
    a, want = e.sum(axis=1), np.arange(n)
    while True:
        gain = 2 * (e - np.outer(a, a))
        gain[(e == 0) | np.tri(n, dtype=bool)] = 0
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] <= 1e-15:
            break
        e[i] += e[j]
        e[:, i] += e[:, j]
        e[j] = e[:, j] = 0
        a[i], a[j] = a[i] + a[j], 0
        want[want == j] = i
    monkeypatch.setattr(heapq, "heappush", lambda h, item: pushed.append(1) or real(h, item))
    got = community._greedy(np.arange(n), x, y, w, 1.0, two_m)
    assert len(set(zip(got.tolist(), want.tolist()))) == len(set(got.tolist())) == len(set(want.tolist())) > 1
    assert len(pushed) < len(pairs)
