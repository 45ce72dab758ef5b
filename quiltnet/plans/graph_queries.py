"""Network metrics, communities and traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, graph, relational, traversal
from ..operators import bundles
from ..operators import community as com
from . import path_sql
from .lineage import stored
from .registry import n, query, r

N_CTX = 12


def members(m):
    """Months from 0."""
    return m.month_members().select("node", (F.col("ctx") - 1).alias("ctx"), "present")


_ADJ = """
, ex AS (SELECT node, ctx - 1 AS ctx FROM mem WHERE present <> 0),
ec AS (SELECT x.ctx, a, b FROM edges JOIN ex x ON x.node = a JOIN ex y ON y.node = b AND y.ctx = x.ctx),
dc AS (SELECT ctx, node, count(*) AS degree FROM (SELECT ctx, a AS node FROM ec UNION ALL SELECT ctx, b FROM ec) GROUP BY ctx, node),
nd AS (SELECT DISTINCT node FROM mem WHERE node IN (SELECT a FROM edges UNION SELECT b FROM edges)),
pc AS (SELECT node, sum(present) AS c FROM mem GROUP BY node),
dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node)"""


@query("g01_subgraph_edges", _ADJ + " SELECT ctx, a, b FROM ec")
def _(m):
    return graph.subgraph_edges(m.edges(), members(m))


@query("g04_degrees", _ADJ + f" SELECT p_partkey AS node, {n('coalesce(degree, 0)', 'degree')} FROM part LEFT JOIN dg ON node = p_partkey")
def _(m):
    return graph.degrees(m.edges(), m.parts().select(F.col("p_partkey").alias("node")))


@query("g05_context_degrees", _ADJ + f" SELECT ctx, node, {n('degree', 'degree')} FROM dc")
def context_degrees(m):
    return graph.context_degrees(m.edges(), members(m))


@query("g06_max_context_degrees", _ADJ + f" SELECT node, {n('coalesce(max(degree), 0)', 'maxts_degree')} FROM nd LEFT JOIN dc USING (node) GROUP BY node")
def _(m):
    e, mem = m.edges(), members(m)
    return graph.max_context_degrees(e, mem, graph.universe(mem, e))


@query("g07_neighbour_presence", _ADJ + f""", live AS (SELECT DISTINCT a, b FROM ec), nb AS (SELECT a AS u, b AS v FROM live UNION ALL SELECT b, a FROM live)
SELECT node, {n('count(v)', 'coexpr_degree')}, {n('coalesce(min(c), 12)', 'min_neighbor_expr_count')}, {n('coalesce(max(c), 0)', 'max_neighbor_expr_count')}
FROM nd LEFT JOIN (SELECT u AS node, v, c FROM nb JOIN pc ON pc.node = v) USING (node) GROUP BY node""")
def neighbour_presence(m):
    e, mem = m.edges(), members(m)
    return graph.neighbour_presence(e, mem, graph.universe(mem, e), N_CTX)


@query("g10_coexistence_weights", _ADJ + f""", xy AS (SELECT a, b, count(*) AS k FROM ec GROUP BY a, b)
SELECT a, b, {r('coalesce(coalesce(k, 0) * 1.0 / nullif(greatest(x.c, y.c), 0), 0)', 'weight')} FROM edges LEFT JOIN xy USING (a, b) JOIN pc x ON x.node = a JOIN pc y ON y.node = b""")
def _(m):
    return graph.coexistence_weights(m.edges(), members(m))


@query("g11_correlation_weights", _ADJ + f""", xy AS (SELECT a, b, count(*) AS k FROM ec GROUP BY a, b)
SELECT a, b, {r('0.5 + 0.5 * coalesce((12.0 * coalesce(k, 0) - x.c * y.c) / nullif(sqrt(CAST((12 * x.c - x.c * x.c) * (12 * y.c - y.c * y.c) AS DOUBLE)), 0), 0)', 'weight')} FROM edges LEFT JOIN xy USING (a, b) JOIN pc x ON x.node = a JOIN pc y ON y.node = b""")
def _(m):
    return graph.correlation_weights(m.edges(), members(m), N_CTX)


_TRI = """, tri AS (SELECT p.a AS x, p.b AS y, q.b AS z FROM edges p JOIN edges q ON q.a = p.b JOIN edges s ON s.a = p.a AND s.b = q.b),
tn AS (SELECT node, count(*) AS t FROM (SELECT x AS node FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri) GROUP BY node)"""


@query("g12_local_clustering", _ADJ + _TRI + f" SELECT p_partkey AS node, {r('coalesce(2.0 * coalesce(t, 0) / nullif(degree * (degree - 1), 0), 0)', 'cc')} FROM part LEFT JOIN dg ON dg.node = p_partkey LEFT JOIN tn ON tn.node = p_partkey")
def local_clustering(m):
    return graph.local_clustering(stored(m.edges(), "edges"), m.parts().select(F.col("p_partkey").alias("node")))


@query("g13_context_clustering", _ADJ + _TRI.replace("tri AS (", "tri AS MATERIALIZED (") + f""", mk AS MATERIALIZED (SELECT node, bit_or(CASE WHEN present <> 0 THEN 1 << (ctx - 1) ELSE 0 END) AS mask FROM mem GROUP BY node),
tl AS MATERIALIZED (SELECT x, y, z, u.mask & v.mask & w.mask AS label FROM tri JOIN mk u ON u.node = x JOIN mk v ON v.node = y JOIN mk w ON w.node = z),
tk AS (SELECT ctx, node, count(*) AS t FROM (SELECT ctx, unnest([x, y, z]) AS node FROM tl, range(12) AS c(ctx) WHERE (label >> ctx) & 1 = 1) GROUP BY ctx, node)
SELECT ctx, node, {r('2.0 * coalesce(t, 0) / (degree * (degree - 1))', 'cc')} FROM dc LEFT JOIN tk USING (ctx, node) WHERE degree >= 2""")
def context_clustering(m):
    return graph.context_clustering(stored(m.edges(), "edges"), stored(members(m), "members"))


@query("g23_global_clustering", _ADJ + _TRI + f" SELECT {r('3.0 * (SELECT count(*) FROM tri) / (SELECT sum(degree * (degree - 1) / 2.0) FROM dg)', 'gl_cluster_coeff')}")
def _(m):
    return graph.global_clustering(stored(m.edges(), "edges"))


@query("g21_degree_summary", _ADJ + f" SELECT {n('count(*)', 'n')}, {n('(SELECT count(*) FROM edges)', 'm')}, {n('min(coalesce(degree, 0))', 'min_deg')}, {n('max(coalesce(degree, 0))', 'max_deg')}, {r('avg(coalesce(degree, 0))', 'avg_deg')} FROM part LEFT JOIN dg ON node = p_partkey")
def _(m):
    return graph.degree_summary(m.edges(), m.parts().select(F.col("p_partkey").alias("node")))


@query("g22_assortativity", _ADJ + f" SELECT {r('corr(x.degree, y.degree)', 'deg_assortativity')} FROM (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges) JOIN dg x ON x.node = u JOIN dg y ON y.node = v")
def _(m):
    return graph.assortativity(m.edges())


@query("g28_neighbour_degree", _ADJ + f" SELECT u AS node, {r('avg(degree)', 'knn')} FROM (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges) JOIN dg ON node = v GROUP BY u")
def _(m):
    return graph.neighbour_degree(m.edges())


_SUB = ", sub AS (SELECT p_partkey AS node FROM part WHERE p_size > 25)"


def _sub(m):
    return m.parts().filter("p_size > 25").select(F.col("p_partkey").alias("node"))


@query("g29_internalness", _SUB + f", nb AS (SELECT DISTINCT v FROM (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges) WHERE u IN (SELECT node FROM sub)) SELECT {r('count(*) FILTER (v IN (SELECT node FROM sub)) * 1.0 / count(*)', 'internal')} FROM nb")
def _(m):
    return graph.internalness(m.edges(), _sub(m))


@query("g30_property_in_sets", _SUB + f""", ie AS (SELECT a, b FROM edges WHERE a IN (SELECT node FROM sub) AND b IN (SELECT node FROM sub)), oe AS (SELECT a, b FROM edges WHERE a NOT IN (SELECT node FROM sub) AND b NOT IN (SELECT node FROM sub))
SELECT node, CAST(1 AS BIGINT) AS "set", {n('count(*)', 'degree')} FROM (SELECT a AS node FROM ie UNION ALL SELECT b FROM ie) GROUP BY node UNION ALL SELECT node, 2, CAST(count(*) AS BIGINT) FROM (SELECT a AS node FROM oe UNION ALL SELECT b FROM oe) GROUP BY node""")
def _(m):
    return _in_sets(m, m.edges())


_TWO = """, one AS (SELECT p_partkey AS node FROM part WHERE p_size > 25), two AS (SELECT p_partkey AS node FROM part WHERE p_size % 3 = 0), own AS (SELECT node, 1 AS s FROM one UNION ALL SELECT node, 2 FROM two)"""


def _two(m, method):
    second = m.parts().filter("p_size % 3 = 0").select(F.col("p_partkey").alias("node"))
    return graph.property_in_sets(stored(m.edges(), "edges"), _sub(m), second, graph.degrees, method).select("node", "set", "degree")


@query("g30_property_in_sets_whole", _TWO + f", d AS (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) SELECT own.node, {n('own.s', 'set')}, {n('count(*)', 'degree')} FROM d JOIN own USING (node) GROUP BY own.node, own.s")
def _(m):
    """Degrees of two overlapping sets in the whole network."""
    return _two(m, "global")


@query("g30_property_in_sets_combined", _TWO + f""", ie AS (SELECT a, b FROM edges WHERE a IN (SELECT node FROM own) AND b IN (SELECT node FROM own)), d AS (SELECT a AS node FROM ie UNION ALL SELECT b FROM ie)
SELECT own.node, {n('own.s', 'set')}, {n('count(*)', 'degree')} FROM d JOIN own USING (node) GROUP BY own.node, own.s""")
def _(m):
    """Degrees of two overlapping sets in the subgraph of both."""
    return _two(m, "combined_subgraph")


@query("g28_simplify", "SELECT a, b FROM edges")
def _(m):
    """Pairs of parts by order in both directions and loops, made simple."""
    p, b = m.pairs(), m.baskets()
    return graph.simplified(p.select("a", "b").union(p.select("b", "a")).union(b.select("p", "p")))


_SERIES = ", sc AS (SELECT node, {score} AS score FROM mem WHERE node IN (SELECT a FROM edges UNION SELECT b FROM edges) GROUP BY node), lv AS (SELECT node, ceil(round(score * 20, 9)) AS l FROM sc), el AS (SELECT greatest(x.l, y.l) AS l FROM edges JOIN lv x ON x.node = a JOIN lv y ON y.node = b), st AS (SELECT unnest(range(21)) AS step)"
_SERIES_ROWS = f" SELECT {n('step', 'step')}, {r('step / 20.0', 't')}, (SELECT count(*) FROM lv WHERE l <= step) AS n, (SELECT count(*) FROM el WHERE l <= step) AS m FROM st"


def _series(m, score):
    scores = m.month_members().groupBy("node").agg(F.avg("present").alias("share")).select("node", score.alias("score"))
    return graph.threshold_series(stored(m.edges(), "edges"), scores)


@query("g28_specific_by_threshold", _SERIES.format(score="avg(present)") + _SERIES_ROWS)
def _(m):
    """Subgraphs of nodes present in at most a share t of their contexts."""
    return _series(m, F.col("share"))


@query("g28_widespread_by_threshold", _SERIES.format(score="1 - avg(present)") + _SERIES_ROWS)
def _(m):
    """Subgraphs of nodes present in at least a share 1 - t of their contexts."""
    return _series(m, 1 - F.col("share"))


def _in_sets(m, e):
    rest = m.parts().filter("p_size <= 25").select(F.col("p_partkey").alias("node"))
    return graph.property_in_sets(stored(e, "edges"), _sub(m), rest, graph.degrees, "subgraph").select("node", "set", "degree")


_CL = ", cl AS (SELECT p_partkey AS node, p_partkey % 10 AS cluster FROM part)"


def _clusters(m):
    return m.parts().select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 10).alias("cluster"))


@query("g19_modularity", _CL + f""", e AS (SELECT x.cluster AS ca, y.cluster AS cb FROM edges JOIN cl x ON x.node = a JOIN cl y ON y.node = b), w AS (SELECT count(*) * 1.0 AS w FROM e),
v AS (SELECT cluster, count(*) * 1.0 AS vol FROM (SELECT ca AS cluster FROM e UNION ALL SELECT cb FROM e) GROUP BY cluster), i AS (SELECT ca AS cluster, count(*) * 1.0 AS k FROM e WHERE ca = cb GROUP BY ca)
SELECT cluster, {r('coalesce(k, 0) / w - power(coalesce(vol, 0) / (2 * w), 2)', 'modularity')} FROM (SELECT DISTINCT cluster FROM cl) LEFT JOIN v USING (cluster) LEFT JOIN i USING (cluster), w""")
def _(m):
    return graph.modularity_per_cluster(stored(m.edges(), "edges"), _clusters(m))


@query("a31_cluster_sizes", f"SELECT {n('size', 'size')}, {n('count(*)', 'count')} FROM (SELECT p_brand, count(*) AS size FROM part GROUP BY p_brand) GROUP BY size", ctes=False)
def _(m):
    return graph.size_histogram(m.parts().select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster")))


@query("a32_weighted_sizes", f"""WITH s AS (SELECT count(*) AS size FROM part GROUP BY p_brand), c AS (SELECT size, sum(size) OVER (ORDER BY size RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM s)
SELECT {r('(SELECT sum(size * size) * 1.0 / sum(size) FROM s)', 'weighted_mean')}, {n('min(size)', 'weighted_median')} FROM c WHERE upto >= total / 2.0""", ctes=False)
def _(m):
    return graph.weighted_sizes(m.parts().select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster")))


_FAR = path_sql.paths(path_sql.WHOLE)
_BW = _FAR + path_sql.betweenness()
_NEAREST = ", rt AS (SELECT s AS node, least(s, min(t)) AS root FROM far GROUP BY s)"
_CTX_FAR = path_sql.paths(path_sql.CONTEXTS)
_CTX_BW = _CTX_FAR + path_sql.betweenness()


@query("g20_components", _FAR + _NEAREST + " SELECT p_partkey AS node, coalesce(root, p_partkey) AS component FROM part LEFT JOIN rt ON node = p_partkey")
def _(m):
    return components.component_labels(m.parts().select(F.col("p_partkey").alias("node")), m.edges())


def _diameter(nodes: str) -> str:
    return f"CASE WHEN (SELECT count(*) FROM far) = ({nodes}) * (({nodes}) - 1) THEN (SELECT max(d) FROM far) ELSE 0 END"


@query("g25_graph_stats", _ADJ + _TRI + _FAR + _NEAREST + f""", q AS (SELECT coalesce(degree, 0) AS degree FROM part LEFT JOIN dg ON node = p_partkey)
SELECT {n('count(*)', 'n')}, {n('(SELECT count(*) FROM edges)', 'm')}, {n('min(degree)', 'min_deg')}, {n('max(degree)', 'max_deg')}, {r('avg(degree)', 'avg_deg')},
{r('(SELECT corr(x.degree, y.degree) FROM aj JOIN dg x ON x.node = u JOIN dg y ON y.node = v)', 'deg_assortativity')}, {n('(SELECT count(DISTINCT coalesce(root, p_partkey)) FROM part LEFT JOIN rt ON node = p_partkey)', 'conn_comp')},
{r('3.0 * (SELECT count(*) FROM tri) / (SELECT sum(degree * (degree - 1) / 2.0) FROM dg)', 'gl_cluster_coeff')}, {n(_diameter('SELECT count(*) FROM part'), 'diameter')} FROM q""")
def graph_stats(m):
    """n, m, degrees, assortativity, components, clustering and diameter of the union network."""
    e, ids = stored(m.edges(), "edges"), m.parts().select(F.col("p_partkey").alias("node"))
    found = components.connected_components(e)
    comps = components.component_labels(ids, e, found).agg(F.count_distinct("component").alias("conn_comp"))
    return graph.degree_summary(e, ids).crossJoin(graph.assortativity(e)).crossJoin(comps).crossJoin(graph.global_clustering(e)).crossJoin(traversal.diameter(e, ids, found=found))


def _flat(df, *names):
    """Sums of many quotients, to three digits: their last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, 3) for c in names})


@query("g14_context_betweenness", _ADJ + _CTX_BW + " SELECT ctx, node, round(coalesce(bw, 0), 3) + 0.0 AS betweenness FROM ex JOIN nd USING (node) LEFT JOIN bw USING (ctx, node)")
def _(m):
    e, mem = m.edges(), members(m)
    return _flat(traversal.betweenness(e, graph.universe(mem, e), mem), "betweenness")


@query("g15_betweenness", _BW + " SELECT p_partkey AS node, round(coalesce(bw, 0), 3) + 0.0 AS betweenness FROM part LEFT JOIN bw ON node = p_partkey")
def betweenness(m):
    return _flat(traversal.betweenness(m.edges(), m.parts().select(F.col("p_partkey").alias("node"))), "betweenness")


@query("g15_betweenness_in_blocks", _BW + " SELECT p_partkey AS node, round(coalesce(bw, 0), 3) + 0.0 AS betweenness FROM part LEFT JOIN bw ON node = p_partkey")
def _(m):
    """As a network that no task holds."""
    return _flat(traversal.betweenness(m.edges(), m.parts().select(F.col("p_partkey").alias("node")), task_edges=0), "betweenness")


@query("g24_diameter_in_blocks", _FAR + f" SELECT {n(_diameter('SELECT count(*) FROM an'), 'diameter')}")
def _(m):
    """As a network that no task holds."""
    e = stored(m.edges(), "edges")
    return traversal.diameter(e, graph.nodes_of(e), task_edges=0)


@query("g24_diameter", _FAR + f" SELECT {n(_diameter('SELECT count(*) FROM an'), 'diameter')}")
def _(m):
    e = stored(m.edges(), "edges")
    return traversal.diameter(e, graph.nodes_of(e))


_LPA0 = ", sy AS (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges), l0 AS (SELECT p_partkey AS node, p_partkey AS label FROM part)"
_LPA = _LPA0 + "".join(
    f", v{k} AS (SELECT u, label, count(*) AS c FROM sy JOIN l{k - 1} ON node = v GROUP BY u, label), l{k} AS MATERIALIZED (SELECT node, coalesce(best, label) AS label FROM l{k - 1} LEFT JOIN (SELECT u, arg_max(label, struct_pack(c := c, m := -label)) AS best FROM v{k} GROUP BY u) ON u = node)"
    for k in range(1, 4)
)


@query("g17_three_rounds_of_labels", _LPA + " SELECT node, label FROM l3")
def _(m):
    """The operator's vote and tie rule, as far as SQL unrolls it."""
    return com.label_propagation(m.edges(), m.parts().select(F.col("p_partkey").alias("node")), rounds=3)


@query("g17_label_propagation")
def label_propagation(m):
    return com.label_propagation(m.edges(), m.parts().select(F.col("p_partkey").alias("node")))


@query("g16_context_label_propagation")
def _(m):
    e, mem = m.edges(), members(m)
    return com.label_propagation(e, graph.universe(mem, e), mem)


@query("g18_louvain")
def _(m):
    e = stored(m.edges(), "edges")
    return com.cluster_report(e, com.modularity_communities(e, graph.nodes_of(e), "louvain", 1.0))


@query("g18_louvain_by_rounds")
def _(m):
    """The union network shrunk by rounds of moves over tables until it has 20,000 edges."""
    e = m.edges()
    return com.cluster_report(e, com.modularity_communities(e, graph.nodes_of(e), "louvain", 1.0, task_edges=20_000))


@query("g18_greedy_by_rounds")
def _(m):
    """The union network merged by rounds of matchings over tables until it has 20,000 edges."""
    e = m.edges()
    return com.cluster_report(e, com.modularity_communities(e, graph.nodes_of(e), "greedy", task_edges=20_000))


@query("g18_greedy_modularity")
def _(m):
    e = stored(m.edges(), "edges")
    return com.cluster_report(e, com.modularity_communities(e, graph.nodes_of(e), "greedy"))


@query("x14_weighted_communities")
def _(m):
    e, mem = m.edges(), members(m)
    w = stored(graph.coexistence_weights(e, mem), "weights")
    return com.cluster_report(w, com.modularity_communities(w, graph.nodes_of(w), "louvain", 5.0, weight="weight"))


_CC = "coalesce(2.0 * coalesce(t, 0) / nullif(degree * (degree - 1), 0), 0)"


@query("g26_node_properties", _ADJ + _TRI + _BW + f" SELECT dg.node, {n('degree', 'degree')}, round(coalesce(bw, 0), 3) + 0.0 AS \"Betweenness\", {r(_CC, 'ClusteringCoeff')} FROM dg LEFT JOIN tn USING (node) LEFT JOIN bw USING (node)")
def _(m):
    return _flat(bundles.node_properties(m.edges()), "Betweenness")


_CTX_TRI = ", tk AS (SELECT ctx, node, count(*) AS t FROM (SELECT p.ctx, unnest([p.a, p.b, q.b]) AS node FROM ec p JOIN ec q ON q.ctx = p.ctx AND q.a = p.b JOIN ec s ON s.ctx = p.ctx AND s.a = p.a AND s.b = q.b) GROUP BY 1, 2)"


@query("g26_context_properties", _ADJ + _CTX_TRI + _CTX_BW + f" SELECT ctx, node, {n('coalesce(degree, 0)', 'degree')}, round(coalesce(bw, 0), 3) + 0.0 AS \"Betweenness\", {r(_CC, 'clcoeff')} FROM ex JOIN nd USING (node) LEFT JOIN dc USING (ctx, node) LEFT JOIN tk USING (ctx, node) LEFT JOIN bw USING (ctx, node)")
def _(m):
    return _flat(bundles.context_properties(m.edges(), members(m)), "Betweenness")


@query("g26_aggregated_properties", _ADJ + f""", live AS (SELECT DISTINCT a, b FROM ec), nb AS (SELECT a AS u, b AS v FROM live UNION ALL SELECT b, a FROM live), mx AS (SELECT node, max(degree) AS k FROM dc GROUP BY node),
ne AS (SELECT u AS node, count(*) AS k, min(c) AS lo, max(c) AS hi FROM nb JOIN pc ON pc.node = v GROUP BY u)
SELECT nd.node, {n('coalesce(degree, 0)', 'degree')}, {n('coalesce(mx.k, 0)', 'maxts_degree')}, {n('coalesce(ne.k, 0)', 'coexpr_degree')}, {n('coalesce(lo, 12)', 'min_neighbor_expr_count')}, {n('coalesce(hi, 0)', 'max_neighbor_expr_count')}
FROM nd LEFT JOIN dg USING (node) LEFT JOIN mx USING (node) LEFT JOIN ne USING (node)""")
def _(m):
    return bundles.aggregated_properties(m.edges(), members(m), N_CTX)


@query("g27_context_stats", _ADJ + _CTX_TRI + _CTX_FAR + f""", me AS (SELECT ctx, node, coalesce(degree, 0) AS degree FROM ex JOIN nd USING (node) LEFT JOIN dc USING (ctx, node)),
rt AS (SELECT ctx, s AS node, least(s, min(t)) AS root FROM far GROUP BY ctx, s), cc AS (SELECT ctx, count(DISTINCT coalesce(root, node)) AS k FROM me LEFT JOIN rt USING (ctx, node) GROUP BY ctx),
mx AS (SELECT aj.ctx, corr(x.degree, y.degree) AS c FROM aj JOIN dc x ON x.ctx = aj.ctx AND x.node = u JOIN dc y ON y.ctx = aj.ctx AND y.node = v GROUP BY 1),
tr AS (SELECT ctx, sum(t) AS t FROM tk GROUP BY ctx), fa AS (SELECT ctx, max(d) AS d, count(*) AS k FROM far GROUP BY ctx)
SELECT me.ctx, {n('count(*)', 'n')}, {n('sum(degree) / 2', 'm')}, {n('min(degree)', 'min_deg')}, {n('max(degree)', 'max_deg')}, {r('avg(degree)', 'avg_deg')}, {r('any_value(mx.c)', 'deg_assortativity')}, {n('any_value(cc.k)', 'conn_comp')},
{r('coalesce(2.0 * any_value(tr.t) / nullif(sum(degree * (degree - 1)), 0), 0)', 'gl_cluster_coeff')}, {n('CASE WHEN any_value(fa.k) = count(*) * (count(*) - 1) THEN any_value(fa.d) ELSE 0 END', 'diameter')}
FROM me LEFT JOIN mx USING (ctx) LEFT JOIN cc USING (ctx) LEFT JOIN tr USING (ctx) LEFT JOIN fa USING (ctx) GROUP BY me.ctx""")
def _(m):
    return bundles.context_stats(m.edges(), members(m))


@query("j14_raised_betweenness")
def _(m):
    """Every network on its own; SQL would take minutes here, a test holds the operator against plain Python."""
    nets, mem, out = stored(m.networks(), "networks"), stored(members(m), "members"), None
    for x in nets.select("net").distinct().orderBy("net").collect():  # a row per network
        one = bundles.raised_betweenness(nets.filter(F.col("net") == x["net"]).select("a", "b"), mem).withColumn("net", F.lit(x["net"]))
        out = one if out is None else out.unionByName(one)
    return _flat(out, "ts_betweenness", "betweenness")


@query("x15_network_summary", f""", adn AS (SELECT net, a AS u, b AS v FROM networks UNION ALL SELECT net, b, a FROM networks), dn AS (SELECT net, u AS node, count(*) AS d FROM adn GROUP BY 1, 2),
tn AS (SELECT net, node, count(*) AS t FROM (SELECT p.net, unnest([p.a, p.b, q.b]) AS node FROM networks p JOIN networks q ON q.net = p.net AND q.a = p.b JOIN networks s ON s.net = p.net AND s.a = p.a AND s.b = q.b) GROUP BY 1, 2)
SELECT net, {n('count(*)', 'nodes')}, {n('sum(d) / 2', 'edges')}, {r('avg(d)', 'avg_deg')}, {n('max(d)', 'max_deg')}, {r('avg(coalesce(2.0 * coalesce(t, 0) / nullif(d * (d - 1), 0), 0))', 'mean_cc')} FROM dn LEFT JOIN tn USING (net, node) GROUP BY net""")
def _(m):
    d = bundles.keyed_clustering(stored(m.networks(), "networks"))
    return d.groupBy("net").agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("avg_deg"), F.max("degree").alias("max_deg"), F.avg("cc").alias("mean_cc"))


@query("g02_core_context_degrees")
def _(m):
    """The reference workload: degrees per context in the dense core."""
    mem = m.month_members()
    core = relational.core(mem, relational.greedy_optimum(relational.coverage_curve(mem)))
    core = stored(core.select("node", (F.col("ctx") - 1).alias("ctx"), "present"), "core")
    return graph.context_degrees(m.edges(), core)
