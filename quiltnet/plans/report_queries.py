"""Reports over metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reports
from ..operators import community, graph
from ..operators import relational as rel
from .graph_queries import _ADJ, members
from .lineage import stored
from .registry import n, query, r


@query("w09_split_sorted", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) <= floor(count(*) OVER () * 0.3) AS low FROM part", ctes=False)
def _(m):
    return reports.split_sorted(m.parts().select("p_partkey", "p_size"), "p_size", 0.3, "p_partkey").select("p_partkey", "low")


@query("w11_head", "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10", ctes=False)
def _(m):
    return reports.head(m.parts(), "p_retailprice", 10, "p_partkey").select("p_partkey")


@query("x19_reverse_map", "SELECT c_name, c_custkey FROM customer", ctes=False)
def _(m):
    return reports.reverse_map(m.table("customer").select("c_custkey", "c_name"), "c_custkey", "c_name")


@query("x20_names", "SELECT a, b, x.p_name AS a_name FROM edges JOIN part x ON x.p_partkey = a")
def _(m):
    return reports.named(m.edges(), m.parts(), "a", "p_partkey", "p_name").select("a", "b", "a_name")


@query("j16_edge_presence", f"SELECT a, b, {n('sum(x.present * y.present)', 'both')}, {n('count(*)', 'measured')}, {r('avg(x.present * y.present)', 'share')} FROM edges JOIN mem x ON x.node = a JOIN mem y ON y.node = b AND y.ctx = x.ctx GROUP BY a, b")
def _(m):
    return reports.edge_presence(m.edges(), m.month_members())


@query("j12_property_by_count", _ADJ + f" SELECT node, {n('degree', 'degree')}, {n('c', 'present')} FROM dg JOIN pc USING (node) WHERE c > 0")
def _(m):
    counts = rel.presence_counts(m.month_members()).filter("present > 0").select("node", "present")
    return graph.degrees(m.edges()).join(counts, "node").select("node", "degree", "present")


@query("j13_three_way_join", _ADJ + f" SELECT dc.ctx, dc.node, {n('dc.degree', 'degree')}, {n('c', 'present')} FROM dc JOIN ex ON ex.node = dc.node AND ex.ctx = dc.ctx JOIN pc ON pc.node = dc.node")
def _(m):
    mem = stored(members(m), "members")
    counts = mem.groupBy("node").agg(F.sum("present").alias("present"))
    return graph.context_degrees(m.edges(), mem).join(mem.filter("present = 1").select("node", "ctx"), ["node", "ctx"]).join(counts, "node").select("ctx", "node", "degree", "present")


@query("r21_compare_clusterings")
def _(m):
    e = stored(m.edges(), "edges")
    ids = graph.nodes_of(e)
    both = None
    for kind, gamma in (("coarse", 1.0), ("fine", 5.0)):
        cl = community.modularity_communities(e, ids, "louvain", gamma)
        one = community.cluster_report(e, cl).withColumn("score", F.col("modularity") / F.col("size")).withColumn("kind", F.lit(kind))
        both = one if both is None else both.unionByName(one)
    got = reports.compare_tops(stored(both, "clusters"), "kind", "coarse", "fine")
    keys = ("t", "df", "m1", "m2", "p")
    return m.spark.createDataFrame([tuple(None if got[k] is None else float(got[k]) for k in keys)], ", ".join(f"{k} double" for k in keys))


@query("o05_paths_to_roots", "SELECT 'root/' || t || '/' || tb AS path FROM (SELECT DISTINCT 'type:' || p_type AS t, 'tb:' || p_type || '|' || p_brand AS tb FROM part) WHERE tb = (SELECT min('tb:' || p_type || '|' || p_brand) FROM part) UNION SELECT 'root/' || b || '/' || tb FROM (SELECT DISTINCT 'brand:' || p_brand AS b, 'tb:' || p_type || '|' || p_brand AS tb FROM part) WHERE tb = (SELECT min('tb:' || p_type || '|' || p_brand) FROM part)", ctes=False)
def _(m):
    from ..operators import ontology
    from .semantic_queries import Hierarchy

    h = Hierarchy(m)
    term = h.names.filter("name like 'tb:%'").orderBy("name").first()["id"]
    paths = ontology.paths_to_roots(h.is_a, term).withColumn("k", F.monotonically_increasing_id())
    long = paths.select("k", F.posexplode("path").alias("i", "id")).join(h.names, "id")
    return long.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), "/").alias("path")).select("path")


@query("x12_resolution_sweep")
def _(m):
    e = stored(m.edges(), "edges")
    return reports.clusterer_summary(community.sweep(e, graph.nodes_of(e)), "clusterer")
