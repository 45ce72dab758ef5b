"""Sources, mapping, reshaping, cores and overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reports, stats
from ..operators import overlap
from ..operators import relational as rel
from ..sources import delimited, ontology_file, tables
from .lineage import fresh_path, stored
from .registry import n, query, r

# ---------------------------------------------------------------- sources: written to the shared folder, scanned back


@query("s01_delimited_scan", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, replace(n_name, ' ', '_') AS n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation", ctes=False)
def _(m):
    at = fresh_path(m.spark, "nation")
    tables.dump_table(m.table("nation").withColumn("n_name", F.replace("n_name", F.lit(" "), F.lit("_"))), at)
    return delimited.scan_delimited(m.spark, at, " ", types={"n_regionkey": "long"})


@query("s02_columns_ragged_rows", "SELECT s_name AS b, CAST(s_suppkey AS VARCHAR) AS a, CASE WHEN s_nationkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS c FROM supplier", ctes=False)
def _(m):
    at = fresh_path(m.spark, "ragged")
    line = F.when(F.col("s_nationkey") % 2 == 0, F.concat_ws("\t", "s_suppkey", "s_name", "s_nationkey", F.lit("more"))).otherwise(F.concat_ws("\t", "s_suppkey", "s_name"))
    m.table("supplier").select(line).coalesce(1).write.text(at)
    raw = delimited.scan_delimited(m.spark, at, "\t", header=False, columns=[1, 0], names=["b", "a"])
    wide = delimited.scan_delimited(m.spark, at, "\t", header=False, columns=[0, 1], names=["a", "b"])
    text = m.spark.read.text(at)
    third = text.select(F.get(F.split("value", "\t"), F.lit(0)).alias("a"), F.coalesce(F.get(F.split("value", "\t"), F.lit(2)), F.lit("")).alias("c"))
    return raw.join(wide.select("a"), "a").join(third, "a").select("b", "a", "c")


@query("s06_preamble_scan", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region", ctes=False)
def _(m):
    at = fresh_path(m.spark, "preamble")
    rows = m.table("region").select(F.concat_ws("\t", F.col("r_regionkey").cast("string"), "r_name").alias("value"), (F.col("r_regionkey") + 10).alias("at"))
    head = m.spark.createDataFrame([("!first", 0), ("!second", 1), ("!third", 2), ("key\tregion name", 3)], "value string, at int")
    head.union(rows).coalesce(1).sortWithinPartitions("at").select("value").write.text(at)
    return delimited.scan_delimited(m.spark, at, "\t", names=["k", "name"], types={"k": "long"}, skip_rows=3)


@query("s07_quoted_scan", "SELECT CAST(c_custkey AS BIGINT) AS k, c_name || ', \"x\"' AS name FROM customer", ctes=False)
def _(m):
    at = fresh_path(m.spark, "quoted")
    m.table("customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("name")).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(at)
    return delimited.scan_delimited(m.spark, at, ",", names=["k", "name"], types={"k": "long"}, quote='"')


@query("s08_mitab_scan", "SELECT 'P' || l_partkey AS g1, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'S' || l_suppkey END AS g2, 'score:' || CAST(l_linenumber AS VARCHAR) AS confidence FROM lineitem", ctes=False)
def _(m):
    at = fresh_path(m.spark, "mitab")
    second = F.when(F.col("l_suppkey") % 3 == 0, F.lit("intact:none")).otherwise(F.concat(F.lit("uniprotkb:S"), "l_suppkey", F.lit("-2")))
    cells = [F.concat(F.lit("uniprotkb:P"), "l_partkey"), second, *[F.lit("-")] * 12, F.concat(F.lit("score:"), "l_linenumber")]
    m.table("lineitem").select(F.concat_ws("\t", *cells)).write.text(at)
    return delimited.scan_mitab(m.spark, at).select(F.col("Gene1").alias("g1"), F.col("Gene2").alias("g2"), "confidence")


@query("s09_scored_network", "SELECT CAST(l_partkey AS VARCHAR) AS g1, CAST(l_suppkey AS VARCHAR) AS g2, CAST(l_quantity * 20 AS BIGINT) AS score FROM lineitem WHERE l_quantity * 20 >= 500 AND l_linenumber > 1", ctes=False)
def _(m):
    at = fresh_path(m.spark, "scored")
    who = F.when(F.col("l_linenumber") > 1, F.lit("9606.")).otherwise(F.lit("10090."))
    m.table("lineitem").select(F.concat_ws(" ", F.concat(who, "l_partkey"), F.concat(who, "l_suppkey"), (F.col("l_quantity") * 20).cast("int"))).write.text(at)
    return delimited.scan_scored_network(m.spark, at, "9606.", 500).select(F.col("Gene1").alias("g1"), F.col("Gene2").alias("g2"), F.col("Reliability").alias("score"))


def _obo(m):
    at = fresh_path(m.spark, "obo")
    part = m.table("part")
    stanza = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: GO:"), "id"), F.concat(F.lit("name: "), "name"), F.lit("namespace: process"), "extra", F.lit(""))
    root = m.spark.createDataFrame([("0", "root", "alt_id: GO:900001")], "id string, name string, extra string")
    types = part.select(F.xxhash64("p_type").alias("h"), "p_type").distinct().select(F.concat(F.lit("1"), F.lpad(F.pmod("h", F.lit(10**9)).cast("string"), 9, "0")).alias("id"), F.col("p_type").alias("name"), F.lit("is_a: GO:0 ! root").alias("extra"))
    gone = m.spark.createDataFrame([("7", "old", "is_obsolete: true\nis_a: GO:0 ! root")], "id string, name string, extra string")
    types.union(root).union(gone).select(stanza).write.text(at)
    return at


@query("s10_ontology_scan", "SELECT p_type AS name, 'root' AS parent FROM part GROUP BY p_type", ctes=False)
def _(m):
    terms, is_a, _ = ontology_file.scan_obo(m.spark, _obo(m), "process")
    name = terms.select("id", "name")
    return is_a.join(name.select(F.col("id").alias("child"), "name"), "child").join(name.select(F.col("id").alias("parent"), F.col("name").alias("up")), "parent").select("name", F.col("up").alias("parent"))


@query("s11_annotation_scan", "SELECT p_name AS gene, CAST(p_partkey AS BIGINT) AS term FROM part", ctes=False)
def _(m):
    at = fresh_path(m.spark, "gaf")
    m.table("part").select(F.concat_ws("\t", F.lit("DB"), F.lit("id"), "p_name", F.lit(""), F.concat(F.lit("GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")))).write.text(at)
    return delimited.scan_annotations(m.spark, at, 0).select(F.col("Gene").alias("gene"), F.split("GOTerm", ":")[1].cast("long").alias("term"))


@query("s15_create_and_append", f"SELECT n_regionkey AS region, {n('count(*)', 'nations')}, 'a' AS run FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, CAST(count(*) AS BIGINT), 'b' FROM nation GROUP BY 1", ctes=False)
def _(m):
    at = fresh_path(m.spark, "results")
    one = m.table("nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("nations"))
    tables.append_results(one, at, run="a")
    tables.append_results(one, at, run="b")
    return m.spark.read.parquet(at)


@query("s20_long_properties", f"SELECT p_partkey AS node, u.k AS \"Property\", {r('u.v', 'Value')} FROM part, (VALUES ('p_size'), ('p_retailprice')) AS t(k), LATERAL (SELECT t.k AS k, CASE WHEN t.k = 'p_size' THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS v) u", ctes=False)
def _(m):
    return tables.long_properties(m.table("part").withColumnRenamed("p_partkey", "node"), ["node"], ["p_size", "p_retailprice"])


@query("s22_cached_frame", f"SELECT p_brand, {n('count(*)', 'k')} FROM part GROUP BY 1", ctes=False)
def _(m):
    at = fresh_path(m.spark, "cache")
    build = lambda: m.table("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("k"))
    tables.cached_frame(m.spark, at, build)
    return tables.cached_frame(m.spark, at, build)


# ---------------------------------------------------------------- filters and normalising


@query("f02_reliable", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'A' AND l_linestatus = 'F') OR (l_returnflag = 'N' AND l_linestatus = 'O')", ctes=False)
def _(m):
    kind = F.when(F.col("l_returnflag") == "A", "APE").when(F.col("l_returnflag") == "N", "Staining").otherwise("other")
    level = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "N", "Medium").otherwise("High")).otherwise(F.when(F.col("l_returnflag") == "N", "Supportive").otherwise("Low"))
    return rel.reliable(m.table("lineitem").select("l_orderkey", "l_linenumber", kind.alias("Expression_type"), level.alias("Reliability"))).select("l_orderkey", "l_linenumber")


@query("f05_classify", "SELECT node, ctx, present FROM mem")
def _(m):
    return rel.classify(m.month_values(), 40)


@query("f06_ordinal", f"SELECT o_orderkey, {r('''CASE WHEN o_orderpriority LIKE '%LOW%' THEN 1 WHEN o_orderpriority LIKE '%MEDIUM%' THEN 2 WHEN o_orderpriority LIKE '%HIGH%' THEN 3 ELSE NULL END''', 'level')} FROM orders", ctes=False)
def _(m):
    word = F.initcap(F.regexp_extract("o_orderpriority", "(LOW|MEDIUM|HIGH)", 1))
    return m.table("orders").select("o_orderkey", rel.ordinal(word).alias("level"))


@query("f07_composite_key", "SELECT l_orderkey, l_linenumber, l_returnflag || ' - ' || l_linestatus AS ctx FROM lineitem", ctes=False)
def _(m):
    return m.table("lineitem").select("l_orderkey", "l_linenumber", rel.composite("l_returnflag", "l_linestatus").alias("ctx"))


@query("f08_real_from_text", f"SELECT p_partkey, {r('CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_retailprice END', 'value')} FROM part", ctes=False)
def _(m):
    text = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 5 == 0, "junk").otherwise(F.col("p_retailprice").cast("string"))
    return m.table("part").select("p_partkey", rel.real(text).alias("value"))


@query("f09_prefer_second", "SELECT p_partkey, CASE WHEN p_size < 25 THEN p_brand ELSE p_name END AS id FROM part", ctes=False)
def _(m):
    second = F.when(F.col("p_size") < 25, "").otherwise(F.col("p_name"))
    return m.table("part").select("p_partkey", F.when(second == "", F.col("p_brand")).otherwise(second).alias("id"))


@query("f11_canonical_edges", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem", ctes=False)
def _(m):
    return rel.canonical_edges(m.table("lineitem"), "l_partkey", "l_suppkey")


@query("f16_spread_class", f"""SELECT node, {n('total', 'total')}, {n('present', 'present')},
CASE WHEN present * 1.0 / total <= 0.25 THEN 'TS' WHEN present * 1.0 / total >= 0.75 THEN 'HK' ELSE 'None' END AS class
FROM (SELECT node, count(ctx) AS total, sum(present) AS present FROM mem GROUP BY node)""")
def _(m):
    return rel.spread_class(rel.presence_counts(m.month_members()), 0.25)


@query("f17_flags", "SELECT p_partkey AS node, CAST(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS BIGINT) AS returned, CAST(p_size > 40 AS BIGINT) AS large FROM part", ctes=False)
def _(m):
    part = m.table("part")
    return rel.flags(part.select(F.col("p_partkey").alias("node")), returned=m.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("node")), large=part.filter("p_size > 40").select(F.col("p_partkey").alias("node")))


# ---------------------------------------------------------------- identifier mapping

_MAPS = """
, m1 AS (SELECT CAST(p_partkey AS VARCHAR) AS k, min(p_name) AS v FROM part WHERE p_size <= 30 GROUP BY 1),
m2 AS (SELECT CAST(p_partkey AS VARCHAR) AS k, min(p_brand) AS v FROM part GROUP BY 1),
map AS (SELECT m2.k, coalesce(m1.v, m2.v) AS v FROM m2 LEFT JOIN m1 USING (k))"""


def _mapping(m):
    part = m.table("part")
    return rel.mapping_table([part.filter("p_size <= 30").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("v"))], "k", "v")


@query("x06_mapping_table", _MAPS + " SELECT k, v FROM map")
def _(m):
    return _mapping(m)


@query("x06_ambiguous_mapping", "SELECT p_name AS k, min(p_brand) AS v FROM part WHERE p_name <> '' AND p_brand <> '' GROUP BY 1", ctes=False)
def _(m):
    return rel.mapping_table([m.table("part").select(F.col("p_name").alias("k"), F.col("p_brand").alias("v"))], "k", "v")


@query("j01_map_ids", _MAPS + " SELECT x.v AS a, y.v AS b FROM edges JOIN map x ON x.k = CAST(a AS VARCHAR) JOIN map y ON y.k = CAST(b AS VARCHAR)")
def _(m):
    return rel.map_ids(m.edges(), ["a", "b"], _mapping(m), "k", "v")


@query("x11_map_two_hops", "SELECT l_orderkey, l_linenumber, h.v AS brand FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT p_name AS k, min(p_brand) AS v FROM part GROUP BY 1) h ON h.k = p_name", ctes=False)
def _(m):
    part = m.table("part")
    one = rel.mapping_table([part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))], "k", "v")
    two = rel.mapping_table([part.select(F.col("p_name").alias("k"), F.col("p_brand").alias("v"))], "k", "v")
    rows = m.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("brand"))
    return rel.map_ids(rel.map_ids(rows, ["brand"], one, "k", "v"), ["brand"], two, "k", "v")


_SMALL = ", small AS (SELECT p_partkey AS id FROM part WHERE p_size <= 30)"


def _small(m):
    return m.table("part").filter("p_size <= 30").select(F.col("p_partkey").alias("id"))


@query("j02_same_ids", _SMALL + " SELECT a, b FROM edges WHERE a IN (SELECT id FROM small) AND b IN (SELECT id FROM small)")
def _(m):
    return rel.same_ids(m.edges(), ["a", "b"], _small(m), "id").select("a", "b")


@query("j03_unmatched", _SMALL + " SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM small)")
def _(m):
    return rel.unmatched(m.table("lineitem").select("l_orderkey", "l_partkey"), "l_partkey", _small(m), "id").select("l_orderkey", "l_partkey")


@query("j04_any_unmatched", _SMALL + " SELECT a, b FROM edges WHERE a NOT IN (SELECT id FROM small) OR b NOT IN (SELECT id FROM small)")
def _(m):
    return rel.any_unmatched(m.edges(), ["a", "b"], _small(m), "id")


@query("a15_mapping_stats", _SMALL + f""" SELECT {n('count(*) FILTER (id IS NOT NULL)', 'rows_matched')}, {n('count(*) FILTER (id IS NULL)', 'rows_unmatched')}, CAST(0 AS BIGINT) AS rows_null,
{n('count(DISTINCT l_partkey) FILTER (id IS NOT NULL)', 'ids_matched')}, {n('count(DISTINCT l_partkey) FILTER (id IS NULL)', 'ids_unmatched')} FROM lineitem LEFT JOIN small ON id = l_partkey""")
def _(m):
    return rel.mapping_stats(m.table("lineitem"), "l_partkey", _small(m), "id")


@query("x05_all_ids", "SELECT l_partkey AS id FROM lineitem UNION SELECT p_partkey FROM part UNION SELECT l_suppkey FROM lineitem", ctes=False)
def _(m):
    li = m.table("lineitem")
    return rel.all_ids([li.select(F.col("l_partkey").alias("id")), m.table("part").select(F.col("p_partkey").alias("id")), li.select(F.col("l_suppkey").alias("id"))], "id")


@query("w01_id_table", f"SELECT {n('row_number() OVER (ORDER BY p_name)', 'id')}, p_name FROM (SELECT DISTINCT p_name FROM part)", ctes=False)
def _(m):
    return rel.id_table(m.table("part"), "p_name")


# ---------------------------------------------------------------- reshaping and counting


@query("u06_unpivot_distinct", "SELECT DISTINCT node, k AS ctx, v AS value FROM (SELECT p_partkey AS node, unnest(['p_name', 'p_brand', 'p_type']) AS k, unnest([p_name, p_brand, p_type]) AS v FROM part)", ctes=False)
def _(m):
    return rel.unpivot_distinct(m.table("part").select(F.col("p_partkey").alias("node"), "p_name", "p_brand", "p_type"), ["node"])


@query("a01_collapse_max", "SELECT node, ctx, value FROM mv")
def _(m):
    rows = m.table("lineitem").select(F.col("l_partkey").alias("node"), F.month("l_shipdate").alias("ctx"), F.col("l_quantity").alias("value"))
    return rel.collapse_max(rows, ["node", "ctx"])


@query("a03_presence_counts", f"SELECT node, {n('count(ctx)', 'total')}, {n('sum(present)', 'present')} FROM mem GROUP BY node")
def _(m):
    return rel.presence_counts(m.month_members())


@query("a04_context_coverage", f"SELECT ctx, {n('count(DISTINCT node)', 'coverage')} FROM mem GROUP BY ctx")
def _(m):
    return rel.context_coverage(m.month_members())


_CURVE = """
, cov AS (SELECT ctx, count(DISTINCT node) AS c FROM mem GROUP BY ctx),
lv AS (SELECT DISTINCT c AS l FROM cov),
reach AS (SELECT l, ctx FROM lv JOIN cov ON c >= l),
k AS (SELECT l, count(*) AS n_ctx FROM reach GROUP BY l),
nn AS (SELECT l, count(*) AS n_nodes FROM (SELECT l, node, count(*) AS q FROM mem JOIN reach USING (ctx) GROUP BY l, node) JOIN k USING (l) WHERE q >= n_ctx GROUP BY l),
curve AS (SELECT l AS coverage, n_ctx, coalesce(n_nodes, 0) AS n_nodes, n_ctx * coalesce(n_nodes, 0) AS product FROM k LEFT JOIN nn USING (l)),
best AS (SELECT * FROM curve ORDER BY product DESC, coverage LIMIT 1),
cctx AS (SELECT ctx FROM cov, best WHERE c >= coverage),
cnode AS (SELECT node FROM mem WHERE ctx IN (SELECT ctx FROM cctx) GROUP BY node HAVING count(*) >= (SELECT count(*) FROM cctx)),
core AS (SELECT node, ctx, present FROM mem WHERE ctx IN (SELECT ctx FROM cctx) AND node IN (SELECT node FROM cnode))"""
_CURVE_COLS = ", ".join(n(c, c) for c in ("coverage", "n_ctx", "n_nodes", "product"))


@query("a05_coverage_curve", _CURVE + f" SELECT {_CURVE_COLS} FROM curve")
def _(m):
    return rel.coverage_curve(m.month_members())


@query("a06_greedy_optimum", _CURVE + f" SELECT {_CURVE_COLS} FROM best")
def _(m):
    return rel.greedy_optimum(rel.coverage_curve(m.month_members()))


def _core(m):
    mem = m.month_members()
    return rel.core(mem, rel.greedy_optimum(rel.coverage_curve(mem)))


@query("a07_core", _CURVE + " SELECT node, ctx, present FROM core")
def _(m):
    return _core(m)


@query("x08_covered_contexts", "SELECT ctx FROM mem GROUP BY ctx HAVING count(DISTINCT node) >= 90")
def _(m):
    return rel.covered_contexts(m.month_members(), 90)


@query("a16_labels", """, c AS (SELECT DISTINCT ctx FROM mem), d AS (SELECT DISTINCT node FROM mem)
SELECT node, string_agg(coalesce(CAST(present AS VARCHAR), '-'), '|' ORDER BY ctx) AS label FROM d CROSS JOIN c LEFT JOIN mem USING (node, ctx) GROUP BY node""")
def _(m):
    mem = m.month_members()
    return rel.labels(mem.select("node"), mem)


@query("a25_incomplete", f"SELECT node, {n('count(DISTINCT ctx)', 'n')} FROM mem GROUP BY node HAVING count(DISTINCT ctx) <> (SELECT count(DISTINCT ctx) FROM mem)")
def _(m):
    return rel.incomplete(m.month_members())


@query("j07_node_universe", _CURVE + f" SELECT {n('row_number() OVER (ORDER BY node) - 1', 'id')}, node FROM (SELECT DISTINCT node FROM core WHERE node IN (SELECT a FROM edges UNION SELECT b FROM edges))")
def _(m):
    return rel.node_universe(_core(m), m.edges())


@query("j09_membership", """, c AS (SELECT DISTINCT ctx FROM mem) SELECT node, ctx, CAST(coalesce(present, 0) AS BIGINT) AS present
FROM (SELECT p_partkey AS node FROM part) CROSS JOIN c LEFT JOIN mem USING (node, ctx)""")
def _(m):
    mem = m.month_members()
    return rel.complete_membership(m.parts().select(F.col("p_partkey").alias("node")), mem, mem)


@query("a14_union_counts", f"SELECT a, b, {n('count(*)', 'n')} FROM networks GROUP BY a, b")
def _(m):
    return rel.union_counts([m.networks()])


@query("a17_degree_by_union", f"SELECT node, {n('count(*)', 'degree')} FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node")
def _(m):
    e = m.edges()
    return e.select(F.col("a").alias("node")).union(e.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query("a18_edge_presence_share", f"SELECT a, b, {r('avg(x.present * y.present)', 'share')} FROM edges JOIN mem x ON x.node = a JOIN mem y ON y.node = b AND y.ctx = x.ctx GROUP BY a, b")
def _(m):
    return _presence_share(m, m.edges())


def _presence_share(m, e):
    return reports.edge_presence(e, m.month_members()).select("a", "b", "share")


@query("a19_node_presence_share", f"SELECT node, {r('sum(present) * 1.0 / count(*)', 'share')} FROM mem GROUP BY node")
def _(m):
    return m.month_members().groupBy("node").agg((F.sum("present") / F.count(F.lit(1))).alias("share"))


@query("a24_multi_distinct", f"""SELECT l_suppkey AS s, {n('count(DISTINCT l_partkey)', 'parts')}, {n('count(DISTINCT l_orderkey)', 'orders')}, {n("count(DISTINCT l_returnflag || '|' || l_linestatus)", 'states')},
{r('avg(l_extendedprice / nullif(l_quantity, 0))', 'unit')}, {r('avg(l_tax / nullif(l_discount, 0))', 'ratio')} FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 50""", ctes=False)
def _(m):
    li = m.table("lineitem")
    out = li.groupBy(F.col("l_suppkey").alias("s")).agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct(F.concat("l_returnflag", F.lit("|"), "l_linestatus")).alias("states"), F.avg(F.try_divide("l_extendedprice", "l_quantity")).alias("unit"), F.avg(F.try_divide("l_tax", "l_discount")).alias("ratio"))
    return out.filter("parts > 50").orderBy(F.desc("parts"))


@query("a26_set_sizes", f"SELECT {n('count(DISTINCT node)', 'nodes')}, {n('count(DISTINCT ctx)', 'contexts')} FROM mem")
def _(m):
    return m.month_members().agg(F.count_distinct("node").alias("nodes"), F.count_distinct("ctx").alias("contexts"))


@query("a27_summary", f"SELECT net, {n('min(d)', 'lo')}, {r('avg(d)', 'mean')}, {n('max(d)', 'hi')} FROM (SELECT net, node, count(*) AS d FROM (SELECT net, a AS node FROM networks UNION ALL SELECT net, b FROM networks) GROUP BY net, node) GROUP BY net")
def _(m):
    d = m.networks().select("net", F.explode(F.array("a", "b")).alias("node")).groupBy("net", "node").agg(F.count(F.lit(1)).alias("d"))
    return d.groupBy("net").agg(F.min("d").alias("lo"), F.avg("d").alias("mean"), F.max("d").alias("hi"))


_CLASS = """, cls AS (SELECT node, CASE WHEN sum(present) * 1.0 / count(ctx) <= 0.25 THEN 'TS' WHEN sum(present) * 1.0 / count(ctx) >= 0.75 THEN 'HK' ELSE 'None' END AS class FROM mem GROUP BY node)"""


@query("a28_class_pairs", _CLASS + f" SELECT least(x.class, y.class) AS class1, greatest(x.class, y.class) AS class2, {n('count(*)', 'n')} FROM edges JOIN cls x ON x.node = a JOIN cls y ON y.node = b GROUP BY 1, 2")
def _(m):
    c = rel.spread_class(rel.presence_counts(m.month_members()), 0.25)
    x, y = c.select(F.col("node").alias("a"), F.col("class").alias("x")), c.select(F.col("node").alias("b"), F.col("class").alias("y"))
    return m.edges().join(x, "a").join(y, "b").groupBy(rel.both_or_null(F.least, "x", "y").alias("class1"), rel.both_or_null(F.greatest, "x", "y").alias("class2")).agg(F.count(F.lit(1)).alias("n"))


@query("a33_contingency", f"SELECT p_type, {', '.join(n(f'count(*) FILTER (p_size % 3 = {k})', f's{k}') for k in range(3))} FROM part GROUP BY p_type", ctes=False)
def _(m):
    rest = F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))
    return m.table("part").withColumn("s", rest).groupBy("p_type").pivot("s", ["s0", "s1", "s2"]).count().na.fill(0)


# ---------------------------------------------------------------- overlaps


def _nets(m):
    return [x[0] for x in m.table("orders").select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # a handful


@query("a08_edge_venn", f"SELECT pattern, {n('count(*)', 'n')} FROM (SELECT a, b, string_agg(net, '+' ORDER BY net) AS pattern FROM networks GROUP BY a, b) GROUP BY pattern")
def _(m):
    nets = m.networks()
    names = _nets(m)
    v = overlap.venn(nets.withColumnRenamed("net", "source"), ["a", "b"], names)
    text = F.concat_ws("+", *[F.when(F.col(f"`{x}`") == 1, F.lit(x)) for x in names])
    return v.select(text.alias("pattern"), "n")


@query("a09_node_venn", f"SELECT pattern, {n('count(*)', 'n')} FROM (SELECT node, string_agg(net, '+' ORDER BY net) AS pattern FROM (SELECT net, a AS node FROM networks UNION SELECT net, b FROM networks) GROUP BY node) GROUP BY pattern")
def _(m):
    names = _nets(m)
    ends = m.networks().select(F.col("net").alias("source"), F.explode(F.array("a", "b")).alias("node")).distinct()
    v = overlap.venn(ends, ["node"], names)
    return v.select(F.concat_ws("+", *[F.when(F.col(f"`{x}`") == 1, F.lit(x)) for x in names]).alias("pattern"), "n")


@query("a11_id_overlap", f""", it AS (SELECT DISTINCT net AS s, a AS node FROM networks UNION SELECT net, b FROM networks), z AS (SELECT s, count(*) AS k FROM it GROUP BY s),
p AS (SELECT i.s AS x, j.s AS y, count(*) AS k FROM it i JOIN it j USING (node) WHERE i.s < j.s GROUP BY 1, 2)
SELECT zx.s AS x, zy.s AS y, {n('zx.k', 'size_x')}, {n('zy.k', 'size_y')}, {n('coalesce(p.k, 0)', 'size_xy')} FROM z zx JOIN z zy ON zx.s < zy.s LEFT JOIN p ON p.x = zx.s AND p.y = zy.s""")
def _(m):
    return overlap.pair_overlap(m.networks().select(F.col("net").alias("source"), F.explode(F.array("a", "b")).alias("node")).distinct(), ["node"])


@query("a12_network_coverage", _SMALL + f""" SELECT {n('(SELECT count(*) FROM (SELECT a FROM edges UNION SELECT b FROM edges))', 'n_nodes')}, {n('(SELECT count(*) FROM edges)', 'n_edges')},
{n('(SELECT count(*) FROM (SELECT a FROM edges UNION SELECT b FROM edges) WHERE a IN (SELECT id FROM small))', 'covered_nodes')}, {n('(SELECT count(*) FROM edges WHERE a IN (SELECT id FROM small) AND b IN (SELECT id FROM small))', 'covered_edges')}""")
def _(m):
    return overlap.coverage(m.edges(), _small(m).withColumnRenamed("id", "node"))


@query("a13_edge_overlap", f""", en AS (SELECT DISTINCT net, a AS node FROM networks UNION SELECT net, b FROM networks), z AS (SELECT net, count(*) AS k FROM networks GROUP BY net),
ins AS (SELECT w.net, e.net AS other, count(*) AS k FROM networks w JOIN en e ON e.node = w.a JOIN en f ON f.node = w.b AND f.net = e.net WHERE w.net <> e.net GROUP BY 1, 2),
sm AS (SELECT i.net AS x, j.net AS y, count(*) AS k FROM networks i JOIN networks j USING (a, b) WHERE i.net < j.net GROUP BY 1, 2)
SELECT zx.net AS x, zy.net AS y, {n('zx.k', 'size_x')}, {n('zy.k', 'size_y')}, {n('coalesce(p.k, 0)', 'shared_x')}, {n('coalesce(q.k, 0)', 'shared_y')}, {n('coalesce(sm.k, 0)', 'size_xy')}
FROM z zx JOIN z zy ON zx.net < zy.net LEFT JOIN ins p ON p.net = zx.net AND p.other = zy.net LEFT JOIN ins q ON q.net = zy.net AND q.other = zx.net LEFT JOIN sm ON sm.x = zx.net AND sm.y = zy.net""")
def _(m):
    return overlap.edge_overlap(stored(m.networks(), "networks"))


# ---------------------------------------------------------------- windows

_RATIO = ", c AS (SELECT node, count(ctx) AS total, sum(present) AS present FROM mem GROUP BY node)"


@query("w02_rank_by_ratio", _RATIO + f" SELECT node, {n('total', 'total')}, {n('present', 'present')}, {r('present * 1.0 / total', 'ratio')}, {n('row_number() OVER (ORDER BY CAST(present AS DOUBLE) / total, node)', 'rank')} FROM c")
def _(m):
    return stats.rank_by_ratio(rel.presence_counts(m.month_members())).select("node", "total", "present", "ratio", "rank")


@query("w03_top_share", "SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS c FROM part) WHERE r <= ceil(c * 0.2)", ctes=False)
def _(m):
    return stats.top_share(m.table("part"), ["p_brand"], "p_retailprice", 0.2, "p_partkey").select("p_partkey", "p_brand")


@query("w04_top_ten", "SELECT p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 10", ctes=False)
def _(m):
    return stats.top_k(m.table("part"), ["p_brand"], "p_retailprice", 10, "p_partkey").select("p_partkey", "p_brand")


@query("w05_ecdf", f"SELECT DISTINCT p_size AS p_size, {r('cume_dist() OVER (ORDER BY p_size)', 'freq')} FROM part".replace("p_size AS p_size", "CAST(p_size AS BIGINT) AS p_size"), ctes=False)
def _(m):
    return stats.ecdf(m.table("part"), "p_size")


@query("w06_lookup", f"SELECT {r('coalesce(count(*) FILTER (p_size < 20) * 1.0 / count(*), 0)', 'freq')}, {n('min(p_size) FILTER (p_size >= 20)', 'value')} FROM part", ctes=False)
def _(m):
    part = m.table("part")
    return stats.freq_below(stats.ecdf(part, "p_size"), "p_size", 20).crossJoin(stats.first_at_least(part, "p_size", 20))


@query("w06_lookup_table", f"""WITH e AS (SELECT p_retailprice AS x, count(*) AS k FROM part GROUP BY 1), c AS (SELECT CAST(x AS DOUBLE) AS x, sum(k) OVER (ORDER BY x) * 1.0 / sum(k) OVER () AS freq FROM e),
q AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) / 20 AS x FROM lineitem), lo AS (SELECT q.*, c.freq FROM q ASOF LEFT JOIN c ON q.x > c.x)
SELECT {n('l_orderkey', 'l_orderkey')}, {n('l_linenumber', 'l_linenumber')}, {r('coalesce(lo.freq, 0)', 'freq')}, {r('c.x', 'value')} FROM lo ASOF LEFT JOIN c ON lo.x <= c.x""", ctes=False)
def _(m):
    """Every line's price in the curve of the parts' prices."""
    prices = m.table("part").select(F.col("p_retailprice").cast("double").alias("price"))
    probes = m.table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice").cast("double") / 20).alias("x"))
    found = stats.look_up(probes, "x", stats.ecdf(prices, "price"), "price", {"freq": "freq"}, {"price": "value"})
    return found.select("l_orderkey", "l_linenumber", F.coalesce("freq", F.lit(0.0)).alias("freq"), "value")


@query("w07_threshold_curve", _RATIO + f", q AS (SELECT CAST(present AS DOUBLE) / total AS ratio FROM c) SELECT {r('a.ratio', 'ratio')}, {r('(SELECT count(*) FROM q WHERE ratio <= a.ratio) * 1.0 / (SELECT count(*) FROM q)', 'ts')}, {r('(SELECT count(*) FROM q WHERE ratio >= a.ratio) * 1.0 / (SELECT count(*) FROM q)', 'hk')} FROM (SELECT DISTINCT ratio FROM q) a")
def _(m):
    return stats.threshold_curve(rel.presence_counts(m.month_members()))


@query("w08_cumulative_share", f"SELECT CAST(present AS BIGINT) AS present, {n('k', 'k')}, {r('sum(k) OVER (ORDER BY present) * 1.0 / sum(k) OVER ()', 'share')} FROM (SELECT present, count(*) AS k FROM (SELECT node, sum(present) AS present FROM mem GROUP BY node) GROUP BY present)")
def _(m):
    c = rel.presence_counts(m.month_members()).groupBy("present").agg(F.count(F.lit(1)).alias("k"))
    return stats.cumulative_share(c, "present", "k")


@query("w12_quantile_bins", f"""SELECT 'all' AS k, {r('quantile_cont(p_retailprice, 0.1)', 'q1')}, {r('quantile_cont(p_retailprice, 0.5)', 'q5')}, {r('quantile_cont(p_retailprice, 0.9)', 'q9')} FROM part""", ctes=False)
def _(m):
    q = stats.quantiles(m.table("part"), "p_retailprice", [0.1, 0.5, 0.9])
    return m.spark.createDataFrame([("all", *(q or [None] * 3))], "k string, q1 double, q5 double, q9 double")


@query("w13_fixed_histogram", f"SELECT {n('CASE WHEN l_quantity = 0 THEN 1 ELSE ceil(l_quantity / 5.0) END', 'bin')}, {n('count(*)', 'n')} FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1", ctes=False)
def _(m):
    return stats.fixed_histogram(m.table("lineitem"), "l_quantity", 0, 50, 10)
