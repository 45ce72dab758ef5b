"""Scans and sinks of every known kind: tables are written to the shared folder in a source's form and read back."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from ..operators import graph, overlap
from ..operators import relational as rel
from ..sources import definitions, delimited, ontology_file, tables
from .lineage import fresh_path, stored
from .registry import n, query, r

TAB = "\t"
FLAGS = ["flag_a", "flag_n", "flag_r"]


def lines(m, name, body, *preamble, once=False):
    """A folder of text files, one per task: preamble lines, then one line per row of body (a column of one table).
    once: the preamble stands in the first file only."""
    at = fresh_path(m.spark, name)

    def run(it):
        if preamble and not (once and TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([pa.array(preamble, pa.string())], ["value"])
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    rows = body.toDF("value")
    (rows.mapInArrow(run, "value string") if preamble else rows).write.text(at)
    return at


@query("s05_row_transform", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand FROM part", ctes=False)
def _(m):
    at = lines(m, "prefixed", m.parts().select(F.concat(F.lit("9606."), "p_partkey", F.lit(TAB + "9606."), "p_brand")))
    return delimited.scan_delimited(m.spark, at, TAB, header=False, names=["id", "brand"], transform=delimited.strip_prefix("9606."))


@query("s06_quoted_preamble", "SELECT CAST(p_partkey AS BIGINT) AS k, p_name || ', \"new\"' AS name FROM part", ctes=False)
def _(m):
    row = F.concat(F.lit('"'), "p_partkey", F.lit('","'), "p_name", F.lit(', ""new"""'))
    at = lines(m, "quoted", m.parts().select(row), "# a preamble", "# of two lines", '"k","name"')
    return delimited.scan_delimited(m.spark, at, ",", quote='"', skip_rows=2, types={"k": "long"})


@query("s10_crlf_ontology", "SELECT CAST(p_partkey + 1 AS BIGINT) AS id, p_name AS name, 'part' AS namespace, CAST(0 AS BIGINT) AS parent FROM part WHERE p_size % 2 = 0", ctes=False)
def _(m):
    """Carriage returns, a comment with brackets, another kind of stanza, another namespace and obsolete terms."""
    end = F.lit("\r")
    body = F.concat_ws("\n", F.concat(F.lit("[Term]"), end), F.concat(F.lit("id: GO:"), F.col("p_partkey") + 1, end), F.concat(F.lit("name: "), "p_name", end), F.concat(F.lit("namespace: "), F.when(F.col("p_size") % 2 == 0, "part").otherwise("other"), end), F.concat(F.lit("is_a: GO:0 ! root"), end), end)
    root = ["[Term]\r", "id: GO:0\r", "name: root\r", "namespace: part\r", "\r", "[Typedef]\r", "id: part_of\r", "\r", "[Term]\r", "id: GO:99999999\r", "name: gone\r", "namespace: part\r", "is_obsolete: true\r", "is_a: GO:0 ! root\r", "\r"]
    at = lines(m, "crlf", m.parts().select(body), "format-version: 1.2\r", "\r", *root, once=True)
    terms, is_a, _ = ontology_file.scan_obo(m.spark, at, "part")
    return terms.join(is_a, terms["id"] == is_a["child"]).select("id", "name", "namespace", "parent")


@query("f19_obsolete_terms", f"SELECT {n('count(*)', 'terms')}, {n('count(*) FILTER (p_size > 40)', 'obsolete')} FROM part", ctes=False)
def _(m):
    body = F.concat_ws("\n", F.lit("[Term]"), F.concat(F.lit("id: GO:"), "p_partkey"), F.concat(F.lit("name: "), "p_name"), F.lit("namespace: part"), F.when(F.col("p_size") > 40, F.lit("is_obsolete: true")), F.lit(""))
    terms, _, _ = ontology_file.scan_obo(m.spark, lines(m, "obsolete", m.parts().select(body)), "part", obsolete=True)
    return terms.agg(F.count(F.lit(1)).alias("terms"), F.count(F.when(F.col("is_obsolete"), 1)).alias("obsolete"))


@query("s11_annotation_preamble", "SELECT p_name AS gene, CAST(p_partkey AS BIGINT) AS term FROM part", ctes=False)
def _(m):
    row = F.concat_ws(TAB, F.lit("DB"), F.lit("id"), "p_name", F.lit(""), F.concat(F.lit("GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")))
    at = lines(m, "gaf", m.parts().select(row), *[f"!line {k}" for k in range(12)])
    return delimited.scan_annotations(m.spark, at).select(F.col("Gene").alias("gene"), F.split("GOTerm", ":")[1].cast("long").alias("term"))


@query("s12_services", "SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'mint' ELSE 'dip' END AS service, 'P' || l_partkey AS g1, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'S' || l_suppkey END AS g2, 'score:' || l_linenumber AS confidence FROM lineitem", ctes=False)
def _(m):
    at = fresh_path(m.spark, "services")
    ident = F.when(F.col("l_suppkey") % 3 == 0, F.lit("intact:x")).otherwise(F.concat(F.lit("uniprotkb:S"), "l_suppkey"))
    row = F.concat_ws(TAB, F.concat(F.lit("uniprotkb:P"), "l_partkey"), ident, *[F.lit("-")] * 12, F.concat(F.lit("score:"), "l_linenumber"))
    li = m.table("lineitem").select(F.when(F.col("l_linenumber") % 2 == 0, "MINT").otherwise("DIP").alias("service"), row.alias("value"))
    li.write.partitionBy("service").text(at)
    got = delimited.scan_services(m.spark, at + "/service=*", r"service=(\w+)/[^/]*$")
    return got.select("service", F.col("Gene1").alias("g1"), F.col("Gene2").alias("g2"), "confidence")


@query("s14_script", f"SELECT p_brand, {n('count(*)', 'k')} FROM part WHERE p_size > 10 GROUP BY 1", ctes=False)
def _(m):
    view = "script_" + uuid.uuid4().hex
    return tables.run_script(m.spark, f"CREATE OR REPLACE TEMP VIEW {view} AS SELECT p_brand, p_size FROM parquet.`{m.dir}/part.parquet`;\nSELECT p_brand, count(*) AS k FROM {view} WHERE p_size > 10 GROUP BY p_brand;\n")


@query("s15_create_as_select", "SELECT p_brand AS brand, 'brand,k' AS columns, TRUE AS before_drop, FALSE AS after_drop, CAST(count(*) AS BIGINT) AS k FROM part GROUP BY 1", ctes=False)
def _(m):
    """Replaced once, then left alone; its columns and whether it is there, before and after it is dropped."""
    name, brands = "created_" + uuid.uuid4().hex, m.parts().groupBy(F.col("p_brand").alias("brand"))
    tables.create_table(brands.agg(F.lit(0).cast("long").alias("k")), name)
    tables.create_table(brands.agg(F.count(F.lit(1)).alias("k")), name)
    tables.create_table(brands.agg(F.lit(7).cast("long").alias("k")), name, overwrite=False)
    columns, there = ",".join(tables.column_names(m.spark, name)), tables.table_exists(m.spark, name)
    rows = stored(m.spark.table(name), "created")
    m.spark.sql(f"DROP TABLE {name}")
    return rows.select("brand", F.lit(columns).alias("columns"), F.lit(there).alias("before_drop"), F.lit(tables.table_exists(m.spark, name)).alias("after_drop"), "k")


@query("s25_timings", f"SELECT {n('l_linenumber', 'T')}, round(sum(l_quantity), 6) + 0.0 AS naive, round(sum(l_tax), 6) + 0.0 AS fast FROM lineitem GROUP BY 1", ctes=False)
def _(m):
    return delimited.scan_timings(m.spark, _timings(m)).withColumn("T", F.col("T").cast("long"))


def _timings(m):
    body = m.table("lineitem").groupBy(F.col("l_linenumber").alias("T")).agg(F.round(F.sum("l_quantity"), 6).alias("naive"), F.round(F.sum("l_tax"), 6).alias("fast"))
    return lines(m, "timings", body.select(F.concat_ws(";", F.format_string("%d", F.col("T").cast("long")), F.col("naive").cast("string"), F.col("fast").cast("string"))), "T;naive;fast")


@query("r25_benchmark_speedups", "SELECT round(sum(l_quantity), 6) + 0.0 AS naive, round(sum(l_tax), 6) + 0.0 AS fast, round(sum(l_quantity) / sum(l_tax), 6) + 0.0 AS fast_speedup FROM lineitem", ctes=False)
def _(m):
    from ..functions import reports

    return reports.speedups(delimited.scan_timings(m.spark, _timings(m)), "naive", "fast").select(*[F.round(c, 6).alias(c) for c in ("naive", "fast", "fast_speedup")])


@query("s26_gene_list", "SELECT CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_size > 25", ctes=False)
def _(m):
    return delimited.scan_gene_list(m.spark, lines(m, "genes", m.parts().filter("p_size > 25").select(F.col("p_partkey").cast("string"))))


_HPA = ('"Gene","Tissue","Cell_Type","Level","Expression_type","Reliability"',)


def _hpa(m):
    level = F.element_at(F.array(*map(F.lit, ("Negative", "Weak", "Moderate", "Strong", "None", "Low", "Medium", "High"))), (F.col("l_linenumber") % 8 + 1).cast("int"))
    kind = F.when(F.col("l_returnflag") == "A", "APE").otherwise("Staining")
    trust = F.when(F.col("l_linestatus") == "F", "High").otherwise(F.when(F.col("l_returnflag") == "N", "Supportive").otherwise("Low"))
    cells = [F.col("l_partkey").cast("string"), F.col("l_linestatus"), F.concat(F.lit("cell, "), "l_returnflag"), level, kind, trust]
    return lines(m, "hpa", m.table("lineitem").select(F.concat(F.lit('"'), F.concat_ws('","', *cells), F.lit('"'))), *_HPA)


_HPA_ROWS = """WITH h AS (SELECT CAST(l_partkey AS VARCHAR) AS g, l_linestatus || ' - cell, ' || l_returnflag AS ctx, [0, 1, 2, 3, 0, 1, 2, 3][CAST(l_linenumber % 8 + 1 AS INTEGER)] AS v,
l_returnflag = 'A' AS ape, CASE WHEN l_linestatus = 'F' THEN 'High' WHEN l_returnflag = 'N' THEN 'Supportive' ELSE 'Low' END AS t FROM lineitem)"""


@query("s27_quoted_reliable", _HPA_ROWS + f" SELECT ctx, {n('count(*)', 'rows')} FROM h WHERE (ape AND t = 'High') OR (NOT ape AND t = 'Supportive') GROUP BY 1", ctes=False)
def _(m):
    raw = delimited.scan_delimited(m.spark, _hpa(m), ",", quote='"')
    return rel.reliable(raw).groupBy(rel.composite("Tissue", "Cell_Type").alias("ctx")).agg(F.count(F.lit(1)).alias("rows"))


@query("f03_all_rows_policy", _HPA_ROWS + f" SELECT ctx, {n('count(*)', 'rows')} FROM h GROUP BY 1", ctes=False)
def _(m):
    raw = delimited.scan_delimited(m.spark, _hpa(m), ",", quote='"')
    return rel.reliable(raw, policy="all").groupBy(rel.composite("Tissue", "Cell_Type").alias("ctx")).agg(F.count(F.lit(1)).alias("rows"))


@query("f01_renamed_columns", "SELECT l_partkey AS \"Gene1\", l_suppkey AS \"Gene2\" FROM lineitem", ctes=False)
def _(m):
    return m.table("lineitem").select(F.col("l_partkey").alias("Gene1"), F.col("l_suppkey").alias("Gene2"))


@query("f12_one_hot", f"SELECT p_partkey AS node, {n('1', 'air')}, {n('0', 'rail')}, {n('0', 'ship')} FROM part", ctes=False)
def _(m):
    return rel.one_hot(m.parts().select(F.col("p_partkey").alias("node")), ["air", "rail", "ship"], "air")


# ---------------------------------------------------------------- identifier tables


@query("x01_chip_table", "SELECT 'at_' || p_partkey AS chip_annot, p_brand AS hgnc FROM part", ctes=False)
def _(m):
    at = lines(m, "gnf1h", m.parts().select(F.concat_ws(TAB, F.concat(F.lit("at_"), "p_partkey"), "p_brand", F.lit("more"))), "ProbesetID\tSymbol\tmore")
    return delimited.scan_id_table(m.spark, at, "gnf1h")


@query("x02_chip_table_with_preamble", "SELECT 'at_' || p_partkey AS chip_annot, p_brand AS hgnc, CAST(p_size AS VARCHAR) AS entrez FROM part", ctes=False)
def _(m):
    cells = [F.concat(F.lit("at_"), "p_partkey"), *[F.lit("")] * 9, F.col("p_brand"), F.col("p_size").cast("string")]
    at = lines(m, "u133a", m.parts().select(F.concat_ws(TAB, *cells)), *[f"# {k}" for k in range(16)], TAB.join(f"c{k}" for k in range(12)))
    return delimited.scan_id_table(m.spark, at, "u133a")


@query("x03_mart_table", "SELECT 'E' || p_partkey AS ensembl, 'P' || p_partkey AS ensp, p_brand AS hgnc, 'U' || p_partkey AS uniprot, 'H' || p_size AS hgnc_id, CAST(p_size AS VARCHAR) AS entrez FROM part", ctes=False)
def _(m):
    cells = [F.concat(F.lit("E"), "p_partkey"), F.concat(F.lit("P"), "p_partkey"), F.col("p_brand"), F.concat(F.lit("U"), "p_partkey", F.lit("_HUMAN")), F.concat(F.lit("H"), "p_size"), F.col("p_size").cast("string")]
    return delimited.scan_id_table(m.spark, lines(m, "mart", m.parts().select(F.concat_ws(",", *cells)), "a,b,c,d,e,f"), "biomart")


@query("x04_nomenclature_table", "SELECT 'H' || p_partkey AS hgnc_id, p_brand AS hgnc, p_name AS hgnc_name, 'Approved' AS status, CASE WHEN p_size % 2 = 0 THEN 'n' || p_size ELSE 'o' || p_size END AS entrez, 'E' || p_partkey AS ensembl, 'U' || p_partkey AS uniprot FROM part", ctes=False)
def _(m):
    second = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("n"), "p_size")).otherwise(F.lit(""))
    cells = [F.concat(F.lit("H"), "p_partkey"), F.col("p_brand"), F.col("p_name"), F.lit("Approved"), F.concat(F.lit("o"), "p_size"), F.concat(F.lit("E"), "p_partkey"), second, F.concat(F.lit("U"), "p_partkey"), F.lit("")]
    return delimited.scan_id_table(m.spark, lines(m, "hgnc", m.parts().select(F.concat_ws(TAB, *cells)), TAB.join("abcdefghi")), "hgnc")


# ---------------------------------------------------------------- whole sources, stage by stage


def _source(items, name):
    return next(s for s in items if s.name == name)


@query("x09_network_stages", "SELECT DISTINCT least(x.p_name, y.p_name) AS a, greatest(x.p_name, y.p_name) AS b FROM lineitem JOIN part x ON x.p_partkey = l_partkey JOIN part y ON y.p_partkey = l_suppkey", ctes=False)
def _(m):
    """Prefixed ids scanned, mapped through a table that lacks some, undirected and distinct."""
    row = F.concat(F.lit("9606."), "l_partkey", F.lit(" 9606."), "l_suppkey", F.lit(" "), "l_linenumber")
    at = lines(m, "string", m.table("lineitem").select(row))
    mapping = rel.mapping_table([m.parts().select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))], "key", "value")
    return definitions.load_network(m.spark, _source(definitions.NETWORKS, "string"), at, mapping)


@query("x10_network_sources", """SELECT s AS source, CAST(count(*) AS BIGINT) AS edges FROM (SELECT DISTINCT s, least(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS a, greatest(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS b
FROM lineitem, (VALUES ('bossi'), ('ccsb'), ('havu'), ('psicquic'), ('string')) t(s)) GROUP BY 1""", ctes=False)
def _(m):
    li, out = m.table("lineitem"), None
    for s in definitions.NETWORKS:
        if s.mitab:
            row = F.concat_ws(TAB, F.concat(F.lit("uniprotkb:"), "l_partkey"), F.concat(F.lit("uniprotkb:"), "l_suppkey"), *[F.lit("-")] * 13)
        else:
            row = F.concat(F.lit(s.prefix), "l_partkey", F.lit(s.sep + s.prefix), "l_suppkey", F.lit(s.sep), "l_linenumber")
        at = lines(m, s.name, li.select(row), *([s.sep.join((s.first, s.second, "more"))] if s.header else []))
        one = definitions.load_network(m.spark, s, at).agg(F.count(F.lit(1)).alias("edges")).withColumn("source", F.lit(s.name))
        out = one if out is None else out.unionByName(one)
    return out


@query("x10_matrix_source", f"SELECT p_brand AS node, ctx, {r('max(v)', 'value')}, {n('CASE WHEN max(v) >= 1000 / 10 THEN 1 ELSE 0 END', 'present')} FROM (SELECT p_brand, unnest(['Liver', 'Lung']) AS ctx, unnest([CAST(p_size AS DOUBLE), p_retailprice / 10]) AS v FROM part) GROUP BY 1, 2", ctes=False)
def _(m):
    at = lines(m, "atlas", m.parts().select(F.concat_ws(",", "p_brand", F.col("p_size").cast("double").cast("string"), (F.col("p_retailprice") / 10).cast("string"))), "Gene_ID,Liver,Lung")
    return definitions.load_measurements(m.spark, _source(definitions.MEASUREMENTS, "gene_atlas"), at)


@query("x10_row_source", _HPA_ROWS + f" SELECT g AS node, ctx, {r('max(v)', 'value')}, {n('CASE WHEN max(v) >= 1 THEN 1 ELSE 0 END', 'present')} FROM h WHERE (ape AND t = 'High') OR (NOT ape AND t = 'Supportive') GROUP BY 1, 2", ctes=False)
def _(m):
    return definitions.load_measurements(m.spark, _source(definitions.MEASUREMENTS, "hpa"), _hpa(m))


# ---------------------------------------------------------------- overlaps and joins of whole sources


@query("a10_measured_id_venn", f"SELECT flag_a, flag_n, flag_r, {n('count(*)', 'n')} FROM (SELECT l_partkey, CAST(max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS flag_a, CAST(max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS flag_n, CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS flag_r FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1) GROUP BY 1, 2, 3", ctes=False)
def _(m):
    return overlap.venn(_modes(m), ["node"], FLAGS)


def _modes(m):
    li = m.table("lineitem")
    return overlap.tagged({k: li.filter(F.col("l_returnflag") == k[-1].upper()).select(F.col("l_partkey").alias("node")) for k in FLAGS}, ["node"])


@query("r24_venn_weights", f"SELECT pattern, {n('count(*)', 'n')} FROM (SELECT l_partkey, CAST(max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS VARCHAR) || CAST(max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS VARCHAR) || CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS VARCHAR) AS pattern FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1) GROUP BY 1", ctes=False)
def _(m):
    return overlap.venn_weights(overlap.venn(_modes(m), ["node"], FLAGS), FLAGS)


@query("r23_overlap_percent", f"""WITH t AS (SELECT DISTINCT 'flag_' || l_returnflag AS s, l_partkey AS p FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')), z AS (SELECT lower(s) AS s, count(*) AS k FROM t GROUP BY 1), b AS (SELECT lower(x.s) AS x, lower(y.s) AS y, count(*) AS k FROM t x JOIN t y ON x.p = y.p AND x.s < y.s GROUP BY 1, 2)
SELECT x, y, {n('u.k', 'size_x')}, {n('v.k', 'size_y')}, {n('b.k', 'size_xy')}, {r('100.0 * b.k / u.k', 'percent_x')}, {r('100.0 * b.k / v.k', 'percent_y')} FROM b JOIN z u ON u.s = x JOIN z v ON v.s = y""", ctes=False)
def _(m):
    return overlap.overlap_percent(overlap.pair_overlap(_modes(m), ["node"]))


@query("a12_pairwise_coverage", f""", mc AS (SELECT DISTINCT node, ctx FROM mem WHERE present <> 0), nn AS (SELECT DISTINCT net, a AS node FROM networks UNION SELECT net, b FROM networks),
x AS (SELECT net, ctx, count(*) AS k FROM nn JOIN mc USING (node) GROUP BY 1, 2), y AS (SELECT net, u.ctx, count(*) AS k FROM networks JOIN mc u ON u.node = a JOIN mc v ON v.node = b AND v.ctx = u.ctx GROUP BY 1, 2)
SELECT net, ctx, {n('x.k', 'covered_nodes')}, {n('coalesce(y.k, 0)', 'covered_edges')} FROM x LEFT JOIN y USING (net, ctx)""")
def _(m):
    """Every network with every context in one job: both are columns."""
    return overlap.pairwise_coverage(m.networks(), m.month_members())


@query("u09_networks_by_contexts", f""", mc AS (SELECT DISTINCT node, ctx FROM mem WHERE present <> 0), e AS (SELECT net, u.ctx, a, b FROM networks JOIN mc u ON u.node = a JOIN mc v ON v.node = b AND v.ctx = u.ctx),
d AS (SELECT net, ctx, node, count(*) AS k FROM (SELECT net, ctx, a AS node FROM e UNION ALL SELECT net, ctx, b FROM e) GROUP BY 1, 2, 3) SELECT net, ctx, {n('count(*)', 'nodes')}, {n('max(k)', 'max_degree')}, {r('avg(k)', 'mean_degree')} FROM d GROUP BY 1, 2""")
def _(m):
    mem = stored(m.month_members(), "members")
    e, words = graph.packed_edges(m.networks(), mem)
    e = e.filter(graph.shared(words, "p") > 0)
    ctx = range(mem.agg(F.max("ctx")).first()[0] + 1)
    own = lambda c: F.getbit(F.col(f"a_p{c // graph.WORD}").bitwiseAND(F.col(f"b_p{c // graph.WORD}")), F.lit(c % graph.WORD)).cast("long")
    bits = [own(c).alias(f"c{c}") for c in ctx]
    d = e.select("net", F.explode(F.array("a", "b")).alias("node"), *bits).groupBy("net", "node").agg(*[F.sum(f"c{c}").alias(f"c{c}") for c in ctx])
    d = d.select("net", F.posexplode(F.array(*[f"c{c}" for c in ctx])).alias("ctx", "k")).filter("k > 0").withColumn("ctx", F.col("ctx").cast("long"))
    return d.groupBy("net", "ctx").agg(F.count(F.lit(1)).alias("nodes"), F.max("k").alias("max_degree"), F.avg("k").alias("mean_degree"))


@query("j11_complete_labels", """, c AS (SELECT count(DISTINCT ctx) AS k FROM mem) SELECT node, string_agg(CAST(present AS VARCHAR), '|' ORDER BY ctx) AS label FROM mem GROUP BY node HAVING count(*) = (SELECT k FROM c)""")
def _(m):
    mem = m.month_members()
    return rel.labels(mem.select("node"), mem, complete_only=True)


@query("j18_frame_merge", f"SELECT n_nationkey, n_regionkey, {n('s', 'suppliers')}, {n('c', 'customers')} FROM nation JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS s FROM supplier GROUP BY 1) USING (n_nationkey) JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer GROUP BY 1) USING (n_nationkey)", ctes=False)
def _(m):
    s = m.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = m.table("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return rel.merge(rel.merge(m.table("nation").select("n_nationkey", "n_regionkey"), s), c)


@query("w10_ordered_rows", f"SELECT {n('row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)', 'place')}, p_partkey FROM part", ctes=False)
def _(m):
    key = F.struct((-F.col("p_retailprice")).alias("price"), "p_partkey")
    return rel.id_table(m.parts().select(key.alias("k")), "k").select(F.col("id").alias("place"), "k.p_partkey")


@query("scalar_both_or_null", f"SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_tax > 0 THEN least(l_discount, l_tax) END', 'low')}, {r('CASE WHEN l_tax > 0 THEN greatest(l_discount, l_tax) END', 'high')} FROM lineitem", ctes=False)
def _(m):
    tax = F.when(F.col("l_tax") > 0, F.col("l_tax"))
    return m.table("lineitem").select("l_orderkey", "l_linenumber", rel.both_or_null(F.least, "l_discount", tax).alias("low"), rel.both_or_null(F.greatest, "l_discount", tax).alias("high"))
