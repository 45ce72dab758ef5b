import pytest
from pyspark.sql import functions as F

from quiltnet.operators import overlap, relational
from quiltnet.sources import delimited, ontology_file, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_delimited_keeps_quotes_and_pads_short_rows(spark, tmp_path):
    (tmp_path / "x.tsv").write_text('#a\n#b\nid one\tname-2\tz\n1\t"q"\tx\n2\n3\tc\td\te\n')
    df = delimited.scan_delimited(spark, str(tmp_path / "x.tsv"), "\t", skip_rows=2)
    assert df.columns == ["id_one", "name_2", "z"]
    assert rows(df) == [("1", '"q"', "x"), ("2", "", ""), ("3", "c", "d")]
    assert rows(delimited.scan_delimited(spark, str(tmp_path / "x.tsv"), "\t", columns=[2, 0], skip_rows=2, types={"id_one": "int"})) == [("", 2), ("d", 3), ("x", 1)]
    no_header = delimited.scan_delimited(spark, str(tmp_path / "x.tsv"), "\t", header=False, skip_rows=3)
    assert no_header.columns == ["Column_0", "Column_1", "Column_2"] and no_header.count() == 3


def test_skip_rows_holds_for_each_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text(f"junk\na,b\n{k},x\n{k + 10},y\n")
    assert rows(delimited.scan_delimited(spark, str(tmp_path), skip_rows=1)) == [("0", "x"), ("1", "x"), ("10", "y"), ("11", "y"), ("12", "y"), ("2", "x")]


def test_quoted(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"1, 2","say ""x"""\n3,\n')
    assert rows(delimited.scan_delimited(spark, str(tmp_path / "q.csv"), quote='"')) == [("1, 2", 'say "x"'), ("3", "")]


def test_mitab_and_scored_network(spark, tmp_path):
    line = lambda a, b, c: "\t".join([a, b, *["-"] * 12, c])
    (tmp_path / "m.tsv").write_text("\n".join([line("uniprotkb:P1-2", "uniprotkb:Q9", "s:0.5"), line("chebi:1", "uniprotkb:A0", "")]))
    got = {(r[0], r[1], r[2]) for r in delimited.scan_mitab(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {("P1", "Q9", "s:0.5"), (None, "A0", "")}
    (tmp_path / "s.txt").write_text("9606.a 9606.b 700\n9606.a 9606.c 499\n10090.a 9606.b 900\n")
    assert rows(delimited.scan_scored_network(spark, str(tmp_path / "s.txt"), "9606.", 500)) == [("a", "b", 700)]


def test_obo(spark, tmp_path):
    (tmp_path / "g.obo").write_text(
        "format-version: 1.2\n\n[Term]\nid: GO:0000001\nname: root\nnamespace: p\n\n[Term]\nid: GO:0000002\nname: kid\nnamespace: p\nalt_id: GO:0000009\nis_a: GO:0000001 ! root\nis_a: GO:0000007 ! elsewhere\n\n"
        "[Term]\nid: GO:0000003\nname: gone\nnamespace: p\nis_obsolete: true\nis_a: GO:0000001\n\n[Term]\nid: GO:0000007\nname: other\nnamespace: f\n\n[Typedef]\nid: part_of\nname: part of\n"
    )
    terms, is_a, alts = ontology_file.scan_obo(spark, str(tmp_path / "g.obo"), "p")
    assert rows(terms.select("id", "name")) == [(1, "root"), (2, "kid")] and rows(is_a) == [(2, 1)] and rows(alts) == [(9, 2)]
    assert ontology_file.scan_obo(spark, str(tmp_path / "g.obo"), obsolete=True)[0].count() == 4


def test_dump_and_caches(spark, tmp_path):
    df = frame(spark, [(1, "a"), (2, None)], "k int, v string")
    tables.dump_table(df, str(tmp_path / "d"))
    assert rows(delimited.scan_delimited(spark, str(tmp_path / "d"), " ")) == [("1", "a"), ("2", "")]
    with pytest.raises(Exception, match="separator"):
        tables.dump_table(frame(spark, [(1, "a b")], "k int, v string"), str(tmp_path / "e"))
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert tables.cached_frame(spark, str(tmp_path / "c"), build).count() == 2
    assert len(calls) == 1
    assert tables.run_script(spark, "CREATE OR REPLACE TEMP VIEW v AS SELECT 1 AS x;\nSELECT x + 1 AS y FROM v;\n").collect()[0]["y"] == 2
    assert tables.table_exists(spark, "v") and tables.column_names(spark, "v") == ["x"]


def test_mapping_rules(spark):
    one = frame(spark, [("k", "b"), ("k", "a"), ("", "x"), ("n", "")], "k string, v string")
    two = frame(spark, [("k", "c"), ("m", "d"), ("n", "e")], "k string, v string")
    m = relational.mapping_table([one, two], "k", "v")
    assert rows(m) == [("k", "a"), ("m", "d"), ("n", "e")]
    e = frame(spark, [("k", "m"), ("k", "q"), (None, "k")], "a string, b string")
    assert rows(relational.map_ids(e, ["a", "b"], m, "k", "v")) == [("a", "d")]
    assert rows(relational.unmatched(e, "b", m, "k")) == [("k", "q")]
    assert rows(relational.any_unmatched(e, ["a", "b"], m, "k")) == [("k", "q")]
    s = relational.mapping_stats(e, "a", m, "k").first()
    assert (s["rows_matched"], s["rows_null"], s["ids_matched"]) == (2, 1, 1)


def test_edges_and_cores(spark):
    e = frame(spark, [("b", "a"), ("a", "b"), ("a", "a"), (None, "a")], "x string, y string")
    assert rows(relational.canonical_edges(e, "x", "y")) == [("a", "a"), ("a", "b")]
    cells = [(n, c, (n + c) % 2) for n in range(6) for c in range(4) if not (n == 5 and c > 1) and not (c == 3 and n > 1)]
    mem = frame(spark, cells, "node long, ctx long, present long")
    curve = relational.coverage_curve(mem)
    assert rows(curve) == [(2, 4, 2, 8), (5, 3, 5, 15), (6, 2, 6, 12)]
    best = relational.greedy_optimum(curve)
    got = relational.core(mem, best)
    assert got.select("node").distinct().count() == 5 and got.select("ctx").distinct().count() == 3 and got.count() == 15
    lab = {r["node"]: r["label"] for r in relational.labels(mem, mem).collect()}
    assert lab[5] == "1|0|-|-" and lab[0] == "0|1|0|1"
    assert {r["node"] for r in relational.labels(mem, mem, complete_only=True).collect()} == {0, 1}
    ids = rows(relational.id_table(mem, "node"))
    assert ids == [(k + 1, k) for k in range(6)]


def test_ordinal_and_real(spark):
    df = frame(spark, [("High", "1.5"), ("Negative", "x"), ("odd", ""), (None, None)], "w string, t string")
    assert [r[0] for r in df.select(relational.ordinal("w")).collect()] == [3.0, 0.0, None, None]
    assert [r[0] for r in df.select(relational.real("t")).collect()] == [1.5, 0.0, 0.0, 0.0]


def test_venn_and_overlap(spark):
    items = overlap.tagged({"x": frame(spark, [(1,), (2,), (2,)], "k int"), "y": frame(spark, [(2,), (3,)], "k int"), "z": frame(spark, [(9,)], "k int")}, ["k"])
    v = overlap.venn(items, ["k"], ["x", "y", "z"])
    assert rows(overlap.venn_weights(v, ["x", "y", "z"])) == [("001", 1), ("010", 1), ("100", 1), ("110", 1)]
    assert rows(overlap.pair_overlap(items, ["k"])) == [("x", "y", 2, 2, 1), ("x", "z", 2, 1, 0), ("y", "z", 2, 1, 0)]


def test_both_or_null(spark):
    df = frame(spark, [(1, 2), (None, 2)], "x int, y int")
    assert [r[0] for r in df.select(relational.both_or_null(F.least, "x", "y")).collect()] == [1, None]
