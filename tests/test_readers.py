"""Readers of delimited text: quotes over line breaks, splits inside records, preambles of many files."""

import csv
import io

import numpy as np
import pytest

from quiltnet.sources import delimited, tables


def test_open_cells_agree_with_the_csv_module():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        line = "".join(rng.choice(list('a",b'), int(rng.integers(0, 9))))
        rows = list(csv.reader([line, 'x"']))
        assert delimited.open_after(line, False, ",", '"') == (len(rows) == 1 or rows[0] == []) or not line, line


@pytest.mark.parametrize("split", [None, 150])
def test_records_cross_lines_and_splits(spark, tmp_path, split):
    rng, want = np.random.default_rng(3), []
    words = ["a", "two words", 'q"uote', "com,ma", "li\nne", "two\n\nlines", "", " x", '"', '5" pipe', "long " * 30]
    for f in range(3):
        rows = [[f"{f}.{k}", *(str(x) for x in rng.choice(words, 2))] for k in range(60)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(rows)
        (tmp_path / f"{f}.csv").write_text("a preamble, with a comma\nid,x,y\n" + out.getvalue() + ("\n" if f else ""))
        want += [tuple(r) for r in rows]
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = delimited.scan_delimited(spark, str(tmp_path), quote='"', skip_rows=1).collect()
        plain = delimited.scan_delimited(spark, str(tmp_path), names=["l"], columns=[0], skip_rows=1, header=False).count()
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{name}")
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert plain == sum((tmp_path / f"{f}.csv").read_text().count("\n") - 1 for f in range(3))


def test_many_files_are_one_scan(spark, tmp_path):
    for f in range(60):
        (tmp_path / f"{f}.tsv").write_text(f"x\ty\n{f}\t{f}\n")
    df = delimited.scan_delimited(spark, str(tmp_path), "\t")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert df.count() == 60 and df.agg({"x": "min"}).first()[0] == "0"
    quoted = delimited.scan_delimited(spark, str(tmp_path), "\t", quote='"')
    assert quoted.count() == 60


def test_scripts_split_outside_of_text(spark):
    tables.run_script(spark, "CREATE OR REPLACE TEMP VIEW semi AS SELECT 'a;\nb' AS x, \"c;\n\" AS y; -- a remark;\nCREATE OR REPLACE TEMP VIEW two AS SELECT 1 AS `o;\nk` /* not;\n here */;\n")
    assert tuple(spark.table("semi").first()) == ("a;\nb", "c;\n")
    assert spark.table("two").first()[0] == 1


def test_lines_are_written_by_every_task(spark):
    from types import SimpleNamespace

    from quiltnet.plans.source_queries import lines

    m, body = SimpleNamespace(spark=spark), spark.range(1000, numPartitions=4).selectExpr("concat('\"', id, '\"')")
    at = lines(m, "spread", body, "# a remark", '"k"')
    sizes = [r["count"] for r in spark.read.text(at).groupBy("_metadata.file_path").count().collect()]
    assert sizes == [252] * 4
    got = delimited.scan_delimited(spark, at, quote='"', skip_rows=1, types={"k": "long"}).collect()
    assert sorted(r["k"] for r in got) == list(range(1000))
    assert spark.read.text(lines(m, "spread", body, "top", once=True)).filter("value = 'top'").count() == 1
