import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """A small documents table with every awkward case, and columns whose names clash with the operators' own."""
    rows = [(r[0], r[1], r[2], r[3]) for r in duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' WHERE doc_id < 60 ORDER BY doc_id").fetchall()]
    long = "word " * 3000
    rows += [
        (9000, None, "en", None), (9001, "", "en", "s"), (9002, " \t\n\x0b ", None, "s"), (9003, "One two", "en", "s"), (9003, "One two", "en", "s"),
        (9004, "one TWO", "en", "t"), (9005, long, "en", "s"), (9006, long + "end", "en", "s"), (None, rows[3][1], "en", None), (9007, "é" * 60, "fr", "s"),
        (9008, "x" * 300, "en", "s"), (9003, "another text under the same id", "en", "s"), (9009, "<|endoftext|> it's A<b a,b ***", "en", "s"),
    ]
    schema = "doc_id long, text string, lang string, source string, g long, bucket string, n_words int, tag string, score double"
    return spark.createDataFrame([(*r, 1, "b", 2, "t", 0.5) for r in rows], schema)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
