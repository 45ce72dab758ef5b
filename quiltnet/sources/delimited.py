"""Delimited files: no type inference, missing cells are empty strings, short rows are padded."""

from __future__ import annotations

import csv
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import stored


def clean_name(name: str) -> str:
    """A header cell as a column name."""
    return re.sub("[^0-9a-zA-Z_]+", "_", name)


def _by_split(lines: pa.RecordBatch, seen: list):
    """Cut a batch of (file, block, value) where the file split changes: (file, block, lines before in it, values). A
    task gets the lines of a split in order; seen carries the split and its lines over batches."""
    key = np.column_stack([lines.column(0).to_numpy(), lines.column(1).to_numpy()])
    cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
    for x, y in zip(cut, cut[1:]):
        if y > x:
            own = tuple(key[x].tolist())
            if seen[0] != own:
                seen[:] = [own, 0]
            yield *own, seen[1], lines.column(2).slice(x, y - x)
            seen[1] += y - x


def _splits(spark: SparkSession, path: str) -> DataFrame:
    meta = spark.read.text(path)
    return meta.select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _lines(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """The lines of all files, without the first `skip` lines of each; one scan, however many files there are."""
    if not skip:
        return spark.read.text(path)

    def run(it):
        seen = [None, 0]
        for b in it:
            for _, block, before, values in _by_split(b, seen):
                gone = max(0, skip - before) if block == 0 else 0
                yield pa.RecordBatch.from_arrays([values.slice(gone)], ["value"])

    return _splits(spark, path).mapInArrow(run, "value string")


def open_after(line: str, inside: bool, sep: str, quote: str) -> bool:
    """Whether a quoted cell is still open at the end of a line that starts inside one or not. A quote opens a cell
    only as its first character; two of them inside are one that is meant."""
    if quote not in line:
        return inside
    at = 0
    while True:
        if inside:
            at = line.find(quote, at)
            if at < 0:
                return True
            if line.startswith(quote, at + 1):
                at += 2
                continue
            inside, at = False, line.find(sep, at + 1)
        elif line.startswith(quote, at):
            inside, at = True, at + 1
            continue
        else:
            at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _records(spark: SparkSession, path: str, skip: int, sep: str, quote: str) -> DataFrame:
    """(cells): the records of all files, without the first `skip` lines of each, quoted cells over several lines whole.

    Files are read in splits. A first pass tells for each split how it ends if it starts inside a quoted cell and
    if it does not; from one such row per split follows where splits start. The second pass cuts lines into records;
    the pieces of records that cross a split border, two a split, are put together by file.
    """
    src = _splits(spark, path)

    def ends(it):
        seen, state, last = [None, 0], [False, True], None
        for b in it:
            for file, block, before, values in _by_split(b, seen):
                if before == 0:
                    if last is not None:
                        yield pa.RecordBatch.from_pylist([last])
                    state = [False, True]
                for line in values.slice(max(0, skip - before) if block == 0 else 0).to_pylist():
                    state = [open_after(line, x, sep, quote) for x in state] if quote in line else state
                last = {"file": file, "block": block, "out": state[0], "in": state[1]}
        if last is not None:
            yield pa.RecordBatch.from_pylist([last])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, inside, got = pdf.sort_values("block"), False, []
        for file, block, out, into in pdf[["file", "block", "out", "in"]].itertuples(index=False):
            if inside:
                got.append((file, block))
            inside = into if inside else out
        return pd.DataFrame(got, columns=["file", "block"]).astype("int64")

    per_split = src.mapInArrow(ends, "file long, block long, out boolean, in boolean")
    inside_at = {(r["file"], r["block"]) for r in per_split.groupBy("file").applyInPandas(starts, "file long, block long").collect()}  # a row per split at most

    def cut(it):
        seen, open_, head, inside, own = [None, 0], [], False, False, None

        def piece(kind):
            return pa.RecordBatch.from_pylist([{"file": own[0], "block": own[1], "kind": kind, "text": "\n".join(open_)}], schema)

        schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
        for b in it:
            for file, block, before, values in _by_split(b, seen):
                if before == 0:
                    if own is not None and (open_ or head):
                        yield piece(1 if head else 2)
                    own, inside, open_ = (file, block), (file, block) in inside_at, []
                    head = inside
                done = []
                for line in values.slice(max(0, skip - before) if block == 0 else 0).to_pylist():
                    if not inside and not line.strip():
                        continue
                    open_.append(line)
                    inside = open_after(line, inside, sep, quote)
                    if not inside:
                        if head:
                            yield piece(0)
                        else:
                            done.append("\n".join(open_))
                        head, open_ = False, []
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(done), pa.int64()), pa.array([block] * len(done), pa.int64()), pa.array([3] * len(done), pa.int32()), pa.array(done, pa.string())], schema=schema)
        if own is not None and (open_ or head):
            yield piece(1 if head else 2)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        # by split: 0 ends a record of an earlier split, 1 continues it, 2 starts one
        got, now = [], []
        for kind, text in pdf.sort_values(["block", "kind"])[["kind", "text"]].itertuples(index=False):
            if kind == 2 and now:
                got.append("\n".join(now))
                now = []
            now.append(text)
            if kind == 0:
                got.append("\n".join(now))
                now = []
        return pd.DataFrame({"text": got + (["\n".join(now)] if now else [])})

    def cells(it):
        for b in it:
            rows = [next(csv.reader([t], delimiter=sep, quotechar=quote), []) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["cells"])

    pieces = stored(src.mapInArrow(cut, "file long, block long, kind int, text string"), "records")
    whole = pieces.filter("kind = 3").select("text").union(pieces.filter("kind < 3").groupBy("file").applyInPandas(joined, "text string"))
    return whole.mapInArrow(cells, "cells array<string>")


def scan_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    columns: list[int] | None = None,
    names: list[str] | None = None,
    types: dict[str, str] | None = None,
    quote: str = "",
    skip_rows: int = 0,
    transform=None,
) -> DataFrame:
    """Scan delimited text.

    With `quote`, cells may hold separators, doubled quotes and line breaks (any of which is read as a newline).
    Names come from `names`, else the cleaned header, else Column_<i>. `columns` keeps these
    positions in this order. Without `quote`, quote characters are data. `transform` maps the
    raw DataFrame of strings before types are applied.
    """
    if quote:
        first = spark.read.text(path).take(skip_rows + 1)
        if not first:
            raise ValueError(f"{path} is empty")
        top = next(csv.reader([first[-1][0]], delimiter=sep, quotechar=quote), [])
        got = top if header else [f"Column_{i}" for i in range(len(top))]
        df = _records(spark, path, skip_rows + bool(header), sep, quote)
        cells: list[Column] = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")) for i in range(len(got))]
    else:
        first = spark.read.text(path).take(skip_rows + 1)
        if not first:
            raise ValueError(f"{path} is empty")
        top = first[-1][0].split(sep)
        got = top if header else [f"Column_{i}" for i in range(len(top))]
        df = _lines(spark, path, skip_rows + bool(header))
        parts = F.split("value", re.escape(sep), -1)
        cells = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(len(got))]
    keep = list(range(len(got))) if columns is None else columns
    labels = names or [clean_name(got[i]) for i in keep]
    if len(labels) != len(keep):
        raise ValueError(f"{len(keep)} columns but {len(labels)} names")
    out = df.select(*[cells[i].alias(n) for i, n in zip(keep, labels)])
    if transform:
        out = transform(out)
    for name, kind in (types or {}).items():
        out = out.withColumn(name, F.expr(f"try_cast({name} as {kind})"))
    return out


def strip_prefix(prefix: str):
    """A transform that removes every occurrence of prefix from every cell."""
    return lambda df: df.select(*[F.replace(F.col(c), F.lit(prefix), F.lit("")).alias(c) for c in df.columns])


def scan_scored_network(spark: SparkSession, path: str, prefix: str, least: int, sep: str = " ") -> DataFrame:
    """(Gene1, Gene2, Reliability): edges whose first id has the prefix and whose score is at least `least`;
    both predicates hold at the scan, before the prefix is stripped."""
    raw = scan_delimited(spark, path, sep, header=False, columns=[0, 1, 2], names=["Gene1", "Gene2", "Reliability"], types={"Reliability": "int"})
    kept = raw.filter(F.col("Gene1").startswith(prefix) & (F.col("Reliability") >= least))
    return kept.select(*[F.replace(F.col(c), F.lit(prefix), F.lit("")).alias(c) for c in ("Gene1", "Gene2")], "Reliability")


def scan_mitab(spark: SparkSession, path: str) -> DataFrame:
    """(Gene1, Gene2, confidence) from PSI-MITAB 2.5: accession ids of columns 1 and 2, null without one."""
    raw = scan_delimited(spark, path, "\t", header=False, columns=[0, 1, 14], names=["x", "y", "confidence"])
    ident = lambda c: F.nullif(F.regexp_extract(c, r"^uniprotkb:(\w+)", 1), F.lit(""))
    return raw.select(ident("x").alias("Gene1"), ident("y").alias("Gene2"), "confidence")


def scan_services(spark: SparkSession, glob: str, pattern: str = r"([A-Za-z0-9_-]+)\.\w+$") -> DataFrame:
    """All files of a glob as MITAB, with the lower-cased service name taken from the file name."""
    parts = F.split("value", "\t", -1)
    ident = lambda i: F.nullif(F.regexp_extract(F.get(parts, F.lit(i)), r"^uniprotkb:(\w+)", 1), F.lit(""))
    text = spark.read.text(glob).select("value", F.lower(F.regexp_extract(F.input_file_name(), pattern, 1)).alias("service"))
    return text.select("service", ident(0).alias("Gene1"), ident(1).alias("Gene2"), F.coalesce(F.get(parts, F.lit(14)), F.lit("")).alias("confidence"))


def scan_annotations(spark: SparkSession, path: str, skip_rows: int = 12) -> DataFrame:
    """(Gene, GOTerm) from columns 3 and 5 of a gene association file."""
    return scan_delimited(spark, path, "\t", header=False, columns=[2, 4], names=["Gene", "GOTerm"], skip_rows=skip_rows)


def scan_gene_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long").csv(path)


def scan_timings(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark tables: semicolon-separated, with a header, numbers typed."""
    return spark.read.option("sep", ";").option("header", True).option("inferSchema", True).csv(path)


def scan_id_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Identifier tables by kind: chip annotations, a mart export and a nomenclature table."""
    if kind == "gnf1h":
        return scan_delimited(spark, path, "\t", columns=[0, 1], names=["chip_annot", "hgnc"])
    if kind == "u133a":
        return scan_delimited(spark, path, "\t", columns=[0, 10, 11], names=["chip_annot", "hgnc", "entrez"], skip_rows=16)
    if kind == "biomart":
        raw = scan_delimited(spark, path, ",", names=["ensembl", "ensp", "hgnc", "uniprot", "hgnc_id", "entrez"])
        return raw.withColumn("uniprot", F.replace("uniprot", F.lit("_HUMAN"), F.lit("")))
    if kind == "hgnc":
        raw = scan_delimited(spark, path, "\t", names=["hgnc_id", "hgnc", "hgnc_name", "status", "entrez", "ensembl", "entrez_2", "uniprot", "ensembl_2"])
        pick = lambda a, b: F.when(F.col(b) == "", F.col(a)).otherwise(F.col(b)).alias(a)
        return raw.select("hgnc_id", "hgnc", "hgnc_name", "status", pick("entrez", "entrez_2"), pick("ensembl", "ensembl_2"), "uniprot")
    raise ValueError(f"unknown identifier table {kind}")
