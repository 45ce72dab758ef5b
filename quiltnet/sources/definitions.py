"""Known sources as data, and the stage order that brings any of them into the common form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as rel
from .delimited import scan_delimited, scan_mitab, strip_prefix


@dataclass(frozen=True)
class NetworkSource:
    """A file of interactions: where its two ids stand and of which type they are."""

    name: str
    id_type: str
    first: str = "Gene1"
    second: str = "Gene2"
    sep: str = "\t"
    header: bool = True
    prefix: str = ""
    mitab: bool = False


@dataclass(frozen=True)
class MeasurementSource:
    """A file of measurements: its id and, where it is a matrix, the columns that are no contexts."""

    name: str
    id_type: str
    id_column: str
    least: float
    sep: str = "\t"
    quote: str = ""
    skip_rows: int = 0
    fixed: tuple[str, ...] = ()  # empty: one row per measurement already
    skip_empty: bool = True
    policy: str = "all"  # of rel.reliable, for rows that tell their reliability


#: Separators, id columns, id types and cut-offs of the known sources.
NETWORKS = (
    NetworkSource("bossi", "ensembl"),
    NetworkSource("ccsb", "hgnc", "SYMBOL_A", "SYMBOL_B"),
    NetworkSource("havu", "uniprot"),
    NetworkSource("psicquic", "uniprot", header=False, mitab=True),
    NetworkSource("string", "ensp", sep=" ", header=False, prefix="9606."),
)
MEASUREMENTS = (
    MeasurementSource("emtab", "hgnc", "Gene_Name", 1.0, skip_rows=3, fixed=("Gene_ID", "Gene_Name")),
    MeasurementSource("gene_atlas", "chip_annot", "Gene_ID", 100.0, sep=",", fixed=("Gene_ID",)),
    MeasurementSource("hpa", "ensembl", "Gene", 1.0, sep=",", quote='"', policy="strict"),
    MeasurementSource("hpa_all", "ensembl", "Gene", 1.0, sep=",", quote='"'),
    MeasurementSource("rnaseq_atlas", "hgnc", "hgnc_symbol", 1.0, fixed=("entrez_gene_id", "ensembl_gene_id", "hgnc_symbol", "transcript", "transcript_length"), skip_empty=False),
)


def load_network(spark: SparkSession, source: NetworkSource, path: str, mapping: DataFrame | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """(a, b) of a source: scan, keep the two ids, map them where a mapping is given, undirected and distinct."""
    if source.mitab:
        raw = scan_mitab(spark, path)
    elif source.header:
        raw = scan_delimited(spark, path, source.sep)
    else:
        strip = strip_prefix(source.prefix) if source.prefix else None
        raw = scan_delimited(spark, path, source.sep, header=False, columns=[0, 1], names=[source.first, source.second], transform=strip)
    pairs = raw.select(F.col(source.first).alias("Gene1"), F.col(source.second).alias("Gene2"))
    if mapping is not None:
        pairs = rel.map_ids(pairs, ["Gene1", "Gene2"], mapping, key, value)
    return rel.canonical_edges(pairs, "Gene1", "Gene2")


def load_measurements(spark: SparkSession, source: MeasurementSource, path: str, mapping: DataFrame | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """(node, ctx, value, present): scan, matrix to rows, trusted rows, ids mapped, numbers, the largest value of
    a node and context, and whether it reaches the source's cut-off."""
    raw = scan_delimited(spark, path, source.sep, quote=source.quote, skip_rows=source.skip_rows)
    if source.fixed:
        contexts = [c for c in raw.columns if c not in source.fixed]
        rows = rel.unpivot_distinct(raw, list(source.fixed), contexts, "ctx", "text")
        rows = rows.filter("text <> ''") if source.skip_empty else rows
        rows = rows.select(F.col(source.id_column).alias("node"), "ctx", rel.real("text").alias("value"))
    else:
        kept = rel.reliable(raw, policy=source.policy)
        rows = kept.select(F.col(source.id_column).alias("node"), rel.composite("Tissue", "Cell_Type").alias("ctx"), rel.ordinal("Level").alias("value"))
    if mapping is not None:
        rows = rel.map_ids(rows, ["node"], mapping, key, value)
    best = rel.collapse_max(rows, ["node", "ctx"])
    return best.select("node", "ctx", "value", F.when(F.col("value") >= source.least, 1).otherwise(0).cast("long").alias("present"))
