"""From raw documents to token files: quality, near copies, benchmark passages, mix, coding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written to the
shared folder as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiltnet.llm import decontaminate, jaccard_join, mixing, quality_model, token_files
from quiltnet.llm.common import read, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    stats = stored(quality_model.with_statistics(docs), "quality-stats", few=True)
    return quality_model.keep_good(docs, quality_model.fit(stats, read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return jaccard_join.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), drop_share=0.0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the written token files: doc_id, start, n_tokens, ids_crc32."""
    return token_files.token_files(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: The classifier, the cube method and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of sf_dir."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-").replace("/", "-"))
    return docs
