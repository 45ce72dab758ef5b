"""Ontology stanza files (OBO 1.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_obo(spark: SparkSession, path: str, namespace: str | None = None, obsolete: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(terms, is_a, alt_ids) of the [Term] stanzas.

    terms: id, name, namespace, is_obsolete; is_a: child, parent, both among the kept terms;
    alt_ids: alt, id. Numbers follow the colon of an id. Records of one scan begin at an opening
    bracket and are taken where that opens a [Term] stanza; other stanza kinds are dropped. Lines may
    end in either way, with blank lines or without.
    """
    raw = spark.read.option("lineSep", "\n[").text(path).select(F.split(F.regexp_replace(F.concat(F.lit("["), "value"), r"\r", ""), "\n").alias("lines"))
    stanza = raw.withColumn("lines", F.transform("lines", lambda x: F.trim(x))).filter(F.element_at("lines", 1).isin("[Term]", "[[Term]"))
    values = lambda key: F.transform(F.filter("lines", lambda x: F.startswith(x, F.lit(key + ": "))), lambda x: F.substr(x, F.lit(len(key) + 3)))
    number = lambda c: F.expr(f"try_cast(split({c}, ':')[1] as bigint)")
    flat = stanza.select(F.get(values("id"), F.lit(0)).alias("key"), F.get(values("name"), F.lit(0)).alias("name"), F.get(values("namespace"), F.lit(0)).alias("namespace"), (F.get(values("is_obsolete"), F.lit(0)) == "true").alias("gone"), values("is_a").alias("up"), values("alt_id").alias("alts"))
    flat = flat.withColumn("id", number("key")).withColumn("is_obsolete", F.coalesce("gone", F.lit(False)))
    if namespace is not None:
        flat = flat.filter(F.col("namespace") == namespace)
    if not obsolete:
        flat = flat.filter(~F.col("is_obsolete"))
    terms = flat.select("id", "name", "namespace", "is_obsolete")
    up = flat.select(F.col("id").alias("child"), F.explode("up").alias("raw")).withColumn("token", F.split("raw", "[ !]")[0])
    is_a = up.select("child", number("token").alias("parent")).join(terms.select(F.col("id").alias("parent")), "parent", "left_semi").select("child", "parent").distinct()
    alts = flat.select(F.explode("alts").alias("alt_key"), "id").select(number("alt_key").alias("alt"), "id")
    return terms, is_a, alts
