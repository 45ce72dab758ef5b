"""Named queries over the supplied tables with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.model import CTES, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DIGITS = 9


def settled(df: DataFrame) -> DataFrame:
    """Result types that do not depend on the plan: integers as long, numbers as rounded double."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, ctes: bool = True, recursive: bool = False):
    """Register f(model) under a name; sql may use the model's CTEs (and add to them after a comma)."""

    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: settled(f(Model(spark, sf_dir)))
        if sql:
            body = sql.strip()
            if ctes:
                body = ("WITH RECURSIVE" if recursive else "WITH") + CTES + ("" if body.startswith(",") else "\n") + body
            ORACLE[name] = body
        return f

    return wrap


def r(x: str, name: str) -> str:
    """SQL of a rounded double."""
    return f"round(CAST({x} AS DOUBLE), {DIGITS}) + 0.0 AS {name}"


def n(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"
