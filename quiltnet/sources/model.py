"""The supplied tables seen as networks, contexts, mappings and a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Model:
    """Lazy projections of one set of tables. Nodes are part keys; contexts are small integers."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def baskets(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()

    def pairs(self) -> DataFrame:
        """(o, a, b): parts a < b of one order."""
        x = self.baskets()
        y = x.select("o", F.col("p").alias("b"))
        return x.select("o", F.col("p").alias("a")).join(y, "o").filter("a < b")

    def networks(self) -> DataFrame:
        """(net, a, b): one network per order priority."""
        orders = self.table("orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("net"))
        return self.pairs().join(orders, "o").select("net", "a", "b").distinct()

    def edges(self) -> DataFrame:
        """(a, b), a < b: the union network."""
        return self.pairs().select("a", "b").distinct()

    def month_values(self) -> DataFrame:
        """(node, ctx, value): largest quantity of a part in a month of the year."""
        rows = self.table("lineitem").select(F.col("l_partkey").alias("node"), F.month("l_shipdate").cast("long").alias("ctx"), F.col("l_quantity").alias("value"))
        return rows.groupBy("node", "ctx").agg(F.max("value").alias("value"))

    def month_members(self) -> DataFrame:
        """(node, ctx, present)."""
        return self.month_values().select("node", "ctx", F.when(F.col("value") >= 40, 1).otherwise(0).cast("long").alias("present"))

    def parts(self) -> DataFrame:
        return self.table("part")


#: The same projections as DuckDB text, to put before a query: WITH <CTES> ...
CTES = """
lp AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
pairs AS (SELECT x.o, x.p AS a, y.p AS b FROM lp x JOIN lp y ON x.o = y.o AND x.p < y.p),
networks AS (SELECT DISTINCT o_orderpriority AS net, a, b FROM pairs JOIN orders ON o = o_orderkey),
edges AS (SELECT DISTINCT a, b FROM pairs),
mv AS (SELECT l_partkey AS node, CAST(month(l_shipdate) AS BIGINT) AS ctx, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
mem AS (SELECT node, ctx, CAST(CASE WHEN value >= 40 THEN 1 ELSE 0 END AS BIGINT) AS present FROM mv)"""
