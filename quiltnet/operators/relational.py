"""Normalising identifiers, networks and measurement matrices; dense cores; labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import running
from ..plans.lineage import stored

# ---------------------------------------------------------------- filters and projections


def non_empty(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither null nor empty."""
    for c in columns:
        df = df.filter(F.col(c) != "")
    return df


def reliable(df: DataFrame, kind: str = "Expression_type", level: str = "Reliability", policy: str = "strict") -> DataFrame:
    """Measurements to trust: array-based ones of at least medium, stained ones of supportive reliability.
    The policy `all` keeps every row."""
    if policy == "all":
        return df
    return df.filter(((F.col(kind) == "APE") & F.col(level).isin("Medium", "High")) | ((F.col(kind) == "Staining") & (F.col(level) == "Supportive")))


#: Ordinal words as numbers.
ORDINALS = {"Negative": 0.0, "None": 0.0, "Weak": 1.0, "Low": 1.0, "Moderate": 2.0, "Medium": 2.0, "Strong": 3.0, "High": 3.0}


def ordinal(column: str | Column, words: dict[str, float] = ORDINALS) -> Column:
    """The number of an ordinal word; null for any other text."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(None).cast("double")
    for word, x in words.items():
        out = F.when(c == word, F.lit(x)).otherwise(out)
    return out


def real(column: str | Column) -> Column:
    """Text as a number, with junk and empty text as 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def classify(df: DataFrame, least: float, value: str = "value", name: str = "present") -> DataFrame:
    """A 0/1 column: 1 where value >= least; null counts as 0."""
    return df.withColumn(name, F.when(F.col(value) >= least, 1).otherwise(0).cast("long")).drop(value)


def composite(*columns: str, sep: str = " - ") -> Column:
    """Joined text; null if any part is."""
    parts = [F.col(c) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep), p)
    return out


def canonical_edges(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) with a <= b, distinct; edges with a null end are dropped, self-loops stay."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def one_hot(df: DataFrame, names: list[str], own: str) -> DataFrame:
    return df.select("*", *[F.lit(1 if n == own else 0).alias(n) for n in names])


def both_or_null(f, x: str | Column, y: str | Column) -> Column:
    """least/greatest that are null if either side is."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.when(x.isNotNull() & y.isNotNull(), f(x, y))


def spread_class(counts: DataFrame, threshold: float, total: str = "total", present: str = "present") -> DataFrame:
    """`class`: TS where at most a share `threshold` of contexts has the node, HK where at least
    1 - threshold has it, else None; TS wins."""
    r = F.try_divide(F.col(present), F.col(total))
    return counts.withColumn("class", F.when(r <= threshold, "TS").when(r >= 1 - threshold, "HK").otherwise("None"))


def flags(nodes: DataFrame, **sets: DataFrame) -> DataFrame:
    """A 0/1 column for each named set of nodes."""
    for name, s in sets.items():
        nodes = nodes.join(s.select("node", F.lit(1).alias(name)).distinct(), "node", "left").na.fill(0, [name])
    return nodes


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both that agree in all columns of the same name."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return left.join(right, shared)


# ---------------------------------------------------------------- identifier mapping


def mapping_table(sources: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value), one row per key: a key takes its value from the first source that has it, the
    smallest where that source has several; empty ids count as absent."""
    ranked = None
    for k, s in enumerate(sources):
        one = non_empty(s.select(F.col(key).cast("string").alias(key), F.col(value).cast("string").alias(value)), key, value).withColumn("source", F.lit(k))
        ranked = one if ranked is None else ranked.unionByName(one)
    best = ranked.groupBy(key).agg(F.min(F.struct("source", value)).alias("best"))
    return best.select(key, F.col(f"best.{value}").alias(value))


def map_ids(df: DataFrame, columns: list[str], mapping: DataFrame, key: str, value: str) -> DataFrame:
    """df with each column replaced through the mapping; rows with an unmapped id are dropped."""
    for c in columns:
        m = mapping.select(F.col(key).alias("_from"), F.col(value).alias("_to"))
        df = df.withColumn(c, F.col(c).cast("string")).join(m, F.col(c) == F.col("_from")).withColumn(c, F.col("_to")).drop("_from", "_to")
    return df


def same_ids(df: DataFrame, columns: list[str], universe: DataFrame, key: str) -> DataFrame:
    """Rows all of whose id columns are known."""
    for c in columns:
        df = df.join(universe.select(F.col(key).alias(c)).distinct(), c, "left_semi")
    return df


def unmatched(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not known; null ids are neither known nor unknown."""
    return df.filter(F.col(column).isNotNull()).join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti").select(*df.columns)


def any_unmatched(df: DataFrame, columns: list[str], known: DataFrame, key: str) -> DataFrame:
    """Rows with at least one id that is not known."""
    out = df
    for i, c in enumerate(columns):
        k = known.select(F.col(key).alias(f"_k{i}")).distinct()
        out = out.join(k, F.col(c) == F.col(f"_k{i}"), "left")
    miss = [F.col(c).isNotNull() & F.col(f"_k{i}").isNull() for i, c in enumerate(columns)]
    cond = miss[0]
    for m in miss[1:]:
        cond = cond | m
    return out.filter(cond).select(*df.columns)


def all_ids(sources: list[DataFrame], column: str) -> DataFrame:
    out = sources[0].select(column)
    for s in sources[1:]:
        out = out.union(s.select(column))
    return out.distinct()


def mapping_stats(df: DataFrame, column: str, mapping: DataFrame, key: str) -> DataFrame:
    """One row: rows and ids that map, that do not, and that have no id."""
    m = mapping.select(F.col(key).alias("_k")).distinct()
    j = df.select(F.col(column).cast("string").alias("id")).join(m, F.col("id") == F.col("_k"), "left")
    hit, miss = F.col("_k").isNotNull(), F.col("_k").isNull() & F.col("id").isNotNull()
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(hit).alias("rows_matched"), n(miss).alias("rows_unmatched"), n(F.col("id").isNull()).alias("rows_null"), F.count_distinct(F.when(hit, F.col("id"))).alias("ids_matched"), F.count_distinct(F.when(miss, F.col("id"))).alias("ids_unmatched"))


def id_table(df: DataFrame, key: str, first: int = 1) -> DataFrame:
    """(id, key): keys numbered in order. A range partition is numbered from the sizes of those before
    it, so no task sees all keys."""
    ordered = df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    # stored, so that the sizes and the numbers are of the same ranges
    at = stored(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = at.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return at.join(before, "_p").select((F.col("_before") + F.col("_i") + first).alias("id"), key)


# ---------------------------------------------------------------- reshaping


def unpivot_distinct(df: DataFrame, ids: list[str], values: list[str] | None = None, name: str = "ctx", value: str = "value") -> DataFrame:
    """Wide to long; equal rows collapse."""
    return df.unpivot(ids, values or [c for c in df.columns if c not in ids], name, value).distinct()


def collapse_max(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def union_counts(networks: list[DataFrame]) -> DataFrame:
    """(a, b, n): in how many networks an edge is."""
    out = networks[0].select("a", "b")
    for n in networks[1:]:
        out = out.unionByName(n.select("a", "b"))
    return out.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- counts, coverage and cores


def presence_counts(members: DataFrame) -> DataFrame:
    """(node, total, present)."""
    return members.groupBy("node").agg(F.count("ctx").alias("total"), F.sum("present").alias("present"))


def context_coverage(members: DataFrame) -> DataFrame:
    """(ctx, coverage): nodes measured in a context."""
    return members.groupBy("ctx").agg(F.count_distinct("node").alias("coverage"))


def coverage_curve(members: DataFrame) -> DataFrame:
    """(coverage, n_ctx, n_nodes, product): for each coverage value, the contexts that reach it and the
    nodes measured in all of those.

    A node counts at a coverage if its contexts at or above it are as many as there are at all. Its contexts are
    counted by coverage and added from the top, so a membership is one row, however many coverages lie below it.
    """
    cov = stored(context_coverage(members), "coverage")
    per = cov.groupBy("coverage").agg(F.count(F.lit(1)).alias("k"))
    down = running(per.withColumn("_down", -F.col("coverage")), "_down", "k", "n_ctx").select("coverage", "n_ctx")
    own = members.select("node", "ctx").distinct().join(cov, "ctx").groupBy("node", "coverage").agg(F.count(F.lit(1)).alias("k"))
    upto = own.withColumn("k", F.sum("k").over(Window.partitionBy("node").orderBy(F.desc("coverage"))))
    n_nodes = upto.join(down, "coverage").filter("k = n_ctx").groupBy("coverage").agg(F.count(F.lit(1)).alias("n_nodes"))
    out = down.join(n_nodes, "coverage", "left").na.fill(0, ["n_nodes"])
    return out.select("coverage", "n_ctx", "n_nodes", (F.col("n_ctx") * F.col("n_nodes")).alias("product"))


def greedy_optimum(curve: DataFrame) -> DataFrame:
    """The row of the largest product, with the smallest coverage among equals."""
    return curve.orderBy(F.desc("product"), "coverage").limit(1)


def core(members: DataFrame, coverage: DataFrame | int) -> DataFrame:
    """Members of the contexts that reach a coverage, of the nodes measured in all of them."""
    cov = context_coverage(members)
    if isinstance(coverage, int):
        kept = cov.filter(F.col("coverage") >= coverage)
    else:
        kept = cov.crossJoin(coverage.select(F.col("coverage").alias("least"))).filter("coverage >= least")
    kept = kept.select("ctx")
    inside = members.join(kept, "ctx", "left_semi")
    n = kept.agg(F.count(F.lit(1)).alias("n"))
    whole = inside.groupBy("node").agg(F.count(F.lit(1)).alias("k")).crossJoin(n).filter("k >= n").select("node")
    return inside.join(whole, "node", "left_semi").select("node", "ctx", "present")


def covered_contexts(members: DataFrame, least: int | None = None) -> DataFrame:
    cov = context_coverage(members)
    return (cov if least is None else cov.filter(F.col("coverage") >= least)).select("ctx")


def labels(nodes: DataFrame, members: DataFrame, complete_only: bool = False) -> DataFrame:
    """(node, label): presence in all contexts in order, joined by |, with - for not measured."""
    ctx = members.select("ctx").distinct()
    grid = nodes.select("node").distinct().crossJoin(ctx).join(members, ["node", "ctx"], "left")
    rows = F.sort_array(F.collect_list(F.struct("ctx", F.coalesce(F.col("present").cast("string"), F.lit("-")).alias("v"))))
    out = grid.groupBy("node").agg(F.array_join(F.transform(rows, lambda x: x["v"]), "|").alias("label"))
    return out.filter(~F.contains("label", F.lit("-"))) if complete_only else out


def node_universe(core_members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, node): nodes both in the core and in the network, numbered from 0."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return id_table(core_members.select("node").intersect(ends), "node", 0)


def complete_membership(nodes: DataFrame, contexts: DataFrame, members: DataFrame) -> DataFrame:
    """Every node and context with present 0 by default; of several rows any presence counts."""
    grid = nodes.select("node").distinct().crossJoin(contexts.select("ctx").distinct())
    own = members.groupBy("node", "ctx").agg(F.max("present").alias("present"))
    return grid.join(own, ["node", "ctx"], "left").select("node", "ctx", F.coalesce("present", F.lit(0)).cast("long").alias("present"))


def incomplete(members: DataFrame) -> DataFrame:
    """Nodes not measured in all contexts: (node, n)."""
    all_ctx = members.agg(F.count_distinct("ctx").alias("t"))
    return members.groupBy("node").agg(F.count_distinct("ctx").alias("n")).crossJoin(all_ctx).filter("n <> t").select("node", "n")
