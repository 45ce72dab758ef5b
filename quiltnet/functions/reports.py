"""Finished tables: summaries, comparisons and tests over metrics that other operators computed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.graph import packed_edges, shared
from ..plans.lineage import stored
from .stats import ecdf, fit_degrees, fit_power_tail, freq_below, log_gamma, quantiles, running, sampled_means, top_share, total_of, welch_moments, welch_p
from .tails import normal_upper

# ---------------------------------------------------------------- ordered lists


def split_sorted(df: DataFrame, by: str, share: float, tie: str) -> DataFrame:
    """`low`: whether a row is among the first floor(share n) by value. Distinct values are counted first, so
    only rows of the one value at the cut are ranked."""
    c = df.groupBy(by).agg(F.count(F.lit(1)).alias("_c"))
    w = total_of(running(c, by, "_c", "_upto"), "_c", "_all").withColumn("_k", F.floor(F.col("_all") * share)).drop("_all")
    j = df.join(w, by)
    r = F.row_number().over(Window.partitionBy(by).orderBy(tie)) + F.col("_upto") - F.col("_c")
    return j.withColumn("low", r <= F.col("_k")).select(*df.columns, "low")


def head(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The first k rows; a bounded top-k, never a full sort."""
    return df.orderBy(F.desc(by), *ties).limit(k)


# ---------------------------------------------------------------- summaries


def clusterer_summary(clusters: DataFrame, *keys: str) -> DataFrame:
    """clusters (keys..., size, modularity) -> summed modularity, count, and sizes."""
    return clusters.groupBy(*keys).agg(F.sum("modularity").alias("modularity"), F.count(F.lit(1)).alias("clusters"), F.min("size").alias("smallest"), F.avg("size").alias("mean_size"), F.max("size").alias("largest"))


def distinct_by(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n"))


def wide_properties(long: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(keys..., Property, Value) rows as one column per property, averaged."""
    return long.groupBy(*keys).pivot("Property", names).agg(F.avg("Value"))


def ratio_table(part: DataFrame, whole: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean value of the parts over the whole's value, per key."""
    a = part.groupBy(*keys).agg(F.avg(value).alias("_part"))
    return a.join(whole.select(*keys, F.col(value).alias("_whole")), keys).select(*keys, F.try_divide("_part", "_whole").alias("ratio"))


def histogram_band(samples: DataFrame, bin_: str = "bin", n: str = "n") -> DataFrame:
    """samples (sample, bin, n) -> per bin the mean count and mean -/+ 1.96 sd over samples."""
    s = samples.groupBy(bin_).agg(F.avg(n).alias("mean"), F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("sd"))
    return s.select(bin_, "mean", (F.col("mean") - 1.96 * F.col("sd")).alias("low"), (F.col("mean") + 1.96 * F.col("sd")).alias("high"))


def speedups(timings: DataFrame, base: str, *others: str) -> DataFrame:
    """Summed seconds of each column and how many times faster than the base each other one is."""
    s = timings.agg(*[F.sum(c).alias(c) for c in (base, *others)])
    return s.select("*", *[F.try_divide(base, c).alias(f"{c}_speedup") for c in others])


def reverse_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """value -> key; an error where two keys share a value."""
    g = df.groupBy(value).agg(F.min(key).alias(key), F.count_distinct(key).alias("_n"))
    return g.select(F.when(F.col("_n") == 1, F.col(value)).otherwise(F.raise_error(F.lit("the mapping is not one-to-one"))).alias(value), key)


def named(df: DataFrame, ids: DataFrame, column: str, key: str = "id", name: str = "name") -> DataFrame:
    """df with the names of its ids beside them."""
    return df.join(ids.select(F.col(key).alias(column), F.col(name).alias(f"{column}_name")), column)


def curve_to_quantile(df: DataFrame, value: str, prob: float = 0.9) -> DataFrame:
    """(value, freq): the cumulative curve as far as a quantile."""
    top = quantiles(df, value, [prob])
    return ecdf(df, value).filter(F.col(value) <= top[0] if top else F.lit(False))


def marked_curve(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """(value, freq, below, beyond, low, high): the cumulative curve with the percentage of rows below a threshold and
    of the others, and the ends of its axis, beside every row."""
    curve = stored(ecdf(df, value), "curve")
    ends = curve.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    mark = freq_below(curve, value, threshold).select((100 * F.col("freq")).alias("below"), (100 - 100 * F.col("freq")).alias("beyond"))
    return curve.crossJoin(mark).crossJoin(ends)  # one row each


# ---------------------------------------------------------------- edges and contexts


def edge_presence(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, both, measured, share): contexts with both ends present, of those with both measured."""
    both, words = packed_edges(edges, members)
    per = both.select("a", "b", shared(words, "p").alias("both"), shared(words, "m").alias("measured")).filter("measured > 0")
    return per.withColumn("share", F.col("both") / F.col("measured"))


def degree_mismatch(first: DataFrame, second: DataFrame) -> DataFrame:
    """Nodes for which two degree tables disagree; empty if both are right."""
    j = first.select("node", F.col("degree").alias("x")).join(second.select("node", F.col("degree").alias("y")), "node", "full")
    return j.filter(~F.col("x").eqNullSafe(F.col("y")))


# ---------------------------------------------------------------- distributions and tests


def fitted_distribution(deg: DataFrame) -> DataFrame:
    """(degree, binomial, poisson, exponential, powerlaw, powerlaw_tail): densities of the fits on 1 .. the
    largest degree; that of the tail is scaled to the share of degrees it was fitted to."""
    f, t = fit_degrees(deg), fit_power_tail(deg)
    d = deg.agg(F.max("degree").alias("top"), F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("degree") >= t["power_xmin"], 1)).alias("tail"))
    d = d.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"))).alias("degree"), (F.col("tail") / F.col("all")).alias("share"))
    x, n, p, lam, rate = F.col("degree").cast("double"), f["n"] - 1, f["binom_p"], f["poisson_rate"], f["exp_rate"]
    ln_choose = log_gamma(F.lit(n + 1)) - log_gamma(x + 1) - log_gamma(F.greatest(F.lit(n) - x, F.lit(0.0)) + 1)
    binom = F.when(x <= n, F.exp(ln_choose + x * math.log(p) + (F.lit(n) - x) * math.log1p(-p))).otherwise(0.0) if 0 < p < 1 else F.lit(0.0)

    def power(alpha: float, lo: float):
        return F.when(x >= lo, (alpha - 1) / lo * F.pow(x / lo, F.lit(-alpha))).otherwise(0.0) if math.isfinite(alpha) else F.lit(0.0)

    return d.select(
        "degree", binom.alias("binomial"), F.exp(x * math.log(lam) - lam - log_gamma(x + 1)).alias("poisson"), (rate * F.exp(-rate * x)).alias("exponential"),
        power(f["power_alpha"], f["power_xmin"]).alias("powerlaw"), (power(t["power_alpha"], t["power_xmin"]) * F.col("share")).alias("powerlaw_tail"),
    )


def class_tests(spark, values: DataFrame, value: str, cls: DataFrame, samples: int = 1000, seed: int = 1) -> DataFrame:
    """(ctx, class, k, mean, mu, sd, z, p) of every class of nodes in every context, against seeded random sets
    of the same size. values: (ctx, node, value); cls: (node, class). One job for all contexts and classes."""
    size = values.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"))
    own = values.join(cls, "node").groupBy("ctx", "class").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("k")).join(size, "ctx")
    k = F.col("k").cast("double")
    room = 10 * F.sqrt(k) + 20
    own = own.withColumns({"cut": F.least(F.lit(1.0), (k + room) / F.col("n")) * (1 << 52), "low": F.greatest(F.lit(0.0), (k - room) / F.col("n")) * (1 << 52)})
    own = stored(own, "class-sizes")
    runs = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    h = F.pmod(F.xxhash64(F.lit(seed), "class", "sample", "node"), F.lit(1 << 52))
    drawn = values.join(F.broadcast(own.select("ctx", "class", "k", "cut", "low")), "ctx").withColumn("sample", runs).withColumn("_h", h).filter(F.col("_h") <= F.col("cut"))  # a row per context and class
    means = sampled_means(drawn, ["ctx", "class", "sample"], F.col("k"), F.col("low"), value).withColumnRenamed("mean", "m")
    out = own.join(means.groupBy("ctx", "class").agg(F.avg("m").alias("mu"), F.stddev_samp("m").alias("sd")), ["ctx", "class"])
    rows = []
    for r in out.collect():  # a row per context and class
        z = (r["mean"] - r["mu"]) / r["sd"] if r["sd"] else math.nan
        rows.append((r["ctx"], r["class"], r["k"], r["mean"], r["mu"], r["sd"], z, 2 * normal_upper(abs(z)) if z == z else math.nan))
    return spark.createDataFrame(rows, "ctx long, class string, k long, mean double, mu double, sd double, z double, p double")


def two_class_p(samples: DataFrame, observed: float) -> tuple[float, float, float]:
    """(mu, sd, p): one-sided normal tail of an observed value against sampled means."""
    r = samples.agg(F.avg("mean").alias("mu"), F.stddev_samp("mean").alias("sd")).first()
    return r["mu"], r["sd"], normal_upper(abs(observed - r["mu"]) / r["sd"]) if r["sd"] else math.nan


def compare_tops(clusters: DataFrame, group: str, first, second, share: float = 0.2, least_size: int = 4) -> dict[str, float]:
    """Welch's test between the scores of the best clusters by modularity of two kinds, small ones left out."""
    big = clusters.filter(F.col("size") >= least_size)
    top = top_share(big, [group], "modularity", share, "cluster")
    r = welch_moments(top, "score", group, first, second).first().asDict()
    return r | {"p": welch_p(r["t"], r["df"]) if r["t"] is not None and r["df"] else math.nan}


def compare_types(clusters: DataFrame, base: str, share: float = 0.2, least_size: int = 4, level: float = 0.05) -> DataFrame:
    """clusters (type, cluster, size, score, modularity) -> (comparison, type, first, second, greater, p): the best
    clusters of a type by modularity against its others (`others`) and against the best of type `base` (`base`);
    `share greater` and `share smaller` count the other types whose difference to base is significant."""
    big = clusters.filter(F.col("size") >= least_size)
    w = Window.partitionBy("type")
    ranked = big.withColumn("k", F.ceil(F.count(F.lit(1)).over(w) * share)).withColumn("top", F.row_number().over(w.orderBy(F.desc("modularity"), "cluster")) <= F.col("k"))
    moments = ranked.groupBy("type", "top").agg(F.avg("score").alias("m"), F.var_samp("score").alias("v"), F.count(F.lit(1)).alias("n"))
    got = {(r["type"], r["top"]): (r["m"], r["v"], r["n"]) for r in moments.collect()}  # two rows per type
    types = sorted({t for t, _ in got})

    def line(name: str, t: str, x, y):
        if not x or not y or x[2] < 2 or y[2] < 2 or not x[1] / x[2] + y[1] / y[2]:
            return name, t, x[0] if x else None, y[0] if y else None, False, None
        a, b = x[1] / x[2], y[1] / y[2]
        df = (a + b) ** 2 / (a * a / (x[2] - 1) + b * b / (y[2] - 1))
        return name, t, x[0], y[0], x[0] > y[0], welch_p((x[0] - y[0]) / math.sqrt(a + b), df)

    rows = [line("others", t, got.get((t, True)), got.get((t, False))) for t in types]
    against = [line("base", t, got.get((t, True)), got.get((base, True))) for t in types if t != base]
    sure = [g for *_, g, p in against if p is not None and p < level]
    n = max(1, len(against))
    rows += against + [("share greater", base, sum(sure) / n, None, False, None), ("share smaller", base, (len(sure) - sum(sure)) / n, None, False, None)]
    return clusters.sparkSession.createDataFrame(rows, "comparison string, type string, first double, second double, greater boolean, p double")
