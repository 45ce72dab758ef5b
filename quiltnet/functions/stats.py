"""Statistics as aggregates, windows and joins; only tail probabilities of finished sums leave Spark."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import stored
from .tails import PowerTails, binom_cdf, chi2_upper, exp_cdf, hyper_upper, poisson_cdf, powerlaw_cdf, t_two_sided

# ---------------------------------------------------------------- correlation and tests


def running(counts: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """counts with `name`: the sum of n over all rows whose key is not larger. Keys are ranged over tasks; each
    range adds the sums of those before it, so no task sees all keys, however many there are."""
    parts = stored(counts.repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_p").agg(F.sum(n).alias("_s"))  # a row per range
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(n).over(Window.partitionBy("_p").orderBy(key))
    return parts.join(before, "_p").withColumn(name, F.col("_before") + own).drop("_p", "_before")


def total_of(counts: DataFrame, n: str, name: str) -> DataFrame:
    """counts with the sum of all n beside every row."""
    return counts.crossJoin(counts.agg(F.sum(n).alias(name)))  # one row


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, name): the mean rank of each distinct value."""
    c = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    return running(c, value, "_c", "_upto").select(value, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias(name))


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(correlation(x, y).alias("r"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (rho, n), with average ranks for ties."""
    d = df.select(x, y).dropna()
    return d.join(average_ranks(d, x, "_rx"), x).join(average_ranks(d, y, "_ry"), y).agg(correlation("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def correlation_p(r: float | None, n: int) -> float:
    """Two-sided p of a correlation by the t approximation; nan without one or with fewer than three rows."""
    return math.nan if r is None or n < 3 else 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def welch_moments(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """One row: t, df and both means, unequal variances."""
    m = df.filter(F.col(group).isin(first, second)).groupBy().pivot(group, [first, second]).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n"))
    m = m.toDF("m1", "v1", "n1", "m2", "v2", "n2")
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b))
    d = F.try_divide(F.pow(a + b, F.lit(2)), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    return m.select(t.alias("t"), d.alias("df"), "m1", "m2", "n1", "n2")


def welch_p(t: float, df: float) -> float:
    return t_two_sided(t, df)


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"))


# ---------------------------------------------------------------- windows over values


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """(value, freq): share of rows at or below each distinct value."""
    c = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    return total_of(running(c, value, "_c", "_upto"), "_c", "_all").select(value, (F.col("_upto") / F.col("_all")).alias("freq"))


def freq_below(curve: DataFrame, value: str, x: float) -> DataFrame:
    """One row: the share of rows below x."""
    return curve.filter(F.col(value) < x).agg(F.coalesce(F.max("freq"), F.lit(0.0)).alias("freq"))


def look_up(probes: DataFrame, probe: str, table: DataFrame, key: str, below: dict[str, str], upward: dict[str, str]) -> DataFrame:
    """probes with columns of a table looked up: `below` {column: name} from the last row whose key is less than the probe,
    `upward` from the first whose key is at least the probe; null where there is none, and for a null probe.

    Keys of the table are taken to be distinct. Probes and keys are ranged over tasks together and merged in order; a
    range passes what its neighbours need over its borders, one row per range, so no probe meets all keys.
    """
    asked = probes.select(F.col(probe).alias("_x")).dropna().distinct().withColumn("_side", F.lit(0))
    taken = sorted({*below, *upward})
    told = table.filter(F.col(key).isNotNull()).select(F.col(key).alias("_x"), F.lit(1).alias("_side"), F.struct(*taken).alias("_row"))
    both = asked.unionByName(told, allowMissingColumns=True).repartitionByRange("_x").withColumn("_p", F.spark_partition_id())
    both = stored(both, "ranges")
    order = Window.partitionBy("_p").orderBy("_x", "_side")  # at equal values the probe comes before the key
    edge = both.groupBy("_p").agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_x"))).alias("_last"), F.min_by("_row", F.when(F.col("_row").isNotNull(), F.col("_x"))).alias("_first"))
    ranges = Window.orderBy("_p")  # a row per range
    edge = edge.select(
        "_p",
        F.last("_last", True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_first", True).over(Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    merged = both.withColumn("_lo", F.last("_row", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy("_p").orderBy(F.desc("_x"), F.desc("_side"))  # from above, as frames that end at a row grow row by row
    merged = merged.withColumn("_hi", F.last("_row", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    found = merged.filter("_side = 0").join(edge, "_p")
    lo, hi = F.coalesce("_lo", "_before"), F.coalesce("_hi", "_after")
    found = found.select("_x", *[lo[c].alias(name) for c, name in below.items()], *[hi[c].alias(name) for c, name in upward.items()])
    return probes.join(found, F.col(probe) == F.col("_x"), "left").drop("_x")


def first_at_least(df: DataFrame, value: str, x: float) -> DataFrame:
    """One row: the smallest value that is at least x."""
    return df.filter(F.col(value) >= x).agg(F.min(value).alias("value"))


def rank_by_ratio(counts: DataFrame, present: str = "present", total: str = "total") -> DataFrame:
    """Rows with ratio and its rank; equal ratios by node. Ranks within a ratio are windows of that ratio."""
    r = counts.withColumn("ratio", F.try_divide(F.col(present).cast("double"), F.col(total)))
    c = r.groupBy("ratio").agg(F.count(F.lit(1)).alias("_c"))
    before = running(c, "ratio", "_c", "_upto").select("ratio", (F.col("_upto") - F.col("_c")).alias("_before"))
    return r.join(before, "ratio").withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy("ratio").orderBy("node"))).drop("_before")


def top_share(df: DataFrame, group: list[str], by: str, share: float, tie: str) -> DataFrame:
    """The best rows of each group: as many as share of the group, rounded up."""
    w = Window.partitionBy(*group)
    return df.withColumn("_k", F.ceil(F.count(F.lit(1)).over(w) * share)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(by), tie))).filter("_r <= _k").drop("_k", "_r")


def top_k(df: DataFrame, group: list[str], by: str, k: int, tie: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(by), tie))).filter(F.col("_r") <= k).drop("_r")


def threshold_curve(counts: DataFrame, present: str = "present", total: str = "total") -> DataFrame:
    """(ratio, ts, hk): for each distinct ratio, the share of nodes at or below it and at or above it."""
    c = counts.withColumn("ratio", F.try_divide(F.col(present).cast("double"), F.col(total))).groupBy("ratio").agg(F.count(F.lit(1)).alias("c"))
    r = total_of(running(c, "ratio", "c", "upto"), "c", "n")
    return r.select("ratio", (F.col("upto") / F.col("n")).alias("ts"), ((F.col("n") - F.col("upto") + F.col("c")) / F.col("n")).alias("hk"))


def cumulative_share(df: DataFrame, key: str, n: str) -> DataFrame:
    """df (key, n), one row per key, with the share of n at or below each key."""
    return total_of(running(df.select(key, n), key, n, "_upto"), n, "_all").select(key, n, (F.col("_upto") / F.col("_all")).alias("share"))


def round_to(x: str | Column, step: float) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x / step) * step


def binned_mean(df: DataFrame, x: str, y: str, step: float) -> DataFrame:
    """(bin, n, mean, se)."""
    out = df.groupBy(round_to(x, step).alias("bin")).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"))
    return out.select("bin", "n", "mean", F.try_divide("sd", F.sqrt("n")).alias("se"))


def fixed_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): right-closed bins from 1, the lowest edge included; values outside are dropped."""
    width = (high - low) / bins
    x = F.col(value)
    k = F.when(x == low, 1).otherwise(F.ceil((x - low) / width)).cast("long")
    return df.filter((x >= low) & (x <= high)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, value: str, probs: list[float]) -> list[float]:
    """Exact quantiles, interpolated linearly between neighbours; empty without values.

    Distinct values are counted, and counts summed over ranges (`running`), so a rank is found by the sums on either
    side of a value: no buffer holds all values, and two rows per probability reach the driver.
    """
    c = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()).groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = stored(running(c, "_v", "_c", "_upto"), "quantiles")
    n = upto.agg(F.max("_upto")).first()[0]
    if not n:
        return []
    places = [p * (n - 1) for p in probs]
    ranks = sorted({k for x in places for k in (math.floor(x), math.ceil(x))})
    asked = df.sparkSession.createDataFrame([(k,) for k in ranks], "_k long")
    got = upto.join(F.broadcast(asked), (F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))
    at = {r["_k"]: r["_v"] for r in got.select("_k", "_v").collect()}
    return [at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in places]


def quantile_breaks(df: DataFrame, value: str, step: float = 0.1) -> list[float]:
    """Distinct quantiles, interpolated linearly."""
    return sorted(set(quantiles(df, value, [i * step for i in range(round(1 / step))] + [1.0])))


def quantile_bins(df: DataFrame, value: str, step: float = 0.1) -> DataFrame:
    """(bin, low, high, n) over the distinct quantiles; bins are right-closed, the lowest edge included."""
    b = quantile_breaks(df, value, step)
    spark = df.sparkSession
    edges = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(b, b[1:]), 1)], "bin long, low double, high double")
    x = F.col(value)
    got = df.select(x).join(F.broadcast(edges), ((x > F.col("low")) | ((F.col("bin") == 1) & (x == F.col("low")))) & (x <= F.col("high"))).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # ten bins
    return edges.join(got, "bin", "left").na.fill(0, ["n"])


# ---------------------------------------------------------------- presence classes and their neighbours


def neighbour_class_share(nodes: DataFrame, present: str, total: str, extreme: str, toward: str = "HK") -> DataFrame:
    """(t, n_class, n_hit, percent) for t = 1 .. half the contexts: of the nodes in at most t contexts (`HK`)
    those with a neighbour in more than all but t; of the nodes in all but t or more (`TS`) those with a
    neighbour in fewer. Thresholds are a table of at most half the contexts."""
    all_ = nodes.agg(F.max(total).alias("n_ctx"))
    ts = all_.select("n_ctx", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("n_ctx") / 2))).alias("t"))
    j = nodes.select(present, extreme).crossJoin(F.broadcast(ts))
    if toward == "HK":
        cls, hit = (F.col(present) <= F.col("t")) & (F.col(present) != 0), F.col(extreme) > F.col("n_ctx") - F.col("t")
    else:
        cls, hit = F.col(present) >= F.col("n_ctx") - F.col("t"), F.col(extreme) < F.col("n_ctx") - F.col("t")
    out = j.groupBy("t").agg(F.count(F.when(cls, 1)).alias("n_class"), F.count(F.when(cls & hit, 1)).alias("n_hit"))
    return out.select("t", "n_class", "n_hit", (100.0 * F.try_divide("n_hit", "n_class")).alias("percent"))


def threshold_for(curve: DataFrame, percent: float = 50.0) -> DataFrame:
    """The row of the smallest t that reaches a percentage."""
    return curve.filter(F.col("percent") >= percent).orderBy("t").limit(1)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, brought down by the recurrence."""
    z = x + 8
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def hyper_none(good: Column, bad: Column, draws: Column) -> Column:
    """P(no good one among draws without replacement), as a column."""
    one = F.lit(1.0)
    ln = log_gamma(bad + one) - log_gamma(F.greatest(bad - draws, F.lit(0.0)) + one) - log_gamma(good + bad + one) + log_gamma(F.greatest(good + bad - draws, F.lit(0.0)) + one)
    return F.when(draws > bad, 0.0).otherwise(F.exp(ln))


def expected_neighbour_share(nodes: DataFrame, threshold: float, toward: str = "HK", class_only: bool = False, present: str = "present", total: str = "total", degree: str = "degree") -> DataFrame:
    """One row (percent): expected share of a class with a neighbour of the other kind, if neighbours were
    drawn at random without replacement; averaged over all present nodes or the class alone."""
    d = nodes.filter(F.col(present) != 0)
    s = d.agg(F.max(total).cast("double").alias("n_ctx"), F.count(F.lit(1)).cast("double").alias("n_all"))
    d = d.crossJoin(s)
    ts, hk = F.col(present) <= threshold * F.col("n_ctx"), F.col(present) >= (1 - threshold) * F.col("n_ctx")
    n_hk = d.agg(F.count(F.when(hk, 1)).cast("double").alias("n_hk"))
    d = d.crossJoin(n_hk)
    if toward == "HK":
        none, cls = hyper_none(F.col("n_hk"), F.col("n_all") - 1 - F.col("n_hk"), F.col(degree).cast("double")), ts
    else:
        none, cls = hyper_none(F.col("n_all") - F.col("n_hk"), F.col("n_hk"), F.col(degree).cast("double")), hk
    p = 1 - none
    return d.agg((100.0 * F.avg(F.when(cls, p) if class_only else p)).alias("percent"))


def overlap_tail(n: int, m1: int, m2: int, shared: int) -> tuple[float, float]:
    """(expected, p): edges two networks on n nodes share by chance, and P(more than shared)."""
    pairs = n * (n - 1) // 2
    return m1 * m2 / pairs, hyper_upper(shared, m1, pairs - m1, m2)


# ---------------------------------------------------------------- degree distributions


def degree_distribution(deg: DataFrame, dense: bool = False) -> DataFrame:
    """(degree, n, freq); dense also lists degrees that do not occur, from the smallest to the largest."""
    c = deg.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    total = deg.agg(F.count(F.lit(1)).alias("all"))
    if dense:
        span = c.agg(F.min("degree").alias("lo"), F.max("degree").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("degree"))
        c = span.join(c, "degree", "left").na.fill(0, ["n"])
    return c.crossJoin(total).select("degree", "n", (F.col("n") / F.col("all")).alias("freq"))


def fit_degrees(deg: DataFrame) -> dict[str, float]:
    """Closed-form fits: binomial p, Poisson rate, exponential rate, power-law exponent from the smallest degree."""
    low = deg.agg(F.min("degree").alias("lo"))
    r = deg.crossJoin(low).agg(F.count(F.lit(1)), F.sum("degree"), F.avg("degree"), F.min("degree"), F.sum(F.log(F.col("degree") / F.col("lo")))).first()
    n, total, mean, lo, logs = (float(x) if x is not None else math.nan for x in r)
    return {"n": n, "binom_p": total / (n * (n - 1)), "poisson_rate": mean, "exp_rate": 1 / mean, "power_alpha": 1 + n / logs if logs else math.inf, "power_xmin": lo}


def fit_power_tail(deg: DataFrame) -> dict[str, float]:
    """Exponent and smallest degree of the tail that a power law fits best (least largest gap between the
    distributions; the smallest lower end among equals).

    Works on the table of distinct degrees, which tasks get whole: m edges have at most 2 sqrt(m) distinct degrees.
    Lower ends are spread over tasks, which first bound every gap from below at a few points; only ends whose bound
    does not exceed the gap of the best-bounded one are looked at in full.
    """
    d = degree_distribution(deg).filter("degree > 0").select("degree", "n").orderBy("degree").toPandas()
    best = {"power_alpha": math.nan, "power_xmin": math.nan, "gap": math.inf}
    if len(d) < 2:
        return best
    tails = PowerTails(d["degree"], d["n"])
    tasks = max(1, min(len(d) // 20_000, 1_000))

    def bounds(batches):
        for batch in batches:
            ends = batch["id"].to_numpy()
            for k in range(0, len(ends), 2048):
                yield pd.DataFrame({"id": ends[k : k + 2048], "least": tails.least_gaps(ends[k : k + 2048])})

    def gaps(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "gap": [tails.gap(i) for i in batch["id"]]})

    bound = stored(deg.sparkSession.range(0, len(d) - 1, 1, tasks).mapInPandas(bounds, "id long, least double"), "tail-bounds")
    most = tails.gap(bound.orderBy("least", "id").first()["id"])
    r = bound.filter(F.col("least") <= most * (1 + 1e-12)).select("id").repartition(tasks).mapInPandas(gaps, "id long, gap double").orderBy("gap", "id").first()
    return {"power_alpha": float(tails.alpha[r["id"]]), "power_xmin": float(tails.x[r["id"]]), "gap": r["gap"]}


def expected_bins(deg: DataFrame, step: float = 0.1) -> list[tuple[str, float, float, int, float]]:
    """(model, low, high, n, expected) of each fitted model and quantile bin, expected masses rescaled to 1."""
    f = fit_degrees(deg)
    bins = sorted((r["low"], r["high"], r["n"]) for r in quantile_bins(deg, "degree", step).collect())  # ten bins at most
    cdfs = {
        "binomial": lambda x: binom_cdf(x, int(f["n"]) - 1, f["binom_p"]), "poisson": lambda x: poisson_cdf(x, f["poisson_rate"]),
        "exponential": lambda x: exp_cdf(x, f["exp_rate"]), "powerlaw": lambda x: powerlaw_cdf(x, f["power_alpha"], f["power_xmin"]),
    }
    total, out = sum(n for _, _, n in bins), []
    for name, cdf in cdfs.items():
        mass = [max(0.0, cdf(y) - cdf(x)) for x, y, _ in bins]
        scale = sum(mass)
        out += [(name, x, y, n, total * m / scale if scale else 0.0) for (x, y, n), m in zip(bins, mass)]
    return out


def chi_square_fits(deg: DataFrame, step: float = 0.1) -> list[tuple[str, float, float]]:
    """(model, chi2, p) of each fitted model over quantile bins; infinite where a bin with rows expects none."""
    out, bins = [], expected_bins(deg, step)
    for name in dict.fromkeys(b[0] for b in bins):
        own = [(n, e) for model, _, _, n, e in bins if model == name]
        chi = sum((n - e) ** 2 / e if e else (math.inf if n else 0.0) for n, e in own)
        out.append((name, chi, chi2_upper(chi, len(own) - 1) if math.isfinite(chi) and len(own) > 1 else 0.0))
    return out


# ---------------------------------------------------------------- permutations


def permutation_moments(df: DataFrame, subset: DataFrame, value: str) -> DataFrame:
    """One row: the subset's mean, and mean and standard deviation of the mean of a random subset of the
    same size without replacement, in closed form, with the z-score."""
    j = df.select("node", value).join(subset.select("node", F.lit(1).alias("_in")).distinct(), "node", "left")
    m = j.agg(F.avg(F.when(F.col("_in") == 1, F.col(value))).alias("mean"), F.count("_in").alias("k"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mu"), F.var_pop(value).alias("v"))
    sd = F.sqrt(F.col("v") / F.col("k") * (F.col("n") - F.col("k")) / (F.col("n") - 1))
    return m.select("mean", "mu", sd.alias("sd"), F.try_divide(F.col("mean") - F.col("mu"), sd).alias("z"))


def sure_and_edge(drawn: DataFrame, keys: list[str], size, low, value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of each sample's candidates `_h`, those up to low are taken without an order: (keys, _c, _s, _n), their count and
    the sum and count of value. Of the others, some 20 roots of `size`, (keys, ..., _r), numbered on from there by (_h, node)."""
    v = F.col(value) if value else F.lit(None).cast("double")
    sure = drawn.filter(F.col("_h") <= low).groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.sum(v).alias("_s"), F.count(v).alias("_n"))
    sure = stored(sure, "samples-sure")
    w = Window.partitionBy(*keys).orderBy("_h", "node")
    taken = F.coalesce("_c", F.lit(0))
    taken = F.when(taken <= size, taken).otherwise(F.raise_error(F.lit("a sample has too many small hashes")).cast("long"))
    near = drawn.filter(F.col("_h") > low).withColumn("_r", F.row_number().over(w)).join(F.broadcast(sure.select(*keys, "_c")), keys, "left")  # a row per sample
    return sure, near.withColumn("_r", F.col("_r") + taken).filter(F.col("_r") <= size)


def sampled_means(drawn: DataFrame, keys: list[str], size, low, value: str) -> DataFrame:
    """(keys, mean) of the `size` candidates with the smallest (_h, node) of each sample."""
    sure, near = sure_and_edge(drawn, keys, size, low, value)
    rest = near.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    both = sure.select(*keys, "_s", "_n").unionByName(rest).groupBy(*keys).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return both.select(*keys, F.try_divide("_s", F.col("_n").cast("double")).alias("mean"))


def permutation_samples(df: DataFrame, size: int, value: str, samples: int = 1000, seed: int = 1) -> DataFrame:
    """(sample, mean): means of seeded random subsets of `size` nodes. A sample takes the nodes of the
    smallest hash; only those near the cut, some 20 roots of `size`, are ordered, the others are added up where they are."""
    n = max(1, df.count())
    room = 10 * math.sqrt(size) + 20
    at = lambda k: min(2**63 - 1, int(-(2**63) + min(1.0, k / n) * 2**64))
    runs = df.sparkSession.range(samples).withColumnRenamed("id", "sample")
    h = F.xxhash64(F.lit(seed), "sample", "node")
    drawn = df.select("node", value).crossJoin(F.broadcast(runs)).withColumn("_h", h).filter(F.col("_h") <= at(size + room))
    return sampled_means(drawn, ["sample"], F.lit(size), F.lit(at(max(0.0, size - room))), value)


def permutation_z(df: DataFrame, subset: DataFrame, value: str, samples: int = 1000, seed: int = 1) -> DataFrame:
    """One row (mean, mu, sd, z) with mu and sd from seeded samples."""
    own = df.join(subset.select("node").distinct(), "node", "left_semi").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("k"))
    k = own.first()["k"]
    s = permutation_samples(df, k, value, samples, seed).agg(F.avg("mean").alias("mu"), F.stddev_samp("mean").alias("sd"))
    return own.select("mean").crossJoin(s).select("mean", "mu", "sd", F.try_divide(F.col("mean") - F.col("mu"), F.col("sd")).alias("z"))


def shuffled(members: DataFrame, within_node: bool = False, seed: int = 1) -> DataFrame:
    """Members with their presence values dealt anew, over all cells or among the cells of each node."""
    if within_node:
        w = Window.partitionBy("node")
        a = members.select("node", "ctx").withColumn("_r", F.row_number().over(w.orderBy("ctx")))
        b = members.select("node", "present", F.xxhash64(F.lit(seed), "node", "ctx").alias("_h")).withColumn("_r", F.row_number().over(w.orderBy("_h"))).drop("_h")
        return a.join(b, ["node", "_r"]).select("node", "ctx", "present")
    # over all cells: both sides numbered partition by partition, not in one window
    from ..operators.relational import id_table

    a = id_table(members.select(F.struct("node", "ctx").alias("cell")), "cell")
    b = id_table(members.select(F.struct(F.xxhash64(F.lit(seed), "node", "ctx").alias("h"), "node", "ctx", "present").alias("v")), "v")
    return a.join(b, "id").select("cell.node", "cell.ctx", "v.present")


def density_curve(df: DataFrame, value: str, points: int = 512) -> DataFrame:
    """(x, y): Gaussian kernel density at even points from three widths below the least value to three above
    the largest, by the usual rule-of-thumb width. Equal values are summed as one, before any point meets them."""
    v = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    low, high = quantiles(df, value, [0.25, 0.75]) or (0.0, 0.0)
    s = df.select(F.col(value).cast("double").alias("v")).agg(F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.lit(high - low).alias("iqr"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    narrow = F.least("sd", F.nullif(F.col("iqr") / 1.34, F.lit(0.0)))
    h = 0.9 * F.coalesce(F.nullif(narrow, F.lit(0.0)), F.lit(1.0)) * F.pow("n", F.lit(-0.2))
    s = s.filter("n > 1").withColumn("h", h).withColumn("step", (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (points - 1))
    at = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select("k", (F.col("lo") - 3 * F.col("h") + F.col("k") * F.col("step")).alias("x"), "h", "n")
    near = v.crossJoin(F.broadcast(at))  # `points` rows
    z = (F.col("x") - F.col("v")) / F.col("h")
    return near.groupBy("k", "x", "h", "n").agg(F.sum(F.col("c") * F.exp(-z * z / 2)).alias("s")).select("x", (F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("y"))


def subset_samples(nodes: DataFrame, share: float, samples: int = 1000, seed: int = 1) -> DataFrame:
    """(sample, node): seeded random subsets of floor(share n) nodes each, to take any property of. A sample
    takes the nodes of the smallest hash: a table of each sample's last one is found first, so that subsets
    themselves are never sorted or stored."""
    n = nodes.count()
    k = math.floor(share * n)
    room, top = 10 * math.sqrt(k) + 20, 1 << 52
    low = int(max(0.0, (k - room) / max(n, 1)) * top) - 1
    h = F.pmod(F.xxhash64(F.lit(seed), "sample", "node"), F.lit(top))
    every = nodes.select("node").withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long")))).withColumn("_h", h)
    drawn = every.filter(F.col("_h") <= min(1.0, (k + room) / max(n, 1)) * top)
    _, near = sure_and_edge(drawn, ["sample"], F.lit(k), F.lit(low))
    last = near.filter(F.col("_r") == k).select("sample", F.col("_h").alias("_last"), F.col("node").alias("_end"))
    last = F.broadcast(stored(last, "samples-last"))  # a row per sample
    ahead = (F.col("_h") <= low) | (F.col("_h") < F.col("_last")) | ((F.col("_h") == F.col("_last")) & (F.col("node") <= F.col("_end")))
    return every.join(last, "sample", "left").filter(ahead).select("sample", "node")
