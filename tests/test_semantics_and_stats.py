import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltnet.functions import stats, tails
from quiltnet.operators import ontology


def diamond(spark):
    terms = spark.createDataFrame([(k,) for k in range(1, 6)], "id long")
    is_a = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (5, 4)], "child long, parent long")
    return terms, is_a


def test_hierarchy(spark):
    terms, is_a = diamond(spark)
    closed = ontology.closure(is_a, terms)
    got = {(r["term"], r["anc"]): r["depth"] for r in closed.collect()}
    assert got == {(k, k): 0 for k in range(1, 6)} | {(2, 1): 1, (3, 1): 1, (4, 2): 1, (4, 3): 1, (4, 1): 2, (5, 4): 1, (5, 2): 2, (5, 3): 2, (5, 1): 3}
    assert {r["id"]: r["level"] for r in ontology.levels(terms, is_a, closed).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert sorted(r["path"] for r in ontology.paths_to_roots(is_a, 5).collect()) == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert {(r["kind"], r["id"]) for r in ontology.relatives(is_a, closed, 4).collect()} == {("parent", 2), ("parent", 3), ("child", 5), ("ancestor", 1), ("ancestor", 2), ("ancestor", 3), ("descendant", 5)}
    pairs = spark.createDataFrame([(2, 3), (4, 5)], "i long, j long")
    lca = {(r["i"], r["j"], r["anc"]) for r in ontology.lowest_common_ancestors(pairs, closed, ontology.levels(terms, is_a, closed)).collect()}
    assert lca == {(2, 3, 1), (4, 5, 4)}


def plain_scores(annotations):
    anc = {1: {1}, 2: {1, 2}, 3: {1, 3}, 4: {1, 2, 3, 4}, 5: {1, 2, 3, 4, 5}}
    freq = {k: sum(1 for _, t in annotations if k in anc[t]) for k in anc}
    p = {k: freq[k] / freq[1] for k in anc}
    ic = {k: -math.log10(p[k]) if p[k] else 0.0 for k in anc}

    def sim(i, j):
        m = max(anc[i] & anc[j], key=lambda a: (ic[a], -a))
        return 2 * ic[m] / (ic[i] + ic[j]) * (1 - p[m]) if ic[i] + ic[j] else 0.0

    own = {}
    for n, t in annotations:
        own.setdefault(n, set()).add(t)
    return freq, ic, sim, own, lambda x, y: max(sim(i, j) for i in own[x] for j in own[y])


def test_similarity_against_plain_python(spark):
    rng = random.Random(3)
    annotations = sorted({(n, rng.choice([2, 3, 4, 5])) for n in range(12) for _ in range(2)})
    terms, is_a = diamond(spark)
    a = spark.createDataFrame(annotations, "node long, term long")
    closed = ontology.closure(is_a, terms)
    info = ontology.information(terms, is_a, closed, a)
    freq, ic, sim, own, score = plain_scores(annotations)
    assert {r["id"]: r["freq"] for r in info.collect()} == freq
    assert {r["id"]: r["ic"] for r in info.collect()} == pytest.approx(ic)
    matrix = ontology.term_matrix(a, terms, closed, info)
    for r in matrix.collect():
        assert r["sim"] == pytest.approx(sim(r["i"], r["j"])) and 0 <= r["sim"] <= 1
    asked = spark.createDataFrame([(2, 3), (3, 2), (4, 5), (5, 5)], "i long, j long")  # in any order
    assert {(r["i"], r["j"]): r["sim"] for r in ontology.term_similarity(asked, closed, info).collect()} == pytest.approx({p: sim(*p) for p in [(2, 3), (3, 2), (4, 5), (5, 5)]})
    best = {(r["i"], r["j"]): r["anc"] for r in ontology.most_informative(asked, closed, info).collect()}
    assert best == {(2, 3): 1, (3, 2): 1, (4, 5): 4, (5, 5): 5}
    pairs = spark.createDataFrame([(x, y) for x in own for y in own if x < y] + [(0, 99)], "x long, y long")
    for r in ontology.node_similarity(pairs, a, matrix).collect():
        assert r["score"] == pytest.approx(0.0 if r["y"] == 99 else score(r["x"], r["y"]))
    who, pt = ontology.profiles(a)
    sums = {r["node"]: r["row_sum"] for r in ontology.row_sums(who, ontology.profile_similarity(pt, matrix)).collect()}
    assert sums == pytest.approx({x: sum(score(x, y) for y in own if y != x) for x in own})
    clusters = {n: n % 3 for n in range(14)} | {50: 7}
    got = {r["cluster"]: r for r in ontology.cluster_scores(spark.createDataFrame(list(clusters.items()), "node long, cluster long"), a, matrix).collect()}
    for c in range(3):
        members = [n for n in own if clusters[n] == c]
        k, n = len(members), len(own)
        inside = sum(score(x, y) for x in members for y in members if x != y)
        outside = sum(sums[x] for x in members) - inside
        assert (got[c]["inside"], got[c]["outside"]) == pytest.approx((inside / (k * (k - 1)), outside / (k * (n - k))))
    assert got[7]["score"] == 0.0
    everyone = spark.createDataFrame([(n,) for n in own], "node long")
    mean = sum(score(x, y) for x in own for y in own if x < y) / (len(own) * (len(own) - 1) / 2)
    assert ontology.set_score(everyone, a, matrix).first()[0] == pytest.approx(mean)
    assert ontology.set_score(everyone.limit(0), a, matrix).first()[0] is None


def test_tails():
    assert tails.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi2_upper(11.0704976935, 5) == pytest.approx(0.05, abs=1e-9)
    assert tails.normal_upper(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert tails.hyper_none(5, 10, 3) == pytest.approx(10 * 9 * 8 / (15 * 14 * 13))
    assert tails.hyper_upper(0, 5, 10, 3) == pytest.approx(1 - tails.hyper_none(5, 10, 3))
    assert tails.binom_cdf(3, 10, 0.5) == pytest.approx(176 / 1024)
    assert tails.poisson_cdf(2, 3.0) == pytest.approx(8.5 * math.exp(-3))


def test_hypergeometric_column(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(5.0, 10.0, 3.0), (1.0, 2.0, 5.0), (40.0, 60.0, 20.0), (0.0, 4.0, 2.0)], "g double, b double, k double")
    for r in df.select("g", "b", "k", stats.hyper_none(F.col("g"), F.col("b"), F.col("k")).alias("p")).collect():
        assert r["p"] == pytest.approx(tails.hyper_none(int(r["g"]), int(r["b"]), int(r["k"])), abs=1e-9)


def test_ranks_and_curves(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (2.0, 9.0), (4.0, 1.0)], "x double, y double")
    assert {r["x"]: r["rk"] for r in stats.average_ranks(df, "x", "rk").collect()} == {1.0: 1.0, 2.0: 2.5, 4.0: 4.0}
    # ranks 1, 2.5, 2.5, 4 and 2.5, 2.5, 4, 1
    assert stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(-0.5)
    assert {r["x"]: r["freq"] for r in stats.ecdf(df, "x").collect()} == {1.0: 0.25, 2.0: 0.75, 4.0: 1.0}
    assert stats.quantile_breaks(df, "x", 0.5) == [1.0, 2.0, 4.0]
    assert [(r["bin"], r["n"]) for r in stats.quantile_bins(df, "x", 0.5).orderBy("bin").collect()] == [(1, 3), (2, 1)]
    hist = {r["bin"]: r["n"] for r in stats.fixed_histogram(df, "x", 1.0, 4.0, 3).collect()}
    assert hist == {1: 3, 3: 1}


def test_fits(spark):
    rng = random.Random(5)
    degrees = spark.createDataFrame([(k, max(1, round(rng.expovariate(0.2)))) for k in range(400)], "node long, degree long")
    got = {m: (c, p) for m, c, p in stats.chi_square_fits(degrees)}
    assert set(got) == {"binomial", "poisson", "exponential", "powerlaw"} and got["exponential"][0] < got["binomial"][0]
    tail = stats.fit_power_tail(spark.createDataFrame([(k, int(3 * (1 - rng.random()) ** -0.8)) for k in range(3000)], "node long, degree long"))
    assert 1.8 < tail["power_alpha"] < 2.8


def brute_tail(values):
    """(alpha, lower end, gap) of the best tail, each one looked at in full."""
    best = (math.nan, math.nan, math.inf)
    for lo in sorted(set(values))[:-1]:
        kept = sorted(v for v in values if v >= lo)
        alpha = 1 + len(kept) / sum(math.log(v / lo) for v in kept)
        gap = 0.0
        for v in set(kept):
            model = 1 - (v / lo) ** (1 - alpha)
            gap = max(gap, abs(sum(w < v for w in kept) / len(kept) - model), abs(sum(w <= v for w in kept) / len(kept) - model))
        if gap < best[2]:
            best = (alpha, float(lo), gap)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_power_tail_is_the_best_of_all(spark, seed):
    rng = random.Random(seed)
    values = [int((2 + 3 * seed) * (1 - rng.random()) ** -0.7) for _ in range(400)] + [rng.randint(1, 6) for _ in range(100 * seed)]
    got = stats.fit_power_tail(spark.createDataFrame(list(enumerate(values)), "node long, degree long"))
    alpha, lo, gap = brute_tail(values)
    assert (got["power_xmin"], got["power_alpha"], got["gap"]) == (lo, pytest.approx(alpha), pytest.approx(gap))


def test_power_tail_of_few_degrees(spark):
    for rows in ([], [(1, 0)], [(1, 4), (2, 4)]):  # no edge, no degree above zero, one degree
        assert math.isnan(stats.fit_power_tail(spark.createDataFrame(rows, "node long, degree long"))["power_alpha"])


def test_gaps_by_intervals_equal_full_ones():
    rng = np.random.default_rng(3)
    x, n = np.unique((5 * (1 - rng.random(20_000)) ** -0.9).astype(np.int64), return_counts=True)
    t = tails.PowerTails(x, n)
    least = t.least_gaps(np.arange(len(x) - 1))
    for i in (0, 3, len(x) // 2, len(x) - 2):
        at = np.arange(i, len(x))
        model = 1 - (x[at] / x[i]) ** (1 - (1 + n[i:].sum() / (n[i:] * np.log(x[i:] / x[i])).sum()))
        own = np.cumsum(n[i:]) / n[i:].sum()
        full = max(abs(own - model).max(), abs(own - n[i:] / n[i:].sum() - model).max())
        assert t.gap(i, 16) == pytest.approx(full) and least[i] <= full + 1e-12


def test_power_tail_of_a_million_degrees(spark):
    """Distinct degrees by the million: most lower ends are dropped by bounds alone."""
    x = np.arange(1, 1_000_001)
    n = np.maximum(1, (1e7 * x**-1.5).astype(np.int64))
    t = tails.PowerTails(x, n)
    began = time.time()
    least = np.concatenate([t.least_gaps(np.arange(k, min(k + 4096, len(x) - 1))) for k in range(0, len(x) - 1, 4096)])
    most = t.gap(int(least.argmin()))
    left = np.flatnonzero(least <= most)
    best = min((t.gap(int(i)), i) for i in left)
    assert best[0] <= most and len(left) < len(x) / 100 and time.time() - began < 20


@pytest.mark.parametrize("k,good,bad,draws", [(0, 5, 10, 3), (2, 5, 10, 7), (-1, 5, 10, 3), (4, 5, 10, 6), (5, 5, 10, 6), (0, 8, 2, 5), (60, 300, 700, 200), (59, 300, 700, 200), (20, 300, 700, 200), (150, 300, 700, 200)])
def test_hypergeometric_tail_equals_the_sum_of_its_terms(k, good, bad, draws):
    terms = [math.comb(good, i) * math.comb(bad, draws - i) for i in range(max(k + 1, 0), min(good, draws) + 1) if draws - i <= bad]
    assert tails.hyper_upper(k, good, bad, draws) == pytest.approx(sum(terms) / math.comb(good + bad, draws), rel=1e-9)


def test_hypergeometric_tail_of_many_draws():
    """Ten million draws: terms beyond a few deviations are never formed."""
    began = time.time()
    assert tails.hyper_upper(5_000_000, 10**9, 10**9, 10**7) == pytest.approx(0.5, abs=1e-3) and time.time() - began < 5


def test_quantiles_by_counts(spark):
    rng = random.Random(2)
    values = [float(rng.randint(0, 50)) for _ in range(500)] + [7.0] * 300
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    assert stats.quantiles(df, "x", probs) == pytest.approx(list(np.quantile(values, probs)))
    assert stats.quantiles(df.filter("x is null"), "x", probs) == [] and stats.quantile_bins(df.filter("x is null"), "x").count() == 0
    assert stats.quantiles(spark.createDataFrame([(3.0,)], "x double"), "x", probs) == [3.0] * 7


def test_p_of_correlations():
    assert stats.correlation_p(0.5, 12) == pytest.approx(0.0978, abs=1e-4)  # from tables
    assert stats.correlation_p(1.0, 9) == 0 and math.isnan(stats.correlation_p(None, 9)) and math.isnan(stats.correlation_p(0.3, 2))


def test_permutations(spark):
    df = spark.createDataFrame([(k, float(k % 17)) for k in range(300)], "node long, value double")
    subset = df.filter("node % 7 = 0").select("node")
    exact, drawn = stats.permutation_moments(df, subset, "value").first(), stats.permutation_z(df, subset, "value", 400).first()
    assert drawn["mean"] == pytest.approx(exact["mean"]) and drawn["mu"] == pytest.approx(exact["mu"], abs=0.3) and drawn["sd"] == pytest.approx(exact["sd"], rel=0.25)
    s = stats.permutation_samples(df, 43, "value", 20)
    assert s.count() == 20 and sorted(map(tuple, s.collect())) == sorted(map(tuple, stats.permutation_samples(df, 43, "value", 20).collect()))
    mem = spark.createDataFrame([(n, c, int((n * c) % 3 == 1)) for n in range(20) for c in range(5)], "node long, ctx long, present long")
    for within in (False, True):
        out = stats.shuffled(mem, within)
        assert out.count() == 100 and out.agg({"present": "sum"}).first()[0] == mem.agg({"present": "sum"}).first()[0]
        if within:
            per = lambda d: {r[0]: r[1] for r in d.groupBy("node").sum("present").collect()}
            assert per(out) == per(mem)


def test_density_integrates_to_one(spark):
    at = sorted(tuple(r) for r in stats.density_curve(spark.createDataFrame([(random.Random(1).gauss(0, 1) + 0.01 * k,) for k in range(200)], "v double"), "v").collect())
    assert sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(at, at[1:])) == pytest.approx(1, abs=0.01)


def test_samples_order_only_what_lies_near_their_cut(spark):
    n, size, top = 20_000, 5_000, 1 << 52
    nodes = spark.range(n).withColumnRenamed("id", "node")
    drawn = nodes.crossJoin(spark.range(3).withColumnRenamed("id", "sample")).selectExpr("node", "sample", f"pmod(xxhash64(1, sample, node), {top}) AS _h", "cast(node AS double) AS v")
    room = 10 * size**0.5 + 20
    some = drawn.filter(drawn["_h"] <= int((size + room) / n * top))
    sure, near = stats.sure_and_edge(some, ["sample"], F.lit(size), F.lit(int((size - room) / n * top)), "v")
    assert near.count() + sum(r["_c"] for r in sure.collect()) == 3 * size and near.count() < 6 * room
    want = {}
    for r in drawn.collect():
        want.setdefault(r["sample"], []).append((r["_h"], r["node"]))
    want = {s: {v for _, v in sorted(x)[:size]} for s, x in want.items()}
    got = {}
    for r in stats.subset_samples(nodes, size / n, 3).collect():
        got.setdefault(r["sample"], set()).add(r["node"])
    assert got == want
    d = nodes.selectExpr("node", "cast(node AS double) AS v")
    h = d.crossJoin(spark.range(3).withColumnRenamed("id", "sample")).selectExpr("sample", "node", "xxhash64(1, sample, node) AS h").collect()
    means = {r["sample"]: r["mean"] for r in stats.permutation_samples(d, size, "v", 3).collect()}
    assert means == {s: sum(v for _, v in sorted((r["h"], r["node"]) for r in h if r["sample"] == s)[:size]) / size for s in range(3)}
