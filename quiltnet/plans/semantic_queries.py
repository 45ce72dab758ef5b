"""Hierarchy and similarity, and statistics over networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import graph, ontology
from ..operators import relational as rel
from .graph_queries import N_CTX, members
from .lineage import stored
from .registry import n, query, r

# ---------------------------------------------------------------- the hierarchy over parts


class Hierarchy:
    """root -> {type:*, brand:*, colour:*, noun:*}; leaves type|brand and part names have two parents."""

    def __init__(self, m):
        part = m.parts().select(F.col("p_partkey").alias("node"), F.concat(F.lit("type:"), "p_type").alias("t"), F.concat(F.lit("brand:"), "p_brand").alias("b"), F.concat(F.lit("colour:"), F.split("p_name", " ")[0]).alias("c"), F.concat(F.lit("noun:"), F.split("p_name", " ")[1]).alias("o"), F.concat(F.lit("tb:"), "p_type", F.lit("|"), "p_brand").alias("tb"), F.concat(F.lit("name:"), "p_name").alias("nm"))
        up = lambda child, parent: part.select(F.col(child).alias("child") if child != "root" else F.lit("root").alias("child"), F.col(parent).alias("parent") if parent != "root" else F.lit("root").alias("parent"))
        named = up("t", "root")
        for c, p in (("b", "root"), ("c", "root"), ("o", "root"), ("tb", "t"), ("tb", "b"), ("nm", "c"), ("nm", "o")):
            named = named.union(up(c, p))
        named = named.distinct()
        ids = stored(rel.id_table(named.select(F.explode(F.array("child", "parent")).alias("name")), "name"), "terms")
        self.names = ids
        self.terms = ids.select("id")
        cid, pid = ids.select(F.col("id").alias("c_id"), F.col("name").alias("child")), ids.select(F.col("id").alias("p_id"), F.col("name").alias("parent"))
        self.is_a = stored(named.join(cid, "child").join(pid, "parent").select(F.col("c_id").alias("child"), F.col("p_id").alias("parent")), "is-a")
        long = part.select("node", F.explode(F.array("tb", "nm")).alias("name"))
        self.annotations = stored(long.join(ids, "name").select("node", F.col("id").alias("term")), "annotations")
        self._closed = self._info = None

    @property
    def closed(self) -> DataFrame:
        if self._closed is None:
            self._closed = stored(ontology.closure(self.is_a, self.terms), "closed")
        return self._closed

    @property
    def info(self) -> DataFrame:
        if self._info is None:
            self._info = stored(ontology.information(self.terms, self.is_a, self.closed, self.annotations), "information")
        return self._info


_H = """WITH pt AS (SELECT p_partkey AS node, 'type:' || p_type AS t, 'brand:' || p_brand AS b, 'colour:' || split_part(p_name, ' ', 1) AS c, 'noun:' || split_part(p_name, ' ', 2) AS o, 'tb:' || p_type || '|' || p_brand AS tb, 'name:' || p_name AS nm FROM part),
named AS (SELECT t AS child, 'root' AS parent FROM pt UNION SELECT b, 'root' FROM pt UNION SELECT c, 'root' FROM pt UNION SELECT o, 'root' FROM pt UNION SELECT tb, t FROM pt UNION SELECT tb, b FROM pt UNION SELECT nm, c FROM pt UNION SELECT nm, o FROM pt),
ids AS (SELECT CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS id, name FROM (SELECT child AS name FROM named UNION SELECT parent FROM named)),
isa AS (SELECT x.id AS child, y.id AS parent FROM named JOIN ids x ON x.name = child JOIN ids y ON y.name = parent),
an AS (SELECT DISTINCT node, id AS term FROM (SELECT node, tb AS name FROM pt UNION ALL SELECT node, nm FROM pt) JOIN ids USING (name)),
cl AS (SELECT term, anc, min(depth) AS depth FROM (SELECT child AS term, parent AS anc, 1 AS depth FROM isa UNION ALL SELECT x.child, y.parent, 2 FROM isa x JOIN isa y ON y.child = x.parent UNION ALL SELECT id, id, 0 FROM ids) GROUP BY term, anc),
own AS (SELECT term, count(*) AS k FROM an GROUP BY term),
fr AS (SELECT id, coalesce(sum(k), 0) AS freq FROM ids LEFT JOIN cl ON anc = id LEFT JOIN own ON own.term = cl.term GROUP BY id),
inf AS (SELECT id, freq, freq * 1.0 / (SELECT sum(freq) FROM fr WHERE id NOT IN (SELECT child FROM isa)) AS p FROM fr),
info AS (SELECT *, CASE WHEN p > 0 THEN -log10(p) ELSE 0 END AS ic FROM inf)"""
_SIM = _H + """, tm AS (SELECT DISTINCT term FROM an),
cm AS (SELECT x.term AS i, y.term AS j, x.anc, f.ic, f.p FROM cl x JOIN cl y ON y.anc = x.anc AND x.term <= y.term JOIN info f ON f.id = x.anc WHERE x.term IN (SELECT term FROM tm) AND y.term IN (SELECT term FROM tm)),
bs AS (SELECT i, j, arg_max(struct_pack(anc := anc, ic := ic, p := p), struct_pack(a := ic, b := -anc)) AS q FROM cm GROUP BY i, j),
sim AS (SELECT i, j, coalesce(2 * q.ic / nullif(x.ic + y.ic, 0) * (1 - q.p), 0) AS s FROM bs JOIN info x ON x.id = i JOIN info y ON y.id = j),
sim2 AS (SELECT i, j, s FROM sim UNION ALL SELECT j, i, s FROM sim WHERE i <> j)"""


@query("o02_roots", _H + " SELECT name FROM ids WHERE id NOT IN (SELECT child FROM isa)", ctes=False)
def _(m):
    h = Hierarchy(m)
    return ontology.roots(h.terms, h.is_a).join(h.names, "id").select("name")


@query("o03_closure", _H + f" SELECT term, anc, {n('depth', 'depth')} FROM cl", ctes=False)
def _(m):
    return Hierarchy(m).closed


@query("o04_levels", _H + f" SELECT id, {n('coalesce((SELECT depth FROM cl WHERE term = id AND anc = (SELECT id FROM ids WHERE name = ' + chr(39) + 'root' + chr(39) + ')), 0)', 'level')} FROM ids", ctes=False)
def _(m):
    h = Hierarchy(m)
    return ontology.levels(h.terms, h.is_a, h.closed)


@query("o08_information", _H + f" SELECT id, {n('freq', 'freq')}, {r('p', 'p')}, {r('ic', 'ic')} FROM info", ctes=False)
def _(m):
    return Hierarchy(m).info


@query("o10_lowest_common", _H + """, lv AS (SELECT term AS id, max(depth) AS level FROM cl GROUP BY term), tm AS (SELECT DISTINCT term FROM an),
c AS (SELECT x.term AS i, y.term AS j, x.anc, level FROM cl x JOIN cl y ON y.anc = x.anc AND x.term < y.term JOIN lv ON lv.id = x.anc WHERE x.term IN (SELECT term FROM tm) AND y.term IN (SELECT term FROM tm))
SELECT i, j, anc FROM (SELECT *, rank() OVER (PARTITION BY i, j ORDER BY level DESC) AS k FROM c) WHERE k = 1""", ctes=False)
def _(m):
    h = Hierarchy(m)
    t = h.annotations.select("term").distinct()
    pairs = t.select(F.col("term").alias("i")).join(t.select(F.col("term").alias("j")), F.col("i") < F.col("j"))
    return ontology.lowest_common_ancestors(pairs, h.closed, ontology.levels(h.terms, h.is_a, h.closed))


_TERM_PAIRS = _SIM + """, tp AS (SELECT DISTINCT x.term AS i, y.term AS j FROM an x JOIN an y ON x.node = y.node AND x.term < y.term)"""


def _term_pairs(h):
    """Pairs of terms that some node has both of."""
    a = h.annotations.select("node", "term").distinct()
    return a.select("node", F.col("term").alias("i")).join(a.select("node", F.col("term").alias("j")), "node").filter("i < j").select("i", "j").distinct()


@query("o11_most_informative", _TERM_PAIRS + f" SELECT i, j, {n('q.anc', 'anc')}, {r('q.ic', 'ic')}, {r('q.p', 'p')} FROM tp JOIN bs USING (i, j)", ctes=False)
def _(m):
    h = Hierarchy(m)
    return ontology.most_informative(_term_pairs(h), h.closed, h.info)


@query("o12_term_similarity", _TERM_PAIRS + f" SELECT i, j, {r('s', 'sim')} FROM tp JOIN sim USING (i, j)", ctes=False)
def _(m):
    h = Hierarchy(m)
    return ontology.term_similarity(_term_pairs(h), h.closed, h.info)


@query("o16_term_matrix", _SIM + f" SELECT i, j, {r('s', 'sim')} FROM sim", ctes=False)
def term_matrix(m):
    h = Hierarchy(m)
    return ontology.term_matrix(h.annotations, h.terms, h.closed, h.info)


@query("o14_node_similarity", _SIM + f""", lp AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT x.p AS x, y.p AS y FROM lp x JOIN lp y ON x.o = y.o AND x.p < y.p)
SELECT e.x, e.y, {r('max(s)', 'score')} FROM e JOIN an a ON a.node = e.x JOIN an b ON b.node = e.y JOIN sim2 ON i = a.term AND j = b.term GROUP BY e.x, e.y""", ctes=False)
def node_similarity(m):
    h = Hierarchy(m)
    matrix = ontology.term_matrix(h.annotations, h.terms, h.closed, h.info, zeros=False)
    return ontology.node_similarity(m.edges().select(F.col("a").alias("x"), F.col("b").alias("y")), h.annotations, matrix)


_PAIRS = _SIM + """, ps AS (SELECT node, string_agg(CAST(term AS VARCHAR), ',' ORDER BY term) AS k FROM an GROUP BY node), pf AS (SELECT k, min(node) AS pr, count(*) AS size FROM ps GROUP BY k), who AS (SELECT node, pr FROM ps JOIN pf USING (k)),
pq AS (SELECT pr, term FROM pf JOIN an ON an.node = pr),
q1 AS (SELECT a.pr AS x, j, max(s) AS s FROM pq a JOIN sim2 ON i = a.term GROUP BY 1, 2), psim AS (SELECT x, b.pr AS y, max(s) AS s FROM q1 JOIN pq b ON b.term = j GROUP BY 1, 2)"""


@query("o18_row_sums", _PAIRS + f", rs AS (SELECT x AS pr, sum(s * size) - max(CASE WHEN x = y THEN s ELSE 0 END) AS v FROM psim JOIN (SELECT pr AS y, size FROM pf) USING (y) GROUP BY x) SELECT node, {r('v', 'row_sum')} FROM who JOIN rs USING (pr)", ctes=False)
def _(m):
    h = Hierarchy(m)
    who, terms = ontology.profiles(h.annotations)
    return ontology.row_sums(who, ontology.profile_similarity(terms, ontology.term_matrix(h.annotations, h.terms, h.closed, h.info, zeros=False)))


@query("o20_cluster_scores", _PAIRS + f""", rs AS (SELECT x AS pr, sum(s * size) - max(CASE WHEN x = y THEN s ELSE 0 END) AS v FROM psim JOIN (SELECT pr AS y, size FROM pf) USING (y) GROUP BY x),
mb AS (SELECT node, node % 10 AS cluster, pr FROM who), sz AS (SELECT cluster, pr, count(*) AS c FROM mb GROUP BY 1, 2),
si AS (SELECT a.cluster, sum(s * CASE WHEN x = y THEN a.c * (a.c - 1) ELSE a.c * b.c END) AS v FROM sz a JOIN psim ON x = a.pr JOIN sz b ON b.cluster = a.cluster AND b.pr = y GROUP BY 1),
sa AS (SELECT cluster, sum(v) AS v, count(*) AS k FROM mb JOIN rs USING (pr) GROUP BY 1), t AS (SELECT count(*) AS n FROM who)
SELECT cluster, {n('k', 'k')}, {r('si.v / (k * (k - 1))', 'inside')}, {r('(sa.v - si.v) / (k * (n - k))', 'outside')}, {r('si.v / (k * (k - 1)) - (sa.v - si.v) / (k * (n - k))', 'score')} FROM sa JOIN si USING (cluster), t""", ctes=False)
def _(m):
    h = Hierarchy(m)
    clusters = m.parts().select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 10).alias("cluster"))
    return ontology.cluster_scores(clusters, h.annotations, stored(ontology.term_matrix(h.annotations, h.terms, h.closed, h.info, zeros=False), "matrix"))


@query("o15_set_score", _PAIRS + f", z AS (SELECT pr, size FROM pf) SELECT {r('sum(s * CASE WHEN x = y THEN a.size * (a.size - 1) ELSE a.size * b.size END) / ((SELECT count(*) FROM who) * ((SELECT count(*) FROM who) - 1))', 'score')} FROM psim JOIN z a ON a.pr = x JOIN z b ON b.pr = y", ctes=False)
def _(m):
    h = Hierarchy(m)
    return ontology.set_score(m.parts().select(F.col("p_partkey").alias("node")), h.annotations, ontology.term_matrix(h.annotations, h.terms, h.closed, h.info, zeros=False))


@query("o23_hierarchy_size", _H + f" SELECT {n('(SELECT count(*) FROM ids)', 'n')}, {n('(SELECT count(*) FROM isa)', 'm')}", ctes=False)
def _(m):
    h = Hierarchy(m)
    return ontology.hierarchy_size(h.terms, h.is_a)


# ---------------------------------------------------------------- statistics

_PROP = """
, ex AS (SELECT node, ctx FROM mem WHERE present <> 0), ec AS (SELECT DISTINCT a, b FROM edges JOIN ex x ON x.node = a JOIN ex y ON y.node = b AND y.ctx = x.ctx),
pc AS (SELECT node, count(ctx) AS total, sum(present) AS present FROM mem GROUP BY node), nb AS (SELECT a AS u, b AS v FROM ec UNION ALL SELECT b, a FROM ec),
nd AS (SELECT node, total, present FROM pc WHERE node IN (SELECT a FROM edges UNION SELECT b FROM edges)),
pr AS (SELECT nd.node, 12 AS total, any_value(nd.present) AS present, count(v) AS degree, coalesce(min(p.present), 12) AS lo, coalesce(max(p.present), 0) AS hi FROM nd LEFT JOIN nb ON u = nd.node LEFT JOIN pc p ON p.node = v GROUP BY nd.node)"""


def _props(m):
    e, mem = stored(m.edges(), "edges"), stored(members(m), "members")
    near = graph.neighbour_presence(e, mem, graph.universe(mem, e), N_CTX)
    counts = rel.presence_counts(mem).select("node", "present")
    return near.join(counts, "node").select("node", F.lit(N_CTX).alias("total"), "present", F.col("coexpr_degree").alias("degree"), F.col("min_neighbor_expr_count").alias("lo"), F.col("max_neighbor_expr_count").alias("hi"))


@query("r01_spearman", _PROP + f""", rk AS (SELECT rank() OVER (ORDER BY present) + (count(*) OVER (PARTITION BY present) - 1) / 2.0 AS x, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS y FROM pr)
SELECT {r('corr(x, y)', 'rho')}, {n('count(*)', 'n')} FROM rk""")
def _(m):
    return stats.spearman(_props(m), "present", "degree")


@query("r02_welch", f"""SELECT {r('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)', 't')}, {r('power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1))', 'df')}, {r('m1', 'm1')}, {r('m2', 'm2')}, {n('n1', 'n1')}, {n('n2', 'n2')}
FROM (SELECT avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m1, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m2, var_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS v1, var_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS v2, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n2 FROM lineitem)""", ctes=False)
def _(m):
    return stats.welch_moments(m.table("lineitem"), "l_extendedprice", "l_returnflag", "A", "R")


#: two-sided p of t with v degrees of freedom, as one less the density's integral (Simpson's rule over g(i))
_T_TWO_SIDED = """round(1 - 2 * sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - ln(v * pi()) / 2 - (v + 1) / 2 * ln(1 + power(t * i / 20000.0, 2) / v))) * any_value(abs(t)) / 60000, 6) + 0.0"""


@query("r01_spearman_test", _PROP + f""", rk AS (SELECT rank() OVER (ORDER BY present) + (count(*) OVER (PARTITION BY present) - 1) / 2.0 AS x, rank() OVER (ORDER BY degree) + (count(*) OVER (PARTITION BY degree) - 1) / 2.0 AS y FROM pr),
z AS (SELECT corr(x, y) AS rho, count(*) AS n FROM rk), w AS (SELECT *, rho * sqrt((n - 2) / (1 - rho * rho)) AS t, n - 2.0 AS v FROM z)
SELECT {r('any_value(rho)', 'rho')}, {n('any_value(n)', 'n')}, {_T_TWO_SIDED} AS p FROM w, range(20001) g(i)""")
def _(m):
    got = stats.spearman(_props(m), "present", "degree").first()
    return m.spark.createDataFrame([(got["rho"], got["n"], round(stats.correlation_p(got["rho"], got["n"]), 6))], "rho double, n long, p double")


@query("r02_welch_test", f"""WITH g AS (SELECT l_linestatus, avg(l_discount) AS m, var_samp(l_discount) AS v, count(*) AS n FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY 1),
w AS (SELECT (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, power(a.v / a.n + b.v / b.n, 2) / (power(a.v / a.n, 2) / (a.n - 1) + power(b.v / b.n, 2) / (b.n - 1)) AS v FROM g a, g b WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O')
SELECT {r('any_value(t)', 't')}, {r('any_value(v)', 'df')}, {_T_TWO_SIDED} AS p FROM w, range(20001) g(i)""", ctes=False)
def _(m):
    got = stats.welch_moments(m.table("lineitem"), "l_discount", "l_linestatus", "F", "O").first()
    return m.spark.createDataFrame([(got["t"], got["df"], round(stats.welch_p(got["t"], got["df"]), 6))], "t double, df double, p double")


@query("r03_pearson", f"SELECT {r('corr(l_quantity, l_extendedprice)', 'r')}, {n('count(*)', 'n')} FROM lineitem", ctes=False)
def _(m):
    return stats.pearson(m.table("lineitem"), "l_quantity", "l_extendedprice")


@query("r04_line_fit", f"SELECT {r('regr_slope(l_extendedprice, l_quantity)', 'slope')}, {r('regr_intercept(l_extendedprice, l_quantity)', 'intercept')}, {r('regr_r2(l_extendedprice, l_quantity)', 'r2')} FROM lineitem", ctes=False)
def _(m):
    return stats.line_fit(m.table("lineitem"), "l_quantity", "l_extendedprice")


def _share_sql(cls: str, hit: str, tail: str = "") -> str:
    return _PROP + f""", t AS (SELECT unnest(range(1, 7)) AS t), q AS (SELECT t, count(*) FILTER ({cls}) AS c, count(*) FILTER ({cls} AND {hit}) AS h FROM pr, t GROUP BY t)
SELECT {n('t', 't')}, {n('c', 'n_class')}, {n('h', 'n_hit')}, {r('100.0 * h / nullif(c, 0)', 'percent')} FROM q {tail}"""


@query("r05_rare_to_common", _share_sql("present <= t AND present <> 0", "hi > 12 - t"))
def _(m):
    return stats.neighbour_class_share(_props(m), "present", "total", "hi", "HK")


@query("r06_common_to_rare", _share_sql("present >= 12 - t", "lo < 12 - t"))
def _(m):
    return stats.neighbour_class_share(_props(m), "present", "total", "lo", "TS")


@query("r08_threshold_search", _share_sql("present <= t AND present <> 0", "hi > 12 - t", "WHERE 100.0 * h >= 50 * c AND c > 0 ORDER BY t LIMIT 1"))
def _(m):
    return stats.threshold_for(stats.neighbour_class_share(_props(m), "present", "total", "hi", "HK"))


def _expect_sql(good: str, bad: str) -> str:
    choose = f"CASE WHEN degree > {bad} THEN 0 ELSE exp(lgamma({bad} + 1) - lgamma({bad} - degree + 1) - lgamma({good} + {bad} + 1) + lgamma({good} + {bad} - degree + 1)) END"
    return _PROP + f""", d AS (SELECT * FROM pr WHERE present <> 0), c AS (SELECT count(*) AS n, count(*) FILTER (present >= 0.5 * 12) AS hk FROM d)
SELECT round(avg(100.0 * (1 - {choose})), 6) + 0.0 AS percent FROM d, c"""


@query("r07_expected_to_common", _expect_sql("hk", "(n - 1 - hk)"))
def _(m):
    return stats.expected_neighbour_share(_props(m), 0.5, "HK").select(F.round("percent", 6).alias("percent"))


@query("r07_expected_to_rare", _expect_sql("(n - hk)", "hk"))
def _(m):
    return stats.expected_neighbour_share(_props(m), 0.5, "TS").select(F.round("percent", 6).alias("percent"))


_DEG = ", dg AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node)"


@query("r13_degree_distribution", _DEG + f", g AS (SELECT unnest(range(min(degree), max(degree) + 1)) AS degree FROM dg) SELECT {n('g.degree', 'degree')}, {n('count(node)', 'n')}, {r('count(node) * 1.0 / (SELECT count(*) FROM dg)', 'freq')} FROM g LEFT JOIN dg USING (degree) GROUP BY g.degree")
def _(m):
    return stats.degree_distribution(stored(graph.degrees(m.edges()), "degrees"), dense=True)


@query("r10_degree_fits", _DEG + f" SELECT {r('sum(degree) * 1.0 / (count(*) * (count(*) - 1.0))', 'binom_p')}, {r('avg(degree)', 'poisson_rate')}, {r('1 / avg(degree)', 'exp_rate')}, {r('1 + count(*) / sum(ln(degree * 1.0 / (SELECT min(degree) FROM dg)))', 'power_alpha')} FROM dg")
def _(m):
    f = stats.fit_degrees(stored(graph.degrees(m.edges()), "degrees"))
    return m.spark.createDataFrame([tuple(f[k] for k in ("binom_p", "poisson_rate", "exp_rate", "power_alpha"))], "binom_p double, poisson_rate double, exp_rate double, power_alpha double")


@query("r12_goodness_of_fit")
def _(m):
    return m.spark.createDataFrame(stats.chi_square_fits(stored(graph.degrees(m.edges()), "degrees")), "model string, chi2 double, p double")


_FITS = """, od AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS k FROM dg), pl AS (SELECT p * (SELECT count(*) - 1 FROM dg) AS x FROM (SELECT CAST(i AS DOUBLE) * CAST(0.1 AS DOUBLE) AS p FROM range(10) t(i) UNION ALL SELECT CAST(1 AS DOUBLE))),
qs AS (SELECT DISTINCT x.degree + (y.degree - x.degree) * (pl.x - floor(pl.x)) AS q FROM pl JOIN od x ON x.k = floor(pl.x) JOIN od y ON y.k = ceil(pl.x)), bs AS (SELECT lag(q) OVER (ORDER BY q) AS low, q AS high, row_number() OVER (ORDER BY q) AS b FROM qs),
ob AS (SELECT low, high, count(degree) AS n FROM bs LEFT JOIN dg ON (degree > low OR (b = 2 AND degree = low)) AND degree <= high WHERE low IS NOT NULL GROUP BY 1, 2),
fd AS (SELECT count(*) - 1 AS k, sum(degree) * 1.0 / (count(*) * (count(*) - 1.0)) AS p, avg(degree) AS lam, min(degree) AS lo, (SELECT 1 + count(*) / sum(ln(degree * 1.0 / (SELECT min(degree) FROM dg))) FROM dg) AS alpha, max(degree) AS top FROM dg),
pm AS (SELECT x, CASE WHEN x <= k THEN exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + x * ln(p) + (k - x) * ln(1 - p)) ELSE 0 END AS bi, exp(x * ln(lam) - lam - lgamma(x + 1)) AS po FROM fd, (SELECT unnest(range(0, (SELECT top FROM fd) + 1)) AS x)),
ms AS (SELECT low, high, n, coalesce(sum(bi), 0) AS bi, coalesce(sum(po), 0) AS po FROM ob LEFT JOIN pm ON x > floor(low) AND x <= floor(high) GROUP BY 1, 2, 3),
al AS (SELECT 'binomial' AS model, low, high, n, bi AS m FROM ms UNION ALL SELECT 'poisson', low, high, n, po FROM ms UNION ALL SELECT 'exponential', low, high, n, exp(-low / lam) - exp(-high / lam) FROM ms, fd UNION ALL SELECT 'powerlaw', low, high, n, power(low / lo, 1 - alpha) - power(high / lo, 1 - alpha) FROM ms, fd)"""


@query("r12_expected_counts", _DEG + _FITS + f" SELECT model, {r('low', 'low')}, {r('high', 'high')}, {n('n', 'n')}, round(sum(n) OVER (PARTITION BY model) * m / sum(m) OVER (PARTITION BY model), 4) + 0.0 AS expected FROM al")
def _(m):
    """Observed and expected degrees of each fitted model in each quantile bin."""
    rows = stats.expected_bins(stored(graph.degrees(m.edges()), "degrees"))
    return m.spark.createDataFrame([(*x, round(e, 4)) for *x, e in rows], "model string, low double, high double, n long, expected double")


@query("r14_permutation_moments", _DEG + f""", s AS (SELECT degree, node IN (SELECT p_partkey FROM part WHERE p_size > 25) AS i FROM dg), q AS (SELECT avg(degree) FILTER (i) AS mean, count(*) FILTER (i) AS k, count(*) AS n, avg(degree) AS mu, var_pop(degree) AS v FROM s)
SELECT {r('mean', 'mean')}, {r('mu', 'mu')}, {r('sqrt(v / k * (n - k) / (n - 1))', 'sd')}, {r('(mean - mu) / sqrt(v / k * (n - k) / (n - 1))', 'z')} FROM q""")
def _(m):
    return stats.permutation_moments(graph.degrees(m.edges()), m.parts().filter("p_size > 25").select(F.col("p_partkey").alias("node")), "degree")


@query("r14_permutation_z")
def _(m):
    d = stored(graph.degrees(m.edges()), "degrees")
    return stats.permutation_z(d, m.parts().filter("p_size > 45").select(F.col("p_partkey").alias("node")), "degree")


@query("r18_shuffled_presence", f", c AS (SELECT count(*) AS k, sum(present) AS p FROM mem) SELECT {n('k', 'cells')}, {n('p', 'present')}, TRUE AS moved, TRUE AS same_cells FROM c")
def _(m):
    """Cells and presences stay as many, every cell is there once, and at least a tenth of them changed."""
    mem = stored(m.month_members(), "members")
    new = stored(stats.shuffled(mem), "shuffled")
    both = mem.join(new.withColumnRenamed("present", "new"), ["node", "ctx"], "full")
    moved = F.sum(F.when(F.col("present") != F.col("new"), 1).otherwise(0)) * 10 >= F.count("present")
    return both.agg(F.count("new").alias("cells"), F.sum("new").alias("present"), moved.alias("moved"), (F.count(F.lit(1)) == F.count("present")).alias("same_cells"))


@query("r18_shuffled_within_nodes", f"SELECT node, {n('count(*)', 'cells')}, {n('sum(present)', 'present')} FROM mem GROUP BY node")
def _(m):
    mem = stored(m.month_members(), "members")
    new = stats.shuffled(mem, within_node=True).join(mem.select("node", "ctx"), ["node", "ctx"])
    return new.groupBy("node").agg(F.count("present").alias("cells"), F.sum("present").alias("present"))


@query("a29_binned_mean", f"SELECT {r('round(l_quantity / 10) * 10', 'bin')}, {n('count(*)', 'n')}, {r('avg(l_extendedprice)', 'mean')}, {r('stddev_samp(l_extendedprice) / sqrt(count(*))', 'se')} FROM lineitem GROUP BY 1", ctes=False)
def _(m):
    return stats.binned_mean(m.table("lineitem"), "l_quantity", "l_extendedprice", 10)


@query("a30_loglog_fit", _DEG + f", q AS (SELECT degree, avg(p_retailprice) AS y FROM dg JOIN part ON p_partkey = node GROUP BY degree) SELECT {r('regr_slope(log10(y), log10(degree))', 'slope')}, {r('regr_intercept(log10(y), log10(degree))', 'intercept')} FROM q")
def _(m):
    d = graph.degrees(m.edges()).join(m.parts().select(F.col("p_partkey").alias("node"), "p_retailprice"), "node").groupBy("degree").agg(F.avg("p_retailprice").alias("y"))
    return stats.line_fit(d.select(F.log10("degree").alias("x"), F.log10("y").alias("y")), "x", "y").select("slope", "intercept")


# ---------------------------------------------------------------- a deep hierarchy: a term's parent has half its number

_HALF = """WITH RECURSIVE up AS (SELECT CAST(p_partkey AS BIGINT) AS term, CAST(p_partkey // 2 AS BIGINT) AS anc, 1 AS depth FROM part WHERE p_partkey >= 1 UNION ALL SELECT term, anc // 2, depth + 1 FROM up WHERE anc >= 1)"""


def _half(m):
    return m.parts().filter("p_partkey >= 1").select(F.col("p_partkey").cast("long").alias("child"), F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"))


@query("o03_deep_closure", _HALF + f" SELECT term, anc, {n('depth', 'depth')} FROM up", ctes=False)
def _(m):
    return ontology.closure(_half(m))


@query("o05_deep_paths", _HALF + " SELECT string_agg(CAST(anc AS VARCHAR), '/' ORDER BY depth DESC) || '/' || max(term) AS path FROM up WHERE term = (SELECT max(p_partkey) FROM part)", ctes=False)
def _(m):
    last = m.parts().agg(F.max("p_partkey")).first()[0]
    return ontology.paths_to_roots(_half(m), last).select(F.array_join("path", "/").alias("path"))


@query("o06_relatives", _HALF + """ SELECT 'parent' AS kind, anc AS id FROM up WHERE term = 9 AND depth = 1 UNION ALL SELECT 'child', term FROM up WHERE anc = 9 AND depth = 1
UNION ALL SELECT 'ancestor', anc FROM up WHERE term = 9 UNION ALL SELECT 'descendant', term FROM up WHERE anc = 9""", ctes=False)
def _(m):
    is_a = stored(_half(m), "half")
    return ontology.relatives(is_a, ontology.closure(is_a), 9)


@query("o17_unknown_nodes_score_zero", _SIM + f""", pq AS (SELECT node AS x, node + 1 AS y FROM pt WHERE node % 3 = 0 UNION ALL SELECT node, -node - 1 FROM pt)
SELECT pq.x, pq.y, {r('coalesce(max(s), 0)', 'score')} FROM pq LEFT JOIN an a ON a.node = pq.x LEFT JOIN an b ON b.node = pq.y LEFT JOIN sim2 ON i = a.term AND j = b.term GROUP BY 1, 2""", ctes=False)
def _(m):
    h = Hierarchy(m)
    node = m.parts().select(F.col("p_partkey").alias("x"))
    pairs = node.filter("x % 3 = 0").select("x", (F.col("x") + 1).alias("y")).union(node.select("x", -F.col("x") - 1))
    return ontology.node_similarity(pairs, h.annotations, ontology.term_matrix(h.annotations, h.terms, h.closed, h.info, zeros=False))


@query("o19_term_lookup", _SIM + f", pq AS (SELECT term AS i, term + 1 AS j FROM (SELECT DISTINCT term FROM an)) SELECT pq.i, pq.j, {r('coalesce(max(s), 0)', 'sim')} FROM pq LEFT JOIN sim2 USING (i, j) GROUP BY 1, 2", ctes=False)
def _(m):
    h = Hierarchy(m)
    matrix = ontology.term_matrix(h.annotations, h.terms, h.closed, h.info)
    pairs = h.annotations.select(F.col("term").alias("i")).distinct().withColumn("j", F.col("i") + 1)
    return ontology.term_lookup(pairs, matrix)
