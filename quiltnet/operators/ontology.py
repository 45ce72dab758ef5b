"""Is-a hierarchies: closure, levels, information content, and similarity of annotated nodes.

terms (id), is_a (child, parent) and annotations (node, term) are tables throughout; sets of
ancestors are rows of the closure, never arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import stored


def roots(terms: DataFrame, is_a: DataFrame) -> DataFrame:
    return terms.select("id").join(is_a.select(F.col("child").alias("id")).distinct(), "id", "left_anti")


def closure(is_a: DataFrame, reflexive_over: DataFrame | None = None) -> DataFrame:
    """(term, anc, depth): every ancestor with its shortest distance; with terms given, each is its own
    ancestor at distance 0. Paths double in length each round."""
    now = stored(is_a.select(F.col("child").alias("term"), F.col("parent").alias("anc"), F.lit(1).alias("depth")).distinct(), "closure")
    n = now.count()
    while True:
        further = now.alias("x").join(now.alias("y"), F.col("x.anc") == F.col("y.term")).select("x.term", "y.anc", (F.col("x.depth") + F.col("y.depth")).alias("depth"))
        now = stored(now.union(further).groupBy("term", "anc").agg(F.min("depth").alias("depth")), "closure")
        m = now.count()
        if m == n:
            break
        n = m
    if reflexive_over is not None:
        now = now.union(reflexive_over.select(F.col("id").alias("term"), F.col("id").alias("anc"), F.lit(0).alias("depth")))
    return now


def levels(terms: DataFrame, is_a: DataFrame, closed: DataFrame) -> DataFrame:
    """(id, level): shortest distance to a root."""
    top = roots(terms, is_a)
    up = closed.join(top.select(F.col("id").alias("anc")), "anc", "left_semi").groupBy(F.col("term").alias("id")).agg(F.min("depth").alias("level"))
    return terms.select("id").join(up, "id", "left").select("id", F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def paths_to_roots(is_a: DataFrame, term: int) -> DataFrame:
    """(path): every path from a root down to the term; fails where the term or one above it is above itself."""
    open_ = is_a.sparkSession.createDataFrame([(term, [term])], "head long, path array<long>")
    done = open_.select("path").limit(0)
    while True:
        up = open_.join(is_a, open_["head"] == is_a["child"], "left")
        done = done.union(up.filter("parent is null").select("path"))
        open_ = stored(up.filter("parent is not null").select(F.col("parent").alias("head"), F.concat(F.array("parent"), "path").alias("path")), "paths")
        if open_.isEmpty():
            return done
        if not open_.filter(F.size(F.array_distinct("path")) < F.size("path")).isEmpty():
            raise ValueError("the hierarchy has a cycle")


def relatives(is_a: DataFrame, closed: DataFrame, term: int) -> DataFrame:
    """(kind, id): parents, children, ancestors and descendants of a term."""
    part = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).alias("id"))
    return (
        part(is_a.filter(F.col("child") == term), "parent", "parent")
        .union(part(is_a.filter(F.col("parent") == term), "child", "child"))
        .union(part(closed.filter((F.col("term") == term) & (F.col("depth") > 0)), "ancestor", "anc"))
        .union(part(closed.filter((F.col("anc") == term) & (F.col("depth") > 0)), "descendant", "term"))
    )


def information(terms: DataFrame, is_a: DataFrame, closed: DataFrame, annotations: DataFrame) -> DataFrame:
    """(id, freq, p, ic): annotations of a term and all below it, as a share of those of the roots."""
    own = annotations.select("node", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    whole = closed.filter("depth > 0").select("term", "anc").union(terms.select(F.col("id").alias("term"), F.col("id").alias("anc")))
    freq = whole.join(own, "term").groupBy(F.col("anc").alias("id")).agg(F.sum("k").alias("freq"))
    every = terms.select("id").join(freq, "id", "left").na.fill(0, ["freq"])
    total = every.join(roots(terms, is_a), "id", "left_semi").agg(F.sum("freq").alias("total"))
    p = F.coalesce(F.try_divide(F.col("freq").cast("double"), "total"), F.lit(0.0))
    return every.crossJoin(total).select("id", "freq", p.alias("p")).withColumn("ic", F.when(F.col("p") > 0, -F.log10("p")).otherwise(0.0))


def common_ancestors(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """pairs (i, j) -> (i, j, anc) over the reflexive closure."""
    x = closed.select(F.col("term").alias("i"), "anc")
    y = closed.select(F.col("term").alias("j"), "anc")
    return pairs.select("i", "j").distinct().join(x, "i").join(y, ["j", "anc"]).select("i", "j", "anc")


def lowest_common_ancestors(pairs: DataFrame, closed: DataFrame, level: DataFrame) -> DataFrame:
    """(i, j, anc): all common ancestors of the largest level."""
    c = common_ancestors(pairs, closed).join(level.select(F.col("id").alias("anc"), "level"), "anc")
    return c.withColumn("r", F.rank().over(Window.partitionBy("i", "j").orderBy(F.desc("level")))).filter("r = 1").select("i", "j", "anc")


def most_informative(pairs: DataFrame, closed: DataFrame, info: DataFrame) -> DataFrame:
    """(i, j, anc, ic, p): the common ancestor of the largest information, the smallest id among equals."""
    c = common_ancestors(pairs, closed).join(info.select(F.col("id").alias("anc"), "ic", "p"), "anc")
    best = c.groupBy("i", "j").agg(F.max(F.struct("ic", (-F.col("anc")).alias("m"), "p")).alias("x"))
    return best.select("i", "j", (-F.col("x.m")).alias("anc"), "x.ic", "x.p")


def term_similarity(pairs: DataFrame, closed: DataFrame, info: DataFrame) -> DataFrame:
    """(i, j, sim): 2 IC(anc) / (IC(i) + IC(j)) (1 - p(anc)) of the most informative ancestor; 0 where undefined."""
    best = most_informative(pairs, closed, info)
    ic = lambda c, n: info.select(F.col("id").alias(c), F.col("ic").alias(n))
    sim = F.coalesce(F.try_divide(2 * F.col("ic"), F.col("ici") + F.col("icj")) * (1 - F.col("p")), F.lit(0.0))
    return best.join(ic("i", "ici"), "i").join(ic("j", "icj"), "j").select("i", "j", sim.alias("sim"))


def term_matrix(annotations: DataFrame, terms: DataFrame, closed: DataFrame, info: DataFrame, zeros: bool = True) -> DataFrame:
    """(i, j, sim), i <= j, over annotated terms: terms are many fewer than nodes, and only pairs with a
    common ancestor are formed. Without `zeros` ancestors of no information, the root above all, form
    none: pairs that share no other have similarity 0 and are left out."""
    used = annotations.select(F.col("term").alias("id")).distinct().join(terms.select("id"), "id", "left_semi")
    up = closed.join(used.select(F.col("id").alias("term")), "term", "left_semi").join(info.filter("ic > 0" if not zeros else "true").select(F.col("id").alias("anc"), "ic", "p"), "anc")
    x = up.select(F.col("term").alias("i"), "anc", "ic", "p")
    y = up.select(F.col("term").alias("j"), "anc")
    best = x.join(y, "anc").filter("i <= j").groupBy("i", "j").agg(F.max(F.struct("ic", (-F.col("anc")).alias("m"), "p")).alias("x"))
    ic = lambda c, n: info.select(F.col("id").alias(c), F.col("ic").alias(n))
    sim = F.coalesce(F.try_divide(2 * F.col("x.ic"), F.col("ici") + F.col("icj")) * (1 - F.col("x.p")), F.lit(0.0))
    return best.join(ic("i", "ici"), "i").join(ic("j", "icj"), "j").select("i", "j", sim.alias("sim"))


def node_similarity(pairs: DataFrame, annotations: DataFrame, matrix: DataFrame) -> DataFrame:
    """pairs (x, y) -> (x, y, score): largest similarity between a term of each; 0 without terms."""
    a = annotations.select("node", "term").distinct()
    both = matrix.union(matrix.filter("i <> j").select("j", "i", "sim"))
    named = pairs.select("x", "y").distinct()
    got = named.join(a.select(F.col("node").alias("x"), F.col("term").alias("i")), "x").join(a.select(F.col("node").alias("y"), F.col("term").alias("j")), "y").join(both, ["i", "j"]).groupBy("x", "y").agg(F.max("sim").alias("score"))
    return named.join(got, ["x", "y"], "left").na.fill(0.0, ["score"])


def term_lookup(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """pairs (i, j) in any order -> (i, j, sim) from a finished matrix; 0 for terms it does not know."""
    both = matrix.union(matrix.filter("i <> j").select("j", "i", "sim"))
    return pairs.select("i", "j").distinct().join(both, ["i", "j"], "left").na.fill(0.0, ["sim"])


def profiles(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, profile) and (profile, term, size): nodes with equal term sets share a profile, named by its
    smallest node, so that pairs of profiles stand for pairs of nodes."""
    sets = annotations.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set("term")), ",").alias("s"))
    named = sets.groupBy("s").agg(F.min("node").alias("profile"), F.count(F.lit(1)).alias("size"))
    who = sets.join(named, "s").select("node", "profile")
    return who, named.select("profile", "size").join(annotations.select(F.col("node").alias("profile"), "term").distinct(), "profile").select("profile", "term", "size")


def profile_similarity(profile_terms: DataFrame, matrix: DataFrame) -> DataFrame:
    """(x, y, score) for all pairs of profiles, both orders, equal ones included."""
    both = matrix.union(matrix.filter("i <> j").select("j", "i", "sim"))
    x = profile_terms.select(F.col("profile").alias("x"), F.col("term").alias("i"))
    y = profile_terms.select(F.col("profile").alias("y"), F.col("term").alias("j"))
    return x.join(both, "i").groupBy("x", "j").agg(F.max("sim").alias("sim")).join(y, "j").groupBy("x", "y").agg(F.max("sim").alias("score"))


def row_sums(who: DataFrame, similarity: DataFrame) -> DataFrame:
    """(node, row_sum): a node's summed similarity to all other annotated nodes."""
    size = who.groupBy("profile").agg(F.count(F.lit(1)).alias("size"))
    per = similarity.join(size.select(F.col("profile").alias("y"), "size"), "y").groupBy(F.col("x").alias("profile")).agg(F.sum(F.col("score") * F.col("size")).alias("s"), F.max(F.when(F.col("x") == F.col("y"), F.col("score"))).alias("own"))
    return who.join(per, "profile").select("node", (F.col("s") - F.coalesce("own", F.lit(0.0))).alias("row_sum"))


def set_score(nodes: DataFrame, annotations: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row: mean similarity over unordered pairs of the annotated nodes of a set; null without pairs."""
    known = nodes.select("node").distinct().join(annotations.select("node").distinct(), "node", "left_semi")
    who, terms = profiles(annotations.join(known, "node", "left_semi"))
    size = who.groupBy("profile").agg(F.count(F.lit(1)).alias("size"))
    sim = profile_similarity(terms, matrix).join(size.select(F.col("profile").alias("x"), F.col("size").alias("sx")), "x").join(size.select(F.col("profile").alias("y"), F.col("size").alias("sy")), "y")
    n = F.when(F.col("x") == F.col("y"), F.col("sx") * (F.col("sx") - 1)).otherwise(F.col("sx") * F.col("sy"))
    k = who.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("pairs"))
    return sim.agg(F.sum(F.col("score") * n).alias("s")).crossJoin(k).select(F.try_divide(F.coalesce("s", F.lit(0.0)), "pairs").alias("score"))


def cluster_scores(clusters: DataFrame, annotations: DataFrame, matrix: DataFrame) -> DataFrame:
    """(cluster, k, inside, outside, score): mean similarity among the k annotated members, mean similarity
    to all other annotated nodes, and their difference; a cluster of at most one such member scores 0.

    Nodes with equal term sets are summed as one, so cost follows distinct term sets, not members.
    """
    who, terms = profiles(annotations)
    sim = stored(profile_similarity(terms, matrix), "profile-similarity")
    rows = row_sums(who, sim)
    member = clusters.select("node", "cluster").join(who, "node")
    size = member.groupBy("cluster", "profile").agg(F.count(F.lit(1)).alias("c"))
    x = size.select("cluster", F.col("profile").alias("x"), F.col("c").alias("cx"))
    y = size.select("cluster", F.col("profile").alias("y"), F.col("c").alias("cy"))
    n = F.when(F.col("x") == F.col("y"), F.col("cx") * (F.col("cx") - 1)).otherwise(F.col("cx") * F.col("cy"))
    inner = x.join(sim, "x").join(y, ["cluster", "y"]).groupBy("cluster").agg(F.sum(F.col("score") * n).alias("s_in"))
    outer = member.join(rows, "node").groupBy("cluster").agg(F.sum("row_sum").alias("s_all"), F.count(F.lit(1)).alias("k"))
    total = who.agg(F.count(F.lit(1)).alias("n"))
    j = clusters.select("cluster").distinct().join(outer, "cluster", "left").join(inner, "cluster", "left").crossJoin(total).na.fill(0, ["k", "s_in", "s_all"])
    many = F.col("k") > 1
    inside = F.when(many, F.try_divide("s_in", F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    outside = F.when(many, F.coalesce(F.try_divide(F.col("s_all") - F.col("s_in"), F.col("k") * (F.col("n") - F.col("k"))), F.lit(0.0))).otherwise(0.0)
    return j.select("cluster", "k", inside.alias("inside"), outside.alias("outside")).withColumn("score", F.col("inside") - F.col("outside"))


def hierarchy_size(terms: DataFrame, is_a: DataFrame) -> DataFrame:
    return terms.agg(F.count(F.lit(1)).alias("n")).crossJoin(is_a.agg(F.count(F.lit(1)).alias("m")))
