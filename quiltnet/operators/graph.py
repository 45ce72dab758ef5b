"""Metrics of one network, and of many overlapping subgraphs of it in one pass.

A network is edges (a, b) with a <= b. A family of subgraphs is a membership table
(node, ctx, present); `masks` packs it into words of 63 contexts, so that one AND per edge or
triangle serves all contexts of a word. Contexts leave the mask only where a result needs them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import correlation
from ..plans.lineage import stored
from .components import connected_components

WORD = 63


# ---------------------------------------------------------------- views


def adjacency(edges: DataFrame) -> DataFrame:
    """(u, v): both directions of every edge, a self-loop once."""
    back = edges.filter("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"))
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(back)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def masks(members: DataFrame) -> DataFrame:
    """(node, word, mask): contexts numbered from 0 as bits, 63 to a word; absent nodes have mask 0."""
    bit = F.when(F.col("present") != 0, F.expr(f"shiftleft(1L, cast(ctx % {WORD} as int))")).otherwise(F.lit(0).cast("long"))
    return members.select("node", F.floor(F.col("ctx") / WORD).cast("long").alias("word"), bit.alias("bit")).groupBy("node", "word").agg(F.bit_or("bit").alias("mask"))


def labelled_edges(edges: DataFrame, packed: DataFrame) -> DataFrame:
    """(a, b, word, mask_a, mask_b, label): label holds the contexts in which both ends are present."""
    left = packed.select(F.col("node").alias("a"), "word", F.col("mask").alias("mask_a"))
    right = packed.select(F.col("node").alias("b"), "word", F.col("mask").alias("mask_b"))
    return edges.join(left, "a").join(right, ["b", "word"]).select("a", "b", "word", "mask_a", "mask_b", F.col("mask_a").bitwiseAND(F.col("mask_b")).alias("label"))


def packed_edges(edges: DataFrame, members: DataFrame, kinds: str = "pm") -> tuple[DataFrame, int]:
    """(a, b, a_p0, a_m0, ..., b_p0, b_m0, ...), and the number of words: edges whose ends are both members, with all words
    of each end's masks, p of the contexts that have it and m of those that measure it (of these, the kinds asked for). An edge stays one row."""
    words = (members.agg(F.max("ctx")).first()[0] or 0) // WORD + 1
    bit = F.expr(f"shiftleft(1L, cast(ctx % {WORD} as int))")
    bits = members.groupBy("node", F.floor(F.col("ctx") / WORD).alias("word"))
    bits = bits.agg(*[F.bit_or(c).alias(k) for k, c in (("p", F.when(F.col("present") != 0, bit).otherwise(F.lit(0).cast("long"))), ("m", bit)) if k in kinds])
    packed = bits.groupBy("node").agg(*[F.coalesce(F.max(F.when(F.col("word") == i, F.col(k))), F.lit(0).cast("long")).alias(f"{k}{i}") for i in range(words) for k in kinds])
    side = lambda end: packed.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in packed.columns[1:]])
    return edges.join(side("a"), "a").join(side("b"), "b"), words


def shared(words: int, kind: str):
    """How many contexts both ends of packed_edges have (p) or measure (m)."""
    one = lambda i: F.bit_count(F.col(f"a_{kind}{i}").bitwiseAND(F.col(f"b_{kind}{i}")))
    return sum((one(i) for i in range(1, words)), one(0)).cast("long")


def contexts_of(mask: str = "label"):
    """The contexts of a mask, as an array expression; needs a column `word`."""
    return F.expr(f"transform(filter(sequence(0, {WORD - 1}), i -> getbit({mask}, i) = 1), i -> word * {WORD} + i)")


def subgraph_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(ctx, a, b): the edges of every subgraph; nodes without edges stay in the universe."""
    lab = labelled_edges(edges, masks(members)).filter("label <> 0")
    return lab.select(F.explode(contexts_of()).alias("ctx"), "a", "b")


def context_edge_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(ctx, m): edges of every subgraph that has any, counted from the masks, without a row per edge and context."""
    both, words = packed_edges(edges, members, "p")
    labels = both.select(*[F.col(f"a_p{i}").bitwiseAND(F.col(f"b_p{i}")).alias(f"w{i}") for i in range(words)])
    named = labels.select(F.posexplode(F.array(*labels.columns)).alias("word", "label")).filter("label <> 0")
    bits = named.groupBy("word").agg(*[F.sum(F.getbit("label", F.lit(i)).cast("long")).alias(f"b{i}") for i in range(WORD)])
    per = bits.select("word", F.posexplode(F.array(*[f"b{i}" for i in range(WORD)])).alias("i", "m"))
    return per.filter("m > 0").select((F.col("word") * WORD + F.col("i")).cast("long").alias("ctx"), "m")


def universe(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): members that are an endpoint of the network."""
    return members.select("node").distinct().join(nodes_of(edges), "node", "left_semi")


# ---------------------------------------------------------------- degrees


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, degree); nodes of a given universe without edges have degree 0."""
    own = adjacency(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    if nodes is None:
        return own
    return nodes.select("node").distinct().join(own, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def context_degrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(ctx, node, degree) where degree > 0."""
    ends = subgraph_edges(edges, members)
    return ends.select("ctx", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("node")).groupBy("ctx", "node").agg(F.count(F.lit(1)).alias("degree"))


def max_context_degrees(edges: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    best = context_degrees(edges, members).groupBy("node").agg(F.max("degree").alias("maxts_degree"))
    return nodes.join(best, "node", "left").select("node", F.coalesce("maxts_degree", F.lit(0)).cast("long").alias("maxts_degree"))


def neighbour_presence(edges: DataFrame, members: DataFrame, nodes: DataFrame, n_contexts: int) -> DataFrame:
    """(node, coexpr_degree, min_neighbor_expr_count, max_neighbor_expr_count).

    Neighbours count that share a context; without any the minimum is the number of contexts and
    the maximum 0.
    """
    both, words = packed_edges(edges, members)
    count = lambda end: sum((F.bit_count(f"{end}_p{i}") for i in range(1, words)), F.bit_count(f"{end}_p0"))
    live = both.filter(shared(words, "p") > 0).select("a", "b", count("a").alias("ca"), count("b").alias("cb"))
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("cb").alias("c")), F.struct(F.col("b").alias("node"), F.col("ca").alias("c")))
    ends = F.when(F.col("a") == F.col("b"), F.slice(ends, 1, 1)).otherwise(ends)
    agg = live.select(F.explode(ends).alias("x")).select("x.*").groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    z = lambda c, d: F.coalesce(c, F.lit(d)).cast("long")
    return nodes.join(agg, "node", "left").select("node", z("k", 0).alias("coexpr_degree"), z("lo", n_contexts).alias("min_neighbor_expr_count"), z("hi", 0).alias("max_neighbor_expr_count"))


# ---------------------------------------------------------------- weights


def coexistence_weights(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, weight): shared contexts over the larger number of contexts, 0 without any."""
    per = labelled_edges(edges, masks(members)).groupBy("a", "b").agg(F.sum(F.bit_count("label")).alias("xy"), F.sum(F.bit_count("mask_a")).alias("x"), F.sum(F.bit_count("mask_b")).alias("y"))
    return per.select("a", "b", F.coalesce(F.try_divide("xy", F.greatest("x", "y")), F.lit(0.0)).alias("weight"))


def correlation_weights(edges: DataFrame, members: DataFrame, n_contexts: int) -> DataFrame:
    """(a, b, weight): 0.5 + 0.5 phi of the two presence vectors; phi is 0 where undefined."""
    per = labelled_edges(edges, masks(members)).groupBy("a", "b").agg(F.sum(F.bit_count("label")).cast("double").alias("xy"), F.sum(F.bit_count("mask_a")).cast("double").alias("x"), F.sum(F.bit_count("mask_b")).cast("double").alias("y"))
    n = F.lit(float(n_contexts))
    below = F.sqrt((n * F.col("x") - F.col("x") * F.col("x")) * (n * F.col("y") - F.col("y") * F.col("y")))
    phi = F.coalesce(F.try_divide(n * F.col("xy") - F.col("x") * F.col("y"), below), F.lit(0.0))
    return per.select("a", "b", (0.5 + 0.5 * phi).alias("weight"))


# ---------------------------------------------------------------- triangles and clustering


#: Edges of a task that lists triangles, about; and the fewest colours of nodes.
TASK_EDGES, COLOURS = 12_000_000, 4


def _colour(node: np.ndarray, colours: int) -> np.ndarray:
    return ((node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % colours


def _packed(x: np.ndarray) -> bytes:
    """Numbers by place of their bytes, compressed: the high bytes of most ids are alike."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, a, b) with nodes as places in names; ids close to each other are looked up, others sorted."""
    low, high = min(a.min(), b.min()), max(a.max(), b.max())
    if int(high) - int(low) < 1 << 26:
        there = np.zeros(int(high - low) + 1, bool)
        there[a - low] = there[b - low] = True
        place = np.cumsum(there, dtype=np.int32) - 1
        return np.flatnonzero(there) + low, place[a - low], place[b - low]
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    return names, ends[: len(a)], ends[len(a) :]


def _listed(a: np.ndarray, b: np.ndarray, wedges: int = 1 << 22):
    """(x, y, z) arrays of the triangles of edges in memory. Edges point from lower to higher (degree, id), so a node has
    at most sqrt(2m) edges out; paths of two of these are looked up, about so many at a time, first in a table of hashes."""
    names, a, b = _numbered(a, b)
    n = len(names)
    order = np.argsort(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    a, b = rank[a], rank[b]
    code = np.sort(np.minimum(a, b) * n + np.maximum(a, b))
    code = code[np.r_[True, code[1:] != code[:-1]]]
    u, v = np.divmod(code, n)
    out = np.bincount(u, minlength=n)
    first = np.cumsum(out) - out
    bits = np.uint64(64 - min(26, max(10, 2 + len(code).bit_length())))
    spot = lambda c: ((c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> bits).astype(np.int64)
    marks = np.zeros(1 << (64 - int(bits)), bool)
    marks[spot(code)] = True
    k = out[v]
    ends = np.cumsum(k)
    lo = 0
    while lo < len(code):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + wedges, side="right")))
        m = k[lo:hi]
        w = v[np.repeat(first[v[lo:hi]] - np.cumsum(m) + m, m) + np.arange(m.sum())]
        third = np.repeat(u[lo:hi] * n, m) + w
        may = np.flatnonzero(marks[spot(third)])
        at = np.minimum(np.searchsorted(code, third[may]), len(code) - 1)
        may = may[code[at] == third[may]]
        edge = lo + np.searchsorted(np.cumsum(m), may, side="right")
        yield tuple(names[order[i]] for i in (u[edge], v[edge], w[may]))
        lo = hi


def _in_bins(plain: DataFrame, m: int) -> DataFrame | None:
    """(bin, a, b): the m edges dealt by connected component; None if one component has most of the nodes."""
    found = connected_components(plain)
    most, every = found.groupBy("root").count().agg(F.max("count"), F.sum("count")).first()
    if 2 * most > every:
        return None
    dealt = plain.join(found.select(F.col("node").alias("a"), "root"), "a", "left")
    return stored(dealt.select(F.pmod(F.xxhash64(F.coalesce("root", "a")), F.lit(math.ceil(8 * m / TASK_EDGES))).alias("bin"), "a", "b"), "edges-by-component")


def triangles(edges: DataFrame, key: str | None = None, fewest: int | None = None) -> DataFrame:
    """(x, y, z), or (key, x, y, z) of several networks in one table: every triangle once.

    Nodes have one of p colours, and a task has the edges between three of them (or two, or one), so an edge is in p tasks, and a triangle
    is listed where its colours are the task's. Edges move packed by the colours of their ends, some bytes each; p grows
    with the root of the largest network, and no list of neighbours moves. A triangle lies in one component, so a network for which
    p exceeds twice COLOURS is dealt by components, and then they are the networks.
    """
    keys = [key] if key else []
    plain = edges.filter(" AND ".join(["a <> b", *(f"{k} IS NOT NULL" for k in keys)])).select(*keys, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    largest = plain.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    p = max(COLOURS if fewest is None else fewest, math.ceil(math.sqrt(6 * largest / TASK_EDGES)))
    if key is None and p > 2 * COLOURS:
        binned = _in_bins(plain, largest)
        if binned is not None:
            return triangles(binned, "bin", 1).drop("bin")
    kind = [f"{key} {dict(plain.dtypes)[key]}"] if key else []
    names = [*keys, "i", "j", "n", "a", "b"]

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 20:
                yield from packed(held)
                held, size = [], 0
        if size:
            yield from packed(held)

    def packed(held):
        table = pa.Table.from_batches(held)
        a, b = table["a"].to_numpy(), table["b"].to_numpy()
        nets = table[key].combine_chunks().dictionary_encode() if key else None
        net = nets.indices.to_numpy(zero_copy_only=False).astype(np.int64) if key else np.zeros(len(a), np.int64)
        i, j = _colour(a, p), _colour(b, p)
        group = (net * p + np.minimum(i, j)) * p + np.maximum(i, j)
        order = np.lexsort((a, group))
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]), len(order)]
        spans = [order[lo:hi] for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        heads = group[[x[0] for x in spans]]
        columns = [pa.array(heads // p % p), pa.array(heads % p), pa.array([len(x) for x in spans], pa.int64()), *(pa.array([_packed(c[x]) for x in spans], pa.binary()) for c in (a, b))]
        if key:
            columns.insert(0, nets.dictionary.take(pa.array(heads // (p * p))))
        yield pa.RecordBatch.from_arrays(columns, names)

    def meet(group: tuple, table: pa.Table) -> pa.Table:
        size = table["n"].to_pylist()
        a, b = (np.concatenate([_unpacked(x, n) for x, n in zip(table[c].to_pylist(), size)]) for c in ("a", "b"))
        own = np.array(group[-1].as_py())
        found = []
        for xyz in _listed(a, b):
            ok = (np.sort(np.stack([_colour(c, p) for c in xyz]), axis=0) == own[:, None]).all(axis=0)
            found.append([c[ok] for c in xyz])
        out = {c: np.concatenate([f[i] for f in found]) for i, c in enumerate("xyz")}
        named = {key: pa.repeat(group[0], len(out["x"]))} if key else {}
        return pa.table(named | out)

    rows = plain.mapInArrow(pack, ", ".join([*kind, "i long, j long, n long, a binary, b binary"]))
    third = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long"))).alias("k")
    rows = rows.select(*names, third).withColumn("colours", F.sort_array(F.array("i", "j", "k")))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), p * (p + 1) * (p + 2) // 6)
    dealt = rows.select(*keys, "colours", "n", "a", "b").repartition(tasks, *keys, "colours")
    return dealt.groupBy(*keys, "colours").applyInArrow(meet, ", ".join([*kind, "x long, y long, z long"]))


def local_clustering(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, cc): closed share of a node's neighbour pairs; 0 below two neighbours."""
    plain = edges.filter("a <> b")
    t = triangles(plain).select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    d = degrees(plain, nodes)
    pairs = F.col("degree") * (F.col("degree") - 1)
    return d.join(t, "node", "left").select("node", F.coalesce(F.try_divide(2.0 * F.coalesce("t", F.lit(0)), pairs), F.lit(0.0)).alias("cc"))


def context_triangles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(ctx, node, t) where t > 0: triangles of the network are listed once, their three masks ANDed, and
    only then counted by context."""
    plain = edges.filter("a <> b")
    packed = masks(members).filter("mask <> 0")
    m = lambda c: packed.select(F.col("node").alias(c), "word", F.col("mask").alias("m" + c))
    tri = triangles(plain).join(m("x"), "x").join(m("y"), ["y", "word"]).join(m("z"), ["z", "word"])
    tri = tri.select("x", "y", "z", "word", F.expr("mx & my & mz").alias("label")).filter("label <> 0")
    return tri.select(F.explode(contexts_of()).alias("ctx"), F.array("x", "y", "z").alias("n")).select("ctx", F.explode("n").alias("node")).groupBy("ctx", "node").agg(F.count(F.lit(1)).alias("t"))


def context_clustering(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(ctx, node, cc) where the node has two neighbours or more."""
    d = context_degrees(edges.filter("a <> b"), members).filter("degree >= 2")
    return d.join(context_triangles(edges, members), ["ctx", "node"], "left").select("ctx", "node", (2.0 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).alias("cc"))


def global_clustering(edges: DataFrame) -> DataFrame:
    """One row: closed wedges over wedges."""
    plain = edges.filter("a <> b")
    w = degrees(plain).agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("w"))
    t = triangles(plain).agg(F.count(F.lit(1)).alias("t"))
    return t.crossJoin(w).select(F.coalesce(F.try_divide(3.0 * F.col("t"), "w"), F.lit(0.0)).alias("gl_cluster_coeff"))


# ---------------------------------------------------------------- whole-network statistics


def degree_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: n, m, min_deg, max_deg, avg_deg."""
    d = degrees(edges, nodes).agg(F.count(F.lit(1)).alias("n"), F.min("degree").alias("min_deg"), F.max("degree").alias("max_deg"), F.avg("degree").alias("avg_deg"))
    return edges.agg(F.count(F.lit(1)).alias("m")).crossJoin(d).select("n", "m", "min_deg", "max_deg", "avg_deg")


def assortativity(edges: DataFrame) -> DataFrame:
    """One row: Newman's r, the correlation of degrees over both directions of every edge; null where all are equal."""
    d = degrees(edges)
    both = adjacency(edges).join(d.select(F.col("node").alias("u"), F.col("degree").alias("x")), "u").join(d.select(F.col("node").alias("v"), F.col("degree").alias("y")), "v")
    return both.agg(correlation("x", "y").alias("deg_assortativity"))


def neighbour_degree(edges: DataFrame) -> DataFrame:
    """(node, knn): mean degree of a node's neighbours."""
    d = degrees(edges)
    return adjacency(edges).join(d.select(F.col("node").alias("v"), "degree"), "v").groupBy(F.col("u").alias("node")).agg(F.avg("degree").alias("knn"))


def internalness(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """One row: share of the subset's neighbours that lie in the subset."""
    near = adjacency(edges).join(subset.select(F.col("node").alias("u")), "u", "left_semi").select(F.col("v").alias("node")).distinct()
    inside = near.join(subset.select("node", F.lit(1).alias("i")).distinct(), "node", "left")
    return inside.agg(F.try_divide(F.count("i").cast("double"), F.count(F.lit(1))).alias("internal"))


def induced(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """Edges with both ends in the subset."""
    s = subset.select("node").distinct()
    return edges.join(s.withColumnRenamed("node", "a"), "a", "left_semi").join(s.withColumnRenamed("node", "b"), "b", "left_semi").select(*edges.columns)


def property_in_sets(edges: DataFrame, first: DataFrame, second: DataFrame, prop, method: str = "global") -> DataFrame:
    """(node, set, value): a node property of two sets, computed on the whole network (`global`), on each
    set's own subgraph (`subgraph`) or on the subgraph of both (`combined_subgraph`)."""
    sets = [(1, first), (2, second)]
    if method == "subgraph":
        parts = [prop(induced(edges, s)).join(s.select("node").distinct(), "node").withColumn("set", F.lit(k)) for k, s in sets]
    elif method in ("global", "combined_subgraph"):
        base = prop(edges if method == "global" else induced(edges, first.select("node").union(second.select("node"))))
        parts = [base.join(s.select("node").distinct(), "node").withColumn("set", F.lit(k)) for k, s in sets]
    else:
        raise ValueError(method)
    return parts[0].unionByName(parts[1])


def simplified(edges: DataFrame) -> DataFrame:
    """(a, b), a < b: each pair of different nodes once, whatever its direction and however often it is given."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def threshold_series(edges: DataFrame, scores: DataFrame, steps: int = 20) -> DataFrame:
    """(step, t, n, m) for t = 0, 1/steps, ..., 1: nodes and edges of the subgraph of network nodes whose score is at
    most t. scores: (node, score), a row per node; nodes without a score are in no subgraph.

    An edge appears with the later of its ends, so edges are counted by that step once and summed over the steps.
    """
    level = F.greatest(F.ceil(F.round(F.col("score") * steps, 9)).cast("long"), F.lit(0))
    s = scores.select("node", level.alias("level")).filter(F.col("score").isNotNull() & (F.col("level") <= steps)).join(nodes_of(edges), "node", "left_semi")
    ends = lambda c: s.select(F.col("node").alias(c), F.col("level").alias(f"_{c}"))
    m = edges.join(ends("a"), "a").join(ends("b"), "b").groupBy(F.greatest("_a", "_b").alias("step")).agg(F.count(F.lit(1)).alias("m"))
    n = s.groupBy(F.col("level").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    at = edges.sparkSession.range(steps + 1).withColumnRenamed("id", "step").join(n, "step", "left").join(m, "step", "left").na.fill(0, ["n", "m"])
    upto = Window.orderBy("step")  # a row per step
    return at.select("step", (F.col("step") / steps).alias("t"), F.sum("n").over(upto).alias("n"), F.sum("m").over(upto).alias("m"))


# ---------------------------------------------------------------- partitions of the nodes


def modularity_per_cluster(edges: DataFrame, clusters: DataFrame, weight: str | None = None) -> DataFrame:
    """(cluster, modularity): w_in / W - (vol / 2W)^2; a self-loop counts twice in the volume.

    Raises where the total weight is 0.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    e = edges.select("a", "b", w.alias("w"))
    ca, cb = clusters.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), clusters.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    e = e.join(ca, "a").join(cb, "b")
    total = e.agg(F.sum("w").alias("W")).select(F.when(F.coalesce("W", F.lit(0.0)) > 0, F.col("W")).otherwise(F.raise_error(F.lit("modularity needs edges"))).alias("W"))
    ends = e.select(F.explode(F.array(F.struct(F.col("ca").alias("cluster"), F.col("w").alias("vol"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inside")), F.struct(F.col("cb").alias("cluster"), F.col("w").alias("vol"), F.lit(0.0).alias("inside")))).alias("x")).select("x.*")
    per = ends.groupBy("cluster").agg(F.sum("vol").alias("vol"), F.sum("inside").alias("inside"))
    every = clusters.select("cluster").distinct().join(per, "cluster", "left").na.fill(0.0, ["vol", "inside"])
    return every.crossJoin(total).select("cluster", (F.col("inside") / F.col("W") - F.pow(F.col("vol") / (2 * F.col("W")), F.lit(2))).alias("modularity"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def size_histogram(clusters: DataFrame, bins: int | None = None) -> DataFrame:
    """(size, count), or with `bins` (bin, count) of equal width rounded up."""
    sizes = cluster_sizes(clusters)
    if bins is None:
        return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("count"))
    width = sizes.agg(F.ceil(F.max("size") / bins).alias("width"))
    return sizes.crossJoin(width).groupBy(F.floor((F.col("size") - 1) / F.col("width")).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def weighted_sizes(clusters: DataFrame) -> DataFrame:
    """One row: mean cluster size of a node, and the size at which half the nodes are reached."""
    sizes = cluster_sizes(clusters).groupBy("size").agg(F.count(F.lit(1)).alias("k"))
    mean = sizes.agg(F.try_divide(F.sum(F.col("size") * F.col("size") * F.col("k")).cast("double"), F.sum(F.col("size") * F.col("k"))).alias("weighted_mean"))
    run = sizes.withColumn("upto", F.sum(F.col("size") * F.col("k")).over(Window.orderBy("size"))).withColumn("all", F.sum(F.col("size") * F.col("k")).over(Window.partitionBy()))
    half = run.filter(F.col("upto") >= F.col("all") / 2).agg(F.min("size").alias("weighted_median"))
    return mean.crossJoin(half)
