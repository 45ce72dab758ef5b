"""URL filters: explicit rules, then trust and distrust propagated over the host link graph.

Hosts, without user and port, are nodes; a page's absolute links add weight to the edge from its host to theirs. Three
stationary vectors come from the same power iteration, all in Spark: trust (personalised PageRank
from hosts with pages that rules allow, along links), distrust (from hosts with pages that rules
block, against links) and a base (from all pages, along links). A host is blocked when its distrust
mass is over `threshold` times its base mass and over its trust mass.

The edge table is summed map-side before its shuffle, and one iteration joins and sums hosts only.
Every `step` iterations the scores are written to the shared folder, and iteration stops once no
host moved by more than `tolerance`; if that has not happened after `rounds` times `step`, it fails.

Defined cases: a null url or one without `://` has an empty host and path and no rule; the empty
host is no node and such pages are allowed; repeated rows count as pages of their own; null html
has no links; links to the own host are no edges; of rules of one length the later in order of text
wins; urls and pages of any length are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

#: (verdict, host and path)
RULES: tuple[tuple[str, str], ...] = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING = 0.85
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without `://`."""
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def node_of(host: Column) -> Column:
    """The host as a node of the link graph: without user and port, on pages and in links alike."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits, else nulls. Rules are a short literal list."""
    if len(rules) > 1000:
        raise ValueError("rules are evaluated in line: at most 1000")
    verdict, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        verdict, text = F.when(fits, F.lit(v)).otherwise(verdict), F.when(fits, F.lit(rule)).otherwise(text)
    return verdict, text


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): absolute links from one host to another, summed."""
    links = pages.select(node_of(F.col("host")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), F.lit(1))).alias("raw"))
    dst = node_of(F.translate("raw", UPPER, LOWER))
    edges = links.select("src", dst.alias("dst")).filter((F.col("src") != F.col("dst")) & (F.col("dst") != "") & (F.col("src") != ""))
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def propagate(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, step: int = 5, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """nodes (host, seed_trust, seed_distrust, seed_base: each summing to 1 or 0) with trust, distrust, base.

    What a host without links in the walk's direction would pass on returns to itself, so totals
    stay put and no global sum is needed inside an iteration.
    """
    ahead = edges.groupBy("src").agg(F.sum("w").alias("out"))
    back = edges.groupBy("dst").agg(F.sum("w").alias("in"))
    e = edges.join(ahead, "src").join(back, "dst").select("src", "dst", (F.col("w") / F.col("out")).alias("f"), (F.col("w") / F.col("in")).alias("b"))
    e = stored(e, "host-edges")
    has = e.select(F.col("src").alias("host"), F.lit(1).alias("fo"), F.lit(0).alias("bo")).union(e.select("dst", F.lit(0), F.lit(1)))
    has = has.groupBy("host").agg(F.max("fo").alias("fo"), F.max("bo").alias("bo"))
    now = nodes.join(has, "host", "left").na.fill(0, ["fo", "bo"])
    now = stored(now.withColumns({"trust": F.col("seed_trust"), "distrust": F.col("seed_distrust"), "base": F.col("seed_base")}), "host-scores")
    if e.isEmpty():  # nothing to pass on: the seeds are the fixed point
        return now
    keep = ["host", "seed_trust", "seed_distrust", "seed_base", "fo", "bo"]
    for _ in range(rounds):
        old = now
        for _ in range(step):
            fwd = e.join(now.select(F.col("host").alias("src"), "trust", "base"), "src").select(F.col("dst").alias("host"), (F.col("f") * F.col("trust")).alias("t"), F.lit(0.0).alias("d"), (F.col("f") * F.col("base")).alias("r"))
            rev = e.join(now.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("b") * F.col("distrust")).alias("d"), F.lit(0.0).alias("r"))
            got = fwd.union(rev).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"), F.sum("r").alias("r"))
            own = lambda s, flag: F.when(F.col(flag) == 0, F.col(s)).otherwise(0.0)
            move = lambda s, g, flag: (1 - damping) * F.col("seed_" + s) + damping * (F.coalesce(F.col(g), F.lit(0.0)) + own(s, flag))
            now = now.join(got, "host", "left").select(*keep, move("trust", "t", "fo").alias("trust"), move("distrust", "d", "bo").alias("distrust"), move("base", "r", "fo").alias("base"))
        now = stored(now, "host-scores")
        gap = F.greatest(*[F.abs(F.col("n." + c) - F.col("o." + c)) for c in ("trust", "distrust", "base")])
        if (now.alias("n").join(old.alias("o"), "host").agg(F.max(gap)).first()[0] or 0.0) < tolerance:
            return now
    raise RuntimeError(f"host scores still move by more than {tolerance} after {rounds * step} steps")


def url_filter(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the host's trust, distrust and base mass."""
    host, path = url_parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    verdict, rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = cut.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), node_of(F.col("host")).alias("node"))
    mark = lambda v: F.sum(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    edges = stored(host_edges(cut), "host-links")
    seeds = judged.filter(F.col("node") != "").groupBy(F.col("node").alias("host")).agg(mark("allow").alias("good"), mark("block").alias("bad"), F.count(F.lit(1)).cast("double").alias("n"))
    linked = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    seeds = stored(seeds.join(linked, "host", "full").na.fill(0.0, ["good", "bad", "n"]), "host-seeds")
    good, bad, n = (x or 0.0 for x in seeds.agg(F.sum("good"), F.sum("bad"), F.sum("n")).first())
    share = lambda c, total: (F.col(c) / total if total else F.lit(0.0))
    nodes = seeds.select("host", share("good", good).alias("seed_trust"), share("bad", bad).alias("seed_distrust"), share("n", n).alias("seed_base"))
    scores = propagate(nodes, edges, damping).select(F.col("host").alias("node"), (F.col("trust") * good).alias("trust"), (F.col("distrust") * bad).alias("distrust"), (F.col("base") * n).alias("base"))
    out = judged.join(scores, "node", "left").na.fill(0.0, ["trust", "distrust", "base"])
    blocked = (F.col("distrust") > threshold * F.col("base")) & (F.col("distrust") > F.col("trust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.col("by_rule"), F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust", "base")


def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))
