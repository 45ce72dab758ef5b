"""Mixing sources to target weights by the cube method (Deville and Tille's balanced sampling).

Every source gets a target number of words from its weight. A document of that source is then
taken floor(rate) times for certain and once more with probability rate - floor(rate), where
rate = target / size of the source. The flight phase moves these fractional probabilities, three
documents at a time, along the null space of the two constraints (words and documents), so both
totals stay exactly as they were; each step settles at least one document. It runs in parallel on
chunks of a source. A chunk leaves at most two documents open; these go through further levels of
the same flight, a thousandfold fewer at each, until one chunk per source is left. The last two
documents of a source are landed with the joint probabilities that vary their total least.

Defined cases: null text has size 0; sources sort by code point, null last; a source whose size is
0 has target 0; a row without an id is a document like any other; repeated rows are documents of their
own; texts of any length are counted whole; other columns, whatever their names, are kept by the mix and
not read otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MB, SPACES, batches, read, row_key, stored, unused, utf8, word_bounds

WEIGHTS = (1, 2, 3)
CAP = 3
CHUNK = 2000
#: Equal rows that go to one task at most before the flight deals them to chunks.
BLOCK = 1000
EPS = 1e-9


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_rows, source_size, target, rate): one row per source, by water filling.

    With sources in ascending order of cap * size / weight, a source is capped as long as its share
    of what is left would exceed the cap; all later ones share the rest by weight. The windows see
    one row per source, never documents.
    """
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    k = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (k + 1).cast("int")).cast("double"))
    per = per.withColumn("most", F.col("source_size").cast("double") * cap)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("left_size", F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    per = per.withColumn("left_w", F.sum("w").over(Window.partitionBy()) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    over = (F.col("most") * F.col("left_w") <= F.col("left_size") * F.col("w")).cast("int")
    per = per.withColumn("over", over).withColumn("nth", F.row_number().over(order))
    per = per.withColumn("capped", F.min("over").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per = per.withColumn("first_free", F.sum("capped").over(Window.partitionBy()) + 1)
    level = F.when(F.col("nth") == F.col("first_free"), F.col("left_size") / F.col("left_w"))
    per = per.withColumn("level", F.max(level).over(Window.partitionBy()))
    target = F.when(F.col("capped") == 1, F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * F.col("level")))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return per.select("source", "source_rows", "source_size", "target", rate.alias("rate"))


def flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move p to 0 or 1, keeping sum(p) and sum(p * sizes); at most two entries stay open unless land."""
    p = [float(x) for x in p]
    todo = [i for i, x in enumerate(p) if EPS < x < 1 - EPS]
    for i, x in enumerate(p):
        if x <= EPS or x >= 1 - EPS:
            p[i] = float(round(x))
    draws = iter(rng.random(len(todo) + 1).tolist())
    open_, at = [], 0
    while True:
        while len(open_) < 3 and at < len(todo):
            open_.append(todo[at])
            at += 1
        if len(open_) < 3:
            if len(open_) == 2 and sizes[open_[0]] == sizes[open_[1]]:
                u = (1.0, -1.0)  # equal sizes: one more step keeps both totals
            else:
                break
        else:
            a, b, c = (float(sizes[i]) for i in open_)
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        up = min((((1 - p[i]) / x) if x > 0 else (p[i] / -x)) for i, x in zip(open_, u) if x)
        down = min(((p[i] / x) if x > 0 else ((1 - p[i]) / -x)) for i, x in zip(open_, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        still = []
        for i, x in zip(open_, u):
            p[i] += step * x
            if p[i] <= EPS or p[i] >= 1 - EPS:
                p[i] = float(round(p[i]))
            else:
                still.append(i)
        open_ = still
    if land and open_:
        r = rng.random()
        if len(open_) == 1:
            p[open_[0]] = float(r < p[open_[0]])
        else:
            i, j = open_
            both = max(0.0, p[i] + p[j] - 1)
            only_i, only_j = p[i] - both, p[j] - both
            p[i], p[j] = (1.0, 1.0) if r < both else (1.0, 0.0) if r < both + only_i else (0.0, 1.0) if r < both + only_i + only_j else (0.0, 0.0)
    return np.array(p)


_STATE = "tag long, doc_id long, size long, source_rank int, whole long, p double, ordinal long"


def _level(rows: DataFrame, chunks, land: bool, seed: int, level: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        order = table.sort_by([("ordinal", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("tag", "ascending")])
        rank, chunk = order["source_rank"][0].as_py(), order["chunk"][0].as_py()
        rng = np.random.default_rng([seed, level, rank, chunk])
        p = flight(order["size"].to_numpy(), order["p"].to_numpy(), rng, land)
        at = order.schema.get_field_index("p")
        return order.set_column(at, "p", pa.array(p)).drop_columns(["chunk"])

    keyed = rows.withColumn("chunk", chunks)
    return keyed.groupBy("source_rank", "chunk").applyInArrow(run, _STATE)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tag, size): ids, the text's key and its number of words, counted over the bytes of a batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, MB):
            raw, offsets = utf8(b.column(3))
            _, _, row = word_bounds(raw, offsets, ~SPACES)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.bincount(row, minlength=b.num_rows), pa.int64())], ["doc_id", "source", "tag", "size"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row_key().alias("tag"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cols.mapInArrow(run, "doc_id long, source string, tag long, size long")


def numbered(base: DataFrame) -> DataFrame:
    """The rows of base with nth: 0, 1, ... among equal rows.

    Equal rows are counted, dealt out in runs of BLOCK and only then written out, so that no task
    gets all rows of a text that has many copies.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))
    counted = base.groupBy("doc_id", "source", "tag", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.explode(blocks))
    dealt = counted.repartition("doc_id", "tag", "block")
    nth = F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.col("n")) - 1)
    return dealt.withColumn("nth", F.explode(nth)).drop("n", "block")


def cube_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 20) -> DataFrame:
    """Per row of docs: doc_id, source, tag (its text's key), size, source_size, target, taken and copies.

    Only ids, sizes and probabilities go through the flight, never texts.
    """
    base = stored(sizes(docs), "mix-sizes", few=True)
    per = source_targets(base, weights, cap)
    per = per.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = stored(per, "mix-targets")
    most = per.agg(F.max("source_rows")).first()[0] or 0
    joined = numbered(base).alias("d").join(per.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    ordinal = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("tag"), F.col("nth"))
    whole = F.floor(F.col("rate") + EPS)
    state = joined.select(
        "tag", "doc_id", "size", "source_rank", whole.cast("long").alias("whole"),
        F.greatest(F.lit(0.0), F.col("rate") - whole).alias("p"), ordinal.alias("ordinal"), F.ceil(F.col("source_rows") / CHUNK).alias("n_chunks"),
    )
    chunks = F.pmod(F.shiftright("ordinal", 7), F.col("n_chunks")).cast("long")
    settled, level, left = [], 0, most
    now = _level(state.withColumn("chunk", chunks).drop("n_chunks"), F.col("chunk"), most <= CHUNK, seed, level)
    while True:
        now = stored(now, f"mix-level{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(now.filter(~open_))
        # a chunk leaves two at most; the number of levels follows from the largest source alone
        if level and left <= CHUNK or not level and most <= CHUNK:
            break
        left = 2 * math.ceil(left / CHUNK)
        level += 1
        n = max(1, math.ceil(left / CHUNK))
        now = _level(now.filter(open_), F.pmod(F.xxhash64("ordinal", F.lit(level)), F.lit(n)).cast("long"), left <= CHUNK, seed, level)
    done = settled[0]
    for x in settled[1:]:
        done = done.unionByName(x)
    copies = F.col("whole") + F.col("p").cast("long")
    return done.alias("d").join(per.alias("s"), "source_rank").select("doc_id", "source", "tag", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def cube_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 20) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted) and copies."""
    return cube_rows(docs, weights, cap, seed).drop("tag", "source")


def _share_picks(rows: DataFrame, key: list[str], cols: list[str], n: str, m: str) -> DataFrame:
    """rows that share doc_id, text and source, and so n copies among m of them, with the copies of each.

    Their copies differ by one at most. Rows with equal columns are counted as one; the others of a key
    are put in the order of their hashes, and the first ones get one copy more. Sums over a key run in
    256 parts, and copies are written out in runs of BLOCK, so that no task gets all rows of a key.
    """
    h, part, c, row, before, inside, block = unused(rows, "hash", "part", "count", "row", "before", "inside", "block")
    plain = [f.name for f in rows.select(*cols).schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    per = rows.withColumn(h, F.xxhash64(*[F.col(f"`{x}`") for x in plain])).groupBy(*key, h).agg(F.any_value(F.struct(*[F.col(f"`{x}`") for x in cols])).alias(row), F.count(F.lit(1)).alias(c), F.first(n).alias(n), F.first(m).alias(m))
    per = stored(per.withColumn(part, F.pmod(h, F.lit(256))), "mix-equal-rows")
    sums = per.groupBy(*key, part).agg(F.sum(c).alias(inside))
    upto = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(inside).over(upto.partitionBy(*key).orderBy(part)), F.lit(0))).drop(inside)  # 256 rows a key
    other = unused(per, *[f"{x}_of" for x in (*key, part)])
    sums = sums.select(*[F.col(x).alias(y) for x, y in zip((*key, part), other)], before)
    on = reduce(and_, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip((*key, part), other)])
    per = per.join(sums, on).drop(*other)
    ahead = F.col(before) + F.coalesce(F.sum(c).over(upto.partitionBy(*key, part).orderBy(h)), F.lit(0))
    each = F.expr(f"`{n}` div `{m}`")
    more = F.greatest(F.lit(0), F.least(F.col(c), F.col(n) - F.col(m) * each - ahead))
    per = per.withColumn(n, F.col(c) * each + more).filter(F.col(n) > 0).withColumn(block, F.explode(F.expr(f"sequence(0L, (`{n}` - 1) div {BLOCK})")))
    dealt = per.repartition(*key, h, block)
    return dealt.select(row, F.explode(F.expr(f"sequence(`{block}` * {BLOCK}, least((`{block}` + 1) * {BLOCK}, `{n}`) - 1)"))).select(f"{row}.*")


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = 20) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with all its columns. Rows that share doc_id, text and
    source but differ elsewhere are told apart by their other columns, so that reruns agree."""
    i, k, n, m, j, t = unused(docs, "id", "key", "copies", "rows", "other_id", "other_key")
    # one number for text and source keeps picks narrow; they grow with docs, so both sides are shuffled at every size
    whole = lambda tag, source: F.xxhash64(tag, source)
    picks = cube_rows(docs, weights, cap, seed).groupBy(F.col("doc_id").alias(j), whole("tag", "source").alias(t)).agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(m))
    picks = stored(picks.filter(F.col(n) > 0), "mix-picks")
    tagged = docs.select("*", F.col("doc_id").cast("long").alias(i), whole(row_key(), F.col("source").cast("string")).alias(k))

    def joined(some: DataFrame) -> DataFrame:
        return tagged.join(some.hint("merge"), tagged[i].eqNullSafe(some[j]) & (tagged[k] == some[t]))

    single = joined(picks.filter(F.col(m) == 1))
    out = single.withColumn(m, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[tagged[c] for c in docs.columns])
    if picks.filter(F.col(m) > 1).isEmpty():
        return out
    return out.union(_share_picks(joined(picks.filter(F.col(m) > 1)).drop(j, t), [i, k], docs.columns, n, m))


def op10_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix(read(spark, sf_dir, "documents"))
