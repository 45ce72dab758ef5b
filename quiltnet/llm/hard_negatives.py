"""Hard-negative mining with a vector-approximation file.

The file holds every vector twice: as a cell of 16 in each dimension, two dimensions to a byte, and as
exact integers. Cells are cut at normal quantiles around each dimension's mean over all rows; their
outer edges are its least and largest value. For an anchor and a pair of dimensions, a table of 256
entries gives the most and the least that a vector with these cells can add to the score, so 32 lookups
bound the score of a vector of 64 dimensions. Bounds are sums of integers, without rounding.

Two passes run over the file, in blocks of a few thousand vectors. The first looks for an anchor's
positives: a vector is scored exactly only if its upper bound reaches the worst positive so far. Positives
give score windows; in the second pass a vector is scored only if its bounds meet a window above the
worst negative that the window has so far. Every row meets every anchor as cells; nothing is capped.

Blocks of rows are made in place, without a shuffle. Anchors are dealt to blocks of about 2,000 by a hash
of their place in the files, and each block of anchors meets each block of rows; Spark broadcasts the
anchors where their blocks are small enough and otherwise sends pairs of files to tasks. A task
returns its best few rows of each anchor. The work is anchors x rows by nature, split over both.

Defined cases: rows whose label or vector is null, or that have a null or non-finite component, take no
part; shorter vectors count as 0 where they have no component; components whose scores would not fit a
long raise an error; a row without an id is no anchor and comes last among ties; repeated rows and ids are
rows of their own (another copy of an anchor is a possible positive); an anchor without positives or
negatives returns nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .centroids import scaled, whole_vectors
from .common import NULL_ID, read, stored, with_row

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: Windows in hundredths of the positive's score.
LEAST, MOST = 50, 95
#: Largest scaled component; a hundred times a product of two still fits a long at 512 dimensions.
LIMIT = 1 << 23
CELLS = 16
ANCHORS, ROWS, TILE = 2048, 4096, 64
BLOCK_BYTES = 2 << 20
_KEYS = ("row", "vec_id", "known", "label")
_TYPES = (np.int64, np.int64, np.int8, np.int64)


def integer_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, known, label, v): rows that take part, with integers of any length in v."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, flat, n = whole_vectors(b.column(4), None)
            v, at = scaled(flat, scale, LIMIT).astype(np.int32), np.r_[0, np.cumsum(n)]
            cols = [b.column(i).take(pa.array(rows)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())], [*_KEYS, "v"])

    i, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    own = F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    src = with_row(vectors.select("vec_id", "label", "embedding")).filter(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    cols = src.select("row", F.coalesce(i, F.lit(NULL_ID)).alias("vec_id"), i.isNotNull().cast("byte").alias("known"), own.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return cols.mapInArrow(run, "row long, vec_id long, known byte, label long, v binary")


def _padded(column: pa.Array, width: int) -> np.ndarray:
    blobs = column.to_pylist()
    x = np.zeros((len(blobs), width), np.int64)
    for i, v in enumerate(blobs):
        v = np.frombuffer(v, np.int32)
        x[i, : len(v)] = v
    return x


def cell_edges(rows: DataFrame) -> np.ndarray:
    """(dimensions, CELLS + 1): cell c of a dimension holds the integers from edge c up to the next one. Dimensions
    are even in number, as two share a byte; their moments are summed over all rows."""
    width = int(rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 4
    width += width % 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, s, q, n = np.full(width, LIMIT), np.full(width, -LIMIT), np.zeros(width), np.zeros(width), 0
        for b in it:
            x = _padded(b.column(0), width)
            if len(x):
                low, high, n = np.minimum(low, x.min(0)), np.maximum(high, x.max(0)), n + len(x)
                s, q = s + x.sum(0), q + (x.astype(float) ** 2).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(low), pa.array(high), pa.array(s), pa.array(q), pa.array(np.full(width, n))], ["dim", "low", "high", "s", "q", "n"])

    per = rows.select("v").mapInArrow(run, "dim long, low long, high long, s double, q double, n long")
    got = per.groupBy("dim").agg(F.min("low"), F.max("high"), F.sum("s"), F.sum("q"), F.sum("n")).orderBy("dim").collect()  # a row per dimension
    edges = np.zeros((width, CELLS + 1), np.int64)
    z = np.array([NormalDist().inv_cdf(c / CELLS) for c in range(1, CELLS)])
    for d, low, high, s, q, n in got:
        mean = s / n
        inner = np.ceil(mean + z * max(q / n - mean * mean, 0.0) ** 0.5).astype(np.int64)
        edges[d] = np.r_[low, np.clip(inner, low, high + 1), high + 1]
    return edges


def cells(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(pairs of dimensions, vectors): the approximations."""
    code = np.empty(x.shape[::-1], np.uint8)
    for d in range(x.shape[1]):
        code[d] = np.searchsorted(edges[d, 1:-1], x[:, d], side="right")
    return code[0::2] + CELLS * code[1::2]


def tables(q: np.ndarray, edges: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of dimensions, 256, anchors), twice: the most and the least that a byte of cells adds to a score."""
    ends = np.stack([edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])])[..., None] * q.T[None, :, None, :]
    out = []
    for x in (ends.max(0).astype(dtype), ends.min(0).astype(dtype)):
        both = x[0::2, None, :, :] + x[1::2, :, None, :]  # the second dimension is the high half of the byte
        out.append(both.reshape(len(both), CELLS * CELLS, -1))
    return out[0], out[1]


def bounds(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(vectors, anchors): a table looked up for every vector and summed."""
    total = np.zeros((code.shape[1], table.shape[2]), table.dtype)
    part = np.empty_like(total)
    for t, c in zip(table, code):
        total += np.take(t, c, axis=0, out=part, mode="clip")
    return total


class _Block:
    """Vectors of one block: keys as arrays, integers as a matrix."""

    def __init__(self, blob: dict, width: int):
        for name, kind in zip(_KEYS, _TYPES):
            setattr(self, name, np.frombuffer(blob[name], kind))
        self.x = np.frombuffer(blob["v"], np.int32).reshape(-1, width)
        self.n = len(self.row)


_BLOB = "block long, " + ", ".join(f"{k} binary" for k in (*_KEYS, "v", "cells", "low", "high"))


def _blob(block: int, b: pa.RecordBatch | pa.Table, edges: np.ndarray, coded: bool) -> pa.RecordBatch:
    x = _padded(b.column("v").combine_chunks() if isinstance(b, pa.Table) else b.column("v"), len(edges))
    keys = [b.column(k).to_numpy().astype(t).tobytes() for k, t in zip(_KEYS, _TYPES)]
    windows = [np.array(b.column(k).to_pylist(), np.int64).tobytes() if k in b.schema.names else None for k in ("low", "high")]
    values = [block, *keys, x.astype(np.int32).tobytes(), cells(x, edges).tobytes() if coded else None, *windows]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([v], pa.binary()) for v in values[1:])], ["block", *_KEYS, "v", "cells", "low", "high"])


def approximation_file(rows: DataFrame, edges: np.ndarray) -> DataFrame:
    """Blocks of rows, each a row of binaries: keys, integers and cells."""
    most = max(64, min(ROWS, BLOCK_BYTES // (4 * max(1, len(edges)))))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in it:
            for at in range(0, b.num_rows, most):
                yield _blob(k, b.slice(at, most), edges, True)
                k += 1

    return rows.mapInArrow(run, _BLOB)


def anchor_blocks(anchors: DataFrame, edges: np.ndarray) -> DataFrame:
    """Blocks of anchors, dealt by hash: about ANCHORS each, fewer if they are wide."""
    most = max(64, min(ANCHORS, BLOCK_BYTES // (4 * max(1, len(edges)))))
    n = -(-anchors.count() // most) or 1
    keyed = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)))
    return keyed.groupBy("block").applyInArrow(lambda key, t: pa.Table.from_batches([_blob(key[0].as_py(), t, edges, False)]), _BLOB)


def _firsts(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, known: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` of each group: higher scores, then smaller ids, null last."""
    order = np.lexsort((1 - known, vec_id, -score, group))
    g = group[order]
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, bool)
    at = np.arange(len(g))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < most]


class _Best:
    """The best rows so far of each slot of a block of anchors; a slot's floor is its worst row's score once it is full."""

    def __init__(self, slots: int, most: int):
        self.most, self.floor = most, np.full(slots, np.iinfo(np.int64).min)
        self.slot, self.score, self.vec_id, self.known = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, slot, score, vec_id, known) -> None:
        if not len(slot):
            return
        four = [np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.vec_id, vec_id), (self.known, known))]
        keep = _firsts(*four, self.most)
        self.slot, self.score, self.vec_id, self.known = (a[keep] for a in four)
        full, n = np.unique(self.slot, return_counts=True)
        last = np.cumsum(n) - 1
        some = n == self.most
        self.floor[full[some]] = self.score[last[some]]


def _search(file: DataFrame, anchors: DataFrame, edges: np.ndarray, slots: int, most: int) -> DataFrame:
    """(row, slot, score, vec_id, known, scored) of each task's best rows. Without windows the one slot of an anchor
    takes rows of its label but itself; with them each slot takes rows of other labels whose score is in its window."""
    width = len(edges)
    top = int(np.abs(edges).max()) if edges.size else 0
    if top * top * width >= 1 << 56:
        raise ValueError("scores would not fit a long")
    narrow, exact_float = top * top * width < 1 << 31, top * top * width < 1 << 53
    dtype, windows = np.int32 if narrow else np.int64, slots > 1
    info = np.iinfo(dtype)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        names: dict[int, np.ndarray] = {}
        scored: dict[int, int] = {}
        last = [None, None, None, None]
        for b in it:
            for i in range(b.num_rows):
                one = {k: b.column(k)[i].as_buffer() if pa.types.is_binary(b.schema.field(k).type) else b.column(k)[i].as_py() for k in b.schema.names if b.column(k)[i].is_valid}
                left = {k[2:]: v for k, v in one.items() if k.startswith("a_")}
                right = {k[2:]: v for k, v in one.items() if k.startswith("r_")}
                if last[0] != left["block"]:
                    last[0], last[1] = left["block"], _Block(left, width)
                q = last[1]
                r = _Block(right, width)
                code = np.frombuffer(right["cells"], np.uint8).reshape(width // 2, r.n)
                xs, qs = (a.astype(float if exact_float else np.int64) for a in (r.x, q.x))
                if left["block"] not in best:
                    best[left["block"]], names[left["block"]], scored[left["block"]] = _Best(q.n * slots, most), q.row, 0
                own = best[left["block"]]
                low, high = (np.frombuffer(left[k], np.int64).reshape(q.n, slots) for k in ("low", "high")) if windows else (None, None)
                for at in range(0, q.n, TILE):
                    t = slice(at, min(q.n, at + TILE))
                    upper_table, lower_table = tables(q.x[t].astype(np.int64), edges, dtype)
                    upper = bounds(upper_table, code)
                    same = r.label[:, None] == q.label[None, t]
                    floor = own.floor.reshape(q.n, slots)[t]
                    fit = lambda v: np.clip(v, info.min, info.max).astype(dtype)
                    if windows:
                        lower, maybe = bounds(lower_table, code), np.zeros(same.shape, bool)
                        for s in range(slots):
                            maybe |= (upper >= fit(np.maximum(low[t, s], floor[:, s]))) & (lower <= fit(high[t, s])) & (low[t, s] <= high[t, s])
                        maybe &= ~same
                    else:
                        maybe = same & (upper >= fit(floor[:, 0])) & (r.row[:, None] != q.row[None, t])
                    v, a = np.nonzero(maybe)
                    a += at
                    score = np.concatenate([np.einsum("ij,ij->i", xs[v[k : k + 65536]], qs[a[k : k + 65536]]) for k in range(0, len(v), 65536)] or [np.zeros(0)]).astype(np.int64)
                    scored[left["block"]] += len(v)
                    for s in range(slots):
                        ok = score >= own.floor[a * slots + s]
                        if windows:
                            ok &= (score >= low[a, s]) & (score <= high[a, s])
                        own.add(a[ok] * slots + s, score[ok], r.vec_id[v[ok]], r.known[v[ok]].astype(np.int64))
        for k, o in best.items():
            n = len(o.slot)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[k][o.slot // slots]), pa.array(o.slot % slots), pa.array(o.score), pa.array(o.vec_id), pa.array(o.known.astype(np.int8)), pa.array(np.full(n, scored[k]))],
                ["row", "slot", "score", "vec_id", "known", "scored"],
            )

    named = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    # the stated queries against all rows, block by block: a row of this join is a pair of blocks
    pairs = named(anchors, "a_").crossJoin(named(file.drop("low", "high"), "r_"))
    return pairs.mapInArrow(run, "row long, slot long, score long, vec_id long, known byte, scored long")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each anchor's slot over all tasks; a task sends `most` of each at most."""
    w = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "vec_id", F.desc("known"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """Per anchor and positive, its first negatives: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Anchors are the rows whose vec_id `every` divides."""
    rows = stored(integer_rows(vectors, scale), "negatives-rows")
    edges = cell_edges(rows)
    file = stored(approximation_file(rows, edges), "negatives-file")
    anchors = rows.filter((F.col("known") == 1) & (F.col("vec_id") % every == 0))
    pos = _ranked(_search(file, stored(anchor_blocks(anchors, edges), "negatives-anchors"), edges, 1, positives), positives)
    pos = stored(pos.select("row", (F.col("rank") - 1).alias("slot"), "score", "vec_id", "known"), "negatives-positives")
    p = F.col("score")
    # integers: least * p <= 100 * n <= most * p
    low = F.expr(f"-((-{least} * score - pmod(-{least} * score, 100)) div 100)")
    high = F.expr(f"({most} * score - pmod({most} * score, 100)) div 100")
    per = pos.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(low.alias("low"), high.alias("high"))))).alias("w"))  # `positives` of a row
    slot = lambda side, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda s: F.coalesce(F.try_element_at("w", s)[side], F.lit(none).cast("long")))
    windows = anchors.join(per, "row").withColumns({"low": slot("low", 1), "high": slot("high", 0)}).drop("w")
    neg = _ranked(_search(file, stored(anchor_blocks(windows, edges), "negatives-windows"), edges, positives, negatives), negatives)
    one = lambda i, k, name: F.when(F.col(k) == 1, F.col(i)).alias(name)
    neg = neg.select("row", "slot", "rank", one("vec_id", "known", "negative_id"), F.col("score").alias("negative_score"))
    pos = pos.select("row", "slot", one("vec_id", "known", "positive_id"), p.alias("positive_score"))
    out = neg.join(pos, ["row", "slot"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % {EVERY} = 0 AND a.r <> b.r),
p AS (SELECT ar, br, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s USING (ar) WHERE NOT s.same AND {LEAST} * p.positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
