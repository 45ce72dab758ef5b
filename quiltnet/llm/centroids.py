"""Centroid clustering by Elkan's bounds: most distances are never computed.

Every vector carries an upper bound of its distance to its centroid and a lower bound of that to each
of the k centroids. When centroids move, bounds move by as much. A distance is computed only where
neither the lower bound nor half the distance between the two centroids lies strictly above the upper
bound, so ties are always looked at. Bounds are 32-bit numbers rounded away from pruning; whatever is
compared in the end are exact integers.

A round is one pass without a shuffle: tasks take their batches of vectors and bounds, get the k
centroids with the code, and write what they changed to the shared folder. Sums come from a second
pass over clusters and components, added up within each task before the k * 64 totals are grouped;
only these reach the driver, which divides them.

Defined cases: rows whose vector is null, has another length, or a null or non-finite component, are
left out; components beyond +-2**27 after scaling raise an error, as distances would not fit a long;
rows without an id have no hash and start no centroid while others are left; equal ids are ordered by
their vectors; repeated rows are vectors of their own; with fewer than k vectors each one starts a
centroid; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Largest scaled component whose squared distances fit a long at 64 dimensions.
MOST = 1 << 27


def whole_vectors(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, values, lengths): the rows of a list column that have `dim` components, or any number where
    None, all of them finite; their components one after the other."""
    n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.flatnonzero(n == dim if dim is not None else n >= 0)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float)  # a null is a NaN
    n = n[rows]
    bad = np.zeros(len(rows), bool)
    bad[np.repeat(np.arange(len(rows)), n)[~np.isfinite(flat)]] = True
    return rows[~bad], flat[np.repeat(~bad, n)], n[~bad]


def scaled(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    v = np.floor(x * scale)
    if len(v) and np.abs(v).max() > most:
        raise ValueError(f"a component is beyond {most} / {scale}: results would not fit a long")
    return v.astype(np.int64)


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as 32-bit integers in a row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, flat, _ = whole_vectors(b.column(1), dim)
            v = scaled(flat, scale, MOST).astype(np.int32).reshape(len(rows), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([x.tobytes() for x in v], pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v binary")


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("...j,...j->...", d, d)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, calculated: np.ndarray) -> np.ndarray:
    """Move own, upper, lower and calculated (distances so far) to the given centroids, all in place; returns
    the squared distance to the own centroid, -1 where nobody had to know it."""
    k = len(centroids)
    half = np.nextafter(np.sqrt(_squares(centroids[:, None], centroids[None]).astype(float)) / 2, -np.inf)
    half = _down(half)
    nearest = np.where(np.eye(k, dtype=bool), np.float32(np.inf), half).min(1)
    exact = np.full(len(x), -1, np.int64)
    rest = np.flatnonzero(upper >= nearest[own])
    for j in range(k):
        i = rest[own[rest] != j]
        i = i[(upper[i] >= lower[i, j]) & (upper[i] >= half[own[i], j])]
        loose = i[exact[i] < 0]
        if len(loose):
            exact[loose] = _squares(x[loose], centroids[own[loose]])
            root = np.sqrt(exact[loose].astype(float))
            upper[loose], lower[loose, own[loose]] = _up(root), _down(root)
            calculated[loose] += 1
            i = i[(upper[i] >= lower[i, j]) & (upper[i] >= half[own[i], j])]
        if not len(i):
            continue
        d = _squares(x[i], centroids[j])
        root = np.sqrt(d.astype(float))
        lower[i, j] = _down(root)
        calculated[i] += 1
        nearer = (d < exact[i]) | ((d == exact[i]) & (j < own[i]))
        w = i[nearer]
        own[w], exact[w], upper[w] = j, d[nearer], _up(root[nearer])
    return exact


_STATE = "vec_id long, v binary, cluster int, upper float, lower binary, calculated int"


def _round(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """state after its vectors have been assigned to centroids; with distances instead of bounds if last."""
    k, dim = centroids.shape
    step = np.sqrt(_squares(centroids, before).astype(float)) if before is not None else np.zeros(k)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.num_rows
            if not n:
                continue
            x = _matrix(b.column("v"), np.int32, dim).astype(np.int64)
            if before is None:
                own, calculated = np.zeros(n, np.int32), np.zeros(n, np.int32)
                upper, lower = np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)
            else:
                own, calculated = b.column("cluster").to_numpy().copy(), b.column("calculated").to_numpy().copy()
                upper = _up(b.column("upper").to_numpy().astype(float) + step[own])
                lower = _down(_matrix(b.column("lower"), np.float32, k).astype(float) - step)
            exact = assign(x, own, upper, lower, centroids, calculated)
            if last:
                unknown = np.flatnonzero(exact < 0)
                exact[unknown] = _squares(x[unknown], centroids[own[unknown]])
                calculated[unknown] += 1
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own), pa.array(exact), pa.array(calculated)], ["vec_id", "cluster", "distance", "calculated"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v"), pa.array(own), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary()), pa.array(calculated)],
                    ["vec_id", "v", "cluster", "upper", "lower", "calculated"],
                )

    return state.mapInArrow(run, "vec_id long, cluster int, distance long, calculated int" if last else _STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the means of the clusters; an empty one keeps its centroid."""
    k, dim = centroids.shape

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in it:
            own, x = b.column(0).to_numpy(), _matrix(b.column(1), np.int32, dim).astype(np.int64)
            n += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            some, first = np.unique(own[order], return_index=True)
            if len(some):
                total[some] += np.add.reduceat(x[order], first)
        some = np.flatnonzero(n)
        c, at = np.repeat(some, dim), np.tile(np.arange(dim), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(at), pa.array(total[c, at]), pa.array(n[c])], ["c", "at", "s", "n"])

    parts = state.select("cluster", "v").mapInArrow(run, "c long, at long, s long, n long")
    out = centroids.copy()
    for r in parts.groupBy("c", "at").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.sum("n").alias("n")).collect():  # k * dim rows
        out[r["c"], r["at"]] = int(r["s"]) // r["n"]
    return out


def elkan(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "1") -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, and
    calculated, the number of distances that were computed for it in all rounds."""
    spark = vectors.sparkSession
    state = stored(integer_vectors(vectors, dim, scale), "elkan-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = state.select("v", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "v").limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, calculated int"
    if not first:
        return spark.createDataFrame([], schema)
    now, before = np.array([np.frombuffer(r["v"], np.int32) for r in first], np.int64), None
    for i in range(rounds):
        state = stored(_round(state, now, before, last=False), f"elkan-round{i}")
        now, before = _means(state, now), now
    out = stored(_round(state, now, before, last=True), "elkan-distances")
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    per = spark.createDataFrame([(c, s, sum(sums.values()), digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "calculated")  # k rows


def op11_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan(read(spark, sf_dir, "embeddings")).drop("calculated")


def _assigned(i: int) -> str:
    return f"""d{i} AS (SELECT e.r, e.v, min(struct_pack(d := list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c.c)) AS m FROM e, c{i} c GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT r, v, m.c AS c, CAST(m.d AS BIGINT) AS d FROM d{i})"""


def _moved(i: int) -> str:
    return f"""s{i} AS (SELECT c, pos, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{i - 1}) GROUP BY c, pos),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM s{i} GROUP BY c),
c{i} AS MATERIALIZED (SELECT c{i - 1}.c, coalesce(m{i}.v, c{i - 1}.v) AS v FROM c{i - 1} LEFT JOIN m{i} USING (c))"""


OP11_SQL = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS k, v FROM e) QUALIFY c < {K}),
{_assigned(0)},
{", ".join(f"{_moved(i)}, {_assigned(i)}" for i in range(1, ROUNDS + 1))},
p AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, p.s AS cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a{ROUNDS}) AS inertia, sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM e JOIN a{ROUNDS} USING (r) JOIN p USING (c) JOIN c{ROUNDS} USING (c)
"""
