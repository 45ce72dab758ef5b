"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are taken from the UTF-8 buffers of whole batches. Random Fourier features of
the standardised statistics approximate a Gaussian kernel. Each task sums the normal equations of
its rows, for each of five folds; the driver adds the sums and solves. Scores of each fold under
the model of the other four then give the isotonic calibration (pool adjacent violators), so it
never sees a fitted score.

At most TRAIN_ROWS labelled rows, the first in the order of a hash of doc_id, train the model: a
documented bound, since the labels may grow without end while the model does not. Everything else
runs over all documents.

Defined cases: null and empty texts have all-zero statistics and a score like any text; a null
doc_id is never trained on and never held out; of repeated labels the lowest counts, null labels
none; without labels, or with one class only, every score is that class's share (1 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, SPACES, batches, read, stored, utf8, window_hashes, word_bounds, word_hashes

TRAIN_ROWS = 200_000
N_FEATURES = 256
RIDGE = 1e-3
CUT = 0.3
FOLDS = 5
SEED = 7

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 white space, 7 lead byte, 8 trail byte
_KIND[0x61:0x7B] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_KIND[[ord(c) for c in "#*$%&|<>{}[]=_/\\^~+@`"]] = 5
_KIND[np.flatnonzero(SPACES)] = 6
_KIND[0xC0:] = 7
_KIND[0x80:0xC0] = 8
STATS = (
    "log_chars", "log_words", "lower", "upper", "digit", "mark", "symbol", "space", "wide", "other", "word_length", "word_spread",
    "distinct_words", "repeated_triples", "lines_per_word", "repeated_lines", "marked_words", "symbol_words", "upper_words", "bangs", "entropy",
)


def statistics(column) -> np.ndarray:
    """One row of STATS for each text of a string column."""
    raw, offsets = utf8(column)
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(STATS)), np.float64)
    if not len(raw):
        return out
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 9 + _KIND[raw], minlength=9 * n).reshape(n, 9).astype(float)
    chars = kinds.sum(1) - kinds[:, 8]
    per = lambda x, y: x / np.maximum(y, 1)
    s, e, doc = word_bounds(raw, offsets, ~SPACES)
    words = np.bincount(doc, minlength=n).astype(float)
    length = (e - s).astype(float)
    mean = per(np.bincount(doc, length, n), words)
    h = word_hashes(raw, s, e)

    def repeats(keys, owner):  # per row: distinct keys
        if not len(keys):
            return np.zeros(n)
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n).astype(float)

    t = window_hashes(h, 3)
    same = doc[: len(t)] == doc[2:] if len(t) else np.zeros(0, bool)
    triples = np.bincount(doc[: len(t)][same], minlength=n).astype(float)
    line = np.ones(256, bool)
    line[10] = False
    ls, le, ld = word_bounds(raw, offsets, line)
    lines = np.bincount(ld, minlength=n).astype(float)
    has_symbol = np.concatenate([[0], np.cumsum(_KIND[raw] == 5)])
    has_lower = np.concatenate([[0], np.cumsum((_KIND[raw] == 1) | (_KIND[raw] == 7))])
    has_upper = np.concatenate([[0], np.cumsum(_KIND[raw] == 2)])
    letters = np.bincount(row * 27 + np.where((FOLD[raw] >= 97) & (FOLD[raw] < 123), FOLD[raw] - 96, 0), minlength=27 * n).reshape(n, 27)[:, 1:].astype(float)
    p = letters / np.maximum(letters.sum(1, keepdims=True), 1)
    out[:, 0], out[:, 1] = np.log1p(chars), np.log1p(words)
    for k, kind in enumerate((1, 2, 3, 4, 5, 6, 7, 0)):
        out[:, 2 + k] = per(kinds[:, kind], chars)
    out[:, 10] = mean
    out[:, 11] = np.sqrt(np.maximum(per(np.bincount(doc, length**2, n), words) - mean**2, 0))
    out[:, 12] = per(repeats(h, doc), words)
    out[:, 13] = per(triples - repeats(t[same], doc[: len(t)][same]), triples)
    out[:, 14] = per(lines, words)
    out[:, 15] = per(lines - repeats(word_hashes(raw, ls, le, fold=False), ld), lines)
    out[:, 16] = per(np.bincount(doc, _KIND[raw[e - 1]] == 4, n), words)
    out[:, 17] = per(np.bincount(doc, has_symbol[e] > has_symbol[s], n), words)
    out[:, 18] = per(np.bincount(doc, (has_upper[e] - has_upper[s] > 1) & (has_lower[e] == has_lower[s]), n), words)
    out[:, 19] = per(np.bincount(row, raw == 33, n), words)
    out[:, 20] = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    xs: np.ndarray  # isotonic steps: from xs[i] on, the score is ys[i]
    ys: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.turn + self.phase) * np.sqrt(2 / self.turn.shape[1]), z * 0.1, np.ones((len(z), 1))])

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return self.ys[np.clip(np.searchsorted(self.xs, raw, side="right") - 1, 0, len(self.ys) - 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.ys[0])
        return self.calibrated(self.features(x) @ self.weights)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; step starts and their means."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    first = np.r_[True, x[1:] != x[:-1]]
    starts = np.flatnonzero(first)
    w = np.diff(np.r_[starts, len(x)]).astype(float)
    v = np.add.reduceat(y, starts) / w
    blocks: list[list[float]] = []
    for at, mean, weight in zip(x[starts].tolist(), v.tolist(), w.tolist()):
        blocks.append([at, mean, weight])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            _, m, k = blocks.pop()
            b = blocks[-1]
            b[1], b[2] = (b[1] * b[2] + m * k) / (b[2] + k), b[2] + k
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): the statistics of every whole text as little-endian doubles."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, stats binary")


def bucket(modulus: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, len(STATS))


def fit(stats: DataFrame, labels: DataFrame, held_out=(5, 0), train_rows: int = TRAIN_ROWS, n_features: int = N_FEATURES, ridge: float = RIDGE) -> Model:
    """A model from stats (doc_id, stats) and labels (doc_id, quality), without rows of the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    modulus, fold = held_out
    known = known.filter(bucket(modulus) != fold).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(train_rows)
    one = stats.groupBy("doc_id").agg(F.min("stats").alias("stats"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")
    train = stored(one.join(known, "doc_id").select("stats", "quality", part.alias("fold")), "quality-train")

    def first(it):
        d = len(STATS)
        total, n, y = np.zeros((2, d)), 0, 0
        for b in it:
            x = _matrix(b["stats"])
            total += [x.sum(0), (x * x).sum(0)]
            n, y = n + len(x), y + int(np.sum(b["quality"].to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n]), pa.array([y])], ["t", "n", "y"])

    rows = train.mapInArrow(first, "t binary, n long, y long").collect()  # a row per task of at most train_rows rows
    n, y = sum(r["n"] for r in rows), sum(r["y"] for r in rows)
    none = np.zeros(0)
    if n == 0 or y in (0, n):
        return Model(none, none, none, none, none, np.array([-np.inf]), np.array([y / n if n else 1.0]))
    s, ss = sum((np.frombuffer(r["t"]).reshape(2, -1) for r in rows), np.zeros((2, len(STATS))))
    mean = s / n
    scale = np.sqrt(np.maximum(ss / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(SEED)
    width = np.sqrt(len(STATS))
    model = Model(mean, scale, rng.normal(size=(len(STATS), n_features)) / width, rng.uniform(0, 2 * np.pi, n_features), none, none, none)

    def normal(it):
        d = n_features + len(STATS) + 1
        a, b_, c = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d)), np.zeros((FOLDS, 2))
        for b in it:
            z, t, f = model.features(_matrix(b["stats"])), b["quality"].to_numpy().astype(float), b["fold"].to_numpy()
            for k in range(FOLDS):
                zk = z[f == k]
                a[k] += zk.T @ zk
                b_[k] += zk.T @ t[f == k]
        yield pa.RecordBatch.from_arrays([pa.array([k for k in range(FOLDS)]), pa.array([a[k].tobytes() for k in range(FOLDS)], pa.binary()), pa.array([b_[k].tobytes() for k in range(FOLDS)], pa.binary())], ["fold", "a", "b"])

    tasks = min(32, max(1, n // 5000))
    d = n_features + len(STATS) + 1
    a, b_ = np.zeros((FOLDS, d, d)), np.zeros((FOLDS, d))
    for r in train.coalesce(tasks).mapInArrow(normal, "fold long, a binary, b binary").toLocalIterator():  # 32 tasks at most
        a[r["fold"]] += np.frombuffer(r["a"]).reshape(d, d)
        b_[r["fold"]] += np.frombuffer(r["b"])
    ident = np.eye(d) * ridge * n
    solve = lambda keep: np.linalg.solve(a[keep].sum(0) + ident, b_[keep].sum(0))
    every = np.arange(FOLDS)
    folds = np.array([solve(every != k) for k in range(FOLDS)])

    def held(it):
        for b in it:
            z, f = model.features(_matrix(b["stats"])), b["fold"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((z * folds[f]).sum(1)), b["quality"]], ["x", "y"])

    pairs = train.mapInArrow(held, "x double, y int").toArrow()  # train_rows rows at most
    model.weights = solve(every >= 0)
    model.xs, model.ys = isotonic(pairs["x"].to_numpy(), pairs["y"].to_numpy())
    return model


def scored(stats: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(it):
        for b in it:
            s = np.clip(shared.value.score(_matrix(b["stats"])), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs whose text scores at least cut, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(it):
        for b in batches(it):
            keep = shared.value.score(statistics(b.column(at).fill_null(""))) >= cut
            yield b if keep.all() else b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(with_statistics(read(spark, sf_dir, "documents")), "quality-stats")
    model = fit(stats, read(spark, sf_dir, "labels"))
    out = scored(stats, model)
    return out.select("doc_id", F.coalesce(bucket(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
