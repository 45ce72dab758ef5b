"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation.

Word counts cover every training document. They are too many to broadcast, so rows are dealt into
groups by their place in the files; a group asks the hash buckets of the words it has, each once, and gets their counts
back. The vocabulary is the sqrt(N) commonest words of N training tokens, 62 at least, of those
seen twice; all others are the rare words, which share one class inside which a word's probability
follows its count. The next token is scored from the two tokens before it, each word of the
vocabulary by its own vector: a context vector (a matrix per position times that token's vector)
times a vector, plus a bias. The vocabulary is cut by rank into about sqrt(V) classes; a token's
class is scored first, then the token among its class, and both normalise, so probabilities sum to
one.

Every training token is a training context. A task climbs the NCE objective over its partition
with Adagrad, with noise shared by a minibatch; all tasks begin alike, and a row of the model
becomes the mean of the tasks' rows, weighted by how often each touched it. Results hence depend
on how files are split. With 62 words or fewer, counts of triples give the exact expected
objective, which Adam climbs on the driver.

Defined cases: null or empty text is the end token alone; a null doc_id is neither trained on nor
held out; repeated rows are documents of their own; equal counts rank by word; texts of any length
are scored whole; other columns, whatever their names, are not read; without training documents N = V = 0 and the
model is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark import TaskContext

from .common import batches, blob, fan_out, id_out, read, stored, texts_of

N_WORDS = 62
WIDTH = 24
NOISE = 10
STEPS = 400
#: Tokens of a minibatch, and of a pass below which a partition is passed over again.
MINIBATCH, PASS = 16384, 400_000
SLICES = 16
#: The end of a text as a word: no word has a space.
END = b" "
LOG10 = np.log(10.0)


def held_out(modulus: int = 7, fold: int = 2):
    return F.col("known") & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == fold)


def split(column) -> list[list[bytes]]:
    """The folded words of each text."""
    return [t.as_buffer().to_pybytes().lower().split() if t.is_valid else [] for t in column.cast(pa.binary())]


class GroupWords:
    """The documents of a group in a fixed order and its distinct words, ordered by bucket and first occurrence.

    Rows that tie in that order have the same words, so every scan orders the words alike."""

    def __init__(self, table: pa.Table, n_buckets: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.known, self.train, self.held = table["doc_id"], table["known"], table["train"].to_numpy(), table["held_out"]
        text = table["text"].combine_chunks()
        self.docs = split(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks))
        words = list(dict.fromkeys(chain([END], chain.from_iterable(self.docs))))
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % n_buckets
        order = np.argsort(bucket, kind="stable")
        self.words = [words[i] for i in order.tolist()]
        self.bucket = bucket[order]

    def counts(self) -> np.ndarray:
        c = Counter(chain.from_iterable(compress(self.docs, self.train.tolist())))
        c[END] = int(self.train.sum())
        return np.fromiter(map(c.__getitem__, self.words), np.int64, len(self.words))


def _ask(n_buckets: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = GroupWords(table, n_buckets)
        c = g.counts()
        cut = np.r_[0, np.flatnonzero(np.diff(g.bucket)) + 1, len(c)]
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        return pa.table(
            {
                "bucket": pa.array([int(g.bucket[a]) for a, _ in spans], pa.int64()), "g": pa.array([key[0].as_py()] * len(spans), pa.int64()),
                "words": pa.array([b"\n".join(g.words[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([blob(c[a:b]) for a, b in spans], pa.binary()),
            }
        )

    return run


_ANSWER = "kind int, g long, bucket long, counts binary, word binary, n long, v long"


def _answer(n_words: int):
    def run(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        asked = []
        for words, counts in zip(table["words"].to_pylist(), table["counts"].to_pylist()):
            ws = words.split(b"\n")
            asked.append(ws)
            for w, c in zip(ws, np.frombuffer(counts, np.int64).tolist()):
                total[w] = total.get(w, 0) + c
        back = [blob(np.fromiter(map(total.__getitem__, ws), np.int64, len(ws))) for ws in asked]
        end = total.pop(END, 0)
        n, v = sum(total.values()), sum(c > 0 for c in total.values())
        top = sorted((-c, w) for w, c in total.items() if c)
        top = top[: max(n_words, sum(c < -1 for c, _ in top))]
        k, m = len(back), len(top)
        return pa.table(
            {
                "kind": pa.array([0] * k + [1] * m + [2], pa.int32()), "g": pa.array(table["g"].to_pylist() + [-1] * (m + 1), pa.int64()),
                "bucket": pa.array(table["bucket"].to_pylist() + [-1] * (m + 1), pa.int64()), "counts": pa.array(back + [None] * (m + 1), pa.binary()),
                "word": pa.array([None] * k + [w for _, w in top] + [None], pa.binary()), "n": pa.array([0] * k + [-c for c, _ in top] + [n + end], pa.int64()), "v": pa.array([0] * (k + m) + [v + (end > 0)], pa.int64()),
            }
        )

    return run


# ---------------------------------------------------------------- the model


@dataclass
class LogBilinear:
    words: dict[bytes, int]  # class of each word of the vocabulary
    context: np.ndarray  # vectors of tokens as context; the last is the start of a text
    turn: np.ndarray  # one matrix per context position
    token: np.ndarray
    bias: np.ndarray
    rest: int  # counts plus types of all words outside the vocabulary, plus one

    @property
    def n_out(self) -> int:
        return len(self.bias)

    def log_probs(self) -> np.ndarray:
        """log P(token | both context tokens), normalised: one batched product over all contexts."""
        a, b = self.context @ self.turn[0], self.context @ self.turn[1]
        s = (a[:, None, :] + b[None, :, :]).reshape(-1, a.shape[1]) @ self.token.T + self.bias
        top = s.max(1, keepdims=True)
        return s - top - np.log(np.exp(s - top).sum(1, keepdims=True))

    def log_p(self, two: np.ndarray, one: np.ndarray, y: np.ndarray) -> np.ndarray:
        table = self.__dict__.get("_table")
        if table is None:
            table = self.__dict__["_table"] = self.log_probs()
        return table[two * len(self.context) + one, y]


def train_nce(triples: np.ndarray, width: int = WIDTH, noise: int = NOISE, steps: int = STEPS, rate: float = 0.05, seed: int = 3):
    """(context, turn, token, bias) from counts[first, second, token]; the noise is the unigram law."""
    n_ctx, _, n_out = triples.shape
    rng = np.random.default_rng(seed)
    n = triples.reshape(-1, n_out).astype(float)
    total = n.sum()
    p = [rng.normal(0, 0.1, (n_ctx, width)), np.stack([np.eye(width), np.eye(width)]) * 0.5, rng.normal(0, 0.1, (n_out, width)), np.zeros(n_out)]
    if total == 0:
        return p[0], p[1], np.zeros_like(p[2]), p[3]
    q = (n.sum(0) + 0.5) / (total + 0.5 * n_out)
    p[3] = np.log(q)
    n /= total
    seen = n.sum(1, keepdims=True) * noise * q
    shift = np.log(noise * q)
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, steps + 1):
        r, c, w, b = p
        left, right = r @ c[0], r @ c[1]
        ctx = (left[:, None] + right[None]).reshape(-1, width)
        sig = 1 / (1 + np.exp(-np.clip(ctx @ w.T + b - shift, -40, 40)))
        g = n * (1 - sig) - seen * sig  # of the expected objective, by score
        d_ctx = (g @ w).reshape(n_ctx, n_ctx, width)
        d_left, d_right = d_ctx.sum(1), d_ctx.sum(0)
        grads = [d_left @ c[0].T + d_right @ c[1].T, np.stack([r.T @ d_left, r.T @ d_right]), g.T @ ctx, g.sum(0)]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            p[i] = p[i] + rate * (1 - t / (steps + 1)) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-10)
    return tuple(p)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


class Hierarchy:
    """A log-bilinear model of any vocabulary: P(class | context) P(word | class, context).

    Words are numbered by rank; after them come the rare words and the end, each a class of its own,
    and as context the start of a text.
    """

    def __init__(self, words: dict[bytes, int], counts: np.ndarray, rest: int, width: int = WIDTH, seed: int = 3):
        """counts: of the words, the rare words and the end."""
        self.words, self.rest, v = words, rest, len(words)
        self.n_out, n_class = v + 2, max(1, math.isqrt(v))
        self.size = -(-v // n_class)
        n_class = -(-v // self.size)
        self.edge = np.r_[np.minimum(np.arange(n_class + 1) * self.size, v), v + 1, v + 2]
        n = counts + 0.5
        of_class = np.add.reduceat(n, self.edge[:-1])
        self.q_class = of_class / of_class.sum()
        self.q_word = (n / np.repeat(of_class, np.diff(self.edge)))[:v]
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.rows = {"context": f(v + 3, width), "class": f(n_class + 2, width), "class_bias": np.log(self.q_class).astype(np.float32)[:, None], "word": f(v, width), "word_bias": np.log(self.q_word).astype(np.float32)[:, None], "turn": np.stack([np.eye(width, dtype=np.float32)] * 2).reshape(2 * width, width) * np.float32(0.5)}

    def class_of(self, y: np.ndarray) -> np.ndarray:
        v = len(self.words)
        return np.where(y < v, y // self.size, len(self.edge) - 3 + y - v)

    def hidden(self, two: np.ndarray, one: np.ndarray) -> np.ndarray:
        p = self.rows
        width = p["turn"].shape[1]
        return (p["context"] @ p["turn"][:width])[two] + (p["context"] @ p["turn"][width:])[one]

    def log_p(self, two: np.ndarray, one: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(y | two, one) of every token, normalised over classes and inside the token's class."""
        p, out, v = self.rows, np.empty(len(y)), len(self.words)
        order = np.argsort(y.astype(np.uint16) if self.n_out < 1 << 16 else y, kind="stable")  # sorts of 16 bits are by radix
        two, one, y = two[order], one[order], y[order]
        h, cls = self.hidden(two, one), self.class_of(y)
        longest = np.sqrt(np.einsum("ij,ij->i", h, h).max(initial=0))

        def among(h: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
            got, step, wt, b = np.empty(len(h), np.float32), 2048, np.ascontiguousarray(w.T), b[:, 0]
            far = longest * np.sqrt((w * w).sum(1).max()) + np.abs(b).max() > 40  # else no score is beyond what exp holds
            for a in range(0, len(h), step):
                s = h[a : a + step] @ wt
                s += b
                if far:
                    s -= s.max(1, keepdims=True)
                own = s[np.arange(len(s)), at[a : a + step]]
                np.exp(s, out=s)
                got[a : a + step] = own - np.log(s @ np.ones(s.shape[1], np.float32))
            return got

        lp = among(h, p["class"], p["class_bias"], cls)
        cut = np.searchsorted(y, self.edge[: len(self.edge) - 2])
        for lo, hi, a, z in zip(self.edge[:-3].tolist(), self.edge[1:-2].tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            if z > a:
                lp[a:z] += among(h[a:z], p["word"][lo:hi], p["word_bias"][lo:hi], y[a:z] - lo)
        out[order] = lp
        return out


class Climb:
    """Adagrad on a task's own copy of a model, over minibatches of its tokens."""

    def __init__(self, model: Hierarchy, seed: int, noise: int = NOISE, rate: float = 0.1):
        self.m, self.rng, self.k, self.rate = model, np.random.default_rng(seed), noise, np.float32(rate)
        self.p = {n: x.copy() for n, x in model.rows.items()}
        self.square = {n: np.full_like(x, 1e-6) for n, x in self.p.items()}
        self.touched = {n: np.zeros(len(x)) for n, x in self.p.items()}
        self.shift_class = np.log(noise * model.q_class).astype(np.float32)
        self.shift_word = np.log(noise * model.q_word).astype(np.float32)
        self.upto_class = np.cumsum(model.q_class)
        self.upto_word = np.cumsum(model.q_word)  # each class adds one

    def _up(self, name: str, rows: np.ndarray, d: np.ndarray, n: np.ndarray | float) -> None:
        s = self.square[name][rows] + d * d
        self.square[name][rows] = s
        self.p[name][rows] += self.rate * d / np.sqrt(s)
        self.touched[name][rows] += n

    def _against(self, h: np.ndarray, name: str, draws: np.ndarray, spans: list[tuple[int, int]], shift: np.ndarray) -> np.ndarray:
        """Push noise down, draws[i] by the tokens of spans[i]; the gradient of h."""
        k, back = draws.shape[1], np.zeros_like(h)
        w, b = self.p[name][draws], self.p[name + "_bias"][draws, 0] - shift[draws]
        d, bias = np.zeros((draws.size, h.shape[1]), np.float32), np.zeros((draws.size, 1), np.float32)
        for i, (a, z) in enumerate(spans):
            s = h[a:z] @ w[i].T
            s += b[i]
            np.tanh(s * np.float32(0.5), out=s)
            s += 1
            s *= np.float32(-0.5)  # minus the logistic of the score
            np.matmul(s, w[i], out=back[a:z])
            d[i * k : i * k + k] = s.T @ h[a:z]
            bias[i * k : i * k + k, 0] = s.sum(0)
        flat = draws.ravel()
        by = np.argsort(flat, kind="stable")
        first = _runs(flat[by])
        rows, times = flat[by][first], np.diff(np.r_[first, len(flat)])
        self._up(name, rows, np.add.reduceat(d[by], first), times)
        self._up(name + "_bias", rows, np.add.reduceat(bias[by], first), times)
        return back

    def step(self, two: np.ndarray, one: np.ndarray, y: np.ndarray) -> None:
        m, p, v = self.m, self.p, len(self.m.words)
        order = np.argsort(y, kind="stable")
        two, one, y = two[order], one[order], y[order]
        width = p["turn"].shape[1]
        x2, x1 = p["context"][two], p["context"][one]
        h = x2 @ p["turn"][:width] + x1 @ p["turn"][width:]
        dh = np.zeros_like(h)

        def toward(name: str, at: np.ndarray, shift: np.ndarray, upto: int) -> tuple:
            """The gradient of the tokens' own rows, taken before noise moves them."""
            w, hh = p[name][at], h[:upto]
            s = np.einsum("ij,ij->i", hh, w) + p[name + "_bias"][at, 0] - shift[at]
            g = (1 / (1 + np.exp(np.clip(s, -40, 40))))[:, None]
            dh[:upto] += g * w
            first = _runs(at)
            return name, at[first], np.add.reduceat(g * hh, first), np.add.reduceat(g, first), np.diff(np.r_[first, upto])

        n_words = int(np.searchsorted(y, v))
        own = [toward("class", m.class_of(y), self.shift_class, len(y))]
        if n_words:
            own.append(toward("word", y[:n_words], self.shift_word, n_words))
        draw = np.searchsorted(self.upto_class, self.rng.random((1, self.k))).clip(0, len(self.upto_class) - 1)
        dh += self._against(h, "class", draw, [(0, len(y))], self.shift_class)
        if n_words:
            cut = np.searchsorted(y, m.edge[: len(m.edge) - 2])
            full = np.flatnonzero(np.diff(cut))
            draw = np.searchsorted(self.upto_word, full[:, None] + self.rng.random((len(full), self.k)))
            draw = draw.clip(m.edge[full][:, None], m.edge[full + 1][:, None] - 1)
            dh += self._against(h, "word", draw, list(zip(cut[full].tolist(), cut[full + 1].tolist())), self.shift_word)
        for name, rows, d, bias, n in own:
            self._up(name, rows, d, n)
            self._up(name + "_bias", rows, bias, n)
        for at, d in ((two, dh @ p["turn"][:width].T), (one, dh @ p["turn"][width:].T)):
            by = np.argsort(at, kind="stable")
            first = _runs(at[by])
            self._up("context", at[by][first], np.add.reduceat(d[by], first), np.diff(np.r_[first, len(at)]))
        self._up("turn", np.arange(2 * width), np.concatenate([x2.T @ dh, x1.T @ dh]), len(y))

    def over(self, two: np.ndarray, one: np.ndarray, y: np.ndarray) -> None:
        size = min(MINIBATCH, max(256, len(y) // 16))
        for a in range(0, len(y), size):
            self.step(two[a : a + size], one[a : a + size], y[a : a + size])


def train_partitions(docs: DataFrame, model: Hierarchy) -> None:
    """Train on every token of docs (text): tasks climb from the same start, rows are averaged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Hierarchy = shared.value
        part = TaskContext.get().partitionId()
        kind = np.uint16 if m.n_out < 1 << 16 else np.int64  # sorts of 16 bits are by radix
        c, held, n = Climb(m, part), [], 0
        for b in batches(it, 2 << 20):
            two, one, y, _ = _classes(split(b.column(0)), m.words, m.n_out)
            got = two.astype(kind), one.astype(kind), y.astype(kind)
            c.over(*got)
            n += len(y)
            held = [*held, got] if n <= PASS else []
        for _ in range(min(40, PASS // max(n, 1)) if held else 0):
            for got in held:
                c.over(*got)
        if n:
            out = [(name, s, c.p[name][s::SLICES], c.touched[name][s::SLICES]) for name in m.rows for s in range(min(SLICES, len(m.rows[name])))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.int64()), pa.array([part] * len(out), pa.int64()), pa.array([blob(o[2]) for o in out], pa.binary()), pa.array([blob(o[3]) for o in out], pa.binary())],
                ["name", "slice", "part", "vectors", "touched"],
            )

    def mean(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        top = bottom = 0.0
        for x, n in zip(*(table.sort_by("part")[k].to_pylist() for k in ("vectors", "touched"))):
            n = np.frombuffer(n, np.float64)[:, None]
            top, bottom = top + n * np.frombuffer(x, np.float32).reshape(len(n), -1), bottom + n
        return pa.table({"name": [key[0].as_py()], "slice": pa.array([key[1].as_py()], pa.int64()), "top": pa.array([blob(top)], pa.binary()), "bottom": pa.array([blob(bottom)], pa.binary())})

    got = docs.mapInArrow(run, "name string, slice long, part long, vectors binary, touched binary").groupBy("name", "slice").applyInArrow(mean, "name string, slice long, top binary, bottom binary")
    for r in got.toLocalIterator():  # one model in all, a slice at a time
        n = np.frombuffer(r["bottom"], np.float64)[:, None]
        rows = model.rows[r["name"]][r["slice"] :: SLICES]
        np.copyto(rows, (np.frombuffer(r["top"], np.float64).reshape(rows.shape) / np.maximum(n, 1)).astype(np.float32), where=n > 0)


def _classes(docs: list[list[bytes]], words: dict[bytes, int], n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context before the last, last context, class, document) of every token, the end tokens included."""
    n = sum(map(len, docs))
    return _placed(docs, np.fromiter(map(words.get, chain.from_iterable(docs), repeat(n_out - 2)), np.int64, n), n_out)


def _placed(docs: list[list[bytes]], inner: np.ndarray, n_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As _classes, from the classes of all words in order."""
    end, begin = n_out - 1, n_out
    n = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
    last = np.cumsum(n) - 1
    cls = np.full(int(n.sum()), end, np.int64)
    body = np.ones(len(cls), bool)
    body[last] = False
    cls[body] = inner
    one, two = np.full(len(cls), begin), np.full(len(cls), begin)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    first = last - n + 1
    one[first], two[first] = begin, begin
    second = first[n > 1] + 1
    two[second] = begin
    return two, one, cls, np.repeat(np.arange(len(docs)), n)


def _triples(docs: DataFrame, words: dict[bytes, int], n_out: int) -> np.ndarray:
    """Counts of (context, context, token) classes over all training documents."""
    size = (n_out + 1) ** 2 * n_out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(size, np.int64)
        for b in batches(it, 2 << 20):
            two, one, cls, _ = _classes(split(b.column(0)), words, n_out)
            c += np.bincount((two * (n_out + 1) + one) * n_out + cls, minlength=size)
        k = np.flatnonzero(c)
        step = -(-size // 64)
        cut = np.searchsorted(k, np.arange(0, 64 * step + 1, step))
        parts = [(a, z) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()) if z > a]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(k[a]) // step for a, _ in parts], pa.int64()), pa.array([blob(k[a:z].astype(np.uint32)) for a, z in parts], pa.binary()), pa.array([blob(c[k[a:z]]) for a, z in parts], pa.binary())],
            ["slice", "codes", "counts"],
        )

    def add(table: pa.Table) -> pa.Table:
        codes = np.concatenate([np.frombuffer(x, np.uint32) for x in table["codes"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()])
        u, inv = np.unique(codes, return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, inv, counts)
        return pa.table({"codes": pa.array([blob(u)], pa.binary()), "counts": pa.array([blob(total)], pa.binary())})

    out = np.zeros(size, np.int64)
    summed = docs.mapInArrow(run, "slice long, codes binary, counts binary").groupBy("slice").applyInArrow(add, "codes binary, counts binary")
    for r in summed.collect():  # 64 rows; all codes together are a table of fixed size
        out[np.frombuffer(r["codes"], np.uint32)] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(n_out + 1, n_out + 1, n_out)


def _score(n_buckets: int, shared, n_total: int, v_total: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        model: LogBilinear | Hierarchy = shared.value
        g = GroupWords(table.select(["doc_id", "text", "known", "train", "held_out"]), n_buckets)
        back = sorted(zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist()))
        counts = np.concatenate([np.frombuffer(x, np.int64) for _, x in back])
        place = dict(zip(g.words, range(len(g.words))))
        other, end = model.n_out - 2, model.n_out - 1
        inner = np.fromiter(map(place.__getitem__, chain.from_iterable(g.docs)), np.int64, sum(map(len, g.docs)))
        class_of = np.fromiter(map(model.words.get, g.words, repeat(other)), np.int64, len(g.words))
        two, one, cls, doc = _placed(g.docs, class_of[inner], model.n_out)
        at = np.full(len(cls), place[END], np.int64)
        at[cls != end] = inner
        c = counts[at]
        n = len(g.docs)
        base = np.log10((counts + 1) / (n_total + v_total + 1))[at]
        score = model.log_p(two, one, cls) / LOG10
        rare = cls == other
        score[rare] += np.log10((c[rare] + 1) / model.rest)
        return pa.table(
            {
                "doc_id": g.ids, "known": g.known, "held_out": g.held, "n_tokens": pa.array(np.bincount(doc, minlength=n), pa.int64()), "n_known": pa.array(np.bincount(doc[c > 0], minlength=n), pa.int64()),
                "train_tokens": pa.array(np.full(n, n_total), pa.int64()), "base_score": pa.array(np.bincount(doc, base, n)), "score": pa.array(np.bincount(doc, score, n)),
            }
        )

    return run


def lm_scores(docs: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    n_words is the least size of the vocabulary."""
    spark = docs.sparkSession
    source = texts_of(docs)
    n_parts = fan_out(docs, 4)
    n_groups = n_buckets = 2 * n_parts
    cols = source.select("doc_id", "text", "known", held_out().alias("held_out"), (F.col("known") & ~held_out()).alias("train"), F.pmod("row", F.lit(n_groups)).alias("g"))
    dealt = cols.repartition(n_parts, "g")
    asked = dealt.groupBy("g").applyInArrow(_ask(n_buckets), "bucket long, g long, words binary, counts binary")
    answers = stored(asked.groupBy("bucket").applyInArrow(_answer(n_words), _ANSWER), "lm-counts")
    n_total, v_total = (x or 0 for x in answers.filter("kind = 2").agg(F.sum("n"), F.sum("v")).first())
    top = answers.filter("kind = 1").orderBy(F.desc("n"), "word").limit(max(n_words, math.isqrt(n_total))).select("word", "n").collect()
    words = {bytes(r["word"]): i for i, r in enumerate(top)}
    n_train = cols.filter("train").count()
    n_out = len(words) + 2
    rest = (n_total - n_train - sum(r["n"] for r in top)) + (v_total - (n_train > 0) - len(top)) + 1
    texts = cols.filter("train").select("text")
    if len(words) <= N_WORDS:
        model = LogBilinear(words, *train_nce(_triples(texts, words, n_out)), rest)
    else:
        known = [r["n"] for r in top]
        model = Hierarchy(words, np.array([*known, n_total - n_train - sum(known), n_train], float), rest)
        train_partitions(texts, model)
    shared = spark.sparkContext.broadcast(model)  # grows with the square root of the training tokens
    schema = "doc_id long, known boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    back = answers.filter("kind = 0").select("g", "bucket", "counts")
    out = dealt.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(_score(n_buckets, shared, n_total, v_total), schema)
    return out.select(id_out(), *[c for c in out.columns if c not in ("doc_id", "known")])


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read(spark, sf_dir, "documents"))

