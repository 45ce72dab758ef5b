"""Token-id files: canonical length-limited Huffman coding of ids, read back by table-driven decoding.

Documents are range-partitioned by doc_id and tokenised in that order; each row of the files is a
run of whole documents. A first pass stores the ids and counts them over the whole corpus; package
merge on the counts (as many as the vocabulary, nothing that grows with the corpus) gives the best
code of at most 16 bits. A row holds its documents' ids as one bit stream, and the bit offset of
every 512th id: each such block decodes on its own, so decoding runs all blocks of a row in step.

File format: a folder with `codebook` (id, bits) and `runs` (part, seq, start_in_part, n_ids,
doc_ids int64[], void bool[] (the id was null), lengths int64[], payload, checkpoints int64[]), little-endian, as Parquet.

Defined cases: null or empty text is the end id alone; null doc_ids come last; repeated rows are
documents of their own; under one id the first 64 characters of the text order rows, then a hash of
their place in the files; texts of any length are
one run of ids; other columns, whatever their names, are not read; an empty table writes an empty codebook and no runs.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, SPACES, batches, blob, fan_out, fresh_path, id_out, read, texts_of, utf8, word_bounds, word_hashes

MAX_BITS = 16
BLOCK = 512
RUN_IDS = 1 << 19
END_ID = 1
#: Words kept with their ids per worker (about 100 MB); beyond it those of the current batch stay.
CACHE_WORDS = 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_IS_TAIL, _IS_PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_IS_TAIL[list(b".,;:!?*%#$&")] = True
_IS_PLAIN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The rows data[start : start + length], end to end."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(length) else 0
    return data[np.repeat(start - ends + length, length) + np.arange(total)]


class Ragged:
    """Rows of numbers end to end, with room to grow."""

    def __init__(self, kind):
        self.data, self.first, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 16, np.int64), 0

    def append(self, lengths: np.ndarray, values: np.ndarray) -> None:
        k, used = self.n, int(self.first[self.n])
        if k + len(lengths) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(k + len(lengths), np.int64)])
        if used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(used + len(values), self.data.dtype)])
        self.first[k + 1 : k + len(lengths) + 1] = used + np.cumsum(lengths)
        self.data[used : used + len(values)] = values
        self.n = k + len(lengths)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some rows, and how many each has."""
        length = self.first[at + 1] - self.first[at]
        return _gather(self.data, self.first[at], length), length


class WordTokenizer:
    """Encodes texts word by word. The model's normaliser and pre-tokeniser never join text across
    ASCII white space and drop the space itself, so the ids of a text are those of its words; they
    fold case, and cut marks from a plain letter or digit before them. A batch looks up each of
    its distinct words once: by 64-bit hash, and the bytes of what is found must be the word's."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.vocab = self.model.get_vocab_size()
        self.ends_word = np.zeros(self.vocab, bool)
        self.ends_word[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and the row of each
        self.ids, self.spelled = Ragged(np.uint32), Ragged(np.uint8)

    def _enter(self, keys: np.ndarray) -> None:
        """Hashes of the rows appended last."""
        keys, slot = np.concatenate([self.keys, keys]), np.concatenate([self.slot, np.arange(self.ids.n - len(keys), self.ids.n)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], slot[order]

    def _find(self, keys: np.ndarray, low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The row of each word, -1 where there is none. Should two words have one hash, all rows go."""
        out = np.full(len(keys), -1)
        if not len(self.keys):
            return out
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == keys)
        slot = self.slot[at[hit]]
        spelled, n = self.spelled.take(slot)
        if (n != length[hit]).any() or (spelled != _gather(low, start[hit], n)).any():
            self.clear()
            return out
        out[hit] = slot
        return out

    def _learn_each(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.model.encode_batch_fast(text, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return lengths, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))

    def _learn_lines(self, text: list[str], per_line: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters are one piece each, and only a piece's last id ends a word."""
        lines = [" ".join(text[i : i + per_line]) for i in range(0, len(text), per_line)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.model.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(text) or (len(ends) and ends[-1] != len(ids)):
            return self._learn_each(text)
        return np.diff(ends, prepend=0), ids

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Append rows for new words; the row of each."""
        text = [w.decode() for w in words]
        pure = np.fromiter(map(str.isalpha, text), bool, len(text))
        order = np.concatenate([np.flatnonzero(pure), np.flatnonzero(~pure)])
        n, k = int(pure.sum()), order.tolist()
        for how, part in ((self._learn_lines, k[:n]), (self._learn_each, k[n:])):
            self.ids.append(*how([text[i] for i in part]))
            self.spelled.append(np.fromiter((len(words[i]) for i in part), np.int64, len(part)), np.frombuffer(b"".join([words[i] for i in part]), np.uint8))
        self._enter(keys[order])
        out = np.empty(len(words), np.int64)
        out[order] = np.arange(self.ids.n - len(words), self.ids.n)
        return out

    def _keep(self, keys: np.ndarray, slot: np.ndarray) -> None:
        """Only these words stay in the table."""
        (ids, n), (spelled, m) = self.ids.take(slot), self.spelled.take(slot)
        self.clear()
        self.ids.append(n, ids)
        self.spelled.append(m, spelled)
        self._enter(keys)

    def encode(self, column, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column, each text followed by end_id, and how many each text has."""
        raw, offsets = utf8(column)
        n = len(offsets) - 1
        s, e, _ = word_bounds(raw, offsets, ~SPACES)
        low = FOLD[raw]
        at = np.flatnonzero((raw == 0x3C) | (raw == 0x27))
        odd = np.searchsorted(at, e) > np.searchsorted(at, s) if len(at) else np.zeros(len(s), bool)
        for k in np.flatnonzero(odd).tolist():
            if (raw[s[k] : e[k]] == 0x3C).any():  # may spell a special token
                low[s[k] : e[k]] = raw[s[k] : e[k]]
        # up to 8 marks after a plain letter or digit are a piece of their own
        k, core = np.flatnonzero(~odd), e.copy()
        for _ in range(8):
            k = k[(core[k] > s[k]) & _IS_TAIL[low[core[k] - 1]]]
            if not len(k):
                break
            core[k] -= 1
        k = np.flatnonzero((core < e) & (core > s))
        cut = core[k][_IS_PLAIN[low[core[k] - 1]]]
        s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
        h = word_hashes(low, s, e, fold=False)
        order = np.argsort(h)
        ranked = h[order]
        new = np.ones(len(h), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        first = order[new]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        keys, start, size = ranked[new], s[first], e[first] - s[first]
        if self.ids.n > CACHE_WORDS:
            slot = self._find(keys, low, start, size)
            self._keep(keys[slot >= 0], slot[slot >= 0])
        slot = self._find(keys, low, start, size)
        unknown = np.flatnonzero(slot < 0)
        if len(unknown):
            whole = low.tobytes()
            slot[unknown] = self._learn(keys[unknown], [whole[a : a + n] for a, n in zip(start[unknown].tolist(), size[unknown].tolist())])
        body, length = self.ids.take(slot[inverse])
        total = np.concatenate([[0], np.cumsum(length)])
        ends, begins = np.searchsorted(s, offsets[1:]), np.searchsorted(s, offsets[:-1])
        per_doc = total[ends] - total[begins] + 1
        out = np.empty(int(per_doc.sum()), np.uint32)
        last = np.cumsum(per_doc) - 1
        free = np.ones(len(out), bool)
        free[last] = False
        out[last] = end_id
        out[free] = body
        return out, per_doc


_loaded: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One per worker process, so that its table of words outlives a task."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits per symbol (0: unused) by package merge; the least total among codes of max_bits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, now = [], leaves
    leaf_flags = np.ones(len(leaves), bool)
    for _ in range(max_bits):
        levels.append(leaf_flags)
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        now, leaf_flags = both[by], by < len(leaves)
    need, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for flags in reversed(levels):
        c = int(flags[:need].sum())
        lengths[:c] += 1
        need = 2 * (need - c)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    bits = lengths[order].astype(np.int64)
    if len(order):
        steps = np.cumsum(np.left_shift(1, MAX_BITS - bits))  # as fractions of the code space
        codes[order] = np.concatenate([[0], steps[:-1]]) >> (MAX_BITS - bits)
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The bit stream of ids and the bit offset of each block of ids."""
    n = lengths[ids]
    ends = np.cumsum(n, dtype=np.int64)
    total = int(ends[-1]) if len(ids) else 0
    out = np.zeros((total >> 5) + 2, np.uint32)
    for lo in range(0, len(ids), 1 << 15):  # pieces that stay in cache
        k = n[lo : lo + (1 << 15)].astype(np.int64)
        pos = ends[lo : lo + (1 << 15)] - k
        base = int(pos[0]) >> 5
        word = (pos >> 5) - base
        v = codes[ids[lo : lo + (1 << 15)]].astype(np.uint64) << (64 - (pos & 31) - k).astype(np.uint64)
        size = int(word[-1]) + 2
        # bits never overlap, so sums stay below 2**32
        both = np.bincount(word, (v >> np.uint64(32)).astype(np.float64), size)
        both += np.bincount(word + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        out[base : base + size] |= both.astype(np.uint32)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], (ends - n)[::block].astype(np.int64)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = canonical(lengths)
    symbol, bits = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.left_shift(1, MAX_BITS - lengths[order].astype(np.int64))
    n = int(span.sum())
    assert n <= 1 << MAX_BITS and (not len(order) or int(codes[order[0]]) == 0)
    symbol[:n], bits[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbol, bits


def decode_bits(payload: bytes, checkpoints: np.ndarray, n_ids: int, table, block: int = BLOCK) -> np.ndarray:
    """The ids of a bit stream; all blocks advance one symbol at a time, together."""
    symbol, bits = table
    buf = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    wide = (buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:]
    out = np.empty((block, len(checkpoints)), np.uint32)
    pos, tail = checkpoints.copy(), n_ids - (len(checkpoints) - 1) * block
    for k in range(block):
        if k == tail:
            pos = pos[:-1]
        if not len(pos):
            break
        code = (wide[pos >> 3] >> (8 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        out[k, : len(pos)] = symbol[code]
        pos = pos + bits[code]
    return out.T.ravel()[:n_ids]


# ---------------------------------------------------------------- Spark


def _tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, at, seq = tokenizer_of(tokenizer), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        counts = np.zeros(max(tok.vocab, end_id + 1), np.int64)

        def flush():
            nonlocal at, seq
            ids = np.concatenate([x[2] for x in held])
            counts[:] += np.bincount(ids, minlength=len(counts))
            kind = np.uint16 if tok.vocab <= 1 << 16 else np.uint32
            row = [part, seq, at, len(ids), *(blob(np.concatenate([x[k] for x in held])) for k in (0, 3, 1)), blob(ids.astype(kind)), kind().itemsize, None]
            at, seq = at + len(ids), seq + 1
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=schema)

        names = ["part", "seq", "start_in_part", "n_ids", "doc_ids", "void", "lengths", "ids", "width", "counts"]
        schema = pa.schema([(n, pa.binary() if n in ("doc_ids", "void", "lengths", "ids", "counts") else pa.int64()) for n in names])
        for b in batches(it, 6 << 20):
            ids, per_doc = tok.encode(b.column(1), end_id)
            held.append((b.column(0).to_numpy(), per_doc, ids, b.column(2).to_numpy(zero_copy_only=False)))
            if sum(len(x[2]) for x in held) >= RUN_IDS:
                yield flush()
        if held:
            yield flush()
        if seq:  # one row for what the whole partition holds of each id
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": -1, "counts": blob(counts)}], schema=schema)

    return docs.mapInArrow(run, "part long, seq long, start_in_part long, n_ids long, doc_ids binary, void binary, lengths binary, ids binary, width long, counts binary")


def _counts(runs: DataFrame, vocab: int) -> np.ndarray:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(vocab, np.int64)
        for b in it:
            for x in b.column(0).to_pylist():
                c += np.frombuffer(x, np.int64)
        k = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c[k])], ["id", "n"])

    out = np.zeros(vocab, np.int64)
    own = runs.filter("seq = -1").select("counts")
    for r in own.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per id of the vocabulary at most
        out[r["id"]] = r["n"]
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Tokenise docs (doc_id, text) into Huffman-coded files under path, in ascending doc_id order."""
    from tokenizers import Tokenizer

    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    vocab = Tokenizer.from_file(tokenizer).get_vocab_size()
    source = texts_of(docs)
    # rows of one id, or without an id, are ranged by how their texts begin and by their place in the files
    order = ["doc_id", "void", "head", "row"]
    source = source.select("doc_id", "text", (~F.col("known")).alias("void"), "row", F.substring("text", 1, 64).alias("head"))
    ordered = source.repartitionByRange(fan_out(docs, 4), *order).sortWithinPartitions(*order).drop("head")
    plain = f"{path}-ids"
    _tokenise(ordered, tokenizer, end_id).write.option("compression", "zstd").parquet(plain)
    runs = spark.read.parquet(plain)
    counts = _counts(runs, max(vocab, end_id + 1))
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    book = T.StructType([T.StructField("id", T.LongType()), T.StructField("bits", T.IntegerType()), T.StructField("n", T.LongType())])
    spark.createDataFrame([(int(i), int(lengths[i]), int(counts[i])) for i in used], book).coalesce(1).write.parquet(f"{path}/codebook")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            coded = [encode_bits(np.frombuffer(x, f"u{w}"), lengths, codes) for x, w in zip(b["ids"].to_pylist(), b["width"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(b[k] for k in ("part", "seq", "start_in_part", "n_ids", "doc_ids", "void", "lengths")), pa.array([x[0] for x in coded], pa.binary()), pa.array([blob(x[1]) for x in coded], pa.binary())],
                ["part", "seq", "start_in_part", "n_ids", "doc_ids", "void", "lengths", "payload", "checkpoints"],
            )

    schema = "part long, seq long, start_in_part long, n_ids long, doc_ids binary, void binary, lengths binary, payload binary, checkpoints binary"
    runs.filter("seq >= 0").drop("counts").mapInArrow(run, schema).write.option("compression", "none").parquet(f"{path}/runs")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(plain)
    at.getFileSystem(conf).delete(at, True)


def read_token_files(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """Per document: doc_id, start, n_tokens and ids_crc32 (or ids, an array, without digest)."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # a row per id of the vocabulary at most
    lengths = np.zeros(max([0, *(r["id"] for r in book)]) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]
    table = spark.sparkContext.broadcast(decode_table(lengths))
    runs = spark.read.parquet(f"{path}/runs")
    parts = sorted(tuple(r) for r in runs.groupBy("part").agg(F.sum("n_ids")).collect())  # a row per file partition
    before = dict(zip((p for p, _ in parts), np.concatenate([[0], np.cumsum([n for _, n in parts])]).tolist()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                ids = decode_bits(r["payload"], np.frombuffer(r["checkpoints"], np.int64), r["n_ids"], table.value).astype("<u4")
                n = np.frombuffer(r["lengths"], np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids).cast("B")
                last = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())] if digest else [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist())]
                start = before[r["part"]] + r["start_in_part"] + ends - n
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], np.int64)), pa.array(~np.frombuffer(r["void"], bool)), pa.array(start), pa.array(n), pa.array(last, pa.int64() if digest else pa.list_(pa.int64()))], ["doc_id", "known", "start", "n_tokens", "x"])

    out = runs.mapInArrow(run, f"doc_id long, known boolean, start long, n_tokens long, x {'long' if digest else 'array<long>'}")
    return out.select(id_out(), "start", "n_tokens", F.col("x").alias("ids_crc32" if digest else "ids"))


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to a fresh folder in the shared folder, read the files back, digest each document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_files(docs, path, tokenizer)
    return read_token_files(spark, path)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"))
