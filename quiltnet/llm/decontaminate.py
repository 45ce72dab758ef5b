"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned over all windows.

Texts are folded (A-Z to lower case) and cut into words of letters, digits and bytes above 127. A
batch of documents is scanned at once: word hashes come from polynomial prefix sums, a window hash
combines ten of them, a bit table drops nearly all windows, and every hit is verified word by word
against the benchmark item before it counts. Nothing is shuffled.

The index is broadcast only where the benchmark has at most `block_bytes` of text, and then takes
about five times that. A larger benchmark stays a table of windows: documents send only those of
their windows that a bit table of 2 MB lets through, and a join verifies them.

Defined cases: null or empty text has no words and no hits; items without words never occur; items
with the same window all count; repeated rows are judged alike; texts of any length are scanned
whole; other columns, whatever their names, are kept or not read; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, MB, batches, read, stored, unused, utf8, window_hashes, with_row, word_bounds, word_hashes

WINDOW = 10
BLOCK_BYTES = 8 << 20
WORD = np.zeros(256, bool)
WORD[0x80:] = True
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
#: Bits of a window's hash that the tables in front of the index and of the join are addressed by.
_TABLE, _WIDE = 20, 24


class Windows:
    """The windows of some texts: for each length m, hash, first word and text of every window."""

    def __init__(self, column, window: int = WINDOW):
        raw, offsets = utf8(column)
        self.low, n = FOLD[raw].tobytes(), len(offsets) - 1
        self.starts, self.ends, row = word_bounds(raw, offsets, WORD)
        h = word_hashes(raw, self.starts, self.ends)
        n_words = np.bincount(row, minlength=n)
        first = np.cumsum(n_words) - n_words
        self.row, self.by = row, {}
        for m in np.unique(np.minimum(n_words[n_words > 0], window)).tolist():
            at = first[n_words == m] if m < window else np.flatnonzero(row[: max(0, len(h) - m + 1)] == row[m - 1 :])
            self.by[m] = window_hashes(h, m)[at], at

    def gram(self, i: int, m: int) -> bytes:
        return b" ".join(self.low[a:z] for a, z in zip(self.starts[i : i + m].tolist(), self.ends[i : i + m].tolist()))


class Index:
    """Benchmark windows by length: hashes in order with place and item, about 30 bytes a window, a bit
    table in front of them, and the folded text that hits are held against."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.names = [str(k) for k, _ in items]
        w = Windows(pa.array([t or "" for _, t in items], pa.large_string()), window)
        small = np.uint32 if len(w.low) < 1 << 32 else np.int64
        self.text, self.by = w, {}
        for m, (h, at) in w.by.items():
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order]
            fresh = self._fresh(h, at, m)
            h, at = h[fresh], at[fresh]
            bits = np.zeros(1 << _TABLE, bool)
            bits[h >> np.uint64(64 - _TABLE)] = True
            self.by[m] = bits, h, at.astype(small)
        w.starts, w.ends, w.row, w.by = w.starts.astype(small), w.ends.astype(small), w.row.astype(np.uint32), {}

    def _fresh(self, h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        """Without repeats of a window in one item; only runs of equal hashes are looked at."""
        keep = np.ones(len(h), bool)
        cut = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)] if len(h) else np.zeros(1, int)
        for k in np.flatnonzero(np.diff(cut) > 1).tolist():
            seen = set()
            for x in range(int(cut[k]), int(cut[k + 1])):
                key = (int(self.text.row[at[x]]), self.text.gram(int(at[x]), m))
                keep[x] = key not in seen
                seen.add(key)
        return keep

    def hits(self, low: bytes, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, hashes: np.ndarray):
        """Yield (first word, length, items) of each verified window."""
        for m, (bits, known, places) in self.by.items():
            h = window_hashes(hashes, m)
            k = np.flatnonzero(bits[h >> np.uint64(64 - _TABLE)])
            k = k[doc[k] == doc[k + m - 1]]
            lo, hi = np.searchsorted(known, h[k]), np.searchsorted(known, h[k], side="right")
            some = np.flatnonzero(hi > lo)
            for i, a, z in zip(k[some].tolist(), lo[some].tolist(), hi[some].tolist()):
                gram = b" ".join(low[x:y] for x, y in zip(starts[i : i + m].tolist(), ends[i : i + m].tolist()))
                items = [self.names[self.text.row[x]] for x in places[a:z].tolist() if self.text.gram(x, m) == gram]
                if items:
                    yield i, m, items


def _scan(column, find):
    """Per row of a text column: (bytes, offsets, word starts, word ends, row, hit mask, items) over the batch."""
    raw, offsets = utf8(column)
    s, e, doc = word_bounds(raw, offsets, WORD)
    edge = np.zeros(len(s) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for i, m, who in find(raw, s, e, doc):
        edge[i] += 1
        edge[i + m] -= 1
        items.setdefault(int(doc[i]), set()).update(who)
    return raw, offsets, s, e, doc, np.cumsum(edge[:-1]) > 0, items


def _window_table(bench: DataFrame, window: int) -> DataFrame:
    """(m, h, gram, item): the distinct windows of every item."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, MB):
            w = Windows(b.column(1), window)
            for m, (h, at) in w.by.items():
                names = b.column(0).take(pa.array(w.row[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), m)), pa.array(h.view(np.int64)), pa.array([w.gram(i, m) for i in at.tolist()], pa.binary()), names], ["m", "h", "gram", "item"])

    cols = bench.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return cols.mapInArrow(run, "m long, h long, gram binary, item string").distinct()


def _by_join(docs: DataFrame, bench: DataFrame, window: int, row: str, hits: str) -> DataFrame:
    """docs (numbered by `row`) with a column of verified windows (first word, length, item), for a benchmark of
    any size: a bit table of fixed size picks document windows, and these alone meet the windows of the benchmark."""
    table = stored(_window_table(bench, window), "benchmark-windows")
    lengths = sorted(r["m"] for r in table.select("m").distinct().collect())  # `window` lengths at most
    bits = np.zeros(1 << _WIDE, bool)
    slot = F.shiftrightunsigned("h", 64 - _WIDE)
    for r in table.groupBy(F.shiftright(slot, 6).alias("s")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - _WIDE}) & 63 as int))")).alias("w")).toLocalIterator():  # 2**18 words at most
        bits[r["s"] * 64 : r["s"] * 64 + 64] = (r["w"] >> np.arange(64)) & 1
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))  # 2 MB

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for b in batches(it, MB):
            raw, offsets = utf8(b.column(1))
            s, e, doc = word_bounds(raw, offsets, WORD)
            hashes, low = word_hashes(raw, s, e), FOLD[raw].tobytes()
            first = np.searchsorted(doc, np.arange(b.num_rows))
            for m in lengths:
                h = window_hashes(hashes, m)
                k = np.flatnonzero(known[h >> np.uint64(64 - _WIDE)])
                k = k[doc[k] == doc[k + m - 1]]
                if len(k):
                    grams = [b" ".join(low[x:y] for x, y in zip(s[i : i + m].tolist(), e[i : i + m].tolist())) for i in k.tolist()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc[k])), pa.array(k - first[doc[k]]), pa.array(np.full(len(k), m)), pa.array(h[k].view(np.int64)), pa.array(grams, pa.binary())], ["row", "at", "m", "h", "gram"])

    texts = docs.select(F.col(row).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seen = texts.mapInArrow(run, "row long, at long, m long, h long, gram binary").join(table, ["m", "h", "gram"])
    per = stored(seen.groupBy("row").agg(F.collect_list(F.struct("at", "m", "item")).alias(hits)), "benchmark-hits").withColumnRenamed("row", row)  # of one document
    return docs.join(per, row, "left")


def _lookup(docs: DataFrame, bench: DataFrame, window: int, block_bytes: int):
    """(table, scan): scan(batch, texts) of the table's batches tells hits and items, see _scan.

    A benchmark of at most block_bytes of text is broadcast as an index; a larger one is joined."""
    size = bench.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    if size <= block_bytes:
        items = [(r["item_id"], r["text"]) for r in bench.select("item_id", "text").filter(F.col("text").isNotNull()).collect()]  # block_bytes at most
        shared = docs.sparkSession.sparkContext.broadcast(Index(items, window))

        def scan(b: pa.RecordBatch, column):
            return _scan(column, lambda raw, s, e, doc: shared.value.hits(FOLD[raw].tobytes(), s, e, doc, word_hashes(raw, s, e)))

        return docs, scan
    row, hits = unused(docs, "row", "hits")
    table = _by_join(with_row(docs, row), bench, window, row, hits).select(*docs.columns, hits)
    at = len(docs.columns)

    def scan(b: pa.RecordBatch, column):
        def find(raw, s, e, doc):
            first = np.searchsorted(doc, np.arange(b.num_rows))
            for i, found in enumerate(b.column(at).to_pylist()):
                for x in found or ():
                    yield int(first[i]) + x["at"], x["m"], [x["item"]]

        return _scan(column, find)

    return table, scan


_DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated."""
    (i, t) = ("doc_id", "text")
    src, scan = _lookup(docs.select(i, t), bench, window, block_bytes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, MB):
            _, _, s, _, doc, hit, items = scan(b, b.column(1).fill_null(""))
            n = b.num_rows
            n_hit = np.bincount(doc[hit], minlength=n)
            names = [sorted(items.get(i, ())) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(np.bincount(doc, minlength=n), pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]), pa.array(n_hit > 0),
                ],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return src.withColumns({i: F.col(i).cast("long"), t: F.col(t).cast("string")}).mapInArrow(run, _DIGEST)


def decontaminate(docs: DataFrame, bench: DataFrame, drop_share: float = 0.5, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without benchmark passages: hit spans are cut out, and a document goes entirely once
    more than drop_share of its words are hit. All columns stay; n_chars, if there, follows the text."""
    table, scan = _lookup(docs, bench, window, block_bytes)
    names = docs.columns
    ti = names.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, MB):
            col = b.column(ti)
            raw, offsets, s, e, doc, hit, _ = scan(b, col.fill_null(""))
            b = b.select(names)
            n_words, n_hit = np.bincount(doc, minlength=b.num_rows), np.bincount(doc[hit], minlength=b.num_rows)
            dirty = np.flatnonzero(n_hit)
            if len(dirty):
                texts = col.to_pylist()
                for i in dirty.tolist():
                    lo, hi = np.searchsorted(doc, [i, i + 1])
                    h = np.flatnonzero(hit[lo:hi])
                    cut = np.flatnonzero(np.diff(h) > 1)
                    first, last = h[np.r_[0, cut + 1]] + lo, h[np.r_[cut, len(h) - 1]] + lo
                    own, at, kept = raw[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                    for a, z in zip(s[first] - offsets[i], e[last] - offsets[i]):
                        kept.append(own[at:a])
                        at = int(z)
                    texts[i] = b"".join([*kept, own[at:]]).decode()
                b = b.set_column(ti, b.schema.field(ti), pa.array(texts, b.schema.field(ti).type))
                if "n_chars" in names:
                    k = names.index("n_chars")
                    chars = np.where(n_hit > 0, [len(x or "") for x in texts], 0)
                    old = b.column(k).to_pylist()
                    b = b.set_column(k, b.schema.field(k), pa.array([int(c) if d else o for c, d, o in zip(chars, n_hit, old)], b.schema.field(k).type))
            keep = n_hit <= drop_share * n_words
            yield b if keep.all() else b.filter(pa.array(keep))

    return table.mapInArrow(run, docs.schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP8_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
bw AS (SELECT item_id, least(len(ws), {WINDOW}) AS m, ws, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS i FROM b WHERE len(ws) > 0),
grams AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS gram FROM bw),
sizes AS (SELECT DISTINCT m FROM grams),
d AS (SELECT doc_id, {_WORDS_SQL} AS ws FROM documents),
dw AS (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes WHERE len(ws) >= m),
dg AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS gram FROM dw),
hits AS (SELECT doc_id, i, m, item_id FROM dg JOIN grams USING (m, gram)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
