"""What the training-data operators share: shared-folder tables, group keys and numpy word scanning.

Workers receive Arrow batches and scan the UTF-8 buffers of a whole batch at once; there is no
Python loop over words. All 64-bit arithmetic wraps on purpose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path, shared_dir, stored  # noqa: F401

#: Stands for a null doc_id in comparisons inside the operators; a column `known` tells it from a real id of that value.
NULL_ID = 2**63 - 1
MB = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a file scan it is the size of the files, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fan_out(df: DataFrame, mb: int = 2) -> int:
    """Partitions for a whole-text exchange of table df: about `mb` of file each, up to 128 MB on huge inputs."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    if size >= 1 << 60:  # not a file scan: unknown
        return max(least, df.rdd.getNumPartitions())
    return max(least, min(size // (mb * MB), max(2000, size // (128 * MB))))


def group_count(df: DataFrame, n_parts: int, mb: int = 1) -> int:
    """Groups of whole texts for workers that hold one group at a time: about `mb` of file each at every size,
    however much of the table a partition takes, and two a partition at least."""
    size = estimated_bytes(df)
    return max(2 * n_parts, size // (mb * MB) if size < 1 << 60 else 0)


def with_row(docs: DataFrame, name: str = "row") -> DataFrame:
    """docs with a number that names each row of its files, whatever its contents: rows that are equal in
    all columns, and rows without an id, can be dealt apart by it, and every scan gives a row the same
    number again, however the files are split. A table that is no plain file scan is stored first.
    """
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select("*", F.xxhash64(at["file_path"], at["row_index"]).alias(name))
    except AnalysisException:
        docs = stored(docs, "rows")
    at = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(at["file_path"], at["row_index"]).alias(name))


def texts_of(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, text, known, row) with nulls replaced; whatever else the table holds is dropped here.

    row: the column of with_row, where docs has been through it."""
    if row is None:
        (row,) = unused(docs, "row")
        docs = with_row(docs, row)
    i = docs["doc_id"].cast("long")
    return docs.select(F.coalesce(i, F.lit(NULL_ID)).alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), i.isNotNull().alias("known"), docs[row].alias("row"))


def row_key(text="text"):
    """With doc_id, tells the rows of a table apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names like the wanted ones that no column of docs has, however it is capitalised."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def id_out(name: str = "doc_id", known: str = "known"):
    return F.when(F.col(known), F.col(name)).alias(name)


# ---------------------------------------------------------------- bytes and words in numpy


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: White space for words: the space and the control characters 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def word_bounds(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a maximal run of bytes with is_word, cut at row borders."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = is_word[raw]
    first = np.empty(n, bool)
    first[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0], done, step = 1, 1, base
        while done < size:
            np.multiply(have[:done], step, out=have[done : 2 * done])
            done *= 2
            step = np.multiply(step, step)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_bytes_to_64 = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from polynomial prefix sums taken block by block."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, lo + block)))
        hi = int(ends[to - 1])
        part = raw[lo:hi]
        v = _bytes_to_64[FOLD[part] if fold else part]
        prefix = np.empty(hi - lo + 1, np.uint64)
        prefix[0] = 0
        np.cumsum(v * powers(BASE, hi - lo), out=prefix[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((prefix[e] - prefix[s]) * powers(INVERSE, hi - lo + 1)[s] + (e - s).astype(np.uint64))
        at = to
    return out


def window_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """A hash for each run of m consecutive word hashes (by position, across rows as well)."""
    n = max(0, len(words) - m + 1)
    h = np.zeros(n, np.uint64)
    for j in range(m):
        h = h * BASE + words[j : j + n]
    return mix(h)


def batches(it: Iterator[pa.RecordBatch], max_bytes: int = 2 * MB) -> Iterator[pa.RecordBatch]:
    """Cut incoming batches so that each holds about max_bytes of text (one row at least)."""
    for b in it:
        size = b.nbytes
        if size <= max_bytes or b.num_rows <= 1:
            if b.num_rows:
                yield b
            continue
        lengths = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                _, offs, _ = c.buffers()
                o = np.frombuffer(offs, np.int32)[c.offset : c.offset + len(c) + 1]
                lengths += np.diff(o)
        ends = np.cumsum(lengths)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield b.slice(at, to - at)
            at = to


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def by_task(df: DataFrame, f, schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)
