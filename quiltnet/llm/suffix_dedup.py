"""Exact substring removal by two-stage suffix sorting.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller
doc_id. The work is cut so that suffixes which may share such a string meet in one bucket:

1. Rows are dealt into groups once, by their place in the files, so that neither copies nor null
   ids meet in one (a single exchange of the texts that all later steps reuse). In every string of `length` bytes the smallest hash of its 28-byte substrings names its
   anchor; equal strings have equal anchors. A group sends the hashes of its anchors, each once.
2. Hash buckets answer which anchors occur in two documents or more, as bit masks.
3. A group sends the strings with shared anchors, run together to segments by a second anchor of
   12 bytes that also names the bucket: every distinct segment once, with the smallest and the
   largest doc_id that have it.
4. A bucket sorts the suffixes of its distinct segments by the two-stage method: suffixes smaller
   than their successors are sorted directly, the rest are induced by scanning the buckets of
   first bytes in order. Adjacent common prefixes of at least `length` bytes give the classes of equal
   strings, and the class its smallest document. Back go the runs of each segment by that document.
5. A group finds its segments again and takes, for each place where one occurs, the runs whose first
   document is smaller; it unites the spans.

Hashes only decide what meets where; equality is decided by the sorted bytes. Passages that all
documents share are sent once per group, whatever the number of copies in it.

Defined cases: null text is empty; texts shorter than `length` lose nothing; rows with one doc_id
never delete from each other; a null doc_id compares like the largest long; texts of any length are
whole in one group; repeated rows are documents of one doc_id; other columns, whatever their names, are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, _bytes_to_64, blob, fan_out, group_count, id_out, mix, read, stored, texts_of, utf8

LENGTH = 50
KMER = 28
SHORT = 12
_PIECE = 1 << 20


# ---------------------------------------------------------------- anchors


def _kmer_hashes(raw: np.ndarray, kmer: int) -> np.ndarray:
    """A 64-bit hash of the kmer bytes at each position, put together from powers of two."""
    h, size, power = _bytes_to_64[raw], 1, BASE
    n, out, done = len(raw) - kmer + 1, None, 0
    while True:
        if kmer & size:  # bytes `done` to `done + size` of each substring
            part = h[done : done + n]
            out = part if out is None else out * power + part
            done += size
        if size * 2 > kmer:
            return mix(out)
        h = h[:-size] * power + h[size:]
        power, size = np.multiply(power, power), size * 2


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string start p (a whole string fits its document): p, its anchor's place, its hash."""
    w = length - kmer + 1
    starts, places, hashes = [], [], []
    for lo in range(0, max(0, len(raw) - length + 1), _PIECE):
        hi = min(len(raw) - length + 1, lo + _PIECE)
        h = _kmer_hashes(raw[lo : hi + length - 1], kmer)
        key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= w:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < w:
            key = np.minimum(key[: hi - lo], key[w - size : w - size + hi - lo])
        at = (key[: hi - lo] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts.append(np.arange(lo, hi))
        places.append(at + lo)
        hashes.append(h[at])
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    p, a, h = map(np.concatenate, (starts, places, hashes))
    fits = np.ones(len(p), bool)
    edge = np.zeros(len(raw) + 1, np.int32)  # starts whose string would cross a document's end
    first = np.maximum(offsets[1:-1] - length + 1, 0)
    np.add.at(edge, first, 1)
    np.add.at(edge, offsets[1:-1], -1)
    fits = np.cumsum(edge)[: len(p)] == 0
    return p[fits], a[fits], h[fits]


def _short_anchors(raw: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the anchor of SHORT bytes for each of some string starts; only their bytes are hashed."""
    if not len(p):
        return p, np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.diff(p) != 1) + 1
    first, count = p[np.r_[0, edge]], np.diff(np.r_[0, edge, len(p)])
    size = count + length - 1
    ends = np.cumsum(size)
    part = raw[np.repeat(first - ends + size, size) + np.arange(ends[-1])]
    _, place, h = anchors(part, np.r_[0, ends], length, SHORT)
    return place + np.repeat(first - ends + size, count), h


class Group:
    """The documents of one group in a fixed order, with their anchors."""

    def __init__(self, table: pa.Table, n_buckets: int, length: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table["doc_id"].to_numpy()
        self.raw, self.offsets = utf8(table["text"])
        self.length = length
        self.p, a, h = anchors(self.raw, self.offsets, length)
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        self.first = np.flatnonzero(new)  # of each segment: its first start
        self.hash = h[self.first]
        self.n_starts = np.diff(np.r_[self.first, len(a)])
        self.doc = np.searchsorted(self.offsets, self.p[self.first], side="right") - 1
        self.n_buckets = n_buckets

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.n_buckets) >> np.uint64(32)).astype(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes in order, whether two documents here have each, and each segment's index."""
        if not len(self.hash):
            return self.hash, np.zeros(0, bool), np.zeros(0, np.int64)
        u, inverse = np.unique(self.hash, return_inverse=True)
        ids = self.ids[self.doc]
        low, high = np.full(len(u), np.iinfo(np.int64).max), np.full(len(u), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        return u, low != high, inverse


def _send_anchors(n_buckets: int, length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = Group(table.select(["doc_id", "text"]), n_buckets, length)
        u, multi, _ = g.distinct()
        b = g.bucket(u)
        cut = np.flatnonzero(np.diff(b)) + 1
        lo, hi = np.r_[0, cut].astype(int), np.r_[cut, len(u)].astype(int)
        if not len(u):
            lo = hi = np.zeros(0, int)
        low = u.astype(np.uint32)
        return pa.table(
            {
                "bucket": pa.array(b[lo] if len(u) else [], pa.int64()),
                "g": pa.array([key[0].as_py()] * len(lo), pa.int64()),
                "keys": pa.array([blob(low[x:y]) for x, y in zip(lo, hi)], pa.binary()),
                "multi": pa.array([blob(np.packbits(multi[x:y])) for x, y in zip(lo, hi)], pa.binary()),
            }
        )

    return run


def _mark_shared(table: pa.Table) -> pa.Table:
    keys = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    multi = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table["multi"].to_pylist(), keys)]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    s = every[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[start, len(s)])
    some = np.add.reduceat(np.concatenate(multi)[order].astype(np.int64), start) > 0
    shared = np.empty(len(s), bool)
    shared[order] = np.repeat((size > 1) | some, size)
    ends = np.cumsum([len(k) for k in keys])
    masks = [blob(np.packbits(shared[e - len(k) : e])) for e, k in zip(ends, keys)]
    return pa.table({"g": table["g"], "bucket": table["bucket"], "mask": pa.array(masks, pa.binary())})


_SEGMENTS = "bucket long, g long, content binary, lengths binary, least binary, most binary"


class Shared:
    """The strings of a group whose anchors are shared, as segments by bucket. Segments with equal bytes in a bucket are
    one; `own` numbers these over all buckets, `first` tells where each bucket's numbers start."""

    def __init__(self, g: Group, masks: list[tuple[int, bytes]]):
        u, _, inverse = g.distinct()
        b = g.bucket(u)
        shared = np.zeros(len(u), bool)
        for k, m in sorted(masks):
            lo, hi = np.searchsorted(b, [k, k + 1])
            shared[lo:hi] = np.unpackbits(np.frombuffer(m, np.uint8), count=hi - lo)
        # shared starts, cut anew by anchors of fewer bytes: longer segments overlap less
        p = g.p[np.repeat(shared[inverse], g.n_starts)]
        place2, hash2 = _short_anchors(g.raw, p, g.length)
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1] + 1) | (place2[1:] != place2[:-1])
        seg = np.flatnonzero(new)
        where = g.bucket(hash2[seg])
        start, count = p[seg], np.diff(np.r_[seg, len(p)])
        order = np.argsort(where, kind="stable")
        where, self.start, count = where[order], start[order], count[order]
        end = self.start + count + g.length - 1
        self.doc = np.searchsorted(g.offsets, self.start, side="right") - 1
        whole = g.raw.tobytes()
        cut = np.r_[0, np.flatnonzero(np.diff(where)) + 1, len(where)] if len(where) else np.zeros(1, int)
        self.buckets, self.own = where[cut[:-1]], np.zeros(len(where), np.int64)
        self.contents: list[list[bytes]] = []
        first, n = [0], 0
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
            place: dict[bytes, int] = {}
            self.own[x:y] = np.fromiter((place.setdefault(whole[s:e], len(place)) for s, e in zip(self.start[x:y].tolist(), end[x:y].tolist())), np.int64, y - x) + n
            self.contents.append(list(place))
            n += len(place)
            first.append(n)
        self.first = np.array(first, np.int64)


def _send_segments(n_buckets: int, length: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, masks: pa.Table) -> pa.Table:
        rows: dict[str, list] = {c.split()[0]: [] for c in _SEGMENTS.split(", ")}
        schema = pa.schema([(c, pa.int64() if c in ("bucket", "g") else pa.binary()) for c in rows])
        if not masks.num_rows or not table.num_rows:
            return pa.table(rows, schema)
        g = Group(table.select(["doc_id", "text"]), n_buckets, length)
        s = Shared(g, list(zip(masks["bucket"].to_pylist(), masks["mask"].to_pylist())))
        least, most = np.full(s.first[-1], np.iinfo(np.int64).max), np.full(s.first[-1], np.iinfo(np.int64).min)
        np.minimum.at(least, s.own, g.ids[s.doc])
        np.maximum.at(most, s.own, g.ids[s.doc])
        for k, content, x, y in zip(s.buckets.tolist(), s.contents, s.first[:-1].tolist(), s.first[1:].tolist()):
            rows["bucket"].append(k)
            rows["g"].append(key[0].as_py())
            rows["content"].append(b"".join(content))
            rows["lengths"].append(blob(np.fromiter(map(len, content), np.uint16, len(content))))
            rows["least"].append(blob(least[x:y]))
            rows["most"].append(blob(most[x:y]))
        return pa.table(rows, schema)

    return run


# ---------------------------------------------------------------- suffix sorting


def _words(t: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number; zeros follow the end."""
    w = np.concatenate([t, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        w = (w[:-size] << np.uint64(8 * size)) | w[size:]
    return w


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than its successor."""
    change = np.flatnonzero(t[1:] != t[:-1])
    runs = np.diff(np.r_[-1, change])
    out = np.zeros(len(t), bool)  # the last run: each suffix has its successor as a prefix
    out[: int(runs.sum())] = np.repeat(t[change] < t[change + 1], runs)
    return out


def suffix_array(t: np.ndarray, depth: int, w: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of t in order of their first `depth` bytes, by two-stage sorting."""
    if not len(t):
        return np.zeros(0, np.int64)
    w = _words(t, depth) if w is None else w
    s = np.flatnonzero(smaller_than_next(t))
    # stage 1: sort the smaller-than-successor suffixes directly, 8 bytes at a time, ties only
    s = s[np.argsort(w[s])]
    new = np.ones(len(s), bool)
    new[1:] = w[s[1:]] != w[s[:-1]]
    for off in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        k = np.flatnonzero(tied)
        if not len(k):
            break
        group, key = np.cumsum(new)[k], w[s[k] + off]
        order = np.lexsort((key, group))
        s[k] = s[k][order]
        key = key[order]
        new[k[1:]] |= key[1:] != key[:-1]
    # stage 2: scan the buckets of first bytes in order; each suffix places its larger predecessor
    place = np.searchsorted(t[s], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([len(t) - 1]))
    out = []
    for c in range(256):
        now = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        parts = []
        while len(now):
            parts.append(now)
            before = now[now > 0] - 1
            now = before[t[before] == c]
        parts.append(s[place[c] : place[c + 1]])
        seq = np.concatenate(parts)
        if not len(seq):
            continue
        out.append(seq)
        before = seq[seq > 0] - 1
        first = t[before]
        before, first = before[first > c], first[first > c]
        before = before[np.argsort(first, kind="stable")]
        at = np.r_[0, np.cumsum(np.bincount(first, minlength=256))]
        for d in np.unique(first).tolist():
            waiting[d].append(before[at[d] : at[d + 1]])
    return np.concatenate(out)


def adjacent_prefixes(w: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in sa (0 for the first), cap at most."""
    out = np.full(len(sa), cap, np.int64)
    out[:1] = 0
    rest = np.arange(1, len(sa))
    for off in range(0, cap, 8):
        diff = w[sa[rest] + off] ^ w[sa[rest - 1] + off]
        differ = diff != 0
        d, k = diff[differ], rest[differ]
        same = np.zeros(len(d), np.int64)
        for shift in range(56, 0, -8):
            same += (d >> np.uint64(shift)) == 0
        out[k] = np.minimum(cap, off + same)
        rest = rest[~differ]
    return out


def _find_repeats(length: int):
    def run(table: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        least, most, parts = [], [], []
        for r in range(table.num_rows):
            get = lambda name, kind: np.frombuffer(table[name][r].as_py(), kind)  # noqa: E731,B023
            ends = np.cumsum(get("lengths", np.uint16).astype(np.int64))
            content = table["content"][r].as_py()
            own = np.fromiter((place.setdefault(content[a:b], len(place)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())), np.int64, len(ends))
            least.append((own, get("least", np.int64)))
            most.append(get("most", np.int64))
            parts.append(np.full(len(own), r))
        low = np.full(len(place), np.iinfo(np.int64).max)
        for own, ids in least:
            np.minimum.at(low, own, ids)
        sizes = np.fromiter(map(len, place), np.int64, len(place))
        t = np.frombuffer(b"".join(place), np.uint8)
        begin = np.cumsum(sizes) - sizes
        w = _words(t, length + 8)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        valid = np.arange(len(t)) - begin[owner] <= sizes[owner] - length
        sa = suffix_array(t, length, w)
        sa = sa[valid[sa]]
        same = adjacent_prefixes(w, sa, length) >= length
        start = np.flatnonzero(~same)
        least_of = np.minimum.reduceat(low[owner[sa]], start) if len(sa) else low[:0]
        first_doc = np.full(len(t), np.iinfo(np.int64).max)
        first_doc[sa] = np.repeat(least_of, np.diff(np.r_[start, len(sa)]))
        # runs of string starts in a segment with the same first document
        v = np.flatnonzero(valid)
        edge = np.ones(len(v), bool)
        edge[1:] = (first_doc[v[1:]] != first_doc[v[:-1]]) | (owner[v[1:]] != owner[v[:-1]])
        rs = np.flatnonzero(edge)
        run_at, run_n, run_doc = v[rs] - begin[owner[v[rs]]], np.diff(np.r_[rs, len(v)]), first_doc[v[rs]]
        run_first = np.searchsorted(owner[v[rs]], np.arange(len(sizes) + 1))
        # each group gets the runs of its segments of which one of its documents is not the first
        src, seg, last = np.concatenate(parts), np.concatenate([own for own, _ in least]), np.concatenate(most)
        local = np.arange(len(seg)) - np.searchsorted(src, src)
        n_runs = np.diff(run_first)[seg]
        o = np.repeat(np.arange(len(seg)), n_runs)
        k = np.arange(len(o)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + run_first[seg[o]]
        hit = run_doc[k] < last[o]
        o, k = o[hit], k[hit]
        cut = np.searchsorted(src[o], np.arange(table.num_rows + 1))
        some = np.flatnonzero(np.diff(cut))
        g, bucket = table["g"].to_pylist(), table["bucket"].to_pylist()
        pack = lambda x, kind: pa.array([blob(x[cut[r] : cut[r + 1]].astype(kind)) for r in some], pa.binary())
        return pa.table(
            {
                "g": pa.array([g[r] for r in some], pa.int64()), "bucket": pa.array([bucket[r] for r in some], pa.int64()),
                "segments": pack(local[o], np.uint32), "starts": pack(run_at[k], np.uint16), "counts": pack(run_n[k], np.uint16), "docs": pack(run_doc[k], np.int64),
            }
        )

    return run


# ---------------------------------------------------------------- documents


def _gone(g: Group, messages: list[dict]) -> np.ndarray:
    """Which bytes of a group go: every occurrence of a segment takes the runs whose first document has a smaller id."""
    edge = np.zeros(len(g.raw) + 1, np.int32)
    runs = [m for m in messages if m["segments"] is not None]
    if runs:
        s = Shared(g, [(m["bucket"], m["mask"]) for m in messages if m["mask"] is not None])
        base = s.first[np.searchsorted(s.buckets, [m["bucket"] for m in runs])]
        get = lambda name, kind: np.concatenate([np.frombuffer(m[name], kind) for m in runs]).astype(np.int64)
        seg = get("segments", np.uint32) + np.repeat(base, [len(m["segments"]) // 4 for m in runs])
        at, count, doc = get("starts", np.uint16), get("counts", np.uint16), get("docs", np.int64)
        order = np.argsort(seg, kind="stable")
        seg, at, count, doc = (x[order] for x in (seg, at, count, doc))
        first = np.searchsorted(seg, np.arange(s.first[-1] + 1))
        n = np.diff(first)[s.own]
        o = np.repeat(np.arange(len(s.own)), n)
        k = np.arange(len(o)) - np.repeat(np.cumsum(n) - n, n) + first[s.own[o]]
        hit = doc[k] < g.ids[s.doc[o]]
        o, k = o[hit], k[hit]
        a = s.start[o] + at[k]
        np.add.at(edge, a, 1)
        np.add.at(edge, a + count[k] + g.length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(n_buckets: int, length: int, with_text: bool):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table, messages: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        messages = messages.to_pylist()
        if any(m["segments"] is not None for m in messages):
            g = Group(table.select(["doc_id", "text"]), n_buckets, length)
            raw, offsets, gone = g.raw, g.offsets, _gone(g, messages)
        else:
            raw, offsets = utf8(table["text"])
            gone = np.zeros(len(raw), bool)
        lengths = np.diff(offsets)
        row = np.repeat(np.arange(len(lengths)), lengths)
        removed = np.bincount(row[gone], minlength=len(lengths))
        first = gone.copy()
        first[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
        n_spans = np.bincount(row[first], minlength=len(lengths))
        kept = raw[~gone].tobytes()
        ends = np.cumsum(lengths - removed)
        texts = [kept[e - n : e] for e, n in zip(ends.tolist(), (lengths - removed).tolist())]
        out = {
            "doc_id": table["doc_id"], "known": table["known"], "n_bytes": pa.array(lengths), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
        }
        return pa.table(out | ({"kept": pa.array(texts, pa.binary())} if with_text else {}))

    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes)."""
    if length < KMER + 1:
        raise ValueError(f"length is {KMER + 1} bytes at least")
    source = texts_of(docs)
    n_parts = fan_out(docs)
    n_groups, n_buckets = group_count(docs, n_parts), 4 * n_parts
    dealt = source.select("doc_id", "text", "known", F.pmod("row", F.lit(n_groups)).alias("g")).repartition(n_parts, "g")
    keys = dealt.groupBy("g").applyInArrow(_send_anchors(n_buckets, length), "bucket long, g long, keys binary, multi binary")
    masks = stored(keys.groupBy("bucket").applyInArrow(_mark_shared, "g long, bucket long, mask binary"), "suffix-masks", few=True)
    segments = dealt.groupBy("g").cogroup(masks.groupBy("g")).applyInArrow(_send_segments(n_buckets, length), _SEGMENTS)
    spans = segments.groupBy("bucket").applyInArrow(_find_repeats(length), "g long, bucket long, segments binary, starts binary, counts binary, docs binary")
    messages = masks.unionByName(spans, allowMissingColumns=True)
    schema = "doc_id long, known boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = dealt.groupBy("g").cogroup(messages.groupBy("g")).applyInArrow(_cut(n_buckets, length, with_text), schema)
    return out.select(id_out(), *[c for c in out.columns if c not in ("doc_id", "known")])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))
