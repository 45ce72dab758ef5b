"""N-gram Jaccard join by grouped prefix filtering.

Documents are sets of 5-word shingles. With shingles in one global order, rare first, two sets of
Jaccard similarity t share an element of their prefixes (n - ceil(t n) + 1 elements). Documents of
equal size and prefix form one group, which is filtered once for all members:

1. A sketch sized by the table counts shingles over the corpus and gives the order.
2. Every document gets its size, a signature of its set and its prefix. Equal sets become one class
   with its smallest document, classes of equal size and prefix one group.
3. Groups post their prefixes to hash buckets. Neighbours by size within a posting, as far as sizes
   allow a link, give candidate edges; each bucket sends a forest of these.
4. Components of candidate edges are blocks. Groups are expanded to classes, and a block is cut
   into cells of CELL classes; each pair of cells is verified on its own, by exact set
   intersections from one blocked matrix product. No posting or block is ever expanded into pairs
   of rows, and no linked pair lies outside a pair of cells.
5. Components of the verified links, and links counted with copies, go back to the documents.

Rows are told apart by their place in the files, so copies and rows without an id are never joined by
anything they share: only the one row that stands for a class sends its text.

Defined cases: with fewer than five words the whole sequence is the one shingle; null, empty and
wordless texts have an empty set, link with nothing and are their own component; repeated rows are
copies; a null doc_id counts as larger than all others; texts of any length are whole sets; other
columns, whatever their names, are kept or not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, batches, blob, estimated_bytes, fan_out, id_out, mix, read, row_key, stored, texts_of, unused, utf8, window_hashes, with_row, word_bounds, word_hashes
from .components import connected_components, local_roots

WORDS = 5
PERCENT = 80
#: The fewest and most bits of a sketch's cells, and bytes of file for a cell.
SKETCH_BITS = (18, 25)
CELL_BYTES = 32
CELL = 256
#: Counters of a set by hash; their overlap bounds the overlap of two sets from above.
CELLS = 256


def shingle_sets(column, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row of each, size per row): the distinct shingles of each text, in order of row and hash."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    s, e, doc = word_bounds(raw, offsets, ~SPACES)
    h = word_hashes(raw, s, e)
    n_words = np.bincount(doc, minlength=n)
    first = np.cumsum(n_words) - n_words
    full = window_hashes(h, words)
    own = doc[: len(full)]
    ok = own == doc[words - 1 : words - 1 + len(full)]
    hashes, rows = [full[ok]], [own[ok]]
    for m in range(1, words):
        k = np.flatnonzero(n_words == m)
        if len(k):
            hashes.append(window_hashes(h, m)[first[k]])
            rows.append(k)
    x, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    x, r = x[new], r[new]
    return x, r, np.bincount(r, minlength=n)


def _sketch_bits(docs: DataFrame) -> int:
    """Bits of the sketch's cells: about one cell for CELL_BYTES of file. A cell that many shingles share tells nothing of
    how rare any of them is; prefixes then hold common shingles, and candidates grow into blocks of unrelated sets."""
    size = estimated_bytes(docs)
    if size >= 1 << 60:  # not a file scan: unknown
        return 22
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], (size // CELL_BYTES).bit_length()))


def _packed(counts: np.ndarray) -> bytes:
    """A task's counts, most of them 0 or 1 in a sketch that grows with the table: less than a bit for a cell."""
    planes = np.unpackbits(counts.view(np.uint8).reshape(len(counts), -1), axis=1).T
    return pa.compress(blob(np.packbits(planes, axis=1)), codec="zstd", asbytes=True)


def _unpacked(packed, width: int, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=width * n, codec="zstd"), np.uint8).reshape(8 * width, -1)
    return np.packbits(np.unpackbits(planes, axis=1).T, axis=1).reshape(-1).view(f"u{width}")


def _narrow(spread: np.ndarray) -> bytes:
    """Counters of one set, a byte each where all fit one, else four."""
    return blob(spread.astype(np.uint8) if spread.max(initial=0) < 1 << 8 else spread)


def _counters(column: list) -> np.ndarray:
    """The rows of _narrow again, in one width."""
    size = np.fromiter(map(len, column), np.int64, len(column))
    out = np.zeros((len(column), CELLS), np.uint8 if (size == CELLS).all() else np.uint32)
    for kind in (np.uint8, np.uint32):
        k = np.flatnonzero(size == CELLS * kind().itemsize)
        if len(k):
            out[k] = np.frombuffer(b"".join([column[i] for i in k.tolist()]), kind).reshape(-1, CELLS)
    return out


def _sketch(texts: DataFrame, words: int, bits: int = SKETCH_BITS[0]) -> np.ndarray:
    """How many documents have a shingle in each of 2**bits cells, as levels 8 * log2(1 + count) of one byte."""
    cells, span = 1 << bits, 1 << 16

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(cells, np.uint32)
        for b in batches(it, 4 << 20):
            x, _, _ = shingle_sets(b.column(0), words)
            np.add.at(c, (x >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        for k, part in enumerate(c.reshape(-1, span)):
            most = part.max()
            if most:
                kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_packed(part.astype(kind))], pa.binary()), pa.array([kind().itemsize], pa.int64())], ["slice", "counts", "width"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(span, np.int64)
        for x, w in zip(table["counts"], table["width"].to_pylist()):
            total += _unpacked(x.as_buffer(), w, span)
        level = np.minimum(np.rint(8 * np.log2(1.0 + total)), 255).astype(np.uint8)
        return pa.table({"slice": table["slice"][:1], "levels": pa.array([blob(level)], pa.binary())})

    summed = texts.select("text").mapInArrow(run, "slice long, counts binary, width long").groupBy("slice").applyInArrow(add, "slice long, levels binary")
    out = np.zeros((cells // span, span), np.uint8)
    for r in summed.toLocalIterator():  # 2**(bits - 16) rows of 64 KB
        out[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


_SETS = "doc_id long, known boolean, tag long, row long, n long, s1 long, s2 long, p1 long, prefix binary, cells binary"


def _signed(texts: DataFrame, order, words: int, percent: int, bits: int) -> DataFrame:
    """Per document its set size, set signature, prefix signature and prefix."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4 << 20):
            x, r, n = shingle_sets(b.column(1), words)
            ends = np.cumsum(n)
            begin = ends - n
            some = np.flatnonzero(n)
            s1, s2, p1 = (np.zeros(len(n), np.uint64) for _ in range(3))
            prefix, cells = [b""] * len(n), [b""] * len(n)
            if len(some):
                spread = np.bincount(r * CELLS + (x & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS * len(n)).astype(np.uint32).reshape(len(n), CELLS)
                cells = [_narrow(c) for c in spread]
                s1[some] = np.add.reduceat(mix(x), begin[some])
                s2[some] = np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), begin[some])
                rare = x[np.lexsort((x, order.value[(x >> np.uint64(64 - bits)).astype(np.int64)], r))]
                k = n - (percent * n + 99) // 100 + 1
                for i in some.tolist():
                    head = rare[begin[i] : begin[i] + k[i]]
                    prefix[i] = blob(head)
                    p1[i] = np.add.reduce(mix(head ^ np.uint64(n[i])))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(n, pa.int64()), *(pa.array(v.view(np.int64)) for v in (s1, s2, p1)), pa.array(prefix, pa.binary()), pa.array(cells, pa.binary())], [c.split()[0] for c in _SETS.split(", ")])

    return texts.mapInArrow(run, _SETS)


def _numbered(groups: DataFrame) -> DataFrame:
    """Give groups compact numbers: the task in the high bits, a count in the low ones."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), *b.columns], ["node", *b.schema.names])
            at += b.num_rows

    return stored(groups.mapInArrow(run, "node long, n long, p1 long, prefix binary"), "jaccard-groups")


def _candidates(groups: DataFrame, n_buckets: int, percent: int) -> DataFrame:
    """(a, b): a forest per bucket over groups that share a prefix element where both may still link.

    An element at place k of a set of n leaves at most n - k in common, so the other set can have at
    most (n - k) (1 + t) / t - n elements. A pair must satisfy this from both sides.
    """

    def post(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            nodes, n = b["node"].to_numpy(), b["n"].to_numpy()
            heads = [np.frombuffer(x, np.uint64) for x in b["prefix"].to_pylist()]
            size = np.fromiter(map(len, heads), np.int64, len(heads))
            x = np.concatenate(heads)
            row = np.repeat(np.arange(len(heads)), size)
            place = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
            room = (n[row] - place) * (100 + percent) // percent - n[row]
            kind = np.uint16 if n.max() * 2 < 1 << 16 else np.uint32
            # a batch may join several files: one base per high part keeps offsets in 32 bits
            for base in np.unique(nodes >> 32):
                k = np.flatnonzero((nodes >> 32)[row] == base)
                to = ((x[k] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                k, to = k[order], to[order]
                cut = np.r_[0, np.flatnonzero(np.diff(to)) + 1, len(to)]
                spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
                low = x[k]
                columns = (low.astype(np.uint32), (low >> np.uint64(32)).astype(np.uint16), (nodes & 0xFFFFFFFF).astype(np.uint32)[row[k]], n[row[k]].astype(kind), room[k].astype(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(to[s]) for s, _ in spans], pa.int64()), pa.array([int(base)] * len(spans), pa.int64()), pa.array([kind().itemsize] * len(spans), pa.int64()), *(pa.array([blob(v[s:e]) for s, e in spans], pa.binary()) for v in columns)],
                    ["bucket", "base", "width", "low", "high", "offs", "sizes", "rooms"],
                )

    def meet(table: pa.Table) -> pa.Table:
        get = lambda c, kind: np.concatenate([np.frombuffer(v, kind if kind else f"u{w}").astype(np.int64) for v, w in zip(table[c].to_pylist(), table["width"].to_pylist())])
        x = get("low", np.uint32) | (get("high", np.uint16) << 32)
        order = np.argsort(x)
        same = x[order[1:]] == x[order[:-1]]
        k = order[np.r_[same, False] | np.r_[False, same]]
        del order, same
        node = np.concatenate([np.frombuffer(v, np.uint32).astype(np.int64) + (base << 32) for v, base in zip(table["offs"].to_pylist(), table["base"].to_pylist())])
        x, node, n, room = x[k], node[k], get("sizes", None)[k], get("rooms", None)[k]
        by = np.lexsort((n, x))
        x, node, n, room = x[by], node[by], n[by], room[by]
        # each entry as the smaller set: the entries after it up to the largest size it allows
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        post_of = np.cumsum(np.r_[True, x[1:] != x[:-1]]) - 1 if len(x) else first
        width = int(n.max()) + 2 if len(n) else 1
        last = np.searchsorted(post_of * width + n, post_of * width + np.minimum(room, width - 1), side="right")
        reach = np.maximum(last - np.arange(len(x)) - 1, 0)
        near = np.minimum(reach, 64)
        a = np.repeat(np.arange(len(x)), near)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(near) - near, near)
        ok = room[b] >= n[a]
        a, b = a[ok], b[ok]
        far = np.flatnonzero(reach > 64)  # long postings: neighbours by size stand for all pairs
        chain = np.zeros(len(x) + 1, np.int64)
        np.add.at(chain, far, 1)
        np.add.at(chain, last[far] - 1, -1)
        c = np.flatnonzero(np.cumsum(chain) > 0)
        nodes, roots = local_roots(node[np.concatenate([a, c])], node[np.concatenate([b, c + 1])])
        differ = nodes != roots
        return pa.table({"a": nodes[differ], "b": roots[differ]})

    posted = groups.select("node", "n", "prefix").mapInArrow(post, "bucket long, base long, width long, low binary, high binary, offs binary, sizes binary, rooms binary")
    return posted.groupBy("bucket").applyInArrow(meet, "a long, b long")


def _keys(table: pa.Table, good: np.ndarray | None = None):
    """Row indexes of each (comp, i, j) of a table, repeats of a class left out."""
    comp, i, j, cid = (table[c].to_numpy() for c in ("comp", "i", "j", "cid"))
    order = np.lexsort((cid, j, i, comp))
    if good is not None:
        order = order[good[order]]
    key = np.stack([comp[order], i[order], j[order]])
    edge = np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)] if len(order) else np.zeros(0, bool)
    cuts = np.r_[np.flatnonzero(edge), len(order)]
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        rows = order[a:z]
        rows = rows[np.r_[True, cid[rows[1:]] != cid[rows[:-1]]]]
        if len(rows) > 1:
            yield rows


def _possible(percent: int):
    """Forest over classes of one block whose counters leave a link possible."""

    def run(table: pa.Table) -> pa.Table:
        cid, n, sub, i, j = (table[c].to_numpy() for c in ("cid", "n", "sub", "i", "j"))
        cells = _counters(table["cells"].to_pylist())
        nodes, roots = [], []
        for rows in _keys(table):
            c, m, own, across = cells[rows], n[rows], sub[rows], i[rows[0]] != j[rows[0]]
            p, q = [], []
            for k in range(len(rows) - 1):
                most = np.minimum(c[k], c[k + 1 :]).sum(1, dtype=np.int64)
                ok = 100 * most >= percent * (m[k] + m[k + 1 :] - most)
                if across:
                    ok &= own[k + 1 :] != own[k]
                hit = np.flatnonzero(ok)
                p.append(np.full(len(hit), k))
                q.append(hit + k + 1)
            x, y = local_roots(cid[rows][np.concatenate(p)], cid[rows][np.concatenate(q)])
            nodes.append(x[x != y])
            roots.append(y[x != y])
        cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return pa.table({"a": cat(nodes), "b": cat(roots)})

    return run


def _intersections(x: np.ndarray, r: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """Set intersection sizes of n rows, from (hash, row) pairs: a blocked product of 0/1 matrices."""
    _, col, seen = np.unique(x, return_inverse=True, return_counts=True)
    keep = seen[col] > 1
    col, r = col[keep], r[keep]
    used, col = np.unique(col, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(col, kind="stable")
    col, r = col[order], r[order]
    cuts = np.searchsorted(col, np.arange(0, len(used) + width, width))
    for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
        m = np.zeros((n, min(width, len(used) - k * width)), np.float32)
        m[r[a:z], col[a:z] - k * width] = 1
        out += m @ m.T
    return out


def _verify(words: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        x, r, n = shingle_sets(table["text"], words)
        # rows of another text under the same doc_id, and repeats of a row, are not members
        sums = np.zeros(len(n), np.uint64)
        begin = np.cumsum(n) - n
        some = np.flatnonzero(n)
        if len(some):
            sums[some] = np.add.reduceat(mix(x), begin[some])
        cid = table["cid"].to_numpy()
        good = sums.view(np.int64) == cid
        i, j, sub, copies = (table[c].to_numpy() for c in ("i", "j", "sub", "copies"))
        nodes, roots, links = [], [], []
        for rows in _keys(table, good):
            own = np.concatenate([x[begin[k] : begin[k] + n[k]] for k in rows])
            inter = _intersections(own, np.repeat(np.arange(len(rows)), n[rows]), len(rows))
            linked = 100 * inter >= percent * (n[rows][:, None] + n[rows][None, :] - inter)
            np.fill_diagonal(linked, False)
            if i[rows[0]] != j[rows[0]]:
                linked &= sub[rows][:, None] != sub[rows][None, :]
            p, q = np.nonzero(np.triu(linked))
            if len(p):
                who, root = local_roots(cid[rows[p]], cid[rows[q]])
                at = np.searchsorted(who, cid[rows])
                hit = at < len(who)
                hit[hit] = who[at[hit]] == cid[rows][hit]
                nodes.append(cid[rows][hit])
                roots.append(root[at[hit]])
                links.append((linked @ copies[rows])[hit])
        cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return pa.table({"node": cat(nodes), "root": cat(roots), "links": cat(links)})

    return run


def _blocks(members: DataFrame, cell: int, name: str) -> DataFrame:
    """Members of blocks of two or more, each with its cell `sub` of `width` cells."""
    members = stored(members, name + "-members")
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("comp", F.ceil(F.col("m") / cell).alias("width"))
    sizes = stored(sizes, name + "-sizes")  # so that both sides of the join are plain exchanges, which can split a large block
    return stored(members.join(sizes, "comp").withColumn("sub", F.pmod(F.xxhash64("cid", "s2"), F.col("width"))), name)


def _in_cells(rows: DataFrame, n_tasks: int):
    """Rows once for every pair of cells that holds theirs, grouped to n_tasks."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("other")
    pairs = rows.select("*", other).withColumns({"i": F.least("sub", "other"), "j": F.greatest("sub", "other")}).drop("other", "width")
    return pairs.withColumn("task", F.pmod(F.xxhash64("comp", "i", "j"), F.lit(n_tasks))).groupBy("task")


def _tasks(blocks: DataFrame, rows: int) -> int:
    """Enough tasks that each has about so many rows, once rows stand in all their cells."""
    least = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, (blocks.agg(F.sum("width")).first()[0] or 0) // rows)


#: What orders the members of a class or component; its first member stands for it.
_FIRST = ("doc_id", "void", "tag", "row")


def jaccard_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cell: int = CELL, row: str | None = None) -> DataFrame:
    """Per row of docs: doc_id (null as the largest number) and known, tag (its text's key), row, n_shingles,
    component_id and component_known, first_row (the row that stands for its component) and n_links.

    row: the column of with_row, where docs has been through it.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, row).select("doc_id", "text", "known", row_key().alias("tag"), "row")
    n_buckets = fan_out(docs)
    bits = _sketch_bits(docs)
    order = spark.sparkContext.broadcast(_sketch(texts, words, bits))  # 32 MB at most
    sets = stored(_signed(texts, order, words, percent, bits), "jaccard-sets").withColumn("void", ~F.col("known"))
    real = sets.filter("n > 0")
    classes = real.groupBy("n", "s1", "s2", "p1").agg(F.min(F.struct(*_FIRST)).alias("first"), F.count(F.lit(1)).alias("copies"), F.min("cells").alias("cells"))
    classes = stored(classes.withColumnRenamed("s1", "cid"), "jaccard-classes")
    groups = _numbered(real.groupBy("n", "p1").agg(F.max("prefix").alias("prefix")))
    # blocks of groups, expanded to classes
    roots = connected_components(_candidates(groups, n_buckets, percent))
    placed = groups.select("node", "n", "p1").join(roots, "node", "left").select("n", "p1", F.coalesce("root", "node").alias("comp"))
    rough = _blocks(classes.join(placed, ["n", "p1"]), cell, "jaccard-rough")
    narrow = rough.select("comp", "cid", "n", "sub", "cells", "width")
    possible = connected_components(_in_cells(narrow, _tasks(rough, 4000)).applyInArrow(_possible(percent), "a long, b long"))
    # finer blocks: what the counters leave
    linked = possible.select(F.col("node").alias("cid"), "root").union(possible.select("root", "root").distinct())
    members = classes.select("cid", "n", "first", "copies", "s2").join(linked, "cid").withColumnRenamed("root", "comp")
    fine = _blocks(members, cell, "jaccard-fine")
    # a bitmap keeps the texts of all rows but those that stand for a class out of the exchange
    wide = min(26, max(16, 5 + fine.count().bit_length()))
    place = lambda c: F.pmod(F.col(c), F.lit(1 << wide))
    marks = fine.select(place("first.row").alias("h")).groupBy(F.shiftright("h", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("word"))
    marked = texts.select("row", "doc_id", "text", place("row").alias("h")).withColumn("slot", F.shiftright("h", 6)).join(F.broadcast(marks), "slot")  # 2**20 rows at most
    marked = marked.filter(F.expr("(shiftright(word, cast(h & 63 as int)) & 1L) = 1")).select("row", "doc_id", "text")
    with_text = marked.join(fine.withColumns({"row": F.col("first.row"), "doc_id": F.col("first.doc_id")}), ["row", "doc_id"])
    verified = _in_cells(with_text.select("comp", "cid", "copies", "sub", "text", "width"), _tasks(fine, 400)).applyInArrow(_verify(words, percent), "node long, root long, links long")
    verified = stored(verified, "jaccard-links")
    final = connected_components(verified.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"))
    label = classes.drop("cells").withColumnRenamed("cid", "node").join(final, "node", "left").join(linked, "node", "left")
    label = label.select(F.col("node").alias("s1"), "n", "s2", "first", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    label = stored(label, "jaccard-labels")
    least = stored(label.groupBy("root").agg(F.min("first").alias("least")), "jaccard-least")
    named = label.join(least, "root").select("n", "s1", "s2", "least", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = sets.select(*_FIRST, "known", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return out.select(
        "doc_id", "known", "tag", "row", F.col("n").alias("n_shingles"), F.coalesce("least.doc_id", "doc_id").alias("component_id"),
        (~F.coalesce("least.void", "void")).alias("component_known"), F.coalesce("least.row", "row").alias("first_row"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links (documents it links with, copies included)."""
    return jaccard_rows(docs, words, percent, cell).select(id_out(), "n_shingles", id_out("component_id", "component_known"), "n_links")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, the one of the smallest doc_id and, among those of one doc_id,
    of the smallest key of its text; all columns stay. Rows without shingles are their own components.
    """
    r, k = unused(docs, "row", "key")
    numbered = with_row(docs, r)
    kept = jaccard_rows(numbered, words, percent, row=r).filter("row = first_row").select(F.col("row").alias(r), F.col("tag").alias(k))
    tagged = numbered.withColumn(k, row_key())
    return tagged.join(stored(kept, "jaccard-kept"), [r, k], "left_semi").select(*[tagged[c] for c in docs.columns])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT a, a AS c FROM (SELECT DISTINCT a FROM l) UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(min(r.c), w.doc_id) AS component_id, CAST(coalesce(any_value(k.k), 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) k ON k.a = w.doc_id
GROUP BY w.doc_id, n.n
"""
