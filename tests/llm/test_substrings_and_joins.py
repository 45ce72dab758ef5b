import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from quiltnet.llm import common, jaccard_join, suffix_dedup
from quiltnet.llm.components import connected_components, local_roots

from .conftest import rows_of

BIG = 2**63 - 1


@pytest.mark.parametrize("letters", [1, 2, 3, 250])
def test_suffix_array_is_sorted_to_depth(letters):
    t = np.random.default_rng(letters).integers(3, 3 + letters, 1500).astype(np.uint8)
    raw = t.tobytes()
    sa = suffix_dedup.suffix_array(t, 50)
    keys = [raw[i : i + 50] for i in sa]
    assert sorted(sa.tolist()) == list(range(1500)) and keys == sorted(keys)
    got = suffix_dedup.adjacent_prefixes(suffix_dedup._words(t, 58), sa, 50)
    for k in range(1, 1500, 7):
        a, b = keys[k - 1], keys[k]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert got[k] == same or len(min(a, b, key=len)) < 50


def brute_spans(rows, length=50):
    docs = sorted(((BIG if i is None else i), (t or "").encode()) for i, t in rows)
    first = {}
    for i, t in docs:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup_equals_brute_force(odd, none):
    got = sorted((BIG if r[0] is None else r[0], *r[1:]) for r in suffix_dedup.suffix_dedup(odd).collect())
    assert got == brute_spans(rows_of(odd))
    assert suffix_dedup.suffix_dedup(none).collect() == []
    kept = suffix_dedup.suffix_dedup(odd, with_text=True).collect()
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in kept)


def test_groups_hold_as_much_at_every_size(monkeypatch, odd):
    for size in (100 << 20, 4 << 30, 30 << 30, 100 << 40):
        monkeypatch.setattr(common, "estimated_bytes", lambda df, size=size: size)
        assert size / common.group_count(odd, common.fan_out(odd)) <= common.MB
    monkeypatch.setattr(common, "estimated_bytes", lambda df: 1 << 62)
    assert common.group_count(odd, 3) == 6


def test_many_groups_a_partition_equal_brute_force(monkeypatch, odd):
    monkeypatch.setattr(suffix_dedup, "group_count", lambda df, n_parts: 31)
    monkeypatch.setattr(suffix_dedup, "fan_out", lambda df: 2)
    got = sorted((BIG if r[0] is None else r[0], *r[1:]) for r in suffix_dedup.suffix_dedup(odd).collect())
    assert got == brute_spans(rows_of(odd))


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {b" ".join(w)} if w else set()


def brute_join(rows):
    sets = [((BIG if i is None else i), shingles(t)) for i, t in rows]
    comp, links = list(range(len(sets))), [0] * len(sets)

    def top(v):
        while comp[v] != v:
            v = comp[v]
        return v

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i][1] & sets[j][1])
            if both and 100 * both >= 80 * (len(sets[i][1]) + len(sets[j][1]) - both):
                comp[top(i)] = top(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), BIG), i)
    return sorted((i, len(s), least[top(k)], links[k]) for k, (i, s) in enumerate(sets))


def edited(spark):
    """A base with copies of growing distance, so that links and near misses both occur."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(60):
        w = list(base)
        for p in rng.choice(120, k // 8, replace=False):
            w[p] = f"z{k}{p}"
        rows.append((k, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("cell", [256, 7])
def test_jaccard_join_equals_brute_force(spark, odd, cell):
    for docs in (odd, edited(spark)):
        got = sorted((BIG if r[0] is None else r[0], r[1], BIG if r[2] is None else r[2], r[3]) for r in jaccard_join.jaccard_join(docs, cell=cell).collect())
        assert got == brute_join(rows_of(docs))


def test_keep_one_leaves_one_of_each_component(odd, none):
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted((BIG if i is None else i, t or "") for i, t in rows_of(kept))
    by_text = {}
    for (i, t), (_, _, c, _) in zip(sorted(((BIG if i is None else i), t or "") for i, t in rows_of(odd)), brute_join([(i, t or "") for i, t in sorted(((BIG if i is None else i), t or "") for i, t in rows_of(odd))])):
        by_text.setdefault((i, t), c)
    assert len(got) == len(set(got)) and (9000, "") in got and (9003, "One two") in got and not any(i == 9004 for i, _ in got)
    assert jaccard_join.jaccard_join(none).collect() == [] and jaccard_join.keep_one(none).collect() == []


def test_the_largest_id_is_no_null(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(BIG, text), (None, "another text of more words than five"), (None, text), (BIG, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == sorted([(str(BIG), str(BIG)), ("None", "None"), ("None", str(BIG)), (str(BIG), str(BIG))])
    assert sorted(str(r["doc_id"]) for r in suffix_dedup.suffix_dedup(docs).collect()) == sorted([str(BIG)] * 2 + ["None"] * 2)


def test_rows_without_an_id_spread_over_groups(spark):
    from quiltnet.llm.common import texts_of, with_row

    docs = spark.createDataFrame([(None, "the same text")] * 20000, "doc_id long, text string").coalesce(3)
    rows = texts_of(docs)
    sizes = [r["count"] for r in rows.selectExpr("pmod(row, 16) AS g").groupBy("g").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 20000 and max(sizes) < 3 * sorted(sizes)[8]
    clash = spark.createDataFrame([(1, "x", 5, "m")], "doc_id long, text string, row int, _metadata string")
    assert with_row(clash, "n").columns == ["doc_id", "text", "row", "_metadata", "n"] and texts_of(clash).first()["known"]


def test_components(spark):
    edges = [(5, 9), (9, 2), (7, 7), (30, 31), (31, 32), (32, 33), (33, 30), (100, 101)] + [(k, k + 1) for k in range(200, 260)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 2, 9: 2, 31: 30, 32: 30, 33: 30, 101: 100} | {k: 200 for k in range(201, 261)}
    nodes, roots = local_roots(np.array([5, 9, 4]), np.array([9, 2, 4]))
    assert dict(zip(nodes.tolist(), roots.tolist())) == {2: 2, 4: 4, 5: 2, 9: 2}


def test_one_row_of_each_component_stays(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(None, base), (None, base + " x"), (None, base + " y"), (None, "alone one two three four five six"), (7, base.upper() + " z"), (9, "p q r s t u v w"), (9, "p q r s t u v w"), (9, "other words under the same number")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = rows_of(jaccard_join.keep_one(docs))
    assert sorted(kept, key=str) == sorted([(7, rows[4][1]), (None, rows[3][1]), (9, rows[5][1]), (9, rows[7][1])], key=str)
    nulls = rows_of(jaccard_join.keep_one(docs.filter("doc_id is null")))
    assert len(nulls) == 2 and rows[3] in nulls


def test_a_family_beyond_long_postings(spark):
    """150 near copies of one text, all different: postings of more than 64 entries, several cells."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, " ".join(f"y{k}_{i}" for i in range(30))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_join(docs, cell=32).collect())
    assert got == brute_join(rows)
    assert len(rows_of(jaccard_join.keep_one(docs))) == 21


def test_messages_to_buckets_do_not_grow_with_copies():
    """A text of many documents is sent once, whatever the number of its copies in the group."""
    text = " ".join(f"word{i} of a text that stands in many documents" for i in range(40))

    def sent(copies):
        table = pa.table({"doc_id": pa.array(range(copies), pa.int64()), "text": [text] * copies})
        keys = suffix_dedup._send_anchors(16, 50)((pa.scalar(0),), table)
        masks = [suffix_dedup._mark_shared(keys.filter(pc.equal(keys["bucket"], b))) for b in pc.unique(keys["bucket"])]
        got = suffix_dedup._send_segments(16, 50)((pa.scalar(0),), table, pa.concat_tables(masks))
        return {r["bucket"]: sum(len(r[c]) for c in ("content", "least", "most", "lengths")) for r in got.to_pylist()}

    assert sent(1000) == sent(100)


def test_the_sketch_grows_with_the_table(spark, odd, monkeypatch):
    bits = []
    for size in (1 << 20, 100 << 20, 500 << 20, 6 << 30):
        monkeypatch.setattr(jaccard_join, "estimated_bytes", lambda df, size=size: size)
        bits.append(jaccard_join._sketch_bits(odd))
    assert bits == [18, 22, 24, 25]
    # 300,000 shingles: most share a cell of a small sketch, and few one of a sketch of their table's size
    rng = np.random.default_rng(1)
    texts = spark.createDataFrame([(" ".join(map(str, rng.integers(0, 1 << 40, 1004))),) for _ in range(300)], "text string")
    once = [(jaccard_join._sketch(texts, 5, b) == 8).sum() for b in (18, 22)]
    assert once[0] < 110_000 and once[1] > 270_000
    monkeypatch.setattr(jaccard_join, "_sketch_bits", lambda docs: 22)
    docs = edited(spark)
    got = sorted((BIG if r[0] is None else r[0], r[1], BIG if r[2] is None else r[2], r[3]) for r in jaccard_join.jaccard_join(docs).collect())
    assert got == brute_join(rows_of(docs))


@pytest.mark.parametrize("mean, most, kind", [(0.15, 0.12, np.uint8), (0, 0.01, np.uint8), (700, 4, np.uint16), (1e6, 4, np.uint32)])
def test_a_tasks_sketch_is_sent_as_bits(mean, most, kind):
    # a byte a cell from every task grew as tasks times cells: 255 of 1,201 MB at 0.51 GB
    counts = np.random.default_rng(1).poisson(mean, 1 << 16).astype(kind)
    packed = jaccard_join._packed(counts)
    assert len(packed) < most * len(counts)
    assert (jaccard_join._unpacked(packed, kind().itemsize, 1 << 16) == counts).all()


def test_counters_of_a_set_take_a_byte_where_they_fit():
    sets = [np.full(jaccard_join.CELLS, k, np.uint32) for k in (0, 255, 256, 90_000)]
    column = [jaccard_join._narrow(c) for c in sets]
    assert [len(c) // jaccard_join.CELLS for c in column] == [1, 1, 4, 4]
    assert (jaccard_join._counters(column) == np.stack(sets)).all() and jaccard_join._counters(column[:2]).dtype == np.uint8
