import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from quiltnet.llm import centroids, hard_negatives, license_scan

SCHEMA = "vec_id long, embedding array<double>, label int, row int, v string, cluster double, known string"


def vectors(dim, n, seed=0):
    """Rows with ties, copies, repeated and missing ids and labels, wrong lengths, nulls and non-finite components."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (np.round(rng.normal(size=dim) * 4) / 16).tolist(), int(i) % 4) for i in range(n)]
    rows += [(int(i), rows[7][1], int(i) % 4) for i in range(n, n + 60)]  # copies, some of them anchors
    rows += [(0, rows[3][1], 1), (0, rows[3][1], 1), (50, rows[9][1], 2), (None, rows[7][1], 3), (None, rows[8][1], 0)]
    rows += [(9001, None, 1), (9002, [None] + rows[0][1][1:], 1), (9003, [math.nan] + rows[0][1][1:], 1), (9004, [math.inf] + rows[0][1][1:], 2)]
    return [(*r, 1, "x", 0.5, "y") for r in rows]


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cent = [v for _, v in sorted(kept, key=key)[:k]]
    x = np.array([v for _, v in kept], object)
    for step in range(rounds + 1):
        d = [[int(((a - np.array(c, object)) ** 2).sum()) for c in cent] for a in x]
        own = [min(range(len(cent)), key=lambda j: (r[j], j)) for r in d]
        if step < rounds:
            for c in range(len(cent)):
                mine = [v for (_, v), o in zip(kept, own) if o == c]
                if mine:
                    cent[c] = [sum(z) // len(mine) for z in zip(*mine)]
    dist = [r[o] for r, o in zip(d, own)]
    inertia = Counter()
    for o, e in zip(own, dist):
        inertia[o] += e
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted((-1 if i is None else i, o, e, inertia[o], sum(dist), sha[o]) for (i, _), o, e in zip(kept, own, dist))


def test_elkan_equals_all_distances(spark):
    rows = vectors(64, 400) + [(9005, [0.5] * 63, 1, 1, "x", 0.5, "y"), (9006, [0.5] * 65, 1, 1, "x", 0.5, "y"), (9007, [], 1, 1, "x", 0.5, "y")]
    got = centroids.elkan(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    # equal hashes of the two rows without an id do not matter here: others come first
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == brute_clusters(rows)


def test_elkan_of_few_equal_and_no_vectors(spark):
    rows = [(i, [0.25 * (i // 3)] * 64, 0, 1, "x", 0.5, "y") for i in range(7)]
    got = centroids.elkan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == brute_clusters(rows)
    assert centroids.elkan(spark.createDataFrame(rows[:0], SCHEMA)).collect() == []
    with pytest.raises(Exception, match="would not fit"):
        centroids.elkan(spark.createDataFrame([(1, [1e300] * 64, 0, 1, "x", 0.5, "y")], SCHEMA)).collect()


def test_bounds_skip_most_distances():
    """Vectors around sixteen places: once bounds are known, few distances are computed, and all are right."""
    rng = np.random.default_rng(3)
    places = rng.integers(-400, 400, (16, 64))
    x = places[rng.integers(0, 16, 3000)] + rng.integers(-20, 20, (3000, 64))
    own, upper, lower, n = np.zeros(3000, np.int32), np.full(3000, np.inf, np.float32), np.zeros((3000, 16), np.float32), np.zeros(3000, np.int32)
    centroids.assign(x, own, upper, lower, places, n)
    moved = places + rng.integers(-3, 4, places.shape)
    step = np.sqrt(centroids._squares(moved, places).astype(float))
    upper, lower, n[:] = centroids._up(upper.astype(float) + step[own]), centroids._down(lower.astype(float) - step), 0
    centroids.assign(x, own, upper, lower, moved, n)
    d = centroids._squares(x[:, None], moved[None])
    assert (own == d.argmin(1)).all()
    assert (upper.astype(float) ** 2 >= d[np.arange(3000), own]).all() and (lower.astype(float) ** 2 <= d).all()
    assert n.sum() < 0.1 * d.size


def brute_negatives(rows, every=50):
    kept = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (i, lab, v) in enumerate(kept):
        if i is None or i % every:
            continue
        s = [(score(v, w), j, m) for k, (j, m, w) in enumerate(kept) if k != n]
        for p, j, _ in sorted((x for x in s if x[2] == lab), key=lambda x: (-x[0], last(x[1])))[:5]:
            hits = sorted((x for x in s if x[2] != lab and 50 * p <= 100 * x[0] <= 95 * p), key=lambda x: (-x[0], last(x[1])))[:3]
            out += [(i, j, k, h[1], p, h[0]) for k, h in enumerate(hits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("dim", [7, 64])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, dim):
    monkeypatch.setattr(hard_negatives, "ROWS", 90)
    monkeypatch.setattr(hard_negatives, "TILE", 5)
    rows = vectors(dim, 600, dim) + [(9010, [0.5, 0.25], 1, 1, "x", 0.5, "y"), (9050, [0.5] * 3, 2, 1, "x", 0.5, "y"), (9011, [], 1, 1, "x", 0.5, "y"), (100, [0.5] * dim, None, 1, "x", 0.5, "y")]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted((tuple(r[k] for k in names) for r in got), key=str) == brute_negatives(rows)


def test_hard_negatives_of_no_rows_and_large_components(spark):
    frame = lambda rows: spark.createDataFrame([(*r, 1, "x", 0.5, "y") for r in rows], SCHEMA)
    assert hard_negatives.hard_negatives(frame([])).collect() == []
    assert hard_negatives.hard_negatives(frame([(50, [1.0], 1), (1, [1.0], 1)])).collect() == []
    rows = [(50, [30000.0, -1.5], 1), (1, [29000.0, 2.0], 1), (2, [20000.0, 0.25], 0), (3, [-1.0, 1.0], 0)]
    got = hard_negatives.hard_negatives(frame(rows)).collect()
    assert [tuple(r) for r in got] == brute_negatives(rows)
    with pytest.raises(Exception, match="would not fit"):
        hard_negatives.hard_negatives(frame([(50, [1e30], 1)])).collect()


def test_table_lookups_bound_scores_and_prune():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(3000, 64)) * 40).astype(np.int64)
    mean, sd = x.mean(0), x.std(0)
    z = np.array([hard_negatives.NormalDist().inv_cdf(c / 16) for c in range(1, 16)])
    edges = np.column_stack([x.min(0), np.ceil(mean[:, None] + z * sd[:, None]), x.max(0) + 1]).astype(np.int64)
    code = hard_negatives.cells(x, edges)
    up, down = (hard_negatives.bounds(t, code) for t in hard_negatives.tables(x[:20], edges, np.int32))
    score = x @ x[:20].T
    assert (down <= score).all() and (score <= up).all()
    fifth = np.sort(score, 0)[-6]
    assert (up >= fifth).sum() < 0.25 * score.size


LINES = [
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
    "Permission is hereby granted, free of charge, to any human obtaining a copy of this software and its documentation files", "licensed under cc by 4.0", "mit mit license license", "GNU general public-license",
]


def brute_licenses(text):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    w = words(text)
    places, labels, best = [], set(), 0.0
    for label, p in license_scan.PHRASES:
        p = words(p)
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append((i, label))
    for label, t in license_scan.TEMPLATES:
        t = words(t)
        for k in range(0, len(t), 32):
            part = set(t[k : k + 32])
            for i in range(0, max(1, len(w) - 64 + 32), 32):
                share = len(part & set(w[i : i + 64])) / len(part)
                if len(part & set(w[i : i + 64])) * 100 >= (80 if len(part) >= license_scan.SHORT else 100) * len(part):
                    labels.add(label)
                    best = max(best, share)
    base = {x for _, x in places}
    at = [i for i, _ in places] or [None]
    return len(w), len(places), min(at), max(at), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best


def test_license_scan_equals_all_blocks(spark, odd, none):
    rng = np.random.default_rng(2)
    filler = ["der", "the", "of", "license", "software", "a", "to", "été", "mit", "any", "person", "x1", "public", "general"]
    texts = [(t,) for (_, t) in [(r["doc_id"], r["text"]) for r in odd.collect()]]
    for k in range(300):
        parts = [" ".join(rng.choice(filler, int(rng.integers(0, 90)))) for _ in range(3)]
        texts.append((parts[0] + ["\n", " ", "-"][k % 3] + LINES[k % len(LINES)] + " " + parts[1] + " " + LINES[int(rng.integers(len(LINES)))] + "\n" + parts[2],))
    texts += [(" ".join(rng.choice(filler, 20_000)) + " " + LINES[1],), (LINES[0],), (LINES[0],)]
    docs = spark.createDataFrame([(i, *t, 1, "w") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, labels string")
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.licenses(docs).collect()}
    for i, (t,) in enumerate(texts):
        want = brute_licenses(t)
        assert got[i][:6] == want[:6] and abs(got[i][6] - want[6]) < 1e-12, (t, got[i], want)
    assert len(license_scan.licenses(odd).collect()) == odd.count()
    assert license_scan.licenses(none).collect() == []
    assert license_scan.licenses(docs.filter("doc_id < 3"), templates=[], phrases=[]).agg({"score": "max"}).first()[0] == 0


def test_license_blocks_and_filters(spark):
    text = " ".join(["word"] * 100) + " " + LINES[1]
    got = license_scan.license_blocks(spark.createDataFrame([(1, text), (2, "licensed under cc")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["label"], r["first_word"]) for r in got} == {(1, "cc-by-nc", 64)} and got[0]["contained"] == 1.0
    # blocks with frequent words only are never counted
    sets = [[0, 5, 6, 7, 8], [1, 6, 7, 8, 9]]
    index = license_scan.Index(sets, [4, 4], 10)
    block, rank = np.repeat(np.arange(50), 4), np.tile(np.array([6, 7, 8, 9]), 50)
    b, t, shared, counted = index.join(block, rank)
    assert counted == 50 and set(t.tolist()) == {1} and (shared == 4).all()
    assert index.join(block, np.tile(np.array([2, 3, 4, 9]), 50))[3] == 0


def test_long_templates_are_cut(spark):
    words = [f"w{i}" for i in range(70)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20]))], "doc_id long, text string")
    got = license_scan.licenses(docs, templates=[("own", " ".join(words))], phrases=[]).collect()
    assert {r["doc_id"]: r["labels"] for r in got} == {1: "own", 2: ""}
