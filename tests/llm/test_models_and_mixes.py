import zlib
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
import pytest

from quiltnet.llm import mixing, quality_model, url_trust

from .conftest import rows_of


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left, lw = total - sum(target.values()), sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / lw >= cap * sizes[s]}
        if not over:
            return target | {s: left * w[s] / lw for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def test_targets_and_totals(spark, odd, none):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), "abcdefg"[int(rng.integers(0, 7)) if k % 3 else 0]) for k in range(6000)] + [(7000, "tiny", "zz"), (7001, None, None), (7002, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for d in (docs, odd):
        got = mixing.cube_mix(d).toPandas()
        src = d.select("doc_id", "source", "text").toPandas()
        src["size"] = [len((t or "").encode().split()) for t in src.text]
        sizes = src.groupby("source", dropna=False)["size"].sum()
        want = brute_targets({None if k is None or k != k else k: int(v) for k, v in sizes.items()})
        assert len(got) == len(src) and sorted(got["size"]) == sorted(src["size"])
        assert sorted(set(got.target.round(6))) == pytest.approx(sorted({round(x, 6) for x in want.values()}))
        assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].replace(0, 1) == 0).all()
        assert got.sort_values(list(got.columns)).reset_index(drop=True).equals(mixing.cube_mix(d).toPandas().sort_values(list(got.columns)).reset_index(drop=True))
        if d is docs:
            for (t, _), part in got.groupby(["target", "source_size"]):
                assert abs(part.taken.sum() - t) <= 3 * part["size"].max()
    assert mixing.cube_mix(none).collect() == []
    assert mixing.take_mix(odd).columns == odd.columns
    assert sum(len((t or "").encode().split()) for _, t in rows_of(mixing.take_mix(odd))) == sum(r["taken"] for r in mixing.cube_mix(odd).collect())


def test_flight_keeps_totals_and_probabilities():
    sizes, p = np.array([3, 5, 5, 8, 13, 1, 1, 40.0]), np.full(8, 0.3)
    mean = np.zeros(8)
    for k in range(3000):
        out = mixing.flight(sizes, p, np.random.default_rng(k), False)
        assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ sizes - p @ sizes) < 1e-6
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
        mean += mixing.flight(sizes, p, np.random.default_rng(k), True)
    assert np.abs(mean / 3000 - 0.3).max() < 0.04


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        y = rng.integers(0, 2, 6)
        xs, ys = quality_model.isotonic(np.arange(6.0), y)
        fit = ys[np.searchsorted(xs, np.arange(6.0), side="right") - 1]
        grid = np.unique([y[a:b].mean() for a in range(6) for b in range(a + 1, 7)])
        best = min(((np.array(c) - y) ** 2).sum() for c in product(grid, repeat=6) if list(c) == sorted(c)) if len(grid) < 6 else None
        assert (np.diff(ys) > 0).all() and (best is None or ((fit - y) ** 2).sum() <= best + 1e-12)


def test_classifier_on_held_out_rows(spark, odd, none):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.fit(quality_model.with_statistics(d), labels)
    got = quality_model.scored(quality_model.with_statistics(d), model).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert quality_model.keep_good(odd, model).columns == odd.columns
    assert len(quality_model.scored(quality_model.with_statistics(odd), model).collect()) == odd.count()
    assert quality_model.scored(quality_model.with_statistics(none), model).collect() == []
    empty = quality_model.fit(quality_model.with_statistics(odd), labels.limit(0))
    assert {r["score"] for r in quality_model.scored(quality_model.with_statistics(odd), empty).collect()} == {1.0}


def test_statistics_do_not_depend_on_the_batch(odd):
    import pyarrow as pa

    texts = [t or "" for _, t in rows_of(odd)]
    whole = quality_model.statistics(pa.array(texts))
    assert np.allclose(whole, np.vstack([quality_model.statistics(pa.array([t])) for t in texts]))


def brute_rank(hosts, edges, seed, damping, rounds):
    out = {h: sum(w for a, _, w in edges if a == h) for h in hosts}
    x = dict(seed)
    for _ in range(rounds):
        x = {h: (1 - damping) * seed[h] + damping * (sum(x[a] * w / out[a] for a, b, w in edges if b == h) + (x[h] if not out[h] else 0)) for h in hosts}
    return x


def test_url_rules_and_propagation(spark):
    url = ["http://www.Example.com/en/x?q", "https://a.example.com/en/1", "http://b.com/", "http://c.net/es/1#x", "http://c.net/de/1", "http://d.net/fr/", "http://good.org/x", "http://spam.org", None, "no scheme", "http://xnet/es/1"]
    html = ["", '<a href="http://b.com/1">', '<A HREF=//good.org/a><a href="/rel">', '<a href="http://d.net/fr/9">', "", '<a href="http://spam.org/">', "", '<a href="http://c.net/es/2"><a href="http://d.net/fr/1">' * 3, None, "", ""]
    pages = spark.createDataFrame([(k, u, h, "clash") for k, (u, h) in enumerate(zip(url, html))], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_trust.url_filter(pages).collect()}
    assert [got[k]["rule"] for k in range(11)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, "net/fr/", None, None, None, None, None]
    assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block" and got[4]["path"] == "/de/1" and got[8]["host"] == got[9]["path"] == ""
    assert got[7]["verdict"] == "block"  # links only to blocked hosts
    assert got[6]["verdict"] == "allow" and got[8]["verdict"] == "allow"
    hosts = sorted({r["host"] for r in got.values() if r["host"]})
    cut = pages.select("page_id", url_trust.url_parts(pages["url"])[0].alias("host"), "html")
    edges = [tuple(r) for r in url_trust.host_edges(cut).collect()]
    good = {h: 0.0 for h in hosts}
    for r in got.values():
        if r["rule"] and r["verdict"] == "allow":
            good[r["host"]] += 1
    total = sum(good.values())
    want = brute_rank(hosts, edges, {h: v / total for h, v in good.items()}, 0.85, 40)
    for r in got.values():
        if r["host"]:
            assert r["trust"] == pytest.approx(want[r["host"]] * total, abs=1e-4)
    assert url_trust.url_filter(pages.limit(0)).collect() == []


def test_links_reach_hosts_with_a_port_or_a_user(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", '<a href="http://b.org:80/"><a href="http://me@c.org/">'), (2, "http://b.org:80/x", ""), (3, "http://C.org:8080/", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_trust.url_filter(pages).collect()}
    assert [got[k]["host"] for k in (1, 2, 3)] == ["a.com", "b.org:80", "c.org:8080"]
    assert got[2]["trust"] == got[3]["trust"] == pytest.approx(0.85 / 2)


def test_mass_is_kept(spark):
    pages = spark.createDataFrame([(1, "http://a.com/", '<a href="http://b.net/es/">'), (2, "http://b.net/es/", "")], "page_id long, url string, html string")
    got = pd.DataFrame([r.asDict() for r in url_trust.url_filter(pages).collect()])
    assert got.trust.sum() == pytest.approx(1) and got.distrust.sum() == pytest.approx(1) and got.base.sum() == pytest.approx(2)


def test_trust_reaches_hosts_far_from_the_seeds(spark):
    n = 50
    nodes = spark.createDataFrame([(f"h{k}", float(k == 0), 0.0, 1.0 / n) for k in range(n)], "host string, seed_trust double, seed_distrust double, seed_base double")
    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1.0) for k in range(n - 1)], "src string, dst string, w double")
    got = {r["host"]: r["trust"] for r in url_trust.propagate(nodes, edges).collect()}
    want = {f"h{k}": 0.15 * 0.85**k for k in range(n - 1)} | {f"h{n - 1}": 0.85 ** (n - 1)}
    assert got == pytest.approx(want, abs=1e-7)
    with pytest.raises(RuntimeError, match="still move"):
        url_trust.propagate(nodes, edges, step=1, rounds=1)


def test_many_equal_rows_are_dealt_out_and_mixed(spark):
    rows = [(None, "the same three", "a")] * 3500 + [(k, "other words " * (k % 7), "b") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    base = mixing.sizes(docs)
    got = mixing.numbered(base).groupBy("doc_id", "tag").agg({"nth": "max", "size": "count"}).collect()
    assert sorted((r["max(nth)"], r["count(size)"]) for r in got if r["doc_id"] is None) == [(3499, 3500)]
    out = mixing.cube_mix(docs).toPandas()
    assert len(out) == 4000
    for (t, _), part in out.groupby(["target", "source_size"]):
        assert abs(part.taken.sum() - t) <= 3 * part["size"].max()
    assert mixing.take_mix(docs).count() == out.copies.sum()


def test_mix_takes_each_row_as_often_as_planned(spark):
    """Rows with equal ids and texts under two sources, and equal rows that differ elsewhere."""
    rows = [(1, "a b c", s, "x", 0) for s in "xy"] + [(2, "d e", "x", f"l{k % 5}", k % 3) for k in range(90)] + [(None, "f", None, "l", k % 2) for k in range(40)] + [(3, None, "y", "l", 0)] * 3
    rows += [(100 + k, " ".join(["w"] * (k % 9 + 1)), "xyz"[k % 3], "l", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rows int").repartition(5)
    take = lambda: Counter(tuple(r) for r in mixing.take_mix(docs).collect())
    got, plan = take(), mixing.cube_rows(docs).collect()
    sizes = lambda k: tuple(k[:3])
    text = {(r[0], len((r[1] or "").split()), r[2]): r[1] for r in rows}
    want = Counter()
    for r in plan:
        want[r["doc_id"], text[r["doc_id"], r["size"], r["source"]], r["source"]] += r["copies"]
    have = Counter()
    for k, n in got.items():
        have[sizes(k)] += n
    assert have == +want
    whole, each = Counter(rows), Counter(r[:3] for r in rows)
    for k, n in whole.items():  # copies of rows that share id, text and source differ by one at most
        low = want[k[:3]] // each[k[:3]]
        assert low * n <= got[k] <= (low + 1) * n
    assert take() == got
