import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quiltnet.llm import decontaminate, lm_score, pii, quality_rules, token_files

from .conftest import rows_of

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(EMAIL, t)],
        "ip": [m.span() for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(CARD, t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(PHONE, t) if 8 <= len(digits(m[0])) <= 15],
    }


def test_base_spans_equal_the_patterns():
    rng, letters = np.random.default_rng(0), list("ab1 2.@+-()_%9é\n0")
    for _ in range(4000):
        t = "".join(rng.choice(letters, int(rng.integers(1, 40))))
        assert pii.base_spans(t) == plain_spans(t)


def test_field_learns_held_out_rows():
    field, good, total, found = pii.train_field(pii.labelled_table()), 0, 0, 0
    for text, spans in pii.labelled_table(2, 99):
        runs = pii._runs_of(text)
        got = {s for r, y in zip(runs, field.decode(runs)) for s in pii._add_spans(text, r, y, {k: [] for k in pii.KINDS})}
        good, total, found = good + len(got & set(spans)), total + len(spans), found + len(got)
    assert good >= 0.9 * total and good >= 0.9 * found


def test_field_finds_formats_it_was_not_trained_on():
    """Lengths, words around, marks and cases that no template has; and texts without personal data."""
    rng, field = np.random.default_rng(8), pii.train_field(pii.labelled_table())
    pick = lambda chars, k: "".join(chars[j] for j in rng.integers(0, len(chars), k))
    letters = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: pick(letters[10:36], int(rng.integers(2, 9)))

    def added(text):
        runs = pii._runs_of(text)
        return [text[a:z] for r, y in zip(runs, field.decode(runs)) for _, a, z in pii._add_spans(text, r, y, {})]

    hit = clean = 0
    for k in range(300):
        key = pick(letters[:16], (40, 56)[k % 2]) if k % 3 else pick(letters, 44)
        text = f"{word()} {word()} passphrase => {['', chr(34), '<'][k % 3]}{key}{['', chr(34), '>'][k % 3]} {word()} {word()}"
        hit += added(text) == [key]
        text = f"{word()} {pick(letters[:10], int(rng.integers(1, 19)))} {word()} {word()}{pick(letters[:10], 2)} ({pick(letters[:10], 4)}) {word()} {pick(letters[:10], 3)}/{pick(letters[:10], 5)}"
        clean += not added(text)
    assert hit >= 270 and clean >= 285


def test_viterbi_equals_enumeration():
    from itertools import product

    field = pii.train_field(pii.labelled_table(2), steps=15)
    run = pii._runs_of("call (212) 555-0100 4111")[0]
    e = field.scores(run)
    best = max(product(range(len(pii.LABELS)), repeat=len(e)), key=lambda y: field.start[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in zip(y, y[1:])) + field.stop[y[-1]])
    assert field.decode([run])[0].tolist() == list(best)


def test_pii_query(spark, odd, none):
    more = spark.createDataFrame([(1, "é mail a.b@c.de, call (212) 555-0100 or 10.0.0.256 and 1.2.3.4"), (2, None), (3, "Version 2.0 of 1999")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(more).collect()}
    assert got[1]["n_email"] == 1 and got[1]["n_ip"] == 1 and "phone:" in got[1]["spans"] and "email:7:15" in got[1]["spans"]
    assert got[2]["spans"] == got[3]["spans"] == ""
    for r in pii.find_pii(odd).collect():
        t = next(t or "" for i, t in rows_of(odd) if i == r["doc_id"]) if r["doc_id"] != 9003 else None
        if t is not None:
            line = ",".join(f"{k}:{a}:{b}" for k, v in plain_spans(t).items() for a, b in v)
            assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
    assert pii.find_pii(none).collect() == []


def test_lm_scores(spark, odd, none):
    rows = rows_of(odd)
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 != 2
    tokens, c = [(i, (t or "").encode().lower().split()) for i, t in rows], Counter()
    for i, w in tokens:
        if train(i):
            c.update(w)
            c[b" "] += 1
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, len(w) + 1, sum(c[x] > 0 for x in [*w, b" "]), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in [*w, b" "]), 5)) for i, w in tokens)
    big = spark.createDataFrame([(2**63 - 1, "the largest id"), (None, "no id")], "doc_id long, text string")
    assert {r["doc_id"] for r in lm_score.lm_scores(big).collect()} == {2**63 - 1, None}
    got = lm_score.lm_scores(odd).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["held_out"] == (r["doc_id"] is not None and not train(r["doc_id"])) and r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm_score.lm_scores(none).collect() == []


def test_log_bilinear_normalises():
    triples = np.random.default_rng(1).integers(0, 50, (6, 6, 5))
    model = lm_score.LogBilinear({}, *lm_score.train_nce(triples, width=8, steps=150), 1)
    p = np.exp(model.log_probs())
    assert np.allclose(p.sum(1), 1)
    seen = triples.reshape(36, 5) + 1e-9
    assert np.abs(p - seen / seen.sum(1, keepdims=True)).mean() < 0.1


def brute_hits(rows, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    grams = {}
    for k, t in items:
        w = words(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1) if m else ():
            grams.setdefault(tuple(w[i : i + m]), set()).add(str(k))
    out = []
    for i, t in rows:
        w, hit, who = words(t), set(), set()
        for g, items_ in grams.items():
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    who |= items_
        out.append((-1 if i is None else i, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination_equals_brute_force(spark, odd, none):
    text = next(t for i, t in rows_of(odd) if i == 5).split()
    items = [(1, " ".join(text[3:20])), (2, "one two"), (3, None), (4, "..."), (10, " ".join(text[3:20]).upper()), (5, "nothing like this here at all in any of the texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 40):  # by broadcast, and by join
        got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in decontaminate.contamination(odd, bench, block_bytes=block).collect())
        assert got == brute_hits(rows_of(odd), items)
    for block in (8 << 20, 40):
        clean = decontaminate.decontaminate(odd, bench, drop_share=0.9, block_bytes=block)
        assert clean.columns == odd.columns and not any(r["contaminated"] for r in decontaminate.contamination(clean, bench).collect())
        whole = decontaminate.decontaminate(odd, bench, drop_share=0.0, block_bytes=block)
        assert sorted(map(str, rows_of(whole))) == sorted(str((i, t)) for i, t in rows_of(odd) if not brute_hits([(i, t)], items)[0][5])
    assert decontaminate.contamination(none, bench).collect() == []
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd, bench.limit(0)).collect())


def test_rule_ledger_equals_brute_force(odd, none):
    def measures(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        rep = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)

    led = quality_rules.ledger(odd)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in led.collect())
    assert got == sorted((-1 if i is None else i, *measures(t)) for i, t in rows_of(odd))
    kept = quality_rules.apply_policy(led, "v2").collect()
    ab = {r["rule"]: (r["rejects"], r["rejects_alone"]) for r in quality_rules.ablation(led, "v2").collect()}
    for k, rule in enumerate(quality_rules.RULES):
        assert ab[rule] == (sum(r["failed"] >> k & 1 for r in kept), sum(r["failed"] == 1 << k for r in kept))
    assert quality_rules.ledger(none).collect() == []


def test_token_files_round_trip(spark, odd, none):
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    rows = sorted(((2**63 - 1 if i is None else i), t or "") for i, t in rows_of(odd))
    got = sorted(token_files.token_files(odd).collect(), key=lambda r: r["start"])
    at = 0
    for (i, t), r in zip(rows, got, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_files(none).collect() == []


def test_huffman_codes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 700, 49_408):
        counts = np.zeros(50_000, np.int64)
        counts[rng.choice(50_000, n, replace=False)] = (rng.pareto(0.7, n) * 5 + 1).astype(np.int64)
        lengths = token_files.code_lengths(counts)
        used = lengths[lengths > 0].astype(float)
        assert len(used) == n and (n == 0 or used.max() <= 16) and (n < 2 or abs((2.0**-used).sum() - 1) < 1e-12)
        if n:
            ids = rng.choice(np.flatnonzero(counts), 3001)
            payload, marks = token_files.encode_bits(ids, lengths, token_files.canonical(lengths))
            assert (token_files.decode_bits(payload, marks, len(ids), token_files.decode_table(lengths)) == ids).all()
    # without a length limit in the way, the total is that of plain Huffman coding
    import heapq

    counts = rng.integers(1, 1000, 300)
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((token_files.code_lengths(counts) * counts).sum()) == total


def test_word_tokenizer_equals_the_model():
    tok, model = token_files.WordTokenizer(token_files.default_tokenizer()), Tokenizer.from_file(token_files.default_tokenizer())
    texts = ["It's we'LL x'sy a.b, c!! d…, é, É. 5, 3.14; <|endoftext|> A<|startoftext|>b", "", "   ", "ΟΔΟΣ Σας İI ﬁ\x85x\x1cy á ́b", "***!!! word,,,,,,,,,,,, 12,5%"]
    ids, n = tok.encode(pa.array(texts), 1)
    at = 0
    for t, k in zip(texts, n):
        assert ids[at : at + k].tolist() == [*model.encode(t, add_special_tokens=False).ids, 1], t
        at += k


def test_vocabulary_grows_and_words_tell_contexts_apart(spark):
    rng = np.random.default_rng(5)
    follows = {a: b for a, b in zip(range(300), rng.permutation(300))}
    texts = [" ".join(f"w{a} x{follows[a]}" for a in rng.integers(0, 300, 40).tolist()) for _ in range(900)]
    swapped = [" ".join(w for a, b in zip(t.split()[::2], t.split()[1::2]) for w in (b, a)) for t in texts]
    ids = [k for k in range(20000) if zlib.crc32(str(k).encode()) % 7 != 2][:900]
    held = [k for k in range(20000) if zlib.crc32(str(k).encode()) % 7 == 2][:200]
    docs = spark.createDataFrame(list(zip(ids, texts)) + list(zip(held[:100], texts)) + list(zip(held[100:], swapped)), "doc_id long, text string")
    got = {r["doc_id"]: (r["score"], r["base_score"]) for r in lm_score.lm_scores(docs).collect()}
    straight, turned = np.array([got[k] for k in held[:100]]), np.array([got[k] for k in held[100:]])
    assert np.allclose(straight[:, 1], turned[:, 1])  # the same words in another order
    assert straight[:, 0].mean() > turned[:, 0].mean() + 20


def test_hierarchy_normalises():
    words = {b"%d" % k: k for k in range(103)}
    model = lm_score.Hierarchy(words, np.arange(105.0)[::-1], 1)
    climb = lm_score.Climb(model, 1)
    rng = np.random.default_rng(2)
    for _ in range(20):
        climb.step(rng.integers(0, 106, 500), rng.integers(0, 106, 500), rng.integers(0, 105, 500))
    model.rows = climb.p
    y = np.arange(105)
    for two, one in ((105, 105), (3, 104), (50, 7)):
        assert np.isclose(np.exp(model.log_p(np.full(105, two), np.full(105, one), y)).sum(), 1, atol=1e-4)


def test_hierarchy_normalises_and_equals_brute_force():
    """log_p against softmaxes written out: over classes, and over the words of the token's class."""
    rng = np.random.default_rng(2)
    words = {b"w%d" % k: k for k in range(90)}
    m = lm_score.Hierarchy(words, rng.integers(1, 50, 92).astype(float), 7, width=6)
    for name in ("context", "class", "word", "turn"):
        m.rows[name] = rng.normal(0, 0.7, m.rows[name].shape).astype(np.float32)
    p, v = m.rows, 90
    for two, one in ((0, 5), (91, 92), (v + 2, v + 2)):
        y = np.arange(v + 2)
        got = m.log_p(np.full(len(y), two), np.full(len(y), one), y)
        h = p["context"][two] @ p["turn"][:6] + p["context"][one] @ p["turn"][6:]
        by_class = p["class"] @ h + p["class_bias"][:, 0]
        by_class = by_class - np.log(np.exp(by_class).sum())
        for k in y:
            c = m.class_of(np.array([k]))[0]
            want = by_class[c]
            if k < v:
                lo, hi = m.edge[c], m.edge[c + 1]
                s = p["word"][lo:hi] @ h + p["word_bias"][lo:hi, 0]
                want += s[k - lo] - np.log(np.exp(s).sum())
            assert abs(got[k] - want) < 1e-4
        assert abs(np.exp(got).sum() - 1) < 1e-4


def test_held_out_texts_score_above_the_base(spark):
    """On texts it was not trained on the model beats the counts by a hundredth of a digit a token at least."""
    got = lm_score.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    gain = (got["sum(score)"] - got["sum(base_score)"]) / got["sum(n_tokens)"]
    print("gain a token", gain)
    assert gain > 0.01
