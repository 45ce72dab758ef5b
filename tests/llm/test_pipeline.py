import zlib

import numpy as np

import corpus_pipeline
from quiltnet.llm import quality_model
from quiltnet.llm.common import read, stored

from .conftest import SF, rows_of
from .test_scans import brute_hits
from .test_substrings_and_joins import brute_join


def test_each_stage_against_its_input(spark):
    docs = read(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    steps = [docs]
    for name, f in corpus_pipeline.STAGES:
        steps.append(stored(f(spark, steps[-1], SF), "test-stage"))
    assert all(s.columns == docs.columns for s in steps[:-1])
    rows = [rows_of(s) for s in steps[:-1]]
    model = quality_model.fit(quality_model.with_statistics(docs), read(spark, SF, "labels"))
    good = {r["doc_id"] for r in quality_model.scored(quality_model.with_statistics(docs), model).collect() if r["predicted"]}
    assert {i for i, _ in rows[1]} == good
    assert {i for i, _ in rows[2]} == {i for i, _, c, _ in brute_join(rows[1]) if i == c}
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    assert {i for i, _ in rows[3]} == {r[0] for r in brute_hits(rows[2], items) if not r[5]}
    copies = {i: sum(k == i for k, _ in rows[4]) for i, _ in rows[4]}
    assert set(copies) <= {i for i, _ in rows[3]} and max(copies.values()) <= 3
    from quiltnet.llm import token_files
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(token_files.default_tokenizer()), 0
    for (i, t), r in zip(sorted(rows[4]), sorted(steps[5].collect(), key=lambda r: r["start"]), strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_stages_take_awkward_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        now = docs
        for name, f in corpus_pipeline.STAGES:
            now = stored(f(spark, now, SF), "test-odd")
            assert name == corpus_pipeline.STAGES[-1][0] or now.columns == docs.columns
        if docs is none:
            assert now.count() == 0
    names = spark.createDataFrame([(1, "one two three four five six " * 20, "a", 1, 2, 3, "x"), (1, "one two three four five six " * 20, "a", 1, 2, 3, "x")], "doc_id long, text string, source string, _id long, _tag long, row long, key string")
    kept = corpus_pipeline.near_copies(spark, names, SF)
    assert kept.columns == names.columns and kept.count() == 1
    assert corpus_pipeline.mix(spark, names, SF).columns == names.columns
