"""License scans: an exact set-similarity join of text blocks with license templates.

Texts are folded and cut into words; blocks are runs of 64 words that start every 32 words, so any
passage of up to 33 words lies whole in one of them. A template is a license sentence (longer ones are
cut into parts of 32 words), as the set of its words. A block meets a template if it contains at least
`least` hundredths of that set, or all of it where it has fewer than SHORT words.

Words of templates are ordered by how often they stand in the whole corpus, rare ones first; other words
can never match and are dropped at once. With o words needed out of a template of t, a block can only meet
it if the two share one of the template's t - o + 1 rarest words (prefix filter), if the block has o words
of the order at all (length filter), and if enough words are left after the first shared one on both sides
(positional filter). What passes is counted exactly, after words have been held byte by byte against the
template's. Phrases are templates of which every word is needed; in the blocks that meet one, the places
where its words stand in a row are taken.

Both passes, the counts and the join, read texts in place; nothing is shuffled but counts of template words.
Templates are a parameter of at most MAX_WORDS words and go to the tasks with the code.

Defined cases: null or empty text has no words, no labels and score 0; a text shorter than a block is one
block; repeated rows are judged alike; texts of any length are scanned whole; an empty table gives an empty
result; other columns, whatever their names, are not read; templates without words meet nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLD, MB, batches, read, utf8, word_bounds, word_hashes
from .decontaminate import WORD

BLOCK, STEP, LEAST = 64, 32, 80
#: Templates with fewer different words than this are met by all of them only: one word tells such licenses apart.
SHORT = 10
#: Words that all templates have together at most.
MAX_WORDS = 100_000

#: Phrases with the labels they give.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
#: Sentences by which licenses are known, with their labels.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: str) -> list[bytes]:
    raw, offsets = utf8(pa.array([text], pa.large_string()))
    s, e, _ = word_bounds(raw, offsets, WORD)
    low = FOLD[raw].tobytes()
    return [low[a:z] for a, z in zip(s.tolist(), e.tolist())]


class Vocabulary:
    """The words of all templates: ids by hash, and their bytes to hold a hit against."""

    def __init__(self, words: list[bytes]):
        self.words = words
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        h = word_hashes(raw, ends - [len(w) for w in words], ends)
        self.order = np.argsort(h, kind="stable")
        self.hashes, self.raw, self.starts, self.lengths = h[self.order], raw, ends - [len(w) for w in words], np.array([len(w) for w in words], np.int64)
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two template words share a hash")

    def find(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The id of each word, -1 where it is none of these; hits are compared byte by byte."""
        out = np.full(len(s), -1, np.int64)
        if not len(s) or not len(self.words):
            return out
        h = word_hashes(raw, s, e)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        ids = self.order[at[hit]]
        n = e[hit] - s[hit]
        hit, ids, n = hit[n == self.lengths[ids]], ids[n == self.lengths[ids]], n[n == self.lengths[ids]]
        if len(hit):
            first = np.cumsum(n) - n
            step = np.arange(n.sum()) - np.repeat(first, n)
            equal = FOLD[raw[np.repeat(s[hit], n) + step]] == self.raw[np.repeat(self.starts[ids], n) + step]
            whole = np.logical_and.reduceat(equal, first)
            out[hit[whole]] = ids[whole]
        return out


def _batches(it: Iterator[pa.RecordBatch], vocabulary: Vocabulary, column: int):
    for b in batches(it, MB):
        raw, offsets = utf8(b.column(column))
        s, e, row = word_bounds(raw, offsets, WORD)
        yield b, row, vocabulary.find(raw, s, e)


def word_counts(docs: DataFrame, words: list[bytes]) -> np.ndarray:
    """How often each template word stands in all texts."""
    vocabulary = Vocabulary(words)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(words), np.int64)
        for _, _, ids in _batches(it, vocabulary, 0):
            n += np.bincount(ids[ids >= 0], minlength=len(words))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["w", "n"])

    out = np.zeros(len(words), np.int64)
    for w, n in docs.select(_text()).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n")).collect():  # MAX_WORDS rows at most
        out[w] = n
    return out


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")


def _spread(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value as often as its count says, and 0, 1, ... within each."""
    return np.repeat(values, counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Index:
    """Templates as sets of ranks, their prefixes by rank, and how many words of each are needed."""

    def __init__(self, sets: list[list[int]], needed: list[int], n_ranks: int):
        self.needed, self.n_ranks = np.array(needed, np.int64), n_ranks
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.flat = np.array([r for x in sets for r in sorted(x)], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        prefix = sorted((r, t, i) for t, x in enumerate(sets) for i, r in enumerate(sorted(x)[: len(x) - needed[t] + 1]))
        self.rank, self.template, self.at = (np.array([p[k] for p in prefix], np.int64) for k in range(3))
        self.in_prefix = np.zeros(n_ranks + 1, bool)  # one more for -1
        self.in_prefix[self.rank] = True

    def join(self, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(block, template, shared words) of all pairs that meet, from the distinct pairs (block, rank), sorted,
        and how many pairs were counted exactly."""
        none = np.zeros(0, np.int64)
        if not len(block):
            return none, none, none, 0
        own, start, size = np.unique(block, return_index=True, return_counts=True)
        start, size = np.repeat(start, size), np.repeat(size, size)
        at = np.arange(len(block)) - start  # place in the block's own order
        lo, hi = np.searchsorted(self.rank, rank), np.searchsorted(self.rank, rank, side="right")
        x, k = _spread(np.arange(len(block)), hi - lo)
        p = lo[x] + k
        t, i, j, n = self.template[p], self.at[p], at[x], size[x]
        need = self.needed[t]
        keep = (n >= need) & (j <= n - need)  # length, and the block's own prefix
        x, t, i, j, n, need = (a[keep] for a in (x, t, i, j, n, need))
        _, first = np.unique(block[x] * len(self.sizes) + t, return_index=True)  # in rank order: the first shared word
        keep = first[1 + np.minimum(self.sizes[t[first]] - i[first], n[first] - j[first]) - 1 >= need[first]]
        b, t = block[x[keep]], t[keep]
        c, k = _spread(np.arange(len(b)), self.sizes[t])
        want = b[c] * self.n_ranks + self.flat[self.first[t[c]] + k]
        have = block * self.n_ranks + rank
        found = have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want
        shared = np.bincount(c[found], minlength=len(b))
        meets = shared >= self.needed[t]
        return b[meets], t[meets], shared[meets], len(b)


_HITS = "n_words long, meets array<struct<template: int, word: long, shared: int>>, places array<struct<template: int, word: long>>"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: int = LEAST) -> DataFrame:
    """Per document: doc_id, n_words, meets (blocks by their first word, with the template's part that they meet and the
    words shared) and places (first words of phrases). Numbers name parts(templates), then phrases."""
    pieces = [(label, w) for label, w in parts(templates) + [(label, words_of(p)) for label, p in phrases] if w]
    words = sorted({w for _, x in pieces for w in x})
    if len(words) > MAX_WORDS:
        raise ValueError(f"templates have more than {MAX_WORDS} different words")
    order = np.lexsort((np.arange(len(words)), word_counts(docs, words)))  # rare words first
    ranked = [words[i] for i in order]
    rank_of = {w: k for k, w in enumerate(ranked)}
    lists = [[rank_of[w] for w in x] for _, x in pieces]
    n_templates = len(pieces) - sum(1 for _, p in phrases if words_of(p))
    sets = [sorted(set(x)) for x in lists]
    needed = [-(-least * len(x) // 100) if t < n_templates and len(x) >= SHORT else len(x) for t, x in enumerate(sets)]
    index, vocabulary = Index(sets, needed, len(words)), Vocabulary(ranked)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, ids in _batches(it, vocabulary, 1):
            n_words = np.bincount(row, minlength=b.num_rows)
            first = np.cumsum(n_words) - n_words
            blocks = np.where(n_words > 0, 1 + np.maximum(0, -(-(n_words - BLOCK) // STEP)), 0)
            base = np.cumsum(blocks) - blocks
            meets, places = defaultdict(list), defaultdict(list)

            def blocks_of(at):
                """(place in at, block) for both blocks of each word."""
                r = row[at]
                k = (at - first[r]) // STEP
                x = np.r_[np.arange(len(at)), np.arange(len(at))]
                k = np.r_[k, k - 1]
                ok = (k >= 0) & (k < blocks[r[x]])
                return x[ok], base[r[x[ok]]] + k[ok]

            rare = np.zeros(int(blocks.sum()) + 1, bool)
            rare[blocks_of(np.flatnonzero(index.in_prefix[ids]))[1]] = True
            known = np.flatnonzero(ids >= 0)
            x, k = blocks_of(known)
            x, k = x[rare[k]], k[rare[k]]
            pairs = np.unique(k * len(words) + ids[known[x]])
            block, template, shared, _ = index.join(pairs // max(1, len(words)), pairs % max(1, len(words)))
            doc = np.searchsorted(base + blocks, block, side="right")
            start = (block - base[doc]) * STEP
            for d, t, w, s in zip(doc.tolist(), template.tolist(), start.tolist(), shared.tolist()):
                if t < n_templates:
                    meets[d].append((t, w, s))
            for t in range(n_templates, len(lists)):
                some = template == t
                inside = np.zeros(len(ids) + 1, np.int64)  # words of the blocks that have all words of the phrase
                np.add.at(inside, first[doc[some]] + start[some], 1)
                np.add.at(inside, first[doc[some]] + np.minimum(start[some] + BLOCK, n_words[doc[some]]), -1)
                at, phrase = np.flatnonzero(np.cumsum(inside[:-1]) > 0), lists[t]
                at = at[at + len(phrase) <= first[row[at]] + n_words[row[at]]]
                for j, r in enumerate(phrase):
                    at = at[ids[at + j] == r]
                for d, w in zip(row[at].tolist(), (at - first[row[at]]).tolist()):
                    places[d].append((t, w))
            kind = pa.list_(pa.struct([("template", pa.int32()), ("word", pa.int64()), ("shared", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n_words, pa.int64()),
                    pa.array([[{"template": t, "word": w, "shared": s} for t, w, s in meets.get(i, ())] for i in range(b.num_rows)], kind),
                    pa.array([[{"template": t, "word": w} for t, w in places.get(i, ())] for i in range(b.num_rows)], pa.list_(pa.struct([("template", pa.int32()), ("word", pa.int64())]))),
                ],
                ["doc_id", "n_words", "meets", "places"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text()).mapInArrow(run, f"doc_id long, {_HITS}")


_TABLE = "array<struct<label: string, size: int>>"


def parts(templates=TEMPLATES) -> list[tuple[str, list[bytes]]]:
    """Templates with words, cut so that each part can lie in a block: (label, words)."""
    return [(label, w[i : i + STEP]) for label, text in templates for w in [words_of(text)] for i in range(0, len(w), STEP)]


def license_blocks(docs: DataFrame, templates=TEMPLATES, least: int = LEAST) -> DataFrame:
    """(doc_id, label, first_word, contained): every block that meets a template, with the share of it that it contains."""
    own = parts(templates)
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(len(set(w))).alias("size")) for label, w in own]).cast(_TABLE)
    hit = scan(docs, templates, [], least).select("doc_id", F.explode("meets").alias("m")).withColumn("t", F.get(table, F.col("m.template")))
    return hit.select("doc_id", F.col("t.label").alias("label"), F.col("m.word").alias("first_word"), (F.col("m.shared") / F.col("t.size")).alias("contained"))


def licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: int = LEAST) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, and score: the largest share of a
    template in a block that meets it, 1 where a phrase stands, else 0."""
    pieces = [(label, len(set(w))) for label, w in parts(templates) + [(label, words_of(p)) for label, p in phrases] if w]
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(size).alias("size")) for label, size in pieces]).cast(_TABLE)
    of = lambda x: F.get(table, x["template"])
    joined = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(a)))
    base, more = F.transform("places", lambda x: of(x)["label"]), F.transform("meets", lambda x: of(x)["label"])
    best = F.array_max(F.transform("meets", lambda x: x["shared"] / of(x)["size"]))
    at = F.transform("places", lambda x: x["word"])
    return scan(docs, templates, phrases, least).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read(spark, sf_dir, "documents"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_VALUES = lambda rows: ", ".join(f"('{label}', '{text}')" for label, text in rows)
OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL.format("text")} AS ws FROM documents),
whole AS (SELECT label, {_WORDS_SQL.format("text")} AS ws FROM (VALUES {_VALUES(TEMPLATES)}) v(label, text)),
t AS (SELECT label, list_distinct(ws[i + 1:i + {STEP}]) AS ws FROM (SELECT label, ws, unnest(range(0, len(ws), {STEP})) AS i FROM whole)),
p AS (SELECT label, {_WORDS_SQL.format("text")} AS ws FROM (VALUES {_VALUES(PHRASES)}) v(label, text)),
b AS (SELECT r, ws[i * {STEP} + 1:i * {STEP} + {BLOCK}] AS ws FROM (SELECT r, ws, unnest(range(0, 1 + greatest(0, (len(ws) - {BLOCK} + {STEP - 1}) // {STEP}))) AS i FROM d WHERE len(ws) > 0)),
m AS (SELECT r, label, len(list_intersect(t.ws, b.ws)) AS shared, len(t.ws) AS size FROM b, t WHERE 100 * len(list_intersect(t.ws, b.ws)) >= CASE WHEN len(t.ws) < {SHORT} THEN 100 ELSE {LEAST} END * len(t.ws)),
o AS (SELECT r, label, i - 1 AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) x, p WHERE x.ws[i:i + len(p.ws) - 1] = p.ws),
og AS (SELECT r, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM o GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM o UNION ALL SELECT r, label FROM m) GROUP BY r),
s AS (SELECT r, max(CAST(shared AS DOUBLE) / size) AS best FROM m GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN og USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""
