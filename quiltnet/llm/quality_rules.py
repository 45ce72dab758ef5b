"""Quality rules as a bitmask ledger, in DataFrame and SQL functions only.

`measure` takes every measurement of a text once. `ledger` evaluates each rule once and stores the
failures as bits of one long beside the measurements. A policy is a version name and a mask of the
rules it applies: `apply_policy` is one bitwise AND, and `ablation` counts, from one grouped pass
over the distinct bit patterns, what each rule rejects, rejects alone, and would let back in.

Defined cases: null text has no words and no lines; a text without words fails `few_words`; ties
and repeated rows are judged independently; an empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Splitting once gives the words; array lambdas bind intermediate arrays, so nothing is evaluated per element twice.
_MEASURES = r"""
transform(array(filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')), ws -> named_struct(
  'n_words', cast(size(ws) as bigint),
  'word_chars', cast(char_length(array_join(ws, '')) as bigint),
  'n_repeat_words', cast(if(size(ws) < 4, 0,
    transform(array(array_sort(transform(sequence(0, size(ws) - 3),
        i -> named_struct('h', xxhash64(ws[i], ws[i + 1], ws[i + 2]), 'i', i)))), s ->
      transform(array(array_sort(transform(
          filter(sequence(0, size(s) - 1), k -> s[k].h <=> get(s, k - 1).h or s[k].h <=> get(s, k + 1).h),
          k -> s[k].i))), r ->
        if(size(r) = 0, 0, aggregate(sequence(0, size(r) - 1), 0,
          (a, k) -> a + least(3, coalesce(get(r, k + 1) - r[k], 3)))))[0])[0]) as bigint)))[0]
"""
_LINES = r"""
transform(array(filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')), ls -> named_struct(
  'n_lines', cast(size(ls) as bigint), 'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) as bigint)))[0]
"""
MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")

#: name -> failing condition over the measurements. A rule keeps its bit for ever; new rules are appended.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "10 * word_chars < 25 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "duplicate_lines": "n_lines >= 4 and 10 * n_dup_lines > 4 * n_lines",
    "shouting": "n_letters >= 50 and 2 * n_upper > n_letters",
    "few_letters": "2 * n_letters < word_chars",
}
BASE_RULES = ("few_words", "repeated_words")


def mask_of(names, rules: dict[str, str] = RULES) -> int:
    order = list(rules)
    return sum(1 << order.index(x) for x in names)


#: version -> the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "duplicate_lines"),
    "v2": tuple(RULES),
}


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements...) for every whole text."""
    t = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    m = t.select(
        "doc_id", F.expr(_MEASURES).alias("m"), F.expr(_LINES).alias("l"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
    )
    return m.select("doc_id", "m.n_words", "m.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "m.n_repeat_words", "n_upper", "n_letters")


def _bits(rules: dict[str, str]) -> Column:
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules; start a second one")
    bits = F.lit(0).cast("long")
    for k, cond in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(cond), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """measure(docs) with `failed`, the bits of the rules that a document fails."""
    return measure(docs).withColumn("failed", _bits(rules))


def apply_policy(led: DataFrame, version: str, policies=POLICIES, rules: dict[str, str] = RULES) -> DataFrame:
    mask = mask_of(policies[version], rules)
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(led: DataFrame, version: str, policies=POLICIES, rules: dict[str, str] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, and documents that only this rule rejects."""
    mask, order = mask_of(policies[version], rules), list(rules)
    patterns = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    hit = lambda b: F.sum(F.when(F.col("bits").bitwiseAND(F.lit(b).cast("long")) != 0, F.col("n")).otherwise(0))
    sole = lambda b: F.sum(F.when(F.col("bits") == b, F.col("n")).otherwise(0))
    items = [(name, 1 << order.index(name)) for name in policies[version]]
    one = patterns.agg(F.array(*[F.struct(F.lit(n).alias("rule"), hit(b).alias("rejects"), sole(b).alias("rejects_alone")) for n, b in items]).alias("x"))
    return one.select(F.inline("x"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(read(spark, sf_dir, "documents")), "v2")
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE_RULES)).cast("long")) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed", "n_lines", "n_upper", "n_letters",
    )


_RULE_SQL = " + ".join(f"CASE WHEN {cond} THEN {1 << k} ELSE 0 END" for k, cond in enumerate(RULES.values()))
OP9_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
g2 AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS tri FROM g),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g2),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM g3, (VALUES (0), (1), (2)) AS o(d) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS BIGINT) AS n_letters
  FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST({_RULE_SQL} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       failed = 0 AS kept, failed, n_lines, n_upper, n_letters
FROM f
"""
