"""Operator 9 [native]: a ledger of quality rules.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; policies are versioned bit masks applied to the stored bits, and ablations are bitwise
aggregations over them: neither reads a text again.

Defined cases: a null or empty text has no words and fails `few_words`; other columns may be null or
bear any name (only `doc_id` and `text` are read; the ledger column replaces one of its own name);
repeated rows get equal ledgers; an empty table gives an empty ledger. Repeated windows are found by
hash and then compared as words, so a hash collision changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import WORD, let

#: Bit position is the place in this list; add rules at its end only. Each is (name, SQL over the measurements).
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "n_words > 0 AND n_symbols > n_words"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("repeated_lines", "n_lines >= 6 AND 100 * n_dup_lines > 60 * n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies: a document is rejected if it fails any rule of the mask.
POLICIES = {"2024-base": BASE, "2025-full": sum(BIT.values())}
DEFAULT_POLICY = "2025-full"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _repeat_words() -> str:
    """SQL for the words inside 3-word windows found twice or more, over _w (words).

    Window hashes share a long with their positions, so one primitive sort puts equal windows side by side;
    the few that meet are sorted again by their words. Every step is linear or n log n in the text.
    """
    meet = lambda a, b: f"coalesce({a} = {b}, false)"
    return f"""
    CASE WHEN size(_w) < 4 THEN 0L ELSE get(transform(array(ceil(log2(size(_w) + 1D)) + 1), _b -> cast(get(
      transform(array(sort_array(transform(sequence(1, size(_w) - 2), _i ->
          shiftleft(xxhash64(element_at(_w, _i), element_at(_w, _i + 1), element_at(_w, _i + 2)), cast(_b as int)) | cast(_i as bigint)))),
        _s -> get(
      transform(array(transform(filter(_s, (_x, _j) -> {meet("shiftright(_x, cast(_b as int))", "shiftright(get(_s, _j - 1), cast(_b as int))")}
                                  OR {meet("shiftright(_x, cast(_b as int))", "shiftright(get(_s, _j + 1), cast(_b as int))")}),
                       _x -> cast(_x & (shiftleft(1L, cast(_b as int)) - 1) as int))),
        _p -> CASE WHEN size(_p) = 0 THEN 0L ELSE get(
      transform(array(sort_array(transform(_p, _i -> struct(concat_ws(' ', slice(_w, _i, 3)) as g, _i as i)))),
        _g -> get(
      transform(array(sort_array(transform(filter(_g, (_x, _j) -> {meet("_x.g", "get(_g, _j - 1).g")} OR {meet("_x.g", "get(_g, _j + 1).g")}), _x -> _x.i))),
        _q -> aggregate(transform(_q, (_x, _j) -> least(3, coalesce(get(_q, _j + 1) - _x, 3))), 0L, (_a, _x) -> _a + _x)), 0)), 0) END), 0)), 0) as bigint)), 0) END"""


def ledger(docs: DataFrame, column: str = "quality") -> DataFrame:
    """docs with a struct column: the measurements, and `fail_bits` with one bit per rule of RULES."""
    names = [c for c in docs.columns if c != column]
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("_row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_t"))
    return packed.select(*[F.col("_row").getField(c).alias(c) for c in names], F.expr(_ledger_sql()).alias(column))


def _ledger_sql() -> str:
    """The whole ledger as one expression over _t, with every shared value bound: an optimizer that moves or copies it can't compute a part for each word."""
    word = WORD.replace("\\", "\\\\")
    wordy = r"[^\\x20\\x09-\\x0D]"
    measures = f"""struct(cast(size(_w) as bigint) as n_words, cast(char_length(array_join(_w, '')) as bigint) as word_chars,
      cast(regexp_count(_t, '[#*$%&|<>]') as bigint) as n_symbols, cast(size(_l) as bigint) as n_lines,
      cast(size(_l) - size(array_distinct(_l)) as bigint) as n_dup_lines, cast({_repeat_words()} as bigint) as n_repeat_words)"""
    rule = lambda text: re.sub(rf"\b({'|'.join(MEASURES)})\b", r"_m.\1", text)
    bits = " | ".join(f"CASE WHEN {rule(text)} THEN {1 << i}L ELSE 0L END" for i, (_, text) in enumerate(RULES))
    out = f"struct({', '.join(f'_m.{m} as {m}' for m in MEASURES)}, {bits} as fail_bits)"
    return let(f"regexp_extract_all(_t, '{word}', 0)", "_w", let(f"filter(split(_t, '\n'), _x -> _x rlike '{wordy}')", "_l", let(measures, "_m", out)))


def apply_policy(ledgered: DataFrame, policy: str = DEFAULT_POLICY, column: str = "quality") -> DataFrame:
    """Rows that fail no rule of the policy."""
    return ledgered.filter(F.col(column)["fail_bits"].bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(ledgered: DataFrame, policy: str = DEFAULT_POLICY, column: str = "quality") -> DataFrame:
    """Per rule of the policy: documents that fail it, and those it alone rejects. Groups are bit patterns, so at most 2**len(RULES)."""
    mask = POLICIES[policy]
    patterns = ledgered.groupBy(F.col(column)["fail_bits"].bitwiseAND(F.lit(mask)).alias("_bits")).agg(F.count("*").alias("_n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if bit & mask])
    each = patterns.withColumn("_r", F.explode(rules))
    failed, alone = F.col("_bits").bitwiseAND(F.col("_r.bit")) != 0, F.col("_bits") == F.col("_r.bit")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("_r.rule").alias("rule")).agg(total(failed).alias("n_failed"), total(alone).alias("n_only_this"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = lambda name: F.col(f"quality.{name}")
    failed = lambda mask: q("fail_bits").bitwiseAND(F.lit(mask)) != 0
    return ledger(docs).select(
        "doc_id", q("n_words"), q("word_chars"), q("n_symbols"), q("n_dup_lines"), q("n_repeat_words"), failed(BASE).alias("base_failed"), (~failed(POLICIES[DEFAULT_POLICY])).alias("kept"), q("fail_bits")
    )


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
m AS (SELECT w.r, doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.r = rep.r),
f AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, n_words > 0 AND n_symbols > n_words AS f2,
        n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS f3, n_lines >= 6 AND 100 * n_dup_lines > 60 * n_lines AS f4 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4) AS kept,
  (f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT)::BIGINT AS fail_bits FROM f"""
