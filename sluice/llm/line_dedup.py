"""Operator 2 [native]: winnowing over line hashes.

A run is MIN_LINES or more consecutive lines (lines without a word are passed over and always kept).
Every window of MIN_LINES lines keeps its smallest line hash, the last of equals: the window's
fingerprint and the place it stands at depend on the window's lines alone, so two equal windows meet at
their fingerprints (the winnowing guarantee). Fingerprints that occur once are dropped; the others are
joined, each is extended both ways to the windows that chose it, and windows that occurred earlier
(smaller doc_id, or same document and earlier line) are deleted. The extension compares two independent
64-bit hashes of the window's lines. Groups are never paired up: a group's first place is an aggregate.

A run of fewer lines counts by its words: one of LONG_WORDS words or more is a window of its own, with its
own hash as fingerprint. Only the query leaves these out (long_words=None), since its SQL has MIN_LINES alone.

Defined cases: a null or empty text has no lines to delete and returns as it is (null stays null); a
null doc_id is smaller than any other; rows with one doc_id and text are one document to the comparison
and get equal results; extra columns of any name pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import keyed, let, load, on_key

#: Lines in a window: the shortest run that is deleted.
MIN_LINES = 3
#: Words of a shorter run that is deleted as well.
LONG_WORDS = 50
_WORDY = r"[^\x20\x09-\x0D]"


def fingerprints(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """One row for each selected line: its hash, its place and the windows that selected it. Each shorter run of long_words words is a row of its own."""
    least = min_lines if long_words is None else 1
    lines = keyed(docs).select("doc_id", "_th", F.filter(F.split("_text", "\n"), lambda x: x.rlike(_WORDY)).alias("_l")).filter(F.size("_l") >= least)
    hashed = lambda s, n: f"{s} as s, {n} as n, xxhash64(slice(_l, {s} + 1, {n})) as a, xxhash64(reverse(slice(_l, {s} + 1, {n})), 'b') as b"
    chosen = let(
        "transform(_l, (_x, _i) -> struct(xxhash64(_x) as h, -_i as q))",
        "_h",
        f"transform(sequence(0, size(_l) - {min_lines}), _s -> struct(array_min(slice(_h, _s + 1, {min_lines})) as m, {hashed('_s', min_lines)}))",
    )
    # the windows of one fingerprint follow each other: a row begins where the minimum's place changes
    each = let(
        chosen,
        "_v",
        "transform(filter(_v, (_x, _i) -> _i = 0 OR _x.m.q != get(_v, _i - 1).m.q),"
        f" _x -> struct(_x.m.h as h, -_x.m.q as p, transform(filter(slice(_v, _x.s + 1, {min_lines}), _y -> _y.m.q = _x.m.q), _y -> struct(_y.s as s, _y.n as n, _y.a as a, _y.b as b)) as w))",
    )
    if long_words is not None:
        short = [
            f"transform(filter(sequence(0, size(_l) - {n}), _s -> aggregate(slice(_c, _s + 1, {n}), 0, (_t, _x) -> _t + _x) >= {long_words}),"
            f" _s -> struct(xxhash64(slice(_l, _s + 1, {n})) as h, _s as p, array(struct({hashed('_s', n)})) as w))"
            for n in range(1, min_lines)
        ]
        each = f"CASE WHEN size(_l) >= {min_lines} THEN {each} END"
        short = [f"CASE WHEN size(_l) >= {n} THEN {x} END" for n, x in enumerate(short, 1)]
        all_ = f"flatten(filter(array({', '.join([each, *short])}), _x -> _x IS NOT NULL))"
        each = let(f"transform(_l, _x -> regexp_count(_x, r'{_WORDY}+'))", "_c", all_)
    return lines.select("doc_id", "_th", F.explode(F.expr(each)).alias("_f")).select("doc_id", "_th", "_f.h", "_f.p", "_f.w")


def repeated_windows(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(doc_id, _th, _starts): windows (s, n) that occurred earlier: the place, among lines with words, where each starts and its lines."""
    found = fingerprints(docs, min_lines, long_words)
    often = found.groupBy("h").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("h").alias("_oh"))
    shared = found.join(often, F.col("h") == F.col("_oh"), "left_semi").select("doc_id", "_th", F.explode("w").alias("_w")).select("doc_id", "_th", "_w.s", "_w.n", "_w.a", "_w.b")
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("doc_id").isNotNull().alias("k"), F.col("s"))
    first = shared.groupBy("a", "b").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "_first")
    later = shared.join(first, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).filter(place > F.col("_first"))
    return later.groupBy("doc_id", "_th").agg(F.collect_set(F.struct("s", "n")).alias("_starts"))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, counts: bool = False, long_words: int | None = LONG_WORDS) -> DataFrame:
    """docs with the later repeated runs deleted from `text`; counts adds n_lines and n_removed (lines)."""
    row = docs.select("doc_id", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("_th"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    text = F.col("_row")["text"].cast("string")
    marked = on_key(row, repeated_windows(docs, min_lines, long_words), "left")
    wordy = f"transform(filter(transform(_l, (_x, _i) -> struct(_x as x, _i as i)), _x -> _x.x rlike r'{_WORDY}'), _x -> _x.i)"
    gone = let(wordy, "_y", f"transform(array_distinct(flatten(transform(_starts, _s -> sequence(_s.s, _s.s + _s.n - 1)))), _j -> get(_y, _j))")
    kept_lines = let(gone, "_g", "struct(size(_g) as n, array_join(transform(array_except(sequence(0, size(_l) - 1), _g), _i -> get(_l, _i)), '\n') as t)")
    split = marked.withColumn("_cut", F.when(F.col("_starts").isNotNull(), F.expr(let("split(_row.text, '\n')", "_l", kept_lines))))
    kept = F.when(F.col("_starts").isNull(), text).otherwise(F.col("_cut.t"))
    out = [kept.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    n = [F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long").alias("n_lines"), F.coalesce("_cut.n", F.lit(0)).cast("long").alias("n_removed")] if counts else []
    return split.select(*out, *n)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents", "doc_id", "text"), counts=True, long_words=None)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, i, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM t)),
b AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j FROM x WHERE regexp_matches(line, '{_WORDY}')),
w AS (SELECT doc_id, j, list(line) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND {MIN_LINES - 1} FOLLOWING) AS k FROM b),
r AS (SELECT doc_id, j FROM (SELECT doc_id, j, row_number() OVER (PARTITION BY k ORDER BY doc_id, j) AS n FROM w WHERE len(k) = {MIN_LINES}) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, j + unnest(range(0, {MIN_LINES})) AS j FROM r),
gone AS (SELECT b.doc_id, b.i FROM b JOIN g ON b.doc_id = g.doc_id AND b.j = g.j),
k AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.i) FILTER (WHERE gone.i IS NULL) AS kept, count(*) AS n_lines, count(gone.i) AS n_removed
      FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k"""
