"""Operator 8 [native]: secret scans over a trigram inverted index.

Each rule's pattern yields a Boolean trigram query. The index holds (trigram, document) postings of the
trigrams that some query names, taken from the lower-cased text; a document is a candidate of a rule if
its postings satisfy the rule's query, and only candidates are verified by the pattern. Rules without a
mandatory trigram (`hex`) read every text.

Spans are half-open and count code points: what lies between the matches (split) and the matches
themselves alternate, so running sums of their lengths are the places. Defined cases: a null or empty
text has no spans; a null doc_id is a key like any other; repeated rows get equal spans; only doc_id and
text are read, so other columns may bear any name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import keyed, let, load, on_key
from sluice.llm.trigram_query import trigram_query


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Fixed patterns in the order of their kinds: (kind, pattern, group whose length counts, least length). The first three are the base.
RULES = [
    ("assign", "(" + "|".join(map(_either, ["password", "passwd", "secret", "token", "api_?key"])) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("vcs_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
]
BASE = 3
#: Matches whose places are summed up in one fold.
_BLOCK = 256


def queries(rules=RULES) -> dict[str, list[frozenset[str]]]:
    return {kind: trigram_query(pattern) for kind, pattern, *_ in rules}


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for some trigrams: (trigram, doc_id, _th), each once for a row."""
    found = keyed(docs).select("doc_id", "_th", F.lower("_text").alias("_low"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("_low"), t))
    return found.select(F.explode(held).alias("trigram"), "doc_id", "_th")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, _th, _rules): the indexed rules whose trigram query the document's postings satisfy."""
    lists = index.groupBy("doc_id", "_th").agg(F.collect_set("trigram").alias("_g"))
    some = lambda q: " OR ".join("(" + " AND ".join(f"array_contains(_g, {_sql(t)})" for t in sorted(a)) + ")" for a in q)
    tests = [f"CASE WHEN {some(q)} THEN '{kind}' END" for kind, q in queries(rules).items() if q]
    return lists.select("doc_id", "_th", F.expr(f"array_compact(array({', '.join(tests)}))").alias("_rules")).filter(F.size("_rules") > 0)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches in _text, leftmost and apart, whose group is long enough: structs (s, o, e, kind)."""
    sums = lambda some, value, step: f"aggregate({some}, struct(cast(array() as array<int>) as a, 0 as p), (_a, _i) -> struct(array_append(_a.a, _a.p + {value}) as a, _a.p + {step} as p))"
    # a fold copies its array at each step, so sums run within blocks, then over blocks
    blocks = f"transform(sequence(0, (size(_m) - 1) div {_BLOCK}), _k -> {sums(f'sequence(_k * {_BLOCK} + 1, least(size(_m), (_k + 1) * {_BLOCK}))', 'get(_b, _i - 1)', 'get(_b, _i - 1) + get(_m, _i - 1)')})"
    starts = let(blocks, "_q", let(f"{sums('_q', '0', '_i.p')}.a", "_o", "flatten(transform(_q, (_x, _j) -> transform(_x.a, _y -> _y + get(_o, _j))))"))
    walk = let(
        f"transform(regexp_extract_all(_text, {_sql(pattern)}, 0), _x -> char_length(_x))",
        "_m",
        let(
            f"transform(split(_text, {_sql(pattern)}, -1), _x -> char_length(_x))",
            "_b",
            f"""transform(zip_with({starts}, regexp_extract_all(_text, {_sql(pattern)}, {group}), (_s, _x) -> struct(_s as s, char_length(_x) as n)),
              (_x, _i) -> struct(_x.s as s, {order} as o, _x.s + get(_m, _i) as e, '{kind}' as kind, _x.n as n))""",
        ),
    )
    return F.expr(f"CASE WHEN regexp_like(_text, {_sql(pattern)}) THEN transform(filter({walk}, _x -> _x.n >= {least}), _x -> struct(_x.s, _x.o, _x.e, _x.kind)) ELSE array() END")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row for each of docs: doc_id, _th, spans (array of start, kind's order, end, kind, sorted)."""
    wanted = queries(rules)
    trigrams = sorted({t for q in wanted.values() for a in q for t in a})
    rows = keyed(docs)
    if trigrams:
        rows = on_key(rows, candidates(postings(docs, trigrams), rules), "left")
    else:
        rows = rows.withColumn("_rules", F.array().cast("array<string>"))
    each = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        found = _spans(order, kind, pattern, group, least)
        each.append(F.when(F.array_contains("_rules", kind), found).otherwise(F.array()) if wanted[kind] else found)
    return rows.select("doc_id", "_th", F.sort_array(F.concat(*each)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    out = scan(load(spark, sf_dir, "documents", "doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["o"] < BASE)
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _duck(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return (
        f"SELECT r, {order} AS o, '{kind}' AS kind, list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, length(m[i]) AS n, length(g[i]) AS k, {least} AS least"
        f" FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS b, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d)"
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(_duck(i, *rule) for i, rule in enumerate(RULES))}),
x AS (SELECT r, o, kind, s, kind || ':' || s || ':' || (s + n) AS v FROM a WHERE k >= least),
j AS (SELECT r, count(*) FILTER (WHERE o = 0) AS n0, count(*) FILTER (WHERE o = 1) AS n1, count(*) FILTER (WHERE o = 2) AS n2,
        string_agg(v, ',' ORDER BY s, o) FILTER (WHERE o < {BASE}) AS base, string_agg(v, ',' ORDER BY s, o) AS spans FROM x GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON d.r = j.r"""
