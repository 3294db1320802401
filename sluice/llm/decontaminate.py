"""Operator 7 [native]: benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. Each window
of WINDOW words keeps its smallest GRAM-word hash: equal windows keep equal fingerprints, so joining the
fingerprints of documents and benchmark finds every shared window. Hits are extended: the windows around
a joined fingerprint are compared word by word with the benchmark's. An item of fewer words is one window
of its own length, with its hash as fingerprint.

The benchmark's side is broadcast only while its size, checked at run time, is below BROADCAST_BYTES;
beyond, the same joins shuffle. Defined cases: null or empty texts have no words and no hits; an item
without words matches nothing; an item with a null item_id makes hits, but is not named in items (only the
query leaves its windows out, as its SQL does: unnamed=False); repeated rows get equal results; other
columns, of any name, are not read; empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import checkpoint, keyed, let, load, lower_az, on_key

WINDOW, GRAM = 10, 5
#: A benchmark side below this is broadcast; beyond, Spark shuffles both.
BROADCAST_BYTES = 32 << 20
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(text), F.lit(_WORDS), F.lit(0))


def _minima(n: int = WINDOW, gram: int = GRAM) -> str:
    """SQL: the smallest gram hash of each n-word window of _w, by window."""
    return f"CASE WHEN size(_w) < {n} THEN array() ELSE {let(_grams(gram), '_g', f'transform(sequence(1, size(_w) - {n - 1}), _i -> array_min(slice(_g, _i, {n - gram + 1})))')} END"


def _grams(n: int) -> str:
    return f"CASE WHEN size(_w) < {n} THEN array() ELSE transform(sequence(1, size(_w) - {n - 1}), _i -> xxhash64(slice(_w, _i, {n}))) END"


def benchmark_windows(benchmark: DataFrame, unnamed: bool = True) -> DataFrame:
    """(n, f, window, items): each distinct window with its length, fingerprint and the items that hold it; unnamed takes items with a null id too."""
    split = benchmark.select(F.col("item_id").alias("_item"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_w")).filter(F.size("_w") > 0)
    split = split if unnamed else split.filter(F.col("_item").isNotNull())
    cut = split.select(
        "_item",
        F.explode(
            F.expr(
                f"CASE WHEN size(_w) < {WINDOW} THEN array(struct(size(_w) as n, xxhash64(_w) as f, concat_ws(' ', _w) as window))"
                f" ELSE transform({_minima()}, (_m, _i) -> struct({WINDOW} as n, _m as f, concat_ws(' ', slice(_w, _i + 1, {WINDOW})) as window)) END"
            )
        ).alias("_x"),
    )
    return cut.groupBy("_x.n", "_x.f", "_x.window").agg(F.collect_set("_item").alias("items"))


def _fingerprints(n: int) -> str:
    """SQL: for each window of n words of _w its fingerprint."""
    return _minima() if n == WINDOW else _grams(n)


def contamination(docs: DataFrame, benchmark: DataFrame, unnamed: bool = True) -> DataFrame:
    """Per document: doc_id, _th (the text's hash), n_words, hits (array of word places), items (array of item_ids). One row for each row of docs."""
    bench = checkpoint(benchmark_windows(benchmark, unnamed))
    lengths = sorted(r[0] for r in bench.select("n").distinct().collect())  # at most WINDOW numbers
    split = keyed(docs).select("doc_id", "_th", words(F.col("_text")).alias("_w"))
    # beside its fingerprints each row sends its number of words, under a key that no window has
    each = [f"transform(array_distinct({_fingerprints(n)}), _x -> struct({n} as n, _x as f, 0 as c))" for n in lengths]
    own = "array(struct(0 as n, _th as f, size(_w) as c))"
    sent = split.select("doc_id", "_th", F.explode(F.expr(f"concat({', '.join([own, *each])})")).alias("_x"))
    prints = _hinted(bench, bench.select(F.col("n").alias("_n"), F.col("f").alias("_bf")).distinct())
    met = sent.join(prints, (F.col("_x.n") == F.col("_n")) & (F.col("_x.f") == F.col("_bf")), "left").filter(F.col("_n").isNotNull() | (F.col("_x.n") == 0))
    mine = F.col("_x.n") == 0
    one = met.groupBy("doc_id", "_th").agg(F.max(F.when(mine, F.col("_x.c"))).cast("long").alias("n_words"), F.count(F.when(mine, 1)).cast("int").alias("_same"), F.collect_set(F.when(~mine, F.struct("_x.n", "_x.f"))).alias("_hit"))
    one = checkpoint(one)
    found = _extended(docs, one.filter(F.size("_hit") > 0).select("doc_id", "_th", "_hit"), bench, lengths)
    out = on_key(one, found, "left").withColumn("_same", F.explode(F.expr("array_repeat(0, _same)")))
    hits, items = F.coalesce("hits", F.array().cast("array<int>")), F.coalesce("items", F.array().cast(bench.schema["items"].dataType))
    return out.select("doc_id", "_th", "n_words", hits.alias("hits"), items.alias("items"))


def _extended(docs: DataFrame, candidates: DataFrame, bench: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, _th, hits, items): the candidates' windows around their joined fingerprints, compared with the benchmark's windows."""
    size = candidates.select(F.sum(64 + 16 * F.size("_hit"))).first()[0] or 0
    texts = on_key(keyed(docs), F.broadcast(candidates) if size < BROADCAST_BYTES else candidates, "inner").select("doc_id", "_th", words(F.col("_text")).alias("_w"), "_hit")
    per = [
        let(f"transform(filter(_hit, _x -> _x.n = {n}), _x -> _x.f)", "_h",
            f"transform(filter(transform({_fingerprints(n)}, (_x, _i) -> struct(_x as f, _i as i)), _x -> array_contains(_h, _x.f)), _x -> struct({n} as n, _x.i as i, concat_ws(' ', slice(_w, _x.i + 1, {n})) as window))")
        for n in lengths
    ] or ["cast(array() as array<struct<n: int, i: int, window: string>>)"]
    windows = texts.select("doc_id", "_th", F.explode(F.expr(f"concat({', '.join(per)})")).alias("_x"))
    known = bench.groupBy(F.col("window").alias("_bw")).agg(F.flatten(F.collect_list("items")).alias("items"))
    matched = windows.join(_hinted(bench, known), F.col("_x.window") == F.col("_bw"))
    grouped = matched.groupBy("doc_id", "_th").agg(F.collect_set(F.struct("_x.n", "_x.i")).alias("_p"), F.flatten(F.collect_set("items")).alias("_items"))
    places = F.expr("array_distinct(flatten(transform(_p, _x -> sequence(_x.i, _x.i + _x.n - 1))))")
    return grouped.select("doc_id", "_th", places.alias("hits"), F.array_distinct("_items").alias("items"))


def _hinted(bench: DataFrame, df: DataFrame) -> DataFrame:
    """df, derived from the benchmark's windows, marked for broadcast if those fit."""
    size = bench.select(F.sum(F.octet_length("window") + 8 * F.size("items") + 64)).first()[0] or 0
    return F.broadcast(df) if size < BROADCAST_BYTES else df


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold any window of the benchmark."""
    bad = contamination(docs, benchmark).filter(F.size("hits") > 0).select("doc_id", "_th").distinct()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("_th"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return on_key(rows, bad, "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = contamination(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"), unnamed=False)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(0, greatest(len(w) - {WINDOW} + 1, 1))) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.r = p.r LEFT JOIN t ON d.r = t.r"""
