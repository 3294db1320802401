"""Every operator against a brute-force version, on rows that hold the edge cases, and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import registry

sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
WS = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda i: (i is not None, i or 0)  # noqa: E731  null is smaller than any
Q = {n.split("_")[0]: f for n, f in registry.queries().items()}


def got(spark, tables, op, which="full"):
    return Q[op](spark, tables[which])


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def ids_of(text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = ids_of.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


crc = lambda ids: zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("op", sorted(Q))
def test_empty_tables(spark, tables, op):
    assert got(spark, tables, op, "empty").count() == 0


def test_token_store(spark, tables):
    found = sorted(rows(got(spark, tables, "op1"), "doc_id", "n_tokens", "ids_crc32").elements(), key=lambda r: (low(r[0]), r[1:]))
    want = sorted(((i, len(x), crc(x)) for i, x in ((i, ids_of(t, 1)) for i, t in tables["docs"])), key=lambda r: (low(r[0]), r[1:]))
    assert found == want
    at, placed = 0, sorted((r.start, r.n_tokens, low(r.doc_id)) for r in got(spark, tables, "op1").collect())
    for start, n, _ in placed:
        assert start == at
        at += n
    assert [p[2] for p in placed] == sorted(p[2] for p in placed)


def test_line_dedup(spark, tables):
    docs, m = tables["docs"], 3
    first, wordy = {}, {}
    for i, t in set(docs):
        wordy[i, t] = [(k, x) for k, x in enumerate((t or "").split("\n")) if WS.search(x)]
        for s in range(len(wordy[i, t]) - m + 1):
            key = tuple(x for _, x in wordy[i, t][s : s + m])
            first[key] = min(first.get(key, ((True, 2**62), 0)), (low(i), s))
    want = Counter()
    for i, t in docs:
        b, gone = wordy[i, t], set()
        for s in range(len(b) - m + 1):
            if first[tuple(x for _, x in b[s : s + m])] < (low(i), s):
                gone |= {k for k, _ in b[s : s + m]}
        lines = (t or "").split("\n")
        want[i, len(lines), len(gone), sha("\n".join(x for k, x in enumerate(lines) if k not in gone))] += 1
    assert rows(got(spark, tables, "op2"), "doc_id", "n_lines", "n_removed", "kept_sha256") == want
    assert any(k[2] for k in want)


def test_suffix_dedup(spark, tables):
    n, docs = 400, [(i, (t or "").encode()) for i, t in tables["docs"]]
    seen = Counter(x[k : k + n] for _, x in docs for k in range(len(x) - n + 1))
    want = Counter()
    for i, x in docs:
        hit = bytearray(len(x))
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                hit[k : k + n] = b"\1" * n
        spans = sum(1 for k in range(len(x)) if hit[k] and (k == 0 or not hit[k - 1]))
        want[i, len(x), sum(hit), spans, sha(bytes(c for c, h in zip(x, hit) if not h))] += 1
    assert rows(got(spark, tables, "op3"), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert any(0 < k[2] < k[1] for k in want)


def shingles(t):
    w = re.findall(WS, "".join(c.lower() if c.isascii() else c for c in t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dups(spark, tables):
    docs = [(i, shingles(t)) for i, t in tables["docs"]]
    sets = sorted({s for _, s in docs if s}, key=len)
    up = {s: s for s in sets}

    def root(s):
        while up[s] != s:
            s = up[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[k + 1 :]:
            if 100 * len(a & b) >= 75 * len(a | b):
                up[root(a)] = root(b)
    least = {}
    for i, s in docs:
        if s:
            least[root(s)] = min(least.get(root(s), (True, 2**62)), low(i))
    name = lambda x: x[1] if x[0] else None
    want = Counter((i, len(s), name(least[root(s)]) if s else i, (name(least[root(s)]) if s else i) == i) for i, s in docs)
    assert rows(got(spark, tables, "op4"), "doc_id", "n_shingles", "component_id", "kept") == want


def check_packing(found, docs):
    whole = Counter()
    for i, t in docs:
        ids = ids_of(t, 0)
        for p in range(0, len(ids), 2048):
            whole[i, p // 2048, p, len(ids[p : p + 2048]), crc(ids[p : p + 2048])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == whole
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    return len(sequences), sum(k[3] * n for k, n in whole.items())


def test_packing(spark, tables):
    n, total = check_packing(got(spark, tables, "op5").collect(), tables["docs"])
    assert n <= total / 2048 + 2


def test_sharding(spark, tables):
    found = got(spark, tables, "op6").collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, size(t), None if t is None else zlib.crc32(t.encode())) for i, t in tables["docs"])
    slots = {}
    for r in found:
        assert r.law == "bytes" and 0 <= r.shard < 24 and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_near_equal_and_splits_what_is_hot(spark):
    from sluice.llm import shards

    rows_ = [(i, "hot " * 20) for i in range(1500)] + [(i, f"text {i} " * (i % 50)) for i in range(1500, 4000)]
    out = shards.assign(spark.createDataFrame(rows_, "doc_id long, text string").repartition(8)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r.b for r in out]
    assert len(sizes) == 24 and max(sizes) <= 1.03 * min(sizes)


def test_decontamination(spark, tables):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for i, t in tables["items"]:
        w = cut(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if w and i is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = Counter()
    for i, t in tables["docs"]:
        w, hit, met = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    met |= found
        want[i, len(w), len(hit), len(met), sha(",".join(sorted(map(str, met)))), bool(hit)] += 1
    assert rows(got(spark, tables, "op7"), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert any(k[2] for k in want)


def test_secret_scan(spark, tables):
    from sluice.llm.secret_scan import BASE, RULES

    rules = [(k, re.compile(p), g, n) for k, p, g, n in RULES]
    want = Counter()
    for i, t in tables["docs"]:
        spans = sorted((m.start(), o, m.end(), k) for o, (k, p, g, n) in enumerate(rules) for m in p.finditer(t or "") if len(m[g]) >= n)
        listed = lambda some: ",".join(f"{k}:{s}:{e}" for s, _, e, k in some)
        of = lambda o: sum(x[1] == o for x in spans)  # noqa: B023, E731
        want[i, of(0), of(1), of(2), sha(listed(x for x in spans if x[1] < BASE)), listed(spans)] += 1
    assert rows(got(spark, tables, "op8"), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want
    assert sum(k[1] for k in want) >= 2


def test_trigram_queries():
    from sluice.llm.trigram_query import trigram_query

    assert trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert trigram_query("[0-9a-f]{16,}") == []
    assert trigram_query("(token|api_?key)[a-z]+") == [frozenset({"tok", "oke", "ken"}), frozenset({"api", "pik", "ike", "key"}), frozenset({"api", "pi_", "i_k", "_ke", "key"})]


def test_quality_rules(spark, tables):
    want = Counter()
    for i, t in tables["docs"]:
        w = WS.findall(t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice = Counter(grams)
        rep = len({j for k, g in enumerate(grams) if twice[g] > 1 for j in range(k, k + 3)})
        lines = [x for x in (t or "").split("\n") if WS.search(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)] += 1
    assert rows(got(spark, tables, "op9"), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got(spark, tables, "op9").filter("kept AND base_failed").count() == 0


def test_policies_and_ablations(spark, tables):
    from sluice.llm import quality_rules as qr

    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    led = qr.ledger(docs).persist()
    assert qr.apply_policy(led, "2025-full").count() <= qr.apply_policy(led, "2024-base").count()
    out = {r.rule: r for r in qr.ablations(led).collect()}
    bits = [r.b for r in led.select(F.col("quality.fail_bits").alias("b")).collect()]
    for name, bit in qr.BIT.items():
        assert (out[name].n_failed, out[name].n_only_this) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits))


def test_window_dedup(spark, tables):
    n, docs = 20, [(i, WS.findall(t or "")) for i, t in tables["docs"]]
    first = {}
    for i, w in docs:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, ((True, 2**62), 0)), (low(i), k))
    want = Counter()
    for i, w in docs:
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < (low(i), k) for j in range(k, k + n)}
        want[i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))] += 1
    assert rows(got(spark, tables, "op10"), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert any(k[2] for k in want)


CLASHES = ["_text", "_th", "_row", "v", "node", "n", "a", "quality", "_starts", "_kept", "length", "set", "seq"]


def test_extra_columns_with_clashing_names(spark, tables):
    from sluice.llm import decontaminate, line_dedup, near_dups, packing, quality_rules, secret_scan, shards, suffix_dedup, token_store, window_dedup

    docs = spark.createDataFrame(tables["docs"][:40], "doc_id long, text string").withColumns({c: F.lit(None).cast("string") if k % 2 else F.lit(c) for k, c in enumerate(CLASHES)})
    bench = spark.createDataFrame(tables["items"], "item_id long, text string").withColumn("n", F.lit(1))
    for out in (line_dedup.dedup_lines(docs), window_dedup.dedup_windows(docs), suffix_dedup.dedup_substrings(docs), near_dups.dedup(docs), decontaminate.drop_contaminated(docs, bench)):
        assert out.columns == docs.columns
        assert out.select("_th", "v", "length").distinct().collect() == docs.select("_th", "v", "length").distinct().collect()
        assert out.count() <= 40
    assert set(quality_rules.ledger(docs).columns) == set(docs.columns)
    for out in (packing.pack(docs), token_store.frames(docs), shards.assign(docs), secret_scan.scan(docs), decontaminate.contamination(docs, bench)):
        assert out.count() > 0
