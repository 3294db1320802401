"""The pipeline's stages against plain versions of them, and the operators on the other side of their switches."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import test_operators as ops
from test_operators import WS, check_packing, low, shingles


def rejected(t):
    """The five rules of the default policy."""
    w = WS.findall(t or "")
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    twice = Counter(grams)
    rep = len({j for k, g in enumerate(grams) if twice[g] > 1 for j in range(k, k + 3)})
    lines = [x for x in (t or "").split("\n") if WS.search(x)]
    chars = sum(map(len, w))
    return len(w) < 50 or 100 * rep > 50 * len(w) or len(re.findall(r"[#*$%&|<>]", t)) > len(w) or not 2 * len(w) <= chars <= 20 * len(w) or (len(lines) >= 6 and 100 * (len(lines) - len(set(lines))) > 60 * len(lines))


def without_lines(docs):
    wordy = {(i, t): [(k, x) for k, x in enumerate(t.split("\n")) if WS.search(x)] for i, t in docs}
    runs, first = {}, {}
    for (i, t), b in wordy.items():
        runs[i, t] = [(s, n) for n in (1, 2, 3) for s in range(len(b) - n + 1) if n == 3 or sum(len(WS.findall(x)) for _, x in b[s : s + n]) >= 50]
        for s, n in runs[i, t]:
            key = tuple(x for _, x in b[s : s + n])
            first[key] = min(first.get(key, ((True, 2**62), 0)), (low(i), s))
    out = []
    for i, t in docs:
        b = wordy[i, t]
        gone = {k for s, n in runs[i, t] if first[tuple(x for _, x in b[s : s + n])] < (low(i), s) for k, _ in b[s : s + n]}
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if WS.search(left):
            out.append((i, left))
    return out


def without_copies(docs):
    nodes = [(i, t, shingles(t)) for i, t in docs]
    up = list(range(len(nodes)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, (_, _, a) in enumerate(nodes):
        for m in range(k):
            b = nodes[m][2]
            if a and 100 * len(a & b) >= 75 * len(a | b):
                up[root(k)] = root(m)
    least = {}
    for k, (i, _, _) in enumerate(nodes):
        least[root(k)] = min(least.get(root(k), (True, 2**62)), low(i))
    return [(i, t) for k, (i, t, _) in enumerate(nodes) if least[root(k)] == low(i)]


def without_benchmark(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = set()
    for _, t in items:
        w = cut(t)
        n = min(len(w), 10)
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(x) for x in windows}
    return [(i, t) for i, t in docs if not any(tuple(w[k : k + n]) in windows for w in [cut(t)] for n in sizes for k in range(len(w) - n + 1))]


def test_every_stage_and_the_run(spark, tables):
    import corpus_pipeline as cp

    items = tables["items"]
    plain = [lambda d: [x for x in d if not rejected(x[1])], without_lines, without_copies, lambda d: without_benchmark(d, items)]
    docs, frame = tables["docs"], spark.read.parquet(f"{tables['full']}/documents.parquet")
    for (name, stage), version in zip(cp.STAGES[:-1], plain):
        docs, frame = version(docs), cp.stored(stage(spark, frame, tables["full"]), name)
        assert Counter((r.doc_id, r.text) for r in frame.collect()) == Counter(docs), name
    assert docs
    check_packing(cp.run(spark, tables["full"]).collect(), docs)


@pytest.mark.parametrize("op", ["near_dups", "decontamination", "packing", "window_dedup", "suffix_dedup"])
def test_other_side_of_the_switches(spark, tables, monkeypatch, op):
    from sluice.llm import countmin, decontaminate, near_dups, packing, suffix_array, window_dedup

    for module in (near_dups, decontaminate):
        monkeypatch.setattr(module, "BROADCAST_BYTES", 0)  # joins shuffle
    monkeypatch.setattr(packing, "ISLAND", 16)  # elites migrate
    monkeypatch.setattr(suffix_array, "LOCAL", 0)
    monkeypatch.setattr(window_dedup, "RUN", 1)  # every batch is a run
    monkeypatch.setattr(countmin, "MIN_CELLS", 1 << 16)
    monkeypatch.setattr(countmin, "MAX_CELLS", 1 << 16)
    monkeypatch.setattr(countmin, "SHARD", 1 << 6)  # many shards
    monkeypatch.setattr(countmin, "RUN", 1)
    monkeypatch.setattr(countmin, "PACK", 3)
    if op == "packing":
        n, total = check_packing(ops.got(spark, tables, "op5").collect(), tables["docs"])
        assert n <= total / 2048 + 4
    else:
        getattr(ops, f"test_{op}")(spark, tables)


def test_sketch_grows_with_the_input(spark, monkeypatch):
    from pyspark.sql import functions as F
    from sluice.llm import countmin, window_dedup
    from sluice.llm import textcore as tc

    monkeypatch.setattr(countmin, "SHARD", 1 << 9)

    def hashes(column):
        h, counts = tc.word_hashes(column)
        return h, np.repeat(np.arange(len(counts)), counts)

    shares = []
    for n in (200, 2000):
        # of the 50 words of a text, 49 occur once and one in half of all texts
        texts = spark.range(n).select(
            F.col("id").alias("_d"), F.xxhash64("id").alias("_th"),
            F.concat_ws(" ", F.when(F.col("id") % 2 == 0, F.lit("common")), F.transform(F.sequence(F.lit(1), F.lit(49)), lambda i: F.concat_ws("-", F.col("id"), i))).alias("text"),
        ).repartition(5)
        out = countmin.repeated_in(texts, hashes, 50 * n).collect()
        hits = {}
        for r in out:
            hits.setdefault((r["_d"], r["_th"]), []).extend(np.frombuffer(r["hits"], np.uint64).tolist())
        common = int(tc.word_hashes(pa.array(["common"]))[0][0])
        assert {d for (d, _), h in hits.items() if common in h} == set(range(0, n, 2))  # none lost
        shares.append((sum(map(len, hits.values())) - n / 2) / (49 * n))
    assert max(shares) < 0.01, shares


def test_suffix_filter_grows_with_the_input(spark, monkeypatch):
    import random

    from sluice.llm import countmin, suffix_dedup

    monkeypatch.setattr(countmin, "MIN_CELLS", 1 << 16)
    monkeypatch.setattr(countmin, "MAX_CELLS", 1 << 16)  # a single sketch of that size would be full
    monkeypatch.setattr(suffix_dedup, "SHARD", 1 << 6, raising=False)  # many shards of windows
    monkeypatch.setattr(suffix_dedup, "RUN", 1, raising=False)
    left, stored = [], suffix_dedup.stored

    def seen(df, name):
        out = stored(df, name)
        if name == "runs":
            left.extend(len(r["data"]) for r in out.select("data").collect())
        return out

    monkeypatch.setattr(suffix_dedup, "stored", seen)
    r = random.Random(3)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(300)) for _ in range(2000)]
    shared = " ".join(f"{r.getrandbits(40):x}" for _ in range(60))
    rows = [(i, f"{t}\n{shared}\t{i}" if i < 2 else t) for i, t in enumerate(texts)]
    out = suffix_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_removed for x in out} == {i: len(shared) + 2 if i < 2 else 0 for i in range(2000)}
    assert sum(left) < 0.05 * sum(len(t) for t in texts)
