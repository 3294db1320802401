"""Places where an operator once did less than its whole job."""

import random

import pytest


def test_small_sets_in_larger_ones_are_linked(spark):
    from sluice.llm import near_dups

    r, rows, sizes = random.Random(4), [], [(48, 64), (60, 80), (62, 82), (63, 83), (63, 84), (64, 83), (64, 84), (64, 85), (66, 88), (100, 133)]
    for n, m in sizes * 60:
        w = [f"{len(rows)}x{r.getrandbits(40)}" for _ in range(m + 4)]
        rows += [(len(rows), " ".join(w[: n + 4])), (len(rows) + 1, " ".join(w))]
    out = near_dups.duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.n for x in out} == {n for pair in sizes for n in pair}
    assert {x.doc_id: x.component for x in out} == {i: i - i % 2 for i in range(len(rows))}


def test_long_runs_of_one_or_two_lines_are_deleted(spark):
    from sluice.llm import line_dedup

    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    long_, half, other, few = words("a", 50), words("b", 25), words("c", 25), words("d", 49)
    rows = [
        (1, f"{long_}\nx"), (2, long_), (3, f"y\n{long_}\n\nz"),  # one line, also as a whole document
        (4, f"{half}\n{other}"), (5, f"p\n{half}\n\n{other}\nq\nr"), (6, f"{half}\nu\n{other}"), (7, f"{other}\n{half}"),  # two lines in that order
        (8, few), (9, few), (10, f"m\n{few}\nn\no"),  # a word short of it
        (11, "i\nj\nk"), (12, "g\ni\nj\nk"), (13, None), (14, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = dict(rows) | {2: "", 3: "y\n\nz", 5: "p\n\nq\nr", 12: "g"}
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(docs).collect()} == want
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(docs, long_words=None).collect()} == dict(rows) | {12: "g"}


def test_stops_after_letters_that_become_letter_and_mark():
    import public_tokenizers
    import pyarrow as pa
    from sluice.llm import tokens
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    texts = ["bekledİ.", "x bekledİ, y", "হয়,", "হয়.", "कड़,", "कड़. a", "élève. straße, ΣΑΣ."]
    ids, n = tokens.pieces().encode(pa.array(texts))
    for x, end, k in zip(texts, n.cumsum().tolist(), n.tolist()):
        assert ids[end - k : end].tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_benchmark_items_without_a_name_are_found(spark):
    from sluice.llm import decontaminate

    bench = spark.createDataFrame([(None, "one two three four five six seven eight nine ten eleven"), (7, "alpha beta"), (None, "alpha beta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "say one two three four five six seven eight nine ten eleven"), (2, "alpha beta gamma"), (3, "gamma")], "doc_id long, text string")
    found = {r.doc_id: (len(r.hits), r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    assert found == {1: (11, []), 2: (2, [7]), 3: (0, [])}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]


def test_the_pipeline_gives_ids(spark, tables):
    import corpus_pipeline
    from test_operators import crc

    found = corpus_pipeline.pack(spark, spark.read.parquet(f"{tables['full']}/documents.parquet"), tables["full"]).collect()
    assert found and all(len(r.ids) == r.length and crc(r.ids) == r.ids_crc32 for r in found)


def test_texts_without_repeats_and_texts_of_several_megabytes(spark):
    from sluice.llm import suffix_dedup

    r = random.Random(8)
    prose = lambda n: " ".join(f"{r.getrandbits(24):x}" for _ in range(n))
    alone = [(i, prose(200)) for i in range(40)]
    out = suffix_dedup.cut(spark.createDataFrame(alone, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.n_bytes, x.n_removed) for x in out} == {(i, len(t), 0) for i, t in alone}
    shared, long_ = prose(100), prose(400_000)
    rows = [(1, long_ + shared), (2, shared + "."), (3, prose(100))]
    out = {x.doc_id: x for x in suffix_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(i, out[i].n_removed) for i in (1, 2, 3)] == [(1, len(shared)), (2, len(shared)), (3, 0)]
    assert bytes(out[1]["_kept"]) == long_.encode() and bytes(out[2]["_kept"]) == b"."


def test_a_text_of_many_secrets_takes_linear_time(spark):
    import time

    from pyspark.sql import functions as F
    from sluice.llm import secret_scan

    n = 80_000
    docs = spark.createDataFrame([(1, "é0123456789abcdef " * n), (2, "0123456789abcdef")], "doc_id long, text string")
    secret_scan.scan(docs.filter("doc_id = 2")).count()
    began = time.time()
    out = {r.doc_id: r for r in secret_scan.scan(docs).select("doc_id", F.size("spans").alias("n"), F.element_at("spans", -1)["s"].alias("s"), F.element_at("spans", -1)["e"].alias("e"), F.get("spans", 777)["s"].alias("k")).collect()}
    assert (out[1].n, out[1].s, out[1].e, out[1].k) == (n, 18 * (n - 1) + 1, 18 * (n - 1) + 17, 18 * 777 + 1) and (out[2].n, out[2].s) == (1, 0)
    assert time.time() - began < 30


def test_packing_takes_little_memory(tmp_path):
    # two workers and a heap of 60 % share an executor, so what one takes besides its texts is bounded
    import os
    import random
    import subprocess
    import sys

    import pyarrow as pa
    from sluice.llm import packing

    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(20_000)]
    texts = [" ".join(r.choices(words, k=500)) for _ in range(9_000)]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    with pa.OSFile(str(tmp_path / "texts"), "wb") as sink, pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    child = """
import re, sys
import pyarrow as pa
from sluice.llm import packing, tokens

class Docs:
    select = lambda self, *cols: self
    mapInArrow = lambda self, run, schema: run

packing.keyed = lambda docs: Docs()
run = packing.pieces(None, ids=True)
read = lambda: pa.ipc.open_stream(pa.OSFile(sys.argv[1]))
tokens.pieces().encode(pa.array(["a b"]))
held = [b for b in read()]
mb = lambda name: int(re.search(name + r":\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
before, n = mb("VmRSS"), 0
for b in run(iter(held)):
    n += b.num_rows
    del b
print(n, mb("VmHWM") - before, mb("VmRSS") - before)
"""
    n, most, kept = map(float, subprocess.run([sys.executable, "-c", child, str(tmp_path / "texts")], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(packing.__file__)) + "/..").stdout.split())
    assert n >= 9_000
    assert most < 200 and kept < 80, (most, kept)


def test_suffix_tasks_give_memory_back(spark, tmp_path, monkeypatch):
    # workers are reused: what a task of any step keeps stands beside the heap of all later ones
    import random
    import uuid

    from sluice.llm import suffix_array, suffix_dedup
    from sluice.llm import textcore as tc

    folder = str(tmp_path)

    def give_back():
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()

    monkeypatch.setattr(tc, "give_back", give_back)
    monkeypatch.setattr(suffix_array, "LOCAL", 0)
    steps, arrow = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, *more: steps.append(run.__qualname__) or arrow(self, run, *more))
    r = random.Random(5)
    passage = "".join(r.choices("abcdefgh ", k=900))
    rows = [(i, "".join(r.choices("abcdefgh ", k=300)) + passage[i : i + 600]) for i in range(12)]
    out = suffix_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 12 and all(x.n_removed >= 500 for x in out)
    own = [s for s in steps if "repeated_in" not in s and "members" not in s]
    assert len(own) >= 13 and all(s.startswith("giving_back") for s in own), own
    assert len(list(tmp_path.iterdir())) >= len(own)


@pytest.mark.parametrize("local", [2500, 10_000])
def test_suffixes_are_ranked_to_their_ends(spark, local):
    import bisect

    from sluice.llm import suffix_array

    seqs = [[1] * 2500, [1] * 2500 + [2], [3] + [1] * 2000]
    got = {(x.seq, x.i): x["rank"] for x in suffix_array.ranks(spark.createDataFrame(list(enumerate(seqs)), "seq long, s array<long>"), local=local).collect()}
    every = sorted(tuple(s[i:]) for s in seqs for i in range(len(s)))
    assert got == {(k, i): bisect.bisect_left(every, tuple(s[i:])) for k, s in enumerate(seqs) for i in range(len(s))}


@pytest.mark.parametrize("local", [0, 1 << 19])
def test_the_suffix_array_of_runs_is_whole_and_settles_long_repeats(spark, monkeypatch, local):
    import bisect

    from sluice.llm import suffix_array, suffix_dedup

    monkeypatch.setattr(suffix_array, "LOCAL", local)
    kept, ranks, stored, ends = [], suffix_array.ranks, suffix_dedup.stored, []

    def seen(sequences, *more, **named):
        outer = not kept
        if outer:  # deeper levels call it too
            kept.append({r["seq"]: r["s"] for r in sequences.collect()})
        out = ranks(sequences, *more, **named)
        if outer:
            kept.append({(r["seq"], r["i"]): r["rank"] for r in out.collect()})
        return out

    def wrote(df, name):
        out = stored(df, name)
        if name == "ends":
            ends.extend(out.collect())
        return out

    r = random.Random(11)
    prose = lambda n: " ".join(f"{r.getrandbits(24):x}" for _ in range(n))
    a, b, c = prose(80), prose(1500), prose(90)
    rows = [(1, f"{a}|{b}"), (2, f"{b}|{c}"), (3, a), (4, c), (5, prose(300))]  # b lies in two runs that differ
    monkeypatch.setattr(suffix_array, "ranks", seen)
    monkeypatch.setattr(suffix_dedup, "stored", wrote)
    out = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (len(a + b), 2), 2: (len(b + c), 2), 3: (len(a), 1), 4: (len(c), 1), 5: (0, 0)}
    symbols, found = kept
    every = sorted(tuple(s[i:]) for s in symbols.values() for i in range(len(s)))
    assert found == {(k, i): bisect.bisect_left(every, tuple(s[i:])) for k, s in symbols.items() for i in range(len(s))}
    assert max(map(len, symbols.values())) > 100
    # what neighbours share is known without a comparison of its bytes, and stands for itself once
    shown = sum(x["width"] for x in ends if not x["times"])
    assert shown > 2 * 0.9 * len(b)
    assert sum(x["width"] for x in ends if x["times"]) < 1.2 * len(a + b + c)
