"""Round trips and parts of the operators."""

import numpy as np
import pytest

from sluice.llm import packing, range_coder, token_store, tokens


@pytest.mark.parametrize("n", [1, 2, 33, 2048, 2049, 7000])
@pytest.mark.parametrize("kind", ["any", "wide", "skewed", "same", "again"])
def test_coder_round_trip(n, kind):
    r = np.random.default_rng(n)
    ids = {"any": r.integers(0, 65536, n), "wide": r.integers(0, 2**32, n), "skewed": r.zipf(1.3, n) % 49408, "same": np.full(n, 7), "again": np.resize(r.integers(65000, 2**31, 300), n)}[kind]
    table, numbers = range_coder.Table.of(ids)
    blocks, held = range_coder.encode(numbers, table), range_coder.Table.load(table.dump())
    assert np.array_equal(np.concatenate(range_coder.decode(blocks, held)), ids)
    assert np.array_equal(range_coder.decode(blocks[-1:], held)[0], ids[-blocks[-1][0] :])  # a block alone


def test_a_table_of_many_ids_round_trips():
    ids = np.random.default_rng(2).permutation(np.repeat(np.arange(90_000), 2))
    table, numbers = range_coder.Table.of(ids)
    assert table.bits == 18
    assert np.array_equal(np.concatenate(range_coder.decode(range_coder.encode(numbers, table, 9000), table, 9000)), ids)


@pytest.mark.parametrize("block", [2048, 32_000])
def test_counts_stay_within_their_fields(block):
    # the same row all along, however long the block is
    ids = np.where(np.arange(40_000) % 64 == 0, np.random.default_rng(1).integers(0, 2000, 40_000), 5)
    table, numbers = range_coder.Table.of(ids)
    assert np.array_equal(np.concatenate(range_coder.decode(range_coder.encode(numbers, table, block), table, block)), ids)


def test_the_coder_beats_order_0():
    r, chain = np.random.default_rng(3), [0]
    follows = r.integers(0, 500, (500, 3))
    for pick in r.integers(0, 3, 60_000).tolist():
        chain.append(int(follows[chain[-1], pick]))
    ids = np.asarray(chain)
    p = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert 8 * len(token_store.pack_frame([1], np.asarray([len(ids)]), ids)) / len(ids) < -(p * np.log2(p)).sum()


def test_several_frames_in_several_parts(spark, tmp_path):
    from test_operators import crc, ids_of

    texts = [(i, f"w{i} alpha beta, gamma. " * (i % 37) + ("delta " * 3000 if i == 41 else "")) for i in range(120)]
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_store.write(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), path, frame=500)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    table = spark.read.parquet(path)
    assert table.select("part").distinct().count() > 1 and table.agg({"seq": "max"}).first()[0] > 1
    at = 0
    for r, (i, x) in zip(sorted(token_store.read(spark, path).collect(), key=lambda r: r.doc_id), texts):
        want = ids_of(x, 1)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (i, at, len(want), crc(want), want)
        at += len(want)


def test_frames_detect_damage():
    ids = np.arange(5000) % 300
    data = token_store.pack_frame([5, None], np.array([2000, 3000]), ids)
    names, n, found = token_store.unpack_frame(data)
    assert names == [5, None] and n.tolist() == [2000, 3000] and np.array_equal(found, ids)
    for at in (24, 20 + 2 * 13 + 3 * 16 + 5, len(data) - 3):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            token_store.unpack_frame(bytes(bad))


def test_cached_pieces_equal_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    texts = ["foo's it's. a,b. 3.5, x. É. İstanbul, ΣΑΣ. <|endoftext|>. <|ENDOFTEXT|> á e ́. J̌.", "\x1c a\x85b\xa0c. d", "!!. ,. .,", "’s. n't, 'S. A.B.C., 1,000.", "", "  ", "a\x0bb\x0cc\rd", "Ⅷ. ª. ٣, x². ﬁn ǅ ŉ"]
    ids, n = tokens.pieces().encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_merged_words_equal_the_tokenizers():
    import random

    import pyarrow as pa

    r, p = random.Random(3), tokens.pieces()
    assert p.merges is not None
    vocabulary = [w.replace("</w>", "") for w in p.tokenizer.get_vocab()]
    letters = "abcdefghijklmnopqrstuvwxyzéèüßñóàçабвгдежз日本語한글İʼﬁǅ.,'-!0159<|> \n\tA\u0301"
    texts = ["".join(r.choices(letters, k=r.randint(0, 60))) for _ in range(3000)] + [" ".join(r.choices(vocabulary, k=12)) + r.choice(".,;") for _ in range(1500)] + ["ab" * 200, "é" * 90 + ".", "a" * 64 + ",", "a" * 63 + ","]
    ids, n = p.encode(pa.array(texts), 5)
    whole, want = p._whole(pa.array(texts), 5)
    assert n.tolist() == want.tolist() and np.array_equal(ids, whole)


def test_children_hold_every_piece():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 2048, 500)
    p = packing.Packer(lengths, 2048, 3)
    one, two = p.first(0), p.first(0.1)
    for bins in (one, two, p.child(two[:100], one), p.evolve([one, two], one[:20], 2)[0]):
        assert sorted(x for b in bins for x in b) == sorted(lengths.tolist()) and max(map(sum, bins)) <= 2048


@pytest.mark.parametrize("local", [0, 40, 10_000])
def test_suffix_ranks(spark, local):
    import bisect
    import random

    from sluice.llm import suffix_array

    r = random.Random(5)
    seqs = [[r.choice([1, 2, -3]) for _ in range(r.randint(1, 20))] for _ in range(8)] + [[5] * 12, [5] * 9, [1, 2, -3] * 5]
    got = {(x.seq, x.i): x["rank"] for x in suffix_array.ranks(spark.createDataFrame(list(enumerate(seqs)), "seq long, s array<long>"), local=local).collect()}
    every = sorted(tuple(s[i:]) for s in seqs for i in range(len(s)))
    assert got == {(k, i): bisect.bisect_left(every, tuple(s[i:])) for k, s in enumerate(seqs) for i in range(len(s))}


def test_ranks_where_one_triple_fills_half_the_rows(spark):
    from collections import Counter

    from sluice.llm import suffix_array

    r = np.random.default_rng(0)
    rows = [(i, 0, *((7, 7, 7) if i % 2 else r.integers(0, 9, 3).tolist()), int(i % 2)) for i in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    full, kinds, table = suffix_array.counted(spark.createDataFrame(rows, "seq long, i long, x long, y long, z long, cls long").repartition(4), ["x", "y", "z"], 2, "t")
    most = max(x[1] for x in table.groupBy("_part").count().collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tally, less, so_far = Counter((k[2:5], k[5]) for k in rows), {}, [0, 0]
    for key in sorted({k[2:5] for k in rows}):
        less[key] = tuple(so_far)
        so_far = [n + tally[key, c] for c, n in enumerate(so_far)]
    assert kinds == len(less) and {(x.x, x.y, x.z): (x.less0, x.less1) for x in full.collect()} == less
    assert most < 1600  # equal triples are dealt to several tasks


def test_components(spark):
    from sluice.llm.components import components

    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (11, 12), (20, 21)] + [(100, k) for k in range(101, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 6)}, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20, **{k: 100 for k in range(100, 140)}}


def test_pipeline_against_brute_force(spark, tables):
    import corpus_pipeline as cp
    from test_operators import WS, check_packing, shingles

    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    names = docs.columns
    for name, stage in cp.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, tables["full"])
        assert docs.columns == names and docs.count() <= before, name
        if name == "quality_rules":
            assert all(len(WS.findall(r.text or "")) >= 50 for r in docs.collect())
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) and WS.search(r.text) for r in docs.collect())
        if name == "near_dedup":
            left = [shingles(t) for t in {r.text for r in docs.collect()}]
            assert all(100 * len(a & b) < 75 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    check_packing(cp.STAGES[-1][1](spark, docs, tables["full"]).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert cp.run(spark, tables["full"]).count() > 0 and cp.run(spark, tables["empty"]).count() == 0
