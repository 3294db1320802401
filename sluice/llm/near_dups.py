"""Operator 4: MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set holds its distinct 5-word shingles; equal sets are one node. The K smallest hashes of a
set are its sketch, and the inverted lists of the retained values count how often each occurs.

1. Overlaps. A value retained once is shared with nobody. A partner at similarity 3/4 shares three
   quarters of a set, so a node whose sketch holds more unshared values than sampling allows (if the sketch
   is the whole set: than a quarter, or than a partner of over K shingles can have cut from its own sketch)
   has no partner and is dropped, most documents at once.
2. The whole sets of the nodes left are counted the same way, now exactly: a node keeps at most a quarter
   of unshared shingles. Its prefix is its rarest n // 4 + 1 shingles; two partners always share one of
   their prefixes (prefix filter), so the lists of prefix values hold all links.
3. Each list is compared with its most central member (fewest unshared shingles): a number of pairs linear
   in the lists, however large a group of near copies is. Members that this leaves in other components than
   their list's centre are compared with those of the rest that can be similar at all: two sets share at most
   what both share with the centre and what both share with anyone beside it, which bounds the partner's size
   (a range of size classes). Those pairs pass the estimate from their union sketch and are verified on whole
   sets. What is never compared is connected already or can't be similar.
4. Components join the links.

Steps 2 to 4 lose no link. Step 1 drops a linked node, and the estimate a link, only if sampling strays by
MARGIN standard deviations (5e-6 for a pair at exactly 3/4 that has over K shingles; zero for smaller
sets; vanishing above 0.8). Hash values have 64 bits.

Defined cases: texts without words (null, empty, blank) have no set, are linked with nothing and kept;
fewer than 5 words are one shingle; repeated rows are one node, and each gets its row; a null doc_id is
smaller than any other (it stands as -2**63, which is no doc_id here); an empty table gives no rows; extra columns pass through or are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sluice.llm import textcore as tc
from sluice.llm.common import checkpoint, keyed, load, on_key, stored
from sluice.llm.components import components

SHINGLE, K, MARGIN = 5, 64, 4.5
#: The least similarity, as a fraction.
NUM, DEN = 3, 4
#: A side below this is broadcast; its size is counted first.
BROADCAST_BYTES = 32 << 20
NULL_ID = -(2**63)
#: Bytes of text that a worker has in hand at once.
_SLICE = 4 << 20


def _sets(column, shingle: int):
    """The sorted distinct shingle hashes of each text."""
    import pyarrow.compute as pc

    hashes, counts = tc.word_hashes(pc.ascii_lower(tc.strings(column)))
    ends = np.cumsum(counts)
    rolling = tc.Rolling(hashes)
    at = np.arange(len(hashes))
    owner_end = np.repeat(ends, counts)
    all_ = rolling(at, np.minimum(at + shingle, owner_end))
    for begin, end in zip((ends - counts).tolist(), ends.tolist()):
        yield np.unique(all_[begin : max(begin + 1, end - shingle + 1)] if end > begin else all_[:0])


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _th, n, a, b, sketch): size, 128-bit hash and K smallest hashes of each row's set."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        tc.tidy()
        for batch in tc.sliced(batches, 2, _SLICE):
            n, a, b, low = [], [], [], []
            for s in _sets(batch.column(2), shingle):
                data = s.tobytes()
                h = xxhash.xxh3_128_intdigest(data)
                n.append(len(s))
                a.append(h >> 64)
                b.append(h & (1 << 64) - 1)
                low.append(data[: 8 * K])
            as_long = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), as_long(a), as_long(b), pa.array(low, pa.binary())], names=["doc_id", "_th", "n", "a", "b", "sketch"])

    return keyed(docs).select("doc_id", "_th", "_text").mapInArrow(run, "doc_id long, _th long, n long, a long, b long, sketch binary")


def _values(table: DataFrame, column: str) -> DataFrame:
    """(node, v): the hashes in a binary column, one row each."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), [len(x) for x in data])), pa.array(np.concatenate(data))], names=["node", "v"])

    return table.select("node", column).mapInArrow(run, "node long, v long")


def _allowed(n):
    """Unshared values that a sketch of a set of n may hold if the set has a partner.

    For n <= K a bound, not an estimate: the two sets' union has at most n * DEN / NUM values, and those missing
    from the partner's sketch are in the union beyond the partner's whole set, or beyond its K smallest values.
    """
    spread = K / DEN + MARGIN * math.sqrt(K * NUM / DEN**2)
    return F.when(n <= K, F.greatest(F.floor(n * (DEN - NUM) / DEN), F.floor(n * DEN / NUM) - K)).otherwise(F.lit(math.ceil(spread)))


def _shared(values: DataFrame) -> DataFrame:
    """(node, v, df): the values that occur in two nodes or more."""
    often = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1").withColumnRenamed("v", "_v")
    return values.join(often, F.col("v") == F.col("_v")).drop("_v")


def _limited(table: DataFrame, bytes_per_row: int) -> DataFrame:
    """Marks a written table for broadcast if its rows, as counted, fit."""
    return F.broadcast(table) if table.count() * bytes_per_row < BROADCAST_BYTES else table


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    of = lambda end: sets.select(F.col("node").alias(f"_{end}"), F.col("set").alias(f"set_{end}"))
    return pairs.join(of("a"), F.col("a") == F.col("_a")).join(of("b"), F.col("b") == F.col("_b")).select("a", "b", "set_a", "set_b")


def _overlaps(pairs: DataFrame, sets: DataFrame, estimate: bool) -> DataFrame:
    """(a, b, both, near): the size of the intersection of each pair's whole sets and whether they are similar; with estimate, only of pairs that the union sketch lets pass."""

    def exact(batches):
        import pyarrow as pa

        floor = NUM / DEN - MARGIN * math.sqrt(NUM * (DEN - NUM) / DEN**2 / K)
        for batch in batches:
            keep, shared, near = [], [], []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_py(), tc.U), np.frombuffer(y.as_py(), tc.U)
                if estimate and min(len(x), len(y)) > K:
                    low = np.union1d(x[:K], y[:K])[:K]
                    if (np.isin(low, x[:K]) & np.isin(low, y[:K])).sum() < floor * K:
                        continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(i)
                shared.append(both)
                near.append(both * DEN >= NUM * (len(x) + len(y) - both))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(shared, pa.int64()), pa.array(near, pa.bool_())], names=["a", "b", "both", "near"])

    return _with_sets(pairs, sets).mapInArrow(exact, "a long, b long, both long, near boolean")


def _class(n):
    """Size class: sizes of one class differ by 2 % at most."""
    return F.floor(F.log(n.cast("double")) / math.log(1.02)).cast("int")


def _rest(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of a centre's members in different components that may be similar; lists has v (the centre), node, n, met, both (shared with the centre), root, centre_root.

    With o = what a member shares beside the centre, an intersection is at most min(both) + min(o).
    """
    beside = lists.withColumn("o", F.col("met") - F.col("both"))
    widest = beside.groupBy("v").agg(F.max("o").alias("_wide")).withColumnRenamed("v", "_w")
    y = beside.filter("root != centre_root").join(widest, F.col("v") == F.col("_w"))
    most = F.col("both") + F.least("o", "_wide")
    # similar sets satisfy (NUM + DEN) * intersection >= NUM * (n_x + n_y), so a partner's size has an upper bound
    limit = F.floor(F.least(most * (NUM + DEN) / NUM - F.col("n"), F.col("n") * DEN / NUM))
    floor_ = F.ceil(F.col("n") * NUM / DEN)
    y = y.withColumn("_to", limit).withColumn("_from", floor_).filter("_to >= _from AND _from > 0")
    y = y.select(F.col("v").alias("_v"), F.col("node").alias("_y"), F.col("n").alias("_n"), F.col("both").alias("_both"), F.col("o").alias("_o"), F.col("root").alias("_root"), F.explode(F.sequence(_class(F.col("_from")), _class(F.col("_to")))).alias("_c"))
    x = beside.select("v", "node", "n", "both", "o", "root", _class(F.col("n")).alias("c"))
    top = F.least("both", "_both") + F.least("o", "_o")
    met = x.join(y, (F.col("v") == F.col("_v")) & (F.col("c") == F.col("_c")) & (F.col("root") != F.col("_root")) & (top * (NUM + DEN) >= NUM * (F.col("n") + F.col("_n"))))
    return met.select(F.greatest("node", "_y").alias("a"), F.least("node", "_y").alias("b")).distinct()


def duplicate_classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _th, n, component): one row for each of docs; component is the smallest doc_id reachable."""
    rows = stored(sketches(docs, shingle), "sketches")
    placed = F.coalesce("doc_id", F.lit(NULL_ID))
    first = F.min_by(F.struct("doc_id", "_th", "sketch"), placed)
    nodes = stored(rows.filter("n > 0").groupBy("a", "b").agg(F.first("n").alias("n"), first.alias("_f"), F.min(placed).alias("low")).select("a", "b", "n", "low", "_f.doc_id", "_f._th", "_f.sketch"), "nodes")
    nodes = checkpoint(nodes.select("a", "b", "n", "low", "doc_id", "_th", "sketch").withColumn("node", F.monotonically_increasing_id()))

    # 1: sketches. Values that are not shared are those missing from the shared ones
    met = _shared(_values(nodes, "sketch")).groupBy("node").agg(F.count("*").alias("_met"))
    hopeful = nodes.join(met.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).filter(F.least("n", F.lit(K)) - F.col("_met") <= _allowed(F.col("n")))
    hopeful = stored(hopeful.select("doc_id", "_th", "node"), "hopeful")

    # 2: whole sets of what is left
    def whole(batches):
        import pyarrow as pa

        tc.tidy()
        for batch in tc.sliced(batches, 1, _SLICE):
            found = list(_sets(batch.column(1), shingle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "n", "set"])

    texts = on_key(keyed(docs), _limited(hopeful, 24), "inner")
    one = texts.select("node", "_text").mapInArrow(whole, "node long, n long, set binary")
    sets = stored(one.groupBy("node").agg(F.first("n").alias("n"), F.first("set").alias("set")), "sets")
    shared = stored(_shared(_values(sets, "set")), "shared")
    tally = shared.groupBy("node").agg(F.count("*").alias("_met"), F.sum("df").alias("_df")).withColumnRenamed("node", "_n")
    alone = F.col("n") - F.col("_met")
    left = sets.select("node", "n").join(tally, F.col("node") == F.col("_n")).filter(alone * DEN <= (DEN - NUM) * F.col("n"))
    left = left.select(F.col("node").alias("_n"), (F.floor(F.col("n") * (DEN - NUM) / DEN) + 1 - alone).alias("_take"), F.struct((alone * 1000 / F.col("n")).cast("int").alias("c"), (-F.col("_df") / F.col("n")).cast("long").alias("d"), F.col("node").alias("node")).alias("rank"), "n", F.col("_met").alias("met"))
    ranked = shared.join(left, F.col("node") == F.col("_n"))
    order = W.partitionBy("node").orderBy("df", "v")  # a node's shingles, at most a document
    lists = stored(ranked.withColumn("_i", F.row_number().over(order)).filter("_i <= _take").select("v", "node", "rank", "n", "met"), "lists")

    # 3: every list against its centre, then what that left apart
    centre = lists.groupBy("v").agg(F.min("rank").alias("_r"), F.count("*").alias("_l")).filter("_l > 1").select(F.col("v").alias("_v"), F.col("_r.node").alias("_c"))
    against = stored(lists.join(centre, F.col("v") == F.col("_v")).select("v", "node", "n", "met", "_c"), "against")
    star = stored(_overlaps(against.filter("node != _c").select(F.col("node").alias("a"), F.col("_c").alias("b")).distinct(), sets, False), "star")
    links = star.filter("near").select("a", "b")
    found = checkpoint(components(links))
    root = lambda c: F.coalesce(F.col("root"), F.col(c))
    label = found.withColumnRenamed("node", "_k")
    rooted = against.join(label, F.col("node") == F.col("_k"), "left").select("v", "node", "n", "met", "_c", root("node").alias("_rn"))
    rooted = rooted.join(label, F.col("_c") == F.col("_k"), "left").select("v", "node", "n", "met", "_c", F.col("_rn"), root("_c").alias("centre_root"))
    # lists of one centre are one here: what a member shares with the centre, and so what it may share beside it, is the same in all
    joint = rooted.select(F.col("_c").alias("v"), "node", "n", "met", F.col("_rn").alias("root"), "centre_root").distinct()
    apart = joint.filter("root != centre_root").select(F.col("v").alias("_v")).distinct()  # the others are connected
    open_ = joint.join(apart, F.col("v") == F.col("_v"), "left_semi")
    shared_with = star.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "both")
    open_ = open_.join(shared_with, (F.col("node") == F.col("_a")) & (F.col("v") == F.col("_b")), "left").select("v", "node", "n", "met", F.coalesce("both", "met").alias("both"), "root", "centre_root")
    more = stored(_overlaps(_rest(stored(open_, "open")), sets, True).filter("near").select("a", "b"), "more")
    if not more.isEmpty():
        found = checkpoint(components(links.union(more)))

    # 4: rows take the smallest doc_id of their component's nodes
    named = nodes.select("a", "b", "low", "node").join(found.withColumnRenamed("node", "_k"), F.col("node") == F.col("_k"), "left").select("a", "b", "low", root("node").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component")).withColumnRenamed("root", "_root")
    named = named.join(lows, F.col("root") == F.col("_root")).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "component")
    out = rows.select("doc_id", "_th", "n", "a", "b").join(named, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("n") > 0), "left")
    # texts without words are not nodes
    component = F.when(F.col("n") > 0, F.when(F.col("component") != NULL_ID, F.col("component"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_th", "n", component.alias("component"))


def dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without the rows that are not their component's first. Of rows that share that doc_id all with its text and set stay."""
    classes = duplicate_classes(docs, shingle)
    gone = classes.filter(~F.col("doc_id").eqNullSafe(F.col("component"))).select("doc_id", "_th").distinct()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("_th"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    return on_key(rows, gone, "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = duplicate_classes(load(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + {SHINGLE}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id"""

tc.by_value(__name__)
