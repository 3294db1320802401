"""Operator 3: removal of repeated byte strings through a distributed suffix array.

A window is LENGTH bytes of one document. Its anchor is the place of the smallest 8-byte hash (the last of
equals) among its first SPREAD places: equal windows have equal anchors, relative to their starts. Anchors
cut a text into chunks; the suffixes that are sorted start at anchors, and their symbols are the chunks.

1. Filter. All windows of an anchor share its core, the CORE bytes from it on; count-min sketches of the cores, in
   shards whose number grows with the input (countmin.repeated_in), drop the anchors that can't have a repeated
   window, and lose none. What is left are runs of text. Equal runs are sorted once, with their number. A bitmap of
   the documents with such anchors spares the others the shuffle.
2. The difference-cover algorithm (suffix_array.py) ranks the suffixes of all runs, to their ends.
3. Neighbours in rank order are compared: where they share the whole chunks that hold all windows that start in
   their first chunk, those windows are repeated. The first of such neighbours stands for the others from there on.
4. Exact ends. Windows that reach beyond shared whole chunks are compared by their bytes: anchors with equal
   contexts (all bytes of their windows) repeat each other; where several contexts share their core, one of each lists
   its windows, which are compared by 128-bit hashes.

Both copies of a repeat lose its bytes. Defined cases: a null or empty text has no bytes; texts under LENGTH
bytes lose none; repeated rows repeat each other and get equal results; a null doc_id is kept; extra
columns pass through or are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import countmin
from sluice.llm import suffix_array
from sluice.llm import textcore as tc
from sluice.llm.common import keyed, load, release, stored

LENGTH, SPREAD, GRAM = 400, 128, 8
#: Bytes from an anchor on that all its windows share.
CORE = LENGTH - SPREAD + 1
#: Kinds of neighbours in rank order that share a stretch of whole chunks.
BEFORE, AFTER = 1, 2
NULL_ID = -(2**63)
#: Bytes of text in hand at once: few enough that the arrays stay in a processor's cache.
_SLICE = 1 << 19
#: Windows that a shard of the last comparison expects at most, and those that a task has in hand at once.
SHARD, RUN = 1 << 18, 1 << 20


class Scan:
    """Anchors of some texts, joined: place of each window's anchor, and the anchors that cut chunks."""

    def __init__(self, texts: list[bytes]):
        self.counts = np.asarray([len(t) for t in texts], dtype=np.int64)
        self.data = b"".join(texts)
        s = np.frombuffer(self.data, np.uint8)
        table = (np.arange(1, 257, dtype=tc.U) * tc.U(tc.MULTIPLIERS[2])) ^ (np.arange(1, 257, dtype=tc.U) * tc.U(tc.MULTIPLIERS[1]) >> tc.U(32))
        self.rolling = tc.Rolling(table[s])
        if len(s) < SPREAD + GRAM - 1:
            self.at = np.empty(0, np.int64)
            return
        grams = np.ndarray((len(s) - GRAM + 1,), "<u8", self.data, strides=(1,)) * tc.U(tc.MULTIPLIERS[0])
        self.at = tc.last_minimum(grams ^ (grams >> tc.U(32)), SPREAD)

    def windows(self) -> np.ndarray:
        return tc.starts_within(self.counts, LENGTH)

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors of windows: place, first window start, number of windows. An anchor never serves two texts."""
        starts = self.windows()
        at = self.at[starts] if len(starts) else starts
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        head = np.flatnonzero(new)
        return at[head], starts[head], np.diff(np.append(head, len(at)))


def _texts(docs: DataFrame) -> DataFrame:
    """(_d, _th, _text): the row key and the text; a null doc_id stands as NULL_ID."""
    return keyed(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_d"), "_th", "_text")


def _picked(rows: DataFrame, bits) -> DataFrame:
    """The rows (with _d and _th) whose key is among the members that a broadcast bitmap holds, and a few others."""
    names = rows.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = np.flatnonzero(countmin.among(bits.value, np.asarray(batch.column(len(names)))))
            if len(keep):
                yield pa.RecordBatch.from_arrays([c.take(pa.array(keep)) for c in batch.columns[:-1]], names=names)

    return rows.select(*names, _key().alias("_key")).mapInArrow(tc.giving_back(run), rows.schema)


def _key():
    return F.xxhash64("_d", "_th")


def _members(keys: DataFrame):
    """A broadcast bitmap of the keys of a stored table."""
    n = keys.count()
    return keys.sparkSession.sparkContext.broadcast(countmin.members(keys.select(_key()), n))


def _runs(texts: DataFrame) -> DataFrame:
    """(_d, _th, offset, ka, kb, data): stretches of text all of whose windows may be repeated. A stored table."""
    n_bytes = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0

    def cores(column):
        scan = Scan(tc.binary(column))
        at, first, _ = scan.chosen()
        return scan.rolling(at, at + CORE), np.searchsorted(np.cumsum(scan.counts), first, "right")

    hits = stored(countmin.repeated_in(texts, cores, 2 * n_bytes // (SPREAD + 1), _SLICE), "hits")
    # texts without a hit are left out before the join, which so needs no more than the others' bytes
    found = hits.groupBy("_d", "_th").agg(F.collect_list("hits").alias("_hits"))
    asked = _picked(texts, _members(hits)).join(found, ["_d", "_th"]).select("_d", "_th", "_text", "_hits")

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in tc.sliced(batches, 2, _SLICE):
            scan = Scan(tc.binary(batch.column(2)))
            at, first, width = scan.chosen()
            keep = np.isin(scan.rolling(at, at + CORE), countmin.words(batch.column(3).flatten())) if len(at) else np.zeros(0, bool)
            if not keep.any():
                continue
            at, first, width = at[keep], first[keep], width[keep]
            ends = np.cumsum(scan.counts)
            owner = np.searchsorted(ends, first, "right")
            new = np.ones(len(at), bool)
            new[1:] = (first[1:] != first[:-1] + width[:-1]) | (owner[1:] != owner[:-1])
            head = np.flatnonzero(new)
            last = np.append(head[1:], len(at)) - 1
            begin, end = first[head], (first + width)[last] - 1 + LENGTH
            data = [scan.data[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            key = [xxhash.xxh3_128_intdigest(d) for d in data]
            half = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
            doc = owner[head]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(begin - (ends - scan.counts)[doc]), half([k >> 64 for k in key]), half([k & (1 << 64) - 1 for k in key]), pa.array(data, pa.binary())],
                names=["_d", "_th", "offset", "ka", "kb", "data"],
            )

    out = stored(asked.mapInArrow(tc.giving_back(run), "_d long, _th long, offset long, ka long, kb long, data binary"), "runs")
    release(hits)
    return out


def _cuts(scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """Places where the chunks of the runs begin, each run's end of its last behind them, and how many places each run has."""
    n, ends = len(scan.at), np.cumsum(scan.counts)
    # an anchor belongs to the SPREAD places before it; those that begin in one run and reach into the next are none of its own
    own = np.repeat(ends, scan.counts)[:n] - np.arange(n) >= SPREAD + GRAM - 1
    at = scan.at[own]
    run = np.searchsorted(ends, at, "right")
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    return at[new], np.bincount(run[new], minlength=len(ends))


def _symbols(runs: DataFrame) -> DataFrame:
    """(seq, s): the chunks of each run as hashes, from its first anchor on."""

    def run(batches):
        import pyarrow as pa

        for batch in tc.sliced(batches, 1, _SLICE):
            scan = Scan(tc.binary(batch.column(1)))
            cuts, n = _cuts(scan)
            last = np.cumsum(n) - 1  # a run's last anchor ends its last chunk
            chunk = np.ones(len(cuts), bool)
            chunk[last] = False
            begin = np.flatnonzero(chunk)
            hashes = scan.rolling(cuts[begin], cuts[begin + 1]).view(np.int64)
            edges = np.concatenate([[0], np.cumsum(n - 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(hashes))], names=["seq", "s"])

    return runs.select("seq", "data").mapInArrow(tc.giving_back(run), "seq long, s array<long>")


def _stretches(runs: DataFrame) -> DataFrame:
    """(seq, i, ka, kb): for each chunk of a run the hash of the whole chunks, from it on, that hold all windows that start in it. Chunks near a run's end have none."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        half = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
        for batch in tc.sliced(batches, 1, _SLICE):
            scan = Scan(tc.binary(batch.column(1)))
            cuts, n = _cuts(scan)
            begin, last = np.repeat(np.cumsum(n) - n, n), np.repeat(np.cumsum(n) - 1, n)
            k = np.flatnonzero(np.arange(len(cuts)) < last)  # a run's last cut only ends a chunk
            stop = np.searchsorted(cuts, cuts[k + 1] - 1 + LENGTH)
            inside = stop <= last[k]
            k, stop = k[inside], stop[inside]
            digest, data, sizes = xxhash.xxh3_128_intdigest, scan.data, cuts[k + 1] - cuts[k]
            # the first chunk's size belongs to it: equal hashes so stand for the same windows
            key = [digest(data[a:b], seed=w) for a, b, w in zip(cuts[k].tolist(), cuts[stop].tolist(), sizes.tolist())]
            owner = np.repeat(np.arange(len(n)), n)[k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(k - begin[k]), half([x >> 64 for x in key]), half([x & (1 << 64) - 1 for x in key])], names=["seq", "i", "ka", "kb"])

    return runs.select("seq", "data").mapInArrow(tc.giving_back(run), "seq long, i long, ka long, kb long")


def _neighbours(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, i, kind): of the suffixes (seq, i, ka, kb, rank) those that have the stretch of the one BEFORE in rank order, or of the one AFTER; and the stored table behind it."""
    names = ["seq", "i", "kind", "ka", "kb", "edge", "_part"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None

        def rows(seq, i, ka, kb, kind, edge):
            k = np.flatnonzero((kind > 0) | (edge > 0))
            at_edge = edge[k] > 0
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (seq[k], i[k], kind[k], np.where(at_edge, ka[k], 0), np.where(at_edge, kb[k], 0), edge[k], np.full(len(k), part))], names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in names[:2] + names[3:5]] + [np.zeros(n, np.int32), np.zeros(n, np.int32)]
            if held is None:
                cols[5][0] = 1
            else:  # the last row waits for the next
                cols = [np.concatenate(x) for x in zip(held, cols)]
            same = (cols[2][1:] == cols[2][:-1]) & (cols[3][1:] == cols[3][:-1])
            cols[4][1:] |= np.where(same, BEFORE, 0).astype(np.int32)
            cols[4][:-1] |= np.where(same, AFTER, 0).astype(np.int32)
            held = [x[-1:].copy() for x in cols]
            yield rows(*(x[:-1] for x in cols))
        if held is not None:
            held[5] |= 2
            yield rows(*held)

    ordered = ranked.repartitionByRange("rank", "seq", "i").sortWithinPartitions("rank")
    local = stored(ordered.mapInArrow(tc.giving_back(run), "seq long, i long, kind int, ka long, kb long, edge int, _part long"), "neighbours")
    # what a partition's first and last row have in common with the next partitions': two rows for each tell
    found, before = [], None
    for r in sorted(local.filter("edge > 0").collect(), key=lambda r: (r["_part"], r["edge"])):
        if r["edge"] & 1 and before is not None and (before["ka"], before["kb"]) == (r["ka"], r["kb"]):
            found += [(r["seq"], r["i"], BEFORE), (before["seq"], before["i"], AFTER)]
        before = r
    rows = local.select("seq", "i", "kind").union(ranked.sparkSession.createDataFrame(found, "seq long, i long, kind int")).filter("kind > 0")
    return rows, local


def _ends(runs: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(seq, first, width, core, ca, cb, times): where times is 0 windows that the neighbours show to be repeated; else, for each anchor with windows that stand for more than a neighbour's, the hashes of its core and its context, with 2 where all its windows are known to be repeated."""
    marks = neighbours.groupBy("seq").agg(*[F.collect_list(c).alias(c) for c in ("i", "kind")]).withColumnRenamed("seq", "_seq")

    def run(batches):
        import pyarrow as pa
        import xxhash

        half = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
        for batch in tc.sliced(batches, 1, _SLICE):
            scan = Scan(tc.binary(batch.column(1)))
            ends, starts = np.cumsum(scan.counts), scan.windows()
            cuts, n = _cuts(scan)
            (i, k), (kinds, _) = tc.flat(batch.column(3)), tc.flat(batch.column(4))
            kind = np.zeros(len(cuts) + 1, np.int8)  # of the places before each cut's; a chunk can have two rows
            np.bitwise_or.at(kind, np.repeat(np.cumsum(n) - n, k) + i + 1, kinds.astype(np.int8))
            kind = np.repeat(kind, np.diff(np.concatenate([[0], cuts, [len(scan.data)]])))[starts]
            known = (kind > 0) | np.repeat(np.asarray(batch.column(2)) > 1, scan.counts)[starts]
            # what is known already
            shown = starts[known]
            head = np.flatnonzero(np.concatenate([[True], shown[1:] != shown[:-1] + 1])) if len(shown) else shown
            settled, extent = shown[head], np.diff(np.append(head, len(shown)))
            # what is compared
            at, first, width = scan.chosen()
            edges = np.cumsum(width) - width
            keep = np.flatnonzero(~np.logical_and.reduceat(kind & BEFORE > 0, edges)) if len(at) else at
            times = np.where(np.logical_and.reduceat(known, edges)[keep], 2, 1) if len(at) else at
            at, first, width = at[keep], first[keep], width[keep]
            digest, data = xxhash.xxh3_128_intdigest, scan.data
            context = [digest(data[a : a + w - 1 + LENGTH], seed=p - a << 8 | w) for a, w, p in zip(first.tolist(), width.tolist(), at.tolist())]
            none = np.zeros(len(settled), np.int64)
            first, width, times = np.append(first, settled), np.append(width, extent), np.append(times, none)
            core, ca, cb = np.append(scan.rolling(at, at + CORE).view(np.int64), none), [x >> 64 for x in context] + none.tolist(), [x & (1 << 64) - 1 for x in context] + none.tolist()
            owner = np.searchsorted(ends, first, "right")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array((first - (ends - scan.counts)[owner]).astype(np.int32)), pa.array(width.astype(np.int32)), pa.array(core), half(ca), half(cb), pa.array(times.astype(np.int32))],
                names=["seq", "first", "width", "core", "ca", "cb", "times"],
            )

    rows = runs.select("seq", "data", "times").join(marks, F.col("seq") == F.col("_seq"), "left").select("seq", "data", "times", "i", "kind")
    return rows.mapInArrow(tc.giving_back(run), "seq long, first int, width int, core long, ca long, cb long, times int")


def _again(runs: DataFrame, anchors: DataFrame, expected: int) -> DataFrame:
    """(seq, first, width): of the windows of some anchors (seq, first, width, times) those that others equal; where times is over one they are known, and only stand against others. expected: windows, or more."""
    listed = anchors.groupBy("seq").agg(*[F.collect_list(c).alias(c) for c in ("first", "width", "times")]).withColumnRenamed("seq", "_seq")
    shards, run_of = expected // SHARD + 1, RUN
    names = ["s", "ha", "hb", "seqs", "ats"]

    def windows(batches):
        import xxhash

        digest, low = xxhash.xxh3_128_intdigest, (1 << 64) - 1
        held, size = [], 0
        for batch in tc.sliced(batches, 1, _SLICE):
            first, width, times = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in (2, 3, 4))
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(batch.column(2).offsets)))
            data, h = tc.binary(batch.column(1)), []
            for r, a, w in zip(row.tolist(), first.tolist(), width.tolist()):
                text = data[r]
                h += [digest(text[i : i + LENGTH]) for i in range(a, a + w)]
            at = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(width.sum())
            at = np.where(np.repeat(times, width) == 1, at, -1 - at).astype(np.int32)
            held.append((np.asarray([k >> 64 for k in h], np.uint64), np.asarray([k & low for k in h], np.uint64), np.asarray(batch.column(0))[np.repeat(row, width)], at))
            size += len(h)
            if size >= run_of:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    def sent(held):
        import pyarrow as pa

        ha, hb, seq, at = (np.concatenate(x) for x in zip(*held))
        shard = ((ha >> tc.U(32)) * tc.U(shards) >> tc.U(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
        cols = [x[order] for x in (ha, hb, seq, at)]
        for i in range(0, len(edges) - 1, 1_000):
            cut = edges[i : i + 1_001]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), *(countmin.strings(x, cut) for x in cols)], names=names)

    def merge(batches):
        now, held = None, []
        for batch in batches:
            s = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)] if len(s) else []
            for a, b in zip(cuts, cuts[1:]):
                if held and s[a] != now:
                    yield answer(held)
                    held = []
                now = s[a]
                held.append([countmin.words(batch.column(i).slice(a, b - a), kind) for i, kind in enumerate((tc.U, tc.U, np.int64, np.int32), 1)])
        if held:
            yield answer(held)

    def answer(held):
        import pyarrow as pa

        ha, hb, seq, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((hb, ha))
        same = (ha[order][1:] == ha[order][:-1]) & (hb[order][1:] == hb[order][:-1])
        again = np.zeros(len(ha), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        k = np.flatnonzero(again & (at >= 0))
        return pa.RecordBatch.from_arrays([pa.array(seq[k]), pa.array(at[k]), pa.array(np.ones(len(k), np.int32))], names=["seq", "first", "width"])

    rows = runs.select("seq", "data").join(listed, F.col("seq") == F.col("_seq")).select("seq", "data", "first", "width", "times").mapInArrow(tc.giving_back(windows), "s long, ha binary, hb binary, seqs binary, ats binary")
    return rows.repartition("s").sortWithinPartitions("s").mapInArrow(tc.giving_back(merge), "seq long, first int, width int")


def _spans(starts: DataFrame) -> DataFrame:
    """(_seq, spans): for each run of (seq, first, width) its bytes to remove, as begin and end of each stretch, one after the other."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            first, width = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in (1, 2))
            n = np.diff(np.asarray(batch.column(1).offsets))
            end = first + width - 1 + LENGTH
            apart = np.repeat(np.arange(len(n)), n) * (end.max(initial=0) + 2)  # no stretch reaches into the next run's
            order = np.argsort(first + apart, kind="stable")
            begin, end = (first + apart)[order], np.maximum.accumulate((end + apart)[order])
            new = np.ones(len(begin), bool)
            new[1:] = begin[1:] > end[:-1]  # bytes that touch are one stretch
            head = np.flatnonzero(new)
            pairs = np.stack([begin[head], end[np.append(head[1:], len(begin)) - 1]], axis=1) - apart[order][head, None]
            edges = 2 * np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], np.cumsum(n)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(pairs.ravel().astype(np.int32)))], names=["_seq", "spans"])

    return starts.groupBy("seq").agg(*[F.collect_list(c).alias(c) for c in ("first", "width")]).mapInArrow(tc.giving_back(run), "_seq long, spans array<int>")


def repeats(docs: DataFrame) -> DataFrame:
    """(_d, _th, _repeats): per document the repeated bytes, as structs of a place and the stretches (begin, end, one after the other) from there. A stored table."""
    all_runs = _runs(_texts(docs))
    numbered = all_runs.groupBy("ka", "kb").agg(F.first("data").alias("data"), F.count("*").alias("times")).withColumn("seq", F.monotonically_increasing_id())
    runs = stored(numbered, "distinct_runs")  # the numbers are fixed as they are written
    found = stored(all_runs.drop("data"), "places")
    release(all_runs)
    ranks = suffix_array.ranks(_symbols(runs))
    stretches = _stretches(runs).join(ranks.withColumnsRenamed({"seq": "_seq", "i": "_i"}), (F.col("seq") == F.col("_seq")) & (F.col("i") == F.col("_i"))).select("seq", "i", "ka", "kb", "rank")
    neighbours, local = _neighbours(stretches)
    release(ranks)
    ends = stored(_ends(runs, neighbours), "ends")
    release(local)
    # one row for each context: how often it occurs, and where it does once
    one = F.min_by(F.struct("seq", "first", "width"), F.struct("seq", "first")).alias("one")
    contexts = stored(ends.filter("times > 0").groupBy("ca", "cb").agg(F.sum("times").alias("times"), F.min("core").alias("core"), one), "context_counts")
    several = contexts.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("core").alias("_core"))
    listed = contexts.join(several, F.col("core") == F.col("_core"), "left_semi").select("one.seq", "one.first", "one.width", "times")
    single = _again(runs, listed, contexts.agg(F.sum("one.width")).first()[0] or 0)
    twice = contexts.filter("times > 1").select(F.col("ca").alias("_ca"), F.col("cb").alias("_cb"))
    equal = ends.filter("times = 1").join(twice, (F.col("ca") == F.col("_ca")) & (F.col("cb") == F.col("_cb")), "left_semi").select("seq", "first", "width")
    spans = stored(_spans(ends.filter("times = 0").select("seq", "first", "width").union(equal).union(single)), "spans")
    release(ends, contexts)
    keyed_runs = runs.select("ka", "kb", "seq").join(spans, F.col("seq") == F.col("_seq")).select(F.col("ka").alias("_ka"), F.col("kb").alias("_kb"), "spans")
    pieces = stored(found.join(keyed_runs, (F.col("ka") == F.col("_ka")) & (F.col("kb") == F.col("_kb"))).groupBy("_d", "_th").agg(F.collect_set(F.struct("offset", "spans")).alias("_repeats")), "repeats")
    release(found, runs, spans)
    return pieces


def cut(docs: DataFrame) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and _kept, the bytes left."""
    cols = docs.columns
    row = docs.select(F.struct(*[docs[c] for c in cols]).alias("_row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("_d"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("_th"))
    pieces = repeats(docs)
    bits, columns = _members(pieces), [F.col("_row").getField(c).alias(c) for c in cols]
    # only the texts that lose bytes go through the join
    marked = _picked(row, bits).join(pieces, ["_d", "_th"], "left").select(*columns, "_repeats")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    fields = f"{fields}, n_bytes long, n_removed long, n_spans long, _kept binary"
    names, text = [*cols, "n_bytes", "n_removed", "n_spans", "_kept"], cols.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in tc.sliced(batches, text):
            out = [[], [], [], []]
            for data, found in zip(tc.binary(batch.column(text)), batch.column(len(cols)).to_pylist()):
                removed, spans, kept = 0, 0, data
                if found:
                    pairs = sorted((r["offset"] + a, r["offset"] + b) for r in found for a, b in zip(r["spans"][::2], r["spans"][1::2]))
                    parts, at, begin, end = [], 0, *pairs[0]
                    for a, b in [*pairs[1:], (len(data) + 2, 0)]:
                        if a > end:  # bytes that touch are one span
                            parts.append(data[at:begin])
                            removed, spans, at = removed + end - begin, spans + 1, end
                            begin, end = a, b
                        else:
                            end = max(end, b)
                    kept = b"".join([*parts, data[at:]])
                for c, x in zip(out, (len(data), removed, spans, kept)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())], names=names)

    def untouched(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(~countmin.among(bits.value, np.asarray(batch.column(len(cols)))))))
            kept = pc.fill_null(batch.column(text).cast(pa.binary()), b"")
            none = pa.array(np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pc.binary_length(kept).cast(pa.int64()), none, none, kept], names=names)

    rest = row.select(*columns, _key().alias("_key")).mapInArrow(tc.giving_back(untouched), fields)
    return rest.union(marked.mapInArrow(tc.giving_back(run), fields))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """docs without repeated byte strings; characters of which bytes are gone are replaced by U+FFFD."""
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # so that no column clashes
    out = cut(docs.withColumnsRenamed(names))
    text = F.when(F.col("n_removed") > 0, F.decode(F.col("_kept"), "UTF-8")).otherwise(F.col("text")).alias("text")
    return out.select(*[text if c == "text" else F.col(names.get(c, c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = cut(load(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("_kept", 256).alias("kept_sha256"))


tc.by_value(__name__)
