"""Operator 10: substring deduplication with a count-min prefilter.

A window is WIDTH consecutive words of one document. Its core is the CORE words from the smallest word
hash (the last of equals) among the window's first WIDTH - CORE + 1 words: equal windows have equal cores,
so a window occurs at most as often as its core does. Pass one counts cores in count-min sketches with
counters that stop at two: the partitions' counts are merged by shards of the range of hashes, whose number
grows with the input (countmin.repeated_in), and the cores estimated to be repeated come back by document. The
merged sketch never underestimates, so pass two, which groups only windows of such cores, loses none.
It groups exactly, by 128 bits of hash: of each RUN windows a partition sends on the first place of each
and settles the others itself, so a window has a row for each run at most, however common.

Defined cases: a null or empty text has no words and stays as it is, empty; a null doc_id is smaller than any
other (it stands as -2**63, which is no doc_id here); rows with one doc_id and text count as one place and get equal results; extra columns of any name
pass through; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import countmin
from sluice.llm import textcore as tc
from sluice.llm.common import load

WIDTH, CORE = 20, 11
#: Windows that a task has in hand at once (some 100 bytes each); a batch's own come on top.
RUN = 1 << 20
NULL_ID = -(2**63)


def _anchors(hashes, counts, width, core):
    """Window starts within the texts, and for each the place of its core."""
    starts = tc.starts_within(counts, width)
    at = tc.last_minimum(hashes, width - core + 1)
    return starts, at[starts]


def repeated_windows(rows: DataFrame, column: int, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """(_d, _th, _starts): for rows (_row, _d, _th), whose text is a field of _row, the places (in words) where windows start that occurred earlier."""
    text = rows.schema["_row"].dataType.names[column]
    texts = rows.select("_d", "_th", F.coalesce(F.col("_row").getField(text).cast("string"), F.lit("")).alias("_text"))
    n_bytes = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    expected = n_bytes // 6 * 2 // (width - core + 2)

    def cores(column):
        hashes, counts = tc.word_hashes(column)
        at = np.unique(_anchors(hashes, counts, width, core)[1])
        return tc.Rolling(hashes)(at, at + core), np.searchsorted(np.cumsum(counts), at, "right")

    hits = countmin.repeated_in(texts, cores, expected).groupBy("_d", "_th").agg(F.collect_list("hits").alias("_hits"))
    # all columns go along, so that this join and the one in cut() read the same shuffled rows
    asked = rows.join(hits, ["_d", "_th"], "left").select("_row", "_d", "_th", "_hits")

    limit = RUN

    def with_hits(batches):
        import pyarrow as pa

        for batch in batches:
            batch = batch.take(pa.array(np.flatnonzero(np.asarray(batch.column(3).is_valid()))))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0).field(column), batch.column(3)], names=["_d", "_th", "_text", "_hits"])

    def emit(batches):
        keep = [[] for _ in range(5)]
        for batch in tc.sliced(with_hits(batches), 2, 4 << 20):
            doc, th = (np.asarray(batch.column(i)) for i in (0, 1))
            hashes, counts = tc.word_hashes(batch.column(2))
            starts, at = _anchors(hashes, counts, width, core)
            if not len(starts):
                continue
            places, where = np.unique(at, return_inverse=True)
            maybe = np.isin(tc.Rolling(hashes)(places, places + core), countmin.words(batch.column(3).flatten()))
            starts = starts[maybe[where]]
            owner = np.repeat(np.arange(len(counts)), counts)[starts]
            first = np.cumsum(counts) - counts
            for out, x in zip(keep, (tc.Rolling(hashes)(starts, starts + width), tc.Rolling(hashes, tc.MULTIPLIERS[2])(starts, starts + width), doc[owner], th[owner], starts - first[owner])):
                out.append(x)
            if sum(map(len, keep[0])) >= limit:
                yield from sent(keep)
                keep = [[] for _ in range(5)]
        if keep[0]:
            yield from sent(keep)

    def sent(keep):
        import pyarrow as pa

        a, b, doc, th, at = (np.concatenate(x) for x in keep)
        order = np.lexsort((th, at, doc, b, a))
        a, b, doc, th, at = a[order], b[order], doc[order], th[order], at[order]
        same = np.zeros(len(a), bool)
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
        later = (doc != doc[lead]) | (at != at[lead])
        # repeated rows hold the same window at the same place; one of them is enough
        twin = np.zeros(len(a), bool)
        twin[1:] = same[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & (th[1:] == th[:-1])
        send = np.flatnonzero(~later & ~twin)
        send = send[np.argsort(order[send])]  # as the documents stand: their ids repeat and are compressed
        for i in range(0, len(send), 50_000):
            k = send[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(a[k].view(np.int64)), pa.array(b[k].view(np.int64)), pa.array(doc[k]), pa.array(th[k]), pa.array(at[k].astype(np.int32)), pa.nulls(len(k), pa.binary())], names=names)
        gone = np.flatnonzero(later & ~twin)
        doc, th, at = doc[gone], th[gone], at[gone]
        order = np.lexsort((at, th, doc))
        doc, th, at = doc[order], th[order], at[order].astype(np.int32)
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (th[1:] != th[:-1])) + 1
        if len(at):
            heads = np.concatenate(([0], cuts))
            lists = [x.tobytes() for x in np.split(at, cuts)]
            for i in range(0, len(heads), 2_000):
                k = heads[i : i + 2_000]
                yield pa.RecordBatch.from_arrays([pa.array(th[k]), pa.array(doc[k]), pa.array(doc[k]), pa.array(th[k]), pa.nulls(len(k), pa.int32()), pa.array(lists[i : i + 2_000], pa.binary())], names=names)

    def settle(batches):
        import pyarrow as pa

        last = None  # hashes and first place of the window at hand
        for batch in batches:
            settled = np.flatnonzero(np.asarray(batch.column(5).is_valid()))
            if len(settled):
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(settled)) for i in (2, 3, 5)], names=["_d", "_th", "starts"])
            rest = np.flatnonzero(np.asarray(batch.column(5).is_null()))
            if not len(rest):
                continue
            a, b, doc, th, at = (np.asarray(batch.column(i).take(pa.array(rest))) for i in range(5))
            same = np.zeros(len(a), bool)
            same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
            lead_doc, lead_at = doc[lead], at[lead]
            if last is not None and last[:2] == (a[0], b[0]):
                carried = np.cumsum(~same) == 1
                lead_doc[carried], lead_at[carried] = last[2:]
            later = np.flatnonzero((doc != lead_doc) | (at != lead_at))
            last = (a[-1], b[-1], lead_doc[-1], lead_at[-1])
            yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(th[later]), pa.array([x.tobytes() for x in at[later]], pa.binary())], names=["_d", "_th", "starts"])

    names = ["a", "b", "d", "_th", "at", "starts"]
    windows = asked.mapInArrow(emit, "a long, b long, d long, _th long, at int, starts binary")
    found = windows.repartition("a", "b").sortWithinPartitions("a", "b", "d", "at").mapInArrow(settle, "_d long, _th long, starts binary")
    return found.groupBy("_d", "_th").agg(F.collect_list("starts").alias("_starts"))


def cut(docs: DataFrame, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """docs with n_words, n_removed (words) and _kept: the kept words joined by single blanks."""
    cols = docs.columns
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("_d")
    rows = docs.select(F.struct(*[docs[c] for c in cols]).alias("_row"), key, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("_th"))
    marked = rows.join(repeated_windows(rows, cols.index("text"), width, core), ["_d", "_th"], "left").select(*[F.col("_row").getField(c).alias(c) for c in cols], "_starts")

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for data, starts in zip(tc.binary(batch.column(cols.index("text"))), batch.column(len(cols)).to_pylist()):
                words = data.split()
                n_words.append(len(words))
                if starts:
                    delta = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.frombuffer(b"".join(starts), np.int32))
                    delta[at] += 1
                    np.add.at(delta, at + width, -1)
                    kept = np.flatnonzero(np.cumsum(delta[:-1]) == 0)
                    words = [words[i] for i in kept.tolist()]
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=[*cols, "n_words", "n_removed", "_kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return marked.mapInArrow(keep, f"{fields}, n_words long, n_removed long, _kept string")


def dedup_windows(docs: DataFrame, width: int = WIDTH, core: int = CORE) -> DataFrame:
    """docs whose texts lost every word of a window that occurred earlier; a text that loses words keeps the others joined by single blanks."""
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # so that no column clashes
    out = cut(docs.withColumnsRenamed(names), width, core)
    text = F.when(F.col("n_removed") > 0, F.col("_kept")).otherwise(F.col("text")).alias("text")
    return out.select(*[text if c == "text" else F.col(names.get(c, c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = cut(load(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i + 1:i + {WIDTH}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - {WIDTH - 1})) AS i FROM d WHERE len(w) >= {WIDTH})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM x) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, i + unnest(range(0, {WIDTH})) AS i FROM r),
e AS (SELECT doc_id, i, w[i + 1] AS word FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d)),
k AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS n FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

tc.by_value(__name__)
