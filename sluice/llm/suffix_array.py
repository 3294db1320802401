"""Distributed suffix ranks by the difference-cover algorithm (period 3), for many sequences at once.

Sequences are arrays of 64-bit symbols, rows of bounded length; a suffix ends with its sequence, and an end
is smaller than any symbol. One level:

1. Sample the suffixes at places 1 and 2 modulo 3; sort their triples of symbols and name each by the
   number of smaller ones.
2. Unless all names differ, recurse on the sequences of names (places 1, then places 2, each a sequence).
3. Merge the remaining suffixes, at places 0: against places 1 by (symbol, rank of the next suffix) and
   against places 2 by (two symbols, rank of the suffix after them). A merged rank is the number of smaller
   suffixes in each class, counted in two sorts.

Sorting is Spark's range partitioning, by place among equal keys, so that a common triple fills many
partitions; counts run within a partition and add up over partitions, of which the driver keeps one row each.
Levels go on until all names differ or cover the longest sequence, so only equal suffixes share a rank. Once
LOCAL symbols or fewer are left, one task ranks them by doubling.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textcore as tc
from sluice.llm.common import release, stored

#: Symbols that one task ranks (some 50 bytes each).
LOCAL = 1 << 19
#: Stands for the end of a sequence (smaller than any symbol or name).
ENDED = -(2**63)


def counted(table: DataFrame, keys: list[str], classes: int, name: str) -> tuple[DataFrame, int, DataFrame]:
    """table (seq, i, keys, `cls`: a class number) with columns less0.. : the rows of each class whose keys are smaller; the number of distinct keys; and the stored table behind it."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, last, tied, lead = np.zeros(classes, np.int64), None, np.zeros(classes, np.int64), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
            cls = np.asarray(batch.column(batch.schema.get_field_index("cls")))
            new = np.zeros(n, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last is None or last != tuple(c[0] for c in cols)
            last = tuple(c[-1] for c in cols)
            lead = tuple(c[0] for c in cols) if lead is None else lead
            leads = np.logical_and.reduce([c == x for c, x in zip(cols, lead)])
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out, total = [], []
            for k in range(classes):
                run_ = np.concatenate([[0], np.cumsum(cls == k)])
                # rows before the first head are tied with the batch before
                out.append(np.where(head >= 0, before[k] + run_[np.maximum(head, 0)], before[k] - tied[k]))
                since = run_[n] - run_[head[-1]] if head[-1] >= 0 else tied[k] + run_[n]
                total.append((run_[n], since))
            for k in range(classes):
                before[k] += total[k][0]
                tied[k] = total[k][1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out), pa.array(leads), pa.array(new), pa.array(np.full(n, part))], names=[*batch.schema.names, *less, "_lead", "_new", "_part"])

    less = [f"less{k}" for k in range(classes)]
    ordered = table.repartitionByRange(*keys, "seq", "i").sortWithinPartitions(*keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields)
    local = stored(ordered.mapInArrow(tc.giving_back(run), f"{fields}, {', '.join(f'{x} long' for x in less)}, _lead boolean, _new boolean, _part long"), name)
    tally = local.groupBy("_part").agg(F.min(F.struct(*keys)), F.max(F.struct(*keys)), F.sum(F.col("_new").cast("long")), *[F.max(x) for x in less], *[F.sum((F.col("cls") == k).cast("long")) for k in range(classes)])
    parts, base, at_lead, last, kinds = [], [0] * classes, [0] * classes, None, 0
    for part, first, end, new, *rest in sorted(tuple(r) for r in tally.collect()):  # a row for each partition
        if first != last:
            at_lead = base
        kinds += new - (first == last)
        parts.append((part, *base, *at_lead))
        if end != first:  # the partition's last key begins here; the next partition may go on with it
            at_lead = [x + y for x, y in zip(base, rest[:classes])]
        base, last = [x + y for x, y in zip(base, rest[classes:])], end
    schema = "_p long, " + ", ".join(f"_base{k} long" for k in range(classes)) + ", " + ", ".join(f"_tied{k} long" for k in range(classes))
    bases = F.broadcast(table.sparkSession.createDataFrame(parts, schema))
    full = local.join(bases, F.col("_part") == F.col("_p"))
    return full.select(*table.columns, *[F.when(F.col("_lead"), F.col(f"_tied{k}")).otherwise(F.col(x) + F.col(f"_base{k}")).alias(x) for k, x in enumerate(less)]), kinds, local


def _after(values: np.ndarray, room: np.ndarray, k: int) -> np.ndarray:
    """For each place the value k places on, ENDED beyond its sequence."""
    out = np.full(len(values), ENDED)
    on = np.flatnonzero(room > k)
    out[on] = values[on + k]
    return out


def _listed(rows: DataFrame, value: str) -> DataFrame:
    """(seq, s, at): each sequence's values, in any order, and their places."""
    return rows.groupBy("seq").agg(F.collect_list(value).alias("s"), F.collect_list("i").alias("at"))


def _placed(values, places) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow column of lists in the order of their places (none: as they are), and the values in each."""
    x, n = tc.flat(values)
    at, k = tc.flat(places)
    if len(at):
        out = np.empty_like(x)
        out[np.repeat(np.cumsum(n) - n, k) + at] = x
        x = out
    return x, n


def ranks(sequences: DataFrame, depth: int | None = None, local: int | None = None) -> DataFrame:
    """sequences (seq long, s array<long>, and at array<long> if s is not in order: each value's place) -> (seq, i, rank): for each suffix the number of smaller ones. depth: levels, as many as the longest sequence needs by default; a name at the last covers 3**depth symbols. The result is a stored table."""
    local = LOCAL if local is None else local

    def sampled(batches):
        import pyarrow as pa

        for batch in batches:
            x, n = _placed(batch.column(1), batch.column(2))
            i = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            room = np.repeat(n, n) - i
            at = np.flatnonzero(i % 3)
            seq = np.repeat(np.asarray(batch.column(0)), n)
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (seq, i, x, _after(x, room, 1), _after(x, room, 2))], names=["seq", "i", "x", "y", "z"])

    if "at" not in sequences.columns:
        sequences = sequences.select("seq", "s", F.lit(None).cast("array<long>").alias("at"))
    sequences = stored(sequences, "sequences")
    total, longest = (x or 0 for x in sequences.agg(F.sum(F.size("s")), F.max(F.size("s"))).first())
    if depth is None:
        depth = next(k for k in range(1, 64) if 3**k >= longest)
    if total <= local:
        return _ranked(sequences, depth)
    triples = sequences.mapInArrow(tc.giving_back(sampled), "seq long, i long, x long, y long, z long").withColumn("cls", F.lit(0).cast("long"))
    # a name is the number of smaller triples, occurrences counted, so that names count smaller suffixes
    named, n_distinct, table = counted(triples, ["x", "y", "z"], 1, "names")
    sample, n_rows = named.select("seq", "i", F.col("less0").alias("name")), table.count()
    held = table
    if n_distinct < n_rows and depth > 1:
        deeper = sample.select((F.col("seq") * 2 + (F.col("i") % 3) - 1).alias("seq"), F.floor(F.col("i") / 3).alias("i"), "name")
        below = ranks(_listed(deeper, "name"), depth - 1, local)
        release(table)
        held = below
        sample = below.select(F.floor(F.col("seq") / 2).alias("seq"), (F.col("i") * 3 + F.pmod("seq", F.lit(2)) + 1).alias("i"), F.col("rank").alias("name"))

    def merged(batches):
        """Each suffix with its class, symbols and the ranks of the two suffixes after it."""
        import pyarrow as pa

        for batch in batches:
            x, n = _placed(batch.column(1), batch.column(2))
            start = np.cumsum(n) - n
            i = np.arange(len(x)) - np.repeat(start, n)
            room, rank = np.repeat(n, n) - i, np.full(len(x), ENDED)
            (names, _), (at, k) = tc.flat(batch.column(3)), tc.flat(batch.column(4))
            rank[np.repeat(start, k) + at] = names
            seq = np.repeat(np.asarray(batch.column(0)), n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (seq, i, i % 3, x, _after(x, room, 1), rank, _after(rank, room, 1), _after(rank, room, 2))], names=["seq", "i", "cls", "x", "y", "own", "r1", "r2"])

    listed = _listed(sample, "name").toDF("_seq", "_names", "_at")
    both = sequences.join(listed, F.col("seq") == F.col("_seq"), "left").select("seq", "s", "at", "_names", "_at")
    suffixes = stored(both.mapInArrow(tc.giving_back(merged), "seq long, i long, cls long, x long, y long, own long, r1 long, r2 long"), "suffixes")
    first, _, merge1 = counted(suffixes.filter("cls < 2").select("seq", "i", "cls", "x", "r1", "own"), ["x", "r1"], 2, "merge1")
    second, _, merge2 = counted(suffixes.filter("cls != 1").select("seq", "i", F.when(F.col("cls") == 0, 0).otherwise(1).cast("long").alias("cls"), "x", "y", "r2", "own"), ["x", "y", "r2"], 2, "merge2")
    known = [side.filter("cls = 1").select("seq", "i", (F.col("own") + F.col("less0")).alias("rank")) for side in (first, second)]
    # those at places 0 count themselves and the others apart: each has a row from either sort
    zero = first.filter("cls = 0").select("seq", "i", (F.col("less0") + F.col("less1")).alias("n")).union(second.filter("cls = 0").select("seq", "i", F.col("less1").alias("n")))
    out = stored(known[0].union(known[1]).union(zero.groupBy("seq", "i").agg(F.sum("n").alias("rank"))), "ranks")
    release(sequences, held, suffixes, merge1, merge2)
    return out


def _ranked(sequences: DataFrame, depth: int) -> DataFrame:
    """ranks() of LOCAL symbols at most, in one task."""

    def run(batches):
        import pyarrow as pa

        seqs, values, sizes = [], [], []
        for batch in batches:
            x, n = _placed(batch.column(1), batch.column(2))
            seqs.append(np.asarray(batch.column(0)))
            values.append(x)
            sizes.append(n)
        if not sum(map(len, values)):
            return
        seqs, sizes = np.concatenate(seqs), np.concatenate(sizes)
        room = (np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())).astype(np.int32)  # symbols up to a sequence's end

        def dense(keys):
            """Numbers of keys in order, from 1 on."""
            order = np.argsort(keys)
            keys = keys[order]
            new = np.ones(len(keys), np.int32)
            new[1:] = keys[1:] != keys[:-1]
            out = np.empty(len(keys), np.int32)
            out[order] = np.cumsum(new, dtype=np.int32)
            return out

        keys = np.concatenate(values)
        del values, x, batch
        rank, span = dense(keys), 1
        while span < 3**depth and span < len(rank) and rank.max() < len(rank):
            keys = rank.astype(np.int64) << 32
            keys[:-span] |= rank[span:] * (room[:-span] > span)
            rank = dense(keys)
            span *= 2
        del keys
        smaller, first = np.cumsum(np.bincount(rank)), np.repeat(np.cumsum(sizes) - sizes, sizes)
        seq = np.repeat(seqs, sizes)
        for k in range(0, len(rank), 100_000):
            at = np.arange(k, min(k + 100_000, len(rank)))
            yield pa.RecordBatch.from_arrays([pa.array(seq[at]), pa.array(at - first[at]), pa.array(smaller[rank[at] - 1])], names=["seq", "i", "rank"])

    out = stored(sequences.repartition(1).mapInArrow(tc.giving_back(run), "seq long, i long, rank long"), "ranks")
    release(sequences)
    return out


tc.by_value(__name__)
