"""Operator 5: best-fit packing by a grouping genetic algorithm, on islands with elite migration.

Documents become ids plus an end id; only longer ones are cut, into pieces of exactly one sequence and a
rest. Full pieces are sequences already. All others are dealt at random to islands of about ISLAND pieces,
so an island's state (ids and lengths, its best solution) is a row of bounded size. An island evolves a
small population: a solution is its bins, and a child takes whole well-filled bins of one parent, then the
bins of the other that still have all their pieces (the duplicates are removed), and best-fits what was
displaced. Pieces of one length are interchangeable, so a bin is a multiset of lengths; after each epoch
an island's best-filled bins migrate to the next island of the ring, which injects those it has pieces for.
Bins that the last epoch leaves ill-filled are pooled and packed once more, dealt anew.

Defined cases: a null or empty text is a piece of its end id alone; rows that repeat are packed each for
itself; a null doc_id is kept; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textcore as tc
from sluice.llm import tokens
from sluice.llm.common import checkpoint, keyed

CAPACITY, END = 2048, 0
ISLAND, POPULATION, GENERATIONS, EPOCHS = 8192, 4, 4, 3
#: Well-filled bins that migrate, and the share of the capacity under which a bin is packed once more.
ELITE, ILL = 256, 0.995
#: Bytes of text that are encoded at once: of the pieces of tokens.SLICE two workers and their executor's heap take too much memory together.
SLICE = 4 << 20


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str = tokens.TOKENIZER, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids, cut at the capacity."""

    def cut(batches):
        import zlib

        import pyarrow as pa

        for batch in tc.sliced(batches, 1, SLICE):
            all_ids, counts = tokens.pieces(tokenizer).encode(batch.column(1), end)
            all_ids = all_ids.astype("<i4", copy=False)
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = (np.cumsum(counts) - counts)[row] + start
            raw = memoryview(all_ids.view(np.uint8))
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())), np.int64, len(at))
            out = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if ids:
                edges = np.concatenate([[0], np.cumsum(length)])
                out.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(all_ids)))
            yield pa.RecordBatch.from_arrays(out, names=names)
            del all_ids, raw, out
        tc.give_back()

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    return keyed(docs).select("doc_id", "_text").mapInArrow(cut, schema)


class Packer:
    """Bin packing over a multiset of lengths; a bin is a sorted tuple of lengths."""

    def __init__(self, lengths, capacity: int, seed: int):
        import random

        self.capacity, self.random = capacity, random.Random(seed)
        self.counts = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacity + 1).tolist()

    def best_fit(self, bins: list[list[int]], lengths: list[int]) -> list[list[int]]:
        """Puts each length, in the order given, into the open bin with the least room for it."""
        room = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for i, b in enumerate(bins):
            r = self.capacity - sum(b)
            room[r].append(i)
            mask |= 1 << r
        for x in lengths:
            above = mask >> x
            if above:
                r = x + (above & -above).bit_length() - 1
                i = room[r].pop()
                if not room[r]:
                    mask ^= 1 << r
                bins[i].append(x)
                r -= x
            else:
                i, r = len(bins), self.capacity - x
                bins.append([x])
            room[r].append(i)
            mask |= 1 << r
        return bins

    def first(self, noise: float) -> list[tuple]:
        order = [x for x in range(self.capacity, 0, -1) for _ in range(self.counts[x])]
        if noise:
            keys = [x * (1 + noise * self.random.random()) for x in order]
            order = [x for _, x in sorted(zip(keys, order), reverse=True)]
        return self.done(self.best_fit([], order))

    def done(self, bins) -> list[tuple]:
        """A solution: bins, best-filled first."""
        return sorted((tuple(sorted(b, reverse=True)) for b in bins), key=lambda b: (-sum(b), b))

    def fitness(self, bins) -> tuple:
        return (-len(bins), sum((sum(b) / self.capacity) ** 2 for b in bins))

    def child(self, well_filled: list[tuple], other: list[tuple]) -> list[tuple]:
        """Injects bins, keeps those of `other` that have all their pieces left, best-fits the rest."""
        left, bins = self.counts[:], []
        for b in [*well_filled, *other[: len(other) * 49 // 50]]:  # the worst fiftieth is always dealt anew
            for k, x in enumerate(b):
                if left[x] == 0:
                    for y in b[:k]:
                        left[y] += 1
                    break
                left[x] -= 1
            else:
                bins.append(list(b))
        return self.done(self.best_fit(bins, [x for x in range(self.capacity, 0, -1) for _ in range(left[x])]))

    def evolve(self, population: list[list[tuple]], migrants: list[tuple], generations: int) -> list[list[tuple]]:
        if migrants:
            population = [*population[:-1], self.child(migrants, population[0])]
        for _ in range(generations):
            children = []
            for other in population:
                donor = self.random.choice(population)
                good = donor[: max(1, int(len(donor) * self.random.uniform(0.2, 0.6)))]
                good = [b for b in good if self.random.random() < 0.9]
                children.append(self.child(good, other))
            population = sorted([*population, *children], key=self.fitness, reverse=True)[: len(population)]
        return population


def _flat(bins) -> bytes:
    """Lengths, with a 0 after each bin."""
    return np.asarray([x for b in bins for x in (*b, 0)], dtype=np.int32).tobytes()


def _bins(data: bytes) -> list[tuple]:
    flat = np.frombuffer(data, np.int32)
    return [tuple(x[:-1].tolist()) for x in np.split(flat, np.flatnonzero(flat == 0) + 1) if len(x)]


def _evolved(state: DataFrame, n: int, capacity: int, epoch: int) -> DataFrame:
    """One epoch on every island: (island, rids, lengths, best, elite), with the elite of the island before it as migrants."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                packer = Packer(row["lengths"], capacity, 1_000_003 * epoch + row["island"])
                if row["best"] is None:
                    population = [packer.first(0.02 * i) for i in range(POPULATION)]
                else:
                    best = _bins(row["best"])
                    population = [best, *[packer.child([b for b in best if packer.random.random() < 0.8], best) for _ in range(POPULATION - 1)]]
                best = packer.evolve(population, _bins(row["migrants"]) if row["migrants"] else [], GENERATIONS)[0]
                yield pa.RecordBatch.from_pylist([{"island": row["island"], "rids": row["rids"], "lengths": row["lengths"], "best": _flat(best), "elite": _flat(best[:ELITE])}], schema=schema)

    import pyarrow as pa

    schema = pa.schema([("island", pa.int64()), ("rids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("best", pa.binary()), ("elite", pa.binary())])
    return state.mapInArrow(run, "island long, rids array<long>, lengths array<int>, best binary, elite binary")


def _solved(items: DataFrame, n_items: int, capacity: int, seed: int) -> DataFrame:
    """(rid, length, bin, offset, filled): items (rid, length) packed on islands; bin holds the island's number."""
    n = max(1, n_items // ISLAND)
    dealt = items.withColumn("island", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(n)))
    state = dealt.groupBy("island").agg(F.sort_array(F.collect_list(F.struct(F.col("length").cast("int").alias("l"), F.col("rid").alias("r")))).alias("x"))
    state = state.select("island", F.col("x.r").alias("rids"), F.col("x.l").alias("lengths"), F.lit(None).cast("binary").alias("best"), F.lit(None).cast("binary").alias("migrants"))
    for epoch in range(EPOCHS):
        out = checkpoint(_evolved(state.repartition(n, "island"), n, capacity, epoch))
        moved = out.select(F.pmod(F.col("island") + 1, F.lit(n)).alias("island"), F.col("elite").alias("migrants"))
        state = out.drop("elite").join(moved, "island")

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                held: dict = {}
                for r, x in zip(row["rids"], row["lengths"]):
                    held.setdefault(x, []).append(r)
                cols = [[], [], [], [], []]
                for number, b in enumerate(_bins(row["best"])):
                    at, filled = 0, sum(b)
                    for x in b:
                        for c, v in zip(cols, (held[x].pop(), x, (row["island"] << 20) + number, at, filled)):
                            c.append(v)
                        at += x
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["rid", "length", "bin", "offset", "filled"])

    return out.mapInArrow(deal, "rid long, length long, bin long, offset long, filled long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str = tokens.TOKENIZER, ids: bool = False) -> DataFrame:
    """One row for each piece: what pieces() gives, with sequence_id and offset. Sequences are gapless and hold `capacity` ids at most."""
    cut = checkpoint(pieces(docs, capacity, end, tokenizer, ids)).withColumn("rid", F.monotonically_increasing_id())  # of a written table: the same at each reading
    items = cut.filter(F.col("length") < capacity).select("rid", "length")
    first = checkpoint(_solved(items, items.count(), capacity, 1))
    ill = first.filter(F.col("filled") < ILL * capacity)
    again = _solved(ill.select("rid", "length"), ill.count(), capacity, 2).select("rid", (2 * F.col("bin") + 1).alias("sequence_id"), "offset")
    # the second packing of the pooled bins is taken if it needs fewer of them
    again = checkpoint(again)
    fewer = again.agg(F.count_distinct("sequence_id")).first()[0] < ill.agg(F.count_distinct("bin")).first()[0]
    kept = first.filter(F.col("filled") >= ILL * capacity) if fewer else first
    placed = kept.select("rid", (2 * F.col("bin")).alias("sequence_id"), "offset")
    placed = placed.union(again) if fewer else placed
    whole = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("rid")).withColumn("offset", F.lit(0).cast("long"))
    return cut.filter(F.col("length") < capacity).join(placed, "rid").unionByName(whole).drop("rid")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


tc.by_value(__name__)
