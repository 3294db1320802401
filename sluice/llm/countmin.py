"""Count-min sketches with counters that stop at two: a lossless filter for hashes that may be repeated.

A hash is estimated as repeated if its cell holds two or more in every row, which an estimate from above never
misses.

`repeated_in` grows with the input. The range of hashes is cut into shards, each with a sketch of its own of 8
cells or more for each hash that it counts, so the share of single hashes that pass is the same at every size. A
partition sends its counts by shard: a hash met once goes with its row's key, one met twice or more in a run goes
once for the run, with the weight two, and its rows are settled on the spot; so a shard gets a hash once a run
at most, however common it is. A shard merges the partitions' counts and answers to the keys.

`members` is a bitmap of keys, small enough to broadcast (MAX_CELLS bits at most, 8 MB): it spares the rows without
an answer the way through a join. Beyond some 8 million keys more rows take that way for nothing; none is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sluice.llm import textcore as tc

ROWS = 3
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 26
SLICE = 1 << 16
#: Hashes that a shard of `repeated_in` expects, those that a task has in hand at once, and those in a row that it sends.
SHARD, RUN, PACK = 1 << 20, 1 << 20, 1 << 10
ASK, TWICE, SETTLED = 0, 1, 2


def _cells(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    bits = cells.bit_length() - 1
    return (((hashes ^ (hashes >> tc.U(31))) * tc.U(tc.MULTIPLIERS[row])) >> tc.U(64 - bits)).astype(np.int64)


def _pack(places: np.ndarray) -> bytes:
    """Cells set in a slice: a list of 16-bit places, or a bitmap once that is shorter."""
    if len(places) < SLICE // 16:
        return places.astype(np.uint16).tobytes()
    bits = np.zeros(SLICE, bool)
    bits[places] = True
    return np.packbits(bits).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) == SLICE // 8:
        return np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool)
    bits = np.zeros(SLICE, bool)
    bits[np.frombuffer(data, np.uint16)] = True
    return bits


def members(keys: DataFrame, expected: int) -> np.ndarray:
    """A bitmap (a power of two of bits, packed) of the cells of some 64-bit hashes, the frame's only column; `among` looks hashes up."""
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (8 * expected).bit_length()))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.unique(_cells(np.asarray(batch.column(0)).view(tc.U), 0, cells))
            slices = np.unique(at // SLICE)
            if len(slices):
                cut = np.split(at % SLICE, np.searchsorted(at, slices[1:] * SLICE))
                yield pa.RecordBatch.from_arrays([pa.array(slices), pa.array([_pack(x) for x in cut], pa.binary())], names=["s", "bits"])

    def merge(batches):
        import pyarrow as pa

        now, bits = None, None
        for batch in batches:
            for s, x in zip(*(c.to_pylist() for c in batch.columns)):
                if s != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["s", "bits"])
                    now, bits = s, np.zeros(SLICE, bool)
                bits |= _unpack(x)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["s", "bits"])

    parts = keys.mapInArrow(pack, "s long, bits binary")
    out = np.zeros(cells // 8, np.uint8)
    for r in parts.repartition("s").sortWithinPartitions("s").mapInArrow(merge, "s long, bits binary").collect():  # MAX_CELLS bits at most
        out[r["s"] * (SLICE // 8) : (r["s"] + 1) * (SLICE // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their cell set."""
    cell = _cells(hashes.view(tc.U), 0, len(bits) * 8)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def words(column, dtype=tc.U) -> np.ndarray:
    """The values in the strings of an Arrow binary column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    if ends[0] == ends[-1]:
        return np.empty(0, dtype)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype)


def strings(values: np.ndarray, edges: np.ndarray):
    """An Arrow binary column of the stretches of values between neighbouring edges."""
    import pyarrow as pa

    values, edges = np.ascontiguousarray(values[edges[0] : edges[-1]]), edges - edges[0]
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def repeated_in(texts: DataFrame, hashes, expected: int, limit: int = 4 << 20) -> DataFrame:
    """(_d, _th, hits): for rows (_d, _th, text) their hashes that are estimated to be repeated, as 64-bit values in some strings a row; hashes(column) gives those of a column of texts and each one's text."""
    shards, run, pack = -(-max(expected, 1) // SHARD), RUN, PACK
    names = ["s", "kind", "ds", "ths", "counts", "hits"]

    def count(batches):
        held, rows, size = [], 0, 0
        for batch in tc.sliced(batches, 2, limit):
            h, owner = hashes(batch.column(2))
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), h, owner + rows))
            rows, size = rows + batch.num_rows, size + len(h)
            if size >= run:
                yield from counted(held)
                held, rows, size = [], 0, 0
        if size:
            yield from counted(held)

    def counted(held):
        doc, th, h, owner = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        shard = ((h >> tc.U(32)) * tc.U(shards) >> tc.U(32)).astype(np.int64)
        lead = np.ones(len(h), bool)
        lead[1:] = ~same
        twice = order[lead & again[order]]  # in order of the hashes and so of the shards
        yield from sent(h[twice], shard[twice], np.zeros(len(twice), np.int64), doc, th, TWICE)
        k = np.flatnonzero(again)
        yield from sent(h[k], owner[k] // pack % shards, owner[k], doc, th, SETTLED)
        k = np.flatnonzero(~again)
        k = k[np.argsort(shard[k], kind="stable")]
        yield from sent(h[k], shard[k], owner[k], doc, th, ASK)

    def sent(h, shard, owner, doc, th, kind):
        """Rows of `pack` hashes of a shard at most, with the keys of their texts and how many hashes each has."""
        import pyarrow as pa

        if not len(h):
            return
        new = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        edges = np.concatenate([np.arange(a, b, pack) for a, b in zip([0, *new.tolist()], [*new.tolist(), len(h)])] + [[len(h)]])
        text = np.ones(len(h), bool)
        text[1:] = owner[1:] != owner[:-1]
        text[edges[:-1]] = True
        heads = np.flatnonzero(text)
        counts, doc, th = np.diff(np.append(heads, len(h))).astype(np.int32), doc[owner[heads]], th[owner[heads]]
        rows = np.searchsorted(heads, edges)
        for i in range(0, len(edges) - 1, 1_000):
            cut, at = edges[i : i + 1_001], rows[i : i + 1_001]
            k = len(cut) - 1
            yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), pa.array(np.full(k, kind, np.int32)), strings(doc, at), strings(th, at), strings(counts, at), strings(h, cut)], names=names)

    def unpacked(packs):
        """Keys, edges of their hashes, and the hashes of packed rows."""
        doc, th = (words(packs.column(i), np.int64) for i in (2, 3))
        return doc, th, np.concatenate(([0], np.cumsum(words(packs.column(4), np.int32), dtype=np.int64))), words(packs.column(5))

    def found(doc, th, edges, h):
        import pyarrow as pa

        for i in range(0, len(doc), 20_000):
            k = slice(i, i + 20_000)
            yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(th[k]), strings(h, edges[i : i + 20_001])], names=["_d", "_th", "hits"])

    def merge(batches):
        import pyarrow as pa

        now, held = None, []
        for batch in batches:
            kind = np.asarray(batch.column(1))
            settled = np.flatnonzero(kind == SETTLED)
            if len(settled):
                yield from found(*unpacked(batch.take(pa.array(settled))))
            batch = batch.take(pa.array(np.flatnonzero(kind != SETTLED)))
            if not batch.num_rows:
                continue
            s = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for a, b in zip(cuts, cuts[1:]):
                if held and s[a] != now:
                    yield from answers(held)
                    held = []
                now = s[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from answers(held)

    def answers(held):
        import pyarrow as pa

        all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        kind = np.asarray(all_.column(1))
        doc, th, edges, one = unpacked(all_.take(pa.array(np.flatnonzero(kind == ASK))))
        two = words(all_.take(pa.array(np.flatnonzero(kind == TWICE))).column(5))
        cells = 1 << (8 * max(len(one) + len(two), 32) - 1).bit_length()
        keep = np.ones(len(one), bool)
        for row in range(ROWS):
            cell, full = _cells(one, row, cells), np.zeros(cells, bool)
            at = np.sort(cell)
            full[at[1:][at[1:] == at[:-1]]] = True
            full[_cells(two, row, cells)] = True
            keep &= full[cell]
        # a row for each hit: a text's hits lie in as many shards as there are, so joined rows would grow in number with the shards
        hits = np.diff(np.concatenate(([0], np.cumsum(keep)))[edges])
        yield from found(np.repeat(doc, hits), np.repeat(th, hits), np.arange(keep.sum() + 1), one[keep])

    parts = texts.mapInArrow(count, "s long, kind int, ds binary, ths binary, counts binary, hits binary")
    return parts.repartition("s").sortWithinPartitions("s").mapInArrow(merge, "_d long, _th long, hits binary")


tc.by_value(__name__)
