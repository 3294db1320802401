"""Vectorised text work for the operators that run Python on the executors.

Functions travel to the executors by value, so workers need not have this package installed; what should
outlive a task in a reused worker is kept under `sys`.
"""

from __future__ import annotations

import sys

import numpy as np

U = np.uint64
#: Odd multipliers of the polynomial hashes (fixed values).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)

def by_value(name: str) -> None:
    """Lets a module's functions be sent to the executors by value."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[name])


def split(column):
    """Words (runs of other than ASCII white space) of an Arrow string column without nulls: the distinct words, each word's number among them, the words in each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(column.cast(pa.string()))
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    number, edges = np.asarray(coded.indices).astype(np.int64), np.asarray(lists.offsets).astype(np.int64)
    edges = edges - edges[0]
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # white space at a text's ends leaves an empty word
        real = number != blank
        edges = np.concatenate([[0], np.cumsum(real)])[edges]
        number = number[real]
    return coded.dictionary, number, np.diff(edges)


def strings(column):
    """An Arrow string column whose nulls are empty texts."""
    return column.fill_null("") if column.null_count else column


def give_back() -> None:
    """Gives free memory back to the system: a reused worker otherwise keeps the most that any task of its took."""
    import contextlib
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run):
    """A function over a task's batches that gives free memory back once they are done."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def tidy() -> None:
    """Gives back what a reused worker holds for other operators: the tokenizer's pieces and Arrow's free memory."""
    import gc

    import pyarrow as pa

    if getattr(sys, "_sluice_pieces", None):
        sys._sluice_pieces.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def sliced(batches, column: int, limit: int = 8 << 20):
    """The batches cut so that the texts of a column take `limit` bytes or are one text: what bounds a task's arrays."""
    import pyarrow.compute as pc

    for batch in batches:
        ends, at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after the other, and the words in each text."""
    import pyarrow as pa
    import xxhash

    distinct, number, counts = split(strings(column))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_pylist()), U, len(distinct))
    return hashes[number], counts


def inverse(m: int) -> int:
    return pow(m, -1, 1 << 64)


def powers(m: int, n: int) -> np.ndarray:
    """1, m, m**2, ... modulo 2**64; a million of them stay in the worker."""
    held = sys.__dict__.setdefault("_sluice_powers", {})
    if n <= 1 << 20 and m in held:
        return held[m][:n]
    out = np.full(max(n, 1 << 20), m, U)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= 1 << 20:
        held[m] = out
    return out[:n]


class Rolling:
    """Polynomial hashes modulo 2**64 of any stretches of an array of 64-bit values."""

    def __init__(self, values: np.ndarray, m: int = MULTIPLIERS[0]):
        self.inverse = powers(inverse(m), len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * powers(m, len(values)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h ^= h >> U(29)
        return h * U(MULTIPLIERS[1])


def last_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its smallest (by the upper 40 bits), the last of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    low = U((1 << 24) - 1)
    if len(values) > 1 << 24:  # places take 24 bits: longer arrays go by parts
        half = 1 << 23
        return np.concatenate([i + last_minimum(values[i : i + half + width - 1], width) for i in range(0, n, half)])
    keys = (values & ~low) | (low - np.arange(len(values), dtype=U))
    done = 1
    while 2 * done <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    keys = np.minimum(keys[:n], keys[width - done : width - done + n])
    return (low - (keys & low)).astype(np.int64)


def starts_within(counts: np.ndarray, width: int) -> np.ndarray:
    """Places in the joined arrays where a window of `width` starts that doesn't leave its text."""
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    if n < width:
        return np.empty(0, np.int64)
    room = np.repeat(ends, counts) - np.arange(n)
    return np.flatnonzero(room >= width)


def binary(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of an Arrow column of lists, one after the other, and the values in each; null is empty."""
    import pyarrow.compute as pc

    n = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return np.asarray(column.flatten()).astype(np.int64, copy=False), n


by_value(__name__)
