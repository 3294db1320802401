"""Operator 1: token-ID output in checksummed, entropy-coded frames.

Documents in ascending doc_id order become ids with an end id, and whole documents are gathered into
frames of about FRAME ids. A frame is self-contained bytes (layout below); its blocks of range_coder.BLOCK
ids are coded independently, each with checksums of its words and of its ids, so any block can be read
with the frame's head alone. The head holds the frame's order-0 table. Frames are rows of a Parquet table (part, seq, first, n_tokens, frame): the container that Spark can
write to and read from any store, with its commit protocol for lost executors. Order is (part, seq); what
lies before a part is a sum over parts, one number for each.

Frame, little-endian: b"SLF2", u32 documents, u32 blocks, u32 bytes of the table, u32 crc of the rest of the
head; for each document i64 doc_id, u8 known, u32 ids; for each block u32 ids, u32 words' bytes, u32 crc of the
words, u32 crc of the ids; the table (u8 bits; zlib: steps between the distinct ids, their frequencies, u32
each); then the words. A very long document is a frame of its own.

Defined cases: a null or empty text is its end id alone; a null doc_id comes first (flag 0); rows of one
doc_id stand in the order of their text's hash; an empty table makes no frame; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import range_coder, tokens
from sluice.llm import textcore as tc
from sluice.llm.common import keyed, load, shared_folder

END, FRAME = 1, 1 << 23
MAGIC = b"SLF2"
_DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u4")])
_BLOCK = np.dtype([("n", "<u4"), ("bytes", "<u4"), ("crc", "<u4"), ("ids_crc", "<u4")])


def pack_frame(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    import zlib

    docs = np.zeros(len(counts), _DOC)
    docs["id"], docs["known"], docs["n"] = [d or 0 for d in doc_ids], [d is not None for d in doc_ids], counts
    table, numbers = range_coder.Table.of(ids)
    coded, order0 = range_coder.encode(numbers, table), table.dump()
    blocks, at = np.zeros(len(coded), _BLOCK), 0
    for i, (n, words) in enumerate(coded):
        blocks[i] = (n, len(words), zlib.crc32(words), range_coder.checksum(ids[at : at + n]))
        at += n
    head = docs.tobytes() + blocks.tobytes() + order0
    sizes = np.array([len(docs), len(blocks), len(order0), zlib.crc32(head)], "<u4").tobytes()
    return b"".join([MAGIC, sizes, head, *(w for _, w in coded)])


def unpack_frame(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a frame; ValueError if a checksum fails."""
    import zlib

    if data[:4] != MAGIC:
        raise ValueError("not a frame")
    n_docs, n_blocks, n_table, crc = (int(x) for x in np.frombuffer(data, "<u4", 4, 4))
    first = 20 + n_docs * _DOC.itemsize
    body = first + n_blocks * _BLOCK.itemsize + n_table
    if zlib.crc32(data[20:body]) != crc:
        raise ValueError("the frame's head is damaged")
    docs = np.frombuffer(data, _DOC, n_docs, 20)
    blocks = np.frombuffer(data, _BLOCK, n_blocks, first)
    words, at = [], body
    for n, size, crc, _ in blocks.tolist():
        w = data[at : at + size]
        if zlib.crc32(w) != crc:
            raise ValueError(f"block {len(words)}'s words are damaged")
        words.append((n, w))
        at += size
    found = range_coder.decode(words, range_coder.Table.load(data[body - n_table : body]))
    for i, (ids, crc) in enumerate(zip(found, blocks["ids_crc"].tolist())):
        if range_coder.checksum(ids) != crc:
            raise ValueError(f"block {i}'s ids are damaged")
    doc_ids = [i if k else None for i, k in zip(docs["id"].tolist(), docs["known"].tolist())]
    return doc_ids, docs["n"].astype(np.int64), np.concatenate(found) if found else np.empty(0, np.uint32)


def frames(docs: DataFrame, end: int = END, tokenizer: str = tokens.TOKENIZER, frame: int = FRAME) -> DataFrame:
    """(part, seq, first, n_tokens, frame): the documents' ids in ascending doc_id order; first counts a part's ids before the frame."""

    def build(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, first = TaskContext.get().partitionId(), 0, 0
        names, counts, ids, held = [], [], [], 0

        def flush():
            nonlocal seq, first, names, counts, ids, held
            all_, ids = np.concatenate(ids), []
            row = {"part": part, "seq": seq, "first": first, "n_tokens": held, "frame": pack_frame(names, np.concatenate(counts), all_)}
            seq, first = seq + 1, first + held
            names, counts, held = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in tc.sliced(batches, 1, tokens.SLICE):
            found, n = tokens.pieces(tokenizer).encode(batch.column(1), end)
            ends, doc, at = np.cumsum(n), batch.column(0).to_pylist(), 0
            while at < len(n):
                # whole documents up to the frame's size, one at least
                begin = int(ends[at] - n[at])
                to = max(at + 1, int(np.searchsorted(ends, begin + frame - held, "right"))) if held < frame else at
                if to > at:
                    names += doc[at:to]
                    counts.append(n[at:to])
                    ids.append(found[begin : int(ends[to - 1])])
                    held += int(ends[to - 1]) - begin
                    at = to
                if held >= frame or at < len(n):
                    yield flush()
        if held:
            yield flush()

    import pyarrow as pa

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.binary())])
    ordered = keyed(docs).repartitionByRange("doc_id", "_th").sortWithinPartitions("doc_id", "_th")
    return ordered.select("doc_id", "_text").mapInArrow(build, "part int, seq int, first long, n_tokens long, frame binary")


def write(docs: DataFrame, path: str, **options) -> None:
    """Writes the documents' ids to a folder."""
    frames(docs, **options).write.mode("errorifexists").option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): each document of a written folder, decoded and checked."""
    table = spark.read.parquet(path)
    sums = sorted((r[0], r[1]) for r in table.groupBy("part").agg(F.sum("n_tokens")).collect())  # a number for each part
    bases, total = [], 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    based = table.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select((F.col("base") + F.col("first")).alias("start"), "frame")

    def open_(batches):
        import zlib

        import pyarrow as pa

        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, n, found = unpack_frame(data.as_py())
                edges = np.concatenate([[0], np.cumsum(n)])
                raw = memoryview(np.ascontiguousarray(found, "<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())), np.int64, len(n))
                out = [pa.array(doc_ids, pa.int64()), pa.array(start + edges[:-1]), pa.array(n), pa.array(crc)]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(found.view(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return based.mapInArrow(open_, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def query(spark, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    write(load(spark, sf_dir, "documents", "doc_id", "text"), path)
    return read(spark, path, ids=False)


tc.by_value(__name__)
