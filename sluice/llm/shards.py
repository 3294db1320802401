"""Operator 6: sharding by vector bin packing.

Groups (rows of one text) are placed so that shards balance bytes, tokens and rows jointly: each group
goes where the dot product of its size with the residual capacity, both as shares of the totals, is
highest. The law that holds is `bytes`: sizes near equal.

How it is spread out: groups are dealt to cells by hash, and each cell places its groups, largest first,
into shards of its own with an equal share of the cell's totals. A task holds 3 numbers for each shard,
whatever the cell's length. A cell's shards are then bundles, placed once more by the same rule on the
driver, largest first. Each is cut in LEVELS by what the cell had placed before (its last 10 % and 1 % of
bytes are the small groups), so the last bundles are small and even out what the first left; there are
CELLS * shards * LEVELS bundles at most. Groups larger than a SPLIT-th part of a shard are cut by
row into pieces first (there are at most shards * SPLIT of them, so that list may be broadcast); smaller
groups always stay together. Slots are a running sum of the counts of (cell, shard), likewise bounded.

Defined cases: a null text has no bytes, no tokens, a null checksum, and forms a group of its own; an
empty text is another; repeated rows are rows of one group; a null doc_id is placed like any other; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import checkpoint, load

SHARDS, CELLS, SPLIT, LEVELS = 24, 64, 16, 3
#: Weights of bytes, tokens and rows in the dot product; bytes lead, since theirs is the law that holds.
WEIGHTS = (4.0, 1.0, 1.0)
#: Bytes that a row takes beside its text.
ROW_BYTES = 8


def place(sizes, shards: int, total):
    """Shard of each (bytes, tokens, rows) by the highest dot product with the residual capacity; sizes come largest first.

    The law is that of bytes, so the last tenth of them, the smallest, goes by bytes alone.
    """
    import numpy as np

    share = np.asarray(sizes, dtype=float) / np.maximum(np.asarray(total, dtype=float), 1.0)
    left = np.full((shards, share.shape[1]), 1.0 / shards)
    out = np.empty(len(share), dtype=np.int32)
    placed = np.cumsum(share[:, 0])
    for i, v in enumerate(share):
        j = out[i] = int(np.argmax(left @ (v * WEIGHTS) if placed[i] <= 0.9 else left[:, 0]))
        left[j] -= v
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, n_tokens, shard, slot): one row for each of docs."""
    text = docs["text"].cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    tokens = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = checkpoint(docs.select(docs["doc_id"].cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), tokens.alias("n_tokens"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("_g")))
    total = rows.agg(F.sum("size"), F.sum("n_tokens"), F.count("*")).first()
    total = [x or 0 for x in total]
    part = max(1, total[0] // (shards * SPLIT))  # bytes that a piece may have
    # rows of a group have one size, so a group's pieces are known from its bytes
    sums = [F.sum("size").alias("b"), F.sum("n_tokens").alias("t"), F.count("*").alias("n")]
    heavy = rows.groupBy("_g").agg(F.sum("size").alias("_b")).filter(F.col("_b") > part).select("_g", F.ceil(F.col("_b") / part).cast("int").alias("_pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", "_salt"), F.col("_pieces")), F.lit(0)).cast("int")
    salted = rows.withColumn("_salt", F.spark_partition_id()).join(F.broadcast(heavy), "_g", "left").select("doc_id", "size", "text_crc32", "n_tokens", "_g", piece.alias("_p"))
    salted = checkpoint(salted)
    groups = salted.groupBy("_g", "_p").agg(*sums).withColumn("_cell", F.pmod(F.xxhash64("_g", "_p"), F.lit(CELLS)).cast("int"))
    groups = checkpoint(groups)
    totals = {r["_cell"]: (r["b"], r["t"], r["n"]) for r in groups.groupBy("_cell").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")).collect()}  # CELLS rows

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        left, now, placed = None, None, 0.0
        for batch in batches:
            cells = batch.column(2).to_numpy()
            v = np.stack([batch.column(i).to_numpy().astype(float) for i in (3, 4, 5)], axis=1)
            out = np.empty(len(cells), dtype=np.int32)
            for i, c in enumerate(cells):
                if c != now:
                    now, scale, left, placed = c, 1.0 / np.maximum(np.asarray(totals[c], dtype=float), 1.0), np.full((shards, 3), 1.0 / shards), 0.0
                x = v[i] * scale
                j = int((left @ (x * WEIGHTS)).argmax())
                left[j] -= x
                placed += x[0]
                out[i] = j * LEVELS + (placed > 0.9) + (placed > 0.99)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["_g", "_p", "_cell", "b", "t", "n", "_bundle"])

    sorted_groups = groups.select("_g", "_p", "_cell", "b", "t", "n").repartition(CELLS, "_cell").sortWithinPartitions("_cell", F.desc("b"), "_g", "_p")
    schema = T.StructType([*sorted_groups.schema.fields, T.StructField("_bundle", T.IntegerType())])
    packed = checkpoint(sorted_groups.mapInArrow(pack, schema))
    bundles = packed.groupBy("_cell", "_bundle").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("n").alias("n")).collect()  # CELLS * shards * LEVELS rows at most
    bundles.sort(key=lambda r: (-r["b"], r["_cell"], r["_bundle"]))
    shard = place([(r["b"], r["t"], r["n"]) for r in bundles], shards, total) if bundles else []
    filled, table = [0] * shards, []
    for r, s in sorted(zip(bundles, shard), key=lambda x: (x[0]["_cell"], x[0]["_bundle"])):
        table.append((r["_cell"], r["_bundle"], int(s), filled[s]))
        filled[s] += r["n"]
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(table, "_cell int, _bundle int, shard int, _start long"))
    located = packed.join(plan, ["_cell", "_bundle"]).withColumnRenamed("n", "_n")
    # a group's rows follow each other; its place in the bundle is the running sum over a bundle's groups
    order = _running(located)
    rows = salted.join(order, ["_g", "_p"])
    return _slots(rows)


def _running(located: DataFrame) -> DataFrame:
    """Adds each group's first slot: a running sum of rows over the groups of a bundle."""
    from pyspark.sql import Window as W

    w = W.partitionBy("_cell", "_bundle").orderBy("_g", "_p").rowsBetween(W.unboundedPreceding, -1)
    return located.select("_g", "_p", "shard", (F.col("_start") + F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_first"))


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each group from its first slot; a group is at most a piece, so the window is bounded by a part of a shard."""
    from pyspark.sql import Window as W

    w = W.partitionBy("_g", "_p").orderBy("doc_id")
    return rows.select("doc_id", "size", "text_crc32", "n_tokens", "shard", (F.col("_first") + F.row_number().over(w) - 1).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    out = assign(load(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
