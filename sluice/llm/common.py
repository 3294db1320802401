"""Shared column expressions.

Rows are identified by (doc_id, hash of the text): rows that agree in both are copies of one row and
get equal results, so no operator relies on doc_id being unique or not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["doc_id", "_th"]


def load(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the text's hash, and nothing else of docs but `more`."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("_th"), *[docs[c] for c in more])


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, computed once. A plain alias that a lambda reads may be inlined by the optimizer and then computed for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def lower_az(text: Column) -> Column:
    """A-Z to a-z and nothing else; the JVM's faster lower() serves where the text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def on_key(a: DataFrame, b: DataFrame, how: str, key: list[str] = KEY) -> DataFrame:
    """Joins on the row key, null doc_ids included; the right side's key columns go."""
    names = {k: f"_r_{k}" for k in key}
    right = b.withColumnsRenamed(names)
    return a.join(right, [a[k].eqNullSafe(right[names[k]]) for k in key], how).drop(*names.values())


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where none is set and driver and executors are one machine."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        import tempfile

        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sluice-ckpt-"))
        now = sc._jsc.sc().getCheckpointDir()
    return now.get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table written to the shared folder: lineage is cut and later reads take only the columns they use."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sluice_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, and lets Spark delete the shuffle files of plans that are done."""
    import gc

    spark = tables[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        where = jvm.org.apache.hadoop.fs.Path(t._sluice_path)
        where.getFileSystem(conf).delete(where, True)
    gc.collect()
    jvm.System.gc()
