"""Lineage cuts: tables written to the folder that every executor shares.

A staged table survives the loss of any executor, is never recomputed and has
a size that the planner knows, so a small one is broadcast and a large one is
shuffled without any hint.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset and the session is a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "checkpoints")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at.getParent())
    files.mkdirs(at)
    files.deleteOnExit(at)
    files.delete(at, True)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    # Lets Spark's cleaner remove the shuffle files of what was just written: nothing refers to them any more.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged path that no later plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        drop_path(df.sparkSession, f)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Words of 64 bits in the bitmap that picks rows: 2 MB, however many keys there are.
SIEVE_WORDS = 1 << 18


def sifted(rows: DataFrame, row_key: Column, keys: DataFrame, key: Column) -> DataFrame:
    """The rows whose 64-bit key may be among ``keys``, in a narrow pass over ``rows``; few others stay while the bitmap is sparse.

    The bitmap has a fixed size, so its broadcast is bounded and the plan is the same
    for any number of keys. An exact join must follow.
    """
    place = lambda h: F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(SIEVE_WORDS - 1).cast("long"))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    own, word, bits = fresh(rows, "key", "word", "bits")
    bitmap = keys.select(key.alias("h")).groupBy(place(F.col("h")).alias(word)).agg(F.bit_or(bit(F.col("h"))).alias(bits))
    placed = rows.withColumn(own, row_key).join(F.broadcast(bitmap), place(F.col(own)) == F.col(word))
    return placed.where(F.col(bits).bitwiseAND(bit(F.col(own))) != 0).drop(own, word, bits)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts at most so long, unless the session asks for less: they are held on both sides of a worker's pipe.

    The session keeps the smaller setting: a plan takes it up only when it runs, after the query has returned.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
