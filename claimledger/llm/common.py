"""Helpers shared by the corpus operators: inputs, shared work folder, held-out split."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters that are neither space nor one of \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a local session may lack that setting (as in tests); it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="claimledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/claimledger-{uuid.uuid4().hex}"


def store(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Removes stored steps that nothing reads any more."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_heap() -> None:
    """Gives freed memory of this process back to the system, where its C library can do so.

    Spark keeps Python workers for later tasks, and the C library would keep what a task has freed: on an executor
    that counts against every later step.
    """
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    """The test fold: rows whose crc32 of the id as text has remainder 2 by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def sample_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` distinct values of ``key``, the same ones on every run: those of the smallest hash.

    Values above a hash threshold, set so that some 4 ``n`` pass it, go before anything is sorted or
    sent, so no task gets more than that many.
    """
    known = df.where(F.col(key).isNotNull()).select(key)
    share = 4 * n / max(1, known.agg(F.approx_count_distinct(key)).first()[0])
    if share < 1:
        known = known.where(F.xxhash64(key) <= int(-(2**63) + share * 2**64))
    return known.distinct().orderBy(F.xxhash64(key), key).limit(n)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, value: int, n: int) -> DataFrame:
    """At most ``n`` training documents (doc_id, text) whose label ``target`` is ``value``.

    The held-out fold is never used.  The sampled ids are at most ``n`` rows, so broadcasting
    them is bounded by a parameter.  Of rows that repeat a doc_id the least text counts (null: none).
    """
    ids = labels.where(~held_out(F.col("doc_id")) & (F.col(target) == value))
    return texts_of(docs, sample_by_hash(ids, "doc_id", n))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the few ``ids``, one row each."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
