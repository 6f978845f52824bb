"""Rows that are made once and read several times: written to the cluster's shared folder, removed when their job is over."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders that the jobs under way have written, the innermost job's last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())
#: While this is set, Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Only a local session may lack the setting; it then gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="claimledger-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and written as Parquet to the shared folder.

    What reads the result never runs ``df``'s plan again and reads only the columns that it needs, so rows of a
    provider are the same for all readers.  Inside a ``scope`` the files go when the scope ends, else they stay.
    """
    return stored_parts([df])


def stored_parts(parts: Iterable[DataFrame], outlive: bool = False) -> DataFrame:
    """``stored`` rows of one frame or more of one schema, computed one after the other.

    The shuffle files of a part are removed once it is written, so the disk holds those of one part at a time.  With ``outlive`` the
    files stay when the present scope ends and go with the one around it.
    """
    folder, scopes = None, _SCOPES.get()[:-1] if outlive else _SCOPES.get()
    for df in parts:
        spark = df.sparkSession
        if folder is None:
            folder = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
            if scopes:
                scopes[-1].append(folder)
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").mode("append").parquet(folder)
        finally:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(folder)


def once(df: DataFrame, keep: Sequence[str | Column], **fields: Column) -> DataFrame:
    """``keep`` and ``fields``, each field computed once a row.

    An ordinary column is written out again in every filter above it, so that a JSON text would be parsed dozens of times; a generator's
    result is not.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))))


def counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stored`` rows, and aggregates over them that were taken while they were written."""
    seen = Observation()
    rows = stored(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]))
    return rows, dict(seen.get)


def pinned(df: DataFrame) -> DataFrame:
    """Rows computed once that keep their partitions: a reliable checkpoint, for what depends on how rows are dealt."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes what is stored inside it when it ends; results read later must have been written elsewhere by then."""
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for folder in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
