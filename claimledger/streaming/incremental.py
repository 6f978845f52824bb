"""Incremental cycles (I1, I9, I10): the batch operators inside ``foreachBatch``; ``keyed`` has the forms with keyed state.

State is kept as Parquet snapshots: a batch reads the snapshot its pointer names, writes a new one
and moves the pointer last, so a batch that is run again after a failure gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimledger.operators.ledger import changed_payloads, keep_latest, latest_heads
from claimledger.operators.projection import clear_failures, merge_cursor, merge_failures, success_prefix


class Snapshots:
    """Numbered Parquet snapshots of one state table under ``root``; batch n's snapshot is ``root/n``."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def before(self, batch: int) -> DataFrame:
        """The last complete snapshot of a batch before this one; empty if there is none."""
        fs, path = self._fs()
        done = []
        if fs.exists(path(self.root)):
            done = [int(s.getPath().getName()) for s in fs.listStatus(path(self.root)) if s.getPath().getName().isdigit() and fs.exists(path(f"{s.getPath()}/_SUCCESS"))]
        earlier = [n for n in done if n < batch]
        if not earlier:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{max(earlier)}")

    def write(self, batch: int, state: DataFrame) -> None:
        state.write.mode("overwrite").parquet(f"{self.root}/{batch}")

    def latest(self) -> DataFrame:
        return self.before(1 << 62)


def run_cycles(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands every micro-batch to ``step`` and stops when the input is used up."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_step(spark: SparkSession, log_path: str, heads: Snapshots, keys: Sequence[str], hash_col: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Appends the changed payloads of a batch; ``heads`` holds the latest hash per key, not the whole log.

    A batch's rows go to ``log_path/batch=n``, overwritten if the batch is run again.
    """

    def step(batch: DataFrame, number: int) -> None:
        head = heads.before(number)
        new = changed_payloads(head, batch, keys, hash_col, order)
        new.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        heads.write(number, latest_heads(head, batch, keys, hash_col, order))

    return step


def failure_step(failures: Snapshots, now: Callable[[int], Column], threshold: int = 5) -> Callable[[DataFrame, int], None]:
    """Counts failures over micro-batches of (source, document_key, ok, error); a success clears its key.

    In one batch a key that succeeded at all has succeeded.  The ledger is a snapshot per batch, so a batch that is run again changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        key = ["source", "document_key"]
        seen = batch.groupBy(*key).agg(F.bool_or("ok").alias("ok"), F.max("error").alias("error"))
        cleared, _ = clear_failures(failures.before(number), seen.where("ok"))
        failures.write(number, merge_failures(cleared, seen.where("NOT ok").select(*key, "error"), now(number), threshold).drop("newly_dead"))

    return step


def feed_cycle(cursors: DataFrame, feed: DataFrame, outcome: DataFrame, source: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(new cursors, one-row summary) of a change-feed cycle.

    ``feed`` (id, date, seq) is de-duplicated (A1); ``outcome`` (id, failed) tells how each went; the
    cursor moves to the last date before the first failure, the rest of the batch counts all the same.
    """
    rows = keep_latest(feed, "id", "date", "seq").join(outcome, "id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))
    prefix = success_prefix(rows, "date", "id", "failed")
    moved = prefix.select(F.lit(source).alias("source"), F.try_to_timestamp("cursor").alias("cursor_last_modified"))
    summary = rows.agg(F.count("*").alias("listed"), F.count_if("failed").alias("failed"), F.count_if(~F.col("failed")).alias("ingested"))
    return merge_cursor(cursors, moved, now), summary
