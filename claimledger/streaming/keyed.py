"""Cycles whose state lives in the state store (I3, I9, I10): one value per key, timers for the slow retry.

Only the keys of a micro-batch are read and written; all other keys' state stays where it is, in RocksDB on the
executors and in its change log under the checkpoint, from which it comes back after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType, TimestampType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The ledger's columns as state; instants are microseconds, which mean the same in every worker.
LEDGER = "attempts int, first_failed_at long, last_failed_at long, last_error string, dead_lettered_at long, last_retry_at long"
INSTANTS = ("first_failed_at", "last_failed_at", "dead_lettered_at", "last_retry_at")


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store with its change log; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _keyed(stream: DataFrame, keys: Sequence[str], columns: Sequence[str], processor: StatefulProcessor, schema: StructType, mode: str) -> DataFrame:
    return stream.select(*columns).groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


class ChangedPayloads(StatefulProcessor):
    """Emits rows whose hash differs from the one before; the state is the latest row's hash and order."""

    def __init__(self, columns: Sequence[str], hash_col: str, order: Sequence[str], state: StructType):
        self.columns, self.hash_col, self.order, self.schema = list(columns), hash_col, list(order), state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        known = tuple(self.head.get()) if self.head.exists() else None
        rank = lambda values: tuple((v is not None, v) for v in values)  # noqa: E731  nulls first
        place = lambda r: rank(r[c] for c in self.order)
        before, first = (known[0], False) if known else (None, True)
        ordered = sorted(rows, key=place)
        for row in ordered:
            if first or row[self.hash_col] != before:
                yield Row(**{c: row[c] for c in self.columns})
            before, first = row[self.hash_col], False
        last = ordered[-1]
        if known is None or place(last) >= rank(known[1:]):
            self.head.update((last[self.hash_col], *[last[c] for c in self.order]))

    def close(self) -> None:
        pass


def changed_payloads_stream(stream: DataFrame, keys: Sequence[str], hash_col: str, order: Sequence[str]) -> DataFrame:
    """The rows of ``ledger.changed_payloads`` batch by batch, the latest hash per key being state.

    A late row is compared with the latest hash, as the batch form does, and does not replace it.  Rows with a null key pass.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    instant = lambda c: isinstance(kinds[c], (TimestampType, TimestampNTZType))
    at = {f"_order{i}": F.unix_micros(F.col(c).cast("timestamp")) if instant(c) else F.col(c) for i, c in enumerate(order)}
    state = StructType([StructField(hash_col, kinds[hash_col]), *[StructField(n, LongType() if instant(c) else kinds[c]) for n, c in zip(at, order, strict=True)]])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rows = stream.where(known).withColumns(at)
    kept = _keyed(rows, keys, rows.columns, ChangedPayloads(stream.columns, hash_col, list(at), state), stream.schema, "None")
    return kept.unionByName(stream.where(~known))


class FailureLedger(StatefulProcessor):
    """Consecutive failures per document, dead letters, and when they are due for the slow retry."""

    def __init__(self, threshold: int, retry_seconds: int):
        self.threshold, self.retry_ms = threshold, 1000 * retry_seconds
        self.schemas = StructType.fromDDL(LEDGER), StructType.fromDDL("at long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("ledger", self.schemas[0])
        self.alarm = handle.getValueState("alarm", self.schemas[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seen = list(rows)
        now = max(r["micros"] for r in seen)
        old = tuple(self.row.get()) if self.row.exists() else None
        if any(r["ok"] for r in seen):
            if old:
                self.row.clear()
                self._silence()
                yield self._event(key, "recovered", old, now)
            return
        attempts, first, _, _, dead, retried = old or (0, now, None, None, None, None)
        error = max((r["error"] for r in seen if r["error"] is not None), default=None)
        attempts += 1
        dies = dead is None and attempts >= self.threshold
        if dead is not None:
            retried = now
        new = (attempts, first, now, error[:500] if error is not None else None, now if dies else dead, retried)
        self.row.update(new)
        if new[4] is not None:
            self._silence()
            at = (retried or new[4]) // 1000 + self.retry_ms
            self.handle.registerTimer(at)
            self.alarm.update((at,))
        yield self._event(key, "dead" if dies else "failed", new, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.alarm.clear()
        if self.row.exists():
            yield self._event(key, "due", tuple(self.row.get()), at * 1000)

    def _silence(self) -> None:
        if self.alarm.exists():
            self.handle.deleteTimer(self.alarm.get()[0])
            self.alarm.clear()

    def _event(self, key, name: str, row: tuple, at: int) -> Row:
        return Row(source=key[0], document_key=key[1], event=name, attempts=row[0], micros=at)

    def close(self) -> None:
        pass


def failure_stream(attempts: DataFrame, threshold: int = 5, retry: str = "24 hours", lateness: str = "0 seconds") -> DataFrame:
    """I10 over a stream (source, document_key, ok, error, at): events failed, dead, recovered and due.

    A document that succeeds in a micro-batch has succeeded.  A dead letter is due ``retry`` after it died or was last tried, once event
    time has passed that instant.  The ledger itself is the state ``ledger`` (``failure_table``).  Null keys and times are left out.
    """
    seconds = int(attempts.sparkSession.sql(f"SELECT unix_seconds(TIMESTAMP '2000-01-01' + INTERVAL {retry}) - unix_seconds(TIMESTAMP '2000-01-01')").first()[0])
    rows = attempts.where("source IS NOT NULL AND document_key IS NOT NULL AND at IS NOT NULL").withColumn("ok", F.coalesce("ok", F.lit(False))).withColumn("at", F.col("at").cast("timestamp"))
    rows = rows.withWatermark("at", lateness).withColumn("micros", F.unix_micros("at"))
    schema = StructType.fromDDL("source string, document_key string, event string, attempts int, micros long")
    events = _keyed(rows, ["source", "document_key"], ["source", "document_key", "ok", "error", "at", "micros"], FailureLedger(threshold, seconds), schema, "EventTime")
    return events.withColumn("at", F.timestamp_micros("micros")).drop("micros")


def failure_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The failure ledger as it stands in the state under a query's checkpoint."""
    rows = spark.read.format("statestore").option("stateVarName", "ledger").load(checkpoint)
    return rows.select("key.source", "key.document_key", "value.*").withColumns({c: F.timestamp_micros(c) for c in INSTANTS})


def once_within(stream: DataFrame, at: str, keys: Sequence[str], overlap: str = "6 hours") -> DataFrame:
    """At-least-once feed to once per key, with a watermark; keeps the first row, A1 keeps the latest."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, overlap).dropDuplicatesWithinWatermark(list(keys))
