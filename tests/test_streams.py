"""Streams with keyed state and cycles over tables that change together: restarts, lost writes, equality with the batch forms."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimledger.functions import scalars as S
from claimledger.operators import ledger, projection
from claimledger.plans import jobs
from claimledger.sources.tables import Kind, Tables
from claimledger.streaming import keyed
from claimledger.streaming.incremental import run_cycles
from tests.test_jobs import empty_state, status

T0 = datetime(2026, 6, 1)
HOUR = timedelta(hours=1)


def feed_batches(spark, folder, batches, schema, start):
    """Writes one file for each batch and runs the query to the end after each, so that every batch is a restart."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/check", f"{folder}/out").awaitTermination()


def to_parquet(df):
    return lambda check, out: df.writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start()


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.use_state_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_changed_payloads_over_restarts(spark, tmp_path, rocks):
    schema = "source string, doc string, h string, at timestamp, n int"
    at = lambda k: T0 + k * HOUR
    batches = [
        [("s", "a", "1", at(1), 1), ("s", "a", "1", at(2), 2), ("s", "b", "1", at(1), 3), (None, "x", "1", at(1), 4)],
        [("s", "a", "2", at(4), 5), ("s", "a", "1", at(5), 6), ("s", "b", "1", at(3), 7)],
        [("s", "a", "2", at(3), 8), ("s", "b", "2", at(4), 9), (None, "x", "1", at(1), 10)],  # 8 is late
        [("s", "a", "1", at(5), 11), ("s", "a", "1", at(6), 12), ("s", "c", None, at(1), 13), ("s", "c", None, at(2), 14)],
    ]
    feed_batches(spark, str(tmp_path), batches, schema, lambda s, check, out: to_parquet(keyed.changed_payloads_stream(s, ["source", "doc"], "h", ["at", "n"]))(check, out))
    heads = spark.createDataFrame([], "source string, doc string, h string, at timestamp, n int")
    want = []
    for rows in batches:
        batch = spark.createDataFrame(rows, schema)
        want += ledger.changed_payloads(heads, batch, ["source", "doc"], "h", ["at", "n"]).collect()
        heads = spark.createDataFrame(ledger.latest_heads(heads, batch, ["source", "doc"], "h", ["at", "n"]).collect(), heads.schema)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    # a first row without a hash is new here; the batch form takes a missing hash for none
    assert sorted((r.n for r in got if r.h)) == sorted(r.n for r in want if r.h) and {8, 4, 10} <= {r.n for r in got}
    assert [r.n for r in got if r.doc == "c"] == [13]


def test_failure_ledger_over_restarts(spark, tmp_path, rocks):
    schema = "source string, document_key string, ok boolean, error string, at timestamp"
    row = lambda k, ok, hours, error=None: ("s", k, ok, error, T0 + hours * HOUR)
    batches = [
        [row("a", False, 1, "e1"), row("b", False, 1, "e1"), row("d", False, 1, "x" * 600)],
        [row("a", False, 2, "e2"), row("b", True, 2), row("c", False, 2, "e"), row("c", True, 2)],
        [row("a", False, 3, "e3"), row("e", True, 3), ("s", None, False, "e", T0)],
        [row("z", True, 40)], [row("z", True, 41)],
    ]
    feed_batches(spark, str(tmp_path), batches, schema, lambda s, check, out: to_parquet(keyed.failure_stream(s, threshold=2))(check, out))
    state = spark.createDataFrame([], jobs.FAILURES)
    for k, rows in enumerate(batches):
        seen = spark.createDataFrame(rows, schema).where("document_key IS NOT NULL").groupBy("source", "document_key").agg(F.bool_or("ok").alias("ok"), F.max("error").alias("error"), F.max("at").alias("at"))
        if k < 3:
            cleared, _ = projection.clear_failures(state, seen.where("ok"))
            cleared = projection.merge_failures(cleared, seen.where("NOT ok").select("source", "document_key", "error"), S.instant(T0 + (k + 1) * HOUR), 2).drop("newly_dead")
            state = spark.createDataFrame(cleared.collect(), state.schema)
    want = {r.document_key: (r.attempts, r.first_failed_at, r.last_failed_at, r.last_error, r.dead_lettered_at) for r in state.collect()}
    table = {r.document_key: (r.attempts, r.first_failed_at, r.last_failed_at, r.last_error, r.dead_lettered_at) for r in keyed.failure_table(spark, str(tmp_path / "check")).collect()}
    assert table == want and set(table) == {"a", "d"} and len(table["d"][3]) == 500
    events = sorted((r.document_key, r.event, r.attempts) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert events == [("a", "dead", 2), ("a", "due", 3), ("a", "failed", 1), ("a", "failed", 3), ("b", "failed", 1), ("b", "recovered", 1), ("d", "failed", 1)]


def test_feed_rows_once(spark, tmp_path):
    schema = "id string, at timestamp, n int"
    batches = [[("a", T0, 1), ("a", T0, 1), ("b", T0, 2)], [("a", T0, 3), ("c", T0 + HOUR, 4)]]
    feed_batches(spark, str(tmp_path), batches, schema, lambda s, check, out: to_parquet(keyed.once_within(s, "at", ["id"]))(check, out))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4]


KINDS = {"t": Kind("k string, v int", "k"), "log": Kind("k string, v int", "k", append=True)}


def test_tables_touch_few_buckets(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), KINDS, buckets=32, most_files=3)
    rows = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"))
    tables.commit(0, {"t": (rows, None), "log": (rows, None)})
    keys = rows.where("k IN ('5', '6')")
    own = tables.buckets_of(keys, "k")
    part = tables.read("t", own)
    n_part = part.count()
    assert len(own) <= 2 and n_part < 2000 * 4 / 32
    assert all(any(f"_bucket={b}/" in f for b in own) for f in part.inputFiles())
    tables.commit(1, {"t": (part.join(keys.select("k", F.lit(1).alias("_n")), "k", "left").select("k", F.coalesce("_n", "v").alias("v")), own), "log": (keys, own)})
    old, new = tables.manifest(1)["tables"]["t"], tables.manifest()["tables"]["t"]
    assert {b for b in old if old[b] != new[b]} == {str(b) for b in own}
    assert tables.read("t").where("v = 1").count() == 2 and tables.read("t").count() == 2000 and tables.read("log").count() == 2002
    for e in range(2, 7):
        tables.commit(e, {"log": (keys, own)})
    assert tables.read("log").count() == 2012 and max(map(len, tables.manifest()["tables"]["log"].values())) <= 4
    assert tables.vacuum(1) > 0 and tables.read("log").count() == 2012 and tables.read("t").count() == 2000
    tables.commit(7, {"t": (rows.limit(0), own)})
    assert tables.read("t", own).count() == 0 and tables.read("t").count() == 2000 - n_part


def test_an_epoch_is_written_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path), KINDS, buckets=4)
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    tables.commit(3, {"log": (one, None)}, {"n": 1})
    tables.commit(3, {"log": (one, None)}, {"n": 2})
    assert tables.read("log").count() == 1 and tables.manifest()["summary"] == {"n": 1} and tables.epochs() == [3]
    with pytest.raises(RuntimeError):
        tables._publish({"epoch": 3, "tables": {}})


class Lost(Exception):
    pass


ENDS = ["2026-07-01T03:59:59Z", "2026-07-02T03:59:59Z", "2026-07-02T03:59:59Z"]
FEED = "id string, date string, seq long"
#: Lists of three micro-batches: C can't be read and dies in the second, B is withdrawn in the third.
BATCHES = [[(d, f"2026-06-0{k + 1} 10:00:00", k) for d in names] for k, names in enumerate(("ABC", "ABCD", "BCDE"))]


def details_of(spark, k):
    rows = [(d, "{broken" if d == "C" else status(d, ENDS[k], withdrawn=d == "B" and k == 2), T0 + k * HOUR, None) for d in "ABCDE"]
    return spark.createDataFrame(rows, "id string, raw string, fetched_at timestamp, error string")


def cycles(spark, folder, break_at=None):
    """The micro-batches through the tables; ``break_at``: writes of a stream, counted over all, that get lost (None: no stream)."""
    tables = Tables(spark, f"{folder}/tables", jobs.status_tables(spark), buckets=16, most_files=2)
    writes, write = [0], tables._write

    def fragile(name, epoch, rows):
        writes[0] += 1
        if writes[0] in (break_at or ()):
            raise Lost(name)
        return write(name, epoch, rows)

    tables._write = fragile
    for k, rows in enumerate(BATCHES):
        step = jobs.status_step(tables, lambda ids, k=k: ids.join(details_of(spark, k), "id"), "v1", lambda n: S.instant(T0 + n * HOUR), threshold=2)
        if break_at is None:
            step(spark.createDataFrame(rows, FEED), k)
            continue
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for _ in range(3):
            try:
                run_cycles(spark.readStream.schema(FEED).parquet(f"{folder}/in"), step, f"{folder}/check").awaitTermination()
                break
            except Exception as e:
                assert "Lost" in str(e), e
    return tables


def rows_of(df):
    return sorted((str(r) for r in df.select(sorted(df.columns)).collect()))


def test_cycles_survive_lost_writes(spark, tmp_path):
    calm, lost = cycles(spark, str(tmp_path / "calm")), cycles(spark, str(tmp_path / "lost"), break_at=(2, 13, 20))
    assert calm.epochs() == lost.epochs() == [0, 1, 2]
    for name in calm.kinds:
        assert rows_of(calm.read(name)) == rows_of(lost.read(name)), name
    assert [calm.manifest(e + 1)["summary"] for e in range(3)] == [lost.manifest(e + 1)["summary"] for e in range(3)]
    assert calm.manifest(2)["summary"]["dead_lettered"] == 1 and calm.manifest()["summary"]["skipped_dead"] == 1
    # the same cycles over whole tables
    state = empty_state(spark)
    for k, rows in enumerate(BATCHES):
        state, _ = jobs.status_cycle(state, spark.createDataFrame(rows, FEED), details_of(spark, k), S.instant(T0 + k * HOUR), "v1", threshold=2)
        state = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in state.items() if n not in ("new", "broken")}
    for name in ("projection", "conflicts", "cursors", "stamps", "failures"):
        whole = calm.read(name)
        assert rows_of(whole) == rows_of(state[name].select(whole.columns)), name
    assert {r.ocd_id[-2:]: (r.version, r.status) for r in calm.read("projection").collect()} == {"DA": (1, "open"), "DB": (1, "withdrawn"), "DD": (0, "open"), "DE": (0, "open")}


def test_since_is_the_cursor_or_two_days(spark):
    cursors = spark.createDataFrame([("regulations_gov", T0, T0)], "source string, cursor_last_modified timestamp, last_polled_at timestamp")
    now = S.instant(T0 + 100 * HOUR)
    assert jobs.due_since(cursors, "regulations_gov", now).first().since == T0
    assert jobs.due_since(cursors.limit(0), "regulations_gov", now).first().since == T0 + 52 * HOUR
