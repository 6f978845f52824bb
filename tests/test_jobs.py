"""Whole jobs on small literal tables: cycles, replay against increments, chain sweep, verification, providers, exports."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from claimledger.functions import scalars as S
from claimledger.operators import chain, ledger, metrics, projection, reconcile, serve, verify
from claimledger.plans import jobs
from claimledger.sources import files
from claimledger.streaming.incremental import Snapshots, failure_step, run_cycles

T0 = datetime(2026, 6, 1)
LOG = "ocd_id string, observation_id string, source string, fetched_at timestamp, raw string"


def primary(number, close, **more):
    return json.dumps({"document_number": number, "comments_close_on": close, "publication_date": "2026-05-01"} | more)


def status(ident, end, **more):
    return json.dumps({"data": {"id": ident, "attributes": {"frDocNum": f"D{ident}", "commentEndDate": end, "openForComment": True} | more}})


@pytest.fixture
def counted(spark):
    """A provider that counts the rows it is given, over all tasks."""
    calls = spark.sparkContext.accumulator(0)

    def judge(row):
        calls.add(1)
        if row["content_hash"] == "bad":
            raise ValueError("no answer")
        return ("affirm" if row["content_hash"] < "h3" else "maybe" if row["content_hash"] == "h9" else "reject"), "because"

    return calls, chain.python_provider(judge)


def test_provider_is_asked_once_and_within_the_budget(spark, counted):
    calls, provider = counted
    now = S.instant("2026-06-20 00:00:00")
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}", f"h{i % 8}") for i in range(16)], "ocd_id string, ocd_id_b string, content_hash string")
    cache = spark.createDataFrame([], "content_hash string, adjudicator_id string, classification string, rationale string, created_at timestamp")
    out, after = chain.adjudicate(pairs, cache, provider, "p:m@1", now, budget=5)
    assert {r.outcome for r in out.collect()} == {"linked", "not_linked", "deferred"} and after.count() == 5 and out.count() == 16
    assert calls.value == 5
    again, last = chain.adjudicate(pairs, after, provider, "p:m@1", now, budget=5)
    assert {r.outcome for r in again.collect()} == {"linked", "not_linked"} and last.count() == 8 and calls.value == 8
    assert chain.adjudicate(pairs, cache, provider, "p:m@1", now, budget=-1)[1].count() == 0 and calls.value == 8


def test_failed_hashes_are_tried_again_but_not_cached(spark, counted):
    calls, provider = counted
    now = S.instant("2026-06-20 00:00:00")
    pairs = spark.createDataFrame([("a1", "b", "bad"), ("a2", "b", "bad"), ("a3", "b", "h9"), ("a4", "b", "h1")], "ocd_id string, ocd_id_b string, content_hash string")
    cache = spark.createDataFrame([], "content_hash string, adjudicator_id string, classification string, rationale string, created_at timestamp")
    out, after = chain.adjudicate(pairs, cache, provider, "p:m@1", now)
    got = {r.ocd_id: (r.outcome, r.classification) for r in out.collect()}
    # "maybe" is no known verdict; "bad" has a second pair and is put again, "h9" has none
    assert got == {"a1": ("error", None), "a2": ("error", None), "a3": ("error", None), "a4": ("linked", "affirm")}
    assert [r.content_hash for r in after.collect()] == ["h1"] and calls.value == 4


def test_latest_claims_ties(spark):
    rows = [("e", f"o{i}", reconcile.PRIMARY, T0, "x") for i in (4, 2, 5, 0, 3, 1)] + [("e", "p1", reconcile.STATUS, None, "x"), ("e", "p2", reconcile.STATUS, T0, "x")]
    r = reconcile.latest_claims(spark.createDataFrame(rows, LOG)).first()
    assert (r.a.observation_id, r.b.observation_id) == ("o0", "p2")


def test_ranks_with_other_columns(spark):
    rows = spark.range(20_000).select((F.xxhash64("id") % 5000).alias("k"), "id", F.rand(3).alias("extra"))
    got = serve.ranks(rows, ["k", "id"], 8)
    assert got.select("rank").distinct().count() == 20_000 and got.agg(F.max("rank")).first()[0] == 20_000
    want = {r.id: i for i, r in enumerate(rows.orderBy("k", "id").select("id").collect(), 1)}
    assert all(want[r.id] == r.rank for r in got.select("id", "rank").collect())


def test_replay_is_what_cycles_arrive_at(spark):
    """T4: one fold over the log gives the versions and histories of merging instant after instant."""
    now = S.instant("2026-06-20 00:00:00")
    closes = {"e1": ["2026-07-01", "2026-07-01", "2026-07-05", "2026-07-01"], "e2": ["2026-07-02", None, "2026-07-03"], "e3": ["2026-08-01"]}
    rows = [(e, f"{e}-{i}", reconcile.PRIMARY, T0 + timedelta(hours=i), primary(e, d)) for e, ds in closes.items() for i, d in enumerate(ds)]
    rows += [("e2", "s0", reconcile.STATUS, T0 + timedelta(hours=1), status("X", "2026-07-09T03:59:59Z")), ("e3", "s1", reconcile.STATUS, T0 + timedelta(hours=3), status("Y", "2026-08-09T03:59:59Z"))]
    log = spark.createDataFrame(rows, LOG).repartition(3)
    state = None
    for h in range(4):
        derived = reconcile.reconcile_log(log.where(F.col("fetched_at") <= F.lit(T0 + timedelta(hours=h))), now).drop("version")
        if state is None:
            state = derived.limit(0).withColumn("version", F.lit(0)).withColumn("change_history", F.array().cast(projection.HISTORY))
        state = spark.createDataFrame((m := projection.merge_projection(state, derived, now)).collect(), m.schema)
    want = {r.ocd_id: (r.version, r.resolved_close_utc, [x.resolved_close_utc for x in r.change_history]) for r in state.collect()}
    got = {r.ocd_id: (r.version, r.resolved_close_utc, [x.close for x in r.history]) for r in reconcile.replay_log(log, now).collect()}
    assert got == want and want["e1"][0] == 2


def empty_state(spark):
    now = S.instant("2026-06-20 00:00:00")
    none, _ = files.status_observations(spark.createDataFrame([], "raw string, fetched_at timestamp"), "v1")
    log = none.withColumn("observation_id", F.lit("x"))
    derived = reconcile.reconcile_log(log, now)
    return {
        "log": log, "projection": derived.drop("version").withColumn("version", F.lit(0)).withColumn("change_history", F.array().cast(projection.HISTORY)), "conflicts": reconcile.conflict_rows(derived, now),
        "cursors": spark.createDataFrame([], "source string, cursor_last_modified timestamp, last_polled_at timestamp"), "stamps": spark.createDataFrame([], "regs_document_id string, last_checked_at timestamp"),
        "failures": spark.createDataFrame([], "source string, document_key string, attempts int, first_failed_at timestamp, last_failed_at timestamp, last_error string, dead_lettered_at timestamp, last_retry_at timestamp"),
    }


def test_status_cycle(spark):
    feed = spark.createDataFrame([("A", "2026-06-01 10:00:00", 1), ("B", "2026-06-02 10:00:00", 2), ("A", "2026-06-03 10:00:00", 3), ("C", "2026-06-04 10:00:00", 4)], "id string, date string, seq long")
    rows = [("A", status("A", "2026-07-01T03:59:59Z"), T0, None), ("B", status("B", "2026-07-02T03:59:59Z"), T0, None), ("C", "{broken", T0, None)]
    details = spark.createDataFrame(rows, "id string, raw string, fetched_at timestamp, error string")
    keep = lambda s: {k: spark.createDataFrame(v.collect(), v.schema) for k, v in s.items()}
    state = keep(empty_state(spark))
    state, one = jobs.status_cycle(state, feed, details, S.instant("2026-06-20 00:00:00"), "v1", threshold=2)
    r = one.first()
    assert (r.listed, r.ingested, r.failed, r.deduped, r.dead_lettered, r.cursor) == (3, 2, 1, 0, 0, "2026-06-03 10:00:00")
    state = keep(state)
    assert {x.regs_document_id for x in state["stamps"].collect()} == {"A", "B"} and state["projection"].count() == 2
    # the same once more: nothing new, C dies; then it is no longer looked at and the cursor passes it
    state, one = jobs.status_cycle(state, feed, details, S.instant("2026-06-20 01:00:00"), "v1", threshold=2)
    r = one.first()
    assert (r.ingested, r.deduped, r.failed, r.dead_lettered) == (0, 2, 1, 1)
    state = keep(state)
    assert {x.version for x in state["projection"].collect()} == {0}
    state, one = jobs.status_cycle(state, feed.unionByName(spark.createDataFrame([("B", "2026-06-05 10:00:00", 5)], feed.schema)), details, S.instant("2026-06-20 02:00:00"), "v1", threshold=2)
    r = one.first()
    assert (r.skipped_dead, r.failed, r.cursor) == (1, 0, "2026-06-05 10:00:00")


def test_chain_sweep(spark):
    now = S.instant("2026-06-20 00:00:00")
    flags = ("is_extension", "is_correction", "is_withdrawal", "is_reopening")
    rows = [
        ("e1", "o1", reconcile.PRIMARY, T0, primary("N1", "2026-07-01", docket_ids=["D"], regulation_id_numbers=["R1"]), *[False] * 4),
        ("e2", "o2", reconcile.PRIMARY, T0, primary("N2", "2026-07-09", docket_ids=["D"], regulation_id_numbers=["R1"], publication_date="2026-05-20"), True, False, False, False),
        ("e3", "o3", reconcile.PRIMARY, T0, primary("N3", "2026-07-09", docket_ids=["D"], publication_date="2026-05-25"), False, True, False, False),
    ]
    log = spark.createDataFrame(rows, LOG + ", " + ", ".join(f"{f} boolean" for f in flags))
    proj = reconcile.reconcile_log(log, now)
    cache = spark.createDataFrame([], "content_hash string, adjudicator_id string, classification string, rationale string, created_at timestamp")
    affirm = chain.python_provider(lambda row: ("affirm", "yes"))
    live, after, one = chain.chain_sweep(log, proj, reconcile.conflict_rows(proj, now), cache, affirm, "p:m@1", now)
    got = {(r.ocd_id, r.ocd_id_b): list(r.conflict_flags) for r in live.collect()}
    assert got[("e1", "e2")] == ["extension_chain_unresolved"]
    assert got[("e1", "e3")] == got[("e2", "e3")] == ["correction_pending", "llm_corroborated"] and len(got) == 3
    r = one.first()
    assert (r.linked, r.ambiguous, r.affirmed, r.live, r.retired) == (1, 2, 2, 3, 0) and after.count() == 2
    # nothing is linked any more: every open row of this scope is retired
    gone, _, one = chain.chain_sweep(log.where("ocd_id = 'e1'"), proj, live, cache, None, "p:m@1", S.instant("2026-06-21 00:00:00"))
    assert one.first().retired == 3 and all(r.resolved_at for r in gone.collect())
    assert reconcile.violations(live, "conflicts").count() == 0


def test_fixtures_replay(spark):
    t = datetime(2026, 6, 1)
    schema = (
        "meta struct<ocd_id: string>, input struct<publishedCloseUtc: timestamp, currentCloseUtc: timestamp, observationsSinceClose: " + verify.SINCE + ">, "
        "expected struct<was_correct: boolean, basis: string, contradicting_observation_ids: array<string>>"
    )
    seen = [("o2", t, False, False, True, False), ("o1", t, False, False, True, False)]
    rows = [
        (("good",), (t, t, []), (True, "post_close_repoll", [])),
        (("late",), (t, t, seen), (False, "late_amendment", ["o1", "o2"])),
        (("wrong",), (t, t, seen), (True, "post_close_repoll", [])),
    ]
    assert [r.meta.ocd_id for r in verify.replay_fixtures(spark.createDataFrame(rows, schema)).collect()] == ["wrong"]


def test_failures_on_a_stream(spark, tmp_path):
    schema = "source string, document_key string, ok boolean, error string"
    ledger_schema = "source string, document_key string, attempts int, first_failed_at timestamp, last_failed_at timestamp, last_error string, dead_lettered_at timestamp, last_retry_at timestamp"
    failures = Snapshots(spark, str(tmp_path / "failures"), ledger_schema)
    step = failure_step(failures, lambda n: S.instant("2026-06-20 00:00:00") + F.make_interval(hours=F.lit(n)), threshold=2)
    for i, rows in enumerate(([("x", "a", False, "e1"), ("x", "b", False, "e1")], [("x", "a", False, "e2"), ("x", "b", True, None)], [("x", "c", False, "e3")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_cycles(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), step, str(tmp_path / "check")).awaitTermination()
        step(spark.createDataFrame(rows, schema), i)  # a batch that runs again changes nothing
    got = {r.document_key: (r.attempts, r.dead_lettered_at is not None) for r in failures.latest().collect()}
    assert got == {"a": (2, True), "c": (1, False)}


def test_exports_and_pages(spark, tmp_path):
    log = spark.createDataFrame([("w", "o1", reconcile.PRIMARY, T0, primary("N", "2026-06-16"))], LOG)
    proj = reconcile.reconcile_log(log, S.instant("2026-06-20 00:00:00"))
    files.write_windows(proj, str(tmp_path / "out"))
    row = json.loads(next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".json").read_text())
    assert set(row) == set(files.EXPORT) and row["raw_fr_close_date"] == "2026-06-16" and row["window_type"] == "comment" and row["resolved_close_utc"].startswith("2026-06-17T03:59:59")
    with pytest.raises(Exception, match="version"):
        files.write_windows(proj.drop("version"), str(tmp_path / "bad"))
    pages = spark.createDataFrame([(3000, [("k", "2026-01-01"), ("k", "2026-02-01"), (None, "x")])], "page int, results array<struct<k: string, d: string>>")
    assert [tuple(r) for r in files.list_rows(pages, "results", "k", "d").collect()] == [("k", "2026-02-01")]


def test_null_keys_stand_apart(spark):
    batch = spark.createDataFrame([(None, "h", i) for i in range(5)] + [("k", "h", 1), ("k", "h", 2)], "k string, h string, t int")
    got = ledger.changed_payloads(None, batch, ["k"], "h", ["t"])
    assert got.count() == 6 and got.where("k IS NULL").count() == 5


def test_increases_cross_windows(spark):
    t = datetime(2026, 1, 1)
    rows = [("a", t + timedelta(minutes=30 * i), i, v) for i, v in enumerate((5.0, 7.0, 3.0, 10.0, 10.0, 2.0))]
    got = metrics.increases(spark.createDataFrame(rows, "l string, at timestamp, n int, v double").repartition(3), ["l"], "at", "v", "n").orderBy("window_start").collect()
    assert [r.increase for r in got] == [2.0, 3.0 + 7.0, 0.0 + 2.0]
