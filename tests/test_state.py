"""Ledger, reconcile, projection, chain, verification on small literal tables."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimledger.functions import scalars as S
from claimledger.operators import chain, ledger, projection, reconcile, verify
from claimledger.streaming.incremental import Snapshots, feed_cycle, ingest_step, run_cycles



@pytest.fixture(autouse=True)
def now(spark):
    """Columns need a session, so the common ``NOW`` is made for each test."""
    global NOW
    NOW = S.instant("2026-06-20 00:00:00")


def test_changed_payloads(spark):
    log = spark.createDataFrame([("k", "A", 1), ("k", "B", 2)], "k string, h string, t int")
    batch = spark.createDataFrame([("k", "B", 3), ("k", "A", 4), ("k", "A", 5), ("n", "A", 3), (None, "A", 3), (None, "A", 4)], "k string, h string, t int")
    got = sorted(tuple(r) for r in ledger.changed_payloads(log, batch, ["k"], "h", ["t"]).collect() if r.k)
    assert got == [("k", "A", 4), ("n", "A", 3)]
    assert ledger.changed_payloads(log, batch, ["k"], "h", ["t"]).where("k IS NULL").count() == 2


def test_keep_latest(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "2026-01-01", 2), ("a", "2026-01-01", 3), ("", "x", 4), (None, "x", 5), ("b", None, 6)], "k string, d string, s int")
    assert sorted((r.k, r.s) for r in ledger.keep_latest(rows, "k", "d", "s").collect()) == [("a", 2), ("b", 6)]


CLAIM = "ocd_id string, a_id string, a_date string, b_id string, b_raw_end string, b_open boolean, b_withdrawn boolean, b_allow_late boolean"
CASES = [
    ("R1", "2026-06-16", "2026-06-17T03:59:59Z", None, True, None, "conflicting", ["withdrawn_vs_open"], "withdrawn"),
    ("R2", None, "2026-06-17T03:59:59Z", None, True, None, "low", [], "withdrawn"),
    ("R2", None, None, None, True, None, "unknown", [], "withdrawn"),
    ("R3", "2026-06-17", "2026-06-17T03:59:59Z", True, None, None, "conflicting", ["fr_regs_date_mismatch"], "open"),
    ("R4", "2026-06-16", "2026-06-17T03:59:59Z", False, None, None, "medium", ["tz_normalization_only"], "closed"),
    ("R5", "2026-06-16", "2026-06-16T15:00:00Z", None, None, None, "high", [], "closed"),
    ("R6", None, "2026-07-17T03:59:59Z", None, None, True, "medium", ["late_comment_ambiguous"], "open"),
    ("R7", "2026-06-16", None, True, None, None, "low", ["null_end_date_open_status"], "open"),
    ("R8", "2026-06-16", "bad", True, None, None, "medium", [], "open"),
    ("R9", None, "bad", True, None, None, "unknown", [], "open"),
]


def test_reconcile_branches(spark):
    rows = [(str(i), "a", a, "b", raw, op, wd, late) for i, (_, a, raw, op, wd, late, *_) in enumerate(CASES)]
    claims = spark.createDataFrame(rows, CLAIM).withColumn("b_close", S.utc_instant(F.col("b_raw_end")))
    got = {int(r.ocd_id): r for r in reconcile.reconcile_claims(claims, NOW).collect()}
    for i, (branch, _, _, _, _, _, confidence, flags, status) in enumerate(CASES):
        r = got[i]
        assert (r.branch, r.confidence, r.conflict_flags, r.status) == (branch, confidence, flags, status), i


def test_reconcile_from_raw(spark):
    t = datetime(2026, 6, 1)
    log = spark.createDataFrame(
        [
            ("w", "o1", "federal_register", t, '{"document_number":"2026-1","comments_close_on":"2026-06-16","publication_date":"2026-05-01","docket_ids":["D1",2],"regulation_id_numbers":[" R "," "]}'),
            ("w", "o2", "regulations_gov", t, '{"data":{"id":"X","attributes":{"commentEndDate":"2026-06-17T03:59:59Z","openForComment":"true","docketId":"D2"}}}'),
            ("v", "o3", "federal_register", t, "[]"),
        ],
        "ocd_id string, observation_id string, source string, fetched_at timestamp, raw string",
    )
    got = {r.ocd_id: r for r in reconcile.reconcile_log(log, NOW).collect()}
    w = got["w"]
    assert (w.confidence, w.docket_id, w.rin, w.regs_document_id, w.b_open) == ("high", ["D1", "D2"], "R", "X", None)
    assert w.provenance.agreeing_observation_ids == ["o1", "o2"] and w.govinfo_url == "https://www.govinfo.gov/content/pkg/FR-2026-05-01/html/2026-1.htm"
    assert got["v"].confidence == "unknown" and reconcile.violations(reconcile.reconcile_log(log, NOW), "projection").count() == 0


def test_versions(spark):
    schema = "ocd_id string, resolved_close_utc timestamp, current_observation_ids array<string>"
    t1, t2 = datetime(2026, 1, 1), datetime(2026, 2, 1)
    empty = spark.createDataFrame([], schema + f", version int, change_history {projection.HISTORY}")
    one = projection.merge_projection(empty, spark.createDataFrame([("a", t1, ["1"]), ("b", None, ["2"])], schema), NOW)
    same = projection.merge_projection(one, spark.createDataFrame([("a", t1, ["9"])], schema), NOW)
    two = {r.ocd_id: r for r in projection.merge_projection(same, spark.createDataFrame([("a", None, ["3"]), ("b", t2, ["4"])], schema), NOW).collect()}
    assert two["a"].version == 1 and two["a"].change_history[0].resolved_close_utc == t1 and two["a"].change_history[0].observation_ids == ["9"]
    assert two["b"].version == 1 and two["b"].change_history[0].resolved_close_utc is None


CONFLICT = "ocd_id string, observation_a_id string, observation_b_id string, ocd_id_b string, conflict_flags array<string>, conflict_scope string, detected_at timestamp, resolved_at timestamp"


def test_conflicts_come_and_go(spark):
    old_t = datetime(2026, 1, 1)
    cur = spark.createDataFrame([("a", "1", "2", None, ["x"], "cross_source", old_t, None), ("b", "1", "2", None, ["x"], "cross_source", old_t, None), ("a", "1", "3", "z", ["y"], "cross_window", old_t, None), ("c", "1", "2", None, ["x"], "cross_source", old_t, old_t)], CONFLICT)
    live = spark.createDataFrame([("a", "1", "2", None, ["w"], "cross_source", datetime(2026, 6, 20), None), ("c", "1", "2", None, ["x"], "cross_source", datetime(2026, 6, 20), None)], CONFLICT)
    out = {(r.ocd_id, r.conflict_scope): r for r in projection.merge_conflicts(cur, live, NOW, "cross_source").collect()}
    assert out["a", "cross_source"].detected_at == old_t and out["a", "cross_source"].conflict_flags == ["w"]
    assert out["b", "cross_source"].resolved_at and out["c", "cross_source"].resolved_at is None and out["a", "cross_window"].resolved_at is None
    touched = spark.createDataFrame([("a",)], "ocd_id string")
    kept = {r.ocd_id: r for r in projection.merge_conflicts(cur, live.where("false"), NOW, "cross_source", touched).where("conflict_scope = 'cross_source'").collect()}
    assert kept["a"].resolved_at and kept["b"].resolved_at is None


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xyz")), min_size=1, max_size=6))
def test_conflict_merge_is_idempotent(spark, pairs):
    t = datetime(2026, 1, 1)
    live = spark.createDataFrame(sorted({(a, b, "2", None, ("x",), "cross_source", t, None) for a, b in pairs}, key=str), CONFLICT)
    once = projection.merge_conflicts(live.where("false"), live, NOW, "cross_source")
    twice = projection.merge_conflicts(once, live, NOW, "cross_source")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_failures(spark):
    schema = "source string, document_key string, attempts int, first_failed_at timestamp, last_failed_at timestamp, last_error string, dead_lettered_at timestamp, last_retry_at timestamp"
    state, failed = spark.createDataFrame([], schema), spark.createDataFrame([("s", "k", "boom" * 200)], "source string, document_key string, error string")
    for n in range(1, 4):
        out = projection.merge_failures(state, failed, NOW, threshold=2)
        row = out.collect()[0]
        assert (row.attempts, row.newly_dead, len(row.last_error)) == (n, n == 2, 500)
        state = spark.createDataFrame(out.drop("newly_dead").collect(), schema)
    left, recovered = projection.clear_failures(state, failed)
    assert left.count() == 0 and recovered.count() == 1


def test_cursor_stops_at_failure(spark):
    feed = spark.createDataFrame([("a", "2026-06-01 00:00:00", 1), ("b", "2026-06-02 00:00:00", 2), ("b", "2026-06-01 12:00:00", 3), ("c", "2026-06-03 00:00:00", 4)], "id string, date string, seq int")
    cursors = spark.createDataFrame([("s", datetime(2026, 5, 1), None)], "source string, cursor_last_modified timestamp, last_polled_at timestamp")
    out, summary = feed_cycle(cursors, feed, spark.createDataFrame([("b", True)], "id string, failed boolean"), "s", NOW)
    assert out.collect()[0].cursor_last_modified == datetime(2026, 6, 1) and tuple(summary.collect()[0]) == (3, 1, 2)


CANDIDATE = "ocd_id string, fr_observation_id string, fr_document_number string, docket_ids array<string>, rins array<string>, is_extension boolean, is_correction boolean, is_withdrawal boolean, is_reopening boolean, title string, publication_date string, govinfo_url string, dates_text string, status string, resolved_close_utc timestamp"


def candidate(key, pub, docket=("D",), rins=("R",), ext=False, title="Rule", dates=None, status="closed", close=datetime(2025, 1, 10)):
    return (key, "o" + key, "2025-" + key, list(docket), list(rins), ext, False, False, False, title, pub, None, dates, status, close)


def test_chain_rules(spark):
    rows = [
        candidate("1", "2025-01-01"), candidate("2", "2025-02-01", ext=True), candidate("3", "2025-02-01", ext=True, rins=("", "Q")), candidate("4", "2025-02-01", ext=True, rins=("Q",), dates="see 2025- 1."),
        candidate("5", "2024-12-01", ext=True), candidate("6", "2025-03-12", ext=True), candidate("7", "2025-02-01", ext=True, title="Public Land Order"), candidate("8", "2025-02-01", docket=("E", ""), ext=True),
    ]
    pairs = chain.chain_pairs(spark.createDataFrame(rows, CANDIDATE))
    got = {(r.ocd_id, r.ocd_id_b): r.confident for r in pairs.collect()}
    assert got[("1", "2")] and not got[("1", "3")] and got[("1", "4")]
    assert ("1", "6") not in got and not any(b in ("5", "7", "8") or a == "8" for a, b in got)
    flags = {r.ocd_id_b: r.conflict_flags for r in chain.chain_conflicts(pairs.where("confident"), NOW).collect() if r.ocd_id == "1"}
    assert flags["4"][0] == "extension_chain_unresolved"


def test_adjudication_budget_and_cache(spark):
    pairs = spark.createDataFrame([("1", "a", "h1"), ("1", "b", "h1"), ("2", "a", "h2"), ("3", "a", "h3"), ("4", "a", "h4")], "ocd_id string, ocd_id_b string, content_hash string")
    cache = spark.createDataFrame([("h4", "p", "affirm", "", datetime(2026, 1, 1))], "content_hash string, adjudicator_id string, classification string, rationale string, created_at timestamp")

    def judge(row):
        if row["content_hash"] == "h2":
            raise ValueError("down")
        return "affirm", "because"

    out, new = chain.adjudicate(pairs, cache, chain.python_provider(judge), "p", NOW, budget=2)
    assert sorted((r.ocd_id, r.ocd_id_b, r.outcome) for r in out.collect()) == [("1", "a", "linked"), ("1", "b", "linked"), ("2", "a", "error"), ("3", "a", "deferred"), ("4", "a", "linked")]
    assert sorted(r.content_hash for r in new.collect()) == ["h1", "h4"]
    none, same = chain.adjudicate(pairs, cache, None, "p", NOW)
    assert {r.outcome for r in none.collect()} == {"ambiguous"} and same.count() == 1


def test_verdicts(spark):
    seen = "array<struct<observation_id: string, fetched_at: timestamp, is_extension: boolean, is_correction: boolean, is_withdrawal: boolean, is_reopening: boolean>>"
    t, later = datetime(2026, 1, 1), datetime(2026, 1, 9)
    o = lambda i, e=False, c=False, w=False, r=False: (i, later, e, c, w, r)
    cases = [([o("1", w=True)], t, ["1"]), ([o("1", e=True)], later, ["1"]), ([o("1", e=True)], t, []), ([o("2"), o("1")], later, ["1", "2"]), ([o("1", r=True)], later, []), ([o("1", e=True, r=True)], later, []), ([], later, []), ([o("1", c=True)], None, ["1"])]
    df = spark.createDataFrame([(i, s, t, cur) for i, (s, cur, _) in enumerate(cases)], f"i int, s {seen}, p timestamp, c timestamp")
    got = {r.i: r.x for r in df.select("i", verify.contradictions(F.col("s"), F.col("p"), F.col("c")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [x for _, _, x in cases]


def test_streamed_ingest_equals_batch(spark, tmp_path):
    schema = "k string, h string, t int"
    src, rows = str(tmp_path / "in"), [("k", "A", 1), ("k", "A", 2), ("k", "B", 3), ("k", "A", 4), ("m", "A", 5), ("m", "A", 6)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        heads = Snapshots(spark, f"{tmp_path}/heads", schema)
        run_cycles(spark.readStream.schema(schema).parquet(src), ingest_step(spark, f"{tmp_path}/log", heads, ["k"], "h", ["t"]), f"{tmp_path}/ckpt").awaitTermination(60)
    got = sorted((r.k, r.h, r.t) for r in spark.read.parquet(f"{tmp_path}/log").collect())
    assert got == [("k", "A", 1), ("k", "A", 4), ("k", "B", 3), ("m", "A", 5)]
    assert sorted((r.k, r.h, r.t) for r in heads.latest().collect()) == [("k", "A", 4), ("m", "A", 6)]
