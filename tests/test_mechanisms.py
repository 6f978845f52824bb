"""Segmented scans, interval join, sliding ranges, histograms and sketches, hash trees, one-pass names: each against brute force."""

import math
import random
import re
import time
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from claimledger.functions import scalars as S
from claimledger.operators import audit, chain, metrics, projection, reconcile, steps, verify
from claimledger.plans import jobs
from tests.test_jobs import LOG, primary, status

T0 = datetime(2026, 6, 1)


def test_replayed_projection_is_what_cycles_arrive_at(spark):
    rng = random.Random(7)
    rows = []
    for e in range(6):
        for i in range(14 if e else 40):
            at = T0 + timedelta(hours=rng.randrange(8))
            day = rng.choice(["2026-07-01", "2026-07-05", None])
            raw = primary(f"e{e}", day, docket_ids=[f"d{i % 3}"]) if rng.random() < 0.6 else status(f"X{e}", f"{day}T03:59:59Z" if day else None, withdrawn=rng.random() < 0.1)
            rows.append((f"e{e}", f"o{e}-{i}", reconcile.PRIMARY if "document_number" in raw else reconcile.STATUS, at, raw))
    rows += [(None, "n", reconcile.PRIMARY, T0, primary("x", None)), ("e1", "late", reconcile.PRIMARY, None, primary("e1", "2027-01-01"))]
    log = spark.createDataFrame(rows, LOG).repartition(5).cache()
    state = None
    for h in range(8):
        at = S.instant(T0 + timedelta(hours=h))
        part = log.where((F.col("fetched_at") <= at) & F.col("ocd_id").isNotNull())
        touched = part.where(F.col("fetched_at") == at).select("ocd_id").distinct()
        derived = reconcile.reconcile_log(part.join(touched, "ocd_id", "left_semi"), at).drop("version")
        if state is None:
            state = derived.limit(0).withColumn("version", F.lit(0)).withColumn("change_history", F.array().cast(projection.HISTORY))
        state = spark.createDataFrame((m := projection.merge_projection(state, derived, at)).collect(), m.schema)
    got = reconcile.replay_projection(log, S.instant(T0 + timedelta(hours=7)), blocks=7)
    columns = sorted(set(state.columns) - {"derived_at", "status"})
    pick = lambda df: sorted(str(r) for r in df.select(columns).collect())
    assert set(columns) <= set(got.columns) and pick(got) == pick(state) and max(r.version for r in state.collect()) > 2


def test_a_hot_entity_is_spread(spark):
    log = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("ok"))
    rows = projection.dealt(log, ["k"], ["t"], blocks=8)
    sizes = [r[1] for r in rows.groupBy("_block").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500
    scanned = projection.running(rows, ["k"], ["t"], sums={"s": F.col("t")}, lasts={"l": F.when(F.col("ok"), F.col("t"))})
    last, total = None, 0
    for r in scanned.orderBy("t").collect():
        total, last = total + r.t, r.t if r.ok else last
        assert (r.s, r.l) == (total, last)
    before = projection.previous(rows, ["k"], ["t"], F.struct("t"), "p").orderBy("t").collect()
    assert before[0].p is None and all(r.p.t == r.t - 1 for r in before[1:])
    run = longest = first = None
    run, longest = 0, 0
    for r in scanned.orderBy("t").collect():
        run = 0 if r.ok else run + 1
        longest = max(longest, run)
        first = r.t if first is None and run >= 5 else first
    one = projection.failure_runs(log, ["k"], ["t"], "ok").first()
    assert (one.attempts, one.longest_run, one.dead_lettered_at) == (run, longest, first)


def test_interval_keys_meet_once(spark):
    rng = random.Random(1)
    spans = [(rng.randrange(-50, 9000), rng.choice([-1, 0, 1, 5, 60, 200, 5000])) for _ in range(60)] + [(20_000, 45_536)]
    days = [rng.randrange(-100, 9300) for _ in range(80)] + [d for a, n in spans[:20] for d in (a - 1, a, a + n, a + n + 1)] + [20_000, 65_536, 65_537]
    a = spark.createDataFrame([(i, x, x + n) for i, (x, n) in enumerate(spans)], "i int, lo int, hi int").withColumn("node", F.explode(chain.interval_nodes(F.col("lo"), F.col("hi"))))
    b = spark.createDataFrame(list(enumerate(days)), "j int, day int").withColumn("node", F.explode(chain.day_nodes(F.col("day"))))
    got = sorted((r.i, r.j) for r in a.join(b, "node").select("i", "j").collect())
    assert got == sorted((i, j) for i, (x, n) in enumerate(spans) for j, d in enumerate(days) if x <= d <= x + n)
    assert a.groupBy("i").count().agg(F.max("count")).first()[0] <= 2 * chain.LEVELS + 12


CANDIDATE = "ocd_id string, fr_observation_id string, fr_document_number string, docket_ids array<string>, rins array<string>, is_extension boolean, is_correction boolean, is_withdrawal boolean, is_reopening boolean, title string, publication_date string, govinfo_url string, dates_text string, status string, resolved_close_utc timestamp"


def test_chain_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        day = date(2025, 1, 1) + timedelta(days=rng.randrange(400))
        close = datetime(day.year, day.month, day.day) + timedelta(days=rng.randrange(-5, 90)) if rng.random() < 0.9 else None
        flags = [rng.random() < 0.15 for _ in range(4)]
        rows.append((f"e{i}", f"o{i % 390}", f"N{i}", rng.sample(["hot", "b", "c", "", "d"], rng.randrange(4)), rng.sample(["r1", "r2", ""], rng.randrange(3)), *flags, "t", day.isoformat() if rng.random() < 0.95 else "bad", None, f"see N{rng.randrange(400)}.", rng.choice(["open", "closed", "closed"]), close))
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] or a[1] == b[1] or "bad" in (a[10], b[10]) or not any(b[5:9]) or not (set(a[3]) & set(b[3]) - {""}) or not b[10] > a[10]:
                continue
            if a[13] == "open" or (a[14] and a[14].date() + timedelta(days=60) >= date.fromisoformat(b[10])):
                want.add((a[0], b[0], bool(set(a[4]) & set(b[4]) - {""}) or re.search(rf"(?<![\w-]){a[2]}(?![\w-])", b[12]) is not None))
    got = {(r.ocd_id, r.ocd_id_b, r.confident) for r in chain.chain_pairs(spark.createDataFrame(rows, CANDIDATE)).select("ocd_id", "ocd_id_b", "confident").collect()}
    assert got == want and len(got) > 500


def test_latest_primary_of_equal_times(spark):
    flags = ", ".join(f"{f} boolean" for f in chain.FLAGS)
    rows = [("e", "o1", reconcile.PRIMARY, T0, primary("N1", None), *[False] * 4), ("e", "o2", reconcile.PRIMARY, T0, primary("N2", None), *[True] * 4), ("e", "o9", reconcile.PRIMARY, None, primary("N9", None), *[False] * 4), ("e", "o9", reconcile.STATUS, T0, status("X", None), *[False] * 4)]
    log = spark.createDataFrame(rows, f"{LOG}, {flags}")
    got = chain.chain_candidates(log, reconcile.reconcile_log(log, S.instant(T0))).collect()
    assert [(r.fr_observation_id, r.fr_document_number, r.is_extension) for r in got] == [("o2", "N2", True)]


def test_a_changed_title_asks_anew(spark):
    base = [("a", "o1", "N1", ["D"], ["R1"], *[False] * 4, "first", "2026-01-01", None, "x", "open", None), ("b", "o2", "N2", ["D"], ["R2"], True, *[False] * 3, "second", "2026-02-01", None, "y", "open", None)]

    def hashed(change=None, rulebook="1", at=9):
        rows = [tuple(change if k == at and change and i == 1 else v for k, v in enumerate(r)) for i, r in enumerate(base)]
        return chain.adjudication_input(chain.chain_pairs(spark.createDataFrame(rows, CANDIDATE)), rulebook).first()

    one = hashed()
    assert one.content_hash == hashed().content_hash == hashed("o77", at=1).content_hash
    assert len({one.content_hash, hashed("other title").content_hash, hashed(rulebook="2").content_hash, hashed("2026-02-02", at=10).content_hash, hashed("z", at=12).content_hash}) == 5
    assert one.input.asDict() == {"kind": "chain", "rulebook_version": "1", "a_title": "first", "a_dates_text": "x", "a_publication_date": "2026-01-01", "b_title": "second", "b_dates_text": "y", "b_publication_date": "2026-02-01", "shared_docket": True, "shared_rin": False, "explicit_reference": False}


def test_a_cache_that_holds_a_hash_twice(spark):
    pairs = spark.createDataFrame([("a", "b", "h1"), ("a", "c", "h1"), ("a", "d", "h2")], "ocd_id string, ocd_id_b string, content_hash string")
    cache = spark.createDataFrame([("h1", "p", "affirm", "", T0), ("h1", "p", "reject", "", T0 + timedelta(hours=1)), ("h1", "q", "reject", "", T0)], "content_hash string, adjudicator_id string, classification string, rationale string, created_at timestamp")
    out, after = chain.adjudicate(pairs, cache, chain.python_provider(lambda r: ("reject", "")), "p", S.instant(T0))
    assert sorted((r.ocd_id_b, r.outcome, r.cached) for r in out.collect()) == [("b", "linked", True), ("c", "linked", True), ("d", "not_linked", False)] and after.count() == 4


def test_broken_rows_are_not_merged(spark, monkeypatch):
    monkeypatch.setitem(reconcile.INVARIANTS, "conflicts", {"never_b": "ocd_id_b = 'e3'"})
    flags = ", ".join(f"{f} boolean" for f in chain.FLAGS)
    rows = [("e1", "o1", reconcile.PRIMARY, T0, primary("N1", "2026-07-01", docket_ids=["D"], regulation_id_numbers=["R"]), *[False] * 4)]
    rows += [(f"e{k}", f"o{k}", reconcile.PRIMARY, T0, primary(f"N{k}", "2026-07-09", docket_ids=["D"], regulation_id_numbers=["R"], publication_date=f"2026-05-2{k}"), True, *[False] * 3) for k in (2, 3)]
    log = spark.createDataFrame(rows, f"{LOG}, {flags}")
    proj = reconcile.reconcile_log(log, S.instant(T0))
    cache = spark.createDataFrame([], "content_hash string, adjudicator_id string, classification string, rationale string, created_at timestamp")
    out = chain.chain_cycle(log, proj, reconcile.conflict_rows(proj, S.instant(T0)), cache, None, "p", S.instant(T0))
    assert [(r.ocd_id, r.ocd_id_b) for r in out["conflicts"].collect()] == [("e1", "e2")] and {r.ocd_id for r in out["broken"].collect()} == {"e1", "e2"}
    one = out["counts"].first()
    assert (one.candidates, one.amendments, one.linked, one.ambiguous, one.broken, one.live, one.cache_hits) == (3, 2, 3, 0, 2, 1, 0)


FIXTURE = "meta struct<ocd_id: string>, input struct<publishedCloseUtc: timestamp, currentCloseUtc: timestamp, currentStatus: string, observationsSinceClose: " + verify.SINCE + ", lapsed: boolean>, expected struct<was_correct: boolean, basis: string, contradicting_observation_ids: array<string>>"
#: Three verdicts that were reached on real windows.
GOLDEN = [
    ("2026-10963", "2026-07-03T03:59:59", "open", "2026-07-03T23:59:16.511", False, True, "post_close_repoll"),
    ("2026-13603", "2026-07-07T03:59:59", "closed", "2026-07-07T07:52:25.798", False, True, "post_close_repoll"),
    ("regs:09000064b934bc24", "2026-06-30T03:59:59", "closed", "2026-07-04T00:15:18.653", True, None, "unverified_lapsed"),
]


def test_fixtures_on_every_field(spark):
    t = datetime.fromisoformat
    rows = [((i,), (t(close), t(close), state, [("o", t(seen), False, False, False, False)], lapsed), (right, basis, [])) for i, close, state, seen, lapsed, right, basis in GOLDEN]
    assert verify.replay_fixtures(spark.createDataFrame(rows, FIXTURE)).count() == 0
    gone = [("o2", T0, False, False, True, False), ("o1", T0, False, False, True, False)]
    broken = {
        "basis": ((T0, T0, "open", [], False), (True, "manual", [])), "lapsed": ((T0, T0, "open", [], True), (True, "post_close_repoll", [])),
        "missed": ((T0, T0, "open", gone, False), (True, "post_close_repoll", [])), "ids": ((T0, T0, "open", gone, False), (False, "late_amendment", ["o1"])),
        "invariant": ((T0, T0, "open", [], True), (None, "unverified_lapsed", ["o1"])), "good": ((T0, T0, "open", gone, False), (False, "late_amendment", ["o2", "o1"])),
    }
    got = {r.meta.ocd_id: r.differs for r in verify.replay_fixtures(spark.createDataFrame([((k,), *v) for k, v in broken.items()], FIXTURE)).collect()}
    assert got == {"basis": ["basis"], "lapsed": ["was_correct", "basis"], "missed": ["was_correct", "basis", "contradicting_observation_ids"], "ids": ["contradicting_observation_ids"], "invariant": ["contradicting_observation_ids", "invariant"]}


def test_exported_fixtures_replay(spark):
    records = spark.createDataFrame([("e", 0, "high", T0, "d", True, "post_close_repoll", [], T0, T0)], "ocd_id string, window_version int, confidence_at_close string, published_close_utc timestamp, published_close_display string, was_correct boolean, basis string, contradicting_observation_ids array<string>, closed_at_utc timestamp, verified_at_utc timestamp")
    watches, windows = records.select("ocd_id", "window_version", F.lit(T0).alias("snapshotted_at")), spark.createDataFrame([("e", T0, "open", "F", "X")], "ocd_id string, resolved_close_utc timestamp, status string, fr_document_number string, regs_document_id string")
    since = spark.createDataFrame([], "ocd_id string, window_version int, since " + verify.SINCE)
    out = jobs.regression_fixtures(records, watches, windows, since, spark.createDataFrame([("X", T0)], "regs_document_id string, last_checked_at timestamp"))
    one = out.first()
    assert (one.meta.last_checked_at, one.meta.regs_document_id, one.input.lapsed, one.input.observationsSinceClose) == (T0, "X", False, []) and verify.replay_fixtures(out).count() == 0


def test_instants_with_a_space(spark):
    rows = [("2026-06-17 03:59:59Z", True), ("2026-06-17T03:59:59Z", True), ("2026-06-17 03:59:59+02:00", True), ("2026-06-17 03:59", True), ("2026-02-30 03:59:59Z", False), ("2026-06-17  03:59:59Z", False), ("2026-06-17_03:59:59Z", False)]
    df = spark.createDataFrame(rows, "t string, ok boolean")
    assert df.where(S.utc_instant(F.col("t")).isNotNull() != F.col("ok")).count() == 0
    assert df.limit(1).select(S.utc_instant(F.col("t")).cast("string").alias("x"), S.has_offset(F.col("t")).alias("o")).first() == ("2026-06-17 03:59:59", True)


def brute_rate(samples, end, width):
    """(increase, n) over (end - width, end], as the query language's documentation states it; samples: (seconds, value) in order."""
    inside = [(t, v) for t, v in samples if end - width < t <= end]
    if len(inside) < 2 or inside[-1][0] == inside[0][0]:
        return None
    up = sum(v if v < before else v - before for (_, before), (_, v) in zip(inside, inside[1:], strict=False))
    between = inside[-1][0] - inside[0][0]
    mean = between / (len(inside) - 1)
    head, tail = inside[0][0] - (end - width), end - inside[-1][0]
    head, tail = mean / 2 if head >= 1.1 * mean else head, mean / 2 if tail >= 1.1 * mean else tail
    if up > 0 and inside[0][1] >= 0:
        head = min(head, between * inside[0][1] / up)
    return up * (between + head + tail) / between, len(inside)


def test_sliding_increases(spark):
    rng = random.Random(9)
    series = {}
    for k in "abc":
        t, v, rows = 0.0, 0.0, []
        while t < 3 * 3600:
            t += rng.choice([15, 60, 60, 300, 300, 2000 if k == "c" else 60])
            v = rng.random() * 3 if rng.random() < 0.05 else v + rng.choice([0, 1, 5.5])
            rows.append((t, v))
        series[k] = rows
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=t), v, i) for k, rows in series.items() for i, (t, v) in enumerate(rows)], "k string, at timestamp, v double, i int")
    got = {(r.k, (r.at - T0).total_seconds()): (r.increase, r.n_samples) for r in metrics.sliding_increases(df, ["k"], "at", "v", "i").collect()}
    want = {(k, end): x for k, rows in series.items() for end in range(300, 5 * 3600, 300) if (x := brute_rate(rows, end, 3600))}
    assert got.keys() == want.keys() and len(want) > 80
    assert all(math.isclose(got[x][0], want[x][0], rel_tol=1e-9, abs_tol=1e-9) and got[x][1] == want[x][1] for x in want)
    with pytest.raises(ValueError):
        metrics.sliding_increases(df, ["k"], "at", "v", "i", "1 hour", "7 minutes")


def test_histograms(spark):
    rows = [("a", "0.1", 10), ("a", "0.5", 20), ("a", "1", 19), ("a", "+Inf", 40), ("b", "1", 5), ("b", "2", 5), ("c", "+Inf", 3), ("d", "1", 0), ("d", "+Inf", 0), ("e", "-1", 4), ("e", "+Inf", 5), (None, "1", 1), (None, "+Inf", 1)]
    df = spark.createDataFrame(rows, "k string, le string, n long")
    at = lambda q: {r.k: r.quantile for r in metrics.histogram_quantile(df, ["k"], "le", "n", q).collect()}
    assert at(0.99) == {"a": 1.0, "b": None, "c": None, "d": None, "e": -1.0, None: pytest.approx(0.99)}
    assert at(0.25)["a"] == pytest.approx(0.1) and at(0.375)["a"] == pytest.approx(0.3) and at(0.5)["e"] == -1.0
    own = spark.createDataFrame([("x", 1.0, 5), ("x", 2.0, 3), ("x", float("inf"), 2)], "k string, le double, n long")
    assert metrics.bucket_quantile(own, ["k"], "le", "n", 0.95).first().quantile == 2.0


def test_sketches_keep_their_bound(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("day"), (F.col("id") % 24).alias("hour"), (F.pmod(F.xxhash64("id"), F.lit(1000003)) / 1000).alias("v"))
    merged = metrics.merged_sketches(metrics.sketches(df, ["day", "hour"], "v"), ["day"])
    for q in (0.05, 0.5, 0.95):
        ranks = metrics.sketch_quantile(merged, q).join(df.select("day", "v"), "day").groupBy("day").agg((F.count_if(F.col("v") <= F.col("quantile")) / F.count("*")).alias("r"), F.max("n").alias("n")).collect()
        assert len(ranks) == 3 and all(abs(r.r - q) <= metrics.rank_error() and r.n == 20_000 for r in ranks)


def test_hash_trees(spark):
    before = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 != 0, (F.col("id") % 13).cast("string")).alias("v"), F.lit(None).cast("string").alias("w"))
    same = before.repartition(7).orderBy(F.rand(3))
    assert audit.snapshot_changes(before, same, ["k"]).count() == 0
    after = same.where("k NOT IN (10, 11)").withColumn("v", F.when(F.col("k") == 20, "new").otherwise(F.col("v"))).withColumn("w", F.when(F.col("k") == 22, F.col("v"))).withColumn("v", F.when(F.col("k") == 22, None).otherwise(F.col("v")))
    after = after.unionByName(before.where("k = 30")).unionByName(before.where("k = 1").withColumn("k", F.lit(9000).cast("long")))
    ranges = audit.differing_ranges(audit.hash_tree(before, ["k"]), audit.hash_tree(after, ["k"])).count()
    assert 0 < ranges <= 6
    got = {r.k: r.change for r in audit.snapshot_changes(before, after, ["k"]).collect()}
    assert got == {10: "missing", 11: "missing", 20: "changed", 22: "changed", 30: "added", 9000: "added"}
    top = lambda df: audit.hash_tree(df, ["k"]).where("level = 0").first()
    assert top(before) == top(same) and top(before).n == 5000


def test_names_in_one_pass(spark):
    names = ["Virginia", "West Virginia", "New York", "York", "New", "A.B", "A"]
    texts = ["West Virginia and New York", "NewYork New", "A.B A", "aWest Virginia_", None, "", "York New York", "A.Bc AxB"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in df.select(S.names_in(F.col("t"), names).alias("w"), S.names_in(F.col("t"), names, whole_words=False).alias("s")).collect()]
    word = r"[A-Za-z0-9_]"
    assert [g[0] for g in got] == [[n for n in names if t and re.search(rf"(?<!{word}){re.escape(n)}(?!{word})", t)] for t in texts]
    assert [g[1] for g in got] == [[n for n in names if t and n in t] for t in texts]
    assert [r[0] for r in df.limit(1).select(S.keywords_of(F.lit("b c"), F.lit("A b"), ["a", "b", "c"])).collect()] == [["b", "c", "a"]]
    assert df.select(S.names_in(F.col("t"), [])).first()[0] == []


def test_many_names_cost_what_few_do(spark):
    rng = random.Random(1)
    many = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(6, 11))) for _ in range(5000)})
    df = spark.range(6000).select(F.concat_ws(" ", *[F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256), 1, 8) for i in range(30)]).alias("t")).cache()
    df.count()

    def seconds(names):
        q = df.select(F.sum(F.size(S.names_in(F.col("t"), names))))
        q.collect()
        began = time.perf_counter()
        q.collect()
        return time.perf_counter() - began

    few, lots = seconds(many[:50]), seconds(many)
    assert lots < 4 * few + 1.5


def test_chain_links_move_no_pairs(spark):
    """Each docket row is shuffled once for both sides and pairs never are; crowded dockets give the same links."""
    rng, rows = random.Random(5), []
    odd = ["a", "a\nb", "a\\nb", "a\\", "b", "c", "", None]
    for i in range(300):
        day = date(2025, 1, 1) + timedelta(days=rng.randrange(200))
        flags = [rng.random() < 0.2 for _ in range(4)]
        rows.append((f"e{i}", f"o{i % 290}", f"N{i}", rng.sample(odd, 3), rng.sample(odd, 2), *flags, "t", day.isoformat(), None, rng.choice([None, f"see N{rng.randrange(300)}."]), rng.choice(["open", "closed"]), datetime(day.year, day.month, day.day)))
    want = set()
    for a in rows:
        for b in rows:
            near = b[10] > a[10] and (a[13] == "open" or (date.fromisoformat(b[10]) - date.fromisoformat(a[10])).days <= 60)
            if near and a[0] != b[0] and a[1] != b[1] and any(b[5:9]) and (set(a[3]) & set(b[3]) - {"", None}):
                want.add((a[0], b[0], bool(set(a[4]) & set(b[4]) - {"", None}) or b[12] == f"see {a[2]}."))
    df = spark.createDataFrame(rows, CANDIDATE)
    for crowd in (0, 100, 10_000):
        got = [tuple(r) for r in chain.chain_links(df, crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 500
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        execution = chain.chain_links(df)._jdf.queryExecution()
        execution.toRdd().count()
        plan = execution.executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [x for x in plan.splitlines() if "hashpartitioning" in x]
    assert len([x for x in shuffles if "ReusedExchange" not in x]) == 1 and all("_docket" in x for x in shuffles)


def _candidates(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = date(2025, 1, 1) + timedelta(days=rng.randrange(200))
        flags = [rng.random() < 0.2 for _ in range(4)]
        rows.append((f"e{i}", f"o{i}", f"N{i}", rng.sample("abcdefghij", 3), rng.sample("rstuvw", 2), *flags, "t", day.isoformat(), None, rng.choice([None, f"see N{rng.randrange(n)}."]), rng.choice(["open", "closed"]), datetime(day.year, day.month, day.day)))
    return rows


def _shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f.getName() for f in (lambda files: [files.apply(i) for i in range(files.size())])(disk.getAllFiles()) if f.getName().startswith("shuffle_")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before, mine = _shuffle_files(spark), spark.conf.get(steps.CLEANUP, None)
    one = steps.stored(spark.range(2000).repartition(3, "id"))
    parts = steps.stored_parts(spark.range(k, k + 10).repartition(2, "id") for k in (0, 10, 20))
    late = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < late:
        time.sleep(0.2)
    assert not left and spark.conf.get(steps.CLEANUP, None) == mine
    assert one.count() == 2000 and sorted(r.id for r in parts.collect()) == list(range(30))


def test_chain_links_in_turns(spark):
    """Links stored in turns are the links; entities and docket rows are gone when they are there, the links with the job's scope."""
    df, shared = spark.createDataFrame(_candidates(300, 8), CANDIDATE), Path(spark.conf.get("spark.checkpoint.dir"))
    want = sorted(tuple(r) for r in chain.chain_links(df).collect())
    old = set(shared.iterdir())
    with steps.scope(spark):
        for k, turns in enumerate((None, 1, 5)):
            assert sorted(tuple(r) for r in chain.stored_links(df, crowd=(1024, 0, 20)[k], turns=turns).collect()) == want and len(want) > 2000
            assert len(set(shared.iterdir()) - old) == k + 1
    assert set(shared.iterdir()) == old


def test_stored_pairs_are_not_stored_again(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    links = chain.stored_links(spark.createDataFrame(_candidates(300, 9), CANDIDATE))
    pairs = links.select("ocd_id", "ocd_id_b", F.substring("ocd_id_b", -1, 1).alias("content_hash"))
    cache = spark.createDataFrame([("3", "p", "affirm", "", T0)], "content_hash string, adjudicator_id string, classification string, rationale string, created_at timestamp")
    judge, old = chain.python_provider(lambda r: ("reject" if r["content_hash"] == "4" else "affirm", "")), set(shared.iterdir())
    kept, _ = chain.adjudicate(pairs, cache, judge, "p", S.instant(T0), budget=3, kept=True)
    assert max(spark.read.parquet(str(f)).count() for f in set(shared.iterdir()) - old) <= 1000 < links.count() // 2
    again, _ = chain.adjudicate(pairs, cache, judge, "p", S.instant(T0), budget=3)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, again.collect()))


def test_first_hashes_behind_many_pairs_of_one(spark):
    """The hashes that are asked are the first ones, however many pairs come before theirs, and only some pairs are sorted."""
    rng = random.Random(6)
    rows = [(f"{i:04}", rng.choice("xy"), "hot" if i < 300 else rng.choice(["warm", f"h{i % 40}", None])) for i in range(700)]
    pairs = spark.createDataFrame(rows, "ocd_id string, ocd_id_b string, content_hash string").repartition(5)
    firsts = {}
    for a, b, h in rows:
        firsts.setdefault(h, (a, b))
    for n, most in ((0, 10), (1, 10), (7, 1), (30, 16), (100, 1000)):
        got = chain._first_asked(pairs, ("ocd_id", "ocd_id_b"), n, most).collect()
        assert sorted((r.content_hash or "", tuple(r._first), (r._row.ocd_id, r._row.ocd_id_b)) for r in got) == sorted((h or "", p, p) for h, p in list(firsts.items())[:n])


def test_documents_are_parsed_once(spark, sf):
    """A filter over derived columns must not write the parsing out again."""
    from claimledger.plans.queries import QUERIES

    for name, most in (("r11_fields", 2), ("u5_dockets", 2), ("s7_status_observations", 2), ("s6_primary_observations", 1)):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= len(re.findall(r"(?i)parse_?json", plan)) <= most, name


def test_dealt_rows_are_read_once(spark):
    """Finding the ranges must not run the reading of the rows as well."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    df = spark.range(1000).repartition(4)
    rows = projection.dealt(df, ["id"], ["id"], 4, lambda r: r.withColumn("read", counted("id")))
    assert rows.where("read = id").count() == 1000 and calls.value == 1000
    assert [r["n"] for r in rows.groupBy("_block").agg(F.min("id").alias("lo"), F.count("*").alias("n"), F.max("id").alias("hi")).where("hi - lo + 1 = n").collect()] and rows.select("_block").distinct().count() == 4


def test_post_close_of_crowded_entities(spark):
    """An entity of very many observations is joined by its watches, with the same result."""
    watches = spark.createDataFrame([("a", 0, T0), ("b", 0, T0), ("c", 1, T0)], "ocd_id string, window_version int, published_close_utc timestamp")
    seen = [("elsewhere", f"x{i}", i) for i in range(500)] + [("a", f"a{i}", i) for i in range(-5, 40)] + [("b", "b1", 1)]
    rows = [(e, e, o, T0 + timedelta(days=d), d % 2 == 0, False, False, False) for e, o, d in seen]
    linked = spark.createDataFrame(rows, "entity string, ocd_id string, observation_id string, fetched_at timestamp, is_extension boolean, is_correction boolean, is_withdrawal boolean, is_reopening boolean")
    for crowd in (0, 10, 10_000):
        got = {r.ocd_id: (r.window_version, {(s.observation_id, s.is_extension) for s in r.since}, r.observed_at) for r in verify.post_close(watches, linked, crowd).collect()}
        assert got == {"a": (0, {(f"a{i}", i % 2 == 0) for i in range(1, 40)}, T0 + timedelta(days=39)), "b": (0, {("b1", False)}, T0 + timedelta(days=1)), "c": (1, set(), None)}


def test_tree_query_deals_rows_by_the_session(spark, sf):
    """No fixed number of partitions, which would grow with the table."""
    from claimledger.plans.queries import QUERIES

    assert "Repartition" in (plan := QUERIES["a20_trees"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()) and "], 8" not in plan
