"""Queries of whole jobs, parsers, merges and scalars on the driver tables; ``queries`` imports this module last."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimledger.functions import rules as R
from claimledger.functions import scalars as S
from claimledger.operators import audit, chain, crosscheck, ledger, metrics, projection, reconcile, serve, verify
from claimledger.plans import jobs
from claimledger.plans.queries import MID, NOW, STAMP, c, query, table, text
from claimledger.sources import files

k_text = lambda name: c(name).cast("string")


def json_object(**fields):
    """JSON text of an object; null fields are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


# ---- claims and parsers ---------------------------------------------------------------------------


@query("w1_latest_claims", """
WITH e AS (SELECT user_id, event_type IN ('click', 'view') AS a, date_trunc('day', ts) AS day, 'o' || event_id AS id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, a ORDER BY day DESC, id) AS n FROM e)
SELECT user_id, max(id) FILTER (a) AS a_id, max(id) FILTER (NOT a) AS b_id FROM r WHERE n = 1 GROUP BY 1""")  # fmt: skip
def w1(spark, sf):
    log = table(spark, sf, "events").select(
        c("user_id").alias("ocd_id"), F.when(c("event_type").isin("click", "view"), reconcile.PRIMARY).otherwise(reconcile.STATUS).alias("source"),
        F.date_trunc("day", "ts").alias("fetched_at"), F.concat(F.lit("o"), "event_id").alias("observation_id"))
    return reconcile.latest_claims(log).select(c("ocd_id").alias("user_id"), c("a.observation_id").alias("a_id"), c("b.observation_id").alias("b_id"))


@query("s5_list_rows", "SELECT CAST(o_custkey AS VARCHAR) AS k, max(strftime(o_orderdate, '%Y-%m-%d')) AS day FROM orders GROUP BY 1")
def s5(spark, sf):
    rows = table(spark, sf, "orders").select((F.floor(c("o_orderkey") / 100) + 2000).cast("int").alias("page"), F.struct(k_text("o_custkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).alias("r"))
    return files.list_rows(rows.groupBy("page").agg(F.collect_list("r").alias("results")), "results", "k", "day")


@query("i5_truncated", "SELECT (SELECT count(*) FROM orders WHERE o_orderkey // 100 = (SELECT max(o_orderkey // 100) FROM orders)) >= 100 AS truncated")
def i5(spark, sf):
    rows = table(spark, sf, "orders").select(F.floor(c("o_orderkey") / 100).alias("page"), "o_orderkey")
    return files.truncated(rows.groupBy("page").agg(F.collect_list("o_orderkey").alias("results")), "results", 1, 100)


def _primary_raw(spark, sf):
    """Primary documents of the orders: some no JSON, some without a number."""
    k = c("o_orderkey")
    title = F.when(k % 4 == 0, "Extension of time").when(k % 4 == 1, "Withdrawal of notice").when(k % 4 == 2, "Hearing").otherwise("Reopened and corrected")
    doc = json_object(document_number=F.when(k % 11 != 0, F.concat(F.lit("D-"), k)), title=title, type=F.lit("Notice"), action=F.when(k % 5 == 0, "Correction"), comments_close_on=F.date_format("o_orderdate", "yyyy-MM-dd"), dates=F.lit("x"))
    return table(spark, sf, "orders").select("o_orderkey", F.when(k % 13 == 0, "{not json").otherwise(doc).alias("raw"), S.instant(NOW).alias("fetched_at"))


PRIMARY_SQL = """
WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'not JSON' WHEN o_orderkey % 11 = 0 THEN 'no document number' END AS error FROM orders)
"""


@query("s6_primary_observations", PRIMARY_SQL + """
SELECT k, 'ocd-participation-window/federal/D-' || k AS ocd_id, k % 4 = 0 AS ext, k % 5 = 0 OR k % 4 = 3 AS cor, k % 4 = 1 AS wit, k % 4 = 3 AS reo FROM p WHERE error IS NULL""")  # fmt: skip
def s6(spark, sf):
    good, _ = files.primary_observations(_primary_raw(spark, sf), "v1")
    return good.select(c("o_orderkey").alias("k"), "ocd_id", c("is_extension").alias("ext"), c("is_correction").alias("cor"), c("is_withdrawal").alias("wit"), c("is_reopening").alias("reo"))


@query("s6_rejects", PRIMARY_SQL + "SELECT k, error FROM p WHERE error IS NOT NULL")
def s6_rejects(spark, sf):
    return files.primary_observations(_primary_raw(spark, sf), "v1")[1].select(c("o_orderkey").alias("k"), "error")


def _status_raw(rows, key: str, end):
    """Status documents by ``key``: ids, a number for two in three, some withdrawn, some without an id."""
    k = c(key)
    number, obj = F.when(k % 3 != 0, F.concat(F.lit("D-"), k)), F.concat(F.lit("obj"), k)
    attributes = F.struct(number.alias("frDocNum"), obj.alias("objectId"), end.alias("commentEndDate"), (k % 2 == 0).alias("openForComment"), F.when(k % 9 == 0, F.lit(True)).alias("withdrawn"), F.lit("Proposed rule").alias("title"), F.lit("Notice").alias("documentType"))
    return F.to_json(F.struct(F.struct(F.when(k % 17 != 0, k.cast("string")).alias("id"), attributes.alias("attributes")).alias("data")))


@query("s7_status_observations", """
SELECT o_orderkey AS k, o_orderkey % 17 = 0 AS rejected, CASE WHEN o_orderkey % 17 <> 0 THEN 'ocd-participation-window/federal/' || CASE WHEN o_orderkey % 3 <> 0 THEN 'D-' || o_orderkey ELSE 'regs:obj' || o_orderkey END END AS ocd_id,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 9 = 0 END AS withdrawal FROM orders""")  # fmt: skip
def s7(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", _status_raw(None, "o_orderkey", F.lit(None).cast("string")).alias("raw"), S.instant(NOW).alias("fetched_at"))
    good, bad = files.status_observations(raw, "v1")
    one = good.select(c("o_orderkey").alias("k"), F.lit(False).alias("rejected"), "ocd_id", c("is_withdrawal").alias("withdrawal"))
    return one.unionByName(bad.select(c("o_orderkey").alias("k"), F.lit(True).alias("rejected"), F.lit(None).cast("string").alias("ocd_id"), F.lit(None).cast("boolean").alias("withdrawal")))


def _log(spark, sf):
    """A log of primary documents: an event is an observation of its user's document, its value names the close."""
    day = F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), F.floor(c("value") / 100).cast("int")), "yyyy-MM-dd")
    raw = json_object(document_number=F.concat(F.lit("D-"), "user_id"), comments_close_on=day, publication_date=F.lit("2024-01-01"), docket_ids=F.array((c("user_id") % 7).cast("string"), (c("user_id") % 11).cast("string")), regulation_id_numbers=F.array((c("user_id") % 3).cast("string")))
    return table(spark, sf, "events").select(k_text("user_id").alias("ocd_id"), F.concat(F.lit("o"), "event_id").alias("observation_id"), F.lit(reconcile.PRIMARY).alias("source"), c("ts").alias("fetched_at"), raw.alias("raw"))


@query("t4_replay_log", """
WITH s AS (SELECT user_id, ts, min_by(CAST(floor(value / 100) AS INTEGER), 'o' || event_id) AS d FROM events GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER w AS n, lag(d) OVER w AS p FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT user_id, list(d ORDER BY n) AS ds FROM l WHERE n = 1 OR d <> p GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS ocd_id, CAST(len(ds) - 1 AS INTEGER) AS version,
  strftime(((CAST(DATE '2024-03-01' + ds[len(ds)] AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59 seconds') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS close FROM h""")  # fmt: skip
def t4_replay_log(spark, sf):
    return reconcile.replay_log(_log(spark, sf), S.instant(NOW)).select("ocd_id", "version", text("resolved_close_utc", "close"))


@query("r11_fields", """
WITH l AS (SELECT user_id, arg_max(event_id, ts) AS e FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS ocd_id, 'o' || e AS a_id, 'D-' || user_id AS fr_document_number, array_to_string(list_distinct([CAST(user_id % 7 AS VARCHAR), CAST(user_id % 11 AS VARCHAR)]), '') <> '' AS has_docket,
  CAST(user_id % 3 AS VARCHAR) AS rin, 'https://www.govinfo.gov/content/pkg/FR-2024-01-01/html/D-' || user_id || '.htm' AS url, 'comment' AS window_type, 0 AS version,
  'closes ' || strftime(DATE '2024-03-01' + CAST(floor(value / 100) AS INTEGER), '%Y-%m-%d') || ' at 11:59 p.m. ET (inferred from FR date-only value)' AS shown
FROM l JOIN events USING (user_id) WHERE event_id = e""")  # fmt: skip
def r11(spark, sf):
    good, _ = reconcile.checked(reconcile.reconcile_log(_log(spark, sf), S.instant(NOW)))
    return good.select("ocd_id", "a_id", "fr_document_number", (F.size("docket_id") > 0).alias("has_docket"), "rin", c("govinfo_url").alias("url"), "window_type", "version", c("resolved_close_display").alias("shown"))


@query("u5_dockets", "SELECT CAST(user_id AS VARCHAR) AS ocd_id, CASE WHEN user_id % 7 = user_id % 11 THEN CAST(user_id % 7 AS VARCHAR) ELSE (user_id % 7) || ',' || (user_id % 11) END AS dockets FROM (SELECT DISTINCT user_id FROM events)")
def u5(spark, sf):
    return reconcile.reconcile_log(_log(spark, sf), S.instant(NOW)).select("ocd_id", F.array_join("docket_id", ",").alias("dockets"))


# ---- cycles and merges ----------------------------------------------------------------------------


def _cycle(spark, sf):
    """A status cycle over the users of the events: some fetches fail, some are dead letters, half the payloads are known."""
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id")
    feed = ev.select(k_text("user_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), c("event_id").alias("seq"))
    users = ev.select("user_id").distinct()
    end = F.date_format(F.date_add(F.lit("2024-03-01").cast("date"), (c("user_id") % 50).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    docs = users.select("user_id", k_text("user_id").alias("id"), _status_raw(None, "user_id", end).alias("raw"))
    details = docs.where(c("user_id") % 19 != 0).select("id", F.when(c("user_id") % 23 != 0, c("raw")).alias("raw"), S.instant(MID).alias("fetched_at"), F.when(c("user_id") % 7 == 0, "timeout").alias("error"))
    known, _ = files.status_observations(docs.where(c("user_id") % 2 == 0).select("raw", S.instant("2024-01-02 00:00:00").alias("fetched_at")), "v1")
    log = known.withColumn("observation_id", F.concat(F.lit("old"), "regs_document_id"))
    at = S.instant("2024-01-01 00:00:00")
    failures = users.where((c("user_id") % 5 == 0) | (c("user_id") % 13 == 0)).select(
        F.lit(reconcile.STATUS).alias("source"), k_text("user_id").alias("document_key"), F.when(c("user_id") % 13 == 0, 5).otherwise(4).alias("attempts"), at.alias("first_failed_at"), at.alias("last_failed_at"),
        F.lit("e").alias("last_error"), F.when(c("user_id") % 13 == 0, at).alias("dead_lettered_at"), F.lit(None).cast("timestamp").alias("last_retry_at"))
    before = reconcile.reconcile_log(log, at)
    state = {
        "log": log, "projection": before.drop("version").withColumn("version", F.lit(0)).withColumn("change_history", F.array().cast(projection.HISTORY)), "conflicts": reconcile.conflict_rows(before, at),
        "cursors": spark.createDataFrame([], "source string, cursor_last_modified timestamp, last_polled_at timestamp"), "stamps": spark.createDataFrame([], "regs_document_id string, last_checked_at timestamp"), "failures": failures,
    }
    return jobs.status_cycle(state, feed, details, S.instant(NOW), "v1")


CYCLE_SQL = """
WITH u AS (SELECT user_id, arg_max(event_id, (strftime(ts, '%Y-%m-%d %H:%M:%S'), -event_id)) AS seq, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS date FROM events GROUP BY 1),
s AS (SELECT *, user_id % 13 = 0 AS dead, user_id % 19 = 0 OR user_id % 23 = 0 OR user_id % 7 = 0 OR user_id % 17 = 0 AS bad, user_id % 5 = 0 AS was_failing FROM u)
"""


@query("i1_status_cycle", CYCLE_SQL + """
SELECT count(*) AS listed, count(*) FILTER (NOT dead AND NOT bad AND user_id % 2 <> 0) AS ingested, count(*) FILTER (NOT dead AND bad) AS failed, count(*) FILTER (NOT dead AND bad AND was_failing) AS dead_lettered,
  count(*) FILTER (NOT dead AND NOT bad AND was_failing) AS recovered, count(*) FILTER (NOT dead AND NOT bad AND user_id % 2 = 0) AS deduped, count(*) FILTER (dead) AS skipped_dead,
  (SELECT max(date) FROM s WHERE NOT dead AND (date, CAST(user_id AS VARCHAR)) < (SELECT min((date, CAST(user_id AS VARCHAR))) FROM s WHERE NOT dead AND bad)) AS cursor FROM s""")  # fmt: skip
def i1(spark, sf):
    return _cycle(spark, sf)[1].select("listed", "ingested", "failed", "dead_lettered", "recovered", "deduped", "skipped_dead", "cursor")


@query("i1_stamps", CYCLE_SQL + "SELECT CAST(user_id AS VARCHAR) AS id FROM s WHERE NOT dead AND NOT bad")
def i1_stamps(spark, sf):
    return _cycle(spark, sf)[0]["stamps"].select(c("regs_document_id").alias("id"))


@query("i1_failures", CYCLE_SQL + """
SELECT CAST(user_id AS VARCHAR) AS id, CAST(CASE WHEN dead THEN 5 WHEN bad AND was_failing THEN 5 WHEN bad THEN 1 END AS INTEGER) AS attempts, dead OR (bad AND was_failing) AS is_dead
FROM s WHERE dead OR bad""")  # fmt: skip
def i1_failures(spark, sf):
    return _cycle(spark, sf)[0]["failures"].select(c("document_key").alias("id"), "attempts", c("dead_lettered_at").isNotNull().alias("is_dead"))


@query("i6_batch", "SELECT count(*) AS eligible, least(count(*), 200) AS taken, greatest(count(*) - 200, 0) AS deferred FROM customer")
def i6_batch(spark, sf):
    rows = table(spark, sf, "customer").select(k_text("c_custkey").alias("regs_document_id"), F.lit(None).cast("timestamp").alias("last_checked_at"))
    return jobs.repoll_batch(rows, -5)[1].select(*[c(x).cast("long").alias(x) for x in ("eligible", "taken", "deferred")])


@query("t2_new_targets", "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS observation_id, CAST(l_orderkey AS VARCHAR) AS ocd_id FROM lineitem WHERE l_orderkey % 6 <> 0 AND l_linenumber > 1 EXCEPT SELECT CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 1")
def t2(spark, sf):
    rows = table(spark, sf, "lineitem").select(k_text("l_partkey").alias("observation_id"), F.when(c("l_orderkey") % 6 != 0, k_text("l_orderkey")).alias("ocd_id"), "l_linenumber")
    first = table(spark, sf, "lineitem").where("l_linenumber = 1").select(k_text("l_partkey").alias("observation_id"), k_text("l_orderkey").alias("ocd_id"))
    return ledger.new_targets(first, rows.where("l_linenumber > 1"))


def _errors(events, when):
    return events.where((c("event_type") == "error") & when).select(k_text("user_id").alias("ocd_id")).distinct().select(
        "ocd_id", F.lit("a").alias("observation_a_id"), F.lit("b").alias("observation_b_id"), F.array(F.lit("f")).alias("conflict_flags"), S.instant(MID).alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"), F.lit("cross_source").alias("conflict_scope"), F.lit(None).cast("string").alias("ocd_id_b"))


@query("t6_touched_only", f"""
WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '{MID}'), b AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '{MID}' AND value > 150)
SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS ocd_id, b.k IS NULL AND a.k % 3 = 0 AS retired FROM a FULL JOIN b ON a.k = b.k""")  # fmt: skip
def t6(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "ts", "value")
    old, new = _errors(ev, c("ts") < S.instant(MID)), _errors(ev, (c("ts") >= S.instant(MID)) & (c("value") > 150))
    touched = ev.where("user_id % 3 = 0").select(k_text("user_id").alias("ocd_id"))
    return projection.merge_conflicts(old, new, S.instant(NOW), "cross_source", touched).select("ocd_id", c("resolved_at").isNotNull().alias("retired"))


def _failures(spark, sf):
    errors = table(spark, sf, "events").where("event_type = 'error'")
    rows = errors.groupBy(k_text("user_id").alias("document_key")).agg(F.count("*").cast("int").alias("attempts"), F.min("ts").alias("first_failed_at"), F.max("ts").alias("last_failed_at"))
    return rows.select(F.lit("x").alias("source"), "document_key", "attempts", "first_failed_at", "last_failed_at", F.lit("e").alias("last_error"), F.when(c("attempts") >= 15, c("last_failed_at")).alias("dead_lettered_at"), F.lit(None).cast("timestamp").alias("last_retry_at"))


FAILURES_SQL = "WITH f AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1)\n"


@query("t11_recovered", FAILURES_SQL + "SELECT CAST(user_id AS VARCHAR) AS document_key FROM f WHERE user_id % 4 = 0")
def t11(spark, sf):
    done = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.lit("x").alias("source"), k_text("c_custkey").alias("document_key"))
    return projection.clear_failures(_failures(spark, sf), done)[1].select("document_key")


@query("t12_slow_retry", FAILURES_SQL + "SELECT CAST(user_id AS VARCHAR) AS document_key, CAST(n + CASE WHEN n >= 15 AND user_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempts, n >= 15 AND user_id % 2 = 0 AS retried, false AS newly_dead FROM f")
def t12(spark, sf):
    rows = _failures(spark, sf)
    failed = jobs.dead_due(rows, S.instant("2030-01-01 00:00:00")).where(c("document_key").cast("long") % 2 == 0).select("source", "document_key", F.lit("again").alias("error"))
    return projection.merge_failures(rows, failed, S.instant(NOW), 15, retry=True).select("document_key", "attempts", c("last_retry_at").isNotNull().alias("retried"), "newly_dead")


@query("i7_dead_due", FAILURES_SQL + f"SELECT CAST(user_id AS VARCHAR) AS document_key FROM f WHERE n >= 15 AND last < TIMESTAMP '{MID}' + INTERVAL 14 DAY")
def i7(spark, sf):
    return jobs.dead_due(_failures(spark, sf), S.instant(MID) + F.expr("INTERVAL 14 DAYS")).select("document_key")


@query("i8_dead_keys", FAILURES_SQL + "SELECT CAST(user_id AS VARCHAR) AS document_key FROM f WHERE n >= 15")
def i8(spark, sf):
    return jobs.dead_keys(_failures(spark, sf), "x")


@query("t15_insert_absent", "SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) GROUP BY 1")
def t15(spark, sf):
    there = table(spark, sf, "customer").where("c_acctbal > 3000").select(c("c_custkey").alias("k"))
    return ledger.insert_absent(there, table(spark, sf, "orders").select(c("o_custkey").alias("k"), c("o_orderkey").alias("o")), ["k"], "o")


def _rederived(spark, sf):
    log = table(spark, sf, "events").select("event_id", (c("value") > 100).alias("is_big"), (c("user_id") % 2 == 0).alias("is_even"), F.lit("v1").alias("parser_version"), "value", "user_id")
    return ledger.rederive_flags(log, {"is_big": c("value") > 150, "is_even": c("user_id") % 2 == 0}, "v2")


@query("c4_rederived", "SELECT event_id, value > 150 AS is_big, CASE WHEN value > 100 AND value <= 150 THEN 'v2' ELSE 'v1' END AS parser_version FROM events")
def c4(spark, sf):
    return _rederived(spark, sf)[0].select("event_id", "is_big", "parser_version")


@query("c4_counts", "SELECT count(*) AS scanned, count(*) FILTER (value > 100 AND value <= 150) AS updated, count(*) FILTER (NOT (value > 100 AND value <= 150)) AS skipped FROM events")
def c4_counts(spark, sf):
    return _rederived(spark, sf)[1].withColumn("skipped", c("scanned") - c("updated"))


# ---- verification ---------------------------------------------------------------------------------


def _verification(spark, sf):
    """Windows and watches of the orders, shipments as observations (part of them by a bridge), stamps of some."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    k = c("o_orderkey")
    windows = o.where(k % 29 != 0).select(
        k_text("o_orderkey").alias("ocd_id"), F.lit(0).alias("version"), F.lit("high").alias("confidence"), F.when(k % 8 != 0, c("o_orderdate")).alias("resolved_close_utc"), F.lit("").alias("resolved_close_display"),
        F.when(k % 10 == 0, "withdrawn").otherwise("closed").alias("status"), k_text("o_orderkey").alias("regs_document_id"))
    watches = o.where(k % 3 == 0).select(
        k_text("o_orderkey").alias("ocd_id"), F.lit(0).alias("window_version"), F.lit("high").alias("confidence_at_close"), F.when(k % 31 != 0, c("o_orderdate")).alias("published_close_utc"),
        F.lit("").alias("published_close_display"), c("o_orderdate").alias("snapshotted_at"))
    records = verify.verdicts(watches.limit(0).withColumn("since", F.lit(None).cast(verify.SINCE)).withColumn("current_close_utc", c("published_close_utc")).withColumn("state", F.lit("x")), S.instant(NOW))
    done = watches.where(c("ocd_id").cast("long") % 6 == 0)
    records = records.unionByName(done.select("ocd_id", "window_version", "confidence_at_close", "published_close_utc", "published_close_display", F.lit(True).alias("was_correct"), F.lit("manual").alias("basis"), F.array().cast("array<string>").alias("contradicting_observation_ids"), c("snapshotted_at").alias("closed_at_utc"), S.instant(NOW).alias("verified_at_utc")))
    lines = table(spark, sf, "lineitem")
    by_bridge = c("l_linenumber") == 2
    obs = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("observation_id"), F.when(by_bridge, "elsewhere").otherwise(k_text("l_orderkey")).alias("ocd_id"), c("l_shipdate").alias("fetched_at"), F.lit(False).alias("is_extension"),
        F.lit(False).alias("is_correction"), (c("l_returnflag") == "R").alias("is_withdrawal"), F.lit(False).alias("is_reopening"))
    bridge = lines.where(by_bridge).select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("observation_id"), k_text("l_orderkey").alias("ocd_id"))
    stamps = o.where(k % 4 == 1).select(k_text("o_orderkey").alias("regs_document_id"), (c("o_orderdate") + F.expr("INTERVAL 9 DAYS")).alias("last_checked_at"))
    return verify.verification_run(windows, watches, records, obs, bridge, stamps, S.instant(NOW))


VERIFICATION_SQL = f"""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders), l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_shipdate AS TIMESTAMP) AS t, l_returnflag = 'R' AS gone FROM lineitem),
g AS (SELECT k, max(t) AS t FROM l WHERE gone GROUP BY 1),
w AS (SELECT k, d AS pub, d AS snap FROM o WHERE k % 3 = 0 AND k % 31 <> 0),
f AS (SELECT o.k, d AS pub, TIMESTAMP '{NOW}' AS snap FROM o LEFT JOIN g ON g.k = o.k WHERE o.k % 29 <> 0 AND o.k % 8 <> 0 AND d <= TIMESTAMP '{NOW}' AND (o.k % 10 <> 0 OR g.t > d)
  AND NOT (o.k % 3 = 0 AND o.k % 6 <> 0) AND NOT (o.k % 6 = 0)),
a AS (SELECT * FROM w WHERE k % 6 <> 0 AND k % 29 <> 0 UNION ALL SELECT * FROM f),
s AS (SELECT a.k, max(l.t) AS seen, count(l.k) FILTER (gone) AS n_gone, count(l.k) AS n FROM a LEFT JOIN l ON l.k = a.k AND l.t > a.pub GROUP BY 1),
v AS (SELECT a.*, n, n_gone, CASE WHEN a.k % 8 <> 0 THEN pub END AS cur, greatest(seen, CASE WHEN a.k % 4 = 1 THEN pub + INTERVAL 9 DAY END) AS checked FROM a JOIN s USING (k)),
st AS (SELECT *, CASE WHEN snap > pub + INTERVAL 14 DAY THEN 'lapsed' WHEN TIMESTAMP '{NOW}' <= pub + INTERVAL 7 DAY THEN 'no' WHEN checked > pub THEN 'verdict' WHEN TIMESTAMP '{NOW}' <= pub + INTERVAL 14 DAY THEN 'no' ELSE 'lapsed' END AS state FROM v),
r AS (SELECT k, CASE WHEN state = 'lapsed' THEN 'unverified_lapsed' WHEN n_gone > 0 OR (cur IS NULL AND n > 0) THEN 'late_amendment' ELSE 'post_close_repoll' END AS basis FROM st WHERE state <> 'no')
"""


@query("e1_snapshots", VERIFICATION_SQL + "SELECT CAST(k AS VARCHAR) AS ocd_id FROM f")
def e1(spark, sf):
    return _verification(spark, sf)["watches"].where(c("snapshotted_at") == S.instant(NOW)).select("ocd_id")


@query("e2_verification_run", VERIFICATION_SQL + "SELECT CAST(k AS VARCHAR) AS ocd_id, basis FROM r")
def e2(spark, sf):
    return _verification(spark, sf)["new"].select("ocd_id", "basis")


@query("e7_set_aside", """
SELECT CAST(o_orderkey AS VARCHAR) AS ocd_id, CASE WHEN o_orderkey % 29 = 0 THEN 'no window' ELSE 'no published close' END AS error FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 AND (o_orderkey % 29 = 0 OR o_orderkey % 31 = 0)""")  # fmt: skip
def e7(spark, sf):
    return _verification(spark, sf)["set_aside"].select("ocd_id", "error")


@query("e8_summary", VERIFICATION_SQL + "SELECT basis, CASE WHEN basis = 'unverified_lapsed' THEN NULL ELSE basis = 'post_close_repoll' END AS was_correct, count(*) AS n FROM r GROUP BY 1, 2")
def e8(spark, sf):
    return _verification(spark, sf)["summary"]


# ---- read models ----------------------------------------------------------------------------------


def _moved(spark, sf):
    """Windows of the customers: the last close by their orders, the earlier ones as history."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(c("o_orderdate").alias("d"), c("o_orderkey").alias("o")))).alias("h"))
    step = lambda x, i: F.struct(i.cast("int").alias("version"), x["d"].alias("resolved_close_utc"), F.array(x["o"].cast("string")).alias("observation_ids"), x["d"].alias("changed_at"))
    earlier = F.transform(F.slice("h", F.lit(1), F.size("h") - 1), step)
    return o.select(
        k_text("o_custkey").alias("ocd_id"), F.element_at("h", -1)["d"].alias("resolved_close_utc"), earlier.alias("change_history"), F.when(c("o_custkey") % 5 == 0, "conflicting").otherwise("high").alias("confidence"),
        F.when(c("o_custkey") % 2 == 0, "open").otherwise("closed").alias("status"), F.element_at("h", -1)["d"].alias("derived_at"))


MOVED_SQL = "WITH h AS (SELECT o_custkey AS k, list(o_orderdate ORDER BY o_orderdate, o_orderkey) AS ds, max(o_orderdate) AS close FROM orders GROUP BY 1)\n"


@query("p5_lookup", MOVED_SQL + "SELECT CAST(k AS VARCHAR) AS ocd_id, strftime(close, '%Y-%m-%d') AS close FROM h WHERE k = 85")
def p5(spark, sf):
    return serve.window(_moved(spark, sf), "85").select("ocd_id", F.date_format("resolved_close_utc", "yyyy-MM-dd").alias("close"))


@query("p7_conflict_feed", "SELECT CAST(l_orderkey AS VARCHAR) AS ocd_id, CAST(l_suppkey AS VARCHAR) AS ocd_id_b FROM lineitem WHERE l_linenumber % 2 = 1 AND (l_orderkey = 17 OR l_suppkey = 17)")
def p7(spark, sf):
    rows = table(spark, sf, "lineitem").select(k_text("l_orderkey").alias("ocd_id"), k_text("l_suppkey").alias("ocd_id_b"), F.when(c("l_linenumber") % 2 == 0, S.instant(NOW)).alias("resolved_at"))
    return serve.conflict_feed(rows, "17").select("ocd_id", "ocd_id_b").unionByName(serve.conflict_feed(rows, "").select("ocd_id", "ocd_id_b"))


@query("p12_clamped_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def p12(spark, sf):
    return serve.page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [c("o_orderdate").desc(), c("o_orderkey")], 5000, -3).select("o_orderkey")


@query("p13_changed", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01 06:00:00'")
def p13(spark, sf):
    return jobs.changed_set(table(spark, sf, "orders"), "o_orderdate", S.instant(NOW)).select("o_orderkey")


@query("p13_keywords", "SELECT o_orderkey FROM orders WHERE (contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderpriority), 'urgent')) AND CAST(o_orderdate AS DATE) >= DATE '1997-06-01' - 120")
def p13_keywords(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return jobs.keyword_set(rows, "o_orderpriority", "day", S.instant(NOW), ["High", "URGENT"]).select("o_orderkey")


@query("p13_report", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1996-01-01' AND '1996-03-31' AND o_orderstatus IN ('O', 'P')")
def p13_report(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return jobs.report_set(rows, "day", "o_orderstatus", "1996-01-01", "1996-03-31", ["O", "P"]).select("o_orderkey")


@query("o6_lists", MOVED_SQL + """
, a AS (SELECT 'all' AS list, k FROM h ORDER BY close, CAST(k AS VARCHAR) LIMIT 400), b AS (SELECT 'moved' AS list, k FROM h WHERE len(ds) > 1 ORDER BY close, CAST(k AS VARCHAR) LIMIT 30),
c AS (SELECT 'clash' AS list, k FROM h WHERE k % 5 = 0 ORDER BY close DESC, CAST(k AS VARCHAR) LIMIT 12)
SELECT list, CAST(k AS VARCHAR) AS ocd_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")  # fmt: skip
def o6(spark, sf):
    parts = serve.dashboard_lists(_moved(spark, sf))
    a, b, d = (p.select(F.lit(n).alias("list"), "ocd_id") for p, n in zip(parts, ("all", "moved", "clash"), strict=True))
    return a.unionByName(b).unionByName(d)


@query("o7_exhibit", MOVED_SQL + "SELECT CAST(k AS VARCHAR) AS ocd_id FROM h WHERE len(ds) > 1 ORDER BY k % 5 <> 0, close, CAST(k AS VARCHAR) LIMIT 1")
def o7(spark, sf):
    moved = _moved(spark, sf).where(S.moved_count(c("change_history")) > 0)
    return serve.pick_exhibit(moved, c("confidence") == "conflicting", [c("resolved_close_utc"), c("ocd_id")]).select("ocd_id")


@query("w7_last_change", MOVED_SQL + "SELECT CAST(k AS VARCHAR) AS ocd_id, strftime(ds[len(ds) - 1], '%Y-%m-%d') AS old_close, CAST(len(ds) - 1 AS INTEGER) AS n_moved FROM h")
def w7(spark, sf):
    rows = serve.last_change(_moved(spark, sf))
    return rows.select("ocd_id", F.date_format("old_close", "yyyy-MM-dd").alias("old_close"), S.moved_count(c("change_history")).cast("int").alias("n_moved"))


@query("w8_ranks", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rank FROM lineitem")
def w8_ranks(spark, sf):
    return serve.ranks(table(spark, sf, "lineitem"), ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rank")


@query("a9_all_counters", MOVED_SQL + f"""
SELECT count(*) AS n_windows, count(*) FILTER (k % 2 = 0) AS n_open, count(*) FILTER (k % 2 = 0 AND close BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 30 DAY) AS n_soon, count(*) FILTER (k % 5 <> 0) AS n_high,
  count(*) FILTER (k % 5 = 0) AS n_conflicting, count(*) FILTER (len(ds) > 1) AS n_moved, 0 AS n_without_close, (SELECT count(*) FROM events) AS n_observations, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS latest,
  (SELECT count(DISTINCT event_type) FROM events) + 1 AS n_agencies, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS n_live_conflicts FROM h""")  # fmt: skip
def a9_all(spark, sf):
    obs = table(spark, sf, "events").select(c("ts").alias("fetched_at"), "event_type")
    conflicts = table(spark, sf, "customer").select(F.when(c("c_acctbal") <= 0, S.instant(NOW)).alias("resolved_at"))
    return serve.counters(_moved(spark, sf), obs, conflicts, F.array("event_type", F.lit("all")), S.instant(NOW)).withColumn("latest", F.date_format("latest", STAMP))


# ---- differential, evaluation, metrics ------------------------------------------------------------


@query("x3_triage", """
WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'agree' ELSE 'date_mismatch' END AS category, CASE o_orderkey % 3 WHEN 0 THEN 'ours' WHEN 1 THEN 'odd' END AS triage FROM orders WHERE o_orderkey % 4 < 2)
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'agree' ELSE 'date_mismatch' END AS category, CASE WHEN o_orderkey % 4 = 1 AND triage = 'ours' THEN 'ours' END AS triage, coalesce(o_orderkey % 4 = 1 AND triage = 'odd', false) AS warned FROM orders LEFT JOIN t ON t.k = o_orderkey""")  # fmt: skip
def x3(spark, sf):
    k = c("o_orderkey")
    found = table(spark, sf, "orders").select(k.alias("k"), F.when(k % 2 == 0, "agree").otherwise("date_mismatch").alias("category"))
    old = found.where("k % 4 < 2").select("k", "category", F.when(c("k") % 3 == 0, "ours").when(c("k") % 3 == 1, "odd").alias("triage"), F.lit("n").alias("note"))
    return crosscheck.carry_triage(found, old, "k", ["ours"])[0].select("k", "category", "triage", c("triage_warning").alias("warned"))


@query("u4_dropped_triage", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 < 2 AND NOT (o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0)")
def u4(spark, sf):
    k = c("o_orderkey")
    found = table(spark, sf, "orders").select(k.alias("k"), F.when(k % 5 == 0, "agree").otherwise("date_mismatch").alias("category"))
    old = table(spark, sf, "orders").where("o_orderkey % 4 < 2").select(k.alias("k"), F.when(k % 2 == 0, "agree").otherwise("date_mismatch").alias("category"), F.lit("ours").alias("triage"), F.lit("n").alias("note"))
    return crosscheck.carry_triage(found, old, "k", ["ours"])[1].select("k")


@query("x5_verdict", "SELECT n, rate, CASE WHEN rate >= 60 THEN 'go' ELSE 'no-go' END AS verdict FROM (SELECT count(*) AS n, round(100.0 * count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2)) / count(*), 1) AS rate FROM orders)")
def x5(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_linenumber > 2").select(c("l_orderkey").alias("o_orderkey"))
    return crosscheck.enough(crosscheck.join_rate(table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey"), "rate").select("n", "rate", "verdict")


@query("x6_samples", """
SELECT event_id FROM (SELECT event_id, CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS DATE) AS ny, CAST(ts AS DATE) AS utc FROM events) WHERE ny <> utc ORDER BY event_id LIMIT 25""")  # fmt: skip
def x6(spark, sf):
    rows = table(spark, sf, "events").select("event_id", S.new_york_date(c("ts")).alias("day"), "ts")
    return crosscheck.zone_samples(rows, "day", "ts", [c("event_id")], 25).select("event_id")


@query("x7_owned_keywords", """
SELECT doc_id, lang, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'the') THEN 'the' ELSE 'de' END AS keyword FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'the') OR contains(lower(text), 'de')""")  # fmt: skip
def x7(spark, sf):
    return crosscheck.owned_keywords(table(spark, sf, "documents").select("doc_id", "lang", "text"), c("text"), ["license", "the", "de"], "lang", "doc_id")


@query("a7_freshness", "SELECT count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM events")
def a7(spark, sf):
    return crosscheck.freshness(table(spark, sf, "events").select("ts"), "ts").withColumn("latest", F.date_format("latest", STAMP))


@query("a12_summary", """
WITH q AS (SELECT unnest(generate_series(TIMESTAMP '1996-07-01', TIMESTAMP '1998-04-01', INTERVAL 3 MONTH)) AS s), d AS (SELECT s, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f FROM q LEFT JOIN orders
  ON o_orderdate >= s AND CAST(o_orderdate AS DATE) <= least(s + INTERVAL 3 MONTH - INTERVAL 1 DAY, TIMESTAMP '1998-05-20') GROUP BY s)
SELECT count(*) AS n_quarters, CAST(sum(o + f) AS BIGINT) AS total, avg(o + f) AS average, round(100.0 * sum(o) / sum(o + f), 1) AS "O_share", round(100.0 * sum(f) / sum(o + f), 1) AS "F_share", CASE WHEN avg(o + f) >= 100 THEN 'dense' ELSE 'sparse' END AS verdict FROM d""")  # fmt: skip
def a12_summary(spark, sf):
    rows = crosscheck.density(table(spark, sf, "orders").select("o_orderdate", "o_orderstatus"), "o_orderdate", "o_orderstatus", F.lit("1998-05-20").cast("date"), 8, ("O", "F"))
    return crosscheck.density_summary(rows, ("O", "F"), 100.0)


def _cache(spark, sf):
    kind = F.when(c("user_id") % 3 == 0, "chain").when(c("user_id") % 3 == 1, "notice").otherwise("other")
    verdict = F.when(c("event_type") == "click", "affirm").when(c("event_type") == "view", "reject").when(c("event_type") == "error", "broken").otherwise("uncertain")
    return table(spark, sf, "events").select((c("event_id") % 400).cast("string").alias("content_hash"), F.when(c("event_id") % 2 == 0, "null:abstain@1").otherwise("real:m@1").alias("adjudicator_id"), kind.alias("kind"), verdict.alias("classification"), "event_id", c("event_id").alias("created_at"))


DATASET_SQL = """
WITH e AS (SELECT event_id % 400 AS h, event_id AS e, CASE user_id % 3 WHEN 0 THEN 'chain' WHEN 1 THEN 'notice' ELSE 'other' END AS kind, CASE event_type WHEN 'click' THEN 'affirm' WHEN 'view' THEN 'reject' WHEN 'error' THEN 'broken' ELSE 'uncertain' END AS cl FROM events WHERE event_id % 2 <> 0),
f AS (SELECT * FROM e WHERE kind <> 'other' AND cl <> 'broken' QUALIFY row_number() OVER (PARTITION BY h ORDER BY e) = 1),
s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY kind, cl ORDER BY e) <= 10)
"""


@query("a13_dataset", DATASET_SQL + "SELECT e AS event_id, kind, cl AS classification FROM s")
def a13_dataset(spark, sf):
    return chain.dataset_items(_cache(spark, sf), ["chain", "notice"], 10)[0].select("event_id", "kind", "classification")


@query("a13_grid", DATASET_SQL + "SELECT k.x AS kind, c.x AS classification, count(s.e) AS n FROM (VALUES ('chain'), ('notice'), ('empty')) k(x) CROSS JOIN (VALUES ('affirm'), ('reject'), ('uncertain')) c(x) LEFT JOIN s ON s.kind = k.x AND s.cl = c.x GROUP BY 1, 2")
def a13_grid(spark, sf):
    return chain.dataset_items(_cache(spark, sf), ["chain", "notice", "empty"], 10)[1]


@query("a15_exact", "SELECT DISTINCT round((SELECT count(*) FROM labels WHERE quality = toxic) / (SELECT count(*) FROM labels), 6) AS exact")
def a15_exact(spark, sf):
    return chain.confusion(table(spark, sf, "labels"), "quality", "toxic", ["0", "1", "2"]).select(F.round("exact", 6).alias("exact")).distinct()


def _increase(spark, sf, some):
    return metrics.increases(table(spark, sf, "events").where(some).select("user_id", "ts", "value", "event_id"), ["user_id"], "ts", "value", "event_id", "1 day")


INCREASE_SQL = """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, event_type = 'error' AS bad, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lag(CASE WHEN event_type = 'error' THEN value END) OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS q FROM events),
w AS (SELECT user_id, day, sum(CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END) AS whole FROM d GROUP BY 1, 2),
b AS (SELECT user_id, day, sum(CASE WHEN q IS NULL THEN 0 WHEN value < q THEN value ELSE value - q END) AS part FROM d WHERE bad GROUP BY 1, 2)
"""


@query("m3_increase_ratio", INCREASE_SQL + "SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN whole > 0 THEN coalesce(part, 0) / whole END, 6) AS ratio FROM w LEFT JOIN b USING (user_id, day)")
def m3_increase(spark, sf):
    rows = metrics.increase_ratio(_increase(spark, sf, "event_type = 'error'"), _increase(spark, sf, "true"), ["user_id"])
    return rows.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.round("ratio", 6).alias("ratio"))


@query("m5_alert", INCREASE_SQL + "SELECT user_id, strftime(day, '%Y-%m-%d') AS day, part > 200 AS firing FROM b")
def m5(spark, sf):
    return metrics.increase_alert(_increase(spark, sf, "event_type = 'error'"), 200.0).select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "firing")


@query("m5_missing", INCREASE_SQL + "SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(greatest(whole - coalesce(part, 0), 0), 4) AS errors FROM w LEFT JOIN b USING (user_id, day)")
def m5_missing(spark, sf):
    rows = metrics.missing_successes(_increase(spark, sf, "true"), _increase(spark, sf, "event_type = 'error'"), ["user_id"])
    return rows.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.round("errors", 4).alias("errors"))


@query("m7_log_lines", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE contains(props, '7')")
def m7(spark, sf):
    return metrics.log_lines(table(spark, sf, "events").select("event_id", "props"), "props", "7", "k bigint").select("event_id", c("fields.k").alias("k"))


@query("m8_outcomes", "SELECT user_id % 5 AS source, 'ok' AS outcome, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS value FROM events GROUP BY 1 UNION ALL SELECT user_id % 5, 'failed', CAST(count(*) FILTER (event_type = 'error') AS BIGINT) FROM events GROUP BY 1")
def m8(spark, sf):
    cycles = table(spark, sf, "events").groupBy((c("user_id") % 5).alias("source"), F.to_date("ts").alias("day")).agg(F.count_if(c("event_type") != "error").alias("ok"), F.count_if(c("event_type") == "error").alias("failed"))
    return metrics.summary_outcomes(cycles, "source", ["ok", "failed"])


# ---- scalars --------------------------------------------------------------------------------------


@query("f1_canonical", "SELECT count(DISTINCT json_extract(props, '$.k')) AS n, true AS alike FROM events")
def f1(spark, sf):
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf, "events").select(S.canonical_hash(F.format_string('{"k":%s,"a":1}', k)).alias("x"), S.canonical_hash(F.format_string('{ "a" : 1, "k" : %s }', k)).alias("y"))
    return rows.agg(F.count_distinct("x").alias("n"), F.bool_and(c("x") == c("y")).alias("alike"))


@query("f2_content_hash", "SELECT count(*) AS n FROM (SELECT DISTINCT event_type, user_id % 3 FROM events)")
def f2(spark, sf):
    fields = {"b": c("event_type"), "a": F.when(c("user_id") % 3 != 0, (c("user_id") % 3).cast("string"))}
    return table(spark, sf, "events").agg(F.count_distinct(S.content_hash(fields)).alias("n"))


def _stamps(spark, sf):
    """Instants as text: with and without offset, some of days that do not exist."""
    k, day = c("o_orderkey"), F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((c("o_custkey") % 40).cast("string"), 2, "0"))
    return table(spark, sf, "orders").select("o_orderkey", F.concat(day, F.when(k % 4 == 0, "T10:00:00Z").when(k % 4 == 1, "T22:30:00-05:00").when(k % 4 == 2, "").otherwise("T10:00:00")).alias("s"))


STAMPS_SQL = """
WITH s AS (SELECT o_orderkey, o_orderkey % 4 AS m, try_cast(strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') AS TIMESTAMP) AS d FROM orders)
"""


@query("f6_instants", STAMPS_SQL + "SELECT o_orderkey, strftime(d + CASE m WHEN 0 THEN INTERVAL 10 HOUR WHEN 1 THEN INTERVAL '27 hours 30 minutes' WHEN 2 THEN INTERVAL 0 HOUR ELSE INTERVAL 10 HOUR END, '%Y-%m-%d %H:%M:%S') AS t FROM s")
def f6(spark, sf):
    return _stamps(spark, sf).select("o_orderkey", text(S.utc_instant(c("s")), "t"))


@query("f9_offsets", "SELECT o_orderkey, o_orderkey % 4 < 2 AS ok FROM orders")
def f9(spark, sf):
    return _stamps(spark, sf).select("o_orderkey", S.has_offset(c("s")).alias("ok"))


@query("f10_new_york", """
SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS wall, strftime(CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) - 3, '%Y-%m-%d') AS earlier,
  strftime(((ts - INTERVAL 6 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS lower FROM events""")  # fmt: skip
def f10(spark, sf):
    return table(spark, sf, "events").select("event_id", S.eastern_text(c("ts")).alias("wall"), S.days_ago(c("ts"), 3).cast("string").alias("earlier"), S.eastern_text(S.lower_bound(c("ts"))).alias("lower"))


@query("f12_texts", """
SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 AND o_custkey % 4 > 0 THEN 'https://www.govinfo.gov/content/pkg/FR-' || strftime(o_orderdate, '%Y-%m-%d') || '/html/D' || o_orderkey || '.htm' END AS url,
  'closes ' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' at 11:59 p.m. ET (inferred from FR date-only value)' ELSE ' (per Regulations.gov)' END AS shown FROM orders""")  # fmt: skip
def f12(spark, sf):
    day = F.to_date("o_orderdate")
    url = S.reliance_url(F.when(c("o_custkey") % 3 > 0, day.cast("string")), F.when(c("o_custkey") % 4 > 0, F.concat(F.lit("D"), "o_orderkey")).otherwise(""))
    return table(spark, sf, "orders").select("o_orderkey", url.alias("url"), F.when(c("o_orderkey") % 2 == 0, S.close_display(day)).otherwise(S.close_display(day, inferred=False)).alias("shown"))


@query("f14_equality", "SELECT o_orderkey, a IS NOT DISTINCT FROM b AS same_close, coalesce(a = b, false) AS same_instant FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_orderdate END AS a, CASE WHEN o_custkey % 2 > 0 THEN o_orderdate END AS b FROM orders)")
def f14(spark, sf):
    a, b = F.when(c("o_custkey") % 3 > 0, c("o_orderdate")), F.when(c("o_custkey") % 2 > 0, c("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", S.same_close(a, b).alias("same_close"), S.same_instant(a, b).alias("same_instant"))


@query("f15_lists", "SELECT p_partkey, array_to_string(list_filter([trim(p_name), trim('  '), trim(p_brand || ' ')], lambda x: x <> ''), '|') AS items, trim(p_name) AS one FROM part")
def f15(spark, sf):
    items = S.clean_list(F.array(F.concat(F.lit(" "), "p_name"), F.lit("  "), F.concat("p_brand", F.lit(" "))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(items, "|").alias("items"), S.first_or_null(items).alias("one"))


@query("f16_references", "SELECT o_orderkey, o_orderkey % 5 IN (0, 1) AS found FROM orders")
def f16(spark, sf):
    k = c("o_orderkey")
    said = F.when(k % 5 == 0, F.concat(F.lit("see FR 2024-"), k, F.lit("."))).when(k % 5 == 1, F.concat(F.lit("as 2024- "), k, F.lit(" says"))).when(k % 5 == 2, F.concat(F.lit("x2024-"), k)).when(k % 5 == 3, F.concat(F.lit("2024-"), k, F.lit("1")))
    return table(spark, sf, "orders").select("o_orderkey", S.references(said, F.concat(F.lit("2024-"), k)).alias("found"))


@query("f21_states", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ohio' WHEN 1 THEN 'New York,Virginia' WHEN 2 THEN 'Virginia,West Virginia' ELSE '' END AS states FROM part")
def f21(spark, sf):
    k = c("p_partkey")
    title = F.concat("p_name", F.when(k % 4 == 0, ", Ohio").when(k % 4 == 1, " New York; Virginia").when(k % 4 == 2, " West Virginia").otherwise(" Ohioan"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.states_in(title), ",").alias("states"))


@query("f22_buckets", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'EIS' WHEN 1 THEN 'Rulemaking' WHEN 2 THEN 'EIS' END AS bucket FROM part")
def f22(spark, sf):
    k = c("p_partkey")
    kind = F.when(k % 4 == 1, "Proposed Rule").otherwise("Notice")
    title = F.when(k % 4 == 0, "Draft Environmental Impact Statement").when(k % 4 == 1, "EIS").when(k % 4 == 2, "An EIS.").otherwise("Weiss")
    return table(spark, sf, "part").select("p_partkey", S.topic_bucket(kind, title).alias("bucket"))


@query("f25_names", "SELECT p_partkey, p_name || ' / ' || p_brand AS names, p_name AS first, left(repeat('x', p_size * 20), 300) AS head, left(p_name, 3) AS err FROM part")
def f25(spark, sf):
    names = F.to_json(F.array(F.struct(c("p_name").alias("name")), F.struct(c("p_brand").alias("name"))))
    return table(spark, sf, "part").select("p_partkey", S.names_joined(names).alias("names"), S.first_name(names).alias("first"), S.head(F.expr("repeat('x', p_size * 20)")).alias("head"), S.short_error(c("p_name"), 3).alias("err"))


@query("f27_days", f"""
SELECT o_orderkey, greatest(0, CAST(ceil((epoch(o_orderdate) - epoch(TIMESTAMP '{NOW}')) / 86400) AS BIGINT)) AS left_, CAST(round((epoch(o_orderdate) - epoch(TIMESTAMP '{NOW}')) / 86400 + 0.25) AS BIGINT) AS between_ FROM orders""")  # fmt: skip
def f27(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.days_left(c("o_orderdate"), S.instant(NOW)).alias("left_"), S.days_between(c("o_orderdate") + F.expr("INTERVAL 6 HOURS"), S.instant(NOW)).alias("between_"))


@query("f29_displays", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'closes 2024-01-01' ELSE strftime(CAST((o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE), '%Y-%m-%d') || ' · at noon' END AS shown FROM orders")
def f29(spark, sf):
    given = F.when(c("o_orderkey") % 2 == 0, "closes 2024-01-01").otherwise("at noon")
    return table(spark, sf, "orders").select("o_orderkey", S.display_with_date(given, c("o_orderdate")).alias("shown"))


@query("c3_denied", "SELECT p_partkey, p_partkey % 7 < 5 AS denied FROM part")
def c3(spark, sf):
    k = c("p_partkey")
    title = (
        F.when(k % 7 == 0, "Public Land Order No. 5").when(k % 7 == 1, "Land-withdrawal in force").when(k % 7 == 2, "Withdrawal of certain public lands").when(k % 7 == 3, "National Forest; partial withdrawal")
        .when(k % 7 == 5, "Extension of the comment period")
    )
    return table(spark, sf, "part").select("p_partkey", R.is_denied(title, F.when(k % 7 == 4, "Notice of proposed withdrawal")).alias("denied"))


@query("c2_haystacks", "SELECT p_partkey, p_partkey % 3 = 0 AS extension FROM part")
def c2(spark, sf):
    hay = R.primary_haystack(c("p_name"), F.lit(None).cast("string"), F.when(c("p_partkey") % 3 == 0, "EXTENDED").otherwise("extensions"))
    return table(spark, sf, "part").select("p_partkey", R.notice_flags(hay)["extension"].alias("extension"))


# ---- chains ---------------------------------------------------------------------------------------


@query("l1_candidates", """
WITH l AS (SELECT user_id, arg_max(event_id, ts) AS e FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS ocd_id, 'o' || e AS fr_observation_id, 'D-' || user_id AS fr_document_number, CAST(user_id % 3 AS VARCHAR) AS rins, event_type = 'view' AS is_extension FROM l JOIN events USING (user_id) WHERE event_id = e""")  # fmt: skip
def l1(spark, sf):
    flags = table(spark, sf, "events").select(F.concat(F.lit("o"), "event_id").alias("observation_id"), (c("event_type") == "view").alias("is_extension"), *[F.lit(False).alias(f"is_{f}") for f in ("correction", "withdrawal", "reopening")])
    log = _log(spark, sf).join(flags, "observation_id")
    out = chain.chain_candidates(log, reconcile.reconcile_log(log, S.instant(NOW)))
    return out.select("ocd_id", "fr_observation_id", "fr_document_number", F.array_join("rins", ",").alias("rins"), "is_extension")


# ---- texts, timelines and audits ------------------------------------------------------------------


@query("f18_hints", """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'likely PRA/info-collection extension (not a docket comment deadline)' WHEN 1 THEN 'likely land-withdrawal FP (not a comment deadline)'
  WHEN 2 THEN 'likely approval/application withdrawal (not a comment deadline)' WHEN 3 THEN 'withdrawal — confirm it touches a comment period' WHEN 4 THEN 'likely editorial/technical correction' ELSE '' END AS hint FROM part""")  # fmt: skip
def f18(spark, sf):
    k = c("p_partkey") % 7
    title = F.concat("p_name", F.when(k == 0, ": Information Collection; extension").when(k == 1, " withdraws 40 acres").when(k == 2, ": withdrawal of approval").when(k == 3, " withdrawn").when(k == 4, ": Correction").when(k == 5, ": Information Collection; extension of comment period").otherwise(": correction of the deadline"))
    return table(spark, sf, "part").select("p_partkey", S.false_positive_hint(title, S.keywords_in(title, ["extension", "withdraw", "correction"])).alias("hint"))


@query("f28_explanations", f"""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '{S.HIGH_TEXT}' WHEN 1 THEN replace('{S.MEDIUM_TEXT}', '%s', CASE WHEN o_custkey % 2 = 0 THEN ': a, b' ELSE '' END)
  WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN '{S.LOW_ONE_TEXT}' ELSE replace('{S.LOW_BOTH_TEXT.replace("'", "''")}', '%s', CASE WHEN o_custkey % 2 = 0 THEN ' (a, b)' ELSE '' END) END
  WHEN 3 THEN '{S.CLASH_TEXT}' ELSE '{S.UNKNOWN_TEXT}' END AS said FROM orders""")  # fmt: skip
def f28(spark, sf):
    k, m = c("o_orderkey") % 6, c("o_custkey")
    confidence = F.when(k == 0, "high").when(k == 1, "medium").when(k == 2, "low").when(k == 3, "conflicting").when(k == 4, "unknown")
    flags = F.when(m % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "orders").select("o_orderkey", S.confidence_text(confidence, flags, F.when(m % 3 != 0, "R")).alias("said"))


def _documents_of(events):
    return events.select(
        k_text("event_id").alias("observation_id"), F.when(c("user_id") % 2 == 0, reconcile.STATUS).otherwise(reconcile.PRIMARY).alias("source"), k_text("user_id").alias("ocd_id"), c("ts").alias("fetched_at"),
        F.when(c("user_id") % 2 == 0, k_text("user_id")).alias("regs_document_id"), F.when(c("user_id") % 3 != 0, k_text("user_id")).alias("fr_document_number"), F.floor(c("value") / 100).cast("string").alias("payload_hash"))


@query("s8_ingest", f"""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN user_id % 2 = 0 OR user_id % 3 <> 0 THEN user_id END AS d, floor(value / 100) AS h FROM events),
l AS (SELECT *, row_number() OVER w AS n, lag(h) OVER w AS p FROM e WHERE d IS NOT NULL WINDOW w AS (PARTITION BY d ORDER BY ts, CAST(event_id AS VARCHAR)))
SELECT CAST(event_id AS VARCHAR) AS observation_id, CAST(user_id AS VARCHAR) AS ocd_id FROM l WHERE ts >= TIMESTAMP '{MID}' AND (n = 1 OR h <> p)
UNION ALL SELECT CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR) FROM e WHERE d IS NULL AND ts >= TIMESTAMP '{MID}'""")  # fmt: skip
def s8(spark, sf):
    ev = table(spark, sf, "events")
    log, batch = _documents_of(ev.where(c("ts") < S.instant(MID))), _documents_of(ev.where(c("ts") >= S.instant(MID)))
    return ledger.ingest(log, log.select("observation_id", "ocd_id"), batch)[1]


@query("a20_newer", f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{MID}'")
def a20_newer(spark, sf):
    return audit.newer_than(table(spark, sf, "events").select("event_id", "ts"), "ts", S.instant(MID)).select("event_id")


@query("v1_repeated", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def v1_repeated(spark, sf):
    return audit.repeated_keys(table(spark, sf, "orders"), ["o_custkey"])


@query("w9_changes", f"""
WITH e AS (SELECT user_id, ts, event_id, event_type, 1 AS s FROM events UNION ALL SELECT DISTINCT user_id, TIMESTAMP '{MID}', NULL, 'change', 0 FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, s, event_id NULLS FIRST) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, s, event_id NULLS FIRST) = 1 OR event_type = 'change' AS beat FROM e),
i AS (SELECT *, CASE WHEN beat THEN n ELSE -sum(CAST(beat AS INTEGER)) OVER (PARTITION BY user_id ORDER BY n) END AS island FROM r),
g AS (SELECT user_id, beat, island, min(n) AS first_n, count(*) AS n_rows, arg_min(event_type, n) AS kind FROM i GROUP BY 1, 2, 3)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_n) AS INTEGER) AS position, CASE WHEN beat THEN kind ELSE 'routine' END AS event, n_rows FROM g""")  # fmt: skip
def w9_changes(spark, sf):
    ev = table(spark, sf, "events").select("user_id", c("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    changes = ev.select("user_id", S.instant(MID).alias("ts")).distinct()
    return serve.timeline(serve.with_changes(ev, changes, "user_id", "ts", "event_type"), "user_id", ["ts", "_spliced", "event_id"], "event_type", ["change"])


@query("x4_abstentions", "SELECT o_orderkey FROM orders WHERE o_custkey % 9 = 0 ORDER BY o_orderkey LIMIT 50")
def x4(spark, sf):
    found = table(spark, sf, "orders").select("o_orderkey", F.when(c("o_custkey") % 9 == 0, "we_abstain").otherwise("agree").alias("category"))
    return crosscheck.first_abstentions(found, "o_orderkey").select("o_orderkey")
