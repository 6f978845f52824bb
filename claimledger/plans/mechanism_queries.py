"""Queries of streams, replay, sliding ranges, histograms, snapshot comparison and reports; ``queries`` imports this module last."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimledger.functions import scalars as S
from claimledger.operators import audit, chain, ledger, metrics, projection, reconcile, serve, steps, verify
from claimledger.plans import job_queries as J
from claimledger.plans import jobs
from claimledger.plans.queries import NOW, STAMP, c, query, table, text
from claimledger.streaming import keyed

k_text = J.k_text


# ---- streams --------------------------------------------------------------------------------------


def _run(spark, sf, name: str, build, statestore: bool = False):
    """Runs a query over the table as a stream to its end; gives its rows, or the folder of its checkpoint."""
    keyed.use_state_store(spark)
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    folder = f"{steps.shared_folder(spark)}/stream-{spark.sql('SELECT uuid()').first()[0]}"
    stream = build(spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf))
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/check" if statestore else spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("i9_changed_stream", """
SELECT event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w""")  # fmt: skip
def i9(spark, sf):
    return _run(spark, sf, "events", lambda s: keyed.changed_payloads_stream(s.select("user_id", "event_type", "ts", "event_id"), ["user_id"], "event_type", ["ts", "event_id"])).select("event_id")


@query("i10_failure_state", """
SELECT user_id || '-' || event_id % 40 AS document_key, CAST(1 AS INTEGER) AS attempts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_failed FROM events GROUP BY 1 HAVING NOT bool_or(event_type = 'purchase')""")  # fmt: skip
def i10(spark, sf):
    build = lambda s: keyed.failure_stream(s.select(c("event_type").alias("error"), F.concat(k_text("user_id"), F.lit("-"), (c("event_id") % 40).cast("string")).alias("document_key"), F.lit("x").alias("source"), (c("event_type") == "purchase").alias("ok"), c("ts").alias("at")))
    return keyed.failure_table(spark, _run(spark, sf, "events", build, statestore=True)).select("document_key", "attempts", text("last_failed_at", "last_failed"))


@query("i3_once", "SELECT DISTINCT user_id, event_type FROM events")
def i3(spark, sf):
    return _run(spark, sf, "events", lambda s: keyed.once_within(s.select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"])).select("user_id", "event_type")


@query("i1_projection", J.CYCLE_SQL + """
SELECT 'ocd-participation-window/federal/' || CASE WHEN user_id % 3 <> 0 THEN 'D-' || user_id ELSE 'regs:obj' || user_id END AS ocd_id, CASE WHEN user_id % 9 = 0 THEN 'withdrawn' ELSE 'open' END AS status,
  strftime(DATE '2024-03-01' + CAST(user_id % 50 AS INTEGER), '%Y-%m-%d') AS close FROM s WHERE user_id % 17 <> 0 AND (user_id % 2 = 0 OR (NOT dead AND NOT bad))""")  # fmt: skip
def i1_projection(spark, sf):
    return J._cycle(spark, sf)[0]["projection"].select("ocd_id", "status", F.date_format("resolved_close_utc", "yyyy-MM-dd").alias("close"))


@query("i1_since", "SELECT o_orderstatus AS source, strftime(CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '1997-05-30 12:00:00' ELSE max(o_orderdate) END, '%Y-%m-%d %H:%M:%S') AS since FROM orders GROUP BY 1")
def i1_since(spark, sf):
    cursors = table(spark, sf, "orders").groupBy(c("o_orderstatus").alias("source")).agg(F.max("o_orderdate").alias("cursor_last_modified")).where("source <> 'P'")
    out = None
    for s in ("F", "O", "P"):
        one = jobs.due_since(cursors, s, S.instant(NOW)).select(F.lit(s).alias("source"), text("since", "since"))
        out = one if out is None else out.unionByName(one)
    return out


@query("i2_ingest", """
WITH d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 THEN true ELSE false END AS bad FROM orders WHERE o_orderkey % 5 <> 0)
SELECT (SELECT count(*) FROM orders) AS listed, count(*) AS to_fetch, count(*) FILTER (NOT bad) AS ingested, count(*) FILTER (bad) AS failed FROM d""")  # fmt: skip
def i2_ingest(spark, sf):
    raw = J._primary_raw(spark, sf).withColumn("fr_document_number", F.concat(F.lit("D-"), "o_orderkey"))
    known, _ = J.files.primary_observations(raw.where("o_orderkey % 5 = 0").select(F.lit('{"document_number": "x"}').alias("raw"), "fetched_at", c("fr_document_number").alias("_n")), "v1")
    log = known.withColumn("fr_document_number", c("_n")).withColumn("observation_id", c("_n")).drop("_n")
    state = {"log": log, "bridge": spark.createDataFrame([], "observation_id string, ocd_id string"), "failures": spark.createDataFrame([], jobs.FAILURES)}
    details = raw.select("fr_document_number", "raw", "fetched_at", F.lit(None).cast("string").alias("error"))
    return jobs.primary_ingest(state, raw.select("fr_document_number"), details, S.instant(NOW), "v1")[1].select("listed", "to_fetch", "ingested", "failed")


# ---- replay and scans -----------------------------------------------------------------------------


@query("t4_projection", """
WITH s AS (SELECT user_id, ts, min_by(CAST(floor(value / 100) AS INTEGER), 'o' || event_id) AS d, min('o' || event_id) AS o FROM events GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER w AS n, lag(d) OVER w AS p, lag(o) OVER w AS po FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT user_id, count(*) AS n, string_agg(po || '@' || strftime(DATE '2024-03-01' + p, '%Y-%m-%d') || '@' || strftime(ts, '%Y-%m-%d %H:%M:%S'), ',' ORDER BY n) AS h FROM l WHERE n > 1 AND d <> p GROUP BY 1),
e AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
SELECT CAST(e.user_id AS VARCHAR) AS ocd_id, CAST(coalesce(h.n, 0) AS INTEGER) AS version, e.o AS ids, coalesce(h.h, '') AS history, strftime(DATE '2024-03-01' + e.d, '%Y-%m-%d') AS close, 'D-' || e.user_id AS fr_document_number,
  CAST(e.user_id % 3 AS VARCHAR) AS rin FROM e LEFT JOIN h USING (user_id)""")  # fmt: skip
def t4_projection(spark, sf):
    out = reconcile.replay_projection(J._log(spark, sf), S.instant(NOW))
    step = lambda h: F.concat(F.get(h["observation_ids"], 0), F.lit("@"), F.date_format(S.new_york_date(h["resolved_close_utc"]), "yyyy-MM-dd"), F.lit("@"), F.date_format(h["changed_at"], STAMP))
    return out.select("ocd_id", "version", F.array_join("current_observation_ids", ",").alias("ids"), F.array_join(F.transform("change_history", step), ",").alias("history"), F.date_format(S.new_york_date(c("resolved_close_utc")), "yyyy-MM-dd").alias("close"), "fr_document_number", "rin")


@query("t4_running", """
SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS so_far, last_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER w AS last_returned, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS before
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def t4_running(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = projection.dealt(table(spark, sf, "lineitem").select("l_orderkey", *order, "l_returnflag"), ["l_orderkey"], order)
    out = projection.running(rows, ["l_orderkey"], order, sums={"so_far": c("l_quantity")}, lasts={"last_returned": F.when(c("l_returnflag") == "R", c("l_partkey"))})
    return projection.previous(out, ["l_orderkey"], order, c("l_partkey"), "before").select("l_orderkey", "l_linenumber", "so_far", "last_returned", "before")


@query("l1_ties", """
WITH t AS (SELECT user_id, 'o' || event_id AS o, date_trunc('day', ts) AS d FROM events) SELECT CAST(user_id AS VARCHAR) AS ocd_id, arg_max(o, (strftime(d, '%Y-%m-%d'), o)) AS fr_observation_id FROM t GROUP BY 1""")  # fmt: skip
def l1_ties(spark, sf):
    log = J._log(spark, sf).withColumn("fetched_at", F.date_trunc("day", "fetched_at")).withColumns({f: F.lit(False) for f in chain.FLAGS})
    return chain.chain_candidates(log, reconcile.reconcile_log(log, S.instant(NOW))).select("ocd_id", "fr_observation_id")


@query("g2_titles", """
WITH p AS (SELECT p_partkey AS k FROM part) SELECT k, CASE WHEN k % 3 = 0 THEN 'deferred' ELSE 'linked' END AS outcome FROM p""")  # fmt: skip
def g2_titles(spark, sf):
    side = lambda title, day: F.struct(title.alias("title"), F.lit(None).cast("string").alias("dates_text"), F.lit(day).alias("publication_date"), c("p_name").alias("fr_document_number"), F.array().cast("array<string>").alias("rins"))
    k = c("p_partkey")
    pairs = lambda now: table(spark, sf, "part").select(k, k_text("p_partkey").alias("ocd_id"), F.lit("b").alias("ocd_id_b"), side(F.concat("p_name", k.cast("string")), "2026-01-01").alias("a"), side(F.concat("p_type", k.cast("string"), F.when(F.lit(now) & (k % 3 == 0), " (corrected)").otherwise("")), "2026-02-01").alias("b"))
    cache = chain.adjudication_input(pairs(False)).select("content_hash", F.lit("p").alias("adjudicator_id"), F.lit("affirm").alias("classification"), F.lit("").alias("rationale"), S.instant(NOW).alias("created_at"))
    provider = lambda df: df.select("content_hash", F.lit("affirm").alias("classification"), F.lit("").alias("rationale"))
    out, _ = chain.adjudicate(chain.adjudication_input(pairs(True)), cache.unionByName(cache), provider, "p", S.instant(NOW), budget=0)
    return out.select(c("p_partkey").alias("k"), "outcome")


@query("u6_retired", """
WITH f AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error') SELECT CAST(k AS VARCHAR) AS ocd_id, k % 2 = 0 AS crosses, k % 2 = 0 AND k % 4 <> 0 AS retired FROM f""")  # fmt: skip
def u6(spark, sf):
    k = c("ocd_id").cast("long")
    rows = J._errors(table(spark, sf, "events"), F.lit(True)).withColumn("conflict_scope", F.when(k % 2 == 0, "cross_window").otherwise("cross_source"))
    out = projection.merge_conflicts(rows, rows.where(k % 4 == 0), S.instant(NOW), "cross_window")
    return out.select("ocd_id", (c("conflict_scope") == "cross_window").alias("crosses"), c("resolved_at").isNotNull().alias("retired"))


# ---- rollups --------------------------------------------------------------------------------------


@query("m1_sliding", """
WITH e AS (SELECT event_type, event_id, epoch_us(ts) AS t, value AS v FROM events WHERE ts < TIMESTAMP '2024-01-04'),
r AS (SELECT *, (CAST(ceil(t / 900000000.0) AS BIGINT) + unnest(range(8))) * 900000000 AS e FROM e),
l AS (SELECT *, lag(v) OVER w AS p, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY event_type, e ORDER BY t, event_id)),
g AS (SELECT event_type, e, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(v, n) AS v0, sum(CASE WHEN n = 1 THEN 0 WHEN v < p THEN v ELSE v - p END) AS up FROM l GROUP BY 1, 2 HAVING count(*) > 1),
x AS (SELECT *, (t1 - t0) / (n - 1) AS m, t0 - (e - 7200000000) AS h, e - t1 AS z FROM g WHERE t1 > t0),
y AS (SELECT *, CASE WHEN h >= 1.1 * m THEN m / 2 ELSE h END AS hh, CASE WHEN z >= 1.1 * m THEN m / 2 ELSE z END AS zz, CASE WHEN up > 0 AND v0 >= 0 THEN (t1 - t0) * v0 / up END AS o FROM x)
SELECT event_type, strftime(make_timestamp(e), '%Y-%m-%d %H:%M:%S') AS at, n AS n_samples, round(up * ((t1 - t0) + least(hh, coalesce(o, hh)) + zz) / (t1 - t0) + 1e-7, 4) AS increase FROM y""")  # fmt: skip
def m1_sliding(spark, sf):
    rows = table(spark, sf, "events").where(c("ts") < F.lit("2024-01-04").cast("timestamp")).select("event_type", "ts", "value", "event_id")
    return metrics.sliding_increases(rows, ["event_type"], "ts", "value", "event_id", "2 hours", "15 minutes").select("event_type", text("at", "at"), "n_samples", F.round(c("increase") + 1e-7, 4).alias("increase"))  # off the ties of rounding


@query("m2_histogram", """
WITH le AS (SELECT unnest([10.0, 25.0, 50.0, 100.0, 150.0]) AS le), b AS (SELECT user_id, le, count(*) FILTER (value <= le) AS n FROM events, le GROUP BY 1, 2),
t AS (SELECT user_id, count(*) AS total FROM events GROUP BY 1), r AS (SELECT b.*, total, coalesce(lag(n) OVER w, 0) AS pn, coalesce(lag(le) OVER w, 0) AS lo FROM b JOIN t USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY le)),
h AS (SELECT user_id, lo + (le - lo) * (0.9 * total - pn) / (n - pn) AS q FROM r WHERE n >= 0.9 * total AND pn < 0.9 * total)
SELECT user_id, round(coalesce(h.q, 150.0), 6) AS quantile FROM t LEFT JOIN h USING (user_id)""")  # fmt: skip
def m2_histogram(spark, sf):
    bounds = F.array(*[F.struct(F.lit(t).alias("le"), F.lit(v).alias("v")) for t, v in (("10", 10.0), ("25", 25.0), ("50", 50.0), ("100", 100.0), ("150", 150.0), ("+Inf", float("inf")))])
    rows = table(spark, sf, "events").select("user_id", "value", F.explode(bounds).alias("b")).groupBy("user_id", c("b.le").alias("le")).agg(F.count_if(c("value") <= c("b.v")).alias("n"))
    return metrics.histogram_quantile(rows, ["user_id"], "le", "n", 0.9).withColumn("quantile", F.round("quantile", 6))


# ---- audits ---------------------------------------------------------------------------------------


@query("s9_changes", """
SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'missing' WHEN o_orderkey % 89 = 0 THEN 'changed' ELSE 'added' END AS change FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0
UNION ALL SELECT -o_orderkey - 1, 'added' FROM orders WHERE o_orderkey % 101 = 0""")  # fmt: skip
def s9_changes(spark, sf):
    before = table(spark, sf, "orders")
    k = c("o_orderkey")
    after = before.where(k % 97 != 0).withColumn("o_orderstatus", F.when(k % 89 == 0, F.lit(None)).otherwise(c("o_orderstatus"))).unionByName(before.where(k % 101 == 0).withColumn("o_orderkey", -k - 1))
    return audit.snapshot_changes(before, after, ["o_orderkey"])


@query("a20_trees", "SELECT CAST(0 AS INTEGER) AS level, count(*) AS n, count(*) > 0 AS alike FROM lineitem")
def a20_trees(spark, sf):
    lines = table(spark, sf, "lineitem")
    a = audit.hash_tree(lines, ["l_orderkey"]).where("level = 0")
    b = audit.hash_tree(lines.repartition("l_partkey"), ["l_orderkey"]).where("level = 0")
    j = a.join(b.select("level", *[c(x).alias(f"{x}2") for x in ("n", "x", "lo", "hi")]), "level")
    return j.select("level", "n", ((c("n") == c("n2")) & (c("x") == c("x2")) & (c("lo") == c("lo2")) & (c("hi") == c("hi2"))).alias("alike"))


@query("e9_fixtures", """
SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 1 THEN 'was_correct,basis' WHEN 2 THEN 'basis' WHEN 3 THEN 'contradicting_observation_ids,invariant' WHEN 4 THEN 'was_correct,basis,contradicting_observation_ids' END AS differs FROM orders WHERE o_orderkey % 7 IN (1, 2, 3, 4)""")  # fmt: skip
def e9_fixtures(spark, sf):
    k = c("o_orderkey") % 7
    none = F.array().cast("array<string>")
    gone = F.array(F.struct(F.lit("o").alias("observation_id"), c("o_orderdate").alias("fetched_at"), F.lit(False).alias("is_extension"), F.lit(False).alias("is_correction"), F.lit(True).alias("is_withdrawal"), F.lit(False).alias("is_reopening"))).cast(verify.SINCE)
    rows = table(spark, sf, "orders").select(
        F.struct(c("o_orderkey").alias("k")).alias("meta"),
        F.struct(c("o_orderdate").alias("publishedCloseUtc"), c("o_orderdate").alias("currentCloseUtc"), F.when(k.isin(4, 5), gone).otherwise(F.array().cast(verify.SINCE)).alias("observationsSinceClose"), k.isin(1, 3, 6).alias("lapsed")).alias("input"),
        F.struct(F.when(k.isin(3, 6), F.lit(None)).otherwise(k != 5).alias("was_correct"), F.when(k == 2, "manual").when(k.isin(3, 6), "unverified_lapsed").when(k == 5, "late_amendment").otherwise("post_close_repoll").alias("basis"), F.when(k.isin(3, 5), F.array(F.lit("o"))).otherwise(none).alias("contradicting_observation_ids")).alias("expected"))
    return verify.replay_fixtures(rows).select(c("meta.k").alias("k"), F.array_join("differs", ",").alias("differs"))


@query("s11_fixtures", "SELECT o_orderkey AS k, o_orderstatus AS status, o_orderkey % 2 = 0 AS stamped, o_orderkey % 5 = 0 AS lapsed FROM orders")
def s11(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", k_text("o_orderkey").alias("ocd_id"), F.lit(0).alias("window_version"), "o_orderdate", "o_orderstatus")
    lapsed = c("o_orderkey") % 5 == 0
    records = o.select("ocd_id", "window_version", c("o_orderdate").alias("published_close_utc"), F.when(~lapsed, True).alias("was_correct"), F.when(lapsed, "unverified_lapsed").otherwise("post_close_repoll").alias("basis"), F.array().cast("array<string>").alias("contradicting_observation_ids"))
    windows = o.select("ocd_id", c("o_orderdate").alias("resolved_close_utc"), c("o_orderstatus").alias("status"), c("ocd_id").alias("regs_document_id"))
    stamps = o.where("o_orderkey % 2 = 0").select(c("ocd_id").alias("regs_document_id"), c("o_orderdate").alias("last_checked_at"))
    since = o.limit(0).select("ocd_id", "window_version", F.array().cast(verify.SINCE).alias("since"))
    out = jobs.regression_fixtures(records, o.select("ocd_id", "window_version", c("o_orderdate").alias("snapshotted_at")), windows, since, stamps)
    return out.select(c("meta.ocd_id").cast("long").alias("k"), c("input.currentStatus").alias("status"), c("meta.last_checked_at").isNotNull().alias("stamped"), c("input.lapsed").alias("lapsed"))


@query("s10_gold", J.DATASET_SQL + "SELECT CAST(h AS VARCHAR) AS content_hash, kind, cl AS classification, CAST(NULL AS VARCHAR) AS gold FROM s")
def s10(spark, sf):
    cache = J._cache(spark, sf).where(c("classification") != "broken")
    return jobs.gold_template(cache, ["chain", "notice"]).select("content_hash", "kind", "classification", "gold")


# ---- texts, feeds and reports ---------------------------------------------------------------------


@query("f6_spaces", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 4 WHEN 2 THEN ' 01:59:59' ELSE ' 03:59:59' END END AS at, o_orderkey % 4 <> 3 AS has_offset FROM orders""")  # fmt: skip
def f6(spark, sf):
    k, day = c("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    said = F.concat(day, F.when(k == 0, " 03:59:59Z").when(k == 1, "T03:59:59Z").when(k == 2, " 03:59:59+02:00").otherwise("_03:59:59"))
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(S.utc_instant(said), STAMP).alias("at"), S.has_offset(said).alias("has_offset"))


@query("f17_joined", """
SELECT p_partkey, array_to_string(list_distinct_keep(a || b), ',') AS stems FROM (SELECT p_partkey, list_filter(['STEEL', 'TIN', 'BRASS', 'NICKEL', 'COPPER', 'ECO'], lambda k: contains(p_type, k)) AS a,
  list_filter(['STEEL', 'TIN', 'BRASS', 'NICKEL', 'COPPER', 'ECO'], lambda k: contains(upper(p_name), k)) AS b FROM part)""".replace("list_distinct_keep(a || b)", "list_filter(a || b, lambda x, i: list_position(a || b, x) = i)"))  # fmt: skip
def f17(spark, sf):
    stems = ["steel", "tin", "brass", "nickel", "copper", "eco"]
    return table(spark, sf, "part").select("p_partkey", F.upper(F.array_join(S.keywords_of(c("p_type"), c("p_name"), stems), ",")).alias("stems"))


@query("f21_names", """
WITH n AS (SELECT DISTINCT p_type AS n FROM part), d AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS t FROM part)
SELECT p_partkey, string_agg(n, ',' ORDER BY n) AS names FROM d JOIN n ON regexp_matches(t, '(^|[^A-Za-z0-9_])' || regexp_escape(n) || '($|[^A-Za-z0-9_])') GROUP BY 1""")  # fmt: skip
def f21_names(spark, sf):
    part = table(spark, sf, "part")
    names = sorted(r[0] for r in part.select("p_type").distinct().limit(1000).collect())  # part types are a list of fixed length
    found = F.array_join(S.names_in(F.concat_ws(" ", "p_name", "p_type", "p_brand"), names), ",")
    return part.select("p_partkey", found.alias("names")).where("names <> ''")


@query("a5_aggregates", """
SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, string_agg(l_linestatus, '' ORDER BY l_linenumber, l_linestatus) AS states, bool_or(CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'R' END) AS any_r,
  coalesce(bool_or(CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'R' END), false) AS any_r_or_false FROM lineitem GROUP BY 1""")  # fmt: skip
def a5(spark, sf):
    mark = F.when(c("l_returnflag") != "N", c("l_returnflag") == "R")
    states = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_linestatus"))), lambda x: x["l_linestatus"]), "")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("flags"), states.alias("states"), F.bool_or(mark).alias("any_r"), F.coalesce(F.bool_or(mark), F.lit(False)).alias("any_r_or_false"))


@query("o5_conflicts", """
WITH f AS (SELECT event_id, user_id, date_trunc('day', ts) AS d FROM events WHERE event_type = 'error') SELECT CAST(event_id AS VARCHAR) AS observation_a_id, CAST(user_id AS VARCHAR) AS ocd_id FROM f
ORDER BY d DESC, CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR) LIMIT 40 OFFSET 10""")  # fmt: skip
def o5(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'error'").select(k_text("user_id").alias("ocd_id"), k_text("event_id").alias("observation_a_id"), F.lit("b").alias("observation_b_id"), F.lit(None).cast("string").alias("ocd_id_b"), F.date_trunc("day", "ts").alias("detected_at"))
    return serve.list_conflicts(rows, 40, 10).select("observation_a_id", "ocd_id")


FEEDS_SQL = """
WITH p AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_custkey FROM orders WHERE o_orderkey % 4 <> 0),
s AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS late, o_orderkey % 6 = 0 AS naive, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 1 END AS utc FROM orders WHERE o_orderkey % 3 <> 0)
"""


def _feeds(spark, sf):
    o, k = table(spark, sf, "orders"), c("o_orderkey")
    primary = o.where(k % 4 != 0).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    at = F.concat(F.date_format(F.date_add(c("o_orderdate").cast("date"), F.when(k % 5 == 0, 3).otherwise(1)), "yyyy-MM-dd"), F.when(k % 10 == 5, "T03:59:59").otherwise("T03:59:59Z"))
    return primary, o.where(k % 3 != 0).select("o_orderkey", at.alias("at"))


@query("x6_report", FEEDS_SQL.replace("o_orderkey % 6 = 0", "o_orderkey % 10 = 5") + """
SELECT count(*) FILTER (NOT naive) AS n, count(*) FILTER (NOT naive AND late) AS n_conflicts, count(*) FILTER (NOT naive) AS n_naive, count(*) FILTER (NOT naive AND NOT late) AS n_zone_only,
  round(100.0 * count(*) FILTER (NOT naive AND late) / count(*) FILTER (NOT naive), 1) AS rate, count(*) FILTER (naive) AS n_refused FROM p JOIN s USING (k)""")  # fmt: skip
def x6_report(spark, sf):
    primary, status = _feeds(spark, sf)
    return jobs.conflict_report(primary, status, "o_orderkey", "day", "at", ["o_orderkey"])[0]


@query("j4_samples", FEEDS_SQL + "SELECT k AS o_orderkey FROM p JOIN s USING (k) WHERE NOT late ORDER BY k LIMIT 10")
def j4_samples(spark, sf):
    primary, status = _feeds(spark, sf)
    return jobs.conflict_report(primary, status, "o_orderkey", "day", "at", ["o_orderkey"])[1].select("o_orderkey")


@query("x5_report", """
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS key, o_custkey AS cust FROM orders), p AS (SELECT o_orderkey AS key, o_custkey AS cust FROM orders WHERE o_orderkey % 3 = 0),
m AS (SELECT *, key IN (SELECT key FROM p) AS hit FROM s), r AS (SELECT DISTINCT k FROM m WHERE NOT coalesce(hit, false) AND cust IN (SELECT cust FROM p))
SELECT (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM m WHERE hit) AS n_joined, (SELECT count(*) FROM r) AS n_recovered, CASE WHEN 100.0 * ((SELECT count(*) FROM m WHERE hit) + (SELECT count(*) FROM r)) / (SELECT count(*) FROM s) >= 60 THEN 'go' ELSE 'no-go' END AS verdict""")  # fmt: skip
def x5_report(spark, sf):
    o, k = table(spark, sf, "orders"), c("o_orderkey")
    status = o.select(c("o_orderkey").alias("k"), F.when(k % 7 != 0, k).alias("key"), "o_custkey")
    primary = o.where(k % 3 == 0).select(k.alias("key"), F.array("o_custkey").alias("customers"))
    return jobs.join_rate_report(status, primary, "key", "o_custkey", "customers").select("n", "n_joined", "n_recovered", "verdict")


@query("x7_report", """
WITH q AS (SELECT unnest(generate_series(TIMESTAMP '1997-07-01', TIMESTAMP '1998-04-01', INTERVAL 3 MONTH)) AS s), d AS (SELECT o_orderdate AS t, o_orderkey % 5 = 0 AS eis FROM orders WHERE o_orderkey % 5 IN (0, 1))
SELECT year(s) || 'Q' || quarter(s) AS label, count(*) FILTER (eis) AS eis, count(*) FILTER (NOT eis) AS rulemaking, count(t) AS total FROM q LEFT JOIN d ON t >= s AND CAST(t AS DATE) <= least(s + INTERVAL 3 MONTH - INTERVAL 1 DAY, TIMESTAMP '1998-05-20') GROUP BY s""")  # fmt: skip
def x7_report(spark, sf):
    k = c("o_orderkey") % 5
    docs = table(spark, sf, "orders").select("o_orderdate", F.when(k == 1, "Proposed Rule").when(k == 2, "Other").otherwise("Notice").alias("kind"), F.when(k == 0, "Draft EIS, a plan").otherwise("Hearing on eisenia").alias("title"))
    return jobs.density_report(docs, "kind", "title", "o_orderdate", F.lit("1998-05-20").cast("date"))[0].select("label", c("EIS").alias("eis"), c("Rulemaking").alias("rulemaking"), "total")


@query("v1_conflicts", """
SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'cross_window_without_other' WHEN 1 THEN 'cross_source_with_other' ELSE 'no_flag' END AS broken FROM orders WHERE o_orderkey % 4 < 3""")  # fmt: skip
def v1_conflicts(spark, sf):
    k = c("o_orderkey") % 4
    rows = table(spark, sf, "orders").select("o_orderkey", k_text("o_orderkey").alias("ocd_id"), F.when(k.isin(0, 3), "cross_window").otherwise("cross_source").alias("conflict_scope"), F.when(k == 0, k_text("o_orderkey")).when(k.isin(1, 3), "other").alias("ocd_id_b"), F.when(k != 2, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")).alias("conflict_flags"))
    return reconcile.violations(rows, "conflicts").select(c("o_orderkey").alias("k"), F.array_join("violations", ",").alias("broken"))


@query("v1_accuracy", """
SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'lapsed_with_verdict' WHEN 1 THEN 'miss_without_evidence' WHEN 2 THEN 'evidence_without_miss' WHEN 3 THEN 'verified_before_close' ELSE 'unknown_at_close' END AS broken FROM orders WHERE o_orderkey % 6 < 5""")  # fmt: skip
def v1_accuracy(spark, sf):
    k = c("o_orderkey") % 6
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k == 0, "unverified_lapsed").otherwise("late_amendment").alias("basis"), (k != 1).alias("was_correct"), F.when(k == 2, F.array(F.lit("o"))).otherwise(F.array().cast("array<string>")).alias("contradicting_observation_ids"),
        F.when(k == 3, c("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(c("o_orderdate")).alias("verified_at_utc"), c("o_orderdate").alias("closed_at_utc"), F.when(k == 4, "unknown").otherwise("high").alias("confidence_at_close"))
    return reconcile.violations(rows, "accuracy").select(c("o_orderkey").alias("k"), F.array_join("violations", ",").alias("broken"))


@query("t1_heads", "SELECT user_id, arg_max(event_type, (strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), event_id)) AS event_type FROM events GROUP BY 1")
def t1_heads(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return ledger.latest_heads(ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_type")


# ---- sources and adjudication ---------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{steps.shared_folder(spark)}/{name}-{spark.sql('SELECT uuid()').first()[0]}"


@query("s1_json_array", "SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 3 = 0")
def s1(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    folder = _folder(spark, "arrays")
    lists = rows.groupBy((c("o_orderkey") % 10).alias("file")).agg(F.to_json(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "day"))).alias("value"))
    lists.write.partitionBy("file").text(folder)
    return J.files.read_json_array(spark, folder, "o_orderkey long, o_orderstatus string, day string").select("o_orderkey", "o_orderstatus", "day")


@query("s2_json_lines", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def s2(spark, sf):
    folder = _folder(spark, "lines")
    table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.when(c("o_orderkey") % 4 != 0, c("o_custkey")).alias("o_custkey")).write.json(folder)
    return J.files.read_json_lines(spark, folder, "o_orderkey long, at string, o_custkey long")


@query("s3_columns", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'")
def s3(spark, sf):
    return J.files.read_columns(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate"]).where(c("l_shipdate") >= F.lit("1997-01-01").cast("timestamp")).select("l_orderkey", "l_quantity")


@query("s4_export", "SELECT CAST(user_id AS VARCHAR) AS ocd_id, 'closes ' AS shown, count(*) > 0 AS there FROM events GROUP BY 1")
def s4(spark, sf):
    folder = _folder(spark, "export")
    J.files.write_windows(reconcile.reconcile_log(J._log(spark, sf), S.instant(NOW)), folder)
    back = J.files.read_json_lines(spark, folder, "ocd_id string, resolved_close_display string, derived_at string, rin string")
    return back.select("ocd_id", F.substring("resolved_close_display", 1, 7).alias("shown"), (c("derived_at") == "1997-06-01T12:00:00.000Z").alias("there"))


@query("g1_outcomes", """
WITH p AS (SELECT p_partkey AS k, p_partkey % 50 AS h FROM part), f AS (SELECT h, row_number() OVER (ORDER BY min(CAST(k AS VARCHAR)), CAST(h AS VARCHAR)) AS n, count(*) AS c FROM p WHERE h % 5 <> 0 GROUP BY 1)
SELECT k, CASE WHEN h % 5 = 0 THEN 'linked' WHEN n > 12 THEN 'deferred' WHEN h % 7 = 0 THEN 'error' WHEN h % 2 = 0 THEN 'linked' ELSE 'not_linked' END AS outcome, h % 5 = 0 AS cached FROM p LEFT JOIN f USING (h)""")  # fmt: skip
def g1(spark, sf):
    pairs = table(spark, sf, "part").select(k_text("p_partkey").alias("ocd_id"), F.lit("b").alias("ocd_id_b"), (c("p_partkey") % 50).cast("string").alias("content_hash"))
    cache = spark.range(0, 50, 5).select(c("id").cast("string").alias("content_hash"), F.lit("p").alias("adjudicator_id"), F.lit("affirm").alias("classification"), F.lit("").alias("rationale"), S.instant(NOW).alias("created_at"))
    h = c("content_hash").cast("int")
    provider = lambda df: df.select("content_hash", F.when(h % 7 == 0, F.lit(None)).when(h % 2 == 0, "affirm").otherwise("reject").alias("classification"), F.lit("").alias("rationale"))
    out, _ = chain.adjudicate(pairs, cache, provider, "p", S.instant(NOW), budget=12, tries=1)
    return out.select(c("ocd_id").cast("long").alias("k"), "outcome", "cached")


@query("g5_without_provider", "SELECT p_partkey AS k, 'ambiguous' AS outcome, p_name IS NULL AS judged FROM part")
def g5(spark, sf):
    pairs = table(spark, sf, "part").select(k_text("p_partkey").alias("ocd_id"), F.lit("b").alias("ocd_id_b"), c("p_name").alias("content_hash"))
    out, _ = chain.adjudicate(pairs, spark.createDataFrame([], "content_hash string, adjudicator_id string, classification string, rationale string, created_at timestamp"), None, "p", S.instant(NOW))
    return out.select(c("ocd_id").cast("long").alias("k"), "outcome", c("classification").isNotNull().alias("judged"))
