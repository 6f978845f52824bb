"""Whole jobs put together from the operators: discovery, re-poll selection, cycles, exports, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger.functions import scalars as S
from claimledger.operators import chain, crosscheck, ledger, projection, reconcile, steps, verify
from claimledger.sources import files
from claimledger.sources.tables import Kind, Tables


def open_set(docs: DataFrame, close_day: str, now: Column) -> DataFrame:
    """Documents whose close is today in New York or later."""
    return docs.where(F.try_to_date(F.col(close_day), "yyyy-MM-dd") >= S.new_york_date(now))


def keyword_set(docs: DataFrame, text: str, day: str, now: Column, terms: Sequence[str], days: int = 120) -> DataFrame:
    """Documents of the last days that hold one of the terms."""
    hit = reduce(or_, [F.contains(F.lower(F.col(text)), F.lit(t.lower())) for t in terms])
    return docs.where(hit & (F.try_to_date(F.col(day), "yyyy-MM-dd") >= S.days_ago(now, days)))


def changed_set(docs: DataFrame, modified: str, cursor: Column, hours: int = 6) -> DataFrame:
    """Documents changed since the cursor, with an overlap."""
    return docs.where(F.col(modified) >= S.lower_bound(cursor, hours))


def report_set(docs: DataFrame, day: str, kind: str, first: str, last: str, kinds: Sequence[str]) -> DataFrame:
    """Documents of some kinds published in a period, both ends included."""
    return docs.where(F.col(day).between(first, last) & F.col(kind).isin(*kinds))


def listed(parts: Sequence[DataFrame], key: str, date: str) -> DataFrame:
    """The union of the sets, one row per key (A1)."""
    rows = reduce(DataFrame.unionByName, [p.select(key, date).withColumn("seq", F.lit(i)) for i, p in enumerate(parts)])
    return ledger.keep_latest(rows, key, date, "seq").select(key, date)


def closing_soon(windows: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """P10: open windows that close within ``days``."""
    return windows.where((F.col("status") == "open") & F.col("resolved_close_utc").between(now, now + F.make_interval(days=F.lit(days))))


def title_search(rows: DataFrame, needle: str, columns: Sequence[str], pattern: str | None = None) -> DataFrame:
    """Rows in which a column contains the text, and (if given) one matches the pattern."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    hit = reduce(or_, [F.contains(c, F.lit(needle.lower())) for c in low])
    return rows.where(hit & (reduce(or_, [c.rlike(f"(?i){pattern}") for c in low]) if pattern else F.lit(True)))


def repoll_eligible(windows: DataFrame, stamps: DataFrame, unresolved: DataFrame, dead: DataFrame, seen: DataFrame, cutoff: Column, key: str = "regs_document_id") -> DataFrame:
    """Windows that are open or under an unresolved watch, stale, not dead, not seen in this cycle."""
    watched = unresolved.select("ocd_id").distinct().withColumn("_watched", F.lit(True))
    j = windows.where(F.col(key).isNotNull()).join(stamps, key, "left").join(watched, "ocd_id", "left")
    rows = projection.due(j.where((F.col("status") == "open") | F.coalesce("_watched", F.lit(False))), F.col("last_checked_at"), cutoff)
    return rows.join(dead.select(key).distinct(), key, "left_anti").join(seen.select(key).distinct(), key, "left_anti").drop("_watched")


def dead_keys(ledger_rows: DataFrame, source: str) -> DataFrame:
    """I8."""
    return ledger_rows.where((F.col("source") == source) & F.col("dead_lettered_at").isNotNull()).select("document_key")


def dead_due(ledger_rows: DataFrame, cutoff: Column) -> DataFrame:
    """Dead letters not retried since the cutoff."""
    return projection.due(ledger_rows.where("dead_lettered_at IS NOT NULL"), F.coalesce("last_retry_at", "dead_lettered_at"), cutoff)


def primary_cycle(found: DataFrame, log: DataFrame, dead: DataFrame, key: str = "fr_document_number") -> tuple[DataFrame, DataFrame]:
    """(keys to fetch: listed, not in the log, not dead; one-row summary)."""
    fresh = found.join(log.select(key).distinct(), key, "left_anti")
    todo = fresh.join(dead.select(F.col("document_key").alias(key)), key, "left_anti")
    one = found.agg(F.count("*").alias("listed")).crossJoin(fresh.agg(F.count("*").alias("fresh"))).crossJoin(todo.agg(F.count("*").alias("to_fetch")))  # one row each
    return todo, one


STATUS_KEY = ["source", "regs_document_id"]
ORDER = ["fetched_at", "observation_id"]


def due_since(cursors: DataFrame, source: str, now: Column, hours: int = 48) -> DataFrame:
    """One row (since): the source's cursor, or ``hours`` before ``now`` where it has none yet."""
    own = cursors.where(F.col("source") == source).agg(F.max("cursor_last_modified").alias("cursor"))
    return own.select(F.coalesce("cursor", now - F.make_interval(hours=F.lit(hours))).alias("since"))


def status_read(failures: DataFrame, feed: DataFrame, details: DataFrame, version: str) -> dict:
    """The reading half of a status cycle: ``live`` rows, observations ``read``, ``ok`` ids, ``failed`` (id, error), and ``counts``.

    Only the dead letters of ``failures`` are looked at.
    """
    dead = dead_keys(failures, reconcile.STATUS).select(F.col("document_key").alias("id"), F.lit(True).alias("dead"))
    got = details.select("id", "raw", "fetched_at", F.col("error").alias("fetch_error"))
    rows = ledger.keep_latest(feed, "id", "date", "seq").join(dead, "id", "left").join(got, "id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    listed, counts = steps.counted(rows, listed=F.count("*"), skipped_dead=F.count_if("dead"))
    live = listed.where("NOT dead").drop("dead")
    good, rejects = files.status_observations(live.where("raw IS NOT NULL AND fetch_error IS NULL").select("id", "raw", "fetched_at"), version)
    named = good.withColumn("observation_id", F.sha2(F.concat_ws("|", "source", "regs_document_id", "payload_hash", F.col("fetched_at").cast("string")), 256)).drop("id")
    read, n_read = steps.counted(named, read=F.count("*"))
    ok = read.select(F.col("regs_document_id").alias("id")).distinct()
    unread = live.where("raw IS NULL OR fetch_error IS NOT NULL").select("id", F.coalesce("fetch_error", F.lit("no details")).alias("error"))
    failed, n_failed = steps.counted(unread.unionByName(rejects.select("id", "error")).dropDuplicates(["id"]).join(ok, "id", "left_anti"), failed=F.count("*"))
    return {"live": live, "read": read, "ok": ok, "failed": failed, "counts": counts | n_read | n_failed}


def status_merge(state: dict[str, DataFrame], seen: dict, now: Column, threshold: int = 5) -> tuple[dict[str, DataFrame], dict]:
    """The writing half: (tables after the cycle and ``broken`` rows, counts).

    ``state`` holds projection, conflicts, cursors, stamps, failures, the log of at least the entities read, and may hold
    ``heads`` (latest hash per document), else the log is asked for them.  A row of the projection that breaks an invariant
    (R13) is not merged, nor its conflict; it comes back in ``broken``.
    """
    named = lambda df: df.withColumn("source", F.lit(reconcile.STATUS)).withColumnRenamed("id", "document_key")
    live, read, ok, failed = (seen[k] for k in ("live", "read", "ok", "failed"))
    new, n_new = steps.counted(ledger.changed_payloads(state.get("heads", state["log"]), read, STATUS_KEY, "payload_hash", ORDER), ingested=F.count("*"))
    log = state["log"].unionByName(new)
    touched = read.select("ocd_id").distinct()
    derived = steps.stored(reconcile.reconcile_log(log.join(touched, "ocd_id", "left_semi"), now))
    sound, broken = reconcile.checked(derived)
    cleared, recovered = projection.clear_failures(state["failures"], named(ok))
    recovered, n_recovered = steps.counted(recovered, recovered=F.count("*"))
    failures, n_dead = steps.counted(projection.merge_failures(cleared, named(failed), now, threshold), dead_lettered=F.count_if("newly_dead"))
    prefix = steps.stored(projection.success_prefix(live.join(failed.select("id", F.lit(True).alias("failed")), "id", "left").withColumn("failed", F.coalesce("failed", F.lit(False))), "date", "id", "failed"))
    moved = prefix.select(F.lit(reconcile.STATUS).alias("source"), F.try_to_timestamp("cursor").alias("cursor_last_modified"))
    merged = projection.merge_conflicts(state["conflicts"], reconcile.conflict_rows(sound, now), now, "cross_source", sound.select("ocd_id"))
    after = {
        "log": log, "new": new, "projection": projection.merge_projection(state["projection"], sound.drop("version"), now), "conflicts": merged, "broken": broken,
        "cursors": projection.merge_cursor(state["cursors"], moved, now), "stamps": projection.merge_stamps(state["stamps"], read.select("regs_document_id", now.alias("last_checked_at"))),
        "failures": failures.drop("newly_dead"),
    }
    if "heads" in state:
        after["heads"] = ledger.latest_heads(state["heads"], read, STATUS_KEY, "payload_hash", ORDER)
    return after, seen["counts"] | n_new | n_recovered | n_dead | {"cursor": prefix.first()["cursor"]}


def status_cycle(state: dict[str, DataFrame], feed: DataFrame, details: DataFrame, now: Column, version: str, threshold: int = 5) -> tuple[dict[str, DataFrame], DataFrame]:
    """One cycle of the status source: (state after it, one-row summary).

    ``state`` holds log, projection, conflicts, cursors, stamps and failures.  ``feed`` (id, date, seq)
    lists what changed, ``details`` (id, raw, fetched_at, error) is what fetching the documents gave.  Dead
    letters are not looked at; a document without details, with an error, or whose details can't be read has
    failed.  All that succeeded are reconciled, stamped and cleared, whether their payload is new or not;
    the cursor stops before the first failure.  The summary is counted while the rows are written (A18, M8).
    """
    seen = status_read(state["failures"], feed, details, version)
    after, counts = status_merge(state, seen, now, threshold)
    return after, status_summary(feed.sparkSession, counts)


def status_summary(spark, counts: dict) -> DataFrame:
    """The cycle's counts as one row."""
    names = ("listed", "ingested", "failed", "dead_lettered", "recovered", "deduped", "skipped_dead")
    row = counts | {"deduped": counts["read"] - counts["ingested"]}
    return spark.createDataFrame([(*[row[n] for n in names], row["cursor"])], ", ".join(f"{n} long" for n in names) + ", cursor string")


LOG = "ocd_id string, observation_id string, source string, fr_document_number string, regs_document_id string, regs_object_id string, payload_hash string, fetched_at timestamp, parser_version string, raw_dates_text string, is_extension boolean, is_correction boolean, is_withdrawal boolean, is_reopening boolean, raw string"
FAILURES = "source string, document_key string, attempts int, first_failed_at timestamp, last_failed_at timestamp, last_error string, dead_lettered_at timestamp, last_retry_at timestamp"
CONFLICTS = "ocd_id string, observation_a_id string, observation_b_id string, source_a string, source_b string, conflict_flags array<string>, govinfo_url string, detected_at timestamp, resolved_at timestamp, conflict_scope string, ocd_id_b string, govinfo_url_b string"


def status_tables(spark) -> dict[str, Kind]:
    """The tables of the status source's cycle, each with the key that deals it into buckets."""
    empty = reconcile.reconcile_log(spark.createDataFrame([], LOG), S.instant("2000-01-01 00:00:00")).drop("version")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in empty.schema)
    return {
        "log": Kind(LOG, "ocd_id", append=True), "heads": Kind("source string, regs_document_id string, payload_hash string, fetched_at timestamp, observation_id string", "regs_document_id"),
        "projection": Kind(f"{columns}, version int, change_history {projection.HISTORY}", "ocd_id"), "conflicts": Kind(CONFLICTS, "ocd_id"), "broken": Kind(f"{columns}, version int, violations array<string>", "ocd_id", append=True),
        "cursors": Kind("source string, cursor_last_modified timestamp, last_polled_at timestamp", "source"), "stamps": Kind("regs_document_id string, last_checked_at timestamp", "regs_document_id"), "failures": Kind(FAILURES, "document_key"),
    }


def status_step(tables: Tables, fetch: Callable[[DataFrame], DataFrame], version: str, now: Callable[[int], Column], threshold: int = 5) -> Callable[[DataFrame, int], None]:
    """I1 for ``foreachBatch``: a micro-batch of feed rows (id, date, seq) is one cycle and one epoch of ``tables``.

    ``fetch`` gives the details (id, raw, fetched_at, error) of rows (id).  Log, heads, projection, conflicts, cursors, stamps and
    failures move together or not at all, and an epoch that is complete is not run again.  Only the buckets that the
    batch's documents and entities fall into are read and written.
    """

    def step(feed: DataFrame, epoch: int) -> None:
        if epoch in tables.epochs():
            return
        spark = feed.sparkSession
        with steps.scope(spark):
            old = tables.manifest(epoch)
            feed = steps.stored(feed.select("id", "date", "seq"))
            ids = feed.select("id").where("id <> ''").distinct()
            documents = tables.buckets_of(ids, "id")
            failures = tables.read("failures", documents, old)
            asked = ids.join(dead_keys(failures, reconcile.STATUS).select(F.col("document_key").alias("id")), "id", "left_anti")
            seen = status_read(failures, feed, steps.stored(fetch(asked).select("id", "raw", "fetched_at", "error")), version)
            entities = tables.buckets_of(seen["read"], "ocd_id")
            # a payload may name another document than the one that was asked for
            documents = sorted({*documents, *tables.buckets_of(seen["read"], "regs_document_id")})
            state = {n: tables.read(n, documents, old) for n in ("heads", "stamps", "failures")} | {n: tables.read(n, entities, old) for n in ("log", "projection", "conflicts")} | {"cursors": tables.read("cursors", None, old)}
            after, counts = status_merge(state, seen, now(epoch), threshold)
            changes = {n: (after[n], documents) for n in ("heads", "stamps", "failures")} | {n: (after[n], entities) for n in ("projection", "conflicts", "broken")} | {"log": (after["new"], entities), "cursors": (after["cursors"], None)}
            tables.commit(epoch, changes, counts)

    return step


def repoll_batch(eligible: DataFrame, budget: int | None = 200, key: str = "regs_document_id") -> tuple[DataFrame, DataFrame]:
    """The stalest rows within the budget (absent or below 0: the default) and the counts."""
    return projection.budget_cut(eligible, 200 if budget is None or budget < 0 else budget, [F.col("last_checked_at").asc_nulls_first(), F.col(key)])


def gold_template(cache: DataFrame, kinds: Sequence[str], cap: int = 10) -> DataFrame:
    """Rows to be labelled: real adjudicators' verdicts, one per hash, capped per kind and class, ``gold`` null."""
    real = cache.where(~F.col("adjudicator_id").startswith("null:") & F.col("kind").isin(*kinds))
    return chain.stratified(real, ["kind", "classification"], "content_hash", "created_at", cap).withColumn("gold", F.lit(None).cast("string"))


def evaluate(gold: DataFrame, predictions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Scores over the whole gold set; a missing or failed prediction counts as wrong for the gate."""
    j = gold.join(predictions.select("content_hash", "classification"), "content_hash", "left")
    one = chain.score_binary(j.where("classification IS NOT NULL"), F.col("gold") == "affirm", F.col("classification") == "affirm")
    total = gold.agg(F.count("*").alias("n_gold"))
    return one.crossJoin(total).withColumn("gate", F.try_divide(F.col("tp") + F.col("tn"), F.col("n_gold"))).withColumn("passed", F.coalesce(F.col("gate") >= threshold, F.lit(False)))


def regression_fixtures(records: DataFrame, watches: DataFrame, windows: DataFrame, since: DataFrame, stamps: DataFrame | None = None) -> DataFrame:
    """One nested document {meta, input, expected} for each accuracy record.

    ``meta`` holds the window's documents, its confidence and display at the close and, given ``stamps``, the last re-check.
    """
    key = ["ocd_id", "window_version"]
    own = windows.select("ocd_id", "resolved_close_utc", "status", *[c for c in ("fr_document_number", "regs_document_id") if c in windows.columns])
    j = records.join(watches.select(*key, "snapshotted_at"), key, "left").join(own, "ocd_id", "left").join(since, key, "left")
    if stamps is not None:
        j = j.join(stamps.select("regs_document_id", "last_checked_at"), "regs_document_id", "left")
    meta = [c for c in (*key, "fr_document_number", "regs_document_id", "confidence_at_close", "published_close_display", "snapshotted_at", "last_checked_at") if c in j.columns]
    return j.select(
        F.struct(*meta).alias("meta"),
        F.struct(
            F.col("published_close_utc").alias("publishedCloseUtc"), F.col("resolved_close_utc").alias("currentCloseUtc"), F.col("status").alias("currentStatus"), F.coalesce("since", F.array().cast(verify.SINCE)).alias("observationsSinceClose"),
            F.col("basis").eqNullSafe("unverified_lapsed").alias("lapsed"),
        ).alias("input"),
        F.struct("was_correct", "basis", "contradicting_observation_ids").alias("expected"),
    )


def statement_report(docs: DataFrame, title: str, close: str) -> DataFrame:
    """One row: documents, and those with a close date, a stage and a state."""
    t = S.squeeze(F.col(title))
    rows = docs.where(t.isNotNull()).select(F.col(close).alias("close"), F.when(S.stage(t) != "—", S.stage(t)).alias("stage"), F.array_join(S.states_in(t), ",").alias("state"))
    return crosscheck.field_coverage(rows, ["close", "stage", "state"])


def join_rate_report(status: DataFrame, primary: DataFrame, key: str, value: str, arrays: str, least: float = 60.0) -> DataFrame:
    """One row: how many status rows join by key, how many more by the fallback, both together, and go or no-go."""
    rate = crosscheck.join_rate(status, primary, key)
    found = crosscheck.coverage(rate, crosscheck.fallback_matches(status, primary, key, value, arrays))
    return crosscheck.enough(found, "combined", least)


def conflict_report(primary: DataFrame, status: DataFrame, key: str, a_day: str, b_instant: str, order: Sequence[str], n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The two feeds joined on their key: (one row of counts and rates, the first pairs whose days differ in UTC only).

    ``b_instant`` is text.  An instant without an offset can't be compared (F9); such pairs are counted as ``n_refused`` and set apart.
    """
    pairs = primary.where(F.col(key).isNotNull()).join(status.select(key, *[c for c in status.columns if c != key]), key)
    marked = pairs.withColumn("_ok", F.col(b_instant).isNull() | S.has_offset(F.col(b_instant)))
    refused = marked.agg(F.count_if(~F.col("_ok")).alias("n_refused"))
    rows = marked.where("_ok").drop("_ok").withColumn(b_instant, S.utc_instant(F.col(b_instant)))
    counts = crosscheck.date_conflicts(rows, a_day, b_instant).crossJoin(refused)  # one row each
    return counts, crosscheck.zone_samples(rows, a_day, b_instant, [F.col(c) for c in order], n)


def density_report(docs: DataFrame, kind: str, title: str, day: str, today: Column, n_quarters: int = 4, least_average: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(candidates by quarter and bucket, the one-row summary with its verdict)."""
    rows = docs.withColumn("_bucket", S.topic_bucket(F.col(kind), F.col(title))).where("_bucket IS NOT NULL").select(F.col(day).alias("_on"), "_bucket")
    counts = crosscheck.density(rows, "_on", "_bucket", today, n_quarters, ("EIS", "Rulemaking"))
    return counts, crosscheck.density_summary(counts, ("EIS", "Rulemaking"), least_average)


def primary_ingest(state: dict[str, DataFrame], found: DataFrame, details: DataFrame, now: Column, version: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """One cycle of the primary source up to the log: (log, bridge, failures and entities to reconcile after it, one-row summary).

    ``found`` lists document numbers, ``details`` (fr_document_number, raw, fetched_at, error) is what fetching gave.  Numbers in the log or dead are not
    fetched; a document that is missing, unreadable or in error has failed and counts towards its dead letter.
    """
    dead = dead_keys(state["failures"], reconcile.PRIMARY)
    todo, one = primary_cycle(found, state["log"], dead)
    key = "fr_document_number"
    live = steps.stored(todo.select(key).distinct().join(details.select(key, "raw", "fetched_at", F.col("error").alias("fetch_error")), key, "left"))
    good, rejects = files.primary_observations(live.where("raw IS NOT NULL AND fetch_error IS NULL").withColumnRenamed(key, "_asked"), version)
    read = steps.stored(good.withColumn("observation_id", F.sha2(F.concat_ws("|", "source", key, "payload_hash", F.col("fetched_at").cast("string")), 256)).drop("fetch_error"))
    bad = live.where("raw IS NULL OR fetch_error IS NOT NULL").select(key, F.coalesce("fetch_error", F.lit("no details")).alias("error")).unionByName(rejects.select(F.col("_asked").alias(key), "error"))
    failed = bad.dropDuplicates([key]).select(F.lit(reconcile.PRIMARY).alias("source"), F.col(key).alias("document_key"), "error")
    ok = read.select(F.lit(reconcile.PRIMARY).alias("source"), F.col("_asked").alias("document_key")).distinct()
    new, targets = ledger.ingest(state["log"], state["bridge"], read.select(*state["log"].columns))
    new, n_new = steps.counted(new, ingested=F.count("*"))
    cleared, recovered = projection.clear_failures(state["failures"], ok)
    failures, n_failed = steps.counted(projection.merge_failures(cleared, failed, now), failed=F.count_if(F.col("last_failed_at") == now), dead_lettered=F.count_if("newly_dead"))
    after = {"log": state["log"].unionByName(new), "bridge": state["bridge"].unionByName(targets), "failures": failures.drop("newly_dead"), "entities": read.select("ocd_id").distinct()}
    summary = one.crossJoin(recovered.agg(F.count("*").alias("recovered")))  # one row each
    return after, summary.withColumns({k: F.lit(v) for k, v in (n_new | n_failed).items()})
