"""Post-deadline verification (E1-E9, J10-J13, A8): every watch at once, no per-entity reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger.operators.steps import stored

#: Observations from which on an entity is joined apart from the others.
CROWD = 10_000
SINCE = "array<struct<observation_id: string, fetched_at: timestamp, is_extension: boolean, is_correction: boolean, is_withdrawal: boolean, is_reopening: boolean>>"


def linked_observations(observations: DataFrame, bridge: DataFrame | None) -> DataFrame:
    """(entity, observation) by own key or bridge: a union instead of an OR join."""
    own = observations.where("ocd_id IS NOT NULL").select(F.col("ocd_id").alias("entity"), *observations.columns)
    if bridge is None:
        return own
    other = bridge.select("observation_id", F.col("ocd_id").alias("entity")).join(observations, "observation_id")
    return own.unionByName(other.select("entity", *observations.columns)).dropDuplicates(["entity", "observation_id"])


def snapshot_scope(windows: DataFrame, watches: DataFrame, records: DataFrame, linked: DataFrame, now: Column) -> DataFrame:
    """Windows to put under watch.

    The nested NOT EXISTS become one aggregate per entity: is a watch unresolved, and what was the
    latest close that was watched.
    """
    key = ["ocd_id", "window_version"]
    seen = watches.join(records.select(*key, F.lit(True).alias("_done")), key, "left")
    per = seen.groupBy("ocd_id").agg(F.bool_or(F.col("_done").isNull()).alias("_open"), F.max("published_close_utc").alias("_watched"))
    closed = windows.where(F.col("resolved_close_utc").isNotNull() & (F.col("resolved_close_utc") <= now))
    gone = linked.where("is_withdrawal").groupBy(F.col("entity").alias("ocd_id")).agg(F.max("fetched_at").alias("_withdrawn_at"))
    j = closed.join(per, "ocd_id", "left").join(gone, "ocd_id", "left")
    live = (F.col("status") != "withdrawn") | F.coalesce(F.col("_withdrawn_at") > F.col("resolved_close_utc"), F.lit(False))
    fresh = ~F.coalesce("_open", F.lit(False)) & (F.col("_watched").isNull() | (F.col("_watched") < F.col("resolved_close_utc")))
    rows = j.where(live & fresh)
    return rows.select("ocd_id", F.col("version").alias("window_version"), F.col("confidence").alias("confidence_at_close"), F.col("resolved_close_utc").alias("published_close_utc"), F.col("resolved_close_display").alias("published_close_display"), now.alias("snapshotted_at")).join(watches.select(*key), key, "left_anti")


def horizon_state(close: Column, checked_at: Column, snapshotted_at: Column, now: Column, horizon_days: int = 7, cap_days: int = 14) -> Column:
    """E3, E4."""
    end, cap = close + F.make_interval(days=F.lit(horizon_days)), close + F.make_interval(days=F.lit(cap_days))
    return (
        F.when(snapshotted_at > cap, "due_lapsed").when(now <= close, "not_due").when(now <= end, "in_horizon")
        .when(F.coalesce(checked_at > close, F.lit(False)), "due_verdict").when(now <= cap, "awaiting_check").otherwise("due_lapsed")
    )


def post_close(watches: DataFrame, linked: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Adds ``since``, the observations strictly after the close, and ``observed_at``, the last of them.

    Entities of more than ``crowd`` observations are few; their watches are broadcast to the observations, so no task reads all
    observations of an entity, be it watched or not.
    """
    w = watches.select("ocd_id", "window_version", "published_close_utc")
    crowded = F.broadcast(linked.groupBy("entity").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select("entity"))
    late = (F.col("ocd_id") == F.col("entity")) & (F.col("fetched_at") > F.col("published_close_utc"))
    observed = linked.select("entity", "observation_id", "fetched_at", "is_extension", "is_correction", "is_withdrawal", "is_reopening")
    few = w.join(observed.join(crowded, "entity", "left_anti"), late)
    watched = F.broadcast(w.join(crowded, F.col("ocd_id") == F.col("entity"), "left_semi"))
    after = few.unionByName(observed.join(crowded, "entity", "left_semi").join(watched, late).select(*few.columns))
    seen = F.struct("observation_id", "fetched_at", "is_extension", "is_correction", "is_withdrawal", "is_reopening")
    got = after.groupBy("ocd_id", "window_version").agg(F.collect_list(seen).alias("since"), F.max("fetched_at").alias("observed_at"))
    return watches.join(got, ["ocd_id", "window_version"], "left").withColumn("since", F.coalesce("since", F.array().cast(SINCE)))


def open_watches(watches: DataFrame, windows: DataFrame, records: DataFrame, stamps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(watches without a record, with their window's current close and re-check stamp; rows that can't be judged, with ``error``)."""
    key = ["ocd_id", "window_version"]
    now_at = windows.select("ocd_id", "regs_document_id", F.col("resolved_close_utc").alias("current_close_utc"), F.lit(True).alias("_window"))
    j = watches.join(records.select(*key), key, "left_anti").join(now_at, "ocd_id", "left").join(stamps.select("regs_document_id", "last_checked_at"), "regs_document_id", "left")
    error = F.when(F.col("_window").isNull(), "no window").when(F.col("published_close_utc").isNull(), "no published close").when(F.col("snapshotted_at").isNull(), "no snapshot time")
    rows = j.withColumn("error", error).drop("_window", "regs_document_id")
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL")


def verification_run(windows: DataFrame, watches: DataFrame, records: DataFrame, observations: DataFrame, bridge: DataFrame | None, stamps: DataFrame, now: Column) -> dict[str, DataFrame]:
    """E1-E8 as one job: ``watches`` and ``records`` as they are after it, ``new`` records, ``set_aside`` rows and a ``summary``."""
    linked = stored(linked_observations(observations, bridge))  # read four times
    fresh = snapshot_scope(windows, watches, records, linked, now)
    all_ = watches.unionByName(fresh)
    rows, set_aside = open_watches(all_, windows, records, stamps)
    seen = post_close(rows, linked)
    stamp = F.when(F.col("last_checked_at") > F.col("published_close_utc"), F.col("last_checked_at"))
    seen = seen.withColumn("observed_at", F.greatest("observed_at", stamp))  # E2; greatest passes over nulls
    judged = seen.withColumn("state", horizon_state(F.col("published_close_utc"), F.col("observed_at"), F.col("snapshotted_at"), now))
    new = verdicts(judged, now)
    return {"watches": all_, "records": records.unionByName(new), "new": new, "set_aside": set_aside, "summary": verdict_counts(new)}


def verdict_counts(records: DataFrame) -> DataFrame:
    """Records by basis and verdict (null: lapsed)."""
    return records.groupBy("basis", "was_correct").agg(F.count("*").alias("n"))


def replay_fixtures(fixtures: DataFrame) -> DataFrame:
    """Fixtures {meta, input, expected} that are broken, with ``differs``; none should be.

    The whole verdict is computed again, lapsed watches included (``input.lapsed``; missing: by the expected basis), and compared field by field,
    nulls being equal to nulls: was_correct, basis, contradicting_observation_ids.  ``invariant``: the expected verdict breaks
    a rule of V1 (lapsed and no verdict go together, a miss names its evidence and nothing else does).
    """
    expected = F.col("expected")
    lapsed = F.coalesce(F.col("input.lapsed"), F.lit(False)) if "lapsed" in fixtures.schema["input"].dataType.names else expected["basis"].eqNullSafe("unverified_lapsed")
    ids = F.when(lapsed, F.array().cast("array<string>")).otherwise(contradictions(F.col("input.observationsSinceClose"), F.col("input.publishedCloseUtc"), F.col("input.currentCloseUtc")))
    rows = fixtures.withColumn("_ids", ids)
    got = {"was_correct": F.when(~lapsed, F.size("_ids") == 0), "basis": basis_of(lapsed, F.col("_ids")), "contradicting_observation_ids": F.col("_ids")}
    want = {"was_correct": expected["was_correct"], "basis": expected["basis"], "contradicting_observation_ids": F.array_sort(expected["contradicting_observation_ids"])}
    n_ids = F.size(F.coalesce(expected["contradicting_observation_ids"], F.array().cast("array<string>")))
    unsound = (expected["basis"].eqNullSafe("unverified_lapsed") != expected["was_correct"].isNull()) | (~F.coalesce(expected["was_correct"], F.lit(True)) != (n_ids > 0))
    differs = F.array_compact(F.array(*[F.when(~got[k].eqNullSafe(want[k]), k) for k in got], F.when(unsound, "invariant")))
    return rows.withColumn("differs", differs).where(F.size("differs") > 0).drop("_ids")


def basis_of(lapsed: Column, ids: Column) -> Column:
    """E5: what a verdict rests on."""
    return F.when(lapsed, "unverified_lapsed").when(F.size(ids) > 0, "late_amendment").otherwise("post_close_repoll")


def contradictions(since: Column, published: Column, current: Column) -> Column:
    """Sorted ids of the observations that contradict the published close; empty if none do."""
    moved = ~current.eqNullSafe(published)
    later = F.coalesce(current > published, F.lit(False))
    fires = lambda o: o["is_withdrawal"] | (o["is_correction"] & moved) | (o["is_extension"] & moved & later & ~o["is_reopening"])
    some = F.transform(F.filter(since, fires), lambda o: o["observation_id"])
    all_ = F.transform(since, lambda o: o["observation_id"])
    reopened = F.exists(since, lambda o: o["is_reopening"]) & later
    ids = F.when(F.size(some) > 0, some).when(moved & ~reopened, all_).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(ids))


def verdicts(watches: DataFrame, now: Column) -> DataFrame:
    """E5: records for watches that are due; columns since, current_close_utc and state are given."""
    lapsed = F.col("state") == "due_lapsed"
    ids = contradictions(F.col("since"), F.col("published_close_utc"), F.col("current_close_utc"))
    rows = watches.where(F.col("state").isin("due_verdict", "due_lapsed")).withColumn("_ids", F.when(lapsed, F.array().cast("array<string>")).otherwise(ids))
    basis = basis_of(lapsed, F.col("_ids"))
    return rows.select(
        "ocd_id", "window_version", "confidence_at_close", "published_close_utc", "published_close_display", F.when(~lapsed, F.size("_ids") == 0).alias("was_correct"), basis.alias("basis"),
        F.col("_ids").alias("contradicting_observation_ids"), F.col("published_close_utc").alias("closed_at_utc"), now.alias("verified_at_utc"),
    )


def high_ratio(records: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Share of correct ones among high-confidence records of the last days; null without any."""
    rows = records.where((F.col("confidence_at_close") == "high") & (F.col("basis") != "unverified_lapsed") & (F.col("closed_at_utc") >= now - F.make_interval(days=F.lit(days))))
    return rows.agg(F.count("*").alias("n"), F.count_if("was_correct").alias("n_correct")).withColumn("ratio", F.try_divide("n_correct", "n"))
