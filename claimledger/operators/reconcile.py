"""Cross-source reconcile (R1-R13) and row invariants (V1): one ordered CASE over each entity's latest claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger.functions import scalars as S
from claimledger.operators.projection import HISTORY, dealt, previous, running
from claimledger.operators.steps import once, stored

PRIMARY, STATUS = "federal_register", "regulations_gov"


def latest_claims(log: DataFrame, a: str = PRIMARY, b: str = STATUS, fields=None) -> DataFrame:
    """Per entity structs ``a`` and ``b`` with the latest observation of either source.

    Of equal times the smallest observation id wins; rows without a time are the oldest.  One shuffle
    by entity, with partial aggregation.
    """
    cols = fields or [c for c in log.columns if c not in ("ocd_id", "source")]
    newest_first = F.struct(F.coalesce(-F.unix_micros(F.col("fetched_at").cast("timestamp")), F.lit(2**63 - 1)).alias("age"), "observation_id")
    pick = lambda s: F.min_by(F.struct(*cols), F.when(F.col("source") == s, newest_first))
    return log.where(F.col("source").isin(a, b)).groupBy("ocd_id").agg(pick(a).alias("a"), pick(b).alias("b"))


def extract_primary(raw: Column) -> dict[str, Column]:
    """Fields of a primary document; nulls for what is missing or of another type."""
    return primary_fields(F.try_parse_json(raw))


def primary_fields(v: Column) -> dict[str, Column]:
    """The same of JSON that is parsed already, best in a column of its own."""
    rins = S.clean_list(S.json_strings(v, "$.regulation_id_numbers"))
    return {
        "document_number": S.json_string(v, "$.document_number"), "close_date": S.calendar_date(S.json_string(v, "$.comments_close_on")),
        "publication_date": S.json_string(v, "$.publication_date"), "comment_url": S.json_string(v, "$.comment_url"), "title": S.json_string(v, "$.title"),
        "docket_ids": S.json_strings(v, "$.docket_ids"), "rins": rins, "rin": S.first_or_null(rins), "dates_text": S.json_string(v, "$.dates"),
        "document_id": S.json_string(v, "$.regulations_dot_gov_info.document_id"), "object_id": S.json_string(v, "$.regulations_dot_gov_info.object_id"),
    }


def extract_status(raw: Column) -> dict[str, Column]:
    """Fields of a status document; booleans only where the JSON has booleans."""
    return status_fields(F.try_parse_json(raw))


def status_fields(v: Column) -> dict[str, Column]:
    """The same of JSON that is parsed already, best in a column of its own."""
    at = "$.data.attributes."
    return {
        "document_id": S.json_string(v, "$.data.id"), "document_number": S.json_string(v, at + "frDocNum"), "object_id": S.json_string(v, at + "objectId"),
        "docket_id": S.json_string(v, at + "docketId"), "raw_end": S.json_string(v, at + "commentEndDate"), "open": S.json_bool(v, at + "openForComment"),
        "withdrawn": S.json_bool(v, at + "withdrawn"), "allow_late": S.json_bool(v, at + "allowLateComments"), "title": S.json_string(v, at + "title"),
    }


def claim_columns(now: Column) -> dict[str, Column]:
    """The CASE of R1-R10 over columns a_id, a_date (real yyyy-mm-dd or null), b_id, b_raw_end, b_close, b_open, b_withdrawn, b_allow_late."""
    c = F.col
    yes, no = lambda x: F.coalesce(x, F.lit(False)), lambda x: F.coalesce(~x, F.lit(False))
    a_there, b_there = c("a_date").isNotNull(), c("b_close").isNotNull()
    a_close, ny = S.end_of_new_york_day(c("a_date")), S.new_york_date(c("b_close"))
    a_day = F.try_to_date(c("a_date"), "yyyy-MM-dd")
    r1, r2 = yes(c("b_withdrawn")) & a_there, yes(c("b_withdrawn"))
    both, equal = a_there & b_there, yes(a_day == ny)
    r7 = c("b_id").isNotNull() & c("b_raw_end").isNull() & yes(c("b_open"))
    cases = ((r1, "R1"), (r2, "R2"), (both & ~equal, "R3"), (both & no(c("b_open")), "R4"), (both, "R5"), (b_there, "R6"), (r7, "R7"), (a_there, "R8"))
    branch = None
    for cond, name in cases:
        branch = F.when(cond, name) if branch is None else branch.when(cond, name)
    branch = branch.otherwise("R9")
    b = c("branch")
    close = F.when(b.isin("R1", "R2"), F.coalesce(c("b_close"), a_close)).when(b.isin("R3", "R4", "R5", "R6"), c("b_close")).when(b.isin("R7", "R8"), a_close)
    low_or_unknown = F.when(a_there | b_there, "low").otherwise("unknown")
    confidence = (
        F.when(b.isin("R1", "R3"), "conflicting").when(b.isin("R2", "R7"), low_or_unknown).when(b == "R5", "high").when(b.isin("R4", "R6"), "medium")
        .when((b == "R8") & c("b_id").isNotNull(), "medium").when(b == "R8", "low").otherwise("unknown")
    )
    late = F.when(yes(c("b_allow_late")), "late_comment_ambiguous")
    flag = (
        F.when(b == "R1", "withdrawn_vs_open").when(b == "R3", "fr_regs_date_mismatch").when(b.isin("R4", "R5") & (a_day != F.to_date("b_close")), "tz_normalization_only")
        .when(b == "R6", late).when(b == "R7", "null_end_date_open_status").when((b == "R8") & c("b_id").isNotNull(), late)
    )
    status = F.when(yes(c("b_withdrawn")), "withdrawn").when(yes(c("b_open")) | yes(c("resolved_close_utc") > now), "open").when(yes(c("resolved_close_utc") <= now), "closed").otherwise("unknown")
    return {"branch": branch, "resolved_close_utc": close, "confidence": confidence, "conflict_flags": F.array_compact(F.array(flag)), "status": status}


def reconcile_claims(claims: DataFrame, now: Column) -> DataFrame:
    """Adds branch, resolved_close_utc, resolved_close_display, confidence, conflict_flags, status."""
    out, columns = claims, claim_columns(now)
    for name in ("branch", "resolved_close_utc"):  # what the others are made of
        out = once(out, out.columns, **{name: columns[name]})
    out = once(out, out.columns, **{n: columns[n] for n in ("confidence", "conflict_flags", "status")})
    shown = F.when(F.col("b_close").isNotNull(), S.close_display(S.new_york_date(F.col("b_close")), inferred=False)).otherwise(S.close_display(F.col("a_date"), inferred=True))
    return out.withColumn("resolved_close_display", F.when(F.col("resolved_close_utc").isNotNull(), shown))


def reconcile_log(log: DataFrame, now: Column) -> DataFrame:
    """R1-R12 from raw observations: the projection's columns, one row per entity, version 0 and no history.

    R13: ``checked`` splits the result into rows that keep the invariants and rows that do not.
    """
    return derive(latest_claims(log, fields=["observation_id", "raw", "fetched_at"]), now)


def replay_log(log: DataFrame, now: Column) -> DataFrame:
    """T4: (ocd_id, version, resolved_close_utc, history) of ``replay_projection``; history holds the earlier closes (_n, since, close)."""
    whole = replay_projection(log, now)
    history = F.transform("change_history", lambda h: F.struct((h["version"] + 1).alias("_n"), h["changed_at"].alias("until"), h["resolved_close_utc"].alias("close")))
    return whole.select("ocd_id", "version", "resolved_close_utc", history.alias("history"))


def replay_projection(log: DataFrame, now: Column, blocks: int | None = None) -> DataFrame:
    """T4: the whole projection from a whole log: every column, version and change history.

    What cycles that merge one instant after the other arrive at: each entity is reconciled at each of its instants, and where the close
    differs from the one before, the old version, close and observation ids go into the history at that instant.  ``status`` and
    ``derived_at`` are those at ``now``.  Documents are parsed once for each observation.  The latest claim of either source so far
    comes from a segmented scan, so an entity of any length is spread over tasks.  Of one source's observations at one
    instant the smallest id counts; rows without an entity or an instant are left out.
    """
    key, at = ["ocd_id"], ["fetched_at"]
    pick = lambda s: F.min_by(F.struct("observation_id", "raw"), F.when(F.col("source") == s, F.col("observation_id")))
    one = log.where(F.col("source").isin(PRIMARY, STATUS) & F.col("ocd_id").isNotNull() & F.col("fetched_at").isNotNull()).groupBy("ocd_id", "fetched_at").agg(pick(PRIMARY).alias("a"), pick(STATUS).alias("b"))
    # read once the rows are dealt: finding the ranges runs what is before it a second time
    claims = dealt(one, key, at, blocks, lambda rows: read_claims(rows, ["ocd_id", "fetched_at", "_block"]))
    states = running(claims.withColumnsRenamed({"a": "_a", "b": "_b"}), key, at, lasts={"a": F.col("_a"), "b": F.col("_b")}).drop("_a", "_b")
    derived = stored(derive_claims(states, now, ("ocd_id", "fetched_at", "_block")))
    closes = previous(derived.select("ocd_id", "fetched_at", "_block", "resolved_close_utc", "current_observation_ids"), key, at, F.struct("resolved_close_utc", "current_observation_ids"), "old")
    moved = closes.where(F.col("old").isNotNull() & ~F.col("resolved_close_utc").eqNullSafe(F.col("old.resolved_close_utc")))
    steps = moved.groupBy("ocd_id").agg(F.sort_array(F.collect_list(F.struct("fetched_at", "old"))).alias("h"))
    history = F.transform("h", lambda x, i: F.struct(i.cast("int").alias("version"), x["old"]["resolved_close_utc"].alias("resolved_close_utc"), x["old"]["current_observation_ids"].alias("observation_ids"), x["fetched_at"].alias("changed_at")))
    columns = [c for c in derived.columns if c not in ("fetched_at", "_block", "version")]
    last = derived.groupBy(F.col("ocd_id").alias("_k")).agg(F.max_by(F.struct(*columns), "fetched_at").alias("r")).select("r.*")
    return last.join(steps, "ocd_id", "left").withColumn("change_history", F.coalesce(history, F.array().cast(HISTORY))).withColumn("version", F.size("change_history")).drop("h")


def derive(claims: DataFrame, now: Column, keys: Sequence[str] = ("ocd_id",)) -> DataFrame:
    """The projection's columns from structs ``a`` and ``b`` (observation_id, raw) of either source's claim."""
    return derive_claims(read_claims(claims, keys), now, keys)


def read_claims(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Structs of fields from structs ``a`` and ``b`` (observation_id, raw), null where they are; each document is parsed once."""
    parsed = claims.select(*keys, *[F.col(f"{s}.observation_id").alias(f"_{s}_id") for s in "ab"], *[F.try_parse_json(F.col(f"{s}.raw")).alias(f"_{s}_v") for s in "ab"], *[F.col(s).isNotNull().alias(f"_{s}") for s in "ab"])
    claim = lambda s, fields: F.when(F.col(f"_{s}"), F.struct(F.col(f"_{s}_id").alias("observation_id"), *[v.alias(k) for k, v in fields(F.col(f"_{s}_v")).items()]))
    return once(parsed, keys, a=claim("a", primary_fields), b=claim("b", status_fields))


def derive_claims(claims: DataFrame, now: Column, keys: Sequence[str] = ("ocd_id",)) -> DataFrame:
    """The same from structs of fields that are read already."""
    p = claims.withColumnsRenamed({"a": "x", "b": "y"})
    none = F.array().cast("array<string>")
    flat = p.select(
        *keys, F.col("x.observation_id").alias("a_id"), F.col("y.observation_id").alias("b_id"), F.col("x.close_date").alias("a_date"), F.col("y.raw_end").alias("b_raw_end"),
        S.utc_instant(F.col("y.raw_end")).alias("b_close"), F.col("y.open").alias("b_open"), F.col("y.withdrawn").alias("b_withdrawn"), F.col("y.allow_late").alias("b_allow_late"),
        F.coalesce("x.document_number", "y.document_number").alias("fr_document_number"), F.coalesce("y.document_id", "x.document_id").alias("regs_document_id"),
        F.coalesce("y.object_id", "x.object_id").alias("regs_object_id"), F.array_distinct(F.concat(F.coalesce("x.docket_ids", none), F.array_compact(F.array("y.docket_id")))).alias("docket_id"),
        F.col("x.rin").alias("rin"), F.col("x.comment_url").alias("submission_url"), S.reliance_url(F.col("x.publication_date"), F.coalesce("x.document_number", "y.document_number")).alias("govinfo_url"),
        F.lit("comment").alias("window_type"), F.col("x.close_date").alias("raw_fr_close_date"), F.col("y.raw_end").alias("raw_regs_close_datetime"), none.alias("tags"),
    )
    out = reconcile_claims(flat, now).withColumn("current_observation_ids", F.array_compact(F.array("a_id", "b_id")))
    clash = F.col("confidence") == "conflicting"
    agreeing, conflicting = F.when(clash, none).otherwise(F.col("current_observation_ids")), F.when(clash, F.col("current_observation_ids")).otherwise(none)
    return out.withColumn("provenance", F.struct(agreeing.alias("agreeing_observation_ids"), conflicting.alias("conflicting_observation_ids"))).withColumn("derived_at", now).withColumn("version", F.lit(0))


def checked(projection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every invariant, rows that break one, with ``violations``)."""
    broken = violations(projection, "projection")
    return projection.where(F.size(broken_invariants("projection")) == 0), broken


def conflict_rows(projection: DataFrame, now: Column) -> DataFrame:
    """One record for each entity in conflict."""
    rows = projection.where("confidence = 'conflicting'")
    return rows.select(
        "ocd_id", F.col("a_id").alias("observation_a_id"), F.col("b_id").alias("observation_b_id"), F.lit(PRIMARY).alias("source_a"), F.lit(STATUS).alias("source_b"),
        "conflict_flags", "govinfo_url", now.alias("detected_at"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit("cross_source").alias("conflict_scope"),
        F.lit(None).cast("string").alias("ocd_id_b"), F.lit(None).cast("string").alias("govinfo_url_b"),
    )


#: V1: table -> {invariant: SQL condition of a row that breaks it}.
INVARIANTS = {
    "projection": {
        "tz_marker_with_conflict": "confidence = 'conflicting' AND array_contains(conflict_flags, 'tz_normalization_only')",
        "graded_without_close": "confidence IN ('high', 'medium', 'low', 'stale') AND resolved_close_utc IS NULL",
        "unknown_with_close": "confidence = 'unknown' AND resolved_close_utc IS NOT NULL",
    },
    "conflicts": {
        "cross_window_without_other": "conflict_scope = 'cross_window' AND (ocd_id_b IS NULL OR ocd_id_b = ocd_id)",
        "cross_source_with_other": "conflict_scope = 'cross_source' AND ocd_id_b IS NOT NULL",
        "no_flag": "size(conflict_flags) = 0",
    },
    "accuracy": {
        "lapsed_with_verdict": "(basis = 'unverified_lapsed') <> (was_correct IS NULL)",
        "miss_without_evidence": "was_correct = false AND basis <> 'manual' AND size(contradicting_observation_ids) = 0",
        "evidence_without_miss": "coalesce(was_correct, true) AND size(contradicting_observation_ids) > 0",
        "verified_before_close": "verified_at_utc < closed_at_utc",
        "unknown_at_close": "confidence_at_close = 'unknown'",
    },
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """V1: rows that break an invariant, with the names of all they break."""
    return df.withColumn("violations", broken_invariants(table)).where(F.size("violations") > 0)


def broken_invariants(table: str) -> Column:
    """Names of the invariants that a row breaks."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.expr(cond), F.lit(False)), name) for name, cond in INVARIANTS[table].items()]))
