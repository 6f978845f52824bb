"""Read models (P1-P12, O1-O7, J17, J20, W7-W9, A9, A10): filters, pages, details, feeds, timelines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimledger.operators.steps import pinned

MOST_ROWS, USUAL_ROWS = 200, 50


def clamp(limit: int | None, offset: int | None) -> tuple[int, int]:
    """Absent limit 50, 0 to 200; absent or negative offset 0."""
    return (USUAL_ROWS if limit is None else min(max(0, limit), MOST_ROWS)), max(0, offset or 0)


def window_filter(confidence=None, status=None, docket=None, before=None, after=None) -> Column:
    """The AND of the filters given; a range excludes rows without a close."""
    close, parts = F.col("resolved_close_utc"), []
    if confidence is not None:
        parts.append(F.col("confidence") == confidence)
    if status is not None:
        parts.append(F.col("status") == status)
    if docket is not None:
        parts.append(F.array_contains("docket_id", docket))
    if before is not None:
        parts.append(close.isNotNull() & (close < F.lit(before).cast("timestamp")))
    if after is not None:
        parts.append(close.isNotNull() & (close > F.lit(after).cast("timestamp")))
    return reduce(and_, parts, F.lit(True))


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """O1, O2: one page of a total order; Spark takes the top rows without sorting all of them."""
    n, skip = clamp(limit, offset)
    return df.orderBy(*order).offset(skip).limit(n)


def list_windows(projection: DataFrame, limit: int | None = None, offset: int | None = None, **filters) -> tuple[DataFrame, DataFrame, int, int]:
    """(page, one-row total of the filtered set, effective limit, effective offset)."""
    rows = projection.where(window_filter(**filters))
    n, skip = clamp(limit, offset)
    return page(rows, [F.col("resolved_close_utc").asc_nulls_last(), F.col("ocd_id")], n, skip), rows.agg(F.count("*").alias("total")), n, skip


#: The order of conflict rows: the latest first, then by what names a row.
CONFLICT_ORDER = ("ocd_id", "observation_a_id", "observation_b_id", "ocd_id_b")


def list_conflicts(conflicts: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """One page of the conflict rows, latest first, in a total order: nulls of the last key come first."""
    return page(conflicts, [F.col("detected_at").desc_nulls_last(), *[F.col(k).asc_nulls_first() for k in CONFLICT_ORDER]], limit, offset)


def window(projection: DataFrame, ident: str) -> DataFrame:
    """P5: the row of one entity; no row when it is absent."""
    return projection.where(F.col("ocd_id") == ident)


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """A dashboard's list of the first ``n`` rows, whatever the page limit."""
    return df.orderBy(*order).limit(n)


def dashboard_lists(projection: DataFrame, n: tuple[int, int, int] = (400, 30, 12)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows by close, moved windows by close, conflicting windows by derivation, the newest first."""
    by_close = [F.col("resolved_close_utc").asc_nulls_last(), F.col("ocd_id")]
    moved = projection.withColumn("n_moved", F.size("change_history")).where("n_moved > 0")
    clash = projection.where("confidence = 'conflicting'")
    return first_rows(projection, by_close, n[0]), first_rows(moved, by_close, n[1]), first_rows(clash, [F.col("derived_at").desc(), F.col("ocd_id")], n[2])


def counters(windows: DataFrame, observations: DataFrame, conflicts: DataFrame, agencies: Column, now: Column, days: int = 30) -> DataFrame:
    """One row of dashboard counters, one pass over each table; ``agencies`` is an array of names per observation."""
    soon = F.col("resolved_close_utc").between(now, now + F.make_interval(days=F.lit(days)))
    level = lambda c: F.count_if(F.col("confidence") == c).alias(f"n_{c}")
    w = windows.agg(
        F.count("*").alias("n_windows"), F.count_if(F.col("status") == "open").alias("n_open"), F.count_if((F.col("status") == "open") & soon).alias("n_soon"), level("high"), level("conflicting"),
        F.count_if(F.size("change_history") > 0).alias("n_moved"), F.count_if(F.col("resolved_close_utc").isNull()).alias("n_without_close"),
    )
    o = observations.agg(F.count("*").alias("n_observations"), F.max("fetched_at").alias("latest"))
    names = observations.select(F.explode(agencies).alias("agency")).agg(F.count_distinct("agency").alias("n_agencies"))
    c = conflicts.agg(F.count_if(F.col("resolved_at").isNull()).alias("n_live_conflicts"))
    return w.crossJoin(o).crossJoin(names).crossJoin(c)  # one row each


def conflict_feed(conflicts: DataFrame, entity: str | None = None, live_only: bool = True) -> DataFrame:
    """Live rows, of one entity on either side; the empty string names no entity."""
    rows = conflicts.where("resolved_at IS NULL") if live_only else conflicts
    if entity is None:
        return rows
    return rows.where(F.lit(entity != "") & ((F.col("ocd_id") == entity) | F.coalesce(F.col("ocd_id_b") == entity, F.lit(False))))


def with_details(entities: DataFrame, details: DataFrame, key: str, newest: Sequence[str], fields: Sequence[str], out: str = "observations") -> DataFrame:
    """Nests an entity's detail rows, newest first; none gives an empty array."""
    rows = details.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*newest, *fields)), asc=False).alias(out))
    j = entities.join(rows, key, "left")
    return j.withColumn(out, F.coalesce(out, F.array().cast(rows.schema[out].dataType)))


def latest_join(entities: DataFrame, documents: DataFrame, key: str, order: Column, how: str = "inner") -> DataFrame:
    """Each entity with its key's latest document row."""
    newest = documents.groupBy(key).agg(F.max_by(F.struct(*[c for c in documents.columns if c != key]), order).alias("latest"))
    return entities.join(newest, key, how)


def top_groups(df: DataFrame, by: Sequence[str], n: int = 12) -> DataFrame:
    """A10: groups by falling count, then by name."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by).limit(n)


def ranks(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Adds ``rank`` (from 1) over the whole table without one task for all rows.

    Rows are dealt by range and stored, so that ranks inside a range and the sizes of the earlier
    ranges belong to one deal (two plans of a deal can sample other bounds).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pinned(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # one row per partition
    inside = Window.partitionBy("_part").orderBy(*order)
    j = dealt.withColumn("_rank", F.row_number().over(inside)).join(F.broadcast(before), "_part")
    return j.withColumn("rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_part", "_rank", "_before")


def stride_sample(df: DataFrame, order: Sequence[str], n: int = 50, total: int | None = None) -> DataFrame:
    """Every s-th row of the order, s = max(1, total // n), at most ``n``."""
    step = max(1, (df.count() if total is None else total) // n)
    return ranks(df, order).where((F.col("rank") - 1) % step == 0).orderBy("rank").limit(n)


def with_changes(events: DataFrame, changes: DataFrame, key: str, at: str, kind: str, name: str = "change") -> DataFrame:
    """Events with the change events (key, at) spliced in; order by ``at`` and ``_spliced``: a change stands before what was seen at its time."""
    spliced = changes.select(key, at, F.lit(name).alias(kind), F.lit(0).alias("_spliced"))
    return events.withColumn("_spliced", F.lit(1)).unionByName(spliced, allowMissingColumns=True)


def timeline(events: DataFrame, key: str, order: Sequence[str], kind: str, beats: Sequence[str]) -> DataFrame:
    """Per entity its beats (first sighting of a kind, or a kind in ``beats``), runs of routine rows as one row with a count."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(Window.partitionBy(key, kind).orderBy(*order)) == 1
    beat = first | F.col(kind).isin(*beats)
    rows = events.withColumn("_beat", beat).withColumn("_n", F.row_number().over(w))
    rows = rows.withColumn("_island", F.when(F.col("_beat"), F.col("_n")).otherwise(-F.sum(F.col("_beat").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    runs = rows.groupBy(key, "_beat", "_island").agg(F.min("_n").alias("first_n"), F.count("*").alias("n_rows"), F.min_by(kind, "_n").alias("_kind"))
    label = F.when(F.col("_beat"), F.col("_kind")).otherwise("routine")
    return runs.select(key, F.row_number().over(Window.partitionBy(key).orderBy("first_n")).alias("position"), label.alias("event"), "n_rows")


def last_change(projection: DataFrame) -> DataFrame:
    """Adds old_close and changed_at of the last change, null if there was none."""
    last = F.try_element_at("change_history", F.lit(-1))
    return projection.withColumn("old_close", last["resolved_close_utc"]).withColumn("last_changed_at", last["changed_at"])


def pick_exhibit(moved: DataFrame, matches: Column, order: Sequence[Column]) -> DataFrame:
    """The first row that matches, else the first of all."""
    return moved.orderBy((~F.coalesce(matches, F.lit(False))).asc(), *order).limit(1)
