"""Keyed state merges (T3-T7, T8-T13, U3): ``merge(current, incoming, now) -> new state``, each one full outer join."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimledger.operators.steps import stored

HISTORY = "array<struct<version: int, resolved_close_utc: timestamp, observation_ids: array<string>, changed_at: timestamp>>"
CONFLICT_KEY = ("ocd_id", "observation_a_id", "observation_b_id", "ocd_id_b")


def merge_projection(current: DataFrame, derived: DataFrame, now: Column, key: str = "ocd_id", close: str = "resolved_close_utc", ids: str = "current_observation_ids") -> DataFrame:
    """A row's version goes up, and its old state into the history, only when the close changes.

    Entities that ``derived`` does not name keep their row.  Columns other than version and
    change_history come from ``derived``, whose columns they are.
    """
    cols = [c for c in derived.columns if c not in ("version", "change_history")]
    cur = current.select(F.struct(*current.columns).alias("o"), F.col(key).alias("_k"))
    new = derived.select(F.struct(*cols).alias("n"), F.col(key).alias("_k"))
    j = cur.join(new, "_k", "full_outer")
    old_there, new_there = F.col("o").isNotNull(), F.col("n").isNotNull()
    moved = old_there & new_there & ~F.col(f"o.{close}").eqNullSafe(F.col(f"n.{close}"))
    step = F.struct(F.col("o.version").alias("version"), F.col(f"o.{close}").alias("resolved_close_utc"), F.col(f"o.{ids}").alias("observation_ids"), now.alias("changed_at"))
    version = F.when(~old_there, F.lit(0)).when(moved, F.col("o.version") + 1).otherwise(F.col("o.version"))
    history = F.when(~old_there, F.array().cast(HISTORY)).when(moved, F.concat("o.change_history", F.array(step))).otherwise(F.col("o.change_history"))
    kept = [F.when(new_there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in cols]
    return j.select(*kept, version.cast("int").alias("version"), history.alias("change_history"))


def replay(states: DataFrame, key: str, at: str, close: str, tie: str) -> DataFrame:
    """T4: folds the closes an entity had over time into (key, version, close, history).

    ``states``: one row per entity and instant.  Version = number of changes; history holds the
    earlier closes in order.  Null is a close of its own.
    """
    w = Window.partitionBy(key).orderBy(at, tie)
    rows = states.withColumn("_n", F.row_number().over(w)).withColumn("_p", F.lag(close).over(w))
    changes = rows.where((F.col("_n") == 1) | ~F.col(close).eqNullSafe(F.col("_p")))
    runs = changes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", F.col(at).alias("since"), F.col(close).alias("close")))).alias("h"))
    return runs.select(key, (F.size("h") - 1).alias("version"), F.element_at("h", -1)["close"].alias(close), F.slice("h", F.lit(1), F.size("h") - 1).alias("history"))


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None, read: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Rows stored by ranges of (keys, order) with the number of their range in ``_block``: a key of any length is spread over tasks.

    ``read`` makes the stored rows of the dealt ones; ``df`` itself runs twice, once to find the ranges.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(read(df.repartitionByRange(n, *keys, *order).withColumn("_block", F.spark_partition_id())))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """A segmented scan over ``dealt`` rows: running sums, and the last value so far that is not null, of each key in order.

    Rows are scanned inside their block.  What leads over is one row for each key and block: its sum and last value, scanned
    over the blocks and joined back.  Rows with a null key are not seen.
    """
    sums, lasts = sums or {}, lasts or {}
    rows = rows.select("*", *[v.alias(f"_s_{n}") for n, v in sums.items()], *[v.alias(f"_l_{n}") for n, v in lasts.items()])
    ends = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums], *[F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.struct(*order))).alias(f"_l_{n}") for n in lasts])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_block", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums], *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = rows.join(carry, [*keys, "_block"])
    added = {n: F.sum(f"_s_{n}").over(inside) + F.col(f"_c_{n}") for n in sums} | {n: F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(inside), f"_c_{n}") for n in lasts}
    return j.withColumns(added).drop(*[f"_{k}_{n}" for n in added for k in "slc"])


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The value (not null) of the row before, over ``dealt`` rows; null on a key's first row."""
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    rows = rows.withColumn("_v", value)
    ends = rows.groupBy(*keys, "_block").agg(F.max_by("_v", F.struct(*order)).alias("_v"))
    carry = ends.select(*keys, "_block", F.lag("_v").over(Window.partitionBy(*keys).orderBy("_block")).alias("_c"))
    return rows.join(carry, [*keys, "_block"]).withColumn(name, F.coalesce(F.lag("_v").over(inside), "_c")).drop("_v", "_c")


def states_over_time(log: DataFrame, key: str, source: str, at: str, claim: str, sources: Sequence[str]) -> DataFrame:
    """T4: at each instant the latest claim of every source so far, as one column per source."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    cols = [F.last(F.when(F.col(source) == s, F.col(claim)), ignorenulls=True).over(w).alias(s) for s in sources]
    return log.select(key, at, *cols).dropDuplicates([key, at])


def merge_conflicts(current: DataFrame, live: DataFrame, now: Column, scope: str, touched: DataFrame | None = None, keys: Sequence[str] = CONFLICT_KEY) -> DataFrame:
    """Upserts the live set of one scope and retires open rows that are no longer live.

    A row seen again keeps ``detected_at`` and comes back to life.  With ``touched`` (keys ``ocd_id``)
    only those entities' rows are retired; without it all of the scope are.  Other scopes stay.
    """
    mine, rest = current.where(F.col("conflict_scope") == scope), current.where(F.col("conflict_scope") != scope)
    o, n = mine.select(F.struct(*mine.columns).alias("o")), live.select(F.struct(*live.columns).alias("n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    j = o.join(n, on, "full_outer")
    if touched is not None:
        j = j.join(touched.select(F.col("ocd_id").alias("_t")).distinct(), F.col("o.ocd_id") == F.col("_t"), "left")
    seen = F.col("n").isNotNull()
    retire = ~seen & F.col("o.resolved_at").isNull() & (F.lit(True) if touched is None else F.col("_t").isNotNull())
    cols = []
    for c in current.columns:
        value = F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        if c == "detected_at":
            value = F.coalesce(f"o.{c}", f"n.{c}")
        elif c == "resolved_at":
            value = F.when(seen, F.lit(None)).when(retire, now).otherwise(F.col(f"o.{c}"))
        cols.append(value.alias(c))
    return j.select(*cols).unionByName(rest)


def merge_cursor(current: DataFrame, moved: DataFrame, now: Column) -> DataFrame:
    """Forward only, per source; a null cursor in ``moved`` only touches ``last_polled_at``."""
    j = current.withColumnRenamed("cursor_last_modified", "_old").join(moved.select("source", F.col("cursor_last_modified").alias("_new"), F.lit(True).alias("_seen")), "source", "full_outer")
    return j.select("source", F.greatest("_old", "_new").alias("cursor_last_modified"), F.when(F.col("_seen"), now).otherwise(F.col("last_polled_at")).alias("last_polled_at"))


def merge_stamps(current: DataFrame, checked: DataFrame, key: str = "regs_document_id", at: str = "last_checked_at") -> DataFrame:
    """The later stamp stays."""
    return current.select(key, at).unionByName(checked.select(key, at)).groupBy(key).agg(F.max(at).alias(at))


def merge_failures(current: DataFrame, failed: DataFrame, now: Column, threshold: int = 5, retry: bool = False) -> DataFrame:
    """One more attempt each; dead once ``threshold`` is reached, and then for good.

    Adds ``newly_dead``.  With ``retry`` the slow-retry stamp is set as well.
    """
    key = ["source", "document_key"]
    j = current.join(failed.select(*key, F.col("error").alias("_e"), F.lit(True).alias("_f")), key, "full_outer")
    hit = F.coalesce("_f", F.lit(False))
    attempts = F.coalesce("attempts", F.lit(0)) + F.when(hit, 1).otherwise(0)
    dies = hit & (attempts >= threshold) & F.col("dead_lettered_at").isNull()
    return j.select(
        *key, attempts.cast("int").alias("attempts"), F.coalesce("first_failed_at", now).alias("first_failed_at"), F.when(hit, now).otherwise(F.col("last_failed_at")).alias("last_failed_at"),
        F.when(hit, F.substring("_e", 1, 500)).otherwise(F.col("last_error")).alias("last_error"), F.when(dies, now).otherwise(F.col("dead_lettered_at")).alias("dead_lettered_at"),
        F.when(hit & F.lit(retry), now).otherwise(F.col("last_retry_at")).alias("last_retry_at"), dies.alias("newly_dead"),
    )


def clear_failures(current: DataFrame, succeeded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger without the keys that succeeded, recovered keys: those that were in it)."""
    key = ["source", "document_key"]
    ok = succeeded.select(*key).distinct()
    return current.join(ok, key, "left_anti"), current.select(*key).join(ok, key, "left_semi")


def failure_runs(attempts: DataFrame, key: Sequence[str], at: Sequence[str], ok: str, threshold: int = 5) -> DataFrame:
    """Per key the run of failures it ends in, its longest run, and when it first reached ``threshold``.

    A run is the failures so far less those at the last success, both from one segmented scan, so a key with very
    many attempts is spread over tasks.  Rows with a null key are left out.
    """
    failed = (~F.col(ok)).cast("long")
    known = attempts.where(reduce(and_, [F.col(k).isNotNull() for k in key]))
    rows = running(dealt(known, key, at), key, at, sums={"_failed": failed})
    rows = running(rows, key, at, lasts={"_cleared": F.when(F.col(ok), F.col("_failed"))})
    rows = rows.withColumn("_run", F.col("_failed") - F.coalesce("_cleared", F.lit(0)))
    return rows.groupBy(*key).agg(
        F.max_by("_run", F.struct(*at)).alias("attempts"), F.max("_run").alias("longest_run"), F.min(F.when(F.col("_run") >= threshold, F.col(at[0]))).alias("dead_lettered_at")
    )


def success_prefix(rows: DataFrame, date: str, ident: str, failed: str, by: Sequence[str] = ()) -> DataFrame:
    """The greatest date before the first failure or null date, in (date, id) order, nulls first.

    Two aggregates instead of one ordered window, so no task sees all rows.
    """
    place = F.struct(F.col(date), F.col(ident))
    bad = F.col(failed) | F.col(date).isNull()
    first_bad = rows.groupBy(*by).agg(F.min(F.when(bad, place)).alias("_bad"))
    joined = rows.join(first_bad, list(by)) if by else rows.crossJoin(F.broadcast(first_bad))  # without ``by`` it is one row
    before = F.when(F.col("_bad").isNull() | (place < F.col("_bad")), F.col(date))
    return joined.groupBy(*by).agg(F.max(before).alias("cursor"), F.count_if(bad).alias("failures"))


def budget_cut(eligible: DataFrame, budget: int, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The first ``budget`` rows (negative: none), and (eligible, taken, deferred) counts."""
    n = max(0, budget)
    counts = eligible.agg(F.count("*").alias("eligible")).select("eligible", F.least("eligible", F.lit(n)).alias("taken"), F.greatest(F.col("eligible") - n, F.lit(0)).alias("deferred"))
    return eligible.orderBy(*order).limit(n), counts


def due(df: DataFrame, last: Column, cutoff: Column) -> DataFrame:
    """Rows last handled before ``cutoff``; never handled is the stalest."""
    return df.where(F.coalesce(last, F.lit("1970-01-01").cast("timestamp")) < cutoff)
