"""Append-only log (A1, T1, T2, W1-W4, C4): de-duplication, latest rows, suppression of unchanged payloads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, key: str, date: str, seq: str) -> DataFrame:
    """A1: per key the row of the greatest date string; null is the oldest, of ties the smallest ``seq`` stays.

    One partial aggregate before the shuffle; null and empty keys go.
    """
    rows = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    order = F.struct(F.coalesce(F.col(date).cast("string"), F.lit("")), -F.col(seq))
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def latest_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Per key the row of the greatest ``order`` (a struct that carries its own tie-break)."""
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def document_key() -> Column:
    """The status source is keyed by its own document id, every other by the document number."""
    return F.when(F.col("source") == "regulations_gov", F.col("regs_document_id")).otherwise(F.col("fr_document_number"))


def changed_payloads(log: DataFrame | None, batch: DataFrame, keys: Sequence[str], hash_col: str, order: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose hash differs from the one before it, in the log or in the batch.

    A payload that changes and comes back is kept again.  Rows with a null key are always kept; they
    are set apart first, so they don't meet in one task.  Only the log's latest hash per key meets the batch.
    """
    no_key = reduce(or_, [F.col(k).isNull() for k in keys])
    apart, batch = batch.where(no_key), batch.where(~no_key)
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = batch.withColumn("_prev", F.lag(hash_col).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    if log is not None:
        seen = log.where(~no_key).groupBy(*keys).agg(F.max_by(hash_col, F.struct(*order)).alias("_stored"))
        rows = rows.join(seen, list(keys), "left").withColumn("_prev", F.when(F.col("_first"), F.col("_stored")).otherwise(F.col("_prev"))).drop("_stored")
    return rows.where(~F.col(hash_col).eqNullSafe(F.col("_prev"))).select(*batch.columns).unionByName(apart)


def latest_heads(heads: DataFrame, batch: DataFrame, keys: Sequence[str], hash_col: str, order: Sequence[str]) -> DataFrame:
    """Latest hash per key of a log and a batch: what ``changed_payloads`` has to know of a log.  Null keys have none."""
    cols = [*keys, hash_col, *order]
    both = heads.select(*cols).unionByName(batch.select(*cols))
    known = both.where(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    return known.groupBy(*keys).agg(F.max_by(F.struct(hash_col, *order), F.struct(*order)).alias("r")).select(*keys, "r.*")


def new_targets(bridge: DataFrame, observations: DataFrame) -> DataFrame:
    """(observation_id, ocd_id) rows that the bridge lacks."""
    rows = observations.select("observation_id", "ocd_id").where("ocd_id IS NOT NULL").dropDuplicates()
    return rows.join(bridge, ["observation_id", "ocd_id"], "left_anti")


def ingest(log: DataFrame, bridge: DataFrame, batch: DataFrame, order: Sequence[str] = ("fetched_at", "observation_id")) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the log, their primary targets to append to the bridge).

    A payload equal to the latest of its document is left out; a document is named by its source's own key.
    """
    keyed = lambda df: df.withColumn("_document", document_key())
    new = changed_payloads(keyed(log), keyed(batch), ["source", "_document"], "payload_hash", order).drop("_document")
    return new, new_targets(bridge, new)


def insert_absent(current: DataFrame, new: DataFrame, keys: Sequence[str], first: str | None = None) -> DataFrame:
    """Rows of ``new`` whose key is not there yet; of several the least ``first`` wins."""
    rows = new
    if first is not None:
        rows = new.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(*new.columns), first).alias("r")).select("r.*")
    return rows.join(current.select(*keys), list(keys), "left_anti")


def rederive_flags(log: DataFrame, derived: dict[str, Column], version: str) -> tuple[DataFrame, DataFrame]:
    """C4: the log with recomputed flags and parser version where one differs, and one row (scanned, updated, skipped)."""
    differs = F.lit(False)
    for name, value in derived.items():
        differs = differs | ~F.col(name).eqNullSafe(value)
    rows = log.withColumn("_new", F.struct(*[v.alias(k) for k, v in derived.items()])).withColumn("_differs", differs)
    counts = rows.agg(F.count("*").alias("scanned"), F.count_if("_differs").alias("updated"), F.count_if(~F.col("_differs")).alias("skipped"))
    for name in derived:
        rows = rows.withColumn(name, F.col(f"_new.{name}"))
    rows = rows.withColumn("parser_version", F.when(F.col("_differs"), F.lit(version)).otherwise(F.col("parser_version")))
    return rows.select(*log.columns), counts
