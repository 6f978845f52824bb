"""Audits (S9, A19, A20, V3, V4): each returns what is wrong, an empty result being the good one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimledger.operators.steps import stored


def append_only_breaks(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the earlier snapshot that the later one lacks or has changed."""
    mark = lambda df: df.withColumn("_row", F.xxhash64(*[F.col(c) for c in sorted(before.columns)]))
    return mark(before).join(mark(after).select(*key, "_row"), [*key, "_row"], "left_anti").drop("_row")


def duplicate_count(log: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond one per key; a payload that came back legitimately counts too."""
    distinct = log.groupBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in key]).agg(F.count("*").alias("_n"))
    return distinct.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct")).withColumn("n_duplicates", F.col("n") - F.col("n_distinct"))


def snapshot_differences(live: dict[str, DataFrame], restored: dict[str, DataFrame], exact: Sequence[str] = (), least: int = 10, share: float = 0.05) -> DataFrame:
    """Per table live and restored counts and whether the restore is within tolerance."""
    out = None
    for name in sorted(live):
        a, b = live[name].agg(F.count("*").alias("live")), restored[name].agg(F.count("*").alias("restored"))
        one = a.crossJoin(b).withColumn("table", F.lit(name)).withColumn("exact", F.lit(name in exact))  # one row each
        out = one if out is None else out.unionByName(one)
    lag = F.col("live") - F.col("restored")
    ok = F.when(F.col("exact"), lag == 0).otherwise((lag >= 0) & (lag <= F.greatest(F.lit(float(least)), share * F.col("live"))))
    return out.select("table", "live", "restored", ok.alias("ok"))


def _hashed(df: DataFrame, key: Sequence[str], bits: int, columns: Sequence[str]) -> DataFrame:
    """Key, its range (the first bits of its hash) and a hash of the row's columns."""
    known = [F.col(c) for c in sorted(columns)]
    # a hash passes over nulls, so which columns are null is hashed as well
    row = F.xxhash64(F.concat_ws("", *[c.isNull().cast("int").cast("string") for c in known]), *known)
    return df.select(*key, F.shiftrightunsigned(F.xxhash64(*key), 64 - bits).alias("_range"), row.alias("_row"))


def hash_tree(df: DataFrame, key: Sequence[str], bits: int = 12, step: int = 4, columns: Sequence[str] | None = None) -> DataFrame:
    """(level, range, n, x, lo, hi): the rows of each range of key hashes, told by sums that no order of rows changes.

    Level ``bits`` has 2**bits ranges at most, each level above it 2**step times fewer, level 0 the whole table.  One pass with partial
    aggregation; two tables hold the same rows, repeated ones included, if their trees' tops agree.
    """
    leaf = _hashed(df, key, bits, columns or df.columns)
    lo, hi = F.col("_row").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("_row", 32)
    sums = leaf.groupBy("_range").agg(F.count("*").alias("n"), F.bit_xor("_row").alias("x"), F.sum(lo).alias("lo"), F.sum(hi).alias("hi"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftrightunsigned("_range", bits - k).alias("range")) for k in range(0, bits + 1, step)])
    up = sums.select(F.explode(levels).alias("e"), "n", "x", "lo", "hi").select("e.*", "n", "x", "lo", "hi")
    return up.groupBy("level", "range").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))


def differing_ranges(before: DataFrame, after: DataFrame, bits: int = 12, step: int = 4) -> DataFrame:
    """The ranges of level ``bits`` (column ``range``) in which two trees differ, found from the top down: a level looks only below ranges that differ."""
    parents = None
    for k in range(0, bits + 1, step):
        a, b = before.where(F.col("level") == k), after.where(F.col("level") == k)
        if parents is not None:
            below = parents.withColumnRenamed("range", "_parent")
            a, b = (t.withColumn("_parent", F.shiftrightunsigned("range", step)).join(below, "_parent", "left_semi") for t in (a, b))
        rows = a.select("range", F.struct("n", "x", "lo", "hi").alias("a")).join(b.select("range", F.struct("n", "x", "lo", "hi").alias("b")), "range", "full_outer")
        # stored, else each level's plan would hold the one above it twice
        parents = stored(rows.where(~F.col("a").eqNullSafe(F.col("b"))).select("range"))
    return parents


def snapshot_changes(before: DataFrame, after: DataFrame, key: Sequence[str], trees: tuple[DataFrame, DataFrame] | None = None, bits: int = 12, step: int = 4) -> DataFrame:
    """Keys whose rows differ between two snapshots, with ``change``: missing, added or changed.

    ``trees`` may have been kept from when the snapshots were written.  Rows of ranges that agree are not shuffled, and the snapshots are not joined: what is
    left is counted, plus one after and minus one before, by key and row.
    """
    columns = before.columns
    # a tree is small and read once a level, so it is stored; each snapshot is read twice, for its tree and for the rows of ranges that differ
    a, b = trees or (stored(hash_tree(before, key, bits, step, columns)), stored(hash_tree(after, key, bits, step, columns)))
    ranges = F.broadcast(differing_ranges(a, b, bits, step).withColumnRenamed("range", "_range"))  # 2**bits numbers at most
    only = lambda df, sign: _hashed(df, key, bits, columns).join(ranges, "_range", "left_semi").select(*key, "_row", F.lit(sign).alias("_n"))
    rows = only(before, -1).unionByName(only(after, 1)).groupBy(*key, "_row").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    per = rows.groupBy(*key).agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    return per.select(*key, F.when(F.col("_hi") < 0, "missing").when(F.col("_lo") > 0, "added").otherwise("changed").alias("change"))


def newer_than(rows: DataFrame, at: str, target: Column) -> DataFrame:
    """Rows that a restore to ``target`` must not hold."""
    return rows.where(F.col(at) > target)


def repeated_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """V1: keys that occur more than once where they must be unique (rule ids, hashes of a gold set), with their count."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """V4: rows whose reference has no target; null references are not references."""
    return rows.where(F.col(key).isNotNull()).join(target.select(F.col(target_key).alias(key)).distinct(), key, "left_anti")
