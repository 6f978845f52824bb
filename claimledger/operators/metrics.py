"""Operational rollups (M1-M8, A18): counter increases, quantiles from buckets, freshness, ratios, last values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def increases(samples: DataFrame, labels: Sequence[str], at: str, value: str, tie: str, every: str = "1 hour") -> DataFrame:
    """M1: increase of a counter per label set and window; a fall is a reset, the new value counts from 0.

    Samples are ordered inside their window only.  What leads over from one window of a label set to
    the next are its first and last samples, one row a window, so a label set of any length is spread over tasks.
    """
    step = lambda before: F.when(before.isNull(), 0.0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    rows = samples.select(*labels, at, tie, value, F.window(at, every)["start"].alias("window_start"))
    inside = Window.partitionBy(*labels, "window_start").orderBy(at, tie)
    rows = rows.withColumn("_d", step(F.lag(value).over(inside)))
    order = F.struct(at, tie)
    parts = rows.groupBy(*labels, "window_start").agg(F.sum("_d").alias("_inside"), F.min_by(value, order).alias(value), F.max_by(value, order).alias("_last"))
    across = Window.partitionBy(*labels).orderBy("window_start")
    return parts.select(*labels, "window_start", (F.col("_inside") + step(F.lag("_last").over(across))).alias("increase"))


def sliding_increases(samples: DataFrame, labels: Sequence[str], at: str, value: str, tie: str, span: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """M1: increase and rate of a counter over (T - span, T] for every multiple T of ``step``: labels, at, increase, rate, n_samples.

    The span is cut into panes of a step.  Resets are resolved once, inside a pane and from pane to pane; a span is the sum of its panes,
    so a sample is read once however many spans hold it.  Increases are carried on to the span's ends as ``rate`` does it: by the
    distance to the first and last sample where that is under 1.1 times the mean distance of samples, else by half of
    that mean, and never back beyond where the counter would have been 0.  Spans of fewer than two samples give no row.
    ``span`` is a multiple of ``step``.
    """
    spark = samples.sparkSession
    micros = lambda text: int(spark.sql(f"SELECT unix_micros(TIMESTAMP '2000-01-01' + INTERVAL {text}) - unix_micros(TIMESTAMP '2000-01-01')").first()[0])
    width, pane = micros(span), micros(step)
    if width % pane:
        raise ValueError("the span is a multiple of the step")
    up = lambda before, now: F.when(before.isNull(), 0.0).when(now < before, now).otherwise(now - before)
    v = F.col(value).cast("double")
    rows = samples.where(F.col(at).isNotNull() & v.isNotNull()).select(*labels, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(tie).alias("_tie"), v.alias("_v"))
    rows = rows.withColumn("_pane", F.ceil(F.col("_t") / pane).cast("long"))
    inside = Window.partitionBy(*labels, "_pane").orderBy("_t", "_tie")
    order = F.struct("_t", "_tie")
    panes = rows.withColumn("_d", up(F.lag("_v").over(inside), F.col("_v"))).groupBy(*labels, "_pane").agg(
        F.sum("_d").alias("_inside"), F.count("*").alias("_n"), F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.min_by("_v", order).alias("_v0"), F.max_by("_v", order).alias("_v1"))
    panes = panes.withColumn("_cross", up(F.lag("_v1").over(Window.partitionBy(*labels).orderBy("_pane")), F.col("_v0")))
    ends = F.transform(F.sequence(F.lit(0), F.lit(width // pane - 1)), lambda k: F.col("_pane") + k)
    spans = panes.withColumn("_end", F.explode(ends)).groupBy(*labels, "_end").agg(
        F.sum(F.col("_inside") + F.col("_cross")).alias("_all"), F.min_by(F.struct("_t0", "_v0", "_cross"), "_pane").alias("_first"), F.max("_t1").alias("_t1"), F.sum("_n").alias("n_samples"))
    spans = spans.where("n_samples >= 2").withColumn("_up", F.col("_all") - F.col("_first._cross"))
    t0, end = F.col("_first._t0"), F.col("_end") * pane
    between = (F.col("_t1") - t0).cast("double")
    mean = between / (F.col("n_samples") - 1)
    reach = lambda d: F.when(d >= 1.1 * mean, mean / 2).otherwise(d)
    zero = F.when((F.col("_up") > 0) & (F.col("_first._v0") >= 0), between * F.col("_first._v0") / F.col("_up"))
    head = F.least(reach((t0 - (end - width)).cast("double")), zero)  # least passes over nulls
    factor = F.try_divide(between + head + reach((end - F.col("_t1")).cast("double")), between)
    out = spans.withColumn("increase", F.col("_up") * factor).where("increase IS NOT NULL")
    return out.select(*labels, F.timestamp_micros(end).alias("at"), "increase", (F.col("increase") / (width / 1e6)).alias("rate"), "n_samples")


def bucket_quantile(buckets: DataFrame, labels: Sequence[str], le: str, count: str, q: float) -> DataFrame:
    """M2: quantile by linear interpolation inside the first bucket whose running count reaches q of the total.

    ``count`` is of the bucket alone.  In a bucket without an upper bound (infinite or NaN) the quantile is the greatest finite bound, in a first
    bucket whose bound is not above 0 it is that bound.
    """
    bound = F.when(F.isnan(F.col(le).cast("double")), F.lit(float("inf"))).otherwise(F.col(le).cast("double"))
    w = Window.partitionBy(*labels).orderBy("_le")
    run = F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = buckets.withColumn("_le", bound).withColumn("_run", run).withColumn("_total", F.sum(count).over(Window.partitionBy(*labels)))
    rows = rows.withColumn("_below", F.lag("_le").over(w)).withColumn("_before", F.col("_run") - F.col(count))
    hit = rows.where((F.col("_run") >= q * F.col("_total")) & (F.col("_before") < q * F.col("_total")))
    inside = F.try_divide(q * F.col("_total") - F.col("_before"), F.col(count))
    low = F.coalesce("_below", F.lit(0.0))
    value = F.when(F.col("_le") == float("inf"), F.col("_below")).when(F.col("_below").isNull() & (F.col("_le") <= 0), F.col("_le")).otherwise(low + (F.col("_le") - low) * inside)
    return hit.select(*labels, value.alias("quantile"))


def histogram_quantile(buckets: DataFrame, labels: Sequence[str], le: str, count: str, q: float) -> DataFrame:
    """M2: the quantile of cumulative buckets, as sources write them: ``le`` is a number or its text, the last one ``+Inf``.

    Counts that fall from one bound to the next are raised to the one before.  A label set without a ``+Inf`` bucket, or with no
    other, or without observations, has a null quantile.
    """
    text = F.lower(F.trim(F.col(le).cast("string")))
    bound = F.when(text.isin("+inf", "inf", "infinity", "+infinity"), F.lit(float("inf"))).otherwise(F.col(le).try_cast("double"))
    rows = buckets.withColumn("_bound", bound).where("_bound IS NOT NULL").groupBy(*labels, "_bound").agg(F.sum(count).alias("_cum"))
    w = Window.partitionBy(*labels).orderBy("_bound")
    rows = rows.withColumn("_cum", F.max("_cum").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = rows.withColumn("_own", F.col("_cum") - F.coalesce(F.lag("_cum").over(w), F.lit(0)))
    whole = own.groupBy(*labels).agg(F.max("_bound").alias("_top"), F.count("*").alias("_n"))
    sound = bucket_quantile(own, labels, "_bound", "_own", q)
    pairs = [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in labels]
    j = whole.alias("w").join(sound.alias("s"), reduce(and_, pairs, F.lit(True)), "left")
    return j.select(*[F.col(f"w.{k}").alias(k) for k in labels], F.when((F.col("_top") == float("inf")) & (F.col("_n") > 1), F.col("quantile")).alias("quantile"))


def sketches(samples: DataFrame, by: Sequence[str], value: str, k: int = 200) -> DataFrame:
    """M2: one KLL sketch of a column per group: a few kilobytes, whatever the number of samples, with their count."""
    return samples.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.count(value).alias("n"))


def merged_sketches(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """M2: sketches of finer groups put together; the same error bound holds as for one sketch of all samples."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketch_quantile(sketched: DataFrame, q: float, name: str = "quantile") -> DataFrame:
    """M2: the quantile that a sketch knows; its rank is within ``rank_error`` of q with 99 % confidence."""
    return sketched.withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))


def rank_error(k: int = 200) -> float:
    """The published bound of a KLL sketch's rank error for one quantile, a share of the samples."""
    return 2.296 / k**0.9021


def ratio(df: DataFrame, by: Sequence[str], part: Column, whole: Column) -> DataFrame:
    """M3, M5: share of rows; null over nothing."""
    return df.groupBy(*by).agg(F.count_if(part).alias("part"), F.count_if(whole).alias("whole")).withColumn("ratio", F.try_divide("part", "whole"))


def increase_ratio(parts: DataFrame, wholes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """M3: per label set and window the ratio of two counters' increases (``increases``); null over nothing."""
    key = [*labels, "window_start"]
    j = wholes.select(*key, F.col("increase").alias("whole")).join(parts.select(*key, F.col("increase").alias("part")), key, "left")
    return j.withColumn("part", F.coalesce("part", F.lit(0.0))).withColumn("ratio", F.try_divide("part", "whole"))


def increase_alert(rows: DataFrame, most: float) -> DataFrame:
    """M5: windows in which a counter rose by more than ``most``."""
    return rows.withColumn("firing", F.col("increase") > most)


def missing_successes(attempts: DataFrame, successes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """M5: errors of a provider as attempts less successes, per label set and window, never below 0."""
    key = [*labels, "window_start"]
    j = attempts.select(*key, F.col("increase").alias("attempts")).join(successes.select(*key, F.col("increase").alias("successes")), key, "left")
    return j.withColumn("errors", F.greatest(F.col("attempts") - F.coalesce("successes", F.lit(0.0)), F.lit(0.0)))


def summary_outcomes(summaries: DataFrame, source: str, outcomes: Sequence[str]) -> DataFrame:
    """M8: (source, outcome, value) rows from cycle summaries with one column per outcome; zeros stay."""
    pairs = F.array(*[F.struct(F.lit(o).alias("outcome"), F.coalesce(F.col(o).cast("long"), F.lit(0)).alias("value")) for o in outcomes])
    return summaries.select(source, F.explode(pairs).alias("p")).groupBy(source, F.col("p.outcome").alias("outcome")).agg(F.sum("p.value").alias("value"))


def freshness_alert(beats: DataFrame, wanted: DataFrame, key: str, at: str, now: Column, most_seconds: int = 2700) -> DataFrame:
    """M4: age of the latest heartbeat; a key that never beat is infinitely old (null age) and firing."""
    last = beats.groupBy(key).agg(F.max(at).alias("last"))
    j = wanted.select(key).distinct().join(last, key, "left").withColumn("age_seconds", F.unix_timestamp(now) - F.unix_timestamp("last"))
    return j.withColumn("firing", F.col("last").isNull() | (F.col("age_seconds") > most_seconds))


def held_breaches(checks: DataFrame, key: str, at: str, breached: str, hold_seconds: int = 600) -> DataFrame:
    """M4: islands of consecutive breaches that lasted ``hold_seconds``: key, since, until, n_checks."""
    w = Window.partitionBy(key).orderBy(at)
    rows = checks.withColumn("_i", F.sum((~F.col(breached)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(breached)
    runs = rows.groupBy(key, "_i").agg(F.min(at).alias("since"), F.max(at).alias("until"), F.count("*").alias("n_checks"))
    return runs.where(F.unix_timestamp("until") - F.unix_timestamp("since") >= hold_seconds).drop("_i")


def last_values(samples: DataFrame, labels: Sequence[str], at: str, value: str, tie: str) -> DataFrame:
    """M6: latest sample per label set."""
    return samples.groupBy(*labels).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def outcome_counts(rows: DataFrame, source: str, outcome: str) -> DataFrame:
    """One (source, outcome, value) row per outcome of a cycle."""
    return rows.groupBy(source, outcome).agg(F.count("*").alias("value"))


def log_lines(logs: DataFrame, text: str, needle: str, schema: str) -> DataFrame:
    """M7: lines that contain a text, with their JSON fields."""
    return logs.where(F.contains(F.col(text), F.lit(needle))).withColumn("fields", F.from_json(text, schema))
