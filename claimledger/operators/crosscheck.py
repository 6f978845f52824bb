"""Differential jobs (J1-J5, J18, A2-A7, A11, A12, U2, U4, X1-X8): join rates, conflict rates, mirror checks, volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimledger.functions import scalars as S

CATEGORIES = ("agree", "date_mismatch", "withdrawn_mismatch", "we_abstain", "parquet_no_close", "unmatched")
DISAGREEMENTS = ("date_mismatch", "withdrawn_mismatch")


def percent(part: Column, whole: Column) -> Column:
    """One decimal; null over nothing."""
    return F.round(F.try_divide(100.0 * part, whole), 1)


def join_rate(status: DataFrame, primary: DataFrame, key: str) -> DataFrame:
    """N, n_keyed, n_joined, rate over all and over keyed rows.  Only distinct keys of the primary meet."""
    keys = primary.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_hit", F.lit(True))
    one = status.join(keys, key, "left").agg(F.count("*").alias("n"), F.count(key).alias("n_keyed"), F.count_if(F.col("_hit").isNotNull()).alias("n_joined"))
    return one.withColumn("rate", percent(F.col("n_joined"), F.col("n"))).withColumn("keyed_rate", percent(F.col("n_joined"), F.col("n_keyed")))


def fallback_matches(status: DataFrame, primary: DataFrame, key: str, value: str, arrays: str) -> DataFrame:
    """Distinct rows without a key match whose ``value`` is in a primary array, by exploded equi-join."""
    missed = status.join(primary.select(key).distinct(), key, "left_anti")
    items = primary.select(F.explode(arrays).alias(value)).distinct()
    return missed.join(items, value, "left_semi")


def coverage(rate: DataFrame, recovered: DataFrame) -> DataFrame:
    """A3: combined share of joined and recovered rows (both inputs are one row or a count)."""
    one = rate.crossJoin(recovered.agg(F.count("*").alias("n_recovered")))  # one row each
    return one.withColumn("combined", percent(F.col("n_joined") + F.col("n_recovered"), F.col("n")))


def enough(rates: DataFrame, rate: str, least: float = 60.0) -> DataFrame:
    """Adds ``verdict``: is the rate at least ``least`` per cent?"""
    return rates.withColumn("verdict", F.when(F.col(rate) >= least, "go").otherwise("no-go"))


def zone_samples(pairs: DataFrame, a_day: str, b_instant: str, order: Sequence[Column], n: int = 10) -> DataFrame:
    """The first pairs whose dates differ in UTC only, the false positives of a naive comparison."""
    ny, utc = S.new_york_date(F.col(b_instant)), F.to_date(b_instant)
    return pairs.where((utc != F.col(a_day)) & (ny == F.col(a_day))).orderBy(*order).limit(n)


def date_conflicts(pairs: DataFrame, a_day: str, b_instant: str) -> DataFrame:
    """Of pairs with both dates: conflicts by New York day, by UTC day, and those the zone explains."""
    both = pairs.where(F.col(a_day).isNotNull() & F.col(b_instant).isNotNull())
    ny, utc = S.new_york_date(F.col(b_instant)) != F.col(a_day), F.to_date(b_instant) != F.col(a_day)
    one = both.agg(F.count("*").alias("n"), F.count_if(ny).alias("n_conflicts"), F.count_if(utc).alias("n_naive"), F.count_if(utc & ~ny).alias("n_zone_only"))
    return one.withColumn("rate", percent(F.col("n_conflicts"), F.col("n")))


def match_by_keys(entities: DataFrame, mirror: DataFrame, ident: str, first: tuple[str, str], second: tuple[str, str], aggs: Sequence[Column]) -> DataFrame:
    """Match on the preferred key; entities without one try the second; aggregates per entity, nulls if none."""
    def by(rows: DataFrame, k: tuple[str, str]) -> DataFrame:
        return rows.select(F.col(ident).alias("_id"), F.col(k[0]).alias("_key")).join(mirror.withColumn("_key", F.col(k[1])), "_key").drop("_key")

    hit = by(entities, first)
    rest = entities.select(ident, second[0]).join(hit.select(F.col("_id").alias(ident)).distinct(), ident, "left_anti")
    found = hit.unionByName(by(rest, second)).groupBy("_id").agg(*aggs)
    return entities.join(found, entities[ident] == found["_id"], "left").drop("_id")


def classify_check(ours: Column, our_withdrawn: Column, mirror_days: Column, mirror_withdrawn: Column, matched: Column) -> Column:
    """The category of one entity; ``mirror_days`` is the array of the mirror's distinct New York days."""
    days = F.coalesce(F.array_compact(mirror_days), F.array().cast("array<date>"))
    return (
        F.when(~F.coalesce(matched, F.lit(False)), "unmatched").when(F.coalesce(mirror_withdrawn != our_withdrawn, F.lit(False)), "withdrawn_mismatch")
        .when(F.size(days) == 0, "parquet_no_close").when(ours.isNull(), "we_abstain").when((F.size(days) == 1) & F.coalesce(F.get(days, F.lit(0)) == ours, F.lit(False)), "agree").otherwise("date_mismatch")
    )


def histogram(df: DataFrame, column: str, values: Sequence[str] = CATEGORIES) -> DataFrame:
    """Counts with zeros for values that do not occur."""
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return wanted.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def first_abstentions(findings: DataFrame, key: str, n: int = 50) -> DataFrame:
    """The first entities without a verdict of ours, by key."""
    return findings.where("category = 'we_abstain'").orderBy(key).limit(n)


def carry_triage(findings: DataFrame, previous: DataFrame, key: str, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(findings with the earlier triage of the same entity and category, triage rows that found no finding).

    Only the two disagreements carry triage.  A value that is not ``allowed`` is left out with
    ``triage_warning`` set; its note stays.
    """
    known = F.col("triage").isin(*allowed)
    old = previous.where(F.col("category").isin(*DISAGREEMENTS))
    old = old.select(key, "category", F.when(known, F.col("triage")).alias("triage"), "note", (F.col("triage").isNotNull() & ~known).alias("triage_warning"))
    some = findings.where(F.col("category").isin(*DISAGREEMENTS))
    kept = findings.join(old, [key, "category"], "left").withColumn("triage_warning", F.coalesce("triage_warning", F.lit(False)))
    return kept, previous.join(some.select(key, "category"), [key, "category"], "left_anti")


def keyword_volume(df: DataFrame, text: Column, stems: Sequence[str], hint: Column, days: int, precision: float) -> DataFrame:
    """Per first-matched keyword: rows, hinted rows, rows per day, and the volume expected at a precision."""
    hits = df.withColumn("_k", S.keywords_in(text, stems)).where(F.size("_k") > 0).withColumn("keyword", F.get("_k", F.lit(0))).withColumn("_hint", hint)
    out = hits.groupBy("keyword").agg(F.count("*").alias("n"), F.count_if(F.col("_hint").isNotNull()).alias("n_hinted"))
    return out.withColumn("per_day", F.round(F.col("n") / F.lit(float(days)), 4)).withColumn("expected_per_day", F.round(F.col("n") * F.lit(precision) / F.lit(float(days)), 4))


def density(df: DataFrame, day: str, bucket: str, today: Column, n_quarters: int, buckets: Sequence[str]) -> DataFrame:
    """Quarter by bucket counts with zero cells, and the quarter's total."""
    q = df.sparkSession.range(1).select(F.explode(S.quarters(today, n_quarters)).alias("q")).select("q.*")
    rows = df.select(F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string")).alias("label"), F.col(day).cast("date").alias("_day"), bucket)
    inside = rows.join(F.broadcast(q), "label").where(F.col("_day").between(F.col("start"), F.col("end")))  # as many rows as quarters
    counts = inside.groupBy("label").pivot(bucket, list(buckets)).agg(F.count(F.lit(1)))
    total = sum((F.coalesce(F.col(f"`{b}`"), F.lit(0)) for b in buckets), F.lit(0))
    return q.join(counts, "label", "left").select("label", *[F.coalesce(F.col(f"`{b}`"), F.lit(0)).cast("long").alias(b) for b in buckets], total.cast("long").alias("total"))


def density_summary(quarters: DataFrame, buckets: Sequence[str], least_average: float) -> DataFrame:
    """One row: totals, average per quarter, each bucket's share in per cent and the threshold's verdict."""
    one = quarters.agg(F.count("*").alias("n_quarters"), F.sum("total").alias("total"), F.avg("total").alias("average"), *[F.sum(F.col(f"`{b}`")).alias(b) for b in buckets])
    shares = [percent(F.col(f"`{b}`"), F.col("total")).alias(f"{b}_share") for b in buckets]
    return one.select("n_quarters", "total", "average", *shares, F.when(F.col("average") >= least_average, "dense").otherwise("sparse").alias("verdict"))


def owned_keywords(docs: DataFrame, text: Column, stems: Sequence[str], period: str, doc: str) -> DataFrame:
    """(period, doc, keyword) of the first keyword of the list to hit a document in a period, no shuffle of texts."""
    hits = docs.select(period, doc, F.get(S.keywords_in(text, stems), F.lit(0)).alias("keyword")).where("keyword IS NOT NULL")
    rank = F.array_position(F.array(*map(F.lit, stems)), F.col("keyword"))
    return hits.groupBy(period, doc).agg(F.min_by("keyword", rank).alias("keyword"))


def first_keyword_owner(hits: DataFrame, period: str, doc: str, rank: str) -> DataFrame:
    """The first keyword (by rank) to hit a document owns it inside a period."""
    w = Window.partitionBy(period, doc).orderBy(rank)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows, and rows with a non-empty value in each field."""
    return df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields])


def freshness(df: DataFrame, at: str) -> DataFrame:
    """A7."""
    return df.agg(F.count("*").alias("n"), F.max(at).alias("latest"))
