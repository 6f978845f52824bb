"""Sources and sinks (S1-S7, S10, S11): explicit schemas, good and bad rows split, nothing thrown inside a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimledger.functions import scalars as S
from claimledger.functions.rules import notice_flags, primary_haystack, status_haystack
from claimledger.operators.ledger import keep_latest
from claimledger.operators.reconcile import PRIMARY, STATUS, primary_fields, status_fields
from claimledger.operators.steps import once

#: The columns of the window export.
EXPORT = (
    "ocd_id", "fr_document_number", "regs_document_id", "docket_id", "window_type", "resolved_close_utc", "resolved_close_display", "raw_fr_close_date", "raw_regs_close_datetime",
    "confidence", "status", "version", "derived_at",
)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; instants are strings in the schema and stay so."""
    return spark.read.schema(schema).json(path)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S3: only these columns are read from the Parquet files."""
    return spark.read.parquet(path).select(*columns)


def write_windows(projection: DataFrame, path: str) -> None:
    """One JSON object per line, by key, instants in ISO UTC; a projection that lacks a column of ``EXPORT`` is refused."""
    projection.select(*EXPORT).orderBy("ocd_id").write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").option("ignoreNullFields", False).json(path)


def list_rows(pages: DataFrame, results: str, key: str, date: str) -> DataFrame:
    """Landed result pages (page, results array of structs) to (key, date), one row per key, the latest date."""
    rows = pages.select("page", F.posexplode(results).alias("at", "r")).select("page", "at", F.col(f"r.{key}").alias(key), F.col(f"r.{date}").alias(date))
    return keep_latest(rows.withColumn("seq", F.col("page").cast("long") * 1_000_000 + F.col("at")), key, date, "seq").select(key, date)


def truncated(pages: DataFrame, results: str, cap: int, page_size: int) -> DataFrame:
    """One row: did the listing stop at the page cap with a full last page?"""
    return pages.agg(F.coalesce(F.max(F.struct("page", F.size(results).alias("n"))), F.lit(None)).alias("l")).select(F.coalesce((F.col("l.page") >= cap) & (F.col("l.n") >= page_size), F.lit(False)).alias("truncated"))


def _split(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def _read(details: DataFrame, fields: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """``details`` with ``fields`` of its parsed document (``_v``), computed once a row, and the columns that hold them."""
    rows = once(details.withColumn("_v", F.try_parse_json("raw")), details.columns, **{f"_x_{k}": e for k, e in fields.items()})
    return rows, {k: F.col(f"_x_{k}") for k in fields}


def primary_observations(details: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects) of details (raw, fetched_at) from the primary source."""
    v = F.col("_v")
    x = {k: e for k, e in primary_fields(v).items() if k in ("document_number", "document_id", "object_id", "dates_text", "title")}
    x |= {"type": S.json_string(v, "$.type"), "action": S.json_string(v, "$.action"), "hash": S.parsed_hash(v)}
    read, x = _read(details, x)
    flags = notice_flags(primary_haystack(x["title"], x["type"], x["action"]))
    rows = read.select(
        *details.columns, F.lit(PRIMARY).alias("source"), S.entity_key(x["document_number"], F.lit(None).cast("string")).alias("ocd_id"), x["document_number"].alias("fr_document_number"),
        x["document_id"].alias("regs_document_id"), x["object_id"].alias("regs_object_id"), x["hash"].alias("payload_hash"), F.lit(version).alias("parser_version"),
        x["dates_text"].alias("raw_dates_text"), *[c.alias(f"is_{f}") for f, c in flags.items()],
    )
    return _split(rows, F.when(F.col("payload_hash").isNull(), "not JSON").when(F.col("ocd_id").isNull(), "no document number"))


def status_observations(details: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(observations, rejects) of details (raw, fetched_at) from the status source."""
    v = F.col("_v")
    x = {k: e for k, e in status_fields(v).items() if k in ("document_number", "document_id", "object_id", "title", "withdrawn")}
    x |= {"type": S.json_string(v, "$.data.attributes.documentType"), "hash": S.parsed_hash(v)}
    read, x = _read(details, x)
    flags = notice_flags(status_haystack(x["title"], x["type"]))
    flags["withdrawal"] = flags["withdrawal"] | F.coalesce(x["withdrawn"], F.lit(False))
    rows = read.select(
        *details.columns, F.lit(STATUS).alias("source"), S.entity_key(x["document_number"], x["object_id"]).alias("ocd_id"), x["document_number"].alias("fr_document_number"),
        x["document_id"].alias("regs_document_id"), x["object_id"].alias("regs_object_id"), x["hash"].alias("payload_hash"), F.lit(version).alias("parser_version"),
        F.lit(None).cast("string").alias("raw_dates_text"), *[c.alias(f"is_{f}") for f, c in flags.items()],
    )
    return _split(rows, F.when(F.col("payload_hash").isNull(), "not JSON").when(F.col("regs_document_id").isNull(), "no document id").when(F.col("ocd_id").isNull(), "no entity key"))
