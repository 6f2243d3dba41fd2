"""Landed crawl results and suggestions as tables or streams of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Activity types that suggest something, and media types of activities.
ACCEPTED_TYPES = ["Announce", "Offer", "Add"]
ACTIVITY_TYPES = ["application/ld+json", "application/activity+json", "application/json"]
_ACTIVITY = "struct<id:string,type:string,actor:string,object:array<string>,_corrupt_record:string>"


def parse_fetch_log(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines (value); works on streams too. A line that is no such object has nulls."""
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def parse_suggestions(rows: DataFrame) -> DataFrame:
    """``rows`` (content_type, body, ...) with type, actor, distinct objects, accepted and reject.

    reject names why a row is no suggestion: media-type, json, or null. Bodies that are not JSON are kept.
    """
    media = F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1))))
    parsed = rows.withColumn("r", F.from_json("body", _ACTIVITY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    reject = F.when(~F.coalesce(media.isin(ACTIVITY_TYPES), F.lit(False)), F.lit("media-type")).when(
        F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), F.lit("json")
    )
    return parsed.select(
        *rows.columns,
        F.col("r.type").alias("type"),
        F.col("r.actor").alias("actor"),
        F.array_distinct(F.coalesce("r.object", F.array().cast("array<string>"))).alias("objects"),
        F.coalesce(F.col("r.type").isin(ACCEPTED_TYPES), F.lit(False)).alias("accepted"),
        reject.alias("reject"),
    )


def read_fetch_stream(spark, folder: str, schema: str) -> DataFrame:
    """Crawl results that land in ``folder`` as text files of JSON lines, as a stream of rows."""
    return parse_fetch_log(spark.readStream.text(folder), schema)


def read_suggestion_stream(spark, folder: str) -> DataFrame:
    """Notifications (event_id, at_ms, content_type, body) that land in ``folder`` as Parquet files, as a stream of parsed ones."""
    return parse_suggestions(spark.readStream.schema("event_id long, at_ms long, content_type string, body string").parquet(folder))
