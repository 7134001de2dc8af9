"""Queries that run events through a stream into a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sentiment
from ..sources.readers import table
from ..sources.versioned import VersionedTable, work_folder
from ..streaming import ledger, reviews
from .catalogue import query

_KEYS, _SUMS = ["day", "user_id", "tag"], ["positive_count", "negative_count", "neutral_count", "total_count", "weight"]


def _increments(events: DataFrame) -> DataFrame:
    """A batch's counts by day, user and tag; an event has the polarity of more of its keywords, and weighs 1."""
    k = F.get_json_object("props", "$.k").cast("int")
    polarity = sentiment.majority(k % 3, k % 2)
    counts = [F.count_if(polarity == p).alias(f"{p}_count") for p in ("positive", "negative", "neutral")]
    return events.groupBy(F.col("ts").cast("date").alias("day"), "user_id", F.col("event_type").alias("tag")).agg(*counts, F.count(F.lit(1)).alias("total_count"), F.count(F.lit(1)).alias("weight"))


@query(
    """WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, event_type AS tag, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS p, CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 AS n FROM events)
    SELECT day, user_id, tag, count(*) FILTER (WHERE p > n) AS positive_count, count(*) FILTER (WHERE n > p) AS negative_count, count(*) FILTER (WHERE p IS NULL OR n IS NULL OR p = n) AS neutral_count, count(*) AS total_count, count(*) AS weight FROM e GROUP BY day, user_id, tag"""
)
def streaming_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily increments of all events, streamed in several batches into a table of days; then the whole stream runs again from its start and adds nothing."""
    root = work_folder(spark)
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "props")
    events.repartition(8, "event_id").write.parquet(f"{root}/in")
    days = VersionedTable(spark, f"{root}/daily", ["day"])
    add = ledger.add_once(days, "events", _increments, _KEYS, _SUMS)
    for run in range(2):
        stream = reviews.file_stream(spark, f"{root}/in", events.schema, files_per_batch=3)
        reviews.available_now(stream, f"{root}/checkpoint{run}", add).awaitTermination()
    return days.read()
