"""Structured Streaming over review events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import filters, merge


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def deduplicated(events: DataFrame, key: Sequence[str], ts: str, late: str = "2 days") -> DataFrame:
    """Each key once, by a watermark that bounds what is remembered."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def tumbling(events: DataFrame, ts: str, width: str, keys: Sequence[str], aggregates: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Aggregates by key and window; sliding if a slide is given.  Windows are [start, end)."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(window.alias("window"), *keys).agg(*aggregates)


def sessions(events: DataFrame, ts: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    return events.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates)


def available_now(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run what is there now through a function of each micro-batch, and stop; a rerun goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def ingest(batch: DataFrame, base: DataFrame, key: Sequence[str], order: Sequence[Column], branch: str, company: str, update: Sequence[str] | None = None, share: float = 0.8) -> DataFrame:
    """One batch into the fact table: the first of each key, without misrouted rows, upserted."""
    clean = filters.misrouted(filters.keep_first(batch, key, order), branch, company, share).filter(~F.col("dropped")).drop("dropped")
    return merge.upsert(base, clean, key, update)


def refreshed(aggregate: DataFrame, facts: DataFrame, touched: DataFrame, key: Sequence[str], recompute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An aggregate with the touched keys computed anew from the facts, so a replay changes nothing."""
    kept = aggregate.join(touched.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(recompute(filters.keys_in(facts, touched, key)))
