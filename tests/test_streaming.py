import datetime as dt

from pyspark.sql import functions as F

from tidewater.operators import aggregates
from tidewater.streaming import reviews


def test_events_are_counted_once_by_day(spark, tmp_path):
    rows = [(1, dt.datetime(2026, 1, 1, 5), "a"), (1, dt.datetime(2026, 1, 1, 5), "a"), (2, dt.datetime(2026, 1, 1, 6), "a"), (3, dt.datetime(2026, 1, 2, 6), "b")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, kind string")
    df.write.parquet(str(tmp_path / "in"))
    stream = reviews.deduplicated(reviews.file_stream(spark, str(tmp_path / "in"), df.schema), ["event_id"], "ts")
    daily = reviews.tumbling(stream, "ts", "1 day", ["kind"], [F.count(F.lit(1)).alias("n")])
    seen = []
    reviews.available_now(daily, str(tmp_path / "ck"), lambda batch, _: seen.extend(batch.collect()), "append").awaitTermination()
    reviews.available_now(reviews.file_stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "ck2"), lambda batch, _: seen.append(batch.count())).awaitTermination()
    assert seen[-1] == 4


def test_replayed_batches_change_nothing(spark):
    schema = "review_id long, branch_id long, company string, sentiment string"
    base = spark.createDataFrame([(1, 10, "A", "positive")], schema)
    batch = spark.createDataFrame([(1, 10, "A", "negative"), (2, 10, "A", "positive"), (2, 10, "A", "neutral")], schema)
    ingest = lambda b: reviews.ingest(batch, b, ["review_id"], [F.desc("sentiment")], "branch_id", "company")
    once = ingest(base)
    twice = ingest(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 10, "A", "negative"), (2, 10, "A", "positive")]
    total = lambda facts: aggregates.by_polarity(facts, "branch_id")
    fresh = reviews.refreshed(total(base), once, batch, ["branch_id"], total)
    assert sorted(map(tuple, fresh.collect())) == sorted(map(tuple, total(once).collect()))
