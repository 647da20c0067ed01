"""Streams over the event table, drained and read back as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.plans.catalogue import E, query, table
from eventloom.sources.shared import shared_folder
from eventloom.streaming.recorder import Limits, Recorder, drained, live_changes, live_combined, live_counts, live_first


def stream(spark, sf):
    """The event table as a stream of its files."""
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_counts", "select epoch_us(date_trunc('day', ts)) as start, event_type, count(*) as count from events group by 1, 2")
def stream_counts(spark, sf):
    out = drained(live_counts(stream(spark, sf), "ts", "1 day", "1 hour"), shared_folder(spark), "complete")
    return out.select(F.unix_micros("start").alias("start"), "event_type", "count")


@query("stream_combined", f"select epoch_us(date_trunc('day', ts)) as start, user_id, count(*) as count, cast(sum(k) as bigint) as sum, max(k) as max from {E} group by 1, 2")
def stream_combined(spark, sf):
    rows = stream(spark, sf).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    out = drained(live_combined(rows, "ts", "1 day", "1 hour", ["user_id"], "k"), shared_folder(spark), "complete")
    return out.select(F.unix_micros("start").alias("start"), "user_id", "count", "sum", "max")


@query("stream_first", "select count(*) as n from (select distinct user_id, event_type from events)")
def stream_first(spark, sf):
    """How many events are the first of their key; which of several in one batch that is, a stream does not say."""
    return drained(live_first(stream(spark, sf), "ts", "4000 days", ["user_id", "event_type"]), shared_folder(spark)).agg(F.count(F.lit(1)).alias("n"))


@query("stream_changes", "select event_id from (select event_id, event_type, lag(event_type) over w as last, row_number() over w as r from events window w as (partition by user_id order by ts, event_id)) where r = 1 or event_type is distinct from last")
def stream_changes(spark, sf):
    return drained(live_changes(stream(spark, sf), "user_id", "event_type", "ts"), shared_folder(spark)).select("event_id")


@query("stream_recorded", "select event_id, event_type from events")
def stream_recorded(spark, sf):
    """All events by way of a rotating recording."""
    path = shared_folder(spark)
    recorder = Recorder(f"{path}/folders", Limits(max_batches=1))
    recorder.start(stream(spark, sf), f"{path}/checkpoint", once=True).awaitTermination()
    return recorder.read(spark).select("event_id", "event_type")
