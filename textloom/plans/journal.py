"""Event logs: journals, resumption, time windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.session import load


def journal_resume(spark, sf_dir):
    """Clicks of a user not yet followed by a purchase: pending work after the journal's last entry."""
    events = load(spark, sf_dir, "events")
    done = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last"))
    pending = events.where("event_type = 'click'").join(done, "user_id", "left").where("last is null or event_id > last")
    return pending.groupBy("user_id").agg(F.count("*").alias("pending"), F.min("event_id").alias("next_event"))


def minute_series(spark, sf_dir):
    """Events by hour and type: count, total and peak value, and a field of their properties."""
    events = load(spark, sf_dir, "events")
    number = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999")).cast("bigint")
    rows = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(
        F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"), F.max("value").alias("peak"), F.sum(number).alias("k_sum")
    )
    return rows.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


def user_sessions(spark, sf_dir):
    """Sessions of users, cut where an hour passes without an event: an addition beside the reference's journals."""
    line = W.partitionBy("user_id").orderBy("ts", "event_id")
    events = load(spark, sf_dir, "events").withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(line).cast("timestamp")))
    events = events.withColumn("session", F.sum(F.when(F.col("gap") > 3600 * 1_000_000, 1).otherwise(0)).over(line.rowsBetween(W.unboundedPreceding, 0)))
    per = events.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))
    return per


def first_wins(spark, sf_dir):
    """First event of every user and type: the state an online first-wins pass keeps."""
    events = load(spark, sf_dir, "events")
    return events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"), F.min_by("props", "event_id").alias("props"), F.count("*").alias("seen"))


def newest_kept(spark, sf_dir):
    """Checkpoint retention: events beyond the newest three of every user, by user."""
    events = load(spark, sf_dir, "events").withColumn("age", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    return events.groupBy("user_id").agg(F.count_if(F.col("age") > 3).alias("removable"), F.max(F.when(F.col("age") == F.lit(3), F.col("event_id"))).alias("oldest_kept"))


def ingest_delay(spark, sf_dir):
    """Candidates by whole days between fetching and ingestion."""
    rows = load(spark, sf_dir, "text_candidates").groupBy("candidate_id").agg(F.min("fetched_at").alias("f"), F.min("ingested_at").alias("i"))
    days = F.floor((F.unix_micros("i") - F.unix_micros("f")) / (86_400 * 1_000_000))
    return rows.groupBy(days.cast("bigint").alias("days")).agg(F.count("*").alias("records"))


QUERIES = {f.__name__: f for f in (journal_resume, minute_series, user_sessions, first_wins, newest_kept, ingest_delay)}

SQL = {
    "journal_resume": "with d as (select user_id, max(event_id) as last from events where event_type = 'purchase' group by 1) select user_id, count(*) as pending, min(event_id) as next_event from events left join d using (user_id) where event_type = 'click' and (last is null or event_id > last) group by 1",
    "minute_series": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as hour, event_type, count(*) as events, round(sum(value), 2) as total, max(value) as peak, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint as k_sum from events group by all",
    "user_sessions": "with g as (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 1 hour as cut from events), s as (select *, sum(case when cut then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as session from g) select user_id, session, count(*) as events, min(event_id) as first_event from s group by all",
    "first_wins": "select user_id, event_type, min(event_id) as first_event, arg_min(props, event_id) as props, count(*) as seen from events group by all",
    "newest_kept": "with a as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as age from events) select user_id, count(*) filter (age > 3) as removable, max(event_id) filter (age = 3) as oldest_kept from a group by 1",
    "ingest_delay": "with r as (select candidate_id, min(fetched_at) as f, min(ingested_at) as i from text_candidates group by 1) select floor((epoch_us(i) - epoch_us(f)) / 86400000000)::bigint as days, count(*) as records from r group by 1",
}
