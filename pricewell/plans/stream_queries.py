"""Streaming queries over the event table as a file stream; their SQL is that of the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.streaming import ops as o

from .analytics_queries import add, events
from .views import read


def stream(s, d):
    """The event table's files as a stream. A file stream reads folders, so a table that is one file is picked by its name."""
    table = read(s, d, "events")
    folder, _, name = table.inputFiles()[0].rpartition("/")
    reader = s.readStream.schema(table.schema)
    if name == "events.parquet":
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def plain(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


def jobs(s, d):
    return stream(s, d).select(F.col("user_id").alias("source"), F.when(F.col("event_type") == "error", "FAILED").otherwise("SUCCESS").alias("status"))


add("stream_window_stats", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(avg(value), 7) AS mean, min(value) AS lowest, max(value) AS highest FROM events GROUP BY 1, 2", lambda s, d: plain(o.drain(o.stream_window_stats(stream(s, d), "ts", "value", keys=["event_type"]), "complete")))
add("rate_breaches", "SELECT event_type, s AS start, count(*) AS n FROM (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), INTERVAL 30 MINUTE)) AS s FROM events) GROUP BY 1, 2 HAVING count(*) > 6", lambda s, d: plain(o.drain(o.rate_breaches(stream(s, d), "event_type", "ts", 6, "60 minutes", "30 minutes"), "complete")))
add("ttl_dedup", "SELECT DISTINCT user_id, event_type FROM events", lambda s, d: o.drain(o.ttl_dedup(stream(s, d), ["user_id", "event_type"], "ts", "60 days"), "append").select("user_id", "event_type"))
BREAK = "SELECT user_id, count(*) FILTER (event_type = 'error' AND (ok IS NULL OR (ts, event_id) > ok)) AS run FROM events LEFT JOIN (SELECT user_id, max((ts, event_id)) AS ok FROM events WHERE event_type <> 'error' GROUP BY user_id) USING (user_id) GROUP BY user_id"
#: A breaker is half open once the watermark, an hour behind the last row, is more than a minute past the last failure.
STREAM_BREAK = f"""SELECT user_id, run, CASE WHEN run < 2 THEN 'CLOSED' WHEN epoch_ms(last_failure) + 60001 < (SELECT epoch_ms(max(ts)) FROM events) - 3600000 THEN 'HALF_OPEN' ELSE 'OPEN' END AS state
 FROM ({BREAK}) JOIN (SELECT user_id, max(ts) FILTER (event_type = 'error') AS last_failure FROM events GROUP BY user_id) USING (user_id)"""
add("breaker_state", STREAM_BREAK, lambda s, d: o.latest_state(o.drain(o.breaker_state(stream(s, d).withColumn("failed", F.col("event_type") == "error"), "user_id", "ts", "failed", 2, ttl_s=40 * 86_400), "update"), "user_id").select("user_id", "run", "state"))
add("breaker_batch", f"SELECT user_id, run, CASE WHEN run < 2 THEN 'CLOSED' ELSE 'HALF_OPEN' END AS state FROM ({BREAK})", lambda s, d: o.breaker_batch(events(s, d).withColumn("failed", F.col("event_type") == "error"), "user_id", "ts", "failed", "2024-03-01", 2))
add("stream_health", "SELECT user_id AS source, count(*) AS runs, round(avg((event_type <> 'error')::INT), 4) AS success_rate FROM events GROUP BY 1", lambda s, d: o.drain(o.stream_health(jobs(s, d)), "complete"))
add("stream_sessions", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::INT, 1) AS new FROM events)) GROUP BY user_id, k", lambda s, d: plain(o.drain(o.stream_sessions(stream(s, d), "user_id", "ts", "6 hours"), "complete")))


def late_repair(s, d):
    """Events in three batches by their number; most of the second and third batch are behind the ones before."""
    out = o.sink_dir(s)
    for k in range(3):  # files of their own, read in the order of their times
        events(s, d).where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{out}-in")
    arriving = s.readStream.schema(events(s, d).schema).option("maxFilesPerTrigger", 1).parquet(f"{out}-in")
    per_day = lambda rows: rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    table, late = o.repair_stream(arriving, out, "ts", per_day)
    behind = late.groupBy("day").agg(F.count(F.lit(1)).alias("late"))
    return table.join(behind, "day", "left").select("day", "n", "total", F.coalesce("late", F.lit(0)).alias("late"))


LATE_SQL = """WITH marks AS (SELECT max(ts) FILTER (event_id % 3 = 0) AS m0, max(ts) FILTER (event_id % 3 < 2) AS m1 FROM events)
SELECT cast(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total,
  count(*) FILTER ((event_id % 3 = 1 AND ts < m0 - INTERVAL 1 HOUR) OR (event_id % 3 = 2 AND ts < m1 - INTERVAL 1 HOUR)) AS late
FROM events, marks GROUP BY 1"""
add("late_repair", LATE_SQL, late_repair)


def repaired_batch(s, d):
    """The daily table without its last ten days, repaired by a batch of late rows."""
    e = events(s, d).withColumn("day", F.to_date("ts"))
    daily = lambda x: x.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return o.late_repair(daily(e.where("day < '2024-01-21' and event_id % 2 = 0")), e.where("day >= '2024-01-10'"), ["day"], lambda keys: daily(e.join(keys, "day", "left_semi")))


add("repaired_batch", "SELECT cast(ts AS DATE) AS day, count(*) FILTER (cast(ts AS DATE) >= DATE '2024-01-10' OR event_id % 2 = 0) AS n FROM events GROUP BY 1", repaired_batch)
_F = "map('flight_number', '6E-100', 'origin_airport', if(event_id % 31 = 0, '', 'DEL'), 'destination_airport', 'BOM', 'travel_date', '2024-01-01', 'total_fare', cast(value + 1 as string))"
add("stream_drift", "SELECT count(*) AS records_checked, count(*) FILTER (event_id % 31 <> 0) AS clean_count, count(*) FILTER (event_id % 31 = 0) AS drift_count, false AS is_drifting, false AS collapsed, 0 AS batch FROM events", lambda s, d: o.stream_drift(stream(s, d).select(F.expr(_F).alias("fields"))))
