"""Streaming operators. Each takes a streaming DataFrame; ``drain`` runs one over all that is there and returns the sink's table."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.operators.clean import drift_report, validate_records
from pricewell.operators.joins import replace_by_key


#: Before all times.
NEVER = -(1 << 62)


def sink_dir(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder. Only in local mode, where one machine is all there is, that may be unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="pricewell-")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(sdf: DataFrame, mode: str) -> DataFrame:
    """Run the query over all available data. ``complete``: the last batch's table; ``append``: all batches' rows."""
    spark, out = sdf.sparkSession, sink_dir(sdf.sparkSession)
    last: list[int] = []

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={k}")
        last.append(k)

    sdf.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    if not last:
        return spark.createDataFrame([], sdf.schema)
    return spark.read.schema(sdf.schema).parquet(f"{out}/batch={last[-1]}" if mode == "complete" else out).select(*sdf.columns)


def stream_window_stats(sdf: DataFrame, ts: str, x: str, size: str = "6 hours", delay: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """Tumbling windows: count, mean and range."""
    w = F.window(ts, size)
    return sdf.withWatermark(ts, delay).groupBy(*(keys or []), w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 7).alias("mean"), F.min(x).alias("lowest"), F.max(x).alias("highest")).select(*(keys or []), F.col("w.start").alias("start"), "n", "mean", "lowest", "highest")


def rate_breaches(sdf: DataFrame, key: str, ts: str, limit: int = 120, size: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Sliding windows in which a key has more requests than its budget."""
    return sdf.withWatermark(ts, size).groupBy(key, F.window(ts, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")


def ttl_dedup(sdf: DataFrame, keys: list[str], ts: str, ttl: str = "30 minutes") -> DataFrame:
    return sdf.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def breaker_state(sdf: DataFrame, source: str, ts: str, failed: str, failures: int = 5, wait_s: int = 60, delay: str = "1 hour", ttl_s: int = 86_400, order: str = "event_id") -> DataFrame:
    """Per source and batch: the run of failures since the last success by (time, id), the breaker's state, the last failure, and ``n``, which counts a source's rows.

    OPEN from ``failures`` on; HALF_OPEN once the watermark is ``wait_s`` seconds past the last failure. The state holds the last success
    and the failures after it, so rows and frames may come in any order; failures that the watermark has passed are only counted,
    as no row can come between them any more. A closed or half-open source without rows for ``ttl_s`` seconds is forgotten.
    """

    def step(key, frames, state):
        ok, ok_id, old, recent, last, n = state.get if state.exists else (NEVER, NEVER, 0, b"", NEVER, 0)
        passed = state.getCurrentWatermarkMs() * 1000
        if state.hasTimedOut:
            if old + len(recent) // 16 < failures or passed >= last + (wait_s + ttl_s) * 1_000_000:
                state.remove()
                return
            state.update((ok, ok_id, old, recent, last, n + 1))
            state.setTimeoutTimestamp(max(passed, last + (wait_s + ttl_s) * 1_000_000) // 1000 + 1)
            yield pd.DataFrame({source: [key[0]], "run": [old + len(recent) // 16], "state": ["HALF_OPEN"], "last": pd.to_datetime([last], unit="us"), "n": [n + 1]})
            return
        parts, top = [np.frombuffer(recent, np.int64).reshape(-1, 2)], NEVER
        for pdf in frames:
            at = np.stack([pdf[ts].to_numpy("datetime64[us]").astype(np.int64), pdf[order].to_numpy(np.int64)], 1)
            bad = pdf[failed].to_numpy(bool)
            parts.append(at[bad])
            top = max(top, int(at[:, 0].max()))
            best = max(map(tuple, at[~bad].tolist()), default=(NEVER, NEVER))
            if best > (ok, ok_id):
                (ok, ok_id), old = best, 0
        run = np.concatenate(parts)
        run = run[(run[:, 0] > ok) | ((run[:, 0] == ok) & (run[:, 1] > ok_id))]
        if len(run):
            last = max(last, int(run[:, 0].max()))
        old += int((run[:, 0] < passed).sum())
        run = run[run[:, 0] >= passed]
        length = old + len(run)
        state.update((ok, ok_id, old, run.tobytes(), last, n + 1))
        until = last + wait_s * 1_000_000 if length >= failures else max(top, ok, last) + ttl_s * 1_000_000
        state.setTimeoutTimestamp(max(until, passed) // 1000 + 1)
        yield pd.DataFrame({source: [key[0]], "run": [length], "state": ["OPEN" if length >= failures else "CLOSED"], "last": pd.to_datetime([None if last == NEVER else last], unit="us"), "n": [n + 1]})

    kind = sdf.schema[source].dataType.simpleString()
    schema = "ok long, ok_id long, old long, recent binary, last long, n long"
    return sdf.withWatermark(ts, delay).groupBy(source).applyInPandasWithState(step, f"{source} {kind}, run long, state string, last timestamp, n long", schema, "update", "EventTimeTimeout")


def latest_state(updates: DataFrame, source: str) -> DataFrame:
    """The last row of every source among the rows of ``breaker_state``."""
    return updates.groupBy(source).agg(F.max_by(F.struct("run", "state", "last"), "n").alias("s")).select(source, "s.run", "s.state", "s.last")


def breaker_batch(df: DataFrame, source: str, ts: str, failed: str, now, failures: int = 5, wait_s: int = 60) -> DataFrame:
    """The batch twin, by the time of the last success: OPEN, HALF_OPEN after ``wait_s`` seconds without a failure, or CLOSED."""
    last = df.groupBy(source).agg(F.max(F.when(~F.col(failed), F.struct(ts, "event_id"))).alias("ok"))
    tail = df.join(last, source).where(F.col(failed) & (F.col("ok").isNull() | (F.struct(ts, "event_id") > F.col("ok"))))
    runs = tail.groupBy(source).agg(F.count(F.lit(1)).alias("run"), F.max(ts).alias("last_failure"))
    waited = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_failure") >= wait_s
    state = F.when(F.coalesce("run", F.lit(0)) < failures, "CLOSED").when(waited, "HALF_OPEN").otherwise("OPEN")
    return last.join(runs, source, "left").select(source, F.coalesce("run", F.lit(0)).cast("long").alias("run"), state.alias("state"))


def stream_health(sdf: DataFrame, source: str = "source") -> DataFrame:
    return sdf.groupBy(source).agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg((F.col("status") == "SUCCESS").cast("double")), 4).alias("success_rate"))


def stream_sessions(sdf: DataFrame, key: str, ts: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of a key: rows with no gap of ``gap`` between them."""
    s = F.session_window(ts, gap)
    return sdf.withWatermark(ts, delay).groupBy(key, s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), "n")


def late_repair(table: DataFrame, batch: DataFrame, keys: list[str], recompute) -> DataFrame:
    """What a micro-batch with late rows makes of a table: the keys it touches are recomputed and replaced. For ``foreachBatch``."""
    return replace_by_key(table, recompute(batch.select(*keys).distinct()), keys)


def repair_stream(sdf: DataFrame, out: str, ts: str, recompute, delay: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """Run a stream into a table of days that late rows repair: (the table, the late rows).

    A row is late if its day's results were final: its time is more than ``delay`` seconds before the latest of the batches before its own. Each batch's rows are kept by day, late
    ones in a side table as well, and the days that a batch touches are computed anew from all their rows by ``recompute(rows)`` (column ``day``) and replaced; other days are not
    read. A batch that runs again after a failure writes the same files.
    """
    spark = sdf.sparkSession

    def step(batch: DataFrame, k: int) -> None:
        marks = [r["mark"] for r in spark.read.schema("batch int, mark double").json(f"{out}/marks").where(F.col("batch") < k).collect()] if k else []
        seconds = F.col(ts).cast("timestamp").cast("double")
        late = seconds < F.lit(max(marks, default=float("-inf")) - delay)
        rows = batch.withColumn("day", F.to_date(ts)).withColumn("late", F.coalesce(late, F.lit(False)))
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{out}/rows/batch={k}")
        mine = spark.read.parquet(f"{out}/rows/batch={k}")
        mine.where("late").write.mode("overwrite").parquet(f"{out}/late/batch={k}")
        facts = mine.agg(F.max(seconds).alias("mark"), F.collect_set("day").alias("days")).first()  # days of a batch, not rows
        spark.createDataFrame([(k, facts["mark"] if facts["mark"] is not None else float("-inf"))], "batch int, mark double").coalesce(1).write.mode("overwrite").json(f"{out}/marks/batch={k}")
        touched = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows").where(F.col("day").isin(facts["days"]) & (F.col("batch") <= k))
        recompute(touched.drop("batch", "late")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/table")

    sdf.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table"), spark.read.parquet(f"{out}/late")


def stream_drift(sdf: DataFrame, fields: str = "fields") -> DataFrame:
    """A drift report for every micro-batch: (batch, counts, is_drifting)."""
    spark, out = sdf.sparkSession, sink_dir(sdf.sparkSession)

    def report(batch: DataFrame, k: int) -> None:
        drift_report(validate_records(batch, fields)).withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/k={k}")

    sdf.writeStream.foreachBatch(report).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("k")


def stream_enrich(sdf: DataFrame, *dims: tuple[DataFrame, str]) -> DataFrame:
    for dim, key in dims:
        sdf = sdf.join(dim, key)
    return sdf
