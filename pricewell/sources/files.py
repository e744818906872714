"""Scans, exports and the payload store."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricewell.operators.joins import latest_per, replace_by_key

TRAFFIC = "period string, origin_airport string, destination_airport string, passenger_volume double, carrier_count int, source_publication string"
BENCHMARK = "period string, indicator_name string, base_year int, index_value double, source_agency string, publication_title string"
FUEL = "date date, location string, price_per_kl double, source string"
TAX = "effective_from date, effective_to string, tax_type string, rate double, source string"
MONTHLY = "route_code string, period string, sector string, fare double"


def _csv(spark: SparkSession, path: str, schema: str, *more: Column) -> DataFrame:
    """The schema's columns by their names in the header, in whatever order; values that are not of their type are null. A missing column is an error, further ones are left out."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    wanted = [c.strip().split(" ") for c in schema.split(",")]
    if missing := [name for name, _ in wanted if name not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    return rows.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in wanted], *more)


def _upsert(rows: DataFrame, old: DataFrame | None, keys: list[str]) -> DataFrame:
    return rows if old is None else replace_by_key(old, rows, keys)


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    rows = _csv(spark, path, TRAFFIC)
    return rows.withColumns({c: F.upper(F.trim(c)) for c in ("origin_airport", "destination_airport")})


def read_benchmark(spark: SparkSession, path: str, old: DataFrame | None = None) -> DataFrame:
    """New values replace those of the same indicator and period."""
    return _upsert(_csv(spark, path, BENCHMARK).where("index_value is not null"), old, ["indicator_name", "period"])


def read_fuel(spark: SparkSession, path: str, old: DataFrame | None = None) -> DataFrame:
    return _upsert(_csv(spark, path, FUEL), old, ["location", "date"])


def read_tax(spark: SparkSession, path: str) -> DataFrame:
    """A blank end date is an open one."""
    return _csv(spark, path, TAX).withColumn("effective_to", F.expr("try_cast(nullif(trim(effective_to), '') as date)"))


def read_monthly_fares(spark: SparkSession, path: str, routes: DataFrame) -> DataFrame:
    """Known routes only, of a route, month and sector the first row of the file, of several files that of the first by name; a file without the required columns is an error.

    A row's place is its file, the start of its split in it, and its number within the task, which rises along a split.
    """
    rows = _csv(spark, path, MONTHLY, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    rows = rows.join(routes.select("route_code"), "route_code", "left_semi")
    key = ["route_code", "period", "sector"]
    # Within a split the place is a number, and numbers are compared without a sort; a row a split and key is left for the places of splits.
    splits = rows.groupBy(*key, "__file", "__start").agg(F.min_by("fare", "__at").alias("fare"))
    return splits.groupBy(*key).agg(F.min_by("fare", F.struct("__file", "__start")).alias("fare"))


def write_fares(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quotes in folders by day and horizon, so that ``scan_fares`` reads only those it is asked for. A hot day is written by several tasks."""
    df.hint("rebalance", "obs_date", "horizon").write.mode(mode).partitionBy("obs_date", "horizon").parquet(path)


def scan_fares(df: DataFrame, day=None, horizon: int | None = None, route: str | None = None, days: DataFrame | None = None) -> DataFrame:
    """Equality filters that reach the scan; of a table written by ``write_fares`` the folders of other days and horizons are not read.

    ``days`` (obs_date) keeps the quotes of its days; folders are then chosen while the query runs. It has a row a day of the calendar at most, so it is broadcast.
    """
    for c, v in (("obs_date", day), ("horizon", horizon), ("route", route)):
        if v is not None:
            df = df.where(F.col(c) == F.lit(v))
    return df if days is None else df.join(F.broadcast(days.select("obs_date").where("obs_date is not null").distinct()), "obs_date", "left_semi")


def align_schema(df: DataFrame, target: dict[str, tuple[str, object]]) -> DataFrame:
    """The target's columns in its order; missing ones have their defaults."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)).cast(t).alias(c) for c, (t, d) in target.items()])


def read_quotes_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per quote of a JSON payload whose list is under flights, data or results, or is the payload itself."""
    lists = [F.from_json(F.get_json_object(payload, f"$.{k}"), "array<string>") for k in ("flights", "data", "results")]
    return df.withColumn("quote", F.explode(F.coalesce(*lists, F.from_json(payload, "array<string>"))))


def extract_quote_fields(df: DataFrame, quote: str = "quote") -> DataFrame:
    """Fields under their alternative names; a quote without seats is sold out."""
    get = lambda *names: F.coalesce(*[F.get_json_object(quote, f"$.{n}") for n in names])
    seats = get("seats", "seats_available").try_cast("int")
    return df.withColumns({
        "carrier": F.upper(get("carrier", "airline_code")), "flight_number": get("flight_number", "flight"), "departure_time": get("departure_time", "departure"), "total_fare": get("total_fare", "fare", "price").try_cast("double"), "base_fare": get("base_fare", "base").try_cast("double"),
        "availability_status": F.when(seats == 0, "SOLD_OUT").otherwise(F.coalesce(get("availability_status"), F.lit("AVAILABLE"))),
    })


def _ordered(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*order)


def export_daily_index(df: DataFrame, path: str, order: list[str]) -> None:
    _ordered(df, order).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def export_daily_index_json(df: DataFrame, path: str, order: list[str]) -> None:
    _ordered(df, order).write.mode("overwrite").json(path)


def export_weights(weights: DataFrame, routes: DataFrame, path: str) -> None:
    export_daily_index(weights.join(routes, "route"), path, ["route"])


def export_route_obs(fares: DataFrame, route: str, n: int, path: str, order: list[str]) -> None:
    rows = fares.where(F.col("route") == route).orderBy(*[F.desc(o) for o in order]).limit(n)
    rows.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def copy_table(src: DataFrame, path: str, mode: str = "errorifexists") -> None:
    src.write.mode(mode).parquet(path)


def hashed(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("payload_hash", F.sha2(F.col(content).cast("binary"), 256))


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders that match."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or [])


def store_payloads(df: DataFrame, path: str, ts: str = "ts", content: str = "content", old: DataFrame | None = None) -> DataFrame:
    """Write each new payload once, by content hash; what is in the store already is left as it is. The rows written, read back.

    The store is dealt into 256 folders by the hash, within these by run. The hashes of the folders concerned are read, not the payloads, and a manifest names the folders that a run
    wrote, which alone are read back. Runs at the same time may both write a hash: ``stored_payloads`` takes that of the earlier run. ``old`` (payload_hash): what another store has.
    """
    spark, run = df.sparkSession, f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows = latest_per(hashed(df, content), ["payload_hash"], [ts]).withColumn("prefix", F.substring("payload_hash", 1, 2))
    if _folders(spark, f"{path}/prefix=*"):
        rows = rows.join(spark.read.parquet(path).select("prefix", "payload_hash"), ["prefix", "payload_hash"], "left_anti")
    if old is not None:
        rows = rows.join(old.select("payload_hash"), "payload_hash", "left_anti")
    rows = rows.withColumns({"y": F.year(ts), "m": F.month(ts), "d": F.dayofmonth(ts), "run": F.lit(run)})
    rows.write.mode("append").partitionBy("prefix", "run").parquet(path)
    written = _folders(spark, f"{path}/prefix=*/run={run}")  # at most 256
    manifest = spark.createDataFrame([(run, w.rsplit("prefix=", 1)[1].split("/")[0]) for w in written], "run string, prefix string")
    manifest.coalesce(1).write.mode("append").json(f"{path}/_manifests/run={run}")
    return payloads_of_run(spark, path, run, rows.schema)


def payloads_of_run(spark: SparkSession, path: str, run: str, schema: StructType | None = None) -> DataFrame:
    """What a run wrote, from the folders that its manifest names."""
    names = [r["prefix"] for r in spark.read.schema("prefix string").json(f"{path}/_manifests/run={run}").collect()]
    if not names:
        return spark.createDataFrame([], schema or spark.read.parquet(path).schema)
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(*[f"{path}/prefix={n}/run={run}" for n in names])


def stored_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The store, each hash once: as the earliest run wrote it."""
    rows = spark.read.parquet(path)
    first = rows.groupBy("prefix", "payload_hash").agg(F.min("run").alias("run"))
    return rows.join(first, ["prefix", "payload_hash", "run"], "left_semi")


def verify_payloads(df: DataFrame, content: str = "content", stored: str | Column = "payload_hash") -> DataFrame:
    return df.withColumn("intact", F.sha2(F.col(content).cast("binary"), 256).eqNullSafe(F.col(stored) if isinstance(stored, str) else stored))
