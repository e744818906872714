"""Quotes and related tables as views on the given star schema. The SQL of a view is shared by Spark and the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricewell.streaming.ops import sink_dir

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

#: One row per quote. order_id and line_no don't identify it: together with part_id, supp_id and the prices they break ties.
FARES = """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
  cast(date_trunc('month', o_orderdate) AS date) AS obs_date, cast(o_orderdate AS date) AS search_date,
  cast(l_shipdate AS date) AS travel_date,
  r_name || '>' || c_mktsegment AS route, 'C' || cast(s_nationkey % 7 AS string) AS carrier,
  CASE l_linenumber % 5 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 15 WHEN 3 THEN 30 ELSE 45 END AS horizon,
  floor(l_extendedprice / l_quantity * 100) / 100 AS base_fare, floor(l_extendedprice / l_quantity * 100) / 100 * (1 + l_tax) AS total_fare,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'SOLD_OUT' ELSE 'AVAILABLE' END AS status,
  CASE l_partkey % 4 WHEN 0 THEN 'CARRIER_DIRECT' WHEN 1 THEN 'RPC_FALLBACK' WHEN 2 THEN 'OTA_AGGREGATOR' ELSE 'SYNTHETIC_BASELINE' END AS feed_type,
  CASE WHEN p_size <= 35 THEN 'BASIC' ELSE 'FLEXI' END AS fare_family,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'BUSINESS' ELSE 'ECONOMY' END AS cabin,
  'C' || cast(s_nationkey % 7 AS string) || '-' || cast(100 + l_partkey % 900 AS string) AS flight,
  l_suppkey % 8 AS source_id, l_quantity AS pax
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
"""
#: Passengers by route as weights, valid from the beginning on.
WEIGHTS = "SELECT route, sum(pax) AS volume, sum(pax) / sum(sum(pax)) OVER () AS weight FROM fares GROUP BY route"
#: A daily series from the event stream: mean value by day and event type.
SERIES = """
SELECT event_type AS series, cast(ts AS date) AS day, avg(value) AS value, count(*) AS n FROM events GROUP BY event_type, cast(ts AS date)
"""
#: A collection log from the event stream.
JOBS = """
SELECT event_id AS job_id, user_id AS source, ts, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  value AS latency, event_type FROM events
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    """Run a view's SQL over the tables of ``sf_dir`` that it names."""
    used = {t: read(spark, sf_dir, t) for t in TABLES if f" {t} " in f"{text} ".replace("\n", " ").replace(",", " ")}
    for name, df in {**used, **more}.items():
        text = _replace(text, name)
        used[name] = df
    return spark.sql(text, **used)


def _replace(text: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", text)


#: Lines of a task in which lines and orders meet, and the least number of such tasks for which lines are dealt out by number.
TASK_LINES, LEAST_TASKS = 500_000, 24


def fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many lines meet their orders in tasks of TASK_LINES each: Spark sizes tasks by compressed bytes, of which these narrow rows have few, and a task would sort tens of millions."""
    lines = read(spark, sf_dir, "lineitem")
    tasks = lines.count() // TASK_LINES  # read from the footers
    return view(spark, sf_dir, FARES, **({"lineitem": lines.repartition(tasks, "l_orderkey")} if tasks >= LEAST_TASKS else {}))


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for queries that read it several times: its joins run once. The schema is passed on, so that reading needs no job."""
    path = sink_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What indices and reports read of a quote.
QUOTED = ["obs_date", "search_date", "travel_date", "route", "carrier", "horizon", "base_fare", "total_fare", "status", "feed_type", "fare_family", "cabin", "pax"]


def weights(spark: SparkSession, sf_dir: str, quotes: DataFrame | None = None) -> DataFrame:
    """Weights of the given quotes, by default all: a query that has the quotes passes them, and files are listed once."""
    return view(spark, sf_dir, WEIGHTS, fares=fares(spark, sf_dir) if quotes is None else quotes)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SERIES)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, JOBS)


def money_sql(x: str, digits: int = 2) -> str:
    """``money`` of ``functions.columns`` in SQL."""
    return f"round(cast({x} AS DECIMAL(24, 8)), {digits})::DOUBLE"


def with_views(body: str, *names: str) -> str:
    """Oracle SQL: ``body`` behind the named views."""
    all_views = {"fares": FARES, "weights": WEIGHTS, "series": SERIES, "jobs": JOBS}
    needed = [n for n in all_views if n in names or (n == "fares" and "weights" in names)]
    return "WITH " + ", ".join(f"{n} AS ({all_views[n]})" for n in needed) + "\n" + body
