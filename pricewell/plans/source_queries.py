"""Queries on readers, exports and stores: files are written from the given tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.functions import columns as fn
from pricewell.operators import text as t
from pricewell.operators import timeseries as ts
from pricewell.sources import files as f
from pricewell.streaming.ops import sink_dir

from .registry import query
from .views import fares, read, series, weights, with_views


def csv(df, *, sep=",") -> str:
    """Folder of the rows as CSV with a header, as its path."""
    path = sink_dir(df.sparkSession)
    df.write.csv(path, header=True, sep=sep, nullValue="", emptyValue="")
    return path


def months(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period"), "o_orderpriority")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS period, 'N' || substr(o_orderpriority, 1, 1) AS origin_airport, 'BOM' AS destination_airport, count(*)::DOUBLE AS passenger_volume,
  count(DISTINCT o_custkey)::INTEGER AS carrier_count, 'orders' AS source_publication FROM orders GROUP BY ALL""")
def read_traffic(spark, sf_dir):
    """Airports come in lower case with blanks around."""
    rows = months(spark, sf_dir).agg(F.count(F.lit(1)).alias("passenger_volume"), F.count_distinct("o_custkey").alias("carrier_count"))
    rows = rows.select("period", F.concat(F.lit(" n"), F.substring("o_orderpriority", 1, 1), F.lit(" ")).alias("origin_airport"), F.lit("bom").alias("destination_airport"), "passenger_volume", "carrier_count", F.lit("orders").alias("source_publication"))
    return f.read_traffic(spark, csv(rows.drop_duplicates(["period", "origin_airport"])))


BENCH = "SELECT strftime(o_orderdate, '%Y-%m') AS period, 'P' || substr(o_orderpriority, 1, 1) AS indicator_name, 2015 AS base_year, round(avg(o_totalprice), 2) AS index_value, '{0}' AS source_agency, 'x' AS publication_title FROM orders GROUP BY ALL"


def benchmark_rows(spark, sf_dir, agency):
    rows = months(spark, sf_dir).agg(F.round(F.avg("o_totalprice"), 2).alias("index_value"))
    return rows.select("period", F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("indicator_name"), F.lit(2015).alias("base_year"), "index_value", F.lit(agency).alias("source_agency"), F.lit("x").alias("publication_title"))


@query(f"SELECT * REPLACE (CASE WHEN period >= '1998-01' AND indicator_name <> 'P1' THEN 'new' ELSE 'old' END AS source_agency) FROM ({BENCH.format('old')})")
def read_benchmark(spark, sf_dir):
    """From 1998 on newer values replace the old ones, but for rows without a value."""
    old = f.read_benchmark(spark, csv(benchmark_rows(spark, sf_dir, "old")))
    newer = benchmark_rows(spark, sf_dir, "new").where("period >= '1998-01'").withColumn("index_value", F.when(F.col("indicator_name") != "P1", F.col("index_value")))
    return f.read_benchmark(spark, csv(newer), old)


@query("""SELECT cast(o_orderdate AS DATE) AS date, 'L' || (o_custkey % 3) AS location, round(max(o_totalprice), 2) AS price_per_kl,
  CASE WHEN o_custkey % 3 = 1 THEN 'second' ELSE 'first' END AS source FROM orders GROUP BY ALL""")
def read_fuel(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.concat(F.lit("L"), F.col("o_custkey") % 3).alias("location")).agg(F.round(F.max("o_totalprice"), 2).alias("price_per_kl"))
    old = f.read_fuel(spark, csv(rows.withColumn("source", F.lit("first"))))
    return f.read_fuel(spark, csv(rows.where("location = 'L1'").withColumn("source", F.lit("second"))), old)


@query("""SELECT cast(o_orderdate AS DATE) AS effective_from, CASE WHEN o_orderkey % 3 > 0 THEN cast(o_orderdate AS DATE) + 30 END AS effective_to, o_orderpriority AS tax_type,
  o_totalprice AS rate, cast(o_orderkey AS VARCHAR) AS source FROM orders""")
def read_tax(spark, sf_dir):
    until = F.when(F.col("o_orderkey") % 3 > 0, F.date_add("o_orderdate", 30).cast("string")).otherwise(F.lit(" "))
    rows = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("effective_from"), until.alias("effective_to"), F.col("o_orderpriority").alias("tax_type"), F.col("o_totalprice").alias("rate"), F.col("o_orderkey").cast("string").alias("source"))
    return f.read_tax(spark, csv(rows))


@query("""SELECT 'R' || (o_custkey % 20) AS route_code, strftime(o_orderdate, '%Y-%m') AS period, o_orderpriority AS sector, round(arg_min(o_totalprice, o_orderkey), 2) AS fare
FROM orders WHERE o_custkey % 20 < 15 GROUP BY ALL""")
def read_monthly_fares(spark, sf_dir):
    """Rows lie in the files, and the files by their names, by order; routes from 15 on are not known."""
    rows = read(spark, sf_dir, "orders").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey").sortWithinPartitions("o_orderkey")
    rows = rows.select(F.concat(F.lit("R"), F.col("o_custkey") % 20).alias("route_code"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_orderpriority").alias("sector"), F.round("o_totalprice", 2).alias("fare"))
    known = spark.range(15).select(F.concat(F.lit("R"), "id").alias("route_code"))
    return f.read_monthly_fares(spark, csv(rows), known)


@query("SELECT p_partkey AS page, p_brand AS text, p_size::DOUBLE AS x1, 10.0::DOUBLE AS y1, (p_size + 30)::DOUBLE AS x2, 15.0::DOUBLE AS y2, 0.96::DOUBLE AS score FROM part WHERE p_partkey % 7 <> 0")
def read_word_rows(spark, sf_dir):
    """Rows of another level than words, and blank words, are left out."""
    parts = read(spark, sf_dir, "part")
    rows = parts.select(F.when(F.col("p_partkey") % 7 == 0, 4).otherwise(5).alias("level"), F.col("p_partkey").alias("page_num"), F.col("p_size").alias("left"), F.lit(10).alias("top"), F.lit(30).alias("width"), F.lit(5).alias("height"), F.lit(96).alias("conf"), F.col("p_brand").alias("text"))
    blank = rows.limit(5).withColumns({"level": F.lit(5), "text": F.lit(" ")})
    return t.read_word_rows(spark, csv(rows.unionByName(blank), sep="\t"))


WEIGHTED = "SELECT route, round(weight, 8) AS weight FROM weights"


@query(with_views(WEIGHTED, "weights"))
def export_daily_index(spark, sf_dir):
    path = sink_dir(spark)
    f.export_daily_index(weights(spark, sf_dir).select("route", F.round("weight", 8).alias("weight")), path, ["route"])
    return spark.read.schema("route string, weight double").csv(path, header=True)


@query(with_views(WEIGHTED, "weights"))
def export_daily_index_json(spark, sf_dir):
    path = sink_dir(spark)
    f.export_daily_index_json(weights(spark, sf_dir).select("route", F.round("weight", 8).alias("weight")), path, ["route"])
    return spark.read.schema("route string, weight double").json(path)


@query(with_views("SELECT route, round(weight, 8) AS weight, length(route)::INTEGER AS letters FROM weights WHERE route <> 'ASIA>BUILDING'", "weights"))
def export_weights(spark, sf_dir):
    path, w = sink_dir(spark), weights(spark, sf_dir).select("route", F.round("weight", 8).alias("weight"))
    f.export_weights(w, w.where("route <> 'ASIA>BUILDING'").select("route", F.length("route").alias("letters")), path)
    return spark.read.schema("route string, weight double, letters int").csv(path, header=True)


@query(with_views("""SELECT order_id, line_no, part_id, supp_id, round(base_fare, 4) AS base_fare FROM fares WHERE route = 'ASIA>BUILDING'
ORDER BY order_id DESC, line_no DESC, part_id DESC, supp_id DESC, base_fare DESC LIMIT 500""", "fares"))
def export_route_obs(spark, sf_dir):
    """The latest 500 quotes of a route, which is what the export is for."""
    path = sink_dir(spark)
    rows = fares(spark, sf_dir).select("route", "order_id", "line_no", "part_id", "supp_id", F.round("base_fare", 4).alias("base_fare"))
    f.export_route_obs(rows, "ASIA>BUILDING", 500, path, ["order_id", "line_no", "part_id", "supp_id", "base_fare"])
    return spark.read.schema("route string, order_id long, line_no long, part_id long, supp_id long, base_fare double").csv(path, header=True).drop("route")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def copy_table(spark, sf_dir):
    path = sink_dir(spark)
    f.copy_table(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path)
    return spark.read.parquet(path)


@query("SELECT sha256(html) AS payload_hash, html AS content, substr(sha256(html), 1, 2) AS prefix FROM pages WHERE page_id % 3 = 0 AND html IS NOT NULL AND html NOT IN (SELECT html FROM pages WHERE page_id % 3 > 0 AND html IS NOT NULL) GROUP BY html")
def store_payloads(spark, sf_dir):
    """What a second run adds to a store that holds two thirds of the pages."""
    pages = read(spark, sf_dir, "pages").where("html is not null").select("page_id", F.col("html").alias("content"), F.lit("2024-01-02").cast("date").alias("ts"))
    path = sink_dir(spark)
    f.store_payloads(pages.where("page_id % 3 > 0").drop("page_id"), path)
    return f.store_payloads(pages.where("page_id % 3 = 0").drop("page_id"), path).select("payload_hash", "content", "prefix")


@query(with_views("""SELECT series, cast(day + INTERVAL (h) DAY AS DATE) AS target, (h)::INTEGER AS horizon_days, round(CASE WHEN day = DATE '2024-01-10' THEN value + 1 ELSE value END, 6) AS p50, day AS forecast_date
FROM (SELECT *, unnest([1, 7]) AS h FROM series WHERE day IN (DATE '2024-01-10', DATE '2024-01-11'))""", "series"))
def append_snapshot(spark, sf_dir):
    """Forecasts of two days; those of the first are made twice, and the later ones hold."""
    path = sink_dir(spark)
    for day, add in (("2024-01-10", 0), ("2024-01-11", 0), ("2024-01-10", 1)):
        rows = series(spark, sf_dir).where(F.col("day") == day).withColumn("h", F.explode(F.array(F.lit(1), F.lit(7))))
        ts.append_snapshot(rows.select("series", F.date_add("day", F.col("h")).alias("target"), (F.col("value") + add).alias("p50")), path, ["series"], day, index_type="BASE")
    return ts.read_snapshots(spark, path).select("series", "target", "horizon_days", F.round("p50", 6).alias("p50"), "forecast_date")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 0.96 WHEN 'click' THEN 0.85 WHEN 'error' THEN 0.6 ELSE 0.5 END::DOUBLE AS weight,
  CASE WHEN value >= 90 THEN 'HIGH' WHEN value >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  CASE WHEN abs(z) >= 5 OR value > 95 THEN 'SEVERE' WHEN abs(z) >= 3.5 THEN 'MODERATE' WHEN abs(z) >= 2.5 OR value > 80 THEN 'LOW' ELSE 'NONE' END AS severity,
  round(value - 4 + 0.33 * 4, 6) AS p25, round(value + 0.67 * 6, 6) AS p75
FROM (SELECT *, value / 20 - 1 AS z FROM events)""")
def quote_scores(spark, sf_dir):
    """Weight of a method, band of a score, severity, and the inner quantiles between value - 4, value and value + 6, for every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    method = F.when(F.col("event_type") == "view", "NETWORK").when(F.col("event_type") == "click", "OCR").when(F.col("event_type") == "error", "CALIBRATED_MODEL").otherwise("other")
    v = F.col("value")
    low, high = fn.inner_quantiles(v - 4, v, v + 6)
    return e.select(
        "event_id", fn.method_weight(method).alias("weight"), fn.confidence_band(v).alias("band"), fn.severity(v / 20 - 1, v > 80, v > 95).alias("severity"),
        F.round(low, 6).alias("p25"), F.round(high, 6).alias("p75"),
    )
