"""Queries on operators that pass rows on with something beside them: the rows themselves are compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.functions import columns as fn
from pricewell.operators import clean as c
from pricewell.operators import index as ix
from pricewell.operators import joins as j
from pricewell.streaming import ops as o

from .clean_queries import records
from .join_queries import SCD, scd
from .registry import query
from .stream_queries import stream
from .views import fares, kept, read, with_views

QUOTE = ["order_id", "line_no", "part_id", "supp_id"]
_Q = ", ".join(QUOTE)


@query("""SELECT c_custkey, c_mktsegment, n_name, r_name FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def enrich(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    customers = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return j.enrich(customers, (nation, "n_nationkey"), (read(spark, sf_dir, "region"), "r_regionkey")).select("c_custkey", "c_mktsegment", "n_name", "r_name")


@query(with_views(f"""SELECT {_Q}, carrier, coalesce(weight, 0.1) AS weight FROM fares
LEFT JOIN (SELECT 'C' || n_nationkey AS carrier, n_regionkey / 2.0::DOUBLE AS weight FROM nation WHERE n_nationkey < 4) USING (carrier)""", "fares"))
def lookup_default(spark, sf_dir):
    known = read(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.concat(F.lit("C"), "n_nationkey").alias("carrier"), (F.col("n_regionkey") / 2.0).alias("weight"))
    return j.lookup_default(fares(spark, sf_dir), known, "carrier", "weight", 0.1).select(*QUOTE, "carrier", "weight")


@query(with_views(f"""SELECT {_Q}, feed_type, round(base_fare, 4) AS base_fare, CASE WHEN feed_type = 'OTA_AGGREGATOR' THEN source_id END AS source_id
FROM fares WHERE feed_type <> 'SYNTHETIC_BASELINE'""", "fares"))
def union_feeds(spark, sf_dir):
    """One of the feeds has a column that the others lack."""
    quotes = kept(fares(spark, sf_dir).select(*QUOTE, "feed_type", F.round("base_fare", 4).alias("base_fare"), "source_id").where("feed_type <> 'SYNTHETIC_BASELINE'"))
    part = lambda f: quotes.where(F.col("feed_type") == f)
    return j.union_feeds(part("CARRIER_DIRECT").drop("source_id"), part("RPC_FALLBACK").drop("source_id"), part("OTA_AGGREGATOR"))


@query(with_views(f"""SELECT {_Q}, f.route, obs_date, round(w.weight, 6) AS weight, effective_from FROM fares f
JOIN {SCD} w ON f.route = w.route AND effective_from <= obs_date AND (effective_to IS NULL OR effective_to >= obs_date)""", "weights"))
def active_on(spark, sf_dir):
    return ix.active_on(fares(spark, sf_dir), scd(spark, sf_dir), "obs_date", "route").select(*QUOTE, "route", "obs_date", F.round("weight", 6).alias("weight"), "effective_from")


METHOD = "CASE WHEN part_id % 5 = 0 THEN 'CALIBRATED_MODEL' WHEN part_id % 5 = 1 THEN 'NETWORK' END"


@query(with_views(f"""SELECT {_Q}, feed_type = 'SYNTHETIC_BASELINE' OR coalesce({METHOD} = 'CALIBRATED_MODEL', false) AS synthetic FROM fares""", "fares"))
def is_synthetic(spark, sf_dir):
    return fares(spark, sf_dir).select(*QUOTE, fn.is_synthetic(F.col("feed_type"), F.expr(METHOD)).alias("synthetic"))


@query(with_views("""SELECT part_id, concat_ws(',', CASE WHEN part_id % 31 = 0 THEN 'missing_required_field:origin_airport' END,
  CASE WHEN part_id % 29 = 0 THEN 'bad_flight_number:bad' END, CASE WHEN part_id % 37 = 0 THEN 'non_numeric:total_fare=x' END) AS issues, count(*) AS n FROM fares GROUP BY ALL""", "fares"))
def validate_records(spark, sf_dir):
    """The issues of each part's records."""
    return c.validate_records(records(spark, sf_dir)).groupBy("part_id", F.array_join("issues", ",").alias("issues")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id AS c_custkey, event_type, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def stream_enrich(spark, sf_dir):
    enriched = o.stream_enrich(stream(spark, sf_dir).withColumnRenamed("user_id", "c_custkey"), (read(spark, sf_dir, "customer"), "c_custkey"))
    return o.drain(enriched.select("event_id", "c_custkey", "event_type", "c_mktsegment"), "append")
