"""Queries on scans, payloads, JSON and texts. Payloads are made by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.operators import text as t
from pricewell.sources import files as f

from .analytics_queries import add, events
from .views import fares, read, with_views



def n():
    return F.count(F.lit(1)).alias("n")


add("scan_fares", with_views("SELECT carrier, count(*) AS n FROM fares WHERE obs_date = DATE '1996-03-01' AND horizon = 15 GROUP BY 1", "fares"), lambda s, d: f.scan_fares(fares(s, d), "1996-03-01", 15).groupBy("carrier").agg(n()))
add("align_schema", "SELECT event_id, event_type, 'INR' AS currency, value FROM events", lambda s, d: f.align_schema(events(s, d), {"event_id": ("long", 0), "event_type": ("string", ""), "currency": ("string", "INR"), "value": ("double", 0.0)}))
PAY = "to_json(struct(array(struct(o_orderkey as flight, 'ai' as airline_code, o_totalprice as price, cast(o_orderkey % 3 as int) as seats)) as data))"
add("extract_quote_fields", "SELECT o_orderkey, 'AI' AS carrier, o_totalprice AS total_fare, CASE WHEN o_orderkey % 3 = 0 THEN 'SOLD_OUT' ELSE 'AVAILABLE' END AS availability_status FROM orders", lambda s, d: f.extract_quote_fields(f.read_quotes_json(read(s, d, "orders").select("o_orderkey", F.expr(PAY).alias("payload")))).select("o_orderkey", "carrier", "total_fare", "availability_status"))
add("read_quotes_json", "SELECT o_orderkey, 1::BIGINT AS n FROM orders", lambda s, d: f.read_quotes_json(read(s, d, "orders").select("o_orderkey", F.expr(PAY).alias("payload"))).groupBy("o_orderkey").agg(n()))
add("verify_payloads", "SELECT page_id, sha256(html) AS payload_hash, page_id % 5 <> 0 AS intact FROM pages", lambda s, d: f.verify_payloads(f.hashed(read(s, d, "pages").withColumnRenamed("html", "content")).withColumn("content", F.expr("if(page_id % 5 = 0, content || 'x', content)"))).select("page_id", "payload_hash", "intact"))
add("card_fields", "SELECT p_partkey, p_retailprice AS price, 'DEL' AS origin, 'BOM' AS destination, '6E-' || (100 + p_partkey % 900) AS flight, '06:30' AS departs, '08:45' AS arrives, (p_size % 3)::INTEGER AS stops, 135 AS minutes FROM part", lambda s, d: t.card_fields(read(s, d, "part").select("p_partkey", F.expr("'DEL - BOM 06:30 08:45 2h 15m ' || cast(p_size % 3 as string) || ' stop 6E-' || cast(100 + p_partkey % 900 as string) || ' INR ' || cast(p_retailprice as string)").alias("text")), "text").drop("text"))
add("card_dates", "SELECT o_orderkey, cast(o_orderdate AS DATE) AS travel_date, cast(o_orderdate + INTERVAL 3 DAY AS DATE) AS return_date FROM orders", lambda s, d: t.card_dates(read(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("ref"), F.expr("'from ' || date_format(o_orderdate, 'd MMM yyyy') || ' back ' || date_format(date_add(o_orderdate, 3), 'yyyy-MM-dd')").alias("text")), "text", "ref").select("o_orderkey", "travel_date", "return_date"))
add("cluster_tokens", "SELECT l_orderkey AS page, count(*) AS tokens, count(DISTINCT l_linenumber) AS cards FROM lineitem GROUP BY 1", lambda s, d: t.cluster_tokens(read(s, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("text"), F.col("l_partkey").cast("double").alias("x1"), (F.col("l_linenumber") * 100.0).alias("y1"), (F.col("l_partkey") + 10.0).alias("x2"), (F.col("l_linenumber") * 100.0 + 10).alias("y2")), "page").groupBy("page").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("cards")))
add("json_values", "SELECT event_id, cast(json_extract(props, '$.k') AS VARCHAR) AS value FROM events", lambda s, d: t.json_values(events(s, d).select("event_id", F.expr("'{\"a\":[{\"b\":' || props || '}]}'").alias("payload")), "payload", "k"))
PRICED = "to_json(struct(struct(o_totalprice as totalPrice, 12 as fareAmount, array(struct(o_totalprice + 100 as GRANDTOTAL, o_custkey as price)) as legs) as x, cast(o_totalprice as string) as totalamount, struct(struct(o_totalprice as totalFare) as y) as total))"
add("json_prices", "SELECT o_orderkey, rank::INTEGER AS rank, round(price, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY price) - 1 AS rank FROM (SELECT o_orderkey, unnest([o_totalprice, o_totalprice + 100]) AS price FROM orders) WHERE price BETWEEN 1500 AND 60000)", lambda s, d: t.json_prices(read(s, d, "orders").select("o_orderkey", F.expr(PRICED).alias("payload")), "payload", "o_orderkey").withColumn("price", F.round("price", 2)))
AV = "to_json(struct(array(struct(array(struct(concat('6E-', o_orderkey) as flight, '06:30' as departure, array(struct('a' as key, 3 as seats), struct('b' as key, 0 as seats)) as fares)) as journeys)) as trips, map('a', o_totalprice, 'b', o_totalprice + 10) as catalog))"
add("flatten_availability", "SELECT o_orderkey, '6E-' || o_orderkey AS flight, '06:30' AS departure, o_totalprice AS price, 3 AS seats FROM orders", lambda s, d: t.flatten_availability(read(s, d, "orders").select("o_orderkey", F.expr(AV).alias("payload")), "payload", "o_orderkey"))
OF = "to_json(struct(array(struct(o_totalprice as total, cast(o_orderkey % 2 as int) as seats, array(struct(concat('6E-', o_orderkey) as flight, '06:30' as departure)) as flights), struct(o_totalprice + 5 as total, 4 as seats, array(struct(concat('6E-', o_orderkey) as flight, '06:30' as departure)) as flights)) as offers))"
#: The second offer costs 5 more and has 4 seats; it counts where only it is within the band.
OFFERS_SQL = """SELECT o_orderkey, '6E-' || o_orderkey AS flight, '06:30' AS departure, round(price, 2) AS price, seats, CASE WHEN seats = 0 THEN 'SOLD_OUT' ELSE 'AVAILABLE' END AS availability_status FROM
 (SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1500 AND 60000 THEN o_totalprice ELSE o_totalprice + 5 END AS price, CASE WHEN o_totalprice BETWEEN 1500 AND 60000 THEN o_orderkey % 2 ELSE 4 END::INTEGER AS seats
 FROM orders WHERE o_totalprice BETWEEN 1500 AND 60000 OR o_totalprice + 5 BETWEEN 1500 AND 60000)"""
add("flatten_offers", OFFERS_SQL, lambda s, d: t.flatten_offers(read(s, d, "orders").select("o_orderkey", F.expr(OF).alias("payload")), "payload", "o_orderkey").withColumn("price", F.round("price", 2)))
