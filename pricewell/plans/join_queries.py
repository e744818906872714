"""Queries on joins, sets, sorts and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.operators import analytics as a
from pricewell.operators import clean
from pricewell.operators import index as ix
from pricewell.operators import joins as j

from .analytics_queries import add, events, pair
from .views import fares, read, series, weights, with_views

SUM = "count(*) AS n, round(sum(base_fare), 2) AS total"


def total(df):
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("base_fare"), 2).alias("total"))


def S(s, d, name):
    return series(s, d).where(F.col("series") == name)


def calendar(s, d):
    """Peak days: the days with most events."""
    return events(s, d).where("event_type = 'signup' and hour(ts) < 1").select(F.to_date("ts").alias("day")).distinct()


CAL = "cal AS (SELECT DISTINCT cast(ts AS DATE) AS day FROM events WHERE event_type = 'signup' AND hour(ts) < 1)"
add("compare_series", with_views("SELECT day, a.value AS a, b.value AS b, round(a.value - b.value, 4) AS gap, round(100 * (a.value - b.value) / nullif(b.value, 0), 4) AS gap_pct FROM (SELECT day, round(value, 6) AS value FROM series WHERE series = 'view' AND day < DATE '2024-01-20') a FULL OUTER JOIN (SELECT day, round(value, 6) AS value FROM series WHERE series = 'click' AND day > DATE '2024-01-05') b USING (day)", "series"), lambda s, d: j.compare_series(S(s, d, "view").where("day < '2024-01-20'").withColumn("value", F.round("value", 6)), S(s, d, "click").where("day > '2024-01-05'").withColumn("value", F.round("value", 6)), ["day"]))
add("align", with_views("SELECT day, round(a.value, 6) AS a, round(b.value, 6) AS b FROM (SELECT * FROM series WHERE series = 'view') a JOIN (SELECT * FROM series WHERE series = 'click') b USING (day)", "series"), lambda s, d: j.align(S(s, d, "view").select("day", F.round("value", 6).alias("a")), S(s, d, "click").select("day", F.round("value", 6).alias("b")), ["day"]))
add("pair_cohorts", with_views("SELECT route, obs_date, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT route, obs_date, avg(base_fare) FILTER (feed_type = 'CARRIER_DIRECT') AS a, avg(base_fare) FILTER (feed_type = 'OTA_AGGREGATOR') AS b FROM fares GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL", "fares"), lambda s, d: j.pair_cohorts(fares(s, d), "feed_type", ["route", "obs_date"], "base_fare", "CARRIER_DIRECT", "OTA_AGGREGATOR").select("route", "obs_date", F.round("a", 6).alias("a"), F.round("b", 6).alias("b")))


def _slots(s, d, kind, name):
    """Quotes from events: one user is one carrier and day."""
    return events(s, d).where(F.col("event_type") == kind).select(F.to_date("ts").alias("day"), (F.col("user_id") % 20).alias("carrier"), (F.hour("ts") * 60 + F.minute("ts")).alias("minutes"), (F.col("event_id") % 97).alias("flight"), F.col("value").alias("price"), F.col("event_id").alias(name))


K = ["day", "carrier"]
SLOT = "(SELECT cast(ts AS DATE) AS day, user_id % 20 AS carrier, hour(ts) * 60 + minute(ts) AS minutes, event_id % 97 AS flight, value AS price, event_id AS id FROM events WHERE event_type = '{0}')"
NEAR = f"near AS (SELECT l.id AS lid, r.id AS rid, abs(l.minutes - r.minutes) AS delta, 1 AS rank FROM {SLOT.format('view')} l JOIN {SLOT.format('click')} r USING (day, carrier) WHERE abs(l.minutes - r.minutes) <= 35 UNION ALL SELECT l.id, r.id, 0, 0 FROM {SLOT.format('view')} l JOIN {SLOT.format('click')} r USING (day, carrier, flight))"
_r = [NEAR]
for _i in range(4):
    _src = "near" if _i == 0 else f"n{_i}"
    _r.append(f"m{_i} AS (SELECT lid, rid, delta FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY rank, delta, rid) AS a, row_number() OVER (PARTITION BY rid ORDER BY rank, delta, lid) AS b FROM {_src}) WHERE a = 1 AND b = 1)")
    _r.append(f"n{_i + 1} AS (SELECT * FROM {_src} WHERE lid NOT IN (SELECT lid FROM m{_i}) AND rid NOT IN (SELECT rid FROM m{_i}))")
# Four rounds leave no pair in the given tables. Should there be one, it is added with an impossible distance, so that the comparison fails.
_r.append("m AS (" + " UNION ALL ".join(f"SELECT * FROM m{_i}" for _i in range(4)) + " UNION ALL SELECT lid, rid, 1000000 + delta FROM n4)")
MATCH = "WITH " + ", ".join(_r)
add("match_nearest", MATCH + " SELECT lid, rid, delta::INTEGER AS delta FROM m", lambda s, d: j.match_nearest(_slots(s, d, "view", "lid"), _slots(s, d, "click", "rid"), K, "minutes", exact="flight").withColumn("delta", F.col("delta").cast("int")))
add("nearest_min", f"""SELECT lid, delta::INTEGER AS delta, round(rp, 4) AS price, CASE WHEN abs((lp - rp) / rp) <= 0.15 THEN 'MATCH' WHEN lp > rp THEN 'HIGHER' ELSE 'LOWER' END AS label FROM (SELECT lid, any_value(lp) AS lp, min((delta, rp)) AS m, m[1] AS delta, m[2] AS rp FROM
 (SELECT l.id AS lid, l.price AS lp, abs(l.minutes - r.minutes) AS delta, r.price AS rp FROM {SLOT.format('view')} l JOIN {SLOT.format('click')} r USING (day, carrier) WHERE abs(l.minutes - r.minutes) <= 25 AND r.price <> 0) GROUP BY lid)""".replace("any_value(lp) AS lp, min((delta, rp)) AS m, m[1] AS delta, m[2] AS rp", "any_value(lp) AS lp, min(struct_pack(delta := delta, rp := rp)).delta AS delta, min(struct_pack(delta := delta, rp := rp)).rp AS rp"), lambda s, d: j.nearest_min(_slots(s, d, "view", "lid"), _slots(s, d, "click", "rid").where("price <> 0"), K, "minutes", "price").withColumn("delta", F.col("delta").cast("int")))
add("unmatched", "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", lambda s, d: j.unmatched(read(s, d, "customer").withColumnRenamed("c_custkey", "k"), read(s, d, "orders").withColumnRenamed("o_custkey", "k"), ["k"]).agg(F.count(F.lit(1)).alias("n")))
AUDIT = MATCH + f""", audits AS (SELECT lid, rid, round(r.price - l.price, 2) AS difference, round(100 * abs(r.price - l.price) / nullif(l.price, 0), 2) AS difference_pct, CASE WHEN abs(r.price - l.price) <= 5 THEN 'EXACT_PARITY' WHEN r.price > l.price THEN 'AGGREGATOR_MARKUP' ELSE 'AGGREGATOR_DISCOUNT' END AS status
 FROM m JOIN {SLOT.format('view')} l ON lid = l.id JOIN {SLOT.format('click')} r ON rid = r.id UNION ALL SELECT NULL, id, NULL, NULL, 'FALLBACK_RPC_USED' FROM {SLOT.format('click')} WHERE id NOT IN (SELECT rid FROM m))"""


def audits(s, d, **more):
    return j.reconcile(_slots(s, d, "view", "lid"), _slots(s, d, "click", "rid"), K, "minutes", "price", "flight", parity=5.0, **more)


add("reconcile", AUDIT + " SELECT * FROM audits", audits)
add("reconcile_all", AUDIT + f" SELECT * FROM audits UNION ALL SELECT id, NULL, NULL, NULL, 'DIRECT_ONLY' FROM {SLOT.format('view')} WHERE id NOT IN (SELECT lid FROM m)", lambda s, d: audits(s, d, direct_only=True))
add("reconciliation_score", AUDIT + " SELECT count(*) AS total, count(*) FILTER (status = 'EXACT_PARITY') AS parity, count(*) FILTER (status = 'AGGREGATOR_MARKUP') AS markup, count(*) FILTER (status = 'AGGREGATOR_DISCOUNT') AS discount, count(*) FILTER (status = 'FALLBACK_RPC_USED') AS fallback, round(avg(difference_pct), 2) AS avg_difference_pct FROM audits", lambda s, d: j.reconciliation_score(audits(s, d)))
add("parity_report", AUDIT + " SELECT count(*) FILTER (status <> 'FALLBACK_RPC_USED') AS compared, round(100 * count(*) FILTER (status = 'EXACT_PARITY')::DOUBLE / nullif(count(*) FILTER (status <> 'FALLBACK_RPC_USED'), 0), 2) AS parity_rate FROM audits", lambda s, d: j.parity_report(audits(s, d)))
O = "order_id, line_no, supp_id, part_id, base_fare"
OL = ["order_id", "line_no", "supp_id", "part_id", "base_fare"]
RANK = "CASE feed_type WHEN 'CARRIER_DIRECT' THEN 0 WHEN 'RPC_FALLBACK' THEN 1 WHEN 'OTA_AGGREGATOR' THEN 2 ELSE 3 END"
ONE = f"one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route, obs_date, carrier, feed_type ORDER BY {O}) AS k FROM fares) WHERE k = 1)"
PVR = f"pvr AS (SELECT route, obs_date, carrier, arg_min(feed_type, {RANK}) OVER p AS reference, feed_type, round(base_fare - arg_min(base_fare, {RANK}) OVER p, 4) AS difference FROM one WINDOW p AS (PARTITION BY route, obs_date, carrier))"
C3 = ["route", "obs_date", "carrier"]
add("one_per_source", with_views("", "fares").rstrip() + ", " + ONE + f" SELECT {SUM} FROM one", lambda s, d: total(j.one_per_source(fares(s, d), C3, "feed_type", OL)))
add("pairs_vs_reference", with_views("", "fares").rstrip() + ", " + ONE + ", " + PVR + " SELECT * FROM pvr WHERE feed_type <> reference", lambda s, d: j.pairs_vs_reference(fares(s, d), C3, "feed_type", "base_fare", F.expr(RANK), OL))
STATUS = "CASE WHEN abs(difference) <= 50 THEN 'PARITY' WHEN difference > 0 THEN 'MARKUP' ELSE 'DISCOUNT' END"
add("source_pair_audit", with_views("", "fares").rstrip() + ", " + ONE + ", " + PVR + f" SELECT *, {STATUS} AS status FROM pvr WHERE feed_type <> reference", lambda s, d: j.source_pair_audit(fares(s, d), C3, "feed_type", "base_fare", F.expr(RANK), OL))
add("markup_report", with_views("", "fares").rstrip() + ", " + ONE + ", " + PVR + f" SELECT reference, feed_type, count(*) AS pairs, count(*) FILTER ({STATUS} = 'PARITY') AS parity, count(*) FILTER ({STATUS} = 'MARKUP') AS markup, count(*) FILTER ({STATUS} = 'DISCOUNT') AS discount, round(avg(difference), 4) AS avg_markup FROM pvr WHERE feed_type <> reference GROUP BY 1, 2", lambda s, d: j.markup_report(j.source_pair_audit(fares(s, d), C3, "feed_type", "base_fare", F.expr(RANK), OL), "feed_type"))
add("near_event", with_views("", "series").rstrip() + ", " + CAL + " SELECT series, s.day, min(c.day) AS event_day FROM series s LEFT JOIN cal c ON abs(s.day - c.day) <= 1 GROUP BY 1, 2", lambda s, d: j.near_event(series(s, d), calendar(s, d), "day", 1).select("series", "day", "event_day"))
add("missing_work", "SELECT r_name, p_size FROM region, (SELECT DISTINCT p_size FROM part) WHERE (r_name, p_size) NOT IN (SELECT r_name, p_size FROM region JOIN part ON p_partkey % 5 = r_regionkey)", lambda s, d: j.missing_work(read(s, d, "region").select("r_name"), read(s, d, "part").select("p_size").distinct(), read(s, d, "region").join(read(s, d, "part"), F.expr("p_partkey % 5 = r_regionkey")), ["r_name", "p_size"]))
add("collection_progress", with_views("SELECT expected, completed, round(100 * completed::DOUBLE / expected, 2) AS progress_pct FROM (SELECT count(DISTINCT route) * 5 AS expected FROM fares), (SELECT count(*) AS completed FROM (SELECT DISTINCT route, horizon FROM fares WHERE feed_type = 'CARRIER_DIRECT' AND fare_family = 'FLEXI'))", "fares"), lambda s, d: j.collection_progress(fares(s, d).select("route").distinct(), s.createDataFrame([(h,) for h in (1, 7, 15, 30, 45)], "horizon int"), fares(s, d).where("feed_type = 'CARRIER_DIRECT' and fare_family = 'FLEXI'"), ["route", "horizon"]))
add("overlay", with_views("SELECT day, round(v.value, 6) AS v, round(c.value, 6) AS c FROM (SELECT * FROM series WHERE series = 'view') v LEFT JOIN (SELECT * FROM series WHERE series = 'click' AND day > DATE '2024-01-10') c USING (day)", "series"), lambda s, d: j.overlay(S(s, d, "view").select("day", F.round("value", 6).alias("v")), S(s, d, "click").where("day > '2024-01-10'").select("day", F.round("value", 6).alias("c")), "day", "v", "c"))
add("with_data", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", lambda s, d: j.with_data(read(s, d, "customer").withColumnRenamed("c_custkey", "k"), read(s, d, "orders").withColumnRenamed("o_custkey", "k"), "k").agg(F.count(F.lit(1)).alias("n")))
MN = "SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS value FROM orders WHERE o_orderstatus = '{0}' AND {1} GROUP BY 1"


def _months(s, d, status, cond):
    return read(s, d, "orders").where(f"o_orderstatus = '{status}' and {cond}").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("value"))


add("month_compare", f"SELECT month, round(a.value, 4) AS a, round(b.value, 4) AS b, round(100 * (a.value - b.value) / nullif(b.value, 0), 4) AS deviation_pct, CASE WHEN a.value IS NULL THEN 'A' WHEN b.value IS NULL THEN 'B' END AS missing FROM ({MN.format('O', 'year(o_orderdate) > 1995')}) a FULL OUTER JOIN ({MN.format('F', 'year(o_orderdate) < 2000')}) b USING (month)", lambda s, d: j.month_compare(_months(s, d, "O", "year(o_orderdate) > 1995"), _months(s, d, "F", "year(o_orderdate) < 2000")))
add("replace_by_key", with_views("SELECT series, day, round(value, 6) AS value FROM series WHERE day < DATE '2024-01-20' AND (series, day) NOT IN (SELECT series, day FROM series WHERE day > DATE '2024-01-10' AND series = 'view') UNION ALL SELECT series, day, 0 FROM series WHERE day > DATE '2024-01-10' AND series = 'view'", "series"), lambda s, d: j.replace_by_key(series(s, d).where("day < '2024-01-20'").select("series", "day", F.round("value", 6).alias("value")), series(s, d).where("day > '2024-01-10' and series = 'view'").select("series", "day", F.lit(0.0).alias("value")), ["series", "day"]))
_A, _B = ("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0", "SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000")


def _keys(s, d):
    return read(s, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).distinct(), read(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()


add("common_keys", f"{_A} INTERSECT {_B}", lambda s, d: j.common_keys(*_keys(s, d)))
add("all_keys", f"{_A} UNION {_B}", lambda s, d: j.all_keys(*_keys(s, d)))
add("missing_keys", f"{_A} EXCEPT {_B}", lambda s, d: j.missing_keys(*_keys(s, d)))
add("unexpected", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fee,mode' WHEN event_id % 3 = 1 THEN 'fee' ELSE '' END AS keys FROM events", lambda s, d: events(s, d).select("event_id", F.array_join(clean.unexpected(F.expr("CASE WHEN event_id % 3 = 0 THEN array('mode', 'total_fare', 'fee') WHEN event_id % 3 = 1 THEN array('fee', 'carrier') ELSE array('total_fare') END"), ["total_fare", "carrier"]), ",").alias("keys")))
add("combos", with_views("SELECT DISTINCT route, carrier, fare_family FROM fares", "fares"), lambda s, d: j.combos(fares(s, d), ["route", "carrier", "fare_family"]))
add("timeline", with_views("SELECT day, round(value, 6) AS value, CASE WHEN day < DATE '2024-01-20' THEN 'OBSERVED' ELSE 'FORECAST' END AS type FROM series WHERE series = 'view'", "series"), lambda s, d: j.timeline(S(s, d, "view").where("day < '2024-01-20'").select("day", F.round("value", 6).alias("value")), S(s, d, "view").where("day >= '2024-01-20'").select("day", F.round("value", 6).alias("value"))))
add("latest_per", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1", lambda s, d: j.latest_per(events(s, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type"))
add("top_n_per", "SELECT user_id, event_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3", lambda s, d: j.top_n_per(events(s, d), ["user_id"], [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "rank"))
add("sort_nulls_first", "SELECT event_id, nullif(event_type, 'error') AS kind FROM events ORDER BY kind NULLS FIRST, event_id", lambda s, d: j.sort_nulls_first(events(s, d).select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("kind")), ["kind", "event_id"]))
add("last_n", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100", lambda s, d: j.last_n(events(s, d), ["ts", "event_id"], 100).select("event_id", "value"))
add("page", "SELECT event_id, (SELECT count(*) FROM events) AS total FROM events ORDER BY event_id LIMIT 50 OFFSET 100", lambda s, d: j.page(events(s, d).select("event_id"), ["event_id"], 3, 50))
add("top_recent", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50", lambda s, d: j.top_recent(events(s, d), ["ts", "event_id"]).select("event_id"))
add("top_surges", with_views("SELECT route, round(100 * (max(base_fare) - min(base_fare)) / avg(base_fare), 2) AS spread_pct FROM fares GROUP BY route ORDER BY 2 DESC, 1 LIMIT 3", "fares"), lambda s, d: a.top_surges(a.corridor_volatility(fares(s, d), ["route"], "base_fare")))
add("rank_by", with_views("SELECT route, count(*) AS n FROM fares GROUP BY route ORDER BY n DESC, route", "fares"), lambda s, d: j.rank_by(fares(s, d).groupBy("route").agg(F.count(F.lit(1)).alias("n")), "n", "route"))
add("where_any", with_views(f"SELECT {SUM} FROM fares WHERE carrier = 'C1' AND horizon = 15 AND obs_date >= DATE '1996-01-01' AND obs_date <= DATE '1998-12-31'", "fares"), lambda s, d: total(j.where_any(fares(s, d), carrier="C1", horizon=15, route=None, obs_date_from="1996-01-01", obs_date_to="1998-12-31")))
add("where_in", with_views(f"SELECT {SUM} FROM fares WHERE carrier IN ('C1', 'C3')", "fares"), lambda s, d: total(j.where_in(fares(s, d), "carrier", "C1, C3")))
add("where_day", "SELECT count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'", lambda s, d: j.where_day(events(s, d), "ts", "2024-01-10").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")))
add("where_finite", "SELECT count(*) AS n FROM events WHERE value > 10", lambda s, d: j.where_finite(events(s, d).withColumn("x", F.when(F.col("value") > 10, F.col("value")).otherwise(F.lit(float("nan")))), "x").agg(F.count(F.lit(1)).alias("n")))
add("national", with_views("SELECT count(*) AS observations FROM fares", "fares"), lambda s, d: j.national(fares(s, d).rollup("route").agg(F.count(F.lit(1)).alias("observations"))).select("observations"))
add("where_band", with_views(f"SELECT {SUM} FROM fares WHERE total_fare BETWEEN 1500 AND 60000", "fares"), lambda s, d: total(j.where_band(fares(s, d), "total_fare")))
add("drop_synthetic", with_views(f"SELECT {SUM} FROM fares WHERE feed_type <> 'SYNTHETIC_BASELINE'", "fares"), lambda s, d: total(j.drop_synthetic(fares(s, d))))
SCD = "(SELECT route, weight, DATE '1995-01-01' AS effective_from, DATE '1997-12-31' AS effective_to FROM weights UNION ALL SELECT route, weight * 2, DATE '1998-01-01', NULL FROM weights)"


def scd(s, d):
    w = weights(s, d).select("route", "weight")
    day = lambda x: F.lit(x).cast("date")
    return w.withColumn("effective_from", day("1995-01-01")).withColumn("effective_to", day("1997-12-31")).union(w.select("route", F.col("weight") * 2, day("1998-01-01"), F.lit(None).cast("date")))


add("publish_weights", with_views(f"SELECT route, round(weight, 6) AS weight, effective_from, CASE WHEN effective_to IS NULL THEN DATE '2000-12-31' ELSE effective_to END AS effective_to FROM {SCD} UNION ALL SELECT route, round(weight, 6), DATE '2001-01-01', NULL FROM weights", "weights"), lambda s, d: ix.publish_weights(scd(s, d), weights(s, d).select("route", "weight"), "2001-01-01").withColumn("weight", F.round("weight", 6)))
add("core_guard", with_views(f"SELECT {SUM} FROM fares WHERE status <> 'SOLD_OUT' AND travel_date NOT IN (SELECT DISTINCT cast(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')", "fares"), lambda s, d: total(ix.core_guard(fares(s, d), read(s, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day")).distinct())))
add("core_anchor", "WITH " + CAL + ", have AS (SELECT DISTINCT cast(ts AS DATE) AS day FROM events), near AS (SELECT day, day - DATE '2024-01-08' AS off FROM have WHERE day NOT IN (SELECT day FROM cal) AND abs(day - DATE '2024-01-08') <= 21) SELECT h.day AS obs_date, arg_min(n.day, (abs(off), CASE WHEN off < 0 THEN 1 ELSE 0 END)) AS anchor FROM have h JOIN near n ON n.day <= h.day GROUP BY h.day", lambda s, d: ix.core_anchor(events(s, d).select(F.to_date("ts").alias("obs_date")), calendar(s, d), "2024-01-08"))
