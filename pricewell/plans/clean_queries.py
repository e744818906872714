"""Queries on cleaning. ``raw`` makes quotes with the usual faults from the fares view."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.functions import columns as fn
from pricewell.operators import clean as c

from .analytics_queries import add
from .views import fares, read, view, with_views

RAW = """
SELECT order_id, line_no, supp_id, part_id, ' ' || lower(substr(route, 1, 3)) AS origin, CASE WHEN part_id % 17 = 0 THEN upper(substr(route, 1, 3)) ELSE substr(route, length(route) - 3, 3) END AS destination,
  CASE WHEN part_id % 19 = 0 THEN ' ' ELSE lower(carrier) END AS carrier, flight AS flight_number, CASE WHEN part_id % 11 = 0 THEN ' sold_out ' WHEN part_id % 13 = 0 THEN 'odd' ELSE 'AVAILABLE' END AS availability_status,
  horizon + part_id % 5 AS advance_purchase_days, cabin AS cabin_class, fare_family, total_fare, CASE WHEN part_id % 3 = 0 THEN base_fare END AS base_fare, CASE WHEN part_id % 3 = 0 THEN total_fare - base_fare - part_id % 70 END AS tax_amount,
  cast(NULL AS double) AS fuel_surcharge, 0.0 AS development_fee, 0.0 AS convenience_fee, 0.0 AS other_fee, feed_type, source_id, CASE WHEN part_id % 23 = 0 THEN 'NETWORK_API' ELSE 'DOM_BROWSER' END AS extraction_method FROM fares
"""


def raw(s, d):
    return view(s, d, RAW, fares=fares(s, d)).withColumns({k: F.col(k).cast("double") for k in ("development_fee", "convenience_fee", "other_fee")})


def raw_sql(body: str, more: str = "") -> str:
    return with_views("", "fares").rstrip() + f", raw AS ({RAW}){more}\n{body}"


H = "CASE WHEN {0} IN (1, 7, 14, 15, 30, 45) THEN {0} WHEN {0} <= 2 THEN 1 WHEN {0} <= 10 THEN 7 WHEN {0} <= 20 THEN 14 WHEN {0} <= 37 THEN 30 ELSE 45 END"
NORM = f""", nz AS (SELECT *, upper(trim(origin)) AS o, upper(trim(destination)) AS dd, upper(trim(carrier)) AS cc, upper(trim(flight_number)) AS ff, CASE WHEN upper(trim(availability_status)) IN ('AVAILABLE', 'SOLD_OUT', 'CANCELLED', 'UNAVAILABLE') THEN upper(trim(availability_status)) ELSE 'AVAILABLE' END AS st,
 coalesce(base_fare, total_fare * 0.75) AS bf, coalesce(tax_amount, total_fare * 0.05) AS tx FROM raw),
nq AS (SELECT order_id, line_no, supp_id, part_id, o AS origin, dd AS destination, cc AS carrier, ff AS flight_number, st AS availability_status, {H.format('advance_purchase_days')} AS advance_purchase_days, CASE WHEN st = 'AVAILABLE' THEN round(bf, 2) END AS base_fare, CASE WHEN st = 'AVAILABLE' THEN round(total_fare, 2) END AS total_fare,
 CASE WHEN st = 'AVAILABLE' THEN round(tx, 2) ELSE 0 END AS tax_amount, CASE WHEN st <> 'AVAILABLE' THEN 0 WHEN abs(total_fare - bf - tx) > 5 AND abs(total_fare - bf - tx) <= 50 THEN round(total_fare - bf - tx, 2) ELSE 0 END AS other_fee,
 CASE WHEN o = '' OR dd = '' OR o = dd THEN 'INVALID_ROUTE' WHEN cc = '' THEN 'MISSING_CARRIER' WHEN ff = '' THEN 'MISSING_FLIGHT' WHEN st <> 'AVAILABLE' THEN NULL WHEN total_fare < 0 OR bf < 0 THEN 'NEGATIVE_PRICE' END AS reject_reason FROM nz)"""
AGG = "count(*) AS n, round(sum(base_fare) / 100, 1) AS base, round(sum(other_fare), 1) AS other"


def n():
    return F.count(F.lit(1)).alias("n")


R1 = lambda x: F.round(F.sum(x) / 100, 1).alias(x)
add("bucket_horizon", raw_sql(f"SELECT advance_purchase_days AS d, ({H.format('advance_purchase_days')})::INTEGER AS h, count(*) AS n FROM raw GROUP BY 1, 2"), lambda s, d: raw(s, d).groupBy(F.col("advance_purchase_days").alias("d"), fn.bucket_horizon(F.col("advance_purchase_days")).alias("h")).agg(n()))
add("normalize_quotes", raw_sql("SELECT reject_reason, availability_status, advance_purchase_days::INTEGER AS advance_purchase_days, count(*) AS n, round(sum(base_fare) / 100, 1) AS base_fare, round(sum(total_fare) / 100, 1) AS total_fare, round(sum(other_fee) / 100, 1) AS other_fee FROM nq GROUP BY 1, 2, 3", NORM), lambda s, d: c.normalize_quotes(raw(s, d)).groupBy("reject_reason", "availability_status", "advance_purchase_days").agg(n(), R1("base_fare"), R1("total_fare"), R1("other_fee")))
add("null_unavailable", raw_sql("SELECT upper(trim(availability_status)) AS st, count(total_fare) FILTER (upper(trim(availability_status)) <> 'SOLD_OUT') AS fares FROM raw GROUP BY 1"), lambda s, d: c.null_unavailable(raw(s, d).withColumn("availability_status", F.trim("availability_status"))).groupBy(F.upper("availability_status").alias("st")).agg(F.count("total_fare").alias("fares")))
add("rebalance_components", raw_sql("SELECT count(*) FILTER (g) AS moved, round(sum(CASE WHEN g THEN total_fare - base_fare - tax_amount ELSE 0 END) / 100, 1) AS other_fee FROM (SELECT *, abs(total_fare - base_fare - tax_amount) > 5 AND abs(total_fare - base_fare - tax_amount) <= 50 AS g FROM raw WHERE base_fare IS NOT NULL)"), lambda s, d: c.rebalance_components(raw(s, d).where("base_fare is not null")).agg(F.count_if(F.col("other_fee") != 0).alias("moved"), R1("other_fee")))
QUAL = """SELECT CASE WHEN o = '' OR o = dd THEN 'REJECT' WHEN cc = '' THEN 'REJECT' WHEN st <> 'AVAILABLE' THEN 'MISSING_FOR_INDEX' WHEN base_fare IS NULL THEN 'REJECT' WHEN total_fare <= 0 OR base_fare <= 0 THEN 'REJECT' WHEN g > 50 THEN 'REJECT' WHEN g > 5 THEN 'ACCEPT_WITH_WARNING' WHEN total_fare NOT BETWEEN 1200 AND 60000 THEN 'REVIEW' ELSE 'ACCEPT' END AS quality_status,
 CASE WHEN o = '' OR o = dd THEN 0.0 WHEN cc = '' THEN 0.0 WHEN st <> 'AVAILABLE' THEN 80.0 WHEN base_fare IS NULL THEN 0.0 WHEN total_fare <= 0 OR base_fare <= 0 THEN 0.0 WHEN g > 50 THEN 45.0 WHEN g > 5 THEN 75.0 WHEN total_fare NOT BETWEEN 1200 AND 60000 THEN 65.0 ELSE 98.0 END::DOUBLE AS quality_score, count(*) AS n FROM (SELECT *, abs(total_fare - base_fare - tax_amount) AS g FROM nz) GROUP BY 1, 2"""


def scored(s, d):
    x = raw(s, d).withColumns({"origin": F.upper(F.trim("origin")), "carrier": F.trim("carrier"), "availability_status": F.expr("CASE WHEN trim(availability_status) = 'sold_out' THEN 'SOLD_OUT' ELSE 'AVAILABLE' END"), "source_error": F.lit(False), "is_duplicate": F.lit(False)})
    return c.score_quality(x)


add("score_quality", raw_sql(QUAL, NORM), lambda s, d: scored(s, d).groupBy("quality_status", "quality_score").agg(n()))
add("decompose_fare", raw_sql("""SELECT feed_type, round(sum(CASE WHEN rl THEN round(base_fare, 2) ELSE round(net - round(net * 0.05, 2) - round(net * 0.15, 2), 2) END) / 100, 1) AS base_fare, round(sum(CASE WHEN rl THEN 0 ELSE conv END) / 100, 1) AS convenience_fee FROM (SELECT *, extraction_method = 'NETWORK_API' AND base_fare IS NOT NULL AS rl, CASE WHEN feed_type = 'RPC_FALLBACK' THEN 299.0 ELSE 0.0 END::DOUBLE AS conv,
 greatest(500, total_fare - 350 - CASE WHEN feed_type = 'RPC_FALLBACK' THEN 299.0 ELSE 0.0 END::DOUBLE) AS net FROM raw) GROUP BY feed_type"""), lambda s, d: c.decompose_fare(raw(s, d)).groupBy("feed_type").agg(R1("base_fare"), R1("convenience_fee")))
add("resolve_source", raw_sql("SELECT feed_type, CASE WHEN feed_type = 'CARRIER_DIRECT' THEN 1 WHEN feed_type = 'OTA_AGGREGATOR' THEN coalesce(nullif(source_id, 0), 1 + n_regionkey, 2) ELSE 2 END AS resolved, count(*) AS n FROM raw LEFT JOIN nation ON n_name = 'NATION_' || supp_id GROUP BY 1, 2"), lambda s, d: c.resolve_source(raw(s, d).withColumn("source_name", F.concat(F.lit("NATION_"), "supp_id")), read(s, d, "nation").select(F.col("n_name").alias("source_name"), (1 + F.col("n_regionkey")).cast("long").alias("source_id")), 1, 2).groupBy("feed_type", "resolved").agg(n()))
T = ["order_id", "line_no", "supp_id", "part_id", "total_fare"]
add("flag_carrier_min", with_views("SELECT route, carrier, count(*) AS n, round(min(base_fare), 4) AS x FROM (SELECT *, row_number() OVER (PARTITION BY route, obs_date, carrier ORDER BY base_fare, order_id, line_no, supp_id, part_id, total_fare) AS k FROM fares) WHERE k = 1 GROUP BY 1, 2", "fares"), lambda s, d: c.flag_carrier_min(fares(s, d), ["route", "obs_date"], "carrier", "base_fare", T).where("is_carrier_min_fare").groupBy("route", "carrier").agg(n(), F.round(F.min("base_fare"), 4).alias("x")))
add("flag_duplicates", with_views("SELECT dup AS is_duplicate, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY order_id, line_no) > 1 AS dup FROM fares) GROUP BY 1", "fares"), lambda s, d: c.flag_duplicates(fares(s, d), ["order_id", "line_no"]).groupBy("is_duplicate").agg(n()))


def records(s, d):
    """Records as string maps: orders with some fields missing or odd."""
    f = lambda k, e: (F.lit(k), F.expr(e))
    pairs = [f("flight_number", "CASE WHEN part_id % 29 = 0 THEN 'bad' ELSE '6E-' || cast(100 + part_id % 900 AS string) END"), f("origin_airport", "CASE WHEN part_id % 31 = 0 THEN '' ELSE 'DEL' END"), f("destination_airport", "'BOM'"), f("travel_date", "cast(travel_date AS string)"), f("total_fare", "CASE WHEN part_id % 37 = 0 THEN 'x' ELSE cast(total_fare AS string) END"), f("base_fare", "cast(base_fare AS string)")]
    return fares(s, d).select("part_id", F.map_from_arrays(F.array(*[k for k, _ in pairs]), F.array(*[v for _, v in pairs])).alias("fields"))


ISS = "(part_id % 29 = 0)::INT + (part_id % 31 = 0)::INT + (part_id % 37 = 0)::INT"
add("drift_report", with_views(f"SELECT count(*) AS records_checked, count(*) FILTER ({ISS} = 0) AS clean_count, count(*) FILTER ({ISS} > 0) AS drift_count, count(*) FILTER ({ISS} > 0) > greatest(2, floor(count(*) * 0.1)) AS is_drifting, count(*) > 0 AND count(*) FILTER ({ISS} > 0) = count(*) AS collapsed FROM fares", "fares"), lambda s, d: c.drift_report(c.validate_records(records(s, d))))
AGREE = "ag AS (SELECT *, round(avg((abs(base_fare - m) / m <= 0.1)::INT) OVER (PARTITION BY route, horizon), 4) AS agreement FROM (SELECT *, median(base_fare) OVER (PARTITION BY route, horizon) AS m FROM fares))"
add("agreement", with_views("", "fares").rstrip() + ", " + AGREE + " SELECT DISTINCT route, horizon, agreement FROM ag", lambda s, d: c.agreement(fares(s, d), ["route", "horizon"], "base_fare").select("route", "horizon", "agreement").distinct())
Q = "CASE feed_type WHEN 'CARRIER_DIRECT' THEN 100.0 WHEN 'RPC_FALLBACK' THEN 90.0 WHEN 'OTA_AGGREGATOR' THEN 70.0 ELSE 30.0 END"
CONF = f"round(greatest(0, least(100, {Q}::DOUBLE * 0.96 * (0.95 + 0.10 * agreement))), 2)"
add("score_quotes", with_views("", "fares").rstrip() + ", " + AGREE + f" SELECT feed_type, band, count(*) AS n, round(sum(confidence) / 100, 1) AS confidence FROM (SELECT *, CASE WHEN confidence >= 90 THEN 'HIGH' WHEN confidence >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT *, {CONF} AS confidence FROM ag)) GROUP BY 1, 2", lambda s, d: c.score_quotes(fares(s, d), ["route", "horizon"], "base_fare", F.expr(Q), F.lit("NETWORK")).groupBy("feed_type", "band").agg(n(), R1("confidence")))
add("confidence", with_views(f"SELECT feed_type, round({Q}::DOUBLE * 0.94 * (0.95 + 0.10 * 0.5), 2) AS confidence FROM fares GROUP BY ALL", "fares"), lambda s, d: fares(s, d).select("feed_type", fn.confidence(F.expr(Q), F.lit("rpc"), F.lit(0.5)).alias("confidence")).distinct())
add("feed_weight", with_views("SELECT feed_type, CASE feed_type WHEN 'CARRIER_DIRECT' THEN 1.0 WHEN 'RPC_FALLBACK' THEN 0.9 WHEN 'OTA_AGGREGATOR' THEN 0.7 ELSE 0.3 END::DOUBLE AS weight, CASE feed_type WHEN 'CARRIER_DIRECT' THEN 100 WHEN 'RPC_FALLBACK' THEN 90 WHEN 'OTA_AGGREGATOR' THEN 70 ELSE 30 END AS score, count(*) AS n FROM fares GROUP BY ALL", "fares"), lambda s, d: fares(s, d).groupBy("feed_type", fn.feed_weight(F.col("feed_type")).alias("weight"), fn.feed_score(F.col("feed_type")).alias("score")).agg(n()))
add("canonical_flight", "SELECT p_partkey, '6E-' || p_partkey AS flight FROM part WHERE p_partkey > 0", lambda s, d: read(s, d, "part").where("p_partkey > 0").select("p_partkey", fn.canonical_flight(F.expr("CASE p_partkey % 4 WHEN 0 THEN '6e-' || p_partkey WHEN 1 THEN 'IndiGo ' || p_partkey WHEN 2 THEN cast(p_partkey as string) ELSE '6E ' || p_partkey END")).alias("flight")))
add("carrier_code", "SELECT p_brand, p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'IX' WHEN 1 THEN 'AI' ELSE '6E' END AS code FROM part", lambda s, d: read(s, d, "part").select("p_brand", "p_partkey", fn.carrier_code(F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Air India Express ' WHEN 1 THEN 'air india ' ELSE '' END || p_brand")).alias("code")))


def sources(s, d):
    return read(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7 != 0).alias("enabled"), F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'PENDING' ELSE 'APPROVED' END").alias("permission_status"), F.expr("CASE WHEN s_suppkey % 11 = 0 THEN 'DOWN' ELSE 'ACTIVE' END").alias("health_status"), F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'CONDITIONAL' WHEN 1 THEN 'PARTNER_ONLY' END").alias("access_mode"), F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'LIMITED_USE' WHEN 1 THEN 'PARTNER_AGREEMENT' END").alias("license_status"))


BLOCK = "CASE WHEN s_suppkey % 7 = 0 THEN 'disabled' WHEN s_suppkey % 5 = 0 THEN 'permission' WHEN s_suppkey % 11 = 0 THEN 'health' WHEN s_suppkey % 3 = 0 AND s_suppkey % 4 <> 0 THEN 'license' WHEN s_suppkey % 3 = 1 AND s_suppkey % 4 <> 1 THEN 'partner agreement' ELSE '' END"
add("blocked_reason", f"SELECT s_suppkey, {BLOCK} AS blocked_reason FROM supplier", lambda s, d: c.blocked_reason(sources(s, d)).select("s_suppkey", "blocked_reason"))
add("can_collect", f"SELECT s_suppkey, {BLOCK} = '' AS can_collect FROM supplier", lambda s, d: c.can_collect(sources(s, d)).select("s_suppkey", "can_collect"))
add("check_transitions", "SELECT s_suppkey, s_suppkey % 11 <> 0 AS allowed FROM supplier", lambda s, d: c.check_transitions(sources(s, d).withColumn("target", F.lit("DEGRADED")), "health_status", "target").select("s_suppkey", "allowed"))
add("cleaned_fares", raw_sql("SELECT (base_fare IS NOT NULL AND tax_amount IS NOT NULL AND fuel_surcharge IS NOT NULL) AS has_full_breakdown, feed_type = 'SYNTHETIC_BASELINE' AS is_imputed, count(*) AS n, round(sum(coalesce(tax_amount, 0)) / 100, 1) AS taxes FROM raw GROUP BY 1, 2"), lambda s, d: c.cleaned_fares(raw(s, d).withColumn("stops", F.lit(0)).withColumn("quality_status", F.lit("ACCEPT"))).groupBy("has_full_breakdown", "is_imputed").agg(n(), R1("taxes")))
