"""Queries on market analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.operators import analytics as a
from pricewell.operators import index as ix

from .index_queries import BASE_DATE, CARRIER, REPORT, cell_sql
from .registry import query
from .views import fares, jobs, money_sql, series, weights, with_views


def add(name: str, sql: str | None, f):
    f.__name__ = name
    query(sql)(f)


AVAILABLE = "status = 'AVAILABLE'"
_SPREAD = "100 * (max(base_fare) - min(base_fare)) / avg(base_fare)"
VOL = f"""SELECT route, horizon, {money_sql("min(base_fare)")} AS min_price, {money_sql("max(base_fare)")} AS max_price, {money_sql("avg(base_fare)")} AS mean_price, {money_sql("median(base_fare)")} AS median_price,
 {money_sql("coalesce(stddev_samp(base_fare), 0)")} AS std_dev, {money_sql(_SPREAD)} AS spread_pct, CASE WHEN {_SPREAD} < 30 THEN 'CALM' WHEN {_SPREAD} <= 50 THEN 'MODERATE' WHEN {_SPREAD} <= 90 THEN 'HIGH_VOLATILITY' ELSE 'SURGE_ALERT' END AS volatility_status,
 count(*) AS sample_size FROM fares WHERE base_fare > 0 GROUP BY route, horizon"""
HHI = """SELECT route, round(h, 2) AS hhi, firms, quotes, CASE WHEN h < 1500 THEN 'COMPETITIVE' WHEN h <= 2500 THEN 'MODERATE' ELSE 'CONCENTRATED' END AS band FROM
 (SELECT route, 10000 * sum(k * k::DOUBLE) / (sum(k) * sum(k::DOUBLE)) AS h, count(*) AS firms, sum(k)::BIGINT AS quotes FROM (SELECT route, carrier, count(*) AS k FROM fares GROUP BY ALL) GROUP BY route)"""
AVAIL = """SELECT route, horizon, round(j, 2) AS jevons, round(ratio, 4) AS sold_out_ratio, round(0.35 * least(ratio, 1), 4) AS premium, round(j * (1 + 0.35 * least(ratio, 1)), 2) AS adjusted FROM
 (SELECT route, horizon, exp(avg(ln(base_fare)) FILTER (status = 'AVAILABLE' AND base_fare > 0)) AS j, count(*) FILTER (status = 'SOLD_OUT')::DOUBLE / count(*) AS ratio FROM fares GROUP BY route, horizon)"""
BUCKET = "CASE WHEN hour(ts) < 6 THEN '00-06' WHEN hour(ts) < 12 THEN '06-12' WHEN hour(ts) < 18 THEN '12-18' ELSE '18-24' END"
INTRA = f"SELECT event_type, {BUCKET} AS bucket, round(avg(value), 2) AS mean, count(value) AS n FROM events GROUP BY 1, 2"


def corr_sql(x: str, y: str, where: str = "true") -> str:
    return f"CASE WHEN count(*) FILTER ({where}) > 1 AND stddev_pop({x}) FILTER ({where}) > 0 AND stddev_pop({y}) FILTER ({where}) > 0 THEN covar_pop({x}, {y}) FILTER ({where}) / (stddev_pop({x}) FILTER ({where}) * stddev_pop({y}) FILTER ({where})) END"


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


FLIGHT = ["flight", "travel_date"]


def direct():
    return F.col("feed_type") == "CARRIER_DIRECT"


def month():
    return F.date_format("day", "yyyy-MM").alias("month")



add("corridor_volatility", with_views(VOL, "fares"), lambda s, d: a.corridor_volatility(fares(s, d), ["route", "horizon"], "base_fare"))
add("network_volatility", with_views(f"SELECT count(*) AS routes, round(avg(spread_pct), 2) AS avg_spread, coalesce(string_agg(CASE WHEN volatility_status = 'SURGE_ALERT' THEN route END, ',' ORDER BY route), '') AS surging FROM ({VOL.replace(', horizon', '')})", "fares"), lambda s, d: a.network_volatility(a.corridor_volatility(fares(s, d), ["route"], "base_fare")))
add("hhi", with_views(HHI, "fares"), lambda s, d: a.hhi(fares(s, d), "route", "carrier"))
add("network_hhi", with_views(f"SELECT round(avg(hhi), 2) AS mean_hhi, round({corr_sql('hhi', 'mean_x')}, 4) AS r_mean, round({corr_sql('hhi', 'std_x')}, 4) AS r_std FROM ({HHI}) JOIN (SELECT route, avg(base_fare) AS mean_x, stddev_pop(base_fare) AS std_x FROM fares GROUP BY route) USING (route)", "fares"), lambda s, d: a.network_hhi(fares(s, d), "route", "carrier", "base_fare"))
add("availability_adjusted", with_views(AVAIL, "fares"), lambda s, d: a.availability_adjusted(fares(s, d), ["route", "horizon"], "base_fare"))
add("network_availability", with_views(f"SELECT round(exp(avg(ln(adjusted))), 2) AS network_fare, round(avg(premium), 4) AS mean_premium, round(avg(sold_out_ratio), 4) AS mean_ratio, count(*) FILTER (adjusted IS NULL) AS sold_out_markets FROM ({AVAIL})", "fares"), lambda s, d: a.network_availability(a.availability_adjusted(fares(s, d), ["route", "horizon"], "base_fare")))
add("intraday_stats", INTRA, lambda s, d: a.intraday_stats(events(s, d), ["event_type"], "ts", "value"))
add("intraday_cv", f"SELECT event_type, count(*) AS buckets, CASE WHEN count(mean) > 1 THEN round(100 * stddev_samp(mean) / nullif(avg(mean), 0), 2) END AS cv_pct FROM ({INTRA}) GROUP BY event_type", lambda s, d: a.intraday_cv(events(s, d), ["event_type"], "ts", "value"))
add("best_window", f"SELECT event_type, arg_min(bucket, (mean, bucket)) AS best_bucket, min(mean) AS best_mean FROM ({INTRA}) GROUP BY event_type", lambda s, d: a.best_window(a.intraday_stats(events(s, d), ["event_type"], "ts", "value"), ["event_type"]))
add("affordability", with_views("""SELECT route, round(lo, 2) AS latest_fare, round(av, 2) AS period_avg, round(trunk, 2) AS trunk_median, round(lo / 2500, 2) AS ratio_target, round(lo / trunk, 2) AS ratio_trunk,
 CASE WHEN lo / 2500 > 1.5 OR coalesce(lo / trunk > 1.5, false) THEN 'BREACH' WHEN lo / 2500 > 1 THEN 'ELEVATED' ELSE 'AFFORDABLE' END AS status FROM (SELECT route, min(base_fare) AS lo, avg(base_fare) AS av FROM fares WHERE route LIKE '%FURNITURE' GROUP BY route), (SELECT median(base_fare) AS trunk FROM fares WHERE route NOT LIKE '%FURNITURE')""", "fares"), lambda s, d: a.affordability(fares(s, d), F.col("route").like("%FURNITURE"), "route", "base_fare"))
add("latest_date", with_views("SELECT route, max(obs_date) AS latest FROM fares GROUP BY route", "fares"), lambda s, d: a.latest_date(fares(s, d), ["route"], "obs_date"))
add("canonical_price", with_views("""SELECT flight, travel_date, round(median(total_fare), 6) AS median, round(min(total_fare), 6) AS lowest, round(max(total_fare), 6) AS highest, round(max(total_fare) - min(total_fare), 6) AS spread,
 round(100 * (max(total_fare) - min(total_fare)) / nullif(min(total_fare), 0), 2) AS spread_pct, arg_min(source_id, (total_fare, source_id)) AS cheapest_source, round(min(total_fare) FILTER (feed_type = 'CARRIER_DIRECT'), 6) AS direct, count(DISTINCT source_id) AS sources FROM fares GROUP BY flight, travel_date""", "fares"), lambda s, d: a.canonical_price(fares(s, d), FLIGHT, "source_id", "total_fare", direct()))
MARK = f"""SELECT carrier, obs_date, feed_type, {money_sql("price")} AS price, {money_sql("price - min(dd) OVER p")} AS markup, price = min(price) OVER p AS is_cheapest FROM
 (SELECT carrier, obs_date, feed_type, min(total_fare) AS price, min(total_fare) FILTER (feed_type = 'CARRIER_DIRECT') AS dd FROM fares GROUP BY ALL) WINDOW p AS (PARTITION BY carrier, obs_date)"""
add("platform_markup", with_views(MARK, "fares"), lambda s, d: a.platform_markup(fares(s, d), ["carrier", "obs_date"], "feed_type", "total_fare", direct()))
add("dispersion_ranking", with_views(f"SELECT feed_type, count(*) AS quotes, round(100 * count(*) FILTER (is_cheapest)::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT carrier, obs_date FROM fares)), 2) AS win_rate, round(avg(markup), 2) AS avg_markup FROM ({MARK}) GROUP BY feed_type", "fares"), lambda s, d: a.dispersion_ranking(a.platform_markup(fares(s, d), ["carrier", "obs_date"], "feed_type", "total_fare", direct()), ["carrier", "obs_date"], "feed_type"))
add("cluster_flights", with_views("SELECT flight, travel_date, count(*) AS quotes, arg_min(source_id, (search_date, order_id, line_no, supp_id)) AS source_id FROM fares GROUP BY flight, travel_date", "fares"), lambda s, d: a.cluster_flights(fares(s, d), FLIGHT, ["source_id"], ["search_date", "order_id", "line_no", "supp_id"]))
add("weekly_geomean", with_views("SELECT series, isoyear(day) || '-W' || lpad(weekofyear(day)::VARCHAR, 2, '0') AS week, round(exp(avg(ln(value))), 4) AS value, min(day) AS first_day, max(day) AS last_day, count(*) AS n FROM series WHERE value > 0 GROUP BY 1, 2", "series"), lambda s, d: a.weekly_geomean(series(s, d), ["series"], "day", "value"))
add("monthly_mean", with_views("SELECT series, strftime(day, '%Y-%m') AS month, round(avg(value), 4) AS value, count(value) AS n FROM series GROUP BY 1, 2", "series"), lambda s, d: a.monthly_mean(series(s, d), ["series"], "day", "value"))
add("resample", with_views("SELECT series, cast(date_trunc('week', day) AS DATE) AS period, round(avg(value), 4) AS value, sum(n)::BIGINT AS observations, max(n) AS most FROM series GROUP BY 1, 2", "series"), lambda s, d: a.resample(series(s, d), ["series"], "day", "value", "n"))
add("weekly_mean", with_views("SELECT series, cast(date_trunc('week', day) AS DATE) AS week, round(avg(value), 4) AS value FROM series GROUP BY 1, 2", "series"), lambda s, d: a.weekly_mean(series(s, d), ["series"], "day", "value"))
CURVE = "SELECT route, horizon, round(base_fare, 2) AS fare FROM (SELECT route, horizon, base_fare, row_number() OVER (PARTITION BY route, horizon ORDER BY base_fare) AS i, count(*) OVER (PARTITION BY route, horizon) AS n FROM fares) WHERE i = n // 2 + 1"
add("lead_time_curve", with_views(CURVE, "fares"), lambda s, d: a.lead_time_curve(fares(s, d), ["route"], "base_fare"))
add("lead_time_multiplier", with_views(f"SELECT route, round(max(fare) FILTER (horizon = 1) / nullif(max(fare) FILTER (horizon = 45), 0), 4) AS multiplier FROM ({CURVE}) GROUP BY route", "fares"), lambda s, d: a.lead_time_multiplier(a.lead_time_curve(fares(s, d), ["route"], "base_fare"), ["route"]))
add("elasticity", with_views("SELECT route, horizon, round(min(base_fare), 2) AS min, round(median(base_fare), 2) AS median, round(avg(base_fare), 2) AS avg, round(max(base_fare), 2) AS max, count(base_fare) AS n FROM fares GROUP BY route, horizon", "fares"), lambda s, d: a.elasticity(fares(s, d), ["route"], "base_fare"))
add("heatmap", with_views("SELECT obs_date, horizon, round(avg(base_fare), 2) AS value, round(min(base_fare), 2) AS lowest, count(base_fare) AS n FROM fares GROUP BY obs_date, horizon", "fares"), lambda s, d: a.heatmap(fares(s, d), "obs_date", "base_fare"))
Q = "CASE feed_type WHEN 'CARRIER_DIRECT' THEN 100 WHEN 'RPC_FALLBACK' THEN 90 WHEN 'OTA_AGGREGATOR' THEN 70 ELSE 30 END"
add("quality_monitor", with_views(f"""SELECT count(*) AS total, count(*) FILTER (feed_type <> 'SYNTHETIC_BASELINE') AS real, count(*) FILTER (feed_type = 'SYNTHETIC_BASELINE') AS synthetic, count(*) FILTER (feed_type = 'CARRIER_DIRECT') AS direct, count(*) FILTER (feed_type = 'RPC_FALLBACK') AS fallback,
 count(*) FILTER ({Q} >= 90) AS high, count(*) FILTER ({Q} >= 70 AND {Q} < 90) AS medium, count(*) FILTER ({Q} < 70) AS low, round(100 * count(*) FILTER (status = 'AVAILABLE')::DOUBLE / count(*), 2) AS capture_pct FROM fares""", "fares"), lambda s, d: a.quality_monitor(fares(s, d), score=F.expr(Q)))
add("corridor_summary", with_views("""SELECT m.route, round(fare, 2) AS fare, carriers, flights FROM (SELECT route, list_sort(list(lo))[len(list(lo)) // 2 + 1] AS fare, string_agg(carrier, ',' ORDER BY carrier) AS carriers FROM (SELECT route, carrier, min(base_fare) AS lo FROM fares GROUP BY ALL) GROUP BY route) m
 JOIN (SELECT route, count(DISTINCT flight) AS flights FROM fares GROUP BY route) f ON m.route = f.route""", "fares"), lambda s, d: a.corridor_summary(fares(s, d)))
add("corridor_detail", with_views("SELECT route, carrier, round(min(base_fare) FILTER (fare_family = 'BASIC'), 2) AS basic, round(min(base_fare) FILTER (fare_family = 'FLEXI'), 2) AS flexi, round(avg(base_fare), 2) AS avg_base, round(avg(total_fare - base_fare), 2) AS avg_tax FROM fares GROUP BY route, carrier", "fares"), lambda s, d: a.corridor_detail(fares(s, d)))
add("route_list", with_views("SELECT w.route, round(weight, 6) AS weight, carriers, flight_count FROM weights w LEFT JOIN (SELECT route, string_agg(DISTINCT carrier, ',' ORDER BY carrier) AS carriers, count(DISTINCT flight) AS flight_count FROM fares GROUP BY route) f ON w.route = f.route", "weights"), lambda s, d: a.route_list(weights(s, d), fares(s, d)))


def _report(s, d):
    from pricewell.operators.cells import cell_report

    return cell_report(fares(s, d))


add("national_rep", cell_sql(f"SELECT obs_date, {money_sql('avg(price)', 6)} AS price, count(*) AS routes, sum(n_obs)::BIGINT AS observations FROM (SELECT route, obs_date, horizon, {money_sql('exp(avg(ln(price)) FILTER (survives))')} AS price, sum(quotes) AS n_obs FROM surv GROUP BY ALL) GROUP BY obs_date"), lambda s, d: a.national_rep(_report(s, d)))
PAIR = "pairs AS (SELECT v.day, v.value AS v, c.value AS c FROM (SELECT * FROM series WHERE series = 'view') v JOIN (SELECT * FROM series WHERE series = 'click') c USING (day))"


def pair(s, d):
    x = series(s, d)
    return x.where("series = 'view'").select("day", F.col("value").alias("v")).join(x.where("series = 'click'").select("day", F.col("value").alias("c")), "day")


def pair_sql(body: str) -> str:
    return with_views("", "series").rstrip() + ", " + PAIR + "\n" + body


add("error_metrics", pair_sql("SELECT strftime(day, '%Y-%m') AS month, round(avg(abs(c - v)), 4) AS mae, round(sqrt(avg((c - v) * (c - v))), 4) AS rmse, round(100 * avg(abs(c - v) / greatest(abs(v), 1)), 4) AS mape, round(avg(c - v), 4) AS bias, count(c - v) AS n FROM pairs GROUP BY 1"), lambda s, d: a.error_metrics(pair(s, d).withColumn("month", month()), "v", "c", ["month"]))
add("pearson", pair_sql(f"SELECT strftime(day, '%Y-%m') AS month, round({corr_sql('v', 'c')}, 4) AS r, count(*) AS n FROM pairs GROUP BY 1"), lambda s, d: a.pearson(pair(s, d).withColumn("month", month()), "v", "c", ["month"]))
DIRS = "SELECT *, strftime(day, '%Y-%m') AS month, sign(v - lag(v) OVER w) = sign(c - lag(c) OVER w) AS s FROM pairs WINDOW w AS (PARTITION BY strftime(day, '%Y-%m') ORDER BY day)"
add("directional_accuracy", pair_sql(f"SELECT month, round(100 * avg(s::INT), 2) AS accuracy, count(s) AS steps FROM ({DIRS}) GROUP BY month"), lambda s, d: a.directional_accuracy(pair(s, d).withColumn("month", month()), "v", "c", "day", ["month"]))
add("comovement", pair_sql(f"""SELECT month, count(*) AS n, CASE WHEN count(*) >= 3 THEN round({corr_sql('v', 'c')}, 3) END AS r, CASE WHEN count(*) >= 3 THEN round(avg(abs(e)), 2) END AS mae, CASE WHEN count(*) >= 3 THEN round(sqrt(avg(e * e)), 2) END AS rmse, CASE WHEN count(*) >= 3 THEN round(100 * avg(s::INT), 1) END AS accuracy
 FROM (SELECT *, 100 * v / first_value(v) OVER (PARTITION BY month ORDER BY day) - 100 * c / first_value(c) OVER (PARTITION BY month ORDER BY day) AS e FROM ({DIRS})) GROUP BY month"""), lambda s, d: a.comovement(pair(s, d).withColumn("month", month()), "v", "c", "day", ["month"]))
EDGES = (0, 3, 7, 14, 21, 30, 45, 60, 90)
HIST = "SELECT from_day, count(*) AS n, round(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share_pct FROM (SELECT CASE " + " ".join(f"WHEN lead >= {e} THEN {e}" for e in reversed(EDGES)) + " END AS from_day FROM (SELECT travel_date - search_date AS lead FROM fares)) WHERE from_day IS NOT NULL GROUP BY from_day"


def hist(s, d):
    return a.lead_histogram(fares(s, d).select(F.datediff("travel_date", "search_date").alias("lead")), "lead", EDGES)


add("lead_histogram", with_views(HIST, "fares"), hist)
add("lead_summary", with_views(f"""SELECT min(from_day) FILTER (run > floor(0.25 * total)) AS p25, min(from_day) FILTER (run > floor(0.5 * total)) AS p50, min(from_day) FILTER (run > floor(0.75 * total)) AS p75, round(sum(from_day * n)::DOUBLE / sum(n), 4) AS mean,
 round(100 * sum(CASE WHEN from_day <= 15 THEN n ELSE 0 END)::DOUBLE / sum(n), 2) AS within_15, round(100 * sum(CASE WHEN from_day <= 30 THEN n ELSE 0 END)::DOUBLE / sum(n), 2) AS within_30 FROM (SELECT *, sum(n) OVER (ORDER BY from_day) AS run, sum(n) OVER () AS total FROM ({HIST}))""", "fares"), lambda s, d: a.lead_summary(hist(s, d)))
add("source_health", with_views("""SELECT source, count(*) AS runs, round(avg((status = 'SUCCESS')::INT), 4) AS success_rate, round(avg(latency) FILTER (r <= 50), 4) AS avg_latency, CASE WHEN avg((status = 'SUCCESS')::INT) < 0.5 THEN 'DOWN' WHEN avg((status = 'SUCCESS')::INT) < 0.8 THEN 'DEGRADED' ELSE 'ACTIVE' END AS health
 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, job_id DESC) AS r FROM jobs) GROUP BY source""", "jobs"), lambda s, d: a.source_health(jobs(s, d)))
add("breadth", with_views("SELECT obs_date, count(DISTINCT carrier) AS carriers FROM fares GROUP BY obs_date", "fares"), lambda s, d: a.breadth(fares(s, d), "obs_date", "carrier"))
add("soldout_pressure", with_views("SELECT obs_date, round(count(*) FILTER (status = 'SOLD_OUT')::DOUBLE / count(*), 4) AS ratio, count(DISTINCT carrier) FILTER (status = 'SOLD_OUT') AS carriers FROM fares GROUP BY obs_date", "fares"), lambda s, d: a.soldout_pressure(fares(s, d), "obs_date"))
add("correlation_summary", pair_sql(f"SELECT count(r) AS pairs, round(avg(r), 4) AS mean_r, count(*) FILTER (r < 0.7) AS flagged FROM (SELECT date_trunc('week', day) AS week, round({corr_sql('v', 'c')}, 4) AS r FROM pairs GROUP BY 1)"), lambda s, d: a.correlation_summary(a.pearson(pair(s, d).withColumn("week", F.date_trunc("week", "day")), "v", "c", ["week"])))
add("pivot_recent", with_views("", "fares", "weights").rstrip() + CARRIER + " SELECT obs_date, " + ", ".join(f"round(max(index_value) FILTER (carrier = 'C{i}'), 4) AS C{i}" for i in range(7)) + " FROM carrier_index GROUP BY obs_date ORDER BY obs_date DESC LIMIT 10", lambda s, d: a.pivot_recent(ix.carrier_index(fares(s, d), weights(s, d), BASE_DATE), "obs_date", "carrier", "index_value", [f"C{i}" for i in range(7)]))
