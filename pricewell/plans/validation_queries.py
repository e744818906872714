"""Queries on official fares, live series, feeds and the digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.functions.columns import money
from pricewell.operators import analytics as a
from pricewell.operators import composite as k
from pricewell.operators import index as ix
from pricewell.operators import published as pub
from pricewell.operators import validation as v

from .analytics_queries import CURVE, VOL, corr_sql
from .evidence_queries import FUEL, fuel
from .index_queries import BASE_DATE, CARRIER, W
from .published_queries import BASE, by_search, daily, headline, sql
from .registry import query
from .views import QUOTED, fares, kept, money_sql, weights, with_views

#: Official fares are the mean total fares of a route and month.
COMPARED = f""", official AS (
  SELECT route, strftime(search_date, '%Y-%m') AS month, {money_sql("avg(total_fare)")} AS official FROM fares GROUP BY ALL),
means AS (
  SELECT route, strftime(obs_date, '%Y-%m') AS month, avg(index_value) AS mean_index FROM headline
  WHERE route IS NOT NULL AND price_series = 'BASE_FARE' AND horizon = 15 AND index_value > 0 GROUP BY ALL),
prices AS (
  SELECT route, obs_date, price FROM cells WHERE price_series = 'BASE_FARE' AND horizon = 15 AND price > 0),
fitted AS (
  SELECT o.route, o.month, o.official, {money_sql("m.mean_index / 100 * p.price")} AS index_fare, {money_sql("p.price")} AS base_fare
  FROM official o JOIN means m USING (route, month) JOIN prices p ON p.route = o.route AND p.obs_date = least((o.month || '-01')::DATE, DATE '{BASE}')
  WHERE o.official > 0),
compared AS (
  SELECT *, {money_sql("(index_fare - official) / official * 100")} AS deviation_pct FROM fitted)"""
SAME = "CASE WHEN lag(month) OVER ({w}) IS NULL THEN NULL ELSE (sign(official - lag(official) OVER ({w})) = sign(index_fare - lag(index_fare) OVER ({w})))::INTEGER END AS same"


def compared(spark, sf_dir):
    quotes = daily(spark, sf_dir)
    official = quotes.groupBy("route", F.date_format("search_date", "yyyy-MM").alias("month")).agg(money(F.avg("total_fare")).alias("official"))
    head = pub.daily_index(quotes, weights(spark, sf_dir, quotes), BASE, prices=("base_fare",))
    cells = pub.price_cells(pub.stacked_prices(quotes.where("horizon = 15"), ("base_fare",)))
    return v.fare_comparison(official, head.where("route is not null and horizon = 15"), cells, BASE)


@query(sql(COMPARED + " SELECT * FROM compared"))
def fare_comparison(spark, sf_dir):
    return compared(spark, sf_dir)


@query(sql(COMPARED + f""", steps AS (SELECT *, {SAME.format(w="PARTITION BY route ORDER BY month")} FROM compared)
SELECT route, {money_sql("avg(abs(index_fare - official))")} AS mae, {money_sql("sqrt(avg((index_fare - official) * (index_fare - official)))")} AS rmse,
  {money_sql("100 * avg(abs(index_fare - official) / greatest(official, 1))")} AS mape, {money_sql("avg(index_fare - official)")} AS bias,
  {money_sql("avg(deviation_pct)")} AS mean_deviation_pct, {money_sql("100 * avg(same)", 1)} AS directional_accuracy,
  {money_sql(corr_sql("official", "index_fare"), 3)} AS correlation, count(*) AS n_months
FROM steps GROUP BY ROLLUP (route) HAVING count(*) > 0"""))
def fare_benchmark(spark, sf_dir):
    return v.fare_benchmark(compared(spark, sf_dir))


@query(sql(COMPARED + f""", steps AS (SELECT *, month[:4] AS period, {SAME.format(w="PARTITION BY route, month[:4] ORDER BY month")} FROM compared),
each AS (
  SELECT route, period, avg(abs(index_fare - official)) AS mae, sqrt(avg((index_fare - official) * (index_fare - official))) AS rmse,
    100 * avg(abs(index_fare - official) / greatest(official, 1)) AS mape, avg(index_fare - official) AS bias, coalesce(100 * avg(same), 0) AS directional_accuracy,
    coalesce({corr_sql("official", "index_fare")}, 0) AS correlation
  FROM steps GROUP BY ALL)
SELECT route, {", ".join(f"{money_sql(f'avg({m})', 4)} AS mean_{m}" for m in ("mae", "rmse", "mape", "bias", "directional_accuracy", "correlation"))}, count(*) AS n_periods
FROM each GROUP BY ROLLUP (route) HAVING count(*) > 0"""))
def validation_summary(spark, sf_dir):
    """Years are the periods, so that direction and correlation are defined."""
    return v.validation_summary(compared(spark, sf_dir), F.substring("month", 1, 4))


def live_sql(keys: list[str], method: str, freq: str) -> str:
    """Live series by the rule: economy quotes, the carriers' least basic fares of their best feed, outliers out for the median."""
    cell = ", ".join([*keys, "obs_date"]) if keys else "route, obs_date"
    scope = ", ".join(keys)
    series = f"{scope}, " if keys else ""
    price = "min(price)" if method == "min" else money_sql("median(price) FILTER (survives)")
    carriers = "count(*)" if method == "min" else "count(*) FILTER (survives)"
    rep = money_sql("rep") if method == "min" else "rep"
    start = {"daily": "obs_date", "weekly": "cast(date_trunc('week', obs_date) AS DATE)", "monthly": "cast(date_trunc('month', obs_date) AS DATE)"}[freq]
    body = f"""quotes AS (SELECT * REPLACE (search_date AS obs_date) FROM fares),
valid AS (SELECT *, {W} AS w FROM quotes WHERE status = 'AVAILABLE' AND base_fare > 0 AND cabin = 'ECONOMY' AND fare_family = 'BASIC'),
best AS (SELECT * FROM (SELECT *, max(w) OVER (PARTITION BY {cell}, carrier) AS top FROM valid) WHERE w = top),
mins AS (SELECT {cell}, carrier, min(base_fare) AS price FROM best GROUP BY ALL),
spread AS (SELECT *, count(*) OVER q AS n, median(price) OVER q AS m, quantile_cont(price, 0.25) OVER q AS q1, quantile_cont(price, 0.75) OVER q AS q3 FROM mins WINDOW q AS (PARTITION BY {cell})),
mads AS (SELECT *, median(abs(price - m)) OVER (PARTITION BY {cell}) AS mad FROM spread),
flags AS (SELECT *, n < 3 OR mad = 0 OR abs(0.6745 * (price - m) / mad) <= 3.5 AS by_mad, n < 4 OR q1 = q3 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS by_iqr FROM mads),
judged AS (SELECT *, CASE WHEN sum(CASE WHEN by_mad THEN 0 ELSE 1 END) OVER (PARTITION BY {cell}) > 0 OR n < 3 THEN by_mad ELSE by_iqr END AS survives FROM flags),
reps AS (SELECT {cell}, {price} AS rep, {carriers} AS carriers FROM judged GROUP BY ALL),
seen AS (SELECT {cell}, count(*) AS observations FROM quotes WHERE status = 'AVAILABLE' AND cabin = 'ECONOMY' GROUP BY ALL),
each AS (SELECT {cell}, {rep} AS rep, carriers, observations, 1 AS routes FROM reps JOIN seen USING ({cell})),
days AS ({"SELECT * FROM each" if keys else "SELECT obs_date, avg(rep) AS rep, sum(carriers) AS carriers, sum(observations) AS observations, count(*) AS routes FROM each GROUP BY obs_date"}),
points AS (SELECT *, max(CASE WHEN obs_date = DATE '{BASE}' AND rep > 0 THEN rep END) OVER ({f"PARTITION BY {scope}" if keys else ""}) AS base FROM days),
valued AS (SELECT *, {money_sql("CASE WHEN base IS NULL THEN rep ELSE rep / base * 100 END")} AS value FROM points)
"""
    if freq == "daily":
        body += f"SELECT {series}obs_date AS index_date, value AS index_value, routes::BIGINT AS route_count, carriers::BIGINT AS carrier_count, observations::BIGINT AS observation_count FROM valued"
    else:
        body += f"SELECT {series}{start} AS index_date, {money_sql('avg(value)')} AS index_value, max(routes)::BIGINT AS route_count, max(carriers)::BIGINT AS carrier_count, sum(observations)::BIGINT AS observation_count FROM valued GROUP BY ALL"
    return with_views("", "fares").rstrip() + ",\n" + body


@query(live_sql([], "median", "daily"))
def live_series(spark, sf_dir):
    return v.live_series(daily(spark, sf_dir), "national", "median", "daily", BASE)


@query(live_sql(["route"], "min", "weekly"))
def live_series_weekly(spark, sf_dir):
    return v.live_series(daily(spark, sf_dir), "route", "min", "weekly", BASE)


@query(live_sql(["route", "horizon"], "median", "monthly"))
def live_series_window(spark, sf_dir):
    return v.live_series(daily(spark, sf_dir), "window", "median", "monthly", BASE)


def cohort_sql(where: str) -> str:
    cell = "route, obs_date, feed_type"
    return with_views("", "fares").rstrip() + f""",
quotes AS (SELECT * REPLACE (search_date AS obs_date) FROM fares WHERE feed_type IN ('CARRIER_DIRECT', 'OTA_AGGREGATOR') AND {where}),
valid AS (SELECT * FROM quotes WHERE status = 'AVAILABLE' AND base_fare > 0 AND cabin = 'ECONOMY' AND fare_family = 'BASIC'),
mins AS (SELECT {cell}, carrier, min(base_fare) AS price FROM valid GROUP BY ALL),
spread AS (SELECT *, count(*) OVER q AS n, median(price) OVER q AS m, quantile_cont(price, 0.25) OVER q AS q1, quantile_cont(price, 0.75) OVER q AS q3 FROM mins WINDOW q AS (PARTITION BY {cell})),
mads AS (SELECT *, median(abs(price - m)) OVER (PARTITION BY {cell}) AS mad FROM spread),
flags AS (SELECT *, n < 3 OR mad = 0 OR abs(0.6745 * (price - m) / mad) <= 3.5 AS by_mad, n < 4 OR q1 = q3 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS by_iqr FROM mads),
judged AS (SELECT *, CASE WHEN sum(CASE WHEN by_mad THEN 0 ELSE 1 END) OVER (PARTITION BY {cell}) > 0 OR n < 3 THEN by_mad ELSE by_iqr END AS survives FROM flags),
reps AS (SELECT {cell}, exp(avg(ln(price))) AS price FROM judged WHERE survives GROUP BY ALL),
both_feeds AS (SELECT route, obs_date, max(price) FILTER (feed_type = 'CARRIER_DIRECT') AS a, max(price) FILTER (feed_type = 'OTA_AGGREGATOR') AS b FROM reps GROUP BY ALL),
cohorts AS (SELECT route, round({corr_sql("a", "b")}, 4) AS r, count(*) AS n FROM both_feeds WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY route)
SELECT route, r, n, r < 0.7 AS {{flag}} FROM cohorts WHERE r IS NOT NULL"""


def cohorts(spark, sf_dir, days):
    return v.cohort_correlation(daily(spark, sf_dir), "CARRIER_DIRECT", "OTA_AGGREGATOR", ["route"], days=days)


@query(cohort_sql("search_date BETWEEN (SELECT max(search_date) FROM fares) - 365 AND (SELECT max(search_date) FROM fares)").format(flag="diverging"))
def cohort_correlation(spark, sf_dir):
    """The last 365 days, as a day of the small tables has few quotes."""
    return cohorts(spark, sf_dir, 365)


@query(cohort_sql("true").format(flag="flagged"))
def correlation_history(spark, sf_dir):
    return k.correlation_history(cohorts(spark, sf_dir, None).drop("diverging"), "route")


@query(with_views(f"""SELECT route, carrier, escalation FROM (SELECT route, carrier,
  {money_sql("min(base_fare) FILTER (horizon = 1) / coalesce(min(base_fare) FILTER (horizon = 45), min(base_fare) FILTER (horizon = 15))")} AS escalation
  FROM fares WHERE base_fare > 0 GROUP BY route, carrier) WHERE escalation IS NOT NULL""", "fares"))
def carrier_escalation(spark, sf_dir):
    """The tables have 15 in place of 14."""
    return a.carrier_escalation(fares(spark, sf_dir), ["route", "carrier"], "base_fare", far=(45, 15))


#: Of each body: a number, the length of its list, and a sum over the list.
DIGEST = f""", {FUEL}, lastc AS (SELECT *, row_number() OVER (PARTITION BY carrier ORDER BY obs_date DESC) AS r FROM carrier_index WHERE horizon = 15),
vol AS (SELECT * FROM ({VOL}) WHERE horizon = 15), curve AS ({CURVE}),
latest AS (SELECT * FROM headline WHERE route IS NULL AND price_series = 'BASE_FARE' AND horizon = 15 ORDER BY obs_date DESC LIMIT 1),
f2 AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS r FROM fuel)
SELECT 'headline' AS matrix, (SELECT index_value FROM latest) AS number, (SELECT count(*) FROM weights) AS items, (SELECT round(sum(round(100 * weight, 2)), 2) FROM weights) AS total
UNION ALL SELECT 'carriers', round(max(index_value) - min(index_value), 4), count(*), round(sum(index_value), 2) FROM lastc WHERE r = 1
UNION ALL SELECT 'corridors', round(avg(spread_pct), 2), count(*), round(sum(spread_pct), 2) FROM vol
UNION ALL SELECT 'lead_time', (SELECT round(max(fare) FILTER (horizon = 1) / max(fare) FILTER (horizon = 45), 2) FROM curve WHERE route = (SELECT min(route) FROM curve)), (SELECT count(DISTINCT route) FROM curve), (SELECT round(sum(fare), 2) FROM curve)
UNION ALL SELECT 'fuel', (SELECT round(100 * (x.fuel - y.fuel) / y.fuel, 2) FROM f2 x, f2 y WHERE x.r = 1 AND y.r = 2), NULL, (SELECT fuel FROM f2 WHERE r = 1)"""


@query(sql(DIGEST).replace("\n, fuel AS", CARRIER + ", fuel AS", 1))
def digest(spark, sf_dir):
    by_month = kept(fares(spark, sf_dir).select(*QUOTED))
    quotes = by_search(by_month)
    w = weights(spark, sf_dir, quotes)
    rows = k.digest(
        headline(spark, sf_dir, quotes=quotes), w, ix.carrier_index(by_month, w, BASE_DATE), a.corridor_volatility(by_month.where("horizon = 15"), ["route"], "base_fare"), a.lead_time_curve(by_month, ["route"], "base_fare"),
        a.carrier_escalation(by_month, ["route", "carrier"], "base_fare", far=(45, 15)), fuel(spark, sf_dir),
    )
    at = lambda path: F.get_json_object("body", path)
    listed = F.when(F.col("matrix") == "headline", at("$.basket[*].weight_pct")).when(F.col("matrix") == "carriers", at("$.carriers[*].index_value")).when(F.col("matrix") == "corridors", at("$.corridors[*].spread_pct"))
    fares_of = F.flatten(F.from_json(at("$.routes"), "array<struct<curve:array<struct<fare:double>>>>")["curve"])["fare"]
    numbers = F.when(F.col("matrix") == "lead_time", fares_of).otherwise(F.from_json(listed, "array<double>"))
    number = F.coalesce(at("$.index_value"), at("$.spread"), at("$.average_spread_pct"), at("$.revision_pct"), at("$.routes[0].multiplier")).cast("double")
    items = F.when(F.col("matrix") == "lead_time", F.size(F.from_json(at("$.routes"), "array<struct<route:string>>"))).when(F.col("matrix") != "fuel", F.size(numbers)).cast("long")
    total = F.when(F.col("matrix") == "fuel", at("$.fuel").cast("double")).otherwise(F.round(F.aggregate(numbers, F.lit(0.0), lambda x, y: x + y), 2))
    return rows.select("matrix", number.alias("number"), items.alias("items"), total.alias("total"))
