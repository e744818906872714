"""Queries on composite reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.operators import analytics as a
from pricewell.operators import composite as k
from pricewell.operators import index as ix

from .analytics_queries import CURVE, VOL, add, corr_sql, direct
from .index_queries import BASE_DATE, CARRIER, LASPEYRES, based, cell_sql
from .join_queries import CAL, SCD, calendar, scd
from .views import QUOTED, fares, kept, read, series, weights, with_views


def lasp(s, d):
    return ix.laspeyres(based(s, d), weights(s, d))


def carr(s, d):
    return ix.carrier_index(fares(s, d), weights(s, d), BASE_DATE)


def view_series(s, d, name):
    return series(s, d).where(F.col("series") == name)


EXP = "ex AS (SELECT series, day, concat_ws(',', CASE WHEN (SELECT min(c.day) FROM cal c WHERE abs(c.day - series.day) <= 1) IS NOT NULL THEN 'calendar:' || (SELECT min(c.day) FROM cal c WHERE abs(c.day - series.day) <= 1) END, CASE WHEN day(day) % 4 = 0 THEN 'fuel' END, CASE WHEN n > 70 THEN 'sold-out' END, CASE WHEN dayname(day) IN ('Friday', 'Sunday') THEN 'weekday:' || dayname(day)[:3] END) AS signals FROM series WHERE series = 'view')"


def explained(s, d):
    x = view_series(s, d, "view")
    fuel = x.select("day", F.when(F.dayofmonth("day") % 4 == 0, 2.0).otherwise(0.0).alias("fuel_move"))
    return k.explain(x.select("series", "day"), "day", calendar(s, d), fuel, x.select("day", F.when(F.col("n") > 70, 0.5).otherwise(0.0).alias("ratio")), days=1)


add("explain", with_views("", "series").rstrip() + ", " + CAL + ", " + EXP + " SELECT *, signals <> '' AS explained FROM ex", explained)
add("alert_feed", with_views("", "series").rstrip() + ", " + CAL + ", " + EXP + " SELECT day, count(*) AS alerts, count(*) FILTER (signals = '') AS unexplained FROM ex GROUP BY day", lambda s, d: k.alert_feed(explained(s, d), "day"))
LEADING = f"""WITH wk AS (SELECT cast(date_trunc('week', o_orderdate) AS DATE) AS week, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY 1),
mon AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS value FROM orders GROUP BY 1),
stepped AS (SELECT cast(date_trunc('week', d) AS DATE) AS week, arg_min(value, month) AS b FROM (SELECT month, value, unnest(generate_series((month || '-01')::DATE, last_day((month || '-01')::DATE), INTERVAL 1 DAY)) AS d FROM mon) GROUP BY 1),
both_ AS (SELECT week, a, b, a - lag(a) OVER (ORDER BY week) AS da, b - lag(b) OVER (ORDER BY week) AS db FROM wk JOIN stepped USING (week)),
shifted AS ({" UNION ALL ".join(f"SELECT {i} AS lag, a AS x, da AS dx, lead(b, {i}) OVER (ORDER BY week) AS y, lead(db, {i}) OVER (ORDER BY week) AS dy FROM both_" for i in range(5))}),
res AS (SELECT lag, round(coalesce({corr_sql('x', 'y')}, 0), 3) AS r, round(100 * avg((sign(dx) = sign(dy))::INT), 1) AS accuracy, count(*) AS n FROM shifted WHERE y IS NOT NULL GROUP BY lag)
SELECT 'all' AS series, lag, r, accuracy, n, row_number() OVER (ORDER BY abs(r) DESC, lag) = 1 AS best FROM res WHERE n >= 3"""
add("leading_indicator", LEADING, lambda s, d: k.leading_indicator(read(s, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("value")), read(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("value")), "day", "value"))
FO = "SELECT f.day, round(100 * f.value / first_value(f.value) OVER (ORDER BY f.day), 4) AS fuel_index, pi AS price_index FROM (SELECT * FROM series WHERE series = 'click') f LEFT JOIN (SELECT day, round(100 * value / first_value(value) OVER (ORDER BY day), 4) AS pi FROM series WHERE series = 'view' AND day > DATE '2024-01-10') p USING (day)"
add("fuel_overlay", with_views(FO, "series"), lambda s, d: k.fuel_overlay(view_series(s, d, "click").select("day", F.col("value").alias("fuel")), view_series(s, d, "view").where("day > '2024-01-10'").select("day", "value"), "day"))
LAST = "lastc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY carrier, horizon ORDER BY obs_date DESC) AS r FROM carrier_index) WHERE r = 1)"
add("carrier_scorecard", with_views("", "fares", "weights").rstrip() + CARRIER + ", " + LAST + " SELECT horizon, round(max(index_value) - min(index_value), 4) AS spread, arg_max(carrier, (index_value, carrier)) AS leader, arg_min(carrier, (index_value, carrier)) AS value_leader, count(*) AS carriers FROM lastc GROUP BY horizon", lambda s, d: k.carrier_scorecard(carr(s, d)))
add("trajectory", with_views("SELECT flight, travel_date, base_fare FROM fares WHERE route = 'ASIA>BUILDING'", "fares"), lambda s, d: k.trajectory(fares(s, d), "ASIA>BUILDING", ["base_fare", "flight"]).select("flight", "travel_date", "base_fare"))
add("common_flights", with_views("SELECT carrier, obs_date, count(DISTINCT source_id) AS sources, round(min(total_fare), 6) AS lowest FROM fares GROUP BY 1, 2 HAVING count(DISTINCT source_id) >= 2", "fares"), lambda s, d: k.common_flights(fares(s, d), ["carrier", "obs_date"], "source_id", "total_fare", direct()).select("carrier", "obs_date", "sources", "lowest"))
add("index_between", cell_sql(f"SELECT * FROM ({LASPEYRES}) WHERE horizon = 15 AND obs_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", "weights"), lambda s, d: k.index_between(lasp(s, d), "obs_date", "1996-01-01", "1997-12-31", horizon=15))
add("weights_history", with_views(f"SELECT route, round(weight, 6) AS weight, effective_from FROM {SCD}", "weights"), lambda s, d: k.weights_history(scd(s, d)).select("route", F.round("weight", 6).alias("weight"), "effective_from"))
add("backtest", cell_sql("", "weights").rstrip() + f", ap AS (SELECT strftime(obs_date, '%Y-%m') AS month, avg(index_value) AS a FROM ({LASPEYRES}) GROUP BY 1), ob AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS b FROM orders GROUP BY 1) SELECT count(*) AS months, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 3) AS r, round(avg(abs(100 * (a - b) / b)), 3) AS mean_deviation_pct FROM ap JOIN ob USING (month)", lambda s, d: k.backtest(lasp(s, d).groupBy(F.date_format("obs_date", "yyyy-MM").alias("month")).agg(F.avg("index_value").alias("value")), read(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.avg("o_totalprice").alias("value"))).withColumns({"r": F.round("r", 3), "mean_deviation_pct": F.round("mean_deviation_pct", 3)}))
def briefing(s, d):
    quotes = kept(fares(s, d).select(*QUOTED))
    w = weights(s, d, quotes)
    index = ix.laspeyres(based(s, d, quotes), w).where("horizon = 15")
    return k.briefing(index, ix.carrier_index(quotes, w, BASE_DATE).where("horizon = 15"), a.corridor_volatility(quotes, ["route"], "base_fare"), a.lead_time_curve(quotes, ["route"], "base_fare"))


BRIEF = f""", head AS (SELECT obs_date AS as_of, index_value AS headline FROM ({LASPEYRES}) WHERE horizon = 15 ORDER BY obs_date DESC LIMIT 1),
lastc AS (SELECT carrier, index_value, row_number() OVER (PARTITION BY carrier ORDER BY obs_date DESC) AS r FROM carrier_index WHERE horizon = 15),
vol AS ({VOL.replace(', horizon', '')}), curve AS ({CURVE})
SELECT as_of, headline, (SELECT arg_max(carrier, (index_value, carrier)) FROM lastc WHERE r = 1) AS dearest_carrier, (SELECT round(avg(spread_pct), 2) FROM vol) AS avg_spread,
 (SELECT round(100 * (avg(fare) FILTER (horizon = 1) - avg(fare) FILTER (horizon = 45)) / nullif(avg(fare) FILTER (horizon = 1), 0), 2) FROM curve) AS early_saving_pct FROM head"""
add("briefing", cell_sql("", "weights").rstrip() + CARRIER + BRIEF, briefing)
