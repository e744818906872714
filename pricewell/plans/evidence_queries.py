"""Queries that bring evidence of other tables to the published index: features, policy signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.functions.columns import money
from pricewell.operators import joins as j
from pricewell.operators import timeseries as t

from .published_queries import PEAK, daily, headline, peak, sql
from .registry import query
from .views import money_sql, read, weights

SERIES = ["price_series", "horizon"]
#: Fuel: the mean unit price of a week's shipments, on its Monday; no records in February.
FUEL = """fuel AS (
  SELECT cast(date_trunc('week', l_shipdate) AS DATE) AS day, round(avg(l_extendedprice / l_quantity), 4) AS fuel
  FROM lineitem WHERE month(l_shipdate) <> 2 GROUP BY 1)"""


def fuel(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("month(l_shipdate) <> 2").groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("day"))
    return rows.agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("fuel"))


def national(spark, sf_dir):
    return headline(spark, sf_dir).where("route is null").select(*SERIES, "obs_date", "index_value")


NATIONAL = "nation AS (SELECT price_series, horizon, obs_date, index_value FROM headline WHERE route IS NULL)"


@query(f"""WITH {FUEL},
asked AS (SELECT o_orderkey, o_orderpriority, cast(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, a.day, f.fuel, (a.day - f.day)::INTEGER AS fuel_age FROM asked a ASOF LEFT JOIN fuel f ON a.day >= f.day""")
def asof_join(spark, sf_dir):
    asked = read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return j.asof_join(asked, fuel(spark, sf_dir), [], "day", "fuel", "fuel")


LAGS, WINDOWS, AHEAD = (1, 2, 3, 7, 14, 21, 28), (7, 14, 28), (1, 7, 15, 30, 45)
_roll = [(name, f, n) for n in WINDOWS for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
_x = "index_value"
_columns = [
    *(f"lag({_x}, {n}) OVER s AS lag_{n}" for n in LAGS),
    *(f"{_x} / nullif(lag({_x}, {n}) OVER s, 0) - 1 AS lag_{n}_pct" for n in LAGS),
    *(f"CASE WHEN count({_x}) OVER s{n} = {n} THEN {f}({_x}) OVER s{n} END AS {name}_{n}" for name, f, n in _roll),
    *(f"{_x} / nullif(lag({_x}, {n}) OVER s, 0) - 1 AS mom_{n}" for n in WINDOWS),
    *(f"CASE WHEN count(step) OVER s{n} = {n} THEN stddev_samp(step) OVER s{n} END AS vol_{n}" for n in (7, 28)),
    *(f"lead({_x}, {n}) OVER s AS target_{n}" for n in AHEAD),
]
_names = [c.rsplit(" AS ", 1)[1] for c in _columns]
_frames = ", ".join([f"s AS (PARTITION BY price_series, horizon ORDER BY obs_date)", *(f"s{n} AS (PARTITION BY price_series, horizon ORDER BY obs_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in WINDOWS)])
FEATURES = f""", {NATIONAL}, {FUEL},
steps AS (SELECT *, {_x} / nullif(lag({_x}) OVER (PARTITION BY price_series, horizon ORDER BY obs_date), 0) - 1 AS step FROM nation),
windows AS (SELECT price_series, horizon, obs_date, index_value, {", ".join(_columns)} FROM steps WINDOW {_frames}),
named AS (SELECT * FROM windows WHERE coalesce({", ".join(f"target_{n}" for n in AHEAD)}) IS NOT NULL)
SELECT n.price_series, n.horizon, n.obs_date, n.index_value, {", ".join(f"{money_sql(c, 5)} AS {c}" for c in _names)},
  (isodow(obs_date) - 1)::INTEGER AS dow, week(obs_date)::INTEGER AS week, month(obs_date)::INTEGER AS month, quarter(obs_date)::INTEGER AS quarter, dayofyear(obs_date)::INTEGER AS doy,
  day(obs_date) = 1 AS month_start, obs_date = last_day(obs_date) AS month_end, isodow(obs_date) >= 6 AS weekend,
  (n.horizon = 15)::INTEGER AS is_headline, (n.price_series = 'BASE_FARE')::INTEGER AS is_base_fare,
  (SELECT round(avg(weight), 6) FROM weights) AS market_weight, (SELECT round(sum(weight * weight), 6) FROM weights) AS market_concentration,
  f.fuel, (n.obs_date - f.day)::INTEGER AS fuel_age
FROM named n ASOF LEFT JOIN fuel f ON n.obs_date >= f.day"""


@query(sql(FEATURES))
def forecast_features(spark, sf_dir):
    quotes = daily(spark, sf_dir)
    rows = t.forecast_features(national(spark, sf_dir), SERIES, "obs_date", "index_value", weights(spark, sf_dir, quotes), fuel(spark, sf_dir))
    return rows.withColumns({c: money(F.col(c), 5) for c in _names} | {c: F.round(c, 6) for c in ("market_weight", "market_concentration")})


POLICY = f""", {NATIONAL}, {FUEL}, {PEAK},
last60 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY price_series, horizon ORDER BY obs_date DESC) AS r, least(60, count(*) OVER (PARTITION BY price_series, horizon)) AS points FROM nation) WHERE r <= 60),
placed AS (
  SELECT *, points - r + 1 AS i FROM last60 WHERE points >= 5),
based_on AS (
  SELECT *, median(CASE WHEN i <= greatest(2, points // 2) THEN index_value END) OVER (PARTITION BY price_series, horizon) AS base FROM placed),
lows AS (
  SELECT *, coalesce(max(CASE WHEN index_value < base * 1.05 THEN i END) OVER (PARTITION BY price_series, horizon), 0) AS low FROM based_on),
starts AS (
  SELECT *, i > low AS tail, min(CASE WHEN i > low THEN obs_date END) OVER (PARTITION BY price_series, horizon) AS start FROM lows),
episodes AS (
  SELECT price_series, horizon, max(base) AS baseline, arg_max(index_value, i) AS latest, count(*) FILTER (tail)::INTEGER AS persistence, min(start) AS episode_start,
    bool_or(tail AND (obs_date IN (SELECT day FROM peak) OR (obs_date = start AND EXISTS (SELECT 1 FROM peak p WHERE abs(p.day - starts.obs_date) <= 2)))) AS calendar_aligned,
    min(obs_date) AS a, max(obs_date) AS b
  FROM starts GROUP BY ALL),
carriers AS (
  SELECT e.price_series, e.horizon, count(DISTINCT carrier)::BIGINT AS breadth FROM episodes e
  JOIN fares f ON f.search_date = e.b AND f.horizon = e.horizon AND f.status = 'AVAILABLE' AND f.base_fare > 0 GROUP BY ALL),
moves AS (
  SELECT price_series, horizon, CASE WHEN count(*) >= 2 THEN 100 * (arg_max(fuel, day) - arg_min(fuel, day)) / arg_min(fuel, day) ELSE 0 END AS move
  FROM episodes JOIN fuel ON day BETWEEN a AND b GROUP BY ALL),
judged_all AS (
  SELECT *, coalesce(breadth, 0) AS carrier_breadth, coalesce(move, 0.0) AS m, 100 * (latest - baseline) / nullif(baseline, 0) AS pct
  FROM episodes LEFT JOIN carriers USING (price_series, horizon) LEFT JOIN moves USING (price_series, horizon)),
scored AS (
  SELECT *, (persistence >= 21)::INTEGER + (carrier_breadth >= 3)::INTEGER + (m >= 2)::INTEGER AS s,
    (persistence <= 14)::INTEGER + calendar_aligned::INTEGER + (carrier_breadth = 1)::INTEGER AS t FROM judged_all),
moded AS (
  SELECT *, CASE WHEN baseline IS NULL OR baseline <= 0 THEN 'NO_DATA' WHEN pct < 5 THEN 'NO_ELEVATION' WHEN s >= 2 AND s >= t THEN 'STRUCTURAL' WHEN t >= 2 AND t > s THEN 'TRANSIENT'
    WHEN s = 1 AND t = 0 THEN 'STRUCTURAL' WHEN t = 1 AND s = 0 THEN 'TRANSIENT' ELSE 'MIXED' END AS mode FROM scored)
SELECT c.price_series, c.horizon, c.points, round(baseline, 2) AS baseline, round(latest, 2) AS latest, round(pct, 2) AS elevation_pct, persistence, episode_start, calendar_aligned,
  s AS structural_score, t AS transient_score, mode, carrier_breadth, {money_sql("m")} AS fuel_move_pct, m >= 2 AS fuel_aligned,
  printf('%s: %.2f%% over baseline for %d day(s)', mode, round(pct, 2), persistence) || printf(', %d carrier(s), fuel %.2f%%', carrier_breadth, {money_sql("m")})
    || CASE WHEN mode = 'TRANSIENT' THEN ', over by ' || cast(episode_start + 14 AS VARCHAR) ELSE '' END AS label,
  CASE WHEN c.points >= 5 THEN 'COMPLETED' ELSE 'INSUFFICIENT_DATA' END AS status
FROM (SELECT price_series, horizon, max(points) AS points FROM last60 GROUP BY ALL) c LEFT JOIN moded USING (price_series, horizon)"""


@query(sql(POLICY))
def policy_signal(spark, sf_dir):
    return t.policy_signal(national(spark, sf_dir), SERIES, "obs_date", "index_value", peak(spark, sf_dir), quotes=daily(spark, sf_dir), fuel=fuel(spark, sf_dir))
