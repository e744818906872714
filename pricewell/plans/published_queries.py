"""Queries on the published index table, over days: quotes are observed on the day of their search."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.operators import analytics as a
from pricewell.operators import composite as k
from pricewell.operators import published as pub

from .index_queries import SCORE, W
from .registry import query
from .views import QUOTED, fares, kept, money_sql, read, weights, with_views

BASE = "1995-07-12"
FIRST, LAST = "1995-07-22", "1997-07-21"

STACKED = """stacked AS (
  SELECT 'BASE_FARE' AS price_series, route, carrier, horizon, search_date AS obs_date, travel_date, status, feed_type, fare_family, cabin, base_fare AS fare FROM fares
  UNION ALL
  SELECT 'TOTAL_FARE', route, carrier, horizon, search_date, travel_date, status, feed_type, fare_family, cabin, total_fare FROM fares)"""

#: Peak days of travel: the days with orders in two holiday seasons.
SEASON = "(month({d}) = 12 AND day({d}) >= 20) OR (month({d}) = 10 AND day({d}) BETWEEN 18 AND 30)"
PEAK = f"peak AS (SELECT DISTINCT cast(o_orderdate AS DATE) AS day FROM orders WHERE {SEASON.format(d='o_orderdate')})"


def cells_sql(p: str, source: str) -> str:
    """CTEs from the stacked quotes of ``source`` to ``{p}cells``: least price of each carrier's best feed, outliers by MAD or fences, geometric mean."""
    cell = "price_series, route, obs_date, horizon"
    return f"""
{p}valid AS (
  SELECT *, {W} AS w FROM {source} WHERE status = 'AVAILABLE' AND fare > 0 AND cabin = 'ECONOMY' AND fare_family = 'BASIC'),
{p}best AS (
  SELECT * FROM (SELECT *, max(w) OVER (PARTITION BY {cell}, carrier) AS top FROM {p}valid) WHERE w = top),
{p}mins AS (
  SELECT {cell}, carrier, min(fare) AS price, any_value(feed_type) AS feed_type FROM {p}best GROUP BY ALL),
{p}spread AS (
  SELECT *, count(*) OVER q AS n, median(price) OVER q AS m, quantile_cont(price, 0.25) OVER q AS q1, quantile_cont(price, 0.75) OVER q AS q3
  FROM {p}mins WINDOW q AS (PARTITION BY {cell})),
{p}mad AS (
  SELECT *, median(abs(price - m)) OVER (PARTITION BY {cell}) AS mad FROM {p}spread),
{p}flags AS (
  SELECT *, n < 3 OR mad = 0 OR abs(0.6745 * (price - m) / mad) <= 3.5 AS by_mad,
    n < 4 OR q1 = q3 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS by_iqr
  FROM {p}mad),
{p}judged AS (
  SELECT *, CASE WHEN sum(CASE WHEN by_mad THEN 0 ELSE 1 END) OVER (PARTITION BY {cell}) > 0 OR n < 3 THEN by_mad ELSE by_iqr END AS survives
  FROM {p}flags),
{p}cells AS (
  SELECT {cell}, {money_sql("exp(avg(ln(price)) FILTER (survives))")} AS price, count(*) AS carriers,
    round(avg({SCORE}) FILTER (survives), 1) AS feed_quality, count(*) FILTER (NOT survives) AS removed
  FROM {p}judged GROUP BY ALL)"""


def points_sql(p: str) -> str:
    """CTE ``{p}points`` from ``{p}based``: the national index of a price, horizon and day."""
    return f"""
{p}used AS (
  SELECT *, weight * price / base AS wr FROM {p}based JOIN weights USING (route) WHERE price > 0 AND base > 0),
{p}summed AS (
  SELECT *, sum(wr) OVER q AS s, sum(weight) OVER q AS ws, count(*) OVER q AS n
  FROM {p}used WINDOW q AS (PARTITION BY price_series, horizon, obs_date)),
{p}pseudo AS (
  SELECT *, n * 100 * s / ws - (n - 1) * CASE WHEN n > 1 THEN 100 * (s - wr) / nullif(ws - weight, 0) END AS pseudo FROM {p}summed),
{p}national AS (
  SELECT price_series, horizon, obs_date, {money_sql("100 * max(s) / max(ws)", 4)} AS index_value,
    {money_sql("100 * max(ws) / (SELECT sum(weight) FROM weights)")} AS coverage, max(ws) / (SELECT sum(weight) FROM weights) < 0.8 AS low_coverage,
    max(n) AS n_routes, {money_sql("sqrt(var_samp(pseudo) / count(pseudo))", 4)} AS standard_error
  FROM {p}pseudo GROUP BY ALL),
{p}rest AS (
  SELECT price_series, horizon, obs_date, count(*) AS routes, avg(carriers) AS carriers, avg(feed_quality) AS feed, sum(removed)::BIGINT AS outliers
  FROM {p}based GROUP BY ALL),
{p}points AS (
  SELECT price_series, horizon, obs_date, index_value, coverage, low_coverage, n_routes, standard_error,
    {money_sql('''coverage * 0.3 + least(routes * 100.0::DOUBLE / 25, 100) * 0.2 + least(feed, 100) * 0.2
      + least(carriers * 10, 100) * 0.15 + (100 - least(outliers * 10.0::DOUBLE, 100)) * 0.15''', 1)} AS quality_score,
    CASE WHEN coverage >= 90 AND routes >= 8 THEN 'LIVE' WHEN coverage >= 80 AND routes >= 6 THEN 'BETA' ELSE 'EXPERIMENTAL' END AS index_status,
    {money_sql("routes * 100.0::DOUBLE / 25", 1)} AS completeness, {money_sql("carriers", 1)} AS carrier_diversity, {money_sql("feed", 1)} AS feed_quality, outliers
  FROM {p}national JOIN {p}rest USING (price_series, horizon, obs_date))"""


def published_sql(rows: str) -> str:
    """The rows with what is published beside a value: changes, mean, divisor, spot window."""
    exact = ", ".join(f"max(index_value) OVER (s RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL {n} DAY PRECEDING) AS p{n}" for n in (1, 7, 30))
    changes = ", ".join(f"CASE WHEN p{n} > 0 THEN {money_sql(f'100 * (index_value - p{n}) / p{n}')} END AS change_{n}d" for n in (1, 7, 30))
    return f"""SELECT price_series, series_type, route, horizon, obs_date, index_value, {changes},
  CASE WHEN points >= 5 THEN {money_sql("mean")} END AS moving_avg, 1.0::DOUBLE AS divisor,
  cast(obs_date - INTERVAL 28 DAY AS DATE) AS spot_from, cast(obs_date - INTERVAL 3 DAY AS DATE) AS spot_to,
  coverage, low_coverage, n_routes, standard_error, quality_score, index_status, completeness, carrier_diversity, feed_quality, outliers
FROM (SELECT *, {exact},
    count(*) FILTER (index_value > 0) OVER (s RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW) AS points,
    avg(index_value) FILTER (index_value > 0) OVER (s RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW) AS mean
  FROM ({rows}) WINDOW s AS (PARTITION BY price_series, series_type, horizon, route ORDER BY obs_date))"""


def headline_sql(base: str, source: str = "stacked") -> str:
    """CTEs up to ``headline``."""
    rows = """SELECT price_series, 'HEADLINE' AS series_type, NULL::VARCHAR AS route, horizon, obs_date, index_value, coverage, low_coverage, n_routes, standard_error,
    quality_score, index_status, completeness, carrier_diversity, feed_quality, outliers FROM points JOIN known USING (price_series, horizon)
  UNION ALL
  SELECT b.price_series, 'HEADLINE', b.route, b.horizon, b.obs_date, """ + money_sql("100 * price / base", 4) + """, 100.0, false, NULL, NULL,
    CASE WHEN p.coverage >= 90 THEN 90.0 ELSE 70.0 END, CASE WHEN p.coverage >= 90 THEN 'LIVE' ELSE 'BETA' END, 100.0, 1.0, 80.0, 0
  FROM based b JOIN points p USING (price_series, horizon, obs_date) JOIN known USING (price_series, horizon) WHERE price > 0 AND base > 0"""
    return f"""{cells_sql("", source)},
bases AS (
  SELECT price_series, route, horizon, price AS base FROM cells WHERE obs_date = DATE '{base}' AND price > 0),
known AS (
  SELECT DISTINCT price_series, horizon FROM bases),
based AS (
  SELECT cells.*, coalesce(b.base, cells.price) AS base FROM cells LEFT JOIN bases b USING (price_series, route, horizon)),
{points_sql("")},
headline AS ({published_sql(rows)})"""


#: The rule of the core series: no peak travel, no sold-out flights; a route needs 5 published points in the 14 days before; the nearest base day within 21 days.
CORE = f"""{PEAK},
guarded AS (
  SELECT * FROM stacked WHERE horizon = 15 AND status NOT IN ('SOLD_OUT', 'CANCELLED') AND travel_date NOT IN (SELECT day FROM peak)),
{cells_sql("core_", "guarded")},
base_days AS (
  SELECT DISTINCT price_series, obs_date AS day FROM core_cells
  WHERE obs_date = DATE '{BASE}' OR (abs(obs_date - DATE '{BASE}') <= 21 AND obs_date + 15 NOT IN (SELECT day FROM peak))),
anchors AS (
  SELECT c.price_series, c.obs_date, arg_min(d.day, (abs(d.day - DATE '{BASE}'), d.day < DATE '{BASE}')) AS anchor
  FROM (SELECT DISTINCT price_series, obs_date FROM core_cells) c JOIN base_days d ON c.price_series = d.price_series AND (d.day <= c.obs_date OR d.day = DATE '{BASE}')
  GROUP BY ALL),
eligible AS (
  SELECT c.* FROM core_cells c WHERE (SELECT count(*) FROM headline h WHERE h.price_series = c.price_series AND h.route = c.route AND h.horizon = c.horizon
    AND h.obs_date >= c.obs_date - 14 AND h.obs_date < c.obs_date) >= 5),
core_all AS (
  SELECT e.*, b.price AS base_price, coalesce(CASE WHEN b.price > 0 THEN b.price END, e.price) AS base
  FROM eligible e JOIN anchors a USING (price_series, obs_date)
  LEFT JOIN core_cells b ON b.price_series = e.price_series AND b.route = e.route AND b.obs_date = a.anchor),
core_based AS (
  SELECT * FROM core_all WHERE (price_series, obs_date) IN (SELECT (price_series, obs_date) FROM core_all WHERE base_price > 0 AND base_price <> price)),
{points_sql("core_")}"""
CORE_ROWS = """SELECT price_series, 'CORE' AS series_type, NULL::VARCHAR AS route, horizon, obs_date, index_value, coverage, low_coverage, n_routes, standard_error,
  quality_score, index_status, completeness, carrier_diversity, feed_quality, outliers FROM core_points"""


def sql(body: str, core: bool = False, base: str = BASE, source: str = "stacked", more: str = "") -> str:
    parts = [STACKED, *([more] if more else []), headline_sql(base, source), *([CORE + f", core AS ({published_sql(CORE_ROWS)})"] if core else [])]
    return with_views("", "fares", "weights").rstrip() + ",\n" + ",\n".join(parts) + "\n" + body


def daily(spark, sf_dir):
    """Quotes by the day of their search."""
    return by_search(fares(spark, sf_dir))


def by_search(quotes):
    return quotes.withColumn("obs_date", F.col("search_date"))


def kept_daily(spark, sf_dir):
    """The same, kept for series that are made of several passes."""
    return by_search(kept(fares(spark, sf_dir).select(*QUOTED)))


def peak(spark, sf_dir):
    return read(spark, sf_dir, "orders").where(SEASON.format(d="o_orderdate")).select(F.to_date("o_orderdate").alias("day")).distinct()


def headline(spark, sf_dir, base=BASE, quotes=None):
    quotes = daily(spark, sf_dir) if quotes is None else quotes
    return pub.daily_index(quotes, weights(spark, sf_dir, quotes), base)


def core(spark, sf_dir):
    quotes = kept_daily(spark, sf_dir)
    w = weights(spark, sf_dir, quotes)
    return pub.core_index(quotes, w, peak(spark, sf_dir), BASE, pub.daily_index(quotes, w, BASE))


@query(sql("SELECT * FROM headline"))
def daily_index(spark, sf_dir):
    return headline(spark, sf_dir)


@query(sql("SELECT * FROM headline", base=FIRST, source="ranged", more=f"ranged AS (SELECT * FROM stacked WHERE obs_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}')"))
def index_range(spark, sf_dir):
    quotes = daily(spark, sf_dir)
    return pub.index_range(quotes, weights(spark, sf_dir, quotes), FIRST, LAST)


@query(sql("SELECT * FROM core", core=True))
def core_index(spark, sf_dir):
    return core(spark, sf_dir)


GAP = money_sql("100 * (a.index_value - b.index_value) / nullif(b.index_value, 0)", 4)


@query(sql("""SELECT price_series, horizon, obs_date, a.index_value AS a, b.index_value AS b, round(a.index_value - b.index_value, 4) AS gap,
  round(100 * (a.index_value - b.index_value) / nullif(b.index_value, 0), 4) AS gap_pct
FROM (SELECT * FROM headline WHERE route IS NULL AND horizon = 15) a FULL OUTER JOIN core b USING (price_series, horizon, obs_date)""", core=True))
def dual_series(spark, sf_dir):
    quotes = kept_daily(spark, sf_dir)
    w = weights(spark, sf_dir, quotes)
    head = kept(pub.daily_index(quotes, w, BASE))
    return k.dual_series(head.where("route is null and horizon = 15"), pub.core_index(quotes, w, peak(spark, sf_dir), BASE, head), pub.POINT)


SELECTORS = [("BASE_FARE", 15, "HEADLINE"), ("BASE_FARE", 14, "HEADLINE"), ("TOTAL_FARE", 1, "HEADLINE"), ("TOTAL_FARE", 45, "HEADLINE"), ("BASE_FARE", 60, "HEADLINE"), ("TOTAL_FARE", 15, "CORE"), ("BASE_FARE", 30, "CORE"), ("BASE_FARE", 15, "OTHER")]
_ASKED = ", ".join(f"('{p}', {h}, '{t}')" for p, h, t in SELECTORS)
_CONFIDENCE = "round(least(100, greatest(0, least(100, coalesce(quality_score, 0)) * 0.96 * 1.05)), 2)"
NOW = f"""SELECT asked_price, asked_horizon, series_type, fallback, x.* EXCLUDE (route, series_type, fallback), {_CONFIDENCE} AS confidence_score,
  CASE WHEN {_CONFIDENCE} >= 90 THEN 'HIGH' WHEN {_CONFIDENCE} >= 70 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_band
FROM (SELECT s.*, CASE WHEN asked_horizon = 14 THEN 15 ELSE asked_horizon END AS h FROM (VALUES {_ASKED}) s (asked_price, asked_horizon, asked_type)) s
JOIN (SELECT *, false AS fallback FROM both_series UNION ALL SELECT *, true FROM both_series) x ON x.series_type = asked_type
WHERE (NOT fallback AND price_series = asked_price AND horizon = h) OR (fallback AND NOT EXISTS (SELECT 1 FROM both_series b WHERE b.series_type = asked_type AND b.price_series = asked_price AND b.horizon = h))
QUALIFY row_number() OVER (PARTITION BY asked_price, asked_horizon, asked_type ORDER BY obs_date DESC, price_series, horizon) = 1"""


@query(sql("SELECT * FROM both_series", core=True).replace("SELECT * FROM both_series", ", both_series AS (SELECT * FROM headline WHERE route IS NULL UNION ALL SELECT * FROM core)\n" + NOW))
def index_now(spark, sf_dir):
    """The headline is kept as well: it is published and judges the continuity of the core series."""
    quotes = kept_daily(spark, sf_dir)
    w = weights(spark, sf_dir, quotes)
    table = pub.published_index(quotes, w, peak(spark, sf_dir), BASE, headline=kept(pub.daily_index(quotes, w, BASE)))
    return pub.index_now(table, spark.createDataFrame(SELECTORS, "price_series string, horizon int, series_type string"))


@query(sql("SELECT count(*) FILTER (standard_error IS NULL AND route IS NULL) AS national, count(*) FILTER (standard_error IS NULL AND route IS NOT NULL) AS routes FROM headline"))
def missing_variance(spark, sf_dir):
    return a.missing_variance(headline(spark, sf_dir))
