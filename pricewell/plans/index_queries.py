"""Queries on cells and indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.operators import cells as c
from pricewell.operators import index as ix

from .registry import query
from .views import fares, money_sql, series, weights, with_views

BASE_DATE = "1995-01-01"
W = "CASE feed_type WHEN 'CARRIER_DIRECT' THEN 1.0::DOUBLE WHEN 'RPC_FALLBACK' THEN 0.9 WHEN 'OTA_AGGREGATOR' THEN 0.7 ELSE 0.3 END"
SCORE = "CASE feed_type WHEN 'CARRIER_DIRECT' THEN 100 WHEN 'RPC_FALLBACK' THEN 90 WHEN 'OTA_AGGREGATOR' THEN 70 ELSE 30 END"
#: Quotes, carrier minima of the best feed, and the outlier flags, as CTEs behind ``fares``.
CELL_CTE = f"""valid AS (SELECT *, {W} AS w FROM fares WHERE status = 'AVAILABLE' AND base_fare > 0 AND cabin = 'ECONOMY' AND fare_family = 'BASIC'),
best AS (SELECT * FROM (SELECT *, max(w) OVER (PARTITION BY route, obs_date, horizon, carrier) AS bw FROM valid) WHERE w = bw),
mins AS (SELECT route, obs_date, horizon, carrier, min(base_fare) AS price, any_value(feed_type) AS feed_type, count(*) AS quotes FROM best GROUP BY ALL),
o1 AS (SELECT *, count(*) OVER p AS n, median(price) OVER p AS m, quantile_cont(price, 0.25) OVER p AS q1, quantile_cont(price, 0.75) OVER p AS q3 FROM mins WINDOW p AS (PARTITION BY route, obs_date, horizon)),
o2 AS (SELECT *, median(abs(price - m)) OVER (PARTITION BY route, obs_date, horizon) AS mad FROM o1),
o3 AS (SELECT *, n < 3 OR mad = 0 OR abs(0.6745 * (price - m) / mad) <= 3.5 AS by_mad, n < 4 OR q1 = q3 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS by_iqr FROM o2),
o4 AS (SELECT *, sum(CASE WHEN by_mad THEN 0 ELSE 1 END) OVER (PARTITION BY route, obs_date, horizon) AS g FROM o3),
surv AS (SELECT *, CASE WHEN g > 0 OR n < 3 THEN by_mad ELSE by_iqr END AS survives FROM o4),
cells AS (SELECT route, obs_date, horizon, exp(avg(ln(price))) AS price FROM surv WHERE survives GROUP BY ALL),
based AS (SELECT cells.*, coalesce(CASE WHEN b.price > 0 THEN b.price END, cells.price) AS base FROM cells
  LEFT JOIN (SELECT route, horizon, price FROM cells WHERE obs_date = DATE '{BASE_DATE}') b USING (route, horizon))"""


def cell_sql(body: str, *names: str) -> str:
    return with_views("", "fares", *names).rstrip() + ", " + CELL_CTE + "\n" + body


def based(spark, sf_dir, quotes=None):
    """Jevons cells with their base price."""
    p = c.representative_price(fares(spark, sf_dir) if quotes is None else quotes, estimator="JEVONS")
    return ix.with_base_date(p, BASE_DATE, ["route", "horizon"])


KEY = ["route", "obs_date", "horizon"]


@query(with_views("SELECT count(*) AS n, round(sum(base_fare), 2) AS total FROM fares WHERE status = 'AVAILABLE' AND base_fare > 0", "fares"))
def where_available(spark, sf_dir):
    return c.where_available(fares(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("base_fare"), 2).alias("total"))


@query(with_views("SELECT count(*) AS n, round(sum(base_fare), 2) AS total FROM fares WHERE cabin = 'ECONOMY' AND fare_family = 'BASIC'", "fares"))
def where_product(spark, sf_dir):
    return c.where_product(fares(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("base_fare"), 2).alias("total"))


@query(with_views(f"SELECT route, carrier, count(*) AS n, round(sum(base_fare), 2) AS total FROM (SELECT *, {W} AS w, max({W}) OVER (PARTITION BY route, obs_date, horizon, carrier) AS bw FROM fares) WHERE w = bw GROUP BY route, carrier", "fares"))
def waterfall(spark, sf_dir):
    return c.waterfall(fares(spark, sf_dir)).groupBy("route", "carrier").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("base_fare"), 2).alias("total"))


@query(with_views(f"SELECT route, obs_date, horizon, carrier, round(min(base_fare), 6) AS price, arg_min(feed_type, (base_fare, -{W})) AS feed_type, count(*) AS quotes FROM fares GROUP BY route, obs_date, horizon, carrier", "fares"))
def carrier_minima(spark, sf_dir):
    return c.carrier_minima(fares(spark, sf_dir)).withColumn("price", F.round("price", 6))


@query(cell_sql("SELECT route, obs_date, horizon, carrier, round(price, 6) AS price FROM o3 WHERE by_mad"))
def drop_mad(spark, sf_dir):
    m = c.best_carrier_minima(c.where_product(c.where_available(fares(spark, sf_dir))))
    return c.drop_mad(m).select(*KEY, "carrier", F.round("price", 6).alias("price"))


@query(cell_sql("SELECT route, obs_date, horizon, carrier, round(price, 6) AS price FROM o3 WHERE by_iqr"))
def drop_iqr(spark, sf_dir):
    m = c.best_carrier_minima(c.where_product(c.where_available(fares(spark, sf_dir))))
    return c.drop_iqr(m).select(*KEY, "carrier", F.round("price", 6).alias("price"))


def _estimator(name: str, expression: str):
    def run(spark, sf_dir):
        return c.representative_price(fares(spark, sf_dir), estimator=name).withColumn("price", F.round("price", 4))

    run.__name__ = f"est_{name.lower()}"
    query(cell_sql(f"SELECT route, obs_date, horizon, round({expression}, 4) AS price FROM surv WHERE survives GROUP BY route, obs_date, horizon"))(run)


for _n, _e in (("MEDIAN", "median(price)"), ("JEVONS", "exp(avg(ln(price)))"), ("MEAN", "avg(price)")):
    _estimator(_n, _e)


@query(cell_sql("""SELECT route, obs_date, horizon, round(CASE WHEN count(*) >= 5 THEN avg(price) FILTER (price BETWEEN lo AND hi) ELSE median(price) END, 4) AS price FROM
 (SELECT *, quantile_cont(price, 0.1) OVER p AS lo, quantile_cont(price, 0.9) OVER p AS hi FROM surv WHERE survives WINDOW p AS (PARTITION BY route, obs_date, horizon)) GROUP BY route, obs_date, horizon"""))
def est_trimmed(spark, sf_dir):
    return c.representative_price(fares(spark, sf_dir), estimator="TRIMMED_MEAN").withColumn("price", F.round("price", 4))


@query(cell_sql(f"""SELECT route, obs_date, horizon, round(min(price) FILTER (run >= total / 2 - 1e-12), 4) AS price FROM
 (SELECT *, sum({W}) OVER (PARTITION BY route, obs_date, horizon ORDER BY price RANGE UNBOUNDED PRECEDING) AS run, sum({W}) OVER (PARTITION BY route, obs_date, horizon) AS total FROM surv WHERE survives) GROUP BY route, obs_date, horizon"""))
def weighted_median(spark, sf_dir):
    return c.representative_price(fares(spark, sf_dir), estimator="ENSEMBLE").withColumn("price", F.round("price", 4))


@query(cell_sql("SELECT route, obs_date, horizon, round(median(price), 4) AS price FROM surv WHERE survives GROUP BY route, obs_date, horizon"))
def representative_price(spark, sf_dir):
    return c.representative_price(fares(spark, sf_dir)).withColumn("price", F.round("price", 4))


@query(cell_sql(f"""SELECT route, obs_date, horizon, {money_sql("exp(avg(ln(price)) FILTER (survives))")} AS price, count(*) AS carriers, count(*) FILTER (survives) AS carriers_after, sum(quotes)::BIGINT AS n_obs,
 {money_sql("min(price) FILTER (survives)")} AS min_price, {money_sql("max(price) FILTER (survives)")} AS max_price, {money_sql("stddev_pop(price) FILTER (survives)")} AS std_price,
 {money_sql("quantile_cont(price, 0.25) FILTER (survives)")} AS p25, {money_sql("quantile_cont(price, 0.75) FILTER (survives)")} AS p75, round(avg({SCORE}) FILTER (survives), 1) AS feed_quality,
 arg_max(feed_type, {SCORE}) FILTER (survives) AS dominant_feed, CASE WHEN count(*) FILTER (NOT survives) = 0 THEN 'none' WHEN max(g) > 0 THEN 'mad' ELSE 'iqr' END AS outlier_method,
 count(*) FILTER (NOT survives) AS removed FROM surv GROUP BY route, obs_date, horizon"""))
def cell_report(spark, sf_dir):
    return c.cell_report(fares(spark, sf_dir))


LASPEYRES = """SELECT horizon, obs_date, round(100 * sum(weight * price / base) / sum(weight), 4) AS index_value, round(100 * sum(weight) / (SELECT sum(weight) FROM weights), 2) AS coverage, count(*) AS n_routes,
 sum(weight) / (SELECT sum(weight) FROM weights) < 0.8 AS low_coverage FROM based JOIN weights USING (route) WHERE price > 0 AND base > 0 GROUP BY horizon, obs_date"""
JACK = """SELECT horizon, obs_date, round(100 * max(s) / max(w), 4) AS index_value, round(sqrt(var_samp(pseudo) / count(pseudo)), 4) AS standard_error, count(*) AS n_routes FROM
 (SELECT *, n * 100 * s / w - (n - 1) * CASE WHEN n > 1 THEN 100 * (s - weight * price / base) / nullif(w - weight, 0) END AS pseudo FROM
 (SELECT *, sum(weight * price / base) OVER p AS s, sum(weight) OVER p AS w, count(*) OVER p AS n FROM based JOIN weights USING (route) WHERE price > 0 AND base > 0 WINDOW p AS (PARTITION BY horizon, obs_date))) GROUP BY horizon, obs_date"""


@query(cell_sql(LASPEYRES, "weights"))
def laspeyres(spark, sf_dir):
    quotes = fares(spark, sf_dir)
    return ix.laspeyres(based(spark, sf_dir, quotes), weights(spark, sf_dir, quotes))


@query(cell_sql("SELECT route, obs_date, horizon, round(base, 4) AS base FROM based"))
def with_base(spark, sf_dir):
    p = c.representative_price(fares(spark, sf_dir), estimator="JEVONS")
    base = p.where(F.col("obs_date") == BASE_DATE).select("route", "horizon", "price")
    return ix.with_base(p, base, ["route", "horizon"]).select(*KEY, F.round("base", 4).alias("base"))


@query(cell_sql("""SELECT route, horizon, obs_date, round(price / base, 4) AS relative, round(100 * (price / base), 2) AS route_index,
 round(100 * (weight / sum(weight) OVER (PARTITION BY horizon, obs_date)) * (price / base), 2) AS contribution FROM based JOIN weights USING (route) WHERE price > 0 AND base > 0""", "weights"))
def route_relatives(spark, sf_dir):
    return ix.route_relatives(based(spark, sf_dir), weights(spark, sf_dir))


@query(cell_sql(JACK, "weights"))
def jackknife(spark, sf_dir):
    quotes = fares(spark, sf_dir)
    return ix.jackknife(based(spark, sf_dir, quotes), weights(spark, sf_dir, quotes))


@query(cell_sql(f"SELECT a.*, standard_error FROM ({LASPEYRES}) a JOIN ({JACK}) b USING (horizon, obs_date)", "weights"))
def with_variance(spark, sf_dir):
    return ix.with_variance(based(spark, sf_dir), weights(spark, sf_dir))


@query(cell_sql("SELECT count(*) AS n, round(sum(price / base), 4) AS relatives FROM based WHERE price > 0 AND base > 0"))
def valid_cells(spark, sf_dir):
    return ix.valid_cells(based(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("price") / F.col("base")), 4).alias("relatives"))


@query(cell_sql("SELECT route, obs_date, horizon, carrier, round(price, 6) AS price FROM surv WHERE survives"))
def variance_sample(spark, sf_dir):
    return ix.variance_sample(fares(spark, sf_dir)).select(*KEY, "carrier", F.round("price", 6).alias("price"))


#: Every cell's 2,000 replications by the draws of ``operators.index``, as one array per cell and replication.
BOOT = """, arrays AS (SELECT route, obs_date, horizon, list_sort(list(price)) AS v, cast('0x' || substr(md5('7|' || route || '/' || obs_date || '/' || horizon), 1, 8) AS BIGINT) % 2147483647 AS c,
  exp(avg(ln(price))) AS seen FROM surv WHERE survives GROUP BY route, obs_date, horizon),
logs AS (SELECT *, list_transform(v, lambda p: ln(p)) AS l FROM arrays),
reps AS (SELECT *, unnest(range(1, 2001)) AS rep FROM logs),
numbers AS (SELECT *, list_transform(range(1, len(l) + 1), lambda k: (c + rep * 1103515245 + k * 1640531527) % 2147483647) AS x FROM reps),
draws AS (SELECT route, obs_date, horizon, rep, seen,
  exp(list_avg(list_transform(x, lambda y: l[1 + ((y * y % 2147483647) * (y * y % 2147483647) % 2147483647 * y % 2147483647 * len(l)) // 2147483647]))) AS price FROM numbers),
b0 AS (SELECT route, horizon, price AS base FROM cells WHERE obs_date = DATE '1995-01-01')"""
BOOT_INDEX = """, each AS (SELECT horizon, obs_date, rep, 100 * sum(weight * price / base) / sum(weight) AS i, 100 * sum(weight * seen / base) / sum(weight) AS seen, count(*) AS routes
  FROM draws JOIN b0 USING (route, horizon) JOIN weights USING (route) WHERE base > 0 GROUP BY horizon, obs_date, rep),
summed AS (SELECT horizon, obs_date, max(routes) AS n_routes, count(*) AS replications, avg(i) AS m, median(i) AS mid, stddev_samp(i) AS sd, quantile_cont(i, 0.025) AS lo, quantile_cont(i, 0.975) AS hi, avg(seen) AS seen
  FROM each GROUP BY horizon, obs_date)
SELECT horizon, obs_date, n_routes, replications, round(m, 4) AS mean_index, round(mid, 4) AS median_index, round(sd, 4) AS standard_error, round(least(lo, seen), 4) AS ci_lower, round(greatest(hi, seen), 4) AS ci_upper,
  round(seen, 4) AS observed_index, round(m - seen, 4) + 0.0 AS bias, round(seen - 1.959963984540054 * sd, 4) AS normal_lower, round(seen + 1.959963984540054 * sd, 4) AS normal_upper FROM summed"""
BOOT_ROUTE = """, summed AS (SELECT route, obs_date, horizon, avg(price) AS m, stddev_samp(price) AS sd, quantile_cont(price, 0.025) AS lo, quantile_cont(price, 0.975) AS hi, avg(seen) AS seen FROM draws GROUP BY route, obs_date, horizon)
SELECT route, obs_date, horizon, round(100 * seen / base, 4) AS observed_index, round(100 * m / base, 4) AS mean_index, round(100 * sd / base, 4) AS standard_error, round(100 * least(lo, seen) / base, 4) AS ci_lower,
  round(100 * greatest(hi, seen) / base, 4) AS ci_upper, round(100 * (m - seen) / base, 4) + 0.0 AS bias FROM summed JOIN b0 USING (route, horizon) WHERE base > 0"""


def _boot(spark, sf_dir):
    """Survivors of all horizons, and base prices."""
    s = ix.variance_sample(fares(spark, sf_dir)).select(*KEY, "carrier", "price")
    return s, s.where(F.col("obs_date") == BASE_DATE).groupBy("route", "horizon").agg(c.est_jevons(F.col("price")).alias("base"))


@query(cell_sql("", "weights").rstrip() + BOOT + BOOT_INDEX)
def bootstrap_index(spark, sf_dir):
    s, base = _boot(spark, sf_dir)
    return ix.bootstrap_index(s, weights(spark, sf_dir), base, KEY, ix.SERIES)


@query(cell_sql("").rstrip() + BOOT + BOOT_ROUTE)
def bootstrap_route(spark, sf_dir):
    s, base = _boot(spark, sf_dir)
    return ix.bootstrap_route(s, base, KEY)


@query(with_views("SELECT least(carrier, 'C' || source_id) || '-' || greatest(carrier, 'C' || source_id) AS pair, sum(pax) AS volume FROM fares GROUP BY 1", "fares"))
def bidirectional(spark, sf_dir):
    return ix.bidirectional(fares(spark, sf_dir).withColumn("other", F.concat(F.lit("C"), "source_id")), "carrier", "other", "pax")


@query(with_views("SELECT route, volume, CASE WHEN min(volume) OVER () >= 0 AND sum(volume) OVER () > 0 THEN round(volume / sum(volume) OVER (), 6) END AS share FROM weights", "weights"))
def normalise_shares(spark, sf_dir):
    return ix.normalise_shares(weights(spark, sf_dir).select("route", "volume"), "volume")


@query(with_views("SELECT count(weight) AS n, round(sum(weight), 6) AS total, CASE WHEN count(weight) = 0 THEN 'EMPTY' WHEN round(sum(weight), 6) BETWEEN 0.999 AND 1.001 THEN 'OK' ELSE 'BAD_SUM' END AS status FROM weights", "weights"))
def check_weights(spark, sf_dir):
    return ix.check_weights(weights(spark, sf_dir))


@query(with_views("SELECT round(sum(weight * weight), 8) AS concentration FROM weights", "weights"))
def weight_concentration(spark, sf_dir):
    return ix.weight_concentration(weights(spark, sf_dir)).select(F.round("concentration", 8).alias("concentration"))


@query(with_views("SELECT route, obs_date, carrier, round(coalesce(min(base_fare) FILTER (fare_family = 'BASIC'), min(base_fare)), 4) AS base_fare FROM fares GROUP BY ALL", "fares"))
def prefer_min(spark, sf_dir):
    return ix.prefer_min(fares(spark, sf_dir), ["route", "obs_date", "carrier"], F.col("fare_family") == "BASIC", "base_fare").withColumn("base_fare", F.round("base_fare", 4))


CARRIER = """, ci AS (SELECT carrier, horizon, obs_date, route, coalesce(min(base_fare) FILTER (fare_family = 'BASIC' AND status = 'AVAILABLE' AND base_fare > 0),
 CASE WHEN NOT bool_or(fare_family = 'BASIC') THEN min(base_fare) FILTER (status = 'AVAILABLE' AND base_fare > 0) END) AS price FROM fares WHERE cabin = 'ECONOMY' GROUP BY ALL),
carrier_index AS (SELECT carrier, horizon, obs_date, round(100 * sum(coalesce(weight, 0.1) * ci.price / b.price) / sum(coalesce(weight, 0.1)), 4) AS index_value, count(*) AS n_routes FROM ci
 JOIN (SELECT carrier, horizon, route, price FROM ci WHERE obs_date = DATE '1995-01-01' AND price IS NOT NULL) b USING (carrier, horizon, route) LEFT JOIN weights USING (route) WHERE ci.price IS NOT NULL GROUP BY carrier, horizon, obs_date)"""


@query(with_views("", "fares", "weights").rstrip() + CARRIER + " SELECT * FROM carrier_index")
def carrier_index(spark, sf_dir):
    quotes = fares(spark, sf_dir)
    return ix.carrier_index(quotes, weights(spark, sf_dir, quotes), BASE_DATE)


REPORT = f"""report AS (SELECT route, obs_date, horizon, {money_sql("exp(avg(ln(price)) FILTER (survives))")} AS price, count(*) AS carriers, round(avg({SCORE}) FILTER (survives), 1) AS feed_quality, count(*) FILTER (NOT survives) AS removed FROM surv GROUP BY ALL),
rbased AS (SELECT r.*, coalesce(CASE WHEN b.price > 0 THEN b.price END, r.price) AS base FROM report r LEFT JOIN (SELECT route, horizon, price FROM report WHERE obs_date = DATE '1995-01-01') b USING (route, horizon)),
qual AS (SELECT horizon, obs_date, count(*) AS routes, avg(carriers) AS carriers, avg(feed_quality) AS feed, sum(removed)::BIGINT AS outliers FROM rbased GROUP BY ALL)"""
QUALITY = """SELECT horizon, obs_date, round(coverage * 0.3 + least(routes * 100.0::DOUBLE / {n}, 100) * 0.2 + least(feed, 100) * 0.2 + least(carriers * 10, 100) * 0.15 + (100 - least(outliers * 10.0::DOUBLE, 100)) * 0.15, 1) AS quality_score,
 CASE WHEN coverage >= 90 AND routes >= 8 THEN 'LIVE' WHEN coverage >= 80 AND routes >= 6 THEN 'BETA' ELSE 'EXPERIMENTAL' END AS index_status, round(carriers, 1) AS carrier_diversity, outliers FROM qual JOIN ({i}) i USING (horizon, obs_date)"""
_R_LASP, _R_JACK = LASPEYRES.replace("FROM based", "FROM rbased"), JACK.replace("FROM based", "FROM rbased")


def _report(spark, sf_dir):
    r = c.cell_report(fares(spark, sf_dir))
    return ix.with_base_date(r, BASE_DATE, ["route", "horizon"])


@query(cell_sql("", "weights").rstrip() + ", " + REPORT + QUALITY.format(n=25, i=_R_LASP))
def index_quality(spark, sf_dir):
    r = _report(spark, sf_dir)
    return ix.index_quality(r, ix.laspeyres(r, weights(spark, sf_dir)), all_routes=25)


@query(cell_sql("SELECT route, count(*) AS cells, sum(quotes)::BIGINT AS observations FROM (SELECT route, obs_date, horizon, sum(quotes) AS quotes FROM surv GROUP BY ALL) GROUP BY ROLLUP (route)"))
def coverage_rollup(spark, sf_dir):
    return ix.coverage_rollup(c.cell_report(fares(spark, sf_dir)))


DAY = "day - DATE '1970-01-01'"


@query(with_views(f"SELECT series, day, round(max(value) OVER (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING), 6) AS lag7 FROM series", "series"))
def exact_lag(spark, sf_dir):
    return ix.exact_lag(series(spark, sf_dir), ["series"], "day", "value", 7, "lag7").select("series", "day", F.round("lag7", 6).alias("lag7"))


@query(with_views("SELECT series, day" + "".join(f", round(100 * (value - l{k}) / nullif(l{k}, 0), 4) AS chg_{k}" for k in (1, 7, 30)) + " FROM (SELECT *" + "".join(f", max(value) OVER (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL {k} DAY PRECEDING AND INTERVAL {k} DAY PRECEDING) AS l{k}" for k in (1, 7, 30)) + " FROM series)", "series"))
def pct_changes(spark, sf_dir):
    return ix.pct_changes(series(spark, sf_dir), ["series"], "day", "value").select("series", "day", "chg_1", "chg_7", "chg_30")


@query(with_views("SELECT series, day, round(last_value(value) OVER (PARTITION BY series ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 3 DAY PRECEDING), 6) AS prior FROM series", "series"))
def asof_prior(spark, sf_dir):
    return ix.asof_prior(series(spark, sf_dir), ["series"], "day", "value", 3, "prior").select("series", "day", F.round("prior", 6).alias("prior"))


@query(with_views("SELECT series, day, round(100 * (value - p) / nullif(p, 0), 4) AS asof_chg FROM (SELECT *, last_value(value) OVER (PARTITION BY series ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 3 DAY PRECEDING) AS p FROM series)", "series"))
def asof_change(spark, sf_dir):
    return ix.asof_change(series(spark, sf_dir), ["series"], "day", "value", 3).select("series", "day", "asof_chg")


@query(with_views("SELECT series, day, CASE WHEN count(value) FILTER (value > 0) OVER w >= 5 THEN round(avg(value) FILTER (value > 0) OVER w, 4) END AS moving_avg FROM series WINDOW w AS (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL 27 DAY PRECEDING AND CURRENT ROW)", "series"))
def moving_avg(spark, sf_dir):
    return ix.moving_avg(series(spark, sf_dir), ["series"], "day", "value").select("series", "day", "moving_avg")


@query(with_views("SELECT series, day, coalesce(round(max(value) OVER (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 6), 1.0::DOUBLE) AS carried FROM series", "series"))
def carry_divisor(spark, sf_dir):
    return ix.carry_divisor(series(spark, sf_dir), ["series"], "day", "value").select("series", "day", F.round("carried", 6).alias("carried"))


@query(with_views("SELECT series, day, cast(day - INTERVAL 28 DAY AS DATE) AS spot_from, cast(day - INTERVAL 3 DAY AS DATE) AS spot_to FROM series", "series"))
def spot_window(spark, sf_dir):
    return ix.spot_window(series(spark, sf_dir), "day").select("series", "day", "spot_from", "spot_to")


@query(with_views("SELECT series, day, count(*) OVER w AS points, count(*) OVER w >= 5 AS continuous FROM series WINDOW w AS (PARTITION BY series ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)", "series"))
def continuity(spark, sf_dir):
    return ix.continuity(series(spark, sf_dir), ["series"], "day").select("series", "day", "points", "continuous")
