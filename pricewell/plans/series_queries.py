"""Queries on series: anomalies, features, forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.operators import analytics as a
from pricewell.operators import joins as j
from pricewell.operators import timeseries as t

from .analytics_queries import add, corr_sql, pair, pair_sql
from .index_queries import BASE_DATE, LASPEYRES, based, cell_sql
from .join_queries import CAL, calendar
from .views import read, series, weights, with_views

K = ["series"]
HORIZONS = (1, 7, 15, 30, 45)


def hourly(s, d):
    """Mean value by event type and hour: a longer series than the daily one."""
    return read(s, d, "events").groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))


P = "WINDOW p AS (PARTITION BY series)"
SCORED = """sc0 AS (SELECT *, count(value) OVER p AS n0, median(value) OVER p AS median, quantile_cont(value, 0.25) OVER p AS q1, quantile_cont(value, 0.75) OVER p AS q3 FROM series WINDOW p AS (PARTITION BY series)),
sc1 AS (SELECT *, median(abs(value - median)) OVER (PARTITION BY series) AS mad FROM sc0),
sc2 AS (SELECT *, CASE WHEN n0 < 3 OR mad = 0 THEN 0 ELSE 0.6745 * (value - median) / nullif(mad, 0) END AS z, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS inner_breach, value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1) AS outer_breach FROM sc1),
scored AS (SELECT *, CASE WHEN coalesce(abs(value - median) / nullif(median, 0), 0) < 0.02 THEN 'NONE' WHEN abs(z) >= 5 OR outer_breach THEN 'SEVERE' WHEN abs(z) >= 3.5 THEN 'MODERATE' WHEN abs(z) >= 2.5 OR inner_breach THEN 'LOW' ELSE 'NONE' END AS severity FROM sc2)"""


def scored_sql(body: str) -> str:
    return with_views("", "series").rstrip() + ", " + SCORED + "\n" + body


def scored(s, d):
    return t.robust_scores(series(s, d), K, "day", "value")


add("robust_scores", scored_sql("SELECT series, day, round(z, 4) AS z, inner_breach, outer_breach, severity FROM scored"), lambda s, d: scored(s, d).select("series", "day", F.round("z", 4).alias("z"), "inner_breach", "outer_breach", "severity"))
add("anomaly_report", scored_sql("SELECT series, count(*) AS n, round(max(median), 4) AS median, round(max(mad), 4) AS mad" + "".join(f", count(*) FILTER (severity = '{x}') AS {x.lower()}" for x in t.RANKS) + " FROM scored GROUP BY series"), lambda s, d: t.anomaly_report(scored(s, d), K))
HITS = "hits AS (SELECT series, day, CASE WHEN value > median * 1.02 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM scored WHERE abs(value - median) > 0.01 * median)"


def hits(s, d):
    return scored(s, d).where("abs(value - median) > 0.01 * median").select("series", "day", F.expr("CASE WHEN value > median * 1.02 THEN 'MODERATE' ELSE 'LOW' END").alias("severity"))


add("escalate", scored_sql("").rstrip() + ", " + HITS + """, isl AS (SELECT *, sum(new) OVER (PARTITION BY series ORDER BY day) AS island FROM (SELECT *, coalesce((day - lag(day) OVER (PARTITION BY series ORDER BY day) > 1)::INT, 1) AS new FROM hits)),
g AS (SELECT series, island, count(*) AS len, max(CASE severity WHEN 'MODERATE' THEN 2 ELSE 1 END) AS top, min(day) AS a, max(day) AS b FROM isl GROUP BY ALL)
SELECT series, sum(len)::BIGINT AS hits, arg_max(len, island) AS last_run, max(len) AS longest_run, CASE max(top) WHEN 2 THEN 'MODERATE' ELSE 'LOW' END AS max_severity, min(a) AS first_day, max(b) AS last_day, max(top) >= 2 AND arg_max(len, island) >= 2 AS escalated FROM g GROUP BY series""", lambda s, d: t.escalate(hits(s, d), K, "day"))
add("alert_summary", scored_sql("").rstrip() + ", " + HITS + " SELECT count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'MODERATE') AS moderate, count(*) FILTER (severity = 'SEVERE') AS severe, count(*) FILTER (day > DATE '2024-01-15') AS open, (DATE '2024-02-15' - max(day))::INTEGER AS days_since FROM hits", lambda s, d: a.alert_summary(hits(s, d).withColumn("status", F.expr("CASE WHEN day > '2024-01-15' THEN 'OPEN' ELSE 'RESOLVED' END")), "2024-02-15"))
add("detect_anomalies", scored_sql("").rstrip() + ", " + HITS + """, found AS (SELECT series, day, severity, 'OPEN' AS status FROM scored WHERE severity <> 'NONE'), log AS (SELECT series, day, severity, 'OPEN' AS status FROM hits WHERE (series, day) NOT IN (SELECT series, day FROM found) UNION ALL SELECT * FROM found)
SELECT series, day, severity, CASE WHEN DATE '2024-01-30' - day > 7 THEN 'RESOLVED' ELSE status END AS status FROM log""", lambda s, d: t.detect_anomalies(scored(s, d), hits(s, d).withColumn("status", F.lit("OPEN")), K, "day", "2024-01-30"))
add("rebase", with_views("SELECT series, day, round(100 * value / nullif(first_value(value) OVER (PARTITION BY series ORDER BY day), 0), 4) AS rebased FROM series", "series"), lambda s, d: t.rebase(series(s, d), K, "day", "value").select("series", "day", "rebased"))
WD = "WINDOW w AS (PARTITION BY series ORDER BY day)"
add("lags", with_views("SELECT series, day" + "".join(f", round(lag(value, {k}) OVER w, 6) AS lag_{k}" for k in (1, 2, 3, 7, 14, 21, 28)) + f" FROM series {WD}", "series"), lambda s, d: t.lags(series(s, d), K, "day", "value").select("series", "day", *[F.round(f"lag_{k}", 6).alias(f"lag_{k}") for k in (1, 2, 3, 7, 14, 21, 28)]))
_roll = [(n, f, k) for k in (7, 14, 28) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))]
add("rolling", with_views("SELECT series, day" + "".join(f", CASE WHEN count(value) OVER w{k} = {k} THEN round({f}(value) OVER w{k}, 4) END AS {n}_{k}" for n, f, k in _roll) + " FROM series WINDOW " + ", ".join(f"w{k} AS (PARTITION BY series ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (7, 14, 28)), "series"), lambda s, d: t.rolling(series(s, d), K, "day", "value").select("series", "day", *[F.round(f"{n}_{k}", 4).alias(f"{n}_{k}") for n, _, k in _roll]))
add("momentum", with_views("SELECT series, day" + "".join(f", round(value / nullif(lag(value, {k}) OVER w, 0) - 1, 6) AS mom_{k}" for k in (7, 14, 28)) + f" FROM series {WD}", "series"), lambda s, d: t.momentum(series(s, d), K, "day", "value").select("series", "day", *[F.round(f"mom_{k}", 6).alias(f"mom_{k}") for k in (7, 14, 28)]))
add("rolling_vol", with_views("SELECT series, day" + "".join(f", CASE WHEN count(c) OVER w{k} = {k} THEN round(stddev_samp(c) OVER w{k}, 6) END AS vol_{k}" for k in (7, 28)) + " FROM (SELECT *, value / nullif(lag(value) OVER (PARTITION BY series ORDER BY day), 0) - 1 AS c FROM series) WINDOW " + ", ".join(f"w{k} AS (PARTITION BY series ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (7, 28)), "series"), lambda s, d: t.rolling_vol(series(s, d), K, "day", "value").select("series", "day", *[F.round(f"vol_{k}", 6).alias(f"vol_{k}") for k in (7, 28)]))
add("targets", with_views(f"SELECT * FROM (SELECT series, day, round(lead(value, 1) OVER w, 6) AS target_1, round(lead(value, 7) OVER w, 6) AS target_7, round(lead(value, 15) OVER w, 6) AS target_15, round(lead(value, 30) OVER w, 6) AS target_30, round(lead(value, 45) OVER w, 6) AS target_45 FROM series {WD}) WHERE coalesce(target_1, target_7, target_15, target_30, target_45) IS NOT NULL", "series"), lambda s, d: t.targets(series(s, d), K, "day", "value").select("series", "day", *[F.round(f"target_{h}", 6).alias(f"target_{h}") for h in HORIZONS]))
add("calendar_features", "SELECT o_orderkey, (isodow(o_orderdate) - 1)::INTEGER AS dow, week(o_orderdate)::INTEGER AS week, month(o_orderdate)::INTEGER AS month, quarter(o_orderdate)::INTEGER AS quarter, dayofyear(o_orderdate)::INTEGER AS doy, day(o_orderdate) = 1 AS month_start, cast(o_orderdate AS DATE) = last_day(o_orderdate) AS month_end FROM orders", lambda s, d: t.calendar_features(read(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day").drop("day"))
ELEV = """e0 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS i, count(*) OVER (PARTITION BY series) AS nn FROM series),
e1 AS (SELECT *, median(CASE WHEN i <= greatest(2, nn // 2) THEN value END) OVER (PARTITION BY series) AS base FROM e0),
e2 AS (SELECT *, max(CASE WHEN value < base * 1.005 THEN i END) OVER (PARTITION BY series) AS low FROM e1),
e3 AS (SELECT *, i > coalesce(low, 0) AS tail, min(CASE WHEN i > coalesce(low, 0) THEN day END) OVER (PARTITION BY series) AS start FROM e2),
e4 AS (SELECT series, max(base) AS baseline, arg_max(value, i) AS latest, count(*) FILTER (tail)::INTEGER AS persistence, min(day) FILTER (tail) AS episode_start, bool_or(tail AND (day IN (SELECT day FROM cal) OR (day = start AND EXISTS (SELECT 1 FROM cal c WHERE abs(c.day - e3.day) <= 2)))) AS calendar_aligned FROM e3 GROUP BY series),
e5 AS (SELECT *, 100 * (latest - baseline) / nullif(baseline, 0) AS pct, (persistence >= 21)::INTEGER + 1 AS s, (persistence <= 14)::INTEGER + calendar_aligned::INTEGER AS t FROM e4)
SELECT series, round(baseline, 2) AS baseline, round(latest, 2) AS latest, round(pct, 2) AS elevation_pct, persistence, episode_start, calendar_aligned, s AS structural_score, t AS transient_score,
 CASE WHEN baseline IS NULL OR baseline <= 0 THEN 'NO_DATA' WHEN pct < 0.5 THEN 'NO_ELEVATION' WHEN s >= 2 AND s >= t THEN 'STRUCTURAL' WHEN t >= 2 AND t > s THEN 'TRANSIENT' WHEN s = 1 AND t = 0 THEN 'STRUCTURAL' WHEN t = 1 AND s = 0 THEN 'TRANSIENT' ELSE 'MIXED' END AS mode FROM e5"""
_elev = with_views("", "series").rstrip() + ", " + CAL + ", " + ELEV
add("classify_elevation", _elev, lambda s, d: t.classify_elevation(series(s, d), K, "day", "value", calendar(s, d), breadth=3, threshold=0.5))
add("window_move", with_views("SELECT series, round(100 * (arg_max(value, day) - arg_min(value, day)) / nullif(arg_min(value, day), 0), 4) AS move_pct, count(*) AS n FROM (SELECT *, max(day) OVER (PARTITION BY series) AS last FROM series) WHERE last - day <= 14 GROUP BY series", "series"), lambda s, d: t.window_move(series(s, d), K, "day", "value", 14))
LL = pair_sql("").rstrip() + """, ll0 AS (SELECT day, v, c, v - lag(v) OVER (ORDER BY day) AS dv, c - lag(c) OVER (ORDER BY day) AS dc FROM pairs), ll AS (""" + " UNION ALL ".join(f"SELECT {k} AS lag, v AS x, dv AS dx, lead(c, {k}) OVER (ORDER BY day) AS y, lead(dc, {k}) OVER (ORDER BY day) AS dy FROM ll0" for k in range(5)) + f"""),
res AS (SELECT lag, round(coalesce({corr_sql('x', 'y')}, 0), 3) AS r, round(100 * avg((sign(dx) = sign(dy))::INT), 1) AS accuracy, count(*) AS n FROM ll WHERE y IS NOT NULL GROUP BY lag) SELECT 'view>click' AS pair, lag, r, accuracy, n, row_number() OVER (ORDER BY abs(r) DESC, lag) = 1 AS best FROM res"""
add("lead_lag", LL, lambda s, d: t.lead_lag(pair(s, d).withColumn("pair", F.lit("view>click")), "v", "c", "day", ["pair"]))
MON = "(SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS value FROM orders GROUP BY 1)"
add("step_weekly", f"SELECT cast(date_trunc('week', d) AS DATE) AS week, arg_min(value, month) AS value FROM (SELECT month, value, unnest(generate_series((month || '-01')::DATE, last_day((month || '-01')::DATE), INTERVAL 1 DAY)) AS d FROM {MON}) GROUP BY 1", lambda s, d: t.step_weekly(read(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("value")), "month", "value"))
add("date_spine", "SELECT o_orderpriority, cast(unnest(generate_series(min(cast(o_orderdate AS DATE)), max(cast(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day FROM orders GROUP BY o_orderpriority", lambda s, d: t.date_spine(read(s, d, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day")), ["o_orderpriority"], "day"))
add("expand_shares", "SELECT p_size, unnest(range(round(share * 10)::INT)) IS NOT NULL AS x FROM (SELECT p_size, round(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM part GROUP BY p_size)", lambda s, d: t.expand_shares(read(s, d, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).crossJoin(read(s, d, "part").agg(F.count(F.lit(1)).alias("all"))).select("p_size", F.round(100 * F.col("n") / F.col("all"), 4).alias("share")), "p_size", "share", 1000).withColumn("x", F.lit(True)))
add("conformal", with_views("SELECT series, round(a, 4) AS half_width, n FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY a) AS k, count(*) OVER (PARTITION BY series) AS n FROM (SELECT series, abs(value - avg(value) OVER (PARTITION BY series)) AS a FROM series)) WHERE k = least(n, ceil((n + 1) * 0.9))", "series"), lambda s, d: t.conformal(series(s, d).withColumn("r", F.expr("value - avg(value) over (partition by series)")), K, "r"))
SNAP = "snap AS (SELECT series, cast(day + INTERVAL (h) DAY AS DATE) AS day, h, value AS p50, value * 0.9 AS p10, value * 1.1 AS p90, value + 0.33 * (value * 0.9 - value) AS p25, value + 0.33 * (value * 1.1 - value) AS p75 FROM (SELECT *, unnest([1, 7, 14, 21]) AS h FROM series)), matured AS (SELECT snap.*, s.value AS actual FROM snap JOIN series s ON s.series = snap.series AND s.day = snap.day)"


def matured(s, d):
    x = series(s, d)
    snap = x.select("series", F.explode(F.array(*[F.lit(h) for h in (1, 7, 14, 21)])).alias("h"), "day", F.col("value").alias("p50")).withColumn("day", F.expr("date_add(day, h)"))
    snap = snap.withColumns({"p10": F.col("p50") * 0.9, "p90": F.col("p50") * 1.1, "p25": F.col("p50") + 0.33 * (F.col("p50") * 0.9 - F.col("p50")), "p75": F.col("p50") + 0.33 * (F.col("p50") * 1.1 - F.col("p50"))})
    return j.mature(snap, x, K, "day", "day", "value")


ACC = "count(*) AS n, round(avg(abs(p50 - actual)), 4) AS mae, round(sqrt(avg((p50 - actual) * (p50 - actual))), 4) AS rmse, round(100 * avg(abs(p50 - actual) / greatest(abs(actual), 1)), 4) AS mape, round(avg(p50 - actual), 4) AS bias, round(100 * avg((actual BETWEEN p25 AND p75)::INT), 2) AS coverage_50, round(100 * avg((actual BETWEEN p10 AND p90)::INT), 2) AS coverage_80"


def mature_sql(body: str) -> str:
    return with_views("", "series").rstrip() + ", " + SNAP + "\n" + body


add("mature", mature_sql("SELECT series, day, h, round(p50, 6) AS p50, round(actual, 6) AS actual FROM matured"), lambda s, d: matured(s, d).select("series", "day", "h", F.round("p50", 6).alias("p50"), F.round("actual", 6).alias("actual")))
add("forecast_accuracy", mature_sql(f"SELECT {ACC} FROM matured"), lambda s, d: t.forecast_accuracy(matured(s, d), []))
add("accuracy_by_bucket", mature_sql(f"SELECT CASE WHEN h BETWEEN 1 AND 7 THEN '1-7' WHEN h BETWEEN 8 AND 14 THEN '8-14' WHEN h BETWEEN 15 AND 21 THEN '15-21' ELSE 'UNKNOWN' END AS bucket, {ACC} FROM matured GROUP BY 1"), lambda s, d: t.accuracy_by_bucket(matured(s, d)))
add("accuracy_all", mature_sql(f"SELECT series, {ACC} FROM matured GROUP BY series"), lambda s, d: t.accuracy_all(matured(s, d), K))
add("model_metrics", mature_sql("SELECT series, round(avg(abs(p50 - actual)), 4) AS mae, round(sqrt(avg((p50 - actual) * (p50 - actual))), 4) AS rmse, round(100 * avg(abs(p50 - actual) / greatest(abs(actual), 1)), 4) AS mape, round(100 * avg((actual BETWEEN p10 AND p90)::INT), 2) AS coverage, round(avg(p90 - p10), 4) AS width FROM matured GROUP BY series"), lambda s, d: t.model_metrics(matured(s, d), K, "actual", "p50", "p10", "p90"))
PERS = "SELECT series, cast(last + INTERVAL (h) DAY AS DATE) AS target, round(v, 4) AS p50, round(v * (1 - 0.05), 4) AS p10, round(v * (1 + 0.05), 4) AS p90 FROM (SELECT series, max(day) AS last, arg_max(value, day) AS v, unnest(range(1, 8)) AS h FROM series GROUP BY series)"
SEAS = """f0 AS (SELECT series, regr_slope(value, day - DATE '1970-01-01') AS sl, regr_intercept(value, day - DATE '1970-01-01') AS ic, max(day) AS last FROM series GROUP BY series),
f1 AS (SELECT s.series, isodow(day) AS dow, value - ic - sl * (day - DATE '1970-01-01') AS res FROM series s JOIN f0 USING (series)), f2 AS (SELECT series, dow, avg(res) AS season FROM f1 GROUP BY ALL),
f3 AS (SELECT f1.series, coalesce(stddev_samp(res - season), 0) AS sd FROM f1 JOIN f2 USING (series, dow) GROUP BY ALL), f4 AS (SELECT *, cast(last + INTERVAL (h) DAY AS DATE) AS target FROM (SELECT *, unnest(range(1, 8)) AS h FROM f0)),
seas AS (SELECT f4.series, target, ic + sl * (target - DATE '1970-01-01') + coalesce(season, 0) AS p, sd FROM f4 JOIN f3 USING (series) LEFT JOIN f2 ON f2.series = f4.series AND f2.dow = isodow(target))"""
SEL = "SELECT series, target, round(p, {0}) AS p50, round(p - 1.2816 * sd, {0}) AS p10, round(p + 1.2816 * sd, {0}) AS p90 FROM seas"
add("persistence", with_views(PERS, "series"), lambda s, d: t.persistence(series(s, d), K, "day", "value"))


def r3():
    return [F.round(q, 3).alias(q) for q in ("p50", "p10", "p90")]


add("seasonal_trend", with_views("", "series").rstrip() + ", " + SEAS + " " + SEL.format(4).replace("round(p, 4)", "round(round(p, 4), 3)").replace("round(p - 1.2816 * sd, 4)", "round(round(p - 1.2816 * sd, 4), 3)").replace("round(p + 1.2816 * sd, 4)", "round(round(p + 1.2816 * sd, 4), 3)"), lambda s, d: t.seasonal_trend(series(s, d), K, "day", "value").select("series", "target", *r3()))


def _models(s, d):
    x = series(s, d)
    return t.persistence(x, K, "day", "value").withColumn("model", F.lit("persistence")).unionByName(t.seasonal_trend(x, K, "day", "value").withColumn("model", F.lit("trend")))


MODELS = with_views("", "series").rstrip() + ", " + SEAS + f", models AS ({PERS} UNION ALL {SEL.format(4)})"
add("ensemble", MODELS + " SELECT series, target, " + ", ".join(f"round(sum(w * {q}) / sum(w), 1) AS {q}" for q in ("p10", "p50", "p90")) + ", count(*) AS models FROM (SELECT *, CASE WHEN abs(p90 / p50 - 1.05) < 0.00001 AND abs(p10 / p50 - 0.95) < 0.00001 THEN 0.4 ELSE 0.6 END::DOUBLE AS w FROM models) GROUP BY series, target", lambda s, d: t.ensemble(_models(s, d), ["series", "target"], "model", {"persistence": 0.4, "trend": 0.6}).select("series", "target", *[F.round(q, 1).alias(q) for q in ("p50", "p10", "p90")], "models"))
add("model_confidence", MODELS + " SELECT series, target, round(round(CASE WHEN count(*) = 1 THEN 0.5 ELSE greatest(0.1, least(1, 1 - stddev_pop(p50) / greatest(abs(avg(p50)), 1))) END, 4), 3) AS confidence FROM models GROUP BY series, target", lambda s, d: t.model_confidence(_models(s, d), ["series", "target"]).withColumn("confidence", F.round("confidence", 3)))
add("history", with_views("SELECT series, day, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS r, count(*) OVER (PARTITION BY series) AS c FROM series) WHERE r <= 20 AND c >= 10", "series"), lambda s, d: t.history(series(s, d), K, "day", 20).select("series", "day", F.round("value", 6).alias("value")))


INPUTS = [*[f"lag_{k}" for k in (1, 2, 3, 7, 14, 21, 28)], *[f"{n}_{k}" for k in (7, 14, 28) for n in ("mean", "std", "min", "max")], *[f"mom_{k}" for k in (7, 14, 28)], "vol_7", "vol_28", "dow"]


def fit_gbt(s, d):
    """A model for each horizon on the hourly series; an hour is one period, so that the series are long enough to hold 28 periods out."""
    x = hourly(s, d).select("series", F.expr("date_add(date'1970-01-01', cast(unix_timestamp(ts) / 3600 as int))").alias("day"), "value")
    return t.fit_horizons(t.forecast_features(x, K, "day", "value"), "day", INPUTS, HORIZONS).select("series", "day", "horizon", "target", "prediction")


add("fit_gbt", None, fit_gbt)
