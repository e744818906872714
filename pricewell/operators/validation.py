"""The index against official fares, live series for viewers, and the agreement of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.columns import money

from . import analytics as a
from . import cells as c


def fare_comparison(official: DataFrame, index: DataFrame, cells: DataFrame, base_date: str) -> DataFrame:
    """One row per route and month that both have: official fare, the fare that the index stands for, deviation in percent.

    official: (route, month ``yyyy-MM``, official); index: route rows (route, obs_date, index_value) of one horizon; cells: (route, obs_date, price) of that horizon. A month's fare is the mean of its
    positive index values over 100 times the route's price on the base date; before the base date it is the price on the month's first day.
    """
    month = F.date_format("obs_date", "yyyy-MM")
    means = index.where("index_value > 0").groupBy("route", month.alias("month")).agg(F.avg("index_value").alias("mean_index"))
    base = F.lit(base_date).cast("date")
    first = F.to_date(F.concat("month", F.lit("-01")))
    asked = official.where("official > 0").join(means, ["route", "month"]).withColumn("obs_date", F.least(first, base))
    prices = cells.where("price > 0").select("route", "obs_date", F.col("price").alias("base_fare"))
    fare = money(F.col("mean_index") / 100 * F.col("base_fare"))
    rows = asked.join(prices, ["route", "obs_date"]).withColumn("index_fare", fare)
    return rows.select("route", "month", "official", "index_fare", money(F.col("base_fare")).alias("base_fare"), money((F.col("index_fare") - F.col("official")) / F.col("official") * 100).alias("deviation_pct"))


def _errors() -> dict[str, Column]:
    e = F.col("index_fare") - F.col("official")
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mape": 100 * F.avg(F.abs(e) / F.greatest("official", F.lit(1.0))), "bias": F.avg(e)}


def _same_way(keys: list[str]) -> Column:
    """1 where both fares move the same way from the month before, null for a key's first month. Steps don't cross the keys."""
    w = Window.partitionBy(*keys).orderBy("month")
    step = lambda x: F.signum(F.col(x) - F.lag(x).over(w))
    return (step("official") == step("index_fare")).cast("double")


def fare_benchmark(rows: DataFrame) -> DataFrame:
    """Metrics of ``fare_comparison`` by route and over all (null route): MAE, RMSE, MAPE, bias, mean deviation, directional accuracy in percent, correlation, months."""
    judged = rows.withColumn("__same", _same_way(["route"]))
    measures = {n: money(v) for n, v in _errors().items()} | {"mean_deviation_pct": money(F.avg("deviation_pct")), "directional_accuracy": money(100 * F.avg("__same"), 1), "correlation": money(a.safe_corr("official", "index_fare"), 3), "n_months": F.count(F.lit(1))}
    return judged.rollup("route").agg(*[v.alias(n) for n, v in measures.items()])


def validation_summary(rows: DataFrame, period: Column | None = None) -> DataFrame:
    """Means over periods (by default months) of each period's metrics, by route and over all (null route): ``mean_<metric>``, ``n_periods``.

    As in the method, a period without a step counts 0 for direction, and one with no defined correlation 0 for that.
    """
    keyed = rows.withColumn("period", F.col("month") if period is None else period)
    judged = keyed.withColumn("__same", _same_way(["route", "period"]))
    per = {**_errors(), "directional_accuracy": F.coalesce(100 * F.avg("__same"), F.lit(0.0)), "correlation": F.coalesce(a.safe_corr("official", "index_fare"), F.lit(0.0))}
    each = judged.groupBy("route", "period").agg(*[v.alias(n) for n, v in per.items()])
    return each.rollup("route").agg(*[money(F.avg(n), 4).alias(f"mean_{n}") for n in per], F.count(F.lit(1)).alias("n_periods"))


def live_series(fares: DataFrame, scope: str = "national", method: str = "median", freq: str = "daily", base_date: str | None = None, x: str = "base_fare") -> DataFrame:
    """Index series for a viewer, for all routes (and horizons) at once.

    scope: ``window`` (a route at each horizon), ``route`` (all horizons together) or ``national`` (mean of the routes, their counts added up). method: ``median`` of the carriers' least prices after
    outliers, or ``min`` of all. Values are percent of the base date's, or prices for a series that has none. freq: ``weekly`` and ``monthly`` take the mean of the days' values,
    the greatest counts of routes and carriers, and the sum of observations, under the period's first day.
    """
    keys = ["route", "horizon"] if scope == "window" else ["route"]
    economy = c.where_product(c.where_available(fares, x), family=None).withColumn("cabin", F.lit("ECONOMY"))
    cell = [*keys, "obs_date"]
    report = c.cell_report(economy, cell=cell, price=x, estimator="MEDIAN")
    least = c.survivors(economy, cell, price=x).groupBy(*cell).agg(F.min("price").alias("least"))
    open_quotes = c.where_product(fares.where(F.upper(F.coalesce("status", F.lit("AVAILABLE"))) == "AVAILABLE"), family=None)
    seen = open_quotes.groupBy(*cell).agg(F.count(F.lit(1)).alias("observations"))
    if method == "min":
        reps = report.join(least, cell).select(*cell, money(F.col("least")).alias("rep"), "carriers")
    else:
        reps = report.select(*cell, F.col("price").alias("rep"), F.col("carriers_after").alias("carriers"))
    days = reps.join(seen, cell).withColumn("routes", F.lit(1).cast("long"))
    series = keys
    if scope == "national":
        days = days.groupBy("obs_date").agg(F.avg("rep").alias("rep"), F.sum("carriers").alias("carriers"), F.sum("observations").alias("observations"), F.sum("routes").alias("routes"))
        series = []
    at = F.max(F.when((F.col("obs_date") == F.lit(base_date).cast("date")) & (F.col("rep") > 0), F.col("rep"))).over(Window.partitionBy(*series))
    value = money(F.when(at.isNotNull(), F.col("rep") / at * 100).otherwise(F.col("rep")))
    out = days.withColumn("value", value)
    if freq == "daily":
        return out.select(*series, F.col("obs_date").alias("index_date"), F.col("value").alias("index_value"), F.col("routes").alias("route_count"), F.col("carriers").alias("carrier_count"), F.col("observations").alias("observation_count"))
    start = F.to_date(F.date_trunc({"weekly": "week", "monthly": "month"}[freq], "obs_date"))
    return out.groupBy(*series, start.alias("index_date")).agg(
        money(F.avg("value")).alias("index_value"), F.max("routes").alias("route_count"), F.max("carriers").alias("carrier_count"), F.sum("observations").alias("observation_count")
    )


def cohort_correlation(fares: DataFrame, one: str, two: str, keys: list[str], day: str = "obs_date", end: str | None = None, days: int | None = 28, floor: float = 0.7) -> DataFrame:
    """r of two feeds' representative prices (geometric mean of the carriers' least, outliers out) over the days that both have, by key; diverging below ``floor``.

    ``days`` before ``end`` count (by default before the last day of the quotes; None: all). Keys without a defined r have no row. Both feeds are cells of one pass.
    """
    rows = fares.where(F.col("feed_type").isin(one, two))
    if days is not None:
        last = F.lit(end).cast("date") if end else F.col("__end")
        if not end:
            rows = rows.crossJoin(F.broadcast(fares.agg(F.max(day).alias("__end"))))  # one row
        rows = rows.where(F.col(day).between(F.date_sub(last, days), last)).drop("__end")
    cell = [*keys, day, "cohort"]
    prices = c.representative_price(rows.withColumn("cohort", F.col("feed_type")), cell=cell, estimator="JEVONS")
    both = prices.groupBy(*keys, day).agg(F.max(F.when(F.col("cohort") == one, F.col("price"))).alias("a"), F.max(F.when(F.col("cohort") == two, F.col("price"))).alias("b")).where("a is not null and b is not null")
    return a.pearson(both, "a", "b", keys).where("r is not null").withColumn("diverging", F.col("r") < floor)
