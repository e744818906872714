"""Composite reports built from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import analytics as a
from . import cells as c
from . import index as ix
from . import joins as j
from . import timeseries as t


def dual_series(headline: DataFrame, core: DataFrame, on: list[str]) -> DataFrame:
    return j.compare_series(headline, core, on, "index_value")


def correlation_history(corrs: DataFrame, order: str, floor: float = 0.7) -> DataFrame:
    return corrs.withColumn("flagged", F.coalesce(F.col("r") < floor, F.lit(False))).orderBy(F.desc(order), F.asc_nulls_last("r"))


def explain(events: DataFrame, date: str, calendar: DataFrame, fuel: DataFrame, pressure: DataFrame, days: int = 3, fuel_pct: float = 1.0, sold: float = 0.1) -> DataFrame:
    """Signals for every event: a peak day within ``days``, the fuel move, sold-out pressure, the weekday; and a text of them."""
    rows = j.near_event(events, calendar, date, days).join(fuel, date, "left").join(pressure, date, "left")
    signals = F.array_compact(F.array(
        F.when(F.col("event_day").isNotNull(), F.concat(F.lit("calendar:"), F.col("event_day").cast("string"))), F.when(F.abs("fuel_move") >= fuel_pct, F.lit("fuel")), F.when(F.col("ratio") >= sold, F.lit("sold-out")),
        F.when(F.date_format(date, "E").isin("Fri", "Sun"), F.concat(F.lit("weekday:"), F.date_format(date, "E"))),
    ))
    return rows.withColumn("signals", F.array_join(signals, ",")).withColumn("explained", F.col("signals") != "").drop("event_day", "fuel_move", "ratio")


def alert_feed(explained: DataFrame, date: str) -> DataFrame:
    return explained.groupBy(date).agg(F.count(F.lit(1)).alias("alerts"), F.count_if(~F.col("explained")).alias("unexplained"))


def leading_indicator(index: DataFrame, monthly: DataFrame, day: str, x: str, max_lag: int = 4) -> DataFrame:
    """Lead and lag of a daily index, as weekly means, against a monthly series stepped to weeks."""
    both = a.weekly_mean(index, [], day, x).withColumnRenamed("value", "a").join(t.step_weekly(monthly, "month", "value").withColumnRenamed("value", "b"), "week")
    return t.lead_lag(both.withColumn("series", F.lit("all")), "a", "b", "week", ["series"], max_lag)


def fuel_overlay(fuel: DataFrame, index: DataFrame, date: str) -> DataFrame:
    """Both series at 100 on their first day, over the fuel's days."""
    f = t.rebase(fuel.withColumn("k", F.lit(1)), ["k"], date, "fuel").select(date, F.col("rebased").alias("fuel_index"))
    i = t.rebase(index.withColumn("k", F.lit(1)), ["k"], date, "value").select(date, F.col("rebased").alias("price_index"))
    return j.overlay(f, i, date, "fuel_index", "price_index")


def carrier_scorecard(carrier_index: DataFrame, day: str = "obs_date") -> DataFrame:
    """Latest index of the carriers: spread, the dearest and the cheapest."""
    last = j.latest_per(carrier_index, ["carrier", "horizon"], [day])
    return last.groupBy("horizon").agg(F.round(F.max("index_value") - F.min("index_value"), 4).alias("spread"), F.max(F.struct("index_value", "carrier"))["carrier"].alias("leader"), F.min(F.struct("index_value", "carrier"))["carrier"].alias("value_leader"), F.count(F.lit(1)).alias("carriers"))


def trajectory(fares: DataFrame, route: str, order: list[str]) -> DataFrame:
    return fares.where(F.col("route") == route).orderBy(*order)


def common_flights(quotes: DataFrame, cluster: list[str], source: str, x: str, direct: Column, least: int = 2) -> DataFrame:
    return a.canonical_price(quotes, cluster, source, x, direct).where(F.col("sources") >= least)


def index_between(index: DataFrame, day: str, lo: str, hi: str, **more) -> DataFrame:
    return j.where_any(index, **{f"{day}_from": lo, f"{day}_to": hi}, **more).orderBy(day)


def weights_history(weights: DataFrame) -> DataFrame:
    return weights.orderBy(F.desc("effective_from"), F.desc("weight"), "route")


def briefing(index: DataFrame, carriers: DataFrame, vol: DataFrame, curve: DataFrame) -> DataFrame:
    """One row: headline, dearest carrier, mean spread, and what booking early saves. Each part is one row, so the joins are of one row each."""
    top = j.latest_per(index.withColumn("k", F.lit(1)), ["k"], ["obs_date"]).select(F.col("obs_date").alias("as_of"), F.col("index_value").alias("headline"))
    leader = j.latest_per(carriers, ["carrier"], ["obs_date"]).agg(F.max(F.struct("index_value", "carrier"))["carrier"].alias("dearest_carrier"))
    spread = vol.agg(F.round(F.avg("spread_pct"), 2).alias("avg_spread"))
    at = lambda h: F.avg(F.when(F.col("horizon") == h, F.col("fare")))
    saved = curve.agg(F.round(100 * (at(1) - at(45)) / F.nullif(at(1), F.lit(0.0)), 2).alias("early_saving_pct"))
    return top.crossJoin(leader).crossJoin(spread).crossJoin(saved)


def digest(published: DataFrame, weights: DataFrame, carriers: DataFrame, volatility: DataFrame, curve: DataFrame, escalation: DataFrame, fuel: DataFrame, horizon: int = 15) -> DataFrame:
    """Five rows (matrix, body): headline, carriers, corridors, lead time and fuel, each as one JSON text for a reader that takes text only.

    The lists in a body have an entry for each carrier, corridor, horizon or route, not for quotes. ``fuel``: (day, fuel); its revision is that of the last day against the record before.
    """
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("matrix"), F.to_json(F.struct("*")).alias("body"))

    def listed(df: DataFrame, columns: list[str], order: list[str]) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("v")))), lambda x: x["v"])

    national = published.where((F.col("price_series") == "BASE_FARE") & (F.col("series_type") == "HEADLINE") & (F.col("horizon") == horizon) & F.col("route").isNull())
    latest = national.agg(F.max_by(F.struct("obs_date", "index_value", "change_1d", "change_7d", "change_30d", "coverage"), "obs_date").alias("r")).select("r.*")
    basket = weights.agg(listed(weights, ["route", "weight_pct"], ["route"]).alias("basket")) if "weight_pct" in weights.columns else weights.withColumn("weight_pct", F.round(100 * F.col("weight"), 2)).agg(listed(weights, ["route", "weight_pct"], ["route"]).alias("basket"))
    headline = one(latest.crossJoin(basket), "headline")  # one row each
    last = j.latest_per(carriers.where(F.col("horizon") == horizon), ["carrier"], ["obs_date"])
    score = last.agg(F.round(F.max("index_value") - F.min("index_value"), 4).alias("spread"), F.max(F.struct("index_value", "carrier"))["carrier"].alias("leader"), F.min(F.struct("index_value", "carrier"))["carrier"].alias("value_leader"), listed(last, ["carrier", "index_value", "n_routes"], ["carrier"]).alias("carriers"))
    surge = F.col("volatility_status") == "SURGE_ALERT"
    corridors = volatility.agg(F.count(F.lit(1)).alias("monitored"), F.round(F.avg("spread_pct"), 2).alias("average_spread_pct"), F.count_if(surge).alias("surging"), listed(volatility, volatility.columns, ["route"]).alias("corridors"))
    at = lambda h: F.max(F.when(F.col("horizon") == h, F.col("fare")))
    by_route = curve.groupBy("route").agg(F.round(F.try_divide(at(1), at(45)), 2).alias("multiplier"), listed(curve, ["horizon", "fare"], ["horizon"]).alias("curve"))
    steps = escalation.groupBy("route").agg(listed(escalation, ["carrier", "escalation"], ["carrier"]).alias("carriers"))
    lead = by_route.join(steps, "route", "left").agg(listed(by_route, ["route", "multiplier", "curve", "carriers"], ["route"]).alias("routes"))
    recent = fuel.orderBy(F.desc("day")).limit(2).agg(F.sort_array(F.collect_list(F.struct("day", "fuel")), asc=False).alias("f"))
    move = recent.select(F.get("f", F.lit(0))["day"].alias("day"), F.get("f", F.lit(0))["fuel"].alias("fuel"), F.round(100 * (F.get("f", F.lit(0))["fuel"] - F.get("f", F.lit(1))["fuel"]) / F.nullif(F.get("f", F.lit(1))["fuel"], F.lit(0.0)), 2).alias("revision_pct"))
    return j.union_feeds(headline, one(score, "carriers"), one(corridors, "corridors"), one(lead, "lead_time"), one(move, "fuel"))


def backtest(index: DataFrame, official: DataFrame, month: str = "month") -> DataFrame:
    """Monthly means against an official series: r, mean absolute deviation in percent, months in common."""
    rows = j.month_compare(index, official, month).where("missing is null")
    return rows.agg(F.count(F.lit(1)).alias("months"), F.round(a.safe_corr("a", "b"), 4).alias("r"), F.round(F.avg(F.abs("deviation_pct")), 4).alias("mean_deviation_pct"))
