"""The published index, its core series and the evidence that other tables give, on planted quotes."""

import bisect
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from pricewell.operators import analytics, joins, validation
from pricewell.operators import published as pub
from pricewell.operators import timeseries as t

DAY0 = dt.date(2024, 1, 1)
QUOTE = "route string, carrier string, horizon int, obs_date date, travel_date date, status string, feed_type string, fare_family string, cabin string, base_fare double, total_fare double"


def day(k):
    return DAY0 + dt.timedelta(days=k)


def quote(route, k, price, horizon=15, carrier="A", travel=None, status="AVAILABLE"):
    return (route, carrier, horizon, day(k), travel or day(k + horizon), status, "CARRIER_DIRECT", "BASIC", "ECONOMY", float(price), price * 1.25)


def frame(spark, rows):
    return spark.createDataFrame(rows, QUOTE)


def weights(spark):
    return spark.createDataFrame([("P", 0.75), ("Q", 0.25)], "route string, weight double")


def calendar(spark, *days):
    return spark.createDataFrame([(day(k),) for k in days], "day date")


def test_daily_index_values_changes_and_mean(spark):
    prices = {k: 100 + k for k in range(40) if k != 20}
    rows = [quote("P", k, x) for k, x in prices.items()] + [quote("Q", k, 200) for k in prices]
    out = pub.daily_index(frame(spark, rows), weights(spark), str(DAY0)).cache()
    assert out.columns == pub.COLUMNS
    got = {r["obs_date"]: r for r in out.where("route is null and price_series = 'BASE_FARE'").collect()}
    value = {k: 75 * (100 + k) / 100 + 25 for k in prices}
    for k in prices:
        r = got[day(k)]
        assert r["index_value"] == pytest.approx(value[k]) and r["coverage"] == 100.0 and not r["low_coverage"] and r["n_routes"] == 2
        for n, c in ((1, "change_1d"), (7, "change_7d"), (30, "change_30d")):
            assert r[c] == (pytest.approx(100 * (value[k] - value[k - n]) / value[k - n], abs=0.006) if k - n in value else None)
        near = [value[i] for i in range(k - 27, k + 1) if i in value]
        assert r["moving_avg"] == (pytest.approx(sum(near) / len(near), abs=0.006) if len(near) >= 5 else None)
        assert (r["spot_from"], r["spot_to"], r["divisor"]) == (day(k - 28), day(k - 3), 1.0)
    routes = {(r["route"], r["obs_date"]): r for r in out.where("route is not null and price_series = 'TOTAL_FARE'").collect()}
    assert routes["P", day(30)]["index_value"] == 130.0 and routes["Q", day(30)]["change_7d"] == 0.0 and routes["P", day(5)]["index_status"] == "LIVE"


def test_series_without_a_base_price_is_not_published(spark):
    rows = [quote("P", k, 100, horizon=15) for k in range(3)] + [quote("P", k, 100, horizon=30) for k in range(1, 3)]
    got = pub.daily_index(frame(spark, rows), weights(spark), str(DAY0)).select("horizon").distinct().collect()
    assert [r["horizon"] for r in got] == [15]
    assert pub.daily_index(frame(spark, rows).limit(0), weights(spark), str(DAY0)).count() == 0


def test_divisor_is_carried_within_a_run_of_days(spark):
    rows = [("s", day(k), 1.5 if k == 2 else None) for k in (0, 1, 2, 3, 4, 6, 7)] + [("u", day(1), 2.0), ("u", day(2), None), ("u", day(3), 4.0), ("u", day(4), None)]
    df = spark.createDataFrame(rows, "k string, obs_date date, reset double")
    got = {(r["k"], r["obs_date"]): r["d"] for r in df.withColumn("d", pub.carried_divisor(["k"], "obs_date", F.col("reset"))).collect()}
    assert [got["s", day(k)] for k in (0, 1, 2, 3, 4, 6, 7)] == [1.0, 1.0, 1.5, 1.5, 1.5, 1.0, 1.0]
    assert [got["u", day(k)] for k in (1, 2, 3, 4)] == [2.0, 2.0, 4.0, 4.0]


def core(spark, rows, cal, base, **options):
    quotes = frame(spark, rows)
    headline = pub.daily_index(quotes, weights(spark), base)
    return {r["obs_date"]: r for r in pub.core_index(quotes, weights(spark), cal, base, headline, **options).where("price_series = 'BASE_FARE'").collect()}


def test_core_waits_for_continuity(spark):
    rows = [quote("P", k, 100 + k) for k in range(12)] + [quote("Q", k, 200 + k) for k in (0, 3, 6, 9, 11)] + [quote("P", 40, 150)]
    got = core(spark, rows, calendar(spark, 500), str(DAY0))
    assert sorted(got) == [day(k) for k in range(5, 12)]  # five points within the 14 days before, so from the sixth day on; day 40 has none
    assert got[day(9)]["index_value"] == 109.0 and got[day(9)]["n_routes"] == 1 and got[day(9)]["coverage"] == 75.0
    assert got[day(11)]["n_routes"] == 1  # Q has four points before


def test_core_leaves_peak_travel_out_and_anchors_anew(spark):
    peak = [quote("P", 0, 100, travel=day(15)), quote("P", 3, 300, travel=day(100))]
    rows = [quote("P", k, 100 + k, travel=day(60)) for k in (1, 2, 4, 5, 6, 7, 8)] + peak
    cal = calendar(spark, 15, 100, 16)  # the base day's travel, and that of day 1 by its horizon
    got = core(spark, rows, cal, str(DAY0))
    # Day 1 would travel on a peak day, so the base is day 2; day 3 had peak travel only; day 5 has points 0 to 4 before it.
    assert {k: r["index_value"] for k, r in got.items()} == {day(k): round(100 * (100 + k) / 102, 4) for k in (5, 6, 7, 8)}
    far = core(spark, rows, cal, str(day(-30)))
    assert far == {}  # no headline either, as it has no base price
    assert core(spark, rows, cal, str(DAY0), anchor_days=1) == {}


def test_index_now_and_its_fallback(spark):
    rows = [quote("P", k, 100 + k, horizon=h) for k in range(8) for h in (15, 30)] + [quote("P", 9, 120)]
    quotes = frame(spark, rows)
    table = pub.published_index(quotes, weights(spark), calendar(spark, 500), str(DAY0))
    asked = spark.createDataFrame([("BASE_FARE", 14, "HEADLINE"), ("BASE_FARE", 45, "HEADLINE"), ("TOTAL_FARE", 30, "HEADLINE"), ("BASE_FARE", 15, "CORE"), ("BASE_FARE", 15, "NONE")], "price_series string, horizon int, series_type string")
    got = {(r["asked_price"], r["asked_horizon"], r["series_type"]): r for r in pub.index_now(table, asked).collect()}
    assert len(got) == 4
    one, other = got["BASE_FARE", 14, "HEADLINE"], got["BASE_FARE", 45, "HEADLINE"]
    assert (one["horizon"], one["obs_date"], one["index_value"], one["fallback"]) == (15, day(9), 120.0, False)
    assert (other["price_series"], other["horizon"], other["obs_date"], other["fallback"]) == ("BASE_FARE", 15, day(9), True)
    assert got["TOTAL_FARE", 30, "HEADLINE"]["obs_date"] == day(7) and got["BASE_FARE", 15, "CORE"]["obs_date"] == day(9)
    assert one["confidence_score"] == round(min(100.0, one["quality_score"] * 0.96 * 1.05), 2) and one["confidence_band"] in ("LOW", "MEDIUM", "HIGH")


def test_asof_join_equals_brute_force(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(400)])) for i in range(300)]
    right = [(rng.choice(["a", None]), rng.choice([None, *range(-50, 380)]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(60)]
    d = lambda k: None if k is None else day(k)
    df = spark.createDataFrame([(i, k, d(x)) for i, k, x in left], "id int, k string, day date")
    other = spark.createDataFrame([(k, d(x), v) for k, x, v in right], "k string, day date, v double")
    for keys in (["k"], []):
        got = {r["id"]: (r["v"], r["v_age"]) for r in joins.asof_join(df, other, keys, "day", "v", "v", span=7).collect()}
        for i, k, x in left:
            seen = [(y, v) for kk, y, v in right if (not keys or kk == k) and y is not None and v is not None and x is not None and y <= x]
            best = max(seen, default=None)
            assert got[i] == ((best[1], x - best[0]) if best else (None, None))
    assert joins.asof_join(df.limit(0), other, ["k"], "day", "v", "v").count() == 0 and joins.asof_join(df, other.limit(0), ["k"], "day", "v", "v").where("v is not null").count() == 0


def test_policy_signal_reads_its_evidence(spark):
    flat, high = [("flat", k, 100.0) for k in range(30)], [("high", k, 100.0 if k < 20 else 130.0) for k in range(50)]
    series = spark.createDataFrame([(s, day(k), 15, x) for s, k, x in [*flat, *high, ("new", 0, 1.0)]], "series string, obs_date date, horizon int, index_value double")
    quotes = frame(spark, [quote("P", 49, 100, carrier=c) for c in "ABC"] + [quote("P", 49, 100, carrier="D", status="SOLD_OUT"), quote("P", 29, 100, carrier="A"), quote("P", 49, 1, carrier="E", horizon=30)])
    fuel = spark.createDataFrame([(day(k), x) for k, x in ((-5, 999.0), (0, 100.0), (20, 101.0), (45, 110.0), (60, 1.0))], "day date, fuel double")
    got = {r["series"]: r for r in t.policy_signal(series, ["series", "horizon"], "obs_date", "index_value", calendar(spark, 500), quotes=quotes, fuel=fuel).collect()}
    assert (got["high"]["carrier_breadth"], got["high"]["fuel_move_pct"], got["high"]["fuel_aligned"], got["high"]["mode"]) == (3, 10.0, True, "STRUCTURAL")
    assert (got["flat"]["carrier_breadth"], got["flat"]["fuel_move_pct"], got["flat"]["mode"]) == (1, 1.0, "NO_ELEVATION")
    assert (got["new"]["status"], got["new"]["mode"], got["new"]["points"]) == ("INSUFFICIENT_DATA", None, 1)


def test_fare_metrics(spark):
    rows = [("P", "2024-01", 100.0, 110.0), ("P", "2024-02", 120.0, 115.0), ("P", "2024-03", 110.0, 120.0), ("Q", "2024-01", 200.0, 200.0)]
    df = spark.createDataFrame(rows, "route string, month string, official double, index_fare double").withColumn("deviation_pct", F.round(100 * (F.col("index_fare") - F.col("official")) / F.col("official"), 2))
    got = {r["route"]: r for r in validation.fare_benchmark(df).collect()}
    assert got["P"]["mae"] == 8.33 and got["P"]["rmse"] == 8.66 and got["P"]["bias"] == 5.0 and got["P"]["directional_accuracy"] == 50.0 and got["P"]["n_months"] == 3
    assert got["Q"]["correlation"] is None and got["Q"]["directional_accuracy"] is None and got[None]["n_months"] == 4 and got[None]["mae"] == 6.25
    assert got[None]["directional_accuracy"] == 50.0  # steps don't lead from one route to another
    by_month = {r["route"]: r for r in validation.validation_summary(df).collect()}
    assert by_month["P"]["mean_mae"] == pytest.approx(8.3333) and by_month["P"]["mean_directional_accuracy"] == 0.0 and by_month["P"]["n_periods"] == 3
    assert by_month[None]["mean_mae"] == 6.25 and by_month[None]["mean_rmse"] == 6.25


def test_escalation_falls_back_and_guards(spark):
    rows = [("A", 1, 300.0), ("A", 45, 100.0), ("A", 14, 50.0), ("B", 1, 90.0), ("B", 14, 60.0), ("B", 45, 0.0), ("C", 1, 10.0), ("C", 30, 5.0), ("D", 45, 5.0)]
    df = spark.createDataFrame(rows, "carrier string, horizon int, fare double")
    assert {r["carrier"]: r["escalation"] for r in analytics.carrier_escalation(df, ["carrier"], "fare").collect()} == {"A": 3.0, "B": 1.5}


def test_features_have_the_last_fuel(spark):
    index = spark.createDataFrame([("BASE_FARE", 15, day(k), 100.0 + k) for k in range(60)], "price_series string, horizon int, obs_date date, index_value double")
    fuel = spark.createDataFrame([(day(k), float(k)) for k in range(-3, 60, 7)], "day date, fuel double")
    got = {r["obs_date"]: r for r in t.forecast_features(index, ["price_series", "horizon"], "obs_date", "index_value", weights(spark), fuel).collect()}
    known = list(range(-3, 60, 7))
    for k in range(59):
        last = known[bisect.bisect_right(known, k) - 1]
        assert (got[day(k)]["fuel"], got[day(k)]["fuel_age"]) == (float(last), k - last)
    r = got[day(30)]
    assert r["is_headline"] == 1 and r["market_concentration"] == 0.625 and r["lag_7_pct"] == pytest.approx(130 / 123 - 1) and r["target_15"] == 145.0 and math.isclose(r["mean_7"], 127.0)
