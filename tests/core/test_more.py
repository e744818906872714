"""Bootstrap by brute force, file readers, snapshots, streams over several batches, models against a plain mean."""

import datetime as dt
import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewell.functions.columns import money
from pricewell.operators import analytics, clean, joins
from pricewell.operators import index as ix
from pricewell.operators import text
from pricewell.operators import timeseries as t
from pricewell.sources import files
from pricewell.streaming import ops


def draws(name, prices, replications, seed=7):
    """The replications of one cell, draw by draw."""
    c = int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:8], 16) % ix.PRIME
    v = sorted(prices)
    out = []
    for rep in range(1, replications + 1):
        picked = [v[pow((c + rep * ix.REP_STEP + k * ix.DRAW_STEP) % ix.PRIME, 5, ix.PRIME) * len(v) // ix.PRIME] for k in range(1, len(v) + 1)]
        out.append(float(np.exp(np.mean(np.log(picked)))))
    return np.array(out)


def test_bootstrap_equals_brute_force(spark):
    rng = random.Random(1)
    cells = {("A", 1): [100.0, 120.0, 90.0, 200.0], ("B", 1): [50.0], ("A", 2): [rng.uniform(50, 150) for _ in range(7)]}
    rows = [(r, h, f"c{i}", p) for (r, h), ps in cells.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "route string, horizon int, carrier string, price double")
    base = spark.createDataFrame([("A", 100.0), ("B", 40.0)], "route string, base double")
    weights = spark.createDataFrame([("A", 0.75), ("B", 0.25)], "route string, weight double")
    got = {r["horizon"]: r for r in ix.bootstrap_index(df, weights, base, ["route", "horizon"], ["horizon"], 400).collect()}
    geo = lambda ps: float(np.exp(np.mean(np.log(ps))))
    for h, routes in ((1, {"A": (100, 0.75), "B": (40, 0.25)}), (2, {"A": (100, 0.75)})):
        total = sum(w for _, w in routes.values())
        index = lambda price: sum(100 * w * price(r) / b for r, (b, w) in routes.items()) / total  # noqa: E731, B023
        each = sum(100 * w * draws(f"{r}/{h}", cells[r, h], 400) / b for r, (b, w) in routes.items()) / total
        seen, sd = index(lambda r: geo(cells[r, h])), each.std(ddof=1)  # noqa: B023
        want = [each.mean(), np.median(each), sd, min(np.quantile(each, 0.025), seen), max(np.quantile(each, 0.975), seen), seen, each.mean() - seen, seen - 1.959964 * sd, seen + 1.959964 * sd]
        assert list(got[h])[3:] == pytest.approx(want, abs=2e-4) and got[h]["n_routes"] == len(routes) and got[h]["replications"] == 400
    one = {(r["route"], r["horizon"]): r for r in ix.bootstrap_route(df, base, ["route", "horizon"], 400).collect()}
    assert one["B", 1]["standard_error"] == 0 and one["B", 1]["ci_lower"] == one["B", 1]["ci_upper"] == 125.0
    assert one["A", 1]["standard_error"] == pytest.approx(draws("A/1", cells["A", 1], 400).std(ddof=1), abs=1e-4)


def test_draws_are_uniform():
    v = np.arange(1.0, 7.0)
    n = len(v)
    rep = np.arange(1, 20001, dtype=np.int64)[:, None] * ix.REP_STEP
    x = (12345 + rep + np.arange(1, n + 1, dtype=np.int64) * ix.DRAW_STEP) % ix.PRIME
    square = x * x % ix.PRIME
    pick = square * square % ix.PRIME * x % ix.PRIME * n // ix.PRIME
    share = np.bincount(pick.ravel(), minlength=n) / pick.size
    assert np.abs(share - 1 / n).max() < 0.005
    assert np.abs(np.corrcoef(pick.T) - np.eye(n)).max() < 0.03 and abs(np.corrcoef(pick[1:, 0], pick[:-1, 0])[0, 1]) < 0.03


def test_money(spark):
    got = spark.createDataFrame([(583.845,), (583.8449999999999,), (0.005,), (-1.115,), (None,)], "x double").select(money(F.col("x"))).collect()
    assert [r[0] for r in got] == [583.85, 583.85, 0.01, -1.12, None]


def write(path, text_):
    path.write_text(text_)
    return str(path)


def test_readers(spark, tmp_path):
    traffic = write(tmp_path / "t.csv", "destination_airport,origin_airport,period,passenger_volume,carrier_count,source_publication,more\n bom, del ,2024-01,1000.5,7,x,y\nblr,del,2024-01,n/a,3,x,y\n")
    assert [(r["origin_airport"], r["destination_airport"], r["passenger_volume"]) for r in files.read_traffic(spark, traffic).collect()] == [("DEL", "BOM", 1000.5), ("DEL", "BLR", None)]
    bench = write(tmp_path / "b.csv", "period,indicator_name,base_year,index_value,source_agency,publication_title\n2024-01,air,2012,150.5,a,p\n2024-02,air,2012,,a,p\n")
    old = spark.createDataFrame([("2024-01", "air", 2012, 1.0, "a", "p"), ("2023-12", "air", 2012, 2.0, "a", "p")], files.BENCHMARK)
    assert sorted((r["period"], r["index_value"]) for r in files.read_benchmark(spark, bench, old).collect()) == [("2023-12", 2.0), ("2024-01", 150.5)]
    fuel = write(tmp_path / "f.csv", "source,date,location,price_per_kl\ns,2024-01-01,DEL,99000\ns,2024-01-02,DEL,98000\n")
    assert [(str(r["date"]), r["price_per_kl"]) for r in files.read_fuel(spark, fuel).orderBy("date").collect()] == [("2024-01-01", 99000.0), ("2024-01-02", 98000.0)]
    routes = spark.createDataFrame([("A-B",)], "route_code string")
    monthly = write(tmp_path / "m.csv", "fare,route_code,period,sector\n5,A-B,2024-01,x\n9,A-B,2024-01,x\n7,C-D,2024-01,x\n")
    assert [(r["route_code"], r["fare"]) for r in files.read_monthly_fares(spark, monthly, routes).collect()] == [("A-B", 5.0)]
    with pytest.raises(ValueError, match="sector"):
        files.read_monthly_fares(spark, write(tmp_path / "w.csv", "fare,route_code,period\n1,A-B,x\n"), routes)
    words = write(tmp_path / "w.tsv", "level\tpage_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t10\t20\t30\t5\t96\tHello\n4\t1\t0\t0\t9\t9\t-1\t\n5\t1\t50\t20\t10\t5\t80\t \n")
    assert [tuple(r) for r in text.read_word_rows(spark, words).collect()] == [(1, "Hello", 10.0, 20.0, 40.0, 25.0, 0.96)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("B", 2, None), ("A", 1, 1.5)], "route string, k int, x double")
    files.export_daily_index(df, str(tmp_path / "csv"), ["route"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("route").collect()[0].asDict() == {"route": "A", "k": "1", "x": "1.5"}
    files.export_daily_index_json(df, str(tmp_path / "json"), ["route"])
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    files.export_weights(df.select("route", F.col("k").alias("weight")), spark.createDataFrame([("A", "x")], "route string, name string"), str(tmp_path / "w"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "w"), header=True).collect()] == [("A", "1", "x")]
    files.export_route_obs(df, "A", 1, str(tmp_path / "r"), ["k"])
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 1
    files.copy_table(df, str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2


def test_store_returns_what_it_wrote(spark, tmp_path):
    path = str(tmp_path / "store")
    day = dt.datetime(2024, 1, 2)
    df = lambda *texts: spark.createDataFrame([(x, day) for x in texts], "content string, ts timestamp")
    assert sorted(r["content"] for r in files.store_payloads(df("a", "b", "a"), path).collect()) == ["a", "b"]
    new = files.store_payloads(df("b", "c"), path)
    assert [r["content"] for r in new.collect()] == ["c"] and spark.read.parquet(path).count() == 3


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    forecast = spark.createDataFrame([("s", dt.date(2024, 1, d), float(d)) for d in (2, 3)], "series string, target date, p50 double")
    assert t.append_snapshot(forecast, path, ["series"], "2024-01-01", {"m": 0.5}, index_type="BASE").count() == 2
    t.append_snapshot(forecast, path, ["series"], "2024-01-01", {"m": 0.5}, index_type="BASE")  # a repeated run replaces its own rows
    t.append_snapshot(forecast, path, ["series"], "2023-12-31", index_type="BASE")
    got = sorted((str(r["forecast_date"]), r["horizon_days"], r["p50"], r["ensemble_weights"]) for r in t.read_snapshots(spark, path).collect())
    assert got == [("2023-12-31", 2, 2.0, None), ("2023-12-31", 3, 3.0, None), ("2024-01-01", 1, 2.0, '{"m": 0.5}'), ("2024-01-01", 2, 3.0, '{"m": 0.5}')]


def test_unexpected_and_deep_json(spark):
    df = spark.createDataFrame([(["b", "fare", "a"],), ([],), (None,)], "k array<string>")
    assert [r[0] for r in df.select(clean.unexpected(F.col("k"), ["fare"])).collect()] == [["a", "b"], [], None]
    deep = '{"x":' * 12 + '{"k":"[{"}' + "}" * 12
    rows = [(1, json.dumps({"k": 1, "a": [{"k": "two"}, {"b": {"k": [3]}}]})), (2, deep), (3, None), (4, "no json"), (5, '{"s":"\\"k\\":{{{{"}')]
    got = text.json_values(spark.createDataFrame(rows, "id int, p string"), "p", "k").collect()
    assert sorted((r["id"], r["value"]) for r in got) == [(1, "1"), (1, "[3]"), (1, "two"), (2, "[{")]


def test_breaker_over_batches_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(4) if i % 3 else 0, at + dt.timedelta(seconds=int(i * 7 + rng.randrange(5))), rng.random() < 0.6) for i in range(600)]
    rng.shuffle(rows)
    schema = "event_id long, source long, ts timestamp, failed boolean"
    for k in range(5):
        spark.createDataFrame(rows[k::5], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = ops.drain(ops.breaker_state(stream, "source", "ts", "failed", 3, delay="3 hours"), "update")
    got = {r["source"]: (r["run"], r["state"]) for r in ops.latest_state(out, "source").collect()}
    batch = ops.breaker_batch(spark.createDataFrame(rows, schema), "source", "ts", "failed", "2024-01-01", 3)
    assert got == {r["source"]: (r["run"], r["state"]) for r in batch.collect()} and len(got) == 4


def test_models_beat_the_mean(spark):
    day = dt.date(2020, 1, 1)
    rows = [("a", day + dt.timedelta(days=i), 100 + 20 * np.sin(2 * np.pi * i / 7)) for i in range(260)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["series", "day", "value"]))
    features = t.forecast_features(df, ["series"], "day", "value").select("series", "day", "lag_1", "lag_2", "value", "target_1", "target_7")
    got = t.fit_horizons(features, "day", ["lag_1", "lag_2", "value"], (1, 7), maxIter=8).toPandas()
    assert sorted(got["horizon"].unique()) == [1, 7]
    for _, part in got.groupby("horizon"):
        assert ((part["prediction"] - part["target"]) ** 2).mean() < 0.2 * part["target"].var()


def test_summary_of_hot_and_odd_groups(spark):
    rng = np.random.default_rng(3)
    groups = {"hot": np.round(rng.lognormal(8, 1, 4001), 2), "even": np.array([5.0, 1.0, 9.0, 3.0]), "signs": np.array([-1e9, -0.5, 0.0, 0.5, 2.0, 1e12]), "ties": np.array([7.0] * 6), "one": np.array([4.25]), None: np.array([1.0, 2.0])}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("gone", None)]
    got = {r["g"]: r for r in analytics.summary(spark.createDataFrame(data, "g string, x double"), ["g"], "x").collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        v, r = np.sort(v), got[g]
        assert (r["n"], r["lo"], r["hi"], r["mid_lo"], r["mid_hi"]) == (len(v), v[0], v[-1], v[(len(v) - 1) // 2], v[len(v) // 2])
        assert r["m"] == pytest.approx(v.mean(), rel=1e-12)
        assert r["sd"] == pytest.approx(v.std(ddof=1) if len(v) > 1 else 0.0, rel=1e-9, abs=1e-9)


def test_summary_without_keys_or_rows(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (float("nan"),)], "x double")
    assert [(r["n"], r["mid_lo"], r["mid_hi"]) for r in analytics.summary(df, [], "x").collect()] == [(3, 3.0, 3.0)]
    empty = analytics.summary(df.where("x < 0"), [], "x").collect()
    assert len(empty) == 1 and empty[0]["mid_lo"] is None
    assert analytics.summary(df.where("x < 0").selectExpr("x", "'a' AS g"), ["g"], "x").collect() == []


def test_islands(spark):
    rows = [("a", float(m)) for m in (0, 10, 34, 69, 105, 140, 141, 300)] + [("b", 5.0), ("b", 41.0), (None, 1.0), (None, 36.0), ("a", None)]
    got = {(r["k"], r["m"]): r["island"] for r in joins.islands(spark.createDataFrame(rows, "k string, m double"), ["k"], "m", 35).collect()}
    assert got == {("a", 0.0): 0, ("a", 10.0): 0, ("a", 34.0): 0, ("a", 69.0): 0, ("a", 105.0): 1, ("a", 140.0): 1, ("a", 141.0): 1, ("a", 300.0): 2, ("b", 5.0): 0, ("b", 41.0): 1, (None, 1.0): 0, (None, 36.0): 0}


def test_hot_key_is_matched_in_many_groups(spark):
    left = spark.range(3000).selectExpr("'x' as k", "id as lid", "cast(id * 100 as double) as minutes")
    right = spark.range(3000).selectExpr("'x' as k", "id as rid", "cast(id * 100 + id % 50 as double) as minutes")
    got = joins.match_nearest(left, right, ["k"], "minutes")
    assert {(r["lid"], r["rid"]) for r in got.collect()} == {(i, i) for i in range(3000) if i % 50 <= 35}
    free = joins.islands(left, ["k"], "minutes", 35).selectExpr("island div 64 as g").distinct().count()
    assert free > 40


def test_first_row_of_the_first_file(spark, tmp_path):
    routes = spark.createDataFrame([("A-B",), ("C-D",)], "route_code string")
    folder = tmp_path / "fares"
    folder.mkdir()
    lines = [f"A-B,2024-{m:02d},x,{m}" for m in range(1, 13)] + ["C-D,2024-01,x,7"] * 200 + [f"A-B,2024-{m:02d},x,{m + 100}" for m in range(1, 13)]
    write(folder / "a.csv", "route_code,period,sector,fare\n" + "\n".join(lines) + "\n")
    write(folder / "b.csv", "route_code,period,sector,fare\nA-B,2024-01,x,999\nE-F,2024-01,x,5\nC-D,2025-01,x,8\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # several splits of the first file
    try:
        rows = files.read_monthly_fares(spark, str(folder), routes)
        assert rows.rdd.getNumPartitions() > 0
        got = {(r["route_code"], r["period"]): r["fare"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {**{("A-B", f"2024-{m:02d}"): float(m) for m in range(1, 13)}, ("C-D", "2024-01"): 7.0, ("C-D", "2025-01"): 8.0}


def test_scan_reads_only_the_folders_asked_for(spark, tmp_path):
    path = str(tmp_path / "fares")
    days = [dt.date(2024, 1, d) for d in range(1, 11)]
    quotes = spark.createDataFrame([(d, h, r, float(h)) for d in days for h in (1, 15) for r in ("A", "B")], "obs_date date, horizon int, route string, price double")
    files.write_fares(quotes, path)
    table = spark.read.parquet(path)
    one = files.scan_fares(table, days[2], 15, "B")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(obs_date" in plan and "EqualTo(route,B)" in plan
    assert [tuple(r) for r in one.select("route", "price").collect()] == [("B", 15.0)]
    wanted = spark.createDataFrame([(days[0], "peak"), (days[9], "peak"), (days[4], "other")], "obs_date date, kind string").where("kind = 'peak'")
    some = files.scan_fares(table, days=wanted)
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 8 and some.inputFiles()


def test_store_by_hash(spark, tmp_path):
    path = str(tmp_path / "store")
    df = lambda *texts: spark.createDataFrame([(x, dt.datetime(2024, 1, 2)) for x in texts], "content string, ts timestamp")
    files.store_payloads(df(*[f"page {i}" for i in range(50)]), path)
    new = files.store_payloads(df("page 1", "page 50"), path)
    assert [r["content"] for r in new.collect()] == ["page 50"]
    assert all("/run=" in f for f in new.inputFiles()) and len(new.inputFiles()) == 1  # of some 50 files in the store
    assert files.store_payloads(df("page 1"), path).count() == 0
    first = spark.read.parquet(path).where("content = 'page 7'")
    first.withColumn("run", F.lit("9")).write.mode("append").partitionBy("prefix", "run").parquet(path)  # a second run at the same time
    assert spark.read.parquet(path).count() == 52 and files.stored_payloads(spark, path).count() == 51


def test_stream_repairs_days(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 1, day, hour)
    batches = [[(1, at(1, 1)), (2, at(1, 20)), (3, at(2, 10))], [(4, at(1, 5)), (5, at(2, 11))], [(6, at(3, 1))]]
    arriving = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.mode("append").parquet(arriving)
    seen = []

    def recompute(rows):
        seen.append(sorted(str(r["day"]) for r in rows.select("day").distinct().collect()))
        return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))

    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(arriving)
    table, late = ops.repair_stream(stream, str(tmp_path / "out"), "ts", recompute)
    assert sorted((str(r["day"]), r["n"]) for r in table.collect()) == [("2024-01-01", 3), ("2024-01-02", 2), ("2024-01-03", 1)]
    assert [r["id"] for r in late.collect()] == [4]
    assert seen == [["2024-01-01", "2024-01-02"], ["2024-01-01", "2024-01-02"], ["2024-01-03"]]


def test_json_prices_are_numbers_under_known_keys(spark):
    rows = [(1, '{"a":[{"TotalFare":2000},{"grandTotal":"3000","totalprice":[{"fareAmount":2500.5}]}],"price":4000,"note":"\\"totalFare\\": 5000"}'), (2, '{"totalFare":true,"totalAmount":1499.9}'), (3, "broken"), (4, None), (5, json.dumps([{"totalFare": 1500 + i} for i in range(9)]))]
    got = sorted((r["id"], r["rank"], r["price"]) for r in text.json_prices(spark.createDataFrame(rows, "id int, p string"), "p", "id").collect())
    assert got == [(1, 0, 2000.0), (1, 1, 2500.5), *[(5, i, 1500.0 + i) for i in range(6)]]
    small = len(text.json_values(spark.createDataFrame(rows[:1], "id int, p string"), "p", "k")._jdf.queryExecution().executedPlan().toString())
    deep = spark.createDataFrame([(1, '{"x":' * 500 + '{"k":1}' + "}" * 500)], "id int, p string")
    assert [r["value"] for r in text.json_values(deep, "p", "k").collect()] == ["1"]
    assert len(text.json_values(deep, "p", "k")._jdf.queryExecution().executedPlan().toString()) == small


def test_order_stats(spark):
    rng = random.Random(9)
    values = {"a": [rng.choice([rng.uniform(-5, 5), float(rng.randint(0, 3)), 1e6]) for _ in range(501)], "b": [2.0], None: [1.0, 4.0]}
    df = spark.createDataFrame([(k, x) for k, v in values.items() for x in v] + [("c", None)], "k string, x double")
    ranks, quantiles = analytics.quantile_ranks(mid=0.5, q9=0.9)
    got = analytics.order_stats(df, ["k"], "x", {**ranks, "last": F.col("n") - 1, "beyond": F.col("n")})
    for r in got.select("k", "n", "last", "beyond", *[v.alias(c) for c, v in quantiles.items()]).collect():
        v = values[r["k"]]
        assert (r["n"], r["last"], r["beyond"]) == (len(v), max(v), None)
        assert r["mid"] == pytest.approx(np.quantile(v, 0.5)) and r["q9"] == pytest.approx(np.quantile(v, 0.9))
    assert got.count() == 3


def test_estimator_of_ones_own(spark):
    from pricewell.operators import cells

    cells.ESTIMATORS["MIDRANGE"] = lambda x, w: (F.min(x) + F.max(x)) / 2
    try:
        rows = [("r", dt.date(2024, 1, 1), 15, c, p, "AVAILABLE", "CARRIER_DIRECT", "BASIC", "ECONOMY") for c, p in (("A", 100.0), ("B", 104.0), ("C", 112.0))]
        quotes = spark.createDataFrame(rows, "route string, obs_date date, horizon int, carrier string, base_fare double, status string, feed_type string, fare_family string, cabin string")
        assert cells.representative_price(quotes, estimator="MIDRANGE").first()["price"] == 106.0
    finally:
        del cells.ESTIMATORS["MIDRANGE"]


def test_first_rows_are_found_without_a_sort(spark, tmp_path):
    routes = spark.createDataFrame([("A-B",)], "route_code string")
    (tmp_path / "m").mkdir()
    write(tmp_path / "m" / "part-00001.csv", "route_code,period,sector,fare\nA-B,2024-01,x,9\nA-B,2024-02,x,4\n")
    write(tmp_path / "m" / "part-00000.csv", "route_code,period,sector,fare\nA-B,2024-01,x,5\nA-B,2024-01,x,6\n")
    rows = files.read_monthly_fares(spark, str(tmp_path / "m"), routes)
    assert {(r["period"], r["fare"]) for r in rows.collect()} == {("2024-01", 5.0), ("2024-02", 4.0)}
    assert "HashAggregate(" in rows._jdf.queryExecution().executedPlan().toString()  # only the rows of splits are sorted


def test_monthly_fares_are_written_by_several_tasks(spark, monkeypatch):
    import os

    from pricewell.plans import source_queries

    folders = []
    monkeypatch.setattr(source_queries.f, "read_monthly_fares", lambda s, path, known: folders.append(path) or s.read.csv(path, header=True))
    source_queries.read_monthly_fares(spark, "/root/testdata/sf0.001")
    folder = folders[0].removeprefix("file:")
    assert len([x for x in os.listdir(folder) if x.endswith(".csv")]) > 1


def test_cards_need_one_sort_and_all_shuffle_partitions(spark):
    tokens = spark.range(400).selectExpr("id % 40 as page", "cast(id as string) as text", "cast(id % 7 as double) as x1", "cast(id as double) as y1", "cast(id % 7 + 5 as double) as x2", "cast(id + 5 as double) as y2")
    cards = text.cluster_tokens(tokens, "page")
    assert cards.agg(F.sum("tokens")).first()[0] == 400
    plan = cards.select("page", "card", "tokens")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "REPARTITION_BY_NUM" in plan


def test_many_lines_meet_orders_in_tasks_by_number(spark, monkeypatch):
    from pricewell.plans import views

    sf = "/root/testdata/sf0.001"
    few = views.fares(spark, sf)
    monkeypatch.setattr(views, "TASK_LINES", 200)
    many = views.fares(spark, sf)
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["union_feeds", "briefing", "digest", "index_now"])
def test_quotes_are_joined_once(spark, name):
    """What is read several times is read from a table; the orders are met before."""
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= (name == "digest")  # its fuel prices are another reading
