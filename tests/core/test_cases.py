"""Hand-computed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricewell.functions import columns as fn
from pricewell.operators import analytics as a
from pricewell.operators import cells as c
from pricewell.operators import clean
from pricewell.operators import index as ix
from pricewell.operators import joins as j
from pricewell.operators import text
from pricewell.operators import timeseries as t
from pricewell.sources import files

QUOTE = "cell int, carrier string, base_fare double, fare_family string, cabin string, status string, feed_type string"


def quotes(spark, rows):
    return spark.createDataFrame([(1, car, p, fam, "ECONOMY", st, feed) for car, p, fam, st, feed in rows], QUOTE)


def price(df, estimator="MEDIAN"):
    return c.representative_price(df, ["cell"], estimator=estimator).first()["price"]


B = [("6E", 4000.0, "BASIC", "AVAILABLE", "CARRIER_DIRECT"), ("AI", 4200.0, "BASIC", "AVAILABLE", "CARRIER_DIRECT"), ("SG", 3900.0, "BASIC", "AVAILABLE", "CARRIER_DIRECT")]


def test_flexi_and_sold_out_rows_change_nothing(spark):
    assert price(quotes(spark, B)) == 4000.0
    more = [("6E", 7100.0, "FLEXI", "AVAILABLE", "CARRIER_DIRECT"), ("AI", 9000.0, "FLEXI", "AVAILABLE", "CARRIER_DIRECT"), ("XX", 10.0, "BASIC", "SOLD_OUT", "CARRIER_DIRECT"), ("YY", None, "BASIC", "AVAILABLE", "CARRIER_DIRECT")]
    assert price(quotes(spark, B + more)) == 4000.0


def test_minima_and_waterfall(spark):
    rows = [("6E", p, "BASIC", "AVAILABLE", "CARRIER_DIRECT") for p in (4800.0, 3800.0, 5200.0)] + [("AI", p, "BASIC", "AVAILABLE", "CARRIER_DIRECT") for p in (4500.0, 4100.0)] + [("SG", 3900.0, "BASIC", "AVAILABLE", "CARRIER_DIRECT"), ("SG", 100.0, "BASIC", "AVAILABLE", "OTA_AGGREGATOR")]
    df = quotes(spark, rows)
    got = {r["carrier"]: (r["price"], r["quotes"]) for r in c.best_carrier_minima(df, ["cell"]).collect()}
    assert got == {"6E": (3800.0, 3), "AI": (4100.0, 2), "SG": (3900.0, 1)}
    assert price(df) == 3900.0
    slow = c.carrier_minima(c.waterfall(df, ["cell"]), ["cell"]).select("carrier", "price").collect()
    assert {r[0]: r[1] for r in slow} == {k: v[0] for k, v in got.items()}


def test_outliers(spark):
    rows = [(f"C{i}", p, "BASIC", "AVAILABLE", "CARRIER_DIRECT") for i, p in enumerate((100.0, 101.0, 99.0, 102.0, 98.0, 900.0))]
    r = c.cell_report(quotes(spark, rows), ["cell"]).first()
    assert (r["carriers"], r["carriers_after"], r["outlier_method"], r["removed"], r["max_price"]) == (6, 5, "mad", 1, 102.0)


def two_routes(spark, pb=120.0):
    prices = spark.createDataFrame([("A", 15, "d", 100.0, 100.0), ("B", 15, "d", pb, 100.0)], "route string, horizon int, obs_date string, price double, base double")
    return prices, spark.createDataFrame([("A", 0.6), ("B", 0.4)], "route string, weight double")


def test_laspeyres(spark):
    p, w = two_routes(spark)
    assert ix.laspeyres(p, w).first()["index_value"] == 108.0
    assert sorted(r["contribution"] for r in ix.route_relatives(p, w).collect()) == [48.0, 60.0]
    r = ix.laspeyres(p.where("route = 'A'"), w).first()
    assert (r["index_value"], r["coverage"], r["low_coverage"]) == (100.0, 60.0, True)
    assert ix.laspeyres(p.where("false"), w).count() == 0


def test_jackknife_against_the_definition(spark):
    import math
    import random

    rng = random.Random(1)
    rows = [(f"R{i}", 15, "d", rng.uniform(50, 200), rng.uniform(50, 200)) for i in range(9)]
    wt = [(f"R{i}", rng.random()) for i in range(9)]
    idx = lambda rs: 100 * sum(dict(wt)[r[0]] * r[3] / r[4] for r in rs) / sum(dict(wt)[r[0]] for r in rs)
    full, n = idx(rows), len(rows)
    pseudo = [n * full - (n - 1) * idx([x for x in rows if x is not r]) for r in rows]
    m = sum(pseudo) / n
    se = math.sqrt(sum((x - m) ** 2 for x in pseudo) / (n * (n - 1)))
    got = ix.jackknife(spark.createDataFrame(rows, "route string, horizon int, obs_date string, price double, base double"), spark.createDataFrame(wt, "route string, weight double")).first()
    assert got["standard_error"] == pytest.approx(se, abs=1e-3) and got["index_value"] == pytest.approx(full, abs=1e-3)
    one = ix.jackknife(two_routes(spark)[0].where("route = 'A'"), two_routes(spark)[1]).first()
    assert one["standard_error"] is None


def test_bootstrap_of_a_constant_cell(spark):
    cells = spark.createDataFrame([("A", 15, "d", f"C{i}", 1000.0) for i in range(3)], "route string, horizon int, obs_date string, carrier string, price double")
    base = spark.createDataFrame([("A", 15, 1000.0)], "route string, horizon int, base double")
    r = ix.bootstrap_index(cells, two_routes(spark)[1], base, ["route", "obs_date", "horizon"], ix.SERIES, 20).first()
    assert (r["standard_error"], r["ci_lower"], r["ci_upper"]) == (0.0, 100.0, 100.0)


@pytest.mark.parametrize(("raw", "carrier", "want"), [("6E-205", None, "6E-205"), ("6E 532", None, "6E-532"), ("205", "6E", "6E-205"), ("SG-8169", None, "SG-8169"), ("IndiGo 205", None, "6E-205"), ("6e205", None, "6E-205"), (None, None, "6E-101"), ("Air India Express 77", None, "IX-77")])
def test_canonical_flight(spark, raw, carrier, want):
    df = spark.createDataFrame([(raw, carrier)], "r string, c string")
    assert df.select(fn.canonical_flight(F.col("r"), F.col("c"))).first()[0] == want


def test_hhi(spark):
    rows = [("R", "A")] * 4 + [("R", "B")] * 3 + [("R", "C")] + [("M", "A")] * 5
    got = {r["route"]: r["hhi"] for r in a.hhi(spark.createDataFrame(rows, "route string, carrier string"), "route", "carrier").collect()}
    assert got == {"R": 4062.5, "M": 10000.0}


def days(spark, values, start=dt.date(2026, 8, 3)):
    return spark.createDataFrame([("s", start + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "series string, day date, value double")


def test_weekly_and_monthly(spark):
    r = a.weekly_geomean(days(spark, [100, 102, 104, 106, 108]), ["series"], "day", "value").first()
    assert r["week"] == "2026-W32" and r["value"] == pytest.approx(103.96, abs=0.01) and r["n"] == 5
    assert a.monthly_mean(days(spark, [100, 105, 110]), ["series"], "day", "value").first()["value"] == 105.0


def test_anomaly(spark):
    s = t.robust_scores(days(spark, [100, 101, 102, 101, 100, 160, 101, 102]), ["series"], "day", "value")
    hits = s.where("severity <> 'NONE'").collect()
    assert len(hits) == 1 and hits[0]["severity"] == "SEVERE" and abs(hits[0]["z"]) >= 5 and hits[0]["median"] == 101.0
    e = t.escalate(s.where("severity <> 'NONE'"), ["series"], "day").first()
    assert e["escalated"] and e["last_run"] == 1


def test_elevation(spark):
    up = t.classify_elevation(days(spark, [100] * 20 + [120, 118, 105]), ["series"], "day", "value").first()
    assert up["mode"] == "TRANSIENT" and up["persistence"] == 3
    long = t.classify_elevation(days(spark, [100] * 30 + [130] * 25), ["series"], "day", "value", breadth=4).first()
    assert long["mode"] == "STRUCTURAL"


def test_windows(spark):
    got = ix.moving_avg(days(spark, range(1, 8)), ["series"], "day", "value").orderBy("day").collect()
    assert [r["moving_avg"] for r in got] == [None] * 4 + [3.0, 3.5, 4.0]
    lag = ix.exact_lag(days(spark, [1, 2, 3]), ["series"], "day", "value", 1, "l").orderBy("day").collect()
    assert [r["l"] for r in lag] == [None, 1.0, 2.0]


def test_lead_lag_finds_the_lag(spark):
    import math

    v = [math.sin(i * 1.3) + i % 3 for i in range(12)]
    rows = [("k", i, v[i + 1], v[i]) for i in range(11)]
    got = t.lead_lag(spark.createDataFrame(rows, "k string, w int, a double, b double"), "a", "b", "w", ["k"]).where("best").first()
    assert got["lag"] == 1 and got["r"] > 0.9


def test_replace_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    new = spark.createDataFrame([(None, 9), ("d", 4)], "k string, v int")
    once = j.replace_by_key(old, new, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, j.replace_by_key(once, new, ["k"]).collect()), key=str) == sorted([("a", 1), ("c", 3), (None, 9), ("d", 4)], key=str)


def test_reconcile(spark):
    q = lambda rows, i: spark.createDataFrame(rows, f"carrier string, flight string, minutes int, price double, {i} long")
    direct = q([("6E", "205", 480, 5000.0, 1), ("6E", "300", 900, 4000.0, 2), ("AI", "1", -1, 100.0, 3)], "lid")
    fall = q([("6E", "205", 700, 5350.0, 11), ("6E", "x", 920, 4010.0, 12), ("AI", "y", 10, 1.0, 13)], "rid")
    got = {(r["lid"], r["rid"]): (r["status"], r["difference"]) for r in j.reconcile(direct, fall, ["carrier"], "minutes", "price", "flight").collect()}
    assert got == {(1, 11): ("AGGREGATOR_MARKUP", 350.0), (2, 12): ("EXACT_PARITY", 10.0), (None, 13): ("FALLBACK_RPC_USED", None)}


def test_matches_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    side = lambda n, span: [(rng.randrange(2), rng.choice(["a", "b", "c", None, *"defghijk"]), rng.randrange(-1, span), i) for i in rng.sample(range(1000), n)]
    for a, b, exact in [(side(150, 90), side(130, 90), "x"), (side(60, 400), side(70, 400), None), ([(0, None, 5, i) for i in range(100)], [(0, None, 5, i) for i in range(100)], "x")]:
        pairs = [(0, 0, l[3], r[3]) for l in a for r in b if exact and l[0] == r[0] and l[1] and l[1] == r[1]]
        pairs += [(1, abs(l[2] - r[2]), l[3], r[3]) for l in a for r in b if l[0] == r[0] and min(l[2], r[2]) >= 0 and abs(l[2] - r[2]) <= 35]
        want = []
        while pairs:  # pairs that are each other's best, until there is none
            best_l, best_r = {}, {}
            for k, d, l, r in pairs:
                best_l[l] = min(best_l.get(l, (9,)), (k, d, r))
                best_r[r] = min(best_r.get(r, (9,)), (k, d, l))
            new = {(l, r, d) for k, d, l, r in pairs if best_l[l] == (k, d, r) and best_r[r] == (k, d, l)}
            want += new
            gone_l, gone_r = {x[0] for x in new}, {x[1] for x in new}
            pairs = [x for x in pairs if x[2] not in gone_l and x[3] not in gone_r]
        q = lambda rows, i: spark.createDataFrame(rows, f"k int, x string, minutes int, {i} long")
        got = j.match_nearest(q(a, "lid"), q(b, "rid"), ["k"], "minutes", exact=exact).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert len(got) == 100


def test_matches_with_odd_ids_and_times(spark):
    big = 2**60
    q = lambda rows, i: spark.createDataFrame(rows, f"k int, x double, minutes double, {i} long")
    left = q([(1, None, 10.0, big + 1), (1, float("nan"), float("nan"), big + 2), (None, 1.0, 5.0, big + 3), (1, 7.0, None, big + 4), (1, None, 12.0, big + 5)], "lid")
    right = q([(1, None, 12.0, big + 7), (1, float("nan"), float("nan"), big + 8), (None, 1.0, 5.0, big + 9), (1, 7.0, -1.0, big + 11), (1, None, 45.0, big + 13)], "rid")
    assert sorted(map(tuple, j.match_nearest(left, right, ["k"], "minutes", exact="x").collect())) == [(big + 1, big + 13, 35.0), (big + 4, big + 11, 0.0), (big + 5, big + 7, 0.0)]
    assert j.match_nearest(left.limit(0), right, ["k"], "minutes", exact="x").count() == 0


def test_reconcile_with_direct_only(spark):
    q = lambda rows, i: spark.createDataFrame(rows, f"carrier string, flight string, minutes int, price double, {i} long")
    direct = q([("6E", "205", 480, 5000.0, 1), ("AI", "1", -1, 100.0, 3)], "lid")
    audits = j.reconcile(direct, q([("6E", "205", 700, 5350.0, 11), ("AI", "y", 10, 1.0, 13)], "rid"), ["carrier"], "minutes", "price", "flight", direct_only=True)
    assert {(r["lid"], r["rid"], r["status"]) for r in audits.collect()} == {(1, 11, "AGGREGATOR_MARKUP"), (None, 13, "FALLBACK_RPC_USED"), (3, None, "DIRECT_ONLY")}
    assert tuple(j.parity_report(audits).first()) == (1, 0.0)


def test_quality_and_drift(spark):
    cols = "origin string, destination string, carrier string, availability_status string, total_fare double, base_fare double, fuel_surcharge double, tax_amount double, development_fee double, convenience_fee double, other_fee double, source_error boolean, is_duplicate boolean"
    row = lambda **k: tuple((dict(origin="DEL", destination="BOM", carrier="6E", availability_status=None, total_fare=5000.0, base_fare=4750.0, fuel_surcharge=0.0, tax_amount=250.0, development_fee=None, convenience_fee=0.0, other_fee=0.0, source_error=False, is_duplicate=False) | k).values())
    cases = [({}, "ACCEPT"), ({"destination": "DEL"}, "REJECT"), ({"availability_status": "sold_out"}, "MISSING_FOR_INDEX"), ({"base_fare": None}, "REJECT"), ({"is_duplicate": True}, "DEDUPLICATED"), ({"tax_amount": 240.0}, "ACCEPT_WITH_WARNING"), ({"tax_amount": 100.0}, "REJECT"), ({"total_fare": 900.0, "base_fare": 650.0}, "REVIEW"), ({"source_error": True}, "SOURCE_ERROR")]
    got = clean.score_quality(spark.createDataFrame([row(**k) for k, _ in cases], cols).coalesce(1)).collect()
    assert [r["quality_status"] for r in got] == [w for _, w in cases]
    good = {"flight_number": "6E-205", "origin_airport": "DEL", "destination_airport": "BOM", "travel_date": "2026-08-01", "total_fare": "5000"}
    bad = good | {"origin_airport": "del", "total_fare": "x", "odd": "1"}
    recs = clean.validate_records(spark.createDataFrame([(good,), (bad,)], "fields map<string,string>"))
    assert sorted(len(r["issues"]) for r in recs.collect()) == [0, 3]


def test_files(spark, tmp_path):
    (tmp_path / "tax.csv").write_text("effective_from,effective_to,tax_type,rate,source\n2026-01-01,,VAT,25.0,x\n2025-01-01,2025-12-31,VAT,20,x\n")
    assert {str(r["effective_to"]) for r in files.read_tax(spark, str(tmp_path / "tax.csv")).collect()} == {"None", "2025-12-31"}
    rows = spark.createDataFrame([("a", dt.datetime(2026, 1, 2)), ("a", dt.datetime(2026, 1, 3)), ("b", dt.datetime(2026, 1, 2))], "content string, ts timestamp")
    out = str(tmp_path / "store")
    files.store_payloads(rows, out)
    assert spark.read.parquet(out).count() == 2
    files.store_payloads(rows, out, old=spark.read.parquet(out).cache())
    assert spark.read.parquet(out).count() == 2


def test_cards(spark):
    df = spark.createDataFrame([("DEL - BOM IndiGo 6E-205 06:30 08:45 2h 15m Non-stop ₹5,432 or INR 6000", dt.date(2026, 12, 20)), ("", None)], "text string, ref date")
    r = text.card_fields(df, "text").first()
    assert (r["price"], r["origin"], r["destination"], r["flight"], r["departs"], r["arrives"], r["stops"], r["minutes"]) == (5432.0, "DEL", "BOM", "6E-205", "06:30", "08:45", 0, 135)
    d = spark.createDataFrame([("go 2026-12-24 back 3 Jan", dt.date(2026, 12, 20))], "text string, ref date")
    r = text.card_dates(d, "text", "ref").first()
    assert (r["travel_date"], r["return_date"]) == (dt.date(2026, 12, 24), dt.date(2027, 1, 3))
    tokens = spark.createDataFrame([(1, w, float(x), float(y), x + 10.0, y + 10.0) for w, x, y in [("b", 50, 0), ("a", 0, 0), ("c", 0, 100), ("d", 0, 112)]], "page int, text string, x1 double, y1 double, x2 double, y2 double")
    assert [r["text"] for r in text.cluster_tokens(tokens, "page").orderBy("card").collect()] == ["a b", "c d"]


def test_nearest_slot_makes_no_pairs_of_quotes(spark):
    """A hot slot: 3,000 quotes of a side at two times. Slots meet, not quotes; the results are those of brute force."""
    import random

    rng = random.Random(3)
    left = [(rng.choice("ab"), float(rng.randrange(0, 300)) / rng.choice([1, 4]), rng.randrange(90, 130) * 1.0, i) for i in range(300)]
    right = [(rng.choice("ab"), float(rng.randrange(0, 300)) / rng.choice([1, 4]), rng.randrange(90, 130) * 1.0, i) for i in range(60)]
    left += [("hot", 600.0, 100.0, 1000 + i) for i in range(3000)] + [(None, 5.0, 1.0, 9001), ("a", -1.0, 1.0, 9002), ("a", None, 1.0, 9003), ("a", 900.0, 1.0, 9004)]
    right += [("hot", 600.0 + 25 * (i % 2), 80.0 + i, 1000 + i) for i in range(3000)]
    make = lambda rows, i: spark.createDataFrame(rows, f"carrier string, minutes double, price double, {i} long")
    found = j.nearest_min(make(left, "lid"), make(right, "rid"), ["carrier"], "minutes", "price")
    want = {}
    for c, m, p, i in left:
        near = [(abs(m - rm), rp) for rc, rm, rp, _ in (right if c != "hot" else right[60:62]) if c is not None and m is not None and m >= 0 and rc == c and abs(m - rm) <= 25]
        if near:
            delta, rp = min(near)
            want[i] = (delta, rp, "MATCH" if abs((p - rp) / rp) <= 0.15 else "HIGHER" if p > rp else "LOWER")
    assert {r["lid"]: (r["delta"], r["price"], r["label"]) for r in found.collect()} == want and len(want) > 3000
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "min(struct(" not in plan and "SortAggregate" not in plan  # no pair is made that would be cut down afterwards
