"""Queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
NAMES = [
    "cell_report", "laspeyres", "jackknife", "bootstrap_index", "bootstrap_route", "daily_index", "index_range", "core_index", "dual_series",
    "leading_indicator", "briefing", "missing_variance", "platform_markup", "digest", "json_values", "targets", "breaker_state", "unexpected",
    "carrier_index", "weighted_median", "corridor_volatility", "hhi", "canonical_price", "match_nearest", "reconcile", "source_pair_audit",
    "robust_scores", "escalate", "classify_elevation", "lead_lag", "seasonal_trend", "forecast_accuracy", "normalize_quotes", "score_quality",
    "stream_window_stats", "stream_sessions", "flatten_offers", "active_on", "index_now", "asof_join", "forecast_features", "policy_signal",
    "fare_benchmark", "validation_summary", "live_series_weekly", "cohort_correlation", "carrier_escalation", "late_repair", "json_prices",
    "conformal", "lead_summary", "store_payloads", "read_benchmark", "read_monthly_fares", "append_snapshot", "validate_records", "stream_enrich",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


def shown(v):
    if v is None or v != v:
        return "null"
    s = str(v)
    return s.removesuffix(" 00:00:00") if isinstance(v, object) and ":" in s else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else s


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = entry.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
