"""Cleaning of quotes: normalisation, quality rules, decomposition, confidence, schema drift and source rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.columns import bucket_horizon, confidence, confidence_band, is_synthetic, rule_when

# Fixed values.
FEES = ["fuel_surcharge", "tax_amount", "development_fee", "convenience_fee", "other_fee"]
UNAVAILABLE = ["SOLD_OUT", "CANCELLED", "UNAVAILABLE"]
REQUIRED = ["flight_number", "origin_airport", "destination_airport", "travel_date", "total_fare"]
KNOWN = [*REQUIRED, "carrier_code", "carrier_name", "departure_time", "arrival_time", "stops", "advance_purchase_days", "cabin_class", "fare_family", "base_fare", *FEES, "currency", "availability_status", "feed_type", "extraction_method", "source"]
CONDITIONAL_LICENSES = ["RESEARCH_EXEMPTION", "LIMITED_USE", "VERIFIED_PERMITTED", "AGGREGATOR_RESEARCH"]
TRANSITIONS = [
    ("DISCOVERED", "REVIEW_REQUIRED"), ("DISCOVERED", "DISABLED"), ("REVIEW_REQUIRED", "APPROVED"), ("REVIEW_REQUIRED", "DISABLED"), ("APPROVED", "ACTIVE"), ("APPROVED", "DISABLED"),
    ("ACTIVE", "DEGRADED"), ("ACTIVE", "DOWN"), ("ACTIVE", "DISABLED"), ("DEGRADED", "ACTIVE"), ("DEGRADED", "DOWN"), ("DEGRADED", "DISABLED"), ("DOWN", "REVIEW_REQUIRED"), ("DOWN", "DISABLED"), ("DISABLED", "REVIEW_REQUIRED"), ("DISABLED", "APPROVED"),
]


def _upper(c: str, default: str = "") -> Column:
    return F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(default))))


def null_unavailable(df: DataFrame, status: str = "availability_status") -> DataFrame:
    """Sold-out, cancelled and unavailable flights have no fares and no fees."""
    gone = F.coalesce(F.upper(F.col(status)).isin(UNAVAILABLE), F.lit(False))
    out = {c: F.when(~gone, F.col(c)) for c in ("base_fare", "total_fare")} | {c: F.when(gone, 0.0).otherwise(F.col(c)) for c in FEES}
    return df.withColumns(out)


def rebalance_components(df: DataFrame, tol: float = 5.0, cap: float = 50.0) -> DataFrame:
    """A difference between total and components over ``tol``, up to ``cap``, goes to other_fee."""
    parts = F.col("base_fare")
    for c in FEES:
        parts = parts + F.coalesce(F.col(c), F.lit(0.0))
    gap = F.col("total_fare") - parts
    return df.withColumn("other_fee", F.when((F.abs(gap) > tol) & (F.abs(gap) <= cap), F.coalesce("other_fee", F.lit(0.0)) + gap).otherwise(F.col("other_fee")))


def normalize_quotes(df: DataFrame) -> DataFrame:
    """Trimmed, upper-cased and typed quotes with defaults; ``reject_reason`` says why a quote can't be used, else null."""
    total = F.coalesce(F.col("total_fare").try_cast("double"), F.when(F.col("total_fare").isNull(), 0.0))
    status = _upper("availability_status", "AVAILABLE")
    rows = df.withColumns({c: _upper(c) for c in ("origin", "destination", "carrier", "flight_number")} | {
        "availability_status": F.when(status.isin("AVAILABLE", *UNAVAILABLE), status).otherwise("AVAILABLE"),
        "advance_purchase_days": bucket_horizon(F.coalesce(F.col("advance_purchase_days").try_cast("int"), F.lit(14))),
        "cabin_class": _upper("cabin_class", "ECONOMY"), "fare_family": _upper("fare_family", "BASIC"),
        "__bad": F.col("total_fare").isNotNull() & F.col("total_fare").try_cast("double").isNull(),
        "base_fare": F.coalesce(F.col("base_fare").try_cast("double"), total * 0.75), "tax_amount": F.coalesce(F.col("tax_amount").try_cast("double"), total * 0.05), "total_fare": total,
    } | {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in FEES if c != "tax_amount"})
    rows = rebalance_components(rows)
    rows = null_unavailable(rows.withColumns({c: F.round(c, 2) for c in ("base_fare", "total_fare", *FEES)}))
    reason = rule_when([
        ((F.col("origin") == "") | (F.col("destination") == "") | (F.col("origin") == F.col("destination")), "INVALID_ROUTE"), (F.col("carrier") == "", "MISSING_CARRIER"), (F.col("flight_number") == "", "MISSING_FLIGHT"),
        (F.col("availability_status") != "AVAILABLE", None), (F.col("__bad"), "NON_NUMERIC"), ((F.col("total_fare") < 0) | (F.col("base_fare") < 0), "NEGATIVE_PRICE"),
    ], F.lit(None).cast("string"))
    return rows.withColumn("reject_reason", reason).withColumn("route_code", F.concat_ws("-", "origin", "destination")).drop("__bad")


def score_quality(df: DataFrame, lo: float = 1200.0, hi: float = 60000.0) -> DataFrame:
    """Columns quality_score, quality_status and quality_reason by the first rule that holds."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    total, base = F.col("total_fare").try_cast("double"), F.col("base_fare").try_cast("double")
    gap = F.abs(total - (base + sum((F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in FEES), F.lit(0.0))))
    status = F.upper(F.coalesce("availability_status", F.lit("AVAILABLE")))
    rules = [
        (F.coalesce("source_error", F.lit(False)), (0.0, "SOURCE_ERROR", "source error")), (~has("origin") | ~has("destination") | (F.col("origin") == F.col("destination")), (0.0, "REJECT", "route")), (~has("carrier"), (0.0, "REJECT", "carrier")),
        (status.isin(UNAVAILABLE), (80.0, "MISSING_FOR_INDEX", "unavailable")), (F.col("total_fare").isNull() | F.col("base_fare").isNull(), (0.0, "REJECT", "missing fare")), (total.isNull() | base.isNull(), (0.0, "REJECT", "not a number")),
        ((total <= 0) | (base <= 0), (0.0, "REJECT", "not positive")), (F.coalesce("is_duplicate", F.lit(False)), (50.0, "DEDUPLICATED", "duplicate")), (gap > 50, (45.0, "REJECT", "components")), (gap > 5, (75.0, "ACCEPT_WITH_WARNING", "components")),
        (~total.between(lo, hi), (65.0, "REVIEW", "extreme price")),
    ]
    s = lambda v: F.struct(F.lit(v[0]).alias("s"), F.lit(v[1]).alias("t"), F.lit(v[2]).alias("r"))
    q = rule_when([(c, s(v)) for c, v in rules], s((98.0, "ACCEPT", None)))
    return df.withColumn("__q", q).withColumns({"quality_score": F.col("__q.s"), "quality_status": F.col("__q.t"), "quality_reason": F.col("__q.r")}).drop("__q")


def decompose_fare(df: DataFrame, total: str = "total_fare") -> DataFrame:
    """Estimated parts of a total fare: a fixed fee, a convenience fee for fallback feeds, 5 % tax and 15 % fuel of the rest. Parts from the source win."""
    real = F.coalesce((F.col("extraction_method") == "NETWORK_API") & F.col("base_fare").isNotNull(), F.lit(False))
    conv = F.when(F.col("feed_type") == "RPC_FALLBACK", 299.0).otherwise(0.0)
    net = F.greatest(F.lit(500.0), F.col(total) - 350.0 - conv)
    tax, fuel = F.round(net * 0.05, 2), F.round(net * 0.15, 2)
    pick = lambda c, e: F.when(real, F.round(F.coalesce(F.col(c), F.lit(0.0)), 2)).otherwise(e)
    return df.withColumns({"base_fare": pick("base_fare", F.round(net - tax - fuel, 2)), "fuel_surcharge": pick("fuel_surcharge", fuel), "tax_amount": pick("tax_amount", tax), "development_fee": pick("development_fee", F.lit(350.0)), "convenience_fee": pick("convenience_fee", conv)})


def resolve_source(df: DataFrame, sources: DataFrame, direct_id: int, fallback_id: int) -> DataFrame:
    """Column ``resolved``: the direct source, an aggregator's own id or that of its name, else the fallback."""
    named = sources.select("source_name", F.col("source_id").alias("__named"))
    out = df.join(named, "source_name", "left")
    agg = F.coalesce(F.nullif(F.col("source_id"), F.lit(0)), F.col("__named"), F.lit(fallback_id))
    feed = F.coalesce("feed_type", F.lit("CARRIER_DIRECT"))
    return out.withColumn("resolved", F.when(feed == "CARRIER_DIRECT", direct_id).when(feed.isin("OTA_AGGREGATOR", "PARTNER_API"), agg).otherwise(fallback_id)).drop("__named")


def flag_carrier_min(df: DataFrame, keys: list[str], carrier: str, x: str, ties: list[str]) -> DataFrame:
    """Exactly one cheapest positive fare per carrier of a batch is flagged; ``ties`` break ties."""
    first = F.row_number().over(Window.partitionBy(*keys, carrier).orderBy(F.when(F.col(x) > 0, F.col(x)).asc_nulls_last(), *ties))
    return df.withColumn("is_carrier_min_fare", (first == 1) & F.coalesce(F.col(x) > 0, F.lit(False)))


def flag_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("is_duplicate", F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)


def unexpected(keys: Column, known: list[str] = KNOWN) -> Column:
    """The keys that are not known, in order."""
    return F.array_sort(F.array_except(keys, F.array(*map(F.lit, known))))


def validate_records(df: DataFrame, fields: str = "fields", known: list[str] = KNOWN) -> DataFrame:
    """Column ``issues``: what is wrong with a record given as map<string,string>."""
    get = lambda k: F.element_at(fields, k)
    value = lambda k: F.coalesce(get(k), F.lit(""))
    missing = [F.when(value(k) == "", F.lit(f"missing_required_field:{k}")) for k in REQUIRED]
    shape = lambda k, rx, name: F.when((value(k) != "") & ~value(k).rlike(rx), F.concat(F.lit(name), get(k)))
    total, base = get("total_fare").try_cast("double"), get("base_fare").try_cast("double")
    extra = unexpected(F.map_keys(fields), known)
    checks = [
        *missing, *[shape(k, "^[A-Z]{3}$", f"bad_iata:{k}=") for k in ("origin_airport", "destination_airport")], shape("travel_date", r"^\d{4}-\d{2}-\d{2}$", "bad_date:travel_date="), shape("flight_number", r"^[A-Z0-9]{2}-\d{3,4}$", "bad_flight_number:"),
        F.when((value("total_fare") != "") & total.isNull(), F.concat(F.lit("non_numeric:total_fare="), get("total_fare"))), F.when(~((total > 0) & (total <= 200000)), F.concat(F.lit("out_of_range:total_fare="), get("total_fare"))),
        F.when(base > total, F.lit("base_fare_gt_total")), F.when(F.size(extra) > 0, F.concat(F.lit("unexpected_keys:"), F.array_join(extra, ","))),
    ]
    return df.withColumn("issues", F.array_compact(F.array(*checks)))


def drift_report(checked: DataFrame, samples: int = 10) -> DataFrame:
    """One row: checked, clean, drift, is_drifting, collapsed. ``drift_samples`` gives the first bad records."""
    bad = F.size("issues") > 0
    agg = checked.agg(F.count(F.lit(1)).alias("records_checked"), F.count_if(~bad).alias("clean_count"), F.count_if(bad).alias("drift_count"))
    limit = F.greatest(F.lit(2), F.floor(F.col("records_checked") * 0.1))
    return agg.withColumn("is_drifting", F.col("drift_count") > limit).withColumn("collapsed", (F.col("records_checked") > 0) & (F.col("drift_count") == F.col("records_checked")))


def drift_samples(checked: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    return checked.where(F.size("issues") > 0).orderBy(*order).limit(n)


def agreement(df: DataFrame, keys: list[str], x: str, tol: float = 0.10) -> DataFrame:
    """Column ``agreement``: share of the group's quotes within ``tol`` of its median, rounded to 4."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__m", F.median(F.when(F.col(x) > 0, F.col(x))).over(w))
    near = F.when(F.col(x) > 0, (F.abs(F.col(x) - F.col("__m")) / F.col("__m") <= tol).cast("double"))
    return rows.withColumn("agreement", F.coalesce(F.round(F.avg(near).over(w), 4), F.lit(0.0))).drop("__m")


def score_quotes(df: DataFrame, keys: list[str], x: str, quality: Column, method: Column) -> DataFrame:
    out = agreement(df, keys, x).withColumn("confidence", confidence(quality, method, F.col("agreement")))
    return out.withColumn("band", confidence_band(F.col("confidence")))


def can_collect(df: DataFrame) -> DataFrame:
    return df.withColumn("can_collect", blocked_column() == "")


def blocked_column() -> Column:
    mode, licence = F.upper(F.coalesce("access_mode", F.lit("PUBLIC"))), F.upper(F.coalesce("license_status", F.lit("")))
    return rule_when([
        (~F.coalesce("enabled", F.lit(False)), "disabled"), (~F.coalesce(F.col("permission_status") == "APPROVED", F.lit(False)), "permission"), (F.coalesce(F.col("health_status").isin("DOWN", "DISABLED"), F.lit(False)), "health"),
        ((mode == "CONDITIONAL") & ~licence.isin(CONDITIONAL_LICENSES), "license"), ((mode == "PARTNER_ONLY") & (licence != "PARTNER_AGREEMENT"), "partner agreement"),
    ], "")


def blocked_reason(df: DataFrame) -> DataFrame:
    return df.withColumn("blocked_reason", blocked_column())


def check_transitions(df: DataFrame, current: str, target: str, allowed: list[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """Column ``allowed``: whether the state machine has the change."""
    table = df.sparkSession.createDataFrame(allowed, "__from string, __to string").withColumn("__ok", F.lit(True))
    return df.join(F.broadcast(table), (F.col(current) == F.col("__from")) & (F.col(target) == F.col("__to")), "left").withColumn("allowed", F.col("__ok").isNotNull()).drop("__from", "__to", "__ok")  # a fixed list


def cleaned_fares(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "has_full_breakdown": F.col("base_fare").isNotNull() & F.col("tax_amount").isNotNull() & F.col("fuel_surcharge").isNotNull(), "taxes": F.coalesce("tax_amount", F.lit(0.0)) + F.coalesce("fuel_surcharge", F.lit(0.0)),
        "is_nonstop": F.coalesce("stops", F.lit(0)) == 0, "is_outlier": F.coalesce(F.col("quality_status") == "REVIEW", F.lit(False)), "is_imputed": is_synthetic(F.col("feed_type"), F.col("extraction_method")),
    })
