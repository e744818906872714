"""Column functions: normalisation, scores and lookups. Each returns a Column and runs inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
FEED_WEIGHTS = {"CARRIER_DIRECT": 1.0, "RPC_FALLBACK": 0.9, "PARTNER_API": 0.85, "OTA_AGGREGATOR": 0.7, "SYNTHETIC_BASELINE": 0.3}
FEED_SCORES = {"CARRIER_DIRECT": 100, "RPC_FALLBACK": 90, "PARTNER_API": 85, "OTA_AGGREGATOR": 70, "SYNTHETIC_BASELINE": 30}
METHOD_WEIGHTS = {"NETWORK_XHR": 0.98, "EMBEDDED": 0.97, "NETWORK": 0.96, "DOM_BROWSER": 0.95, "RPC": 0.94, "LLM": 0.93, "VLM": 0.90, "OCR": 0.85, "CALIBRATED_MODEL": 0.60, "SYNTHETIC": 0.50}
CARRIER_NAMES = {"INDIGO": "6E", "AIR INDIA EXPRESS": "IX", "AIR INDIA": "AI", "SPICEJET": "SG", "AKASA AIR": "QP", "AKASA": "QP", "VISTARA": "AI"}
HORIZONS = [1, 7, 14, 15, 30, 45]


def lookup(c: Column, table: dict, default) -> Column:
    """The table's value for an upper-cased key, else ``default``; null has none."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.upper(c) == k, v).otherwise(out)
    return out


def money(c: Column, digits: int = 2) -> Column:
    """Rounded half up to ``digits`` after the noise of binary fractions is gone: 583.8449999999999 is 583.845 and gives 583.85."""
    return F.round(F.round(c, 8), digits)


def feed_weight(c: Column) -> Column:
    return lookup(c, FEED_WEIGHTS, 0.3)


def feed_score(c: Column) -> Column:
    return lookup(c, FEED_SCORES, 30)


def method_weight(c: Column) -> Column:
    return lookup(c, METHOD_WEIGHTS, 0.5)


def bucket_horizon(days: Column) -> Column:
    """The days themselves if they are a horizon, else the bucket they are near to."""
    return F.when(days.isin(HORIZONS), days).when(days <= 2, 1).when(days <= 10, 7).when(days <= 20, 14).when(days <= 37, 30).when(days.isNotNull(), 45).cast("int")


def confidence(quality: Column, method: Column, agreement: Column) -> Column:
    """Quality x trust in the method x (0.95 + 0.1 x agreement), within 0 and 100, rounded to 2."""
    between = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(hi), c.cast("double")))
    return F.round(between(between(quality, 100.0) * method_weight(method) * (0.95 + 0.10 * between(agreement, 1.0)), 100.0), 2)


def confidence_band(score: Column, high: float = 90.0, medium: float = 70.0) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def minutes_of_day(c: Column) -> Column:
    """HH:MM as minutes; -1 if malformed."""
    h, m = (F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*([0-9]{1,2}):([0-9]{2})", i) for i in (1, 2))
    ok = (h != "") & (h.try_cast("int") < 24) & (m.try_cast("int") < 60)
    return F.when(ok, h.try_cast("int") * 60 + m.try_cast("int")).otherwise(-1)


def carrier_code(name: Column, default: str = "6E") -> Column:
    """IATA code of a carrier's name by the first known name it contains; longer names come before those they contain."""
    out = F.lit(default)
    for known, code in reversed(CARRIER_NAMES.items()):
        out = F.when(F.upper(name).contains(known), code).otherwise(out)
    return out


def canonical_flight(raw: Column, carrier: Column | None = None) -> Column:
    """``CC-NNN`` from the many ways to write a flight; number 101 and carrier 6E where none is given."""
    text = F.upper(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))
    given = F.nullif(F.upper(F.trim(F.coalesce(carrier, F.lit("")))), F.lit("")) if carrier is not None else F.lit(None).cast("string")
    named = F.lit(None).cast("string")
    bare = text
    for known, code in reversed(CARRIER_NAMES.items()):
        if known != "VISTARA":
            named = F.when(text.contains(known), code).otherwise(named)
            bare = F.when(text.contains(known) & given.isNull(), F.trim(F.replace(text, F.lit(known), F.lit("")))).otherwise(bare)
    code = F.coalesce(given, named)
    first = F.regexp_extract(bare, r"^([^- ]*)\s*[- ]", 1)
    joined = F.regexp_extract(bare, r"^([A-Z0-9]{2})([0-9]+)$", 1)
    digits = bare.rlike("^[0-9]+$")
    parted = bare.rlike("[- ]")
    behind = F.when(parted, F.regexp_extract(bare, r"[- ](.*)$", 1)).when(code.isNotNull() & bare.startswith(code), bare.substr(F.length(code) + 1, F.lit(99))).otherwise(F.when(joined != "", F.regexp_extract(bare, r"^[A-Z0-9]{2}([0-9]+)$", 1)).otherwise(bare))
    number = F.when(digits, bare).otherwise(F.coalesce(F.nullif(F.regexp_extract(behind, "([0-9]+)", 1), F.lit("")), F.lit("101")))
    prefix = F.coalesce(code, F.when(digits, None).when(parted, F.nullif(F.trim(first), F.lit(""))).otherwise(F.nullif(joined, F.lit(""))), F.lit("6E"))
    return F.concat(prefix, F.lit("-"), number)


def is_synthetic(feed: Column, method: Column) -> Column:
    return F.coalesce(feed.isin("CALIBRATED_BASELINE", "SYNTHETIC_BASELINE"), F.lit(False)) | F.coalesce(method == "CALIBRATED_MODEL", F.lit(False))


def severity(z: Column, inner: Column, outer: Column) -> Column:
    return F.when((F.abs(z) >= 5.0) | outer, "SEVERE").when(F.abs(z) >= 3.5, "MODERATE").when((F.abs(z) >= 2.5) | inner, "LOW").otherwise("NONE")


def inner_quantiles(p10: Column, p50: Column, p90: Column) -> tuple[Column, Column]:
    """p25 and p75 between the outer quantiles and the median."""
    return p10 + 0.33 * (p50 - p10), p50 + 0.67 * (p90 - p50)


def rule_when(rules: list[tuple[Column, object]], default) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(default) if not isinstance(default, Column) else default
    for when, value in reversed(rules):
        out = F.when(when, value).otherwise(out)
    return out
