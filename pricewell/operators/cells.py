"""Price cells: from quotes to one representative price per cell. A cell is a set of key columns; all cells are done in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.columns import feed_score, feed_weight, money

CELL = ["route", "obs_date", "horizon"]


def where_available(df: DataFrame, price: str = "base_fare", status: str = "status") -> DataFrame:
    """Available quotes (the default status) with a positive price; prices that are no number are out."""
    return df.where((F.upper(F.coalesce(status, F.lit("AVAILABLE"))) == "AVAILABLE") & (F.col(price).try_cast("double") > 0))


def where_product(df: DataFrame, cabin: str | None = "ECONOMY", family: str | None = "BASIC") -> DataFrame:
    """One cabin and fare family; null means the default. None asks for nothing."""
    if cabin:
        df = df.where(F.upper(F.coalesce("cabin", F.lit("ECONOMY"))) == cabin)
    return df.where(F.upper(F.coalesce("fare_family", F.lit("BASIC"))) == family) if family else df


def waterfall(df: DataFrame, cell: list[str] = CELL, carrier: str = "carrier", weight: Column | None = None) -> DataFrame:
    """Per carrier of a cell only the quotes of its best feed."""
    w = feed_weight(F.col("feed_type")) if weight is None else weight
    best = F.max(w).over(Window.partitionBy(*cell, carrier))
    return df.withColumn("__w", w).withColumn("__best", best).where("__w = __best").drop("__w", "__best")


def carrier_minima(df: DataFrame, cell: list[str] = CELL, carrier: str = "carrier", price: str = "base_fare") -> DataFrame:
    """One row per cell and carrier: its least price, the feed of that quote (the best on ties) and how many quotes it had."""
    first = F.min(F.struct(F.col(price).alias("price"), (-feed_weight(F.col("feed_type"))).alias("w"), F.col("feed_type").alias("feed_type")))
    return df.groupBy(*cell, carrier).agg(first.alias("m"), F.count(F.lit(1)).alias("quotes")).select(*cell, carrier, F.col("m.price").alias("price"), F.col("m.feed_type").alias("feed_type"), "quotes")


def best_carrier_minima(df: DataFrame, cell: list[str] = CELL, carrier: str = "carrier", price: str = "base_fare") -> DataFrame:
    """``waterfall`` and ``carrier_minima`` in one grouped pass: the least price of the best feed. No window, so no sort."""
    w = feed_weight(F.col("feed_type"))
    best = F.min(F.struct((-w).alias("w"), F.col(price).alias("price"), F.col("feed_type").alias("feed_type")))
    per_feed = df.groupBy(*cell, carrier, "feed_type").agg(F.min(price).alias(price), F.count(F.lit(1)).alias("n"))
    top = per_feed.groupBy(*cell, carrier).agg(best.alias("m"), F.max_by("n", F.struct(w, -F.col(price))).alias("quotes"))
    return top.select(*cell, carrier, F.col("m.price").alias("price"), F.col("m.feed_type").alias("feed_type"), "quotes")


def drop_mad(df: DataFrame, cell: list[str] = CELL, x: str = "price", k: float = 3.5) -> DataFrame:
    """Without the rows whose robust z is over ``k``; cells of under 3 rows or without spread stay whole."""
    return _mad(df, cell, x, k).where("__mad").drop("__mad", "__n")


def _mad(df: DataFrame, cell: list[str], x: str, k: float) -> DataFrame:
    w = Window.partitionBy(*cell)
    step = df.withColumn("__n", F.count(x).over(w)).withColumn("__m", F.median(x).over(w)).withColumn("__d", F.abs(F.col(x) - F.col("__m")))
    step = step.withColumn("__mad_", F.median("__d").over(w))
    ok = (F.col("__n") < 3) | (F.col("__mad_") == 0) | (F.abs(0.6745 * (F.col(x) - F.col("__m")) / F.nullif(F.col("__mad_"), F.lit(0.0))) <= k)
    return step.withColumn("__mad", ok).drop("__m", "__d", "__mad_")


def drop_iqr(df: DataFrame, cell: list[str] = CELL, x: str = "price", m: float = 1.5) -> DataFrame:
    """Without the rows outside the fences; cells of under 4 rows or without spread stay whole."""
    return _iqr(df, cell, x, m).where("__iqr").drop("__iqr")


def _iqr(df: DataFrame, cell: list[str], x: str, m: float) -> DataFrame:
    w = Window.partitionBy(*cell)
    step = df.withColumn("__c", F.count(x).over(w)).withColumn("__q", F.percentile(x, [0.25, 0.75]).over(w))
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    ok = (F.col("__c") < 4) | (hi == lo) | F.col(x).between(lo - m * (hi - lo), hi + m * (hi - lo))
    return step.withColumn("__iqr", ok).drop("__c", "__q")


def flag_outliers(df: DataFrame, cell: list[str] = CELL, x: str = "price", k: float = 3.5, m: float = 1.5) -> DataFrame:
    """Columns ``survives`` and ``outlier_method``: by MAD, or where that removes nothing by the fences."""
    w = Window.partitionBy(*cell)
    step = _iqr(_mad(df, cell, x, k), cell, x, m)
    by_mad = F.sum(F.when(~F.col("__mad"), 1).otherwise(0)).over(w)
    step = step.withColumn("__by", by_mad).withColumn("survives", F.when((F.col("__by") > 0) | (F.col("__n") < 3), F.col("__mad")).otherwise(F.col("__iqr")))
    gone = F.sum(F.when(~F.col("survives"), 1).otherwise(0)).over(w)
    method = F.when(gone == 0, "none").when(F.col("__by") > 0, "mad").otherwise("iqr")
    return step.withColumn("outlier_method", method).drop("__mad", "__iqr", "__n", "__by")


def est_median(x: Column) -> Column:
    return F.median(x)


def est_jevons(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


def est_mean(x: Column) -> Column:
    return F.avg(x)


def est_trimmed(df: DataFrame, cell: list[str] = CELL, x: str = "price") -> DataFrame:
    """Mean between the 10th and 90th percentile, from 5 rows on; else the median. One row per cell: ``price``, ``n``."""
    q = F.percentile(x, [0.1, 0.9]).over(Window.partitionBy(*cell))
    step = df.withColumn("__q", q).withColumn("__in", F.col(x).between(F.col("__q")[0], F.col("__q")[1]))
    return step.groupBy(*cell).agg(F.when(F.count(x) >= 5, F.avg(F.when(F.col("__in"), F.col(x)))).otherwise(F.median(x)).alias("price"), F.count(x).alias("n"))


def weighted_median(df: DataFrame, cell: list[str] = CELL, x: str = "price", w: str = "weight") -> DataFrame:
    """The first price at which the running weight reaches half of all. One row per cell: ``price``, ``n``."""
    part = Window.partitionBy(*cell)
    run = F.sum(w).over(part.orderBy(x).rangeBetween(Window.unboundedPreceding, 0))
    step = df.withColumn("__run", run).withColumn("__all", F.sum(w).over(part))
    return step.groupBy(*cell).agg(F.min(F.when(F.col("__run") >= F.col("__all") / 2 - 1e-12, F.col(x))).alias("price"), F.count(x).alias("n"))


#: Name -> aggregate over a cell's surviving carrier prices and their weights. Users add their own.
ESTIMATORS: dict = {"MEDIAN": lambda x, w: est_median(x), "JEVONS": lambda x, w: est_jevons(x), "MEAN": lambda x, w: est_mean(x)}


def survivors(df: DataFrame, cell: list[str] = CELL, carrier: str = "carrier", price: str = "base_fare", cabin: str | None = "ECONOMY", family: str | None = "BASIC") -> DataFrame:
    """Carrier prices of every cell with their outlier flags: what estimates and their variance are computed from."""
    return flag_outliers(best_carrier_minima(where_product(where_available(df, price), cabin, family), cell, carrier, price), cell)


def representative_price(df: DataFrame, cell: list[str] = CELL, carrier: str = "carrier", price: str = "base_fare", estimator: str = "MEDIAN", cabin: str | None = "ECONOMY", family: str | None = "BASIC") -> DataFrame:
    """One row per cell with a quote: ``price`` by the named estimator (MEDIAN, JEVONS, MEAN, TRIMMED_MEAN, ENSEMBLE or one from ESTIMATORS)."""
    rows = survivors(df, cell, carrier, price, cabin, family).where("survives").withColumn("weight", feed_weight(F.col("feed_type")))
    if estimator == "TRIMMED_MEAN":
        return est_trimmed(rows, cell).select(*cell, "price")
    if estimator == "ENSEMBLE":
        return weighted_median(rows, cell).select(*cell, "price")
    return rows.groupBy(*cell).agg(ESTIMATORS[estimator](F.col("price"), F.col("weight")).alias("price"))


def cell_report(df: DataFrame, cell: list[str] = CELL, carrier: str = "carrier", price: str = "base_fare", cabin: str | None = "ECONOMY", family: str | None = "BASIC", estimator: str = "JEVONS") -> DataFrame:
    """Per cell: the price and what it rests on. Outliers count for nothing but ``carriers``, ``n_obs`` and ``removed``."""
    rows = survivors(df, cell, carrier, price, cabin, family).withColumn("weight", feed_weight(F.col("feed_type")))
    x = F.when(F.col("survives"), F.col("price"))
    return rows.groupBy(*cell).agg(
        money(ESTIMATORS[estimator](x, F.col("weight"))).alias("price"),
        F.count(F.lit(1)).alias("carriers"),
        F.count(x).alias("carriers_after"),
        F.sum("quotes").alias("n_obs"),
        money(F.min(x)).alias("min_price"),
        money(F.max(x)).alias("max_price"),
        money(F.stddev_pop(x)).alias("std_price"),
        money(F.percentile(x, 0.25)).alias("p25"),
        money(F.percentile(x, 0.75)).alias("p75"),
        F.round(F.avg(F.when(F.col("survives"), feed_score(F.col("feed_type")))), 1).alias("feed_quality"),
        F.max(F.when(F.col("survives"), F.struct(feed_score(F.col("feed_type")).alias("s"), F.col("feed_type").alias("f"))))["f"].alias("dominant_feed"),
        F.max("outlier_method").alias("outlier_method"),
        F.count(F.when(~F.col("survives"), 1)).alias("removed"),
    )
