"""The published index table: headline and core series of all prices, horizons and days, national and by route, with changes, means, error and quality.

One pass over the quotes: the prices of a quote are stacked, so every series shares one scan, and the rows of routes come out of the group that makes the national row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.columns import confidence, confidence_band, money

from . import cells as c
from . import index as ix

#: Key of a national series, and with the route of any series.
POINT = ["price_series", "horizon", "obs_date"]
SERIES = ["price_series", "series_type", "horizon", "route"]
#: Fixed by the method: what a route's row says of its quality, by whether the national coverage is 90 or more.
ROUTE_QUALITY = {True: ("LIVE", 90.0), False: ("BETA", 70.0)}
COLUMNS = [
    "price_series", "series_type", "route", "horizon", "obs_date", "index_value", "change_1d", "change_7d", "change_30d", "moving_avg", "divisor", "spot_from", "spot_to", "coverage", "low_coverage", "n_routes",
    "standard_error", "quality_score", "index_status", "completeness", "carrier_diversity", "feed_quality", "outliers",
]


def stacked_prices(fares: DataFrame, prices: tuple = ("base_fare", "total_fare")) -> DataFrame:
    """A row per quote and price: ``price_series`` names the price, ``fare`` is its value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p.upper()).alias("price_series"), F.col(p).cast("double").alias("fare")) for p in prices]))
    return fares.select(*[x for x in ("route", "carrier", "horizon", "obs_date", "travel_date", "status", "feed_type", "fare_family", "cabin") if x in fares.columns], pairs.alias("__p")).select("*", "__p.*").drop("__p")


def price_cells(stacked: DataFrame, estimator: str = "JEVONS") -> DataFrame:
    """The cell report of every price series."""
    return c.cell_report(stacked, cell=["price_series", "route", "obs_date", "horizon"], price="fare", estimator=estimator)


def index_points(cells: DataFrame, weights: DataFrame, all_routes: int = 25) -> DataFrame:
    """One row per point (POINT) from cells with a base: index, coverage, jackknife error, quality; ``routes`` holds the index of each route.

    A window and a group over the same keys, so the cells are shuffled once. A point has as many cells as there are routes, however many quotes.
    ``genuine``: whether any cell's base is a price of its base day; ``moved``: whether any of these differs from the price.
    """
    total = weights.agg(F.sum("weight").alias("__total"))
    rows = cells.join(weights.select("route", "weight"), "route", "left").withColumn("__used", (F.col("price") > 0) & (F.col("base") > 0) & F.col("weight").isNotNull())
    used = lambda x: F.when(F.col("__used"), x)
    w = Window.partitionBy(*POINT)
    rows = rows.withColumn("__wr", used(F.col("weight") * F.col("price") / F.col("base"))).withColumn("__w", used(F.col("weight")))
    rows = rows.withColumn("__sum_wr", F.sum("__wr").over(w)).withColumn("__sum_w", F.sum("__w").over(w)).withColumn("__n", F.count("__w").over(w))
    left_out = used(F.when(F.col("__n") > 1, 100 * (F.col("__sum_wr") - F.col("__wr")) / F.nullif(F.col("__sum_w") - F.col("__w"), F.lit(0.0))))
    rows = rows.withColumn("__pseudo", F.col("__n") * 100 * F.col("__sum_wr") / F.col("__sum_w") - (F.col("__n") - 1) * left_out)
    of_route = F.struct("route", money(100 * F.col("price") / F.col("base"), 4).alias("index_value"))
    out = rows.groupBy(*POINT).agg(
        F.max("__sum_wr").alias("S"), F.max("__sum_w").alias("W"), F.max("__n").alias("n_routes"), money(F.sqrt(F.var_samp("__pseudo") / F.count("__pseudo")), 4).alias("standard_error"),
        F.count(F.lit(1)).alias("__routes"), F.avg("carriers").alias("__carriers"), F.avg("feed_quality").alias("__feed"), F.sum("removed").alias("outliers"),
        F.bool_or(F.col("is_base") & (F.col("price") > 0)).alias("genuine"), F.bool_or(F.col("has_base") & (F.col("base") != F.col("price"))).alias("moved"),
        F.collect_list(F.when((F.col("price") > 0) & (F.col("base") > 0), of_route)).alias("routes"),
    )
    share = F.col("W") / F.col("__total")
    out = out.where("n_routes > 0").crossJoin(F.broadcast(total)).withColumn("coverage", money(100 * share)).withColumn("low_coverage", share < 0.8)  # one row
    score, status = ix.quality_of(all_routes)
    quality = out.withColumnsRenamed({"__routes": "routes_", "routes": "__list"}).withColumnsRenamed({"routes_": "routes", "__carriers": "carriers", "__feed": "feed"})
    return quality.select(
        *POINT, money(100 * F.col("S") / F.col("W"), 4).alias("index_value"), "coverage", "low_coverage", "n_routes", "standard_error", money(score, 1).alias("quality_score"), status.alias("index_status"),
        money(F.col("routes") * 100.0 / all_routes, 1).alias("completeness"), money(F.col("carriers"), 1).alias("carrier_diversity"), money(F.col("feed"), 1).alias("feed_quality"), "outliers", "genuine", "moved", F.col("__list").alias("routes"),
    )


def carried_divisor(keys: list[str], date: str, reset: Column | None = None) -> Column:
    """The divisor of the day before, 1.0 where that day has no row; ``reset`` (null: none) begins anew with its own value.

    A run of days without a gap shares the number of days since a fixed one less the place in the series, and a divisor is carried within its run only.
    """
    if reset is None:
        return F.lit(1.0)
    order = Window.partitionBy(*keys).orderBy(date)
    run = F.datediff(F.col(date), F.lit("1970-01-01")) - F.row_number().over(order)
    # The last reset, if it belongs to this run: the greatest run number so far is the current one.
    last = F.last(F.when(reset.isNotNull(), F.struct(run.alias("run"), reset.alias("value"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return F.when(last["run"] == run, last["value"]).otherwise(F.lit(1.0))


def publish(points: DataFrame, keys: list[str] = SERIES, date: str = "obs_date", x: str = "index_value", reset: str | None = None, mean_days: int = 28, min_n: int = 5, spot: tuple = (28, 3)) -> DataFrame:
    """With the changes against 1, 7 and 30 days before, the trailing mean, divisor and spot window. A series is a row a day, so its windows are small."""
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(day)
    before = lambda k: F.max(x).over(w.rangeBetween(-k, -k))
    good = F.when(F.col(x) > 0, F.col(x))
    trailing = w.rangeBetween(1 - mean_days, 0)
    changes = {f"change_{k}d": F.when(before(k) > 0, money(100 * (F.col(x) - before(k)) / F.nullif(before(k), F.lit(0.0)))) for k in (1, 7, 30)}
    mean = F.when(F.count(good).over(trailing) >= min_n, money(F.avg(good).over(trailing)))
    out = points.withColumns({**changes, "moving_avg": mean}).withColumn("divisor", carried_divisor(keys, date, F.col(reset) if reset else None))
    return ix.spot_window(out, date, *spot)


def daily_index(fares: DataFrame, weights: DataFrame, base_date: str, prices: tuple = ("base_fare", "total_fare"), estimator: str = "JEVONS", all_routes: int = 25) -> DataFrame:
    """National (null route) and route rows of the headline index for all prices, horizons and days, with all of COLUMNS.

    Base prices are those of ``base_date`` by price, route and horizon, or the current price where they are missing. A series that has no base price at all has no rows, but for the base
    date itself. Rows of routes have the simplified quality that the method gives them.
    """
    cells = price_cells(stacked_prices(fares, prices), estimator)
    at = F.max(F.when((F.col("obs_date") == F.lit(base_date).cast("date")) & (F.col("price") > 0), F.col("price"))).over(Window.partitionBy("price_series", "route", "horizon"))
    is_base = F.col("obs_date") == F.lit(base_date).cast("date")
    cells = cells.withColumn("__at", at).withColumn("base", F.coalesce("__at", "price")).withColumn("has_base", F.col("__at").isNotNull()).withColumn("is_base", is_base)
    points = index_points(cells, weights, all_routes)
    known = F.bool_or("genuine").over(Window.partitionBy("price_series", "horizon"))  # a row a day
    return _rows(points.withColumn("__known", known).where("__known"), "HEADLINE")


def _rows(points: DataFrame, series_type: str, with_routes: bool = True) -> DataFrame:
    national = ["index_value", "coverage", "low_coverage", "n_routes", "standard_error", "quality_score", "index_status", "completeness", "carrier_diversity", "feed_quality", "outliers"]
    kinds = dict(points.dtypes)
    null = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    of_nation = F.struct(F.lit(None).cast("string").alias("route"), *national)
    live = F.col("coverage") >= 90
    pick = lambda i: F.when(live, ROUTE_QUALITY[True][i]).otherwise(ROUTE_QUALITY[False][i])
    of_route = lambda r: F.struct(
        r["route"].alias("route"), r["index_value"].alias("index_value"), F.lit(100.0).alias("coverage"), F.lit(False).alias("low_coverage"), null("n_routes"), null("standard_error"), pick(1).alias("quality_score"), pick(0).alias("index_status"),
        F.lit(100.0).alias("completeness"), F.lit(1.0).alias("carrier_diversity"), F.lit(80.0).alias("feed_quality"), F.lit(0).cast(kinds["outliers"]).alias("outliers"),
    )
    both = F.concat(F.array(of_nation), F.transform("routes", of_route)) if with_routes else F.array(of_nation)
    flat = points.select(*POINT, F.lit(series_type).alias("series_type"), F.inline(both))
    return publish(flat).select(*COLUMNS)


def index_range(fares: DataFrame, weights: DataFrame, first: str, last: str, prices: tuple = ("base_fare", "total_fare"), estimator: str = "JEVONS") -> DataFrame:
    """``daily_index`` over a range of days, against the range's first day: one job over all days and prices."""
    days = fares.where(F.col("obs_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return daily_index(days, weights, first, prices, estimator)


def continuous_routes(cells: DataFrame, headline: DataFrame, days: int = 14, min_n: int = 5) -> DataFrame:
    """Cells of routes whose published headline has ``min_n`` points within the ``days`` before, the day itself not counted.

    Cells and published points of a route are put in order of days together, and a running count over the points judges the cells: one shuffle by route.
    """
    key = ["price_series", "route", "horizon"]
    published = headline.where("route is not null").select(*key, "obs_date", F.lit(None).cast(cells.select(F.struct("*")).schema[0].dataType).alias("cell"))
    both = cells.select(*key, "obs_date", F.struct("*").alias("cell")).unionByName(published)
    day = F.datediff("obs_date", F.lit("1970-01-01"))
    points = F.count_if(F.col("cell").isNull()).over(Window.partitionBy(*key).orderBy(day).rangeBetween(-days, -1))
    return both.withColumn("__points", points).where(F.col("cell").isNotNull() & (F.col("__points") >= min_n)).select("cell.*")


def core_index(fares: DataFrame, weights: DataFrame, calendar: DataFrame, base_date: str, headline: DataFrame, horizon: int = 15, prices: tuple = ("base_fare", "total_fare"), estimator: str = "JEVONS", anchor_days: int = 21, all_routes: int = 25) -> DataFrame:
    """National rows of the core series of one horizon: quotes without peak travel (``core_guard``), routes with continuity in ``headline`` (rows of ``daily_index``).

    The base is the base date's guarded prices; if a price series has none, those of the nearest day (``core_anchor``) within ``anchor_days`` whose travel is no peak day, never a day
    after the observation. A day on which no route's base differs from its price has no row.
    """
    guarded = ix.core_guard(fares.where(F.col("horizon") == horizon), calendar)
    cells = price_cells(stacked_prices(guarded, prices), estimator)
    base = F.lit(base_date).cast("date")
    on_base = cells.where(F.col("obs_date") == base).select("price_series").distinct().withColumn("__on_base", F.lit(True))
    anchors = ix.core_anchor(cells, calendar, base_date, "obs_date", anchor_days, ["price_series"], horizon)
    days = cells.select("price_series", "obs_date").distinct().join(F.broadcast(on_base), "price_series", "left")  # a row a price series
    days = days.join(anchors, ["price_series", "obs_date"], "left").select("price_series", "obs_date", F.when(F.col("__on_base"), base).otherwise(F.col("anchor")).alias("anchor")).where("anchor is not null")
    bases = cells.where(F.abs(F.datediff("obs_date", base)) <= anchor_days).select("price_series", "route", F.col("obs_date").alias("anchor"), F.col("price").alias("__b"))
    eligible = continuous_routes(cells, headline.where((F.col("horizon") == horizon) & (F.col("series_type") == "HEADLINE")))
    rows = eligible.join(days, ["price_series", "obs_date"]).join(bases, ["price_series", "route", "anchor"], "left")
    has = F.coalesce(F.col("__b") > 0, F.lit(False))
    rows = rows.withColumn("has_base", has).withColumn("base", F.when(has, F.col("__b")).otherwise(F.col("price"))).withColumn("is_base", F.col("obs_date") == F.col("anchor")).drop("__b", "anchor")
    points = index_points(rows, weights, all_routes).where("moved")
    return _rows(points, "CORE", with_routes=False)


def published_index(fares: DataFrame, weights: DataFrame, calendar: DataFrame, base_date: str, horizon: int = 15, headline: DataFrame | None = None) -> DataFrame:
    """Headline and core rows together. The headline is read twice; a caller that has stored it passes it."""
    headline = daily_index(fares, weights, base_date) if headline is None else headline
    return headline.unionByName(core_index(fares, weights, calendar, base_date, headline, horizon))


def index_now(published: DataFrame, selectors: DataFrame) -> DataFrame:
    """The latest national row for each selector (price_series, horizon, series_type), with confidence and band; horizon 14 asks for 15.

    A selector without rows gets the latest national row of its series type (``fallback``), of several the first by price series and horizon; one whose type has none is left out.
    Only the latest row of each series is kept before selectors meet them, so the join is of a few rows.
    """
    national = published.where("route is null")
    value = F.struct(*[x for x in national.columns if x not in ("price_series", "horizon", "series_type")])
    latest = national.groupBy("series_type", "price_series", "horizon").agg(F.max_by(value, "obs_date").alias("row"))
    any_row = latest.groupBy("series_type").agg(F.min_by(F.struct("price_series", "horizon", "row"), F.struct(-F.datediff("row.obs_date", F.lit("1970-01-01")), "price_series", "horizon")).alias("any"))
    asked = selectors.select(F.col("price_series").alias("asked_price"), F.col("horizon").alias("asked_horizon"), "series_type", F.when(F.col("horizon") == 14, 15).otherwise(F.col("horizon")).alias("__h"))
    exact = latest.select("series_type", F.col("price_series").alias("asked_price"), F.col("horizon").alias("__h"), F.struct("price_series", "horizon", "row").alias("hit"))
    both = asked.join(exact, ["series_type", "asked_price", "__h"], "left").join(any_row, "series_type").withColumn("fallback", F.col("hit").isNull())
    out = both.select("asked_price", "asked_horizon", "series_type", "fallback", F.coalesce("hit", "any").alias("r")).select("asked_price", "asked_horizon", "series_type", "fallback", "r.price_series", "r.horizon", "r.row.*")
    score = confidence(F.coalesce("quality_score", F.lit(0.0)), F.lit("NETWORK"), F.lit(1.0))
    return out.drop("route").withColumn("confidence_score", score).withColumn("confidence_band", confidence_band(score))
