"""Series analytics: anomalies, elevation, lead and lag, features, forecasts and their accuracy."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.columns import money, severity

from .analytics import order_stats, quantile_ranks, safe_corr
from .joins import asof_join


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01"))


def robust_scores(df: DataFrame, keys: list[str], date: str, x: str, days: int | None = None, floor: float = 0.02) -> DataFrame:
    """Robust z and Tukey fences of the last ``days`` of every series, with severity; moves under ``floor`` of the median are NONE. Rows that are not finite are out.

    Medians and quartiles are those of ``order_stats``, joined back by series, so that no series is sorted as a whole.
    """
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(x)).drop("n", "median", "mad")
    if days:
        last = rows.groupBy(*keys).agg(F.max(date).alias("__last"))
        rows = _with(rows, last, keys).where(F.datediff("__last", date) < days).drop("__last")
    ranks, values = quantile_ranks(median=0.5, __q1=0.25, __q3=0.75)
    middle = order_stats(rows, keys, x, ranks).select(*keys, "n", *[v.alias(c) for c, v in values.items()])
    rows = _with(rows, middle, keys).withColumn("__d", F.abs(F.col(x) - F.col("median")))
    ranks, values = quantile_ranks(mad=0.5)
    rows = _with(rows, order_stats(rows, keys, "__d", ranks).select(*keys, values["mad"].alias("mad")), keys)
    z = F.when((F.col("n") < 3) | (F.col("mad") == 0), 0.0).otherwise(0.6745 * (F.col(x) - F.col("median")) / F.nullif(F.col("mad"), F.lit(0.0)))
    lo, hi = F.col("__q1"), F.col("__q3")
    outside = lambda m: (F.col(x) < lo - m * (hi - lo)) | (F.col(x) > hi + m * (hi - lo))
    dev = F.coalesce(F.abs(F.col(x) - F.col("median")) / F.nullif(F.col("median"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("z", z).withColumn("inner_breach", outside(1.5)).withColumn("outer_breach", outside(3.0))
    return rows.withColumn("severity", F.when(dev < floor, "NONE").otherwise(severity(F.col("z"), F.col("inner_breach"), F.col("outer_breach")))).drop("__q1", "__q3", "__d")


def _with(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their series in ``stats``, null keys included."""
    named = stats.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys]) if keys else F.lit(True)
    return rows.join(named, on).drop(*[f"__of_{k}" for k in keys])


def anomaly_report(scored: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("median"), 4).alias("median"), F.round(F.max("mad"), 4).alias("mad"), n("NONE"), n("LOW"), n("MODERATE"), n("SEVERE"))


RANKS = {"NONE": 0, "LOW": 1, "MODERATE": 2, "SEVERE": 3}


def severity_rank(c: str) -> Column:
    return F.coalesce(*[F.when(F.col(c) == s, r) for s, r in RANKS.items()])


def escalate(hits: DataFrame, keys: list[str], date: str, run: int = 2) -> DataFrame:
    """Runs of hits on consecutive days: the last and the longest; escalated if any is severe, or moderate with a last run of ``run``."""
    w = Window.partitionBy(*keys).orderBy(date)
    rows = hits.withColumn("__new", F.coalesce((F.datediff(date, F.lag(date).over(w)) > 1).cast("int"), F.lit(1))).withColumn("__island", F.sum("__new").over(w))
    islands = rows.groupBy(*keys, "__island").agg(F.count(F.lit(1)).alias("len"), F.max(severity_rank("severity")).alias("top"), F.min(date).alias("a"), F.max(date).alias("b"))
    out = islands.groupBy(*keys).agg(F.sum("len").alias("hits"), F.max_by("len", "__island").alias("last_run"), F.max("len").alias("longest_run"), F.max("top").alias("top"), F.min("a").alias("first_day"), F.max("b").alias("last_day"))
    name = F.element_at(F.array(*[F.lit(s) for s in RANKS]), F.col("top") + 1)
    return out.select(*keys, "hits", "last_run", "longest_run", name.alias("max_severity"), "first_day", "last_day", ((F.col("top") == 3) | ((F.col("top") >= 2) & (F.col("last_run") >= run))).alias("escalated"))


def detect_anomalies(scored: DataFrame, events: DataFrame, keys: list[str], date: str, today: str, stale: int = 7) -> DataFrame:
    """The event log after a run: today's findings replace those of the same point, and open ones older than ``stale`` days are resolved."""
    from .joins import replace_by_key

    new = scored.where("severity <> 'NONE'").select(*keys, date, "severity", F.lit("OPEN").alias("status"))
    log = replace_by_key(events, new, [*keys, date])
    old = F.datediff(F.lit(today).cast("date"), F.col(date)) > stale
    return log.withColumn("status", F.when((F.col("status") == "OPEN") & old, "RESOLVED").otherwise(F.col("status")))


def rebase(df: DataFrame, keys: list[str], date: str, x: str, base_date: str | None = None) -> DataFrame:
    """Column ``rebased``: 100 at the base date, or at the first point; null if that is missing or 0."""
    w = Window.partitionBy(*keys)
    base = F.max(F.when(F.col(date) == F.lit(base_date).cast("date"), F.col(x))).over(w) if base_date else F.first(x).over(w.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("rebased", F.round(100 * F.col(x) / F.nullif(base, F.lit(0.0)), 4))


def lags(df: DataFrame, keys: list[str], date: str, x: str, ks: tuple = (1, 2, 3, 7, 14, 21, 28)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date)
    return df.withColumns({f"lag_{k}": F.lag(x, k).over(w) for k in ks})


def rolling(df: DataFrame, keys: list[str], date: str, x: str, ks: tuple = (7, 14, 28)) -> DataFrame:
    """Mean, sample deviation, least and greatest of the last k rows; null until there are k."""
    out = {}
    for k in ks:
        w = Window.partitionBy(*keys).orderBy(date).rowsBetween(1 - k, 0)
        full = F.count(x).over(w) == k
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"{name}_{k}"] = F.when(full, f(x).over(w))
    return df.withColumns(out)


def momentum(df: DataFrame, keys: list[str], date: str, x: str, ks: tuple = (7, 14, 28)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date)
    return df.withColumns({f"mom_{k}": F.col(x) / F.nullif(F.lag(x, k).over(w), F.lit(0.0)) - 1 for k in ks})


def rolling_vol(df: DataFrame, keys: list[str], date: str, x: str, ks: tuple = (7, 28)) -> DataFrame:
    """Sample deviation of the last k one-row changes; null until there are k."""
    w = Window.partitionBy(*keys).orderBy(date)
    rows = df.withColumn("__c", F.col(x) / F.nullif(F.lag(x).over(w), F.lit(0.0)) - 1)
    return rows.withColumns({f"vol_{k}": F.when(F.count("__c").over(w.rowsBetween(1 - k, 0)) == k, F.stddev_samp("__c").over(w.rowsBetween(1 - k, 0))) for k in ks}).drop("__c")


def targets(df: DataFrame, keys: list[str], date: str, x: str, hs: tuple = (1, 7, 15, 30, 45)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(date)
    return df.withColumns({f"target_{h}": F.lead(x, h).over(w) for h in hs}).dropna("all", subset=[f"target_{h}" for h in hs])


def calendar_features(df: DataFrame, date: str) -> DataFrame:
    """Day of week from Monday = 0, ISO week, month, quarter, day of year, first and last day of the month."""
    d = F.col(date)
    return df.withColumns({"dow": F.weekday(d), "week": F.weekofyear(d), "month": F.month(d), "quarter": F.quarter(d), "doy": F.dayofyear(d), "month_start": F.dayofmonth(d) == 1, "month_end": d == F.last_day(d)})


def classify_elevation(df: DataFrame, keys: list[str], date: str, x: str, calendar: DataFrame | None = None, breadth: Column | int = 0, fuel_move: Column | float = 0.0, threshold: float = 5.0, transient: int = 14, structural: int = 21, fuel_threshold: float = 2.0, evidence: DataFrame | None = None) -> DataFrame:
    """Each series' elevation over the median of its first half, how long its last run above it is, and what that evidence makes it.

    Structural evidence: a long run, three or more carriers, a fuel move. Transient: a short run, a peak day in the run or within two days of its start, one carrier.
    ``evidence`` (keys, breadth, fuel_move) gives each series its own carriers and fuel move, which are returned with it.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(date))).withColumn("__n", F.count(F.lit(1)).over(w))
    half = F.greatest(F.lit(2), F.expr("__n div 2"))
    rows = rows.withColumn("__base", F.median(F.when(F.col("__i") <= half, F.col(x))).over(w))
    level = F.col("__base") * (1 + threshold / 100)
    rows = rows.withColumn("__low", F.max(F.when(F.col(x) < level, F.col("__i"))).over(w)).withColumn("__tail", F.col("__i") > F.coalesce("__low", F.lit(0)))
    if calendar is not None:
        start = F.min(F.when(F.col("__tail"), F.col(date))).over(w)
        near = calendar.select(F.explode(F.sequence(F.date_sub("day", 2), F.date_add("day", 2))).alias("__near"), F.col("day").alias("__peak"))
        near = near.groupBy("__near").agg(F.max((F.col("__near") == F.col("__peak")).cast("int")).alias("__is"))
        rows = rows.withColumn("__start", start).join(near, F.col(date) == F.col("__near"), "left")
        hit = F.col("__tail") & ((F.col("__is") == 1) | (F.col("__is").isNotNull() & (F.col(date) == F.col("__start"))))
    else:
        hit = F.lit(False)
    out = rows.withColumn("__hit", F.coalesce(hit, F.lit(False))).groupBy(*keys).agg(
        F.max("__base").alias("baseline"), F.max_by(x, "__i").alias("latest"), F.count_if("__tail").cast("int").alias("persistence"), F.min(F.when(F.col("__tail"), F.col(date))).alias("episode_start"), F.bool_or("__hit").alias("calendar_aligned")
    )
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    b, m, more = as_col(breadth), as_col(fuel_move), []
    if evidence is not None:
        out = out.join(evidence.select(*keys, "breadth", "fuel_move"), keys, "left")
        b, m = F.coalesce("breadth", F.lit(0)), F.coalesce("fuel_move", F.lit(0.0))
        more = [b.alias("carrier_breadth"), money(m).alias("fuel_move_pct"), (m >= fuel_threshold).alias("fuel_aligned")]
    pct = 100 * (F.col("latest") - F.col("baseline")) / F.nullif(F.col("baseline"), F.lit(0.0))
    i = lambda c: c.cast("int")
    s = i(F.col("persistence") >= structural) + i(b >= 3) + i(m >= fuel_threshold)
    t = i(F.col("persistence") <= transient) + i(F.col("calendar_aligned")) + i((b > 0) & (b <= 1))
    mode = (
        F.when(F.col("baseline").isNull() | (F.col("baseline") <= 0), "NO_DATA").when(pct < threshold, "NO_ELEVATION").when((s >= 2) & (s >= t), "STRUCTURAL")
        .when((t >= 2) & (t > s), "TRANSIENT").when((s == 1) & (t == 0), "STRUCTURAL").when((t == 1) & (s == 0), "TRANSIENT").otherwise("MIXED")
    )
    return out.select(*keys, F.round("baseline", 2).alias("baseline"), F.round("latest", 2).alias("latest"), F.round(pct, 2).alias("elevation_pct"), "persistence", "episode_start", "calendar_aligned", s.alias("structural_score"), t.alias("transient_score"), mode.alias("mode"), *more)


def episode_evidence(rows: DataFrame, keys: list[str], date: str, quotes: DataFrame, fuel: DataFrame, same: tuple[str, ...] = ("horizon",)) -> DataFrame:
    """(keys, breadth, fuel_move) of each series' own window, the days from its first to its last row.

    breadth: carriers with an available price on the series' last day, among ``quotes`` that agree in the columns ``same``; fuel_move: change of ``fuel`` (day, fuel) in percent from the
    first to the last record within the window, 0 with under two or from nothing. Windows are laid out as days and joined by equality; a series has at most a few hundred.
    """
    windows = rows.groupBy(*keys).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    priced = quotes.where((F.upper(F.coalesce("status", F.lit("AVAILABLE"))) == "AVAILABLE") & (F.col("base_fare") > 0))
    on_last = priced.select(*same, F.col(date).alias("__b"), "carrier").distinct().join(windows.select(*keys, "__b"), [*same, "__b"])
    breadth = on_last.groupBy(*keys).agg(F.count_distinct("carrier").alias("breadth"))
    days = windows.select(*keys, F.explode(F.sequence("__a", "__b")).alias("day")).join(fuel.where("fuel is not null").select("day", "fuel"), "day")
    first, last = F.min_by("fuel", "day"), F.max_by("fuel", "day")
    move = days.groupBy(*keys).agg(F.when((F.count(F.lit(1)) >= 2) & (first != 0), 100 * (last - first) / F.nullif(first, F.lit(0.0))).otherwise(0.0).alias("fuel_move"))
    return windows.select(*keys).join(breadth, keys, "left").join(move, keys, "left")


def policy_signal(df: DataFrame, keys: list[str], date: str, x: str, calendar: DataFrame | None = None, points: int = 60, min_n: int = 5, quotes: DataFrame | None = None, fuel: DataFrame | None = None, same: tuple[str, ...] = ("horizon",), **options) -> DataFrame:
    """``classify_elevation`` over the last ``points`` of every series, with a line that says what it rests on; series of under ``min_n`` points are INSUFFICIENT_DATA.

    With ``quotes`` and ``fuel`` the evidence is that of ``episode_evidence``.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__r", F.row_number().over(w.orderBy(F.desc(date)))).withColumn("points", F.least(F.lit(points), F.count(F.lit(1)).over(w))).where(F.col("__r") <= points).drop("__r")
    enough = rows.where(F.col("points") >= min_n)
    evidence = episode_evidence(enough, keys, date, quotes, fuel, same) if quotes is not None and fuel is not None else None
    out = classify_elevation(enough.drop("points"), keys, date, x, calendar, evidence=evidence, **options)
    line = F.format_string("%s: %.2f%% over baseline for %d day(s)", "mode", "elevation_pct", "persistence")
    if evidence is not None:
        carriers = F.format_string(", %d carrier(s), fuel %.2f%%", "carrier_breadth", "fuel_move_pct")
        until = F.when(F.col("mode") == "TRANSIENT", F.concat(F.lit(", over by "), F.date_add("episode_start", options.get("transient", 14)).cast("string"))).otherwise("")
        line = F.concat(line, carriers, until)
    counts = rows.groupBy(*keys).agg(F.max("points").alias("points"))
    named = out.withColumn("label", F.when(F.col("mode") != "NO_DATA", line))
    return counts.join(named, keys, "left").withColumn("status", F.when(F.col("points") >= min_n, "COMPLETED").otherwise("INSUFFICIENT_DATA"))


def window_move(df: DataFrame, keys: list[str], date: str, x: str, days: int = 30) -> DataFrame:
    """Change in percent from the first to the last value of each series' last ``days``."""
    rows = df.withColumn("__last", F.max(date).over(Window.partitionBy(*keys))).where(F.datediff("__last", date) <= days)
    a, b = F.min_by(x, date), F.max_by(x, date)
    return rows.groupBy(*keys).agg(F.round(100 * (b - a) / F.nullif(a, F.lit(0.0)), 4).alias("move_pct"), F.count(F.lit(1)).alias("n"))


def lead_lag(df: DataFrame, a: str, b: str, order: str, by: list[str], max_lag: int = 4, min_n: int = 6) -> DataFrame:
    """r of a[t] with b[t + k] and directional accuracy for every lag k with 3 pairs; ``best`` marks the greatest |r|. Series under ``min_n`` give no rows."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("__n") >= min_n)
    rows = rows.withColumn("__da", F.col(a) - F.lag(a).over(w)).withColumn("__db", F.col(b) - F.lag(b).over(w))
    shifted = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead(b, k).over(w).alias("y"), F.lead("__db", k).over(w).alias("dy")) for k in range(max_lag + 1)])
    rows = rows.withColumn("__s", shifted).select(*by, F.col(a).alias("x"), F.col("__da").alias("dx"), F.inline("__s")).where("y is not null")
    # The first pair of a lag has no step before it.
    out = rows.groupBy(*by, "lag").agg(F.round(F.coalesce(safe_corr("x", "y"), F.lit(0.0)), 3).alias("r"), F.round(100 * F.avg((F.signum("dx") == F.signum("dy")).cast("double")), 1).alias("accuracy"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.abs("r")), "lag")) == 1
    return out.withColumn("best", best)


def step_weekly(df: DataFrame, month: str, x: str) -> DataFrame:
    """Monthly values as weeks from Monday; a week of two months has the first one's value."""
    first = F.to_date(F.concat(F.col(month), F.lit("-01")))
    days = df.select(month, x, F.explode(F.sequence(first, F.last_day(first))).alias("__d"))
    return days.groupBy(F.to_date(F.date_trunc("week", "__d")).alias("week")).agg(F.min_by(x, month).alias("value"))


def date_spine(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Every day between the first and the last of each key."""
    return df.groupBy(*keys).agg(F.min(date).alias("a"), F.max(date).alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias(date))


def expand_shares(hist: DataFrame, day: str, share: str, n: int = 1000) -> DataFrame:
    """``n`` rows in all, spread by share (percent), rounded per row of the histogram."""
    return hist.select(day, F.explode(F.expr(f"sequence(1, cast(round({share} * {n} / 100) as int))")).alias("k")).where("k > 0").select(day)


def conformal(residuals: DataFrame, keys: list[str], r: str, alpha: float = 0.1) -> DataFrame:
    """Half width of the split-conformal interval: the ceil((n + 1)(1 - alpha))-th least |residual| (the greatest if there are too few)."""
    k = F.least(F.col("n"), F.ceil((F.col("n") + 1) * (1 - alpha))) - 1
    stats = order_stats(residuals.withColumn("__a", F.abs(F.col(r))), keys, "__a", {"half_width": k})
    return stats.select(*keys, F.round("half_width", 4).alias("half_width"), "n")


def model_metrics(pred: DataFrame, by: list[str], actual: str, p: str, lo: str, hi: str) -> DataFrame:
    e = F.col(p) - F.col(actual)
    return pred.groupBy(*by).agg(
        F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(100 * F.avg(F.abs(e) / F.greatest(F.abs(F.col(actual)), F.lit(1.0))), 4).alias("mape"),
        F.round(100 * F.avg(F.col(actual).between(F.col(lo), F.col(hi)).cast("double")), 2).alias("coverage"), F.round(F.avg(F.col(hi) - F.col(lo)), 4).alias("width"),
    )


def _horizon(df: DataFrame, keys: list[str], h: int) -> DataFrame:
    return df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(h))))


def persistence(df: DataFrame, keys: list[str], date: str, x: str, h: int = 7, band: float = 0.05) -> DataFrame:
    """The last value for every day ahead, with a band of 5 percent."""
    last = df.groupBy(*keys).agg(F.max(date).alias("last"), F.max_by(x, date).alias("v"))
    return _horizon(last, keys, h).select(*keys, F.expr("date_add(last, h)").alias("target"), F.round("v", 4).alias("p50"), F.round(F.col("v") * (1 - band), 4).alias("p10"), F.round(F.col("v") * (1 + band), 4).alias("p90"))


def seasonal_trend(df: DataFrame, keys: list[str], date: str, x: str, h: int = 7, z: float = 1.2816) -> DataFrame:
    """Linear trend plus the mean residual of the weekday, with a band of z residual deviations: all series in one job."""
    t = _day(date)
    fit = df.groupBy(*keys).agg(F.regr_slope(F.col(x), t).alias("slope"), F.regr_intercept(F.col(x), t).alias("icept"), F.max(date).alias("last"))
    res = df.join(fit, keys).withColumn("res", F.col(x) - F.col("icept") - F.col("slope") * t).withColumn("dow", F.weekday(date))
    season = res.groupBy(*keys, "dow").agg(F.avg("res").alias("season"))
    band = res.join(season, [*keys, "dow"]).groupBy(*keys).agg(F.coalesce(F.stddev_samp(F.col("res") - F.col("season")), F.lit(0.0)).alias("sd"))
    ahead = _horizon(fit.join(band, keys), keys, h).withColumn("target", F.expr("date_add(last, h)")).withColumn("dow", F.weekday("target"))
    p = F.col("icept") + F.col("slope") * _day("target") + F.coalesce("season", F.lit(0.0))
    return ahead.join(season, [*keys, "dow"], "left").select(*keys, "target", F.round(p, 4).alias("p50"), F.round(p - z * F.col("sd"), 4).alias("p10"), F.round(p + z * F.col("sd"), 4).alias("p90"))


def ensemble(forecasts: DataFrame, keys: list[str], model: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of each quantile over the models there are."""
    w = F.lit(None).cast("double")
    for name, v in weights.items():
        w = F.when(F.col(model) == name, float(v)).otherwise(w)
    rows = forecasts.withColumn("__w", w).where("__w > 0")
    return rows.groupBy(*keys).agg(*[F.round(F.sum(F.col("__w") * F.col(q)) / F.sum("__w"), 4).alias(q) for q in ("p10", "p50", "p90")], F.count(F.lit(1)).alias("models"))


def model_confidence(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """1 less the spread of the models over their mean, within 0.1 and 1; 0.5 for a single model."""
    m = F.greatest(F.abs(F.avg("p50")), F.lit(1.0))
    return forecasts.groupBy(*keys).agg(F.round(F.when(F.count(F.lit(1)) == 1, 0.5).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - F.stddev_pop("p50") / m))), 4).alias("confidence"))


def history(df: DataFrame, keys: list[str], date: str, n: int = 90, min_n: int = 10) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("__r", F.row_number().over(w.orderBy(F.desc(date)))).withColumn("__c", F.count(F.lit(1)).over(w)).where((F.col("__r") <= n) & (F.col("__c") >= min_n)).drop("__r", "__c")


def horizon_bucket(c: Column) -> Column:
    return F.when(c.between(1, 7), "1-7").when(c.between(8, 14), "8-14").when(c.between(15, 21), "15-21").when(c.between(22, 28), "22-28").otherwise("UNKNOWN")


def forecast_accuracy(matured: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE, MAPE, bias and how often the value lies between the quantiles."""
    e = F.col("p50") - F.col("actual")
    inside = lambda a, b: F.round(100 * F.avg(F.col("actual").between(F.col(a), F.col(b)).cast("double")), 2)
    return matured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(100 * F.avg(F.abs(e) / F.greatest(F.abs(F.col("actual")), F.lit(1.0))), 4).alias("mape"), F.round(F.avg(e), 4).alias("bias"),
        inside("p25", "p75").alias("coverage_50"), inside("p10", "p90").alias("coverage_80"),
    )


def accuracy_by_bucket(matured: DataFrame, horizon: str = "h") -> DataFrame:
    """``forecast_accuracy`` for each bucket of horizons."""
    return forecast_accuracy(matured.withColumn("bucket", horizon_bucket(F.col(horizon))), ["bucket"])


def accuracy_all(matured: DataFrame, series: list[str]) -> DataFrame:
    """``forecast_accuracy`` for each series."""
    return forecast_accuracy(matured, series)


def append_snapshot(forecast: DataFrame, path: str, keys: list[str], forecast_date: str, model_weights: dict[str, float] | None = None, **about) -> DataFrame:
    """Append one row per forecast day (``target``, quantiles) to the snapshots at ``path``, a folder for each date of forecast; the rows of that date.

    ``about`` names further columns with one value. Snapshots of one date replace those that an earlier run of that date wrote.
    """
    import json

    day = F.to_date(F.lit(forecast_date))
    out = forecast.withColumns({"horizon_days": F.datediff("target", day), "ensemble_weights": F.lit(json.dumps(model_weights, sort_keys=True) if model_weights else None).cast("string"), **{k: F.lit(v) for k, v in about.items()}})
    out.write.mode("overwrite").parquet(f"{path.rstrip('/')}/forecast_date={forecast_date}")
    return out.sparkSession.read.schema(out.schema).parquet(f"{path.rstrip('/')}/forecast_date={forecast_date}").withColumn("forecast_date", day).select(*keys, "forecast_date", *[c for c in out.columns if c not in keys])


def read_snapshots(spark, path: str) -> DataFrame:
    """All snapshots at ``path`` with their ``forecast_date``."""
    return spark.read.parquet(path)


def forecast_features(df: DataFrame, keys: list[str], date: str, x: str, weights: DataFrame | None = None, fuel: DataFrame | None = None) -> DataFrame:
    """Features and targets of every series and day: lags and changes against them, rolling statistics, momentum, volatility, calendar; of what is there besides:
    ``is_headline`` (column ``horizon``), ``is_base_fare`` (column ``price_series``), the mean and concentration of ``weights``, and the last ``fuel`` (day, fuel) at or before the day.
    """
    for f in (lags, rolling, momentum, rolling_vol):
        df = f(df, keys, date, x)
    df = df.withColumns({f"lag_{k}_pct": F.col(x) / F.nullif(F.col(f"lag_{k}"), F.lit(0.0)) - 1 for k in (1, 2, 3, 7, 14, 21, 28)})
    df = calendar_features(df, date).withColumn("weekend", F.col("dow") >= 5)
    if "horizon" in df.columns:
        df = df.withColumn("is_headline", (F.col("horizon") == 15).cast("int"))
    if "price_series" in df.columns:
        df = df.withColumn("is_base_fare", (F.col("price_series") == "BASE_FARE").cast("int"))
    if weights is not None:  # one row
        df = df.crossJoin(F.broadcast(weights.agg(F.avg("weight").alias("market_weight"), F.sum(F.col("weight") * F.col("weight")).alias("market_concentration"))))
    df = targets(df, keys, date, x)
    return asof_join(df, fuel.withColumnRenamed("day", date) if date != "day" else fuel, [], date, "fuel", "fuel") if fuel is not None else df


def fit_gbt(features: DataFrame, target: str, date: str, inputs: list[str], holdout_days: int = 28, **params):
    """A gradient-boosted model of the target, fitted before the last ``holdout_days`` days; (model, predictions for those days)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip").transform(features.where(F.col(target).isNotNull()))
    last = rows.agg(F.max(date)).first()[0]
    late = F.datediff(F.lit(last), F.col(date)) < holdout_days
    model = GBTRegressor(labelCol=target, maxIter=params.pop("maxIter", 20), maxDepth=params.pop("maxDepth", 4), seed=7, **params).fit(rows.where(~late))
    return model, model.transform(rows.where(late)).drop("features")


def fit_horizons(features: DataFrame, date: str, inputs: list[str], hs: tuple = (1, 7, 15, 30, 45), holdout_days: int = 28, **params) -> DataFrame:
    """One model for each target ``target_<h>``: its predictions for the held-out days, a row for each horizon (``horizon``, ``target``, ``prediction``)."""
    parts = []
    for h in hs:
        pred = fit_gbt(features, f"target_{h}", date, inputs, holdout_days, **params)[1]
        parts.append(pred.drop(*[f"target_{k}" for k in hs if k != h]).withColumn("horizon", F.lit(h)).withColumnRenamed(f"target_{h}", "target"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
