"""Index numbers: weights, Laspeyres indices, their variance, and windows over index series."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import where_available

SERIES = ["horizon", "obs_date"]


def bidirectional(df: DataFrame, origin: str, dest: str, value: str) -> DataFrame:
    """Both directions of a pair added up under the one whose ends are in order: ``pair``, ``volume``."""
    pair = F.concat_ws("-", F.least(origin, dest), F.greatest(origin, dest))
    return df.groupBy(pair.alias("pair")).agg(F.sum(value).alias("volume"))


def normalise_shares(df: DataFrame, value: str, by: list[str] | None = None, out: str = "share") -> DataFrame:
    """``value`` over the group's total, rounded to 6; null if any value of the group is negative or the total isn't positive."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    total, least = F.sum(value).over(w), F.min(value).over(w)
    return df.withColumn(out, F.when((least >= 0) & (total > 0), F.round(F.col(value) / total, 6)))


def check_weights(weights: DataFrame, weight: str = "weight", lo: float = 0.999, hi: float = 1.001) -> DataFrame:
    """One row: how many weights there are, their sum and whether they can be used."""
    agg = weights.agg(F.count(weight).alias("n"), F.round(F.sum(weight), 6).alias("total"))
    status = F.when(F.col("n") == 0, "EMPTY").when(~F.coalesce(F.col("total").between(lo, hi), F.lit(False)), "BAD_SUM").otherwise("OK")
    return agg.withColumn("status", status)


def weight_concentration(weights: DataFrame, weight: str = "weight") -> DataFrame:
    return weights.agg(F.sum(F.col(weight) * F.col(weight)).alias("concentration"))


def with_base(prices: DataFrame, base: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """Column ``base``: the base price of the keys, or the current price where there is none above 0."""
    b = base.select(*keys, F.col(price).alias("__b"))
    return prices.join(b, keys, "left").withColumn("base", F.coalesce(F.when(F.col("__b") > 0, F.col("__b")), F.col(price))).drop("__b")


def with_base_date(prices: DataFrame, base_date, keys: list[str], date: str = "obs_date", price: str = "price") -> DataFrame:
    """``with_base`` for a base period among the prices: one window over the keys' cells, so that the quotes are read once."""
    at = F.max(F.when((F.col(date) == F.lit(base_date).cast("date")) & (F.col(price) > 0), F.col(price))).over(Window.partitionBy(*keys))
    return prices.withColumn("base", F.coalesce(at, F.col(price)))


def route_relatives(prices: DataFrame, weights: DataFrame, series: list[str] = SERIES, route: str = "route") -> DataFrame:
    """Relative, index and contribution of every route. Weights are renormalised over the routes with a price."""
    rows = prices.join(weights.select(route, "weight"), route).where("price > 0 and base > 0")
    w = Window.partitionBy(*series)
    rel = F.col("price") / F.col("base")
    share = F.col("weight") / F.sum("weight").over(w)
    return rows.select(route, *series, F.round(rel, 4).alias("relative"), F.round(100 * rel, 2).alias("route_index"), F.round(100 * share * rel, 2).alias("contribution"))


def laspeyres(prices: DataFrame, weights: DataFrame, series: list[str] = SERIES, route: str = "route") -> DataFrame:
    """The weighted index of every series key: 100 x sum(w p/p0) / sum(w) over the routes present, with the weight they cover."""
    rows = prices.join(weights.select(route, "weight"), route).where("price > 0 and base > 0")
    total = weights.agg(F.sum("weight").alias("__all"))
    out = rows.groupBy(*series).agg(F.sum(F.col("weight") * F.col("price") / F.col("base")).alias("s"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n_routes"))
    out = out.crossJoin(F.broadcast(total))  # one row
    return out.select(*series, F.round(100 * F.col("s") / F.col("w"), 4).alias("index_value"), F.round(100 * F.col("w") / F.col("__all"), 2).alias("coverage"), "n_routes", (F.col("w") / F.col("__all") < 0.8).alias("low_coverage"))


def jackknife(prices: DataFrame, weights: DataFrame, series: list[str] = SERIES, route: str = "route") -> DataFrame:
    """Delete-one-route variance of every series key in closed form: index, standard_error, n_routes; null with one route.

    With S = sum(w r) and W = sum(w), the index without route j is 100 (S - w r) / (W - w), so one window does for all routes.
    """
    rows = prices.join(weights.select(route, "weight"), route).where("price > 0 and base > 0").withColumn("r", F.col("price") / F.col("base"))
    w = Window.partitionBy(*series)
    step = rows.withColumn("S", F.sum(F.col("weight") * F.col("r")).over(w)).withColumn("W", F.sum("weight").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    out = F.when(F.col("n") > 1, 100 * (F.col("S") - F.col("weight") * F.col("r")) / F.nullif(F.col("W") - F.col("weight"), F.lit(0.0)))
    step = step.withColumn("pseudo", F.col("n") * 100 * F.col("S") / F.col("W") - (F.col("n") - 1) * out)
    return step.groupBy(*series).agg(
        F.round(100 * F.first("S") / F.first("W"), 4).alias("index_value"), F.round(F.sqrt(F.var_samp("pseudo") / F.count("pseudo")), 4).alias("standard_error"), F.count(F.lit(1)).alias("n_routes")
    )


#: Fixed by the draws: a prime and the steps of replications and draws. The fifth power permutes the numbers below the prime.
PRIME, REP_STEP, DRAW_STEP = 2147483647, 1103515245, 1640531527
REPLICATIONS = 2000


def cell_arrays(cells: DataFrame, cell: list[str], seed: int) -> DataFrame:
    """One row per cell: its carriers' prices as a sorted array ``v`` and the number ``c`` that its draws start from."""
    name = F.concat_ws("|", F.lit(seed).cast("string"), F.concat_ws("/", *[F.col(c).cast("string") for c in cell]))
    start = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % PRIME
    return cells.groupBy(*cell).agg(F.sort_array(F.collect_list("price")).alias("v")).withColumn("c", start)


def _means(v: np.ndarray, c: int, replications: int) -> np.ndarray:
    """Geometric means of the replications of one cell. Draws depend on the cell's number only, so they are the same whatever the partitions are."""
    n, logs, out = len(v), np.log(v), np.empty(replications)
    k = np.arange(1, n + 1, dtype=np.int64) * DRAW_STEP
    step = max(1, (1 << 18) // n)
    for a in range(0, replications, step):
        rep = np.arange(a + 1, min(replications, a + step) + 1, dtype=np.int64)[:, None] * REP_STEP
        x = (c + rep + k) % PRIME
        square = x * x % PRIME
        out[a : a + len(rep)] = logs[square * square % PRIME * x % PRIME * n // PRIME].mean(axis=1)
    return np.exp(out)


def _per_cell(arrays: DataFrame, cell: list[str], f, columns: str, rows: int) -> DataFrame:
    """``f(prices, start)`` for every cell in Arrow batches of ``rows`` cells: (cell, the columns it gives)."""
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values, starts = part.column("v"), part.column("c").to_numpy()
                got = [f(values[i].values.to_numpy(), int(starts[i])) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in cell), *(pa.array(x) for x in zip(*got, strict=True))], [*cell, *names])

    kinds = [f"{c} {arrays.schema[c].dataType.simpleString()}" for c in cell]
    return arrays.select(*cell, "v", "c").mapInArrow(run, ", ".join([*kinds, columns]))


def bootstrap_index(cells: DataFrame, weights: DataFrame, base: DataFrame, cell: list[str], series: list[str], replications: int = REPLICATIONS, seed: int = 7, level: float = 0.95, route: str = "route") -> DataFrame:
    """Bootstrap of the national index by series key: standard error, percentile interval (which holds the observed index), bias and normal interval.

    ``cells``: (cell, carrier, price) rows that survived the outlier filter; ``base``: (cell without dates, base price). The cells of a series key, one a route, meet before any replication
    is drawn, and their replications are added up in one array, so no replication is shuffled.
    """
    tail, kinds = (1 - level) / 2, [cells.schema[c] for c in series]
    names = ["n_routes", "replications", "mean", "mid", "sd", "lo", "hi", "seen"]

    def summed(group: pa.Table) -> pa.Table:
        prices, starts, shares, bases = group.column("v").to_pylist(), group.column("c").to_numpy(), group.column("weight").to_numpy(), group.column("base").to_numpy()
        drawn, seen = np.zeros(replications), 0.0
        for v, c, w, b in zip(prices, starts, shares, bases, strict=True):
            v = np.array(v)
            drawn += w / b * _means(v, int(c), replications)
            seen += w / b * float(np.exp(np.log(v).mean()))
        drawn, seen = 100 * drawn / shares.sum(), 100 * seen / shares.sum()
        lo, mid, hi = np.quantile(drawn, [tail, 0.5, 1 - tail])
        row = [len(prices), replications, drawn.mean(), mid, drawn.std(ddof=1) if replications > 1 else None, lo, hi, seen]
        return pa.table([*(group.column(c).slice(0, 1) for c in series), *([x] for x in row)], schema=pa.schema([*(group.schema.field(c) for c in series), *((n, pa.int64() if i < 2 else pa.float64()) for i, n in enumerate(names))]))

    rows = cell_arrays(cells, cell, seed).join(base, [c for c in base.columns if c != "base"]).join(weights.select(route, "weight"), route).where("base > 0")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kinds), *(f"{n} {'long' if i < 2 else 'double'}" for i, n in enumerate(names))])
    out = rows.select(*series, "v", "c", "weight", "base").groupBy(*series).applyInArrow(summed, schema)
    half = NormalDist().inv_cdf(1 - tail) * F.col("sd")
    columns = {"mean_index": F.col("mean"), "median_index": F.col("mid"), "standard_error": F.col("sd"), "ci_lower": F.least("lo", "seen"), "ci_upper": F.greatest("hi", "seen"), "observed_index": F.col("seen"), "bias": F.col("mean") - F.col("seen") + 0.0, "normal_lower": F.col("seen") - half, "normal_upper": F.col("seen") + half}
    return out.select(*series, "n_routes", "replications", *[F.round(c, 4).alias(name) for name, c in columns.items()])


def bootstrap_route(cells: DataFrame, base: DataFrame, cell: list[str], replications: int = REPLICATIONS, seed: int = 7, level: float = 0.95) -> DataFrame:
    """Bootstrap of every route's own index: one row per cell. A cell's replications stay in its row, so nothing is shuffled for them."""
    tail = (1 - level) / 2

    def summary(v, c):
        drawn = _means(v, c, replications)
        lo, hi = np.quantile(drawn, [tail, 1 - tail])
        seen = float(np.exp(np.log(v).mean()))
        return seen, float(drawn.mean()), float(drawn.std(ddof=1)), min(float(lo), seen), max(float(hi), seen)

    rows = _per_cell(cell_arrays(cells, cell, seed), cell, summary, "seen double, mean double, sd double, lo double, hi double", 4096)
    rows = rows.join(base, [c for c in base.columns if c != "base"]).where("base > 0")
    columns = {"observed_index": F.col("seen"), "mean_index": F.col("mean"), "standard_error": F.col("sd"), "ci_lower": F.col("lo"), "ci_upper": F.col("hi"), "bias": F.col("mean") - F.col("seen") + 0.0}
    return rows.select(*cell, *[F.round(100 * c / F.col("base"), 4).alias(name) for name, c in columns.items()])


def variance_sample(fares: DataFrame, **options) -> DataFrame:
    """The carrier prices that variance is estimated from: those that survive the outlier filter, with their cell."""
    from .cells import survivors

    return survivors(fares, **options).where("survives").drop("survives", "outlier_method")


def with_variance(prices: DataFrame, weights: DataFrame, method: str = "JACKKNIFE", series: list[str] = SERIES) -> DataFrame:
    """The index with the standard error of the named method (JACKKNIFE or NONE); null where it is undefined."""
    out = laspeyres(prices, weights, series)
    if method == "NONE":
        return out.withColumn("standard_error", F.lit(None).cast("double"))
    return out.join(jackknife(prices, weights, series).select(*series, "standard_error"), series)


def valid_cells(cells: DataFrame) -> DataFrame:
    """Cells that variance can use: a price and a base above 0."""
    return cells.where("price > 0 and base > 0")


def prefer_min(df: DataFrame, keys: list[str], preferred: Column, x: str) -> DataFrame:
    """The least x of the preferred rows, or of all where none is preferred."""
    return df.groupBy(*keys).agg(F.coalesce(F.min(F.when(preferred, F.col(x))), F.min(x)).alias(x))


def carrier_index(fares: DataFrame, weights: DataFrame, base_date, keys: list[str] | None = None, default_weight: float = 0.1) -> DataFrame:
    """Laspeyres index of every carrier: least fare per route, BASIC if there is one, against the base date's; weights renormalised."""
    keys = keys or ["carrier", "horizon", "obs_date"]
    fares = fares.where(F.coalesce("cabin", F.lit("ECONOMY")) == "ECONOMY")
    basic = fares.withColumn("__basic", F.coalesce(F.col("fare_family") == "BASIC", F.lit(False)))
    any_basic = F.coalesce(F.min(F.when(F.col("__basic") & F.col("__ok"), F.col("base_fare"))), F.when(~F.bool_or("__basic"), F.min(F.when(F.col("__ok"), F.col("base_fare")))))
    ok = (F.coalesce("status", F.lit("AVAILABLE")) == "AVAILABLE") & (F.col("base_fare") > 0)
    price = basic.withColumn("__ok", ok).groupBy(*keys, "route").agg(any_basic.alias("price")).where("price is not null")
    base = price.where(F.col("obs_date") == F.lit(base_date)).select(*[k for k in keys if k != "obs_date"], "route", F.col("price").alias("base"))
    rows = price.join(base, [*[k for k in keys if k != "obs_date"], "route"]).join(weights.select("route", "weight"), "route", "left").withColumn("w", F.coalesce("weight", F.lit(default_weight)))
    return rows.groupBy(*keys).agg(F.round(100 * F.sum(F.col("w") * F.col("price") / F.col("base")) / F.sum("w"), 4).alias("index_value"), F.count(F.lit(1)).alias("n_routes"))


def quality_of(all_routes: int, live: tuple = (90.0, 8), beta: tuple = (80.0, 6)) -> tuple[Column, Column]:
    """Score and status from the columns coverage, routes, feed, carriers and outliers."""
    hundred = lambda c: F.least(c, F.lit(100.0))
    score = F.col("coverage") * 0.3 + hundred(F.col("routes") * 100.0 / all_routes) * 0.2 + hundred(F.col("feed")) * 0.2 + hundred(F.col("carriers") * 10) * 0.15 + (100 - hundred(F.col("outliers") * 10.0)) * 0.15
    status = F.when((F.col("coverage") >= live[0]) & (F.col("routes") >= live[1]), "LIVE").when((F.col("coverage") >= beta[0]) & (F.col("routes") >= beta[1]), "BETA").otherwise("EXPERIMENTAL")
    return score, status


def index_quality(cells: DataFrame, index: DataFrame, series: list[str] = SERIES, all_routes: int = 10, live: tuple = (90.0, 8), beta: tuple = (80.0, 6)) -> DataFrame:
    """Quality score (0-100) and status of every index point, from the cell report."""
    per = cells.groupBy(*series).agg(F.count(F.lit(1)).alias("routes"), F.avg("carriers").alias("carriers"), F.avg("feed_quality").alias("feed"), F.sum("removed").alias("outliers"))
    score, status = quality_of(all_routes, live, beta)
    return index.join(per, series).select(*series, F.round(score, 1).alias("quality_score"), status.alias("index_status"), F.round("carriers", 1).alias("carrier_diversity"), "outliers")


def exact_lag(df: DataFrame, keys: list[str], date: str, x: str, days: int, out: str) -> DataFrame:
    """Column ``out``: the value exactly ``days`` earlier, null if there is none."""
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, -days)
    return df.withColumn(out, F.max(x).over(w))


def pct_changes(df: DataFrame, keys: list[str], date: str, x: str, lags: tuple = (1, 7, 30)) -> DataFrame:
    """Columns ``chg_<k>``: change in percent against the value exactly k days earlier."""
    for k in lags:
        df = exact_lag(df, keys, date, x, k, "__l")
        df = df.withColumn(f"chg_{k}", F.round(F.try_divide(100 * (F.col(x) - F.col("__l")), F.nullif(F.col("__l"), F.lit(0.0))), 4)).drop("__l")
    return df


def asof_prior(df: DataFrame, keys: list[str], date: str, x: str, days: int, out: str) -> DataFrame:
    """Column ``out``: the last value at or before ``days`` earlier."""
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, -days)
    return df.withColumn(out, F.last(x, ignorenulls=True).over(w))


def asof_change(df: DataFrame, keys: list[str], date: str, x: str, days: int) -> DataFrame:
    return asof_prior(df, keys, date, x, days, "__p").withColumn("asof_chg", F.round(F.try_divide(100 * (F.col(x) - F.col("__p")), F.nullif(F.col("__p"), F.lit(0.0))), 4)).drop("__p")


def moving_avg(df: DataFrame, keys: list[str], date: str, x: str, days: int = 28, min_n: int = 5) -> DataFrame:
    """Column ``moving_avg``: mean of the positive values of the last ``days`` calendar days; null with under ``min_n``."""
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(1 - days, 0)
    good = F.when(F.col(x) > 0, F.col(x))
    return df.withColumn("moving_avg", F.when(F.count(good).over(w) >= min_n, F.round(F.avg(good).over(w), 4)))


def carry_divisor(df: DataFrame, keys: list[str], date: str, divisor: str = "divisor") -> DataFrame:
    """Column ``carried``: the divisor of the day before, 1.0 where there is none."""
    return exact_lag(df, keys, date, divisor, 1, "__d").withColumn("carried", F.coalesce("__d", F.lit(1.0))).drop("__d")


def spot_window(df: DataFrame, date: str, first: int = 28, last: int = 3) -> DataFrame:
    return df.withColumn("spot_from", F.date_sub(date, first)).withColumn("spot_to", F.date_sub(date, last))


def continuity(df: DataFrame, keys: list[str], date: str, days: int = 14, min_n: int = 5) -> DataFrame:
    """Columns ``points`` and ``continuous``: how many points the ``days`` before have, without the day itself."""
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-days, -1)
    return df.withColumn("points", F.count(F.lit(1)).over(w)).withColumn("continuous", F.col("points") >= min_n)


def active_on(df: DataFrame, scd: DataFrame, date: str, key: str, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Rows with the version of their key that holds on their date; an open end holds on."""
    v = scd.select(F.col(key).alias("__k"), *[c for c in scd.columns if c != key])
    return df.join(v, (F.col(key) == F.col("__k")) & (F.col(start) <= F.col(date)) & (F.col(end).isNull() | (F.col(end) >= F.col(date)))).drop("__k")


def publish_weights(old: DataFrame, new: DataFrame, from_date: str, key: str = "route") -> DataFrame:
    """A new version of the weights: what is open ends the day before, versions that begin then are replaced, the new ones are added."""
    day = F.lit(from_date).cast("date")
    kept = old.where(~(F.col("effective_from") == day)).withColumn("effective_to", F.when(F.col("effective_to").isNull() & (F.col("effective_from") < day), F.date_sub(day, 1)).otherwise(F.col("effective_to")))
    return kept.unionByName(new.withColumn("effective_from", day).withColumn("effective_to", F.lit(None).cast("date")), allowMissingColumns=True)


def core_anchor(cells: DataFrame, calendar: DataFrame, base_date: str, date: str = "obs_date", days: int = 21, keys: list[str] | None = None, lead: int = 0) -> DataFrame:
    """Per observation date (and key) the day nearest to the base that is not in the calendar and not after that date; forward wins ties.

    With a ``lead`` it is the day so many days later, that of travel, which must not be in the calendar.
    """
    keys = keys or []
    have = cells.select(*keys, F.col(date).alias("day")).distinct().join(calendar.select(F.date_sub("day", lead).alias("day")).distinct(), "day", "left_anti")
    base = F.lit(base_date).cast("date")
    near = have.withColumn("off", F.datediff("day", base)).where(F.abs("off") <= days).withColumnsRenamed({c: f"__{c}" for c in keys})
    obs = cells.select(*keys, date).distinct()
    pick = F.min_by("day", F.struct(F.abs("off"), F.when(F.col("off") < 0, 1).otherwise(0)))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    on = reduce(lambda x, y: x & y, same, F.col("day") <= F.col(date))
    return obs.join(F.broadcast(near), on).groupBy(*keys, date).agg(pick.alias("anchor"))  # at most 2 x days + 1 rows a key


def core_guard(df: DataFrame, calendar: DataFrame, travel: str = "travel_date", status: str = "status", quality: str | None = None) -> DataFrame:
    """Without travel on peak days, rejected quotes, and flights sold out or cancelled."""
    df = df.where(~F.coalesce(F.upper(F.col(status)).isin("SOLD_OUT", "CANCELLED"), F.lit(False)))
    if quality:
        df = df.where(F.coalesce(F.col(quality) != "REJECT", F.lit(True)))
    return df.join(calendar.select(F.col("day").alias(travel)), travel, "left_anti")


def coverage_rollup(cells: DataFrame, route: str = "route") -> DataFrame:
    """Cells and observations by route, and of all (null route)."""
    return cells.rollup(route).agg(F.count(F.lit(1)).alias("cells"), F.sum("n_obs").alias("observations"))
