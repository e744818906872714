"""Joins: lookups, alignment of series, nearest-time matches and audits of sources against each other."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(fact: DataFrame, *dims: tuple[DataFrame, str]) -> DataFrame:
    """Inner joins with dimensions on their keys. Spark broadcasts those it finds small."""
    return reduce(lambda df, dim: df.join(dim[0], dim[1]), dims, fact)


def lookup_default(df: DataFrame, dim: DataFrame, key: str, value: str, default=None) -> DataFrame:
    out = df.join(dim.select(key, value), key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))


def compare_series(a: DataFrame, b: DataFrame, on: list[str], x: str = "value") -> DataFrame:
    """Full outer join: both values, the gap and the gap in percent of b."""
    both = a.select(*on, F.col(x).alias("a")).join(b.select(*on, F.col(x).alias("b")), on, "full_outer")
    return both.withColumn("gap", F.round(F.col("a") - F.col("b"), 4)).withColumn("gap_pct", F.round(100 * (F.col("a") - F.col("b")) / F.nullif(F.col("b"), F.lit(0.0)), 4))


def align(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on)


def pair_cohorts(df: DataFrame, cohort: str, on: list[str], x: str, one: str, two: str) -> DataFrame:
    """Mean of x in two cohorts, where both have rows, in one grouped pass."""
    m = lambda c: F.avg(F.when(F.col(cohort) == c, F.col(x)))
    return df.where(F.col(cohort).isin(one, two)).groupBy(*on).agg(m(one).alias("a"), m(two).alias("b")).where("a is not null and b is not null")


def _greedy(left, right, tol: int):
    """Pairs (lid, rid, delta) of one key, least (delta, lid, rid) first, until no pair is left.

    Quotes wait in one queue per minute, so no list of pairs is made: a left quote takes the head of a right queue.
    """
    import heapq
    from collections import defaultdict, deque

    def queues(side, ids):
        q = defaultdict(deque)
        for k, i in sorted(zip(side["minutes"], side[ids]), key=lambda x: x[1]):
            q[k].append(i)
        return q

    a, b = queues(left, "lid"), queues(right, "rid")
    tiers, slots, out = defaultdict(lambda: defaultdict(list)), sorted(b), []
    for m in a:
        for k in slots[bisect_left(slots, m - tol) : bisect_right(slots, m + tol)]:
            tiers[abs(m - k)][m].append(k)
    for delta in sorted(tiers):  # left quotes come by id over all queues, each takes the least right id that is ``delta`` away
        links = tiers[delta]
        heads = [(a[k][0], k) for k in links if a[k]]
        heapq.heapify(heads)
        while heads:
            lid, k = heads[0]
            near = [b[x] for x in links[k] if b[x]]
            if not near:
                heapq.heappop(heads)
                continue
            out.append((lid, min(near, key=lambda q: q[0]).popleft(), float(delta)))
            a[k].popleft()
            heapq.heapreplace(heads, (a[k][0], k)) if a[k] else heapq.heappop(heads)
    return out


def _pair_off(rows: DataFrame, by: list[str]) -> DataFrame:
    """Pair the k-th single left row of each ``by`` with the k-th single right one, by id; other rows, and those with a null in ``by``, stay as they are.

    Rows are numbered by a sort, and the pairs are grouped by number as well, so a frequent value is spread again.
    """
    open_ = reduce(and_, [F.col(c).isNotNull() for c in by], F.col("lid").isNull() | F.col("rid").isNull())
    rows = rows.withColumn("__left", F.col("rid").isNull()).withColumn("__open", open_)
    number = F.row_number().over(Window.partitionBy(*by, "__open", "__left").orderBy("lid", "rid"))
    # a row that can't pair is a group of its own
    rows = rows.withColumn("__n", F.when(F.col("__open"), number)).withColumn("__l", F.when(~F.col("__open"), F.col("lid"))).withColumn("__r", F.when(~F.col("__open"), F.col("rid")))
    rest = [F.max(c).alias(c) for c in rows.columns if c not in by and not c.startswith("__")]
    return rows.groupBy(*by, "__open", "__n", "__l", "__r").agg(*rest).drop("__open", "__n", "__l", "__r")


#: Islands of a key that are matched together.
ISLANDS = 64


def islands(rows: DataFrame, keys: list[str], x: str, gap: float, out: str = "island") -> DataFrame:
    """Column ``out``: numbers the runs of a key's values in which no two neighbours are more than ``gap`` apart; rows without a value are left out.

    Values are dealt into buckets as wide as the gap, within which no run can end; the least and greatest of each bucket tell where one does. So the
    order of a key is kept over its buckets, not over its rows, and a hot key is never sorted as a whole.
    """
    width = max(float(gap), 1e-9)
    rows = rows.where(F.col(x).isNotNull()).withColumn("__bucket", F.floor(F.col(x) / width))
    spans = rows.groupBy(*keys, "__bucket").agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    w = Window.partitionBy(*keys).orderBy("__bucket")
    runs = spans.withColumn(out, F.sum(F.coalesce((F.col("__lo") - F.lag("__hi").over(w) > gap).cast("long"), F.lit(0))).over(w))
    runs = runs.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("__bucket").alias("__b"), out)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return rows.join(runs, reduce(and_, same, F.col("__bucket") == F.col("__b"))).drop("__bucket", "__b", *[f"__{c}" for c in keys])


def match_nearest(left: DataFrame, right: DataFrame, key: list[str], minutes: str, tol: int = 35, lid: str = "lid", rid: str = "rid", exact: str | None = None) -> DataFrame:
    """One-to-one matches (lid, rid, delta): equal ``exact`` columns first, then pairs that are each other's nearest by (delta, ids), until none is left.

    Rows with a null key match nothing, malformed times (null, NaN or below 0) match by ``exact`` only. An id names one row. Equal ``exact`` values and equal
    times are paired by number, in order of the ids. Of each minute only one side is left then; a key's quotes are cut into ``islands`` wherever more than the tolerance lies
    between neighbours, as these can't match each other, and ISLANDS of them are matched in a task, without their pairs.
    """
    import pandas as pd

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    keys = [f"k{i}" for i in range(len(key))]

    def side(df, name, to):
        x = F.col(exact) if exact else F.lit(None).cast("string")
        x = F.nanvl(x, F.lit(None)) if exact and kind(df, exact) in ("double", "float") else x
        time = F.col(minutes).cast("double")
        rows = df.dropna(subset=key).select(*[F.col(c).alias(k) for c, k in zip(key, keys, strict=True)], x.alias("x"), F.when((time >= 0) & ~F.isnan(time), time).alias("minutes"), F.col(name).alias(to))
        return rows.where(F.col(to).isNotNull())

    rows = side(left, lid, "lid").unionByName(side(right, rid, "rid"), allowMissingColumns=True)
    if exact:
        rows = _pair_off(rows, [*keys, "x"])
    rows = _pair_off(rows.drop("x"), [*keys, "minutes"])
    paired = F.col("lid").isNotNull() & F.col("rid").isNotNull()

    # What is left of ``rows`` is told by the result of the pairing, not by the times, so that all uses of ``rows`` share one exchange.
    free = islands(rows.select(*keys, F.when(~paired, F.col("minutes")).alias("minutes"), "lid", "rid"), keys, "minutes", tol)
    free = free.withColumn("__group", F.floor(F.col("island") / ISLANDS))

    # Ids stay what they are: a null among integers would make pandas take them for floats.
    whole = lambda c, df, name: F.coalesce(c, F.lit(0).cast(kind(df, name))).alias(c)
    free = free.select(*keys, "__group", "minutes", F.col("lid").isNotNull().alias("is_left"), whole("lid", left, lid), whole("rid", right, rid))

    def match(pdf):
        return pd.DataFrame(_greedy(pdf[pdf["is_left"]], pdf[~pdf["is_left"]], tol), columns=["lid", "rid", "delta"])

    near = free.groupBy(*keys, "__group").applyInPandas(match, f"lid {kind(left, lid)}, rid {kind(right, rid)}, delta double")
    pairs = rows.where(paired).select("lid", "rid", F.lit(0.0).alias("delta")).unionByName(near)
    return pairs.select("lid", "rid", F.col("delta").cast(left.schema[minutes].dataType).alias("delta"))


def nearest_min(left: DataFrame, right: DataFrame, key: list[str], minutes: str, price: str, tol: int = 25, lid: str = "lid", rid: str = "rid", band: float = 0.15) -> DataFrame:
    """Many-to-one: the least right price at the nearest slot, and whether the left price is within ``band`` of it.

    Quotes of one time are one slot, with its least price, before slots meet, so no pairs of quotes are made. A right slot is dealt to the time bucket, as wide as the
    tolerance, that it is in and the two beside it; within a bucket the last slot before a left one and the first after it are all that it can take.
    """
    keys = [f"k{i}" for i in range(len(key))]
    named = [F.col(c).alias(k) for c, k in zip(key, keys, strict=True)]
    bucket = F.floor(F.col("minutes") / tol)
    side = lambda df, i: df.dropna(subset=[*key, i]).where(F.col(minutes) >= 0)
    a = side(left, lid).select(*named, F.col(minutes).alias("minutes"), F.col(lid).alias("lid"), F.col(price).alias("lp"))
    b = side(right, rid).select(*named, F.col(minutes).alias("minutes"), F.col(price).alias("rp")).groupBy(*keys, "minutes").agg(F.min("rp").alias("rp"))
    asked = a.select(*keys, "minutes").distinct().withColumn("__b", bucket).withColumn("slot", F.lit(None).cast(b.select(F.struct("minutes", "rp").alias("x")).schema[0].dataType))
    given = b.select(*keys, "minutes", F.explode(F.array(*[bucket + i for i in (-1, 0, 1)])).alias("__b"), F.struct("minutes", "rp").alias("slot"))
    w = Window.partitionBy(*keys, "__b").rowsBetween(Window.unboundedPreceding, 0)
    # right slots come first among equal times going up, and going down the slot of the same time has been met already
    near = lambda order: F.last("slot", ignorenulls=True).over(w.orderBy(order, F.col("slot").isNull()))
    slots = asked.unionByName(given).withColumn("__before", near(F.col("minutes"))).withColumn("__after", near(F.col("minutes").desc())).where("slot is null")
    gap = lambda c: F.when(F.abs(F.col("minutes") - F.col(c)["minutes"]) <= tol, F.struct(F.abs(F.col("minutes") - F.col(c)["minutes"]).alias("delta"), F.col(c)["rp"].alias("rp")))
    best = slots.select(*keys, "minutes", F.least(gap("__before"), gap("__after")).alias("m")).where("m is not null")
    diff = (F.col("lp") - F.col("m.rp")) / F.col("m.rp")
    return a.join(best, [*keys, "minutes"]).select("lid", F.col("m.delta").alias("delta"), F.round("m.rp", 4).alias("price"), F.when(F.abs(diff) <= band, "MATCH").when(diff > 0, "HIGHER").otherwise("LOWER").alias("label"))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def parity_status(direct: Column, other: Column, tol: float = 50.0) -> Column:
    d = other - direct
    return F.when(F.abs(d) <= tol, "EXACT_PARITY").when(d > tol, "AGGREGATOR_MARKUP").when(d < -tol, "AGGREGATOR_DISCOUNT")


def reconcile(direct: DataFrame, fallback: DataFrame, key: list[str], minutes: str, price: str, exact: str, lid: str = "lid", rid: str = "rid", tol: int = 35, parity: float = 50.0, direct_only: bool = False) -> DataFrame:
    """Audits of matched quotes (status by the difference), then fallback quotes that no direct quote matches, with ``direct_only`` also direct quotes that no fallback quote matches."""
    m = match_nearest(direct, fallback, key, minutes, tol, lid, rid, exact)
    a = m.join(direct.select(F.col(lid).alias("lid"), F.col(price).alias("lp")), "lid").join(fallback.select(F.col(rid).alias("rid"), F.col(price).alias("rp")), "rid")
    audits = a.select("lid", "rid", F.round(F.col("rp") - F.col("lp"), 2).alias("difference"), F.round(100 * F.abs(F.col("rp") - F.col("lp")) / F.nullif(F.col("lp"), F.lit(0.0)), 2).alias("difference_pct"), parity_status(F.col("lp"), F.col("rp"), parity).alias("status"))
    rest = fallback.select(F.col(rid).alias("rid")).join(m.select("rid"), "rid", "left_anti").withColumn("status", F.lit("FALLBACK_RPC_USED"))
    audits = audits.unionByName(rest, allowMissingColumns=True)
    if direct_only:
        alone = direct.select(F.col(lid).alias("lid")).join(m.select("lid"), "lid", "left_anti").withColumn("status", F.lit("DIRECT_ONLY"))
        audits = audits.unionByName(alone, allowMissingColumns=True)
    return audits


def reconciliation_score(audits: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return audits.agg(F.count(F.lit(1)).alias("total"), n("EXACT_PARITY").alias("parity"), n("AGGREGATOR_MARKUP").alias("markup"), n("AGGREGATOR_DISCOUNT").alias("discount"), n("FALLBACK_RPC_USED").alias("fallback"), F.round(F.avg("difference_pct"), 2).alias("avg_difference_pct"))


def parity_report(audits: DataFrame) -> DataFrame:
    seen = F.count_if(~F.col("status").isin("FALLBACK_RPC_USED", "DIRECT_ONLY"))
    return audits.agg(seen.alias("compared"), F.round(100 * F.count_if(F.col("status") == "EXACT_PARITY") / F.nullif(seen, F.lit(0)), 2).alias("parity_rate"))


def one_per_source(df: DataFrame, cluster: list[str], source: str, order: list[str]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*cluster, source).orderBy(*order))).where("__r = 1").drop("__r")


def pairs_vs_reference(df: DataFrame, cluster: list[str], source: str, price: str, reference: Column, order: list[str]) -> DataFrame:
    """Each source of a cluster against the reference source (the best by ``reference``, then by name): difference in price."""
    rows = one_per_source(df, cluster, source, order)
    ref = F.min(F.struct(reference.alias("o"), F.col(source).alias("s"), F.col(price).alias("p"))).over(Window.partitionBy(*cluster))
    rows = rows.withColumn("__ref", ref).where(F.col(source) != F.col("__ref.s"))
    return rows.select(*cluster, F.col("__ref.s").alias("reference"), source, F.round(F.col(price) - F.col("__ref.p"), 4).alias("difference"))


def source_pair_audit(df: DataFrame, cluster: list[str], source: str, price: str, reference: Column, order: list[str], tol: float = 50.0) -> DataFrame:
    rows = pairs_vs_reference(df, cluster, source, price, reference, order)
    d = F.col("difference")
    return rows.withColumn("status", F.when(F.abs(d) <= tol, "PARITY").when(d > 0, "MARKUP").otherwise("DISCOUNT"))


def markup_report(audits: DataFrame, source: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return audits.groupBy("reference", source).agg(F.count(F.lit(1)).alias("pairs"), n("PARITY").alias("parity"), n("MARKUP").alias("markup"), n("DISCOUNT").alias("discount"), F.round(F.avg("difference"), 4).alias("avg_markup"))


def near_event(df: DataFrame, calendar: DataFrame, date: str, days: int = 3) -> DataFrame:
    """Column ``event_day``: the earliest calendar day within ``days``. The calendar is spread over its days, so it is an equi-join."""
    spread = calendar.select(F.col("day").alias("event_day"), F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("__d")).groupBy("__d").agg(F.min("event_day").alias("event_day"))
    return df.join(spread, F.col(date) == F.col("__d"), "left").drop("__d")


def mature(snapshots: DataFrame, realised: DataFrame, keys: list[str], target: str, day: str, x: str) -> DataFrame:
    """Forecasts whose target date has come, with the realised value."""
    return snapshots.join(realised.select(*keys, F.col(day).alias(target), F.col(x).alias("actual")), [*keys, target])


def missing_work(routes: DataFrame, horizons: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The grid of routes and horizons without what is done. The grid is the result's own size."""
    return routes.crossJoin(horizons).join(done.select(*keys), keys, "left_anti")


def collection_progress(routes: DataFrame, horizons: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    grid = routes.crossJoin(horizons).agg(F.count(F.lit(1)).alias("expected"))
    got = done.select(*keys).distinct().agg(F.count(F.lit(1)).alias("completed"))
    return grid.crossJoin(got).withColumn("progress_pct", F.round(100 * F.col("completed") / F.nullif(F.col("expected"), F.lit(0)), 2))  # one row each


def overlay(a: DataFrame, b: DataFrame, date: str, x: str, y: str) -> DataFrame:
    return a.select(date, x).join(b.select(date, y), date, "left")


def asof_join(df: DataFrame, other: DataFrame, keys: list[str], date: str, x: str, out: str, span: int = 64) -> DataFrame:
    """Rows of ``df`` with ``out``, the last ``x`` of ``other`` at or before their day by ``keys`` (none: one series for all), and ``<out>_age``, its days since.

    Days are dealt into spans, so that a key, or no key at all, is many tasks: within a span both tables are put in order together and the last value runs on; a span without an
    earlier value takes the last one of the spans before it. Of several values of a day the greatest counts; null values and null days of ``other`` don't. Rows without a day get null.
    """
    day = F.datediff(F.col(date), F.lit("1970-01-01"))
    span_of = F.floor(F.col("__day") / span)
    mine = [f"__k{i}" for i in range(len(keys))]
    keyed = lambda t: [F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)] if t else mine
    left = df.select(*keyed(True), day.alias("__day"), F.struct("*").alias("__row")).withColumn("__span", span_of)
    right = other.select(*keyed(True), day.alias("__day"), F.col(x).alias("__x")).where("__day is not null and __x is not null").withColumn("__span", span_of)
    value = F.struct(F.col("__day").alias("day"), F.col("__x").alias("x"))
    part = [*mine, "__span"]
    both = left.select(*part, "__day", "__row", F.lit(None).cast(right.select(value).schema[0].dataType).alias("__v"), F.lit(1).alias("__side"))
    both = both.unionByName(right.select(*part, "__day", F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), value.alias("__v"), F.lit(0).alias("__side")))
    near = F.last("__v", ignorenulls=True).over(Window.partitionBy(*part).orderBy("__day", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0))
    near_rows = both.withColumn("__near", near).where("__side = 1")
    # One row a key and span: the last value of the spans before.
    tops = right.groupBy(*part).agg(F.max(value).alias("__top"))
    tops = tops.unionByName(left.select(*part).distinct(), allowMissingColumns=True).groupBy(*part).agg(F.max("__top").alias("__top"))
    before = F.last("__top", ignorenulls=True).over(Window.partitionBy(*mine).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    carried = tops.withColumn("__before", before).select(*[F.col(c).alias(f"{c}_") for c in part], "__before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in part])
    found = near_rows.join(carried, same, "left").withColumn("__hit", F.coalesce("__near", "__before"))
    return found.select("__row.*", F.when(F.col("__day").isNotNull(), F.col("__hit.x")).alias(out), (F.col("__day") - F.col("__hit.day")).alias(f"{out}_age"))


def with_data(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    return dim.join(fact.select(key), key, "left_semi")


def month_compare(a: DataFrame, b: DataFrame, month: str = "month", x: str = "value") -> DataFrame:
    """Months of both series with their deviation in percent, or which side lacks them."""
    both = compare_series(a, b, [month], x)
    side = F.when(F.col("a").isNull(), "A").when(F.col("b").isNull(), "B")
    return both.select(month, F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.col("gap_pct").alias("deviation_pct"), side.alias("missing"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose keys (null equals null) it doesn't have."""
    n = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return old.join(n, on, "left_anti").unionByName(new, allowMissingColumns=True)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def all_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def missing_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def combos(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def timeline(history: DataFrame, forecast: DataFrame) -> DataFrame:
    return history.withColumn("type", F.lit("OBSERVED")).unionByName(forecast.withColumn("type", F.lit("FORECAST")), allowMissingColumns=True)


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).where("__r = 1").drop("__r")


def top_n_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def sort_nulls_first(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.orderBy(*[F.asc_nulls_first(c) for c in cols])


def last_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows in ascending order."""
    return df.orderBy(*[F.desc(o) for o in order]).limit(n).orderBy(*order)


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """One page of the ordered rows, with the count of all."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def top_recent(df: DataFrame, order: list[str], k: int = 50) -> DataFrame:
    return df.orderBy(*[F.desc(o) for o in order]).limit(k)


def rank_by(df: DataFrame, x: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(x), *ties)


def where_any(df: DataFrame, **criteria) -> DataFrame:
    """Only the criteria that are not None: ``c=value``, ``c_from=``, ``c_to=``."""
    for name, value in criteria.items():
        if value is None:
            continue
        if name.endswith("_from"):
            df = df.where(F.col(name[:-5]) >= value)
        elif name.endswith("_to"):
            df = df.where(F.col(name[:-3]) <= value)
        else:
            df = df.where(F.col(name) == value)
    return df


def where_in(df: DataFrame, col: str, csv: str) -> DataFrame:
    return df.where(F.col(col).isin([x.strip() for x in csv.split(",") if x.strip()]))


def where_day(df: DataFrame, ts: str, day) -> DataFrame:
    d = F.lit(day).cast("date")
    return df.where((F.col(ts) >= d.cast("timestamp")) & (F.col(ts) < F.date_add(d, 1).cast("timestamp")))


def where_finite(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(F.col(col)) != float("inf")))


def national(df: DataFrame, route: str = "route") -> DataFrame:
    return df.where(F.col(route).isNull())


def where_band(df: DataFrame, col: str, lo: float = 1500.0, hi: float = 60000.0) -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def drop_synthetic(df: DataFrame, feed: str = "feed_type") -> DataFrame:
    return df.where(~F.coalesce(F.col(feed).isin("SYNTHETIC_BASELINE", "CALIBRATED_BASELINE"), F.lit(False)))
