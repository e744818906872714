"""Extraction from card texts, tokens and JSON payloads, as column jobs."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

# Fixed patterns.
PRICE = r"(?:₹|INR|Rs\.?)\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
PAIR = r"\b([A-Z]{3})\s*(?:-|–|→|to)\s*([A-Z]{3})\b"
FLIGHT = r"\b([A-Z0-9]{2})[- ]?([0-9]{3,4})\b"
TIME = r"\b([01]?[0-9]|2[0-3]):([0-5][0-9])\b"
STOPS = r"(?i)([0-9]+)\s*stops?"
DURATION = r"([0-9]{1,2})\s*h(?:\s*([0-9]{1,2})\s*m)?"
DATES = r"([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[- ][A-Z][a-z]{2}[- ][0-9]{4}|[A-Z][a-z]{2} [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} [A-Z][a-z]{2}\b|[A-Z][a-z]{2} [0-9]{1,2}\b)"
PRICE_KEYS = ["fareamount", "totalfare", "totalprice", "grandtotal", "totalamount"]


def card_fields(df: DataFrame, text: str) -> DataFrame:
    """Least price, route, flight, times, stops and minutes of a card; null where the text has none."""
    t = F.col(text)
    opt = lambda rx, i: F.nullif(F.regexp_extract(t, rx, i), F.lit(""))
    prices = F.transform(F.regexp_extract_all(text, F.lit(PRICE), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    times = F.regexp_extract_all(text, F.lit(TIME), 0)
    stops = F.when(t.rlike("(?i)non-?stop|direct"), 0).otherwise(opt(STOPS, 1).try_cast("int"))
    minutes = opt(DURATION, 1).try_cast("int") * 60 + F.coalesce(opt(DURATION, 2).try_cast("int"), F.lit(0))
    return df.withColumns({
        "price": F.array_min(prices), "origin": opt(PAIR, 1), "destination": opt(PAIR, 2), "flight": F.when(t.rlike(FLIGHT), F.concat_ws("-", opt(FLIGHT, 1), opt(FLIGHT, 2))),
        "departs": F.get(times, F.lit(0)), "arrives": F.get(times, F.lit(1)), "stops": stops, "minutes": minutes,
    })


def card_dates(df: DataFrame, text: str, ref: str | Column) -> DataFrame:
    """First and second date of a text. A date without a year is in the reference's year, or the next if that lies before the reference by more than a day."""
    ref = F.col(ref) if isinstance(ref, str) else ref

    def parse(s: Column) -> Column:
        s = F.replace(F.replace(s, F.lit(","), F.lit("")), F.lit("-"), F.lit(" "))
        full = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in ("yyyy MM dd", "d MMM yyyy", "MMM d yyyy")])
        short = lambda y: F.coalesce(*[F.try_to_timestamp(F.concat_ws(" ", s, y.cast("string")), F.lit(f)).cast("date") for f in ("d MMM yyyy", "MMM d yyyy")])
        here = short(F.year(ref))
        return F.coalesce(full, F.when(here < F.date_sub(ref, 1), short(F.year(ref) + 1)).otherwise(here))

    found = F.regexp_extract_all(text, F.lit(DATES), 1)
    return df.withColumn("__f", found).withColumn("travel_date", parse(F.get("__f", F.lit(0)))).withColumn("return_date", parse(F.get("__f", F.lit(1)))).drop("__f")


def cluster_tokens(tokens: DataFrame, page: str, floor: float = 12.0, factor: float = 1.8) -> DataFrame:
    """Tokens of a page as cards: a vertical gap over max(floor, factor x median height) begins a new one; text in reading order."""
    # A task for each shuffle partition: tasks that are sized by compressed bytes hold too many of these narrow rows.
    tokens = tokens.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), page)
    w = Window.partitionBy(page)
    order = w.orderBy("y1", "x1")
    # The ordered window comes first, so that its sort serves all three.
    rows = tokens.withColumn("__below", F.max("y2").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__h", F.median(F.col("y2") - F.col("y1")).over(w))
    new = F.coalesce((F.col("y1") - F.col("__below") > F.greatest(F.lit(floor), factor * F.col("__h"))).cast("int"), F.lit(0))
    rows = rows.withColumn("card", F.sum(new).over(order))
    items = F.sort_array(F.collect_list(F.struct("y1", "x1", "text")))
    return rows.groupBy(page, "card").agg(F.array_join(F.transform(items, lambda i: i["text"]), " ").alias("text"), F.count(F.lit(1)).alias("tokens"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def read_word_rows(spark, path: str) -> DataFrame:
    """Word rows (level 5) of a layout TSV as tokens with scores between 0 and 1."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    num = lambda c: F.col(c).try_cast("double")
    return rows.where("level = '5' and trim(text) <> ''").select(num("page_num").cast("long").alias("page"), "text", num("left").alias("x1"), num("top").alias("y1"), (num("left") + num("width")).alias("x2"), (num("top") + num("height")).alias("y2"), (num("conf") / 100).alias("score"))


def json_pairs(payload: str | None) -> Iterator[tuple[str, object]]:
    """Every (key, value) of a JSON text's objects at any depth, an object's key before what is within its value; nothing if the text is no JSON."""
    try:
        todo = [json.loads(payload)] if payload is not None else []
    except (ValueError, RecursionError):
        return
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            yield node
            node = node[1]
        if isinstance(node, dict):
            todo.extend(reversed(node.items()))
        elif isinstance(node, list):
            todo.extend(reversed(node))


def _from_payloads(df: DataFrame, payload: str, find, name: str, kind: str) -> DataFrame:
    """The rows of ``df`` without ``payload``, repeated for each value that ``find(payload)`` gives, which is in column ``name``. One scan in Arrow batches, however deep the payloads are."""
    base = [c for c in df.columns if c != payload]
    schema = StructType([*(df.schema[c] for c in base), StructField(name, _parse_datatype_string(kind))])
    value = to_arrow_type(schema[name].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(find(p)) for p in batch.column(len(base)).to_pylist()]
            rows = batch.select(base).take(pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())) if base else None
            values = pa.array([v for f in found for v in f], value)
            yield pa.RecordBatch.from_arrays([*(rows.columns if rows is not None else []), values], [*base, name])

    return df.select(*base, payload).mapInArrow(run, schema)


def json_values(df: DataFrame, payload: str, key: str, most: int | None = None) -> DataFrame:
    """Every value under ``key`` at any level, as text, in the order of the payload: one row each, at most ``most`` (None: all) a payload. A null is the text null."""

    def find(p):
        hits = (v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in json_pairs(p) if k == key)
        return islice(hits, most)

    return _from_payloads(df, payload, find, "value", "string")


def json_prices(df: DataFrame, payload: str, id_: str, lo: float = 1500.0, hi: float = 60000.0, n: int = 6, keys: Sequence[str] = PRICE_KEYS) -> DataFrame:
    """Distinct numbers within a band under known keys (of any case, at any level), the n least per payload with their rank. Numbers in quotes are texts and don't count."""
    known = frozenset(k.lower() for k in keys)

    def find(p):
        prices = {float(v) for k, v in json_pairs(p) if k.lower() in known and isinstance(v, (int, float)) and not isinstance(v, bool) and lo <= v <= hi}
        return [{"rank": i, "price": x} for i, x in enumerate(sorted(prices)[:n])]

    return _from_payloads(df.select(id_, payload), payload, find, "found", "struct<rank:int,price:double>").select(id_, "found.*")


AVAILABILITY = "struct<trips:array<struct<journeys:array<struct<flight:string,departure:string,fares:array<struct<key:string,seats:int>>>>>>,catalog:map<string,double>>"
OFFERS = "struct<offers:array<struct<total:double,seats:int,flights:array<struct<flight:string,departure:string>>>>>"


def flatten_availability(df: DataFrame, payload: str, id_: str) -> DataFrame:
    """Trips, journeys and fares of a payload: the cheapest catalogued fare of every journey."""
    rows = df.select(id_, F.from_json(payload, AVAILABILITY).alias("p")).select(id_, "p.catalog", F.explode("p.trips").alias("t")).select(id_, "catalog", F.posexplode("t.journeys").alias("i", "j"))
    fares = rows.select(id_, "j.flight", "j.departure", "catalog", F.explode("j.fares").alias("f")).withColumn("price", F.element_at("catalog", F.col("f.key"))).where("price is not null")
    return fares.groupBy(id_, "flight", "departure").agg(F.min("price").alias("price"), F.min_by("f.seats", "price").alias("seats"))


def flatten_offers(df: DataFrame, payload: str, id_: str, lo: float = 1500.0, hi: float = 60000.0) -> DataFrame:
    """Offers and flights of a payload within the price band, the cheapest per flight and departure; no seats is sold out."""
    rows = df.select(id_, F.from_json(payload, OFFERS).alias("p")).select(id_, F.explode("p.offers").alias("o")).where(F.col("o.total").between(lo, hi))
    flights = rows.select(id_, F.col("o.total").alias("price"), F.col("o.seats").alias("seats"), F.explode("o.flights").alias("f"))
    best = flights.groupBy(id_, F.col("f.flight").alias("flight"), F.col("f.departure").alias("departure")).agg(F.min("price").alias("price"), F.min_by("seats", "price").alias("seats"))
    return best.withColumn("availability_status", F.when(F.col("seats") == 0, "SOLD_OUT").otherwise("AVAILABLE"))
