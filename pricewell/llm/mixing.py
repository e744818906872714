"""Mixing sources to target weights by hierarchical budgeting (operator 4).

Leaves are sources within a language within a domain. A token budget is shared out from the root by weights; no node gets more than its
leaves hold over ``max_epochs`` epochs. What a node cannot take goes to its siblings by their weights, and only when all
of them are full to the siblings of its ancestors. Each leaf then reads its documents epoch by epoch in an order seeded by
(seed, epoch, key): whole epochs first, then the longest prefix of the last one that fits its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, words

LEAF = ["domain", "lang", "source"]
DOMAINS = {"d0": 0.4, "d1": 0.3, "d2": 0.2, "d3": 0.1}
LANGUAGES = {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1}
#: Documents of a leaf that are put in order together.
RUN_DOCS = 1000


def source_domain(source: Column, domains: int = 4) -> Column:
    """``d`` and the number at the end of the source's name modulo ``domains``; sources without a number are in ``d0``."""
    digits = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.coalesce(F.when(digits != "", digits.cast("bigint")), F.lit(0)) % domains)


def _weight(column: str, weights: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, w in weights.items():
        out = F.when(F.col(column) == name, float(w)).otherwise(out)
    return out


def share_out(nodes: DataFrame, parent: list[str], node: str, weight: str, capacity: str, budget: str, out: str) -> DataFrame:
    """Column ``out``: each sibling's part of the parent's budget, by weight, none above its capacity.

    A part is ``min(capacity, weight * level)``. With siblings by capacity / weight, the level is the greatest of (budget less
    the capacities before) / (weights from here on).
    """
    group = Window.partitionBy(*[F.coalesce(p, F.lit("")) for p in parent]) if parent else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.try_divide(F.col(capacity), F.col(weight)).asc_nulls_first(), node)
    before = F.coalesce(F.sum(capacity).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    step = nodes.where(F.col(weight) > 0).withColumn("__level", (F.col(budget) - before) / after)
    return step.withColumn(out, F.greatest(F.lit(0.0), F.least(F.col(capacity), F.col(weight) * F.max("__level").over(group)))).drop("__level")


def _leaf_columns(docs: DataFrame, key: str, text: str, lang: str, source: str, *more: Column) -> DataFrame:
    named = docs.select(F.col(key).alias("k"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.size(words(F.col(text))).cast("long").alias("n_tokens"), *more)
    return named.withColumn("domain", source_domain(F.col("source")))


def _plan(rows: DataFrame, fraction: float, max_epochs: int, domains: dict[str, float], languages: dict[str, float], sources: dict[str, float] | None) -> tuple[DataFrame, DataFrame]:
    """Token counts of the documents, and every leaf's budget as whole epochs and a rest."""
    stats = keep(rows, "tokens")
    leaves = stats.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = leaves.select(
        *LEAF, "tokens", "docs",
        (F.col("tokens") * float(max_epochs)).alias("c3"), _weight("source", sources or {}, 1.0).alias("w3"), _weight("lang", languages, 0.0).alias("w2"), _weight("domain", domains, 0.0).alias("w1"),
    )
    leaves = keep(leaves, "leaves")
    usable = leaves.where("w1 > 0 and w2 > 0 and w3 > 0")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    d = usable.groupBy("domain").agg(F.sum("c3").alias("c"), F.max("w1").alias("w")).withColumn("b", F.lit(float(total) * fraction))
    d = share_out(d, [], "domain", "w", "c", "b", "b1").select("domain", "b1")
    lg = usable.groupBy("domain", "lang").agg(F.sum("c3").alias("c"), F.max("w2").alias("w")).join(d, "domain")
    lg = share_out(lg, ["domain"], "lang", "w", "c", "b1", "b2").select("domain", "lang", "b2")
    leaf = share_out(usable.join(lg, ["domain", "lang"]), ["domain", "lang"], "source", "w3", "c3", "b2", "b3")
    budget = F.floor(F.col("b3") + 1e-6).cast("long")
    plan = keep(
        leaf.select(*LEAF, budget.alias("budget"), F.when(F.col("tokens") > 0, budget % F.col("tokens")).otherwise(0).alias("rest"), F.when(F.col("tokens") > 0, F.floor(budget / F.col("tokens"))).otherwise(1).cast("int").alias("epochs"), F.greatest(F.lit(1), F.ceil(F.col("docs") / RUN_DOCS)).alias("runs")),
        "plan",
    )
    return stats, plan


def mix(
    docs: DataFrame,
    fraction: float = 0.5,
    max_epochs: int = 2,
    seed: int = 7,
    domains: dict[str, float] = DOMAINS,
    languages: dict[str, float] = LANGUAGES,
    sources: dict[str, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """One row per selected document and epoch: key, domain, lang, source, n_tokens, epoch.

    The budget is ``fraction`` of all tokens (words of the whole text). Names that ``domains`` or ``languages`` don't hold have weight 0,
    sources that ``sources`` doesn't hold 1; weight 0 selects nothing. Null and empty texts have no tokens and cost nothing. A null
    language or source is a node named ''. Repeated rows are documents of their own; rows of one key
    follow each other. An empty table gives an empty result. Further columns are not read.
    """
    stats, plan = _plan(_leaf_columns(docs, key, text, lang, source), fraction, max_epochs, domains, languages, sources)
    rows = stats.join(plan, LEAF)
    whole = rows.where("epochs > 0").select("k", *LEAF, "n_tokens", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"))
    part = _last_epoch(rows, seed).select("k", *LEAF, "n_tokens", F.col("epochs").alias("epoch"))
    return whole.union(part).select(F.col("k").alias(key), *LEAF, "n_tokens", "epoch")


def _draw(seed: int):
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("epochs"), F.coalesce(F.col("k").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")


def _last_epoch(rows: DataFrame, seed: int) -> DataFrame:
    """The rows of the longest prefix of each leaf's last epoch that fits the rest of its budget, with their draw."""
    last = rows.where("rest > 0").withColumn("draw", _draw(seed)).withColumn("run", F.floor(F.col("draw") / float(1 << 48) * F.col("runs")))
    sums = last.groupBy(*LEAF, "run").agg(F.sum("n_tokens").alias("s"))
    before = sums.select(*LEAF, "run", (F.sum("s").over(Window.partitionBy(*LEAF).orderBy("run")) - F.col("s")).alias("before"))
    # Runs that begin behind the budget need no order.
    some = last.join(before, [*LEAF, "run"]).where("before < rest")
    upto = F.sum("n_tokens").over(Window.partitionBy(*LEAF, "run").orderBy("draw", "k", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    return some.withColumn("upto", F.col("before") + upto).where("upto <= rest")


def take_once(docs: DataFrame, fraction: float = 0.8, seed: int = 7, domains: dict[str, float] = DOMAINS, languages: dict[str, float] = LANGUAGES, sources: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``mix`` selects with one epoch.

    A leaf's prefix ends at a last (draw, key, tokens), so that each row is judged against its leaf's end where it is read; only the leaves are joined. Of rows that
    tie with the end, as repeated rows do, as many are taken as ``mix`` takes; only these are shuffled.
    """
    stats, plan = _plan(_leaf_columns(docs, key, text, lang, source), fraction, 1, domains, languages, sources)
    order = F.struct("draw", "k", "n_tokens")
    taken = _last_epoch(stats.join(plan, LEAF), seed).groupBy(*LEAF, order.alias("end")).agg(F.count(F.lit(1)).alias("taken"))
    ends = taken.groupBy(*LEAF).agg(F.max(F.struct("end", "taken")).alias("e"))
    ends = keep(plan.join(ends, LEAF, "left").select(*[F.col(c).alias(f"__{c}") for c in LEAF], "epochs", F.col("e.end").alias("end"), F.col("e.taken").alias("taken")), "ends")
    rows = _leaf_columns(docs, key, text, lang, source, F.struct(*docs.columns).alias("row"))
    rows = rows.join(ends, [F.col(c) == F.col(f"__{c}") for c in LEAF]).withColumn("draw", _draw(seed))
    inside = F.coalesce((F.col("epochs") > 0) | (order < F.col("end")), F.lit(False))
    tied = F.coalesce((F.col("epochs") == 0) & (order == F.col("end")), F.lit(False))
    small = stats.join(ends, [F.col(c) == F.col(f"__{c}") for c in LEAF]).withColumn("draw", _draw(seed))
    if not small.where(tied).groupBy(*LEAF).agg(F.count(F.lit(1)).alias("n"), F.max("taken").alias("taken")).where("n > taken").limit(1).count():
        return rows.where(inside | tied).select("row.*")
    number = F.row_number().over(Window.partitionBy(*LEAF).orderBy(F.xxhash64(F.col("row")[text])))
    return rows.where(inside).select("row.*").union(rows.where(tied).withColumn("number", number).where("number <= taken").select("row.*"))


SQL = """
WITH s AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS BIGINT), 0) % 4) AS domain,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
total AS (SELECT sum(n_tokens)::DOUBLE * 0.5 AS b FROM s),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE * 2 AS c FROM s GROUP BY ALL),
u AS (SELECT * FROM (SELECT *, CASE domain WHEN 'd0' THEN 0.4::DOUBLE WHEN 'd1' THEN 0.3::DOUBLE WHEN 'd2' THEN 0.2::DOUBLE WHEN 'd3' THEN 0.1::DOUBLE ELSE 0 END AS w1,
  CASE lang WHEN 'en' THEN 0.55::DOUBLE WHEN 'de' THEN 0.2::DOUBLE WHEN 'fr' THEN 0.15::DOUBLE WHEN 'es' THEN 0.1::DOUBLE ELSE 0 END AS w2 FROM leaf) WHERE w1 > 0 AND w2 > 0),
d0 AS (SELECT domain, sum(c) AS c, max(w1) AS w, max(b) AS b FROM u, total GROUP BY domain),
d1 AS (SELECT *, (b - coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM d0 WINDOW o AS (ORDER BY c / w, domain)),
d AS (SELECT domain, greatest(0, least(c, w * max(l) OVER ())) AS b1 FROM d1),
l0 AS (SELECT u.domain, lang, sum(c) AS c, max(w2) AS w, max(b1) AS b FROM u JOIN d USING (domain) GROUP BY ALL),
l1 AS (SELECT *, (b - coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM l0 WINDOW o AS (PARTITION BY domain ORDER BY c / w, lang)),
l AS (SELECT domain, lang, greatest(0, least(c, w * max(l) OVER (PARTITION BY domain))) AS b2 FROM l1),
s0 AS (SELECT u.domain, u.lang, source, tokens, c, 1::DOUBLE AS w, b2 AS b FROM u JOIN l USING (domain, lang)),
s1 AS (SELECT *, (b - coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM s0 WINDOW o AS (PARTITION BY domain, lang ORDER BY c / w, source)),
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN g % tokens ELSE 0 END AS rest, CASE WHEN tokens > 0 THEN g // tokens ELSE 1 END AS epochs
  FROM (SELECT *, floor(greatest(0, least(c, w * max(l) OVER (PARTITION BY domain, lang))) + 1e-6)::BIGINT AS g FROM s1)),
r AS (SELECT * FROM s JOIN plan USING (domain, lang, source)),
part AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('7|' || epochs || '|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT, doc_id, n_tokens
  ROWS UNBOUNDED PRECEDING) AS upto FROM r WHERE rest > 0)
SELECT doc_id, domain, lang, source, n_tokens, e::INTEGER AS epoch FROM (SELECT *, unnest(range(epochs)) AS e FROM r)
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, epochs::INTEGER AS epoch FROM part WHERE upto <= rest
"""
