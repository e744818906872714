"""URL filters by host-suffix and path-prefix expressions (operator 6).

A URL is expanded into every host suffix (at label borders) joined to every path prefix (at the lengths that
rules have). The expressions meet the rules on a four-byte prefix of their SHA-256; a hit counts
only if the full digests are equal, and of several hits the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii

#: The rules of the contract: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


#: Hex digits of a digest that expressions and rules are joined on.
PREFIX = 8


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and gets ``default``. Repeated rows
    and null or repeated keys each keep their row. Of rules of equal length the greatest (host, path, verdict) wins. Repeated rules count
    once. Further columns are not read. Rules may be any number: they are joined by digest prefix, a row for each prefix, and that table is broadcast only if
    Spark finds it small. Where it is not, the expressions of a very common rule are one key, which adaptive execution splits.
    """
    shape = rules.agg(
        F.collect_set(F.length("rule_path")).alias("lengths"),
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"),
    ).first()
    known = rules.distinct().select(
        F.col("rule_host").alias("r_host"),
        F.col("rule_path").alias("r_path"),
        F.col("rule_verdict").alias("r_verdict"),
        _digest(F.col("rule_host"), F.col("rule_path")).alias("r_digest"),
    )
    by_prefix = known.groupBy(F.substring("r_digest", 1, PREFIX).alias("r_prefix")).agg(F.collect_list(F.struct("r_digest", "r_host", "r_path", "r_verdict")).alias("r_rules"))
    rows = pages.select(F.col(key).alias("k"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(1, shape["labels"])))), lambda i: F.concat_ws(".", F.slice(labels, n - i + 1, i)))
    lengths = F.array(*[F.lit(x) for x in sorted(shape["lengths"])]) if shape["lengths"] else F.array().cast("array<int>")
    prefixes = F.transform(F.filter(lengths, lambda x: x <= F.length("path")), lambda x: F.substring(F.col("path"), F.lit(1), x))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    hits = (
        rows.select("k", "host", "path", "row", F.explode_outer(expressions).alias("e"))
        .withColumn("digest", _digest(F.col("e.h"), F.col("e.p")))
        .join(by_prefix, F.substring("digest", 1, PREFIX) == F.col("r_prefix"), "left")
    )
    confirmed = F.filter("r_rules", lambda r: r["r_digest"] == F.col("digest"))
    ranked = F.transform(confirmed, lambda r: F.struct(F.length(F.concat(r["r_host"], r["r_path"])).alias("n"), r["r_host"].alias("h"), r["r_path"].alias("p"), r["r_verdict"].alias("v")))
    return (
        hits.groupBy("row", "k", "host", "path").agg(F.max(F.array_max(ranked)).alias("b"))
        .select(F.col("k").alias(key), "host", "path", F.concat("b.h", "b.p").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))
    )


SQL = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
pg AS (SELECT page_id, row_number() OVER () AS rid,
  coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT rid, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC, h DESC, p DESC) AS k
  FROM pg JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.v, 'allow') AS verdict
FROM pg LEFT JOIN fit ON pg.rid = fit.rid AND fit.k = 1
"""
