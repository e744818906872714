"""Quality rules as learned decision lists (operator 3).

A decision list is an ordered list of rules; a rule is a conjunction of thresholds on text statistics. Sequential
covering learns rules for bad documents: it grows a conjunction literal by literal by FOIL gain on two thirds of
the labelled rows, prunes it from the end on the other third, takes what it covers out and goes on. The list
becomes one ordered ``CASE WHEN`` expression. All labelled rows are used: each step is one Spark aggregate into a
histogram of (feature, bin), and only these bins reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, keep, words

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word_chars", "symbols_per_word", "dup_lines_per_line", "repeat_share"]


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """key, the five base statistics of the whole text (long) and n_lines, the lines with a word. A null text has none, all are 0.

    n_repeat_words: words within three-word windows that occur at least twice in the text. The windows are
    compared by 64-bit hashes, sorted with their positions, so that a text of n words costs n log n.
    carry: columns of the input that the result holds as a struct ``row``, instead of the key.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    line_list = F.filter(F.split(t, "\n"), lambda s: F.translate(s, SPACE_CHARS, "") != "")
    held = F.struct(*carry).alias("row") if carry else F.col(key)
    key = "row" if carry else key
    step = docs.select(held, t.alias("t"), words(F.col(text)).alias("w"), line_list.alias("lines"))
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(
        key,
        n.cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("h"),
    )
    at = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), at))
    twice = F.filter("s", lambda x, i: (F.get(F.col("s"), i - 1)["h"] == x["h"]) | (F.get(F.col("s"), i + 1)["h"] == x["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return step.select(key, *BASE[:4], F.when(F.col("s").isNull(), 0).otherwise(F.size(covered)).cast("long").alias("n_repeat_words"), "n_lines")


def feature_columns() -> dict[str, Column]:
    """Ratios are rounded, so that thresholds are short and read well."""
    per = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 3)
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines_per_line": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Literal:
    feature: str
    op: str  # "<=" or ">"
    threshold: float

    def column(self) -> Column:
        c = feature_columns()[self.feature]
        return c <= self.threshold if self.op == "<=" else c > self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules for bad documents, in order; what no rule covers is kept."""

    rules: tuple[tuple[Literal, ...], ...] = ()

    def verdict(self) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(_all(rule), False).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join([*(f"if {' and '.join(map(str, r))}: reject" for r in self.rules), "else: keep"])


def _all(rule) -> Column:
    out = F.lit(True)
    for literal in rule:
        out = out & literal.column()
    return out


def learn(labelled: DataFrame, key: str = "doc_id", label: str = "quality", bins: int = 32, max_rules: int = 8, max_literals: int = 3, min_precision: float = 0.9, min_bad: int = 5) -> DecisionList:
    """Learn a decision list from statistics with a 0/1 label (rows with another or no label don't count).

    bins: thresholds tried per feature (quantiles over all labelled rows). A rule is accepted while its precision on
    both parts is at least ``min_precision`` and it covers ``min_bad`` bad rows. Without labelled
    rows of both kinds the list is empty and keeps everything.
    """
    features = feature_columns()
    rows = labelled.where(F.col(label).isin(0, 1)).select(
        *BASE, "n_lines", (F.col(label) == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("split"), key), F.lit(3)) > 0).alias("grow"), *[c.alias(f"f_{f}") for f, c in features.items()]
    )
    cuts = rows.agg(F.count(F.when(F.col("bad"), 1)), F.count(F.lit(1)), *[F.percentile_approx(f"f_{f}", [i / bins for i in range(1, bins)], 1000) for f in FEATURES]).first()
    if not 0 < cuts[0] < cuts[1]:
        return DecisionList()
    edges = {f: sorted(set(c)) for f, c in zip(FEATURES, cuts[2:], strict=True)}
    #: bin i of a feature: the number of edges below the value, so "value <= edges[i]" is "bin <= i".
    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[f]]), lambda e: e < F.col(f"f_{f}")))

    pairs = [F.struct(F.lit(f).alias("f"), bin_of(f).alias("bin")) for f in FEATURES]
    rows = rows.withColumn("pairs", F.array(*pairs))

    def histogram(where: Column) -> dict[str, dict[int, tuple[int, int]]]:
        out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
        got = rows.where(where & F.col("grow")).select("bad", F.explode("pairs").alias("p")).groupBy("p").agg(F.count(F.when(F.col("bad"), 1)).alias("b"), F.count(F.lit(1)).alias("n"))
        for r in got.collect():  # features x bins rows at most
            out[r["p"]["f"]][r["p"]["bin"]] = (r["b"], r["n"] - r["b"])
        return out

    rules: list[tuple[Literal, ...]] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: tuple[Literal, ...] = ()
        while len(rule) < max_literals:
            hist = histogram(left & _all(rule))
            p0 = sum(b for b, _ in hist[FEATURES[0]].values())
            n0 = sum(g for _, g in hist[FEATURES[0]].values())
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for f in FEATURES:
                p = n = 0
                for i, edge in enumerate(edges[f]):
                    b, g = hist[f].get(i, (0, 0))
                    p, n = p + b, n + g
                    for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                        if pp >= min_bad and (v := pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))) > gain:
                            best, gain = Literal(f, op, float(edge)), v
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        # Prune: the shortest prefix with the best (p - n) / (p + n) on the rows held back.
        sums = [F.count(F.when(_all(rule[: k + 1]) & (F.col("bad") == bad) & (F.col("grow") == grow), 1)) for k in range(len(rule)) for bad in (True, False) for grow in (True, False)]
        got = list(rows.where(left).agg(*sums).first())
        scores = []
        for k in range(len(rule)):
            pg, pp, ng, np_ = got[4 * k : 4 * k + 4]
            held = (pp - np_) / (pp + np_) if pp + np_ else -1.0
            scores.append((held, -k, pg / max(1, pg + ng), pp / max(1, pp + np_), pg + pp))
        held, k, on_grow, on_prune, bad = max(scores)
        if on_grow < min_precision or on_prune < min_precision or bad < min_bad:
            break
        rules.append(rule[: 1 - k])
        left = left & ~_all(rules[-1])
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(stats: DataFrame, model: DecisionList, key: str = "doc_id") -> DataFrame:
    """kept: not base_failed and the list keeps it."""
    return stats.select(key, *BASE, base_failed().alias("base_failed"), (~base_failed() & model.verdict()).alias("kept"))


def _learned(stats: DataFrame, labels: DataFrame, key: str, label: str) -> DecisionList:
    labelled = stats.where(~base_failed()).join(labels.select(F.col(key), F.col(label)), key)
    return learn(keep(labelled, "labelled"), key, label)


def quality_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: key, the base statistics, base_failed, kept.

    The list is learned from all documents with a label that pass the base rules. Null and empty texts fail the base rules.
    Repeated rows keep their rows; a key with several labels counts with each. Null keys have no label but a verdict.
    Other columns of either table are not read.
    """
    stats = keep(text_statistics(docs, key, text), "quality")
    return judge(stats, _learned(stats, labels, key, label), key)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``quality_rules`` keeps.

    Texts are read once: every row is written beside its statistics, the list is learned from the keys and statistics of that table joined
    to the labels, and the filter reads the table again. No text is shuffled.
    """
    stats = keep(text_statistics(docs, key, text, carry=docs.columns), "quality")
    small = stats.select(F.col("row")[key].alias(key), *BASE, "n_lines")
    return stats.where(~base_failed() & _learned(small, labels, key, label).verdict()).select("row.*")
