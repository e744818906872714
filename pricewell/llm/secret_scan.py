"""Secret scans with a random forest against false positives (operator 8).

Candidates are the long runs of key characters in all words, several of a word where it holds them, and shorter ones that an assignment announces (``password=hunter2!``). Each gets
statistics of its run (length, transitions between kinds of characters, distinct characters, coverage by the corpus's own dictionary), of its path and of the words in front of it, which
count by what the labelled findings say of them. A random forest trained from labelled findings gives the probability that it is a secret.

Where there are no reviewed findings, labels come from evidence that is none of the features: key prefixes of known services, check digits, how many
documents hold the run, and how surprising its letters are to the corpus (bits a character by pairs of letters).
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, lower_ascii, words

#: A run of 16 key characters or more, where equal signs belong to it only if they fill it up at its end (``name=`` stays in front of it); or one of 6 or more characters of
#: passwords right behind an equal sign or colon, with or without a quote between.
RUN = (
    r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
    r"|(?:(?<=[=:])|(?<=[=:][\"'`]))(?!/)[A-Za-z0-9+/_!@#$%^*.~-]{5,}[A-Za-z0-9+/_!@#$%^*~-]"
)
#: Words in front of a run, parts of paths and the dictionary are dealt into this many buckets by their hashes.
BUCKETS = 1024
#: Fixed: how keys of known services begin.
KNOWN_KEYS = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[opsu]_[0-9A-Za-z]{36}|glpat-|xox[abpr]-|sk_live_|rk_live_|AIza[0-9A-Za-z_-]{35}$|npm_[0-9A-Za-z]{36}$)"
FEATURES = ["run_length", "kinds", "transitions", "distinct_share", "digit_share", "hex_only", "dictionary_share", "path_odds", "before_high", "before_low", "assigned", "quoted"]
#: Letters that pairs are counted of; all other characters are one sign.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, text: str = "text", share: float = 1e-5) -> dict[str, int]:
    """Words of 3 to 20 letters (a-z, any case) that are at least ``share`` of all such words in all texts, with their counts: the dictionary of the features. There are at most 1 / share of them."""
    found = docs.select(F.explode(words(lower_ascii(F.col(text)))).alias("w")).where(F.col("w").rlike("^[a-z]{3,20}$")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = keep(found, "words")
    total = found.agg(F.sum("n")).first()[0] or 0
    return {r["w"]: r["n"] for r in found.where(F.col("n") >= share * total).orderBy(F.desc("n"), "w").collect()}


def pair_bits(counts: dict[str, int]) -> dict[str, float]:
    """Bits of the second letter of each pair after the first, over the dictionary's words by their counts; every pair is counted once more than it occurs."""
    signs = LETTERS + "."
    seen = {a + b: 1 for a in signs for b in signs}
    for word, n in counts.items():
        for a, b in zip(word, word[1:], strict=False):
            seen[a + b] += n
    return {a + b: math.log2(sum(seen[a + c] for c in signs) / seen[a + b]) for a in signs for b in signs}


def among(word: Column, names: Iterable[str]) -> Column:
    """Whether a word is one of up to some hundred thousand ``names``: these are one constant, dealt into buckets by CRC, so that a plan stays small and a word is compared with a few."""
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    for name in names:
        buckets[zlib.crc32(name.encode()) % BUCKETS].append(name)
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<string>>")
    return F.array_contains(F.get(table, (F.crc32(word) % BUCKETS).cast("int")), word)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", dictionary: dict[str, int] | None = None) -> DataFrame:
    """One row per candidate: key, word_index (from 0), run_index (from 0, of the word's runs), run, the features of the run itself, ``near_words`` (up to three words in front of it, lower case) and
    ``path_parts``. ``path`` None: no column names where a text is from.

    In front of a run stand the word's characters back to the run before it, that run, and for the first one the words before. A word behind one that ends in an equal sign or colon is announced by it.
    ``dictionary``: by default that of the corpus. Null and empty texts have no candidates.
    """
    dictionary = corpus_words(docs, text) if dictionary is None else dictionary
    # A word behind one that ends in an equal sign or colon begins with an equal sign in ``v``, which has the same words else.
    marked = F.regexp_replace(F.col(text), r"([=:])([\x20\x09-\x0D]+)(?=[^\x20\x09-\x0D])", "$1$2=")
    rows = docs.select(F.col(key).alias("id"), (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"), words(F.col(text)).alias("w"), words(marked).alias("v"))
    at = F.filter(F.transform("v", lambda v, i: F.when(((F.length(v) >= 16) | v.contains("=") | v.contains(":")) & v.rlike(RUN), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", at).where(F.size("at") > 0).select("id", "path", "w", "v", F.explode("at").alias("i"))
    near = lambda c: lower_ascii(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    word = F.get("v", F.col("i"))
    rows = rows.select(
        "id", "path", F.col("i").alias("word_index"), F.regexp_extract_all(word, F.lit(RUN), F.lit(0)).alias("runs"), F.split(word, RUN, -1).alias("gaps"),
        F.transform(F.slice("w", F.greatest(F.lit(1), F.col("i") - 2), F.least(F.lit(3), F.col("i"))), near).alias("words"),
        F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("i")), F.least(F.lit(1), F.col("i"))), "").alias("last"),
    )
    each = F.transform("runs", lambda r, k: F.struct(k.alias("run_index"), r.alias("run"), F.get("gaps", k).alias("gap"), F.coalesce(F.get("runs", k - 1), F.lit("")).alias("run_before")))
    rows = rows.select("id", "path", "word_index", "words", "last", F.inline(each))
    inside = F.filter(F.split(lower_ascii(F.concat_ws(" ", "run_before", "gap")), "[^a-z0-9]+"), lambda x: x != "")
    before = F.when(F.col("run_index") == 0, F.concat("words", inside)).otherwise(inside)
    rows = rows.withColumn("before", before).withColumn("before", F.slice("before", F.greatest(F.lit(1), F.size("before") - 2), F.lit(3)))
    first = (F.col("run_index") == 0) & ~F.col("gap").rlike("[A-Za-z0-9]")
    n = F.length("run")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("run", "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "0"), "[^ab0]", ".")
    rows = rows.withColumn("kind", kind)
    pieces = F.transform(F.expr("regexp_extract_all(run, '[A-Z]?[a-z]{2,}|[A-Z]{3,}', 0)"), lower_ascii)
    known = F.aggregate(pieces, F.lit(0), lambda a, x: a + F.when(among(x, dictionary), F.length(x)).otherwise(0)) if dictionary else F.lit(0)
    number = lambda c: c.cast("double")
    return rows.select(
        F.col("id").alias(key), "word_index", "run_index", "run",
        number(n).alias("run_length"),
        number(F.size(F.array_distinct(F.split("kind", "")))).alias("kinds"),
        (F.size(F.expr(r"regexp_extract_all(kind, '(.)\\1*', 0)")) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split("run", ""))) / n).alias("distinct_share"),
        ((n - F.length(F.translate("run", "0123456789", ""))) / n).alias("digit_share"),
        number(F.col("run").rlike("^[0-9a-fA-F]+$")).alias("hex_only"),
        (known / n).alias("dictionary_share"),
        number((first & F.col("last").rlike("[=:]$")) | F.col("gap").rlike("[=:][^A-Za-z0-9]*$")).alias("assigned"),
        number(F.col("gap").rlike("[\"'`][^A-Za-z0-9]*$")).alias("quoted"),
        F.filter("before", lambda x: x != "").alias("near_words"),
        F.array_distinct(F.filter(F.split(lower_ascii(F.col("path")), "[^a-z]+"), lambda x: x != "")).alias("path_parts"),
    )


@dataclass
class SecretModel:
    """A forest, and what the labelled findings say of the words in front of a run and of the parts of a path: log odds of a secret by bucket."""

    forest: RandomForestClassificationModel
    near: list[float]
    path: list[float]


def log_odds(found: DataFrame, column: str, label: str = "label") -> list[float]:
    """By bucket: the log of how much likelier a word of ``column`` stands with a secret than with another finding. Each count is taken as one higher."""
    bucket = F.pmod(F.xxhash64("w"), F.lit(BUCKETS))
    each = found.select(F.explode(F.array_distinct(column)).alias("w"), label).groupBy(bucket.alias("b")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    all_p, all_q = found.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    odds = [math.log((all_q + 2) / (all_p + 2))] * BUCKETS
    for r in each.collect():  # at most BUCKETS
        odds[r["b"]] = math.log((r["p"] + 1) / (all_p + 2)) - math.log((r["q"] + 1) / (all_q + 2))
    return [0.0 if not (all_p and all_q) else o for o in odds]


def with_odds(found: DataFrame, near: list[float], path: list[float]) -> DataFrame:
    """The features that rest on learned words: the greatest and least odds of the words in front of a run, the sum over the parts of its path; 0 without words."""

    def of(column: str, odds: list[float]) -> Column:
        table = F.array(*[F.lit(float(o)) for o in odds])
        return F.transform(column, lambda w: F.get(table, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")))

    most, least = F.coalesce(F.array_max(of("near_words", near)), F.lit(0.0)), F.coalesce(F.array_min(of("near_words", near)), F.lit(0.0))
    return found.withColumns({"path_odds": F.aggregate(of("path_parts", path), F.lit(0.0), lambda a, x: a + x), "before_high": most, "before_low": least})


def train(found: DataFrame, label: str = "label", max_findings: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 11) -> SecretModel | None:
    """A forest and the odds of words from candidates with a 0/1 label, None if not both labels occur.

    ``max_findings``: of each label at most half as many findings are used, and at least one (those with the least hashes); a forest needs no more.
    """
    of_run = [c for c in FEATURES if c in found.columns]
    rows = found.where(F.col(label).isin(0, 1)).select(*of_run, "near_words", "path_parts", F.col(label).cast("double").alias("label"), F.xxhash64(*of_run, "near_words", "path_parts", label, "run", "word_index", "run_index").alias("h"))
    some = [keep(rows.where(F.col("label") == x).orderBy("h").limit(max(1, max_findings // 2)), "findings") for x in (0.0, 1.0)]
    if not all(s.limit(1).count() for s in some):
        return None
    both = some[0].union(some[1])
    near, path = log_odds(both, "near_words"), log_odds(both, "path_parts")
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_odds(both, near, path))
    return SecretModel(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(vectors), near, path)


def score(found: DataFrame, model: SecretModel | None, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """key, word_index, run_index, run, score, is_secret. Without a model every candidate scores 1, as nothing tells false ones apart."""
    if model is None:
        return found.select(key, "word_index", "run_index", "run", F.lit(1.0).alias("score"), F.lit(True).alias("is_secret"))
    scored = model.forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_odds(found, model.near, model.path)))
    return scored.select(key, "word_index", "run_index", "run", F.round(vector_to_array("probability")[1], 6).alias("score")).withColumn("is_secret", F.col("score") >= threshold)


def luhn(run: Column) -> Column:
    """Whether a run is 13 to 19 digits that the Luhn check accepts, as those of cards."""
    digits = F.transform(F.filter(F.split(F.reverse(run), ""), lambda c: c != ""), lambda c: c.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))), F.lit(0), lambda a, d: a + d)
    return F.when(run.rlike("^[0-9]{13,19}$"), total % 10 == 0).otherwise(False)


def surprise(run: Column, bits: dict[str, float]) -> Column:
    """Mean bits of a run's characters after the ones before, by ``pair_bits``."""
    plain = F.regexp_replace(lower_ascii(run), "[^a-z]", ".")
    table = F.create_map(*[x for pair, v in bits.items() for x in (F.lit(pair), F.lit(float(v)))])
    pairs = F.transform(F.sequence(F.lit(1), F.length(plain) - 1), lambda i: F.element_at(table, F.substring(plain, i, F.lit(2))))
    return F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b) / (F.length(plain) - 1)


def weak_findings(found: DataFrame, bits: dict[str, float], recurring: int = 5, low: float = 4.5, high: float = 6.0, key: str = "doc_id") -> DataFrame:
    """Labelled findings where no reviewed ones exist, from evidence that the forest doesn't see.

    1: the key of a known service, or a run of over ``high`` bits a character. 0: a number with the check digit of cards, a run that ``recurring`` documents
    hold, or one of under ``low`` bits. In that order, with known services first and surprise last; the rest gets no label.
    """
    spread = keep(found.groupBy("run").agg(F.count_distinct(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("docs")).where(F.col("docs") >= recurring).select(F.col("run").alias("r")), "recurring")
    rows = found.join(spread, F.col("run") == F.col("r"), "left")
    much = surprise(F.col("run"), bits)
    label = F.when(F.col("run").rlike(KNOWN_KEYS), 1).when(luhn(F.col("run")) | F.col("r").isNotNull(), 0).when(F.col("run").rlike("^[0-9]+$"), None).when(much > high, 1).when(much < low, 0)
    return rows.withColumn("label", label).drop("r")


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, key: str = "doc_id", text: str = "text", path: str | None = "source", max_findings: int = 20_000) -> DataFrame:
    """One row per candidate: key, word_index, run_index, run, score, is_secret.

    ``findings``: (key, word_index, run_index, label) of reviewed candidates, without run_index of a word's first run; without findings ``weak_findings`` labels. Null and empty texts have no candidates;
    repeated rows repeat theirs; null keys stay. Words of any length are read whole. Other columns are not read. An empty table has no candidates.
    """
    dictionary = corpus_words(docs, text)
    found = keep(candidates(docs, key, text, path, dictionary), "candidates")
    at = [key, "word_index", "run_index"]
    if findings is not None and "run_index" not in findings.columns:
        findings = findings.withColumn("run_index", F.lit(0))
    labelled = weak_findings(found, pair_bits(dictionary), key=key) if findings is None else found.join(findings.select(*at, "label"), at)
    return score(found, train(labelled, max_findings=max_findings), key)
