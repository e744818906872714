"""Line dedup by a log-template tree of fixed depth (operator 5).

A line goes down the tree by its number of words and its leading words, in which variable fields (words with a
digit) are one wildcard. In a leaf, a position whose commonest word stands in at least half of the lines is constant,
the others are variable. A line fits a template if it agrees with the constants on ``similarity`` of all positions. What fits no template of its leaf
is generalised again among itself, so a leaf can hold several templates.
Dropped are the lines whose template, or whose own text with wildcards, occurs in ``min_docs`` documents. Apart from templates,
lines too short for one are counted by their words as they are, and of a long line that recurs only the first document keeps its copy.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, words
from .text_hash import _buffers, line_hashes


#: Bits of the filter by which the second pass over the texts finds the leaves whose lines it gives.
FILTER_BITS = 22
#: Hashes of lines that go which are sent to all tasks, so that texts are judged where they are read; beyond it texts and hashes are joined.
KNOWN_LINES = 1 << 22


def masked_words(line: Column) -> Column:
    """Words of a line; those with a digit become ``<*>``."""
    plain = words(line)
    return F.when(line.rlike("[0-9]"), F.transform(plain, lambda w: F.when(w.rlike("[0-9]"), F.lit("<*>")).otherwise(w))).otherwise(plain)


def _hashes(min_words: int, depth: int, short_docs: int | None, long_words: int):
    """(id, row, exact, leaf, long) of every line with its leaf; short and long lines also as they are, with a null leaf."""

    def run(batches):
        for batch in batches:
            for x in line_hashes(batch.column(2), depth):
                masked, as_is = x["n"] >= min_words, x["n"] > long_words
                if short_docs is not None:
                    as_is |= x["n"] < min_words
                at = pa.array(np.concatenate([x["row"][masked], x["row"][as_is]]))
                no_leaf = np.arange(len(at)) >= masked.sum()
                long = pa.array(no_leaf & (np.concatenate([x["n"][masked], x["n"][as_is]]) > long_words))
                exact, leaf = (pa.array(np.concatenate([x[one][masked], x[two][as_is]]), mask=m) for one, two, m in (("exact", "whole", None), ("leaf", "leaf", no_leaf)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), exact, leaf, long], ["id", "row", "exact", "leaf", "long"])

    return run


def _lines_in(wanted, min_words: int, depth: int):
    """(leaf, exact, line) of the lines whose leaf may be wanted, each once a slice."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            data, _ = _buffers(batch.column(0))
            for x in line_hashes(batch.column(0), depth):
                bit = x["leaf"].view(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)
                hit = np.flatnonzero((x["n"] >= min_words) & ((bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1))
                if len(hit):
                    hit = hit[np.unique(x["exact"][hit], return_index=True)[1]]
                    lines = [data[a:b].tobytes().decode() for a, b in zip(x["start"][hit], x["end"][hit], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x["leaf"][hit]), pa.array(x["exact"][hit]), pa.array(lines)], ["leaf", "exact", "line"])

    return run


def _without(raw: np.ndarray, starts: np.ndarray) -> tuple[int, str]:
    """(lines dropped, what stays) of a text's bytes; ``starts``: a place in each line that goes."""
    lines = raw.tobytes().split(b"\n")
    gone = set(np.searchsorted(np.flatnonzero(raw == 10), starts).tolist())
    return len(gone), b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode()


def _answer(batch, at: np.ndarray, changed: list[tuple[int, str]]):
    """(id, n_lines, n_dropped, text) of a batch (id, row, text, ..) whose rows ``at`` become ``changed``."""
    text = batch.column(2)
    n = pc.fill_null(pc.add(pc.count_substring(text, "\n").cast(pa.int64()), 1), 0)
    dropped, mask = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
    if changed:
        dropped[at], mask[at] = [k for k, _ in changed], True
        text = pc.replace_with_mask(text, pa.array(mask), pa.array([t for _, t in changed], text.type))
    return pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(dropped), text], ["id", "n_lines", "n_dropped", "text"])


def _dropping(goes, min_words: int, depth: int, long_words: int):
    """(id, n_lines, n_dropped, text) of (id, row, text, ..): ``goes`` tells from the batch and a slice's lines (rows, hashes with wildcards, as they are, and which of both count) what goes."""

    def run(batches):
        for batch in batches:
            text, rows, starts = batch.column(2), [], []
            data, offsets = _buffers(text)
            judge = goes(batch)
            for x in line_hashes(text, depth):
                out = judge(x["row"], x["exact"], x["whole"], x["n"] >= min_words, (x["n"] < min_words) | (x["n"] > long_words))
                rows.append(x["row"][out])
                starts.append(x["start"][out])
            rows, starts = (np.concatenate(a) if a else np.empty(0, np.int64) for a in (rows, starts))
            at, first = np.unique(rows, return_index=True)
            last = np.append(first[1:], len(rows))[: len(at)]
            changed = [_without(data[offsets[i] : offsets[i + 1]], starts[a:b] - offsets[i]) for i, a, b in zip(at.tolist(), first, last, strict=True)]
            yield _answer(batch, at, changed)

    return run


def _by_lists(batch):
    """Lines of a row go whose hashes are in its list ``gone``."""
    lists = batch.column(3)

    def judge(row, exact, whole, masked, as_is):
        out = np.zeros(len(row), bool)
        for i in np.unique(row).tolist():
            if lists[i].is_valid:
                mine, gone = row == i, lists[i].values.to_numpy()
                out |= mine & ((masked & np.isin(exact, gone)) | (as_is & np.isin(whole, gone)))
        return out

    return judge


def _by_known(known):
    """Lines go by the hashes of all that do: sorted arrays of those that go everywhere, with and without wildcards, and of long lines with the id that keeps each."""

    def goes(batch):
        templates, short, long, keeper = known.value
        among = lambda h, a: a[np.minimum(np.searchsorted(a, h), len(a) - 1)] == h if len(a) else np.zeros(len(h), bool)
        ids = batch.column(0)

        def judge(row, exact, whole, masked, as_is):
            out = (masked & among(exact, templates)) | (as_is & among(whole, short))
            for k in np.flatnonzero(as_is & ~out & among(whole, long)).tolist():
                out[k] = keeper[int(np.searchsorted(long, whole[k]))] != ids[int(row[k])].as_py()
            return out

        return judge

    return goes


def _templates(texts: DataFrame, similarity: float, min_docs: int) -> DataFrame:
    """(leaf, exact, round) of the lines that fit a template: one template of each leaf a round, until what is left fits none.

    ``texts``: leaf, exact, docs (how many documents hold the line) and its words ``w``. Each line leaves in one round or the leaf is given up, so rounds end.
    """
    rest, found, number = texts, [], 0
    while True:
        places = rest.select("leaf", "exact", "docs", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
        words_ = places.groupBy("leaf", "pos", "word").agg(F.sum("docs").alias("k"))
        top = words_.groupBy("leaf", "pos").agg(F.max(F.struct("k", "word")).alias("top"), F.sum("k").alias("all")).where(2 * F.col("top.k") >= F.col("all"))
        # A leaf's constants are one array, by place; a line is compared with it where it is.
        constants = top.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("pos", "top.word"))).alias("constant")).select(F.col("leaf").alias("__leaf"), "constant")
        same = F.size(F.filter("w", lambda w, i: w == F.element_at("constant", i)))
        fits = rest.join(constants, F.col("leaf") == F.col("__leaf")).where(same >= similarity * F.size("w"))
        fits = keep(fits.select("leaf", "exact", F.lit(number).alias("round")), "fits")
        found.append(fits)
        # Leaves that gave a template go on with the rest, if several lines of enough documents are left.
        left = rest.join(fits.select("leaf").distinct(), "leaf", "left_semi").join(fits.select("exact"), "exact", "left_anti")
        enough = left.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("d")).where((F.col("n") > 1) & (F.col("d") >= min_docs)).select("leaf")
        rest = keep(left.join(enough, "leaf", "left_semi"), "rest")
        if not rest.limit(1).count():
            return reduce(DataFrame.union, found)
        number += 1


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 5, min_words: int = 5, depth: int = 4, similarity: float = 0.6, short_docs: int | None = None, long_words: int = 50) -> DataFrame:
    """One row per input row: key, n_lines, n_dropped, text without the dropped lines.

    Lines of under ``min_words`` words are dropped where the same words are a line of ``short_docs`` documents (None: never). A line of over
    ``long_words`` words that recurs, be it in two documents, stays only in the one with the least key (all go from ``min_docs`` on). A null text stays null and has no lines; an empty text has one
    empty line. Documents are counted by key, so rows with one key, or without one, count once; each row loses the lines that it holds itself. Further columns are not read.
    """
    # A row is known by its id and text, so rows without an id, or with one of many rows, are spread, and rows that are equal in both lose the same lines.
    docs = df.select(F.col(key).alias("id"), F.xxhash64(F.col(key), F.col(text)).alias("row"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    hashes = docs.where("text <> ''").mapInArrow(_hashes(min_words, depth, short_docs, long_words), f"id {kind}, row long, exact long, leaf long, long boolean")
    hashes = keep(hashes.distinct(), "lines")
    per_id = hashes if _one_row_an_id(hashes) else keep(hashes.select("id", "exact", "leaf", "long").distinct(), "lines-of-ids")
    lines = per_id.where("leaf is not null").select("id", "exact", "leaf")
    again = per_id.where("leaf is null").groupBy("exact", "long").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    again = keep(again.where(F.when(F.col("long"), F.col("docs") > 1).otherwise(F.col("docs") >= (short_docs or 1))).select("exact", "long", "first"), "again")
    often = keep(lines.groupBy("exact", "leaf").agg(F.count(F.lit(1)).alias("docs")), "exact")
    recurring = often.where(F.col("docs") >= min_docs).select("exact")
    # Leaves that several documents reach, counted with other lines than those that recur alone.
    busy = lines.select("leaf", "id").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("leaf")
    varied = keep(often.join(busy, "leaf").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf"), "varied")
    # A bitmap of fixed size spares the lines that no wanted leaf has.
    bit = F.col("leaf").bitwiseAND((1 << FILTER_BITS) - 1)
    some = varied.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("m")).collect()
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    for r in some:
        bits[r["w"]] = r["m"]
    wanted = df.sparkSession.sparkContext.broadcast(bits.view(np.uint64))
    lines_of = docs.where("text <> ''").select("text").mapInArrow(_lines_in(wanted, min_words, depth), "leaf long, exact long, line string")
    texts = lines_of.join(varied, "leaf").groupBy("leaf", "exact").agg(F.first("line").alias("line"))
    texts = keep(texts.join(often.select("exact", "docs"), "exact").select("leaf", "exact", "docs", masked_words(F.col("line")).alias("w")), "texts")
    fits = _templates(texts, similarity, min_docs)
    reached = lines.join(fits, ["leaf", "exact"]).select("leaf", "round", "id").distinct().groupBy("leaf", "round").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("leaf", "round")
    dropped = keep(recurring.union(fits.join(reached, ["leaf", "round"]).select("exact")).distinct(), "dropped")
    schema = f"id {kind}, n_lines long, n_dropped long, text string"
    if dropped.count() + again.count() <= KNOWN_LINES:
        known = df.sparkSession.sparkContext.broadcast(_known(dropped, again))
        out = docs.mapInArrow(_dropping(_by_known(known), min_words, depth, long_words), schema)
    else:
        # Texts meet the hashes of their own lines that go, by row.
        all_lines = hashes.select("id", "row", "exact", "leaf", "long")
        as_is = all_lines.where("leaf is null").join(again, ["exact", "long"]).where(~F.col("long") | ~F.col("id").eqNullSafe(F.col("first.id"))).select("row", "exact")
        gone = all_lines.where("leaf is not null").join(dropped, "exact").select("row", "exact").union(as_is)
        per_row = gone.groupBy("row").agg(F.collect_set("exact").alias("gone")).withColumnRenamed("row", "gone_row")  # lines of one text
        out = docs.join(per_row, F.col("row") == F.col("gone_row"), "left").select("id", "row", "text", "gone").mapInArrow(_dropping(_by_lists, min_words, depth, long_words), schema)
    return out.select(F.col("id").alias(key), "n_lines", "n_dropped", "text")


def _one_row_an_id(hashes: DataFrame) -> bool:
    """Whether no id has two rows with different texts; then lines by row are lines by id."""
    return not hashes.groupBy("id").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").limit(1).count()


def _known(dropped: DataFrame, again: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """At most KNOWN_LINES hashes: sorted ones with wildcards, short ones, long ones, and the ids that keep these."""
    templates = np.sort(np.array([r[0] for r in dropped.select("exact").toLocalIterator()], np.int64))
    rows = sorted(((r["exact"], r["long"], r["first"]["id"]) for r in again.toLocalIterator()), key=lambda r: r[0])
    short = np.array([e for e, long, _ in rows if not long], np.int64)
    return templates, short, np.array([e for e, long, _ in rows if long], np.int64), [i for _, long, i in rows if long]
