"""Benchmark decontamination by spaced seeds (operator 7).

A mask of fixed positions is laid over every window of words; positions with 0 may hold anything. Test items and training texts are
hashed under each mask and joined on the hash. Around every hit the item is laid along the text without gaps, and
the best-scoring stretch (a match counts 1, a substitution -4) must hold ``min_words`` matching words, or all of
a shorter item.

The items are searched in blocks of about ``block_words`` words, one pass over the documents for each; a block is
collected and broadcast, so its size is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words
from .text_hash import _steps, mix, word_hashes

#: 1: the word counts, 0: it may differ.
MASKS = ("11111111", "110110101101", "1011100110101", "1110001011011")
SHORTEST = 8
GATE_BITS = 22


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask laid at every word at which it fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out += hashes[k : k + n] * _steps[k]
    return mix(out)


class _Block:
    """The items of one block with their seeds, sorted by hash."""

    def __init__(self, rows, min_item_words: int):
        self.ids, self.words = [], []
        texts = pa.array([r["text"] for r in rows], pa.string())
        for first, hashes, bounds in word_hashes(texts):
            for i in range(len(bounds) - 1):
                if bounds[i + 1] - bounds[i] >= min_item_words:
                    self.ids.append(rows[first + i]["id"])
                    self.words.append(hashes[bounds[i] : bounds[i + 1]])
        short = sorted({len(w) for w in self.words if len(w) < SHORTEST})
        self.masks = [*MASKS, *("1" * n for n in short)]
        self.seeds = []
        for mask in self.masks:
            wanted = [(i, _seeds(w, mask)) for i, w in enumerate(self.words) if len(mask) >= SHORTEST or len(w) == len(mask)]
            seed = np.concatenate([np.empty(0, np.uint64), *(s for _, s in wanted)])
            item = np.concatenate([np.empty(0, np.int64), *(np.full(len(s), i) for i, s in wanted)])
            place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(s)) for _, s in wanted)])
            order = np.argsort(seed, kind="stable")
            gate = np.zeros(1 << GATE_BITS, bool)
            gate[seed & np.uint64((1 << GATE_BITS) - 1)] = True
            self.seeds.append((seed[order], item[order], place[order], np.packbits(gate)))


def _overlaps(block: _Block, texts: pa.Array, min_words: int):
    """(row, item, matching words, first word, words) of the best stretch for each row and item."""
    gates = [np.unpackbits(s[3]).astype(bool) for s in block.seeds]
    for first, hashes, bounds in word_hashes(texts):
        found: set[tuple[int, int, int]] = set()
        for mask, (seed, item, place, _), gate in zip(block.masks, block.seeds, gates, strict=True):
            if not len(seed):
                continue
            laid = _seeds(hashes, mask)
            at = np.flatnonzero(gate[laid & np.uint64((1 << GATE_BITS) - 1)])
            low, high = np.searchsorted(seed, laid[at], "left"), np.searchsorted(seed, laid[at], "right")
            for p, a, b in zip(at[high > low], low[high > low], high[high > low], strict=True):
                row = int(np.searchsorted(bounds, p, "right")) - 1
                if p + len(mask) <= bounds[row + 1]:
                    found.update((row, int(i), int(p - q)) for i, q in zip(item[a:b], place[a:b], strict=True))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, i, shift in found:
            w = block.words[i]
            begin, end = max(int(bounds[row]), shift), min(int(bounds[row + 1]), shift + len(w))
            score = np.concatenate([[0], np.cumsum(np.where(hashes[begin:end] == w[begin - shift : end - shift], 1, -4))])
            gain = score - np.minimum.accumulate(score)
            stop = int(gain.argmax())
            start = int(score[: stop + 1].argmin())
            matching = int((score[stop] - score[start] + 4 * (stop - start)) // 5)
            if matching >= min(min_words, len(w)):
                best[row, i] = max(best.get((row, i), (0, 0, 0)), (matching, start + begin - int(bounds[row]), stop - start))
        for (row, i), (matching, start, length) in best.items():
            yield first + row, block.ids[i], matching, start, length


def _blocks(items: DataFrame, item_key: str, item_text: str, block_words: int, min_item_words: int):
    spark = items.sparkSession
    rows = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("text")).distinct()
    total = rows.agg(F.sum(F.size(words(F.col("text"))))).first()[0] or 0
    parts = -(-total // block_words)
    for k in range(parts):
        block = _Block(rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).orderBy("id", "text").collect(), min_item_words)
        yield spark.sparkContext.broadcast(block)


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = 12, min_item_words: int = 5, block_words: int = 400_000) -> DataFrame:
    """One row per document key and item that overlap: key, item key, matching_words, first_word, span_words.

    Of several overlaps the one with most matching words counts, then the latest. Null and empty texts overlap with nothing; items of fewer than
    ``min_item_words`` words are not searched. Rows with equal or null keys count as one document. Other columns are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    out = rows.sparkSession.createDataFrame([], "id long, item long, matching long, first long, length long")
    for block in _blocks(items, item_key, item_text, block_words, min_item_words):

        def run(batches, block=block):
            for batch in batches:
                hits = list(_overlaps(block.value, batch.column(1), min_words))
                if hits:
                    r, item, m, s, n = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), *(pa.array(x, pa.int64()) for x in (item, m, s, n))], ["id", "item", "matching", "first", "length"])

        out = out.union(rows.mapInArrow(run, out.schema))
    best = out.groupBy("id", "item").agg(F.max(F.struct("matching", "first", "length")).alias("b"))
    return best.select(F.col("id").alias(key), F.col("item").alias(item_key), F.col("b.matching").alias("matching_words"), F.col("b.first").alias("first_word"), F.col("b.length").alias("span_words"))


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = 12, min_item_words: int = 5, block_words: int = 400_000) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that overlap with an item."""
    at = docs.columns.index(text)
    for block in _blocks(items, item_key, item_text, block_words, min_item_words):

        def run(batches, block=block):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in _overlaps(block.value, batch.column(at), min_words)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
