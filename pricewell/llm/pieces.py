"""SentencePiece encoding and decoding with merge-type vocabularies (operator 12).

The symbols of a text begin as its characters. An agenda holds the adjacent pairs that together are a piece, the best score first and the leftmost of equal ones; the
best pair is merged, its new neighbours join the agenda, and entries whose symbols have changed since are passed over. Characters left that are no piece become
their UTF-8 bytes. No piece reaches across the start of a word, so words are merged each for itself, and those that come again are looked up.

Words are cut and told apart in Arrow: each different word of a batch is looked at once, and the ids of the texts are put together by number of word. The new words are merged
side by side in numpy: a column holds the agenda of a word, one entry for each place where a pair may begin, and each round takes the least entry of every column. Long words
have an agenda of their own, a heap.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Words that a Python worker remembers, and the greatest length of words that are merged side by side and remembered.
REMEMBERED, LONGEST = 1 << 19, 32
#: Words merged side by side at once: their tables stay in the processor's cache.
MANY = 1 << 13
NONE, GONE, NEVER = -1, -2, np.iinfo(np.int32).max
#: Characters of texts that are held at once with their ids.
SLICE = 1 << 22
#: Kinds of pieces in the model file, fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Encoder:
    """One vocabulary: ``encode_many`` gives the ids of texts by the agenda, ``library`` is the reference implementation."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("the vocabulary is not of merge type")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in spec.pieces):
            raise ValueError("the vocabulary has user-defined or unused pieces")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.cost = {p.piece: -p.score for p in spec.pieces if p.type == NORMAL}
        by_name = {p.piece: i for i, p in enumerate(spec.pieces)}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.bytes = [by_name[f"<0x{b:02X}>"] for b in range(256)] if spec.trainer_spec.byte_fallback else None
        self.parted = all(MARK not in piece.lstrip(MARK) for piece in self.ids)  # else a text is one word
        self._remember({}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self._pairs(spec)

    def _remember(self, known: dict[str, int], store: np.ndarray, counts: np.ndarray, uses: np.ndarray) -> None:
        """The known words by number; their ids one after the other and how many each has; in how many batches each was lately met."""
        self.known, self.store, self.counts, self.uses = known, store, counts, uses
        self.begins = np.cumsum(counts) - counts

    def _pairs(self, spec) -> None:
        """Tables of the symbols: a character's symbol; for a pair of symbols the one they make and the rank of its score (equal scores have one rank)."""
        pieces = list(self.ids)
        symbols = {piece: self.ids[piece] for piece in pieces}
        for char in sorted(set(chain.from_iterable(pieces)) - symbols.keys()):
            symbols[char] = len(spec.pieces) + len(symbols)
        self.of_char = np.full(0x110000, NONE, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.span = max(symbols.values()) + 1
        pairs = {symbols[p[:k]] * self.span + symbols[p[k:]]: self.ids[p] for p in pieces for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        costs = np.array([-p.score for p in spec.pieces])
        ranks = np.unique(costs, return_inverse=True)[1].astype(np.int32)
        keys, makes = np.array([*pairs], np.int64), np.array([*pairs.values()], np.int32)
        self.shift = 64 - (8 * len(keys) + 8).bit_length()
        self.pair_keys = np.full((1 << 64 - self.shift) + len(keys) + 1, NONE, np.int64)  # a key stands at its hash or, if others stand there, behind them
        at, left = self._hash(keys), np.arange(len(keys))
        while len(left):
            free = left[self.pair_keys[at[left]] == NONE]
            self.pair_keys[at[free]] = keys[free]
            left = left[self.pair_keys[at[left]] != keys[left]]
            at[left] += 1
        self.pair_makes, self.pair_rank = np.zeros((2, len(self.pair_keys)), np.int32)
        self.pair_makes[at], self.pair_rank[at] = makes, ranks[makes]
        self.pieces = len(spec.pieces)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys of pairs stand in the tables, and whether they do."""
        at = self._hash(keys)
        there = self.pair_keys[at]
        on = np.flatnonzero((there != keys) & (there != NONE))
        while len(on):
            at[on] += 1
            there[on] = self.pair_keys[at[on]]
            on = on[(there[on] != keys[on]) & (there[on] != NONE)]
        return at, (there == keys) & (keys != NONE)

    def merged(self, word: str) -> list[str]:
        """The symbols that are left of a word when no adjacent pair is a piece any more."""
        cost, n = self.cost, len(word)
        symbols: list[str] = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = word[i : i + 2]
            if pair in cost:
                agenda.append((cost[pair], i, i + 1, 2))
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                pair = symbols[left] + symbols[follow]
                if pair in cost:
                    heappush(agenda, (cost[pair], left, follow, len(pair)))
            prior = before[left]
            if prior >= 0:
                pair = symbols[prior] + symbols[left]
                if pair in cost:
                    heappush(agenda, (cost[pair], prior, left, len(pair)))
        return [s for s in symbols if s]

    def word(self, word: str) -> tuple[int, ...]:
        out: list[int] = []
        for s in self.merged(word):
            if s in self.ids:
                out.append(self.ids[s])
            else:
                out += self._spell(s)
        return tuple(out)

    def merge_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most LONGEST characters, one after the other, and how many each word has. They are merged side by side: row i, column j of a table is about the
        symbol that begins at place i of word j; a place in the table is i * n + j."""
        n, lengths = len(words), np.fromiter(map(len, words), np.int32, len(words))
        high = int(lengths.max())
        chars = np.frombuffer("".join(w.ljust(high) for w in words).encode("utf-32-le"), np.uint32).reshape(n, high)
        symbol = np.where(np.arange(high) < lengths[:, None], self.of_char[chars], GONE).T.ravel()
        after = np.repeat(np.arange(1, high + 1, dtype=np.int32), n)
        before = after - 2
        agenda = np.full(high * n, NEVER, np.int32)  # rank of the pair that begins here, then its row: the least is the best, the leftmost of equals
        makes = np.zeros(high * n, np.int32)

        def enter(place: np.ndarray, right: np.ndarray) -> None:
            """Put the pairs of the symbols at two places on the agenda; what was there for the first place is void."""
            x, y = symbol[place], symbol[right]
            at, hit = self._places(np.where((x >= 0) & (y >= 0), x.astype(np.int64) * self.span + y, NONE))
            agenda[place] = np.where(hit, self.pair_rank[at] * LONGEST + place // n, NEVER)
            makes[place] = self.pair_makes[at]

        first = np.flatnonzero((np.arange(1, high)[:, None] < lengths).ravel())
        enter(first, first + n)
        while True:
            best = agenda.reshape(high, n).min(axis=0)
            columns = np.flatnonzero(best != NEVER)
            if not len(columns):
                break
            row = best[columns] % LONGEST
            left = row * n + columns
            right = after[left] * n + columns
            symbol[left] = makes[left]
            symbol[right] = GONE
            follow = after[right]
            after[left] = follow
            agenda[left] = agenda[right] = NEVER
            some, prior = follow < lengths[columns], before[left]
            behind = follow[some] * n + columns[some]
            before[behind] = row[some]
            others = prior >= 0
            enter(np.concatenate([left[some], prior[others] * n + columns[others]]), np.concatenate([behind, left[others]]))
        symbol = symbol.reshape(high, n).T
        found = symbol != GONE
        ids, counts = symbol[found], found.sum(axis=1)
        odd = np.flatnonzero((ids < 0) | (ids >= self.pieces))  # characters that are no piece
        if len(odd):
            spelled = [self._spell(chr(c)) for c in chars[found][odd].tolist()]
            sizes = np.ones(len(ids), np.int64)
            sizes[odd] = [*map(len, spelled)]
            words_of, begins = np.repeat(np.arange(n), counts), np.cumsum(sizes) - sizes
            ids = np.repeat(ids, sizes)
            ids[_ranges(begins[odd], sizes[odd])] = [*chain.from_iterable(spelled)]
            counts = np.bincount(words_of, sizes, n).astype(np.int64)
        return ids, counts

    def _spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words of the texts, the number of each word among them, and where the words of each text begin."""
        spelled = pa.array(self.library.normalize([t.encode() for t in texts]), pa.large_binary())
        _, ends, data = spelled.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
        begins = np.zeros(len(data), bool)
        if self.parted and len(data) > 2:
            a, b, c = MARK.encode()
            begins[:-2] = (data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)
            begins[3:] &= ~begins[:-3]
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        begins = np.flatnonzero(begins)
        cut = pa.py_buffer(np.append(begins, len(data)).astype(np.int64))
        words = pa.LargeStringArray.from_buffers(len(begins), cut, pa.py_buffer(data)).dictionary_encode()
        return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), np.searchsorted(begins, ends)

    def _forget(self) -> None:
        """Of the remembered words, the half at most stay that were met in most of the last batches, in two at least."""
        stay = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2]
        stay = np.sort(stay[self.uses[stay] > 1])
        names, counts = [*self.known], self.counts[stay]
        self._remember({names[i]: k for k, i in enumerate(stay.tolist())}, self.store[_ranges(self.begins[stay], counts)], counts, self.uses[stay] // 2)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and where those of each text begin, with the end of the last."""
        words, number, bounds = self.split(texts)
        if len(self.known) >= REMEMBERED:
            self._forget()
        known = self.known
        at = np.fromiter(map(known.get, words, repeat(NONE)), np.int64, len(words))
        missing = np.flatnonzero(at == NONE)
        lengths = np.fromiter((len(words[i]) for i in missing.tolist()), np.int64, len(missing))
        order = np.argsort(lengths, kind="stable")
        short, long = missing[order[lengths[order] <= LONGEST]], missing[lengths > LONGEST]  # only short words are remembered
        if len(short):
            new = [words[i] for i in short.tolist()]
            ids, counts = zip(*(self.merge_many(new[k : k + MANY]) for k in range(0, len(new), MANY)), strict=True)
            at[short] = range(len(known), len(known) + len(new))
            known.update(zip(new, at[short].tolist(), strict=True))
            self._remember(known, np.concatenate([self.store, *ids]), np.concatenate([self.counts, *counts]), np.append(self.uses, np.zeros(len(new), np.int32)))
        self.uses[at[at != NONE]] += 1
        merged = [self.word(words[i]) for i in long.tolist()]
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        at[long] = len(known) + np.arange(len(long))
        store = np.append(self.store, np.fromiter(chain.from_iterable(merged), np.int32, sizes.sum()))
        begins, counts = np.append(self.begins, len(self.store) + np.cumsum(sizes) - sizes)[at], np.append(self.counts, sizes)[at]
        ids = store[_ranges(begins[number], counts[number])]
        return ids, np.append(0, np.cumsum(counts[number]))[bounds]


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, as many as its count, one range after the other."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


#: The encoder of this Python worker and the model that it was made from.
_worker: tuple[bytes, Encoder] | None = None


def encoder(model: bytes) -> Encoder:
    global _worker
    if _worker is None or _worker[0] != model:
        _worker = model, Encoder(model)
    return _worker[1]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ids (array), decoded (the text of the ids), agrees (the library gives the same ids).

    ``model`` is the vocabulary's file, read by the driver and passed to the tasks (less than a megabyte). Ids come without those of begin and end. Every batch is
    encoded by the library as well, and ``agrees`` tells the result; ids are decoded by the library. A null text counts as empty and has no ids. Rows that
    repeat a key, or have none, are encoded each for itself; further columns are not read. A very long word costs n log n.
    """
    with open(model, "rb") as f:
        proto = f.read()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(proto)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts):
                part = texts[a:b]
                flat, bounds = own.encode_many(part)
                ids = [flat[i:j] for i, j in pairwise(bounds.tolist())]
                checked = own.library.encode(part, num_threads=1, return_type="numpy")
                decoded = own.library.decode(ids, num_threads=1)
                agrees = [np.array_equal(x, y) for x, y in zip(ids, checked, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                columns = [batch.column(0).slice(a, b - a), lists, pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded", "agrees"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string, agrees boolean")
    return out.withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of ids, digest of the ids joined by commas, digest of the decoded text, and whether the library agrees."""
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
