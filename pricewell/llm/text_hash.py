"""Word and shingle hashes of many texts at once, in numpy, for use inside Spark tasks.

Hashes are 64-bit and depend on nothing but the text, so every executor agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are hashed together; longer texts are cut at spaces.
PIECE = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240501))
_byte = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_byte[65:91] = _byte[97:123]  # A-Z count as a-z
_exact_byte = _byte.copy()  # every byte counts as itself
_exact_byte[65:91] = np.random.Generator(np.random.PCG64(20240502)).integers(1, 2**64, 26, dtype=np.uint64)
_space = np.zeros(256, dtype=bool)
_space[[32, 9, 10, 11, 12, 13]] = True
_steps = _rng.integers(0, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def _hash_piece(data: np.ndarray, borders: np.ndarray, table: np.ndarray = _byte) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, where they start and where they end; a word also ends at a border."""
    if not len(data):
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    space = _space[data]
    first = ~space
    first[1:] &= space[:-1]
    at = borders[(borders > 0) & (borders < len(data))]
    first[at] |= ~space[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, U), starts, starts
    gaps = np.flatnonzero(space)
    ends = np.append(gaps, len(data))[np.searchsorted(gaps, starts)]
    ends[:-1] = np.minimum(ends[:-1], starts[1:])
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * _BASE), starts, ends


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and the offsets of its rows; null texts are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)), offsets


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of all words, words before each row) for slices of a string array; null texts have no words.

    A slice holds about PIECE bytes, or one longer text.
    """
    data, offsets = _buffers(texts)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        part, borders = data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        if len(part) <= PIECE:
            hashes, starts, _ = _hash_piece(part, borders)
        else:
            found, at, begin = [], [], 0
            while begin < len(part):
                end = min(len(part), begin + PIECE)
                while end < len(part) and not _space[part[end]]:
                    near = np.flatnonzero(_space[part[end : end + PIECE]])
                    end = end + int(near[0]) if len(near) else min(len(part), end + PIECE)
                h, s, _ = _hash_piece(part[begin:end], borders - begin)
                found.append(h)
                at.append(s + begin)
                begin = end
            hashes, starts = np.concatenate(found), np.concatenate(at)
        yield row, hashes, np.searchsorted(starts, borders)
        row = last


def line_hashes(texts: pa.Array, depth: int) -> Iterator[dict[str, np.ndarray]]:
    """The lines with a word in slices of a string array: row, start and end (bytes of ``_buffers``), n (words), and hashes: ``whole`` of the words as they are, ``exact`` of
    the words where those with a digit are one wildcard, ``leaf`` of their number and the first ``depth`` of these.

    A slice holds about PIECE bytes, or one longer line.
    """
    data, offsets = _buffers(texts)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        begin, stop = int(offsets[row]), int(offsets[last])
        while begin < stop:
            end = stop
            if stop - begin > PIECE:
                breaks = np.flatnonzero(data[begin : begin + PIECE] == 10)
                end = begin + int(breaks[-1]) + 1 if len(breaks) else begin + PIECE
                while not len(breaks) and end < stop:
                    breaks = np.flatnonzero(data[end : end + PIECE] == 10)
                    end = end + int(breaks[0]) + 1 if len(breaks) else min(stop, end + PIECE)
            found = _lines_of(data[begin:end], offsets[row : last + 1] - begin, depth)
            if len(found["n"]):
                found["row"] += row
                found["start"] += begin
                found["end"] += begin
                yield found
            begin = end
        row = last


def _lines_of(part: np.ndarray, borders: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    hashes, starts, ends = _hash_piece(part, borders, _exact_byte)
    breaks = np.flatnonzero(part == 10)
    inside = borders[(borders > 0) & (borders < len(part))]
    line_starts = np.unique(np.concatenate([[0], breaks + 1, inside]))
    line_of = np.searchsorted(line_starts, starts, "right") - 1
    first = np.flatnonzero(np.diff(line_of, prepend=-1))
    n = np.diff(np.append(first, len(starts)))
    digits = np.zeros(len(part) + 1, np.int64)
    np.cumsum((part >= 48) & (part <= 57), out=digits[1:])
    masked = np.where(digits[ends] > digits[starts], _BASE, hashes)
    up, down = _tables(len(hashes) + 1)

    def chain(h: np.ndarray, count: np.ndarray, kind: int) -> np.ndarray:
        sums = np.zeros(len(h) + 1, U)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        return mix((sums[first + count] - sums[first]) * down[first] + n.astype(U) * _steps[kind]).view(np.int64)

    at = line_starts[line_of[first]]
    stop = np.minimum(np.append(breaks, len(part))[np.searchsorted(breaks, at)], np.append(inside, len(part))[np.searchsorted(inside, at, "right")])
    row = np.searchsorted(borders, at, "right") - 1
    return {"row": row, "start": at, "end": stop, "n": n, "whole": chain(hashes, n, 41), "exact": chain(masked, n, 42), "leaf": chain(masked, np.minimum(n, depth), 43)}


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text. With fewer words the whole sequence is one shingle."""
    for row, words, bounds in word_hashes(texts):
        n = len(words)
        rolled = np.zeros(max(0, n - width + 1), U)
        for k in range(width):
            rolled += words[k : n - width + 1 + k] * _steps[k] if n >= width else U(0)
        rolled = mix(rolled)
        for i in range(len(bounds) - 1):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= width:
                yield row + i, np.unique(rolled[a : b - width + 1])
            elif b > a:
                short = (words[a:b] * _steps[32 : 32 + b - a]).sum(dtype=U) + U(b - a)
                yield row + i, mix(np.array([short], U))
            else:
                yield row + i, np.empty(0, U)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = mix(tokens ^ U(0x243F6A8885A308D3)).sum(dtype=U)
    b = mix(tokens ^ U(0x13198A2E03707344)).sum(dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
