"""Repair of conversation structure with Four-Russians block tables (operator 13).

Each row of a conversation is a symbol: the initial of its role and its fault. What the cheapest edits of the rest of a conversation cost from each state of the pattern
``(s?(ua)+)?`` is a vector of four numbers. Less their least number only a few dozen vectors exist, so tables hold, for every vector and every block of BLOCK symbols,
the vector in front of the block and what was taken off. Blocks are looked up from the end of a conversation to its begin; then each block is
expanded backward from the vector behind it, and the edits are read off from the front, the least letter first among those of least cost, which makes ties safe.

Tables of the shared folder keep the work in step: rows without texts give the edits of each conversation, which meet the texts again in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

BLOCK = 4
#: Symbols: 0 must be deleted; else 1 + 2 x initial (s, u, a, other) + truncated.
SYMBOLS = 9
#: What edits cost, fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. The state that a kept initial leads to, and the one that a user or assistant put there leads to.
KEPT = [{0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {}]
NEXT = [2, 2, 3, 2]
END = (0, 10, 5, 0)
#: White space, as in the words of this subpackage.
BLANK = r"[\x20\x09-\x0D]"
#: Characters of a text that order rows of one turn and role; a hash of the text goes on from there.
ORDER_CHARS = 32


def choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a row, in the order of their letters."""
    out = [("D", DELETE, state)]
    if symbol:
        initial, extra = divmod(symbol - 1, 2)
        if state in KEPT[initial]:
            out.append(("K", TRUNCATED * extra, KEPT[initial][state]))
        out.append(("R", REROLE + TRUNCATED * extra, NEXT[state]))
    return out


def before(symbol: int, behind: tuple) -> tuple:
    """Costs of each state in front of a row, from those behind it; turns may be inserted in front of the row."""
    cost = [min(c + behind[to] for _, c, to in choices(symbol, state)) for state in range(4)]
    for _ in range(2):  # at most a user and an assistant help
        cost = [min(cost[state], INSERT + cost[NEXT[state]]) for state in range(4)]
    return tuple(cost)


def _normal(vector: tuple) -> tuple[tuple, int]:
    least = min(vector)
    return tuple(v - least for v in vector), least


@lru_cache(maxsize=1)
def tables() -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(normalised vectors, table[vector, block] of the vector in front, table of what was taken off). A block's number has its first symbol as highest digit."""
    vectors, at = [_normal(END)[0]], {_normal(END)[0]: 0}
    step, taken = [], []
    for v in vectors:  # grows while it is read
        row = [_normal(before(s, v)) for s in range(SYMBOLS)]
        for w, _ in row:
            if w not in at:
                at[w] = len(vectors)
                vectors.append(w)
        step.append([at[w] for w, _ in row])
        taken.append([t for _, t in row])
    one, off = np.array(step, np.int16), np.array(taken, np.int32)
    table, total = one, off
    for _ in range(BLOCK - 1):  # one symbol more in front
        table, total = one[table].transpose(0, 2, 1).reshape(len(vectors), -1), (off[table] + total[:, :, None]).transpose(0, 2, 1).reshape(len(vectors), -1)
    return vectors, table, total


def _numbers(symbols: np.ndarray) -> np.ndarray:
    """Numbers of the whole blocks of ``symbols``, whose length is a multiple of BLOCK."""
    return symbols.reshape(-1, BLOCK).astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))


def repair(symbols: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation: the cheapest edits in order, the ASCII-least of equal cost."""
    return _short(symbols) if len(symbols) <= 16 else _repair(symbols)


def _repair(symbols: bytes) -> tuple[int, str]:
    vectors, table, total = tables()
    all_symbols = np.frombuffer(symbols, np.uint8)
    odd = len(all_symbols) % BLOCK  # symbols in front of the first whole block
    numbers = _numbers(all_symbols[odd:])
    behind = np.empty(len(numbers), np.int16)
    v, cost = 0, 0
    for k in range(len(numbers) - 1, -1, -1):
        behind[k] = v
        cost += int(total[v, numbers[k]])
        v = int(table[v, numbers[k]])
    audit: list[str] = []
    front = vectors[v]
    head = _expand(symbols[:odd], front)
    cost += head[0][0] - front[0]  # what the odd symbols add to state 0
    state = _read(symbols[:odd], head, 0, audit)
    for k in range(len(numbers)):
        part = symbols[odd + k * BLOCK : odd + (k + 1) * BLOCK]
        state = _read(part, _expand(part, vectors[behind[k]]), state, audit)
    audit.append({0: "", 1: "II", 2: "I", 3: ""}[state])
    return cost + front[0], "".join(audit)


def _expand(part: bytes, behind: tuple) -> list[tuple]:
    """The vectors at every place of a block, backward from the one behind it."""
    out = [behind]
    for s in reversed(part):
        out.append(before(s, out[-1]))
    return out[::-1]


def _read(part: bytes, costs: list[tuple], state: int, audit: list[str]) -> int:
    """Append the edits of a block to ``audit``; the state behind it."""
    for i, s in enumerate(part):
        while True:
            here = costs[i][state]
            edits = [(letter, to) for letter, c, to in choices(s, state) if c + costs[i + 1][to] == here]
            insert = INSERT + costs[i][NEXT[state]] == here
            if edits and (edits[0][0] == "D" or not insert):
                audit.append(edits[0][0])
                state = edits[0][1]
                break
            audit.append("I")
            state = NEXT[state]
    return state


_short = lru_cache(maxsize=1 << 16)(_repair)


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, copies) after damage by the CRC of conversation and turn; dropped rows have no copies. Nulls of role and text become one space."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col(conv).cast("string"), blank), F.coalesce(F.col(turn).cast("string"), blank))
    rows = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"), (F.crc32(name) % 20).alias("fault"))
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), copies.alias("copies"))


def _order(rows: DataFrame) -> DataFrame:
    """With what rows of a turn are ordered by: role, begin of the text, hash of both."""
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return rows.withColumn("start", F.substring("text", 1, ORDER_CHARS)).withColumn("h", digest)


ORDER = ["conv", "turn", "role", "start", "h"]


def _symbol(initial: Column, cut: Column) -> Column:
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return 1 + 2 * kind + cut.cast("int")


STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What is known of the conversation that is being read."""

    def __init__(self, conv):
        self.conv, self.symbols, self.turns = conv, bytearray(), 0
        self.first = self.last = self.initial = None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, symbol: int, is_blank: bool, repeated: bool, copies: int) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = (turn if self.first is None else self.first), turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.illegal += copies - 1  # equal initials side by side
        self.initial = initial
        if is_blank:
            self.blank += copies
            self.symbols += bytes(copies)
            return
        self.duplicate += copies - (not repeated)
        if not repeated:
            self.truncated += symbol % 2 == 0
            self.symbols.append(symbol)
        self.symbols += bytes(copies - (not repeated))

    def row(self) -> tuple:
        cost, audit = repair(bytes(self.symbols))
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _audits(batches: Iterator[pa.RecordBatch], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per conversation from rows in order; a conversation may go on in the next batch."""
    current, done = None, []
    for batch in batches:
        for conv, turn, initial, symbol, is_blank, repeated, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or current.conv != conv:
                if current is not None:
                    done.append(current.row())
                current = _Conversation(conv)
            current.add(turn, initial, symbol, is_blank, repeated, copies)
            if len(done) >= 4096:
                yield _batch(done, kinds)
                done = []
    if current is not None:
        done.append(current.row())
    if done:
        yield _batch(done, kinds)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256): each conversation's audit comes first, then its rows, which are hashed as they pass and not held."""
    conv, digest, audit, at, state, empty, done = None, None, "", 0, 0, True, []

    def say(line: str) -> None:
        nonlocal empty
        digest.update((line if empty else "\n" + line).encode())
        empty = False

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = NEXT[state]
            say("user:" if state == 2 else "assistant:")
            at += 1

    for batch in batches:
        for c, edits, role, text, copies in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if edits is not None:
                if digest is not None:
                    inserts()
                    done.append((conv, digest.hexdigest()))
                conv, digest, audit, at, state, empty = c, hashlib.sha256(), edits, 0, 0, True
                continue
            for _ in range(copies):
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = KEPT[("s", "u", "a").index(role[:1])][state]
                    say(f"{role}:{text}")
                elif edit == "R":
                    state = NEXT[state]
                    say(f"{'user' if state == 2 else 'assistant'}:{text}")
        if len(done) >= 4096:
            yield _batch(done, schema)
            done = []
    if digest is not None:
        inserts()
        done.append((conv, digest.hexdigest()))
    if done:
        yield _batch(done, schema)


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``rows`` after ``damaged``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null role or text counts as one space; rows without a conversation are one conversation with a null id; rows without a turn come first. Rows of one turn are in the order
    of their roles, the first ORDER_CHARS characters of their texts and a hash, so repeated rows are side by side. A conversation whose
    rows were all dropped has zeros, an empty audit and the hash of nothing. Further columns are not read; an empty table gives no rows. A conversation's audit, one
    letter a row, is held by a task; its texts, of any length, are not: they pass through the hash in order, which is by its nature one task for each conversation.
    """
    all_rows = _order(damaged(rows, conv, turn, role, text))
    last = F.right(F.regexp_replace("text", f"{BLANK}+$", ""), F.lit(1))
    slim = all_rows.select(*ORDER, F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), "copies")
    slim = slim.groupBy(*ORDER, "initial", "blank", "cut").agg(F.sum("copies").cast("int").alias("copies"))  # equal rows of one turn
    slim = keep(slim, "turns")
    # The first turn that says a text; a null turn is before all others.
    first = slim.where("copies > 0").groupBy("conv", "h").agg(F.min(F.struct("turn")).alias("first")).select(F.col("conv").alias("c"), F.col("h").alias("x"), "first")
    marked = slim.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h") == F.col("x")), "left")
    repeated = F.coalesce(~F.struct("turn").eqNullSafe(F.col("first")), F.lit(False))
    symbol = _symbol(F.col("initial"), F.col("cut")).cast("int")
    marked = marked.select(*ORDER, "initial", symbol.alias("symbol"), "blank", repeated.alias("repeated"), "copies")
    ordered = marked.repartition("conv").sortWithinPartitions(*ORDER).select("conv", "turn", "initial", "symbol", "blank", "repeated", "copies")
    kind = rows.schema[conv].dataType.simpleString()
    audits = keep(ordered.mapInArrow(_with_schema(_audits, rows, conv, STATS), f"conv {kind}, {STATS}"), "audits")
    edits = audits.select("conv", F.lit(None).cast(rows.schema[turn].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("start"), F.lit(b"").alias("h"), F.lit(0).alias("kind"), "audit", F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"))
    texts = all_rows.where("copies > 0").select(*ORDER, F.lit(1).alias("kind"), F.lit(None).cast("string").alias("audit"), "text", "copies")
    both = edits.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER[1:]).select("conv", "audit", "role", "text", "copies")
    hashed = both.mapInArrow(_with_schema(_repaired, rows, conv, "repaired_sha256 string"), f"conv {kind}, repaired_sha256 string").select(F.col("conv").alias("c"), "repaired_sha256")
    out = audits.join(hashed, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return out.withColumnRenamed("conv", conv)


def _with_schema(f, rows: DataFrame, conv: str, more: str):
    """``f`` with the Arrow schema of its result."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("conv", to_arrow_type(rows.schema[conv].dataType)), *[(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in more.split(", ")]])
    return lambda batches: f(batches, schema)
