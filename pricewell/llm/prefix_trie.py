"""Trie of conversation prefixes from sorted sequences (operator 11).

Conversations are sorted by their turns (as 128-bit digests), over many parts of bounded size. A prefix of d turns that begins at place i of the order is new there if its
length exceeds the common prefix with the place before (LCP). A sparse table of minima of the LCPs lets each candidate prefix find the ends of its interval by two
binary searches, one to each side, each for itself; the interval is its members. Sums over a subtree are differences of running sums, as a subtree is an
interval of the candidates too.

Prefixes that reach over the border of two parts are found by every part that holds some of their members; each gives its share. The same
search over the LCPs of the borders numbers these prefixes and adds the shares up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Prefixes of others are at most this long.
LEAD = 5
#: Turns of a part of the sorted order, in the mean.
PART_TURNS = 1 << 18
EMPTY = hashlib.sha256(b"").hexdigest()
#: As in the repair of turns: what rows of one turn are ordered by besides their role.
ORDER_CHARS = 32
MEASURES = "depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class Minima:
    """Sparse table of minima; ``left`` and ``right`` find how far a bound holds."""

    def __init__(self, values: np.ndarray):
        self.rows = [np.asarray(values)]
        while 2 << (len(self.rows) - 1) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place r >= at with values[at + 1 .. r] >= bound, by binary search."""
        r, n = at.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            can = r + (1 << k) < n
            can[can] = self.rows[k][r[can] + 1] >= bound[can]
            r[can] += 1 << k
        return r

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place l <= at with values[l + 1 .. at] >= bound, by binary search."""
        l = at.copy()  # noqa: E741
        for k in range(len(self.rows) - 1, -1, -1):
            can = l - (1 << k) >= 0
            can[can] = self.rows[k][l[can] - (1 << k) + 1] >= bound[can]
            l[can] -= 1 << k
        return l

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of values[lo .. hi]."""
        out, k = np.empty(len(lo), self.rows[0].dtype), np.frexp((hi - lo + 1).astype(float))[1] - 1
        for j in np.unique(k):
            m = k == j
            out[m] = np.minimum(self.rows[j][lo[m]], self.rows[j][hi[m] - (1 << int(j)) + 1])
        return out


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, .. (count numbers) for each row, in one array."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - start, count)


def common_prefixes(a: np.ndarray, b: np.ndarray, tokens: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the sequences that begin at a and b in ``tokens`` (n x 2 numbers)."""
    least = np.minimum(a_len, b_len)
    first = _ranges(a, least)
    differs = np.flatnonzero((tokens[first] != tokens[_ranges(b, least)]).any(axis=1))
    begins = np.cumsum(least) - least
    at = np.searchsorted(differs, begins)
    found = np.append(differs, len(first))[at] - begins
    return np.minimum(found, least)


# --- sequences -------------------------------------------------------------


def rebuilt_sequences(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, digests, sizes): every conversation's turns as digests of 16 bytes, joined, with their texts' code points.

    The first h turns are those of conversation c - c % 100, h being the CRC of c modulo 6; its own follow from the turn after its first h.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    by = F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said)))
    slim = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.struct(F.col(turn).cast("long").alias("turn"), by.alias("role"), F.substring(said, 1, ORDER_CHARS).alias("start"), digest.alias("d"), F.length(said).alias("size")).alias("t")
    )
    slim = keep(slim, "turns")
    bases = slim.where("conv % 100 = 0").withColumn("k", F.row_number().over(Window.partitionBy("conv").orderBy("t"))).where(f"k <= {LEAD}")
    leads = bases.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("k", "t"))).alias("lead")).select(F.col("conv").alias("base"), "lead")
    own = slim.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("own"))
    h = (F.crc32(F.col("conv").cast("string")) % 6).cast("int")
    both = own.withColumn("base", F.col("conv") - F.col("conv") % 100).join(leads, "base", "left")
    lead = F.transform(F.slice("lead", F.lit(1), h), lambda x: F.struct(x["t"]["d"].alias("d"), x["t"]["size"].alias("size")))
    rest = F.transform(F.slice("own", h + 1, F.size("own")), lambda x: F.struct(x["d"].alias("d"), x["size"].alias("size")))
    seq = both.select("conv", F.when(F.col("lead").isNull(), rest).otherwise(F.concat(lead, rest)).alias("s"))
    return seq.select("conv", F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["d"])), "")).alias("digests"), F.col("s.size").alias("sizes"))


# --- parts of the sorted order ---------------------------------------------

PART = "part int, convs binary, lengths binary, digests binary, sizes binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a sorted part."""
    convs, lengths, digests, sizes, part = [], [], [], [], None
    for b in batches:
        if b.num_rows:
            part = b.column(0)[0].as_py()
            convs.append(b.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            raw = [x or b"" for x in b.column(2).to_pylist()]
            lengths.append(np.array([len(x) // 16 for x in raw], np.int64))
            digests.append(b"".join(raw))
            sizes.append(b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    if convs:
        whole = [np.concatenate(convs).tobytes(), np.concatenate(lengths).tobytes(), b"".join(digests), np.concatenate(sizes).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in whole)], ["part", "convs", "lengths", "digests", "sizes"])


class _Part:
    def __init__(self, row: dict):
        self.part = row["part"]
        self.convs, self.lengths, self.sizes = (np.frombuffer(row[c], np.int64) for c in ("convs", "lengths", "sizes"))
        self.tokens = np.frombuffer(row["digests"], np.uint64).reshape(-1, 2)
        self.starts = np.cumsum(self.lengths) - self.lengths


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, first digests, last digests) of each part."""
    for b in batches:
        for row in b.to_pylist():
            p, raw = _Part(row), row["digests"]
            first, last = raw[: 16 * int(p.lengths[0])], raw[16 * int(p.starts[-1]) :]
            yield pa.RecordBatch.from_arrays([pa.array([p.part], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], ["part", "first", "last"])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // 16
    x, y = np.frombuffer(a, np.uint64)[: 2 * n], np.frombuffer(b, np.uint64)[: 2 * n]
    differs = np.flatnonzero(x != y)
    return int(differs[0]) // 2 if len(differs) else n


def _prefixes_of_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, border, inner): common prefix of a part's first sequence with the last one before it (-1: none), and with its own last one."""
    for b in batches:
        parts, firsts, lasts, priors = (b.column(i).to_pylist() for i in range(4))
        border = [-1 if x is None else _common(x, y) for x, y in zip(priors, firsts, strict=True)]
        inner = [_common(x, y) for x, y in zip(firsts, lasts, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(border, pa.int64()), pa.array(inner, pa.int64())], ["part", "border", "inner"])


#: A row of the search of a part. kind: a finished prefix, a share of one that reaches over borders (border, depth: which), or a member that ends at one of these.
FOUND = "kind string, border long, conv_id long, " + MEASURES + ", last_size long"
_FOUND = pa.schema([("kind", pa.string()), *((c, pa.int64()) for c in ("border", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("last_size", pa.int64())])


def _found(kind: str, n: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array([kind] * n, pa.string()) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND]
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND)


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def search(p: _Part, place: int, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Prefixes of the part at ``place``. ends[2k] is the LCP of the first sequence of part k and the last one before (-1 for the first part), ends[2k + 1]
    that of its first and last one. A prefix that reaches over borders is named by the first place of ``ends`` from which on all LCPs have its length."""
    n, come, go = len(p.convs), 2 * place, 2 * place + 2
    lcp = np.empty(n, np.int64)
    lcp[0] = ends[come]
    lcp[1:] = common_prefixes(p.starts[:-1], p.starts[1:], p.tokens, p.lengths[:-1], p.lengths[1:])
    onward = ends[go] if go < len(ends) else -1
    table, least, end_table = Minima(lcp), Minima(p.convs), Minima(ends)
    name = lambda at, depths: end_table.left(np.full(len(depths), at), depths) + 1
    # Candidates in order: at each place the prefixes that are new there, from short to long.
    new = p.lengths - lcp
    at, depth = np.repeat(np.arange(n), new), _ranges(lcp + 1, new)
    stop = np.cumsum(new)  # candidates up to the end of each place
    left, right = table.left(at, depth), table.right(at, depth)
    over = (right == n - 1) & (depth <= onward)
    closed = ~over
    size = np.where(depth > 0, np.append(p.sizes, 0)[p.starts[at] + depth - 1], 0)
    # A candidate's parent begins in this part, or comes from the part before.
    parent_at = table.left(at, depth - 1)
    inside = (depth > 0) & ((parent_at > 0) | (depth - 1 > lcp[0]))
    parent = np.where(inside, (stop - new)[parent_at] + depth - 2 - lcp[parent_at], -1)
    children = np.bincount(parent[inside], minlength=len(at))
    saved_to = _sums(np.where(closed, (right - left) * size, 0))
    leaf_to = _sums(closed & (children == 0))
    conv_of = least.least(left, right)
    # Members that end at a prefix are the first of its interval: a run of equal sequences.
    run_ends = np.flatnonzero(np.append((lcp[1:] < p.lengths[:-1]) | (p.lengths[1:] > p.lengths[:-1]), True))
    run_end = run_ends[np.searchsorted(run_ends, np.arange(n))]
    shas = np.full(len(at), EMPTY, object)
    for k in np.flatnonzero(closed & (depth == p.lengths[at])):
        shas[k] = hashlib.sha256(",".join(map(str, p.convs[at[k] : run_end[at[k]] + 1].tolist())).encode()).hexdigest()
    kept_parent = inside & closed & np.append(closed, True)[parent]
    outside = closed & (depth > 0) & ~kept_parent
    border = np.full(len(at), -1)
    border[outside & inside] = name(go, depth[outside & inside] - 1)
    border[outside & ~inside] = name(come, depth[outside & ~inside] - 1)
    c = np.flatnonzero(closed)
    yield _found(
        "prefix", len(c), conv_id=conv_of[c], depth=depth[c], n_convs=right[c] - left[c] + 1, n_children=children[c],
        n_leaves=leaf_to[stop[right[c]]] - leaf_to[c], saved_tokens=saved_to[stop[right[c]]] - saved_to[c], ends_sha256=shas[c].tolist(),
        parent_conv_id=pa.array(conv_of[np.where(kept_parent, parent, 0)[c]], pa.int64(), mask=~kept_parent[c]), border=pa.array(border[c], pa.int64(), mask=~outside[c]),
    )
    # Shares of prefixes that go on in the next part.
    o = np.flatnonzero(over)
    kids = np.bincount(parent[outside & inside], minlength=len(at))
    yield _found(
        "share", len(o), border=name(go, depth[o]), depth=depth[o], conv_id=conv_of[o], n_convs=right[o] - left[o] + 1, n_children=kids[o],
        n_leaves=leaf_to[stop[right[o]]] - leaf_to[o], saved_tokens=saved_to[stop[right[o]]] - saved_to[o], last_size=size[o],
    )
    for k in o[depth[o] == p.lengths[at[o]]]:
        members = p.convs[at[k] : run_end[at[k]] + 1]
        yield _found("end", len(members), border=np.repeat(name(go, depth[k : k + 1]), len(members)), depth=np.repeat(depth[k], len(members)), conv_id=members)
    # Shares of prefixes that come from the part before: their interval begins at the first place.
    back = np.arange(lcp[0] + 1)
    if len(back):
        zero = np.zeros(len(back), np.int64)
        r = table.right(zero, back)
        kids = np.bincount((depth - 1)[outside & ~inside], minlength=len(back))
        sizes = np.where(back > 0, np.append(p.sizes, 0)[back - 1], 0)
        yield _found("share", len(back), border=name(come, back), depth=back, conv_id=least.least(zero, r), n_convs=r + 1, n_children=kids, n_leaves=leaf_to[stop[r]], saved_tokens=saved_to[stop[r]], last_size=sizes)
        short = np.flatnonzero(p.lengths <= lcp[0])
        short = short[short <= r[p.lengths[short]]]
        yield _found("end", len(short), border=name(come, p.lengths[short]), depth=p.lengths[short], conv_id=p.convs[short])


def _searched(batches: Iterator[pa.RecordBatch], places: dict[int, int], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            yield from search(_Part(row), places[row["part"]], ends)


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(border, depth, sha) from rows in order; members pass through the hash and are not held."""
    current, digest, done = None, None, []
    for b in batches:
        for border, depth, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if current != (border, depth):
                if digest is not None:
                    done.append((*current, digest.hexdigest()))
                current, digest, comma = (border, depth), hashlib.sha256(), ""
            digest.update(f"{comma}{conv}".encode())
            comma = ","
    if digest is not None:
        done.append((*current, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["border", "depth", "sha"])


def _over_borders(batches: Iterator[pa.RecordBatch], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The prefixes that reach over borders, from their added shares: a row for each."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).sort_by([("border", "ascending"), ("depth", "ascending")])
    border, depth, conv, n, kids, leaves, saved, size = (t.column(c).to_numpy() for c in ("border", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "last_size"))
    table = Minima(ends)
    code = border * (int(depth.max()) + 2) + depth  # in order, as the rows are
    up = (table.left(border, depth - 1) + 1) * (int(depth.max()) + 2) + depth - 1
    parent = np.where(depth > 0, np.searchsorted(code, up), 0)
    children = kids + np.bincount(parent[depth > 0], minlength=len(code))
    here, stop = np.arange(len(code)), np.searchsorted(border, table.right(border, depth), "right")
    saved_to, leaf_to = _sums((n - 1) * size), _sums(children == 0)
    yield _found(
        "prefix", len(code), border=border, depth=depth, conv_id=conv, n_convs=n, n_children=children, n_leaves=leaves + leaf_to[stop] - leaf_to[here], saved_tokens=saved + saved_to[stop] - saved_to[here],
        parent_conv_id=pa.array(conv[parent], pa.int64(), mask=depth == 0), ends_sha256=t.column("sha").to_pylist(),
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in order (null first), rows of one turn by role, the first ORDER_CHARS characters of the text and a digest; repeated rows are turns of their own. A null role or text
    is empty. Rows without a conversation belong to none and are left out; further columns are not read; an empty table has no prefixes. Turns
    are compared by digests of 128 bits. A task holds the digests (16 bytes a turn) of single conversations and of parts of about PART_TURNS turns, whatever the texts are;
    copies of a conversation are spread over parts. Only the LCPs at the parts' ends, two numbers a part, pass through the driver.
    """
    spark = rows.sparkSession
    seqs = keep(rebuilt_sequences(rows, conv, turn, role, text), "sequences")
    turns = seqs.agg(F.sum(F.size("sizes"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // PART_TURNS))
    ordered = seqs.repartitionByRange(parts, "digests", "conv").sortWithinPartitions("digests", "conv")
    packed = keep(ordered.select(F.spark_partition_id().alias("part"), "conv", "digests", "sizes").mapInArrow(_pack, PART), "parts")
    firsts = packed.mapInArrow(_ends, "part int, first binary, last binary")
    firsts = firsts.withColumn("prior", F.lag("last").over(Window.orderBy("part")))  # a row a part
    found_ends = sorted(firsts.mapInArrow(_prefixes_of_ends, "part int, border long, inner long").collect())
    places = {r[0]: i for i, r in enumerate(found_ends)}
    ends = np.array([x for r in found_ends for x in r[1:]], np.int64)
    found = keep(packed.mapInArrow(lambda batches: _searched(batches, places, ends), FOUND), "prefixes")
    shares = found.where("kind = 'share'").groupBy("border", "depth").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("last_size").alias("last_size")
    )
    members = found.where("kind = 'end'").select("border", "depth", "conv_id").repartition("border", "depth").sortWithinPartitions("border", "depth", "conv_id")
    shas = members.mapInArrow(_hashed_ends, "border long, depth long, sha string")
    added = shares.join(shas, ["border", "depth"], "left").fillna(EMPTY, ["sha"])
    over = keep(added.coalesce(1).mapInArrow(lambda batches: _over_borders(batches, ends), FOUND), "border-prefixes")  # at most the parts times their common prefixes
    parents = over.select("border", (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("over_conv"))
    if int(np.maximum(ends[::2] + 1, 0).sum()) <= 1_000_000:
        parents = F.broadcast(parents)
    closed = found.where("kind = 'prefix'").join(parents, ["border", "depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over_conv"))
    return closed.select(*COLUMNS).unionByName(over.select(*COLUMNS))
