"""N-gram Jaccard join with adaptive multi-match prefixes (operator 1).

Documents are sets of distinct 5-word shingles (64-bit hashes). All sets follow one global order, rare shingles first.
With a set of n shingles and the share ``t`` of it that any partner must have, the first ``n - t + l`` shingles
share at least ``l`` with the like prefix of every partner. Each document chooses its own ``l`` by the estimated cost:
shingles that a first count finds frequent make long posting lists, and a longer prefix that asks for more
shared shingles leaves fewer pairs to verify. Two documents are verified if they share the smaller of their ``l``, and as much
more as their sizes ask for.

Before two sets are shipped, their signatures are: about one to two bits a shingle, each the parity of the shingles that fall on it. Bits that
differ bound the shingles that differ from below, so a pair is dropped only if it can't link.

Skew. Equal sets are one node from the start. A posting list over ``max_list`` nodes is never expanded into pairs: each node in
one is verified against its best leader, verified links contract nodes into components, and what is left is verified between
units of at most about ``unit_docs`` nodes of like size, where units of one component are not compared and signatures are tried first. Pairs of units meet in cells of
CELL by CELL units, so that a unit is sent once to a cell and not once for each partner. No link between components is
lost; links within one component may be left out.

Memory. A task holds about PIECE bytes of text, one bucket of postings, a cell of units, or two sets. Buckets stand for 16 MB of text each up to MOST_BUCKETS of
them, and for more text beyond. Only the sketch of frequent shingles and a bitmap reach the driver. The bitmap is of fixed size; more input makes it coarser, which costs
time and not results. The sketch has at least four slots for each shingle in it and holds the most frequent ones, MOST_FREQUENT at most: more input asks for a higher count.
In a sketch that were filled, shingles of empty slots would pass for rare, and these are mostly those that the first count leaves out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import connected_components
from .text_hash import fingerprint, mix, shingle_sets

#: Shingles in the sketch at most; it has four slots or more for each, of one byte: eighths of the count's binary logarithm.
MOST_FREQUENT = 1 << 22
LEVELS = np.exp2(np.arange(256) / 8).astype(np.float32)
FILTER_BITS = 22
#: Shingles that a task packs together, and the bounds of the number of buckets they are packed for.
FLUSH = 1 << 20
LEAST_BUCKETS, MOST_BUCKETS = 512, 1 << 18
#: Parts into which the joins on a shingle with a long list are split.
SALTS = 16
#: Units of one group and size class that share a side of a cell.
CELL = 32
#: Fingerprints that a task remembers, so that copies it meets again send no postings.
SEEN = 1 << 16


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _signature(tokens: np.ndarray) -> bytes:
    """Parities of the shingles by their low bits; the number of bits is the power of two from the set's size on, 64 at least."""
    bits = 1 << max(6, int(len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(signature: np.ndarray, width: int) -> np.ndarray:
    """The signature of the same set with fewer bits (bytes along the last axis): the halves' parities add up."""
    while signature.shape[-1] > width:
        half = signature.shape[-1] // 2
        signature = signature[..., :half] ^ signature[..., half:]
    return signature


def _may_link(x: np.ndarray, nx, y: np.ndarray, ny, percent: int) -> np.ndarray:
    """Whether sets of these signatures and sizes can reach the similarity, as far as signatures tell."""
    width = min(x.shape[-1], y.shape[-1])
    differ = np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(axis=-1, dtype=np.int64)
    return (100 + percent) * (nx + ny - differ) >= 2 * percent * (nx + ny)


def _scan(buckets: int, percent: int):
    """Packed (id, size, fingerprint) rows with their signatures, and the shingles of prefixes of twice the least length, counted within the task.

    A bucket goes by the high bits of a hash, so the low 32 bits do for telling its shingles apart here.
    """

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            found = np.zeros((batch.num_rows, 5), np.int64)
            ids = batch.column(0)
            found[:, 0] = ids.fill_null(0).to_numpy()
            found[:, 4] = np.asarray(ids.is_null())
            held, size, signatures = [], 0, []

            def counted(held=held):
                tokens, counts = np.unique(np.concatenate(held), return_counts=True)
                bucket = _bucket(tokens, buckets)
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                often = counts > 1
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = often[a:b]
                    low = tokens[a:b].astype(np.uint32)
                    yield int(bucket[a]), False, low[~part].tobytes(), np.stack([low[part], counts[a:b][part].astype(np.uint32)]).tobytes()

            out = []
            for i, tokens in shingle_sets(batch.column(1)):
                n = len(tokens)
                found[i, 1], (found[i, 2], found[i, 3]) = n, fingerprint(tokens)
                if n:
                    signatures.append(_signature(tokens))
                    held.append(tokens[: 2 * (n - -(-percent * n // 100) + 1)])
                    size += len(held[-1])
                if size > FLUSH:
                    out += counted()
                    held.clear()
                    size = 0
            if held:
                out += counted()
            out.append((int(mix(np.array([task + number], np.uint64))[0] % np.uint64(buckets)), True, found.tobytes(), b"".join(signatures)))
            k, rows, one, many = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(rows), pa.array(one, pa.binary()), pa.array(many, pa.binary())], ["bucket", "rows", "one", "many"])

    return run


def _count(frequent: int):
    """Of one bucket: the rows, and the shingles counted at least ``frequent`` times as often as the middle one, which counts 1.

    Where most texts are there several times, all shingles are counted as often, which makes none of them frequent.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, tokens = pdf[pdf["rows"]], pdf[~pdf["rows"]]
        found = np.frombuffer(b"".join(rows["one"]), np.int64).reshape(-1, 5)
        packed = b"".join(rows["many"])
        ends = np.cumsum([(1 << max(6, int(n - 1).bit_length())) // 8 if n else 0 for n in found[:, 1]])
        signatures = [packed[a:b] for a, b in zip(np.append(0, ends), ends, strict=False)]
        one = np.frombuffer(b"".join(tokens["one"]), np.uint32)
        many = [np.frombuffer(m, np.uint32).reshape(2, -1) for m in tokens["many"]]
        token = np.concatenate([one, *(m[0] for m in many)])
        times = np.concatenate([np.ones(len(one), np.int64), *(m[1].astype(np.int64) for m in many)])
        order = np.argsort(token, kind="stable")
        token, times = token[order], times[order]
        starts = np.flatnonzero(np.diff(token, prepend=token[:1] + np.uint32(1))) if len(token) else np.empty(0, np.int64)
        sums = np.add.reduceat(times, starts) if len(starts) else np.empty(0, np.int64)
        if len(sums):
            sums = sums // np.partition(sums, len(sums) // 2)[len(sums) // 2]
        slots = token[starts][sums >= frequent].astype(np.int64)
        sums = sums[sums >= frequent]
        k = len(sums)
        ids = pd.array(np.concatenate([found[:, 0], np.zeros(k, np.int64)]), "Int64")
        ids[np.concatenate([found[:, 4] == 1, np.ones(k, bool)])] = pd.NA
        more = lambda i: np.concatenate([found[:, i], np.zeros(k, np.int64)])
        return pd.DataFrame({"id": ids, "n": more(1), "hi": more(2), "lo": more(3), "slot": np.concatenate([np.full(len(found), -1), slots]), "times": np.concatenate([np.zeros(len(found), np.int64), sums]), "signature": signatures + [None] * k})

    return run


def _estimates(scan: DataFrame) -> np.ndarray:
    """Level of the frequency by sketch slot; only the most frequent shingles are in the sketch, the others are of level 0 and count 1."""
    level = F.least(F.floor(8 * F.log2("times")), F.lit(len(LEVELS) - 1)).cast("short")
    found = scan.where("slot >= 0").select("slot", "times", level.alias("level"))
    least, size = len(LEVELS), 0
    for r in sorted(found.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        if size + r["k"] > MOST_FREQUENT:
            break
        least, size = r["level"], size + r["k"]
    out = np.zeros(1 << max(16, (4 * size - 1).bit_length()), np.uint8)
    slots = found.where(F.col("level") >= least).groupBy(F.expr(f"cast(slot & {len(out) - 1} as int)").alias("slot")).agg(F.sum("times").alias("times"))
    got = slots.select("slot", level.alias("level")).toArrow()
    out[got["slot"].to_numpy()] = got["level"].to_numpy()
    return out


def _frequency(levels: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return LEVELS[levels[tokens & np.uint64(len(levels) - 1)]]


def _prefixes(estimates, percent: int, choices: tuple[int, ...], verify_cost: float):
    """(node, l, prefix): the node is one half of the set's fingerprint. Copies that the task remembers are left out."""

    def run(batches):
        est = estimates.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for _, tokens in shingle_sets(batch.column(0)):
                n = len(tokens)
                if not n or (mark := fingerprint(tokens)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(mark)
                e = _frequency(est, tokens)
                need = -(-percent * n // 100)
                most = n - need + max(choices)
                if (e > 1).any():
                    order = np.argsort(e, kind="stable")
                    tokens_, e = tokens[order], e[order]
                else:
                    tokens_ = tokens
                total = np.cumsum(e[:most] - 1)
                best = (float("inf"), 1)
                for k in choices:
                    if k <= need:
                        cost = total[n - need + k - 1]
                        best = min(best, (k + cost + verify_cost * cost / k, k))
                rows.append((mark[0], best[1], tokens_[: n - need + best[1]].copy()))
            yield rows

    return run


def _pack(estimates, buckets: int, hot: float):
    """Postings by bucket of the shingle; postings of frequent shingles are dealt by node, as they are not paired there.

    Within a bucket the low 32 bits stand for a shingle; two that agree in them can only add a pair to verify.
    """

    def run(lists):
        est = estimates.value
        for rows in lists:
            at = 0
            while at < len(rows):
                tokens, size, nodes, ls = [], 0, [], []
                while at < len(rows) and size < FLUSH:
                    node, least, prefix = rows[at]
                    tokens.append(prefix)
                    nodes.append(node)
                    ls.append(least)
                    size += len(prefix)
                    at += 1
                node = np.repeat(np.array(nodes, np.int64), [len(t) for t in tokens])
                least = np.repeat(np.array(ls, np.uint8), [len(t) for t in tokens])
                token = np.concatenate(tokens)
                frequent = _frequency(est, token) >= hot
                spread = np.where(frequent, mix(node.astype(np.uint64)), token)
                bucket = _bucket(spread, buckets) * 2 + frequent
                order = np.argsort(bucket, kind="stable")
                bucket, token, node, least = bucket[order], token[order], node[order], least[order]
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                part = [(int(bucket[a]), (token[a:b] if bucket[a] % 2 else token[a:b].astype(np.uint32)).tobytes(), node[a:b].tobytes(), least[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                b, t, n, k = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([x // 2 for x in b], pa.int32()), pa.array([x % 2 == 1 for x in b]), pa.array(t, pa.binary()), pa.array(n, pa.binary()), pa.array(k, pa.binary())], ["bucket", "frequent", "tokens", "nodes", "least"])

    return run


def _match(max_list: int):
    """Pairs of the short lists of one bucket with the shingles they share, and the postings of its long lists."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def joined(rows, column, kind):
            return np.frombuffer(b"".join(rows[column]), kind)

        rare, often = pdf[~pdf["frequent"]], pdf[pdf["frequent"]]
        token, node, least = joined(rare, "tokens", np.uint32), joined(rare, "nodes", np.int64), joined(rare, "least", np.uint8)
        order = np.lexsort((node, token))
        token, node, least = token[order], node[order], least[order]
        if len(token):  # copies that several tasks sent are one node; should two sets share their half of a fingerprint, the smaller l counts
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, least = token[new], node[new], np.minimum.reduceat(least, np.flatnonzero(new))
        starts = np.flatnonzero(np.diff(token, prepend=token[:1] + np.uint32(1))) if len(token) else np.empty(0, np.int64)
        lengths = np.diff(np.append(starts, len(token)))
        many = np.repeat(lengths, lengths)
        place = np.arange(len(token)) - np.repeat(starts, lengths)
        long = many > max_list
        bucket = np.uint64(pdf["bucket"].iloc[0]) << np.uint64(32)
        hot_t = np.concatenate([token[long] | bucket, mix(joined(often, "tokens", np.uint64)) | np.uint64(1 << 63)]).view(np.int64)
        hot_n = np.concatenate([node[long], joined(often, "nodes", np.int64)])
        keep_ = (many > 1) & ~long
        node, least, many, place = node[keep_], least[keep_], many[keep_], place[keep_]
        a, b, need = [], [], []
        for d in range(1, int(many.max()) if len(many) else 1):
            i = np.flatnonzero(place + d < many)
            a.append(node[i])
            b.append(node[i + d])
            need.append(np.minimum(least[i], least[i + d]))
        pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1) if a else np.empty((0, 2), np.int64)
        at = counts = np.empty(0, np.int64)
        if len(pairs):
            pairs, at, counts = np.unique(pairs, axis=0, return_index=True, return_counts=True)
        need = np.concatenate(need)[at].astype(np.int64) if len(pairs) else at
        return pd.DataFrame({
            "token": pd.array(np.concatenate([np.zeros(len(pairs), np.int64), hot_t])),
            "a": np.concatenate([pairs[:, 0], hot_n]), "b": np.concatenate([pairs[:, 1], np.full(len(hot_n), -1)]), "shared": np.concatenate([counts, np.zeros(len(hot_n), np.int64)]),
            "need": np.concatenate([need, np.zeros(len(hot_n), np.int64)]),
        })

    return run


def _set_rows(wanted):
    def run(batches):
        bits = wanted.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1))
            if batch.num_rows:
                rows = [(i, *fingerprint(t), t.tobytes()) for i, t in shingle_sets(batch.column(1))]
                i, hi, lo, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(s, pa.binary())], ["id", "hi", "lo", "tokens"])

    return run


def _passing(percent: int):
    """The pairs whose signatures allow a link."""

    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in (4, 5))
                good[i] = _may_link(x, na[i], y, nb[i], percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _passing_units(percent: int):
    """The pairs of units of a cell in which some pair of signatures allows a link. Only small blocks of signatures are laid against each other."""

    def blocks(rows):
        by: dict[int, list] = {}
        for m in rows:
            by.setdefault(len(m["signature"]), []).append(m)
        return [(np.stack([np.frombuffer(m["signature"], np.uint8) for m in ms]), np.array([m["n"] for m in ms], np.int64)) for ms in by.values()]

    def run(pairs, units):
        of = {u: blocks(held) for u, held in zip(units["unit"].to_pylist(), units["held"].to_pylist(), strict=True)}
        pairs = pairs.select(["u", "v"])
        good = [any(_may_link(p[j : j + 1], n[j], q, m, percent).any() for p, n in of[u] for q, m in of[v] for j in range(len(n))) for u, v in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist(), strict=True)]
        return pairs.filter(pa.array(good, pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                if len(x) > len(y):
                    x, y = y, x
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _verify_units(percent: int):
    """Links between the sets of the paired units of a cell, without those that close a circle."""

    def run(pairs, units):
        of = {u: [(m["node"], np.frombuffer(m["tokens"], np.uint64)) for m in held] for u, held in zip(units["unit"].to_pylist(), units["held"].to_pylist(), strict=True)}
        found, root = [], {}

        def top(v):
            while root.setdefault(v, v) != v:
                v = root[v] = root[root[v]]
            return v

        for u, v in zip(pairs["u"].to_pylist(), pairs["v"].to_pylist(), strict=True):
            x, y = of[u], of[v]
            words = np.unique(np.concatenate([t for _, t in x + y]))
            one, two = (np.zeros((len(s), len(words)), np.float32) for s in (x, y))
            for grid, side in ((one, x), (two, y)):
                for k, (_, t) in enumerate(side):
                    grid[k, np.searchsorted(words, t)] = 1
            same = np.rint(one @ two.T).astype(np.int64)
            sizes = np.array([len(t) for _, t in x])[:, None] + np.array([len(t) for _, t in y])[None]
            for i, j in zip(*np.nonzero(100 * same >= percent * (sizes - same)), strict=True):
                a, b = x[i][0], y[j][0]
                if top(a) != top(b):
                    root[top(a)] = top(b)
                    found.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, tokens) of the needed nodes. A bitmap of fixed size spares the texts that no needed node has."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    words = needed.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("m")).collect()
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    for r in words:
        bits[r["w"]] = r["m"]
    wanted = spark.sparkContext.broadcast(bits.view(np.uint64))
    rows = docs.where("id is not null").select("id", "text", bit.alias("bit")).mapInArrow(_set_rows(wanted), "id long, hi long, lo long, tokens binary")
    return keep(rows.join(needed, ["id", "hi", "lo"]).dropDuplicates(["id", "hi", "lo"]).select("node", "tokens"), "sets")


def similar_components(
    df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, choices: tuple[int, ...] = (1, 2, 3, 4, 6, 8), verify_cost: float = 16.0, max_list: int = 32, frequent: int = 3, hot: float = 4096.0, unit_docs: int = 32, unit_tokens: int = 1 << 14
) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, the smallest key reachable by links (itself included).

    Documents link when ``100 * shared >= percent * all`` of their distinct shingles. Texts without words, empty or null, have no shingle
    and link with nothing: their component is their own key. Repeated rows keep their rows. A row with a null key counts as a copy of any equal text and has
    its component, else none, and links with nothing else. Further columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) >> 24))
    scan = keep(
        docs.mapInArrow(_scan(buckets, percent), "bucket int, rows boolean, one binary, many binary")
        .groupBy("bucket").applyInPandas(_count(frequent), "id long, n long, hi long, lo long, slot long, times long, signature binary"),
        "scan",
    )
    rows = scan.where("slot < 0").select("id", "n", "hi", "lo")
    sets_of = scan.where("slot < 0 and n > 0").groupBy("hi", "lo", "n").agg(F.min("id").alias("id"), F.max("signature").alias("signature"))
    nodes = keep(sets_of.withColumn("node", F.monotonically_increasing_id()), "nodes")
    known = nodes.where("id is not null")
    estimates = spark.sparkContext.broadcast(_estimates(scan))
    prefixes, pack = _prefixes(estimates, percent, choices, verify_cost), _pack(estimates, buckets, hot)
    # Within this step a node is named by half of its fingerprint; ``known`` gives all nodes of that name afterwards.
    matched = keep(
        docs.where("id is not null").select("text").mapInArrow(lambda batches: pack(prefixes(batches)), "bucket int, frequent boolean, tokens binary, nodes binary, least binary")
        .groupBy("bucket").applyInPandas(_match(max_list), "token long, a long, b long, shared long, need long"),
        "matched",
    )
    size = lambda x: known.select(F.col("hi").alias(f"hi_{x}"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs (hi_a, hi_b, ...) whose sizes allow the similarity, with their nodes, sizes and signatures."""
        both = pairs.join(size("a"), "hi_a").join(size("b"), "hi_b")
        return both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    # What two sets share behind the prefix that ends first is at most t - l, so of the overlap that their sizes ask
    # for the rest must be shared within the prefixes.
    overlap = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-9)
    behind = F.ceil(percent * F.greatest("na", "nb") / 100 - 1e-9) - F.col("need")
    pair = ["a", "b", "na", "nb", "sa", "sb"]
    sharing = matched.where("shared > 0").groupBy(F.col("a").alias("hi_a"), F.col("b").alias("hi_b")).agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need")
    candidates = fitting(sharing).where(F.col("shared") >= overlap - behind).select(*pair)
    postings = matched.where("shared = 0").select("token", F.col("a").alias("hi")).join(known.select("hi", "node"), "hi").select("token", "node", F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    postings = keep(postings, "postings")
    hot_nodes = keep(postings.groupBy("node").agg(F.count(F.lit(1)).alias("score")), "hot-nodes")
    any_hot = hot_nodes.limit(1).count() > 0
    if any_hot:
        leaders = postings.join(hot_nodes, "node").groupBy("token").agg(F.max(F.struct("score", "node")).alias("leader"))
        leaders = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        led = keep(postings.join(leaders, ["token", "salt"]).groupBy("node").agg(F.max("leader").alias("leader")).select("node", F.col("leader.node").alias("leader")), "led")
        by_node = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
        stars = led.where("node <> leader").toDF("a", "b").join(by_node("a"), "a").join(by_node("b"), "b")
        candidates = candidates.union(stars.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select(*pair))
    candidates = candidates.mapInArrow(_passing(percent), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    candidates = keep(candidates, "candidates")
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("node"))
    if any_hot:
        wanted = wanted.union(hot_nodes.select("node"))
    sets = _sets(docs, known.join(wanted.distinct(), "node").select("id", "hi", "lo", "node"))
    paired = candidates.join(sets.toDF("b", "y"), "b").select("a", "b", "y").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
    links = keep(paired.mapInArrow(_verify(percent), "a long, b long"), "verified")
    if any_hot:
        links = links.union(_between_units(postings, led, links, sets, known, percent, unit_docs, unit_tokens))
    components = connected_components(links)
    first = known.join(components, "node").groupBy("component").agg(F.min("id").alias("component_id"))
    linked = components.join(first, "component").select("node", "component_id")
    labelled = nodes.join(linked, "node", "left").select("hi", "lo", "n", F.coalesce("component_id", "id").alias("component_id"))
    return rows.join(labelled, ["hi", "lo", "n"], "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _between_units(postings, led, links, sets, known, percent, unit_docs, unit_tokens) -> DataFrame:
    """Links between nodes that share a long list and are not in one component yet.

    A unit holds nodes of one component, or of one leader, whose sizes are within a ratio of ``percent``; sizes of linked nodes are in
    the same or in neighbouring classes.
    """
    components = connected_components(links).toDF("node", "component")
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n")
    grouped = keep(
        led.join(known.select("node", "n", "signature"), "node").join(components, "node", "left")
        .select("node", "n", "signature", F.col("component").isNull().alias("loose"), F.coalesce("component", "leader").alias("group"), size_class.alias("class")),
        "grouped",
    )
    by = ["loose", "group", "class"]
    parts = grouped.groupBy(*by).agg(F.greatest(F.ceil(F.sum("n") / unit_tokens), F.ceil(F.count(F.lit(1)) / unit_docs)).alias("parts"))
    members = keep(grouped.join(parts, by).withColumn("unit", F.concat_ws("/", *by, F.pmod(F.xxhash64("node"), F.col("parts")))), "members")
    lists = keep(postings.join(members.select("node", "unit", *by), "node").select("token", *by, "unit").distinct(), "lists")
    main = lists.where("not loose").groupBy("token", "group").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "group")).alias("main"))
    others = lists.join(main, "token", "left").where("loose or not (group <=> main.group)").select("token", F.col("unit").alias("u"), F.when(~F.col("loose"), F.col("group")).alias("ug"), F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1)).alias("class"))
    pairs = (
        others.join(lists, ["token", "class"]).where("ug is null or loose or ug <> group")
        .select(F.least("u", "unit").alias("u"), F.greatest("u", "unit").alias("v")).distinct()
    )

    def held(what: DataFrame, *columns: str) -> DataFrame:
        return what.groupBy("unit").agg(F.collect_list(F.struct(*columns)).alias("held"))

    def in_cells(pairs: DataFrame, units: DataFrame, run, schema: str) -> DataFrame:
        block = lambda c: F.concat_ws("/", F.substring_index(c, "/", len(by)), F.floor(F.substring_index(c, "/", -1).cast("long") / CELL))
        cells = pairs.select("u", "v", F.least(block("u"), block("v")).alias("i"), F.greatest(block("u"), block("v")).alias("j"))
        there = cells.select(F.col("i").alias("k"), F.col("j").alias("l"), F.explode(F.array("u", "v")).alias("unit")).distinct().join(units, "unit")
        return cells.groupBy("i", "j").cogroup(there.groupBy("k", "l")).applyInArrow(run, schema)

    pairs = keep(in_cells(pairs, held(members, "n", "signature"), _passing_units(percent), "u string, v string"), "unit-pairs")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("unit")).distinct()
    units = keep(held(members.join(needed, "unit").join(sets, "node"), "node", "tokens"), "units")
    return keep(in_cells(pairs, units, _verify_units(percent), "a long, b long"), "unit-links")
