"""Sharding by a hierarchical weighted hash tree (operator 2).

Every row descends region, rack and shard. At each level the children draw ``-ln(u) / weight`` with ``u`` hashed
from the row's key and the child's name, and the least draw wins. A child's draw does not depend on its siblings,
so a changed weight moves rows only into or out of that child's subtree.

Law: ``key``. Shard and doc_id alone decide; a shard added by ``ShardTree.grown`` stands in a region of its own
and takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one shard that are numbered together.
RUN_ROWS = 50_000


@dataclass(frozen=True)
class ShardTree:
    """``regions[r][k]`` holds the (shard number, weight) pairs of rack k of region r."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...] = field(default_factory=tuple)

    @staticmethod
    def balanced(shards: int = 24, per_rack: int = 4, racks: int = 2) -> ShardTree:
        ids = [(i, 1.0) for i in range(shards)]
        in_racks = [tuple(ids[i : i + per_rack]) for i in range(0, shards, per_rack)]
        return ShardTree(tuple(tuple(in_racks[i : i + racks]) for i in range(0, len(in_racks), racks)))

    def grown(self, weight: float = 1.0) -> ShardTree:
        """One more shard, in a region of its own."""
        new = 1 + max(i for region in self.regions for rack in region for i, _ in rack)
        return ShardTree((*self.regions, (((new, weight),),)))

    def shards(self) -> list[int]:
        return [i for region in self.regions for rack in region for i, _ in rack]


def _nested(x) -> str:
    return f"array({', '.join(map(_nested, x))})" if isinstance(x, list) else str(x)


def _winner(key: str, name: str, weights: str) -> Column:
    """Index of the child with the least weighted draw; children without weight draw nothing."""
    u = f"(shiftrightunsigned(xxhash64({key}, {name}, i), 11) + 0.5D) / {float(1 << 53)!r}D"
    return F.expr(f"array_min(transform({weights}, (w, i) -> if(w > 0, named_struct('d', -ln({u}) / w, 'i', i), null))).i")


def place(df: DataFrame, key: str, tree: ShardTree, out: str) -> DataFrame:
    """Add the shard of the key as column ``out`` (int). A null key draws like any other, so it has a shard too."""
    leaf_w = [[[f"{float(w)}D" for _, w in rack] for rack in region] for region in tree.regions]
    leaf_id = [[[i for i, _ in rack] for rack in region] for region in tree.regions]
    rack_w = [[f"{float(sum(w for _, w in rack))}D" for rack in region] for region in tree.regions]
    region_w = [f"{float(sum(w for rack in region for _, w in rack))}D" for region in tree.regions]
    return (
        df.withColumn("__region", _winner(key, "'region'", _nested(region_w)))
        .withColumn("__rack", _winner(key, "'rack', __region", f"get({_nested(rack_w)}, __region)"))
        .withColumn("__leaf", _winner(key, "'shard', __region, __rack", f"get(get({_nested(leaf_w)}, __region), __rack)"))
        .withColumn(out, F.expr(f"cast(get(get(get({_nested(leaf_id)}, __region), __rack), __leaf) as int)"))
        .drop("__region", "__rack", "__leaf")
    )


def assign_shards(df: DataFrame, tree: ShardTree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 8 (a null text has none, so 8). text_crc32 is null for a null text and 0 for an
    empty one. slot: gapless from 0 within the shard; rows of one key follow each other in any order. Rows with a null key go to one
    shard like those of any key. Other columns of the input are not read, whatever they are called. An empty input gives an empty result.

    Slots need no task that holds a shard: a shard's rows are numbered in runs dealt by a hash of the key, and
    the runs start where the counts of the runs before them end.
    """
    tree = tree or ShardTree.balanced()
    base = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    shards = len(tree.shards())
    total = base.select(F.count(F.lit(1))).first()[0]
    runs = max(1, -(-total // (RUN_ROWS * shards)), min(64, total // 256))
    placed = base.select(
        "k",
        (F.coalesce(F.octet_length("t"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode("t", "UTF-8")).alias("crc"),
    )
    placed = place(place(placed, "k", tree, "shard"), "k", tree.grown(), "grown").withColumn("run", F.pmod(F.xxhash64(F.lit("run"), "k", "crc"), F.lit(runs)).cast("int"))
    counts = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(
        F.col("shard").alias("o_shard"),
        F.col("run").alias("o_run"),
        (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("start"),
    )
    order = Window.partitionBy("shard", "run").orderBy("k", "crc", "size")
    return (
        placed.withColumn("rank", F.row_number().over(order))
        .join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("run") == F.col("o_run")))
        .select(
            F.col("k").alias(key),
            "size",
            F.col("crc").cast(T.LongType()).alias("text_crc32"),
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
            F.col("grown").alias("grown_shard"),
        )
    )
