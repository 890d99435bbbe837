"""Sharding by a hierarchical weighted hash tree.

A shard tree has regions, racks and shards, each with a weight.  A row descends it: at each level
every child draws ``-ln(u) / weight`` with ``u`` hashed from the key and the child's name, and the
smallest draw wins (ties: the smallest id).  A child thus wins with probability weight / sum of
weights, and changing one child's weight changes only that child's draw: rows move only into a
subtree that gained weight or out of one that lost it, never between two untouched subtrees.

``ShardTree.grow`` adds a shard as a region of its own.  Placed inside an existing region it would
raise that region's weight, and the rows won by the region could land on its old shards; as an own
region it takes rows only into itself.

Everything is a column expression: no Python runs on the executors, and a row's shard needs no
other row.  Slots (places in a shard) come from counts per (shard, bucket) and a row number in
each bucket, so no task ever holds a whole shard.

Defined cases: a null key counts as the word ``null``; a null text has no bytes (size 16,
crc32 0); repeated rows get the same shard and different slots; an empty table gives no rows;
columns other than the key and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 13 hex digits are 52 bits, which a double holds exactly.
_UNIT = float(1 << 52)


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class ShardTree:
    shards: tuple[Shard, ...]

    @staticmethod
    def balanced(regions: int, racks: int, shards: int) -> ShardTree:
        """``regions`` x ``racks`` x ``shards`` leaves of weight 1, numbered from 0."""
        return ShardTree(tuple(
            Shard(r, k, (r * racks + k) * shards + s)
            for r in range(regions) for k in range(racks) for s in range(shards)))

    def grow(self, weight: float = 1.0) -> ShardTree:
        region = max(s.region for s in self.shards) + 1
        return ShardTree((*self.shards, Shard(region, 0, max(s.shard for s in self.shards) + 1, weight)))

    def reweight(self, shard: int, weight: float) -> ShardTree:
        return ShardTree(tuple(Shard(s.region, s.rack, s.shard, weight) if s.shard == shard else s
                               for s in self.shards))

    def regions(self) -> dict[int, float]:
        out: dict[int, float] = {}
        for s in self.shards:
            out[s.region] = out.get(s.region, 0.0) + s.weight
        return out

    def racks(self, region: int) -> dict[int, float]:
        out: dict[int, float] = {}
        for s in self.shards:
            if s.region == region:
                out[s.rack] = out.get(s.rack, 0.0) + s.weight
        return out

    def leaves(self, region: int, rack: int) -> dict[int, float]:
        return {s.shard: s.weight for s in self.shards if (s.region, s.rack) == (region, rack)}


def _unit(name: Column) -> Column:
    """A draw in (0, 1) from the md5 of ``name``."""
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / _UNIT


def _children(weights: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("w"))
                     for i, w in sorted(weights.items()) if w > 0])


def _winner(children: Column, name: Column) -> Column:
    """The id of the child with the smallest weighted draw under ``name``."""
    draws = F.transform(children, lambda c: F.struct(
        (-F.ln(_unit(F.concat_ws("/", name, c["id"].cast("string")))) / c["w"]).alias("e"), c["id"].alias("id")))
    return F.array_min(draws)["id"]


def _pick(key: Column, choices: list[tuple[Column, Column]]) -> Column:
    out = F.when(*choices[0])
    for condition, value in choices[1:]:
        out = out.when(condition, value)
    return out


def assign(df: DataFrame, tree: ShardTree, key: str, into: str) -> DataFrame:
    """``df`` with an int column ``into``: the shard of each row's ``key``."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    regions = tree.regions()
    df = df.withColumn("_region", _winner(_children(regions), F.concat(F.lit("region:"), name)))
    region = F.col("_region")
    df = df.withColumn("_rack", _pick(region, [
        (region == r, _winner(_children(tree.racks(r)), F.concat(F.lit(f"rack:{r}:"), name))) for r in regions]))
    rack = F.col("_rack")
    df = df.withColumn(into, _pick(region, [
        ((region == r) & (rack == k), _winner(_children(tree.leaves(r, k)), F.concat(F.lit(f"shard:{r}:{k}:"), name)))
        for r in regions for k in tree.racks(r)]).cast("int"))
    return df.drop("_region", "_rack")


def shard_rows(docs: DataFrame, tree: ShardTree, key: str = "doc_id", text: str = "text",
               buckets: int = 256) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``buckets`` splits each shard for numbering; shards x buckets offsets are broadcast, which
    is a fixed number of rows however large ``docs`` is.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    base = assign(assign(base, tree, "doc_id", "shard"), tree.grow(), "doc_id", "grown_shard")
    bucket = F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 8), 16, 10)
                    .cast("long"), F.lit(buckets)).cast("int")
    base = base.withColumn("_bucket", bucket)
    counts = (assign(docs.select(F.col(key).alias("doc_id")), tree, "doc_id", "shard").withColumn("_bucket", bucket)
              .groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32")
    return (base.withColumn("_place", F.row_number().over(place))
            .join(F.broadcast(offsets), ["shard", "_bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_before") + F.col("_place") - 1).cast("long").alias("slot"), "grown_shard"))
