"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A key descends: it draws once for each region, an exponential variate with the region's weight as its
rate, and enters the region with the least draw; there it draws once for each rack, and in the rack
once for each shard. So a key costs one hash a child on its way, not one a shard. A subtree weighs the
sum of its shards unless it has a weight of its own. What changes inside a subtree moves keys only
inside it, unless its weight changes; a weight that grows lowers one draw among siblings, so keys enter
that subtree and move between no others. A shard that opens a region of its own takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one shard are numbered in so many independent hash buckets.
SLOT_BUCKETS = 1024
#: Equal rows beyond so many are numbered by several tasks.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Shards, and weights of regions and of (region, rack) where they are not the sums of their shards."""

    shards: tuple[Shard, ...]
    regions: tuple[tuple[int, float], ...] = ()
    racks: tuple[tuple[tuple[int, int], float], ...] = ()

    def children(self) -> tuple[list, list, list]:
        """(name, weight, place) of regions, of racks by region, of shards by rack; live ones only.

        The place of a region or rack is its index in the next list, that of a shard its number.
        """
        live = [s for s in self.shards if s.weight > 0]
        rack_weight = {k: sum(s.weight for s in live if (s.region, s.rack) == k) for k in sorted({(s.region, s.rack) for s in live})}
        rack_weight = {k: w for k, v in rack_weight.items() if (w := dict(self.racks).get(k, v)) > 0}
        region_weight = {r: sum(w for k, w in rack_weight.items() if k[0] == r) for r in sorted({k[0] for k in rack_weight})}
        region_weight = {r: w for r, v in region_weight.items() if (w := dict(self.regions).get(r, v)) > 0}
        if not region_weight:
            raise ValueError("no shard has a positive weight")
        racks = [k for k in rack_weight if k[0] in region_weight]
        return (
            [(f"{r}", w, i) for i, (r, w) in enumerate(region_weight.items())],
            [[(f"{r}/{k[1]}", rack_weight[k], i) for i, k in enumerate(racks) if k[0] == r] for r in region_weight],
            [[(f"{r}/{k}/{s.number}", s.weight, s.number) for s in live if (s.region, s.rack) == (r, k)] for r, k in racks],
        )


def topology(shards: int, per_rack: int = 2, per_region: int = 4) -> Tree:
    """Shards 0.. fill racks, racks fill regions; an added shard never moves an earlier one.

    Growth by one shard takes keys only into it if the shards before it fill their regions.
    """
    return Tree(tuple(Shard(s, s // per_region, s // per_rack) for s in range(shards)))


def _options(children: list[tuple[str, float, int]]) -> str:
    return "array(" + ", ".join(f"named_struct('name', '{n}', 'weight', {float(w)!r}D, 'place', {p})" for n, w, p in children) + ")"


def _chosen(options: str) -> str:
    """The place of the option with the least draw: 52 hash bits, off zero, as a uniform variate, over the weight."""
    uniform = f"(cast(shiftrightunsigned(xxhash64(k, o.name), 12) as double) + 0.5D) / {float(2**52)!r}D"
    return f"array_min(transform({options}, o -> struct(-ln({uniform}) / o.weight AS draw, o.place AS place))).place"


def descend(key: str, tree: Tree) -> Column:
    """The shard number for column ``key``; a null key is a key like any other. Weights of 0 or less get nothing."""
    regions, racks, shards = tree.children()
    within = lambda lists, at: f"element_at(array({', '.join(map(_options, lists))}), {at} + 1)"
    steps = _chosen(within(shards, _chosen(within(racks, _chosen(_options(regions))))))
    quoted = key.replace("`", "``")
    return F.expr(f"cast(get(transform(array(`{quoted}`), k -> {steps}), 0) as int)")


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard for each row of ``df``.

    A null text has size 1 and crc32 0. A null key is a key like any other: such rows share a
    shard. Rows that repeat a key share a shard and get slots of their own. Slots of a shard are 0,
    1, 2, ... by hash bucket, key, crc32 and size, so they depend on the rows alone; rows equal in
    all of these are counted before they are numbered, so many of them are no large group. An empty
    table gives no rows. Columns other than the two named are ignored.
    """
    rows = df.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("string").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    bucket = F.pmod(F.xxhash64("_key", "text_crc32", F.lit("slot")), F.lit(SLOT_BUCKETS)).cast("int")
    placed = (
        rows.groupBy("_key", "size", "text_crc32")
        .agg(F.count("*").alias("_n"))
        .select("*", descend("_key", topology(shards)).alias("shard"), descend("_key", topology(shards + 1)).alias("grown_shard"), bucket.alias("_bucket"))
    )
    # At most shards * SLOT_BUCKETS rows, whatever the input.
    counts = placed.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_m"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_m").over(before(Window.partitionBy("shard").orderBy("_bucket"))), F.lit(0)).alias("_start"))
    earlier = F.coalesce(F.sum("_n").over(before(Window.partitionBy("shard", "_bucket").orderBy("_key", "text_crc32", "size"))), F.lit(0))
    groups = placed.withColumn("_earlier", earlier).join(F.broadcast(starts), ["shard", "_bucket"]).withColumn("_first", F.col("_start") + F.col("_earlier"))
    # rows equal in everything are made from their count, the many ones in chunks over several tasks
    few = groups.where(F.col("_n") <= CHUNK).select("*", F.explode(F.expr("sequence(0L, _n - 1)")).alias("_i"))
    chunks = groups.where(F.col("_n") > CHUNK).select("*", F.explode(F.expr(f"sequence(0L, _n - 1, {CHUNK}L)")).alias("_from")).repartition("_key", "_from")
    many = chunks.select("*", F.explode(F.expr(f"sequence(_from, least(_from + {CHUNK}L, _n) - 1)")).alias("_i")).drop("_from")
    return few.unionByName(many).select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_i")).cast("long").alias("slot"), "grown_shard")
