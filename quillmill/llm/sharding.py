"""Sharding by a hierarchical weighted hash tree, with DataFrame expressions only.

A key descends from the root over regions and racks to a shard.  At each level every
child draws -ln(u) / weight from a hash of the key and the child's name, and the least
draw wins, so a child gets its part of the weight, and a change of one child's weight
moves keys only to or from that child.

Shards beyond the `base` ones come as regions of their own with one rack and one shard.
So adding a shard changes no weight inside the other subtrees, and every key that moves
moves into the new shard: the law is `key`.

Slots are gapless within a shard.  They are counted in hash buckets of a shard and
shifted by the counts before, so no shard's rows meet in one task.

Null texts have size 16 and checksum 0.  A null doc_id descends like the key ''.  Rows
with equal ids share a shard and have slots of their own.  An empty table gives an
empty result.  Extra columns pass through `assign` untouched.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.common import ranked, table

LAW = "key"
SHARDS = 40
OVERHEAD = 16


@dataclasses.dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def topology(shards: int, base: int = SHARDS, racks: int = 2, region_shards: int = 10) -> list[Shard]:
    """The first `base` shards in full regions; each further one is a region of its own."""
    out = []
    for n in range(min(shards, base)):
        region, place = divmod(n, region_shards)
        out.append(Shard(f"r{region}", f"r{region}/k{place * racks // region_shards}", n))
    return out + [Shard(f"x{n}", f"x{n}/k0", n) for n in range(base, shards)]


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential draw from 52 bits of a hash, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(key, name), 12).cast("double")
    return -F.ln((bits + 0.5) / float(1 << 52)) / weight


def assign(df: DataFrame, key: Column, shards: list[Shard], name: str) -> DataFrame:
    """Adds `name`, the shard of each row's key.  The tree is a literal, so its size is
    that of the cluster and not of the data."""

    def total(own: list[Shard]) -> float:
        return float(sum(s.weight for s in own))

    def grouped(own: list[Shard], by: str) -> dict[str, list[Shard]]:
        out: dict[str, list[Shard]] = {}
        for s in own:
            out.setdefault(getattr(s, by), []).append(s)
        return out

    def node(label: str, own: list[Shard], below: Column) -> Column:
        return F.struct(F.lit(label).alias("name"), F.lit(total(own)).alias("weight"), below.alias("below"))

    tree = F.array(
        *(
            node(region, in_region, F.array(*(node(rack, in_rack, F.array(*(node(f"s{s.number}", [s], F.lit(s.number)) for s in in_rack))) for rack, in_rack in grouped(in_region, "rack").items())))
            for region, in_region in grouped(shards, "region").items()
        )
    )

    def least(children: Column) -> Column:
        # the number of the child comes second: equal draws fall to the first
        draws = F.transform(children, lambda c, i: F.struct(_draw(F.coalesce(F.col("_key"), F.lit("")), c["name"], c["weight"]).alias("draw"), i.alias("i")))
        return F.element_at(children, F.array_min(draws)["i"] + 1)["below"]

    out = df.withColumn("_key", key.cast("string")).withColumn("_tree", tree)
    for _ in range(2):
        out = out.withColumn("_tree", least(F.col("_tree")))
    return out.withColumn(name, least(F.col("_tree"))).drop("_key", "_tree")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = documents.count()
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = documents.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(LAW).alias("law"))
    placed = assign(assign(sized, F.col("doc_id"), topology(SHARDS), "shard"), F.col("doc_id"), topology(SHARDS + 1), "grown_shard")
    return ranked(placed, ["shard"], ["doc_id"], rows, "slot", SHARDS).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op3_sharding": op3_sharding}
ORACLE_SQL: dict[str, str] = {}
