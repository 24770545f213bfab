"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards.

Every shard has a weight, and a subtree the sum of its shards'. A row descends from the root: at each level every
child draws an exponential arrival time with its weight as the rate, -ln(u) / weight, from a hash of the row's key, the
level and the child's number, and the row goes into the child that draws least. So a row takes as many
draws as its path has children beside it, not as many as there are shards.

A child whose weight stays draws as before, and below it nothing changes: changed weights move rows only into
subtrees that grew or out of subtrees that shrank, at each level. A shard that is added as a region of its own takes rows
only into itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0 to shards - 1 of weight 1, racks and regions filled in turn."""
    return [Leaf(s // (per_rack * racks_per_region), s // per_rack, s, 1.0) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """tree with one more shard, in a region and a rack of its own."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, max(x.shard for x in tree) + 1, weight)]


def place(key: Column, tree: Iterable[Leaf], seed: int = 17) -> Column:
    """struct(region, rack, shard) of the leaf that the key descends to. Null keys hash alike.

    The tree is one literal, nested as regions, racks and shards, whatever its size.
    """
    nested: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            nested.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    if not nested:
        raise ValueError("the tree has no shard of positive weight")

    def node(number: int, leaves: list[Leaf], below: Column | None = None) -> Column:
        fields = [F.lit(number).alias("number"), F.lit(float(sum(x.weight for x in leaves))).alias("weight")]
        return F.struct(*fields, *([] if below is None else [below.alias("below")]))

    racks = lambda of: F.array(*[node(k, leaves, F.array(*[node(x.shard, [x]) for x in leaves])) for k, leaves in sorted(of.items())])
    regions = F.array(*[node(r, [x for leaves in of.values() for x in leaves], racks(of)) for r, of in sorted(nested.items())])

    def least(children: Column, level: int) -> Column:
        """struct(draw, child) of the child that draws least."""

        def draw(x: Column) -> Column:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), x["number"], F.lit(seed)), 11)
            return F.struct((-F.log((bits + F.lit(1.0)) / F.lit(2.0**53)) / x["weight"]).alias("draw"), x.alias("child"))

        return F.array_min(F.transform(children, draw))["child"]

    def then(x: Column, go: Callable[[Column], Column]) -> Column:
        return F.transform(F.array(x), go)[0]  # x is computed once

    def in_region(region: Column) -> Column:
        return then(least(region["below"], 1), lambda rack: F.struct(region["number"].alias("region"), rack["number"].alias("rack"), least(rack["below"], 2)["number"].alias("shard")))

    return then(least(regions, 0), in_region)


def slots(df: DataFrame, shard: str, key: str, out: str = "slot", parts: int = 1024) -> DataFrame:
    """df with out: numbers from 0 without gaps within each shard.

    No shard is sorted as a whole: rows fall by a hash of their columns into parts of each shard, so that a hot key is dealt over many, are numbered
    within their part, and start from the count of the parts before. The counts, broadcast, are at most
    shards x parts rows. Rows with equal keys are told apart by their other columns; entirely equal rows
    may take each other's numbers.
    """
    part = F.pmod(F.xxhash64(*[c for c in df.columns if c != shard]), F.lit(parts)).cast("int")
    rows = df.withColumn("__part", part)
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"))
        .select(F.col(shard).alias("__shard"), F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before.partitionBy(shard)), F.lit(0)).alias("__start"))
    )
    order = [key, *[c for c in df.columns if c not in (shard, key)]]
    number = F.row_number().over(Window.partitionBy(shard, "__part").orderBy(*order))
    return (
        rows.withColumn("__i", number)
        .join(F.broadcast(starts), (F.col(shard) == F.col("__shard")) & (F.col("__part") == F.col("__of")))
        .withColumn(out, F.col("__start") + F.col("__i") - 1)
        .drop("__part", "__i", "__shard", "__of", "__start")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law 'key', region, rack, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 8; text_crc32 is unsigned (null: that of no bytes).
    doc_id and the number of shards alone decide. grown_shard is the shard with one more, which is a region of its own. Repeated rows
    and rows with a null doc_id go where their doc_id goes; every row has a slot of its own. No rows give
    no rows; other columns of docs play no part.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(raw) + F.lit(8)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        place(F.col("doc_id"), even_tree(shards)).alias("home"), place(F.col("doc_id"), grown(even_tree(shards))).alias("grown"),
    ).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("home.region").alias("region"), F.col("home.rack").alias("rack"),
        F.col("home.shard").alias("shard"), F.col("grown.shard").alias("grown_shard"),
    )
    return slots(rows, "shard", "doc_id")
