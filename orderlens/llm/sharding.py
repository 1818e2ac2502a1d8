"""Shards by a weighted hash tree: region, rack, shard.

A document descends the tree. At each node every child draws a number from the
hash of the identifier and the child's own name, scaled by the weight below the
child, and the smallest draw wins. A child's draw does not depend on its
siblings, so a change of weights moves documents only into subtrees that gained
weight or out of subtrees that lost it; draws inside all other subtrees stay.

A new shard takes documents into itself alone when it opens a region of its own,
which is how ``default_tree`` grows. Put into an old region, it also makes that
whole region draw more documents, of which its neighbours get their share.

Null identifiers are drawn as one identifier of their own; a null text has no
bytes. Rows that are equal get different slots: they are counted, the counts are
numbered, and each is unfolded again, so that very many equal rows are no burden to one
task. Other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import hash_long, id_text, unfolded, whole_text
from orderlens.sources.catalog import stored

# Rows that one task numbers at a time, about.
_BLOCK_ROWS = 20_000
_LEAST_BLOCKS = 64


@dataclass(frozen=True, order=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def default_tree(shards: int, first: int = 16, racks: int = 2, per_rack: int = 2) -> list[Shard]:
    """The first shards fill regions of equal racks; each later one opens a region of its own."""
    per_region = racks * per_rack
    filled = [
        Shard(s // per_region, s % per_region // per_rack, s) for s in range(min(shards, first))
    ]
    regions = -(-first // per_region)
    return filled + [Shard(regions + i, 0, first + i) for i in range(max(0, shards - first))]


def _draw(id_column: str, name: str, weight: float) -> Column:
    """Smaller for heavier children: the first arrival at a rate of ``weight``."""
    bits = hash_long(F.lit(name), id_text(id_column))
    return -F.ln((bits.cast("double") + 0.5) / float(1 << 48)) / F.lit(float(weight))


def _descend(shards: Sequence[Shard], id_column: str, levels: Sequence[str], name: str = "") -> Column:
    """The shard that wins below a node, as nested choices; only the winner's branch is evaluated."""
    if not levels:
        return F.lit(shards[0].shard)
    key = lambda s: getattr(s, levels[0])
    children = {k: list(below) for k, below in groupby(sorted(shards, key=key), key)}
    paths = {k: f"{name}/{levels[0]} {k}" for k in children}
    below = {k: _descend(c, id_column, levels[1:], paths[k]) for k, c in children.items()}
    if len(children) == 1:
        return next(iter(below.values()))
    draws = {k: _draw(id_column, paths[k], sum(s.weight for s in c)) for k, c in children.items()}
    winner = F.least(*[F.struct(draws[k].alias("draw"), F.lit(k).alias("child")) for k in children])["child"]
    choice = None
    for k in children:
        choice = (F if choice is None else choice).when(winner == k, below[k])
    return choice


def tree_shard(tree: Sequence[Shard], id_column: str = "doc_id") -> Column:
    """The shard of an identifier in a tree. Shards of no weight take nothing."""
    alive = [s for s in tree if s.weight > 0]
    if not alive:
        raise ValueError("the tree has no shard with weight")
    return _descend(alive, id_column, ["region", "rack", "shard"]).cast("int")


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2, ... within each value of ``group``.

    Equal rows are numbered together. What is left is numbered in blocks that the hash
    of ``order`` decides, so a group is never in one task; the sizes of earlier blocks
    are added. ``order`` must decide the other columns.
    """
    counted = stored(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times")), "shard-rows")
    total = counted.agg(F.sum("times")).first()[0] or 0
    blocks = max(_LEAST_BLOCKS, total // _BLOCK_ROWS)
    dealt = counted.withColumn("block", hash_long(*[id_text(c) for c in order]) % blocks)
    earlier = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(group, "block")
        .agg(F.sum("times").alias("rows_in_block"))
        .select(group, "block", F.coalesce(F.sum("rows_in_block").over(earlier), F.lit(0)).alias("rows_before"))
    )
    in_block = Window.partitionBy(group, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("in_block", F.coalesce(F.sum("times").over(in_block), F.lit(0)))
        .join(before, [group, "block"])
        .withColumn("first_slot", F.col("rows_before") + F.col("in_block"))
    )
    many = unfolded(placed.where("times > 1"), "times", "equal")
    each = placed.where("times = 1").withColumn("equal", F.lit(0).cast("long")).unionByName(many)
    return each.select(*rows.columns, (F.col("first_slot") + F.col("equal")).alias("slot"))


def shards_by_key(
    docs: DataFrame,
    tree: Sequence[Shard],
    grown: Sequence[Shard] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Shard and slot of each row, its size and text checksum, and its shard in the ``grown`` tree."""
    rows = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(whole_text(text_column)) + 1).cast("long").alias("size"),
        F.crc32(whole_text(text_column).cast("binary")).alias("text_crc32"),
    ).select(
        "*",
        tree_shard(tree, "id").alias("shard"),
        (F.lit(None).cast("int") if grown is None else tree_shard(grown, "id")).alias("grown_shard"),
    )
    return numbered(rows, "shard", ["id", "text_crc32", "size"]).select(
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
