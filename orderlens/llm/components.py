"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.sources.catalog import stored

_PARTS = 256  # join keys of a node


def _downward(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node ``u`` to the smaller ``v``."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` with ``m``, the smallest ``v`` of their ``u``.

    A node of very many edges is dealt to up to 256 join keys by the other end, and its
    minimum goes to those keys that occur, so it is no task of its own.
    """
    dealt = edges.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(_PARTS)).cast("int"))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("part").alias("parts"))
    return dealt.join(least.select("u", "m", F.explode("parts").alias("part")), ["u", "part"]).select("u", "v", "m")


def _stars(edges: DataFrame) -> DataFrame:
    """One round: neighbours above a node, then below it, are tied to the smallest neighbour.

    Smallest neighbours come from a minimum with a combine before the shuffle, so
    no list of neighbours is ever built.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    above = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    below = _with_least(above.where("u <> v").distinct()).select(
        F.explode(
            F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        ).alias("edge")
    )
    return _downward(below.select("edge.u", "edge.v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of an edge but the roots.

    ``edges`` has two columns of whole numbers, ``u`` and ``v``. Rounds are written
    to the shared folder, until one changes nothing. An edge with a null end, or from a
    node to itself, ties nothing; without edges the result is empty.
    """

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    current = stored(_downward(edges), "edges")
    before = state(current)
    while before[0]:
        current = stored(_stars(current), "edges")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
