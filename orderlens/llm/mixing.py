"""Mixing sources to target weights by systematic sampling.

Each document has an expected number of copies, its source's target over its
source's size. Along a fixed order the expected copies of a source are summed, one
random offset is added, and a document is emitted once per whole number that the
sum crosses on it. So each document gets the whole number below or above its
expectation, and neighbours in the order balance each other. The order is by
size, so that the words taken come near the target as well as the copies.

Sizes count words; a null or empty text has none. A null source is a source of its
own, the last. Sums are exact: expectations are multiples of 2**-24. The same rows
and seed give the same copies, whatever their order; rows that are equal in
identifier, source and size are interchangeable, so they are counted, ranked together
and unfolded again. The order has size classes first, then parts of about 20,000 rows
that a hash of identifiers deals, then sizes; when a class outgrows a part its rows are
dealt anew, so other documents may then be taken. An empty table gives an empty result;
sources without words get no copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import WORD, hash_long, id_text, unfolded, unused_name, whole_text
from orderlens.sources.catalog import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2

_UNIT_BITS = 24
_SIZE_STEPS = 16  # size classes per factor e
_BLOCK_ROWS = 20_000


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``target`` of each source from (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn. Targets stop
    at ``MOST_COPIES`` times the size; the excess is shared among the others by
    weight. With sources ordered by limit over weight, the ones that stop are the
    first; the level of the others follows from running sums.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank"), F.lit(len(weights))) + 1)
    weighed = sizes.withColumn("rank", F.row_number().over(ordered) - 1).select(
        "source",
        "source_size",
        "rank",
        weight.alias("weight"),
        (F.col("source_size") * MOST_COPIES).alias("limit"),
    )
    tightest = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = tightest.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = weighed.withColumn("level", level)
    stops = F.col("limit") / F.col("weight") <= F.col("level")
    # The level that counts is that of the first source that does not stop.
    common = levels.withColumn("level", F.min(F.when(~stops, F.struct(F.col("limit") / F.col("weight"), "rank", "level")))
                               .over(everything)["level"])
    return common.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")), F.col("limit").cast("double"))
        .alias("target"),
    )


def systematic_copies(
    docs: DataFrame,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    row_column: str | None = None,
) -> DataFrame:
    """For each row: its size, source_size, target and number of ``copies``.

    If ``row_column`` names a key of the rows, it is given instead of the identifier,
    and rows are dealt and ordered by their texts as well.
    """
    keys = ["source", "size", "size_class", "id"]
    tie = [F.md5(whole_text(text_column).cast("binary")).alias("tie"), F.col(row_column).alias("row")] if row_column else []
    ties = ["tie", "row"] if row_column else []
    every = docs.select(
        *tie,
        F.col(id_column).alias("id"),
        F.col(source_column).alias("source"),
        F.regexp_count(whole_text(text_column), F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("size_class", F.floor(F.ln(F.col("size") + 1) * _SIZE_STEPS).cast("int"))
    counted = (
        every.withColumn("times", F.lit(1).cast("long"))
        if row_column
        else every.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    )
    rows = stored(counted, "mix-sizes")
    goals = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size")), weights, share)
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << _UNIT_BITS)))
    source_text = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    offset = F.pmod(hash_long(F.lit(str(seed)), F.lit("offset"), source_text), F.lit(1 << _UNIT_BITS))
    goals = goals.select("*", F.coalesce(rate, F.lit(0)).alias("rate"), offset.alias("offset"))

    # A class of a source with many rows is numbered in parts, dealt by identifier.
    classes = rows.groupBy("source", "size_class").agg(F.ceil(F.sum("times") / _BLOCK_ROWS).alias("parts"))
    same = lambda a, b, *names: [a[n].eqNullSafe(b[n]) for n in names]
    deal = hash_long(F.lit(str(seed)), id_text("id"), *(["tie"] if row_column else []))
    dealt = rows.join(classes, same(rows, classes, "source", "size_class")).select(
        rows["*"], F.pmod(deal, "parts").alias("part")
    )
    part = ["source", "size_class", "part"]
    earlier = Window.partitionBy("source").orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        dealt.groupBy(*part)
        .agg(F.sum("times").alias("rows_in_part"))
        .select(*part, F.coalesce(F.sum("rows_in_part").over(earlier), F.lit(0)).alias("rows_before"))
    )
    in_part = Window.partitionBy(*part).orderBy("size", F.col("id").asc_nulls_last(), *ties)
    before = in_part.rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("in_part", F.coalesce(F.sum("times").over(before), F.lit(0)))
    placed = ranked.join(counts, same(ranked, counts, *part)).select(
        ranked["*"], (F.col("rows_before") + F.col("in_part")).alias("rank_before")
    )
    if row_column:
        each = placed.withColumn("rank", F.col("rank_before") + 1)
    else:
        many = unfolded(placed.where("times > 1"), "times", "equal")
        one = placed.where("times = 1").withColumn("equal", F.lit(0).cast("long"))
        each = one.unionByName(many).withColumn("rank", F.col("rank_before") + F.col("equal") + 1)
    crossed = lambda rank: F.shiftright(rank * F.col("rate") + F.col("offset"), _UNIT_BITS)
    rank = F.col("rank")
    return each.join(goals, same(each, goals, "source")).select(
        F.col("row").alias(row_column) if row_column else F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        (crossed(rank) - crossed(rank - 1)).alias("copies"),
    )


def mixed(docs: DataFrame, seed: int = 0, id_column: str = "doc_id") -> DataFrame:
    """The documents of the mix: each row as often as its copies say, with its own columns.

    Rows are stored with a key of their own, so identifiers may be null or repeated.
    """
    times, key, of = [unused_name(docs.columns, name) for name in ("copies", "row_key", "copies_of")]
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()), "mix-rows")
    copies = (
        systematic_copies(rows, seed, id_column, row_column=key)
        .where(F.col("copies") > 0)
        .select(F.col(key).alias(of), F.col("copies").alias(times))
    )
    taken = rows.join(copies, rows[key] == copies[of]).select(*[rows[f"`{c}`"] for c in docs.columns], times)
    return taken.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).drop(times)
