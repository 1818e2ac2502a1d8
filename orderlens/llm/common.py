"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that separate words.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/documents.parquet")


def whole_text(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_text(column: str) -> Column:
    """An identifier as text for hashing; null has a text of its own."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def hash_long(*parts: Column) -> Column:
    """A number from 0 below 2**48 that the parts decide, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def unfolded(groups: DataFrame, count: str, number: str, chunk: int = 20_000) -> DataFrame:
    """Each row ``count`` times, with ``number`` from 0. A row of very many is dealt to tasks in chunks."""
    chunked = groups.withColumn(
        number, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / chunk)))
    )
    spread = chunked.repartition(number, *[c for c in groups.columns if c != count])
    last = F.least(F.col(count), (F.col(number) + 1) * chunk) - 1
    return spread.withColumn(number, F.explode(F.sequence(F.col(number) * chunk, last)))


def unused_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores in front while a column already has the name."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted
