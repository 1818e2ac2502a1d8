"""Rows that break a table's keys or could not be read, set aside with a reason instead of counted only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASON = "reject_reason"
UNREADABLE, NULL_KEY, REPEATED_KEY = "unreadable", "null key", "repeated key"


def orphan_reason(key: str) -> str:
    return f"orphan {key}"


def with_reasons(
    df: DataFrame,
    keys: Sequence[str] = (),
    parents: Mapping[str, DataFrame] | None = None,
    corrupt_column: str | None = None,
) -> DataFrame:
    """The rows of a table, each with the first reason to reject it, or NULL.

    In this order: the row could not be read (``corrupt_column`` of the CSV reader),
    a column of its primary key is NULL, its key occurs more than once (all such rows,
    as nothing tells which is right), a foreign key has no row in its parent. A NULL
    foreign key is no orphan. Every row comes out once, so accepted and rejected add
    up to the input.

    Repeated keys and parents' keys are one row per key before they are joined, and
    the rows come from the left side, so a hot key's partition can be split.
    """
    reasons: list[tuple[Column, str]] = []
    if corrupt_column is not None:
        reasons.append((F.col(corrupt_column).isNotNull(), UNREADABLE))
    out = df
    if keys:
        reasons.append((reduce(Column.__or__, [F.col(k).isNull() for k in keys]), NULL_KEY))
        whole = df if corrupt_column is None else df.where(F.col(corrupt_column).isNull())
        repeated = (
            whole.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))
            .groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)])
            .agg(F.count("*").alias("_rows"))
            .where(F.col("_rows") > 1)
        )
        same = [F.col(k) == F.col(f"_key_{i}") for i, k in enumerate(keys)]
        out = out.join(repeated, reduce(Column.__and__, same), "left")
        reasons.append((F.col("_rows").isNotNull(), REPEATED_KEY))
    for i, (key, parent) in enumerate((parents or {}).items()):
        known = parent.select(F.col(key).alias(f"_parent_{i}")).where(F.col(f"_parent_{i}").isNotNull()).distinct()
        out = out.join(known, F.col(key) == F.col(f"_parent_{i}"), "left")
        reasons.append((F.col(key).isNotNull() & F.col(f"_parent_{i}").isNull(), orphan_reason(key)))
    reason = F.lit(None).cast("string")
    for condition, text in reversed(reasons):
        reason = F.when(condition, text).otherwise(reason)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], reason.alias(REASON))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(REASON).isNull()).drop(REASON)


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(REASON).isNotNull())


def tables_with_reasons(
    tables: Mapping[str, DataFrame],
    primary_keys: Mapping[str, Sequence[str]],
    foreign_keys: Sequence[tuple[str, str, str]],
) -> dict[str, DataFrame]:
    """``with_reasons`` for every table that has a primary or foreign key.

    Parents are taken as they are: a child of a row that is itself rejected is no orphan,
    so the reasons of one table don't depend on another's.
    """
    names = list(dict.fromkeys([*primary_keys, *[child for child, _, _ in foreign_keys]]))
    return {
        name: with_reasons(
            tables[name],
            primary_keys.get(name, ()),
            {key: tables[parent] for child, parent, key in foreign_keys if child == name},
        )
        for name in names
    }


def rejection_summary(with_reason: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table and reason; accepted rows have the reason ``accepted``."""
    legs = [
        rows.groupBy(F.coalesce(REASON, F.lit("accepted")).alias(REASON))
        .agg(F.count("*").alias("row_count"))
        .select(F.lit(name).alias("table_name"), REASON, "row_count")
        for name, rows in with_reason.items()
    ]
    return reduce(DataFrame.unionByName, legs)
