"""Percentiles against a brute-force definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from orderlens.operators.percentiles import selected_percentiles, value_counts, weighted_percentile

PROBABILITIES = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


def percentile(values, p):
    values = sorted(values)
    position = p * (len(values) - 1)
    low, high = values[math.floor(position)], values[math.ceil(position)]
    return low + (high - low) * (position - math.floor(position))


def expected(rows):
    groups = {}
    for group, value in rows:
        if value is not None:
            groups.setdefault(group, []).append(value)
    return {g: {n: percentile(v, p) for n, p in PROBABILITIES.items()} for g, v in groups.items()}


def rows_of(kind):
    rng = random.Random(kind)
    if kind == "one value":
        return [("a", 7)] * 1000
    if kind == "skewed":
        rows = [("hot", rng.choice([5, 6, 1 << 33])) for _ in range(3000)]
        return rows + [(g, rng.randrange(-(10**9), 10**9)) for g in "bcd" for _ in range(50)]
    if kind == "null group and values":
        rows = [(None, rng.randrange(1000)) for _ in range(101)]
        return rows + [("a", None), ("a", 3), ("b", None)]
    return [(rng.choice("abc"), rng.randrange(-70000, 70000)) for _ in range(2000)]


@pytest.mark.parametrize("kind", ["one value", "skewed", "null group and values", "wide"])
@pytest.mark.parametrize("bits", [4, 16])
def test_selected_percentiles_are_exact(spark, kind, bits):
    rows = rows_of(kind)
    counts = value_counts(spark.createDataFrame(rows, "g string, v long"), ["g"], "v")
    actual = {
        r["g"]: {n: r[n] for n in PROBABILITIES}
        for r in selected_percentiles(counts, ["g"], "v", PROBABILITIES, bits).collect()
    }
    want = expected(rows)
    assert actual.keys() == want.keys()
    for group, values in want.items():
        assert actual[group] == pytest.approx(values, rel=1e-12)


def test_selected_percentiles_without_groups(spark):
    values = [random.Random(1).randrange(10**7) for _ in range(999)]
    counts = value_counts(spark.createDataFrame([(v,) for v in values], "v long"), [], "v")
    row = selected_percentiles(counts, [], "v", {"median": 0.5}).first()
    assert row["median"] == percentile(values, 0.5)


def test_no_values_give_null(spark):
    counts = value_counts(spark.createDataFrame([], "v long"), [], "v")
    assert selected_percentiles(counts, [], "v", {"median": 0.5}).collect() == [(None,)]


def test_weighted_percentile_equals_brute_force(spark):
    rows = rows_of("wide")
    counts = value_counts(spark.createDataFrame(rows, "g string, v long"), ["g"], "v")
    table = counts.groupBy("g").agg(*[weighted_percentile("v", p).alias(n) for n, p in PROBABILITIES.items()])
    want = expected(rows)
    for row in table.collect():
        assert {n: row[n] for n in PROBABILITIES} == pytest.approx(want[row["g"]])


def test_half_cents_between_two_middle_values(spark):
    counts = value_counts(spark.createDataFrame([(1717,), (1718,)], "v long"), [], "v")
    table = selected_percentiles(counts, [], "v", {"median": 0.5}).select((F.col("median") / 100).alias("m"))
    assert table.first()["m"] == 17.175
