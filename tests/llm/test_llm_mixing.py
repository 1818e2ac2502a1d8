import re
from collections import defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from orderlens.llm import mixing


def poured(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by pouring the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        rest = share * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else rest * weight[s] / total for s in order}
        over = {s for s in order if s not in capped and target[s] >= 2 * sizes[s]}
        if not over:
            return target
        capped |= over
        if len(capped) == len(order):
            return {s: 2.0 * sizes[s] for s in order}


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 10, "b": 1000, "c": 50, "d": 5, None: 70},
        {"a": 1, "b": 1, "c": 100000},
        {"only": 7},
        {"a": 0, "b": 0},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(poured(sizes))


def test_words_taken_come_near_targets(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), F.least(F.col("id") % 11, F.lit(5))).alias("source"),
        F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(40)) * (F.col("id") % 13)).cast("int")).alias("text"),
    )
    taken, target, seen = defaultdict(int), {}, set()
    sources = dict(df.select("doc_id", "source").collect())
    for r in mixing.systematic_copies(df, 3).collect():
        assert 0 <= r.copies <= 2
        source = sources[r.doc_id]
        taken[source] += r.copies * r.size
        target[source] = r.target
        seen.add(r.doc_id)
    assert len(seen) == 6000
    for source in target:
        assert taken[source] == pytest.approx(target[source], rel=0.03)


def test_reruns_and_order_of_rows_agree(spark):
    df = cases.edge_table(spark)
    first = sorted(mixing.systematic_copies(df, 1).collect(), key=str)
    again = sorted(mixing.systematic_copies(df.repartition(5, "text"), 1).collect(), key=str)
    assert first == again and len(first) == len(cases.edge_rows())
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert sorted(r.size for r in first) == sorted(len(word.findall(r[1] or "")) for r in cases.edge_rows())


def test_mixed_rows_keep_their_columns(spark):
    df = cases.edge_table(spark).dropDuplicates(["doc_id"])
    copies = {r.doc_id: r.copies for r in mixing.systematic_copies(df, 1).collect()}
    out = mixing.mixed(df, 1)
    assert out.columns == df.columns
    counts = dict(out.groupBy("doc_id").count().collect())
    assert counts == {i: n for i, n in copies.items() if n}


def test_very_many_rows_without_identifier(spark, monkeypatch):
    """They are counted before they are ranked, and dealt by their texts where rows have keys of their own."""
    df = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, null, id) AS doc_id", "concat('w ', id) AS text", "if(id % 3 = 1, 'x', 'y') AS source", "id AS row"
    )
    tables, stored = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda d, n: tables.append(stored(d, n)) or tables[-1])
    rows = mixing.systematic_copies(df, 5).collect()
    assert len(rows) == 30_000 and tables[0].count() == 20_001
    monkeypatch.setattr(mixing, "_BLOCK_ROWS", 500)
    keyed = mixing.systematic_copies(df, 5, row_column="row").collect()
    assert len({r.row for r in keyed}) == 30_000
    for found in (rows, keyed):
        for size in {r.source_size for r in found}:
            of = [r for r in found if r.source_size == size]
            assert abs(sum(r.copies * r.size for r in of) - of[0].target) <= 4


def test_empty(spark):
    assert mixing.systematic_copies(cases.empty_table(spark)).count() == 0
    assert mixing.mixed(cases.empty_table(spark)).count() == 0


def test_parts_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_BLOCK_ROWS", 10)
    df = spark.range(500).selectExpr("id AS doc_id", "'a b c' AS text", "if(id % 3 = 0, 'x', 'y') AS source")
    rows = mixing.systematic_copies(df, 5).collect()
    for size in {r.source_size for r in rows}:
        of = [r for r in rows if r.source_size == size]
        assert abs(sum(r.copies for r in of) * 3 - of[0].target) <= 3


def test_sources_come_near_targets_with_null_and_repeated_identifiers(spark):
    """A third of the rows has no identifier, a third shares one, over all sources; targets hold for each source."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(-1)).alias("doc_id"),
        F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
        F.concat(F.lit("w"), F.col("id"), F.repeat(F.lit(" w"), (F.col("id") % 17).cast("int"))).alias("text"),
        F.col("id").alias("own"),
    )
    words = lambda t: len(t.split())
    sizes, taken, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in df.collect():
        sizes[r.source] += words(r.text)
    for r in mixing.mixed(df, 3).collect():
        taken[r.source] += words(r.text)
        times[r.own] += 1
    assert max(times.values()) <= 2
    for source, target in poured(sizes).items():
        assert taken[source] == pytest.approx(target, rel=0.03), source
