import hashlib
import re
from collections import defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from orderlens.llm import exact_dedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check(df, result):
    groups = defaultdict(list)
    for row in df.select("doc_id", "text").collect():
        groups[norm(row.text)].append(row.doc_id)
    rows = result.collect()
    assert len(rows) == sum(map(len, groups.values()))
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(list)
    for row in rows:
        ids = by_text[row.text_sha256]
        assert row.doc_id in ids
        assert row.group_size == len(ids)
        assert row.keep_id == min((i for i in ids if i is not None), default=None)
        if row.kept:
            kept[row.text_sha256].append(row.doc_id)
    assert {t: [min((i for i in ids if i is not None), default=None)] for t, ids in by_text.items()} == kept


@pytest.mark.parametrize("slice_rows", [1, 1000])
def test_edge_cases(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(exact_dedup, "MOST_LISTED", 10_000)
    df = cases.edge_table(spark)
    check(df, exact_dedup.exact_duplicates(df))
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    texts = [norm(r.text) for r in rows]
    assert len(texts) == len(set(texts)) == len({norm(r[1]) for r in cases.edge_rows()})
    assert {r.doc_id for r in rows} == {0, 2, 3, 5, 6, 8, 9, 10, 11, None}


def test_empty(spark):
    assert exact_dedup.exact_duplicates(cases.empty_table(spark)).count() == 0
    assert exact_dedup.keep_first(cases.empty_table(spark)).count() == 0


def test_group_of_a_third_of_all_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", 50)
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 1, "same  text").otherwise(F.concat(F.lit("t "), "id")).alias("text"),
    )
    check(df, exact_dedup.exact_duplicates(df))


def test_texts_of_equal_beginning(spark):
    head = "x" * 500
    df = spark.createDataFrame([(i, head + str(i % 7)) for i in range(50)], "doc_id long, text string")
    check(df, exact_dedup.exact_duplicates(df))


def test_sorts_without_python(spark, capsys):
    exact_dedup.exact_duplicates(cases.edge_table(spark)).explain()
    assert "Python" not in capsys.readouterr().out


def test_rows_with_one_identifier_are_spread_over_slices(spark):
    rows = spark.range(30_000, numPartitions=4).selectExpr("CASE WHEN id % 3 = 0 THEN 7 END AS doc_id", "'same' AS text")
    slices = rows.groupBy(F.pmod(exact_dedup.row_hash("doc_id"), F.lit(30)).alias("slice")).count().collect()
    assert len(slices) == 30 and max(r["count"] for r in slices) < 1300


def test_many_copies_without_identifier(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", 100)
    rows = spark.range(9_000).selectExpr("CASE WHEN id % 3 <> 0 THEN id END AS doc_id", "CASE WHEN id % 9 < 8 THEN 'same' ELSE concat('t', id) END AS text")
    out = exact_dedup.exact_duplicates(rows)
    assert out.where("kept").count() == 1001
    same = out.where("group_size > 1").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in same] == [(1, 8000)]
