"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import cases
import numpy as np
import pytest

from orderlens.llm import lexical_search
from orderlens.llm.queries import op13_lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, k=50):
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counts = [(doc_id, c) for doc_id, c in counts if c]
    n_docs, n_all = len(counts), sum(sum(c.values()) for _, c in counts)
    frequency = Counter(t for _, c in counts for t in c)
    rows = []
    for item_id, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1))) for t in set(terms(text)) if frequency[t]}
        scores = []
        for doc_id, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_all
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in weights.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        ranked = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        rows += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(ranked, start=1)]
    return sorted(rows, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("directory", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_matches_scoring_every_document(spark, directory):
    docs = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{directory}/benchmark.parquet").select("item_id", "text").collect()
    result = found(op13_lexical_search(spark, directory))
    assert result == expected(docs, items) and len(result) > 1000


def test_terms_are_those_of_the_pattern():
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(0x250)] + ["日", "👍", " ", " "]
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert [t.decode() for t in lexical_search.terms_of(text)] == terms(text)


@pytest.mark.parametrize("block_documents", [1, 8, 64])
def test_ties_copies_and_few_results_in_blocks_of_any_size(spark, monkeypatch, block_documents):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCUMENTS", block_documents)
    monkeypatch.setattr(lexical_search, "QUERIES_A_BLOCK", 3)
    monkeypatch.setattr(lexical_search, "CHUNK_CELLS", 2000)
    rng = random.Random(block_documents)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(1, 25)))) for i in range(400)]
    docs += [(1000 + i, "w1 w5 w59") for i in range(300)] + [(None, "w1 w5 w59"), (7, "w59"), (7, "w59"), (2**53 + 1, "w58 w57 w56")]
    items = [(i, " ".join(rng.sample(words, rng.randrange(1, 9)))) for i in range(7)] + [(50, "w59 w1"), (51, "unseen"), (52, ""), (53, "w56 w57")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    result = found(lexical_search.ranked(df, spark.createDataFrame(items, "item_id long, text string")))
    assert result == expected(docs, items)


def test_edge_rows_and_empty_tables(spark):
    docs = cases.edge_table(spark)
    items = [(1, cases.PROSE), (2, None), (3, ""), (4, "WORD Word 日本語のテキスト"), (4, "ab lorem0"), (None, "the")]
    df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "'x' AS score")
    rows = [(r[0], r[1]) for r in cases.edge_rows()]
    assert found(lexical_search.ranked(docs, df)) == expected(rows, items)
    assert found(lexical_search.ranked(cases.empty_table(spark), df)) == []
    assert found(lexical_search.ranked(docs, df.limit(0))) == []


def test_lists_are_skipped_only_if_their_bound_fails():
    matrix, most = np.array([[900, 500, 10]]), np.array([1000, 1000, 1000])
    queries = [np.array([0, 1, 2])]

    def sought(floor):
        return sorted(lexical_search.essential_terms(queries, matrix, most, np.array([floor])))

    assert sought(510_000) == [0, 1] and sought(510_001) == [0] and sought(0) == [0, 1, 2]


def test_blocks_are_skipped_only_if_their_summary_fails(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCUMENTS", 2)
    rng = np.random.default_rng(5)
    matrix = np.zeros((6, 30), dtype=np.int64)
    queries = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(6)]
    for i, terms in enumerate(queries):
        matrix[i, terms] = rng.integers(1, 1000, 8)
    impacts = (rng.integers(0, 1000, (40, 30)) * (rng.random((40, 30)) < 0.2)).astype(np.int32)
    scores = impacts.astype(np.int64) @ matrix.T
    skipped = 0
    for share in (0, 50, 90, 99):
        floors = np.percentile(scores, share, axis=0).astype(np.int64)
        wanted = lexical_search.wanted_pairs(impacts, queries, matrix, floors)
        assert wanted[(scores >= floors) & (scores > 0)].all()
        skipped += (~wanted & (scores > 0)).sum()
    assert skipped > 50
