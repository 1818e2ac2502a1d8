import random

import cases
import public_tokenizers
import pytest
import tiktoken

from orderlens.llm import bpe, queries, token_lengths

RANKS = public_tokenizers.path(queries.RANKS)


def check(lengths, rows):
    assert [r.context_limit for r in sorted(rows, key=lambda r: r.context_limit)] == sorted(set(lengths))
    for r in rows:
        limit = r.context_limit
        assert r.n_docs == lengths.count(limit)
        assert r.docs_over == sum(n > limit for n in lengths)
        assert r.docs_within == sum(n <= limit for n in lengths)
        assert r.tokens_within == sum(min(n, limit) for n in lengths)
        assert r.tokens_cut == sum(max(n - limit, 0) for n in lengths)
        assert r.total_tokens == sum(lengths)
        assert r.quantile == r.docs_within / len(lengths)


def table(spark, lengths):
    return spark.createDataFrame([(n,) for n in lengths], "n_tokens long").groupBy("n_tokens").count().withColumnRenamed(
        "count", "n_docs"
    )


@pytest.mark.parametrize("most", [0, 5, 30_000])
def test_sums_against_brute_force(spark, most):
    r = random.Random(most)
    lengths = [r.randint(0, most) for _ in range(300)]
    limits = token_lengths.context_limits(table(spark, lengths)).cache()
    check(lengths, limits.collect())
    for limit in {0, 1, 3, most // 2, most, most + 7}:
        row = token_lengths.at_limit(limits, limit).first()
        assert row.docs_within == sum(n <= limit for n in lengths)
        assert row.tokens_within == sum(min(n, limit) for n in lengths)
    quantiles = token_lengths.length_quantiles(limits, [0.1, 0.5, 1.0]).first()
    for share, name in ((0.1, "p10"), (0.5, "p50"), (1.0, "p100")):
        assert quantiles[name] == min(n for n in lengths if sum(m <= n for m in lengths) / len(lengths) >= share)


def test_query_against_brute_force(spark):
    directory = "/root/testdata/sf0.001"
    library = tiktoken.Encoding(
        "x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )
    texts = spark.read.parquet(f"{directory}/documents.parquet").select("text").collect()
    check([len(library.encode_ordinary(t.text or "")) for t in texts], queries.op7_token_lengths(spark, directory).collect())


def test_edge_cases(spark):
    histogram = token_lengths.length_histogram(cases.edge_table(spark), RANKS, public_tokenizers.PATTERN)
    rows = {r.n_tokens: r.n_docs for r in histogram.collect()}
    assert rows[0] == 2 and sum(rows.values()) == len(cases.edge_rows())
    empty = token_lengths.length_histogram(cases.empty_table(spark), RANKS, public_tokenizers.PATTERN)
    limits = token_lengths.context_limits(empty)
    assert limits.count() == 0 and token_lengths.at_limit(limits, 5).count() == 0
