"""Each stage against a plain version on its own input, and the whole run against the stages."""

import re
from collections import Counter, defaultdict

import cases
import public_tokenizers
import pytest
import tiktoken
from test_llm_fertility import brute_kept
from test_llm_ngram_join import brute as brute_classes

import corpus_pipeline
from orderlens.llm import bpe, fertility, mixing, queries
from orderlens.llm.common import documents
from orderlens.sources.catalog import stored

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """Name of each stage to its input and output, as the check tool runs them."""
    docs, found = documents(spark, DIRECTORY), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, DIRECTORY), "stage")
        found[name] = docs, out
        docs = out
    return found


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay_until_the_last_stage(spark, inputs):
    names = documents(spark, DIRECTORY).columns
    outs = [out for _, out in inputs.values()]
    assert len(outs) == 5 and all(out.columns == names for out in outs[:-1])


def test_quality_rules(spark, inputs):
    docs, out = inputs["quality rules"]
    measured = fertility.quality(docs, public_tokenizers.path(queries.PIECES))
    kept = brute_kept(measured.join(docs.select("doc_id", "lang"), "doc_id").collect())
    assert sorted(rows(out)) == sorted(i for i, k in kept.items() if k)
    assert 0 < len(rows(out)) < docs.count()
    # Labelled as good, of enough words and not repetitive: all stay.
    good = {r.doc_id for r in spark.read.parquet(f"{DIRECTORY}/labels.parquet").where("quality = 1").collect()}
    clean = {r.doc_id for r in measured.where("NOT base_failed").collect()} & good
    assert len(clean) > 50 and clean <= set(rows(out))


def test_exact_dedup(inputs):
    docs, out = inputs["exact dedup"]
    first = {}
    for i, row in sorted(rows(docs).items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", row.text), row)
    assert rows(out) == {r.doc_id: r for r in first.values()}


def test_near_dedup(inputs):
    docs, out = inputs["n-gram Jaccard join"]
    classes = brute_classes({i: r.text for i, r in rows(docs).items()})
    assert sorted(rows(out)) == sorted({c for c, _ in classes.values()})


def test_mixing(inputs):
    docs, out = inputs["mixing sources to target weights"]
    copies = {r.doc_id: r.copies for r in mixing.systematic_copies(docs, queries.SEED).collect()}
    counts = Counter(r.doc_id for r in out.collect())
    assert counts == {i: n for i, n in copies.items() if n}
    words, taken, total = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)), defaultdict(int), 0
    for r in out.collect():
        taken[r.source] += words(r.text)
    total = sum(words(r.text) for r in docs.collect())
    assert sum(taken.values()) == pytest.approx(1.5 * total, rel=0.1)


def test_encoding(inputs):
    docs, out = inputs["byte-level BPE encoding and decoding"]
    library = tiktoken.Encoding(
        "x",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe.read_ranks(public_tokenizers.path(queries.RANKS)),
        special_tokens={},
    )
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = out.collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


def test_run_applies_the_stages(spark, inputs):
    *_, (_, last) = inputs.values()
    assert sorted(map(str, corpus_pipeline.run(spark, DIRECTORY).collect())) == sorted(map(str, last.collect()))


@pytest.mark.parametrize("table", [cases.edge_table, cases.empty_table])
def test_edge_cases_go_through(spark, table):
    docs = table(spark)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIRECTORY), "edge")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    assert all(r.round_trip for r in docs.collect())
