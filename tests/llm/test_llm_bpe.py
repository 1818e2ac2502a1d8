import hashlib
import itertools

import cases
import hypothesis.strategies as st
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings

from orderlens.llm import bpe, queries

RANKS = public_tokenizers.path(queries.RANKS)


@pytest.fixture(scope="module")
def own():
    return bpe.coder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}
    )


PARTS = ["a", "b", "e", "th", "ing", "tion", " ", "  ", "\n", "\t", "é", "ß", "中", "文", "👍", "1", "23", "!", "==", "'s"]


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=60).map("".join)))
def test_same_as_the_library(own, library, text):
    ids = own.encode(text)
    assert ids == library.encode_ordinary(text)
    assert own.count(text) == len(ids)
    assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 50_000, "=" * 50_000, " " * 20_000, "ab" * 30_000, "é" * 20_000])
def test_long_pieces(own, library, text):
    assert own.encode(text) == library.encode_ordinary(text)


def test_memory_of_pieces_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "_PIECES_KEPT", 3)
    monkeypatch.setattr(bpe, "_PAIRS_KEPT", 3)
    small = bpe.BytePairCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    text = "several rather uncommonish wordlets, none repeatable " * 3
    assert small.encode(text) == library.encode_ordinary(text)
    assert len(small._known) <= 3 and len(small._pairs) <= 3


WORDS = [" " + "".join(p) for p in itertools.product(["th", "qu", "é", "x", "ing", "文"], repeat=4)]


def test_counting_merges_short_pieces_together(monkeypatch, library):
    """A new word takes no walk of its own, nor when words were forgotten."""

    def walk(self, piece):
        raise AssertionError(f"{piece} alone")

    monkeypatch.setattr(bpe, "_LENGTHS_KEPT", 100)
    monkeypatch.setattr(bpe, "_BATCH_PIECES", 300)
    small = bpe.BytePairCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe.BytePairCoder, "_backtracked", walk)
    texts = ["".join(WORDS[i::7]) + "\u0000!?" * i for i in range(7)] + ["", "".join(WORDS)]
    assert small.counts(texts) == [len(library.encode_ordinary(t)) for t in texts]


def test_memory_of_lengths_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "_LENGTHS_KEPT", 3)
    monkeypatch.setattr(bpe, "_BATCH_PIECES", 5)
    monkeypatch.setattr(bpe, "_MERGED_BYTES", 100)
    small = bpe.BytePairCoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    # Two texts of many batches, pieces at both sides of the longest ones merged together.
    texts = ["".join(WORDS[:40]), "x" * 63 + " " + "x" * 64 + "é" * 32 + " " + "é" * 33, "=" * 3000, "".join(WORDS[20:60])]
    assert small.counts(texts * 2) == [len(library.encode_ordinary(t)) for t in texts * 2]
    assert len(small._lengths) <= 3 and max(map(len, small._lengths)) <= 64


def test_counting_with_a_vocabulary_of_few_bytes():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 7, b"abab": 9, b"abc": 4, b"cabc": 5}
    own = bpe.BytePairCoder(ranks, r"\S+")
    library = tiktoken.Encoding("x", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    texts = ["".join(t) for n in range(1, 8) for t in itertools.product("abc", repeat=n)]
    assert own.counts(texts) == [len(library.encode_ordinary(t)) for t in texts]
    with pytest.raises(KeyError):
        own.counts(["abd"])


def test_tokens_that_merges_never_make():
    """``abc`` has a rank but no merge leads to it: it can be a whole piece, not a part of one."""
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"d": 3, b"abc": 4}
    own = bpe.BytePairCoder(ranks, r"\S+")
    library = tiktoken.Encoding("x", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcd", "dabc", "abcabc"):
        assert own.encode(text) == library.encode_ordinary(text)


def test_edge_cases(spark, library):
    df = cases.edge_table(spark)
    out = bpe.encoded(df, RANKS, public_tokenizers.PATTERN)
    assert [c for c in out.columns if c not in ("ids", "bytes")] == [c for c in df.columns if c not in ("ids", "bytes")]
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
        assert bytes(r.bytes) == (r.text or "").encode()
    again = bpe.decoded(out, RANKS, public_tokenizers.PATTERN).select("bytes")
    assert sorted(bytes(r[0]) for r in again.collect()) == sorted(bytes(r.bytes) for r in rows)


def test_empty(spark):
    df = cases.empty_table(spark)
    assert bpe.encoded(df, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.token_counts(df, RANKS, public_tokenizers.PATTERN).count() == 0


def test_query(spark, library):
    directory = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op6_byte_bpe(spark, directory).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
