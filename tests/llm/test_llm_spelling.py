"""Spelling variants against brute force, and the bound on affected grams against real edits."""

import random
import re
import zlib
from collections import Counter, defaultdict

import cases
import pytest

from orderlens.llm import spelling
from orderlens.llm.queries import op11_spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def expected(rows):
    """By deletion neighbourhoods in plain Python."""
    counts = Counter()
    lower = str.maketrans(spelling.CAPITALS, spelling.CAPITALS.lower())
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def shorter(word):
        return {word[:i] + word[i + 1 :] for i in range(len(word))}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return b in shorter(a) if len(a) == len(b) + 1 else len(b) == len(a) + 1 and a in shorter(b)

    groups = defaultdict(set)
    for word in words:
        for key in shorter(word) | {word}:
            groups[key].add(word)
    partners = {w: {o for k in shorter(w) | {w} for o in groups[k] if near(w, o)} for w in words}
    forms = {}
    for word, others in partners.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 2 * words[word]:
                forms[word] = best

    def root(word):
        while word in forms:
            word = forms[word]
        return word

    return sorted((w, forms.get(w), root(w), n, len(partners[w]), words.get(forms.get(w))) for w, n in words.items())


def found(df):
    assert df.columns == COLUMNS
    assert [t for _, t in df.dtypes] == ["string", "string", "string", "bigint", "bigint", "bigint"]
    return sorted(map(tuple, df.collect()))


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    result = found(op11_spelling(spark, "/root/testdata/sf0.001"))
    assert len(result) > 1000 and result == expected(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_few_letters_and_many_neighbours_match_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(60):
        words = ["".join(rng.choice("aabÀÿ") for _ in range(rng.randrange(4, 9))) for _ in range(40)]
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(spelling.variants(df)) == expected(rows)


def test_edge_rows(spark):
    rows = [(r[0], r[1]) for r in cases.edge_rows()]
    long = "x" * 50_000
    rows += [(100 + i, f"{long} {long}y THEIR thEir their theiR ther× thier") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "'y' AS id")
    result = found(spelling.variants(df))
    assert result == expected(rows)
    assert (long, None) in {(r[0], r[1]) for r in result}
    assert found(spelling.variants(cases.edge_table(spark))) == expected([(r[0], r[1]) for r in cases.edge_rows()])


def test_empty_table(spark):
    assert spelling.variants(cases.empty_table(spark)).collect() == []


@pytest.mark.parametrize("share", [0, 3, 30])
def test_no_edit_changes_more_grams_than_the_bound(share):
    rng = random.Random(share)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(5, 12))) for _ in range(300)]
    frequencies = Counter()
    for word in words:
        marked = "<<" + word + ">>"
        for k in (2, 3, 4):
            frequencies.update(marked[i : i + k] for i in range(len(marked) - k + 1))
    grams = {g: n for g, n in frequencies.items() if len(g) == 2 or frequencies[g[:-1]] > share}
    for word in words:
        marked = "<<" + word + ">>"
        kept = spelling.decomposed(marked, grams)
        bound = spelling.affected_grams(marked, kept, grams, share)
        assert bound < len(kept)
        for other in words:
            if len(other) > len(word) or other == word:
                continue
            edits = [
                i
                for i in range(len(word))
                if (word[:i] + word[i + 1 :] == other) or (len(word) == len(other) and word[:i] == other[:i] and word[i + 1 :] == other[i + 1 :])
            ]
            if not edits:
                continue
            marked_other = "<<" + other + ">>"
            others = {(p, marked_other[p : p + k]) for p, k in spelling.decomposed(marked_other, grams)}
            shift = len(word) - len(other)
            lost = [(p, k) for p, k in kept if not {(p, marked[p : p + k]), (p - shift, marked[p : p + k])} & others]
            assert len(lost) <= bound


def test_long_chains_of_forms_end_at_one_root(spark):
    # Each step is at least twice as frequent and one character away.
    steps = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg", "lkjihg"]
    text = " ".join(w for i, w in enumerate(steps) for _ in range(4 * 3**i))
    rows = [(1, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    result = found(spelling.variants(df))
    assert result == expected(rows)
    assert {r[2] for r in result if r[0] in steps} == {"lkjihg"}
