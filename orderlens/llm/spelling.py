"""Spelling variants by an index of variable-length grams.

Words that one inserted, deleted or replaced character tells apart are near. They
are found in an index of grams of two to four characters. Which grams exist depends
on how frequent they are (``gram_frequencies``): a gram is prolonged only while it is
frequent, so no list of words is much longer than the others. Each word is cut into
the longest grams that exist, but those inside another. One edit changes only some of
a word's grams, and ``affected_grams`` bounds how many for that very word. So of any
that many plus one, at least one gram is left unchanged, at the same place from the
beginning or from the end: a word looks up just its rarest ones. What is found is
verified by edit distance.

Defined results: a null text has no words; a null identifier counts as the text
``null``; equal rows count as often as they occur; words of any length are whole; an
empty table gives no rows. Other columns of the documents are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import id_text
from orderlens.sources.catalog import stored

RUN = "([A-Za-z\\u00C0-\\u00FF]+)"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CHANGED_ONE_IN = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3

SHORTEST, LONGEST = 2, 4
# Two marks in front and behind let every word of five characters keep a gram, whatever the edit.
MARKS = ("<<", ">>")
# A gram is frequent above this share of all grams of words, so at most 10,000 of a
# length are, and each has at most 92 successors: the dictionary never exceeds 2 million.
FREQUENT_SHARE = 10_000
# Characters of a word that go with each of its grams.
HEAD = 32
_ROWS_A_BATCH = 50_000


def run_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word`` and ``n``: runs of letters in lower case, one in 97 with a character deleted, how often each occurs.

    Runs too short to give a word are left out before anything is computed of them.
    """
    runs = docs.select(
        id_text(id_column).alias("id"), F.explode(F.regexp_extract_all(F.col(text_column), F.lit(RUN), 1)).alias("run")
    ).where(F.char_length("run") >= LEAST_LENGTH)
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", CAPITALS, CAPITALS.lower())).otherwise(F.col("run"))
    hashed = runs.select("id", lower.alias("run")).select(
        "run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("hash")
    )
    cut = (F.col("hash") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.char_length("run")))
    word = F.when(F.col("hash") % CHANGED_ONE_IN == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The words long and frequent enough to be compared."""
    return run_counts(docs, id_column, text_column).where(
        (F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)
    )


def _marked(word: Column) -> Column:
    return F.concat(F.lit(MARKS[0]), word, F.lit(MARKS[1]))


def gram_frequencies(words: DataFrame) -> tuple[dict[str, int], int]:
    """The grams that exist, with how often they occur in words, and the frequency up to which none is prolonged.

    All grams of two characters, and those longer ones whose beginning, one character
    shorter, is frequent.
    """
    places = F.sequence(F.lit(1), F.char_length("marked") - F.col("length") + 1)
    grams = (
        words.select(_marked(F.col("word")).alias("marked"))
        .withColumn("length", F.explode(F.array(*[F.lit(n) for n in range(SHORTEST, LONGEST + 1)])))
        .select("length", F.explode(F.transform(places, lambda i: F.substring(F.col("marked"), i, F.col("length")))).alias("gram"))
        .groupBy("gram", "length")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    grams = stored(grams, "grams")
    total = grams.where(F.col("length") == SHORTEST).agg(F.sum("frequency")).first()[0] or 0
    limit = total // FREQUENT_SHARE
    frequent = grams.where((F.col("frequency") > limit) & (F.col("length") < LONGEST)).select(F.col("gram").alias("beginning"))
    beginning = F.expr("substring(gram, 1, length - 1)")
    longer = grams.where(F.col("length") > SHORTEST).join(frequent, beginning == F.col("beginning"), "left_semi")
    kept = grams.where(F.col("length") == SHORTEST).unionByName(longer)
    return {row["gram"]: row["frequency"] for row in kept.select("gram", "frequency").toLocalIterator()}, limit


def decomposed(marked: str, grams: dict[str, int]) -> list[tuple[int, int]]:
    """Place and length of a word's grams: at each place the longest that exists, unless inside an earlier one."""
    kept, reached = [], 0
    for place in range(len(marked) - SHORTEST + 1):
        length = LONGEST
        while length > SHORTEST and (place + length > len(marked) or marked[place : place + length] not in grams):
            length -= 1
        if place + length > reached:
            kept.append((place, length))
            reached = place + length
    return kept


def affected_grams(marked: str, kept: list[tuple[int, int]], grams: dict[str, int], limit: int) -> int:
    """The most grams of a word that replacing or deleting one character can change.

    A gram changes if it holds the character; if it ends before it and it, or one that
    starts earlier, may now be prolonged over the character; or if it starts behind and
    a gram over the character may now contain it.
    """
    length_at = dict(kept)

    def prolonged(start: int, edit: int) -> bool:
        known = marked[start:edit]
        return len(known) < SHORTEST or (len(known) < LONGEST and grams.get(known, 0) > limit)

    most = 0
    for edit in range(len(MARKS[0]), len(marked) - len(MARKS[1])):
        changed, reaches = 0, False
        for place in range(max(0, edit - LONGEST + 1), edit + 1):
            reaches = reaches or prolonged(place, edit)
            length = length_at.get(place)
            if length and (place + length > edit or reaches):
                changed += 1
        for place in range(edit + 1, edit + LONGEST - SHORTEST + 1):
            length = length_at.get(place)
            if length and place + length <= edit + LONGEST:
                changed += 1
        most = max(most, changed)
    return most


def gram_index(words: DataFrame) -> DataFrame:
    """A row per word and gram: ``gram``, its ``place``, ``length`` and ``id`` of the word, its ``head``, whether to look it up.

    A row holds the first characters of the word only, as a long word has many rows.
    """
    grams, limit = gram_frequencies(words)
    shared = words.sparkSession.sparkContext.broadcast((grams, limit))
    columns = ["gram", "place", "length", "id", "head", "sought"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, limit = shared.value
        rows: list[tuple] = []
        for batch in batches:
            for key, word in zip(batch["id"], batch["word"]):
                marked = MARKS[0] + word + MARKS[1]
                kept = decomposed(marked, grams)
                wanted = affected_grams(marked, kept, grams, limit) + 1
                found = sorted((grams.get(marked[p : p + k], 0), p, k) for p, k in kept)
                for i, (_, p, k) in enumerate(found):
                    rows.append((marked[p : p + k], p, len(word), key, word[:HEAD], i < wanted))
                    if len(rows) == _ROWS_A_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return words.select("id", "word").mapInPandas(
        cut, "gram string, place int, length int, id long, head string, sought boolean"
    )


def near_words(words: DataFrame) -> DataFrame:
    """Each pair of near words once: ``longer``, ``n_longer``, ``other``, ``n_other``.

    ``words`` has an ``id``, the ``word`` and ``n``. The longer word of a pair (of equals
    the one with the larger id) looks the other one up, in the lists of grams of that
    length: left of the edit at the same place, right of a deletion one place further
    left. Words whose beginnings are too different are left out at once; the whole
    words decide.
    """
    index = stored(gram_index(words), "gram-index")
    same = F.struct(F.col("place"), F.col("length"))
    left = F.struct(F.col("place"), (F.col("length") - 1).alias("length"))
    right = F.struct((F.col("place") - 1).alias("place"), (F.col("length") - 1).alias("length"))
    sought = index.where("sought").select(
        "gram", F.col("id").alias("a"), F.col("head").alias("head_a"), F.col("length").alias("length_a"), F.inline(F.array(same, left, right))
    )
    lists = index.select("gram", "place", "length", F.col("id").alias("b"), F.col("head").alias("head_b"))
    # One edit changes a beginning of fixed length by at most two.
    alike = F.when(F.col("length_a") <= HEAD, F.levenshtein("head_a", "head_b", 1) == 1).otherwise(
        F.levenshtein("head_a", "head_b", 2) >= 0
    )
    pairs = (
        sought.join(lists, ["gram", "place", "length"])
        .where(((F.col("length_a") > F.col("length")) | (F.col("a") > F.col("b"))) & alike)
        .select("a", "b")
        .distinct()
    )
    longer = words.select(F.col("id").alias("a"), F.col("word").alias("longer"), F.col("n").alias("n_longer"))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("other"), F.col("n").alias("n_other"))
    return (
        pairs.join(longer, "a")
        .join(other, "b")
        .where(F.levenshtein("longer", "other", 1) == 1)
        .select("longer", "n_longer", "other", "n_other")
    )


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per word: ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    A form occurs at least twice as often as the word, so following forms ends after
    at most 62 steps; following them from both ends doubles the steps of each round.
    """
    counted = vocabulary(docs, id_column, text_column).withColumn("id", F.monotonically_increasing_id())
    words = stored(counted, "words")
    pairs = stored(near_words(words), "near-words")
    both = pairs.select(F.col("longer").alias("word"), F.col("other").alias("near"), F.col("n_other").alias("n")).unionByName(
        pairs.select(F.col("other").alias("word"), F.col("longer").alias("near"), F.col("n_longer").alias("n"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("near"))).alias("best")
    )
    is_form = -F.col("best.minus") >= 2 * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word",
        F.when(is_form, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, -F.col("best.minus")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    roots = _roots(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(steps: DataFrame) -> DataFrame:
    """Where following ``root`` from each ``word`` ends. The steps never run in a circle."""
    current = stored(steps, "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        joined = current.join(ahead, "root", "left")
        if joined.where("ahead IS NOT NULL").isEmpty():
            return current
        current = stored(joined.select("word", F.coalesce("ahead", "root").alias("root")), "roots")
