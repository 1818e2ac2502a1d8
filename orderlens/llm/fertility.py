"""Quality rules from tokeniser fertility.

A public vocabulary measures each text: characters per token, share of tokens that
fall back to single bytes, entropy of the tokens, and share of tokens that are symbols
and no punctuation of prose. What is ordinary differs
between languages, so each language has its own bands: the median over all its
documents, plus and minus a number of robust spreads. A text outside a band is
rejected; symbols between words, capitals and foreign scripts cut words into more
and other tokens than the language needs.

Texts of few words and of mostly repeated words fail beforehand and do not count
for the bands. A null text is empty and fails so. A null language is a language of
its own. Repeated rows are measured each; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import whole_text
from orderlens.sources.catalog import stored

FEWEST_WORDS = 20
MOST_REPEATED_PERCENT = 30
WINDOW_WORDS = 8

# The bands are sent to every executor unless there are more languages than this.
MOST_LANGUAGES_SENT = 10_000

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_PROSE_MARKS = frozenset(".,;:!?'\"()-’‘“”«»„¿¡–—…")
_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_FERTILITY = "n_tokens long, chars_per_token double, fallback_share double, token_entropy double, symbol_share double"


@dataclass(frozen=True)
class Band:
    """How many spreads below and above the median are ordinary, and the least spread that counts."""

    below: float
    above: float
    least_spread: float


# Characters per token tell most where texts are alike; where they differ in length, so that
# bands are wide, symbols do. The others reject only what is far out.
BANDS: Mapping[str, Band] = {
    "chars_per_token": Band(5.0, 8.0, 0.04),
    "fallback_share": Band(float("inf"), 12.0, 0.005),
    "token_entropy": Band(6.0, float("inf"), 0.04),
    "symbol_share": Band(float("inf"), 8.0, 0.005),
}
# Medians are taken over values rounded to this many places, so that equal ones can be counted.
_PLACES = 3


def _repeated_words(words: list[bytes]) -> int:
    """Words covered by a window that occurs at least twice."""
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
    windows = len(codes) - WINDOW_WORDS + 1
    if windows < 2 or len(numbers) == len(codes):
        return 0
    hashes = np.zeros(windows, np.uint64)
    for k in range(WINDOW_WORDS):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + windows] + np.uint64(1)
    order = np.argsort(hashes, kind="stable")
    first, second = order[:-1], order[1:]
    equal = hashes[first] == hashes[second]
    first, second = first[equal], second[equal]
    if not len(first):
        return 0
    views = np.lib.stride_tricks.sliding_window_view(codes, WINDOW_WORDS)
    if (views[first] == views[second]).all():
        repeated = np.zeros(windows, bool)
        repeated[first] = repeated[second] = True
    else:  # different windows share a hash
        _, inverse, counts = np.unique(views, axis=0, return_inverse=True, return_counts=True)
        repeated = counts[inverse.ravel()] > 1
    steps = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(repeated)
    steps[at] += 1
    steps[at + WINDOW_WORDS] -= 1
    return int((np.cumsum(steps)[:-1] > 0).sum())


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, lines seen before, and words in repeated windows."""
    words = text.encode("utf-8").split()  # splits bytes at ASCII white space, which is _SPACES
    seen: set[str] = set()
    repeated_lines = 0
    for line in text.split("\n"):
        if line in seen:
            repeated_lines += 1
        elif line.strip(_SPACES):
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        repeated_lines,
        _repeated_words(words),
    )


def _is_symbol(piece: str) -> bool:
    """Symbols or marks only, and not all of them marks of prose."""
    marks = piece.replace("\u2581", "")
    return (
        bool(marks)
        and all(unicodedata.category(c)[0] in "SP" for c in marks)
        and not all(c in _PROSE_MARKS for c in marks)
    )


@cache
def _vocabulary(path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray, np.ndarray]:
    """The tokenizer, and which of its pieces are single bytes and symbols; a Python worker loads it once."""
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(pieces.get_piece_size())
    is_byte = np.array([pieces.is_byte(i) for i in every])
    is_symbol = np.array([_is_symbol(pieces.id_to_piece(i)) for i in every]) & ~is_byte
    return pieces, is_byte, is_symbol


def token_measures(text: str, path: str) -> tuple[int, float, float, float, float]:
    """What ``fertility`` gives, and the share of tokens that are symbols."""
    pieces, is_byte, is_symbol = _vocabulary(path)
    ids = np.array(pieces.encode(text, num_threads=1), np.int64)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0, 0.0
    shares = np.bincount(ids)
    shares = shares[shares > 0] / len(ids)
    entropy = -float((shares * np.log2(shares)).sum()) / np.log2(max(len(ids), 2))
    return len(ids), len(text) / len(ids), float(is_byte[ids].mean()), entropy, float(is_symbol[ids].mean())


def fertility(text: str, path: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, share of byte tokens, and entropy relative to its most."""
    return token_measures(text, path)[:4]


def measures(text: Column, path: str) -> Column:
    """Base measures and fertility of each text, as one struct."""

    @F.pandas_udf(f"{_BASE}, {_FERTILITY}")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in f"{_BASE}, {_FERTILITY}".split(", ")]
        for batch in batches:
            rows = [(*base_measures(text), *token_measures(text, path)) for text in batch]
            yield pd.DataFrame(rows, columns=names)

    return measure(whole_text(text))


def base_failed(measured: str = "measured") -> Column:
    m = F.col(measured)
    too_repeated = 100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"]
    return (m["n_words"] < FEWEST_WORDS) | too_repeated


def language_bands(measured: DataFrame, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """Lowest and highest ordinary value of each measure, a row per language.

    ``measured`` has ``lang`` and ``measured``. Equal values are counted first, so a
    language of a third of all documents is no hot key, and medians are exact.
    """
    ordinary = measured.where(~base_failed())
    limits = None
    for name, band in bands.items():
        counted = ordinary.groupBy("lang", F.round(F.col("measured")[name], _PLACES).alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        )
        middle = counted.groupBy("lang").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("middle"))
        distance = F.abs(F.col("value") - F.col("middle"))
        spread = (
            counted.join(middle.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
            .groupBy("lang", "middle")
            .agg((F.percentile(distance, F.lit(0.5), F.col("n")) * 1.4826).alias("spread"))
            .withColumn("spread", F.greatest("spread", F.lit(band.least_spread)))
        )
        limit = spread.select(
            F.col("lang").alias(f"lang_{name}"),
            (F.col("middle") - F.col("spread") * band.below).alias(f"{name}_low"),
            (F.col("middle") + F.col("spread") * band.above).alias(f"{name}_high"),
        )
        if limits is None:
            limits = limit.withColumnRenamed(f"lang_{name}", "band_lang")
        else:
            limits = limits.join(limit, F.col("band_lang").eqNullSafe(F.col(f"lang_{name}"))).drop(f"lang_{name}")
    return limits


def judged(measured: DataFrame, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``. It is read several times, so it must be stored."""
    limits = stored(language_bands(measured, bands), "fertility-bands")
    if limits.count() <= MOST_LANGUAGES_SENT:
        limits = F.broadcast(limits)
    ordinary = F.lit(True)
    for name in bands:
        value = F.round(F.col("measured")[name], _PLACES)
        ordinary = ordinary & value.between(F.col(f"{name}_low"), F.col(f"{name}_high"))
    # A language whose documents all fail has no band.
    kept = ~base_failed() & F.coalesce(ordinary, F.lit(True))
    return (
        measured.join(limits, F.col("lang").eqNullSafe(F.col("band_lang")), "left")
        .withColumns({"base_failed": base_failed(), "kept": kept})
        .drop(*limits.columns)
    )


def quality(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """Measures and verdict for each row."""
    measured = stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(lang_column).alias("lang"),
            measures(F.col(text_column), path).alias("measured"),
        ),
        "fertility",
    )
    return judged(measured).select(F.col("id").alias(id_column), "measured.*", "base_failed", "kept")


def accepted(docs: DataFrame, path: str, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows that are kept, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    measured = stored(
        docs.select(
            row.alias("row"), F.col(lang_column).alias("lang"), measures(F.col(text_column), path).alias("measured")
        ),
        "fertility-rows",
    )
    return judged(measured).where("kept").select("row.*")
