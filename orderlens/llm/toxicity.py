"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text, lower case, and the beginnings of longer
words, hashed to a fixed number of places. The score of a text is the chance that
follows from a bias, a weight per term, and for each pair of terms the product of
their factors, so a pair can say what neither term says alone.

The machine is fitted on a sample of labelled rows of bounded number, those of the
smallest hashes of their identifier, so every run takes the same. Every term of enough
rows has factors, whatever its weight, so two terms that say nothing alone can say
something together. Weights and factors shrink to exactly zero unless the rows keep
speaking for them: the model stays small, and common words, however many a text has,
add nothing. Scoring covers every row and whole texts.

A null text is empty and gets the bias alone. Rows without identifier are scored and
never learnt from; of several texts of an identifier, the one of the smallest hash is
learnt from. Null labels are left out; an identifier with several labels is
toxic if one of them is. With labels of one kind only, every score is their share. An
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import whole_text

# The fit uses this many labelled rows at most; scoring is not limited.
TRAINING_ROWS = 10_000

_TERM_BITS = 20
_STEM_BYTES = 4
_OTHER = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_OTHER, b" " * len(_OTHER))


def hashed_terms(text: str) -> list[int]:
    """Distinct places of the words and word beginnings of a text."""
    words = set(text.lower().encode("utf-8").translate(_TO_SPACE).split())
    stems = {b"^" + word[:_STEM_BYTES] for word in words if len(word) > _STEM_BYTES}
    mask = (1 << _TERM_BITS) - 1
    return sorted({zlib.crc32(term) & mask for term in words | stems})


@dataclass(frozen=True)
class FactorizationMachine:
    """Bias, and for each term with a weight or factors its row in ``weights`` and ``factors``."""

    bias: float
    places: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def score(self, terms: list[int]) -> float:
        rows = [row for row in map(self.places.get, terms) if row is not None]
        odds = self.bias
        if rows:
            v = self.factors[rows]
            odds += self.weights[rows].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def gradients(
    terms: np.ndarray, row: np.ndarray, labels: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error of each row of a batch, and the slopes of its loss by weights and by factors.

    ``row`` says to which row of the batch each of ``terms`` belongs.
    """
    size, (n, factors) = len(labels), v.shape
    own = v[terms]
    sums = np.stack([np.bincount(row, own[:, k], size) for k in range(factors)], axis=1)
    pairs = 0.5 * ((sums**2).sum(axis=1) - np.bincount(row, (own**2).sum(axis=1), size))
    odds = bias + np.bincount(row, w[terms], size) + pairs
    error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels
    slope = error[row, None] * (sums[row] - own)
    by_factors = np.stack([np.bincount(terms, slope[:, k], n) for k in range(factors)], axis=1)
    return error, np.bincount(terms, error[row], n), by_factors


def fitted(
    rows: list[np.ndarray],
    labels: np.ndarray,
    factors: int = 4,
    epochs: int = 20,
    batch: int = 256,
    rate: float = 1.0,
    factor_rate: float = 0.05,
    sparsity: float | None = None,
    shrinkage: float = 1.5,
    decay: float = 1e-3,
    least_rows: int = 5,
    seed: int = 0,
) -> FactorizationMachine:
    """Fits by proximal stochastic gradient steps with a rate per term.

    ``sparsity`` is the evidence, in summed gradients, that a term needs for a weight; by
    default it follows the noise of such sums. ``shrinkage`` is how much shorter the
    factors of a term get in an epoch, in lengths that they start with: those to which no
    pair speaks end at zero. Terms of fewer than ``least_rows`` rows have neither.
    """
    share = float(labels.mean()) if len(labels) else 0.5
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if sparsity is None:
        sparsity = 0.6 * len(labels) ** 0.5
    empty = FactorizationMachine(bias, {}, np.zeros(0), np.zeros((0, factors)))
    if share in (0.0, 1.0) or not len(labels):
        return empty
    every = np.concatenate(rows)
    seen = np.bincount(every)
    places = np.flatnonzero(seen >= least_rows)
    if not len(places):
        return empty
    number = np.full(len(seen), -1, np.int32)
    number[places] = np.arange(len(places))
    flat = number[every]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])[flat >= 0]
    flat = flat[flat >= 0]
    starts = np.searchsorted(owner, np.arange(len(rows) + 1))
    random = np.random.default_rng(seed)
    n = len(places)
    w, summed, squares = np.zeros(n), np.zeros(n), np.full(n, 1e-8)
    # Pairs of a whole row start with little to say, however many terms it has.
    spread = 0.3 / (len(flat) / len(rows)) ** 0.5
    v, v_squares = random.normal(0, spread, (n, factors)), np.ones((n, factors))
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = np.sort(order[at : at + batch])
            lengths = starts[chosen + 1] - starts[chosen]
            local = np.repeat(np.arange(len(chosen)), lengths)
            span = np.arange(len(local)) + (starts[chosen] - np.cumsum(lengths) + lengths)[local]
            error, step, slope = gradients(flat[span], local, labels[chosen], bias, w, v)
            bias -= rate * error.mean()
            # Weights: gradients are summed, and what stays below the sparsity is zero.
            now = np.sqrt(squares + step**2)
            summed += step - (now - np.sqrt(squares)) / rate * w
            squares += step**2
            w = np.where(
                np.abs(summed) > sparsity, (np.sign(summed) * sparsity - summed) / ((1 + now) / rate + decay), 0.0
            )
            # Factors: a step, then all of a term get shorter together, down to zero.
            v_squares += slope**2
            v -= factor_rate * slope / np.sqrt(v_squares)
            shorter = shrinkage * spread * len(chosen) / len(rows)
            length = np.sqrt((v**2).sum(axis=1))
            v *= np.maximum(0, 1 - shorter / np.maximum(length, 1e-12))[:, None]
    say = np.flatnonzero((w != 0) | v.any(axis=1))
    return FactorizationMachine(bias, {int(places[i]): k for k, i in enumerate(say)}, w[say], v[say])


def training_sample(
    docs: DataFrame, labels: DataFrame, learn: Column, id_column: str, text_column: str, label_column: str
) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of at most ``TRAINING_ROWS`` rows for which ``learn`` holds.

    A row has at most 2**20 terms of four bytes, so 4 MB; ordinary texts have a few hundred.
    """
    chosen = (
        labels.where(learn & F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
        .groupBy(F.col(id_column).alias("chosen"))
        .agg(F.max(F.col(label_column).cast("int")).alias("label"))
        .orderBy(F.xxhash64("chosen"), "chosen")
        .limit(TRAINING_ROWS)
    )

    @F.pandas_udf("array<int>")
    def terms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(hashed_terms)

    texts = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    found = (
        texts.join(F.broadcast(chosen), F.col("id") == F.col("chosen"))  # TRAINING_ROWS at most
        .groupBy("id", "label")
        .agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
        .select("id", "label", terms("text").alias("terms"))
        .toPandas()
        .sort_values("id")
    )
    return [np.array(t, np.int32) for t in found["terms"]], found["label"].to_numpy(float)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> DataFrame:
    """``score`` of each row, next to its identifier. ``learn`` says which labels may be learnt from."""
    machine = fitted(*training_sample(docs, labels, learn, id_column, text_column, label_column))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: machine.score(hashed_terms(text)))

    return docs.select(F.col(id_column), score(whole_text(text_column)).alias("score"))
