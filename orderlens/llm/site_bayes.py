"""Quality classifier by hierarchical empirical Bayes.

The evidence of a document is a sum of log odds, one per measure of its text, learnt
from labelled documents by counting (a naive Bayes of binned measures). One measure
is what the terms of the text tell: each distinct term, hashed to one of 32,768
places, weighs by how much oftener than expected good documents hold it, and the
measure is the mean weight. Labelled documents are dealt to five folds by identifier;
a document's weights come from the other folds, so it never weighs its own terms and
the bins of that measure are as honest as those of the others. The site a
document comes from says how much to expect before looking at it: the share of good
documents of its host, and of its path below the host. Sites with few documents say
little, so their shares shrink: the path's towards the host's, the host's towards
the global share. How far is itself estimated from how much hosts, and paths within
hosts, differ from each other. A document never counts for its own prior.

All is counted by grouped aggregation, with a combine before each shuffle. A null
text is empty; a null host or path is a site of its own. Repeated rows count each;
labels are joined by identifier, and an identifier with several labels counts as
good if most of them are. A text without terms has the measure 0. An empty table gives an empty result; without labels of
both kinds all evidence is 0 and every document keeps the prior.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SPACES, WORD, id_text, whole_text
from orderlens.sources.catalog import stored

_BINS = 12
_SMOOTHING = 1.0
_PLACES = 1 << 15  # of hashed terms; a place fits two bytes
_FOLDS = 5
_TERM_SMOOTHING = 2.0  # documents for and against that a term starts with
_TERM = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")  # runs of letters, digits or other signs
# A word that comes again right after itself.
_REPEATED = f"(?<![^{SPACES}])([^{SPACES}]++)(?=[{SPACES}]++\\1(?![^{SPACES}]))"
_MOST_STRENGTH = 1e6  # documents that a prior may count as, where sites do not differ at all


def text_measures(text: Column) -> dict[str, Column]:
    """Numbers from 0 that describe a text, by built-in functions."""
    length = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / length
    words = F.regexp_count(text, F.lit(WORD))
    return {
        "words": F.ln(1 + words),
        "word_length": F.length(F.regexp_replace(text, f"[{SPACES}]+", "")) / F.greatest(words, F.lit(1)),
        "repeats": F.regexp_count(text, F.lit(_REPEATED)) / F.greatest(words, F.lit(1)),
        "symbols": share("[#*$%&|<>!@=_~^]"),
        "capitals": share("\\p{Lu}"),
        "digits": share("[0-9]"),
        "lines": share("\n"),
    }


# Width of a bin of each measure; the last bin is open.
_WIDTHS = {
    "words": 0.75, "word_length": 1.5, "symbols": 0.02, "capitals": 0.05, "digits": 0.02, "lines": 0.004,
    "repeats": 0.05, "terms": 0.05,
}
_LEAST = {"terms": -0.3}  # where the bins of a measure begin; 0 else


def _bin(measure: str, value: Column) -> Column:
    place = F.floor((value - _LEAST.get(measure, 0.0)) / _WIDTHS[measure])
    bounded = F.least(F.greatest(place, F.lit(0)), F.lit(_BINS))
    return F.struct(F.lit(measure).alias("measure"), bounded.alias("bin"))


def _term_places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Distinct places of a text's terms, ascending, two bytes each."""
    for texts in batches:
        found = []
        for text in texts:
            terms = set(_TERM.findall(text.lower()))
            places = np.fromiter((xxhash.xxh3_64_intdigest(t) % _PLACES for t in terms), np.uint16, len(terms))
            found.append(np.unique(places).tobytes())
        yield pd.Series(found)


def _measured(docs: DataFrame, id_column: str, text_column: str, host: Column, path: Column) -> DataFrame:
    """Per row: identifier, host, path, fold, bins of the measures of the text, places of its terms."""
    text = whole_text("text")
    bins = [_bin(name, value) for name, value in text_measures(text).items()]
    return docs.select(
        F.col(id_column).alias("id"), host.alias("host"), path.alias("path"), F.col(text_column).alias("text")
    ).select(
        "id",
        "host",
        "path",
        F.pmod(F.xxhash64(id_text("id")), F.lit(_FOLDS)).cast("int").alias("fold"),
        F.array(*bins).alias("bins"),
        F.pandas_udf(_term_places, "binary")(text).alias("terms"),
    )


def _term_weights(labelled: DataFrame) -> np.ndarray:
    """For each fold, the weight of each place of terms by the labelled rows of the other folds.

    A task adds up its rows, so it sends on two numbers per fold and place at most, and
    the driver gets one row per place.
    """

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((_FOLDS, 2, _PLACES), np.int64)
        for batch in batches:
            for fold, terms, good in zip(batch["fold"], batch["terms"], batch["good"]):
                held[fold, good, np.frombuffer(terms, np.uint16)] += 1
        fold, good, place = np.nonzero(held)
        yield pd.DataFrame({"place": place, "slot": 2 * fold + good, "n": held[fold, good, place]})

    slots = range(2 * _FOLDS)
    counted = (
        labelled.select("fold", "terms", "good")
        .mapInPandas(added, "place int, slot int, n long")
        .groupBy("place")
        .agg(*[F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in slots])
        .toPandas()  # _PLACES rows at most
    )
    holds = np.zeros((_FOLDS, 2, _PLACES))
    for k in slots:
        holds[k // 2, k % 2, counted["place"].to_numpy(np.int64)] = counted[f"n{k}"]
    rows = np.zeros((_FOLDS, 2))
    for r in labelled.groupBy("fold", "good").count().collect():
        rows[r.fold, r.good] = r["count"]

    holds, rows = holds.sum(axis=0) - holds, rows.sum(axis=0) - rows  # those of the other folds
    weights = np.zeros((_FOLDS, _PLACES))
    for fold in range(_FOLDS):
        if rows[fold].all():
            expected = holds[fold].sum(axis=0) * (rows[fold] / rows[fold].sum())[:, None]
            against, for_ = np.log((holds[fold] + _TERM_SMOOTHING) / (expected + _TERM_SMOOTHING))
            weights[fold] = for_ - against
    return weights


def _with_terms(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` with the bin of what its terms tell among its bins, and without the terms."""

    @F.pandas_udf("double")
    def mean_weight(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for folds, terms in batches:
            places = [np.frombuffer(t, np.uint16) for t in terms]
            yield pd.Series([float(weights[f][p].mean()) if len(p) else 0.0 for f, p in zip(folds, places)])

    return (
        rows.withColumn("told", mean_weight("fold", "terms"))
        .withColumn("bins", F.array_append("bins", _bin("terms", F.col("told"))))
        .drop("told", "terms", "fold")
    )


def _log_odds(labelled: DataFrame, good: int, bad: int) -> Column:
    """Log odds of each bin of each measure as one map: at most a number per measure and bin."""
    counted = (
        labelled.select("good", F.explode("bins").alias("b"))
        .groupBy("b.measure", "b.bin")
        .agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("all"))
        .collect()  # len(_WIDTHS) * (_BINS + 1) rows at most
    )
    share = lambda n, of: (n + _SMOOTHING) / (of + _SMOOTHING * (_BINS + 1))
    entries = [("", 0.0)]
    if good and bad:
        entries += [
            (f"{r.measure}/{r.bin}", math.log(share(r.good, good) / share(r["all"] - r.good, bad))) for r in counted
        ]
    return F.create_map(*[F.lit(x) for entry in entries for x in entry])


def _strength(sites: DataFrame) -> float:
    """Documents that a prior counts as, by the method of moments over sites.

    ``sites`` has ``n``, ``mean`` and the ``prior`` above. What sites differ beyond
    chance says how much alike they are.
    """
    chance = F.col("prior") * (1 - F.col("prior"))
    seen = (
        sites.where("n > 1")
        .agg(
            F.sum(F.col("n") * (F.col("mean") - F.col("prior")) ** 2).alias("between"),
            F.sum(chance).alias("by_chance"),
            F.sum(F.col("n") * chance).alias("within"),
            F.sum("n").alias("all"),
            F.count(F.lit(1)).alias("sites"),
        )
        .first()
    )
    if not seen.sites:
        return 1.0
    # Of each site, n * (mean - prior)**2 is about chance + (n - 1) * variance of the true shares.
    variance = (seen.between - seen.by_chance) / (seen.all - seen.sites)
    strength = seen.within / seen.all / variance - 1 if variance > 0 else _MOST_STRENGTH
    return min(max(strength, 1.0), _MOST_STRENGTH)


def site_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
) -> DataFrame:
    """For each row: evidence, shrunk prior of its site, posterior ``score`` and ``kept`` (0.5 or more)."""
    measured = stored(_measured(docs, id_column, text_column, host, path), "site-texts")
    votes = labels.groupBy(F.col(id_column).alias("labelled")).agg(F.avg(label_column).alias("vote"))
    voted = F.when(F.col("vote") >= 0.5, 1).otherwise(0).alias("good")
    labelled = stored(
        measured.join(votes.where("vote IS NOT NULL"), F.col("id") == F.col("labelled")).select(
            "fold", "bins", "terms", voted
        ),
        "site-labelled",
    )
    weights = _term_weights(labelled)
    rows, labelled = _with_terms(measured, weights), _with_terms(labelled, weights)
    seen = labelled.agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("all")).first()
    good, bad = seen.good or 0, seen.all - (seen.good or 0)
    share = (good + 1) / (good + bad + 2)

    logit = lambda p: F.ln(p / (1 - p))
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    odds = _log_odds(labelled, good, bad)
    known = lambda b: F.coalesce(F.element_at(odds, F.concat_ws("/", b["measure"], b["bin"])), F.lit(0.0))
    told = stored(
        rows.select("id", "host", "path", F.aggregate("bins", F.lit(0.0), lambda total, b: total + known(b)).alias("evidence"))
        .withColumn("alone", chance(F.col("evidence") + math.log(share / (1 - share)))),
        "site-evidence",
    )

    # The mean over all documents is the centre of the hosts, a host's mean that of its paths.
    paths = stored(
        told.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("alone").alias("good")), "site-paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    hosts_of = hosts.withColumnRenamed("host", "of")
    sites = paths.join(hosts_of, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    overall = paths.agg(F.sum("good") / F.sum("n")).first()[0]
    centre = F.lit(0.5 if overall is None else overall)
    host_mean = F.col("host_good") / F.col("host_n")
    host_strength = _strength(hosts.select(F.col("host_n").alias("n"), host_mean.alias("mean"), centre.alias("prior")))
    path_strength = _strength(
        sites.select("n", (F.col("good") / F.col("n")).alias("mean"), host_mean.alias("prior"))
    )
    site = sites.withColumnsRenamed({"host": "site_host", "path": "site_path"})

    def others(total: str, n: str, prior: Column, strength: float) -> Column:
        """What the rest of the site says, without the document itself, shrunk to ``prior``."""
        rest = F.greatest(F.col(total) - F.col("alone"), F.lit(0.0))
        return (rest + strength * prior) / (F.col(n) - 1 + strength)

    bounded = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = (
        told.join(site, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
        .withColumn("host_prior", others("host_good", "host_n", centre, host_strength))
        .withColumn("site_prior", bounded(others("good", "n", F.col("host_prior"), path_strength)))
        .withColumn("score", chance(F.col("evidence") + logit(F.col("site_prior"))))
    )
    return scored.select(
        F.col("id").alias(id_column),
        "evidence",
        "host_prior",
        "site_prior",
        "score",
        (F.col("score") >= 0.5).alias("kept"),
    )
