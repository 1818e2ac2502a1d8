import collections
import functools
import itertools
import math
import re
import unicodedata

import cases
import pytest
import xxhash
from pyspark.sql import functions as F

from orderlens.llm import queries, site_bayes

LABELS = "doc_id long, quality int, toxic int"


def site_quality(docs, labels):
    return site_bayes.site_quality(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))


def test_held_out_accuracy(spark):
    """Labels of every fifth document are hidden and then compared with."""
    directory = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    hidden = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    rows = site_quality(docs, labels.where(~hidden)).join(labels.where(hidden), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in rows)
    assert len(rows) > 500 and right / len(rows) > 0.98
    good = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in good) / len(good) > 0.98
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in bad) / len(bad) < 0.05


def test_terms_alone_tell(spark):
    """Texts alike in every other measure: what labelled documents hold decides, in documents without a label too."""
    fine, spam = "river stone field cloud maple".split(), "prize bonus click offer cheap".split()
    text = lambda words, i: " ".join(words[(i + k * (1 + i % 3)) % 5] for k in range(30))
    rows = [(i, text(spam if i % 2 else fine, i // 2), "en", "web") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], LABELS)
    out = {r.doc_id: r.kept for r in site_quality(docs, labels).collect()}
    assert all(out[i] == (i % 2 == 0) for i in range(600))


def test_sparse_sites_shrink(spark):
    """Equal texts everywhere: only where a document comes from differs."""
    junk, prose = "### $$$ %%% &&& ***", cases.PROSE
    rows = []
    for host, good, bad in (("clean", 190, 10), ("dirty", 20, 180), ("rare", 0, 2)):
        rows += [(host, prose)] * good + [(host, junk)] * bad
    docs = spark.createDataFrame(
        [(i, t, "en", h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, lang string, source string"
    )
    labels = spark.createDataFrame([(i, int(t == prose), 0) for i, (_, t) in enumerate(rows)], LABELS)
    out = {r.doc_id: r for r in site_quality(docs, labels).collect()}
    prior = lambda host: [out[i].host_prior for i, (h, _) in enumerate(rows) if h == host][0]
    overall = 210 / 402
    assert prior("clean") > 0.9 and prior("dirty") < 0.15
    # The other document of the rare host is junk, but one document says little.
    assert prior("dirty") < prior("rare") < overall
    assert all(out[i].kept == (t == prose) for i, (_, t) in enumerate(rows))


def test_posterior_is_evidence_times_prior(spark):
    rows = queries.op5_site_bayes(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    for r in rows:
        odds = r.evidence + math.log(r.site_prior / (1 - r.site_prior))
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)))
        assert r.kept == (r.score >= 0.5) and 0 <= r.score <= 1


SPACE = r"[\x20\x09-\x0D]+"
MEASURES = 8


def chance(odds):
    return 1 / (1 + math.exp(-odds))


def measured(text):
    words = [w for w in re.split(SPACE, text) if w]
    n = max(len(words), 1)
    share = lambda keep: sum(map(keep, text)) / max(len(text), 1)
    return {
        "words": math.log1p(len(words)),
        "word_length": sum(map(len, words)) / n,
        "repeats": sum(a == b for a, b in zip(words, words[1:])) / n,
        "symbols": share(lambda c: c in "#*$%&|<>!@=_~^"),
        "capitals": share(lambda c: unicodedata.category(c) == "Lu"),
        "digits": share(lambda c: c in "0123456789"),
        "lines": share(lambda c: c == "\n"),
    }


def places(text):
    """Places of the terms, which are cut by the kind of each character."""
    kind = lambda c: "_" if c == "_" else "d" if c.isdecimal() else "l" if c.isalnum() else " " if c.isspace() else "s"
    terms = {"".join(run) for k, run in itertools.groupby(text.lower(), kind) if k != " "}
    return {xxhash.xxh3_64_intdigest(t) % 32768 for t in terms}


def strength(sites):
    """``sites``: (n, mean, prior)."""
    sites = [s for s in sites if s[0] > 1]
    if not sites:
        return 1.0
    total = sum(n for n, _, _ in sites)
    between = sum(n * (m - p) ** 2 for n, m, p in sites)
    variance = (between - sum(p * (1 - p) for _, _, p in sites)) / (total - len(sites))
    within = sum(n * p * (1 - p) for n, _, p in sites) / total
    return min(max(within / variance - 1 if variance > 0 else 1e6, 1.0), 1e6)


def brute(rows, labels):
    """(evidence, host prior, site prior, score) from texts by the same definitions, one document after another."""
    fold = {i: xxhash.xxh64_intdigest(str(i), seed=42) for i in rows}
    fold = {i: (h - (h >> 63 << 64)) % 5 for i, h in fold.items()}
    terms = {i: places(t) for i, (t, _, _) in rows.items()}
    holds, size = collections.Counter(), collections.Counter()
    for i, y in labels.items():
        size[fold[i], y] += 1
        holds.update((fold[i], y, p) for p in terms[i])

    @functools.cache
    def weight(f, place):
        n = [sum(size[g, y] for g in range(5) if g != f) for y in (0, 1)]
        seen = [sum(holds[g, y, place] for g in range(5) if g != f) for y in (0, 1)]
        ratio = [math.log((seen[y] + 2) / (sum(seen) * n[y] / sum(n) + 2)) for y in (0, 1)]
        return ratio[1] - ratio[0]

    widths = site_bayes._WIDTHS
    bins = {}
    for i, (text, _, _) in rows.items():
        told = sum(weight(fold[i], p) for p in terms[i]) / len(terms[i]) if terms[i] else 0.0
        values = {**measured(text), "terms": told + 0.3}
        bins[i] = {m: min(max(math.floor(v / widths[m] + 1e-12), 0), 12) for m, v in values.items()}
        assert len(bins[i]) == len(widths) == MEASURES
    good = sum(labels.values())
    bad = len(labels) - good
    odds = {}
    for m in widths:
        for b in range(13):
            g = sum(y for i, y in labels.items() if bins[i][m] == b)
            a = sum(1 - y for i, y in labels.items() if bins[i][m] == b)
            if g + a:
                odds[m, b] = math.log((g + 1) / (good + 13) * (bad + 13) / (a + 1))
    evidence = {i: sum(odds.get(x, 0.0) for x in b.items()) for i, b in bins.items()}

    alone = {i: chance(e + math.log((good + 1) / (bad + 1))) for i, e in evidence.items()}
    host = {i: h for i, (_, h, _) in rows.items()}
    path = {i: (h, lang) for i, (_, h, lang) in rows.items()}
    of = lambda site: {s: [i for i in rows if site[i] == s] for s in set(site.values())}
    hosts, paths = of(host), of(path)
    mean = lambda ids: sum(alone[i] for i in ids) / len(ids)
    overall = mean(list(rows))
    host_strength = strength([(len(ids), mean(ids), overall) for ids in hosts.values()])
    path_strength = strength([(len(ids), mean(ids), mean(hosts[p[0]])) for p, ids in paths.items()])
    out = {}
    for i in rows:
        rest = lambda ids, prior, k: (sum(alone[j] for j in ids if j != i) + k * prior) / (len(ids) - 1 + k)  # noqa: E731, B023
        host_prior = rest(hosts[host[i]], overall, host_strength)
        site_prior = min(max(rest(paths[path[i]], host_prior, path_strength), 1e-6), 1 - 1e-6)
        out[i] = evidence[i], host_prior, site_prior, chance(evidence[i] + math.log(site_prior / (1 - site_prior)))
    return out


def test_against_brute_force(spark):
    directory = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{directory}/documents.parquet").collect()
    docs = {r.doc_id: (r.text or "", r.source, r.lang) for r in docs}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{directory}/labels.parquet").collect()}
    expected = brute(docs, {i: y for i, y in labels.items() if i in docs})
    rows = queries.op5_site_bayes(spark, directory).collect()
    assert {r.doc_id for r in rows} == set(expected)
    for r in rows:
        got = r.evidence, r.host_prior, r.site_prior, r.score
        assert got == pytest.approx(expected[r.doc_id], rel=1e-9, abs=1e-9)


def test_edge_cases(spark):
    df = cases.edge_table(spark)
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (8, 0, 0), (4, 0, 0), (5, None, 0), (None, 1, 0)], LABELS)
    rows = site_quality(df, labels).collect()
    assert len(rows) == df.count()
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = spark.createDataFrame([], LABELS)
    assert {r.evidence for r in site_quality(df, nothing).collect()} == {0.0}
    assert site_quality(cases.empty_table(spark), labels).count() == 0
