import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    directory = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    langs = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "lang")
    scored = queries.op9_toxicity(spark, directory)
    rows = scored.join(labels, "doc_id").join(langs, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert len(toxic) > 50
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.75
    assert sum(r.predicted for r in clean) / len(clean) < 0.01
    for lang in ("en", "fr", "de"):
        of = [r.predicted for r in toxic if r.lang == lang]
        assert len(of) < 15 or np.mean(of) >= 0.6
    above = np.mean([[a.score > b.score for b in clean[::5]] for a in toxic])
    assert above > 0.93


def test_pairs_say_what_terms_alone_do_not():
    """An insult or a group alone is harmless; both together are toxic, as is neither. Defaults of the query."""
    r = np.random.default_rng(1)
    insult, group, other = 1, 2, np.arange(10, 30)
    rows, labels = [], []
    for _ in range(8000):
        a, b = r.integers(0, 2, 2)
        rows.append(np.array(sorted({insult + 100 * (1 - a), group + 100 * (1 - b), *r.choice(other, 5)})))
        labels.append(float(a == b))
    machine = toxicity.fitted(rows, np.array(labels))
    scores = np.array([machine.score(list(x)) for x in rows])
    assert ((scores >= 0.5) == np.array(labels)).mean() > 0.97
    assert {1, 2, 101, 102} <= set(machine.places)


def test_a_rare_pair_in_long_texts(spark):
    """Both terms together are toxic; each alone, as common in clean texts, is not."""
    r = np.random.default_rng(2)
    texts = []
    for i in range(3000):
        a, b = map(int, r.random(2) < 0.25)
        words = [f"w{x}" for x in r.choice(2000, 100)] + ["fool"] * a + ["tribe"] * b
        r.shuffle(words)
        texts.append((i, " ".join(words), int(a and b)))
    df = spark.createDataFrame(texts, "doc_id long, text string, toxic int").repartition(4)
    scored = toxicity.toxicity(df.drop("toxic"), df.drop("text"), F.col("doc_id") % 5 != 0).collect()
    held_out = [(r.score >= 0.5) == texts[r.doc_id][2] for r in scored if r.doc_id % 5 == 0]
    assert len(held_out) == 600 and np.mean(held_out) > 0.98


def test_gradients_against_every_pair():
    """Slopes by small differences of the loss, with every pair of terms written out."""
    r = np.random.default_rng(3)
    rows = [[0, 2, 3], [1], [], [0, 1, 2, 3, 4], [2, 4]]
    labels, bias, w, v = np.array([1.0, 0, 1, 0, 1]), -0.3, r.normal(size=6), r.normal(size=(6, 3))

    def odds(row, w, v):
        pairs = sum(v[i] @ v[j] for k, i in enumerate(row) for j in row[k + 1 :])
        return bias + sum(w[i] for i in row) + pairs

    def loss(w, v):
        return sum(np.logaddexp(0, -odds(x, w, v) if y else odds(x, w, v)) for x, y in zip(rows, labels))

    terms, local = np.concatenate(rows).astype(int), np.repeat(np.arange(5), [len(x) for x in rows])
    error, by_weight, by_factor = toxicity.gradients(terms, local, labels, bias, w, v)
    assert error == pytest.approx([1 / (1 + np.exp(-odds(x, w, v))) - y for x, y in zip(rows, labels)])
    for at in np.ndindex(6):
        up = np.zeros(6)
        up[at] = 1e-5
        assert by_weight[at] == pytest.approx((loss(w + up, v) - loss(w - up, v)) / 2e-5, abs=1e-7)
    for at in np.ndindex(6, 3):
        up = np.zeros((6, 3))
        up[at] = 1e-5
        assert by_factor[at] == pytest.approx((loss(w, v + up) - loss(w, v - up)) / 2e-5, abs=1e-7)
    machine = toxicity.FactorizationMachine(bias, {i: i for i in range(6)}, w, v)
    assert [machine.score(x) for x in rows] == pytest.approx(list(error + labels))


def test_score_is_bias_weights_and_pairs():
    m = toxicity.FactorizationMachine(0.1, {5: 0, 7: 1, 9: 2}, np.array([1.0, -0.5, 0.2]), np.arange(6.0).reshape(3, 2) / 5)
    pairs = sum(m.factors[i] @ m.factors[j] for i, j in ((0, 1), (0, 2), (1, 2)))
    assert m.score([5, 7, 9, 11]) == pytest.approx(1 / (1 + np.exp(-(0.1 + 0.7 + pairs))))
    assert m.score([]) == pytest.approx(1 / (1 + np.exp(-0.1)))


def test_same_rows_in_other_order_give_the_same_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    first = dict(toxicity.toxicity(docs, labels, F.lit(True)).collect())
    again = dict(toxicity.toxicity(docs.orderBy("text"), labels.orderBy(F.col("doc_id").desc()), F.lit(True)).collect())
    assert first == again


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAINING_ROWS", 7)
    docs = spark.range(50).selectExpr("id AS doc_id", "'some text' AS text")
    labels = spark.range(50).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS INT) AS toxic")
    rows, y = toxicity.training_sample(docs, labels, F.lit(True), "doc_id", "text", "toxic")
    assert len(rows) == len(y) == 7


def test_edge_cases(spark):
    df = cases.edge_table(spark)
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (8, 0, 0), (4, 0, 0), (5, 1, None), (None, 1, 1)], LABELS)
    rows = toxicity.toxicity(df, labels, F.lit(True)).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    one_kind = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], LABELS)
    assert all(r.score < 0.01 for r in toxicity.toxicity(df, one_kind, F.lit(True)).collect())
    none = spark.createDataFrame([], LABELS)
    assert all(r.score == 0.5 for r in toxicity.toxicity(df, none, F.lit(True)).collect())
    assert toxicity.toxicity(cases.empty_table(spark), labels, F.lit(True)).count() == 0


def test_one_row_of_an_identifier_reaches_the_driver(spark, monkeypatch):
    """A hot identifier with many texts: one is collected, the same in every order of rows."""
    texts = [(0, f"text number {i} of many") for i in range(300)] + [(i, "other") for i in range(1, 8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    labels = spark.range(8).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 2 AS INT) AS toxic")
    collected, whole = [], type(docs).toPandas

    def counted(df):
        found = whole(df)
        collected.append(len(found))
        return found

    monkeypatch.setattr(type(docs), "toPandas", counted)
    orders = docs, docs.orderBy("text"), docs.orderBy(F.col("text").desc())
    samples = [toxicity.training_sample(d, labels, F.lit(True), "doc_id", "text", "toxic") for d in orders]
    assert collected == [8, 8, 8]
    assert len({str([list(t) for t in rows]) for rows, _ in samples}) == 1
