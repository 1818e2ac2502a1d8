"""Exact ranked lexical search with geometric blocks in each term's posting list.

Documents become vectors: for each term that a query has, the term's impact in the
document. Vectors are put in the order of the signs of random projections, so that
similar documents are neighbours, and a task takes them in chunks. In a chunk, the
posting list of a term is cut into blocks of neighbours, and a block's summary is the
largest impact of each term in it. A summary gives an upper bound of every score in its
block, so a block is skipped only if that bound is below what the last place of a query
already reached in the task; the others are scored in full, and the result is exact.

Terms are ordered by weight, heaviest first, and a document is looked for in the list
of its first term of a query. So a bound in a term's list counts that term and later
ones only, and lists of common terms are mostly skipped as a whole, by the bound of a
chunk. Only vectors are shuffled, never postings or summaries.

Queries are worked on in blocks of at most ``QUERIES_A_BLOCK`` queries and, but for one
query that has more alone, ``TERMS_A_BLOCK`` terms; what tasks get of them is bounded by that.

Defined results: null and empty texts have no terms and are never found; a query without
terms finds nothing; equal rows are documents of their own, ordered by identifier (null
last) and then by place in the table; empty tables give no rows. Other columns are not
looked at. Of documents with equal vectors only as many are kept as a query returns, since
later ones can't be among the first.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.sources.catalog import stored

QUERIES_A_BLOCK = 200
TERMS_A_BLOCK = 20_000
# Documents of a block, cells of a chunk's table of documents by terms, and bits of a signature.
BLOCK_DOCUMENTS = 64
CHUNK_CELLS = 5_000_000
SIGNATURE_BITS = 20

# Bytes that end terms become spaces, and A to Z lower case. All other bytes of UTF-8 text belong to terms.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


def ranked(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 50,
    doc_columns: tuple[str, str] = ("doc_id", "text"),
    query_columns: tuple[str, str] = ("item_id", "text"),
) -> DataFrame:
    """The ``k`` best documents of each query: its identifier, ``rank``, the document's identifier, ``score``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_columns[0]).alias("doc_id"), F.col(doc_columns[1]).alias("text"))
    results = []
    for block in _query_blocks(queries.select(*query_columns)):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        if vocabulary:
            names = spark.createDataFrame(
                [(i, query_id) for i, (query_id, _) in enumerate(block)],
                f"query int, {query_columns[0]} {queries.schema[query_columns[0]].dataType.simpleString()}",
            )
            best = _search(docs, [sorted(vocabulary[t] for t in terms) for _, terms in block], vocabulary, k)
            results.append(best.join(names, "query").select(query_columns[0], "rank", F.col("doc_id").alias(doc_columns[0]), "score"))
    if not results:
        kinds = [queries.schema[query_columns[0]].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()]
        return spark.createDataFrame([], f"{query_columns[0]} {kinds[0]}, rank int, {doc_columns[0]} {kinds[1]}, score long")
    out = results[0]
    for result in results[1:]:
        out = out.unionByName(result)
    return out


def _query_blocks(queries: DataFrame) -> Iterator[list[tuple]]:
    block, vocabulary = [], set()
    for query_id, text in queries.toLocalIterator():
        terms = set(terms_of(text))
        if block and (len(block) == QUERIES_A_BLOCK or len(vocabulary | terms) > TERMS_A_BLOCK):
            yield block
            block, vocabulary = [], set()
        block.append((query_id, terms))
        vocabulary |= terms
    if block:
        yield block


def _search(docs: DataFrame, queries: list[list[int]], vocabulary: dict[bytes, int], k: int) -> DataFrame:
    counted = stored(term_counts(docs, vocabulary), "term-counts")
    weighed, size = _weights(counted, len(vocabulary))
    # New numbers, in order of weight.
    order = np.lexsort((np.arange(len(weighed)), -weighed))
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    weights = weighed[order]
    queries = [sorted(int(number[t]) for t in terms) for terms in queries]
    matrix = np.zeros((len(queries), len(weights)), dtype=np.int64)
    for i, terms in enumerate(queries):
        matrix[i, terms] = weights[terms]

    same = Window.partitionBy("terms", "impacts").orderBy(F.asc_nulls_last("doc_id"), "key")
    vectors = impact_vectors(counted, number, weights, *size)
    vectors = vectors.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k).drop("copy")
    vectors = stored(vectors, "vectors")
    neighbours = vectors.repartitionByRange("signature", "key").sortWithinPartitions("signature", "key")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key")
    best = _found(neighbours, queries, matrix, k).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query", "doc_id", "score", "rank")


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with terms: ``key``, ``doc_id``, ``n`` terms, and the numbers and counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch["text"]:
                found = terms_of(text)
                sizes.append(len(found))
                hits = sorted((known[t], c) for t, c in Counter(found).items() if t in known)
                terms.append([t for t, _ in hits])
                counts.append([c for _, c in hits])
            out = pd.DataFrame({"key": batch["key"], "doc_id": batch["doc_id"], "n": sizes, "terms": terms, "counts": counts})
            yield out[out["n"] > 0]

    keyed = docs.withColumn("key", F.monotonically_increasing_id())
    return _mapped(keyed, count, "key long, doc_id string, n long, terms array<int>, counts array<long>")


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` with the identifier as text, since pandas would turn whole numbers next to nulls into floats."""
    kind = df.schema["doc_id"].dataType
    mapped = df.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(function, schema)
    return mapped.withColumn("doc_id", F.col("doc_id").cast(kind))


def _weights(counted: DataFrame, n_terms: int) -> tuple[np.ndarray, tuple[int, int]]:
    """Each term's weight (0 where no document has it), and the number of documents and of all their terms."""
    n_docs, n_all = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = np.zeros(n_terms, dtype=np.int64)
    # A row per term of the block of queries.
    for row in frequency.select("term", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("weight")).collect():
        weights[row["term"]] = row["weight"]
    return weights, (n_docs, n_all or 0)


def impact_vectors(counted: DataFrame, number: np.ndarray, weights: np.ndarray, n_docs: int, n_all: int) -> DataFrame:
    """Documents with a term of the queries: ``terms`` by their new numbers, ascending, ``impacts``, and a ``signature``."""
    signs = np.random.default_rng(0).choice(np.array([-1, 1], dtype=np.int8), size=(len(weights), SIGNATURE_BITS))
    shared = counted.sparkSession.sparkContext.broadcast((number, weights, signs))
    bits = 1 << np.arange(SIGNATURE_BITS - 1, -1, -1)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, weights, signs = shared.value
        for batch in batches:
            rows = []
            for key, doc_id, n, old, counts in batch.itertuples(index=False):
                if len(old) == 0:
                    continue
                terms = number[old]
                ascending = np.argsort(terms)
                terms, counts = terms[ascending], np.asarray(counts, dtype=np.int64)[ascending]
                length = 50 + 50 * int(n) * n_docs // n_all
                impacts = 1_000_000_000 * counts // (1000 * counts + 20 * length)
                projected = (weights[terms] * impacts).astype(np.float64) @ signs[terms]
                rows.append((key, doc_id, terms, impacts, int(bits[projected > 0].sum())))
            yield pd.DataFrame(rows, columns=["key", "doc_id", "terms", "impacts", "signature"])

    return _mapped(counted, convert, "key long, doc_id string, terms array<int>, impacts array<long>, signature int")


def essential_terms(queries: list[np.ndarray], matrix: np.ndarray, most: np.ndarray, floors: np.ndarray) -> dict[int, list[int]]:
    """Terms in whose lists a document that starts there can still reach the floor of a query, with those queries.

    ``most`` has the largest impact of each term.
    """
    of_term: dict[int, list[int]] = {}
    for query, terms in enumerate(queries):
        largest = matrix[query, terms] * most[terms]
        ahead = np.cumsum(largest[::-1])[::-1]
        for term in terms[(ahead >= max(1, floors[query])) & (most[terms] > 0)]:
            of_term.setdefault(int(term), []).append(query)
    return of_term


def wanted_pairs(impacts: np.ndarray, queries: list[np.ndarray], matrix: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Which documents of a chunk to score for which queries: those in blocks whose summary reaches the floor."""
    wanted = np.zeros((len(impacts), len(queries)), dtype=bool)
    for term, having in essential_terms(queries, matrix, impacts.max(axis=0).astype(np.int64), floors).items():
        listed = np.flatnonzero(impacts[:, term])
        coordinates = np.unique(np.concatenate([queries[q] for q in having]))
        coordinates = coordinates[np.searchsorted(coordinates, term) :]
        starts = np.arange(0, len(listed), BLOCK_DOCUMENTS)
        summaries = np.maximum.reduceat(impacts[np.ix_(listed, coordinates)], starts, axis=0).astype(np.int64)
        bounds = matrix[np.ix_(having, coordinates)] @ summaries.T
        for query, live in zip(having, bounds >= np.maximum(1, floors[having])[:, None]):
            wanted[listed[np.repeat(live, BLOCK_DOCUMENTS)[: len(listed)]], query] = True
    return wanted


def _found(vectors: DataFrame, queries: list[list[int]], matrix: np.ndarray, k: int) -> DataFrame:
    """Documents with their scores: of each task at least the ``k`` best of each query, and all that tie with them."""
    shared = vectors.sparkSession.sparkContext.broadcast(([np.array(q, dtype=np.int64) for q in queries], matrix))
    documents_a_chunk = max(1, CHUNK_CELLS // matrix.shape[1])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, matrix = shared.value
        best = [np.zeros(0, dtype=np.int64) for _ in queries]
        floors = np.zeros(len(queries), dtype=np.int64)
        for batch in batches:
            for start in range(0, len(batch), documents_a_chunk):
                chunk = batch.iloc[start : start + documents_a_chunk]
                impacts = np.zeros((len(chunk), matrix.shape[1]), dtype=np.int32)
                for row, (terms, values) in enumerate(zip(chunk["terms"], chunk["impacts"])):
                    impacts[row, terms] = values
                wanted = wanted_pairs(impacts, queries, matrix, floors)
                parts = []
                for query, terms in enumerate(queries):
                    rows = np.flatnonzero(wanted[:, query])
                    scores = impacts[np.ix_(rows, terms)].astype(np.int64) @ matrix[query, terms]
                    reached = scores >= max(1, floors[query])
                    rows, scores = rows[reached], scores[reached]
                    best[query] = np.sort(np.concatenate([best[query], scores]))[-k:]
                    if len(best[query]) == k:
                        floors[query] = best[query][0]
                    keep = scores >= floors[query]
                    found = chunk.iloc[rows[keep]][["key", "doc_id"]]
                    parts.append(found.assign(query=query, score=scores[keep]))
                yield pd.concat(parts)[["query", "key", "doc_id", "score"]]

    columns = vectors.select("key", "doc_id", "terms", "impacts")
    return _mapped(columns, search, "query int, key long, doc_id string, score long")
