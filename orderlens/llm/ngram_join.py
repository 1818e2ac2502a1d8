"""Similarity join on word n-grams: banded MinHash LSH, then exact Jaccard.

Words are lower case, cut at white space and ASCII punctuation. A text is the set of
its runs of five words, or of all its words if it has fewer; texts without words
are similar to nothing. Two texts are linked when the Jaccard index of their sets is
0.8 or more.

Each of several tries holds all texts by a sequence of minhashes, cut at one fixed
prefix: the longest with which the chance that a pair at the threshold shares it in
some trie reaches the target recall. It follows from the settings alone, not from the
data; no trie is descended. Texts below a trie node are candidates of each other:

* Below a small node, texts are compared by their signatures from the longest
  shared prefix to the shortest, and tied together where they may be similar.
* Below a node of many texts all are tied to its smallest, without any comparison.

What is tied together, directly or not, is verified exactly, each text with each
other, in blocks. The blocks count links and tie linked texts, so the number of rows
never grows with the square of a group. No group is cut or sampled.

Copies (texts of the same words) are one text throughout. Rows with null
identifiers have no class of others' making: their class is that of their text.
Extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import unused_name, whole_text
from orderlens.llm.components import connected_components
from orderlens.sources.catalog import stored

_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_ROWS_AT_A_TIME = 2048


@dataclass(frozen=True)
class Forest:
    """Shape of the forest and of the verification."""

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.999
    trees: int = 14
    longest_prefix: int = 6
    small_node: int = 16  # texts below a node that are compared there
    block_texts: int = 512  # texts and n-grams of a block of a large candidate group
    block_ngrams: int = 1 << 20
    seed: int = 1

    @property
    def hashes(self) -> int:
        return self.trees * self.longest_prefix

    @property
    def prefix(self) -> int:
        """The longest prefix whose recall at the threshold reaches the target."""
        for length in range(self.longest_prefix, 1, -1):
            if 1 - (1 - self.threshold**length) ** self.trees >= self.recall:
                return length
        return 1

    @property
    def least_equal(self) -> int:
        """Equal minhashes that a pair at the threshold has, but for five standard deviations."""
        mean = self.hashes * self.threshold
        return math.floor(mean - 5 * math.sqrt(mean * (1 - self.threshold)))

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng(self.seed)
        factors = random.integers(0, 1 << 31, self.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        return factors, random.integers(0, 1 << 32, self.hashes, dtype=np.uint32)


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8").translate(_TO_SPACE).split()


def _ngrams(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words."""
    if not words:
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = len(codes) - n + 1
    mixed = np.full(runs, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ codes[k : k + runs]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _signature(ngrams: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    factors, terms = functions
    low = (ngrams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), _ROWS_AT_A_TIME):
        part = low[start : start + _ROWS_AT_A_TIME, None] * factors + terms
        np.minimum(least, part.min(axis=0), out=least)
    return least


def _text_hash(text: Column) -> Column:
    """128 bits, so that different texts of one identifier, or of none, can be told apart."""
    return F.unhex(F.md5(text.cast("binary")))


def _signed(docs: DataFrame, id_column: str, text_column: str, forest: Forest) -> DataFrame:
    """Per row: digest of the words, number of n-grams, signature (big-endian, as bytes)."""

    @F.pandas_udf("digest binary, ngrams long, signature binary")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        functions = forest.functions()
        for batch in batches:
            rows = []
            for text in batch:
                words = _words(text)
                ngrams = _ngrams(words, forest.n)
                signature = _signature(ngrams, functions).astype(">u4").tobytes() if words else None
                rows.append((xxhash.xxh3_128_digest(b" ".join(words)), len(ngrams), signature))
            yield pd.DataFrame(rows, columns=["digest", "ngrams", "signature"])

    text = whole_text(text_column)
    return docs.select(F.col(id_column).alias("id"), _text_hash(text).alias("text_hash"), sign(text).alias("s")).select(
        "id", "text_hash", "s.*"
    )


def _trie_nodes(texts: DataFrame, forest: Forest) -> DataFrame:
    """(key, node) for each trie node of the final prefix length that a text is below."""
    step = 4 * forest.longest_prefix
    keys = [
        F.xxhash64(F.lit(tree), F.substring("signature", tree * step + 1, 4 * forest.prefix))
        for tree in range(forest.trees)
    ]
    return texts.select("node", F.explode(F.array(*keys)).alias("key"))


def _ties_below_small_nodes(groups: DataFrame, forest: Forest) -> DataFrame:
    """Ties between texts that may be similar. ``groups``: (group, node, signature), sorted by group."""

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            nodes = group.column(1).to_numpy()
            signatures = _signatures(group.column(2), forest)
            root = list(range(len(nodes)))
            equal = signatures[:, None, :] == signatures[None, :, :]
            # Longest prefix in common in any trie; pairs with the longest go first.
            leading = equal.reshape(len(nodes), len(nodes), forest.trees, -1).cumprod(axis=3).sum(axis=3).max(axis=2)
            likeness = equal.sum(axis=2)
            a, b = np.triu_indices(len(nodes), 1)
            ties = []
            for i in np.argsort(-leading[a, b], kind="stable"):
                x, y = root[a[i]], root[b[i]]
                if x != y and likeness[a[i], b[i]] >= forest.least_equal:
                    root = [x if r == y else r for r in root]
                    ties.append((nodes[a[i]], nodes[b[i]]))
            if ties:
                u, v = zip(*ties)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return groups.mapInArrow(tie, "u long, v long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in runs of equal values of the first column, across batches."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for start, end in zip([0, *edges], [*edges, len(keys)]):
            if start == end:
                continue
            if held and keys[start] != value:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            value = keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _signatures(column: pa.ChunkedArray, forest: Forest) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, forest.hashes).astype(np.uint32)


def _candidate_groups(texts: DataFrame, forest: Forest) -> DataFrame:
    """(node, root) of what the tries tie together, roots included."""
    below = _trie_nodes(texts, forest)
    counted = (
        below.groupBy("key")
        .agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("first"))
        .where("texts > 1")
    )
    members = stored(below.join(counted, "key"), "trie-nodes")
    large = members.where((F.col("texts") > forest.small_node) & (F.col("node") != F.col("first"))).select(
        F.col("node").alias("u"), F.col("first").alias("v")
    )
    # The same few texts often meet in several tries; each set is compared once.
    small = (
        members.where(F.col("texts") <= forest.small_node)
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        .select("nodes")
        .distinct()
        .select(F.xxhash64("nodes").alias("group"), F.explode("nodes").alias("node"))
        .join(texts.select("node", "signature"), "node")
        .select("group", "node", "signature")
        .repartition("group")
        .sortWithinPartitions("group")
    )
    tied = connected_components(_ties_below_small_nodes(small, forest).unionByName(large))
    return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct())


def _verified(groups: DataFrame, texts: DataFrame, docs: DataFrame, forest: Forest, columns: tuple[str, str]) -> DataFrame:
    """(node, root, links, linked_rows) per text and block pair of its candidate group.

    ``docs`` is joined by identifier to get the words of each candidate text again.
    """
    id_column, text_column = columns
    grouped = groups.join(texts, "node")
    sizes = grouped.groupBy("root").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / forest.block_texts), F.ceil(F.sum("ngrams") / forest.block_ngrams)
        ).alias("blocks")
    )
    placed = grouped.join(sizes, "root").select(
        "node",
        "root",
        "copies",
        "digest",
        "signature",
        "blocks",
        F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"),
        F.col("first.id").alias("id"),
        F.col("first.text_hash").alias("text_hash"),
    )
    text = whole_text(text_column)
    # Rows that repeat identifier and text are made one before they are joined: combined before the shuffle, which
    # is by the keys of the join, so texts are shuffled once.
    no_id, known = F.col("id").isNull(), F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = (
        docs.select(F.col(id_column).alias("id"), text.alias("text"))
        .groupBy(no_id.alias("no_doc"), known.alias("doc"), _text_hash(F.col("text")).alias("doc_hash"))
        .agg(F.min("text").alias("text"))
    )
    placed = placed.withColumns({"no_id": no_id, "known": known})

    @F.pandas_udf("digest binary, ngrams binary")
    def words_again(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for whole in batch:
                words = _words(whole)
                found.append((xxhash.xxh3_128_digest(b" ".join(words)), _ngrams(words, forest.n).tobytes()))
            yield pd.DataFrame(found, columns=["digest", "ngrams"])

    read = (
        rows.join(
            placed,
            (F.col("no_doc") == F.col("no_id"))
            & (F.col("doc") == F.col("known"))
            & (F.col("doc_hash") == F.col("text_hash")),
        )
        # Marked so that the filter does not run it a second time.
        .withColumn("again", words_again.asNondeterministic()("text"))
        .where(F.col("again.digest") == F.col("digest"))
    )
    other = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))
    pairs = read.withColumn("other", other).select(
        F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")).alias("task"),
        "node",
        "root",
        "copies",
        (F.col("block") != F.col("other")).alias("across"),
        F.when(F.col("blocks") > 1, F.col("block")).alias("block"),
        "signature",
        F.col("again.ngrams").alias("ngrams"),
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            yield _verify(run.take(pa.array(np.argsort(run.column(1).to_numpy()))), forest)

    return pairs.repartition("task").sortWithinPartitions("task").mapInArrow(
        verify, "node long, root long, links long, linked_rows long, whole boolean"
    )


def _verify(run: pa.Table, forest: Forest) -> pa.RecordBatch:
    """Exact links within a block, or between two blocks, sorted by node."""
    nodes, copies = run.column(1).to_numpy(), run.column(3).to_numpy()
    across, blocks = run.column(4)[0].as_py(), run.column(5)
    side = blocks.to_numpy(zero_copy_only=False) if across else None
    whole = blocks[0].as_py() is None
    signatures = _signatures(run.column(6), forest)
    ngrams = [np.frombuffer(x, np.uint64) for x in run.column(7).to_pylist()]
    sizes = np.array([len(x) for x in ngrams])
    root = np.arange(len(nodes))
    links, linked = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    for i in range(len(nodes) - 1):
        rest = slice(i + 1, None)
        likely = (signatures[rest] == signatures[i]).sum(axis=1) >= forest.least_equal
        if across:
            likely &= side[rest] != side[i]
        others = np.flatnonzero(likely) + i + 1
        if not len(others):
            continue
        joined = np.concatenate([ngrams[o] for o in others])
        at = np.minimum(np.searchsorted(ngrams[i], joined), len(ngrams[i]) - 1)
        starts = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        common = np.add.reduceat((ngrams[i][at] == joined).astype(np.int64), starts)
        union = sizes[i] + sizes[others] - common
        found = others[common >= forest.threshold * union - 1e-9]
        links[i] += len(found)
        linked[i] += copies[found].sum()
        links[found] += 1
        linked[found] += copies[i]
        for o in found:
            a, b = sorted((root[i], root[o]))
            if a != b:
                root[root == b] = a
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes), pa.array(nodes[root]), pa.array(links), pa.array(linked), pa.array([whole] * len(nodes))],
        ["node", "root", "links", "linked_rows", "whole"],
    )


def _classes(docs: DataFrame, forest: Forest, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Each row's (id, text_hash, digest, ngrams, ...), and each digest's first row, first row of its class, and links."""
    signed = stored(_signed(docs, id_column, text_column, forest), "signatures")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    texts = stored(
        signed.where("ngrams > 0")
        .groupBy("digest")
        .agg(
            F.min(first).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.first("ngrams").alias("ngrams"),
            F.first("signature").alias("signature"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "texts",
    )
    verified = stored(
        _verified(_candidate_groups(texts, forest), texts, docs, forest, (id_column, text_column)), "verified"
    )
    across = verified.where(~F.col("whole") & (F.col("node") != F.col("root"))).select(
        F.col("node").alias("u"), F.col("root").alias("v")
    )
    joined = connected_components(across).withColumnRenamed("root", "joined")
    linked = (
        verified.groupBy("node")
        .agg(
            F.min("root").alias("root"),
            F.sum("links").alias("n_links"),
            F.sum("linked_rows").alias("linked_rows"),
        )
        .join(joined, "node", "left")
        .select("node", F.coalesce("joined", "root").alias("root"), "n_links", "linked_rows")
        .where("n_links > 0")
    )
    in_class = linked.join(texts.select("node", "first"), "node")
    classes = in_class.groupBy("root").agg(F.min("first").alias("class"))
    described = in_class.join(classes, "root").select("node", "class", "n_links", "linked_rows")
    by_digest = texts.join(described, "node", "left").select(
        "digest",
        "first",
        F.coalesce("class", "first").alias("class"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce("linked_rows", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_linked_docs"),
    )
    return signed, by_digest


def similar_classes(
    docs: DataFrame, forest: Forest = Forest(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """For each row: its class, its copy class, and its links.

    ``class_id`` is the smallest identifier among all rows that links connect;
    ``copy_id`` the smallest among rows of the same words; ``n_links`` the number of
    different texts linked to the row's; ``n_linked_docs`` the number of other rows
    that are copies of the row or of those texts.
    """
    signed, by_digest = _classes(docs, forest, id_column, text_column)
    has_words = F.col("n_links").isNotNull()
    return (
        signed.select("id", F.when(F.col("ngrams") > 0, F.col("digest")).alias("digest"))
        .join(by_digest, "digest", "left")
        .select(
            F.col("id").alias(id_column),
            F.when(has_words, F.col("class.id")).otherwise(F.col("id")).alias("class_id"),
            F.when(has_words, F.col("first.id")).otherwise(F.col("id")).alias("copy_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("n_linked_docs", F.lit(0)).cast("long").alias("n_linked_docs"),
        )
    )


def one_of_each_class(docs: DataFrame, forest: Forest = Forest(), id_column: str = "doc_id") -> DataFrame:
    """The rows whose identifier is the smallest of their class, and those without an identifier.

    It goes by identifiers alone, so they must be unique; else take ``one_row_of_each_class``.
    """
    gone = unused_name(docs.columns, "gone")
    dropped = (
        similar_classes(docs, forest, id_column)
        .where(F.col(id_column).isNotNull() & ~F.col("class_id").eqNullSafe(F.col(id_column)))
        .select(F.col(id_column).alias(gone))
    )
    return docs.join(dropped, docs[id_column] == dropped[gone], "left_anti")


def one_row_of_each_class(
    docs: DataFrame, forest: Forest = Forest(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of each class, whatever its identifier: the smallest identifier's, null last. Rows without words stay.

    Rows are told apart by identifier and text. Of rows equal in both, the one whose
    columns have the smallest hash stays.
    """
    signed, by_digest = _classes(docs, forest, id_column, text_column)
    names = ["key_id", "key_hash", "key_first"]
    key_id, key_hash, key_first = [unused_name(docs.columns, name) for name in names]
    first = F.col("id").eqNullSafe(F.col("class.id")) & (F.col("text_hash") == F.col("class.text_hash"))
    marked = stored(
        signed.where("ngrams > 0")
        .groupBy("id", "text_hash", "digest")
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(by_digest.select("digest", "class"), "digest")
        .where(~first | (F.col("rows") > 1))
        .select(F.col("id").alias(key_id), F.col("text_hash").alias(key_hash), first.alias(key_first)),
        "class-rows",
    )
    same = docs[id_column].eqNullSafe(marked[key_id]) & (_text_hash(whole_text(docs[text_column])) == marked[key_hash])
    left = docs.join(marked, same, "left_anti")
    repeated = marked.where(key_first)
    if repeated.isEmpty():
        return left
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    once = (
        docs.join(repeated, same)
        .select(key_id, key_hash, row.alias("row"))
        .groupBy(key_id, key_hash)
        .agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
        .select("row.*")
    )
    return left.unionByName(once)
