"""Byte-level BPE encoding and decoding by longest matches and backtracking.

The bytes of a piece are mapped to Latin-1, so that an Aho-Corasick automaton over
the vocabulary finds at each position the longest token in one pass. Encoding takes
the longest token, checks that it may stand next to the token before it, and falls
back to shorter tokens or to an earlier position where it may not. Two tokens may
stand next to each other exactly when merging their joined bytes gives these two
tokens; the answers are remembered. The result is that of the merges, while each
position is left for good at most once, so time is linear in the text.

Where only the number of tokens is asked for, the new short pieces of many texts are
merged together: they are rows of byte arrays, and each round does the next merge of
every row.

A null text is empty and has no tokens. Any text is allowed; strings of special
tokens are ordinary text. Rows keep their identifiers, repeated ones too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache, cached_property
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.llm.common import whole_text

# Bounds of what a Python worker remembers.
_PIECES_KEPT = 200_000
_PAIRS_KEPT = 400_000
_LONGEST_PIECE_KEPT = 64
_LENGTHS_KEPT = 500_000
# Counting learns the new ones among this many pieces at a time.
_BATCH_PIECES = 200_000
# Pieces of up to so many bytes are merged together, with others whose length is less than a step away and
# whose bytes are not more than these in all.
_LONGEST_MERGED_TOGETHER = 64
_ROW_STEP = 8
_MERGED_BYTES = 500_000
# An output batch ends at this many tokens.
_BATCH_TOKENS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a rank file: base64 and number on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class BytePairCoder:
    """Encodes and decodes text by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._ranks = ranks
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._pieces = regex.compile(pattern).findall
        self._known: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self._lengths: dict[str, int] = {}
        self._automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            # A token that merging never makes of its own bytes can only be a whole piece.
            if len(token) == 1 or self._merged(token) == (rank,):
                self._automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self._automaton.make_automaton()

    def _merged(self, data: bytes) -> tuple[int, ...]:
        """Merging as defined: again and again the adjacent pair of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self._ranks
        while len(parts) > 1:
            best, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == len(ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens next to each other."""
        pair = (left, right)
        answer = self._pairs.get(pair)
        if answer is None:
            if len(self._pairs) >= _PAIRS_KEPT:
                self._pairs.clear()
            answer = self._pairs[pair] = self._merged(self._bytes[left] + self._bytes[right]) == pair
        return answer

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of the token, -1 if there is none."""
        answer = self._shorter.get(token)
        if answer is None:
            data = self._bytes[token].decode("latin-1")
            lengths = [n for n in range(1, len(data)) if data[:n] in self._automaton]
            answer = self._shorter[token] = self._automaton.get(data[: lengths[-1]])[1] if lengths else -1
        return answer

    def _backtracked(self, piece: bytes) -> tuple[int, ...]:
        longest = [-1] * len(piece)
        for end, (length, token) in self._automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = token  # later matches from a position are longer
        size, fit = self._bytes, self._fit
        dead = set()  # positions from which the rest can't be encoded after what leads there
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token >= 0:
                end = at + len(size[token])
                if end not in dead and (not tokens or fit(tokens[-1], token)):
                    break
                token = self._next_shorter(token)
            if token >= 0:
                tokens.append(token)
                at = end
                token = longest[at] if at < len(piece) else -1
            else:
                dead.add(at)
                token = tokens.pop()
                at -= len(size[token])
                token = self._next_shorter(token)
        return tuple(tokens)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self._ranks.get(data)
        tokens = (whole,) if whole is not None else self._backtracked(data)
        if len(piece) <= _LONGEST_PIECE_KEPT:
            if len(self._known) >= _PIECES_KEPT:
                self._known.clear()
            self._known[piece] = tokens
        return tokens

    def encode(self, text: str) -> list[int]:
        known, ids = self._known.get, []
        extend = ids.extend
        for piece in self._pieces(text):
            extend(known(piece) or self._piece(piece))
        return ids

    @cached_property
    def _merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The rank of each byte, keys of the pairs that merge, sorted, their ranks, and a rank for none."""
        ranks = self._ranks
        none = max(ranks.values(), default=-1) + 1
        pairs = {
            ranks[token[:n]] * (none + 1) + ranks[token[n:]]: rank
            for token, rank in ranks.items()
            for n in range(1, len(token))
            if token[:n] in ranks and token[n:] in ranks
        }
        pairs[(none + 1) ** 2] = none  # above every key
        keys = np.array(sorted(pairs), np.int64)
        singles = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        return singles, keys, np.array([pairs[k] for k in keys.tolist()], np.int64), none

    def _merged_lengths(self, pieces: list[bytes]) -> np.ndarray:
        """How many tokens merging leaves of each piece: each round merges every row's first pair of lowest rank."""
        singles, keys, key_ranks, none = self._merges

        def pair_ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            pairs = left * (none + 1) + right
            at = np.searchsorted(keys, pairs)
            return np.where(keys[at] == pairs, key_ranks[at], none)

        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        data = np.array(pieces, f"S{width}").view(np.uint8).reshape(len(pieces), width)
        # A part that merges with none stands at both ends.
        parts = np.full((len(pieces), width + 2), none)
        parts[:, 1:-1] = np.where(np.arange(width) < lengths[:, None], singles[data], none)
        if parts.min() < 0:
            raise KeyError("a byte of the text has no rank")
        ranks = pair_ranks(parts[:, :-1], parts[:, 1:])
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            going = best < none
            rows, at, best, parts, ranks = rows[going], at[going], best[going], parts[going], ranks[going]
            each = np.arange(len(rows))
            lengths[rows] -= 1
            parts[each, at] = best
            stay = np.ones(parts.shape, bool)
            stay[each, at + 1] = False
            parts = parts[stay].reshape(len(rows), parts.shape[1] - 1)
            ranks = ranks[stay[:, 1:]].reshape(len(rows), ranks.shape[1] - 1)
            ranks[each, at - 1] = pair_ranks(parts[each, at - 1], best)
            ranks[each, at] = pair_ranks(best, parts[each, at + 1])
        return lengths

    def _learn_lengths(self, pieces: Iterable[str]) -> list[str]:
        """Remembers the number of tokens of each piece; returns those too long to be kept."""
        lengths, long = self._lengths, []
        alike: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8")
            if data in self._ranks:
                lengths[piece] = 1
            elif len(data) <= _LONGEST_MERGED_TOGETHER:
                alike.setdefault(len(data) // _ROW_STEP, []).append((piece, data))
            else:
                lengths[piece] = len(self._backtracked(data))
            if len(piece) > _LONGEST_PIECE_KEPT:
                long.append(piece)
        for most, group in alike.items():
            step = _MERGED_BYTES // ((most + 1) * _ROW_STEP)
            for start in range(0, len(group), step):
                names, rows = zip(*group[start : start + step])
                lengths.update(zip(names, self._merged_lengths(rows).tolist()))
        return long

    def _add_lengths(self, counts: list[int], waiting: list[tuple[int, list[str]]]) -> None:
        lengths = self._lengths
        new = set().union(*[pieces for _, pieces in waiting]).difference(lengths)
        long = self._learn_lengths(new)
        for row, pieces in waiting:
            counts[row] += sum(map(lengths.__getitem__, pieces))
        for piece in long:
            del lengths[piece]
        # The oldest are forgotten; what is frequent is soon learnt again.
        for piece in list(islice(lengths, max(len(lengths) - _LENGTHS_KEPT, 0))):
            del lengths[piece]

    def counts(self, texts: Iterable[str]) -> list[int]:
        """How many tokens each text has."""
        counts, waiting, total = [], [], 0
        for row, text in enumerate(texts):
            counts.append(0)
            pieces = self._pieces(text)
            for start in range(0, len(pieces), _BATCH_PIECES):
                waiting.append((row, pieces[start : start + _BATCH_PIECES]))
                total += len(waiting[-1][1])
                if total >= _BATCH_PIECES:
                    self._add_lengths(counts, waiting)
                    waiting, total = [], 0
        self._add_lengths(counts, waiting)
        return counts

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


@cache
def coder(path: str, pattern: str) -> BytePairCoder:
    """The coder of a rank file; a Python worker builds it once."""
    return BytePairCoder(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """The rows with their own columns, ``ids`` of the text, and the ``bytes`` that these decode to.

    Columns of these two names are replaced.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "bytes")])
    names = [*rows.columns, "ids", "bytes"]
    at = [c.lower() for c in names].index(text_column.lower())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(path, pattern)
        for batch in batches:
            texts = batch.column(at)
            start, ids, total = 0, [], 0
            for row in range(batch.num_rows):
                ids.append(np.array(table.encode(texts[row].as_py() or ""), np.int32))
                total += len(ids[-1])
                if total >= _BATCH_TOKENS or row + 1 == batch.num_rows:
                    columns = [*batch.slice(start, len(ids)).columns, pa.array(ids, pa.list_(pa.int32()))]
                    columns.append(pa.array([table.decode(x.tolist()) for x in ids], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names)
                    start, ids, total = row + 1, [], 0

    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("bytes", T.BinaryType()),
        ]
    )
    return rows.mapInArrow(encode, schema)


def decoded(
    tokens: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """``bytes`` of each row's ids, next to its identifier and the ids."""
    id_type = tokens.schema[id_column].dataType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(path, pattern)
        for batch in batches:
            ids = batch.column(1)
            offsets, flat = ids.offsets.to_pylist(), ids.values.to_pylist()
            texts = [table.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["id", "ids", "bytes"])

    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("bytes", T.BinaryType()),
        ]
    )
    columns = [F.col(id_column).alias("id"), F.coalesce(ids_column, F.array().cast("array<int>")).alias("ids")]
    return tokens.select(*columns).mapInArrow(decode, schema).withColumnRenamed("id", id_column)


def token_counts(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``n_tokens`` of each row's text, next to its identifier."""
    id_type = docs.schema[id_column].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = coder(path, pattern)
        for batch in batches:
            counts = table.counts(text.as_py() for text in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType())])
    texts = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    return texts.mapInArrow(count, schema).withColumnRenamed("id", id_column)
