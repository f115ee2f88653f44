"""Problem 7: token ids by a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern. Each distinct piece is
merged once: its bytes form a doubly linked list of symbols, a priority queue
holds the merge ranks of neighbours, and entries whose symbols have changed
since are skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies on every machine; a parameter of each operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that this vocabulary's merges presuppose.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct pieces whose ids a worker keeps; beyond that it starts anew, so memory is bounded.
KEPT = 500_000
#: Longer pieces are merged each time they occur, so that kept pieces stay small.
KEPT_LENGTH = 200


@lru_cache(maxsize=4)
def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id, which is also the rank of the merge that makes it."""
    out: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, number = line.split()
                out[base64.b64decode(token)] = int(number)
    return out


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always the neighbours of least rank are joined, the leftmost first among equals."""
    n = len(piece)
    if n == 1:
        return [rank[piece]]
    end = list(range(1, n + 1))  # symbol i covers piece[i:end[i]]; 0 when it was joined to its left
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    queue: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        found = rank.get(piece[i : i + 2])
        if found is not None:
            queue.append((found, i, i + 2))
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        j = after[i] if end[i] else n
        if j >= n or end[j] != stop:
            continue  # stale: one of the two symbols is gone or has grown
        end[i], end[j] = stop, 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            found = rank.get(piece[i : end[after[j]]])
            if found is not None:
                heapq.heappush(queue, (found, i, end[after[j]]))
        if before[i] >= 0:
            found = rank.get(piece[before[i] : stop])
            if found is not None:
                heapq.heappush(queue, (found, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = after[i]
    return out


class _Pieces(dict):
    """Piece to its ids as packed 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.rank = ranks(path)

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(merge(piece.encode("utf-8", "replace"), self.rank), np.int32).tobytes()
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """Encodes texts with one vocabulary."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        self._cut = regex.compile(pattern).findall
        self._pieces = _Pieces(path)

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self._pieces.__getitem__, self._cut(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


def decode(ids: list[int] | None, path: str = VOCABULARY) -> str:
    """The text of these ids: their vocabulary strings in a row; bytes that are no UTF-8 become U+FFFD. Null gives an empty text."""
    return b"".join(_strings(path)[i] for i in ids or []).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _strings(path: str) -> dict[int, bytes]:
    return {number: token for token, number in ranks(path).items()}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path, pattern)


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            packed = [own.packed(t) for t in batch.column(1).to_pylist()]
            ends = np.r_[0, np.cumsum([len(p) // 4 for p in packed])].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return run


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n = np.array([len(own.packed(t)) // 4 for t in batch.column(-1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*batch.schema.names[:-1], "tokens"])

    return run


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(i, path) for i in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return run


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): each row's token ids, without special tokens, in one pass and without a shuffle.

    A null and an empty text have no ids: an empty list, never null. Text that
    spells a special token is ordinary text. Repeated rows each come out, with
    null ids kept as null; other columns are not read; an empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(vocabulary), f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text): the inverse of encode_texts; null and empty lists give an empty text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(vocabulary), f"id {df.schema[id_col].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of ids of the text; 0 for null and empty texts."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(_count(vocabulary), f"{schema}, tokens long")
