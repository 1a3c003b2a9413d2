"""Columnar text helpers: whole Arrow string columns become byte or code point arrays, words become numbers.

Inside a chunk words are numbered by their bytes, compared in full. Between tasks a word is its XXH3 hash of 128 bits.

Everything here is vectorised over a chunk of documents whose text is bounded by ``CHUNK_BYTES`` (one longer
document makes a chunk of its own), so a worker's memory does not depend on the size of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_128_digest

from ..checkpoint import cut

CHUNK_BYTES = 2 << 20

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (shift, multiply) on unsigned 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))



def intern(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each of the byte strings that follow each other in raw (at: where each starts, and the end), and
    the distinct strings by number. Equal numbers are equal bytes: no hash decides."""
    if len(at) < 2:
        return np.zeros(0, np.int32), []
    kind, size = (pa.large_binary(), np.int64) if at[-1] >= 1 << 31 else (pa.binary(), np.int32)
    strings = pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(size)), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = strings.dictionary_encode()
    _, off, data = coded.dictionary.buffers()
    ends = np.frombuffer(off, size)[: len(coded.dictionary) + 1].tolist()
    held = data.to_pybytes() if data is not None else b""
    return np.asarray(coded.indices), [held[a:b] for a, b in zip(ends, ends[1:])]  # noqa: B905


def digests(names: list[bytes]) -> np.ndarray:
    """The 128-bit hash of each byte string, as two unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(map(xxh3_128_digest, names)), np.uint64).reshape(-1, 2)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a chunk of documents, as positions in its UTF-8 bytes."""

    data: np.ndarray  # uint8
    doc_start: np.ndarray  # byte offsets, one more than documents
    start: np.ndarray  # of each word
    end: np.ndarray
    first: np.ndarray  # index of each document's first word, one more than documents

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of every word among the distinct ones, and these."""
        step = np.zeros(len(self.data) + 1, np.int8)
        step[self.start] += 1
        step[self.end] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        return intern(self.data[inside], np.r_[0, np.cumsum(self.end - self.start)])

    def hashes(self) -> np.ndarray:
        """Two 64-bit halves of every word's hash, a row each."""
        code, names = self.coded()
        return np.ascontiguousarray(digests(names).T)[:, code]


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words inside one document: (index of the first word, hash)."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for t in range(k):
        total ^= total >> _U(29)  # so that sequences of few words have no algebra
        total *= _U(0xD6E8FEB86659FD93)
        total += h[t : t + n]
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(left >= k)
    return at, mix64(total[at])


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, or one document."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        at = string_parts(col)[1]
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets (starting at 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(data: np.ndarray, at: np.ndarray) -> Words:
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~ink[:-1] | edge[1:-1]
    after[:-1] = ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(ink & before), np.flatnonzero(ink & after) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i], ..., starts[i] + lengths[i] - 1 for each i in turn."""
    lengths = np.asarray(lengths, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(np.asarray(starts, np.int64) - at, lengths)


#: Plans whose partitions hold the same rows in the same order whenever they are computed again.
STEADY = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "Relation", "ExternalRDD", "SerializeFromObject", "DataSourceV2ScanRelation"}


def settled(df: DataFrame) -> DataFrame:
    """The frame if it only reads and projects, else written down: so that a row can be named by its place."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().split(" ")[0] not in STEADY:
            return cut(df)
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return df


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the frame's size, from files and schema: nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bytes_each: int, least: int = 16, most: int = 1 << 24) -> int:
    """So many buckets that each gets about bytes_each of the frame, from its estimated size."""
    return max(least, min(most, -(-plan_bytes(df) // bytes_each)))
