"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into whole sequences of the largest length and then into the powers of two of what is
left, largest first. Every piece is a sequence by itself, of a length that is a power of two, so no sequence crosses
documents and none is padded; sequences of one length form a bucket and are numbered in it, for batches of equal
lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ._text import ragged
from .bpe import load
from .sharding import number_within

COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def decompose(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of n tokens; most is a power of two."""
    bits = most.bit_length() - 1
    whole = n // most
    rest = n % most
    powers = 1 << np.arange(bits - 1, -1, -1)
    has = (rest[:, None] & powers) > 0
    count = whole + has.sum(axis=1)
    doc = np.repeat(np.arange(len(n)), count)
    rank = ragged(np.zeros(len(n), np.int64), count)
    length = np.full(len(doc), most, np.int64)
    length[rank >= whole[doc]] = np.broadcast_to(powers, has.shape)[has]
    done = np.cumsum(length) - length
    start = done - done[(np.cumsum(count) - count)[doc]] if len(doc) else done
    return doc, start, length


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", most: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of length), slot (numbered
    from 0 in its bucket), sequence_id (unique), offset (0) and, with_ids, the token ids.

    A document's tokens are its text's, under the tokenizers file, and end_id. A null text counts as empty: one piece
    of one token. Ids may repeat or be null: each row is packed by itself. Other columns are not read. An empty table
    gives no rows.
    """
    assert most & (most - 1) == 0, "the largest length must be a power of two"
    model = load(df, path)
    schema = COLUMNS + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, at in model.value.encode_parts(batches):
            docs = np.arange(len(ids))
            flat = np.insert(flat, at[1:], end_id).astype("<u4")
            at = at + np.r_[0, docs + 1]
            n = np.diff(at)
            doc, start, length = decompose(n, most)
            begin = at[doc] + start
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [ids.take(pa.array(doc)), *(pa.array(x) for x in (start, length, np.array(crc, np.int64), n[doc])), pa.array(np.log2(length).astype(np.int32))]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    pieces = cut(df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, schema))
    numbered = number_within(pieces, "bucket", ["doc_id", "start", "ids_crc32", "doc_tokens"], "slot")
    bits = most.bit_length()
    return numbered.withColumn("sequence_id", F.col("slot") * bits + F.col("bucket")).withColumn("offset", F.lit(0).cast("long"))
