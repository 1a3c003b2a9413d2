"""Exact substring deduplication by fixed-block anchors.

A window of w words holds a whole block of b = (w + 1) // 2 words that starts at a multiple of b in its document. So:

1. index: every document's non-overlapping b-word blocks; probe: every rolling b-word window. Both meet by hash.
   A probe hits where a smaller document has the block; the block is then wanted by a larger document.
2. extend: hits and wanted blocks are extended over all w-word windows that hold them, and those windows of probes
   and of references meet by a 128-bit hash of their words' 128-bit hashes. The union of the confirmed windows is the
   union of the maximal exact repeats of at least w words.
3. mark: words under confirmed windows are removed, where the text has the confirmed hash at that place: rows that
   repeat a doc_id with another text are told apart by it.

Entries travel packed (see _packed). A map task settles by itself what it can: of a hash that many of its documents
share, only the smallest reference, the largest document and the unsettled entries are sent, so a passage that a
third of all documents hold sends a few entries from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packed as P
from ._text import CHUNK_BYTES, Words, buckets_for, chunks, ragged, split_words, string_parts, windows

BIG = np.iinfo(np.int64).max
ENTRIES, HITS = 0, 1
PROBE, REF = 1, 2
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, and where each run of equal keys starts."""
    order = np.argsort(key)
    k = key[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)


def _settle(key: np.ndarray, doc: np.ndarray, ref: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each entry: a smaller document has it as reference; a larger document probes it; it tells others of either."""
    order, at = _groups(key)
    if not len(at):
        e = np.zeros(0, bool)
        return e, e, e
    n = np.diff(np.r_[at, len(key)])
    d, r, p = doc[order], ref[order], probe[order]
    low, high = np.where(r, d, BIG), np.where(p, d, -BIG)
    least, most = np.repeat(np.minimum.reduceat(low, at), n), np.repeat(np.maximum.reduceat(high, at), n)
    out = []
    for x in (p & (least < d), r & (most > d), (r & (d == least)) | (p & (d == most))):
        y = np.empty(len(key), bool)
        y[order] = x
        out.append(y)
    return tuple(out)


def _anchor_map(w: int, b: int, nb: int, nd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, hits = P.Held(nb, ENTRIES, 4), P.Held(nd, HITS, 1)
        for batch in chunks(batches, "text"):
            words = split_words(*string_parts(batch.column(1)))
            ids = np.asarray(batch.column(0))
            at, h = windows(words.hashes()[0], words.first, b)
            own = words.doc_of()[at]
            long = words.count[own] >= w
            at, h, own = at[long], h[long], own[long]
            pos, doc = at - words.first[own], ids[own]
            block = pos % b == 0
            hit, wanted, tells = _settle(h, doc, block, np.ones(len(doc), bool))
            send = ~hit | (block & ~wanted) | tells
            yield from entries.add((h[send] >> np.uint64(32)) % np.uint64(nb), doc[send], h[send], pos[send])
            yield from hits.add(*_hits(doc, pos, hit, wanted, nd))
        yield from entries.rest()
        yield from hits.rest()

    return run


def _hits(doc, pos, hit, wanted, nd) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    some = hit | wanted
    role = hit[some] * PROBE + wanted[some] * REF
    return P.doc_group(doc[some], nd), doc[some], role.astype(np.uint64), pos[some]


def _anchor_reduce(b: int, nd: int):
    def run(table: pa.Table) -> pa.Table:
        passed = P.kind(table, HITS)
        doc, h, pos = P.unpack(P.kind(table, ENTRIES), 4)
        hit, wanted, _ = _settle(h.astype(np.uint32), doc, pos % b == 0, np.ones(len(doc), bool))
        order = np.lexsort((pos[hit | wanted], doc[hit | wanted]))
        at = np.flatnonzero(hit | wanted)[order]
        return pa.concat_tables([passed, pa.Table.from_batches(P.pack(*_hits(doc[at], pos[at], hit[at], wanted[at], nd), HITS, 1), P.ARROW)])

    return run


def _texts(table: pa.Table) -> Iterator[tuple[np.ndarray, Words]]:
    for batch in chunks(iter(table.combine_chunks().to_batches()), "text"):
        yield np.asarray(batch.column(0)), split_words(*string_parts(batch.column(1)))


def _places(ids: np.ndarray, words: Words, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, index of the entry) for each text with an entry's document that has its position."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids, doc, side, sorter=order) for side in ("left", "right"))
    own, entry = order[ragged(low, high - low)], np.repeat(np.arange(len(doc)), high - low)
    there = pos[entry] < words.count[own]
    return own[there], entry[there]


def _marks(words: Words, own: np.ndarray, pos: np.ndarray, before: int, after: int) -> np.ndarray:
    """True for each word from before words before to after words after one of the positions, within the document."""
    first, last = words.first[own], words.first[own + 1]
    step = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(step, np.maximum(first + pos - before, first), 1)
    np.add.at(step, np.minimum(first + pos + after + 1, last), -1)
    return np.cumsum(step[:-1]) > 0


def _both(words: Words, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of w words begin, and two 64-bit hashes of each."""
    a, b = words.hashes()
    at, h = windows(a, words.first, w)
    return at, h, windows(b, words.first, w)[1]


def _extend(w: int, b: int, nb: int, nd: int):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        doc, role, pos = P.unpack(hits, 1)
        if not len(doc):
            return P.EMPTY
        some = pa.array(np.isin(np.asarray(docs["doc_id"]), doc))
        found: list[tuple[np.ndarray, ...]] = []
        for ids, words in _texts(docs.filter(some)):
            own, entry = _places(ids, words, doc, pos)
            at, h, g = _both(words, w)
            flags = []
            for r in (PROBE, REF):
                is_r = (role[entry] & np.uint64(r)) > 0
                flags.append(_marks(words, own[is_r], pos[entry[is_r]], w - b, 0)[at])
            keep = flags[0] | flags[1]
            of = words.doc_of()[at[keep]]
            found.append((h[keep], g[keep], ids[of], at[keep] - words.first[of], flags[1][keep], flags[0][keep]))
        h, g, doc, pos, ref, probe = (np.concatenate(x) for x in zip(*found, strict=True))
        done, _, tells = _settle(_names(h, g), doc, ref, probe)
        # a reference is told only by the smallest document that has it; a probe is sent until it is settled
        send = (probe & ~done) | (ref & tells)
        info = (pos * 4 + ref * REF + probe * PROBE)[send]
        key = ((h[send] >> np.uint64(32)) % np.uint64(nb)).astype(np.int64)
        out = P.pack(key, doc[send], h[send], info, ENTRIES, more=g[send])
        out += P.pack(P.doc_group(doc[done], nd), doc[done], h[done], pos[done], HITS)
        return pa.Table.from_batches(out, P.ARROW)

    return lambda _key, docs, hits: run(docs, hits)


def _names(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A number for each pair of hashes."""
    if not len(h):
        return h
    order = np.lexsort((g, h))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new)
    return out


def _confirm(nd: int):
    def run(table: pa.Table) -> pa.Table:
        passed = P.kind(table, HITS)
        entries = P.kind(table, ENTRIES)
        doc, h, info = P.unpack(entries)
        done, _, _ = _settle(_names(h, P.more(entries)), doc, (info & REF) > 0, (info & PROBE) > 0)
        doc, pos, h = doc[done], info[done] >> 2, h[done]
        order = np.lexsort((pos, doc))
        rows = P.pack(P.doc_group(doc[order], nd), doc[order], h[order], pos[order], HITS)
        return pa.concat_tables([passed, pa.Table.from_batches(rows, P.ARROW)])

    return run


def _remove(w: int):
    def run(docs: pa.Table, hits: pa.Table) -> pa.Table:
        doc, sure, pos = P.unpack(hits)
        out = []
        for ids, words in _texts(docs):
            gone = np.zeros(len(words.start), bool)
            own, entry = _places(ids, words, doc, pos)
            if len(own):
                at, h, _ = _both(words, w)
                hash_at = np.zeros(len(words.start), np.uint64)
                hash_at[at] = h
                whole = np.zeros(len(words.start), bool)
                whole[at] = True
                word = words.first[own] + pos[entry]
                same = whole[word] & (hash_at[word] == sure[entry])
                gone = _marks(words, own[same], pos[entry[same]], 0, w - 1)
            out.append(_result(pa.array(ids), words, gone))
        return pa.Table.from_batches(out, OUT)

    return lambda _key, docs, hits: run(docs, hits)


def _result(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.RecordBatch:
    n_removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), words.first[:-1]) * (words.count > 0) if len(ids) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([ids, pa.array(words.count), pa.array(n_removed), join_words(words, ~gone)], schema=OUT)


def _unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        words = split_words(*string_parts(batch.column(1)))
        yield _result(batch.column(0), words, np.zeros(len(words.start), bool))


def join_words(words: Words, keep: np.ndarray) -> pa.Array:
    """Each document's kept words joined by one space."""
    start, end = words.start[keep], words.end[keep]
    length = end - start + 1
    data = np.r_[words.data, np.uint8(32)][ragged(start, length)]
    stop = np.cumsum(length)
    data[stop - 1] = 32
    kept = np.r_[0, np.cumsum(keep)][words.first]  # of words, before each document
    at = np.r_[0, stop][kept]
    last = at[1:][np.diff(kept) > 0] - 1  # no space after a document's last word
    data = np.delete(data, last)
    at = at - np.r_[0, np.cumsum(np.diff(kept) > 0)]
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data.tobytes()))


def dedup_substrings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, bucket_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each document without the words under any run of ``window`` words whose
    sequence also starts in a document with a smaller doc_id (judged on the input).

    doc_id must be an integer. Rows may repeat an id with the same or another text: neither is smaller than the other.
    A null id is neither smaller nor larger than any, so such a row loses no words and takes none. A null text has no
    words. Other columns are not read. An empty table gives no rows.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = rows.where("doc_id IS NOT NULL")
    b = (window + 1) // 2
    nb = buckets_for(rows, bucket_bytes)
    nd = nb | 1
    entries = docs.mapInArrow(_anchor_map(window, b, nb, nd), P.SCHEMA)
    hits = entries.groupBy("key").applyInArrow(_anchor_reduce(b, nd), P.SCHEMA)
    grouped = docs.withColumn("key", F.pmod("doc_id", F.lit(nd)).cast("int"))
    found = grouped.groupBy("key").cogroup(hits.groupBy("key")).applyInArrow(_extend(window, b, nb, nd), P.SCHEMA)
    confirmed = found.groupBy("key").applyInArrow(_confirm(nd), P.SCHEMA)
    schema = "doc_id long, n_words long, n_removed long, kept string"
    out = grouped.groupBy("key").cogroup(confirmed.groupBy("key")).applyInArrow(_remove(window), schema)
    return out.unionByName(rows.where("doc_id IS NULL").mapInArrow(_unchanged, schema))
