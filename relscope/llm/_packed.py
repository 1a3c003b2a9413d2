"""Shuffling many small (document, hash, number) entries as few packed rows.

A map task sorts its entries by key (a bucket of hashes, or a group of documents) and writes one row for each key:
numpy arrays as bytes, the documents run-length coded as differences, and each number's bytes by place value. Longer
arrays are compressed by zstandard, which unlike the shuffle's codec codes frequent bytes shorter; hashes, which do
not compress, are left as they are. A row of 10,000 entries costs Spark one row. The reducer of a key unpacks its rows into whole arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

SMALL = 64  # bytes that are not worth a frame
LEAST, MOST = 4096, 2_000_000  # entries a row should have, and those that a task may hold for it
ZIP, UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()  # one each: making them takes longer than a short row
SCHEMA = "key int, kind int, docs binary, runs binary, hashes binary, extra binary, more binary"
ARROW = pa.schema([("key", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("docs", "runs", "hashes", "extra", "more"))])
EMPTY = pa.Table.from_batches([], ARROW)


def planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def flat(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def squeezed(x: np.ndarray) -> bytes:
    """planes(x), compressed if that is shorter; the first byte tells."""
    raw = planes(x)
    if len(raw) > SMALL:
        small = ZIP.compress(raw)
        if len(small) < len(raw):
            return b"\1" + small
    return b"\0" + raw


def unsqueezed(raw: bytes, dtype) -> np.ndarray:
    return flat(UNZIP.decompress(raw[1:]) if raw[:1] == b"\1" else raw[1:], dtype)


def planes_of(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()


def flat_of(raw: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.reshape(-1).view(np.uint64)


def doc_group(doc: np.ndarray, groups: int) -> np.ndarray:
    """As ``pmod(doc_id, groups)`` in Spark."""
    return np.mod(doc, groups)


def pack(key: np.ndarray, doc: np.ndarray, hashes: np.ndarray, extra: np.ndarray, kind: int, width: int = 8, more: np.ndarray | None = None) -> list[pa.RecordBatch]:
    """One row for each key; entries of one document should be neighbours. extra: int32; more: a second hash."""
    if not len(key):
        return []
    small = key.astype(np.uint16) if int(key.max()) < 1 << 16 else key
    order = np.argsort(small, kind="stable")
    key, doc, hashes, extra = key[order], doc[order], hashes[order], extra[order].astype(np.int32)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[cut[1:], len(key)]
    rows: dict[str, list] = {n: [] for n in ARROW.names}
    for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
        d = doc[a:b]
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        rows["key"].append(int(key[a]))
        rows["kind"].append(kind)
        rows["docs"].append(squeezed(np.diff(d[at].astype(np.int64), prepend=np.int64(0))))
        rows["runs"].append(squeezed(np.diff(np.r_[at, b - a]).astype(np.int32)))
        rows["hashes"].append(planes_of(hashes[a:b].astype(np.uint64), width))
        rows["extra"].append(squeezed(extra[a:b]))
        rows["more"].append(None if more is None else planes(more[order[a:b]]))
    return pa.Table.from_pydict(rows, ARROW).to_batches()


class Held:
    """Entries of several chunks of a map task, packed together: a chunk has as many rows as keys, so rows of single
    chunks would grow in number with the square of the input, and get shorter and shorter."""

    def __init__(self, keys: int, kind: int, width: int = 8):
        self.enough, self.kind, self.width = min(MOST, LEAST * keys), kind, width
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, key: np.ndarray, doc: np.ndarray, hashes: np.ndarray, extra: np.ndarray) -> list[pa.RecordBatch]:
        """Rows, as soon as there are enough entries for them."""
        self.parts.append((key.astype(np.int32), doc, hashes, extra.astype(np.int32)))
        self.n += len(key)
        return self.rest() if self.n >= self.enough else []

    def rest(self) -> list[pa.RecordBatch]:
        """Rows of what is held."""
        parts, self.parts, self.n = self.parts, [], 0
        if not parts:
            return []
        columns = parts[0] if len(parts) == 1 else tuple(np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        return pack(*columns, self.kind, self.width)


def unpack(table: pa.Table, width: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, hashes and extras of all rows, one after another."""
    doc = [np.repeat(np.cumsum(unsqueezed(d, np.int64)), unsqueezed(r, np.int32)) for d, r in zip(table["docs"].to_pylist(), table["runs"].to_pylist(), strict=True)]
    hashes = [flat_of(h, width) for h in table["hashes"].to_pylist()]
    extra = [unsqueezed(e, np.int32) for e in table["extra"].to_pylist()]
    if not doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(doc), np.concatenate(hashes), np.concatenate(extra)


def more(table: pa.Table) -> np.ndarray:
    """The second hashes of all rows."""
    return np.concatenate([flat(m, np.uint64) for m in table["more"].to_pylist()] or [np.zeros(0, np.uint64)])


def kind(table: pa.Table, k: int) -> pa.Table:
    return table.filter(pa.array(np.asarray(table["kind"]) == k))
