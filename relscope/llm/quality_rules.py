"""Quality rules: base statistics of a text, and compression bands.

A text is compressed by zstandard as a whole and in chunks of a fixed size. Very low ratios show repetition, very high
ones noise. What is normal depends on the length, so each band holds for texts from one length to the next; the chunks
find a repetitive or noisy part that a text's mean hides. Chunks cover every byte: the last one ends where the text ends.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from ._text import Words, chunks, split_words, string_parts

LEVEL, CHUNK = 3, 4096
#: (bytes from, lowest, highest ratio of compressed to plain bytes); shorter texts than the first have no band
BANDS = ((256, 0.35, 0.85), (512, 0.32, 0.80), (1024, 0.30, 0.72), (2048, 0.28, 0.66), (4096, 0.26, 0.62), (16384, 0.22, 0.58))
#: the band of a whole chunk
CHUNK_BAND = (0.15, 0.75)
#: (bytes from, size of a chunk, its lowest, its highest ratio); shorter texts than the first are checked as a whole only
CHUNKS = ((512, 256, 0.30, 0.90), (2048, 1024, 0.20, 0.77), (2 * CHUNK, CHUNK, *CHUNK_BAND))
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][at])


def _trigrams(code: np.ndarray, n: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, number) of all runs of three words in one text; equal numbers are equal runs."""
    at = np.arange(max(len(code) - 2, 0))
    left = np.repeat(first[1:], np.diff(first))[: len(at)] - at
    at = at[left >= 3]
    a, b, c = (code[at + k].astype(np.int64) for k in range(3))
    pair = a * n + b
    if n**3 >= 1 << 63:
        names, pair = np.unique(pair, return_inverse=True)
        if len(names) * n >= 1 << 63:
            raise OverflowError("a chunk has too many distinct words")
    return at, pair * n + c


def _again(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an entry's hash occurs twice or more in its document, and whether it occurred before."""
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
    often = same | np.r_[same[1:], False]
    out = []
    for x in (often, same):
        y = np.empty(len(h), bool)
        y[order] = x
        out.append(y)
    return out[0], out[1]


def base_statistics(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The base columns of a chunk of texts."""
    words = split_words(data, at)
    ink = np.zeros(len(data) + 1, np.int64)
    ink[words.start] += 1
    np.subtract.at(ink, words.end, 1)
    inside = np.cumsum(ink[:-1]) > 0
    # lines that hold a word
    edge = np.zeros(len(data) + 1, bool)
    edge[at[:-1]] = True
    edge[np.flatnonzero(data == 10) + 1] = True
    start = np.flatnonzero(edge[:-1])
    end = np.r_[start[1:], len(data)]
    end = end - ((end > start) & (data[np.maximum(end, 1) - 1] == 10) if len(data) else 0)
    held = np.r_[0, np.cumsum(inside)]
    some = held[end] > held[start]
    lines = Words(data, at, start[some], end[some], np.searchsorted(start[some], at))
    _, before = _again(lines.doc_of(), lines.coded()[0])
    code, names = words.coded()
    pos, grams = _trigrams(code, len(names), words.first)
    often, _ = _again(words.doc_of()[pos], grams)
    repeated = np.zeros(len(words.start), bool)
    for k in range(3):
        repeated[pos[often] + k] = True
    return dict(
        n_words=words.count,
        word_chars=_per_doc(inside & ((data & 0xC0) != 0x80), at),
        n_symbols=_per_doc(SYMBOLS[data], at),
        n_dup_lines=_per_doc(before, lines.first),
        n_repeat_words=_per_doc(repeated, words.first),
    )


def band_of(n: int) -> tuple[float, float]:
    low, high = 0.0, np.inf
    for start, a, b in BANDS:
        if n >= start:
            low, high = a, b
    return low, high


def chunks_of(n: int) -> tuple[int, float, float]:
    """The size of a text's chunks (0: none) and their band."""
    size, low, high = 0, 0.0, np.inf
    for start, *chunk in CHUNKS:
        if n >= start:
            size, low, high = chunk
    return size, low, high


def compression(raw: bytes, pack: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Ratio of the whole text, and the lowest and highest of its chunks, or of the text if it has none (a ratio of 0
    bytes is 1). Chunks follow each other; the last one ends where the text ends and may overlap the one before."""
    n = len(raw)
    size = chunks_of(n)[0]
    whole = len(pack.compress(raw)) / n if n else 1.0
    parts = [len(pack.compress(raw[i : i + size])) / size for i in [*range(0, n - size, size), n - size]] if size else []
    return whole, min(parts, default=whole), max(parts, default=whole)


def judge(df: DataFrame, doc_id: str = "doc_id", text: str = "text", also: Sequence[str] = ()) -> DataFrame:
    """doc_id, the base columns, base_failed, the ratios and kept, for each row, and the row's columns named in also.

    base_failed: fewer than 50 words, or more than half of the words in 3-word windows that occur again. kept: not
    base_failed, the whole ratio within the band of the length and all chunks' ratios within that of their size. A null text
    counts as empty. Rows are judged one by one: ids may repeat or be null. Other columns are not read.
    """
    names = ["doc_id", *NAMES, "base_failed", "ratio", "lowest_chunk", "highest_chunk", "kept", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        for b in chunks(batches, "text"):
            data, at = string_parts(b.column(1))
            base = base_statistics(data, at)
            raw = memoryview(data.tobytes())
            ratios = np.array([compression(raw[i:j], pack) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]).reshape(-1, 3)
            bands = np.array([band_of(n) for n in np.diff(at).tolist()]).reshape(-1, 2)
            failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
            parts = np.array([chunks_of(n)[1:] for n in np.diff(at).tolist()]).reshape(-1, 2)
            good = (ratios[:, 0] >= bands[:, 0]) & (ratios[:, 0] <= bands[:, 1]) & (ratios[:, 1] >= parts[:, 0]) & (ratios[:, 2] <= parts[:, 1])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(base[n].astype(np.int64)) for n in NAMES), pa.array(failed), *(pa.array(ratios[:, k]) for k in range(3)), pa.array(good & ~failed), *(b.column(i) for i in extra)], names=names)

    rows = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text"), *(df[c] for c in also if c != text))
    extra = [1 if c == text else rows.columns.index(c, 2) for c in also]
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, ratio double, lowest_chunk double, highest_chunk double, kept boolean"
    return rows.mapInArrow(run, StructType([*StructType.fromDDL(schema), *(StructField(c, rows.schema[i].dataType) for c, i in zip(also, extra, strict=True))]))
