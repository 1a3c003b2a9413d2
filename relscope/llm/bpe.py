"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a partition are laid out as one array of symbols. An index maps each pair that has a rank to all
its positions; active ranks are applied in ascending order, each at all its positions at once, and the lists of the
pairs beside them are updated. As every token is made by one merge, a merge's result only takes part in later ranks,
so one pass over the ranks gives what merging word by word gives.

Model files are those of the tokenizers library (BPE, byte level). The driver reads the file; executors get its tables
by broadcast (the vocabulary's size, a few MB).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._text import Words, chunks, ragged
from ._vocab import Tokens, by_distinct_words

NONE = np.iinfo(np.int64).max
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be printed, else the next one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@cache
def char_classes() -> np.ndarray:
    """Of each code point: white space, letter, number or other, by Python's own tables."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def newer_classes(spec: str) -> dict[int, int]:
    """What the library takes for letters and numbers among the code points whose class depends on the year."""
    cut = library_tokenizer(spec).pre_tokenizer.pre_tokenize_str
    out = {}
    others = "".join(chr(c) for c in np.flatnonzero(char_classes() == OTHER).tolist() if not 0xD800 <= c < 0xE000)
    for c in regex.findall(r"[\p{L}\p{N}]", others):
        if len(cut("a" + c)) == 1:
            out[ord(c)] = LETTER
        elif len(cut("." + c)) == 2:
            out[ord(c)] = NUMBER
    return out


def unknown_chars() -> np.ndarray:
    """Of each code point whether Python's own tables lack it; a library with newer ones may change its case or
    compose it."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def library_tokenizer(spec: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


class BpeModel:
    """A model file's tables: symbols of bytes, merges, bytes of tokens, special tokens and how text is cut."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        self.width = 1 << 17
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        assert len(np.unique(self.made)) == len(self.made), "a token is made by two merges"
        self.twin = left == right
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(letters)}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for token, i in vocab.items():
            # a word end stands for white space that the cut dropped
            ends = bool(suffix) and token.endswith(suffix)
            self.bytes[i] = bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + b" " * ends
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.lower = spec["normalizer"] is not None  # NFC, white space, lower case
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.lookup: dict[int, int] | None = None
        self.spec = json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []})
        self.unknown = unknown_chars() if self.lower else np.zeros(0, bool)
        self.kinds = char_classes().copy()
        for c, kind in newer_classes(self.spec).items():
            self.kinds[c] = kind

    def rank_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    # -- text to words -------------------------------------------------------------------------------------------

    def normal(self, text: str) -> str:
        if not self.lower:
            return text
        if not text.isascii():
            if self.unknown[code_points(text)].any():
                return library_tokenizer(self.spec).normalizer.normalize_str(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def segments(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts cut at special tokens: pieces, the id of each that is special (else -1), first piece of each text."""
        pieces, special, first = [], [], [0]
        for t in texts:
            parts = self.split.split(t) if self.split and any(s in t for s in self.special) else [t]
            for k, p in enumerate(parts):
                if k % 2:
                    pieces.append("")
                    special.append(self.special[p])
                else:
                    pieces.append(self.normal(p))
                    special.append(-1)
            first.append(len(pieces))
        return pieces, np.array(special, np.int64), np.array(first)

    def cut(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where words begin, in code points; at: where pieces begin, and the end."""
        n = len(cp)
        kind = self.kinds[cp]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
        if self.lower:
            start |= kind == NUMBER
        run = np.flatnonzero(start)
        stop = np.r_[run[1:], n]
        quote = run[(cp[run] == 39) & (stop - run == 1) & (kind[run] == OTHER)]
        if not self.lower:
            ink = run[kind[run] != SPACE]
            before = ink[(ink > 0) & ~edge[ink]] - 1
            before = before[kind[before] == SPACE]
            start[before] = True  # a run's last white space stands alone, or leads the next word if it is a blank
            leads = before[cp[before] == 32]
            start[leads + 1] = False
            quote = quote[start[quote]]
        inside = lambda i: (i < n) & ~edge[np.minimum(i, n)]  # noqa: E731  of the same piece as what stands before
        c = lambda i: np.where(inside(i), cp[np.minimum(i, n - 1)], 0)
        c1 = c(quote + 1)
        c2 = np.where(c1 > 0, c(quote + 2), 0)
        one = np.isin(c1, [ord(x) for x in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        some = one | two
        q, size = quote[some], np.where(two, 2, 1)[some]
        start[q + 1] = False
        after = q + 1 + size
        start[after[after < n]] = True
        return np.flatnonzero(start)

    def words(self, ids, texts: list[str]) -> Tokens:
        """The words of texts; a special token is a word whose bytes are b'\\xff' and its id."""
        pieces, special, first = self.segments(texts)
        joined = "".join(pieces)
        cp = code_points(joined)
        at = np.r_[0, np.cumsum([len(p) for p in pieces])]
        start = self.cut(cp, at) if len(cp) else np.zeros(0, np.int64)
        end = np.r_[start[1:], len(cp)]
        byte = np.r_[0, np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))]  # where each code point is in UTF-8
        if self.lower:
            ink = self.kinds[cp[start]] != SPACE
            start, end = start[ink], end[ink]
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        codes, names = Words(raw, at, byte[start], byte[end], at).coded()
        before = np.searchsorted(start, at[first])
        marks = np.flatnonzero(special >= 0)
        if len(marks):
            kinds, which = np.unique(special[marks], return_inverse=True)
            codes = np.insert(codes, np.searchsorted(start, at[marks]), len(names) + which)
            names += [b"\xff" + str(i).encode() for i in kinds.tolist()]
            before = before + np.searchsorted(marks, first)
        return Tokens(ids, codes, names, before)

    # -- words to ids --------------------------------------------------------------------------------------------

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, and where each word's begin (one more than words)."""
        given = {i: int(w[1:]) for i, w in enumerate(words) if w[:1] == b"\xff"}
        if given:
            words = [b"" if i in given else w for i, w in enumerate(words)]
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
        sym, live = PairIndex(self, data, at).run() if len(data) else (np.zeros(0, np.int64), np.zeros(0, bool))
        count = np.r_[0, np.cumsum(live)][at]
        ids = sym[live]
        if given:
            where = np.array(sorted(given))
            ids = np.insert(ids, count[where], [given[i] for i in where.tolist()])
            count = count + np.searchsorted(where, np.arange(len(words) + 1))
        return ids.astype(np.int32), count

    def encode_parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document ids, token ids of all, where each document's begin) from batches of (id, text)."""

        def tokens() -> Iterator[Tokens]:
            for b in chunks(batches, "text"):
                yield self.words(b.column(0), b.column(1).fill_null("").to_pylist())

        def emit(ids, first, number, solved):
            flat, at = solved
            size = np.diff(at)[number]
            return ids, flat[ragged(at[number], size)], np.r_[0, np.cumsum(size)][first]

        return by_distinct_words(tokens(), self.encode_words, emit)

    # -- ids to text ---------------------------------------------------------------------------------------------

    def decode(self, ids) -> str:
        """The text of byte-level ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


class PairIndex:
    """Symbols of a partition's words, and for each ranked pair its positions."""

    def __init__(self, model: BpeModel, data: np.ndarray, at: np.ndarray):
        self.model = model
        n = len(data)
        self.sym = model.first[data]
        full = at[1:][np.diff(at) > 0]
        self.sym[full - 1] = model.last[data[full - 1]]
        self.next = np.arange(1, n + 1)
        self.next[full - 1] = -1
        self.prev = np.arange(-1, n - 1)
        self.prev[full[:-1]] = -1
        self.live = np.ones(n, bool)
        self.rank = np.full(n, NONE)
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.refresh(np.arange(n))

    def refresh(self, at: np.ndarray) -> None:
        """Give the pairs at these positions their ranks, and put the positions into the lists of those."""
        m, follow = self.model, self.next[at]
        rank = m.rank_of(self.sym[at] * m.width + self.sym[follow])
        rank[follow < 0] = NONE
        self.rank[at] = rank
        some = rank != NONE
        at, rank = at[some], rank[some]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        if not len(at):
            return
        begins = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        for a, b, r in zip(begins.tolist(), [*begins[1:].tolist(), len(at)], rank[begins].tolist(), strict=True):
            self.enlist(r, at[a:b])

    def enlist(self, r: int, at) -> None:
        known = self.lists.get(r)
        if known is None:
            self.lists[r] = [at]
            heapq.heappush(self.heap, r)
        else:
            known.append(at)

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        if m.lookup is None:
            m.lookup = dict(zip(m.keys.tolist(), m.ranks.tolist(), strict=True))
        while self.heap:
            r = heapq.heappop(self.heap)
            at = self.lists.pop(r)
            if sum(x.size for x in at) <= 6:
                self.merge_few(r, sorted(i for x in at for i in x.tolist()))
                continue
            at = np.concatenate(at) if len(at) > 1 else at[0]
            at = at[self.rank[at] == r]
            if m.twin[r] and len(at) > 1:
                at = np.sort(at)
                chained = np.r_[False, self.next[at[:-1]] == at[1:]]
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if len(at):
                self.merge(r, at)
        return self.sym, self.live

    def merge(self, r: int, at: np.ndarray) -> None:
        gone = self.next[at]
        follow = self.next[gone]
        self.sym[at] = self.model.made[r]
        self.next[at] = follow
        inner = follow >= 0
        self.prev[follow[inner]] = at[inner]
        self.rank[gone] = NONE
        self.live[gone] = False
        before = self.prev[at]
        touched = np.sort(np.concatenate([at, before[before >= 0]]))
        self.refresh(touched[np.r_[True, touched[1:] != touched[:-1]]])

    def merge_few(self, r: int, at: list[int]) -> None:
        sym, nxt, prev, rank, live, m = self.sym, self.next, self.prev, self.rank, self.live, self.model
        made, lookup, width = int(m.made[r]), m.lookup, m.width
        touched = []
        for i in at:
            if rank.item(i) != r:
                continue
            gone = nxt.item(i)
            follow = nxt.item(gone)
            sym[i] = made
            nxt[i] = follow
            if follow >= 0:
                prev[follow] = i
            rank[gone] = NONE
            live[gone] = False
            before = prev.item(i)
            if before >= 0:
                if rank.item(before) == r:  # its pair is no more; a twin pair must not be merged again
                    rank[before] = NONE
                touched.append(before)
            rank[i] = NONE
            touched.append(i)
        for i in dict.fromkeys(touched):
            if live.item(i) and (follow := nxt.item(i)) >= 0:
                k = lookup.get(sym.item(i) * width + sym.item(follow), NONE)
                rank[i] = k
                if k != NONE:
                    self.enlist(k, np.array([i]))
            else:
                rank[i] = NONE


def load(df: DataFrame, path: str):
    """The model, broadcast: its size is that of its vocabulary."""
    return df.sparkSession.sparkContext.broadcast(BpeModel(path))


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: each text's token ids, as the tokenizers library gives them without added special tokens.

    A null or empty text has no ids; special tokens that occur in a text are encoded as such, as the library does.
    Document ids may repeat or be null; rows are encoded one by one. Other columns are not read.
    """
    model = load(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, at in model.value.encode_parts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, text: the text of each array of byte-level token ids, special tokens included. Null ids give ''."""
    model = load(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.value.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[ids].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
