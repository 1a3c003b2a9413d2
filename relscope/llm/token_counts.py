"""Token counts of a unigram language model by dynamic programming over a shared trie.

The distinct pre-tokens of a partition (words with a leading U+2581) are put into a trie. Going down level by level,
each node keeps the pieces of the vocabulary that are under way, with the forward score at the place where they
began; the best forward score of a prefix, and with it its number of tokens, is computed once for all words that
share it. A word's count is stored at its terminal node.

The vocabulary is a sentencepiece model's. A piece's log probability is that of its rank under Zipf's law, in
fixed-point numbers; a character that is no piece counts as its UTF-8 bytes, at the lowest score. Among equally good
segmentations the one with the fewest tokens counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import chunks, ragged, split_words, string_parts
from ._vocab import Tokens, by_distinct_words

NEVER, MANY = np.iinfo(np.int64).min // 2, np.iinfo(np.int64).max


class UnigramModel:
    """A trie of pieces as one sorted table of (node, character) -> node, and the score of each node that ends one."""

    def __init__(self, path: str, shift: float = 2.7, scale: int = 1000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        total = math.log(sum(1 / (r + shift) for r in range(len(pieces))))
        self.scores = {p: round(scale * (-math.log(r + shift) - total)) for r, p in enumerate(pieces)}
        self.byte_score = min(self.scores.values()) - scale
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for piece, score in self.scores.items():
            at = 0
            for c in piece:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            ends[at] = score
        keys = np.array([(a << 21) | c for a, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(nodes.values()), np.int64)[order]
        self.gain = np.zeros(len(nodes) + 1, np.int64)  # 0: no piece ends here; scores are below it
        for at, score in ends.items():
            self.gain[at] = score
        self.single = np.array(sorted(ord(p) for p in self.scores if len(p) == 1))

    def move(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node reached, or -1."""
        key = (node << 21) | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def fallback(self, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of tokens of a character's bytes; no score where the character is a piece."""
        size = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
        at = np.minimum(np.searchsorted(self.single, char), len(self.single) - 1)
        return np.where(self.single[at] == char, NEVER, size * self.byte_score), size

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word's best segmentation."""
        texts = ["▁" + w.decode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(texts)), key=texts.__getitem__)
        cp = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter((len(texts[i]) for i in order), np.int64, len(order))
        begin = np.cumsum(size) - size
        counts = np.zeros(len(texts), np.int64)
        order = np.array(order, np.int64)
        alive = np.arange(len(order))  # words, in sorted order, that are longer than the level
        node = np.zeros(len(order), np.int64)  # of each alive word at the level above
        best, tokens = np.zeros(1, np.int64), np.zeros(1, np.int64)  # forward score of each node of the level above
        # pieces under way, by node: where they are in the vocabulary, score and tokens where they began
        at, state, base, since = np.zeros(2, np.int64), *(np.zeros(0, np.int64) for _ in range(3))
        level = 0
        while len(alive):
            char = cp[begin[alive] + level]
            fresh = np.r_[True, (char[1:] != char[:-1]) | (node[1:] != node[:-1])]
            first = np.flatnonzero(fresh)
            parent, c = node[first], char[first]  # of each node of this level
            node = np.cumsum(fresh) - 1
            # pieces under way go on, and one begins at each parent
            held = at[parent + 1] - at[parent]
            pick = ragged(at[parent], held)
            who = np.repeat(np.arange(len(first)), held)
            who = np.concatenate([who, np.arange(len(first))])
            old = np.concatenate([state[pick], np.zeros(len(first), np.int64)])
            start, held = np.concatenate([base[pick], best[parent]]), np.concatenate([since[pick], tokens[parent]])
            new = self.move(old, c[who])
            go = np.flatnonzero(new >= 0)
            go = go[np.argsort(who[go], kind="stable")]
            who, new, start, held = who[go], new[go], start[go], held[go]
            gain, size_ = self.fallback(c)
            plain, spent = best[parent] + gain, tokens[parent] + size_
            ends = self.gain[new] != 0
            node_of, score = who[ends], start[ends] + self.gain[new[ends]]
            best = plain.copy()
            np.maximum.at(best, node_of, score)
            tokens = np.where(plain == best, spent, MANY)
            good = score == best[node_of]
            np.minimum.at(tokens, node_of[good], held[ends][good] + 1)
            state, base, since = new, start, held
            at = np.searchsorted(who, np.arange(len(first) + 1))
            level += 1
            done = size[alive] == level
            counts[order[alive[done]]] = tokens[node[done]]
            alive, node = alive[~done], node[~done]
        return counts


def count_tokens(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of each text under the model in the sentencepiece file (read on the driver, broadcast).

    Null, empty and wordless texts have 0 of both. Rows are counted one by one: ids may repeat or be null. Other
    columns are not read. An empty table gives no rows.
    """
    model = df.sparkSession.sparkContext.broadcast(UnigramModel(path))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
        for b in chunks(batches, "text"):
            words = split_words(*string_parts(b.column(1)))
            yield Tokens(b.column(0), *words.coded(), words.first)

    def emit(ids, first, number, counts):
        total = np.r_[0, np.cumsum(counts[number] if len(number) else np.zeros(0, np.int64))][first]
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first).astype(np.int64)), pa.array(np.diff(total))], names=["doc_id", "n_words", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return by_distinct_words(parts(batches), model.value.count, emit)

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
