"""Work once on each distinct word of a partition: documents wait as word numbers. Words are told apart by their bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np


@dataclass
class Tokens:
    """The words of some documents, one after another."""

    ids: Any  # of the documents
    codes: np.ndarray  # of each word, its number among
    names: list[bytes]  # the distinct words
    first: np.ndarray  # index of each document's first word, one more than documents


def by_distinct_words(parts: Iterator[Tokens], solve: Callable[[list[bytes]], Any], emit: Callable[[Any, np.ndarray, np.ndarray, Any], Any], most_words: int = 1 << 20, most_waiting: int = 24 << 20) -> Iterator[Any]:
    """emit(ids, first, numbers, solved) for each part, after solve(words) was called on all distinct words so far.

    Both limits bound memory only: beyond either, what waits is emitted and the vocabulary starts anew.
    """
    known: dict[bytes, int] = {}
    words: list[bytes] = []
    waiting: list[tuple[Any, np.ndarray, np.ndarray]] = []
    n = 0
    for part in parts:
        number = np.empty(len(part.names), np.int32)
        for i, w in enumerate(part.names):
            k = known.get(w)
            if k is None:
                k = known[w] = len(words)
                words.append(w)
            number[i] = k
        waiting.append((part.ids, part.first, number[part.codes]))
        n += len(part.codes)
        if n > most_waiting or len(words) > most_words:
            solved = solve(words)
            yield from (emit(*w, solved) for w in waiting)
            known, words, waiting, n = {}, [], [], 0
    if waiting:
        solved = solve(words)
        yield from (emit(*w, solved) for w in waiting)
