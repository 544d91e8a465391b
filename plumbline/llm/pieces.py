"""A cache from pre-tokens to their tokens, so that a batch's distinct pre-tokens are encoded once.

Byte-pair and unigram models encode pre-tokens independently of each other; a text's tokens are those of its
pre-tokens in order, whatever batch they came in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np


class _Numbers(dict):
    """Numbers keys as they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def slices(pieces: list[str], size: int = 2048) -> Iterator[list[str]]:
    """Runs of pieces, so that a library's rich results of one run are dropped before the next is encoded."""
    for at in range(0, len(pieces), size):
        yield pieces[at : at + size]


class PieceCache:
    """encode: takes distinct pre-tokens and returns for each a list of integers, in one or more parallel columns; if
    joined, how many each has and the columns with all of them in order.

    limit: pre-tokens held at most; beyond it the cache starts anew before the next batch, which changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[np.ndarray]]], columns: int = 1, limit: int = 200_000, joined: bool = False):
        self.encode, self.columns, self.limit, self.joined = encode, columns, limit, joined
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.begins = np.zeros(1, np.int64)
        self.flat = [np.zeros(0, np.int32) for _ in range(self.columns)]

    def look_up(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(tokens of each pre-token, pre-token of each token, the columns of each token)."""
        if len(self.numbers) > self.limit:
            self._clear()
        known = len(self.numbers)
        index = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        if len(self.numbers) > known:
            new = list(self.numbers)[known:] if known else list(self.numbers)
            if self.joined:
                counts, encoded = self.encode(new)
            else:
                lists = self.encode(new)
                counts = np.fromiter(map(len, lists[0]), np.int64, len(new))
                encoded = [np.fromiter(chain.from_iterable(more), np.int32, int(counts.sum())) for more in lists]
            self.begins = np.concatenate((self.begins, self.begins[-1] + np.cumsum(counts)))
            self.flat = [np.concatenate((old, more)) for old, more in zip(self.flat, encoded, strict=True)]
        begin = self.begins[index]
        counts = self.begins[index + 1] - begin
        of = np.repeat(np.arange(len(pieces)), counts)
        at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + begin[of]
        return counts, of, [x[at] for x in self.flat]
