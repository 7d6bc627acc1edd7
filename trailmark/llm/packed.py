"""Tables of packed token ids, for text cut into units that a tokenizer never joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain, filterfalse

import numpy as np

#: Bytes that an entry takes besides its characters and ids: two objects and its place in the table.
ENTRY = 140
#: Bytes of each of the two generations of a table.
LIMIT = 12 << 20


class PackedTable:
    """unit -> its ids as bytes of the type ``kind``; ``encode`` gives the ids of many units at once.

    A worker process keeps one table for all its tasks and has each unit encoded when it is first
    met. When the entries reach ``limit`` bytes, they become the older generation and what was the
    older one is forgotten; units met again come back from there. So memory is bounded, and the
    bound changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[list[int]]], kind: str, limit: int = LIMIT):
        self.encode, self.kind, self.limit = encode, kind, limit
        self.rows: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, units: list[str]) -> None:
        ids = list(self.encode(units))
        ends = np.cumsum([len(x) for x in ids]) * np.dtype(self.kind).itemsize
        raw, at = np.array(list(chain.from_iterable(ids)), self.kind).tobytes(), 0
        for u, end in zip(units, ends.tolist(), strict=True):
            self.rows[u] = raw[at:end]
            at = end
        self.held += sum(map(len, units)) + len(raw) + ENTRY * len(units)

    def pack(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list of units."""
        if self.held > self.limit:
            self.older, self.rows, self.held = self.rows, {}, 0
        new: set[str] = set()
        for s in split:
            new.update(filterfalse(self.rows.__contains__, s))
        if self.older:
            again = new.intersection(self.older)
            self.rows.update((u, self.older[u]) for u in again)
            self.held += sum(len(u) + len(self.rows[u]) + ENTRY for u in again)
            new = new.difference(again)
        if new:
            self._learn(list(new))
        known = self.rows.__getitem__
        return [b"".join(map(known, s)) for s in split]
