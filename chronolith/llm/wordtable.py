"""A worker's table of words and their token ids, as arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .wordscan import Words

#: Bytes of a worker's table, some 30 for each word; twice that while it is merged. It is emptied when full.
TABLE_BYTES = 96 << 20
#: New words are kept apart until they are this part of the table, but for so many at least.
PART, LEAST = 8, 4096


class Slots:
    """Numbers of 64-bit hashes: a large sorted array and a small one of what came since, merged when that is an eighth of it."""

    def __init__(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int32)
        for known, slot in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                out = np.where(known[at] == hashes, slot[at], out)
        return out

    def add(self, hashes: np.ndarray, first: int) -> None:
        """Numbers sorted hashes that are not known from ``first`` on."""
        large, small = self.levels
        small = self._merged(small, (hashes, np.arange(first, first + len(hashes), dtype=np.int32)))
        if len(small[0]) > max(LEAST, len(large[0]) // PART):
            large, small = self._merged(large, small), (small[0][:0], small[1][:0])
        self.levels = [large, small]

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for level in self.levels for x in level)


class Growing:
    """An array that is appended to, with room to spare."""

    def __init__(self, dtype: type):
        self.held, self.n = np.zeros(1024, dtype), 0

    def append(self, more: np.ndarray) -> None:
        if more.dtype.itemsize > self.held.dtype.itemsize:
            self.held = self.held.astype(more.dtype)
        if self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(len(more) + self.n // 2, self.held.dtype)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


class WordIds:
    """Ids of words, which ``learn`` finds for those that the table lacks, as little-endian 32-bit numbers.

    The ids of known words lie end to end, by slots of the words' 64-bit hashes.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]]):
        self.learn = learn
        self._empty()

    def _empty(self) -> None:
        self.slots, self.begin, self.flat = Slots(), Growing(np.int64), Growing(np.uint16)  # where each slot's ids begin, and the ids
        self.begin.append(np.zeros(1, np.int64))

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of the documents' words, and where each document's begin and end."""
        hashes, first, each = np.unique(w.hashes(), return_index=True, return_inverse=True)
        slot = self._slots(w, hashes, first)[each]
        begin = self.begin.held[slot]
        size = self.begin.held[slot + 1] - begin
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat.held[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)]
        return ids, ends[w.first]

    def _slots(self, w: Words, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The slots of words by their sorted hashes; ``first``: where each word is first. Words without one get it."""
        if self.slots.nbytes + self.begin.held.nbytes + self.flat.held.nbytes > TABLE_BYTES:
            self._empty()
        slot = self.slots.find(hashes)
        lacking = slot < 0
        if lacking.any():
            view, starts, ends = memoryview(w.raw), w.starts[first[lacking]].tolist(), w.ends[first[lacking]].tolist()
            blobs = self.learn([bytes(view[a:b]) for a, b in zip(starts, ends, strict=True)])
            ids = np.frombuffer(b"".join(blobs), "<u4")
            new = self.begin.n - 1
            self.flat.append(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids)
            self.begin.append(self.begin.held[new] + np.cumsum([len(x) // 4 for x in blobs], dtype=np.int64))
            self.slots.add(hashes[lacking], new)
            slot[lacking] = np.arange(new, new + len(blobs), dtype=np.int32)
        return slot
