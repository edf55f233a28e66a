"""Word scanning over Arrow text columns, vectorised with numpy on the UTF-8 bytes.

Words are maximal runs of bytes that are not separators. Every separator set used
here holds ASCII bytes only, so a scan over bytes finds the same words as a scan
over code points. Null texts count as empty.

Batches are cut into chunks of whole documents of about ``CHUNK_BYTES`` so that the
working arrays stay small whatever the batch size; a single longer document is a
chunk of its own, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything in ASCII but 0-9, A-Z and a-z; bytes of other code points are letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x41] = NOT_ALNUM[0x5B:0x61] = NOT_ALNUM[0x7B:0x80] = True

#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_U = np.uint64
_MIX1, _MIX2, _SEED = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_ROLL = _U(0xD1342543DE82EF95)
_ROLL_INV = _U(pow(int(_ROLL), -1, 1 << 64))
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(raw: np.ndarray, offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, offsets) of whole documents, about ``most`` bytes each."""
    n, at = len(offs) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


@dataclass
class Words:
    """Words of some documents: byte bounds, and of each document the index of its first word."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, eight bytes at a step."""
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) * _SEED + _U(1))
        padded = np.zeros(len(self.raw) + 8, np.uint8)
        padded[: len(self.raw)] = self.raw
        eight = np.ndarray((len(self.raw) + 1,), "<u8", padded.data, 0, (1,))
        live, at, left = None, self.starts, size
        while len(at):
            word = eight[at] & _KEEP[np.minimum(left, 8)]
            if live is None:
                out = mix(out ^ word)
                live = np.flatnonzero(left > 8)
                at, left = at[live] + 8, left[live] - 8
            else:
                out[live] = mix((out[live] + _SEED) ^ word)
                more = left > 8
                live, at, left = live[more], at[more] + 8, left[more] - 8
        return out

    def text(self, a: int, b: int) -> bytes:
        """Words a to b, one space between each."""
        return b" ".join(self.raw[self.starts[a] : self.ends[b - 1]].tobytes().split()) if b > a else b""


def scan(raw: np.ndarray, offs: np.ndarray, separators: np.ndarray = WHITE) -> Words:
    """All words of the documents at ``offs`` in ``raw``."""
    inside = ~separators[raw]
    change = np.empty(len(raw) + 1, bool)
    change[0] = change[-1] = False
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    bounds = offs[(offs > 0) & (offs < len(raw))]
    begin, end = change.copy(), change
    begin[:-1] &= inside
    begin[-1] = False
    end[1:] &= inside
    end[0] = False
    if len(raw):
        begin[0] = inside[0]
        end[-1] = inside[-1]
    begin[bounds] = inside[bounds]
    end[bounds] = inside[bounds - 1]
    starts = np.flatnonzero(begin)
    return Words(raw, starts, np.flatnonzero(end), np.searchsorted(starts, offs))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rolling base to the powers 0 to n - 1, and the inverses; grown as needed."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for key, base in (("up", _ROLL), ("down", _ROLL_INV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hashes of any run of consecutive values in O(1) each, after one pass."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of values a to b; runs of the same values hash alike wherever they are."""
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * _SEED)

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.multiply(_U(size), _SEED, dtype=np.uint64))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Word indexes at which a window of ``size`` words lies within one document."""
    n = int(first[-1])
    ok = np.ones(n + 1, bool)
    counts = np.diff(first)
    for back in range(1, size):
        at = first[1:][counts >= back] - back
        ok[at] = False
    return np.flatnonzero(ok[:n])


def covered(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of n positions lie in a run a to b."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, a, 1)
    np.add.at(step, b, -1)
    return np.cumsum(step[:n]) > 0
