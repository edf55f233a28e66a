"""Keccak-256 with its original padding, over Arrow batches: all rows of a batch are permuted together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_RATE = 136


def _round_constants() -> np.ndarray:
    """By the linear feedback register x^8 + x^6 + x^5 + x^4 + 1."""
    out, state = [], 1
    for _ in range(24):
        word = 0
        for j in range(7):
            if state & 1:
                word |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state >> 7 else 0)
        out.append(word)
    return np.array(out, np.uint64)


def _rotations() -> dict[tuple[int, int], int]:
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_CONSTANTS, _TURNS = _round_constants(), _rotations()


def _turned(lane: np.ndarray, n: int) -> np.ndarray:
    return lane if not n else (lane << np.uint64(n)) | (lane >> np.uint64(64 - n))


def _permute(a: np.ndarray) -> np.ndarray:
    """The permutation of 5 x 5 lanes, for all columns of the last axis."""
    for constant in _CONSTANTS:
        c = np.bitwise_xor.reduce(a, axis=1)
        a = a ^ (np.roll(c, 1, axis=0) ^ _turned(np.roll(c, -1, axis=0), 1))[:, None]
        b = np.empty_like(a)
        for (x, y), n in _TURNS.items():
            b[y, (2 * x + 3 * y) % 5] = _turned(a[x, y], n)
        a = b ^ (~np.roll(b, -1, axis=0) & np.roll(b, -2, axis=0))
        a[0, 0] ^= constant
    return a


def digests(messages: list[bytes]) -> list[str]:
    """The hexadecimal digest of each message."""
    out = [""] * len(messages)
    by_blocks: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        by_blocks.setdefault(len(m) // _RATE + 1, []).append(i)
    for blocks, which in by_blocks.items():
        padded = np.zeros((len(which), blocks * _RATE), np.uint8)
        for r, i in enumerate(which):
            padded[r, : len(messages[i])] = np.frombuffer(messages[i], np.uint8)
            padded[r, len(messages[i])] ^= 0x01
            padded[r, -1] ^= 0x80
        words = padded.view("<u8").reshape(len(which), blocks, _RATE // 8)
        state = np.zeros((5, 5, len(which)), np.uint64)
        for k in range(blocks):
            for w in range(_RATE // 8):
                state[w % 5, w // 5] ^= words[:, k, w]
            state = _permute(state)
        first = np.stack([state[w, 0] for w in range(4)], axis=1).astype("<u8")
        for r, i in enumerate(which):
            out[i] = first[r].tobytes().hex()
    return out


def _hashed(texts: pd.Series) -> pd.Series:
    return pd.Series(digests([t.encode() if t is not None else b"" for t in texts])).where(texts.notna().to_numpy(), None)


def keccak256(text: Column) -> Column:
    """The hexadecimal digest of a text's UTF-8 bytes; null of null."""
    return pandas_udf(_hashed, "string")(text)


def topic_for(signature: Column) -> Column:
    """The topic of an event's signature, such as Transfer(address,address,uint256)."""
    return F.concat(F.lit("0x"), keccak256(signature))


def _readable(digits: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.decode(F.unhex(digits), "UTF-8"), "\\x00", "")), F.lit(""))


def decode_symbol(raw: Column) -> Column:
    """What a token answers for its symbol: a string behind offset and length, or 32 padded bytes; null for anything else."""
    digits = F.when(F.startswith(raw, F.lit("0x")), F.substring(raw, 3, 1 << 20))
    number = lambda at: F.conv(F.ltrim(F.substring(digits, at, 64), F.lit("0")), 16, 10).try_cast("long")
    size = number(65)
    dynamic = (F.length(digits) >= 128) & (number(1) == 32) & size.between(1, 32)
    return F.when(dynamic, _readable(F.substring(digits, F.lit(129), (size * 2).cast("int")))).when(F.length(digits) == 64, _readable(digits))


def decode_decimals(raw: Column) -> Column:
    """A number from 0 to 36, else null."""
    digits = F.when(F.startswith(raw, F.lit("0x")) & (F.length(raw) > 2), F.ltrim(F.substring(raw, 3, 1 << 20), F.lit("0")))
    number = F.when(digits == "", 0).when(F.length(digits) <= 8, F.conv(digits, 16, 10).try_cast("int"))
    return F.when(number <= 36, number)
