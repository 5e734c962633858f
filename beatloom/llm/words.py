"""Words and their hashes from many texts at once, on byte arrays.

Texts are joined into one byte array with a blank byte between them; class
tables turn it into spans; a span's 64-bit hash is a difference of prefix sums
of a polynomial in the byte positions.  Nothing depends on the block a text
falls into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

BLOCK_BYTES = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def table(chars: bytes, high: bool = False) -> np.ndarray:
    """Bool class table of bytes; ``high`` adds all bytes above 127."""
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars, dtype=np.uint8)] = True
    out[128:] = high
    return out


# Bytes [0-9a-z] and above 127, after lower-casing A-Z; and what is not blank.
ALNUM = table(b"0123456789abcdefghijklmnopqrstuvwxyz", high=True)
VISIBLE = ~table(b" \t\n\v\f\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block:
    """Some texts as one byte array: text i is ``data[starts[i]:ends[i]]``."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.n = len(texts)

    def lowered(self) -> np.ndarray:
        return LOWER[self.data]

    def hasher(self, data: np.ndarray) -> "Hasher":
        return Hasher(data)


class Hasher:
    """Hashes of any spans of one byte array."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _power_tables(len(data) + 1)
        self.prefix = np.empty(len(data) + 1, dtype=np.uint64)
        self.prefix[0] = 0
        np.cumsum(_BYTE_VALUE[data] * powers[: len(data)], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = (ends - starts).astype(np.uint64)
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + sizes)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.empty(len(inside) + 1, dtype=bool)
    edge[0], edge[-1] = inside[:1].any(), inside[-1:].any()
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def shingles(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and owners of all runs of ``size`` consecutive words of one owner."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, owner.dtype)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(_MULTIPLIER) + hashes[k : k + n]
    whole = owner[:n] == owner[size - 1 :]
    return mix(out[whole]), owner[:n][whole]


def blocks(texts: pd.Series, limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Consecutive slices of a column as UTF-8, each of about ``limit`` bytes.
    Null is empty."""
    held, size, start = [], 0, 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8") if isinstance(text, str) else b""
        held.append(data)
        size += len(data)
        if size >= limit:
            yield slice(start, i + 1), held
            held, size, start = [], 0, i + 1
    if held:
        yield slice(start, start + len(held)), held
