"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut by the tokenizer's pattern.  The distinct pieces of a block of
documents are laid out as rows of byte ids, one matrix per length bucket.  In
every round each row merges its leftmost pair of minimum rank, the columns
right of it move up, finished rows leave the matrix and empty columns are cut.
A pair's rank comes from an open-addressing hash table over (left id, right
id), probed for all rows at once.  Decoding joins the bytes of the ids.

Results are those of the rank file, whatever the text: a null or empty text
has no ids; no special token is ever produced; pieces wider than ``WIDEST``
bytes merge one by one through a heap, which gives the same ids without a
quadratic matrix.  Other columns and repeated rows pass through unchanged.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
WIDEST = 1024          # bytes of the widest bucket
BLOCK_CHARS = 500_000  # characters split into pieces at once
CACHE_PIECES = 1 << 17   # encoded pieces a worker remembers
CELLS = 1 << 18          # entries of one matrix
MAX_VOCABULARY = 64 << 20  # bytes of a rank file that is sent to the tasks


class PairTable:
    """Hash table from id pairs to ranks; looked up by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(8, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        key = self._key(left, right)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several, the last stays
            won = self.keys[slot[todo]] == key[todo]
            self.values[slot[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair; ``NONE`` where there is none or an id is -1."""
        key = self._key(left, right)
        out = np.full(len(key), NONE, dtype=np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = key[todo]
        slot = self._slot(key)
        while len(todo):
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        lines = (line.split() for line in ranks.splitlines() if line)
        self.rank = {base64.b64decode(token): int(number) for token, number in lines}
        self.pattern = regex.compile(pattern)
        self.token = {number: token for token, number in self.rank.items()}
        self.cache: dict[str, bytes] = {}

    @cached_property
    def byte_id(self) -> np.ndarray:
        return np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)

    @cached_property
    def pairs(self) -> PairTable:
        """Every pair of ids whose bytes together are a token."""
        found = [
            (left, right, number)
            for t, number in self.rank.items() for k in range(1, len(t))
            if (left := self.rank.get(t[:k])) is not None and (right := self.rank.get(t[k:])) is not None
        ]
        return PairTable(*np.array(found or np.empty((0, 3)), dtype=np.int32).T)

    def _merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their final ids padded with -1), as rows finish."""
        n, width = ids.shape
        rows = np.arange(n)
        ranks = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, max(width - 1, 0))
        while len(rows):
            if ids.shape[1] < 2:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)  # the leftmost of equal minima
            best = ranks[np.arange(len(rows)), at]
            live = best != NONE
            if not live.all():
                yield rows[~live], ids[~live]
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    return
            k = np.arange(len(rows))
            ids[k, at] = best
            columns = np.arange(ids.shape[1] - 1)
            moved = columns + (columns > at[:, None])
            ids = np.take_along_axis(ids, moved, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(moved, ranks.shape[1] - 1), axis=1)[:, : ids.shape[1] - 1]
            used = int((ids >= 0).any(axis=0).sum())
            ids, ranks = ids[:, :used], ranks[:, : max(used - 1, 0)]
            if used < 2:
                continue
            for pair in (at - 1, at):  # the two pairs that hold the merged id
                ok = (pair >= 0) & (pair < used - 1)
                r, p = k[ok], pair[ok]
                ranks[r, p] = self.pairs(ids[r, p], ids[r, p + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one over-long piece: leftmost minimum from a heap."""
        ids = [self.rank[bytes([b])] for b in piece]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def pair(i: int) -> int | None:
            j = after[i]
            return None if j < 0 else self.rank.get(self.token[ids[i]] + self.token[ids[j]])

        heap = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or pair(i) != r:
                continue
            j = after[i]
            ids[i], gone[j], after[i] = r, 1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([x for x, out in zip(ids, gone) if not out], dtype=np.int32)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The int32 ids of every piece, as bytes."""
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: list[bytes] = [b""] * len(raw)
        for i, piece in enumerate(raw):  # a piece that is a token is that token
            if (whole := self.rank.get(piece)) is not None:
                out[i], sizes[i] = whole.to_bytes(4, "little"), 0
        top = 1
        while True:
            low = top // 2
            chosen = np.flatnonzero((sizes > low) & (sizes <= top))
            for start in range(0, len(chosen), max(1, CELLS // top)):
                part = chosen[start : start + max(1, CELLS // top)]
                block = np.frombuffer(b"".join(raw[i].ljust(top, b"\0") for i in part), dtype=np.uint8)
                ids = self.byte_id[block.reshape(len(part), top)]
                ids[np.arange(top) >= sizes[part, None]] = -1
                for rows, final in self._merge_rows(ids):
                    counts = (final >= 0).sum(axis=1)
                    flat = final[final >= 0].astype("<i4").tobytes()
                    ends = 4 * np.cumsum(counts)
                    for row, end, count in zip(part[rows].tolist(), ends.tolist(), (4 * counts).tolist()):
                        out[row] = flat[end - count : end]
            if top >= WIDEST:
                break
            top *= 2
        for i in np.flatnonzero(sizes > WIDEST):
            out[i] = self._merge_long(raw[i]).astype("<i4").tobytes()
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text."""
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new = list(set().union(*split).difference(self.cache))
        self.cache.update(zip(new, self.encode_pieces(new)))
        look = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(look, pieces)), dtype="<i4") for pieces in split]

    def encode_blocks(self, texts: pd.Series) -> list[np.ndarray]:
        """As ``encode``, a bounded number of characters at a time."""
        out, block, chars = [], [], 0
        for text in texts:
            text = text if isinstance(text, str) else ""
            block.append(text)
            chars += len(text)
            if chars >= BLOCK_CHARS:
                out += self.encode(block)
                block, chars = [], 0
        return out + self.encode(block)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(ranks, pattern)


class Tokenizer:
    """A rank file and its pattern, read on the driver and sent to the tasks."""

    def __init__(self, path: str, pattern: str):
        if (size := Path(path).stat().st_size) > MAX_VOCABULARY:
            raise ValueError(f"{path} has {size} bytes; at most {MAX_VOCABULARY} are sent to the tasks")
        self.ranks, self.pattern = Path(path).read_bytes(), pattern

    def codec(self) -> Codec:
        return codec(self.ranks, self.pattern)

    @contextmanager
    def working(self) -> Iterator[Codec]:
        """The worker's codec for one task; what it remembered goes after."""
        work = self.codec()
        try:
            yield work
        finally:
            work.cache.clear()

    def ids(self, text: Column | str) -> Column:
        """array<int> of a text column; no ids for null or empty."""
        own = self

        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            with own.working() as work:
                for texts in batches:
                    yield pd.Series(work.encode_blocks(texts), index=texts.index, dtype=object)

        encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(encode, "array<int>")(text)

    def round_trip(self, text: Column | str) -> Column:
        """struct<ids, decoded>: a text column encoded, and the ids decoded."""
        own = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            with own.working() as work:
                for texts in batches:
                    ids = work.encode_blocks(texts)
                    yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([work.decode(x) for x in ids], dtype=object)})

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, "ids array<int>, decoded binary")(text)

    def count(self, text: Column | str) -> Column:
        """Number of ids of a text column."""
        own = self

        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            with own.working() as work:
                for texts in batches:
                    yield pd.Series([len(x) for x in work.encode_blocks(texts)], index=texts.index, dtype="int64")

        count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(count, "long")(text)

    def bytes(self, ids: Column | str) -> Column:
        """binary: the bytes of an id column."""
        own = self

        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            work = own.codec()
            for rows in batches:
                yield pd.Series([b"" if x is None else work.decode(np.asarray(x)) for x in rows], index=rows.index, dtype=object)

        decode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(decode, "binary")(ids)


def encode(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "ids") -> DataFrame:
    return docs.withColumn(ids, tokenizer.ids(text))


def decode(encoded: DataFrame, tokenizer: Tokenizer, ids: str = "ids", out: str = "decoded") -> DataFrame:
    return encoded.withColumn(out, tokenizer.bytes(ids))
