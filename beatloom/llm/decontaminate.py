"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents.  Its words become symbols of its own
vocabulary; words that no benchmark item holds (a bitmap of fixed size tells,
with some false alarms), and runs of others too short for any window, cannot
take part in a match and collapse into breakers.  Over the rest: suffix array
(prefix doubling; every breaker its own terminator), BWT, wavelet matrix with
packed bits, and suffix positions sampled at every eighth place and at run
starts.  All windows of a block are searched backwards at once; their rows are
located by walking to a sample, compared word by word with the window, and
merged into spans of hit words.

The benchmark never passes through the driver.  Spark writes its different
texts as pieces of ``PIECE`` windows, and the ids of each text apart from them;
executors fetch these files (``SparkContext.addFile``).  A Python worker packs
pieces into blocks of at most some ``BLOCK_WINDOWS`` windows and searches one
block after another in the index of the shard at hand; up to ``KEPT`` blocks
stay in memory, others are read again for every shard.  Ids are looked up for
the texts that a shard hits, by key ranges of the files' row groups.

A window is ``SIZE`` consecutive words of an item, or a shorter item as a
whole.  Items or texts that are null or have no words match nothing; repeated
items add themselves once; a null item_id hits words but is not listed; other
columns and repeated rows pass through.  The ids of one document are one array.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm import words
from beatloom.llm.store import fresh_folder

SIZE = 10
SHARD_BYTES = 4 << 20
PHRASE_BYTES = 1 << 20   # benchmark text in a block, at most, but for one piece
BLOCK_WINDOWS = 200_000
PIECE = 1000             # windows of a text in one row
KEPT = 8                 # blocks that a worker keeps
FILE_BYTES = 32 << 20
ITEMS_AT_ONCE = 500_000  # ids in a frame on its way out, but for one document's
SAMPLED = 8
BITMAP = 1 << 22
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(PATTERN.encode())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(len(bits) // 64 + 1, dtype="<u8")
        self.blocks.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.blocks) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.blocks), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        inside = self.blocks[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[i >> 6] + np.bitwise_count(inside)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.blocks[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Wavelet matrix of a symbol array."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros, self.bits = [], [], bits
        for k in range(bits - 1, -1, -1):
            bit = (symbols >> k) & 1 == 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros_like(i)
        for k, level, zeros in zip(range(self.bits - 1, -1, -1), self.levels, self.zeros):
            one = (symbol >> k) & 1 == 1
            a, b = level.ones(low), level.ones(i)
            low, i = np.where(one, zeros + a, low - a), np.where(one, zeros + b, i - b)
        return i - low

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level, zeros in zip(self.levels, self.zeros):
            one, before = level[i], level.ones(i)
            out = out * 2 + one
            i = np.where(one, zeros + before, i - before)
        return out


class FMIndex:
    """Of symbols 1.. in runs ended by the breaker 0; starts with a breaker."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        n = len(symbols)
        breaker = symbols == 0
        order = self._suffixes(symbols, breaker)
        before = symbols[order - 1]
        self.wavelet = Wavelet(before, max(1, int(n_symbols).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))))
        kept = (order % SAMPLED == 0) | (before == 0)
        self.sampled, self.samples, self.n = Bits(kept), order[kept], n

    @staticmethod
    def _suffixes(symbols: np.ndarray, breaker: np.ndarray) -> np.ndarray:
        n, k = len(symbols), 1
        n_breakers = int(breaker.sum())
        rank = symbols.astype(np.int64) + n_breakers
        rank[breaker] = np.arange(n_breakers)
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: n - k] = rank[k:] + 1
            key = rank * (max(n, int(rank.max())) + 2) + after
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            k *= 2

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and suffix row ranges of the windows that occur."""
        live = np.arange(len(windows))
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), self.n, dtype=np.int64)
        found = []
        for step in range(windows.shape[1]):
            done = sizes[live] == step
            found.append((live[done], low[done], high[done]))
            live, low, high = live[~done], low[~done], high[~done]
            symbol = windows[live, sizes[live] - 1 - step]
            low = self.first[symbol] + self.wavelet.rank(symbol, low)
            high = self.first[symbol] + self.wavelet.rank(symbol, high)
            kept = low < high
            live, low, high = live[kept], low[kept], high[kept]
        found.append((live, low, high))
        return tuple(np.concatenate(x) for x in zip(*found))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.empty(len(rows), dtype=np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            here = self.sampled[at]
            out[todo[here]] = self.samples[self.sampled.ones(at[here])] + steps
            todo, at = todo[~here], at[~here]
            symbol = self.wavelet[at]
            at = self.first[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out


@dataclass
class Phrases:
    """A block of benchmark pieces; a window is a place among their words."""

    data: bytes          # pieces, their words parted by blanks
    starts: np.ndarray   # bytes of each word
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray    # first word and number of words of each window
    sizes: np.ndarray
    piece: np.ndarray
    keys: list           # of each piece

    @classmethod
    def made(cls, pieces: list[tuple], size: int = SIZE) -> "Phrases":
        """Of (key, words parted by blanks)."""
        block = words.Block([p.encode("utf-8") if isinstance(p, str) else p for _, p in pieces])
        starts, ends = words.spans(words.ALNUM[block.data])
        owner = np.searchsorted(block.ends, starts, side="right")
        n = np.bincount(owner, minlength=block.n)
        n_windows = np.where(n > 0, np.maximum(1, n - size + 1), 0)
        of = np.repeat(np.arange(block.n), n_windows)
        first = np.arange(len(of)) + np.repeat(np.cumsum(n) - n - (np.cumsum(n_windows) - n_windows), n_windows)
        return cls(block.data.tobytes(), starts, ends, words.Hasher(block.data)(starts, ends),
                   first, np.minimum(n, size)[of], of, [k for k, _ in pieces])

    @classmethod
    def of(cls, rows: list[tuple]) -> "Phrases":
        """Of (key, text)."""
        return cls.made([(k, b" ".join(WORD.findall((t or "").encode("utf-8").translate(words.LOWER.tobytes())))) for k, t in rows])

    def hits(self, texts: list[bytes]) -> list[tuple[int, list, list]]:
        """Per text: words, spans, keys, by this block alone."""
        shard = Shard(texts, *vocabulary([self]))
        shard.search(self)
        return [(n, spans, sorted(k for k in keys if k is not None)) for n, spans, keys in shard.hits()]

    def words_of(self, window: int) -> bytes:
        at = self.first[window]
        return self.data[self.starts[at] : self.ends[at + self.sizes[window] - 1]]


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BITMAP - 1)).astype(np.int64)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Places of neighbouring words in a bitmap."""
    return _place(words.mix(hashes[:-1] * np.uint64(words._MULTIPLIER) + hashes[1:]))


def vocabulary(blocks: Iterable[Phrases]) -> tuple[np.ndarray, int]:
    """Bitmap of the words of all blocks, and the size of the least window (0
    where there is none)."""
    known, shortest = np.zeros(BITMAP, dtype=bool), 0
    for b in blocks:
        known[_place(b.hashes)] = True
        if len(b.sizes):
            shortest = min(shortest or SIZE, int(b.sizes.min()))
    return known, shortest


class Shard:
    """The index of some texts, and what the blocks searched so far hit."""

    def __init__(self, texts: list[bytes], known: np.ndarray, shortest: int):
        self.block = block = words.Block(texts)
        data = block.lowered()
        self.starts, self.ends = starts, ends = words.spans(words.ALNUM[data])
        self.owner = owner = np.searchsorted(block.ends, starts, side="right")
        self.n_words = np.bincount(owner, minlength=block.n)
        self.change = np.zeros(len(starts) + 1, dtype=np.int64)
        self.keys: list[set] = [set() for _ in texts]
        self.index = None
        if not shortest or not len(starts):
            return
        hashes = words.Hasher(data)(starts, ends)
        # A gap before each text's first word keeps runs within texts.
        places = np.arange(len(starts)) + owner
        spread = np.zeros(len(starts) + int(owner[-1]) + 1, dtype=bool)
        spread[places] = known[_place(hashes)]
        run_starts, run_ends = words.spans(spread)
        wide = run_ends - run_starts >= shortest
        run_starts, run_ends = run_starts[wide], run_ends[wide]
        if not len(run_starts):
            return
        sizes = run_ends - run_starts
        new = np.concatenate(([1], np.cumsum(sizes + 1) + 1))  # after a breaker each
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        word_at = np.searchsorted(places, np.repeat(run_starts, sizes) + inside)
        text_at = np.repeat(new[:-1], sizes) + inside
        self.raw, used = data.tobytes(), hashes[word_at]
        self.vocabulary, symbol = np.unique(used, return_inverse=True)
        self.back = np.full(new[-1], -1, dtype=np.int64)
        self.back[text_at] = word_at
        symbols = np.zeros(new[-1], dtype=np.int64)
        symbols[text_at] = symbol + 1
        self.pairs = np.zeros(BITMAP, dtype=bool)
        self.pairs[_pairs(used)] = True
        self.index = FMIndex(symbols, len(self.vocabulary))

    def search(self, phrases: Phrases) -> None:
        """Add the occurrences of a block's windows."""
        if self.index is None or not len(phrases.first):
            return
        at = np.searchsorted(self.vocabulary, phrases.hashes)
        at[at == len(self.vocabulary)] = 0
        # Windows with a word or a pair of words that the shard lacks need no search.
        lacks = np.concatenate(([0], np.cumsum(self.vocabulary[at] != phrases.hashes)))
        apart = np.concatenate(([0], np.cumsum(~self.pairs[_pairs(phrases.hashes)])))
        a, b = phrases.first, phrases.first + phrases.sizes
        live = np.flatnonzero((lacks[a] == lacks[b]) & (apart[a] == apart[b - 1]))
        if not len(live):
            return
        sizes = phrases.sizes[live]
        word = a[live][:, None] + np.arange(sizes.max())
        windows = at[np.minimum(word, len(at) - 1)] + 1
        found, low, high = self.index.search(windows, sizes)
        if not len(found):
            return
        counts = high - low
        rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        place, window = self.back[self.index.locate(rows)], np.repeat(live[found], counts)
        last = place + phrases.sizes[window] - 1
        wanted = {w: phrases.words_of(w) for w in np.unique(window).tolist()}
        same = np.fromiter((b" ".join(WORD.findall(self.raw[i:j])) == wanted[w] for i, j, w in
                            zip(self.starts[place].tolist(), self.ends[last].tolist(), window.tolist())), bool, len(place))
        place, window, last = place[same], window[same], last[same]
        np.add.at(self.change, place, 1)
        np.add.at(self.change, last + 1, -1)
        for of, piece in np.unique(np.column_stack((self.owner[place], phrases.piece[window])), axis=0).tolist():
            self.keys[of].add(phrases.keys[piece])

    def hits(self) -> list[tuple[int, list[tuple[int, int, int, int]], set]]:
        """Per text: words, spans (first and last word, start and end byte) of
        hit words, keys."""
        out = [(int(n), [], keys) for n, keys in zip(self.n_words, self.keys)]
        first_word = np.concatenate(([0], np.cumsum(self.n_words)))
        joined = np.zeros(len(self.starts) + self.block.n, dtype=bool)  # a gap after each text parts the runs
        joined[np.arange(len(self.starts)) + self.owner] = np.cumsum(self.change[:-1]) > 0
        for a, b in zip(*words.spans(joined)):
            of = int(np.searchsorted(first_word[1:] + np.arange(self.block.n), a, side="right"))
            a, b = a - of, b - of - 1
            base, byte = first_word[of], self.block.starts[of]
            out[of][1].append((int(a - base), int(b - base), int(self.starts[a] - byte), int(self.ends[b] - byte)))
        return out


class Benchmark:
    """The benchmark's files as a worker sees them."""

    def __init__(self, pieces: tuple[str, ...], ids: tuple[str, ...], block_bytes: int):
        self.pieces, self.ids, self.block_bytes = pieces, ids, block_bytes
        self.kept: list[Phrases] = []
        self.more = False  # blocks beyond the kept ones
        self.known, self.shortest = vocabulary(self._first_pass())

    def _first_pass(self) -> Iterator[Phrases]:
        for k, block in enumerate(self._read()):
            if k < KEPT:
                self.kept.append(block)
            self.more = k >= KEPT
            yield block

    def _read(self, skip: int = 0) -> Iterator[Phrases]:
        """Blocks but for the first ``skip``, in the order of the files."""
        held, size, windows, k = [], 0, 0, 0
        for name in self.pieces:
            with pq.ParquetFile(SparkFiles.get(name)) as file:
                for batch in file.iter_batches(batch_size=256, columns=["key", "piece", "n"]):
                    for key, piece, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                        held.append((key, piece))
                        size, windows = size + len(piece), windows + n
                        if size >= self.block_bytes or windows >= BLOCK_WINDOWS:
                            if k >= skip:
                                yield Phrases.made(held)
                            held, size, windows, k = [], 0, 0, k + 1
        if held and k >= skip:
            yield Phrases.made(held)

    def blocks(self) -> Iterator[Phrases]:
        yield from self.kept
        if self.more:
            yield from self._read(len(self.kept))

    def ids_of(self, keys: set[str]) -> dict[str, list]:
        wanted, out = sorted(keys), {}
        if not wanted:
            return out
        values = pa.array(wanted, pa.string())
        for name in self.ids:
            with pq.ParquetFile(SparkFiles.get(name)) as file:
                near = []
                for g in range(file.metadata.num_row_groups):
                    range_ = file.metadata.row_group(g).column(0).statistics
                    at = bisect_left(wanted, range_.min) if range_ and range_.has_min_max else 0
                    if at < len(wanted) and (not range_ or not range_.has_min_max or wanted[at] <= range_.max):
                        near.append(g)
                for batch in file.iter_batches(row_groups=near, columns=["key", "item"]) if near else ():
                    batch = batch.filter(pc.is_in(batch.column(0), value_set=values))
                    for key, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        out.setdefault(key, []).append(item)
        return out

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, list, list]]:
        """Per text: words, spans, ids."""
        shard = Shard(texts, self.known, self.shortest)
        if shard.index is not None:
            for block in self.blocks():
                shard.search(block)
        ids = self.ids_of(set().union(*shard.keys)) if self.ids else {}
        joined: dict[frozenset, list] = {}  # texts that hit the same share one list
        for n, spans, keys in shard.hits():
            own = frozenset(k for k in keys if k in ids)
            if own not in joined:
                joined[own] = sorted({i for k in own for i in ids[k]})
            yield n, spans, joined[own]


_opened: dict[tuple, Benchmark] = {}


def _benchmark(*files) -> Benchmark:
    """The worker's benchmark; another takes its place."""
    if files not in _opened:
        _opened.clear()
        _opened[files] = Benchmark(*files)
    return _opened[files]


def _sent(df: DataFrame, label: str) -> tuple[str, ...]:
    """Write ``df`` in the shared folder, have every executor fetch its files,
    and return their names."""
    path = fresh_folder(df.sparkSession, label)
    df.write.option("parquet.block.size", 4 << 20).parquet(path)
    files = sorted(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())
    for f in files:
        df.sparkSession.sparkContext.addFile(unquote(f))
    return tuple(os.path.basename(unquote(f)) for f in files)


def _send(benchmark: DataFrame, item: str, text: str, list_items: bool) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Names of the files of pieces (key, piece, n windows) and ids (key, item)."""
    rows = benchmark.select(F.md5(text).alias("key"), F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = 1 + int(size) // FILE_BYTES
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(PATTERN), F.lit(0))
    texts = rows.select("key", "text").dropDuplicates(["key"]).select("key", found.alias("w")).where(F.size("w") > 0)
    windows = F.greatest(F.size("w") - (SIZE - 1), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), windows - 1, F.lit(PIECE)), lambda i: F.struct(
        F.array_join(F.slice("w", i + 1, F.lit(PIECE + SIZE - 1)), " ").alias("piece"), F.least(windows - i, F.lit(PIECE)).alias("n")))
    pieces = texts.select("key", F.explode(cut).alias("p")).select("key", "p.piece", "p.n")
    ids = rows.where("item is not null").select("key", "item").distinct()
    return _sent(pieces.coalesce(n_files), "phrases"), \
        _sent(ids.coalesce(n_files).sortWithinPartitions("key"), "ids") if list_items else ()


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         out: str = "hits", list_items: bool = True) -> DataFrame:
    """``docs`` and ``out``: n_words, n_hit, spans of hit words, items (empty
    without ``list_items``).  One pass over ``docs``, which are not shuffled."""
    kind = benchmark.schema[item].dataType.simpleString()
    span = "array<struct<first:int,last:int,start:int,end:int>>"
    files = (*_send(benchmark, item, item_text, list_items), PHRASE_BYTES)

    def frame(made: list) -> pd.DataFrame:
        return pd.DataFrame({
            "n_words": pd.Series([r[0] for r in made], dtype="int64"),
            "spans": pd.Series([[dict(zip(("first", "last", "start", "end"), s)) for s in r[1]] for r in made], dtype=object),
            "items": pd.Series([r[2] for r in made], dtype=object),
        })

    def frames(texts: list[bytes]) -> Iterator[pd.DataFrame]:
        made, n = [], 0
        for row in _benchmark(*files).search(texts):
            made.append(row)
            n += len(row[2])
            if n >= ITEMS_AT_ONCE:
                yield frame(made)
                made, n = [], 0
        if made:
            yield frame(made)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for texts in batches:
            for _, part in words.blocks(texts, SHARD_BYTES):
                held.extend(part)
                size += sum(map(len, part))
                if size >= SHARD_BYTES:
                    yield from frames(held)
                    held, size = [], 0
        if held:
            yield from frames(held)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    search = F.pandas_udf(run, f"n_words long, spans {span}, items array<{kind}>")
    df = docs.select("*", search(text).alias("_hits"))
    n_hit = F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"] + 1)
    made = F.struct(F.col("_hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("_hits.spans").alias("spans"),
                    F.col("_hits.items").alias("items"))
    return df.select(*[df[f"`{c}`"] for c in docs.columns], made.alias(out))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without their hit spans; same columns, n_chars renewed."""
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in place.items()])
    old = F.col(place["text"])
    data = F.encode(F.coalesce(old, F.lit("")), "UTF-8")
    found = find(own, benchmark, text=place["text"], list_items=False)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<binary>").alias("parts"))
    cut = F.aggregate(
        "hits.spans", start,
        lambda acc, s: F.struct((s["end"] + 1).alias("at"),
                                F.concat(acc["parts"], F.array(F.substring(data, acc["at"], s["start"] + 1 - acc["at"]))).alias("parts")),
        lambda acc: F.concat(F.array_join(F.transform(acc["parts"], lambda p: F.decode(p, "UTF-8")), ""),
                             F.decode(F.substring(data, acc["at"], F.lit(2**31 - 1)), "UTF-8")),
    )
    changed = {"text": F.when(F.col("hits.n_hit") > 0, cut).otherwise(old)}
    if "n_chars" in place:
        n_chars = F.col(place["n_chars"])
        changed["n_chars"] = F.when(F.col("hits.n_hit") > 0, F.char_length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(n_chars)
    return found.select(*[changed.get(c, F.col(p)).alias(c) for c, p in place.items()])
