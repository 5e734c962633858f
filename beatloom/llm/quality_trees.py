"""Quality classifier: histogram gradient-boosted trees over document
statistics.

Statistics come from whole texts, a block of bytes at a time, and are stored
once.  Trees are grown level by level from gradient histograms over quantile
bins, on at most ``SAMPLE`` labelled rows, and flattened into arrays of
feature, threshold and first child, so that a batch walks all trees in one
numpy step per level.

Null and empty texts have all statistics 0 and get a score like any other.
Rows repeated are scored each.  Rows without a label do not train.  Without
any training row of both kinds the score is the share of good rows, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.llm import words
from beatloom.llm.store import hash_order, hash_sample, in_turns

SAMPLE = 20_000  # labelled rows that a model is fitted on, at most

STATISTICS = (
    "log_bytes", "lower", "upper", "digit", "blank", "symbol", "bang", "punctuation", "high",
    "log_words", "word_mean", "word_std", "distinct_words", "repeated_next", "distinct_triples", "top_word",
    "caps_words", "marked_words", "stopped_words", "lines_per_word", "repeated_lines", "short_words", "bare_marks",
)
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
                             b" \t\n\v\f\r", b"#*$%&|<>@^~=_+\\/", b"!", b".,;:?'\"()-"), start=1):
    _CLASS[np.frombuffer(_chars, dtype=np.uint8)] = _k
_CLASS[128:] = 8


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    block = words.Block(texts)
    n, size = block.n, np.maximum(block.ends - block.starts, 1)
    kind = _CLASS[block.data]
    of = np.repeat(np.arange(n), block.ends - block.starts + 1)
    counts = np.bincount(of * 9 + kind, minlength=9 * n).reshape(n, 9).astype(float)
    counts[:, 4] -= 1  # the byte that joins texts
    starts, ends = words.spans(kind != 4)
    owner = of[starts]
    n_words = np.bincount(owner, minlength=n)
    per_word = np.maximum(n_words, 1)
    length = (ends - starts).astype(float)
    hasher = words.Hasher(block.data)
    hashes = hasher(starts, ends)

    def total(values: np.ndarray, who: np.ndarray) -> np.ndarray:
        return np.bincount(who, weights=values, minlength=n)

    def distinct(h: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes and most repeats of one, per text."""
        order = np.lexsort((h, who))
        h, who = h[order], who[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
        at = np.flatnonzero(first)
        most = np.zeros(n)
        np.maximum.at(most, who[at], np.diff(np.append(at, len(h))))
        return np.bincount(who[at], minlength=n), most

    kinds, most = distinct(hashes, owner)
    triples, who = words.shingles(hashes, owner, 3)
    n_triples = np.bincount(who, minlength=n)
    triple_kinds, _ = distinct(triples, who)
    mean = total(length, owner) / per_word
    inside = {k: np.concatenate(([0], np.cumsum(kind == k))) for k in (1, 2, 5, 6)}
    held = {k: c[ends] - c[starts] for k, c in inside.items()}
    last = block.data[ends - 1] if len(ends) else np.empty(0, np.uint8)
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    line_starts, line_ends = words.spans(block.data != 10)
    line_owner = of[line_starts]
    lines = np.bincount(line_owner, minlength=n)
    line_kinds, _ = distinct(hasher(line_starts, line_ends), line_owner)
    out = [
        np.log1p(block.ends - block.starts), *(counts[:, k] / size for k in (1, 2, 3, 4, 5, 6, 7, 8)),
        np.log1p(n_words), mean, np.sqrt(np.maximum(total(length**2, owner) / per_word - mean**2, 0)),
        kinds / per_word, total(same.astype(float), owner[1:]) / per_word, triple_kinds / np.maximum(n_triples, 1), most / per_word,
        total(((held[2] > 0) & (held[1] == 0)).astype(float), owner) / per_word,
        total(((held[5] > 0) | (held[6] > 0)).astype(float), owner) / per_word,
        total((last == ord(".")).astype(float), owner) / per_word,
        lines / per_word, (lines - line_kinds) / np.maximum(lines, 1),
        total((length <= 3).astype(float), owner) / per_word, total((held[5] == length).astype(float), owner) / per_word,
    ]
    return np.column_stack(out).astype(np.float32)


def with_statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """``docs`` and an array<float> of its texts' statistics."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = [row for _, part in words.blocks(texts) for row in statistics(part)]
            yield pd.Series(rows, index=texts.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(run, "array<float>")(text))


@dataclass(frozen=True)
class Forest:
    """Flat trees: node i goes to ``child[i]`` if its feature is at most its
    threshold, else to the node after that; leaves point to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            step = self.child[at] + (x[rows, self.feature[at]] > self.threshold[at])
            at = np.where(self.leaf[at], at, step)
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        least: float = 5.0, ridge: float = 1.0) -> Forest:
    """Boosted trees for labels 0 and 1 by the logistic loss."""
    empty = np.empty(0)
    none = (np.empty(0, np.int64), np.empty(0, np.int64), empty, np.empty(0, np.int64), np.empty(0, bool), empty)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Forest(float(np.log(share / (1 - share))), *none, depth)
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)])  # bin b: at most cut b
    base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(n, base)
    roots, feature, threshold, child, leaf, value = [], [], [], [], [], []

    def node() -> int:
        for column, v in ((feature, 0), (threshold, 0.0), (child, 0), (leaf, True), (value, 0.0)):
            column.append(v)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-12)
        level, where = [node()], np.zeros(n, dtype=np.int64)  # where: place in the level, or -1 in a leaf
        roots.append(level[0])
        for d in range(depth + 1):
            live = np.flatnonzero(where >= 0)
            k = len(level)
            g = np.bincount(where[live], weights=gradient[live], minlength=k)
            h = np.bincount(where[live], weights=hessian[live], minlength=k)
            for i, at in enumerate(level):
                value[at] = float(rate * g[i] / (h[i] + ridge))
            if d == depth or not len(live):
                break
            best = np.zeros(k)
            split = np.zeros((k, 2), dtype=np.int64)
            for f in range(width):
                nb = len(cuts[f]) + 1
                cell = where[live] * nb + binned[live, f]
                gl = np.bincount(cell, weights=gradient[live], minlength=k * nb).reshape(k, nb).cumsum(axis=1)[:, :-1]
                hl = np.bincount(cell, weights=hessian[live], minlength=k * nb).reshape(k, nb).cumsum(axis=1)[:, :-1]
                if not gl.shape[1]:
                    continue
                gr, hr = g[:, None] - gl, h[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g**2 / (h + ridge))[:, None]
                gain[(hl < least / 4) | (hr < least / 4)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(k), top] > best + 1e-9
                best[better] = gain[np.arange(k), top][better]
                split[better] = np.column_stack((np.full(k, f), top))[better]
            target, following = np.full((k, 2), -1, dtype=np.int64), []
            for i, at in enumerate(level):
                if best[i] > 0:
                    f, b = split[i]
                    left, right = node(), node()
                    feature[at], threshold[at], child[at], leaf[at] = int(f), float(cuts[f][b]), left, False
                    target[i] = len(following), len(following) + 1
                    following += [left, right]
            old = where[live]
            right_side = binned[live, split[old, 0]] > split[old, 1]
            moved = np.where(right_side, target[old, 1], target[old, 0])
            gone = live[moved < 0]
            score[gone] += np.array(value)[np.array(level)[where[gone]]]
            where[live] = moved
            level = following
            if not level:
                break
        rest = np.flatnonzero(where >= 0)
        if len(rest) and level:
            score[rest] += np.array(value)[np.array(level)[where[rest]]]
    return Forest(base, np.array(roots), np.array(feature), np.array(threshold), np.array(child), np.array(leaf),
                  np.array(value), depth)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(described: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled rows that are not held out, taken in
    the order of a hash of their ids, every id once before repeated ones again."""
    mark = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("_y")).distinct()
    mark = hash_sample(mark, "doc_id", sample, "_y")
    joined = in_turns(described.select("doc_id", "statistics").join(mark, "doc_id"), "doc_id", sample, "_y", F.col("statistics"))
    rows = joined.orderBy("_turn", hash_order("doc_id"), "doc_id", "_y").limit(sample).toPandas()
    if not len(rows):
        return fit(np.empty((0, len(STATISTICS))), np.empty(0))
    rows = rows.sort_values(["doc_id", "_y", "_turn"], kind="stable")
    return fit(np.stack(rows["statistics"].to_numpy()).astype(np.float32).astype(float), rows["_y"].to_numpy(dtype=float))


def score(described: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    """``described`` and the probability of label 1."""

    @F.pandas_udf("double")
    def walk(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype="float64")
        x = np.stack(rows.to_numpy()).astype(float)
        return pd.Series(np.concatenate([forest.probability(x[k : k + 2000]) for k in range(0, len(x), 2000)]))

    return described.withColumn(out, walk("statistics"))
