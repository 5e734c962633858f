"""Toxicity by a classifier chain of linear models.

The categories form a chain: ``toxic`` (the label), ``severe`` (toxic, and the
share of marked words is at least the middle of the toxic rows'), ``pervasive``
(toxic, and marked words in at least three quarters of the text's eight parts).
Terms are words and their beginnings, which carry over to forms not seen in
training; marked ones are those seen far more often in toxic rows; the given table has one label, so the later categories derive from it.

Model k sees the words of a text and the probabilities of categories before k.
It is trained with out-of-fold predictions of the earlier models, so that it
learns from probabilities as wrong as those it will meet.  The vocabulary and
the models are fitted on at most ``SAMPLE`` labelled rows of either kind; every
whole text is scored.

Null and empty texts have no words and get the models' intercepts.  Repeated
rows are scored each.  Without labelled rows of both kinds every probability
is the share of toxic rows (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatloom.llm import words
from beatloom.llm.store import hash_order, hash_sample, in_turns, stored

SAMPLE = 2_000      # labelled rows of each kind used in training, at most
VOCABULARY = 1_000  # terms kept, by the size of their z score
PREFIXES = (4, 5)   # bytes of the word beginnings that are terms too
FOLDS = 4
PARTS = 8
CATEGORIES = ("toxic", "severe", "pervasive")


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, owner and part (0..7 by byte position) of every term, by owner."""
    block = words.Block(texts)
    data = block.lowered()
    starts, ends = words.spans(words.ALNUM[data])
    of = np.repeat(np.arange(block.n), block.ends - block.starts + 1)
    owner = of[starts]
    size = np.maximum(block.ends - block.starts, 1)[owner]
    part = (starts - block.starts[owner]) * PARTS // size
    hasher = words.Hasher(data)
    made = [(hasher(starts, ends), owner, part)]
    for k in PREFIXES:
        long = ends - starts > k
        made.append((hasher(starts[long], starts[long] + k) ^ np.uint64(k), owner[long], part[long]))
    hashes, owner, part = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order], part[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    """Logistic regression on a dense matrix, with a ridge."""

    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 3.0, steps: int = 120) -> "Linear":
        """Accelerated gradient steps of size 1 / Lipschitz bound."""
        n, width = x.shape
        if not n or y.min() == y.max():
            share = min(max(float(y.mean()) if n else 0.0, 1e-3), 1 - 1e-3)
            return cls(np.zeros(width), float(np.log(share / (1 - share))))
        full = np.column_stack((x, np.ones(n))).astype(np.float32)
        v = np.ones(width + 1, dtype=np.float32)
        for _ in range(15):  # largest eigenvalue of full' full
            v = full.T @ (full @ v)
            v /= np.linalg.norm(v)
        rate = 1 / (0.3 * float(np.linalg.norm(full.T @ (full @ v))) + ridge)
        penalty = np.append(np.full(width, ridge), 0.0)
        w = previous = np.zeros(width + 1, dtype=np.float32)
        penalty, rate = penalty.astype(np.float32), np.float32(rate)
        for t in range(1, steps + 1):
            ahead = w + np.float32((t - 1) / (t + 2)) * (w - previous)
            step = full.T @ (sigmoid(full @ ahead) - y).astype(np.float32) + penalty * ahead
            previous, w = w, ahead - rate * step
        return cls(w[:-1].astype(float), float(w[-1]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weight + self.bias)


@dataclass
class Chain:
    vocabulary: np.ndarray  # sorted word hashes
    marked: np.ndarray      # which of them are marked
    models: list[Linear] = field(default_factory=list)

    def features(self, hashes: np.ndarray, owner: np.ndarray, part: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """Per text: log counts of vocabulary words, marked words, parts that
        hold one, words."""
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), dtype=bool)
        who, word = owner[known], at[known]
        counts = np.bincount(who * len(self.vocabulary) + word, minlength=n * len(self.vocabulary))
        counts = np.log1p(counts.reshape(n, -1).astype(np.float32))
        hit = self.marked[word]
        n_marked = np.bincount(who[hit], minlength=n)
        cells = np.zeros((n, PARTS), dtype=bool)
        cells[who[hit], part[known][hit]] = True
        return counts, n_marked, cells.sum(axis=1), np.bincount(owner, minlength=n)

    def inputs(self, counts: np.ndarray, n_marked: np.ndarray, parts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        share = n_marked / np.maximum(n_words, 1)
        return np.column_stack((counts, 10 * np.sqrt(share), parts / PARTS)).astype(np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """One column per category, each model seeing the columns before."""
        out = np.empty((len(x), 0))
        for model in self.models:
            out = np.column_stack((out, model(np.column_stack((x, out)))))
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and numbers of marked words."""
        hashes, owner, part = text_words(texts)
        made, step = [], 256
        edges = np.searchsorted(owner, np.arange(0, len(texts) + step, step))
        for k, low in enumerate(range(0, len(texts), step)):  # bounded dense rows
            rows = slice(edges[k], edges[k + 1])
            n = min(step, len(texts) - low)
            f = self.features(hashes[rows], owner[rows] - low, part[rows], n)
            made.append((self.probabilities(self.inputs(*f)), f[1]))
        return np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])


def prior(share: float) -> Chain:
    """The chain of a table whose training rows are all of one kind."""
    bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    return Chain(np.empty(0, np.uint64), np.empty(0, bool), [Linear(np.zeros(2 + k), bias) for k in range(len(CATEGORIES))])


def fit_models(x: np.ndarray, share: np.ndarray, parts: np.ndarray, toxic: np.ndarray) -> list[Linear]:
    """The chain's models, each after the out-of-fold predictions of those
    before it.  ``share``: marked terms a word; ``parts``: parts with one."""
    middle = np.median(share[toxic > 0])
    targets = (toxic > 0, (toxic > 0) & (share >= middle), (toxic > 0) & (parts >= PARTS * 3 // 4))
    fold = np.arange(len(x)) % FOLDS
    models, unseen = [], np.empty((len(x), 0), dtype=np.float32)
    for target in targets:
        y = target.astype(np.float32)
        given = np.column_stack((x, unseen))
        models.append(Linear.fit(given, y))
        column = np.empty(len(x), dtype=np.float32)
        for k in range(FOLDS):
            column[fold == k] = Linear.fit(given[fold != k], y[fold != k])(given[fold == k])
        unseen = np.column_stack((unseen, column))
    return models


def _terms(sample: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """Terms of at least five sampled texts with their z scores, and whether
    they are marked: the ``VOCABULARY`` largest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, texts in words.blocks(batch["text"]):
                hashes, owner, _ = text_words(texts)
                order = np.lexsort((owner, hashes))
                hashes, owner = hashes[order], owner[order]
                first = np.ones(len(order), dtype=bool)  # a text counts a term once
                first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                kinds, place = np.unique(hashes[first], return_inverse=True)
                bad = batch["_y"].iloc[rows].to_numpy()[owner[first]] > 0
                counts = (np.bincount(place[m], minlength=len(kinds)) for m in (bad, ~bad))
                yield pd.DataFrame({"term": kinds.view(np.int64), **dict(zip(("bad", "good"), counts))})

    seen = sample.mapInPandas(run, "term long, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    bad, good = (F.col("bad") + 0.5) / (n_bad + 1), (F.col("good") + 0.5) / (n_good + 1)
    z = F.log(bad / good) / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    marked = (z > 4) & (bad > 10 * good) & (F.col("bad") > 0.02 * n_bad)
    return seen.where("bad + good >= 5").select("term", marked.alias("marked"), z.alias("z")).orderBy(F.abs("z").desc(), "term").limit(VOCABULARY)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit on at most ``sample`` rows of either label in the order of a hash of
    their ids, every id once before repeated ones again.  The vocabulary is counted in the cluster; the driver sees its
    terms and one short feature row per sampled text."""
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("_y")).distinct()
    picked = [hash_sample(known.where(F.col("_y") == k), "doc_id", sample) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * sample ids
    joined = docs.select("doc_id", "text").join(chosen, "doc_id")
    turns = in_turns(joined, "doc_id", sample, "_y", F.md5(F.coalesce("text", F.lit(""))))
    place = F.row_number().over(Window.partitionBy("_y").orderBy("_turn", hash_order("doc_id"), "doc_id"))
    bounded = turns.withColumn("_place", place).where(F.col("_place") <= sample)
    rows = stored(bounded.drop("_turn", "_place"), "sample")  # cut only where ids repeat
    counts = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    n_bad, n_good = counts.get(1, 0), counts.get(0, 0)
    if not n_bad or not n_good:
        return prior(n_bad / max(n_bad + n_good, 1))
    terms = sorted((np.uint64(r["term"] & (2**64 - 1)), r["marked"]) for r in _terms(rows, n_bad, n_good).collect())
    chain = Chain(np.array([t for t, _ in terms], dtype=np.uint64), np.array([m for _, m in terms], dtype=bool))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, texts in words.blocks(batch["text"]):
                f = chain.features(*text_words(texts), len(texts))
                own = batch.iloc[part]
                yield pd.DataFrame({"doc_id": own["doc_id"], "y": own["_y"], "marked": f[1], "parts": f[2], "n_words": f[3],
                                    "x": pd.Series([r.tobytes() for r in chain.inputs(*f)], index=own.index, dtype=object)})

    made = rows.mapInPandas(run, "doc_id long, y int, marked long, parts long, n_words long, x binary").toPandas()
    made = made.sort_values(["doc_id", "y", "x"], kind="stable")
    x = np.frombuffer(b"".join(made["x"]), dtype=np.float32).reshape(len(made), -1)
    share = made["marked"].to_numpy() / np.maximum(made["n_words"].to_numpy(), 1)
    chain.models = fit_models(x, share, made["parts"].to_numpy(), made["y"].to_numpy())
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` and ``toxicity``: a struct of the categories' probabilities
    and the number of marked words."""
    fields = ", ".join(f"{c} double" for c in CATEGORIES)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = [chain.score(part) for _, part in words.blocks(texts)]
            p = np.concatenate([m[0] for m in made]) if made else np.empty((0, len(CATEGORIES)))
            marked = np.concatenate([m[1] for m in made]) if made else np.empty(0)
            yield pd.DataFrame(p, columns=list(CATEGORIES)).assign(n_marked=marked.astype("int64"))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return docs.withColumn("toxicity", F.pandas_udf(run, f"{fields}, n_marked long")(text))
