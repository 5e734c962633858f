"""Near-duplicate documents by DartMinHash.

A text is the weighted set of its runs of ``SHINGLE`` words (fewer words: one
run of all), weighted by their counts; similarity is weighted Jaccard.

* Sketch: every element owns a region of width 1 per unit of weight and of
  unbounded rank.  Darts fall into it as a Poisson process whose arrival
  ranks, weight coordinates and sketch coordinates are hashes of (element,
  unit, dart number).  A text throws the darts of rank below t / total weight,
  t = k ln k + 2 k, so the number of darts does not grow with its length;
  each of the k coordinates keeps its earliest dart, and texts with an empty
  coordinate double the rank.  Two texts agree in a coordinate with
  probability equal to their weighted Jaccard similarity.
* Banded join: ``BANDS`` bands of ``ROWS`` coordinates.  At similarity 0.8 a
  pair meets in a band with probability 1 - 3e-5.  Texts equal in all words
  are collapsed before.  Texts that share a band with another form loose
  groups (connected components over stars, never over all pairs).
* Check: a loose group's element sets meet in one task, once each; pairs that
  share a band and are not linked yet, directly or through others, are compared
  exactly.  Groups over ``CELL`` texts are dealt by band and pairs of blocks of
  at most ``CELL`` texts instead, which compares the same pairs.

Result: one row per input row with the class of texts linked at 0.8 or more.
Null text counts as empty; texts without words are equal if their bytes are.
A class is named by its least non-null doc_id.  Rows equal in id and text are
one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm import words
from beatloom.llm.components import components
from beatloom.llm.store import row_key, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
CELL = 1024
BLOCK = 1 << 18  # bytes of text sketched at once


def elements(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Sorted shingle hashes, their counts, their texts, and per text a
    16-byte fingerprint of its words (of its bytes if it has none)."""
    block = words.Block(texts)
    data = block.lowered()
    starts, ends = words.spans(words.ALNUM[data])
    owner = np.searchsorted(block.ends, starts, side="right")
    hashes = words.Hasher(data)(starts, ends)
    n_words = np.bincount(owner, minlength=block.n)
    first = np.concatenate(([0], np.cumsum(n_words)))
    prints = [
        hashlib.blake2b(b"w" + hashes[a:b].tobytes() if b > a else b"t" + t, digest_size=16).digest()
        for a, b, t in zip(first[:-1].tolist(), first[1:].tolist(), texts)
    ]
    found, who = words.shingles(hashes, owner, size)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    whole = [words.shingles(hashes[first[i] : first[i + 1]], np.zeros(n_words[i], np.int64), int(n_words[i]))[0] for i in short]
    found, who = np.concatenate([found, *whole]), np.concatenate([who, short])
    order = np.lexsort((found, who))
    found, who = found[order], who[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    return found[at], np.diff(np.append(at, len(found))), who[at], prints


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_minhash(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) sketches; rows of texts without weight are 0."""
    units = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(element)), units)
    layer = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    width = np.minimum(1.0, weight[of] - layer)
    seed = words.mix(element[of] + layer.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    who = owner[of]
    total = np.bincount(owner, weights=weight, minlength=n)
    best = np.full(n * k, np.inf)
    mark = np.zeros(n * k, dtype=np.uint64)
    limit = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    rank, dart = np.zeros(len(seed)), np.zeros(len(seed), dtype=np.uint64)  # last arrival and its number
    ahead = -np.log(_unit(words.mix(seed)))  # the next arrival
    todo = np.arange(len(seed))
    while len(todo):
        live = todo
        while len(live):  # all arrivals below the texts' limits
            live = live[ahead[live] < limit[who[live]]]
            rank[live] = ahead[live]
            h = words.mix(seed[live] ^ words.mix(dart[live] * np.uint64(2) + np.uint64(1)))
            hit = _unit(words.mix(h ^ np.uint64(0x5851F42D4C957F2D))) <= width[live]
            cell = who[live] * k + (h % np.uint64(k)).astype(np.int64)
            c, r, h2 = cell[hit], rank[live][hit], h[hit]
            np.minimum.at(best, c, r)
            first = best[c] == r
            mark[c[first]] = h2[first]
            dart[live] += np.uint64(1)
            ahead[live] = rank[live] - np.log(_unit(words.mix(seed[live] + dart[live] * np.uint64(0xD1342543DE82EF95))))
        open_text = np.isinf(best.reshape(n, k)).any(axis=1) & (total > 0)
        limit = np.where(open_text, limit * 2, limit)
        todo = todo[open_text[who[todo]]]
    return mark.reshape(n, k)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One signed 64-bit key per band."""
    parts = sketch.reshape(len(sketch), bands, -1)
    key = np.zeros(parts.shape[:2], dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(parts.shape[2]):
        key = words.mix(key * np.uint64(0xD1342543DE82EF95) + parts[:, :, r])
    return key.view(np.int64)


def _sketched(docs: DataFrame) -> DataFrame:
    """key, doc_id, fp, bands (none for a text without words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, texts in words.blocks(batch["text"], BLOCK):
                found, count, owner, prints = elements(texts)
                keys = band_keys(dart_minhash(found, count.astype(float), owner, len(texts), BANDS * ROWS))
                some = np.bincount(owner, minlength=len(texts)) > 0
                part = batch.iloc[rows]
                yield pd.DataFrame({
                    "key": part["key"], "doc_id": part["doc_id"], "fp": pd.Series(prints, index=part.index, dtype=object),
                    "bands": pd.Series([k if s else k[:0] for k, s in zip(keys, some)], index=part.index, dtype=object),
                })

    slim = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    return slim.mapInPandas(run, f"key string, doc_id {kind}, fp binary, bands array<bigint>")


def link(sets: list[np.ndarray], bands: list[np.ndarray], block: np.ndarray | None = None, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Links that join the texts of a cell: ``sets`` are sorted elements.

    Every text in turn is compared with those of other groups that share a
    band with it and have not had their turn; of texts in two blocks, only with
    those of the other block.  Best-connected first, then what it reached.
    """
    n = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    if n < 2 or not sizes.sum():
        return []
    joined, place = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))
    flat = np.concatenate(bands)
    order = np.argsort(flat, kind="stable")
    text = np.repeat(np.arange(n), [len(b) for b in bands])[order]
    edge = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) != 0)))
    groups = [g for g in np.split(text, edge[1:]) if len(g) > 1]
    of: list[list[int]] = [[] for _ in range(n)]
    for k, g in enumerate(groups):
        for i in g.tolist():
            of[i].append(k)
    degree = np.array([sum(len(groups[k]) for k in ks) for ks in of])
    group, done, links = np.arange(n), np.zeros(n, dtype=bool), []
    waiting = np.argsort(-degree, kind="stable").tolist()
    reached: list[int] = []
    while waiting or reached:
        i = reached.pop() if reached else waiting.pop(0)
        if done[i]:
            continue
        done[i] = True
        if not of[i]:
            continue
        mates = np.unique(np.concatenate([groups[k] for k in of[i]]))
        mates = mates[(group[mates] != group[i]) & ~done[mates]]
        if block is not None:
            mates = mates[block[mates] != block[i]]
        mates = mates[(np.minimum(sizes[mates], sizes[i]) >= threshold * np.maximum(sizes[mates], sizes[i]) - 1e-9)]
        if not len(mates):
            continue
        counts = sizes[mates]
        at = np.repeat(place[mates] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        near = np.searchsorted(sets[i], joined[at])
        near[near == sizes[i]] = 0
        same = np.add.reduceat((sets[i][near] == joined[at]).astype(np.int64), np.cumsum(counts) - counts)
        for j in mates[same >= threshold * (sizes[i] + counts - same) - 1e-9].tolist():
            if group[j] != group[i]:
                links.append((i, j))
                group[group == group[j]] = group[i]
            reached.append(j)
    return links


def unit_elements(found: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A counted set as sorted hashes, one per unit of weight, so that plain
    Jaccard of the units is weighted Jaccard of the counts."""
    layer = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(words.mix(np.repeat(found, count) + layer.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _verified(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints.  ``cells``: key, fp, bands, cell, block
    (null, or one of two blocks to be compared with each other)."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, texts in words.blocks(batch["text"], BLOCK):
                found, count, owner, _ = elements(texts)
                edge = np.searchsorted(owner, np.arange(len(texts) + 1))
                units = [unit_elements(found[a:b], count[a:b]).view(np.int64) for a, b in zip(edge[:-1], edge[1:])]
                part = batch.iloc[rows]
                yield part[["fp", "bands", "cells"]].assign(units=pd.Series(units, index=part.index, dtype=object))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["fp", "block"]).reset_index(drop=True)
        units = [np.asarray(u).view(np.uint64) for u in cell["units"]]
        # A text compared across blocks of one band needs that band alone.
        bands = [np.asarray(b) if pd.isna(x) else np.zeros(1, np.int64) for b, x in zip(cell["bands"], cell["block"])]
        block = None if cell["block"].isna().any() or cell["block"].nunique() < 2 else cell["block"].to_numpy()
        links = link(units, bands, block)
        fp = cell["fp"].tolist()
        return pd.DataFrame({"a": [fp[i] for i, _ in links], "b": [fp[j] for _, j in links]})

    # A text is fetched once however many cells it is compared in.
    wanted = cells.groupBy("key").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"),
                                      F.collect_list(F.struct("cell", "block")).alias("cells"))
    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    # Repeated rows share a key; one of them stands for all in the cells.
    rows = wanted.join(texts, "key").dropDuplicates(["key"]).select("fp", "bands", "cells", "text")
    spread = "array<struct<cell:string,block:int>>"
    made = rows.mapInPandas(sets, f"fp binary, bands array<bigint>, cells {spread}, units array<bigint>")
    dealt = made.select("fp", "bands", "units", F.explode("cells").alias("c")).select("fp", "bands", "units", "c.cell", "c.block")
    return dealt.groupBy("cell").applyInPandas(compare, "a binary, b binary")


def _cells(reps: DataFrame, shared: DataFrame, loose: DataFrame, limit: int) -> DataFrame:
    """Where each text of a loose group is compared: see the module's text.
    ``shared``: texts (fp) and the bands they share with n - 1 others."""
    sizes = loose.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = stored(loose.join(sizes, "root").select(F.col("node").alias("fp"), "root", "n"), "placed")
    own = reps.select("fp", "bands", F.col("rep.key").alias("key"))
    small = placed.where(F.col("n") <= limit).join(own, "fp").select(
        "key", "fp", "bands", F.concat(F.lit("g"), F.hex("root")).alias("cell"), F.lit(None).cast("int").alias("block"))
    if placed.where(F.col("n") > limit).isEmpty():
        return small
    dealt = shared.withColumn("s", F.ceil(F.col("n") / limit).cast("int")).drop("n").join(placed.where(F.col("n") > limit).select("fp"), "fp")
    mine = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    pairs = dealt.select("fp", "band", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other"))
    cell = F.concat_ws("-", F.lit("b"), "band", F.least("mine", "other"), F.greatest("mine", "other"))
    large = pairs.join(own, "fp").select("key", "fp", "bands", cell.alias("cell"), F.col("mine").alias("block"))
    return small.unionByName(large)


def classes(docs: DataFrame, limit: int = CELL) -> DataFrame:
    """key, doc_id, class_id, n_class, keep: one row per row of ``docs``."""
    sig = stored(_sketched(docs), "sketches")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    reps = stored(sig.groupBy("fp").agg(F.min(rank).alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")), "texts")
    buckets = reps.select("fp", F.explode("bands").alias("band"))
    leaders = buckets.groupBy("band").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(buckets.join(leaders, "band"), "shared")
    stars = shared.where(F.col("a") != F.col("fp")).select("a", F.col("fp").alias("b")).distinct()
    loose = stored(components(stars), "loose")
    links = stored(_verified(_cells(reps, shared, loose, limit), docs), "links")
    linked = stored(components(links), "linked")
    members = reps.join(linked, F.col("fp") == F.col("node")).select("fp", "root", "rep", "n")
    merged = members.groupBy("root").agg(F.min("rep").alias("class_rep"), F.sum("n").alias("n_class"))
    wide = members.select("fp", "root").join(merged, "root").select("fp", "class_rep", "n_class")
    named = reps.select("fp", "rep", "n").join(wide, "fp", "left").select(
        "fp", F.coalesce("class_rep", "rep").alias("rep"), F.coalesce("n_class", "n").alias("n_class"))
    return sig.select("key", "doc_id", "fp").join(named, "fp").select(
        "key", "doc_id", F.col("rep.doc_id").alias("class_id"), "n_class", (F.col("key") == F.col("rep.key")).alias("keep"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of every class, the one of least id; same columns."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)])
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    doc_id, text = F.col(place["doc_id"]), F.col(place["text"])
    found = stored(classes(own.select(doc_id.alias("doc_id"), text.alias("text"))).select("key", "keep"), "classes")
    states = found.groupBy("key").agg(F.first("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
    twice = stored(states.where("keep and n > 1").select(F.col("key").alias("_key")), "twice")
    leave = states.where("not keep or n > 1").select(F.col("key").alias("_key"))
    keyed = own.withColumn("_key", row_key(doc_id, text))
    kept = keyed.join(leave, "_key", "left_anti")
    if not twice.isEmpty():
        kept = kept.unionByName(keyed.join(twice, "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
