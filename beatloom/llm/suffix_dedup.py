"""Removal of repeated 100-byte strings with suffix arrays by linear grouping.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier
(documents ordered by id, nulls last, then by a hash of the row) goes.

1. Anchors: 50-grams whose hash is the least of a window of 51 positions.
   Each 100-byte string holds the least 50-gram of its own window, so all its
   occurrences meet at an equal anchor, at an equal offset.
2. Anchors travel with a hash of their context (50 bytes on both sides), packed
   by partition of the anchor.  Of equal contexts the earliest is the owner,
   the others are repeated whole.  Anchors with several contexts are open.
3. The owners' contexts of open anchors are cut into blocks of 25 bytes,
   aligned to the anchor, and a suffix array is built over the blocks of a
   shard of anchors (``suffix_array``).  Suffixes that share three blocks are
   equal 100-byte strings at aligned offsets; those that share two share all
   but 25 bytes of the strings in between, which then are compared by them.
4. All starts found are joined back to the texts.

Anchors of over ``Sizes.hot`` open contexts leave the shards: their strings are
grouped one by one by Spark, with partial minima.

Null text is empty; rows equal in id and text are one document, so they get
the same result; texts under 100 bytes lose nothing; matches never cross rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatloom.llm import words
from beatloom.llm.store import row_key, stored
from beatloom.session import planned_bytes

LENGTH, GRAM, BLOCK = 100, 50, 25
REACH = LENGTH - GRAM  # bytes of context on either side of an anchor


@dataclass(frozen=True)
class Sizes:
    """How the work is cut; results do not depend on it."""

    pack: int = 12 << 20   # bytes of text a task packs at once
    part: int = 16 << 20   # stored input per anchor partition
    shard: int = 10_000    # contexts of one suffix array, about
    hot: int = 20_000      # open contexts from which an anchor leaves its shard


# -- the suffix array ---------------------------------------------------------

def suffix_array(text: list[int]) -> list[int]:
    """Suffix array in two sweeps, without renaming.

    Groups hold suffixes of equal known prefix, at first one symbol.  Sweep 1
    takes the groups from the highest down.  A group's prefix is then its
    suffixes' longest Lyndon prefix; each suffix i points to its previous
    smaller suffix p, the nearest before it in a lower group, whose prefix it
    prolongs: p moves to the upper end of its group, by how often it was
    prolonged.  Sweep 2 reads the order from the least suffix up: the suffixes
    whose next smaller suffix is i are i - 1 and its chain of pointers, and
    each takes the next place of its group.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, end = [0] * n, [0] * n, [0] * (n + 1)
    start = 0
    for r, i in enumerate(order):
        if r and text[i] != text[order[r - 1]]:
            end[start] = r
            start = r
        place[i], group[i] = r, start
    end[start] = n
    smaller = [-1] * n
    high = n
    while high:
        low = group[order[high - 1]]
        prolonged: dict[int, int] = {}
        for i in sorted(order[low:high]) if high - low > 1 else order[low:high]:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                prolonged[p] = prolonged.get(p, 0) + 1
        if prolonged:
            by_times: dict[int, list[int]] = {}
            for p, times in prolonged.items():
                by_times.setdefault(times, []).append(p)
            for times in sorted(by_times, reverse=True):
                ends: dict[int, int] = {}
                for p in by_times[times]:
                    g = group[p]
                    ends.setdefault(g, end[g])
                    end[g] = at = end[g] - 1
                    other, here = order[at], place[p]
                    order[here], place[other] = other, here
                    order[at], place[p] = p, at
                fresh = {g: end[g] for g in ends}
                for p in by_times[times]:
                    group[p] = fresh[group[p]]
                for g, upper in ends.items():
                    end[fresh[g]] = upper
        high = low
    free = list(range(n))  # next free place of the group that starts there
    out, placed = [-1] * n, bytearray(n)
    for r in range(-1, n):
        j = (out[r] if r >= 0 else n) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out


# -- anchors ------------------------------------------------------------------

def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Extreme of every window of ``width`` values."""
    size = 1
    while size * 2 <= width:
        values = pick(values[: len(values) - size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, context hash, text and byte position of all anchors."""
    block = words.Block(texts)
    data, n = block.data, len(block.data) - GRAM + 1
    none = tuple(np.empty(0, d) for d in (np.uint64, np.uint64, np.int64, np.int64))
    if len(data) < LENGTH:
        return none
    hasher = words.Hasher(data)
    at = np.arange(n)
    gram = hasher(at, at + GRAM) | np.uint64(1)  # never 0
    least = _sliding(gram, REACH + 1, np.minimum)
    size = block.ends - block.starts
    inside = np.zeros(len(data) + 1, dtype=np.int64)  # windows within one text
    long = size >= LENGTH
    np.add.at(inside, block.starts[long], 1)
    np.add.at(inside, block.ends[long] - LENGTH + 1, -1)
    least = np.where(np.cumsum(inside)[: len(least)] > 0, least, np.uint64(0))
    edge = np.zeros(REACH, dtype=np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), REACH + 1, np.maximum)[:n] == gram)
    of = np.searchsorted(block.ends, chosen, side="right")
    left, right = np.maximum(chosen - REACH, block.starts[of]), np.minimum(chosen + LENGTH, block.ends[of])
    context = words.mix(hasher(left, right) + (chosen - left).astype(np.uint64))
    return gram[chosen], context, of, chosen - block.starts[of]


DOC = np.dtype([("null", "u1"), ("id", "<i8"), ("key", "<u8"), ("n", "<u4")])
PACK = "pid int, kind int, docs binary, gram binary, context binary, pos binary"


def _pack(pid: int, kind: int, docs: np.ndarray, of: np.ndarray, gram: np.ndarray, context: np.ndarray, pos: np.ndarray) -> dict:
    """Records sorted by document, with one entry for each document."""
    used, counts = np.unique(of, return_counts=True)
    table = docs[used].copy()
    table["n"] = counts
    return {"pid": pid, "kind": kind, "docs": table.tobytes(), "gram": gram.tobytes(), "context": context.tobytes(),
            "pos": pos.astype("<u4").tobytes()}


def _flushed(rows: list[tuple], parts: int) -> Iterator[dict]:
    """Packs of some documents (null, id, key, bytes): kind 0 anchors by
    partition, kind 1 contexts that repeat an earlier one of these documents.
    Rows of one name are one document."""
    rows = sorted({r[:3]: r for r in rows}.values(), key=lambda r: r[:3])
    docs = np.array([(*r[:3], 0) for r in rows], dtype=DOC)
    made, first = [], 0
    for part, texts in words.blocks(pd.Series([r[3] for r in rows], dtype=object)):
        gram, context, of, pos = anchors(texts)
        made.append((gram, context, of + first, pos))
        first += len(texts)
    gram, context, of, pos = (np.concatenate(x) for x in zip(*made))
    both = words.mix(gram * np.uint64(0x9E3779B97F4A7C15) + context)
    order = np.argsort(both, kind="stable")
    again = np.zeros(len(order), dtype=bool)
    a, b = order[:-1], order[1:]
    again[b] = (gram[a] == gram[b]) & (context[a] == context[b])
    pid = (words.mix(gram) % np.uint64(parts)).astype(np.int64)
    single = np.flatnonzero(~again)
    single = single[np.argsort(pid[single], kind="stable")]
    for at in np.split(single, np.flatnonzero(np.diff(pid[single])) + 1):
        if len(at):
            yield _pack(int(pid[at[0]]), 0, docs, of[at], gram[at], context[at], pos[at])
    at = np.flatnonzero(again)
    if len(at):
        yield _pack(int(of[at[0]]) % parts, 1, docs, of[at], gram[:0], context[:0], pos[at])


def _packed(docs: DataFrame, parts: int, limit: int) -> DataFrame:
    """Packs of all documents of 100 bytes and more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for doc_id, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
                if text is None or len(text) < LENGTH // 4:
                    continue
                data = text.encode("utf-8")
                if len(data) < LENGTH:
                    continue
                missing = pd.isna(doc_id)
                held.append((int(missing), 0 if missing else int(doc_id), int(key), text))
                size += len(data)
                if size >= limit:
                    yield from (pd.DataFrame([p]) for p in _flushed(held, parts))
                    held, size = [], 0
        if held:
            yield from (pd.DataFrame([p]) for p in _flushed(held, parts))

    return docs.mapInPandas(run, PACK)


MARK = "null int, doc_id long, key long, whole array<int>, want array<struct<pos:int,gram:long,hot:boolean>>"


def _marks(group: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Of one anchor partition: repeated contexts and open ones, by document.
    Anchors of over ``limit`` open contexts are hot."""
    plain, local = group[group["kind"] == 0], group[group["kind"] == 1]

    def unpack(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        table = np.concatenate([np.frombuffer(x, dtype=DOC) for x in rows["docs"]] or [np.empty(0, DOC)])
        columns = [np.frombuffer(b"".join(rows[c]), dtype=t) for c, t in (("gram", "<u8"), ("context", "<u8"), ("pos", "<u4"))]
        return table, *columns

    table, gram, context, pos = unpack(plain)
    table2, _, _, pos2 = unpack(local)
    docs = np.concatenate((table, table2))
    order = np.lexsort((docs["key"], docs["id"], docs["null"]))
    names = docs[["null", "id", "key"]][order]
    fresh = np.ones(len(names), dtype=bool)
    fresh[1:] = names[1:] != names[:-1]
    rank = np.empty(len(docs), dtype=np.int64)
    rank[order] = np.cumsum(fresh) - 1
    names = names[fresh]
    of = np.repeat(rank[: len(table)], table["n"])
    of2 = np.repeat(rank[len(table) :], table2["n"])

    by = np.argsort(gram, kind="stable")
    g = gram[by]
    twin = np.zeros(len(g), dtype=bool)
    twin[1:] = g[1:] == g[:-1]
    twin[:-1] |= twin[1:]
    by = by[twin]
    by = by[np.lexsort((pos[by], of[by], context[by], gram[by]))]
    once = np.ones(len(by), dtype=bool)  # a row repeated in another pack brings its anchors again
    once[1:] = (gram[by[1:]] != gram[by[:-1]]) | (of[by[1:]] != of[by[:-1]]) | (pos[by[1:]] != pos[by[:-1]])
    by = by[once]
    gram, context, of, pos = gram[by], context[by], of[by], pos[by].astype(np.int64)
    new_gram = np.ones(len(by), dtype=bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    owner = new_gram.copy()
    owner[1:] |= context[1:] != context[:-1]
    number = np.cumsum(new_gram) - 1
    kinds = np.bincount(number, weights=owner, minlength=0).astype(np.int64)
    open_ = owner & (kinds[number] > 1)
    hot = kinds[number] > limit
    whole_of, whole_pos = np.concatenate((of[~owner], of2)), np.concatenate((pos[~owner], pos2.astype(np.int64)))
    want_of, want_pos, want_gram, want_hot = of[open_], pos[open_], gram[open_].view(np.int64), hot[open_]

    def split(owners: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        order = np.argsort(owners, kind="stable")
        used, at = np.unique(owners[order], return_index=True)
        return dict(zip(used.tolist(), np.split(order, at[1:]))) if len(used) else {}

    whole, want = split(whole_of), split(want_of)
    rows = []
    for d in sorted({*whole, *want}):
        null, doc_id, key = names[d].tolist()
        i, j = whole.get(d, []), want.get(d, [])
        wanted = [{"pos": p, "gram": x, "hot": h} for p, x, h in zip(want_pos[j].tolist(), want_gram[j].tolist(), want_hot[j].tolist())] if len(j) else []
        rows.append((null, doc_id, np.uint64(key).astype(np.int64), whole_pos[i].astype(np.int32) if len(i) else [], wanted))
    return pd.DataFrame(rows, columns=["null", "doc_id", "key", "whole", "want"])


# -- open contexts ------------------------------------------------------------

def repeated_starts(contexts: list[bytes], left: np.ndarray, gram: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Per context: distances before its anchor at which a 100-byte string
    starts that an earlier context has at the same distance.

    ``left``: context bytes before the anchor; ``gram``: anchors; ``rank``:
    order of the contexts in the corpus.
    """
    n = len(contexts)
    block = words.Block(contexts)
    hasher = words.Hasher(block.data)
    anchor = block.starts + left
    # Blocks at -50, -25, 0 (the anchor, 50 bytes), 50 and 75 from the anchor.
    offsets = np.array([-2 * BLOCK, -BLOCK, 0, GRAM, GRAM + BLOCK])
    widths = np.array([BLOCK, BLOCK, GRAM, BLOCK, BLOCK])
    low, high = anchor[:, None] + offsets, anchor[:, None] + offsets + widths
    there = (low >= block.starts[:, None]) & (high <= block.ends[:, None])
    symbol = np.zeros((n, 6), dtype=np.uint64)  # column 5 stays 0, a separator
    flat = there.ravel()
    symbol[:, :5][there] = words.mix(hasher(low.ravel()[flat], high.ravel()[flat]) ^ np.repeat(gram, 5)[flat]) | np.uint64(1)
    exists = np.column_stack((there, np.ones(n, dtype=bool)))
    text = symbol[exists]
    where = np.column_stack(np.nonzero(exists))
    names, text = np.unique(text, return_inverse=True)
    order = np.array(suffix_array(text.tolist()))
    padded = np.concatenate((text, np.zeros(3, dtype=text.dtype)))
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    shared = np.zeros(len(order), dtype=np.int64)  # blocks shared with the suffix before, up to 3
    for k in range(3):
        same[1:] &= (padded[order[1:] + k] == padded[order[:-1] + k]) & (names[np.minimum(padded[order[1:] + k], len(names) - 1)] != 0)
        shared += same
    context, column = where[order, 0], where[order, 1]
    found: list[list[np.ndarray]] = [[], []]

    def mark(classes: np.ndarray, who: np.ndarray, distance: np.ndarray) -> None:
        """All but the earliest of each class start a repeated string."""
        order = np.lexsort((rank[who], classes))
        later = np.zeros(len(order), dtype=bool)
        later[1:] = classes[order][1:] == classes[order][:-1]
        found[0].append(who[order][later])
        found[1].append(distance[order][later])

    aligned = np.cumsum(shared < 3)
    at = np.flatnonzero(column <= 2)
    mark(aligned[at], context[at], -offsets[column[at]])
    core = np.cumsum(shared < 2)
    sizes = np.bincount(core)
    for col in (1, 2):
        at = np.flatnonzero((column == col) & (sizes[core] > 1))
        who = np.repeat(context[at], BLOCK - 1)
        distance = np.tile(np.arange(1, BLOCK), len(at)) - offsets[col]
        start = anchor[who] - distance
        fits = (start >= block.starts[who]) & (start + LENGTH <= block.ends[who])
        who, distance, start = who[fits], distance[fits], start[fits]
        kind = np.repeat(core[at], BLOCK - 1)[fits].astype(np.uint64)
        mark(words.mix(hasher(start, start + LENGTH) + kind * np.uint64(0xD1342543DE82EF95) + distance.astype(np.uint64)), who, distance)
    who, distance = np.concatenate(found[0]), np.concatenate(found[1])
    order = np.argsort(who, kind="stable")
    return np.split(distance[order], np.searchsorted(who[order], np.arange(1, n)))


CONTEXT = "shard int, hot boolean, gram long, context binary, before int, null int, doc_id long, key long, pos int"
STARTS = "null int, doc_id long, key long, starts array<int>"


def _contexts(wanted: DataFrame, shards: int) -> DataFrame:
    """One row per open context."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, want, null, doc_id, key in zip(batch["text"], batch["want"], batch["null"], batch["doc_id"], batch["key"]):
                data = text.encode("utf-8")
                for w in want:
                    low = max(0, w["pos"] - REACH)
                    shard = int(words.mix(np.array([w["gram"]], dtype=np.int64).view(np.uint64))[0] >> np.uint64(20)) % shards
                    rows.append((shard, w["hot"], w["gram"], data[low : w["pos"] + LENGTH], w["pos"] - low, null, doc_id, key, w["pos"]))
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONTEXT.split(", ")])
                    rows = []
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CONTEXT.split(", ")])

    return wanted.mapInPandas(run, CONTEXT)


def _by_suffix_array(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["null", "doc_id", "key", "pos"], kind="stable").reset_index(drop=True)
    distances = repeated_starts(group["context"].tolist(), group["before"].to_numpy(np.int64),
                                group["gram"].to_numpy(np.int64).view(np.uint64), np.arange(len(group)))
    group["starts"] = [(p - d).tolist() for p, d in zip(group["pos"].tolist(), distances)]
    group = group[group["starts"].map(len) > 0]
    return group[["null", "doc_id", "key", "starts"]]


def _one_by_one(hot: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: strings by Spark."""
    distance = F.explode(F.sequence(F.lit(0), F.lit(REACH))).alias("d")
    one = hot.select("null", "doc_id", "key", "pos", "before", "context", "gram", distance)
    one = one.where((F.col("before") >= F.col("d")) & (F.octet_length("context") >= F.col("before") - F.col("d") + LENGTH))
    string = F.expr(f"substring(context, before - d + 1, {LENGTH})")
    one = one.select(F.struct("null", "doc_id", "key", "pos").alias("at"), "null", "doc_id", "key",
                     (F.col("pos") - F.col("d")).alias("start"), "gram", "d", string.alias("string"))
    first = one.groupBy("gram", "d", "string").agg(F.min("at").alias("first"))
    later = one.join(first, ["gram", "d", "string"]).where("at > first")
    return later.groupBy("null", "doc_id", "key").agg(F.collect_list("start").alias("starts"))


# -- texts --------------------------------------------------------------------

def removed(size: int, whole: list[int], starts: list[int]) -> list[tuple[int, int]]:
    """Maximal removed runs of a text: contexts at anchors ``whole`` and
    strings at ``starts``."""
    spans = [(max(0, p - REACH), min(size, p + LENGTH)) for p in whole] + [(s, s + LENGTH) for s in starts]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _cut(whole_characters: bool):
    """UDF of text, whole, starts: n_bytes, spans, the bytes that stay."""

    def run(text: pd.Series, whole: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = []
        for t, w, s in zip(text, whole, starts):
            data = (t or "").encode("utf-8")
            spans = removed(len(data), [] if w is None else list(w), [] if s is None else list(s))
            if whole_characters:  # a character stays unless all of it goes
                spans = [(a, b) for a, b in (_inner(data, *x) for x in spans) if a < b]
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            rows.append((len(data), [{"start": a, "end": b} for a, b in spans], b"".join([*kept, data[at:]])))
        return pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])

    run.__annotations__ = {"text": pd.Series, "whole": pd.Series, "starts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def _inner(data: bytes, a: int, b: int) -> tuple[int, int]:
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _stored_bytes(docs: DataFrame) -> int:
    """Size of the files behind ``docs``, or half of its texts where Catalyst
    knows no size."""
    planned = planned_bytes(docs)
    return planned if planned < 1 << 50 else (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2


def deduplicate(docs: DataFrame, derive: dict[str, Column], whole_characters: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """``docs`` with columns derived from ``cut.n_bytes``, ``cut.spans`` (runs
    removed) and ``cut.kept`` (bytes that stay).  A derived column replaces one
    of the same name.  Texts without open contexts are finished, and dropped,
    at the first join; the others wait for the suffix arrays."""
    place = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in place.items()])
    doc_id, text = F.col(place["doc_id"]), F.col(place["text"])
    key = F.expr("cast(conv(substring(_md5, 1, 15), 16, 10) as bigint)")
    keyed = own.withColumn("_md5", row_key(doc_id, text)).withColumn("_key", key).drop("_md5")
    parts = max(1, math.ceil(_stored_bytes(docs) / sizes.part))
    slim = keyed.select(doc_id.cast("long").alias("doc_id"), F.col("_key").alias("key"), text.alias("text"))
    hot = sizes.hot

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        return _marks(group, hot)

    marks = stored(_packed(slim, parts, sizes.pack).groupBy("pid").applyInPandas(mark, MARK), "marks")
    name = ["null", "doc_id", "key"]
    of_doc = marks.groupBy(*name).agg(F.flatten(F.collect_list("whole")).alias("whole"), F.flatten(F.collect_list("want")).alias("want"))
    n_open = marks.agg(F.sum(F.size("want")), F.max(F.exists("want", lambda w: w["hot"]))).first()
    shards = max(1, math.ceil((n_open[0] or 0) / sizes.shard))

    named = keyed.withColumn("_null", doc_id.isNull().cast("int")).withColumn("_id", F.coalesce(doc_id.cast("long"), F.lit(0)))
    match = [F.col("_null") == F.col("null"), F.col("_id") == F.col("doc_id"), F.col("_key") == F.col("key")]
    joined = named.join(of_doc, match, "left")
    waits = F.coalesce(F.size("want") > 0, F.lit(False))
    cut = _cut(whole_characters)
    none = F.lit(None).cast("array<int>")
    others = [p for p in place.values() if p != place["text"]]
    target = {c: f"_d{i}" for i, c in enumerate(derive)}

    def finished(df: DataFrame, starts: Column) -> DataFrame:
        full = df.withColumn("cut", cut(F.col(place["text"]), F.col("whole"), starts))
        return full.select(*[c for c in full.columns if c != "cut"], *[e.alias(target[c]) for c, e in derive.items()])

    first = finished(joined.withColumn("_wait", waits), none)
    held = [F.when(F.col("_wait"), F.col(place["text"])).alias(place["text"]),
            *[F.when(~F.col("_wait"), F.col(t)).alias(t) for t in target.values()]]
    table = stored(first.select(*others, *held, "whole", "want", "_wait", "_null", "_id", "_key"), "joined")
    waiting = table.where("_wait")
    wanted = waiting.select(F.col(place["text"]).alias("text"), "want", F.col("_null").alias("null"), F.col("_id").alias("doc_id"), F.col("_key").alias("key"))
    contexts = _contexts(wanted.dropDuplicates(name), shards)
    starts = contexts.where("not hot").groupBy("shard").applyInPandas(_by_suffix_array, STARTS)
    if n_open[1]:
        starts = starts.unionByName(_one_by_one(contexts.where("hot")))
    starts = stored(starts, "starts").groupBy(*name).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    rest = finished(waiting.drop(*target.values()).join(starts, match, "left"), F.col("starts"))
    columns = [*[place[c] for c in docs.columns if place[c] in others and c not in derive], *target.values()]
    done = table.where("not _wait").select(*columns).unionByName(rest.select(*columns))
    order = [c for c in docs.columns if c in derive or place[c] in columns] + [c for c in derive if c not in place]
    return done.select(*[F.col(target.get(c) or place[c]).alias(c) for c in order])


def clean(docs: DataFrame) -> DataFrame:
    """Documents without repeated strings, whole characters only; the same
    columns, n_chars renewed."""
    text = F.when(F.size("cut.spans") > 0, F.decode("cut.kept", "UTF-8")).otherwise(F.col(f"_c{docs.columns.index('text')}"))
    derive = {"text": text}
    if "n_chars" in docs.columns:
        old = F.col(f"_c{docs.columns.index('n_chars')}")
        derive["n_chars"] = F.when(F.size("cut.spans") > 0, F.char_length(F.decode("cut.kept", "UTF-8")).cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return deduplicate(docs, derive, whole_characters=True).select(*[f"`{c}`" for c in docs.columns])
