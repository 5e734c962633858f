import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from beatloom.llm import near_duplicates as nd
from beatloom.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def weighted(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows):
    """Class name (least id) of every row, comparing all pairs that share a run."""
    sets = [weighted(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or [("bytes", rows[i][1] or "")]:
            holders[x].append(i)
    near = set()
    for i, s in enumerate(sets):
        for x in s or [("bytes", rows[i][1] or "")]:
            near.update((i, j) for j in holders[x] if j > i)
    for i, j in near:
        a, b = sets[i], sets[j]
        if not a or sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return [least.get(find(i)) for i in range(len(rows))]


def check(spark, rows, limit=nd.CELL):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.classes(docs, limit).collect()
    want = Counter(zip([r[0] for r in rows], brute(rows)))
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want


def noisy(base, n, rate, seed):
    rng, out = random.Random(seed), []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randrange(rate)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("limit", [nd.CELL, 7])
def test_copies_and_chains(spark, limit):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = noisy(base, 40, 4, 1) + [" ".join(base)] * 60
    chain, now = [], list(base[::-1])
    for k in range(12):  # each link is near, the ends are not
        chain.append(" ".join(now))
        now = [*now[2:], f"c{k}", f"d{k}"]
    texts += chain + ["", None, "!!!", "!!!", "???", "one two", "One, TWO!", "a b c d e", "a b c d", "word " * 9000, "word " * 8999]
    check(spark, list(enumerate(texts)) + [(None, "a b c d e"), (None, "lonely row without an id"), (3, texts[3])], limit)


def test_sketch_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 60, dtype=np.int64).astype(np.uint64)
    a, b = rng.uniform(0, 3, 60), rng.uniform(0, 3, 60)
    both = nd.dart_minhash(np.concatenate((e, e)), np.concatenate((a, b)), np.repeat([0, 1], 60), 2, 4000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((both[0] == both[1]).mean() - want) < 0.04
    alone = nd.dart_minhash(e, a, np.zeros(60, np.int64), 1, 4000)
    assert (alone[0] == both[0]).all()  # a sketch does not depend on its neighbours


def test_stage_keeps_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "a", "en"), (2, text + " end", "b", "en"), (0, "other words here", "c", None), (0, "other words here", "c", None),
            (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, _key string")
    got = nd.distinct_documents(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["key"] or "") for r in got.collect()) == [(-1, ""), (-1, "c"), (1, "a")]
    assert nd.distinct_documents(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(9, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = list(range(500))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}
