"""The manifest against a tree built in plain Python, at several partition sizes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from beatloom.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(leaves):
    """(root, path of every leaf) of one list of digests."""
    paths, spots, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, at in enumerate(spots):
            start = at - at % 8
            paths[i].append(("".join(level[start:at]), "".join(level[at + 1:start + 8])))
        level = [sha("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
        spots = [at // 8 for at in spots]
    return level[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[name] = tree([leaf_of(r) for r in groups[name]])
    root, over = tree([built[n][0] for n in names]) if names else (None, [])
    out = []
    for name, high in zip(names, over):
        subroot, paths = built[name]
        for r, low in zip(groups[name], paths):
            path = low + high
            node = leaf_of(lowered(r))
            for before, after in path:
                node = sha(before + node + after)
            out.append((r[0], leaf_of(r), subroot, root, sha("".join(b + a for b, a in path)), node))
    return out


def lowered(r):
    struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
    return (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if struck else r


def got(spark, rows, inner):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(struck, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return [tuple(r) for r in M.documents_manifest(docs, {"text": text}, inner).collect()]


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("inner", [0, 1, 4])
def test_equals_plain_tree(spark, inner):
    rnd = random.Random(inner)
    sizes = {None: 1, "a": 75, "": 8, "é": 9, "z": 530 if inner else 70}
    rows = [(i * 10**12 if i % 7 else i, rnd.choice([None, "s"]), lang, rnd.choice([None, i]), rnd.choice([None, "", f"Text {i} Ää", "same"]))
            for lang, n in sizes.items() for i in range(n)]
    assert sorted(got(spark, rows, inner), key=key) == sorted(plain(rows), key=key)


def test_many_trees_and_repeated_rows(spark):
    rows = [(i % 40, "s", f"l{i % 11}", 1, "T") for i in range(300)] + [(None, None, None, None, None)] * 10
    assert sorted(got(spark, rows, 1), key=key) == sorted(plain(rows), key=key)


def test_one_row_and_none(spark):
    assert got(spark, [(5, "s", "en", 1, "x")], 4) == plain([(5, "s", "en", 1, "x")])
    assert got(spark, [], 4) == []


def test_long_text_and_extra_columns(spark):
    row = (1, "s", "en", 1, "Ab" * 400_000)
    df = spark.createDataFrame([(*row, 1, "x", 2)], SCHEMA + ", block int, leaf string, levels int")
    assert [tuple(r) for r in M.documents_manifest(df).collect()] == plain_untouched(row)


def plain_untouched(row):
    d = leaf_of(row)
    return [(row[0], d, d, d, sha(""), d)]
