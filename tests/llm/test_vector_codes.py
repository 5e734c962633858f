"""Vector codes against plain Python, and exact products of large integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from beatloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, n_parts, n_entries, rounds):
    """[(vec_id, label, code, error)], label sums and digest, one number at a time."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in v], l) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[1] and len(r[1]) % n_parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not order:
        return [(i, l, None, None) for i, _, l in kept], {}, None
    width = len(order[0][1])
    fit = [r for r in order if len(r[1]) == width]
    d = width // n_parts
    cut = lambda v: [v[p * d:(p + 1) * d] for p in range(n_parts)]
    books = [[cut(r[1])[p] for r in fit[:n_entries]] for p in range(n_parts)]

    def nearest(part, entries):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in entries]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        given = [[[] for _ in books[p]] for p in range(n_parts)]
        for _, v, _ in fit:
            for p, part in enumerate(cut(v)):
                given[p][nearest(part, books[p])[0]].append(part)
        books = [[[sum(c) // len(g) for c in zip(*g)] if g else e for e, g in zip(books[p], given[p])] for p in range(n_parts)]
    out, sums = [], {}
    for i, v, l in kept:
        if len(v) != width:
            out.append((i, l, None, None))
            continue
        found = [nearest(part, books[p]) for p, part in enumerate(cut(v))]
        error = sum(f for _, f in found)
        error = error if error < 2**63 else None
        out.append((i, l, "".join(f"{k:02x}" for k, _ in found), error))
        if error is not None:
            sums[l] = sums.get(l, 0) + error
    digest = hashlib.sha256(",".join(str(n) for p in books for e in p for n in e).encode()).hexdigest()
    return out, sums, digest


def check(spark, rows, n_parts=4, n_entries=5, rounds=2):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coded, books = V.compress(df, n_parts, n_entries, rounds)
    got = [tuple(r) for r in V.with_label_error(coded).select("vec_id", "label", "code", "error", "label_error").collect()]
    want, sums, digest = plain(rows, n_parts, n_entries, rounds)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(((*r, sums.get(r[1])) for r in want), key=key)
    assert (books.digest() if books else None) == digest


def test_equals_plain_python(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.uniform(-2, 2) for _ in range(8)], rnd.choice([None, 0, 1])) for i in range(60)]
    check(spark, rows)


def test_dropped_and_odd_rows(spark):
    rows = [(9, [0.5, -0.5, 1.0, 0.0], 1), (9, [0.5, -0.5, 1.0, 0.0], 1), (9, [0.25, 0.0, 0.0, 0.0], 1), (3, None, 1),
            (4, [0.1, None, 0.0, 0.0], 1), (5, [float("nan"), 0.0, 0.0, 0.0], 2), (6, [0.0, float("inf"), 0.0, 0.0], 2),
            (None, [1.0, 2.0, 3.0, 4.0], None), (7, [], 3), (8, [1.0, 2.0], 3), (10, [1.0] * 8, 3), (-1, [-0.001, 0.0, 0.002, 1.0], None)]
    check(spark, rows)


def test_ties_go_to_the_lower_entry(spark):
    check(spark, [(i, [float(i % 2)] * 4, 0) for i in range(12)])


def test_numbers_beyond_int64(spark):
    rows = [(0, [1e30, 1.0, -3e9, 0.5], 0), (1, [-1e30, 1.0, 2e12, 0.0], 0), (2, [1e30, 2.0, -3e9, 1e7], 1), (3, [0.0, 0.0, 0.0, 0.0], 1)]
    check(spark, rows, n_entries=2)
    check(spark, [(i, [1e6 * i, -2e7, 3e5 + i, 1e9], 0) for i in range(9)], n_entries=3)


def test_empty_and_useless_tables(spark):
    check(spark, [])
    check(spark, [(1, None, 0)])
    check(spark, [(1, [], 0), (2, [1.0], 0)])


def test_other_columns_do_no_harm(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], 0, "x", 5)], SCHEMA + ", code string, v int")
    assert V.compress(df, 4, 4)[0].columns == ["vec_id", "label", "code", "error"]


@pytest.mark.parametrize("bits", [3, 20, 28, 31, 45, 70])
def test_products_are_exact(bits):
    rnd = random.Random(bits)
    draw = lambda n: np.array([[rnd.randint(-(1 << bits), 1 << bits) for _ in range(6)] for _ in range(n)], dtype=np.int64 if bits < 62 else object)
    a, b = draw(7), draw(5)
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
    assert [[int(x) for x in row] for row in V.dot(a, b)] == want
