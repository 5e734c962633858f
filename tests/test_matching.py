from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from beatloom.operators import matching as M


def brute_greedy(truth, found, tol):
    pairs = sorted((abs(a - b), a, b) for a in truth for b in found if abs(a - b) <= tol)
    used_t, used_f, out = set(), set(), []
    for d, a, b in pairs:
        if a not in used_t and b not in used_f:
            used_t.add(a), used_f.add(b), out.append((int(a), int(b)))
    return sorted(out)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    make = lambda n: pd.DataFrame({
        "rec": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 4, n)), "at": rng.integers(-400, 3000, n)})
    t, f = make(300).drop_duplicates(), make(320).drop_duplicates()
    return t, f, spark.createDataFrame(t), spark.createDataFrame(f)


@pytest.mark.parametrize("tol", [0, 3, 25])
def test_hits_equal_brute_force(points, tol):
    t, f, ts, fs = points
    got = M.hits(ts, fs, ["rec"], "at", tol).toPandas()
    by_rec = f.groupby("rec")["at"].apply(np.array).to_dict()
    want = [bool((np.abs(by_rec.get(r, np.array([10**9])) - a) <= tol).any()) for r, a in zip(got.rec, got["at"])]
    assert got.hit.tolist() == want


@pytest.mark.parametrize("tol,width,limit", [(3, 10, 1000), (25, 60, 1000), (25, 60, 5), (25, 60, 40)])
def test_greedy_equals_brute_force(points, tol, width, limit):
    t, f, ts, fs = points
    got = M.match_one_to_one(ts, fs, ["rec"], "at", tol, width, limit).toPandas()
    for rec in sorted(t.rec.unique()):
        mine = sorted(zip(got.truth_at[got.rec == rec].astype(int), got.found_at[got.rec == rec].astype(int)))
        assert mine == brute_greedy(t["at"][t.rec == rec], f["at"][f.rec == rec], tol)


def test_no_candidates(spark, points):
    _, _, ts, fs = points
    far = fs.selectExpr("rec", "at + 100000 AS at")
    assert M.match_one_to_one(ts, far, ["rec"], "at", 5, 50).count() == 0


def test_shrinking_chain(spark):
    """Every pair competes with the one before it."""
    gaps = np.arange(10_000, 0, -1)
    at = np.cumsum(gaps)
    truth = spark.createDataFrame(pd.DataFrame({"rec": 1, "at": at[::2]}))
    found = spark.createDataFrame(pd.DataFrame({"rec": 1, "at": at[1::2]}))
    got = M.match_one_to_one(truth, found, ["rec"], "at", 20_000, 30_000).toPandas()
    assert len(got) == 5000 and got.distance.sum() == gaps[1::2].sum()
