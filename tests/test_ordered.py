"""Sliced plans must give the same rows as plain windows, skewed data included."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from beatloom.operators import hrv as H
from beatloom.operators.ordered import sequence
from beatloom.operators.quantiles import percentiles, upper_middle


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    # one record holds more than a third of the rows; gaps leave empty slices
    rid = np.where(rng.random(1500) < 0.4, 0, rng.integers(1, 40, 1500))
    t = np.sort(rng.choice(60_000, 1500)) + np.where(rng.random(1500) < 0.1, 200_000, 0)
    v = np.where(rng.random(1500) < 0.15, np.nan, np.round(rng.normal(800, 60, 1500), 1))
    pdf = pd.DataFrame({"record_id": rid, "t": t, "id": np.arange(1500), "v": v})
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    return df.cache()


def both(series, build, width):
    out = []
    for kw in ({"slices": 1}, {"slice_width": width}):
        rows = build(sequence(series, ["record_id"], ["t", "id"], **kw)).rows()
        out.append(rows.orderBy("record_id", "t", "id").toPandas())
    return out


@pytest.mark.parametrize("width", [137, 5_000, 1_000_000])
def test_bounded_frames(series, width):
    def build(s):
        return s.near(lambda w: {
            "prev": F.lag("v").over(w), "next": F.lead("v").over(w),
            "mean": F.round(F.avg("v").over(w.rowsBetween(-3, 3)), 9),
        }, before=3, after=3)

    plain, sliced = both(series, build, width)
    pd.testing.assert_frame_equal(plain, sliced[plain.columns])


@pytest.mark.parametrize("width", [137, 5_000])
def test_prefix_frames(series, width):
    def build(s):
        return s.last_valid_before("v", "last_v").running_sum("id", "run").position("pos")

    plain, sliced = both(series, build, width)
    pd.testing.assert_frame_equal(plain, sliced[plain.columns], check_dtype=False)


def test_ranged_slices(series):
    cut = sequence(series, ["record_id"], ["t", "id"], slices=15)
    assert cut.df.groupBy("_slice").count().agg(F.max("count")).first()[0] < 300  # the hot record has 600 rows
    plain = sequence(series, ["record_id"], ["t", "id"], slices=1)

    def build(s):
        return s.near(lambda w: {"prev": F.lag("v").over(w)}, before=1).running_sum("id", "run").last_valid_before("v", "last")

    a, b = (build(s).rows().orderBy("record_id", "t", "id").toPandas() for s in (plain, cut))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


@pytest.mark.parametrize("kw", [{"slices": 1}, {"slices": 6}, {"slice_width": 50.0}])
def test_missing_order_values_come_first(spark, kw):
    rows = [(r, None if k < 2 else 10 * k, k, float(k)) for r in ("a", None) for k in range(40)]
    df = spark.createDataFrame(rows, "record_id string, t long, id long, v double")
    s = sequence(df, ["record_id"], ["t", "id"], **kw)
    s = s.near(lambda w: {"prev": F.lag("v").over(w), "ahead": F.lead("v", 2).over(w)}, before=1, after=2).last_valid_before("v", "last").position("n")
    got = s.rows().collect()
    assert len(got) == 80
    for r in got:
        k = r["id"]
        assert (r["prev"], r["last"], r["ahead"], r["n"]) == (k - 1 if k else None, k - 1 if k else None, k + 2 if k < 38 else None, k)


def test_hrv_sliced_equals_plain(series):
    frames = []
    for kw in ({"slices": 1}, {"slice_width": 900}, {"slices": 9}):
        out = H.hrv(sequence(series, ["record_id"], ["t", "id"], **kw), value="v")
        frames.append(out.orderBy("record_id").toPandas())
    for other in frames[1:]:
        pd.testing.assert_frame_equal(frames[0], other)


def test_percentiles_refined_equal_builtin(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({
        "k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n)),
        # ties, heavy tail and negatives together
        "v": np.where(rng.random(n) < 0.3, 5.0, np.exp(rng.normal(0, 6, n)) * rng.choice([-1, 1], n)),
    })
    df = spark.createDataFrame(pdf)
    probs = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = percentiles(df, ["k"], "v", probs).orderBy("k").toPandas()
    for row in got.itertuples():
        want = np.percentile(pdf.v[pdf.k == row.k], [0, 25, 50, 95, 100])
        np.testing.assert_allclose([row.q0, row.q25, row.q50, row.q95, row.q100], want, rtol=1e-12)


def test_percentiles_of_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("inf", v) for v in (1.0, inf, 2.0)] + [("nan", v) for v in (nan, 1.0, 2.0, 3.0)] + [("low", v) for v in (-inf, 4.0)]
    rows += [("none", None), (None, 7.0), ("same", 5.0), ("same", 5.0)] + [("hot", float(k % 1000)) for k in range(20_000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: (r["mid"], r["top"]) for r in percentiles(df, ["k"], "v", {"mid": 0.5, "top": 1.0}).collect()}
    assert got.pop("nan")[0] == 2.5 and got == {
        "inf": (2.0, inf), "low": (-inf, 4.0), None: (7.0, 7.0), "same": (5.0, 5.0), "hot": (499.5, 999.0)}
    assert percentiles(df.where("k = 'hot'"), [], "v", {"q": 0.25}).first()["q"] == 249.75
    assert percentiles(df.limit(0), ["k"], "v", {"q": 0.5}).count() == 0
    assert percentiles(df.limit(0), [], "v", {"q": 0.5}).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_median_of_the_upper_half(spark, n):
    values = sorted(float(k * k) for k in range(n))
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    assert percentiles(df, ["k"], "v", {"m": upper_middle}).first()["m"] == np.median(values[n // 2 :])
