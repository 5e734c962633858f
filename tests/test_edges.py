"""Edges by expressions against a walk sample by sample."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.functions import edges as E


def parabola_slope(x, width):
    """Dense least squares: a parabola around every sample, the outermost one
    at the ends; then central differences."""
    half, fit = width // 2, np.empty(len(x))
    for i in range(len(x)):
        a = min(max(0, i - half), len(x) - width)
        fit[i] = np.polyval(np.polyfit(np.arange(a, a + width), x[a : a + width], 2), i)
    return np.array([(fit[min(i + 1, len(x) - 1)] - fit[max(i - 1, 0)]) / (min(i + 1, len(x) - 1) - max(i - 1, 0)) for i in range(len(x))])


def walk(y, center, fs, side, reach_ms=200.0):
    if y is None or not len(y) or center is None:
        return None
    c, reach, beyond = min(max(center, 0), len(y) - 1), round(reach_ms * fs / 1000), round(60 * fs / 1000)
    a, b = (max(0, c - reach), c) if side == "left" else (c, min(len(y) - 1, c + reach))
    far = (max(0, a - beyond), a) if side == "left" else (b, min(len(y) - 1, b + beyond))
    seg, base, width = y[a : b + 1], y[far[0] : far[1] + 1], max(3, round(fs / 50)) | 1
    if len(seg) < width or np.isnan(seg).any() or np.isnan(base).any():
        return c, False
    d = parabola_slope(seg, width)
    steep = np.abs(d).max()
    for k in range(len(seg) - 1, -1, -1) if side == "left" else range(len(seg)):
        if steep > 1e-12 and abs(d[k]) <= 0.2 * steep and abs(seg[k] - np.median(base)) <= 0.05 * steep:
            return a + k, True
    return c, False


def cases():
    rng, out = np.random.default_rng(3), []
    for n in (1, 2, 4, 5, 6, 40, 90, 200):
        for _ in range(12):
            t, peak = np.arange(n), n * rng.random()
            wave = np.exp(-((t - peak) / rng.uniform(1, 4)) ** 2 / 2) * rng.normal(0, 2)
            out.append((wave + rng.normal(0, 0.01, n), int(rng.integers(-3, n + 4))))
            out.append((wave + rng.normal(0, 1e-3, n), int(peak)))  # flat beyond the wave: most have edges
    gap = np.sin(np.arange(60) / 5.0)
    gap[20] = np.nan
    return [*out, (gap, 40), (gap, 10), (np.zeros(50), 25), (np.empty(0), 0), (None, 3), (np.ones(9), None)]


@pytest.mark.parametrize("fs", [100.0, 250.0, 500.0])
@pytest.mark.parametrize("reach_ms", [80.0, 200.0])
def test_edges_equal_a_walk(spark, fs, reach_ms):
    rows = cases()
    df = spark.createDataFrame([(k, None if y is None else y.tolist(), c) for k, (y, c) in enumerate(rows)], "k int, y array<double>, c int")
    got = df.select("k", *[E.edge(F.col("y"), F.col("c"), fs, s, reach_ms).alias(s) for s in ("left", "right")]).collect()
    found = 0
    for r in got:
        for side in ("left", "right"):
            want = walk(*rows[r["k"]], fs, side, reach_ms)
            assert (r[side] and (r[side]["at"], r[side]["found"])) == want
            found += bool(want and want[1])
    assert found > 20


def test_missing_sample_is_like_nan(spark):
    y = [float(k % 7) for k in range(60)]
    y[30] = None
    df = spark.createDataFrame([(y,)], "y array<double>")
    r = df.select(E.edge(F.col("y"), F.lit(35), 250.0, "left").alias("e")).first()["e"]
    assert (r["at"], r["max_slope"], r["found"]) == (35, None, False)
    with pytest.raises(ValueError):
        E.edge(F.col("y"), F.lit(1), 250.0, "up")


def test_derivative_of_a_parabola(spark):
    y = [0.5 * k * k - 3 * k + 1 for k in range(30)]
    df = spark.createDataFrame([(y,), (y[:4],), ([],), (None,)], "y array<double>")
    got = [r[0] for r in df.select(E.smooth_derivative(F.col("y"), 250.0)).collect()]
    assert np.allclose(got[0][1:-1], [k - 3 for k in range(1, 29)]) and got[1:] == [None, None, None]
