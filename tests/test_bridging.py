"""Baseline and QRS removal against dense fits and one beat after another."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.functions import bridges as B
from beatloom.operators import bridging as BR
from beatloom.sources.recordings import from_arrays

FS = 100.0


def dense(x, width):
    h = width // 2
    p = np.pad(x, h, mode="edge")
    return np.array([np.polynomial.Polynomial.fit(np.arange(-h, h + 1), p[i : i + width], 3)(0.0) for i in range(len(x))])


def in_order(y, peaks, s_off, fs):
    """Bridges one after another on the whole recording."""
    x, n, k = np.array(y, float), len(y), max(1, round(fs / 100))
    for i, r in enumerate(peaks):
        rr = r - peaks[i - 1] if i else (peaks[1] - r if len(peaks) > 1 else round(0.8 * fs))
        right = round(0.08 * fs) if s_off[i] is None else round(s_off[i] - r + 0.05 * fs)
        a, b = max(0, r - round(rr / 3)), min(n, r + right)
        if a >= b:
            continue
        lo = x[max(0, a - k) : a].mean() if a else x[0]
        hi = x[b : b + k].mean() if b < n else x[-1]
        x[a:b] = lo + (hi - lo) / (1 + np.exp(-np.linspace(-6, 6, b - a)))
    return x


def signal(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(0, 0.1, n)) + rng.normal(0, 1, n) + 50.0


def stitched(df):
    out = {}
    for r in df.where("reason IS NULL").orderBy("record_id", "start").collect():
        out.setdefault(r["record_id"], []).append(np.array(r["y"][r["lead"] : r["lead"] + r["core"]]))
    return {k: np.concatenate(v) for k, v in out.items()}


def recordings(spark, signals):
    return spark.createDataFrame([(k, FS, None if y is None else list(map(float, y))) for k, y in signals.items()],
                                 "record_id string, fs double, signal array<double>")


@pytest.mark.parametrize("half", [2, 7, 40])
def test_running_cubic_is_the_dense_fit(half):
    for n in (1, 5, 81, 400):
        x = signal(n, half) * 1e3
        assert np.allclose(B.running_cubic(x, half), dense(x, 2 * half + 1), rtol=0, atol=1e-7)


@pytest.mark.parametrize("seconds", [25.0, 300.0])
def test_baseline_has_no_seams(spark, seconds):
    signals = {"long": signal(9000), "middling": signal(150, 1), "brief": signal(60, 2), "one": [3.0]}
    got = stitched(BR.remove_baseline(from_arrays(recordings(spark, signals), seconds, 12.0)))
    for name, y in signals.items():
        want = np.array(y, float)
        for width in (75, 200):
            if len(y) > width:
                want = want - dense(want, width | 1)
        assert np.allclose(got[name], want, atol=1e-8), name


def test_refused_recordings_and_short_halos(spark):
    gap = signal(9000)
    gap[7000] = np.nan
    chunks = from_arrays(recordings(spark, {"gap": gap, "sound": signal(4000), "none": [], "null": None}), 25.0, 0.5)
    rows = BR.remove_baseline(chunks).collect()
    assert {(r["record_id"], r["reason"]) for r in rows} == {("gap", "missing samples"), ("sound", "halo too short")}
    assert all(r["y"] is None for r in rows)
    beats = spark.createDataFrame([("sound", 300), ("sound", 2700), ("gap", 5)], "record_id string, r_idx int")
    got = {(r["record_id"], r["chunk_id"]): r["reason"] for r in BR.remove_qrs(chunks, beats).collect()}
    # the bridge over 2700 starts at 1900, ahead of the second chunk's halo
    assert got["sound", 0] == got["sound", 1] == "halo too short" and got["gap", 2] == "missing samples"


@pytest.mark.parametrize("seconds", [25.0, 40.0, 300.0])
@pytest.mark.parametrize("gap", [(60, 120), (11, 16), (6, 9)])
def test_bridges_equal_one_after_another(spark, seconds, gap):
    """Slow rhythms, bridges that read the one before, and bridges that overlap;
    beats at and around the borders of chunks."""
    rng, signals, beats, peaks = np.random.default_rng(sum(gap)), {}, [], {}
    for name, n in (("a", 9000), ("b", 2600), ("c", 90)):
        signals[name] = signal(n, n)
        r = np.cumsum(rng.integers(*gap, n))
        peaks[name] = [int(p) for p in r[r < n]]
        beats += [(name, p, None if k % 3 else float(p + 2)) for k, p in enumerate(peaks[name])]
    df = spark.createDataFrame(beats, "record_id string, r_idx int, s_offset double").repartition(3)
    again = df.unionByName(df)  # repeated beats count once
    got = stitched(BR.remove_qrs(from_arrays(recordings(spark, signals), seconds, 12.0), again))
    for name, y in signals.items():
        s_off = [s for k, _, s in beats if k == name]
        assert np.allclose(got[name], in_order(y, peaks[name], s_off, FS), atol=1e-9), name


def test_spans_of_odd_beats(spark):
    chunks = from_arrays(recordings(spark, {"lone": signal(500), "quiet": signal(300), "edge": signal(100)}))
    beats = spark.createDataFrame(
        [("lone", 100, float("nan")), ("edge", 0, None), ("edge", 99, None), ("edge", None, 5.0), (None, 3, None),
         ("unknown", 50, None), ("lone", 300, 200.0)], "record_id string, r_idx int, s_offset double")
    got = {(r["record_id"], r["r_idx"]): (r["from_idx"], r["to_idx"]) for r in BR.qrs_spans(chunks, beats).collect()}
    # S far ahead of R leaves no bridge there
    assert got == {("lone", 100): (33, 108), ("edge", 0): (0, 8), ("edge", 99): (66, 100)}
    out = stitched(BR.remove_qrs(chunks, beats))
    assert np.allclose(out["quiet"], signal(300)) and np.allclose(out["edge"], in_order(signal(100), [0, 99], [None] * 2, FS))
    empty = BR.remove_qrs(chunks.limit(0), beats)
    assert empty.count() == 0 and BR.remove_qrs(chunks, beats.where(F.lit(False))).count() == 3
